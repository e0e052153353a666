"""Labelled sentences, some for each script, that the sentence model is always trained on: an entry of a list is one sentence, and neighbours follow one another."""

SEEDS = [
    ["The list was short.", "Nobody read it, cf. the note by Mr. Hale.", "Did it help?", "No!", "It cost 3.5 units, i.e. too much.", "See sec. 4 for more.", "Then it was gone."],
    ["Prof. Lind came at 8 a.m. and left.", "She wrote to R. B. Moss of Tarn Ltd. about it.", "The file data.raw.txt is empty.", "Is version 2.0.1 better?", "He paused ... and went on.", "It was late..."],
    ["“Go home. It is over,” said Ms. Hale.", "They left.", "“Who won?”", "“Nobody.”", 'He asked, "Is it done? I hope so." and sat down.', "We see trees, roots, etc. in it.", "Rates fell by 0.2%.", "The work ended at 6 p.m.", "Rain fell."],
    ["(See the table.)", "The rest (cf. no. 7) is lost.", "Write to http://b.invalid/y?q=1 soon.", "Why not?!", "Mt. Ard is high.", "Both, e.g. ash and elm, grow there, vs. none here.", "It grew in vol. 12, ch. 3.", "Next came St. Ann."],
    ["It follows Rahn et al.", "Then it stops.", "We met Rahn et al. there.", "They sell tea, rice, etc.", "Prices rose.", "It belongs to Tarn Inc.", "Work began at 9 a.m.", "All came."],
    ["Der Bach ist tief.", "Hr. Lahn sah ihn z. B. am 4. Juni.", "Das gilt d. h. immer.", "Warum?", "„Halt! Nicht weiter“, rief Frau Dr. Moos.", "„Wer war das?“", "Es kostet 2,5 Mark bzw. mehr.", "Siehe S. 9 ff. und Abb. 2.", "Im 3. Jahr war Ruhe.", "Alles endet, usw. und so fort.", "Gut."],
    ["Le pont est vieux.", "M. Dax dit « Non ! Pas ici » et part.", "« Venez ! »", "Voir p. ex. la fig. 8.", "Est-ce loin ?", "Mme Aube paie 4,5 francs.", "C'est fini !"],
    ["La casa es vieja.", "El Dr. Paz y la Sra. Sol llegaron.", "¿Dónde están?", "¡Aquí!", "Véase p. ej. la pág. 5.", "Anotó: «Es tarde. No voy» y salió.", "Costó 3,5 reales, etc., y nada más."],
    ["Река глубока.", "Проф. Лунин видел её, т. е. берег.", "Почему?", "Да!", "См. стр. 8 и рис. 2.", "В 1990 г. она высохла.", "Их было 5 тыс. штук.", "«Стой. Не ходи», — сказал он.", "Рыбы, птицы и т. д. ушли."],
    ["Το νερό είναι κρύο.", "Ο κ. Λίνος το είδε, π.χ. χθες.", "Γιατί;", "Κανείς!", "Βλ. σελ. 3 για το τέλος.", "Τίποτα δεν έμεινε· όλα χάθηκαν."],
    ["नदी गहरी है।", "डॉ. राव आए।", "क्यों?", "हाँ!", "पृ. 8 देखें।", 'उसने लिखा, "रुको। मत जाओ।" और चला गया।', "मान 2.5 है।"],
    ["النهر عميق.", "لماذا؟", "نعم!", "القيمة 2.5 فقط.", "قال: «قف. لا تذهب.» ثم رحل.", "انظر ص. 8 الآن."],
    ["ወንዙ ጥልቅ ነው።", "ለምን?", "ዶ/ር ላማ መጣ።", "ማን ነው፧", "እዚህ ነው።"],
    ["Գետը խորն է։", "Ինչո՞ւ։", "Տես էջ 8 և նկ. 2։", "«Կանգնիր։ Մի գնա» ասաց նա։", "Վերջ։"],
    ["河很深。", "为什么？", "是的！", "他说：“停下！别走。”然后离开了。", "数值是2.5。", "见第8页……其余没有。", "版本3.0.1很旧。", "（见下文。）"],
    ["川は深い。", "なぜ？", "はい！", "「止まれ！」と彼は言った。", "値は2.5だった。", "図3を見よ……続きは次だ。", "彼は「行くな。待て。」と書いた。"],
    ["แม่น้ำลึกมาก", "ทำไมจึงลึก", "เขาเห็น 5 ครั้งแล้ว", "คำว่า tree อยู่ตรงนี้", "สิ่งต่าง ๆ หายไป", "ไม่มีใครรู้"],
]
