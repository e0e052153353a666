from gramloom.streaming import scorer


def test_stream_is_scored_and_measured(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("+1 a b\n;note\n\n-1 c\n")
    made = spark.createDataFrame([(0, "a b", ["a", "b"], 1.5)], "feature_id int, pattern string, tokens array<string>, weight double")
    seen = []
    stream = scorer.labelled_stream(spark, str(tmp_path / "in"))
    query = scorer.score_stream(stream, made, lambda rows, report, n: seen.append((sorted((r["y"], r["score"]) for r in rows.collect()), report.first()["accuracy"], n))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert seen == [([(-1, 0.0), (1, 1.5)], 100.0, 0)]
