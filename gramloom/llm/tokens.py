"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary used where none is given; GRAMLOOM_TOKENIZER overrides it.
VOCABULARY = os.environ.get("GRAMLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Splits a text before merges of a rank file are applied (fixed value of these vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BUILT: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(name: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """Counts tokens with a vocabulary file's content: ``.tiktoken`` ranks, ``.json`` or ``.model`` (sentencepiece). Built once in a process."""
    key = hashlib.md5(data).hexdigest()
    if key not in _BUILT:
        if name.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
            own = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _BUILT[key] = lambda texts: [len(own.encode_ordinary(t)) for t in texts]
        elif name.endswith(".json"):
            from tokenizers import Tokenizer

            other = Tokenizer.from_str(data.decode())
            other.encode_special_tokens = True
            _BUILT[key] = lambda texts: [len(x.ids) for x in other.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_proto=data)
            _BUILT[key] = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    return _BUILT[key]


def with_tokens(spark: SparkSession, frame: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replaces ``text`` by ``tokens`` (bigint), 0 for null and empty texts. The vocabulary file (at most a few MB) is read here and sent along."""
    if os.path.getsize(vocabulary) > 32e6:
        raise ValueError("a vocabulary of more than 32 MB isn't broadcast")
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    name = os.path.basename(vocabulary)
    others = [c for c in frame.columns if c not in (text, "tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(name, data.value)
        for batch in batches:
            n = pa.array(own([x or "" for x in batch.column(len(others)).to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), n], names=[*others, "tokens"])

    own = frame.select(*others, F.col(text))
    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in others) + ", tokens bigint"
    return own.mapInArrow(count, schema)


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number above 0 and below 1 that depends on nothing but the columns and the seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / 2.0**53
