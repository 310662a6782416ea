"""Operator 9: token counts by a public tokenizer, lengths only.

The library encodes batches of about equal bytes inside Arrow functions and only lengths come back.
A BPE vocabulary file with white-space pre-tokens never merges across white space, so that long texts
are split there, and a chunk that comes again in a worker isn't encoded again. A text without white space
is one chunk, however long: there is no safer boundary in it.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of texts that the library gets at once.
BATCH_BYTES = 256 * 1024
#: Chunks whose lengths a Python worker keeps; when full, it starts anew.
CACHED_CHUNKS = 500_000

_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def by_bytes(texts, most: int = BATCH_BYTES):
    """Lists of texts of about ``most`` bytes each; a longer text stands alone."""
    batch, size = [], 0
    for t in texts:
        n = len(t) if t.isascii() else len(t.encode())
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += n
    if batch:
        yield batch


class WordCounter:
    """Counts of a vocabulary file of the tokenizers library that drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # White space is a safe boundary only if the vocabulary drops it.
        self.safe = all(not self.tokenizer.encode(s, add_special_tokens=False).ids for s in (" ", "\n", "\t "))
        self.known: dict[str, int] = {}

    def learn(self, new: list[str]) -> None:
        for batch in by_bytes(new):
            self.known.update(zip(batch, map(len, self.tokenizer.encode_batch(batch, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(e) for batch in by_bytes(texts) for e in self.tokenizer.encode_batch(batch, add_special_tokens=False)]
        split = [[c for c in _SPACE.split(t) if c] if _NOT_SPACE.search(t) else t.split() for t in texts]
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        self.learn(list(set().union(*split).difference(self.known)))
        return [sum(map(self.known.__getitem__, chunks)) for chunks in split]


class PieceCounter:
    """Counts of a sentencepiece model, of whole texts: its pieces take white space along."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for batch in by_bytes(texts) for ids in self.model.encode(batch, num_threads=1)]


@lru_cache(2)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else WordCounter(path)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``docs`` with a long column ``name``: the tokens of each whole text, 0 for a null or empty one.

    Rows are independent: ties, repeated rows, nulls and extra columns stay as they are; a column of
    that name is replaced.
    """
    where = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        found = (counter(where).count([t or "" for t in part.to_pylist()]) for part in sliced([texts]))
        return pa.array([n for part in found for n in part], pa.int64())

    return docs.withColumn(name, lengths(F.col(text)))


def query(spark, sf_dir):
    """Per document its bytes, its tokens, and whether they are more than the limit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
