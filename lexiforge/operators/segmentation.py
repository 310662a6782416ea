"""Texts cut into windows, paragraphs and budgeted chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def word_windows(docs: DataFrame, doc_id: str = "doc_id", body: str = "text", words: int = 360) -> DataFrame:
    """(doc_id, chunk_index, n_words, content): consecutive windows of so many words; none for a text without words."""
    split = F.filter(F.split(F.col(body), text.SPACE), lambda w: w != "")
    windows = docs.select(doc_id, split.alias("w")).filter(F.size("w") > 0)
    starts = windows.select(doc_id, "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(words))).alias("chunk_index", "start"))
    content = F.slice("w", F.col("start") + 1, F.lit(words))
    return starts.select(doc_id, "chunk_index", F.size(content).alias("n_words"), F.array_join(content, " ").alias("content"))


def lines(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, line_no, line): non-blank lines in order."""
    return docs.select(doc_id, F.posexplode(F.split(F.col(body), "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
