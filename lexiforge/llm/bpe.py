"""Operator 4: byte-pair encoding and decoding with a public word-end vocabulary.

Merges run by the lowest rank first: a heap of (rank, position) over a doubly linked list of
symbols. A heap entry whose symbols have changed since it was pushed is stale and is skipped.
White space always separates symbols in this vocabulary, so a text is coded chunk by chunk and a
chunk's code is kept for its next occurrence.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

VOCABULARY = "word_bpe_49k.json"
#: Chunks whose codes a Python worker keeps; when full, they are kept aside and those that come again are taken over.
CACHED_CHUNKS = 75_000
#: The same for pre-tokens: a chunk in lower case without its punctuation.
CACHED_WORDS = 75_000

#: Python's split() also cuts at these four, which the vocabulary's white space doesn't include.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes texts with a vocabulary file of the tokenizers library (BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.vocab, **self.special}.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: (left id, right id) as one number -> (rank, merged id) as one number.
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: k << 32 | self.vocab[a + b] for k, (a, b) in enumerate(pairs)}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        shown = byte_alphabet()
        self.inner, self.last = [self.vocab[c] for c in shown], [self.vocab[c + self.end] for c in shown]
        self.words: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.old_words: dict[str, tuple[bytes, str]] = {}
        self.old_chunks: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw, merges = word.encode(), self.merges
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        #: For each symbol still in the list, rank and result of merging it with the next, or None.
        now = [merges.get(a << 32 | b) for a, b in zip(ids, ids[1:])]
        now.append(None)
        heap = [(m, i) for i, m in enumerate(now) if m is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            if now[i] != m:
                continue  # stale: one of the two has been merged since
            j = right[i]
            ids[i] = new = m & 0xFFFFFFFF
            now[j], now[i] = None, None
            ids[j] = -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (m := merges.get(new << 32 | ids[k])) is not None:
                    now[i] = m
                    heapq.heappush(heap, (m, i))
            if (h := left[i]) >= 0:
                now[h] = m = merges.get(ids[h] << 32 | new)
                if m is not None:
                    heapq.heappush(heap, (m, h))
        return [x for x in ids if x >= 0]

    def coded(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def word(self, piece: str) -> tuple[bytes, str]:
        """Packed ids and the decoded text of one pre-token."""
        if (got := self.words.get(piece)) is None:
            if len(self.words) >= CACHED_WORDS:
                self.words, self.old_words = {}, self.words
            got = self.old_words.get(piece) or self.coded(self.merge(piece))
            if len(piece) <= 64:
                self.words[piece] = got
        return got

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """Packed ids and the decoded text of a text without white space."""
        if chunk.isascii():
            plain = chunk.lower()
            if plain.isalpha():
                return self.word(plain)
        if "<|" in chunk and self.cut:
            parts = [self.coded([self.special[p]]) if p in self.special else self.chunk(p) for p in self.cut.split(chunk) if p] if self.cut.search(chunk) else None
        else:
            parts = None
        if parts is None:
            # Case is folded character by character: a final sigma is no special case.
            plain = unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3").lower()
            parts = list(map(self.word, self.pieces.findall(plain)))
        return parts[0] if len(parts) == 1 else (b"".join([p for p, _ in parts]), " ".join([d for p, d in parts if p]))

    def decode(self, ids) -> str:
        """Vocabulary strings in a row; this vocabulary has no decoder, so that a blank stands between them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        chunks = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        known, found = self.chunks, []
        for c in chunks:
            if c:
                if (got := known.get(c)) is None:
                    if len(known) >= CACHED_CHUNKS:
                        self.chunks, self.old_chunks = {}, known
                        known = self.chunks
                    got = self.old_chunks.get(c) or self.chunk(c)
                    if len(c) <= 64:
                        known[c] = got
                found.append(got)
        return b"".join([p for p, _ in found]), " ".join([d for p, d in found if p])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``docs``, then the ids of each whole text (packed little-endian uint32) and their decoded text.

    A null or empty text has no ids and decodes to the empty text. Rows are independent: ties, repeated
    rows and nulls in other columns are kept as they are. Columns of ``docs`` that have one of the two
    new names are replaced.
    """
    where = path or public_tokenizers.path(VOCABULARY)
    kept = docs.drop(ids, decoded)
    at = kept.columns.index(text)
    schema = kept.limit(0).withColumn(ids, F.lit(b"")).withColumn(decoded, F.lit("")).schema

    def run(batches):
        coder = codec(where)
        for batch in sliced(batches):
            pairs = [coder.encode(t or "") for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([p for p, _ in pairs], pa.binary()), pa.array([d for _, d in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def query(spark, sf_dir):
    """Per document the number and digest of its ids, and the digest of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
