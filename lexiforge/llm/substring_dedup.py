"""Operator 8: repeated passages by content-defined chunking.

A gear hash rolls over a text's bytes; a chunk ends after white space where the hash of the last 16 bytes
says so (every fifth such place on average), or, where those 16 bytes hold no white space, at every
sixteenth character or so. The ends depend on those bytes alone, so that an insertion moves no other chunk.
Chunks are compared by digest over all documents; the second, third, ... time that a document has a chunk
counts as a chunk of its own, so that passages that repeat a line find their like.

The partner of a chunk is the document with the smallest id that has it, and the chunk's place there. A
run of adjacent chunks of which the partners are adjacent chunks of one earlier document is a repeated
passage if it has MIN_BYTES or more: that document has the same bytes in one piece and keeps them, as their
partner is it itself. Whole chunks count, so that at either end of a passage the part of a chunk that
reaches beyond it, some five words on average, isn't found.

Digests that come often are dealt out by a salt, and their partners to each of these parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAP_BITS, bit_map, checkpoint, is_set, may_have, sliced

WINDOW = 16
#: Of 256 hash values, so many end a chunk after white space, and where there is no white space.
ENDS, INNER = 51, 16
MIN_BYTES = 80
#: A digest that makes a larger share than 1/HOT of all chunks is dealt out in SALTS parts: fewer than HOT digests.
HOT, SALTS = 10_000, 64
#: A number for each byte value.
GEAR = np.random.default_rng(8).integers(0, 1 << 16, 256).astype(np.uint16)


def blanks(data: np.ndarray) -> np.ndarray:
    """Where a white-space character ends: ASCII, U+00A0, U+2000 to U+200A, U+3000."""
    blank = data <= 0x20
    if len(data) > 2:
        blank[1:] |= (data[:-1] == 0xC2) & (data[1:] == 0xA0)
        first, last = data[:-2], data[2:]
        blank[2:] |= (data[1:-1] == 0x80) & ((first == 0xE2) & (last >= 0x80) & (last <= 0x8A) | (first == 0xE3) & (last == 0x80))
    return blank


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted ends of the chunks of texts that lie one behind the other; every text's end is one."""
    h = GEAR[data]
    for s in (1, 2, 4, 8):  # the gear hash of 2s bytes from that of s bytes
        h = np.concatenate([h[:s], h[s:] + (h[:-s] << np.uint16(s))])
    h >>= np.uint16(8)
    blank = blanks(data)
    ends = blank & (h < ENDS)
    if len(data) > WINDOW:
        so_far = np.cumsum(blank, dtype=np.int32)
        none = so_far[WINDOW - 1 : -1] - np.r_[np.int32(0), so_far[: -WINDOW - 1]] == 0
        ends[WINDOW - 1 : -1] |= none & ((data[WINDOW:] & 0xC0) != 0x80) & (h[WINDOW - 1 : -1] < INNER)
    place = np.flatnonzero(ends) + 1
    # the window must lie within the text
    start = offsets[np.searchsorted(offsets, place, "left") - 1]
    return np.union1d(place[place - start >= WINDOW], offsets[1:][np.diff(offsets) > 0])


def digests_of(data: bytes, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A digest of each chunk and of how often its document has had it before."""
    begins = [0, *ends[:-1].tolist()]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    found = np.fromiter((digest(view[a:b]) for a, b in zip(begins, ends.tolist(), strict=True)), np.uint64, len(ends))
    order = np.lexsort((found, doc))
    new = np.ones(len(order), bool)
    new[1:] = (found[order][1:] != found[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.arange(len(order))
    before = np.empty(len(order), np.uint64)
    before[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return found + before * np.uint64(0x9E3779B97F4A7C15)


def chunks(docs: DataFrame, among=None) -> DataFrame:
    """(key, version, start, end, digest) of the chunks of ``docs`` (key, version, text), in bytes of the text.

    ``among``: a bit map of digests that leaves out chunks without one of them.
    """

    def run(batches):
        for batch in sliced(batches):
            raw = [t.encode() if t else b"" for t in batch.column(2).to_pylist()]
            data = b"".join(raw)
            if not data:
                continue
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
            ends = chunk_ends(np.frombuffer(data, np.uint8), offsets)
            doc = np.searchsorted(offsets, ends, "left") - 1
            begins, digests = np.r_[0, ends[:-1]], digests_of(data, ends, doc)
            if among is not None:
                kept = is_set(among.value, (digests & np.uint64(MAP_BITS - 1)).astype(np.int64))
                ends, doc, begins, digests = (x[kept] for x in (ends, doc, begins, digests))
            base, at = offsets[doc], pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)), pa.array(digests.view(np.int64))],
                names=["key", "version", "start", "end", "digest"],
            )

    return docs.mapInArrow(run, "key long, version long, start int, end int, digest long")


def runs(key, version, start, end, first, first_version, first_start, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of each passage, of chunks in order of document and place."""
    later = first < key
    on = np.zeros(len(key), bool)
    on[1:] = later[1:] & later[:-1] & (start[1:] == end[:-1]) & (first_start[1:] - first_start[:-1] == start[1:] - start[:-1])
    for c in (key, version, first, first_version):
        on[1:] &= c[1:] == c[:-1]
    begins = np.flatnonzero(later & ~on)
    stops = np.flatnonzero(later & ~np.r_[on[1:], False])
    long = end[stops] - start[begins] >= min_bytes
    return begins[long], stops[long]


def later_passages(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(key, version, start, end, first, first_version, first_start): passages that an earlier document, ``first``, has as well."""
    found = chunks(docs)
    place = F.struct(F.col("key"), F.col("version"), F.col("start"))
    shared = found.groupBy("digest").agg(F.min(place).alias("at"), F.max("key").alias("last"), F.count("*").alias("n")).filter("at.key < last")
    shared = checkpoint(shared.select("digest", F.col("at.key").alias("first"), F.col("at.version").alias("first_version"), F.col("at.start").alias("first_start"), "n"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > max(SALTS, total / HOT)
    parts = shared.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    # fewer than HOT digests
    hot = F.broadcast(shared.filter(is_hot).select("digest", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "version"), F.lit(SALTS)).cast("int")).otherwise(0)
    repeated = chunks(docs, bit_map(shared.select(F.col("digest").bitwiseAND(MAP_BITS - 1).alias("spot")))).join(hot, "digest", "left").withColumn("salt", salt).drop("hot").join(parts, ["digest", "salt"])
    names = ["key", "version", "start", "end", "first", "first_version", "first_start"]

    def run(batches):
        held: list[list[np.ndarray]] = []

        def rows():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.ones(len(columns[0]), bool)  # repeated rows count once
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], 0)
            columns = [c[new] for c in columns]
            a, b = runs(*columns, min_bytes)
            out = [c[a] for c in columns]
            out[3] = columns[3][b]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(7)]
            if not len(columns[0]):
                continue
            other = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = other[-1] + 1 if len(other) else 0  # the last document may go on in the next batch
            goes_on = held and (held[-1][0][-1], held[-1][1][-1]) == (columns[0][0], columns[1][0])
            if cut or not goes_on:
                if cut:
                    held.append([c[:cut] for c in columns])
                if held:
                    yield rows()
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield rows()

    in_order = repeated.select(*names).repartition("key", "version").sortWithinPartitions("key", "version", "start")
    return in_order.mapInArrow(run, "key long, version long, start int, end int, first long, first_version long, first_start int")


def passages(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(key, version, start, end, kept, first): the repeated passages of ``docs`` (key, version, text), in bytes.

    Not kept: each passage that an earlier document, ``first``, has as well. Kept: its like there, where
    those that touch come as one; ``first`` is the document itself.
    """
    later = checkpoint(later_passages(docs, min_bytes))
    likes = later.select(F.col("first").alias("key"), F.col("first_version").alias("version"), F.col("first_start").alias("start"), (F.col("first_start") + F.col("end") - F.col("start")).alias("end")).distinct()
    w = Window.partitionBy("key", "version").orderBy("start", "end")
    apart = F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = likes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = islands.groupBy("key", "version", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return later.select("key", "version", "start", "end", F.lit(False).alias("kept"), "first").unionByName(kept.select("key", "version", "start", "end", F.lit(True).alias("kept"), F.col("key").alias("first")))


def version_of(text: Column) -> Column:
    """60 bits of a text's MD5, 0 for null: tells several texts of one id apart."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("key"), version_of(F.col(text)).alias("version"), F.col(text).alias("text")).filter("key IS NOT NULL")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs``, all rows and columns, with repeated passages cut out of the texts but for their first document.

    What rows of one id share is no repeat; several texts of one id are looked at each by itself, and
    repeated rows are cut alike. Rows with a null id or text stay as they are, as do texts without repeats;
    a text that is a repeat as a whole becomes an empty one. Extra columns stay whatever their names. An
    empty table gives an empty one.
    """
    rows = keyed(docs, doc_id, text)
    spans = (
        later_passages(rows, min_bytes)
        .groupBy(F.col("key").alias("__key"), F.col("version").alias("__version"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    )

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if t is not None and cuts:
                raw, at, kept = t.encode(), 0, []
                for c in cuts:
                    kept.append(raw[at : c["start"]])
                    at = c["end"]
                t = b"".join([*kept, raw[at:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    names = docs.columns
    spans = checkpoint(spans)
    may_cut = F.coalesce(F.col(doc_id).isNotNull() & may_have(spans.select(F.col("__key").alias("key")), F.col(doc_id)), F.lit(False))
    same = (F.col(doc_id).cast("long") == F.col("__key")) & (version_of(F.col(text)) == F.col("__version"))
    joined = docs.filter(may_cut).join(spans, same, "left")
    done = joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(cut(F.col(text), F.col("__spans")))).select(*names)
    return docs.filter(~may_cut).unionByName(done)


def query(spark, sf_dir):
    """The repeated passages of all documents: where they lie, whether the document keeps them, and the first that has them.

    Null ids and texts have no passage; rows of one id share none with each other; repeated rows come once.
    ``version`` (``version_of`` the text) tells several texts of one id apart. An empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = passages(keyed(docs, "doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "kept", F.col("first").alias("first_doc_id"), "version")
