"""Operator 5: components of documents whose word n-gram sets have a Jaccard similarity of a given percentage.

One pass over the texts makes each document's shingle set and its segment signatures (``jaccard_core``), which
travel packed: a row holds thousands of signatures of one part of their range, and a shuffle brings the rows of a
part together. Of the documents with a signature the one with the smallest id is the centre, and all of them join
the centre's group, once however many signatures they share with it; two documents with a common signature thus
meet in a group. There the counts of their sets' elements in 256 cells tell which may reach the similarity at all,
and only those documents' texts are read again. A group is split into blocks of bounded size, each with the centre,
in which sets are compared exactly; documents that this doesn't link with the group's main component then meet the
group's other blocks in tiles of bounded size, again by the cells first. Pairs are not emitted, only a spanning tree
of the links that are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_core as core
from .common import by_bytes, by_group, checkpoint, may_have, sliced
from .components import components

WORDS, PERCENT = 4, 85
#: Documents of a group that are compared in one task.
BLOCK = 300
#: Sets that a task remembers, to tell copies without a signature for each.
KEPT = 200_000
#: Bytes of texts that are split at once, and signatures that are packed at once.
SPLIT, PACKED = 1 << 20, 1 << 20
#: Bytes and rows of texts whose signatures meet in one part.
PART_BYTES, PART_ROWS = 8 << 20, 40_000
SIGNATURE, FIRST, COPY = 0, 1, 2


def split(batches):
    """(key, text) in pieces of about SPLIT bytes, as lists."""
    for batch in sliced(batches):
        for start, end in by_bytes(batch.column(1), SPLIT):
            yield batch.column(0).slice(start, end - start).to_pylist(), batch.column(1).slice(start, end - start).to_pylist()


def binaries(x: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes of runs of ``x``."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]) * (x.itemsize * int(np.prod(x.shape[1:])))
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def packed(kind: int, parts: int, buckets: np.ndarray, keys: np.ndarray, extras: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """A row for each part of the buckets' range that has any."""
    part = ((buckets >> core.U64(32)) * core.U64(parts) >> core.U64(32)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    there, counts = np.unique(part[order], return_counts=True)
    columns = [binaries(x[order], counts) if len(x) else pa.nulls(len(there), pa.binary()) for x in (buckets, keys, extras, cells)]
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(np.full(len(there), kind, np.int8)), *columns], names=["part", "kind", "buckets", "keys", "extras", "cells"])


def signature_rows(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """(part, kind, buckets, keys, extras, cells), packed: signatures; sets (bucket: the set's number, extra: its size); copies of a set that its task has seen (extra: that key)."""
    none = np.zeros(0, np.int64)

    def run(batches):
        seen, held, total = {}, [], 0
        for keys, texts in split(batches):
            s, sizes = core.shingles(texts, words)
            keys = np.array(keys, np.int64)
            of_key = core.mixed(keys.view(core.U64))
            numbers = np.where(sizes > 0, core.set_ids(s, sizes), of_key)
            copied, new = [], np.ones(len(keys), bool)
            for k in np.flatnonzero(sizes).tolist():
                number, key = int(numbers[k]), int(keys[k])
                if (first := seen.get(number)) is not None:
                    copied.append((k, first))
                    new[k] = False
                else:
                    if len(seen) > KEPT:
                        seen.clear()
                    seen[number] = key
            if copied:
                at = np.array([k for k, _ in copied])
                yield packed(COPY, parts, of_key[at], keys[at], np.array([x for _, x in copied], np.int64), none)
            s, sizes, keys, numbers = s[np.repeat(new, sizes)], sizes[new], keys[new], numbers[new]
            if len(keys):
                yield packed(FIRST, parts, numbers, keys, sizes, core.cell_counts(s, sizes))
            for number, of in core.signatures(s, sizes, percent):
                held.append((number, keys[of]))
                total += len(of)
                if total >= PACKED:
                    yield packed(SIGNATURE, parts, *map(np.concatenate, zip(*held, strict=True)), none, none)
                    held, total = [], 0
        if held:
            yield packed(SIGNATURE, parts, *map(np.concatenate, zip(*held, strict=True)), none, none)

    return docs.mapInArrow(run, "part int, kind byte, buckets binary, keys binary, extras binary, cells binary")


def unpacked(table: pa.Table, kind: int, name: str, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).filter(pc.equal(table.column("kind"), kind)).to_pylist()), dtype)


def shared(buckets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries whose bucket others have too: bucket, key, and the bucket's least key."""
    order = np.argsort(buckets)
    buckets = buckets[order]
    same = buckets[1:] == buckets[:-1]
    several = np.zeros(len(buckets), bool)
    several[1:] = same
    several[:-1] |= same
    buckets, keys = buckets[several], keys[order[several]]
    if not len(keys):
        return buckets, keys, keys
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return buckets, keys, np.repeat(np.minimum.reduceat(keys, starts), np.diff(np.append(starts, len(keys))))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def gathered(rows: DataFrame) -> DataFrame:
    """(kind, key, other, size, cells) of each part: members of a centre's group and the centre itself, once; sets with the least key of equal ones; copies."""

    def run(table: pa.Table) -> pa.Table:
        _, members, centres = shared(unpacked(table, SIGNATURE, "buckets", core.U64), unpacked(table, SIGNATURE, "keys"))
        others = members != centres
        centres, members = distinct_pairs(np.concatenate([centres[others], centres[others]]), np.concatenate([members[others], centres[others]]))
        numbers, keys, sizes = unpacked(table, FIRST, "buckets", core.U64), unpacked(table, FIRST, "keys"), unpacked(table, FIRST, "extras")
        _, at, least = np.unique(numbers, return_index=True, return_inverse=True)
        first = keys[at]
        np.minimum.at(first, least, keys)
        counts = unpacked(table, FIRST, "cells", np.uint8).reshape(-1, core.CELLS)
        copies, copied = unpacked(table, COPY, "keys"), unpacked(table, COPY, "extras")
        kinds = np.repeat(np.array([SIGNATURE, FIRST, COPY], np.int8), [len(members), len(keys), len(copies)])
        size = np.zeros(len(kinds), np.int64)
        size[kinds == FIRST] = sizes
        cells = pa.concat_arrays([pa.nulls(len(members), pa.binary()), binaries(counts, np.ones(len(counts), np.int64)), pa.nulls(len(copies), pa.binary())])
        return pa.table({"kind": kinds, "key": np.concatenate([members, keys, copies]), "other": np.concatenate([centres, first[least], copied]), "size": size, "cells": cells})

    return rows.groupBy("part").applyInArrow(run, "kind byte, key long, other long, size long, cells binary")


def cells_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, core.CELLS)


def possible(groups: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """The rows of ``groups`` (centre, block, key) that may have a link within the block, by the cells of ``counted`` (key, size, cells)."""

    def run(table: pa.Table) -> pa.Table:
        return table.select(["centre", "block", "key"]).filter(pa.array(core.plausible(table.column("size").to_numpy(), cells_of(table), percent)))

    return by_group(groups.select("centre", "block", "key").join(counted, "key").select("centre", "block", "key", "size", "cells"), ["centre", "block"], run, "centre long, block long, key long").distinct()


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` (key, text) whose key is in ``keys``."""
    return docs.filter(may_have(keys, F.col("key"))).join(keys.select("key").distinct(), "key", "left_semi")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(key, set): the sorted shingle hashes, 64 bits each."""

    def run(batches):
        for keys, some in split(batches):
            s, counts = core.shingles(some, words)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), binaries(s, counts)], names=["key", "set"])

    return texts.select("key", "text").mapInArrow(run, "key long, set binary")


def compared(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the components within each (centre, block) of ``members`` (…, key, set, component, probe).

    With probes in a block, pairs without a probe are not looked at.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("probe", "descending"), ("key", "ascending")])
        keys, apart = table.column("key").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(b.as_buffer(), core.U64) for b in table.column("set").combine_chunks()]
        probes = int(np.sum(table.column("probe").to_numpy()))
        root = core.linked(sets, percent, apart, probes or None)
        linked = root != np.arange(len(root))
        return pa.table({"a": keys[linked], "b": keys[root[linked]]})

    return by_group(members.select("centre", "block", "key", "set", "component", "probe"), ["centre", "block"], run, "a long, b long").filter("a <> b")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, n_shingles, component_id): the smallest id reachable by links.

    Words are lower-cased (A-Z) and cut at ASCII white space. A row without words or text has no shingles
    and no links. Rows with one id count as one document for links. A null id has no component. Equal sets
    are linked. An empty table gives an empty one; extra columns are dropped.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"))
    keyed = named.filter("key IS NOT NULL")
    many = keyed.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(many.bytes // PART_BYTES, many.rows // PART_ROWS, docs.sparkSession.sparkContext.defaultParallelism)
    found = checkpoint(gathered(signature_rows(keyed, words, percent, parts)))
    equal = found.filter(F.col("kind").isin(FIRST, COPY)).select(F.col("key").alias("a"), F.col("other").alias("b")).filter("a <> b")
    counted = found.filter(F.col("kind") == FIRST).select("key", "size", "cells")
    sizes = counted.select("key", "size")
    sizes = sizes.unionByName(found.filter(F.col("kind") == COPY).select("key", F.col("other").alias("at")).join(sizes.withColumnRenamed("key", "at").distinct(), "at").select("key", "size"))

    groups = found.filter(F.col("kind") == SIGNATURE).select(F.col("other").alias("centre"), "key").distinct()
    blocks = groups.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    groups = checkpoint(groups.join(blocks, "centre").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))))
    wide = groups.filter("blocks > 1")
    is_wide = not wide.isEmpty()
    if is_wide:
        centres = wide.select("centre", "blocks").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("key", F.col("centre"))
        groups = groups.unionByName(centres).distinct()
    near = checkpoint(possible(groups, counted, percent))
    members = near.join(sets_of(texts_of(keyed, near), words), "key").withColumn("component", F.col("key")).withColumn("probe", F.lit(0))
    links = checkpoint(compared(members, percent).unionByName(equal))
    labels = components(links)
    if is_wide:
        tiles = checkpoint(across_blocks(wide, counted, labels, percent))
        links = links.unionByName(compared(tiles.join(sets_of(texts_of(keyed, tiles), words), "key"), percent))
        labels = components(links)
    with_labels = sizes.join(labels.withColumnRenamed("id", "key"), "key", "left")
    result = with_labels.select(F.col("key").alias(doc_id), F.col("size").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
    return result.unionByName(without_id(named, words).select(F.col("key").alias(doc_id), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def across_blocks(wide: DataFrame, counted: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(centre, block, key, component, probe): what may still link between blocks of a group, in tiles (``block``).

    Documents outside a group's largest component so far, in lots of bounded size, meet each other block of it.
    """
    known = wide.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    shares = known.groupBy("centre", "component").count()
    main = shares.groupBy("centre").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    rest = checkpoint(known.join(main, "centre").filter("component <> main").drop("main"))
    lots = rest.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("lots"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # dealt by key, as a group's rows are many times as many in its tiles; lots are mixed anew: keys of one block lie in all of them
    probes = rest.join(lots, "centre").repartition("key").withColumn("lot", F.pmod(F.xxhash64("key", F.lit(1)), F.col("lots"))).withColumn("to", each("blocks")).filter("to <> block").withColumn("block", F.col("to")).withColumn("probe", F.lit(1))
    targets = known.join(lots, "centre").repartition("key").withColumn("lot", each("lots")).withColumn("probe", F.lit(0))
    columns = ["centre", (F.col("lot") * F.col("blocks") + F.col("block")).alias("block"), "key", "component", "probe"]
    met = probes.select(*columns).unionByName(targets.select(*columns)).join(counted, "key")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("probe", "descending")])
        probes = int(np.sum(table.column("probe").to_numpy()))
        near = core.plausible(table.column("size").to_numpy(), cells_of(table), percent, table.column("component").to_numpy(), probes)
        return table.select(["centre", "block", "key", "component", "probe"]).filter(pa.array(near))

    return by_group(met.select("centre", "block", "key", "component", "probe", "size", "cells"), ["centre", "block"], run, "centre long, block long, key long, component long, probe int").distinct()


def without_id(named: DataFrame, words: int) -> DataFrame:
    """(key, n_shingles) of rows without an id."""

    def run(batches):
        for keys, texts in split(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(core.shingles(texts, words)[1])], names=["key", "n_shingles"])

    return named.filter("key IS NULL").mapInArrow(run, "key long, n_shingles long")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the row with the smallest id, and of repeated rows of an id one.

    Rows without words have no links and all stay, as do rows with a null id.
    """
    found = checkpoint(join(docs, doc_id, text, words, percent).filter(F.col(doc_id).isNotNull()))
    gone = found.filter(F.col("component_id") < F.col(doc_id)).select(F.col(doc_id).cast("long").alias("key")).distinct()
    again = found.groupBy(F.col(doc_id).cast("long").alias("key")).count().filter("count > 1").select("key")
    touched = checkpoint(gone.unionByName(again).distinct())
    may_go = F.coalesce(F.col(doc_id).isNotNull() & may_have(touched, F.col(doc_id)), F.lit(False))
    rest = docs.filter(may_go)
    left = rest.join(gone.withColumnRenamed("key", "__key"), F.col(doc_id).cast("long") == F.col("__key"), "left_anti").dropDuplicates([doc_id])
    return docs.filter(~may_go).unionByName(left)


def query(spark, sf_dir):
    """Every document's shingles and the component that its links reach."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
