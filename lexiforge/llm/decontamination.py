"""Operator 6: benchmark decontamination by SimHash windows, with DataFrame functions only.

Benchmark items and documents are read as bags of five-word shingles. A document's windows of an item's
size are fingerprinted by SimHash (64 bits, a shingle weighs as often as it comes); fingerprints are cut
into blocks, one more than the radius, so that any two within the radius agree in a block, and windows
meet the items of their size by (block, value). Candidates within the radius are verified exactly by the
weighted Jaccard similarity of their bags.

Which item a window may hold is found by fingerprints alone. Which windows are fingerprinted at all is
bounded by an exact filter that knows no item: a window that reaches the similarity with some item of its
size has at least that share of shingles that items of that size have, so that others are passed over
without loss. The votes of a fingerprint are differences of running sums along the document, so that a
window costs the same whatever its size.

Bags of the least similarity differ in about 10 of 64 bits, with a standard deviation of 2.9; the radius
stands 4.8 deviations above. For so wide a radius blocks are two or three bits, and it is the window's size
and the filter that keep candidates few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints at most so many bits apart are candidates.
RADIUS = 23
BITS = 64
#: What items make (shingles, or blocks of fingerprints) is broadcast if it has no more rows; else it is shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words in lower case, cut at everything but letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def beside(w: Column) -> Column:
    """An array of words as an array of structs (w0, w1, ...): each word and those after it, null beyond the end."""
    return F.arrays_zip(w.alias("w0"), *[F.slice(w, k + 1, F.size(w)).alias(f"w{k}") for k in range(1, WORDS)])


def shingles(w: Column) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    whole = F.slice(beside(w), 1, F.greatest(F.size(w) - (WORDS - 1), F.lit(0)))
    return F.transform(whole, lambda s: F.xxhash64(*[s[f"w{k}"] for k in range(WORDS)]))


def lanes(h: Column) -> list[Column]:
    """The bits of a hash, two to a number, 32 bits apart: sums of such numbers count both."""
    bit = lambda b: F.getbit(h, F.lit(b)).cast("long")
    return [bit(b) + F.shiftleft(bit(b + 1), 32) for b in range(0, BITS, 2)]


def fingerprint(votes: list[Column], size: Column) -> Column:
    """SimHash from sums of ``lanes``: a bit is set where more than half of so many hashes have it."""
    bits = []
    for k, v in enumerate(votes):
        for b, n in ((2 * k, v.bitwiseAND(0xFFFFFFFF)), (2 * k + 1, F.shiftrightunsigned(v, 32))):
            bits.append(F.when(2 * n > size, F.lit((1 << b) - (1 << BITS if b == BITS - 1 else 0))).otherwise(F.lit(0)).cast("long"))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def cuts() -> list[tuple[int, int]]:
    """First bit and number of bits of each block."""
    at = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def block_of(print_: Column, k: int) -> Column:
    a, n = cuts()[k]
    return F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << n) - 1))


def blocks(print_: Column) -> Column:
    """(block, value) of a fingerprint's RADIUS + 1 blocks."""
    return F.array(*[F.struct(F.lit(k).alias("block"), block_of(print_, k).alias("value")) for k in range(RADIUS + 1)])


def shared(own: Column, bag: Column, repeated: Column) -> Column:
    """Size of the intersection of two bags; ``repeated``: (h, n) of the elements that ``bag`` has more than once."""
    times = lambda h: F.size(F.filter(own, lambda x: x == h))
    more = F.aggregate(repeated, F.lit(0), lambda s, r: s + F.greatest(F.least(times(r["h"]), r["n"]) - 1, F.lit(0)))
    return F.size(F.array_intersect(own, bag)) + more


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(key, item, bag, repeated, length, print): items of at least five words, one row for each text."""
    bags = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), shingles(words(F.col(text))).alias("bag")).distinct()
    bags = bags.filter(F.size("bag") > 0).withColumn("key", F.xxhash64("item", "bag")).withColumn("length", F.size("bag"))
    each = bags.select("key", F.explode("bag").alias("h"))
    votes = each.groupBy("key").agg(*[F.sum(v).alias(f"v{k}") for k, v in enumerate(lanes(F.col("h")))])
    many = each.groupBy("key", "h").agg(F.count("*").cast("int").alias("n")).filter("n > 1").groupBy("key").agg(F.collect_list(F.struct("h", "n")).alias("repeated"))
    named = [F.col(f"v{k}") for k in range(BITS // 2)]
    rows = bags.join(votes, "key").join(many, "key", "left")
    none = F.array().cast("array<struct<h:bigint,n:int>>")
    return rows.select("key", "item", "bag", F.coalesce("repeated", none).alias("repeated"), "length", fingerprint(named, F.col("length")).alias("print"))


def hits_of(docs: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """(doc, version, pos, hash): the shingles of ``docs`` (doc, version, words) that are in ``known`` (hash)."""
    rows = docs.select("doc", "version", F.posexplode(beside(F.col("words"))).alias("pos", "s")).filter(F.col(f"s.w{WORDS - 1}").isNotNull())
    hashed = rows.select("doc", "version", "pos", F.xxhash64(*[F.col(f"s.w{k}") for k in range(WORDS)]).alias("hash"))
    return hashed.join(F.broadcast(known) if small else known, "hash", "left_semi")


def windows_of(hits: DataFrame, of_lengths: DataFrame, similarity: float) -> DataFrame:
    """(doc, version, length, start): the windows with enough shingles of items of their size (``of_lengths``: length, hash)."""
    need = F.ceil(F.col("length") * similarity).cast("int")
    places = hits.join(of_lengths, "hash").groupBy("doc", "version", "length").agg(F.sort_array(F.collect_set("pos")).alias("at")).filter(F.size("at") >= need)
    # A window whose first such shingle is at[i] and which holds enough starts at at[i] or up to ``slack`` before
    last = F.col("length") - 1
    first = F.transform(
        "at",
        lambda p, i: F.struct(
            p.alias("p"),
            F.when(i + need <= F.size("at"), p + last - F.element_at("at", (i + need).cast("int"))).otherwise(-1).alias("slack"),
            F.when(i > 0, p - F.element_at("at", F.greatest(i, F.lit(1)).cast("int")) - 1).otherwise(p).alias("gap"),
        ),
    )
    return (
        places.select("doc", "version", "length", F.explode(F.filter(first, lambda x: x["slack"] >= 0)).alias("x"))
        .select("doc", "version", "length", F.explode(F.sequence(F.col("x.p") - F.least("x.slack", "x.gap"), F.col("x.p"))).alias("start"))
        .distinct()
    )


def prints_of(bags: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, version, length, start, size, own_print) of ``windows`` on ``bags`` (doc, version, all).

    Marks at a window's ends take part in the running sums of its document's shingles.
    """
    nothing = F.lit(None).cast("int")
    rows = bags.select("doc", "version", F.posexplode("all").alias("pos", "h")).select("doc", "version", "pos", F.lit(1).alias("mark"), "h", nothing.alias("length"), nothing.alias("start"), F.lit(0).alias("sign"))
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(-1).alias("sign")), F.struct((F.col("start") + F.col("length")).alias("pos"), F.lit(1).alias("sign")))).alias("e")
    marks = windows.select("doc", "version", "length", "start", ends).select("doc", "version", "e.pos", F.lit(0).alias("mark"), F.lit(0).cast("long").alias("h"), "length", "start", "e.sign")
    so_far = Window.partitionBy("doc", "version").orderBy("pos", "mark").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.unionByName(marks).select("doc", "version", "mark", "length", "start", "sign", F.sum("mark").over(so_far).alias("n"), *[F.sum(v).over(so_far).alias(f"v{k}") for k, v in enumerate(lanes(F.col("h")))])
    names = [f"v{k}" for k in range(BITS // 2)]
    votes = summed.filter("mark = 0").groupBy("doc", "version", "length", "start").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("n", *names)])
    return votes.filter("n > 0").select("doc", "version", "length", "start", F.col("n").cast("int").alias("size"), fingerprint([F.col(c) for c in names], F.col("n")).alias("own_print"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): each document's best window for each item it contains.

    Null ids take no part; null and empty texts contain nothing; items of fewer than five words aren't
    looked for. Rows with one id count as one document, each of its texts looked at by itself; of several
    texts of an item the nearest counts. Ties go to the earlier window. An empty table on either side gives
    an empty one; extra columns are dropped. What the radius may lose is one window in a million at the
    least similarity, and less above it.
    """
    items = checkpoint(items_of(benchmark, item_id, item_text))
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    small, few = n_shingles <= BROADCAST_ROWS, n_items * (RADIUS + 1) <= BROADCAST_ROWS
    send = lambda df, if_: F.broadcast(df) if if_ else df
    texts = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    of_lengths = items.select("length", F.explode("bag").alias("hash")).distinct()
    hits = hits_of(texts.select("doc", "version", words(F.col("text")).alias("words")), of_lengths.select("hash").distinct(), small)
    windows = checkpoint(windows_of(hits, send(of_lengths, small), similarity))

    whole = texts.join(windows.select("doc", "version").distinct(), ["doc", "version"], "left_semi").dropDuplicates(["doc", "version"])
    bags = checkpoint(whole.select("doc", "version", shingles(words(F.col("text"))).alias("all")))
    prints = checkpoint(prints_of(bags, windows))
    by_block = prints.withColumn("b", F.explode(blocks(F.col("own_print")))).select("*", "b.block", "b.value").drop("b")
    index = items.withColumn("b", F.explode(blocks(F.col("print")))).select("key", "print", "length", "b.block", "b.value")
    apart = F.col("own_print").bitwiseXOR(F.col("print"))
    # a pair that agrees in several blocks counts in the first of them
    first = F.coalesce(*[F.when(block_of(apart, k) == 0, F.lit(k)) for k in range(RADIUS + 1)])
    pairs = by_block.join(send(index, few), ["length", "block", "value"]).filter((F.bit_count(apart) <= RADIUS) & (F.col("block") == first))

    found = pairs.select("doc", "version", "start", "length", "size", "key").join(bags, ["doc", "version"]).join(send(items.select("key", "item", "bag", "repeated"), small), "key")
    own = F.slice("all", F.col("start") + 1, F.col("length"))
    return (
        found.withColumn("both", shared(own, F.col("bag"), F.col("repeated")))
        .withColumn("similarity", F.col("both") / (F.col("size") + F.col("length") - F.col("both")))
        .filter(F.col("similarity") >= similarity)
        .groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
        .select(doc_id, item_id, (-F.col("best.start")).alias("start_word"), F.col("best.similarity").alias("similarity"))
    )


def query(spark, sf_dir):
    """Documents that hold a benchmark item, with the item, the place and the similarity."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contaminated(read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"))
