"""Small cases of text functions and relational operators."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Row
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import retrieval, segmentation, tables


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_tokens_count_words_and_marks(spark):
    assert one(spark, "Lis, réponds !", T.token_estimate) == 4
    assert one(spark, "", T.token_estimate) == 0
    assert one(spark, "a b", T.token_estimate) == 2


def test_terms_keep_inner_marks_and_arabic(spark):
    assert one(spark, "L'École est-elle OK? الأسرة", T.terms) == ["l'école", "est-elle", "ok", "الأسرة"]


def test_cleaning_collapses_lines(spark):
    assert one(spark, "a \r\n\r\n\r\n\r\n b\x00\t c ", T.cleaned) == "a\n\nb c"


def test_previews_end_in_an_ellipsis(spark):
    assert one(spark, "ab  cd", lambda c: T.preview(c, 5)) == "ab cd"
    assert one(spark, "ab  cd ef", lambda c: T.preview(c, 4)) == "ab…"


def test_levels(spark):
    assert one(spark, " PRE-A1 ", T.level_of) == "A1"
    assert one(spark, "b 1", T.level_of) == "B1"
    assert one(spark, "D1", T.level_of) is None


def test_digests_equal_their_definitions(spark):
    made = one(spark, "chunk:1", lambda c: T.name_uuid("6ba7b8119dad11d180b400c04fd430c8", c))
    assert made == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:1"))
    v = one(spark, "x", T.digest_vector)
    h = hashlib.sha256(b"x").digest()
    assert v == [int.from_bytes(h[i * 4 : i * 4 + 4], "big") / 2**32 for i in range(8)]
    same = [one(spark, t, lambda c: T.chunk_digest(c, F.lit("t"), F.lit(None).cast("int"), F.lit(2), "v1")) for t in ("a  b", " a\nb ")]
    assert same[0] == same[1]


def test_fusion_of_two_lists(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "q int, d string, rank int")
    got = {r.d: (r.rrf, r.fused_rank) for r in retrieval.fuse(a, b, ["q", "d"]).collect()}
    assert got["b"] == (round(1 / 62 + 1 / 61, 9), 1)
    assert got["a"][1] == 2 and got["c"][1] == 3


def test_budget_skips_what_is_too_large_and_stops_at_the_limit(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 2, 9), (1, 3, 4), (1, 4, 5)], "g int, i int, n int")
    got = retrieval.within_budget(rows, "g", ["i"], "n", 10, 5).orderBy("i").collect()
    assert [r.i for r in got] == [1, 3]


def test_windows_and_packing(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "  "), (3, None)], "doc_id long, text string")
    got = segmentation.word_windows(docs, words=2).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.n_words, r.content) for r in got] == [(1, 2, "a b"), (1, 2, "c d"), (1, 1, "e")]


def test_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(t, c, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, tables.delete(t, c, ["k"]).collect())) == [(1, "a")]
    assert {(r.k, r.state) for r in tables.compare(t, c, "k").collect()} == {(1, "left_only"), (2, "both"), (3, "right_only")}
    got = tables.first_of_key(spark.createDataFrame([Row(i=1, x="a"), Row(i=2, x="a"), Row(i=3, x=""), Row(i=4, x="")]), F.col("x"), ["i"])
    assert sorted(r.i for r in got.collect()) == [1, 3, 4]


def test_near_copies_equal_brute_force(spark):
    import random

    from lexiforge.operators import exercises as X

    r = random.Random(1)
    texts = []
    for _ in range(25):
        w = [f"m{r.randrange(60)}" for _ in range(r.randrange(2, 25))]
        texts += [" ".join(w), " ".join(w[: len(w) - r.randrange(4)] + ["new"] * r.randrange(2))]
    texts += [texts[3]] * 40 + [None, "", "x"]
    got = {p.i: p.representative for p in X.near_copies(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "i", "text").collect()}
    sets = [frozenset(w for w in (t or "")[:180].split() if len(w) >= 2) for t in texts]
    first = {s: sets.index(s) for s in sets if s}
    near = lambda a, b: round(2 * len(a & b) / (len(a) + len(b)), 6) >= 0.78
    want = {i: min([j for t, j in first.items() if j < first[s] and near(s, t)] or [first[s]]) if s else i for i, s in enumerate(sets)}
    assert got == want


def written(spark, job) -> int:
    """Bytes that the stages of a job write for shuffles."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    every = lambda: {s.stageId(): s.shuffleWriteBytes() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))}
    before = every()
    job()
    return sum(n for i, n in every().items() if i not in before)


def test_near_copies_of_few_words_write_no_pairs(spark):
    """Texts of a small vocabulary share their rarest words with most others; near copies of one text are like each other."""
    import random

    from lexiforge.operators import exercises as X

    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(70)]
    texts = [" ".join(r.sample(vocabulary, 30)) for _ in range(1_200)]
    texts += [" ".join(w if r.random() < 0.9 else f"x{r.randrange(4)}" for w in vocabulary[:30]) for _ in range(150)]
    rows, got = spark.createDataFrame(list(enumerate(texts)), "i long, text string"), {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = written(spark, lambda: got.update({p.i: p.representative for p in X.near_copies(rows, "i", "text").collect()}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sets = [frozenset(t[:180].split()) for t in texts]
    first = {s: sets.index(s) for s in sets}
    near = lambda a, b: round(2 * len(a & b) / (len(a) + len(b)), 6) >= 0.78
    want = {i: min([j for t, j in first.items() if j < first[s] and near(s, t)] or [first[s]]) for i, s in enumerate(sets)}
    assert got == want
    assert len(set(want.values())) < len(texts) - 50
    assert n < 10_000_000, n


def test_contexts(spark):
    from lexiforge.operators import contexts as C

    schema = "q int, rank int, doc int, i int, head string, text string, n int"
    rows = [(1, 1, 7, 0, "h", "Same  text", 5), (1, 2, 7, 1, "h", "same text", 5), (1, 3, 7, 2, "h", "b", 90), (1, 4, 7, 3, "h", "c", 3), (1, 5, 8, 0, None, "d", 2), (1, 6, 8, 1, None, "e", 1), (2, 1, 9, 0, "h", "same text", 4)]
    table = spark.createDataFrame(rows, schema)
    first = C.first_texts(table, "q", ["rank"], "text")
    chosen = C.budgeted(first, "q", ["rank"], "n", 3, 12).cache()
    assert sorted((r.q, r.rank, r.place) for r in chosen.collect()) == [(1, 1, 0), (1, 4, 1), (1, 5, 2), (2, 1, 0)]
    merged = C.blocks(chosen, "q", "doc", "head", "place", "text").collect()
    assert sorted((r.q, r.doc, r.content) for r in merged) == [(1, 7, "Same  text\n\nc"), (1, 8, "d"), (2, 9, "same text")]
    near = C.neighbours(table.filter("rank = 2 and q = 1"), table.select("doc", "i", "head", "text"), "doc", "i", "head").collect()
    assert [r.neighbour.text for r in near] == ["Same  text"]
    reasons = table.select(C.usable(F.col("text"), F.lit(None).cast("string")).alias("r")).distinct().collect()
    assert {r.r for r in reasons} == {None, "low_information"}
