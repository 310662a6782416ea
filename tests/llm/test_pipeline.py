"""The pipeline and the registered queries on the small tables."""

from __future__ import annotations

import inspect
from collections import Counter

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from lexiforge.llm import bpe, toxicity
from pyspark.sql import functions as F

from .test_jaccard import brute
from .test_passages import brute as leaks
from .test_passages import prose

DIR = "/root/testdata/sf0.01"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, DIR).cache()
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if k == 0:
            labels = spark.read.parquet(f"{DIR}/labels.parquet")
            model = toxicity.fit(docs, labels)
            assert set(after) == {i for i, t in before.items() if model.score(t or "") < 0.5}
        if k == 1:
            assert set(after) == {c for _, _, c in brute(sorted(before.items()), 5, 80)}
        if k == 2:
            assert set(after) == set(before)
            assert all(r.n_chars == len(r.text) <= len(before[i]) for i, r in after.items())
        if k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            near = [(i, t) for i, t in before.items() if any(item.lower()[:30] in t.lower() or item.lower()[-30:] in t.lower() for _, item in items)]
            assert set(before) - set(after) >= {i for i, _ in leaks(near, items)}
        if k < 4:
            assert out.columns == names
        docs = out
    for r in out.collect():
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.n_tokens
    assert out.count() == len(before)


def test_a_small_corpus_end_to_end(spark, tmp_path):
    item, passage = prose(900, 40), prose(901, 70)
    rows = [(i, prose(i, 120)) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " end"), (102, f"{prose(50, 60)} {passage}"), (103, f"{passage} {prose(51, 60)}"), (104, f"{prose(52, 60)} {item} {prose(53, 9)}"), (105, None), (106, "")]
    table = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(40)) | {102, 103, 105, 106}
    coder = bpe.codec(bpe.public_tokenizers.path(bpe.VOCABULARY))
    assert got[103] < len(coder.encode(rows[43][1])[0]) / 4 - 60 and got[102] == len(coder.encode(rows[42][1])[0]) / 4


def test_odd_rows_pass_the_stages(spark):
    rows = [(1, prose(1, 80)), (1, prose(1, 80)), (None, prose(2, 60)), (None, None), (3, None), (4, ""), (5, prose(3, 60)), (6, prose(3, 60))]
    docs = spark.createDataFrame([(i, t, None, "s", None, 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key long, start long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns, name
        left = got.collect()
        assert sum(r.doc_id is None for r in left) == 2 and {r.doc_id for r in left} >= {1, 3, 4, 5}, name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
        docs = spark.createDataFrame(left, docs.schema)
    assert sorted(r.doc_id for r in docs.collect() if r.doc_id) == [1, 3, 4, 5]
    assert all(r.n_tokens >= 0 for r in corpus_pipeline.STAGES[4][1](spark, docs, "/root/testdata/sf0.001").collect())


def test_all_queries_are_registered():
    names = list(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names


def test_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    want = {
        "op1": {"page_id", "url", "text", "n_chars"},
        "op2": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op3": {"doc_id", "held_out", "score", "predicted"},
        "op7": {"query_id", "rank", "vec_id", "score"},
        "op10": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    }
    for name, run in entry.queries().items():
        if (op := name.split("_")[0]) in want:
            df = run(spark, d)
            assert want[op] <= set(df.columns)
            rows = df.collect()
            if op == "op2":
                assert Counter(r.law for r in rows).keys() == {"bytes"} and {r.shard for r in rows} <= set(range(24))
            if op == "op3":
                assert all(r.predicted == (r.score >= 0.5) for r in rows) and len(rows) == 200


def test_operators_say_what_they_do():
    import lexiforge.llm as package
    import pkgutil
    from importlib import import_module

    for m in pkgutil.iter_modules(package.__path__):
        assert inspect.getdoc(import_module(f"lexiforge.llm.{m.name}"))


def test_folds_of_null_ids(spark):
    row = spark.createDataFrame([(None,)], "i long").select(toxicity.fold(F.col("i"), 5).alias("f")).first()
    assert row.f == 0


def test_queries_equal_their_sql(spark):
    from lexiforge.llm import registry

    from ..oracle import connected

    d = "/root/testdata/sf0.001"
    con = connected(d)
    for name, sql in registry.oracle_sql().items():
        want = con.sql(sql)
        got = [tuple(r[c] for c in want.columns) for r in registry.queries()[name](spark, d).collect()]
        assert sorted(got, key=str) == sorted(want.fetchall(), key=str), name
