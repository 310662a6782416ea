"""Queries of the retrieval chain: postings, search, fusion, ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import cells
from ..operators import impacts as I
from ..operators import retrieval as R
from ..sources.shared import built, spread
from . import judging
from .texts import TERMS_SQL


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, d):
    return read(spark, d, "benchmark").select("item_id", "text")


def term_frequencies(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return R.inverse_frequencies(R.postings(docs), docs.count()).select("term", "n", F.round("idf", 6).alias("idf"))


def indexed(spark, d):
    """Postings of the items, and one index of the documents for all arms of a query."""
    asked = built(R.postings(items(spark, d), "item_id"))
    return asked, I.index(spread(read(spark, d, "documents").select("doc_id", "text")), asked)


def sparse(spark, d):
    asked, index = indexed(spark, d)
    return I.search(index, asked, "item_id")


def both_arms(spark, d):
    """The sparse arm, and by how many distinct terms of the item a document has, in one list."""
    asked, index = indexed(spark, d)
    return R.fuse(I.search(index, asked, "item_id"), I.overlap(index, asked, "item_id"), ["item_id", "doc_id"])


def sparse_search(spark, d):
    return sparse(spark, d).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


def fused_search(spark, d):
    fused = both_arms(spark, d)
    return fused.select("item_id", "doc_id", "rrf", F.col("fused_rank").cast("long").alias("fused_rank"))


def provenance(spark, d):
    """Of each item's candidates how many come from both arms, and from either alone."""
    fused = both_arms(spark, d)
    a, b = F.col("first_rank").isNotNull(), F.col("second_rank").isNotNull()
    return fused.groupBy("item_id").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"))


def dense_search(spark, d):
    """The ten vectors nearest to every twentieth vector."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    top = cells.search(v, v.filter("vec_id % 20 = 0"), k=10)
    return top.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def dense_filtered(spark, d):
    """The same among vectors whose document is French or English and longer than 200 characters: filters come before the search."""
    docs = read(spark, d, "documents").filter(F.col("lang").isin("fr", "en") & (F.col("n_chars") > 200)).select(F.col("doc_id").alias("vec_id"))
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    top = cells.search(v.join(docs, "vec_id", "left_semi"), v.filter("vec_id % 20 = 0"), k=5)
    return top.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def hydrated_hits(spark, d):
    hits = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    rows = R.hydrate(hits, read(spark, d, "documents").select("doc_id", "lang"))
    return rows.groupBy("label").agg(F.count("*").alias("hits"), F.count_if("stale").alias("stale"), F.countDistinct("lang").alias("languages"))


def asked_features():
    """The item's number stands for what it asks for."""
    return {"intent": "CASE item_id % 4 WHEN 0 THEN 'activity' WHEN 1 THEN 'exercise' WHEN 2 THEN 'listening' ELSE 'general' END", "wanted_level": "CASE WHEN item_id % 3 < 2 THEN 'A1' END", "wanted_skill": "CASE WHEN item_id % 2 = 0 THEN 'reading' END"}


def document_features(dialect):
    """What a document says for itself: role, concreteness, skills."""
    return [*rules.role(dialect, "kind", "heading", "content"), *rules.concreteness(dialect, "kind", "heading", "content"), *rules.skill_evidence(dialect, "heading", "content")]


def candidate_features():
    return [asked_features(), *rules.adjustments("intent", "level", "wanted_level", "wanted_skill")]


def ranked_by_features(spark, d):
    """The sparse arm again, with what role, concreteness, level and skill say. Each document that any item found is judged once."""
    hits = built(sparse(spark, d).withColumnRenamed("doc_id", "id"))
    docs = spread(judging.pieces(spark, d).join(I.if_small(hits.select("id").distinct(), I.BROADCAST_ROWS), "id", "left_semi"))
    judged = rules.settled(rules.applied(docs, document_features(judging.S)), "id", "level", "role", "concrete", "heading_skills", "content_skills")
    rows = rules.applied(judged.join(I.if_small(hits, I.BROADCAST_ROWS), "id"), candidate_features()).withColumnRenamed("id", "doc_id")
    ranked = R.feature_rank(rows, [F.col(c) for c in judging.ADJUSTMENTS], "item_id", "doc_id")
    return ranked.select("item_id", "doc_id", "final_score", F.col("final_rank").cast("long").alias("final_rank"))


def composed(spark, d):
    """At most two documents of a source, six in all."""
    rows = sparse(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.diverse(rows, "item_id", "source", "rank", 2, 6).select("item_id", "doc_id", F.col("place").cast("long").alias("place"))


def retrieval_metrics(spark, d):
    """Of each item's ten first hits: those that contain the whole item, the first such rank, sources, duplicates."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    rows = sparse(spark, d).filter("rank <= 10").join(docs, "doc_id").join(items(spark, d).withColumnRenamed("text", "item"), "item_id")
    hit = F.contains(T.normalized(F.col("text")), T.normalized(F.col("item")))
    n = F.count("*")
    return rows.groupBy("item_id").agg(
        F.count_if(hit).alias("relevant"), F.min(F.when(hit, F.col("rank"))).cast("long").alias("first_relevant"), F.countDistinct("source").alias("sources"), F.round((n - F.countDistinct("text")) / n, 6).alias("duplicate_rate")
    )


def arm_comparison(spark, d):
    """How often fusion places a document better than the sparse arm, as well, or worse."""
    fused = both_arms(spark, d).filter("first_rank IS NOT NULL")
    delta = F.sign(F.col("first_rank") - F.col("fused_rank"))
    return fused.groupBy("item_id").agg(F.count_if(delta > 0).alias("improved"), F.count_if(delta == 0).alias("unchanged"), F.count_if(delta < 0).alias("regressed"))


POSTINGS = f"""p AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY ALL),
 w AS (SELECT term, count(*) AS n, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
 q AS (SELECT item_id, term, 1 + ln(count(*)) AS tf FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL)"""
SPARSE = f"""{POSTINGS}, s AS (SELECT item_id, doc_id, round(sum(p.tf * q.tf * idf), 6) AS score FROM p JOIN q USING (term) JOIN w USING (term) GROUP BY ALL),
 a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)"""
ARMS = f"""{SPARSE}, o AS (SELECT item_id, doc_id, count(*) AS score FROM p JOIN q USING (term) GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= 20),
 m AS (SELECT item_id, doc_id, a.rank AS r1, b.rank AS r2, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM a FULL JOIN b USING (item_id, doc_id)),
 f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, least(r1, r2), doc_id) AS fused_rank FROM m)"""
NORM = r"lower(trim(regexp_replace({}, '[\p{{Z}}\x09-\x0D]+', ' ', 'g')))"
DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"



def _dense(which: str, k: int) -> str:
    cosine = f"{DOT.format(a='e.embedding', b='q.embedding')} / sqrt({DOT.format(a='e.embedding', b='e.embedding')} * {DOT.format(a='q.embedding', b='q.embedding')})"
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round({cosine}, 6) AS score FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND {which}) QUALIFY rank <= {k}"""


QUERIES = {
    "term_frequencies": (term_frequencies, f"WITH {POSTINGS} SELECT term, n, round(idf, 6) AS idf FROM w"),
    "sparse_search": (sparse_search, f"WITH {SPARSE} SELECT item_id, doc_id, rank, score FROM a"),
    "fused_search": (fused_search, f"WITH {ARMS} SELECT item_id, doc_id, rrf, fused_rank FROM f"),
    "provenance": (
        provenance,
        f"WITH {ARMS} SELECT item_id, count(*) FILTER (r1 IS NOT NULL AND r2 IS NOT NULL) AS both, count(*) FILTER (r2 IS NULL) AS first_only, count(*) FILTER (r1 IS NULL) AS second_only FROM f GROUP BY item_id",
    ),
    "dense_search": (dense_search, _dense("true", 10)),
    "dense_filtered": (dense_filtered, _dense("e.vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('fr', 'en') AND n_chars > 200)", 5)),
    "hydrated_hits": (
        hydrated_hits,
        "SELECT label, count(*) AS hits, count(*) FILTER (doc_id IS NULL) AS stale, count(DISTINCT lang) AS languages FROM embeddings LEFT JOIN documents ON doc_id = vec_id GROUP BY label",
    ),
    "ranked_by_features": (
        ranked_by_features,
        f"""WITH {SPARSE}, c AS (SELECT a.*, p.* EXCLUDE (id) FROM a JOIN {judging.PIECES} p ON p.id = a.doc_id), r AS (SELECT item_id, doc_id, rank,
        round(1 - 0.025::DOUBLE * (rank - 1) + greatest(0.35::DOUBLE, 1 - 0.04::DOUBLE * (rank - 1)) * ({' + '.join(judging.ADJUSTMENTS)}), 6) AS final_score FROM {rules.stated('c', [*document_features(judging.D), *candidate_features()])})
        SELECT item_id, doc_id, final_score, row_number() OVER (PARTITION BY item_id ORDER BY final_score DESC, rank, doc_id) AS final_rank FROM r""",
    ),
    "composed": (
        composed,
        f"""WITH {SPARSE}, c AS (SELECT item_id, doc_id, rank FROM a JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY rank) <= 2)
        SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM c QUALIFY place <= 6""",
    ),
    "retrieval_metrics": (
        retrieval_metrics,
        f"""WITH {SPARSE} SELECT item_id, count(*) FILTER (contains({NORM.format('d.text')}, {NORM.format('b.text')})) AS relevant, min(rank) FILTER (contains({NORM.format('d.text')}, {NORM.format('b.text')})) AS first_relevant, count(DISTINCT source) AS sources,
        round((count(*) - count(DISTINCT d.text)) / count(*), 6) AS duplicate_rate FROM a JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 10 GROUP BY item_id""",
    ),
    "arm_comparison": (
        arm_comparison,
        f"WITH {ARMS} SELECT item_id, count(*) FILTER (r1 > fused_rank) AS improved, count(*) FILTER (r1 = fused_rank) AS unchanged, count(*) FILTER (r1 < fused_rank) AS regressed FROM f WHERE r1 IS NOT NULL GROUP BY item_id",
    ),
}


def budgeted_contexts(spark, d):
    """Of each item's candidates at most six within 1,800 tokens, skipping those that don't fit."""
    from ..operators import contexts

    docs = read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    rows = sparse(spark, d).select("item_id", "rank", "doc_id").join(docs, "doc_id")
    chosen = contexts.budgeted(rows, "item_id", ["rank"], "tokens", 6, 1800)
    return chosen.select("item_id", "doc_id", F.col("place").cast("long").alias("place"), F.col("tokens").cast("long").alias("tokens"))


QUERIES["budgeted_contexts"] = (
    budgeted_contexts,
    f"""WITH RECURSIVE {SPARSE}, c AS (SELECT item_id, rank, doc_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{Z}}\\x09-\\x0D\\p{{L}}\\p{{N}}_]')) AS n FROM a JOIN documents USING (doc_id)),
    f AS (SELECT item_id, 0 AS rank, 0::BIGINT AS used, 0 AS taken, NULL::BIGINT AS doc_id, 0::BIGINT AS n, false AS kept FROM benchmark
      UNION ALL SELECT f.item_id, c.rank, CASE WHEN f.used + c.n <= 1800 AND f.taken < 6 THEN f.used + c.n ELSE f.used END, CASE WHEN f.used + c.n <= 1800 AND f.taken < 6 THEN f.taken + 1 ELSE f.taken END, c.doc_id, c.n, f.used + c.n <= 1800 AND f.taken < 6 FROM f JOIN c ON c.item_id = f.item_id AND c.rank = f.rank + 1)
    SELECT item_id, doc_id, taken - 1 AS place, n AS tokens FROM f WHERE kept""",
)
