"""Queries of the acceptance report: four stages of retrieval for each item, from one index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import acceptance as A
from ..operators import contexts as C
from ..operators import impacts as I
from ..operators import retrieval as R
from ..sources.shared import built, spread
from . import judging
from .retrieving import ARMS, document_features, indexed

BUDGET, CHUNKS, POOL = 1_800, 6, 20
#: An item's document is on topic if it has this share of the item's terms.
ON_TOPIC = 0.5
#: The item's number stands for what it asks for.
WISH = {"intent": "CASE item_id % 2 WHEN 0 THEN 'methodology' ELSE 'activity' END", "wanted_level": "CASE WHEN item_id % 3 < 2 THEN 'A1' END", "wanted_skill": "CASE WHEN item_id % 2 = 0 THEN 'reading' END"}
CANDIDATE = [WISH, *rules.adjustments("intent", "level", "wanted_level", "wanted_skill")]
TOKEN = r"[\p{L}\p{N}_]+|[^\p{Z}\x09-\x0D\p{L}\p{N}_]"


def wished() -> str:
    """Whether a role is one that the intent prefers."""
    return rules.first_of([(f"intent = '{k}'", f"role IN ({', '.join(repr(r) for r in rules.PREFERRED[k])})") for k in ("methodology", "activity")], "NULL")


def ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    """(item_id, doc_id, stage, place) of the four stages, and what is known of each (item, document) in them."""
    asked, index = indexed(spark, d)
    overlap = built(I.overlap(index, asked, "item_id"))
    fused = built(R.fuse(I.search(index, asked, "item_id"), overlap, ["item_id", "doc_id"]).filter(F.col("fused_rank") <= POOL))
    ids = overlap.select("doc_id").unionByName(fused.select("doc_id")).distinct().withColumnRenamed("doc_id", "id")
    docs = spread(judging.pieces(spark, d).join(I.if_small(ids, I.BROADCAST_ROWS), "id", "left_semi"))
    own = {"copy": "md5(content)", "tokens": f"CAST(regexp_count(content, r'{TOKEN}') AS BIGINT)"}
    judged = rules.settled(rules.applied(docs, [*document_features(judging.S), own]), "id", "level", "role", "concrete", "heading_skills", "content_skills", "copy", "tokens")
    judged = built(judged.withColumnRenamed("id", "doc_id"))
    candidates = rules.applied(fused.join(I.if_small(judged, I.BROADCAST_ROWS), "doc_id"), CANDIDATE)
    final = built(R.feature_rank(candidates, [F.col(c) for c in judging.ADJUSTMENTS], "item_id", "doc_id", "fused_rank"))
    context = C.budgeted(C.tables.first_of_key(final, F.concat_ws(" ", F.col("item_id").cast("string"), "copy"), ["final_rank"]).select("item_id", "doc_id", "final_rank", "tokens"), "item_id", ["final_rank"], "tokens", CHUNKS, BUDGET)
    stage = lambda df, name, place: df.select("item_id", "doc_id", F.lit(name).alias("stage"), place.cast("long").alias("place"))
    parts = [stage(overlap, "A", F.col("rank")), stage(fused, "B", F.col("fused_rank")), stage(final, "C", F.col("final_rank")), stage(context, "D", F.col("place") + 1)]
    runs = built(reduce(DataFrame.unionByName, parts))
    pairs = runs.select("item_id", "doc_id").distinct()
    common = I.scored(index, pairs, I.if_small(asked.select("item_id", "term", F.lit(1.0).alias("q")), I.BROADCAST_ROWS), "item_id", lambda n: F.when(F.col(n) > 0, 1.0))
    facts = pairs.join(common, ["item_id", "doc_id"], "left").join(asked.groupBy("item_id").agg(F.count("*").alias("n_terms")), "item_id").join(judged, "doc_id")
    facts = rules.applied(facts, [WISH])
    desired = F.coalesce(F.expr(wished()), F.lit(False))
    return runs, built(facts.select("item_id", "doc_id", (F.coalesce("score", F.lit(0.0)) >= ON_TOPIC * F.col("n_terms")).alias("topic"), desired.alias("desired"), "concrete", "copy", "tokens"))


def hits(runs: DataFrame, facts: DataFrame) -> DataFrame:
    return runs.filter(F.col("place") <= A.TOP).join(facts, ["item_id", "doc_id"])


def acceptance_cases(spark, d):
    """Of each item and stage what is on topic, wished and concrete, and what the stage gains over the one before."""
    rows = A.cases(hits(*ranked(spark, d)), "item_id")
    return rows.select("item_id", "stage", "hits", "topic", "desired", "first_desired", "concrete", "duplicate_rate", "tokens", F.round("gain", 6).alias("gain"))


def acceptance_report(spark, d):
    """The four stages side by side, all of them together, and whether the last may be handed on."""
    return A.report(A.cases(hits(*ranked(spark, d)), "item_id"), BUDGET)


def acceptance_labels(spark, d):
    """Why an item isn't served, from its stages and its whole pool."""
    runs, facts = ranked(spark, d)
    pool = runs.filter("stage = 'C'").join(facts, ["item_id", "doc_id"]).groupBy("item_id").agg(F.bool_or("desired").alias("desired"), F.bool_or("concrete").alias("concrete"))
    return A.diagnosis(A.cases(hits(runs, facts), "item_id"), pool, "item_id")


def _stages() -> str:
    own = {"copy": "md5(content)", "tokens": f"len(regexp_extract_all(content, '{TOKEN}'))"}
    judged = rules.stated(judging.PIECES, [*document_features(judging.D), own])
    fits = f"t.used + g.tokens <= {BUDGET} AND t.taken < {CHUNKS}"
    return f"""WITH RECURSIVE {ARMS}, u AS (SELECT id AS doc_id, level, role, concrete, heading_skills, content_skills, copy, tokens FROM {judged}),
    x AS (SELECT f.item_id, f.doc_id, f.fused_rank, u.* EXCLUDE (doc_id) FROM f JOIN u USING (doc_id) WHERE fused_rank <= {POOL}),
    y AS (SELECT *, round(1 - 0.025::DOUBLE * (fused_rank - 1) + greatest(0.35::DOUBLE, 1 - 0.04::DOUBLE * (fused_rank - 1)) * ({' + '.join(judging.ADJUSTMENTS)}), 6) AS final_score FROM {rules.stated('x', CANDIDATE)}),
    c AS (SELECT item_id, doc_id, copy, tokens, row_number() OVER (PARTITION BY item_id ORDER BY final_score DESC, fused_rank, doc_id) AS final_rank FROM y),
    g AS (SELECT item_id, doc_id, tokens, row_number() OVER (PARTITION BY item_id ORDER BY final_rank) AS n FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_id, copy ORDER BY final_rank) = 1)),
    t AS (SELECT item_id, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS taken, NULL::BIGINT AS doc_id, false AS kept FROM benchmark
      UNION ALL SELECT t.item_id, g.n, CASE WHEN {fits} THEN t.used + g.tokens ELSE t.used END, CASE WHEN {fits} THEN t.taken + 1 ELSE t.taken END, g.doc_id, {fits} FROM t JOIN g ON g.item_id = t.item_id AND g.n = t.n + 1),
    runs AS (SELECT 'A' AS stage, item_id, doc_id, rank AS place FROM b UNION ALL SELECT 'B', item_id, doc_id, fused_rank FROM f WHERE fused_rank <= {POOL} UNION ALL SELECT 'C', item_id, doc_id, final_rank FROM c UNION ALL SELECT 'D', item_id, doc_id, taken FROM t WHERE kept),
    k AS (SELECT item_id, count(*) AS n_terms FROM q GROUP BY item_id),
    facts AS (SELECT item_id, doc_id, coalesce(o.score, 0) >= {ON_TOPIC} * n_terms AS topic, coalesce({wished()}, false) AS desired, concrete, copy, tokens
      FROM {rules.stated('(SELECT DISTINCT item_id, doc_id FROM runs)', [WISH])} z LEFT JOIN o USING (item_id, doc_id) JOIN k USING (item_id) JOIN u USING (doc_id)),
    cases AS (SELECT *, topic - lag(topic) OVER (PARTITION BY item_id ORDER BY stage) AS gain FROM (SELECT item_id, stage, count(*) AS hits, round(avg(topic::INT), 6) AS topic, bool_or(desired) AS desired, bool_or(desired AND place <= 3) AS desired_3, bool_or(desired AND place <= 5) AS desired_5,
      min(place) FILTER (desired) AS first_desired, bool_or(concrete AND place <= 5) AS concrete_5, bool_or(concrete) AS concrete, round((count(*) - count(DISTINCT copy)) / count(*), 6) AS duplicate_rate, sum(tokens)::BIGINT AS tokens FROM runs JOIN facts USING (item_id, doc_id) WHERE place <= {A.TOP} GROUP BY ALL))"""


STAGES = _stages()
_COUNTS = ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("desired", "desired_3", "desired_5", "concrete_5", "concrete"))
QUERIES = {
    "acceptance_cases": (acceptance_cases, f"{STAGES} SELECT item_id, stage, hits, topic, desired, first_desired, concrete, duplicate_rate, tokens, round(gain, 6) AS gain FROM cases"),
    "acceptance_report": (
        acceptance_report,
        f"""{STAGES} SELECT *, CASE WHEN stage = 'D' THEN CASE WHEN bad THEN 'NOT_READY' ELSE 'READY' END END AS decision FROM (SELECT stage, count(*) AS cases, round(avg(topic), 6) AS topic, {_COUNTS}, round(avg(first_desired), 6) AS mean_first_desired, round(avg(duplicate_rate), 6) AS duplicate_rate,
        count(*) FILTER (gain > 0) AS improved, count(*) FILTER (gain = 0) AS unchanged, count(*) FILTER (gain < 0) AS regressed, count(*) FILTER (stage = 'D' AND tokens > {BUDGET}) AS overflows, bool_or(stage = 'D' AND (duplicate_rate > 0 OR tokens > {BUDGET})) AS bad FROM cases GROUP BY GROUPING SETS ((stage), ()))""".replace("SELECT *, CASE WHEN stage = 'D'", "SELECT * EXCLUDE (bad), CASE WHEN stage = 'D'"),
    ),
    "acceptance_labels": (
        acceptance_labels,
        f"""{STAGES}, whole AS (SELECT item_id, bool_or(desired) AS pool, bool_or(concrete) AS strong FROM runs JOIN facts USING (item_id, doc_id) WHERE stage = 'C' GROUP BY item_id),
        e AS (SELECT item_id, coalesce(bool_or(desired) FILTER (stage = 'C'), false) AS top, coalesce(bool_or(desired) FILTER (stage = 'D'), false) AS final FROM cases GROUP BY item_id)
        SELECT item_id, coalesce(nullif(concat_ws(', ', CASE WHEN NOT top AND pool THEN 'RANKING_LIMITATION' END, CASE WHEN NOT pool AND NOT strong THEN 'RETRIEVAL_COVERAGE_LIMITATION' END, CASE WHEN top AND NOT final THEN 'COMPOSITION_LOSS' END, CASE WHEN NOT strong THEN 'NO_STRONG_CONCRETE_AVAILABLE' END), ''), 'NO_LIMITATION_DETECTED') AS labels FROM e JOIN whole USING (item_id)""",
    ),
}
