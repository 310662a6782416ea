"""Queries that cut documents into chunks and compose contexts of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, tables
from ..operators import chunking, composing
from . import judging

BUDGET = 120
CONTEXT = "'Document: ' || source || ' Section: ' || lang"
WORDS = r"[\p{L}\p{N}_]+|[^\p{Z}\x09-\x0D\p{L}\p{N}_]"


def packed_chunks(spark, d):
    """Documents cut at paragraphs and sentences into chunks of 120 tokens with their context; long sentences by words."""
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("kind", F.lit("text"))
    c = chunking.chunks(docs, "doc_id", "text", "kind", "source", "lang", BUDGET)
    return c.select("doc_id", "chunk_index", "tokens", F.md5("content").alias("digest"))


def table_chunks(spark, d):
    """Tables of documents, one for each language and 64 ids, cut by rows under a repeated header."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    line = F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), "source", F.lit(" | "), F.col("n_chars").cast("string"), F.lit(" |"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"])
    text = F.concat(F.lit("| id | source | chars |\n|---|---|---|\n"), F.array_join(rows, "\n"))
    tables = docs.groupBy("lang", F.floor(F.col("doc_id") / 64).alias("part")).agg(text.alias("text")).select(F.concat_ws("-", "lang", "part").alias("name"), "text", F.lit("table").alias("kind"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("heading"))
    c = chunking.chunks(tables, "name", "text", "kind", "title", "heading", BUDGET)
    return c.select("name", "chunk_index", "tokens", F.md5("content").alias("digest"))


def candidates(spark, d):
    """Chunks as candidates of requests: one for each ten source files, in order of id."""
    steps = [
        *rules.role(judging.S, "kind", "heading", "content"),
        *rules.concreteness(judging.S, "kind", "heading", "content"),
        {"request": "document_id div 5", "category": "CASE WHEN concrete THEN 'concrete' WHEN role = 'METHODOLOGY' THEN 'guidance' ELSE 'supporting' END", "tokens": judging.S.count("content", WORDS)},
        {"intent": "CASE request % 3 WHEN 0 THEN 'concrete_activity' WHEN 1 THEN 'methodology' ELSE 'general' END"},
    ]
    return rules.applied(judging.pieces(spark, d), steps).selectExpr("request", "id", "document_id AS document", "page", "heading", "category", "intent", "content", "CAST(tokens AS BIGINT) AS tokens")


def composed_contexts(spark, d):
    """The composer's six of each request's twenty first candidates, and why each was taken."""
    return composing.composed(candidates(spark, d).drop("content", "tokens"), "request", ["id"])


def distinct_contexts(spark, d):
    """Each request's candidates that say something new, within 1,800 tokens."""
    return composing.contexts(candidates(spark, d).select("request", "id", "content", "tokens"), "request", ["id"])


_UNITS = r"""u AS (SELECT doc_id, source, lang, k, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(p, '([.!?…؟])[\p{Z}\x09-\x0D]+', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, E' \t\n\r')), lambda s: s <> '')) AS s, generate_subscripts(list_filter(list_transform(regexp_split_to_array(regexp_replace(p, '([.!?…؟])[\p{Z}\x09-\x0D]+', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, E' \t\n\r')), lambda s: s <> ''), 1) AS j
 FROM (SELECT doc_id, source, lang, generate_subscripts(x, 1) AS k, trim(unnest(x), E' \t\n\r') AS p FROM (SELECT doc_id, source, lang, regexp_split_to_array(trim(text, E' \t\n\r'), '\n\s*\n+') AS x FROM documents WHERE trim(text, E' \t\n\r') <> '')))"""

QUERIES = {
    "packed_chunks": (
        packed_chunks,
        rf"""WITH RECURSIVE b AS (SELECT doc_id, {BUDGET} - len(regexp_extract_all({CONTEXT}, '{WORDS}')) AS room, len(regexp_extract_all(text, '{WORDS}')) <= {BUDGET} - len(regexp_extract_all({CONTEXT}, '{WORDS}')) AS whole, trim(text, E' \t\n\r') AS t FROM documents),
        {_UNITS},
        n AS (SELECT *, len(regexp_extract_all(s, '{WORDS}')) AS m FROM u JOIN b USING (doc_id) WHERE NOT whole),
        w AS (SELECT doc_id, room, k, j, 0 AS i, s AS part, m, false AS word, false AS cut FROM n WHERE m <= room UNION ALL
          SELECT doc_id, room, k, j, i, part, len(regexp_extract_all(part, '{WORDS}')), true, i = 1 FROM (SELECT doc_id, room, k, j, generate_subscripts(x, 1) AS i, unnest(x) AS part FROM (SELECT *, list_filter(regexp_split_to_array(s, '[\p{{Z}}\x09-\x0D]+'), lambda y: y <> '') AS x FROM n WHERE m > room))),
        o AS (SELECT *, coalesce(cut OR (NOT word AND lag(word) OVER v), true) AS breaks, row_number() OVER v AS r FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY k, j, i)),
        f AS (SELECT doc_id, r, 0 AS c, m AS used FROM o WHERE r = 1 UNION ALL
          SELECT o.doc_id, o.r, CASE WHEN o.breaks OR f.used + o.m > o.room THEN f.c + 1 ELSE f.c END, CASE WHEN o.breaks OR f.used + o.m > o.room THEN o.m ELSE f.used + o.m END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1),
        g AS (SELECT doc_id, c::BIGINT AS chunk_index, sum(m)::BIGINT AS tokens, CASE WHEN bool_or(word) THEN string_agg(part, ' ' ORDER BY r) ELSE string_agg(part, chr(10) || chr(10) ORDER BY r) END AS content FROM (SELECT o.*, f.c FROM f JOIN o USING (doc_id, r)) GROUP BY doc_id, c)
        SELECT doc_id, chunk_index, tokens, md5(content) AS digest FROM g UNION ALL SELECT doc_id, 0, len(regexp_extract_all(t, '{WORDS}')), md5(t) FROM b WHERE whole AND t <> ''""",
    ),
    "table_chunks": (
        table_chunks,
        rf"""WITH RECURSIVE l AS (SELECT lang || '-' || doc_id // 64 AS name, row_number() OVER (PARTITION BY lang, doc_id // 64 ORDER BY doc_id) AS r, '| ' || doc_id || ' | ' || source || ' | ' || n_chars || ' |' AS line FROM documents),
        h AS (SELECT '| id | source | chars |' || chr(10) || '|---|---|---|' AS head), k AS (SELECT head, len(regexp_extract_all(head, '{WORDS}')) AS hm, {BUDGET} - len(regexp_extract_all('Document: t', '{WORDS}')) AS room FROM h),
        a AS (SELECT name, string_agg(line, chr(10) ORDER BY r) AS whole FROM l GROUP BY name), z AS (SELECT name, head || chr(10) || whole AS t, len(regexp_extract_all(head || chr(10) || whole, '{WORDS}')) AS m FROM a, k),
        o AS (SELECT l.*, len(regexp_extract_all(line, '{WORDS}')) AS m FROM l JOIN z USING (name), k WHERE z.m > k.room),
        f AS (SELECT name, r, 0 AS c, m AS used FROM o WHERE r = 1 UNION ALL SELECT o.name, o.r, CASE WHEN f.used + o.m > k.room - k.hm THEN f.c + 1 ELSE f.c END, CASE WHEN f.used + o.m > k.room - k.hm THEN o.m ELSE f.used + o.m END FROM f JOIN o ON o.name = f.name AND o.r = f.r + 1, k)
        SELECT name, c::BIGINT AS chunk_index, (any_value(hm) + sum(m))::BIGINT AS tokens, md5(any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY r)) AS digest FROM (SELECT o.*, f.c FROM f JOIN o USING (name, r)), k GROUP BY name, c
        UNION ALL SELECT name, 0, m, md5(t) FROM z, k WHERE m <= room""",
    ),
    "composed_contexts": (composed_contexts, None),
    "distinct_contexts": (
        distinct_contexts,
        f"""WITH RECURSIVE c AS (SELECT document_id // 5 AS request, id, lower(trim(regexp_replace(content, '[\\p{{Z}}\\x09-\\x0D]+', ' ', 'g'))) AS t, len(regexp_extract_all(content, '{WORDS}')) AS m, row_number() OVER (PARTITION BY document_id // 5 ORDER BY id) AS k FROM {judging.PIECES} QUALIFY k <= {composing.POOL}),
        f AS (SELECT request, 0::BIGINT AS k, []::VARCHAR[] AS kept, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS id, false AS took FROM (SELECT DISTINCT request FROM c) UNION ALL
          SELECT request, k, CASE WHEN fresh THEN list_append(kept, t) ELSE kept END, CASE WHEN fresh AND n < 6 AND used + m <= 1800 THEN used + m ELSE used END, CASE WHEN fresh AND n < 6 AND used + m <= 1800 THEN n + 1 ELSE n END, id, fresh AND n < 6 AND used + m <= 1800
          FROM (SELECT f.request, c.k, f.kept, f.used, f.n, c.id, c.t, c.m, c.t <> '' AND len(list_filter(f.kept, lambda x: x = c.t OR (length(c.t) <= 100 AND contains(x, c.t)))) = 0 AS fresh FROM f JOIN c ON c.request = f.request AND c.k = f.k + 1))
        SELECT request, (n - 1)::BIGINT AS place, id FROM f WHERE took""",
    ),
}


def sql_contexts(spark, d):
    """The same contexts by a table function in SQL: each request's candidates in order, within 1,800 tokens."""
    tables.register(spark)
    rows = candidates(spark, d).select("request", "id", "tokens")
    return spark.sql("SELECT request, id, place, tokens FROM context_within(TABLE({rows}) PARTITION BY (request) ORDER BY (id), 6, 1800)", rows=rows)


def sql_composed(spark, d):
    """The composer's six of each request's twenty first candidates by a table function in SQL."""
    tables.register(spark)
    rows = candidates(spark, d).drop("content", "tokens")
    return spark.sql("SELECT request, place, id, reason FROM composed_context(TABLE({rows}) PARTITION BY (request) ORDER BY (id))", rows=rows)


_REQUESTED = f"SELECT document_id // 5 AS request, id, len(regexp_extract_all(content, '{WORDS}')) AS tokens FROM {judging.PIECES}"
QUERIES["sql_contexts"] = (
    sql_contexts,
    f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY id) AS n FROM ({_REQUESTED})),
    f AS (SELECT DISTINCT request, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS taken, NULL::BIGINT AS id, 0::BIGINT AS tokens, false AS kept FROM c
      UNION ALL SELECT f.request, c.n, CASE WHEN {{fits}} THEN f.used + c.tokens ELSE f.used END, CASE WHEN {{fits}} THEN f.taken + 1 ELSE f.taken END, c.id, c.tokens, {{fits}} FROM f JOIN c ON c.request = f.request AND c.n = f.n + 1)
    SELECT request, id, taken - 1 AS place, tokens FROM f WHERE kept""".replace("{fits}", "(f.used + c.tokens <= 1800 AND f.taken < 6)"),
)
QUERIES["sql_composed"] = (sql_composed, None)
