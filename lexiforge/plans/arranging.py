"""Queries of the layout, check and context operators over rows of the given tables that stand for theirs."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, contexts, layout, tables
from ..sources import vectors
from ..sources.shared import shared_folder
from .judging import PIECES, pieces


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def page_lines(spark, d):
    """Boxes of a page (an order's lines) as lines of text."""
    boxes = read(spark, d, "lineitem").selectExpr("l_orderkey AS page", "CAST(l_linenumber * 9 + l_quantity % 7 AS DOUBLE) AS top", "CAST(l_partkey % 500 AS DOUBLE) AS l", "concat('w', l_suppkey) AS x")
    return layout.visual_lines(boxes, "page", "top", "l", "x")


def canonical_boxes(spark, d):
    """Boxes in canonical form, some of which count from the bottom."""
    c = F.col
    box = layout.canonical(c("p_partkey") % 300, c("p_partkey") % 700, c("p_partkey") * 7 % 300, c("p_partkey") * 3 % 700, c("p_size") % 2 == 0, F.lit(800).cast("long"))
    return read(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.l", "b.t", "b.r", "b.b", "b.area")


def box(key: str):
    return F.expr(f"named_struct('l', CAST({key} % 300 AS DOUBLE), 't', CAST({key} % 700 AS DOUBLE), 'r', CAST({key} % 300 + 50 AS DOUBLE), 'b', CAST({key} % 700 + 40 AS DOUBLE))")


def image_captions(spark, d):
    """Pictures of a page with the nearest text."""
    images = read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_size").alias("page"), box("p_partkey").alias("box"))
    texts = read(spark, d, "supplier").select((F.col("s_suppkey") % 50 + 1).cast("int").alias("page"), box("s_suppkey * 37").alias("box"), F.col("s_name").alias("text"))
    return layout.captions(images, texts, "page").select("image_id", "caption")


def page_sections(spark, d):
    """Sections of a file: a list, or a leading number, begins one."""
    rows = pieces(spark, d).withColumn("label", F.when(F.col("kind") == "list", "section_header").otherwise(F.col("kind")))
    return layout.sections(rows, "document_id", "chunk_index", "label", "content").select("id", "section")


def associated_images(spark, d):
    """Each file's first chunk as the text near a picture: the chunk that shares terms with it."""
    rows = pieces(spark, d).drop("page").withColumnRenamed("document_id", "page")
    images = rows.filter("chunk_index = 0").select(F.col("id").alias("image_id"), "page", F.col("content").alias("nearby_text"))
    chunks = rows.filter("chunk_index > 0").select(F.col("id").alias("chunk_id"), "page", F.col("content").alias("text"))
    return layout.associated(images, chunks, least=4)


def unknown_references(spark, d):
    """References of items to blocks beyond the thirty allowed ones."""
    items = read(spark, d, "benchmark").selectExpr("item_id", "array(concat('block:', item_id % 50 + 1), concat('block:', item_id % 7 + 25)) AS refs")
    return checks.unknown_references(items, checks.allowed_table(spark, "block", 30), "item_id", "refs")


def plan_faults(spark, d):
    """Faults of plans: an order and its lines as steps."""
    step = F.struct(F.col("l_linestatus").alias("phase"), F.col("l_quantity").cast("int").alias("minutes"), F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("materials"))
    steps = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(step).alias("steps"), F.sum(F.col("l_quantity").cast("long")).alias("total"))
    plans = read(spark, d, "orders").join(steps, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("minutes", F.when(F.col("o_orderkey") % 3 == 0, F.col("total")).otherwise(F.lit(60).cast("long")))
    return checks.plan_faults(plans).select("o_orderkey", F.array_join("faults", ",").alias("faults"))


def repeated_exercises(spark, d):
    """Parts that several of a supplier's five sections have."""
    rows = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 5).alias("section"), (F.col("l_partkey") % 50).alias("signature"))
    return checks.repeated_across(rows, "l_suppkey", "section", "signature")


def source_blocks(spark, d):
    """Runs of a file's chunks under one heading as blocks."""
    rows = pieces(spark, d).withColumn("query", F.col("document_id"))
    b = contexts.blocks(rows, "query", "document_id", "heading", "chunk_index", "content")
    return b.select("query", F.col("block").cast("long").alias("block"), "heading", F.md5("content").alias("digest"))


def neighbour_chunks(spark, d):
    """For the second and fourth chunk of a file the one before or after it under the same heading."""
    rows = pieces(spark, d).select("id", "document_id", "chunk_index", "heading")
    near = contexts.neighbours(rows.filter("chunk_index IN (1, 3)"), rows, "document_id", "chunk_index", "heading")
    return near.select("id", F.col("neighbour.id").alias("near_id"))


def first_contents(spark, d):
    """A file's chunks whose text no earlier one of it has, as a search's candidates."""
    return contexts.first_texts(pieces(spark, d), "document_id", ["chunk_index", "id"], "content").select("id")


def deleted_points(spark, d):
    """Documents left after those with a toxic label are deleted."""
    gone = read(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return tables.delete(read(spark, d, "documents").select("doc_id", "lang"), gone, ["doc_id"])


def owned_updates(spark, d):
    """Customers after changes of their segment, of which every second comes from another nation's user and is dropped."""
    table = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    changes = table.filter("c_custkey % 3 = 0").selectExpr("c_custkey", "c_nationkey + CAST(c_custkey % 2 AS INT) AS c_nationkey", "'CHANGED' AS c_mktsegment")
    return tables.owned(table, changes, "c_custkey", "c_nationkey")


def attached_vectors(spark, d):
    """Documents with their vector's first component, where there is one; vectors without a document make no row."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("v"))
    return tables.attached(read(spark, d, "documents").select("doc_id"), v, "doc_id", "v")


def appended_exchanges(spark, d):
    """Conversations with one more question and answer each, and those that begin with one."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    new = turns.groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr("conv_id + CASE WHEN conv_id % 4 = 0 THEN 1000000 ELSE 0 END AS conv_id", "concat('q', n) AS question", "concat('a', n) AS answer")
    return tables.appended(turns, new, "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def stored_vectors(spark, d):
    """The vectors as points of a store, every third one written again with another payload, read back from "v2" on."""
    vectors.register(spark)
    options = {"path": f"{urlparse(shared_folder(spark)).path}/{uuid.uuid4().hex}", "collection": "points"}
    points = read(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("payload"), "vec_id")
    for rows in (points, points.filter("vec_id % 3 = 0").withColumn("payload", F.lit("changed"))):
        rows.drop("vec_id").write.format("vector_store").mode("append").options(**options).save()
    found = spark.read.format("vector_store").options(**options).load().filter("id >= 'v2'")
    return found.select("id", "payload", F.size("vector").alias("width"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def folded_texts(spark, d):
    """Digests of texts without accents and case."""
    return read(spark, d, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("digest"))


TERMS = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*'), lambda t: length(t) >= 2))"
_BOX = "{0} % 300 AS {1}l, {0} % 700 AS {1}t, {0} % 300 + 50 AS {1}r, {0} % 700 + 40 AS {1}b"
NORMAL = r"lower(trim(regexp_replace(content, '[\p{Z}\x09-\x0D]+', ' ', 'g')))"

QUERIES = {
    "page_lines": (
        page_lines,
        """WITH RECURSIVE b AS (SELECT l_orderkey AS page, (l_linenumber * 9 + l_quantity % 7)::DOUBLE AS t, (l_partkey % 500)::DOUBLE AS l, 'w' || l_suppkey AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber * 9 + l_quantity % 7)::DOUBLE, (l_partkey % 500)::DOUBLE, 'w' || l_suppkey) AS r FROM lineitem),
        f AS (SELECT page, r, t AS head, 0 AS line, l, x FROM b WHERE r = 1 UNION ALL SELECT b.page, b.r, CASE WHEN b.t - f.head > 12 THEN b.t ELSE f.head END, CASE WHEN b.t - f.head > 12 THEN f.line + 1 ELSE f.line END, b.l, b.x FROM f JOIN b ON b.page = f.page AND b.r = f.r + 1)
        SELECT page, line::BIGINT AS line, string_agg(x, ' ' ORDER BY l, x) AS text FROM f GROUP BY page, line""",
    ),
    "canonical_boxes": (
        canonical_boxes,
        """SELECT p_partkey, l, CASE WHEN up THEN 800 - greatest(a, z) ELSE least(a, z) END AS t, r, CASE WHEN up THEN 800 - least(a, z) ELSE greatest(a, z) END AS b, (r - l) * abs(a - z) AS area
        FROM (SELECT p_partkey, p_size % 2 = 0 AS up, p_partkey % 700 AS a, p_partkey * 3 % 700 AS z, least(p_partkey % 300, p_partkey * 7 % 300) AS l, greatest(p_partkey % 300, p_partkey * 7 % 300) AS r FROM part)""",
    ),
    "image_captions": (
        image_captions,
        f"""WITH i AS (SELECT p_partkey AS image_id, p_size AS page, {_BOX.format('p_partkey', 'i')} FROM part), t AS (SELECT s_suppkey % 50 + 1 AS page, s_name AS text, {_BOX.format('s_suppkey * 37', 't')} FROM supplier),
        c AS (SELECT image_id, text, 2 * greatest(0, it - tb, tt - ib) + 0.35::DOUBLE * greatest(0, il - tr, tl - ir) AS cost FROM i JOIN t USING (page))
        SELECT image_id, caption FROM i LEFT JOIN (SELECT image_id, arg_min(text, (cost, text)) AS caption FROM c WHERE cost <= 120 GROUP BY image_id) USING (image_id)""",
    ),
    "page_sections": (page_sections, rf"SELECT id, sum(CASE WHEN kind = 'list' OR regexp_matches(content, '^\s*\d{{1,2}}[.)]\s') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY chunk_index)::BIGINT AS section FROM {PIECES}"),
    "associated_images": (
        associated_images,
        f"""WITH p AS (SELECT * FROM {PIECES}), i AS (SELECT id AS image_id, document_id AS page, unnest({TERMS.format('content')}) AS term FROM p WHERE chunk_index = 0), c AS (SELECT id AS chunk_id, document_id AS page, unnest({TERMS.format('content')}) AS term FROM p WHERE chunk_index > 0),
        s AS (SELECT image_id, chunk_id FROM i JOIN c USING (page, term) GROUP BY ALL HAVING count(*) >= 4), m AS (SELECT image_id, CASE WHEN count(*) = 1 THEN min(chunk_id) END AS matched FROM s GROUP BY image_id),
        a AS (SELECT document_id AS page, CASE WHEN count(*) = 1 THEN min(id) END AS alone FROM p WHERE chunk_index > 0 GROUP BY 1)
        SELECT p.id AS image_id, coalesce(matched, alone) AS chunk_id FROM p LEFT JOIN m ON m.image_id = p.id LEFT JOIN a ON a.page = p.document_id WHERE chunk_index = 0""",
    ),
    "unknown_references": (unknown_references, "SELECT DISTINCT item_id, 'block:' || n AS reference FROM (SELECT item_id, unnest([item_id % 50 + 1, item_id % 7 + 25]) AS n FROM benchmark) WHERE n > 30"),
    "plan_faults": (
        plan_faults,
        """SELECT o_orderkey, concat_ws(',', CASE WHEN n IS NULL THEN 'no_steps' END, CASE WHEN total <> CASE WHEN o_orderkey % 3 = 0 THEN total ELSE 60 END THEN 'duration_mismatch' END, CASE WHEN least_ <= 0 THEN 'empty_step' END, CASE WHEN phases < n THEN 'repeated_phase' END, CASE WHEN bare > 0 THEN 'no_materials' END) AS faults
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity::INT) AS total, min(l_quantity::INT) AS least_, count(DISTINCT l_linestatus) AS phases, count(*) FILTER (l_tax <= 0.02) AS bare FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    ),
    "repeated_exercises": (repeated_exercises, "SELECT l_suppkey, l_partkey % 50 AS signature, count(DISTINCT l_orderkey % 5) AS sections FROM lineitem GROUP BY ALL HAVING sections > 1"),
    "source_blocks": (
        source_blocks,
        f"""SELECT document_id AS query, block, heading, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, content)) AS digest FROM (SELECT *, sum(s) OVER (PARTITION BY document_id ORDER BY chunk_index)::BIGINT AS block
        FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(heading) OVER w IS NOT DISTINCT FROM heading THEN 0 ELSE 1 END AS s FROM {PIECES} WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index))) GROUP BY document_id, block, heading""",
    ),
    "neighbour_chunks": (
        neighbour_chunks,
        f"WITH p AS (SELECT * FROM {PIECES}) SELECT a.id, arg_min(b.id, b.chunk_index) AS near_id FROM p a JOIN p b ON b.document_id = a.document_id AND abs(b.chunk_index - a.chunk_index) = 1 AND b.heading IS NOT DISTINCT FROM a.heading WHERE a.chunk_index IN (1, 3) GROUP BY a.id",
    ),
    "first_contents": (first_contents, f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id, {NORMAL} ORDER BY chunk_index, id) AS place FROM {PIECES}) WHERE place = 1"),
    "deleted_points": (deleted_points, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "owned_updates": (owned_updates, "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "attached_vectors": (attached_vectors, "SELECT doc_id, round(embedding[1]::DOUBLE, 6) AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id"),
    "appended_exchanges": (
        appended_exchanges,
        """WITH n AS (SELECT conv_id, count(*) AS n, max(turn) AS final FROM conversations GROUP BY conv_id), e AS (SELECT conv_id + CASE WHEN conv_id % 4 = 0 THEN 1000000 ELSE 0 END AS conv_id, CASE WHEN conv_id % 4 = 0 THEN 0 ELSE final END AS final, n FROM n)
        SELECT conv_id, turn, role, md5(text) AS digest FROM conversations UNION ALL SELECT conv_id, final + 1, 'user', md5('q' || n) FROM e UNION ALL SELECT conv_id, final + 2, 'assistant', md5('a' || n) FROM e""",
    ),
    "folded_texts": (folded_texts, r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[\p{Z}\x09-\x0D]+', ' ', 'g'))) AS digest FROM documents"),
    "stored_vectors": (stored_vectors, "SELECT 'v' || vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'changed' ELSE coalesce(label::VARCHAR, 'none') END AS payload, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE 'v' || vec_id >= 'v2'"),
}
