"""Queries over tables: filters, joins, aggregates, windows, set comparisons, job states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval, tables


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filtered_documents(spark, d):
    rows = read(spark, d, "documents").filter(F.col("lang").isin("en", "fr") & (F.col("source") == "src1"))
    return rows.select("doc_id", "lang", "n_chars")


def customer_search(spark, d):
    c = read(spark, d, "customer")
    found = c.filter(F.lower("c_name").contains("7") & (F.col("c_acctbal") > 0) | F.col("c_mktsegment").ilike("%build%"))
    return found.select("c_custkey", "c_name", "c_mktsegment")


def customer_page(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.page(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 3, 20)


def order_statistics(spark, d):
    o = read(spark, d, "orders")
    start = F.lit("1996-06-01").cast("timestamp_ntz")
    return o.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if(F.col("o_orderstatus") != "O").alias("closed"),
        F.count_if(F.col("o_orderdate").cast("timestamp_ntz") >= start).alias("recent"),
    )


def monthly_orders(spark, d):
    o = read(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return o.groupBy("month").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("price"))


def conversation_counts(spark, d):
    """Turns of each conversation; those of the longest table side without any count 0."""
    turns = read(spark, d, "conversations")
    heads = turns.select("conv_id").distinct()
    users = turns.filter("role = 'user'")
    return heads.join(users, "conv_id", "left").groupBy("conv_id").agg(F.count("turn").alias("user_turns"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))


def recent_history(spark, d):
    """The newest ten turns of users and assistants within 2,000 characters, whole turns only, in order."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = read(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    kept = rows.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.filter("place <= 10 AND used <= 2000").select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


def editable_turns(spark, d):
    w = Window.partitionBy("conv_id")
    rows = read(spark, d, "conversations").withColumn("last_user", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w))
    return rows.filter("turn = last_user").select("conv_id", "turn")


def role_violations(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.bool_and(F.col("role").isin("user", "assistant")).alias("allowed"))


def near_turns(spark, d):
    rows = tables.adjacent(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 4)
    return rows.select("conv_id", "turn", F.size("near").cast("long").alias("near"), F.array_min("near").alias("first"), F.array_max("near").alias("last"))


def role_runs(spark, d):
    """Runs of turns of one role."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = tables.islands(read(spark, d, "conversations"), "conv_id", ["turn"], F.lag("role").over(w) == F.col("role"))
    return rows.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first"), F.count("*").alias("turns"))


def budgeted_turns(spark, d):
    rows = read(spark, d, "conversations").withColumn("n", F.char_length("text"))
    return retrieval.within_budget(rows, "conv_id", ["turn"], "n", 4000, 12).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


def part_facets(spark, d):
    return tables.facets(read(spark, d, "part"), ["p_brand", "p_type", "p_size"])


def merged_listing(spark, d):
    """The hundred newest of orders and shipments."""
    o = read(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("line"), F.col("o_orderdate").cast("date").alias("day"))
    s = read(spark, d, "lineitem").select(F.lit("shipment").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_shipdate").cast("date").alias("day"))
    return o.unionByName(s).orderBy(F.desc("day"), "kind", "id", "line").limit(100)


def oldest_jobs(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("waiting"))


def latest_jobs(spark, d):
    e = read(spark, d, "events")
    return tables.latest(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


def stale_jobs(spark, d):
    """Events half an hour or more older than the newest of their type, and their next state by attempts."""
    events = read(spark, d, "events")
    newest = events.groupBy("event_type").agg(F.max("ts").alias("now"))
    attempts = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    stale = events.withColumn("attempt", F.row_number().over(attempts)).join(newest, "event_type").filter(F.expr("ts <= now - INTERVAL 30 MINUTES"))
    return stale.groupBy("event_type", F.when(F.col("attempt") >= 2, "failed").otherwise("pending").alias("state")).agg(F.count("*").alias("n"))


def event_properties(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def hourly_activity(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def user_sessions(spark, d):
    """Sessions of a user: gaps of more than 30 minutes part them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events")
    rows = tables.islands(e, "user_id", ["ts", "event_id"], F.expr("ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES"))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def vector_states(spark, d):
    """Documents with and without a vector, and vectors without a document."""
    a = read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    b = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return tables.compare(a, b, "id")


def index_audit(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("there")), "doc_id", "left")
    n, done = F.count("*"), F.count("there")
    state = F.when(done == 0, "NOT_INDEXED").when(done < n, "PARTIAL").otherwise("READY")
    return rows.groupBy("source").agg(n.alias("n"), done.alias("indexed"), state.alias("state"))


def incremental_changes(spark, d):
    """What an index run would do with each chunk: new, unchanged or changed by the digest of its input; indexed are those with a vector."""
    now = read(spark, d, "documents").select("doc_id", "source", F.sha2(F.concat_ws(":", F.lit("v3"), F.lower("text")), 256).alias("digest"))
    was = read(spark, d, "documents").join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.sha2(F.concat_ws(":", F.lit("v3"), "text"), 256).alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("digest"), "unchanged").otherwise("changed")
    return now.join(was, "doc_id", "left").groupBy("source", state.alias("state")).agg(F.count("*").alias("n"))


def upserted_labels(spark, d):
    table = read(spark, d, "labels").select("doc_id", "quality")
    changes = read(spark, d, "documents").filter("n_chars > 2000").select("doc_id", F.lit(1).alias("quality"))
    return tables.upsert(table, changes, ["doc_id"])


def active_levels(spark, d):
    """Nations that have a customer and no supplier with a negative balance."""
    n = read(spark, d, "nation")
    with_customer = n.join(read(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    bad = read(spark, d, "supplier").filter("s_acctbal < 0")
    return with_customer.join(bad, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey", "n_name")


def star_join(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    li = li.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("r_name", "l_returnflag").agg(F.count("*").alias("lines"), F.round(F.sum(price), 2).alias("revenue"))


def nested_conversations(spark, d):
    c = read(spark, d, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["turn"].cast("string"), t["role"])), " ").alias("turns"))


def duration_checks(spark, d):
    """Orders whose lines' prices add up to the order's price within one per cent."""
    sums = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"))
    o = read(spark, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ok = F.coalesce(F.abs(F.col("s") - F.col("o_totalprice")) <= 0.01 * F.col("o_totalprice"), F.lit(False))
    return o.groupBy("o_orderstatus").agg(F.count_if(ok).alias("consistent"), F.count("*").alias("n"))


CONV = "conversations"
QUERIES = {
    "filtered_documents": (filtered_documents, "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1'"),
    "customer_search": (customer_search, "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE (c_name ILIKE '%7%' AND c_acctbal > 0) OR c_mktsegment ILIKE '%build%'"),
    "customer_page": (
        customer_page,
        "SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer) AS total, CAST(ceil((SELECT count(*) FROM customer) / 20.0) AS BIGINT) AS pages FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40",
    ),
    "order_statistics": (
        order_statistics,
        "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus <> 'O') AS closed, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-06-01') AS recent FROM orders",
    ),
    "monthly_orders": (
        monthly_orders,
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1",
    ),
    "conversation_counts": (
        conversation_counts,
        "SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
    ),
    "recent_history": (
        recent_history,
        "SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER w AS place, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE place <= 10 AND used <= 2000",
    ),
    "editable_turns": (editable_turns, "SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id"),
    "role_violations": (role_violations, "SELECT role, count(*) AS n, role IN ('user', 'assistant') AS allowed FROM conversations GROUP BY role"),
    "near_turns": (
        near_turns,
        "SELECT conv_id, turn, count(*) OVER w AS near, min(turn) OVER w AS first, max(turn) OVER w AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)",
    ),
    "role_runs": (
        role_runs,
        "SELECT conv_id, CAST(island AS BIGINT) AS island, role, min(turn) AS first, count(*) AS turns FROM (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM conversations)) GROUP BY ALL",
    ),
    "budgeted_turns": (
        budgeted_turns,
        "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE length(text) <= 2000) WHERE used <= 4000 AND place <= 12",
    ),
    "part_facets": (
        part_facets,
        "SELECT facet, value, count(*) AS n FROM (SELECT 'p_brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part) WHERE value IS NOT NULL GROUP BY ALL",
    ),
    "merged_listing": (
        merged_listing,
        "SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, 0::BIGINT AS line, o_orderdate::DATE AS day FROM orders UNION ALL SELECT 'shipment', l_orderkey, l_linenumber::BIGINT, l_shipdate::DATE FROM lineitem) ORDER BY day DESC, kind, id, line LIMIT 100",
    ),
    "oldest_jobs": (oldest_jobs, "SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS waiting FROM events GROUP BY event_type"),
    "latest_jobs": (latest_jobs, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "stale_jobs": (
        stale_jobs,
        "SELECT event_type, CASE WHEN attempt >= 2 THEN 'failed' ELSE 'pending' END AS state, count(*) AS n FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS latest, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events) WHERE ts <= latest - INTERVAL 30 MINUTE GROUP BY ALL",
    ),
    "event_properties": (event_properties, "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key"),
    "hourly_activity": (hourly_activity, "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"),
    "user_sessions": (
        user_sessions,
        "SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS events, min(event_id) AS first_event FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events)) GROUP BY ALL",
    ),
    "vector_states": (
        vector_states,
        "SELECT coalesce(doc_id, vec_id) AS id, CASE WHEN vec_id IS NULL THEN 'left_only' WHEN doc_id IS NULL THEN 'right_only' ELSE 'both' END AS state FROM (SELECT DISTINCT doc_id FROM documents) FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) ON doc_id = vec_id",
    ),
    "index_audit": (
        index_audit,
        "SELECT source, count(*) AS n, count(vec_id) AS indexed, CASE WHEN count(vec_id) = 0 THEN 'NOT_INDEXED' WHEN count(vec_id) < count(*) THEN 'PARTIAL' ELSE 'READY' END AS state FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source",
    ),
    "incremental_changes": (
        incremental_changes,
        "SELECT source, CASE WHEN vec_id IS NULL THEN 'new' WHEN sha256('v3:' || text) = sha256('v3:' || lower(text)) THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY ALL",
    ),
    "upserted_labels": (
        upserted_labels,
        "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 2000) UNION ALL SELECT doc_id, 1 FROM documents WHERE n_chars > 2000",
    ),
    "active_levels": (
        active_levels,
        "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    ),
    "star_join": (
        star_join,
        "SELECT r_name, l_returnflag, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    ),
    "nested_conversations": (nested_conversations, "SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id"),
    "duration_checks": (
        duration_checks,
        "SELECT o_orderstatus, count(*) FILTER (coalesce(abs(s - o_totalprice) <= 0.01 * o_totalprice, false)) AS consistent, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1",
    ),
}
