"""Descriptor rows ("B1, Scale name = text") in chunks of text, as records of level, scale and descriptor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import settled

#: Levels as they stand in a row, in any case; what is no part of the word before or after them.
LEVEL = r"(?:PR(?:E|É)[- ]?A1|A1|A2\+?|B1\+?|B2\+?|C1|C2)"
BEFORE, AFTER = r"(?<![\p{L}\p{N}_+\-])", r"(?![\p{L}\p{N}_+\-])"
#: A row's header, a row of a table, a level that looks like the start of a row.
HEADER = rf"(?iu){BEFORE}({LEVEL}){AFTER}\s*[,;]\s*([^\n=|]{{1,180}}?)\s*="
TABLE_ROW = rf"(?imu)^\s*({LEVEL}\s*\|\s*[^\n|].*?)\s*$"
SIGNAL = rf"(?iu){BEFORE}{LEVEL}{AFTER}\s*[,;|]"
#: No descriptor, with the level to look at instead.
NONE = rf"(?iu)^pas\s+de\s+descripteur\s+disponible\s*(?:[,;:]\s*voir\s+({LEVEL}))?\s*[.!…]*$"
#: What shows that a scale's name or a descriptor isn't whole, or isn't one.
TAIL = r"[,;:/\-]$"
CONTAMINATED = r"(?iu)(?:^|[^\p{L}\p{N}_])(?:annexe|consulter|page|section|chapitre|modifications?|a\s+été|a\s+ete)(?:[^\p{L}\p{N}_]|$)"
CELL = r"(?s)(?:[.!…]\s*)?,\s*[A-ZÀ-ÖØ-Þ][^=\n|]{2,180}\s*="
ORPHAN_TAIL = r"(?s)[.!…]{2,}\s*,\s*[A-ZÀ-ÖØ-Þ].{3,}$"
NARRATIVE = r"(?iu)^(?:(?:des|les)\s+descripteurs|ce\s+(?:niveau|tableau))(?:[^\p{L}\p{N}_]|$)"
EDITORIAL = (
    r"(?iu)(?:^|[^\p{L}\p{N}_])(?:plusieurs\s+modifications?|modifications?\s+(?:présentées?|apportées?|introduites?)|liste\s+de\s+l['’]annexe|consulter\s+l['’]annexe|"
    r"changements?\s+(?:dans|introduits?)|(?:cette|la)\s+(?:édition|annexe)|version\s+(?:précédente|révisée))(?:[^\p{L}\p{N}_]|$)"
)
#: What an ASCII text that EDITORIAL matches has one of.
EDITORIAL_STEMS = ("modification", "annexe", "changement", "version")
LEADING = r"^(?:[,;:)\]]|(?:enregistr[ée]s?|de|du|des|ainsi\s+que|et|ou|mais|avec|pour|dans|sur|à|au)(?:[^\p{L}\p{N}_]|$))"
MID_SENTENCE = r"^(?:[,;:]|(?:exemple|information|ainsi|mais|et|ou|avec|pour|dans|sur)(?:[^\p{L}\p{N}_]|$))"
SENTINEL = "\u0001"


def tidy(c: Column) -> Column:
    """Bars as blanks, collapsed, no blank before a full stop."""
    return F.regexp_replace(T.collapsed(F.replace(c, F.lit("|"), F.lit(" "))), r" ([.!…])", "$1")


def held(c: Column, x: str) -> Column:
    """How often a text has an ASCII character."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(x), F.lit("")))


def level_name(c: Column) -> Column:
    return F.translate(F.translate(F.upper(c), " ", "-"), "É", "E")


def is_leading(c: Column) -> Column:
    """Whether a text goes on with one that began before it."""
    return F.regexp(c, F.lit(LEADING))


def is_unfinished(c: Column) -> Column:
    return F.regexp(c, F.lit(TAIL)) | (held(c, "(") > held(c, ")")) | (held(c, "[") > held(c, "]"))


def fault_of_scale(scale: Column) -> Column:
    """The first reason why a scale's name is none, or null."""
    outside = F.regexp_replace(scale, r"\([^()]*\)", "")
    return (
        F.when(F.regexp_count(scale, F.lit(r"\p{L}")) == 0, "NUMERIC_OR_PUNCTUATION_SCALE")
        .when(F.regexp(scale, F.lit(TAIL)), "INCOMPLETE_SCALE_FRAGMENT")
        .when((F.char_length(scale) > 220) | F.regexp(scale, F.lit(CONTAMINATED)), "CONTAMINATED_SCALE")
        .when(held(scale, "(") != held(scale, ")"), "INCOMPLETE_SCALE_FRAGMENT")
        .when(F.regexp(outside, F.lit("[.!?]")) | (F.regexp(scale, F.lit("[,;|]")) & F.regexp(scale, F.lit(SIGNAL))), "CONTAMINATED_SCALE")
        .when(F.regexp(scale, F.lit(r"^[!-@\[-~]+$")), "INCOMPLETE_SCALE_FRAGMENT")
    )


def fault_of_text(value: Column) -> Column:
    """The first reason why a descriptor isn't taken, or null. What a pattern can't match without is looked for first."""
    has = lambda x: F.contains(value, F.lit(x))
    # in ASCII, lower case says what a pattern without regard to case may match
    low = F.lower(value)
    editorial = reduce(lambda a, x: a | F.contains(low, F.lit(x)), EDITORIAL_STEMS, ~T.is_ascii(value)) & F.regexp(value, F.lit(EDITORIAL))
    return (
        F.when(has("=") & F.regexp(value, F.lit(HEADER)), "EMBEDDED_NEXT_ROW_MARKER")
        .when(has("=") & has(",") & F.regexp(value, F.lit(CELL)), "EMBEDDED_SERIALIZED_CELL")
        .when(has(",") & F.regexp(value, F.lit(ORPHAN_TAIL)), "TAIL_CONTAMINATION")
        .when(F.regexp(value, F.lit(NARRATIVE)) | editorial, "NARRATIVE_FALSE_POSITIVE")
        .when(is_leading(value), "AVAILABLE_LEADING_FRAGMENT")
        .when(is_unfinished(value), "TRUNCATED_DESCRIPTOR")
        .when(F.regexp(value, F.lit(MID_SENTENCE)), "MID_SENTENCE_TRUNCATED")
    )


ROW = "struct<level: string, scale: string, value: string, headed: boolean>"


def reconstructed(rows: DataFrame) -> DataFrame:
    """Rows (key, place, level, scale, value, headed, lone) of chunks, where a row goes into the one before it that it goes on with.

    A run is a row and those right after it with its header and a beginning that continues something. Its rows
    go into its first one, unless that one itself continues something, as long as what they make is unfinished:
    it ends in the middle, or a bracket is open.
    """
    order = Window.partitionBy("key").orderBy("place")
    goes_on = F.col("headed") & (F.col("level") == F.lag("level").over(order)) & (F.col("scale") == F.lag("scale").over(order)) & is_leading(F.col("value"))
    count = lambda x: held(F.col("value"), x)
    marked = rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("leads", is_leading(F.col("value"))).withColumn("tail", F.regexp(F.col("value"), F.lit(TAIL)))
    marked = marked.withColumn("round", count("(") - count(")")).withColumn("square", count("[") - count("]"))
    runs = marked.withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order))
    within = Window.partitionBy("key", "run").orderBy("place")
    unfinished = F.col("tail") | (F.sum("round").over(within) > 0) | (F.sum("square").over(within) > 0)
    so_far = runs.withColumn("unfinished", unfinished).withColumn("first_leads", F.first("leads").over(within))
    whole = F.max(F.when(F.col("unfinished"), 0).otherwise(1)).over(within.rowsBetween(Window.unboundedPreceding, -1))
    joined = F.col("goes_on") & ~F.col("first_leads") & (F.coalesce(whole, F.lit(0)) == 0)
    placed = so_far.withColumn("joined", joined).withColumn("island", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order))
    first = lambda c: F.min_by(c, "place").alias(c)
    values = F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    made = placed.groupBy("key", "island").agg(first("level"), first("scale"), first("lone"), F.count("*").alias("n"), values.alias("values"))
    value = F.when(F.col("n") > 1, tidy(F.array_join("values", " "))).otherwise(F.get("values", F.lit(0)))
    return made.select("key", (F.col("island") - 1).cast("int").alias("place"), "level", "scale", value.alias("value"), (F.col("n") > 1).alias("joined"), "lone")


def parsed(chunks: DataFrame, key: str = "chunk_id", body: str = "text", default_scale: str | None = None) -> DataFrame:
    """(key, place, level, scale, descriptor, status, reference_level, reason, reconstructed): one row for each row found in a chunk.

    A row goes from its header to the next. A chunk without headers is read as a table of ``level | text`` under
    the scale in the column ``default_scale``, if that is given. ``status`` is AVAILABLE,
    NO_DESCRIPTOR_AVAILABLE (with the level that the text refers to), or REJECTED with the first ``reason``. A
    chunk with nothing but the look of a row is one REJECTED row; others without rows, null or empty have none.
    Keys are unique.
    """
    scale_of = F.col(default_scale) if default_scale else F.lit(None).cast("string")
    base = chunks.select(F.col(key).alias("key"), T.composed(F.col(body)).alias("t"), tidy(scale_of).alias("default"))
    marked = F.regexp_replace(F.col("t"), HEADER, SENTINEL + "$1" + SENTINEL + "$2" + SENTINEL)
    cut = base.withColumn("cut", F.split(marked, SENTINEL))
    row = lambda level, scale, value, headed: F.struct(level_name(level).alias("level"), scale.alias("scale"), value.alias("value"), F.lit(headed).alias("headed"))
    # three pieces a header, after the text before the first
    headed = F.transform(F.sequence(F.lit(1), F.size("cut") - 3, F.lit(3)), lambda i: row(F.get("cut", i), tidy(F.get("cut", i + 1)), tidy(F.get("cut", i + 2)), True))
    listed = F.transform(F.regexp_extract_all("t", F.lit(TABLE_ROW), 1), lambda r: row(F.trim(F.split(r, r"\|", 2)[0]), F.col("default"), tidy(F.split(r, r"\|", 2)[1]), False))
    rows = F.when(F.size("cut") > 3, headed).when(F.col("default").isNotNull(), listed)
    lone = F.when(F.col("default").isNotNull() & F.regexp(tidy(F.col("t")), F.lit(MID_SENTENCE)), "MID_SENTENCE_TRUNCATED").when(F.regexp("t", F.lit(SIGNAL)), "UNSUPPORTED_STRUCTURE")
    found = cut.withColumn("rows", rows).withColumn("lone", F.when(F.coalesce(F.size("rows"), F.lit(0)) <= 0, lone))
    each = found.select("key", "lone", F.posexplode_outer("rows").alias("place", "r")).filter("r IS NOT NULL OR lone IS NOT NULL")
    each = reconstructed(each.select("key", F.coalesce("place", F.lit(0)).alias("place"), "r.*", "lone"))
    each = settled(each, *each.columns)
    absent = F.coalesce(F.regexp(F.col("value"), F.lit(NONE)), F.lit(False))
    reason = F.coalesce("lone", fault_of_scale(F.col("scale")), F.when(F.col("value") == "", "TRUNCATED_DESCRIPTOR"), F.when(~absent, fault_of_text(F.col("value"))))
    referred = F.regexp_extract("value", NONE, 1)
    judged = each.withColumn("absent", absent).withColumn("reason", reason)
    judged, absent = settled(judged, *judged.columns), F.col("absent")
    return judged.select(
        F.col("key").alias(key), "place", "level", "scale", F.when(~absent, F.col("value")).alias("descriptor"),
        F.when(F.col("reason").isNotNull(), "REJECTED").when(absent, "NO_DESCRIPTOR_AVAILABLE").otherwise("AVAILABLE").alias("status"),
        F.when(absent & (referred != ""), level_name(referred)).alias("reference_level"), "reason", F.col("joined").alias("reconstructed"),
    )


def descriptor_hash() -> Column:
    """SHA-256 over level, scale, descriptor, status and reference, in lower case where case says nothing."""
    said = F.when(F.col("status") == "AVAILABLE", F.lower("descriptor")).otherwise(F.lit(""))
    return F.sha2(F.concat_ws("\u001f", "level", F.lower("scale"), said, "status", F.coalesce("reference_level", F.lit(""))), 256)


def star(records: DataFrame, key: str = "chunk_id") -> dict[str, DataFrame]:
    """Tables of scales, descriptors and their sources: equal descriptors once, the first chunk as first source."""
    kept = records.filter("status <> 'REJECTED'").withColumn("scale_key", F.lower("scale")).withColumn("descriptor_hash", descriptor_hash())
    first = Window.partitionBy("descriptor_hash").orderBy(key, "place")
    sources = kept.select("descriptor_hash", key).distinct().withColumn("source_order", F.row_number().over(Window.partitionBy("descriptor_hash").orderBy(key)))
    return {
        "scales": kept.groupBy("scale_key").agg(F.min("scale").alias("name")),
        "descriptors": kept.withColumn("n", F.row_number().over(first)).filter("n = 1").select("descriptor_hash", "level", "scale_key", "descriptor", "status", "reference_level"),
        "sources": sources,
    }


def summary(records: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(descriptor_hash, level, scale_key, sources, first_source): distinct descriptors with the number of chunks that have them and the first of these, in one pass."""
    kept = records.filter("status <> 'REJECTED'").select(descriptor_hash().alias("descriptor_hash"), "level", F.lower("scale").alias("scale_key"), key)
    # the hash is of level and scale too, so that these are equal within a group
    once = kept.groupBy("descriptor_hash", key).agg(F.first("level").alias("level"), F.first("scale_key").alias("scale_key"))
    return once.groupBy("descriptor_hash").agg(F.first("level").alias("level"), F.first("scale_key").alias("scale_key"), F.count("*").alias("sources"), F.min(key).alias("first_source"))


def replaced(old: dict[str, DataFrame], records: DataFrame, documents: DataFrame, document: str = "document_id", key: str = "chunk_id") -> dict[str, DataFrame]:
    """The tables of ``star`` after the records of some ``documents`` (document) have been replaced by ``records`` (with a column of the document).

    Sources of these documents go, those of ``records`` come; descriptors without any source go, and scales
    without any descriptor. ``old`` has a column of the document in its sources. Doing it again changes nothing.
    """
    new = star(records, key)
    of_document = records.select(key, document).distinct()
    kept_sources = old["sources"].join(documents.select(document).distinct(), document, "left_anti").drop("source_order")
    sources = kept_sources.unionByName(new["sources"].drop("source_order").join(of_document, key)).distinct()
    sources = sources.withColumn("source_order", F.row_number().over(Window.partitionBy("descriptor_hash").orderBy(key)))
    fresh = new["descriptors"].join(old["descriptors"].select("descriptor_hash"), "descriptor_hash", "left_anti")
    descriptors = old["descriptors"].unionByName(fresh).join(sources.select("descriptor_hash").distinct(), "descriptor_hash", "left_semi")
    more = new["scales"].join(old["scales"].select("scale_key"), "scale_key", "left_anti")
    scales = old["scales"].unionByName(more).join(descriptors.select("scale_key").distinct(), "scale_key", "left_semi")
    return {"scales": scales, "descriptors": descriptors, "sources": sources}
