"""Queries over descriptor rows: documents cut at commas and line ends, each piece under a header of level and scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import descriptors as D
from ..sources.shared import spread

#: Scales of the headers, sound ones and others, three pieces each.
SCALES = ("Production orale", "Lecture", "12", "traitement", "Interaction (ex. orale)")
#: The scales that a skill needs.
SKILL_SCALES = (("speaking", "production orale"), ("speaking", "interaction orale"), ("reading", "lecture"), ("writing", "écriture"), ("listening", "compréhension orale"))


def chunks(spark, d):
    """(doc_id, source, text): chunks of descriptor rows."""
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text"))
    pieces = F.filter(F.transform(F.split(F.replace("text", F.lit(","), F.lit(",\n")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    of = lambda names, i: F.get(F.array(*map(F.lit, names)), (F.floor(i / 3) % len(names)).cast("int"))
    rows = F.transform(pieces, lambda x, i: F.concat(of(T.LEVELS, i), F.lit(", "), of(SCALES, i), F.lit(" = "), x))
    return docs.select("doc_id", "source", F.array_join(rows, " ").alias("text"))


def records(spark, d):
    return D.parsed(chunks(spark, d), "doc_id")


def descriptor_rows(spark, d):
    """Each document's rows with fragments joined: what is taken, and why others aren't."""
    return records(spark, d).select("doc_id", F.col("place").cast("long").alias("place"), "level", "scale", F.md5("descriptor").alias("digest"), "status", "reason", "reconstructed")


def descriptor_facts(spark, d):
    """Distinct descriptors with their first source and the number of sources."""
    return D.summary(records(spark, d), "doc_id")


def skill_scales(spark, d):
    """Scales that a request's skills need at a level, and those without a descriptor there."""
    n = descriptor_facts(spark, d).groupBy("level", F.col("scale_key").alias("scale")).agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([(level, skill, scale) for level in ("A1", "B1") for skill, scale in SKILL_SCALES], "level string, skill string, scale string")
    found = F.broadcast(asked).join(n, ["level", "scale"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.select("level", "skill", "scale", "n", (F.col("n") == 0).alias("missing"))


def import_counts(spark, d):
    """Of each source how many rows were found, taken, joined and refused, by reason."""
    rows = records(spark, d).join(chunks(spark, d).select("doc_id", "source"), "doc_id")
    return rows.groupBy("source", F.coalesce("reason", "status").alias("outcome")).agg(F.count("*").alias("n"), F.count_if("reconstructed").alias("joined"))


def orchestrated(spark, d):
    """What a request gets to know: descriptors of its level, documents of that level's share, and a warning for what is missing."""
    facts = descriptor_facts(spark, d).groupBy("level").agg(F.count("*").alias("descriptors"))
    level = F.get(F.array(*[F.lit(x) for x in ("A1", "B1", "B2", "C3")]), (F.col("doc_id") % 4).cast("int"))
    resources = spark.read.parquet(f"{d}/documents.parquet").groupBy(level.alias("level")).agg(F.count("*").alias("resources"))
    both = facts.join(resources, "level", "full_outer").select("level", F.coalesce("descriptors", F.lit(0)).alias("descriptors"), F.coalesce("resources", F.lit(0)).alias("resources"))
    return both.withColumn("warnings", F.concat_ws(",", F.when(F.col("descriptors") == 0, "NO_DESCRIPTORS"), F.when(F.col("resources") == 0, "NO_RESOURCES")))


def _rows() -> str:
    """The same rows without parsing: pieces are known, lists are folded, reasons are stated for another regex engine."""
    tidy = lambda c: f"regexp_replace(trim(regexp_replace(replace({c}, '|', ' '), '[\\p{{Z}}\\x09-\\x0D]+', ' ', 'g')), ' ([.!…])', '\\1', 'g')"
    names = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    count = lambda c, x: f"(length({c}) - length(replace({c}, '{x}', '')))"
    end = "(?:[^\\p{L}\\p{N}_]|$)"
    leading = lambda c: f"regexp_matches({c}, '^(?:[,;:)\\]]|(?:enregistr[ée]s?|de|du|des|ainsi\\s+que|et|ou|mais|avec|pour|dans|sur|à|au){end})')"
    open_ = lambda c: f"(regexp_matches({c}, '[,;:/\\-]$') OR {count(c, '(')} > {count(c, ')')} OR {count(c, '[')} > {count(c, ']')})"
    last, new = "a[len(a)]", "b[1]"
    joins = f"{last}.h = {new}.h AND {leading(new + '.value')} AND NOT {leading(last + '.value')} AND {open_(last + '.value')}"
    merged = f"{{'h': {last}.h, 'level': {last}.level, 'scale': {last}.scale, 'value': {tidy(f'{last}.value || chr(32) || {new}.value')}, 'joined': true}}"
    why = [
        ("scale = '12'", "NUMERIC_OR_PUNCTUATION_SCALE"), ("scale = 'traitement'", "INCOMPLETE_SCALE_FRAGMENT"), ("value = ''", "TRUNCATED_DESCRIPTOR"),
        ("regexp_matches(value, '(?s)(?:[.!…]\\s*)?,\\s*[A-ZÀ-ÖØ-Þ][^=\\n|]{2,180}\\s*=')", "EMBEDDED_SERIALIZED_CELL"), ("regexp_matches(value, '(?s)[.!…]{2,}\\s*,\\s*[A-ZÀ-ÖØ-Þ].{3,}$')", "TAIL_CONTAMINATION"),
        (f"regexp_matches(value, '(?i)^(?:(?:des|les)\\s+descripteurs|ce\\s+(?:niveau|tableau)){end}')", "NARRATIVE_FALSE_POSITIVE"), (leading("value"), "AVAILABLE_LEADING_FRAGMENT"), (open_("value"), "TRUNCATED_DESCRIPTOR"),
        (f"regexp_matches(value, '^(?:[,;:]|(?:exemple|information|ainsi|mais|et|ou|avec|pour|dans|sur){end})')", "MID_SENTENCE_TRUNCATED"),
    ]
    reason = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name in why) + " END"
    return f"""WITH p AS (SELECT doc_id, source, list_filter(list_transform(string_split(replace(text, ',', ',' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
    e AS (SELECT doc_id, source, list_transform(range(len(ps)), lambda i: [{{'h': (i // 3 % 6, i // 3 % 5), 'level': {names(T.LEVELS)}[i // 3 % 6 + 1], 'scale': {names(SCALES)}[i // 3 % 5 + 1], 'value': {tidy('ps[i + 1]')}, 'joined': false}}]) AS es FROM p WHERE len(ps) > 0),
    f AS (SELECT doc_id, source, list_reduce(es, lambda a, b: CASE WHEN {joins} THEN list_concat(a[1:len(a) - 1], [{merged}]) ELSE list_concat(a, b) END) AS rs FROM e),
    r AS (SELECT doc_id, source, unnest(range(len(rs))) AS place, unnest(rs, recursive := false) AS r FROM f),
    records AS (SELECT doc_id, source, place, level, scale, value, reason, CASE WHEN reason IS NULL THEN 'AVAILABLE' ELSE 'REJECTED' END AS status, joined FROM (SELECT *, {reason} AS reason FROM (SELECT doc_id, source, place, r.level AS level, r.scale AS scale, r.value AS value, r.joined AS joined FROM r)))"""


RECORDS = _rows()
FACTS = f"""{RECORDS}, facts AS (SELECT sha256(concat_ws(chr(31), level, lower(scale), lower(value), status, '')) AS descriptor_hash, level, lower(scale) AS scale_key, count(DISTINCT doc_id) AS sources, min(doc_id) AS first_source FROM records WHERE reason IS NULL GROUP BY ALL)"""
ASKED = ", ".join(f"('{level}', '{skill}', '{scale}')" for level in ("A1", "B1") for skill, scale in SKILL_SCALES)

QUERIES = {
    "descriptor_rows": (descriptor_rows, f"{RECORDS} SELECT doc_id, place, level, scale, md5(value) AS digest, status, reason, joined AS reconstructed FROM records"),
    "descriptor_facts": (descriptor_facts, f"{FACTS} SELECT * FROM facts"),
    "import_counts": (import_counts, f"{RECORDS} SELECT source, coalesce(reason, status) AS outcome, count(*) AS n, count(*) FILTER (joined) AS joined FROM records GROUP BY ALL"),
    "orchestrated": (
        orchestrated,
        f"""{FACTS} SELECT level, coalesce(descriptors, 0) AS descriptors, coalesce(resources, 0) AS resources, concat_ws(',', CASE WHEN descriptors IS NULL THEN 'NO_DESCRIPTORS' END, CASE WHEN resources IS NULL THEN 'NO_RESOURCES' END) AS warnings
        FROM (SELECT level, count(*) AS descriptors FROM facts GROUP BY level) FULL JOIN (SELECT ['A1', 'B1', 'B2', 'C3'][doc_id % 4 + 1] AS level, count(*) AS resources FROM documents GROUP BY 1) USING (level)""",
    ),
    "skill_scales": (
        skill_scales,
        f"{FACTS}, n AS (SELECT level, scale_key AS scale, count(*) AS n FROM facts GROUP BY ALL) SELECT s.level, skill, s.scale, coalesce(n, 0) AS n, n IS NULL AS missing FROM (VALUES {ASKED}) s(level, skill, scale) LEFT JOIN n ON n.level = s.level AND n.scale = s.scale",
    ),
}
