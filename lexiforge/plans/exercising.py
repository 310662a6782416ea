"""Queries over exercise items that are made of the lines of documents: verdicts, copies in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exercises as X
from ..sources.shared import spread

TYPES = ("qcm", "true_false", "complete", "matching", "grammar_transformation", "ordering", "open_question", "other", "")


def documents(spark, d):
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source", "lang"))


def exercise_items(spark, d):
    """Each document as an item: its first line is the prompt (in reversed order of words for orderings), its second the answer, those after it the options."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = documents(spark, d).withColumn("lines", lines).withColumn("first", F.get("lines", F.lit(0))).withColumn("exercise_type", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % len(TYPES) + 1).cast("int")))
    own = F.when(F.col("doc_id") % 2 == 0, F.col("first")).otherwise(F.get("lines", F.lit(1)))
    return rows.select(
        "doc_id", F.element_at(F.array(*map(F.lit, ("A1", "b1", "Z9"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("level"), "exercise_type",
        F.when(F.col("exercise_type") == "ordering", F.array_join(F.reverse(F.split("first", " ")), " / ")).otherwise(F.col("first")).alias("prompt"),
        F.when(F.col("doc_id") % 5 > 0, own).alias("answer"), F.slice("lines", 2, 4).alias("options"), F.lit(None).cast("boolean").alias("is_true"), F.array("first").alias("left_right"),
        F.lit("A1").alias("request_level"), F.when(F.col("doc_id") % 7 == 0, "ar").otherwise(F.col("lang")).alias("language"),
    )


def item_verdicts(spark, d):
    """What speaks against each item."""
    return X.verdicts(exercise_items(spark, d)).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


def kept_items(spark, d):
    """Which documents of a source are kept, of those that begin alike, in order of their ids."""
    return X.kept_in_order(documents(spark, d), "source", "doc_id", "text")


FOLDED = r"trim(regexp_replace(replace(lower(strip_accents({})), 'ß', 'ss'), '[\p{{Z}}\x09-\x0D]+', ' ', 'g'))"
WORDS = r"list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2)"


def words(c: str, folded: bool = True) -> str:
    return WORDS.format(FOLDED.format(c) if folded else c)


def dice(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE 2 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END)"


def _verdicts() -> str:
    kinds = ", ".join(f"'{t.replace(chr(39), chr(39) * 2)}'" for t in TYPES)
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    mixed = lambda c: f"(len(regexp_extract_all({c}, '[\\x{{0600}}-\\x{{06FF}}]')) > 0 AND len(regexp_extract_all({c}, '[A-Za-z\\x{{00C0}}-\\x{{024E}}]')) > 0.15 * len(regexp_extract_all({c}, '[A-Za-z\\x{{00C0}}-\\x{{024E}}\\x{{0600}}-\\x{{06FE}}]')))"
    script = lambda c: f"regexp_matches({c}, '[\\x{{0600}}-\\x{{06FF}}]')"
    twins = f"len(list_filter(range(1, len(o) + 1), lambda i: len(list_filter(range(i + 1, len(o) + 1), lambda j: {dice('list_distinct(wo[i])', 'list_distinct(wo[j])')} >= 0.9)) > 0)) > 0"
    cases = [
        ("p = ''", quote(X.EMPTY_PROMPT)), ("level = 'Z9'", "'niveau invalide (Z9)'"), ("k = ''", quote(X.NO_TYPE)), ("level <> 'A1'", "'niveau (' || level || ') != demandé (A1)'"),
        (f"language = 'ar' AND length(p) >= 12 AND NOT {script('p')}", quote(X.NOT_ARABIC)), (f"language = 'ar' AND length(p) >= 12 AND {mixed('p')}", quote(X.MIXED)),
        (f"language = 'ar' AND len(list_filter(list_concat(raw, [f, a]), lambda x: coalesce({mixed('x')}, false))) > 0", quote(X.MIXED)),
        ("k = 'qcm' AND len(o) = 0", quote(X.NO_OPTIONS)), ("k = 'qcm' AND len(list_distinct(lo)) <> len(o)", quote(X.SAME_OPTIONS)),
        ("k = 'qcm' AND a <> '' AND len(o) > 0 AND NOT list_contains(lo, lower(a))", quote(X.ANSWER_MISSING)), (f"k = 'qcm' AND {twins}", quote(X.LIKE_OPTIONS)),
        ("k = 'true_false' AND a = ''", quote(X.NO_TRUTH)), ("k IN ('ordering', 'complete', 'matching', 'grammar_transformation') AND a = ''", quote(X.NO_ANSWER)),
        ("k = 'ordering' AND a <> '' AND len(wp) = 0", quote(X.NO_WORDS)), ("k = 'ordering' AND a <> '' AND len(wp) > 0 AND NOT list_has_all(wp, wa)", quote(X.WORD_MISSING)),
        ("k IN ('other', '') AND p = ''", quote(X.EMPTY_PROMPT)), ("na <> '' AND contains(np, na)", quote(X.COPIED)),
    ]
    return f"""WITH l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls, [{kinds}][doc_id % {len(TYPES)} + 1] AS k, ['A1', 'b1', 'Z9'][doc_id % 3 + 1] AS level, CASE WHEN doc_id % 7 = 0 THEN 'ar' ELSE lang END AS language FROM documents),
    i AS (SELECT doc_id, k, level, language, ls[1] AS f, trim(coalesce(CASE WHEN k = 'ordering' THEN array_to_string(list_reverse(string_split(ls[1], ' ')), ' / ') ELSE ls[1] END, '')) AS p,
      trim(coalesce(CASE WHEN doc_id % 5 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN ls[1] ELSE ls[2] END END, '')) AS a, ls[2:5] AS raw, list_transform(ls[2:5], lambda x: trim(x)) AS o FROM l),
    n AS (SELECT *, {FOLDED.format('p')} AS np, {FOLDED.format('a')} AS na, list_transform(o, lambda x: lower(x)) AS lo, list_transform(o, lambda x: {words('x')}) AS wo, {words('p')} AS wp, {words('a')} AS wa FROM i)
    SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {test} THEN {what} END' for test, what in cases)}], lambda x: x IS NOT NULL), '; ') AS reasons FROM n"""


def _kept() -> str:
    """Row after row, with the word lists of all that were kept so far."""
    return f"""WITH RECURSIVE s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, list_distinct({words(f"substr({FOLDED.format('text')}, 1, 180)", False)}) AS t FROM documents),
    f AS (SELECT source, doc_id, n, true AS kept, [t] AS seen FROM s WHERE n = 1
      UNION ALL SELECT s.source, s.doc_id, s.n, NOT {{like}} AS kept, CASE WHEN {{like}} THEN seen ELSE list_append(seen, s.t) END AS seen FROM f JOIN s ON s.source = f.source AND s.n = f.n + 1)
    SELECT source, doc_id, kept FROM f""".replace("{like}", f"(len(list_filter(seen, lambda x: len(x) > 0 AND len(s.t) > 0 AND {dice('x', 's.t')} >= 0.78)) > 0)")


QUERIES = {"item_verdicts": (item_verdicts, _verdicts()), "kept_items": (kept_items, _kept())}
