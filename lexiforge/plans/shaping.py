"""Queries over answers of models: the turns of conversations, wrapped by rule in objects of many shapes.

A turn's number says which shape its answer has; its text goes into the object as JSON, whatever quotes, braces
and line ends it holds. The SQL says what must come out of each shape; it parses no JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes as V

EXTRA = 'b {x} "y"'
MORE = 'é " } {'


def turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def js(c):
    """A text as a JSON string."""
    whole = F.to_json(F.struct(c.alias("x")))
    return F.substring(whole, F.lit(6), F.char_length(whole) - 6)


def pick(number, shapes: list):
    """The shape of a number, modulo their count."""
    chosen = F.lit(None).cast("string")
    for k, shape in reversed(list(enumerate(shapes))):
        chosen = F.when(number % len(shapes) == k, shape).otherwise(chosen)
    return chosen


def envelopes(spark, d):
    """The exercise envelope of each answer, fenced, bare or in prose: its state, its first exercise's title and items."""
    t, role = js(F.col("text")), js(F.col("role"))
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    answer = pick(F.col("conv_id") + F.col("turn"), [
        c('```json\n{"exercises":[{"title":', role, ',"items":[', t, ",", js(F.lit(EXTRA)), "]}]}\n```"),
        c('Voici {pas du json} : {"note": {"exercises": "x"}} puis {"exercises":[{"title":', role, ',"items":[{"number":1,"content":', t, '},{"number":2,"text":', js(F.lit(MORE)), "}]}]} merci }"),
        c('{"exercises":[{"title":', role, ',"instruction":', t, ',"items":"a; b"}]}'),
        c('{"exercises":[{"instruction":', t, ',"items":["",{"number":3}]}]}'),
        c('{"exercises": [{"title": ', t),
        c('{"title":', t, "}"),
        F.col("text"),
    ])
    rows = turns(spark, d).withColumn("answer", answer).withColumn("envelope", V.envelope(F.col("answer"), "exercises"))
    first = rows.withColumn("list", V.list_of(V.at(F.col("envelope"), "exercises"))).withColumn("first", F.get("list", F.lit(0)))
    read = first.withColumn("items", V.items(V.at(F.col("first"), "items"), F.coalesce(V.text_of(V.at(F.col("first"), "instruction")), F.lit(""))))
    state = F.when(F.col("envelope").isNull(), "no_json").when(F.col("list").isNull(), "no_list").otherwise("complete")
    lines = F.array_join(F.transform("items", lambda x: F.concat(F.coalesce(x["number"], F.lit("-")), F.lit(":"), x["content"])), "|")
    done = F.col("list").isNotNull()
    return read.select("conv_id", "turn", state.alias("state"), F.when(done, F.coalesce(V.text_of(V.at(F.col("first"), "title")), F.lit(""))).alias("title"), F.when(done, lines).alias("items"))


STRIPPED = r"regexp_replace({}, '^[\p{{Z}}\x09-\x0D]+|[\p{{Z}}\x09-\x0D]+$', '', 'g')"
ENVELOPES = f"""SELECT conv_id, turn, CASE WHEN k IN (4, 6) THEN 'no_json' WHEN k = 5 THEN 'no_list' ELSE 'complete' END AS state, CASE WHEN k <= 2 THEN role WHEN k = 3 THEN '' END AS title,
 CASE k WHEN 0 THEN '-:' || {STRIPPED.format('t')} || '|-:{EXTRA}' WHEN 1 THEN '1:' || {STRIPPED.format('t')} || '|2:{MORE}' WHEN 2 THEN '-:' || t WHEN 3 THEN '-:' || t END AS items
 FROM (SELECT conv_id, turn, role, coalesce(text, '') AS t, (conv_id + turn) % 7 AS k FROM conversations)"""

#: (what the object has more in its section, its warnings, what it has more itself, the fault)
ANSWERS = [
    ("", "[]", "", None),
    ("", "[]", ',"zeta":1,"alpha":2', "unexpected top-level fields: alpha, zeta"),
    ("", '["a",1]', "", "warnings: must be a list of strings"),
    (',"source_basis":"web"', "[]", "", "content_sections[0]: source_basis must be cefr, resource, or null"),
    ("", "[]", ',"title":{"a":1}', "title: must be a string or null"),
    ("", "[]", ',"cefr_claims":[{"ref":"r"}]', "cefr_claims[0]: must contain exactly the CEFR fact fields"),
    ("", "[", "", "invalid JSON"),
]


def closed_schema(spark, d):
    """The first fault of each structured answer under its closed schema."""
    shape = lambda section, warnings, more: F.concat(
        F.lit('{"pedagogical_summary":{"cefr_level":"A1","output_language":"fr","skills":["reading"]},"content_sections":[{"section_type":"text","content":'),
        js(F.col("text")), F.lit(f',"source_refs":[]{section}}}],"cefr_refs":[],"source_refs":["resource:1"],"warnings":{warnings}{more}}}'),
    )
    answer = pick(F.col("conv_id") * 3 + F.col("turn"), [shape(*a[:3]) for a in ANSWERS])
    rows = turns(spark, d).withColumn("v", V.parsed(V.unfenced(answer)))
    return rows.select("conv_id", "turn", V.fault_of_answer(F.col("v")).alias("fault"))


CLOSED = f"SELECT conv_id, turn, CASE (conv_id * 3 + turn) % {len(ANSWERS)} {' '.join(f'WHEN {k} THEN {chr(39)}{a[3]}{chr(39)}' for k, a in enumerate(ANSWERS) if a[3])} END AS fault FROM conversations"


def repaired_courses(spark, d):
    """Fields of courses in one shape, from numbers and phrases, strings and lists, lines and objects."""
    t, role = js(F.col("text")), js(F.col("role"))
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    answer = pick(F.col("conv_id") + 2 * F.col("turn"), [
        c('{"duration":"45 minutes","vocabulary":', role, ',"summary":', t, ',"dialogue":"A: oui / B: non","content":[', t, "]}"),
        c('{"duration":30,"vocabulary":["a","b"],"summary":["x"],"dialogue":{"context":"c","lines":["u","v"]},"content":[{"title":', role, ',"body":', t, ',"examples":"e"},"s"]}'),
        c('{"duration":"an hour","summary":null,"dialogue":5,"content":"x"}'),
        c('{"duration":" 7 Minute ","vocabulary":[1,"z"],"summary":', t, ',"dialogue":{"lines":"one"},"content":[]}'),
    ])
    rows = turns(spark, d).withColumn("v", F.try_parse_json(answer)).withColumn("course", V.course(F.col("v")))
    return rows.select(
        "conv_id", "turn", "course.duration", F.array_join("course.vocabulary", "|").alias("vocabulary"), F.size("course.summary").cast("long").alias("lines"), F.md5(F.array_join("course.summary", "|")).alias("summary"),
        F.col("course.dialogue.context").alias("context"), F.array_join("course.dialogue.lines", "|").alias("dialogue"), F.array_join(F.transform("course.content", lambda s: F.concat(s["title"], F.lit(":"), F.md5(s["body"]), F.lit(":"), F.size(s["examples"]).cast("string"))), "|").alias("content"),
    )


REPAIRED = f"""SELECT conv_id, turn, CASE k WHEN 0 THEN 45 WHEN 1 THEN 30 WHEN 3 THEN 7 END::INT AS duration, CASE k WHEN 0 THEN role WHEN 1 THEN 'a|b' WHEN 3 THEN 'z' END AS vocabulary,
 CASE k WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE len(ls) END AS lines, md5(CASE k WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE array_to_string(ls, '|') END) AS summary, CASE k WHEN 0 THEN '' WHEN 1 THEN 'c' WHEN 3 THEN '' END AS context,
 CASE k WHEN 0 THEN 'A: oui|B: non' WHEN 1 THEN 'u|v' WHEN 3 THEN 'one' END AS dialogue, CASE k WHEN 0 THEN ':' || md5(t) || ':0' WHEN 1 THEN role || ':' || md5(t) || ':1|:' || md5('s') || ':0' WHEN 3 THEN '' END AS content
 FROM (SELECT *, list_transform(regexp_split_to_array(t, '\\r\\n|\\n|\\r'), lambda x: {STRIPPED.format('x')}) AS ls FROM (SELECT conv_id, turn, role, coalesce(text, '') AS t, (conv_id + 2 * turn) % 4 AS k FROM conversations))"""

QUERIES = {"envelopes": (envelopes, ENVELOPES), "closed_schema": (closed_schema, CLOSED), "repaired_courses": (repaired_courses, REPAIRED)}
