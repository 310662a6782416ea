"""Model output of any shape, as VARIANT: envelopes in noisy text, closed schemas, repair of fields that come as string, list or object.

Values are looked at by their type (``schema_of_variant``), so that braces and quotes within strings, escapes and
nesting of any depth are the parser's business and no pattern's.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder()


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null), a number's type, or null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def at(v: Column, key: str) -> Column:
    """The value of a key as VARIANT, or null."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def text_of(v: Column) -> Column:
    """The text of a string, or null for another value."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def list_of(v: Column) -> Column:
    """The elements of a list, or null for another value."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def keys_of(v: Column) -> Column:
    """The keys of an object in order, or null for another value."""
    return F.when(kind(v) == "OBJECT", F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))))


def objects_of(text: str | None) -> list[str]:
    """The decodable objects of a text that don't lie in one another, in order."""
    found, start = [], (text or "").find("{")
    while start >= 0:
        try:
            value, end = _DECODER.raw_decode(text, start)
        except (ValueError, RecursionError):
            start = text.find("{", start + 1)
            continue
        found.append(json.dumps(value, ensure_ascii=False))
        start = text.find("{", end)
    return found


def outer_objects(text: Column) -> Column:
    """``objects_of`` as an array of JSON texts."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(map(objects_of, texts.to_pylist()), pa.list_(pa.string()))

    return run(text)


def unfenced(text: Column) -> Column:
    """Without a Markdown fence around all of it."""
    bare = strip(text)
    return F.when(F.startswith(bare, F.lit("```")), strip(F.regexp_replace(bare, r"^```[a-zA-Z]*\s*|\s*```$", ""))).otherwise(bare)


def whole_of(text: str | None) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return None


def parsed(text: Column) -> Column:
    """The value that a text is as a whole, or null: Spark's own parser lets what follows a value pass."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(map(whole_of, texts.to_pylist()), pa.string())

    return F.try_parse_json(run(text))


def envelope(text: Column, key: str) -> Column:
    """The object that a text is, fenced or not; else the first outer object in it that has a list under ``key``; else null."""
    whole = parsed(unfenced(text))
    inside = F.transform(outer_objects(text), lambda o: F.try_parse_json(o))
    with_list = F.get(F.filter(inside, lambda o: F.coalesce(kind(at(o, key)) == "ARRAY", F.lit(False))), F.lit(0))
    return F.when(kind(whole) == "OBJECT", whole).otherwise(with_list)


def items(raw: Column, instruction: Column) -> Column:
    """array<struct<number, content>> of a list of strings and of objects with content or text; the instruction alone where that says nothing."""
    said = lambda v: F.nullif(strip(text_of(v)), F.lit(""))
    entry = lambda e: F.struct(
        F.when(kind(e) == "OBJECT", F.try_variant_get(e, "$.number", "string")).alias("number"),
        F.when(is_string(e), strip(text_of(e))).otherwise(F.coalesce(said(at(e, "content")), said(at(e, "text")), F.lit(""))).alias("content"),
    )
    read = F.transform(F.filter(list_of(raw), lambda e: is_string(e) | (kind(e) == "OBJECT")), entry)
    alone = F.array(F.struct(F.lit(None).cast("string").alias("number"), instruction.alias("content")))
    return F.when(F.exists(read, lambda x: x["content"] != ""), read).otherwise(alone)


#: The fields of a structured answer.
REQUIRED = ("pedagogical_summary", "content_sections", "cefr_refs", "source_refs", "warnings")
OPTIONAL = ("title", "cefr_claims")
SUMMARY = ("cefr_level", "output_language", "objective", "skills")
SECTION = ("section_type", "heading", "content", "source_refs", "source_basis")
CLAIM = ("ref", "level", "scale", "status", "descriptor_text", "reference_level")


def fault_of_answer(v: Column) -> Column:
    """The first fault of a structured answer (a parsed value, null where the text was none) under its closed schema, as "path: what"; null for a sound one."""
    other = lambda v, names: F.array_except(F.coalesce(keys_of(v), F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    lacking = lambda v, names: F.array_except(F.array(*map(F.lit, names)), F.coalesce(keys_of(v), F.array().cast("array<string>")))
    optional = lambda v: F.coalesce(kind(v).isin("STRING", "VOID"), F.lit(True))
    is_list = lambda v: F.coalesce(kind(v) == "ARRAY", F.lit(False))
    is_object = lambda v: F.coalesce(kind(v) == "OBJECT", F.lit(False))
    strings = lambda v: is_list(v) & ~F.coalesce(F.exists(list_of(v), lambda x: ~is_string(x)), F.lit(False))
    summary, sections, claims = at(v, "pedagogical_summary"), at(v, "content_sections"), at(v, "cefr_claims")
    basis = lambda s: F.coalesce(text_of(at(s, "source_basis")).isin("cefr", "resource"), F.coalesce(kind(at(s, "source_basis")) == "VOID", F.lit(True)))

    def fault_of_section(s: Column) -> Column:
        return (
            F.when(~is_object(s) | (F.size(other(s, SECTION)) > 0), "invalid section object")
            .when(~is_string(at(s, "section_type")) | ~is_string(at(s, "content")), "section_type and content are required strings")
            .when(~basis(s), "source_basis must be cefr, resource, or null")
            .when(~optional(at(s, "heading")), "heading must be a string or null")
            .when(~strings(at(s, "source_refs")), "source_refs must be a list of strings")
        )

    def fault_of_claim(c: Column) -> Column:
        return (
            F.when(~is_object(c) | (F.size(other(c, CLAIM)) > 0) | (F.size(lacking(c, CLAIM)) > 0), "must contain exactly the CEFR fact fields")
            .when(~is_string(at(c, "ref")) | ~is_string(at(c, "level")) | ~is_string(at(c, "scale")) | ~is_string(at(c, "status")), "ref, level, scale, and status must be strings")
            .when(~optional(at(c, "descriptor_text")), "descriptor_text must be a string or null")
            .when(~optional(at(c, "reference_level")), "reference_level must be a string or null")
        )

    def first_in(v: Column, fault, name: str) -> Column:
        found = F.get(F.filter(F.transform(list_of(v), lambda s, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]: "), fault(s))), lambda x: x.isNotNull()), F.lit(0))
        return found

    return F.coalesce(
        F.when(v.isNull(), "invalid JSON").when(~is_object(v), "top-level value must be an object"),
        F.when(F.size(other(v, (*REQUIRED, *OPTIONAL))) > 0, F.concat(F.lit("unexpected top-level fields: "), F.array_join(other(v, (*REQUIRED, *OPTIONAL)), ", "))),
        F.when(F.size(lacking(v, REQUIRED)) > 0, F.concat(F.lit("missing required fields: "), F.array_join(F.array_sort(lacking(v, REQUIRED)), ", "))),
        F.when(~is_object(summary), "pedagogical_summary: must be an object")
        .when(F.size(other(summary, SUMMARY)) > 0, "pedagogical_summary: unexpected fields")
        .when(~is_string(at(summary, "cefr_level")) | ~is_string(at(summary, "output_language")), "pedagogical_summary: cefr_level and output_language are required strings")
        .when(~optional(at(summary, "objective")), "pedagogical_summary.objective: must be a string or null")
        .when(~strings(at(summary, "skills")), "pedagogical_summary.skills: must be a list of strings")
        .when(~is_list(sections), "content_sections: must be a list"),
        first_in(sections, fault_of_section, "content_sections"),
        F.when(claims.isNotNull() & ~is_list(claims), "cefr_claims: must be a list"),
        first_in(claims, fault_of_claim, "cefr_claims"),
        F.when(~optional(at(v, "title")), "title: must be a string or null"),
        *[F.when(~strings(at(v, name)), f"{name}: must be a list of strings") for name in ("cefr_refs", "source_refs", "warnings")],
    )


def strings_of(v: Column) -> Column:
    """A string as a list of one, a list as its strings, null for nothing."""
    return F.when(is_string(v), F.array(text_of(v))).otherwise(F.transform(F.filter(list_of(v), is_string), text_of))


def examples_of(v: Column) -> Column:
    """array<struct<title, body>> of a string, of a list of strings and objects; none of another value."""
    pair = lambda title, body: F.struct(title.alias("title"), body.alias("body"))
    named = lambda e: pair(F.coalesce(text_of(at(e, "title")), F.lit("Exemple")), F.coalesce(text_of(at(e, "body")), text_of(at(e, "example")), F.lit("")))
    each = F.transform(F.filter(list_of(v), lambda e: is_string(e) | (kind(e) == "OBJECT")), lambda e: F.when(is_string(e), pair(F.lit("Exemple"), text_of(e))).otherwise(named(e)))
    empty = F.array().cast("array<struct<title: string, body: string>>")
    return F.coalesce(F.when(is_string(v), F.array(pair(F.lit("Exemple"), text_of(v)))).otherwise(each), empty)


def course(v: Column) -> Column:
    """A course's fields in one shape, whatever shape the object ``v`` gives them.

    ``duration`` is a number or "N minutes"; word lists are strings or lists; a summary is lines; a dialogue is
    lines (between line ends or " / ") or an object with context and lines; sections and exercises are strings or objects.
    """
    duration = F.try_variant_get(at(v, "duration"), "$", "int")
    minutes = F.regexp_extract(text_of(at(v, "duration")), r"(?i)^\s*(\d+)\s+minutes?\s*$", 1)
    summary = at(v, "summary")
    lines = F.transform(F.split(text_of(summary), r"\r\n|\n|\r"), strip)
    dialogue = at(v, "dialogue")
    spoken = F.filter(F.transform(F.split(text_of(dialogue), r"\n| / "), strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    given = F.coalesce(strings_of(at(dialogue, "lines")), none)
    sides = F.when(is_string(dialogue), F.struct(F.lit("").alias("context"), spoken.alias("lines"))).when(
        kind(dialogue) == "OBJECT", F.struct(F.coalesce(text_of(at(dialogue, "context")), F.lit("")).alias("context"), given.alias("lines"))
    )
    or_else = lambda e, a, b: F.coalesce(F.nullif(text_of(at(e, a)), F.lit("")), text_of(at(e, b)), F.lit(""))

    def sections(name: str, title: tuple, body: tuple, example: str) -> Column:
        as_string = lambda e: F.struct(F.lit("").alias("title"), text_of(e).alias("body"), examples_of(F.lit(None).cast("variant")).alias("examples"))
        as_object = lambda e: F.struct(or_else(e, *title).alias("title"), or_else(e, *body).alias("body"), examples_of(at(e, example)).alias("examples"))
        each = F.filter(list_of(at(v, name)), lambda e: is_string(e) | (kind(e) == "OBJECT"))
        return F.transform(each, lambda e: F.when(is_string(e), as_string(e)).otherwise(as_object(e)))

    def exercises(name: str) -> Column:
        each = F.filter(list_of(at(v, name)), lambda e: is_string(e) | (kind(e) == "OBJECT"))
        return F.transform(each, lambda e: F.when(is_string(e), F.struct(text_of(e).alias("title"), F.lit("").alias("instructions"))).otherwise(F.struct(or_else(e, "title", "title").alias("title"), or_else(e, "instructions", "instructions").alias("instructions"))))

    return F.struct(
        F.when(is_string(at(v, "duration")), F.nullif(minutes, F.lit("")).cast("int")).otherwise(duration).alias("duration"),
        *[strings_of(at(v, name)).alias(name) for name in ("vocabulary", "objectives", "skills", "expressions")],
        F.when(is_string(summary), lines).otherwise(F.coalesce(strings_of(summary), none)).alias("summary"),
        sides.alias("dialogue"),
        sections("grammar", ("topic", "title"), ("explanation", "body"), "example").alias("grammar"),
        sections("content", ("title", "title"), ("body", "body"), "examples").alias("content"),
        *[exercises(name).alias(name) for name in ("comprehension", "guided_practice", "communicative_practice", "production")],
    )
