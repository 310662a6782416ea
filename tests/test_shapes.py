"""Model output as VARIANT."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import shapes as S


@pytest.fixture
def over(spark):
    def run(texts, expression):
        rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
        return [r[0] for r in rows.select("k", expression(F.col("t")).alias("x")).orderBy("k").select("x").collect()]

    return run


def test_envelopes(over):
    inner = {"exercises": [{"title": 'a "quoted" } {', "items": ["x"]}], "deep": {"a": {"b": {"c": [1, {"d": 2}]}}}}
    texts = [
        json.dumps(inner), "```json\n" + json.dumps(inner) + "\n```", "Voici {pas du json} puis " + json.dumps({"note": 1}) + " et " + json.dumps(inner) + " fin }",
        '{"exercises": "none"} then nothing', '{"exercises": [', None, "", "[1, 2]", json.dumps({"outer": inner}) + " x", json.dumps({"title": "no list"}),
    ]
    got = over(texts, lambda t: F.to_json(S.envelope(t, "exercises")))
    as_json = [None if g is None else json.loads(g) for g in got]
    assert as_json == [inner, inner, inner, None, None, None, None, None, None, {"title": "no list"}]


def test_items(over):
    texts = ['["a ", {"number": 2, "content": " b "}, {"text": "c"}, 5]', '"a; b"', "[]", '["", {"number": 1}]', "{}", None]
    got = over(texts, lambda t: S.items(F.try_parse_json(t), F.lit("do it")))
    alone = [(None, "do it")]
    assert [[tuple(x) for x in g] for g in got] == [[(None, "a"), ("2", "b"), (None, "c")], alone, alone, alone, alone, alone]


def sound(**change):
    answer = {
        "title": None, "pedagogical_summary": {"cefr_level": "A1", "output_language": "fr", "objective": None, "skills": ["reading"]},
        "content_sections": [{"section_type": "text", "heading": "h", "content": "c", "source_refs": [], "source_basis": None}], "cefr_refs": ["cefr:1"], "source_refs": [], "warnings": [],
        "cefr_claims": [{"ref": "r", "level": "A1", "scale": "s", "status": "x", "descriptor_text": None, "reference_level": None}],
    }
    answer.update(change)
    return json.dumps({k: v for k, v in answer.items() if v != "DROP"})


def test_closed_schema(over):
    section = {"section_type": "text", "content": "c", "source_refs": []}
    cases = [
        (sound(), None), ("```json\n" + sound() + "\n```", None), ("{", "invalid JSON"), ("[1]", "top-level value must be an object"), (sound(zeta=1, alpha=2), "unexpected top-level fields: alpha, zeta"),
        (sound(warnings="DROP", cefr_refs="DROP"), "missing required fields: cefr_refs, warnings"), (sound(pedagogical_summary=[]), "pedagogical_summary: must be an object"),
        (sound(pedagogical_summary={"cefr_level": 1, "output_language": "fr", "skills": []}), "pedagogical_summary: cefr_level and output_language are required strings"),
        (sound(pedagogical_summary={"cefr_level": "A1", "output_language": "fr", "skills": "x"}), "pedagogical_summary.skills: must be a list of strings"),
        (sound(pedagogical_summary={"cefr_level": "A1", "output_language": "fr", "skills": [], "more": 1}), "pedagogical_summary: unexpected fields"),
        (sound(content_sections={}), "content_sections: must be a list"), (sound(content_sections=[section, 3]), "content_sections[1]: invalid section object"),
        (sound(content_sections=[section, {**section, "source_basis": "web"}]), "content_sections[1]: source_basis must be cefr, resource, or null"),
        (sound(content_sections=[{**section, "content": 1}]), "content_sections[0]: section_type and content are required strings"), (sound(cefr_claims="x"), "cefr_claims: must be a list"),
        (sound(cefr_claims=[{"ref": "r"}]), "cefr_claims[0]: must contain exactly the CEFR fact fields"), (sound(title=5), "title: must be a string or null"), (sound(warnings=["a", 1]), "warnings: must be a list of strings"),
        (sound(cefr_claims="DROP", title="DROP"), None),
    ]
    assert over([t for t, _ in cases], lambda t: S.fault_of_answer(S.parsed(S.unfenced(t)))) == [w for _, w in cases]


def test_courses(over):
    objects = [
        {"duration": " 45 Minutes ", "vocabulary": "mot", "summary": "un\n deux ", "dialogue": "A: salut / B: bonjour\n", "grammar": ["règle", {"topic": "t", "explanation": "e", "example": "ex"}], "production": ["écris", {"title": "p", "instructions": "i"}]},
        {"duration": 30, "vocabulary": ["a", "b"], "summary": None, "dialogue": {"context": "c", "lines": "une"}, "content": [{"title": "t", "body": "b", "examples": ["x", {"body": "y"}, 3]}]},
        {"duration": "an hour", "dialogue": 5, "grammar": "no list", "summary": ["s"]},
    ]
    a, b, c = over([json.dumps(o) for o in objects], lambda t: S.course(F.try_parse_json(t)))
    assert (a.duration, a.vocabulary, a.summary, a.dialogue.context, a.dialogue.lines) == (45, ["mot"], ["un", "deux"], "", ["A: salut", "B: bonjour"])
    assert [tuple(g)[:2] for g in a.grammar] == [("", "règle"), ("t", "e")] and [tuple(x) for x in a.grammar[1].examples] == [("Exemple", "ex")]
    assert [tuple(p) for p in a.production] == [("écris", ""), ("p", "i")] and a.objectives is None
    assert (b.duration, b.vocabulary, b.summary, b.dialogue.lines) == (30, ["a", "b"], [], ["une"])
    assert [tuple(x) for x in b.content[0].examples] == [("Exemple", "x"), ("Exemple", "y")]
    assert c.duration is None and c.dialogue is None and c.grammar is None and c.summary == ["s"]
