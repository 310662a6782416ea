"""Rules, chunks and contexts on rows whose judgement is known."""

from __future__ import annotations

import random

import pytest

from lexiforge.functions import rules
from lexiforge.operators import chunking, composing

S = rules.Spark()


@pytest.fixture
def judged(spark):
    def run(rows, schema, steps, *columns):
        table = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
        return [tuple(r) for r in rules.applied(table, steps).orderBy("i").selectExpr(*columns).collect()]

    return run


def test_quality_of_text(judged):
    texts = [
        "Lis le texte puis réponds aux questions.", "اقرأ النص ثم أجب عن الأسئلة. Lis le texte puis réponds.", "كوّن جملاً باستعمال الصور. Make sentences using the pictures.",
        "Kw A,«aw «.3 34w... 33% ,3qm30... @990 JSA...", "c 3 gnaw, 'ml '43% m3 ¢", "", None, "good words with a broken \ufffd sign and the rest",
    ]
    got = judged(texts, "c string", rules.quality(S, "c"), "q_passed", "q_languages", "q_score", "q_reasons")
    assert [g[0] for g in got] == [True, True, True, False, False, False, False, False]
    assert [g[1] for g in got[:3]] == ["fr", "ar,fr", "ar,en"]
    assert got[3][3] and got[4][2] < 0.6 and "fr" not in got[4][1] and got[5][2] == got[6][2] == 0.0 and "replacement_characters" in got[7][3]


def test_trust_in_pages(judged):
    texts = ["Lis le texte puis réponds aux questions.", "alefisolated fathalow in a line of text", "c 3 gnaw, 'ml '43% m3 ¢", "a | b\n---|---\n1 | 2"]
    steps = [*rules.quality(S, "c"), *rules.native_level(S), *rules.table_cells(S, "c"), *rules.page_decision(S)]
    got = judged(texts, "c string", steps, "native", "decision", "cells")
    assert [g[:2] for g in got[:3]] == [("high_confidence", "high_confidence_native_text"), ("corrupted", "hard_corruption"), ("corrupted", "hard_corruption")] or got[2][0] == "corrupted"
    assert got[3][2] == 4 and got[3][1] == "borderline_but_structurally_usable_table"


def test_classes_of_chunks(judged):
    low = [".", "___________", "................", "1. ________", "□ □ □", "   "]
    valid = ["اقرأ", "Lis et réponds.", "نص عربي سليم"]
    bad = ["a8x@@@1qz//::x9kk...a7b@@@c3d//x5y", "alefisolated fathalow meemmedial arabicindicdigit"]
    rows = [(t, "text", 2) for t in low + valid + bad] + [("A1", "table", 1), ("https://example.org/x", "text", 9)]
    got = [g[0] for g in judged(rows, "c string, kind string, n int", rules.chunk_class(S, "c", "kind", "n"), "chunk_class")]
    assert got == ["low_information"] * 6 + ["valid_semantic"] * 3 + ["corrupted"] * 2 + ["valid_semantic", "low_information"]


def test_levels(judged):
    rows = [(" pre-a1 ", None, "x"), (None, "Niveau B1 — Vocabulaire", "x"), (None, None, "تمارين في المستوى أ2"), ("Z9", None, "rien"), ("c2", "Niveau A1", "x")]
    assert [g[0] for g in judged(rows, "l string, h string, c string", rules.explicit_level(S, "l", "h", "c"), "explicit_level")] == ["A1", "B1", "A2", None, "C2"]
    texts = ["Je suis ici maintenant. Tu es bien là.", "Selon vous, cet avis est juste ou faux ?", "trop court", "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze."]
    got = judged(texts, "c string", rules.estimated_level(S, "c"), "level_guess", "level_confidence")
    assert got == [("A1", 0.55), ("B2", 0.5), (None, 0.0), ("B1", 0.4)]


def test_roles_and_concreteness(judged):
    rows = [
        ("worksheet_exercise", None, "x"), ("text", None, "Enseignant : Bonjour."), ("text", "Guide pédagogique", "x"), ("table", None, "x"), ("text", None, "x"),
        ("text", None, "1) écoutez le texte"), ("text", None, "Consigne : lisez le texte."), ("text", None, "Questions ? Où ? Quand ?"),
    ]
    got = judged(rows, "k string, h string, c string", [*rules.role(S, "k", "h", "c"), *rules.concreteness(S, "k", "h", "c")], "role", "concrete_reason")
    assert [g[0] for g in got] == ["EXERCISE", "DIALOGUE", "METHODOLOGY", "REFERENCE", "OTHER", "OTHER", "TASK", "OTHER"]
    assert [g[1] for g in got] == ["canonical_worksheet_exercise", "dialogue_speaker_structure", None, None, None, "numbered_procedural_steps", "learner_instruction", "learner_question_set"]


def test_adjustments(judged):
    rows = [("activity", "A1", "A1", "reading", "Lecture", "x", "ACTIVITY", True), ("general", "B1", "A1", None, None, "x", "TASK", True), ("exercise", "A2", "A1", "speaking", None, "lecture et listening", "TASK", False), ("task", None, "A1", "reading", "Écoute", "x", "OTHER", False)]
    steps = [*rules.skill_evidence(S, "h", "c"), *rules.adjustments("intent", "level", "wl", "ws")]
    got = judged(rows, "intent string, level string, wl string, ws string, h string, c string, role string, concrete boolean", steps, "role_adjustment", "concrete_adjustment", "level_adjustment", "skill_adjustment")
    assert got == [(0.06, 0.03, 0.025, 0.02), (0.0, 0.0, -0.02, 0.0), (0.04, 0.0, -0.005, 0.0), (0.0, 0.0, 0.0, -0.01)]


def test_exercises(judged):
    rows = [
        ("Exercice 1 : Complète les phrases.\n1. Je ____ à l'école.\n2. Tu ____ content.", True, "fill_blank"), ("exercice exercice exercice", False, None), ("تمرين 4\n4", True, None),
        ("Choisis la bonne réponse\na) chat\nb) chien\nc) oiseau", True, "qcm"), ("Vrai ou faux\n1. Le ciel est bleu.\n2. La mer est rouge.", True, "true_false"), ("Relie les mots.\n1. a\n2. b", True, "matching"),
        ("Remets les mots en ordre\n1. a b\n2. c d", True, "ordering"), ("Ce manuel présente une démarche pédagogique.", False, None), ("السؤال\nالاختيارات:\n- بيت\n- كتاب", True, "qcm"), (None, False, None),
    ]
    got = judged([(None, t) for t, _, _ in rows], "h string, c string", rules.exercise(S, "h", "c"), "is_exercise", "exercise_type", "exercise_score", "exercise_confidence")
    for (text, yes, kind), g in zip(rows, got, strict=True):
        if text != "تمرين 4\n4":  # a title alone: 3 - 2
            assert g[0] == yes and (kind is None or g[1] == kind), (text, g)
    assert got[2][2] == 1 and not got[2][0]


def test_requests_for_exercises(judged):
    texts = ["exercices A1 de vocabulaire sur l'école", "Je cherche des exercices sur la famille", "تمارين في المستوى أ2 عن الأسرة", ""]
    got = judged(texts, "c string", rules.search_request(S, "c"), "asked_level", "asked_skills", "asked_theme")
    assert got == [("A1", "vocabulary", "école"), (None, "", "famille"), ("A2", "", "الأسرة"), (None, "", "")]


def test_chat_parameters(judged):
    texts = ["Propose-moi une activité orale A1 sur la famille.", "أجب بالعربية", "Please make a lesson at B2+", "hm"]
    got = judged(texts, "c string", rules.chat_parameters(S, "c"), "chat_level", "chat_skills", "chat_language", "chat_language_source")
    assert got == [("A1", "speaking", "fr", "message_detection"), (None, None, "ar", "explicit_message"), ("B2+", None, "en", "message_detection"), (None, None, None, None)]
    assert judged(["Une lecture A1 , svp ."], "c string", [], rules.without_signals(S, "c")) == [("Une, svp.",)]


def test_chunks(spark):
    r = random.Random(2)
    sentence = lambda n: " ".join(f"w{r.randrange(99)}" for _ in range(n)) + "."
    texts = [None, "", "short text", "\n\n".join(sentence(n) for n in (5, 9, 30, 4)), sentence(70), "a" * 500]
    for t in texts:
        parts = chunking.split(t, "text", "T", "H", 20)
        assert all(chunking.count(p) <= 20 - 6 for p in parts) and " ".join(" ".join(parts).split()) == " ".join((t or "").split())
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {k} | {'x ' * k}|" for k in range(12))
    parts = chunking.split(table, "table", None, None, 40)
    assert len(parts) > 2 and all(p.startswith("| a | b |\n|---|---|\n") for p in parts) and all(f"| {k} |" in "".join(parts) for k in range(12))
    with pytest.raises(ValueError):
        chunking.split("text", "text", "long title " * 20, None, 20)
    docs = spark.createDataFrame([(i, t, "text", "T", None) for i, t in enumerate(texts)], "i long, t string, k string, title string, h string")
    got = chunking.chunks(docs, "i", "t", "k", "title", "h", 20).collect()
    assert {x.i for x in got} == {2, 3, 4, 5} and all(x.tokens == chunking.count(x.content) for x in got)


def test_composer():
    c = lambda n, doc=None, category="supporting", heading=None, page=1: {"id": n, "document": doc or n, "page": page, "heading": heading, "category": category}
    three = [c(1), c(2, category="guidance"), c(3, category="concrete")]
    assert [k for k, _ in composing.compose(three, "concrete_activity")] == [2, 1, 0]
    one = [c(k, doc=1, heading=h) for k, h in enumerate("abcdb")] + [c(9, doc=2)]
    taken = [one[k] for k, _ in composing.compose(one, "general")]
    assert sum(t["document"] == 1 for t in taken) == 4 and sum(t["heading"] == "b" for t in taken) == 1 and any(t["document"] == 2 for t in taken)
    far = [c(k) for k in range(11)] + [c(50, category="concrete")]
    assert 11 in [k for k, _ in composing.compose(far, "task")] and len(composing.compose(far, "task")) == 6


def test_contexts_say_no_thing_twice():
    texts = ["Lesson Goals", "lesson  goals", "All of the lesson goals are here", "goals", None, "x" * 150, "y"]
    rows = [{"content": t, "tokens": 4} for t in texts]
    assert composing.unlike(rows) == [0, 2, 5, 6] or composing.unlike(rows) == [0, 2, 5]
    assert composing.budgeted([{"tokens": n} for n in (3, 9, 4, 1)], 2, 8) == [0, 2]


def test_store_guards_and_sets(spark):
    from lexiforge.plans import keeping

    names = {r.__name__ for r in keeping.ALL}
    assert len(names) == len(keeping.ALL) == len(keeping.QUERIES)


def test_quality_counts_odd_tokens_as_the_other_engine_does_and_once(spark):
    """Counts by one pass over the text equal those over lists of words; no list of words is filtered for them."""
    import duckdb

    texts = ["", "...", "a_1 b2c ..x-y.. ?é! x.", "Le le LE la a7b@@@c3d a@b.co+d@e.fr ___ -a- a.b. ؟نص؟ 3x3x", "x" * 500 + "!", "K Make make makE Texte l'été §§§§ a§b ..§.. .a..b"]
    names = [f"q_{x}" for x in ("n_words", "single", "meant", "suspicious", "chars", "latin", "digit_inside", "symbol_inside", "score", "reasons", "languages")]
    got = rules.applied(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), rules.quality(rules.Spark(), "text")).orderBy("i").select(*names).collect()
    with duckdb.connect() as c:
        c.execute("CREATE TABLE g (i BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO g VALUES (?, ?)", list(enumerate(texts)))
        want = c.sql(f"SELECT {', '.join(names)} FROM {rules.stated('g', rules.quality(rules.Duck(), 'text'))} ORDER BY i").fetchall()
    assert [tuple(r) for r in got] == want
    counts = [e for step in rules.quality(rules.Spark(), "text") for n, e in step.items() if n in ("q_single", "q_meant", "q_suspicious", "q_digit_inside", "q_symbol_inside")]
    assert len(counts) == 5 and not any("filter(" in e for e in counts)
