"""Verdicts on exercise items, and what is kept in order."""

from __future__ import annotations

import random

from lexiforge.operators import exercises as X

from .test_operators import written

ITEM = "id long, level string, exercise_type string, prompt string, answer string, options array<string>, is_true boolean, left_right array<string>, request_level string, language string"


def test_verdicts(spark):
    rows = [
        ("A1", "ordering", "école / vais / à / je / l", "Je vais à l'école", None, None, None, "fr", []),
        ("A1", "ordering", "ecole / vais", "Je vais à l'école", None, None, None, "fr", [X.WORD_MISSING]),
        ("A1", "ordering", "/ /", "Je vais", None, None, None, "fr", [X.NO_WORDS]),
        ("A1", "ordering", "a b c", None, None, None, None, "fr", [X.NO_ANSWER]),
        ("A1", "qcm", "Choisis", "Chat", ["chat", "chien"], None, None, "fr", []),
        ("A1", "qcm", "Choisis", "lion", ["chat", "Chat", ""], None, None, "fr", [X.SAME_OPTIONS, X.ANSWER_MISSING, X.LIKE_OPTIONS]),
        ("A1", "QCM", "Choisis", "", [], None, None, "fr", [X.NO_OPTIONS]),
        ("A1", "true_false", "Le ciel est bleu", None, None, None, None, "fr", [X.NO_TRUTH]),
        ("A1", "true_false", "Le ciel est bleu", None, None, False, None, "fr", []),
        ("Z9", "writing", " ", None, None, None, None, "fr", [X.EMPTY_PROMPT, X.BAD_LEVEL % "Z9", X.OTHER_LEVEL % ("Z9", "A1")]),
        ("b1", "writing", "Écris", None, None, None, None, "fr", [X.OTHER_LEVEL % ("b1", "A1")]),
        (None, "", "Écris", None, None, None, None, "fr", [X.NO_TYPE]),
        (None, "dance", None, None, None, None, None, None, [X.EMPTY_PROMPT, X.EMPTY_PROMPT]),
        ("A1", "complete", "Complète : je suis ÉLÈVE", "eleve", None, None, None, "fr", [X.COPIED]),
        ("A1", "writing", "Écris une lettre à un ami", None, None, None, None, "ar", [X.NOT_ARABIC]),
        ("A1", "writing", "أريد أن partir إلى المدرسة", None, ["bonjour سلام"], None, None, "ar", [X.MIXED, X.MIXED]),
        ("A1", "writing", "أريد أن أذهب إلى المدرسة", None, None, None, ["بيت", "maison بيت"], "ar", [X.MIXED]),
    ]
    made = spark.createDataFrame([(k, lv, t, p, a, o, y, lr, "A1", lang) for k, (lv, t, p, a, o, y, lr, lang, _) in enumerate(rows)], ITEM)
    got = {r.id: r.reasons for r in X.verdicts(made).collect()}
    for k, row in enumerate(rows):
        assert got[k] == row[-1], (row, got[k])


def in_turn(rows, least=0.78):
    seen, kept = {}, {}
    for g, o, text in sorted(rows, key=lambda r: (r[0], r[1])):
        words = {w for w in (text or "").lower()[:180].split() if len(w) > 1}
        like = any(words and s and 2 * len(words & s) / (len(words) + len(s)) >= least for s in seen.setdefault(g, []))
        kept[g, o] = not like
        if not like:
            seen[g].append(words)
    return kept


def test_kept_equals_the_rule_in_turn(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(24)]
    rows = []
    for g in range(3):
        text = r.sample(words, 9)
        for o in range(150):
            if r.random() < 0.7:
                text = list(text)
                text[r.randrange(len(text))] = r.choice(words)  # chains: each is like the one before, not like the first
            else:
                text = r.sample(words, r.randrange(1, 12))
            rows.append((g, o, " ".join(text)))
        rows += [(g, 200 + k, t) for k, t in enumerate((None, "", "a b", "Same words here", "here SAME words", "same words hére"))]
    got = {(x.g, x.o): x.kept for x in X.kept_in_order(spark.createDataFrame(rows, "g long, o long, body string"), "g", "o", "body").collect()}
    want = in_turn([(g, o, (t or "").replace("é", "e")) for g, o, t in rows])
    assert got == want and 50 < sum(got.values()) < 400


def test_copies_are_one_class(spark):
    rows = [(1, k, "the same seven words of one prompt") for k in range(5000)]
    made = X.kept_in_order(spark.createDataFrame(rows, "g long, o long, body string"), "g", "o", "body")
    assert [r.o for r in made.filter("kept").collect()] == [0]
    assert X.kept_in_order(made.limit(0).withColumnRenamed("kept", "body").selectExpr("g", "o", "string(body) AS body"), "g", "o", "body").count() == 0


def test_kept_without_pairs_equals_the_rule_in_turn(spark, monkeypatch):
    """Candidates that only share rare words aren't written, and with too many links each class keeps its least one."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.sample(words, 25)) for _ in range(1_000)]
    texts += [" ".join(w if r.random() < 0.8 else r.choice(words) for w in words[:25]) for _ in range(60)]
    rows = [(k % 2, k, t) for k, t in enumerate(texts)]
    table, got = spark.createDataFrame(rows, "g long, o long, body string"), {}
    keep = lambda: {(x.g, x.o): x.kept for x in X.kept_in_order(table, "g", "o", "body").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = written(spark, lambda: got.update(keep()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = in_turn(rows)
    assert got == want and 950 < sum(want.values()) < 1_050
    # before: the words of some 250,000 pairs
    assert n < 3_000_000, n
    monkeypatch.setattr(X, "PAIRS", 0)
    monkeypatch.setattr(X, "TILE", 50)
    assert keep() == want
