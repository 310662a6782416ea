"""Descriptor rows: headers, fragments, reasons, tables, replacement."""

from __future__ import annotations

import pytest

from lexiforge.operators import descriptors as D

CASES = [
    ("C2, Échelle X = Peut comprendre tout. C1; Échelle X = Peut suivre un long exposé . PRÉ-A1, Échelle Y = Peut saluer", None, [("C2", "Peut comprendre tout.", None), ("C1", "Peut suivre un long exposé.", None), ("PRE-A1", "Peut saluer", None)]),
    ("a1, 12 = Peut dire", None, [("A1", "Peut dire", "NUMERIC_OR_PUNCTUATION_SCALE")]),
    ("A1, traitement = Peut dire", None, [("A1", "Peut dire", "INCOMPLETE_SCALE_FRAGMENT")]),
    ("A1, Production orale, = Peut dire", None, [("A1", "Peut dire", "INCOMPLETE_SCALE_FRAGMENT")]),
    ("A1, Production (orale = Peut dire", None, [("A1", "Peut dire", "INCOMPLETE_SCALE_FRAGMENT")]),
    ("A1, Consulter l'annexe = Peut dire", None, [("A1", "Peut dire", "CONTAMINATED_SCALE")]),
    ("A1, Production. Orale = Peut dire", None, [("A1", "Peut dire", "CONTAMINATED_SCALE")]),
    ("A1, Production (ex. orale) = Peut dire", None, [("A1", "Peut dire", None)]),
    ("B2, Lecture =  ", None, [("B2", "", "TRUNCATED_DESCRIPTOR")]),
    ("B2, Lecture = pas de descripteur disponible ; voir B1+.", None, [("B2", None, "NO:B1+")]),
    ("B2, Lecture = Pas de descripteur disponible !", None, [("B2", None, "NO:")]),
    ("B2, Lecture = Peut lire., Texte suivi = encore", None, [("B2", "Peut lire., Texte suivi = encore", "EMBEDDED_SERIALIZED_CELL")]),
    ("B2, Lecture = Peut lire.. , Texte suivi", None, [("B2", "Peut lire.. , Texte suivi", "TAIL_CONTAMINATION")]),
    ("B2, Lecture = Les descripteurs de ce niveau", None, [("B2", "Les descripteurs de ce niveau", "NARRATIVE_FALSE_POSITIVE")]),
    ("B2, Lecture = Peut voir la version révisée ici", None, [("B2", "Peut voir la version révisée ici", "NARRATIVE_FALSE_POSITIVE")]),
    ("B2, Lecture = de manière simple", None, [("B2", "de manière simple", "AVAILABLE_LEADING_FRAGMENT")]),
    ("B2, Lecture = Peut lire (un texte", None, [("B2", "Peut lire (un texte", "TRUNCATED_DESCRIPTOR")]),
    ("B2, Lecture = exemple de texte", None, [("B2", "exemple de texte", "MID_SENTENCE_TRUNCATED")]),
    # fragments: an open bracket goes on until it is closed, a whole one doesn't
    ("B1, Lecture = Peut lire (des, B1, Lecture = de longs textes, B1, Lecture = et des lettres). B1, Lecture = et plus", None, [("B1", "Peut lire (des, de longs textes, et des lettres).", None), ("B1", "et plus", "AVAILABLE_LEADING_FRAGMENT")]),
    ("B1, Lecture = Peut lire, A1, Lecture = de longs textes", None, [("B1", "Peut lire,", "TRUNCATED_DESCRIPTOR"), ("A1", "de longs textes", "AVAILABLE_LEADING_FRAGMENT")]),
    ("B1, Lecture = Peut lire, B1, Lecture = Peut écrire.", None, [("B1", "Peut lire,", "TRUNCATED_DESCRIPTOR"), ("B1", "Peut écrire.", None)]),
    ("A1 | Peut répondre\n b2 | Pas de descripteur disponible\nA2 sans barre", "Lecture", [("A1", "Peut répondre", None), ("B2", None, "NO:")]),
    ("A1 | Peut répondre", "12", [("A1", "Peut répondre", "NUMERIC_OR_PUNCTUATION_SCALE")]),
    ("A1 | Peut répondre", None, [(None, None, "UNSUPPORTED_STRUCTURE")]),
    ("exemple sans niveau", "Lecture", [(None, None, "MID_SENTENCE_TRUNCATED")]),
    ("Un texte ordinaire, niveau A1.", None, []),
    ("XA1, Lecture = non", None, []),
    ("A1, Période = Peut dire", None, [("A1", "Peut dire", None)]),
    (None, "Lecture", []),
    ("", None, []),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(k, k // 10, t, s) for k, (t, s, _) in enumerate(CASES)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string, heading string")
    return D.parsed(chunks, default_scale="heading").join(chunks.select("chunk_id", "document_id"), "chunk_id").cache()


def test_rows(records):
    got = {}
    for r in records.orderBy("chunk_id", "place").collect():
        what = r.reason or (f"NO:{r.reference_level or ''}" if r.status == "NO_DESCRIPTOR_AVAILABLE" else None)
        got.setdefault(r.chunk_id, []).append((r.level, r.descriptor, what))
    for k, (text, _, want) in enumerate(CASES):
        assert got.get(k, []) == want, (text, got.get(k))
    assert [r.reconstructed for r in records.filter("chunk_id = 18").orderBy("place").collect()] == [True, False]


def test_replacement_leaves_no_orphans_and_changes_nothing_twice(spark, records):
    star = D.star(records)
    assert star["descriptors"].count() == star["descriptors"].select("descriptor_hash").distinct().count()
    of = records.select("chunk_id", "document_id").distinct()
    old = {**star, "sources": star["sources"].join(of, "chunk_id")}
    gone = spark.createDataFrame([(0,)], "document_id long")
    new = records.filter("chunk_id = 0 AND level = 'C2'").withColumn("document_id", records.document_id)
    rows = lambda t: {n: sorted((tuple(r[c] for c in sorted(f.columns)) for r in f.collect()), key=repr) for n, f in t.items()}
    once = D.replaced(old, new, gone)
    assert rows(D.replaced(once, new, gone)) == rows(once)
    assert {r.chunk_id for r in once["sources"].collect() if r.document_id == 0} == {0}
    held = {r.descriptor_hash for r in once["sources"].collect()}
    assert {r.descriptor_hash for r in once["descriptors"].collect()} == held
    assert {r.scale_key for r in once["scales"].collect()} == {r.scale_key for r in once["descriptors"].collect()}
    assert "échelle y" not in {r.scale_key for r in once["scales"].collect()}
