"""Operators 6 and 8."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import regex

from lexiforge.llm import decontamination, substring_dedup


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**5)}" for _ in range(n))


def test_chunks_resist_insertions():
    text = prose(1, 2000).encode()
    moved = b"inserted words " + text
    cut = lambda t: substring_dedup.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    a, b = cut(text), cut(moved) - 15
    assert len(set(a) - set(b)) <= 4
    two = substring_dedup.chunk_ends(np.frombuffer(moved + text, np.uint8), np.array([0, len(moved), len(moved) + len(text)]))
    assert set(two - len(moved)) >= set(a)


def test_repeated_passages_go_but_for_the_first(spark, docs):
    passage = prose(2, 60)
    rows = [(3, f"{prose(3, 80)} {passage} {prose(4, 80)}"), (1, f"{prose(5, 90)} {passage} {prose(6, 50)}"), (2, prose(7, 300)), (4, None), (5, ""), (None, passage)]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(docs(rows)).collect()}
    assert got[1] == rows[1][1] and got[2] == rows[2][1] and got[4] is None and got[5] == "" and got[None] == passage
    gone = len(rows[0][1]) - len(got[3])
    assert len(passage) * 0.6 < gone <= len(passage) + 2
    assert got[3].startswith(prose(3, 80)[:300]) and got[3].endswith(prose(4, 80)[-300:])


def cut_at(text):
    raw = text.encode()
    ends = substring_dedup.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [(int(a), int(b)) for a, b in zip([0, *ends], ends, strict=False)]


def brute_passages(rows, least=80):
    """Passages by the rule, one chunk after another: (doc, start, end, first) of later ones, and the first documents' spans."""
    first, has = {}, {}
    texts = sorted({(i, t) for i, t in rows if i is not None and t})
    for i, t in texts:
        times = Counter()
        for a, b in cut_at(t):
            c = t.encode()[a:b]
            key = (c, times[c])
            times[c] += 1
            first.setdefault(key, (i, t, a))
            has.setdefault(key, set()).add(i)
    later, likes = set(), {}
    for i, t in texts:
        times, run = Counter(), []

        def end(run=run, i=i):
            if run and run[-1][1] - run[0][0] >= least:
                later.add((i, run[0][0], run[-1][1], run[0][2][0]))
                likes.setdefault(run[0][2][:2], set()).add((run[0][2][2], run[0][2][2] + run[-1][1] - run[0][0]))
            run.clear()

        for a, b in cut_at(t):
            c = t.encode()[a:b]
            at = first[c, times[c]]
            times[c] += 1
            if at[0] >= i:
                end()
                continue
            if run and not (run[-1][2][:2] == at[:2] and run[-1][2][2] + a - run[-1][0] == at[2]):
                end()
            run.append((a, b, at))
        end()
    kept = set()
    for (i, _), spans in likes.items():
        at = None
        for a, b in sorted(spans):
            if at and a <= at[1]:
                at[1] = max(at[1], b)
                continue
            if at:
                kept.add((i, *at, i))
            at = [a, b]
        kept.add((i, *at, i))
    return later, kept


def passage_rows(seed, n=60):
    r = random.Random(seed)
    pool = [prose(3000 + k, r.randrange(8, 90)) for k in range(12)]
    lines = ["all rights reserved by nobody at all", "line"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(1, 7)):
            parts.append(r.choice([r.choice(pool), prose(r.randrange(10**6), r.randrange(60)), " ".join([r.choice(lines)] * r.randrange(1, 6))]))
        rows.append((i, " ".join(parts)))
    return rows


def test_passages_equal_brute_force(spark, docs, monkeypatch):
    rows = passage_rows(7) + [(70, passage_rows(7)[3][1]), (71, None), (72, ""), (None, passage_rows(7)[3][1])]
    rows += [(3, passage_rows(7)[3][1]), (4, "another text of one id " + prose(3004, 50)), (80, "語" * 400), (81, "前" * 30 + "語" * 400)]
    later, kept = brute_passages(rows)
    assert len(later) > 40 and kept
    for hot in (10_000, 50):  # at 50 many digests are dealt out
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = substring_dedup.passages(substring_dedup.keyed(docs(rows), "doc_id", "text")).collect()
        assert {(g.key, g.start, g.end, g.first) for g in got if not g.kept} == later
        assert {(g.key, g.start, g.end, g.first) for g in got if g.kept} == kept


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    later, kept = brute_passages(rows)
    got = entry.queries()["op8_substring_dedup"](spark, d).collect()
    assert {(g.doc_id, g.start_byte, g.end_byte, g.first_doc_id) for g in got} == later | kept


def test_no_passage_leaves_the_corpus(spark, docs):
    rows = passage_rows(11, 80)
    out = {r.doc_id: r.text for r in substring_dedup.dedup(docs(rows)).collect()}
    texts = dict(rows)
    for i, a, b, first in brute_passages(rows)[0]:
        gone = texts[i].encode()[a:b]
        assert first < i and gone in texts[first].encode() and gone in out[first].encode()
    assert sum(map(len, out.values())) < sum(len(t) for _, t in rows)


def test_chunks_of_others_make_no_passage(spark, docs):
    passage = prose(77, 60)
    pieces = [passage.encode()[a:b].decode() for a, b in cut_at("x" * 40 + " " + passage)[1:]]
    rows = [(i, f"{prose(500 + i, 40)} {p.strip()} {prose(600 + i, 40)}") for i, p in enumerate(pieces)] + [(900, "x" * 40 + " " + passage)]
    assert {r.doc_id: r.text for r in substring_dedup.dedup(docs(rows)).collect()} == dict(rows)


def test_passages_of_over_fifty_words_are_found(spark, docs):
    rows = []
    for k in range(60):
        passage = prose(1000 + k, 52)
        rows += [(2 * k + i, f"{prose(5000 + 10 * k + i, 60)} {passage} {prose(7000 + 10 * k + i, 60)}") for i in range(2)]
    found = {g.key for g in substring_dedup.passages(substring_dedup.keyed(docs(rows), "doc_id", "text")).collect()}
    assert len(found) >= 118


def test_text_without_white_space(spark, docs):
    r = random.Random(3)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    passage = han(200)
    rows = [(1, han(300) + passage + han(300)), (2, han(150) + passage + han(90)), (3, "\u3000".join(han(12) for _ in range(30)))]
    out = {x.doc_id: x.text for x in substring_dedup.dedup(docs(rows)).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and 100 < len(rows[1][1]) - len(out[2]) <= 200


def words(t):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]


def bags(t):
    w = words(t)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, items, least=0.8):
    want = {}
    for i, t in rows:
        s = bags(t)
        for j, item in items:
            b = bags(item)
            if i is None or j is None or not b:
                continue
            for at in range(max(1, len(s))):
                own = s[at : at + len(b)]
                both = sum((Counter(own) & Counter(b)).values())
                if own and both / (len(own) + len(b) - both) >= least:
                    want[i, j] = max(want.get((i, j), 0), both / (len(own) + len(b) - both))
    return want


def test_contamination_equals_brute_force(spark, docs):
    items = [(k, prose(100 + k, 15 + 7 * k)) for k in range(6)] + [(6, "too short"), (7, None), (None, prose(100, 15)), (8, "one two " * 20)]
    r = random.Random(4)
    rows = []
    for k in range(40):
        w = words(items[k % 6][1])
        for _ in range(k // 12):
            w[r.randrange(len(w))] = "changed"
        if k % 5 == 4:
            w.insert(r.randrange(len(w)), "more")
        rows.append((k, f"{prose(200 + k, r.randrange(80))} {' '.join(w).upper()}, {prose(300 + k, r.randrange(80))}"))
    rows += [(50, None), (51, ""), (52, "one two " * 300), (None, items[0][1]), (53, items[2][1] * 3), (53, items[2][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.contaminated(docs(rows), table).collect()}
    assert got == {k: round(v, 9) for k, v in brute(rows, items).items()}
    big = {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs(rows).withColumnRenamed("lang", "item").withColumnRenamed("source", "words"), table).collect()}
    assert big == set(got)


def test_contamination_of_empty_tables(spark, docs):
    table = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontamination.contaminated(docs([]), table).count() == 0
    assert decontamination.contaminated(docs([(1, prose(1, 30))]), table.limit(0)).count() == 0


def test_a_benchmark_too_large_to_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    table = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert [x.doc_id for x in decontamination.contaminated(docs([(4, prose(2, 9) + " " + prose(1, 30)), (5, prose(3, 60))]), table).collect()] == [4]


def test_contamination_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{d}/{name}.parquet").collect()]
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in entry.queries()["op6_decontamination"](spark, d).collect()}
    assert got == {k: round(v, 9) for k, v in brute(read("documents", "doc_id"), read("benchmark", "item_id")).items()} and got


def test_a_long_item(spark, docs):
    item = prose(1, 6000)
    w = item.split()
    w[100] = w[3000] = "changed"
    table = spark.createDataFrame([(1, item), (2, prose(2, 40)), (2, prose(3, 40))], "item_id long, text string")
    rows = [(1, f"{prose(4, 500)} {' '.join(w)} {prose(5, 300)}"), (2, prose(3, 40)), (2, "other text"), (3, prose(6, 9000))]
    got = {(x.doc_id, x.item_id): (x.start_word, round(x.similarity, 4)) for x in decontamination.contaminated(docs(rows), table).collect()}
    assert set(got) == {(1, 1), (2, 2)} and got[1, 1][0] == 500 and got[2, 2] == (0, 1.0)
