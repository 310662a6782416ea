"""Operators 11, 12 and 13."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import block_max, clustering, host_rules, registry

from ..oracle import connected, differences

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_clustering", "op12_host_rules", "op13_block_max"])
def test_queries_equal_their_sql(spark, name):
    assert not differences(registry.queries()[name](spark, DIR), connected(DIR), registry.oracle_sql()[name])


# 11: clustering


def lloyd(x, centroids, rounds):
    """All distances in each round, in whole numbers."""
    for r in range(rounds + 1):
        d = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
        at = d.argmin(1)
        if r < rounds:
            centroids = np.array([[s // n for s in x[at == c].sum(0).tolist()] if (n := int((at == c).sum())) else centroids[c].tolist() for c in range(len(centroids))])
    return at, d[np.arange(len(x)), at], centroids


def test_bounds_give_the_rows_of_full_scans(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 4)) * 4
    x = (centres[r.integers(0, 6, 900)] + r.normal(size=(900, 4)) * 0.3).round(2)
    x[100:160] = x[0]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    trace = []
    got = {a.vec_id: a for a in clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=8, rounds=6, dimensions=4, trace=trace).collect()}
    whole = np.floor(256 * x).astype(np.int64)
    import hashlib

    first = sorted(range(900), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:8]
    at, distance, centroids = lloyd(whole, whole[first], 6)
    assert [got[i].cluster for i in range(900)] == at.tolist()
    assert [got[i].distance for i in range(900)] == distance.tolist()
    assert {a.inertia for a in got.values()} == {int(distance.sum())}
    assert got[5].centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[at[5]].tolist())).encode()).hexdigest()
    assert trace[0] == 900 and sum(trace[1:]) < 0.35 * 900 * 6, trace  # the bounds spare most scans


def test_ties_go_to_the_smaller_number():
    c = np.array([[4, 0], [0, 0], [4, 0]])
    x = np.array([[2, 0], [4, 0], [2, 3]])
    cluster, upper, lower = np.full(3, -1), np.zeros(3), np.zeros(3)
    assert clustering.settle(x, cluster, upper, lower, c, None).all()
    assert cluster.tolist() == [0, 0, 0]
    moved = np.array([[4, 0], [3, 0], [4, 0]])
    clustering.settle(x, cluster, upper, lower, moved, np.sqrt(((moved - c) ** 2).sum(1)))
    assert cluster.tolist() == [1, 0, 1]


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [0.0, 1.0], "a"), (1, [5.0, 5.0], "b"), (None, [0.1, 1.0], "c"), (2, None, "d"), (3, [1.0], "e"), (4, [nan, 1.0], "f"), (5, [inf, 1.0], "g"), (6, [None, 1.0], "h"), (7, [0.0, 0.0], "i")]
    schema = "vec_id long, embedding array<double>, cluster string"
    got = clustering.cluster(spark.createDataFrame(rows, schema), k=40, rounds=2, dimensions=2).collect()
    assert Counter(r.vec_id for r in got) == {1: 2, None: 1, 7: 1}
    assert {r.distance for r in got} == {0} and {r.cluster for r in got} == {0, 1, 2, 3}
    empty = clustering.cluster(spark.createDataFrame([], schema), dimensions=2)
    assert empty.count() == 0 and empty.columns == clustering.RESULT.replace(",", "").split()[::2]
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e9, 0.0], "a")], schema), dimensions=2).count()


# 12: rules by host


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(inside)]


def test_measures_equal_plain_python():
    r = random.Random(4)
    texts = [None, "", " \n\t ", "a b c a b c", "   x", "é é é é", "a" * 70000, "a b\r\na b\r\n\n a b", "x\x0by\x0cz\x1c"]
    texts += ["".join(r.choice("ab #|\n é\t") for _ in range(r.randrange(300))) for _ in range(200)] + ["lorem ipsum dolor " * 3000]
    got = host_rules.measured(pa.array(texts, pa.string()))
    assert list(zip(*(c.tolist() for c in got), strict=True)) == [tuple(plain_measures(t)) for t in texts]
    later = host_rules.measured(pa.array(texts, pa.string()).slice(3, 50))
    assert [c.tolist() for c in later] == [c[3:53].tolist() for c in got]


def good(i):
    return " ".join(f"word{i}x{k}" for k in range(60))


def judged(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, h, "extra") for i, t, h in rows], "doc_id long, text string, source string, failed string")
    return {r.doc_id: r.verdict for r in host_rules.judge(host_rules.measure(docs).drop("text"), **more).collect()}


def test_a_bad_host_goes_and_a_small_one_gets_the_benefit_of_the_doubt(spark):
    rows = [(i, good(i), f"good{i % 20}") for i in range(1000)]
    rows += [(2000 + i, f"# | $ {good(i)}", "few symbols") for i in range(200)]
    rows += [(3000 + i, f"{'# ' * 30} {good(i)}" if i % 10 < 7 else good(i), "worse") for i in range(200)]
    rows += [(4000, f"{'# ' * 30} {good(1)}", "tiny"), (4001, good(2), "tiny")]
    rows += [(5000 + i, f"{'# ' * 30} {good(i)}" if i % 10 < 4 else good(i), "half") for i in range(200)]
    got = judged(spark, rows)
    assert all(got[i].kept for i in range(1000)) and all(got[2000 + i].kept for i in range(200))
    assert not any(got[3000 + i].kept for i in range(200)) and got[3000].barred
    assert not got[4000].barred and got[4001].kept
    assert [got[5000 + i].kept for i in range(10)] == [False] * 4 + [True] * 6 and got[5000].strict == ["symbols"]


def test_verdicts_are_alike_whether_hosts_are_broadcast_or_shuffled(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, f"{'# ' * 30} {good(i)}" if r.random() < (i % 40) / 40 else good(i), f"h{i % 40}") for i in range(2000)] + [(9000, good(0), None), (9001, None, None), (9002, "", "h1")]
    first = judged(spark, rows)
    monkeypatch.setattr(host_rules, "LARGE", 1)
    assert judged(spark, rows) == first
    assert first[9000].kept and first[9001].base_failed and not first[9001].kept and first[9002].failed == ["few_words"]
    assert len({v.kept for v in first.values()}) == 2
    assert judged(spark, []) == {}


def test_the_prior_is_that_of_the_hosts(spark):
    r = np.random.default_rng(6)
    rows = [(f"h{i}", 400, int(r.binomial(400, r.beta(4, 16)))) for i in range(3000)]
    hosts = spark.createDataFrame(rows, "host string, n long, any long")
    alpha, beta, rate = host_rules.prior(hosts, ["any"])["any"]
    assert abs(rate - 0.2) < 0.01 and 17 < alpha + beta < 23
    assert host_rules.prior(hosts.limit(0), ["any"])["any"][2] == 0


# 13: variable blocks


def least_cost(impacts, docs, longest, fee):
    best = [0]
    for j in range(1, len(impacts) + 1):
        best.append(min(best[i] + fee + (docs[j - 1] - docs[i] + 1) * max(impacts[i:j]) for i in range(max(0, j - longest), j)))
    return best[-1]


def test_cuts_have_the_least_cost():
    r = np.random.default_rng(7)
    sizes = (1, 40, 7, 100, 2, 300)
    lists = [r.integers(1, 1000, n) for n in sizes]
    docs = [np.sort(r.choice(600, n, replace=False)) for n in sizes]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = block_max.block_starts(np.concatenate(lists), np.concatenate(docs), starts, ends, 16, 3.0)
    for x, d, a, b in zip(lists, docs, starts, ends, strict=True):
        fee = 1 + int(np.round(3.0 * x.sum() / len(x)))
        cuts = [*np.flatnonzero(first[a:b]), len(x)]
        assert cuts[0] == 0 and max(np.diff(cuts)) <= 16
        cost = sum(fee + int(d[j - 1] - d[i] + 1) * int(max(x[i:j])) for i, j in zip(cuts, cuts[1:], strict=False))
        assert cost == least_cost(x.tolist(), d.tolist(), 16, fee)
    assert len(block_max.block_starts(lists[0][:0], docs[0][:0], starts[:0], ends[:0])) == 0


def plain_search(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: term.findall((t or "").translate(lower))
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in split(text) if t in b)
            if s > 0:
                scored.append((-s, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_search_equals_scoring_all(spark):
    r = random.Random(8)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(300)]
    docs = [(i, " ".join([r.choice(common) for _ in range(r.randrange(1, 60))] + [r.choice(rare) for _ in range(r.randrange(6))])) for i in range(1500)]
    docs += [(2000 + i, "Same Text, same-text r1 r2 É") for i in range(60)] + [(7, docs[7][1]), (5000, None), (5001, " .,"), (5002, "x" * 50_000)]
    items = [(k, " ".join(r.sample(rare, 3) + r.sample(common, 4))) for k in range(30)] + [(90, "same text É same"), (91, None), (92, "..."), (93, "nowhere"), (94, "c1 c1 c2")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in [*items, items[0]]], "item_id long, text string, score string")
    for postings in (2_000, 3_000_000):
        got = sorted(tuple(x) for x in block_max.search(frame, asked, top=5, longest=8, postings=postings).collect())
        assert got == plain_search(docs, items, 5)
    assert block_max.search(frame.limit(0), asked).count() == block_max.search(frame, asked.limit(0)).count() == 0


def test_items_in_rounds(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 11} c") for i in range(200)]
    items = [(k, f"a{k % 7} b{k % 5}") for k in range(20)]
    monkeypatch.setattr(block_max, "ROUND_BYTES", 300)
    got = block_max.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top=3)
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items, 3)


def test_blocks_are_skipped():
    """Documents of a rare term come first; blocks of the frequent one that can't reach them aren't read."""
    r = np.random.default_rng(9)
    n, size = 20_000, 2
    rare = np.zeros(n, bool)
    rare[r.choice(n, 40, replace=False)] = True
    counts = 1 + rare.astype(int)
    terms = np.concatenate([[0, 1] if x else [0] for x in rare])
    shard = block_max.Shard(np.arange(n), np.full(n, 50), counts, terms, np.where(terms == 1, 5, r.integers(1, 9, len(terms))), n, 50 * n, size)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    score, ids = shard.search(np.array([0, 1]), np.array([1, 900]), nothing, 20)
    assert set(ids) <= set(np.flatnonzero(rare)) and len(ids) == 20
    assert shard.read < 0.2 * len(terms)
