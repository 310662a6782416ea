"""Operator 10: language-model scores by prediction by partial matching.

A text is coded byte by byte: its words, lower-cased and joined by blanks, then an end symbol. A byte is
predicted from the ORDER bytes before it, which run over blanks into the words before; a text starts after
end symbols. The longest context that the training texts have shown gives a symbol that it has shown c times
in n the share (2c - 1) / 2n (method D: half an occurrence of each distinct symbol goes to the escape); for
any other it escapes to the next shorter context, where the symbols already ruled out are excluded, down to
a uniform guess. ``Trie`` states this law for one machine; ``log10s`` gives the same numbers for a table.

Counts cover the whole training corpus and none are dropped: each distinct gram (ORDER bytes and the one
after them) is scored once, among all grams that share the last two bytes of the context; shorter contexts
than that have 65,536 entries at most. Frequent words and grams, at most HEAVY and SENT of them, reach the
documents by broadcast. What else the texts of a chunk (CHUNK bytes or one partition's end) hold is asked for
once a chunk, and the answers meet the chunk's texts again. Logarithms are summed as whole numbers of 1e-11,
so that a score doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold, sliced

FOLDS, HELD_OUT = 7, 2
ORDER = 5
#: Words above a share 1/HEAVY of all tokens and grams above a share 1/SENT of all bytes are broadcast.
HEAVY = 1_000_000
SENT = 4_000_000
#: Distinct words, or grams, that a task gathers before it hands them on.
GATHERED = 150_000
GATHERED_GRAMS = 1_000_000
#: Bytes whose grams are looked at once, and grams that are scored at once (a two-byte context with more is whole).
CODED = 1_000_000
LOT = 500_000
#: Bytes of texts whose rare grams are asked for together.
CHUNK = 64_000_000
START = b" "
#: The end of a text; words have no such byte. As many as a context has come before a text.
END = b"\n"
SYMBOLS = 256
#: Keys of words lie above those of grams, which have 48 bits.
WORD_KEY = 1 << 62
UNIT = 1e11


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode().lower().split()


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 2 | WORD_KEY


def symbols(word: bytes):
    """(context, symbol) of each byte of a word and of its ending blank."""
    coded = START + word + START
    for i in range(1, len(coded)):
        yield coded[max(0, i - ORDER) : i], coded[i : i + 1]


class Trie:
    """Counts of symbols by context, all context lengths."""

    def __init__(self, entries):
        self.next: dict[bytes, dict[bytes, int]] = defaultdict(dict)
        for context, symbol, n in entries:
            self.next[context][symbol] = n
        self.next.default_factory = None
        self.total = {c: sum(x.values()) for c, x in self.next.items()}
        self.memo: dict[bytes, float] = {}

    def log10(self, context: bytes, symbol: bytes) -> float:
        """log10 of the probability of a symbol after a context."""
        key = context + symbol
        if (got := self.memo.get(key)) is not None:
            return got
        p, ruled_out = 0.0, {}
        for k in range(len(context) + 1):
            if not (found := self.next.get(context[k:])):
                continue
            n, d = self.total[context[k:]], len(found)
            if ruled_out:
                gone = [found[s] for s in ruled_out if s in found]
                n, d = n - sum(gone), d - len(gone)
            if symbol in found:
                p += math.log10((2 * found[symbol] - 1) / (2 * n))
                break
            if d:
                p += math.log10(d / (2 * n))
            ruled_out = {**ruled_out, **found} if ruled_out else found
        else:
            p += math.log10(1 / max(1, SYMBOLS - len(ruled_out)))
        if len(self.memo) > GATHERED:
            self.memo.clear()
        self.memo[key] = p
        return p

    def word(self, word: bytes) -> float:
        return sum(self.log10(c, s) for c, s in symbols(word))


def counted(docs: DataFrame, training: Column, text: str) -> DataFrame:
    """(word, c, n): each distinct word's occurrences in training rows and in all rows.

    The pairs of bytes of coded training texts are counted along, as "words" that start with END (n: 0).
    """

    def run(batches):
        found: tuple[Counter, Counter] = (Counter(), Counter())
        pairs = np.zeros(1 << 16, np.int64)

        def batch_of(keys, c, n):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])

        def rows():
            keys = list(found[0].keys() | found[1].keys())
            learnt, other = ([x.get(k, 0) for k in keys] for x in found)
            for x in found:
                x.clear()
            return batch_of(keys, learnt, [a + b for a, b in zip(learnt, other, strict=True)])

        for batch in sliced(batches):
            bodies = []
            for learns, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(t)
                found[not learns].update(ws)
                if learns:
                    bodies.append(END + b" ".join(ws))
            data = np.frombuffer(b"".join(bodies) + END, np.uint8).astype(np.int64)
            pairs += np.bincount(data[:-1] << 8 | data[1:], minlength=1 << 16)
            if len(found[0]) + len(found[1]) > GATHERED:
                yield rows()
        yield rows()
        at = np.flatnonzero(pairs)
        yield batch_of([END + int(p).to_bytes(2, "big") for p in at], pairs[at], np.zeros(len(at), np.int64))

    return docs.select(training.alias("learns"), F.col(text)).mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of each coded byte: its gram (ORDER bytes before it and itself, as a number) and the place of its text."""
    bodies = [b" ".join(words(t)) + END for t in texts]
    data = np.frombuffer(b"".join(END * ORDER + b for b in bodies), np.uint8).astype(np.int64)
    key = np.zeros(max(0, len(data) - ORDER), np.int64)
    for k in range(ORDER + 1):
        key = key << 8 | data[k : k + len(key)]
    text = np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
    return key[np.arange(len(text)) + text * ORDER], text


def slices(texts: list[str | None]):
    """(from, to) of runs of texts of about CODED bytes, or of one longer text."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > CODED:
            yield begin, k
            begin, size = k, 0
        size += len(t or "") + 1
    if begin < len(texts):
        yield begin, len(texts)


def summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    return key[at], *(np.add.reduceat(c[order], at) if len(at) else c[:0] for c in counts)


def counted_grams(docs: DataFrame, training: Column, text: str) -> DataFrame:
    """(end, gram, c, n): grams' occurrences in training rows and in all rows, summed in each task; their contexts' last two bytes."""

    def run(batches):
        held, size = [], 0

        def rows():
            key, c, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array((key >> 8 & 0xFFFF).astype(np.int32)), pa.array(key), pa.array(c), pa.array(n)], names=["end", "gram", "c", "n"])

        for batch in sliced(batches):
            learns, texts = np.array(batch.column(0).to_pylist(), bool), batch.column(1).to_pylist()
            for a, b in slices(texts):
                key, at = grams(texts[a:b])
                mine = learns[a:b][at]
                for part, learnt in ((key[mine], 1), (key[~mine], 0)):
                    if len(part):
                        distinct, n = np.unique(part, return_counts=True)
                        held.append((distinct, n * learnt, n))
                        size += len(distinct)
            if size > GATHERED_GRAMS:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if 2 * size > GATHERED_GRAMS:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return docs.select(training.alias("learns"), F.col(text)).mapInArrow(run, "end int, gram long, c long, n long")


def log10s(gram: np.ndarray, c: np.ndarray, short: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the others.

    ``gram`` (distinct) has all grams of its two-byte contexts, ``c`` their counts in training texts;
    ``short`` has the counts of all pairs of bytes. A symbol that a context has shown, its shorter ones
    have shown too, so that the symbols ruled out are those of the next longer context.
    """
    p, searching, longer = np.zeros(len(gram)), np.ones(len(gram), bool), None
    for k in range(ORDER, -1, -1):
        entry = gram & ((1 << 8 * (k + 1)) - 1)
        if k > 1:
            entries, at = np.unique(entry, return_inverse=True)
            found = np.bincount(at, c, len(entries))
        else:
            found = short if k else short.reshape(-1, 256).sum(0)
            entries, at = np.arange(len(found)), entry
        context = np.r_[0, np.cumsum(np.diff(entries >> 8) > 0)] if len(entries) else entries
        n, d = np.bincount(context, found), np.bincount(context, found > 0)
        mine = context[at]
        n, d, seen = n[mine], d[mine], found[at]
        if longer is not None:
            entries_, found_, context_, at_ = longer
            here = found[np.searchsorted(entries, entries_ & ((1 << 8 * (k + 1)) - 1))]
            place = context_[at_]
            n -= np.bincount(context_, here * (found_ > 0))[place]
            d -= np.bincount(context_, found_ > 0)[place]
        longer = entries, found, context, at
        hit, escapes = searching & (seen > 0), searching & (seen <= 0) & (d > 0)
        p[hit] += np.log10((2 * seen[hit] - 1) / (2 * n[hit]))
        p[escapes] += np.log10(d[escapes] / (2 * n[escapes]))
        searching &= ~hit
    p[searching] -= math.log10(max(1, SYMBOLS - np.count_nonzero(short.reshape(-1, 256).sum(0))))
    return p


def scored_grams(counts: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(gram, n, p): of each gram of ``counts`` the log10 of its last byte's probability, in 1e-11; pairs: counts of two bytes."""
    short = counts.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        held, size, goal = [], 0, LOT

        def rows(part):
            key, c, n = summed(*part)
            p = np.rint(log10s(key, c.astype(float), short.value) * UNIT).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(p)], names=["gram", "n", "p"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(3)]))
            size += batch.num_rows
            if size > goal:
                every = np.concatenate(held, 1)
                # rows are sorted by the last two bytes of the context; the last such context may go on
                end = every[0] >> 8 & 0xFFFF
                whole = int(np.searchsorted(end, end[-1], "left"))
                if whole:
                    yield rows(every[:, :whole])
                held = [every[:, whole:]]
                size -= whole
                goal = max(LOT, 2 * size)
        if held:
            yield rows(np.concatenate(held, 1))

    return counts.repartition("end").sortWithinPartitions("end").select("gram", "c", "n").mapInArrow(run, "gram long, n long, p long")


def exact_sums(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place."""
    high, low = value >> 20, value & 0xFFFFF
    return (np.bincount(at, high, n).astype(np.int64) << 20) + np.bincount(at, low, n).astype(np.int64)


class Known:
    """What is broadcast: values of grams, and of words whether they are known and their base value."""

    def __init__(self, gram, p, word, known, base):
        self.gram, self.p, self.known, self.base = gram, p, known, base
        self.word = {w: k for k, w in enumerate(word)}

    def spelt(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the sum over its known grams; its other grams, and how many it has."""
        key, at = grams(texts)
        both = np.sort(key << 15 | at)  # texts of a slice are fewer than 2 ** 15
        key, at = both >> 15, (both & 0x7FFF).astype(np.uint16)
        starts = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
        distinct, times = key[starts], np.diff(np.r_[starts, len(key)])
        found = np.minimum(np.searchsorted(self.gram, distinct), max(0, len(self.gram) - 1))
        is_known = self.gram[found] == distinct if len(self.gram) else np.zeros(len(distinct), bool)
        value = np.where(is_known, self.p[found], 0) if len(self.gram) else np.zeros(len(distinct), np.int64)
        rare = np.repeat(~is_known, times)
        key, of = key[rare], at[rare]
        return exact_sums(at, np.repeat(value, times), len(texts)), key[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(texts))

    def words(self, text: str | None) -> tuple[int, int, int, list[int]]:
        """Tokens, known ones and their base value without the end; keys of words that aren't broadcast, as often as they come."""
        found = Counter(words(text))
        places, times, rest = [], [], []
        for w, n in found.items():
            if (k := self.word.get(w)) is None:
                rest += [word_key(w)] * n
            else:
                places.append(k)
                times.append(n)
        k, n = np.array(places, np.int64), np.array(times, np.int64)
        return sum(found.values()), int(n[self.known[k]].sum()), int(n @ self.base[k]), rest


#: place: twice a chunk's number for its requests (key), one more for its texts, with the places of their keys among the chunk's.
CHUNK_ROWS = "place long, key long, doc struct<id:{id},n_tokens:bigint,n_known:bigint,base:bigint,ppm:bigint,at:array<int>>"
DOC = ["id", "n_tokens", "n_known", "base", "ppm", "at"]


def chunk_rows(docs: DataFrame, shared) -> DataFrame:
    """Of (id, text): requests, without value, and texts, chunk by chunk."""
    schema = CHUNK_ROWS.format(id=docs.schema["id"].dataType.simpleString())

    def run(batches):
        known, task = shared.value, TaskContext.get().partitionId()
        held, rare, size, number = [], [], 0, 0

        def rows():
            every = np.concatenate([k for k, _ in rare])
            asked, place = np.unique(every, return_inverse=True)
            place_of = (task << 31 | number) << 1
            kind = pa.struct([(n, held[0][0].type if n == "id" else pa.list_(pa.int32()) if n == "at" else pa.int64()) for n in DOC])

            def batch_of(where, keys, docs_):
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), where)), pa.array(keys), docs_], names=["place", "key", "doc"])

            yield batch_of(place_of, asked, pa.nulls(len(asked), kind))
            begin = 0
            for (ids, *columns), (keys, lengths) in zip(held, rare, strict=True):
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                at = pa.ListArray.from_arrays(offsets, pa.array(place[begin : begin + len(keys)].astype(np.int32)))
                begin += len(keys)
                yield batch_of(place_of + 1, np.arange(len(ids)), pa.StructArray.from_arrays([ids, *map(pa.array, columns), at], fields=list(kind)))

        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ppm, keys, n_grams = known.spelt(texts[a:b])
                tokens, n_known, base, rest = zip(*map(known.words, texts[a:b]), strict=True)
                n_words = np.array([len(r) for r in rest])
                # of each text its grams, then its words
                cuts = np.cumsum(n_grams)[:-1]
                mixed = [x for g, r in zip(np.split(keys, cuts), rest, strict=True) for x in (g, np.array(r, np.int64))]
                held.append((batch.column(0).slice(a, b - a), *(np.array(x, np.int64) for x in (tokens, n_known, base)), ppm))
                rare.append((np.concatenate(mixed), n_grams + n_words))
                size += sum(len(t or "") for t in texts[a:b])
                if size > CHUNK:
                    yield from rows()
                    held, rare, size, number = [], [], 0, number + 1
        if held:
            yield from rows()

    return docs.mapInArrow(run, schema)


def packed(answers: DataFrame) -> DataFrame:
    """(place, keys, values) of ``answers`` (place, key, value): those of a chunk that a task has, in one row."""

    def run(batches):
        held, size = [], 0

        def rows():
            place, key, value = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(place, kind="stable")
            place, key, value = place[order], key[order], value[order]
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), len(place)]
            parts = [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x in (key, value)]
            return pa.RecordBatch.from_arrays([pa.array(place[cuts[:-1]]), *(pa.array(x, pa.binary()) for x in parts)], names=["place", "keys", "values"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in range(3)])
                size += batch.num_rows
            if size > 2 * GATHERED_GRAMS:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return answers.mapInArrow(run, "place long, keys binary, values binary")


def answered(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n_tokens, n_known, base, ppm) of ``texts`` (place, doc) with the ``answers`` (place, keys, values) of their chunks added."""

    def run(batches):
        place, parts, table = None, [], None

        def sums(offsets, values):
            total = np.r_[0, np.cumsum(values)]
            return total[offsets[1:]] - total[offsets[:-1]]

        for batch in batches:
            places = batch.column(0).to_numpy()
            if not len(places):
                continue
            cuts = np.flatnonzero(places[1:] != places[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
                part = batch.slice(a, b - a)
                if place is None or places[a] >> 1 != place >> 1:
                    parts, table = [], None
                place = places[a]
                if place & 1 == 0:
                    parts += zip(*([np.frombuffer(x, np.int64) for x in part.column(k).to_pylist()] for k in (1, 2)), strict=True)
                    continue
                if table is None:
                    key, value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
                    order = np.argsort(key)
                    key, value = key[order], value[order]
                    is_word = key >= WORD_KEY
                    table, parts = (np.where(is_word, 0, value >> 1), np.where(is_word, value >> 1, 0), value & 1), []
                ids, *own, lists = part.column(3).flatten()
                offsets = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
                at = lists.flatten().to_numpy()
                ppm, base, n_known = (sums(offsets, x[at]) if len(at) else np.zeros(b - a, np.int64) for x in table)
                own = [x.to_numpy() for x in own]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (own[0], own[1] + n_known, own[2] + base, own[3] + ppm))], names=DOC[:5])

    nothing = F.lit(None).cast("binary")
    rows = answers.withColumn("doc", F.lit(None).cast(texts.schema["doc"].dataType)).unionByName(texts.select("place", nothing.alias("keys"), nothing.alias("values"), "doc"))
    in_order = rows.repartition(F.shiftright("place", 1)).sortWithinPartitions("place")
    return in_order.mapInArrow(run, f"id {rows.schema['doc'].dataType['id'].dataType.simpleString()}, n_tokens long, n_known long, base long, ppm long")


def score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_tokens, n_known, train_tokens, base_score and score (both log10).

    ``training`` says which rows the model learns from. A null text is an empty one: its only token is the
    end. Repeated rows are scored each; null ids stay. Without training rows every guess is uniform. An
    empty table gives an empty one; extra columns are dropped.
    """
    spark = docs.sparkSession
    every = checkpoint(counted(docs, training, text))
    is_pair = F.substring("word", 1, 1) == F.lit(END)
    pairs = np.zeros(1 << 16)
    # 65,536 rows at most
    for word, c in every.filter(is_pair).select("word", "c").collect():
        pairs[int.from_bytes(word[1:], "big")] = c
    counts = every.filter(~is_pair)
    texts = docs.filter(training).count()
    learnt, distinct, all_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, kinds = learnt + texts, distinct + bool(texts)

    by_gram = checkpoint(scored_grams(counted_grams(docs, training, text), pairs))
    all_grams = by_gram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Grams of more than 1/SENT of all coded bytes: fewer than SENT
    is_hot = F.col("n") >= max(2, all_grams / SENT)
    hot = by_gram.filter(is_hot).select("gram", "p").orderBy("gram").toArrow()

    def base(c):
        return np.rint(np.log10((np.asarray(c) + 1) / (tokens + kinds + 1)) * UNIT).astype(np.int64)

    def coded(batches):
        for batch in batches:
            c = batch.column(1).to_numpy()
            keys = np.array([word_key(w) for w in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(base(c) << 1 | (c > 0))], names=["key", "value"])

    # Words of more than 1/HEAVY of all tokens: fewer than HEAVY
    is_heavy = F.col("n") >= max(2, all_words / HEAVY)
    heavy = counts.filter(is_heavy).select("word", "c").toArrow()
    c = heavy.column("c").to_numpy()
    shared = spark.sparkContext.broadcast(Known(hot.column("gram").to_numpy(), hot.column("p").to_numpy(), heavy.column("word").to_pylist(), c > 0, base(c)))
    del hot, heavy

    rows = checkpoint(chunk_rows(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), shared))
    # twice the value, and one more for a known word
    rare = by_gram.filter(~is_hot).select(F.col("gram").alias("key"), F.shiftleft("p", 1).alias("value"))
    rare = rare.unionByName(counts.filter(~is_heavy).select("word", "c").mapInArrow(coded, "key long, value long"))
    is_request = F.col("place").bitwiseAND(1) == 0
    answers = rows.filter(is_request).select("place", "key").join(rare, "key").select("place", "key", "value")
    found = answered(packed(answers), rows.filter(~is_request).select("place", "doc"))
    end_base, end_known = int(base(texts)), int(bool(texts))
    return found.select(
        F.col("id").alias(doc_id),
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + end_known).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + end_base) / F.lit(UNIT)).alias("base_score"),
        (F.col("ppm") / F.lit(UNIT)).alias("score"),
    )


def query(spark, sf_dir):
    """All documents, scored by what the rows outside the held-out fold teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return score(docs, fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
