"""Contexts composed for a request: categories, diversity, budget, neighbours, source blocks.

Each choice depends on those before it, so that a request's candidates, of which a search returns POOL at
most, are looked at in order by one small function; Spark groups and spreads the requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIMARY, POOL, MOST, PER_DOCUMENT = 10, 20, 6, 3
#: The order in which an intent fills its categories.
CONCRETE_FIRST = ("concrete", "guidance", "supporting")
ORDERS = {
    **dict.fromkeys(("concrete_activity", "concrete_exercise", "role_play", "listening_activity", "task", "dialogue"), CONCRETE_FIRST),
    "methodology": ("guidance", "supporting", "concrete"),
}
OTHERWISE = ("supporting", "concrete", "guidance")


def compose(candidates: list[dict], intent: str) -> list[tuple[int, str]]:
    """(place among the candidates, reason) of what is chosen of candidates with document, page, heading, category."""
    pool, order = candidates[:POOL], ORDERS.get(intent, OTHERWISE)
    taken: list[tuple[int, str]] = []
    units, documents = set(), {}

    def take(at: int, reason: str, capped: bool) -> bool:
        c = pool[at]
        unit = (c["document"], c["page"], c["heading"])
        if len(taken) >= MOST or unit in units or capped and documents.get(c["document"], 0) >= PER_DOCUMENT:
            return False
        taken.append((at, reason))
        units.add(unit)
        documents[c["document"]] = documents.get(c["document"], 0) + 1
        return True

    primary, extended = range(min(PRIMARY, len(pool))), range(PRIMARY, len(pool))
    of = lambda category, places: (k for k in places if pool[k]["category"] == category)
    for category in order:
        any(take(k, f"category_{category}", True) for k in of(category, primary))
    for category in [c for c in order if c not in {pool[k]["category"] for k, _ in taken}]:
        any(take(k, f"extended_{category}", False) for k in of(category, extended))
    chosen = lambda k: any(k == at for at, _ in taken)
    for k in primary:
        if not chosen(k) and pool[k]["document"] not in documents:
            take(k, "document_diversity", True)
    for capped, reason in ((True, "fill"), (False, "fill_same_document")):
        for k in primary:
            if not chosen(k):
                take(k, reason, capped)
    for k in extended:
        if not chosen(k):
            take(k, "extended_fill", False)
    return taken


def unlike(candidates: list[dict]) -> list[int]:
    """Places of candidates that say something new: not blank, not equal to an earlier one nor, if short, within it."""
    kept: list[tuple[int, str]] = []
    for at, c in enumerate(candidates):
        text = " ".join((c["content"] or "").lower().split())
        if text and not any(text == other or len(text) <= 100 and text in other for _, other in kept):
            kept.append((at, text))
    return [at for at, _ in kept]


def budgeted(candidates: list[dict], most: int, tokens: int) -> list[int]:
    """Places of candidates taken in order while they fit; one that doesn't is skipped."""
    out, used = [], 0
    for at, c in enumerate(candidates):
        if len(out) < most and used + c["tokens"] <= tokens:
            out.append(at)
            used += c["tokens"]
    return out


def singly(batches):
    """The rows of batches as batches of one, as each may hold whole texts."""
    return (b.slice(k, 1) for b in batches for k in range(b.num_rows))


def per_request(rows: DataFrame, request: str, order: list[str], choose, result: str) -> DataFrame:
    """(request, place, ...) of what ``choose`` picks of each request's rows in order: one list a request, POOL rows at most."""
    w = Window.partitionBy(request).orderBy(*order)
    first = rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= POOL)
    listed = first.groupBy(request).agg(F.sort_array(F.collect_list(F.struct("__k", *[c for c in rows.columns if c != request]))).alias("c"))

    def run(batches):
        import pyarrow as pa

        for batch in singly(batches):
            out = [(i, place, *picked) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for place, picked in enumerate(choose(c))]
            fields = [(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in result.split(", "))]
            columns = list(zip(*out, strict=True)) if out else [[]] * (2 + len(fields))
            kinds = [batch.column(0).type, pa.int64(), *[t for _, t in fields]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[request, "place", *[n for n, _ in fields]])

    return listed.mapInArrow(run, f"{request} {rows.schema[request].dataType.simpleString()}, place long, {result}")


def composed(candidates: DataFrame, request: str, order: list[str]) -> DataFrame:
    """(request, place, id, reason): the composer's choice of candidates (id, document, page, heading, category, intent)."""
    return per_request(candidates, request, order, lambda c: [(c[k]["id"], r) for k, r in compose(c, c[0]["intent"])], "id long, reason string")


def contexts(candidates: DataFrame, request: str, order: list[str], most: int = MOST, tokens: int = 1800) -> DataFrame:
    """(request, place, id): candidates (id, content, tokens) without what earlier ones say, within the budget."""

    def choose(c):
        rest = [c[k] for k in unlike(c)]
        return [(rest[k]["id"],) for k in budgeted(rest, most, tokens)]

    return per_request(candidates, request, order, choose, "id long")
