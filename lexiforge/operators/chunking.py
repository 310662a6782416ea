"""Documents cut into chunks within a token budget: paragraphs, sentences, table rows, words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

BUDGET = 480
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PARAGRAPHS = re.compile(r"\n\s*\n+")
_SENTENCES = re.compile(r"(?<=[.!?…؟])\s+")


def count(text: str) -> int:
    """Words and single other characters: sums over parts that white space divides."""
    return len(_TOKEN.findall(text))


def units(text: str) -> list[str]:
    """The sentences of a text's paragraphs."""
    found = [s for p in _PARAGRAPHS.split(text) for s in map(str.strip, _SENTENCES.split(p.strip())) if s]
    return found or [text]


def packed(parts: list[str], budget: int, by: str = "\n\n") -> list[str]:
    """Parts joined greedily, in order, to at most ``budget`` tokens; a larger part is packed by its words, alone.

    A word over the budget makes a chunk of its own.
    """
    out, held, size = [], [], 0

    def close():
        nonlocal held, size
        if held:
            out.append(by.join(held))
        held, size = [], 0

    for part in parts:
        n = count(part)
        if size + n > budget:
            close()
        if n > budget and by != " ":
            out.extend(packed(part.split(), budget, " "))
        else:
            held.append(part)
            size += n
    close()
    return out


def table_parts(text: str, budget: int) -> list[str]:
    """Rows of a table in fragments that each begin with its header, and its rule where there is one."""
    rows = [r for r in text.splitlines() if "|" in r]
    if not rows:
        return packed(units(text), budget)
    ruled = len(rows) > 1 and set(rows[1]) <= set("|-: ")
    header, body = "\n".join(rows[: 1 + ruled]), rows[1 + ruled :]
    if not body:
        return packed([header], budget)
    room = budget - count(header)
    out, held, size = [], [], 0
    for row in body:
        n = count(row)
        if held and size + n > room:
            out.append("\n".join([header, *held]))
            held, size = [], 0
        if n > room:
            cells = [f"| {c.strip()} |" for c in row.split("|") if c.strip()] or [row]
            out += [f"{header}\n{part}" for part in packed(cells, room)]
        else:
            held.append(row)
            size += n
    if held:
        out.append("\n".join([header, *held]))
    return out


def split(text: str | None, kind: str | None, title: str | None, heading: str | None, budget: int = BUDGET) -> list[str]:
    """The chunks of a text; title and heading, which go with each, count against the budget.

    Without text there are none. A context that leaves no room is an error.
    """
    text = (text or "").strip()
    if not text:
        return []
    context = count(f"Document: {title}" if title else "") + count(f"Section: {heading}" if heading else "")
    if context >= budget:
        raise ValueError("title and heading exhaust the token budget")
    if context + count(text) <= budget:
        return [text]
    return table_parts(text, budget - context) if kind == "table" else packed(units(text), budget - context)


def chunks(docs: DataFrame, doc_id: str, body: str, kind: str, title: str, heading: str, budget: int = BUDGET) -> DataFrame:
    """(doc_id, chunk_index, content, tokens): the chunks of each document, in order, gapless from 0."""
    rows = docs.select(doc_id, body, kind, title, heading)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [(i, n, c, count(c)) for i, *row in zip(*(x.to_pylist() for x in part.columns), strict=True) for n, c in enumerate(split(*row, budget))]
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (part.column(0).type, pa.int64(), pa.string(), pa.int64()), strict=True)], names=[doc_id, "chunk_index", "content", "tokens"])

    return rows.mapInArrow(run, f"{doc_id} {rows.schema[doc_id].dataType.simpleString()}, chunk_index long, content string, tokens long")
