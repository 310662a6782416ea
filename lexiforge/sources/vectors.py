"""A vector store as a Python data source: ``spark.read.format("vector_store")`` and ``df.write.format("vector_store")``.

A store is a folder of collections; a collection is a folder of pages, Parquet files of points (id, vector,
payload). A reader has one partition a page and leaves out pages that a filter on the id rules out, by the
least and largest id in the page's statistics; rows of the pages that are left are filtered too.

A writer is idempotent. Each task writes a file beside the pages that no reader sees, and says so in its commit
message; only when all tasks have succeeded does the driver publish a new list of pages, in one rename. Points
take the place of those with the same id, which are left out when pages are read; a failed job leaves the old
list. A page's place in the list is its age, so that the newest point of an id holds.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "id string, vector array<double>, payload string"
POINTS = pa.schema([("id", pa.string()), ("vector", pa.list_(pa.float64())), ("payload", pa.string())])
PAGE_ROWS = 10_000
_LIST = "pages.json"


def pages_of(folder: str) -> list[str]:
    """Names of the pages of a collection, the oldest first."""
    path = os.path.join(folder, _LIST)
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def publish(folder: str, pages: list[str]) -> None:
    """Makes these the pages of a collection, in one rename."""
    draft = os.path.join(folder, f".{uuid.uuid4().hex}")
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(pages, f)
    os.replace(draft, os.path.join(folder, _LIST))


def span(path: str) -> tuple[str, str]:
    """The least and the largest id of a page."""
    ids = [g.statistics for g in (pq.ParquetFile(path).metadata.row_group(k).column(0) for k in range(pq.ParquetFile(path).metadata.num_row_groups))]
    return min(s.min for s in ids), max(s.max for s in ids)


@dataclass
class Page(InputPartition):
    path: str
    newer: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    pages: tuple[str, ...]


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.filters = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("id",):
                self.filters.append(f)
            else:
                yield f

    def keeps(self, ids: pa.Array) -> pa.Array:
        """Which ids all filters let through."""
        kept = pa.array([True] * len(ids))
        tests = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
        for f in self.filters:
            kept = pc.and_(kept, pc.is_in(ids, pa.array(f.value, pa.string())) if isinstance(f, In) else tests[type(f)](ids, pa.scalar(f.value, pa.string())))
        return kept

    def may_hold(self, low: str, high: str) -> bool:
        for f in self.filters:
            v = f.value
            out = all(x < low or x > high for x in v) if isinstance(f, In) else (isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and v < low) or (isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and v > high)
            if out:
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        paths = [os.path.join(self.folder, p) for p in pages_of(self.folder)]
        spans = {p: span(p) for p in paths}
        # newer pages that share ids with a page hide its older points
        overlap = lambda a, b: spans[a][0] <= spans[b][1] and spans[b][0] <= spans[a][1]
        return [Page(p, tuple(q for q in paths[k + 1 :] if overlap(p, q))) for k, p in enumerate(paths) if self.may_hold(*spans[p])] or [Page("", ())]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        table = pq.read_table(partition.path)
        kept = self.keeps(table.column("id").combine_chunks())
        for newer in partition.newer:
            kept = pc.and_(kept, pc.invert(pc.is_in(table.column("id").combine_chunks(), pq.read_table(newer, columns=["id"]).column("id").combine_chunks())))
        yield from table.filter(kept).to_batches()


class Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        os.makedirs(folder, exist_ok=True)

    def write(self, iterator) -> Written:
        pages: list[str] = []
        rows: dict[str, tuple] = {}

        def flush():
            if rows:
                name = f"page-{uuid.uuid4().hex}.parquet"
                ids = sorted(rows)
                columns = [pa.array(ids, pa.string()), pa.array([list(rows[i][0]) if rows[i][0] is not None else None for i in ids], pa.list_(pa.float64())), pa.array([rows[i][1] for i in ids], pa.string())]
                pq.write_table(pa.Table.from_arrays(columns, schema=POINTS), os.path.join(self.folder, name))
                pages.append(name)
                rows.clear()

        for r in iterator:
            if r["id"] is None:
                raise ValueError("a point has no id")
            rows[r["id"]] = (r["vector"], r["payload"])
            if len(rows) >= PAGE_ROWS:
                flush()
        flush()
        return Written(tuple(pages))

    def commit(self, messages) -> None:
        new = [p for m in messages if m is not None for p in m.pages]
        publish(self.folder, ([] if self.overwrite else pages_of(self.folder)) + new)

    def abort(self, messages) -> None:
        for m in messages:
            for p in m.pages if m is not None else ():
                os.remove(os.path.join(self.folder, p))


class VectorStore(DataSource):
    """Options: ``path`` of the store, a folder that all executors share; ``collection``."""

    @classmethod
    def name(cls) -> str:
        return "vector_store"

    def schema(self) -> str:
        return SCHEMA

    def folder(self) -> str:
        return os.path.join(self.options["path"], self.options["collection"])

    def reader(self, schema) -> Reader:
        return Reader(self.folder())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.folder(), overwrite)


def register(spark) -> None:
    """Makes the format known to a session, and lets filters reach readers of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorStore)
