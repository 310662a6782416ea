"""Operator 1: the main text of pages by wrapper induction.

Pages are read as trees of blocks, furniture included. The pages of a host are aligned with one of them, a
reference, by simple tree matching. A slot of the reference that has the same text in a share CONSTANT of
the host's distinct pages that align with it belongs to the template, and the slots aligned with it, with
that text, are left out of every page; slots that vary are content. For a short text LEAST pages are
evidence enough; a text of PROSE words, or one within a marked article, must be the same in STRONG pages, as
copies of an article may share it.

Varying furniture (menus of other pages' links, adverts, readers' comments, footers) looks like content to
an alignment. There the markup decides: what elements and roles, or names that say nothing else, mark as
furniture is left out, and where a page marks its article, content lies within it.

A host may have several layouts: its pages are aligned once among all of them and once among those with the
same sequence of containers below the body, with two references each.

Alignment works on packed trees with text hashes; counts are summed before they are shuffled, and a host's
pages may be aligned by any task, as references are broadcast, or else dealt out with a salt.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_tree as tree
from .common import checkpoint, sliced

#: Share of the pages that align with a slot in which a template slot has the same text.
CONSTANT = 0.9
#: Distinct pages that must align with a slot: with a short text, and with prose or within a marked article.
LEAST, STRONG = 3, 8
PROSE = 25
#: References are broadcast up to so many bytes in all; else they are dealt out in SALTS copies.
BROADCAST_BYTES = 64 << 20
SALTS = 16


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1), F.lit("")))


def trees_of(pages: DataFrame) -> DataFrame:
    """(host, layout, tree): the distinct packed trees of each host's pages."""

    def run(batches):
        for batch in sliced(batches, 128):
            roots = [tree.parse(h) if h else None for h in batch.column(1).to_pylist()]
            packed = [r and tree.packed(r) for r in roots]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r and tree.layout(r) for r in roots], pa.int64()), pa.array(packed, pa.binary())], names=["host", "layout", "tree"])

    return pages.mapInArrow(run, "host string, layout long, tree binary").filter("tree IS NOT NULL").distinct()


def with_groups(rows: DataFrame, groups: DataFrame, salt: str, how: str, size) -> DataFrame:
    """``rows`` joined with ``groups`` (host, layout, ...; ``size``: bytes of a row), however many rows a group has."""
    if (groups.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), ["host", "layout"], how)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, ["host", "layout", "salt"], how).drop("salt")


def templates(pages: DataFrame, constant: float = CONSTANT, least: int = LEAST, strong: int = STRONG) -> DataFrame:
    """(host, layout, templates): of groups that have any, an array of (reference, slots, strong).

    A group is a host (layout 0) or a host's layout; the references are two of its pages. ``strong`` are the
    slots with the evidence that prose needs. A group all of whose slots are constant has shown no
    variation, and has no template.
    """
    trees = checkpoint(trees_of(pages))
    # a host with one layout is one group
    several = trees.groupBy("host").agg((F.min("layout") < F.max("layout")).alias("several"))
    trees = trees.withColumn("layout", F.explode(F.array(F.lit(0).cast("long"), "layout")))
    ends = [f("tree", F.xxhash64("tree")) for f in (F.min_by, F.max_by)]
    groups = trees.groupBy("host", "layout").agg(F.array_distinct(F.array(*ends)).alias("references"), F.count("*").alias("pages")).filter(F.col("pages") >= least)
    groups = groups.join(several, "host").filter("several OR layout = 0")
    groups = checkpoint(groups.select("host", "layout", F.posexplode("references").alias("variant", "reference")))

    def run(batches):
        for batch in sliced(batches):
            known: dict[tuple, tuple] = {}
            same, aligned = Counter(), Counter()
            for *group, reference, page in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (key := tuple(group)) not in known:
                    known[key] = tree.unpacked(reference)
                ours, texts = known[key]
                theirs, hashes = tree.unpacked(page)
                for i, j in tree.match(ours, theirs):
                    if texts[i] and hashes[j]:
                        aligned[*key, i] += 1
                        same[*key, i] += texts[i] == hashes[j]
            columns = [*(zip(*aligned, strict=True) if aligned else [[]] * 4), [same[k] for k in aligned], list(aligned.values())]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["host", "layout", "variant", "slot", "same", "aligned"])

    pairs = with_groups(trees, groups, "tree", "inner", F.length("reference")).select("host", "layout", "variant", "reference", "tree")
    counts = pairs.mapInArrow(run, "host string, layout long, variant int, slot int, same long, aligned long")
    counts = counts.groupBy("host", "layout", "variant", "slot").agg(F.sum("same").alias("same"), F.sum("aligned").alias("aligned"))
    fixed = F.col("same") >= constant * F.col("aligned")
    enough = lambda n: F.sort_array(F.collect_list(F.when(fixed & (F.col("aligned") >= n), F.col("slot"))))
    found = counts.groupBy("host", "layout", "variant").agg(enough(least).alias("slots"), enough(strong).alias("strong"), F.count("*").alias("all"))
    some = found.filter((F.size("slots") > 0) & (F.size("slots") < F.col("all"))).join(groups, ["host", "layout", "variant"])
    return some.groupBy("host", "layout").agg(F.sort_array(F.collect_list(F.struct("reference", "slots", "strong"))).alias("templates"))


def main_text(html: str | None, *groups: list[dict] | None) -> str:
    """A page's content without the slots aligned with the templates of its groups."""
    if not html:
        return ""
    root = tree.parse(html)
    constant = set()
    for template in (t for group in groups for t in group or ()):
        ours, texts = tree.unpacked(template["reference"])
        theirs, hashes = tree.unpacked(tree.packed(root))
        fixed, sure = set(template["slots"]), set(template["strong"])
        aligned = {j: i for i, j in tree.match(ours, theirs) if i in fixed and texts[i] == hashes[j]}
        prose = lambda s: s.in_article or s.text.count(" ") + 1 >= PROSE
        constant |= {s.index for s in tree.slots(root) if s.index in aligned and (aligned[s.index] in sure or not prose(s))}
    return " ".join(s.text for s in tree.content(root, frozenset(constant)))


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without its html, with the main text of each whole page in a column ``text``.

    A null or empty html has an empty text. A null url, or one without a host, belongs to the host "".
    Repeated rows and ties are kept, and count once for a template. Depth and number of elements don't
    matter. A column named ``text`` is replaced. An empty table gives an empty one.
    """
    names = {c: f"__{k}" for k, c in enumerate(pages.columns)}
    source = names[html]
    plain = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], host_of(F.col(f"`{url}`")).alias("host"))
    found = checkpoint(templates(plain.select("host", F.col(source).alias("html"))))
    size = F.aggregate("templates", F.lit(0), lambda n, t: n + F.length(t["reference"]) + 8 * F.size(t["slots"]))

    @F.arrow_udf("long")
    def layouts(htmls: pa.Array) -> pa.Array:
        return pa.array([tree.layout(tree.parse(h)) if h else 0 for part in sliced([htmls], 128) for h in part.to_pylist()], pa.int64())

    @F.arrow_udf("string")
    def extracted(htmls: pa.Array, of_host: pa.Array, of_layout: pa.Array) -> pa.Array:
        parts = (zip(*(x.slice(k, 128).to_pylist() for x in (htmls, of_host, of_layout)), strict=True) for k in range(0, len(htmls), 128))
        return pa.array([main_text(*row) for part in parts for row in part], pa.string())

    done = with_groups(plain.withColumn("layout", F.lit(0).cast("long")), found.filter("layout = 0"), source, "left", size).withColumnRenamed("templates", "of_host")
    by_layout = found.filter("layout <> 0")
    if by_layout.isEmpty():
        done = done.withColumn("of_layout", F.lit(None).cast(found.schema["templates"].dataType))
    else:
        done = with_groups(done.withColumn("layout", layouts(F.col(source))), by_layout, source, "left", size).withColumnRenamed("templates", "of_layout")
    done = done.withColumn("text", extracted(F.col(source), F.col("of_host"), F.col("of_layout")))
    return done.select(*[F.col(n).alias(c) for c, n in names.items() if c not in (html, text)], F.col("text").alias(text))


def query(spark, sf_dir):
    """Every page's main text and its length."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
