"""Text expressions: cleaning, tokens, scripts, levels, digests."""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, line ends and blanks alike.
SPACE = r"[\p{Z}\x09-\x0D]+"
#: The six levels, from the lowest.
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
#: Characters that stay as they are in normal form C, wherever they stand.
SETTLED = r"\x00-\u02FF\u0400-\u0482\u048A-\u0513\u0620-\u064A\u0660-\u066F\u0671-\u06D5\u2010-\u206F\u20A0-\u20C0\u2190-\u21FF\u3001-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"
#: Texts that a worker holds as Python objects at once.
SLICE = 64


def each(texts: pa.Array, of, kind: pa.DataType) -> pa.Array:
    """``of`` every text that isn't null, some texts at a time."""
    parts = [pa.array([None if t is None else of(t) for t in texts.slice(k, SLICE).to_pylist()], kind) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def uncomposed(c: Column) -> Column:
    """A text that may not be in Unicode normal form C, else null."""
    return F.when(~is_ascii(c) & F.regexp(c, F.lit(r"[^\x00-\u02FF]")) & F.regexp(c, F.lit(f"[^{SETTLED}]")), c)


def composed(c: Column) -> Column:
    """In Unicode normal form C. Only texts that may change go to a Python worker."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return each(texts, lambda t: unicodedata.normalize("NFC", t), pa.string())

    return F.coalesce(run(uncomposed(c)), c)


def collapsed(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalized(c: Column) -> Column:
    """Collapsed and in lower case: equal for texts that differ in layout and case only."""
    return F.lower(collapsed(c))


def cleaned(c: Column) -> Column:
    """Control characters dropped, lines trimmed and their blanks collapsed, at most one empty line in a row."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.regexp_replace(lines, r"[ \t]+", " ")
    lines = F.regexp_replace(F.regexp_replace(lines, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"^[ \n]+|[ \n]+$", "")


def terms(c: Column) -> Column:
    """Words in lower case: letters and digits, with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*)"), 1)


def token_estimate(c: Column) -> Column:
    """Words and single other characters."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{Z}\x09-\x0D\p{L}\p{N}_]"))


def preview(c: Column, most: int) -> Column:
    """Collapsed, and cut to ``most`` characters, the last being an ellipsis, where longer."""
    flat = collapsed(c)
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def dice(a: Column, b: Column) -> Column:
    """Twice the common elements of two arrays over the elements of both, as sets; 0 for two empty ones."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    n = F.size(x) + F.size(y)
    return F.when(n > 0, 2 * F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def level_of(c: Column) -> Column:
    """A level name in any case and with blanks or a PRE- prefix, or null."""
    name = F.upper(F.regexp_replace(c, r"[\s_]", ""))
    name = F.when(name.isin("PREA1", "PRE-A1"), "A1").otherwise(name)
    return F.when(name.isin(*LEVELS), name)


def chunk_digest(content: Column, kind: Column, page_start: Column, page_end: Column, version: str) -> Column:
    """SHA-256 over the collapsed content and what else makes a chunk, as JSON with keys in order."""
    whole = F.struct(collapsed(content).alias("content"), kind.alias("content_type"), F.lit(version).alias("ingestion_version"), F.array(page_start, page_end).alias("pages"))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def name_uuid(namespace_hex: str, name: Column) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def digest_vector(c: Column, dimensions: int = 8) -> Column:
    """A deterministic stand-in for an embedding: 32-bit slices of SHA-256, as fractions of one."""
    h = F.sha2(c, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967296.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def folded(c: Column) -> Column:
    """Without marks, in folded case, collapsed: texts that differ in accents and case only are equal. ASCII stays with Spark."""
    def plain(t: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn").casefold()

    @F.arrow_udf("string")
    def fold(texts: pa.Array) -> pa.Array:
        return each(texts, plain, pa.string())

    return collapsed(F.coalesce(fold(F.when(~is_ascii(c), c)), F.lower(c)))


def head(c: Column, n: int) -> Column:
    """The beginning with the first ``n`` letters and digits, or all of a text with fewer: enough for the first ``n`` characters of its folded form, as marks and blanks don't count."""
    start = F.regexp_extract(c, rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{n}}}", 0)
    return F.when(start != "", start).otherwise(c)


def term_id(c: Column) -> Column:
    """The stable 31-bit number of a term: the first four bytes of its BLAKE2b digest of that size, without the sign."""
    @F.arrow_udf("long")
    def number(terms: pa.Array) -> pa.Array:
        return pa.array([None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big") & 0x7FFFFFFF for t in terms.to_pylist()], pa.int64())

    return number(c)
