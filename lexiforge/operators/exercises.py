"""Exercise items: what speaks against one, and copies among them; what makes a block an exercise is in ``functions.rules``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import built
from .impacts import BROADCAST_ROWS, if_small


#: Fixed value: characters of a folded text that tell which rows are alike.
BEGINNING = 180
#: Fixed value: rows of a term that meet in one task; a more frequent term's rows are dealt out in tiles.
TILE = 2_000
#: Fixed value: candidates of a class that are looked at in one round after the first.
RESIDUES = 16


def near_copies(rows: DataFrame, key: str, body: str, least: float = 0.78) -> DataFrame:
    """(key, representative): for each row the first one whose first 180 characters share so many terms with its own.

    Rows with the same terms are one class, which its least key stands for; only classes are compared, so that
    copies make no pairs. Candidates share one of the rarest terms that two such texts cannot all miss, and the
    bit maps of their terms differ in no more places than their terms may. Pairs are never written: each class
    keeps its least candidate, is held against it term by term, and goes on to the next one where that fails.
    A row without terms, or without a like before it, stands for itself.
    """
    terms = F.array_sort(F.array_distinct(F.filter(T.terms(F.substring(F.col(body), 1, 180)), lambda t: F.char_length(t) >= 2)))
    sets = built(rows.select(F.col(key).alias("k"), terms.alias("t")))
    classes = built(sets.filter(F.size("t") > 0).groupBy("t").agg(F.min("k").alias("c")))
    each = classes.select("c", F.explode("t").alias("term"), F.size("t").alias("n")).withColumn("h", F.xxhash64("term"))
    # by rarity, ties by term: two sets with the similarity share a term among the first ones of both
    rare = each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term")
    place = F.row_number().over(Window.partitionBy("c").orderBy("df", "term"))
    reach = F.col("n") - F.ceil(F.col("n") * least / (2 - least) - 1e-9) + 1
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    maps = [F.bit_or(F.when(F.expr(f"(h >> 6) & 3 = {i}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"x{i}") for i in range(4)]
    first = F.collect_list(F.when((F.col("p") <= reach) & (F.col("df") > 1), F.struct("h", F.ceil(F.col("df") / TILE).cast("int").alias("tiles")))).alias("first")
    marked = rare.withColumn("p", place).groupBy("c", "n").agg(*maps, first)
    prefix = built(marked.select("c", "n", "x0", "x1", "x2", "x3", F.inline("first")))
    a = prefix.select("h", F.pmod(F.xxhash64("c"), "tiles").cast("int").alias("tile"), F.col("c").alias("a"), F.col("n").alias("m"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(4)])
    b = prefix.select("h", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("c").alias("b"), "n", "x0", "x1", "x2", "x3")
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(1, 4)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
    # a similarity is rounded to six places
    both = F.col("n") + F.col("m")
    like = (F.abs(F.col("n") - F.col("m")) <= both * (1 - least + 1e-6)) & (apart <= both * (1 - least + 1e-6))
    kind = prefix.schema["c"].dataType
    residue = F.pmod(F.xxhash64("a"), F.lit(RESIDUES)).cast("int")
    left, keys, near = b.withColumn("r", F.lit(0)).withColumn("past", F.lit(None).cast(kind)).withColumn("best", F.lit(None).cast(kind)), ["h", "tile"], None
    while True:
        met = a.withColumn("r", residue).join(left, keys) if near is not None else a.join(left, keys)
        open_ = F.coalesce(F.col("a") > F.col("past"), F.lit(True)) & (F.col("a") < F.coalesce("best", "b"))
        least_of = met.filter(open_ & like).groupBy("b", "r").agg(F.min("a").alias("a"), F.min("best").alias("best"))
        held = least_of.join(classes.select(F.col("c").alias("a"), F.col("t").alias("s")), "a").join(classes.select(F.col("c").alias("b"), "t"), "b")
        judged = built(held.select("b", "r", "a", "best", (F.round(T.dice(F.col("s"), F.col("t")), 6) >= least).alias("found")))
        found = judged.filter("found").select("b", F.col("a").alias("near"))
        open_rows = judged.filter("NOT found").select("b", "r", F.col("a").alias("past"), "best")
        # from the second round on a class has a candidate of each residue, so that few rounds are left
        more = open_rows.drop("r").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(RESIDUES - 1)))) if near is None else open_rows
        more = built(more.join(found.groupBy("b").agg(F.min("near").alias("near")), "b", "left").withColumn("best", F.least("best", "near")).filter("best IS NULL OR past < best").drop("near"))
        near = found if near is None else near.unionByName(found)
        if more.isEmpty():
            break
        left, keys = b.join(if_small(more, BROADCAST_ROWS), "b"), ["h", "tile", "r"]
    near = near.groupBy("b").agg(F.min("near").alias("near"))
    own = sets.join(classes, "t", "left").join(near.withColumnRenamed("b", "c"), "c", "left")
    return own.select(F.col("k").alias(key), F.coalesce("near", "c", "k").alias("representative"))


#: Fixed value: pairs for each class that may be written; while there are more, each class keeps its least candidate.
PAIRS = 8
#: The columns of a bit map of 256 bits.
MAP = ("x0", "x1", "x2", "x3")


def bit_map(h: str) -> list[Column]:
    """The bit map of a group's hashes."""
    bit = F.expr(f"shiftleft(1L, CAST({h} & 63 AS INT))")
    return [F.bit_or(F.when(F.expr(f"({h} >> 6) & 3 = {i}"), bit).otherwise(F.lit(0).cast("long"))).alias(x) for i, x in enumerate(MAP)]


#: What a verdict says, in the order in which it says it.
EMPTY_PROMPT, BAD_LEVEL, NO_TYPE, OTHER_LEVEL = "consigne vide", "niveau invalide (%s)", "type d'exercice manquant", "niveau (%s) != demandé (%s)"
NOT_ARABIC, MIXED = "arabe requis mais texte non arabe", "mélange français/arabe"
NO_OPTIONS, SAME_OPTIONS, ANSWER_MISSING, LIKE_OPTIONS = "QCM sans options", "options identiques", "réponse correcte absente des options", "options quasi identiques"
NO_TRUTH, NO_ANSWER, NO_WORDS, WORD_MISSING = "vrai/faux sans réponse", "réponse attendue manquante", "mots à ordonner absents", "mot essentiel manquant pour reconstruire la phrase"
COPIED = "la correction recopie la consigne"
#: Types that need an answer, and types that need none.
ANSWERED, OPEN = ("complete", "matching", "grammar_transformation"), ("open_question", "writing", "reading_comprehension")
#: How like two options, and how Latin an Arabic text may be.
LIKE_OPTION, LATIN_SHARE = 0.9, 0.15
ARABIC, LATIN = r"[؀-۾ݐ-ݾﭐ-﷾ﹰ-﻾]", r"[A-Za-zÀ-Ɏ]"
_MARK = "\u0001"


def word_list(folded: Column) -> Column:
    """Words of two characters or more of a folded text."""
    return F.filter(F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.char_length(w) >= 2)


def too_latin(c: Column) -> Column:
    """Whether a text with Arabic letters has more Latin ones among both than it may."""
    arabic, latin = F.regexp_count(c, F.lit(ARABIC)), F.regexp_count(c, F.lit(LATIN))
    return (arabic > 0) & (latin / (arabic + latin) > LATIN_SHARE)


def verdicts(items: DataFrame) -> DataFrame:
    """``items`` with ``reasons``: what speaks against each, none for a sound one.

    ``items`` has level, exercise_type, prompt, answer, options (array<string>), is_true, left_right
    (array<string>, both sides of its pairs), request_level, language. An answer that is to be put in order must
    be made of the words of its prompt; near copies of options are told by the Dice similarity of their words.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    options = F.filter(F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda o: F.trim(F.coalesce(o, F.lit("")))), lambda o: o != "")
    base = items.withColumn("__o", options).withColumn("__p", blank("prompt")).withColumn("__a", blank("answer"))
    folded = base.withColumn("__np", T.folded(F.col("__p"))).withColumn("__na", T.folded(F.col("__a"))).withColumn("__no", F.split(T.folded(F.array_join("__o", _MARK)), _MARK))
    words = folded.withColumn("__wo", F.transform("__no", word_list)).withColumn("__wp", word_list(F.col("__np"))).withColumn("__wa", word_list(F.col("__na")))
    kind, level = F.lower(blank("exercise_type")), F.upper(F.coalesce("level", F.lit("")))
    prompt, answer, n = F.col("__p"), F.col("__a"), F.size("__o")
    lower_options = F.transform("__o", lambda o: F.lower(o))
    learner = F.concat(F.coalesce("options", F.array().cast("array<string>")), F.coalesce("left_right", F.array().cast("array<string>")), F.array("__a"))
    arabic = F.col("language") == "ar"
    has_arabic = lambda c: F.coalesce(F.regexp(c, F.lit(r"[؀-ۿ]")), F.lit(False))
    like = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.exists(F.sequence(i, F.greatest(n, i)), lambda j: (j > i) & (T.dice(F.get("__wo", i - 1), F.get("__wo", j - 1)) >= LIKE_OPTION)))
    known = kind.isin("qcm", "true_false", "ordering", *ANSWERED, *OPEN)
    ordering = (kind == "ordering") & (answer != "")
    said = [
        (prompt == "", F.lit(EMPTY_PROMPT)),
        ((level != "") & ~level.isin(*T.LEVELS), F.format_string(BAD_LEVEL, "level")),
        (kind == "", F.lit(NO_TYPE)),
        ((F.coalesce("request_level", F.lit("")) != "") & (level != "") & (level != F.upper("request_level")), F.format_string(OTHER_LEVEL, "level", "request_level")),
        (arabic & (F.char_length(prompt) >= 12) & ~has_arabic(prompt), F.lit(NOT_ARABIC)),
        (arabic & (F.char_length(prompt) >= 12) & has_arabic(prompt) & too_latin(prompt), F.lit(MIXED)),
        (arabic & F.exists(learner, lambda x: F.coalesce(has_arabic(x) & too_latin(x), F.lit(False))), F.lit(MIXED)),
        ((kind == "qcm") & (n == 0), F.lit(NO_OPTIONS)),
        ((kind == "qcm") & (F.size(F.array_distinct(lower_options)) != n), F.lit(SAME_OPTIONS)),
        ((kind == "qcm") & (answer != "") & (n > 0) & ~F.array_contains(lower_options, F.lower(answer)), F.lit(ANSWER_MISSING)),
        ((kind == "qcm") & (n > 1) & like, F.lit(LIKE_OPTIONS)),
        ((kind == "true_false") & F.col("is_true").isNull() & (answer == ""), F.lit(NO_TRUTH)),
        (kind.isin("ordering", *ANSWERED) & (answer == ""), F.lit(NO_ANSWER)),
        (ordering & (F.size("__wp") == 0), F.lit(NO_WORDS)),
        (ordering & (F.size("__wp") > 0) & (F.size(F.array_except("__wa", "__wp")) > 0), F.lit(WORD_MISSING)),
        (~known & (prompt == ""), F.lit(EMPTY_PROMPT)),
        ((F.col("__na") != "") & F.contains("__np", F.col("__na")), F.lit(COPIED)),
    ]
    return words.withColumn("reasons", F.array_compact(F.array(*[F.when(test, what) for test, what in said]))).select(*items.columns, "reasons")


def kept_in_order(rows: DataFrame, group: str, order: str, body: str, least: float = 0.78) -> DataFrame:
    """(group, order, kept): a row goes only if an earlier row of its group that is kept itself is like it.

    Likeness is the Dice similarity of the words in the first 180 characters of the folded text; a row without
    words is always kept. ``order`` is unique in a group. Rows with the same words are one class, for which the
    first speaks; all others of it go. Candidates share one of the rarest words that two such texts cannot all
    miss, and the bit maps of their words differ in no more places than their words may. While these are many,
    pairs aren't written: each class keeps its least candidate, and goes if that one is kept and like it. What
    remains is settled by links in rounds: a class that no undecided or kept earlier one is like is kept, and
    those like it go; a round decides at least the first undecided class of each group.
    """
    words = F.array_sort(F.array_distinct(word_list(F.substring(T.folded(T.head(F.coalesce(F.col(body), F.lit("")), BEGINNING)), 1, BEGINNING))))
    sets = built(rows.select(F.col(group).alias("g"), F.col(order).alias("o"), words.alias("t")))
    classes = built(sets.filter(F.size("t") > 0).groupBy("g", "t").agg(F.min("o").alias("o")))
    each = classes.select("g", "o", F.size("t").alias("n"), F.explode(F.transform("t", lambda w: F.xxhash64(w))).alias("h"))
    counted = each.join(each.groupBy("g", "h").agg(F.count("*").alias("df")), ["g", "h"])
    place = F.row_number().over(Window.partitionBy("g", "o").orderBy("df", "h"))
    reach = F.col("n") - F.ceil(F.col("n") * least / (2 - least) - 1e-9) + 1
    first = F.collect_list(F.when((F.col("p") <= reach) & (F.col("df") > 1), F.struct("h", F.ceil(F.col("df") / TILE).cast("int").alias("tiles")))).alias("first")
    marked = counted.withColumn("p", place).groupBy("g", "o", "n").agg(*bit_map("h"), first)
    prefix = built(marked.select("g", "o", "n", *MAP, F.inline("first")))
    a = prefix.select("g", "h", F.pmod(F.xxhash64("o"), "tiles").cast("int").alias("tile"), F.col("o").alias("a"), F.col("n").alias("m"), *[F.col(x).alias(f"y{x}") for x in MAP])
    b = prefix.select("g", "h", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("o").alias("b"), "n", *MAP)
    # sizes bound the similarity: 2 min / (n + m)
    both = F.col("n") + F.col("m")
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"y{x}"))) for x in MAP[1:]), F.bit_count(F.col(MAP[0]).bitwiseXOR(F.col(f"y{MAP[0]}"))))
    like = (F.col("a") < F.col("b")) & (2 * F.least("n", "m") >= least * both - 1e-9) & (differ <= both * (1 - least + 1e-6))
    most = PAIRS * classes.count()

    def judged(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(classes.select("g", F.col("o").alias("a"), F.col("t").alias("s")), ["g", "a"]).join(classes.select("g", F.col("o").alias("b"), "t"), ["g", "b"])
        return sides.withColumn("like", F.round(T.dice(F.col("s"), F.col("t")), 9) >= least).drop("s", "t")

    gone, left = None, b.withColumn("past", F.lit(None).cast(prefix.schema["o"].dataType))
    while True:
        there = a if gone is None else a.join(if_small(gone.withColumnRenamed("b", "a"), BROADCAST_ROWS), ["g", "a"], "left_anti")
        met = there.join(left, ["g", "h", "tile"]).filter(like & F.coalesce(F.col("a") > F.col("past"), F.lit(True)))
        nearest = built(met.groupBy("g", "b").agg(F.min("a").alias("a"), F.max("past").alias("past"), F.count("*").alias("pairs")))
        if (nearest.agg(F.sum("pairs")).first()[0] or 0) <= most:
            links = built(judged(met.select("g", "a", "b").distinct()).filter("like").select("g", "a", "b"))
            break
        # a class without a candidate is kept for sure
        open_ = nearest.select("g", F.col("b").alias("a"), F.lit(True).alias("open"))
        seen = built(judged(nearest.select("g", "a", "b", "past")).join(open_, ["g", "a"], "left"))
        out = built(seen.filter("like AND open IS NULL").select("g", "b"))
        gone = out if gone is None else gone.unionByName(out)
        past = seen.filter("NOT like OR open").select("g", "b", F.when(F.col("like"), F.col("past")).otherwise(F.col("a")).alias("past"))
        left = b.join(if_small(past, BROADCAST_ROWS), ["g", "b"])
    while not links.isEmpty():
        later = links.select("g", F.col("b").alias("a")).distinct()
        kept = links.select("g", "a").distinct().join(later, ["g", "a"], "left_anti")
        out = built(links.join(kept, ["g", "a"], "left_semi").select("g", "b").distinct())
        gone = out if gone is None else gone.unionByName(out)
        # links of classes that are decided now: all links to those that go, all from them, all from those kept
        rest = links.join(out, ["g", "b"], "left_anti").join(out.withColumnRenamed("b", "a"), ["g", "a"], "left_anti")
        links = built(rest)
    own = sets.join(classes.select("g", "t", F.col("o").alias("c")), ["g", "t"], "left")
    first = F.col("c").isNull() | (F.col("c") == F.col("o"))
    if gone is not None:
        own = own.join(gone.select("g", F.col("b").alias("c"), F.lit(True).alias("like")), ["g", "c"], "left")
        first = first & F.col("like").isNull()
    return own.select(F.col("g").alias(group), F.col("o").alias(order), first.alias("kept"))
