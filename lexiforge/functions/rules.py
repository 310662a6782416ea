"""Rules over texts, stated as SQL expressions: quality, levels, roles, skills, exercises, requests.

A rule is a list of steps, each a dictionary of new columns; ``applied`` adds them to a DataFrame and
``stated`` to a SELECT. The spelling of regex and array functions comes from a dialect, so that the same
rule can be held against another engine. Patterns that both run use no look-around and no word boundaries,
whose meaning differs between engines; where the dialects count in different ways, each has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
BLANK = r"\p{Z}\x09-\x0D"
#: Punctuation that may stand at a word's ends.
ENDS = ".,;:!?…؟"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"


class Spark:
    size, lit_quote = "size", '"'

    def lit(self, s: str) -> str:
        return f'"{s}"'

    def has(self, c: str, p: str) -> str:
        return f'regexp_like({c}, r"{p}")'

    def count(self, c: str, p: str) -> str:
        return f'regexp_count({c}, r"{p}")'

    def every(self, c: str, p: str) -> str:
        return f'regexp_extract_all({c}, r"{p}", 0)'

    def first(self, c: str, p: str, group: int = 0) -> str:
        return f'regexp_extract({c}, r"{p}", {group})'

    def sub(self, c: str, p: str, by: str = "") -> str:
        return f'regexp_replace({c}, r"{p}", "{by}")'

    def split(self, c: str, p: str) -> str:
        return f'split({c}, r"{p}")'

    def keep(self, a: str, x: str, test: str) -> str:
        return f"filter({a}, {x} -> {test})"

    def each(self, a: str, x: str, e: str) -> str:
        return f"transform({a}, {x} -> {e})"

    def join(self, a: str, by: str) -> str:
        return f'array_join({a}, "{by}")'

    def repeated_symbols(self, c: str) -> str:
        return rf'regexp_count({c}, r"([^\p{{L}}\p{{N}}_{BLANK}])\1{{2,}}")'

    # one pass over the text each; the other engine, which has no look-around, filters lists of words

    def most(self, c: str, p: str) -> str:
        """How many characters aren't in a class that is given with ``^``: of a class that most are in."""
        return f"(length({c}) - {self.count(c, p.replace('[^', '[', 1) if p.startswith('[^') else p.replace('[', '[^', 1))})"

    def glyphs(self, c: str) -> str:
        """Above 0 if a text holds the name of a glyph."""
        return f"CAST({any_of(self, f'lower({c})', GLYPHS)} AS INT)"

    def words_in(self, c: str, words: str) -> str:
        return self.count(c, f"{W}+")

    def single(self, c: str, words: str) -> str:
        return self.count(c, f"(?<!{W}){W}(?!{W})")

    def meant(self, c: str, words: str) -> str:
        return self.count(c, rf"(?<!{W})(?=[\p{{N}}_]*+\p{{L}}){W}{{3,}}+")

    def suspicious(self, c: str, words: str) -> str:
        return self.count(c, rf"(?<!{W})(?=[0-9]*+[A-Za-z])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{3,}}+(?!{W})")

    def mixed(self, c: str, mixed: str, inside: str = "") -> str:
        """How many tokens with a letter there are, or of these those with a digit or a symbol ``inside``."""
        at = rf"(?<![^{BLANK}])(?=[^\p{{L}}{BLANK}]*+\p{{L}})"
        also = {"": "", "digit": rf"(?=[^\p{{Nd}}{BLANK}]*+\p{{Nd}})", "symbol": rf"(?=[{ENDS}]*+[\p{{L}}\p{{N}}]*+(?:[^\p{{L}}\p{{N}}{ENDS}{BLANK}]|[{ENDS}]++[^{ENDS}{BLANK}]))"}
        return self.count(c, rf"{at}{also[inside]}[^{BLANK}]++")

    def hints(self, c: str, words: str, some: str) -> str:
        """How many different words of a text are among some, in any case."""
        found = self.every(c, f"(?iu)(?<!{W})(?:{some})(?!{W})")
        return f"size({self.keep(f'array_distinct({found})', 'w', self.has('lower(w)', f'^(?:{some})$'))})"

    def once(self, columns: dict[str, str]) -> tuple[list[dict[str, str]], dict[str, str]]:
        """A step of columns that are computed once, and how later steps name them."""
        return [columns], {k: k for k in columns}

    def url_or_mail(self) -> str:
        """A run of an address's characters is looked at once, not anew from each of them."""
        before, after = URL_OR_MAIL.split(f"{MAIL}+@")
        return rf"{before}(?:(?<!{MAIL})|\G){MAIL}++@{after}"


class Duck(Spark):
    """The spelling of the reference engine that queries are held against."""

    size = "len"

    def lit(self, s):
        return "'" + s.replace("'", "''") + "'"

    def has(self, c, p):
        return f"regexp_matches({c}, {self.lit(p)})"

    def count(self, c, p):
        return f"len(regexp_extract_all({c}, {self.lit(p)}))"

    def every(self, c, p):
        return f"regexp_extract_all({c}, {self.lit(p)})"

    def first(self, c, p, group=0):
        return f"regexp_extract({c}, {self.lit(p)}, {group})"

    def sub(self, c, p, by=""):
        return f"regexp_replace({c}, {self.lit(p)}, {self.lit(by)}, 'g')"

    def split(self, c, p):
        return f"regexp_split_to_array({c}, {self.lit(p)})"

    def keep(self, a, x, test):
        return f"list_filter({a}, lambda {x}: {test})"

    def each(self, a, x, e):
        return f"list_transform({a}, lambda {x}: {e})"

    def join(self, a, by):
        return f"array_to_string({a}, {self.lit(by)})"

    def repeated_symbols(self, c):
        runs = self.every(c, rf"[^\p{{L}}\p{{N}}_{BLANK}]{{3,}}")
        starts = "len(list_filter(range(3, length(r) + 1), lambda i: r[i] = r[i - 1] AND r[i] = r[i - 2] AND (i = 3 OR r[i - 3] <> r[i])))"
        return f"coalesce(list_sum(list_transform({runs}, lambda r: {starts})), 0)"

    def most(self, c, p):
        return self.count(c, p)

    def glyphs(self, c):
        return "(" + " + ".join(self.count(f"lower({c})", g) for g in GLYPHS) + ")"

    def words_in(self, c, words):
        return f"len({words})"

    def single(self, c, words):
        return f"len({self.keep(words, 'w', 'length(w) = 1')})"

    def meant(self, c, words):
        return f"len({self.keep(words, 'w', 'length(w) >= 3 AND ' + self.has('w', r'\p{L}'))})"

    def suspicious(self, c, words):
        return f"len({self.keep(words, 'w', ' AND '.join(self.has('w', x) for x in ('^[A-Za-z0-9]{3,}$', '[0-9]', '[A-Za-z]')))})"

    def mixed(self, c, mixed, inside=""):
        inner = self.sub("x", rf"^[{ENDS}]+|[{ENDS}]+$")
        kept = {"": mixed, "digit": self.keep(mixed, "x", self.has("x", r"\p{Nd}")), "symbol": self.keep(mixed, "x", self.has(inner, r"[^\p{L}\p{N}]"))}
        return f"len({kept[inside]})"

    def hints(self, c, words, some):
        return f"len({self.keep(f'list_distinct({words})', 'w', self.has('lower(w)', f'^(?:{some})$'))})"

    def once(self, columns):
        return [], columns

    def url_or_mail(self):
        return URL_OR_MAIL


def num(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def any_of(d: Spark, c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {d.lit(w)})" for w in words) + ")"


def how_many(d: Spark, c: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({c}, {d.lit(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def word_in(words: str) -> str:
    """One of some words, as a word of its own."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:[^\p{{L}}\p{{N}}_]|$)"


def trimmed(d: Spark, c: str) -> str:
    return d.sub(c, rf"^[{BLANK}]+|[{BLANK}]+$")


def first_of(cases: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in cases) + f" ELSE {other} END"


def reasons(cases: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in cases) + ")"


def applied(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in step.items()])
    return df


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns as computed once: a filter on them isn't pushed below, where it would repeat their rules."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def stated(source: str, steps: list[dict[str, str]]) -> str:
    for step in steps:
        source = "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM {source})"
    return source


# Quality of extracted text

#: Names of glyphs that stand in a text whose font wasn't decoded.
GLYPHS = "alefisolated alefinitial alefmedial behinitial hehinitial meemmedial thalfinal fathalow fatha kasra damma sukun shadda arabicindicdigit".split()
#: Words that tell French and English.
HINTS = {
    "fr": "le|la|les|des|un|une|et|avec|dans|pour|réponds|texte|lis|consigne",
    "en": "the|and|with|read|make|sentences|answer|text|instructions",
}
#: Bounds of the score for a passed, a certain and a borderline text.
PASSED, CERTAIN, BORDERLINE = 0.65, 0.85, 0.60


def quality(d: Spark, c: str, p: str = "q_") -> list[dict[str, str]]:
    """Counts, ratios, score, reasons, languages, passed of a text; names begin with ``p``."""
    t, words, tokens, mixed = f"{p}t", f"{p}words", f"{p}tokens", f"{p}mixed"
    seen = lambda b: f"{p}{b}"
    ratio = lambda a, b, none: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE {num(none)} END"
    counts = {seen(f"{k}_hints"): d.hints(t, words, HINTS[k]) for k in HINTS} | {seen(f"mixed_{k}"): d.mixed(t, mixed, k) for k in ("", "digit", "symbol")}
    counted, told = d.once(counts)
    hints = lambda k: f"{told[seen(f'{k}_hints')]} >= 2 AND {seen('meaningful')} >= {num(0.5)}"
    n, symbols, single = seen("n_words"), seen("symbol_ratio"), seen("single_ratio")
    checks = {
        "empty_text": f"{t} = ''",
        "glyph_noise": f"{seen('glyphs')} > 0",
        "replacement_characters": f"{seen('broken')} > 0",
        "control_characters": f"{seen('controls')} > 0",
        "low_letter_ratio": f"{seen('arabic_ratio')} + {seen('latin_ratio')} < {num(0.45)}",
        "high_symbol_ratio": f"{symbols} > {num(0.25)}",
        "high_single_character_token_ratio": f"{single} > {num(0.55)} AND {n} >= 4",
        "repeated_symbols": f"{seen('repeated_ratio')} > {num(0.1)}",
        "suspicious_ascii_sequences": f"{seen('suspicious')} >= 2 AND ({symbols} > {num(0.1)} OR {single} > {num(0.35)})",
        "digit_inside_word_ratio": f"{seen('digit_inside')} > {num(0.2)}",
        "symbol_inside_word_ratio": f"{seen('symbol_inside')} > {num(0.2)}",
        "low_meaningful_word_ratio": f"{seen('meaningful')} < {num(0.35)} AND {n} >= 4",
    }
    loss = {
        "glyph_noise": num(0.8),
        "replacement_characters": f"least({num(0.5)}, {seen('broken')} * {num(0.1)})",
        "control_characters": f"least({num(0.4)}, {seen('controls')} * {num(0.1)})",
        "low_letter_ratio": num(0.4),
        "high_symbol_ratio": f"least({num(0.35)}, {symbols})",
        "high_single_character_token_ratio": num(0.25),
        "repeated_symbols": num(0.2),
        "suspicious_ascii_sequences": num(0.3),
        "digit_inside_word_ratio": f"least({num(0.35)}, {seen('digit_inside')} * {num(0.45)})",
        "symbol_inside_word_ratio": f"least({num(0.3)}, {seen('symbol_inside')} * {num(0.4)})",
        "low_meaningful_word_ratio": num(0.22),
    }
    score = f"CASE WHEN {t} = '' THEN {num(0)} ELSE {num(0.95)} END" + "".join(f" - CASE WHEN {checks[k]} THEN {v} ELSE {num(0)} END" for k, v in loss.items())
    hard = ("empty_text", "glyph_noise", "replacement_characters", "control_characters")
    return [
        {t: trimmed(d, f"coalesce({c}, '')")},
        {
            words: d.every(t, f"{W}+"),
            tokens: d.every(t, rf"[^{BLANK}]+"),
            seen("chars"): d.most(t, rf"[^{BLANK}]"),
            seen("arabic"): d.count(t, rf"[{ARABIC}]"),
            seen("latin"): d.most(t, r"[A-Za-zÀ-ÖØ-öø-ÿ]"),
            seen("digits"): d.count(t, r"\p{Nd}"),
            seen("symbols"): d.count(t, rf"[^\p{{L}}\p{{N}}{BLANK}{ARABIC}]"),
            seen("glyphs"): d.glyphs(t),
            seen("broken"): d.count(t, r"\x{FFFD}"),
            seen("controls"): d.count(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\p{Cf}\p{Co}]"),
            seen("repeated"): d.repeated_symbols(t),
        },
        {
            n: d.words_in(t, words),
            seen("single"): d.single(t, words),
            seen("meant"): d.meant(t, words),
            seen("suspicious"): d.suspicious(t, words),
            mixed: d.keep(tokens, "x", d.has("x", r"\p{L}")),
        },
        *counted,
        {
            single: ratio(seen("single"), n, 1),
            seen("meaningful"): ratio(seen("meant"), n, 0),
            seen("digit_inside"): ratio(told[seen("mixed_digit")], told[seen("mixed_")], 0),
            seen("symbol_inside"): ratio(told[seen("mixed_symbol")], told[seen("mixed_")], 0),
            seen("repeated_ratio"): f"CAST({seen('repeated')} AS DOUBLE) / greatest(1, {n})",
            **{seen(f"{k}_ratio"): f"CAST({seen(v)} AS DOUBLE) / greatest(1, {seen('chars')})" for k, v in (("arabic", "arabic"), ("latin", "latin"), ("symbol", "symbols"))},
        },
        {
            seen("score"): f"round(greatest({num(0)}, least({num(1)}, {score})), 6)",
            seen("reasons"): reasons(list(checks.items())),
            seen("sound"): f"NOT ({' OR '.join(checks[k] for k in hard)})",
            seen("languages"): f"concat_ws(',', CASE WHEN {seen('arabic')} > 0 THEN 'ar' END, CASE WHEN {seen('latin')} > 0 AND {hints('fr')} THEN 'fr' END, CASE WHEN {seen('latin')} > 0 AND {hints('en')} THEN 'en' END, "
            f"CASE WHEN {seen('latin')} > 0 AND NOT ({hints('fr')}) AND NOT ({hints('en')}) THEN 'latin' END)",
        },
        {seen("passed"): f"{seen('sound')} AND {seen('score')} >= {num(PASSED)}"},
    ]


def native_level(d: Spark, arabic_profile: str = "false", p: str = "q_") -> list[dict[str, str]]:
    """``hard``: corrupted beyond doubt; ``native``: how far a page's own text can be trusted. After ``quality``."""
    seen = lambda b: f"{p}{b}"
    hard = f"{seen('glyphs')} > 0 OR {seen('broken')} > 0 OR ({seen('suspicious')} >= 2 AND ({seen('digit_inside')} > {num(0.15)} OR {seen('symbol_inside')} > {num(0.15)}))"
    mismatch = f"{arabic_profile} AND {seen('arabic')} = 0 AND contains({seen('languages')}, 'latin') AND {seen('meaningful')} < {num(0.7)}"
    return [
        {"hard": hard, "mismatch": mismatch},
        {"native": first_of([(f"hard OR {seen('score')} < {num(BORDERLINE)}", "'corrupted'"), (f"{seen('score')} >= {num(CERTAIN)} AND NOT mismatch", "'high_confidence'")], "'borderline'")},
    ]


def table_cells(d: Spark, c: str) -> list[dict[str, str]]:
    """Cells of the rows with bars: ``cells`` that aren't empty, ``told`` with a letter or digit, ``usable`` as a table."""
    rows = d.keep(d.split(f"coalesce({c}, '')", r"\n"), "r", "contains(r, '|')")
    cells = d.keep(d.split(d.join(rows, "|"), r"\|"), "x", d.has("x", rf"[^{BLANK}\-:]"))
    return [
        {"cell_list": cells},
        {"cells": f"{d.size}(cell_list)", "told": f"{d.size}({d.keep('cell_list', 'x', d.has('x', r'[\p{L}\p{N}]'))})"},
        {"usable": f"cells >= 2 AND told >= {num(0.5)} * cells"},
    ]


def page_decision(d: Spark) -> list[dict[str, str]]:
    """Whether a page's own text is used or it is to be read anew, and why. After ``native_level`` and ``table_cells``."""
    why = [("native = 'high_confidence'", "'high_confidence_native_text'"), ("usable AND NOT hard", "'borderline_but_structurally_usable_table'"), ("hard", "'hard_corruption'")]
    return [{"decision": first_of(why, "'native_text_quality_uncertain'")}, {"native_usable": "decision IN ('high_confidence_native_text', 'borderline_but_structurally_usable_table')"}]


MAIL = r"[\p{L}\p{N}_.+\-]"
URL_OR_MAIL = r"(?:https?://|www\.)[^\s<>()]+|[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)+"
REFERENCE = r"(?:[a-c][1-2]\+?|cm[0-9]+|[0-9]{1,4}(?:er|e|ème)?|mene[0-9]+[a-z]?)"


def chunk_class(d: Spark, c: str, kind: str, tokens: str) -> list[dict[str, str]]:
    """``chunk_class`` and ``chunk_reason``: the first that holds. Decoration and references are no corruption."""
    bare = d.sub(d.sub(f"lower(coalesce({c}, ''))", d.url_or_mail(), " "), rf"(^|[^\p{{L}}\p{{N}}_]){REFERENCE}([^\p{{L}}\p{{N}}_]|$)", " ")
    poor = f"(b_score < {num(0.45)} OR b_single_ratio > {num(0.55)})"
    cited = f"{d.has(c, '(?i)' + d.url_or_mail())} AND NOT {d.has('bare', r'\p{L}')}"
    counted, told = d.once({"cited": cited})
    cases = [
        ("compact = 0", "low_information", "empty"),
        (f"compact <= 48 AND letters <= 2 AND q_n_words <= 2 AND (decoration >= {num(0.35)} * greatest(1, compact) OR {tokens} <= 3) AND {kind} <> 'table'", "low_information", "decorative_or_blank_field"),
        ("q_glyphs > 0", "corrupted", "glyph_noise"),
        (f"{kind} = 'table' AND letters + q_digits >= 1", "valid_semantic", "meaningful_table_cell"),
        (told["cited"], "low_information", "structured_reference"),
        (f"compact >= 12 AND b_suspicious >= 2 AND ({poor} OR b_symbol_ratio > {num(0.3)})", "corrupted", "severe_random_ascii_corruption"),
        (f"compact >= 40 AND {poor}", "corrupted", "substantial_extraction_garbage"),
    ]
    return [
        *quality(d, c),
        {"bare": bare},
        *quality(d, "bare", "b_"),
        *counted,
        {"compact": "q_chars", "letters": d.count("q_t", r"\p{L}"), "decoration": d.count("q_t", "[_.–—□☐☑▪•-]")},
        {"chunk_class": first_of([(t, f"'{k}'") for t, k, _ in cases], "'valid_semantic'"), "chunk_reason": first_of([(t, f"'{r}'") for t, _, r in cases], "'semantic_content'")},
    ]


# Levels, skills, roles

#: Levels in order, and Arabic letters for theirs.
LEVELS = ("PRE-A1", "A1", "A2", "B1", "B2", "C1", "C2")
SIMPLE = ("et", "ou", "puis", "alors", "parce que", "avec", "و", "ثم", "أو", "لكن", "لأن")
COMPLEX = ("cependant", "néanmoins", "par conséquent", "en revanche", "de plus", "ainsi", "bien que", "toutefois", "en effet", "auparavant", "par ailleurs", "وبالتالي", "مع ذلك", "علاوة على ذلك", "على الرغم من", "بالتالي", "بالمقابل")
OPINION = ("opinion", "argumenter", "argument", "point de vue", "justifiez", "selon vous", "comparez", "discutez", "raison", "avis", "رأي", "حجة", "برر", "قارن", "ناقش", "دافع", "برّر")
ABSTRACT = ("nuance", "registre", "implicite", "critique", "nuancé", "دقيق", "محكم", "نقد")


def level_name(c: str, allowed=LEVELS[1:]) -> str:
    """A level in canonical form, or null; PRE-x counts as x."""
    name = f"upper(trim({c}))"
    some = ", ".join(f"'{x}'" for x in allowed)
    return f"CASE WHEN {name} IN ({some}) THEN {name} WHEN {name} LIKE 'PRE-%' AND substr({name}, 5) IN ({some}) THEN substr({name}, 5) END"


def explicit_level(d: Spark, indexed: str, heading: str, content: str) -> list[dict[str, str]]:
    """``explicit_level``: what the index says, else the first level that heading or beginning state."""
    evidence = f"upper(concat(coalesce({heading}, ''), '\n', substr(coalesce({content}, ''), 1, 500)))"
    named = d.first("level_evidence", r"(?:^|[^\p{L}\p{N}_])((?:NIVEAU|NIV\.|مستوى|المستوى)?\p{Z}*[A-Cأبج][12])(?:[^\p{L}\p{N}_]|$)", 1)
    tail = "substr(level_named, length(level_named) - 1, 1)"
    return [
        {"level_evidence": evidence},
        {"level_named": named},
        {"level_found": f"CASE WHEN level_named <> '' THEN concat(translate({tail}, 'أبج', 'ABC'), substr(level_named, length(level_named), 1)) END"},
        {"explicit_level": f"coalesce({level_name(indexed)}, level_found)"},
    ]


def estimated_level(d: Spark, c: str) -> list[dict[str, str]]:
    """``level_guess`` and ``level_confidence`` from the length of sentences and from markers; null without a sentence of four words."""
    parts = d.split(d.sub(f"coalesce({c}, '')", r"\[[^\]]*\]", " "), r"[.!?…]+|[\x{060C}\x{061B}]")
    low = f"lower(coalesce({c}, ''))"
    total = "aggregate(sentence_words, 0, (a, n) -> a + n)" if d.size == "size" else "list_sum(sentence_words)"
    cases = [("opinion >= 1", "B2", 0.5), ("abstract >= 2", "C1", 0.5), ("complex_n >= 2 OR mean_words >= 60", "B1", 0.45), ("mean_words <= 8 AND simple_n <= 2", "A1", 0.55), ("mean_words <= 12", "A2", 0.5)]
    return [
        {"sentence_words": d.keep(d.each(parts, "s", d.count("s", f"{W}+")), "n", "n >= 4")},
        {"n_sentences": f"{d.size}(sentence_words)", **{k: how_many(d, low, v) for k, v in (("opinion", OPINION), ("abstract", ABSTRACT), ("complex_n", COMPLEX), ("simple_n", SIMPLE))}},
        {"mean_words": f"CAST({total} AS DOUBLE) / nullif(n_sentences, 0)"},
        {
            "level_guess": "CASE WHEN n_sentences > 0 THEN " + first_of([(t, f"'{v}'") for t, v, _ in cases], "'B1'") + " END",
            "level_confidence": f"CASE WHEN n_sentences > 0 THEN {first_of([(t, num(x)) for t, _, x in cases], num(0.4))} ELSE {num(0)} END",
        },
    ]


#: Marks of roles, in the order in which they are tried.
ROLES = {
    "DIALOGUE": ("dialogue", "حوار"),
    "EXERCISE": ("exercice", "exercise", "worksheet_exercise", "تمرين"),
    "TASK": ("jeu de rôle", "role play", "role-play", "tâche", "mission", "consigne", "مهمة", "تعليمات"),
    "ASSESSMENT": ("évaluation", "evaluation", "correction", "assessment", "تقويم", "تصحيح"),
    "ACTIVITY": ("activité", "activity", "نشاط"),
    "METHODOLOGY": ("méthodolog", "methodolog", "démarche", "déroulement", "pedagogical guide", "guide pédagogique"),
}
#: Roles that an intent prefers, the ranker's and the legacy order's.
PREFERRED = {
    "activity": ("ACTIVITY", "TASK", "DIALOGUE", "EXERCISE"),
    "exercise": ("EXERCISE", "TASK", "ACTIVITY"),
    "dialogue": ("DIALOGUE", "TASK", "ACTIVITY"),
    "role_play": ("DIALOGUE", "TASK", "ACTIVITY", "EXERCISE"),
    "listening": ("ACTIVITY", "EXERCISE", "DIALOGUE", "TASK"),
    "task": ("TASK", "DIALOGUE", "ACTIVITY"),
    "methodology": ("METHODOLOGY", "REFERENCE", "ACTIVITY"),
}
PREFERRED_LEGACY = {
    "concrete_activity": ("ACTIVITY", "EXERCISE", "DIALOGUE", "TASK"),
    "concrete_exercise": ("EXERCISE", "ACTIVITY", "TASK", "DIALOGUE"),
    "role_play": ("DIALOGUE", "TASK", "ACTIVITY", "EXERCISE"),
    "listening_activity": ("DIALOGUE", "ACTIVITY", "EXERCISE", "TASK"),
    "methodology": ("METHODOLOGY", "REFERENCE"),
}
#: Words of the five skills that the ranker knows.
RANKER_SKILLS = {
    "listening": ("compréhension de l'oral", "compréhension orale", "écouter", "écoute", "listening", "الاستماع", "فهم المسموع"),
    "speaking": ("production orale", "expression orale", "prise de parole", "parler", "التعبير الشفهي", "نشاط شفهي"),
    "interaction": ("interaction orale", "dialogue", "conversation", "تفاعل شفهي", "حوار"),
    "reading": ("compréhension écrite", "lecture", "reading", "القراءة", "فهم المقروء"),
    "writing": ("production écrite", "expression écrite", "writing", "الكتابة", "التعبير الكتابي"),
}
SPEAKER = r"(?:^|\n)\s*(?:enseignant|professeur|apprenant|élève|teacher|learner)\s*:"
ACTION = "(?:écoutez|répondez|complétez|associez|discutez|présentez|jouez|demandez|lisez|écrivez|travaillez|أجب|استمع|أكمل|اكتب|اقرأ)"


def role(d: Spark, kind: str, heading: str, content: str, speakers: bool = True) -> list[dict[str, str]]:
    """``role`` of a chunk; without ``speakers`` a line that begins with a speaker is no evidence, as in the metrics."""
    low = f"lower(concat_ws(' ', {kind}, {heading}, {content}))"
    cases = [(f"{kind} = 'worksheet_exercise'", "'EXERCISE'")]
    if speakers:
        cases.append((d.has(f"lower({content})", SPEAKER), "'DIALOGUE'"))
    cases += [(any_of(d, "role_evidence", words), f"'{k}'") for k, words in ROLES.items()]
    return [{"role_evidence": low}, {"role": first_of([*cases, (f"{kind} IN ('table', 'list')", "'REFERENCE'")], "'OTHER'")}]


def concreteness(d: Spark, kind: str, heading: str, content: str) -> list[dict[str, str]]:
    """``concrete_reason``: the first structure of classroom material that a chunk has, or null; ``concrete``."""
    c, both = "concrete_low", "concrete_both"
    after = r"(?:[^\p{L}\p{N}_]|$)"
    cases = [
        (f"{kind} = 'worksheet_exercise'", "canonical_worksheet_exercise"),
        (d.has(c, rf"(?:^|\n)\s*[0-9]+\s*[).:-]\s*{ACTION}{after}"), "numbered_procedural_steps"),
        (d.has(c, SPEAKER), "dialogue_speaker_structure"),
        (d.has(c, rf"(?:consigne|instructions?|déroulement|matériel|التعليمات)\s*[:-].{{0,100}}{ACTION}{after}") + " OR " + d.has(both, rf"{ACTION}\s+(?:en binômes|aux questions|le dialogue|la consigne|ثم)"), "learner_instruction"),
        (d.has(c, r"(?:rôle\s*[:-]|role\s*[:-]).{0,100}(?:apprenant|élève|client|serveur|teacher|learner)"), "role_play_structure"),
        (f"{d.count(content, '[?]')} >= 2 AND {d.has(both, '(?:questions?|réponses?|سؤال|أجب)')}", "learner_question_set"),
    ]
    low = {"concrete_low": f"lower({content})", "concrete_both": f"lower(concat_ws(' ', {heading}, {content}))"}
    return [low, {"concrete_reason": first_of([(f"({t})", f"'{r}'") for t, r in cases], "NULL")}, {"concrete": "concrete_reason IS NOT NULL"}]


def skills_in(d: Spark, c: str, lexicon: dict) -> str:
    """Names of the skills whose words a text in lower case has, in the lexicon's order."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {any_of(d, c, [w.lower() for w in words])} THEN '{k}' END" for k, words in lexicon.items()) + ")"


def skill_evidence(d: Spark, heading: str, content: str) -> list[dict[str, str]]:
    """``heading_skills`` and ``content_skills`` of a chunk."""
    low = {"skills_heading": f"lower(coalesce({heading}, ''))", "skills_content": f"lower({content})"}
    return [low, {"heading_skills": skills_in(d, "skills_heading", RANKER_SKILLS), "content_skills": skills_in(d, "skills_content", RANKER_SKILLS)}]


def adjustments(intent: str, level: str, wanted_level: str, wanted_skill: str) -> list[dict[str, str]]:
    """``role_adjustment``, ``concrete_adjustment``, ``level_adjustment``, ``skill_adjustment``. After ``role``, ``concreteness`` and ``skill_evidence``."""
    by_role = [(f"{intent} = '{k}' AND role = '{r}'", num((0.06, 0.04, 0.02, 0.02)[i])) for k, prefs in PREFERRED.items() for i, r in enumerate(prefs)]
    known = ", ".join(f"'{k}'" for k in PREFERRED)
    place = lambda c: first_of([(f"upper({c}) = '{x}'", str(i)) for i, x in enumerate(LEVELS)], "NULL")
    has = lambda names: f"contains(concat(',', {names}, ','), concat(',', {wanted_skill}, ','))"
    skill = [
        (f"{wanted_skill} IS NULL", num(0)),
        (has("heading_skills"), num(0.02)),
        ("heading_skills <> ''", num(-0.01)),
        ("contains(content_skills, ',')", num(0)),
        (has("content_skills"), num(0.02)),
        ("content_skills <> ''", num(-0.01)),
    ]
    return [
        {"level_distance": f"abs({place(level)} - {place(wanted_level)})"},
        {
            "role_adjustment": first_of(by_role, num(0)),
            "concrete_adjustment": f"CASE WHEN concrete AND {intent} IN ({known}) THEN {num(0.03)} ELSE {num(0)} END",
            "level_adjustment": first_of([("level_distance IS NULL", num(0)), ("level_distance = 0", num(0.025)), ("level_distance = 1", num(-0.005))], num(-0.02)),
            "skill_adjustment": first_of(skill, num(0)),
        },
    ]


#: What a request asks for, in the order in which it is tried.
INTENTS = {
    "role_play": ("jeu de rôle", "role play", "role-play", "لعب دور"),
    "methodology": ("comment enseigner", "méthode", "method", "كيف أدرّس", "كيف ادرس"),
    "concrete_exercise": ("exercice", "exercise", "تمرين"),
    "listening_activity": ("compréhension orale", "listening", "activité d'écoute", "استماع", "فهم المسموع"),
    "concrete_activity": ("activité", "activity", "tâche", "task", "نشاط"),
}


def intent(d: Spark, c: str) -> str:
    return first_of([(any_of(d, f"lower({c})", words), f"'{k}'") for k, words in INTENTS.items()], "'general'")


# Exercises

#: What each signal weighs.
WEIGHTS = {
    "title": 3, "instruction": 3, "numbered_items": 2, "choice_items": 2, "blanks": 1, "fill_blank_verb": 1, "mcq_hint": 1, "matching": 1, "true_false": 1, "ordering": 1,
    "transformation": 1, "open_question": 1, "production": 1, "descriptive_rhetoric": -4, "no_items": -2,
}
TITLE = r"^\s*(?:exercice|exercise|activité|activity|تمرين|نشاط)\s*[0-9٠-٩]+(?:[^\p{L}\p{N}_]|$)"
INSTRUCTION = r"^\s*(?:consigne|directive|instruction|consigne pédagogique|تعليمات|توجيه)\s*[:：]"
NUMBERED = r"^\s*(?:[0-9]+[.)]|[٠-٩]+[.)]|[أ-ز][.)]|\(?[a-z]\))\s+"
CHOICE = r"^\s*(?:\(?\s*[a-z]\)|[أ-ز][.)])\s+"
BLANKS = r"_{2,}|\[\.\.\.\]|\(\.\.\.\)|\.\.\.\."
CHOICES_HEADER = r"^\s*الاختيارات\s*[:：]?\s*$"
OPTION = r"^\s*[-–—]\s*[^\s]+"
VERBS = {
    "fill_blank_verb": "complète|complétez|remplis|remplissez|compléter|أكمل|أكمل الفراغ|املأ|املا",
    "mcq_hint": "choisis|choisissez|entoure|entourez|bonne réponse|إختر|اختر|اختر الإجابة|اختر الإجابة الصحيحة|ضع دائرة",
    "matching": "relie|reliez|associe|associez|trouve le correspondant|اربط|صِل|وصل|طابق|صل بين",
    "true_false": "vrai ou faux|vrai|faux|صواب|خطأ|غير صحيح|صح أو خطأ|صح وخطأ|الصحيح والخطأ",
    "ordering": "remettre|remettez|remets|mets en ordre|mettez en ordre|range|rangez|organise|organisez|en ordre|رتب|رتّب|رتّبي",
    "transformation": "transforme|transformez|conjugue|conjuguez|mets au|mettez au|حوّل|صرّف|صرف الأفعال",
    "production": "production écrite|rédige|rédigez|écris un|écrivez|petit texte|أنتج نص|اكتب نص|تعبير كتابي|en quelques phrases",
}
QUESTION = r"[؟?؛;]\s*$|(?:réponds|répondez|أجب|أين|متى|لماذا|كيف|ماذا)|(?:qui|que|quoi|où|quand|pourquoi|comment|من)(?:[^\p{L}\p{N}_]|$)"
DESCRIPTIVE = (
    "ce manuel|ce cahier|cet ouvrage|la présente méthode|des exercices (?:sont|seront) proposés|les exercices (?:proposés|présentés)|permet.*aux élèves|permettent aux élèves|nous avons conçu|"
    "années de (?:recherche|travail)|pour chaque niveau|par niveau|cahier d.activités|présentation générale|avant-propos|introduction|méthodologie|démarche pédagogique|guide pédagogique|"
    "exercices de (?:production|vocabulaire|grammaire) (?:sont|seront) présentés|يقدم هذا الكتاب|يشمل هذا|يتضمن هذا|سلسلة|منهجية|مقدمة|لاحظ أن"
)
THRESHOLD = 2


def exercise(d: Spark, heading: str, content: str) -> list[dict[str, str]]:
    """``exercise_score``, ``exercise_reasons``, ``exercise_confidence``, ``is_exercise``, ``exercise_type`` of a block."""
    lines = d.keep(d.split(f"lower(coalesce({content}, ''))", r"\r?\n"), "x", d.has("x", rf"[^{BLANK}]"))
    # options count after a line that heads them; lines are joined by a mark to look back over them
    options = d.count(d.first("exercise_lines_text", r"(?s)\x{1E}\s*الاختيارات\s*[:：]?\s*\x{1E}(.*)", 1), r"(?:^|\x{1E})\s*[-–—]\s*[^\s\x{1E}]")
    test = {
        "title": d.has("exercise_text", TITLE),
        "instruction": d.has("exercise_text", INSTRUCTION),
        "numbered_items": "n_numbered >= least_items",
        "choice_items": "n_choices >= least_items",
        "blanks": d.has(content, BLANKS),
        **{k: d.has("exercise_text", word_in(v)) for k, v in VERBS.items() if k != "production"},
        "open_question": f"n_lines <= 4 AND {d.has('exercise_text', QUESTION)}",
        "production": d.has("exercise_text", word_in(VERBS["production"])),
        "descriptive_rhetoric": d.has("exercise_text", DESCRIPTIVE),
        "no_items": f"n_numbered = 0 AND n_choices = 0 AND NOT {d.has(content, BLANKS)}",
    }
    kinds = [(f"s_{k}", f"'{k}'") for k in ("matching", "true_false", "ordering", "transformation", "production")]
    kinds += [("s_blanks OR s_fill_blank_verb", "'fill_blank'"), (f"s_mcq_hint OR {d.has('exercise_text', CHOICE)} OR n_options > 0", "'qcm'"), (d.has("exercise_text", QUESTION), "'open_question'")]
    return [
        {"exercise_lines": lines, "exercise_text": f"lower(concat(coalesce({heading}, ''), '\n', coalesce({content}, '')))"},
        {"n_lines": f"{d.size}(exercise_lines)", "exercise_lines_text": f"concat('\x1e', {d.join('exercise_lines', chr(0x1E))})"},
        {"n_numbered": f"{d.size}({d.keep('exercise_lines', 'x', d.has('x', NUMBERED))})", "n_options": options},
        {"n_choices": f"{d.size}({d.keep('exercise_lines', 'x', d.has('x', CHOICE))}) + n_options", "least_items": f"CASE WHEN coalesce({heading}, '') <> '' AND n_lines <= 2 THEN 1 ELSE 2 END"},
        {f"s_{k}": f"coalesce({t}, false)" for k, t in test.items()},
        {"exercise_score": " + ".join(f"CASE WHEN s_{k} THEN {w} ELSE 0 END" for k, w in WEIGHTS.items()), "exercise_reasons": reasons([(k, f"s_{k}") for k in WEIGHTS]), "exercise_type": first_of(kinds, "'mixed'")},
        {"exercise_confidence": f"round(1 / (1 + exp(-CAST(exercise_score AS DOUBLE))), 2)", "is_exercise": f"exercise_score >= {THRESHOLD}"},
    ]


#: Words of skills and of types in a search for exercises.
SEARCH_SKILLS = {
    "reading": ("compréhension écrite", "lecture", "قراءة", "فهم المقروء", "reading"),
    "listening": ("compréhension orale", "écoute", "استماع", "فهم المسموع", "listening"),
    "speaking": ("expression orale", "interaction orale", "production orale", "تحدث", "تعبير شفهي", "speaking"),
    "writing": ("expression écrite", "production écrite", "écriture", "كتابة", "تعبير كتابي", "writing"),
    "vocabulary": ("vocabulaire", "lexique", "mots", "مفردات", "كلمات", "vocabulary"),
    "grammar": ("grammaire", "conjugaison", "syntaxe", "قواعد", "تصريف"),
    "spelling": ("orthographe", "dictée", "إملاء"),
}
SEARCH_TYPES = {
    "qcm": ("qcm", "choix multiple", "q.c.m", "اختيار من متعدد", "test à choix"),
    "true_false": ("vrai ou faux", "vrai/faux", "صواب وخطأ", "صح وخطأ", "الصحيح والخطأ"),
    "matching": ("relier", "apparier", "associer", "correspondance", "وصل", "طابق", "اربط"),
    "fill_blank": ("compléter", "trous", "complète", "الفراغ", "أكمل", "املأ"),
    "ordering": ("remettre en ordre", "réordonner", "ranger", "رتب", "رتّب"),
    "transformation": ("transformation", "transforme", "conjugue", "حوّل", "صرف"),
    "production": ("production écrite", "rédaction", "expression écrite", "تعبير كتابي", "أنتج"),
    "open_question": ("question ouverte", "réponds", "question libre", "سؤال مفتوح", "أجب"),
}
FILLERS = (
    "je cherche cherché cherchez trouve trouvez donne donnez exercices exercice des les la le l d un une de du sur à au aux en pour avec niveau niveaux m me s il plait plaît svp activités activité "
    "travailler travaille ainsi faut savoir peux أبحث عن تمارين تمرين في مستوى المستوى هام من فضلك a1 a2 b1 b2 c1 c2"
).split()
LEVEL_WORD = r"(?:niveau|niv\.|level|مستوى|المستوى)?\p{Z}*(?:pre-)?[a-cأبج][12]"


def search_request(d: Spark, c: str) -> list[dict[str, str]]:
    """``asked_level``, ``asked_skills``, ``asked_type``, ``asked_theme`` (six words at most) of a search for exercises."""
    named = d.first("asked", rf"(?:^|[^\p{{L}}\p{{N}}_])({LEVEL_WORD})(?:[^\p{{L}}\p{{N}}_]|$)", 1)
    words = "|".join(sorted({w.replace(".", r"\.") for x in (SEARCH_SKILLS, SEARCH_TYPES) for v in x.values() for w in v}, key=lambda w: (-len(w), w)))
    rest = d.sub(d.sub("asked", rf"(^|[^\p{{L}}\p{{N}}_]){LEVEL_WORD}([^\p{{L}}\p{{N}}_]|$)", " "), words, " ")
    fill = "(" + ", ".join(d.lit(w) for w in FILLERS) + ")"
    some = d.keep(d.every(rest, f"{W}+"), "w", f"w NOT IN {fill}")
    distinct, cut = ("array_distinct(theme_words)", "slice({}, 1, 6)") if d.size == "size" else ("list_filter(theme_words, lambda x, i: list_position(theme_words, x) = i)", "({})[1:6]")
    return [
        {"asked": trimmed(d, f"lower(coalesce({c}, ''))")},
        {"asked_named": named, "theme_words": some, "asked_skills": skills_in(d, "asked", SEARCH_SKILLS), "asked_type": first_of([(any_of(d, "asked", v), f"'{k}'") for k, v in SEARCH_TYPES.items()], "NULL")},
        {
            "asked_level": "CASE WHEN asked_named <> '' THEN concat(translate(substr(asked_named, length(asked_named) - 1, 1), 'أبجabc', 'ABCABC'), substr(asked_named, length(asked_named), 1)) END",
            "asked_theme": d.join(cut.format(distinct), " "),
        },
    ]


# Chat

#: Words of the four skills of a chat, and of its languages.
CHAT_SKILLS = {
    "speaking": ("production orale", "interaction orale", "activité orale", "expression orale", "faire parler", "conversation", "speaking", "oral production", "oral interaction", "expresión oral", "producción oral", "interacción oral", "التعبير الشفهي", "الإنتاج الشفهي", "التفاعل الشفهي", "المحادثة", "التحدث"),
    "listening": ("compréhension orale", "activité d'écoute", "écoute", "listening comprehension", "listening", "comprensión oral", "escucha", "الاستماع", "فهم المسموع", "الفهم الشفهي"),
    "reading": ("compréhension écrite", "compréhension de l'écrit", "lecture", "reading comprehension", "reading", "comprensión lectora", "lectura", "القراءة", "فهم المقروء"),
    "writing": ("production écrite", "expression écrite", "écriture", "written production", "writing", "producción escrita", "expresión escrita", "التعبير الكتابي", "الإنتاج الكتابي", "الكتابة"),
}
SAID_LANGUAGE = {
    "ar": ("réponds en arabe", "réponse en arabe", "donne-moi la réponse en arabe", "explique-moi cela en arabe", "أجب بالعربية", "اشرح بالعربية"),
    "fr": ("réponds en français", "réponse en français"),
    "en": ("answer in english", "respond in english"),
    "es": ("responde en español", "responde en espanol"),
}
HEARD_LANGUAGE = {
    "fr": ("propose", "activité", "famille", "rends", "niveau", "compréhension"),
    "en": ("please", "activity", "lesson", "speaking", "reading", "answer"),
    "es": ("propón", "actividad", "nivel", "lectura", "respuesta", "escucha"),
}
CHAT_LEVEL = r"(?:^|[^A-Z0-9+\-])(PRE-A1|A1|A2\+|A2|B1\+|B1|B2\+|B2|C1|C2)(?:[^A-Z0-9+\-]|$)"


def chat_parameters(d: Spark, c: str) -> list[dict[str, str]]:
    """``chat_level``, ``chat_skills``, ``chat_language`` and ``chat_language_source`` that one message states."""
    low = f"lower({c})"
    heard = {k: any_of(d, low, v) for k, v in HEARD_LANGUAGE.items()}
    alone = lambda k: f"heard_n = 1 AND {heard[k]}"
    said = [(any_of(d, low, v), f"'{k}'") for k, v in SAID_LANGUAGE.items()]
    return [
        {"chat_level": f"nullif({d.first(f'upper({c})', CHAT_LEVEL, 1)}, '')", "chat_skills": f"nullif({skills_in(d, low, CHAT_SKILLS)}, '')", "said": first_of(said, "NULL"), "heard_n": "(" + " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in heard.values()) + ")"},
        {"chat_language": first_of([("said IS NOT NULL", "said"), (d.has(c, rf"[\x{{0600}}-\x{{06FF}}]"), "'ar'"), *[(alone(k), f"'{k}'") for k in heard]], "NULL")},
        {"chat_language_source": "CASE WHEN said IS NOT NULL THEN 'explicit_message' WHEN chat_language IS NOT NULL THEN 'message_detection' END"},
    ]


def without_signals(d: Spark, c: str) -> str:
    """A message of the history without level and skill words, for retrieval; its punctuation closes up."""
    words = "|".join(sorted({w for v in CHAT_SKILLS.values() for w in v}, key=lambda w: (-len(w), w)))
    bare = d.sub(c, r"(?i)PRE-A1|A1|A2\+|A2|B1\+|B1|B2\+|B2|C1|C2")
    bare = d.sub(bare, rf"(?i)(?:{words})")
    return trimmed(d, d.sub(d.sub(bare, rf"[{BLANK}]+", " "), r" ([,.;:!?])", r"$1" if d.size == "size" else r"\1"))
