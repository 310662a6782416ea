"""Queries over texts: cleaning, tokens, quality, segments, digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import segmentation, tables

WS = r"[\p{Z}\x09-\x0D]+"
#: The name space of URLs for version 5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
STOPWORDS = {k: rf"(?:^|[^\p{{L}}])(?:{w})(?:$|[^\p{{L}}])" for k, w in {"en": "the|and|of|is", "fr": "le|la|les|de|et", "es": "el|los|que|y|en", "de": "der|die|das|und|ist"}.items()}


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d):
    return read(spark, d, "documents")


def token_estimates(spark, d):
    return docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


TOKENS_SQL = rf"len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{Z}}\x09-\x0D\p{{L}}\p{{N}}_]'))"


def source_summary(spark, d):
    """Token statistics of each source; the median is exact, from counts of equal sizes."""
    sized = docs(spark, d).withColumn("tokens", T.token_estimate(F.col("text")).cast("long"))
    n = F.col("n")
    counts = sized.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    languages = sized.groupBy("source").agg(F.countDistinct("lang").alias("languages"))
    summed = counts.groupBy("source").agg(
        F.sum(n).alias("documents"),
        F.min("tokens").alias("least"),
        F.max("tokens").alias("most"),
        F.round(F.sum(F.col("tokens") * n) / F.sum(n), 2).alias("mean"),
        F.percentile("tokens", 0.5, n).alias("median"),
        F.sum(F.when(F.col("tokens") > 512, n).otherwise(0)).alias("over_limit"),
    )
    return summed.join(languages, "source")


def clean_texts(spark, d):
    c = T.cleaned(F.col("text"))
    return docs(spark, d).select("doc_id", F.char_length(c).cast("long").alias("n_clean"), F.md5(c).alias("digest"))


CLEAN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
  '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""


def previews(spark, d):
    return docs(spark, d).select("doc_id", T.preview(F.col("text"), 220).alias("preview"))


def term_weights(spark, d):
    from ..operators import retrieval

    found = retrieval.postings(docs(spark, d))
    return found.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("tf"), 4).alias("weight"))


TERMS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*')"


def script_shares(spark, d):
    latin, arabic = (F.regexp_count(F.col("text"), F.lit(p)) for p in (r"[A-Za-zÀ-ɏ]", r"[؀-ۿ]"))
    digits = F.regexp_count(F.col("text"), F.lit("[0-9]"))
    n = F.greatest(F.char_length("text"), F.lit(1))
    return docs(spark, d).select("doc_id", F.round(latin / n, 6).alias("latin"), (arabic > 0).alias("has_arabic"), F.round(digits / n, 6).alias("digits"))


def language_guess(spark, d):
    counts = {k: F.regexp_count(F.lower("text"), F.lit(p)) for k, p in STOPWORDS.items()}
    best = F.greatest(*counts.values())
    guess = F.coalesce(F.when(best == 0, "unknown"), *[F.when(c == best, k) for k, c in counts.items()])
    return docs(spark, d).groupBy("lang", guess.alias("guess")).agg(F.count("*").alias("n"))


def word_windows(spark, d):
    w = segmentation.word_windows(docs(spark, d))
    return w.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("n_words").cast("long").alias("n_words"), F.md5("content").alias("digest"))


def chunk_digests(spark, d):
    digest = T.chunk_digest(F.col("text"), F.lit("text"), F.lit(None).cast("int"), F.lit(1), "v1")
    return docs(spark, d).select("doc_id", digest.alias("digest"))


CHUNK_SQL = rf"""sha256('{{"content":' || to_json(trim(regexp_replace(text, '{WS}', ' ', 'g'))) || ',"content_type":"text","ingestion_version":"v1","pages":[null,1]}}')"""


def point_ids(spark, d):
    name = F.concat_ws(":", F.lit("chunk"), F.col("doc_id").cast("string"), F.md5("text"), F.lit("0"))
    return docs(spark, d).select("doc_id", T.name_uuid(URL_NAMESPACE, name).alias("point_id"))


def digest_vectors(spark, d):
    v = T.digest_vector(F.col("text"))
    return docs(spark, d).select("doc_id", *[F.round(v[i], 9).alias(f"v{i}") for i in range(8)])


def repeated_blocks(spark, d):
    """Documents that are the first with their normalised first 120 characters."""
    key = F.substring(T.normalized(F.col("text")), 1, 120)
    return tables.first_of_key(docs(spark, d), key, ["doc_id"]).select("doc_id", "lang", "source")


def duplicate_rates(spark, d):
    key = F.sha2(F.concat_ws("\u001f", T.normalized(F.col("text")), "lang"), 256)
    n = F.count("*")
    return docs(spark, d).groupBy("source").agg(n.alias("n"), F.round((n - F.countDistinct(key)) / n, 6).alias("duplicate_rate"))


def turn_similarity(spark, d):
    """Dice similarity of the terms of each turn and the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, d, "conversations").withColumn("t", T.terms(F.col("text")))
    pairs = turns.withColumn("before", F.lag("t").over(w)).filter("before IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(T.dice(F.col("t"), F.col("before")), 6).alias("dice"))


def masked_contacts(spark, d):
    """Addresses of mail and hosts taken out of texts."""
    c = F.regexp_replace("text", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "<mail>")
    c = F.regexp_replace(c, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<host>")
    found = F.regexp_count(c, F.lit("<mail>|<host>")).cast("long")
    return docs(spark, d).select("doc_id", found.alias("n"), F.md5(c).alias("digest"))


def page_titles(spark, d):
    """A title for each page from the last part of its url."""
    stem = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/?$", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(stem, r"\.[A-Za-z0-9]+$", ""), r"[_ ]+", " "))
    return read(spark, d, "pages").select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.lit("document")).alias("title"))


WORDS_SQL = rf"list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')"

QUERIES = {
    "source_summary": (
        source_summary,
        f"SELECT source, count(*) AS documents, count(DISTINCT lang) AS languages, min(t) AS least, max(t) AS most, round(avg(t), 2) AS mean, median(t) AS median, count(*) FILTER (t > 512) AS over_limit FROM (SELECT *, {TOKENS_SQL} AS t FROM documents) GROUP BY source",
    ),
    "token_estimates": (token_estimates, f"SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents"),
    "clean_texts": (clean_texts, f"SELECT doc_id, length({CLEAN_SQL}) AS n_clean, md5({CLEAN_SQL}) AS digest FROM documents"),
    "previews": (
        previews,
        rf"SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(t[1:219]) || '…' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS t FROM documents)",
    ),
    "term_weights": (
        term_weights,
        f"SELECT doc_id, count(*) AS terms, round(sum(1 + ln(n)), 4) AS weight FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY ALL) GROUP BY doc_id",
    ),
    "script_shares": (
        script_shares,
        r"""SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{024F}]')) / greatest(length(text), 1), 6) AS latin,
        len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) > 0 AS has_arabic, round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1), 6) AS digits FROM documents""",
    ),
    "language_guess": (
        language_guess,
        "WITH c AS (SELECT lang, "
        + ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS {k}" for k, p in STOPWORDS.items())
        + " FROM documents), b AS (SELECT *, greatest(en, fr, es, de) AS m FROM c) SELECT lang, CASE WHEN m = 0 THEN 'unknown' WHEN en = m THEN 'en' WHEN fr = m THEN 'fr' WHEN es = m THEN 'es' ELSE 'de' END AS guess, count(*) AS n FROM b GROUP BY ALL",
    ),
    "word_windows": (
        word_windows,
        f"SELECT doc_id, k AS chunk_index, len(part) AS n_words, md5(array_to_string(part, ' ')) AS digest FROM (SELECT doc_id, k, w[k * 360 + 1 : k * 360 + 360] AS part FROM (SELECT doc_id, w, unnest(range((len(w) + 359) // 360)) AS k FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)))",
    ),
    "chunk_digests": (chunk_digests, f"SELECT doc_id, {CHUNK_SQL} AS digest FROM documents"),
    "point_ids": (
        point_ids,
        f"""SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id
        FROM (SELECT doc_id, sha1(unhex('{URL_NAMESPACE}') || encode('chunk:' || doc_id || ':' || md5(text) || ':0')) AS h FROM documents)""",
    ),
    "digest_vectors": (
        digest_vectors,
        "SELECT doc_id, " + ", ".join(f"round(('0x' || h[{i * 8 + 1}:{i * 8 + 8}])::BIGINT / 4294967296.0::DOUBLE, 9) AS v{i}" for i in range(8)) + " FROM (SELECT doc_id, sha256(text) AS h FROM documents)",
    ),
    "repeated_blocks": (
        repeated_blocks,
        rf"SELECT doc_id, lang, source FROM (SELECT *, substr(lower(trim(regexp_replace(text, '{WS}', ' ', 'g'))), 1, 120) AS k FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1 OR k = ''",
    ),
    "duplicate_rates": (
        duplicate_rates,
        rf"SELECT source, count(*) AS n, round((count(*) - count(DISTINCT (lower(trim(regexp_replace(text, '{WS}', ' ', 'g'))), lang))) / count(*), 6) AS duplicate_rate FROM documents GROUP BY source",
    ),
    "turn_similarity": (
        turn_similarity,
        f"""SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) > 0 THEN 2 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS dice
        FROM (SELECT conv_id, turn, list_distinct(t) AS a, list_distinct(lag(t) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM (SELECT *, {TERMS_SQL} AS t FROM conversations)) WHERE b IS NOT NULL""",
    ),
    "masked_contacts": (
        masked_contacts,
        r"""SELECT doc_id, len(regexp_extract_all(c, '<mail>|<host>')) AS n, md5(c) AS digest FROM (SELECT doc_id,
        regexp_replace(regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '<mail>', 'g'), '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '<host>', 'g') AS c FROM documents)""",
    ),
    "page_titles": (
        page_titles,
        r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1), '\.[A-Za-z0-9]+$', ''), '[_ ]+', ' ', 'g')), ''), 'document') AS title FROM pages""",
    ),
}


def near_blocks(spark, d):
    """For each chunk the first one whose beginning has most terms in common with its own, itself if there is none."""
    from ..operators import exercises
    from . import judging

    return exercises.near_copies(judging.pieces(spark, d), "id", "content")


def _near_sql() -> str:
    from . import judging

    terms = TERMS_SQL.replace("text", "substr(content, 1, 180)")
    return f"""WITH s AS (SELECT id, list_sort(list_distinct(list_filter({terms}, lambda t: length(t) >= 2))) AS t FROM {judging.PIECES}),
    c AS (SELECT min(id) AS a, t FROM s WHERE len(t) > 0 GROUP BY t), e AS (SELECT a, unnest(t) AS term, len(t) AS n FROM c),
    p AS (SELECT y.a AS a, min(x.a) AS near FROM (SELECT x.a AS xa, y.a AS ya FROM e x JOIN e y ON x.term = y.term AND x.a < y.a GROUP BY x.a, y.a HAVING round(2 * count(*) / (any_value(x.n) + any_value(y.n)), 6) >= 0.78) z JOIN c x ON x.a = z.xa JOIN c y ON y.a = z.ya GROUP BY y.a)
    SELECT s.id, coalesce(p.near, c.a, s.id) AS representative FROM s LEFT JOIN c USING (t) LEFT JOIN p ON p.a = c.a"""


def preflight_rollup(spark, d):
    """Of each source's documents how many are good, borderline and bad by their quality score, and how to read the source."""
    scored = rules.applied(docs(spark, d), rules.quality(rules.Spark(), "text"))
    grade = F.when(F.col("q_score") >= rules.CERTAIN, "good").when(F.col("q_score") >= rules.BORDERLINE, "borderline").otherwise("bad")
    n, bad = F.count("*"), F.count_if(F.col("grade") == "bad")
    ratio = bad / n
    return scored.withColumn("grade", grade).groupBy("source").agg(
        n.alias("pages"),
        F.count_if(F.col("grade") == "good").alias("good"),
        F.count_if(F.col("grade") == "borderline").alias("borderline"),
        bad.alias("bad"),
        F.when(ratio <= 0.02, "native_only").when(ratio >= 0.6, "ocr_heavy").otherwise("mixed").alias("strategy"),
        F.when((n >= 150) | (ratio >= 0.6), "high").when((n >= 40) | (ratio > 0.02), "medium").otherwise("low").alias("complexity"),
    )


def conversation_titles(spark, d):
    """A title of at most 80 characters from each conversation's first turn of a user."""
    users = read(spark, d, "conversations").filter("role = 'user'")
    first = users.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", T.preview(F.col("text"), 80).alias("title"))


def posting_coverage(spark, d):
    """Of each language's documents those with postings, with a vector, and with both."""
    has_terms = F.regexp(F.col("text"), F.lit(r"[\p{L}\p{N}]"))
    rows = docs(spark, d).join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v")), "doc_id", "left")
    v = F.coalesce(F.col("v"), F.lit(False))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(has_terms).alias("sparse"), F.count_if(v).alias("dense"), F.count_if(has_terms & v).alias("both"))


QUERIES["near_blocks"] = (near_blocks, _near_sql())
QUERIES["preflight_rollup"] = (
    preflight_rollup,
    f"""SELECT source, count(*) AS pages, count(*) FILTER (x >= 0.85) AS good, count(*) FILTER (x >= 0.6 AND x < 0.85) AS borderline, count(*) FILTER (x < 0.6) AS bad,
    CASE WHEN count(*) FILTER (x < 0.6) / count(*) <= 0.02 THEN 'native_only' WHEN count(*) FILTER (x < 0.6) / count(*) >= 0.6 THEN 'ocr_heavy' ELSE 'mixed' END AS strategy,
    CASE WHEN count(*) >= 150 OR count(*) FILTER (x < 0.6) / count(*) >= 0.6 THEN 'high' WHEN count(*) >= 40 OR count(*) FILTER (x < 0.6) / count(*) > 0.02 THEN 'medium' ELSE 'low' END AS complexity
    FROM (SELECT source, q_score AS x FROM {rules.stated('documents', rules.quality(rules.Duck(), 'text'))}) GROUP BY source""",
)
QUERIES["conversation_titles"] = (
    conversation_titles,
    rf"SELECT conv_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(t[1:79]) || '…' END AS title FROM (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '{WS}', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)",
)
QUERIES["posting_coverage"] = (
    posting_coverage,
    r"SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) AS sparse, count(vec_id) AS dense, count(vec_id) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) AS both FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY lang",
)
