"""SQL with the rows of the registered queries, for those that SQL can express: operators 1, 5 to 8 and 10 to 13."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]"
#: A-Z in lower case, other letters as they are.
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def ngram_jaccard(words: int = 4, percent: int = 85) -> str:
    gram = f"list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct({gram}) END AS s FROM (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
    l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM d JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)"""


def decontamination(words: int = 5, similarity: float = 0.8) -> str:
    split = "list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')"
    bag = f"list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))"
    return f"""WITH d AS (SELECT doc_id, {bag} AS s FROM (SELECT doc_id, {split} AS w FROM documents) WHERE len(w) >= {words}),
    i AS (SELECT item_id, {bag} AS b FROM (SELECT item_id, {split} AS w FROM benchmark) WHERE len(w) >= {words}),
    c AS (SELECT doc_id, item_id FROM (SELECT doc_id, unnest(list_distinct(s)) AS g FROM d) x JOIN (SELECT item_id, len(list_distinct(b)) AS n, unnest(list_distinct(b)) AS g FROM i) y USING (g) GROUP BY doc_id, item_id HAVING count(*) >= 0.5 * any_value(n)),
    k AS (SELECT doc_id, item_id, len(b) AS l, s[start + 1:start + len(b)] AS own, start FROM (SELECT doc_id, item_id, s, b, unnest(range(len(s))) AS start FROM c JOIN d USING (doc_id) JOIN i USING (item_id))),
    o AS (SELECT doc_id, item_id, start, l, len(own) AS n, g, count(*) AS m FROM (SELECT doc_id, item_id, start, l, own, unnest(own) AS g FROM k) GROUP BY ALL),
    q AS (SELECT item_id, g, count(*) AS m FROM (SELECT item_id, unnest(b) AS g FROM i) GROUP BY ALL),
    f AS (SELECT doc_id, item_id, start, l, n, sum(least(o.m, q.m))::BIGINT AS common FROM o JOIN q USING (item_id, g) GROUP BY ALL),
    z AS (SELECT doc_id, item_id, start AS start_word, common / (n + l - common) AS similarity FROM f)
    SELECT doc_id, item_id, start_word::INT AS start_word, similarity FROM z WHERE similarity >= {similarity} QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word) = 1"""


def nearest(every: int = 50, k: int = 5) -> str:
    dot = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
    return f"""WITH v AS (SELECT vec_id, embedding AS e, sqrt({dot('embedding', 'embedding')}) AS n FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, {dot('c.e', 'q.e')} / (c.n * q.n) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % {every} = 0 AND q.n > 0 AND c.n > 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""


def crc32(text: str) -> str:
    """The checksum of a short ASCII text, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = "xor(c, ascii(k)::BIGINT)"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda x: {step})[1]"
    return f"xor(list_reduce(string_split({text}, ''), lambda c, k: {byte}, 4294967295::BIGINT), 4294967295)"


def lm_scoring(folds: int = 7, held_out: int = 2, order: int = 5, unit: float = 1e11) -> str:
    """Counts of bytes after contexts of every length, exclusion by the next longer context, sums of whole numbers."""
    size = 2 * (order + 1)
    e, x, joins, terms = [], [], [], "0::DOUBLE"
    for k in range(order, -1, -1):
        e.append(f"e{k} AS (SELECT right(gram, {2 * k + 2}) AS entry, sum(c)::BIGINT AS c FROM g WHERE c > 0 GROUP BY 1), c{k} AS (SELECT left(entry, {2 * k}) AS ctx, sum(c)::BIGINT AS n, count(*) AS d FROM e{k} GROUP BY 1)")
        joins.append(f"LEFT JOIN e{k} ON e{k}.entry = right(gram, {2 * k + 2}) LEFT JOIN c{k} ON c{k}.ctx = substr(gram, {size - 2 * k - 1}, {2 * k})")
        n, d = f"c{k}.n", f"c{k}.d"
        if k < order:
            x.append(f"x{k} AS (SELECT left(y.entry, {2 * k + 2}) AS ctx, sum(e{k}.c)::BIGINT AS n, count(*) AS d FROM e{k + 1} y JOIN e{k} ON e{k}.entry = right(y.entry, {2 * k + 2}) GROUP BY 1)")
            joins.append(f"LEFT JOIN x{k} ON x{k}.ctx = substr(gram, {size - 2 * k - 3}, {2 * k + 2})")
            n, d = f"({n} - coalesce(x{k}.n, 0))", f"({d} - coalesce(x{k}.d, 0))"
        searching = " AND ".join(["true", *[f"e{j}.c IS NULL" for j in range(order, k, -1)]])
        terms = f"({terms} + CASE WHEN {searching} THEN CASE WHEN e{k}.c IS NOT NULL THEN log10((2 * e{k}.c - 1)::DOUBLE / (2 * {n})::DOUBLE) WHEN {d} > 0 THEN log10({d}::DOUBLE / (2 * {n})::DOUBLE) ELSE 0 END ELSE 0 END)"
    never = " AND ".join(f"e{j}.c IS NULL" for j in range(order, -1, -1))
    return f"""WITH t AS (SELECT doc_id, {crc32('doc_id::VARCHAR')} % {folds} AS fold, trim(regexp_replace({ASCII_LOWER}, '{BLANK}+', ' ', 'g'), ' ') AS body FROM documents),
    w AS (SELECT doc_id, fold, CASE WHEN body = '' THEN [] ELSE string_split(body, ' ') END AS ws FROM t),
    u AS (SELECT doc_id, fold, unnest(list_append(ws, chr(10))) AS word FROM w),
    v AS (SELECT word, count(*) FILTER (fold <> {held_out}) AS c FROM u GROUP BY word),
    m AS (SELECT sum(c)::BIGINT AS n, count(*) FILTER (c > 0) AS v FROM v),
    b AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(m.n) AS train_tokens, sum(round_even(log10((c + 1)::DOUBLE / (m.n + m.v + 1)::DOUBLE) * {unit}, 0)::HUGEINT)::DOUBLE / {unit} AS base_score FROM u JOIN v USING (word), m GROUP BY doc_id),
    h AS (SELECT doc_id, fold, '{'0A' * order}' || hex(encode(body)) || '0A' AS code FROM t),
    p AS (SELECT doc_id, fold, substr(code, 2 * i + 1, {size}) AS gram FROM (SELECT doc_id, fold, code, unnest(range(length(code) // 2 - {order})) AS i FROM h)),
    g AS (SELECT gram, count(*) FILTER (fold <> {held_out}) AS c FROM p GROUP BY gram),
    {', '.join(e)}, {', '.join(x)},
    s AS (SELECT gram, round_even(({terms} - CASE WHEN {never} THEN log10(greatest(1, 256 - (SELECT count(*) FROM e0))::DOUBLE) ELSE 0 END) * {unit}, 0)::HUGEINT AS p FROM g {' '.join(joins)}),
    z AS (SELECT doc_id, sum(s.p)::DOUBLE / {unit} AS score FROM p JOIN s USING (gram) GROUP BY doc_id)
    SELECT doc_id, fold = {held_out} AS held_out, n_tokens, n_known, train_tokens, base_score, score FROM b JOIN z USING (doc_id) JOIN t USING (doc_id)"""


def html_extraction() -> str:
    """The article's blocks of the given pages, whose articles hold headlines, paragraphs, line breaks and bold text only."""
    article = r"regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1)"
    plain = rf"regexp_replace(regexp_replace({article}, '</?(?:p|h1|br)(?:\s[^>]*)?/?>', ' ', 'g'), '</?b>', '', 'g')"
    said = rf"regexp_replace(replace({plain}, '&quot;', '\"'), '&amp;?', '&', 'g')".replace('\\"', '"')
    return rf"""SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url, trim(regexp_replace({said}, '[\p{{Z}}\x09-\x0D\x1C-\x1F\x{{85}}]+', ' ', 'g'), ' ') AS text FROM pages)"""


def substring_dedup(min_bytes: int = 80) -> str:
    """Chunk ends from the sixteen bytes before them, the first document of each chunk, runs of partners in one piece."""
    from .substring_dedup import ENDS, GEAR, INNER

    gear = "[" + ", ".join(map(str, GEAR.tolist())) + "]"
    rolled = " + ".join(f"coalesce(lag(g, {j}) OVER w, 0) * {1 << j}" for j in range(16))
    blank = "b <= 32 OR (b1 = 194 AND b = 160) OR (b2 = 226 AND b1 = 128 AND b BETWEEN 128 AND 138) OR (b2 = 227 AND b1 = 128 AND b = 128)"
    return f"""WITH t AS (SELECT doc_id AS key, ('0x' || md5(text)[1:15])::BIGINT AS version, hex(encode(text)) AS code, strlen(text) AS n FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
    p AS (SELECT key, version, n, i, ('0x' || substr(code, 2 * i + 1, 2))::INT AS b FROM (SELECT *, unnest(range(n)) AS i FROM t)),
    q AS (SELECT *, ({gear})[b + 1]::BIGINT AS g, lag(b, 1) OVER w AS b1, lag(b, 2) OVER w AS b2, lead(b) OVER w AS after FROM p WINDOW w AS (PARTITION BY key, version ORDER BY i)),
    r AS (SELECT key, version, n, i, after, ({rolled}) % 65536 // 256 AS h, coalesce({blank}, false) AS blank FROM q WINDOW w AS (PARTITION BY key, version ORDER BY i)),
    s AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY key, version ORDER BY i ROWS 15 PRECEDING) AS blanks FROM r),
    e AS (SELECT key, version, i + 1 AS stop FROM s WHERE i + 1 = n OR (i >= 15 AND (blank AND h < {ENDS} OR blanks = 0 AND after // 64 <> 2 AND h < {INNER}))),
    c AS (SELECT key, version, lag(stop, 1, 0) OVER (PARTITION BY key, version ORDER BY stop) AS start, stop FROM e),
    d AS (SELECT c.*, substr(code, 2 * start + 1, 2 * (stop - start)) AS chunk FROM c JOIN t USING (key, version)),
    o AS (SELECT *, row_number() OVER (PARTITION BY key, version, chunk ORDER BY start) AS k FROM d),
    f AS (SELECT chunk, k, min((key, version, start)) AS spot, max(key) AS final FROM o GROUP BY chunk, k),
    j AS (SELECT o.key, o.version, o.start, o.stop, spot[1] AS first, spot[2] AS first_version, spot[3] AS first_start FROM o JOIN f USING (chunk, k) WHERE spot[1] < final),
    y AS (SELECT *, coalesce(first < key AND lag(first) OVER w < key AND lag(first) OVER w = first AND lag(first_version) OVER w = first_version AND lag(stop) OVER w = start AND first_start - lag(first_start) OVER w = start - lag(start) OVER w, false) AS goes_on FROM j WINDOW w AS (PARTITION BY key, version ORDER BY start)),
    u AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY key, version ORDER BY start) AS run FROM y),
    l AS (SELECT key, version, min(start) AS start, max(stop) AS stop, any_value(first) AS first, any_value(first_version) AS first_version, min(first_start) AS first_start FROM u WHERE first < key GROUP BY key, version, run HAVING max(stop) - min(start) >= {min_bytes}),
    m AS (SELECT DISTINCT first AS key, first_version AS version, first_start AS start, first_start + stop - start AS stop FROM l),
    x AS (SELECT *, sum(apart) OVER (PARTITION BY key, version ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY key, version ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY key, version ORDER BY start, stop) = 1 THEN 1 ELSE 0 END AS apart FROM m))
    SELECT key AS doc_id, start::INT AS start_byte, stop::INT AS end_byte, false AS kept, first AS first_doc_id, version FROM l
    UNION ALL SELECT key, min(start)::INT, max(stop)::INT, true, key, version FROM x GROUP BY key, version, island"""


def clustering(k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Each round in full: all distances, then exact sums."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda a: floor(a::DOUBLE * {scale})::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS cluster, x FROM v QUALIFY cluster < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, vec_id, v.x AS x, cluster, {distance} AS distance FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS MATERIALIZED (SELECT cluster, list({floor} ORDER BY i) AS x FROM (SELECT cluster, i, sum(a)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT cluster, unnest(x) AS a, unnest(range({dimensions})) AS i FROM a{r}) GROUP BY ALL) GROUP BY cluster)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    return f"""WITH {', '.join(steps)}
    SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


def host_rules(barred: float = 0.5, strict: float = 0.2, times: float = 2.0, least: float = 2.0, most: float = 1000.0) -> str:
    rules = {
        "few_words": "n_words < 50",
        "repeats": "100 * n_repeat_words > 50 * n_words",
        "symbols": "100 * n_symbols > 10 * n_words",
        "dup_lines": "100 * n_dup_lines > 30 * n_lines",
        "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    }
    names = [*rules, "failing"]
    counts = ", ".join(f"count(*) FILTER ({r}) AS {r}" for r in names)
    totals = ", ".join(f"sum({r}) / sum(n) AS rate_{r}, sum(({r}::DOUBLE * {r} / n)::DECIMAL(38, 3))::DOUBLE AS q_{r}" for r in names)
    rho = lambda r: f"(q_{r} - n * rate_{r} * rate_{r}) / (rate_{r} * (1 - rate_{r})) - (hosts - 1)"
    sizes = ", ".join(f"CASE WHEN rate_{r} > 0 AND rate_{r} < 1 AND free > 0 AND {rho(r)} > 0 THEN greatest({least}, least({most}, free / ({rho(r)}) - 1)) ELSE {most} END AS size_{r}" for r in names)
    rate = lambda r: f"(h.{r} + rate_{r} * size_{r}) / (h.n + size_{r})"
    strictly = ", ".join(f"{rate(r)} > {strict} AND {rate(r)} > {times} * rate_{r} AS strict_{r}" for r in rules)
    goes = " OR ".join(f"(m.{r} AND coalesce(strict_{r}, false))" for r in rules)
    return f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
    g AS (SELECT row, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS g FROM w),
    p AS (SELECT row, count(DISTINCT j) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1)) GROUP BY row),
    k AS (SELECT row, doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (row)),
    f AS (SELECT *, {', '.join(f'({sql}) AS {r}' for r, sql in rules.items())}, {' OR '.join(f'({sql})' for sql in rules.values())} AS failing FROM k),
    h AS (SELECT source, count(*) AS n, {counts} FROM f WHERE source IS NOT NULL GROUP BY source),
    a AS (SELECT count(*) AS hosts, sum(n)::DOUBLE AS n, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS free, {totals} FROM h),
    b AS (SELECT *, {sizes} FROM a),
    v AS (SELECT h.source, {rate('failing')} > {barred} AS barred, {strictly} FROM h, b)
    SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, few_words OR repeats AS base_failed, NOT (few_words OR repeats OR coalesce(barred, false) OR {goes}) AS kept FROM f m LEFT JOIN v USING (source)"""


def block_max(top: int = 20) -> str:
    terms = f"regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row, doc_id, ws, len(ws) AS n FROM (SELECT row_number() OVER () AS row, doc_id, {terms} AS ws FROM documents) WHERE len(ws) > 0),
    a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
    p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ws) AS term FROM d) GROUP BY ALL),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY term),
    s AS (SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + 25 * n * docs // total))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), a GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {top}"""
