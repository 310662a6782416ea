"""Queries that keep the store in order: eligibility, access, audits, histories, jobs, reports.

Each is one SQL text that Spark runs over views of the tables; ``d`` spells what engines spell differently.
``pieces`` are the chunks of ``judging``.
"""

from __future__ import annotations

import re

from ..functions import rules
from ..functions.rules import Duck, Spark
from . import judging

S, D = Spark(), Duck()
TABLES = "documents embeddings labels conversations events benchmark customer orders lineitem pages".split()


def div(d, a, b):
    return f"({a} {'div' if d is S else '//'} {b})"


def joined(d, x, by, order):
    """Texts of a group, in order, in one."""
    return f"string_agg({x}, {d.lit(by)}) WITHIN GROUP (ORDER BY {order})" if d is S else f"string_agg({x}, {d.lit(by)} ORDER BY {order})"


def sha(d, x):
    return f"sha2({x}, 256)" if d is S else f"sha256({x})"


def pieces_of(d):
    return "pieces" if d is S else judging.PIECES


#: A chunk's state in the index: its document has a vector (dense) and terms (sparse).
def indexed(d):
    return f"""(SELECT p.*, v.vec_id, l.quality, l.toxic FROM {pieces_of(d)} p LEFT JOIN embeddings v ON v.vec_id = p.id LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = p.id)"""


def eligibility(d):
    """The first reason why a chunk isn't embedded, and why it has no sparse vector."""
    letters = d.count("content", r"\p{L}")
    why = [
        ("trim(content) = ''", "'empty_embedding_text'"),
        ("quality = 0", "'layout_unreliable'"),
        (d.has("content", r"(?i)<!--\s*image\s*-->") + f" AND {letters} <= 8", "'image_placeholder_only'"),
        (f"{letters} < 3", "'low_information'"),
        ("toxic = 1", "'rejected_quality'"),
        ("page < 1", "'missing_page'"),
    ]
    return f"""SELECT id, dense, coalesce(dense, CASE WHEN vec_id IS NULL THEN 'dense_embedding_not_indexed' WHEN NOT {d.has('content', r'[\p{L}\p{N}]')} THEN 'empty_sparse_vector' END) AS sparse
    FROM (SELECT *, {rules.first_of(why, 'NULL')} AS dense FROM {indexed(d)})"""


def ingestion_eligibility(d):
    """Whether a source file may be ingested: all its chunks there, a text in each, its quality known, no job under way."""
    why = [("blank > 0", "'file_missing'"), ("last_index <> n - 1", "'preflight_incomplete'"), ("judged = 0", "'preflight_unknown'"), ("busy", "'job_active'")]
    return f"""SELECT document_id, {rules.first_of(why, "'eligible'")} AS state FROM (SELECT document_id, count(*) AS n, max(chunk_index) AS last_index, count(*) FILTER (WHERE trim(content) = '') AS blank, count(quality) AS judged, bool_or(vec_id % 3 = 0) AS busy FROM {indexed(d)} GROUP BY document_id)"""


def page_overlap(d):
    """Chunks that touch page two, by kind, with the newest place of each."""
    return f"SELECT kind, count(*) AS n, max(chunk_index) AS newest, min(id) AS first_id FROM {pieces_of(d)} WHERE page <= 2 AND page >= 2 GROUP BY kind"


def guarded_fetch(d):
    """What a request for a user by id gets: the user, or 404 for another role, a removed one or none."""
    return """SELECT r.id, coalesce(c.c_name, '') AS name, CASE WHEN c.c_custkey IS NULL THEN 404 WHEN c.c_mktsegment = 'MACHINERY' THEN 404 WHEN c.c_acctbal < 0 THEN 404 ELSE 200 END AS status
    FROM (SELECT DISTINCT o_custkey + 7 AS id FROM orders) r LEFT JOIN customer c ON c.c_custkey = r.id"""


def owned_history(d):
    """Of each conversation's owner the turns before the newest one of the user; a foreign conversation has none."""
    return """SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, max(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY conv_id) n ON n.conv_id = c.conv_id
    JOIN (SELECT DISTINCT conv_id, conv_id % 7 AS owner FROM conversations) o ON o.conv_id = c.conv_id WHERE o.owner = c.conv_id % 7 AND o.owner <> 3 AND c.turn < n.asked"""


def archive_states(d):
    """Conversations by archive state before and after all of an owner's short ones are flipped."""
    return """SELECT archived, CASE WHEN n <= 2 THEN NOT archived ELSE archived END AS flipped, count(*) AS n FROM (SELECT conv_id, count(*) AS n, bool_or(length(text) > 400) AS archived FROM conversations GROUP BY conv_id) GROUP BY 1, 2"""


def access_guard(d):
    """Whether a request may read its five chunks: all must be there and of one owner."""
    return f"""SELECT request, count(*) AS asked, count(p.id) AS found, count(*) = count(p.id) AND count(DISTINCT p.owner) = 1 AS granted
    FROM (SELECT doc_id AS request, doc_id + k AS id FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(k)) r LEFT JOIN (SELECT id, {div(d, 'id', 10)} AS owner FROM {pieces_of(d)}) p ON p.id = r.id GROUP BY request"""


def vector_payloads(d):
    """What goes with a vector: a chunk's value, else its document's, blanks and nulls alike."""
    return f"""SELECT p.id, p.document_id, coalesce(nullif(p.level, ''), f.level, 'none') AS level, coalesce(nullif(p.heading, ''), f.heading, '') AS heading, p.kind IN ('table', 'list') AS structured
    FROM {pieces_of(d)} p JOIN (SELECT document_id, max(level) AS level, min(heading) AS heading FROM {pieces_of(d)} GROUP BY document_id) f ON f.document_id = p.document_id"""


def chunk_sample(d):
    """A preview of a file: its first, middle and last chunk and all its tables, twenty at most."""
    return f"""SELECT document_id, id, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS place FROM
    (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS k, count(*) OVER (PARTITION BY document_id) AS n FROM {pieces_of(d)}) WHERE k = 1 OR k = n OR k = {div(d, 'n', 2)} + 1 OR kind = 'table') WHERE place <= 20"""


def chunk_validation(d):
    """The first fault of a file's chunks: a gap in the index, a blank one, one over the budget, a page out of order."""
    w = "OVER (PARTITION BY document_id ORDER BY chunk_index)"
    why = [("min(gap) < 1 OR max(gap) > 1 OR min(chunk_index) <> 0", "'index_not_sequential'"), ("min(words) = 0", "'blank_chunk'"), ("max(words) > 480", "'over_token_budget'"), ("min(turned) < 0", "'pages_out_of_order'")]
    rows = f"SELECT *, chunk_index - lag(chunk_index, 1, -1) {w} AS gap, page - lag(page, 1, 1) {w} AS turned, {d.count('content', rules.W + '+')} AS words FROM {pieces_of(d)}"
    return f"SELECT document_id, count(*) AS n, {rules.first_of(why, chr(39) + 'valid' + chr(39))} AS fault FROM ({rows}) GROUP BY document_id"


def request_validation(d):
    """The first fault of a request for contexts, made of a customer's row."""
    why = [("k < 1 OR k > 20", "'top_k'"), ("lang NOT IN ('FURNITURE', 'BUILDING', 'MACHINERY', 'HOUSEHOLD')", "'language'"), ("c_acctbal < 0", "'level'"), ("topic = ''", "'topic'")]
    return f"SELECT fault, count(*) AS n, min(c_custkey) AS first_id FROM (SELECT c_custkey, {rules.first_of(why, chr(39) + 'valid' + chr(39))} AS fault FROM (SELECT *, c_custkey % 23 AS k, c_mktsegment AS lang, trim(c_name) AS topic FROM customer)) GROUP BY fault"


def file_texts(d):
    """All chunks of a file in order, as one text: its length and digest."""
    return f"SELECT document_id, count(*) AS n, CAST(length({joined(d, 'content', chr(10), 'chunk_index, id')}) AS BIGINT) AS chars, md5({joined(d, 'content', chr(10), 'chunk_index, id')}) AS digest FROM {pieces_of(d)} GROUP BY document_id"


def embedding_queue(d):
    """Chunks to be embedded with their document, in order of id, and the batch of eight that each goes with."""
    return f"SELECT id, document_id, CAST({div(d, 'place - 1', 8)} AS BIGINT) AS batch FROM (SELECT p.id, p.document_id, row_number() OVER (PARTITION BY {div(d, 'p.id', 4096)} ORDER BY p.id) AS place FROM {indexed(d)} p WHERE p.vec_id IS NULL)"


def siblings(d):
    """Chunks on the page of a short anchor under the same heading: the anchor is a file's first chunk, or isn't short."""
    short = f"{d.count('content', '[^' + rules.BLANK + ']+')} <= 24"
    return f"""SELECT a.document_id, b.id, CAST(row_number() OVER (PARTITION BY a.document_id ORDER BY b.chunk_index, b.id) AS BIGINT) AS place FROM (SELECT * FROM {pieces_of(d)} WHERE chunk_index = 0 AND {short}) a
    JOIN {pieces_of(d)} b ON b.document_id = a.document_id AND b.page = a.page AND b.id <> a.id AND coalesce(b.heading, '') = coalesce(a.heading, '')"""


def file_jobs(d):
    """Of each user the jobs under way and the latest finished one, from the events."""
    return """SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS active, max_by(event_id, CASE WHEN event_type = 'purchase' THEN ts END) AS latest_done, count(*) FILTER (WHERE event_type = 'purchase') AS done FROM events GROUP BY user_id"""


def job_list(d):
    """The newest three jobs of each kind and user group."""
    return "SELECT event_type, grp, event_id, CAST(place AS BIGINT) AS place FROM (SELECT event_type, user_id % 10 AS grp, event_id, row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3"


def bound_items(d):
    """Generated items bound to a source block by a 0-based index where it is in range, else to none."""
    return f"""SELECT i.item_id, i.document_id, i.wanted, p.id AS block FROM (SELECT item_id, item_id % 40 AS document_id, item_id % 7 AS wanted FROM benchmark) i LEFT JOIN {pieces_of(d)} p ON p.document_id = i.document_id AND p.chunk_index = i.wanted"""


def answer_sources(d):
    """The sources of an answer: chunks of the asked level first, then others, each file once, in order of their first chunk."""
    return f"""SELECT asked, document_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY own, first_id) AS BIGINT) AS place FROM
    (SELECT item_id % 11 AS asked, p.document_id, min(CASE WHEN p.level = 'A1' THEN 0 ELSE 1 END) AS own, min(p.id) AS first_id FROM benchmark b JOIN {pieces_of(d)} p ON p.id = b.item_id GROUP BY 1, 2)"""


def case_summary(d):
    """Measures of all cases: booleans summed, numbers averaged over the cases that have them."""
    rows = f"""SELECT b.item_id, b.item_id % 4 AS stage, p.level, length(p.content) AS n, contains(p.content, b.text) AS hit FROM benchmark b LEFT JOIN {pieces_of(d)} p ON p.id = b.item_id"""
    return f"SELECT stage, count(*) AS cases, count(*) FILTER (WHERE hit) AS hits, round(avg(n), 4) AS mean_length, count(level) AS levelled FROM ({rows}) GROUP BY stage"


def context_summary(d):
    """Contexts within 1,800 tokens and six chunks: mean, least and most tokens, how many hold to the budget, and the gate."""
    rows = f"SELECT document_id, sum({d.count('content', judging.TOKEN)}) AS tokens, count(*) AS chunks, count(*) - count(DISTINCT md5(content)) AS copies FROM {pieces_of(d)} GROUP BY document_id"
    return f"""SELECT count(*) AS contexts, round(avg(tokens), 4) AS mean_tokens, CAST(min(tokens) AS BIGINT) AS least, CAST(max(tokens) AS BIGINT) AS most, count(*) FILTER (WHERE tokens > 1800) AS overflows, count(*) FILTER (WHERE chunks > 6) AS too_many,
    round(CAST(sum(copies) AS DOUBLE) / sum(chunks), 6) AS duplicate_rate, sum(copies) = 0 AND count(*) FILTER (WHERE tokens > 1800) = 0 AS ready FROM ({rows})"""


def stage_cases(d):
    """Whether two stages measured the same cases: in both, in either alone."""
    return "SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (WHERE b IS NULL) AS first_only, count(*) FILTER (WHERE a IS NULL) AS second_only, count(*) = count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS same FROM (SELECT item_id AS a FROM benchmark) x FULL JOIN (SELECT doc_id AS b FROM documents WHERE n_chars > 100) y ON a = b"


def descriptor_audit(d):
    """What is wrong among chunks read as descriptors: without level, with a level outside the grid, twice under one level and text."""
    return f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE level IS NULL) AS orphans, count(*) FILTER (WHERE {rules.level_name('level')} IS NULL AND level IS NOT NULL) AS misclassified, CAST(sum(CASE WHEN place > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates
    FROM (SELECT *, row_number() OVER (PARTITION BY level, md5(lower(content)) ORDER BY id) AS place FROM {pieces_of(d)})"""


def import_report(d):
    """Rows of an import by the first reason for rejection, and accepted ones by level."""
    why = [("level IS NULL", "'UNKNOWN_LEVEL'"), (f"{d.count('content', rules.W + '+')} < 4", "'TOO_SHORT'"), (d.has("content", "[|]"), "'UNSUPPORTED_STRUCTURE'")]
    return f"SELECT reason, level, count(*) AS n FROM (SELECT {rules.first_of(why, chr(39) + 'ACCEPTED' + chr(39))} AS reason, level FROM {pieces_of(d)}) GROUP BY reason, level"


def continued_lines(d):
    """Chunks that go on in the next one of the file: no end of sentence, a lower-case start there, or an open bracket."""
    w = "OVER (PARTITION BY document_id ORDER BY chunk_index, id)"
    rows = f"SELECT *, lead(content) {w} AS after, lead(id) {w} AS next_id FROM {pieces_of(d)}"
    open_end = f"NOT {d.has('content', r'[.!?…؟][^' + rules.BLANK + r']*[' + rules.BLANK + r']*$')}"
    goes_on = f"{open_end} OR {d.has('after', r'^[' + rules.BLANK + r']*\p{Ll}')} OR {d.count('content', '[(]')} > {d.count('content', '[)]')}"
    return f"SELECT id, next_id FROM ({rows}) WHERE after IS NOT NULL AND ({goes_on})"


def planned_order(d):
    """Items of a file in the order of a plan of kinds, unknown kinds last, stable."""
    plan = rules.first_of([("kind = 'text'", "0"), ("kind = 'list'", "1")], "2")
    return f"SELECT id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY {plan}, chunk_index, id) AS BIGINT) AS place FROM {pieces_of(d)}"


def distinct_exercises(d):
    """The first block of each file and normalised beginning of 100 characters."""
    key = f"substr(lower({d.sub('content', '[' + rules.BLANK + ']+', ' ')}), 1, 100)"
    return f"SELECT document_id, id FROM (SELECT document_id, id, row_number() OVER (PARTITION BY document_id, {key} ORDER BY chunk_index, id) AS place FROM {pieces_of(d)}) WHERE place = 1"


def indexed_texts(d):
    """What is indexed of a chunk: headings and body, trimmed, on lines of their own; and its text for an embedding."""
    head, body = rules.trimmed(d, "coalesce(heading, '')"), rules.trimmed(d, "content")
    bare = rules.trimmed(d, d.sub("content", r"<!--\s*image\s*-->"))
    return f"""SELECT id, md5(concat_ws({d.lit(chr(10))}, nullif({head}, ''), nullif({body}, ''))) AS sparse_digest,
    md5(concat('Document: ', CAST(document_id AS STRING), CASE WHEN heading IS NOT NULL THEN concat({d.lit(chr(10))}, 'Section: ', heading) ELSE '' END, {d.lit(chr(10) * 2)}, {bare})) AS dense_digest FROM {pieces_of(d)}"""


def page_spans(d):
    """A file's pages and the kind that its items give: table before list before heading before mixed before text."""
    kind = [("bool_or(kind = 'table')", "'table'"), ("bool_or(kind = 'list')", "'list'"), ("bool_or(kind = 'heading')", "'heading'"), ("count(DISTINCT kind) > 1", "'mixed'")]
    return f"SELECT document_id, min(page) AS first_page, max(page) AS last_page, {rules.first_of(kind, chr(39) + 'text' + chr(39))} AS kind FROM {pieces_of(d)} GROUP BY document_id"


def labels_removed(d):
    """Answers without internal labels, in brackets, after a cue or bare, with any dash."""
    label = r"(?:BLOCK|SOURCE|CHUNK)[ _–—‑-]?[0-9]+"
    said = "concat(content, ' (voir BLOCK-', CAST(id % 9 AS STRING), ') [SOURCE ', CAST(id % 7 AS STRING), '], selon CHUNK_3 BLOCK–2')"
    clean = d.sub(d.sub(d.sub(d.sub("said", rf"\((?:voir |see )?{label}\)"), rf"\[{label}\]"), rf"(?:selon|d.après|according to) {label}"), label)
    return f"SELECT id, {clean} AS answer FROM (SELECT id, {said} AS said FROM {pieces_of(d)})"


def output_sanity(d):
    """Faults of a reviewed text against its original: empty, under 35 % of its letters, a marker lost, cut off."""
    why = [("trim(after) = ''", "'empty'"), (f"{d.count('after', r'\p{L}')} < {rules.num(0.35)} * {d.count('content', r'\p{L}')}", "'too_short'"), (f"{d.count('after', '[0-9]+[.)]')} < {d.count('content', '[0-9]+[.)]')}", "'marker_lost'"), (f"NOT {d.has('after', '[.!?…؟)]' + '[' + rules.BLANK + ']*$')}", "'truncated'")]
    return f"SELECT id, {rules.first_of(why, 'NULL')} AS fault FROM (SELECT id, content, substr(content, 1, CAST({div(d, 'length(content) * (40 + id % 61)', 100)} AS INT)) AS after FROM {pieces_of(d)})"


def block_titles(d):
    """A block's title: its line that names an exercise, else its heading, else a default."""
    line = d.keep(d.split("content", r"\r?\n"), "x", d.has("lower(x)", rules.TITLE))
    flat = d.sub(f"{d.join(line, chr(10))}", r"(?s)\n.*$")
    return f"SELECT id, coalesce(nullif(trim({d.sub(flat, '[ :—–]+$')}), ''), nullif(trim(heading), ''), 'Exercice') AS title FROM {pieces_of(d)}"


def passages_rendered(d):
    """Passages as they stand in a prompt: number, pages, heading, text; by file, within 4,000 characters."""
    one = f"concat('[', CAST(chunk_index + 1 AS STRING), '] p. ', CAST(page AS STRING), CASE WHEN heading IS NULL THEN '' ELSE concat(' — ', heading) END, {d.lit(chr(10))}, content)"
    return f"SELECT document_id, CAST(least(4000, length({joined(d, one, chr(10) * 2, 'chunk_index, id')})) AS BIGINT) AS chars, md5(substr({joined(d, one, chr(10) * 2, 'chunk_index, id')}, 1, 4000)) AS digest FROM {pieces_of(d)} GROUP BY document_id"


def demanded_complexity(d):
    """Whether a chunk of the levels up to B1 asks for complex sentences."""
    return f"SELECT id, level, ({d.has('lower(content)', '(?:phrases?|sentences?|texte?s?) (?:très )?(?:complexes?|longues?)')} OR {d.has('lower(content)', 'argument|nuance|complex')}) AS demanded FROM {pieces_of(d)} WHERE {rules.level_name('level')} IN ('A1', 'A2', 'B1')"


def provider_notes(d):
    """Delay and tokens that an error text of a provider tells, its category by keyword, and the text on one safe line."""
    said = "concat('Error ', CASE user_id % 4 WHEN 0 THEN '429 rate limit: retry after ' WHEN 1 THEN 'timeout, try again in ' WHEN 2 THEN 'quota exceeded; wait ' ELSE 'invalid key ' END, CAST(event_id % 60 AS STRING), 's', chr(10), 'total_tokens: ', CAST(event_id AS STRING))"
    low = "lower(said)"
    kind = [(rules.any_of(d, low, ("rate limit", "429")), "'rate_limit'"), (rules.any_of(d, low, ("timeout", "timed out")), "'timeout'"), (rules.any_of(d, low, ("quota",)), "'quota'"), (rules.any_of(d, low, ("api key", "invalid key")), "'configuration'")]
    return f"""SELECT event_id, CAST(nullif({d.first(low, '(?:after|in|wait) ([0-9]+)s', 1)}, '') AS BIGINT) AS delay, CAST(nullif({d.first(low, 'total_tokens: ([0-9]+)', 1)}, '') AS BIGINT) AS tokens, {rules.first_of(kind, "'unknown'")} AS category,
    substr(trim({d.sub('said', '[' + rules.BLANK + ']+', ' ')}), 1, 1000) AS safe, {rules.any_of(d, low, ('429', 'timeout'))} AS retryable FROM (SELECT event_id, {said} AS said FROM events)"""


def durations(d):
    """Minutes that a text names, and whether a lesson's steps add up to the asked ones."""
    said = "concat('Séance de ', CAST(30 + o_orderkey % 90 AS STRING), CASE o_orderkey % 3 WHEN 0 THEN ' minutes' WHEN 1 THEN 'min' ELSE ' mn' END)"
    minutes = f"CAST({d.first('said', '([0-9]+) *(?:minutes?|min|mn)', 1)} AS BIGINT)"
    return f"SELECT o_orderkey, {minutes} AS minutes, {minutes} = coalesce(steps, 0) AS consistent FROM (SELECT o_orderkey, {said} AS said FROM orders) o LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS steps FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"


def title_flags(d):
    """Whether a page's address names a framework's companion volume, in any spelling."""
    low = d.sub("lower(url)", "[^a-z0-9]+", " ")
    return f"SELECT page_id, {d.has(low, 'companion|cefr|cecr')} AS flagged, CAST(length({low}) AS BIGINT) AS n FROM pages"


def semantic_requests(d):
    """A request for material as the search gets it: what it is for, level, theme, skills, joined by semicolons."""
    steps = rules.search_request(d, "text")
    source = f"({judging.literal(judging.REQUESTS, 'item_id long, text string')} UNION ALL SELECT item_id + 1000, text FROM benchmark)" if d is D else "asked"
    return f"SELECT item_id, concat_ws('; ', 'exercices', 'niveau ' || asked_level, 'compétence : ' || nullif(asked_skills, ''), 'type : ' || asked_type, 'thème : ' || coalesce(nullif(asked_theme, ''), asked)) AS query FROM {rules.stated(source, steps)}"


def consistency_repair(d):
    """What a repair would do with each point: keep, attach sparse to one that is there, delete a stale one, make a missing one."""
    return f"SELECT action, count(*) AS n FROM (SELECT CASE WHEN p.id IS NULL THEN 'delete_stale' WHEN v.vec_id IS NULL THEN 'create' WHEN {d.has('p.content', r'[\p{L}\p{N}]')} THEN 'attach_sparse' ELSE 'keep' END AS action FROM {pieces_of(d)} p FULL JOIN (SELECT vec_id FROM embeddings) v ON v.vec_id = p.id) GROUP BY action"


def collection_guard(d):
    """Whether each collection may be used: one vector size and no zero vector; a label is a collection."""
    total = "aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x * x)" if d is S else "list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))"
    return f"SELECT label, count(*) AS n, CAST(min({d.size}(embedding)) AS BIGINT) AS size, min({d.size}(embedding)) = max({d.size}(embedding)) AND min({total}) > 0 AS valid FROM embeddings GROUP BY label"


def profile_modes(d):
    """How a search runs: by the asked profile, the fallbacks of a missing arm, and reranking that turns fusion off."""
    rows = "SELECT doc_id, doc_id % 3 AS profile, doc_id % 5 = 0 AS rerank, vec_id IS NOT NULL AS dense, n_chars > 20 AS sparse FROM documents LEFT JOIN embeddings ON vec_id = doc_id"
    mode = [("NOT dense AND NOT sparse", "'empty'"), ("profile = 0 OR rerank", "'dense'"), ("NOT sparse", "'dense_fallback'"), ("NOT dense", "'sparse_fallback'"), ("profile = 2", "'hybrid_ranked'")]
    return f"SELECT mode, count(*) AS n, count(*) FILTER (WHERE rerank) AS reranked FROM (SELECT *, {rules.first_of(mode, chr(39) + 'hybrid' + chr(39))} AS mode FROM ({rows})) GROUP BY mode"


ALL = (
    eligibility, ingestion_eligibility, page_overlap, guarded_fetch, owned_history, archive_states, access_guard, vector_payloads, chunk_sample, chunk_validation, request_validation, file_texts, embedding_queue, siblings, file_jobs,
    job_list, bound_items, answer_sources, case_summary, context_summary, stage_cases, descriptor_audit, import_report, continued_lines, planned_order, distinct_exercises, indexed_texts, page_spans, labels_removed, output_sanity,
    block_titles, passages_rendered, demanded_complexity, provider_notes, durations, title_flags, semantic_requests, consistency_repair, collection_guard, profile_modes,
)


def bound(spark, sql: str, tables: dict):
    """A query over DataFrames by name, which leaves the session's views as they are."""
    used = {}

    def name(found):
        used[found[3]] = tables[found[3]]()
        return f"{found[1]}{found[2]}{{{found[3]}}}"

    text = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(tables)})\b", name, sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **used)


def run(rule, arranged=lambda tables: tables):
    """The query of a rule; ``arranged`` may lay out the tables for it."""

    def query(spark, sf_dir):
        tables = {t: lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
        return bound(spark, rule(S), arranged(tables | {"pieces": lambda: judging.pieces(spark, sf_dir), "asked": lambda: judging.requests(spark, sf_dir)}))

    query.__doc__ = rule.__doc__
    return query


QUERIES = {rule.__name__: (run(rule), rule(D)) for rule in ALL}
