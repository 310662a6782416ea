"""Queries that judge chunks, requests and messages by the rules: quality, classes, levels, roles, exercises, chats.

Chunks are the documents, five to a source file, and the rows of SAMPLES, which show what invented prose
doesn't: Arabic, headings, exercises, dialogues, damaged text.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rules import Duck, Spark
from ..operators.impacts import BROADCAST_ROWS, if_small
from ..sources.shared import built

S, D = Spark(), Duck()

#: (id, document, place, page, kind, heading, level, content)
SAMPLES = [
    (1_000_000_001, 900_001, 0, 1, "text", "Leçon 1 > Lecture", "A1", "Lis le texte puis réponds aux questions."),
    (1_000_000_002, 900_001, 1, 1, "text", "Leçon 1", None, "اقرأ النص ثم أجب عن الأسئلة. Lis le texte puis réponds."),
    (1_000_000_003, 900_001, 2, 2, "text", "Leçon 1", None, "كوّن جملاً باستعمال الصور. Make sentences using the pictures."),
    (1_000_000_004, 900_001, 3, 3, "text", None, None, "Kw A,«aw «.3 34w... 33% ,3qm30... @990 JSA..."),
    (1_000_000_005, 900_001, 4, 3, "text", None, None, "c 3 gnaw, 'ml '43% m3 ¢"),
    (1_000_000_006, 900_002, 0, 1, "text", None, None, "."),
    (1_000_000_007, 900_002, 1, 1, "text", None, None, "___________"),
    (1_000_000_008, 900_002, 2, 2, "text", None, None, "1. ________"),
    (1_000_000_009, 900_002, 3, 2, "text", None, None, "□ □ □"),
    (1_000_000_010, 900_002, 4, 3, "table", None, "A1", "A1"),
    (1_000_000_011, 900_003, 0, 1, "text", "الدرس الأول", "A1", "اقرأ"),
    (1_000_000_012, 900_003, 1, 2, "text", "الدرس الأول", "A1", "نص عربي سليم عن الأسرة والبيت والمدرسة"),
    (1_000_000_013, 900_003, 2, 3, "text", None, None, "a8x@@@1qz//::x9kk...a7b@@@c3d//x5y"),
    (1_000_000_014, 900_003, 3, 4, "text", None, None, "alefisolated fathalow meemmedial arabicindicdigit"),
    (1_000_000_015, 900_003, 4, 4, "text", None, None, "https://example.org/a1 B1 12e"),
    (1_000_000_016, 900_004, 0, 1, "text", "Vocabulaire", "A1", "Exercice 1 : Complète les phrases.\n1. Je ____ à l'école.\n2. Tu ____ un livre."),
    (1_000_000_017, 900_004, 1, 1, "text", "Niveau B1 — Vocabulaire", None, "Choisis la bonne réponse.\na) le chat\nb) le chien\nc) la maison"),
    (1_000_000_018, 900_004, 2, 2, "list", "Grammaire", "A2", "Relie les mots.\n1. père\n2. mère\n3. sœur"),
    (1_000_000_019, 900_004, 3, 2, "text", None, None, "Vrai ou faux ?\n1. La famille est grande.\n2. Le père est absent."),
    (1_000_000_020, 900_004, 4, 3, "worksheet_exercise", "Dialogue", "A2+", "Remets les mots en ordre :\n1) école / vais / je"),
    (1_000_000_021, 900_005, 0, 1, "text", "Guide pédagogique", None, "Ce manuel présente une démarche pédagogique. Des exercices sont proposés pour chaque niveau."),
    (1_000_000_022, 900_005, 1, 1, "text", "Expression orale", "A1", "Enseignant : Bonjour, comment tu t'appelles ?\nÉlève : Je m'appelle Salma."),
    (1_000_000_023, 900_005, 2, 2, "text", "Compréhension de l'oral", "A2", "Consigne : écoutez le dialogue puis répondez aux questions. Qui parle ? Où est-il ?"),
    (1_000_000_024, 900_005, 3, 2, "text", "Production écrite", "B2", "Selon vous, la nuance de cet argument est-elle implicite ? Justifiez votre opinion en quelques phrases."),
    (1_000_000_025, 900_005, 4, 3, "table", "Descripteurs", "B1", "Niveau | Peut | Score\n--- | --- | ---\nA1 | peut saluer | 3\nA2 | peut décrire | 4"),
    (1_000_000_026, 900_006, 0, 1, "text", "تمرين 4", None, "تمرين 4: رتب الكلمات\n1. المدرسة\n2. إلى\n3. أذهب"),
    (1_000_000_027, 900_006, 1, 1, "text", None, None, "السؤال الأول\nالاختيارات:\n- بيت\n- كتاب\n- قلم"),
    (1_000_000_028, 900_006, 2, 2, "text", None, None, "exercice exercice exercice"),
    (1_000_000_029, 900_006, 3, 2, "text", None, "A1", "Rôle : serveur. Le client commande un thé et le serveur répond."),
    (1_000_000_030, 900_006, 4, 3, "text", "مستوى أ2", None, "هذا نشاط حول أفراد الأسرة، ثم حوار قصير بين التلاميذ في المدرسة."),
]
SAMPLE_TYPES = "id long, document_id long, chunk_index long, page long, kind string, heading string, level string, content string"
#: Requests for exercises or lessons.
REQUESTS = [
    (1, "exercices A1 de vocabulaire sur l'école"),
    (2, "Je cherche des exercices sur la famille"),
    (3, "تمارين في المستوى أ2 عن الأسرة"),
    (4, "un QCM de grammaire niveau B1"),
    (5, "vrai ou faux sur la famille, compréhension écrite A2"),
    (6, "comment enseigner le dialogue au restaurant"),
    (7, "jeu de rôle : le client et le serveur"),
    (8, "activité d'écoute sur la maison"),
]
#: (conversation, turn, role, text)
TURNS = [
    (900_001, 1, "user", "Propose-moi une activité orale A1 sur la famille."),
    (900_001, 2, "assistant", "Voici une activité A1."),
    (900_001, 3, "user", "Et pour la lecture ?"),
    (900_002, 1, "user", "Please make a reading lesson at level B2."),
    (900_002, 3, "user", "Now answer in english, and shorter."),
    (900_003, 1, "user", "أجب بالعربية من فضلك، المستوى A2+"),
    (900_003, 3, "user", "نشاط في المحادثة"),
    (900_004, 1, "user", "Une compréhension orale PRE-A1 , avec écoute ."),
    (900_004, 3, "user", "Rends la famille plus visible"),
]


def literal(rows, names: str) -> str:
    """Rows as a SELECT of the reference engine."""
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else D.lit(v)
    kinds = {"long": "BIGINT", "string": "VARCHAR"}
    columns = [c.split() for c in names.split(", ")]
    return "SELECT " + ", ".join(f"{n}::{kinds[t]} AS {n}" for n, t in columns) + f" FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({', '.join(n for n, _ in columns)})"


def pieces(spark, d):
    """Chunks: documents as places of source files, and the samples."""
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr(
        "doc_id AS id", "doc_id div 5 AS document_id", "doc_id % 5 AS chunk_index", "doc_id % 5 div 2 + 1 AS page", "CASE doc_id % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'list' ELSE 'text' END AS kind",
        "concat(source, ' > ', lang) AS heading", "CASE doc_id % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'B1' WHEN 2 THEN 'PRE-A1' END AS level", "text AS content",
    )
    return docs.unionByName(spark.createDataFrame(SAMPLES, SAMPLE_TYPES))


PIECES = f"""(SELECT doc_id AS id, doc_id // 5 AS document_id, doc_id % 5 AS chunk_index, doc_id % 5 // 2 + 1 AS page, CASE doc_id % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'list' ELSE 'text' END AS kind,
 source || ' > ' || lang AS heading, CASE doc_id % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'B1' WHEN 2 THEN 'PRE-A1' END AS level, text AS content FROM documents UNION ALL {literal(SAMPLES, SAMPLE_TYPES)})"""


def quality_steps(d):
    return [*rules.quality(d, "content"), *rules.native_level(d), *rules.table_cells(d, "content"), *rules.page_decision(d)]


def page_quality(spark, d):
    """Each chunk's quality: words, score, reasons, languages, how far its own text is trusted, and what is decided."""
    return rules.applied(pieces(spark, d), quality_steps(S)).selectExpr(
        "id", "CAST(q_n_words AS BIGINT) AS n_words", "q_score AS score", "q_reasons AS reasons", "q_languages AS languages", "q_passed AS passed", "native", "decision", "CAST(cells AS BIGINT) AS cells"
    )


PAGE_QUALITY = f"SELECT id, q_n_words::BIGINT AS n_words, q_score AS score, q_reasons AS reasons, q_languages AS languages, q_passed AS passed, native, decision, cells::BIGINT AS cells FROM {rules.stated(PIECES, quality_steps(D))}"

DISPOSITION = "CASE WHEN failed = 0 THEN 'complete' WHEN failed <= 0.2 * pages AND pages - failed >= 1 THEN 'partial' ELSE 'failed' END"


def dispositions(spark, d):
    """Of each source file the pages without a sound chunk, their share, and whether it is taken whole, in part or not."""
    sound = rules.applied(pieces(spark, d), rules.quality(S, "content")).groupBy("document_id", "page").agg(F.bool_or("q_passed").alias("passed"))
    counted = sound.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(~F.col("passed")).alias("failed"))
    return counted.selectExpr("*", "round(failed / pages, 6) AS failed_ratio", f"{DISPOSITION} AS disposition")


def arabic_profiles(spark, d):
    """Source files with two or more trusted pages that hold Arabic; there a page of noisy Latin is a mismatch."""
    steps = [*rules.quality(S, "content"), *rules.native_level(S)]
    rows = rules.applied(pieces(spark, d), steps).withColumn("sure", F.expr("native = 'high_confidence' AND q_arabic > 0"))
    profiled = rows.withColumn("profile", F.count_if("sure").over(Window.partitionBy("document_id")) >= 2)
    again = rules.applied(profiled.drop("hard", "mismatch", "native"), rules.native_level(S, "profile"))
    return again.groupBy("profile", "native").agg(F.count("*").alias("n"), F.count_if("mismatch").alias("mismatches"))


_TWICE = f"(SELECT * EXCLUDE (hard, mismatch, native), count(*) FILTER (native = 'high_confidence' AND q_arabic > 0) OVER (PARTITION BY document_id) >= 2 AS profile FROM {rules.stated(PIECES, [*rules.quality(D, 'content'), *rules.native_level(D)])})"


def chunk_classes(spark, d):
    """Each chunk's class and the reason: semantic, of little information, or corrupted."""
    sized = pieces(spark, d).withColumn("n_tokens", F.expr(S.count("content", TOKEN)))
    return rules.applied(sized, rules.chunk_class(S, "content", "kind", "n_tokens")).select("id", "chunk_class", "chunk_reason")


TOKEN = rf"{rules.W}+|[^{rules.BLANK}\p{{L}}\p{{N}}_]"


def level_judgements(spark, d):
    """The level that a chunk states, by index, heading or text, and the one that its sentences suggest."""
    steps = [*rules.explicit_level(S, "level", "heading", "content"), *rules.estimated_level(S, "content")]
    return rules.applied(pieces(spark, d), steps).select("id", "explicit_level", "level_guess", F.col("level_confidence").alias("confidence"))


LEVELS_SQL = rules.stated(PIECES, [*rules.explicit_level(D, "level", "heading", "content"), *rules.estimated_level(D, "content")])


def role_steps(d):
    return [*[{k.replace("role", "metric_role"): e.replace("role_evidence", "metric_role_evidence") for k, e in x.items()} for x in rules.role(d, "kind", "heading", "content", speakers=False)], *rules.role(d, "kind", "heading", "content"), *rules.concreteness(d, "kind", "heading", "content")]


def chunk_roles(spark, d):
    """Each chunk's role, for the ranker and for the metrics, and what makes it classroom material."""
    return rules.applied(pieces(spark, d), role_steps(S)).select("id", "role", "metric_role", "concrete_reason")


ASKED = "CASE document_id % 4 WHEN 0 THEN 'activity' WHEN 1 THEN 'exercise' WHEN 2 THEN 'listening' ELSE 'general' END"


def ranked_steps(d):
    """Chunks of a source file as candidates of a request, in order of place."""
    return [
        {"intent": ASKED, "wanted_level": "CASE WHEN document_id % 3 < 2 THEN 'A1' END", "wanted_skill": "CASE WHEN document_id % 2 = 0 THEN 'listening' END", "rank": "chunk_index + 1"},
        *rules.role(d, "kind", "heading", "content"),
        *rules.concreteness(d, "kind", "heading", "content"),
        *rules.skill_evidence(d, "heading", "content"),
        *rules.adjustments("intent", "level", "wanted_level", "wanted_skill"),
        {"gate": f"greatest({rules.num(0.35)}, 1 - {rules.num(0.04)} * (rank - 1))"},
        {"final_score": f"round(1 - {rules.num(0.025)} * (rank - 1) + gate * (role_adjustment + concrete_adjustment + level_adjustment + skill_adjustment), 6)"},
    ]


def ranked_pieces(spark, d):
    """Final scores and ranks of candidates with their four adjustments, gated by rank."""
    order = Window.partitionBy("document_id").orderBy(F.desc("final_score"), "rank", "id")
    rows = rules.applied(pieces(spark, d), ranked_steps(S)).withColumn("final_rank", F.row_number().over(order).cast("long"))
    return rows.select("id", *[F.round(F.col(c) * F.col("gate"), 6).alias(c) for c in ADJUSTMENTS], "final_score", "final_rank")


ADJUSTMENTS = ("role_adjustment", "concrete_adjustment", "level_adjustment", "skill_adjustment")
RANKED = rules.stated(PIECES, ranked_steps(D))
WISHED = {k: rules.PREFERRED.get(k, ()) for k in ("activity", "exercise", "listening")}


def wished(role: str = "role") -> str:
    """Whether a role is one that the intent prefers; null for an intent without preferences."""
    return rules.first_of([(f"intent = '{k}'", f"{role} IN ({', '.join(f'{chr(39)}{r}{chr(39)}' for r in v)})") for k, v in WISHED.items()], "NULL")


def union_diagnostics(spark, d):
    """Whether a request's candidates hold a wished role, classroom material, or both, and the best such rank."""
    rows = rules.applied(pieces(spark, d), [*ranked_steps(S), {"wished": wished()}])
    return rows.groupBy("document_id").agg(
        F.bool_or("wished").alias("desired"), F.bool_or("concrete").alias("concrete"), F.bool_or(F.col("wished") & F.col("concrete")).alias("both"), F.min(F.when(F.col("wished") & F.col("concrete"), F.col("rank"))).alias("best_rank")
    )


def role_metrics(spark, d):
    """Wished roles among the first three and five, the first rank, and concrete chunks, of each request."""
    rows = rules.applied(pieces(spark, d), [*ranked_steps(S), {"wished": f"coalesce({wished()}, false)"}])
    return rows.groupBy("document_id").agg(
        F.count_if(F.col("wished") & (F.col("rank") <= 3)).alias("top3"), F.count_if(F.col("wished") & (F.col("rank") <= 5)).alias("top5"), F.min(F.when(F.col("wished"), F.col("rank"))).alias("first_rank"), F.count_if("concrete").alias("concrete")
    )


LEGACY = "CASE document_id % 3 WHEN 0 THEN 'concrete_activity' WHEN 1 THEN 'concrete_exercise' ELSE 'general' END"


def legacy_place(intent: str = "intent", role: str = "role") -> str:
    cases = [(f"{intent} = '{k}' AND {role} = '{r}'", str(i)) for k, prefs in rules.PREFERRED_LEGACY.items() for i, r in enumerate(prefs)]
    return rules.first_of(cases, rules.first_of([(f"{intent} = '{k}'", str(len(v))) for k, v in rules.PREFERRED_LEGACY.items()], "0"))


def band_steps(d):
    return [*rules.role(d, "kind", "heading", "content", speakers=False), {"intent": LEGACY, "rank": "chunk_index + 1"}, {"band": "(rank - 1) // 3" if d.size == "len" else "(rank - 1) div 3", "preference": legacy_place()}]


def role_bands(spark, d):
    """The legacy order: within bands of three ranks by the intent's preferred roles, then rank, then id."""
    order = Window.partitionBy("document_id").orderBy("band", F.when(F.col("intent") == "general", 0).otherwise(F.col("preference")), "rank", "id")
    rows = rules.applied(pieces(spark, d), band_steps(S))
    return rows.select("id", "role", F.row_number().over(order).cast("long").alias("place"))


def requests(spark, d):
    given = spark.createDataFrame(REQUESTS, "item_id long, text string")
    return given.unionByName(spark.read.parquet(f"{d}/benchmark.parquet").selectExpr("item_id + 1000 AS item_id", "text"))


ASKED_SQL = f"({literal(REQUESTS, 'item_id long, text string')} UNION ALL SELECT item_id + 1000, text FROM benchmark)"


def exercise_requests(spark, d):
    """What a search for exercises asks for: level, skills, type, theme; and a request's intent."""
    rows = rules.applied(requests(spark, d), [*rules.search_request(S, "text"), {"intent": rules.intent(S, "text")}])
    return rows.select("item_id", "asked_level", "asked_skills", "asked_type", "asked_theme", "intent")


def block_steps(d):
    return [*rules.exercise(d, "heading", "content"), {"skill": rules.skills_in(d, "lower(concat_ws(' ', heading, content))", rules.SEARCH_SKILLS)}]


def exercise_scores(spark, d):
    """Each chunk's signals of an exercise, their weighted sum, its confidence, type and skills."""
    rows = rules.applied(pieces(spark, d), block_steps(S))
    return rows.selectExpr("id", "CAST(exercise_score AS BIGINT) AS score", "exercise_reasons AS reasons", "exercise_confidence AS confidence", "is_exercise", "exercise_type AS kind", "skill AS skills")


#: What retrieval, structure, theme, level, skill, type and source weigh in the blended score.
BLEND = {"retrieval": 0.40, "structure": 0.20, "theme": 0.12, "level": 0.12, "skill": 0.08, "type": 0.03, "source": 0.05}
FOUND, KEPT = 24, 12


def blend_steps(d):
    """The parts of the blended score of (request, block); ``place`` is the block's rank among the request's candidates."""
    wanted = "contains(concat(',', skill, ','), concat(',', asked_first_skill, ','))"
    return [
        {
            "part_retrieval": f"greatest({rules.num(0)}, 1 - CAST(place - 1 AS DOUBLE) / {FOUND})",
            "part_structure": "exercise_confidence",
            "part_theme": "CASE WHEN n_theme > 0 THEN CAST(n_shared AS DOUBLE) / n_theme ELSE CAST(0.5 AS DOUBLE) END",
            "part_level": f"CASE WHEN asked_level IS NULL THEN {rules.num(0.5)} WHEN explicit_level = asked_level THEN {rules.num(1)} WHEN explicit_level IS NULL THEN {rules.num(0.3)} ELSE {rules.num(0)} END",
            "part_skill": f"CASE WHEN asked_first_skill = '' THEN {rules.num(0.5)} WHEN {wanted} THEN {rules.num(1)} ELSE {rules.num(0)} END",
            "part_type": f"CASE WHEN exercise_type = asked_type THEN {rules.num(1)} ELSE {rules.num(0)} END",
            "part_source": rules.num(1),
        },
        {"blended": "round(" + " + ".join(f"{rules.num(w)} * part_{k}" for k, w in BLEND.items()) + ", 6)"},
    ]


def candidate_steps(d):
    return [*block_steps(d), *rules.explicit_level(d, "level", "heading", "content")]


REQUEST_STEPS = lambda d: [*rules.search_request(d, "text"), {"asked_words": d.split("asked_theme", " "), "asked_first_skill": d.sub("asked_skills", ",.*$")}]


def exercise_search(spark, d):
    """For each request, the items' included, the twelve best exercises of its type, or of any where it names none, by the blended score.

    A block of another explicit level than the asked one is excluded. Requests are a stated set; blocks meet
    them by type.
    """
    asked = rules.applied(requests(spark, d), REQUEST_STEPS(S))
    asked = asked.withColumn("kinds", F.when(F.col("asked_type").isNull(), F.array(*map(F.lit, TYPES))).otherwise(F.array("asked_type"))).withColumn("exercise_type", F.explode("kinds"))
    judged = rules.applied(pieces(spark, d), candidate_steps(S))
    asked = if_small(built(asked.select("item_id", "asked_level", "asked_type", "asked_first_skill", "asked_words", "exercise_type")), BROADCAST_ROWS)
    blocks = rules.settled(judged.withColumn("low", F.lower("content")), "id", "low", "exercise_type", "exercise_confidence", "explicit_level", "skill", "is_exercise").filter("is_exercise")
    met = blocks.join(asked, "exercise_type")
    sound = met.filter("asked_level IS NULL OR explicit_level IS NULL OR explicit_level = asked_level")
    shared = F.size(F.filter("asked_words", lambda w: (w != "") & F.contains("low", w)))
    counted = sound.withColumn("n_shared", shared).withColumn("n_theme", F.size(F.filter("asked_words", lambda w: w != "")))
    order = Window.partitionBy("item_id").orderBy(F.desc("n_shared"), F.desc("exercise_confidence"), "id")
    found = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= FOUND)
    best = Window.partitionBy("item_id").orderBy(F.desc("blended"), "place")
    rows = rules.applied(found, blend_steps(S)).withColumn("final", F.row_number().over(best)).filter(F.col("final") <= KEPT)
    return rows.select("item_id", "id", F.col("final").cast("long").alias("place"), "blended")


TYPES = ("matching", "true_false", "ordering", "transformation", "production", "fill_blank", "qcm", "open_question", "mixed")
_SEARCH = f"""WITH a AS (SELECT *, unnest(CASE WHEN asked_type IS NULL THEN [{', '.join(f"'{t}'" for t in TYPES)}] ELSE [asked_type] END) AS exercise_type FROM {rules.stated(ASKED_SQL, REQUEST_STEPS(D))}),
 b AS (SELECT id, content, exercise_type, exercise_confidence, explicit_level, skill FROM {rules.stated(PIECES, candidate_steps(D))} WHERE is_exercise),
 m AS (SELECT item_id, asked_level, asked_type, asked_first_skill, b.*, len(list_filter(asked_words, lambda w: w <> '' AND contains(lower(content), w))) AS n_shared, len(list_filter(asked_words, lambda w: w <> '')) AS n_theme
   FROM b JOIN a USING (exercise_type) WHERE asked_level IS NULL OR explicit_level IS NULL OR explicit_level = asked_level),
 f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_shared DESC, exercise_confidence DESC, id) AS place FROM m QUALIFY place <= {FOUND})
 SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY blended DESC, place) AS place, blended FROM {rules.stated('f', blend_steps(D))} r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY blended DESC, r.place) <= {KEPT}"""


def turns(spark, d):
    given = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    return given.unionByName(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text"))


TURNS_SQL = f"({literal(TURNS, 'conv_id long, turn long, role string, text string')} UNION ALL SELECT conv_id, turn, role, text FROM conversations)"


def asked_parameters(spark, d):
    """Level, skills and language of each conversation: of the newest message of the user, else of the latest earlier one that has them."""
    users = rules.applied(turns(spark, d).filter("role = 'user'"), rules.chat_parameters(S, "text"))
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("turn")))
    newest = users.groupBy("conv_id").agg(*[F.max_by(c, "turn").alias(f"now_{c}") for c in CHAT], *[last(c).alias(c) for c in CHAT[:3]])
    source = lambda c, now: F.when(F.col(f"now_{c}").isNotNull(), now).when(F.col(c).isNotNull(), F.lit("history")).alias(f"{c}_source")
    return newest.select("conv_id", *CHAT[:3], source("chat_level", F.lit("current_message")), source("chat_skills", F.lit("current_message")), source("chat_language", F.col("now_chat_language_source")))


CHAT = ("chat_level", "chat_skills", "chat_language", "chat_language_source")
_ASKED = ", ".join(f"arg_max({c}, turn) FILTER ({c} IS NOT NULL) AS {c}" for c in CHAT[:3])
_NOW = ", ".join(f"last({c} ORDER BY turn) AS now_{c}" for c in CHAT)


def retrieval_topics(spark, d):
    """The newest message of the user after what is left of the three before it without level and skill words."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    users = turns(spark, d).filter("role = 'user'").withColumn("back", F.row_number().over(w)).filter("back <= 4")
    text = users.withColumn("part", F.when(F.col("back") == 1, F.trim("text")).otherwise(F.expr(rules.without_signals(S, "text"))))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"])
    return text.groupBy("conv_id").agg(F.array_join(F.filter(parts, lambda p: p != ""), "\n").alias("topic"))


QUERIES = {
    "page_quality": (page_quality, PAGE_QUALITY),
    "dispositions": (
        dispositions,
        f"SELECT *, round(failed / pages, 6) AS failed_ratio, {DISPOSITION} AS disposition FROM (SELECT document_id, count(*) AS pages, count(*) FILTER (NOT passed) AS failed FROM (SELECT document_id, page, bool_or(q_passed) AS passed FROM {rules.stated(PIECES, rules.quality(D, 'content'))} GROUP BY ALL) GROUP BY document_id)",
    ),
    "arabic_profiles": (arabic_profiles, f"SELECT profile, native, count(*) AS n, count(*) FILTER (mismatch) AS mismatches FROM {rules.stated(_TWICE, rules.native_level(D, 'profile'))} GROUP BY ALL"),
    "chunk_classes": (chunk_classes, f"SELECT id, chunk_class, chunk_reason FROM {rules.stated(f'(SELECT *, {D.count("content", TOKEN)} AS n_tokens FROM {PIECES})', rules.chunk_class(D, 'content', 'kind', 'n_tokens'))}"),
    "level_judgements": (level_judgements, f"SELECT id, explicit_level, level_guess, level_confidence AS confidence FROM {LEVELS_SQL}"),
    "chunk_roles": (chunk_roles, f"SELECT id, role, metric_role, concrete_reason FROM {rules.stated(PIECES, role_steps(D))}"),
    "ranked_pieces": (
        ranked_pieces,
        "SELECT id, " + ", ".join(f"round({c} * gate, 6) AS {c}" for c in ADJUSTMENTS) + f", final_score, row_number() OVER (PARTITION BY document_id ORDER BY final_score DESC, rank, id) AS final_rank FROM {RANKED}",
    ),
    "union_diagnostics": (
        union_diagnostics,
        f"SELECT document_id, bool_or(wished) AS desired, bool_or(concrete) AS concrete, bool_or(wished AND concrete) AS both, min(rank) FILTER (wished AND concrete) AS best_rank FROM {rules.stated(RANKED, [{'wished': wished()}])} GROUP BY document_id",
    ),
    "role_metrics": (
        role_metrics,
        f"SELECT document_id, count(*) FILTER (wished AND rank <= 3) AS top3, count(*) FILTER (wished AND rank <= 5) AS top5, min(rank) FILTER (wished) AS first_rank, count(*) FILTER (concrete) AS concrete FROM {rules.stated(RANKED, [{'wished': wished()}])} GROUP BY document_id",
    ),
    "role_bands": (role_bands, f"SELECT id, role, row_number() OVER (PARTITION BY document_id ORDER BY band, CASE WHEN intent = 'general' THEN 0 ELSE preference END, rank, id) AS place FROM {rules.stated(PIECES, band_steps(D))}"),
    "exercise_requests": (exercise_requests, f"SELECT item_id, asked_level, asked_skills, asked_type, asked_theme, intent FROM {rules.stated(ASKED_SQL, [*rules.search_request(D, 'text'), {'intent': rules.intent(D, 'text')}])}"),
    "exercise_scores": (
        exercise_scores,
        f"SELECT id, exercise_score::BIGINT AS score, exercise_reasons AS reasons, exercise_confidence AS confidence, is_exercise, exercise_type AS kind, skill AS skills FROM {rules.stated(PIECES, block_steps(D))}",
    ),
    "exercise_search": (exercise_search, _SEARCH),
    "asked_parameters": (
        asked_parameters,
        f"""SELECT conv_id, chat_level, chat_skills, chat_language, CASE WHEN now_chat_level IS NOT NULL THEN 'current_message' WHEN chat_level IS NOT NULL THEN 'history' END AS chat_level_source,
        CASE WHEN now_chat_skills IS NOT NULL THEN 'current_message' WHEN chat_skills IS NOT NULL THEN 'history' END AS chat_skills_source, CASE WHEN now_chat_language IS NOT NULL THEN now_chat_language_source WHEN chat_language IS NOT NULL THEN 'history' END AS chat_language_source
        FROM (SELECT conv_id, {_ASKED}, {_NOW} FROM {rules.stated(f"(SELECT * FROM {TURNS_SQL} WHERE role = 'user')", rules.chat_parameters(D, 'text'))} GROUP BY conv_id)""",
    ),
    "retrieval_topics": (
        retrieval_topics,
        f"""SELECT conv_id, coalesce(string_agg(part, chr(10) ORDER BY turn) FILTER (part <> ''), '') AS topic FROM (SELECT conv_id, turn, CASE WHEN back = 1 THEN trim(text) ELSE {rules.without_signals(D, 'text')} END AS part
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {TURNS_SQL} WHERE role = 'user' QUALIFY back <= 4)) GROUP BY conv_id""",
    ),
}
