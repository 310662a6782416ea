"""Queries over fragments of exercises, exercise items, plans and activities."""

from __future__ import annotations

from ..functions import rules
from ..sources.shared import dealt
from . import keeping
from .keeping import D

#: Lines of orders that meet in one task, about: each stands in four hash tables there, with some 600 bytes in all.
LINES = 500_000


def fragment_windows(d):
    """A titled chunk with the chunks after it up to the next title, four at most: the text of an exercise in fragments."""
    titled = d.has("lower(content)", rules.TITLE)
    w = "OVER (PARTITION BY document_id ORDER BY chunk_index, id)"
    return f"""SELECT document_id, min(id) AS id, count(*) AS chunks, md5({keeping.joined(d, 'content', chr(10), 'chunk_index, id')}) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY document_id, part ORDER BY chunk_index, id) AS k
    FROM (SELECT *, sum(CASE WHEN {titled} THEN 1 ELSE 0 END) {w} AS part FROM {keeping.pieces_of(d)})) WHERE part > 0 AND k <= 5 GROUP BY document_id, part"""


def item_faults(d):
    """The first fault of an exercise item: empty, without blank or choices where its type needs them, an answer that the prompt gives away or can't make."""
    lines = d.keep(d.split("content", r"\n"), "x", d.has("x", rf"[^{rules.BLANK}]"))
    body = d.keep("lines", "x", d.has("lower(x)", rules.NUMBERED))
    why = [
        (f"{d.size}(lines) = 0", "'empty'"),
        (f"exercise_type = 'fill_blank' AND NOT {d.has('content', rules.BLANKS)}", "'no_blank'"),
        (f"exercise_type IN ('ordering', 'matching', 'true_false') AND {d.size}({body}) < 2", "'too_few_items'"),
        ("exercise_type = 'qcm' AND n_choices < 2", "'too_few_choices'"),
        ("exercise_type = 'open_question' AND NOT contains(content, '?')", "'no_question'"),
    ]
    steps = [*rules.exercise(d, "heading", "content"), {"lines": lines}]
    return f"SELECT id, exercise_type, {rules.first_of(why, chr(39) + 'valid' + chr(39))} AS fault FROM {rules.stated(keeping.pieces_of(d), steps)}"


def generated_plans(d):
    """How many items of each type a request for so many gets: types in turn, fifteen at most."""
    asked = "least(15, 3 + item_id % 17)"
    return f"""SELECT item_id, kind, count(*) AS n FROM (SELECT item_id, k, CASE (item_id + k) % 4 WHEN 0 THEN 'qcm' WHEN 1 THEN 'fill_blank' WHEN 2 THEN 'matching' ELSE 'true_false' END AS kind FROM
    (SELECT item_id FROM benchmark) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14)) v(k) WHERE k < {asked}) GROUP BY item_id, kind"""


def knowledge_sets(d):
    """An exercise set out of the store alone: of each type the blocks of best score, no beginning twice, three at most."""
    judged = rules.stated(keeping.pieces_of(d), [*rules.exercise(d, "heading", "content"), {"start": f"substr(lower({d.sub('content', '[' + rules.BLANK + ']+', ' ')}), 1, 80)"}])
    first = f"SELECT *, row_number() OVER (PARTITION BY exercise_type, start ORDER BY exercise_score DESC, id) AS copy FROM {judged}"
    return f"SELECT exercise_type, id, CAST(place AS BIGINT) AS place FROM (SELECT exercise_type, id, row_number() OVER (PARTITION BY exercise_type ORDER BY exercise_score DESC, id) AS place FROM ({first}) WHERE copy = 1) WHERE place <= 3"


def activity_faults(d):
    """Faults of an activity made of an order: steps that don't add up, no material, a repeated step, a duration out of bounds."""
    why = [("lines = 0", "'no_steps'"), ("parts < lines", "'repeated_material'"), ("minutes < 10 OR minutes > 180", "'duration_out_of_bounds'"), ("lines > 6", "'too_many_steps'")]
    inner = "SELECT o_orderkey, count(l_orderkey) AS lines, count(DISTINCT l_partkey) AS parts, coalesce(sum(l_quantity), 0) AS minutes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
    return f"SELECT fault, count(*) AS n, min(o_orderkey) AS first_id FROM (SELECT o_orderkey, {rules.first_of(why, chr(39) + 'valid' + chr(39))} AS fault FROM ({inner})) GROUP BY fault"


def by_order(tables: dict) -> dict:
    """Orders and their lines in parts of bounded size."""
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    made = dealt({t: tables[t]() for t in keys}, keys, LINES)
    return tables | {t: lambda df=df: df for t, df in made.items()}


ALL = (fragment_windows, item_faults, generated_plans, knowledge_sets, activity_faults)


QUERIES = {rule.__name__: (keeping.run(rule), rule(D)) for rule in ALL} | {"activity_faults": (keeping.run(activity_faults, by_order), activity_faults(D))}
