"""The rounds in SQL for DuckDB: the chain of the rules within itself, each round on the tables of the one before."""

from __future__ import annotations

from lexgraft.plans.apply import NEW
from lexgraft.plans.apply_sql import _APPLIED

ROUNDS = 3
#: A round's new rows, of all tables in one: t says which.
_DELTA = f"""added AS (SELECT entry_id, lemma, pos, gloss, entry_id + {NEW} AS synset_id FROM (SELECT entry_id, lemma, pos, gloss FROM slotted UNION ALL SELECT entry_id, lemma, pos, gloss FROM route WHERE route = 'modifier')),
  new_senses AS (SELECT DISTINCT lemma, pos, synset_id FROM (SELECT lemma, pos, synset_id FROM added UNION ALL SELECT m.lemma, y.pos, m.synset_id FROM merged m JOIN synset y USING (synset_id)) n WHERE NOT EXISTS (SELECT 1 FROM sense s WHERE s.lemma = n.lemma AND s.pos = n.pos AND s.synset_id = n.synset_id)),
  last_rank AS (SELECT lemma, pos, max(sense_rank) AS last FROM sense GROUP BY lemma, pos),
  new_edges AS (SELECT DISTINCT a.synset_id AS src, g.target AS dst, g.symbol AS pointer, CASE WHEN g.symbol IN ('!', '\\', '+') THEN 'word' ELSE 'synset' END AS level, CASE WHEN g.symbol IN ('!', '\\', '+') THEN 1 ELSE 0 END AS ord FROM granted g JOIN added a USING (entry_id))
  SELECT 'synset' AS t, synset_id AS a, NULL::BIGINT AS b, NULL::VARCHAR AS p, pos AS q, gloss AS r, NULL::INTEGER AS n FROM added
  UNION ALL SELECT 'sense', s.synset_id, NULL, s.lemma, s.pos, NULL, (coalesce(l.last, 0) + row_number() OVER (PARTITION BY s.lemma, s.pos ORDER BY s.synset_id))::INTEGER FROM new_senses s LEFT JOIN last_rank l ON l.lemma = s.lemma AND l.pos = s.pos
  UNION ALL SELECT 'edge', src, dst, pointer, level, NULL, ord FROM (SELECT * FROM new_edges EXCEPT SELECT src, dst, pointer, level, ord FROM edge)
  UNION ALL SELECT 'exception', NULL, NULL, surface, pos, base, NULL FROM (SELECT surface, pos, base FROM spelled_out EXCEPT SELECT surface, pos, base FROM exception)
  UNION ALL SELECT 'matched', entry_id, NULL, route, NULL, NULL, NULL FROM route"""


def version(k: int) -> str:
    """The tables after round k."""
    old = (lambda name: f"{name}_{k - 1}") if k > 1 else (lambda name: name)
    return f"""synset_{k} AS MATERIALIZED (SELECT synset_id, pos, gloss FROM {old('synset')} UNION ALL SELECT a, q, r FROM delta_{k} WHERE t = 'synset'),
  sense_{k} AS MATERIALIZED (SELECT lemma, pos, synset_id, sense_rank FROM {old('sense')} UNION ALL SELECT p, q, a, n FROM delta_{k} WHERE t = 'sense'),
  edge_{k} AS MATERIALIZED (SELECT src, dst, pointer, level, ord FROM {old('edge')} UNION ALL SELECT a, b, p, q, n FROM delta_{k} WHERE t = 'edge'),
  exception_{k} AS MATERIALIZED (SELECT surface, pos, base FROM {old('exception')} UNION ALL SELECT p, q, r FROM delta_{k} WHERE t = 'exception'),
  raw_{k} AS MATERIALIZED (SELECT * FROM {old('raw')} WHERE entry_id NOT IN (SELECT a FROM delta_{k} WHERE t = 'matched'))"""


def _rounds() -> str:
    out = []
    for k in range(1, ROUNDS + 1):
        shadow = "".join(f"{name} AS (SELECT * FROM {name}_{k - 1}), " for name in ("synset", "sense", "edge", "exception", "raw")) if k > 1 else ""
        out.append(f"delta_{k} AS MATERIALIZED (WITH {shadow}{_APPLIED},\n  {_DELTA})")
        out.append(version(k))
    return ",\n  ".join(out)


def _all(select: str, base: str, table: str) -> str:
    return f"WITH {_rounds()} {base} " + " ".join(f"UNION ALL SELECT {select}, {k} FROM delta_{k} WHERE t = '{table}'" for k in range(1, ROUNDS + 1))


SQL = {
    "store_synset": _all("a, q, md5(r)", "SELECT synset_id, pos, md5(gloss) AS gloss, 0 AS round FROM synset", "synset"),
    "store_sense": _all("p, q, a, n", "SELECT lemma, pos, synset_id, sense_rank, 0 AS round FROM sense", "sense"),
    "store_edge": _all("a, b, p, q, n", "SELECT src, dst, pointer, level, ord, 0 AS round FROM edge", "edge"),
    "store_exception": _all("p, q, r", "SELECT surface, pos, base, 0 AS round FROM exception", "exception"),
    "round_loop": f"WITH {_rounds()} SELECT 1 AS round, a AS entry_id, p AS route FROM delta_1 WHERE t = 'matched' UNION ALL SELECT 2, a, p FROM delta_2 WHERE t = 'matched' UNION ALL SELECT 3, a, p FROM delta_3 WHERE t = 'matched'",
}
