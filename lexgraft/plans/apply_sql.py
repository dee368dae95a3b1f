"""The queries of apply in SQL for DuckDB."""

from __future__ import annotations

from lexgraft.plans.rules import ALWAYS_PERSON
from lexgraft.plans.rules_sql import _DECIDED, _FOUND, _top, _voted, quoted, stems

VALID = r"regexp_matches(replace(lemma, ' ', '_'), '^[\w''-]+[A-Za-z0-9]$') AND length(lemma) < 47"
FITS = r"length(gloss) BETWEEN 3 AND 250 AND NOT regexp_matches(gloss, '[^\x00-\x7F]')"


def balanced(g: str) -> str:
    count = lambda c: f"(length({g}) - length(replace({g}, '{c}', '')))"
    return f"repeat('(', greatest({count(')')} - {count('(')}, 0)::INTEGER) || {g} || repeat(')', greatest({count('(')} - {count(')')}, 0)::INTEGER)"


_LINKED_DOMAINS = f"""dlinks AS ({_top('entry_id, d_word AS domain, synset_id AS target', "(SELECT d.entry_id, d.word AS d_word, r.synset_id, r.rank, c.extended FROM domains d JOIN ranked r ON r.word = d.word AND r.wpos = 'noun' JOIN cos c ON c.entry_id = d.entry_id AND c.part = 'all' AND c.synset_id = r.synset_id)", 'TRUE', 'entry_id, d_word', 'extended', -1)}),
  domain_links AS (SELECT DISTINCT entry_id, domain, target FROM dlinks)"""
_APPLIED = (
    _DECIDED
    + f""",
  {_LINKED_DOMAINS},
  n_senses AS (SELECT lemma, count(*) AS senses FROM sense GROUP BY lemma),
  flags AS (SELECT f.entry_id, e.lemma, e.pos, e.gloss, bool_or(f.op = 'lexicalise') AS lex, bool_or(f.op = 'merge') AS merged, bool_or(f.op = 'hypernym') AS under FROM first_match f JOIN e USING (entry_id) GROUP BY ALL),
  route AS MATERIALIZED (SELECT entry_id, lemma, pos, gloss, CASE WHEN NOT ({VALID} AND (({FITS}) OR merged OR lex)) OR coalesce(senses, 0) > 99 THEN 'drop' WHEN lex THEN 'exception' WHEN merged THEN 'merge' WHEN pos IN ('adjective', 'adverb') THEN 'modifier' WHEN under THEN 'new synset' END AS route
    FROM flags LEFT JOIN n_senses USING (lemma)),
  to_merge AS (SELECT f.target, r.lemma, min(f.entry_id) AS entry_id FROM first_match f JOIN route r USING (entry_id) WHERE f.op = 'merge' AND r.route = 'merge' GROUP BY f.target, r.lemma),
  capped AS (SELECT * EXCLUDE (rn, senses) FROM (SELECT r.*, row_number() OVER (PARTITION BY lemma ORDER BY entry_id) AS rn FROM route r WHERE route = 'new synset') LEFT JOIN n_senses USING (lemma) WHERE coalesce(senses, 0) + rn - 1 <= 99),
  goes_under AS (SELECT entry_id, min(target) AS target FROM first_match WHERE op = 'hypernym' GROUP BY entry_id),
  n_pointers AS (SELECT src AS target, count(DISTINCT CASE WHEN level = 'synset' THEN pointer END) + count(CASE WHEN level = 'word' THEN 1 END) AS base FROM edge GROUP BY src),
  linked AS (SELECT DISTINCT entry_id, CASE op WHEN 'antonym' THEN '!' WHEN 'pertainym' THEN '\\' WHEN 'derived' THEN '\\' WHEN 'similar to' THEN '&' WHEN 'member meronym' THEN '%m' WHEN 'domain topic' THEN ';c' END AS symbol, target
    FROM (SELECT entry_id, op, target FROM first_match UNION ALL SELECT entry_id, 'domain topic', target FROM domain_links WHERE entry_id IN (SELECT entry_id FROM first_match)) WHERE op NOT IN ('hypernym', 'merge', 'lexicalise') AND target IS NOT NULL),
  crowded AS (SELECT DISTINCT synset_id FROM sense JOIN n_senses USING (lemma) WHERE senses > 99),
  wants AS (SELECT c.entry_id, 0 AS place, 0 AS seq, '@' AS symbol, u.target FROM capped c JOIN goes_under u USING (entry_id)
    UNION ALL SELECT l.entry_id, p.place, 1, l.symbol, l.target FROM linked l JOIN (SELECT entry_id, 0 AS place FROM capped JOIN goes_under USING (entry_id) UNION ALL SELECT entry_id, 1 FROM route WHERE route = 'modifier') p USING (entry_id) WHERE l.target NOT IN (SELECT synset_id FROM crowded)),
  -- no target of the given tables is full, so that an entry that falls gives no room back
  granted AS (SELECT w.entry_id, w.symbol, w.target FROM wants w LEFT JOIN n_pointers p USING (target) QUALIFY coalesce(p.base, 0) + row_number() OVER (PARTITION BY w.target ORDER BY w.place, w.entry_id, w.seq, w.symbol) <= 500),
  roomy AS (SELECT c.*, g.target FROM capped c JOIN granted g ON g.entry_id = c.entry_id AND g.symbol = '@'),
  free AS (SELECT low, pos, slot, row_number() OVER (PARTITION BY low, pos ORDER BY slot) AS rn FROM (SELECT DISTINCT lower(lemma) AS low, pos FROM route WHERE route = 'new synset') n CROSS JOIN generate_series(1, 15) g(slot)
    WHERE NOT EXISTS (SELECT 1 FROM sense s WHERE lower(s.lemma) = n.low AND s.pos = n.pos AND s.sense_rank = g.slot)),
  slotted AS (SELECT r.*, f.slot, replace(r.lemma, ' ', '_') || CASE WHEN regexp_matches(r.lemma, '[0-9]$') THEN '"' ELSE '' END || f.slot AS file_id FROM (SELECT *, lower(lemma) AS low, row_number() OVER (PARTITION BY lower(lemma), pos ORDER BY entry_id) AS rn FROM roomy) r JOIN free f USING (low, pos, rn)),
  link_list AS (SELECT entry_id, string_agg(target || ',' || symbol, ' ' ORDER BY target || ',' || symbol) AS links FROM granted WHERE symbol <> '@' GROUP BY entry_id),
  modified AS (SELECT r.entry_id, r.lemma, r.pos, r.gloss, l.symbol, l.target FROM route r LEFT JOIN (SELECT * FROM granted WHERE symbol <> '@') l USING (entry_id) WHERE r.route = 'modifier'),
  merged AS (SELECT target AS synset_id, lemma FROM to_merge m WHERE NOT EXISTS (SELECT 1 FROM sense s WHERE s.synset_id = m.target AND s.lemma = m.lemma)),
  spellings AS (SELECT DISTINCT r.pos, replace(r.lemma, ' ', '_') AS surface, f.how AS base FROM first_match f JOIN route r USING (entry_id) WHERE f.op = 'lexicalise' AND r.route = 'exception'),
  apart AS (SELECT * FROM spellings WHERE regexp_matches(base, '^[\\w''-]+[A-Za-z0-9]$') AND length(base) < 47 AND NOT list_contains({stems('surface')}, base)),
  sides_of AS (SELECT DISTINCT pos, replace(unnest([surface, base]), '_', ' ') AS lemma FROM apart),
  known_side AS (SELECT DISTINCT pos, lemma FROM (SELECT pos, lemma, unnest(list_append({stems('lemma')}, lemma)) AS form FROM sides_of UNION ALL SELECT o.pos, o.lemma, x.base FROM sides_of o JOIN exception x ON x.surface = o.lemma AND x.pos = o.pos) k WHERE EXISTS (SELECT 1 FROM sense s WHERE s.lemma = k.form AND s.pos = k.pos)),
  decided AS (SELECT *, (pos, replace(surface, '_', ' ')) IN (SELECT (pos, lemma) FROM known_side) AS a, (pos, replace(base, '_', ' ')) IN (SELECT (pos, lemma) FROM known_side) AS b FROM apart),
  spelled_out AS (SELECT DISTINCT CASE WHEN b THEN surface ELSE base END AS surface, pos, CASE WHEN b THEN base ELSE surface END AS base FROM decided WHERE a <> b)""".replace("\\\\", "\\")
)


_REASON = """'{"heuristic":"' || how || '","rule":"' || rule || '","score":"' || score::DECIMAL(9, 6) || '"}'"""


def _from(text: str) -> str:
    return f"WITH {_APPLIED} {text}"


def _terms(where: str) -> str:
    return f"WITH {_FOUND} SELECT entry_id, rule, kind, ord::INTEGER AS ord, word AS lemma FROM named WHERE {where} AND word IN (SELECT lemma FROM sense WHERE pos = 'noun')"


SQL = {
    "route_by_operation": _from("SELECT entry_id, route FROM route"),
    "merge_dedup": _from("SELECT target, lemma, entry_id FROM to_merge"),
    "sense_cap": _from("SELECT entry_id, lemma FROM capped"),
    "pointer_cap": _from("SELECT entry_id, symbol, target FROM granted"),
    "exception_pairs": _from("SELECT surface, pos, base FROM spelled_out"),
    "exceptions_out": _from("SELECT pos, surface || ' ' || base AS line FROM exception UNION SELECT pos, surface || ' ' || base FROM spelled_out"),
    "lemma_slot": _from("""SELECT entry_id, replace(r.lemma, ' ', '_') || CASE WHEN regexp_matches(r.lemma, '[0-9]$') THEN '"' ELSE '' END || f.slot AS file_id FROM (SELECT *, lower(lemma) AS low, row_number() OVER (PARTITION BY lower(lemma), pos ORDER BY entry_id) AS rn FROM route WHERE route = 'new synset') r JOIN free f USING (low, pos, rn)"""),
    "relation_edges": _from("SELECT entry_id, symbol, target FROM linked"),
    "attach_new_synset": _from("SELECT entry_id, target, file_id, coalesce(links, '') AS links FROM slotted LEFT JOIN link_list USING (entry_id)"),
    "attach_modifier": _from("SELECT entry_id, lemma, pos, symbol, target FROM modified"),
    "merge_lemmas": _from("SELECT synset_id, lemma FROM merged"),
    "new_synset_lines": _from(f"SELECT entry_id, '{{ ' || file_id || ' ' || target || ',@' || CASE WHEN coalesce(links, '') = '' THEN '' ELSE ' ' || links END || CASE pos WHEN 'verb' THEN ' frames: 1, 2' ELSE '' END || ' (' || {balanced('gloss')} || ') }}' AS line FROM slotted LEFT JOIN link_list USING (entry_id)"),
    "new_modifier_lines": _from(f"SELECT entry_id, '{{ ' || replace(lemma, ' ', '_') || ' ' || coalesce(links, '') || ' (' || {balanced('gloss')} || ') }}' AS line FROM (SELECT DISTINCT entry_id, lemma, gloss FROM modified) LEFT JOIN link_list USING (entry_id)"),
    "enriched_lexicon": _from("""SELECT lemma, pos, synset_id::VARCHAR AS synset, 0 AS round FROM sense
        UNION ALL SELECT m.lemma, s.pos, m.synset_id::VARCHAR, 1 FROM merged m JOIN synset s USING (synset_id)
        UNION ALL SELECT lemma, pos, md5(pos || '|' || lemma || '|' || entry_id), 1 FROM (SELECT entry_id, lemma, pos FROM slotted UNION ALL SELECT entry_id, lemma, pos FROM route WHERE route = 'modifier')"""),
    "operations_log": _from("""SELECT f.entry_id, concat_ws(chr(9), e.lemma, e.pos, f.entry_id::VARCHAR, e.gloss, f.op, f.target::VARCHAR, replace(l.lemmas, ' ', ' '), s.gloss, '{"rule":' || f.rule || ',"heuristic":"' || f.how || '"}') AS line
        FROM first_match f JOIN e USING (entry_id) JOIN synset s ON s.synset_id = f.target JOIN (SELECT synset_id, string_agg(lemma, ',' ORDER BY lemma) AS lemmas FROM (SELECT DISTINCT synset_id, lemma FROM sense) GROUP BY synset_id) l ON l.synset_id = f.target
        UNION ALL SELECT f.entry_id, concat_ws(chr(9), e.lemma, e.pos, f.entry_id::VARCHAR, e.gloss, f.op, f.how) FROM first_match f JOIN e USING (entry_id) WHERE f.target IS NULL"""),
    "proposal_record": _from(f"""SELECT entry_id, op, target, {_REASON} AS reason FROM proposals WHERE op NOT IN ('member meronym', 'part meronym', 'domain topic') QUALIFY row_number() OVER (PARTITION BY entry_id, op ORDER BY rule DESC, target DESC NULLS LAST) = 1
        UNION ALL SELECT entry_id, op, target, {_REASON} FROM proposals WHERE op IN ('member meronym', 'part meronym', 'domain topic')"""),
    "remaining_entries": _from("SELECT entry_id, lemma FROM raw WHERE entry_id NOT IN (SELECT entry_id FROM first_match)"),
    "augment_after_match": _from("SELECT entry_id, domain, target FROM domain_links WHERE entry_id IN (SELECT entry_id FROM first_match)"),
    "operation_counts": _from("SELECT rule, op, count(*) AS n FROM first_match GROUP BY rule, op ORDER BY n DESC, rule, op"),
    "round_stats": _from("""SELECT (SELECT count(*) FROM raw) AS processed, (SELECT count(DISTINCT entry_id) FROM first_match) AS tentative,
        (SELECT count(DISTINCT entry_id) FROM (SELECT entry_id FROM slotted UNION ALL SELECT entry_id FROM modified UNION ALL SELECT entry_id FROM to_merge)) AS final"""),
    "vote_ties": f"WITH {_FOUND}, {_voted('tied', 2, True, 'TRUE')} SELECT entry_id, synset_id, n, ties, how FROM tied",
    "candidate_multimap": f"WITH {_FOUND} SELECT entry_id, word AS lemma, string_agg(DISTINCT rule || ':' || kind, ',' ORDER BY rule || ':' || kind) AS by FROM named GROUP BY entry_id, word",
    "noun_ngram_candidates": _terms("rule IN (10, 13)"),
    "adj_noun_candidates": _terms("rule = 15"),
    "near_duplicate_guard": f"WITH {_FOUND} SELECT entry_id, synset_id FROM found EXCEPT SELECT entry_id, synset_id FROM dup",
    "person_closure": f"WITH {_FOUND} SELECT lemma FROM person_lemmas UNION SELECT unnest([{quoted(ALWAYS_PERSON)}])",
    "bounded_closure": f"WITH {_FOUND} SELECT s.lemma, s.synset_id, r.depth FROM rooted r JOIN sense s ON s.synset_id = r.id WHERE s.sense_rank = 1 AND s.pos = 'noun'",
    "read_lexicon_lines": _from(f"SELECT file_id, regexp_replace(file_id, '\"?[0-9]+$', '') AS lemma, (1 + coalesce(len(string_split(links, ' ')), 0))::INTEGER AS links, {balanced('gloss')} AS gloss FROM slotted LEFT JOIN link_list USING (entry_id)"),
    "organism_member": _from("SELECT genus, member, hypernym FROM members"),
}
