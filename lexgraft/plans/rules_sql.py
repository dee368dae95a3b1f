"""The rules in SQL for DuckDB: one chain of CTEs, written from what each rule says."""

from __future__ import annotations

from lexgraft.functions import text as T
from lexgraft.plans.rules import ALWAYS_PERSON, ANTONYMS, NO_DOMAIN, PATTERN, RULES, TEMPLATES
from lexgraft.sources import tables as S


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def ex(text: str, name: str, group: int = 1) -> str:
    return f"regexp_extract({text}, '{PATTERN[name]}', {group})"


def stems(w: str, pos: str = "pos") -> str:
    cut = lambda end, base: f"CASE WHEN {w} LIKE '%{end}' THEN left({w}, length({w}) - {len(end)}) || '{base}' END"
    cases = " ".join(f"WHEN '{p}' THEN [{', '.join(cut(*r) for r in rules)}]" for p, rules in T.ENDINGS.items())
    return f"list_distinct(list_filter(CASE {pos} {cases} ELSE [] END, lambda f: f IS NOT NULL AND length(f) > 0))"


def forms(keys: str, n: str = "") -> str:
    """CTEs, their names begun by n, that end in fuzzy(key_id, synset_id, branch, sense_rank), for SELECT key_id, lemma, pos (words of three parts at most)."""
    part = lambda c: f"CASE WHEN len({stems(c)}) > 0 THEN {stems(c)} ELSE [{c}] END"
    return f"""{n}dkeys AS ({keys}),
  {n}spelled AS (SELECT key_id, pos, unnest(CASE WHEN contains(lemma, '_') THEN [lemma, replace(lemma, '_', ' '), replace(lemma, '_', '-')] WHEN contains(lemma, '-') THEN [lemma, replace(lemma, '-', ' ')] WHEN contains(lemma, ' ') THEN [lemma, replace(lemma, ' ', '-')] ELSE [lemma] END) AS lemma FROM {n}dkeys),
  {n}stemmed AS (SELECT *, {stems('lemma')} AS stems FROM {n}spelled),
  {n}halves AS (SELECT key_id, pos, split_part(lemma, ' ', 1) AS a, split_part(lemma, ' ', 2) AS b, split_part(lemma, ' ', 3) AS c FROM {n}stemmed WHERE len(stems) = 0 AND contains(lemma, ' ')),
  {n}compound1 AS (SELECT key_id, pos, unnest({part('a')}) AS x, b, c FROM {n}halves),
  {n}compound2 AS (SELECT key_id, pos, x, unnest({part('b')}) AS y, c FROM {n}compound1),
  {n}compound AS (SELECT key_id, pos, trim(x || ' ' || y || ' ' || z) AS lemma FROM (SELECT key_id, pos, x, y, unnest(CASE WHEN c = '' THEN [''] ELSE {part('c')} END) AS z FROM {n}compound2)),
  {n}forms AS (SELECT key_id, pos, lemma, 0 AS branch FROM {n}spelled UNION ALL SELECT key_id, pos, unnest(stems), 1 FROM {n}stemmed UNION ALL SELECT key_id, pos, lemma, 2 FROM {n}compound
    UNION ALL SELECT s.key_id, s.pos, x.base, 3 FROM {n}spelled s JOIN exception x ON s.lemma = x.surface AND s.pos = x.pos),
  {n}fuzzy AS (SELECT key_id, synset_id, m // 100000000 AS branch, m % 100000000 AS sense_rank FROM (SELECT f.key_id, s.synset_id, min(f.branch * 100000000 + s.sense_rank) AS m FROM {n}forms f JOIN sense s USING (lemma, pos) GROUP BY f.key_id, s.synset_id))"""


def ngrams(w: str) -> str:
    return f"list_filter([CASE WHEN len({w}) >= 3 THEN array_to_string(list_slice({w}, 1, 3), ' ') END, CASE WHEN len({w}) >= 2 THEN array_to_string(list_slice({w}, 1, 2), ' ') END, {w}[3], {w}[2], {w}[1]], lambda g: g IS NOT NULL)"


def pieces(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


def following(text: str) -> str:
    return pieces(f"regexp_extract({text}, '^([^,.;:]*)', 1)")


#: The sums of the vectors' components.
SUMS = ", ".join(f"sum(u.vec[{i}])" for i in range(1, 65))
_BODIES = r"""bodies AS (SELECT entry_id, pos, unnest(b) AS body, generate_subscripts(b, 1) AS n FROM (SELECT entry_id, pos, regexp_extract_all(regexp_extract(raw, '^\s*((?:\{\{[^{}]*\}\}\s*)*)', 1), '\{\{([^{}]*)\}\}', 1) AS b FROM raw)),
  valued AS (SELECT entry_id, pos, n, args[1] AS type, list_filter(list_slice(args, CASE args[1] WHEN 'surname' THEN 1 WHEN 'form of' THEN 3 ELSE 2 END, len(args)), lambda a: NOT contains(a, '=') AND NOT contains(a, '{'))[1] AS value FROM (SELECT *, string_split(body, '|') AS args FROM bodies))"""
_DOMAINS = f"""dlabels AS (SELECT entry_id, list_slice(string_split(body, '|'), 2, len(string_split(body, '|'))) AS l FROM bodies WHERE body LIKE 'context|%'),
  domains AS (SELECT DISTINCT entry_id, regexp_replace(word, '[\\[\\]]', '', 'g') AS word FROM (SELECT entry_id, unnest(l) AS word FROM dlabels WHERE NOT list_has_any(l, [{quoted(NO_DOMAIN)}])) WHERE NOT contains(word, '='))"""
_KIND = " ".join(f"WHEN '{t}' THEN '{op}'" for t, op in TEMPLATES.items())
_SINGLE = f"CASE pos WHEN 'noun' THEN {ex('p', 'one_noun')} WHEN 'verb' THEN {ex('p', 'one_verb')} ELSE {ex('p', 'one_word')} END"
_PARTS = "list_transform(string_split_regex(gloss, '[;,]'), lambda p: trim(p))"
_OPPOSITE = "CASE pos " + " ".join(f"{when} flatten([" + ", ".join(f"list_transform({_PARTS}, lambda p: regexp_extract(p, '{t}', 1))" for t in ANTONYMS[p]) + "])" for when, p in (("WHEN 'noun' THEN", "noun"), ("WHEN 'verb' THEN", "verb"), ("ELSE", "modifier"))) + " END"
_REST = "regexp_extract(lemma, '^(?:over|super|under)(.*)$', 1)"
_PREFIX = f"CASE WHEN pos <> 'verb' OR {_REST} = '' THEN '' WHEN lemma LIKE 'under%' THEN 'super' || {_REST} ELSE 'under' || {_REST} END"
_TAX = "CASE WHEN lead[1] LIKE 'taxlink|%' THEN string_split(lead[1], '|')[2] ELSE " + ex("gloss", "member") + " END"


def _link(name: str) -> str:
    more = f"{pieces('trim(' + ex('plain', name, 2) + ')')}" if name != "first_link" else "[]::VARCHAR[]"
    return f"list_concat({pieces(ex('plain', name))}, {more})"


_NAMED = (
    _BODIES
    + ", "
    + _DOMAINS
    + f""",
  e AS MATERIALIZED (SELECT *, lower(gloss) AS low FROM (SELECT entry_id, lemma, pos, raw, {S._CLEAN.format(g='raw')} AS gloss, trim(regexp_replace(raw, '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g')) AS plain,
    regexp_extract_all(regexp_extract(raw, '^\\s*((?:\\{{\\{{[^{{}}]*\\}}\\}}\\s*)*)', 1), '\\{{\\{{([^{{}}]*)\\}}\\}}', 1) AS lead FROM raw)),
  fresh AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM sense s WHERE s.lemma = e.lemma AND s.pos = e.pos)),
  templates AS (SELECT entry_id, pos, kind, min(n) - 1 AS ord, arg_max(value, n) AS word FROM (SELECT *, CASE type {_KIND} END AS kind FROM valued) WHERE kind IS NOT NULL AND value <> '' GROUP BY entry_id, pos, kind, type),
  lists AS (
    SELECT r.entry_id, 2 AS rule, 'synonym' AS kind, list_sort(list(DISTINCT target)) AS words, any_value(e.pos) AS wpos FROM relation r JOIN e USING (entry_id) WHERE type = 'SYNONYM' GROUP BY r.entry_id
    UNION ALL SELECT entry_id, 3, 'antonym', list_filter(list_concat([{_PREFIX}], {_OPPOSITE}), lambda w: w <> ''), pos FROM e
    UNION ALL SELECT entry_id, 4, 'synonym', list_filter(list_transform(list_filter(list_transform(string_split(gloss, ';'), lambda x: regexp_replace(trim(x), '[.,;:!?]+$', '')), lambda x: x <> ''), lambda p: {_SINGLE}), lambda w: w <> ''), pos FROM e
    UNION ALL SELECT entry_id, 5, CASE WHEN regexp_matches(gloss, '{PATTERN['manner']}.{{0,2}}$') THEN 'exact' ELSE 'longer' END, [{ex('gloss', 'manner')}], 'adjective' FROM fresh WHERE pos = 'adverb'
    UNION ALL SELECT entry_id, 6, 'genus', [lower({_TAX})], 'noun' FROM e WHERE pos = 'noun'
    UNION ALL SELECT entry_id, 7, 'group', [{ex('gloss', 'group')}], 'noun' FROM e WHERE pos = 'noun'
    UNION ALL SELECT entry_id, 7, 'member', {ngrams('w')}, 'noun' FROM (SELECT entry_id, {following(ex('gloss', 'group', 2))} AS w FROM e WHERE pos = 'noun')
    UNION ALL SELECT entry_id, 8, 'generic', ['person'], 'noun' FROM e WHERE pos = 'noun' AND (regexp_matches(gloss, '{PATTERN['someone']}') OR {ex('gloss', 'typed')} = 'person')
    UNION ALL SELECT entry_id, 8, 'typed', [{ex('gloss', 'typed')}], 'noun' FROM e WHERE pos = 'noun'
    UNION ALL """
    + " UNION ALL ".join(f"SELECT entry_id, 10, '{i}', {ngrams('w')}, 'noun' FROM (SELECT entry_id, {_link(n)} AS w FROM fresh WHERE pos = 'noun' AND regexp_matches(plain, '{PATTERN[n]}'))" for i, n in enumerate(("article_link", "first_link", "after_link")))
    + f"""
    UNION ALL SELECT entry_id, 11, 'link', [{ex('plain', 'verb_link')}], 'verb' FROM fresh WHERE pos = 'verb'
    UNION ALL SELECT entry_id, 12, 'head', [{ex('gloss', 'verb_head')}], 'verb' FROM fresh WHERE pos = 'verb'
    UNION ALL """
    + " UNION ALL ".join(f"SELECT entry_id, 13, '{i}', {ngrams('w')}, 'noun' FROM (SELECT entry_id, {pieces(ex('gloss', n))} AS w FROM fresh WHERE pos = 'noun')" for i, n in enumerate(("which", "any_of", "comma")))
    + f"""
    UNION ALL SELECT entry_id, 14, 'list', string_split_regex(low, '\\s*,\\s*'), 'adjective' FROM fresh WHERE pos = 'adjective' AND regexp_matches(low, '{PATTERN['list']}')
    UNION ALL SELECT entry_id, 15, 'noun', list_filter([CASE WHEN len(w) >= 3 THEN array_to_string(list_slice(w, 1, 3), ' ') END, CASE WHEN len(w) >= 2 THEN array_to_string(list_slice(w, 1, 2), ' ') END, CASE WHEN len(w) >= 3 THEN array_to_string(list_slice(w, 2, 3), ' ') END, w[1], w[2], w[3]], lambda g: g IS NOT NULL AND g NOT IN ({quoted(T.STOP)})), 'noun'
      FROM (SELECT entry_id, {following(ex('low', 'relate'))} AS w FROM fresh WHERE pos = 'adjective')),
  once AS (SELECT entry_id, rule, kind, list_filter(words, lambda x, i: list_position(words, x) = i) AS words, wpos FROM lists),
  named AS MATERIALIZED (SELECT * FROM (SELECT entry_id, rule, kind, generate_subscripts(words, 1) - 1 AS ord, unnest(words) AS word, wpos FROM once UNION ALL SELECT entry_id, 1, kind, ord, word, pos FROM templates) WHERE word <> '')"""
)
_FOUND = (
    _NAMED
    + ", "
    + forms("SELECT DISTINCT wpos || '|' || word AS key_id, word AS lemma, wpos AS pos FROM (SELECT word, wpos FROM named UNION SELECT word, 'noun' FROM domains)")
    + """,
  ranked AS MATERIALIZED (SELECT substr(key_id, strpos(key_id, '|') + 1) AS word, split_part(key_id, '|', 1) AS wpos, synset_id, row_number() OVER (PARTITION BY key_id ORDER BY branch, sense_rank, synset_id) AS rank, count(*) OVER (PARTITION BY key_id) AS senses FROM fuzzy),
  found AS MATERIALIZED (SELECT n.*, r.synset_id, r.rank, r.senses, CASE WHEN n.rule = 7 AND n.kind = 'member' THEN 'rest' ELSE 'all' END AS part FROM named n JOIN ranked r USING (word, wpos)),
  upward AS (SELECT src AS synset_id, dst AS up FROM edge WHERE pointer = '@'),
  parent AS (SELECT src AS synset_id, min(dst) AS parent FROM edge WHERE pointer IN ('@', '@i') GROUP BY src),
  opposite AS (SELECT synset_id, min(o) AS opposite FROM (SELECT src AS synset_id, dst AS o FROM edge WHERE pointer = '!' UNION ALL SELECT dst, src FROM edge WHERE pointer = '!') GROUP BY synset_id),
  level1 AS (SELECT DISTINCT src AS id FROM edge WHERE pointer IN ('@', '@i') AND dst = (SELECT min(key) FROM parts)),
  level2 AS (SELECT DISTINCT src AS id FROM edge JOIN level1 ON dst = id WHERE pointer IN ('@', '@i')),
  level3 AS (SELECT DISTINCT src AS id FROM edge JOIN level2 ON dst = id WHERE pointer IN ('@', '@i')),
  rooted AS (SELECT id, max(depth) AS depth FROM (SELECT id, 1 AS depth FROM level1 UNION ALL SELECT id, 2 FROM level2 UNION ALL SELECT id, 3 FROM level3) GROUP BY id),
  persons AS (SELECT DISTINCT w.key AS synset_id FROM wsense w JOIN parts p ON p.key = w.key WHERE w.pos = 'noun' AND p.grp = (SELECT arg_min(grp, g) FROM grps) AND w.key <> (SELECT min(g) FROM grps)),
  person_lemmas AS (SELECT DISTINCT lemma FROM sense JOIN persons USING (synset_id) WHERE sense_rank = 1 AND pos = 'noun'),
  back AS (SELECT dst AS noun, src AS synset_id FROM edge WHERE pointer = '\\'),
  pairs AS MATERIALIZED (SELECT entry_id, part, synset_id FROM found UNION SELECT entry_id, 'all', up FROM found JOIN upward USING (synset_id) WHERE rule = 2
    UNION SELECT entry_id, 'all', p.synset_id FROM named, persons p WHERE rule = 8 AND kind = 'generic' UNION SELECT f.entry_id, 'all', b.synset_id FROM found f JOIN back b ON f.synset_id = b.noun WHERE rule = 15
    UNION SELECT d.entry_id, 'all', r.synset_id FROM domains d JOIN ranked r ON r.word = d.word AND r.wpos = 'noun'),
  lem AS (SELECT synset_id, string_agg(lemma, ' ' ORDER BY lemma) AS lemmas FROM (SELECT DISTINCT synset_id, lemma FROM sense) GROUP BY synset_id),
  sides AS MATERIALIZED (SELECT synset_id, plain, trim(plain || ' ' || lemmas) AS extended FROM (SELECT synset_id, regexp_replace(gloss, ';\\s*"[^"]*"', '', 'g') AS plain FROM synset WHERE synset_id IN (SELECT synset_id FROM pairs)) JOIN lem USING (synset_id)),
  texts AS MATERIALIZED (SELECT entry_id, part, text FROM (SELECT entry_id, 'all' AS part, gloss AS text FROM e UNION ALL SELECT entry_id, 'rest', """.replace("\\\\", "\\")
    + ex("gloss", "group", 2)
    + f""" FROM e) WHERE entry_id IN (SELECT entry_id FROM pairs) AND (part = 'all' OR text <> '')),
  unit AS MATERIALIZED (SELECT word, list_transform(vec, lambda x: x::DOUBLE / sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[]))) AS vec FROM word_vector WHERE list_dot_product(vec::DOUBLE[], vec::DOUBLE[]) > 0),
  gw AS MATERIALIZED (SELECT text, unnest({S._GLOSS_WORDS.format(g='text')}) AS word FROM (SELECT text FROM texts UNION SELECT plain FROM sides UNION SELECT extended FROM sides)),
  gv AS MATERIALIZED (SELECT gw.text, [{SUMS}] AS vec FROM gw JOIN unit u USING (word) GROUP BY gw.text),
  cos AS MATERIALIZED (SELECT p.entry_id, p.part, p.synset_id, round(coalesce(list_cosine_similarity(a.vec, b.vec), 0), 6) AS plain, round(coalesce(list_cosine_similarity(a.vec, c.vec), 0), 6) AS extended
    FROM pairs p JOIN texts t USING (entry_id, part) JOIN sides s USING (synset_id) LEFT JOIN gv a ON a.text = t.text LEFT JOIN gv b ON b.text = s.plain LEFT JOIN gv c ON c.text = s.extended),
  {forms("SELECT entry_id AS key_id, lemma, pos FROM raw", "o_")},
  own AS (SELECT DISTINCT key_id AS entry_id, synset_id AS own FROM o_fuzzy),
  nb AS MATERIALIZED (SELECT src, dst FROM edge WHERE pointer IN ('@', '@i', '&', '^') UNION SELECT dst, src FROM edge WHERE pointer IN ('@', '@i', '&', '^')),
  asked AS (SELECT DISTINCT a.entry_id, a.synset_id, o.own FROM (SELECT entry_id, synset_id FROM found UNION SELECT entry_id, up FROM found JOIN upward USING (synset_id) WHERE rule = 2
    UNION SELECT entry_id, parent FROM found JOIN parent USING (synset_id) WHERE rule = 3 UNION SELECT entry_id, opposite FROM found JOIN opposite USING (synset_id) WHERE rule = 3) a JOIN own o USING (entry_id)),
  dup AS MATERIALIZED (SELECT entry_id, synset_id FROM asked WHERE synset_id = own UNION SELECT entry_id, synset_id FROM asked JOIN nb ON src = synset_id AND dst = own
    UNION SELECT entry_id, synset_id FROM asked JOIN nb a ON a.src = synset_id JOIN nb b ON b.src = a.dst AND b.dst = own),
  rows AS MATERIALIZED (SELECT f.*, c.plain, c.extended, e.pos, e.gloss, EXISTS (SELECT 1 FROM dup d WHERE d.entry_id = f.entry_id AND d.synset_id = f.synset_id) AS stop FROM found f JOIN cos c USING (entry_id, part, synset_id) JOIN e ON e.entry_id = f.entry_id)"""
)


def _top(select: str, source: str, where: str, by: str, score: str, least: float = 0) -> str:
    return f"SELECT {select} FROM {source} WHERE {where} AND {score} > {least} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, rank, synset_id) = 1"


def _voted(name: str, rule: int, hypernyms: bool, where: str) -> str:
    more = "UNION ALL SELECT v.entry_id, v.word, u.up, v.rank, c.plain, FALSE FROM {n}_own v JOIN upward u USING (synset_id) JOIN cos c ON c.entry_id = v.entry_id AND c.part = 'all' AND c.synset_id = u.up" if hypernyms else ""
    return f"""{name}_own AS (SELECT entry_id, word, synset_id, rank, plain, TRUE AS sense FROM rows WHERE rule = {rule} AND {where}),
  {name}_votes AS (SELECT entry_id, synset_id, count(*) AS n, min(rank) AS rank, max(plain) AS plain, bool_or(sense) AS sense FROM (SELECT * FROM {name}_own {more.format(n=name)}) GROUP BY entry_id, synset_id),
  {name}_words AS (SELECT entry_id, count(DISTINCT word) AS words FROM {name}_own GROUP BY entry_id),
  {name}_kept AS (SELECT v.*, w.words FROM {name}_votes v JOIN {name}_words w USING (entry_id) WHERE w.words > 1 OR v.sense),
  {name}_most AS (SELECT *, count(*) OVER (PARTITION BY entry_id) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY entry_id) AS most FROM {name}_kept) WHERE words = 1 OR n = most),
  {name} AS (SELECT entry_id, synset_id, n, ties, 'votes' AS how, plain FROM {name}_most WHERE ties = 1 UNION ALL {_top("entry_id, synset_id, n, ties, 'similarity', plain", f"{name}_most", "ties > 1", "entry_id", "plain")})"""


def _winners(rule: int, score: str, least: float = 0) -> str:
    return f"""SELECT entry_id, 'hypernym' AS op, synset_id AS target, word AS how, {score} AS score FROM (SELECT * FROM ({_top('*', 'rows', f'rule = {rule}', 'entry_id, kind, ord', score, least)}) WHERE NOT stop) QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY kind, ord) = 1"""


_RULE = {
    1: f"""SELECT entry_id, op, target, how, score FROM (
      SELECT entry_id, ord, CASE WHEN kind = 'merge' THEN 'merge' WHEN pos = 'adjective' THEN 'similar to' ELSE 'hypernym' END AS op, CASE WHEN kind = 'sibling' AND pos <> 'adjective' THEN parent ELSE synset_id END AS target, how, extended AS score
      FROM (SELECT *, 'first sense' AS how FROM guarded1 WHERE NOT contains(gloss, ' ') AND rank = 1 UNION ALL {_top("*, 'similarity'", 'guarded1', "contains(gloss, ' ')", 'entry_id, ord', 'extended')}) LEFT JOIN parent USING (synset_id)
      WHERE CASE WHEN kind = 'sibling' AND pos <> 'adjective' THEN parent ELSE synset_id END IS NOT NULL
      UNION ALL SELECT entry_id, ord, 'lexicalise', NULL, word, 0.0 FROM named WHERE rule = 1 AND kind = 'lexicalise') QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY ord) = 1""",
    2: "SELECT entry_id, 'merge' AS op, synset_id AS target, how, plain AS score FROM voted2",
    3: """SELECT entry_id, 'merge' AS op, opposite AS target, 'antonym''s antonym' AS how, extended AS score FROM contrary WHERE opposite IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dup d WHERE d.entry_id = contrary.entry_id AND d.synset_id = opposite)
      UNION ALL SELECT entry_id, 'antonym', synset_id, 'antonym', extended FROM contrary WHERE opposite IS NULL AND pos IN ('adjective', 'adverb')
      UNION ALL SELECT entry_id, o.op, CASE o.op WHEN 'antonym' THEN synset_id ELSE parent END, 'antonym', extended FROM contrary, (VALUES ('antonym'), ('hypernym')) o(op) WHERE opposite IS NULL AND pos NOT IN ('adjective', 'adverb') AND parent IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM dup d WHERE d.entry_id = contrary.entry_id AND d.synset_id = parent)""",
    4: f"""SELECT entry_id, 'merge' AS op, synset_id AS target, how, extended AS score FROM (SELECT *, 'first sense' AS how FROM guarded4 WHERE words = 1 AND rank = 1 UNION ALL {_top("*, 'similarity'", 'guarded4', 'words > 1', 'entry_id', 'extended')})""",
    5: f"""SELECT entry_id, 'derived' AS op, synset_id AS target, how, extended AS score FROM (SELECT *, 'first sense' AS how FROM rows WHERE rule = 5 AND (senses = 1 OR kind = 'exact') AND rank = 1 UNION ALL {_top("*, 'similarity'", 'rows', "rule = 5 AND senses > 1 AND kind = 'longer'", 'entry_id', 'extended')})""",
    6: """SELECT r.entry_id, o.op, CASE o.op WHEN 'hypernym' THEN m.hypernym ELSE m.genus END AS target, 'genus' AS how, 0.0 AS score FROM rows r JOIN members m ON m.genus = r.synset_id, (VALUES ('hypernym'), ('member meronym')) o(op) WHERE r.rule = 6 AND r.rank = 1""",
    7: f"""SELECT entry_id, 'hypernym' AS op, synset_id AS target, 'group' AS how, plain AS score FROM grouped UNION ALL SELECT entry_id, 'member meronym', synset_id, 'member', plain FROM (SELECT entry_id, synset_id, plain FROM best7 UNION ALL
      SELECT entry_id, synset_id, plain FROM (SELECT * FROM rows WHERE rule = 7 AND kind = 'member' AND entry_id IN (SELECT entry_id FROM grouped) AND entry_id NOT IN (SELECT entry_id FROM best7) QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY ord, rank, synset_id) = 1))""",
    8: f"""SELECT entry_id, 'hypernym' AS op, target, how, score FROM (SELECT entry_id, synset_id AS target, 'typed' AS how, plain AS score FROM rows WHERE rule = 8 AND kind = 'typed' AND rank = 1 AND word <> 'person' AND (word IN (SELECT lemma FROM person_lemmas) OR word IN ({quoted(ALWAYS_PERSON)}))
      UNION ALL SELECT entry_id, synset_id, 'closure', plain FROM (SELECT n.entry_id, c.synset_id, c.plain FROM named n JOIN cos c ON c.entry_id = n.entry_id AND c.part = 'all' JOIN persons p ON p.synset_id = c.synset_id WHERE n.rule = 8 AND n.kind = 'generic' AND c.plain > 0
          AND n.entry_id NOT IN (SELECT entry_id FROM rows WHERE rule = 8 AND kind = 'typed' AND rank = 1 AND word <> 'person' AND (word IN (SELECT lemma FROM person_lemmas) OR word IN ({quoted(ALWAYS_PERSON)})))
        QUALIFY row_number() OVER (PARTITION BY n.entry_id ORDER BY c.plain DESC, c.synset_id) = 1)) WHERE entry_id NOT IN (SELECT entry_id FROM own JOIN persons ON own = synset_id)""",
    10: _winners(10, "plain"),
    11: _winners(11, "plain", -1),
    12: _winners(12, "extended"),
    13: _winners(13, "plain"),
    14: "SELECT entry_id, 'merge' AS op, synset_id AS target, how, plain AS score FROM voted14",
    15: """SELECT entry_id, 'pertainym' AS op, noun AS target, 'noun' AS how, score FROM noun15 WHERE noun NOT IN (SELECT noun FROM back)
      UNION ALL SELECT entry_id, 'merge', synset_id, 'adjective', plain FROM (SELECT n.entry_id, b.synset_id, c.plain FROM noun15 n JOIN back b USING (noun) JOIN cos c ON c.entry_id = n.entry_id AND c.part = 'all' AND c.synset_id = b.synset_id WHERE c.plain > n.score
        QUALIFY row_number() OVER (PARTITION BY n.entry_id ORDER BY c.plain DESC, b.synset_id) = 1)""",
}
_DECIDED = (
    _FOUND
    + f""",
  guarded1 AS (SELECT * FROM rows r WHERE rule = 1 AND kind <> 'lexicalise' AND (pos <> 'adverb' OR kind = 'merge') AND NOT EXISTS (SELECT 1 FROM rows s WHERE s.rule = 1 AND s.kind <> 'lexicalise' AND s.stop AND s.entry_id = r.entry_id AND s.ord = r.ord)),
  third AS (SELECT * FROM rows WHERE rule = 3 QUALIFY ord = min(ord) OVER (PARTITION BY entry_id)),
  {_voted('voted2', 2, True, "entry_id NOT IN (SELECT f.entry_id FROM found f LEFT JOIN upward u USING (synset_id) JOIN dup d ON d.entry_id = f.entry_id AND d.synset_id IN (f.synset_id, u.up) WHERE f.rule = 2)")},
  contrary AS (SELECT a.*, o.opposite, p.parent FROM (SELECT entry_id, pos, synset_id, extended FROM third WHERE (senses = 1 OR NOT contains(gloss, ',')) AND rank = 1 UNION ALL
    {_top('entry_id, pos, synset_id, extended', 'third', "senses > 1 AND contains(gloss, ',')", 'entry_id', 'extended')}) a LEFT JOIN opposite o USING (synset_id) LEFT JOIN parent p USING (synset_id)),
  guarded4 AS (SELECT r.*, count(DISTINCT word) OVER (PARTITION BY entry_id) AS words FROM rows r WHERE rule = 4 AND entry_id NOT IN (SELECT entry_id FROM rows WHERE rule = 4 AND stop)),
  members AS (SELECT genus, member, hypernym FROM (SELECT m.src AS genus, m.dst AS member, p.parent AS hypernym FROM edge m JOIN rooted r ON r.id = m.dst JOIN parent p ON p.synset_id = m.dst WHERE m.pointer = '%m') QUALIFY row_number() OVER (PARTITION BY genus ORDER BY member) = 1),
  grouped AS (SELECT * FROM rows WHERE rule = 7 AND kind = 'group' AND rank = 1 AND synset_id IN (SELECT id FROM rooted)),
  best7 AS ({_top('*', 'rows', "rule = 7 AND kind = 'member' AND entry_id IN (SELECT entry_id FROM grouped)", 'entry_id', 'plain')}),
  {_voted('voted14', 14, False, "TRUE")},
  noun15 AS ({_top('entry_id, word, synset_id AS noun, plain AS score', 'rows', 'rule = 15', 'entry_id', 'plain')}),
  """
    + ",\n  ".join(f"rule{n} AS ({text})" for n, text in _RULE.items())
    + """,
  proposals AS MATERIALIZED (SELECT DISTINCT * FROM ("""
    + " UNION ALL ".join(f"SELECT entry_id, {n} AS rule, op, target::BIGINT AS target, how, score::DOUBLE AS score FROM rule{n}" for n in _RULE)
    + """)),
  first_match AS (SELECT * FROM proposals p QUALIFY rule = min(rule) OVER (PARTITION BY entry_id))"""
)
SQL = {name: f"WITH {_DECIDED} SELECT entry_id, op, target::BIGINT AS target, how, score::DOUBLE AS score FROM rule{n}" for name, n in RULES.items()} | {
    "first_match": f"WITH {_DECIDED} SELECT entry_id, rule, op, target, how, score FROM first_match",
    "domain_links": f"WITH {_FOUND}, linked AS ({_top('entry_id, d_word AS domain, synset_id AS target', '(SELECT d.entry_id, d.word AS d_word, r.synset_id, r.rank, c.extended FROM domains d JOIN ranked r ON r.word = d.word AND r.wpos = ' + chr(39) + 'noun' + chr(39) + ' JOIN cos c ON c.entry_id = d.entry_id AND c.part = ' + chr(39) + 'all' + chr(39) + ' AND c.synset_id = r.synset_id)', 'TRUE', 'entry_id, d_word', 'extended', -1)}) SELECT DISTINCT entry_id, domain, target FROM linked",
}
