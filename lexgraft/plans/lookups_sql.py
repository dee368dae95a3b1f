"""The queries of lookups in SQL for DuckDB."""

from __future__ import annotations

from lexgraft.plans.rules_sql import SUMS, forms
from lexgraft.plans.rules_sql import stems as _stems

_KEYS = "keys AS (SELECT key AS key_id, CASE key % 4 WHEN 0 THEN noun || 's' WHEN 1 THEN replace(lemma, ' ', '-') WHEN 2 THEN noun || 'en' ELSE lemma || 's' END AS lemma, 'noun' AS pos FROM parts)"
_FORMS = f"{_KEYS}, " + forms("SELECT min(key_id) AS key_id, lemma, pos FROM keys GROUP BY lemma, pos")
_HOPS = """up AS (SELECT src, dst FROM edge WHERE pointer IN ('@', '@i', '&', '^')), both_ways AS (SELECT src, dst FROM up UNION SELECT dst, src FROM up)"""
_VOTES = """senses AS (SELECT r.entry_id, s.synset_id FROM relation r JOIN sense s ON r.target = s.lemma AND s.pos = 'noun' WHERE r.type = 'SYNONYM'),
  votes AS (SELECT entry_id, synset_id, count(*) AS n FROM (SELECT * FROM senses UNION ALL SELECT entry_id, e.dst FROM senses JOIN edge e ON synset_id = e.src AND e.pointer = '@') GROUP BY entry_id, synset_id)"""
_LIST = r"list_distinct(list_filter(list_transform(string_split_regex(trim(lower({g})), '\s+'), lambda t: regexp_extract(t, '^[[:punct:]]*([^[:punct:]\s]+)[[:punct:]]*$', 1)), lambda t: t <> ''))"
_WEIGHTS = f"""ew AS (SELECT unnest({_LIST.format(g='gloss')}) AS lemma FROM entry), sw AS (SELECT unnest({_LIST.format(g='gloss')}) AS lemma FROM synset),
  weights AS MATERIALIZED (SELECT lemma, -ln(count(*) / (SELECT count(*) FROM entry) / (SELECT count(*) FROM entry)) AS weight FROM (SELECT * FROM ew UNION ALL SELECT * FROM sw) GROUP BY lemma)"""
_VECTORS = f"""unit AS MATERIALIZED (SELECT word, list_transform(vec, lambda x: x::DOUBLE / sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[]))) AS vec FROM word_vector WHERE list_dot_product(vec::DOUBLE[], vec::DOUBLE[]) > 0),
  glosses AS (SELECT gloss FROM entry UNION SELECT gloss FROM synset),
  gw AS MATERIALIZED (SELECT gloss, unnest({_LIST.format(g='gloss')}) AS word FROM glosses),
  gv AS MATERIALIZED (SELECT gw.gloss, [{SUMS}] AS vec FROM gw JOIN unit u USING (word) GROUP BY gw.gloss)"""
_SCORED = f"""{_VECTORS},
  scored AS MATERIALIZED (SELECT e.entry_id, s.synset_id, s.sense_rank, round(coalesce(list_cosine_similarity(a.vec, b.vec), 0), 6) AS score
    FROM entry e JOIN gv a ON a.gloss = e.gloss JOIN sense s USING (lemma, pos) JOIN synset y ON y.synset_id = s.synset_id JOIN gv b ON b.gloss = y.gloss)"""
_COMPONENTS = ", ".join(f"round(vec[{i}], 6) AS c{i}" for i in range(1, 65))
SQL = {
    "sense_lookup": "SELECT entry_id, synset_id, sense_rank FROM entry JOIN sense USING (lemma, pos)",
    "fuzzy_sense_lookup": f"WITH {_FORMS} SELECT key_id, synset_id, branch::INTEGER AS branch FROM fuzzy",
    "fuzzy_lookup_many": "WITH " + forms("SELECT DISTINCT entry_id AS key_id, target AS lemma, 'noun' AS pos FROM relation WHERE type = 'SYNONYM'") + " SELECT DISTINCT key_id AS entry_id, synset_id FROM fuzzy",
    "first_sense": f"WITH {_FORMS} SELECT key_id, synset_id FROM fuzzy QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY branch, sense_rank, synset_id) = 1",
    "in_lexicon_semi": f"""WITH {_KEYS}, known AS (SELECT key_id FROM keys k JOIN exception x ON k.lemma = x.surface JOIN sense s ON s.lemma = x.base AND s.pos = 'noun'
        UNION SELECT key_id FROM (SELECT key_id, unnest(list_append({_stems('lemma')}, lemma)) AS form FROM keys) JOIN sense s ON s.lemma = form AND s.pos = 'noun') SELECT key_id FROM known""",
    "not_in_lexicon_anti": f"""WITH {_KEYS}, known AS (SELECT key_id FROM keys k JOIN exception x ON k.lemma = x.surface JOIN sense s ON s.lemma = x.base AND s.pos = 'noun'
        UNION SELECT key_id FROM (SELECT key_id, unnest(list_append({_stems('lemma')}, lemma)) AS form FROM keys) JOIN sense s ON s.lemma = form AND s.pos = 'noun') SELECT key_id, lemma FROM keys WHERE key_id NOT IN (SELECT key_id FROM known)""",
    "one_hop": f"WITH {_HOPS} SELECT DISTINCT src AS synset_id, dst AS near FROM both_ways",
    "pointer_follow": "SELECT src, pointer, arg_min(dst, ord * 10000000000000 + dst) AS dst FROM edge GROUP BY src, pointer",
    "gloss_equi_join": "SELECT first, lemma, synset_id FROM (SELECT s.synset_id, lemma, min(s.synset_id) OVER w AS first, count(*) OVER w AS n FROM synset y JOIN (SELECT DISTINCT synset_id, lemma FROM sense) s USING (synset_id) WINDOW w AS (PARTITION BY y.gloss, lemma)) WHERE n > 1",
    "is_descendant": "WITH up AS (SELECT src AS root, src AS node FROM tree UNION SELECT up.root, t.dst FROM up JOIN tree t ON t.src = up.node) SELECT root, node FROM up",
    "synset_votes": f"WITH {_VOTES} SELECT entry_id, synset_id, n FROM votes",
    "lemma_weights": f"WITH {_WEIGHTS} SELECT lemma, round(weight, 6) AS weight FROM weights",
    "load_vectors": f"WITH {_VECTORS}, ew AS (SELECT DISTINCT unnest({_LIST.format(g='gloss')}) AS word FROM entry) SELECT word, {_COMPONENTS} FROM unit JOIN ew USING (word)",
    "gloss_vector": f"WITH {_VECTORS} SELECT md5(gloss) AS gloss, {_COMPONENTS} FROM gv WHERE gloss IN (SELECT gloss FROM entry)",
    "gloss_cosine": f"WITH {_SCORED} SELECT entry_id, synset_id, score FROM scored",
    "best_sense": f"WITH {_SCORED} SELECT entry_id, synset_id, score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, sense_rank, synset_id) = 1",
    "too_similar_filter": f"WITH {_VECTORS}, "
    + forms("SELECT entry_id AS key_id, lemma, pos FROM entry")
    + """, close AS (SELECT f.key_id FROM fuzzy f JOIN entry e ON e.entry_id = f.key_id JOIN gv a ON a.gloss = e.gloss JOIN synset y ON y.synset_id = f.synset_id JOIN gv b ON b.gloss = y.gloss WHERE round(coalesce(list_cosine_similarity(a.vec, b.vec), 0), 6) > 0.3)
        SELECT entry_id, lemma FROM entry WHERE entry_id NOT IN (SELECT key_id FROM close)""",
    "weighted_overlap": f"""WITH {_WEIGHTS}, pairs AS (SELECT e.entry_id AS pair_id, e.gloss AS a, y.gloss AS b FROM entry e JOIN sense s USING (lemma, pos) JOIN synset y ON y.synset_id = s.synset_id WHERE s.sense_rank = 1),
        shared AS (SELECT pair_id, unnest(list_intersect({_LIST.format(g='a')}, {_LIST.format(g='b')})) AS lemma FROM pairs),
        scores AS (SELECT pair_id, sum(weight) AS score FROM shared JOIN weights USING (lemma) GROUP BY pair_id)
        SELECT pair_id, round(coalesce(score, 0), 5) AS score FROM pairs LEFT JOIN scores USING (pair_id)""",
}
