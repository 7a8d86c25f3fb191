"""DuckDB SQL of the numbered queries that SQL can express, by their definitions, without any index."""

from .licences import ANCHORS, NOTICES, exact_phrase

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH RECURSIVE usable AS (
  SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE label IS NOT NULL)
  GROUP BY vec_id HAVING count(x) = count(*) AND bool_and(isfinite(x)) AND bool_or(x <> 0)
), v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings SEMI JOIN usable USING (vec_id)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), classes AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN degree USING (vec_id)
"""

# one level of the tree: children that fill up come first by cap / weight, the others share the rest by weight
_FILL = """
{name}_order AS (
  SELECT c.*, p.given AS budget,
    sum(c.cap) OVER (PARTITION BY {by} ORDER BY c.cap / c.weight, {key} ROWS UNBOUNDED PRECEDING) - c.cap AS caps,
    sum(c.weight) OVER (PARTITION BY {by} ORDER BY c.cap / c.weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM {name}_node c JOIN {above} p ON {on} WHERE c.weight > 0 AND c.cap > 0
), {name}_level AS (
  SELECT *, (budget - caps) / weights AS line, cap <= (budget - caps) / weights * weight AS filled FROM {name}_order
), {name}_first AS (
  SELECT *, first_value(CASE WHEN NOT filled THEN line END) OVER (PARTITION BY {by} ORDER BY filled, caps ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS share FROM {name}_level
), {name}_given AS (
  SELECT *, CASE WHEN filled OR share IS NULL THEN cap ELSE share * weight END AS given FROM {name}_first
)"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n
  FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n) AS tokens FROM d GROUP BY ALL HAVING sum(n) > 0
), source_node AS (
  SELECT *, 2.0::DOUBLE * tokens AS cap, 1.0::DOUBLE AS weight FROM leaf
), lang_node AS (
  SELECT domain, lang, sum(cap) AS cap, CAST(CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 WHEN '(none)' THEN 0.01 ELSE 1 END AS DOUBLE) AS weight
  FROM source_node GROUP BY domain, lang
), domain_node AS (
  SELECT domain, sum(cap) AS cap, CAST(CASE domain WHEN 'web' THEN 0.6 ELSE 0.4 END AS DOUBLE) AS weight FROM lang_node GROUP BY domain
), top AS (
  SELECT floor(sum(tokens) * 0.8::DOUBLE) AS given FROM leaf
), {_FILL.format(name="domain", by="1", key="c.domain", above="top", on="true")}
, {_FILL.format(name="lang", by="c.domain", key="c.lang", above="domain_given", on="c.domain = p.domain").replace("PARTITION BY c.domain ORDER BY filled", "PARTITION BY domain ORDER BY filled")}
, {_FILL.format(name="source", by="c.domain, c.lang", key="c.source", above="lang_given", on="c.domain = p.domain AND c.lang = p.lang").replace("PARTITION BY c.domain, c.lang ORDER BY filled", "PARTITION BY domain, lang ORDER BY filled")}
, plan AS (
  SELECT domain, lang, source, CAST(floor(given + 1e-6) AS BIGINT) // CAST(tokens AS BIGINT) AS whole, CAST(floor(given + 1e-6) AS BIGINT) % CAST(tokens AS BIGINT) AS rest
  FROM source_given WHERE floor(given + 1e-6) > 0
), keyed AS (
  SELECT d.*, whole, rest, md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest) AS key FROM d JOIN plan USING (domain, lang, source)
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM keyed
), cut AS (
  SELECT *, min(CASE WHEN rest > 0 AND upto >= rest THEN key[1:4] END) OVER (PARTITION BY domain, lang, source) AS digits FROM summed
), taken AS (
  SELECT doc_id, domain, lang, source, unnest(range(whole)) AS epoch, n, n AS take FROM cut
  UNION ALL
  SELECT doc_id, domain, lang, source, whole, n, least(n, rest - upto + n) FROM cut WHERE key[1:4] < digits OR key[1:4] = digits AND least(n, rest - upto + n) > 0
)
SELECT doc_id, domain AS mix_domain, lang AS mix_lang, source AS mix_source, CAST(epoch AS INTEGER) AS mix_epoch, CAST(n AS BIGINT) AS mix_tokens, CAST(take AS BIGINT) AS mix_take FROM taken
"""

_SHINGLE = "concat_ws(' ', w1, CASE WHEN run > 1 THEN w2 END, CASE WHEN run > 2 THEN w3 END, CASE WHEN run > 3 THEN w4 END, CASE WHEN run > 4 THEN w5 END)"
_RUNS = ", ".join(f"lead(word, {k}) OVER (PARTITION BY id ORDER BY i) AS w{k + 1}" for k in range(1, 5))

OP5 = rf"""
WITH item_text AS (
  SELECT row_number() OVER () AS id, item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM benchmark WHERE item_id IS NOT NULL
), item_word AS (
  SELECT id, item_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM item_text WHERE len(words) > 0
), item_run AS (
  SELECT id, item_id, n, i, least(n, 5) AS run, word AS w1, {_RUNS} FROM item_word
), item AS (
  SELECT id AS item, item_id, run, n - run + 1 AS size, {_SHINGLE} AS h FROM item_run WHERE i <= n - run + 1
), wanted AS (
  SELECT item, item_id, run, size, h, count(*) AS d FROM item GROUP BY ALL
), doc_text AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS words FROM documents
), doc_word AS (
  SELECT id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM doc_text
), doc_run AS (
  SELECT id, n, i, word AS w1, {_RUNS} FROM doc_word
), doc AS (
  SELECT id, run, i, n - run + 1 AS last, {_SHINGLE} AS h FROM doc_run, (SELECT DISTINCT run FROM item) WHERE i <= n - run + 1
), met AS (
  SELECT id, item, item_id, size, i, last, h, d FROM doc JOIN wanted USING (run, h)
), inside AS (
  SELECT a.id, a.item, a.item_id, a.size, a.i, a.last, b.h, b.d, count(*) AS c
  FROM met a JOIN met b ON a.id = b.id AND a.item = b.item AND b.i BETWEEN a.i AND a.i + a.size - 1 GROUP BY ALL
), shared AS (
  SELECT id, item_id, size, i, least(size, last - i + 1) AS n, sum(least(c, d)) AS common FROM inside GROUP BY id, item, item_id, size, i, last
), hits AS (
  SELECT id, item_id, max(common / (n + size - common)) AS similarity FROM shared WHERE 100 * common >= 80 * (n + size - common) GROUP BY id, item_id
), best AS (
  SELECT id, count(*) AS n_items, max(similarity) AS similarity FROM hits GROUP BY id
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(similarity, 0.0::DOUBLE) AS best_similarity FROM doc_text LEFT JOIN best USING (id)
"""

OP7 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents
), word AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts
), runs AS (
  SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w) AS s FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), sets AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM runs WHERE i <= greatest(n - 2, 1)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), classes AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM classes LEFT JOIN sizes USING (doc_id)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


# crc32 of a value's text by its definition, bit by bit
_BITS = "list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b))"
_CRC = "xor(list_reduce(list_transform(string_split(CAST({of} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: " + _BITS + ", CAST(4294967295 AS BIGINT)), 4294967295)"

# the levels of a tree as lists of digests, and the siblings of node i (from 0) in each
_NEXT = "list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], '')))"
_BESIDE = "list_transform(range(0, len(levels) - 1), lambda k: levels[k + 1][xor(CAST({i} AS BIGINT) >> k, 1) + 1])"

OP11 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
    CASE WHEN doc_crc % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS tampered
  FROM (SELECT documents.*, {_CRC.format(of="doc_id")} AS doc_crc FROM documents)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), step AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, {_NEXT} FROM step WHERE len(nodes) > 1
), trees AS (
  SELECT tree, list(nodes ORDER BY level) AS levels, list(nodes ORDER BY level)[-1][1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM step GROUP BY tree
), top_step AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM trees
  UNION ALL
  SELECT level + 1, {_NEXT} FROM top_step WHERE len(nodes) > 1
), top AS (
  SELECT list(nodes ORDER BY level) AS levels, list(nodes ORDER BY level)[-1][1] AS root FROM top_step
), ways AS (
  SELECT row_number() OVER () AS id, doc_id, leaf, tampered, i, place, subroot, {_BESIDE.format(i="i")} AS own, levels FROM placed JOIN trees USING (tree)
), whole AS (
  SELECT w.*, root, list_transform(own, lambda x, k: struct_pack(digest := x, before := CAST(i AS BIGINT) >> (k - 1) & 1)) || list_transform(above, lambda x, k: struct_pack(digest := x, before := CAST(place AS BIGINT) >> (k - 1) & 1)) AS way
  FROM ways w, LATERAL (SELECT root, {_BESIDE.format(i="w.place").replace("levels", "top.levels")} AS above FROM top)
), fold AS (
  SELECT id, 1 AS k, way, tampered AS digest FROM whole
  UNION ALL
  SELECT id, k + 1, way, sha256(CASE WHEN way[k].before = 1 THEN way[k].digest || digest ELSE digest || coalesce(way[k].digest, '') END) FROM fold WHERE k <= len(way)
), ends AS (
  SELECT id, digest AS folded_root FROM fold WHERE k = len(way) + 1
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(way, lambda s: s.digest), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM whole JOIN ends USING (id)
"""


_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def licences(templates: list) -> str:
    """The labels by the definition: every word's places, every anchor's, every window's."""
    rows = ", ".join(f"({t}, '{x.label}', {x.base}, {x.slack}, {_list(x.words.split(' '))}, {_list(x.phrases)})" for t, x in enumerate(templates))
    return rf"""
WITH template(t, label, base, slack, twords, phrases) AS (VALUES {rows}
), d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_PLAIN}') AS words FROM documents
), word AS (
  SELECT id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d
), tword AS (
  SELECT t, slack, word, min(tpos) AS tpos FROM (SELECT t, slack, unnest(twords) AS word, generate_subscripts(twords, 1) - 1 AS tpos FROM template) GROUP BY ALL
), df AS (
  SELECT word, count(DISTINCT id) AS df FROM word GROUP BY word
), weighed AS (
  SELECT t, slack, word, tpos, CAST(floor(1000 * ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1))) AS BIGINT) + 1 AS weight FROM tword LEFT JOIN df USING (word)
), anchor AS (
  SELECT *, sum(weight) OVER (PARTITION BY t) AS total, sum(weight) OVER (PARTITION BY t ORDER BY rank DESC) AS rest
  FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY weight DESC, tpos) AS rank FROM weighed) WHERE rank <= CASE WHEN slack = 0 THEN 1 ELSE {ANCHORS} END
), proposed AS (
  SELECT DISTINCT id, t, i - tpos AS start FROM word JOIN anchor USING (word) WHERE 2 * rest >= total
), found AS (
  SELECT id, t, start, total, sum(weight) AS found FROM (
    SELECT DISTINCT p.id, p.t, p.start, a.word, a.weight, a.total FROM proposed p JOIN anchor a USING (t)
    JOIN word w ON w.id = p.id AND w.word = a.word AND w.i BETWEEN p.start + a.tpos - a.slack AND p.start + a.tpos + a.slack
  ) GROUP BY ALL
), place AS (
  SELECT id, start, label, base, found / total AS share FROM found JOIN template USING (t) JOIN d USING (id)
  WHERE 2 * found >= total AND len(list_filter(phrases, lambda p: NOT contains(' ' || array_to_string(words[greatest(start - slack, 0) + 1 : start + len(twords) + slack], ' ') || ' ', ' ' || p || ' '))) = 0
), labelled AS (
  SELECT id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM place GROUP BY id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN labelled USING (id)
"""


OP12 = licences([exact_phrase("cc by", "cc-by"), exact_phrase("general public license", "gpl"), exact_phrase("all rights reserved", "reserved"), *NOTICES])

# one assignment of every part to the nearest entry, and the floored means that follow
_ASSIGN = """
a{k} AS (
  SELECT vec_id, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
    SELECT vec_id, part.p, c.e, list_sum(list_transform(list_zip(part.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM part JOIN c{k} c USING (p)
  ) GROUP BY vec_id, p
)"""
_MEANS = """
m{k} AS (
  SELECT p, e, i, CAST(floor(sum(x)) AS HUGEINT) AS total, count(*) AS n FROM (SELECT a.p, a.e, unnest(part.q) AS x, generate_subscripts(part.q, 1) AS i FROM a{k} a JOIN part USING (vec_id, p)) GROUP BY ALL
), n{k} AS (
  SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS q FROM m{k} GROUP BY p, e
), c{next} AS (
  SELECT p, e, coalesce(n.q, c.q) AS q FROM c{k} c LEFT JOIN n{k} n USING (p, e)
)"""

OP13 = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT vec_id, p, q[p * len(q) // 16 + 1 : (p + 1) * len(q) // 16] AS q FROM kept, range(16) r(p)
), c0 AS (
  SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), {_ASSIGN.format(k=0)}, {_MEANS.format(k=0, next=1)}, {_ASSIGN.format(k=1)}, {_MEANS.format(k=1, next=2)}, {_ASSIGN.format(k=2)}
, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 JOIN kept USING (vec_id) GROUP BY vec_id, label
), books AS (
  SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""

ORACLE_SQL = {
    "op1_embedding_near_dedup": OP1, "op4_source_mixing": OP4, "op5_decontamination": OP5, "op7_ngram_jaccard": OP7,
    "op11_merkle_manifest": OP11, "op12_licence_scan": OP12, "op13_vector_codes": OP13,
}
