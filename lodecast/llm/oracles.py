"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]) END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 5 * c >= 4 * (na + nb - c)
), reached AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node
), classes AS (
  SELECT node, min(root) AS class_id FROM reached GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT d.doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links
FROM documents d JOIN classes ON node = d.doc_id LEFT JOIN counts ON a = d.doc_id
"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WINNOWING = rf"""
WITH d AS (
  SELECT doc_id, {_ITEM_WORDS} AS w FROM documents
), i AS (
  SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), grams AS (
  SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM d, sizes WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, k, size, item_id FROM grams JOIN windows USING (size, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

WARC_MEMBERS = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""

#: The cutoffs follow from the definition: exact binomial sums by the gamma function, every cutoff counted anew.
RISK_CONTROLLED_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT row_no, x.k AS k, x.win AS win FROM (
    SELECT row_no, unnest(list_transform(generate_series(1, len(w) - 4), lambda k: {'k': k, 'win': array_to_string(w[k : k + 4], ' ')})) AS x FROM d WHERE len(w) >= 5)
), repeated AS (
  SELECT row_no, count(DISTINCT p) AS n FROM (
    SELECT row_no, unnest(generate_series(k, k + 4)) AS p FROM windows JOIN (SELECT row_no, win FROM windows GROUP BY ALL HAVING count(*) > 1) USING (row_no, win)
  ) GROUP BY row_no
), counted AS (
  SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_capitals,
    length(t) - length(regexp_replace(t, '[!?=~^_@]', '', 'g')) AS n_marks,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (row_no)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_transform(
    [{'rule': 'symbols', 'a': n_symbols, 'b': word_chars}, {'rule': 'capitals', 'a': n_capitals, 'b': word_chars}, {'rule': 'marks', 'a': n_marks, 'b': word_chars},
     {'rule': 'repeats', 'a': n_repeat_words, 'b': n_words}, {'rule': 'lines', 'a': n_dup_lines, 'b': n_lines}],
    lambda s: {'rule': s.rule, 'place': CASE WHEN s.b > 0 THEN ceil(least(s.a / s.b, 1.0::DOUBLE) * 50) - 1 ELSE -1 END}) AS places
  FROM counted
), known AS (
  SELECT stratum, label, unnest(places, recursive := true)
  FROM judged JOIN (SELECT doc_id, min(quality) AS label FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
), tallies AS (
  SELECT stratum, rule, j, count(*) FILTER (label = 1) AS n, count(*) FILTER (label = 1 AND place >= j) AS k,
    count(*) FILTER (label <> 1) AS nb, count(*) FILTER (label <> 1 AND place >= j) AS kb
  FROM known, range(50) AS cutoffs(j) GROUP BY ALL
), tests AS (
  SELECT *, k <= n * 0.006::DOUBLE AND list_sum(list_transform(generate_series(0, k),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.006) + (n - i) * ln(1 - 0.006)))) <= 0.05::DOUBLE / (5 * (SELECT count(DISTINCT stratum) FROM known)) AS passes
  FROM tallies
), certified AS (
  SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY j DESC) AS certain FROM tests
), chosen AS (
  SELECT stratum, rule, j FROM certified WHERE certain AND kb > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY kb / nb - k / n DESC, j DESC) = 1
), limits AS (
  SELECT stratum, list({'rule': rule, 'j': j}) AS cuts FROM chosen GROUP BY stratum
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND len(list_filter(coalesce(cuts, []), lambda c: len(list_filter(places, lambda p: p.rule = c.rule AND p.place >= c.j)) > 0)) = 0 AS kept
FROM judged LEFT JOIN limits USING (stratum)
"""

#: CRC-32 byte by byte over a table of 256, once for each distinct run of words.
IMPORTANCE_RESAMPLING = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents
), i AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), runs AS (
  SELECT r, unnest([array_to_string(w[k : k + n - 1], ' ') FOR k IN generate_series(1, len(w) - n + 1)]) AS f FROM d, (SELECT unnest([1, 2, 3]) AS n)
), aims AS (
  SELECT unnest([array_to_string(w[k : k + n - 1], ' ') FOR k IN generate_series(1, len(w) - n + 1)]) AS f FROM i, (SELECT unnest([1, 2, 3]) AS n)
), tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM runs UNION SELECT f FROM aims)
), bytes AS (
  SELECT f, list_prepend(4294967295, [('0x' || h[2 * k - 1 : 2 * k])::BIGINT FOR k IN generate_series(1, len(h) // 2)]) AS b FROM hexed
), buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS b FROM bytes, tab
), s AS (
  SELECT b, count(*) AS s FROM runs JOIN buckets USING (f) GROUP BY b
), t AS (
  SELECT b, count(*) AS t FROM aims JOIN buckets USING (f) GROUP BY b
), g AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(coalesce(s, 0)) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (sum(coalesce(t, 0)) OVER () + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), weights AS (
  SELECT r, count(*) AS n, sum(g)::BIGINT AS w FROM runs JOIN buckets USING (f) JOIN g USING (b) GROUP BY r
), scores AS (
  SELECT doc_id, len(d.w) AS words, coalesce(n, 0) AS n_features, coalesce(weights.w, 0) AS weight,
    coalesce(weights.w, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS p, count(*) FILTER (words >= 20) OVER () AS n FROM scores
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN words >= 20 AND p <= 5 * n // 100 THEN p END AS rank FROM ranked
"""

HARD_NEGATIVES = """
WITH rows_ AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.r, a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
  SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS p
  FROM scores WHERE same QUALIFY p <= 5
), windows AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.p ORDER BY score DESC, id) AS rank
  FROM positives p JOIN scores s ON s.r = p.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= 10
"""

def _escaped(text: str) -> str:
    """SQL of a text as the chat template writes it."""
    from lodecast.llm.chat import CONTROLS

    out = f"replace({text}, '\\', '\\\\')"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'chatgpt' THEN 'assistant' ELSE role END, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(length('<|im_start|>') + length(replace({_escaped('role')}, chr(10), chr(92) || 'n')) + 1 + length({_escaped('text')}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES = {"op2_risk_controlled_rules": RISK_CONTROLLED_RULES, "op3_warc_members": WARC_MEMBERS, "op6_lsh_forest_join": JACCARD_JOIN, "op8_winnowing": WINNOWING, "op11_importance_resampling": IMPORTANCE_RESAMPLING, "op12_hard_negatives": HARD_NEGATIVES, "op13_chat_turns": CHAT}
