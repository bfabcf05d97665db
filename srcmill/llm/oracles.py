"""The same results in DuckDB SQL, where SQL can express them; each is written from the contract, not from the operator."""

from .license_texts import TEMPLATES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(" + _LOWER + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


LICENSE_SCAN = f"""
WITH template AS (
  SELECT split_part(name, '/', 1) AS licence, list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS grams
  FROM (SELECT name, {_WORDS.format("text")} AS ws FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}) AS t(name, text))
), part AS (
  SELECT doc_id, unnest(list_distinct([t] || string_split_regex(t, '\\n[ \\t]*\\n') || string_split(t, chr(10)))) AS part
  FROM (SELECT doc_id, {_LOWER.format("text")} AS t FROM documents WHERE text IS NOT NULL)
), gram AS (
  SELECT doc_id, part, list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS grams
  FROM (SELECT doc_id, part, {_WORDS.format("part")} AS ws FROM part) WHERE len(ws) > 1
), scored AS (
  SELECT doc_id, part, licence, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS score
  FROM gram g JOIN template t ON len(g.grams) <= 2 * len(t.grams)
), best AS (
  SELECT doc_id, part, arg_min(licence, (-score, licence)) AS licence, max(score) AS score
  FROM scored WHERE score >= 0.8 GROUP BY ALL
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, arg_min(licence, (-score, licence)) AS licence, max(score) AS score
  FROM best GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences, licence, round(score, 9) AS score
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""

DECONTAMINATION = f"""
WITH item AS (
  SELECT item_id, ws, least(10, len(ws)) AS size FROM (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark) WHERE len(ws) > 0
), win AS (
  SELECT item_id, size, k, ws[k:k + size - 1] AS ws FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS k FROM item)
), doc AS (
  SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents
), place AS (
  SELECT doc_id, k, ws[k:k + size - 1] AS ws, size
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM doc, (SELECT DISTINCT size FROM win))
), hit AS (
  SELECT DISTINCT doc_id, item_id, place.k, place.size FROM place JOIN win ON place.ws = win.ws
), covered AS (
  SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS w FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id
), posting AS (
  SELECT doc_id, w, q FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS q FROM doc) WHERE w IN (SELECT unnest(ws) FROM item)
), frequency AS (
  SELECT w, count(*) AS n FROM posting GROUP BY w
), word AS (
  SELECT item_id, k, size, unnest(ws) AS w, generate_subscripts(ws, 1) AS nth FROM win
), rare AS (
  SELECT item_id, k, size, arg_min(w, (coalesce(n, 0), nth)) AS w, arg_min(nth, (coalesce(n, 0), nth)) AS nth FROM word LEFT JOIN frequency USING (w) GROUP BY ALL
), start AS (
  SELECT DISTINCT item_id, k, size, doc_id, q - nth + d AS p FROM rare JOIN posting USING (w), (SELECT unnest([-2, -1, 0, 1, 2]) AS d)
), near AS (
  SELECT doc_id, item_id FROM (
    SELECT doc_id, item_id, k, size, p, count(DISTINCT nth) AS n
    FROM start JOIN word USING (item_id, k, size) JOIN posting USING (doc_id, w) WHERE q - nth BETWEEN p - 2 AND p + 2 GROUP BY ALL
  ) WHERE n = size
), nearby AS (
  SELECT doc_id, count(DISTINCT item_id) AS n FROM near GROUP BY doc_id
)
SELECT doc.doc_id, len(doc.ws)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated, coalesce(nearby.n, 0)::BIGINT AS n_near_items
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM part q JOIN part c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""

MIXING = """
WITH doc AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM doc GROUP BY source
), capped AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS turn
  FROM src WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(rest / open, turn) AS level FROM capped WHERE cap > weight * rest / open
), target AS (
  SELECT source, source_size, CASE WHEN cap <= weight * rest / open THEN cap ELSE least(cap, weight * level) END AS target FROM capped, (SELECT (FROM level) AS level)
), need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM target
), ranked AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS need, sum(size) OVER (PARTITION BY d.source ORDER BY key RANGE UNBOUNDED PRECEDING) AS reached,
    sum(size) OVER (PARTITION BY d.source, substr(key, 1, 3)) AS cell, sum(size) OVER (PARTITION BY d.source ORDER BY substr(key, 1, 3) RANGE UNBOUNDED PRECEDING) AS cells
  FROM doc d JOIN need n ON d.source IS NOT DISTINCT FROM n.source
), chosen AS (
  -- buckets before that in which the target is reached are taken whole, of that one the documents whose middle lies before it
  SELECT *, need > 0 AND (cells < need OR cells - cell < need AND reached - size / 2 < need) AS more FROM ranked
), off AS (
  SELECT source, need - coalesce(sum(size) FILTER (more), 0) AS rest FROM chosen GROUP BY source, need
), together AS (
  SELECT c.source, key, bool_or(more) AS more, sum(size) AS size, any_value(rest) AS rest FROM chosen c JOIN off o ON c.source IS NOT DISTINCT FROM o.source GROUP BY c.source, key
), turned AS (
  SELECT source, arg_min(key, (abs(abs(rest) - size), key)) AS key FROM together WHERE abs(abs(rest) - size) < abs(rest) AND more = (rest < 0) GROUP BY source
)
SELECT doc_id, size, source_size, target, ((whole + (more <> (t.key IS NOT NULL))::INT) * size)::BIGINT AS taken
FROM chosen c LEFT JOIN turned t ON c.source IS NOT DISTINCT FROM t.source AND c.key = t.key
"""

REPEATS = """
WITH doc AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM doc)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), island AS (
  SELECT doc_id, s, sum(CASE WHEN s - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM again)
), span AS (
  SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM island GROUP BY doc_id, run
), piece AS (
  SELECT span.doc_id, a, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS kept, b
  FROM span JOIN doc USING (doc_id) WINDOW w AS (PARTITION BY span.doc_id ORDER BY a)
), cut AS (
  SELECT doc_id, string_agg(kept, '' ORDER BY a) AS kept, max(b) AS b, count(*) AS n FROM piece GROUP BY doc_id
), removed AS (
  SELECT doc_id, sum(b - a) AS n FROM span GROUP BY doc_id
)
SELECT doc.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed.n, 0)::BIGINT AS n_removed, coalesce(cut.n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(cut.kept || substr(h, 2 * cut.b + 1), h))) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

# CRC-32 from its definition: a table of the 256 remainders, then a byte at a time.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc"
_CRC = "xor(list_reduce({0}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"

CONVERSATION_TRIE = f"""
WITH crc AS ({_CRC_TABLE}), own AS (
  SELECT conv_id, list(length(role) || ':' || role || text ORDER BY p) AS s, list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY p) AS w
  FROM (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS p
    FROM conversations WHERE conv_id IS NOT NULL
  ) GROUP BY conv_id
), head AS (
  SELECT *, conv_id - conv_id % 20 AS base, {_CRC.format("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 4 AS h FROM own, crc
), conv AS (
  SELECT h.conv_id, CASE WHEN h.conv_id = base THEN h.s ELSE list_concat(coalesce(b.s, [])[1:h], h.s[h + 1:]) END AS s,
    CASE WHEN h.conv_id = base THEN h.w ELSE list_concat(coalesce(b.w, [])[1:h], h.w[h + 1:]) END AS w
  FROM head h LEFT JOIN own b ON b.conv_id = base
), node AS (
  SELECT s[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d = 0 THEN 0 ELSE w[d] END) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM conv) GROUP BY ALL
), child AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), subtree AS (
  SELECT path[1:a] AS path, sum(leaf) AS leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT n.*, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, depth + 1)) AS a FROM node n LEFT JOIN child c USING (path)) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1] LEFT JOIN child c ON c.path = n.path JOIN subtree s ON s.path = n.path
"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), run AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents WHERE text IS NOT NULL
  ) WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, {_CRC.format("list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)")} AS h
  FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM run), crc
), dict AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM dict)
), shorter AS (
  SELECT DISTINCT c.word, c.n, d.word AS other, d.n AS other_n FROM cut c JOIN dict d ON d.word = c.rest
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL FROM shorter UNION ALL SELECT other, other_n, word, n FROM shorter
), best AS (
  SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS form, max(other_n) AS form_n FROM near GROUP BY word, n
), form AS (
  SELECT word, form, form_n FROM best WHERE form_n >= 10 * n
), chain AS (
  SELECT word, form AS place, 1 AS step FROM form UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN form f ON f.word = c.place
), root AS (
  SELECT word, arg_max(place, step) AS root FROM chain GROUP BY word
)
SELECT d.word, f.form, coalesce(r.root, d.word) AS root, d.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM dict d LEFT JOIN best b USING (word) LEFT JOIN form f USING (word) LEFT JOIN root r USING (word)
"""

SQL = {
    "op1_license_scan": LICENSE_SCAN, "op3_decontamination": DECONTAMINATION, "op5_topk": TOPK, "op8_mixing": MIXING, "op10_repeats": REPEATS,
    "op11_spelling_variants": SPELLING_VARIANTS, "op13_conversation_trie": CONVERSATION_TRIE,
}
