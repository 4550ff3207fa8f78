"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)),
triples AS (
  SELECT k, i, word, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY k ORDER BY i)),
twice AS (
  SELECT k, unnest(range(i, i + 3)) AS i
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, word, b, c) AS n FROM triples WHERE c IS NOT NULL) WHERE n > 1),
repeated AS (SELECT k, count(DISTINCT i) AS n FROM twice GROUP BY k),
per_word AS (SELECT k, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY k),
lines AS (
  SELECT k, line FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
per_line AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM lines GROUP BY k),
measured AS (
  SELECT t.k, doc_id, lang, source, coalesce(w.n, 0) AS n_words, coalesce(w.chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
    coalesce(w.n, 0) < 50 OR 100 * coalesce(r.n, 0) > 50 * coalesce(w.n, 0) AS base_failed
  FROM texts t LEFT JOIN per_word w USING (k) LEFT JOIN per_line l USING (k) LEFT JOIN repeated r USING (k)),
valued AS (
  SELECT k, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats', 'n_words', 'n_lines']) AS rule,
    unnest([100 * word_chars // n_words, 1000 * n_symbols // n_words, 1000 * n_dup_lines // n_lines,
            1000 * n_repeat_words // n_words, n_words, n_lines]) AS exact
  FROM measured WHERE NOT base_failed),
cells AS (
  SELECT *, (exact >> greatest(length(bin(exact)) - 7, 0)::BIGINT) << greatest(length(bin(exact)) - 7, 0)::BIGINT AS v FROM valued),
placed AS (
  SELECT rule, lang, source, v, count(*) OVER g AS n, count(*) OVER (g ORDER BY v) AS below, count(*) OVER l AS ln,
    count(*) OVER (l ORDER BY v) AS lbelow, count(*) OVER a AS an, count(*) OVER (a ORDER BY v) AS abelow
  FROM cells WINDOW g AS (PARTITION BY rule, lang, source), l AS (PARTITION BY rule, lang), a AS (PARTITION BY rule)),
marks AS (SELECT unnest([1, 5, 9]) AS d),
by_group AS (
  SELECT rule, lang, source, d, any_value(n) AS n, any_value(ln) AS ln, min(v) FILTER (below * 10 >= n * d) AS q
  FROM placed, marks GROUP BY ALL),
by_lang AS (SELECT rule, lang, d, min(v) FILTER (lbelow * 10 >= ln * d) AS q FROM placed, marks GROUP BY ALL),
corpus AS (SELECT rule, d, min(v) FILTER (abelow * 10 >= an * d) AS q FROM placed, marks GROUP BY ALL),
settled AS (
  SELECT g.rule, g.lang, g.source, max(q) FILTER (g.d = 1) AS low, max(q) FILTER (g.d = 5) AS median, max(q) FILTER (g.d = 9) AS high
  FROM (SELECT g.rule, g.lang, g.source, g.d, CASE WHEN g.n >= 100 THEN g.q WHEN g.ln >= 100 THEN l.q ELSE c.q END AS q
        FROM by_group g JOIN by_lang l ON g.rule = l.rule AND g.lang IS NOT DISTINCT FROM l.lang AND g.d = l.d
        JOIN corpus c ON g.rule = c.rule AND g.d = c.d) g
  GROUP BY ALL),
sizes AS (SELECT lang, source, max(median) FILTER (rule = 'n_words') AS words, max(median) FILTER (rule = 'n_lines') AS lines FROM settled GROUP BY ALL),
bad AS (
  SELECT DISTINCT v.k
  FROM cells v JOIN settled s ON v.rule = s.rule AND v.lang IS NOT DISTINCT FROM s.lang AND v.source IS NOT DISTINCT FROM s.source
  JOIN sizes z ON v.lang IS NOT DISTINCT FROM z.lang AND v.source IS NOT DISTINCT FROM z.source
  WHERE v.rule NOT IN ('n_words', 'n_lines')
    AND (v.v > high + 6 * greatest(high - median, CASE v.rule WHEN 'word_length' THEN 0 WHEN 'dup_lines' THEN 1000 // greatest(lines, 1) ELSE 1000 // greatest(words, 1) END)
      OR v.rule = 'word_length' AND v.v < low - 6 * (median - low)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND k NOT IN (SELECT k FROM bad) AS kept
FROM measured
"""


OP7 = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, regexp_extract_all(lower(line), '[\p{L}\p{N}]+') AS words
  FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
places AS (SELECT words, {'doc_id': doc_id, 'line_no': line_no} AS place FROM lines WHERE len(words) > 0),
reduced AS (SELECT row_number() OVER () AS id, words, min(place) AS first FROM places GROUP BY words),
gaps AS (
  SELECT id, words, first, g, list_concat(words[1:g - 1], words[g + 1:]) AS rest
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS g FROM reduced WHERE len(words) >= 5)),
pairs AS (
  SELECT a.id, b.first FROM gaps a JOIN gaps b ON a.g = b.g AND a.rest = b.rest AND b.first < a.first
  UNION ALL
  SELECT a.id, b.first FROM gaps a JOIN reduced b ON a.rest = b.words AND b.first < a.first AND len(b.words) >= 5
  UNION ALL
  SELECT b.id, a.first FROM gaps a JOIN reduced b ON a.rest = b.words AND a.first < b.first AND len(b.words) >= 5),
near AS (SELECT id, min(first) AS near FROM pairs GROUP BY id),
verdicts AS (SELECT words, first, CASE WHEN near < first THEN near ELSE first END AS kept FROM reduced LEFT JOIN near USING (id))
SELECT DISTINCT place.doc_id AS doc_id, place.line_no AS line_no, kept.doc_id AS kept_doc_id, kept.line_no AS kept_line_no,
  (kept < first)::BIGINT AS edits
FROM places JOIN verdicts USING (words) WHERE place > kept
"""


OP8 = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS k, doc_id,
    list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\S+'),
      lambda w: lower(regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g'))), lambda w: w <> '') AS w
  FROM documents),
cut AS (
  SELECT k, doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM texts WHERE len(w) > 0),
hashed AS (SELECT k, doc_id, list_transform(s, lambda x: hash(x)) AS s FROM cut),
classes AS (SELECT s, min(doc_id) AS rep, count(*) AS n_copies, row_number() OVER () AS c FROM hashed GROUP BY s),
tokens AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING count(*) * 1800 >= 800 * (a.n + b.n)),
reached AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a),
named AS (SELECT a AS c, min(rep) AS class_id FROM reached JOIN classes ON reached.b = classes.c GROUP BY a),
links AS (SELECT a AS c, count(*) AS n_links FROM pairs GROUP BY a)
SELECT t.doc_id, CASE WHEN c.c IS NULL THEN t.doc_id ELSE class_id END AS class_id, coalesce(n_copies, 1) AS n_copies,
  coalesce(n_links, 0) AS n_links
FROM texts t LEFT JOIN hashed h USING (k) LEFT JOIN classes c ON h.s = c.s LEFT JOIN named USING (c) LEFT JOIN links USING (c)
"""


OP10 = r"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS k, doc_id, source, length(coalesce(text, '')) AS chars, md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
laid AS (
  SELECT *, coalesce(sum(chars) OVER (PARTITION BY source ORDER BY place, doc_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM rows),
sizes AS (SELECT source, sum(chars) AS chars, floor(sqrt(sum(chars)))::BIGINT AS root FROM rows GROUP BY source),
sources AS (
  SELECT source, greatest(ceil(chars / 20000), 1)::BIGINT AS n, greatest(1, 200 * root // greatest(sum(root) OVER (), 1))::BIGINT AS p
  FROM sizes),
starts AS (SELECT DISTINCT unnest([0, n // p, n // p + 1]) AS f FROM sources),
kinds AS (
  SELECT f, source, least(n - least(n, f * p), p) AS a, sum(least(n, f * p)) OVER (PARTITION BY f) AS base,
    sum(least(n - least(n, f * p), p)) OVER (PARTITION BY f) AS q
  FROM starts, sources),
run AS (
  SELECT f, source, a, base, q, 0::BIGINT AS t, 0::BIGINT AS done, NULL::VARCHAR AS pick FROM kinds WHERE a > 0
  UNION ALL
  SELECT f, source, a, base, q, t + 1, done + (source = best.s)::BIGINT, best.s
  FROM (SELECT *, min(CASE WHEN done < a AND done * q // a <= t THEN {'d': ((done + 1) * q + a - 1) // a, 's': source} END) OVER (PARTITION BY f) AS best
        FROM run WHERE t < q)),
plan AS (SELECT f, source, done - 1 AS nth, base + t - 1 AS slot, q FROM run WHERE pick = source),
blocks AS (
  SELECT doc_id, l.source, least(b // 20000, n - 1)::BIGINT AS block_no, p, b FROM laid l JOIN sources s ON l.source = s.source),
timed AS (SELECT *, block_no // p AS c, (SELECT max(f) FROM starts WHERE f <= block_no // p) AS f FROM blocks)
SELECT doc_id, t.source, block_no, (slot + (c - t.f) * q)::BIGINT AS slot, (b - block_no * 20000)::BIGINT AS block_offset
FROM timed t JOIN plan ON t.source = plan.source AND t.f = plan.f AND block_no - c * p = nth
"""


# The nearest border of a group or of a row is found by sorting everything; crc32 goes byte by byte over a table of 256 codes.
OP11 = r"""
WITH RECURSIVE step AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
codes AS (SELECT list(c ORDER BY i) AS codes FROM step WHERE n = 8),
texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
crcs AS (
  SELECT text, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT text FROM texts), codes),
sized AS (
  SELECT k, doc_id, strlen(text) + 16 AS size, crc, ('0x' || substr(md5(text), 1, 15))::BIGINT AS text_key,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS id_key
  FROM texts JOIN crcs USING (text)),
laid AS (
  SELECT *, sum(size) OVER (ORDER BY text_key, id_key, k) - size AS below, sum(size) OVER () AS total FROM sized),
grouped AS (
  SELECT *, min(below) OVER (PARTITION BY text_key) AS group_start, max(below + size) OVER (PARTITION BY text_key) AS group_end FROM laid),
hit AS (
  SELECT i, total, i * total AS goal, 40 * group_start AS gs, 40 * group_end AS ge, 40 * below AS rs, 40 * (below + size) AS re
  FROM grouped, range(1, 40) t(i) WHERE i * total >= 40 * below AND i * total < 40 * (below + size)),
near AS (
  SELECT i, total, goal, CASE WHEN goal - gs <= ge - goal THEN gs ELSE ge END AS by_group,
    CASE WHEN goal - rs <= re - goal THEN rs ELSE re END AS by_row FROM hit),
borders AS (SELECT CASE WHEN 1000 * abs(by_group - goal) <= total THEN by_group ELSE by_row END // 40 AS border FROM near),
dealt AS (SELECT l.*, (SELECT count(*) FROM borders WHERE border <= below)::INTEGER AS shard FROM laid l)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY below) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""


def op13(rounds: int = 10) -> str:
    """All rounds of comparing every vector with every centroid, one after the other. Products of components are exact as doubles."""
    assign = """
of{n} AS MATERIALIZED (
  SELECT r, any_value(v) AS v, min({{'d': norm - 2 * list_inner_product(v, w)::BIGINT + list_inner_product(w, w)::BIGINT, 'c': c}}) AS best
  FROM kept, centroids{n} GROUP BY r),"""
    move = """
sums{n} AS (
  SELECT best.c AS c, i, sum(x::BIGINT)::BIGINT AS s, count(*) AS n
  FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM of{m}) GROUP BY ALL),
centroids{n} AS MATERIALIZED (
  SELECT o.c, coalesce(m.w, o.w) AS w
  FROM centroids{m} o LEFT JOIN (SELECT c, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS w FROM sums{n} GROUP BY c) m USING (c)),"""
    steps = assign.format(n=0) + "".join(move.format(n=n, m=n - 1) + assign.format(n=n) for n in range(1, rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, v, list_inner_product(v, v)::BIGINT AS norm
  FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
centroids0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS c, v AS w FROM kept
  QUALIFY c < 8),{steps}
named AS (SELECT c, sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS name FROM centroids{rounds})
SELECT vec_id, c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(best.d) OVER ()::BIGINT AS inertia, name AS centroid_sha256
FROM of{rounds} JOIN kept USING (r) JOIN named ON named.c = best.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_adaptive_rules": OP4, "op7_line_neighbours": OP7, "op8_chosen_path_join": OP8, "op10_pfair_mix": OP10, "op11_histogram_sort": OP11, "op13_heap_kmeans": op13()}
