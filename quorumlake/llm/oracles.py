"""DuckDB SQL for the numbered queries that SQL can express, over whole tables."""

LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT l.*, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM keyed l LEFT JOIN owners o ON l.k = o.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

CONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT DISTINCT d.doc_id, d.p, d.n, win.item_id
  FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.s = d.s),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""

REPEATS = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM dw WHERE len(w) >= 35)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM win WHERE h IN (SELECT h FROM again)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM dw WHERE len(w) > 0),
kept AS (
  SELECT words.doc_id, count(*) FILTER (gone.q IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY words.q) FILTER (gone.q IS NULL) AS s
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.q = words.q GROUP BY words.doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM dw LEFT JOIN kept ON kept.doc_id = dw.doc_id
"""

NEAR = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + least(len(w), 5) - 1], ' '), least(len(w), 5)) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS to_id FROM documents UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.to_id),
least_of AS (SELECT node, min(to_id) AS component_id FROM reach GROUP BY node)
SELECT dw.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, dw.doc_id = component_id AS kept
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id JOIN least_of ON least_of.node = dw.doc_id
"""

CHATS = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, regexp_replace(text, '(\\|### |: |</turn>)', '\\\1', 'g') AS safe,
         CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || regexp_replace(role, '(\\|### |: |</turn>)', '\\\1', 'g') END AS name,
         lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final
  FROM t),
j AS (
  SELECT *, CASE before WHEN '' THEN role IN ('system', 'user') AND (SELECT count(*) FROM t x WHERE x.conv_id = e.conv_id AND x.turn < e.turn) = 0
                        WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS fine FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(name) + 2 + length(safe) + 8)::BIGINT AS formatted_chars, bool_and(fine) AND bool_or(final AND role = 'assistant') AS complete
FROM j GROUP BY conv_id
"""

#: For pages without redirects or canonical links, as the synthetic ones are; tests cover the rest by brute force.
URLS = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rh, rp, verdict)),
m AS (SELECT p.page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id
"""

SPELLING = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS h
  FROM counted, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.s = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.s = words.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY a),
forms AS (SELECT a AS word, min(b) AS form, max(p.n) AS form_n FROM pairs p JOIN best USING (a) JOIN words w ON w.word = p.a WHERE p.n = most AND p.n >= 10 * w.n GROUP BY a),
chain AS (SELECT word, form AS upto FROM forms UNION SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.upto),
roots AS (SELECT word, upto AS root FROM chain WHERE upto NOT IN (SELECT word FROM forms))
SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form, form_n, coalesce(root, w.word) AS root
FROM words w LEFT JOIN best ON best.a = w.word LEFT JOIN forms ON forms.word = w.word LEFT JOIN roots ON roots.word = w.word
"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    steps = [f"""
WITH kept AS (
  SELECT vec_id, list_transform(e, lambda x: floor(64 * x)::BIGINT) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS c, v AS m FROM kept ORDER BY c LIMIT {k})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(
            f"""d{i} AS (SELECT vec_id, v, c, m, list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j])))::BIGINT AS distance FROM kept, m{i}),
a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT c, j, floor(sum(v[j]) / count(*))::BIGINT AS x FROM a{i}, range(1, 65) AS r(j) GROUP BY c, j),
m{i + 1} AS (SELECT m{i}.c, coalesce(x, m) AS m FROM m{i} LEFT JOIN (SELECT c, list(x ORDER BY j) AS x FROM s{i} GROUP BY c) s ON s.c = m{i}.c)"""
            )
    return ",\n".join(steps) + f"""
SELECT vec_id, c AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds}
"""


CLUSTERS = _clusters()

ORACLES: dict[str, str] = {
    "op2_chat_format": CHATS,
    "op4_line_dedup": LINES,
    "op6_decontaminate": CONTAMINATION,
    "op8_near_dedup": NEAR,
    "op9_substring_dedup": REPEATS,
    "op10_url_filter": URLS,
    "op11_spelling": SPELLING,
    "op12_clusters": CLUSTERS,
}
