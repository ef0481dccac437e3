"""DuckDB SQL of queries whose modules do not hold it themselves."""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words] ELSE list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a AS u, b AS v FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), l AS (
  SELECT u, v FROM e UNION SELECT v, u FROM e
), r AS (
  SELECT u AS node, u AS seen FROM l UNION SELECT r.node, l.v FROM r JOIN l ON l.u = r.seen
), k AS (
  SELECT node, min(seen) AS component FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.node = d.doc_id
"""

LICENSE_BASE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), p AS (
  SELECT doc_id, len(words) AS n_words, list_filter(range(1, len(words) + 1), lambda i: words[i] = 'mit' AND words[i + 1] = 'license') AS mit,
         list_filter(range(1, len(words) + 1), lambda i: words[i] = 'apache' AND words[i + 1] = 'license') AS apache,
         list_filter(range(1, len(words) + 1), lambda i: words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license') AS gpl FROM w
), q AS (
  SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM p
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM q
"""

PII_COUNTS = r"""
WITH m AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
         regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
         list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
         list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
  FROM documents
)
SELECT doc_id, len(email) AS n_email,
       len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(TRY_CAST(y AS DOUBLE), 1000) > 255)) = 0)) AS n_ip,
       len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i:
           CASE WHEN i % 2 = 1 THEN CAST(x[length(x) - i + 1] AS INT) ELSE CAST(x[length(x) - i + 1] AS INT) * 2 - CASE WHEN CAST(x[length(x) - i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
       len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone
FROM m
"""

REPAIR = r"""
WITH RECURSIVE inserts(came, state, cost, letters) AS (
  VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')
), edits(came, state, head, edit, cost) AS (
  VALUES (0, 0, '', 'D', 4), (1, 1, '', 'D', 4), (2, 2, '', 'D', 4), (3, 3, '', 'D', 4), (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0), (3, 2, 'u', 'K', 0),
         (0, 2, '', 'R', 3), (1, 2, '', 'R', 3), (2, 3, '', 'R', 3), (3, 2, '', 'R', 3)
), raw AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                         lambda s, x: list_reduce(range(8), lambda v, k: xor(v >> 1, (v & 1) * 3988292384), xor(s, ascii(x)::BIGINT)), 4294967295), 4294967295) % 20 AS how
  FROM (SELECT conv_id, turn, role, text FROM conversations)
), damaged AS (
  SELECT c, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, range(2) copies(k) WHERE how <> 0 AND (k = 0 OR how = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), copies AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS copy FROM placed
), turns AS (
  SELECT c, i, turn, role, text, left(role, 1) AS head, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM copies
), counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY c
), walk(c, i, state, cost, audit) AS (
  SELECT c, 0::BIGINT, inserts.state, inserts.cost, inserts.letters FROM counts, inserts WHERE came = 0
  UNION ALL
  SELECT c, i, state, best.cost, best.audit FROM (
    SELECT w.c, t.i, n.state, min(struct_pack(cost := w.cost + e.cost + n.cost + CASE WHEN t.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END, audit := w.audit || e.edit || n.letters)) AS best
    FROM walk w JOIN turns t ON t.c = w.c AND t.i = w.i + 1 JOIN edits e ON e.came = w.state AND e.head IN ('', t.head) AND (e.edit = 'D' OR t.fault IN ('', 'truncated')) JOIN inserts n ON n.came = e.state
    GROUP BY w.c, t.i, n.state
  )
), chosen AS (
  SELECT c, best.cost AS cost, best.audit AS audit FROM (SELECT w.c, min(struct_pack(cost := w.cost, audit := w.audit)) AS best FROM walk w JOIN counts k ON k.c = w.c AND k.n = w.i WHERE w.state IN (0, 3) GROUP BY w.c)
), letters AS (
  SELECT c, p, audit[p] AS edit FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS p FROM chosen)
), kept AS (
  SELECT l.c, p, edit, role, text, row_number() OVER (PARTITION BY l.c ORDER BY p) AS place FROM (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY c ORDER BY p) AS i FROM letters) l
  LEFT JOIN turns t ON t.c = l.c AND t.i = l.i AND l.edit <> 'I' WHERE edit <> 'D'
), lines AS (
  SELECT c, p, CASE edit WHEN 'K' THEN role ELSE CASE WHEN (place - 1 - max(CASE WHEN place = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c)) % 2 = 0 THEN 'user' ELSE 'assistant' END END
               || ':' || CASE edit WHEN 'I' THEN '' ELSE text END AS line FROM kept
), joined AS (
  SELECT c, string_agg(line, chr(10) ORDER BY p) AS text FROM lines GROUP BY c
)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(j.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM raw) r LEFT JOIN counts USING (c) LEFT JOIN chosen USING (c) LEFT JOIN joined j USING (c)
"""
