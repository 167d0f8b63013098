"""DuckDB SQL for the queries of this package that SQL can express; the others are tested by brute force."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
), known AS (
  SELECT k, min(doc_id) AS least FROM w GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM (SELECT w.doc_id, w.i FROM w JOIN known USING (k) WHERE known.least < w.doc_id), range(0, 50) AS t(j)
), word AS (
  SELECT doc_id, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS p FROM d
), kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY word.p) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


OP4 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), known AS (
  SELECT body, min(page_id) AS first FROM p GROUP BY body
)
SELECT page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               CAST(1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)
                        FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p JOIN known ON p.body = known.body
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), size AS (
  SELECT DISTINCT n FROM phrase
), w AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, size WHERE len(ws) >= n)
), hit AS (
  SELECT w.doc_id, w.i, w.n, phrase.item_id FROM w JOIN phrase ON w.k = phrase.k AND w.n = phrase.n
), words AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(0, 10) AS t(j) WHERE j < n GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS t
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS r ON r.a = d.doc_id
"""


OP12 = r"""
WITH piece AS (
  SELECT row_number() OVER () AS id, lang, p
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), word AS (
  SELECT id, lang, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT id, lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece)
), place AS (
  SELECT lang, x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM word WINDOW w AS (PARTITION BY id ORDER BY i)
), f1 AS (
  SELECT lang, x, CAST(count(*) AS BIGINT) AS n FROM place GROUP BY ALL
), f2 AS (
  SELECT lang, x, y, CAST(count(*) AS BIGINT) AS n FROM place WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, x, y, z, CAST(count(*) AS BIGINT) AS n FROM place WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), total AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f1 GROUP BY lang
), cut AS (
  SELECT f2.lang, x || ' ' || f2.y AS phrase, f2.n AS a, 1 AS k, p.n AS l, q.n AS r
  FROM f2 JOIN f1 p USING (lang, x) JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
  UNION ALL
  SELECT f3.lang, concat_ws(' ', f3.x, f3.y, f3.z), f3.n, 1, p.n, q.n
  FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
  UNION ALL
  SELECT f3.lang, concat_ws(' ', f3.x, f3.y, f3.z), f3.n, 2, p.n, q.n
  FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z
), scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a * a) // (l::HUGEINT * r), k) = 1
), covered AS (
  SELECT DISTINCT f2.lang, f2.x || ' ' || f2.y AS phrase
  FROM f2 JOIN (SELECT lang, x, y, n FROM f3 UNION ALL SELECT lang, y, z, n FROM f3) t
    ON t.lang = f2.lang AND t.x = f2.x AND t.y = f2.y WHERE 100 * t.n >= 50 * f2.n
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM scored s ANTI JOIN covered v ON v.lang = s.lang AND v.phrase = s.phrase
)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, total.n AS n, score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""


OP13 = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || list_transform(range(0, 8), lambda x: CAST(0 AS BIGINT)),
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS i))
), run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS prefix, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS v FROM documents
), hashed AS (
  SELECT v, xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(prefix || v, ''),
                              lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [195, CAST(ord(ch) - 64 AS BIGINT)] END)),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM run, crc WHERE length(v) >= 5
), word AS (
  SELECT w, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(v, 1, h % length(v)) || substr(v, h % length(v) + 2) ELSE v END AS w FROM hashed)
  WHERE length(w) >= 5 GROUP BY w HAVING count(*) >= 3
), shorter AS (
  SELECT w, n, p, substr(w, 1, p) || substr(w, p + 2) AS s FROM (SELECT w, n, unnest(range(0, length(w))) AS p FROM word)
), near AS (
  SELECT x.w, y.w AS v, y.n FROM shorter x JOIN shorter y ON x.s = y.s AND x.p = y.p AND x.w <> y.w
  UNION SELECT x.w, y.w, y.n FROM shorter x JOIN word y ON x.s = y.w
  UNION SELECT y.w, x.w, x.n FROM shorter x JOIN word y ON x.s = y.w
), best AS (
  SELECT w, CAST(count(*) AS BIGINT) AS n_near, first(v ORDER BY n DESC, v) AS v, max(n) AS n FROM near GROUP BY w
), form AS (
  SELECT word.w, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * word.n THEN v END AS form,
         CASE WHEN best.n >= 2 * word.n THEN best.n END AS form_n
  FROM word LEFT JOIN best ON best.w = word.w
), path AS (
  SELECT w, w AS root, form AS further FROM form
  UNION ALL SELECT path.w, form.w, form.form FROM path JOIN form ON form.w = path.further
)
SELECT form.w AS word, form, path.root AS root, n, n_near, form_n FROM form JOIN path ON path.w = form.w AND path.further IS NULL
"""


def llm_oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op4_warc": OP4, "op6_decontamination": OP6, "op8_near_duplicates": OP8,
            "op12_collocations": OP12, "op13_spelling_variants": OP13}
