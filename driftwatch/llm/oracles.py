"""DuckDB twins of the registered queries that SQL can express over whole tables."""

from __future__ import annotations

# Host, parent domains and section of a URL as in `url_filters`; the fetch times and lists as in `queries`.
_HOST = r"nullif(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)), '')"
_SEGMENT = r"nullif(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '')"

OP2 = f"""
WITH fetched AS (
  SELECT page_id, {_HOST.format(url='url')} AS host, {_SEGMENT.format(url='url')} AS segment,
         1704067200 + (page_id * 7919) % 2592000 AS fetched_at
  FROM pages),
reports AS (
  SELECT (page_id // 7) % 12 AS turn, host, segment, 1704067200 + (page_id * 104729 + 86400) % 2592000 AS listed_at
  FROM fetched WHERE page_id % 7 = 0),
entries AS (
  SELECT pattern, listed_at, max(action) AS action FROM (
    SELECT CASE turn % 3 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]*\\.', '') ELSE host || '/' || segment END AS pattern,
           CASE WHEN turn < 6 THEN 'block' WHEN turn < 9 THEN 'unlist' ELSE 'allow' END AS action, listed_at
    FROM reports)
  WHERE pattern IS NOT NULL GROUP BY ALL),
intervals AS (
  SELECT pattern, action, listed_at, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS until FROM entries),
asked AS (
  SELECT page_id, fetched_at, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS pattern,
         len(string_split(host, '.')) - k + 1 AS weight
  FROM fetched, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(k) WHERE host IS NOT NULL
  UNION ALL
  SELECT page_id, fetched_at, host || '/' || segment, 1000 FROM fetched WHERE segment IS NOT NULL AND host IS NOT NULL),
decided AS (
  SELECT a.page_id, arg_max({{'action': i.action, 'pattern': a.pattern, 'listed_at': i.listed_at}}, a.weight) AS entry
  FROM asked a JOIN intervals i ON a.pattern = i.pattern AND a.fetched_at >= i.listed_at
                                AND (i.until IS NULL OR a.fetched_at < i.until)
  WHERE i.action <> 'unlist' GROUP BY a.page_id)
SELECT f.page_id, f.fetched_at, f.host, CASE WHEN d.entry.action = 'block' THEN 'drop' ELSE 'keep' END AS verdict,
       d.entry.pattern AS pattern, d.entry.listed_at AS listed_at
FROM fetched f LEFT JOIN decided d ON f.page_id = d.page_id
"""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM sized)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

OP11 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
occurring AS (
  SELECT lang, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS phrase
  FROM pieces, unnest(range(1, 5)) AS s(size), unnest(range(1, CAST(len(w) AS BIGINT) - size + 2)) AS p(pos)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM occurring GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.f AS a, k, array_to_string(list_slice(string_split(c.phrase, ' '), 1, k), ' ') AS first_part,
         array_to_string(list_slice(string_split(c.phrase, ' '), k + 1, c.size), ' ') AS rest
  FROM counts c, unnest(range(1, c.size)) AS u(k) WHERE c.size > 1),
cut_scores AS (
  SELECT u.lang, u.size, u.phrase, u.a, u.k, x.f AS l, y.f AS r, (2000000::HUGEINT * u.a) // (x.f::HUGEINT + y.f) AS score
  FROM cuts u JOIN counts x ON x.lang = u.lang AND x.phrase = u.first_part JOIN counts y ON y.lang = u.lang AND y.phrase = u.rest),
lowest AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(string_split(phrase, ' '), pos, pos + part - 1), ' ') AS phrase, max(f) AS longer
  FROM counts, unnest(range(2, size)) AS s(part), unnest(range(1, size - part + 2)) AS p(pos) WHERE size > 2 GROUP BY ALL),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, encode(l.phrase)) AS rank
  FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * l.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

LLM_ORACLES: dict[str, str] = {"op2_url_filters": OP2, "op4_exact_dedup": OP4, "op11_collocations": OP11}
