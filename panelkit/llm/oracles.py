"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM norm WINDOW g AS (PARTITION BY body)
"""

#: The binary search and the greedy check as a recursive query over the list
#: of running sizes; the checksum byte by byte from a table built by its rule.
SHARDING = """
WITH RECURSIVE crc_steps(b, i, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_steps WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM crc_steps WHERE i = 8),
docs AS (
  SELECT doc_id, coalesce(text, '') AS body, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         sha256(coalesce(text, '')) AS atom
  FROM documents),
summed AS (
  SELECT atom, any_value(body) AS body, sum(size)::BIGINT AS bytes FROM docs GROUP BY atom),
checked AS (
  SELECT atom, xor(4294967295, list_reduce(
           [4294967295] || list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT),
           lambda c, b: xor(c // 256, tab[1 + xor(c, b) % 256]))) AS text_crc32
  FROM summed, crc_table),
totals AS (SELECT coalesce(sum(bytes), 0)::BIGINT AS total FROM summed),
by_size AS (
  SELECT atom, bytes, row_number() OVER w - 1 AS i, sum(bytes) OVER w - bytes AS larger
  FROM summed WINDOW w AS (ORDER BY bytes DESC, atom)),
own AS (
  SELECT atom, i FROM (
    SELECT atom, i, bool_and(i < 23 AND bytes * (24 - i) > total - larger) OVER (ORDER BY i) AS alone
    FROM by_size, totals) WHERE alone),
line AS (
  SELECT atom, bytes, sum(bytes) OVER (ORDER BY atom)::BIGINT AS upto
  FROM summed WHERE atom NOT IN (SELECT atom FROM own)),
given AS (
  SELECT 24 - (SELECT count(*) FROM own) AS n, coalesce(max(upto), 0) AS total, coalesce(max(bytes), 0) AS largest,
         [0::BIGINT] || coalesce(list(upto ORDER BY upto), []) AS ends
  FROM line),
search(low, high) AS (
  SELECT greatest(largest, (total + n - 1) // n)::BIGINT, total::BIGINT FROM given
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT low, high, mid, total = list_reduce(list_resize([0::BIGINT], n + 1, 0), lambda p, z:
                 list_max(list_filter(ends, lambda e: e <= p + mid))) AS ok
        FROM (SELECT low, high, (low + high) // 2 AS mid FROM search WHERE low < high), given)),
capacity AS (SELECT low AS c FROM search WHERE low >= high LIMIT 1),
cuts(k, p) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT k + 1, list_max(list_filter(ends, lambda e: e <= p + c)) FROM cuts, given, capacity WHERE k + 1 < n),
placed AS (
  SELECT atom, i::INTEGER AS shard FROM own
  UNION ALL
  SELECT atom, ((SELECT count(*) FROM own) + (SELECT count(*) FROM cuts WHERE k > 0 AND p <= upto - bytes))::INTEGER
  FROM line)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY atom, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM docs JOIN placed USING (atom) JOIN checked USING (atom)
"""

#: Every pair of sources over the language's kept terms, absent ones as 0.
SOURCE_AUDIT = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
words AS (
  SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(terms) AS term FROM docs)
  GROUP BY ALL),
kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(*) >= 3),
langs AS (
  SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(total), 0)::HUGEINT AS lang_n
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (
  SELECT lang, source, term, sum(n)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM groups LEFT JOIN held USING (lang, source)
  GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (s.size + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (l.lang_n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) JOIN sizes s USING (lang, source)
  LEFT JOIN held h USING (lang, source, term)),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN priced p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source),
over_used AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM over_used)
WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {"op2_exact_dedup": EXACT_DEDUP, "op11_sharding": SHARDING, "op12_source_audit": SOURCE_AUDIT}
