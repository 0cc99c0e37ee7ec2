"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP5 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

OP7 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_symbols * 100 > 10 * n_words OR n_dup_lines * 100 > 30 * n_lines OR NOT (word_chars / greatest(n_words, 1) BETWEEN 2 AND 15) AS soft_failed
  FROM m),
h AS (SELECT source, count(*) AS docs, sum(CAST(base_failed OR soft_failed AS BIGINT)) AS failed FROM f GROUP BY source),
p AS (
  SELECT sum(failed) / sum(docs) AS mean, sum(docs) AS d, coalesce(var_samp(failed / docs), 0) - sum(failed) / sum(docs) * (1 - sum(failed) / sum(docs)) * avg(1 / docs) AS between_hosts
  FROM h),
q AS (SELECT mean, CASE WHEN between_hosts > 0 THEN greatest(mean * (1 - mean) / between_hosts - 1, 0.01) ELSE d END AS strength FROM p),
v AS (SELECT source, (failed + mean * strength) / (docs + strength) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (rate > 0.4 AND soft_failed) AS kept, soft_failed, round(rate, 9) AS host_rate, rate > 0.4 AS host_bad
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

# spans by kind: (kind, pattern, group whose length counts within all of the pattern in group 1, least length)
_KINDS = (
    ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 3, 8),
    ("access", "AKIA[A-Z0-9]+", 1, 16),
    ("hex", "[0-9a-f]+", 1, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 1, 0),
    ("github", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", 1, 0),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 1, 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
    ("url_login", r"\b[a-z][a-z0-9+.-]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]{3,}@", 1, 0),
)
# chr(57344) to chr(57346), which no text has, stand before the group, the match, and what follows it
_MARKED = "\n  UNION ALL ".join(f"SELECT rid, {k} AS rank, '{kind}' AS kind, {least} AS least, regexp_replace(t, '({pattern})', chr(57344) || '\\{group}' || chr(57345) || '\\1' || chr(57346), 'g') AS marked FROM d" for k, (kind, pattern, group, least) in enumerate(_KINDS))

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_MARKED}),
p AS (SELECT rid, rank, kind, least, unnest(string_split(marked, chr(57344))) AS part, generate_subscripts(string_split(marked, chr(57344)), 1) AS j FROM m),
l AS (
  SELECT *, CASE WHEN j = 1 THEN 0 ELSE length(split_part(split_part(part, chr(57345), 2), chr(57346), 1)) END AS found,
    CASE WHEN j = 1 THEN length(part) ELSE length(split_part(part, chr(57346), 2)) END AS rest
  FROM p),
s AS (SELECT *, coalesce(sum(found + rest) OVER (PARTITION BY rid, rank ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
x AS (SELECT rid, rank, kind, CAST(start AS BIGINT) AS start, CAST(start AS BIGINT) + found AS end_ FROM s WHERE j > 1 AND length(split_part(part, chr(57345), 1)) >= least),
g AS (
  SELECT rid, string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, rank) AS spans, string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex
  FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, (i - 1) % 3 + 1 AS w, 3 * ss AS cap, sum(ss) OVER () AS total FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, i) AS turn, total - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM w),
f AS (SELECT turn AS first_open, remains, open_w FROM o WHERE remains * w <= cap * open_w ORDER BY turn LIMIT 1),
t AS (SELECT source, i, ss, cap, total // 4 AS seats, CASE WHEN turn < first_open THEN CAST(cap AS DOUBLE) ELSE CAST(f.remains * w AS DOUBLE) / CAST(f.open_w AS DOUBLE) END AS target FROM o, f),
q AS (SELECT i, seats, target / (2 * k + 1) AS q FROM (SELECT *, unnest(range(CAST(seats AS BIGINT))) AS k FROM t WHERE target > 0)),
r AS (SELECT i, seats, row_number() OVER (ORDER BY q DESC, i) AS place FROM q),
e AS (
  SELECT t.i, k, least(4 * count(r.place), any_value(cap)) AS e
  FROM t CROSS JOIN range(16) AS x(k) LEFT JOIN r ON r.i = t.i AND r.place <= t.seats * (k + 1) // 16 GROUP BY t.i, k),
b AS (SELECT i, k, e, coalesce(lag(e) OVER (PARTITION BY i ORDER BY k), 0) AS before FROM e),
p AS (
  SELECT doc_id, size, t.i, ss, target, coalesce(sum(size) OVER (PARTITION BY t.i ORDER BY md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT doc_id, k, sum(greatest(least(start + pass * ss + size, e) - greatest(start + pass * ss, before), 0)) AS words
  FROM p JOIN b ON p.i = b.i CROSS JOIN range(3) AS y(pass) GROUP BY doc_id, k),
g AS (SELECT doc_id, sum(words) AS taken, coalesce(string_agg(k || ':' || words, ',' ORDER BY k) FILTER (words > 0), '') AS shards FROM n GROUP BY doc_id)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken, shards FROM p JOIN g USING (doc_id)
"""

# every window of 100 bytes, by content in the order of its places
OP9 = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT rid, b, unnest(range(n - 99)) AS place FROM d WHERE n >= 100),
x AS MATERIALIZED (SELECT rid, place, md5_number(b[place + 1 : place + 100]) AS x FROM p),
w AS (SELECT rid, place, row_number() OVER (PARTITION BY x ORDER BY rid, place) > 1 AS again FROM x),
h AS (SELECT rid, place, coalesce(place > lag(place) OVER (PARTITION BY rid ORDER BY place) + 100, true) AS fresh FROM w WHERE again),
s AS (SELECT rid, place, sum(CAST(fresh AS INT)) OVER (PARTITION BY rid ORDER BY place) AS span FROM h),
r AS (SELECT rid, min(place) AS a, max(place) + 100 AS z FROM s GROUP BY rid, span),
k AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM r),
g AS (
  SELECT rid, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(hex(b[before + 1 : a]), '' ORDER BY a) AS kept, max(z) AS tail
  FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept || hex(b[tail + 1 : n])) END) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""

ORACLE_SQL = {"op2_secret_scan": OP2, "op5_exact_dedup": OP5, "op7_quality_rules": OP7, "op8_mixing": OP8, "op9_suffix_dedup": OP9}
