"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

_LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

# What each rule matches, as SQL strings; letters of assign keywords in either case.
_PATTERNS = {
    "assign": r"""'([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""",
    "access": "'AKIA[A-Z0-9]+'",
    "hex": "'[0-9a-f]+'",
    "pem": "'-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'",
    "forge": "'gh[opsru]_[A-Za-z0-9]+'",
}


def _by_rule(call: str) -> str:
    """CASE branches that make a call with each rule's pattern, which has to be a constant."""
    return " ".join(f"WHEN '{rule}' THEN {call.replace('{p}', pattern)}" for rule, pattern in _PATTERNS.items())


ORACLES = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
sized AS (SELECT doc_id, len(s) AS n FROM shingled),
incidence AS (SELECT doc_id, unnest(s) AS g FROM shingled),
overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM incidence a JOIN incidence b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM overlap o JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reached(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
lowest AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x),
degree AS (SELECT x, count(*) AS k FROM links GROUP BY x)
SELECT s.doc_id, s.n AS n_shingles, component_id, coalesce(k, 0) AS n_links
FROM sized s JOIN lowest c ON c.x = s.doc_id LEFT JOIN degree d ON d.x = s.doc_id""",
    "op5_secret_scan": f"""
WITH rules(rule, number) AS (VALUES ('assign', 0), ('access', 1), ('hex', 2), ('pem', 3), ('forge', 4)),
cut AS (
  SELECT doc_id, rule, number, CASE rule {_by_rule("string_split_regex(coalesce(text, ''), {p})")} END AS gaps,
    CASE rule {_by_rule("regexp_extract_all(coalesce(text, ''), {p})")} END AS hits,
    CASE rule WHEN 'assign' THEN regexp_extract_all(coalesce(text, ''), {_PATTERNS["assign"]}, 2) END AS inner_hits
  FROM documents, rules),
placed AS (
  SELECT doc_id, rule, number, unnest(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(
      finish := list_sum(list_transform(gaps[1:i], lambda g: len(g))) + list_sum(list_transform(hits[1:i], lambda h: len(h))),
      size := len(hits[i]), checked := len(inner_hits[i])))) AS m
  FROM cut),
kept AS (
  SELECT doc_id, rule, number, CAST(m.finish - m.size AS BIGINT) AS start, CAST(m.finish AS BIGINT) AS finish FROM placed
  WHERE m.size >= CASE rule WHEN 'access' THEN 20 WHEN 'hex' THEN 24 WHEN 'forge' THEN 40 ELSE 1 END AND coalesce(m.checked, 6) >= 6),
said AS (
  SELECT doc_id, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access, count(*) FILTER (rule = 'hex') AS n_hex,
    string_agg(rule || ':' || start || ':' || finish, ',' ORDER BY start, number) FILTER (number < 3) AS base,
    string_agg(rule || ':' || start || ':' || finish, ',' ORDER BY start, number) AS spans
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN said USING (doc_id)""",
    "op11_periodic_runs": """
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(CAST(doc_id AS VARCHAR)))),
      lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INTEGER), 1)) AS BIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) AS h
  FROM documents),
shaped AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM worded),
changed AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
    ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END) END AS w FROM shaped),
placed AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM changed),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM placed LEFT JOIN (SELECT doc_id, i, true AS gone FROM dropped) USING (doc_id, i)
  WHERE gone IS NULL GROUP BY doc_id),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    min({'shorter': -length, 'start': start, 'period': period}) AS best FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, CAST(-best.shorter AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(-1000 * best.shorter // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_source_divergence": f"""
WITH told AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWERED} AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM told),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM words GROUP BY lang, source, term),
terms AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term HAVING sum(docs) >= 3),
kept AS (SELECT lang, source, term, c.n FROM counts c JOIN terms t USING (lang, term)),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM terms GROUP BY lang),
grouped AS (
  SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total, coalesce(sum(k.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM told) g LEFT JOIN langs l ON l.lang = g.lang LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source
  GROUP BY g.lang, g.source),
prices AS (
  SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(k.n, 0) + 1) // (g.total + g.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (t.n + 1) // (g.lang_total + g.v) AS q
  FROM grouped g JOIN terms t ON t.lang = g.lang LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
distances AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM prices x JOIN prices y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
rated AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(d.value, 0) AS value
  FROM grouped g JOIN grouped h ON h.lang = g.lang AND h.source <> g.source
    LEFT JOIN distances d ON d.lang = g.lang AND d.source = g.source AND d.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM prices WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rated)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op9_warc": """
WITH told AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM told""",
}
