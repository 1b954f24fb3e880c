"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from foliant.llm import secret_scan

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
  FROM w
), s AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS n_both
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM pairs WHERE 100 * n_both >= 80 * (na + nb - n_both)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id
), roots AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM sets d JOIN roots r ON r.id = d.doc_id
"""

_ALL_WORDS = _WORDS.format(text="coalesce(text, '')")

SUBSTRING_DEDUP = f"""
WITH w AS (
  SELECT doc_id, {_ALL_WORDS} AS ws FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS body
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)
), least AS (
  SELECT body, min(doc_id) AS d FROM win GROUP BY body HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p
  FROM win JOIN least USING (body) WHERE doc_id > d
), lost AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE
    array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)),
      lambda i: ws[i]), ' ') END) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""

# 160 bits as 32 digits of 5 bits.
_BITS = "CAST(unhex(sha1(body)) AS BIT)::VARCHAR"
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: "
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), "
    "lambda j: CAST(substr(bits, 5 * i + j, 1) AS INTEGER) * (1 << (5 - j)))) AS INTEGER), 1)), '')"
)

WARC_ARCHIVE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS digest, {_BITS} AS bits FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS latest FROM d
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM r
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: int, pattern: str, group: int, least: int, text: str = "text") -> str:
    p = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS kind, {least} AS least, string_split_regex({text}, {p}) AS gaps,
    regexp_extract_all({text}, {p}) AS hits, regexp_extract_all({text}, {p}, {group}) AS own FROM t"""


_KINDS = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(secret_scan.KINDS))
_SUSPECT = " AND ".join(f"NOT regexp_matches(body, {_quoted(p)})" for p in secret_scan.ALLOWED)
_MATCHES = " UNION ALL ".join(
    [
        *[_matches(k, p, g, n) for k, (_, p, g, n) in enumerate(secret_scan.PATTERNS)],
        _matches(3, secret_scan.CANDIDATE, 0, secret_scan.WINDOW, "seen"),
        *[_matches(4 + k, p, 0, secret_scan.WINDOW, "seen") for k, (p, _, _) in enumerate(secret_scan.HEX_PIECES)],
    ]
)
_W = secret_scan.WINDOW
_SEEN = "text"
for _word in "|".join(secret_scan.ALLOWED_WORDS).split("|"):
    _SEEN = f"regexp_replace({_SEEN}, '(?i){_word}', '{' ' * len(_word)}', 'g')"
_BITS_OF = " ".join(f"WHEN {4 + k} THEN {bits}" for k, (_, _, bits) in enumerate(secret_scan.HEX_PIECES))

SECRET_SCAN = f"""
WITH t AS (
  SELECT doc_id, text, {_SEEN} AS seen FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), m AS ({_MATCHES}), e AS (
  SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM m
), f AS (
  SELECT doc_id, kind, hits[k] AS body, list_sum(list_transform(gaps[1 : k], lambda x: length(x)))
    + coalesce(list_sum(list_transform(hits[1 : k - 1], lambda x: length(x))), 0) AS start
  FROM e WHERE length(own[k]) >= least
), base AS (
  SELECT doc_id, kind, start, start + length(body) AS stop FROM f WHERE kind < 3
), windows AS (
  SELECT doc_id, kind, start, body, unnest(range(0, length(body) - {_W - 1})) AS o FROM f WHERE kind >= 3 AND {_SUSPECT}
), letters AS (
  SELECT doc_id, kind, start, body, o, substr(body, o + i, 1) AS c
  FROM (SELECT *, unnest(range(1, {_W + 1})) AS i FROM windows)
), sums AS (
  SELECT doc_id, kind, start, body, o, sum(n * log2(n)) AS s
  FROM (SELECT doc_id, kind, start, body, o, c, count(*) AS n FROM letters GROUP BY ALL) GROUP BY ALL
), high AS (
  SELECT DISTINCT doc_id, 3 AS kind, start, stop FROM (
    SELECT doc_id, start + min(o) AS start, start + max(o) + {_W} AS stop FROM sums
    WHERE s <= {_W} * (log2({_W}) - CASE kind {_BITS_OF} ELSE CASE WHEN regexp_matches(body, '^[0-9a-f]+$')
      THEN {secret_scan.HEX_BITS} ELSE {secret_scan.KEY_BITS} END END) + 1e-9
    GROUP BY doc_id, sums.kind, sums.start, body)
), spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM high h WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.start < h.stop AND h.start < b.stop)
), said AS (
  SELECT *, CASE kind {_KINDS} END || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS word FROM spans
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg(word, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(word, ',' ORDER BY start, kind, stop) AS spans
  FROM said GROUP BY doc_id
)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN by_doc USING (doc_id)
"""

SOURCE_MIXING = f"""
WITH f AS (
  SELECT doc_id, source, len({_ALL_WORDS}) AS size, md5(doc_id || '|42') AS d FROM documents
), own AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM f GROUP BY source
), rising AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM own WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)
), met AS (
  SELECT *, 3 * source_size * sharing <= w * rest AS met FROM rising
), level AS (
  SELECT arg_min(rest, source_size / w) FILTER (NOT met) AS rest, arg_min(sharing, source_size / w) FILTER (NOT met) AS sharing
  FROM met
), t AS (
  SELECT m.source, m.source_size, CASE WHEN m.met THEN CAST(3 * m.source_size AS DOUBLE)
    ELSE CAST(CAST(m.w * l.rest AS BIGINT) AS DOUBLE) / CAST(l.sharing AS DOUBLE) END AS target
  FROM met m, level l
), p AS (
  SELECT f.doc_id, f.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
    coalesce(sum(f.size) OVER (PARTITION BY f.source ORDER BY d, f.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(list_sum(list_transform([0, 1, 2],
  lambda k: greatest(0, least(size, quota - before - k * source_size)))) AS BIGINT) AS taken FROM p
"""

# Fixed value: the reversed polynomial of CRC-32.
_CRC = (
    "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len({text}) + 1), "
    "lambda i: ascii(substr({text}, i, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), "
    "lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
)

PERIODIC_RUNS = f"""
WITH w AS (
  SELECT doc_id, {_ALL_WORDS} AS own FROM documents
), g AS (
  SELECT doc_id, own, len(own) AS n, h % 10 = 0 AND len(own) > 0 AS changed, h // 10 AS g
  FROM (SELECT *, {_CRC.format(text="CAST(doc_id AS VARCHAR)")} AS h FROM w)
), a AS (
  SELECT *, CASE WHEN changed THEN g % n END AS a, CASE WHEN changed THEN 1 + (n - g % n) // (3 + g % 8) END AS p
  FROM g
), t AS (
  SELECT doc_id, n, CASE WHEN changed THEN list_transform(range(0, n), lambda i:
    own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE own END AS ws FROM a
), x AS (
  SELECT doc_id, n, i, ws[i + 1] AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM t)
), same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word
    AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same)
  GROUP BY doc_id, q, k
), runs AS (
  SELECT doc_id, s AS start, e - s AS length, min(q) AS period FROM stretches
  WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS lost
  FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY doc_id
), by_doc AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS body,
    first(struct_pack(s := start, l := length, q := period) ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
  1000 * best.l // best.q AS exponent_milli, sha256(coalesce(body, '')) AS runs_sha256,
  sha256(CASE WHEN lost IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(
    list_filter(range(0, n), lambda i: NOT list_contains(lost, i)), lambda i: ws[i + 1]), ' ') END) AS collapsed_sha256
FROM t LEFT JOIN by_doc USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike,
    CAST(list_dot_product(a.c, r.c) AS BIGINT) AS score
  FROM (FROM v WHERE vec_id % 100 = 0) a JOIN v r ON a.vec_id <> r.vec_id
), positives AS (
  SELECT * FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""

SQL: dict[str, str] = {
    "op2_warc_archive": WARC_ARCHIVE,
    "op4_near_dedup": NEAR_DEDUP,
    "op5_secret_scan": SECRET_SCAN,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op11_source_mixing": SOURCE_MIXING,
    "op12_periodic_runs": PERIODIC_RUNS,
    "op13_hard_negatives": HARD_NEGATIVES,
}
