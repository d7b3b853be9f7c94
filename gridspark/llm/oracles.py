"""DuckDB SQL for those numbered queries that SQL can express."""

from .licenses import TEMPLATES, WORDS, template_words

OP1 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN comp USING (doc_id)
"""


_PRINT = """(SELECT t, sha256(array_to_string(list_transform(string_split(rtrim(array_to_string(list_transform(ps, lambda p: p.d || p.m), ''), ';,'), ';'), lambda s: sha256(rtrim(s, ','))), ','))
    || '|' || rtrim(array_to_string(list_transform(ps, lambda p: p.d[1:8] || '.' || p.l || p.m), ''), ';,') AS f
  FROM (SELECT t, list_transform(string_split(t, chr(10)), lambda p: {
      'd': sha256(array_to_string(list_transform(regexp_extract_all(p, '[^.]{1,160}\\.?|\\.'), lambda x: sha256(x)), '')),
      'm': CASE WHEN sha256(array_to_string(list_transform(regexp_extract_all(p, '[^.]{1,160}\\.?|\\.'), lambda x: sha256(x)), ''))[1:1] IN ('0', '1') THEN ';' ELSE ',' END,
      'l': array_to_string(list_transform(regexp_extract_all(p, '[^.]{1,160}\\.?|\\.'), lambda x: sha256(x)[1:8]), '')}) AS ps
    FROM (SELECT DISTINCT t FROM %s)))"""

_LEAVES = "list_distinct(flatten(list_transform(string_split_regex(%s[66:], '[,;]'), lambda p: regexp_extract_all(p[10:], '[0-9a-f]{8}'))))"


def _likeness(a: str, b: str) -> str:
    x, y = _LEAVES % a, _LEAVES % b
    return f"CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE round(len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))), 6) END"


OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), n AS (
  SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC, t), first_value(t) OVER (ORDER BY doc_id DESC, t)) AS nt FROM d
), e AS (SELECT doc_id, t, nt, t[:length(t) - length(t) // 2] || CASE WHEN length(t) < 2 THEN '' ELSE nt[:length(t) // 2] END AS et FROM n
), alltexts AS (SELECT t FROM e UNION SELECT et FROM e
), prints AS {_PRINT % 'alltexts'}
SELECT doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.et) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  {_likeness('a.f', 'b.f')} AS near_edited, {_likeness('a.f', 'c.f')} AS near_next
FROM e JOIN prints a ON a.t = e.t JOIN prints b ON b.t = e.et JOIN prints c ON c.t = e.nt
"""

OP7 = """
WITH u AS (
  SELECT doc_id, text, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS i
  FROM (SELECT doc_id, text, replace(replace(replace(text, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)) AS t FROM documents WHERE text IS NOT NULL)
), v AS (
  SELECT doc_id, i, raw, text, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS body,
    sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) - 1 AS pos FROM u
), w AS (
  SELECT doc_id, i, raw, body, pos, CASE WHEN i = 1 THEN ' ' ELSE text[pos:pos] END AS sep, len(string_split(body, ' ')) AS words,
    body <> '' AND row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS again FROM v
), r AS (
  SELECT *, sum((body <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) - sum(again::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w
), g AS (
  SELECT *, again AND sum(words) FILTER (again) OVER (PARTITION BY doc_id, run) >= 30 AS gone FROM r
)
SELECT doc_id, coalesce(string_agg(sep || raw, '' ORDER BY i) FILTER (NOT gone), ' ')[2:] AS text, count(*) AS n_units,
  count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(pos::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (gone), '') AS removed_starts,
  coalesce(string_agg((pos + length(raw))::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (gone), '') AS removed_ends,
  coalesce(string_agg(pos::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (again AND NOT gone), '') AS spared_starts,
  coalesce(string_agg((pos + length(raw))::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (again AND NOT gone), '') AS spared_ends
FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0, '', '', '', '' FROM documents WHERE text IS NULL AND doc_id IS NOT NULL
"""

OP4 = """
WITH RECURSIVE r AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t FROM documents
), g AS (SELECT t, sum(size) AS size, min(doc_id) AS first FROM r GROUP BY t
), l AS (SELECT list(size ORDER BY first) AS sizes, sum(size) AS total, max(size) AS most FROM g
), fill AS (
  SELECT greatest((total + 7) // 8, most)::BIGINT - 1 AS low, total::BIGINT AS high FROM l
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (
    SELECT low, high, mid, list_reduce(list_prepend({'n': 1::BIGINT, 'f': 0::BIGINT}, list_transform(sizes, lambda s: {'n': 0::BIGINT, 'f': s::BIGINT})),
      lambda a, b: CASE WHEN a.f + b.f > mid THEN {'n': a.n + 1, 'f': b.f} ELSE {'n': a.n, 'f': a.f + b.f} END).n <= 8 AS ok
    FROM (SELECT low, high, (low + high) // 2 AS mid FROM fill WHERE high - low > 1), l)
), cap AS (SELECT min(high) AS c FROM fill
), ends AS (SELECT t, sum(size) OVER (ORDER BY first)::BIGINT AS e FROM g
), cuts AS (
  SELECT 0 AS k, 0::BIGINT AS pos UNION ALL
  SELECT k + 1, (SELECT max(e) FROM ends WHERE e <= pos + (SELECT c FROM cap)) FROM cuts WHERE k < 7
), tab AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS tab
), bytes AS (
  SELECT t, list_transform(range(0, strlen(t)), lambda i: ('0x' || hex(t)[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM (SELECT DISTINCT t FROM r)
), crcs AS (
  SELECT t, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295::BIGINT) AS text_crc32 FROM bytes, tab
), placed AS (
  SELECT doc_id, r.size, r.t, text_crc32, (SELECT count(DISTINCT pos) FROM cuts WHERE k > 0 AND pos < e AND pos < (SELECT total FROM l)) AS shard
  FROM r JOIN ends ON ends.t = r.t JOIN crcs ON crcs.t = r.t
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed
"""

_T = {k: template_words(t) for k, t in TEMPLATES.items() if len(template_words(t)) >= WORDS}
_ROWS = ", ".join("('" + k + "', '" + " ".join(w) + "')" for k, w in _T.items())
OP10 = f"""
WITH ts AS (
  SELECT license, len(w) AS m, greatest(1, len(w) // 4) AS step, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM (SELECT license, string_split(ws, ' ') AS w FROM (VALUES {_ROWS}) v(license, ws))
), d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), sh AS (
  SELECT doc_id, r, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM d WHERE len(w) >= 5
), hit AS (
  SELECT doc_id, r, license, m, step, len(s) AS k, p, sh.g FROM sh JOIN (SELECT *, unnest(s) AS g FROM ts) ts ON sh.g = ts.g
), held AS (
  SELECT doc_id, r, license, k, count(DISTINCT g) AS n, min(p) AS p FROM hit GROUP BY ALL
), win AS (
  SELECT r, license, k, g, unnest(range(greatest(0, ((p - (m + step - 6) + step - 1) // step)) * step, p + 1, step)) AS start, p, m, step FROM hit
), wins AS (
  SELECT r, license, start, count(DISTINCT g) / max(k) AS c FROM win WHERE p >= start AND p <= start + m + step - 6 GROUP BY ALL
), w AS (
  SELECT r, license, count(*) AS n_windows, min(start) AS first_window FROM wins WHERE c >= 0.75 GROUP BY ALL
)
SELECT doc_id, license, round(max(n / k), 6) AS containment, max(n) AS n_shingles, min(p)::BIGINT AS first_word,
  coalesce(sum(n_windows), 0)::BIGINT AS n_windows, min(first_window)::BIGINT AS first_window
FROM held LEFT JOIN w USING (r, license) WHERE n / k >= 0.75 GROUP BY doc_id, license
"""

OP11 = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS tab
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || r AS k, r, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL
), sums AS (
  SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(k)), lambda i: ('0x' || hex(k)[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295::BIGINT) AS h FROM runs, tab
), spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM sums
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM pairs GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON a = word
), way AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN forms f ON f.word = way.root WHERE f.form IS NOT NULL
)
SELECT word, form, arg_max(root, steps) AS root, n, n_near, form_n FROM forms JOIN way USING (word) GROUP BY ALL
"""

_URL = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)'"
OP12 = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS t, translate(regexp_extract(url, {_URL}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, {_URL}, 2) AS rest FROM pages
), k AS (
  SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest,
    CASE WHEN regexp_matches(url, {_URL}) THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END ELSE coalesce(url, '') END AS url_key,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y%m%d%H%M%S') AS time FROM p
), f AS (SELECT payload_digest, min(page_id) AS first FROM k WHERE payload_bytes >= 100 GROUP BY 1
), r AS (SELECT k.*, CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to FROM k LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url_key, time,
  row_number() OVER (ORDER BY url_key, time, page_id NULLS FIRST) AS position, row_number() OVER (PARTITION BY url_key ORDER BY time, page_id NULLS FIRST) AS capture_no
FROM r
"""

_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
OP13 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_UNIT}') AS us, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u
), p AS (
  SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": OP1,
    "op2_merkle_fingerprints": OP2,
    "op4_minimax_shards": OP4,
    "op7_line_dedup": OP7,
    "op10_license_scan": OP10,
    "op11_spelling_groups": OP11,
    "op12_warc_history": OP12,
    "op13_fill_in_middle": OP13,
}
