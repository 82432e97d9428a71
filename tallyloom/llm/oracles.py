"""DuckDB SQL of the operators that SQL can express, over the same tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM d, (SELECT DISTINCT m FROM bw) AS ms, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
hit AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, g)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + m)) AS t(j) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

LINE_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, j, ls[j] AS line, regexp_replace(translate(ls[j], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
      FROM d, unnest(range(1, len(ls) + 1)) AS t(j)),
many AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
judged AS (SELECT l.r, j, line, many.k IS NOT NULL AND l.doc_id IS DISTINCT FROM last AS gone FROM l LEFT JOIN many ON l.k = many.k),
out AS (SELECT r, count(*) AS n_lines, sum(gone::INT) AS n_dropped, string_agg(line, chr(10) ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN out USING (r)
"""

MIXING = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM sums),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lv AS (SELECT arg_min(level, cap / weight) AS level FROM c WHERE level * weight <= cap),
tg AS (SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM lv) * weight, cap)), 6) AS target FROM c),
q AS (SELECT doc_id, max(CASE WHEN quality >= 1 THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT s.doc_id, s.source, size, source_size, target,
             -ln((('0x' || substr(md5('9:' || coalesce(s.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
      FROM s LEFT JOIN q ON s.doc_id = q.doc_id JOIN tg ON s.source IS NOT DISTINCT FROM tg.source),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, (size * (epochs + (size > 0 AND ahead + size / 2.0 <= target - epochs * source_size)::INT))::BIGINT AS taken FROM a
"""

SUBSTRING_BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM d, unnest(range(0, n - 199)) AS t(i)),
hit AS (SELECT r, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
marks AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS fresh FROM hit),
numbered AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM marks),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, run),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM runs),
o AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN o USING (r)
"""

SUBSTRING_WORDS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
hit AS (SELECT r, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
marks AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 35, true) AS fresh FROM hit),
numbered AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM marks),
runs AS (SELECT r, min(i) AS a, max(i) + 35 AS b FROM numbered GROUP BY r, run),
o AS (SELECT r, sum(b - a) AS gone, list_concat(list(a ORDER BY a), [2147483647]) AS a, list_concat([1], list(b ORDER BY a)) AS b FROM runs GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE flatten([w[b[k]:a[k] - 1] FOR k IN range(1, len(a) + 1)]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN o USING (r)
"""


def merkle(digits: int) -> str:
    """Roots and likenesses from whole hashes; the fingerprints write so many digits of those below the root."""
    leaves = "[[md5(p) FOR p IN regexp_extract_all(s, '[^.!?]{0,80}[.!?]+|[^.!?]{1,80}')] FOR s IN string_split(TEXT, chr(10))]"
    tree = lambda x, n: f"array_to_string([left(md5(array_to_string(s, '.')), {n}) || '=' || array_to_string([left(p, {n}) FOR p IN s], '.') FOR s IN {x}], ';')"
    flat = lambda x: f"list_distinct(flatten([CASE WHEN len(s) = 0 THEN [''] ELSE s END FOR s IN {x}]))"
    near = lambda y: f"CASE WHEN a = {y} THEN 1.0::DOUBLE ELSE len(list_intersect({flat('a')}, {flat(y)}))::DOUBLE / greatest(len({flat('a')}), len({flat(y)})) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) AS edited FROM n),
t AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {leaves.replace("TEXT", "text")} AS a, {leaves.replace("TEXT", "edited")} AS b, {leaves.replace("TEXT", "nxt")} AS c FROM e)
SELECT doc_id, n_chars, edited_sha256, md5({tree("a", 32)}) || '|' || {tree("a", digits)} AS fingerprint, md5({tree("b", 32)}) || '|' || {tree("b", digits)} AS edited_fingerprint,
  {near("b")} AS near_edited, {near("c")} AS near_next, coalesce(len(w), 0)::BIGINT AS n_changed, w[1]::BIGINT AS first_changed, w[-1]::BIGINT AS last_changed
FROM (SELECT *, [i - 1 FOR i IN range(1, greatest(len(a), len(b)) + 1) IF a[i] IS DISTINCT FROM b[i]] AS w FROM t)
"""


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
_IP = "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+"
_CARD = "[0-9](?:[\\x20-]?[0-9])+"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_IBAN = "\\b[A-Z]{2}[0-9]{2}(?:[\\x20-]?[A-Z0-9]){11,30}"
_SSN = "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b"


def _kind(kind: str, pattern: str, valid: str, score: str) -> str:
    return f"""{kind} AS (SELECT r, '{kind}' AS kind, i, m[i] AS v, (list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::INT AS s,
  lower(right(g[i], 40) || ' ' || left(g[i + 1], 40)) AS near
  FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d), unnest(range(1, len(m) + 1)) AS t(i)),
{kind}_ok AS (SELECT r, kind, s, s + length(v) AS e, v, {score} AS score FROM {kind} WHERE {valid})"""


def _score(kind: str) -> str:
    from .pii import LOWER as lower
    from .pii import RAISE, SCORES

    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {SCORES[kind]}::DOUBLE + CASE WHEN regexp_matches(near, '\\b(?:{RAISE[kind]})') THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(near, '\\b(?:{lower[kind]})') THEN 0.3::DOUBLE ELSE 0 END)), 3)"


_D = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"length({_D}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length({_D}) - j) % 2 = 0 THEN {_D}[j]::INT ELSE {_D}[j]::INT * 2 - CASE WHEN {_D}[j]::INT > 4 THEN 9 ELSE 0 END END FOR j IN range(1, length({_D}) + 1)]) % 10 = 0"
_I = "regexp_replace(v, '[^A-Z0-9]', '', 'g')"
_MOD97 = f"list_reduce([CASE WHEN unicode(c) >= 65 THEN unicode(c) - 55 ELSE unicode(c) - 48 END FOR c IN string_split({_I}[5:] || {_I}[1:4], '')], lambda a, x: (a * CASE WHEN x >= 10 THEN 100 ELSE 10 END + x) % 97, 0) = 1"
PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_kind("email", _EMAIL, "true", _score("email"))},
{_kind("ip", _IP, "list_bool_and([x::HUGEINT <= 255 FOR x IN string_split(v, '.')])", _score("ip"))},
{_kind("card", _CARD, _LUHN, _score("card"))},
{_kind("phone", _PHONE, f"length({_D}) BETWEEN 9 AND 15", _score("phone"))},
{_kind("iban", _IBAN, _MOD97, _score("iban"))},
{_kind("ssn", _SSN, "NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')", _score("ssn"))},
s AS (SELECT 1 AS k, * FROM email_ok UNION ALL SELECT 2, * FROM ip_ok UNION ALL SELECT 3, * FROM card_ok UNION ALL SELECT 4, * FROM phone_ok UNION ALL SELECT 5, * FROM iban_ok WHERE score >= 0.5 UNION ALL SELECT 6, * FROM ssn_ok WHERE score >= 0.5),
o AS (SELECT r, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, count(*) FILTER (WHERE k = 3) AS n3, count(*) FILTER (WHERE k = 4) AS n4, count(*) FILTER (WHERE k = 5) AS n5, count(*) FILTER (WHERE k = 6) AS n6, string_agg(printf('%.1f', score), ',' ORDER BY k, s) AS scores,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE k < 5) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, max(score) AS top_score FROM s GROUP BY r)
SELECT doc_id, coalesce(n1, 0)::BIGINT AS n_email, coalesce(n2, 0)::BIGINT AS n_ip, coalesce(n3, 0)::BIGINT AS n_card, coalesce(n4, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n5, 0)::BIGINT AS n_iban, coalesce(n6, 0)::BIGINT AS n_ssn, coalesce(scores, '') AS scores, top_score
FROM d LEFT JOIN o USING (r)
"""


# crc32 bit by bit; the grid: a run of period p covers a multiple of greatest(24, 3p) - p with eight equal words on one side
PERIODIC = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v FROM documents),
c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], [unicode(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
        lambda s, x: list_reduce(list_concat([xor(s, x)], [0::BIGINT FOR k IN range(8)]), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) AS h FROM t),
q AS (SELECT r, (h // 10) % len(v) AS a, 1 + (len(v) - (h // 10) % len(v)) // (3 + (h // 10) % 8) AS p FROM c WHERE h % 10 = 0 AND len(v) > 0),
o AS (SELECT r, unnest(v) AS w, unnest(range(0, len(v))) AS i, len(v) AS n FROM t),
d AS (SELECT o.r, o.i, o.n, coalesce(v.w, o.w) AS w FROM o LEFT JOIN q ON o.r = q.r LEFT JOIN o AS v ON v.r = q.r AND o.i >= q.a AND v.i = q.a + (o.i - q.a) % q.p),
w AS (SELECT *, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS behind FROM d),
g AS (SELECT r, p, k * (greatest(24, 3 * p) - p) AS i FROM (SELECT r, len(v) AS n FROM t WHERE len(v) >= 24), unnest(range(1, n // 3 + 1)) AS u(p), unnest(range(0, (n - p - 1) // (greatest(24, 3 * p) - p) + 1)) AS x(k)),
m AS (SELECT DISTINCT r, p, a.n FROM g JOIN w AS a USING (r, i) JOIN w AS b USING (r) WHERE b.i = g.i + p AND a.w = b.w AND (a.ahead = b.ahead OR a.behind = b.behind)),
e AS (SELECT r, p, -1 AS i FROM m UNION ALL SELECT r, p, n - p FROM m UNION ALL SELECT r, p, a.i FROM m JOIN d AS a USING (r) JOIN d AS b USING (r) WHERE b.i = a.i + p AND a.w <> b.w),
x AS (SELECT r, p, i + 1 AS s, lead(i) OVER (PARTITION BY r, p ORDER BY i) + p AS z FROM e),
runs AS (SELECT r, s, z - s AS n, min(p) AS p FROM x WHERE z - s >= greatest(24, 3 * p) GROUP BY r, s, z),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS listed FROM runs GROUP BY r),
best AS (SELECT r, s, n, p FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n::DOUBLE / p DESC, s, p) = 1),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(s + p, s + n)) AS t(i)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM d ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, n::BIGINT AS length, p::BIGINT AS period, (1000 * n // p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_concat([true], [x IS NOT NULL AND isfinite(x) FOR x IN embedding]))),
s AS (SELECT a.r AS a, a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum([a.v[i] * b.v[i] FOR i IN range(1, least(len(a.v), len(b.v)) + 1)])::BIGINT AS score
      FROM e AS a JOIN e AS b ON a.id % 50 = 0 AND a.id <> b.id),
pos AS (SELECT a, anchor_id, id, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
neg AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM pos AS p JOIN s ON p.a = s.a AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg
"""
