"""DuckDB SQL for those queries of the training-data operators that SQL can express."""

from __future__ import annotations

from sieveloom.llm import license_scan, mixing, warc
from sieveloom.llm.license_texts import TEXTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- licences --------------------------------------------------------------------


def _canonical(column: str) -> str:
    out = f"regexp_replace(lower({column}), {quoted(license_scan.COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"' ' || trim(regexp_replace({out}, {quoted(license_scan.NOT_WORD)}, '  ', 'g')) || ' '"
    for pattern, to in license_scan.SPELLINGS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return out


_KNOWN = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(TEXTS.items()))
LICENSES = f"""
WITH known AS (SELECT min(license_id) AS license_id, digest FROM (SELECT license_id, sha256({_canonical('text')}) AS digest FROM (VALUES {_KNOWN}) t(license_id, text)) GROUP BY digest),
found AS (SELECT doc_id, sha256({_canonical('text')}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM found LEFT JOIN known USING (digest)
"""


# ---- WARC ------------------------------------------------------------------------


def _replace(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {to}, 'g')"


def _unescape(x: str) -> str:
    named = "MAP {'amp': '&', " + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in warc.ENTITIES.items()) + "}"
    name = "string_split(p, ';')[1]"
    code = f"CASE WHEN NOT regexp_matches({name}, {quoted(warc.NUMBERED)}) THEN NULL WHEN lower({name}[2:2]) = 'x' THEN try_cast('0x' || {name}[3:] AS BIGINT) ELSE try_cast({name}[2:] AS BIGINT) END"
    rest = f"substring(p, length({name}) + 2)"
    one = (
        f"CASE WHEN NOT contains(p, ';') THEN '&' || p WHEN {named}[{name}] IS NOT NULL THEN {named}[{name}] || {rest} "
        f"WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr(CAST(({code}) AS INTEGER)) || {rest} ELSE '&' || p END"
    )
    return f"string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: {one}), '')"


def _plain(x: str) -> str:
    out = _replace(x, warc.HIDDEN, "' '")
    out = _replace(out, r"[\n\r]+", "' '")
    out = _replace(out, warc.BREAKS, "chr(10)")
    return _replace(out, warc.TAGS, "''")


def _squeeze(x: str) -> str:
    out = _replace(x, warc.SPACES, "' '")
    out = _replace(out, r" ?\n[ \n]*", "chr(10)")
    return f"trim({out}, ' ' || chr(10))"


def _id(parts: str) -> str:
    h = f"md5({parts})"
    return f"'<urn:uuid:' || substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-' || substring({h}, 13, 4) || '-' || substring({h}, 17, 4) || '-' || substring({h}, 21, 12) || '>'"


_CRLF = "chr(13) || chr(10)"
_S = warc._S
_TITLE = f"regexp_extract(html, {quoted(f'(?is)<title(?:{_S}[^>]*)?>(.*?)</title')}, 1)"
_LANG = "regexp_extract(html, " + quoted(r"(?i)<html[^>]*[ \t\n\f\r]lang[ ]*=[ ]*[\"']?([A-Za-z0-9-]+)") + ", 1)"
_LINKS = "regexp_extract_all(html, " + quoted(r"(?i)<a[ \t\n\f\r][^>]*href[ ]*=[ ]*[\"']([^\"'<>\n\r]*)[\"']") + ", 1)"
WARC = f"""
WITH pages_ AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
base AS (SELECT page_id, {_id("coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '') || '|response'")} AS refers_to, url AS target_uri, {quoted(warc.EPOCH)} AS date,
  'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(html) AS http_headers, html, 'sha256:' || sha256(html) AS source_digest FROM pages_),
bare AS (SELECT *, {_plain('html')} AS t0, {_plain(_TITLE)} AS t1 FROM base),
open_ AS (SELECT *, {_unescape('t0')} AS u0, {_unescape('t1')} AS u1 FROM bare),
texts AS (SELECT *, {_squeeze('u0')} AS body, regexp_replace({_squeeze('u1')}, '[\\r\\n]+', ' ', 'g') AS title FROM open_),
blocks AS (
  SELECT page_id, refers_to, target_uri, date, source_digest, 'conversion' AS warc_type, 'text/plain; charset=utf-8' AS content_type, body AS block FROM texts
  UNION ALL
  SELECT page_id, refers_to, target_uri, date, source_digest, 'metadata', 'application/warc-fields', array_to_string(
    ['title: ' || title, 'language: ' || {_LANG}, 'http-status: 200', 'source-digest: ' || source_digest]
    || list_transform(string_split(http_headers, {_CRLF}), lambda x: 'source-header: ' || x) || list_transform({_LINKS}, lambda x: 'outlink: ' || x), {_CRLF}) || {_CRLF} FROM texts),
sized AS (SELECT *, {_id("refers_to || '|' || warc_type")} AS record_id, 'sha256:' || sha256(block) AS digest, strlen(block)::BIGINT AS length FROM blocks)
SELECT page_id, warc_type, record_id, refers_to, target_uri, date, content_type, source_digest, digest, length,
  'WARC/1.1' || {_CRLF} || 'WARC-Type: ' || warc_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Date: ' || date || {_CRLF}
  || coalesce('WARC-Target-URI: ' || regexp_replace(target_uri, '[\\r\\n]', '', 'g') || {_CRLF}, '') || 'WARC-Refers-To: ' || refers_to || {_CRLF}
  || 'WARC-Source-Payload-Digest: ' || source_digest || {_CRLF} || 'WARC-Block-Digest: ' || digest || {_CRLF}
  || 'Content-Type: ' || content_type || {_CRLF} || 'Content-Length: ' || length || {_CRLF} AS headers, block
FROM sized
"""


# ---- vectors ---------------------------------------------------------------------

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"
TOP_K = f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 256)) AS q FROM embeddings WHERE {_FINITE}),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5
"""

EMBED_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN comp USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


# ---- mixing ----------------------------------------------------------------------


def _seeded(number: str, salt: str) -> str:
    return f"('0x' || substring(md5({quoted(f'{mixing.SEED}/{salt}/')} || {number}), 1, 8))::BIGINT"


_B, _P, _C = "(SELECT b FROM blk)", mixing.PERCENT, mixing.CAP
_W = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
MIXING = f"""
WITH base AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {quoted(mixing.WORD)})), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
blk AS MATERIALIZED (SELECT greatest(1, least({mixing.BLOCK}, sum(source_size)::BIGINT // {mixing.BLOCKS})) AS b FROM per),
w AS (SELECT *, {_W}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1]::BIGINT AS weight FROM per),
filled AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
  (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS above
  FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)),
opened AS (SELECT *, total * {_P} - below * {100 * _C} AS spare, (total * {_P} - below * {100 * _C}) * weight <= source_size * {100 * _C} * above AS open FROM filled),
level AS (SELECT spare, above FROM opened WHERE open ORDER BY source_size / weight, source IS NULL, source LIMIT 1),
goal AS (SELECT o.source, n_docs, source_size, total, CASE WHEN open THEN (l.spare * weight)::DOUBLE / (l.above * 100) ELSE (source_size * {_C})::DOUBLE END AS target FROM opened o LEFT JOIN level l ON true),
seats AS (SELECT *, (total * {_P} + 50 * {_B}) // (100 * {_B}) AS seats FROM goal),
offers AS (SELECT source, target, seats, unnest(range(0, (ceil(target / {_B}) + 100)::BIGINT)) AS i FROM seats WHERE target > 0),
won AS (SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, source IS NULL, source, i) AS rank FROM offers) WHERE rank <= seats GROUP BY source),
quotas AS (SELECT s.*, coalesce(quota, 0) AS quota, (n_docs + {mixing.SHARD_DOCS - 1}) // {mixing.SHARD_DOCS} AS shards FROM seats s LEFT JOIN won ON s.source IS NOT DISTINCT FROM won.source),
placed AS (SELECT b.*, source_size, target, quota, {_seeded("coalesce(doc_id::VARCHAR, '')", "order")} AS o, {_seeded("coalesce(doc_id::VARCHAR, '')", "shard")} % shards AS shard
  FROM base b JOIN quotas q ON b.source IS NOT DISTINCT FROM q.source),
lined AS MATERIALIZED (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM placed),
sharded AS (SELECT source, shard, sum(size)::BIGINT AS words, any_value(quota) AS seats FROM lined GROUP BY source, shard),
soffers AS (SELECT *, unnest(range(0, (ceil(seats::DOUBLE * words / greatest(sum(words) OVER (PARTITION BY source), 1)) + 100)::BIGINT)) AS i FROM sharded),
swon AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY words / (2 * i + 1) DESC, shard, i) AS rank FROM soffers WHERE words > 0) WHERE rank <= seats GROUP BY source, shard),
cut AS (SELECT s.source, s.shard, words, (words + {_B} - 1) // {_B} AS blocks, coalesce(quota, 0) AS quota FROM sharded s LEFT JOIN swon w ON s.source IS NOT DISTINCT FROM w.source AND s.shard = w.shard),
cut2 AS (SELECT *, CASE WHEN blocks > 0 THEN least(quota, blocks * {_C}) // blocks ELSE 0 END AS whole,
  CASE WHEN blocks > 0 THEN least(quota, blocks * {_C}) % blocks ELSE 0 END AS more,
  CASE WHEN blocks > 0 THEN {_seeded("coalesce(source, '') || '/' || shard", "start")} % blocks ELSE 0 END AS first FROM cut),
spans AS (SELECT source, shard, whole, first * {_B} AS lo, least((first + more) * {_B}, words) AS hi, least(greatest(first + more - blocks, 0) * {_B}, words) AS wrap FROM cut2)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(wrap - (stop - size), size))
  + greatest(0, greatest(0, least(hi - (stop - size), size)) - greatest(0, least(lo - (stop - size), size))))::BIGINT AS taken
FROM lined l JOIN spans s ON l.source IS NOT DISTINCT FROM s.source AND l.shard = s.shard
"""


# ---- URLs ------------------------------------------------------------------------


def url_filter(rules: list[tuple[str, str, str]], default: str) -> str:
    values = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in rules)
    return f"""
WITH rules(verdict, h, p) AS (VALUES {values}),
parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
keyed AS (SELECT row_number() OVER () AS r, * FROM parsed),
best AS (SELECT r, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS verdict
  FROM keyed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, {quoted(default)}) AS verdict FROM keyed LEFT JOIN best USING (r)
"""
