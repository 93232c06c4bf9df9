"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .merkle import LEAF

_SPACE = "[^ \\t\\n\\x0b\\f\\r]+"
_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD9 = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

NGRAM_JOIN = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10ffff}]+') AS ws FROM documents),
    g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gs FROM w WHERE len(ws) > 0),
    s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM g),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2, 3, 4),
    links AS (SELECT a, b, c = na AND c = nb AS same FROM pairs WHERE c * 1.8 >= 0.8 * (na + nb) - 1e-9),
    texts AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(l.b), d.doc_id)) AS text_id FROM documents d LEFT JOIN links l ON l.a = d.doc_id AND l.same GROUP BY d.doc_id),
    reach AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node),
    classes AS (SELECT node AS doc_id, min(label) AS class_id FROM reach GROUP BY node),
    counts AS (SELECT l.a AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN NOT l.same THEN t.text_id END) AS n_texts FROM links l JOIN texts t ON t.doc_id = l.b GROUP BY l.a)
    SELECT t.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links, t.text_id, coalesce(n.n_texts, 0) AS n_texts FROM texts t JOIN classes c ON c.doc_id = t.doc_id LEFT JOIN counts n ON n.doc_id = t.doc_id"""

WARC = """WITH bare AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
    parts AS (SELECT page_id, html, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://(?:www\\.)?([^/?]*)', 1)), ':(80|443)$', '') AS host, regexp_extract(u, '^[A-Za-z]+://[^/?]*(.*)$', 1) AS rest FROM bare),
    asked AS (SELECT *, regexp_replace(regexp_replace(rest, '\\?.*$', ''), '/+$', '') AS path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '\\?(.*)$', 1), '(^|&)utm_[a-z]+=[^&]*', '', 'g'), '(^|&)ref=[^&]*', '', 'g'), '(^|&)fbclid=[^&]*', '', 'g'), '(^|&)gclid=[^&]*', '', 'g'), '^&', '') AS q FROM parts),
    p AS (SELECT page_id, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url, md5(coalesce(html, '')) AS digest, CAST(length(coalesce(html, '')) AS VARCHAR) AS n FROM asked),
    r AS (SELECT page_id, url, digest, n, day, page_id * 5 + day AS record_id, day * 86400 + page_id % 86400 AS ts, day = 1 OR (day = 3 AND page_id % 4 = 0) AS is_full,
        '"' || substr(digest, 1, 12) || '"' AS tag, '"v2-' || substr(digest, 1, 8) || '"' AS second, 'day-1-' || CAST(page_id % 86400 AS VARCHAR) AS modified FROM p, (SELECT unnest([0, 1, 2, 3, 4]) AS day) WHERE day > 0 OR page_id % 7 = 0),
    v AS (SELECT *, CASE WHEN is_full AND day = 3 THEN second WHEN is_full THEN tag WHEN day = 2 AND page_id % 3 = 0 THEN 'W/' || tag WHEN day <> 3 THEN tag END AS etag, CASE WHEN is_full OR day = 3 THEN modified END AS lm,
        CASE WHEN is_full THEN 'max-age=60' WHEN day = 3 THEN 'max-age=120' END AS cc, CASE WHEN day > 0 THEN 'day-' || CAST(day AS VARCHAR) END AS dt, CASE WHEN day = 4 THEN 'HIT' END AS xc, CASE WHEN day = 3 AND is_full THEN md5(digest || 'v2') ELSE digest END AS body FROM r),
    f AS (SELECT *, CASE WHEN is_full THEN {'id': record_id, 'etag': etag, 'lm': lm, 'cc': cc, 'dt': dt, 'n': n, 'body': body} END AS mine FROM v),
    b AS (SELECT *, last_value(mine IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, is_full, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS was FROM f),
    s AS (SELECT *, CASE WHEN was IS NULL THEN 'orphan' WHEN coalesce(etag, lm) IS NULL THEN 'unvalidated' WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(was.etag, '^W/', '') ELSE lm = was.lm END THEN 'resolved' ELSE 'mismatch' END AS status FROM b WHERE NOT is_full)
    SELECT record_id, url AS canonical_url, status, CASE WHEN status = 'resolved' THEN was.id END AS response_id, CASE WHEN status = 'resolved' THEN was.body END AS payload_digest,
    CASE WHEN status = 'resolved' THEN 'cache-control: ' || coalesce(cc, was.cc) || chr(10) || 'content-length: ' || was.n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || coalesce(dt, was.dt) || chr(10) || 'etag: ' || coalesce(etag, was.etag) || chr(10) || 'last-modified: ' || coalesce(lm, was.lm) || CASE WHEN xc IS NOT NULL THEN chr(10) || 'x-cache: ' || xc ELSE '' END END AS merged_headers FROM s"""


def _tree(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.!?]{{1,{LEAF}}}[.!?]*|[.!?]+', 0), lambda x: sha256(x))))"


def _paragraphs(tree: str) -> str:
    return f"list_transform({tree}, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, ''))))"


def _sections(tree: str) -> str:
    return f"list_transform({_paragraphs(tree)}, lambda s: sha256(array_to_string(s, '')))"


def _print(tree: str) -> str:
    root = f"sha256(array_to_string({_sections(tree)}, ''))"
    leaves = f"array_to_string(list_transform({tree}, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda x: substr(x, 1, 8)), '.')), ',')), ';')"
    paragraphs = f"array_to_string(list_transform({_paragraphs(tree)}, lambda s: array_to_string(list_transform(s, lambda p: substr(p, 1, 16)), '.')), ';')"
    sections = f"array_to_string(list_transform({_sections(tree)}, lambda s: substr(s, 1, 16)), '.')"
    return f"{root} || ':' || {leaves} || ':' || {paragraphs} || ':' || {sections}"


def _like(a: str, b: str) -> str:
    leaves = lambda f: f"list_distinct(list_filter(string_split_regex(split_part({f}, ':', 2), '[.,;]'), lambda x: x <> ''))"
    both = f"(len({leaves(a)}) + len({leaves(b)}))"
    return f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN 1.0::DOUBLE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({leaves(a)}, {leaves(b)})) / {both} END"


FINGERPRINTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nt FROM d),
    e AS (SELECT doc_id, t, nt, substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) AS et FROM n),
    k AS (SELECT doc_id, t, et, {_tree('t')} AS a, {_tree('et')} AS b, {_tree('nt')} AS c FROM e),
    f AS (SELECT doc_id, t, et, {_print('a')} AS fp, {_print('b')} AS ep, {_print('c')} AS np FROM k),
    bs AS (SELECT doc_id, i - 1 AS s, {_sections('b')}[i] AS sd, {_paragraphs('b')}[i] AS pd FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM k)),
    bp AS (SELECT doc_id, s, sd, i - 1 AS p, pd[i] AS d FROM (SELECT doc_id, s, sd, pd, unnest(range(1, len(pd) + 1)) AS i FROM bs)),
    sa AS (SELECT DISTINCT doc_id, unnest({_sections('a')}) AS d FROM k),
    pa AS (SELECT DISTINCT doc_id, unnest(flatten({_paragraphs('a')})) AS d FROM k),
    x AS (SELECT doc_id, string_agg(CAST(s AS VARCHAR) || '.' || CAST(p AS VARCHAR), ',' ORDER BY s, p) AS edits FROM bp
        WHERE NOT EXISTS (SELECT 1 FROM sa WHERE sa.doc_id = bp.doc_id AND sa.d = bp.sd) AND NOT EXISTS (SELECT 1 FROM pa WHERE pa.doc_id = bp.doc_id AND pa.d = bp.d) GROUP BY doc_id)
    SELECT f.doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256, fp AS fingerprint, ep AS edited_fingerprint, coalesce(x.edits, '') AS edits, {_like('fp', 'ep')} AS near_edited, {_like('fp', 'np')} AS near_next FROM f LEFT JOIN x ON x.doc_id = f.doc_id"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS ws FROM documents),
    v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM v) WHERE n > 1),
    x AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r) GROUP BY doc_id),
    p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w WHERE len(ws) > 0),
    g AS (SELECT DISTINCT doc_id, unnest(gone) AS j FROM x),
    k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.j) AS kept, count(*) AS n FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.j = p.j WHERE g.j IS NULL GROUP BY p.doc_id)
    SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

DECONTAMINATION = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '{_WORD9}') AS ws FROM benchmark),
    p AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[j:j + least(13, len(ws)) - 1], ' ') AS h FROM (SELECT item, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT n FROM p),
    d AS (SELECT doc_id, regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '{_WORD9}') AS ws FROM documents),
    v AS (SELECT doc_id, n, j, array_to_string(ws[j:j + n - 1], ' ') AS h FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS j FROM d, sizes WHERE len(ws) >= n)),
    o AS (SELECT v.doc_id, v.j, v.n, p.item FROM v JOIN p ON p.n = v.n AND p.h = v.h),
    c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS k FROM o) GROUP BY doc_id),
    m AS (SELECT doc_id, list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)) AS items FROM o GROUP BY doc_id)
    SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

LINES = """WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines FROM documents),
    t AS (SELECT host, count(*) AS n FROM d GROUP BY host),
    l AS (SELECT doc_id, host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM d),
    c AS (SELECT host, line, count(*) AS k FROM l WHERE line <> '' GROUP BY host, line),
    b AS (SELECT c.host, list(line) AS bad FROM c JOIN t ON t.host = c.host WHERE k >= 5 AND k > 0.1 * n GROUP BY c.host),
    k AS (SELECT doc_id, lines, list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept FROM d LEFT JOIN b ON b.host = d.host)
    SELECT doc_id, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k"""

#: Starts of one text with equal first five words, on one diagonal, make up the maximal pairs.
PERIODIC = r"""
with h as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295::bigint), 4294967295) as h
  from documents
), a as (select doc_id, w, h, len(w) as n, (h // 10) % greatest(len(w), 1) as a from h),
p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from a),
t as materialized (select doc_id, n, case when h % 10 = 0 and n > 0 then list_concat(w[1:a], list_transform(range(a, n), lambda i: w[1 + a + (i - a) % p])) else w end as w from p),
e as materialized (select doc_id, n, unnest(range(n)) as i, unnest(w) as word from t),
f as materialized (select doc_id, n, i, word, hash(word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) as five from e window o as (partition by doc_id order by i)),
m as (select x.doc_id, x.i, y.i - x.i as q from f x join f y on x.doc_id = y.doc_id and x.five = y.five and y.i between x.i + 1 and x.i + x.n // 4 where x.i + 5 <= x.n and y.i + 5 <= x.n),
s as (select *, i - row_number() over (partition by doc_id, q order by i) as island from m),
l as (select doc_id, min(i) as start, q, count(*) + 4 as shared from s group by doc_id, q, island),
r as materialized (select doc_id, start, shared + q as length, min(q) as period from l where shared >= 3 * q and shared + q >= 6 group by all),
b as (select doc_id, count(*) as n_runs, arg_min(struct_pack(s := start, l := length, q := period), (-length, start, period)) as top, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed from r group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
kept as (select doc_id, string_agg(word, ' ' order by i) as kept from e anti join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, top.s as start, top.l as length, top.q as period, 1000 * top.l // top.q as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from documents left join b using (doc_id) left join kept using (doc_id)"""

DIVERGENCE = r"""
with d as materialized (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), w as (select row, lang, source, unnest(words) as term from d),
c as materialized (select lang, source, term, count(*) as n, count(distinct row) as docs from w group by all),
kept as materialized (select lang, term, sum(n)::hugeint as n from c group by all having sum(docs) >= 30),
langs as materialized (select lang, count(term)::hugeint as v, coalesce(sum(n), 0)::hugeint as n from (select distinct lang from d) left join kept using (lang) group by lang),
g as materialized (
  select lang, source, v, l.n as lang_n, coalesce(sum(c.n) filter (where k.term is not null), 0)::hugeint as n
  from (select distinct lang, source from d) join langs l using (lang) left join c using (lang, source) left join kept k using (lang, term) group by all
), p as materialized (
  select lang, source, term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (g.lang_n + 5 * g.v) as q
  from g join kept k using (lang) left join c using (lang, source, term)
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source
), r as (
  select * from pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q
) select lang, source, part, item, value::bigint as value, rank::integer as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r) where part = 'pair' or rank <= 50"""
