"""SQL of the operators that SQL can express, for an independent engine."""

from __future__ import annotations

from .fingerprint import RUN

# Windows of one length: islands of hits whose starts are at most that length apart are maximal removed runs.
_ISLANDS = """
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
hit AS (SELECT w.doc_id, w.i FROM win w JOIN first f ON f.k = w.k WHERE f.least < w.doc_id),
cut AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit),
island AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM cut),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM island GROUP BY 1, 2),
edges AS (SELECT s.doc_id, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 1) AS s, a AS e FROM spans s UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY 1),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1),
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
{_ISLANDS}
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY s) AS t FROM (SELECT e.doc_id, e.s, array_to_string(d.w[e.s:coalesce(e.e - 1, len(d.w))], ' ') AS t FROM edges e JOIN d ON d.doc_id = e.doc_id) WHERE t <> '' GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN r.doc_id IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(k.t, '') END) AS kept_sha256
FROM d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, hash(substr(h, CAST(2 * i - 1 AS BIGINT), 100)) AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
{_ISLANDS}
kept AS (SELECT doc_id, string_agg(t, '' ORDER BY s) AS t FROM (SELECT e.doc_id, e.s, substr(d.h, CAST(2 * e.s - 1 AS BIGINT), CAST(CASE WHEN e.e IS NULL THEN length(d.h) ELSE 2 * (e.e - e.s) END AS BIGINT)) AS t FROM edges e JOIN d ON d.doc_id = e.doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN r.doc_id IS NULL THEN d.h ELSE coalesce(k.t, '') END)) AS kept_sha256
FROM d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def _branches(text: str) -> str:
    """Sections of a text: lists of paragraphs, each its hash and the joined short hashes of its runs."""
    runs = f"list_transform(regexp_extract_all(p, '{RUN}'), lambda r: sha256(r))"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(list_transform(string_split(s, chr(10)), lambda p: {runs}), lambda h: {{'hash': sha256(array_to_string(h, '')), 'runs': array_to_string(list_transform(h, lambda x: substr(x, 1, 8)), ' ')}}))"


def _rendered(branches: str) -> str:
    sections = f"list_transform({branches}, lambda s: {{'hash': sha256(array_to_string(list_transform(s, lambda p: p.hash), '')), 'said': array_to_string(list_transform(s, lambda p: substr(p.hash, 1, 16) || '(' || p.runs || ')'), ',')}})"
    return f"list_transform([{sections}], lambda a: sha256(array_to_string(list_transform(a, lambda s: s.hash), '')) || ':' || array_to_string(list_transform(a, lambda s: substr(s.hash, 1, 16) || '[' || s.said || ']'), '/'))[1]"


def _walk(a: str, b: str, said: str) -> str:
    """Steps from fingerprints a and b of a row of f to their likeness."""
    sections = lambda x: f"list_distinct(string_split(split_part({x}, ':', 2), '/'))"
    inner = lambda x, sep: f"flatten(list_transform({x}, lambda s: string_split(substr(s, 18, length(s) - 18), '{sep}')))"
    minus = lambda x, y: f"list_filter({x}, lambda e: NOT list_contains({y}, e))"
    both = lambda x, y: f"list_filter({x}, lambda e: list_contains({y}, e))"
    weight = lambda x: f"coalesce(list_sum(list_transform({x}, lambda p: (length(p) - 17) // 9)), 0)"
    return f"""
{said}1 AS (SELECT doc_id, split_part({a}, ':', 1) = split_part({b}, ':', 1) AS equal, {sections(a)} AS sa, {sections(b)} AS sb FROM f),
{said}2 AS (SELECT doc_id, equal, list_distinct({inner(both('sa', 'sb'), ',')}) AS same, list_distinct({inner(minus('sa', 'sb'), ',')}) AS pa, list_distinct({inner(minus('sb', 'sa'), ',')}) AS pb FROM {said}1),
{said}3 AS (SELECT doc_id, equal, {weight('same')} + {weight(both('pa', 'pb'))} AS same, list_distinct(list_filter({inner(minus('pa', 'pb'), ' ')}, lambda r: r <> '')) AS ra, list_distinct(list_filter({inner(minus('pb', 'pa'), ' ')}, lambda r: r <> '')) AS rb FROM {said}2),
{said} AS (SELECT doc_id, CASE WHEN equal THEN 1.0::DOUBLE WHEN 2 * same + len(ra) + len(rb) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (same + len({both('ra', 'rb')})) / (2 * same + len(ra) + len(rb)) END AS near FROM {said}3)"""


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, concat(substr(t, 1, length(t) - length(t) // 2), substr(nt, 1, length(t) // 2)) AS et FROM n),
f AS (SELECT doc_id, t, et, {_rendered(_branches('t'))} AS own, {_rendered(_branches('et'))} AS edit, {_rendered(_branches('nt'))} AS next FROM e),
{_walk('own', 'edit', 'w')}, {_walk('own', 'next', 'v')}
SELECT f.doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, own AS fingerprint, edit AS edited_fingerprint, w.near AS near_edited, v.near AS near_next
FROM f JOIN w ON w.doc_id = f.doc_id JOIN v ON v.doc_id = f.doc_id
"""

EXACT_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(nth AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM s) WHERE nth <= 20
"""

# crc32 of an id in decimal: the table's 256 entries are made by eight steps each.
_CRC_TABLE = "list_transform(range(0, 256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS STRING), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y: xor(x // 256, t[(xor(x, y) % 256) + 1])))"

# A lag is tried in full for a document where four words in a row at that stride are equal, as every run of four periods has them.
PERIODIC_RUNS = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, {_CRC} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents, crc),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS echoed, h // 10 AS g FROM d),
a AS (SELECT doc_id, w, n, echoed, CASE WHEN echoed THEN g % n END AS a, g FROM g),
p AS (SELECT doc_id, w, n, a, CASE WHEN echoed THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
e AS (SELECT doc_id, n, CASE WHEN p IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
pos AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS w FROM e),
strides AS (SELECT doc_id, q, unnest(range(0, n, q)) AS i FROM (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM e)),
four AS (SELECT s.doc_id, q, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM strides s JOIN pos ON pos.doc_id = s.doc_id AND pos.i = s.i WINDOW o AS (PARTITION BY s.doc_id, q ORDER BY s.i)),
tried AS (SELECT DISTINCT doc_id, q FROM four WHERE w = w1 AND w1 = w2 AND w2 = w3),
same AS (SELECT t.doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY t.doc_id, q ORDER BY x.i) AS island FROM tried t JOIN pos x ON x.doc_id = t.doc_id JOIN pos y ON y.doc_id = t.doc_id AND y.i = x.i + q WHERE x.w = y.w),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY 1, 2, 3),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS top FROM run GROUP BY 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM pos ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT e.doc_id, CAST(coalesce(s.n_runs, 0) AS BIGINT) AS n_runs, CAST(s.top.start AS BIGINT) AS start, CAST(s.top.length AS BIGINT) AS length, CAST(s.top.period AS BIGINT) AS period, CAST(1000 * s.top.length // s.top.period AS BIGINT) AS exponent_milli, sha256(coalesce(s.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM e LEFT JOIN said s ON s.doc_id = e.doc_id LEFT JOIN kept k ON k.doc_id = e.doc_id
"""

LANGUAGE_ID = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, lang, ({_CRC}) % 5 AS fold, concat(' ', trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')), ' ') AS s FROM documents, crc),
place AS (SELECT doc_id, lang, fold, unnest(c) AS x, unnest(list_append(c[2:], '')) AS y, unnest(list_concat(c[3:], ['', ''])) AS z FROM (SELECT doc_id, lang, fold, string_split(s, '') AS c FROM d)),
g AS (SELECT doc_id, lang, fold, unnest([x, CASE WHEN y <> '' THEN x || y END, CASE WHEN y <> ' ' AND z <> '' THEN x || y || z END]) AS gram FROM place),
n AS (SELECT doc_id, lang, fold, gram, count(*) AS n FROM g WHERE trim(gram) <> '' GROUP BY ALL),
learned AS (SELECT lang, gram, sum(n) AS n FROM n WHERE fold <> 0 AND lang IS NOT NULL GROUP BY ALL),
profile AS (SELECT lang, gram, place FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS place FROM learned) WHERE place < 400),
own AS (SELECT doc_id, gram, place FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS place FROM n) WHERE place < 400),
away AS (SELECT o.doc_id, l.lang, CAST(sum(coalesce(abs(o.place - p.place), 400)) AS BIGINT) AS away, count(*) AS m FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.gram = o.gram GROUP BY 1, 2),
best AS (SELECT doc_id, lang, 1 - CAST(away AS DOUBLE) / CAST(400 * m AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) AS nth FROM away) WHERE nth = 1)
SELECT d.doc_id, fold = 0 AS held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(b.score, 0.0::DOUBLE) AS score FROM d LEFT JOIN best b ON b.doc_id = d.doc_id
"""

PHRASES = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
longer AS (SELECT lang, f, unnest([g[1:len(g) - 1], g[2:len(g)]]) AS g FROM f WHERE len(g) > 2),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) >= 2 AND NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = f.lang AND o.g = f.g AND o.f >= f.f)),
cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
scored AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, t.n, CAST((CAST(1000 AS HUGEINT) * a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)] JOIN total t ON t.lang = c.lang),
least AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM scored) WHERE nth = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least) WHERE rank <= 2000
"""

ORACLE_SQL = {"op1_substring_dedup": SUBSTRING_DEDUP, "op7_merkle_fingerprints": FINGERPRINTS, "op8_exact_topk": EXACT_TOPK, "op10_suffix_dedup": SUFFIX_DEDUP, "op11_periodic_runs": PERIODIC_RUNS, "op12_phrase_mining": PHRASES, "op13_language_id": LANGUAGE_ID}
