"""Queries of figures printed in text, passages, splitting and parsing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, joins, quality, reads, sections
from .frames import CTE_ASSESSED, CTE_REPORTS, docs, records, registry, reports, table

QUERIES, ORACLE_SQL, query = registry()

_TARGETS = "targets AS (SELECT DISTINCT ticker, target FROM (SELECT ticker, unnest(CASE WHEN reason IN ('scale_ambiguous', 'scale_disagreement') THEN [abs(value), abs(value) * 1000, abs(value) / 1000] ELSE [abs(value)] END) AS target FROM judged WHERE value IS NOT NULL AND value <> 0))"
_RUN = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
_WORDS = "CASE rtrim(lower(word), 's') " + " ".join(f"WHEN '{w}' THEN {v!r}::DOUBLE" for w, v in guards.WORDS.items()) + " END"
# Runs of digits with what stands before and behind; a run behind a letter loses what is before its first comma.
_AMOUNTS = f"""{CTE_REPORTS}, {_TARGETS},
cut AS (SELECT doc_id, ticker, regexp_split_to_array(text, '{_RUN}') AS s, regexp_extract_all(text, '{_RUN}') AS t FROM reports),
runs AS (SELECT doc_id, ticker, i, s[i] AS before, t[i] AS run, s[i + 1] AS after, i = len(t) AS ends FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM cut)),
seen AS (SELECT *, regexp_matches(before, '[\\pL\\pM\\pN_.]$') AS blocked, contains(run, ',') AS grouped, regexp_extract(before, '\\$\\s?$') AS sign, regexp_extract(after, '^\\s?') AS gap, regexp_extract(after, '^\\s?([\\pL\\pM_]+)', 1) AS word FROM runs),
num AS (SELECT *, CASE WHEN NOT blocked THEN run WHEN grouped THEN substr(run, instr(run, ',') + 1) END AS said,
  sign <> '' AND NOT blocked AND NOT regexp_matches(left(before, length(before) - length(sign)), '[\\pL\\pM\\pN_.]$') AS dollar,
  CASE WHEN ends OR length(gap) + length(word) < length(after) THEN {_WORDS} END AS scale FROM seen),
read AS (SELECT *, CAST(replace(said, ',', '') AS DOUBLE) AS v, dollar OR contains(said, ',') OR scale IS NOT NULL AS money FROM num WHERE said IS NOT NULL),
reading AS (SELECT doc_id, ticker, i, said, unnest(CASE WHEN scale IS NOT NULL THEN [v * scale] ELSE [v, v * 1e3::DOUBLE, v * 1e6::DOUBLE, v * 1e9::DOUBLE] END) AS reading FROM read WHERE money)"""
_BAND = "reading BETWEEN target - target * 0.005::DOUBLE AND target + target * 0.005::DOUBLE"


def _targets(s, d):
    return quality.guard_values(quality.assessed(reads.current(docs(s, d), records(s, d))))


@query(f"WITH {CTE_ASSESSED}, {_AMOUNTS}, nth AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM read) SELECT r.doc_id, CAST(n.place AS INT) AS place, said, reading, target FROM reading r JOIN targets t ON t.ticker = r.ticker AND {_BAND} JOIN nth n ON n.doc_id = r.doc_id AND n.i = r.i")
def j8_printed_figures(s, d):
    """Amounts printed in all texts, at all readings, with the figures stored for the text's company."""
    return guards.printed_figures(reports(s, d), _targets(s, d), "ticker").select("doc_id", "place", "said", "reading", "target")


@query(f"""WITH {CTE_ASSESSED}, {_AMOUNTS},
hit AS (SELECT DISTINCT doc_id, i FROM reading r JOIN targets t ON t.ticker = r.ticker AND {_BAND}),
marked AS (SELECT n.*, h.i IS NOT NULL AS hit FROM num n LEFT JOIN hit h ON h.doc_id = n.doc_id AND h.i = n.i),
pieces AS (SELECT doc_id, i, hit, substr(before, 1 + coalesce(lag(CASE WHEN hit AND scale IS NOT NULL THEN length(gap) + length(word) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i), 0)) AS front, CASE WHEN hit AND dollar THEN length(sign) ELSE 0 END AS back,
  CASE WHEN hit THEN concat(left(run, length(run) - length(said)), '[figure withheld]') ELSE run END AS shown, CASE WHEN hit AND scale IS NOT NULL THEN length(gap) + length(word) ELSE 0 END AS tail FROM marked),
joined AS (SELECT doc_id, string_agg(concat(left(front, length(front) - back), shown), '' ORDER BY i) AS t, count(*) FILTER (hit) AS withheld, arg_max(tail, i) AS tail FROM pieces GROUP BY 1)
SELECT c.doc_id, sha256(concat(coalesce(j.t, ''), substr(s[len(s)], 1 + coalesce(j.tail, 0)))) AS masked, CAST(coalesce(withheld, 0) AS INT) AS withheld FROM cut c LEFT JOIN joined j ON j.doc_id = c.doc_id""")
def q7_masked_reports(s, d):
    """Whole texts without the amounts that denote a figure stored for their company."""
    targets = _targets(s, d).groupBy("ticker").agg(F.collect_list("target").alias("targets"))  # at most 3 for each of five figures
    return guards.masked(reports(s, d), targets, "ticker").select("doc_id", F.sha2("text", 256).alias("masked"), "withheld")


def _split_sql(text: str, k: int, size: int, overlap: int) -> str:
    """Pieces of a text at the separators from the kth on, as nested folds of lists; every element has the shape of the fold's state."""
    s, p = f"s{k}", f"p{k}"
    q = sections.SEPARATORS[k].replace("'", "''").replace("\n", "' || chr(10) || '")
    cut = f"string_split({text}, '')" if not sections.SEPARATORS[k] else f"list_transform(string_split({text}, '{q}'), lambda x{k}, i{k}: CASE WHEN i{k} > 1 THEN concat('{q}', x{k}) ELSE x{k} END)"
    empty = "CAST([] AS STRUCT(t VARCHAR, n INT)[])"
    make = lambda out, window, total, t="''", n="0": f"struct_pack(o := {out}, w := {window}, c := CAST({total} AS INT), t := {t}, n := CAST({n} AS INT))"
    piece = lambda w: f"list_filter([regexp_replace(array_to_string(list_transform({w}, lambda y{k}: y{k}.t), ''), '^\\s+|\\s+$', '', 'g')], lambda z{k}: z{k} <> '')"
    most = f"least({overlap}, {size} - {p}.n)"
    end = f"list_filter({s}.w, lambda e{k}, j{k}: {s}.c - coalesce(list_sum(list_transform({s}.w[1:j{k} - 1], lambda f{k}: f{k}.n)), 0) <= {most})"
    done = f"list_concat({s}.o, {piece(s + '.w')})"
    finer = _split_sql(f"{p}.t", k + 1, size, overlap) if k + 1 < len(sections.SEPARATORS) else f"[{p}.t]"
    own = f"struct_pack(t := {p}.t, n := {p}.n)"
    absent = f" OR NOT contains({text}, '{q}')" if sections.SEPARATORS[k] else ""
    step = (
        f"CASE WHEN {p}.n >= {size}{absent} THEN {make(f'list_concat({done}, {finer})', empty, 0)}"
        f" WHEN {s}.c + {p}.n > {size} THEN {make(done, f'list_append({end}, {own})', f'coalesce(list_sum(list_transform({end}, lambda g{k}: g{k}.n)), 0) + {p}.n')}"
        f" ELSE {make(f'{s}.o', f'list_append({s}.w, {own})', f'{s}.c + {p}.n')} END"
    )
    none = "CAST([] AS VARCHAR[])"
    words = f"len(list_filter(regexp_split_to_array(m{k}, '\\s+'), lambda h{k}: h{k} <> ''))"
    parts = f"list_transform(list_filter({cut}, lambda l{k}: l{k} <> ''), lambda m{k}: {make(none, empty, 0, f'm{k}', words)})"
    folded = f"list_reduce(list_prepend({make(none, empty, 0)}, {parts}), lambda {s}, {p}: {step})"
    return f"list_transform([{folded}], lambda {s}: list_concat({s}.o, {piece(s + '.w')}))[1]"


@query(f"SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, c AS text FROM (SELECT doc_id, unnest(c) AS c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {_split_sql('text', 0, 100, 10)} AS c FROM documents)) WHERE length(trim(c)) >= 100")
def c5_recursive_chunks(s, d):
    return sections.recursive_chunks(table(s, d, "documents"), 100, 10)


_SHORT = "p AS (SELECT item_id * 3 + k AS passage_id, CASE k WHEN 0 THEN w[3] WHEN 1 THEN concat(w[3], ' ', w[4]) ELSE left(w[5], 2) END AS passage FROM (SELECT item_id, regexp_split_to_array(text, '\\s+') AS w FROM benchmark), (VALUES (0), (1), (2)) v(k))"


@query(f"WITH {_SHORT} SELECT passage_id, doc_id AS text_id FROM p JOIN documents ON contains(text, passage)")
def q1_short_passages(s, d):
    """A word, two words and two letters of each benchmark passage, looked for in all whole texts."""
    w = table(s, d, "benchmark").select("item_id", F.split("text", r"\s+").alias("w"))
    said = F.array(F.get("w", 2), F.concat(F.get("w", 2), F.lit(" "), F.get("w", 3)), F.left(F.get("w", 4), F.lit(2)))
    p = w.select("item_id", F.posexplode(said).alias("k", "passage")).select((F.col("item_id") * 3 + F.col("k")).alias("passage_id"), "passage")
    return joins.contained_passages(p, table(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))
