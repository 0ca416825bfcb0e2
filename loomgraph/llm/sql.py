"""The operators' results in SQL (DuckDB), for the comparison of both engines on small tables."""

from __future__ import annotations

from loomgraph.llm import quality_rules as Q
from loomgraph.llm import secrets as S

_SPACE = r"[\x20\x09-\x0D]+"


def op1() -> str:
    """Counts, references, distances and verdict."""
    classes = list(Q.CHAR_CLASSES)
    removed = "text"
    steps = []
    for i, chars in enumerate(Q.CHAR_CLASSES.values()):
        removed = f"regexp_replace({removed}, '[{chars.replace(chr(39), chr(39) * 2)}]+', '', 'g')"
        steps.append(f"{removed} AS r{i}")
    sizes = ["length(text) - length(r0)"] + [f"length(r{i - 1}) - length(r{i})" for i in range(1, len(classes))] + [f"length(r{len(classes) - 1})"]
    langs = sorted(Q.COMMON_WORDS)
    own = {lang: ", ".join(f"len(list_filter(low, lambda w: w = '{x}'))" for x in Q.COMMON_WORDS[lang]) for lang in langs}
    known = "[" + ", ".join(f"'{s}'" for w in Q.ALL_WORDS for s in Q._spellings(w)) + "]"
    counts = "".join(f", [{own[lang]}] AS own_{lang}" for lang in langs)
    full = "".join(f", list_append(own_{lang}, n - CAST(list_sum(own_{lang}) AS BIGINT)) AS {lang}" for lang in langs)
    refs = "\nUNION ALL ".join(
        f"SELECT '{lang}' AS lang, (SELECT list(s ORDER BY i) FROM (SELECT i, sum(floor(10000 * classes[i] / size)) AS s FROM fit, range(1, {len(classes) + 2}) t(i) WHERE lang = '{lang}' GROUP BY i)) AS c, "
        f"(SELECT list(s ORDER BY i) FROM (SELECT i, sum(floor(10000 * {lang}[i] / n)) AS s FROM fit, range(1, 18) t(i) WHERE lang = '{lang}' GROUP BY i)) AS w"
        for lang in langs
    )
    part = "CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END"
    js = lambda mine, total, ref: f"sqrt(greatest(0, (SELECT sum({part}) FROM (SELECT unnest({mine}) / {total} AS x, unnest({ref}) / list_sum({ref}) AS y)) / 2))"
    near = "\nUNION ALL ".join(f"SELECT k, '{lang}' AS lang, {js('classes', 'size', 'r.c')} AS chars, {js(lang, 'n', 'r.w')} AS wds FROM m JOIN refs r ON r.lang = '{lang}' WHERE r.c IS NOT NULL AND n >= 50" for lang in langs)
    upper, signs = classes.index("upper") + 1, len(classes) + 1
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') AS words, {', '.join(steps)} FROM t),
c AS (SELECT *, len(words) AS n, length(text) AS size, [{', '.join(sizes)}] AS classes, list_transform(list_filter(words, lambda w: list_contains({known}, w)), lambda w: lower(w)) AS low FROM s),
o AS (SELECT *{counts} FROM c),
m AS (SELECT *{full} FROM o),
fit AS (SELECT * FROM m WHERE n >= 50 AND 100 * classes[{upper}] <= 20 * size AND 100 * classes[{signs}] <= 2 * size),
refs AS ({refs}),
near AS ({near}),
best AS (SELECT k, min_by(lang, (chars + wds, lang)) AS lang, min_by(chars, (chars + wds, lang)) AS chars, min_by(wds, (chars + wds, lang)) AS wds FROM near GROUP BY k),
g AS (SELECT k, unnest(range(1, n - 3)) AS i, words FROM m WHERE n >= 5),
gw AS (SELECT k, i, array_to_string(words[i:i + 4], ' ') AS w FROM g),
again AS (SELECT k, i FROM gw QUALIFY count(*) OVER (PARTITION BY k, w) > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS r FROM again, range(0, 5) x(j) GROUP BY k),
lines AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
f AS (SELECT m.*, coalesce(r, 0) AS r, len(lines) - len(list_distinct(lines)) AS dup, length(r1) - length(regexp_replace(r1, '[#*$%&|<>]', '', 'g')) AS symbols FROM m JOIN lines USING (k) LEFT JOIN covered USING (k))
SELECT doc_id, n AS n_words, size - classes[{classes.index('space') + 1}] AS word_chars, symbols AS n_symbols, dup AS n_dup_lines, r AS n_repeat_words, n < 10 OR 100 * r > 20 * n AS base_failed,
  NOT (n < 10 OR 100 * r > 20 * n) AND NOT coalesce(chars > {Q.Bounds().most_char_distance} OR wds > {Q.Bounds().most_word_distance}, false) AS kept, best.lang AS nearest_lang, round(chars, 4) AS char_distance, round(wds, 4) AS word_distance
FROM f LEFT JOIN best USING (k)
"""


def op2() -> str:
    """Base spans; the candidates of weak kinds with their complements; the credentials that they make."""
    found = "\nUNION ALL ".join(
        f"SELECT k, '{kind}' AS kind, {rank} AS rank, list_transform(string_split_regex(text, p), lambda x: length(x)) AS gaps, regexp_extract_all(text, p, 0) AS whole, regexp_extract_all(text, p, {group}) AS part, {least} AS least "
        f"FROM (SELECT k, text, '{pattern.replace(chr(39), chr(39) * 2)}' AS p FROM t)"
        for rank, (kind, (pattern, group, least)) in enumerate(S.KINDS.items())
    )
    base = ", ".join(f"'{k}'" for k in S.BASE)
    roles = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in S.ROLES.items())
    near = lambda role: f"EXISTS (SELECT 1 FROM parts q WHERE q.k = w.k AND q.role = '{role}' AND q.s < w.e + {S.SCOPE} AND w.s < q.e + {S.SCOPE})"
    linked = " OR ".join(f"(kind = '{kind}' AND {' AND '.join(near(r) for r in needs)})" for kind, needs in S.NEEDS.items())
    nearest = lambda role: f"(SELECT arg_min(q.kind || ':' || q.s || ':' || q.e, (greatest(0, q.s - w.e, w.s - q.e), q.s, q.kind, q.e)) FROM parts q WHERE q.k = w.k AND q.role = '{role}' AND q.s < w.e + {S.SCOPE} AND w.s < q.e + {S.SCOPE})"
    part = lambda role: f"CASE WHEN w.role = '{role}' THEN w.kind || ':' || w.s || ':' || w.e ELSE {nearest(role)} END AS {role}_"
    text = lambda where: f"coalesce((SELECT string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FROM spans WHERE spans.k = t.k{where}), '')"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM f WHERE len(whole) > 0),
p AS (SELECT k, kind, rank, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(whole[i]) AS size, whole[i] AS w FROM i
  WHERE length(part[i]) >= least AND (kind <> 'weak_secret' OR (regexp_matches(whole[i], '[a-z]') AND regexp_matches(whole[i], '[A-Z]') AND regexp_matches(whole[i], '[0-9]')))),
every AS (SELECT k, kind, rank, s, s + size AS e, kind IN ({base}) AS base FROM p),
clear AS (SELECT * FROM every x WHERE base OR NOT EXISTS (SELECT 1 FROM every b WHERE b.base AND b.k = x.k AND b.s < x.e AND x.s < b.e)),
parts AS (SELECT *, CASE kind {roles} END AS role FROM clear),
spans AS (SELECT k, kind, rank, s, e, base FROM parts w WHERE base OR {linked}),
asked AS (SELECT k, {part("id")}, {part("secret")}, {part("address")} FROM parts w WHERE kind NOT IN ('assign', 'hex')),
credentials AS (SELECT DISTINCT k, id_ || '+' || secret_ || '+' || coalesce(address_, '-') AS c FROM asked WHERE id_ IS NOT NULL AND secret_ IS NOT NULL)
SELECT doc_id, {', '.join(f"(SELECT count(*) FROM spans WHERE spans.k = t.k AND kind = '{b}') AS n_{b}" for b in S.BASE)}, sha256({text(' AND base')}) AS base_sha256, {text('')} AS spans,
  coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM credentials WHERE credentials.k = t.k), '') AS credentials FROM t
"""


def op8() -> str:
    """Links by brute force, components by recursion."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
ok AS (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS u FROM v WHERE x IS NOT NULL AND list_dot_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id
"""


def op5() -> str:
    """Shingle sets, links by counting common shingles, components by recursion."""
    return r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
"""


