"""URL filters: glob rules simulated at once by a bit-parallel automaton.

Every glob ('*' any run, '?' any one byte, anything else itself) becomes a chain of states,
one more than it has literals; all chains lie end to end in one bit vector of several 64-bit
words. A step over a byte c is ``D = ((D & accepts[c]) << 1) | (D & loops)``, where loops
marks the states at which a '*' stands. A URL matches a glob whose last state is set at the
end. Each step advances all URLs of an Arrow batch that are longer than the step's position.

The automaton reads the canonical URL: scheme and host in lower case, the default port, the
fragment, tracking parameters and a trailing slash of the path dropped.

Defined cases: a null URL, or one without '://', has an empty host, path and canonical form;
no host rule fits it and globs see the empty string. Longest host rule first; else the longest
matching glob (a block before an allow of equal length); else allow. Repeated rows are judged
alike; a very long URL is stepped through to its end; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path prefix)
HOST_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: (verdict, glob over the canonical URL)
GLOB_RULES = [
    ("block", "*://*spam-farm.*"),
    ("block", "*://*cheap-pills.*"),
    ("block", "*://*casino*.*/*"),
    ("block", "*://*adult-??deo*"),
    ("block", "*://*/wp-admin/*"),
    ("block", "*://*/cgi-bin/*"),
    ("block", "*://*/*.exe"),
    ("block", "*://*/*.zip"),
    ("block", "*://*/login*redirect=*"),
    ("block", "ftp://*"),
    ("allow", "*://*/robots.txt"),
    ("allow", "*://docs.*/*.html"),
]


class GlobAutomaton:
    """All globs packed into multiword masks."""

    def __init__(self, globs: list[str]) -> None:
        chains = []
        for glob in globs:
            literals: list[int | None] = []
            loops = {i: False for i in range(len(glob.encode()) + 1)}
            for c in glob.encode():
                if c == ord("*"):
                    loops[len(literals)] = True
                else:
                    literals.append(None if c == ord("?") else c)
            chains.append((literals, [i for i, loop in loops.items() if loop]))
        bits = sum(len(literals) + 1 for literals, _ in chains)
        self.words = max(1, -(-bits // 64))
        accepts = np.zeros((256, self.words * 64), bool)
        start, loop, self.last = np.zeros(self.words * 64, bool), np.zeros(self.words * 64, bool), []
        at = 0
        for literals, loops_at in chains:
            start[at] = True
            for i, c in enumerate(literals):
                accepts[slice(None) if c is None else c, at + i] = True
            loop[[at + i for i in loops_at]] = True
            self.last.append(at + len(literals))
            at += len(literals) + 1
        self.accepts, self.start, self.loop = (self._pack(x) for x in (accepts, start[None], loop[None]))

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, axis=1, bitorder="little").view("<u8")

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each string ``data[offsets[i]:offsets[i + 1]]``, a column for each glob."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begins, left = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start, len(order), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(order)
        for j in range(int(left[0]) if live else 0):
            while live and left[live - 1] <= j:
                live -= 1
            d = state[:live]
            moved = d & self.accepts[data[begins[:live] + j]]
            stepped = moved << one
            stepped[:, 1:] |= moved[:, :-1] >> top
            state[:live] = stepped | (d & self.loop)
        found = np.empty((len(order), len(self.last)), bool)
        for k, bit in enumerate(self.last):
            found[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one
        return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): text after the first '://' up to / ? # or the end, A-Z lowered; then up to ? # or the end."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, url.substr(cut + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Scheme and host lowered; default port, fragment, tracking parameters and trailing slash dropped."""
    host, path = url_parts(url)
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    host = F.regexp_replace(host, r":(80|443)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(?:utm_[^&=]*|gclid|fbclid|ref)(?:=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, r"^&+", "")
    whole = F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole).otherwise("")


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def filter_urls(
    pages: DataFrame,
    host_rules: list[tuple[str, str, str]] = HOST_RULES,
    glob_rules: list[tuple[str, str]] = GLOB_RULES,
    slice_rows: int = 4096,
) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, glob_rule for each row of ``pages``."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(canonical_url(F.col("url")), F.lit("")).alias("canonical"))
    rule, ruled = host_rule(F.col("host"), F.col("path"), host_rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), "canonical")
    ranked = sorted(glob_rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([glob for _, glob in ranked])
        globs = pa.array([*(glob for _, glob in ranked), None], pa.string())
        kinds = pa.array([*(kind for kind, _ in ranked), "allow"], pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                urls = [x.encode() for x in batch.column("canonical").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(u) for u in urls])]).astype(np.int64)
                found = automaton.matches(np.frombuffer(b"".join(urls), np.uint8), offsets)
                first = np.where(found.any(1), found.argmax(1), len(ranked)) if len(ranked) else np.zeros(len(urls), int)
                yield pa.RecordBatch.from_arrays([*batch.columns, globs.take(pa.array(first)), kinds.take(pa.array(first))], names=[*batch.schema.names, "glob_rule", "globbed"])

    judged = parts.mapInArrow(judge, "page_id long, host string, path string, rule string, ruled string, canonical string, glob_rule string, globbed string")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "globbed").alias("verdict"), "canonical", "glob_rule")


def op7_glob_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the host rules, else by the glob automaton."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _like(glob: str) -> str:
    """The glob as an anchored regular expression."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c.isalnum() or c in "/:-_=" else "\\" + c) for c in glob) + "$"


def op7_sql() -> str:
    """The same judgement in SQL, a regular expression for each glob."""
    rules = sorted(HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r))
    globs = sorted(GLOB_RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    fits = [(f"(host = '{d}' OR host LIKE '%.{d}') AND starts_with(path, '{p}')", d + p, k) for k, d, p in rules]
    hits = [(f"regexp_matches(canonical, '{_like(g)}', 's')", g, k) for k, g in globs]
    case = lambda pairs, i, other: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[i]}'" for x in pairs) + f" ELSE {other} END"
    return rf"""
WITH cut AS (
  SELECT page_id, url, instr(url, '://') AS pos,
         coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest
  FROM pages
), parts AS (
  SELECT page_id, url, pos, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace('&' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&(utm_[^&=]*|gclid|fbclid|ref)(=[^&]*)?(&(utm_[^&=]*|gclid|fbclid|ref)(=[^&]*)?)*(&|$)', '\6', 'g') AS query
  FROM cut
), canon AS (
  SELECT page_id, host, path,
         coalesce(CASE WHEN pos > 0 THEN translate(substr(url, 1, pos - 1), '{UPPER}', '{LOWER}') || '://' || regexp_replace(host, ':(80|443)$', '')
           || regexp_replace(path, '/+$', '') || CASE WHEN ltrim(query, '&') <> '' THEN '?' || ltrim(query, '&') ELSE '' END ELSE '' END, '') AS canonical
  FROM parts
), ruled AS (
  SELECT *, {case(fits, 1, 'NULL')} AS rule, {case(fits, 2, 'NULL')} AS ruled,
         {case(hits, 1, 'NULL')} AS glob_rule, {case(hits, 2, "'allow'")} AS globbed
  FROM canon
)
SELECT page_id, host, path, rule, coalesce(ruled, globbed) AS verdict, canonical, glob_rule FROM ruled
"""
