"""Quality rules with distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 5-word windows. The method then
compares a document's histogram of character classes, and its histogram of common words, with
references of each language by Jensen-Shannon distance (base 2, so 0 to 1). A document is
kept when some language's two distances are within bounds; one with too few words for a
meaningful histogram is judged by the base rules alone.

References are means over the corpus's own documents of a language, save those that can't be
prose by their share of capitals or signs, computed in one pass over all of them (``fit_references``); whoever has trusted ones passes them instead. They are
four rows of 24 numbers, whatever the corpus.

The bound of the word distance lies below the distance of a text that has none of a language's
common words (0.34 and more, as measured) and above that of short prose (up to 0.30).

Defined cases: a null or empty text has zero counts and fails the base rules (fewer than 10
words); a very long text is counted whole; repeated rows are judged each; a null or unknown lang
adds to no reference, and such a document is compared with all of them; of languages at the same
distance the first by name is the nearest; without any reference the base rules decide alone;
extra columns are carried along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"

# Frequent words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "nicht", "des", "auf", "für", "ist", "ein", "eine"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "pas"],
}
#: Character classes, each as a regular expression's set; what is in none is "other".
CHAR_CLASSES = {"lower": "a-z", "space": SPACE, "upper": "A-Z", "digit": "0-9", "stop": r".,;:!?'\x22()-", "foreign": r"\x{80}-\x{10FFFF}"}
ALL_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})


@dataclass(frozen=True)
class Bounds:
    """Thresholds of the rules."""

    min_words: int = 10
    most_repeat_percent: int = 20
    least_words_compared: int = 50
    most_char_distance: float = 0.20
    most_word_distance: float = 0.32
    most_upper_percent_fitted: int = 20
    most_signs_percent_fitted: int = 2


def _spellings(word: str) -> list[str]:
    return sorted({word, word.capitalize(), word.upper()})


def _counted(docs: DataFrame) -> DataFrame:
    """docs with text made non-null, its words, and the counts of both histograms."""
    text = docs.withColumn("text", F.coalesce("text", F.lit("")))
    words = F.array_remove(F.split("text", f"[{SPACE}]+"), "")
    text = text.withColumn("_words", words)
    known = [s for w in ALL_WORDS for s in _spellings(w)]
    common = F.filter("_words", lambda w: w.isin(known))
    text = text.withColumn("_n", F.size("_words")).withColumn("_common", F.concat(F.lit(" "), F.lower(F.concat_ws("  ", common)), F.lit(" ")))
    # Lower-case letters go first, then spaces: the other classes are counted in the little that is left.
    rest, sizes = "text", []
    for i, chars in enumerate(CHAR_CLASSES.values()):
        text = text.withColumn(f"_rest{i}", F.regexp_replace(rest, f"[{chars}]+", ""))
        sizes.append(F.length(rest) - F.length(f"_rest{i}"))
        rest = f"_rest{i}"
    hits = [((F.length("_common") - F.length(F.replace("_common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w in ALL_WORDS]
    return text.withColumn("_hits", F.array(*hits)).withColumn("_classes", F.array(*sizes, F.length(rest))).withColumn("_size", F.length("text"))


def _word_counts(lang: str) -> Column:
    """Counts of the language's common words, then of all other words."""
    own = F.array(*(F.get("_hits", F.lit(ALL_WORDS.index(w))) for w in COMMON_WORDS[lang]))
    return F.concat(own, F.array(F.col("_n") - F.aggregate(own, F.lit(0), lambda a, x: a + x)))


def _computed_once(df: DataFrame) -> DataFrame:
    """df with a row number, to be named in the filters that follow.

    It is a bound for the optimizer, which would push such a filter below the columns that it
    is made of and compute each of them anew wherever another uses it.
    """
    return df.withColumn("_row", F.monotonically_increasing_id())


def fit_references(docs: DataFrame, bounds: Bounds = Bounds()) -> dict[str, tuple[list[float], list[float]]]:
    """lang -> (shares of the character classes, shares of the common words and of the rest)."""
    text = _computed_once(_counted(docs.select("text", "lang").filter(F.col("lang").isin(sorted(COMMON_WORDS))))).filter((F.col("_row") >= 0) & (F.col("_n") >= bounds.least_words_compared))
    upper, signs = F.get("_classes", F.lit(list(CHAR_CLASSES).index("upper"))), F.get("_classes", F.lit(len(CHAR_CLASSES)))
    text = text.filter((F.col("_row") >= 0) & (100 * upper.cast("long") <= bounds.most_upper_percent_fitted * F.col("_size").cast("long")) & (100 * signs.cast("long") <= bounds.most_signs_percent_fitted * F.col("_size").cast("long")))
    words = F.coalesce(*(F.when(F.col("lang") == lang, _word_counts(lang)) for lang in sorted(COMMON_WORDS)))
    text = text.select("lang", "_classes", "_size", "_n", words.alias("_own"))
    n_classes, n_words = len(CHAR_CLASSES) + 1, 17
    whole = F.lit(10000).cast("long")  # a count of a very long text times that is no int
    # Whole ten-thousandths of each document, so that sums don't depend on their order.
    shares = [F.sum(F.floor(whole * F.get("_classes", F.lit(i)) / F.col("_size"))).alias(f"c{i}") for i in range(n_classes)]
    shares += [F.sum(F.floor(whole * F.get("_own", F.lit(i)) / F.col("_n"))).alias(f"w{i}") for i in range(n_words)]
    out = {}
    for row in text.groupBy("lang").agg(*shares).collect():
        chars, own = [row[f"c{i}"] for i in range(n_classes)], [row[f"w{i}"] for i in range(n_words)]
        out[row["lang"]] = ([x / sum(chars) for x in chars], [x / sum(own) for x in own])
    return out


def js_distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counts / total from the reference shares."""
    q = F.array(*(F.lit(float(x)) for x in reference))
    p = F.transform(counts, lambda x: x / total)

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x) / 2))


def _windows(words: Column, n: Column) -> tuple[Column, Column]:
    """The hash of each 5-word window; the windows' words with their places, sorted.

    Hashes come first: only a text in which two are equal sorts the windows' own words, so
    that the count is exact.
    """
    at = F.sequence(F.lit(0), n - 5)
    window = lambda i: [F.get(words, i + j) for j in range(5)]
    hashes = F.transform(at, lambda i: F.xxhash64(*window(i)))
    return hashes, F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))))


def measure(docs: DataFrame) -> DataFrame:
    """The input's columns (none named like those of this module) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the histograms."""
    text = _counted(docs)
    hashes, ordered = _windows(F.col("_words"), F.col("_n"))
    text = text.withColumn("_again", F.when(F.col("_n") >= 6, F.size(F.array_distinct(hashes)) < F.col("_n") - 4).otherwise(False))
    text = text.withColumn("_ordered", F.when(F.col("_again"), ordered))
    same = lambda k, j: F.get("_ordered", k)["w"] == F.get("_ordered", j)["w"]
    repeated = F.filter(F.sequence(F.lit(0), F.size("_ordered") - 1), lambda k: F.coalesce((k > 0) & same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    places = F.sort_array(F.transform(repeated, lambda k: F.get("_ordered", k)["i"]))
    text = text.withColumn("_places", F.when(F.col("_again"), places))
    # A window covers five words, or those up to the next repeated window.
    covered = F.aggregate(
        F.zip_with("_places", F.slice(F.col("_places"), F.lit(2), F.size("_places")), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5)))), F.lit(0), lambda s, x: s + x
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    text = text.withColumn("_lines", lines)
    return text.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": (F.col("_size") - F.get("_classes", F.lit(list(CHAR_CLASSES).index("space")))).cast("long"),
        "n_symbols": (F.length("_rest1") - F.length(F.regexp_replace("_rest1", r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_again"), covered).otherwise(0).cast("long"),
    })


VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "nearest_lang", "char_distance", "word_distance", "kept"]


def _judged(docs: DataFrame, references: dict[str, tuple[list[float], list[float]]] | None, bounds: Bounds) -> DataFrame:
    """The input's columns as c0, c1, ..., then those of VERDICT."""
    references = fit_references(docs, bounds) if references is None else references
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    text = measure(plain.withColumn("text", F.col(columns[docs.columns.index("text")])))
    text = text.withColumn("base_failed", (F.col("n_words") < bounds.min_words) | (100 * F.col("n_repeat_words") > bounds.most_repeat_percent * F.col("n_words")))
    if references:
        each = [
            F.struct((c + w).alias("sum"), F.lit(lang).alias("lang"), c.alias("chars"), w.alias("words"))
            for lang, (chars, words) in sorted(references.items())
            for c, w in [(js_distance(F.col("_classes"), F.col("_size"), chars), js_distance(_word_counts(lang), F.col("_n"), words))]
        ]
        text = text.withColumn("_near", F.when(F.col("n_words") >= bounds.least_words_compared, F.array_min(F.array(*each))))
    else:
        text = text.withColumn("_near", F.lit(None).cast("struct<sum: double, lang: string, chars: double, words: double>"))
    far = (F.col("_near.chars") > bounds.most_char_distance) | (F.col("_near.words") > bounds.most_word_distance)
    text = text.withColumns({
        "nearest_lang": F.col("_near.lang"), "char_distance": F.round("_near.chars", 4), "word_distance": F.round("_near.words", 4),
        "kept": ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)),
    })
    return text.select(*columns, *VERDICT)


def judge(docs: DataFrame, references: dict[str, tuple[list[float], list[float]]] | None = None, bounds: Bounds = Bounds()) -> DataFrame:
    """The input's columns, then the counts, base_failed, nearest_lang, char_distance, word_distance, kept.

    The distances are those of the nearest language, null where the text isn't compared.
    """
    return _judged(docs, references, bounds).toDF(*docs.columns, *VERDICT)


def keep_documents(docs: DataFrame, references: dict | None = None, bounds: Bounds = Bounds()) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    judged = _computed_once(_judged(docs, references, bounds)).filter("kept AND _row >= 0")
    return judged.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op1_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", *VERDICT)
