"""Terms of a question for lexical reranking, Latin and Chinese, and identifiers as words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import soft_tokens, whole_word

# What separates the parts of a question, terms that say nothing, and generic pairs and words.
SEPARATORS = r"(?U)[的了吗呢啊吧和与在为对从中到及、，。；：？！\?\!\s]+"
SKIPPED = ["什么", "如何", "哪些", "是否", "怎么", "怎样", "请问", "这个", "那个", "一个"]
GENERIC_PAIRS = [
    "管理", "流程", "场景", "处理", "数据", "信息", "系统", "服务", "模块", "相关", "功能", "接口", "业务", "代码", "方法",
    "实现", "逻辑", "应用", "配置", "参数", "结果", "内容", "对象", "实体", "组件", "页面", "请求", "响应", "用户", "操作",
]
MOST_TERMS = 60
WHOLE_RUN = 12


def _grams(run: Column, size: int) -> Column:
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - (size - 1))), lambda i: i + (size - 1) <= F.length(run))
    return F.transform(places, lambda i: F.substr(run, i, F.lit(size)))


def query_terms(question: Column) -> Column:
    """Distinct terms in order: Latin words of three characters or more, lower-cased; then Chinese runs between separators.

    A run of up to twelve characters is one term; a longer one gives its pairs, then its triples.
    At most sixty terms, as the lexical score is a share of them.
    """
    q = F.trim(F.coalesce(question, F.lit("")))
    latin = F.transform(F.regexp_extract_all(q, F.lit(r"[A-Za-z][A-Za-z0-9_]{2,}"), F.lit(0)), lambda t: F.lower(t))
    runs = F.filter(F.transform(F.split(q, SEPARATORS), lambda p: F.regexp_replace(p, r"[^一-鿿]", "")), lambda r: F.length(r) >= 2)
    chinese = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= WHOLE_RUN, F.array(r)).otherwise(F.concat(_grams(r, 2), _grams(r, 3)))))
    terms = F.filter(F.concat(latin, chinese), lambda t: ~t.isin(SKIPPED))
    return F.slice(F.array_distinct(terms), 1, MOST_TERMS)


def phrase_ends(phrase: Column, generic: list[str] | None = None) -> Column:
    """The first and the last pair of a Chinese phrase of four characters or more, save generic ones."""
    run = F.regexp_replace(F.coalesce(phrase, F.lit("")), r"[^一-鿿]", "")
    pairs = F.array_distinct(F.array(F.substring(run, 1, 2), F.substring(run, -2, 2)))
    return F.when(F.length(run) >= 4, F.filter(pairs, lambda p: ~p.isin(GENERIC_PAIRS if generic is None else generic))).otherwise(F.array().cast("array<string>"))


def is_noise(term: Column, question: Column, generic: list[str], kept: list[str]) -> Column:
    """Whether a generic Latin term stands in no whole word of the question, and in no list of terms to be kept."""
    low = F.lower(F.trim(term))
    return ~term.rlike(r"[^\x00-\x7f]") & low.isin(generic) & (~low.isin(kept) if kept else F.lit(True)) & ~whole_word(term, soft_tokens(question))


def lexical_terms(question: Column, extra: Column | None = None, generic: list[str] = (), kept: list[str] = ()) -> Column:
    """The question's terms, the extra ones (of a vocabulary), the ends of its phrases; without noise."""
    base = query_terms(question)
    every = F.array_distinct(F.concat(base, extra if extra is not None else F.array().cast("array<string>"), F.flatten(F.transform(base, lambda t: phrase_ends(t)))))
    return F.filter(every, lambda t: ~is_noise(t, question, list(generic), list(kept))) if generic else every


def identifier_words(ident: Column) -> Column:
    """A camel-case or underscored name as lower-case words of two characters or more."""
    flat = F.regexp_replace(F.trim(F.coalesce(ident, F.lit(""))), r"[_\-\s]+", " ")
    humps = F.regexp_replace(F.regexp_replace(flat, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_join(F.transform(F.filter(F.split(humps, r"\s+"), lambda w: F.length(w) >= 2), lambda w: F.lower(w)), " ")


def expand_terms(question: Column, base: Column, vocabulary: list[str], entries: list[tuple[str, list[str]]] = (), most: int = 100) -> Column:
    """The base terms, then what a configuration adds, ``most`` in all and each once.

    First the vocabulary's phrases that the question holds, by name; then those that hold a base term of two
    characters or more or are held by one, base term by base term; then the synonyms or ids of the entries whose name is
    touched in either way. Latin additions of entries are lower-cased, single ones dropped.
    """
    none = F.array().cast("array<string>")
    phrases = sorted({p.strip() for p in vocabulary if len(p.strip()) >= 2})
    vocab = F.array(*map(F.lit, phrases)) if phrases else none
    q, terms = F.trim(F.coalesce(question, F.lit(""))), F.filter(F.transform(base, F.trim), lambda t: t != "")
    long = F.filter(terms, lambda t: F.length(t) >= 2)
    near = lambda t, p: t.contains(p) | p.contains(t)
    touched = lambda own: q.contains(own) | F.exists(long, lambda t: near(t, own))
    held = F.filter(vocab, lambda p: q.contains(p))
    related = F.flatten(F.transform(long, lambda t: F.filter(vocab, lambda p: near(t, p))))
    added = [none]
    for name, extras in entries:
        kept = [x.lower() if x.isascii() else x for x in map(str.strip, extras) if x and not (len(x) == 1 and x.isascii())]
        if len(name.strip()) >= 2 and kept:
            added.append(F.when(touched(F.lit(name.strip())), F.array(*map(F.lit, kept))).otherwise(none))
    return F.slice(F.array_distinct(F.concat(terms, held, related, *added)), 1, most)
