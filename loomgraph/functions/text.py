"""Scalar text functions for code identifiers, SQL statements and generated texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_tokens(name: Column) -> Column:
    """Lower-cased runs of an identifier: capitalised words, lower-case runs, acronyms, digits."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1)), lambda t: F.lower(t))


def soft_tokens(text: Column) -> Column:
    """Text as lower-case ASCII tokens with one space between and around: camel humps and signs split."""
    humps = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(humps), r"[^a-z0-9]+", " ")), F.lit(" "))


def whole_word(term: Column, flat: Column) -> Column:
    """Whether a term of two characters or more is a token of a soft-token text."""
    return (F.length(term) >= 2) & (F.instr(flat, F.concat(F.lit(" "), F.lower(term), F.lit(" "))) > 0)


def sql_tables(statement: Column) -> Column:
    """The distinct tables after FROM, JOIN, INTO, UPDATE and TABLE, lower-cased, in order; back-quoted or not, with their schema."""
    name = r"(`?[A-Za-z_]\w*`?(?:\.`?[A-Za-z_]\w*`?)*)"
    found = F.regexp_extract_all(statement, F.lit(rf"(?i)\b(?:from|join|into|update|table)\s+{name}"), F.lit(1))
    plain = F.transform(found, lambda t: F.lower(F.replace(t, F.lit("`"), F.lit(""))))
    return F.array_distinct(F.filter(plain, lambda t: ~t.isin("select", "where", "and", "or", "on")))


def sql_columns(statement: Column, op: Column, most: int = 50) -> Column:
    """The columns that a select, update or insert names, in order; none where it selects * or counts."""
    flat = F.trim(F.regexp_replace(statement, r"\s+", " "))
    words = lambda part: F.regexp_extract_all(part, F.lit(r"`?(\w+)`?"), F.lit(1))
    chosen = F.regexp_extract(flat, r"(?i)SELECT\s+(.+?)\s+FROM", 1)
    selected = F.when(F.lower(chosen).contains("count(") | chosen.contains("*"), F.array().cast("array<string>")).otherwise(F.filter(words(chosen), lambda w: ~F.upper(w).isin("AS", "DISTINCT", "FROM")))
    updated = F.regexp_extract_all(F.regexp_extract(flat, r"(?i)SET\s+(.+?)(?:WHERE|$)", 1), F.lit(r"`?(\w+)`?\s*="), F.lit(1))
    inserted = F.filter(words(F.regexp_extract(flat, r"(?i)INSERT\s+INTO\s+\w+\s*\((.+?)\)", 1)), lambda w: F.upper(w) != "VALUES")
    low = F.lower(op)
    return F.slice(F.when(low == "select", selected).when(low == "update", updated).when(low == "insert", inserted).otherwise(F.array().cast("array<string>")), 1, most)


def dao_key(class_name: Column) -> Column:
    """One key for a data-access class and its mapper: the simple name without Dao or Mapper."""
    return F.lower(F.regexp_replace(F.element_at(F.split(class_name, r"\."), -1), "(Dao|DAO|Mapper)$", ""))


def json_of(text: Column) -> Column:
    """A generated text, fences of code aside, if all of it is JSON, else what begins at its first bracket if that is; null otherwise."""
    bare = F.btrim(F.regexp_replace(F.btrim(text), r"(?im)^```(?:json)?\s*|```$", ""), F.lit(" \t\r\n"))
    begun = F.regexp_extract(bare, r"(?s)^[^\[{]*(.*)$", 1)
    return F.coalesce(*(F.when(_is_json(x), x) for x in (bare, begun)))


def _is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else: in an array it must still be one value."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[1]", "variant").isNull()
    return (text != "") & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.coalesce(alone, F.lit(True))


def one_line(text: Column, limit: int) -> Column:
    """White space squeezed to single spaces; of more than ``limit`` characters one less and an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def without_thoughts(text: Column) -> Column:
    """A generated text without its <think> blocks, stripped."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def bean_name(name: Column) -> Column:
    """Decapitalised property name; names that begin with two capitals stay."""
    return F.when(name.rlike("^[A-Z]{2}"), name).otherwise(F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))


def simple_type(signature: Column) -> Column:
    """A type without generics, package and blanks: what stands before the first '<', after its last dot."""
    raw = F.regexp_replace(signature, r"(?s)^([^<]+)<.*$", "$1")
    return F.replace(F.regexp_replace(raw, r"(?s)^.+\.", ""), F.lit(" "), F.lit(""))


# Roles of classes by the ends of their names.
ROLE_SUFFIXES = {"Controller": ["Controller"], "Service": ["Service", "Facade", "Manager"], "Repository": ["Repository", "Dao", "Mapper"]}


def class_role(name: Column) -> Column:
    """Role of a class by its name's suffix, else Other."""
    role = F.lit("Other")
    for kind, suffixes in ROLE_SUFFIXES.items():
        role = F.when(F.coalesce(name, F.lit("")).rlike(f"({'|'.join(suffixes)})$"), kind).otherwise(role)
    return role


# The marks of the parts of a generated text.
SUMMARY, DETAIL = "[摘要]", "[详情]"


def summary_of(text: Column, most: int = 50) -> Column:
    """The summary in a generated text, cut to ``most`` characters: what stands after its mark up to the details' mark or, without one, the line's end; else the first line of five characters or more; else the text's begin."""
    after = F.when(F.instr(text, SUMMARY) > 0, F.substr(text, F.instr(text, SUMMARY) + len(SUMMARY)))
    told = F.when(F.instr(after, DETAIL) > 0, F.substr(after, F.lit(1), F.instr(after, DETAIL) - 1)).otherwise(F.substring_index(after, "\n", 1))
    blank = F.lit(" \t\r\n\x0b\x0c")
    lines = F.transform(F.split(F.btrim(text, blank), "\n"), lambda x: F.ltrim(F.btrim(x, blank), F.lit("#*- ")))
    first = F.try_element_at(F.filter(lines, lambda x: F.length(x) >= 5), F.lit(1))
    return F.substring(F.coalesce(F.nullif(F.btrim(told, blank), F.lit("")), first, text), 1, most)


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text takes: one for each 1.5 characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 1.5).cast("int"))
