"""Functions on source text: accessors, names in signatures, bean properties, table definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import bean_name


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _filled(text: Column) -> Column:
    """The text without outer blanks; null where nothing is left."""
    return F.nullif(_stripped(text), F.lit(""))


def statements(code: Column) -> Column:
    """The statements between the first opening and the last closing brace; none without a body."""
    body = F.regexp_extract(F.coalesce(code, F.lit("")), r"(?s)^[^{]*\{(.*)\}[^}]*$", 1)
    return F.filter(F.transform(F.split(body, ";"), _stripped), lambda s: s != "")


def accessor_kind(name: Column, code: Column, fields: Column) -> Column:
    """``getter``, ``setter`` or ``none``: a bean prefix before one of the class's fields, and a body of that shape.

    A getter's body is one return; a setter's one or two statements that assign or return, one of them an assignment.
    """
    body = statements(code)
    owns = lambda prefix: name.startswith(prefix) & F.coalesce(F.array_contains(fields, bean_name(F.substr(name, F.lit(len(prefix) + 1)))), F.lit(False))
    returns = (F.size(body) == 1) & F.coalesce(F.get(body, 0).startswith("return "), F.lit(False))
    sets = lambda s: s.contains("=") & ~s.startswith("return") & ~s.startswith("if")
    assigns = F.size(body).between(1, 2) & F.forall(body, lambda s: sets(s) | s.startswith("return")) & F.exists(body, lambda s: sets(s) & ~s.contains("=="))
    return F.when((owns("get") | owns("is")) & returns, "getter").when(owns("set") & assigns, "setter").otherwise("none")


def mapper_class(location: Column) -> Column:
    """The lower-case mapper class that a source location names; the empty text if none."""
    path = F.replace(F.coalesce(location, F.lit("")), F.lit("\\"), F.lit("/"))
    found = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    return F.lower(F.coalesce(found(r"(?i)/(\w+Mapper)\.java:"), found(r"(?i)(\w+Mapper)\.java"), F.lit("")))


def method_name(name: Column, signature: Column) -> Column:
    """A method's lower-case name: its own, else the last word before the signature's parenthesis."""
    head = F.when(signature.contains("("), F.substring_index(signature, "(", 1))
    word = F.element_at(F.split(_stripped(F.replace(head, F.lit("@"), F.lit(" "))), r"\s+"), -1)
    return F.lower(F.coalesce(_filled(name), F.substring_index(word, ".", -1), F.lit("")))


def snippet(text: Column, first: Column, last: Column, most: int = 12_000) -> Column:
    """The lines from the first to the last, from one on, without outer blanks; cut to ``most`` characters with "..." for the rest. Null for no such range."""
    lines = F.slice(F.split(text, "\n"), F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0)))
    cut = F.btrim(F.array_join(lines, "\n"), F.lit(" \t\r\n\x0b\x0c"))
    return F.when((first >= 1) & (last >= first), F.when(F.length(cut) > most, F.concat(F.substring(cut, 1, most), F.lit("..."))).otherwise(cut))


def create_tables(text: Column) -> Column:
    """Array of (name, ddl) of the quoted CREATE TABLE statements that name an engine."""
    pattern = F.lit(r"(?s)CREATE TABLE\s+`(\w+)`\s*\(.*?\)\s*ENGINE")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("ddl"))


def bean_calls(code: Column) -> Column:
    """Array of (class_name, field) in order: property calls on variables whose class the code tells.

    ``new`` decides a variable's class, the last one if several; else its first declaration with a capital type.
    """
    part = lambda pattern, group: F.regexp_extract_all(code, F.lit(pattern), F.lit(group))
    made, typed, used = r"\w+\s+(\w+)\s*=\s*new\s+(\w+)", r"(\w+)(?:<[^>]+>)?\s+(\w+)\s*[=;]", r"(\w+)\.(?:set|get|is)(\w+)\("
    news = F.reverse(F.arrays_zip(part(made, 1).alias("v"), part(made, 2).alias("t")))
    declared = F.filter(F.arrays_zip(part(typed, 2).alias("v"), part(typed, 1).alias("t")), lambda x: x["t"].rlike("^[A-Z]"))
    known = F.concat(news, declared)
    uses = F.arrays_zip(part(used, 1).alias("v"), part(used, 2).alias("f"))
    own = lambda k, u: F.get(F.filter(k, lambda x: x["v"] == u["v"]), 0)["t"]
    field = lambda f: F.when(f.rlike("^[A-Z][a-z]"), F.concat(F.lower(F.substring(f, 1, 1)), F.substr(f, F.lit(2)))).otherwise(f)
    found = lambda k: F.filter(F.transform(uses, lambda u: F.struct(own(k, u).alias("class_name"), field(u["f"]).alias("field"))), lambda x: x["class_name"].isNotNull())
    return F.get(F.transform(F.array(known), found), 0)  # what is known is made out once a text, not once a use


def embed_text(name: Column, kind: Column, owner: Column, *more: Column) -> Column:
    """What is embedded of an entity: owner, name, kind, then what is there of location, signature and path."""
    return F.concat_ws(" ", owner, name, kind, *(F.nullif(m, F.lit("")) for m in more))


def service_module(service_id: Column) -> Column:
    """A service's module: its id without scheme; null for none."""
    return _filled(F.regexp_replace(_stripped(service_id), "^service://", ""))


def endpoint_method(endpoint_id: Column, attribute: Column) -> Column:
    """The method behind an endpoint: the attribute, else the id before ``#api``; null for none."""
    return F.coalesce(_filled(attribute), _filled(F.regexp_extract(_stripped(endpoint_id), r"(?s)^(.+)#api$", 1)))
