"""Calls whose targets are known by name only, resolved to methods in steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def method_name(signature: Column) -> Column:
    """A signature's part before its parameters."""
    return F.substring_index(signature, "(", 1)


def resolve_calls(deferred: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """caller_id, target_fqn, callee, target_id, status of every distinct deferred call.

    deferred: caller_id, target_fqn, callee. classes: class_id, package, name, ordinal. methods:
    id, class_id, signature, ordinal. The full name leads to a class (of several of one name the last by ordinal), the class and
    the callee's name to its first method by ordinal, whatever its parameters.
    status: resolved, self (a method that calls itself), no_class or no_method; target_id is null for the
    last two. What is called by very many is resolved once, before the calls are joined to it.
    """
    full = F.when(F.coalesce("package", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name"))
    of_name = classes.groupBy(full.alias("target_fqn")).agg(F.max(F.struct("ordinal", "class_id")).alias("x")).select("target_fqn", "x.class_id")
    of_class = methods.groupBy("class_id", method_name(F.col("signature")).alias("callee")).agg(F.min(F.struct("ordinal", "id")).alias("x")).select("class_id", "callee", F.col("x.id").alias("target_id"))
    calls = deferred.select("caller_id", "target_fqn", "callee").distinct()
    targets = calls.select("target_fqn", "callee").distinct().join(of_name, "target_fqn", "left").join(of_class, ["class_id", "callee"], "left")
    known = calls.join(targets.filter("class_id IS NOT NULL"), ["target_fqn", "callee"], "left")
    status = F.when(F.col("class_id").isNull(), "no_class").when(F.col("target_id").isNull(), "no_method").when(F.col("target_id") == F.col("caller_id"), "self").otherwise("resolved")
    return known.select("caller_id", "target_fqn", "callee", "target_id", status.alias("status"))


def call_edges(resolved: DataFrame, methods: DataFrame) -> DataFrame:
    """source_id, target_id, caller_class, caller_method, callee_class, callee_method of each resolved call once. methods: id, class_name, name."""
    edges = resolved.filter("status = 'resolved'").select(F.col("caller_id").alias("source_id"), "target_id").distinct()
    end = lambda id_, side: methods.select(F.col("id").alias(id_), F.col("class_name").alias(f"{side}_class"), F.col("name").alias(f"{side}_method"))
    return edges.join(end("source_id", "caller"), "source_id", "left").join(end("target_id", "callee"), "target_id", "left").select("source_id", "target_id", "caller_class", "caller_method", "callee_class", "callee_method")
