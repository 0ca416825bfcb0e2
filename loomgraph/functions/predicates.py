"""Predicates on paths, methods and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders of builds, of sources that they generate, and of what they compile.
BUILD_DIRS = ["target", "build"]
GENERATED_DIRS = ["generated-sources", "generated-test-sources", "generated", "apt"]
ARTEFACT_DIRS = ["classes", "test-classes", "maven-status", "maven-archiver", "surefire-reports", "failsafe-reports", "site", "dependency", "antrun"]
# Types of entities that stand for code.
CODE_TYPES = ["file", "module", "package", "class", "interface", "method", "field", "parameter", "service", "api_endpoint"]


def _below_build(path: Column) -> Column:
    """The path's parts below its first build folder; null outside of one."""
    parts = F.split(path, "/")
    first = F.array_min(F.transform(F.array(*(F.array_position(parts, d) for d in BUILD_DIRS)), lambda i: F.when(i > 0, i))).cast("int")
    return F.when(first.isNotNull(), F.slice(parts, first + 1, F.size(parts)))


def is_generated(path: Column) -> Column:
    """Whether a file lies among the sources that a build generated."""
    return F.coalesce(F.arrays_overlap(_below_build(path), F.array(*map(F.lit, GENERATED_DIRS))), F.lit(False))


def is_source_path(path: Column, with_generated: bool = True) -> Column:
    """Whether a file counts as source: outside of builds, or generated (if wanted) and no artefact."""
    below = _below_build(path)
    kept = is_generated(path) & ~F.arrays_overlap(below, F.array(*map(F.lit, ARTEFACT_DIRS))) if with_generated else F.lit(False)
    return below.isNull() | F.coalesce(kept, F.lit(False))


def is_code_type(entity_type: Column) -> Column:
    """Whether an entity's type, in any case, stands for code."""
    return F.coalesce(F.lower(entity_type).isin(CODE_TYPES), F.lit(False))


def is_trivial_accessor(name: Column, signature: Column, flagged: Column) -> Column:
    """Whether a method is a getter or setter: flagged as one, or named and shaped like one."""
    sig = F.trim(F.coalesce(signature, name))
    inside = F.regexp_extract(sig, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    params = F.size(F.filter(F.split(inside, ","), lambda p: F.trim(p) != ""))
    shaped = sig.rlike(r"(?s)^[^(]*\(.*\)")
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    guessed = shaped & (((trimmed.startswith("get") | trimmed.startswith("is")) & (params == 0)) | (trimmed.startswith("set") & (params == 1)))
    return F.coalesce(flagged, F.lit(False)) | F.coalesce(guessed, F.lit(False))


def is_controller_like(class_name: Column) -> Column:
    """Whether a class takes requests, by its name."""
    return F.coalesce(class_name.contains("Controller") | class_name.contains("Resource") | class_name.contains("Api"), F.lit(False))


def is_method_node(node_id: Column, entity_type: Column) -> Column:
    """Whether a node is a method, by either spelling of its id or by its type."""
    return node_id.startswith("method://") | node_id.startswith("method//") | F.coalesce(F.lower(entity_type) == "method", F.lit(False))
