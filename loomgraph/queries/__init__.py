"""Registered queries: name -> function of (spark, sf_dir), and the SQL each must agree with."""

from __future__ import annotations

from loomgraph.queries import contexts, facts, graphs, lineage, relational, vocabulary, resolution, retrieval, sessions, stores, structure, views  # noqa: F401
from loomgraph.queries._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
