"""Evaluation of end-to-end campaigns: probes against rendered contexts, sessions against graph deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import holds_all, holds_any


def _given(array: str) -> Column:
    return F.coalesce(F.col(array), F.array().cast("array<string>"))


def probe_results(probes: DataFrame, contexts: DataFrame, most_selected: int = 8) -> DataFrame:
    """``probe_id`` with ``failures``, the expectations that its context doesn't meet.

    ``probes`` has ``probe_id, contains_all, contains_any, excludes, expect_empty, expect_nonempty, max_selected``,
    ``contexts`` has ``probe_id, text, selected``. Substrings are compared without letter case; absent ones expect nothing.
    """
    j = probes.join(contexts, "probe_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    chosen = F.size(F.coalesce("selected", F.array().cast("array<string>")))
    checks = [
        F.when(~holds_all(F.col("text"), _given("contains_all")), "contains_all"),
        F.when((F.size(_given("contains_any")) > 0) & ~holds_any(F.col("text"), _given("contains_any")), "contains_any"),
        F.when(holds_any(F.col("text"), _given("excludes")), "excludes"),
        F.when(F.coalesce("expect_empty", F.lit(False)) & (F.btrim("text") != ""), "expect_empty"),
        F.when(F.coalesce("expect_nonempty", F.lit(False)) & (F.btrim("text") == ""), "expect_nonempty"),
        F.when(chosen > F.coalesce("max_selected", F.lit(most_selected)), "max_selected"),
    ]
    return j.select("probe_id", F.array_compact(F.array(*checks)).alias("failures"))


def session_results(expectations: DataFrame, names: DataFrame, counters: DataFrame) -> DataFrame:
    """``session_id`` with ``failures``: wanted names that no node has, unwanted ones that one has, and counters out of bounds.

    ``expectations`` has ``session_id, has_node_any (array of arrays), lacks_node_terms, max_nodes_created,
    min_edges_created, min_edges_superseded``; ``names`` has ``session_id, name``; ``counters`` has ``session_id,
    nodes_created, edges_created, edges_superseded``.
    """
    known = names.groupBy("session_id").agg(F.collect_set(F.lower("name")).alias("known"))
    j = expectations.join(known, "session_id", "left").join(counters, "session_id", "left").withColumn("known", _given("known"))
    held = lambda term: F.exists("known", lambda n: F.contains(n, F.lower(term)))
    missing = F.exists(F.coalesce("has_node_any", F.array().cast("array<array<string>>")), lambda group: ~F.exists(group, held))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    checks = [
        F.when(missing, "has_node_any"),
        F.when(F.exists(_given("lacks_node_terms"), held), "lacks_node_terms"),
        F.when(count("nodes_created") > F.col("max_nodes_created"), "max_nodes_created"),
        F.when(count("edges_created") < F.col("min_edges_created"), "min_edges_created"),
        F.when(count("edges_superseded") < F.col("min_edges_superseded"), "min_edges_superseded"),
    ]
    return j.select("session_id", F.array_compact(F.array(*checks)).alias("failures"))


def summary(results: DataFrame) -> DataFrame:
    """One row: how many were checked, passed and failed."""
    return results.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.size("failures") == 0).alias("passed"), F.count_if(F.size("failures") > 0).alias("failed"))


def unfinished(sessions: DataFrame, done: DataFrame) -> DataFrame:
    """Sessions that a resumed run still has to do."""
    return sessions.join(done.select("session_id").distinct(), "session_id", "left_anti")
