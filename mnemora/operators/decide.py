"""Decisions of a model about merges and replacements: prompts, tolerant parsing, bands, the extractor's hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import graph as Gr

G = "graph_id"
#: What a supersession decision may be.
DECISIONS = ("supersedes", "coexist", "contradicts")
MERGE_PROMPT = """Decide for each candidate how likely it is the same real thing as the entity, from 0 to 1.
Answer with JSON alone: {"candidates": [{"key": "...", "confidence": 0.0, "reason": "..."}]}"""
REPLACE_PROMPT = """Decide whether the new relationship replaces the old one, stands beside it, or contradicts it.
Answer with JSON alone: {"decision": "supersedes|coexist|contradicts", "reason": "..."}"""


def hinted(resolved: DataFrame, hints: DataFrame, nodes: DataFrame) -> DataFrame:
    """``resolved`` with the extractor's hints (``graph_id, entity, kind, hint``): a new entity whose hint is a node of its
    kind needs review with that node as its candidate; other hints change nothing."""
    known = nodes.select(G, F.col("key").alias("hint"), "kind").distinct()
    hit = hints.join(known, [G, "hint", "kind"], "left_semi").groupBy(G, "entity").agg(F.min("hint").alias("hint"))
    use = (F.col("decision") == "new") & F.col("hint").isNotNull()
    out = resolved.join(hit, [G, "entity"], "left")
    return out.withColumns({"rule": F.when(use, "extractor_hint").otherwise(F.col("rule")), "candidates": F.when(use, F.array("hint")).otherwise(F.col("candidates")), "decision": F.when(use, "review").otherwise(F.col("decision"))}).drop("hint")


def merge_prompts(reviews: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """``graph_id, entity, candidates, prompt`` of entities under review (``graph_id, entity, name, kind, aliases,
    properties, context, candidates``), every candidate with its rendered neighbourhood."""
    ask = F.to_json(F.struct(F.col("entity").cast("string").alias("entity"), "candidate"))
    offered = reviews.select(G, "entity", F.explode("candidates").alias("candidate"))
    seeds = offered.select(ask.alias("ask"), G, F.col("candidate").alias("key"))
    blocks = Gr.rendered(Gr.neighbourhood(seeds, edges, nodes, depth), nodes, edges)
    shown = offered.withColumn("ask", ask).join(blocks, ["ask", G], "left")
    text = F.concat(F.lit("candidate "), "candidate", F.lit("\n"), F.coalesce("text", F.lit("(no neighbourhood)")))
    each = shown.groupBy(G, "entity").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n\n").alias("shown"))
    said = lambda c: F.coalesce(F.to_json(c), F.lit(""))
    parts = [F.lit(MERGE_PROMPT), F.concat(F.lit("entity "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("kind", F.lit("")), F.lit(")")), F.concat(F.lit("aliases "), said("aliases")), F.concat(F.lit("properties "), said("properties")), F.concat(F.lit("conversation "), F.coalesce(F.nullif("context", F.lit("")), F.lit("(none)"))), F.col("shown")]
    return reviews.join(each, [G, "entity"]).select(G, "entity", "candidates", F.concat_ws("\n\n", *parts).alias("prompt"))


def parsed_candidates(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``graph_id, entity, key, confidence, reason`` from replies (``graph_id, entity, candidates, reply``).

    Only offered keys stay; confidences are clamped to 0 to 1, what isn't a number counts 0; a reply that no repair
    makes JSON gives no rows.
    """
    read = F.from_json(T.repaired_json(reply), "struct<candidates array<struct<key string, confidence string, reason string>>>")
    rows = replies.select(G, "entity", "candidates", F.explode(read["candidates"]).alias("c")).where(F.array_contains("candidates", F.col("c.key")))
    return rows.select(G, "entity", F.col("c.key").alias("key"), T.clamp01(F.col("c.confidence"), 0.0).alias("confidence"), F.coalesce("c.reason", F.lit("")).alias("reason"))


def named_candidates(candidates: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Supersession candidates with ``source_name, old_name, new_name`` and ``old_relation, old_snippet``; unknown names are keys."""
    old = edges.select(G, F.col("id").alias("old_id"), F.col("source_key").alias("_s"), F.col("relation").alias("old_relation"), F.col("target_key").alias("_o"), F.col("snippet").alias("old_snippet"))
    rows = candidates.join(old, [G, "old_id"]).withColumn("_n", F.expr("substr(new_key, length(_s) + length(new_relation) + 5)"))
    for key, name in (("_s", "source_name"), ("_o", "old_name"), ("_n", "new_name")):
        known = nodes.select(G, F.col("key").alias(key), F.col("name").alias(name))
        rows = rows.join(known, [G, key], "left").withColumn(name, F.coalesce(name, key))
    return rows.drop("_s", "_o", "_n")


def replace_prompts(named: DataFrame, context: Column | None = None) -> DataFrame:
    """``named`` candidates with ``prompt``."""
    arrow = lambda r, t: F.concat("source_name", F.lit(" -["), r, F.lit("]-> "), t)
    none = F.lit("(none)")
    parts = [F.lit(REPLACE_PROMPT), F.concat(F.lit("old "), arrow("old_relation", "old_name")), F.concat(F.lit("said "), F.coalesce(F.nullif("old_snippet", F.lit("")), none)), F.concat(F.lit("new "), arrow("new_relation", "new_name")), F.concat(F.lit("conversation "), none if context is None else F.coalesce(F.nullif(context, F.lit("")), none))]
    return named.withColumn("prompt", F.concat_ws("\n\n", *parts))


def parsed_decisions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``replies`` with ``decision`` and ``reason``: whatever isn't a known decision, or no JSON, is ``coexist``."""
    read = F.from_json(T.repaired_json(reply), "struct<decision string, reason string>")
    decision = F.lower(F.btrim(read["decision"]))
    return replies.withColumns({"decision": F.when(decision.isin(*DECISIONS), decision).otherwise("coexist"), "reason": F.when(read.isNull(), "no usable decision").otherwise(F.coalesce(read["reason"], F.lit("")))})


def merge_notes(resolved: DataFrame, best: DataFrame) -> DataFrame:
    """``graph_id, note``: per entity what became of it (``action, rule, target, confidence``), for the journal."""
    j = resolved.join(best.select(G, "entity", F.col("target_key").alias("_t"), "confidence", F.col("decision").alias("_d")), [G, "entity"], "left")
    action = F.when(F.col("decision") == "auto", "auto_merge").when(F.col("decision") == "new", "new").when(F.col("_d") == "merge", "llm_merge").otherwise("new_after_review")
    note = F.create_map(F.lit("entity"), F.col("entity").cast("string"), F.lit("action"), action, F.lit("rule"), F.col("rule"), F.lit("target"), F.coalesce("target_key", "_t", F.lit("")), F.lit("confidence"), F.coalesce(F.col("confidence").cast("string"), F.lit("")))
    return j.select(G, note.alias("note"))
