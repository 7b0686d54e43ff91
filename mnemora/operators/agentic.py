"""Tool calls of extraction sessions against the graph: one round takes at most one call of every session.

Calls of one session build on each other, so rounds follow one another; the sessions of a round are one set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora import config
from mnemora.functions import text as T
from mnemora.operators import consolidate as C
from mnemora.operators import decide as De
from mnemora.operators import resolve as R
from mnemora.runtime import canonical_name, checkpointed, instant

G = "graph_id"
TOOLS = ("add_entity", "add_relationship", "finish_extraction")
#: Arguments of the three tools, as column types.
ENTITY_ARGUMENTS = "struct<text string, type string, confidence string, properties map<string,string>, aliases array<string>, candidate_merge_key string>"
RELATIONSHIP_ARGUMENTS = "struct<source string, relation string, target string, confidence string, stability string, ttl_days string, cardinality string, evidence string, snippet string, properties map<string,string>>"
FINISH_ARGUMENTS = "struct<summary string, importance string, tags array<string>>"
Decider = Callable[[DataFrame], DataFrame] | None


def tool_schemas() -> list[dict]:
    """The tools as JSON schemas for a chat model, made from the column types that read their arguments."""

    def properties(fields: str) -> dict:
        kinds = {"string": {"type": "string"}, "array<string>": {"type": "array", "items": {"type": "string"}}, "map<string,string>": {"type": "object"}}
        return {n: kinds[k] for n, k in (f.split(" ", 1) for f in fields[len("struct<") : -1].split(", "))}

    required = {"add_entity": ["text", "type"], "add_relationship": ["source", "relation", "target"], "finish_extraction": ["summary"]}
    arguments = (ENTITY_ARGUMENTS, RELATIONSHIP_ARGUMENTS, FINISH_ARGUMENTS)
    return [{"type": "function", "function": {"name": n, "parameters": {"type": "object", "properties": properties(a), "required": required[n]}}} for n, a in zip(TOOLS, arguments, strict=True)]


def name_keys(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``names`` (``graph_id, name``) with ``key``: the first written node of that canonical name or alias, null without one; raw keys don't count."""
    order = F.struct(F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0))).alias("at"), F.col("id").alias("i"))
    forms = F.array_union(F.array(canonical_name("name")), F.transform(F.array_compact(F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: canonical_name(a)))
    first = nodes.select(G, "key", order.alias("o"), F.explode(forms).alias("_canon")).groupBy(G, "_canon").agg(F.min_by("key", "o").alias("key"))
    return names.withColumn("_canon", canonical_name("name")).join(first, [G, "_canon"], "left").drop("_canon")


def relationship_ends(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls (``graph_id, source, target``) with ``source_key, target_key`` and ``made_source, made_target``.

    One unknown end becomes a provisional OTHER node (its key is in ``made_*`` too); two unknown ends stay null.
    """
    out = calls
    for end in ("source", "target"):
        found = name_keys(calls.select(G, F.col(end).alias("name")).distinct(), nodes)
        out = out.join(found.select(G, F.col("name").alias(end), F.col("key").alias(f"{end}_key")), [G, end], "left")
    for end, other in (("source", "target"), ("target", "source")):
        out = out.withColumn(f"made_{end}", F.when(F.col(f"{end}_key").isNull() & F.col(f"{other}_key").isNotNull(), T.node_key(F.lit("OTHER"), end)))
    return out.withColumns({f"{e}_key": F.coalesce(f"{e}_key", f"made_{e}") for e in ("source", "target")})


def merge_plan(staged: DataFrame, nodes: DataFrame, edges: DataFrame, self_keys: DataFrame, disambiguate: Decider) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``remap`` (``graph_id, entity, target_key``), merge ``notes`` and ``flagged`` merges of staged entities.

    ``staged`` has ``graph_id, entity, name, kind, aliases, properties, context, hint``. Rules, then hints, then the
    model for what needs review; without a model what needs review is new.
    """
    resolved = De.hinted(R.resolve(staged.select(G, "entity", "name", "kind"), nodes, self_keys), staged.where("hint is not null").select(G, "entity", "kind", "hint"), nodes)
    resolved = checkpointed(resolved)
    remap = resolved.where("decision = 'auto'").select(G, "entity", "target_key")
    best = None
    if disambiguate is not None:
        reviews = resolved.where("decision = 'review'").select(G, "entity", "rule", "candidates")
        asked = reviews.join(staged, [G, "entity"])
        prompts = De.merge_prompts(asked, nodes, edges).join(reviews.select(G, "entity", "rule"), [G, "entity"])
        answer = disambiguate(prompts)
        scored = De.parsed_candidates(answer) if "reply" in answer.columns else answer
        scored = scored if "reason" in scored.columns else scored.withColumn("reason", F.lit(""))
        best = checkpointed(R.banded(scored, [G, "entity"]))
        remap = remap.unionByName(best.where("decision = 'merge'").select(G, "entity", "target_key"))
    else:
        best = remap.limit(0).withColumns({"confidence": F.lit(0.0), "decision": F.lit("new"), "flagged": F.lit(False)})
    flagged = best.where("flagged").select(G, F.create_map(F.lit("entity"), F.col("entity").cast("string"), F.lit("target"), F.col("target_key"), F.lit("confidence"), F.col("confidence").cast("string")).alias("note"))
    return checkpointed(remap), De.merge_notes(resolved, best), flagged


def replacements(staged_edges: DataFrame, edges: DataFrame, nodes: DataFrame, known: DataFrame, supersede: Decider) -> DataFrame:
    """Decided supersessions of staged edges; without a model old and new coexist."""
    candidates = C.supersession_candidates(staged_edges, edges, known)
    if supersede is None:
        return candidates.limit(0)
    answer = supersede(De.replace_prompts(De.named_candidates(candidates, edges, nodes)))
    return De.parsed_decisions(answer) if "reply" in answer.columns else answer


def apply_round(calls: DataFrame, nodes: DataFrame, edges: DataFrame, self_keys: DataFrame, now: str, disambiguate: Decider = None, supersede: Decider = None) -> dict[str, DataFrame]:
    """What ``apply_write`` gives for one round of calls (``session_id, graph_id, episode_id, tool, arguments``), and ``results``.

    ``results`` has ``session_id, result, touched`` (the final key of an added entity). Arguments that aren't JSON,
    unknown tools and invalid entities or relationships change nothing and say so. A relationship is checked strictly:
    nothing is coerced.
    """
    calls = checkpointed(calls.withColumn("parsed", F.try_parse_json("arguments").isNotNull()))
    usable = calls.where("parsed")
    read = lambda tool, kind: usable.where(F.col("tool") == tool).withColumn("a", F.from_json("arguments", kind))
    # Entities.
    e = read("add_entity", ENTITY_ARGUMENTS).select("session_id", G, "episode_id", F.btrim(F.coalesce("a.text", F.lit(""))).alias("name"), F.upper(F.btrim(F.coalesce("a.type", F.lit("")))).alias("kind"), T.clamp01(F.col("a.confidence"), config.DEFAULT_CONFIDENCE).alias("confidence"), T.clean_list("a.aliases").alias("aliases"), F.coalesce("a.properties", F.create_map().cast("map<string,string>")).alias("properties"), T.nullish("a.candidate_merge_key").alias("hint"))
    e = checkpointed(e.withColumn("error", F.when((F.col("name") == "") | (F.col("kind") == ""), "error: text and type are required").when(~F.col("kind").isin(*config.NODE_KINDS), "error: unknown entity type")))
    good = e.where("error is null").withColumn("own", T.node_key("kind", "name"))
    remap, notes, merge_flags = merge_plan(good.select(G, F.col("session_id").alias("entity"), "name", "kind", "aliases", "properties", F.col("name").alias("context"), "hint"), nodes, edges, self_keys, disambiguate)
    final = checkpointed(good.join(remap.withColumnRenamed("entity", "session_id"), [G, "session_id"], "left").withColumn("key", F.coalesce("target_key", "own")))
    episode = F.array("episode_id").alias("source_episode_ids")
    staged = final.select(G, "key", F.col("session_id").alias("seq"), "name", "kind", "aliases", "confidence", "properties", episode)
    # Relationships.
    r = read("add_relationship", RELATIONSHIP_ARGUMENTS).select("session_id", G, "episode_id", F.btrim(F.coalesce("a.source", F.lit(""))).alias("source"), F.btrim(F.coalesce("a.target", F.lit(""))).alias("target"), T.strict_relation(F.coalesce("a.relation", F.lit(""))).alias("relation"), T.clamp01(F.col("a.confidence"), config.DEFAULT_CONFIDENCE).alias("confidence"), F.coalesce(T.nullish("a.stability"), F.lit("stable")).alias("stability"), T.nullish("a.ttl_days").try_cast("int").alias("ttl_days"), F.coalesce(T.nullish("a.cardinality"), F.lit("one_to_many")).alias("cardinality"), F.coalesce("a.evidence", F.lit("")).alias("evidence"), F.coalesce("a.snippet", F.lit("")).alias("snippet"), F.coalesce("a.properties", F.create_map().cast("map<string,string>")).alias("properties"))
    r = C.validated_edges(relationship_ends(r, nodes))
    missing = (F.col("source") == "") | (F.col("target") == "") | (F.col("relation") == "")
    r = checkpointed(r.withColumn("error", F.when(missing, "error: source, target and relation are required").when(F.col("source_key").isNull(), "error: neither end exists yet").otherwise(F.concat(F.lit("error: "), "reason"))).drop("reason"))
    ends = [r.where(F.col(f"made_{x}").isNotNull() & ~missing).select(G, F.col(f"made_{x}").alias("key"), F.col("session_id").alias("seq"), F.col(x).alias("name"), F.lit("OTHER").alias("kind"), F.array().cast("array<string>").alias("aliases"), F.lit(0.5).alias("confidence"), F.create_map(F.lit(config.PROVISIONAL), F.lit("true")).alias("properties"), F.array().cast("array<string>").alias("source_episode_ids")) for x in ("source", "target")]
    made = ends[0].unionByName(ends[1])
    written = r.where("error is null").select(G, F.col("session_id").alias("seq"), "source_key", "relation", "target_key", "confidence", "stability", "ttl_days", "cardinality", "evidence", "snippet", "properties", episode).withColumn("key", T.edge_key("source_key", "relation", "target_key"))
    both = staged.unionByName(made)
    decided = checkpointed(replacements(written, edges, nodes, nodes.select(G, "key").unionByName(both.select(G, "key")), supersede))
    out = C.apply_write(nodes, edges, both, written, decided, edges.limit(0).select(G, F.col("key").alias("edge")), now)
    # What each call is told.
    there = nodes.select(G, "key", F.lit(True).alias("_k"))
    told_entities = final.join(there, [G, "key"], "left").select("session_id", F.when(F.col("_k"), F.concat(F.lit("merged into "), "key")).otherwise(F.concat(F.lit("created "), "key")).alias("result"), F.col("key").alias("touched"))
    stored = edges.select(G, "key", F.lit(True).alias("_k")).distinct()
    replaced = decided.groupBy(G, F.col("new_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    told_edges = written.join(stored, [G, "key"], "left").join(replaced, [G, "key"], "left")
    told_edges = told_edges.select(F.col("seq").alias("session_id"), F.when(F.col("n") > 0, F.concat(F.lit("added "), "key", F.lit("; superseded "), F.col("n").cast("string"))).when(F.col("_k"), F.concat(F.lit("reinforced "), "key")).otherwise(F.concat(F.lit("added "), "key")).alias("result"), F.lit(None).cast("string").alias("touched"))
    wrong = lambda df, text: df.select("session_id", text.alias("result"), F.lit(None).cast("string").alias("touched"))
    results = told_entities.unionByName(told_edges).unionByName(wrong(e.where("error is not null"), F.col("error"))).unionByName(wrong(r.where("error is not null"), F.col("error")))
    results = results.unionByName(wrong(calls.where("not parsed"), F.lit("error: arguments aren't JSON"))).unionByName(wrong(usable.where(~F.col("tool").isin(*TOOLS)), F.concat(F.lit("error: unknown tool "), "tool"))).unionByName(wrong(usable.where("tool = 'finish_extraction'"), F.lit("finished")))
    return out | {"results": results, "notes": notes, "merge_flags": merge_flags}
