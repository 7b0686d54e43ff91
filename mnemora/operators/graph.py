"""Graph operators over many graphs and many questions at once.

Every table carries ``graph_id``; every question carries ``ask``. One plan answers one message or a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import RetrievalConfig
from mnemora.runtime import checkpointed, instant

G = "graph_id"


def one_per_key(nodes: DataFrame) -> DataFrame:
    """One row per graph and key: the first written (by instant, then id); repeated rows count once."""
    order = Window.partitionBy(G, "key").orderBy(F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0))), "id")
    return nodes.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def one_per_id(edges: DataFrame) -> DataFrame:
    """Edges without repeated rows; several edges of one key stay several."""
    return edges.dropDuplicates([G, "id"])


def first_per_key(edges: DataFrame) -> DataFrame:
    """One row per graph and edge key: the first written (by instant, then id)."""
    order = Window.partitionBy(G, "key").orderBy(F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0))), "id")
    return edges.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def superseded(properties: Column) -> Column:
    return F.coalesce(F.element_at(properties, "superseded_by"), F.lit("")) != ""


def adjacency(edges: DataFrame) -> DataFrame:
    """``graph_id, from_key, to_key, edge_key, edge_id, direction, strength, share``: both directions of every edge.

    ``share`` is the strength over the sum of all strengths at ``from_key`` (a sum of 0 counts as 1). Sums are
    aggregated map-side and joined back, so a hub's edges never meet in one window.
    """
    both = edges.select(G, F.explode(F.array(F.struct(F.col("source_key").alias("f"), F.col("target_key").alias("t"), F.lit("F").alias("d")), F.struct(F.col("target_key").alias("f"), F.col("source_key").alias("t"), F.lit("R").alias("d")))).alias("x"), "key", "id", "strength")
    both = both.select(G, F.col("x.f").alias("from_key"), F.col("x.t").alias("to_key"), F.col("key").alias("edge_key"), F.col("id").alias("edge_id"), F.col("x.d").alias("direction"), "strength")
    total = both.groupBy(G, "from_key").agg(F.sum("strength").alias("total"))
    return both.join(total, [G, "from_key"]).withColumn("share", F.col("strength") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).drop("total")


def hops(seeds: DataFrame, adj: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> list[DataFrame]:
    """Arriving activation per hop: ``ask, graph_id, key, hop, arrived, forward, reverse`` (seeds are hop 0 with 1.0)."""
    zero = seeds.select("ask", G, "key").distinct().select("*", F.lit(0).alias("hop"), F.lit(1.0).alias("arrived"), F.lit(0.0).alias("forward"), F.lit(0.0).alias("reverse"))
    out = [zero]
    ways = adj.groupBy(G, "from_key", "to_key", "direction").agg(F.sum("share").alias("share"))
    for h in range(1, cfg.max_depth + 1):
        # Only mass that newly arrived travels on; parallel edges were added up beforehand.
        crossed = out[-1].join(ways, [(out[-1][G] == ways[G]), (out[-1]["key"] == ways["from_key"])]).select("ask", out[-1][G], F.col("to_key").alias("key"), "direction", (F.col("arrived") * F.col("share") * cfg.hop_decay).alias("c"))
        if cfg.min_contribution > 0:
            crossed = crossed.where(F.col("c") >= cfg.min_contribution)
        out.append(crossed.groupBy("ask", G, "key").agg(F.lit(h).alias("hop"), F.sum("c").alias("arrived"), F.sum(F.when(F.col("direction") == "F", F.col("c")).otherwise(0.0)).alias("forward"), F.sum(F.when(F.col("direction") == "R", F.col("c")).otherwise(0.0)).alias("reverse")))
    return out


def spreading_activation(seeds: DataFrame, adj: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``ask, graph_id, key, score, hop, direction`` of every reached node: total mass over hops, least hop, main direction."""
    union = None
    for step in hops(seeds, adj, cfg):
        union = step if union is None else union.unionByName(step)
    total = union.groupBy("ask", G, "key").agg(F.round(F.sum("arrived"), 9).alias("score"), F.min("hop").alias("hop"), F.sum("forward").alias("fwd"), F.sum("reverse").alias("rev"))
    direction = F.when(F.col("hop") == 0, "SEED").when(F.round("fwd", 9) >= F.round("rev", 9), "FORWARD").otherwise("REVERSE")
    return total.select("ask", G, "key", "score", "hop", direction.alias("direction"))


def co_episode_boost(activations: DataFrame, nodes: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Adds the boost to nodes that share an episode with a fired one but didn't fire; unreached ones get a row.

    Which nodes fired is decided before boosting.
    """
    fired = activations.where(F.col("score") >= cfg.primary_threshold).select("ask", G, "key")
    episodes = nodes.select(G, "key", F.explode(F.array_distinct(F.array_compact("source_episode_ids"))).alias("episode")).distinct()
    lit = fired.join(episodes, [G, "key"]).select("ask", G, "episode").distinct()
    near = lit.join(episodes, [G, "episode"]).select("ask", G, "key").distinct().join(fired, ["ask", G, "key"], "left_anti").withColumn("boosted", F.lit(True))
    out = activations.join(near, ["ask", G, "key"], "full_outer")
    boost = F.when(F.col("boosted"), cfg.co_episode_boost).otherwise(0.0)
    return out.select("ask", G, "key", F.round(F.coalesce("score", F.lit(0.0)) + boost, 9).alias("score"), "hop", F.coalesce("direction", F.lit("FORWARD")).alias("direction"), F.coalesce("boosted", F.lit(False)).alias("co_episode"))


def select_within_budget(activations: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``ask, graph_id, key, score, rank``: forward and reverse places first, leftovers by score, then one order by score and key."""
    fired = activations.where(F.col("score") >= cfg.primary_threshold)
    reverse = F.col("direction") == "REVERSE"
    order = [F.desc("score"), "key"]
    classed = fired.withColumn("_c", F.row_number().over(Window.partitionBy("ask", G, reverse).orderBy(*order)))
    chosen = F.when(reverse, F.col("_c") <= cfg.node_budget - cfg.forward_budget).otherwise(F.col("_c") <= cfg.forward_budget)
    # Chosen ones come first, leftovers fill up by score: the first `budget` of that order are kept.
    placed = classed.withColumn("_p", F.row_number().over(Window.partitionBy("ask", G).orderBy(chosen.desc(), *order))).where(F.col("_p") <= cfg.node_budget)
    return placed.select("ask", G, "key", "score", "direction", "hop", F.row_number().over(Window.partitionBy("ask", G).orderBy(*order)).alias("rank"))


def neighbourhood(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2) -> DataFrame:
    """``ask, graph_id, key, hop``: nodes within ``depth`` undirected steps of known seeds, with the least number of steps."""
    ways = edges.select(G, F.col("source_key").alias("f"), F.col("target_key").alias("t"))
    ways = ways.unionByName(ways.select(G, F.col("t").alias("f"), F.col("f").alias("t"))).distinct()
    seen = checkpointed(seeds.select("ask", G, "key").distinct().join(nodes.select(G, "key").distinct(), [G, "key"], "left_semi").select("ask", G, "key", F.lit(0).alias("hop")))
    frontier = seen
    for h in range(1, max(0, depth) + 1):
        step = frontier.join(ways, [(frontier[G] == ways[G]), (frontier["key"] == ways["f"])]).select("ask", frontier[G], F.col("t").alias("key")).distinct()
        frontier = step.join(seen.select("ask", G, "key"), ["ask", G, "key"], "left_anti").withColumn("hop", F.lit(h))
        if h < depth:  # used twice more: as frontier and as seen
            frontier = checkpointed(frontier)
        seen = seen.unionByName(frontier)
    return seen


def induced_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are members: ``ask`` and the edge's columns."""
    a = members.select("ask", G, F.col("key").alias("source_key"))
    b = members.select("ask", G, F.col("key").alias("target_key"))
    return edges.join(a, [G, "source_key"]).join(b, ["ask", G, "target_key"], "left_semi")


def memory_lines(selected: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ask, graph_id, line, ord``: statements between selected nodes, superseded ones hidden, equal lines once.

    In the order of the source's rank, then of the edges' instants and ids.
    """
    names = nodes.select(G, "key", "name")
    src = selected.select("ask", G, F.col("key").alias("source_key"), "rank")
    dst = selected.select("ask", G, F.col("key").alias("target_key"))
    live = edges.where(~superseded(F.col("properties")))
    rows = live.join(src, [G, "source_key"]).join(dst, ["ask", G, "target_key"], "left_semi")
    rows = rows.join(names.select(G, F.col("key").alias("source_key"), F.col("name").alias("sn")), [G, "source_key"]).join(names.select(G, F.col("key").alias("target_key"), F.col("name").alias("tn")), [G, "target_key"])
    line = F.concat("sn", F.lit(" -["), "relation", F.lit("]-> "), "tn")
    first = rows.select("ask", G, line.alias("line"), F.struct("rank", F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0))).alias("at"), "id").alias("o")).groupBy("ask", G, "line").agg(F.min("o").alias("o"))
    return first.select("ask", G, "line", F.row_number().over(Window.partitionBy("ask", G).orderBy("o")).alias("ord"))


def _top_snippets(selected: DataFrame, edges: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``ask, graph_id, key, rank, n, id, snippet``: the strongest snippets around each hot node."""
    hot = selected.where(F.col("score") >= cfg.secondary_threshold).select("ask", G, "key", "rank")
    said = edges.where(~superseded(F.col("properties")) & (F.coalesce("snippet", F.lit("")) != ""))
    at = F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0))).alias("at")
    ends = said.select(G, F.col("source_key").alias("key"), F.lit(0).alias("d"), "strength", at, "id", "snippet").unionByName(said.select(G, F.col("target_key").alias("key"), F.lit(1).alias("d"), "strength", at, "id", "snippet"))
    order = Window.partitionBy("ask", G, "key").orderBy(F.desc("strength"), "d", "at", "id")
    return hot.join(ends, [G, "key"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cfg.max_snippets)


def snippets(selected: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``ask, graph_id, key, edge_id, snippet, ord``: the strongest snippets around hot nodes, equal texts once per question.

    Order: strength, outgoing before incoming, then instant and id.
    """
    first = _top_snippets(selected, edges, cfg).groupBy("ask", G, "snippet").agg(F.min(F.struct("rank", "n", "key", "id")).alias("o"))
    return first.select("ask", G, F.col("o.key").alias("key"), F.col("o.id").alias("edge_id"), "snippet", F.row_number().over(Window.partitionBy("ask", G).orderBy("o")).alias("ord"))


def context_text(lines: DataFrame, snips: DataFrame) -> DataFrame:
    """``ask, graph_id, memory_block, context_block, text``: the rendered blocks of each question, snippets in quotes."""
    snips = snips.withColumn("snippet", F.concat(F.lit('"'), "snippet", F.lit('"')))

    def block(df: DataFrame, text: str, head: str, name: str) -> DataFrame:
        joined = df.groupBy("ask", G).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text))), lambda r: r[text]), "\n").alias("t"))
        return joined.select("ask", G, F.concat(F.lit(head + "\n"), "t").alias(name))

    out = block(lines, "line", "[MEMORY]", "memory_block").join(block(snips, "snippet", "[CONTEXT]", "context_block"), ["ask", G], "full_outer")
    return out.select("ask", G, "memory_block", "context_block", F.concat_ws("\n\n", "memory_block", "context_block").alias("text"))


def injections(selected: DataFrame, edges: DataFrame, nodes: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``ask, graph_id, edge_key, source, relation, relation_phrase, target, snippet``: what a context injects, one row per edge key.

    Edges between selected nodes, and those whose snippet is among a hot node's strongest (with the snippet, whether
    or not another node said the same); superseded ones are hidden.
    """
    live = edges.where(~superseded(F.col("properties")))
    src = selected.select("ask", G, F.col("key").alias("source_key"))
    dst = selected.select("ask", G, F.col("key").alias("target_key"))
    inner = live.join(src, [G, "source_key"]).join(dst, ["ask", G, "target_key"], "left_semi").select("ask", G, "key", "source_key", "relation", "target_key", F.lit(None).cast("string").alias("snippet"))
    top = _top_snippets(selected, edges, cfg).select("ask", G, F.col("id"), F.col("snippet"))
    told = top.join(live.select(G, "id", "key", "source_key", "relation", "target_key"), [G, "id"]).select("ask", G, "key", "source_key", "relation", "target_key", "snippet")
    rows = inner.unionByName(told).groupBy("ask", G, "key").agg(F.min(F.struct("source_key", "relation", "target_key")).alias("e"), F.max("snippet").alias("snippet"))
    names = nodes.select(G, "key", "name")
    rows = rows.select("ask", G, F.col("key").alias("edge_key"), "e.*", "snippet")
    rows = rows.join(names.select(G, F.col("key").alias("source_key"), F.col("name").alias("source")), [G, "source_key"]).join(names.select(G, F.col("key").alias("target_key"), F.col("name").alias("target")), [G, "target_key"])
    return rows.select("ask", G, "edge_key", "source", "relation", F.replace(F.lower("relation"), F.lit("_"), F.lit(" ")).alias("relation_phrase"), "target", "snippet")


def rendered(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``ask, graph_id, text``: the subgraph that ``members`` (``ask, graph_id, key``) span, as sorted lines.

    A node's line has its key, name, aliases and properties (lists and maps as JSON), an edge's line both keys around
    the relation; nodes come first.
    """
    own = members.select("ask", G, "key").distinct()
    listed = F.when(F.size("aliases") > 0, F.concat(F.lit(", aliases="), F.to_json("aliases"))).otherwise("")
    held = F.when(F.size("properties") > 0, F.concat(F.lit(", properties="), F.to_json("properties"))).otherwise("") if "properties" in nodes.columns else F.lit("")
    node_line = F.concat(F.lit("- "), "key", F.lit(" (name="), F.coalesce("name", F.lit("")), F.coalesce(listed, F.lit("")), F.coalesce(held, F.lit("")), F.lit(")"))
    lines = own.join(nodes, [G, "key"]).select("ask", G, F.lit(0).alias("part"), "key", node_line.alias("line"))
    inner = induced_edges(own, edges).select("ask", G, F.lit(1).alias("part"), "key", F.concat(F.lit("  "), "source_key", F.lit(" -["), "relation", F.lit("]-> "), "target_key").alias("line")).distinct()
    rows = lines.unionByName(inner).groupBy("ask", G).agg(F.array_sort(F.collect_list(F.struct("part", "key", "line"))).alias("r"))
    return rows.select("ask", G, F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


def event_trace(seeds: DataFrame, adj: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``ask, graph_id, hop, edge_id, from_key, to_key, direction, contribution, running``: every crossing and the mass so far at its end."""
    steps = hops(seeds, adj, cfg)
    out = None
    for h in range(1, cfg.max_depth + 1):
        f = steps[h - 1]
        c = f.join(adj, [(f[G] == adj[G]), (f["key"] == adj["from_key"])]).select("ask", f[G], F.lit(h).alias("hop"), "edge_id", "from_key", "to_key", "direction", (F.col("arrived") * F.col("share") * cfg.hop_decay).alias("contribution"))
        out = c if out is None else out.unionByName(c)
    w = Window.partitionBy("ask", G, "to_key").orderBy("hop", "edge_id", "direction").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seeded = seeds.select("ask", G, F.col("key").alias("to_key")).distinct().withColumn("s", F.lit(1.0))
    out = out.join(seeded, ["ask", G, "to_key"], "left")
    return out.select("ask", G, "hop", "edge_id", "from_key", "to_key", "direction", F.round("contribution", 9).alias("contribution"), F.round(F.coalesce("s", F.lit(0.0)) + F.sum("contribution").over(w), 9).alias("running"))
