"""From messages to seeds: nouns, hashed vectors, mean-centred search, threshold and margin gates, relation seeds; then the whole read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import RetrievalConfig
from mnemora.functions import text as T
from mnemora.functions import vectors as V
from mnemora.operators import graph as Gr
from mnemora.operators.consolidate import index_inputs
from mnemora.runtime import checkpointed

G = "graph_id"


def message_nouns(messages: DataFrame, text: str = "message") -> DataFrame:
    """``ask, graph_id, noun, ord`` of messages (``ask, graph_id`` and a text)."""
    return messages.select("ask", G, F.posexplode(T.nouns(text)).alias("ord", "noun"))


def noun_hits(nouns: DataFrame, index: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``graph_id, noun, key, score, rank``: the best index entries of each noun of a graph, in mean-centred space.

    ``index`` has ``graph_id, key, text``. Vectors stay sparse, and centring is algebra on inner products:
    (q-m)(v-m) = qv - qm - vm + mm, so the only join is on (graph, bucket) and no dense vector or cross join is made.
    Distinct nouns of a graph are searched once, however many messages hold them.
    """
    size = cfg.embed_dimensions
    texts = index.select(G, "key", T.tokens("text").alias("tokens"))
    v = V.sparse_vectors(texts, [G, "key"], dimensions=size)
    n = texts.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    sums = v.groupBy(G, "bucket").agg(F.sum("weight").alias("s"))
    mean = sums.join(n, G).select(G, "bucket", F.when(F.col("n") > 1, F.col("s") / F.col("n")).otherwise(0.0).alias("mean"))
    mm = mean.groupBy(G).agg(F.sum(F.col("mean") * F.col("mean")).alias("mm"))
    vm = v.join(mean, [G, "bucket"]).groupBy(G, "key").agg(F.sum(F.col("weight") * F.col("mean")).alias("vm"), F.sum(F.col("weight") * F.col("weight")).alias("vv"))
    q = nouns.select(G, "noun").distinct().select(G, "noun", V.token_bucket(F.col("noun"), size).alias("bucket"), V.token_sign(F.col("noun")).alias("sign"))
    qm = q.join(mean, [G, "bucket"], "left").select(G, "noun", (F.col("sign") * F.coalesce("mean", F.lit(0.0))).alias("qm"))
    qv = q.join(v, [G, "bucket"]).groupBy(G, "noun", "key").agg(F.sum(F.col("sign") * F.col("weight")).alias("qv"))
    # Entries that share no bucket with the noun have qv = 0; they can still rank, as in a search over the whole index.
    every = qm.join(vm, G).join(mm, G).join(qv, [G, "noun", "key"], "left")
    qv0 = F.coalesce("qv", F.lit(0.0))
    norm = F.sqrt((1 - 2 * F.col("qm") + F.col("mm")) * (F.col("vv") - 2 * F.col("vm") + F.col("mm")))
    score = F.round((qv0 - F.col("qm") - F.col("vm") + F.col("mm")) / F.when(norm <= 1e-12, 1.0).otherwise(norm), 9)
    order = Window.partitionBy(G, "noun").orderBy(F.desc("score"), "key")
    ranked = every.select(G, "noun", "key", score.alias("score")).where("score >= 0").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= max(cfg.seed_top_k, 2))


def gated(hits: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), margin: bool = True) -> DataFrame:
    """``graph_id, noun, key, score, rank`` of accepted hits: above the threshold, or a best hit clearly ahead of the next."""
    next_score = F.coalesce(F.lead("score").over(Window.partitionBy(G, "noun").orderBy("rank")), F.lit(0.0))
    ahead = (F.col("rank") == 1) & (F.col("score") >= cfg.seed_margin_floor) & (F.col("score") - next_score >= cfg.seed_margin)
    keep = F.col("score") >= cfg.seed_similarity
    return hits.withColumn("_ok", keep | ahead if margin else keep).where("_ok").drop("_ok")


def seed_keys(accepted: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, noun, key`` of seeds: node hits that exist, and both ends of all edges of a relation hit."""
    own = accepted.where(~T.is_relation_key("key")).join(nodes.select(G, "key").distinct(), [G, "key"], "left_semi").select(G, "noun", "key")
    relations = edges.select(G, "relation", F.explode(F.array("source_key", "target_key")).alias("end")).distinct()
    via = accepted.where(T.is_relation_key("key")).select(G, "noun", T.relation_of_key("key").alias("relation")).join(relations, [G, "relation"]).select(G, "noun", F.col("end").alias("key"))
    return own.unionByName(via).distinct()


def find_seeds(messages: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), text: str = "message") -> DataFrame:
    """``ask, graph_id, key``: the seeds of each message."""
    nouns = message_nouns(messages, text)
    seeds = seed_keys(gated(noun_hits(nouns, index_inputs(nodes, edges), cfg), cfg), nodes, edges)
    return nouns.join(seeds, [G, "noun"]).select("ask", G, "key").distinct()


def read(messages: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), text: str = "message") -> dict[str, DataFrame]:
    """Everything one read yields, for any number of messages: seeds, activations, selected nodes, lines, snippets, context."""
    nodes, edges = Gr.one_per_key(nodes), Gr.one_per_id(edges)
    return read_from_seeds(find_seeds(messages, nodes, edges, cfg, text), nodes, edges, cfg)


def read_from_seeds(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> dict[str, DataFrame]:
    # Each of these feeds several branches, so each is computed once.
    seeds = checkpointed(seeds)
    active = checkpointed(Gr.co_episode_boost(checkpointed(Gr.spreading_activation(seeds, Gr.adjacency(edges), cfg)), nodes, cfg))
    chosen = checkpointed(Gr.select_within_budget(active, cfg))
    lines, snips = Gr.memory_lines(chosen, edges, nodes), Gr.snippets(chosen, edges, cfg)
    return {"seeds": seeds, "activations": active, "selected": chosen, "lines": lines, "snippets": snips, "context": Gr.context_text(lines, snips), "injections": Gr.injections(chosen, edges, nodes, cfg)}


def traversed(activations: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``ask, graph_id, edge``: edges crossed by a read, the rows of its reinforcement log."""
    start = activations.where(F.col("hop") < cfg.max_depth).select("ask", G, F.col("key").alias("end"))
    ends = edges.select(G, F.col("key").alias("edge"), F.explode(F.array("source_key", "target_key")).alias("end"))
    return start.join(ends, [G, "end"]).select("ask", G, "edge").distinct()


def read_trace_rows(messages: DataFrame, got: dict[str, DataFrame], cfg: RetrievalConfig = RetrievalConfig(), text: str = "message") -> DataFrame:
    """One trace row per message: preview, seeds, selected in order, fired scores, token estimate."""
    seeds = got["seeds"].groupBy("ask", G).agg(F.array_sort(F.collect_set("key")).alias("seeds"))
    chosen = got["selected"].groupBy("ask", G).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda r: r["key"]).alias("selected"))
    fired = got["activations"].where(F.col("score") >= cfg.primary_threshold).groupBy("ask", G).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.round("score", 4).alias("s"))))).alias("fired"))
    base = messages.select("ask", G, F.lit("read").alias("event"), T.preview(text).alias("message_preview"))
    out = base.join(seeds, ["ask", G], "left").join(chosen, ["ask", G], "left").join(fired, ["ask", G], "left").join(got["context"].select("ask", G, T.token_estimate("text").alias("context_tokens_estimate")), ["ask", G], "left")
    return out.withColumn("context_tokens_estimate", F.coalesce("context_tokens_estimate", F.lit(0)))


def find_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ask, graph_id, key`` of the first node with the asked name or an alias of that form, else with the asked raw key."""
    canon = T.canonical_name
    forms = nodes.select(G, "key", F.explode(F.array_union(F.array(canon("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: canon(a)))).alias("canon"), F.struct(F.coalesce(Gr.instant("created_at"), F.timestamp_seconds(F.lit(0))).alias("at"), "id").alias("o"))
    by_name = names.withColumn("canon", canon("name")).join(forms, [G, "canon"]).groupBy("ask", G).agg(F.min_by("key", "o").alias("k1"))
    by_key = names.join(nodes.select(G, F.col("key").alias("name"), F.col("key").alias("k2")), [G, "name"]).select("ask", G, "k2")
    return names.select("ask", G).join(by_name, ["ask", G], "left").join(by_key, ["ask", G], "left").select("ask", G, F.coalesce("k1", "k2").alias("key")).where("key is not null")


def retrieve_memory(names: DataFrame, nodes: DataFrame, edges: DataFrame, episodes: DataFrame, depth: int = 2) -> dict[str, DataFrame]:
    """Neighbourhood, relationships and stored episodes (of the node and of those relationships) of named nodes."""
    found = checkpointed(find_nodes(names, nodes))
    near = Gr.neighbourhood(found, edges, nodes, depth)
    inner = Gr.induced_edges(near, edges)
    ids = inner.select("ask", G, F.explode("source_episode_ids").alias("episode")).unionByName(found.join(nodes, [G, "key"]).select("ask", G, F.explode("source_episode_ids").alias("episode"))).where("episode is not null").distinct()
    stored = ids.join(episodes.select(G, F.col("id").alias("episode"), "summary").dropDuplicates([G, "episode"]), [G, "episode"])
    return {"node": found, "neighbourhood": near, "relationships": inner, "episodes": stored}
