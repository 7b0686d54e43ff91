"""Queries of the graph, retrieval, resolution and write operators over the memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora import config
from mnemora.config import RetrievalConfig
from mnemora.functions import vectors as V
from mnemora.functions.text import STOP_WORDS
from mnemora.operators import agentic as A
from mnemora.operators import consolidate as C
from mnemora.operators import context as Co
from mnemora.operators import decide as De
from mnemora.operators import graph as Gr
from mnemora.operators import resolve as R
from mnemora.operators import retrieve as Re
from mnemora.plans.sqltext import CTES, NOW, RETRIEVAL, canon, inlist, sql, tokens
from mnemora.runtime import checkpointed, instant, table

#: Edges written from here on count as the new ones of write queries; the earlier ones as stored.
CUT = "2025-08-01 00:00:00"
LOW = RetrievalConfig(primary_threshold=0.05, secondary_threshold=0.20)


def nodes(s: SparkSession, d: str) -> DataFrame:
    return Gr.one_per_key(table(s, d, "nodes"))


def edges(s: SparkSession, d: str) -> DataFrame:
    return Gr.one_per_id(table(s, d, "edges"))


def trace_seeds(s: SparkSession, d: str) -> DataFrame:
    """Seeds of every recorded read that are nodes of its graph."""
    seeds = table(s, d, "read_trace").select(F.col("read_id").alias("ask"), "graph_id", F.explode("seeds").alias("key")).distinct()
    return seeds.join(nodes(s, d).select("graph_id", "key"), ["graph_id", "key"], "left_semi")


def activations(s: SparkSession, d: str, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    return Gr.co_episode_boost(checkpointed(Gr.spreading_activation(trace_seeds(s, d), Gr.adjacency(edges(s, d)), cfg)), nodes(s, d), cfg)


def chosen(s: SparkSession, d: str, cfg: RetrievalConfig = LOW) -> DataFrame:
    return checkpointed(Gr.select_within_budget(activations(s, d, cfg), cfg))


def messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "read_trace").groupBy(F.col("read_id").alias("ask"), "graph_id").agg(F.min("message_preview").alias("message"))


def noun_scores(s: SparkSession, d: str) -> DataFrame:
    return checkpointed(Re.noun_hits(Re.message_nouns(messages(s, d)), C.index_inputs(nodes(s, d), edges(s, d))))


def split_edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored edges (one per key: the first) and newly staged ones with their order."""
    at = F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0)))
    e = edges(s, d).withColumn("at", at)
    old = e.where(F.col("at") < F.to_timestamp(F.lit(CUT)))
    old = old.withColumn("r", F.row_number().over(Window.partitionBy("graph_id", "key").orderBy("at", "id"))).where("r = 1").drop("r")
    new = e.where(F.col("at") >= F.to_timestamp(F.lit(CUT)))
    return old, new.withColumn("seq", F.struct("at", "id"))


def staged_entities(s: SparkSession, d: str) -> DataFrame:
    rec = table(s, d, "node_records").where("name is not null and kind is not null").dropDuplicates(["rec_id"])
    return rec.select("graph_id", F.col("rec_id").alias("entity"), "name", "kind")


def staged_node_rows(s: SparkSession, d: str) -> DataFrame:
    rec = table(s, d, "node_records").where("name is not null and kind is not null").dropDuplicates(["rec_id"])
    conf = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.lit(config.DEFAULT_CONFIDENCE))
    key = F.concat("kind", F.lit("::"), R.canonical_name("name"))
    told = F.create_map(F.lit("rec"), F.col("rec_id").cast("string"), F.lit("kind"), F.col("kind"))
    return rec.select("graph_id", key.alias("key"), F.col("rec_id").alias("seq"), "name", "kind", "aliases", conf.alias("confidence"), "source_episode_ids", told.alias("properties"))


def _listed(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as sorted joined text, so that any engine compares them alike."""
    return df.withColumns({a: F.array_join(F.array_sort(F.array_compact(F.coalesce(a, F.array().cast("array<string>")))), "|") for a in arrays})


def _er(match):
    def run(s: SparkSession, d: str) -> DataFrame:
        base = staged_entities(s, d).select("graph_id", "entity", "kind", R.canonical_name("name").alias("canon")).withColumn("key", F.concat("kind", F.lit("::"), "canon")).distinct()
        return match(base, nodes(s, d)).select("graph_id", "entity", "target_key").distinct()

    return run


def _knn(s: SparkSession, d: str, k: int = 3) -> DataFrame:
    v = V.centred(table(s, d, "embeddings").select("vec_id", "embedding"))
    return V.nearest(v.where("vec_id % 100 = 0"), v, k, "vec_id", "vec_id").select("q_id", "v_id", F.round("score", 6).alias("score"), "rank")


def _retrieved(s: SparkSession, d: str) -> dict[str, DataFrame]:
    names = table(s, d, "read_trace").where(F.get("seeds", F.lit(0)).isNotNull()).groupBy(F.col("read_id").alias("ask"), "graph_id").agg(F.min(F.get("seeds", F.lit(0))).alias("key"))
    names = names.select("ask", "graph_id", F.replace(F.substring_index("key", "::", -1), F.lit("_"), F.lit(" ")).alias("name"))
    return Re.retrieve_memory(names, nodes(s, d), edges(s, d), table(s, d, "episodes"), 1)


def _supersession(s: SparkSession, d: str) -> DataFrame:
    old, new = split_edges(s, d)
    return C.supersession_candidates(new, old).drop("seq")


def _superseded_edges(s: SparkSession, d: str) -> DataFrame:
    old, new = split_edges(s, d)
    out = C.apply_supersessions(old, C.supersession_candidates(new, old), NOW)
    return out.select("graph_id", "id", "strength", F.element_at("properties", "superseded_by").alias("by"), "updated_at")


def _upserted_edges(s: SparkSession, d: str) -> DataFrame:
    old, new = split_edges(s, d)
    out = C.upsert_edges(old.drop("at"), new, NOW)
    return _listed(out, "source_episode_ids").select("graph_id", "key", "source_key", "relation", "target_key", F.round("strength", 6).alias("strength"), "confidence", "snippet", "evidence", "source_episode_ids", "updated_at", "outcome", "mentions")


def _upserted_nodes(s: SparkSession, d: str) -> DataFrame:
    out = C.upsert_nodes(nodes(s, d), staged_node_rows(s, d), NOW)
    held = F.array_join(F.array_sort(F.transform(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "|")
    return _listed(out, "aliases", "source_episode_ids").select("graph_id", "key", "name", "kind", "aliases", "confidence", "source_episode_ids", held.alias("properties"), "updated_at", "outcome", "mentions")


def _written(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """One whole write: recorded nodes and new edges into the stored graph, every candidate replaced, recorded traversals applied."""
    old, new = split_edges(s, d)
    return C.apply_write(nodes(s, d), old.drop("at"), staged_node_rows(s, d), new.drop("at"), C.supersession_candidates(new, old), _traversals(s, d), NOW)


def _hinted(s: SparkSession, d: str) -> DataFrame:
    """Recorded entities with the key they were written under as the extractor's hint."""
    n = nodes(s, d)
    resolved = R.resolve(staged_entities(s, d), n, C.first_edge_self(edges(s, d)))
    hints = table(s, d, "node_records").where("name is not null and kind is not null").select("graph_id", F.col("rec_id").alias("entity"), "kind", F.col("key").alias("hint")).distinct()
    return _listed(De.hinted(resolved, hints, n).select("graph_id", "entity", "rule", "decision", "candidates"), "candidates")


def _model_candidates(s: SparkSession, d: str) -> DataFrame:
    """Recorded confidences as a model's fenced reply about each kind of node of a graph; only stored keys were offered."""
    rec = table(s, d, "node_records").where("key is not null and kind is not null").select("graph_id", "kind", "key", "confidence", "rec_id").distinct()
    told = F.struct("key", F.col("confidence").cast("string").alias("confidence"), F.col("rec_id").cast("string").alias("reason"))
    replies = rec.groupBy("graph_id", F.col("kind").alias("entity")).agg(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.collect_list(told).alias("candidates"))), F.lit("\n```")).alias("reply"))
    offered = nodes(s, d).groupBy("graph_id").agg(F.collect_set("key").alias("candidates"))
    return De.parsed_candidates(replies.join(offered, "graph_id")).withColumn("confidence", F.round("confidence", 6))


def _model_decisions(s: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("stability") == "mutable", "SUPERSEDES ").when(F.col("stability") == "time_bound", "contradicts").when(F.col("stability") == "stable", "perhaps").otherwise("coexist")
    reply = F.when(F.col("stability") == "ephemeral", F.lit("no idea")).otherwise(F.concat(F.lit('{"decision": "'), said, F.lit('", "reason": "r",}')))
    return De.parsed_decisions(edges(s, d).select("graph_id", "id", reply.alias("reply"))).select("graph_id", "id", "decision", "reason")


def _relationship_ends(s: SparkSession, d: str) -> DataFrame:
    """Calls that name a node by its recorded name and another by an alias, or by a name nobody has."""
    rec = table(s, d, "node_records").where("name is not null").select("graph_id", "rec_id", F.col("name").alias("source"), F.coalesce(F.get(F.array_compact("aliases"), F.lit(0)), F.concat(F.lit("nobody "), F.col("rec_id").cast("string"))).alias("target")).distinct()
    return A.relationship_ends(rec, nodes(s, d)).select("graph_id", "rec_id", "source", "target", "source_key", "target_key", "made_source", "made_target")


def _traversals(s: SparkSession, d: str) -> DataFrame:
    """Edges with both ends selected in one read, as a traversal log."""
    sel = table(s, d, "read_trace").select("read_id", "graph_id", F.explode(F.array_distinct(F.array_compact("selected"))).alias("k")).distinct()
    a, b = sel.select("read_id", "graph_id", F.col("k").alias("source_key")), sel.select("read_id", "graph_id", F.col("k").alias("target_key"))
    return edges(s, d).select("graph_id", "source_key", "target_key", "key").distinct().join(a, ["graph_id", "source_key"]).join(b, ["read_id", "graph_id", "target_key"]).select("graph_id", F.col("key").alias("edge"))


def _deliveries_delta(s: SparkSession, d: str) -> DataFrame:
    """Changes between every two deliveries of a graph that follow one another (differing rows of a key: the smallest counts)."""
    snaps = table(s, d, "node_snapshots")
    order = Window.partitionBy("graph_id").orderBy("snapshot_no")
    pairs = snaps.select("graph_id", "snapshot_no").distinct().withColumn("to_no", F.lead("snapshot_no").over(order)).where("to_no is not null")
    rows = snaps.groupBy("graph_id", "snapshot_no", "key").agg(F.min(F.struct("name", "kind", "confidence")).alias("m")).select("graph_id", "snapshot_no", "key", "m.*")
    before = rows.join(pairs, ["graph_id", "snapshot_no"])
    after = rows.join(pairs.select("graph_id", F.col("to_no").alias("snapshot_no")), ["graph_id", "snapshot_no"]).withColumn("to_no", F.col("snapshot_no"))
    return C.graph_delta(before, after, ["graph_id", "to_no", "key"], ["name", "kind", "confidence"])


def _bands(s: SparkSession, d: str) -> DataFrame:
    cand = table(s, d, "node_records").where("confidence between 0 and 1").select("graph_id", "kind", "key", "confidence").distinct()
    return R.banded(cand, ["graph_id", "kind"])


QUERIES = {
    "j01_missing_ends": lambda s, d: C.missing_ends(edges(s, d), nodes(s, d)),
    "j02_adjacency": lambda s, d: Gr.adjacency(edges(s, d)).select("graph_id", "from_key", "to_key", "edge_id", "direction", F.round("share", 6).alias("share")),
    "a01_incident_strength": lambda s, d: Gr.adjacency(edges(s, d)).groupBy("graph_id", "from_key").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("strength"), 4).alias("strength")),
    "g01_neighbourhood": lambda s, d: Gr.neighbourhood(trace_seeds(s, d), edges(s, d), nodes(s, d), 2),
    "proj14_induced_edges": lambda s, d: Gr.induced_edges(chosen(s, d), edges(s, d)).select("ask", "graph_id", "id"),
    "g03_spread_activation": lambda s, d: Gr.spreading_activation(trace_seeds(s, d), Gr.adjacency(edges(s, d))).withColumn("score", F.round("score", 6)),
    "g06_co_episode_boost": lambda s, d: activations(s, d, LOW).select("ask", "graph_id", "key", F.round("score", 6).alias("score"), "direction", "co_episode"),
    "g07_budget_select": lambda s, d: chosen(s, d).select("ask", "graph_id", "key", "direction", "rank"),
    "g08_memory_lines": lambda s, d: Gr.memory_lines(chosen(s, d), edges(s, d), nodes(s, d)),
    "w06_top_snippets": lambda s, d: Gr.snippets(chosen(s, d), edges(s, d), LOW),
    "g08_context_text": lambda s, d: Re.read_from_seeds(trace_seeds(s, d), nodes(s, d), edges(s, d), LOW)["context"].select("ask", "graph_id", "text"),
    "g09_event_trace": lambda s, d: Gr.event_trace(trace_seeds(s, d), Gr.adjacency(edges(s, d)), RetrievalConfig(max_depth=1)).select("ask", "graph_id", "edge_id", "to_key", "direction", F.round("contribution", 6).alias("contribution"), F.round("running", 6).alias("running")),
    "g09_event_trace_deep": lambda s, d: Gr.event_trace(trace_seeds(s, d), Gr.adjacency(edges(s, d))),
    "s30_index_inputs": lambda s, d: C.index_inputs(nodes(s, d), edges(s, d)),
    "j06_nearest_vectors": _knn,
    "a16_corpus_mean": lambda s, d: table(s, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")),
    "w01_noun_hits": lambda s, d: noun_scores(s, d).select("graph_id", "noun", "key", F.round("score", 5).alias("score"), "rank"),
    "w02_margin_gate": lambda s, d: Re.gated(noun_scores(s, d)).select("graph_id", "noun", "key", "rank"),
    "g11_find_seeds": lambda s, d: Re.find_seeds(messages(s, d), nodes(s, d), edges(s, d)),
    "y01_read": lambda s, d: Co.contexts(messages(s, d), table(s, d, "nodes"), table(s, d, "edges")),
    "g10_assemble_context": lambda s, d: Gr.neighbourhood(Re.message_nouns(messages(s, d)).join(Re.seed_keys(Re.gated(noun_scores(s, d), margin=False), nodes(s, d), edges(s, d)), ["graph_id", "noun"]).select("ask", "graph_id", "key").distinct(), edges(s, d), nodes(s, d), 2).groupBy("ask", "graph_id").agg(F.count(F.lit(1)).alias("members")),
    "j08_er_exact": _er(R.exact_matches),
    "j09_er_alias": _er(R.alias_matches),
    "j10_er_abbreviation": _er(R.abbreviation_matches),
    "j11_er_fuzzy": _er(R.fuzzy_matches),
    "j12_er_token_overlap": _er(R.token_matches),
    "w10_er_resolution": lambda s, d: _listed(R.resolve(staged_entities(s, d), nodes(s, d), C.first_edge_self(edges(s, d))), "candidates"),
    "w08_bands": _bands,
    "w11_first_edge_self": lambda s, d: C.first_edge_self(edges(s, d)),
    "j14_remapped_edges": lambda s, d: R.remapped(edges(s, d), C.first_edge_self(edges(s, d)).select("graph_id", F.lit("PERSON::user").alias("old_key"), F.col("self_key").alias("new_key"))).select("graph_id", "id", "key"),
    "j15_supersession": _supersession,
    "m08_superseded_edges": _superseded_edges,
    "m06_upserted_nodes": _upserted_nodes,
    "m07_upserted_edges": _upserted_edges,
    "a14_write_counters": lambda s, d: _written(s, d)["counters"],
    "m15_sticky_self": lambda s, d: C.sticky_self(C.first_edge_self(split_edges(s, d)[0]), C.first_edge_self(split_edges(s, d)[1])),
    "j13_hinted_entities": _hinted,
    "j27_known_forms": lambda s, d: C.known_forms(nodes(s, d)),
    "f30_model_candidates": _model_candidates,
    "f31_model_decisions": _model_decisions,
    "m12_relationship_ends": _relationship_ends,
    "g02_rendered_graphs": lambda s, d: Gr.rendered(nodes(s, d).select(F.col("graph_id").alias("ask"), "graph_id", "key"), nodes(s, d).withColumns({c: F.lit(None).cast(k) for c, k in (("aliases", "array<string>"), ("properties", "map<string,string>"))}), edges(s, d)),
    "g08_injections": lambda s, d: Gr.injections(chosen(s, d), edges(s, d), nodes(s, d), LOW),
    "m09_reinforced_edges": lambda s, d: C.reinforce(edges(s, d), _traversals(s, d), NOW).select("graph_id", "id", F.round("strength", 6).alias("strength"), "updated_at"),
    "a13_reinforced": lambda s, d: C.reinforce(edges(s, d), _traversals(s, d)).select("graph_id", "id", F.round("strength", 6).alias("strength")),
    "y15_decayed_graph": lambda s, d: C.decay_edges(edges(s, d), NOW).groupBy("graph_id").agg(F.count_if("decayed").alias("decayed"), F.count_if("dormant").alias("dormant"), F.round(F.sum("strength"), 3).alias("strength")),
    "k02_decay_due": lambda s, d: edges(s, d).groupBy("graph_id").agg(F.max(instant("updated_at")).alias("last")).select("graph_id", C.decay_due(F.col("last"), F.to_timestamp(F.lit(NOW))).alias("due")),
    "proj15_graph_snapshot": lambda s, d: C.decay_edges(edges(s, d), NOW).select("graph_id", "id", "source_key", "relation", "target_key", F.round("strength", 4).alias("strength"), "dormant", F.element_at("properties", "superseded_by").alias("superseded_by")),
    "j29_orphans": lambda s, d: C.orphans(nodes(s, d), edges(s, d)),
    "j32_graph_delta": _deliveries_delta,
    "j30_index_sync": lambda s, d: C.index_sync_plan(table(s, d, "node_snapshots").select("graph_id", "key").distinct(), nodes(s, d).select("graph_id", "key")),
    "j24_found_nodes": lambda s, d: _retrieved(s, d)["node"],
    "y14_retrieve_memory": lambda s, d: _retrieved(s, d)["relationships"].select("ask", "graph_id", "id"),
    "j23_episodes": lambda s, d: _retrieved(s, d)["episodes"].select("ask", "graph_id", "episode"),
    "proj13_validated_edges": lambda s, d: C.validated_edges(edges(s, d)).groupBy(F.coalesce("reason", F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n")),
    "a18_health": lambda s, d: nodes(s, d).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("kind").alias("kinds")).join(edges(s, d).groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("relation").alias("relations")), "graph_id", "full_outer"),
    "k17_last_read": lambda s, d: table(s, d, "read_trace").groupBy("graph_id").agg(F.max(F.struct("ts", "received_at", "read_id")).alias("m")).select("graph_id", "m.read_id"),
    "s29_high_water": lambda s, d: table(s, d, "read_trace").select("graph_id", "read_id").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("graph_id").orderBy("read_id"))).join(table(s, d, "read_trace").where("ts < '2025-06-01'").groupBy("graph_id").agg(F.countDistinct("read_id").alias("done")), "graph_id", "left").where(F.col("turn") > F.coalesce("done", F.lit(0))).groupBy("graph_id").agg(F.count(F.lit(1)).alias("pending")),
    "s14_conversation_jsonl": lambda s, d: C.conversation_jsonl(table(s, d, "documents").withColumn("conv_id", F.col("speaker")), "conv_id", "doc_id", ["doc_id", "speaker", "lang", "text"]),
}

_NOUN_SEARCH = (
    "tk as (select graph_id, key, unnest(" + tokens("text") + ") as t from idx)",
    "vs as (select graph_id, key, ('0x' || substr(sha1(t), 1, 8))::bigint % 256 as b, sum(case when ('0x' || substr(sha1(t), 9, 2))::int % 2 = 1 then 1.0::double else -1.0::double end) as w from tk group by all having sum(case when ('0x' || substr(sha1(t), 9, 2))::int % 2 = 1 then 1 else -1 end) <> 0)",
    "v as (select graph_id, key, b, w / sqrt(sum(w * w) over (partition by graph_id, key)) as w from vs)",
    "mean as (select graph_id, b, case when max(c.n) > 1 then sum(w) / max(c.n) else 0.0 end as m from v join (select graph_id, count(*) as n from idx group by graph_id) c using (graph_id) group by all)",
    "mm as (select graph_id, sum(m * m) as mm from mean group by graph_id)",
    "vm as (select graph_id, key, sum(w * m) as vm, sum(w * w) as vv from v join mean using (graph_id, b) group by all)",
    "msg as (select read_id, graph_id, min(message_preview) as m from read_trace group by all)",
    f"q0 as (select distinct graph_id, noun from (select graph_id, unnest({tokens('m')}) as noun from msg) where length(noun) > 1 and noun not in ({inlist(STOP_WORDS)}))",
    "q as (select graph_id, noun, ('0x' || substr(sha1(noun), 1, 8))::bigint % 256 as b, case when ('0x' || substr(sha1(noun), 9, 2))::int % 2 = 1 then 1.0::double else -1.0::double end as sign from q0)",
    "qm as (select graph_id, noun, b, sign, sign * coalesce(m, 0.0) as qm from q left join mean using (graph_id, b))",
    "sc as (select qm.graph_id, noun, vm.key, coalesce(v.w * sign, 0.0) - qm - vm + mm as top, sqrt((1 - 2 * qm + mm) * (vv - 2 * vm + mm)) as norm from qm join vm on vm.graph_id = qm.graph_id join mm on mm.graph_id = qm.graph_id left join v on v.graph_id = qm.graph_id and v.key = vm.key and v.b = qm.b)",
    "sr as (select graph_id, noun, key, round(top / case when norm <= 1e-12 then 1.0 else norm end, 9) as score from sc)",
    "hits as (select *, row_number() over (partition by graph_id, noun order by score desc, key) as rank from sr where score >= 0 qualify rank <= 3)",
    "gate as (select *, coalesce(lead(score) over (partition by graph_id, noun order by rank), 0.0) as nxt from hits)",
    "acc as (select * from gate where score >= 0.30 or (rank = 1 and score >= 0.15 and score - nxt >= 0.15))",
)
_STAGED = f"st as (select distinct graph_id, rec_id as entity, kind, {canon('name')} as canon, kind || '::' || {canon('name')} as key from node_records where name is not null and kind is not null)"
_NC = f"nc as (select graph_id, kind, key as target_key, {canon('name')} as canon, aliases from n)"
_GROUPS = "g as (select unnest([" + ", ".join("[" + inlist(g) + "]" for g in R.ABBREVIATIONS) + f"]) as names, unnest(range({len(R.ABBREVIATIONS)})) as grp)"
_TOK = "list_distinct(list_filter(string_split({}, '_'), lambda t: t <> ''))"
_FUZZY = "case when greatest(length(st.canon), length(nc.canon)) = 0 then 1.0 else 1 - levenshtein(st.canon, nc.canon) / greatest(length(st.canon), length(nc.canon)) end > 0.8"
_TA, _TB = _TOK.format("st.canon"), _TOK.format("nc.canon")
_OVERLAP = f"len(list_filter(list_intersect({_TA}, {_TB}), lambda t: length(t) >= 2)) > 0 and (len(list_intersect({_TA}, {_TB})) in (len({_TA}), len({_TB})) or len(list_intersect({_TA}, {_TB})) / len(list_distinct(list_concat({_TA}, {_TB}))) >= 0.5)"


def _more(query: str, *extra: str) -> str:
    """Adds CTEs between the shared ones and the final select (marked by a line that starts with --)."""
    head, _, last = query.rpartition("\n--\n")
    return (head + ",\n" if head else "with ") + ",\n".join(extra) + "\n" + last


def _with(select: str, *names: str, extra: tuple[str, ...] = ()) -> str:
    return _more(sql("\n--\n" + select, *names).replace("\n\n--\n", "\n--\n"), *extra) if extra else sql(select, *names)


_CUTTS = f"timestamptz '{CUT}+00'"
_OLDNEW = (
    "ea as (select *, coalesce(try_cast(created_at as timestamptz), to_timestamp(0)) as ts0 from e)",
    f"old as (select * from ea where ts0 < {_CUTTS} qualify row_number() over (partition by graph_id, key order by ts0, id) = 1)",
    f"new as (select * from ea where ts0 >= {_CUTTS})",
    "lold as (select * from old where coalesce(properties['superseded_by'], '') = '')",
    """cand as (select o.graph_id, o.id as old_id, o.key as old_key, w.key as new_key, w.relation as new_relation, w.ts0, w.id as new_id
        from new w join lold o on o.graph_id = w.graph_id and o.source_key = w.source_key
        where (o.target_key = w.target_key and o.relation <> w.relation) or (o.relation = w.relation and o.target_key <> w.target_key and 'one_to_one' in (o.cardinality, w.cardinality)))""",
    "sup as (select graph_id, old_id, old_key, new_relation, new_key, ts0, new_id from cand qualify row_number() over (partition by graph_id, old_id, new_relation order by ts0, new_id, new_key) = 1)",
)
_UPSERT = f"""
  u as (select * from new where source_key <> target_key),
  f as (select graph_id, key, first(source_key order by ts0, id) as s, first(relation order by ts0, id) as r, first(target_key order by ts0, id) as t,
        first(confidence order by confidence desc, ts0, id) as bc, first(snippet order by confidence desc, ts0, id) as bs, first(evidence order by confidence desc, ts0, id) as be, count(*) as k, flatten(list(coalesce(source_episode_ids, []))) as ep from u group by graph_id, key),
  up as (select coalesce(o.graph_id, f.graph_id) as graph_id, coalesce(o.key, f.key) as key, coalesce(o.source_key, f.s) as source_key, coalesce(o.relation, f.r) as relation, coalesce(o.target_key, f.t) as target_key,
        round(case when o.key is null then 100 else least(o.strength + 15 * coalesce(f.k, 0), 100) end, 6) as strength,
        case when o.key is null or coalesce(f.bc > o.confidence, false) then f.bc else o.confidence end as confidence,
        case when o.key is null or coalesce(f.bc > o.confidence, false) then f.bs else o.snippet end as snippet,
        case when o.key is null or coalesce(f.bc > o.confidence, false) then f.be else o.evidence end as evidence,
        array_to_string(list_sort(list_filter(case when f.key is null then coalesce(o.source_episode_ids, []) else list_distinct(list_concat(coalesce(o.source_episode_ids, []), f.ep)) end, lambda x: x is not null)), '|') as source_episode_ids,
        case when f.key is null then o.updated_at else '{NOW}' end as updated_at,
        case when o.key is null then 'created' when f.key is null then 'kept' else 'reinforced' end as outcome, coalesce(f.k, 0) as mentions
        from old o full join f on o.graph_id = f.graph_id and o.key = f.key)""".strip()
_DAYS = f"greatest(0.0::double, (epoch_us(timestamptz '{NOW}+00') - epoch_us(try_cast(updated_at as timestamptz))) / 86400e6)"
_RATE = "case stability " + " ".join(f"when '{k}' then {v}" for k, v in config.DECAY_PER_DAY.items()) + " end"
_DEC = f"dec as (select *, strength * exp(-({_RATE}) * {_DAYS}) as s1 from e)"
_TRAVERSED = (
    "sel as (select distinct read_id, graph_id, k from (select read_id, graph_id, unnest(selected) as k from read_trace) where k is not null)",
    "ek as (select distinct graph_id, source_key, target_key, key from e)",
    "trav as (select ek.graph_id, ek.key from ek join sel a on a.graph_id = ek.graph_id and a.k = ek.source_key join sel b on b.read_id = a.read_id and b.graph_id = ek.graph_id and b.k = ek.target_key)",
)
_LOW = {"primary": 0.05, "secondary": 0.20}
_NAMES = (
    "nm as (select read_id as ask, graph_id, replace(split_part(min(seeds[1]), '::', 2), '_', ' ') as name from read_trace where seeds[1] is not null group by all)",
    f"forms as (select graph_id, key, coalesce(try_cast(created_at as timestamptz), to_timestamp(0)) as ts0, id, {canon('form')} as canon from (select graph_id, key, created_at, id, unnest(list_concat([name], coalesce(aliases, []))) as form from n))",
    f"byname as (select nm.ask, nm.graph_id, first(forms.key order by ts0, id) as k1 from nm join forms on forms.graph_id = nm.graph_id and forms.canon = {canon('nm.name')} group by all)",
    "node as (select nm.ask, nm.graph_id, coalesce(b.k1, n.key) as key from nm left join byname b using (ask, graph_id) left join n on n.graph_id = nm.graph_id and n.key = nm.name where coalesce(b.k1, n.key) is not null)",
    "around as (select ask, graph_id, key from node union select x.ask, x.graph_id, b.to_key from node x join bothways b on b.graph_id = x.graph_id and b.from_key = x.key)",
    "rel as (select a.ask, e.* from around a join e on e.graph_id = a.graph_id and e.source_key = a.key join around c on c.ask = a.ask and c.graph_id = a.graph_id and c.key = e.target_key)",
)


def _er_sql(condition: str, *extra: str, source: str = "st join nc on st.graph_id = nc.graph_id and st.kind = nc.kind") -> str:
    return _with(f"select distinct st.graph_id, st.entity, nc.target_key from {source} where {condition}", "n", extra=(_STAGED, _NC, *extra))


_EXACT, _ALIAS = "st.key = nc.target_key", f"list_contains(list_transform(coalesce(nc.aliases, []), lambda a: {canon('a')}), st.canon) and st.canon <> ''"
_ABBR = "exists (select 1 from g where list_contains(g.names, st.canon) and list_contains(g.names, nc.canon))"

SQL = {
    "j01_missing_ends": sql("select distinct x.graph_id, x.key, x.k as end from (select graph_id, key, unnest([source_key, target_key]) as k from e) x left join n on n.graph_id = x.graph_id and n.key = x.k where n.key is null", "n", "e"),
    "j02_adjacency": sql("select graph_id, from_key, to_key, edge_id, direction, round(share, 6) as share from adj", "e", "bothways", "adj"),
    "a01_incident_strength": sql("select graph_id, from_key, count(*) as degree, round(sum(strength), 4) as strength from bothways group by all", "e", "bothways"),
    "g01_neighbourhood": _with("select ask, graph_id, key, min(hop) as hop from (select ask, graph_id, key, 0 as hop from seeds union all select ask, graph_id, key, 1 from one union all select o.ask, o.graph_id, b.to_key, 2 from one o join bothways b on b.graph_id = o.graph_id and b.from_key = o.key) group by ask, graph_id, key", "n", "e", "bothways", "seeds", extra=("one as (select distinct s.ask, s.graph_id, b.to_key as key from seeds s join bothways b on b.graph_id = s.graph_id and b.from_key = s.key)",)),
    "proj14_induced_edges": sql("select b.ask, b.graph_id, b.id from (select a.ask, e.graph_id, e.id, e.target_key as key from pick a join e on a.graph_id = e.graph_id and a.key = e.source_key) b join pick c on c.ask = b.ask and c.graph_id = b.graph_id and c.key = b.key", *RETRIEVAL[:17], "pick", **_LOW),
    "g03_spread_activation": sql("select ask, graph_id, key, round(score, 6) as score, hop, direction from act", *RETRIEVAL[:10]),
    "g06_co_episode_boost": sql("select ask, graph_id, key, round(score, 6) as score, direction, co_episode from boosted", *RETRIEVAL[:14], **_LOW),
    "g07_budget_select": sql("select ask, graph_id, key, direction, rank from chosen", *RETRIEVAL[:17], **_LOW),
    "g08_memory_lines": sql("select * from lines", *RETRIEVAL[:20], **_LOW),
    "w06_top_snippets": sql("select * from snips", *RETRIEVAL, **_LOW),
    "g08_context_text": sql("select coalesce(l.ask, s.ask) as ask, coalesce(l.graph_id, s.graph_id) as graph_id, concat_ws(chr(10) || chr(10), '[MEMORY]' || chr(10) || l.t, '[CONTEXT]' || chr(10) || s.t) as text from (select ask, graph_id, string_agg(line, chr(10) order by ord) as t from lines group by all) l full join (select ask, graph_id, string_agg('\"' || snippet || '\"', chr(10) order by ord) as t from snips group by all) s on l.ask = s.ask and l.graph_id = s.graph_id", *RETRIEVAL, **_LOW),
    "g09_event_trace": sql("select ask, graph_id, edge_id, to_key, direction, round(c, 6) as contribution, round(s0 + sum(c) over (partition by ask, graph_id, to_key order by edge_id, direction rows unbounded preceding), 6) as running from (select s.ask, s.graph_id, a.edge_id, a.to_key, a.direction, a.share * 0.6 as c, case when z.key is null then 0.0 else 1.0 end as s0 from seeds s join adj a on a.graph_id = s.graph_id and a.from_key = s.key left join seeds z on z.ask = s.ask and z.graph_id = s.graph_id and z.key = a.to_key)", "n", "e", "bothways", "adj", "seeds"),
    "s30_index_inputs": sql("select * from idx", "n", "e", "idx"),
    "a16_corpus_mean": "select pos - 1 as pos, round(avg(x::double), 6) as mean from (select unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as pos from embeddings) group by pos",
    "j06_nearest_vectors": """with m as (select pos, avg(x::double) as m from (select unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings) group by pos),
        v as (select vec_id, pos, x::double - m as c from (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings) join m using (pos)),
        u as (select vec_id, pos, c / sqrt(sum(c * c) over (partition by vec_id)) as c from v),
        s as (select q.vec_id as q_id, w.vec_id as v_id, round(sum(q.c * w.c), 9) as score from u q join u w using (pos) where q.vec_id % 100 = 0 group by all)
        select q_id, v_id, round(score, 6) as score, row_number() over (partition by q_id order by score desc, v_id) as rank from s qualify rank <= 3""",
    "w01_noun_hits": _with("select graph_id, noun, key, round(score, 5) as score, rank from hits", "n", "e", "idx", extra=_NOUN_SEARCH[:13]),
    "w02_margin_gate": _with("select graph_id, noun, key, rank from acc", "n", "e", "idx", extra=_NOUN_SEARCH),
    "g11_find_seeds": _with(
        "select distinct mn.ask, mn.graph_id, sk.key from mn join sk on sk.graph_id = mn.graph_id and sk.noun = mn.noun",
        "n",
        "e",
        "idx",
        extra=(
            *_NOUN_SEARCH,
            f"mn as (select distinct read_id as ask, graph_id, unnest({tokens('m')}) as noun from msg)",
            "sk as (select acc.graph_id, acc.noun, n.key from acc join n on n.graph_id = acc.graph_id and n.key = acc.key union select acc.graph_id, acc.noun, unnest([e.source_key, e.target_key]) from acc join e on e.graph_id = acc.graph_id and acc.key = 'REL::' || e.relation)",
        ),
    ),
    "j08_er_exact": _er_sql(_EXACT),
    "j09_er_alias": _er_sql(_ALIAS),
    "j10_er_abbreviation": _er_sql(_ABBR, _GROUPS),
    "j11_er_fuzzy": _er_sql(_FUZZY),
    "j12_er_token_overlap": _er_sql(_OVERLAP),
    "w10_er_resolution": _with(
        """select s.graph_id, s.entity, coalesce(names[r + 1], 'none') as rule,
            case when r is null then 'new' when r <= 3 and len(c) = 1 then 'auto' else 'review' end as decision,
            case when r <= 3 and len(c) = 1 then c[1] end as target_key, array_to_string(coalesce(c, []), '|') as candidates
            from (select distinct graph_id, entity from st) s left join (select graph_id, entity, r, list_sort(list(distinct target_key)) as c from rules where (graph_id, entity, r) in (select graph_id, entity, min(r) from rules group by all) group by all) m using (graph_id, entity),
            (select ['self', 'exact_key', 'alias', 'abbreviation', 'fuzzy', 'token_overlap'] as names)""",
        "n",
        "e",
        extra=(
            _STAGED,
            _NC,
            _GROUPS,
            "selfs as (select graph_id, first(source_key order by coalesce(try_cast(created_at as timestamptz), to_timestamp(0)), id) as self_key from e group by graph_id)",
            f"""rules as (select st.graph_id, st.entity, selfs.self_key as target_key, 0 as r from st join selfs using (graph_id) where st.canon in ({inlist(config.SELF_PLACEHOLDERS)})
            union all select st.graph_id, st.entity, nc.target_key, 1 from st join nc on st.graph_id = nc.graph_id and st.key = nc.target_key
            union all select st.graph_id, st.entity, nc.target_key, 2 from st join nc on st.graph_id = nc.graph_id and st.kind = nc.kind where {_ALIAS}
            union all select st.graph_id, st.entity, nc.target_key, 3 from st join nc on st.graph_id = nc.graph_id and st.kind = nc.kind where {_ABBR}
            union all select st.graph_id, st.entity, nc.target_key, 4 from st join nc on st.graph_id = nc.graph_id and st.kind = nc.kind where {_FUZZY}
            union all select st.graph_id, st.entity, nc.target_key, 5 from st join nc on st.graph_id = nc.graph_id and st.kind = nc.kind where {_OVERLAP})""",
        ),
    ),
    "w08_bands": "select graph_id, kind, case when confidence >= 0.7 then key end as target_key, confidence, case when confidence >= 0.7 then 'merge' else 'new' end as decision, confidence >= 0.7 and confidence <= 0.9 as flagged from (select distinct graph_id, kind, key, confidence from node_records where confidence between 0 and 1) qualify row_number() over (partition by graph_id, kind order by confidence desc, key desc) = 1",
    "w11_first_edge_self": sql("select graph_id, first(source_key order by coalesce(try_cast(created_at as timestamptz), to_timestamp(0)), id) as self_key from e group by graph_id", "e"),
    "j14_remapped_edges": _with("select e.graph_id, e.id, (case when e.source_key = 'PERSON::user' then s.self_key else e.source_key end) || '::' || relation || '::' || (case when e.target_key = 'PERSON::user' then s.self_key else e.target_key end) as key from e join selfs s using (graph_id)", "e", extra=("selfs as (select graph_id, first(source_key order by coalesce(try_cast(created_at as timestamptz), to_timestamp(0)), id) as self_key from e group by graph_id)",)),
    "j15_supersession": _with("select graph_id, old_id, old_key, new_relation, new_key from sup", "e", extra=_OLDNEW),
    "m08_superseded_edges": _with(f"select old.graph_id, old.id, case when d.by is not null then 1.0 else strength end as strength, coalesce(d.by, properties['superseded_by']) as by, case when d.by is not null then '{NOW}' else updated_at end as updated_at from old left join (select graph_id, old_id as id, arg_max(new_relation, (ts0, new_id, new_relation)) as by from sup group by all) d using (graph_id, id)", "e", extra=_OLDNEW),
    "m06_upserted_nodes": _with(
        f"""select coalesce(n.graph_id, f.graph_id) as graph_id, coalesce(n.key, f.key) as key, coalesce(n.name, f.name) as name, coalesce(n.kind, f.kind) as kind,
            array_to_string(list_sort(list_filter(case when n.key is null then list_filter(f.al, lambda x: x <> '') when f.key is null then coalesce(n.aliases, []) else list_distinct(list_concat(coalesce(n.aliases, []), f.every)) end, lambda x: x is not null)), '|') as aliases,
            greatest(n.confidence, f.conf) as confidence,
            array_to_string(list_sort(list_filter(case when n.key is null then f.ep when f.key is null then coalesce(n.source_episode_ids, []) else list_distinct(list_concat(coalesce(n.source_episode_ids, []), f.ep)) end, lambda x: x is not null)), '|') as source_episode_ids,
            array_to_string(list_sort(list_concat(list_transform(list_filter(map_entries(coalesce(n.properties, map([]::varchar[], []::varchar[]))), lambda x: f.key is null or x.key not in ('rec', 'kind')), lambda x: x.key || '=' || coalesce(x.value, '')), case when f.key is null then [] else ['rec=' || f.rec, 'kind=' || f.lastkind] end)), '|') as properties,
            case when f.key is null then n.updated_at else '{NOW}' end as updated_at,
            case when n.key is null then 'created' when f.key is null then 'kept' else 'merged' end as outcome, coalesce(f.k, 0) as mentions
            from n full join f on n.graph_id = f.graph_id and n.key = f.key""",
        "n",
        extra=(
            f"sr as (select distinct rec_id as seq, graph_id, kind || '::' || {canon('name')} as key, name, kind, coalesce(aliases, []) as aliases, case when confidence between 0 and 1 then confidence else 0.85 end as conf, coalesce(source_episode_ids, []) as ep from node_records where name is not null and kind is not null)",
            "f as (select graph_id, key, first(name order by seq) as name, first(kind order by seq) as kind, list_distinct(list_concat(flatten(list(aliases)), (list(name order by seq))[2:])) as al, list_filter(list_distinct(list_concat(flatten(list(aliases)), list(name))), lambda x: x <> '') as every, count(*) as k, last(seq order by seq)::varchar as rec, last(kind order by seq) as lastkind, max(conf) as conf, list_distinct(flatten(list(ep))) as ep from sr group by graph_id, key)",
        ),
    ),
    "m07_upserted_edges": _with("select * from up", "e", extra=(*_OLDNEW, _UPSERT)),
    "a14_write_counters": _with(
        """select graph_id, sum(nc)::bigint as nodes_created, sum(nm)::bigint as nodes_merged, sum(ec)::bigint as edges_created, sum(er)::bigint as edges_reinforced, 0::bigint as edges_dropped, sum(es)::bigint as edges_superseded, sum(rr)::bigint as reinforced_from_read from (
            select graph_id, 0 as nc, 0 as nm, 0 as ec, 0 as er, 0 as es, 0 as rr from n union all select graph_id, 0, 0, 0, 0, 0, 0 from up
            union all select graph_id, (n.key is null)::int, k - (n.key is null)::int, 0, 0, 0, 0 from (select graph_id, kind || '::' || """
        + canon("name")
        + """ as key, count(*) as k from (select distinct graph_id, rec_id, name, kind from node_records where name is not null and kind is not null) group by all) f left join n using (graph_id, key)
            union all select graph_id, 0, 0, (outcome = 'created')::int, greatest(mentions - (outcome = 'created')::int, 0), 0, 0 from up
            union all select graph_id, 0, 0, 0, 0, 1, 0 from sup
            union all select trav.graph_id, 0, 0, 0, 0, 0, 1 from trav join (select distinct graph_id, key from up) u using (graph_id, key)) group by graph_id""",
        "n",
        "e",
        extra=(*_OLDNEW, _UPSERT, *_TRAVERSED),
    ),
    "m15_sticky_self": _with("select graph_id, coalesce(a.k, b.k) as self_key from (select graph_id, first(source_key order by ts0, id) as k from old group by graph_id) a full join (select graph_id, first(source_key order by ts0, id) as k from new group by graph_id) b using (graph_id)", "e", extra=_OLDNEW[:3]),
    "j13_hinted_entities": f"""with w as ({{W10}}), h as (select r.graph_id, r.rec_id as entity, min(n.key) as hint from (select distinct graph_id, rec_id, kind, key from node_records where name is not null and kind is not null) r
            join ({CTES["n"]}) n on n.graph_id = r.graph_id and n.key = r.key and n.kind = r.kind group by all)
        select w.graph_id, w.entity, case when decision = 'new' and hint is not null then 'extractor_hint' else rule end as rule, case when decision = 'new' and hint is not null then 'review' else decision end as decision,
            case when decision = 'new' and hint is not null then hint else candidates end as candidates from w left join h using (graph_id, entity)""",
    "j27_known_forms": _with(f"select graph_id, canon, arg_max(key, (ts0, id)) as key from (select graph_id, key, id, coalesce(try_cast(created_at as timestamptz), to_timestamp(0)) as ts0, {canon('form')} as canon from (select graph_id, key, id, created_at, unnest(list_concat([name], list_filter(coalesce(aliases, []), lambda x: x is not null))) as form from n)) where canon is not null group by all", "n"),
    "f30_model_candidates": _with("select distinct r.graph_id, r.kind as entity, r.key, round(least(1.0, greatest(0.0, coalesce(case when not isnan(r.confidence) then r.confidence end, 0.0))), 6) as confidence, r.rec_id::varchar as reason from (select distinct graph_id, kind, key, confidence, rec_id from node_records where key is not null and kind is not null) r join n on n.graph_id = r.graph_id and n.key = r.key", "n"),
    "f31_model_decisions": sql("select graph_id, id, case stability when 'mutable' then 'supersedes' when 'time_bound' then 'contradicts' else 'coexist' end as decision, case stability when 'ephemeral' then 'no usable decision' else 'r' end as reason from e", "e"),
    "m12_relationship_ends": _with(
        "select c.graph_id, rec_id, source, target, coalesce(a.key, case when b.key is not null then 'OTHER::' || " + canon("source") + " end) as source_key, coalesce(b.key, case when a.key is not null then 'OTHER::' || " + canon("target") + " end) as target_key, case when a.key is null and b.key is not null then 'OTHER::' || " + canon("source") + " end as made_source, case when b.key is null and a.key is not null then 'OTHER::' || " + canon("target") + " end as made_target"
        + " from c left join ff a on a.graph_id = c.graph_id and a.canon = " + canon("source") + " left join ff b on b.graph_id = c.graph_id and b.canon = " + canon("target"),
        "n",
        extra=(
            "c as (select distinct graph_id, rec_id, name as source, coalesce(list_filter(aliases, lambda x: x is not null)[1], 'nobody ' || rec_id) as target from node_records where name is not null)",
            f"ff as (select graph_id, canon, arg_min(key, (ts0, id)) as key from (select graph_id, key, id, coalesce(try_cast(created_at as timestamptz), to_timestamp(0)) as ts0, {canon('form')} as canon from (select graph_id, key, id, created_at, unnest(list_concat([name], list_filter(coalesce(aliases, []), lambda x: x is not null))) as form from n)) group by all)",
        ),
    ),
    "g02_rendered_graphs": sql("select graph_id as ask, graph_id, string_agg(line, chr(10) order by part, key, line) as text from (select graph_id, 0 as part, key, '- ' || key || ' (name=' || coalesce(name, '') || ')' as line from n union select graph_id, 1, key, '  ' || source_key || ' -[' || relation || ']-> ' || target_key from e) group by graph_id", "n", "e"),
    "g08_injections": sql(
        "select x.ask, x.graph_id, x.key as edge_key, s.name as source, x.relation, replace(lower(x.relation), '_', ' ') as relation_phrase, t.name as target, x.snippet from (select ask, graph_id, key, min((source_key, relation, target_key)) as e, e[1] as source_key, e[2] as relation, e[3] as target_key, max(snippet) as snippet from (select c.ask, c.graph_id, l.key, l.source_key, l.relation, l.target_key, null as snippet from chosen c join live l on l.graph_id = c.graph_id and l.source_key = c.key join chosen d on d.ask = c.ask and d.graph_id = c.graph_id and d.key = l.target_key union all select q.ask, q.graph_id, l.key, l.source_key, l.relation, l.target_key, q.snippet from sniptop q join live l on l.graph_id = q.graph_id and l.id = q.id) group by ask, graph_id, key) x join n s on s.graph_id = x.graph_id and s.key = x.source_key join n t on t.graph_id = x.graph_id and t.key = x.target_key",
        *RETRIEVAL[:22],
        **_LOW,
    ),
    "m09_reinforced_edges": _with(f"select e.graph_id, e.id, round(case when t.k is null then strength else least(strength + 15 * t.k, 100) end, 6) as strength, case when t.k is null then updated_at else '{NOW}' end as updated_at from e left join (select graph_id, key, count(*) as k from trav group by all) t using (graph_id, key)", "e", extra=_TRAVERSED),
    "a13_reinforced": _with("select e.graph_id, e.id, round(case when t.k is null then strength else least(strength + 15 * t.k, 100) end, 6) as strength from e left join (select graph_id, key, count(*) as k from trav group by all) t using (graph_id, key)", "e", extra=_TRAVERSED),
    "y15_decayed_graph": _with("select graph_id, count(s1) as decayed, count(*) filter (where coalesce(s1, strength) < 2) as dormant, round(sum(coalesce(s1, strength)), 3) as strength from dec group by graph_id", "e", extra=(_DEC,)),
    "k02_decay_due": sql(f"select graph_id, max(try_cast(updated_at as timestamptz)) is null or epoch_us(timestamptz '{NOW}+00') - epoch_us(max(try_cast(updated_at as timestamptz))) >= 86400000000 as due from e group by graph_id", "e"),
    "proj15_graph_snapshot": _with("select graph_id, id, source_key, relation, target_key, round(coalesce(s1, strength), 4) as strength, coalesce(s1, strength) < 2 as dormant, properties['superseded_by'] as superseded_by from dec", "e", extra=(_DEC,)),
    "j29_orphans": sql("select n.graph_id, n.key from n left join (select distinct graph_id, from_key from bothways) b on b.graph_id = n.graph_id and b.from_key = n.key where b.from_key is null", "n", "e", "bothways"),
    "j32_graph_delta": "with p as (select graph_id, snapshot_no, lead(snapshot_no) over (partition by graph_id order by snapshot_no) as to_no from (select distinct graph_id, snapshot_no from node_snapshots)), r as (select graph_id, snapshot_no, key, min((name, kind, confidence)) as m from node_snapshots group by all), a as (select graph_id, to_no, key, m from r join p using (graph_id, snapshot_no) where to_no is not null), b as (select r.graph_id, p.to_no, key, m from r join p on p.graph_id = r.graph_id and p.to_no = r.snapshot_no) select coalesce(a.graph_id, b.graph_id) as graph_id, coalesce(a.to_no, b.to_no) as to_no, coalesce(a.key, b.key) as key, case when a.key is null then 'created' when b.key is null then 'removed' else 'changed' end as change from a full join b on a.graph_id = b.graph_id and a.to_no = b.to_no and a.key = b.key where a.key is null or b.key is null or a.m is distinct from b.m",
    "j30_index_sync": sql("select coalesce(i.graph_id, c.graph_id) as graph_id, coalesce(i.key, c.key) as key, case when c.key is null then 'drop' when i.key is null then 'add' else 'keep' end as action from (select distinct graph_id, key from node_snapshots) i full join (select graph_id, key from n) c on i.graph_id = c.graph_id and i.key = c.key", "n"),
    "j24_found_nodes": _with("select * from node", "n", "e", "bothways", extra=_NAMES[:4]),
    "y14_retrieve_memory": _with("select distinct ask, graph_id, id from rel", "n", "e", "bothways", extra=_NAMES),
    "j23_episodes": _with("select distinct x.ask, x.graph_id, x.ep as episode from (select ask, graph_id, unnest(source_episode_ids) as ep from rel union select node.ask, node.graph_id, unnest(n.source_episode_ids) from node join n using (graph_id, key)) x join episodes p on p.graph_id = x.graph_id and p.id = x.ep", "n", "e", "bothways", extra=_NAMES),
    "proj13_validated_edges": sql(
        f"""select case when relation is null or not regexp_full_match(relation, '[A-Z]+(?:_[A-Z]+){{0,3}}') then 'bad relation' when source_key = target_key then 'self loop'
            when stability is null or stability not in ({inlist(config.STABILITIES)}) then 'unknown stability' when cardinality is null or cardinality not in ({inlist(config.CARDINALITIES)}) then 'unknown cardinality'
            when ttl_days is not null and stability not in ({inlist(config.TTL_STABILITIES)}) then 'ttl on a lasting relation' when not coalesce(confidence between 0 and 1, false) then 'confidence out of range'
            else 'valid' end as verdict, count(*) as n from e group by verdict""",
        "e",
    ),
    "a18_health": sql("select coalesce(a.graph_id, b.graph_id) as graph_id, nodes, kinds, edges, relations from (select graph_id, count(*) as nodes, count(distinct kind) as kinds from n group by graph_id) a full join (select graph_id, count(*) as edges, count(distinct relation) as relations from e group by graph_id) b on a.graph_id = b.graph_id", "n", "e"),
    "k17_last_read": "select graph_id, arg_max(read_id, (ts, received_at, read_id)) as read_id from read_trace group by graph_id",
    "s29_high_water": "with t as (select graph_id, read_id, row_number() over (partition by graph_id order by read_id) as turn from (select distinct graph_id, read_id from read_trace)), h as (select graph_id, count(distinct read_id) as done from read_trace where ts < timestamp '2025-06-01' group by graph_id) select graph_id, count(*) as pending from t left join h using (graph_id) where turn > coalesce(done, 0) group by graph_id",
}
SQL["j13_hinted_entities"] = SQL["j13_hinted_entities"].replace("{W10}", SQL["w10_er_resolution"])
