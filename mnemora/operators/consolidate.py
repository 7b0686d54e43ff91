"""Writing to graphs: normalised extractions, supersession, upserts of nodes and edges, decay, reinforcement, journals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora import config
from mnemora.functions import decay as D
from mnemora.functions import text as T
from mnemora.operators.graph import superseded
from mnemora.runtime import canonical_name, checkpointed, instant

G = "graph_id"
ENTITY = "array<struct<text string, type string, confidence string, properties map<string,string>, aliases array<string>, candidate_merge_key string>>"
RELATIONSHIP = "array<struct<source string, relation string, target string, confidence string, stability string, ttl_days string, cardinality string, evidence string, snippet string, properties map<string,string>>>"
EPISODE = "struct<summary string, importance string, tags array<string>>"
PAYLOAD = f"struct<entities {ENTITY}, relationships {RELATIONSHIP}, episode {EPISODE}>"


def parsed_payloads(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``payload`` (null where no repair of the reply parses) to model replies."""
    return replies.withColumn("payload", F.from_json(T.repaired_json(reply), PAYLOAD))


def payload_entities(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised entities (``batch_id, seq, text, kind, confidence, aliases, properties, hint, key``) and rejects with a reason."""
    rows = payloads.select("batch_id", F.posexplode("payload.entities").alias("seq", "e"))
    rows = rows.select("batch_id", "seq", F.btrim(F.coalesce("e.text", F.lit(""))).alias("text"), F.upper(F.btrim(F.coalesce("e.type", F.lit("")))).alias("kind"), T.clamp01(F.col("e.confidence"), config.DEFAULT_CONFIDENCE).alias("confidence"), T.clean_list("e.aliases").alias("aliases"), F.col("e.properties").alias("properties"), T.nullish("e.candidate_merge_key").alias("hint"))
    reason = F.when(F.col("text") == "", "entity without text").when(~F.col("kind").isin(*config.NODE_KINDS), "unknown entity type")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason").withColumn("key", T.node_key("kind", "text")), rows.where("reason is not null").select("batch_id", "seq", "text", "reason")


def payload_edges(payloads: DataFrame, entities: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised edges, the endpoints made up for them, and rejects.

    An end is looked up by exact text, canonical text, then in ``existing`` (``canon, key`` per ``batch_id``, or per
    ``graph_id`` where the payloads have it). With one end unknown an OTHER node of at most half confidence is made
    up; with both unknown the edge is dropped.
    """
    scope = G if G in existing.columns else "batch_id"
    own = ["batch_id"] if scope == "batch_id" else ["batch_id", G]
    rows = payloads.select(*own, F.posexplode("payload.relationships").alias("seq", "r"))
    stability, cardinality = F.lower(F.btrim("r.stability")), F.lower(F.btrim("r.cardinality"))
    stability = F.when(stability.isin(*config.STABILITIES), stability).otherwise("stable")
    rows = rows.select(*own, "seq", F.btrim(F.coalesce("r.source", F.lit(""))).alias("source"), F.btrim(F.coalesce("r.target", F.lit(""))).alias("target"), T.normal_relation("r.relation").alias("relation"), T.clamp01(F.col("r.confidence"), config.DEFAULT_CONFIDENCE).alias("confidence"), stability.alias("stability"), F.when(cardinality.isin(*config.CARDINALITIES), cardinality).otherwise("one_to_many").alias("cardinality"), F.when(stability.isin(*config.TTL_STABILITIES), F.col("r.ttl_days").try_cast("int")).alias("ttl_days"), F.coalesce("r.evidence", F.lit("")).alias("evidence"), F.coalesce("r.snippet", F.lit("")).alias("snippet"), F.coalesce("r.properties", F.create_map().cast("map<string,string>")).alias("properties"))
    by_text = entities.groupBy("batch_id", "text").agg(F.max_by("key", "seq").alias("key"))
    by_canon = entities.groupBy("batch_id", canonical_name("text").alias("canon")).agg(F.max_by("key", "seq").alias("key"))
    for end in ("source", "target"):
        rows = rows.join(by_text.select("batch_id", F.col("text").alias(end), F.col("key").alias("k1")), ["batch_id", end], "left")
        rows = rows.withColumn("canon", canonical_name(end)).join(by_canon.select("batch_id", "canon", F.col("key").alias("k2")), ["batch_id", "canon"], "left").join(existing.select(scope, "canon", F.col("key").alias("k3")), [scope, "canon"], "left")
        rows = rows.withColumn(f"{end}_key", F.coalesce("k1", "k2", "k3")).drop("k1", "k2", "k3", "canon")
    unknown = F.col("source_key").isNull(), F.col("target_key").isNull()
    made = [F.when(unknown[i] & ~unknown[1 - i] & (F.col(e) != ""), T.node_key(F.lit("OTHER"), e)) for i, e in enumerate(("source", "target"))]
    rows = rows.withColumns({"made_source": made[0], "made_target": made[1]})
    rows = rows.withColumns({"source_key": F.coalesce("source_key", "made_source"), "target_key": F.coalesce("target_key", "made_target")})
    reason = F.when(F.col("source_key").isNull() | F.col("target_key").isNull(), "unknown endpoint").when(F.col("source_key") == F.col("target_key"), "self loop").when(~T.is_relation("relation"), "bad relation")
    rows = rows.withColumn("reason", F.coalesce(reason, F.when(F.col("relation").isNull(), "bad relation")))
    good = rows.where("reason is null")
    ends = rows.where("made_source is not null or made_target is not null").select(*own, "seq", F.explode(F.array(F.struct(F.col("made_source").alias("key"), F.col("source").alias("text")), F.struct(F.col("made_target").alias("key"), F.col("target").alias("text")))).alias("m")).where("m.key is not null")
    made_up = ends.groupBy(*own, "m.key").agg(F.min_by("m.text", "seq").alias("text"), F.lit(min(config.DEFAULT_CONFIDENCE, 0.5)).alias("confidence"))
    made_up = made_up.withColumn("properties", F.create_map(F.lit(config.PROVISIONAL), F.lit("true")))
    edges = good.drop("reason", "made_source", "made_target", "source", "target").withColumn("key", T.edge_key("source_key", "relation", "target_key"))
    return edges, made_up, rows.where("reason is not null").select("batch_id", "seq", "source", "relation", "target", "reason")


def payload_warnings(payloads: DataFrame, bad_entities: DataFrame, bad_edges: DataFrame, made: DataFrame) -> DataFrame:
    """``batch_id, warning``: what normalising dropped, coerced or made up."""
    rels = payloads.select("batch_id", F.explode("payload.relationships").alias("r"))
    coerced = []
    for field, known, used in (("stability", config.STABILITIES, "stable"), ("cardinality", config.CARDINALITIES, "one_to_many")):
        value = F.lower(F.btrim(f"r.{field}"))
        coerced.append(rels.where(value.isNotNull() & (value != "") & ~value.isin(*known)).select("batch_id", F.concat(F.lit(f"unknown {field} "), f"r.{field}", F.lit(f" became {used}")).alias("warning")))
    said = F.nullif(F.btrim(F.coalesce("payload.episode.summary", F.lit(""))), F.lit(""))
    out = [
        bad_entities.select("batch_id", F.concat(F.lit("entity dropped: "), "reason").alias("warning")),
        bad_edges.select("batch_id", F.concat(F.lit("relationship "), "source", F.lit(" "), F.coalesce("relation", F.lit("")), F.lit(" "), "target", F.lit(" dropped: "), "reason").alias("warning")),
        made.select("batch_id", F.concat(F.lit("made up "), "key", F.lit(" for a relationship")).alias("warning")),
        payloads.where(F.col("payload").isNull()).select("batch_id", F.lit("reply isn't usable JSON").alias("warning")),
        payloads.where(said.isNull()).select("batch_id", F.lit("episode without summary").alias("warning")),
        *coerced,
    ]
    return reduce(lambda a, b: a.unionByName(b), out)


def known_forms(nodes: DataFrame) -> DataFrame:
    """``graph_id, canon, key``: the node that a canonical name or alias stands for; of several the last one written."""
    order = F.struct(F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0))).alias("at"), F.col("id").alias("i"))
    forms = F.array_union(F.array(canonical_name("name")), F.transform(F.array_compact(F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: canonical_name(a)))
    return nodes.select(G, "key", order.alias("o"), F.explode(forms).alias("canon")).groupBy(G, "canon").agg(F.max_by("key", "o").alias("key"))


def payload_episodes(payloads: DataFrame) -> DataFrame:
    """``batch_id, summary, importance, tags``: without a summary a stand-in of importance 0.1; importance defaults to 0.3."""
    summary = F.nullif(F.btrim(F.coalesce("payload.episode.summary", F.lit(""))), F.lit(""))
    return payloads.select("batch_id", F.coalesce(summary, F.lit("(no durable summary)")).alias("summary"), F.when(summary.isNull(), 0.1).otherwise(T.clamp01(F.col("payload.episode.importance"), 0.3)).alias("importance"), T.clean_list("payload.episode.tags", 5).alias("tags"))


def validated_edges(edges: DataFrame, ttl_strict: bool = True) -> DataFrame:
    """Edges with ``reason``: null if valid, else the first rule broken. Rows are never raised on."""
    reason = (
        F.when(~T.is_relation("relation") | F.col("relation").isNull(), "bad relation")
        .when(F.col("source_key") == F.col("target_key"), "self loop")
        .when(~F.coalesce(F.col("stability").isin(*config.STABILITIES), F.lit(False)), "unknown stability")
        .when(~F.coalesce(F.col("cardinality").isin(*config.CARDINALITIES), F.lit(False)), "unknown cardinality")
        .when(F.lit(ttl_strict) & F.col("ttl_days").isNotNull() & ~F.col("stability").isin(*config.TTL_STABILITIES), "ttl on a lasting relation")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range")
    )
    return edges.withColumn("reason", reason)


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``graph_id, key, end`` of edges whose source or target is no node."""
    known = nodes.select(G, F.col("key").alias("end")).distinct()
    ends = edges.select(G, "key", F.explode(F.array("source_key", "target_key")).alias("end")).distinct()
    return ends.join(known, [G, "end"], "left_anti").select(G, "key", "end")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, key`` of nodes without any edge."""
    ends = edges.select(G, F.explode(F.array("source_key", "target_key")).alias("key")).distinct()
    return nodes.select(G, "key").distinct().join(ends, [G, "key"], "left_anti")


def supersession_candidates(new_edges: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``graph_id, old_id, old_key, new_key, new_relation, seq``: stored edges that a new one may replace, each pair of old edge and new relation once.

    Same source, and the same target under another relation, or the same relation to another target if either is
    one-to-one. Two equi-joins, so no source's edges meet all others. With ``known`` (``graph_id, key`` of stored and
    staged nodes) only new edges between known nodes take part.
    """
    old = edges.where(~superseded(F.col("properties"))).select(G, F.col("id").alias("old_id"), F.col("key").alias("old_key"), "source_key", F.col("relation").alias("old_relation"), F.col("target_key").alias("old_target"), F.col("cardinality").alias("old_cardinality"))
    if known is not None:
        for end in ("source_key", "target_key"):
            new_edges = new_edges.join(known.select(G, F.col("key").alias(end)).distinct(), [G, end], "left_semi")
    new = new_edges.select(G, "seq", F.col("key").alias("new_key"), "source_key", F.col("relation").alias("new_relation"), F.col("target_key").alias("new_target"), F.col("cardinality").alias("new_cardinality"))
    columns = [G, "seq", "old_id", "old_key", "new_key", "new_relation"]
    same_target = new.join(old.withColumn("new_target", F.col("old_target")), [G, "source_key", "new_target"]).where("new_relation <> old_relation").select(*columns)
    same_relation = new.join(old.withColumn("new_relation", F.col("old_relation")), [G, "source_key", "new_relation"]).where("new_target <> old_target and 'one_to_one' in (old_cardinality, new_cardinality)").select(*columns)
    first = same_target.unionByName(same_relation).groupBy(G, "old_id", "old_key", "new_relation").agg(F.min(F.struct("seq", "new_key")).alias("m"))
    return first.select(G, "old_id", "old_key", F.col("m.new_key").alias("new_key"), "new_relation", F.col("m.seq").alias("seq"))


def replacing(decided: DataFrame) -> DataFrame:
    """Decisions that act: ``supersedes`` and ``contradicts``; without a ``decision`` column every row supersedes."""
    if "decision" not in decided.columns:
        decided = decided.withColumn("decision", F.lit("supersedes"))
    if "reason" not in decided.columns:
        decided = decided.withColumn("reason", F.lit(""))
    return decided.where(F.col("decision").isin("supersedes", "contradicts"))


def apply_supersessions(edges: DataFrame, decided: DataFrame, now: str | None = None) -> DataFrame:
    """Demotes decided edges (``graph_id, old_id, new_relation``) to strength 1 and tags them with the new relation.

    Of several decisions on one edge the last in ``seq`` tags it. Nothing is deleted. ``now`` becomes ``updated_at``;
    without it times stay as they were.
    """
    order = F.struct("seq", "new_relation") if "seq" in decided.columns else F.col("new_relation")
    last = replacing(decided).groupBy(G, "old_id").agg(F.max_by("new_relation", order).alias("by")).withColumnRenamed("old_id", "id")
    out = edges.join(last, [G, "id"], "left")
    hit = F.col("by").isNotNull()
    tag = _merged(F.col("properties"), F.create_map(F.lit("superseded_by"), "by"))
    changed = {"strength": F.when(hit, config.DEMOTED_STRENGTH).otherwise(F.col("strength")), "properties": F.when(hit, tag).otherwise(F.col("properties"))}
    return out.withColumns(changed | _stamped(hit, now)).drop("by")


def contradictions(decided: DataFrame) -> DataFrame:
    """``graph_id, edge, superseded_by, reason`` of decisions to be looked at."""
    return replacing(decided).where("decision = 'contradicts'").select(G, F.col("old_key").alias("edge"), F.col("new_relation").alias("superseded_by"), "reason")


def _stamped(hit: Column, now: str | None) -> dict[str, Column]:
    return {} if now is None else {"updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}


def _union(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*[F.array_compact(F.coalesce(a, F.array().cast("array<string>"))) for a in arrays]))


def _merged(old: Column, new: Column) -> Column:
    """Two property maps as one, new values win."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def _in_order(rows: DataFrame, value: str, order: Column) -> DataFrame:
    """``graph_id, key`` with the distinct values of a key as a list, in the order of their first mention.

    Values are made distinct before they meet, so a key mentioned by any number of rows holds its own values only.
    """
    first = rows.groupBy(G, "key", value).agg(F.min(order).alias("o"))
    return first.groupBy(G, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias(value))


def staged_nodes(staged: DataFrame) -> DataFrame:
    """Staged entities folded per final key in ``seq`` order.

    ``name, kind`` of the first mention, greatest ``confidence``, ``mentions``, united ``source_episode_ids`` and
    ``properties`` (later values win); ``mentioned`` has all aliases with every mention's name behind its own,
    ``aliases`` the same without the first mention's name, which is the node's.
    """
    base = staged.groupBy(G, "key").agg(F.min_by(F.struct("name", "kind"), "seq").alias("f"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("mentions"), F.min("seq").alias("first"))
    forms = staged.select(G, "key", "seq", F.posexplode(F.array_compact(F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "form")).withColumn("own", F.lit(False))
    forms = forms.unionByName(staged.select(G, "key", "seq", F.lit(1 << 30).alias("pos"), F.col("name").alias("form"), F.lit(True).alias("own"))).where("form <> ''")
    later = forms.join(base.select(G, "key", "first"), [G, "key"]).where("not (own and seq = first)")
    order = F.struct("seq", "pos")
    out = base.join(_in_order(later, "form", order).withColumnRenamed("form", "aliases"), [G, "key"], "left").join(_in_order(forms, "form", order).withColumnRenamed("form", "mentioned"), [G, "key"], "left")
    episodes = staged.select(G, "key", "seq", F.posexplode(F.array_compact("source_episode_ids")).alias("pos", "source_episode_ids"))
    out = out.join(_in_order(episodes, "source_episode_ids", order), [G, "key"], "left")
    if "properties" in staged.columns:
        said = staged.select(G, "key", "seq", F.explode("properties").alias("k", "v")).groupBy(G, "key", "k").agg(F.max_by("v", "seq").alias("v"))
        out = out.join(said.groupBy(G, "key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties")), [G, "key"], "left")
    else:
        out = out.withColumn("properties", F.lit(None).cast("map<string,string>"))
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, empty) for c in ("aliases", "mentioned", "source_episode_ids")}
    return out.withColumns(lists | {"name": F.col("f.name"), "kind": F.col("f.kind"), "properties": F.coalesce("properties", F.create_map().cast("map<string,string>"))}).drop("f", "first")


def upsert_nodes(nodes: DataFrame, staged: DataFrame, now: str | None = None) -> DataFrame:
    """Nodes (one per key) after merging staged ones, with ``outcome`` (created, merged or kept) and ``mentions``.

    New keys are added; known ones gain aliases (every mention's name among them), episodes and properties (new
    values win) and keep the greater confidence. ``now`` becomes ``updated_at`` of what changed and ``created_at`` of
    what is new.
    """
    fields = ("name", "kind", "aliases", "mentioned", "confidence", "source_episode_ids", "properties", "mentions")
    new = staged_nodes(staged).select(G, "key", *[F.col(c).alias(f"n_{c}") for c in fields], F.lit(True).alias("_n"))
    j = nodes.withColumn("_o", F.lit(True)).join(new, [G, "key"], "full_outer")
    both, created = F.col("_o").isNotNull() & F.col("_n").isNotNull(), F.col("_o").isNull()
    changed = {
        "name": F.coalesce("name", "n_name"),
        "kind": F.coalesce("kind", "n_kind"),
        "aliases": F.when(both, _union(F.col("aliases"), F.col("n_mentioned"))).otherwise(F.coalesce("aliases", "n_aliases", F.array().cast("array<string>"))),
        "confidence": F.greatest("confidence", "n_confidence"),
        "source_episode_ids": F.when(both, _union(F.col("source_episode_ids"), F.col("n_source_episode_ids"))).otherwise(F.coalesce("source_episode_ids", "n_source_episode_ids")),
        "outcome": F.when(created, "created").when(F.col("_n").isNull(), "kept").otherwise("merged"),
        "mentions": F.coalesce("n_mentions", F.lit(0)),
    }
    if "properties" in nodes.columns:
        changed["properties"] = F.when(both, _merged(F.col("properties"), F.col("n_properties"))).otherwise(F.coalesce("properties", "n_properties"))
    return j.withColumns(changed | _new_row(nodes, created, F.col("_n").isNotNull(), now)).select(*nodes.columns, "outcome", "mentions")


def _new_row(table: DataFrame, created: Column, hit: Column, now: str | None) -> dict[str, Column]:
    """Identity and times of upserted rows."""
    out = {"id": F.coalesce("id", F.sha2(F.concat_ws("|", F.col(G).cast("string"), "key"), 256))} if "id" in table.columns else {}
    if now is not None:
        out |= {c: F.when(h, F.lit(now)).otherwise(F.col(c)) for c, h in (("created_at", created), ("updated_at", hit)) if c in table.columns}
    return out


def bound_episodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the episodes of written edges (``source_key, target_key, seq, source_episode_ids``) added at both ends."""
    ends = edges.select(G, "seq", F.explode(F.array("source_key", "target_key")).alias("key"), "source_episode_ids")
    told = _in_order(ends.select(G, "key", "seq", F.posexplode(F.array_compact("source_episode_ids")).alias("pos", "told")), "told", F.struct("seq", "pos"))
    out = nodes.join(told, [G, "key"], "left")
    return out.withColumn("source_episode_ids", F.when(F.col("told").isNull(), F.col("source_episode_ids")).otherwise(_union(F.col("source_episode_ids"), F.col("told")))).drop("told")


def usable_edges(staged: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged edges that can be written, and those dropped with a ``reason``: ends that became one node, or an end that is none of ``nodes``."""
    rows = staged.withColumn("reason", F.when(F.col("source_key") == F.col("target_key"), "ends merged to the same node"))
    if nodes is not None:
        for end in ("source_key", "target_key"):
            rows = rows.join(nodes.select(G, F.col("key").alias(end), F.lit(True).alias("_k")).distinct(), [G, end], "left")
            rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("_k").isNull(), "missing endpoint"))).drop("_k")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def upsert_edges(edges: DataFrame, staged: DataFrame, now: str | None = None) -> DataFrame:
    """Edges (one per key) after merging staged ones in ``seq`` order, with ``outcome`` and ``mentions``.

    A new key starts at full strength whatever was staged; each further mention reinforces; snippet, evidence and
    confidence are taken over only from mentions of strictly greater confidence; episodes are united. Edges whose ends
    became one are left out.
    """
    usable, _ = usable_edges(staged)
    once = ("source_key", "relation", "target_key", "stability", "ttl_days", "cardinality", "properties")
    told = ("confidence", "snippet", "evidence")
    first = usable.groupBy(G, "key").agg(F.min_by(F.struct(*once), "seq").alias("f"), F.min_by(F.struct(*told), F.struct(-F.col("confidence"), "seq")).alias("b"), F.count(F.lit(1)).alias("mentions"))
    episodes = usable.select(G, "key", "seq", F.posexplode(F.array_compact("source_episode_ids")).alias("pos", "told"))
    first = first.join(_in_order(episodes, "told", F.struct("seq", "pos")), [G, "key"], "left")
    j = edges.withColumn("_o", F.lit(True)).join(first, [G, "key"], "full_outer")
    created = F.col("_o").isNull()
    better = created | F.coalesce(F.col("b.confidence") > F.col("confidence"), F.lit(False))
    changed = {c: F.when(created, F.col(f"f.{c}")).otherwise(F.col(c)) for c in once} | {c: F.when(better, F.col(f"b.{c}")).otherwise(F.col(c)) for c in told}
    changed |= {
        "mentions": F.coalesce("mentions", F.lit(0)),
        "strength": F.when(created, config.INITIAL_STRENGTH).otherwise(D.reinforced(F.col("strength"), F.coalesce("mentions", F.lit(0)))),
        "source_episode_ids": F.when(F.col("told").isNull() & ~created, F.col("source_episode_ids")).otherwise(_union(F.col("source_episode_ids"), F.col("told"))),
        "outcome": F.when(created, "created").when(F.col("f").isNull(), "kept").otherwise("reinforced"),
    }
    return j.withColumns(changed | _new_row(edges, created, F.col("f").isNotNull(), now)).select(*edges.columns, "outcome", "mentions")


def reinforce(edges: DataFrame, log: DataFrame, now: str | None = None) -> DataFrame:
    """Edges after a log of traversals (``graph_id, edge``): the closed form of one capped boost per logged row.

    ``now`` becomes ``updated_at`` of reinforced edges, where their next decay starts; without it times stay.
    """
    times = log.groupBy(G, F.col("edge").alias("key")).agg(F.count(F.lit(1)).alias("_times"))
    out = edges.join(times, [G, "key"], "left")
    hit = F.col("_times").isNotNull()
    return out.withColumns({"strength": F.when(hit, D.reinforced(F.col("strength"), F.col("_times"))).otherwise(F.col("strength"))} | _stamped(hit, now)).drop("_times")


def apply_write(nodes: DataFrame, edges: DataFrame, staged: DataFrame, staged_edges: DataFrame, decided: DataFrame, log: DataFrame, now: str) -> dict[str, DataFrame]:
    """One deterministic write: nodes, edges, supersessions, orphan warnings, read reinforcement, in this order.

    ``nodes`` and ``edges`` have one row per key; ``staged`` and ``staged_edges`` carry final keys and ``seq``.
    Returns the new ``nodes`` and ``edges``, ``counters`` per graph, ``flagged`` and ``warnings`` (``graph_id, warning``).
    """
    up_nodes = checkpointed(upsert_nodes(nodes, staged, now))
    good, dropped = usable_edges(staged_edges, up_nodes)
    good = checkpointed(good)
    out_nodes = bound_episodes(up_nodes.drop("outcome", "mentions"), good)
    up_edges = checkpointed(upsert_edges(edges, good, now))
    acting = checkpointed(replacing(decided))
    stored = apply_supersessions(up_edges.drop("outcome", "mentions"), acting, now)
    alone = orphans(up_nodes.where("outcome <> 'kept'"), up_edges)
    said = lambda df, *parts: df.select(G, F.concat(*parts).alias("warning"))
    warnings = said(dropped, F.lit("edge "), "key", F.lit(" dropped: "), "reason").unionByName(said(alone, F.lit("orphan "), "key")).unionByName(said(acting, F.lit("edge "), "old_key", F.lit(" superseded by "), "new_relation"))
    created, n = F.col("outcome") == "created", F.col("mentions")
    count = lambda df, **sums: df.groupBy(G).agg(*[F.sum(c).cast("bigint").alias(k) for k, c in sums.items()])
    parts = [
        count(up_nodes, nodes_created=created.cast("int"), nodes_merged=F.greatest(n - created.cast("int"), F.lit(0))),
        count(up_edges, edges_created=created.cast("int"), edges_reinforced=F.greatest(n - created.cast("int"), F.lit(0))),
        count(dropped, edges_dropped=F.lit(1)),
        count(acting, edges_superseded=F.lit(1)),
        count(log.join(up_edges.select(G, F.col("key").alias("edge")).distinct(), [G, "edge"], "left_semi"), reinforced_from_read=F.lit(1)),
    ]
    counters = reduce(lambda a, b: a.join(b, G, "full_outer"), parts).na.fill(0)
    return {"nodes": out_nodes, "edges": reinforce(stored, log, now), "counters": counters, "flagged": contradictions(acting), "warnings": warnings}


def sticky_self(meta: DataFrame, inferred: DataFrame) -> DataFrame:
    """``graph_id, self_key``: the designated self of each graph, once known for good, else the inferred one."""
    j = meta.select(G, F.col("self_key").alias("known")).join(inferred.select(G, "self_key"), G, "full_outer")
    return j.select(G, F.coalesce("known", "self_key").alias("self_key"))


def decay_edges(edges: DataFrame, now: str) -> DataFrame:
    """Edges decayed from their last update to ``now``, with ``dormant``; those without a usable instant or class stay."""
    at = F.to_timestamp(F.lit(now))
    days = D.elapsed_days(instant("updated_at"), at)
    fresh = D.decayed(F.col("strength"), F.col("stability"), days)
    return edges.withColumn("decayed", fresh.isNotNull()).withColumn("strength", F.coalesce(fresh, F.col("strength"))).withColumn("dormant", D.is_dormant(F.col("strength")))


def decay_due(last: Column, now: Column, force: bool = False) -> Column:
    """Whether a decay may run: never ran, forced, or at least a day ago."""
    return F.lit(force) | last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= config.DECAY_GATE_HOURS * 3_600_000_000)


def graph_delta(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``key, change`` of rows created, changed or removed between two states of a table."""
    a = before.select(*key, F.struct(*values).alias("_a"))
    b = after.select(*key, F.struct(*values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(*key, change.alias("change")).where("change is not null")


def index_sync_plan(index: DataFrame, inputs: DataFrame) -> DataFrame:
    """``graph_id, key, action`` (keep, drop, add) that brings an index to the current keys; only keys count."""
    j = index.select(G, "key", F.lit(1).alias("i")).distinct().join(inputs.select(G, "key", F.lit(1).alias("c")).distinct(), [G, "key"], "full_outer")
    return j.select(G, "key", F.when(F.col("c").isNull(), "drop").when(F.col("i").isNull(), "add").otherwise("keep").alias("action"))


def index_inputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, key, text`` of everything that's embedded: nodes, and each relation once as a phrase."""
    own = nodes.select(G, "key", T.node_text("name", "aliases").alias("text"))
    relations = edges.select(G, "relation").distinct().select(G, T.relation_index_key("relation").alias("key"), T.relation_phrase("relation").alias("text"))
    return own.unionByName(relations)


def first_edge_self(edges: DataFrame) -> DataFrame:
    """``graph_id, self_key``: the source of a graph's first edge (by instant, then id)."""
    at = F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0)))
    return edges.groupBy(G).agg(F.min_by("source_key", F.struct(at.alias("a"), F.col("id").alias("i"))).alias("self_key"))


def numbered_turns(turns: DataFrame, conversation: str = "conv_id", order: str = "pos") -> DataFrame:
    """Turns with their number ``turn`` from 1 inside a conversation."""
    return turns.withColumn("turn", F.row_number().over(Window.partitionBy(conversation).orderBy(order)))


def unwritten_turns(turns: DataFrame, written: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Numbered turns beyond a conversation's high-water mark (``written``: ``conversation, done``)."""
    marks = written.select(conversation, F.col("done").alias("_done"))
    return turns.join(marks, conversation, "left").where(F.col("turn") > F.coalesce("_done", F.lit(0))).drop("_done")


def spoken_turns(turns: DataFrame, role: str | None = None) -> DataFrame:
    """Turns with text, of one role if asked for (extraction may read the user's turns alone)."""
    said = turns.where(F.btrim(F.coalesce("text", F.lit(""))) != "")
    return said if role is None else said.where(F.col("role") == role)


def conversation_jsonl(turns: DataFrame, conversation: str, order: str, fields: list[str], part_chars: int = 1 << 20, unnamed: str = "(null)") -> DataFrame:
    """``conversation, part, jsonl``: each conversation's turns as JSON lines in order, nulls written out.

    A conversation comes in numbered parts (numbers are left out after a very long turn); joined with newlines, they are
    the whole. A part has the turns that begin within one multiple of ``part_chars``, so only its last can pass that. Only turn sizes of one conversation
    meet in a task, never its texts. Turns of a null conversation are the conversation ``unnamed``.
    """
    rows = turns.select(F.coalesce(F.col(conversation).cast("string"), F.lit(unnamed)).alias(conversation), F.col(order).alias("o"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("j"))
    sizes = rows.groupBy(conversation, "o").agg(F.sum(F.length("j").cast("bigint") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy(conversation).orderBy("o").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.select(F.col(conversation).alias("_c"), F.col("o").alias("_o"), F.floor(F.coalesce(before, F.lit(0)) / part_chars).alias("part"))
    parted = rows.join(placed, (F.col(conversation) == F.col("_c")) & F.col("o").eqNullSafe(F.col("_o"))).groupBy(conversation, "part").agg(F.array_sort(F.collect_list(F.struct("o", "j"))).alias("r"))
    return parted.select(conversation, "part", F.array_join(F.transform("r", lambda x: x["j"]), "\n").alias("jsonl"))
