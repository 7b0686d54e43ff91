"""Best representative of each duplicate group, field by field, and which of its many values are true.

Two stages over one grouping. ``survivors`` names, per node, the record from which each surviving single value is
taken. ``true_values`` is the latent two-sided quality model for multi-valued fields: a source (an episode that wrote
records) has a sensitivity (it lists a value that is true) and a specificity (it leaves out one that is false). Both
and the probability of every value are inferred by expectation-maximisation, and every value judged true is retained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.runtime import broadcast_if_small, canonical_name, checkpointed, instant

NODE = ["graph_id", "node_key"]
#: Nodes that a source writes about before its rows are split over several join keys.
SPLIT = 100_000


def node_key(key: Column | str) -> Column:
    """``KIND::canonical_name`` of a key, however it is written; null if the key has no ``::``."""
    c = F.col(key) if isinstance(key, str) else key
    cut = F.instr(c, "::")
    return F.when(cut > 0, F.concat(F.upper(F.btrim(F.substr(c, F.lit(1), cut - 1))), F.lit("::"), canonical_name(F.substr(c, cut + 2))))


def value_forms(values: Column) -> Column:
    """Distinct values of a text array, blank ones, letter case and outer blanks aside; null gives an empty array."""
    trimmed = F.transform(F.array_compact(values), lambda v: F.lower(F.regexp_replace(v, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return F.coalesce(F.array_distinct(F.filter(trimmed, lambda v: v != "")), F.array().cast("array<string>"))


def prepared(records: DataFrame) -> DataFrame:
    """Records with ``node_key`` and usable evidence per field; identical repeats and records without id or node are left out."""
    conf = F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.col("confidence"))
    at = instant("updated_at")
    received = F.col("received_at").cast("timestamp")
    return (
        records.select("rec_id", "graph_id", "key", "aliases", "confidence", "source_episode_ids", "updated_at", "received_at")
        .withColumn("node_key", node_key("key"))
        .where("rec_id is not null and graph_id is not null and node_key is not null")
        .select(
            "rec_id",
            *NODE,
            conf.alias("confidence"),
            value_forms(F.col("aliases")).alias("aliases"),
            F.coalesce(F.array_distinct(F.array_compact("source_episode_ids")), F.array().cast("array<string>")).alias("episodes"),
            F.when(at <= received, at).alias("updated_at"),
        )
    )


def survivors(records: DataFrame) -> DataFrame:
    """Per node with two or more distinct ``rec_id``, the record that each surviving value is taken from.

    ``confidence_rec`` has the greatest confidence within 0 to 1, ``aliases_rec`` the most distinct aliases,
    ``episodes_rec`` the most distinct episode ids, ``updated_rec`` the latest update that is an instant not after the
    record's own ``received_at``; ties go to the smallest ``rec_id``. One aggregation with map-side partial results:
    a node of any number of records needs constant space. Defined cases: where no record has a usable confidence or
    instant the column is null; an empty or null array counts as no values (so the smallest ``rec_id`` wins if all
    are); differing rows of one ``rec_id`` count as one record with the best of each value; an empty table gives no rows.
    """
    rows = prepared(records)

    def best(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-F.col("rec_id")).alias("r"))))["r"]

    groups = rows.groupBy(*NODE).agg(
        F.min("rec_id").alias("_low"),
        F.max("rec_id").alias("_high"),
        best(F.col("confidence")).alias("c"),
        best(F.size("aliases")).alias("a"),
        best(F.size("episodes")).alias("e"),
        best(F.col("updated_at")).alias("u"),
    )
    return groups.where("_low < _high").select(*NODE, (-F.col("c")).alias("confidence_rec"), (-F.col("a")).alias("aliases_rec"), (-F.col("e")).alias("episodes_rec"), (-F.col("u")).alias("updated_rec"))


def _claims(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who speaks of which node (``graph_id, node, source, salt``) and what they list (``value`` besides), in 64-bit numbers.

    Numbers are told apart inside a graph only. ``salt`` spreads the rows of a source of many nodes.
    """
    rows = prepared(records)
    sources = F.when(F.size("episodes") > 0, F.col("episodes")).otherwise(F.array(F.lit("")))
    said = rows.select("graph_id", F.xxhash64("node_key").alias("node"), F.explode(sources).alias("source"), "aliases").withColumn("source", F.xxhash64("source"))
    says = said.select("graph_id", "node", "source").distinct()
    listed = said.select("graph_id", "node", "source", F.explode("aliases").alias("value")).withColumn("value", F.xxhash64("value")).distinct()
    per = broadcast_if_small(says.groupBy("graph_id", "source").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("splits")))
    salted = lambda df: checkpointed(df.join(per, ["graph_id", "source"]).withColumn("salt", F.pmod("node", "splits").cast("int")))
    return salted(says), salted(listed).drop("splits")


def source_quality(says: DataFrame, withp: DataFrame, belief: DataFrame) -> DataFrame:
    """``graph_id, source, splits, sensitivity, specificity`` from the probabilities of all values (``withp``: listed ones with theirs).

    What a source leaves out is the node's total less what it lists, so no table of sources by values is made.
    """
    total = belief.groupBy("graph_id", "node").agg(F.sum("probability").alias("t"), F.count(F.lit(1)).alias("v"))
    spoken = says.join(total, ["graph_id", "node"]).groupBy("graph_id", "source").agg(F.max("splits").alias("splits"), F.sum("t").alias("t1"), F.sum(F.col("v") - F.col("t")).alias("t0"))
    named = withp.groupBy("graph_id", "source").agg(F.sum("probability").alias("s1"), F.sum(1 - F.col("probability")).alias("s0"))
    j = spoken.join(named, ["graph_id", "source"], "left").na.fill(0.0, ["s1", "s0"])
    return j.select("graph_id", "source", "splits", ((F.col("s1") + 2.0) / (F.col("t1") + 3.0)).alias("sensitivity"), ((F.greatest(F.col("t0") - F.col("s0"), F.lit(0.0)) + 3.0) / (F.col("t0") + 4.0)).alias("specificity"))


def true_values(records: DataFrame, rounds: int = 10, prior: float = 0.5, tolerance: float = 0.01) -> DataFrame:
    """Probability that each alias of a node is true, from a latent two-sided quality model of the sources.

    A source that writes about a node claims each of the node's values: it lists it or leaves it out. Starting from
    the share of sources that list a value, rounds alternate between smoothed sensitivities and specificities of all
    sources and the posterior of every value, until no probability moves by more than ``tolerance`` (or ``rounds`` are
    over). Returns ``graph_id, node_key, value, sources, listed, probability``; a value is retained where
    ``probability >= 0.5``. A value's log odds are the node's sum over all sources that speak of it, as if each left
    the value out, corrected by those that list it; so the work follows what is listed, and one hot source or node is
    many small rows, never one task's list. Records without episode ids form one source of the graph; nodes without
    values give no rows; an empty table gives no rows.
    """
    says, listed = _claims(records)
    speakers = says.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("sources"))
    belief = checkpointed(listed.groupBy("graph_id", "node", "value").agg(F.count(F.lit(1)).alias("listed")).join(speakers, ["graph_id", "node"]).withColumn("probability", F.col("listed") / F.col("sources")))
    odds = F.lit(prior / (1 - prior))
    for _ in range(rounds):
        withp = listed.join(belief.select("graph_id", "node", "value", "probability"), ["graph_id", "node", "value"])
        sens, spec = F.col("sensitivity"), F.col("specificity")
        quality = source_quality(says, withp, belief).select("graph_id", "source", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"), F.log((1 - sens) / spec).alias("without"), (F.log(sens / (1 - spec)) - F.log((1 - sens) / spec)).alias("gain"))
        quality = checkpointed(quality)
        join = ["graph_id", "source", "salt"]
        base = says.join(quality, join).groupBy("graph_id", "node").agg(F.sum("without").alias("base"))
        gains = withp.join(quality, join).groupBy("graph_id", "node", "value").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("listed"), F.max("probability").alias("was"))
        after = gains.join(base, ["graph_id", "node"]).join(speakers, ["graph_id", "node"])
        belief = checkpointed(after.withColumn("probability", 1 / (1 + F.exp(-(F.col("base") + F.col("gain") + F.log(odds))))).drop("base", "gain"))
        if belief.where(F.abs(F.col("probability") - F.col("was")) > tolerance).isEmpty():
            break
    texts = prepared(records).select(*NODE, F.explode("aliases").alias("text")).distinct()
    texts = texts.withColumns({"node": F.xxhash64("node_key"), "value": F.xxhash64("text")})
    out = belief.join(texts, ["graph_id", "node", "value"])
    return out.select(*NODE, F.col("text").alias("value"), "sources", "listed", "probability")


def fused(records: DataFrame) -> DataFrame:
    """One surviving record per node: single values from the records named by ``survivors``, all values judged true of ``aliases``."""
    kept = true_values(records).where("probability >= 0.5").groupBy(*NODE).agg(F.array_sort(F.collect_set("value")).alias("aliases"))
    rows = prepared(records)
    best = survivors(records)
    single = rows.join(best, NODE).groupBy(*NODE).agg(
        F.max(F.when(F.col("rec_id") == F.col("confidence_rec"), F.col("confidence"))).alias("confidence"),
        F.max(F.when(F.col("rec_id") == F.col("updated_rec"), F.col("updated_at"))).alias("updated_at"),
        F.array_sort(F.max(F.when(F.col("rec_id") == F.col("episodes_rec"), F.col("episodes")))).alias("source_episode_ids"),
    )
    return single.join(kept, NODE, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
