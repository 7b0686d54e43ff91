"""Entity resolution of staged entities against a graph: ordered rules, candidate bands, remapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora import config
from mnemora.functions.text import name_tokens, token_overlap
from mnemora.runtime import canonical_name, checkpointed

G = "graph_id"
#: Groups of short forms of given names; "ted" stands in two, so it's never merged unseen.
ABBREVIATIONS = (
    ("william", "bill", "will", "billy"),
    ("samuel", "sam", "sammy"),
    ("elizabeth", "liz", "beth", "eliza", "lizzie", "betty"),
    ("robert", "rob", "bob", "bobby"),
    ("richard", "rick", "rich", "richie"),
    ("michael", "mike", "mikey", "mick"),
    ("james", "jim", "jimmy", "jamie"),
    ("john", "johnny", "jack"),
    ("margaret", "maggie", "meg", "peggy"),
    ("katherine", "kate", "katie", "kathy", "kat", "catherine"),
    ("thomas", "tom", "tommy"),
    ("charles", "charlie", "chuck"),
    ("joseph", "joe", "joey"),
    ("daniel", "dan", "danny"),
    ("matthew", "matt", "matty"),
    ("anthony", "tony"),
    ("christopher", "chris"),
    ("nicholas", "nick", "nicky"),
    ("alexander", "alex", "sasha"),
    ("benjamin", "ben", "benny"),
    ("edward", "ed", "eddie", "ted", "ned"),
    ("andrew", "andy", "drew"),
    ("frederick", "fred", "freddy"),
    ("theodore", "theo", "ted", "teddy"),
    ("jonathan", "jon", "jonny"),
    ("stephen", "steve", "stevie", "steven"),
    ("timothy", "tim", "timmy"),
)
RULES = ("self", "exact_key", "alias", "abbreviation", "fuzzy", "token_overlap")


def abbreviation_groups(canon: Column) -> Column:
    """Numbers of the abbreviation groups that hold a canonical name."""
    return F.array_compact(F.array(*[F.when(canon.isin(*g), F.lit(i)) for i, g in enumerate(ABBREVIATIONS)]))


def _named(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == G else f"{prefix}_{c}") for c in columns])


def exact_matches(staged: DataFrame, nodes: DataFrame) -> DataFrame:
    return staged.join(nodes.select(G, F.col("key").alias("target_key")), (staged[G] == nodes[G]) & (staged["key"] == F.col("target_key"))).select(staged[G], "entity", "target_key")


def alias_matches(staged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the same kind with an alias of the same canonical form (no empty forms)."""
    aliases = nodes.select(G, "kind", F.col("key").alias("target_key"), F.explode("aliases").alias("alias")).select(G, "kind", "target_key", canonical_name("alias").alias("canon")).where("canon <> ''").distinct()
    return staged.join(aliases, [G, "kind", "canon"]).select(G, "entity", "target_key").distinct()


def abbreviation_matches(staged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the same kind whose name shares an abbreviation group."""
    a = staged.select(G, "kind", "entity", "canon", F.explode(abbreviation_groups(F.col("canon"))).alias("group"))
    b = nodes.select(G, "kind", F.col("key").alias("target_key"), F.explode(abbreviation_groups(canonical_name("name"))).alias("group"))
    return a.join(b, [G, "kind", "group"]).select(G, "entity", "target_key").distinct()


def fuzzy_matches(staged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the same kind with a name similarity above the threshold.

    Lossless blocking: a similarity above 0.8 allows k < 0.2 n edits of the longer name of n letters. Both names are
    cut into pieces, one more than the greatest k; one piece then stands unchanged in the other name, at most k places
    away. Pieces join on text and nearby place, and only those pairs are measured.
    """
    a = staged.select(G, "kind", "entity", "canon").distinct()
    b = nodes.select(G, "kind", F.col("key").alias("target_key"), canonical_name("name").alias("name_canon")).distinct()

    def allowed(n: Column) -> Column:
        # The other name is at most n / 0.8 letters long, so this bounds the edits of any pair above the threshold.
        return F.ceil(n * 0.25).cast("int")

    def pieces(canon: Column) -> Column:
        n, k = F.length(canon), allowed(F.length(canon)) + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.substr(canon, (i * n / k).cast("int") + 1, ((i + 1) * n / k).cast("int") - (i * n / k).cast("int")).alias("piece"), (i * n / k).cast("int").alias("at"), n.alias("n"))))

    def grams(canon: Column) -> Column:
        n = F.length(canon)
        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), lambda size: F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(F.substr(canon, i + 1, size).alias("piece"), i.alias("at"))))))

    cut = a.select("*", F.explode(pieces(F.col("canon"))).alias("p")).where("p.piece <> ''").select(G, "kind", "entity", "canon", "p.piece", F.col("p.at").alias("pa"), F.col("p.n").alias("n"))
    sizes = [int(r[0]) for r in cut.select(F.length("piece")).distinct().collect()]
    held = b.select("*", F.explode(F.filter(grams(F.col("name_canon")), lambda g: F.length(g["piece"]).isin(*(sizes or [0])))).alias("p")).select(G, "kind", "target_key", "name_canon", "p.piece", F.col("p.at").alias("pb"))
    near = cut.join(held, [G, "kind", "piece"]).where(F.abs(F.col("pa") - F.col("pb")) <= allowed(F.col("n"))).select(G, "entity", "target_key", "canon", "name_canon").distinct()
    longest = F.greatest(F.length("canon"), F.length("name_canon"))
    similarity = 1 - F.levenshtein("canon", "name_canon") / longest
    empty = a.where("canon = ''").join(b.where("name_canon = ''"), [G, "kind"]).select(G, "entity", "target_key", F.lit(1.0).alias("similarity"))
    return near.select(G, "entity", "target_key", similarity.alias("similarity")).where(F.col("similarity") > config.FUZZY_ABOVE).unionByName(empty)


def token_matches(staged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the same kind whose name overlaps in words (they must share one of two letters or more, so that's the join key)."""
    a = staged.select(G, "kind", "entity", F.filter(F.array_distinct(F.split("canon", "_")), lambda t: t != "").alias("ta"))
    b = nodes.select(G, "kind", F.col("key").alias("target_key"), name_tokens("name").alias("tb"))
    a, b = a.withColumn("t", F.explode("ta")).where("length(t) >= 2"), b.withColumn("t", F.explode("tb")).where("length(t) >= 2")
    return a.join(b, [G, "kind", "t"]).where(token_overlap(F.col("ta"), F.col("tb"))).select(G, "entity", "target_key").distinct()


def resolve(staged: DataFrame, nodes: DataFrame, self_keys: DataFrame | None = None) -> DataFrame:
    """``graph_id, entity, rule, decision, target_key, candidates`` for each staged entity (``graph_id, entity, name, kind``).

    Rules run in order, cheap joins first, and each sees only what the earlier ones left. One match of rules 0 to 3
    merges by itself; several matches, and any match of the later rules, need review; none is a new entity.
    """
    base = staged.select(G, "entity", "kind", canonical_name("name").alias("canon")).withColumn("key", F.concat("kind", F.lit("::"), "canon")).distinct()
    left, found = base, []
    steps = [("exact_key", exact_matches), ("alias", alias_matches), ("abbreviation", abbreviation_matches), ("fuzzy", fuzzy_matches), ("token_overlap", token_matches)]
    if self_keys is not None:
        own = base.where(F.col("canon").isin(*config.SELF_PLACEHOLDERS)).join(self_keys.select(G, F.col("self_key").alias("target_key")), G).where("target_key is not null")
        found.append(own.select(G, "entity", "target_key", F.lit("self").alias("rule")))
        left = left.join(found[-1].select(G, "entity"), [G, "entity"], "left_anti")
    for rule, match in steps:
        got = checkpointed(match(left, nodes).select(G, "entity", "target_key", F.lit(rule).alias("rule")))
        found.append(got)
        left = left.join(got.select(G, "entity").distinct(), [G, "entity"], "left_anti")
    matches = reduce(lambda x, y: x.unionByName(y), found).groupBy(G, "entity", "rule").agg(F.array_sort(F.collect_set("target_key")).alias("candidates"))
    out = base.select(G, "entity").distinct().join(matches, [G, "entity"], "left")
    auto = (F.size("candidates") == 1) & F.col("rule").isin("self", "exact_key", "alias", "abbreviation")
    decision = F.when(F.col("rule").isNull(), "new").when(auto, "auto").otherwise("review")
    return out.select(G, "entity", F.coalesce("rule", F.lit("none")).alias("rule"), decision.alias("decision"), F.when(auto, F.col("candidates")[0]).alias("target_key"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def banded(candidates: DataFrame, group: list[str]) -> DataFrame:
    """``group, target_key, confidence, decision, flagged`` of the best candidate (``key, confidence``); ties go to the greatest key."""
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("confidence"), F.desc("key")))).where("_r = 1")
    merge = F.col("confidence") >= config.FLAG_FROM
    return best.select(*group, F.when(merge, F.col("key")).alias("target_key"), "confidence", F.when(merge, "merge").otherwise("new").alias("decision"), (merge & (F.col("confidence") <= config.AUTO_ABOVE)).alias("flagged"))


def remapped(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Both ends through ``graph_id, old_key, new_key``; keys without an entry stay."""
    src = remap.select(G, F.col("old_key").alias("source_key"), F.col("new_key").alias("_s"))
    dst = remap.select(G, F.col("old_key").alias("target_key"), F.col("new_key").alias("_t"))
    out = edges.join(src, [G, "source_key"], "left").join(dst, [G, "target_key"], "left")
    return out.withColumns({"source_key": F.coalesce("_s", "source_key"), "target_key": F.coalesce("_t", "target_key")}).drop("_s", "_t").withColumn("key", F.concat("source_key", F.lit("::"), "relation", F.lit("::"), "target_key"))
