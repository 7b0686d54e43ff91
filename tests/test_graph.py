"""Hand-computed activation, budget, rendering, decay, resolution and write cases."""

import json

import pytest
from pyspark.sql import functions as F

from mnemora.config import RetrievalConfig
from mnemora.functions import decay as D
from mnemora.functions import text as T
from mnemora.functions import vectors as V
from mnemora.operators import consolidate as C
from mnemora.operators import graph as Gr
from mnemora.operators import resolve as R
from mnemora.operators import retrieve as Re

EDGE = "graph_id bigint, id string, key string, source_key string, relation string, target_key string, strength double, confidence double, stability string, ttl_days int, cardinality string, snippet string, evidence string, properties map<string,string>, source_episode_ids array<string>, created_at string, updated_at string"
NODE = "graph_id bigint, id string, key string, name string, kind string, aliases array<string>, confidence double, source_episode_ids array<string>, created_at string"
T0 = "2025-01-01T00:00:00+00:00"


def edges(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        s, rel, t, *more = r
        o = more[0] if more else {}
        out.append((1, f"e{i}", f"{s}::{rel}::{t}", s, rel, t, o.get("strength", 100.0), o.get("confidence", 0.5), o.get("stability", "stable"), o.get("ttl"), o.get("cardinality", "one_to_many"), o.get("snippet", ""), None, o.get("properties"), o.get("episodes"), T0, o.get("updated", T0)))
    return spark.createDataFrame(out, EDGE)


def nodes(spark, *names, episodes=None, kind="PERSON", aliases=None):
    return spark.createDataFrame([(1, n, n, n, kind, (aliases or {}).get(n), 0.5, (episodes or {}).get(n), T0) for n in names], NODE)


def seeds(spark, *keys):
    return spark.createDataFrame([(1, 1, k) for k in keys], "ask bigint, graph_id bigint, key string")


def activation(spark, e, *keys, cfg=RetrievalConfig()):
    return {r.key: r for r in Gr.spreading_activation(seeds(spark, *keys), Gr.adjacency(e), cfg).collect()}


def test_chain(spark):
    e = edges(spark, ("A", "R", "B"), ("B", "R", "C"))
    got = activation(spark, e, "A")
    assert got["B"].score == pytest.approx(0.6) and (got["B"].direction, got["B"].hop) == ("FORWARD", 1)
    assert got["C"].score == pytest.approx(0.18) and got["C"].hop == 2
    assert got["A"].score >= 1 and got["A"].direction == "SEED"
    back = activation(spark, e, "B")
    assert back["A"].score == pytest.approx(0.3) and back["A"].direction == "REVERSE"


def test_convergence_and_hub(spark):
    assert activation(spark, edges(spark, ("A", "R", "C"), ("B", "R", "C")), "A", "B")["C"].score == pytest.approx(1.2)
    hub = activation(spark, edges(spark, *[("H", "R", f"s{i}") for i in range(7)]), "s0", "s1")
    assert hub["H"].score >= 0.3 and all(hub[f"s{i}"].score < 0.3 for i in range(2, 7))


def test_zero_strength_counts_as_one(spark):
    assert activation(spark, edges(spark, ("A", "R", "B", {"strength": 0.0})), "A")["B"].score == 0


def test_co_episode(spark):
    n = nodes(spark, "A", "B", "C", episodes={"A": ["x", None], "B": ["x"], "C": ["y"]})
    act = Gr.spreading_activation(seeds(spark, "A"), Gr.adjacency(edges(spark, ("C", "R", "D"))))
    got = {r.key: r for r in Gr.co_episode_boost(act, n).collect()}
    assert got["B"].score == pytest.approx(0.15) and got["B"].co_episode and "C" not in got


def test_budget(spark):
    rows = [(1, 1, f"f{i}", 0.9 - i / 100, 1, "FORWARD", False) for i in range(9)] + [(1, 1, f"r{i}", 0.4 + i / 100, 1, "REVERSE", False) for i in range(3)]
    act = spark.createDataFrame(rows, "ask bigint, graph_id bigint, key string, score double, hop int, direction string, co_episode boolean")
    got = Gr.select_within_budget(act, RetrievalConfig(node_budget=10)).collect()
    assert len(got) == 10 and sum(r.direction == "REVERSE" for r in got) == 3 and sum(r.direction == "FORWARD" for r in got) == 7
    assert [r.rank for r in sorted(got, key=lambda r: (-r.score, r.key))] == list(range(1, 11))


def test_lines_and_snippets(spark):
    e = edges(spark, *[("H", f"R{'ABCDEF'[i]}", f"s{i}", {"strength": 50.0 + i, "snippet": f"t{i}"}) for i in range(6)], ("H", "OLD", "s0", {"properties": {"superseded_by": "x"}, "snippet": "gone"}))
    sel = spark.createDataFrame([(1, 1, "H", 0.9, 1), (1, 1, "s0", 0.4, 2)], "ask bigint, graph_id bigint, key string, score double, rank int")
    n = nodes(spark, "H", *[f"s{i}" for i in range(6)])
    assert [r.line for r in Gr.memory_lines(sel, e, n).collect()] == ["H -[RA]-> s0"]
    assert [r.snippet for r in Gr.snippets(sel, e).orderBy("ord").collect()] == ["t5", "t4", "t3", "t2"]
    text = Gr.context_text(Gr.memory_lines(sel, e, n), Gr.snippets(sel, e)).first().text
    assert text.startswith("[MEMORY]\nH -[RA]-> s0\n\n[CONTEXT]\n\"t5\"")


def test_neighbourhood(spark):
    e, n = edges(spark, ("A", "R", "B"), ("C", "R", "B"), ("C", "R", "D")), nodes(spark, "A", "B", "C", "D")
    for depth, size in ((0, 1), (1, 3), (2, 4)):
        assert Gr.neighbourhood(seeds(spark, "B"), e, n, depth).count() == size
    assert Gr.neighbourhood(seeds(spark, "ghost"), e, n).count() == 0
    assert Gr.induced_edges(Gr.neighbourhood(seeds(spark, "B"), e, n, 2), e).count() == 3


def test_trace_keeps_totals(spark):
    e = edges(spark, ("A", "R", "B"), ("B", "R", "C"))
    act = activation(spark, e, "A")
    last = {}
    for r in Gr.event_trace(seeds(spark, "A"), Gr.adjacency(e)).orderBy("hop", "edge_id", "direction").collect():
        last[r.to_key] = max(last.get(r.to_key, 0), r.running)
    assert last["C"] == pytest.approx(act["C"].score) and last["A"] == pytest.approx(act["A"].score)


def test_deep_trace_query_crosses_two_hops(spark, tmp_path):
    import __spark_entry__ as entry

    links = [("A", "B", 30.0), ("B", "C", 10.0), ("C", "A", 20.0), ("C", "D", 40.0), ("D", "E", 5.0)]
    spark.createDataFrame([(1, k, k, None) for k in "ABCDE"], "graph_id bigint, id string, key string, created_at string").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(1, f"e{i}", f"{s}R{t}", s, "R", t, w) for i, (s, t, w) in enumerate(links)], "graph_id bigint, id string, key string, source_key string, relation string, target_key string, strength double").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(7, 1, ["A", "A", None])], "read_id bigint, graph_id bigint, seeds array<string>").write.parquet(f"{tmp_path}/read_trace.parquet")
    ways = [(s, t, f"e{i}", "F", w) for i, (s, t, w) in enumerate(links)] + [(t, s, f"e{i}", "R", w) for i, (s, t, w) in enumerate(links)]
    total = {k: sum(w for f, *_, w in ways if f == k) for k in "ABCDE"}
    front, running, want = {"A": 1.0}, {"A": 1.0}, {}
    for hop in (1, 2):
        after = {}
        for f, t, e, d, w in sorted(ways, key=lambda x: (x[2], x[3])):
            if f in front:
                c = front[f] * w / total[f] * 0.6
                after[t], running[t] = after.get(t, 0.0) + c, running.get(t, 0.0) + c
                want[hop, e, f, t, d] = (pytest.approx(c), pytest.approx(running[t]))
        front = after
    got = entry.queries()["g09_event_trace_deep"](spark, str(tmp_path)).collect()
    assert {(r.hop, r.edge_id, r.from_key, r.to_key, r.direction): (r.contribution, r.running) for r in got} == want
    assert {r.hop for r in got} == {1, 2} and len(got) == len(want)


def test_margin_gate(spark):
    def accepted(*scores):
        df = spark.createDataFrame([(1, "n", f"k{i}", s, i + 1) for i, s in enumerate(scores)], "graph_id bigint, noun string, key string, score double, rank int")
        return Re.gated(df).count()

    assert [accepted(0.26, 0.06, 0.02), accepted(0.11, 0.09, 0.07), accepted(1.0, 0.05), accepted(0.10, 0.0)] == [1, 0, 1, 0]


def test_relation_seeds(spark):
    hits = spark.createDataFrame([(1, "n", "REL::X", 0.9, 1), (1, "m", "ghost", 0.9, 1)], "graph_id bigint, noun string, key string, score double, rank int")
    assert sorted(r.key for r in Re.seed_keys(hits, nodes(spark, "A", "B"), edges(spark, ("A", "X", "B"))).collect()) == ["A", "B"]


def test_noun_search_equals_dense(spark):
    import hashlib

    import numpy as np

    texts = {"a": "red boat", "b": "red red house", "c": "old stone bridge", "d": "boat bridge"}
    dim = 16

    def embed(tokens):
        v = np.zeros(dim)
        for t in tokens:
            h = hashlib.sha1(t.encode()).digest()
            v[int.from_bytes(h[:4], "big") % dim] += 1.0 if h[4] & 1 else -1.0
        return v / (np.linalg.norm(v) or 1)

    m = np.stack([embed(t.split()) for t in texts.values()])
    mu = m.mean(axis=0)
    c = m - mu
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    index = spark.createDataFrame([(1, k, t) for k, t in texts.items()], "graph_id bigint, key string, text string")
    nouns = spark.createDataFrame([(1, 1, "boat", 0), (1, 1, "zebra", 1)], "ask bigint, graph_id bigint, noun string, ord int")
    got = {(r.noun, r.key): r.score for r in Re.noun_hits(nouns, index, RetrievalConfig(embed_dimensions=dim, seed_top_k=4)).collect()}
    for noun in ("boat", "zebra"):
        q = embed([noun]) - mu
        q /= np.linalg.norm(q)
        want = {(noun, k): s for k, s in zip(texts, c @ q, strict=True) if s >= 0}
        assert {k: v for k, v in got.items() if k[0] == noun} == pytest.approx(want, abs=1e-6)


def test_nearest(spark):
    v = V.centred(spark.createDataFrame([(0, [5.0, 5.0, 1.0]), (1, [5.0, 5.0, 1.1]), (2, [5.0, 6.0, 0.0])], "vec_id int, embedding array<float>"))
    assert V.nearest(v.where("vec_id = 0"), v, 1, "vec_id", "vec_id").first().v_id == 0


def test_scalars(spark):
    row = spark.range(1).select(
        T.normal_relation(F.lit(" works-at the ")).alias("rel"),
        T.node_key(F.lit("PERSON"), F.lit("Étion  dansé!")).alias("key"),
        F.round(T.name_similarity(F.lit("Jonathan"), F.lit("Jonathon")), 3).alias("sim"),
        T.name_similarity(F.lit("!"), F.lit("?")).alias("empty"),
        T.token_overlap(T.name_tokens(F.lit("Elon")), T.name_tokens(F.lit("Elon Musk"))).alias("elon"),
        T.token_overlap(T.name_tokens(F.lit("New York")), T.name_tokens(F.lit("New Jersey"))).alias("new"),
        T.nouns(F.lit("Tell me about the Garden and the garden of I")).alias("nouns"),
        T.clamp01(F.lit("7"), 0.5).alias("c1"),
        T.clamp01(F.lit("x"), 0.5).alias("c2"),
        T.repaired_json(F.lit('Sure!\n```json\n{"a": [1, 2,],}\n```')).alias("json"),
        T.repaired_json(F.lit("no json")).alias("none"),
        T.clean_list(F.array(F.lit(" a "), F.lit(None), F.lit(" ")), 5).alias("clean"),
        T.nullish(F.lit(" None ")).alias("nullish"),
    ).first()
    assert (row.rel, row.key, row.sim, row.empty) == ("WORKS_AT_THE", "PERSON::tion_dans", 0.875, 1.0)
    assert row.elon and not row.new and "garden" in row.nouns and "me" not in row.nouns
    assert (row.c1, row.c2, row.none, row.clean, row.nullish) == (1.0, 0.5, None, ["a"], None)
    assert json.loads(row.json) == {"a": [1, 2]}


def test_decay_laws(spark):
    f = lambda s, c, d: D.decayed(F.lit(s), F.lit(c), F.lit(d))
    row = spark.range(1).select(f(100.0, "stable", 30.0).alias("s"), f(100.0, "mutable", 30.0).alias("m"), f(100.0, "ephemeral", 30.0).alias("e"), f(1.0, "odd", 1.0).alias("o"), D.reinforced(F.lit(50.0), F.lit(1)).alias("r")).first()
    assert (round(row.s, 2), round(row.m, 2), round(row.e, 2), row.o, row.r) == (86.07, 54.88, 0.25, None, 65.0)
    once, step = 0.8607079764250578, 1.0
    for _ in range(30):
        step *= 2.718281828459045 ** (-0.005)
    assert step == pytest.approx(once, abs=1e-9)


def test_rules_in_order(spark):
    n = nodes(spark, "PERSON::samuel", "PERSON::edward", "PERSON::theodore", "PERSON::jonathon_smith", "PERSON::elon_musk", kind="PERSON", aliases={"PERSON::elon_musk": ["The Boss"]}).withColumn("name", F.initcap(F.replace(F.substring("key", 9, 99), F.lit("_"), F.lit(" "))))
    staged = spark.createDataFrame([(1, "e1", "Sam", "PERSON"), (1, "e2", "Ted", "PERSON"), (1, "e3", "Jonathan Smith", "PERSON"), (1, "e4", "the boss", "PERSON"), (1, "e5", "Elon", "PERSON"), (1, "e6", "Samuel", "ORG"), (1, "e7", "samuel", "PERSON"), (1, "e8", "User", "PERSON")], "graph_id bigint, entity string, name string, kind string")
    own = spark.createDataFrame([(1, "PERSON::edward")], "graph_id bigint, self_key string")
    got = {r.entity: (r.rule, r.decision, r.target_key) for r in R.resolve(staged, n, own).collect()}
    assert got["e1"] == ("abbreviation", "auto", "PERSON::samuel")
    assert got["e2"] == ("abbreviation", "review", None)
    assert got["e3"] == ("fuzzy", "review", None)
    assert got["e4"] == ("alias", "auto", "PERSON::elon_musk")
    assert got["e5"] == ("token_overlap", "review", None)
    assert got["e6"] == ("none", "new", None)
    assert got["e7"] == ("exact_key", "auto", "PERSON::samuel")
    assert got["e8"] == ("self", "auto", "PERSON::edward")


def test_bands(spark):
    cand = spark.createDataFrame([("a", "k", 0.95), ("b", "k", 0.8), ("c", "k", 0.7), ("d", "k", 0.55), ("e", "k1", 0.8), ("e", "k2", 0.8)], "entity string, key string, confidence double")
    got = {r.entity: (r.decision, r.flagged, r.target_key) for r in R.banded(cand, ["entity"]).collect()}
    assert got == {"a": ("merge", False, "k"), "b": ("merge", True, "k"), "c": ("merge", True, "k"), "d": ("new", False, None), "e": ("merge", True, "k2")}


def test_supersession(spark):
    old = edges(spark, ("u", "CONSIDERING_X", "a"), ("u", "MANAGED_BY", "p", {"cardinality": "one_to_one"}), ("u", "LIKES", "x"))
    new = edges(spark, ("u", "DID_X", "a"), ("u", "MANAGED_BY", "d"), ("u", "LIKES", "y")).withColumn("seq", F.col("id"))
    got = C.supersession_candidates(new, old)
    assert sorted((r.old_id, r.new_relation) for r in got.collect()) == [("e0", "DID_X"), ("e1", "MANAGED_BY")]
    after = {r.id: r for r in C.apply_supersessions(old, got).collect()}
    assert after["e0"].strength == 1.0 and after["e0"].properties["superseded_by"] and after["e2"].strength == 100.0
    # Reinforcement after a demotion lifts the edge again, but it stays tagged.
    log = spark.createDataFrame([(1, "u::CONSIDERING_X::a")], "graph_id bigint, edge string")
    lifted = {r.id: r for r in C.reinforce(C.apply_supersessions(old, got), log).collect()}
    assert lifted["e0"].strength == 16.0 and lifted["e0"].properties["superseded_by"]


def test_edge_upsert(spark):
    old = edges(spark, ("a", "R", "b", {"strength": 50.0, "confidence": 0.6, "snippet": "old"}))
    new = edges(spark, ("a", "R", "b", {"confidence": 0.9, "snippet": "better"}), ("a", "R", "b", {"confidence": 0.9, "snippet": "late"}), ("x", "R", "x"), ("c", "R", "d", {"strength": 3.0})).withColumn("seq", F.col("id"))
    got = {r.key: r for r in C.upsert_edges(old, new).collect()}
    assert (got["a::R::b"].strength, got["a::R::b"].snippet, got["a::R::b"].outcome) == (80.0, "better", "reinforced")
    assert got["c::R::d"].strength == 100.0 and "x::R::x" not in got


def test_payloads(spark):
    reply = json.dumps({"entities": [{"text": "Ann", "type": "person"}, {"text": "", "type": "ORG"}, {"text": "X", "type": "ALIEN"}], "relationships": [{"source": "Ann", "relation": "works at", "target": "Acme", "stability": "weird", "ttl_days": 3}, {"source": "Q", "relation": "R", "target": "Z"}, {"source": "Ann", "relation": "IS", "target": "ann"}], "episode": {"tags": [" a ", "", "b"]}})
    p = C.parsed_payloads(spark.createDataFrame([("b", f"```json\n{reply}\n```")], "batch_id string, reply string"))
    good, bad = C.payload_entities(p)
    assert [r.key for r in good.collect()] == ["PERSON::ann"] and sorted(r.reason for r in bad.collect()) == ["entity without text", "unknown entity type"]
    e, made, rejected = C.payload_edges(p, good, spark.createDataFrame([], "batch_id string, canon string, key string"))
    row = e.first()
    assert (row.key, row.stability, row.ttl_days) == ("PERSON::ann::WORKS_AT::OTHER::acme", "stable", None)
    assert [(r.key, r.confidence) for r in made.collect()] == [("OTHER::acme", 0.5)]
    assert sorted(r.reason for r in rejected.collect()) == ["self loop", "unknown endpoint"]
    ep = C.payload_episodes(p).first()
    assert (ep.summary, ep.importance, ep.tags) == ("(no durable summary)", 0.1, ["a", "b"])


def test_delta_orphans_sync(spark):
    n = nodes(spark, "A", "B", "C")
    assert [r.key for r in C.orphans(n, edges(spark, ("A", "R", "B"))).collect()] == ["C"]
    assert [r.end for r in C.missing_ends(edges(spark, ("A", "R", "Z")), n).collect()] == ["Z"]
    plan = {r.key: r.action for r in C.index_sync_plan(nodes(spark, "A", "X"), n).collect()}
    assert plan == {"A": "keep", "X": "drop", "B": "add", "C": "add"}
    assert C.graph_delta(n, n, ["graph_id", "key"], ["name"]).count() == 0
    assert C.validated_edges(edges(spark, ("A", "R", "A"), ("A", "r", "B"), ("A", "R", "B"))).where("reason is null").count() == 1
