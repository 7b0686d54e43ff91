"""Contexts of reads, graph by graph: the same as the operators one by one, and little more than the input is shuffled."""

import random

import pytest

from mnemora.config import RetrievalConfig
from mnemora.operators import context as Co
from mnemora.operators import retrieve as Re
from mnemora.plans import memory as M

NODE = "graph_id bigint, id string, key string, name string, kind string, aliases array<string>, confidence double, source_episode_ids array<string>, created_at string"
EDGE = "graph_id bigint, id string, key string, source_key string, relation string, target_key string, strength double, snippet string, properties map<string,string>, created_at string"
WORDS = "amber birch cedar dune ember fjord grove heath inlet jetty knoll lagoon marsh oasis pines quarry ridge spring tarn vale".split()


def graphs(spark, graphs=3, n=24, asks=60):
    """Graphs with repeated nodes and edges, self-loops, ends without a node, hidden edges, equal snippets, nulls."""
    rng = random.Random(5)
    nodes, edges, asked = [], [], []
    for g in range(graphs):
        keys = [f"TOPIC::{rng.choice(WORDS)}_{i}" for i in range(n)]
        at = lambda: f"2025-0{rng.randint(1, 9)}-01T00:00:00+00:00"
        for i, k in enumerate(keys):
            row = (g, f"n{i}", k, k[7:].replace("_", " "), "TOPIC", rng.choice([None, [rng.choice(WORDS), None]]), 0.5, rng.choice([None, [f"e{rng.randint(0, 6)}", None], [f"e{rng.randint(0, 6)}"] * 2]), rng.choice([at(), None, "soon"]))
            nodes += [row] * rng.choice([1, 1, 2])
        nodes.append((g, "n99", keys[0], "written later", "TOPIC", None, 0.5, None, "2026-01-01T00:00:00+00:00"))
        for i in range(3 * n):
            s, t = rng.choice(keys), rng.choice([*keys, f"TOPIC::ghost_{i % 4}"])
            relation = rng.choice(["LIKES", "NEAR_TO", "AMBER_OF"])
            row = (g, f"x{i}", f"{s}::{relation}::{t}", s, relation, t, rng.choice([0.0, 5.0, 50.0, 100.0, 100.0]), rng.choice([None, "", "said once", f"snippet {i % 20}"]), rng.choice([None, {}, {"superseded_by": "y"}, {"superseded_by": ""}]), at())
            edges += [row] * rng.choice([1, 1, 2])
        asked += [(1000 * g + i, g, " ".join(rng.choices(WORDS, k=3)) if i else None) for i in range(asks)]
    asked.append((9999, 77, "amber in a graph without rows"))
    return spark.createDataFrame(asked, "ask bigint, graph_id bigint, message string"), spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def rows(df):
    return sorted(tuple(r) for r in df.select("ask", "graph_id", "text", "memory_block", "context_block").fillna("-").collect())


@pytest.mark.parametrize("cfg", [RetrievalConfig(), RetrievalConfig(primary_threshold=0.1, secondary_threshold=0.2, node_budget=5, max_depth=3)])
def test_contexts_equal_the_operators_one_by_one(spark, monkeypatch, cfg):
    tables = graphs(spark)
    want = rows(Re.read(*tables, cfg)["context"])
    assert len(want) > 100 and rows(Co.contexts(*tables, cfg)) == want
    # Split questions, small arrays; graphs beyond a worker's arrays.
    monkeypatch.setattr(Co, "ASKS", 7)
    monkeypatch.setattr(Co, "CELLS", 50)
    assert rows(Co.contexts(*tables, cfg)) == want
    monkeypatch.setattr(Co, "GRAPH_ROWS", 3 * 24 + 24 + 48)
    assert rows(Co.contexts(*tables, cfg)) == want


def test_read_query_shuffles_about_its_input(spark, tmp_path):
    messages, nodes, edges = graphs(spark, asks=400)
    nodes.write.parquet(f"{tmp_path}/nodes.parquet")
    edges.write.parquet(f"{tmp_path}/edges.parquet")
    messages.selectExpr("ask as read_id", "graph_id", "message as message_preview").write.parquet(f"{tmp_path}/read_trace.parquet")
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    assert M.QUERIES["y01_read"](spark, str(tmp_path)).count() > 1000
    one = written() - before
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file())
    assert one < 6 * size, (one, size)
