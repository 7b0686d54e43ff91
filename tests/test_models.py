"""Model calls with retries and audits, embedders, campaign evaluation."""

import pytest

from mnemora.operators import campaign
from mnemora.sources import models as M


def test_retries_rotate_keys():
    seen, slept = [], []

    def call(prompt, key):
        seen.append(key)
        if len(seen) < 4:
            raise RuntimeError("HTTP 429: rate limit")
        return prompt.upper()

    assert M.with_retries(call, ["a", "b"], sleep=slept.append)("x") == "X"
    assert seen == ["a", "b", "a", "b"] and slept == [4.0]
    with pytest.raises(ValueError):
        M.with_retries(lambda p, k: int("x"), ["a"])("x")
    with pytest.raises(RuntimeError):
        M.with_retries(lambda p, k: (_ for _ in ()).throw(RuntimeError("quota")), ["a"], sleep=lambda s: None)("x")


def test_generated(spark):
    df = spark.createDataFrame([("a", "hi"), ("b", None), ("c", "boom")], "batch_id string, prompt string")

    def make():
        def call(text):
            if text == "boom":
                raise ValueError(text)
            return text + "!"

        return call

    got = {r.batch_id: r for r in M.generated(df, make).collect()}
    assert got["a"].reply == "hi!" and got["b"].reply == "!" and got["c"].error == "ValueError: boom" and got["a"].prompt_chars == 2


def test_embedded(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "key int, text string")
    got = {r.key: r.vec for r in M.embedded(df, lambda: lambda texts: [[len(t), 3.0] for t in texts], "m").collect()}
    assert got[2] == [0.0, 1.0] and got[1][0] == pytest.approx(2 / 13**0.5)
    assert M.ordered_embeddings({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2) == [[1], [2]]
    with pytest.raises(RuntimeError):
        M.ordered_embeddings({"data": []}, 1)
    assert M.endpoint("http://h/v1/", "/chat") == "http://h/v1/chat"


def test_campaign(spark):
    probes = spark.createDataFrame([(1, ["Ann"], None, ["bob"], None, True, None), (2, None, ["x", "q"], None, None, None, 1), (3, None, None, None, True, None, None)], "probe_id int, contains_all array<string>, contains_any array<string>, excludes array<string>, expect_empty boolean, expect_nonempty boolean, max_selected int")
    contexts = spark.createDataFrame([(1, "ANN and Bob", ["a"]), (2, "only z", ["a", "b"])], "probe_id int, text string, selected array<string>")
    got = campaign.probe_results(probes, contexts)
    assert {r.probe_id: r.failures for r in got.collect()} == {1: ["excludes"], 2: ["contains_any", "max_selected"], 3: []}
    s = campaign.summary(got).first()
    assert (s.checked, s.passed, s.failed) == (3, 1, 2)
    want = spark.createDataFrame([("s", [["ann", "bea"], ["zed"]], ["foe"], 1, 1, None)], "session_id string, has_node_any array<array<string>>, lacks_node_terms array<string>, max_nodes_created int, min_edges_created int, min_edges_superseded int")
    names = spark.createDataFrame([("s", "Ann Lee"), ("s", "Foe Inc")], "session_id string, name string")
    counters = spark.createDataFrame([("s", 2, 1, 0)], "session_id string, nodes_created int, edges_created int, edges_superseded int")
    assert campaign.session_results(want, names, counters).first().failures == ["has_node_any", "lacks_node_terms", "max_nodes_created"]
    assert campaign.unfinished(want, want.limit(0)).count() == 1
