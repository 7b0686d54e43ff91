"""Snapshot changes and nested records: brute force, hand cases, dirt."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.operators.nested import _deep_json, campaign_items, campaign_tables, interval_nodes, unwrap_json
from mnemora.operators.snapshots import snapshot_changes

SNAP = "graph_id bigint, key string, snapshot_no bigint, name string, kind string, confidence double, aliases array<string>, change_kind string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes(spark):
    data = [
        (1, "a", 0, "A", "X", 0.5, ["p", "q", "p"], "clash"),
        (1, "a", 0, "A", "X", 0.5, ["p", "q", "p"], "clash"),
        (1, "a", 2, "A", "X", 0.5, ["q", "p"], None),
        (1, "b", 0, "B", "X", None, None, None),
        (1, "b", 2, "B", "X", None, [], None),
        (1, "c", 0, "C", "X", 0.1, None, None),
        (1, "d", 2, "D", "X", 0.1, None, None),
        (1, "e", 0, "E", "X", 0.1, None, None),
        (1, "e", 2, "E", "X", None, None, None),
        (1, None, 2, "N", "X", 0.1, None, None),
        (2, "a", 5, "A", "X", 0.1, None, None),
        (None, "z", 5, "A", "X", 0.1, None, None),
    ]
    got = snapshot_changes(spark.createDataFrame(data, SNAP))
    assert {tuple(r) for r in got.collect()} == {(1, "c", 2, "removed"), (1, "d", 2, "added"), (1, "e", 2, "changed"), (1, None, 2, "added")}


def test_changes_of_several_rows_per_key(spark):
    data = [(1, "a", 0, "A", "X", 0.5, None, None), (1, "a", 0, "B", "X", 0.5, None, None), (1, "a", 1, "A", "X", 0.5, None, None), (1, "b", 1, "A", "X", 0.5, None, None)]
    assert rows(snapshot_changes(spark.createDataFrame(data, SNAP))) == [(1, "a", 1, "changed"), (1, "b", 1, "added")]


def test_changes_of_a_hot_key(spark):
    data = [(1, "a", n, f"A{i}", "X", 0.5, None, None) for n in (0, 1, 2) for i in range(300 - (n == 2))] + [(1, "b", n, "B", "X", 0.5, None, None) for n in (0, 1, 2)]
    assert rows(snapshot_changes(spark.createDataFrame(data, SNAP))) == [(1, "a", 2, "changed")]


def test_changes_of_nothing(spark):
    assert rows(snapshot_changes(spark.createDataFrame([], SNAP))) == []


def test_unwrap():
    campaign = {"sessions": []}
    text = json.dumps(campaign)
    for t in (text, "﻿" + text, f"```json\n{text}\n```", json.dumps(text), f"  {text}\n"):
        assert unwrap_json(t) == campaign
    for t in (None, "", text[:-1], "```json\n" + text, text + "x"):
        assert unwrap_json(t) is None


def test_unwrap_deep_and_often():
    depth = 100_000
    root = unwrap_json('{"sessions": [], "a": ' + "[" * depth + "1" + "]" * depth + "}")
    assert sum(1 for _ in interval_nodes(root)) == depth + 3
    for bad in ("[" * depth, "[" * depth + "1" + "]" * (depth - 1), '{"a":' * depth + "1" + "}" * depth + "x", '{"a" 1' + "}" * depth):
        assert unwrap_json(bad) is None
    text = json.dumps({"sessions": []})
    for _ in range(12):
        text = "```json\n" + json.dumps(text) + "\n```"
    assert unwrap_json(text) == {"sessions": []}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
@settings(max_examples=200, deadline=None)
def test_explicit_stack_reads_as_the_decoder(value):
    for indent in (None, 1):
        assert _deep_json(json.dumps(value, indent=indent)) == value


def test_items_below_deep_values(spark):
    deep = "[" * 30_000 + "1" + "]" * 30_000
    text = '{"x": ' + deep + ', "sessions": [{"turns": [{"meta": ' + deep + ', "text": "hi"}]}]}'
    got = rows(campaign_items(spark.createDataFrame([(1, text)], "campaign_id bigint, payload string")))
    assert got == [(1, 0, "turn", 0, 0, "hi")]


def test_intervals_contain():
    nodes = list(interval_nodes({"a": [{"b": 1}, {"b": None}], "c": "x"}))
    a = next(n for n in nodes if n[4] == "a")
    inside = sorted(n[4] for n in nodes if a[0] < n[0] and n[1] < a[1])
    assert inside == ["[]", "[]", "b", "b"]
    assert sorted(n[0] for n in nodes) == list(range(len(nodes))) == sorted(n[1] for n in nodes)
    by = {n[0]: n for n in nodes}
    assert all(n[3] == -1 or by[n[3]][0] < n[0] and n[1] < by[n[3]][1] and by[n[3]][2] == n[2] - 1 for n in nodes)


def test_campaign_items(spark):
    deep = {
        "name": "n",
        "runner": {"probes": [{"query": "not in a session"}]},
        "sessions": [
            {"turns": [{"text": "hi"}, None, {"text": " "}, {"text": "\ud83d"}], "probes": {"query": "q?"}, "expect_graph": {"has_node_any": ["x", ["y", None, "z"], [], "x"]}},
            None,
            {"turns": {"text": "lone", "meta": {"text": "inner"}}, "expect_graph": {"has_node_any": "single"}},
        ],
    }
    lone = {"sessions": {"turns": [{"text": "s"}]}}
    data = [(1, json.dumps(deep), "a"), (1, json.dumps(deep, indent=2), "b"), (2, json.dumps(lone), "c"), (3, None, "d"), (4, "[1]", "e"), (5, json.dumps(deep)[:50], "f")]
    got = rows(campaign_items(spark.createDataFrame(data, "campaign_id bigint, payload string, path string")))
    assert got == sorted(
        [
            (1, 0, "turn", 0, 0, "hi"),
            (1, 0, "turn", 3, 0, "�"),
            (1, 0, "probe", 0, 0, "q?"),
            (1, 0, "node_any", 0, 0, "x"),
            (1, 0, "node_any", 1, 0, "y"),
            (1, 0, "node_any", 1, 2, "z"),
            (1, 0, "node_any", 3, 0, "x"),
            (1, 2, "turn", 0, 0, "lone"),
            (1, 2, "node_any", 0, 0, "single"),
            (2, 0, "turn", 0, 0, "s"),
        ]
    )


def test_campaign_tables_link(spark):
    text = json.dumps({"sessions": [{"turns": [{"text": "a"}]}, {"turns": [{"text": "b"}]}]})
    t = campaign_tables(spark.createDataFrame([(7, text)], "campaign_id bigint, payload string"))
    linked = t["turn"].join(t["session"].select("campaign_id", "doc", "pre", "post", t["session"].session_pos.alias("p")), ["campaign_id", "doc"]).where("session_pre = pre and session_post = post")
    assert sorted((r.item, r.p) for r in linked.collect()) == [("a", 0), ("b", 1)]
    assert rows(campaign_items(spark.createDataFrame([], "campaign_id bigint, payload string"))) == []


def test_conversation_jsonl_exports_whole_turns(spark, tmp_path):
    import __spark_entry__ as entry
    from mnemora.operators import consolidate as C

    docs = [(3, "Ann", "en", "third"), (1, "Ann", None, "fürst"), (2, None, "de", "x"), (4, "Bo", "en", None), (5, None, "fr", "")]
    schema = "doc_id bigint, speaker string, lang string, text string"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.conv_id: [json.loads(x) for x in r.jsonl.split("\n")] for r in entry.queries()["s14_conversation_jsonl"](spark, str(tmp_path)).collect()}
    row = lambda i: dict(zip(("doc_id", "speaker", "lang", "text"), next(d for d in docs if d[0] == i), strict=True))
    assert got == {"Ann": [row(1), row(3)], "(null)": [row(2), row(5)], "Bo": [row(4)]}
    many = spark.createDataFrame([(i, "Ann", "en", "w" * 50) for i in range(40)], schema)
    parts = C.conversation_jsonl(many, "speaker", "doc_id", ["doc_id", "text"], 300).orderBy("part").collect()
    assert len(parts) > 5 and all(len(r.jsonl) < 300 + 90 for r in parts)
    assert [json.loads(x)["doc_id"] for r in parts for x in r.jsonl.split("\n")] == list(range(40))
