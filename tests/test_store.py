"""Versioned store, logs, streaming sessions and the engine facade."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemora.engine import MemoryEngine
from mnemora.sources import store as S
from mnemora.streaming import sessions as K

T0 = "2025-01-01T00:00:00+00:00"


def graph(spark):
    n = spark.createDataFrame([(1, "n1", "PERSON::ann", "Ann", "PERSON", {}, ["Annie"], 0.9, ["ep1"], T0, T0), (1, "n2", "ORG::acme", "Acme", "ORG", {}, [], 0.9, ["ep1"], T0, T0)], "graph_id bigint, " + S.NODE)
    e = spark.createDataFrame([(1, "e1", "PERSON::ann::WORKS_AT::ORG::acme", "PERSON::ann", "WORKS_AT", "ORG::acme", 80.0, 0.8, "stable", None, "one_to_one", "Ann works at Acme", "", {}, ["ep1"], T0, T0)], "graph_id bigint, " + S.EDGE)
    p = spark.createDataFrame([(1, "ep1", "told", 0.5, ["t"], "text", T0)], "graph_id bigint, " + S.EPISODE)
    return {"nodes": n, "edges": e, "episodes": p}


def test_versions(spark, tmp_path):
    s = S.GraphStore(spark, str(tmp_path))
    assert s.version() == 0
    assert s.save(graph(spark)) == 1 and s.table("nodes").count() == 2
    with pytest.raises(Exception):
        s.save({"nodes": spark.range(1).select(F.raise_error(F.lit("x")).alias("c"))})
    assert s.version() == 1 and [p.name for p in (tmp_path / "_versions").iterdir() if not p.name.startswith(".")] == ["000000000001.json"]
    s.save({"episodes": graph(spark)["episodes"].limit(0)})
    assert s.version() == 2 and s.table("nodes").count() == 2 and s.table("episodes").count() == 0
    with pytest.raises(S.ConcurrentWrite):
        s.save({"nodes": graph(spark)["nodes"]}, base=1)
    s.save_vectors(spark.createDataFrame([(1, "a", "t", [1.0], "m")], S.VECTORS))
    assert s.vectors().first().vec == [1.0] and s.table("nodes").count() == 2


def test_snapshot_round_trip(spark, tmp_path):
    tables = {k: v.drop("graph_id") for k, v in graph(spark).items()}
    path = tmp_path / "g.json"
    path.write_text(S.snapshot_json(tables, "PERSON::ann"))
    back = S.load_snapshot(spark, str(path))
    assert [r.key for r in back["nodes"].orderBy("seq").collect()] == ["ORG::acme", "PERSON::ann"] or back["nodes"].count() == 2
    assert back["meta"].first().self_key == "PERSON::ann"
    broken = json.loads(path.read_text())
    broken["edges"][0]["target_key"] = "ghost"
    path.write_text(json.dumps(broken))
    with pytest.raises(S.IntegrityError):
        S.load_snapshot(spark, str(path))


def test_rows(spark):
    old = spark.createDataFrame([(1, "a", "x", T0)], "graph_id int, key string, name string, updated_at string")
    new = spark.createDataFrame([(1, "a", "y", T0), (1, "b", "z", T0)], old.schema)
    with pytest.raises(S.IntegrityError):
        S.add_rows(old, new, ["graph_id", "key"])
    assert sorted(r.name for r in S.upsert_absent(old, new, ["graph_id", "key"]).collect()) == ["x", "z"]
    up = S.update_rows(old, spark.createDataFrame([(1, "a", "w")], "graph_id int, key string, name string"), ["graph_id", "key"], "now").first()
    assert (up.name, up.updated_at) == ("w", "now")


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    assert S.read_events(spark, path, "event string, ts string").count() == 0
    S.append_events(spark.createDataFrame([("read", None), ("decay", "2025")], "event string, ts string"), path)
    S.append_events(spark.createDataFrame([("read",)], "event string"), path)
    got = S.read_events(spark, path, "event string, ts string").collect()
    assert len(got) == 3 and all(r.ts for r in got)


def test_index_sync(spark):
    inputs = spark.createDataFrame([(1, "a", "t"), (1, "b", "t")], "graph_id int, key string, text string")
    embed = lambda df: df.select("graph_id", "key", F.lit("m").alias("model_id"), F.lit("new").alias("v"))
    index = spark.createDataFrame([(1, "a", "m", "old"), (1, "gone", "m", "old")], "graph_id int, key string, model_id string, v string")
    assert {r.key: r.v for r in S.synced_index(index, "m", inputs, embed).collect()} == {"a": "old", "b": "new"}
    assert {r.v for r in S.synced_index(index, "other", inputs, embed).collect()} == {"new"}
    assert {r.v for r in S.load_or_rebuild(index, "m", inputs, embed).collect()} == {"new"}
    same = index.where("key = 'a'")
    assert {r.v for r in S.load_or_rebuild(same, "m", inputs.where("key = 'a'"), embed).collect()} == {"old"}


def test_sessions(spark, tmp_path):
    at = lambda m: dt.datetime(2025, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    entity = json.dumps({"name": "Ann"})
    relation = json.dumps({"source": "Ann", "target": "Acme", "relation": "WORKS_AT"})
    rows = [("s1", "start", None, at(0)), ("s1", "add_entity", entity, at(1)), ("s1", "add_relationship", relation, at(2)), ("s1", "finish", None, at(3)), ("s1", "add_entity", entity, at(4)), ("s2", "start", None, at(0)), ("s2", "add_entity", "{bad", at(40)), ("s3", "add_entity", entity, at(1)), ("s4", "start", None, at(0))]
    rows += [("s4", "add_entity", entity, at(1)) for _ in range(80)]
    spark.createDataFrame(rows, K.CALLS).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = K.sessions(spark.readStream.schema(K.CALLS).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [(r.session_id, r.outcome) for r in spark.table("outcomes").collect()]
    assert ("s1", "finished") in got and ("s1", "late") in got and ("s2", "expired") in got and ("s3", "late") in got and ("s4", "capped") in got
    assert got.count(("s1", "entity")) == 1 and got.count(("s1", "relationship")) == 1


def test_drain(spark, tmp_path):
    src, cp, seen = str(tmp_path / "log"), str(tmp_path / "cp"), []
    spark.createDataFrame([(1, "e"), (1, "e"), (1, "f")], "graph_id bigint, edge string").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # the second run has nothing left to drain
        log = spark.readStream.schema("graph_id bigint, edge string").parquet(src)
        K.drain_reinforcement(log, lambda counts, n: seen.extend(tuple(r) for r in counts.collect()), cp).awaitTermination(120)
    assert sorted(seen) == [(1, "e", 2), (1, "f", 1)]
    edges = spark.createDataFrame([(1, "e", 50.0), (1, "g", 50.0)], "graph_id bigint, key string, strength double")
    counts = spark.createDataFrame(seen, "graph_id bigint, edge string, times bigint")
    assert {r.key: r.strength for r in K.reinforced_by_counts(edges, counts).collect()} == {"e": 80.0, "g": 50.0}


def test_engine_cycle(spark, tmp_path):
    def extract(prompts):
        reply = json.dumps({"entities": [{"text": "Annie", "type": "PERSON", "confidence": 0.9}, {"text": "Globex", "type": "ORG"}], "relationships": [{"source": "Annie", "relation": "works at", "target": "Globex", "confidence": 0.9, "stability": "stable", "cardinality": "one_to_one", "snippet": "Annie moved to Globex"}], "episode": {"summary": "new job"}})
        return prompts.select("batch_id", F.lit(reply).alias("reply"))

    s = S.GraphStore(spark, str(tmp_path))
    s.save(graph(spark))
    eng = MemoryEngine(s, extract=extract, supersede=lambda pairs: pairs)
    msg = spark.createDataFrame([(1, 1, "Tell me about Ann please")], "ask bigint, graph_id bigint, message string")
    first = eng.read(msg)
    assert "Ann -[WORKS_AT]-> Acme" in first["context"].first().text
    assert first["trace"].first().selected[0] == "PERSON::ann" and first["traversed"].count() == 1
    c = eng.write(spark.createDataFrame([("b1", 1, "Annie moved to Globex")], "batch_id string, graph_id bigint, conversation string"), "2025-02-01T00:00:00+00:00").first()
    assert (c.nodes_created, c.nodes_merged, c.edges_created, c.edges_superseded) == (1, 1, 1, 1)
    old = s.table("edges").where("id = 'e1'").first()
    # The old edge is demoted, tagged with the new relation, then lifted by the traversal that the read logged.
    assert old.strength == 16.0 and old.properties["superseded_by"] == "WORKS_AT" and old.updated_at == "2025-02-01T00:00:00+00:00"
    assert "Acme" not in eng.read(msg)["lines"].agg(F.array_join(F.collect_list("line"), "\n")).first()[0]
    assert s.table("nodes").where("name = 'Ann'").first().aliases == ["Annie"] and s.pending("reinforcement")[1] != [] and s.table("episodes").count() == 2
    mem = eng.retrieve_memory(spark.createDataFrame([(1, 1, "annie")], "ask bigint, graph_id bigint, name string"))
    assert mem["relationships"].count() == 2 and mem["episodes"].count() == 2
    assert eng.decay("2025-02-02T00:00:00+00:00", last="2025-02-01T12:00:00+00:00") is None
    assert eng.decay("2025-03-01T00:00:00+00:00", last="2025-02-01T12:00:00+00:00").first().edges_decayed == 2
    assert eng.health().first().edges == 2


def test_contexts_search_the_whole_conversation(spark, tmp_path):
    s = S.GraphStore(spark, str(tmp_path))
    s.save(graph(spark))
    late = "nothing of note was said here. " * 200 + "Then Ann came in"
    got = MemoryEngine(s).contexts(spark.createDataFrame([("b1", 1, late)], "batch_id string, graph_id bigint, conversation string")).collect()
    assert len(got) == 1 and "PERSON::ann" in got[0].context


def test_write_reads_the_users_turns_and_journals(spark, tmp_path):
    prompts = []

    def extract(df):
        prompts.extend(r.prompt for r in df.collect())
        reply = {"entities": [{"text": "Ann", "type": "PERSON", "properties": {"age": "9"}}, {"text": "Dr Bo", "type": "PERSON", "candidate_merge_key": "PERSON::ann"}, {"text": "", "type": "ORG"}], "relationships": [{"source": "Ann", "relation": "WORKS_AT", "target": "Acme", "confidence": 0.95, "snippet": "new", "evidence": "said so", "stability": "odd"}, {"source": "Ann", "relation": "KNOWS", "target": "Zed"}]}
        return df.select("batch_id", F.lit(json.dumps(reply)).alias("reply"))

    s = S.GraphStore(spark, str(tmp_path))
    s.save(graph(spark))
    ask = []

    def disambiguate(reviews):
        ask.extend(reviews.collect())
        return reviews.select("graph_id", "entity", "candidates", F.lit('{"candidates": [{"key": "PERSON::ann", "confidence": 0.8}, {"key": "ghost", "confidence": 1}]}').alias("reply"))

    eng = MemoryEngine(s, extract=extract, disambiguate=disambiguate, user_only=True)
    now = "2025-02-01T00:00:00+00:00"
    talk = spark.createDataFrame([("b1", 1, [("user", "I am Ann"), ("assistant", "Hello there")])], "batch_id string, graph_id bigint, turns array<struct<role string, text string>>")
    c = eng.write(talk, now).first()
    assert "I am Ann" in prompts[0] and "Hello there" not in prompts[0] and "PERSON::ann -[WORKS_AT]-> ORG::acme" in prompts[0]
    assert [(r.entity, r.candidates) for r in ask] == [("PERSON::dr_bo", ["PERSON::ann"])] and "ORG::acme" in ask[0].prompt
    assert (c.nodes_created, c.nodes_merged, c.edges_created, c.edges_reinforced, c.edges_dropped) == (1, 2, 1, 1, 0)
    ann = s.table("nodes").where("key = 'PERSON::ann'").first()
    assert ann.aliases == ["Annie", "Ann", "Dr Bo"] and ann.properties == {"age": "9"} and ann.source_episode_ids == ["ep1", "b1"] and ann.updated_at == now
    acme = s.table("nodes").where("key = 'ORG::acme'").first()
    assert acme.source_episode_ids == ["ep1", "b1"] and acme.updated_at == T0
    assert s.table("nodes").where("key = 'OTHER::zed'").first().properties == {"provisional_from_relationship": "true"}
    e = s.table("edges").where("id = 'e1'").first()
    assert (e.strength, e.confidence, e.snippet, e.evidence, e.updated_at, e.source_episode_ids) == (95.0, 0.95, "new", "said so", now, ["ep1", "b1"])
    journal = s.pending("journal")[0].collect()
    assert {r.event for r in journal} == {"write", "merge_note", "flagged", "warning"}
    assert any("odd became stable" in (r.detail or {}).get("warning", "") for r in journal) and eng.flagged.first().note["target"] == "PERSON::ann"
    assert s.meta().first().self_key == "PERSON::ann"
    assert eng.decay("2025-02-02T00:00:00+00:00") is not None and eng.decay("2025-02-02T12:00:00+00:00") is None and s.state()["last_decay_at"] == "2025-02-02T00:00:00+00:00"


def test_extraction_session_writes_every_call(spark, tmp_path):
    s = S.GraphStore(spark, str(tmp_path))
    s.save(graph(spark))
    eng = MemoryEngine(s, supersede=lambda pairs: pairs.withColumn("reply", F.lit('{"decision": "Contradicts", "reason": "moved"}')))
    at = "2025-02-01T00:00:00+00:00"
    started = eng.start_sessions(spark.createDataFrame([("s1", 1, "Ann left Acme")], "batch_id string, graph_id bigint, conversation string"), at)
    assert "PERSON::ann" in started.first().prompt
    relation = {"source": "annie", "relation": "works at", "target": "Globex", "cardinality": "one_to_one"}
    calls = [("s1", 1, "add_entity", {"text": "Lone", "type": "thing"}), ("s1", 2, "add_relationship", relation), ("s1", 3, "add_relationship", relation | {"stability": "odd"}), ("s2", 1, "add_entity", {"text": "X", "type": "ORG"}), ("s1", 4, "finish_extraction", {"summary": "left", "importance": "0.9", "tags": ["job"]})]
    got = eng.apply_calls(spark.createDataFrame([(i, o, t, json.dumps(a)) for i, o, t, a in calls], "session_id string, ord int, tool string, arguments string"), at)
    told = {(r.session_id, r.ord): (r.result, r.finished) for r in got.collect()}
    assert told["s1", 1] == ("created THING::lone", False) and told["s1", 2] == ("added PERSON::ann::WORKS_AT::OTHER::globex; superseded 1", False)
    assert told["s1", 3] == ("error: unknown stability", False) and told["s1", 4] == ("finished", True) and told["s2", 1][1]
    assert s.table("edges").where("id = 'e1'").first().strength == 1.0
    p = s.table("episodes").where("id = 's1'").first()
    assert (p.summary, p.importance, p.tags) == ("left", 0.9, ["job"])
    journal = s.pending("journal")[0].collect()
    assert [r.detail["warning"] for r in journal if r.event == "warning" and "orphan" in r.detail["warning"]] == ["orphan THING::lone"]
    assert any(r.event == "flagged" and r.detail["kind"] == "contradiction" for r in journal)
    late = eng.apply_calls(spark.createDataFrame([("s1", 1, "add_entity", "{}")], "session_id string, ord int, tool string, arguments string"), at).first()
    assert late.finished and late.result.startswith("error")
    eng.start_sessions(spark.createDataFrame([("s3", 1, "x")], "batch_id string, graph_id bigint, conversation string"), at)
    eng.sweep_sessions("2025-02-01T00:31:00+00:00")
    assert s.table("episodes").where("id = 's3'").first().summary == "(ended without a summary)" and s.table("sessions").where("session_id = 's3'").first().finished
