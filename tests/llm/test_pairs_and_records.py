"""Names, co-occurrence and survivorship against brute force and hand cases."""

import datetime as dt
import itertools

import numpy as np
import pytest

from mnemora.llm import cooccur, names, survivor

NODE = "graph_id bigint, id string, key string, name string, kind string, aliases array<string>, entity string, norm string"


def linked(spark, *rows):
    data = [(g, str(i), "k", name, kind, aliases, "clash", None) for i, (g, kind, name, aliases) in enumerate(rows)]
    return {(int(r.id_a), int(r.id_b)) for r in names.same_entity_pairs(spark.createDataFrame(data, NODE)).collect()}


def test_spellings_of_one_person(spark):
    people = [(1, "PERSON", n, None) for n in ("Harold Mosshitto", "MOSSHITTO, Haarold", "Hal Mosshitto", "H. Mosshitto", "Mosshitto H", "Harold Ann Mosshitto", "HaroldMosshitto", "Harold Moss-hitto", "Mr Mosshitto", "Harold")]
    assert linked(spark, *people) == set(itertools.combinations(range(len(people)), 2))


def test_different_people(spark):
    people = [(1, "PERSON", n, None) for n in ("Leonard Haskgaford", "Björn Haskgaford", "Leonard Quingalde", "Ingrid Lund Jr", "Ingrid Lund Sr", "Haskgaford", "Leonard", "L. Unknown")]
    assert linked(spark, *people) == set()
    assert linked(spark, (1, "PERSON", "Ann Lee", None), (2, "PERSON", "Ann Lee", None), (1, "ORG", "Ann Lee", None)) == set()


def test_aliases_roles_and_oneself(spark):
    got = linked(
        spark,
        (1, "PERSON", "Fran Norwell", ["Francesca Norwell"]),
        (1, "PERSON", "Francesca Norwell", ["the landlord", " ", None]),
        (1, "PERSON", "My landlord", None),
        (1, "PERSON", "The User", ["me"]),
        (1, "PERSON", "Myself", []),
        (1, "PERSON", "Ida Berg", ["dentist"]),
        (1, "PERSON", "Otto Falk", ["the dentist"]),
        (1, "PERSON", "the dentist", None),
    )
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4)}


def test_bodies(spark):
    got = linked(spark, *[(1, "ORG", n, None) for n in ("Kestrel Point Housing Association GmbH", "The Kestrel Point Housing Assoc.", "Housing Association, Kestrel Point", "KPHA", "Kestrel Pont Housing Association", "University of Elmstead", "Elmstead Uni", "Kestrel Bay Housing Association", "Redcairn Robotics", "Redcairn Logistics", "Redcairn")])
    assert got == set(itertools.combinations(range(5), 2)) | {(5, 6)}


def test_bodies_in_turned_order():
    def score(v, c):
        (v, _), (c, _) = names.parse("ORG", v), names.parse("ORG", c)
        met = bool(names.blocking("ORG", v, "b") & names.blocking("ORG", c, "b"))
        got = names.likelihood("ORG", v, c)
        return met and got is not None and not got[1]

    assert score("Stonebeck and Fairweather Partners", "Fairweather and Stonebeck Partners")
    assert score("Greatrex and Blackwater Ford Partners", "Blackwater Ford and Greatrex Partners")
    assert score("Greatrex & Blackwater Ford Partners", "Blackwater Ford Greatrex Partners")
    assert score("Stonebeck and Fairweather Partners", "Fairwether & Stonebeck Partners Ltd")
    assert score("Kes Poi Housing Association", "Kestrel Point Housing Association")
    assert not score("Stonebeck and Fairweather Partners", "Fairweather and Stonebeck Builders")
    assert not score("Stonebeck and Fairweather Partners", "Fairweather and Kestrel Partners")


def test_names_dirt(spark):
    assert linked(spark) == set()
    rows = [(1, "PERSON", None, None), (1, "PERSON", " ", [None]), (1, "PERSON", "!!", []), (None, "PERSON", "A B", None), (1, None, "A B", None), (1, "PERSON", "x" * 5000, ["y z " * 2000]), (1, "ORG", ",", None), (1, "ORG", "Inc", None)]
    assert linked(spark, *rows) == set()
    twice = spark.createDataFrame([(1, "a", "k", "Ann Lee", "PERSON", None, None, None)] * 2 + [(1, "b", "k", "Lee, Ann", "PERSON", None, None, None)], NODE)
    assert [tuple(r) for r in names.same_entity_pairs(twice).collect()] == [("a", "b")]


def test_pieces_meet_after_one_slip():
    letters = "abcde"
    for word in ("abcd", "abcde", "bacdeb", "abcdeabc", "abcdeabcd", "abcdeabcde"):
        slips = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
        for other in slips:
            assert names.within_one(word, other)
            if min(len(word), len(other)) >= 4:
                assert names.pieces(word) & names.pieces(other), (word, other)


def test_pieces_lose_no_pair_of_the_one_letter_out_keys():
    def shortened(word):
        return {word} | ({word[:k] + word[k + 1 :] for k in range(len(word))} if len(word) > 3 else set())

    words = ["".join(w) for n in (3, 4, 5) for w in itertools.product("abc", repeat=n)] + ["owen", "oewn", "hna", "hana", "zoe", "zoee"]
    met = 0
    for a, b in itertools.combinations(words, 2):
        if names.word_slip(a, b) is not None and shortened(a) & shortened(b):
            met += 1
            assert names.pieces(a) & names.pieces(b), (a, b)
    assert met > 1000
    for a, b in (("Bob Oewn", "Robert Owen"), ("Zoe Ravstarn", "Zoee Ravstarn")):
        a, b = names.parse("PERSON", a)[0], names.parse("PERSON", b)[0]
        assert names.blocking("PERSON", a, "b") & names.blocking("PERSON", b, "b") and names.likelihood("PERSON", a, b)
    one, several = names.parse("PERSON", "Hana")[0], names.parse("PERSON", "Hna Ravstarn")[0]
    assert names.blocking("PERSON", one, "s") & names.blocking("PERSON", several, "f")
    # Longer words: a swap at any place leaves a piece.
    for word in ("abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"):
        for i in range(len(word) - 1):
            assert names.pieces(word) & names.pieces(word[:i] + word[i + 1] + word[i] + word[i + 2 :])


def baskets(spark, rows):
    return spark.createDataFrame(rows, "basket string, graph_id bigint, set_id string, key string")


def test_pair_counts_against_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = {("read", g, str(s)): set(rng.choice(list("abcdefghij"), rng.integers(0, 6))) for g in (1, 2) for s in range(60)}
    data = [(b, g, s, k) for (b, g, s), keys in sets.items() for k in keys]
    got = {(r.graph_id, r.key_a, r.key_b): (r.n_ab, r.n_a, r.n_b, r.n_sets) for r in cooccur.pair_counts(baskets(spark, data), {"read": 2}).collect()}
    want = {}
    for g in (1, 2):
        mine = [keys for (b, h, _), keys in sets.items() if h == g and keys]
        for a, b in itertools.combinations("abcdefghij", 2):
            n = sum(a in k and b in k for k in mine)
            if n >= 2:
                want[g, a, b] = (n, sum(a in k for k in mine), sum(b in k for k in mine), len(mine))
    assert got == want
    # The bound on hubs loses no pair that reaches the lift.
    lifted = {(r.graph_id, r.key_a, r.key_b) for r in cooccur.pair_counts(baskets(spark, data), {"read": 2}, 1.2).collect()}
    assert lifted == {k for k, (n, a, b, m) in want.items() if n * m >= 1.2 * a * b}


def test_null_keeps_degrees_and_tail_is_exact():
    f, n, s, m = np.array([1, 3, 7]), np.array([10, 5, 2]), np.array([2, 4]), np.array([14, 3])
    s = np.array([2, 4])
    m = np.array([(f * n).sum() // 2 - 4, 2])
    p = cooccur.membership(*cooccur.fit_null(f, n, s, m))
    total = (f * n).sum()
    assert (p * m).sum(axis=1) == pytest.approx(f * (s * m).sum() / total, rel=0.05)
    q, trials = np.array([0.2, 0.05]), np.array([4, 6])
    dist = np.array([1.0])
    for prob, t in zip(q, trials, strict=True):
        for _ in range(t):
            dist = np.convolve(dist, [1 - prob, prob])
    for k in range(11):
        assert cooccur.poisson_binomial_tail(q, trials, k) == pytest.approx(dist[k:].sum(), abs=1e-12)


def test_tail_is_whole_at_any_mean():
    q, trials = np.array([0.3, 1e-3, 0.9]), np.array([30, 500, 7])
    dist = np.array([1.0])
    for prob, n in zip(q, trials, strict=True):
        for _ in range(n):
            dist = np.convolve(dist, [1 - prob, prob])
    for k in range(0, 60):
        assert cooccur.poisson_binomial_tail(q, trials, k) == pytest.approx(dist[k:][::-1].sum(), rel=1e-9)
    assert cooccur.poisson_binomial_tail(np.array([0.5, 1.0]), np.array([3, 2]), 5) == pytest.approx(1 / 8)
    assert cooccur.poisson_binomial_tail(np.array([0.5, 0.0]), np.array([3, 2]), 4) == 0.0
    # Far more terms than any fixed window: the tail of a normal distribution.
    for mean in (1e4, 1e5, 1e6):
        p, n = np.array([1e-4]), np.array([int(mean * 1e4)])
        assert cooccur.poisson_binomial_tail(p, n, int(mean) + 1) == pytest.approx(0.5, abs=0.01)
        assert cooccur.poisson_binomial_tail(p, n, int(mean + mean**0.5) + 1) == pytest.approx(0.1587, abs=0.005)


def test_huge_baskets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK_KEYS", 3)
    data = [("read", 1, s, f"k{i}") for s, step in (("a", 1), ("b", 2), ("c", 5)) for i in range(0, 20, step)]
    got = {(r.key_a, r.key_b): r.n_ab for r in cooccur.pair_counts(baskets(spark, data), {"read": 1}).collect()}
    want = {}
    for step in (1, 2, 5):
        for pair in itertools.combinations(sorted(f"k{i}" for i in range(0, 20, step)), 2):
            want[pair] = want.get(pair, 0) + 1
    assert got == want


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [("read", int(g), int(i), float(np.round(rng.random() ** 3, 2)), int(rng.integers(1, 5))) for g in (1, 2) for i in range(80)]
    tails = spark.createDataFrame(rows, "basket string, graph_id bigint, n_ab bigint, p_value double, pairs bigint")
    tests = spark.createDataFrame([("read", 1, 400.0), ("read", 2, 300.0)], "basket string, graph_id bigint, tests double")
    got = {(r.graph_id, r.n_ab): r.q_value for r in cooccur.ranked_by_p(tails, tests, 7).collect()}
    for g, n in ((1, 400.0), (2, 300.0)):
        mine = [r for r in rows if r[1] == g]
        at = {p: p * n / sum(r[4] for r in mine if r[3] <= p) for p in {r[3] for r in mine}}
        for r in mine:
            assert got[g, r[2]] == pytest.approx(min(1.0, min(v for p, v in at.items() if p >= r[3])))


def test_surprise(spark):
    data = [("read", 1, str(i), k) for i in range(60) for k in (["x", "y"] if i < 8 else [f"z{i % 7}", f"w{i % 5}"])]
    got = {(r.key_a, r.key_b): r for r in cooccur.surprising_pairs(baskets(spark, data), {"read": 1}).collect()}
    best = min(got.values(), key=lambda r: r.p_value)
    assert (best.key_a, best.key_b) == ("x", "y") and best.q_value < 0.01 and best.expected < best.n_ab
    assert all(r.p_value <= r.q_value <= 1 for r in got.values())


def test_surprise_query_has_pairs_met_once(spark, tmp_path):
    from mnemora.llm.queries import QUERIES

    trace = [(i, 1, ["a"], ["b"]) if i == 0 else (i, 1, [f"n{i % 9}"], [f"m{i % 5}"]) for i in range(40)]
    spark.createDataFrame(trace, "read_id bigint, graph_id bigint, seeds array<string>, selected array<string>").write.parquet(f"{tmp_path}/read_trace.parquet")
    spark.createDataFrame([(1, "p", ["e"]), (1, "q", ["e"])], "graph_id bigint, key string, source_episode_ids array<string>").write.parquet(f"{tmp_path}/nodes.parquet")
    got = {(r.basket, r.key_a, r.key_b): r for r in QUERIES["p2_surprise"](spark, str(tmp_path)).collect()}
    assert got["read", "a", "b"].n_ab == 1 and ("episode", "p", "q") in got
    assert {(r.n_ab) for r in got.values() if r.basket == "read"} == {1}


def test_found_pairs(spark):
    trace = [(i, 1, ["a", None, "a"], ["b"]) for i in range(6)] + [(i, 1, None, [f"n{i}"]) for i in range(6, 40)] + [(0, 1, ["a"], ["b"])] + [(50, 1, [], None), (None, 1, ["q"], None)]
    node = [(1, k, ["e1", "e1", None, "e2", "e3", "e4"]) for k in ("p", "q", "p")] + [(1, f"m{i}", [f"x{i}"]) for i in range(30)] + [(1, None, ["e1"]), (1, "r", None)]
    got = cooccur.found_pairs(spark.createDataFrame(trace, "read_id bigint, graph_id bigint, seeds array<string>, selected array<string>"), spark.createDataFrame(node, "graph_id bigint, key string, source_episode_ids array<string>"))
    assert sorted(tuple(r) for r in got.collect()) == [("episode", 1, "p", "q"), ("read", 1, "a", "b")]
    empty = cooccur.found_pairs(spark.createDataFrame([], "read_id bigint, graph_id bigint, seeds array<string>, selected array<string>"), spark.createDataFrame([], "graph_id bigint, key string, source_episode_ids array<string>"))
    assert empty.collect() == []


RECORD = "rec_id bigint, graph_id bigint, key string, aliases array<string>, confidence double, source_episode_ids array<string>, updated_at string, received_at timestamp, node_key string, episodes string"


def records(spark, *rows):
    now = dt.datetime(2025, 6, 1)
    full = [(r.get("id"), 1, r.get("key", "PERSON::ann lee"), r.get("al"), r.get("c"), r.get("ep"), r.get("up"), r.get("rec", now), "clash", "clash") for r in rows]
    return spark.createDataFrame(full, RECORD)


def test_survivors(spark):
    got = survivor.survivors(
        records(
            spark,
            {"id": 3, "c": 0.9, "al": ["A", " a ", "b", ""], "ep": ["e", "e", None], "up": "2025-05-01T00:00:00Z"},
            {"id": 2, "c": 75.0, "al": ["x", "y"], "ep": ["e"], "up": "2025-05-01 02:00:00+02:00", "key": " person::ANN-LEE "},
            {"id": 1, "c": float("nan"), "al": None, "ep": None, "up": "2031-01-01T00:00:00Z"},
            {"id": 4, "c": 0.9, "up": "n/a"},
            {"id": 9, "key": "ORG::lonely", "c": 0.1},
            {"id": None, "c": 1.0},
            {"id": 8, "key": None},
            {"id": 7, "key": "no kind"},
        )
    )
    assert [tuple(r) for r in got.collect()] == [(1, "PERSON::ann_lee", 3, 2, 2, 2)]
    nothing = survivor.survivors(records(spark, {"id": 1}, {"id": 2}, {"id": 2})).first()
    assert (nothing.confidence_rec, nothing.aliases_rec, nothing.episodes_rec, nothing.updated_rec) == (None, 1, 1, None)
    assert survivor.survivors(records(spark).limit(0)).collect() == []


def test_true_values(spark):
    # Three careful sources list the true alias; a careless one lists something else everywhere.
    rows, n = [], 0
    for node in range(12):
        for source in ("good1", "good2", "good3", "bad"):
            n += 1
            rows.append({"id": n, "key": f"PERSON::p{node}", "al": [f"bad{node}"] if source == "bad" else [f"true{node}"], "ep": [source]})
    got = {r.value: r.probability for r in survivor.true_values(records(spark, *rows)).collect()}
    assert all(got[f"true{i}"] > 0.9 and got[f"bad{i}"] < 0.1 for i in range(12))
    one = survivor.fused(records(spark, *rows)).orderBy("node_key").first()
    assert one.aliases == ["true0"]


def test_true_values_against_the_whole_table(spark, monkeypatch):
    """The sums over listed values give what the table of all sources by all values of a node gives."""
    monkeypatch.setattr(survivor, "SPLIT", 3)
    rng = np.random.default_rng(6)
    rows = [{"id": i, "key": f"PERSON::p{rng.integers(6)}", "al": [f"v{k}" for k in rng.integers(0, 5, rng.integers(0, 4))], "ep": [f"s{k}" for k in rng.integers(0, 5, rng.integers(0, 3))]} for i in range(60)]
    listed, says = set(), set()
    for r in rows:
        for s in set(r["ep"]) or {""}:
            says.add((r["key"], s))
            listed |= {(r["key"], s, v) for v in r["al"]}
    values = {(n, v) for n, _, v in listed}
    p = {(n, v): sum((n, s, v) in listed for m, s in says if m == n) / sum(m == n for m, _ in says) for n, v in values}
    for _ in range(6):
        sens, spec = {}, {}
        for s in {s for _, s in says}:
            mine = [(p[n, v], (n, s, v) in listed) for n, v in values if (n, s) in says]
            sens[s] = (sum(t for t, o in mine if o) + 2) / (sum(t for t, _ in mine) + 3)
            spec[s] = (sum(1 - t for t, o in mine if not o) + 3) / (sum(1 - t for t, _ in mine) + 4)
        odds = {(n, v): sum(np.log(sens[s] / (1 - spec[s])) if (n, s, v) in listed else np.log((1 - sens[s]) / spec[s]) for m, s in says if m == n) for n, v in values}
        p = {k: 1 / (1 + np.exp(-o)) for k, o in odds.items()}
    got = {(r.node_key, r.value): r for r in survivor.true_values(records(spark, *rows), rounds=6, tolerance=0.0).collect()}
    assert set(got) == values
    for k, r in got.items():
        assert r.probability == pytest.approx(p[k], abs=1e-9)
        assert (r.listed, r.sources) == (sum((k[0], s, k[1]) in listed for m, s in says if m == k[0]), sum(m == k[0] for m, _ in says))


def test_components_of_long_chains(spark):
    order = np.random.default_rng(3).permutation(60).tolist()
    chain = [(1, a, b) for a, b in itertools.pairwise(order)] + [(2, i, i + 1) for i in range(40)] + [(2, 100, 101)]
    edges = spark.createDataFrame(chain, "graph_id bigint, a bigint, b bigint")
    got = {(r.graph_id, r.sid): r.entity for r in names.components(edges).collect()}
    assert got == {(1, i): 0 for i in range(60)} | {(2, i): 0 for i in range(41)} | {(2, 100): 100, (2, 101): 100}
    with pytest.raises(RuntimeError):
        names.components(edges, rounds=2)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_freed_checkpoints_leave_no_shuffle_of_a_plan_that_is_still_known(spark, adaptive):
    from mnemora.runtime import checkpointed

    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        other = spark.range(500).repartition(3).groupBy("id").count()
        assert other.count() == len(other.collect()) == 500
        others = [i for i in range(10_000) if tracker.containsShuffle(i)]
        keyed = spark.range(1000).selectExpr("id % 10 as k", "id")
        df = keyed.groupBy("k").count().join(keyed.groupBy("k").agg({"id": "max"}), "k")
        held = df._jdf.queryExecution()
        out = checkpointed(df, free=True)
        if adaptive == "true":  # only there it's known which shuffles were the plan's
            assert held.executedPlan().context().shuffleIds().size() >= 2
            assert [i for i in range(10_000) if tracker.containsShuffle(i)] == others
        assert out.count() == 10 and other.count() == 500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
