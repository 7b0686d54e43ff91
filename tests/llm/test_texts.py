"""Encoding, leakage and text statistics: round trips, brute force, held-out labels, dirt."""

import random

import numpy as np
import pytest

from mnemora.llm import encode, leak, quality

DOC = "doc_id bigint, text string, ids string, item_id string, language string, distance string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)], DOC)


def test_ids_equal_public_encoder(spark):
    import tiktoken

    path = f"{encode.VOCABULARIES}/byte_bpe_50k.tiktoken"
    public = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    alphabet = "abcdefghij   \n\t.,;'’é漢🙂0123<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    texts += ["<|endoftext|>", "a" * 3000, " " * 500, "ab" * 4000, "don't stop", "日本語" * 300, "\u0000x"]
    got = {r.doc_id: r.ids for r in encode.corpus_ids(docs(spark, *texts, "", None)).collect()}
    assert all(got[i] == public.encode_ordinary(t) for i, t in enumerate(texts))
    assert all(public.decode(got[i]) == t for i, t in enumerate(texts))
    assert got[len(texts)] == got[len(texts) + 1] == []
    assert encode.corpus_ids(docs(spark).limit(0)).collect() == []


def words(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}" for _ in range(n)]


def test_seeds_against_brute_force():
    rng = random.Random(1)
    items = leak.Items([1, 2], [" ".join(rng.choices("abcdefg", k=30)) for _ in range(2)])
    tokens = np.array([rng.randrange(0, len(items.vocabulary) + 1) for _ in range(3000)], "int64")
    got = set(zip(*map(list, leak.seeds_in(tokens, items)), strict=True))
    want = {(p, s) for p in range(len(tokens) - 2) for s in range(len(items.flat) - 2) if items.owner[s] == items.owner[s + 2] and all(tokens[p + k] == items.flat[s + k] for k in range(3))}
    assert got == want


def test_align_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(1, 5, (1, 25)), rng.integers(1, 5, (1, 18))
        h = np.zeros((19, 26))
        for i in range(18):
            for j in range(25):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if b[0, i] == a[0, j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, span = leak.align(a, b, np.full(b.shape, 2.0))
        assert score[0] == h.max() and 0 < span[0] <= 18


def test_leaks(spark):
    rng = random.Random(7)
    item = words(rng, 60)
    formula = "I beg to move that the motion be agreed to."
    items = spark.createDataFrame([(1, " ".join(item) + ". " + formula, "x"), (2, " ".join(words(rng, 60)) + ". " + formula, "x"), (3, None, "x"), (4, "", "x")], "item_id bigint, text string, doc_id string")
    fill = lambda n: " ".join(words(rng, n))
    part = item[10:34]
    changed = list(part)
    changed[5], changed[15] = "other", "thing"
    del changed[9]
    typed = [w[:-1] + "x" if i % 6 == 0 else w for i, w in enumerate(part)]
    texts = [
        fill(50) + " " + " ".join(part) + " " + fill(50),
        fill(50) + " " + " ".join(changed).upper() + " " + fill(9),
        fill(9) + " " + ", ".join(typed[:12]) + " [Col. 12] (Laughter.) HON. MEMBERS: Oh! " + " ".join(typed[12:]),
        " ".join(w[:2] + "-\n" + w[2:] for w in part),
        fill(50) + " " + " ".join(item[10:25]) + " " + fill(50),
        formula + " " + " ".join(item[45:60]) + ". " + formula,
        fill(400),
        None,
        "",
        " ",
        fill(20_000) + " " + " ".join(item) + " " + fill(20_000),
    ]
    got = sorted((r.doc_id, r.item_id) for r in leak.leaks(docs(spark, *texts), items).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 1), (10, 1)]
    whole = {r.doc_id: r for r in leak.leaks(docs(spark, *texts), items).collect()}
    assert whole[10].verbatim == 60 and whole[10].score == 120
    assert leak.clean_documents(docs(spark, *texts), items).count() == len(texts) - 5
    assert leak.leaks(docs(spark, *texts), items.limit(0)).collect() == [] == leak.leaks(docs(spark).limit(0), items).collect()


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    rng = random.Random(11)
    closing = "the house stands in recess until the bell has rung twice and then meets again to hear the report read."
    items = [(i, " ".join(words(rng, 40)) + ". " + closing, "x") for i in range(2)]
    items += [(10 + i, " ".join(words(rng, 60)), "x") for i in range(6)]
    items = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    parts = [r.text.split() for r in items.collect()]
    # A misspelling that could stand for words of two items is no word of either, whatever block they are in.
    texts = [" ".join(words(rng, 30)) + " " + closing, *(" ".join(words(rng, 9) + p[5:33] + words(rng, 9)) for p in parts), *(" ".join(w[1:] if k % 5 == 0 else w for k, w in enumerate(p[:40])) for p in parts)]
    table = docs(spark, *texts, *texts)
    whole = sorted(map(tuple, leak.leaks(table, items).collect()))
    assert {r[0] for r in whole} >= {1, 2, 3} and not any(r[0] == 0 for r in whole)
    assert sorted(map(tuple, leak.leaks(table, items, block_chars=300).collect())) == whole
    blocks = list(leak.blocks_of(items, 300))
    assert len(blocks) > 2
    block = leak.Items(*next(leak.blocks_of(items, 10**9)))
    shards = leak.shard_matches(texts, block, {})
    monkeypatch.setattr(leak, "PAIRS_AT_ONCE", 20)
    assert sorted(leak.shard_matches(texts, block, {})) == sorted(shards) != []


def test_verbatim_counts_the_very_words(spark):
    rng = random.Random(12)
    item = words(rng, 30)
    typed = [w[:-1] if k == 12 else w for k, w in enumerate(item)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    got = leak.leaks(docs(spark, " ".join(typed)), items).first()
    assert (got.score, got.span, got.verbatim) == (60.0, 30, 17)


def test_asides_have_a_border():
    inside, outside = "[" + "a" * 60 + "]", "[" + "a" * 61 + "]"
    assert leak.words_of(f"one {inside} two") == ["one", "two"]
    assert leak.words_of(f"one {outside} two") == ["one", "a" * 61, "two"]


def test_workers_need_no_package(tmp_path):
    """Driver with the package on its path alone, workers started elsewhere without it."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from mnemora.llm import leak, quality
text = " ".join("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor".split())
docs, items = spark.createDataFrame([(1, "so " + text)], "doc_id bigint, text string"), spark.createDataFrame([(5, text)], "item_id bigint, text string")
assert [tuple(r)[:2] for r in leak.leaks(docs, items).collect()] == [(1, 5)]
assert quality.outlierness(docs).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


NOUNS = "committee market bridge school harbour library report tariff hospital budget forest pension".split()
PROSE = ["the {0} of the {1} should not {2} this {0} and we must have a {1} in our {2}", "I think that every {0} will be a {1} for the {2}, but they would not say so", "it is no secret that the {1} was in the {0} with an old {2} before we came"]


def prose(rng, n):
    return " ".join(rng.choice(PROSE).format(*rng.choices(NOUNS, k=3)).capitalize() + "." for _ in range(n))


def test_not_prose(spark):
    rng = random.Random(4)
    good = [prose(rng, rng.randrange(3, 12)) for _ in range(300)]
    good += [prose(rng, 6).upper(), prose(rng, 6).replace(".", ""), prose(rng, 2), prose(rng, 20) + "\n1. " + "\n2. ".join(NOUNS[:4])]
    bad = ["\n".join(f"{i}. {a} {b}" for i, (a, b) in enumerate(zip(NOUNS, NOUNS[1:], strict=False))) * 3, "\n".join(f"{n}\t{rng.randrange(999)}\t{rng.random():.2f}\tn/a" for n in NOUNS), " ".join(rng.choices(NOUNS, k=80)), " ".join(rng.choices("the of and to a in for".split(), k=80)), "x8Fq+zz/" * 60, "#### ---- ====", prose(rng, 1) + "\n" + "\n".join(f"{a} {b}" for a in NOUNS for b in NOUNS)]
    labels = [(i, "ada", "prose") for i in range(0, 300, 3)] + [(0, "bo", "list"), (1, "bo", None)] + [(len(good) + i, "cy", "list") for i in range(4)]
    table = docs(spark, *good, *bad, "", None, " \n ")
    rated = spark.createDataFrame(labels, "doc_id bigint, rater string, form string")
    got = {r.doc_id for r in quality.not_prose(table, rated).collect()}
    assert got == set(range(len(good), len(good) + len(bad)))
    # Without ratings the default threshold holds and still tells the clear cases.
    assert {r.doc_id for r in quality.not_prose(table, rated.limit(0)).collect()} <= got


def test_outlierness_parts(spark):
    rng = random.Random(9)
    out = quality.outlierness(docs(spark, *[prose(rng, 5) for _ in range(80)], None, "")).collect()
    for r in out:
        if r.n_lines == 0:
            assert r.distance is None and r.contributions is None
        else:
            assert sum(r.contributions.values()) == pytest.approx(r.distance) and set(r.contributions) == set(quality.STATISTICS)
    assert quality.not_prose(docs(spark).limit(0), spark.createDataFrame([], "doc_id bigint, rater string, form string")).collect() == []


def test_statistics_of():
    got = dict(zip((c.split()[0] for c in quality.STATISTICS_SCHEMA.split(", ")), quality.statistics_of("The cat, the dog\nand 3 mice."), strict=True))
    assert (got["language"], got["n_words"], got["n_lines"]) == ("en", 7, 2)
    assert got["function_share"] == pytest.approx(3 / 7) and got["alternation"] == pytest.approx(5 / 6) and got["digit_share"] == pytest.approx(1 / 7)
    assert quality.statistics_of(None)[0] is None and quality.statistics_of("…")[2] == 0


def test_threshold_takes_every_rated_document(spark):
    import numpy as np
    from pyspark.sql import functions as F

    def cut(ratings):
        """The best cut between different distances, by trying each."""
        x = np.log([max(d, 1e-3) for d, _ in ratings])
        y = np.array([o for _, o in ratings])
        values = np.unique(x)
        after = np.searchsorted(np.sort(x[y]), values, "right") + (~y).sum() - np.searchsorted(np.sort(x[~y]), values, "right")
        good = [i for i in range(len(values) - 1) if after[i] == after[:-1].min()]
        i = max(good, key=lambda i: (values[i + 1] - values[i], -i))
        return float(np.exp((values[i] + values[i + 1]) / 2))

    # 30 000 ratings, all of which agree with one cut alone.
    for at in (14_998, 14_999, 15_000):
        docs = spark.range(30_000).select(F.col("id").alias("doc_id"), (1 + F.col("id") / 100).alias("distance"))
        labels = docs.select("doc_id", F.when(F.col("doc_id") > at, "list").otherwise("prose").alias("form"))
        assert quality.threshold(docs, labels) == pytest.approx(cut([(1 + k / 100, k > at) for k in range(30_000)]), rel=1e-12)
    # Noise, equal distances, both forms at one distance, split votes, no votes.
    rng = random.Random(3)
    for n, steps in ((400, 30), (60, 4)):
        rows = [(k, rng.randrange(steps) / 2) for k in range(n)]
        other = {k: d > steps / 4 if rng.random() < 0.8 else rng.random() < 0.5 for k, d in rows} | {0: True, 1: False}
        docs = spark.createDataFrame([*rows, (n, None), (n + 1, 0.3)], "doc_id bigint, distance double")
        votes = [(k, "list" if o else "prose") for k, o in other.items()] + [(n, "list"), (n + 1, "list"), (n + 1, "prose"), (5 * n, "list"), (0, None), (None, "list")]
        assert quality.threshold(docs, spark.createDataFrame(votes, "doc_id bigint, form string")) == pytest.approx(cut([(d, other[k]) for k, d in rows]))
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "doc_id bigint, distance double")
    assert quality.threshold(same, spark.createDataFrame([(1, "list"), (2, "prose")], "doc_id bigint, form string")) == quality.DEFAULT_THRESHOLD
    assert quality.threshold(same, spark.createDataFrame([(1, "list")], "doc_id bigint, form string")) == quality.DEFAULT_THRESHOLD
    assert quality.threshold(same.limit(0), spark.createDataFrame([(1, "list")], "doc_id bigint, form string")) == quality.DEFAULT_THRESHOLD
