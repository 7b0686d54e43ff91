"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

The null keeps, on average, every item's frequency and every basket's size: item ``a`` is in basket ``s`` with
probability ``x_a y_s / (1 + x_a y_s)``. Items of equal frequency and baskets of equal size have equal parameters, so
a group's whole null is fitted on two histograms (frequencies, sizes), whose lengths grow at most with the square root
of its rows. The count of a pair is Poisson-binomial under the null: a sum of binomials, one per basket size. Its
upper tail is the pair's p-value, and the Benjamini-Hochberg rule over all pairs of a group gives the q-value.

No group's work stands in one task: only its two histograms meet there, for the fit. Tails are computed in bundles of
bounded size, and ranks of p-values come from ranges that are sorted apart and added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.runtime import checkpointed

FAMILY = ["basket", "graph_id"]
#: Keys of a block of a large basket: two blocks at a time meet in one list.
BLOCK_KEYS = 256
#: Distinct cases (two frequencies and a count) whose tails one bundle computes.
BUNDLE = 2048
#: Entries of the fit's matrix that are held at once.
HELD = 2_000_000


def read_baskets(read_trace: DataFrame) -> DataFrame:
    """Distinct ``(basket, graph_id, set_id, key)`` of reads: the non-null keys in seeds or selected of one read_id."""
    keys = F.concat(F.coalesce("seeds", F.array().cast("array<string>")), F.coalesce("selected", F.array().cast("array<string>")))
    rows = read_trace.where("read_id is not null and graph_id is not null").select("graph_id", F.col("read_id").cast("string").alias("set_id"), F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    return rows.distinct().select(F.lit("read").alias("basket"), "graph_id", "set_id", "key")


def episode_baskets(nodes: DataFrame) -> DataFrame:
    """Distinct ``(basket, graph_id, set_id, key)`` of episodes: the keys of all nodes of a graph that list one episode id."""
    ids = F.array_distinct(F.array_compact("source_episode_ids"))
    rows = nodes.where("key is not null and graph_id is not null").select("graph_id", F.explode(ids).alias("set_id"), "key")
    return rows.distinct().select(F.lit("episode").alias("basket"), "graph_id", "set_id", "key")


def fit_null(frequencies: np.ndarray, items: np.ndarray, sizes: np.ndarray, baskets: np.ndarray, rounds: int = 2000, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Parameters ``x`` per frequency class and ``y`` per size class of the maximum-entropy null with these histograms.

    Degrees met by every basket (or every item) have probability 1 and are set apart; the others are fitted by
    fixed-point iteration until expected degrees agree. The matrix of all classes is taken in strips.
    """
    f, s = frequencies.astype(float), sizes.astype(float)
    n, m = items.astype(float), baskets.astype(float)
    total = max((f * n).sum(), 1.0)
    x, y = f / np.sqrt(total), s / np.sqrt(total)
    full_f, full_s = f >= m.sum(), s >= n.sum()
    x[full_f], y[full_s] = 1e9, 1e9
    step = max(1, HELD // max(len(s), 1))
    strips = [slice(k, k + step) for k in range(0, len(f), step)]
    for _ in range(rounds):
        x2 = np.concatenate([(y * m / (1.0 + np.outer(x[k], y))).sum(axis=1) for k in strips])
        x2 = np.where(full_f, 1e9, f / np.maximum(x2, 1e-300))
        y2 = np.sum([((x2[k] * n[k])[:, None] / (1.0 + np.outer(x2[k], y))).sum(axis=0) for k in strips], axis=0)
        y2 = np.where(full_s, 1e9, s / np.maximum(y2, 1e-300))
        moved = max(np.abs(np.log(np.maximum(x2, 1e-300) / np.maximum(x, 1e-300))).max(), np.abs(np.log(np.maximum(y2, 1e-300) / np.maximum(y, 1e-300))).max())
        x, y = x2, y2
        if moved < tolerance:
            break
    return x, y


def membership(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Probability ``[frequency class, size class]`` that an item is in a basket."""
    xy = np.outer(x, y)
    return np.clip(xy / (1.0 + xy), 0.0, 1.0)


def binomial_sum_tails(q: np.ndarray, baskets: np.ndarray, at_least: np.ndarray) -> np.ndarray:
    """P(X >= at_least[i]) for X the sum of ``baskets[c]`` Bernoulli trials with success ``q[i, c]`` for every class c.

    Above the mean the distribution is tilted so that its mean becomes the observed count, and the tail is summed from
    its characteristic function: what is left out is below 1e-16 of the result, whatever the count, and the
    frequencies needed don't grow with it. Up to the mean the complement is taken the same way.
    """
    trials = np.broadcast_to(baskets.astype(float), q.shape)
    sure = (q >= 1).astype(float)
    k = at_least.astype(float) - (sure * trials).sum(axis=1)
    m = trials * ((q > 0) & (q < 1))
    q = np.where(m > 0, q, 0.5)
    total = m.sum(axis=1)
    below = (k <= (q * m).sum(axis=1)) & (k > 0)
    q = np.where(below[:, None], 1.0 - q, q)
    k = np.where(below, total - k + 1, k)
    out = np.where(k <= 0, 1.0, 0.0)
    # Every trial succeeds: one product; it also has no finite tilt.
    every = (k > 0) & (k == total)
    out[every] = np.exp((m[every] * np.log(q[every])).sum(axis=1))
    left = np.flatnonzero((k > 0) & (k < total))
    if left.size:
        out[left] = _tilted_tails(q[left], m[left], k[left])
    return np.clip(np.where(below, 1.0 - out, out), 0.0, 1.0)


def _tilted_tails(q: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The tails for ``mean < k < trials``, all ``q`` inside (0, 1)."""
    odds = np.log(q) - np.log1p(-q)

    def tilted(theta):
        return 1.0 / (1.0 + np.exp(-np.clip(odds + theta[:, None], -700, 700)))

    # Newton steps for the tilt, kept inside a bracket; a tilt near the root is as good as the root.
    low, high = np.zeros(len(k)), np.full(len(k), 1.0)
    while (short := (tilted(high) * m).sum(axis=1) < k).any():
        high = np.where(short, high * 2, high)
    theta = np.clip(np.log(k / (q * m).sum(axis=1)), low, high)
    for _ in range(100):
        p = tilted(theta)
        mean, variance = (p * m).sum(axis=1), (p * (1 - p) * m).sum(axis=1)
        if (np.abs(mean - k) <= 1e-3 * np.sqrt(variance)).all():
            break
        low, high = np.where(mean < k, theta, low), np.where(mean < k, high, theta)
        step = theta + (k - mean) / np.maximum(variance, 1e-300)
        theta = np.where((step > low) & (step < high), step, (low + high) / 2)
    p = tilted(theta)
    sd = np.sqrt((p * (1 - p) * m).sum(axis=1))
    scale = np.exp((m * (np.logaddexp(0.0, odds + theta[:, None]) - np.logaddexp(0.0, odds))).sum(axis=1) - theta * k)
    # Windows of powers of two beyond ten standard deviations; frequencies until the characteristic function vanishes.
    window = np.ceil(np.log2(10 * sd + 32)).astype(int)
    out = np.zeros(len(k))
    for w in np.unique(window):
        mine = np.flatnonzero(window == w)
        half = 2.0**w
        freqs = int(min(half, np.ceil(15 / sd[mine].min() * half / np.pi)))
        step = max(1, int(1_000_000 // (q.shape[1] * (freqs + 1))))
        omega = np.pi / half * np.arange(freqs + 1)
        weight = np.where((np.arange(freqs + 1) == 0) | (np.arange(freqs + 1) == half), 1.0, 2.0)
        turn = np.expm1(1j * omega)
        for i in (mine[j : j + step] for j in range(0, len(mine), step)):
            psi = np.exp((m[i][:, :, None] * np.log1p(p[i][:, :, None] * turn)).sum(axis=1) - 1j * omega * k[i][:, None])
            z = -(theta[i][:, None] + 1j * omega)
            with np.errstate(divide="ignore", invalid="ignore"):
                series = np.where(z == 0, half, np.expm1(z * half) / np.expm1(z))
            out[i] = (weight * (psi * series).real).sum(axis=1) / (2 * half)
    return out * scale


def poisson_binomial_tail(q: np.ndarray, baskets: np.ndarray, at_least: int) -> float:
    """``binomial_sum_tails`` of one case."""
    return float(binomial_sum_tails(np.asarray(q, dtype=float)[None, :], np.asarray(baskets), np.array([at_least]))[0])


def _fitted_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The null of each family from its two histograms."""
    for pdf in batches:
        rows = []
        for row in pdf.itertuples(index=False):
            f, n = np.array([h["degree"] for h in row.frequencies]), np.array([h["n"] for h in row.frequencies])
            s, m = np.array([h["degree"] for h in row.sizes]), np.array([h["n"] for h in row.sizes])
            x, y = fit_null(f, n, s, m)
            rows.append((row.basket, row.graph_id, f, x, y, m))
        yield pd.DataFrame(rows, columns=[*FAMILY, "f", "x", "y", "m"])


def _tail_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each case (two frequencies and a count) of a bundle: expected count and tail probability under its family's null."""
    columns = [*FAMILY, "n_low", "n_high", "n_ab", "pairs", "expected", "p_value"]
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            f, x, y, m = (np.asarray(v) for v in (row.f, row.x, row.y, row.m))
            case = np.array([(c["n_low"], c["n_high"], c["n_ab"], c["pairs"]) for c in row.cases])
            q = membership(x[np.searchsorted(f, case[:, 0])], y) * membership(x[np.searchsorted(f, case[:, 1])], y)
            yield pd.DataFrame({"basket": row.basket, "graph_id": row.graph_id, "n_low": case[:, 0], "n_high": case[:, 1], "n_ab": case[:, 2], "pairs": case[:, 3], "expected": (q * m).sum(axis=1), "p_value": binomial_sum_tails(q, m, case[:, 2])}, columns=columns)


def basket_sizes(baskets: DataFrame) -> DataFrame:
    """``basket, graph_id, set_id, degree``: distinct keys of every basket."""
    return baskets.groupBy(*FAMILY, "set_id").agg(F.count(F.lit(1)).alias("degree"))


def degree_histograms(baskets: DataFrame) -> DataFrame:
    """``basket, graph_id, side, degree, n``: how many keys have a frequency (side ``key``), how many baskets a size (``set``)."""
    keys = baskets.groupBy(*FAMILY, "key").agg(F.count(F.lit(1)).alias("degree")).select(*FAMILY, F.lit("key").alias("side"), "degree")
    sets = basket_sizes(baskets).select(*FAMILY, F.lit("set").alias("side"), "degree")
    return keys.unionByName(sets).groupBy(*FAMILY, "side", "degree").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(baskets: DataFrame, least: dict[str, int], lift: float = 0.0, histograms: DataFrame | None = None) -> DataFrame:
    """Exact ``n_ab, n_a, n_b, n_sets`` of every pair of keys with ``n_ab >= least[basket]`` and ``n_ab n_sets >= lift n_a n_b``.

    Two bounds leave out only keys that can be in no such pair: a key met less often than ``least``, and, since
    ``n_ab`` is at most the rarer key's count, a key with ``lift * n > n_sets``. That also takes the hubs away, so the
    work left follows the pairs that can qualify. Pairs of one basket are streamed by two generators and counted
    before the shuffle; no basket's pairs ever stand in one array. A basket of more than ``BLOCK_KEYS`` keys is cut
    into blocks by a hash of the key, and every two blocks meet in a list of their own, so a huge basket is spread
    over many tasks. ``histograms`` are those of ``degree_histograms``, if they are at hand.
    """
    histograms = checkpointed(degree_histograms(baskets)) if histograms is None else histograms
    floor = F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v))])[F.col("basket")]
    sets = histograms.where("side = 'set'").groupBy(*FAMILY).agg(F.sum("n").alias("n_sets"))
    items = baskets.groupBy(*FAMILY, "key").agg(F.count(F.lit(1)).alias("n"))
    items = items.join(sets, FAMILY).where((F.col("n") >= floor) & (F.col("n") * lift <= F.col("n_sets")))
    kept = baskets.join(items, [*FAMILY, "key"])
    if histograms.where(f"side = 'set' and degree > {BLOCK_KEYS}").isEmpty():
        kept = kept.withColumns({"block": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    else:
        large = basket_sizes(baskets).where(F.col("degree") > BLOCK_KEYS).select(*FAMILY, "set_id", F.ceil(F.col("degree") / BLOCK_KEYS).cast("int").alias("blocks"))
        kept = kept.join(large, [*FAMILY, "set_id"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        kept = kept.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        kept = kept.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    groups = kept.groupBy(*FAMILY, "set_id", "low", "high").agg(F.array_sort(F.collect_list(F.struct("key", "n", "block"))).alias("keys"), F.max("n_sets").alias("n_sets")).where(F.size("keys") > 1)
    first = groups.select(*FAMILY, "n_sets", "low", "high", "keys", F.posexplode("keys").alias("pos", "a")).where(F.col("pos") < F.size("keys") - 1)
    after = F.slice("keys", F.col("pos") + 2, F.size("keys"))
    # In the list of two different blocks only pairs across them count; those within one have a list of their own.
    after = F.when(F.col("low") == F.col("high"), after).otherwise(F.filter(after, lambda k: k["block"] != F.col("a.block")))
    pairs = first.select(*FAMILY, "n_sets", "a", F.explode(after).alias("b"))
    counted = pairs.groupBy(*FAMILY, F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).agg(F.count(F.lit(1)).alias("n_ab"), F.max("a.n").alias("n_a"), F.max("b.n").alias("n_b"), F.max("n_sets").alias("n_sets"))
    return counted.where((F.col("n_ab") >= floor) & (F.col("n_ab") * F.col("n_sets") >= lift * F.col("n_a") * F.col("n_b")))


def surprising_pairs(baskets: DataFrame, least: dict[str, int] | None = None, lift: float = 0.0) -> DataFrame:
    """Pairs of keys of one graph with their exact counts and their surprise under the fitted null.

    ``baskets`` has distinct ``(basket, graph_id, set_id, key)``. Returns ``basket, graph_id, key_a, key_b`` (smaller
    key first), ``n_ab, n_a, n_b, n_sets, lift, expected, p_value, q_value`` for the pairs that ``pair_counts`` keeps: without
    ``least``, every pair that ever meets. With a higher ``least`` the q-values count the pairs below it as not rejected.
    q-values control the false discovery rate over all pairs of a family's keys, also those never met together (their
    p-value is 1); with ``lift`` above 0 the pairs below it count as not rejected, which makes q-values no smaller.
    Defined cases: null and repeated keys in a record count once or not at all; baskets of one key give no pair but
    count in ``n_sets``; ties of p-values share a q-value; an empty table gives no rows.
    """
    least = least or {"read": 1, "episode": 1}
    # Shuffle files of the counting are freed before what follows; they are most of the disk that is needed.
    histograms = checkpointed(degree_histograms(baskets), free=True)
    counts = checkpointed(pair_counts(baskets, least, lift, histograms), free=True)

    def histogram(side: str, name: str) -> DataFrame:
        return histograms.where(F.col("side") == side).groupBy(*FAMILY).agg(F.array_sort(F.collect_list(F.struct("degree", "n"))).alias(name), F.sum("n").alias(f"n_{name}"))

    kind = dict(baskets.dtypes)["graph_id"]
    tasks = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    family = f"basket string, graph_id {kind}"
    low, high = F.least("n_a", "n_b").alias("n_low"), F.greatest("n_a", "n_b").alias("n_high")
    cases = counts.select(*FAMILY, low, high, "n_ab").groupBy(*FAMILY, "n_low", "n_high", "n_ab").agg(F.count(F.lit(1)).alias("pairs"))
    load = cases.groupBy(*FAMILY).agg(F.ceil(F.count(F.lit(1)) / BUNDLE).cast("int").alias("bundles"))
    # A numbered repartition: these rows are few but costly, so they mustn't be merged into few tasks by their bytes.
    model = checkpointed(histogram("key", "frequencies").join(histogram("set", "sizes"), FAMILY).join(load, FAMILY).repartition(tasks, *FAMILY))
    tests = model.select(*FAMILY, (F.col("n_frequencies") * (F.col("n_frequencies") - 1) / 2).alias("tests"))
    fitted = model.select(*FAMILY, "frequencies", "sizes").mapInPandas(_fitted_rows, f"{family}, f array<bigint>, x array<double>, y array<double>, m array<bigint>")
    spread = fitted.join(load, FAMILY).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1))).drop("bundles")
    bundled = cases.join(load, FAMILY).withColumn("bundle", F.pmod(F.xxhash64("n_low", "n_high", "n_ab"), "bundles").cast("int"))
    bundled = bundled.groupBy(*FAMILY, "bundle").agg(F.collect_list(F.struct("n_low", "n_high", "n_ab", "pairs")).alias("cases"))
    work = bundled.join(spread, [*FAMILY, "bundle"]).drop("bundle").repartition(tasks)
    tails = work.select(*FAMILY, "f", "x", "y", "m", "cases").mapInPandas(_tail_rows, f"{family}, n_low bigint, n_high bigint, n_ab bigint, pairs bigint, expected double, p_value double")
    # Written once: cutting ranges reads its input twice.
    ranked = ranked_by_p(checkpointed(tails), tests, tasks).select(*FAMILY, "n_low", "n_high", "n_ab", "expected", "p_value", "q_value")
    scored = counts.withColumns({"n_low": low, "n_high": high}).join(ranked, [*FAMILY, "n_low", "n_high", "n_ab"])
    ratio = F.col("n_ab") * F.col("n_sets") / (F.col("n_a") * F.col("n_b"))
    return scored.select(*FAMILY, "key_a", "key_b", "n_ab", "n_a", "n_b", "n_sets", ratio.alias("lift"), "expected", "p_value", "q_value")


def ranked_by_p(tails: DataFrame, tests: DataFrame, ranges: int) -> DataFrame:
    """``tails`` (with ``pairs``, ``p_value``) with ``q_value``, the Benjamini-Hochberg value among ``tests`` of the family.

    A family's cases are cut into ranges of p-values; running counts and minima inside a range are completed by those
    of the ranges before and behind, of which a family has at most ``ranges``.
    """
    cut = checkpointed(tails.repartitionByRange(ranges, *FAMILY, "p_value").withColumn("range", F.spark_partition_id()))
    part, whole = [*FAMILY, "range"], Window.partitionBy(*FAMILY).orderBy("range")
    before = F.coalesce(F.sum("pairs").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = cut.groupBy(*part).agg(F.sum("pairs").alias("pairs")).select(*part, before.alias("start")).join(tests, FAMILY)
    up = Window.partitionBy(*part).orderBy("p_value")
    down = Window.partitionBy(*part).orderBy(F.desc("p_value"))
    placed = cut.join(start, part).withColumn("rank", F.col("start") + F.sum("pairs").over(up))
    placed = checkpointed(placed.withColumn("least", F.min(F.col("p_value") * F.col("tests") / F.col("rank")).over(down)))
    later = F.min("least").over(whole.rowsBetween(1, Window.unboundedFollowing))
    behind = placed.groupBy(*part).agg(F.min("least").alias("least")).select(*part, later.alias("behind"))
    return placed.join(behind, part).withColumn("q_value", F.least(F.lit(1.0), "least", "behind"))


def found_pairs(read_trace: DataFrame, nodes: DataFrame, lift: int = 3) -> DataFrame:
    """Pairs of both kinds that meet at least ``lift`` times as often as chance: the scored pairs, then the exact rule on whole numbers.

    The rule is one of counts, so the p- and q-values that the pairs carry drop none of them.
    """
    pairs = surprising_pairs(read_baskets(read_trace).unionByName(episode_baskets(nodes)), {"read": 6, "episode": 4}, lift)
    return pairs.where(F.col("n_ab") * F.col("n_sets") >= F.lit(lift) * F.col("n_a") * F.col("n_b")).select(*FAMILY, "key_a", "key_b")
