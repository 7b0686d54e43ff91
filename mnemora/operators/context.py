"""The contexts of reads, graph by graph: search, activation, budget and text of one graph where its rows lie together.

The operators of ``retrieve`` and ``graph`` write every (noun, entry) and (question, node) to a shuffle several times
over. Here only the input is shuffled, once, by graph; what a read makes in between stays in a worker's arrays. The
rules are those of ``retrieve.read``, whose operators take the graphs that are too large for one worker's arrays.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.config import RetrievalConfig
from mnemora.functions import text as T
from mnemora.operators import graph as Gr
from mnemora.operators import retrieve as Re
from mnemora.runtime import instant

G = "graph_id"
#: Rows (nodes and edges) of a graph up to which one worker holds it; its matrix of nodes has at most their square.
GRAPH_ROWS = 4000
#: Questions of one graph that are answered together; a graph asked more often is sent to several workers.
ASKS = 4096
#: Cells (questions by nodes, nouns by entries) of an array that is held at once.
CELLS = 1_000_000
NODE, EDGE, ASK = range(3)


def contexts(messages: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), text: str = "message") -> DataFrame:
    """``ask, graph_id, memory_block, context_block, text`` of messages, as ``retrieve.read(...)["context"]``."""
    if cfg.min_contribution > 0:  # single contributions are dropped there, which no sum over ways can do
        return Re.read(messages, nodes, edges, cfg, text)["context"]
    rows = nodes.select(G).unionByName(edges.select(G)).groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    large = rows.where(F.col("n") > GRAPH_ROWS).select(G)
    if large.isEmpty():
        return _together(messages, nodes, edges, cfg, text)
    (ours, theirs) = ([df.join(large, G, how) for df in (messages, nodes, edges)] for how in ("left_anti", "left_semi"))
    return _together(*ours, cfg, text).unionByName(Re.read(*theirs, cfg, text)["context"])


def _together(messages: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: RetrievalConfig, text: str) -> DataFrame:
    # At most one row for every ASKS questions, so it's broadcast whatever the size of the rest.
    hot = F.broadcast(messages.groupBy(G).agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("parts")).where("parts > 1"))
    at = F.unix_micros(F.coalesce(instant("created_at"), F.timestamp_seconds(F.lit(0)))).alias("at")
    own = nodes.where("graph_id is not null and key is not null").select(G, F.lit(NODE).alias("sort"), "key", F.col("name").alias("said"), T.tokens(T.node_text("name", "aliases")).alias("tokens"), F.array_distinct(F.array_compact("source_episode_ids")).alias("episodes"), at, "id")
    live = ~Gr.superseded(F.col("properties"))
    ways = edges.where("graph_id is not null").select(G, F.lit(EDGE).alias("sort"), F.col("source_key").alias("key"), F.col("target_key").alias("other"), "relation", F.col("snippet").alias("said"), T.tokens(T.relation_phrase("relation")).alias("tokens"), F.col("strength").cast("double").alias("strength"), live.alias("live"), at, "id")
    stored = own.unionByName(ways, allowMissingColumns=True).join(hot, G, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    asked = messages.where("graph_id is not null").join(hot, G, "left").select(G, F.lit(ASK).alias("sort"), "ask", T.nouns(text).alias("tokens"), F.pmod(F.xxhash64("ask"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    rows = stored.drop("parts").unionByName(asked, allowMissingColumns=True)
    rows = rows.select(G, "part", "sort", "ask", "key", "other", "relation", "said", "tokens", "episodes", "strength", "live", "at", "id")
    kinds = dict(rows.dtypes)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, now, out = None, ([], [], []), None, []
        for batch in batches:
            if schema is None:
                kind = {f.name: f.type for f in batch.schema}
                schema = pa.schema([("ask", kind["ask"]), (G, kind[G]), *[(c, pa.string()) for c in ("memory_block", "context_block", "text")]])
            for graph, part, sort, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (graph, part) != now:
                    if now is not None:
                        out += [(ask, now[0], *told) for ask, *told in _answers(*held, cfg)]
                    held, now = ([], [], []), (graph, part)
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                held[sort].append(row)
        if now is not None:
            out += [(ask, now[0], *told) for ask, *told in _answers(*held, cfg)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    placed = rows.repartition(G, "part").sortWithinPartitions(G, "part", "sort")
    return placed.mapInArrow(answer, f"ask {kinds['ask']}, graph_id {kinds[G]}, memory_block string, context_block string, text string")


def _nulls_first(x: object) -> tuple:
    return (x is not None, x)


def _hash(token: str, size: int) -> tuple[int, float]:
    """Bucket and sign of a token, as ``vectors.token_bucket`` and ``token_sign``."""
    h = hashlib.sha1(token.encode()).digest()
    return int.from_bytes(h[:4], "big") % size, 1.0 if h[4] & 1 else -1.0


def _noun_seeds(nouns: list[str], entries: dict[str, list[str]], n: int, cfg: RetrievalConfig) -> dict[str, list[str]]:
    """Accepted index keys of each noun: mean-centred search over all ``n`` entries, threshold and margin gates."""
    size = cfg.embed_dimensions
    keys = sorted(k for k in entries if entries[k])
    v = np.zeros((len(keys), size))
    for i, k in enumerate(keys):
        for token in entries[k]:
            bucket, sign = _hash(token, size)
            v[i, bucket] += sign
    norm = np.sqrt((v * v).sum(axis=1))
    keys, v = [k for k, x in zip(keys, norm, strict=True) if x], v[norm > 0] / norm[norm > 0][:, None]
    if not keys:
        return {}
    mean = v.sum(axis=0) / n if n > 1 else np.zeros(size)
    mm, vm, vv = mean @ mean, v @ mean, (v * v).sum(axis=1)
    top, got = max(cfg.seed_top_k, 2), {}
    step = max(1, CELLS // len(keys))
    for j in range(0, len(nouns), step):
        block = nouns[j : j + step]
        bucket, sign = (np.array(x) for x in zip(*[_hash(w, size) for w in block], strict=True))
        qm = sign * mean[bucket]
        square = (1 - 2 * qm + mm)[:, None] * (vv - 2 * vm + mm)[None, :]
        width = np.sqrt(np.maximum(square, 0.0))
        score = np.round((v[:, bucket].T * sign[:, None] - qm[:, None] - vm[None, :] + mm) / np.where(width <= 1e-12, 1.0, width), 9)
        # Keys are in order, so a stable sort leaves ties to the smaller one.
        best = np.argsort(-score, axis=1, kind="stable")[:, :top]
        for noun, at, s in zip(block, best, np.take_along_axis(score, best, axis=1), strict=True):
            s = [float(x) for x in s if x >= 0]
            ahead = bool(s) and s[0] >= cfg.seed_margin_floor and s[0] - (s[1] if len(s) > 1 else 0.0) >= cfg.seed_margin
            if found := [keys[a] for r, (a, x) in enumerate(zip(at, s, strict=False)) if x >= cfg.seed_similarity or (r == 0 and ahead)]:
                got[noun] = found
    return got


def _selected(seeds: np.ndarray, forward: np.ndarray, reverse: np.ndarray, shared: np.ndarray, cfg: RetrievalConfig) -> list[list[tuple[int, float]]]:
    """Selected nodes and their scores, by rank, of each row of ``seeds`` (questions by nodes in the order of keys)."""
    both = forward + reverse
    arrived, score = seeds, seeds.copy()
    fwd, rev = np.zeros_like(seeds), np.zeros_like(seeds)
    ways, reached = both > 0, seeds > 0
    frontier = reached
    for _ in range(cfg.max_depth):
        fwd += cfg.hop_decay * (arrived @ forward)
        rev += cfg.hop_decay * (arrived @ reverse)
        arrived = cfg.hop_decay * (arrived @ both)
        score += arrived
        frontier = frontier.astype(float) @ ways > 0
        reached = reached | frontier
    score = np.round(score, 9)
    fired = reached & (score >= cfg.primary_threshold)
    near = (fired.astype(float) @ shared > 0) & ~fired
    score = np.round(score + np.where(near, cfg.co_episode_boost, 0.0), 9)
    back = (seeds == 0) & (np.round(fwd, 9) < np.round(rev, 9))
    fit = (reached | near) & (score >= cfg.primary_threshold)
    order = np.argsort(np.where(fit, -score, np.inf), axis=1, kind="stable")
    places = {False: cfg.forward_budget, True: cfg.node_budget - cfg.forward_budget}
    out = []
    for i, n in enumerate(fit.sum(axis=1)):
        free, first, rest = dict(places), [], []
        for rank, k in enumerate(order[i, :n]):
            side = bool(back[i, k])
            (first if free[side] > 0 else rest).append(rank)
            free[side] -= 1
        kept = sorted((first + rest)[: cfg.node_budget])
        out.append([(int(k), float(score[i, k])) for k in order[i, kept]])
    return out


def _answers(nodes: list, edges: list, asks: list, cfg: RetrievalConfig) -> list[tuple]:
    """``ask, memory_block, context_block, text`` of the questions of one graph that have a context.

    Rows: ``ask, key, other, relation, said, tokens, episodes, strength, live, at, id``. Questions of equal seeds are
    answered once.
    """
    if not asks:
        return []
    # One node per key, the first written; one edge per id.
    node: dict[str, list] = {}
    for r in sorted(nodes, key=lambda r: (r[1], r[9], _nulls_first(r[10]))):
        node.setdefault(r[1], r)
    edge: dict[str | None, list] = {}
    for r in sorted(edges, key=lambda r: [_nulls_first(x) for x in r[1:4]]):
        edge.setdefault(r[10], r)
    entries: dict[str, list[str]] = {k: list(r[5]) for k, r in node.items()}
    relations = {r[3]: r[5] for r in edge.values()}
    ends = defaultdict(set)
    for r in edge.values():
        ends[r[3]].update(x for x in r[1:3] if x is not None)
    for relation, tokens in relations.items():
        if relation is not None:
            entries["REL::" + relation] = entries.get("REL::" + relation, []) + list(tokens)
    nouns_of = defaultdict(set)
    for r in asks:
        nouns_of[r[0]].update(r[5] or ())
    found = _noun_seeds(sorted(set().union(*nouns_of.values())), entries, len(node) + len(relations), cfg)
    seeds_of = {w: frozenset(x for k in ks for x in (ends.get(k[5:], ()) if k.startswith("REL::") else [k])) for w, ks in found.items()}
    asks_of = defaultdict(list)
    for ask, nouns in nouns_of.items():
        if seeds := frozenset().union(*[seeds_of[w] for w in nouns if w in seeds_of]):
            asks_of[seeds].append(ask)
    if not asks_of:
        return []

    keys = sorted(set(node) | {x for r in edge.values() for x in r[1:3] if x is not None})
    place = {k: i for i, k in enumerate(keys)}
    way = np.array([(place[r[1]], place[r[2]]) for r in edge.values() if r[1] is not None and r[2] is not None], dtype=int).reshape(-1, 2)
    strength = np.array([r[7] or 0.0 for r in edge.values() if r[1] is not None and r[2] is not None], dtype=float)
    total = np.bincount(way.ravel(), np.repeat(strength, 2), len(keys))
    total[total == 0] = 1.0
    forward, reverse = np.zeros((2, len(keys), len(keys)))
    np.add.at(forward, (way[:, 0], way[:, 1]), strength / total[way[:, 0]])
    np.add.at(reverse, (way[:, 1], way[:, 0]), strength / total[way[:, 1]])
    shared, by_episode = np.zeros((len(keys), len(keys))), defaultdict(list)
    for k, r in node.items():
        for e in r[6] or ():
            by_episode[e].append(place[k])
    for at in by_episode.values():
        if len(at) > 1:
            shared[np.ix_(at, at)] = 1.0

    # What each node's edges say, in the order of instants and ids; the strongest snippets around it.
    lines, snips = defaultdict(list), defaultdict(list)
    told = sorted((r for r in edge.values() if r[8]), key=lambda r: (r[9], _nulls_first(r[10])))
    for r in told:
        if r[1] in node and r[2] in node:
            parts = node[r[1]][4], r[3], node[r[2]][4]
            lines[place[r[1]]].append((place[r[2]], None if None in parts else f"{parts[0]} -[{parts[1]}]-> {parts[2]}"))
        if r[4]:
            for d, end in enumerate(r[1:3]):
                if end is not None:
                    snips[place[end]].append((-r[7] if r[7] is not None else np.inf, d, r[9], _nulls_first(r[10]), r[4]))
    best = {k: [x[-1] for x in sorted(rows)[: cfg.max_snippets]] for k, rows in snips.items()}

    answers: list[tuple] = []
    sets = list(asks_of)
    step = max(1, CELLS // len(keys))
    for j in range(0, len(sets), step):
        start = np.zeros((len(sets[j : j + step]), len(keys)))
        for i, s in enumerate(sets[j : j + step]):
            start[i, [place[k] for k in s]] = 1.0
        for s, chosen in zip(sets[j : j + step], _selected(start, forward, reverse, shared, cfg), strict=True):
            there = {k for k, _ in chosen}
            memory = dict.fromkeys(line for k, _ in chosen for target, line in lines.get(k, ()) if target in there)
            context = dict.fromkeys(x for k, score in chosen if score >= cfg.secondary_threshold for x in best.get(k, ()))
            blocks = "[MEMORY]\n" + "\n".join(x for x in memory if x is not None) if memory else None, "[CONTEXT]\n" + "\n".join(f'"{x}"' for x in context) if context else None
            if memory or context:
                text = "\n\n".join(b for b in blocks if b is not None)
                answers += [(ask, *blocks, text) for ask in asks_of[s]]
    return answers
