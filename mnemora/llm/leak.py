"""Evaluation passages inside training text.

Training shards carry suffix arrays over words; every suffix of every test item is binary-searched in each shard,
which gives all places that share its first words and, by extension, the longest verbatim match. Verbatim matches on
neighbouring diagonals of one document and item are then joined by a local alignment, so that passages with changed,
lost or added words are found whole. The corpus is read once by a narrow map: nothing is shuffled but the result.

A shard is one Arrow batch of whole documents. Only suffixes that begin with ``SEED`` words of the test vocabulary can
match a test suffix, so only those stand in the array. What depends on all test items at once (procedural formulas,
words that a misspelling could equally mean) is counted over all of them before they are cut into blocks, so a
block's matches don't depend on the cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemora.runtime import checkpointed

#: Words that a verbatim seed has; words that seeds of one diagonal band must cover together before they are aligned.
SEED, COVERED = 3, 8
#: Width of a diagonal band in words: how far insertions and losses may shift a passage between seeds.
BAND = 16
#: Alignment scores: an equal word, and any changed, lost or added word.
EQUAL, ODD = 2, -1
#: Least alignment score and span in item words of a case: a verbatim phrase of 15 words scores 30 and is none.
LEAST_SCORE, LEAST_SPAN = 31, 17
#: Characters of test items that go to the executors at once; larger sets are taken in hashed blocks of about this size.
BLOCK_CHARS = 8_000_000
#: Pairs of positions that a shard holds at once; with more it's cut by documents, then by items.
PAIRS_AT_ONCE = 4_000_000
#: Sentences of at most so many words can be formulas.
FORMULA_WORDS = 20
#: Distinct corpus words that a Python worker remembers; beyond it the memory starts afresh (results are the same).
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W_]+")
_ASIDE = re.compile(r"\[[^\[\]\n]{1,60}\]|\([^()\n]{1,60}\)")
#: Blocks of combining marks and invisible format characters.
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_BROKEN = re.compile(r"(?<=\w)[-‐‑­]\s*\r?\n\s*(?=\w)")
_DIGITS = str.maketrans("015", "ols")
#: Letters of other scripts that look like Latin ones, as scanners and typists mix them.
_ALIKE = str.maketrans(dict(zip("аеорсухіѕјԁһκνοραι", "aeopcyxisjdhkvopai", strict=True)))


def words_of(text: str) -> list[str]:
    """The words of a text, apart from writing and setting: case, accents, compatibility forms, asides in brackets,
    words broken at a line end, invisible characters, and digits inside words that stand for letters.

    An aside (a column mark, a call from the floor) is bracketed text of up to 60 characters without a line break or
    an inner bracket; longer bracketed text is part of the speech and keeps its words.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _MARKS.sub("", text)
    text = _BROKEN.sub("", _ASIDE.sub(" ", text)).casefold()
    words = _WORD.findall(text)
    return [w if w.isalpha() or w.isdigit() else w.translate(_DIGITS) for w in words]


def latin_if_mixed(word: str) -> str:
    """A word of mixed scripts in Latin letters; words of one script stay."""
    if word.isascii():
        return word
    other = word.translate(_ALIKE)
    return other if other.isascii() else word


def out_of(word: str) -> set[str]:
    """A word with each way to leave one letter out; short words have none."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))} if len(word) >= 4 else set()


def folded(text: str) -> list[str]:
    return [latin_if_mixed(w) for w in words_of(text)]


def sentence_ends(text: str) -> list[tuple[bool, str, int]]:
    """``(may be a formula, words, their number)`` of each sentence: short ones among the first and last two of a text may."""
    sentences = [s for s in map(folded, re.split(r"(?<=[.!?:;])\s+", text)) if s]
    ends = {0, 1, len(sentences) - 1, len(sentences) - 2}
    return [(k in ends and len(s) <= FORMULA_WORDS, " ".join(s), len(s)) for k, s in enumerate(sentences)]


def item_facts(text: str) -> set[tuple[str, str, str]]:
    """``(kind, text, by)`` of one item: its possible formulas (by the item's words) and shortened words (by the word).

    A formula or a shortened word that two different items or words share is ``shared``.
    """
    words = folded(text)
    whole = " ".join(words)
    return {("formula", s, whole) for may, s, _ in sentence_ends(text) if may} | {("short", v, w) for w in set(words) for v in out_of(w)}


class Items:
    """A block of test items: vocabulary, suffixes, and which words belong to procedural formulas.

    ``shared`` has the ``(kind, text)`` that several items (formulas) or words (shortened words) of the whole test set
    have in common, as far as they occur in the block.
    """

    def __init__(self, ids: list, texts: list[str], shared: set[tuple[str, str]] = frozenset()) -> None:
        self.ids = ids
        words = [folded(t) for t in texts]
        vocabulary: dict[str, int] = {}
        flat, start = [], [0]
        for ws in words:
            flat += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws]
            start.append(len(flat))
        self.vocabulary = vocabulary
        self.flat, self.start = np.array(flat, "int64"), np.array(start, "int64")
        self.owner = np.repeat(np.arange(len(ids)), np.diff(self.start))
        #: Marks the words of opening and closing sentences that stand, whole, at an end of at least two different items.
        self.formula = np.zeros(len(flat), bool)
        for n, text in enumerate(texts):
            at = start[n]
            for may, sentence, size in sentence_ends(text):
                if may and ("formula", sentence) in shared and at + size <= start[n + 1]:
                    self.formula[at : at + size] = True
                at += size
        #: Words by each way to leave one letter out, to recognise a word with one wrong, lost or added letter.
        self.near = {v: i for w, i in vocabulary.items() for v in out_of(w) if ("short", v) not in shared}

    def code(self, word: str) -> int:
        """Twice the number of the item word that a corpus word stands for, plus 1 if it is that very word; 0 if none."""
        word = latin_if_mixed(word)
        own = self.vocabulary.get(word)
        if own is not None:
            return 2 * own + 1
        return next((2 * got for v in (word, *out_of(word)) if (got := self.near.get(v))), 0) if len(word) >= 4 else 0


def suffix_array(tokens: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes of ``tokens`` that begin with ``SEED`` known words, sorted, with the packed words they are sorted by.

    ``tokens`` are below ``base``; 0 is no word and ends a match. The order goes as deep as one machine word holds
    (six words for a vocabulary of about a thousand); how far a match reaches beyond is read off the text itself, so
    no deeper order is needed. The last value is that depth.
    """
    depth = max(SEED, int(62 // np.log2(max(base, 2))))
    padded = np.concatenate([tokens, np.zeros(depth, tokens.dtype)])
    live = np.ones(len(tokens), bool)
    for k in range(SEED):
        live &= padded[k : k + len(tokens)] > 0
    at = np.flatnonzero(live)
    packed = np.zeros(len(at), "int64")
    for k in range(depth):
        packed = packed * base + padded[at + k]
    order = np.argsort(packed, kind="stable")
    return at[order], packed[order], depth


def item_suffixes(items: Items) -> np.ndarray:
    """Positions of all item suffixes that begin with ``SEED`` words of one item, formulas aside."""
    at = np.arange(max(0, len(items.flat) - SEED + 1))
    whole = items.owner[at] == items.owner[at + SEED - 1]
    for k in range(SEED):
        whole &= ~items.formula[at + k]
    return at[whole]


def seeds_in(tokens: np.ndarray, items: Items, at: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs (shard position, item position) that share ``SEED`` words, by binary search of every item suffix (or those ``at``).

    None if there are more than ``most``: they are counted before any is written out.
    """
    base = len(items.vocabulary) + 1
    order, keys, depth = suffix_array(tokens, base)
    at = item_suffixes(items) if at is None else at
    prefix = np.zeros(len(at), "int64")
    for k in range(SEED):
        prefix = prefix * base + items.flat[at + k]
    step = base ** (depth - SEED)
    left, right = np.searchsorted(keys, prefix * step), np.searchsorted(keys, (prefix + 1) * step)
    n = right - left
    if most is not None and n.sum() > most:
        return None
    first = np.repeat(left - np.concatenate([[0], np.cumsum(n)])[:-1], n)
    return order[first + np.arange(n.sum())], np.repeat(at, n)


def longest_runs(pair: np.ndarray, p: np.ndarray, s: np.ndarray) -> dict[int, int]:
    """Longest verbatim match in words of each pair: seeds that follow one another on one diagonal."""
    if not len(p):
        return {}
    order = np.lexsort((s, p - s, pair))
    pair, p, s = pair[order], p[order], s[order]
    new = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(p - s) != 0) | (np.diff(s) != 1)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(s))) + SEED - 1
    return pd.Series(size).groupby(pair[first]).max().to_dict()


def align(texts: np.ndarray, items: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and its span in item words, for many (window, item) pairs in step.

    ``texts`` is (pairs, window) and ``items`` (pairs, length), 0-padded; ``worth`` is what an equal word counts.
    """
    pairs, length = items.shape
    width = texts.shape[1]
    ramp = np.arange(width + 1)
    row = np.zeros((pairs, width + 1))
    begin = np.zeros((pairs, width + 1), "int64")  # the item word at which the alignment that ends here began
    best, span = np.zeros(pairs), np.zeros(pairs, "int64")
    for i in range(length):
        word = items[:, i : i + 1]
        same = (texts == word) & (word > 0)
        diagonal = row[:, :-1] + np.where(same, worth[:, i : i + 1], ODD)
        now = np.zeros_like(row)
        start = np.full_like(begin, i + 1)
        up = row[:, 1:] + ODD
        take = diagonal >= up
        now[:, 1:] = np.where(take, diagonal, up)
        start[:, 1:] = np.where(take, np.where(row[:, :-1] > 0, begin[:, :-1], i), begin[:, 1:])
        dead = now <= 0
        now[dead], start[dead] = 0, i + 1
        # Added words: the best earlier cell less one for each word between, as a running maximum.
        lifted = now - ODD * ramp
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted >= top, ramp, 0), axis=1)
        over = top + ODD * ramp
        start = np.where(over > now, np.take_along_axis(start, source, axis=1), start)
        row, begin = np.maximum(now, over), start
        row = np.maximum(row, 0)
        at = row.argmax(axis=1)
        high = row[np.arange(pairs), at]
        better = high > best
        best = np.where(better, high, best)
        span = np.where(better, i + 1 - begin[np.arange(pairs), at], span)
    return best, span


def shard_matches(texts: list[str | None], items: Items, known: dict[str, int]) -> list[tuple[int, int, float, int, int]]:
    """``(text index, item index, score, span, longest verbatim match)`` of the best passage of each pair in a shard."""
    flat: list[int] = []
    start = [0]
    for text in texts:
        if text:
            words = words_of(text)
            try:
                flat += [known[w] for w in words]
            except KeyError:
                if len(known) > REMEMBERED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = items.code(w)
                flat += [known[w] for w in words]
        flat.append(0)
        start.append(len(flat))
    codes = np.array(flat, "int64")
    return _matches(codes >> 1, codes & 1, np.array(start, "int64"), items, item_suffixes(items))


def _matches(tokens: np.ndarray, exact: np.ndarray, begin: np.ndarray, items: Items, at: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """Matches of the texts that begin at ``begin`` (the last entry is their end) with the item suffixes ``at``.

    Texts and items are independent, so a shard with too many pairs at once is cut in halves by texts, then by items.
    """
    docs = len(begin) - 1
    owners = np.unique(items.owner[at])
    found = seeds_in(tokens, items, at, PAIRS_AT_ONCE if docs > 1 or len(owners) > 1 else None)
    if found is None and docs > 1:
        half = docs // 2
        cut = begin[half]
        left = _matches(tokens[:cut], exact[:cut], begin[: half + 1], items, at)
        return left + [(d + half, *rest) for d, *rest in _matches(tokens[cut:], exact[cut:], begin[half:] - cut, items, at)]
    if found is None:
        first = items.owner[at] < owners[len(owners) // 2]
        return _matches(tokens, exact, begin, items, at[first]) + _matches(tokens, exact, begin, items, at[~first])
    p, s = found
    if not len(p):
        return []
    doc, item = np.searchsorted(begin, p, "right") - 1, items.owner[s]
    shift = p - begin[doc] - (s - items.start[item]) + -(-int(np.diff(items.start).max()) // BAND) * BAND + BAND
    both = doc * len(items.ids) + item
    found = []
    # Two sets of bands, half a band apart, so that no passage is cut by a band's edge.
    for offset in (0, BAND // 2):
        band = (shift + offset) // BAND
        pair = both * (int(band.max()) + 1) + band
        order = np.lexsort((s, pair))
        sorted_pair, sorted_s = pair[order], s[order]
        fresh = np.concatenate([[True], (np.diff(sorted_pair) != 0) | (np.diff(sorted_s) != 0)])
        groups, counts = np.unique(sorted_pair[fresh], return_counts=True)
        mask = np.isin(pair, groups[counts >= COVERED - SEED + 1])
        if mask.any():
            frame = pd.DataFrame({"pair": pair[mask], "doc": doc[mask], "item": item[mask], "p": p[mask]})
            found.append(frame.groupby("pair").agg(doc=("doc", "first"), item=("item", "first"), low=("p", "min"), high=("p", "max")))
    if not found:
        return []
    # Around the seeds of a band, a window may hold the item's whole length on either side.
    cases = pd.concat(found)
    length = np.diff(items.start)[cases.item]
    cases["low"] = np.maximum(cases.low - length, begin[cases.doc])
    cases["high"] = np.minimum(cases.high + SEED + length, begin[cases.doc + 1] - 1)
    cases = cases.drop_duplicates(["doc", "item", "low", "high"])
    cases["width"], cases["length"] = cases.high - cases.low, np.diff(items.start)[cases.item]
    cases = cases.sort_values(["width", "length"])
    best: dict[tuple[int, int], tuple[float, int]] = {}
    rows = list(cases[["doc", "item", "low", "high"]].itertuples(index=False, name=None))
    k = 0
    while k < len(rows):
        some = 1
        while k + some < len(rows) and some < 512 and (rows[k + some][3] - rows[k + some][2]) * (some + 1) < 400_000:
            some += 1
        chunk = rows[k : k + some]
        k += some
        width, tall = max(r[3] - r[2] for r in chunk), max(items.start[r[1] + 1] - items.start[r[1]] for r in chunk)
        a, b, worth = np.full((some, width), -1), np.zeros((some, tall), "int64"), np.zeros((some, tall))
        for n, (_, i, low, high) in enumerate(chunk):
            a[n, : high - low] = tokens[low:high]
            own = slice(items.start[i], items.start[i + 1])
            b[n, : own.stop - own.start] = items.flat[own]
            worth[n, : own.stop - own.start] = np.where(items.formula[own], 0, EQUAL)
        score, span = align(a, b, worth)
        for n, (d, i, _, _) in enumerate(chunk):
            if score[n] > best.get((d, i), (0, 0))[0]:
                best[d, i] = (float(score[n]), int(span[n]))
    hit = np.isin(both, [d * len(items.ids) + i for d, i in best]) & np.all([exact[p + k] == 1 for k in range(SEED)], axis=0)
    runs = longest_runs(both[hit], p[hit], s[hit])
    return [(d, i, score, span, int(runs.get(d * len(items.ids) + i, 0))) for (d, i), (score, span) in best.items()]


def blocks_of(eval_items: DataFrame, block_chars: int) -> Iterator[tuple[list, list, set]]:
    """``ids, texts, shared`` of the test items in hashed blocks of about ``block_chars`` characters.

    Only one block at a time is on the driver; formulas and shared shortened words are counted over all items.
    """
    asked = eval_items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    total = asked.agg(F.sum(F.length("text").cast("bigint"))).first()[0]
    if not total:
        return
    blocks = -(-total // block_chars)
    placed = checkpointed(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")))

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(b, *fact) for b, text in zip(pdf["block"], pdf["text"], strict=True) for fact in item_facts(text)}
            yield pd.DataFrame(sorted(rows), columns=["block", "kind", "fact", "by"])

    told = placed.select("block", "text").mapInPandas(facts, "block int, kind string, fact string, by string")
    shared = told.groupBy("kind", "fact").agg(F.min("by").alias("low"), F.max("by").alias("high")).where("low <> high").select("kind", "fact")
    shared = checkpointed(told.select("block", "kind", "fact").distinct().join(shared, ["kind", "fact"]))
    for block in range(blocks):
        rows = placed.where(F.col("block") == block).select("item_id", "text").collect()
        common = shared.where(F.col("block") == block).select("kind", "fact").collect()
        rows.sort(key=lambda r: (r.item_id, r.text))
        if rows:
            yield [r.item_id for r in rows], [r.text for r in rows], {(r.kind, r.fact) for r in common}


def leaks(documents: DataFrame, eval_items: DataFrame, least_score: float = LEAST_SCORE, least_span: int = LEAST_SPAN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Passages of test items in documents: ``doc_id, item_id, score, span, verbatim``, one row for each document and item.

    ``score`` is that of the best local alignment (2 for an equal word, -1 for a changed, lost or added one, formula
    words count nothing; words that differ by one letter count as equal), ``span`` its length in item words,
    ``verbatim`` the longest run of the very same words, formulas aside. Only passages of at least ``least_score`` and
    ``least_span`` are returned. The test set is a stated query set: it goes to the executors in blocks of about
    ``block_chars`` characters, each against all documents, and the result doesn't depend on the blocks. Defined
    cases: null, empty and wordless texts on either side have no passages; repeated documents or items give their
    distinct pairs; items shorter than the least passage are never found; other columns are never read; empty tables
    give no rows.
    """
    kinds = dict(documents.dtypes)["doc_id"], dict(eval_items.dtypes)["item_id"]
    item_type = to_arrow_type(eval_items.schema["item_id"].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, span int, verbatim int"
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    spark = documents.sparkSession
    result = None
    for ids, parts, shared in blocks_of(eval_items, block_chars):
        # Built-in types only: what a broadcast holds is read where this package isn't installed.
        sent = spark.sparkContext.broadcast((ids, parts, shared))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value)
            known: dict[str, int] = {}
            for batch in batches:
                names = batch.column(0).to_pylist()
                rows = [r for r in shard_matches(batch.column(1).to_pylist(), items, known) if r[2] >= least_score and r[3] >= least_span]
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"doc_id": [names[r[0]] for r in rows], "item_id": [items.ids[r[1]] for r in rows], "score": [r[2] for r in rows], "span": [r[3] for r in rows], "verbatim": [r[4] for r in rows]}),
                    schema=pa.schema([("doc_id", batch.schema.field(0).type), ("item_id", item_type), ("score", pa.float64()), ("span", pa.int32()), ("verbatim", pa.int32())]),
                )

        part = texts.mapInArrow(search, schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], schema)
    return result.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("span").alias("span"), F.max("verbatim").alias("verbatim"))


def clean_documents(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``documents`` without those that hold a test passage."""
    return documents.join(leaks(documents, eval_items).select("doc_id").distinct(), "doc_id", "left_anti")
