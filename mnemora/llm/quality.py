"""Per-document text statistics, and the documents that aren't natural prose.

Prose of a language forms one cloud in their space; its centre and
covariance are estimated robustly (concentration steps: moments of the inliers, new distances, new inliers) from sums
that Spark aggregates, so only a few moments per language reach the driver. A document's squared Mahalanobis distance
from its language's cloud says how unlike prose it is, and splits into one contribution per statistic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.runtime import broadcast_if_small, checkpointed

#: Common function words of the languages, lower case; an elided word keeps its apostrophe.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up what its about than into them can only other could these two may first then do any like my now over such our me most made after also did many before must through where your down should because each those too shall cannot every i us nobody here unless although while whereas since yet even",
    "fr": "le la les de des du un une et à au aux en dans par pour sur avec sans ce cet cette ces que qui quoi dont où ne pas plus est sont être a ont avoir il elle ils elles nous vous je tu on se sa son ses leur leurs notre nos votre vos mon ma mes mais ou donc si comme même aussi très peut doit va aucun chaque tout tous toute toutes quand lorsque puisque parce bien devrait pourrait avant l' d' c' s' n' qu' j' m' t'",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber in im an am auf aus bei mit nach von vom zu zum zur für über unter vor durch gegen ohne um ist sind war waren wird werden wurde hat haben kann können soll sollen muss müssen darf dürfen nicht kein keine keinen keinem keiner auch als wie wenn weil dass damit obwohl während ich er sie es wir ihr mein meine unser unsere unseren unserem dieser diese dieses diesen diesem jeder jede jedes jeden sich noch nur schon sehr niemand solange dennoch",
    "el": "ο η το οι τα τον την του της των τους τις στο στη στην στον στα στις στους και ή αλλά να θα δεν μη μην με σε για από προς κατά μετά πριν χωρίς ένα ένας μια μία που πως ότι όταν αν επειδή ώστε ενώ είναι ήταν έχει έχουν πρέπει μπορεί κάθε μας σας μου σου κανένας καμία κανένα αυτό αυτή αυτός αυτόν αυτήν τη όπως",
}
LANGUAGES = tuple(FUNCTION_WORDS)
#: The statistics that span the space, and how far each may stray in prose for reasons that say nothing about its
#: form (standard deviations): letter case, punctuation, line breaks, subject and length don't make a text less prose.
SLACK = {
    "function_share": 0.05,
    "alternation": 0.07,
    "word_length": 0.12,
    "digit_share": 0.05,
    "symbol_share": 0.03,
    "line_end_share": 0.45,
    "variety": 0.05,
    "odd_share": 0.01,
    "length": 4.0,
    "lines": 4.0,
}
STATISTICS = tuple(SLACK)
#: A text of n words deviates by n / (n + DAMPING) of what a long one would: shares of few words scatter.
DAMPING = 14.0
#: Inliers of a concentration step: squared distance below this (0.999 quantile of chi-squared with 10 degrees).
INLIER, STEPS, LEAST_INLIERS = 29.6, 5, 60
#: The threshold where there are no ratings.
DEFAULT_THRESHOLD = 60.0


_BITS = {w: sum(1 << i for i, k in enumerate(LANGUAGES) if w in FUNCTION_WORDS[k].split()) for k in LANGUAGES for w in FUNCTION_WORDS[k].split()}
_ENUMERATOR = re.compile(r"(?m)^[ \t]*\(?(?:[^\W\d_]|\d{1,3})[.)][ \t]")
_ELISION = re.compile(r"(?<=[^\W\d_])['’](?=[^\W\d_])")
_SEPARATOR = re.compile(r"[^\w'/\s]+|_+")
_SIGN = re.compile(r"[^\w\s.,;:!?'\"’‘–—()\[\]“”«»…-]|_")
#: Letters that a wrong decoding leaves, when another sign of one follows; alone they are letters of French and others.
_ODD = re.compile("[ÃÂÐÎÏâ](?=[\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ])|[\u0080-\u009f�]")
_ENDS = tuple(".!?…»”\"')]")


def statistics_of(text: str | None) -> tuple:
    """Language, counts and statistics of one text, in the order of ``STATISTICS_SCHEMA``."""
    text = text or ""
    # Enumerators at line starts aren't words; an apostrophe ends an elided word; other signs separate words.
    words = _SEPARATOR.sub(" ", _ELISION.sub("' ", _ENUMERATOR.sub(" § ", text.lower()))).split()
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    n = len(words)
    if not lines:
        return (None, len(text), n, 0, *[None] * len(STATISTICS))
    solid = sum(map(len, text.split())) or 1
    signs, odd = len(_SIGN.findall(text)) / solid, len(_ODD.findall(text)) / solid
    ended = sum(len(line) for line in lines if line.endswith(_ENDS)) / sum(map(len, lines))
    if not n:
        return (None, len(text), 0, len(lines), None, None, None, None, signs, ended, None, odd, 0.0, math.log(1 + len(lines)))
    flags = [_BITS.get(w, 0) for w in words]
    marks = "".join(["x" if f else "." for f in flags])
    kinds = Counter(flags)
    counts = [sum(c for f, c in kinds.items() if f >> i & 1) for i in range(len(LANGUAGES))]
    digits = sum(1 for w in words if not w.isalpha() and (w == "n/a" or any(map(str.isdigit, w))))
    changes = marks.count("x.") + marks.count(".x")
    variety = math.log(len(set(words))) / math.log(n) if n > 2 else 1.0
    return (
        LANGUAGES[counts.index(max(counts))],
        len(text),
        n,
        len(lines),
        (n - kinds[0]) / n,
        changes / max(n - 1, 1),
        math.log(sum(map(len, words)) / n),
        digits / n,
        signs,
        ended,
        variety,
        odd,
        math.log(1 + n),
        math.log(1 + len(lines)),
    )


STATISTICS_SCHEMA = "language string, n_chars int, n_words int, n_lines int, " + ", ".join(f"{s} double" for s in STATISTICS)


def text_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of each document: ``doc_id, language, n_chars, n_words, n_lines`` and the columns of ``STATISTICS``.

    ``function_share`` is the share of common function words among words and numbers, ``alternation`` that of
    neighbours of which exactly one is a function word, ``word_length`` the logarithm of the mean length,
    ``digit_share`` the share of tokens with a digit, ``symbol_share`` of signs other than usual punctuation,
    ``line_end_share`` of text in lines that end in punctuation, ``variety`` log(distinct words) / log(words),
    ``odd_share`` of characters typical of wrong decoding, ``length`` and ``lines`` the logarithms of one more than
    the words and lines. ``language`` is the one with most function words. One
    Arrow-batched pass over whole texts; nothing is shuffled. Defined cases: null, empty and blank texts have null language and statistics; texts of signs only lack those of words; repeated rows stay; only the named
    columns are read; an empty table gives no rows.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATISTICS_SCHEMA.split(", ")]
        for pdf in batches:
            out = pd.DataFrame([statistics_of(t) for t in pdf["_t"]], columns=names)
            for s in STATISTICS:
                out[s] = out[s].astype("float64")
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    kind = dict(documents.dtypes)[doc_id]
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).mapInPandas(measure, f"doc_id {kind}, {STATISTICS_SCHEMA}")


class Cloud:
    """Centre and inverse covariance of one language's prose."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray) -> None:
        slack = np.diag([SLACK[s] ** 2 for s in STATISTICS])
        self.mean, self.inverse = mean, np.linalg.inv(covariance + slack)


def distances(clouds: dict[str, Cloud], language: pd.Series, words: pd.Series, values: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and the contribution of every statistic, each text against its language's cloud (one matrix product per language)."""
    x = values.to_numpy(dtype="float64")
    x = np.where(np.isnan(x), 0.0, x)
    damp = (words / (words + DAMPING)).to_numpy()[:, None]
    parts = np.zeros_like(x)
    names = language.fillna("").where(language.isin([k for k in clouds if k]), "")
    for name, at in names.groupby(names).indices.items():
        z = (x[at] - clouds[name].mean) * damp[at]
        parts[at] = z * (z @ clouds[name].inverse)
    return parts.sum(axis=1), parts


def _measured(stats: DataFrame, clouds: dict[str, Cloud]) -> DataFrame:
    """``stats`` with ``distance`` and ``parts``."""

    @F.pandas_udf("distance double, parts array<double>")
    def measure(language: pd.Series, words: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        total, parts = distances(clouds, language, words, pd.concat(columns, axis=1))
        return pd.DataFrame({"distance": total, "parts": list(parts)})

    return stats.withColumn("_m", measure("language", "n_words", *STATISTICS)).select("*", "_m.distance", "_m.parts").drop("_m")


def _moments(stats: DataFrame, clouds: dict[str, Cloud]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of the inliers per language.

    Each batch gives its sums and sums of products, Spark adds them up, and a few hundred numbers reach the driver.
    """
    d = len(STATISTICS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = distances(clouds, pdf.language, pdf.n_words, pdf[list(STATISTICS)])[0] <= INLIER
            for name, part in pdf[near].groupby("language"):
                x = np.nan_to_num(part[list(STATISTICS)].to_numpy(dtype="float64"))
                flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield pd.DataFrame({"language": name, "pos": np.arange(len(flat)), "value": flat})

    rows = stats.where("language is not null").select("language", "n_words", *STATISTICS).mapInPandas(sums, "language string, pos int, value double")
    flat: dict[str, np.ndarray] = {}
    for r in rows.groupBy("language", "pos").agg(F.sum("value").alias("value")).collect():
        flat.setdefault(r.language, np.zeros(1 + d + d * d))[r.pos] = r.value
    if flat:
        flat[""] = np.sum(list(flat.values()), axis=0)
    got = {}
    for name, v in flat.items():
        mean = v[1 : d + 1] / v[0]
        got[name] = v[0], mean, v[d + 1 :].reshape(d, d) / v[0] - np.outer(mean, mean)
    return got


def prose_clouds(stats: DataFrame) -> dict[str, Cloud]:
    """Robust centre and covariance of prose per language, and pooled ones under ``""`` for languages with few texts.

    Start: medians and a spread from the quartiles of each language; then concentration steps on the inliers.
    """
    q = stats.where("language is not null").groupBy("language").agg(*[F.percentile_approx(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(s) for s in STATISTICS])
    clouds = {}
    for r in q.collect():
        quartiles = np.array([r[s] for s in STATISTICS])
        spread = (quartiles[:, 2] - quartiles[:, 0]) / 1.349
        clouds[r.language] = Cloud(quartiles[:, 1], np.diag(spread**2))
    if not clouds:
        return {"": Cloud(np.zeros(len(STATISTICS)), np.eye(len(STATISTICS)))}
    clouds[""] = Cloud(np.mean([c.mean for c in clouds.values()], axis=0), np.eye(len(STATISTICS)) * 0.01)
    for _ in range(STEPS):
        moments = _moments(stats, clouds)
        if "" not in moments:
            break
        pooled = Cloud(*moments[""][1:])
        clouds = {k: Cloud(m, c) if n >= LEAST_INLIERS else pooled for k, (n, m, c) in moments.items()} | {"": pooled}
    return clouds


def outlierness(documents: DataFrame) -> DataFrame:
    """Statistics of every document with ``distance`` (squared Mahalanobis distance from its language's prose) and
    ``contributions``, a map from statistic to its part of the distance (the parts add up to it).

    Blank and null texts have null distances, texts of signs only the greatest one. Whole texts and all documents
    take part.
    """
    stats = checkpointed(text_statistics(documents))
    out = _measured(stats, prose_clouds(stats))
    parts = F.map_from_arrays(F.array(*[F.lit(x) for x in STATISTICS]), F.col("parts"))
    said = F.col("n_lines") > 0
    distance = F.when(F.col("n_words") == 0, F.lit(1e9)).otherwise(F.col("distance"))
    return out.select(*stats.columns, F.when(said, distance).alias("distance"), F.when(said, parts).alias("contributions"))


def threshold(distances: DataFrame, labels: DataFrame) -> float:
    """Distance beyond which a document counts as no prose: the cut that agrees best with the raters' majority.

    All rated documents take part; they're counted by distance and cut into ranges of distances, and only a row per
    range reaches the driver. Cuts lie between different distances. Of equally good cuts the middle of the widest gap
    in log distance is taken (of the first of those); without usable ratings ``DEFAULT_THRESHOLD`` holds.
    """
    spark = distances.sparkSession
    votes = labels.where("form is not null and doc_id is not null").groupBy("doc_id").agg(F.avg((F.col("form") != "prose").cast("double")).alias("other")).where("other <> 0.5")
    rated = distances.select("doc_id", F.log(F.greatest("distance", F.lit(1e-3))).alias("x")).where("x is not null").join(broadcast_if_small(votes), "doc_id")
    counted = checkpointed(rated.groupBy("x").agg(F.count_if(F.col("other") > 0.5).alias("other"), F.count_if(F.col("other") < 0.5).alias("prose")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so a range keeps its number.
    cut = checkpointed(counted.repartitionByRange(ranges, "x").withColumn("range", F.spark_partition_id()))
    sums = cut.groupBy("range").agg(F.sum("other").alias("other"), F.sum("prose").alias("prose"), F.min("x").alias("first")).orderBy("range").collect()
    if not sum(r.other for r in sums) or not sum(r.prose for r in sums):
        return DEFAULT_THRESHOLD
    # Before each range: wrong are the prose from there on and the others up to there.
    starts, wrong = [], sum(r.prose for r in sums)
    for r, behind in zip(sums, [*sums[1:], None], strict=True):
        starts.append((r.range, wrong, behind and behind.first))
        wrong += r.other - r.prose
    up = Window.partitionBy("range").orderBy("x")
    placed = cut.join(F.broadcast(spark.createDataFrame(starts, "range int, start bigint, behind double")), "range")
    placed = placed.select((F.col("start") + F.sum(F.col("other") - F.col("prose")).over(up)).alias("wrong"), "x", F.coalesce(F.lead("x").over(up), "behind").alias("after"))
    best = placed.where("after is not null").agg(F.min(F.struct("wrong", (F.col("x") - F.col("after")).alias("gap"), "x", "after")).alias("b")).first().b
    return math.exp((best.x + best.after) / 2) if best else DEFAULT_THRESHOLD


def not_prose(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose text isn't blank and isn't prose for the greater part."""
    measured = outlierness(documents)
    return measured.where(F.col("distance") > threshold(measured, labels)).select("doc_id").distinct()
