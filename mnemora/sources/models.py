"""Injected model calls as Arrow-batched maps: retries with back-off, key rotation, audit rows, HTTP JSON, embedders."""

from __future__ import annotations

import hashlib
import itertools
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of error texts that mean a rate limit.
RATE_LIMIT_MARKS = ("429", "rate limit", "rate_limit", "resource_exhausted", "quota")
REPLY = "reply string, error string, prompt_sha256 string, prompt_chars int, response_chars int, latency_seconds double"


def is_rate_limit(error: BaseException) -> bool:
    return any(m in str(error).lower() for m in RATE_LIMIT_MARKS)


def endpoint(base: str, path: str) -> str:
    return base.rstrip("/") + "/" + path.lstrip("/")


def post_json(url: str, payload: dict, headers: dict[str, str] | None = None, timeout: float = 60.0) -> dict:
    """POST of JSON; anything but a JSON object in a 2xx reply raises ``RuntimeError``."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            body = json.loads(reply.read())
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.read()[:500]!r}") from e
    except (urllib.error.URLError, ValueError) as e:
        raise RuntimeError(f"no usable reply: {e}") from e
    if not isinstance(body, dict):
        raise RuntimeError("reply isn't a JSON object")
    return body


def with_retries(call: Callable[[str, str], str], keys: Sequence[str] = ("",), sweeps: int = 4, wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call(prompt, key)`` over rotating keys; after each sweep of rate limits the wait doubles; other errors raise."""
    turn = itertools.cycle(range(len(keys)))

    def run(prompt: str) -> str:
        last: Exception | None = None
        for sweep in range(sweeps):
            for _ in keys:
                try:
                    return call(prompt, keys[next(turn)])
                except Exception as e:
                    if not is_rate_limit(e):
                        raise
                    last = e
            if sweep < sweeps - 1:
                sleep(wait * 2**sweep)
        raise RuntimeError("rate limited on every key") from last

    return run


def generated(prompts: DataFrame, make_call: Callable[[], Callable[[str], str]], key: str = "batch_id", prompt: str = "prompt") -> DataFrame:
    """``key`` with reply, error and audit columns; ``make_call`` runs once per worker, failures are rows, not lost tasks."""
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_call()
        for pdf in batches:
            rows = []
            for name, text in zip(pdf[key], pdf[prompt], strict=True):
                text = text or ""
                began, reply, error = time.perf_counter(), None, None
                try:
                    reply = call(text)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"[:500]
                rows.append((name, reply, error, hashlib.sha256(text.encode()).hexdigest(), len(text), len(reply or ""), time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in REPLY.split(", "))])

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, {REPLY}")


def embedded(texts: DataFrame, make_embed: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], model_id: str, batch: int = 100) -> DataFrame:
    """``texts`` with ``vec`` (unit length) and ``model_id``; the model is loaded once per worker and fed batches of ``batch``."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make_embed()
        for s in parts:
            out: list = []
            for i in range(0, len(s), batch):
                piece = s.iloc[i : i + batch].fillna("").tolist()
                got = [list(map(float, v)) for v in embed(piece)]
                if len(got) != len(piece):
                    raise RuntimeError(f"{len(got)} vectors for {len(piece)} texts")
                for v in got:
                    norm = sum(x * x for x in v) ** 0.5 or 1.0
                    out.append([x / norm for x in v])
            yield pd.Series(out, index=s.index)

    return texts.withColumns({"vec": vectors("text"), "model_id": F.lit(model_id)})


def ordered_embeddings(reply: dict, expected: int) -> list[list[float]]:
    """Vectors of an embeddings reply in the order of their ``index``; a wrong count raises."""
    data = sorted(reply.get("data", []), key=lambda d: d["index"])
    if len(data) != expected:
        raise RuntimeError(f"{len(data)} vectors for {expected} texts")
    return [d["embedding"] for d in data]
