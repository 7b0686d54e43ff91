"""Versioned tables, state, logs, snapshot JSON.

A store is a folder of immutable table versions and one small file per version that names its tables. A write makes
its tables first and then claims the next version number by renaming its file into place, which succeeds for one
writer only: readers see whole versions, and of two writers one gets ``ConcurrentWrite``. Everything goes through the
file system of the path, local or remote. Logs are appended as folders of Parquet; draining one names the folders it
took in the version that applied them, so each row is applied exactly once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, key string, name string, kind string, properties map<string,string>, aliases array<string>, confidence double, source_episode_ids array<string>, created_at string, updated_at string"
EDGE = "id string, key string, source_key string, relation string, target_key string, strength double, confidence double, stability string, ttl_days int, cardinality string, snippet string, evidence string, properties map<string,string>, source_episode_ids array<string>, created_at string, updated_at string"
EPISODE = "id string, summary string, importance double, tags array<string>, source_prompt_text string, created_at string"


def _fields(schema: str) -> str:
    """A column list as the fields of a struct."""
    return ", ".join(f"{name}: {kind}" for name, kind in (c.split(" ", 1) for c in schema.split(", ")))


SNAPSHOT = f"version int, nodes array<struct<{_fields(NODE)}>>, edges array<struct<{_fields(EDGE)}>>, episodes array<struct<{_fields(EPISODE)}>>, self_key string"
TABLES = ("nodes", "edges", "episodes")
META = "graph_id bigint, self_key string"
VECTORS = "graph_id bigint, key string, text string, vec array<float>, model_id string"
LOGS = {
    "reinforcement": "graph_id bigint, edge string, ts string",
    "reads": "ask string, graph_id bigint, event string, message_preview string, seeds array<string>, selected array<string>, fired map<string,double>, context_tokens_estimate int, ts string",
    "journal": "event string, graph_id bigint, detail map<string,string>, ts string",
    "model_calls": "purpose string, model string, prompt_sha256 string, prompt_chars int, response_chars int, latency_seconds double, error string, ts string",
}
SNAPSHOT_VERSION = 1


class IntegrityError(ValueError):
    """An edge's end is no node, or a key to be added exists."""


class ConcurrentWrite(RuntimeError):
    """Another writer has claimed the version that this one was based on."""


class Files:
    """Small files and folders on the file system that a path names."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        fs, p = self.at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, path: str, text: str) -> bool:
        """Writes a file that must not exist; False if it does. The file appears whole, by a rename."""
        fs, part = self.at(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), self.conf)
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(part), fs.makeQualified(self.at(path)[1]), none)
            return True
        except Exception as e:
            if self.exists(path):
                return False
            raise e
        finally:
            fs.delete(part, False)

    def delete(self, folder: str) -> None:
        fs, p = self.at(folder)
        fs.delete(p, True)


class GraphStore:
    """Nodes, edges, episodes, vectors, meta, state and logs of one or many graphs under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def version(self) -> int:
        """The current version, 0 for an empty store."""
        known = [n[:-5] for n in self.files.names(f"{self.root}/_versions") if n.endswith(".json")]
        return int(known[-1]) if known else 0

    def _described(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.root}/_versions/{version:012d}.json")) if version else {"tables": {}, "state": {}}

    def has(self, name: str) -> bool:
        return name in self._described(self.version())["tables"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._described(self.version())['tables'][name]}")

    def state(self) -> dict:
        """Small values of the current version, such as ``last_decay_at``; empty where nothing usable is stored."""
        return self._described(self.version())["state"]

    def meta(self) -> DataFrame:
        """``graph_id, self_key``."""
        return self.table("meta") if self.has("meta") else self.spark.createDataFrame([], META)

    def save(self, tables: dict[str, DataFrame], state: dict | None = None, base: int | None = None) -> int:
        """Writes tables as a new version upon ``base`` (the current one); tables not given stay as they are.

        On failure the old version stays current; ``ConcurrentWrite`` if another writer was faster.
        """
        base = self.version() if base is None else base
        old = self._described(base)
        new, folder = base + 1, f"data/v{base + 1}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        described = {"tables": old["tables"] | {name: f"{folder}/{name}" for name in tables}, "state": old["state"] | (state or {})}
        if not self.files.claim(f"{self.root}/_versions/{new:012d}.json", json.dumps(described)):
            self.files.delete(f"{self.root}/{folder}")
            raise ConcurrentWrite(f"version {new} was written by somebody else")
        return new

    def append(self, log: str, rows: DataFrame, ts: str | None = None) -> None:
        """Appends rows to a log of ``LOGS``; columns that are absent become null, ``ts`` is stamped where it's absent."""
        stamp = F.lit(ts) if ts else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        wanted = [c.split(" ", 1) for c in LOGS[log].replace("map<string, ", "map<string,").split(", ")]
        columns = [(F.coalesce(F.col(n).cast(k), stamp if n == "ts" else F.lit(None)) if n in rows.columns else stamp if n == "ts" else F.lit(None).cast(k)).alias(n) for n, k in wanted]
        rows.select(*columns).write.parquet(f"{self.root}/log/{log}/{time.time_ns():020d}-{uuid.uuid4().hex}")

    def pending(self, log: str) -> tuple[DataFrame, list[str]]:
        """Rows of a log that no version has applied, and the names of their folders (for ``drained`` in the state)."""
        done = set(self.state().get(f"drained_{log}", []))
        folders = [n for n in self.files.names(f"{self.root}/log/{log}") if n not in done and self.files.exists(f"{self.root}/log/{log}/{n}/_SUCCESS")]
        reader = self.spark.read.schema(LOGS[log])
        return (reader.parquet(*[f"{self.root}/log/{log}/{n}" for n in folders]) if folders else self.spark.createDataFrame([], LOGS[log])), folders

    def forget(self, log: str, folders: list[str]) -> None:
        """Removes drained folders; those left over by a crash are skipped, since the version that drained them names them."""
        for n in folders:
            self.files.delete(f"{self.root}/log/{log}/{n}")

    def save_vectors(self, vectors: DataFrame) -> int:
        """Stores the vector index (``VECTORS``) beside the tables."""
        return self.save({"vectors": vectors.select("graph_id", "key", "text", "vec", "model_id")})

    def vectors(self) -> DataFrame | None:
        return self.table("vectors") if self.has("vectors") else None


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``nodes, edges, episodes, meta`` of a snapshot file, with ``seq`` in file order; ends of edges are checked."""
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    out = {t: raw.select(F.posexplode(t).alias("seq", "r")).select("seq", "r.*") for t in TABLES}
    known = out["nodes"].select(F.col("key").alias("end"))
    ends = out["edges"].select(F.explode(F.array("source_key", "target_key")).alias("end"))
    lost = ends.join(known, "end", "left_anti").limit(1).collect()
    if lost:
        raise IntegrityError(f"edge end without node: {lost[0].end}")
    return out | {"meta": raw.select("version", "self_key")}


def snapshot_json(tables: dict[str, DataFrame], self_key: str | None = None) -> str:
    """One graph as snapshot JSON text on the driver; ``write_snapshots`` exports any number of graphs from the executors."""
    parts: dict = {"version": SNAPSHOT_VERSION}
    for t, schema in zip(TABLES, (NODE, EDGE, EPISODE), strict=True):
        names = [c.split()[0] for c in schema.split(", ")]
        order = "seq" if "seq" in tables[t].columns else "id"
        parts[t] = [json.loads(r.j) for r in tables[t].orderBy(order).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    return json.dumps(parts | {"self_key": self_key}, ensure_ascii=False)


def graph_snapshots(tables: dict[str, DataFrame], meta: DataFrame | None = None) -> DataFrame:
    """``graph_id, snapshot``: each graph as one JSON text, made on the executors (a graph is one file by contract)."""
    out = None
    for t, schema in zip(TABLES, (NODE, EDGE, EPISODE), strict=True):
        names = [c.split()[0] for c in schema.split(", ")]
        part = tables[t].groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("id", F.struct(*names).alias("r")))).alias(t))
        part = part.withColumn(t, F.transform(t, lambda x: x["r"]))
        out = part if out is None else out.join(part, "graph_id", "full_outer")
    out = out.join(meta, "graph_id", "left") if meta is not None else out.withColumn("self_key", F.lit(None).cast("string"))
    body = F.struct(F.lit(SNAPSHOT_VERSION).alias("version"), *[F.coalesce(t, F.array()).alias(t) for t in TABLES], "self_key")
    return out.select("graph_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("snapshot"))


def add_rows(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert that raises if a key exists already."""
    if not new.join(existing, key, "left_semi").isEmpty():
        raise IntegrityError("key exists")
    return existing.unionByName(new)


def upsert_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert of what is absent; existing rows stay unchanged."""
    return existing.unionByName(new.dropDuplicates(key).join(existing, key, "left_anti"))


def update_rows(existing: DataFrame, changes: DataFrame, key: list[str], now: str) -> DataFrame:
    """Takes over non-null columns of ``changes`` and stamps ``updated_at`` on the rows that change.

    Lists are united in order, maps merged with new values winning; other values are replaced. A change whose key
    doesn't exist, or a confidence outside 0 to 1, raises ``IntegrityError``.
    """
    if not changes.join(existing, key, "left_anti").isEmpty():
        raise IntegrityError("unknown key")
    if "confidence" in changes.columns and not changes.where("not confidence between 0 and 1").isEmpty():
        raise IntegrityError("confidence out of range")
    values, kinds = [c for c in changes.columns if c not in key], dict(existing.dtypes)
    renamed = changes.select(*key, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_hit"))
    j = existing.join(renamed, key, "left")

    def taken(c: str):
        old, new = F.col(c), F.col(f"_n_{c}")
        if kinds[c].startswith("array"):
            return F.when(new.isNull(), old).otherwise(F.array_distinct(F.concat(F.coalesce(old, F.array().cast(kinds[c])), new)))
        if kinds[c].startswith("map"):
            kept = F.map_filter(F.coalesce(old, F.create_map().cast(kinds[c])), lambda k, v: ~F.map_contains_key(new, k))
            return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))
        return F.coalesce(new, old)

    out = j.withColumns({c: taken(c) for c in values})
    if "updated_at" in existing.columns:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at")))
    return out.select(*existing.columns)


def append_events(df: DataFrame, path: str) -> None:
    """Appends events as JSON lines; ``ts`` is stamped where it's absent or null."""
    ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    stamped = df.withColumn("ts", F.coalesce("ts", ts)) if "ts" in df.columns else df.withColumn("ts", ts)
    stamped.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Logged events; a missing log is empty, blank lines are skipped."""
    if not Files(spark).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def load_or_rebuild(index: DataFrame | None, model_id: str, inputs: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored vectors if model and key set match, else vectors of all inputs."""
    if index is None:
        return embed(inputs)
    same_model = index.where(F.col("model_id") != model_id).isEmpty()
    keys, wanted = index.select("graph_id", "key").distinct(), inputs.select("graph_id", "key").distinct()
    if same_model and keys.exceptAll(wanted).isEmpty() and wanted.exceptAll(keys).isEmpty():
        return index
    return embed(inputs)


def synced_index(index: DataFrame, model_id: str, inputs: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keeps current keys, drops stale ones and embeds only what's missing; another model means a full rebuild."""
    if not index.where(F.col("model_id") != model_id).isEmpty():
        return embed(inputs)
    kept = index.join(inputs.select("graph_id", "key"), ["graph_id", "key"], "left_semi")
    missing = inputs.join(index.select("graph_id", "key"), ["graph_id", "key"], "left_anti")
    return kept.unionByName(embed(missing))
