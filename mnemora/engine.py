"""The facade: read, write, extraction sessions, retrieve_memory and decay over a versioned store.

Model calls are injected. ``extract`` maps prompts (``batch_id, prompt``) to replies (``batch_id, reply``);
``disambiguate`` maps review rows with a ``prompt`` to replies (``graph_id, entity, candidates, reply``) or to scored
candidates (``graph_id, entity, key, confidence``); ``supersede`` adds a ``reply`` or a ``decision`` to candidate
pairs, or keeps those that replace the old edge. Offline defaults: nothing is extracted, reviews become new entities,
old and new edges coexist.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import config
from mnemora.config import RetrievalConfig
from mnemora.functions import text as T
from mnemora.operators import agentic as A
from mnemora.operators import consolidate as C
from mnemora.operators import graph as Gr
from mnemora.operators import resolve as R
from mnemora.operators import retrieve as Re
from mnemora.runtime import checkpointed, instant
from mnemora.sources.store import GraphStore

G = "graph_id"
Model = Callable[[DataFrame], DataFrame]
#: Summary of an episode whose session hasn't finished, and of one that ended without.
PENDING, UNFINISHED = "(pending)", "(ended without a summary)"
SESSIONS = "session_id string, graph_id bigint, episode_id string, started_at string, calls int, finished boolean, touched array<string>"


def no_extraction(prompts: DataFrame) -> DataFrame:
    return prompts.select("batch_id", F.lit('{"entities": [], "relationships": []}').alias("reply"))


@dataclass
class MemoryEngine:
    """Batch-first memory: every call takes any number of messages, conversations or names of any number of graphs."""

    store: GraphStore
    extract: Model = no_extraction
    disambiguate: Model | None = None
    supersede: Model | None = None
    cfg: RetrievalConfig = field(default_factory=RetrievalConfig)
    prompt: str = "Known so far:\n{context}\n\nConversation:\n{conversation}\n"
    user_only: bool = False
    #: What the last write flagged and warned of (``graph_id, note`` and ``graph_id, warning``).
    flagged: DataFrame | None = None
    warnings: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.store.table("nodes"), self.store.table("edges"), self.store.table("episodes")

    def read(self, messages: DataFrame, log: bool = True) -> dict[str, DataFrame]:
        """Context of messages (``ask, graph_id, message``); also ``traversed`` (reinforcement rows), ``trace`` and ``injections``.

        Nothing in the graph changes: traversed edges and the trace are logged (unless ``log`` is off), and the next
        write applies the traversals.
        """
        nodes, edges, _ = self._tables()
        got = Re.read(messages, nodes, edges, self.cfg)
        got["traversed"] = Re.traversed(got["activations"], Gr.one_per_id(edges), self.cfg)
        got["trace"] = Re.read_trace_rows(messages, got, self.cfg)
        if log:
            self.store.append("reinforcement", got["traversed"])
            self.store.append("reads", got["trace"])
        return got

    def last_reads(self) -> DataFrame:
        """The latest logged read of each graph."""
        reads, _ = self.store.pending("reads")
        return reads.groupBy(G).agg(F.max_by(F.struct(*reads.columns), "ts").alias("r")).select("r.*")

    def retrieve_memory(self, names: DataFrame, depth: int = 2) -> dict[str, DataFrame]:
        nodes, edges, episodes = self._tables()
        return Re.retrieve_memory(names, Gr.one_per_key(nodes), Gr.one_per_id(edges), episodes, depth)

    def contexts(self, conversations: DataFrame, depth: int = 2) -> DataFrame:
        """``batch_id, context``: the rendered graph near what a whole conversation (``batch_id, graph_id, conversation``) speaks of."""
        nodes, edges, _ = self._tables()
        nodes, edges = Gr.one_per_key(nodes), Gr.one_per_id(edges)
        asks = conversations.select(F.col("batch_id").alias("ask"), G, F.col("conversation").alias("message"))
        nouns = Re.message_nouns(asks)
        hits = Re.gated(Re.noun_hits(nouns, C.index_inputs(nodes, edges), self.cfg), self.cfg, margin=False)
        seeds = nouns.join(Re.seed_keys(hits, nodes, edges), [G, "noun"]).select("ask", G, "key").distinct()
        near = Gr.neighbourhood(seeds, edges, nodes, depth)
        return Gr.rendered(near, nodes, edges).select(F.col("ask").alias("batch_id"), F.col("text").alias("context"))

    def _spoken(self, conversations: DataFrame) -> DataFrame:
        """Conversations with ``conversation`` (all turns) and ``extracted`` (what extraction reads, as JSON lines)."""
        if "turns" not in conversations.columns:
            return conversations.withColumn("extracted", F.col("conversation"))
        kept = F.filter("turns", lambda t: t["role"] == "user") if self.user_only else F.col("turns")
        text = F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))), " ")
        return conversations.withColumns({"conversation": text, "extracted": F.array_join(F.transform(kept, lambda t: F.to_json(t)), "\n")}).drop("turns")

    def _prompts(self, conversations: DataFrame) -> DataFrame:
        known = self.contexts(conversations)
        return conversations.join(known, "batch_id", "left").select("batch_id", T.filled_prompt(self.prompt, F.col("context"), F.col("extracted")).alias("prompt"))

    def _self_keys(self, edges: DataFrame) -> DataFrame:
        return C.sticky_self(self.store.meta(), C.first_edge_self(edges))

    def _commit(self, base: int, out: dict[str, DataFrame], now: str, notes: list[DataFrame], extra: dict[str, DataFrame], drained: list[str], event: str = "write") -> DataFrame:
        """Stores one write and its journal: a row of counters per graph, and one per note, flag and warning."""
        counters, warnings = checkpointed(out["counters"]), checkpointed(out["warnings"].distinct())
        flags = out["flagged"].select(G, F.create_map(F.lit("edge"), "edge", F.lit("superseded_by"), "superseded_by", F.lit("kind"), F.lit("contradiction"), F.lit("reason"), "reason").alias("note"))
        flagged = checkpointed(flags.unionByName(notes[1]))
        self.store.save({"nodes": out["nodes"], "edges": out["edges"]} | extra, {"drained_reinforcement": drained}, base)
        self.store.forget("reinforcement", drained)
        numbers = F.map_from_arrays(F.array(*[F.lit(c) for c in counters.columns if c != G]), F.array(*[F.col(c).cast("string") for c in counters.columns if c != G]))
        rows = counters.select(F.lit(event).alias("event"), G, numbers.alias("detail"))
        for kind, part in (("merge_note", notes[0]), ("flagged", flagged)):
            rows = rows.unionByName(part.select(F.lit(kind).alias("event"), G, F.col("note").alias("detail")))
        rows = rows.unionByName(warnings.select(F.lit("warning").alias("event"), G, F.create_map(F.lit("warning"), F.col("warning")).alias("detail")))
        self.store.append("journal", rows, now)
        self.flagged, self.warnings = flagged, warnings
        return counters

    def write(self, conversations: DataFrame, now: str, reinforcement: DataFrame | None = None) -> DataFrame:
        """Extracts, resolves, merges and stores conversations; returns counters per graph.

        ``conversations`` has ``batch_id, graph_id`` and ``conversation``, or ``turns`` (an array of ``role, text``).
        Order: nodes, edges, supersessions, read reinforcement (the log since the last write, unless given); nothing
        is ever deleted. Entities are resolved against the graph before the write; equal keys meet in it.
        """
        base = self.store.version()
        nodes, edges, episodes = self._tables()
        nodes, edges = checkpointed(Gr.one_per_key(nodes)), checkpointed(Gr.first_per_key(edges))
        conversations = checkpointed(self._spoken(conversations))
        # Model calls run once: their replies are written down before anything reads them.
        replies = self.extract(self._prompts(conversations))
        owner = conversations.select("batch_id", G, F.substring("conversation", 1, 2000).alias("context"))
        payloads = checkpointed(C.parsed_payloads(replies).join(owner.drop("context"), "batch_id"))
        entities, bad_entities = C.payload_entities(payloads)
        staged_edges, made, bad_edges = C.payload_edges(payloads, entities, C.known_forms(nodes))
        none = F.array().cast("array<string>")
        stand_ins = made.select("batch_id", F.lit(1 << 20).alias("seq"), "text", F.lit("OTHER").alias("kind"), "confidence", none.alias("aliases"), "properties", F.lit(None).cast("string").alias("hint"), "key")
        staged = checkpointed(entities.select("batch_id", "seq", "text", "kind", "confidence", "aliases", "properties", "hint", "key").unionByName(stand_ins).join(owner, "batch_id"))
        asked = staged.groupBy(G, F.col("key").alias("entity")).agg(F.min_by(F.struct(F.col("text").alias("name"), "kind", "aliases", "properties", "context"), F.struct("batch_id", "seq")).alias("f"), F.max_by("hint", F.struct(F.col("hint").isNotNull(), "batch_id", "seq")).alias("hint")).select(G, "entity", "f.*", "hint")
        remap, notes, merge_flags = A.merge_plan(asked, nodes, edges, self._self_keys(edges), self.disambiguate)
        remap = remap.select(G, F.col("entity").alias("old_key"), F.col("target_key").alias("new_key"))
        seq, episode = F.struct("batch_id", "seq").alias("seq"), F.array("batch_id").alias("source_episode_ids")
        final = staged.join(remap.withColumnRenamed("old_key", "key"), [G, "key"], "left").select(G, F.coalesce("new_key", "key").alias("key"), seq, F.col("text").alias("name"), "kind", "aliases", "confidence", "properties", episode)
        new_edges = checkpointed(R.remapped(staged_edges, remap).withColumns({"seq": seq, "source_episode_ids": episode}))
        known = nodes.select(G, "key").unionByName(final.select(G, "key"))
        decided = A.replacements(new_edges, edges, nodes, known, self.supersede)
        log, drained = (reinforcement, []) if reinforcement is not None else self.store.pending("reinforcement")
        out = C.apply_write(nodes, edges, final, new_edges, decided, log.select(G, "edge"), now)
        told = C.payload_episodes(payloads).join(conversations, "batch_id").select(G, F.col("batch_id").alias("id"), "summary", "importance", "tags", F.col("conversation").alias("source_prompt_text"), F.lit(now).alias("created_at"))
        inferred = new_edges.groupBy(G).agg(F.min_by("source_key", "seq").alias("self_key"))
        said = C.payload_warnings(payloads, bad_entities, bad_edges, made).join(owner.drop("context"), "batch_id").select(G, "warning")
        out["warnings"] = out["warnings"].unionByName(said)
        kept = episodes.select(G, "id", "summary", "importance", "tags", "source_prompt_text", "created_at")
        return self._commit(base, out, now, [notes, merge_flags], {"episodes": kept.unionByName(told), "meta": C.sticky_self(self._self_keys(edges), inferred)}, drained)

    # Extraction sessions: a model drives them with tool calls, each of which is written at once.

    def _sessions(self) -> DataFrame:
        return self.store.table("sessions") if self.store.has("sessions") else self.spark.createDataFrame([], SESSIONS)

    def start_sessions(self, conversations: DataFrame, now: str) -> DataFrame:
        """Opens a session per conversation (``batch_id`` names it); returns ``session_id, prompt``."""
        base = self.store.version()
        self.sweep_sessions(now)
        conversations = checkpointed(self._spoken(conversations))
        prompts = checkpointed(self._prompts(conversations).withColumnRenamed("batch_id", "session_id"))
        new = conversations.select(F.col("batch_id").alias("session_id"), G, F.col("batch_id").alias("episode_id"), F.lit(now).alias("started_at"), F.lit(0).alias("calls"), F.lit(False).alias("finished"), F.array().cast("array<string>").alias("touched"))
        episodes = self.store.table("episodes")
        opened = conversations.select(G, F.col("batch_id").alias("id"), F.lit(PENDING).alias("summary"), F.lit(0.3).alias("importance"), F.array().cast("array<string>").alias("tags"), F.col("conversation").alias("source_prompt_text"), F.lit(now).alias("created_at"))
        self.store.save({"sessions": checkpointed(self._sessions()).unionByName(new), "episodes": checkpointed(episodes).select(*opened.columns).unionByName(opened)}, base=max(base, self.store.version()))
        return prompts

    def apply_calls(self, calls: DataFrame, now: str) -> DataFrame:
        """Applies tool calls (``session_id, ord, tool, arguments``) in order; returns ``session_id, ord, result, finished``.

        A session ends by ``finish_extraction`` or at its call cap; calls of an unknown or ended session change
        nothing. Every call is written when it's applied, so an interrupted session loses nothing.
        """
        self.sweep_sessions(now)
        calls = checkpointed(calls.withColumn("turn", F.row_number().over(Re.Window.partitionBy("session_id").orderBy("ord"))))
        rounds = calls.agg(F.max("turn")).first()[0] or 0
        results = None
        for turn in range(1, rounds + 1):
            base = self.store.version()
            nodes, edges, episodes = self._tables()
            nodes, edges = checkpointed(Gr.one_per_key(nodes)), checkpointed(Gr.first_per_key(edges))
            sessions = checkpointed(self._sessions())
            mine = calls.where(F.col("turn") == turn)
            live = checkpointed(mine.join(sessions.where("not finished").select("session_id", G, "episode_id", F.col("calls").alias("before")), "session_id"))
            out = A.apply_round(live.select("session_id", G, "episode_id", "tool", "arguments"), nodes, edges, self._self_keys(edges), now, self.disambiguate, self.supersede)
            told = checkpointed(out["results"])
            ended = live.select("session_id", ((F.col("tool") == "finish_extraction") & F.try_parse_json("arguments").isNotNull() | (F.col("before") + 1 >= config.SESSION_MAX_CALLS)).alias("ends"))
            after = sessions.join(ended, "session_id", "left").join(told.select("session_id", F.col("touched").alias("_t")), "session_id", "left")
            after = after.withColumns({"calls": F.col("calls") + F.when(F.col("ends").isNotNull(), 1).otherwise(0), "finished": F.col("finished") | F.coalesce("ends", F.lit(False)), "touched": F.array_union("touched", F.array_compact(F.array("_t")))}).select(*sessions.columns)
            given = F.from_json("arguments", A.FINISH_ARGUMENTS)
            finish = live.where("tool = 'finish_extraction'").select(G, F.col("episode_id").alias("id"), F.nullif(F.btrim(given["summary"]), F.lit("")).alias("_s"), given["importance"].alias("_i"), T.clean_list(given["tags"], 5).alias("_g"), F.lit(True).alias("_f"))
            closed = live.join(ended.where("ends"), "session_id", "left_semi").select(G, F.col("episode_id").alias("id"), F.lit(True).alias("_c"))
            stored = episodes.join(finish, [G, "id"], "left").join(closed, [G, "id"], "left")
            summary = F.coalesce("_s", F.when(F.col("_c") & (F.col("summary") == PENDING), UNFINISHED), "summary")
            importance = F.when(F.col("_f"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_i").try_cast("double"))), "importance")).otherwise(F.col("importance"))
            stored = stored.withColumns({"summary": summary, "importance": importance, "tags": F.when(F.col("_f"), F.col("_g")).otherwise(F.col("tags"))}).select(*episodes.columns)
            # An entity is an orphan only if its session ends and it still has no edge.
            over = after.join(ended.where("ends"), "session_id", "left_semi").select(G, F.explode("touched").alias("key")).distinct()
            alone = C.orphans(over, out["edges"]).select(G, F.concat(F.lit("orphan "), "key").alias("warning"))
            out["warnings"] = out["warnings"].where(~F.startswith("warning", F.lit("orphan "))).unionByName(alone)
            drained: list[str] = []
            if not ended.where("ends").isEmpty():
                log, drained = self.store.pending("reinforcement")
                out["edges"] = C.reinforce(out["edges"], log, now)
            self._commit(base, out, now, [out["notes"], out["merge_flags"]], {"episodes": stored, "sessions": after, "meta": self._self_keys(out["edges"])}, drained, "tool_calls")
            late = mine.join(live.select("session_id"), "session_id", "left_anti").select("session_id", "ord", F.lit("error: unknown or finished session").alias("result"), F.lit(True).alias("finished"))
            part = checkpointed(mine.select("session_id", "ord").join(told.select("session_id", "result"), "session_id").join(ended, "session_id").select("session_id", "ord", "result", F.col("ends").alias("finished")).unionByName(late))
            results = part if results is None else results.unionByName(part)
        return results if results is not None else self.spark.createDataFrame([], "session_id string, ord int, result string, finished boolean")

    def sweep_sessions(self, now: str) -> None:
        """Ends sessions that started more than half an hour ago; what they wrote stays, their episode is closed."""
        if not self.store.has("sessions"):
            return
        sessions, episodes = self._sessions(), self.store.table("episodes")
        age = F.unix_micros(instant(F.lit(now))) - F.unix_micros(instant("started_at"))
        stale = ~F.col("finished") & (age > config.SESSION_MAX_MINUTES * 60_000_000)
        gone = checkpointed(sessions.where(stale))
        if gone.isEmpty():
            return
        closed = episodes.join(gone.select(G, F.col("episode_id").alias("id"), F.lit(True).alias("_c")), [G, "id"], "left")
        closed = closed.withColumn("summary", F.when(F.col("_c") & (F.col("summary") == PENDING), UNFINISHED).otherwise(F.col("summary"))).select(*episodes.columns)
        self.store.save({"sessions": sessions.withColumn("finished", F.col("finished") | stale), "episodes": closed})
        self.store.append("journal", gone.select(F.lit("warning").alias("event"), G, F.create_map(F.lit("warning"), F.concat(F.lit("session expired: "), "session_id")).alias("detail")), now)

    def decay(self, now: str, last: str | None = None, force: bool = False) -> DataFrame | None:
        """Decays all edges to ``now`` unless the last decay (stored, or given) is less than a day old; returns counters per graph."""
        last = last or self.store.state().get("last_decay_at")
        due = self.spark.range(1).select(C.decay_due(instant(F.lit(last)), instant(F.lit(now)), force).alias("d")).first().d
        if not due:
            return None
        base = self.store.version()
        edges = self.store.table("edges")
        out = checkpointed(C.decay_edges(edges, now))
        counters = checkpointed(out.groupBy(G).agg(F.count_if("decayed").alias("edges_decayed"), F.count_if("dormant").alias("edges_dormant")))
        kept = out.withColumn("updated_at", F.when(F.col("decayed"), F.lit(now)).otherwise(F.col("updated_at"))).select(*edges.columns)
        self.store.save({"edges": kept}, {"last_decay_at": now}, base)
        detail = F.create_map(F.lit("edges_decayed"), F.col("edges_decayed").cast("string"), F.lit("edges_dormant"), F.col("edges_dormant").cast("string"), F.lit("dormant_below"), F.lit(str(config.DORMANT_BELOW)))
        self.store.append("journal", counters.select(F.lit("decay").alias("event"), G, detail.alias("detail")), now)
        return counters

    def graph(self, now: str) -> DataFrame:
        """Edges with strengths as of ``now``, without storing them."""
        return C.decay_edges(Gr.one_per_id(self.store.table("edges")), now)

    def health(self) -> DataFrame:
        nodes, edges, episodes = self._tables()
        count = lambda df, name: df.groupBy(G).agg(F.count(F.lit(1)).alias(name))
        return count(nodes, "nodes").join(count(edges, "edges"), G, "full_outer").join(count(episodes, "episodes"), G, "full_outer").na.fill(0)


def tools() -> str:
    """The session tools as JSON for a chat model."""
    return json.dumps(A.tool_schemas())


__all__ = ["MemoryEngine", "no_extraction", "tools"]
