"""Deeply nested JSON documents as related flat tables, linked by interval containment.

Every JSON value becomes a node with a pre-order and a post-order number from one depth-first traversal. A node lies
inside another exactly if ``pre`` is greater and ``post`` smaller, so any ancestor-descendant link between the flat
tables is a comparison of two numbers, whatever the depth, and no parent keys need to be carried down. A document
arrives whole, so its links are found where it is walked and only the rows asked for leave the task.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "pre bigint, post bigint, level int, parent bigint, step string, pos bigint, kind string, value string"
CHILD_SCHEMA = "child string, pre bigint, post bigint, session_pre bigint, session_post bigint, session_pos bigint, child_pos bigint, alt_pos bigint, item string"
_FENCE = "```"
_BLANK = re.compile(r"[ \t\n\r]*")
_SAID = re.compile(r"[^\s﻿​]")


def _deep_json(text: str) -> object:
    """The JSON value in ``text``, by an explicit stack; ``ValueError`` if it isn't one complete value."""
    decoder = json.JSONDecoder()
    stack: list[tuple[dict | list, object]] = []
    key: object = None
    at = _BLANK.match(text).end()

    def member(at: int) -> tuple[object, int]:
        name, at = decoder.scan_once(text, at)
        at = _BLANK.match(text, at).end()
        if not isinstance(name, str) or text[at : at + 1] != ":":
            raise ValueError("no member name")
        return name, _BLANK.match(text, at + 1).end()

    try:
        while True:
            opened = text[at : at + 1]
            if opened in ("{", "["):
                value: object = {} if opened == "{" else []
                at = _BLANK.match(text, at + 1).end()
                if text[at : at + 1] != ("}" if opened == "{" else "]"):
                    stack.append((value, key))
                    if opened == "{":
                        key, at = member(at)
                    continue
                at += 1
            else:
                value, at = decoder.scan_once(text, at)
            while True:
                at = _BLANK.match(text, at).end()
                if not stack:
                    if at != len(text):
                        raise ValueError("text after the value")
                    return value
                holder, outer = stack[-1]
                if isinstance(holder, dict):
                    holder[key] = value
                else:
                    holder.append(value)
                mark, at = text[at : at + 1], _BLANK.match(text, at + 1).end() if at < len(text) else at
                if mark == ",":
                    if isinstance(holder, dict):
                        key, at = member(at)
                    break
                if mark != ("}" if isinstance(holder, dict) else "]"):
                    raise ValueError("no end of a value")
                stack.pop()
                value, key = holder, outer
    except StopIteration as e:
        raise ValueError("no value") from e


def read_json(text: str) -> object:
    """The JSON value in ``text``, however deep it nests; ``ValueError`` if it isn't one complete value."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep_json(text)


def unwrap_json(text: str | None) -> object | None:
    """The one complete JSON value in ``text``, or None.

    Wrappings that are undone, in any order and however often: a byte order mark, outer white space, a Markdown code
    fence with or without a language tag, and JSON encoded as a JSON string. Each makes the text shorter, so the loop
    ends. Cut or empty text gives None.
    """
    while isinstance(text, str):
        text = text.strip().lstrip("﻿").strip()
        if text.startswith(_FENCE):
            head, _, body = text[len(_FENCE) :].partition("\n")
            if not body:
                body, head = head, ""
            text = (body if head.strip().isalnum() or not head.strip() else head + "\n" + body).strip()
            if not text.endswith(_FENCE):
                return None
            text = text[: -len(_FENCE)].strip()
            continue
        try:
            text = read_json(text)
        except ValueError:
            return None
    return text


def _kind(node: object) -> str:
    """The JSON type of a decoded value."""
    if node is None:
        return "null"
    kinds = ((bool, "boolean"), (str, "string"), (dict, "object"), (list, "array"))
    return next((name for cls, name in kinds if isinstance(node, cls)), "number")


def sound_text(text: str) -> str:
    """``text`` unchanged if it can be stored as UTF-8; lone surrogates from JSON escapes become U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _walk(root: object) -> Iterator[tuple]:
    """``(pre, post, level, parent, step, pos, node, type)`` of every value below ``root``, in the order of ``post``.

    ``type`` numbers the values that are reached by the same steps (array steps count as one), from a trie of steps
    that grows with the document, never with its depth squared.
    """
    pre = post = 0
    trie: dict[tuple[int, str], int] = {}
    stack: list[list] = [[root, None, 0, 0, 0, -1, None]]  # node, children left, own pre, level, type, parent, place
    stack[0][6] = ("$", 0)
    while stack:
        top = stack[-1]
        node = top[0]
        if top[1] is None:
            top[2] = pre
            pre += 1
            top[1] = iter(node.items()) if isinstance(node, dict) else iter(enumerate(node)) if isinstance(node, list) else iter(())
        child = next(top[1], None)
        if child is not None:
            step, pos = (child[0], 0) if isinstance(node, dict) else ("[]", child[0])
            # A field that is named "[]" is no array step.
            kind = trie.setdefault((top[4], step if isinstance(node, list) else "." + step), len(trie) + 1)
            stack.append([child[1], None, 0, top[3] + 1, kind, top[2], (step, pos)])
            continue
        stack.pop()
        yield top[2], post, top[3], top[5], top[6][0], top[6][1], node, top[4]
        post += 1
    yield trie


def interval_nodes(root: object) -> Iterator[tuple]:
    """``(pre, post, level, parent, step, pos, kind, value)`` of every value below ``root``, by an iterative depth-first walk.

    ``parent`` is the ``pre`` of the enclosing value (-1 for the root), ``step`` the field name, ``[]`` inside an array
    or ``$`` for the root; ``pos`` is the place in the enclosing array, 0 for a value that isn't in one. Scalars carry
    their text (strings decoded and unchanged).
    """
    for n in _walk(root):
        if isinstance(n, tuple):
            node = n[6]
            kind = _kind(node)
            yield *n[:4], sound_text(n[4]), n[5], kind, sound_text(node) if kind == "string" else json.dumps(node) if kind in ("number", "boolean") else None


def _table(df: DataFrame, payload: str, keys: list[str], schema: str, rows: Callable[[dict], Iterator[tuple]], required_root: str) -> DataFrame:
    """``rows`` of every payload that is one complete JSON object with the field ``required_root``, behind ``keys`` and ``doc``."""
    kinds = dict(df.dtypes)
    columns = [*keys, "doc", *(c.split()[0] for c in schema.split(", "))]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *own, doc, text in pdf.itertuples(index=False, name=None):
                root = unwrap_json(text)
                if isinstance(root, dict) and required_root in root:
                    for r in rows(root):
                        out.append((*own, doc, *r))
                        if len(out) == 20_000:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
            yield pd.DataFrame(out, columns=columns)

    docs = df.where(F.col(payload).isNotNull()).select(*keys, F.md5(payload).alias("_doc"), F.col(payload).alias("_payload"))
    return docs.mapInPandas(walk, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "doc string", schema]))


def interval_table(df: DataFrame, payload: str, keys: list[str], required_root: str = "sessions") -> DataFrame:
    """Node table of all JSON documents in column ``payload``: ``keys``, ``doc`` (a digest of the text) and the node columns.

    A payload that isn't one complete JSON object with the field ``required_root`` gives no rows, and neither do null
    or empty ones. Identical copies of a payload under the same keys give one set of rows. Names of other columns
    can't clash: only ``keys`` and ``payload`` are read.
    """
    return _table(df, payload, keys, NODE_SCHEMA, interval_nodes, required_root).dropDuplicates([*keys, "doc", "pre"])


def campaign_nodes(campaigns: DataFrame) -> DataFrame:
    """Interval-labelled nodes of all campaign payloads (see ``interval_table``)."""
    return interval_table(campaigns, "payload", ["campaign_id"])


class _Containers:
    """Values of one type that never overlap: the only one that may hold a node is the last before it in pre-order."""

    def __init__(self, found: list[tuple]) -> None:
        self.found = sorted(found)
        self.pre = [c[0] for c in self.found]

    def around(self, pre: int, post: int) -> tuple | None:
        k = bisect_left(self.pre, pre) - 1
        return self.found[k] if k >= 0 and self.found[k][1] > post else None


def session_rows(root: dict) -> Iterator[tuple]:
    """Sessions and their flat child rows (``CHILD_SCHEMA``) of one campaign, linked by interval containment.

    Positions count from 0 in the arrays as sent; a lone value in place of an array has position 0. A child that lies
    in no session, and a text or query outside a turn or probe object, gives nothing.
    """
    *nodes, trie = _walk(root)

    def types(*paths: tuple[str, ...]) -> set[int]:
        out = set()
        for path in paths:
            at: int | None = 0
            for step in path:
                at = trie.get((at, step)) if at is not None else None
            out.add(at)
        return out - {None}

    base = ((".sessions",), (".sessions", "[]"))
    below = lambda *ways: types(*((*b, *w) for b in base for w in ways))
    either = lambda array, *more: ((array, *more), (array, "[]", *more))
    terms = (".expect_graph", ".has_node_any")
    is_session, is_item, is_inner = types(*base), below(*either(".turns"), *either(".probes")), below((*terms, "[]"))
    child = dict.fromkeys(below(*either(".turns", ".text")), "turn") | dict.fromkeys(below(*either(".probes", ".query")), "probe") | dict.fromkeys(below(terms, (*terms, "[]"), (*terms, "[]", "[]")), "node_any")
    sessions = _Containers([(n[0], n[1], n[5]) for n in nodes if n[7] in is_session and isinstance(n[6], dict)])
    holders = _Containers([(n[0], n[1], n[5]) for n in nodes if n[7] in is_item and isinstance(n[6], dict) or n[7] in is_inner and isinstance(n[6], list)])
    for pre, post, pos in sessions.found:
        yield "session", pre, post, pre, post, pos, pos, 0, None
    for pre, post, _, _, _, pos, node, kind in nodes:
        name = child.get(kind)
        if name is None or not isinstance(node, str) or not _SAID.search(node):
            continue
        session, holder = sessions.around(pre, post), holders.around(pre, post)
        if session is None or holder is None and name != "node_any":
            continue
        yield name, pre, post, *session, holder[2] if holder else pos, pos if holder and name == "node_any" else 0, sound_text(node)


def campaign_rows(campaigns: DataFrame) -> DataFrame:
    """``campaign_id, doc`` and ``CHILD_SCHEMA`` of all campaigns: sessions, turn texts, probe queries, wanted node terms."""
    return _table(campaigns, "payload", ["campaign_id"], CHILD_SCHEMA, session_rows, "sessions")


def campaign_tables(campaigns: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables ``node`` (every value), ``session``, ``turn``, ``probe`` and ``node_any`` of nested payloads."""
    rows = campaign_rows(campaigns).dropDuplicates(["campaign_id", "doc", "pre"])
    sessions = rows.where("child = 'session'").select("campaign_id", "doc", "pre", "post", "session_pos")
    children = rows.drop("pre", "post")
    return {"node": campaign_nodes(campaigns), "session": sessions} | {c: children.where(F.col("child") == c) for c in ("turn", "probe", "node_any")}


def campaign_items(campaigns: DataFrame) -> DataFrame:
    """Turn texts, probe queries and wanted node terms of every campaign as one table with their places.

    Returns distinct ``(campaign_id, session_pos, child, child_pos, alt_pos, item)``. Null, absent or blank texts,
    values that aren't strings and payloads that aren't one complete JSON campaign give nothing; repeated payloads
    count once; an empty table gives no rows.
    """
    return campaign_rows(campaigns).where("child <> 'session'").select("campaign_id", "session_pos", "child", "child_pos", "alt_pos", "item").distinct()
