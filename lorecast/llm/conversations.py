"""Conversations rebuilt from message rows: Kahn's algorithm over reply graphs, then checks of alternation and completeness.

All rows are sorted by conversation and time over range partitions, so a conversation of any length is spread over as many
tasks as its rows need. Within a task a conversation is ordered in slices: every edge of a valid reply graph leads forward in
time, so the slices' orders follow one another. What a task sees whole it judges at once; of conversations that are cut, only
a row per slice comes together, with the roles at the cuts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions.keys import is_blank, key
from lorecast.functions.roles import ROLES, readable_role  # noqa: F401
from lorecast.operators.skew import salted_join
from lorecast.session import write_shared

#: A task orders at most so many rows of a conversation at a time.
SLICE_ROWS = 100_000
_RANK = {"system": 0, "user": 1, "assistant": 2}


def message_rows(messages: DataFrame, content: bool, reply_to: str | None = None) -> DataFrame:
    """conversation_id, at (microseconds), role (null if unreadable), rank, raw, sign[, content][, id, parent, parent_at] of each row.

    ``sign`` is the content's digest, null if it is blank. ``raw`` keeps the spelling of unreadable roles. ``parent`` is the
    row that ``reply_to`` names, or the first of its copies.
    """
    blank = is_blank(F.col("content"))
    role = readable_role(F.col("role"))
    rank = F.when(role == "system", 0).when(role == "user", 1).when(role == "assistant", 2)
    kept = lambda c: F.when(~blank, c)  # noqa: E731 - of a blank row only the conversation counts
    rows = messages.select(
        key("conversation_id").alias("conversation_id"), kept(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("at"), kept(role).alias("role"), kept(rank).alias("rank"),
        kept(F.when(role.isNull(), F.lower(F.trim("role")))).alias("raw"), kept(F.md5("content")).alias("sign"),
        *([kept(F.col("content")).alias("content")] if content else []), *([key("id").alias("id"), key(reply_to).alias("parent")] if reply_to else []),
    ).where(F.col("conversation_id").isNotNull())
    if not reply_to:
        return rows
    rows = rows.withColumn("first", F.min("id").over(Window.partitionBy("conversation_id", "at", "role", "raw", "sign")))
    named = rows.where("sign is not null").select("conversation_id", F.col("id").alias("parent"), F.col("first").alias("answered"), F.col("at").alias("parent_at")).dropna(subset=["parent"]).dropDuplicates(["conversation_id", "parent"])
    found = salted_join(rows, named, ["conversation_id", "parent"], "left", F.col("id"))
    return found.withColumn("parent", F.coalesce("answered", "parent")).drop("answered", "first")


def topological_order(nodes: list[tuple], edges: dict[int, list[int]]) -> list[int]:
    """Kahn's algorithm: of the nodes without open edges always the least by its tuple is next. Nodes on or after a cycle are left over."""
    open_edges = [0] * len(nodes)
    for targets in edges.values():
        for t in targets:
            open_edges[t] += 1
    ready = [(nodes[i], i) for i, n in enumerate(open_edges) if not n]
    heapq.heapify(ready)
    order = []
    while ready:
        _, i = heapq.heappop(ready)
        order.append(i)
        for t in edges.get(i, ()):
            open_edges[t] -= 1
            if not open_edges[t]:
                heapq.heappush(ready, (nodes[t], t))
    return order


def reply_graph(times: list, roles: list, parents: list | None, ids: list | None) -> tuple[list[tuple], dict[int, list[int]]]:
    """Nodes (time, role rank, number) of the rows with a time and a role, and the edges from what is answered to the answer.

    With given parents these are the edges. Else a turn answers what came last before it: every row of the time before, and
    for an assistant also the users of its own time, leads to it (through one join node per time, so edges stay few).
    """
    nodes = [(t, _RANK[r], i) for i, (t, r) in enumerate(zip(times, roles))]
    edges: dict[int, list[int]] = {}
    if parents is not None:
        at = {m: i for i, m in enumerate(ids)}
        for i, p in enumerate(parents):
            if p in at:
                edges.setdefault(at[p], []).append(i)
        return nodes, edges
    levels: dict[tuple, list[int]] = {}
    for i, n in enumerate(nodes):
        levels.setdefault(n[:2], []).append(i)
    before = None
    for level in sorted(levels):
        if before is not None:
            joint = len(nodes)
            nodes.append((before[0], before[1], joint))
            for i in levels[before]:
                edges.setdefault(i, []).append(joint)
            edges[joint] = levels[level]
        before = level
    return nodes, edges


class _Slice:
    """Rows of one conversation in order of time, ordered as a graph and summed up."""

    def __init__(self, rows: list[tuple], linked: bool):
        good = [r for r in rows if r[2] is not None and r[1] is not None]
        self.size = len(good)
        fault = len(good) < len(rows)
        if linked:  # an answer to nothing or to a later row
            early = [r for r in good if not (r[-2] is not None and (r[-1] is None or r[-1] > r[1]))]
            fault, good = fault or len(early) < len(good), early
        nodes, edges = reply_graph([r[1] for r in good], [r[2] for r in good], [r[-2] for r in good] if linked else None, [r[-3] for r in good] if linked else None)
        self.order = [good[i] for i in topological_order(nodes, edges) if i < len(good)]
        self.left_over = len(good) - len(self.order)  # on or after a cycle
        self.fault = fault or self.left_over > 0
        self.bare = all(r[2] == "system" for r in rows)
        turns = [r[2] for r in self.order if r[2] != "system"]
        self.turns, self.opens, self.ends = len(turns), turns[0] if turns else None, turns[-1] if turns else None
        self.twice = any(b == "assistant" and a != "user" for a, b in zip(turns, turns[1:]))
        self.unanswered = any(a == "user" and b != "assistant" for a, b in zip(turns, turns[1:]))

    def reason(self) -> str | None:
        """Why a conversation that is this slice is dropped."""
        if self.bare:
            return "empty"
        if self.fault or self.twice or self.opens == "assistant":
            return "broken"
        return "missing_reply" if self.unanswered or self.ends == "user" else None


_FACTS = ("fault", "bare", "turns", "twice", "unanswered", "opens", "ends", "size", "left_over")
_ROW = pa.schema([
    ("conversation_id", pa.string()), ("slice", pa.int64()), ("whole", pa.bool_()), ("reason", pa.string()), *((n, pa.bool_()) for n in ("fault", "bare")), ("turns", pa.int64()),
    *((n, pa.bool_()) for n in ("twice", "unanswered")), *((n, pa.string()) for n in ("opens", "ends")), ("size", pa.int64()), ("left_over", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("at", pa.int64()), ("content", pa.string()),
])
_DDL = "conversation_id string, slice bigint, whole boolean, reason string, fault boolean, bare boolean, turns bigint, twice boolean, unanswered boolean, opens string, ends string, size bigint, left_over bigint, pos bigint, role string, at bigint, content string"


def _order(content: bool, linked: bool, slice_rows: int):
    """A row per slice with its facts (``pos`` null), and given ``content`` the rows of slices that may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        facts, kept = [], {n: [] for n in ("conversation_id", "slice", "whole", "pos", "role", "at", "content")}

        def close(rows: list[tuple], conversation: str, number: int, whole: bool) -> None:
            s = _Slice(rows, linked)
            reason = s.reason() if whole else None
            facts.append({"conversation_id": conversation, "slice": part + number, "whole": whole, "reason": reason} | {f: getattr(s, f) for f in _FACTS})
            if content and not reason:
                n = len(s.order)
                for name, values in zip(kept, ([conversation] * n, [part + number] * n, [whole] * n, range(n), (r[2] for r in s.order), (r[1] for r in s.order), (r[6] for r in s.order))):
                    kept[name].extend(values)

        def made() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pylist(facts, _ROW)
            n = len(kept["pos"])
            yield pa.RecordBatch.from_arrays([pa.array(kept[f.name], f.type) if f.name in kept else pa.nulls(n, f.type) for f in _ROW], schema=_ROW)
            facts.clear()
            for values in kept.values():
                values.clear()

        conversation, held, number, first, before, unseen = None, [], 0, True, None, True
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if unseen or row[0] != conversation:
                    if not unseen:
                        close(held, conversation, number, not first and not number)
                        first = False
                    conversation, held, number, before, unseen = row[0], [], 0, None, False
                if row[5] is None or before is not None and row[1:6] == before[1:6]:  # blank, or a copy
                    continue
                if len(held) >= slice_rows and not (linked and row[1] == before[1]):
                    close(held, conversation, number, False)
                    held, number = [], number + 1
                before = row
                held.append(row)
            if len(facts) + len(kept["pos"]) > 20_000:
                yield from made()
        if not unseen:
            close(held, conversation, number, False)  # may go on in the next partition
        yield from made()

    return run


def ordered_slices(messages: DataFrame, content: bool = True, reply_to: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Slices with their facts and, given ``content``, rows with their place ``pos`` in the slice, by one shuffle.

    Rows are in order over all partitions, equal ones beside each other, so copies are left out as rows stream by. Slice
    numbers ascend within a conversation. With ``reply_to`` rows of one time stay together, as only these can form a cycle.
    """
    rows = message_rows(messages, content, reply_to)
    by = [F.col("conversation_id"), F.col("at")]
    within = [*by, F.col("rank"), F.col("raw"), F.col("sign"), *([F.col("id").asc_nulls_last()] if reply_to else [])]
    columns = ["conversation_id", "at", "role", "rank", "raw", "sign", *(["content"] if content else []), *(["id", "parent", "parent_at"] if reply_to else [])]
    spread = rows.select(*columns).repartitionByRange(*(by if reply_to else within[:5])).sortWithinPartitions(*within)
    return spread.mapInArrow(_order(content, bool(reply_to), slice_rows), _DDL)


def _judged(slices: DataFrame) -> DataFrame:
    """(conversation_id, slice, reason, offset) of the slices of conversations that are cut: few, a row per cut.

    ``empty``: nothing but system rows. ``broken``: a faulty row, or an assistant turn that doesn't directly follow a user
    turn. ``missing_reply``: a user turn that isn't directly followed by an assistant turn.
    """
    w = Window.partitionBy("conversation_id").orderBy("slice")
    all_of = Window.partitionBy("conversation_id")
    before = F.last("ends", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("opens", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    met = slices.withColumn("before", before).withColumn("after", after)
    broken = F.col("fault") | F.col("twice") | F.coalesce((F.col("opens") == "assistant") & ~F.coalesce(F.col("before") == "user", F.lit(False)), F.lit(False))
    missing = F.col("unanswered") | F.coalesce((F.col("ends") == "user") & ~F.coalesce(F.col("after") == "assistant", F.lit(False)), F.lit(False))
    reason = F.when(F.min("bare").over(all_of), "empty").when(F.max(broken).over(all_of), "broken").when(F.max(missing).over(all_of), "missing_reply")
    offset = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.select("conversation_id", "slice", reason.alias("reason"), offset.alias("offset"))


def dropped_conversations(messages: DataFrame, reply_to: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(conversation_id, reason): one row per dropped conversation; empty tables give no rows.

    Rows without conversation id or with blank content are left out (a conversation of which nothing remains is ``empty``);
    rows that agree in conversation, role, content and time count once. Other columns play no part. Given ``reply_to``, the
    column that names the row answered, an answer to nothing, to a later row or on a cycle is broken too.
    """
    slices = write_shared(ordered_slices(messages, False, reply_to, slice_rows), "slices")
    cut = _judged(slices.where("not whole")).select("conversation_id", "reason").distinct()
    return slices.where("whole").select("conversation_id", "reason").unionByName(cut).where("reason is not null")


def rebuilt_conversations(messages: DataFrame, reply_to: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(conversation_id, position, role, content, created_at): the rows of whole conversations in order, from 1 on.

    What is dropped is what ``dropped_conversations`` gives. The rows are ordered once and written; those of cut
    conversations, two a task and what has more than ``slice_rows`` rows, are joined to the places of the slices before.
    """
    made = write_shared(ordered_slices(messages, True, reply_to, slice_rows), "turns")
    cut = _judged(made.where("pos is null and not whole")).where("reason is null").select("conversation_id", "slice", "offset")
    rows = made.where("pos is not null")
    of_cut = rows.where("not whole").join(cut, ["conversation_id", "slice"])
    both = rows.where("whole").withColumn("offset", F.lit(0).cast("bigint")).unionByName(of_cut)
    return both.select("conversation_id", (F.col("offset") + F.col("pos") + 1).alias("position"), "role", "content", F.timestamp_micros("at").cast("timestamp_ntz").alias("created_at"))


def reply_cycles(messages: DataFrame, reply_to: str) -> DataFrame:
    """(conversation_id, left_over): how many rows of a conversation are on a cycle of replies or answer one, as Kahn's algorithm leaves them over."""
    slices = ordered_slices(messages, False, reply_to)
    return slices.groupBy("conversation_id").agg(F.sum("left_over").alias("left_over")).where("left_over > 0")
