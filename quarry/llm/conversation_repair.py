"""Repair of conversation structure by a survivor-coalescence Viterbi search.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials.  The cheapest edits
come from a Viterbi search over the pattern's four states: every state has one survivor,
kept as a leaf of a tree of back pointers.  Branches that no survivor refers to any more
are released, and once all survivors descend from one node the edits up to it are emitted,
so only the unresolved suffixes are held.  Equal costs are decided by the complete
unresolved suffixes: the survivors' order by suffix is carried from row to row, which
compares two of them whole without walking them again.

Long conversations are cut into segments of ``SEGMENT`` rows.  A segment's summary (cost
and order for every pair of entry and exit state) combines with its neighbour's, so
summaries meet level by level in groups of ``FAN``, the path over the segments is handed
down again, and every segment is then searched by itself between two known states.  No
task ever holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bounded_batches, materialize
from quarry.operators.ordered import join_null_safe, row_index

SEGMENT = 4096
FAN = 256
# fixed values: white space and sentence ends of the contract
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: The role that a rerole or an insertion brings, and the state after it.
NEXT = (2, 2, 3, 2)
#: Insertions that lead from a state to the end.
TO_END = (0, 2, 1, 0)
STATES = range(4)


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Node:
    """A survivor's edits of one row; ``kids`` are the nodes that refer to it."""
    __slots__ = ("parent", "piece", "kids")

    def __init__(self, parent: Node | None, piece: str):
        self.parent, self.piece, self.kids = parent, piece, []


class Search:
    """Viterbi search from ``entry`` over rows of codes: role initial (s, u, a or o), in
    upper case if truncated, x if the row has to go."""

    def __init__(self, entry: int, costs: Costs):
        self.costs = costs
        self.root = Node(None, "")
        self.out: list[str] = []
        self.live = {entry: (0, 0, self.root)}      # state: cost, order, leaf
        # what another state's survivor saves at most by being where it is: insertions lead
        # from u to a and back; nothing and s are worth no more than a and one deletion
        i, d, no = costs.insert, costs.delete, 1 << 60
        self.lead = ((0, no, no, no), (no, 0, no, no), (i + d, i + d, 0, i), (d, d, i, 0))

    def step(self, code: str) -> None:
        c = self.costs
        best: dict[int, tuple] = {}

        def offer(state: int, cost: int, order: int, piece: str, leaf: Node) -> None:
            old = best.get(state)
            if old is None or (cost, order, piece) < old[:3]:
                best[state] = (cost, order, piece, leaf)

        low = code.lower()
        stays = c.truncated if code != low else 0
        for state, (cost, order, leaf) in self.live.items():
            made = ""
            for _ in range(3):      # a third insertion leads back to a state at a higher cost
                if code != "x":
                    if (to := KEEP[low].get(state)) is not None:
                        offer(to, cost + stays, order, made + "K", leaf)
                    offer(NEXT[state], cost + stays + c.rerole, order, made + "R", leaf)
                offer(state, cost + c.delete, order, made + "D", leaf)
                state, cost, made = NEXT[state], cost + c.insert, made + "I"
        leaves = [x[2] for x in self.live.values()]
        # a survivor that another one beats whatever follows is none
        for state in [x for x in best if any(best[y][0] + self.lead[y][x] < best[x][0] for y in best)]:
            del best[state]
        # suffixes end in a row's edit, so none is the beginning of another
        self.live = {}
        for rank, (state, x) in enumerate(sorted(best.items(), key=lambda kv: (kv[1][1], kv[1][2]))):
            node = Node(x[3], x[2])
            x[3].kids.append(node)
            self.live[state] = (x[0], rank, node)
        for leaf in leaves:
            self._release(leaf)
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.out.append(self.root.piece)

    def _release(self, node: Node) -> None:
        """Drop a node that nothing refers to, and its ancestors of which it was the last."""
        while not node.kids and node.parent is not None:
            node.parent.kids.remove(node)
            node = node.parent

    def end(self) -> int:
        """The state of the cheapest survivor once insertions have led it to the end."""
        return min(self.live, key=lambda s: (self.live[s][0] + TO_END[s] * self.costs.insert, self.live[s][1]))

    def pieces(self, state: int) -> list[str]:
        """The edits of all rows, row by row, for the survivor in ``state``."""
        tail, node = [], self.live[state][2]
        while node is not self.root:
            tail.append(node.piece)
            node = node.parent
        return self.out + tail[::-1]


def search(codes: str, entry: int = 0, exit_: int | None = None, costs: Costs = Costs()) -> tuple[int, list[str]]:
    """Cost and edits (a string per row; without ``exit_`` one more for the end)."""
    run = Search(entry, costs)
    for code in codes:
        run.step(code)
    if exit_ is not None:
        return run.live[exit_][0], run.pieces(exit_)
    at = run.end()
    return run.live[at][0] + TO_END[at] * costs.insert, [*run.pieces(at), "I" * TO_END[at]]


def made_roles(pieces: list[str], codes: str, entry: int = 0) -> list[str]:
    """Per piece the messages it leaves: ``.`` the row as it is, u or a the row with that
    role, U or A an inserted message."""
    state, out = entry, []
    for piece, code in zip(pieces, [*codes.lower(), ""]):
        made = ""
        for e in piece:
            if e == "K":
                state = KEEP[code][state]
                made += "."
            elif e in "RI":
                state = NEXT[state]
                made += "ua"[state - 2] if e == "R" else "UA"[state - 2]
        out.append(made)
    return out


def summary(codes: str, costs: Costs) -> tuple[list[int], list[int]]:
    """Cost (-1: none) and order of the best edits for every (entry, exit), 4 by 4."""
    cost, order = [-1] * 16, [0] * 16
    for entry in STATES:
        run = Search(entry, costs)
        for code in codes:
            run.step(code)
        for state, (c, rank, _) in run.live.items():
            cost[4 * entry + state], order[4 * entry + state] = c, rank
    return cost, order


def _pass(live: dict, cost: list[int], order: list[int]) -> dict:
    """Survivors (cost, order, states passed) beyond one more segment."""
    best: dict[int, tuple] = {}
    for state, (c, rank, path) in live.items():
        for to in STATES:
            if cost[4 * state + to] >= 0:
                x = (c + cost[4 * state + to], rank, order[4 * state + to], [path, to])
                if to not in best or x[:3] < best[to][:3]:
                    best[to] = x
    ranked = sorted(best.items(), key=lambda kv: kv[1][1:3])
    return {to: (x[0], rank, x[3]) for rank, (to, x) in enumerate(ranked)}


def combine(parts: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The summary of consecutive segments."""
    cost, order = [-1] * 16, [0] * 16
    for entry in STATES:
        live = {entry: (0, 0, None)}
        for p in parts:
            live = _pass(live, *p)
        for state, (c, rank, _) in live.items():
            cost[4 * entry + state], order[4 * entry + state] = c, rank
    return cost, order


def route(parts: list[tuple[list[int], list[int]]], entry: int, exit_: int | None, costs: Costs) -> list[int]:
    """The state after each of consecutive segments."""
    live = {entry: (0, 0, None)}
    for p in parts:
        live = _pass(live, *p)
    if exit_ is None:
        exit_ = min(live, key=lambda s: (live[s][0] + TO_END[s] * costs.insert, live[s][1]))
    path, out = live[exit_][2], []
    while path is not None:
        path, to = path
        out.append(to)
    return out[::-1]


# ------------------------------------------------------------------ Spark

def damage(rows: DataFrame) -> DataFrame:
    """The damaged conversations of the contract, by crc32(``conv_id:turn``) % 20: 0 drops a
    row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    Null roles and texts, and null ids and turns within the key, are one space; ids and turns
    themselves stay null."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    r = F.crc32(key) % 20
    text = F.coalesce(F.col("text"), space)
    out = rows.select("conv_id", "turn", F.when(r == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
                      F.when(r == 1, "").when(r == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                      r.alias("__r")).filter("__r <> 0")
    twice = F.when(F.col("__r") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("__copy", F.explode(twice)).drop("__r", "__copy")


class Repair(NamedTuple):
    """``messages``: conv_id, pos (of the damaged row), part, role, text, edit (K, R or I),
    in the order of (pos, part).  ``conversations``: conv_id and what was found and done."""
    messages: DataFrame
    conversations: DataFrame


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def _faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``: b(lank), d(uplicate), t(runcated) or ``-``; the first that holds."""
    text = _stripped(F.col("text"))
    own = rows.select("conv", "pos", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
                      F.when(text == "", "b").when(~F.substring(text, -1, 1).isin(*ENDS), "t").otherwise("-").alias("own"))
    first = own.filter("own <> 'b'").groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"))
    both = join_null_safe(own, first, ["conv", "role", "digest"], "left")
    return both.select("conv", "pos", "turn", "role",
                       F.when(F.col("first") < F.col("pos"), "d").otherwise(F.col("own")).alias("fault"))


def _segments(rows: DataFrame) -> DataFrame:
    """One row per segment: ``codes`` of its rows, and its share of what a conversation is
    reported with (the last row of the segment before it stands in for its left neighbour)."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    seg = F.expr(f"pos div {SEGMENT}")
    to = F.when((F.col("pos") + 1) % SEGMENT == 0, F.array(seg, seg + 1)).otherwise(F.array(seg))
    row = F.struct("pos", initial.alias("i"), "fault", "turn")
    got = (_faults(rows).select("conv", row.alias("row"), F.explode(to).alias("seg"))
           .groupBy("conv", "seg").agg(F.array_sort(F.collect_list("row")).alias("all")))
    start = F.col("seg") * SEGMENT
    own = F.filter("all", lambda x: x["pos"] >= start)
    code = F.transform(own, lambda x: F.when(x["fault"].isin("b", "d"), "x").when(
        x["fault"] == "t", F.upper(x["i"])).otherwise(x["i"]))

    def count(f):
        return F.size(F.filter(own, f)).cast("long")

    def before(x):      # the row in front of x, null for the first
        at = (x["pos"] - F.col("all")[0]["pos"]).cast("int")
        return F.when(at > 0, F.element_at("all", F.when(at > 0, at).otherwise(1)))

    pair = lambda x: F.concat(before(x)["i"], x["i"])
    turns = F.transform(own, lambda x: x["turn"])
    return got.filter(F.element_at("all", -1)["pos"] >= start).select(
        "conv", "seg", F.array_join(code, "").alias("codes"),
        count(lambda x: x["fault"] == "b").alias("blank"), count(lambda x: x["fault"] == "d").alias("duplicate"),
        count(lambda x: x["fault"] == "t").alias("truncated"),
        count(lambda x: before(x)["pos"].isNotNull() & ~pair(x).isin("su", "ua", "au")).alias("illegal"),
        count(lambda x: x["turn"].isNotNull() & ~before(x)["turn"].eqNullSafe(x["turn"])).alias("turns"),
        F.array_min(turns).alias("low"), F.array_max(turns).alias("high"))


_SUMMARY = T.StructType([T.StructField("conv", T.LongType()), T.StructField("seg", T.LongType()),
                         T.StructField("cost", T.ArrayType(T.LongType())), T.StructField("order", T.ArrayType(T.IntegerType()))])


def _summaries(segments: DataFrame, costs: Costs) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [summary(c, costs) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.list_(pa.int64())),
                                              pa.array([x[1] for x in got], pa.list_(pa.int32()))], names=_SUMMARY.names)
    return segments.select("conv", "seg", "codes").mapInArrow(run, _SUMMARY)


def _up(parts: DataFrame) -> DataFrame:
    """Summaries of ``FAN`` neighbours each."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seg")
        cost, order = combine([([int(v) for v in c], [int(v) for v in o]) for c, o in zip(g["cost"], g["order"])])
        out = pd.DataFrame({"conv": g["conv"].iloc[:1], "seg": g["seg"].iloc[:1] // FAN})
        out["cost"], out["order"] = [cost], [order]
        return out
    return parts.groupBy("conv", F.expr(f"seg div {FAN}").alias("group")).applyInPandas(run, _SUMMARY)


def _down(parts: DataFrame, ends: DataFrame | None, costs: Costs) -> DataFrame:
    """(conv, seg, entry, exit) from those of the groups; without groups a conversation
    starts at 0 and ends where it is cheapest (exit null for its last segment)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seg")
        entry = int(g["entry"].iloc[0])
        exit_ = None if pd.isna(g["exit"].iloc[0]) else int(g["exit"].iloc[0])
        path = route([([int(v) for v in c], [int(v) for v in o]) for c, o in zip(g["cost"], g["order"])], entry, exit_, costs)
        out = g[["conv", "seg"]].copy()
        out["entry"] = [entry, *path[:-1]]
        out["exit"] = pd.array([*path[:-1], exit_], dtype="Int32")
        return out
    parts = parts.withColumn("group", F.expr(f"seg div {FAN}"))
    if ends is None:
        parts = parts.withColumns({"entry": F.lit(0), "exit": F.lit(None).cast("int")})
    else:
        parts = join_null_safe(parts, ends.withColumnRenamed("seg", "group"), ["conv", "group"])
    return parts.groupBy("conv", "group").applyInPandas(run, "conv long, seg long, entry int, exit int")


def _ends(segments: DataFrame, costs: Costs) -> DataFrame:
    """Entry and exit state of every segment of the conversations that have several."""
    levels = [materialize(_summaries(segments, costs), "repair-level")]
    while levels[-1].agg(F.max("seg")).first()[0] >= FAN:
        levels.append(materialize(_up(levels[-1]), "repair-level"))
    ends = None
    for level in reversed(levels):
        ends = _down(level, ends, costs)
    return materialize(ends, "repair-ends")


def _edits(segments: DataFrame, costs: Costs) -> DataFrame:
    """Every segment between its two states: (conv, seg, cost, pieces, made); the last
    segment of a conversation has one more entry, for what is appended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            out = []
            for args in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                done = known.get(args)
                if done is None:
                    codes, entry, exit_ = args
                    cost, pieces = search(codes, entry, exit_, costs)
                    done = cost, pieces, made_roles(pieces, codes, entry)
                    if len(codes) <= 16 and len(known) < 50_000:     # short conversations are often alike
                        known[args] = done
                out.append(done)
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], text),
                 pa.array([x[2] for x in out], text)], names=["conv", "seg", "cost", "pieces", "made"])
    return segments.select("conv", "seg", "codes", "entry", "exit").mapInArrow(
        run, "conv long, seg long, cost long, pieces array<string>, made array<string>")


def repair(rows: DataFrame, costs: Costs = Costs()) -> Repair:
    """Find faults in conversations (``conv_id``, ``turn``, ``role``, ``text``) and repair them.

    Rows are taken by turn, nulls first, rows of one turn by role and text; rows that repeat
    all of them are duplicates.  A null conv_id is a conversation of its own; null roles and
    texts count as one space (a blank row of no role).  Extra columns are ignored.  A table
    without rows gives none.  ``conversations``: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost (longs), audit."""
    bounded_batches(rows.sparkSession)
    src = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                      F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    src = materialize(row_index(src, order, ["conv"], name="pos", tie_break=False), "repair-rows")
    segments = materialize(_segments(src), "repair-segments")
    several = segments.filter("seg > 0").select("conv").distinct()
    several = join_null_safe(segments, several, ["conv"], "left_semi")
    whole = segments.withColumns({"entry": F.lit(0), "exit": F.lit(None).cast("int")})
    if not segments.filter("seg > 0").isEmpty():
        ends = _ends(several, costs)
        whole = join_null_safe(segments, ends, ["conv", "seg"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    edits = materialize(_edits(whole, costs), "repair-edits")

    found = join_null_safe(segments, edits, ["conv", "seg"])
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.array_join("pieces", "").alias("a")))),
                                     lambda x: x["a"]), "")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long")
    conversations = found.groupBy("conv").agg(gaps.alias("gaps"), *sums, audit.alias("audit"))

    each = edits.select("conv", "seg", F.posexplode(F.arrays_zip("pieces", "made")).alias("i", "e"))
    each = each.select("conv", (F.col("seg") * SEGMENT + F.col("i")).alias("pos"), F.col("e.made").alias("made")).filter("made <> ''")
    parts = F.posexplode(F.split("made", "")).alias("part", "m")
    full = join_null_safe(each, src.select("conv", "pos", "role", "text"), ["conv", "pos"], "left").select(
        "conv", "pos", "role", "text", parts)
    role = F.when(F.col("m") == ".", F.col("role")).when(F.lower("m") == "u", "user").otherwise("assistant")
    messages = full.select(F.col("conv").alias("conv_id"), "pos", "part", role.alias("role"),
                           F.when(F.col("m").isin("U", "A"), "").otherwise(F.col("text")).alias("text"),
                           F.when(F.col("m") == ".", "K").when(F.col("m").isin("U", "A"), "I").otherwise("R").alias("edit"))
    return Repair(messages, conversations.withColumnRenamed("conv", "conv_id"))


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, sha256 of its ``role:text`` lines in order, newline-joined).

    A digest is a chain over the whole conversation, so its rows pass through one task, but
    as a stream: a running hash is all that is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for b in batches:
            done = []
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                line = line.encode("utf-8", "surrogatepass")
                if running is None or conv != at:
                    if running is not None:
                        done.append((at, running.hexdigest()))
                    at, running = conv, hashlib.sha256(line)
                else:
                    running.update(b"\n")
                    running.update(line)
            yield _pairs(done)
        if running is not None:
            yield _pairs([(at, running.hexdigest())])

    def _pairs(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()),
                                           pa.array([x[1] for x in done], pa.string())], names=["conv_id", "sha"])

    lines = messages.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "part")
    return lines.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(
        run, "conv_id long, sha string")
