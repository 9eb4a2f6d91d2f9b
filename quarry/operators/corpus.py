"""Text-corpus preparation (IO16, B1-B8, E11 support).

* Pre-tokenising runs in the JVM (``regexp_extract_all`` with the split
  pattern; Java regex supports its possessive quantifiers).
* BPE training works on the table of distinct pre-tokens with their counts
  (map-side combined), held as packed arrays of token ids.
  A round counts adjacent pairs (one aggregation), brings the stretches of leading pairs
  (a bounded number) to the driver, and rewrites the words with all merges they tell.
  The table is checkpointed every few rounds to cut lineage.
* Encoding, decoding and packing run per partition on Arrow batches with a
  small Python helper (rank-ordered byte-pair merging, cached per pre-token).
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.ordered import DEFAULT_BUCKET_ROWS, row_index, running
from quarry.session import cut_lineage, keep_table

# Pre-tokenisation split pattern, special tokens and the beginning-of-sequence token.
SPLIT_PATTERN = (r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|"""
                 r"""\s*[\r\n]|\s+(?!\S)|\s+""")
SPECIAL_TOKENS = [f"<|reserved_{i}|>" for i in range(4)]
BOS_TOKEN = "<|reserved_0|>"
MAX_SEQ_LEN = 2048


# ---------------------------------------------------------------- shards

def split_shards(df: DataFrame, key: str = "doc_id", k: int = 10, val_shard: int | None = None,
                 file_name: bool = False) -> tuple[DataFrame, DataFrame]:
    """IO16 (train, val): val is the last shard.  With ``file_name`` the shard
    is the source file (``_metadata.file_name``, last in sorted order);
    otherwise shard = key % k and val = shard k - 1."""
    if file_name:
        names = df.select(F.col("_metadata.file_name").alias("f")).distinct().orderBy(F.desc("f")).limit(1).collect()
        last = names[0]["f"] if names else None
        is_val = F.col("_metadata.file_name") == F.lit(last)
    else:
        v = k - 1 if val_shard is None else val_shard
        is_val = F.pmod(F.col(key), F.lit(k)) == v
    return df.where(~is_val), df.where(is_val)


def cap_corpus(df: DataFrame, order_by: Sequence, text: str = "text", doc_cap: int | None = None,
               max_chars: int | None = None, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """B1 documents cut to ``doc_cap`` characters and, in order, kept while the
    characters before them stay under ``max_chars`` (the document that crosses
    the budget is kept).  Neither limit holds unless it is given.  The running total is a
    skew-safe prefix sum; ``cap_report`` tells what the limits removed."""
    doc = F.substring(F.col(text), 1, doc_cap) if doc_cap else F.col(text)
    if max_chars is None:
        return df.withColumn("doc", doc)
    ix = row_index(df, order_by, name="_idx")
    # the running total sees positions and lengths only; as it never falls, it ends at one position
    sizes = ix.select("_idx", F.length(doc).cast("long").alias("_len"))
    r = running(sizes, [], [], [("_before", "sum", "_len", False)], bucket_rows=bucket_rows, idx="_idx")
    last = r.where(F.coalesce("_before", F.lit(0)) < max_chars).agg(F.max("_idx")).first()[0]
    return ix.where(F.col("_idx") <= F.lit(last).cast("long")).drop("_idx").withColumn("doc", doc)


def cap_report(df: DataFrame, capped: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents and characters before and after ``cap_corpus``."""
    def total(x: DataFrame, c: str, name: str) -> DataFrame:
        return x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(c)), F.lit(0)).alias("chars")).select(
            F.lit(name).alias("part"), "n", "chars")

    both = total(df, text, "before").unionAll(total(capped, "doc", "after"))
    at = {k: F.max(F.when(F.col("part") == k, F.struct("n", "chars"))) for k in ("before", "after")}
    return both.agg(at["before"].alias("b"), at["after"].alias("a")).select(
        F.col("b.n").alias("documents"), (F.col("b.n") - F.col("a.n")).alias("documents_removed"),
        F.col("b.chars").alias("chars"), (F.col("b.chars") - F.col("a.chars")).alias("chars_removed"))


# ---------------------------------------------------------------- pre-tokens and BPE training

def pretokens(df: DataFrame, text: str = "text") -> DataFrame:
    """B2 one row per pre-token (whole texts, JVM regex)."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(SPLIT_PATTERN), 0)).alias("piece"))


def pretoken_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct pre-tokens with their counts (map-side combined)."""
    return pretokens(df, text).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


#: Column type of a task's words: a row holds those of one Arrow batch of pre-tokens.
_BLOCK = "ids binary, sizes binary, n binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens and counts as packed arrays: token ids of all words, ids per word, counts."""
    for b in batches:
        words = [w.encode("utf-8") for w in b.column(0).to_pylist()]
        yield _block(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]),
                     np.asarray(b.column(1), dtype=np.int64))


def _block(ids: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    raw = (ids.astype(np.int32), sizes.astype(np.int32), n.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in raw], names=["ids", "sizes", "n"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sizes, n, keys): ``keys`` holds left << 32 | right at the left id of every pair
    inside a word, -1 at the last id of a word."""
    for b in batches:
        for ids, sizes, n in zip(*(c.to_pylist() for c in b.columns)):
            ids = np.frombuffer(ids, np.int32).astype(np.int64)
            sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
            keys = np.append((ids[:-1] << 32) | ids[1:], -1)[:len(ids)]
            keys[np.cumsum(sizes)[sizes > 0] - 1] = -1
            yield ids, sizes, np.frombuffer(n, np.int64), keys


def _by_rank(ids: Sequence[int], ranks: dict[tuple[int, int], int], first: int) -> list[int]:
    """Merge by rank, leftmost first (pair of rank r becomes token ``first + r``): the pairs wait
    in a heap, the ids are a linked list, so n ids take O(n log n).  A merge's own pairs always
    rank behind it."""
    ids = list(ids)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        # a pair that a merge beside it has changed is no longer there
        if ids[i] < 0 or j >= n or ranks.get((ids[i], ids[j])) != r:
            continue
        ids[i], ids[j] = first + r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (x := ranks.get((ids[i], ids[k]))) is not None:
                heapq.heappush(heap, (x, i))
        h = before[i]
        if h >= 0 and (x := ranks.get((ids[h], ids[i]))) is not None:
            heapq.heappush(heap, (x, h))
    return [i for i in ids if i >= 0]


def _merge_step(pairs: Sequence[tuple[int, int]], first: int):
    """Task function: the pairs, one after the other, become tokens ``first + i`` in every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        ranks = {p: i for i, p in enumerate(pairs)}
        for ids, sizes, n, at in _unpacked(batches):
            word = np.repeat(np.arange(len(sizes)), sizes)
            changed = np.zeros(len(sizes), bool)
            changed[word[np.isin(at, keys)]] = True
            some = np.flatnonzero(changed)
            ends = np.cumsum(sizes)
            parts = [_by_rank(ids[ends[w] - sizes[w]:ends[w]].tolist(), ranks, first) for w in some.tolist()]
            # unchanged words first: their order within a block has no meaning
            yield _block(np.concatenate([ids[~changed[word]], np.fromiter(itertools.chain.from_iterable(parts), np.int64)]),
                         np.concatenate([sizes[~changed], np.array([len(x) for x in parts], np.int64)]),
                         np.concatenate([n[~changed], n[changed]]))
    return run


def _hot_runs(pairs: Sequence[tuple[int, int]]):
    """Task function: (run, n) of the longest stretches of words whose adjacent pairs are all among
    ``pairs``, with the counts of equal ones in a block added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        for ids, sizes, n, at in _unpacked(batches):
            hot = np.isin(at, keys)
            edge = np.diff(np.concatenate([[0], hot.astype(np.int8), [0]]))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            weight = np.repeat(n, sizes)[starts]
            small = ids.astype(np.int32)
            total: dict[bytes, int] = {}
            for s, e, w in zip(starts.tolist(), stops.tolist(), weight.tolist()):
                x = small[s:e + 1].tobytes()
                total[x] = total.get(x, 0) + w
            for some in itertools.batched(total.items(), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.binary()),
                                                  pa.array([w for _, w in some], pa.int64())], names=["run", "n"])
    return run


def _merges_of_runs(runs: Sequence[tuple[bytes, int]], line: int, first: int, most: int) -> list[tuple[int, int]]:
    """The next merges, as long as the best pair is counted ``line`` times or more.

    The runs lie one after the other in one linked list; a pair knows the places where it was
    seen (looked at again when it is merged), so all merges together take about as many steps as there are ids."""
    ids = np.frombuffer(b"".join(r for r, _ in runs), np.int32).tolist()
    sizes = [len(r) // 4 for r, _ in runs]
    n = len(ids)
    weight = np.repeat(np.array([w for _, w in runs], np.int64), sizes).tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at = 0
    for size in sizes:
        before[at], after[at + size - 1] = -1, -1
        at += size
    count: dict[tuple[int, int], int] = {}
    places: dict[tuple[int, int], list[int]] = {}

    def seen(i: int, pair: tuple[int, int]) -> None:
        count[pair] = count.get(pair, 0) + weight[i]
        places.setdefault(pair, []).append(i)

    for i in range(n):
        if after[i] >= 0:
            seen(i, (ids[i], ids[after[i]]))
    heap = [(-c, pair) for pair, c in count.items() if c >= line]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while heap and len(merges) < most:
        c, pair = heapq.heappop(heap)
        now = count[pair]
        if now != -c:
            # other merges took some of its places
            if now >= line:
                heapq.heappush(heap, (-now, pair))
            continue
        new = first + len(merges)
        merges.append(pair)
        made: set[tuple[int, int]] = set()
        for i in sorted(places.pop(pair)):
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            h, k, w = before[i], after[j], weight[i]
            count[pair] -= w
            if h >= 0:
                count[ids[h], ids[i]] -= w
            if k >= 0:
                count[ids[j], ids[k]] -= w
                before[k] = i
            ids[i], ids[j], after[i], after[j] = new, -1, k, -1
            if h >= 0:
                seen(h, (ids[h], new))
                made.add((ids[h], new))
            if k >= 0:
                seen(i, (new, ids[k]))
                made.add((new, ids[k]))
        for p in made:
            if count[p] >= line:
                heapq.heappush(heap, (-count[p], p))
    return merges


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sizes, n, keys in _unpacked(batches):
        inside = keys >= 0
        pair, where = np.unique(keys[inside], return_inverse=True)
        count = np.zeros(len(pair), np.int64)
        np.add.at(count, where, np.repeat(n, sizes)[inside])
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], names=["pair", "c"])


def _together(best: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The leading pairs that one round can merge as if one by one.

    As long as no left id of theirs is a right id of theirs, no merge changes another's
    count, and a pair with a new token is at most as frequent as a pair ranked after them
    (and ranks behind on ties, since new ids are larger)."""
    out: list[tuple[int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for a, b in best:
        if a in rights or b in lefts or (a == b and out):
            break
        out.append((a, b))
        if a == b:
            break
        lefts.add(a)
        rights.add(b)
    return out


#: Ids that the runs of one round may have together: they are what the driver gets.
RUN_IDS = 1 << 19


def train_bpe(counts: DataFrame, vocab_size: int, checkpoint_every: int = 32,
              specials: Sequence[str] = SPECIAL_TOKENS, most: int = 1024, run_ids: int = RUN_IDS) -> list[tuple[int, int]]:
    """B3 learn ``vocab_size - len(specials) - 256`` merges over the byte
    sequences of the distinct pre-tokens, weighted by their counts.  Returns
    the merges in order; merge i creates token 256 + i.  Ties between pair
    counts go to the smaller (left id, right id); the merges are those of one pair a round.

    A round counts the adjacent pairs of all distinct pre-tokens (packed arrays, one
    aggregation) and finds all merges of pairs counted at least ``line`` times, a line that
    only the leading pairs reach (``most``, adapted from round to round).  Any such pair, also
    of tokens made in the round, lies where every adjacent pair reaches the line now, since a
    pair of larger tokens is no more frequent than the pair at its seam.  So the stretches of
    leading pairs, summed over all words, tell these merges exactly.  The driver gets at most
    ``run_ids`` ids of them; where there are more, a round takes fewer pairs.  The tasks then
    rewrite their words."""
    n_merges = vocab_size - len(specials) - 256
    words = counts.select("piece", F.col("n").cast("long").alias("n")).mapInArrow(_blocks, _BLOCK)
    words = cut_lineage(words)
    merges: list[tuple[int, int]] = []
    held, rounds = None, 0
    while len(merges) < n_merges:
        best = (words.mapInArrow(_count_pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
                .orderBy(F.desc("c"), F.asc("pair")).limit(most + 1).collect())
        if held is not None:
            held.unpersist()
        if not best:
            break
        top = [(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF) for r in best]
        pairs: list[tuple[int, int]] = []
        take, most = most, min(4 * most, 1 << 16)
        while not pairs:
            line = best[take]["c"] + 1 if len(best) > take else 1
            hot = [p for p, r in zip(top, best) if r["c"] >= line]
            if not hot:
                # the leading pairs are equally frequent
                pairs = _together(top[:-1] or top)
                break
            runs = words.mapInArrow(_hot_runs(hot), "run binary, n long").groupBy("run").agg(F.sum("n").alias("n")).persist()
            size = runs.agg(F.sum(F.length("run") / 4)).first()[0]
            if size <= run_ids:
                got = [(bytes(r["run"]), r["n"]) for r in runs.collect()]
                pairs = _merges_of_runs(got, line, 256 + len(merges), n_merges - len(merges))
            elif take == 1:
                pairs = top[:1]
            else:
                take = most = max(take // 4, 1)
            runs.unpersist()
        pairs = pairs[:n_merges - len(merges)]
        step = words.mapInArrow(_merge_step(pairs, 256 + len(merges)), _BLOCK)
        merges += pairs
        rounds += 1
        if len(merges) >= n_merges:
            break
        # a lost block is recomputed from the last checkpoint (deterministic lineage)
        held = words
        words = cut_lineage(step) if rounds % checkpoint_every == 0 else step.persist()
    words.unpersist()
    if held is not None:
        held.unpersist()
    return merges


#: A block with its index (``held``: the pairs it holds, sorted) and the change of pair counts
#: that the last round made in it (null: none).
_INDEXED = "ids binary, sizes binary, n binary, held binary, pair array<long>, delta array<long>"
BLOCK_WORDS = 2048


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs inside words and their weighted counts."""
    inside = keys >= 0
    pair, where = np.unique(keys[inside], return_inverse=True)
    count = np.zeros(len(pair), np.int64)
    np.add.at(count, where, weight[inside])
    return pair, count


def _keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    keys = np.append((ids[:-1] << 32) | ids[1:], -1)[:len(ids)]
    keys[np.cumsum(sizes)[sizes > 0] - 1] = -1
    return keys


def _indexed(ids, sizes, n, held, pair=None, delta=None) -> pa.RecordBatch:
    raw = (ids.astype(np.int32), sizes.astype(np.int32), n.astype(np.int64), held.astype(np.int64))
    lists = [pa.array([x if x is None else x.tolist()], pa.list_(pa.int64())) for x in (pair, delta)]
    return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in raw), *lists],
                                      names=["ids", "sizes", "n", "held", "pair", "delta"])


def _first_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_WORDS):
            part = b.slice(at, BLOCK_WORDS)
            words = [w.encode("utf-8") for w in part.column(0).to_pylist()]
            ids, sizes = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.array([len(w) for w in words])
            n = np.asarray(part.column(1), dtype=np.int64)
            pair, count = _counted(_keys(ids, sizes), np.repeat(n, sizes))
            yield _indexed(ids, sizes, n, pair, pair, count)


def _merged(ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, want: np.ndarray, new: np.ndarray,
            alike: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes with every pair of ``want`` (sorted) replaced by its token of ``new``."""
    found = np.minimum(np.searchsorted(want, keys), len(want) - 1)
    hit = np.flatnonzero(want[found] == keys)
    if len(hit) and alike:      # a a a: every second one from the left
        start = np.append(True, np.diff(hit) != 1)
        hit = hit[(hit - hit[start][np.cumsum(start) - 1]) % 2 == 0]
    ids = ids.copy()
    ids[hit] = new[found[hit]]
    gone = np.zeros(len(ids) + 1, np.int64)
    gone[hit + 1] = 1
    ends = np.cumsum(sizes)
    upto = np.concatenate([[0], np.cumsum(gone[:-1])])
    return ids[gone[:-1] == 0], sizes - (upto[ends] - upto[ends - sizes])


def _delta_step(pairs: Sequence[tuple[int, int]], first: int):
    """Task function: pair i becomes token ``first + i``.  Blocks whose index holds none of
    the pairs pass as they are; in the others only the words that change are counted, before
    and after."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        want, new = keys[order], first + order
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                held = np.frombuffer(row[3], np.int64)
                at = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
                if not len(held) or not (held[at] == want).any():
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x], pa.binary()) for x in row), *[pa.array([None], pa.list_(pa.int64()))] * 2],
                        names=["ids", "sizes", "n", "held", "pair", "delta"])
                    continue
                ids, sizes = (np.frombuffer(x, np.int32).astype(np.int64) for x in row[:2])
                n = np.frombuffer(row[2], np.int64)
                at = _keys(ids, sizes)
                word = np.repeat(np.arange(len(sizes)), sizes)
                changed = np.zeros(len(sizes), bool)
                changed[word[np.isin(at, want)]] = True
                some = changed[word]
                sub, size, weight = ids[some], sizes[changed], n[changed]
                old, less = _counted(at[some], np.repeat(weight, size))
                sub2, size2 = _merged(sub, size, at[some], want, new, pairs[0][0] == pairs[0][1])
                now, more = _counted(_keys(sub2, size2), np.repeat(weight, size2))
                pair, where = np.unique(np.concatenate([old, now]), return_inverse=True)
                delta = np.zeros(len(pair), np.int64)
                np.add.at(delta, where, np.concatenate([-less, more]))
                # unchanged words first: their order within a block has no meaning
                ids = np.concatenate([ids[~some], sub2])
                sizes = np.concatenate([sizes[~changed], size2])
                n = np.concatenate([n[~changed], weight])
                keep = _keys(ids, sizes)
                yield _indexed(ids, sizes, n, np.unique(keep[keep >= 0]), pair[delta != 0], delta[delta != 0])
    return run


def train_bpe_incremental(counts: DataFrame, vocab_size: int, checkpoint_every: int = 6,
                          specials: Sequence[str] = SPECIAL_TOKENS, most: int = 1024) -> list[tuple[int, int]]:
    """B3, the merges of ``train_bpe`` from changes alone.

    Words lie in blocks that know which pairs they hold; the pair counts are a table of
    their own.  A round takes the leading pairs that do not touch each other, rewrites the
    blocks that hold one of them, and adds what changed there to the counts: one job, whose
    shuffle carries the changed pairs only.  A lost block is recomputed from the last
    checkpoint (every ``checkpoint_every`` rounds; planning a round costs more the longer
    the plan since then, so it is a small number)."""
    n_merges = vocab_size - len(specials) - 256
    if n_merges <= 0:
        return []
    blocks = cut_lineage(counts.select("piece", F.col("n").cast("long").alias("n")).mapInArrow(_first_blocks, _INDEXED))
    table: DataFrame | None = None
    merges: list[tuple[int, int]] = []
    held: list[DataFrame] = []
    rounds = 0
    while True:
        change = (blocks.where(F.col("pair").isNotNull()).select(F.explode(F.arrays_zip("pair", "delta")).alias("x"))
                  .groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.delta").alias("d")))
        if table is None:
            table = change.withColumnRenamed("d", "c")
        else:
            total = (F.coalesce("c", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("c")
            table = table.join(change, "pair", "full_outer").select("pair", total).where("c > 0")
        table = cut_lineage(table) if rounds % checkpoint_every == 0 else table.persist()
        best = table.orderBy(F.desc("c"), F.asc("pair")).limit(most).collect()
        for d in held:
            d.unpersist()
        pairs = _together([(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF) for r in best])[:n_merges - len(merges)]
        held = [blocks, table]
        if not pairs:
            break
        step = blocks.mapInArrow(_delta_step(pairs, 256 + len(merges)), _INDEXED)
        merges += pairs
        rounds += 1
        if len(merges) >= n_merges:
            break
        blocks = cut_lineage(step) if rounds % checkpoint_every == 0 else step.persist()
    for d in held:
        d.unpersist()
    return merges


# ---------------------------------------------------------------- saved vocabularies

def save_merges(spark: SparkSession, path: str, merges: Sequence[tuple[int, int]]) -> None:
    """Keep a vocabulary's merges as a table (rank, left_id, right_id) in a shared folder."""
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(merges)]
    spark.createDataFrame(rows, "rank int, left_id int, right_id int").coalesce(1).write.mode("overwrite").parquet(path)


def load_merges(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The merges kept at ``path``, in order (bounded by the vocabulary)."""
    return [(r["left_id"], r["right_id"]) for r in spark.read.parquet(path).orderBy("rank").collect()]


def vocabulary(spark: SparkSession, merges: Sequence[tuple[int, int]],
               specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """B6 (token_id, text, n_bytes, special): bytes of every token; special
    tokens have 0 bytes (F11)."""
    table = token_table(merges)
    rows = [(i, b.decode("utf-8", "replace"), len(b), False) for i, b in enumerate(table)]
    rows += [(len(table) + j, s, 0, True) for j, s in enumerate(specials)]
    return spark.createDataFrame(rows, "token_id int, text string, n_bytes int, special boolean")


def token_table(merges: Sequence[tuple[int, int]]) -> list[bytes]:
    table = [bytes([i]) for i in range(256)]
    for a, b in merges:
        table.append(table[a] + table[b])
    return table


# ---------------------------------------------------------------- encoding helper (per task)

class _Encoder:
    """Rank-ordered byte-pair merging of pre-tokens (short ones cached)."""

    def __init__(self, merges: Sequence[tuple[int, int]]):
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.table = token_table(merges)
        self._cached = functools.lru_cache(maxsize=1 << 16)(self._encode_piece)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        # long pieces are rare and not worth their memory
        return self._cached(piece) if len(piece) <= 64 else self._encode_piece(piece)

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        return tuple(_by_rank(piece.encode("utf-8"), self.ranks, 256))

    def encode(self, pieces: Sequence[str] | None) -> list[int]:
        """Ids of a text's pre-tokens (a piece met before is looked up)."""
        out: list[int] = []
        for piece in pieces if pieces is not None else ():
            out.extend(self.encode_piece(piece))
        return out

    def decode(self, ids) -> str:
        return b"".join(self.table[i] for i in ids if i < len(self.table)).decode("utf-8", "replace")


def _pieces(text: str) -> Column:
    """The pre-tokens of a text, cut in the JVM by the pattern that training uses."""
    return F.regexp_extract_all(F.col(text), F.lit(SPLIT_PATTERN), 0)


def encode(df: DataFrame, merges: Sequence[tuple[int, int]], text: str = "text", prepend_bos: bool = True,
           out: str = "ids") -> DataFrame:
    """B4 token ids of every document (whole text), BOS first; the merge list
    (bounded by the vocabulary size) is broadcast once."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(list(merges))
    bos = len(merges) + 256 + SPECIAL_TOKENS.index(BOS_TOKEN)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def enc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _Encoder(bc.value)
        for s in texts:
            yield s.map(lambda t: ([bos] if prepend_bos else []) + e.encode(t))
    return df.withColumn(out, enc(_pieces(text)))


def round_trip_audit(df: DataFrame, merges: Sequence[tuple[int, int]], text: str = "text") -> DataFrame:
    """B5 number of documents where decode(encode(x)) != x."""
    bc = df.sparkSession.sparkContext.broadcast(list(merges))

    @F.pandas_udf(T.BooleanType())
    def same(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        e = _Encoder(bc.value)
        for s, pieces in texts:
            yield pd.Series([e.decode(e.encode(p)) == (t or "") for t, p in zip(s, pieces)])
    return df.agg(F.count(F.lit(1)).alias("documents"),
                  F.count(F.when(~same(F.col(text), _pieces(text)), 1)).alias("mismatches"))


# ---------------------------------------------------------------- packing

class _Waiting:
    """Token sequences sorted by length: the longest that fits is found by bisection."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.held: list[list[int]] = []

    def add(self, ids: list[int]) -> None:
        at = bisect.bisect_right(self.lengths, len(ids))
        self.lengths.insert(at, len(ids))
        self.held.insert(at, ids)

    def take(self, space: int) -> list[int]:
        """The longest sequence of at most ``space`` tokens; if there is none, the shortest."""
        at = max(bisect.bisect_right(self.lengths, space) - 1, 0)
        self.lengths.pop(at)
        return self.held.pop(at)


def pack(df: DataFrame, length: int = MAX_SEQ_LEN, ids: str = "ids", buffer: int = 1000,
         crop: bool = True) -> DataFrame:
    """B7 best-fit packing into rows of ``length + 1`` ids: (row, n_tokens, n_cropped).

    Every task packs its partition with at most ``buffer`` sequences waiting: the longest
    that fits goes into the row; where none fits, the shortest fills it and its rest is
    cropped (``n_cropped`` tokens of that row's making) or, with ``crop=False``, waits as a
    sequence of its own.  The last row of a partition may be short; ``n_tokens`` tells.
    Kept and cropped tokens together are those of the input, however it is partitioned.
    Null sequences count as empty."""
    cap = length + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, row, cropped = _Waiting(), [], 0
        source = (list(d) for pdf in batches for d in pdf[ids] if d is not None and len(d))
        done: list[tuple[list[int], int, int]] = []

        def rows() -> pd.DataFrame:
            return pd.DataFrame(done, columns=["row", "n_tokens", "n_cropped"])

        while True:
            for seq in itertools.islice(source, buffer - len(waiting.held)):
                waiting.add(seq)
            if not waiting.held:
                break
            seq = waiting.take(cap - len(row))
            part, rest = seq[:cap - len(row)], seq[cap - len(row):]
            row = row + part
            if rest and crop:
                cropped += len(rest)
            elif rest:
                waiting.add(rest)
            if len(row) == cap:
                done.append((row, cap, cropped))
                row, cropped = [], 0
                if len(done) == 256:
                    yield rows()
                    done = []
        if row:
            done.append((row, len(row), cropped))
        if done:
            yield rows()
    return df.select(ids).mapInPandas(run, "row array<int>, n_tokens int, n_cropped int")


def _full_rows(source: Iterator[list[int]], cap: int, buffer: int, crop: bool) -> Iterator[tuple[list[int], int | None, int]]:
    """(ids, None, cropped) of every full row ``pack`` makes of ``source``, then
    (ids, number, 0) of the sequences left, which together are shorter than a row."""
    waiting, pieces, used, held, cropped = _Waiting(), [], 0, 0, 0
    while True:
        for seq in itertools.islice(source, buffer - len(waiting.held)):
            waiting.add(seq)
            held += len(seq)
        if used + held < cap and len(waiting.held) < buffer:  # the source has ended
            yield from ((seq, i, 0) for i, seq in enumerate(pieces + waiting.held))
            return
        seq = waiting.take(cap - used)
        part, rest = seq[:cap - used], seq[cap - used:]
        pieces.append(part)
        used += len(part)
        held -= len(seq)
        if rest and crop:
            cropped += len(rest)
        elif rest:
            waiting.add(rest)
            held += len(rest)
        if used == cap:
            yield list(itertools.chain.from_iterable(pieces)), None, cropped
            pieces, used, cropped = [], 0, 0


def plan_rows(histogram: dict[int, int], cap: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit rows of ``cap`` tokens from a length histogram alone: (length, from, to, row,
    slot): of the sequences of that length, number ``from`` goes to place ``slot`` of row
    ``row``, the next one to the same place of the next row, up to before ``to``.

    A row takes the longest length that fits, or where none fits the shortest, to be cropped;
    rows of one kind are planned together, so the work depends on the lengths, not on how
    many sequences there are.  Only the last row can be short."""
    left = {n: c for n, c in histogram.items() if c}
    lengths, used = sorted(left), dict.fromkeys(left, 0)
    out, row = [], 0
    while lengths:
        take: list[int] = []
        free, space, open_ = dict.fromkeys(lengths, 0), cap, list(lengths)
        while space > 0 and open_:
            n = open_[max(bisect.bisect_right(open_, space) - 1, 0)]
            take.append(n)
            free[n] += 1
            space -= n
            if free[n] == left[n]:
                open_.remove(n)
        times = min(left[n] // free[n] for n in take)
        for slot, n in enumerate(take):
            out.append((n, used[n], used[n] + times, row, slot))
            used[n] += times
            left[n] -= times
        row += times
        lengths = [n for n in lengths if left[n]]
    return out


def pack_corpus(df: DataFrame, length: int = MAX_SEQ_LEN, ids: str = "ids", buffer: int = 1000,
                crop: bool = True) -> DataFrame:
    """B7 over the whole table: ``pack``'s rows (row, n_tokens, n_cropped) of which at most one
    is short, however the table is partitioned.

    Every task packs full rows and leaves less than a row.  The tasks' length histograms (a
    row per task and length, lengths below a row's) are added up; rows are planned on the
    sum, and the running counts by task give each left sequence its place in them.  With
    ``crop=False`` the left sequences are laid end to end instead and cut at the row ends.
    Kept and cropped tokens are those of the input; null sequences count as empty."""
    cap, spark = length + 1, df.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        source = (list(d) for pdf in batches for d in pdf[ids] if d is not None and len(d))
        made = _full_rows(source, cap, buffer, crop)
        while some := list(itertools.islice(made, 256)):
            out = pd.DataFrame(some, columns=["row", "seq", "n_cropped"])
            yield out.assign(part=part, seq=out["seq"].astype("Int32"))[["part", "seq", "row", "n_cropped"]]

    # written once: full rows and leftovers must come from one run of the tasks
    made = keep_table(df.select(ids).mapInPandas(run, "part int, seq int, row array<int>, n_cropped int"), "packed")
    full = made.where("seq IS NULL").select("row", F.lit(cap).alias("n_tokens"), "n_cropped")
    left = made.where("seq IS NOT NULL").select("part", "seq", "row", F.size("row").alias("n"))
    if crop:
        hist = left.groupBy("part", "n").agg(F.count(F.lit(1)).alias("c"))
        before = hist.withColumn("before", F.sum("c").over(Window.partitionBy("n").orderBy("part")) - F.col("c"))
        total = hist.groupBy("n").agg(F.sum("c").alias("c")).collect()  # at most ``length`` rows
        plan = spark.createDataFrame(plan_rows({r["n"]: r["c"] for r in total}, cap),
                                     "n int, first long, last long, to_row long, slot int")
        rank = F.row_number().over(Window.partitionBy("part", "n").orderBy("seq")) - 1  # fewer tokens than a row
        at = left.withColumn("rank", rank).join(before.select("part", "n", "before"), ["part", "n"])
        at = at.withColumn("at", F.col("before") + F.col("rank")).join(F.broadcast(plan), "n").where(
            "at >= first AND at < last")  # the plan is bounded by the row length
        pieces = at.select((F.col("to_row") + F.col("at") - F.col("first")).alias("to_row"),
                           F.col("slot").cast("long").alias("slot"), "row")
    else:
        tokens = left.groupBy("part").agg(F.sum("n").alias("tokens"))
        starts = tokens.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
        inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")  # a row per task, less than a row
        at = left.withColumn("inside", inside).join(starts, "part").withColumn("start", F.col("base") + F.col("inside"))
        at = at.withColumn("to_row", F.explode(F.expr(f"sequence(start div {cap}, (start + n - 1) div {cap})")))
        pieces = at.select("to_row", F.col("start").alias("slot"), F.expr(
            f"slice(row, cast(greatest(to_row * {cap} - start, 0) as int) + 1, "
            f"cast(least((to_row + 1) * {cap} - start, n) - greatest(to_row * {cap} - start, 0) as int))").alias("row"))
    rest = pieces.groupBy("to_row").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("slot", "row"))), lambda x: x["row"])).alias("all"))
    n = F.least(F.size("all"), F.lit(cap))
    rest = rest.select(F.slice("all", 1, cap).alias("row"), n.alias("n_tokens"), (F.size("all") - n).alias("n_cropped"))
    return full.unionByName(rest)


def shift_targets(packed: DataFrame, row: str = "row") -> DataFrame:
    """B8 inputs = row[:-1], targets = row[1:]."""
    n = F.size(F.col(row))
    return packed.select(F.slice(F.col(row), 1, n - 1).alias("inputs"), F.slice(F.col(row), 2, n - 1).alias("targets"))


# ---------------------------------------------------------------- evaluation input

def unigram_nats(train_ids: DataFrame, val_ids: DataFrame, vocab: int, ids: str = "ids") -> DataFrame:
    """Per-token cross-entropy (nats) of the validation targets under an
    add-one unigram model of the training tokens; the probability table has
    one row per vocabulary entry (bounded by the vocabulary size)."""
    tr = train_ids.select(F.explode(F.slice(F.col(ids), 2, F.lit(1 << 30))).alias("token_id"))
    counts = tr.groupBy("token_id").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    probs = counts.select("token_id", F.log((F.col("c") + 1.0) / (total + vocab)).alias("lp"))
    unseen = -math.log(1.0 / (total + vocab))
    v = val_ids.select(F.explode(F.slice(F.col(ids), 2, F.lit(1 << 30))).alias("token_id"))
    return v.join(F.broadcast(probs), "token_id", "left").select(
        "token_id", F.coalesce(-F.col("lp"), F.lit(unseen)).alias("nats"))


def token_counts(df: DataFrame, ids: str = "ids") -> DataFrame:
    return df.select(F.explode(F.col(ids)).alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))

