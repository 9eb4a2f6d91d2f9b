"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if the runs of tokens they share, as long
as the shortest tile, cover enough of the item: the longest matches that overlap no
earlier one are marked again and again, found by running Karp-Rabin hashes of falling
length, until none of the least length is left.
The share of an item's tokens that its tiles cover does not depend on their order, so
shuffled passages are caught like straight ones.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, ids_and_texts, text_batches

TOKEN = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


@dataclass(frozen=True)
class Config:
    """``block_tokens`` bounds the part of the benchmark that is broadcast at a time; a
    larger benchmark is taken in several blocks against all documents."""
    tile: int = 3
    coverage: float = 0.8
    block_tokens: int = 2_000_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _rolling(x: Sequence[int], marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(hash, position) of every unmarked stretch of ``size`` tokens."""
    top = pow(_BASE, size, _MOD)
    h = run = 0
    for i, v in enumerate(x):
        if marked[i] or v < 0:
            h = run = 0
            continue
        h = (h * _BASE + v + 1) % _MOD
        run += 1
        if run > size:
            h = (h - (x[i - size] + 1) * top) % _MOD
        if run >= size:
            yield h, i - size + 1


def greedy_tiles(item: Sequence[int], text: Sequence[int], least: int, first: int = 20) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length) of running-Karp-Rabin greedy string
    tiling; negative tokens of ``text`` match nothing."""
    if not item or not text:
        return []
    in_item, in_text = bytearray(len(item)), bytearray(len(text))
    out: list[tuple[int, int, int]] = []
    size = max(least, min(first, len(item)))
    while True:
        index: dict[int, list[int]] = defaultdict(list)
        for h, p in _rolling(item, in_item, size):
            index[h].append(p)
        longest, matches = 0, []
        if index:
            for h, t in _rolling(text, in_text, size):
                for p in index.get(h, ()):
                    # a match that could start one token earlier has been extended from there
                    if (p and t and item[p - 1] == text[t - 1] and not in_item[p - 1] and not in_text[t - 1]):
                        continue
                    n = 0
                    while (p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n]
                           and not in_item[p + n] and not in_text[t + n]):
                        n += 1
                    if n >= size:
                        matches.append((n, p, t))
                        longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        heap = [(-n, p, t) for n, p, t in matches]
        heapq.heapify(heap)
        while heap:
            n, p, t = heapq.heappop(heap)
            free = [not (in_item[p + k] or in_text[t + k]) for k in range(-n)]
            if all(free):
                in_item[p:p - n] = b"\1" * -n
                in_text[t:t - n] = b"\1" * -n
                out.append((p, t, -n))
                continue
            k = 0       # what earlier tiles left of it goes back if it is long enough
            while k < -n:
                e = k
                while e < -n and free[e]:
                    e += 1
                if e - k >= size:
                    heapq.heappush(heap, (k - e, p + k, t + k))
                k = e + 1
        if size <= least or all(in_item):
            return out
        size = max(least, size // 2)


class Index:
    """A block of benchmark items: token numbers and where in the items a seed stands.

    A seed has as many tokens as the shortest tile of its item, so every tile is made of
    shared seeds and no pair that could reach the threshold goes unseen."""

    def __init__(self, items: list[tuple[int | None, str | None]], cfg: Config):
        self.cfg = cfg
        self.code: dict[str, int] = {}
        self.items: list[tuple[int | None, list[int]]] = []
        for item_id, text in items:
            ids = [self.code.setdefault(w, len(self.code)) for w in tokens(text)]
            if ids:
                self.items.append((item_id, ids))
        self.size = np.array([len(ids) for _, ids in self.items], np.int64)
        self.least = np.minimum(cfg.tile, self.size)    # an item shorter than a tile is a tile itself
        owner = np.repeat(np.arange(len(self.items)), self.size)
        flat = np.fromiter((w for _, ids in self.items for w in ids), np.int64, int(self.size.sum()))
        #: by seed length: seed hashes, where the places of each begin, places in all items' tokens, their items
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.least).tolist():
            h = seed_hash(flat, n)
            place = np.flatnonzero((owner[:len(h)] == owner[n - 1:]) & (self.least[owner[:len(h)]] == n))
            place = place[np.argsort(h[place], kind="stable")]
            known, begin = np.unique(h[place], return_index=True)
            self.seeds[n] = known, np.append(begin, len(place)), place, owner

    def encode(self, text: str | None) -> np.ndarray:
        get = self.code.get
        words = tokens(text)
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items of which seeds shared with the tokens (-1: in no item) cover the threshold;
        tiles cover no other positions, so the rest cannot reach it."""
        out: list[int] = []
        for n, (known, begin, place, owner) in self.seeds.items():
            if len(ids) < n:
                continue
            inside = np.concatenate([[0], np.cumsum(ids >= 0)])
            whole = inside[n:] - inside[:-n] == n
            if not whole.any():
                continue
            h = np.unique(seed_hash(ids, n)[whole])
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            at = at[known[at] == h]
            if not len(at):
                continue
            times = begin[at + 1] - begin[at]
            first = np.repeat(begin[at] - np.cumsum(times) + times, times)
            hit = np.sort(place[first + np.arange(len(first))])
            # the last seed of an item ends before the next item begins
            new = np.minimum(np.diff(hit, append=hit[-1] + n), n)
            covered = np.bincount(owner[hit], new, len(self.items))
            out += np.flatnonzero((covered > 0) & (covered >= self.cfg.coverage * self.size - 1e-9)).tolist()
        return sorted(out)

    def match(self, text: str | None) -> Iterator[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
        """(item id, tokens covered, tokens of the item, tiles) of the items whose coverage
        reaches the threshold."""
        ids = self.encode(text)
        for k in self.candidates(ids):
            item_id, item = self.items[k]
            least = int(self.least[k])
            # only stretches of the item's own tokens can hold a tile
            own = np.isin(ids, item)
            edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = ends - starts >= least
            part: list[int] = []
            place: list[int] = []
            for s, e in zip(starts[long].tolist(), ends[long].tolist()):
                part += [*ids[s:e].tolist(), -1]
                place += [*range(s, e), -1]
            tiles = greedy_tiles(item, part, least)
            covered = sum(n for _, _, n in tiles)
            if covered and covered >= self.cfg.coverage * len(item) - 1e-9:
                yield item_id, covered, len(item), [(p, place[t], n) for p, t, n in sorted(tiles)]


def seed_hash(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive token numbers."""
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(max(0, len(x) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[j:j + len(h)]
    return h


_ROW = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_tokens", pa.int64()),
                  ("tiles", pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()),
                                                ("length", pa.int64())])))])


def _blocks(spark, benchmark: DataFrame, cfg: Config, item_col: str, text_col: str) -> Iterator:
    """The benchmark as indexes of bounded size (each goes to the tasks with their function)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"),
                             F.col(f"`{text_col}`").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (4 * cfg.block_tokens)))
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()   # a bounded block
        block.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        yield Index([(r["item_id"], r["text"]) for r in block], cfg)


def contamination(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config(), id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and benchmark item whose coverage reaches the threshold:
    id, item id, ``covered`` and ``item_tokens`` (tokens), ``coverage``, ``tiles`` (array of
    item_start, doc_start, length in tokens).

    Tokens are lower-cased runs of letters, digits and underscores.  Null and empty texts
    and items without tokens match nothing; an item shorter than a tile needs all its
    tokens in a row once; repeated rows and items give rows of their own; ties between
    equally long matches go to the earlier one in the item, then in the document."""
    spark = docs.sparkSession
    src = ids_and_texts(docs, id_col, text_col)
    out = None
    for index in _blocks(spark, benchmark, cfg, item_col, item_text_col):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = ("item_start", "doc_start", "length")
            for b in text_batches(batches):
                rows = []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item_id, covered, size, tiles in index.match(text):
                        rows.append({"id": i, "item_id": item_id, "covered": covered, "item_tokens": size,
                                     "tiles": [dict(zip(names, t)) for t in tiles]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

        part = src.mapInArrow(run, "id long, item_id long, covered long, item_tokens long, "
                                   "tiles array<struct<item_start: long, doc_start: long, length: long>>")
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "covered", "item_tokens",
                      (F.col("covered") / F.col("item_tokens")).alias("coverage"), "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config(), text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The input rows, all columns, whose text covers no benchmark item up to the threshold."""
    bounded_batches(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema
    for index in _blocks(docs.sparkSession, benchmark, cfg, item_col, item_text_col):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in text_batches(batches, text_col):
                yield b.filter(pa.array([next(index.match(t), None) is None for t in b.column(at).to_pylist()]))

        docs = docs.mapInArrow(run, schema)
    return docs
