"""Ranked lexical search over a length-stratified index.

Documents of one normaliser m form a stratum, and only m and a term's count tf decide what
a posting adds: its impact is computed once per (m, tf) and shared by all postings of that
list.  The largest impacts of a stratum bound what any of its documents can score for a
query; strata are visited by falling bound, and a query stops where the bound falls below
its current k-th score.

The index is a table in the shared folder: per document its number of terms and the
occurrences of the queries' terms.  Counts over it give the statistics of the whole corpus;
dealt out by m (a large stratum over several tasks), it is searched a block at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, ids_and_texts, materialize, plain_texts, text_batches
from quarry.operators.stats import top_k_per_group

# fixed values: terms are runs of ASCII letters and digits and of all characters beyond ASCII
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytearray(range(256))
for _c in _SEPARATORS:
    _TABLE[_c] = 0x20
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] += 32
_TABLE = bytes(_TABLE)


@dataclass(frozen=True)
class Config:
    """``block_terms`` and ``block_items`` bound the queries that are searched at a time and
    their distinct terms (a larger set of queries takes several rounds over the documents);
    ``block_postings`` the part of the index that a task holds."""
    top: int = 20
    block_terms: int = 20_000
    block_items: int = 500
    block_postings: int = 4_000_000


def terms(text: str | bytes | None) -> list[bytes]:
    """The terms of a text as UTF-8, A-Z lower-cased, in order."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def normaliser(n, n_docs: int, total: int):
    """m of documents of ``n`` terms."""
    return 100 - 25 + (25 * n * n_docs) // total


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, term array, tf array): a row per document that has terms, with the counts of
    the vocabulary's terms (as positions in it)."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for b in text_batches(batches):
            texts = plain_texts(b.column(1))
            edge = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1).tolist()
            data = texts.buffers()[2]
            data = data.to_pybytes().translate(_TABLE) if data else b""
            n, size, term, tf = [], [0], [], []
            for s, e in zip(edge, edge[1:]):
                words = data[s:e].split()
                n.append(len(words))
                found = Counter(map(get, words))
                found.pop(None, None)
                term.extend(found)
                tf.extend(found.values())
                size.append(len(term))
            size = pa.array(size, pa.int32())
            out = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(size, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(size, pa.array(tf, pa.int64()))], names=["id", "n", "term", "tf"])
            yield out.filter(pa.compute.greater(out.column(1), 0))

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "id long, n long, term array<int>, tf array<long>")


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, last), one after the other."""
    size = last - first
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Stratified:
    """A block of documents grouped by m, with a posting list per (term, stratum, tf)."""

    def __init__(self, m: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        self.m, stratum = np.unique(m, return_inverse=True)
        layer = stratum[owner]
        order = np.lexsort((tf, layer, term))
        self.owner, tf, term, layer = owner[order], tf[order], term[order], layer[order]
        # a list starts where term, stratum or tf changes; its impact is computed here, once
        group = np.ones(len(order), bool)
        group[1:] = (layer[1:] != layer[:-1]) | (term[1:] != term[:-1])
        new = group.copy()
        new[1:] |= tf[1:] != tf[:-1]
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], len(order))
        self.layer = layer[self.begin]
        self.impact = impact(tf[self.begin], self.m[self.layer])
        # lists of a term in a stratum go by rising tf: the last has the largest impact
        last = np.append(np.flatnonzero(group[self.begin])[1:], len(self.begin)) - 1
        self.most_layer, self.most = self.layer[last], self.impact[last]
        edges = np.arange(n_terms + 1)
        self.list_of = np.searchsorted(term[self.begin], edges)
        self.most_of = np.searchsorted(term[self.begin][last], edges)
        self.size = np.bincount(stratum, minlength=len(self.m))
        self.n_docs = len(m)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """At least what any document of a stratum scores, per stratum."""
        a, b = self.most_of[terms], self.most_of[terms + 1]
        at = _ranges(a, b)
        top = np.bincount(self.most_layer[at], np.repeat(weights, b - a) * self.most[at].astype(float), len(self.m))
        return top * (1 + 1e-9)     # sums of doubles: a little high, never low

    def scores(self, strata: np.ndarray, terms: np.ndarray, weights: np.ndarray, exact: bool) -> np.ndarray:
        """Score of every document in the marked strata (0 elsewhere)."""
        a, b = self.list_of[terms], self.list_of[terms + 1]
        at, w = _ranges(a, b), np.repeat(weights, b - a)
        hit = strata[self.layer[at]]
        at, w = at[hit], w[hit]
        docs = self.owner[_ranges(self.begin[at], self.end[at])]
        add = np.repeat(w * self.impact[at], self.end[at] - self.begin[at])
        if exact:       # below 2^53 sums of doubles are those of the integers
            return np.bincount(docs, add.astype(float), self.n_docs).astype(np.int64)
        out = np.zeros(self.n_docs, np.int64)
        np.add.at(out, docs, add)
        return out


class Top:
    """The k best documents of a query so far: score, then id, those without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A document scoring less cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, id_: np.ndarray, none: np.ndarray) -> None:
        parts = [np.concatenate(x) for x in ((self.score, score), (self.id, id_), (self.none, none))]
        best = np.lexsort((parts[1], parts[2], -parts[0]))[:self.k]
        self.score, self.id, self.none = (x[best] for x in parts)


def search_block(block: Stratified, ids: np.ndarray, none: np.ndarray, queries: list[tuple], tops: list[Top]) -> int:
    """Bring each query's ``tops`` up to date with a block; number of strata visited.

    Strata come by falling bound, few documents first, then more at a time."""
    visits = 0
    for (terms, weights), top in zip(queries, tops):
        if not len(terms):
            continue
        bounds = block.bounds(terms, weights)
        order = np.argsort(-bounds, kind="stable")
        upto = np.cumsum(block.size[order])
        exact, at, take = bounds[order[0]] < 2 ** 53, 0, 4 * top.k
        while at < len(order) and bounds[order[at]] >= top.least():
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + take, "right")))
            chosen = order[at:end]
            chosen = chosen[bounds[chosen] >= top.least()]
            visits += len(chosen)
            strata = np.zeros(len(order), bool)
            strata[chosen] = True
            score = block.scores(strata, terms, weights, exact)
            docs = np.flatnonzero(score >= top.least())
            top.add(score[docs], ids[docs], none[docs])
            at, take = end, 4 * take
    return visits


def _searcher(queries: list[tuple], n_terms: int, cfg: Config) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(cfg.top) for _ in queries]

        def finish(held: list[pa.RecordBatch]) -> None:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            size = np.asarray(pa.compute.list_value_length(b.column(2)), dtype=np.int64)
            owner = np.repeat(np.arange(b.num_rows), size)
            term = np.asarray(b.column(2).flatten(), dtype=np.int64)
            block = Stratified(np.asarray(b.column(1)), owner, term, np.asarray(b.column(3).flatten()), n_terms)
            none = np.asarray(b.column(0).is_null())
            search_block(block, np.asarray(b.column(0).fill_null(0)), none, queries, tops)

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += len(b.column(2).flatten())
            if size >= cfg.block_postings:
                finish(held)
                held, size = [], 0
        if size:
            finish(held)
        if queries:
            size = [len(t.score) for t in tops]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(tops)), size)), pa.array(np.concatenate([t.id for t in tops]),
                                                                         mask=np.concatenate([t.none for t in tops])),
                 pa.array(np.concatenate([t.score for t in tops]))], names=["query", "id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents for every item: item id, ``rank`` (from 1), document id, ``score``.

    Scores above 0 only, equal ones by ascending document id (a null id comes last; rows
    that repeat an id are documents of their own).  Null and empty texts have no terms and
    are not found; an item without terms, or whose terms no document holds, has no rows;
    items that repeat an id or a text have rows each.  Extra columns are ignored.  The
    items are taken in blocks of a bounded number of terms, read from their table one
    after the other; all documents are searched for each block."""
    bounded_batches(docs.sparkSession)
    src = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    out = None
    for block in _blocks(src.toLocalIterator(prefetchPartitions=False), cfg):
        found = _search(docs, block, cfg, id_col, text_col)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item long, rank int, id long, score long")
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id_col), "score")


def _blocks(rows: Iterator, cfg: Config) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with their terms, as many at a time as the bounds allow (one at least)."""
    held, seen = [], set()
    for r in rows:
        own = Counter(terms(r["text"]))
        if len(held) == cfg.block_items or held and len(seen | own.keys()) > cfg.block_terms:
            yield held
            held, seen = [], set()
        held.append((r["item"], own))
        seen |= own.keys()
    if held:
        yield held


def _search(docs: DataFrame, block: list[tuple[int | None, Counter]], cfg: Config, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*(own.keys() for _, own in block)))
    number = {w: i for i, w in enumerate(vocabulary)}
    table = materialize(index(docs, vocabulary, id_col, text_col), "search-index")
    all_ = table.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not all_["n"]:
        return spark.createDataFrame([], "item long, rank int, id long, score long")
    df = dict(table.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect())
    queries = []
    for _, own in block:
        pairs = [(number[w], c * weight(all_["n"], df[number[w]])) for w, c in own.items() if number[w] in df]
        queries.append(tuple(np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ()))))
    m = F.lit(100 - 25) + F.expr(f"(25 * n * {all_['n']}) div {all_['l']}")
    dealt = (table.select("id", m.alias("m"), "term", "tf").filter(F.size("term") > 0)
             .repartitionByRange("m", F.xxhash64("id", "term")))
    best = dealt.select("id", "m", "term", "tf").mapInArrow(_searcher(queries, len(vocabulary), cfg),
                                                            "query long, id long, score long")
    best = materialize(best, "search-best")
    # a bounded number of rows per query and task
    first = [F.desc("score"), F.col("id").asc_nulls_last()]
    ranked = top_k_per_group(best, ["query"], first, cfg.top, rank_name="rank")
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query long, item long")
    return ranked.join(F.broadcast(names), "query").select("item", F.col("rank").cast("int").alias("rank"), "id", "score")
