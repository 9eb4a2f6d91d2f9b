"""Language-model scores: a Katz backoff bigram model with Good-Turing discounts.

Training and scoring are one pass of tables between *units* (a task's share of the
documents, token streams packed as numbers) and *buckets* (shares of the vocabulary or
of the bigrams):

1. units -> vocabulary buckets: training counts of every word;
2. buckets -> units: the counts of the unit's words, from which base scores follow;
3. units -> bigram buckets: the unit's distinct bigrams with their training counts; a
   bucket adds them up, counts counts for Good-Turing, and gathers per history what its
   backoff weight needs;
4. buckets -> units: the total of each of the unit's bigrams and the statistics of the
   histories that must back off; the unit evaluates every token: the discounted estimate
   if the bigram was seen, otherwise the history's weight times the unigram estimate.

Each table is written to the shared folder, partitioned by its bucket or unit.  Words are
told apart by 64-bit hashes.  Histories above a share of all tokens are split over buckets
by the following word and their statistics added up per history.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ids_and_texts, materialize, shuffle_partitions, split_words, text_batches

#: Hash of the token that ends a text.
END = np.uint64(1)
#: Counts up to this are discounted.
GT = 5
#: Bytes of text in a unit, and buckets per shuffle partition.
UNIT_BYTES = 8 << 20
VOCABULARY, BIGRAMS = 2, 6
#: A history with more than 1/(HOT * partitions) of all tokens is split.
HOT = 8


def pack(*arrays: np.ndarray) -> bytes:
    """Number arrays as one compressed string: bytes of equal weight stand together and
    leading zero bytes are left out."""
    head, body = [struct.pack("<i", len(arrays))], []
    for a in arrays:
        u = np.ascontiguousarray(a).astype(np.int64).view(np.uint64)
        width = (int(u.max()).bit_length() + 7) // 8 if len(u) else 0
        head.append(struct.pack("<qi", len(u), width))
        body.append(u.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<i", raw)[0]
    at, out = 4 + 12 * n, []
    for i in range(n):
        size, width = struct.unpack_from("<qi", raw, 4 + 12 * i)
        u = np.zeros((size, 8), np.uint8)
        u[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        at += size * width
        out.append(u.reshape(-1).view(np.int64))
    return out


_UNIT = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("body", pa.binary())])
_UNIT_SQL = "unit long, bucket int, ids array<long>, body binary"
_PART = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])
_PART_SQL = "unit long, bucket int, body binary"


def units(docs: DataFrame, buckets: int) -> DataFrame:
    """Token streams (bucket -1: text lengths, held-out flags, word numbers of the unit) and
    the unit's words by vocabulary bucket (hashes, training counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([h[0] for h in held])
            out = np.concatenate([h[1] for h in held])
            n = np.concatenate([h[2] for h in held])
            token = np.concatenate([h[3] for h in held])
            word, code = np.unique(token, return_inverse=True)
            bucket = (word % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = place[code]
            seen = np.bincount(code, weights=np.repeat(~out, n), minlength=len(word)).astype(np.int64)
            word, bucket = word[order].view(np.int64), bucket[order]
            unit = (task << 32) + seq
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            rows = [{"unit": unit, "bucket": -1, "ids": ids.to_pylist(), "body": pack(n, out, code)}]
            rows += [{"unit": unit, "bucket": int(bucket[s]), "ids": None, "body": pack(word[s:e], seen[s:e])}
                     for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_pylist(rows, schema=_UNIT)

        for b in text_batches(batches):
            words, n = split_words(b.column(1), lower=True)
            coded = words.dictionary_encode()
            known = np.fromiter((max(2, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))
                                 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            n = n + 1
            token = np.full(int(n.sum()), END, np.uint64)
            inner = np.ones(len(token), bool)
            inner[np.cumsum(n) - 1] = False
            if len(words):
                token[inner] = known[np.asarray(coded.indices)]
            held.append((b.column(0), np.asarray(b.column(2).cast(pa.int8()), dtype=np.int8).astype(bool), n, token))
            size += int(b.column(1).nbytes)
            if size >= UNIT_BYTES:
                yield from flush()
                held, size, seq = [], 0, seq + 1
        if held:
            yield from flush()

    return docs.mapInArrow(run, _UNIT_SQL)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"unit": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int32()),
                     "body": pa.array([r[2] for r in rows], pa.binary())}, schema=_PART)


def count_words(table: DataFrame, buckets: int) -> DataFrame:
    """Per unit and bucket the numbers and training counts of the unit's words; as unit -1
    the bucket's tokens and distinct words."""
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        body = [unpack(x) for x in group.column("body").to_pylist()]
        word, code = np.unique(np.concatenate([b[0] for b in body]), return_inverse=True)
        count = np.bincount(code, weights=np.concatenate([b[1] for b in body]), minlength=len(word)).astype(np.int64)
        rank = np.empty(len(word), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(word))
        number = 1 + rank * buckets + bucket
        at = np.cumsum([0] + [len(b[0]) for b in body])
        rows = [(u, bucket, pack(number[code[s:e]], count[code[s:e]]))
                for u, s, e in zip(group.column("unit").to_pylist(), at[:-1].tolist(), at[1:].tolist())]
        return _rows(rows + [(-1, bucket, pack(np.array([count.sum(), (count > 0).sum()])))])

    return table.filter("bucket >= 0").groupBy("bucket").applyInArrow(run, _PART_SQL)


@dataclass
class Totals:
    """Of the training part: tokens, distinct words, documents."""
    tokens: int
    words: int
    docs: int
    limit: int
    buckets: int

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.words + 1)


class Unit:
    """The tokens of a unit with the counts of its words, and its distinct bigrams in the
    order in which the bigram buckets see them."""

    def __init__(self, stream: bytes, words: list[tuple[int, bytes]], t: Totals):
        self.n, held, self.code = unpack(stream)
        self.held = held.astype(bool)
        parts = [unpack(body) for _, body in sorted(words, key=lambda x: x[0])]
        # the start of a text is a history of its own, number 0
        self.number = np.concatenate([p[0] for p in parts] + [np.zeros(1, np.int64)])
        self.count = np.concatenate([p[1] for p in parts] + [np.array([t.docs])])
        size = len(self.number)
        first = np.cumsum(self.n) - self.n
        before = np.concatenate([[size - 1], self.code[:-1]])
        before[first] = size - 1
        kind, inverse = np.unique(before * size + self.code, return_inverse=True)
        train = np.repeat(~self.held, self.n)
        seen = np.bincount(inverse, weights=train, minlength=len(kind)).astype(np.int64)
        h, w = kind // size, kind % size
        # a history that training has never seen passes straight to the unigrams
        known = self.count[h] > 0
        spread = 1 + self.count[h] // t.limit
        bucket = np.where(known, (self.number[h] * 31 + (self.number[w] % spread) * 7919) % t.buckets, t.buckets)
        order = np.lexsort((self.number[w], self.number[h], bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.kind = place[inverse]                      # bigram of every token
        self.h, self.w, self.seen = h[order], w[order], seen[order]
        self.bucket, self.known, self.hot = bucket[order], known[order], spread[order] > 1
        edge = np.concatenate([[0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(order)]])
        self.slices = [(int(self.bucket[s]), s, e) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())
                       if e > s and self.bucket[s] < t.buckets]


def send_bigrams(table: DataFrame, words: DataFrame, t: Totals) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows([])
        u = Unit(left.column("body")[0].as_py(), list(zip(right.column("bucket").to_pylist(),
                                                          right.column("body").to_pylist())), t)
        unit = left.column("unit")[0].as_py()
        rows = []
        for bucket, s, e in u.slices:
            h = u.number[u.h[s:e]]
            rows.append((unit, bucket, pack(np.diff(h, prepend=0), u.number[u.w[s:e]], u.count[u.w[s:e]],
                                            u.seen[s:e], u.hot[s:e])))
        return _rows(rows)

    return table.filter("bucket = -1").select("unit", "body").groupBy("unit").cogroup(
        words.filter("unit >= 0").groupBy("unit")).applyInArrow(run, _PART_SQL)


def count_bigrams(bigrams: DataFrame) -> DataFrame:
    """Per unit and bucket: totals of the unit's bigrams, per history whether none of its
    counts is discounted, and the backoff statistics of histories with unseen bigrams.
    As unit -1 the bucket's counts of counts, as unit -2 its share of split histories."""
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        body = [unpack(x) for x in group.column("body").to_pylist()]
        at = np.cumsum([0] + [len(b[0]) for b in body])
        h = np.concatenate([np.cumsum(b[0]) for b in body])
        w, cw, seen, hot = (np.concatenate([b[i] for b in body]) for i in (1, 2, 3, 4))
        order = np.lexsort((w, h))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        lead = order[new]
        total = np.bincount(kind, weights=seen).astype(np.int64)
        kh, khot = h[lead], hot[lead].astype(bool)
        history, hcode = np.unique(kh, return_inverse=True)
        few = np.stack([np.bincount(hcode, weights=total == r, minlength=len(history)) for r in range(1, GT + 1)]).astype(np.int64)
        mass = np.bincount(hcode, weights=np.where(total > 0, cw[lead] + 1, 0), minlength=len(history)).astype(np.int64)
        plain = (few.sum(0) == 0).astype(np.int64)
        rows = []
        for u, s, e in zip(group.column("unit").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            k = kind[s:e]
            own, inner = np.unique(hcode[k], return_inverse=True)
            need = np.bincount(inner, weights=total[k] == 0) > 0
            stats = own[need]
            rows.append((u, bucket, pack(total[k], plain[own], need, mass[stats], *few[:, stats])))
        rows.append((-1, bucket, pack(np.array([np.sum(total == r) for r in range(1, GT + 2)]))))
        wide = np.unique(hcode[khot])
        if len(wide):
            rows.append((-2, bucket, pack(history[wide], mass[wide], *few[:, wide])))
        return _rows(rows)

    return bigrams.groupBy("bucket").applyInArrow(run, _PART_SQL)


def good_turing(counts: np.ndarray) -> np.ndarray:
    """Discount factors of the counts 0 to GT (0 and 1 unused): Katz's formula, or half an
    occurrence off where the counts of counts give none between 0 and 1."""
    d = np.ones(GT + 1)
    n = [0, *[float(x) for x in counts]]
    rest = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


@dataclass
class Discounts:
    factor: np.ndarray
    hot: dict[int, np.ndarray]      # split history: mass, counts of its counts


def probabilities(u: Unit, answers: list[tuple[int, bytes]], t: Totals, d: Discounts) -> np.ndarray:
    """log10 probability of every distinct bigram of the unit."""
    p = t.unigram(u.count[u.w]).astype(np.float64)
    body = dict(answers)
    weight = np.arange(1, GT + 1)
    for bucket, s, e in u.slices:
        total, plain, need, mass, *few = unpack(body[bucket])
        hs, inner = np.unique(u.number[u.h[s:e]], return_inverse=True)
        few = np.stack(few)
        full_few, full_mass = np.zeros((GT, len(hs)), np.int64), np.zeros(len(hs), np.int64)
        need = need.astype(bool)
        full_few[:, need], full_mass[need] = few, mass
        plain = plain.astype(np.int64)
        for i in np.unique(inner[u.hot[s:e]]).tolist():
            x = d.hot[int(hs[i])]
            full_mass[i], full_few[:, i] = x[0], x[1:]
            plain[i] = int(x[1:].sum() == 0)
        count = np.zeros(len(hs), np.int64)
        count[inner] = u.count[u.h[s:e]]
        # a history without discounted counts gives up one occurrence of one more
        whole = count + plain
        low = (weight[:, None] * full_few).sum(0)
        left = 1 - ((weight * d.factor[1:]) @ full_few + (count - low)) / np.maximum(whole, 1)
        rest = 1 - full_mass / (t.tokens + t.words + 1)
        alpha = left / rest
        factor = np.where(total <= GT, d.factor[np.minimum(total, GT)], 1.0)
        p[s:e] = np.where(total > 0, factor * total / whole[inner], alpha[inner] * p[s:e])
    return np.log10(p)


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10 probabilities of the text: add-one unigrams, Katz
    bigrams).  ``training`` is a boolean Column over ``id``; the model learns from those rows.

    A-Z are lower-cased; tokens are the words and one end per text, so null and empty texts
    have one token.  Rows that repeat an id count and are scored one by one; without
    training rows every token has the estimate of an unknown word.  Extra columns are ignored."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    src = ids_and_texts(docs, id_col, text_col).withColumn("out", ~F.coalesce(training, F.lit(False)))
    table = materialize(units(src, parts * VOCABULARY), "lm-units")
    words = materialize(count_words(table, parts * VOCABULARY), "lm-words")
    tokens = distinct = 0
    for r in words.filter("unit = -1").select("body").toLocalIterator():
        a = unpack(r["body"])[0]
        tokens, distinct = tokens + int(a[0]), distinct + int(a[1])
    train_docs = src.filter("NOT out").count()
    t = Totals(tokens, distinct, train_docs, max(1, tokens // (HOT * parts)), parts * BIGRAMS)
    answers = materialize(count_bigrams(send_bigrams(table, words, t)), "lm-bigrams")
    counts, hot = np.zeros(GT + 1, np.int64), {}
    # counts of counts per bucket; split histories number at most HOT * partitions
    for r in answers.filter("unit < 0").select("unit", "body").toLocalIterator():
        x = unpack(r["body"])
        if r["unit"] == -1:
            counts += x[0]
            continue
        for i, h in enumerate(x[0].tolist()):
            own = np.array([a[i] for a in x[1:]])
            hot[h] = hot.get(h, 0) + own
    d = Discounts(good_turing(counts), hot)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                            ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not left.num_rows:
            return schema.empty_table()
        rows = list(zip(right.column("which").to_pylist(), right.column("bucket").to_pylist(),
                        right.column("body").to_pylist()))
        u = Unit(left.column("body")[0].as_py(), [(b, x) for k, b, x in rows if k == 0], t)
        p = probabilities(u, [(b, x) for k, b, x in rows if k == 1], t, d)
        first = np.cumsum(u.n) - u.n
        own = u.count[u.code]
        return pa.table([left.column("ids")[0].values, pa.array(u.held), pa.array(u.n),
                         pa.array(np.add.reduceat((own > 0).astype(np.int64), first)),
                         pa.array(np.add.reduceat(np.log10(t.unigram(own)), first)),
                         pa.array(np.add.reduceat(p[u.kind], first))], schema=schema)

    both = words.filter("unit >= 0").withColumn("which", F.lit(0)).unionAll(
        answers.filter("unit >= 0").withColumn("which", F.lit(1)))
    out = table.filter("bucket = -1").groupBy("unit").cogroup(both.groupBy("unit")).applyInArrow(
        run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                      F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
