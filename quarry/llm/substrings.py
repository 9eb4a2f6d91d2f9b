"""Exact removal of repeated passages by super-k-mer partitioning.

Every window of ``k`` consecutive words has a minimiser: the smallest hash of its
``m``-word shingles.  Consecutive windows with the same minimiser travel together as
one packed string to the bucket of that minimiser, so equal windows always meet and a
word is shipped about three times instead of ``k`` times.  In its bucket the windows
of all strings are sorted and equal ones compared word by word.

Buckets that a very common passage overfills (measured over all data first) are not
sent to one task: of their windows every batch reports its first place, the least of
these is found by an aggregate that combines before the shuffle, and comes back to the
occurrences, which stay spread over the batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import (BATCH_BYTES, ids_and_texts, materialize, shuffle_partitions, split_words,
                               text_batches)

#: Buckets per shuffle partition: one bucket is what a task holds in memory at a time.
BUCKETS_PER_PARTITION = 24
#: What one occurrence of a string weighs in a bucket (20 bytes), in words.
OCCURRENCE_WORDS = 4
#: Windows whose first place may be sent to all tasks (those in the most batches).
HEAVY_WINDOWS = 10_000
#: Stands for a null id (such rows count as one document, after all others).
NO_ID = (1 << 63) - 1
#: Up to so many repeated ids are sent to the tasks; with more, every row gets a key.
KEYED_IDS = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values (by doubling), ``len(h) - n + 1`` long."""
    out, done = None, 0
    power, width = h, 1
    with np.errstate(over="ignore"):
        while done < n:
            if n & width:
                part = power[done:]
                out = part if out is None else _mix(out[:len(part)] * _BASE + part)
                done += width
            if done < n:
                power = _mix(power[:-width] * _BASE + power[width:]) if len(power) > width else power[:0]
                width *= 2
    return out[:max(0, len(h) - n + 1)]


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width, out = 1, x
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        width += step
    return out


class Windows:
    """The words of a batch of texts and its super-k-mers."""

    def __init__(self, texts: pa.Array, k: int, m: int):
        self.words, self.n = split_words(texts)
        self.first = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        coded = self.words.dictionary_encode()
        self.code = np.asarray(coded.indices, dtype=np.int64)
        seen = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in coded.dictionary.to_pylist()),
                           np.uint64, len(coded.dictionary))
        self.hash = seen[self.code] if len(seen) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        least = _sliding_min(_mix(_run_hash(self.hash, m)), k - m + 1)
        at = np.flatnonzero(owner[:len(least)] == owner[k - 1:][:len(least)]) if len(least) else np.zeros(0, np.int64)
        own, val = owner[at], least[at]
        new = np.ones(len(at), bool)
        new[1:] = (val[1:] != val[:-1]) | (own[1:] != own[:-1])
        cut = np.flatnonzero(new)
        self.start = at[cut]                                    # first window
        self.count = np.diff(np.append(cut, len(at)))           # windows
        self.owner, self.key = own[cut], val[cut]

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words joined by one space, and the offset of every word in it."""
        if not len(self.words):
            return b"", np.zeros(1, np.int64)
        one = pa.ListArray.from_arrays(pa.array([0, len(self.words)], pa.int32()), self.words)
        text = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py().encode("utf-8", "surrogatepass")
        size = np.asarray(pc.binary_length(self.words), dtype=np.int64) + 1
        return text, np.concatenate([[0], np.cumsum(size)])


def _bucket_sizes(docs: DataFrame, k: int, m: int, parts: int) -> DataFrame:
    """(part, words): words of the distinct super-k-mers of each batch and the weight of their
    occurrences, summed; ``words`` has an entry for each of the ``BUCKETS_PER_PARTITION``
    buckets of a part."""
    width = BUCKETS_PER_PARTITION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, width), np.int64)
        for b in text_batches(batches):
            w = Windows(b.column(1), k, m)
            if not len(w.start):
                continue
            with np.errstate(over="ignore"):
                run_sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(_run_hash(w.hash, k)))])
                content = run_sum[w.start + w.count] - run_sum[w.start]
            _, once = np.unique(content, return_index=True)
            bucket = (w.key % np.uint64(parts * width)).astype(np.int64)
            np.add.at(total.reshape(-1), bucket[once], w.count[once] + k - 1)
            total.reshape(-1)[:] += OCCURRENCE_WORDS * np.bincount(bucket, minlength=parts * width)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].tolist(), pa.list_(pa.int64()))],
                                         names=["part", "words"])

    rows = docs.mapInArrow(run, "part long, words array<long>")
    return rows.groupBy("part").agg(F.array(*[F.sum(F.col("words")[i]) for i in range(width)]).alias("words"))


def _row_keys(ids: np.ndarray, texts: pa.Array, keyed: np.ndarray | None) -> np.ndarray:
    """What tells rows of one id apart: a hash of the text for rows with a ``keyed`` id (all
    rows if None), 0 for the others.  Rows equal in id and text have equal ranges."""
    at = np.arange(len(ids)) if keyed is None else np.flatnonzero(np.isin(ids, keyed))
    out = np.zeros(len(ids), np.uint64)
    for i in at.tolist():
        out[i] = xxhash.xxh64_intdigest((texts[i].as_py() or "").encode("utf-8", "surrogatepass"))
    return out.view(np.int64)


def _keyed_ids(docs: DataFrame) -> np.ndarray | None:
    """Ids that more than one row may hold, null among them; None if they are too many to send."""
    many = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("id")
    ids = [r["id"] for r in many.filter(F.col("id") != NO_ID).limit(KEYED_IDS + 1).collect()]
    return None if len(ids) > KEYED_IDS else np.array([*ids, NO_ID], np.int64)


def _pack(docs: DataFrame, k: int, m: int, buckets: int, hot: np.ndarray, keyed: np.ndarray | None = None) -> DataFrame:
    """(bucket, packed): per batch and bucket the distinct super-k-mers and where they occur,
    but for the ``hot`` buckets."""
    hot_set = np.asarray(hot, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in text_batches(batches):
            w = Windows(b.column(1), k, m)
            if not len(w.start):
                continue
            bucket = (w.key % np.uint64(buckets)).astype(np.int64)
            start, count, owner = w.start, w.count, w.owner
            if len(hot_set):
                stay = ~np.isin(bucket, hot_set)
                start, count, owner, bucket = start[stay], count[stay], owner[stay], bucket[stay]
                if not len(start):
                    continue
            text, offset = w.joined()
            ids = np.asarray(b.column(0).fill_null(NO_ID), dtype=np.int64)
            row = _row_keys(ids, b.column(1), keyed)[owner]
            ids = ids[owner]
            begin = (start - w.first[owner]).astype(np.int32)
            names: dict[bytes, int] = {}
            code = np.fromiter((names.setdefault(text[s:e], len(names)) for s, e in
                                zip(offset[start].tolist(), (offset[start + count + k - 1] - 1).tolist())),
                               np.int64, len(start))
            strings = list(names)
            order = np.lexsort((code, bucket))
            code_o, bucket_o = code[order], bucket[order]
            ids_o, row_o, begin_o = ids[order], row[order], begin[order]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket_o)) + 1, [len(order)]])
            out_bucket, out = [], []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                c = code_o[s:e]
                head = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
                times = np.diff(np.append(head, e - s)).astype(np.int32)
                body = b"\n".join([strings[i] for i in c[head].tolist()])
                raw = b"".join([np.array([len(head), e - s], np.int32).tobytes(), times.tobytes(),
                                ids_o[s:e].tobytes(), row_o[s:e].tobytes(), begin_o[s:e].tobytes(), body])
                out_bucket.append(int(bucket_o[s]))
                out.append(press.compress(raw))
            for s in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket[s:s + 4096], pa.int64()),
                                                  pa.array(out[s:s + 4096], pa.binary())], names=["bucket", "packed"])

    return docs.mapInArrow(run, "bucket long, packed binary")


def _hot_windows(docs: DataFrame, k: int, m: int, buckets: int, hot: np.ndarray,
                 keyed: np.ndarray | None = None) -> DataFrame:
    """(window, id, start, places): the distinct windows of each batch that belong to ``hot``
    buckets, as 128-bit digests, with their first place in the batch and all places there."""
    hot_set = np.asarray(hot, np.int64)
    place = pa.struct([("id", pa.int64()), ("row", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            w = Windows(b.column(1), k, m)
            wide = np.isin((w.key % np.uint64(buckets)).astype(np.int64), hot_set) if len(w.start) else np.zeros(0, bool)
            if not wide.any():
                continue
            n = w.count[wide]
            start = np.repeat(w.start[wide] - np.cumsum(n) + n, n) + np.arange(n.sum())
            owner = np.repeat(w.owner[wide], n)
            text, offset = w.joined()
            ids = np.asarray(b.column(0).fill_null(NO_ID), dtype=np.int64)
            row = _row_keys(ids, b.column(1), keyed)[owner]
            ids = ids[owner]
            begin = (start - w.first[owner]).astype(np.int32)
            names: dict[bytes, int] = {}
            code = np.fromiter((names.setdefault(text[s:e], len(names)) for s, e in
                                zip(offset[start].tolist(), (offset[start + k] - 1).tolist())), np.int64, len(start))
            digest = [hashlib.blake2b(x, digest_size=16).digest() for x in names]
            order = np.lexsort((begin, ids, code))
            head = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1, [len(order)]])
            for s in range(0, len(head) - 1, 4096):
                edge = head[s:s + 4097]
                here, lead = order[edge[0]:edge[-1]], order[edge[:-1]]
                places = pa.ListArray.from_arrays(
                    pa.array(edge - edge[0], pa.int32()),
                    pa.StructArray.from_arrays([pa.array(ids[here]), pa.array(row[here]), pa.array(begin[here])],
                                               fields=list(place)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest[i] for i in code[lead].tolist()], pa.binary()), pa.array(ids[lead]),
                     pa.array(begin[lead]), places], names=["window", "id", "start", "places"])

    return docs.mapInArrow(run, "window binary, id long, start int, places array<struct<id:long,row:long,start:int>>")


def _hot_ranges(seen: DataFrame, k: int) -> DataFrame:
    """(id, row, start, end) of every later occurrence of the windows of ``_hot_windows``.

    A window is a row per batch, its first place an aggregate combined before the shuffle.
    The windows in more than one of ``HEAVY_WINDOWS`` parts of all rows, fewer than
    ``HEAVY_WINDOWS``, are sent to all tasks, so no key of the join holds more than that part."""
    line = seen.count() // HEAVY_WINDOWS
    firsts = materialize(seen.groupBy("window").agg(
        F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("batches"),
        F.sum(F.size("places")).alias("n")).filter(F.col("n") > 1).drop("n"), "first-places")
    heavy = firsts.filter(F.col("batches") > line).select("window", "first")
    light = firsts.filter(F.col("batches") <= line).select("window", F.col("first").alias("light"))
    known = seen.select("window", "places").join(F.broadcast(heavy), "window", "left")
    found = known.filter(F.col("first").isNotNull()).select("first", "places").unionByName(
        known.filter(F.col("first").isNull()).select("window", "places").join(light, "window")
        .select(F.col("light").alias("first"), "places"))
    p = found.select("first", F.explode("places").alias("p"))
    p = p.filter((F.col("p.id") != F.col("first.id")) | (F.col("p.start") != F.col("first.start")))
    start = F.col("p.start").cast("long")
    return p.select("p.id", "p.row", start.alias("start"), (start + k).alias("end"))


def _equal_windows(code: np.ndarray, hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` that share their window with another, sorted by window, and the
    number of the window for each; equality is checked word by word."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    group = np.cumsum(~same) - 1
    many = np.bincount(group, minlength=1)[group] > 1
    order, group = order[many], group[many]
    if not len(order):
        return order, group
    pos = at[order]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    lead = pos[head][np.cumsum(head) - 1]
    wrong = np.zeros(len(pos), bool)
    for j in range(k):
        wrong |= code[pos + j] != code[lead + j]
    if wrong.any():  # two windows with one hash: number the contents of that group
        fresh = int(group.max()) + 1
        for g in np.unique(group[wrong]).tolist():
            names: dict[tuple, int] = {}
            for i in np.flatnonzero(group == g).tolist():
                key = tuple(code[pos[i]:pos[i] + k].tolist())
                names.setdefault(key, g if not names else fresh + len(names))
                group[i] = names[key]
            fresh += len(names) + 1
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
    return order, group


def bucket_ranges(blobs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, first word, end word) of every stretch of later occurrences in one bucket."""
    i, _, s, e = row_ranges(blobs, k)
    return i, s, e


def row_ranges(blobs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, row key, first word, end word), each once, of every stretch of later occurrences
    in one bucket."""
    press = zstandard.ZstdDecompressor()
    names: dict[bytes, int] = {}
    string, ids, row, begin = [], [], [], []
    for blob in blobs:
        raw = press.decompress(blob)
        n, occ = np.frombuffer(raw, np.int32, 2).tolist()
        at = 8
        times = np.frombuffer(raw, np.int32, n, at)
        ids.append(np.frombuffer(raw, np.int64, occ, at + 4 * n))
        row.append(np.frombuffer(raw, np.int64, occ, at + 4 * n + 8 * occ))
        begin.append(np.frombuffer(raw, np.int32, occ, at + 4 * n + 16 * occ).astype(np.int64))
        body = raw[at + 4 * n + 20 * occ:].split(b"\n")
        string.append(np.repeat(np.array([names.setdefault(s, len(names)) for s in body], np.int64), times))
    string, ids, row, begin = (np.concatenate(x) for x in (string, ids, row, begin))
    texts = pa.array([s.decode("utf-8", "surrogatepass") for s in names], pa.large_string())
    words, size = split_words(texts)
    order = np.lexsort((row, begin, ids, string))
    string, ids, row, begin = string[order], ids[order], row[order], begin[order]
    lead = np.concatenate([[True], string[1:] != string[:-1]])
    first_id, first_at = ids[lead], begin[lead]
    # further occurrences of a whole string are repeats from end to end; equal (id, place)
    # is the first one again, in the same row or in another row of that id
    later = ~((ids == first_id[string]) & (begin == first_at[string]))
    once = np.concatenate([[True], (string[1:] != string[:-1]) | (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
                           | (begin[1:] != begin[:-1])])
    again = later & once
    out = [(ids[again], row[again], begin[again], begin[again] + size[string[again]])]
    holder = row[~later & once]         # rows in which a string is a first one, by string
    holders = np.bincount(string[~later & once], minlength=len(size))
    held = np.cumsum(holders) - holders

    code = np.asarray(words.dictionary_encode().indices, dtype=np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    base = np.concatenate([[0], np.cumsum(size)])
    hashes = _run_hash(_mix(code.astype(np.uint64) + np.uint64(1)), k)
    at = np.flatnonzero(owner[:len(hashes)] == owner[k - 1:][:len(hashes)])
    place, group = _equal_windows(code, hashes[at], at, k)
    if len(place):
        pos = at[place]
        own = owner[pos]
        wid, wat = first_id[own], first_at[own] + pos - base[own]
        best = np.lexsort((wat, wid, group))
        lead = np.concatenate([[True], group[best][1:] != group[best][:-1]])
        num = np.cumsum(lead) - 1
        dup = ~((wid[best] == wid[best][lead][num]) & (wat[best] == wat[best][lead][num]))
        pos = np.sort(pos[best][dup])
        if len(pos):
            own = owner[pos]
            new = np.concatenate([[True], (np.diff(pos) != 1) | (np.diff(own) != 0)])
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(pos)) - 1
            own = own[s]
            shift = first_at[own] - base[own]
            n = holders[own]
            at = np.repeat(held[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append((np.repeat(first_id[own], n), holder[at], np.repeat(pos[s] + shift, n),
                        np.repeat(pos[e] + shift + k, n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_ranges(docs: DataFrame, k: int, m: int, keyed: np.ndarray | None = None) -> DataFrame:
    """(id, row, start, end): stretches of words covered by windows that also start earlier
    (``row`` as of ``_row_keys``)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = parts * BUCKETS_PER_PARTITION
    # one number per bucket, and buckets are as many as the settings say; at most 2 * parts
    # of them can hold more than half a partition's share
    sizes = np.zeros((parts, BUCKETS_PER_PARTITION), np.int64)
    for r in _bucket_sizes(docs, k, m, parts).toLocalIterator():
        sizes[r["part"]] = r["words"]
    hot = np.flatnonzero(sizes.reshape(-1) * (2 * parts) > max(int(sizes.sum()), 1))
    packed = _pack(docs, k, m, buckets, hot, keyed)

    def run(table: pa.Table) -> pa.Table:
        i, r, s, e = row_ranges(table.column("packed").to_pylist(), k)
        return pa.table({"id": i, "row": r, "start": s, "end": e}, schema=pa.schema(
            [(c, pa.int64()) for c in ("id", "row", "start", "end")]))

    ranges = packed.groupBy("bucket").applyInArrow(run, "id long, row long, start long, end long")
    if not len(hot):
        return ranges
    seen = materialize(_hot_windows(docs, k, m, buckets, hot, keyed), "hot-windows")
    return ranges.unionByName(_hot_ranges(seen, k))


def remove_repeats(docs: DataFrame, k: int = 20, m: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept`` (kept words joined by
    one space) and ``kept_sha256`` (of ``kept`` as UTF-8, lowercase hex).

    A word goes if a window of ``k`` words over it also starts earlier (smaller id, or
    the same id and an earlier word), judged on the input.  Null and empty texts have
    no words and keep the empty string.  Every row is judged by its own windows: rows that
    repeat an id count as one document for the order (windows that start in the same
    place are no repeats of each other), rows with a null id as one after all others.
    Extra columns are ignored."""
    src = ids_and_texts(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    keyed = _keyed_ids(src)
    spans = repeated_ranges(src, k, m, keyed).groupBy("id", "row").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in text_batches(batches):
            row = _row_keys(np.asarray(b.column(0), dtype=np.int64), b.column(1), keyed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(row), pa.array(
                [None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()],
                pa.binary())], names=["id", "row", "body"])

    # texts cross the network once, compressed
    joined = src.mapInArrow(zipped, "id long, row long, body binary").join(spans, ["id", "row"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in text_batches(batches, "body", BATCH_BYTES // 4):
            n, gone, kept, sha = [], [], [], []
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("body", "starts", "ends")]
            for body, starts, ends in zip(*cols):
                words = press.decompress(body).split() if body else []
                n.append(len(words))
                if starts:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, np.minimum(starts, len(words)), 1)
                    np.add.at(step, np.minimum(ends, len(words)), -1)
                    stay = np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()
                    gone.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    gone.append(0)
                body = b" ".join(words)
                kept.append(body.decode("utf-8", "surrogatepass"))
                sha.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(sha, pa.string())],
                names=["id", "n_words", "n_removed", "kept", "kept_sha256"])

    out = joined.select("id", "body", "starts", "ends").mapInArrow(
        run, "id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), "n_words", "n_removed", "kept", "kept_sha256")
