"""Embedding near-duplicates by PCA-ordered strips, compared in tiles.

Vectors are scaled to unit length and turned into the principal axes of all vectors, so
that the leading coordinates carry most of a product.  The distinct vectors lie in strips
along the first axis, one row and one file each; strips too far apart on it never meet.
A tile of two strips is compared in one product in single precision over the leading
coordinates and the norm of the rest, which bounds the cosine from above; the pairs left
go on by themselves until the bound is below the threshold, and survivors are settled by
the cosine of the vectors as given, in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bounded_batches, components, materialize, send_if_few
from quarry.operators.ordered import row_index

#: Distinct vectors of a strip; a task is sent two at a time.
STRIP = 4096
#: Rows of a tile; one square of products is held.
TILE = 1024
#: Leading dimensions after which the bound is tested.
STEPS = (16, 32, 64, 128, 256, 512)
#: Numbers of a side of the pairs that go on by themselves at a time.
PAIR_NUMBERS = 1 << 22
#: Bytes of prepared strips that a task holds, and two strips at least.
HELD_BYTES = 128 << 20
#: What single precision can take from a bound (sums of unit vectors' products).
_SLACK = 1e-4
#: Components are named by a broadcast up to so many.
BROADCAST_COMPONENTS = 50_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, packed vector) of every row, and the kind of number packed: single where the column
    holds floats, double otherwise.  The rows that cannot link (a null or non-finite component,
    no length) are told apart by a null ``v``."""
    element = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(b.column(1)), 0), np.int64)
            starts = np.cumsum(sizes) - sizes
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)     # a null component is nan
            out = [None] * len(sizes)
            for d in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == d)
                x = flat[starts[at, None] + np.arange(d)]
                ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[ok], x[ok]
                if kind == "<f8":
                    # scaled so that squares neither overflow nor vanish (of singles they cannot)
                    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
                x = (x + 0.0).astype(kind)      # -0.0 becomes 0.0
                for i, row in zip(at.tolist(), x):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    cast = "array<float>" if kind == "<f4" else "array<double>"
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          F.col(f"`{vector_col}`").cast(cast).alias("v")).mapInArrow(run, "id long, v binary"), kind


def _matrices(column: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per vector length (length, positions, matrix of doubles) of a column of packed vectors."""
    rows, width = column.to_pylist(), np.dtype(kind).itemsize
    sizes = np.array([len(r) // width for r in rows], np.int64)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, np.frombuffer(b"".join(rows[i] for i in at.tolist()), kind).reshape(-1, d).astype(np.float64)


def principal_axes(good: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Per vector length the axes by falling variance: each task sums its products, the
    driver adds up d x d numbers per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(b.column(0), kind):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())],
                                             names=["d", "m"])

    sums: dict[int, np.ndarray] = {}
    for r in good.select("v").mapInArrow(run, "d int, m binary").toLocalIterator():
        sums[r["d"]] = sums.get(r["d"], 0) + np.frombuffer(r["m"], np.float64).reshape(r["d"], r["d"])
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in sums.items()}


def _first(column: pa.Array, kind: str, lead: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(length, coordinate on the first axis) of packed vectors.  Added up dimension by
    dimension, so that equal vectors get the same number wherever they are."""
    d, x = np.zeros(len(column), np.int32), np.zeros(len(column))
    for n, at, m in _matrices(column, kind):
        dot, square = np.zeros(len(at)), np.zeros(len(at))
        for k in range(n):
            dot += m[:, k] * lead[n][k]
            square += m[:, k] * m[:, k]
        d[at], x[at] = n, dot / np.sqrt(square)
    return d, x


def strip_bounds(good: DataFrame, kind: str, lead: dict[int, np.ndarray], rows: int) -> dict[int, tuple]:
    """Per vector length the (number of its first strip, first coordinates, first hashes): a strip
    has at most ``rows`` distinct vectors, in the order of coordinate and hash (two numbers a
    strip go through the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, x = _first(b.column(0), kind, lead)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(x), b.column(1)], names=["d", "x", "hash"])

    keys = good.select("v", F.xxhash64("v").alias("hash")).mapInArrow(run, "d int, x double, hash long").distinct()
    order = row_index(keys, ["x", "hash"], ["d"], name="pos", tie_break=False)
    firsts = order.filter(F.col("pos") % rows == 0).select("d", "x", "hash").toPandas()
    out, number = {}, 0
    for d, t in firsts.sort_values(["d", "x", "hash"]).groupby("d"):
        out[int(d)] = (number, t["x"].to_numpy(), t["hash"].to_numpy())
        number += len(t)
    return out


def _strip(x: np.ndarray, h: np.ndarray, bounds: tuple) -> np.ndarray:
    """The strip of each (coordinate, hash): the last one that starts at or before it."""
    number, xs, hs = bounds
    low, high = np.searchsorted(xs, x, "left"), np.searchsorted(xs, x, "right")
    at = low - 1
    for i in np.flatnonzero(low < high).tolist():      # on a bound: the hash decides
        at[i] += np.searchsorted(hs[low[i]:high[i]], h[i], "right")
    return number + at


def strips_of(good: DataFrame, kind: str, lead: dict[int, np.ndarray], bounds: dict[int, tuple]) -> DataFrame:
    """(d, strip, low, high, least, times, m): the distinct vectors of a strip in one row, each
    with its smallest id and how often it occurs.  Equal vectors meet in a strip; those of a
    batch are counted before they travel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d, x = _first(b.column(1), kind, lead)
            h, strip = np.asarray(b.column(2)), np.zeros(len(d), np.int64)
            for n in np.unique(d).tolist():
                at = np.flatnonzero(d == n)
                strip[at] = _strip(x[at], h[at], bounds[n])
            t = pa.table({"d": d, "strip": strip, "x": x, "v": b.column(1), "id": b.column(0)})
            t = t.group_by(["d", "strip", "x", "v"]).aggregate([("id", "min"), ([], "count_all")])
            t = t.rename_columns({"id_min": "least", "count_all": "times"}).select(["d", "strip", "x", "v", "least", "times"])
            yield from t.combine_chunks().to_batches()

    def pack(key, table):
        t = table.group_by(["x", "v"]).aggregate([("least", "min"), ("times", "sum")])
        t = t.sort_by([("x", "ascending"), ("v", "ascending")])
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "strip": pa.array([key[1].as_py()], pa.int64()),
                         "low": pa.array([t["x"][0].as_py()], pa.float64()),
                         "high": pa.array([t["x"][-1].as_py()], pa.float64()),
                         "least": pa.array([t["least_min"].to_pylist()], pa.list_(pa.int64())),
                         "times": pa.array([np.asarray(t["times_sum"], dtype=np.int64).tobytes()], pa.binary()),
                         "m": pa.array([b"".join(t["v"].to_pylist())], pa.binary())})

    sent = good.select("id", "v", F.xxhash64("v").alias("hash")).mapInArrow(
        run, "d int, strip long, x double, v binary, least long, times long")
    return sent.groupBy("d", "strip").applyInArrow(
        pack, "d int, strip long, low double, high double, least array<long>, times binary, m binary")


def numbered(strips: DataFrame, kind: str) -> DataFrame:
    """(number, key, least, times) of the distinct vectors; ``key`` is the SHA-256 of the packed vector."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, strip, least, times, m in zip(*(c.to_pylist() for c in b.columns)):
                keys = [hashlib.sha256(m[s:s + width * d]).digest() for s in range(0, len(m), width * d)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((strip << 32) + np.arange(len(keys))), pa.array(keys, pa.binary()),
                     pa.array(least, pa.int64()), pa.array(np.frombuffer(times, np.int64))],
                    names=["number", "key", "least", "times"])

    return strips.select("d", "strip", "least", "times", "m").mapInArrow(
        run, "number long, key binary, least long, times long")


class Strip:
    """A strip as the comparison reads it: its vectors as given, and in single precision what
    they have on the leading axes with the norm of the rest."""

    def __init__(self, m: bytes, times: bytes, axes: np.ndarray, kind: str):
        d = axes.shape[0]
        self.m = np.frombuffer(m, kind).reshape(-1, d)
        self.times = np.frombuffer(times, np.int64)
        x = self.m.astype(np.float64)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes
        rest = np.sqrt(np.maximum(np.cumsum((x ** 2)[:, ::-1], axis=1)[:, ::-1], 0))
        self.x = x.astype(np.float32)
        self.steps = [s for s in STEPS if s < d]
        self.rest = rest[:, self.steps].astype(np.float32)
        #: The first step as one product: the leading axes and, as one more, the norm of the rest.
        self.lead = np.hstack([self.x[:, :self.steps[0]], self.rest[:, :1]]) if self.steps else self.x

    @property
    def bytes(self) -> int:
        return self.m.nbytes + self.x.nbytes + self.rest.nbytes + self.lead.nbytes + self.times.nbytes


def compare(a: Strip, b: Strip, ra: slice, rb: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i of ``a`` in ``ra``, j of ``b`` in ``rb``) with cosine at or above the threshold."""
    line, d = np.float32(threshold - _SLACK), a.x.shape[1]
    live = (a.lead[ra] @ b.lead[rb].T) >= line
    steps = list(enumerate([*a.steps, d]))
    if a.steps and np.count_nonzero(live) * 8 > live.size:      # many are left: all axes as one product
        live, steps = (a.x[ra] @ b.x[rb].T) >= line, []
    i, j = np.divmod(np.flatnonzero(live), live.shape[1])
    i, j = i + ra.start, j + rb.start
    keep_i, keep_j, some = [], [], max(1, PAIR_NUMBERS // d)
    for s in range(0, len(i), some):
        x, y = i[s:s + some], j[s:s + some]
        product, done = np.zeros(len(x), np.float32), 0
        # the pairs left go on by themselves: what the other axes can add is bounded by the norms of the rest
        for k, step in steps:
            product = product + np.einsum("ij,ij->i", a.x[x, done:step], b.x[y, done:step])
            done = step
            bound = product if step == d else product + a.rest[x, k] * b.rest[y, k]
            live = bound >= line
            x, y, product = x[live], y[live], product[live]
        # survivors are settled by the cosine of the vectors as given
        u, v = a.m[x].astype(np.float64), b.m[y].astype(np.float64)
        cos = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
        keep_i.append(x[cos >= threshold])
        keep_j.append(y[cos >= threshold])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(keep_i or none), np.concatenate(keep_j or none)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of links that connect what all links connect (at most n - 1)."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return np.array(out, np.int64)


def strip_links(strips: DataFrame, axes: dict[int, np.ndarray], threshold: float, kind: str) -> DataFrame:
    """Rows (id, n, other): ``n`` links of ``id`` found in one pair of strips, weighted by how
    often the other vector occurs; ``other`` non-null names one link of a spanning forest.

    The pairs come from a product of the written strips with themselves: a task reads the
    files of its two sides, and no copy of a vector is shuffled or kept on disk."""
    # unit vectors at cosine t differ by at most sqrt(2 - 2t) on any axis
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    left = strips.select("d", F.col("strip").alias("a"), F.col("high").alias("high_a"), F.col("times").alias("times_a"),
                         F.col("m").alias("m_a"))
    right = strips.select(F.col("d").alias("d_b"), F.col("strip").alias("b"), F.col("low").alias("low_b"),
                          F.col("times").alias("times_b"), F.col("m").alias("m_b"))
    met = (F.col("d") == F.col("d_b")) & (F.col("a") <= F.col("b")) & (F.col("low_b") <= F.col("high_a") + reach)
    pairs = left.hint("shuffle_replicate_nl").join(right, met).select("d", "a", "b", "times_a", "m_a", "times_b", "m_b")
    tile = TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Strip] = OrderedDict()

        def made(number: int, d: int, times: pa.Scalar, m: pa.Scalar) -> Strip:
            if number not in held:
                held[number] = Strip(m.as_py(), times.as_py(), axes[d], kind)
            held.move_to_end(number)
            while len(held) > 2 and sum(x.bytes for x in held.values()) > HELD_BYTES:
                held.popitem(last=False)
            return held[number]

        for batch in batches:
            for r in range(batch.num_rows):
                d, na, nb = (batch.column(c)[r].as_py() for c in range(3))
                a, b = (made(n, d, batch.column(c)[r], batch.column(c + 1)[r]) for n, c in ((na, 3), (nb, 5)))
                la, lb, tree = np.zeros(len(a.m), np.int64), np.zeros(len(b.m), np.int64), []
                for p in range(0, len(a.m), tile):
                    for q in range(p if na == nb else 0, len(b.m), tile):
                        i, j = compare(a, b, slice(p, p + tile), slice(q, q + tile), threshold)
                        if na == nb and p == q:
                            i, j = i[i < j], j[i < j]
                        if not len(i):
                            continue
                        np.add.at(la, i, b.times[j])
                        np.add.at(lb, j, a.times[i])
                        t = forest(i - p, j - q + (0 if na == nb and p == q else tile), 2 * tile)
                        tree.append(np.stack([i[t], j[t]]))
                if not tree:
                    continue
                tree = np.hstack(tree) + np.array([[na << 32], [nb << 32]])
                ha, hb = np.flatnonzero(la), np.flatnonzero(lb)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([(na << 32) + ha, (nb << 32) + hb, tree[0]])),
                     pa.array(np.concatenate([la[ha], lb[hb], np.zeros(tree.shape[1], np.int64)])),
                     pa.concat_arrays([pa.nulls(len(ha) + len(hb), pa.int64()), pa.array(tree[1])])],
                    names=["id", "n", "other"])

    bounded_batches(strips.sparkSession)
    return pairs.mapInArrow(run, "id long, n long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, ``n_links`` (other rows at or above the cosine threshold),
    ``component_id`` (smallest id reachable by links, itself included), ``kept``.

    Rows whose vector is null, empty, zero or holds a null or non-finite component link
    with nothing, as do vectors of different lengths among each other.  Equal vectors
    are compared once and counted as often as they occur; rows that repeat an id or have
    none count as rows of their own (``component_id`` is null where no row has an id).  Extra columns (labels included) are ignored."""
    packed, kind = usable(vectors, id_col, vector_col)
    rows = materialize(packed, "embed-rows")
    good = rows.filter("v IS NOT NULL")
    axes = principal_axes(good, kind)
    lead = {d: m[:, 0].copy() for d, m in axes.items()}
    bounds = strip_bounds(good, kind, lead, STRIP)
    # a file a strip, so that tasks can be dealt any number of them
    strips = materialize(strips_of(good, kind, lead, bounds), "embed-strips", maxRecordsPerFile=1)
    found = materialize(strip_links(strips, axes, threshold, kind), "embed-links")
    distinct = materialize(numbered(strips, kind), "embed-distinct")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")),
                      "embed-cc")
    names = (distinct.join(comp, distinct["number"] == comp["node"]).groupBy("component")
             .agg(F.min("least").alias("name")))
    names = send_if_few(materialize(names, "embed-names"), BROADCAST_COMPONENTS)
    reps = (distinct.join(counts, distinct["number"] == counts["id"], "left").drop("id")
            .join(comp, distinct["number"] == comp["node"], "left").join(names, "component", "left")
            .select("key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
                    F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id")))
    linked = (good.select("id", F.unhex(F.sha2("v", 256)).alias("key")).join(reps, "key")
              .select("id", "n_links", "component_id"))
    rest = rows.filter("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionAll(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
