"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_bits // 2 + 1`` segments, so that of two
fingerprints within ``max_bits`` one segment differs in at most one bit.  Every
segment is indexed once per bit with that bit blanked out (one-wildcard variants);
equal variants give candidates, whose whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, ids_and_texts, materialize, send_if_few, text_batches

#: Fingerprints that share a variant are compared pairwise up to this many; larger
#: buckets (clusters of near copies) go through shared neighbours, which is linear.
PAIR_BUCKET = 24
#: Shared variants of three and more fingerprints up to this many are broadcast.
BROADCAST_VARIANTS = 250_000
_CHUNK = 1 << 17


def _bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per group of consecutive hashes the fingerprint of majority bits."""
    n = np.diff(np.append(starts, len(hashes)))
    counts = np.zeros((len(starts), 64), np.int64)
    for s in range(0, len(hashes), _CHUNK):
        h = hashes[s:s + _CHUNK]
        first = np.searchsorted(starts, s, "right") - 1
        last = np.searchsorted(starts, s + len(h), "left")
        cuts = np.maximum(starts[first:last] - s, 0)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_batch(texts: list[str | None], shingle: int) -> np.ndarray:
    """Fingerprints (uint64) of whole texts; no word: zero."""
    out = np.zeros(len(texts), np.uint64)
    hash64 = xxhash.xxh64_intdigest
    rows, parts, held = [], [], 0

    def settle() -> None:
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        out[rows] = _bits(np.concatenate(parts), starts)

    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        rows.append(i)
        parts.append(np.fromiter((hash64(b" ".join(g), 42) for g in grams), np.uint64, n))
        held += n
        if held >= _CHUNK:
            settle()
            rows, parts, held = [], [], 0
    if rows:
        settle()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, ``fp`` long) of every row; A-Z lower-cased, words joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            fp = fingerprint_batch(b.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    src = ids_and_texts(docs, id_col, text_col)
    return src.mapInArrow(run, "id long, fp long")


def _variants(max_bits: int):
    """One key per segment and blanked bit: position * 2^32 + the other bits of the segment."""
    parts = max_bits // 2 + 1
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        for bit in range(lo, hi):
            mask = ((1 << (hi - lo)) - 1) & ~(1 << (bit - lo))
            seg = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask - (1 << 64 if mask >> 63 else 0)))
            out.append((F.xxhash64(F.lit(bit), seg) if hi - lo > 32 else seg.bitwiseOR(F.lit(bit << 32))))
    return F.array(*out)


def _one(bit: int) -> int:
    return (1 << bit) - (1 << 64 if bit == 63 else 0)


def _shared_values(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, bit, v): values that two fingerprints have in common exactly if they differ in
    at most ``max_bits`` bits: neighbours at max_bits // 2, with one more bit blanked if odd."""
    out = fps.withColumn("v", F.col("fp"))
    if max_bits >= 2:
        flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_one(b))) for b in range(64)]
        out = fps.select("fp", F.explode(F.array(*flips)).alias("v"))
    if max_bits % 2 == 0:
        return out.withColumn("bit", F.lit(-1))
    blank = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(~_one(b)).alias("mask")) for b in range(64)]))
    return out.select("fp", "v", blank.alias("b")).select("fp", F.col("v").bitwiseAND(F.col("b.mask")).alias("v"),
                                                          F.col("b.bit").alias("bit"))


def fingerprint_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (``a``, ``b``) that connect distinct fingerprints (``fp``) exactly as all
    pairs at ``max_bits`` or fewer differing bits do.

    Candidates come from the one-wildcard segment index.  A variant shared by two
    gives its pair, by up to ``PAIR_BUCKET`` their pairs, all verified.  The members
    of larger buckets are linked through common neighbour values instead (two values
    are within two bits exactly if a third is within one of both), so a cluster of n
    fingerprints costs 65 n keys rather than its pairs and no link is lost."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keys = fps.select("fp", F.explode(_variants(max_bits)).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"),
                                     F.max("fp").alias("b")).filter("n > 1")
    shared = materialize(shared, "simhash-shared")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = shared.filter("n = 2").select("a", "b").filter(near).distinct()
    # variants of three and more; where they are few, the keys need no second shuffle
    several = send_if_few(shared.filter("n > 2").select("key", "n"), BROADCAST_VARIANTS)
    members = materialize(keys.join(several, "key"), "simhash-members")
    few = members.filter(F.col("n") <= PAIR_BUCKET).select("key", "fp")
    some = (few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key")
            .filter("a < b").filter(near).select("a", "b").distinct())
    many = members.filter(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    stars = _shared_values(many, max_bits)
    hubs = stars.groupBy("v", "bit").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = stars.join(hubs.select("v", "bit", "a"), ["v", "bit"]).filter("fp != a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionAll(some).unionAll(linked)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id reachable by links, itself included), ``kept`` (id is that smallest).

    Null and empty texts have fingerprint zero and link like any other; rows that
    repeat an id and text give equal rows; a row with a null id belongs to a component
    but never names it (null component if no id does).  Extra columns are ignored."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    reps = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    comp = components(fingerprint_links(reps.select("fp"), max_bits), "simhash-cc")
    reps = reps.join(comp, reps["fp"] == comp["node"], "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = reps.groupBy("c").agg(F.min("rep").alias("component_id"))
    found = reps.join(least, "c").select("fp", "component_id")
    return rows.join(found, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: More rows to drop than this are joined without a broadcast (8 bytes a row).
BROADCAST_GONE = 2_000_000


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 2) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns: the one with the
    smallest id (a null id comes after all others; of rows that repeat it, the first read).

    Rows are told apart by a number written with them, so rows that share an id, or have
    none, go by their own texts.  Texts without words are near-duplicates of each other.
    An empty table stays one."""
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(numbered, "__row", text_col, shingle, max_bits).select("__row", "component_id")
    ids = numbered.select("__row", F.col(f"`{id_col}`").cast("long").alias("id"))
    found = materialize(found.join(ids, "__row"), "simhash-found")
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("least"))
    gone = materialize(found.join(stays, "component_id").filter(F.col("__row") != F.col("least.__row")).select("__row"),
                       "simhash-gone")
    # numbers of a bounded count are sent to the texts; beyond it the texts are shuffled
    return numbered.join(send_if_few(gone, BROADCAST_GONE), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
