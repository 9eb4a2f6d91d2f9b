"""Shared pieces of the training-data operators: words, tables, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

# fixed value: a word is a run of characters other than ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task works on at a time, however long the documents are.
BATCH_BYTES = 8 << 20


def read_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back (``options``:
    of the writer).

    Cuts lineage with data that every executor can reach, so a lost executor
    costs one re-read; each call takes a new folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quarry-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def send_if_few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a written table) broadcast if its counted rows are at most ``rows``; otherwise
    as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, text string): what the Python tasks are sent, in batches of a bounded size."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send Python tasks at most ``BATCH_BYTES`` at a time (a row at least)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                 limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``
    (``BATCH_BYTES`` unless given, one row at least)."""
    limit = limit or BATCH_BYTES
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0)
        block = np.cumsum(np.asarray(sizes, dtype=np.int64)) // limit
        cuts = np.flatnonzero(np.diff(block)) + 1
        for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
            yield b.slice(s, e - s)


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 (``bytes.split`` cuts at ASCII white space only)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def plain_texts(texts: pa.Array, lower: bool = False) -> pa.Array:
    """A copy that starts at offset 0, nulls as empty texts, A-Z lower-cased if asked.

    Arrow's string kernels misread some slices of larger arrays, so they only get these."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    offset = np.frombuffer(offsets, np.int64, texts.offset + n + 1)[texts.offset:] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offset[0]:offset[-1]] if data else np.zeros(0, np.uint8)
    if texts.null_count:
        size = np.where(np.asarray(texts.is_valid()), np.diff(offset), 0)
        if size.sum() != len(raw):
            return plain_texts(pa.array([t or "" for t in texts.to_pylist()], pa.large_string()), lower)
        offset = np.concatenate([[0], np.cumsum(size)])
    raw = _LOWER[raw] if lower else raw.copy()
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer((offset - offset[0]).astype(np.int64).tobytes()),
                                            pa.py_buffer(raw.tobytes()))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts and the number of words of each text (null: 0)."""
    lists = pc.ascii_split_whitespace(plain_texts(texts, lower))
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    words = flat.filter(keep)
    return words, np.bincount(owner[np.asarray(keep)], minlength=len(lists)).astype(np.int64)


def held_out(column: str, buckets: int, remainder: int):
    """crc32 of the id as text, modulo ``buckets``, equals ``remainder``."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % buckets == remainder, F.lit(False))


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 100) -> DataFrame:
    """Connected components of an undirected edge table (``a``, ``b`` long).

    Alternates two star contractions until nothing changes: first every node hands
    its larger neighbours to its smallest one, then its smaller neighbours.  Every
    step is a grouped minimum (combined before the shuffle, so a hub costs one row
    per task) and an equality join.  Returns ``node``, ``component`` (its smallest
    node) for every node with an edge to another; null ends and loops are ignored."""
    cur = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialize(cur, tag)

    def sign(df: DataFrame):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return r["n"], r["x"]

    state = sign(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        before, state = state, sign(cur)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
