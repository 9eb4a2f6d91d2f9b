"""Exact duplicates through an extendible-hash index on shared files (DataFrame functions only).

Keys are 64-bit hashes of whole texts.  The directory is an array of 2^g pointers, indexed
by a key's first g bits; a bucket of depth d is pointed at by all 2^(g-d) cells that begin
with its d bits.  A bucket holding more than ``capacity`` distinct texts splits by its next
bit, and the directory doubles where the bucket was as deep as the directory.  Buckets lie
in files in key order: every owner task writes a range of keys, in which texts of one key
are chained.  Equal texts are found by comparing their bytes (grouping by the text itself,
combined before the shuffle, so a text held by a third of all rows is one row per task);
rows then reach their chain link by key and digest.

The index can be kept and looked up by later tables (``build`` and ``lookup``).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: Directories of more pointers are joined without a broadcast.
BROADCAST_POINTERS = 1 << 18
#: Bits by which the first count of keys exceeds the expected depth of the directory.
SPARE_BITS = 4


@dataclass
class Index:
    """``entries``: one row per distinct text, in key order (``bucket``, ``key``, ``link`` of
    the chain, ``digest``, ``top`` (doc_id and row number that stay), ``n`` rows).
    ``directory``: ``cell``, ``bucket``, ``depth``.  ``bits``: g."""
    entries: DataFrame
    directory: DataFrame
    bits: int


def cell_of(key: Column, bits) -> Column:
    """The first ``bits`` bits of a key (0 to 62 of them)."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    # a shift by 64 would leave a long as it is
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", key, (F.lit(64) - bits).cast("int")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, key): null texts count as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).withColumn(
        "key", F.xxhash64("text"))


def directory(links: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Directory for a table with a ``key`` per distinct text: (cell, bucket, depth), bits g.

    Keys are counted once per prefix of ``most`` bits.  From these counts come those of
    all shorter prefixes, hence every splitting and doubling: a bucket is a prefix that is
    not overfull below one that is.  Prefixes of ``most`` bits stay whole (only far more
    equal hashes than ``capacity`` could overfill them)."""
    total = links.count()
    most = min(40, max(0, -(-total // capacity) - 1).bit_length() + SPARE_BITS)
    cells = links.groupBy(cell_of(F.col("key"), most).alias("cell")).agg(F.count(F.lit(1)).alias("keys"))
    cells = materialize(cells, "dedup-cells")
    sizes = (cells.select(F.explode(F.sequence(F.lit(0), F.lit(most))).alias("depth"), "cell", "keys")
             .groupBy("depth", F.call_function("shiftright", F.col("cell"), (F.lit(most) - F.col("depth")).cast("int"))
                      .alias("prefix")).agg(F.sum("keys").alias("keys")))
    # both halves of a split are there, also where one holds no key
    whole = sizes.filter((F.col("keys") > capacity) & (F.col("depth") < most))
    halves = whole.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(
        F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = links.sparkSession.createDataFrame([(0, 0)], "depth int, prefix long")
    buckets = (root.unionAll(halves).join(whole.select("depth", "prefix"), ["depth", "prefix"], "left_anti"))
    buckets = materialize(buckets, "dedup-buckets")
    bits = buckets.agg(F.max("depth")).first()[0]
    spare = (F.lit(bits) - F.col("depth")).cast("int")
    first = F.call_function("shiftleft", F.col("prefix"), spare)
    cells = F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), spare) - 1)
    return buckets.select(F.explode(cells).alias("cell"), first.alias("bucket"), "depth"), bits


def _owned(df: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """Add ``bucket``: follow the pointer of the key's cell."""
    small = F.broadcast(table) if 1 << bits <= BROADCAST_POINTERS else table
    return df.withColumn("cell", cell_of(F.col("key"), bits)).join(small.select("cell", "bucket"), "cell").drop("cell")


def _rows(keys: DataFrame) -> DataFrame:
    """(id, row, key, digest), written: every row with a number of its own."""
    return materialize(keys.select("id", F.monotonically_increasing_id().alias("row"), "key",
                                   F.unhex(F.sha2("text", 256)).alias("digest")), "dedup-rows")


def _index(keys: DataFrame, rows: DataFrame, capacity: int) -> Index:
    # bytes are compared here: texts are grouped by themselves
    texts = keys.select("key", "text").distinct().select("key", F.unhex(F.sha2("text", 256)).alias("digest"))
    texts = materialize(texts, "dedup-texts")
    table, bits = directory(texts, capacity)
    table = materialize(table, "dedup-directory")
    stay = rows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("top"))
    chain = Window.partitionBy("bucket", "key").orderBy("digest")
    owned = (_owned(texts.join(stay, ["key", "digest"]), table, bits).repartitionByRange("bucket", "key")
             .withColumn("link", F.row_number().over(chain)))
    return Index(materialize(owned.select("bucket", "key", "link", "digest", "top", "n"), "dedup-index"), table, bits)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 16) -> Index:
    """The index of a table."""
    keys = keyed(docs, id_col, text_col)
    return _index(keys, _rows(keys), capacity)


def save(index: Index, path: str) -> None:
    """Keep an index below a shared folder."""
    index.entries.write.parquet(os.path.join(path, "entries"))
    index.directory.withColumn("bits", F.lit(index.bits)).write.parquet(os.path.join(path, "directory"))


def load(spark: SparkSession, path: str) -> Index:
    table = spark.read.parquet(os.path.join(path, "directory"))
    return Index(spark.read.parquet(os.path.join(path, "entries")), table.drop("bits"), table.first()["bits"])


def lookup(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of another table: id and ``found`` (doc_id that stays for its text in
    the index; null if the index has no such text)."""
    rows = keyed(docs, id_col, text_col).select("id", "key", F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = _owned(rows, index.directory, index.bits)
    return rows.join(index.entries.select("bucket", "key", "digest", F.col("top.id").alias("found")),
                     ["bucket", "key", "digest"], "left").select(F.col("id").alias(id_col), "found")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 16) -> DataFrame:
    """One row per input row: id, ``keep_id`` (largest id among the rows of its text),
    ``group_size``, ``kept`` and ``text_sha256``.

    A null text counts as empty; texts are equal only if all their bytes are.  A null id is
    smaller than any other: such a row stays, and ``keep_id`` is null, only where no row of
    its text has an id.  Exactly one row of a text is kept: of rows that repeat the largest
    id one stays (the one read last).  An empty table gives an empty table; extra columns
    are ignored."""
    keys = keyed(docs, id_col, text_col)
    rows = _rows(keys)
    index = _index(keys, rows, capacity)
    found = rows.join(index.entries.select("key", "digest", "top", "n"), ["key", "digest"])
    return found.select(F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("row") == F.col("top.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

