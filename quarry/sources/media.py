"""File-collection sources (IO10-IO13): media inventory, multi-file bundles,
companion tables and sample-submission layouts.  Listings come from Spark's
``binaryFile`` source with the ``content`` column pruned, so only paths and
sizes are read; the kept listing of a shared local folder is made by the tasks,
which the driver tells the folders only."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

# File extensions of images and audio.
IMAGE_EXTS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif")
AUDIO_EXTS = ("mp3", "wav", "ogg", "flac", "m4a", "aac", "wma")
#: What a file's opening counts for, in bytes, where files are dealt to tasks: a listing opens none.
LISTING_COST = 1 << 16
#: Files that a task lists at a time.
LISTED_FILES = 1 << 14


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, name, ext, length) of every non-hidden file under root."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))
    return _described(files, root)


def _described(files: DataFrame, root: str) -> DataFrame:
    """(path, rel, name, ext, length) of the non-hidden ones of (path, length)."""
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _escape(base.split("://")[-1]) + "/", "")
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    out = files.select("path", rel.alias("rel"), name.alias("name"),
                       F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).alias("ext"), "length")
    hidden = F.exists(F.split("rel", "/"), lambda p: p.startswith(".") | p.startswith("_"))
    return out.where(~hidden)


def local_folder(spark: SparkSession, root: str) -> str | None:
    """The path of ``root`` where it is a folder of the (shared) local file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = store.makeQualified(path).toUri().getPath()
    return top if store.getUri().getScheme() == "file" and os.path.isdir(top) else None


def list_local_files(spark: SparkSession, top: str) -> DataFrame:
    """(path, length) of the files below the local folder ``top``: the driver looks for folders,
    the tasks list them, each folder in pieces of a bounded number of files."""
    def shown(name: str) -> bool:
        return not name.startswith((".", "_")) and not name.endswith("._COPYING_")

    folders, open_ = [], [top]
    while open_:
        folders.append(open_.pop())
        with os.scandir(folders[-1]) as entries:
            open_ += [e.path for e in entries if shown(e.name) and e.is_dir()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"file:{p}" for p, _ in found], pa.string()),
                                               pa.array([n for _, n in found], pa.int64())], names=["path", "length"])

        for b in batches:
            for folder in b.column(0).to_pylist():
                found = []
                with os.scandir(folder) as entries:
                    for e in entries:
                        if shown(e.name) and e.is_file():
                            found.append((e.path, e.stat().st_size))
                            if len(found) == LISTED_FILES:
                                yield batch(found)
                                found = []
                yield batch(found)

    tasks = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
    return (spark.createDataFrame([(f,) for f in folders], "folder string").repartition(tasks)
            .mapInArrow(run, "path string, length long"))


def kept_listing(spark: SparkSession, root: str) -> DataFrame:
    """``list_files`` written once as a table below the shared checkpoint folder; what is asked
    of the listing reads the table.

    The files of a local folder are listed by the tasks.  For other stores a session of its own
    makes the listing, with about two thousand small files a task (32 at the usual cost of opening)."""
    if top := local_folder(spark, root):
        files = _described(list_local_files(spark, top), root)
    else:
        lister = spark.newSession()
        lister.conf.set("spark.sql.files.openCostInBytes", str(LISTING_COST))
        files = list_files(lister, root)
    path = os.path.join(checkpoint_dir(spark), f"listing-{uuid.uuid4().hex}")
    files.write.parquet(path)
    return spark.read.schema(files.schema).parquet(path)


def _escape(s: str) -> str:
    import re
    return re.escape(s)


def media_inventory(spark: SparkSession, root: str, image_exts: Sequence[str] = IMAGE_EXTS,
                    audio_exts: Sequence[str] = AUDIO_EXTS) -> dict:
    """IO10 (filepath, label) rows where label = top-level folder; images win
    over audio; plus class counts, totals and six sample paths."""
    files = kept_listing(spark, root)
    n_img = files.where(F.col("ext").isin(*image_exts)).limit(1).count()
    exts = image_exts if n_img else audio_exts
    media = files.where(F.col("ext").isin(*exts))
    top = F.when(F.col("rel").contains("/"), F.split("rel", "/")[0])
    rows = media.select(F.col("path").alias("filepath"), F.coalesce(top, F.lit("")).alias("label"))
    classes = rows.where(F.col("label") != "").groupBy("label").agg(F.count(F.lit(1)).alias("files"))
    return {"media_type": "image" if n_img else "audio", "rows": rows, "classes": classes,
            "total": media.count(), "samples": media.orderBy("rel").limit(6).select("rel")}


def _role(name: Column) -> Column:
    lo = F.lower(name)
    return (F.when(lo.contains("submission") | lo.contains("sample"), "submission")
            .when(lo.contains("test") | lo.contains("holdout") | lo.contains("predict"), "test")
            .otherwise("extra"))


def bundle_entries(spark: SparkSession, root: str) -> DataFrame:
    """Top-level entries (a file, or a folder of part files) with total size."""
    files = list_files(spark, root)
    entry = F.split("rel", "/")[0]
    return files.groupBy(entry.alias("entry")).agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("files"))


def resolve_bundle(spark: SparkSession, root: str, primary: str | None = None) -> DataFrame:
    """IO11 rank of each entry: train.<ext> 0, train* 1, other 2,
    test/submission/sample 3; the primary table is the best rank, then the
    largest; ``primary`` overrides.  Output (entry, length, rank, role)."""
    e = bundle_entries(spark, root)
    lo = F.lower("entry")
    rank = (F.when(lo.rlike(r"^train\.[^.]+$"), 0).when(lo.startswith("train"), 1)
            .when(lo.contains("test") | lo.contains("submission") | lo.contains("sample"), 3).otherwise(2))
    e = e.withColumn("rank", rank)
    if primary:
        chosen = F.col("entry") == F.lit(primary)
    else:
        best = e.orderBy("rank", F.desc("length"), "entry").select("entry").first()
        chosen = F.col("entry") == F.lit(best["entry"] if best else None)
    return e.withColumn("role", F.when(chosen, "primary").otherwise(_role(F.col("entry"))))


def companion_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """IO12 rows, column count, headers and role per companion table."""
    parts = None
    for name, df in tables.items():
        p = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("cols"),
            F.array(*[F.lit(c) for c in df.columns]).alias("headers"), _role(F.lit(name)).alias("role"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


def sample_layout(sample: DataFrame, train: DataFrame) -> DataFrame:
    """IO13 first sample column = id, the rest = targets; targets missing
    from the training table are flagged as computed (by aggregation)."""
    cols = sample.columns
    rows = [(cols[0], "id", False)] + [(c, "target", c not in train.columns) for c in cols[1:]]
    return sample.sparkSession.createDataFrame(rows, "column string, role string, must_be_computed boolean")
