"""File sources and sinks (IO1, IO3-IO5, IO9, IO14, IO15).

What decides how a file is read is found without a prefix cap: the separator from the
whole header record, the encoding and line breaks inside quotes from a distributed pass
over all lines, the shape of a JSON payload by following its first value to its end.
The data itself is always read by Spark's parallel readers.
"""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import closing

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import NUMBER_PATTERN

# Sniffing order of encodings and separators.
ENCODINGS = ("utf-8", "latin-1", "utf-8-sig")
SEPARATORS = (",", ";", "\t", "|")
# Keys that hold the record list of a JSON payload, in priority order.
PAYLOAD_KEYS = ("data", "results", "items", "records", "rows", "value")
CHUNK = 1 << 16
SPARK_CHARSET = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "utf-8-sig": "UTF-8"}


def read_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes of the first file under ``path`` that has any, piece by piece (Hadoop FS, any
    scheme); Spark leaves an empty first file where its first task had no rows."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.getFileStatus(p).isDirectory():
        files = sorted(((s.getLen() == 0, s.getPath().toString()) for s in fs.listStatus(p)
                        if s.isFile() and not s.getPath().getName().startswith((".", "_"))))
        if not files:
            raise FileNotFoundError(path)
        p = jvm.org.apache.hadoop.fs.Path(files[0][1])
    stream = fs.open(p)
    try:
        while piece := bytes(stream.readNBytes(int(size))):  # a Java byte[] arrives as bytes
            yield piece
    finally:
        stream.close()


def header_record(pieces: Iterator[bytes]) -> bytes:
    """The first record of delimited text: up to the first line break outside quotes."""
    out, quoted = bytearray(), False
    for piece in pieces:
        for i, c in enumerate(piece):
            if c == 0x22:
                quoted = not quoted
            elif c in (0x0A, 0x0D) and not quoted:
                if record := (bytes(out) + piece[:i]).strip(b"\xef\xbb\xbf \t\r\n"):
                    return record
        out += piece
    return bytes(out)


def sniff_separator(header: str) -> str:
    """The first separator that cuts the header record into several columns, else comma."""
    for sep in SEPARATORS:
        if len(next(csv.reader(io.StringIO(header.lstrip("\r\n"), newline=""), delimiter=sep), [])) > 1:
            return sep
    return ","


def line_facts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """One pass over all lines: whether every byte is valid UTF-8, and whether a quoted
    field spans lines (only then must files be read whole)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    seen = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
                                     F.bool_or(quotes % 2 == 1).alias("broken")).first()
    return seen["utf8"] is not False, bool(seen["broken"])


def delimited_reader(spark: SparkSession, sep: str, multi_line: bool = False, encoding: str = "utf-8") -> DataFrameReader:
    """The reader of everything that ``write_table`` writes as text: a header and standard
    quoting (quotes doubled; separators and, with ``multi_line``, line breaks inside quotes)."""
    return (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("encoding", SPARK_CHARSET[encoding]).option("maxCharsPerColumn", -1)
            .option("inferSchema", False).option("multiLine", multi_line))


def read_delimited(spark: SparkSession, path: str, typed: bool = True) -> tuple[DataFrame, str, str]:
    """IO1 delimited text with separator and encoding sniffing and standard quoting
    (doubled quotes, separators and line breaks inside quotes).

    One pass over all lines tells whether every byte is valid UTF-8 (else latin-1) and
    whether a quoted field spans lines; only then are files read whole, otherwise they
    are split.  Columns are read as strings, then typed with guarded casts
    (``infer_types``).  An empty table is an error."""
    utf8, broken = line_facts(spark, path)
    enc = "utf-8" if utf8 else "latin-1"
    with closing(read_chunks(spark, path)) as pieces:
        head = header_record(pieces)
    sep = sniff_separator(head.decode("utf-8-sig" if enc == "utf-8" else enc))
    df = delimited_reader(spark, sep, broken, enc).csv(path)
    if df.columns and df.columns[0].startswith("\ufeff"):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("\ufeff"))
    if df.limit(1).count() == 0:
        raise ValueError(f"{path}: table is empty (0 rows)")
    return (infer_types(df) if typed else df), sep, enc


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns whose non-null values are all numbers (to long when
    all integral, else double).  One aggregate decides every column."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    q = lambda c: F.col(f"`{c}`")
    aggs = []
    for c in cols:
        nn = q(c).isNotNull() & (F.trim(q(c)) != "")
        aggs += [F.count(F.when(nn, 1)).alias(f"n|{c}"),
                 F.count(F.when(nn & q(c).rlike(NUMBER_PATTERN), 1)).alias(f"num|{c}"),
                 F.count(F.when(nn & q(c).rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), 1)).alias(f"int|{c}")]
    r = df.agg(*aggs).first()
    casts = {}
    for c in cols:
        n = r[f"n|{c}"]
        if n and r[f"num|{c}"] == n:
            t = "long" if r[f"int|{c}"] == n else "double"
            casts[c] = F.when(F.trim(q(c)) != "", F.trim(q(c)).try_cast(t))
    return df.withColumns(casts) if casts else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                 where: Column | None = None) -> DataFrame:
    """IO3 parquet with projection and filter stated up front (pushed to the scan)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def _flatten(df: DataFrame) -> DataFrame:
    """Nested structs -> dotted top-level names (``a.b``), like json_normalize."""
    def walk(dt: T.StructType, prefix: list[str]):
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield path
    cols = [F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in walk(df.schema, [])]
    return df.select(*cols)


def json_shape(pieces: Iterator[bytes]) -> str:
    """``array``, ``lines`` or ``object`` (one value over several lines): the first value is
    followed until it closes or a line ends inside it; only its nesting is kept."""
    depth, quoted, skip, kind = 0, False, False, ""
    for piece in pieces:
        for c in piece.lstrip(b"\xef\xbb\xbf \t\r\n") if not kind else piece:
            if not kind:
                if c == 0x5B:
                    return "array"
                if c != 0x7B:
                    raise ValueError("not a JSON array or object")
                kind = "object"
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == 0x5C, c != 0x22
            elif c == 0x22:
                quoted = True
            elif c in (0x7B, 0x5B):
                depth += 1
            elif c in (0x7D, 0x5D):
                depth -= 1
                if not depth:
                    return "lines"
            elif c == 0x0A:
                return "object"
    if not kind:
        raise ValueError("not a JSON array or object")
    return kind


def read_json_payload(spark: SparkSession, path: str) -> DataFrame:
    """IO4/IO5 JSON: an array of records, JSON lines, or an object whose first
    list-valued key among PAYLOAD_KEYS holds the records; other objects are
    flattened with dotted names."""
    with closing(read_chunks(spark, path)) as pieces:
        shape = json_shape(pieces)
    df = spark.read.option("multiLine", shape != "lines").json(path)
    if shape != "array":
        for k in PAYLOAD_KEYS:
            if k in df.columns and isinstance(df.schema[k].dataType, T.ArrayType):
                rec = df.select(F.explode(F.col(f"`{k}`")).alias("_r"))
                if isinstance(rec.schema["_r"].dataType, T.StructType):
                    return _flatten(rec.select("_r.*"))
                return rec.withColumnRenamed("_r", "value")
    return _flatten(df)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """IO9 dispatch on the key's extension: json, parquet, else delimited."""
    low = path.lower().rstrip("/")
    if low.endswith(".json") or low.endswith(".jsonl"):
        return read_json_payload(spark, path)
    if low.endswith(".parquet") or low.endswith(".pq"):
        return spark.read.parquet(path)
    return read_delimited(spark, path)[0]


def preview(df: DataFrame, order_by: Sequence, n: int = 100) -> DataFrame:
    """IO14 first ``n`` rows in a stated order (distributed top-n)."""
    return df.orderBy(*order_by).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                sep: str = ",", partition_by: Sequence[str] = ()) -> None:
    """IO15 sinks: parquet, csv (header) or tsv (tab, header), overwrite or append."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt in ("csv", "tsv"):
        w.option("header", True).option("sep", "\t" if fmt == "tsv" else sep).option("quote", '"').option("escape", '"').csv(path)
    else:
        raise ValueError(fmt)


#: What Hive's layout writes as %XX in a folder name, and the folder of rows without a value.
FOLDER_ESCAPES = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_text_files(df: DataFrame, root: str, label: str, text: str) -> None:
    """One text file a row below a folder ``label=value``, as Spark's text writer with one record
    a file leaves them, but in a folder a task.

    Hadoop's local file system starts two processes for each file (the mode of the file and of
    its checksums), so on a shared local folder the tasks write the files themselves: into a
    hidden folder of the attempt, whose labels are moved into place once Spark has reported the
    attempt as the one that counts.  Any other store gets Spark's writer."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = df.select(F.col(f"`{label}`").cast("string").alias(label), F.col(f"`{text}`").alias("value"))
    if store.getUri().getScheme() != "file":
        # tasks move their files into place themselves, which the driver would do one by one
        rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2) \
            .partitionBy(label).text(root)
        return
    top = store.makeQualified(path).toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, n, made = uuid.uuid4().hex, 0, {}
        for b in batches:
            for value, content in zip(b.column(0).to_pylist(), b.column(1)):
                if value not in made:
                    name = FOLDER_ESCAPES.sub(lambda c: f"%{ord(c[0]):02X}", value or "") or NO_VALUE
                    made[value] = f"{label}={name}"
                    os.makedirs(f"{top}/_attempts/{attempt}/{made[value]}", exist_ok=True)
                with open(f"{top}/_attempts/{attempt}/{made[value]}/part-{n:07d}.txt", "wb", 0) as f:
                    f.write((content.as_py() or b"") + b"\n")
                n += 1
        folders = sorted(set(made.values()))
        yield pa.RecordBatch.from_arrays([pa.array([attempt] * len(folders), pa.string()), pa.array(folders, pa.string())],
                                         names=["attempt", "folder"])

    rows = rows.withColumn("value", F.col("value").cast("binary"))
    os.makedirs(top, exist_ok=True)
    # a row a task and label
    for r in rows.mapInArrow(run, "attempt string, folder string").collect():
        os.makedirs(f"{top}/{r['folder']}", exist_ok=True)
        os.rename(f"{top}/_attempts/{r['attempt']}/{r['folder']}", f"{top}/{r['folder']}/{r['attempt']}")
