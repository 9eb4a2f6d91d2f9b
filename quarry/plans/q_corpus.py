"""Queries: corpus preparation (IO16, B1-B8) and bits per byte."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.operators.evaluation import bits_per_byte
from quarry.plans.registry import finish, register
from quarry.session import checkpoint_dir, read_table, table_path

#: Size of the vocabulary, special tokens included.
VOCAB = 8192


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def merges_for(spark, sf, vocab: int = VOCAB, train_anew: bool = False):
    """The merges of a vocabulary trained on the training shards, kept in the shared folder
    under what the input's files are, so the queries of one input train once."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(table_path(sf, "documents"))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(top))
    name = hashlib.sha256(repr((vocab, files)).encode()).hexdigest()[:24]
    path = f"{checkpoint_dir(spark).rstrip('/')}/vocabulary-{name}"
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not train_anew and done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return C.load_merges(spark, path)
    train, _ = C.split_shards(_docs(spark, sf))
    merges = C.train_bpe(C.pretoken_counts(train), vocab)
    C.save_merges(spark, path, merges)
    return merges


@register("io16_shard_split", """
SELECT CASE WHEN doc_id % 10 = 9 THEN 'val' ELSE 'train' END AS split, count(*) AS docs,
  CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def io16_shard_split(spark, sf):
    train, val = C.split_shards(_docs(spark, sf))
    t = train.agg(F.lit("train").alias("split"), F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    v = val.agg(F.lit("val").alias("split"), F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    return t.unionByName(v)


@register("b1_cap_corpus", """
WITH d AS (SELECT doc_id, substr(text, 1, 10000) AS doc FROM documents WHERE doc_id % 10 <> 9),
r AS (SELECT doc_id, CAST(length(doc) AS INTEGER) AS n, coalesce(sum(length(doc)) OVER (ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, n FROM r WHERE before < 1000000""")
def b1_cap_corpus(spark, sf):
    train, _ = C.split_shards(_docs(spark, sf))
    capped = C.cap_corpus(train.select("doc_id", "text"), ["doc_id"], doc_cap=10_000, max_chars=1_000_000)
    return capped.select("doc_id", F.length("doc").alias("n"))


@register("b1_cap_report", """
WITH d AS (SELECT doc_id, length(text) AS full_n, length(substr(text, 1, 10000)) AS n FROM documents WHERE doc_id % 10 <> 9),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT count(*) AS documents, count(*) FILTER (before >= 1000000) AS documents_removed,
  CAST(sum(full_n) AS BIGINT) AS chars, CAST(sum(full_n) - sum(n) FILTER (before < 1000000) AS BIGINT) AS chars_removed FROM r""")
def b1_cap_report(spark, sf):
    train, _ = C.split_shards(_docs(spark, sf))
    train = train.select("doc_id", "text")
    return C.cap_report(train, C.cap_corpus(train, ["doc_id"], doc_cap=10_000, max_chars=1_000_000))


@register("b2_pretokens")
def b2_pretokens(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(C.SPLIT_PATTERN), 0)).alias("pieces"))


@register("b3_bpe_merges")
def b3_bpe_merges(spark, sf):
    merges = merges_for(spark, sf, train_anew=True)
    table = C.token_table(merges)
    rows = [(i, a, b, 256 + i, table[256 + i].decode("utf-8", "replace")) for i, (a, b) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank int, left_id int, right_id int, token_id int, text string")


@register("b4_encode")
def b4_encode(spark, sf):
    merges = merges_for(spark, sf)
    enc = C.encode(_docs(spark, sf).select("doc_id", "text"), merges)
    return enc.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


@register("b5_round_trip_audit")
def b5_round_trip_audit(spark, sf):
    return C.round_trip_audit(_docs(spark, sf), merges_for(spark, sf))


@register("b6_f11_token_bytes")
def b6_f11_token_bytes(spark, sf):
    return C.vocabulary(spark, merges_for(spark, sf))


@register("b7_b8_pack_shift")
def b7_b8_pack_shift(spark, sf):
    merges = merges_for(spark, sf)
    packed = C.pack(C.encode(_docs(spark, sf), merges), length=C.MAX_SEQ_LEN)
    return C.shift_targets(packed).select(F.size("inputs").alias("n_inputs"), F.size("targets").alias("n_targets"),
                                          "inputs", "targets")


@register("b7_corpus_packing")
def b7_corpus_packing(spark, sf):
    return C.pack_corpus(C.encode(_docs(spark, sf), merges_for(spark, sf)))


@register("f11_token_byte_length", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE octet_length(encode(p_name || 'é€')) END AS n_bytes FROM part""")
def f11_token_byte_length(spark, sf):
    from quarry.functions.scalars import token_byte_length
    p = read_table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("é€")).alias("t"))
    return p.select("p_partkey", token_byte_length("t", F.col("p_partkey") % 5 == 0).alias("n_bytes"))


@register("e11_bits_of_scores", """
SELECT round(sum(CASE WHEN l_linenumber > 1 THEN l_quantity / 10.0 END) / (ln(2.0) * sum(l_linenumber - 1)), 6) AS bpb,
  CAST(sum(l_linenumber - 1) AS BIGINT) AS bytes, count(*) AS tokens FROM lineitem""")
def e11_bits_of_scores(spark, sf):
    """Given scores: token 1 is special (no bytes), the others have token - 1 bytes."""
    vocab = spark.range(1, 65).select(F.col("id").cast("int").alias("token_id"), (F.col("id") - 1).cast("int").alias("n_bytes"))
    scored = read_table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("token_id"),
                                                      (F.col("l_quantity") / 10.0).alias("nats"))
    return finish(bits_per_byte(scored, vocab))


@register("e11_bits_per_byte")
def e11_bits_per_byte(spark, sf):
    merges = merges_for(spark, sf)
    train, val = C.split_shards(_docs(spark, sf))
    vocab = C.vocabulary(spark, merges)
    nats = C.unigram_nats(C.encode(train, merges), C.encode(val, merges), vocab.count())
    return finish(bits_per_byte(nats, vocab))
