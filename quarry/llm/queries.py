"""The registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator with production parameters to the whole table and
derives the fixed digest columns from the operator's output.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quarry.llm import (conversation_repair, decontamination, embedding_dedup, exact_dedup, lexical_search, lm, mixing, pii,
                        quality, secret_scan, simhash, substrings, toxicity)
from quarry.llm.common import held_out, read_docs
from quarry.operators.ordered import join_null_safe

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _labelled(spark, sf_dir, module, label, buckets, remainder):
    """Fit on labelled rows that are not held out; score every document."""
    docs = read_docs(spark, sf_dir)
    texts, labels = toxicity.labelled_sample(docs, _table(spark, sf_dir, "labels"), label,
                                             ~held_out("id", buckets, remainder), module.Config().sample)
    scored = module.score(docs, module.fit(texts, labels))
    return scored.select("doc_id", held_out("doc_id", buckets, remainder).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return _labelled(spark, sf_dir, toxicity, "toxic", 3, 1)


@query("op2_substring_dedup", rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(CASE WHEN len(w) >= 20 THEN range(1, CAST(len(w) - 18 AS BIGINT)) ELSE [] END) AS s FROM d),
win AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(list_slice(w, s, s + 19), ' ')
        ORDER BY doc_id, s) AS r FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM win WHERE r > 1),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS i FROM d),
k AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed
      FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""")
def op2_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(read_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_lm_scoring")
def op3_lm_scoring(spark, sf_dir):
    return lm.score(read_docs(spark, sf_dir), ~held_out("id", 7, 2))


def _count(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    found = secret_scan.scan(read_docs(spark, sf_dir))
    spans = F.col("spans")
    base = secret_scan.KINDS[:3]
    return found.select("doc_id", *[_count(spans, k) for k in base],
                        F.sha2(secret_scan.span_text(spans, base), 256).alias("base_sha256"),
                        secret_scan.span_text(spans).alias("spans"))


@query("op5_pii")
def op5_pii(spark, sf_dir):
    found = pii.find(read_docs(spark, sf_dir))
    spans = F.col("spans")
    base = pii.KINDS[:4]
    return found.select("doc_id", *[_count(spans, k) for k in base],
                        F.sha2(secret_scan.span_text(spans, base), 256).alias("base_sha256"),
                        secret_scan.span_text(spans).alias("spans"))


@query("op6_quality")
def op6_quality(spark, sf_dir):
    return _labelled(spark, sf_dir, quality, "quality", 4, 2)


@query("op7_source_mixing")
def op7_source_mixing(spark, sf_dir):
    return mixing.mix(read_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
       WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.y, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.y, vec_id)) AS kept
FROM v LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id""")
def op8_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contamination(read_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "item_tokens", "coverage")


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read_docs(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query("op11_lexical_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
qt AS (SELECT item_id, t, count(*) AS c FROM q GROUP BY ALL),
g AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(c * CAST(floor(1000 * ln((2 * g.n + 2) / (2 * df + 1))) AS BIGINT)
  * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * tf.n * g.n) // g.l))))) AS BIGINT) AS score
  FROM qt JOIN tf USING (t) JOIN df USING (t), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""")
def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(read_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


@query("op12_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op12_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicates(read_docs(spark, sf_dir))


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    done = conversation_repair.repair(conversation_repair.damage(rows))
    out = join_null_safe(rows.select("conv_id").distinct(), done.conversations, ["conv_id"], "left")
    out = join_null_safe(out, conversation_repair.digests(done.messages), ["conv_id"], "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated",
                                                                           "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
