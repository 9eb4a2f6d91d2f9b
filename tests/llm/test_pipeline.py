"""The registered queries' contracts and the pipeline, stage by stage on its own input."""

import math
import re
from collections import Counter, defaultdict

import brute
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from quarry.llm import decontamination, mixing
from quarry.llm.common import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
                       "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint",
                        "base_sha256": "string", "spans": "string"},
    "op5_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
                "base_sha256": "string", "spans": "string"},
    "op6_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_benchmark_decontamination": {"doc_id": "bigint", "item_id": "bigint", "covered": "bigint", "item_tokens": "bigint",
                                      "coverage": "double"},
    "op10_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean",
                         "text_sha256": "string"},
    "op13_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint",
                                 "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string",
                                 "repaired_sha256": "string"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_columns(spark, name):
    df = E.queries()[name](spark, SF)
    assert dict(df.dtypes) == COLUMNS[name]
    table = {"vec_id": "embeddings", "conv_id": "conversations"}.get(df.columns[0], "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").select(df.columns[0] if table != "documents" else "doc_id").distinct().count()
    assert df.count() == n or name.startswith(("op9", "op11"))


def test_every_operator_has_one_query():
    names = [q for q in E.queries() if re.match(r"op\d+_", q)]
    assert Counter(int(re.match(r"op(\d+)_", q)[1]) for q in names) == Counter(range(1, 14))
    assert set(names) == set(COLUMNS) and "pipeline" in E.queries()


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output rows) of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        kept = materialize(f(spark, docs, SF), "test-stage")
        out.append((name, docs.collect(), kept.collect(), kept.columns))
        docs = kept
    return out


def test_stages_keep_the_columns(stages):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [s[0] for s in stages] == [n for n, _ in P.STAGES] and len(stages) == 5
    assert all(s[3] == cols for s in stages[:4]) and stages[4][3] == [*cols, "copy"]


def test_quality_stage(spark, stages):
    _, before, after, _ = stages[0]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    right = [(r.doc_id in kept) == bool(label[r.doc_id]) for r in before if label.get(r.doc_id) is not None]
    assert sum(right) >= 0.97 * len(right) and 0 < len(kept) < len(before)
    assert set(after) <= set(before)


def test_near_dedup_stage(stages):
    _, before, after, _ = stages[1]
    fp = [brute.fingerprint(r.text) for r in before]
    comp = brute.components(range(len(before)), [(i, j) for i, j in brute.pairs(len(before))
                                                 if bin(fp[i] ^ fp[j]).count("1") <= 2])
    least = defaultdict(lambda: math.inf)
    for i, r in enumerate(before):
        least[comp[i]] = min(least[comp[i]], r.doc_id)
    assert {r.doc_id for r in after} == set(least.values()) and len(after) < len(before)


def test_decontamination_stage(spark, stages):
    _, before, after, _ = stages[2]
    items = [decontamination.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaked(text):
        words = decontamination.tokens(text)
        grams = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        code = {w: k for k, w in enumerate(dict.fromkeys([*words, *(w for t in items for w in t)]))}
        for t in items:
            if grams & {tuple(t[i:i + 5]) for i in range(len(t) - 4)}:
                tiles = decontamination.greedy_tiles([code[w] for w in t], [code[w] for w in words], 3)
                if sum(n for _, _, n in tiles) >= 0.8 * len(t):
                    return True
        return False

    assert {r.doc_id for r in after} == {r.doc_id for r in before if not leaked(r.text)}


def test_pii_stage(stages):
    _, before, after, _ = stages[3]
    text = {r.doc_id: r.text for r in after}
    for r in before:
        out, at = [], 0
        for kind, s, e in brute.pii_base(r.text):
            if s >= at:
                out += [r.text[at:s], f"<{kind.upper()}>"]
            at = max(at, e)
        assert text[r.doc_id] == "".join(out) + r.text[at:]
    assert any("<EMAIL>" in t for t in text.values())


def test_mixing_stage(spark, stages):
    _, before, after, cols = stages[4]
    taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect() if r.copies}
    assert Counter(r.doc_id for r in after) == Counter(taken)
    assert all(sorted(r.copy for r in after if r.doc_id == d) == list(range(1, n + 1)) for d, n in list(taken.items())[:20])


def test_run_applies_all_stages(spark, stages):
    assert Counter(P.run(spark, SF).collect()) == Counter(stages[4][2])


# ------------------------------------------------------------------ rows that stages must not confuse

ODD = [(2, "unique words of another kind stand here alone."), (2, "one two three four five six seven eight."),
       (1, "one two three four five six seven eight."), (1, "one two three four five six seven eight."),
       (None, "null rows have texts of their own as well."), (None, "null rows have texts of their own as well."),
       (None, "and this one is not like the other at all, no."), (7, None), (8, ""), (9, " \n"), (7, None)]


def _odd(spark, rows=None):
    cols = "doc_id long, text string, lang string, source string, n_chars long, copy int, id long, component_id long, n int"
    return spark.createDataFrame([(i, t, None, "s", None, 5, 6, 7, 8) for i, t in (ODD if rows is None else rows)], cols)


def test_near_dedup_of_rows_that_share_an_id(spark):
    got = P.near_dedup(spark, _odd(spark).repartition(3), SF)
    assert got.columns == _odd(spark).columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter(
        [(2, ODD[0][1]), (1, ODD[1][1]), (None, ODD[4][1]), (None, ODD[6][1]), (7, "")])


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_on_odd_rows_and_empty_tables(spark, stage):
    docs = _odd(spark)
    got = stage(spark, docs, SF)
    assert got.columns[:len(docs.columns)] == docs.columns and len(set(got.columns)) == len(got.columns)
    assert all(r.copy == 5 and r.id == 6 for r in got.collect())
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_odd_rows_keep_texts_and_ids_together(spark):
    docs = _odd(spark)
    assert Counter(r[:2] for r in P.decontaminate(spark, docs, SF).collect()) == Counter(ODD)
    assert Counter(r[:2] for r in P.redact_pii(spark, docs, SF).collect()) == Counter(ODD)
    kept = Counter(r[:2] for r in P.quality_filter(spark, docs, SF).collect())
    assert all(kept[x] in (0, n) for x, n in Counter(ODD).items()) and not any(not (t or "").strip() for _, t in kept)


@pytest.mark.parametrize("same", [5, None])
def test_mixing_meets_its_target_with_one_id(spark, same):
    rows = [(same, f"{'word ' * 9}{i}") for i in range(150)] + [(same, "again " * 10)] * 50
    other = [(i, "other words " * 100) for i in range(20)]
    docs = _odd(spark, rows).withColumn("source", P.mixing.F.lit("a")).unionAll(
        _odd(spark, other).withColumn("source", P.mixing.F.lit("b"))).repartition(4)
    mixed = mixing.mix(docs).collect()
    taken = sum(r.taken for r in mixed if r.doc_id == same and r.size == 10)
    assert abs(taken - mixed[[r.size for r in mixed].index(10)].target) <= 5
    got = mixing.take(docs)
    assert "_copy" in got.columns and got.filter("source = 'a'").count() * 10 == taken
    assert Counter(r[:8] for r in mixing.mix(docs.repartition(2)).collect()) == Counter(r[:8] for r in mixed)


def test_secrets_beside_placeholders():
    from quarry.llm import secret_scan
    value = "9fK3xQ7vLm2Zp8RtY6wB1nCd4sHj0aGe"
    for name in ("auth_key", "example_key", "placeholder_id"):
        found = [s for s in secret_scan.secret_spans(f"see {name}={value} ok") if s[0] == "entropy"]
        assert found == [("entropy", 5 + len(name), 5 + len(name) + len(value))], name
    assert not secret_scan.entropy_spans("XXXXXXXXXXXXXXXXXXXXXXXXXXXX") and not secret_scan.entropy_spans("your_token_example_0a1b2c")
    text = f"token={value}" * 300
    assert all(k == "assign" for k, _, _ in secret_scan.secret_spans(text))
