"""L1 log reading, and partition invariance of ordered operators: the same
result with 1, 3 and 8 shuffle partitions."""

import os

import pytest

from quarry.operators import explog as L
from quarry.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_read_full_and_short_logs(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "results.tsv")
    head = "\t".join(f.name for f in L.LOG_SCHEMA.fields)
    rows = ["1\tgbt\trmse\t10.5\t9.0\t10.5\t\t\t10.5\t\t\t\t\tkeep\tbaseline",
            "2\trf\trmse\t\t\t\t\t\t\t\t\t\t\tcrash\tOOM"]
    with open(p, "w") as f:
        f.write(head + "\n" + "\n".join(rows) + "\n")
    df = L.read_log(spark, p)
    r = df.orderBy("experiment").collect()
    assert r[0]["metric_value"] == 10.5 and r[0]["train_r2"] is None and r[1]["status"] == "crash"
    q = os.path.join(tmpdir_path, "short.tsv")
    with open(q, "w") as f:
        f.write("commit\tval_bpb\tmemory_gb\tstatus\tdescription\n"
                "a1b2c3d\t0.997900\t44.0\tkeep\tbaseline\nd4e5f6g\t0.000000\t0.0\tcrash\tdouble width (OOM)\n")
    s = L.read_log(spark, q, variant="short").collect()
    assert s[0]["val_bpb"] == 0.9979 and s[1]["status"] == "crash"


QUERIES = ["w7_stagnation", "l10_kept_progress", "t17_forward_fill_global", "e5_auc_by_lang", "w4_rolling_mean",
           "v4_stratified_kfold", "w9_crash_streaks", "w1_running_best", "w3_hits", "l4_near_baseline",
           "w10_lag_features", "j9_lagged_pairs", "x6_factorize_first_appearance", "v1_time_split",
           "b1_cap_corpus", "p6_serial_correlation", "k4_list_runs", "t9_bin"]


@pytest.mark.parametrize("name", QUERIES)
def test_partition_invariance(spark, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(sorted(tuple(r) for r in q(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
    assert X is not None


def test_log_fields_with_quotes_tabs_and_line_breaks(spark, tmpdir_path):
    from quarry.sources.files import write_table
    texts = ['{"k": 0}', 'a\tb', 'two\nlines', '"', '""', 'back\\slash "q"', 'plain', "tail \\"]
    cols = [f"cast({f'{i}.5' if f.dataType.simpleString() == 'double' else 'null'} as {f.dataType.simpleString()}) AS `{f.name}`"
            for i, f in enumerate(L.LOG_SCHEMA.fields) if f.name not in ("experiment", "description")]
    src = spark.createDataFrame(list(enumerate(texts)), "experiment long, description string")
    src = src.selectExpr("experiment", *cols, "description")
    for some in (src.select(*[f.name for f in L.LOG_SCHEMA.fields]), src.where("experiment IN (0, 5)").select(
            *[f.name for f in L.LOG_SCHEMA.fields])):
        p = os.path.join(tmpdir_path, f"log{some.count()}.tsv")
        write_table(some, p, fmt="tsv")
        assert {tuple(r) for r in L.read_log(spark, p).collect()} == {tuple(r) for r in some.collect()}
