"""Profiling and joins on small tables (pandas as expected value)."""

import pandas as pd

from quarry.operators import joins as J
from quarry.operators import profile as P


def test_semantic_types(spark):
    n = 100
    pdf = pd.DataFrame({
        "num_text": [str(i) for i in range(n)],
        "dates": [f"2024-01-{(i % 28) + 1:02d}" for i in range(n)],
        "cat": ["a" if i % 3 else "b" for i in range(n)],
        "long_text": ["word " * 12 + str(i) for i in range(n)],
        "paths": [f"img/{i}.png" for i in range(n)],
        "ids": [f"id{i}" for i in range(n)],
        "empty": [None] * n,
    })
    df = spark.createDataFrame(pdf, "num_text string, dates string, cat string, long_text string, paths string, "
                                    "ids string, empty string")
    types = {r["name"]: r["type"] for r in P.profile_columns(df).collect()}
    assert types == {"num_text": "numeric", "dates": "datetime", "cat": "categorical", "long_text": "text",
                     "paths": "filepath", "ids": "high_cardinality", "empty": "empty"}


def test_numeric_stats_match_pandas(spark):
    s = pd.Series([1.0, 2.0, 2.0, 3.0, 10.0, None])
    df = spark.createDataFrame([(v,) for v in s.tolist()], "x double")
    r = P.profile_columns(df).first()
    x = s.dropna()
    assert r["mean"] == round(x.mean(), 4) and r["std"] == round(x.std(), 4)
    assert (r["p25"], r["p50"], r["p75"]) == tuple(round(x.quantile(q), 4) for q in (0.25, 0.5, 0.75))
    assert r["skew"] == round(x.skew(), 3)
    assert r["nulls"] == 1 and r["unique"] == 4


def test_class_balance_and_top_values(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbc"], "c string")
    bal = {r["value"]: r["share"] for r in P.class_balance(df).collect()}
    assert bal == {"a": 0.5, "b": 0.333, "c": 0.167}
    r = P.profile_columns(df).first()
    assert [t["value"] for t in r["top_values"]] == ["a", "b", "c"] and r["majority_pct"] == 50.0


def test_null_keys_match_in_auto_join(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "cust_id long, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "cust_id long, v string")
    out, info = J.auto_join({"a.csv": a, "b.csv": b})
    got = [(r["cust_id"], r["v"], r["v_b"]) for r in out.collect()]
    exp = pd.merge(pd.DataFrame({"cust_id": [1, None], "v": ["x", "y"]}),
                   pd.DataFrame({"cust_id": [1, None, 3], "v_b": ["p", "q", "r"]}), on="cust_id", how="outer")
    assert len(got) == len(exp) == 3
    assert (None, "y", "q") in got and (3, None, "r") in got and info["key"] == "cust_id"


def test_concat_without_common_columns(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([("x",)], "b string")
    out, info = J.auto_join({"a": a, "b": b})
    assert info["method"] == "concat" and out.columns == ["a", "b"] and out.count() == 2


def test_fan_out_prediction(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (1,), (3,)], "k int")
    r = J.fan_out(a, b, "k").first()
    assert (r["rows_before"], r["rows_after"], r["warn"]) == (3, 2 * 3 + 1 + 1, True)


def test_approximate_profile_close_to_exact(spark):
    from quarry.session import read_table
    o = read_table(spark, "/root/testdata/sf0.001", "orders")
    ex = {r["name"]: r for r in P.profile_columns(o).collect()}
    ap = {r["name"]: r for r in P.profile_columns(o, exact=False).collect()}
    assert {k: v["type"] for k, v in ex.items()} == {k: v["type"] for k, v in ap.items()}
    for k, v in ex.items():
        assert abs(ap[k]["unique"] - v["unique"]) <= 0.05 * max(v["unique"], 1)
        if v["p50"] is not None:
            assert abs(ap[k]["p50"] - v["p50"]) <= 0.02 * max(abs(v["p50"]), 1.0) + 1e-9


def test_products_of_frequent_keys_are_made_in_blocks(spark, monkeypatch):
    from collections import Counter
    left = [(None if i % 2 else i % 5, f"l{i % 30}") for i in range(60)]
    right = [(None if i % 3 else i % 7, i % 20) for i in range(90)]
    l, r = spark.createDataFrame(left, "id long, a string"), spark.createDataFrame(right, "id long, b int")
    keys = {k for k, _ in left}
    want = Counter((k, a, b) for k, a in left for j, b in right if j == k)
    want += Counter((k, a, None) for k, a in left if not any(j == k for j, _ in right))
    want += Counter((j, None, b) for j, b in right if j not in keys)
    heavy = {x["id"]: x["__a"] * x["__b"] for x in J.heavy_keys(l, r, "id", rows=50).collect()}
    assert heavy[None] >= 30 * 60 / 50 and 0 < len(heavy) < len(keys)
    monkeypatch.setattr(J, "PRODUCT_ROWS", 50)
    out, _ = J.auto_join({"l.csv": l, "r.csv": r}, key="id")
    assert Counter(map(tuple, out.collect())) == want
    assert "__a" in out._jdf.queryExecution().optimizedPlan().toString()


def test_large_products_of_three_tables_are_not_kept(spark, monkeypatch):
    """Keys that are large, that a table lacks, or that only the last has; key columns of two types."""
    from collections import Counter
    t = [[(None if i % 2 else i % 4, f"a{i % 9}") for i in range(40)],
         [(None if i % 3 else i % 5, i % 11) for i in range(60)] + [(77, i) for i in range(9)],
         [(None if i % 4 else i % 6, float(i)) for i in range(30)] + [(77, 1.0)] * 8 + [(2, 5.0)] * 30 + [(88, 2.0)]]
    keys = {k for x in t for k, _ in x}
    want = Counter()
    for k in keys:
        a, b, c = ([v for j, v in x if j == k] or [None] for x in t)
        want += Counter((k, x, y, z) for x in a for y in b for z in c)
    made = []
    for name in ("cut_lineage", "keep_table"):
        keep = getattr(J, name)
        monkeypatch.setattr(J, name, lambda df, *a, keep=keep: made.append(df.count()) or keep(df, *a))
    for rows, blocks in ((1 << 24, 64), (40, 64), (40, 1)):
        monkeypatch.setattr(J, "PRODUCT_ROWS", rows)
        monkeypatch.setattr(J, "CORE_BLOCKS", blocks, raising=False)
        made.clear()
        tables = {n: spark.createDataFrame(x, f"id {kind}, v {v}") for n, x, kind, v in
                  zip(("a.csv", "b.csv", "c.csv"), t, ("int", "long", "int"), ("string", "long", "double"))}
        out, info = J.auto_join(tables, key="id")
        assert Counter(map(tuple, out.collect())) == want and out.columns == ["id", "v", "v_b", "v_c"]
        assert [w.split(" grows")[0] for w in info["warnings"]] == ["joining 'b.csv'", "joining 'c.csv'"]
        # the product of the first two tables' null keys has 800 rows
        assert rows > 40 or made and max(made) < 100


def test_profile_parses_each_text_value_once_and_ranks_numbers_only(spark, monkeypatch):
    # texts weigh as often as they occur: 9 of 10 rows are numbers in two distinct values
    rows = [("1.5" if i % 2 else "4", f"word {i % 7}", float(i), "2024-01-0%d" % (i % 9 + 1)) for i in range(90)]
    rows += [("n/a", None, float("nan"), "x"), (None, "word 0", float("inf"), None)] * 5
    df = spark.createDataFrame(rows, "t string, w string, x double, d string")
    ranked = []

    def quantiles(frame, cols, *a, **k):
        ranked.extend(cols)
        return quantiles_df(frame, cols, *a, **k)

    from quarry.operators.stats import quantiles_df
    monkeypatch.setattr(P, "quantiles_df", quantiles)
    r = {x["name"]: x for x in P.profile_columns(df).collect()}
    assert ranked == ["t", "x"]     # words and dates have no quartiles
    assert {n: x["type"] for n, x in r.items()} == {"t": "numeric", "w": "high_cardinality", "x": "numeric", "d": "datetime"}
    assert (r["t"]["mean"], r["t"]["p50"], r["t"]["nulls"], r["t"]["unique"]) == (2.75, 2.75, 5, 3)
    assert (r["x"]["nulls"], r["x"]["unique"], r["x"]["max"], r["x"]["p50"]) == (5, 91, 89.0, 46.75 + 0.25)
    assert (r["w"]["majority_pct"], r["w"]["nulls"], r["d"]["nulls"], r["d"]["unique"]) == (18.9, 5, 5, 10)


def test_flagship_profiles_a_columnar_copy_of_the_join(spark, tmp_path, monkeypatch):
    from quarry.plans import flagship as FL
    spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 4.0)], "l_orderkey long, l_quantity double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "a"), (None, "b"), (7, "c")], "o_orderkey long, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet"))
    seen = []
    monkeypatch.setattr(FL, "profile_columns", lambda df: seen.append(df) or P.profile_columns(df))
    r = {x["name"]: x for x in FL.flagship(spark, str(tmp_path)).collect()}
    # each pass reads the columns it needs from files, not whole rows
    assert seen[0].inputFiles() and all(f.endswith(".parquet") for f in seen[0].inputFiles())
    assert sorted(map(str, seen[0].collect())) == sorted(map(str, spark.createDataFrame(
        [(1, 2.0, "a"), (1, 3.0, "a"), (None, 4.0, "b"), (7, None, "c")],
        "orderkey long, l_quantity double, o_orderstatus string").collect()))
    assert (r["orderkey"]["nulls"], r["l_quantity"]["p50"], r["o_orderstatus"]["unique"]) == (1, 3.0, 3)
