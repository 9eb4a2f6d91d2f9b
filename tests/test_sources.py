"""Sources on small files written by the test: delimited sniffing, JSON
payloads, media inventory, bundles, embedded Derby over JDBC."""

import json
import os

from quarry.sources import files as IO
from quarry.sources import jdbc as DB
from quarry.sources import media as MD


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_sniff_semicolon_latin1(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    _write(p, "name;price;city\nCafé;1.5;Zürich\nBar;2;Genève\n".encode("latin-1"))
    df, sep, enc = IO.read_delimited(spark, p)
    assert (sep, enc) == (";", "latin-1")
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("Bar", 2.0, "Genève"), ("Café", 1.5, "Zürich")]


def test_single_column_falls_back_to_comma(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "one.csv")
    _write(p, b"value\n1\n2\n")
    df, sep, _ = IO.read_delimited(spark, p)
    assert sep == "," and df.columns == ["value"] and [r[0] for r in df.orderBy("value").collect()] == [1, 2]


def test_empty_table_is_an_error(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "empty.csv")
    _write(p, b"a,b\n")
    try:
        IO.read_delimited(spark, p)
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_json_payload_unwrapping(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "payload.json")
    _write(p, json.dumps({"meta": {"n": 2}, "results": [{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": "y"}}]},
                         indent=2).encode())
    df = IO.read_json_payload(spark, p)
    assert sorted(df.columns) == ["a", "b.c"] and df.count() == 2
    q = os.path.join(tmpdir_path, "obj.json")
    _write(q, json.dumps({"x": {"y": 1}, "z": "w"}, indent=2).encode())
    assert sorted(IO.read_json_payload(spark, q).columns) == ["x.y", "z"]
    r = os.path.join(tmpdir_path, "arr.json")
    _write(r, json.dumps([{"k": 1}, {"k": 2}]).encode())
    assert IO.read_json_payload(spark, r).count() == 2


def _like_pandas(spark, path, enc="utf-8"):
    import pandas as pd
    df, _, got = IO.read_delimited(spark, path)
    assert got == enc
    want = pd.read_csv(path, encoding=enc)
    assert df.columns == list(want.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.itertuples(index=False, name=None), key=str)


def test_quoted_fields_like_pandas(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "q.csv")
    _write(p, b'id,"say, what",note\n1,"say ""hi"", ok",plain\n2,"two\nlines","a ""b"" c"\n3,"x,y","last, ""one"""\n')
    _like_pandas(spark, p)
    q = os.path.join(tmpdir_path, "split.csv")
    _write(q, b'id,note\n1,"say ""hi"", ok"\n2,plain\n')
    _like_pandas(spark, q)


def test_character_across_the_first_chunk(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "long.csv")
    head = b"id,word\n"
    rows = b"".join(b"%06d,%s\n" % (i, b"x" * 56) for i in range(1023))
    body = head + rows
    pad = 65535 - len(body) - len(b"999999,")
    assert pad > 0
    _write(p, body + b"999999," + b"y" * pad + "é".encode() + b"z\n" + "1000000,café\n".encode())
    _like_pandas(spark, p)


def test_late_latin1_byte(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "late.csv")
    _write(p, b"id,word\n" + b"".join(b"%d,plain\n" % i for i in range(9000)) + "9000,café\n".encode("latin-1"))
    _like_pandas(spark, p, "latin-1")


def test_written_csv_is_standard(spark, tmpdir_path):
    import glob

    import pandas as pd
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, "x,y"), (4, "plain")]
    out = os.path.join(tmpdir_path, "out")
    IO.write_table(spark.createDataFrame(rows, "id long, note string").coalesce(1), out, "csv")
    got = pd.read_csv(glob.glob(out + "/part-*")[0])
    assert sorted(got.itertuples(index=False, name=None)) == rows
    assert sorted(map(tuple, IO.read_delimited(spark, out)[0].collect())) == rows


def test_json_lines_with_long_records(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "long.jsonl")
    _write(p, b"".join(json.dumps({"id": i, "t": '{"[' + "x" * (90000 if i == 0 else 5)}).encode() + b"\n" for i in range(50)))
    assert IO.read_json_payload(spark, p).count() == 50
    assert IO.read_any(spark, p).count() == 50
    q = os.path.join(tmpdir_path, "pretty.json")
    _write(q, json.dumps({"pad": "y" * 9000, "items": [{"a": 1}, {"a": 2}, {"a": 3}]}, indent=1).encode())
    assert IO.read_json_payload(spark, q).count() == 3


def test_media_inventory_images_win(spark, tmpdir_path):
    for cls in ("cat", "dog"):
        for i in range(3):
            _write(os.path.join(tmpdir_path, cls, f"{i}.png"), b"\x89PNG")
    _write(os.path.join(tmpdir_path, "dog", "bark.wav"), b"RIFF")
    _write(os.path.join(tmpdir_path, ".hidden", "x.png"), b"\x89PNG")
    inv = MD.media_inventory(spark, tmpdir_path)
    assert inv["media_type"] == "image" and inv["total"] == 6
    assert {r["label"]: r["files"] for r in inv["classes"].collect()} == {"cat": 3, "dog": 3}


def test_bundle_primary_choice(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "train_extra.csv"), b"a\n1\n")
    _write(os.path.join(tmpdir_path, "train.csv"), b"a,b\n1,2\n")
    _write(os.path.join(tmpdir_path, "test.csv"), b"a\n1\n" * 50)
    _write(os.path.join(tmpdir_path, "sample_submission.csv"), b"id,y\n1,0\n")
    roles = {r["entry"]: r["role"] for r in MD.resolve_bundle(spark, tmpdir_path).collect()}
    assert roles == {"train.csv": "primary", "train_extra.csv": "extra", "test.csv": "test",
                     "sample_submission.csv": "submission"}
    sample, _, _ = IO.read_delimited(spark, os.path.join(tmpdir_path, "sample_submission.csv"))
    train, _, _ = IO.read_delimited(spark, os.path.join(tmpdir_path, "train.csv"))
    lay = {r["column"]: (r["role"], r["must_be_computed"]) for r in MD.sample_layout(sample, train).collect()}
    assert lay == {"id": ("id", False), "y": ("target", True)}


def test_derby_jdbc_query_and_table(spark):
    url = "jdbc:derby:memory:quarrytest;create=true"
    opts = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    DB.write_jdbc(spark.range(100).selectExpr("id AS ID", "id * 2 AS V"), url, "T1", options=opts)
    q = DB.read_jdbc(spark, url, query="SELECT * FROM T1 WHERE V > 150", options=opts)
    assert q.count() == 24
    t = DB.read_jdbc(spark, url, table="T1", limit=10, options=opts, partition=("ID", 0, 100, 4))
    assert t.count() == 10
    try:
        DB.read_jdbc(spark, url, table="T1; DROP TABLE T1", options=opts)
        raise AssertionError("expected a name error")
    except ValueError:
        pass


def test_connector_urls():
    url, opts = DB.connection("postgresql", {"host": "h", "database": "d", "user": "u"})
    assert url == "jdbc:postgresql://h:5432/d" and opts["user"] == "u" and opts["queryTimeout"] == "30"


def test_records_behind_an_empty_first_file(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "part.json")
    _write(os.path.join(root, "part-00000.json"), b"")
    _write(os.path.join(root, "part-00001.json"), b'{"k":1,"info":{"a":"x"}}\n{"k":2,"info":{"a":"y"}}\n')
    got = IO.read_json_payload(spark, root).orderBy("k").collect()
    assert [(r["k"], r["info.a"]) for r in got] == [(1, "x"), (2, "y")]


def test_media_inventory_lists_its_files_once(spark, tmpdir_path):
    for i in range(40):
        _write(os.path.join(tmpdir_path, f"class{i % 3}", f"f{i}.PNG"), b"x")
    _write(os.path.join(tmpdir_path, "top.png"), b"x")
    _write(os.path.join(tmpdir_path, "_hidden", "f.png"), b"x")
    inv = MD.media_inventory(spark, tmpdir_path)
    assert (inv["media_type"], inv["total"]) == ("image", 41)
    assert sorted(tuple(r) for r in inv["classes"].collect()) == [("class0", 14), ("class1", 13), ("class2", 13)]
    assert [r["rel"] for r in inv["samples"].collect()][:2] == ["class0/f0.PNG", "class0/f12.PNG"]
    for part in ("rows", "classes", "samples"):
        assert "binaryfile" not in inv[part]._jdf.queryExecution().toString().lower()


def test_text_files_are_written_and_listed_by_tasks(spark, tmpdir_path):
    rows = [("en", "a"), ("en", "b\nc"), ("a/b:c", "ä"), (None, "x"), ("", None), ("_d", "y")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    import glob
    ours, spark_s = os.path.join(tmpdir_path, "ours"), os.path.join(tmpdir_path, "sparks")
    IO.write_text_files(df.repartition(3), ours, "lang", "text")
    df.write.option("maxRecordsPerFile", 1).partitionBy("lang").text(spark_s)

    def found(root):
        files = [f for f in glob.glob(root + "/lang=*/**/*.txt", recursive=True) if os.path.isfile(f)]
        return sorted((os.path.relpath(f, root).split("/")[0], open(f, "rb").read()) for f in files)

    assert found(ours) == found(spark_s) and len(found(ours)) == 18
    assert not glob.glob(ours + "/**/.*.crc", recursive=True)      # no second file a text
    _write(os.path.join(ours, "lang=en", ".hidden.txt"), b"x")
    _write(os.path.join(ours, "_gone", "x.txt"), b"x")
    listed = MD.kept_listing(spark, ours).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, MD.list_files(spark, ours).collect())) and len(listed) == 18
    plan = MD.list_local_files(spark, ours)._jdf.queryExecution().toString().lower()
    assert "binaryfile" not in plan     # the driver holds folders, not files
