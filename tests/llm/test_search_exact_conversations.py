"""Lexical search, exact duplicates and conversation repair against brute force: nulls in
any column, empty and long texts, ties, repeated rows, empty tables, clashing names, and
the splitting of large strata, buckets and conversations."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

import __spark_entry__ as E
from quarry.llm import conversation_repair as R
from quarry.llm import exact_dedup, lexical_search

SF = "/root/testdata/sf0.001"
EXTRA = "id long, key long, n string, m int, score int, item int, rank int, top int, link int, bucket int, row int, digest int"


def _texts(rng):
    vocab = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "naïve", "x-y", "😀", "THE", "the", "a1"]
    out = [None, "", " \t\n", "...", "The the THE.", "w1", "w1 " * 3000, "é" * 5000 + " w2", "\x00w3\x7fw4"]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    return out + out[5:25] + out[5:15]


def _table(spark, rows, schema):
    return spark.createDataFrame([(*r, *[1, 2, "z", *range(9)]) for r in rows], f"{schema}, {EXTRA}").repartition(3)


# ------------------------------------------------------------------ search

@pytest.mark.parametrize("postings,terms,items", [(10**6, 10**4, 500), (50, 3, 2)])
def test_search_equals_brute_force(spark, postings, terms, items):
    rng = random.Random(3)
    docs = [(None if i % 17 == 3 else i // 2 if i % 5 == 0 else i, t) for i, t in enumerate(_texts(rng))]
    asks = [(1, "the W1 w2 été"), (2, ""), (3, None), (None, "w3 w3 w4 😀"), (1, "the W1 w2 été"), (5, "nowhere"),
            (6, "x y"), (7, " ".join(f"w{i}" for i in range(30)))]
    cfg = lexical_search.Config(block_postings=postings, block_terms=terms, block_items=items)
    got = lexical_search.search(_table(spark, docs, "doc_id long, text string"),
                                _table(spark, asks, "item_id long, text string"), cfg)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.ranked(docs, asks))
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.filter("doc_id = 2"), items).count() == 0


def test_strata_below_the_last_score_are_not_visited():
    """One impact per (stratum, term, tf); bounds hold and end a query early."""
    rng = np.random.default_rng(1)
    n = 400
    m = rng.integers(80, 84, n) * np.where(np.arange(n) < 300, 1, 40)
    size = rng.integers(1, 6, n)
    owner = np.repeat(np.arange(n), size)
    term = np.concatenate([rng.choice(8, s, replace=False) for s in size])
    tf = rng.integers(1, 4, len(owner))
    block = lexical_search.Stratified(m, owner, term, tf, 8)
    keys = {(int(m[o]), int(t), int(f)) for o, t, f in zip(owner, term, tf)}
    assert len(block.impact) == len(keys)
    queries = [(np.array(t, np.int64), np.array(w, np.int64)) for t, w in (((0, 3), (5, 2)), ((7,), (1,)), ((), ()))]
    tops = [lexical_search.Top(5) for _ in queries]
    visits = lexical_search.search_block(block, np.arange(n), np.zeros(n, bool), queries, tops)
    assert visits < 2 * len(block.m)
    for (terms, weights), top in zip(queries, tops):
        w = dict(zip(terms.tolist(), weights.tolist()))
        score = Counter()
        for o, t, f in zip(owner.tolist(), term.tolist(), tf.tolist()):
            if t in w:
                score[o] += w[t] * lexical_search.impact(f, int(m[o]))
        assert list(zip((-top.score).tolist(), top.id.tolist())) == sorted((-s, i) for i, s in score.items())[:5]
        if w:
            bounds = block.bounds(terms, weights)
            assert all(s <= bounds[np.searchsorted(block.m, m[o])] for o, s in score.items())
            for exact in (True, False):
                got = block.scores(np.ones(len(block.m), bool), terms, weights, exact)
                assert {i: s for i, s in enumerate(got.tolist()) if s} == score


# ------------------------------------------------------------------ exact duplicates

def _want(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return [(i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
             hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]


@pytest.mark.parametrize("capacity", [1 << 16, 8, 1])
def test_exact_duplicates(spark, capacity):
    rng = random.Random(4)
    texts = _texts(rng) + ["hot"] * 300 + ["hot "] * 3 + ["é", "é"]
    rows = [(None if i % 19 == 4 else i // 2 if i % 7 == 0 else i, t) for i, t in enumerate(texts)] + [(None, "alone")] * 2
    got = exact_dedup.duplicates(_table(spark, rows, "doc_id long, text string"), capacity=capacity).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(_want(rows))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_duplicates_of_an_empty_table(spark):
    assert exact_dedup.duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_directory(spark):
    """Buckets hold at most ``capacity`` keys, their cells tile the directory, the depth
    is the least that does it, and equal keys are chained."""
    rng = random.Random(5)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(500)] + [(7 << 40) + i for i in range(60)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    table, bits = exact_dedup.directory(df, 20)
    cells = {r.cell: (r.bucket, r.depth) for r in table.collect()}
    assert sorted(cells) == list(range(1 << bits)) and max(d for _, d in cells.values()) == bits
    held = Counter(cells[(k % (1 << 64)) >> (64 - bits)][0] for k in keys)
    for cell, (bucket, depth) in cells.items():
        assert bucket == cell >> (bits - depth) << (bits - depth)
    crowded = cells[(7 << 40) >> (64 - bits)][0]
    assert all(n <= 20 for b, n in held.items() if b != crowded)
    # a bucket's parent would be overfull
    for bucket, depth in set(cells.values()):
        if depth:
            parent = bucket >> (bits - depth + 1)
            assert sum((k % (1 << 64)) >> (64 - depth + 1) == parent for k in keys) > 20


def test_collisions_are_chained(spark, monkeypatch):
    from pyspark.sql import functions as F
    plain = exact_dedup.keyed
    monkeypatch.setattr(exact_dedup, "keyed", lambda *a: plain(*a).withColumn("key", F.length("text") % 3))
    texts = ["a", "b", "a", "cc", "dd", "cc", "eee", "", None, "a" * 4]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.duplicates(docs, capacity=1).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(_want(rows))
    entries = exact_dedup.build(docs, capacity=1).entries.collect()
    links = defaultdict(list)
    for r in entries:
        links[r.key].append(r.link)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in links.values()) and max(map(len, links.values())) == 3


def test_kept_index_answers_later_tables(spark, tmpdir_path):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    exact_dedup.save(exact_dedup.build(docs, capacity=4), tmpdir_path + "/index")
    index = exact_dedup.load(spark, tmpdir_path + "/index")
    asked = spark.createDataFrame([(1, "text 3"), (2, "text 41"), (None, None), (4, "text 39")], "doc_id long, text string")
    assert {(r.doc_id, r.found) for r in exact_dedup.lookup(index, asked).collect()} == {(1, 83), (2, None), (None, None), (4, 79)}


def test_exact_dedup_runs_no_python(spark):
    plan = E.queries()["op12_exact_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ conversations

def _conversations(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    said = ["Hi.", "Yes!", "no", "", " \n", None, "Why?  ", "so be it", "é", "x" * 3000 + "."]
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            turn = rng.choice([t, t, t, t + 1, None, 2 * t])
            role = ["user", "assistant"][t % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = f"line {rng.random()}." if rng.random() < 0.6 else rng.choice(said)
            rows.append((None if c == 3 else c, turn, role, text))
    return rows + rows[:9]


def _query(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    from quarry.llm import queries
    monkeypatch.setattr(queries, "_table", lambda *a: df)
    return {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, SF).collect()}


@pytest.mark.parametrize("segment,fan", [(4096, 256), (2, 2)])
def test_conversations_equal_brute_force(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(R, "SEGMENT", segment)
    monkeypatch.setattr(R, "FAN", fan)
    rng = random.Random(6)
    rows = _conversations(rng, 60) + [(900, t, rng.choice(["user", "assistant"]), f"t{rng.randrange(9)}.") for t in range(70)]
    want = {c: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | brute.conversations(brute.damaged(rows))
    assert _query(spark, rows, monkeypatch) == want


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, pos int, seg int, conv int, codes int")
    done = R.repair(R.damage(df))
    assert done.messages.count() == done.conversations.count() == R.digests(done.messages).count() == 0


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi.", 5, 6, 7, 8), (1, 1, "assistant", "Yes.", 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, seg int, conv int, fault int")
    assert R.repair(df).conversations.first().asDict() == {
        "conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "KK"}


@pytest.mark.parametrize("costs", [(1, 2, 5, 5), (3, 4, 1, 2), (1, 1, 1, 1), (2, 7, 2, 0)])
def test_search_equals_whole_strings(costs):
    """Every code string of up to five rows, and long random ones cut at any place."""
    own = R.Costs(*costs)
    rng = random.Random(7)

    def want(codes):
        rows = [("o" if c == "x" else c.lower(), "b" if c == "x" else "t" if c.isupper() else "-", c, "") for c in codes]
        return brute.cheapest(rows, costs)

    strings = ["".join(x) for n in range(5) for x in itertools.product("suaxUA", repeat=n)]
    strings += ["".join(rng.choice("suaoxSUAO") for _ in range(rng.randint(5, 60))) for _ in range(150)]
    strings += ["u" * 51, "ua" * 30 + "a" + "ua" * 30, "uu" * 20 + "x" + "a" * 9]
    for codes in strings:
        cost, audit, made = want(codes)
        got, pieces = R.search(codes, costs=own)
        assert (got, "".join(pieces)) == (cost, audit)
        letters = "".join(R.made_roles(pieces, codes))
        assert len(letters) == len(made) and len(pieces) == len(codes) + 1
    for codes in strings[-60:]:
        cut = sorted(rng.sample(range(len(codes) + 1), 3))
        parts = [p for p in (codes[a:b] for a, b in zip([0, *cut], [*cut, len(codes)]))]
        sums = [R.summary(p, own) for p in parts]
        path = R.route([R.combine(sums[:2]), R.combine(sums[2:])], 0, None, own)
        path = R.route(sums[:2], 0, path[0], own) + R.route(sums[2:], path[0], None, own)
        entry, audit, cost = 0, "", 0
        for p, to in zip(parts[:-1], path):
            c, pieces = R.search(p, entry, to, own)
            entry, audit, cost = to, audit + "".join(pieces), cost + c
        c, pieces = R.search(parts[-1], entry, None, own)
        assert (cost + c, audit + "".join(pieces)) == want(codes)[:2]


def test_edits_are_emitted_when_survivors_meet():
    """A clean stretch leaves a few rows unresolved, and released branches leave the tree."""
    run = R.Search(0, R.Costs())
    for i in range(10_000):
        run.step("uua"[i % 3] if i % 50 == 0 else "ua"[i % 2])

    level, held = [run.root], 0
    while level:
        held += len(level)
        level = [k for n in level for k in n.kids]
    assert held < 100 and len(run.out) > 9_900
    same = R.Search(0, R.Costs())       # an unresolved choice is held until it is resolved
    for _ in range(301):
        same.step("u")
    assert "".join(same.pieces(same.end())) == "D" + "KR" * 150
