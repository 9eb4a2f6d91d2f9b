"""Corpus preparation: BPE equals a plain-Python BPE, decode(encode(x)) = x,
packed rows have exactly T+1 ids, bits per byte is positive."""

import collections
import random

import pytest
import regex
from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.operators.evaluation import bits_per_byte
from quarry.plans import q_corpus

TEXTS = ["Hello world! Numbers: 123. Unicode: 你好", "the cat sat on the mat", "the the the cat",
         "Le café est très chaud, n'est-ce pas?", "über straße 42 \n\n  spaces   here"]


def _ref_bpe(texts, n):
    sp = regex.compile(C.SPLIT_PATTERN)
    wc = collections.Counter(p for t in texts for p in sp.findall(t))
    words = {tuple(w.encode()): c for w, c in wc.items()}
    merges = []
    for r in range(n):
        pc = collections.Counter()
        for w, c in words.items():
            for i in range(len(w) - 1):
                pc[(w[i], w[i + 1])] += c
        if not pc:
            break
        (a, b), _ = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))
        merges.append((a, b))
        nw = collections.Counter()
        for w, c in words.items():
            out, i = [], 0
            while i < len(w):
                if i < len(w) - 1 and (w[i], w[i + 1]) == (a, b):
                    out.append(256 + r)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            nw[tuple(out)] += c
        words = dict(nw)
    return merges


def test_bpe_equals_reference_and_round_trips(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    merges = C.train_bpe(C.pretoken_counts(df), 256 + 4 + 12, checkpoint_every=5)
    assert merges == _ref_bpe(TEXTS, 12)
    assert C.train_bpe_incremental(C.pretoken_counts(df), 256 + 4 + 12, checkpoint_every=5) == merges
    audit = C.round_trip_audit(df, merges).first()
    assert audit["mismatches"] == 0 and audit["documents"] == len(TEXTS)
    enc = C.encode(df, merges)
    bos = 256 + len(merges)
    assert all(r["ids"][0] == bos for r in enc.collect())


def test_merges_taken_together_equal_one_by_one(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aab") * rng.randint(1, 4) for _ in range(rng.randint(1, 5))) for _ in range(30))
             for _ in range(6)] + ["aaaaaaa", "", "éé ééé 你好你好"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    expected = _ref_bpe(texts, 200)
    assert C.train_bpe(C.pretoken_counts(df), 256 + 4 + 200, checkpoint_every=7) == expected
    assert any(a == b for a, b in expected) and len(expected) > 100
    assert C.train_bpe(C.pretoken_counts(df), 256 + 4 + 31, checkpoint_every=3) == expected[:31]


def test_training_takes_many_merges_a_round(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(12)]
    texts += ["aaaaaaaaa aaaa", "", "abababab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    expected = _ref_bpe(texts, 300)
    rounds, step = [], C._merge_step
    monkeypatch.setattr(C, "_merge_step", lambda pairs, first: rounds.append(len(pairs)) or step(pairs, first))
    assert C.train_bpe(C.pretoken_counts(df), 256 + 4 + 300) == expected
    assert sum(rounds) == len(expected) and len(rounds) <= 3
    # small bounds (all runs, few runs, one pair a round) give the same merges
    for most, run_ids in ((7, 1 << 19), (64, 300), (1, 2)):
        assert C.train_bpe(C.pretoken_counts(df), 256 + 4 + 60, most=most, run_ids=run_ids) == expected[:60]


def test_queries_train_the_whole_vocabulary_once(spark, monkeypatch, tmpdir_path):
    asked = []
    monkeypatch.setattr(q_corpus, "checkpoint_dir", lambda spark: tmpdir_path)
    monkeypatch.setattr(C, "train_bpe", lambda counts, size, *a, **k: asked.append(size) or [(97, 98)])
    for again in (False, False, True):
        assert q_corpus.merges_for(spark, "/root/testdata/sf0.001", train_anew=again) == [(97, 98)]
    assert asked == [8192, 8192]
    q_corpus.merges_for(spark, "/root/testdata/sf0.01")
    assert asked == [8192] * 3


def test_pretokens_match_python_regex(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r["piece"] for r in C.pretokens(df).collect()]
    exp = [p for t in TEXTS for p in regex.findall(C.SPLIT_PATTERN, t)]
    assert got == exp


def test_pack_keeps_every_token(spark):
    import random
    rng = random.Random(3)
    docs = [[d] + [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 8, 9, 20, 45]))] for d in range(300)]
    df = spark.createDataFrame([(d,) for d in docs] + [(None,), ([],)], "ids array<int>")
    total = sum(map(len, docs))
    for parts in (1, 8, 64):
        rows = C.pack(df.repartition(parts), length=8, buffer=20).collect()
        assert sum(r["n_tokens"] + r["n_cropped"] for r in rows) == total
        assert all(len(r["row"]) == r["n_tokens"] <= 9 for r in rows)
        assert sum(r["n_tokens"] < 9 for r in rows) <= parts
        whole = C.pack(df.repartition(parts), length=8, buffer=20, crop=False).collect()
        assert sum(r["n_tokens"] for r in whole) == total and not any(r["n_cropped"] for r in whole)
        assert sorted(t for r in whole for t in r["row"]) == sorted(t for d in docs for t in d)
    st = C.shift_targets(C.pack(df, length=8).where("n_tokens = 9")).first()
    assert len(st["inputs"]) == len(st["targets"]) == 8 and st["inputs"][1:] == st["targets"][:-1]


@pytest.mark.parametrize("crop", [True, False])
@pytest.mark.parametrize("parts", [1, 3, 16])
def test_corpus_packing_leaves_one_short_row(spark, parts, crop):
    rng = random.Random(parts)
    seqs = [[1000 * i + j for j in range(rng.choice([0, 1, 2, 3, 5, 8, 9, 30]))] for i in range(120)] + [None]
    df = spark.createDataFrame([(x,) for x in seqs], "ids array<int>").repartition(parts)
    rows = C.pack_corpus(df, length=8, buffer=5, crop=crop).collect()
    want = sorted(t for x in seqs if x for t in x)
    kept = [t for r in rows for t in r["row"]]
    assert len(set(kept)) == len(kept) and set(kept) <= set(want)
    assert len(kept) + sum(r["n_cropped"] for r in rows) == len(want)
    assert sum(r["n_tokens"] < 9 for r in rows) <= 1 and all(len(r["row"]) == r["n_tokens"] <= 9 for r in rows)
    if crop:  # every sequence keeps a beginning, in one row
        starts = {t for r in rows for t in r["row"] if t % 1000 == 0}
        assert starts == {x[0] for x in seqs if x}
        assert all(t % 1000 == 0 or (i and r["row"][i - 1] == t - 1) for r in rows for i, t in enumerate(r["row"]))
    else:
        assert sorted(kept) == want
    empty = spark.createDataFrame([], "ids array<int>")
    assert C.pack_corpus(empty, length=8, crop=crop).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_planned_rows_use_every_sequence_once(seed):
    rng = random.Random(seed)
    hist = {n: rng.choice([1, 3, 50, 10**9]) for n in rng.sample(range(1, 40), 12)}
    plan = C.plan_rows(hist, 40)
    for n, c in hist.items():
        spans = sorted((a, b) for m, a, b, _, _ in plan if m == n)
        assert spans[0][0] == 0 and spans[-1][1] == c and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    kinds = {}
    for n, a, b, row, slot in plan:
        kinds.setdefault(row, []).append((slot, n, b - a))
    for k, (_, kind) in enumerate(sorted(kinds.items())):
        sizes = [n for _, n, _ in sorted(kind)]
        assert len({t for _, _, t in kind}) == 1 and sum(sizes[:-1]) < 40
        assert sum(sizes) >= 40 or (k == len(kinds) - 1 and kind[0][2] == 1)


def test_pack_takes_the_longest_that_fits(spark):
    df = spark.createDataFrame([([9] * n,) for n in (3, 9, 4, 20, 7, 1, 15, 6)], "ids array<int>").coalesce(1)
    rows = C.pack(df, length=9, buffer=8).collect()
    assert [(r["n_tokens"], r["n_cropped"]) for r in rows] == [(10, 0), (10, 0), (10, 0), (10, 5), (10, 10)]


def test_cap_corpus_keeps_crossing_document(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([5, 5, 5, 5])], "doc_id long, text string")
    out = C.cap_corpus(df, ["doc_id"], doc_cap=4, max_chars=9)
    assert [(r["doc_id"], len(r["doc"])) for r in out.orderBy("doc_id").collect()] == [(0, 4), (1, 4), (2, 4)]


def test_bits_per_byte_excludes_special_tokens(spark):
    vocab = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "token_id int, n_bytes int")
    scored = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 9.0)], "token_id int, nats double")
    import math
    assert abs(bits_per_byte(scored, vocab).first()["bpb"] - 1.5 / (math.log(2) * 3)) < 1e-12
    assert F is not None


def _rescanned(ids, ranks):
    """Byte-pair merging by the definition: the best pair everywhere, again and again."""
    while True:
        best = min((ranks[p] for p in zip(ids, ids[1:]) if p in ranks), default=None)
        if best is None:
            return ids
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and ranks.get((ids[i], ids[i + 1])) == best:
                out.append(256 + best)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out


def test_heap_encoder_equals_rescanning_and_is_fast_on_long_pieces():
    import random
    import time
    rng = random.Random(2)
    for _ in range(40):
        merges, known = [], set()
        while len(merges) < 60:
            top = 256 + len(merges)
            pair = tuple(rng.choice([97, 98, 99, *range(256, top)]) for _ in range(2))
            if pair not in known:
                known.add(pair)
                merges.append(pair)
        e = C._Encoder(merges)
        for _ in range(30):
            piece = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
            assert list(e.encode_piece(piece)) == _rescanned(list(piece.encode()), e.ranks)
            assert e.decode(e.encode_piece(piece)) == piece
    long = "".join(rng.choice("abcé漢") for _ in range(500_000))     # over a million bytes
    t = time.time()
    ids = e.encode_piece(long)
    assert time.time() - t < 30 and e.decode(ids) == long


def test_incremental_training_equals_recounting(spark, monkeypatch):
    import random
    rng = random.Random(3)
    rows = [("".join(rng.choice("aab") for _ in range(rng.randint(1, 9))), rng.randint(1, 50)) for _ in range(400)]
    rows += [("aaaaaaa", 7), ("", 3), ("é漢é漢", 40)]
    counts = spark.createDataFrame(rows, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    monkeypatch.setattr(C, "BLOCK_WORDS", 16)
    want = C.train_bpe(counts, 256 + 4 + 60, checkpoint_every=7)
    assert len(want) == 60 and C.train_bpe_incremental(counts, 256 + 4 + 60, checkpoint_every=5) == want
    assert C.train_bpe_incremental(counts.limit(0), 300) == [] and C.train_bpe_incremental(counts, 100) == []


def test_saved_merges(spark, tmpdir_path):
    C.save_merges(spark, tmpdir_path + "/v", [(97, 98), (256, 99)])
    assert C.load_merges(spark, tmpdir_path + "/v") == [(97, 98), (256, 99)]


def test_character_budget_keeps_texts_out_of_the_running_total(spark, monkeypatch):
    seen, running = [], C.running
    monkeypatch.setattr(C, "running", lambda df, *a, **k: seen.append(df.columns) or running(df, *a, **k))
    rows = [(i // 2, None if i % 7 == 0 else "ab" * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        if total < 50:
            want.append((i, t, t and t[:5]))
        total += len((t or "")[:5])
    got = C.cap_corpus(df, ["doc_id"], doc_cap=5, max_chars=50, bucket_rows=4)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert C.cap_corpus(df, ["doc_id"], max_chars=0).count() == 0
    assert len(seen) == 2 and all("text" not in c and "doc" not in c for c in seen)
