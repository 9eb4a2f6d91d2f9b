"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A window of a few words is the bag of the character n-grams of its words (word borders
included); its embedding is the average of the n-grams' hashed vectors, and a linear
softmax over it gives the window's probability.  Vectors and softmax are trained jointly
in numpy.  A document is as toxic as its most toxic window, so a few insults in a long
text are not averaged away; a misspelling shares most n-grams with known spellings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ids_and_texts, text_batches

#: Characters that are encoded at a time (a longer document is taken whole).
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Config:
    """``sample`` bounds the labelled rows of each class that the classifier is fitted on."""
    sample: int = 1500
    grams: tuple = (3, 4, 5)
    bits: int = 18
    dim: int = 12
    words: int = 5
    rounds: int = 3
    epochs: int = 6
    seed: int = 11


@dataclass
class Model:
    value: np.ndarray       # per hashed n-gram: its vector times the softmax weights
    bias: float
    slope: float            # of the document's probability over its top window's logit
    offset: float
    cfg: Config

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Logit of every text's most toxic window (no word: -inf)."""
        out = np.full(len(texts), -np.inf)
        for rows, bag in bags(texts, self.cfg):
            z = bag.sums(self.value) / bag.size + self.bias
            np.maximum.at(out, rows[bag.owner], z)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; a text without words scores 0."""
        z = self.logits(texts)
        seen = np.isfinite(z)
        p = 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.where(seen, z, 0.0) + self.offset, -700, 30)))
        return np.where(seen, p, 0.0)


class Bag:
    """Windows of a chunk of texts: hashed n-grams sorted by window."""

    def __init__(self, code: np.ndarray, window: np.ndarray, owner: np.ndarray):
        self.code, self.window, self.owner = code, window, owner
        self.size = np.maximum(np.bincount(window, minlength=len(owner)), 1).astype(np.float64)

    def sums(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.window, weights=value[self.code], minlength=len(self.owner))


def bags(texts: list[str | None], cfg: Config) -> Iterator[tuple[np.ndarray, Bag]]:
    """Chunks of texts as bags: (row numbers, bag whose ``owner`` indexes them)."""
    rows: list[int] = []
    body: list[str] = []
    held = 0
    for i, t in enumerate(texts):
        if not t or not (t := " ".join(t.lower().split())):
            continue
        if body and held + len(t) > _CHUNK:
            yield np.array(rows), _bag(body, cfg)
            rows, body, held = [], [], 0
        rows.append(i)
        body.append(t)
        held += len(t) + 1
    if body:
        yield np.array(rows), _bag(body, cfg)


def _bag(body: list[str], cfg: Config) -> Bag:
    x = np.frombuffer((" " + " ".join(body) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = x == 32
    words = np.cumsum(space, dtype=np.int32)            # 1-based word that a character belongs to
    ends = np.cumsum([len(t) + 1 for t in body])        # the space after each text
    last = words[ends] - 1                              # last word of each text
    n = np.diff(np.concatenate([[0], last]))
    local = np.arange(last[-1]) - np.repeat(last - n, n)
    per_text = -(-n // cfg.words)
    owner = np.repeat(np.arange(len(body)), per_text)
    window_of = (np.repeat(np.cumsum(per_text) - per_text, n) + local // cfg.words).astype(np.int32)
    with np.errstate(over="ignore"):
        h = x * np.uint32(0x9E3779B1)
        codes, wins = [], []
        for k in range(2, max(cfg.grams) + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[k - 1:] * np.uint32(0x9E3779B1)
            if k not in cfg.grams or not len(h):
                continue
            # a border may be the first or the last character only
            ok = words[k - 2:][:len(h)] == words[:len(h)]
            g = h[ok]
            g = (g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            codes.append((g >> np.uint32(32 - cfg.bits)).astype(np.int32))
            wins.append(window_of[words[:len(h)][ok] - 1])
    return Bag(np.concatenate(codes), np.concatenate(wins), owner)


def _top(z: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Positions of the ``count`` largest values of each owner."""
    order = np.lexsort((-z, owner))
    o = owner[order]
    rank = np.arange(len(o)) - np.searchsorted(o, o, "left")
    return order[rank < count]


def fit(texts: list[str], labels: np.ndarray, cfg: Config = Config()) -> Model:
    """Train on documents: which windows of a toxic document are toxic is found by
    training on its currently most toxic ones and choosing again."""
    rng = np.random.default_rng(cfg.seed)
    size = 1 << cfg.bits
    order = rng.permutation(len(texts))
    texts, labels = [texts[i] for i in order], np.asarray(labels)[order]
    # n-grams of all windows, those of window i at begin[i]:begin[i + 1]; which documents
    # hold an n-gram is counted chunk by chunk
    codes, owners, lengths = [], [], []
    has, toxic = np.zeros(size), np.zeros(size)
    for rows, bag in bags(texts, cfg):
        codes.append(bag.code[np.argsort(bag.window, kind="stable")])
        owners.append(rows[bag.owner])
        lengths.append(np.bincount(bag.window, minlength=len(bag.owner)))
        pair = np.unique(bag.owner[bag.window] << cfg.bits | bag.code)
        has += np.bincount(pair & (size - 1), minlength=size)
        toxic += np.bincount(pair & (size - 1), weights=labels[rows[pair >> cfg.bits]], minlength=size)
    if not codes or len(set(labels.tolist())) < 2:
        rate = float(np.mean(labels)) if len(labels) else 0.5
        rate = min(max(rate, 0.01), 0.99)
        return Model(np.zeros(size), 0.0, 0.0, float(np.log(rate / (1 - rate))), cfg)
    code, owner, length = np.concatenate(codes), np.concatenate(owners), np.concatenate(lengths)
    del codes
    begin = np.concatenate([[0], np.cumsum(length)])
    y = labels[owner]

    def average(value: np.ndarray) -> np.ndarray:
        """Mean value of the n-grams of every window (each holds one at least)."""
        out = np.empty(len(length))
        for s in range(0, len(length), 1 << 16):
            e = min(s + (1 << 16), len(length))
            out[s:e] = np.add.reduceat(value[code[begin[s]:begin[e]]], begin[s:e] - begin[s]) / length[s:e]
        return out

    # first choice: log-odds of the documents that hold an n-gram
    value = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((has - toxic + 0.5) / ((1 - labels).sum() + 1))
    z = average(value)
    e = rng.normal(0, 0.1, (size, cfg.dim)).astype(np.float32)
    w = rng.normal(0, 0.3, cfg.dim).astype(np.float32)
    bias = 0.0
    g_e, g_w, g_b = np.full(size, 1e-6, np.float32), np.full(cfg.dim, 1e-6), 1e-6
    for _ in range(cfg.rounds):
        mine = _top(z, owner, 2)
        other = rng.choice(np.flatnonzero(y == 0), min(int((y == 0).sum()), 4 * len(texts)), replace=False)
        chosen = np.unique(np.concatenate([mine, other]))
        for _ in range(cfg.epochs):
            for batch in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 256)):
                n = length[batch]
                at = np.repeat(begin[batch], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                grams = code[at]
                head = np.cumsum(n) - n
                mean = np.add.reduceat(e[grams], head, axis=0) / n[:, None]
                p = 1 / (1 + np.exp(-np.clip(mean @ w + bias, -30, 30)))
                d = ((p - y[batch]) * np.where(y[batch] == 1, 2.0, 1.0) / len(batch)).astype(np.float32)
                gw, gb = mean.T @ d, float(d.sum())
                ge = np.repeat(d / n, n).astype(np.float32)
                touched, where = np.unique(grams, return_inverse=True)
                gv = np.bincount(where, weights=ge)[:, None].astype(np.float32) * w[None, :]
                g_e[touched] += np.mean(gv * gv, axis=1)
                e[touched] -= 0.3 * gv / np.sqrt(g_e[touched])[:, None]
                g_w += gw * gw
                g_b += gb * gb
                w -= (0.1 * gw / np.sqrt(g_w)).astype(np.float32)
                bias -= 0.1 * gb / np.sqrt(g_b)
        value = (e @ w).astype(np.float64)
        z = average(value) + bias
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, owner, z)
    slope, offset = _platt(top[np.isfinite(top)], labels[np.isfinite(top)])
    return Model(value, float(bias), slope, offset, cfg)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels over logits by Newton steps, classes weighted alike."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([np.sum(weight * (p - y) * z), np.sum(weight * (p - y))]) + 0.1 * np.array([a, b])
        s = weight * p * (1 - p)
        m = np.array([[np.sum(s * z * z), np.sum(s * z)], [np.sum(s * z), np.sum(s)]]) + 0.1 * np.eye(2)
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``per_class`` labelled rows of each class, chosen
    by a hash of the id; ``usable`` is a Column over ``id``.  Only the ids of the sample
    go through the sort; ids with conflicting labels count as 1."""
    known = (labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
             .filter("id IS NOT NULL AND y IN (0, 1)").filter(usable).groupBy("id").agg(F.max("y").alias("y")))
    ids = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        ids = part if ids is None else ids.unionAll(part)
    rows = (docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
            .join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy("id").collect())   # 2 * per_class rows at most
    return [r["text"] or "" for r in rows], np.array([r["y"] for r in rows], np.int64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1).  Null texts and texts without words
    score 0; equal texts score alike; a null id is kept; extra columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            p = model.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    src = ids_and_texts(docs, id_col, text_col)
    return src.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
