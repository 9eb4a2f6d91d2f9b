"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled bad or good by a chain whose node scores use features of the
line and of its neighbours and whose edges favour runs of one label.  A document's
quality is the average of the lines' forward-backward marginals weighted by length,
brought to a probability by a logistic fit on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, ids_and_texts, text_batches
from quarry.llm.toxicity import _platt

_CHUNK = 1 << 21


@dataclass(frozen=True)
class Config:
    """``sample`` bounds the labelled rows of each class that the field is fitted on."""
    sample: int = 1500
    steps: int = 60
    rounds: int = 2
    rate: float = 0.15
    penalty: float = 1e-3


def _class_table() -> np.ndarray:
    """Character class of every byte."""
    t = np.full(256, 8, np.int8)                            # other punctuation
    t[0:33] = 4                                             # white space and control
    t[ord("A"):ord("Z") + 1] = 0
    t[ord("a"):ord("z") + 1] = 1
    t[ord("0"):ord("9") + 1] = 2
    t[128:] = 3                                             # parts of other letters
    t[[ord(c) for c in "!?"]] = 5
    t[[ord(c) for c in "|\\/<>{}[]=_^~`"]] = 6
    t[[ord(c) for c in "#$%&*@+"]] = 7
    return t


_CLASS = _class_table()
_CLASSES = 9
#: Own features: class shares, length, words, word length, shouted, decorated, stuttering, repeated.
OWN = _CLASSES + 7
FEATURES = 3 * OWN + 3


class Lines:
    """Feature matrix of the non-blank lines of a chunk of texts."""

    def __init__(self, texts: list[str]):
        body = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join(body) + b"\n"
        x = np.frombuffer(raw, np.uint8)
        doc_end = np.cumsum([len(b) + 1 for b in body])
        ends = np.flatnonzero(x == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        kind = _CLASS[x]
        white = (kind == 4).astype(np.int64)
        ink = np.concatenate([[0], np.cumsum(1 - white)])
        filled = ink[ends] > ink[starts]
        starts, ends = starts[filled], ends[filled]
        self.owner = np.searchsorted(doc_end, starts, "right")
        n = len(starts)
        length = (ends - starts).astype(np.float64)
        self.length = length
        own = np.zeros((n, OWN), np.float32)
        if n:
            for c in range(_CLASSES):
                total = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int64)])
                own[:, c] = (total[ends] - total[starts]) / length
            before = np.concatenate([[1], white[:-1]])
            words = np.concatenate([[0], np.cumsum((white == 0) & (before == 1), dtype=np.int64)])
            count = np.maximum(words[ends] - words[starts], 1)
            letters = own[:, 0] + own[:, 1] + own[:, 3] + 1e-6
            own[:, _CLASSES] = np.log1p(length) / 8
            own[:, _CLASSES + 1] = np.log1p(count) / 6
            own[:, _CLASSES + 2] = np.minimum(length / count / 10, 3)
            own[:, _CLASSES + 3] = own[:, 0] / letters > 0.5
            own[:, _CLASSES + 4] = np.minimum((own[:, 5] + own[:, 6] + own[:, 7]) * length / count, 3)
            own[:, _CLASSES + 5] = self._stutter(x, white, starts, ends) / count
            # a line that its document has had before
            h = np.fromiter((hash(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, n)
            order = np.lexsort((starts, h, self.owner))
            same = (h[order][1:] == h[order][:-1]) & (self.owner[order][1:] == self.owner[order][:-1])
            own[order[1:][same], _CLASSES + 6] = 1
        first = np.ones(n, bool)
        first[1:] = self.owner[1:] != self.owner[:-1]
        last = np.ones(n, bool)
        last[:-1] = first[1:]
        f = np.zeros((n, FEATURES), np.float32)
        f[:, :OWN] = own
        if n:
            f[1:, OWN:2 * OWN] = own[:-1]
            f[:-1, 2 * OWN:3 * OWN] = own[1:]
            f[first, OWN:2 * OWN] = 0
            f[last, 2 * OWN:3 * OWN] = 0
        f[:, -3], f[:, -2], f[:, -1] = first, last, 1
        self.features = f

    @staticmethod
    def _stutter(x: np.ndarray, white: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words of each line that look like the word before them (length and first letters)."""
        edge = np.diff(np.concatenate([[1], white, [1]]))
        begin, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        pad = np.concatenate([x, np.zeros(4, np.uint8)])
        look = np.zeros(len(begin), np.int64)
        for j in range(4):
            look = look * 256 + np.where(begin + j < stop, pad[begin + j], 0)
        alike = np.zeros(len(begin), np.int64)
        alike[1:] = (look[1:] == look[:-1]) & (np.diff(stop - begin) == 0)
        run = np.concatenate([[0], np.cumsum(alike)])
        return run[np.searchsorted(begin, ends)] - run[np.searchsorted(begin, starts)]


def chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, Lines]]:
    """Chunks of texts with a visible character: (row numbers, their lines)."""
    rows: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if not t or not t.strip():
            continue
        if rows and held + len(t) > _CHUNK:
            yield np.array(rows), Lines([texts[r] for r in rows])
            rows, held = [], 0
        rows.append(i)
        held += len(t)
    if rows:
        yield np.array(rows), Lines([texts[r] for r in rows])


def marginals(unary: np.ndarray, owner: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the expected label pairs (2x2) summed over all edges.

    ``unary`` is the score of good over bad; the recursions run over line positions for
    all documents at once (documents sorted by length, so finished ones drop out)."""
    n = len(unary)
    docs, start, count = np.unique(owner, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    phi = np.ones((n, 2))
    phi[:, 1] = np.exp(np.clip(unary, -30, 30))
    psi = np.exp(edge)
    alive = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    cur = None
    for t, a in enumerate(alive):
        at = start[:a] + t
        cur = phi[at] if t == 0 else (cur[:a] @ psi) * phi[at]
        cur /= cur.sum(1, keepdims=True)
        alpha[at] = cur
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = start[:alive[t]] + t
        right = phi[at] * beta[at]
        joint = alpha[at - 1][:, :, None] * psi[None] * right[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        left = right @ psi.T
        beta[at - 1] = left / left.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs


@dataclass
class Model:
    weights: np.ndarray
    edge: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted share of good lines (nan: no visible character)."""
        out = np.full(len(texts), np.nan)
        for rows, lines in chunks(texts):
            p, _ = marginals((lines.features * self.scale) @ self.weights, lines.owner, self.edge)
            total = np.bincount(lines.owner, weights=p * lines.length, minlength=len(rows))
            out[rows] = total / np.maximum(np.bincount(lines.owner, weights=lines.length, minlength=len(rows)), 1)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        q = self.quality(texts)
        p = 1 / (1 + np.exp(-np.clip(self.slope * q + self.offset, -700, 30)))
        return np.where(np.isnan(q), 0.0, p)


def fit(texts: list[str], labels: np.ndarray, cfg: Config = Config()) -> Model:
    """Train on labelled documents: first all lines carry their document's label; then
    lines of bad documents that the field finds good are relabelled, as long as half of
    the document's length stays bad, and the field is trained again."""
    parts = list(chunks(texts))
    labels = np.asarray(labels)
    flat = np.zeros(FEATURES)
    if not parts or len(set(labels.tolist())) < 2:
        rate = min(max(float(labels.mean()) if len(labels) else 0.5, 0.01), 0.99)
        return Model(flat, np.zeros((2, 2)), np.ones(FEATURES, np.float32), 0.0, float(np.log(rate / (1 - rate))))
    owner = np.concatenate([rows[x.owner] for rows, x in parts])
    length = np.concatenate([x.length for _, x in parts])
    f = np.concatenate([x.features for _, x in parts])
    scale = (1 / np.maximum(f.std(0), 0.05)).astype(np.float32)
    scale[-1] = 1
    f = f * scale
    y = labels[owner].astype(np.float64)
    truth = y.copy()
    inside = owner[1:] == owner[:-1]
    # a document counts once, its class as much as the other
    per_doc = np.bincount(owner, minlength=len(labels))
    share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1)) * len(labels)
    line_weight = (share / np.maximum(per_doc, 1))[owner]
    w, edge = flat.copy(), np.zeros((2, 2))
    for _ in range(cfg.rounds):
        m_w, v_w, m_e, v_e = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)), np.zeros((2, 2))
        real = np.zeros((2, 2))
        a, b = truth[:-1][inside].astype(int), truth[1:][inside].astype(int)
        np.add.at(real, (a, b), 1)
        for step in range(1, cfg.steps + 1):
            p, pairs = marginals(f @ w, owner, edge)
            g = f.T @ (line_weight * (p - truth)) / line_weight.sum() + cfg.penalty * w
            ge = (pairs - real) / max(real.sum(), 1) + cfg.penalty * edge
            m_w, v_w = 0.9 * m_w + 0.1 * g, 0.99 * v_w + 0.01 * g * g
            m_e, v_e = 0.9 * m_e + 0.1 * ge, 0.99 * v_e + 0.01 * ge * ge
            up, uv = 1 - 0.9 ** step, 1 - 0.99 ** step
            w = w - cfg.rate * (m_w / up) / (np.sqrt(v_w / uv) + 1e-8)
            edge = edge - 0.5 * cfg.rate * (m_e / up) / (np.sqrt(v_e / uv) + 1e-8)
        p, _ = marginals(f @ w, owner, edge)
        good = (p > 0.5) & (y == 0)
        stays = np.bincount(owner, weights=length * (~good), minlength=len(labels)) * 2 >= np.bincount(
            owner, weights=length, minlength=len(labels))
        truth = np.where(good & stays[owner], 1.0, y)
    q = np.bincount(owner, weights=p * length, minlength=len(labels)) / np.maximum(
        np.bincount(owner, weights=length, minlength=len(labels)), 1)
    seen = per_doc > 0
    slope, offset = _platt(q[seen], labels[seen])
    return Model(w, edge, scale, slope, offset)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1).  Null texts and texts without a
    visible character score 0; equal texts score alike; a null id is kept; extra columns
    are ignored.  Whole texts are read, lines of any number and length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            p = model.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    src = ids_and_texts(docs, id_col, text_col)
    return src.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The input rows, all columns, whose text scores at least ``least``; texts without a
    visible character go."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, text_col):
            yield b.filter(pa.array(model.scores(b.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
