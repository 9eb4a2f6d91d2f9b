"""Secret scanning: fixed patterns and sliding-window entropy.

Three kinds of base spans come from fixed patterns.  Other candidates are runs of
key-like characters that hold a digit; the Shannon entropy of every window over a run
is kept up to date by adding the entering and removing the leaving character, and is
compared with a threshold for the window's character class.  Runs are cut at ``=``, so a name
does not speak for its value; parts of a run, and stretches that reach the threshold, are
suppressed if they are on the allow-list (identifiers, plain numbers, counting sequences,
placeholders).
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ids_and_texts, plain_texts, text_batches

# fixed values: the patterns of the base spans, in the order of their kinds
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
PLACEHOLDER = re.compile(r"(?i).*(example|placeholder|changeme|your[_-]?(key|token|secret)|x{6,}).*")
#: Strings that look random but are not secrets.
ALLOW = (PLACEHOLDER, *(re.compile(p) for p in (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",   # UUID
    r"[0-9+/_=-]+",                                                                   # numbers, dates, rules
    r"(?i)(/?[a-z_-]+[0-9]{0,4})(/[a-z_-]*[0-9]{0,4})+/?",                            # paths of plain names
)))


@dataclass(frozen=True)
class Entropy:
    """Window length and entropy thresholds (bits) per character class of a window."""
    window: int = 20
    classes: dict = field(default_factory=lambda: {"hex": 2.9, "single": 3.6, "mixed": 3.75})
    allow: tuple = ALLOW


_KEYLIKE = np.zeros(256, bool)
_KEYLIKE[[ord(c) for c in "+/_=-0123456789"]] = True
_KEYLIKE[ord("A"):ord("Z") + 1] = True
_KEYLIKE[ord("a"):ord("z") + 1] = True
_LOWHEX = np.zeros(256, bool)
_LOWHEX[[ord(c) for c in "0123456789abcdef"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True


def char_class(upper: int, lower: int, digit: int, beyond_hex: int) -> str | None:
    """Class of a window from counts of its characters; None: no digit, or no letter."""
    if not digit or not upper + lower:
        return None
    if not beyond_hex:
        return "hex"
    return "mixed" if upper and lower else "single"


def entropy_spans(run: str, cfg: Entropy = Entropy()) -> list[tuple[int, int]]:
    """Stretches of ``run`` whose windows reach the threshold of their class."""
    out, at = [], 0
    for part in run.split("="):
        out += [(at + s, at + e) for s, e in _stretches(part, cfg) if not _allowed(part[s:e], cfg)]
        at += len(part) + 1
    return out


def _allowed(text: str, cfg: Entropy) -> bool:
    return any(p.fullmatch(text) for p in cfg.allow)


def _stretches(run: str, cfg: Entropy) -> list[tuple[int, int]]:
    """One pass: the counts of the window's characters and the sum of c*log2(c) change by
    the entering and the leaving character only."""
    width = cfg.window
    if len(run) < width or any(p.fullmatch(run) for p in cfg.allow if p is not PLACEHOLDER):
        return []
    counts: dict[str, int] = {}
    weight = 0.0
    kinds = [0, 0, 0, 0]        # upper, lower, digit, beyond hex
    steps = 0                   # neighbours that count up by one
    out: list[list[int]] = []

    def change(c: str, by: int) -> None:
        nonlocal weight
        old = counts.get(c, 0)
        new = old + by
        weight += (new * math.log2(new) if new else 0.0) - (old * math.log2(old) if old else 0.0)
        counts[c] = new
        kinds[0] += by * ("A" <= c <= "Z")
        kinds[1] += by * ("a" <= c <= "z")
        kinds[2] += by * ("0" <= c <= "9")
        kinds[3] += by * (c not in "0123456789abcdefABCDEF")

    for i, c in enumerate(run):
        change(c, 1)
        steps += i > 0 and ord(c) - ord(run[i - 1]) == 1
        if i >= width:
            change(run[i - width], -1)
            steps -= ord(run[i - width + 1]) - ord(run[i - width]) == 1
        if i >= width - 1:
            name = char_class(*kinds)
            if (name and math.log2(width) - weight / width >= cfg.classes[name] and steps < width // 2):
                if out and i - width + 1 <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([i - width + 1, i + 1])
    return [tuple(x) for x in out]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    low = text.lower()
    out = []
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    out += [("hex", *m.span()) for m in re.finditer(rf"[0-9a-f]{{{HEX_LENGTH},}}", text)]
    return out


def secret_spans(text: str | None, cfg: Entropy = Entropy()) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind; entropy spans
    that lie within a base span are left out."""
    if not text:
        return []
    base = base_spans(text)
    begins = sorted((a, b) for _, a, b in base)
    reach = list(itertools.accumulate((b for _, b in begins), max))     # furthest end so far
    extra = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{cfg.window},}}", text):
        for s, e in entropy_spans(m[0], cfg):
            s, e = m.start() + s, m.start() + e
            upto = bisect.bisect_right(begins, (s, math.inf))
            if not upto or reach[upto - 1] < e:
                extra.append(("entropy", s, e))
    return sorted(base + extra, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _long_runs(data: np.ndarray, start: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``table``'s bytes of ``least`` length within a text."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = start[(start > 0) & (start < len(data))]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = e - s >= least
    return s[long], e[long]


def _suspects(texts: pa.Array, window: int) -> np.ndarray:
    """Which texts hold a run of ``window`` key-like characters with a digit or a run of
    lower-case hex; decided on the batch's bytes at once."""
    n = len(texts)
    start = np.frombuffer(texts.buffers()[1], np.int64, n + 1)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    hit = np.zeros(n, bool)
    if not len(data):
        return hit
    s, e = _long_runs(data, start, _KEYLIKE, window)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    for at in (s[digits[e] > digits[s]], _long_runs(data, start, _LOWHEX, HEX_LENGTH)[0]):
        hit[np.searchsorted(start, at, "right") - 1] = True
    return hit


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: Entropy = Entropy()) -> DataFrame:
    """One row per input row: id, ``spans`` (array of kind, start, end; code points, end
    exclusive).  Null and empty texts have none; repeated rows give equal rows; a null
    id is kept as it is; extra columns are ignored.  Whole texts of any length are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in text_batches(batches):
            texts = plain_texts(b.column(1))
            hit = _suspects(texts, cfg.window)
            found = []
            for text, long in zip(texts.to_pylist(), hit.tolist()):
                if not text:
                    found.append([])
                    continue
                if not long:    # no long run: only an assignment or a short access key can match
                    low = text.lower()
                    long = "AKIA" in text or any(k in low for k in ("passw", "secret", "token", "apikey", "api_key"))
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(text, cfg)] if long else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    src = ids_and_texts(docs, id_col, text_col)
    return src.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed(
        "id", id_col)


def span_text(spans, kinds=None):
    """Column: ``kind:start:end`` of the spans (of ``kinds`` only), comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def brute_digest(text: str | None) -> str:
    """Checksum of the base spans of one text (for tests)."""
    return hashlib.sha256(digest(base_spans(text or "")).encode()).hexdigest()
