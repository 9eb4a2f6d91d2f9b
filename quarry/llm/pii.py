"""Personal data: fixed patterns and bootstrapped contextual extraction, all in SQL functions.

Base spans come from four fixed patterns.  They are also the seeds of the bootstrap:
the words left and right of a whole span, or of an identifier-like word outside the spans,
are its lexical pattern, patterns and instances (values) form a bipartite graph, and a few rounds of scoring pass
confidence from seed instances to the patterns they occur in and on to further
instances.  Tokens that a confident pattern surrounds become spans of their own.

Only DataFrame functions are used; positions come from splitting a text at its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

# fixed values: the base patterns in the order of their kinds.  They are written with
# possessive parts and a left border (or the end of the match before), which finds the
# same leftmost matches without trying every start within a run of characters.
KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_OK = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
#: A word that could be an identifier: it holds two digits.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


@dataclass(frozen=True)
class Config:
    """Bootstrap: rounds, least distinct instances of a pattern, and the confidence that a
    pattern needs to discover further instances."""
    rounds: int = 3
    support: int = 5
    confidence: float = 0.8


#: Elements that are added up in one go: running sums are built in blocks, and blocks of
#: blocks, so that their cost follows the length of a text.
_BLOCK = 128
#: Characters on either side of a match that are read for its context.
_REACH = 64
#: Characters of a text that are cut out together when it is rewritten.
_PIECE = 4096
_WHITE = r"\x20\x09-\x0D"


def found_and_gaps(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches of a text, and the stretches before, between and after them (splitting at
    the same pattern leaves exactly those)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _running(values: Column, first: Column, count: Column, base: Column) -> Column:
    """Sums before each of ``count`` elements from index ``first`` on, beginning at ``base``.
    Elements are read by index: cutting a slice would copy the whole array each time."""
    zero = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
    at = F.sequence(first, first + count - 1)
    return F.aggregate(at, zero, lambda acc, i: F.struct(
        (acc["at"] + F.get(values, i)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"])


def _block_sums(values: Column) -> Column:
    n = F.size(values)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda c: F.aggregate(
        F.sequence(c * _BLOCK, F.least(n, (c + 1) * _BLOCK) - 1), F.lit(0).cast("long"),
        lambda a, i: a + F.get(values, i)))


def _from_blocks(values: Column, block_starts: Column) -> Column:
    n = F.size(values)
    return F.flatten(F.transform(block_starts, lambda base, c: _running(
        values, c * _BLOCK, F.least(n - c * _BLOCK, F.lit(_BLOCK)), base)))


def locate(src: DataFrame, keep: list[Column], kinds: list[str]) -> DataFrame:
    """Adds ``__p_<kind>``, the position of every stretch (code points): the lengths of all
    stretches and matches before it.  Every step is a projection of its own, so that each
    array is computed once a row."""
    cols = [*keep, *[F.col(f"__{c}_{k}") for k in kinds for c in "fg"]]
    zero = F.lit(0).cast("long")

    def step(df: DataFrame, old: str, new: dict) -> DataFrame:
        return df.select(*cols, *[F.col(f"__{c}_{k}") for k in kinds for c in old],
                         *[f(k).alias(f"__{c}_{k}") for k in kinds for c, f in new.items()])

    def col(c: str, k: str) -> Column:
        return F.col(f"__{c}_{k}")

    src = step(src, "", {"n": lambda k: F.zip_with(col("f", k), col("g", k), lambda f, g: (
        F.coalesce(F.char_length(f), F.lit(0)) + F.char_length(g)).cast("long"))})
    src = step(src, "n", {"b": lambda k: F.when(F.size(col("n", k)) > 0, _block_sums(col("n", k)))
               .otherwise(F.array().cast("array<bigint>"))})
    src = step(src, "nb", {"c": lambda k: F.when(F.size(col("b", k)) > 0, _block_sums(col("b", k)))
               .otherwise(F.array().cast("array<bigint>"))})
    src = step(src, "nb", {"d": lambda k: F.when(F.size(col("c", k)) > 0, _running(
        col("c", k), F.lit(0), F.size(col("c", k)), zero)).otherwise(F.array().cast("array<bigint>"))})
    src = step(src, "n", {"e": lambda k: _from_blocks(col("b", k), col("d", k))})
    return step(src, "", {"p": lambda k: _from_blocks(col("n", k), col("e", k))})


def matches(kind: str) -> Column:
    """Array of (kind, start, end, value, left, right) from the columns of ``locate``, end
    exclusive.  ``left`` holds up to two words that end before the match, the nearest first,
    ``right`` the word after it (empty: none), lower-cased, as far as they lie within
    ``_REACH`` characters, two matches of the same search and the stretches between them."""
    found, gaps, at = (F.col(f"__{c}_{kind}") for c in "fgp")

    def near(*parts: Column) -> Column:
        return F.concat(*[F.coalesce(x, F.lit("")) for x in parts])

    def before_of(i: Column, array: Column, back: int) -> Column:
        return F.when(i >= back, F.get(array, i - back))

    def one(value: Column, i: Column) -> Column:
        start = F.get(at, i) + F.char_length(F.get(gaps, i))
        before = F.substring(near(before_of(i, found, 2), before_of(i, gaps, 1), before_of(i, found, 1),
                                  F.get(gaps, i)), -_REACH, _REACH)
        after = F.substring(near(F.get(gaps, i + 1), F.get(found, i + 1), F.get(gaps, i + 2), F.get(found, i + 2)),
                            1, _REACH)
        words = F.filter(F.split(F.lower(before), f"[{_WHITE}]+", -1), lambda w: w != "")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"),
                        (start + F.char_length(value)).alias("end"), value.alias("value"),
                        F.slice(F.reverse(words), 1, 2).alias("left"),
                        F.regexp_extract(F.lower(after), f"^[{_WHITE}]*([^{_WHITE}]+)", 1).alias("right"))

    return F.transform(found, one)


def luhn(digits: Column) -> Column:
    """Checksum test of a digit string: every second digit from the right counts twice,
    with the digits of the double summed."""
    n = F.char_length(digits)
    at = F.sequence(F.lit(1), n)
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when(
        (n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                     F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card_ok(value: Column) -> Column:
    n = F.char_length(_digits(value))
    return F.when(n.between(12, 19), luhn(_digits(value))).otherwise(F.lit(False))


def _searches(text: Column) -> dict[str, tuple[Column, str]]:
    """Per kind the test that a text has to pass to be searched, and the pattern."""
    digit = text.rlike("[0-9]")
    return {"email": (F.contains(text, F.lit("@")), EMAIL),
            "ip": (text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), IP),
            "card": (text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), CARD),
            "phone": (F.contains(text, F.lit("+")), PHONE),
            "token": (digit, TOKEN)}


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(IP_OK),
    "card": _card_ok,
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}


def scan_rows(src: DataFrame) -> DataFrame:
    """The columns but ``text``, ``base`` (matches of the fixed patterns; failing ones are
    dropped) and ``tokens`` (candidate words), both as ``matches`` gives them."""
    others = [F.col(f"`{c}`") for c in src.columns if c != "text"]
    src = src.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none, made = F.array().cast("array<string>"), []
    for kind, (gate, pattern) in _searches(F.col("text")).items():
        found, gaps = found_and_gaps(F.col("text"), pattern)
        made += [F.when(gate, found).otherwise(none).alias(f"__f_{kind}"),
                 F.when(gate, gaps).otherwise(none).alias(f"__g_{kind}")]
    kinds = [*KINDS[:4], "token"]
    src = locate(src.select(*others, *made), others, kinds)
    base = [F.filter(matches(k), lambda m: _VALID[k](m["value"])) for k in KINDS[:4]]
    return src.select(*others, F.concat(*base).alias("base"), matches("token").alias("tokens"))


def free_spans(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, start, end, value, left, right): the base spans and the candidates that no
    base span overlaps.

    A candidate meets a base span that begins before it if the largest end so far lies
    beyond its start, and one that begins in it if the next base start lies before its end:
    two running aggregates over the spans of one text."""
    s = rows.select(key, F.explode(F.concat("base", "tokens")).alias("s")).select(key, "s.*")
    s = s.withColumn("cand", F.col("kind") == "token")
    up = Window.partitionBy(key).orderBy("start", "cand").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("start"), "cand").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("open", F.max(F.when(~F.col("cand"), F.col("end"))).over(up))
    s = s.withColumn("next", F.min(F.when(~F.col("cand"), F.col("start"))).over(down))
    met = (F.coalesce(F.col("open") > F.col("start"), F.lit(False))
           | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    return s.filter(~F.col("cand") | ~met).drop("cand", "open", "next")


def _patterns() -> Column:
    """Lexical patterns of a span: the two words before it, and the words on either side of
    it (null where a word is missing)."""
    left, right = F.col("left"), F.col("right")
    return F.array(F.when(F.size(left) == 2, F.concat_ws("\u0001", F.lit("before"), left)),
                   F.when((F.size(left) > 0) & (right != ""), F.concat_ws("\u0001", F.lit("around"), left[0], right)))


def bootstrap(spans: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Confident patterns of ``free_spans``: (pattern, confidence, instances).

    Edges join a pattern (two words before, or the words on both sides) with an instance
    (the value of a base span or a candidate).  Base spans, whole and whatever they consist
    of, are seeds with confidence 1.
    In every round a pattern's confidence is the mean of its instances', counted over at
    least ``support`` distinct ones, and another instance's is the best of its confident
    patterns'; both are grouped aggregates over equality joins."""
    t = spans.select("value", (F.col("kind") != "token").alias("seed"), F.explode(_patterns()).alias("pattern"))
    edges = materialize(t.filter("pattern IS NOT NULL").groupBy("pattern", "value").agg(F.max("seed").alias("seed")),
                        "pii-edges")
    # a pattern of few instances can never be confident: only the others take part
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")).filter(F.col("instances") >= cfg.support)
    edges = materialize(edges.join(size, "pattern"), "pii-graph")
    scored = edges.withColumn("c", F.col("seed").cast("double"))
    found = None
    for _ in range(cfg.rounds):
        found = materialize(scored.groupBy("pattern").agg(F.avg("c").alias("confidence"),
                                                          F.max("instances").alias("instances"))
                            .filter(F.col("confidence") >= cfg.confidence), "pii-patterns")
        value = edges.join(found.select("pattern", "confidence"), "pattern").groupBy("value").agg(
            F.max("confidence").alias("best"))
        scored = edges.join(value, "value", "left").select(
            "pattern", "value", "seed", "instances",
            F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("c"))
    return found


_SPANS = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"


def with_context(rows: DataFrame, key: str, cfg: Config) -> DataFrame:
    """(key, spans): base spans and the candidates that confident patterns surround, in order."""
    free = materialize(free_spans(rows, key), "pii-spans")
    good = bootstrap(free, cfg)
    t = free.filter("kind = 'token'").select(key, "start", "end", "value", F.explode(_patterns()).alias("pattern"))
    extra = (t.join(good.select("pattern"), "pattern").groupBy(key).agg(F.collect_set(F.struct(
        F.lit("context").alias("kind"), F.col("start"), F.col("end"), F.col("value"))).alias("extra")))
    base = F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value")]))
    every = F.concat(base, F.coalesce("extra", F.array().cast(_SPANS)))
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(every, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"),
        s["kind"].alias("kind"), s["value"].alias("value")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return rows.join(extra, key, "left").withColumn("spans", spans).drop("base", "tokens", "extra")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: Config = Config()) -> DataFrame:
    """One row per input row: id, ``spans`` (array of kind, start, end, value by start, then
    kind; code points, end exclusive).

    Base spans are always there; ``context`` spans are tokens outside them that a
    confident pattern surrounds.  Null and empty texts have none; rows that repeat an
    id and a text get equal rows; a null id is kept as it is; extra columns are ignored."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(scan_rows(src).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    return with_context(rows, "row", cfg).select(F.col("id").alias(id_col), "spans")


def redact(docs: DataFrame, text_col: str = "text", cfg: Config = Config()) -> DataFrame:
    """The input rows with every span of their text replaced by ``<KIND>``; all columns and
    their order are kept.  Spans that overlap in a chain are replaced as one, named after the
    first.  A text is rebuilt from pieces of bounded size, so the work follows its length."""
    cols, text = docs.columns, F.col(f"`{text_col}`")
    # spans depend on the text alone, so they are kept per text (its digest) and only for
    # texts that have any
    mark = F.sha2(text.cast("string"), 256)
    rows = scan_rows(docs.select(mark.alias("__mark"), text.alias("text")))
    # written before the filter: pushed below the projections it would repeat their work
    rows = materialize(rows, "pii-scan").filter((F.size("base") > 0) | (F.size("tokens") > 0))
    rows = materialize(rows.dropDuplicates(["__mark"]), "pii-rows")
    spans = with_context(rows, "__mark", cfg).select("__mark", F.posexplode("spans").alias("pos", "s"))
    before = Window.partitionBy("__mark").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("head", F.coalesce(F.col("s.start") >= F.max("s.end").over(before), F.lit(True)))
    spans = spans.withColumn("run", F.sum(F.col("head").cast("int")).over(Window.partitionBy("__mark").orderBy("pos")
                             .rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("__mark", "run").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"),
                                              F.min_by("s.kind", "pos").alias("kind"))
    runs = runs.groupBy("__mark").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__runs"))
    out = docs.withColumn("__mark", mark).join(runs, "__mark", "left").withColumn("__pieces", F.when(
        F.col("__runs").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    pieces, at = F.col("__pieces"), F.col("__runs")

    def cut(start: Column, end: Column) -> Column:
        first = F.floor(start / _PIECE).cast("int")
        held = F.array_join(F.transform(F.sequence(first, F.floor((end - 1) / _PIECE).cast("int")),
                                        lambda i: F.get(pieces, i)), "")
        return F.when(end > start, F.substring(held, (start - first * _PIECE + 1).cast("int"),
                                               (end - start).cast("int"))).otherwise("")

    def ended(i: Column) -> Column:
        return F.when(i > 0, F.get(at, i - 1)["end"]).otherwise(F.lit(0).cast("long"))

    kept = F.transform(at, lambda r, i: F.concat(cut(ended(i), r["start"]), F.lit("<"), F.upper(r["kind"]), F.lit(">")))
    done = F.concat(F.array_join(kept, ""), cut(ended(F.size(at)), F.char_length(text).cast("long")))
    out = out.withColumn("__clean", F.when(at.isNull(), text).otherwise(done))
    return out.select(*[F.col("__clean").alias(c) if c == text_col else docs[c] for c in cols])
