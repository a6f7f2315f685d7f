"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

Three base kinds are found by pattern alone: an assignment to a telling name, an access key id, a
run of lower-case hex digits.  The method adds more.  For each character class every run of the
class that is long enough is a candidate.  A window slides over it; the counts of its characters
change by one that enters and one that leaves, and with them the sum of ``c * log2(c)``, so the
window's entropy ``log2(w) - sum / w`` is never counted anew.  Windows with enough bits are
hot, and hot windows that touch are one span.  Candidates that the allow-list knows as harmless give no
spans, and neither do spans that lie inside a base one; base spans always stay.

Only DataFrame functions, one pass, no shuffle.  Positions are code points, ends exclusive.  Sums
are kept in whole numbers of 2**-20, so they don't hang on the order of steps.  Matches of a kind
are the leftmost ones and don't overlap.  A null text counts as empty and has no spans.  Rows
with a null or repeated id are scanned each on its own.  An empty table gives no rows.  Other
columns are not read.  Places in a text are summed up in blocks, so a text with a very large
number of matches costs no square of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 20

# The base kinds by name, in the order in which spans of one start are listed.
ASSIGN = ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
          "([A-Za-z0-9+/_.=-]+)")
LEAST_VALUE = 6
BASE = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
}
HEX, LEAST_HEX = "0123456789abcdef", 24


def runs_of(alphabet: str, least: int) -> str:
    """Whole runs of at least so many of these characters."""
    inside = "".join("\\" + c if c in "\\]^-[&" else c for c in sorted(set(alphabet)))
    return f"(?<![{inside}])[{inside}]{{{least},}}"


@dataclass(frozen=True)
class CharClass:
    """Characters of a kind of candidate, the window's length, and the bits that make it hot."""

    kind: str
    alphabet: str
    window: int
    bits: float

    def pattern(self) -> str:
        return runs_of(self.alphabet, self.window)

    def costs(self) -> list[int]:
        """``c * log2(c)`` of every count that a window can hold, scaled."""
        return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, self.window + 1))]

    def most(self) -> int:
        """The largest sum with which a window is hot."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * SCALE)


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharClass("entropy_hex", DIGITS + "ABCDEFabcdef", 24, 3.0),
    CharClass("entropy_base64", UPPER + LOWER + DIGITS + "+/=_-", 24, 4.0),
)
#: Harmless candidates: plain numbers, words without digits, sample values, alphabets.
ALLOWED = (
    "^[0-9]+$",
    "^[a-z/_=+-]+$",
    "^[A-Z/_=+-]+$",
    "(?i)example|sample|placeholder|changeme",
    "(?i)abcdefgh|01234567",
)


def starts_of(sizes: Column) -> Column:
    """What stands before each entry of an array, in sum; by blocks of about its root."""
    n = F.size(sizes)
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")),
                         lambda b: F.slice(sizes, b * width + 1, width))
    added = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    sums = F.transform(blocks, added)
    before = F.flatten(F.transform(
        F.arrays_zip(blocks.alias("block"), F.sequence(F.lit(0), F.size(blocks) - 1).alias("at")),
        lambda z: F.transform(z["block"], lambda x, k: added(F.slice(sums, 1, z["at"]))
                              + added(F.slice(z["block"], 1, k)))))
    return F.when(n > 0, before).otherwise(F.array().cast("array<bigint>"))


def located(rows: DataFrame, kinds: dict[str, str], possible: dict[str, Column]) -> DataFrame:
    """``rows`` (id, text) with a column for each kind: an array of (start, end, text) matches.

    ``possible`` are cheap conditions without which a kind can't match.
    """
    flagged = rows.select("*", *[c.alias(f"may_{k}") for k, c in possible.items()])
    found = flagged.select("*", *[F.when(
        F.col(f"may_{may}"), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(
        F.array().cast("array<string>")).alias(f"found_{k}")
        for k, p in kinds.items() for may in [k if k in possible else "run"]])
    parts = found.select("*", *[
        F.when(F.size(f"found_{k}") > 0, F.split("text", p, -1)).alias(f"gaps_{k}")
        for k, p in kinds.items()])
    sized = parts.select("*", *[
        F.zip_with(F.slice(f"gaps_{k}", 1, F.size(f"found_{k}")), f"found_{k}",
                   lambda g, m: (F.length(g) + F.length(m)).cast("long")).alias(f"sizes_{k}")
        for k in kinds])
    begun = sized.select("*", *[
        F.when(F.size(f"found_{k}") > 0, starts_of(F.col(f"sizes_{k}"))).alias(f"starts_{k}")
        for k in kinds])

    def spans(k: str) -> Column:
        each = F.transform(F.arrays_zip(
            F.col(f"starts_{k}").alias("at"), F.col(f"sizes_{k}").alias("size"),
            F.col(f"found_{k}").alias("text")), lambda z: F.struct(
                (z["at"] + z["size"] - F.length(z["text"])).alias("start"),
                (z["at"] + z["size"]).alias("end"), z["text"].alias("text")))
        return F.coalesce(each, F.array().cast(SPANS)).alias(k)

    return begun.select(*rows.columns, *[spans(k) for k in kinds])


SPANS = "array<struct<start:bigint,end:bigint,text:string>>"
HOT = "array<struct<a:int,b:int>>"


def hot_windows(candidate: Column, kind: CharClass) -> Column:
    """(a, b) spans of a candidate that hot windows cover, by counts that slide along."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.call_function(
        "instr", F.lit(kind.alphabet), c) - 1)
    return F.flatten(F.transform(F.array(codes), lambda c: _slid(c, kind)))


def _slid(codes: Column, kind: CharClass) -> Column:
    w = kind.window
    costs = F.array(*[F.lit(x).cast("long") for x in kind.costs()])
    cost = lambda n: F.get(costs, n)
    none = F.struct(F.array(*[F.lit(0)] * len(kind.alphabet)).alias("counts"),
                    F.lit(0).cast("long").alias("cost"), F.array().cast(HOT).alias("spans"))

    def step(state: Column, i: Column) -> Column:
        enters, leaves = F.get(codes, i), F.get(codes, i - w)  # null before the window is full
        counts, spans = state["counts"], state["spans"]
        moved = F.transform(counts, lambda n, k: n + F.when(k == enters, 1).otherwise(0)
                            - F.when(k == leaves, 1).otherwise(0))
        more, less = F.get(counts, enters), F.get(counts, leaves)
        now = state["cost"] + F.when(leaves.eqNullSafe(enters), 0).otherwise(
            cost(more + 1) - cost(more) - F.coalesce(cost(less) - cost(less - 1), F.lit(0)))
        window = F.struct((i - w + 1).alias("a"), (i + 1).alias("b"))
        last = F.get(spans, F.size(spans) - 1)
        grown = F.when(last["b"] >= i - w + 1, F.concat(
            F.slice(spans, 1, F.size(spans) - 1),
            F.array(F.struct(last["a"].alias("a"), (i + 1).alias("b"))))).otherwise(
            F.concat(spans, F.array(window)))
        hot = (i >= w - 1) & (now <= kind.most())
        return F.struct(moved.alias("counts"), now.alias("cost"),
                        F.when(hot, grown).otherwise(spans).alias("spans"))

    slid = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), none, step,
                       lambda state: state["spans"])
    # Fewer different characters than 2**bits can't reach the bits in any window.
    return F.when(F.size(F.array_distinct(codes)) >= 2 ** kind.bits, slid).otherwise(
        F.array().cast(HOT))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(id, spans) of every row: an array of (start, rank, kind, end, text), by start, then kind.

    ``rank`` is the kind's place: the base kinds, then ``classes`` as given.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run = runs_of("".join([HEX, *(c.alphabet for c in classes)]),
                  min([LEAST_HEX, *(c.window for c in classes)]))
    met = located(rows, BASE | {c.kind: c.pattern() for c in classes}, {
        "assign": F.contains("text", F.lit(":")) | F.contains("text", F.lit("=")),
        "access": F.contains("text", F.lit("AKIA")), "run": F.col("text").rlike(run)})
    value = lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= LEAST_VALUE
    names = [*BASE, *(c.kind for c in classes)]

    def ranked(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(names.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"), s["end"].alias("end"), s["text"].alias("text")))

    based = met.select("id", F.concat(*[
        ranked(k, F.filter(k, value) if k == "assign" else F.col(k)) for k in BASE]).alias("base"),
        *[F.filter(c.kind, lambda m: ~_harmless(m["text"], allowed)).alias(c.kind)
          for c in classes])
    found = based.select("id", "base", *[_entropic(c).alias(c.kind) for c in classes])
    fresh = lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"])
                                & (b["end"] >= s["end"]))
    return found.select("id", F.array_sort(F.concat(
        "base", *[ranked(c.kind, F.filter(c.kind, fresh)) for c in classes])).alias("spans"))


def _entropic(kind: CharClass) -> Column:
    """The hot spans of all candidates of a kind."""
    return F.flatten(F.transform(kind.kind, lambda m: F.transform(
        hot_windows(m["text"], kind), lambda h: F.struct(
            (m["start"] + h["a"]).alias("start"), (m["start"] + h["b"]).alias("end"),
            F.substring(m["text"], h["a"] + 1, h["b"] - h["a"]).alias("text")))))


def _harmless(candidate: Column, allowed: tuple[str, ...]) -> Column:
    known = F.lit(False)
    for pattern in allowed:
        known = known | candidate.rlike(pattern)
    return known


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
