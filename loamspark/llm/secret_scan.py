"""Secrets in texts: three fixed patterns, and strings of high entropy in sliding windows. Native column expressions throughout."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns by kind, in their order. Letters of an assignment's name stand in either case.
BASE = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
#: The least characters of an assignment's value, and of a whole match of the others.
LEAST = {"assign": 8, "access": 16, "hex": 32}


@dataclass(frozen=True)
class CharClass:
    """Candidates are the longest runs of ``chars`` of at least ``window`` characters; a window of at least ``bits`` a character that ``allowed`` does not match is hot."""

    kind: str
    chars: str
    window: int
    bits: float
    allowed: str

    @property
    def pattern(self) -> str:
        return f"{self.chars}{{{self.window},}}"

    @property
    def costs(self) -> list[int]:
        """n log2 n of 0 to ``window`` occurrences in millionths of a bit, so that sums are exact in any order."""
        return [round(1e6 * n * math.log2(n)) if n else 0 for n in range(self.window + 1)]

    @property
    def most(self) -> int:
        """The entropy is at least ``bits`` where the costs of all characters add up to this at most."""
        return math.floor(1e6 * self.window * (math.log2(self.window) - self.bits))


#: Random hexadecimal windows have 3.5 bits a character, random base64 ones 4.2; windows of digits only, and of letters only, are numbers and words.
CLASSES = (
    CharClass("entropy_hex", "[0-9A-Fa-f]", 20, 3.0, "^([0-9]*|[A-Fa-f]*)$"),
    CharClass("entropy_base64", "[A-Za-z0-9+/_=-]", 24, 3.9, "^[^0-9]*$"),
)
#: Candidates with one of these are placeholders or rows of keys, in lower case.
ALLOWED = "example|placeholder|changeme|your_api|your-api|dummykey|abcdefgh|12345678|qwertyui|xxxxxxxx"
#: Characters of a candidate whose windows begin in one piece of it.
PIECE = 256


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Each element merged with all before it, by doubling steps: n log n work, where appending to an array would copy it n times."""
    steps = F.array(*[F.lit(1 << i) for i in range(24)])

    def step(done: Column, shift: Column) -> Column:
        return F.when(F.size(done) > shift, F.transform(done, lambda x, i: F.when(i >= shift, merge(F.get(done, i - shift), x)).otherwise(x))).otherwise(done)

    return F.aggregate(steps, values, step)


def located(rows: DataFrame, name: str, pattern: str, text: str = "text") -> DataFrame:
    """``rows`` with ``name``, the matches of a pattern from left to right: ``start`` (code points) and ``match``.

    Texts are cut at the matches, so a match starts after the lengths of all pieces and matches before it; texts without a match are not cut.
    """
    found = rows.withColumn("matches", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    between = F.when(F.size("matches") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    # What lies before each match: a piece, and the match before that. Arrays are arguments of these functions, never inside of one: there they would be made anew for each element.
    before = F.concat(F.array(F.lit("")), F.col("matches"))
    starts = running(F.zip_with(between, before, lambda p, m: (F.length(p) + F.length(m)).cast("long")), lambda a, b: a + b)
    at = F.zip_with(F.slice(starts, F.lit(1), F.size("matches")), F.col("matches"), lambda s, m: F.struct(s.alias("start"), m.alias("match")))
    return found.withColumn(name, at).drop("matches")


def _occurrences(char: Column, window: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def hot_windows(piece: Column, c: CharClass) -> Column:
    """The starts in ``piece`` (0-based) of its hot windows, ascending.

    A step to the right changes two counts: that of the character that leaves and that of the one that enters. The costs of the
    changed counts, added up, give every window's cost.
    """
    costs = F.array(*[F.lit(v).cast("long") for v in c.costs])

    def cost(n: Column) -> Column:
        return F.get(costs, n)

    def change(i: Column) -> Column:
        char = lambda at: F.substring(piece, at + 1, F.lit(1))
        left = _occurrences(char(i - c.window), F.substring(piece, i - c.window + 1, F.lit(c.window)))
        stayed = F.when(i < c.window, F.substring(piece, F.lit(1), i)).otherwise(F.substring(piece, i - c.window + 2, F.lit(c.window - 1)))
        entered = _occurrences(char(i), stayed)
        return cost(entered + 1) - cost(entered) + F.when(i >= c.window, cost(left - 1) - cost(left)).otherwise(F.lit(0).cast("long"))

    sums = running(F.transform(F.sequence(F.lit(0), F.length(piece) - 1), change), lambda a, b: a + b)
    marked = F.transform(sums, lambda v, i: F.when((i >= c.window - 1) & (v <= c.most), i - (c.window - 1)))
    return F.filter(marked, lambda i: i.isNotNull() & ~F.rlike(F.substring(piece, i + 1, F.lit(c.window)), F.lit(c.allowed)))


def _entropic(rows: DataFrame, c: CharClass, order: int) -> DataFrame:
    """``rows`` with the spans of a class: of each candidate that is not allowed, from its first hot window to its last."""
    # Pieces overlap by a window less one character, so each window lies in one piece.
    pieces = lambda text: F.regexp_extract_all(text, F.lit(f"(?=(.{{{c.window},{PIECE + c.window - 1}}})).{{1,{PIECE}}}"), F.lit(1))

    def ends(match: Column) -> Column:
        """The first and the last hot window's start of each piece that has one."""
        hot = F.transform(pieces(match), lambda p, k: F.transform(hot_windows(p, c), lambda i: (i + k * PIECE).cast("long")))
        return F.flatten(hot)

    texts = F.filter(F.col(c.kind), lambda m: ~F.rlike(F.lower(m["match"]), F.lit(ALLOWED)))
    hot = F.transform(texts, lambda m: F.struct(m["start"].alias("start"), ends(m["match"]).alias("hot")))
    spans = F.transform(F.filter(hot, lambda m: F.size(m["hot"]) > 0), lambda m: _span(m["start"] + F.get(m["hot"], F.lit(0)), order, m["start"] + F.element_at(m["hot"], -1) + c.window, c.kind))
    return located(rows, c.kind, c.pattern).withColumn(c.kind, spans)


def _span(start: Column, order: int, end: Column, kind: str) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(order).alias("turn"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))


def _base(rows: DataFrame, kind: str, order: int) -> DataFrame:
    """``rows`` with the spans of a base kind: its leftmost matches that do not overlap, less those that are too short."""
    # A run of hexadecimal digits is a match by itself, so short ones need not be found; the other patterns may swallow what a later match would need.
    pattern = f"[0-9a-f]{{{LEAST[kind]},}}" if kind == "hex" else BASE[kind]
    size = (lambda m: F.length(F.regexp_extract(m["match"], BASE[kind], 2))) if kind == "assign" else (lambda m: F.length(m["match"]))
    long = F.filter(F.col(kind), lambda m: size(m) >= LEAST[kind])
    return located(rows, kind, pattern).withColumn(kind, F.transform(long, lambda m: _span(m["start"], order, m["start"] + F.length(m["match"]), kind)))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of every span with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of every row: the base kinds' spans, and those with the spans of high entropy, by start, then kind.

    A span is ``start, turn, end, kind``, in code points, the end exclusive, ``turn`` the kind's place. Base kinds are the patterns of BASE. Candidates of a class are its longest runs
    of characters; windows slide over them, and the entropy follows from two changed counts a step. Placeholders, numbers and words are on the allow-list. An added span that begins within a base span is left out.
    Whole texts are scanned, in time that is about linear in their length. Null and empty texts have no spans; every row gives one, repeated rows and null ids too; an empty table an empty one; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for order, kind in enumerate(BASE):
        rows = _base(rows, kind, order)
    for order, c in enumerate(CLASSES):
        rows = _entropic(rows, c, len(BASE) + order)
    rows = rows.withColumn("base", F.array_sort(F.concat(*BASE))).withColumn("found", F.array_sort(F.concat(F.col("base"), *(F.col(c.kind) for c in CLASSES))))
    reach = running(F.transform("found", lambda s: F.when(s["turn"] < len(BASE), s["end"]).otherwise(F.lit(0).cast("long"))), lambda a, b: F.greatest(a, b))
    reaching = F.zip_with("found", reach, lambda s, r: F.struct(s.alias("span"), r.alias("reach")))
    kept = F.filter(reaching, lambda x: (x["span"]["turn"] < len(BASE)) | (x["span"]["start"] >= x["reach"]))
    return rows.select("doc_id", "base", F.transform(kept, lambda x: x["span"]).alias("spans"))
