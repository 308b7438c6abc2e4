"""Joins of neighbouring segments of a document: folds over its ordered array, without leaving the JVM.

Segments are array<struct<type string, text string, chunks array<int>>>, chunks being the numbers of the
paragraphs that a segment comes from. An empty array stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTION, PHRASE, VESTING = "order_action", "ordering_phrase", "vesting_clause"
#: Outline markers by depth, in the order tried; the ends of a whole sentence; the interrupted connector.
DEPTHS = [(0, r"(?iU)^(?:Section|Sec\.)\s+\d+[.\s]"), (0, r"(?U)^\d+\.\s"), (3, r"(?iU)^\([ivxlcdm]+\)\s"), (1, r"(?iU)^\([a-z]\)\s"), (2, r"(?U)^\(\d+\)\s")]
CLOSED, FRAGMENT = r"[.!?;:]$", 30
CONNECTOR, CONTINUATION = r"(?iU)^I\s+(?:further\s+)?determine\s*,\s*$", r"(?iU)^(?:that|whether)\b"
_PARTS = "array<struct<text:string,vesting:boolean>>"
_RENDERED = f"array<struct<type:string,parts:{_PARTS},chunks:array<int>>>"


def _left(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def _right(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def _last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def _but_last(c: Column) -> Column:
    return F.slice(c, F.lit(1), F.greatest(F.lit(0), F.size(c) - 1))


def _segment(kind: Column, text: Column, chunks: Column) -> Column:
    return F.struct(kind.alias("type"), text.alias("text"), chunks.alias("chunks"))


def _none(like: Column) -> Column:
    """An empty array of the kind of like."""
    return F.slice(like, 1, 0)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def depth(text: Column) -> Column:
    """Outline depth of the marker that a text begins with, or null."""
    return F.coalesce(*[F.when(_left(text).rlike(p), F.lit(d)) for d, p in DEPTHS])


def merge_sublists(segments: Column) -> Column:
    """Actions and phrases under a deeper marker than the action before join it; other kinds end that action."""

    def step(acc, s):
        parent = _last(acc["out"])
        deeper = _yes(acc["open"] & s["type"].isin(ACTION, PHRASE) & (depth(s["text"]) > depth(parent["text"])))
        joined = _segment(F.lit(ACTION), F.concat(parent["text"], F.lit(" "), s["text"]), F.array_union(parent["chunks"], s["chunks"]))
        out = F.when(deeper, F.concat(_but_last(acc["out"]), F.array(joined))).otherwise(F.concat(acc["out"], F.array(s)))
        return F.struct(out.alias("out"), (deeper | (s["type"] == ACTION)).alias("open"))

    return F.aggregate(segments, F.struct(_none(segments).alias("out"), F.lit(False).alias("open")), step, lambda a: a["out"])


def merge_short(segments: Column, longest: int = FRAGMENT) -> Column:
    """A short action that ends no sentence joins the action after it."""

    def step(out, s):
        p = _last(out)
        joins = _yes((p["type"] == ACTION) & (s["type"] == ACTION) & (F.length(p["text"]) <= longest) & ~_right(p["text"]).rlike(CLOSED))
        joined = _segment(F.lit(ACTION), F.concat(_right(p["text"]), F.lit(" "), _left(s["text"])), F.array_union(p["chunks"], s["chunks"]))
        return F.when(joins, F.concat(_but_last(out), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(segments, _none(segments), step)


def relabel_connectors(segments: Column) -> Column:
    """An action that a vesting clause of its paragraph interrupts after ``I determine,`` is an ordering phrase."""

    def label(s, i):
        v, then = F.get(segments, i + 1), F.get(segments, i + 2)
        cut = (s["type"] == ACTION) & s["text"].rlike(CONNECTOR) & (v["type"] == VESTING) & (then["type"] == ACTION) & then["text"].rlike(CONTINUATION)
        cut = cut & F.arrays_overlap(s["chunks"], v["chunks"]) & F.arrays_overlap(v["chunks"], then["chunks"])
        return _segment(F.when(_yes(cut), F.lit(PHRASE)).otherwise(s["type"]), s["text"], s["chunks"])

    return F.transform(segments, label)


def coalesce_pieces(pieces: Column) -> Column:
    """Neighbouring pieces (text, vesting) that vest nothing become one; vesting pieces stand alone."""

    def step(out, p):
        q = _last(out)
        joined = F.struct(F.concat(q["text"], F.lit(" "), p["text"]).alias("text"), F.lit(False).alias("vesting"))
        return F.when(_yes(~p["vesting"] & ~q["vesting"]), F.concat(_but_last(out), F.array(joined))).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(pieces, _none(pieces), step)


def for_display(segments: Column) -> Column:
    """array<struct<type, parts, chunks>>: vesting clauses put back into the provision of their paragraph.

    A clause joins the row before it if they share a paragraph, else waits for the next one; if that shares
    none either, the waiting clauses are a paragraph of their own. Text rows that share a paragraph join too,
    but two actions never do.
    """
    parts, rendered, ints = (lambda *x: F.array(*x).cast(_PARTS)), F.array().cast(_RENDERED), F.array().cast("array<int>")

    def part(text, vesting):
        return F.struct(text.alias("text"), F.lit(vesting).alias("vesting"))

    def row(kind, p, chunks):
        return F.array(F.struct(kind.alias("type"), p.alias("parts"), chunks.alias("chunks"))).cast(_RENDERED)

    def both(a, b):
        return F.array_sort(F.array_union(a, b))

    def state(out, wait, at):
        return F.struct(out.alias("out"), wait.alias("wait"), at.alias("at"))

    def step(acc, s):
        out, wait, at = acc["out"], acc["wait"], acc["at"]
        last, spaced = _last(out), F.concat(F.lit(" "), s["text"])
        grown = F.concat(_but_last(out), row(last["type"], F.concat(last["parts"], parts(part(spaced, True))), both(last["chunks"], s["chunks"])))
        held = state(out, F.concat(wait, parts(part(s["text"], True))), F.concat(at, s["chunks"]))
        vests = F.when(_yes(F.arrays_overlap(last["chunks"], s["chunks"])), state(grown, wait, at)).otherwise(held)
        takes = _yes(F.arrays_overlap(at, s["chunks"])) & (F.size(wait) > 0)
        chunks = F.when(takes, both(s["chunks"], at)).otherwise(s["chunks"])
        base = F.when((F.size(wait) > 0) & ~takes, F.concat(out, row(F.lit("paragraph"), wait, at))).otherwise(out)
        end = _last(base)
        joins = _yes(end["type"].isin("section", "paragraph", ACTION) & s["type"].isin("paragraph", ACTION) & ~((end["type"] == ACTION) & (s["type"] == ACTION)) & F.arrays_overlap(end["chunks"], s["chunks"]))
        alone = F.when(takes, F.concat(wait, parts(part(spaced, False)))).otherwise(parts(part(s["text"], False)))
        after = F.transform(alone, lambda p, i: F.struct(F.when((i == 0) & ~p["text"].startswith(" "), F.concat(F.lit(" "), p["text"])).otherwise(p["text"]).alias("text"), p["vesting"].alias("vesting")))
        grown = F.concat(_but_last(base), row(end["type"], F.concat(end["parts"], after), both(end["chunks"], chunks)))
        plain = state(F.when(joins, grown).otherwise(F.concat(base, row(s["type"], alone, chunks))), parts(), ints)
        return F.when(s["type"] == VESTING, vests).otherwise(plain)

    return F.aggregate(segments, state(rendered, parts(), ints), step, lambda a: F.when(F.size(a["wait"]) > 0, F.concat(a["out"], row(F.lit("paragraph"), a["wait"], a["at"]))).otherwise(a["out"]))


def sections(text: Column, provisions: Column) -> Column:
    """array<struct<kind, text, idx>>: a text as context and operative parts by turns.

    provisions (array<string>) are looked for in order, each after the one before, with any white space
    between their words; one that is not found is left out. idx is a provision's place, null for context.
    """
    kind = "array<struct<kind:string,text:string,idx:int>>"

    def pattern(p):
        trimmed = F.regexp_replace(p, r"(?U)^\s+|\s+$", "")
        return F.concat(F.lit("(?U)"), F.regexp_replace(F.regexp_replace(trimmed, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), r"(?U)\s+", r"\\s+"))

    def context(c):
        stripped = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        return F.when(stripped == "", F.array().cast(kind)).otherwise(F.array(F.struct(F.lit("context").alias("kind"), stripped.alias("text"), F.lit(None).cast("int").alias("idx"))).cast(kind))

    def step(acc, x):
        hit = F.regexp_substr(acc["rest"], pattern(x["p"]))
        at = F.regexp_instr(acc["rest"], pattern(x["p"]))
        found = F.array(F.struct(F.lit("operative").alias("kind"), hit.alias("text"), x["i"].alias("idx"))).cast(kind)
        out = F.concat(acc["out"], context(F.substring(acc["rest"], F.lit(1), at - 1)), found)
        rest = F.substring(acc["rest"], at + F.length(hit), F.length(acc["rest"]))
        return F.struct(F.when(hit.isNull(), acc["out"]).otherwise(out).alias("out"), F.when(hit.isNull(), acc["rest"]).otherwise(rest).alias("rest"))

    numbered = F.transform(provisions, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.aggregate(numbered, F.struct(F.array().cast(kind).alias("out"), text.alias("rest")), step, lambda a: F.concat(a["out"], context(a["rest"])))
