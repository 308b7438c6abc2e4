"""Authority citations in texts: their spans, masking, and the removal of recurring provisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import match_spans

TOKEN = "[AUTHORITY]"
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: Kinds of authority in order, with their patterns (Java syntax).
AUTHORITY = {
    "usc_section": r"(?iU)\bsections?\s+[\dA-Za-z().,\-\s]+?\s+of\s+title\s+\d+\s*,?\s*United\s+States\s+Code\b|\b\d+\s+U\.?\s*S\.?\s*C\.?\s*(?:§{1,2}\s*)?[\dA-Za-z().\-–—]+(?:\s+et\s+seq\.)?",
    "act_section": r"(?U)\bsections?\s+[\dA-Za-z().,\-\s]+?\s+of\s+(?:the\s+)?(?:[A-Z][A-Za-z0-9'’&.,\-]*\s+){1,12}Act(?:\s+of\s+\d{4})?\b",
    "named_act": r"(?U)\b(?:the\s+)?(?:[A-Z][A-Za-z0-9'’&.\-]*\s+){1,12}Act(?:\s+of\s+\d{4})?\b",
    "public_law": r"(?iU)\bPublic\s+Law\s+(?:No\.?\s*)?\d+(?:-\d+)?\b",
    "statutes_at_large": r"(?iU)\b\d+\s+Stat\.?\s+\d+(?:[-–]\d+)?\b",
    "executive_order": r"(?iU)\bExecutive\s+Orders?(?:\s+Nos?\.?)?\s+\d{4,5}(?:\s*-\s*A)?\b",
    "proclamation": r"(?iU)\bProclamation(?:\s+No\.?)?\s+\d+\b",
    "numbered_memorandum": r"(?iU)\b(?:(?:National\s+Security|Homeland\s+Security|Presidential\s+Policy|Presidential\s+Study|National\s+Security\s+Presidential)\s+Directive\s*/?\s*)?(?:NSD|PPD|PSD|NSDD|NSPD|HSPD|PDD|NSM|NSPM)-\s*\d+\b|\bPresidential\s+Determination(?:\s+No\.?)?\s+\d{4}\s*[-–—]\s*\d+\b",
    "dated_unnumbered_directive": r"(?iU)\b(?:memorandum|letter)(?:\s+(?:to|for|from)\b.{0,100}?)?\s+(?:of|dated|on)\s+" + _MONTH + r"\s+\d{1,2},\s+\d{4}\b",
    "titled_unnumbered_directive": r"(?iU)\b(?:memorandum|letter)(?:\s+(?:titled|entitled|regarding|concerning))?\s*[\"“][^\"”]{4,300}[\"”]",
    "constitution": r"(?iU)\b(?:Article\s+[IVXLC\d]+\s+of\s+)?(?:the\s+)?Constitution(?:\s+of\s+the\s+United\s+States(?:\s+of\s+America)?)?\b",
    "constitutional_power": r"(?iU)\b(?:Commander[-\s]+in[-\s]+Chief|Chief\s+Executive|(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Eleventh|Twelfth|Thirteenth|Fourteenth|Fifteenth|Sixteenth|Seventeenth|Eighteenth|Nineteenth|Twentieth|Twenty-First|Twenty-Second|Twenty-Third|Twenty-Fourth|Twenty-Fifth|Twenty-Sixth|Twenty-Seventh|\d+(?:st|nd|rd|th))\s+Amendment)\b",
    "generic_laws": r"(?iU)\b(?:the\s+)?laws?\s+of\s+the\s+United\s+States(?:\s+of\s+America)?\b",
    "joint_resolution": r"(?iU)\b(?:House|Senate)?\s*(?:Joint|Concurrent)\s+Resolution(?:\s+\d+)?\b",
}
#: Kinds of directive and what their recurring provisions say.
NOUNS = ("order", "memorandum", "proclamation", "letter", "directive")
SIGNALS = (
    "nothing in this {} shall be construed to impair or otherwise affect",
    "nothing in this {} shall be construed to impair",
    "this {} shall be implemented consistent with applicable law",
    "this {} shall be implemented in accordance with applicable law",
    "this {} is not intended to, and does not, create any right or benefit",
    "this {} is not intended to create, and does not create, any right or benefit",
)
PUBLISHED = "shall be published in the federal register"
SEVERABILITY = (
    r"(?isU)\bif\s+any\s+provision\s+of\s+this\s+(?:order|memorandum|proclamation|letter|directive)\b.{0,1200}?\b(?:held\s+invalid|invalidated|not\s+given\s+effect)\b"
    r"|\bthe\s+invalidity\s+of\s+any\s+provision\s+of\s+this\s+(?:order|memorandum|proclamation|letter|directive)\b"
)
CONTINUATION = r"(?iU)^\s*\((?:i|ii)\)\s+(?:the\s+)?(?:authority\s+granted\s+by\s+law|functions?\s+of\s+the\s+Director\s+of\s+the\s+Office\s+of\s+Management\s+and\s+Budget)"


def authority_spans(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """array<struct<start,end,kind>>: spans of all kinds, overlapping ones merged under the kind of the first.

    At one place the longest comes first, and of equally long ones the kind that is tried first.
    """
    kinds = patterns or AUTHORITY

    def named(i: int, kind: str, pattern: str) -> Column:
        return F.transform(match_spans(text, pattern), lambda m: F.struct(m["start"].alias("start"), (-(m["end"] - m["start"])).alias("less"), F.lit(i).alias("i"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.array_sort(F.flatten(F.array(*[named(i, k, p) for i, (k, p) in enumerate(kinds.items())])))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(acc, s):
        last, new = F.element_at(acc, -1), F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        inside = (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(inside, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(every, none, step)


def mask(text: Column, spans: Column, token: str = TOKEN) -> Column:
    """text with each of the ordered spans replaced by the token."""
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(text, a + 1, b - a)), token)


def without_boilerplate(text: Column) -> Column:
    """struct<kept, removed>: the paragraphs (cut at two or more spaces) without recurring provisions, joined by two spaces, and those removed.

    After a paragraph that says nothing shall impair, its sub-items go with it.
    """
    paragraphs = F.filter(F.transform(F.split(text, " {2,}"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    signals = F.array(*[F.lit(s.format(n)) for n in NOUNS for s in SIGNALS], F.lit(PUBLISHED))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("kept"), none.alias("removed"), F.lit(False).alias("on"))

    def step(acc, p):
        low = F.lower(p)
        starts = low.contains("nothing in this ") & low.contains("shall be construed to impair")
        goes_on = p.rlike(CONTINUATION)
        gone = F.exists(signals, lambda s: F.contains(low, s)) | p.rlike(SEVERABILITY) | (acc["on"] & goes_on)
        return F.struct(
            F.when(gone, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(p))).alias("kept"),
            F.when(gone, F.concat(acc["removed"], F.array(p))).otherwise(acc["removed"]).alias("removed"),
            (starts | (acc["on"] & goes_on)).alias("on"),
        )

    return F.aggregate(paragraphs, zero, step, lambda a: F.struct(F.array_join(a["kept"], "  ").alias("kept"), a["removed"].alias("removed")))
