"""Scalar text functions as Column expressions; all stay in whole-stage code or JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern (ASCII, apostrophe-joined) and the date format.
TOKEN = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*"
DATE_FORMAT = "MMMM d, yyyy"
#: The space separators (Unicode Zs), which SQL's trim takes away; no tabs or line ends.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Space separators off both ends. Takes one argument, so that a lambda's index is not taken for the characters to trim."""
    return F.trim(c, F.lit(SPACES))


def parse_date(c: Column) -> Column:
    """A DATE from 'Month d, yyyy'; NULL if it is none."""
    return F.to_date(F.try_to_timestamp(c, F.lit(DATE_FORMAT)))


def normalize_identifier(c: Column) -> Column:
    """Dashes of any kind to '-', white space out, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, "[‐-―−]", "-"), r"\s+", ""))


def normalize_title(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def title_from_url(c: Column, prefix: str = r"^(?:executive-order|proclamation|memorandum)-\d+-") -> Column:
    """The last path segment, percent-decoded, without a type prefix, dashes as spaces."""
    slug = F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)
    slug = F.url_decode(F.replace(slug, F.lit("+"), F.lit("%2B")))
    return F.replace(F.regexp_replace(slug, prefix, ""), F.lit("-"), F.lit(" "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def word_shingles(words: Column, size: int = 10) -> Column:
    """The set of runs of size words, each joined by spaces; empty for fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def display_text(c: Column, delimiter: str = r" {2,}") -> Column:
    """Paragraphs stripped, empty ones dropped, joined by a blank line."""
    parts = F.transform(F.split(c, delimiter), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def excerpt(c: Column, start: Column, end: Column, reach: int = 140) -> Column:
    """Text around [start, end) (0-based) with ellipses where it was cut, white space collapsed."""
    a, b = F.greatest(F.lit(0), start - reach), F.least(F.length(c), end + reach)
    inside = F.trim(F.regexp_replace(F.substring(c, a + 1, b - a), r"\s+", " "))
    return F.concat(F.when(a > 0, "...").otherwise(""), inside, F.when(b < F.length(c), "...").otherwise(""))


def text_windows(c: Column, size: int = 10_000, overlap: int = 500) -> Column:
    """Overlapping windows; the last reaches the end, texts up to size are one window."""
    count = F.greatest(F.lit(1), F.ceil((F.length(c) - overlap) / (size - overlap)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * (size - overlap) + 1, F.lit(size)))


def score_band(c: Column) -> Column:
    return F.when(c.isNull(), "missing").when(c >= 0.9, "very_high").when(c >= 0.8, "high").when(c >= 0.7, "moderate").otherwise("low")


def match_spans(c: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> (0-based, end exclusive) of every match, left to right.

    The places are running lengths of what lies between the matches and of the matches themselves, so
    context outside a match counts as in the search. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    between = F.split(c, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        item = F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"))
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def title_words(c: Column) -> Column:
    """The slug of a URL as a title: a trailing number of four or more digits dropped, each word capitalised."""
    slug = F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)
    return F.initcap(F.replace(F.regexp_replace(slug, r"-\d{4,}$", ""), F.lit("-"), F.lit(" ")))


#: Numbered memoranda and determinations; the identifier is the whole of group 1 or 2.
MEMORANDUM = (
    r"(?iU)\b(?:(?:National\s+Security|Homeland\s+Security|Presidential\s+Policy|Presidential\s+Study|National\s+Security\s+Presidential)\s+Directive\s*/?\s*)?"
    r"((?:NSD|PPD|PSD|NSDD|NSPD|HSPD|PDD|NSM|NSPM)-\s*\d+)\b|\bPresidential\s+Determination(?:\s+No\.?)?\s+(\d{4}\s*[-–—]\s*\d+)\b"
)


def row_identifier(doc_type: Column, url: Column, text: Column, head: int = 500) -> Column:
    """The identifier of a document: numbers of orders and proclamations from the URL, of memoranda from the text's beginning."""
    begin = F.left(text, F.lit(head))
    numbered = F.concat(F.regexp_extract(begin, MEMORANDUM, 1), F.regexp_extract(begin, MEMORANDUM, 2))
    return (
        F.when(doc_type == "executive_order", F.regexp_extract(url, r"(?i)executive-order-(\d+(?:-?a)?)(?:-|/|$)", 1))
        .when(doc_type == "proclamation", F.regexp_extract(url, r"(?i)proclamation-(\d+)(?:-|/|$)", 1))
        .when(doc_type == "memorandum", normalize_identifier(numbered)).otherwise("")
    )


def unmask(masked: Column, spans: Column, token: str = "[AUTHORITY]") -> Column:
    """The masked text with its spans put back in order; another number of spans than of tokens is an error."""
    parts = F.split(masked, "\\Q" + token + "\\E", -1)
    whole = F.array_join(F.zip_with(parts, F.concat(spans, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    return F.when(F.size(parts) == F.size(spans) + 1, whole).otherwise(F.raise_error(F.lit("the spans do not fit the masked text")).cast("string"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(c: Column, pattern: str, tag: str = "mark") -> Column:
    """Escaped text with every match in a tag."""
    return F.regexp_replace(escape_html(c), f"({pattern})", f"<{tag}>$1</{tag}>")


def pack_pieces(pieces: Column, budget: int) -> Column:
    """Pieces packed in order into chunks of at most ``budget`` white-space tokens, joined by blank lines.

    Pieces are numbered from 1; one over the budget is cut into runs of that many tokens. Null or no pieces give no chunks.
    """
    numbered = F.transform(pieces, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p))

    def cut(piece):
        words = F.filter(F.split(piece, r"\s+"), lambda w: w != "")
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(words) / budget).cast("int") - 1))
        return F.transform(starts, lambda i: F.slice(words, i * budget + 1, budget))

    runs = F.flatten(F.transform(numbered, cut))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"))

    def step(acc, run):
        full = (F.size(acc["held"]) > 0) & (acc["size"] + F.size(run) > budget)
        text = F.array(F.array_join(run, " "))
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["held"], "\n\n")))).otherwise(acc["out"]).alias("out"),
            F.when(full, text).otherwise(F.concat(acc["held"], text)).alias("held"),
            (F.when(full, 0).otherwise(acc["size"]) + F.size(run)).alias("size"),
        )

    done = F.aggregate(runs, zero, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(F.array_join(a["held"], "\n\n")))).otherwise(a["out"]))
    return F.when(F.size(pieces) > 0, done).otherwise(F.array().cast("array<string>"))


def try_number(c: Column) -> Column:
    """Empty is missing; what is no finite number raises."""
    v = F.nullif(F.trim(c), F.lit("")).cast("double")
    return F.when(F.isnan(v) | v.isin(float("inf"), float("-inf")), F.raise_error(F.lit("a score is not finite"))).otherwise(v)
