"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

Every text is measured once. The sketch is a histogram over geometric buckets (relative error of
about 1 %): counts add, so sketches of any split of the rows merge to the same one, whatever the order
of tasks, and quantiles are reproducible. Sketches take the rows that pass the base rules.

A ratio is smoothed: (count + 1) / (size + weight), so that a few symbols in a short text are no large
ratio and a group without any still has a spread. A group's cut-off lies, on a logarithmic scale, a
multiple of the distance between its quartiles above the upper one (for the mean word length also below
the lower one), and beyond that by the sketch's own error, so that a group without spread keeps its rows.
There is no fixed cut-off. The quartiles of a group of n rows are drawn towards those of
its language, and those of a language towards those of all rows, with the weight of ``prior`` rows, so a
small group has its cut-offs mostly from its language and a large one from itself, without a switch.

Null and empty texts have no words and fail the base rules. Null languages and sources are groups of
their own. Repeated rows are measured and returned row by row; an empty table gives an empty result;
columns besides the named ones are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, alone, cut, doc_chunks, mix, pick, small_batches, unused, utf8, word_hashes

GAMMA = 1.02
WINDOW_WORDS = 8
#: metric -> (count, size, weight in the smoothed ratio, sides, distances between quartiles up to the cut-off)
METRICS = {
    "symbol_ratio": ("n_symbols", "n_words", 100, "upper", 3.0),
    "upper_ratio": ("n_upper", "word_chars", 50, "upper", 4.0),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 10, "upper", 3.0),
    "word_length": ("word_chars", "n_words", None, "both", 4.0),
}
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def repeated_words(h: np.ndarray, k: int = WINDOW_WORDS) -> int:
    """Words that lie in a k-word window found at least twice."""
    n = len(h) - k + 1
    if n < 2:
        return 0
    w = np.full(n, k, U64)
    for i in range(k):
        w = mix(w * U64(0x9E3779B97F4A7C15) + h[i : n + i])
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def measure_text(data: bytes, n_chars: int, h: np.ndarray, word_bytes: int) -> list[int]:
    spaces = len(data) - word_bytes
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return [
        len(h),
        n_chars - spaces,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(h),
        len(lines),
        len(data) - len(data.translate(None, UPPER)),
    ]


@alone
def _measure(batches):
    for batch in batches:
        texts = utf8(batch.column("text"))
        rows = []
        for a, b in doc_chunks(texts):
            part = texts[a:b]
            h, start, end = word_hashes(b"\n".join(part))
            edges = np.cumsum([0] + [len(t) + 1 for t in part])
            cuts = np.searchsorted(start, edges)
            lengths = np.concatenate(([0], np.cumsum(end - start)))
            for i, t in enumerate(part):
                x, y = cuts[i], cuts[i + 1]
                chars = len(t) if t.isascii() else len(t.decode("utf-8", "replace"))
                rows.append(measure_text(t, chars, h[x:y], int(lengths[y] - lengths[x])))
        a = np.array(rows, np.int64).reshape(-1, len(COUNTS))
        keep = [batch.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(a[:, i]) for i in range(len(COUNTS)))], names=["doc_id", "lang", "source", *COUNTS])


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each row, from one scan."""
    small_batches(docs.sparkSession)
    d = pick(docs, doc_id=doc_id, lang=lang, source=source, text=text)
    kind = dict(d.dtypes)
    schema = f"doc_id {kind['doc_id']}, lang {kind['lang']}, source {kind['source']}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return d.mapInArrow(_measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_metrics(m: DataFrame) -> DataFrame:
    """The metrics: smoothed ratios, and the mean word length (0 without words)."""

    def ratio(count: str, size: str, weight: int | None) -> Column:
        if weight is None:
            return F.when(F.col(size) > 0, F.col(count) / F.col(size)).otherwise(F.lit(0.0))
        return (F.col(count) + 1) / (F.col(size) + weight)

    return m.withColumns({name: ratio(*spec[:3]) for name, spec in METRICS.items()})


def sketch(m: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """keys, metric, bucket, n: bucket b holds values in (GAMMA^(b-1), GAMMA^b], null bucket the value 0."""
    names = metrics or list(METRICS)
    long = m.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("v")) for x in names])).alias("e"))
    bucket = F.when(F.col("e.v") > 0, F.ceil(F.log(F.col("e.v")) / math.log(GAMMA)).cast("int"))
    return long.select(*keys, F.col("e.metric").alias("metric"), bucket.alias("bucket")).groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """keys, metric, size and a column for each quantile; a group has a bounded number of buckets."""
    by = Window.partitionBy(*keys, "metric")
    run = by.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    s = sketches.withColumns({"up_to": F.sum("n").over(run), "size": F.sum("n").over(by), "value": value})
    return s.groupBy(*keys, "metric").agg(
        F.max("size").alias("size"),
        *[F.min(F.when(F.col("up_to") >= F.greatest(F.lit(1.0), F.ceil(F.col("size") * q)), F.col("value"))).alias(c) for c, q in qs.items()],
    )


def thresholds(m: DataFrame, prior: float = 100.0) -> DataFrame:
    """lang, source, and low and high of each metric."""
    fine = cut(sketch(with_metrics(m.filter(~base_failed())), ["lang", "source"]), "quality-sketch")
    qs = {"q1": 0.25, "q3": 0.75}
    own = quantiles(fine, ["lang", "source"], qs)
    of_lang = quantiles(merge(fine, ["lang"]), ["lang"], qs)
    of_all = quantiles(merge(fine, []), [], qs)
    level = own.alias("o").join(of_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.metric") == F.col("l.metric"))).join(of_all.alias("a"), F.col("o.metric") == F.col("a.metric"))

    def drawn(n: str, here: Column, there: Column) -> Column:
        return (F.col(n) * here + prior * there) / (F.col(n) + prior)

    def q(name: str) -> Column:
        return drawn("o.size", F.log(f"o.{name}"), drawn("l.size", F.log(f"l.{name}"), F.log(f"a.{name}")))

    level = level.select("o.lang", "o.source", "o.metric", q("q1").alias("q1"), q("q3").alias("q3"))
    out = []
    for name, (*_, sides, reach) in METRICS.items():
        wide, here = reach * (F.col("q3") - F.col("q1")), F.col("metric") == name
        out.append(F.max(F.when(here, GAMMA * F.exp(F.col("q3") + wide))).alias(f"{name}_high"))
        out.append(F.max(F.when(here, F.exp(F.col("q1") - wide) / GAMMA if sides == "both" else F.lit(0.0))).alias(f"{name}_low"))
    return level.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, prior: float = 100.0, **columns: str) -> DataFrame:
    """A row for each document: its counts, base_failed and kept."""
    m = cut(measure(docs, **columns), "quality-measures")
    t = thresholds(m, prior)
    x = with_metrics(m).alias("m").join(t.alias("t"), F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    inside = F.lit(True)
    for name in METRICS:
        inside = inside & F.col(f"m.{name}").between(F.col(f"t.{name}_low"), F.col(f"t.{name}_high"))
    failed = base_failed()
    return x.select("m.doc_id", *[f"m.{c}" for c in COUNTS], failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep.

    Rows that share a doc_id go or stay together: they stay if one of them is kept.
    """
    name = options.get("doc_id", "doc_id")
    (key,) = unused(docs, "id")
    good = judge(docs, **options).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(good, F.col(f"`{name}`").eqNullSafe(F.col(key)), "left_semi")
