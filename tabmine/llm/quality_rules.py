"""Quality rules with thresholds learned from mergeable quantile sketches per language and source.

Everything here is DataFrame functions. A sketch is a table of counts over logarithmic buckets of an
integer metric (64 buckets per power of two, so a quantile is off by at most 1/64): sketches merge by
adding counts, are the same for every partitioning, and have at most a few thousand rows per group, so
the hot source costs no more than any other.

A rate's threshold in a group is mid + times * max(low, least / length): mid is the median, low how far the
lowest tenth lies below it, both of which junk above the median doesn't move, however much of it there is up to
half; least / length is what the smallest occurrence makes in a typical text, or in the text itself if that
is shorter. So a spike at one value (all texts without symbols, say) doesn't make a single occurrence
count as excess. A group whose median is over the threshold of its language, or a language's over that of all,
is mostly junk and is held to that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmine.llm.common import OWN, small, stored, text_of

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Base measures, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Judged measures: (name, count, per, least). ``least`` is the smallest count that an occurrence adds: a
#: repeated window covers three words at two places.
RATES = (
    ("symbol_rate", "n_symbols", "n_words", 1),
    ("dup_line_rate", "n_dup_lines", "n_lines", 1),
    ("repeat_rate", "n_repeat_words", "n_words", 6),
    ("upper_rate", "n_upper", "word_chars", 1),
)
#: Lengths whose medians are learned too.
LENGTHS = ("n_words", "n_lines", "word_chars")
#: How many lower spreads, or occurrences in a typical text, a rate may lie above the median.
TIMES = 8
#: A group's threshold weighs as many documents as it has, its language's (and that of all) so many.
PRIOR = 200


def measure(docs: DataFrame, prefix: str = OWN, text_col: str = "text") -> DataFrame:
    """``docs`` plus the base measures, n_lines and n_upper of each whole text, named with ``prefix``.

    A 3-word window counts as repeated if it stands at two or more places; n_repeat_words is how many
    words such windows cover. Windows are compared by a 64-bit hash within their document.
    """
    p, own = prefix, docs.columns
    w, h, s, at, lines = (F.col(f"{OWN}{x}") for x in ("w", "h", "s", "at", "lines"))
    n = F.size(w)
    out = docs.withColumn(f"{OWN}t", text_of(text_col))
    out = out.withColumns({
        f"{OWN}w": F.array_remove(F.split(F.col(f"{OWN}t"), SPACE), ""),
        f"{OWN}lines": F.filter(F.split(F.col(f"{OWN}t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        f"{p}n_symbols": F.regexp_count(F.col(f"{OWN}t"), F.lit(SYMBOL)).cast("long"),
        f"{p}n_upper": F.regexp_count(F.col(f"{OWN}t"), F.lit(r"\p{Lu}")).cast("long"),
        f"{p}word_chars": F.length(F.regexp_replace(F.col(f"{OWN}t"), SPACE, "")).cast("long"),
    })
    out = out.withColumns({
        f"{OWN}h": F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ),
        f"{p}n_words": n.cast("long"),
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }).drop(f"{OWN}w", f"{OWN}lines", f"{OWN}t")
    out = out.withColumn(
        f"{OWN}s",
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop(f"{OWN}h")
    twin = lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
    out = out.withColumn(f"{OWN}at", F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))).drop(f"{OWN}s")
    k = F.size(at)
    gaps = F.zip_with(F.slice(at, F.lit(2), k - 1), F.slice(at, F.lit(1), k - 1), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3).cast("long"), lambda total, x: total + x)
    repeat = F.when(F.coalesce(k, F.lit(0)) > 1, covered).otherwise(F.lit(0).cast("long"))
    return out.select(*own, *[f"{p}{x}" for x in (*MEASURES[:-1], "n_lines", "n_upper")], repeat.alias(f"{p}n_repeat_words"))


def base_failed(prefix: str = OWN) -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def rate(count: str, per: str, prefix: str = OWN) -> Column:
    """Millionths beyond the first occurrence, rounded down; 0 where there is nothing to divide by.

    One occurrence says nothing about a text, so it counts in no rate.
    """
    n, k = F.col(f"{prefix}{per}"), F.greatest(F.col(f"{prefix}{count}") - 1, F.lit(0))
    return F.when(n > 0, F.floor(k * 1_000_000 / n)).otherwise(0).cast("long")


def bucket(v: Column) -> Column:
    """Sketch bucket of an integer >= 0: exact below 128, then 64 per power of two."""
    e = F.length(F.bin(v)) - 1
    step = F.expr("bigint(1)") * F.pow(F.lit(2.0), F.greatest(e - 6, F.lit(0))).cast("long")
    return F.when(v < 64, v).otherwise((e - 6) * 64 + F.floor(v / step)).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest integer of a bucket."""
    e = F.floor(b / 64) + 5
    step = F.pow(F.lit(2.0), e - 6).cast("long")
    return F.when(b < 64, b).otherwise((F.pmod(b, F.lit(64)) + 65) * step - 1).cast("long")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source", prefix: str = OWN) -> DataFrame:
    """(lang, source, name, bucket, n) of rates and lengths over the documents that pass the base rules."""
    values = [(name, rate(a, b, prefix)) for name, a, b, _ in RATES] + [(name, F.col(f"{prefix}{name}")) for name in LENGTHS]
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), bucket(v).alias("bucket")) for name, v in values])
    rows = measured.filter(~base_failed(prefix)).select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.explode(pairs).alias("x"),
    )
    return rows.groupBy("lang", "source", "x.name", "x.bucket").agg(F.count("*").alias("n"))


def _least(name: str | Column) -> Column:
    return F.create_map(*[F.lit(x) for rule, _, _, least in RATES for x in (rule, least * 1_000_000)])[name]


def _top(mid: Column, low: Column, size: Column, least: Column, times: int) -> Column:
    """The threshold of a rate in a text of a length."""
    return mid + times * F.greatest(low, F.floor(least / size))


def levels(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, n, mid, low, size) of each group and rate: n documents, median, lower spread, median length."""
    merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "name")
    run = merged.select(
        *keys, "name", bucket_top(F.col("bucket")).alias("v"), F.sum("n").over(group).alias("all"),
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    quantile = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("v")))
    found = run.groupBy(*keys, "name").agg(F.max("all").alias("n"), quantile(10).alias("q10"), quantile(50).alias("q50"))
    rates = found.select(*keys, "name", "n", F.col("q50").alias("mid"), (F.col("q50") - F.col("q10")).alias("low"))
    per = F.create_map(*[F.lit(x) for rule, _, of, _ in RATES for x in (rule, of)])
    sizes = found.select(*keys, F.col("name").alias("per"), F.greatest("q50", F.lit(1)).alias("size"))
    return rates.filter(F.col("name").isin([rule for rule, *_ in RATES])).withColumn("per", per[F.col("name")]).join(sizes, [*keys, "per"]).drop("per")


def group_levels(sketch: DataFrame, prior: int = PRIOR, times: int = TIMES) -> DataFrame:
    """(lang, source, name, mid, low, size): each group's own levels, drawn towards its language's, and those towards everyone's.

    A group of n documents weighs n and what it is drawn towards ``prior``, so that a small group relies
    on the merged sketches and a large one on its own, without a size at which it changes over. A group whose
    median is over the threshold it is drawn towards takes that one's median and spread.
    """

    def drawn(own: DataFrame, to: DataFrame, on: list[str]) -> DataFrame:
        both = own.join(to.drop("n").withColumnsRenamed({c: f"to_{c}" for c in ("mid", "low", "size")}), on)
        junk = F.col("mid") > _top(F.col("to_mid"), F.col("to_low"), F.col("to_size"), _least(F.col("name")), times)
        pull = lambda c: F.floor((F.col("n") * F.col(c) + prior * F.col(f"to_{c}")) / (F.col("n") + prior)).cast("long")
        kept = {c: F.when(junk, F.col(f"to_{c}")).otherwise(pull(c)) for c in ("mid", "low")} | {"size": pull("size")}
        return both.withColumns(kept).select(*own.columns)

    lang = drawn(levels(sketch, ["lang"]), F.broadcast(levels(sketch, [])), ["name"])  # a row per rule
    return drawn(levels(sketch, ["lang", "source"]), lang, ["lang", "name"]).drop("n")


def judge(
    spark: SparkSession, measured: DataFrame, lang: str = "lang", source: str = "source", prefix: str = OWN, prior: int = PRIOR, times: int = TIMES
) -> DataFrame:
    """``measured`` plus base_failed and kept, named with ``prefix``.

    A document is held to the thresholds of its language and source. Null languages and sources are a
    group of their own. A rate equal to its threshold is kept; in an empty table nothing is judged.
    """
    sketch = stored(spark, sketches(measured, lang, source, prefix), "sketches")
    kinds = ("mid", "low", "size")
    columns = [F.max(F.when(F.col("name") == name, F.col(c))).alias(f"{OWN}{c}_{name}") for name, *_ in RATES for c in kinds]
    groups = group_levels(sketch, prior, times).groupBy(F.col("lang").alias(f"{OWN}lang"), F.col("source").alias(f"{OWN}source")).agg(*columns)
    out = measured.withColumns({
        f"{OWN}lang": F.coalesce(F.col(lang).cast("string"), F.lit("")),
        f"{OWN}source": F.coalesce(F.col(source).cast("string"), F.lit("")),
    })
    out = out.join(small(stored(spark, groups, "levels")), [f"{OWN}lang", f"{OWN}source"], "left")
    ok = F.lit(True)
    for name, a, b, _ in RATES:
        mid, low, size = (F.col(f"{OWN}{c}_{name}") for c in kinds)
        top = _top(mid, low, F.least(size, F.greatest(F.col(f"{prefix}{b}"), F.lit(1))), _least(F.lit(name)), times)
        ok &= F.coalesce(rate(a, b, prefix) <= top, F.lit(True))
    failed = base_failed(prefix)
    return out.withColumns({f"{prefix}base_failed": failed, f"{prefix}kept": ~failed & ok})


def quality(spark: SparkSession, docs: DataFrame, prior: int = PRIOR, times: int = TIMES) -> DataFrame:
    """doc_id, the base measures, n_lines, n_upper, base_failed and kept of every row.

    Null and empty texts have no words and fail the base rules; texts of any length are measured whole;
    repeated rows give repeated rows, an empty table none; columns beyond doc_id, text, lang and source are
    ignored, whatever their names. Measures are written once to the shared folder, so the texts are read
    once for sketches and verdicts together.
    """
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"))
    measured = stored(spark, measure(rows, "").drop("text"), "quality")
    judged = judge(spark, measured, prefix="", prior=prior, times=times)
    return judged.select("doc_id", *MEASURES, "n_lines", "n_upper", "base_failed", "kept")


def keep_good(spark: SparkSession, docs: DataFrame, prior: int = PRIOR, times: int = TIMES) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts go to the shared folder once, beside their measures.

    Rows with null or empty texts go, as ``quality`` says; repeated rows stay or go together; null ids don't
    matter; extra columns stay, and none may begin with the helper prefix; an empty table stays empty.
    """
    if clash := [c for c in docs.columns if c.startswith(OWN)]:
        raise ValueError(f"columns named like helper columns: {clash}")
    measured = stored(spark, measure(docs), "quality")
    judged = judge(spark, measured, prior=prior, times=times)
    return judged.filter(F.col(f"{OWN}kept")).select(*docs.columns)
