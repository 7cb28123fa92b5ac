"""The feature frame (row_id, x array<double>, y int), label dictionaries and exact distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmine.functions.columns import order_key, vector
from tabmine.sources.files import stored


def frame(df: DataFrame, row_id: str, features: list[str], label: str | None = None) -> DataFrame:
    """(row_id, x, y) from wide columns; y is an int code that the table already has."""
    y = F.col(label).cast("int") if label else F.lit(0)
    return df.select(F.col(row_id).alias("row_id"), vector(features).alias("x"), y.alias("y"))


def long(df: DataFrame) -> DataFrame:
    """(row_id, y, fi, v): one row per cell of a feature frame."""
    return df.select("row_id", "y", F.posexplode("x").alias("fi", "v"))


def melt(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., fi, feature, v): wide columns as rows, features numbered as listed."""
    cells = F.array(*[
        F.struct(F.lit(k).alias("fi"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for k, c in enumerate(features)
    ])
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.fi", "cell.feature", "cell.v")


def label_dictionary(df: DataFrame, label: str) -> DataFrame:
    """(label, y): codes 0..K-1 in the labels' order. The window is over distinct labels only."""
    names = df.select(F.col(label).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return names.withColumn("y", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def label_dictionary_first_seen(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """(label, y): codes in the order of each label's smallest row id."""
    first = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.min(row_id).alias("at"))
    return first.select("label", (F.row_number().over(Window.orderBy("at", "label")) - 1).cast("int").alias("y"))


def encode(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """``df`` with the code y of its label; labels outside the dictionary are an error."""
    joined = df.join(codes.withColumnRenamed("label", "__label"), F.col(label) == F.col("__label"), "left").drop("__label")
    known = F.col("y").isNotNull() | F.col(label).isNull()
    return joined.withColumn("y", F.when(known, F.col("y")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.col(label)))))


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of aggregates, marked for broadcast if it has at most ``most`` rows, which are then read once.

    Larger ones meet the other side in an ordinary join.
    """
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def parts_for(n: int, size: int = 65_536) -> int:
    """Into how many buckets ``n`` values go: about ``size`` in each, more (and not only more buckets) beyond its square."""
    return max(1, -(-n // max(size, int(n**0.5))))


def literal_array(values: list, kind: str = "double") -> Column:
    """A constant array, written as one string, so that long ones are cheap to plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def ranged(df: DataFrame, order: list[Column | str], size: int = 65_536) -> tuple[DataFrame, Column | None]:
    """``df`` in ranges of ``order`` of about ``size`` rows each, and the number of a row's range; (df, None) if one is enough.

    Spark's range partitioning finds the borders, so none are in the plan, and equal keys share a range. It is
    written, since a range's number must stay what it is; the number is a column __range.
    """
    parts = parts_for(df.count(), size)
    if parts == 1:
        return df, None
    dealt = df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    return stored(dealt, "ranges"), F.col("__range")


def running_sums(
    df: DataFrame, values: dict[str, Column], bucket: Column | None, order: list[Column | str], by: list[str] | None = None
) -> DataFrame:
    """``df`` with running sums of ``values``, a row's own value included, over ``order`` within ``by``.

    No window holds more than a bucket: totals per bucket give each bucket what lies before it, and
    ``bucket`` must agree with ``order``. Without a bucket there is one window for each ``by``.
    """
    by = by or []
    if bucket is None:
        inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(v).over(inside) for n, v in values.items()})
    rows = df.withColumns({"__bucket": bucket, **{f"__v_{n}": v for n, v in values.items()}})
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "__bucket").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    totals = totals.select(*by, "__bucket", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values])
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = {n: F.col(f"__b_{n}") + F.sum(f"__v_{n}").over(inside) for n in values}
    joined = rows.join(totals, [*by, "__bucket"]).withColumns(run)
    return joined.drop("__bucket", *[f"__{p}_{n}" for n in values for p in "vb"])


def running_sum(df: DataFrame, value: Column, name: str, order: list[Column | str], by: list[str] | None = None, size: int = 65_536) -> DataFrame:
    """``running_sums`` of one value over ranges of ``order``."""
    dealt, bucket = ranged(df, order, size)
    return running_sums(dealt, {name: value}, bucket, order, by).drop("__range")


def shuffled_rank(df: DataFrame, row_id: str, seed: int, by: list[str] | None = None, name: str = "rank", size: int = 65_536) -> DataFrame:
    """``df`` with the 1-based place of each row in the seeded shuffle, exact and without a global window."""
    keyed = df.withColumn("__key", order_key(seed, F.col(row_id)))
    return running_sum(keyed, F.lit(1), name, ["__key", row_id], by, size).drop("__key")


def quantiles(cells: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 10_000, size: int = 65_536) -> DataFrame:
    """(keys..., n, q): exact quantiles of the values of each group, interpolated between neighbours; nulls are skipped.

    A mergeable sketch brackets each quantile; one more pass counts what lies below a bracket and, by value,
    what lies in it: some thousandths of the rows. Only those are ordered, in buckets of the bracket.
    """
    rows = cells.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    margin, k = 3.0 / accuracy, len(probs)
    at = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", at, accuracy).alias("__a")
    )
    short = F.col("n") <= size  # then all of it is the bracket
    bracket = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(short, F.col("__min")).otherwise(F.col("__a")[i]).alias("lo"), F.when(short, F.col("__max")).otherwise(F.col("__a")[k + i]).alias("hi"))
        for i in range(k)
    ])
    sketch = few(sketch.select(*keys, "n", bracket.alias("__b")))
    met = rows.join(sketch, keys) if keys else rows.crossJoin(sketch)
    near = met.select(*keys, "n", "__v", F.explode(F.filter("__b", lambda b: F.col("__v") <= b["hi"])).alias("b"))
    inside = F.when(F.col("__v") >= F.col("b.lo"), F.col("__v"))
    counts = near.groupBy(*keys, "n", "b.i", "b.lo", "b.hi", inside.alias("w")).agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("n") * (4 * margin) / size)
    place = F.floor((F.col("w") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * parts)
    group = [*keys, "i"]
    bucket = F.when((parts <= 1) | (F.col("hi") == F.col("lo")), 0).otherwise(F.least(place, parts - 1))
    bucket = F.when(F.col("w").isNull(), -1).otherwise(bucket)
    run = running_sums(counts, {"upto": F.col("c")}, bucket, [F.asc_nulls_first("w")], group)
    p = F.element_at(literal_array(probs), F.col("i") + 1) * (F.col("n") - 1)
    low = F.min(F.when(F.col("upto") > F.floor(p), F.col("w")))
    high = F.min(F.when(F.col("upto") > F.ceil(p), F.col("w")))
    found = run.groupBy(*group, "n").agg(low.alias("low"), high.alias("high"))
    q = F.col("low") + (F.col("high") - F.col("low")) * (p - F.floor(p))
    each = found.select(*keys, "n", F.struct("i", q.alias("q")).alias("s"))
    out = each.groupBy(*keys, "n").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return out.select(*keys, "n", F.transform("s", lambda x: x["q"]).alias("q"))
