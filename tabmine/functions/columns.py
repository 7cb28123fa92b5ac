"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cell that is a number: no units, no digit separators, no words such as NaN.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Cells that stand for a missing value.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "?")


def number(cell: Column) -> Column:
    """The cell as double, null where it isn't a number."""
    cell = F.trim(cell)
    return F.when(cell.rlike(NUMBER), cell.try_cast("double"))


def is_missing(cell: Column) -> Column:
    return cell.isNull() | F.trim(cell).isin(*MISSING)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for reports, never -0.0."""
    return F.round(x, digits) + F.lit(0.0)


def order_key(seed: int, row_id: Column) -> Column:
    """A reproducible shuffle: ordering by this string is a permutation that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}-"), row_id.cast("string")))


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def poly_kernel(a: Column, b: Column, gamma: Column, coef0: float = 0.0, degree: int = 3) -> Column:
    return F.pow(gamma * dot(a, b) + coef0, F.lit(float(degree)))


def rbf_kernel(a: Column, b: Column, gamma: Column) -> Column:
    return F.exp(-gamma * squared_distance(a, b))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column, clip: float = 500.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(x, F.lit(-clip)), F.lit(clip))))


def activation_slope(name: str, x: Column) -> Column:
    """Derivative of an activation at its input."""
    if name == "relu":
        return F.when(x > 0, 1.0).otherwise(0.0)
    if name == "sigmoid":
        return sigmoid(x) * (1.0 - sigmoid(x))
    return 1.0 - F.tanh(x) * F.tanh(x)


def softmax(x: Column) -> Column:
    """Stable softmax of an array."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / total(e))


def argmax(x: Column) -> Column:
    """Zero-based place of the largest element, the first one of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: Pearson r over the rows that have both values, null where one has no spread."""
    a, b = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def entropy_of(counts: Column) -> Column:
    """Entropy in bits of an array of counts."""
    n = total(F.transform(counts, lambda c: c.cast("double")))
    return F.aggregate(
        counts, F.lit(0.0), lambda acc, c: acc - F.when(c > 0, (c / n) * F.log2(c / n)).otherwise(0.0)
    )
