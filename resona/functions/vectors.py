"""Vector columns: `array<double>`, all expressions stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(col: Column) -> Column:
    return col.cast("array<double>")


def matrix_literal(rows: Sequence[Sequence[float]]) -> Column:
    """Constant vectors as one folded expression (not one literal per element)."""
    text = json.dumps([[float(v) for v in row] for row in rows])
    return F.from_json(F.lit(text), "array<array<double>>")


def constant_array(values: Sequence, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often and wherever `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    """L2 distance; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(squared_distance(a, b)))


def weighted_euclidean(a: Column, b: Column, weights: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(dot(squares, weights)))


def frames_gaussian(values: Column, frames: int, d: int) -> Column:
    """Mean and sample covariance (flat d + d*d) of one vector read as frames of d numbers."""
    series = [strided(values, i, d, frames) for i in range(d)]
    means = [total(s) / frames for s in series]
    covariances = [
        (dot(a, b) - total(a) * total(b) / frames) / (frames - 1) for a in series for b in series
    ]
    return F.array(*means, *covariances)


def strided(values: Column, start: int, step: int, count: int) -> Column:
    """Elements start, start + step, ... (zero based)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.element_at(values, i * step + start + 1),
    )


def upper_triangle(matrix: Column, d: int) -> Column:
    """Row-major upper triangle, diagonal included, of a flat d x d matrix."""
    return F.concat(*[F.slice(matrix, r * d + r + 1, d - r) for r in range(d)])


def gaussian_to_euclid(gaussian: Column, d: int) -> Column:
    """Mean followed by the upper triangle of the covariance, from the flat d + d*d form."""
    return F.concat(F.slice(gaussian, 1, d), upper_triangle(F.slice(gaussian, d + 1, d * d), d))


def parse_numbers(text: Column) -> Column:
    """Numbers out of `b'1.5'`, `"1.5"`, `[1, 2]` or `1,2`; an unreadable element becomes null."""
    bare = F.regexp_replace(text, r"b'|['\"\[\]\s]", "")
    return F.when(
        F.length(bare) > 0,
        F.transform(F.split(bare, ","), lambda v: v.try_cast("double")),
    ).otherwise(F.array().cast("array<double>"))


def all_numbers(values: Column) -> Column:
    """True for a non-empty vector without null or NaN elements."""
    return (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))


def rows_of(flat: Column, rows: int) -> Column:
    """Row-major flat matrix to array of rows."""
    width = (F.size(flat) / rows).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(flat, r * width + 1, width)
    )


def transpose_flat(flat: Column, rows: int) -> Column:
    """Row-major rows x L to row-major L x rows."""
    width = (F.size(flat) / rows).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.size(flat) - 1),
        lambda i: F.element_at(flat, ((i % rows) * width + (i / rows).cast("int") + 1).cast("int")),
    )
