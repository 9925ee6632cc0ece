"""Moment matrices as mergeable aggregates, and elimination on them in DataFrame expressions.

Tasks multiply whole Arrow batches and hand on one matrix each; the matrices are added up
and solved by DataFrame functions. (Written as one built-in sum a matrix cell, the
aggregate of some forty columns grows beyond what the JVM compiles.) What is shuffled is
as wide as the columns asked for, whatever the number of table rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the columns of some rows of one group to named matrices, whose sums over all rows are wanted.
Product = Callable[[str, np.ndarray], dict[str, np.ndarray]]


def gram(group: str, columns: np.ndarray) -> dict[str, np.ndarray]:
    """Products of all columns with all columns."""
    return {"": columns.T @ columns}


def _partial(group: str, columns: Sequence[str], product: Product):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            of = batch[group].to_numpy(zero_copy_only=False)
            values = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in columns]) if len(of) else np.zeros((0, len(columns)))
            for key in dict.fromkeys(of.tolist()):
                for name, matrix in product(key, values[of == key]).items():
                    known = sums.get((key, name))
                    sums[key, name] = matrix if known is None else known + matrix
        rows = [(key, name, i, row.tolist()) for (key, name), matrix in sums.items() for i, row in enumerate(matrix)]
        names, kinds = (group, "name", "i", "moments"), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def moments(rows: DataFrame, group: str, columns: Sequence[str], product: Product = gram) -> DataFrame:
    """(group, name, moments): the sum of each named matrix over all rows of a group, as rows of numbers.

    ``group`` is a text column of few values, the columns are doubles without NULL.
    """
    wanted = rows.select(group, *columns)
    parts = wanted.mapInArrow(_partial(group, columns, product), f"{group} string, name string, i int, moments array<double>")
    cells = parts.select(group, "name", "i", F.posexplode("moments").alias("j", "x")).groupBy(group, "name", "i", "j").agg(F.sum("x").alias("x"))

    def in_order(place: str, value: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda cell: cell[value])

    lines = cells.groupBy(group, "name", "i").agg(in_order("j", "x").alias("x"))
    return lines.groupBy(group, "name").agg(in_order("i", "x").alias("moments"))


def eliminated(matrix: Column, size: Column) -> Column:
    """Gauss-Jordan elimination of the first ``size`` columns, without exchange of rows.

    For positive definite matrices, whose pivots stay positive. Appended columns become
    solutions, an appended unit matrix the inverse.
    """

    def step(rows: Column, k: Column) -> Column:
        pivot = F.element_at(rows, k)
        scaled = F.transform(pivot, lambda x: x / F.element_at(pivot, k))
        return F.transform(
            rows,
            lambda row, i: F.when(i + 1 == k, scaled).otherwise(F.zip_with(row, scaled, lambda x, p: x - F.element_at(row, k) * p)),
        )

    return F.aggregate(F.sequence(F.lit(1), size), matrix, step)


def picked(matrix: Column, places: Column, penalties: Column) -> Column:
    """Sub-matrix at 1-based ``places``, with ``penalties`` added to its diagonal."""
    return F.transform(
        places,
        lambda a, i: F.transform(
            places, lambda b, j: F.element_at(F.element_at(matrix, a), b) + F.when(i == j, F.element_at(penalties, i + 1)).otherwise(F.lit(0.0))
        ),
    )


def solution(matrix: Column, right: Column) -> Column:
    """x with matrix x = right."""
    system = F.zip_with(matrix, right, lambda row, y: F.concat(row, F.array(y)))
    return F.transform(eliminated(system, F.size(right)), lambda row: F.element_at(row, -1))


def inverse_diagonal(matrix: Column) -> Column:
    """Diagonal of the inverse."""
    n = F.size(matrix)
    unit = F.transform(matrix, lambda row, i: F.concat(row, F.transform(row, lambda _, j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))))
    return F.transform(eliminated(unit, n), lambda row, i: F.element_at(row, n + i + 1))
