"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that are summed up by one fold; a fold copies what it has gathered at each step.
BLOCK = 256


def apart(docs: DataFrame, names: Iterable[str], own: Iterable[str] = ()) -> DataFrame:
    """``docs`` with columns that clash with result names renamed to ``name_input`` (again until it is free).

    Columns of ``own`` stay as they are: the operator replaces or reads them.
    """
    taken = {n.lower() for n in names} | {c.lower() for c in docs.columns}
    results = {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in results and c not in own:
            name = c + "_input"
            while name.lower() in taken:
                name += "_input"
            taken.add(name.lower())
            docs = docs.withColumnRenamed(c, name)
    return docs


def sums_before(values: Column) -> Column:
    """For each int of an array the sum of those before it, in time almost linear in its length.

    Blocks are summed first; then each block is folded by itself from its own start.
    """
    size = F.lit(BLOCK)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), size), lambda k: k < F.size(values))
    blocks = F.transform(starts, lambda k: F.slice(values, k + 1, size))
    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x)
    none = F.array().cast("array<int>")

    def fold(block: Column, begin: Column) -> Column:
        state = F.struct(begin.alias("at"), none.alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(block, state, step, lambda s: s["out"])

    one = fold(values, F.lit(0))
    begins = F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, b: F.struct((s["at"] + total(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"],
    )
    many = F.flatten(F.zip_with(blocks, begins, fold))
    return F.when(F.size(values) <= BLOCK, one).otherwise(many)


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once for each row, however often later expressions, or their lambdas, read them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
