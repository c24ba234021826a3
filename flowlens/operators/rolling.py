"""Count-based windows over the last N rows, without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.operators.split import assign_index
from flowlens.schema import CATEGORIES


def _halo(df: DataFrame, index: str, n: int, block: int, contiguous: bool) -> tuple[DataFrame, Column]:
    """Rows with their block, those within n-1 of its end also in the next one; and the home block of a row.

    Blocks hold a fixed number of rows, so unless the index is known to have no gaps, rows are ranked by it first.
    """
    if not contiguous:
        df = assign_index(df, [index], "_rank")
    i = F.col(index if contiguous else "_rank")
    home = F.floor(i / block)
    late = F.pmod(i, F.lit(block)) > block - n
    copies = F.when(late, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_block", F.explode(copies)), home


def last_n(df: DataFrame, index: str, n: int, aggregates: dict[str, Column], keep: list[str] = (),
           block: int | None = None, contiguous: bool = False) -> DataFrame:
    """``aggregates`` over the last ``n`` rows at every row in order of ``index``, which may have gaps and be negative; of equal
    indexes either may come first. ``contiguous``: the caller knows that it counts up by one, which saves a sort.

    Rows are cut into blocks; the last n-1 rows of a block are copied into the next one, so
    each block is an independent window partition of bounded size.
    """
    block = block or max(4096, 32 * n)
    if block < n:
        raise ValueError("a block must hold at least n rows")
    halo, home = _halo(df, index, n, block, contiguous)
    window = Window.partitionBy("_block").orderBy(index).rowsBetween(-(n - 1), 0)
    return (
        halo.select(index, *keep, "_block", *[e.over(window).alias(name) for name, e in aggregates.items()])
        .where(F.col("_block") == home)
        .drop("_block")
    )


def last_n_sums(df: DataFrame, index: str, n: int, terms: dict[str, Column], keep: list[str] = (),
                block: int | None = None, contiguous: bool = False) -> DataFrame:
    """Sums over the last ``n`` rows as in ``last_n``: a running sum minus the running sum n rows before, so the cost of a
    row does not depend on n."""
    block = block or max(4096, 32 * n)
    if block < n:
        raise ValueError("a block must hold at least n rows")
    halo, home = _halo(df, index, n, block, contiguous)
    by_index = Window.partitionBy("_block").orderBy(index)
    running = by_index.rowsBetween(Window.unboundedPreceding, 0)
    summed = halo.select(index, *keep, "_block", *[F.sum(e).over(running).alias(name) for name, e in terms.items()])
    sums = F.struct(*terms)
    before = summed.withColumn("_before", F.lag(sums, n).over(by_index))
    return before.where(F.col("_block") == home).select(
        index, *keep, *[(F.col(t) - F.coalesce(F.col(f"_before.{t}"), F.lit(0))).alias(t) for t in terms]
    )


def confusion_cells(category: str, pred: str) -> dict[str, Column]:
    """One 0/1 term per cell of the category x verdict matrix: ``c<category>_<verdict>``."""
    return {
        f"c{c}_{v}": ((F.col(category) == c) & (F.col(pred) == v)).cast("long")
        for c in range(len(CATEGORIES)) for v in (0, 1)
    }


def rolling_category_confusion(df: DataFrame, index: str, category: str, pred: str, n: int = 200,
                               block: int | None = None, contiguous: bool = False) -> DataFrame:
    """The confusion matrix of the last ``n`` flows at every flow."""
    return last_n_sums(df, index, n, confusion_cells(category, pred), block=block, contiguous=contiguous)
