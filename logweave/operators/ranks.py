"""Places in order within groups of any size, in two levels (X4, W1, raw line numbers).

A group is cut into cells of so many order values. Counts run within a cell, and the counts of whole cells run within the
group, one narrow row a cell. So a group that holds most rows is spread over as many tasks as it has cells, and no sort gets
more rows than a cell has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values of a cell.
CELL = 65_536


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], ties: list[str] | None = None, cell: int = CELL) -> DataFrame:
    """``rows`` with further columns: for each of ``sums`` its sum over the group's rows before this one.

    ``order`` is a whole number, not negative; ``ties`` order rows of one number. Keys must not be null.
    """
    made = [f"_n_{k}" for k in sums]
    placed = rows.withColumns({"_cell": F.expr(f"{order} div {cell}"), **{m: c.cast("bigint") for m, c in zip(made, sums.values())}})
    inside = Window.partitionBy(*keys, "_cell")
    along = inside.orderBy(order, *(ties or []))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = placed.withColumns({"_nth": F.row_number().over(along), **{f"_upto{m}": F.sum(m).over(upto) for m in made}, **{f"_all{m}": F.sum(m).over(inside) for m in made}})
    cells = inner.where("_nth = 1").select(*keys, "_cell", *[f"_all{m}" for m in made])
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(*keys, "_cell", *[F.coalesce(F.sum(f"_all{m}").over(before), F.lit(0)).alias(f"_base{m}") for m in made])
    out = inner.join(bases, [*keys, "_cell"])
    return out.select(*[F.col(c) for c in rows.columns], *[(F.col(f"_base{m}") + F.col(f"_upto{m}") - F.col(m)).alias(k) for k, m in zip(sums, made)])
