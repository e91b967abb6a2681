"""The flagship plan: total the amounts on scanned invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import parse_cell
from ..operators.grids import grid_with_header


def invoice_totals(blocks: DataFrame, amount_col: int = 3) -> DataFrame:
    """``image_id, lines, total`` from text boxes: grid, header, typed cells, sum in whole cents.

    Only a row that looks like a header is left out; an invoice without one keeps all its rows.
    """
    cells = grid_with_header(blocks).where(~(F.col("is_header") & F.col("met")) & (F.col("col") == amount_col))
    cell = parse_cell(F.col("text"))
    amount = F.coalesce(cell["whole"].cast("decimal(38,2)"), cell["num"].cast("decimal(18,2)"))
    return cells.groupBy("image_id").agg(
        F.count(amount).alias("lines"), F.sum(amount).cast("double").alias("total")
    )
