"""Tables of blocks: cells as items of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as K


def table_items(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, row, cell, id, kind, source, formulas) of the cells of blocks (doc_id, pos, page, ord, rows), where rows
    is an array of rows of cells of parts (kind, content). Formulas become numbered placeholders; cells without any text
    or formula give none."""
    rows = blocks.select("doc_id", "pos", "page", "ord", F.posexplode("rows").alias("row", "r"))
    cells = rows.select("doc_id", "pos", "page", "ord", "row", F.posexplode("r.cells").alias("cell", "c"))
    made = cells.withColumn("s", K.assembled(F.col("c.parts"))).where("s.text <> ''")
    block = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("ord").cast("string"))
    name = F.concat(block, F.lit("__r"), F.col("row").cast("string"), F.lit("c"), F.col("cell").cast("string"))
    return made.select("doc_id", "pos", "row", "cell", name.alias("id"), F.lit("table_cell").alias("kind"), F.col("s.text").alias("source"), F.col("s.formulas").alias("formulas"))
