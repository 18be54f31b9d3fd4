"""Relational part of drawing analysis: boxes, lines and what they touch.

Geometry of one page is bounded; joins are within (document, page), on cells of a grid
where a page may hold many objects, so that no page is compared all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.relational import islands

#: Side of a grid cell in points.
CELL = 72.0


def cells(x0: Column, y0: Column, x1: Column, y1: Column, slack: float = 0.0) -> Column:
    """Grid cells that a box, widened by ``slack``, touches."""
    lo = lambda v: F.floor((v - slack) / CELL)
    hi = lambda v: F.floor((v + slack) / CELL)
    return F.flatten(F.transform(F.sequence(lo(x0), hi(x1)), lambda i: F.transform(F.sequence(lo(y0), hi(y1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def containing(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """(box_id, point_id): boxes (page, box_id, x0, y0, x1, y1) that hold a point (page, point_id, x, y)."""
    b = boxes.withColumn("cell", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))))
    p = points.withColumn("cell", F.struct(F.floor(F.col("x") / CELL).alias("i"), F.floor(F.col("y") / CELL).alias("j")))
    return b.join(p, ["page", "cell"]).filter("x between x0 and x1 and y between y0 and y1").select("page", "box_id", "point_id")


def merge_lines(lines: DataFrame, across: float = 4.0, along: float = 6.0) -> DataFrame:
    """Horizontal lines (page, y, x0, x1) in bins of ``across``, joined where gaps are at most ``along``."""
    binned = lines.withColumn("bin", F.floor(F.col("y") / across))
    runs = islands(binned, ["page", "bin"], "x0", "x1", along)
    return runs.groupBy("page", "bin", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.round(F.avg("y"), 3).alias("y"), F.count(F.lit(1)).alias("parts"))


def connections(lines: DataFrame, symbols: DataFrame, reach: float = 6.0) -> DataFrame:
    """(page, a, b, line_id): two symbols that both ends of one line touch; the first line of a pair counts."""
    ends = lines.select("page", "line_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("end"))
    ends = ends.select("page", "line_id", "end.x", "end.y").withColumn("cell", F.struct(F.floor(F.col("x") / CELL).alias("i"), F.floor(F.col("y") / CELL).alias("j")))
    boxes = symbols.withColumn("cell", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), reach)))
    touch = ends.join(boxes, ["page", "cell"]).filter(f"x between x0 - {reach} and x1 + {reach} and y between y0 - {reach} and y1 + {reach}")
    touch = touch.select("page", "line_id", "symbol_id").distinct()
    pair = touch.withColumnRenamed("symbol_id", "a").join(touch.withColumnRenamed("symbol_id", "b"), ["page", "line_id"]).filter("a < b")
    first = F.row_number().over(Window.partitionBy("page", "a", "b").orderBy("line_id"))
    return pair.withColumn("n", first).filter("n = 1").drop("n")
