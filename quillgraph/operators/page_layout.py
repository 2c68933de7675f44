"""Text segments of recognised pages: doubtful segments, rows and cells, reading order, tables, Markdown.

Segments are ``(page_id, seg_id, text, confidence, x, y, w, h)``; a page is small, so its windows hold one page each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows: gap of tops in shares of the mean height; cells: gap of sides in shares of the mean height.
ROW_GAP, CELL_GAP = 0.75, 1.5
# What stands before an entry of a list.
LIST_MARK = r"^\s*(?:[•●◦▪*-]|\d{1,3}[.)])\s+"


def doubtful(segments: DataFrame, least: float = 60.0) -> DataFrame:
    """Segments with ``doubt``: ``low`` confidence, a run of ``signs``, or null."""
    signs = F.col("text").rlike(r"[^\p{L}\p{N}\s.,;:!?()'\"-]{3,}")
    return segments.withColumn("doubt", F.when(F.col("confidence") < least, "low").when(signs, "signs"))


def confidence_buckets(segments: DataFrame) -> DataFrame:
    """``(page_id, n, high, medium, low, mean)``: from 80, from 60, and below."""
    c = F.col("confidence")
    return segments.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(c >= 80).alias("high"), F.count_if((c >= 60) & (c < 80)).alias("medium"), F.count_if(c < 60).alias("low"), F.round(F.avg(c), 2).alias("mean"))


def normal_boxes(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Segments with their boxes in shares of the page, from ``pages`` ``(page_id, width, height)``; null where it has no size."""
    share = lambda c, of: F.when(F.col(of) > 0, F.round(F.col(c) / F.col(of), 6))
    met = segments.join(pages.select("page_id", "width", "height"), "page_id", "left")
    return met.select(*segments.columns, share("x", "width").alias("nx"), share("y", "height").alias("ny"), share("w", "width").alias("nw"), share("h", "height").alias("nh"))


def rows_and_cells(segments: DataFrame) -> DataFrame:
    """Segments with their row and cell on the page: a new row where a top is further than ROW_GAP of the mean height from
    the mean of the tops of the row so far, a new cell where sides are further apart than CELL_GAP of it.  Boxes without
    size are left out."""
    page = Window.partitionBy("page_id")
    rows = segments.where("w > 0 AND h > 0").withColumn("mean_h", F.avg("h").over(page))
    # the different tops of a page are folded from above (equal ones share a row); each opens a row or joins the last one
    # and moves its mean
    met = rows.groupBy("page_id", "mean_h", "y").agg(F.count("*").alias("k"))
    tops = met.groupBy("page_id", "mean_h").agg(F.array_sort(F.collect_list(F.struct("y", "k"))).alias("s"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        y, k = s["y"].cast("double"), s["k"]
        far = (a["n"] == 0) | (F.abs(y - a["sum"] / F.greatest(a["n"], F.lit(1))) > ROW_GAP * F.col("mean_h"))
        row = F.when(far, a["row"] + 1).otherwise(a["row"])
        return F.struct(row.alias("row"), F.when(far, y * k).otherwise(a["sum"] + y * k).alias("sum"), F.when(far, k).otherwise(a["n"] + k).alias("n"), F.concat(a["out"], F.array(row)).alias("out"))

    placed = tops.select("page_id", "s", F.aggregate("s", start, step)["out"].alias("r")).select("page_id", F.explode(F.arrays_zip("s", "r")).alias("z")).select("page_id", F.col("z.s.y").alias("y"), F.col("z.r").cast("bigint").alias("row"))
    rows = rows.join(placed, ["page_id", "y"])
    along = Window.partitionBy("page_id", "row").orderBy("x", "seg_id")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(along)
    return rows.withColumn("cell", F.sum(F.when(gap >= CELL_GAP * F.col("mean_h"), 1).otherwise(0)).over(along)).drop("mean_h")


def cells(segments: DataFrame) -> DataFrame:
    """``(page_id, row, cell, text)``: the text of each cell."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seg_id", "text"))), lambda s: s["text"]), " ")
    return rows_and_cells(segments).groupBy("page_id", "row", "cell").agg(words.alias("text"))


def tables(segments: DataFrame, least_rows: int = 3) -> DataFrame:
    """``(page_id, n_columns, n_rows)``: pages on which at least three rows have the same number of two or more cells."""
    per_row = cells(segments).groupBy("page_id", "row").agg(F.count("*").alias("n_columns")).where("n_columns >= 2")
    counted = per_row.groupBy("page_id", "n_columns").agg(F.count("*").alias("n_rows"))
    best = counted.groupBy("page_id").agg(F.max(F.struct("n_rows", "n_columns")).alias("b"))
    return best.where(F.col("b.n_rows") >= least_rows).select("page_id", "b.n_columns", "b.n_rows")


def reading_order(segments: DataFrame, least: int = 10) -> DataFrame:
    """Segments with their place: column by column where the page has two columns, else from top to bottom.

    A page has two columns if it has ``least`` segments, few of them cross its middle, and both halves hold a third.
    """
    page = Window.partitionBy("page_id")
    box = segments.where("w > 0 AND h > 0").withColumn("middle", (F.min("x").over(page) + F.max(F.col("x") + F.col("w")).over(page)) / 2)
    left, right = F.col("x") + F.col("w") <= F.col("middle"), F.col("x") >= F.col("middle")
    n = F.count("*").over(page)
    share = lambda c: F.sum(c.cast("int")).over(page) / n
    two = (n >= least) & (share(~left & ~right) <= 0.15) & (share(left) >= 1 / 3) & (share(right) >= 1 / 3)
    placed = box.withColumn("column", F.when(two & right, 1).otherwise(0))
    return placed.withColumn("place", F.row_number().over(page.orderBy("column", "y", "x", "seg_id"))).drop("middle")


def markdown(segments: DataFrame) -> DataFrame:
    """``(page_id, text)``: lines in reading order; high lines are headings, wide gaps open paragraphs."""
    ordered = reading_order(segments)
    median = ordered.groupBy("page_id").agg(F.percentile("h", 0.5).alias("median"))
    w = Window.partitionBy("page_id").orderBy("place")
    rows = ordered.join(median, "page_id").withColumn("gap", F.col("y") - F.lag("y").over(w))
    head = F.when(F.col("h") >= 2 * F.col("median"), "# ").when(F.col("h") >= 1.5 * F.col("median"), "## ").otherwise("")
    bullet = F.col("text").rlike(LIST_MARK)
    mark = F.when((head == "") & bullet, "- ").otherwise(head)
    opens = F.when(F.col("gap").isNull(), "").when((head != "") | (F.col("gap") > 2.2 * F.col("median")) | (F.col("gap") < 0), "\n\n").otherwise("\n")
    line = F.concat(opens, mark, F.when((head == "") & bullet, F.regexp_replace("text", LIST_MARK, "")).otherwise(F.col("text")))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "").alias("text"))
