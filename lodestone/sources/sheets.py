"""Spreadsheet rows as text: (sheet, row, cells) in, one line for each row out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"^[-\d,.%]+$"


def sheet_lines(rows: DataFrame, head_rows: int = 8) -> DataFrame:
    """(sheet, row, text): rows below the header as 'label — header: value; ...', rows above it as they are.

    The header is the row with the most cells of text among the first ``head_rows`` that are
    not empty, of several the first.  A row's label is its cells of text; its numbers go with their headers."""
    cells = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    own = rows.select("sheet", "row", cells.alias("cells")).filter(F.exists("cells", lambda c: c != ""))
    worded = F.size(F.filter("cells", lambda c: (c != "") & ~c.rlike(NUMBER)))
    # Each task keeps the first rows of a sheet, and only these meet.
    firsts = own.withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy("row"))).filter(F.col("place") <= head_rows)
    starts = firsts.groupBy("sheet").agg(F.collect_list(F.struct("row", worded.alias("n"), "cells")).alias("first"))
    best = F.array_sort(F.transform("first", lambda r: F.struct((-r["n"]).alias("n"), r["row"].alias("row"), r["cells"].alias("cells"))))[0]
    heads = starts.select("sheet", best["row"].alias("head_row"), best["cells"].alias("head"))
    label = F.array_join(F.filter("cells", lambda c: (c != "") & ~c.rlike(NUMBER)), " ")
    pairs = F.zip_with("head", "cells", lambda h, c: F.when(c.rlike(NUMBER), F.concat(F.when(F.coalesce(h, F.lit("")) == "", "column").otherwise(h), F.lit(": "), c)))
    values = F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "; ")
    label = F.when(label == "", "-").otherwise(label)
    text = F.when(F.col("row") < F.col("head_row"), F.array_join(F.filter("cells", lambda c: c != ""), " ")).otherwise(F.when(values == "", label).otherwise(F.concat(label, F.lit(" — "), values)))
    return own.join(heads, "sheet").filter(F.col("row") != F.col("head_row")).select("sheet", "row", text.alias("text"))
