"""HTML pages and tables: text, links, images and cells as rows.

Parsing a page is Python (the standard library's parser) in Arrow batches; what
follows, such as grid checks and rendering, is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.pages import markup_texts
from lodestone.operators import tablelex



class _Links(HTMLParser):
    """href and src of a page with what they are: (kind, url, label)."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.found, self.href, self.label = base, [], None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag == "a" and own.get("href"):
            self.href, self.label = own["href"], []
        elif tag == "img" and own.get("src"):
            self.found.append(("image", own["src"], own.get("alt") or ""))

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.label.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            self.found.append(("link", self.href, " ".join("".join(self.label).split())))
            self.href = None

    def rows(self) -> list[dict]:
        out = []
        for kind, url, label in self.found:
            try:
                out.append({"kind": kind, "url": urljoin(self.base, url), "label": label})
            except ValueError:
                continue
        return out


#: The widest spans of a table that is laid out.
MOST_ROWS, MOST_COLUMNS = 2000, 64
_CELLS = pa.struct(
    [(n, pa.int32()) for n in ("table", "n_rows", "row", "cell", "col", "rowspan", "colspan")] + [("table_begin", pa.int64()), ("table_end", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]
    + [("fault", pa.string()), ("header", pa.bool_()), ("text", pa.string()), ("source", pa.string())]
)
_CELL = "array<struct<table:int,n_rows:int,row:int,cell:int,col:int,rowspan:int,colspan:int,table_begin:long,table_end:long,begin:long,end:long,fault:string,header:boolean,text:string,source:string>>"


def page_cells(pages: DataFrame, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS, sources: bool = False) -> DataFrame:
    """(page_id, cells): the cells of all tables of a page (page_id, html) as one array in the order of the page, with the
    fields of ``table_cells`` and, if ``sources``, with their ``source``, the part of the html that each one is.

    Null and empty pages have no tables; only pages with a table go to Python.  Pages are dealt by their id first: a file
    that Spark reads in one task is parsed, and its cells are aggregated, in as many as there are partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends = [], [0]
            for page in batch.column(1).to_pylist():
                for i, t in enumerate(tablelex.tables(page, most_rows, most_columns)):
                    places, n = None if t.fault else tablelex.columns(t.rows), len(t.rows)
                    for r, row in enumerate(t.rows):
                        for k, c in enumerate(row):
                            col = None if places is None else places[r][k]
                            rows.append((i, n, r, k, col, c.rowspan, c.colspan, t.begin, t.end, c.begin, c.end, t.fault, c.header, c.text, page[c.begin : c.end] if sources else None))
                ends.append(len(rows))
            fields = zip(*rows) if rows else [()] * _CELLS.num_fields
            cells = pa.StructArray.from_arrays([pa.array(own, f.type) for own, f in zip(fields, _CELLS)], fields=list(_CELLS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], names=["page_id", "cells"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").filter(F.col("html").rlike("(?i)<table"))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as joining small partitions goes by bytes, not by the time that parsing takes
    return own.repartition(tasks, "page_id").mapInArrow(run, f"page_id long, cells {_CELL}")


def table_cells(pages: DataFrame, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """The cells of all tables of pages (page_id, html), a row each: page_id, table, n_rows, row, cell (its place in the
    row's source), col, rowspan, colspan, header, text, where table and cell begin and end in the html, in
    characters, and the table's fault.  A table with a fault is not laid out: its cells have no ``col``."""
    return page_cells(pages, most_rows, most_columns).select("page_id", F.explode("cells").alias("c")).select("page_id", "c.*").drop("source")


def text_with_tables(pages: DataFrame) -> DataFrame:
    """(page_id, text): a page's blocks as lines, its tables in their places as lines 'first — header: value; ...' where a
    row is as wide as the first one, else with bars; a caption is left out.  Only pages with a table go to Python."""

    has = F.col("html").rlike("(?i)<table")

    @F.arrow_udf("string")
    def lined(page: pa.Array) -> pa.Array:
        return pa.array([None if x is None else tablelex.with_lines(x) for x in page.to_pylist()], pa.string())

    own = pages.select("page_id", "html", has.alias("has")).select("page_id", F.when(F.col("has"), lined(F.when(F.col("has"), F.col("html")))).otherwise(F.col("html")).alias("text"))
    return markup_texts(own, "text")


def page_links(pages: DataFrame) -> DataFrame:
    """The links and images of pages (page_id, url, html): page_id, kind, url (absolute), label."""
    schema = "page_id long, found array<struct<kind:string,url:string,label:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("url", pa.string()), ("label", pa.string())]))
        for batch in batches:
            found = []
            for base, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parser = _Links(base or "")
                parser.feed(page or "")
                found.append(parser.rows())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["page_id", "found"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)
    return rows.select("page_id", F.explode("found").alias("f")).select("page_id", "f.*")


def attested(attachments: DataFrame, links: DataFrame) -> DataFrame:
    """Attachments (url, parent_id) that their parent page really links to."""
    own = links.filter("kind = 'link'").select(F.col("page_id").alias("parent_id"), "url").distinct()
    return attachments.join(own, ["parent_id", "url"], "left_semi")


def grid_faults(cells: DataFrame) -> DataFrame:
    """(page_id, table, fault) of tables that are no full grid: those that could not be laid out, and by their
    spans out of bounds, overlapping, with gaps."""
    keys = ["page_id", "table"]
    spots = cells.filter("fault IS NULL").select(
        *keys, "n_rows", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("r"), F.col("col").alias("c0"), (F.col("col") + F.col("colspan") - 1).alias("c1"),
    ).select(*keys, "n_rows", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    own = spots.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), F.max("r").alias("r"), F.max("c").alias("c"), F.count(F.lit(1)).alias("n"), F.countDistinct("r", "c").alias("d"))
    fault = (
        F.when(F.col("r") >= F.col("n_rows"), "span out of bounds").when(F.col("n") > F.col("d"), "overlap").when(F.col("d") < F.col("n_rows") * (F.col("c") + 1), "gaps")
    )
    laid_out = own.select(*keys, fault.alias("fault")).filter("fault is not null")
    return laid_out.unionByName(cells.filter("fault IS NOT NULL").select(*keys, "fault").distinct())


def table_text(cells: DataFrame) -> DataFrame:
    """(page_id, table, row, text): rows as 'header: value; ...' by the header cells above each column."""
    heads = cells.filter("header").select("page_id", "table", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("col"), "row", F.col("text").alias("head"))
    top = heads.groupBy("page_id", "table", "col").agg(F.array_join(F.array_distinct(F.array_sort(F.collect_list(F.struct("row", "head")))["head"]), " / ").alias("head"))
    body = cells.filter("not header").join(top, ["page_id", "table", "col"], "left")
    value = F.when(F.col("head").isNotNull() & (F.col("head") != ""), F.concat("head", F.lit(": "), "text")).otherwise(F.col("text"))
    rows = body.filter("text <> ''").groupBy("page_id", "table", "row").agg(F.array_sort(F.collect_list(F.struct("col", "cell", value.alias("v")))).alias("vs"))
    return rows.select("page_id", "table", "row", F.array_join("vs.v", "; ").alias("text"))


def spanned_groups(cells: DataFrame) -> DataFrame:
    """(page_id, table, row, row_group): rows that spans tie together are one group."""
    rows = cells.groupBy("page_id", "table", "row").agg(F.max(F.col("row") + F.col("rowspan") - 1).alias("row_end"))
    w = Window.partitionBy("page_id", "table").orderBy("row")
    before = F.max("row_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("new", F.when(before.isNull() | (F.col("row") > before), 1).otherwise(0))
    return new.select("page_id", "table", "row", F.sum("new").over(w).alias("row_group"))


def rendered_groups(cells: DataFrame) -> DataFrame:
    """(page_id, table, row_group, text): body rows that spans tie together as lines
    '- row r, column c [headers]: value', counted from 1, with the range of a merged cell and '(blank)'."""
    keys = ["page_id", "table"]
    heads = cells.filter("header").select(*keys, F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("col"), "row", F.col("text").alias("head"))
    top = heads.filter("head <> ''").groupBy(*keys, "col").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("row", "head")))["head"]).alias("heads"))
    span = lambda at, n: F.when(F.col(n) > 1, F.concat((F.col(at) + 1).cast("string"), F.lit("-"), (F.col(at) + F.col(n)).cast("string"))).otherwise((F.col(at) + 1).cast("string"))
    head = F.when(F.size("heads") > 0, F.concat(F.lit(" ["), F.array_join("heads", " / "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- row "), span("row", "rowspan"), F.lit(", column "), span("col", "colspan"), head, F.lit(": "), F.when(F.col("text") == "", "(blank)").otherwise(F.col("text")))
    body = cells.filter("not header").join(top, [*keys, "col"], "left").join(spanned_groups(cells), [*keys, "row"])
    lines = F.array_sort(F.collect_list(F.struct("row", "col", "cell", line.alias("line"))))["line"]
    return body.groupBy(*keys, "row_group").agg(F.array_join(lines, "\n").alias("text"))


def linked_cells(paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(section, record_number, state) of cell paragraphs against the blocks of a document, both
    (section, record_number, text): 'linked', 'other text', 'repeated' if one record stands for several, 'no block'
    or, of a block that no paragraph has, 'left over'."""
    key = ["section", "record_number"]
    own = paragraphs.groupBy(*key).agg(F.count(F.lit(1)).alias("np"), F.min("text").alias("pt"))
    other = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("nb"), F.min("text").alias("bt"))
    state = (
        F.when(F.col("np").isNull(), "left over").when(F.col("nb").isNull(), "no block").when((F.col("np") > 1) | (F.col("nb") > 1), "repeated")
        .when(F.col("pt").eqNullSafe(F.col("bt")), "linked").otherwise("other text")
    )
    return own.join(other, key, "full").select(*key, state.alias("state"))


def duty_rows(cells: DataFrame, dept: str, phone: str = r"\d{2,3}-\d{3,4}-\d{4}") -> DataFrame:
    """(page_id, pos, task, phone) of the table rows of a department: three cells, the first its name, the last a phone number."""
    rows = cells.filter("not header").groupBy("page_id", "table", "row").agg(F.array_sort(F.collect_list(F.struct("col", "cell", "text")))["text"].alias("c"))
    own = rows.filter((F.size("c") == 3) & (F.col("c")[0] == dept) & F.col("c")[2].rlike(f"^(?:{phone})$"))
    return own.select("page_id", F.col("row").alias("pos"), F.col("c")[1].alias("task"), F.col("c")[2].alias("phone"))
