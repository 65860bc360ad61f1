"""Operators at their limits: errors, nulls, empty tables, hot groups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import approval, chunking, conversation, evaluation, evidence, htmltables, index, quality
from lodestone.sources import readers, work


def test_numbered_is_the_loop(spark):
    work.shared_folder(spark)
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(("a", "b", None)), i) for i in range(500)]
    got = {(r.g, r.o): r.number for r in index.numbered(spark.createDataFrame(rows, "g string, o long").repartition(7), "g", "o").collect()}
    for g in {g for g, _ in rows}:
        assert [got[g, o] for o in sorted(o for x, o in rows if x == g)] == list(range(1, sum(x == g for x, _ in rows) + 1))
    assert index.numbered(spark.createDataFrame([], "g string, o long"), "g", "o").count() == 0


def test_what_stops_a_job(spark):
    listed = lambda *now: spark.createDataFrame([("law", c, i) for i, c in enumerate(now)], "name string, current boolean, serial int")
    assert approval.only_current(listed(False, True, None), "serial").first()["serial"] == 1
    for now in ((False, False), (True, True)):
        with pytest.raises(Exception, match="not exactly one"):
            approval.only_current(listed(*now), "serial").collect()
    sheet = spark.createDataFrame([("s", 0, ["Key"]), ("s", 1, ["1"])], "sheet string, row int, cells array<string>")
    assert evaluation.by_headers(sheet, {"k": "Key"}).first()["k"] == "1"
    with pytest.raises(Exception, match="no column Name"):
        evaluation.by_headers(sheet, {"n": "Name"}).collect()
    with pytest.raises(Exception, match="model call failed: 401"):
        spark.range(1).select(conversation.backend_route(F.lit("401"), F.lit("x"), "y")).collect()


def test_currentness_of_nothing(spark):
    of = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    none = F.lit(None).cast("string")
    rows = F.array(F.lit("a"), F.lit("b"))
    empty = F.array().cast("array<string>")
    assert of(approval.file_current(F.lit("h"), none)).detail == "look-up failed" and not of(approval.file_current(none, F.lit("h"))).ok
    assert of(approval.table_current(rows, empty, F.array(F.lit("b"), F.lit("a")))).ok and of(approval.table_current(rows, empty, empty)).detail == "look-up failed"
    assert of(approval.table_current(rows, F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))).detail == "look-up failed"
    assert of(approval.law_current(F.lit("1"), F.lit("2024"), none, none, empty, F.lit("2025"))).detail == "look-up failed"


def test_tables_with_wide_spans(spark):
    """Spans beyond the limits are a fault, found before anything is laid out; others that are no number are 1."""
    wide = "<table><tr>" + "<td colspan=60000 rowspan=60000>a</td>" * 1000 + "</tr></table>"
    pages = spark.createDataFrame([(1, wide), (2, ""), (3, None), (4, "<table><tr><td colspan=64 rowspan=0>a</td><td colspan=x>b</td></tr></table>")], "page_id long, html string")
    cells = htmltables.table_cells(pages)
    assert {(r.page_id, r.fault) for r in cells.collect()} == {(1, "span beyond limit"), (4, None)}
    assert [(r.col, r.rowspan, r.colspan, r.text) for r in cells.filter("page_id = 4").orderBy("col").collect()] == [(0, 1, 64, "a"), (64, 1, 1, "b")]
    assert [tuple(r) for r in htmltables.grid_faults(cells).collect()] == [(1, 0, "span beyond limit")]


def test_cells_tile_the_text_of_their_table(spark):
    """Made tables in any notation: the parts of the source outside cells have no text, and a cell's part has its own."""
    import html
    import random
    import re

    rng = random.Random(8)
    tags = re.compile(r"""<!--.*?-->|<(script|style)\b.*?</\1>|<(?:[^>"']|"[^"]*"|'[^']*')*>""", re.DOTALL | re.IGNORECASE)
    bare = lambda x: " ".join(html.unescape(tags.sub(" ", x)).split())
    pages = []
    for i in range(60):
        def cell():
            tag = rng.choice(["td", "th", "TD"])
            inner = rng.choice(["", "x", "a &amp; b", "<b>é</b> c", "<p>l</p>m", "1<br>2", "<!-- <td>no</td> -->v", "w<script>'<td>'</script>", "<a title='</td>'>t</a>"])
            return f"<{tag}{rng.choice(['', ' rowspan=2', ' colspan=" + chr(34) + "3" + chr(34) + "', ' data-colspan=9'])}>{inner}{rng.choice([f'</{tag}>', ''])}"
        body = "".join(f"<tr>{''.join(cell() for _ in range(rng.randint(0, 4)))}{rng.choice(['</tr>', ''])}" for _ in range(rng.randint(1, 4)))
        pages.append((i, f"<p>漢 before</p><table>{body}</table> after <table><tr><td>z</table>"))
    cells = htmltables.table_cells(spark.createDataFrame(pages, "page_id long, html string")).collect()
    for i, page in pages:
        own = sorted((c for c in cells if c.page_id == i), key=lambda c: c.begin)
        assert [c.text for c in own] == [bare(page[c.begin : c.end]) for c in own]
        for t in {c.table for c in own}:
            at, rest, of = None, [], [c for c in own if c.table == t]
            at = of[0].table_begin
            for c in of:
                assert c.begin >= at
                rest.append(page[at : c.begin])
                at = c.end
            assert bare("".join([*rest, page[at : of[0].table_end]])) == ""
            assert page[of[0].table_begin :].startswith("<table") and page[: of[0].table_end].endswith("</table>")


def test_faults_of_the_lexer(spark):
    pages = [(1, "<table><tr><td><table><tr><td>in</td></tr></table>out</td></tr></table>"), (2, "<table><tr><td>x"), (3, "<table></table><table><td>no row</td></table>")]
    cells = htmltables.table_cells(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id").collect()
    assert [(c.page_id, c.table, c.fault, c.text, c.col) for c in cells] == [(1, 0, "nested table", "out", None), (2, 0, "table not closed", "x", None), (3, 1, None, "no row", 0)]


def test_texts_with_tables_in_their_places(spark):
    page = "<p>a &amp; b</p><table><caption>cap</caption><tr><th>K</th><th>Fee</th><th>By</th></tr><tr><td>x</td><td>1 &lt; 2</td><td></td></tr><tr><td colspan=2>wide</td><td>z</td></tr></table>c<table><tr><td>one</td></tr><tr><td>two</td></tr></table>"
    got = {r.page_id: r.text for r in htmltables.text_with_tables(spark.createDataFrame([(1, page), (2, "<p>plain</p>"), (3, None)], "page_id long, html string")).collect()}
    assert got == {1: "a & b\nK | Fee | By\nx — Fee: 1 < 2; By: -\nwide | z\nc\none\ntwo", 2: "plain", 3: None}


def test_texts_without_content(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\na\n b\nlong line\nlong  line\n")], "doc_id long, text string")
    once = {r.doc_id: (r.text, r.removed) for r in quality.once_in_order(docs).collect()}
    assert once[3] == ("a\n\na\n b\nlong line", 1) and once[2] == ("", 0) and once[1][0] is None
    limited = {r.doc_id: (r.status, r.reason) for r in chunking.within_limits(docs.withColumn("chunk_kind", F.lit(None).cast("string")), {"form": 9}, other=5).collect()}
    assert limited == {1: ("held", "blank"), 2: ("held", "blank"), 3: ("held", "longer than 5")}
    of = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    none = F.lit(None).cast("string")
    assert of(tx.only_elsewhere(none, "a", "b")) is False and of(tx.is_submitted(none, "x")) is False and of(tx.good_transcript(none)) is False and of(tx.good_transcript(F.lit(""))) is False
    assert of(tx.relative_dates(none, F.lit("2024-01-31").cast("date"), {"w": ("month", -1)}, {"month": "yyyy-MM"})) == []
    assert of(tx.date_label(F.lit("known"), none, F.lit(""), {"updated": "u", "published": "p", "conflicting": "c", "unknown": "none"})) == "none"
    assert of(conversation.reclassified(F.lit("answer"), F.lit("nothing here"), F.lit(1), "nothing", {"n": F.lit(True)})).answer == "nothing here\n\nn"
    assert of(evidence.form_download(none, F.lit("t"), F.lit("u"), F.array().cast("array<int>"))) is None
    assert readers.ndjson_tokens(spark.createDataFrame([("m", None), ("n", "x\n[]\n{}")], "message_id string, body string")).count() == 0
    images = spark.createDataFrame([("a",), ("b",), ("b",)], "sha256 string")
    texts = lambda *rows: spark.createDataFrame(rows, "sha256 string, text string")
    got = {r.sha256: (r.origin, r.text) for r in quality.with_transcripts(images, ("hand", texts(("a", " "))), ("read", texts(("a", "t")))).collect()}
    assert got == {"a": ("read", "t"), "b": (None, None)}


def test_folders(spark, tmp_path):
    assert work.exists(spark, f"file://{tmp_path}") and not work.exists(spark, f"file://{tmp_path}/none")

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work.shared_folder(Cluster())
