"""Page expressions, sheets, unit spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import pages as pg
from lodestone.functions import text
from lodestone.operators import chunking
from lodestone.sources import sheets


def one(spark, column):
    return spark.createDataFrame([(1,)], "i int").select(column.alias("x")).first()["x"]


PAGE = "<nav>n</nav><!-- content start --><h2>T</h2><p>a &amp; b<br>c</p><ul><li>x</li><li>y</li></ul><script>s</script><table><tr><th>h</th><td>v</td></tr></table><img src=i alt=\"pic\"><!-- content end --><p>f</p>"


def test_body_text(spark):
    got = one(spark, pg.body_text(F.lit(PAGE), "<!-- content start -->", "<!-- content end -->"))
    assert (got.text, got.problem) == ("T\na & b\nc\n- x\n- y\nh | v\n[pic]", None)
    assert one(spark, pg.body_text(F.lit(PAGE + "<!-- content end -->"), "<!-- content start -->", "<!-- content end -->")).problem == "no single boundary"
    assert one(spark, pg.body_text(F.lit("<s><p>x<e>"), "<s>", "<e>")).problem == "too short"


def test_lines_and_addresses(spark):
    lines = F.array(*map(F.lit, ("home", "menu", "text", "menu")))
    nav = F.array(F.lit("home"), F.lit("menu"))
    assert one(spark, pg.without_leading(lines, nav)) == ["text", "menu"] and one(spark, pg.without_leading(nav, nav)) == []
    assert one(spark, pg.phones(F.lit("061-123-4567, 061-123-4567 or 02-999-8888 not 1061-123-45678"))) == ["061-123-4567", "02-999-8888"]
    assert one(spark, pg.impossible_times(F.lit("9:00 to 25:10, 24:00, 12:75"))) == ["25:10", "12:75"]
    assert one(spark, pg.says_no_evidence(F.lit("There is nothing about it."), "nothing about"))


def test_answers(spark):
    got = one(spark, pg.answer_blocks(F.lit("Intro **bold** [1]\n1. first [2]\n- dot\n\n")))
    assert [(b.kind, b.text, b.cited) for b in got] == [("paragraph", "Intro bold", [1]), ("ordered", "first", [2]), ("bullet", "dot", [])]
    t = one(spark, pg.trailer(F.lit('@@ {"type":"clarify","options":["a","a","b"],"forms":["[2]",3],"forms":[3,"x"],"type":"answer"} rest')))
    assert (t.type, t.options, t.actions, t.forms) == ("clarify", ["a", "b"], [], [3])
    t = one(spark, pg.trailer(F.lit('{"type":"clarify","options":["' + "x" * 51 + '"," ",7],"actions":["pay",3,"buy"],"forms":[" 4 ",true,2.5,"a1",-1]}'), ("pay",)))
    assert (t.type, t.options, t.actions, t.forms) == ("answer", [], ["pay"], [4, -1])
    t = one(spark, pg.trailer(F.lit('{"type":"answer","options":["a"],"forms":"12","forms":[1]}')))
    assert (t.type, t.options, t.forms) == ("answer", [], [])
    t = one(spark, pg.trailer(F.lit("none")))
    assert (t.type, t.options, t.forms) == ("answer", [], [])


def test_trimming_a_long_text_takes_time_in_proportion(spark):
    import time

    rows = spark.createDataFrame([("a\nb\n" * 50_000 + "end",)], "text string")
    kept = pg.without_leading(text.lines(F.col("text")), lambda own: F.slice(own, 1, 2))
    began = time.time()
    assert rows.select(F.size(kept)).first()[0] == 1
    assert time.time() - began < 5


def test_sheets(spark):
    rows = [("s", 0, ["Fees 2024", None, ""]), ("s", 1, ["Kind", "2023", "Unit cost"]), ("s", 2, ["Crane", "1,200", "3.5"]), ("s", 3, [None, "7", ""]), ("s", 4, ["", "", ""])]
    got = sheets.sheet_lines(spark.createDataFrame(rows, "sheet string, row int, cells array<string>")).orderBy("row").collect()
    assert [(r.row, r.text) for r in got] == [(0, "Fees 2024"), (2, "Crane — 2023: 1,200; Unit cost: 3.5"), (3, "- — 2023: 7")]


def test_units_tile_the_text(spark):
    text = "head\nArticle 1 (a) see Article 2 too\nArticle 2 (b)\nrest\nArticle 3"
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, "")], "doc_id long, text string")
    spans = chunking.unit_spans(docs, r"^Article \d+").cache()
    got = [(r.unit, r.text) for r in spans.filter("doc_id = 1").orderBy("start").collect()]
    assert [u for u, _ in got] == [0, 1, 2, 3] and "".join(t for _, t in got) == text
    assert all(text[r.start : r.end] == r.text for r in spans.filter("doc_id = 1").collect())
    assert chunking.coverage(spans, docs).filter("not covered").count() == 0
    assert one(spark, chunking.numbered_breaks(F.lit("제1조 ① 가 ② 나 1. 하나 2. 둘"))) == "제1조\n① 가\n② 나\n1. 하나\n2. 둘"
    ids = chunking.ranged_ids(spark.createDataFrame([(1, 3), (7, 8)], "lo long, hi long"), spark.createDataFrame([(3,), (20,)], "id long"))
    assert sorted(r.id for r in ids.collect()) == [1, 2, 3, 7, 8, 20]
