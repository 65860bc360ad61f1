"""Operators on small tables, against loops and by their invariants."""

from __future__ import annotations

from collections import Counter

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import approval, chunking, conversation, evaluation, evidence, htmltables, index, quality, retrieval


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def packed_by_loop(title, text, most, more=" (cont.)"):
    room = max(most - len(title) - len(more) - 1, 1)
    pieces = []
    for line in text.split("\n"):
        pieces += [line[i : i + room] for i in range(0, len(line), room)] or [""]
    out, body = [], []
    head = lambda: title if not out else title + more
    for p in pieces:
        if body and len("\n".join([head(), *body, p])) > most:
            out.append("\n".join([head(), *body]))
            body = []
        body.append(p)
    if body and "".join(body).strip():
        out.append("\n".join([head(), *body]))
    return out


def test_pack_lines_is_the_loop(spark):
    rng = random.Random(1)
    texts = ["", "one", "x" * 205, "a\n\nb"] + ["\n".join("w" * rng.randint(0, 70) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    df = spark.createDataFrame([(i, f"Title {i}", t) for i, t in enumerate(texts)], "doc_id long, title string, text string")
    got = {}
    for r in chunking.packed_chunks(df, 100).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.text
    for i, t in enumerate(texts):
        want = packed_by_loop(f"Title {i}", t.removesuffix("\n"), 100)
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want
        assert all(len(x) <= 100 for x in want)


TITLE = r"^제\d+조\([^)]*\)"


def test_paragraph_parts(spark):
    long = "제5조(사용) 머리말\n① " + "가" * 500 + "\n② " + "나" * 500 + " ③ 끝"
    chunks = spark.createDataFrame(
        [("c1", "article", long), ("c2", "article", "제1조 ① a ② b"), ("c3", "table", long), ("c4", "article", "가" * 900)], "chunk_id string, chunk_kind string, text string"
    )
    got = rows(chunking.paragraph_parts(chunks, TITLE).select("chunk_id", "parent_chunk_id", "chunk_kind", "text"), "chunk_id")
    assert [r[0] for r in got] == ["c1#p1", "c1#p2", "c1#p3"] and {r[1] for r in got} == {"c1"} and {r[2] for r in got} == {"article_part"}
    assert all(r[3].startswith("제5조(사용)\n") for r in got) and got[2][3].endswith("③ 끝")
    assert chunking.with_parts(chunks, TITLE).count() == 7


def test_emitted_units_and_manifests(spark):
    units = spark.createDataFrame([("d", 0, "context_only", "x"), ("d", 1, "page", " "), ("d", 2, "page", "y" * 30), ("d", 3, "form", "y" * 30), ("e", 0, "page", None)], "doc_id string, unit int, chunk_kind string, text string")
    chunks, coverage = chunking.emitted(units, {"form": 50}, 20, ("context_only",))
    assert {(r.doc_id, r.unit): r.reason for r in coverage.collect()} == {("d", 0): "context only", ("d", 1): "blank", ("d", 2): "longer than 20", ("d", 3): None, ("e", 0): "blank"}
    assert [r.unit for r in chunks.collect()] == [3] and chunks.first().chunk_id.startswith("d-")
    got = {r.doc_id: (r.chunk_count, r.held_count, [tuple(x) for x in r.reasons]) for r in chunking.emit_manifest(coverage).collect()}
    assert got == {"d": (1, 3, [("blank", 1), ("context only", 1), ("longer than 20", 1)]), "e": (0, 1, [("blank", 1)])}
    laws = spark.createDataFrame([("1", "A"), ("2", "B")], "serial string, name string")
    parts = spark.createDataFrame([("1", "x", i, "w" * 30) for i in range(4)] + [("1", "y", 0, "w")], "serial string, article string, unit int, text string")
    own = {r.serial: tuple(r)[2:] for r in chunking.law_manifest(parts, chunking.law_chunks(parts, laws, 80), laws).collect()}
    assert own["1"][0] == 2 and own["1"][1] > 2 and own["1"][3] == ["x"] and own["2"] == (0, 0, 0, [])


def test_overlapping_is_the_loop(spark):
    rng = random.Random(2)
    spans = lambda n: [(d, i, s, s + rng.randint(1, 9000)) for d in range(2) for i, s in enumerate(rng.randint(0, 20000) for _ in range(n))]
    a, b = spans(15), spans(10)
    schema = "doc_id long, id long, start long, end long"
    got = set(rows(chunking.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))))
    want = {(d, i, j, max(s, u), min(t, v)) for d, i, s, t in a for e, j, u, v in b if d == e and max(s, u) < min(t, v)}
    assert got == want


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "abcdef"), (3, ""), (4, "abc")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 6), (2, 0, 3), (2, 4, 6)], "doc_id long, start long, end long")
    assert rows(chunking.coverage(spans, docs), "doc_id") == [(1, True), (2, False), (3, True), (4, False)]


def test_headings_and_groups(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["intro", "Chapter 1", "Section 1", "a", "Chapter 2", "b"])], "doc_id long, pos int, line string")
    got = rows(chunking.with_headings(lines, "^Chapter", "^Section").select("pos", "chapter", "section"), "pos")
    assert got[3][1:] == ("Chapter 1", "Section 1") and got[5][1:] == ("Chapter 2", None) and got[0][1:] == (None, None)
    table = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 2, 2), (1, 3, 3), (1, 4, 4)], "table_id long, row int, row_end int")
    assert [r[1] for r in rows(chunking.rowspan_groups(table).select("row", "row_group"), "row")] == [1, 2, 2, 2, 3]


def test_ruled_units(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["+---+", "| a  | b |", "|    |   |", "+---+", "| c |"])], "doc_id long, pos int, line string")
    assert rows(chunking.ruled_units(lines, r"^\+-", r"\|").select("unit", "text"), "unit") == [(1, "a b"), (2, "c")]


def test_citing_articles(spark):
    forms = spark.createDataFrame([("d", x) for x in ("1", "1-2", "10", "3")], "doc_id string, form string")
    articles = spark.createDataFrame([("d", "5", "see form 1-2 and form 10"), ("d", "6", "form 1 is needed")], "doc_id string, article string, text string")
    assert rows(chunking.citing_articles(forms, articles, r"form (\d+(?:-\d+)?)").select("form", "articles"), "form") == [("1", ["6"]), ("1-2", ["5"]), ("10", ["5"]), ("3", [])]


POLICY = approval.SourcePolicy(
    allowed_hosts=("a.org",), blocked_paths=("/faq",), blocked_query={"id": ("7",)}, excluded_kinds=("old",), superseded={"d9": "d8"},
    flag_notes={"fine": None, "timed": "has a deadline"}, excluding_flags=("historical",),
)


@pytest.mark.parametrize(
    "url, blocked, admitted",
    [
        ("https://a.org/x", False, True), ("https://a.org/faq/1", True, False), ("https://a.org/%2566aq", True, False), ("https://a.org/FAQ", True, False), ("https://a.org/x?id=7", True, False),
        ("https://a.org/x?id=8&id=7", True, False), ("https://a.org/x?ID=7", True, False), ("http://a.org/x", False, False), ("https://b.org/x", False, False), ("https://u@a.org/x", False, False),
        ("https://a.org:8080/x", False, False), ("https://a.org/x#y", False, False), (None, False, False), ("not a url", False, False),
    ],
)
def test_urls(spark, url, blocked, admitted):
    r = spark.createDataFrame([(url,)], "u string").select(approval.blocked(F.col("u"), POLICY).alias("b"), approval.url_admitted(F.col("u"), POLICY).alias("a")).first()
    assert (r.b, r.a) == (blocked, admitted)


def chunk(i, **how):
    base = {"chunk_id": i, "doc_id": "d1", "source_url": "https://a.org/x", "chunk_kind": "page", "text": "t", "sha": None, "source_snapshot": "s1", "review_flags": [], "date_status": "known"} | how
    return tuple(base.values())


def test_decide(spark):
    cases = {
        "approved": {}, "approved_with_notes": {"review_flags": ["timed", "fine"]}, "excluded": {"source_url": "https://a.org/faq"}, "held": {"source_url": "https://z.org/x"},
        "excluded2": {"chunk_kind": "old"}, "excluded3": {"doc_id": "d9"}, "held2": {"text": " "}, "held3": {"sha": "x"}, "held4": {"source_snapshot": "s0"}, "held5": {"doc_id": "d2"},
        "held6": {"doc_id": "d3"}, "excluded4": {"review_flags": ["fine", "historical"]}, "held7": {"review_flags": ["new", "historical"]}, "approved_with_notes2": {"date_status": "conflicting"},
        "approved2": {"review_flags": None},
    }
    df = spark.createDataFrame(
        [chunk(k, **v) for k, v in cases.items()],
        "chunk_id string, doc_id string, source_url string, chunk_kind string, text string, sha string, source_snapshot string, review_flags array<string>, date_status string",
    ).withColumn("chunk_text_sha256", F.coalesce("sha", F.sha2("text", 256)))
    checks = spark.createDataFrame([("d1", "s1", True, ""), ("d9", "s1", True, ""), ("d2", "s1", None, ""), ("d3", "s1", False, "gone")], "doc_id string, latest_snapshot string, current boolean, detail string")
    got = {r.chunk_id: r for r in approval.decide(df, checks, POLICY).collect()}
    for name in cases:
        assert got[name].status == name.rstrip("0123456789"), name
    assert got["approved_with_notes"].notes == ["has a deadline"] and got["held6"].notes == ["gone"] and got["held7"].notes == ["unknown flag new"]


def test_ledger_expires(spark):
    chunks = spark.createDataFrame([("c", "d", "h")], "chunk_id string, doc_id string, chunk_text_sha256 string")
    ledger = spark.createDataFrame([("c", "approved", "h")], "chunk_id string, status string, chunk_text_sha256 string")
    at = lambda day: F.lit(datetime.datetime(2024, 1, day))
    assert rows(approval.apply_ledger(chunks, ledger, at(1), at(31), POLICY)) == [("c", "d", True, "approved")]
    with pytest.raises(Exception, match="too old"):
        approval.apply_ledger(chunks, ledger, at(1), F.lit(datetime.datetime(2024, 2, 1)), POLICY).collect()


def test_selected_stops_at_a_blocked_source(spark):
    schema = "chunk_id string, doc_id string, chunk_kind string, source_url string"
    good = spark.createDataFrame([("a", "d1", "page", "https://a.org/x"), ("b", "d1", "old", "https://a.org/x"), ("c", "d9", None, "https://a.org/x"), ("e", "d1", None, "https://a.org/x")], schema)
    kept, counts = approval.selected(good, POLICY)
    assert {r.chunk_id for r in kept.collect()} == {"a", "e"} and dict(rows(counts)) == {"kind": 1, "superseded": 1}
    with pytest.raises(Exception, match="blocked source"):
        approval.selected(spark.createDataFrame([("a", "d1", "page", "https://a.org/faq")], schema), POLICY)[0].collect()


def test_reuse_and_currentness(spark):
    schema = "chunk_id string, doc_id string, chunk_text_sha256 string"
    chunks = spark.createDataFrame([("a", "d1", "1"), ("b", "d1", "2"), ("c", "d2", "3")], schema)
    previous = spark.createDataFrame([("a", "1", "approved"), ("b", "9", "approved"), ("c", "3", "held")], "chunk_id string, chunk_text_sha256 string, status string")
    assert rows(approval.reusable(previous, chunks)) == [("d2",)]
    check = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(approval.page_current(F.col("a"), F.col("b"), r"views: \d+").alias("x")).first()["x"]
    assert check("t views: 1", "t views: 9").ok and check("t", "u").detail == "changed" and check("t", None).detail == "look-up failed"


def test_quality(spark):
    docs = spark.createDataFrame([(i, "en", f"menu\nown {i}\na | b") for i in range(5)] + [(9, "de", "menu\nx")], "doc_id long, lang string, text string")
    got = dict(rows(quality.without_repeated_lines(docs)))
    assert got[0] == "own 0\na | b" and got[9] == "menu\nx"
    images = spark.createDataFrame(
        [("a", "ko", "", "f", 900, 900, False, ""), ("b", "ko", "", "f", 900, 900, True, ""), ("c", "en", "", "f", 900, 900, False, ""), ("d", "ko", "", "", 0, 0, False, ""), ("e", "ko", "", "f", 10, 10, False, ""),
         ("f", "ko", "", "f", 900, 900, False, "가나다라마바사 abcdefg 1234567890"), ("g", "ko", "a long enough description", "f", 900, 900, False, ""), ("h", "ko", "icon of something nice", "f", 900, 900, False, "")],
        "sha256 string, lang string, alt string, file string, width int, height int, manual boolean, read string",
    )
    refs = spark.createDataFrame([("a", d) for d in (1, 2, 3, 3)] + [("g", 1)], "sha256 string, doc_id long")
    got = {r.sha256: (r.state, r.n_refs, r.wanted) for r in quality.image_states(images, refs, "icon").collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "repeated", "b": "manual", "c": "foreign", "d": "none", "e": "small", "f": "ocr", "g": "alt", "h": "none"}
    assert got["a"][1] == 4 and not got["d"][2] and got["h"][2]


def test_transcript_route(spark):
    of = lambda text, finish="stop", repeats=0, about="": spark.range(1).select(quality.transcript_route(F.lit(text), F.lit(finish), F.lit(repeats), F.lit(about), "^photo", "map", r"\[none\]").alias("x")).first()["x"].route
    assert [of("a text of more than twenty letters"), of("x" * 30, "length"), of("x" * 30, repeats=3), of("photo of a ship"), of("x" * 30, about="a map"), of("short")] == ["auto", "review", "review", "none", "review", "none"]


def test_conversation(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "How do I apply for a pass?"), (1, 1, "assistant", "For whom?"), (1, 2, "user", "a crew"), (1, 3, "assistant", "Here."), (1, 4, "user", "when?"), (1, 5, "user", None)],
        "conv_id long, turn long, role string, text string",
    )
    got = rows(conversation.effective_questions(turns).select("turn", "kind", "search_text"), "turn")
    assert [r[1] for r in got] == ["question", "choice", "follow_up", "follow_up"] and got[1][2] == "How do I apply for a pass?\na crew" and got[2][2] == "a crew\nwhen?"
    assert rows(conversation.with_history(turns, 2).select("turn", "n_history"), "turn") == [(0, 0), (2, 2), (4, 2), (5, 2)]
    assert rows(conversation.request_problems(turns)) == [(1, "empty text")]


def test_retrieval_caps_and_parts(spark):
    vectors = [("p", None, "d1", "other", 0.1), ("c", "p", "d1", "other", 0.9), ("q", None, "d1", "other", 0.8), ("r", None, "d1", "other", 0.7), ("l1", None, "d2", "law", 0.6), ("l2", None, "d3", "law", 0.5),
               ("l3", None, "d4", "law", 0.4), ("f1", None, "d5", "form", 0.3), ("f2", None, "d6", "form", 0.2), ("e", None, "d7", "other", 0.05)]
    chunks = spark.createDataFrame([(c, p, d, k, None, [x]) for c, p, d, k, x in vectors], "chunk_id string, parent_chunk_id string, doc_id string, kind string, language string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "qid long, vector array<float>")
    got = rows(retrieval.top_k(chunks, asked, retrieval.RetrievalConfig(k=6)).select("rank", "chunk_id", "part_id"), "rank")
    assert got == [(1, "p", "c"), (2, "q", None), (3, "l1", None), (4, "l2", None), (5, "f1", None), (6, "e", None)]
    many = retrieval.RetrievalConfig(k=6, broadcast_bytes=0)
    assert rows(retrieval.top_k(chunks, asked, many).select("rank", "chunk_id", "part_id"), "rank") == got
    wide = retrieval.top_k(chunks, asked, retrieval.RetrievalConfig(k=9), capped_kinds=False)
    assert wide.filter("kind = 'law'").count() == 3
    no_scores = retrieval.rerank(wide.withColumn("rerank", F.lit(None).cast("double")), retrieval.RetrievalConfig(k=6))
    assert [r[0] for r in rows(no_scores.select("chunk_id", "rank").orderBy("rank"))] == ["p", "q", "l1", "l2", "f1", "e"]


def test_scope_and_routes(spark):
    asked = spark.createDataFrame([(1, "passing ships"), (2, "TEU rules"), (3, "none")], "qid long, question string")
    rules = {"d30": ("TEU", "DWT"), "d28": ("passing",)}
    assert rows(asked.select("qid", retrieval.scope_exclusions(F.col("question"), rules)), "qid") == [(1, ["d30"]), (2, ["d28"]), (3, ["d28", "d30"])]
    assert asked.select(retrieval.scope_exclusions(F.lit(None).cast("string"), rules)).first()[0] == ["d28", "d30"]
    hits = spark.createDataFrame([(1, 0.6, "x"), (2, 0.3, "about teu")], "qid long, score double, evidence string")
    first = retrieval.route(asked, hits)
    assert {r.qid: r.route for r in first.collect()} == {1: "answer", 2: "answer", 3: "unknown"}
    second = spark.createDataFrame([(3, 0.7, "answer")], "qid long, top_score double, route string")
    assert {r.qid: (r.route, r.joined) for r in retrieval.two_stage(first, second).collect()} == {1: ("answer", False), 2: ("answer", False), 3: ("answer", True)}


def test_evaluation(spark):
    values = spark.createDataFrame([(float(i),) for i in range(1, 21)], "s double")
    r = evaluation.latency(values, "s", 5.0).first()
    assert r.p95 == 19.0 and r.share_within == 0.25
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "qid long, rank int")
    assert abs(evaluation.retrieval_scores(ranks).first()["mrr_at_5"] - 0.5) < 1e-12
    golden = spark.createDataFrame([(1, "A-1; A-2\n", "B-3-0123456789abcdef01234567#p2"), (2, None, None)], "qid long, docs string, chunks string")
    assert sorted(r.doc_id for r in evaluation.gold_items(golden).collect()) == ["A-1", "A-2", "B-3"]
    items = spark.createDataFrame(
        [("i", "g", "q", ["answer"], ["d1"], ["fee|cost"], ["no"], ["maybe"], None, ["f1"], ["f2"], "The cost.\n\nmaybe later", "answer", ["d2", "d1"], [], ["f1", "f3"])],
        "id string, grp string, question string, expect_type array<string>, expect_docs array<string>, must_mention array<string>, must_not_mention array<string>, must_not_lead array<string>, "
        "must_contact array<string>, forms_required array<string>, forms_allowed array<string>, answer string, answer_type string, top_docs array<string>, contacts array<string>, downloads array<string>",
    )
    checks = evaluation.answer_checks(items).first()["checks"]
    assert checks == {"type": True, "retrieval": True, "retrieval_at_1": False, "mention": True, "no_mention": True, "no_lead": True, "forms": False}
    runs = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], "config string, id long, answer string")
    assert rows(evaluation.compare_runs(runs, "answer"), "id") == [(1, "x", "y"), (2, "z", None)]
    with pytest.raises(ValueError, match="more than 1"):
        evaluation.compare_runs(runs, "answer", most=1)
    assert evaluation.every_nth(spark.range(13).withColumn("g", F.lit(1)), 6, "g", "id").count() == 3


def test_evidence(spark):
    refs = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("page_number")) for k, p in (("pdf_page", 5), ("pdf_page", 3), ("hwp", 1))))
    assert spark.range(1).select(evidence.page_span(refs).alias("x")).first()["x"] == "3-5"
    loc = lambda kind, titles, label, whole=False: spark.range(1).select(evidence.locator(F.lit(kind), F.array(*map(F.lit, titles)).cast("array<string>"), F.lit(label).cast("string"), F.lit("3"), F.lit(whole)).alias("x")).first()["x"]
    assert [loc("processed_text", ["A", "B"], None), loc("html_table", ["T"], None), loc("law_api", [], "Art. 5", True), loc("attachment", ["Old rules"], None), loc("attachment", [], "Art. 2")] == [
        "A · B", "T (table)", "Art. 5 · whole form", "Old rules · p. 3", "Art. 2 · p. 3"]
    answers = spark.createDataFrame([(1, "see [2] and [1]", "answer", [2, 3], ["pay", "none", "pay"]), (2, "", "unknown", [], []), (3, "[1]", "clarify", [1], ["pay"])], "qid long, answer string, answer_type string, forms array<int>, keys array<string>")
    hits = spark.createDataFrame([(1, 1, None, "page", "https://a", "Payment here"), (1, 2, "Form A", "whole_form", "https://b", ""), (1, 3, "Form B", "whole_form", "https://c", ""), (3, 1, "F", "whole_form", "https://d", "pay")], "qid long, rank int, form_title string, chunk_kind string, source_url string, evidence string")
    links = spark.createDataFrame([("pay", "Pay", "https://pay", "payment"), ("none", "None", "https://n", "absent"), ("main", "Main", "tel", "")], "key string, label string, url string, word string")
    assert rows(evidence.action_lists(answers, hits, links).select("qid", "place", "type", "label"), "qid", "place") == [(1, 1, "download", "Form A"), (1, 2, "link", "Pay"), (2, 1, "contact", "Main")]
    labels = spark.createDataFrame([("Pay", "fr", "Payer"), ("Pay", "en", "Pay now")], "label string, lang string, text string")
    one = spark.createDataFrame([("Pay",), ("Other",)], "label string")
    assert sorted(r.label for r in evidence.localized(one, labels, F.lit("fr")).collect()) == ["Other", "Payer"] and sorted(r.label for r in evidence.localized(one, labels, F.lit("de")).collect()) == ["Other", "Pay now"]
    duties = spark.createDataFrame([("A", 0, "tax", "1"), ("A", 1, "lead", "2"), ("B", 0, "tax", "3"), ("B", 1, "tax", "4")], "dept string, pos int, task string, phone string")
    assert rows(evidence.department_contacts(duties, "lead"), "dept") == [("A", "2", ["tax: 1", "lead: 2"]), ("B", "3", ["tax: 3, 4"])]
    assert {r.key for r in evidence.merge_contacts(spark.createDataFrame([("x1",), ("y1",)], "key string"), spark.createDataFrame([("x2",)], "key string"), "x").collect()} == {"y1", "x2"}
    with pytest.raises(Exception, match="more than one"):
        evidence.only_value(duties, "phone", "dept").collect()


def test_index_digest(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(200)], "chunk_id long, chunk_text_sha256 string")
    one = lambda df, r="r": rows(index.version_digest(df, r))[0]
    assert one(a) == one(a.orderBy(F.desc("chunk_id")).repartition(7)) and one(a)[0] == 200 and len(one(a)[1]) == 12
    assert one(a) != one(a, "s") and one(a) != one(a.filter("chunk_id <> 5")) and one(a.filter("false"))[0] == 0


def test_embed_encodes_once(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "chunk_id long, input string")
    known = spark.createDataFrame([("c", [9.0])], "t string, embedding array<float>").select(F.sha2("t", 256).alias("input_hash"), "embedding")
    got = {r.chunk_id: (r.reused, list(r.embedding)) for r in index.embed(chunks, known, lambda x: F.array(F.length(x).cast("float"), F.lit(1.0).cast("float"))).collect()}
    assert got == {1: (False, [3.0, 1.0]), 2: (False, [3.0, 1.0]), 3: (True, [9.0])}
    with pytest.raises(Exception, match="too many tokens"):
        chunks.select(index.token_guard(F.length("input"), 2, F.col("chunk_id"))).collect()


TABLE = """<p>x</p><table><!-- c --><tr><th>Name</th><th colspan=2>Fee</th></tr><tr><td rowspan=2>A&amp;B</td><td>1</td><td></td></tr>
<tr><td>2</td><td>3<script>no</script></td></tr><tr><td>C</td><td>4</td><td>5</td></tr></table><table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>"""


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.org/d/", TABLE + '<a href="f.pdf">the <b>file</b></a><img src="/i.png" alt="pic">'), (2, "https://a.org", None)], "page_id long, url string, html string")
    cells = htmltables.table_cells(pages).cache()
    assert rows(htmltables.grid_faults(cells).select("table", "fault")) == [(1, "gaps")]
    assert rows(htmltables.table_text(cells).filter("table = 0").select("row", "text"), "row") == [(1, "Name: A&B; Fee: 1"), (2, "Fee: 2; Fee: 3"), (3, "Name: C; Fee: 4; Fee: 5")]
    assert [r[1] for r in rows(htmltables.spanned_groups(cells).filter("table = 0").select("row", "row_group"), "row")] == [1, 2, 2, 3]
    links = htmltables.page_links(pages)
    assert set(rows(links.select("kind", "url", "label"))) == {("link", "https://a.org/d/f.pdf", "the file"), ("image", "https://a.org/i.png", "pic")}
    wanted = spark.createDataFrame([(1, "https://a.org/d/f.pdf"), (1, "https://a.org/g.pdf")], "parent_id long, url string")
    assert rows(htmltables.attested(wanted, links).select("url")) == [("https://a.org/d/f.pdf",)]


def test_heaps_that_caps_leave_short_are_answered_from_all_chunks(spark):
    """The nearest chunks are all of one document or parts of one unit, more than a heap holds; ties all over."""
    import random

    rng = random.Random(5)
    chunk = lambda i, parent, doc, x: (f"c{i:04}", parent, doc, rng.choice(["law", "form", "other"]), None, [x, 1.0])
    data = [chunk(i, "c0000" if i < 120 else None, "near" if i < 200 else f"d{i % 40}", 0.9 if i < 200 else rng.choice([0.1, 0.2, 0.3, 0.3])) for i in range(600)]
    chunks = spark.createDataFrame(data, "chunk_id string, parent_chunk_id string, doc_id string, kind string, language string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "qid int, vector array<float>")
    config = retrieval.RetrievalConfig(k=6)
    want = []
    for qid, vector in ((1, 1.0), (2, -1.0), (3, 0.0)):
        units = {}
        for cid, parent, doc, kind, _, e in data:
            key = (1.0 - float(np.float32(e[0])) * vector, parent or cid)
            units[key[1]] = min(units.get(key[1], (9.0,)), (key[0], cid, doc, kind))
        docs, kinds, out = Counter(), Counter(), []
        for dist, unit, cid, doc, kind in sorted((v[0], u, *v[1:]) for u, v in units.items()):
            docs[doc] += 1
            if docs[doc] <= config.per_doc:
                kinds[kind] += 1
                if kinds[kind] <= config.kind_caps.get(kind, config.k) and len(out) < config.k:
                    out.append((qid, len(out) + 1, unit, cid if cid != unit else None))
        want += out
    hits = retrieval.top_k(chunks, asked, config).select("qid", "rank", "chunk_id", "part_id")
    assert sorted(map(tuple, hits.collect())) == want
    for q in (1, 2, 3):
        one = retrieval.top_k(chunks, asked.filter(f"qid = {q}"), config, one=True).select("qid", "rank", "chunk_id", "part_id")
        assert sorted(map(tuple, one.collect())) == [w for w in want if w[0] == q]


def test_only_heaps_cross_the_shuffle(spark):
    chunks = spark.range(5000).select(F.col("id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("parent_chunk_id"), F.col("id").cast("string").alias("doc_id"), F.lit("other").alias("kind"), F.lit(None).cast("string").alias("language"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding")).repartition(4)
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "qid int, vector array<float>")
    hits = retrieval.top_k(chunks, asked)
    assert "WindowGroupLimit" in hits._jdf.queryExecution().executedPlan().toString() and hits.count() == 15
