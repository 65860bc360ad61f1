"""Readers, sinks, stream filters and stream windows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import commits, readers, sinks
from lodestone.streaming import events, filters


def test_write_once(spark, tmp_path):
    path = f"file://{tmp_path}/v1"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    assert sinks.write_once(a, path) == "written" and sinks.write_once(a.orderBy(F.desc("id")), path) == "existing"
    with pytest.raises(sinks.VersionConflict):
        sinks.write_once(a.filter("id = 1"), path)
    assert sinks.read_version(spark, path).count() == 2
    a.write.mode("append").parquet(commits.read_json(spark, f"{path}/manifest.json")["folder"])
    with pytest.raises(sinks.VersionConflict):
        sinks.read_version(spark, path)
    with pytest.raises(sinks.VersionConflict):
        sinks.read_version(spark, f"file://{tmp_path}/none")


def test_replace_version(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    v = lambda version, n: spark.createDataFrame([(version, i, [1.0, 2.0]) for i in range(n)], "index_version string, chunk_id long, embedding array<float>")
    sinks.replace_version(v("a", 3), path, 2)
    sinks.replace_version(v("b", 2), path, 2)
    sinks.replace_version(v("a", 1), path, 2)
    now = lambda: {r["index_version"]: r["count"] for r in sinks.read_current(spark, path, verify=True).groupBy("index_version").count().collect()}
    assert now() == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="components"):
        sinks.replace_version(v("a", 1), path, 3)
    assert now() == {"a": 1, "b": 2}  # a job that fails changes nothing
    folder = commits.latest(spark, f"{path}/commits")[1]["b"]["folder"]
    v("b", 9).write.mode("append").partitionBy("index_version").parquet(folder)
    with pytest.raises(sinks.VersionConflict):
        now()


def test_two_writers_at_once_both_end(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's reading and putting; then many writers in threads."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/index"
    v = lambda version, n: spark.createDataFrame([(version, i, [1.0]) for i in range(n)], "index_version string, chunk_id long, embedding array<float>")
    put, seen = commits.put_if_absent, []

    def late(session, file, content):
        if not seen and file.endswith("01.json"):
            seen.append(file)
            sinks.replace_version(v("b", 5), path, 1)
        return put(session, file, content)

    monkeypatch.setattr(commits, "put_if_absent", late)
    assert sinks.replace_version(v("a", 3), path, 1) == 2 and seen
    monkeypatch.setattr(commits, "put_if_absent", put)
    with ThreadPoolExecutor(6) as pool:
        got = sorted(pool.map(lambda i: sinks.replace_version(v(f"t{i % 3}", i + 1), path, 1), range(6)))
    assert got == [3, 4, 5, 6, 7, 8] == commits.numbers(spark, f"{path}/commits")[2:]
    now = {r["index_version"]: r["count"] for r in sinks.read_current(spark, path, verify=True).groupBy("index_version").count().collect()}
    assert now["a"] == 3 and now["b"] == 5 and all(now[f"t{i}"] in (i + 1, i + 4) for i in range(3))
    assert sinks.remove_unnamed(spark, path) == 0 and len(commits.numbers(spark, f"{path}/commits")) == 1  # younger than a day
    assert sinks.remove_unnamed(spark, path, hours=0) == 3
    assert {r["index_version"]: r["count"] for r in sinks.read_current(spark, path, verify=True).groupBy("index_version").count().collect()} == now


def test_one_of_two_first_writers_has_written(spark, tmp_path, monkeypatch):
    path, rows = f"file://{tmp_path}/once", spark.range(5)
    put, states = commits.put_if_absent, []

    def late(session, file, content):
        if not states:
            states.append("")
            states[0] = sinks.write_once(rows, path)
        return put(session, file, content)

    monkeypatch.setattr(commits, "put_if_absent", late)
    assert sinks.write_once(rows, path) == "existing" and states == ["written"]
    assert sinks.read_version(spark, path).count() == 5
    with pytest.raises(sinks.VersionConflict):
        sinks.write_once(spark.range(6), path)


def test_append_feedback_differences(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = lambda *x: spark.createDataFrame([(i, "t") for i in x], "id long, t string")
    sinks.append_new(rows(1, 2, 2), path, "id")
    sinks.append_new(rows(2, 3), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    logs = spark.createDataFrame([("m1",), ("m2",)], "message_id string")
    given = spark.createDataFrame([("m1", "up", 1), ("m1", "down", 2), ("m9", "up", 1)], "message_id string, rating string, ts long")
    known, lost = sinks.with_feedback(logs, given)
    assert {r.message_id: r.rating for r in known.collect()} == {"m1": "down", "m2": None} and [r.message_id for r in lost.collect()] == ["m9"]
    b = spark.createDataFrame([(1, "t"), (2, "u"), (4, "t")], "id long, t string")
    assert {r.id: r.state for r in sinks.differences(rows(1, 2, 3), b, "id").collect()} == {2: "different", 3: "extra", 4: "missing"}
    assert sinks.evolved(rows(1), spark.createDataFrame([(2, 5)], "id long, n int")).columns == ["id", "t", "n"]
    batch, where = spark.createDataFrame([(1, "done"), (2, "held")], "id long, status string"), f"file://{tmp_path}/batch"
    for name in ("one", "two"):
        assert {r.status: r.n for r in sinks.held_and_done(batch, where, name).collect()} == {"done": 1, "held": 1}
    assert spark.read.parquet(where).count() == 4
    with pytest.raises(sinks.HeldRows):
        sinks.held_and_done(batch, where, "one", stop=True)
    with pytest.raises(Exception, match="(?i)parquet"):  # a damaged table is no table that begins now
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "x.parquet").write_text("no parquet")
        sinks.append_new(rows(1), f"file://{tmp_path}/bad", "id")


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿doc_id,source_url\na,https://x\na,https://y\n", encoding="utf-8")
    table = readers.catalog(spark, f"file://{tmp_path}/c.csv", ["doc_id", "source_url"])
    assert [r.n for r in readers.repeated_keys(table, "doc_id").collect()] == [2]
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "chunks.jsonl").write_text(json.dumps({"chunk_id": "1", "doc_id": "d", "text": "t", "source_locator": {"kind": "law_api", "article_label": "5"}, "other": 1}))
    r = readers.chunks(spark, f"file://{tmp_path}/chunks").first()
    assert r.source_locator.article_label == "5" and r.language is None
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.hwp": bytes.fromhex("D0CF11E0A1B11AE1"), "c.docx": b"PK\x03\x04 word/document.xml", "d.html": b" <!DOCTYPE html><p>", "e.bin": b"\x00"}.items():
        (raw / name).write_bytes(data)
    files = readers.snapshots(spark, f"file://{raw}")
    assert {r.path[-6:].split("/")[-1][0]: r.format for r in files.select("path", "format").collect()} == {"a": "pdf", "b": "ole", "c": "docx", "d": "html", "e": "unknown"}
    meta = files.select("path", F.when(F.col("format") == "pdf", F.lit("wrong")).otherwise(F.col("sha256")).alias("content_sha256"))
    assert readers.verified(files, meta, files.filter("format = 'ole'").select("sha256")).count() == 3
    page = spark.createDataFrame([("가".encode("euc-kr"),), ("가".encode(),)], "c binary").select(readers.decoded_page(F.col("c")).alias("t"))
    assert [r.t for r in page.collect()] == ["가", "가"]


def test_law_units(spark):
    law = {"serial": "7", "articles": [{"number": "1", "text": "Article 1", "deleted": False, "paragraphs": [{"text": "(1) p", "items": [{"text": "1. i", "subitems": [{"text": "a. s"}]}]}]}, {"number": "2", "text": "gone", "deleted": True}, {"number": "3", "text": "Article 3"}]}
    df = spark.createDataFrame([(json.dumps(law),)], "j string").select(F.from_json("j", readers.LAW).alias("law"))
    assert [(r.article, r.text) for r in readers.law_units(df).orderBy("article", "unit").collect()] == [("1", "Article 1"), ("1", "(1) p\n 1. i\n  a. s"), ("3", "Article 3")]
    lists = spark.createDataFrame([('{"a":{"x":1}}',), ('{"a":[{"x":1},{"x":2}]}',), ("{}",)], "j string").select(readers.as_list("j", "$.a", "struct<x:int>").alias("a"))
    assert [None if r.a is None else [y.x for y in r.a] for r in lists.collect()] == [[1], [1, 2], None]


def test_answer_runs_and_questions(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text('{"meta": true, "id": "m"}\n{"id": "a", "question": "q"}\n{"id": "a", "question": "q"}\n{"id": "b", "question": "r"}\n')
    meta, answers = readers.answer_runs(spark, f"file://{tmp_path}/run.jsonl", "id string, question string")
    assert meta.count() == 1 and answers.count() == 3
    assert readers.questions(spark, f"file://{tmp_path}/run.jsonl", "id string, question string", only=["a"]).count() == 1


SSE = ": hello\n\nevent: token\r\ndata: a\r\ndata:b\r\n\r\ndata: plain\n\nevent: empty\n\nevent: done\ndata: {}\n\ndata: cut"


def test_sse(spark):
    got = [(r.event, r.data) for r in readers.sse_events(spark.createDataFrame([("m", SSE)], "message_id string, body string")).orderBy("seq").collect()]
    want = [("token", "a\nb"), ("message", "plain"), ("done", "{}")]
    assert got == want


ANSWER = (
    "---\nFees [1] are in [evidence] and [20].\n - - -\n* item -- [2]\n___\nCall 061-123-4567 or 02-999-8888, mail x@y.org, see https://ok.org/a [x] [12 [3]\n@@ME no\n--"
    "\nforms: [1]\n@@META {\"a\": 1}"
)
EVIDENCE = "call 061-123-4567, https://ok.org/a"


def cut(text, rng):
    out, at = [], 0
    while at < len(text):
        n = rng.choice((1, 1, 2, 3, 5, 8, 40))
        out.append(text[at : at + n])
        at += n
    return out


CONFIG = filters.FilterConfig(
    markers=("@@META", "\nforms:", "\ntype:"), labels=(("[evidence]", "the official sources"),), contact=r"https?://[!-(*-\[^-~]+|[a-z.]+@[a-z.]+[a-z]|0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}"
)


def run_chain(pieces, config=CONFIG):
    chain = filters.Chain(config, 3, EVIDENCE)
    return "".join(chain.push(p) for p in pieces) + chain.end(), chain.trailer


def test_filters_do_not_depend_on_fragments():
    whole = run_chain([ANSWER])
    assert whole[0] == (
        "Fees [1] are in the official sources and .\n* item -- [2]\nCall 061-123-4567 or (see the official notice), mail (see the official notice), see https://ok.org/a [x] [12 [3]\n@@ME no\n--"
    ) and whole[1].startswith("\nforms:")
    rng = random.Random(4)
    for _ in range(300):
        assert run_chain(cut(ANSWER, rng)) == whole


def test_what_is_held_is_bounded_and_can_be_stored():
    config = filters.FilterConfig(markers=("@@",), contact="x@y", longest_rule=10, longest_word=20, longest_trailer=30)
    chain = filters.Chain(config, 1, "")
    out = "".join(chain.push(p) for p in ["-" * 50, "a" * 5000, " x@y ", "b" * 15, "@@" + "t" * 900, "t" * 900])
    assert out + chain.end() == "-" * 50 + "a" * 5000 + " (see the official notice) " + "b" * 15 and len(chain.trailer) == 30
    for text in ("-" * 500, "a" * 500, "[" * 500, "\n" * 500):
        chain = filters.Chain(config, 1, "")
        chain.push(text)
        assert sum(len(s.held) for s in chain.steps) < 60
    rng, (text, trailer) = random.Random(6), run_chain([ANSWER])
    for _ in range(50):
        chain, out = filters.Chain(CONFIG, 3, EVIDENCE), ""
        for p in cut(ANSWER, rng):
            chain = filters.Chain(CONFIG, 3, EVIDENCE).restore(chain.state())
            out += chain.push(p)
        assert (out + chain.end(), chain.trailer) == (text, trailer)


def test_steps_are_the_expressions(spark):
    """Any text gives in fragments what the column expressions give for the whole."""
    rng = random.Random(8)
    words = ["a", " ", "\n", "-", "- -", "***", "___", "[1]", "[9]", "[", "12]", "[evid", "[evidence]", "x@y.org", "061-123-4567", "02-999-8888.", "https://ok.org/a)", "@@", "@@META", "\nforms:", "é가", "\t"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["x" * 2500 + "02-999-8888", "-" * 300]
    rows = spark.createDataFrame([(str(i), 0, t, 3, EVIDENCE) for i, t in enumerate(texts)], "message_id string, seq long, fragment string, n_sources int, evidence string")
    got = {int(r.message_id): (r.text, r.trailer) for r in filters.filtered(rows, CONFIG).collect()}
    for i, t in enumerate(texts):
        assert got[i] == run_chain(cut(t, rng)) == run_chain([t]), t


def test_held_text_comes_out_at_the_end():
    for text in ("ends with @@MET", "ends with [1", "ends with [evid", "a\n--", "word", "", "\n"):
        assert run_chain(list(text))[0] == text


def fragments(spark, seed=5):
    rng = random.Random(seed)
    out = []
    for m in range(6):
        pieces = cut(ANSWER + str(m), rng)
        out += [(f"m{m}", i, p, i == len(pieces) - 1, 3, EVIDENCE) for i, p in enumerate(pieces)]
    return spark.createDataFrame(out, "message_id string, seq long, fragment string, last boolean, n_sources int, evidence string")


def test_filtered_batch(spark):
    want = {f"m{m}": run_chain([ANSWER + str(m)]) for m in range(6)}
    assert {r.message_id: (r.text, r.trailer) for r in filters.filtered(fragments(spark), CONFIG).collect()} == want


def test_filtered_stream(spark, tmp_path):
    rows = fragments(spark)
    source = f"file://{tmp_path}/in"
    for part in range(3):
        rows.filter(f"seq div 20 = {part}" if part < 2 else "seq div 20 >= 2").coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(source)
    out = filters.filtered_stream(stream, CONFIG)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").option("path", f"file://{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got: dict[str, list] = {}
    for r in spark.read.parquet(f"file://{tmp_path}/out").orderBy("seq").collect():
        got.setdefault(r.message_id, []).append(r)
    for m in range(6):
        text, trailer = run_chain([ANSWER + str(m)])
        assert "".join(r.text for r in got[f"m{m}"]) == text and got[f"m{m}"][-1].trailer == trailer


def test_windows_as_a_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = events.tumbling(stream, "1 day", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.start, r.event_type)
    got = {key(r): r.n for r in spark.table("windows").collect()}
    assert got == {key(r): r.n for r in events.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 day", "event_type").collect()}
    assert events.sliding(spark.read.parquet(f"{sf_dir}/events.parquet"), "2 days", "1 day").agg(F.sum("n")).first()[0] == 2000


def test_times(spark):
    t = spark.createDataFrame([("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02"), ("a", "2024-01-01 00:00:04")], "message_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = spark.createDataFrame([("a", "2024-01-01 00:00:00")], "message_id string, asked_at string").withColumn("asked_at", F.col("asked_at").cast("timestamp"))
    assert tuple(events.answer_times(t, asked).first()) == ("a", 1.0, 4.0)
