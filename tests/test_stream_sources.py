"""The event source: any cut of bytes, a stream that is stopped in mid-block and started again, and the batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import streams


def blocks(rng, n, end="\n"):
    """Server-sent events in any notation, and what they say."""
    raw, want = [], []
    for i in range(n):
        data = [rng.choice(["", "x", "é漢", f"v{i}", ": no comment", "a:b"]) for _ in range(rng.randint(0, 3))]
        name = rng.choice([None, "token", "done"])
        lines = [": note"] * rng.randint(0, 1) + ([f"event: {name}"] if name else []) + [rng.choice(["data: ", "data:"]) + d if not d.startswith(" ") else f"data: {d}" for d in data]
        rng.random()
        raw.append(end.join(lines or [": empty"]) + end * 2)
        if data:
            want.append((name or "message", "\n".join(data)))
    return "".join(raw).encode(), want


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_any_growth_gives_each_block_once(tmp_path, end):
    rng = random.Random(3)
    for case in range(25):
        raw, want = blocks(rng, 12, end)
        raw += b"data: cut"
        folder = tmp_path / f"{case}{len(end)}{ord(end[0])}"
        folder.mkdir()
        files = streams.Files({"path": str(folder), "partBytes": str(rng.choice((1, 40, 10**6)))})
        known, got = {}, []
        for cut in [*sorted(rng.sample(range(len(raw)), 6)), len(raw)]:
            (folder / "a.txt").write_bytes(raw[:cut])
            reader = streams._Stream(files)  # started again each time: nothing is kept but the offset
            end_ = reader.latestOffset() or known
            for part in reader.partitions(known, end_):
                got += [tuple(x) for x in files.read(part)]
            known = end_
        assert [g[2:] for g in got] == want and len({g[:2] for g in got}) == len(got), (case, raw)


def test_a_stream_is_stopped_in_mid_block_and_goes_on(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()

    def run():
        events = streams.message_files(spark, f"file://{source}", part_bytes=40, stream=True)
        q = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.event, r.data) for r in spark.read.parquet(out).collect()) if (tmp_path / "out").exists() and list((tmp_path / "out").glob("*.parquet")) else []

    (source / "m1.sse").write_text("event: token\ndata: one\n\nevent: token\ndata: tw")
    assert run() == [("token", "one")]
    assert run() == [("token", "one")]
    with (source / "m1.sse").open("a") as f:
        f.write("o\n\nevent: done\ndata: {}\n")
    (source / "m2.sse").write_text("data: other\n\n")
    assert run() == [("message", "other"), ("token", "one"), ("token", "two")]
    with (source / "m1.sse").open("a") as f:
        f.write("\n")
    want = [("done", "{}"), ("message", "other"), ("token", "one"), ("token", "two")]
    assert run() == want
    assert sorted((r.event, r.data) for r in streams.message_files(spark, f"file://{source}", part_bytes=1).collect()) == want


def test_lines_and_tokens(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"message":{"content":"a"},"done":false}\r\n\nno json\n{"done":true}\n{"message":{"content":"cut')
    token, done = streams.token_of(F.col("data"))
    rows = streams.message_files(spark, f"file://{tmp_path}", "lines").select("at", token.alias("t"), done.alias("d")).orderBy("at").collect()
    assert [(r.t, r.d) for r in rows] == [("a", False), (None, None), ("", True)]
    assert streams.message_files(spark, f"file://{tmp_path}/none").collect() == []
