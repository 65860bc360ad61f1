"""Cases of the third round of findings."""

from __future__ import annotations

import pickle
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import pages as pg
from lodestone.functions import text as tx
from lodestone.llm import tables, toxicity
from lodestone.llm.textblocks import Block
from lodestone.operators import htmltables, index, nearest, retrieval
from lodestone.plans import layouts


def test_closed_references(spark):
    text = "a &amp; b&amp\nc &copy; &notit; &foo; &#65; &#x42; &#65 &amp;quot;"
    one = lambda closed: spark.range(1).select(pg.unescaped(F.lit(text), closed).alias("x")).first()["x"]
    assert one(True) == "a & b&amp\nc © &notit; &foo; A B &#65 &quot;"
    assert one(False) == "a & b&\nc © ¬it; &foo; A B A &quot;"
    body = pg.body_or_content(F.lit("<article>x &amp</article>"), "<article>", "</article>", "(.*)", least=1, closed=True)
    assert spark.range(1).select(body.alias("x")).first()["x"] == "x &amp"


def test_walk_ends_after_the_most_steps(spark):
    roots = spark.createDataFrame([(0,)], "page long")
    links = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    reached = lambda most: index.reachable(spark, roots, links, most=most).agg(F.count(F.lit(1)), F.max("depth")).first()
    assert tuple(reached(10)) == (11, 10)
    assert tuple(reached(0)) == (1, 0)


def test_cells_with_sources_need_no_join(spark):
    pages = spark.createDataFrame([(1, "é<table><tr><td>a<td>b &amp; c</td></tr></table>"), (2, "<p>"), (3, None)], "page_id long, html string")
    own = htmltables.page_cells(pages, sources=True)
    assert [(r.page_id, [(c.source, c.text, c.begin) for c in r.cells]) for r in own.collect()] == [(1, [("<td>a", "a", 12), ("<td>b &amp; c</td>", "b & c", 17)])]
    assert "Join" not in layouts.cell_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_pages_of_one_task_are_dealt(spark):
    pages = spark.range(0, 200, 1, 1).select(F.col("id").alias("page_id"), F.lit("<table><tr><th>h</th></tr><tr><td>v</td></tr></table>").alias("html"))
    cells = htmltables.table_cells(pages)
    assert cells.select(F.spark_partition_id()).distinct().count() > 1 and cells.count() == 400


@pytest.mark.parametrize(("docs", "mixed", "k", "caps"), [(7, False, 5, True), (7, False, 12, False), (150, True, 4, True), (150, False, 3, True), (400, True, 6, False)])
def test_blocks_of_units_are_the_loop(spark, docs, mixed, k, caps):
    rng = random.Random(docs + k)
    kinds = ["law", "form", "other"]
    data = []
    for i in range(500):
        doc = rng.randrange(docs)
        vector = [rng.choice([-1.0, 0.1, 0.3, 0.7, 1.5]) for _ in range(3)] if i % 3 else [rng.uniform(-1, 1) for _ in range(3)]
        data.append((i, i - 1 if i % 5 == 4 else None, f"d{doc}", kinds[rng.randrange(3) if mixed else doc % 3], rng.choice([None, "ko", "en"]), vector))
    data += [(900, None, "d1", "law", None, None), (901, None, "d1", "law", None, [1.0]), (902, None, "d1", "law", None, [1.0, float("nan"), 1.0])]
    asked = [(q, [rng.uniform(-1, 1) for _ in range(3)], rng.choice([None, ["d1", "d2"]]), rng.choice([None, [str(q), "3"]]), rng.choice([None, ["en"]])) for q in range(0, 60, 2)]
    config = retrieval.RetrievalConfig(k=k, block_chunks=90, block_questions=11)
    want = []
    for q, v, no_docs, no_chunks, langs in asked:
        units = {}
        for cid, parent, doc, kind, lang, e in data:
            if e is None or len(e) != 3 or np.isnan(e).any() or doc in (no_docs or ()) or str(cid) in (no_chunks or ()) or (langs and (lang or "ko") not in langs):
                continue
            total = 0.0
            for x, y in zip(np.float32(e), np.float32(v)):
                total += float(x) * float(y)
            unit = cid if parent is None else parent
            units[unit] = min(units.get(unit, (9e9,)), (1.0 - total, cid, doc, kind))
        of_doc, of_kind, rank = Counter(), Counter(), 0
        for dist, unit, cid, doc, kind in sorted((b[0], u, *b[1:]) for u, b in units.items()):
            of_doc[doc] += 1
            if of_doc[doc] <= config.per_doc and rank < k:
                of_kind[kind] += 1
                if not caps or of_kind[kind] <= config.kind_caps.get(kind, k):
                    rank += 1
                    want.append((q, rank, unit, cid if cid != unit else None, 1 - dist))
    chunks = spark.createDataFrame(data, "chunk_id long, parent_chunk_id long, doc_id string, kind string, language string, embedding array<float>")
    questions = spark.createDataFrame(asked, "qid long, vector array<float>, excluded_docs array<string>, excluded_chunks array<string>, languages array<string>")
    hits = retrieval.top_k(chunks, questions, config, capped_kinds=caps).select("qid", "rank", "chunk_id", "part_id", "score")
    assert sorted(map(tuple, hits.collect())) == want


def test_pairs_are_no_rows(spark):
    """What crosses the shuffle is few units of a document for each block, not each pair or a heap of a thousand."""
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.col("id").alias("unit"), (F.col("id") % 300).alias("doc_id"), F.lit("x").alias("kind"), F.lit("ko").alias("language"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    none = F.lit(None).cast("array<string>")
    asked = spark.range(20).select(F.col("id").alias("qid"), F.array(F.lit(1.0), F.rand(3)).alias("q_vector"), none.alias("q_excluded"), none.alias("q_chunks"), none.alias("q_languages"))
    assert nearest.near_units(chunks, asked, 2, 5, True).count() <= 20 * 2 * 16


def test_f4_every_labelled_text_is_learnt_from(spark):
    """Words that only few labelled texts have are known however few texts a shard has."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    bad = [f"zq{a}{b}x" for a in "bcdfghjk" for b in "aeiou"]
    texts = []
    for i in range(3000):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 20))] + ["the", "of"]
        if i % 3 == 0:
            words[rng.randrange(5)] = bad[i // 3 % len(bad)]
        texts.append((i, " ".join(words), int(i % 3 == 0)))
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int").cache()
    how = toxicity.ConvFit(sample=600)
    net = toxicity.train_toxicity(table.drop("toxic"), table.select("doc_id", "toxic"), how=how)
    data = np.frombuffer(" ".join(bad).encode(), np.uint8)
    whole = toxicity.word_ids(Block(0, data, np.array([0, len(data)])), how.buckets)[0]
    assert (net.rows[0][whole] > 0).all()
    scored = toxicity.toxicity_scores(table, net, "toxic").toPandas()
    held = scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert (scored.predicted == scored.toxic)[held].mean() > 0.95
    again = toxicity.train_toxicity(table.drop("toxic").repartition(7), table.select("doc_id", "toxic").repartition(3), how=how)
    assert (again.out == net.out).all() and (again.shift == net.shift).all() and all((a == b).all() for w in net.tables for x, y in zip(net.tables[w], again.tables[w]) for a, b in zip(x, y))


def test_op10_what_is_sent_is_small(spark):
    """A trained network is sent as embeddings and filters, and gives what its tables give; Arrow batches of texts are bounded in bytes."""
    how, known, rng = toxicity.ConvFit(buckets=1 << 12), (3000, 2000), np.random.default_rng(8)
    index = tuple((np.arange(how.buckets) % k).astype(np.int32) for k in known)
    net = toxicity.TrainedNetwork(toxicity._views(toxicity._first_state(known, how), known, how), index, how)
    tables = toxicity.Network(net.tables, net.bias, net.rows, net.out, net.offset, net.shift, net.buckets)
    assert len(pickle.dumps(net)) < len(pickle.dumps(tables)) / 4
    counts = np.array([0, 1, 2, 9000, 40])
    whole, begin = (rng.integers(0, how.buckets, counts.sum()) for _ in range(2))
    assert np.allclose(net.maxima(whole, begin, counts), tables.maxima(whole, begin, counts), atol=1e-5)
    texts = spark.range(0, 12_000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    toxicity.without_toxic(texts, net)
    got = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert max(r.n for r in got) < 2 * 4 << 20


def test_op10_packed_texts_are_read_in_small_parts(spark):
    """No row of packed texts and no page of their files is large, all words are there, and the reader's batches have few rows."""
    rng, n = np.random.default_rng(9), 200
    texts = spark.createDataFrame([(0, i % 15, i % 2, " ".join(f"w{k}" for k in rng.integers(0, 300_000, 900))) for i in range(n)], "shard int, part int, label int, text string")
    index = spark.sparkContext.broadcast(tuple(np.arange(1 << 19, dtype=np.int32) for _ in range(2)))
    scratch = tables.Scratch(spark, "packed")
    rows = scratch.cut(toxicity._packed(toxicity._hashed(texts.coalesce(1), 1 << 19), index), **toxicity._WRITTEN)
    got = rows.collect()
    assert max(len(r.ids) for r in got) < 256 << 10 and sum(np.frombuffer(r.n, "<i8").sum() for r in got) == 900 * n
    files = [pq.ParquetFile(f).metadata for f in Path(scratch.paths[0].removeprefix("file:")).glob("*.parquet")]
    assert {f.row_group(0).column(5).compression for f in files if f.num_rows} == {"UNCOMPRESSED"}
    scratch.clear()
    tables.bound_batches(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    with tables.read_rows(spark, 16):
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "16"
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512"


def test_f15_markup_in_steps(spark):
    """Texts made in steps are those of the expression; what html.escape has written is not decoded by Python, and markup is taken out once."""
    bits = ["<p>", "</p>", "<br>", "<li>", "</td><td>", "<b>", "&amp;", "&lt;", "&gt;", "&quot;", "&#x27;", "&amp;lt;", "&nbsp;", "&#10;", "&copy", "&", "a", "b c", " ", "\n", "\t", "\u2028", "\x1c", "<!-- x -->", "<img alt=\"i\">"]
    rng = random.Random(15)
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(3000)] + [(3000, None)]
    texts = spark.createDataFrame(rows, "page_id long, html string").cache()

    def lines(x: Column) -> Column:
        return F.array_join(F.filter(F.transform(F.split(x, "\n"), tx.squeeze), lambda y: y != ""), "\n")

    for closed in (False, True):
        plain = pg.unescaped(pg._unmarked(F.col("html")), closed)
        want = {r.page_id: (r.x, r.y) for r in texts.select("page_id", lines(plain).alias("x"), pg.markup_text(F.col("html"), closed).alias("y")).collect()}
        got = {r.page_id: (r.html, r.html) for r in pg.markup_texts(texts, "html", closed).collect()}
        assert got == want
    pages = spark.range(10).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>x &amp; y</p><table><tr><td>"), F.col("id").cast("string"), F.lit("</td></tr></table>")).alias("html"))
    plan = htmltables.text_with_tables(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<img") == 1
