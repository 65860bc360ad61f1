"""Queries that write and read: versions, appends, batches, files, catalogs, currentness."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import approval
from lodestone.plans.registry import query, read
from lodestone.sources import readers, sinks
from lodestone.sources.work import remove_at_exit, shared_folder


def _folder(spark: SparkSession) -> str:
    return remove_at_exit(spark, f"{shared_folder(spark)}/query-{uuid.uuid4().hex}")


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", F.sha2("text", 256).alias("chunk_text_sha256"))


@query("SELECT doc_id AS chunk_id, lang, sha256(text) AS chunk_text_sha256, 'written' AS first, 'existing' AS second FROM documents")
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version that is written once; the same contents again leave it as it is."""
    path, rows = _folder(spark), _narrow(spark, sf_dir)
    states = [sinks.write_once(rows, path, "lang"), sinks.write_once(rows.orderBy(F.desc("chunk_id")), path, "lang")]
    return sinks.read_version(spark, path).select("chunk_id", "lang", "chunk_text_sha256", F.lit(states[0]).alias("first"), F.lit(states[1]).alias("second"))


@query("SELECT CASE WHEN vec_id % 3 = 1 THEN 'v1' ELSE 'v2' END AS index_version, vec_id AS chunk_id, label FROM embeddings WHERE vec_id % 3 <> 1 OR label % 2 = 0")
def replaced_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two index versions of all vectors, one of which is replaced as a whole by its even labels; what no commit names is removed."""
    path, v = _folder(spark), F.col("vec_id")
    vectors = read(spark, sf_dir, "embeddings").select(F.when(v % 3 == 1, "v1").otherwise("v2").alias("index_version"), v.alias("chunk_id"), "label", "embedding")
    dim = vectors.select(F.size("embedding")).first()[0]
    sinks.replace_version(vectors.filter("index_version = 'v1'"), path, dim)
    sinks.replace_version(vectors.filter("index_version = 'v2'"), path, dim)
    sinks.replace_version(vectors.filter("index_version = 'v1' and label % 2 = 0"), path, dim)
    if sinks.remove_unnamed(spark, path, hours=0) != 1:
        raise RuntimeError("the replaced version has left other than one folder")
    return sinks.read_current(spark, path, verify=True).select("index_version", "chunk_id", "label")


@query("SELECT CAST(lang AS VARCHAR) AS lang, count(*) FILTER (doc_id % 2 = 0 OR lang <> 'en') AS n FROM documents GROUP BY lang HAVING n > 0")
def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions that are overwritten where new rows have them; others stay."""
    path, rows = _folder(spark), read(spark, sf_dir, "documents").select("doc_id", "lang")
    sinks.replace_partitions(rows, path, "lang")
    sinks.replace_partitions(rows.filter("lang = 'en' and doc_id % 2 = 0"), path, "lang")
    return spark.read.parquet(path).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log to which two runs append; what the first has done the second leaves out."""
    path, e = _folder(spark), read(spark, sf_dir, "events").select("event_id")
    first = e.filter("event_id % 2 = 0").withColumn("run", F.lit("first"))
    sinks.append_new(first.unionByName(first), path, "event_id")
    sinks.append_new(e.filter("event_id % 3 = 0").withColumn("run", F.lit("second")), path, "event_id")
    return spark.read.parquet(path).select("event_id", "run")


@query("SELECT batch, status, count(*) AS n FROM (SELECT 'b' || (doc_id % 2) AS batch, CASE WHEN length(text) > 500 THEN 'held' ELSE 'done' END AS status FROM documents) GROUP BY ALL")
def held_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by status; a batch that is run again replaces itself only."""
    path, d = _folder(spark), read(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(F.length("text") > 500, "held").otherwise("done").alias("status"))
    counts = [sinks.held_and_done(rows.filter(f"doc_id % 2 = {b[1]}"), path, b).withColumn("batch", F.lit(b)) for b in ("b0", "b1", "b0")]
    return counts[1].unionByName(counts[2]).select("batch", "status", "n")


@query("SELECT doc_id, lang, NULL::VARCHAR AS note FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, 'new' FROM documents WHERE doc_id % 2 = 1")
def evolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return sinks.evolved(d.filter("doc_id % 2 = 0").select("doc_id", "lang"), d.filter("doc_id % 2 = 1").select("doc_id", F.lit("new").alias("note")))


@query("SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'different' ELSE 'extra' END AS state FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0 OR doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR doc_id % 7 = 0)")
def stored_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a store that are missing, extra or different from what was written."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "source")
    k = F.col("key")
    expected = d.filter((k % 3 != 0) | (k % 5 != 0) & (k % 7 == 0))
    stored = d.filter(k % 5 != 0).withColumn("lang", F.when(k % 7 == 0, "xx").otherwise(F.col("lang")))
    return sinks.differences(stored, expected, "key")


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, lang AS language, CASE WHEN doc_id % 2 = 0 THEN lang || ',x' END AS titles, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS char_start, NULL::VARCHAR AS form_title FROM documents")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk lines of files in the one schema; fields that a producer lacks are null."""
    path, d = _folder(spark), F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        d.cast("string").alias("chunk_id"), "text", F.col("lang").alias("language"), F.when(d % 2 == 0, F.array("lang", F.lit("x"))).alias("section_titles"), F.struct(F.when(d % 3 == 0, d).alias("char_start")).alias("source_locator")
    )
    rows.write.json(path)
    return readers.chunks(spark, path).select("chunk_id", "text", "language", F.array_join("section_titles", ",").alias("titles"), F.col("source_locator.char_start").alias("char_start"), "form_title")


@query(
    """SELECT 'S-' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'only in the catalog' WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 = 0 THEN 'name,nation' WHEN s_suppkey % 3 = 0 THEN 'name' ELSE 'nation' END AS problem
FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 UNION ALL SELECT 'X-' || n_nationkey, 'only in the policy' FROM nation"""
)
def catalog_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog file with a byte order mark against the policy of its entries."""
    path, k = _folder(spark), F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S-"), k.cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"), k)
    s.select(F.col("id").alias("﻿id"), "name", "nation").write.option("header", True).csv(path)
    rows = readers.catalog(spark, path, ["id", "name", "nation"])
    own = s.filter(k % 10 != 0).select("id", F.when(k % 3 == 0, "other").otherwise(F.col("name")).alias("name"), F.when(k % 4 == 0, "99").otherwise(F.col("nation")).alias("nation"))
    extra = read(spark, sf_dir, "nation").select(F.concat(F.lit("X-"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("x").alias("name"), F.lit("x").alias("nation"))
    return approval.disagreements(rows, own.unionByName(extra), "id", "name", "nation")


@query(
    """WITH f AS (SELECT doc_id, text, ['pdf', 'ole', 'hwpx', 'docx', 'xlsx', 'zip', 'html', 'unknown'][CAST(doc_id % 8 + 1 AS INTEGER)] AS format FROM documents)
SELECT doc_id, format, CASE WHEN format = 'unknown' THEN text END AS text FROM f WHERE doc_id % 9 <> 0"""
)
def verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their first bytes, whose content is that of their metadata and not blocked; pages of text decoded."""
    d = F.col("doc_id")
    raw = lambda h, tail="": F.concat(F.unhex(F.lit(h)), F.encode(F.lit(tail), "UTF-8"))
    heads = (raw("255044462D"), raw("D0CF11E0A1B11AE1"), raw("504B0304", "mimetypeapplication/hwp+zip"), raw("504B0304", "word/document"), raw("504B0304", "xl/workbook"), raw("504B0304", "other"), F.encode(F.lit(" <!DOCTYPE html>"), "UTF-8"))
    content = F.encode("text", "UTF-8")
    for i, head in enumerate(heads):
        content = F.when(d % 8 == i, F.concat(head, F.encode(d.cast("string"), "UTF-8"))).otherwise(content)
    files = read(spark, sf_dir, "documents").select("doc_id", d.cast("string").alias("path"), content.alias("content")).withColumn("sha256", F.sha2("content", 256))
    metadata = files.select("path", F.when(d % 9 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("content_sha256"))
    blocked = read(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("sha256"))
    good = readers.verified(files, metadata, blocked)
    form = readers.file_format(F.col("content"))
    return good.select("doc_id", form.alias("format"), F.when(form == "unknown", readers.decoded_page(F.col("content"))).alias("text"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'q' || (doc_id % 50) AS question, 'r1' AS run FROM documents")
def answer_run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of answer runs with the meta line of their file, and questions that are repeated."""
    path, d = _folder(spark), F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(F.lit(None).cast("boolean").alias("meta"), d.cast("string").alias("id"), F.concat(F.lit("q"), (d % 50).cast("string")).alias("question"))
    rows.unionByName(rows).write.json(f"{path}/run")
    spark.range(1).select(F.lit(True).alias("meta"), F.lit("r1").alias("id"), F.lit("").alias("question")).coalesce(1).write.mode("append").json(f"{path}/run")
    meta, _ = readers.answer_runs(spark, f"{path}/run", "id string, question string")
    asked = readers.questions(spark, f"{path}/run", "id string, question string").filter("question <> ''")
    return asked.select("id", "question", F.lit(meta.first()["id"]).alias("run"))


# Currentness and selection.


@query(
    """SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'look-up failed' WHEN doc_id % 3 = 0 THEN 'changed' WHEN doc_id % 7 = 0 THEN 'not yet in force' WHEN doc_id % 11 = 0 THEN 'chunks of another date' ELSE 'same' END
  WHEN 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'look-up failed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'same' END
  WHEN 2 THEN CASE WHEN doc_id % 5 = 0 THEN 'look-up failed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'same' END
  ELSE CASE WHEN doc_id % 5 = 0 THEN 'look-up failed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'same' END END AS detail FROM documents"""
)
def current_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sources are as they were: laws, pages, files and tables, each in its own way."""
    d = F.col("doc_id")
    failed, changed = d % 5 == 0, d % 3 == 0
    today, late = F.lit("2024-06-01"), F.when(d % 7 == 0, "2025-01-01").otherwise("2024-01-01")
    law = approval.law_current(F.lit("s1"), late, F.when(~failed, F.when(changed, "s2").otherwise("s1")), late, F.array(late, F.when(d % 11 == 0, "2023-01-01").otherwise(late)), today)
    page = approval.page_current(F.concat("text", F.lit(" views: 1")), F.when(~failed, F.concat("text", F.when(changed, " more").otherwise(""), F.lit(" views: 99"))), r"views: \d+")
    file = approval.file_current(F.sha2("text", 256), F.when(~failed, F.sha2(F.concat("text", F.when(changed, "x").otherwise("")), 256)))
    rows_of = F.when(changed, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    none = F.array().cast("array<string>")
    table = approval.table_current(F.array(F.lit("a"), F.lit("b")), F.when(failed | (d % 2 == 1), none).otherwise(rows_of), F.when(~failed, rows_of))
    found = F.when(d % 4 == 0, law).when(d % 4 == 1, page).when(d % 4 == 2, file).otherwise(table)
    return read(spark, sf_dir, "documents").select("doc_id", found.alias("r")).select("doc_id", "r.detail")


@query("SELECT 'law ' || n_nationkey AS name, n_nationkey * 2 AS serial FROM nation")
def current_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the versions listed under a law's name the one that is in force; none or several stop the job."""
    k = F.col("n_nationkey")
    listed = read(spark, sf_dir, "nation").select(F.concat(F.lit("law "), k.cast("string")).alias("name"), F.explode(F.array(k * 2, k * 2 + 1)).alias("serial"))
    return approval.only_current(listed.withColumn("current", F.col("serial") % 2 == 0), "serial")


@query(
    """SELECT DISTINCT source AS doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)"""
)
def reusable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources all of whose chunks have a decision for the same text."""
    d = F.col("doc_id")
    chunks = read(spark, sf_dir, "documents").select(d.alias("chunk_id"), F.col("source").alias("doc_id"), F.sha2("text", 256).alias("chunk_text_sha256"))
    c = F.col("chunk_id")
    previous = chunks.filter(c % 194 != 0).select("chunk_id", F.when(c % 97 == 0, "other").otherwise(F.col("chunk_text_sha256")).alias("chunk_text_sha256"), F.lit("approved").alias("status"))
    return approval.reusable(previous, chunks)


SELECTION = approval.SourcePolicy(allowed_hosts=("a.org",), blocked_paths=("/faq",), excluded_kinds=("old",), superseded={"src1": "src2"})


@query(
    """SELECT CASE WHEN doc_id % 4 = 0 THEN 'kind' WHEN source = 'src1' THEN 'superseded' ELSE 'selected' END AS reason, count(*) AS n FROM documents GROUP BY 1"""
)
def index_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of an index, and how many are left out for which reason."""
    d = F.col("doc_id")
    chunks = read(spark, sf_dir, "documents").select(d.alias("chunk_id"), F.col("source").alias("doc_id"), F.when(d % 4 == 0, "old").otherwise("page").alias("chunk_kind"), F.concat(F.lit("https://a.org/"), d.cast("string")).alias("source_url"))
    kept, reasons = approval.selected(chunks, SELECTION)
    return reasons.unionByName(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("selected").alias("reason"), "n"))
