"""Reading catalogs, chunks, snapshots, law JSON, answer runs and event streams.

Schemas are given, never inferred.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx

LOCATOR = (
    "struct<kind:string,char_start:long,char_end:long,article_label:string,table_index:int,"
    "source_refs:array<struct<kind:string,page_number:int,section:string,record_number:long,char_start:long,char_end:long>>>"
)
CHUNK = (
    "chunk_id string, doc_id string, document_version string, source_snapshot string, extraction_version string, chunking_version string, "
    "text_sha256 string, chunk_text_sha256 string, title string, source_url string, parent_source_url string, publisher string, fetched_at string, published_at string, "
    "updated_at string, effective_at string, date_status string, date_evidence string, section_titles array<string>, text string, "
    f"source_locator {LOCATOR}, review_status string, index_approved boolean, review_flags array<string>, chunk_kind string, form_title string, language string, parent_chunk_id string"
)


def catalog(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A catalog CSV, all columns text; a byte order mark before the header is dropped."""
    return spark.read.option("header", True).option("encoding", "UTF-8").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines of all files under a path, in the one chunk schema; fields that a producer lacks are null."""
    return spark.read.schema(CHUNK).json(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Raw files: path, length, content, sha256, format; the format by the first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), file_format(F.col("content")).alias("format"))


def file_format(content: Column) -> Column:
    """pdf, ole, hwpx, docx, xlsx, zip, html or unknown, by magic bytes and the names in a zip's beginning."""
    head, start = F.hex(F.substring(content, 1, 8)), F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    zipped = F.when(start.contains("hwp+zip"), "hwpx").when(start.contains("word/"), "docx").when(start.contains("xl/"), "xlsx").otherwise("zip")
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0A1B11AE1"), "ole").when(head.startswith("504B0304"), zipped)
        .when(F.lower(start).rlike(r"^\s*(<!doctype html|<html)"), "html").otherwise("unknown")
    )


def decoded_page(content: Column, second: str = "cp949") -> Column:
    """Page bytes as UTF-8, else in the second encoding (bytes that it lacks are replaced); only such pages go to Python."""

    @F.pandas_udf("string")
    def other(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(second, "replace"))

    good = F.is_valid_utf8(content.cast("string"))
    return F.coalesce(F.when(good, content.cast("string")), other(F.when(~good, content)))


def verified(files: DataFrame, metadata: DataFrame, blocked_hashes: DataFrame) -> DataFrame:
    """Files whose bytes match their metadata (path, content_sha256) and are not among blocked hashes (sha256)."""
    good = files.join(metadata, "path").filter(F.col("sha256") == F.col("content_sha256"))
    return good.join(blocked_hashes.select("sha256").distinct(), "sha256", "left_anti")


_HO = "array<struct<number:string,text:string,subitems:array<struct<number:string,text:string>>>>"
LAW = f"struct<serial:string,name:string,effective:string,articles:array<struct<number:string,title:string,text:string,deleted:boolean,paragraphs:array<struct<number:string,text:string,items:{_HO}>>>>>"


def as_list(json: str, path: str, element: str) -> Column:
    """A JSON value that is a list, or one element without its list, as an array; null if absent."""
    value = F.get_json_object(json, path)
    many = F.from_json(value, f"array<{element}>")
    one = F.array(F.from_json(value, element))
    return F.when(value.isNull(), None).when(value.startswith("["), many).otherwise(one)


def law_units(laws: DataFrame) -> DataFrame:
    """(serial, article, unit, text) of laws (a struct column ``law``): the article's text, then each
    paragraph with its items and sub-items on lines of their own.  Deleted articles are left out."""
    sub = lambda s: F.concat(F.lit("  "), s["text"])
    item = lambda i: F.concat(F.array(F.concat(F.lit(" "), i["text"])), F.coalesce(F.transform(i["subitems"], sub), F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    paragraph = lambda p: F.array_join(F.concat(F.array(p["text"]), F.coalesce(F.flatten(F.transform(p["items"], item)), none)), "\n")
    articles = laws.select("law.serial", F.explode("law.articles").alias("a")).filter(~F.coalesce(F.col("a.deleted"), F.lit(False)))
    units = F.concat(F.array(F.col("a.text")), F.coalesce(F.transform("a.paragraphs", paragraph), none))
    rows = articles.select("serial", F.col("a.number").alias("article"), F.posexplode(units).alias("unit", "text"))
    return rows.filter(F.col("text").isNotNull() & (tx.strip(F.col("text")) != ""))


def answer_runs(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The meta lines and the answers of run files; a line is meta if its field ``meta`` is true."""
    rows = spark.read.schema(f"meta boolean, {schema}").json(path)
    return rows.filter("meta"), rows.filter("not coalesce(meta, false)").drop("meta")


def questions(spark: SparkSession, path: str, schema: str, only: list[str] | None = None) -> DataFrame:
    """Evaluation questions; of repeated (id, question) one."""
    rows = spark.read.schema(schema).json(path)
    rows = rows.filter(F.col("id").isin(*only)) if only else rows
    return rows.dropDuplicates(["id", "question"])


def ndjson_tokens(streams: DataFrame) -> DataFrame:
    """Tokens of whole NDJSON streams (message_id, body): message_id, seq, token, done; lines that are no JSON object are left out."""
    rows = streams.select("message_id", F.posexplode(F.split("body", "\r?\n")).alias("seq", "line"))
    parsed = rows.withColumn("j", F.from_json("line", "struct<message:struct<content:string>,done:boolean>"))
    some = parsed.filter(F.col("j.message.content").isNotNull() | F.col("j.done").isNotNull())
    return some.select("message_id", "seq", F.coalesce("j.message.content", F.lit("")).alias("token"), F.coalesce("j.done", F.lit(False)).alias("done"))


def sse_events(streams: DataFrame) -> DataFrame:
    """Server-sent events of whole streams (message_id, body): message_id, seq, event, data.

    Any line end; comments are left out; data lines are joined; an event without a name is 'message',
    one without data none.  What follows the last blank line is unfinished and left out."""
    body = F.regexp_replace("body", "\r\n|\r", "\n")
    blocks = F.split(body, "\n\n+")
    done = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    rows = streams.select("message_id", F.posexplode(done).alias("seq", "block"))
    own = F.filter(F.split("block", "\n"), lambda x: ~x.startswith(":"))
    value = lambda name: F.transform(F.filter(own, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    events = rows.select("message_id", "seq", F.coalesce(F.get(F.reverse(value("event")), F.lit(0)), F.lit("message")).alias("event"), value("data").alias("d"))
    return events.filter(F.size("d") > 0).select("message_id", "seq", "event", F.array_join("d", "\n").alias("data"))
