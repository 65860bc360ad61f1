"""Corpus quality: boilerplate, duplicates, held-out content, images, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import bitmaps


def line_frequencies(documents: DataFrame, longest: int = 60) -> DataFrame:
    """(lang, line, n_docs) of lines shorter than ``longest``: in how many documents of a language each occurs."""
    own = F.array_distinct(F.filter(tx.lines(F.col("text")), lambda x: F.length(x) < longest))
    return documents.select("lang", F.explode(own).alias("line")).groupBy("lang", "line").agg(F.count(F.lit(1)).alias("n_docs"))


def without_repeated_lines(documents: DataFrame, least_docs: int = 5, longest: int = 60, spare: str = r"[|—]", bits: int = bitmaps.BITS) -> DataFrame:
    """(doc_id, text): without the lines that ``least_docs`` documents of the language have,
    but for those that match ``spare``.

    First hashes of short lines are counted in 2**bits buckets, once a document; a line whose bucket has fewer can't
    be in so many documents.  Only lines that may be are made rows: counted exactly, looked up, and joined in parts by
    salt.  The texts move once, to the positions that are dropped from them."""
    salts = 16
    place = lambda x: bitmaps.bucket(F.xxhash64("lang", x), bits)
    short = F.filter(tx.lines(F.col("text")), lambda x: F.length(x) < longest)
    buckets = documents.select(F.explode(F.array_distinct(F.transform(short, place))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    bitmap = bitmaps.of_buckets(buckets.filter(F.col("n") >= least_docs), "bucket", bits)
    numbered = F.transform(tx.lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    likely = F.filter(numbered, lambda e: (F.length(e["line"]) < longest) & bitmaps.may_hold(place(e["line"])))
    rows = bitmaps.asked(documents.select("doc_id", "lang", "text"), bitmap).select("doc_id", "lang", likely.alias("likely"))
    counted = rows.select("lang", F.explode(F.array_distinct(F.col("likely")["line"])).alias("line")).groupBy("lang", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    listed = rows.select("doc_id", "lang", F.explode("likely").alias("e")).select("doc_id", "lang", "e.pos", "e.line")
    candidates = listed.filter(~F.col("line").rlike(spare)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    repeated = counted.filter(F.col("n_docs") >= least_docs).select("lang", "line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dropped = candidates.join(repeated, ["lang", "line", "salt"], "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("dropped"))
    kept = F.filter(tx.lines(F.col("text")), lambda x, i: ~F.coalesce(F.array_contains("dropped", i), F.lit(False)))
    return documents.join(dropped, "doc_id", "left").select("doc_id", F.array_join(kept, "\n").alias("text"))


def first_occurrences(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """Of rows with one key the first in order; a null key is a key."""
    names = F.struct(*order)
    firsts = rows.select(key.alias("k"), names.alias("o")).groupBy("k").agg(F.min("o").alias("o"))
    return rows.withColumns({"_k": key, "_o": names}).join(firsts, F.col("_k").eqNullSafe(F.col("k")) & (F.col("_o") == F.col("o")), "left_semi").drop("_k", "_o")


def without_copies_of(rows: DataFrame, blocked: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose content hash is not among those of ``blocked``; hashes are compared, texts are not moved."""
    hashes = blocked.select(F.sha2(F.col(text), 256).alias("h")).filter("h is not null").distinct()
    return rows.withColumn("_h", F.sha2(F.col(text), 256)).join(hashes, F.col("_h") == F.col("h"), "left_anti").drop("_h")


def low_quality_counts(documents: DataFrame, policy: tx.ProsePolicy) -> DataFrame:
    """(reason, n): how many documents are no prose, by reason; 'kept' for the others."""
    reason = F.coalesce(tx.low_quality(F.col("text"), policy), F.lit("kept"))
    return documents.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def near_empty(text: Column, least: int = 30) -> Column:
    return tx.dense_length(F.coalesce(text, F.lit(""))) < least


def image_states(images: DataFrame, references: DataFrame, noise: str, repeated: int = 3, home: str = "ko", width: int = 300, height: int = 100) -> DataFrame:
    """The state of each image (sha256, lang, alt, file, width, height, manual, read): of its
    references (sha256, doc_id), ``n_refs`` counts all and ``n_docs`` documents.

    In this order: repeated, manual, foreign, none (no file), small, ocr, alt, none."""
    counts = references.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("doc_id").alias("n_docs"))
    small = (F.col("width") > 0) & ((F.col("width") < width) | (F.col("height") < height))
    good_alt = (F.length("alt") >= 15) & ~F.col("alt").rlike(noise)
    no_file = F.coalesce(F.col("file"), F.lit("")) == ""
    state = (
        F.when(F.coalesce("n_docs", F.lit(0)) >= repeated, "repeated").when(F.col("manual"), "manual").when(F.col("lang") != home, "foreign")
        .when(no_file, "none").when(small, "small").when(tx.good_transcript(F.coalesce("read", F.lit(""))), "ocr").when(good_alt, "alt").otherwise("none")
    )
    rows = images.join(counts, "sha256", "left").withColumn("state", state)
    return rows.withColumn("wanted", F.col("state").isin("ocr", "alt", "none", "foreign") & ~no_file)


def transcript_route(text: Column, finish: Column, repeats: Column, about: Column, decor: str, maps: str, gaps: str) -> Column:
    """(route, text) of a machine transcript: 'review' if cut or repeating or of a map, 'none' if decoration or
    under 20 characters, else 'auto'.  Lines of ``decor`` and what ``gaps`` matches are not in the text."""
    clean = lambda own: tx.strip(F.regexp_replace(F.array_join(F.filter(tx.lines(own), lambda x: ~x.rlike(decor)), "\n"), gaps, ""))
    routed = lambda name, kept="": F.struct(F.lit(name).alias("route"), (F.lit(kept) if isinstance(kept, str) else kept).alias("text"))
    judged = lambda own: tx.bound(clean(own), lambda kept: F.when(tx.dense_length(kept) < 20, routed("none")).otherwise(routed("auto", kept)))
    route = lambda own: F.when(own.rlike(decor), routed("none")).when(about.rlike(maps), routed("review")).otherwise(judged(own))
    return F.when((finish == "length") | (repeats >= 3), routed("review")).otherwise(tx.bound(tx.strip(text), route))


def once_in_order(documents: DataFrame, shortest: int = 4) -> DataFrame:
    """(doc_id, text, removed): each line once, the first; lines with fewer than ``shortest``
    characters besides white space always stay.  A null text stays null.  All within the row."""
    key = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    entry = lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("line"))
    first = lambda all_, e, j: (F.length(e["key"]) < shortest) | (j == 0) | (F.get(all_, j - 1)["key"] != e["key"])
    by_key = F.array_sort(F.transform(tx.lines(F.col("text")), entry))
    firsts = tx.bound(by_key, lambda all_: F.filter(all_, lambda e, j: first(all_, e, j)))
    in_order = lambda kept: F.array_sort(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["line"].alias("line"))))["line"]
    rows = documents.select("doc_id", "text", firsts.alias("firsts"))
    return rows.select("doc_id", F.array_join(in_order(F.col("firsts")), "\n").alias("text"), (F.size(tx.lines(F.col("text"))) - F.size("firsts")).cast("long").alias("removed"))


def image_inventory(images: DataFrame, files: DataFrame, read: DataFrame) -> DataFrame:
    """Images (sha256, lang, alt, file) with the size of their files (file, width, height; 0 if unknown)
    and what was read from them (sha256, read; '' if nothing)."""
    known = images.join(files, "file", "left").join(read, "sha256", "left")
    return known.select(*images.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height")), F.coalesce("read", F.lit("")).alias("read"))


def with_transcripts(images: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """(sha256, origin, text): of the sources, (name, (sha256, text)) by priority, the first with a text that is not blank."""
    rows, found = images.select("sha256").distinct(), []
    for name, texts in sources:
        rows = rows.join(texts.select("sha256", F.col("text").alias(f"_{name}")), "sha256", "left")
        found.append(F.when(tx.strip(F.col(f"_{name}")) != "", F.struct(F.lit(name).alias("origin"), F.col(f"_{name}").alias("text"))))
    return rows.select("sha256", F.coalesce(*found).alias("t")).select("sha256", "t.origin", "t.text")
