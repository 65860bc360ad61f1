"""Queries over texts: languages, sources, dates, titles, transcripts, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import pages as pg
from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import evidence, index, quality, retrieval
from lodestone.plans.registry import query, read
from lodestone.sources import readers

_STRIP = r"E' \t\r\n'"


def _count(chars: str) -> str:
    return f"length(regexp_replace(x, '[^{chars}]', '', 'g'))"


#: Letters of texts as those of another script, by the length of a text modulo 5.
_OTHER_SCRIPTS = {1: ("aeioutn", "가나다라마바사"), 2: ("aeiou", "アイウエオ"), 3: ("aeioustr", "日月水火木金土人"), 4: ("ae", "가나")}
_MADE = "CASE length(text) % 5 " + " ".join(f"WHEN {k} THEN translate(text, '{a}', '{b}')" for k, (a, b) in _OTHER_SCRIPTS.items()) + " ELSE text END"


@query(
    rf"""WITH q AS (SELECT conv_id, turn, {_MADE} AS x FROM conversations WHERE role = 'user'),
n AS (SELECT *, {_count('가-힣ㄱ-ㆎ')} AS h, {_count('぀-ヿㇰ-ㇿ')} AS k, {_count('一-鿿㐀-䶿')} AS z, {_count('A-Za-z')} AS l, len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) AS w FROM q),
f AS (SELECT *, CASE WHEN h + k + z + l < 2 THEN NULL WHEN h > 0 AND 2 * h >= l AND h >= k + z THEN 'ko' WHEN k > 0 THEN 'ja' WHEN z > 0 AND z >= h THEN 'zh' WHEN l > 0 AND w > 1 THEN 'en' WHEN l > 0 THEN NULL ELSE 'ko' END AS found FROM n)
SELECT conv_id, turn, found AS language, CASE WHEN trim(x) = '' OR found = 'ko' THEN 'ko' WHEN found = 'zh' THEN 'ko,zh,ja' WHEN found IN ('en', 'ja') THEN 'ko,' || found ELSE 'ko,en,ja,zh' END AS admitted FROM f"""
)
def language_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of chunks that a question may see; some questions have letters of another script, more or fewer of them."""
    made = F.when(F.length("text") % 5 == 0, F.col("text"))
    for i, (a, b) in _OTHER_SCRIPTS.items():
        made = made.when(F.length("text") % 5 == i, F.translate("text", a, b))
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("x", made)
    return asked.select("conv_id", "turn", tx.language(F.col("x")).alias("language"), F.array_join(tx.admitted_languages(F.col("x")), ",").alias("admitted"))



SCOPE = {"d1": ("the", "les"), "d2": ("der",), "d3": ("que", "el "), "d4": ("zzz",), "d5": (".",)}
_SCOPED = ", ".join(f"CASE WHEN NOT ({' OR '.join(f"contains(text, '{w}')" for w in words)}) THEN '{doc}' END" for doc, words in sorted(SCOPE.items()))


@query(f"SELECT conv_id, turn, array_to_string([x for x in [{_SCOPED}] if x IS NOT NULL], ',') AS excluded FROM conversations WHERE role = 'user'")
def question_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are out of a question's scope, as it has none of their words."""
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(retrieval.scope_exclusions(F.col("text"), SCOPE), ",").alias("excluded"))


@query(
    rf"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN trim(ls[1], {_STRIP}) ELSE 'none' END AS title FROM t),
v AS (SELECT doc_id, trim(regexp_replace(array_to_string([trim(ls[i], {_STRIP}) for i in range(1, len(ls) + 1) if trim(ls[i], {_STRIP}) <> '' AND NOT (i = 1 AND trim(ls[i], {_STRIP}) = title)], ' '), '\s+', ' ', 'g')) AS x FROM u)
SELECT doc_id, CASE WHEN length(x) <= 150 THEN x ELSE rtrim(left(x, 150)) || '…' END AS snippet FROM v"""
)
def passage_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = tx.strip(F.get(tx.lines(F.col("text")), F.lit(0)))
    return read(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text"), F.when(F.col("doc_id") % 2 == 0, first).otherwise("none")).alias("snippet"))


_CARDS = """
c AS (SELECT doc_id, source, lang, text, ['processed_text', 'html_table', 'law_api', 'attachment'][CAST(doc_id % 4 + 1 AS INTEGER)] AS kind, doc_id % 7 = 0 AS whole,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS first, CASE WHEN doc_id % 5 <> 0 THEN 'Art. ' || (doc_id % 9) END AS label,
  CASE WHEN doc_id % 4 = doc_id % 6 THEN '' || (doc_id % 4) ELSE least(doc_id % 4, doc_id % 6) || '-' || greatest(doc_id % 4, doc_id % 6) END AS pages FROM documents)"""


@query(
    f"""WITH {_CARDS}, w AS (SELECT *, CASE kind WHEN 'processed_text' THEN CASE WHEN first <> '' THEN source || ' · ' || lang ELSE 'text' END WHEN 'html_table' THEN CASE WHEN first <> '' THEN first || ' (table)' ELSE 'table' END
  WHEN 'law_api' THEN CASE WHEN whole THEN label || ' · whole form' ELSE label END ELSE CASE WHEN whole THEN 'whole form' ELSE coalesce(label, nullif(first, ''), 'attachment') || ' · p. ' || pages END END AS locator FROM c)
SELECT doc_id, pages, source AS title, CASE WHEN doc_id % 2 = 0 THEN 'https://a.org/' || doc_id END AS url, lang AS publisher, CASE WHEN doc_id % 3 = 1 THEN '2024-01-01' END AS "date", locator, nullif(trim(left(text, 20), {_STRIP}), '') AS snippet FROM w"""
)
def source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a chunk as a source, with its place by the kind of its locator."""
    d = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ("processed_text", "html_table", "law_api", "attachment"))), (d % 4).cast("int"))
    titles = F.when(d % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang"))
    refs = F.array(*(F.struct(F.lit(k).alias("kind"), n.cast("int").alias("page_number")) for k, n in (("pdf_page", d % 4), ("pdf_page", d % 6), ("hwp", d % 9))))
    rows = read(spark, sf_dir, "documents").withColumn("pages", evidence.page_span(refs))
    label = F.when(d % 5 != 0, F.concat(F.lit("Art. "), (d % 9).cast("string")))
    url, date = F.when(d % 2 == 0, F.concat(F.lit("https://a.org/"), d.cast("string"))).otherwise(" "), F.when(d % 3 == 1, "2024-01-01").otherwise("")
    where = evidence.locator(kind, titles, label, F.col("pages"), d % 7 == 0)
    card = evidence.source(F.col("source"), url, F.col("lang"), date, where, F.substring("text", 1, 20))
    return rows.select("doc_id", "pages", card.alias("c")).select("doc_id", "pages", "c.*")


@query(
    """WITH d AS (SELECT *, length(text) < 600 AS form, len(string_split(text, chr(10))) AS n_lines FROM documents)
SELECT doc_id, CASE WHEN form THEN 'form' WHEN lang = 'de' THEN 'law' ELSE 'other' END AS kind, CASE WHEN form THEN CASE WHEN n_lines > 1 THEN 'pdf' ELSE 'hwp' END END AS format, CASE WHEN form THEN source END AS label FROM d"""
)
def form_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of chunks, and the download of those that are whole forms: short texts are forms, and their lines pages."""
    n_lines = F.size(F.split("text", "\n", -1))
    chunk_kind = F.when(F.length("text") < 600, "whole_form").otherwise("page")
    form = evidence.form_download(chunk_kind, F.col("source"), F.lit("https://a.org"), F.when(n_lines > 1, F.sequence(F.lit(1), n_lines)).otherwise(F.array().cast("array<int>")))
    kind = retrieval.kind_of(chunk_kind, F.concat(F.when(F.col("lang") == "de", "LAW-").otherwise("D-"), F.col("doc_id").cast("string")))
    return read(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), form["format"].alias("format"), form["label"].alias("label"))


@query(
    """SELECT doc_id, sha256(source || '/' || text) AS name_sha256, sha256(source || '/' || text) AS repaired_sha256, NOT regexp_full_match(source || '/' || text, '(?s)[\\x00-\\x7F]*') AS was_broken FROM documents"""
)
def repaired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose UTF-8 was read as Latin-1, read again; right names stay.  Whole texts stand for names."""
    name = F.concat_ws("/", "source", "text")
    broken = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.repaired_name(name), 256).alias("name_sha256"), F.sha2(tx.repaired_name(broken), 256).alias("repaired_sha256"), (broken != name).alias("was_broken"))




@query(
    rf"""WITH t AS (SELECT doc_id, text, trim(text, {_STRIP}) AS s, length(regexp_replace(text, '\s', '', 'g')) AS n, length(regexp_replace(text, '[^가-힣A-Za-z0-9]', '', 'g')) AS a FROM documents),
k AS (SELECT *, trim(regexp_replace(array_to_string([x for x in string_split(s, chr(10)) if NOT regexp_matches(x, '^The')], chr(10)), '\[none:[^\]]*\]', '', 'g'), {_STRIP}) AS clean FROM t),
r AS (SELECT *, CASE WHEN doc_id % 10 = 0 OR doc_id % 4 = 3 THEN 'review' WHEN regexp_matches(s, '^The') THEN 'none' WHEN doc_id % 6 = 0 THEN 'review' WHEN length(regexp_replace(clean, '\s', '', 'g')) < 20 THEN 'none' ELSE 'auto' END AS route FROM k)
SELECT doc_id, n >= 20 AND a / n::DOUBLE > 0.75 AS good, route, sha256(CASE WHEN route = 'auto' THEN clean ELSE '' END) AS text_sha256 FROM r"""
)
def transcript_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a transcript is usable, and where a machine's goes."""
    d = F.col("doc_id")
    route = quality.transcript_route(F.col("text"), F.when(d % 10 == 0, "length").otherwise("stop"), d % 4, F.when(d % 6 == 0, "a map").otherwise("photo"), "^The", "map", r"\[none:[^\]]*\]")
    rows = read(spark, sf_dir, "documents").select("doc_id", tx.good_transcript(F.col("text")).alias("good"), route.alias("r"))
    return rows.select("doc_id", "good", "r.route", F.sha2("r.text", 256).alias("text_sha256"))


@query(
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents), p AS (SELECT *, coalesce(list_position([x = ls[1] OR x = ls[2] for x in ls], FALSE), 0) AS p FROM l)
SELECT doc_id, CAST(CASE WHEN p > 0 THEN len(ls) - p + 1 ELSE 0 END AS INTEGER) AS n_lines, CASE WHEN p > 0 THEN ls[p] END AS first_line FROM p"""
)
def leading_lines_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without those at the beginning that are navigation: here, copies of the first two."""
    furniture = lambda own: F.filter(F.slice(own, 1, 2), lambda x: x.isNotNull())
    rows = read(spark, sf_dir, "documents").select("doc_id", pg.without_leading(tx.lines(F.col("text")), furniture).alias("kept"))
    return rows.select("doc_id", F.size("kept").alias("n_lines"), F.get("kept", F.lit(0)).alias("first_line"))


# Dates, titles and numbers.


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
  CASE o_orderkey % 4 WHEN 0 THEN 'dates differ' WHEN 1 THEN 'updated ' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 2 THEN 'published ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'no date' END AS label FROM orders"""
)
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact dates as ISO dates, and what is shown as a source's date."""
    k = F.col("o_orderkey")
    day = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "yyyy-MM-dd")
    raw = F.when(k % 7 == 0, "2024-01").when(k % 11 == 0, "20240231").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    words = {"updated": "updated", "published": "published", "conflicting": "dates differ", "unknown": "no date"}
    published, updated = F.when(k % 4 == 3, "").otherwise(day(0)), F.when(k % 4 == 1, day(1)).otherwise("")
    label = tx.date_label(F.when(k % 4 == 0, "conflicting").otherwise("known"), published, updated, words)
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.iso_date(raw).alias("iso"), label.alias("label"))


@query(
    """WITH d AS (SELECT o_orderkey, [CAST(o_orderdate AS DATE), CAST(o_orderdate + INTERVAL 400 DAY AS DATE), CAST(o_orderdate AS DATE)] AS ds FROM orders),
p AS (SELECT o_orderkey, list_sort(list_distinct([strftime(x, '%Y-%m-%d') for x in ds if x < DATE '1998-06-01'])) AS ps FROM d)
SELECT o_orderkey, array_to_string(ps, ',') AS past FROM p"""
)
def past_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deadlines in a text that are over; days that no calendar has are none."""
    told = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "'until' yyyy/M/d")
    text = F.concat_ws(", ", told(0), F.lit("until 1990/2/30"), told(400), told(0))
    past = tx.past_deadlines(text, F.lit("1998-06-01").cast("date"), r"until (\d{4})/(\d{1,2})/(\d{1,2})")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.transform(past, lambda x: x.cast("string"))), ",").alias("past"))


RELATIVE = {"the": ("year", -1), "de": ("year", 0), "ion": ("month", -1), "ung": ("day", 1)}
SHOWN = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}


@query(
    """SELECT conv_id, turn, array_to_string([x for x in [CASE WHEN contains(text, 'the') THEN 'the=2023' END, CASE WHEN contains(text, 'de') THEN 'de=2024' END, CASE WHEN contains(text, 'ion') THEN 'ion=2024-02' END, CASE WHEN contains(text, 'ung') THEN 'ung=2024-04-01' END] if x IS NOT NULL], ';') AS dates
FROM conversations WHERE role = 'user'"""
)
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a question that name a time by its distance from today; frequent syllables stand for such words."""
    found = tx.relative_dates(F.col("text"), F.lit("2024-03-31").cast("date"), RELATIVE, SHOWN)
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["word"], x["value"])), ";").alias("dates"))



@query(
    """SELECT p_partkey, p_partkey % 3 = 0 AS submitted, p_partkey % 4 = 1 AS elsewhere, CASE p_partkey % 5 WHEN 0 THEN '「' || p_name || '」' WHEN 1 THEN '' || chr(57345) || p_name || chr(57345) || chr(57346) ELSE p_name END AS title FROM part"""
)
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that are handed in, questions about another place, and brackets in place of private glyphs."""
    k, mark = F.col("p_partkey"), F.lit(chr(57345))
    title = F.when(k % 3 == 0, "사용 신청서 (Application)").when(k % 3 == 1, "출입 허가증 (Pass)").otherwise("완료 확인증")
    question = F.when(k % 4 == 0, "fees of Northport and here").when(k % 4 == 1, "fees of Northport").otherwise("fees")
    raw = F.when(k % 5 == 0, F.concat(mark, "p_name", mark)).when(k % 5 == 1, F.concat(mark, "p_name", mark, F.lit(chr(57346)))).otherwise(F.col("p_name"))
    fixed = tx.guarded_glyphs(raw, "[a-z]+ [a-z]+", "「", "」")
    return read(spark, sf_dir, "part").select("p_partkey", tx.is_submitted(title, "증").alias("submitted"), tx.only_elsewhere(question, "Northport", "here").alias("elsewhere"), fixed.alias("title"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, format('{:,}', CAST(l_quantity * 1000 AS BIGINT)) AS quantity, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN format('{:,}', CAST(l_extendedprice AS BIGINT)) ELSE format('{:,.2f}', l_extendedprice) END AS price FROM lineitem")
def plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tx.plain_number(F.col("l_quantity") * 1000).alias("quantity"), tx.plain_number(F.col("l_extendedprice")).alias("price"))


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, '<p>([^<]*)</p>', 1) AS para FROM pages),
c AS (SELECT *, list_filter(string_split(regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1), '/'), lambda x: trim(x) <> '') AS parts,
  list_filter(string_split(t || chr(10) || chr(10) || '20' || right('0' || (length(t) % 100), 2) || '-' || (length(para) % 14) || '-' || (length(t) % 33) || chr(10) || para, chr(10)), lambda x: trim(x) <> '') AS ls FROM p),
d AS (SELECT *, [x for x in ls[1:10] if regexp_matches(x, '(?:20|19)[0-9]{2}[-.]\s?[0-9]{1,2}[-.]\s?[0-9]{1,2}')][1] AS dated FROM c)
SELECT page_id, array_to_string(list_reverse(parts)[1:3], ' - ') AS title, coalesce(ls[1], '') AS post_title,
  coalesce(regexp_extract(dated, '((?:20|19)[0-9]{2})[-.]\s?([0-9]{1,2})[-.]\s?([0-9]{1,2})', 1) || '-' || lpad(regexp_extract(dated, '((?:20|19)[0-9]{2})[-.]\s?([0-9]{1,2})[-.]\s?([0-9]{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(dated, '((?:20|19)[0-9]{2})[-.]\s?([0-9]{1,2})[-.]\s?([0-9]{1,2})', 3), 2, '0'), '') AS post_date,
  array_to_string(ls[2:], chr(10)) AS post_text FROM d"""
)
def board_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from the parts of a page's address, and the parts of a post, of the page's title and first paragraph, before the links to its neighbours."""
    t, para = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "<p>([^<]*)</p>", 1)
    crumbs = F.array_join(F.split(F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1), "/"), " > ")
    day = F.concat_ws("-", F.concat(F.lit("20"), F.lpad((F.length(t) % 100).cast("string"), 2, "0")), (F.length(para) % 14).cast("string"), (F.length(t) % 33).cast("string"))
    post = F.concat(t, F.lit("\n\n"), day, F.lit("\n"), para, F.lit("\nPrevious post\nother 2020-01-01"))
    parts = tx.post_parts(post, "Previous|Next")
    return read(spark, sf_dir, "pages").select("page_id", tx.page_title(crumbs).alias("title"), parts["title"].alias("post_title"), parts["date"].alias("post_date"), parts["text"].alias("post_text"))


@query(
    r"""WITH t AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || '※ '), chr(10)) AS ls FROM documents)
SELECT doc_id, CAST(len([x for x in ls if starts_with(x, '※') AND (contains(x, 'the') OR contains(x, 'les'))]) AS INTEGER) AS n_notices, sha256(array_to_string([trim(x) for x in ls if starts_with(x, '※') AND (contains(x, 'the') OR contains(x, 'les'))], chr(10))) AS notices_sha256 FROM t"""
)
def notice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.notices(F.replace("text", F.lit(". "), F.lit(".\n※ ")), ("the", "les"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_notices"), F.sha2(F.array_join(found, "\n"), 256).alias("notices_sha256"))


@query(
    r"""WITH a AS (SELECT r.conv_id, r.turn, r.text, length(r.text) AS n, coalesce(u.text, '') AS q FROM conversations r LEFT JOIN conversations u ON u.conv_id = r.conv_id AND u.turn = r.turn - 1 AND u.role = 'user' WHERE r.role = 'assistant'),
s AS (SELECT *, [(n % 28) || ':' || lpad('' || (n % 65), 2, '0'), (length(q) % 26) || ':' || lpad('' || (length(q) % 61), 2, '0')] AS ts,
  '0' || (n % 100) || '-' || (100 + n % 900) || '-' || lpad('' || (n * 7 % 10000), 4, '0') || CASE WHEN n % 5 = 0 THEN '1' ELSE '' END || ' / 0' || (length(q) % 100) || '-' || (100 + length(q) % 9900) || '-' || lpad('' || (length(q) * 3 % 10000), 4, '0') AS tel FROM a),
p AS (SELECT *, regexp_extract_all(tel, '\b0\d{1,2}-\d{3,4}-\d{4}\b') AS ps FROM s)
SELECT conv_id, turn, regexp_matches(q, 'the|de') AND NOT regexp_matches(regexp_replace(text, '(?m)\[\d+\]|^\s*\d+\.\s', '', 'g'), '\d') AS missing_date, n <= 200 AND regexp_matches(text, 'ing|ung') AS no_evidence,
  array_to_string([x for x in ts if CAST(split_part(x, ':', 1) AS INT) > 24 OR CAST(split_part(x, ':', 2) AS INT) > 59 OR split_part(x, ':', 1) = '24' AND split_part(x, ':', 2) <> '00'], ',') AS bad_times,
  array_to_string(list_filter(ps, lambda x, i: list_position(ps, x) = i), ',') AS phones FROM p"""
)
def answer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies against the question before: a time that was asked for and is not told, words that say there is nothing; clock times and phones, of lengths of texts, that are none."""
    said = read(spark, sf_dir, "conversations")
    asked = said.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    rows = said.filter("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").withColumn("q", F.coalesce("q", F.lit("")))
    n, m = F.length("text"), F.length("q")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    times = F.concat((n % 28).cast("string"), F.lit(":"), two(n % 65), F.lit(" or "), (m % 26).cast("string"), F.lit(":"), two(m % 61), F.lit(" 123:456"))
    tel = lambda a, b, c: F.concat(F.lit("0"), a.cast("string"), F.lit("-"), b.cast("string"), F.lit("-"), F.lpad(c.cast("string"), 4, "0"))
    told = F.concat(tel(n % 100, 100 + n % 900, n * 7 % 10000), F.when(n % 5 == 0, "1").otherwise(""), F.lit(" / "), tel(m % 100, 100 + m % 9900, m * 3 % 10000))
    return rows.select(
        "conv_id", "turn", tx.missing_date(F.col("q"), F.col("text"), "the|de", r"\d").alias("missing_date"), pg.says_no_evidence(F.col("text"), "ing|ung").alias("no_evidence"),
        F.array_join(pg.impossible_times(times), ",").alias("bad_times"), F.array_join(pg.phones(told), ",").alias("phones"),
    )



# Index input and rows of images.


@query("SELECT doc_id, sha256(source || chr(10) || lang || ' > ' || source || chr(10) || chr(10) || text) AS input_sha256, CAST(length(text) AS INTEGER) AS tokens, '[' || (doc_id % 7) || ',' || (doc_id % 5) || ']' AS literal FROM documents")
def index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encoder reads, the guard of its length, and a vector as text."""
    d = F.col("doc_id")
    rows = index.in_order(read(spark, sf_dir, "documents").withColumn("chunk_id", d))
    made = index.input_text(F.col("source"), F.array("lang", "source"), F.col("text"))
    return rows.select("doc_id", F.sha2(made, 256).alias("input_sha256"), index.token_guard(F.length("text"), 1_000_000, d).alias("tokens"), vx.literal(F.array(d % 7, d % 5)).alias("literal"))


_IMAGES = """
i AS (SELECT 's' || p_partkey AS sha256, p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'en' ELSE 'ko' END AS lang, p_name || ' ' || lower(p_type) AS alt, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'f' || (p_partkey % 50) END AS file,
  CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE (p_partkey % 50) * 20 END AS width, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE (p_partkey % 50) * 10 END AS height, p_partkey % 11 = 0 AS manual,
  CASE WHEN p_partkey % 4 = 0 THEN 'text that was read from image ' || p_partkey ELSE '' END AS read FROM part),
r AS (SELECT 's' || l_partkey AS sha256, count(*) AS n_refs, count(DISTINCT l_suppkey) AS n_docs FROM lineitem GROUP BY l_partkey)"""


@query(
    f"""WITH {_IMAGES}, s AS (SELECT i.*, n_refs, CASE WHEN coalesce(n_docs, 0) >= 27 THEN 'repeated' WHEN manual THEN 'manual' WHEN lang <> 'ko' THEN 'foreign' WHEN file = '' THEN 'none' WHEN width > 0 AND (width < 300 OR height < 100) THEN 'small'
  WHEN read <> '' THEN 'ocr' WHEN length(alt) >= 15 AND NOT contains(alt, 'ring') THEN 'alt' ELSE 'none' END AS state FROM i LEFT JOIN r USING (sha256))
SELECT sha256, n_refs, state, state IN ('ocr', 'alt', 'none', 'foreign') AND file <> '' AS wanted, CASE WHEN k % 11 = 0 THEN 'manual' WHEN k % 6 = 0 THEN 'machine' WHEN read <> '' THEN 'ocr' END AS origin FROM s"""
)
def image_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with their files, what was read from them, their references, state and transcripts; parts stand for images."""
    k = F.col("p_partkey")
    sha = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    part = read(spark, sf_dir, "part")
    images = part.select(
        sha("p_partkey").alias("sha256"), F.when(k % 9 == 0, "en").otherwise("ko").alias("lang"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("alt"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("f"), (k % 50).cast("string"))).alias("file"), (k % 11 == 0).alias("manual"),
    )
    n = F.col("id")
    files = spark.range(50).select(F.concat(F.lit("f"), n.cast("string")).alias("file"), (n * 20).cast("int").alias("width"), (n * 10).cast("int").alias("height"))
    ocr = part.filter(k % 4 == 0).select(sha("p_partkey").alias("sha256"), F.concat(F.lit("text that was read from image "), k.cast("string")).alias("read"))
    refs = read(spark, sf_dir, "lineitem").select(sha("l_partkey").alias("sha256"), F.col("l_suppkey").alias("doc_id"))
    states = quality.image_states(quality.image_inventory(images, files, ocr), refs, "ring", repeated=27)
    manual, machine = (part.filter(k % m == 0).select(sha("p_partkey").alias("sha256"), F.lit("some text").alias("text")) for m in (11, 6))
    origin = quality.with_transcripts(images, ("manual", manual), ("machine", machine), ("ocr", ocr.withColumnRenamed("read", "text")))
    return states.join(origin, "sha256").select("sha256", "n_refs", "state", "wanted", "origin")


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(lead(embedding) OVER (ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(a, a)), 6) AS norm, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine FROM v WHERE b IS NOT NULL"""
)
def neighbour_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each vector, and its cosine with the vector of the next id."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ahead = index.numbered(e.withColumn("all", F.lit(0)), "all", "vec_id")
    pairs = ahead.join(ahead.select((F.col("number") - 1).alias("number"), F.col("embedding").alias("b")), "number")
    return pairs.select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"), F.round(vx.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT user_id, count(*) AS n_events, sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END) AS n_values, sum(CASE WHEN event_id % 2 = 0 THEN k + event_id ELSE k END) AS total FROM e GROUP BY user_id HAVING count(*) > 1"""
)
def repeated_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that more than one row has, and JSON values that are a list or one element without its list."""
    e = read(spark, sf_dir, "events")
    listed = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a":['), "props", F.lit(',{"k":'), F.col("event_id").cast("string"), F.lit("}]}"))).otherwise(F.concat(F.lit('{"a":'), "props", F.lit("}")))
    values = F.transform(readers.as_list(listed, "$.a", "struct<k:long>"), lambda x: x["k"])
    sums = e.select("user_id", values.alias("v")).groupBy("user_id").agg(F.sum(F.size("v")).alias("n_values"), F.sum(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))
    return readers.repeated_keys(e, "user_id").withColumnRenamed("n", "n_events").join(sums, "user_id")
