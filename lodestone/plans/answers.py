"""Queries over answers: filters, events, actions, checks, routes, runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import pages as pg
from lodestone.operators import conversation, evaluation, evidence, retrieval
from lodestone.plans.registry import query, read
from lodestone.sources import readers, streams
from lodestone.sources.work import remove_at_exit, shared_folder
from lodestone.streaming import events as ev
from lodestone.streaming import filters, gate


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").filter("role = 'assistant'")


# Stream filters, over complete answers; tests hold the stateful stream against these expressions.

FILTERS = filters.FilterConfig(
    markers=("@@META", "\nforms:"), labels=(("[evidence]", "the sources"),), mask="(hidden)",
    contact=r"https?://[!-(*-\[^-~]+|[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+|0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}",
)
_RULES = "|".join(rf"[ \t]*(?:[{m}][ \t]*){{3,}}" for m in (r"\-", r"\*", "_"))


@query(
    rf"""WITH a AS (SELECT conv_id, turn, '---' || chr(10) || 'Fee [1] [' || (conv_id % 7) || ']' || chr(10) || ' - - -' || chr(10) || text || chr(10) || '___ x' || chr(10) || '**' || chr(10) ||
    'See [evidence] [99], mail x@y.org. or call 061-123-4567, https://ok.org/a' || CASE turn % 3 WHEN 0 THEN '@@META {{"a": 1}}' WHEN 1 THEN chr(10) || 'forms: [1]' ELSE chr(10) || '***' END AS body,
  conv_id % 3 AS n, CASE WHEN conv_id % 2 = 0 THEN 'call 061-123-4567' ELSE 'mail x@y.org https://ok.org/a' END AS evidence FROM conversations WHERE role = 'assistant'),
s AS (SELECT *, string_split_regex(body, '@@META|\nforms:')[1] AS shown FROM a),
l AS (SELECT *, string_split(shown, chr(10)) AS ls FROM s),
r AS (SELECT *, array_to_string([ls[i] || CASE WHEN i < len(ls) THEN chr(10) ELSE '' END for i in range(1, len(ls) + 1) if NOT (length(ls[i]) <= 200 AND regexp_full_match(ls[i], '{_RULES}'))], '') AS x FROM l),
c AS (SELECT *, string_split_regex(x, '\[[0-9]{{1,6}}\]') AS ps, regexp_extract_all(x, '\[[0-9]{{1,6}}\]') AS ms FROM r),
d AS (SELECT *, replace(array_to_string([ps[i] || coalesce(CASE WHEN CAST(regexp_extract(ms[i], '[0-9]+') AS INTEGER) BETWEEN 1 AND n THEN ms[i] END, '') for i in range(1, len(ps) + 1)], ''), '[evidence]', 'the sources') AS y FROM c),
e AS (SELECT *, string_split_regex(y, '{FILTERS.contact}') AS qs, regexp_extract_all(y, '{FILTERS.contact}') AS ks FROM d)
SELECT conv_id, turn, array_to_string([qs[i] || coalesce(CASE WHEN ks[i] IS NULL THEN NULL WHEN contains(evidence, rtrim(ks[i], '.,')) THEN ks[i] ELSE '(hidden)' END, '') for i in range(1, len(qs) + 1)], '') AS text,
  nullif(substr(body, length(shown) + 1), '') AS trailer FROM e"""
)
def filtered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without trailer, rule lines, citations of no source, internal labels and contacts that the evidence lacks."""
    c, t = F.col("conv_id"), F.col("turn")
    end = F.when(t % 3 == 0, '@@META {"a": 1}').when(t % 3 == 1, "\nforms: [1]").otherwise("\n***")
    body = F.concat(
        F.lit("---\nFee [1] ["), (c % 7).cast("string"), F.lit("]\n - - -\n"), "text", F.lit("\n___ x\n**\nSee [evidence] [99], mail x@y.org. or call 061-123-4567, https://ok.org/a"), end
    )
    evidence_of = F.when(c % 2 == 0, "call 061-123-4567").otherwise("mail x@y.org https://ok.org/a")
    key = F.concat_ws("/", "conv_id", "turn").alias("message_id")
    # Each answer comes in pieces of 7 characters.
    rows = _replies(spark, sf_dir).select("conv_id", "turn", key, body.alias("body"), (c % 3).cast("int").alias("n_sources"), evidence_of.alias("evidence"))
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("body") / 7).cast("int")), lambda i: F.substring(F.col("body"), i * 7 + 1, F.lit(7)))).alias("seq", "fragment")
    out = filters.filtered(rows.select("message_id", "n_sources", "evidence", pieces), FILTERS)
    place = lambda i: F.split("message_id", "/")[i].cast("long")
    return out.select(place(0).alias("conv_id"), place(1).alias("turn"), "text", "trailer")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, CASE WHEN role = 'user' THEN 'message' ELSE 'token' END AS event, text AS data FROM conversations")
def stream_events_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent events: names, joined data lines, comments, blocks without data, an unfinished end."""
    name = F.when(F.col("role") == "user", "").otherwise("event: token\r\n")
    block = F.concat(name, F.lit("data: "), F.replace("text", F.lit("\n"), F.lit("\r\ndata:")), F.lit("\r\n\r\n: note\n\nevent: none\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))["b"]
    streams = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("message_id")).agg(F.concat(F.array_join(ordered, ""), F.lit("data: cut")).alias("body"))
    events = readers.sse_events(streams)
    place = F.row_number().over(Window.partitionBy("message_id").orderBy("seq"))
    return events.select(F.col("message_id").alias("conv_id"), place.alias("place"), "event", "data")


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'message' ELSE 'token' END AS event, sha256(text) AS text_sha256, length(text) AS n_chars FROM conversations"""
)
def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of server-sent events with comments, empty events and an unfinished one at the end of each, read by the event source."""
    name = F.when(F.col("role") == "user", "").otherwise("event: token\n")
    data = F.to_json(F.struct("conv_id", "turn", "text"))
    block = F.concat(F.lit(": note\n"), name, F.lit("data: "), data, F.lit("\n\nevent: none\n"))
    path = remove_at_exit(spark, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}")
    read(spark, sf_dir, "conversations").select(block.alias("value")).write.text(path)
    events = streams.message_files(spark, path if "://" in path else path.replace("file:", "file://", 1), part_bytes=1 << 20)
    said = F.from_json("data", "conv_id long, turn long, text string")
    return events.select(said.alias("s"), "event").select("s.conv_id", "s.turn", "event", F.sha2("s.text", 256).alias("text_sha256"), F.length("s.text").cast("long").alias("n_chars"))


@query("SELECT conv_id, count(*) + 1 AS n, sha256(string_agg(text, '' ORDER BY turn)) AS text_sha256, 1 AS ends FROM conversations GROUP BY conv_id")
def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDJSON lines of tokens, read and joined."""
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.lit(False).alias("done")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))["l"]
    end = F.lit('\nno json\n{"message":{"content":""},"done":true}\n')
    streams = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("message_id")).agg(F.concat(F.array_join(ordered, "\n"), end).alias("body"))
    tokens = readers.ndjson_tokens(streams).groupBy(F.col("message_id").alias("conv_id"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("seq", "token")))["token"], "")
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.sha2(text, 256).alias("text_sha256"), F.count_if("done").cast("int").alias("ends"))


_MESSAGES = """
m AS (SELECT *, user_id || '/' || strftime(ts, '%Y-%m-%d') AS message_id FROM events),
t AS (SELECT * FROM m WHERE event_type IN ('view', 'click', 'purchase'))"""


@query(
    f"""WITH {_MESSAGES},
v AS (SELECT message_id, ts AS v_ts, event_type = 'signup' AS allowed FROM m WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ts, event_type) = 1),
refused AS (SELECT message_id FROM (SELECT message_id, min(ts) AS started FROM t GROUP BY 1) JOIN v USING (message_id) WHERE NOT allowed AND v_ts <= started + INTERVAL 6 HOUR)
SELECT message_id, event_id AS seq, event_type AS text FROM t WHERE message_id NOT IN (SELECT message_id FROM refused)"""
)
def gated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a message, its errors refuse it, its signups let it through; a refused one shows nothing."""
    e = _user_days(spark, sf_dir)
    tokens = e.filter("event_type IN ('view', 'click', 'purchase')").select("message_id", F.col("event_id").alias("seq"), F.col("event_type").alias("text"), "ts")
    verdicts = e.filter("event_type IN ('signup', 'error')").select("message_id", (F.col("event_type") == "signup").alias("allowed"), "ts")
    return gate.released(tokens, verdicts, within="6 hours").select("message_id", "seq", "text")


@query(
    f"""WITH {_MESSAGES},
r AS (SELECT message_id, ts, event_type = 'purchase' AS done, coalesce(lag(ts) OVER w + INTERVAL 8 HOUR < ts, FALSE) AS quiet FROM m WINDOW w AS (PARTITION BY message_id ORDER BY ts, event_type = 'purchase')),
n AS (SELECT *, coalesce(sum((done OR quiet)::INT) OVER (PARTITION BY message_id ORDER BY ts, done ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
k AS (SELECT message_id, count(*) FILTER (NOT done AND NOT quiet) AS n_shown, max(CASE WHEN quiet THEN 'idle' WHEN done THEN 'done' END) AS ending, max(ts) FILTER (NOT quiet) AS last FROM n WHERE before = 0 GROUP BY 1)
SELECT message_id, n_shown, coalesce(ending, 'ended') AS ending, round(epoch(CASE WHEN ending = 'idle' THEN last + INTERVAL 8 HOUR ELSE last END), 3) AS at_s FROM k"""
)
def message_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a user's day as a message ends: by a purchase, by hours of silence, or without a mark."""
    rows = _user_days(spark, sf_dir).select("message_id", F.when(F.col("event_type") == "purchase", "done").otherwise("token").alias("kind"), "ts")
    return gate.endings(rows, "8 hours").select("message_id", "n_shown", "ending", F.round(F.col("at").cast("double"), 3).alias("at_s"))


def _user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("message_id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))


@query("SELECT user_id AS message_id, round(epoch(min(ts)) - epoch(TIMESTAMP '2024-01-01'), 3) AS first_token_s, round(epoch(max(ts)) - epoch(TIMESTAMP '2024-01-01'), 3) AS total_s FROM events GROUP BY user_id")
def answer_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    asked = e.select("message_id").distinct().withColumn("asked_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return ev.answer_times(e, asked).select("message_id", F.round("first_token_s", 3).alias("first_token_s"), F.round("total_s", 3).alias("total_s"))


# Actions, contacts, labels.


@query(
    """WITH a AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'unknown' ELSE 'clarify' END AS kind, conv_id % 4 + 1 AS form FROM conversations WHERE role = 'assistant'),
x AS (
  SELECT conv_id, turn, 0 AS part, form AS ord, 'download' AS type, 'Form ' || form AS label FROM a WHERE kind = 'answer' AND form IN (1, 2) AND form % 2 = 0
  UNION ALL SELECT conv_id, turn, 1, 0, 'link', 'Pay' FROM a WHERE kind = 'answer' AND conv_id % 2 = 0
  UNION ALL SELECT conv_id, turn, 2, 0, 'contact', 'Main' FROM a WHERE kind = 'unknown')
SELECT conv_id, turn, string_agg(label, ',' ORDER BY part, ord) FILTER (type <> 'contact') AS links, string_agg(label, ',' ORDER BY part, ord) FILTER (type = 'contact') AS contacts FROM x GROUP BY conv_id, turn"""
)
def answer_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buttons of answers by their type, forms that are chosen and cited, links whose word is in the evidence; links and contacts apart."""
    c = F.col("conv_id")
    form = (c % 4 + 1).cast("int")
    kind = F.when(c % 3 == 0, "answer").when(c % 3 == 1, "unknown").otherwise("clarify")
    replies = _replies(spark, sf_dir).select(F.struct("conv_id", "turn").alias("qid"), "conv_id", F.lit("see [1] and [2]").alias("answer"), kind.alias("answer_type"), F.array(form).alias("forms"), F.array(F.lit("pay"), F.lit("gone"), F.lit("pay")).alias("keys"))
    rank = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")
    hits = replies.select("qid", "conv_id", rank).select(
        "qid", "rank", F.concat(F.lit("Form "), F.col("rank").cast("string")).alias("form_title"), F.when(F.col("rank") % 2 == 0, "whole_form").otherwise("page").alias("chunk_kind"),
        F.lit("https://a.org").alias("source_url"), F.when((c % 2 == 0) & (F.col("rank") == 3), "About PAYMENT").otherwise("else").alias("evidence"),
    )
    links = spark.createDataFrame([("pay", "Pay", "https://pay", "payment"), ("gone", "Gone", "https://gone", "absent"), ("main", "Main", "tel:1", "")], "key string, label string, url string, word string")
    split = evidence.split_actions(evidence.action_lists(replies, hits, links))
    joined = lambda name: F.when(F.size(name) > 0, F.array_join(name, ",")).alias(name)
    return split.select("qid.conv_id", "qid.turn", joined("links"), joined("contacts"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'fr ' || n_name WHEN n_nationkey % 3 <> 2 THEN 'en ' || n_name ELSE n_name END AS label FROM nation")
def localized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the asker's language, else in English, else as they are."""
    k = F.col("n_nationkey")
    nation = read(spark, sf_dir, "nation")
    of = lambda lang, rows: rows.select(F.col("n_name").alias("label"), F.lit(lang).alias("lang"), F.concat_ws(" ", F.lit(lang), "n_name").alias("text"))
    labels = of("fr", nation.filter(k % 3 == 0)).unionByName(of("en", nation.filter(k % 3 != 2)))
    return evidence.localized(nation.select(k, F.col("n_name").alias("label")), labels, F.when(k % 2 == 0, "fr").otherwise("de"))


_DUTIES = "d AS (SELECT s_nationkey AS dept, s_suppkey AS pos, CASE WHEN s_suppkey % 4 = 0 THEN 'lead' ELSE 'task ' || (s_suppkey % 3) END AS task, 'p' || (s_suppkey % 5) AS phone FROM supplier)"


@query(
    f"""WITH {_DUTIES}, t AS (SELECT dept, task, min(pos) AS pos, list(phone ORDER BY pos, phone) AS ps FROM d GROUP BY dept, task),
u AS (SELECT dept, string_agg(task || ': ' || array_to_string([ps[i] for i in range(1, len(ps) + 1) if list_position(ps, ps[i]) = i], ', '), '; ' ORDER BY pos) AS tasks FROM t GROUP BY dept),
p AS (SELECT dept, coalesce(arg_min(phone, pos) FILTER (contains(task, 'lead')), arg_min(phone, pos)) AS phone FROM d GROUP BY dept)
SELECT dept, phone, tasks FROM p JOIN u USING (dept)"""
)
def department_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    duties = read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("dept"), k.alias("pos"), F.when(k % 4 == 0, "lead").otherwise(F.concat(F.lit("task "), (k % 3).cast("string"))).alias("task"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("phone")
    )
    return evidence.department_contacts(duties, "lead").select("dept", "phone", F.array_join("tasks", "; ").alias("tasks"))


@query(
    """WITH c AS (SELECT 'old-' || s_nationkey AS key, s_name AS label FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'dept-' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1)
SELECT key, label, 'kept' AS origin FROM c WHERE key NOT LIKE 'dept-%' UNION ALL SELECT 'dept-' || n_nationkey, n_name, 'fresh' FROM nation"""
)
def merged_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of one collection replaced by fresh ones; others stay."""
    k = F.col("s_suppkey")
    old = read(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, F.concat(F.lit("old-"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("dept-"), k.cast("string"))).alias("key"), F.col("s_name").alias("label"), F.lit("kept").alias("origin"))
    fresh = read(spark, sf_dir, "nation").select(F.concat(F.lit("dept-"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("label"), F.lit("fresh").alias("origin"))
    return evidence.merge_contacts(old, fresh, "dept-")


@query(
    """SELECT c_mktsegment AS role, c_nationkey AS region, 'p' || (c_nationkey % 7) AS phone, CAST(count(DISTINCT c_custkey % 50) AS INTEGER) AS n_docs, array_to_string(list_sort(list_distinct(list(c_custkey % 50))), ',') AS doc_ids FROM customer GROUP BY 1, 2, 3"""
)
def grouped_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that name a contact; each region has one phone, or the job stops."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role"), F.col("c_nationkey").alias("region"), F.concat(F.lit("p"), (F.col("c_nationkey") % 7).cast("string")).alias("phone"), (F.col("c_custkey") % 50).alias("doc_id"))
    one = evidence.only_value(rows, "phone", "region")
    return evidence.grouped_contacts(rows.drop("phone").join(one, "region")).select("role", "region", "phone", F.size("doc_ids").alias("n_docs"), F.array_join("doc_ids", ",").alias("doc_ids"))


# Answer texts.


@query(
    r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CASE pos % 3 WHEN 0 THEN 'ordered' WHEN 1 THEN 'bullet' ELSE 'paragraph' END AS kind, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text, CAST(1 AS INTEGER) AS n_cited FROM l"""
)
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of answers as ordered items, bullets and paragraphs, without their marks and citations."""
    mark = lambda i: F.when(i % 3 == 0, F.concat((i + 1).cast("string"), F.lit(". "))).when(i % 3 == 1, "- ").otherwise("")
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(mark(i), F.lit("**"), x, F.lit("** ["), (i + 1).cast("string"), F.lit("]"))), "\n")
    rows = _replies(spark, sf_dir).select("conv_id", "turn", F.posexplode(pg.answer_blocks(marked)).alias("pos", "b"))
    return rows.select("conv_id", "turn", "pos", "b.kind", "b.text", F.size("b.cited").alias("n_cited"))


_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(
    f"""WITH a AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w, length(text) AS n FROM conversations WHERE role = 'assistant'),
k AS (SELECT *, CASE n % 4 WHEN 0 THEN 'clarify' WHEN 1 THEN 'unknown' WHEN 2 THEN 'answer' ELSE 'shout' END AS said, n % 7 <> 0 AS whole,
  CASE WHEN n % 3 = 0 THEN [] ELSE [trim(x, ' ' || chr(10)) for x in list_concat(w[1:3], w[3:8]) if length(trim(x, ' ' || chr(10))) BETWEEN 1 AND 50] END AS o,
  list_concat([n], [CAST(x AS BIGINT) for x in w if regexp_full_match(x, '[0-9]{{1,9}}')], [len(w)]) AS f FROM a)
SELECT conv_id, turn, CASE WHEN NOT whole OR said = 'shout' OR said = 'clarify' AND len(o) = 0 THEN 'answer' ELSE said END AS type,
  CASE WHEN whole AND said = 'clarify' THEN array_to_string(({_ONCE.format('o')})[1:4], ',') ELSE '' END AS options, CASE WHEN whole THEN array_to_string({_ONCE.format('f')}, ',') ELSE '' END AS forms FROM k"""
)
def answer_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailers of an answer's own words: lists under repeated keys, texts and numbers as forms, unknown types, objects without an end."""
    n, w = F.length("text"), F.split("text", " ")
    of = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    kind = F.get(F.array(*map(F.lit, ('"clarify"', '"unknown"', '"answer"', '"shout"'))), n % 4)
    options = F.when(n % 3 == 0, of("options", F.lit('"no list"'))).otherwise(F.concat_ws(",", of("options", F.to_json(F.slice(w, 1, 3))), of("options", F.to_json(F.slice(w, 3, 6)))))
    numbers = F.filter(w, lambda x: x.rlike("^[0-9]{1,9}$"))
    forms = F.concat_ws(",", of("forms", F.concat(F.lit("["), n.cast("string"), F.lit(',"x1",true]'))), of("forms", F.to_json(numbers)), of("forms", F.concat(F.lit('[" '), F.size(w).cast("string"), F.lit('"]'))))
    whole = F.concat(F.lit("@@META {"), F.concat_ws(",", of("type", kind), options, forms), F.when(n % 7 == 0, "").otherwise('} rest {"type":"clarify"}'))
    rows = _replies(spark, sf_dir).select("conv_id", "turn", pg.trailer(whole).alias("t"))
    return rows.select("conv_id", "turn", "t.type", F.array_join("t.options", ",").alias("options"), F.array_join(F.transform("t.forms", lambda x: x.cast("string")), ",").alias("forms"))


# Routes and checks.


@query(
    """WITH e AS (SELECT event_id AS qid, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM events),
s AS (SELECT *, value >= 50 AS good, greatest(value, before) * 0.75 AS both_score, greatest(value, before) * 0.75 >= 50 AS both_good FROM e)
SELECT qid, round(CASE WHEN NOT good AND both_good THEN both_score ELSE value END, 6) AS top_score, CASE WHEN good OR both_good THEN 'answer' ELSE 'unknown' END AS route, NOT good AND both_good AS joined FROM s"""
)
def two_stage_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions (events with a score) that are weak are asked again with the one that their user asked before."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0.0))
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), F.col("value").alias("top_score"), (F.greatest("value", before) * 0.75).alias("both"))
    routed = lambda score: F.when(score >= 50, "answer").otherwise("unknown").alias("route")
    out = retrieval.two_stage(e.select("qid", "top_score", routed(F.col("top_score"))), e.select("qid", F.col("both").alias("top_score"), routed(F.col("both"))))
    return out.withColumn("top_score", F.round("top_score", 6))



@query(
    """WITH a AS (SELECT conv_id, turn, text, length(text) AS n, length(text) - length(replace(text, ',', '')) AS cited, regexp_matches(text, 'ing|ung|tion') AS nothing FROM conversations WHERE role = 'assistant'),
k AS (SELECT *, n <= 200 AND nothing AND cited = 0 AS unknown, array_to_string([x for x in [CASE WHEN contains(text, 'the') THEN 'Dates may change.' END, CASE WHEN n % 2 = 1 THEN 'Fees may change.' END] if x IS NOT NULL], chr(10)) AS notes FROM a)
SELECT conv_id, turn, CASE WHEN unknown THEN 'unknown' ELSE 'answer' END AS answer_type, sha256(CASE WHEN unknown OR notes = '' THEN text ELSE text || chr(10) || chr(10) || notes END) AS answer_sha256,
  CASE WHEN n % 5 < 2 THEN 'unavailable' ELSE 'answer' END AS route, sha256(CASE WHEN n % 5 < 2 THEN 'Please call.' ELSE text END) AS shown_sha256 FROM k"""
)
def reclassified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short answers whose words say that there is nothing, and that cite nothing, become unknown, others get notes; a model that can't be reached has a route of its own."""
    text, n = F.col("text"), F.length("text")
    notes = {"Dates may change.": F.contains(text, F.lit("the")), "Fees may change.": n % 2 == 1}
    after = conversation.reclassified(F.lit("answer"), text, F.regexp_count(text, F.lit(",")), "ing|ung|tion", notes)
    route = conversation.backend_route(F.when(n % 5 == 0, "timeout").when(n % 5 == 1, "reset"), text, "Please call.")
    rows = _replies(spark, sf_dir).select("conv_id", "turn", after.alias("a"), route.alias("r"))
    return rows.select("conv_id", "turn", "a.answer_type", F.sha2("a.answer", 256).alias("answer_sha256"), "r.route", F.sha2("r.answer", 256).alias("shown_sha256"))



@query(
    r"""WITH a AS (SELECT r.conv_id AS id, r.turn, r.text AS a, string_split(r.text, ' ') AS aw, string_split(u.text, ' ') AS qw, length(r.text) AS n FROM conversations r JOIN conversations u ON u.conv_id = r.conv_id AND u.turn = r.turn - 1 AND u.role = 'user' WHERE r.role = 'assistant'),
w AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'clarify' ELSE 'answer' END AS kind, string_split_regex(a, '\n\s*\n')[1] AS lead, list_filter(qw, lambda x: length(x) > 9) AS need, list_filter(aw, lambda x: length(x) > 9) AS got FROM a),
k AS (
  SELECT id, turn, 'type' AS "check", kind = 'answer' AS ok FROM w UNION ALL SELECT id, turn, 'retrieval', list_has_any(qw, aw) FROM w UNION ALL SELECT id, turn, 'retrieval_at_1', list_contains(qw, aw[1]) FROM w
  UNION ALL SELECT id, turn, 'mention', regexp_matches(a, 'the|de') AND contains(a, 'ion') FROM w UNION ALL SELECT id, turn, 'no_mention', NOT contains(a, 'ung') AND NOT contains(a, 'ing') FROM w WHERE n % 2 = 0
  UNION ALL SELECT id, turn, 'no_lead', NOT contains(lead, 'and') FROM w UNION ALL SELECT id, turn, 'contact', len(list_filter(aw, lambda x: contains(x, qw[1]))) > 0 FROM w WHERE n % 2 = 1
  UNION ALL SELECT id, turn, 'forms', list_has_all(got, need) AND list_has_all(qw, got) FROM w)
SELECT * FROM k"""
)
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of replies against what their questions say, those that apply, a row each: words stand for documents, contacts and forms."""
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.split("text", " ").alias("qw"))
    n, aw = F.length("text"), F.split("text", " ")
    some = lambda *xs: F.array(*map(F.lit, xs))
    long = lambda words: F.filter(words, lambda x: F.length(x) > 9)
    items = _replies(spark, sf_dir).join(asked, ["conv_id", "turn"]).select(
        F.struct("conv_id", "turn").alias("id"), F.lit("g").alias("grp"), F.lit("q").alias("question"), some("answer").alias("expect_type"), F.col("qw").alias("expect_docs"), some("the|de", "ion").alias("must_mention"),
        F.when(n % 2 == 0, some("ung", "ing")).alias("must_not_mention"), some("and").alias("must_not_lead"), F.when(n % 2 == 1, F.slice("qw", 1, 1)).alias("must_contact"), long(F.col("qw")).alias("forms_required"),
        F.col("qw").alias("forms_allowed"), F.col("text").alias("answer"), F.when(n % 3 == 0, "clarify").otherwise("answer").alias("answer_type"), aw.alias("top_docs"), aw.alias("contacts"), long(aw).alias("downloads"),
    )
    return evaluation.answer_checks(items).select("id.*", F.explode("checks").alias("check", "ok")).select(F.col("conv_id").alias("id"), "turn", "check", "ok")



@query("SELECT event_id // 3 AS id, max(event_type) FILTER (event_id % 3 = 0) AS c0, max(event_type) FILTER (event_id % 3 = 1) AS c1, max(event_type) FILTER (event_id % 3 = 2) AS c2 FROM events GROUP BY 1")
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three configurations side by side."""
    e = F.col("event_id")
    runs = read(spark, sf_dir, "events").select(F.concat(F.lit("c"), (e % 3).cast("string")).alias("config"), F.floor(e / 3).alias("id"), "event_type")
    return evaluation.compare_runs(runs, "event_type")


@query(
    """SELECT l.doc_id AS qid, d.doc_id IS NOT NULL AS answered, CASE WHEN d.doc_id IS NOT NULL THEN l.quality END AS quality FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d USING (doc_id)"""
)
def answers_with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their gold rows, and the questions without an answer."""
    golden = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), "quality")
    answers = read(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("qid"))
    both, missing = evaluation.with_gold(answers, golden)
    return both.select("qid", F.lit(True).alias("answered"), "quality").unionByName(missing.select("qid", F.lit(False).alias("answered"), F.lit(None).cast("int").alias("quality")))


@query(
    """SELECT doc_id AS qid, unnest(list_distinct(['A-' || doc_id, 'A-' || (doc_id + 1), CASE WHEN doc_id % 2 = 0 THEN 'A-' || doc_id ELSE 'B-' || doc_id || '-x' END])) AS gold FROM documents"""
)
def golden_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that gold cells name, themselves or by their chunks and parts."""
    d = F.col("doc_id")
    docs = F.format_string("A-%d; A-%d\n,", d, d + 1)
    chunks = F.when(d % 2 == 0, F.format_string("A-%d-0123456789abcdef01234567#p2", d)).otherwise(F.format_string(" B-%d-x ", d))
    golden = read(spark, sf_dir, "documents").select(d.alias("qid"), docs.alias("docs"), chunks.alias("chunks"))
    return evaluation.gold_items(golden).select("qid", F.col("doc_id").alias("gold"))


@query("""SELECT event_type, '{"summary":{"n":' || count(*) || ',"users":' || count(DISTINCT user_id) || '},"rows":' || count(*) FILTER (event_id % 2 = 0) || '}' AS report FROM events GROUP BY event_type""")
def evaluation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    summary = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return evaluation.report(summary, e.filter("event_id % 2 = 0"), "event_type")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r % 6 = 1")
def every_sixth_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.every_nth(read(spark, sf_dir, "events"), 6, "event_type", "event_id").select("event_type", "event_id")


@query("SELECT s_nationkey AS sheet, CAST(s_suppkey + 1 AS INTEGER) AS row, CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier")
def sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows as columns by the texts of their headers, which differ in order by sheet."""
    k, sheet = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    s = read(spark, sf_dir, "supplier")
    turned = lambda a, b: F.when(sheet % 2 == 0, F.array(a, b)).otherwise(F.array(b, a))
    heads = s.select(sheet.alias("sheet"), F.lit(0).alias("row"), turned(F.lit("Key"), F.lit(" Full  name\n")).alias("cells")).distinct()
    rows = s.select(sheet.alias("sheet"), (F.col("s_suppkey") + 1).cast("int").alias("row"), turned(k, F.col("s_name")).alias("cells"))
    return evaluation.by_headers(heads.unionByName(rows), {"key": "Key", "name": "Full name"})
