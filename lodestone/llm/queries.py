"""The registered queries of the ten operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bytepairs, chat, curvepack, packing, phrases, pseudonyms, repetition, ruleset, simjoin, topk, toxicity, turnrepair, webpages
from lodestone.llm.tables import Scratch, held_out, read

#: The key of the registered query; a real one comes from a secret store.
PSEUDONYM_KEY = "registered query"
BIN_WORDS = 2048


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 as a prompt and response record."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    turns = chat.turns_from_table(read(spark, sf_dir, "conversations")).unionByName(chat.turns_from_table(extra))
    return chat.chat_digests(chat.render(turns))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.jaccard_join(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins without two documents of a source or of a class of near copies (operator 2)."""
    documents = read(spark, sf_dir, "documents")
    rows = simjoin.with_class(documents, doc_id=F.col("doc_id"), source=F.col("source"), size=packing.words(), text_hash=F.xxhash64("text"))
    own = Scratch(spark, "classes").cut(rows.withColumnRenamed("text_hash", "text"))  # the hash is only to deal rows out
    return packing.best_fit_pack(own, BIN_WORDS, size=F.col("size"), cluster=F.col("class_node"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(read(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytepairs.encode_documents(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpages.extract_pages(read(spark, sf_dir, "pages"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    rules = ruleset.train_quality(documents, read(spark, sf_dir, "labels"))
    return ruleset.quality_scores(documents, rules).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    net = toxicity.train_toxicity(documents, read(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(documents, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with planted faults, repaired."""
    turns = turnrepair.damaged(read(spark, sf_dir, "conversations"))
    return turnrepair.repair_digests(turnrepair.repair(turns, Scratch(spark, "repair")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), Scratch(spark, "phrases"))


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return curvepack.pack(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, Scratch(spark, "curve"), 1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_html_text": op6_html_text,
    "op7_exact_topk": op7_exact_topk,
    "op8_quality_rules": op8_quality_rules,
    "op9_repetition_rules": op9_repetition_rules,
    "op10_toxicity": op10_toxicity,
    "op11_turn_repair": op11_turn_repair,
    "op12_collocations": op12_collocations,
    "op13_curve_packing": op13_curve_packing,
}

_WINDOW = """
w{n} AS (
  SELECT k, sum(CASE WHEN hit > 0 THEN 1 ELSE 0 END) AS words, sum(CASE WHEN hit > 0 THEN length(w) ELSE 0 END) AS chars
  FROM (
    SELECT k, w, max(again) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS hit
    FROM (
      SELECT k, i, w, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY k, g) > 1 THEN 1 ELSE 0 END AS again
      FROM (SELECT k, i, w, CASE WHEN i + {back} <= n THEN array_to_string(list_slice(ws, i, i + {back}), ' ') END AS g FROM words)
    )
  ) GROUP BY k
)"""

_OP9 = (
    """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, text FROM d),
words AS (SELECT k, ws, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM lists),
"""
    + ",".join(_WINDOW.format(n=n, back=n - 1) for n in (5, 7, 10))
    + """,
lines AS (SELECT k, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT k, string_split(text, chr(10)) AS ls FROM d)),
dup AS (
  SELECT k, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars
  FROM (SELECT k, line, row_number() OVER (PARTITION BY k, line ORDER BY i) AS r FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]'))
  WHERE r > 1 GROUP BY k
),
m AS (
  SELECT d.doc_id, len(l.ws) AS n_words,
    length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(w5.words, 0) AS n_repeat_words,
    coalesce(w5.chars, 0) AS dup_chars_5, coalesce(w7.chars, 0) AS dup_chars_7, coalesce(w10.chars, 0) AS dup_chars_10,
    coalesce(dup.chars, 0) AS dup_line_chars
  FROM d JOIN lists l USING (k) LEFT JOIN w5 USING (k) LEFT JOIN w7 USING (k) LEFT JOIN w10 USING (k) LEFT JOIN dup USING (k)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  CAST(dup_chars_5 AS BIGINT) AS dup_chars_5, CAST(dup_chars_7 AS BIGINT) AS dup_chars_7, CAST(dup_chars_10 AS BIGINT) AS dup_chars_10,
  CAST(dup_line_chars AS BIGINT) AS dup_line_chars,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * dup_chars_5 <= 20 * word_chars
    AND 100 * dup_chars_7 <= 18 * word_chars AND 100 * dup_chars_10 <= 15 * word_chars AND 100 * dup_line_chars <= 20 * word_chars AS kept
FROM m
"""
)

_CONTROL_COUNT = " + ".join(f"(len(x) - len(replace(x, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS)
_OP1 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, {len(chat.TURN) + len(chat.END) + 2} + len(r) + len(x) + len(x) - len(replace(x, chr(92), '')) + 2 * ({_CONTROL_COUNT}) AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN len(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY turn NULLS FIRST, r, x), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id, alone
"""

_OP7 = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.k, q.vec_id AS query_id, v.vec_id, CAST(list_sum([q.e[i] * v.e[i] for i in range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.k <> v.k AND len(q.e) = len(v.e)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _step(state: str, cost: str, letter: str) -> str:
    """A state's cost and audit, the cost in ten digits, with one more edit; null stays null."""
    return f"lpad(CAST(CAST(left({state}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({state}, 11) || '{letter}'"


_I = [f"q{i}" for i in range(4)]  # the states with insertions made before the turn
_INSERTED = {
    "q0": "s0", "q1": "s1", "q2": _least("s2", *(_step(x, "2", "I") for x in ("s0", "s1", "s3"))),
    "q3": _least("s3", _step("s2", "2", "I"), *(_step(_step(x, "2", "I"), "2", "I") for x in ("s0", "s1"))),
}
_KEEPS = {0: [], 1: [("q0", "s")], 2: [("q0", "u"), ("q1", "u"), ("q3", "u")], 3: [("q2", "a")]}
_REROLES = {0: [], 1: [], 2: ["q0", "q1", "q3"], 3: ["q2"]}
_EDITED = {
    j: _least(
        _step(f"q{j}", "3", "D"),
        *(f"CASE WHEN NOT gone AND initial = '{c}' THEN {_step(i, 'more', 'K')} END" for i, c in _KEEPS[j]),
        *(f"CASE WHEN NOT gone THEN {_step(i, '2 + more', 'R')} END" for i in _REROLES[j]),
    )
    for j in range(4)
}
_OP11 = f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
codes AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
kinds AS (
  SELECT g.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295) % 20 AS kind
  FROM given g, codes
), harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i, rtrim(text, {_WS}) AS t FROM harmed
), judged AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, t = '' AS blank, t <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    right(t, 1) NOT IN ('.', '!', '?') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS broken
  FROM placed
), turns AS (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND open THEN 1 ELSE 0 END AS more FROM judged),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    sum(more) AS truncated, count(*) FILTER (broken) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id
), scan AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '0000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM facts
  UNION ALL
  SELECT conv_id, i, {', '.join(f'{_EDITED[j]} AS s{j}' for j in range(4))}
  FROM (SELECT t.conv_id, t.i, t.initial, t.gone, t.more, {', '.join(f'{v} AS {k}' for k, v in _INSERTED.items())} FROM scan s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1)
), ends AS (
  SELECT s.conv_id, least(s0, {_INSERTED['q3']}) AS best
  FROM scan s JOIN facts f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.i
), edits AS (
  SELECT conv_id, e, j, CAST(sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS made
  FROM (SELECT conv_id, unnest(string_split(substr(best, 11), '')) AS e, unnest(range(length(best) - 10)) AS j FROM ends WHERE length(best) > 10)
  WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), roles AS (
  SELECT e.conv_id, e.j, CASE WHEN e.e = 'K' THEN t.role WHEN (made + bool_or(e.e = 'K' AND t.initial = 's') OVER (PARTITION BY e.conv_id)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN e.e = 'I' THEN '' ELSE t.text END AS text
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i WHERE e.e <> 'D'
), texts AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY j)) AS h FROM roles GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(best, 10), '0') AS BIGINT) AS cost, coalesce(substr(best, 11), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_OP12 = """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS k, piece
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS m))
), f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT lang, m, g, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), scores AS (
  SELECT t.lang, t.m, t.g, t.a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * t.a) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts t JOIN f l ON l.lang = t.lang AND l.g = t.x AND l.m = t.k JOIN f r ON r.lang = t.lang AND r.g = t.y AND r.m = t.m - t.k
), lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = s.lang AND c.m > s.m AND contains(' ' || c.g || ' ', ' ' || s.g || ' ') AND 100 * c.a >= 80 * s.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {"op12_collocations": _OP12, "op11_turn_repair": _OP11, "op1_chat_format": _OP1, "op7_exact_topk": _OP7, "op9_repetition_rules": _OP9}
