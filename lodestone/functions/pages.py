"""Page and answer texts as expressions: markup to text, cells, addresses, answer blocks, trailers."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import text as tx

PHONE = r"\b0\d{1,2}-\d{3,4}-\d{4}\b"


@F.pandas_udf(StringType())
def _unescaped(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else html.unescape(x))


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def _closed_reference(m: re.Match) -> str:
    return m[0] if m[1] and m[1] + ";" not in html5 else html.unescape(m[0])


@F.pandas_udf(StringType())
def _closed_unescaped(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else _CLOSED.sub(_closed_reference, x))


def unescaped(c: Column, closed: bool = False) -> Column:
    """Character references decoded, as HTML 5 does also those without a semicolon, or, if ``closed``, only
    those with one; only texts that have any go to Python."""
    return F.when(F.contains(c, F.lit("&")), (_closed_unescaped if closed else _unescaped)(c)).otherwise(c)


def between(c: Column, start: str, end: str) -> Column:
    """The text between the only start and the only end marker; null if there is not exactly one of each, in order."""
    one = lambda mark: F.size(F.split(c, f"\\Q{mark}\\E", -1)) == 2
    first, last = F.instr(c, F.lit(start)), F.instr(c, F.lit(end))
    return F.when(one(start) & one(end) & (last > first), F.substring(c, first + len(start), last - first - len(start)))


def markup_text(c: Column, closed: bool = False) -> Column:
    """HTML as lines: scripts, styles and comments gone, blocks on lines of their own, list items after
    '- ', cells joined by ' | ', an image's alternative text in brackets.  ``closed`` as in ``unescaped``."""
    return _as_lines(unescaped(_unmarked(c), closed))


def _unmarked(c: Column) -> Column:
    steps = (
        (r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", ""),
        (r"(?i)<img\b[^>]*?\balt\s*=\s*\"([^\"]+)\"[^>]*>", "[$1]"),
        (r"(?U)\s+", " "),
        (r"(?i)<li\b[^>]*>", "\n- "),
        (r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | "),
        (r"(?i)<(?:br|hr|/?(?:p|div|section|article|header|footer|ul|ol|table|thead|tbody|tr|h[1-6]|dl|dt|dd|blockquote|pre|form|nav))\b[^>]*>", "\n"),
        (r"<[^>]*>", ""),
    )
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def _as_lines(c: Column) -> Column:
    """Lines without white space around them and with runs of it as one space; none is empty."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"(?U)[\s&&[^\n]]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


#: The references that ``html.escape`` writes; & comes last, as what it gives is no reference.
_ESCAPES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x27;": "'", "&amp;": "&"}


def markup_texts(rows: DataFrame, name: str, closed: bool = False) -> DataFrame:
    """``rows`` with the column ``name`` as ``markup_text`` makes it, for large tables: each step is a projection, so that markup is taken
    out once and not for each use of the text, and only texts with other references than those of ``html.escape`` go to Python."""
    c = F.col(name)
    plain = reduce(lambda x, e: F.replace(x, F.lit(e), F.lit(_ESCAPES[e])), _ESCAPES, c)
    others = c.rlike("&(?!(?:lt|gt|quot|#x27|amp);)")
    decoded = F.when(F.col("other"), (_closed_unescaped if closed else _unescaped)(F.when(F.col("other"), c))).otherwise(plain)
    own = rows.withColumn(name, _unmarked(c)).withColumn("other", others).withColumn(name, decoded).drop("other")
    return own.withColumn(name, _as_lines(c))


def body_text(c: Column, start: str, end: str, least: int = 20, closed: bool = False) -> Column:
    """(text, problem) of a page's bounded body: a missing or repeated boundary and a short text are problems."""
    inside = between(c, start, end)
    text = markup_text(inside, closed)
    problem = F.when(inside.isNull(), "no single boundary").when(F.length(text) < least, "too short")
    return F.struct(F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


def page_contact(c: Column, label: str, phone: str = PHONE) -> Column:
    """(department, phone) from the line of a page that begins with ``label``; null if there is none."""
    own = F.get(F.filter(tx.lines(c), lambda x: tx.strip(x).startswith(label)), F.lit(0))
    dept = tx.squeeze(F.regexp_replace(F.substring(tx.strip(own), F.lit(len(label) + 1), F.length(own)), f"{phone}|[:|]", " "))
    return F.when(own.isNotNull(), F.struct(F.nullif(dept, F.lit("")).alias("department"), F.nullif(F.regexp_extract(own, f"({phone})", 1), F.lit("")).alias("phone")))


def body_or_content(c: Column, start: str, end: str, content: str, least: int = 20, closed: bool = False) -> Column:
    """The text of a page's bounded body, else (pages of another layout) of what the first group of ``content`` matches.
    ``closed`` as in ``unescaped``."""
    return F.coalesce(body_text(c, start, end, least, closed)["text"], F.nullif(markup_text(F.regexp_extract(c, content, 1), closed), F.lit("")))


def without_leading(lines: Column, furniture: Column | Callable[[Column], Column]) -> Column:
    """Lines without those at the start that are in ``furniture``, an array or what makes one of the lines.

    Lines and furniture are bound once, so a text takes time in proportion to its lines."""

    def kept(own: Column) -> Column:
        wanted = furniture(own) if callable(furniture) else furniture
        return tx.bound(wanted, lambda names: _from_first(own, F.array_position(F.transform(own, lambda x: F.array_contains(names, x)), False)))

    return tx.bound(lines, kept)


def _from_first(lines: Column, first: Column) -> Column:
    return tx.bound(first, lambda at: F.when(at > 0, F.slice(lines, at.cast("int"), F.size(lines))).otherwise(F.slice(lines, 1, 0)))


def phones(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({PHONE})"), F.lit(1)))


def impossible_times(c: Column) -> Column:
    """Clock times in a text that no clock shows."""
    times = F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{1,2}:\d{2})(?!\d)"), F.lit(1))
    part = lambda t, i: F.get(F.split(t, ":"), F.lit(i)).cast("int")
    return F.filter(times, lambda t: (part(t, 0) > 24) | (part(t, 1) > 59) | ((part(t, 0) == 24) & (part(t, 1) > 0)))


def says_no_evidence(answer: Column, pattern: str, most: int = 200) -> Column:
    """A short answer whose words say that there is nothing to go by."""
    return (F.length(answer) <= most) & answer.rlike(pattern)


def answer_blocks(c: Column) -> Column:
    """(kind, text, cited) of an answer's lines: ordered, bullet or paragraph, without its mark and citations."""
    own = F.filter(F.transform(tx.lines(c), tx.strip), lambda x: x != "")
    kind = lambda x: F.when(x.rlike(r"^\d+[.)]\s"), "ordered").when(x.rlike(r"^[-*•]\s"), "bullet").otherwise("paragraph")
    plain = lambda x: tx.squeeze(F.regexp_replace(F.regexp_replace(x, r"^(?:\d+[.)]|[-*•])\s+", ""), r"\[\d+\]|\*\*", ""))
    return F.transform(own, lambda x: F.struct(kind(x).alias("kind"), plain(x).alias("text"), tx.citations(x).alias("cited")))


def _members(c: Column, key: str) -> Column:
    """The values (variants) that the first JSON object in a text has under a key, in order; null if it has no whole object."""
    start = F.instr(c, F.lit("{"))
    own = F.when(start > 0, F.substring(c, start, F.length(c)))
    entries = F.map_entries(F.from_json(own, "map<string,variant>"))  # a key that is repeated is there as often
    return F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["value"])


def _elements(c: Column, key: str) -> Column:
    """The elements of the lists under a key, if the first value under it is a list."""
    lists = F.transform(_members(c, key), lambda v: F.try_variant_get(v, "$", "array<variant>"))
    return F.when(F.get(lists, F.lit(0)).isNotNull(), F.flatten(F.filter(lists, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<variant>"))


def trailer(c: Column, actions: tuple[str, ...] | None = None, most: int = 4, longest: int = 50, kinds: tuple[str, ...] = ("answer", "clarify", "unknown")) -> Column:
    """The first JSON object of a trailer: type, options, actions, forms, all read in the JVM.

    Lists under one key are joined if the first value is one, of other repeated values the first counts.  Options are texts
    of 1 to ``longest`` characters without the space around them, ``most`` at most, and only a question back has them;
    without any it is an answer, as is another type or no whole object.  Actions are texts, of ``actions`` if given; forms
    are whole numbers or texts of digits.  Repeated elements count once."""
    texts = lambda key: F.transform(F.filter(_elements(c, key), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))
    options = F.slice(F.array_distinct(F.filter(F.transform(texts("options"), tx.strip), lambda x: F.length(x).between(1, longest))), 1, most)
    kind = F.try_variant_get(F.get(_members(c, "type"), F.lit(0)), "$", "string")
    kind = F.when(kind.isin(*kinds), kind).otherwise("answer")
    kind = F.when((kind == "clarify") & (F.coalesce(F.size(options), F.lit(0)) == 0), "answer").otherwise(kind)
    named = F.filter(texts("actions"), lambda x: x.isin(*actions)) if actions is not None else texts("actions")
    number = lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "int")).when(F.schema_of_variant(v) == "STRING", F.regexp_extract(F.variant_get(v, "$", "string"), r"^\s*(\d+)\s*$", 1).try_cast("int"))
    forms = F.filter(F.transform(_elements(c, "forms"), number), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return F.struct(kind.alias("type"), F.when(kind == "clarify", options).otherwise(none).alias("options"), F.array_distinct(named).alias("actions"), F.array_distinct(forms).alias("forms"))
