"""Operator 1, chat formatting by schema fingerprints; DataFrame functions only.

A layout is known by the hash of its nested field paths.  For a record column of
JSON the paths of each row are hashed in the plan, so one column may mix layouts;
for turn rows in columns the paths of the table's schema are.  The hash selects
a declarative mapping to canonical turns (conv_id, turn, role, text), which one
template renders.

Template: ``<|turn|>`` role newline text ``<|end|>`` newline, for each turn.  In
texts a backslash is doubled, and the first character of any control string is
followed by ``\\-``, so no control string survives in a text and reading undoes
it.  Roles are URL-encoded.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Strings that common templates give a meaning.
CONTROLS = (
    TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
)
#: Other names of the three roles in records.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A layout's field paths and where its turns are.

    ``fields``: (role, paths) for each turn, paths joined by an empty line.
    ``items``: (list field, role key, text key) of a list of messages."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        if self.items:
            name, role, text = self.items
            return (name, f"{name}[].{role}", f"{name}[].{text}")
        return tuple(p for _, paths in self.fields for p in paths)


LAYOUTS = (
    Layout("messages", items=("messages", "role", "content")),
    Layout("messages text", items=("messages", "role", "text")),
    Layout("from and value", items=("conversations", "from", "value")),
    Layout("role turns", items=("turns", "role", "text")),
    Layout("prompt and completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt, response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", (("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction and output", (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction, input, output", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction and response", (("user", ("instruction",)), ("assistant", ("response",)))),
)
TURN_ROWS = ("conv_id", "role", "text", "turn")


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def record_fingerprint(record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The fingerprint of a JSON column: of those paths that some layout names.

    Other fields of a record don't count.  The paths of a list are those of its
    first element.  Null if the record is no JSON object."""
    known = sorted({p for x in layouts for p in x.paths})
    lists = sorted({x.items[0] for x in layouts if x.items})
    keys = lambda json: F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    inside = lambda name: F.transform(keys(F.get_json_object(record, f"$.{name}[0]")), lambda k: F.concat(F.lit(f"{name}[]."), k))
    nested = [inside(name) for name in lists]
    paths = F.array_sort(F.array_distinct(F.array_intersect(F.concat(F.json_object_keys(record), *nested), F.array(*map(F.lit, known)))))
    return F.sha2(F.array_join(paths, "\n"), 256)


def _turns_of(layout: Layout, record: str) -> Column:
    if layout.items:
        name, role, text = layout.items
        rows = F.from_json(record, f"`{name}` array<struct<`{role}` string, `{text}` string>>")[name]
        names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
        return F.transform(rows, lambda m: F.struct(F.coalesce(names[F.lower(m[role])], m[role]).alias("role"), m[text].alias("text")))
    values = F.from_json(record, ", ".join(f"`{p}` string" for p in layout.paths))
    join = lambda paths: F.array_join(F.filter(F.array(*(values[p] for p in paths)), lambda x: x.isNotNull() & (x != "")), "\n\n")
    return F.array(*(F.struct(F.lit(role).alias("role"), join(paths).alias("text")) for role, paths in layout.fields))


def turns_from_records(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of JSON records (conv_id, record) of any known layouts, in one pass.

    Records that are null, no JSON object or of no known layout give no turns; see
    ``unmapped_records``.  An empty list of messages gives none either."""
    print_of = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(record).alias("record")).withColumn("print", record_fingerprint("record", layouts))
    turns = F.coalesce(*(F.when(F.col("print") == fingerprint(x.paths), _turns_of(x, "record")) for x in layouts))
    return print_of.select("conv_id", F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def unmapped_records(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records that no mapping takes, with their fingerprint."""
    known = [fingerprint(x.paths) for x in layouts]
    return records.withColumn("fingerprint", record_fingerprint(record, layouts)).filter(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(known))


def turns_from_table(table: DataFrame) -> DataFrame:
    """Canonical turns of a table: its schema's fingerprint selects the mapping."""
    relevant = {*TURN_ROWS, "record"}
    own = fingerprint([c for c in table.columns if c in relevant])
    if own == fingerprint(TURN_ROWS):
        return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    if own == fingerprint(("conv_id", "record")):
        return turns_from_records(table)
    raise ValueError(f"no mapping for columns {table.columns}")


def _control_pattern(controls: tuple[str, ...]) -> str:
    quote = lambda s: "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)
    return "|".join(f"{quote(a)}(?={'|'.join(quote(c[1:]) for c in controls if c[0] == a)})" for a in sorted({c[0] for c in controls}))


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_control_pattern(controls)), F.lit(r"$0\\-"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\(?:-|(\\))"), F.lit("$1"))


def render(turns: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    ``loss_mask`` has, for each assistant turn, its number in the conversation and
    the start and length, in code points, of its text within the turn.  Null roles
    and texts count as empty.  Rows go by turn (null first), equal turns by role
    and text, repeated rows are repeated turns.  A row without a conversation id is a
    conversation of its own.  A conversation is one row, as its digest needs its whole text."""
    role, text = F.url_encode(F.coalesce(F.col("role"), F.lit(""))), escape(F.coalesce(F.col("text"), F.lit("")), controls)
    parts = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), role.alias("head"), text.alias("body"), F.coalesce("text", F.lit("")).alias("text")
    )
    piece = F.concat(F.lit(TURN), "head", F.lit("\n"), "body", F.lit(END + "\n"))
    rows = parts.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.col("role"), F.col("text"), piece.alias("piece"), (F.length("head") + len(TURN) + 1).alias("start"), F.length("body").alias("length")
        ).alias("t"),
    )
    known = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    grouped = known.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array("t").alias("ts")))
    mask = F.transform("ts", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"))))
    return grouped.select("conv_id", F.array_join("ts.piece", "").alias("formatted"), F.filter(mask, lambda m: m.isNotNull()).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_texts, from ``formatted`` and ``loss_mask`` alone."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 2_000_000_000)
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(head(p)) + 2, F.length(p) - F.length(head(p)) - 2 - len(END))
    turn = lambda p: F.struct(F.url_decode(head(p)).alias("role"), unescape(body(p)).alias("text"))
    split = formatted.select("conv_id", "formatted", "loss_mask", pieces.alias("pieces"))
    masked = lambda m: unescape(F.substring(F.get("pieces", m["turn"]), m["start"] - len(TURN) + 1, m["length"]))
    return split.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.transform("loss_mask", masked).alias("loss_texts"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, read back from them."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
