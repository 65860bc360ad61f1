"""Approval of chunks for an index: sources, currentness, the decision, the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SourcePolicy:
    """What may be indexed.  ``flag_notes``: review flags that pass, with the note that they add (None: none)."""

    allowed_hosts: tuple[str, ...]
    blocked_paths: tuple[str, ...] = ()
    blocked_query: dict[str, tuple[str, ...]] = field(default_factory=dict)
    excluded_kinds: tuple[str, ...] = ()
    superseded: dict[str, str] = field(default_factory=dict)
    flag_notes: dict[str, str | None] = field(default_factory=dict)
    excluding_flags: tuple[str, ...] = ()
    valid_days: int = 30


def decoded(url: Column, times: int = 5) -> Column:
    """The URL with percent escapes undone until nothing changes, at most ``times`` times."""
    for _ in range(times):
        url = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    return url


def blocked(url: Column, policy: SourcePolicy) -> Column:
    """A path prefix or a query value of the deny list, decoded and in any case; a null url is not."""
    plain = F.lower(decoded(url))
    path, query = F.coalesce(F.try_parse_url(F.lower(url), F.lit("PATH")), F.lit("")), F.regexp_extract(plain, r"\?([^#]*)", 1)
    path = F.lower(decoded(path))
    hit = F.lit(False)
    for prefix in policy.blocked_paths:
        hit = hit | path.startswith(prefix.lower())
    for key, values in policy.blocked_query.items():
        own = F.regexp_extract_all(query, F.lit(f"(?:^|&){key.lower()}=([^&]*)"), F.lit(1))
        hit = hit | F.arrays_overlap(own, F.array(*(F.lit(v.lower()) for v in values)))
    return F.coalesce(hit, F.lit(False))


def url_admitted(url: Column, policy: SourcePolicy) -> Column:
    """https, an allowed host, no user, port or fragment, and not blocked; blocking beats allowing."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    plain = (part("PROTOCOL") == "https") & part("HOST").isin(*policy.allowed_hosts) & part("USERINFO").isNull() & part("REF").isNull()
    return F.coalesce(plain & (part("AUTHORITY") == part("HOST")), F.lit(False)) & ~blocked(url, policy)


def _notes(flags: Column, policy: SourcePolicy) -> Column:
    if not policy.flag_notes:
        return F.array().cast("array<string>")
    notes = F.create_map(*(F.lit(x) for k, v in policy.flag_notes.items() for x in (k, v or "")))
    return F.filter(F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda f: notes[f]), lambda n: n != "")


def decide(chunks: DataFrame, checks: DataFrame, policy: SourcePolicy) -> DataFrame:
    """status and notes of each chunk, by the first rule that applies.

    ``chunks``: chunk_id, doc_id, source_url, chunk_kind, text, chunk_text_sha256, source_snapshot,
    review_flags, date_status.  ``checks``: doc_id, latest_snapshot, current (null: not checked), detail."""
    host = F.try_parse_url(F.col("source_url"), F.lit("HOST"))
    flags = F.coalesce("review_flags", F.array().cast("array<string>"))
    known = F.array(*map(F.lit, policy.flag_notes)) if policy.flag_notes else F.array().cast("array<string>")
    excluding = F.array(*map(F.lit, policy.excluding_flags)) if policy.excluding_flags else F.array().cast("array<string>")
    # The first flag that ends the matter: one that excludes, or one that the policy doesn't know.
    ending = F.get(F.filter(flags, lambda f: F.array_contains(excluding, f) | ~F.array_contains(known, f)), F.lit(0))
    conflict = F.when(F.col("date_status") == "conflicting", F.array(F.lit("conflicting dates"))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(_notes(flags, policy), conflict)
    superseded = F.col("doc_id").cast("string").isin(*policy.superseded) if policy.superseded else F.lit(False)
    kinds = F.coalesce(F.col("chunk_kind").isin(*policy.excluded_kinds), F.lit(False)) if policy.excluded_kinds else F.lit(False)
    broken = (F.trim(F.coalesce("text", F.lit(""))) == "") | ~F.coalesce(F.sha2("text", 256) == F.col("chunk_text_sha256"), F.lit(False))
    reason = (
        F.when(blocked(F.col("source_url"), policy), "excluded: blocked source")
        .when(~F.coalesce(host.isin(*policy.allowed_hosts), F.lit(False)), "held: host not allowed")
        .when(kinds, "excluded: kind")
        .when(superseded, "excluded: superseded")
        .when(broken, "held: empty text or wrong hash")
        .when(F.col("latest_snapshot").isNotNull() & (F.col("source_snapshot") != F.col("latest_snapshot")), "held: not of the latest snapshot")
        .when(F.col("current").isNull(), "held: not checked")
        .when(~F.col("current"), F.concat(F.lit("held: "), F.coalesce("detail", F.lit("changed"))))
        .when(F.array_contains(excluding, ending), "excluded: flag")
        .when(ending.isNotNull(), F.concat(F.lit("held: unknown flag "), ending))
    )
    status = F.when(reason.isNotNull(), F.substring_index("reason", ": ", 1)).when(F.size(notes) > 0, "approved_with_notes").otherwise("approved")
    joined = chunks.join(checks, "doc_id", "left").withColumn("reason", reason)
    return joined.select("chunk_id", "doc_id", status.alias("status"), F.when(F.col("reason").isNull(), notes).otherwise(F.array(F.substring_index("reason", ": ", -1))).alias("notes"), "chunk_text_sha256")


def apply_ledger(chunks: DataFrame, ledger: DataFrame, checked_at: Column, now: Column, policy: SourcePolicy) -> DataFrame:
    """chunk_id, index_approved and review_status by a ledger (chunk_id, status, chunk_text_sha256).

    Approved needs an approving status and the same text hash; else 'stale', the
    ledger's status, or 'not_reviewed'.  A ledger older than the policy's days stops the job."""
    fresh = checked_at >= now - F.make_interval(days=F.lit(policy.valid_days))
    own = ledger.select("chunk_id", F.col("status").alias("decided"), F.col("chunk_text_sha256").alias("decided_sha"))
    same = F.coalesce(F.col("decided_sha") == F.col("chunk_text_sha256"), F.lit(False))
    good = F.col("decided").isin("approved", "approved_with_notes")
    status = F.when(F.col("decided").isNull(), "not_reviewed").when(~same, "stale").otherwise(F.col("decided"))
    guard = F.when(fresh, F.lit(True)).otherwise(F.raise_error(F.lit("the approval ledger is too old")).cast("boolean"))
    return chunks.join(own, "chunk_id", "left").select("chunk_id", "doc_id", (guard & F.coalesce(good & same, F.lit(False))).alias("index_approved"), status.alias("review_status"))


def status_counts(decisions: DataFrame) -> DataFrame:
    """(doc_id, status, n) by document and in total (null doc_id), in one pass."""
    out = decisions.groupingSets([["doc_id", "status"], ["status"]], "doc_id", "status")
    return out.agg(F.grouping("doc_id").cast("boolean").alias("total"), F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the highest order value; ties by all columns."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*")


def changed_versions(stored: DataFrame, current: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, state): new, gone, changed or same, by a null-safe comparison of the columns."""
    a, b = stored.select(key, F.struct(*columns).alias("old")), current.select(key, F.struct(*columns).alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def page_current(stored: Column, now: Column, volatile: str) -> Column:
    """(ok, detail): whether a page says the same but for ``volatile`` parts; a failed look-up (null) is not ok."""
    same = F.regexp_replace(stored, volatile, "") == F.regexp_replace(now, volatile, "")
    return F.struct(F.coalesce(same, F.lit(False)).alias("ok"), F.when(now.isNull(), "look-up failed").when(~same, "changed").otherwise("same").alias("detail"))


def reusable(previous: DataFrame, chunks: DataFrame) -> DataFrame:
    """The documents of which every chunk has a decision for the same text."""
    own = previous.select("chunk_id", F.col("chunk_text_sha256").alias("sha"), F.col("status"))
    same = F.coalesce((F.col("sha") == F.col("chunk_text_sha256")) & F.col("status").isNotNull(), F.lit(False))
    return chunks.join(own, "chunk_id", "left").groupBy("doc_id").agg(F.bool_and(same).alias("all")).filter("all").select("doc_id")


def selected(chunks: DataFrame, policy: SourcePolicy) -> tuple[DataFrame, DataFrame]:
    """The chunks to index, and (reason, n) of the others.  A blocked source stops the job."""
    url = F.when(blocked(F.col("source_url"), policy), F.raise_error(F.concat(F.lit("blocked source: "), F.col("source_url")))).otherwise(F.col("source_url"))
    superseded = F.col("doc_id").cast("string").isin(*policy.superseded) if policy.superseded else F.lit(False)
    kind = F.coalesce(F.col("chunk_kind").isin(*policy.excluded_kinds), F.lit(False)) if policy.excluded_kinds else F.lit(False)
    rows = chunks.withColumn("source_url", url).withColumn("_reason", F.when(kind, "kind").when(superseded, "superseded"))
    return rows.filter("_reason is null").drop("_reason"), rows.filter("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def law_current(stored_serial: Column, stored_date: Column, serial: Column, date: Column, chunk_dates: Column, today: Column) -> Column:
    """(ok, detail): a law is current if serial and date are those of the look-up, the date is over
    and all chunks have it; a failed look-up (null serial) is not ok."""
    detail = (
        F.when(serial.isNull(), "look-up failed").when(~stored_serial.eqNullSafe(serial) | ~stored_date.eqNullSafe(date), "changed")
        .when(date > today, "not yet in force").when(~F.forall(chunk_dates, lambda d: d.eqNullSafe(date)), "chunks of another date").otherwise("same")
    )
    return F.struct((detail == "same").alias("ok"), detail.alias("detail"))


def file_current(stored_sha256: Column, sha256: Column) -> Column:
    """(ok, detail) of a file by its hash; no hash is a failed look-up."""
    detail = F.when(sha256.isNull(), "look-up failed").when(stored_sha256.eqNullSafe(sha256), "same").otherwise("changed")
    return F.struct((detail == "same").alias("ok"), detail.alias("detail"))


def table_current(stored: Column, first: Column, again: Column) -> Column:
    """(ok, detail) of a table's rows (arrays, in any order); an empty look-up is tried ``again``, and if that is
    empty too it has failed and says nothing of a change."""
    some = lambda rows: F.coalesce(F.size(rows), F.lit(0)) > 0
    found = F.when(some(first), first).when(some(again), again)
    detail = F.when(found.isNull(), "look-up failed").when(F.array_sort(found) == F.array_sort(stored), "same").otherwise("changed")
    return F.struct((detail == "same").alias("ok"), detail.alias("detail"))


def only_current(listed: DataFrame, *keep: str) -> DataFrame:
    """(name, ...): of the laws listed under a name (name, current, ...) the one that is current; a name with none
    or several stops the job."""
    one = F.when(F.count_if("current") == 1, F.min(F.when(F.col("current"), F.struct(*keep)))).otherwise(F.raise_error(F.concat(F.lit("not exactly one current "), F.col("name"))))
    return listed.groupBy("name").agg(one.alias("r")).select("name", "r.*")


def disagreements(catalog: DataFrame, policy: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, problem): entries that only one of two tables has, or whose columns differ."""
    a, b = (d.select(key, F.struct(*columns).alias(n)) for d, n in ((catalog, "a"), (policy, "b")))
    differing = F.array_join(F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull()), ",")
    problem = F.when(F.col("a").isNull(), "only in the policy").when(F.col("b").isNull(), "only in the catalog").when(differing != "", differing)
    return a.join(b, key, "full").select(key, problem.alias("problem")).filter("problem is not null")
