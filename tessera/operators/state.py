"""Scoped stores and control-plane decisions as functions of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which status may follow which.
TRANSITIONS = {
    "queued": ["running", "cancelled"],
    "running": ["paused", "completed", "failed", "cancelled"],
    "paused": ["running", "cancelled"],
    "failed": ["queued"],
    "completed": [],
    "cancelled": [],
}


def in_scope(user: str | None, workspace: str | None, owner_col: str = "owner", workspace_col: str = "workspace") -> Column:
    """Rows of one's own, or shared in one's workspace; rows without owner belong to all."""
    return F.col(owner_col).isNull() | (F.col(owner_col) == F.lit(user)) | F.coalesce(F.col(workspace_col) == F.lit(workspace), F.lit(False))


def recent_messages(turns: DataFrame, keep: int = 6, caps: dict[str, int] | None = None) -> DataFrame:
    """The last `keep` turns of each conversation, texts cut by role (user 400, others 700).

    turns: conv_id, turn, role, text.
    """
    caps = {"user": 400} | (caps or {})
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    cap = F.lit(700)
    for role, n in caps.items():
        cap = F.when(F.col("role") == role, n).otherwise(cap)
    recent = turns.withColumn("age", F.row_number().over(order)).where(F.col("age") <= keep)
    return recent.select("conv_id", "turn", "role", F.substring("text", F.lit(1), cap).alias("text"))


def prune(rows: DataFrame, by: tuple[str, ...], keep: int, newest_col: str, tie: str) -> DataFrame:
    """The rows to delete: all but the newest `keep` of each owner."""
    order = Window.partitionBy(*by).orderBy(F.desc(newest_col), F.desc(tie))
    return rows.withColumn("age", F.row_number().over(order)).where(F.col("age") > keep).drop("age")


def claimable(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks a worker may claim: queued and due, or running with an expired lease; attempt counts up.

    tasks: task_id, status, due_at, lease_until, attempt.
    """
    queued = (F.col("status") == "queued") & (F.col("due_at").isNull() | (F.col("due_at") <= now))
    expired = (F.col("status") == "running") & (F.col("lease_until") <= now)
    return tasks.where(queued | expired).select("task_id", F.when(queued, "queued").otherwise("expired").alias("why"), (F.col("attempt") + 1).alias("attempt"))


def illegal_transitions(history: DataFrame, by: str = "run_id", order: str = "seq") -> DataFrame:
    """by, order, previous, status of each step that the transition table doesn't allow."""
    legal = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    rows = history.withColumn("previous", F.lag("status").over(Window.partitionBy(by).orderBy(order)))
    allowed = F.coalesce(F.array_contains(legal[F.col("previous")], F.col("status")), F.lit(False))
    return rows.where(F.col("previous").isNotNull() & (F.col("previous") != F.col("status")) & ~allowed).select(by, order, "previous", "status")


#: Rows of a page: the most, and what counts where none is given.
PAGE_MOST, PAGE_DEFAULT = 1000, 200


def page_size(wanted: int | str | None) -> int | None:
    """A page's rows within 1 to PAGE_MOST; None for "all"."""
    if wanted == "all":
        return None
    try:
        return min(PAGE_MOST, max(1, int(wanted))) if wanted is not None else PAGE_DEFAULT
    except ValueError:
        return PAGE_DEFAULT


def audit_filter(rows: DataFrame, scope: dict | None = None, asked_scope: dict | None = None, time_col: str = "ts", start=None, end=None) -> DataFrame:
    """Rows of the caller's scope from start on and before end; none, where another scope is asked for."""
    for name, value in (scope or {}).items():
        wanted = (asked_scope or {}).get(name)
        rows = rows.where(F.lit(False) if wanted is not None and wanted != value else F.col(name) == value)
    if start is not None:
        rows = rows.where(F.col(time_col) >= F.lit(start).cast(rows.schema[time_col].dataType))
    if end is not None:
        rows = rows.where(F.col(time_col) < F.lit(end).cast(rows.schema[time_col].dataType))
    return rows


def audit_page(rows: DataFrame, page: int, size: int | str | None, order: list[Column], **filters) -> DataFrame:
    """One page of the rows that meet the given equalities (None: any), with the total beside it."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    size = page_size(size)
    if size is None:
        return rows.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit((page + 1) * size).offset(page * size).join(F.broadcast(total))


def audit_after(rows: DataFrame, last: DataFrame | None, size: int | None, time_col: str = "ts", id_col: str = "id", **filters) -> DataFrame:
    """The page, newest first, that follows a row seen last: however deep, each task keeps size rows.

    last: one row of time_col and id_col (no row, or None: the first page). Rows of the same time are told apart by
    id; rows without time or id are never on a page. size as in page_size(), without "all".
    """
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    place = F.struct(time_col, id_col)
    rows = rows.where(F.col(time_col).isNotNull() & F.col(id_col).isNotNull())
    if last is not None:
        seen = last.agg(F.max(place).alias("seen"))
        rows = rows.join(F.broadcast(seen)).where(F.col("seen").isNull() | (place < F.col("seen"))).drop("seen")
    return rows.orderBy(F.desc(time_col), F.desc(id_col)).limit(page_size(size))


def latest_snapshot(rows: DataFrame, keys: tuple[str, ...], newest: list[str]) -> DataFrame:
    """The newest row of each key: latest wins, ties by the later columns of newest."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in others])


def insert_new(existing: DataFrame, arrivals: DataFrame, key: str) -> DataFrame:
    """Arrivals whose key neither exists nor came earlier among them: an idempotent insert."""
    first = arrivals.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in arrivals.columns if c != key]))).where("turn = 1").drop("turn")
    return first.join(existing.select(key), key, "left_anti")


def merge_uploads(parts: DataFrame) -> DataFrame:
    """upload_id, complete, parts, bytes, sha256: parts joined in order once all have arrived.

    parts: upload_id, part (from 0), total, body. The body of an upload is one file, so one row.
    """
    whole = parts.groupBy("upload_id").agg(F.count_distinct("part").alias("parts"), F.max("total").alias("total"), F.max("part").alias("last"), F.array_sort(F.collect_set(F.struct("part", "body"))).alias("all"))
    body = F.concat_ws("", F.transform("all", lambda p: p["body"]))
    complete = (F.col("parts") == F.col("total")) & (F.col("last") + 1 == F.col("total"))
    return whole.select("upload_id", complete.alias("complete"), "parts", F.when(complete, F.octet_length(body)).cast("long").alias("bytes"), F.when(complete, F.sha2(body, 256)).alias("sha256"))


def rank_memories(notes: DataFrame, question: str, limit: int = 8) -> DataFrame:
    """owner, note_id, weight, place: preferences first (100), notes by shared terms. notes: owner, note_id, kind, text."""
    from tessera.functions.scores import keyword_score
    from tessera.functions.text import term_set

    asked = term_set(F.lit(question))
    shared = F.coalesce(keyword_score(asked, term_set(F.col("text"))), F.lit(0.0)) * F.size(asked)
    weight = F.when(F.col("kind") == "preference", 100.0).otherwise(shared)
    order = Window.partitionBy("owner").orderBy(F.desc("weight"), "note_id")
    rows = notes.select("owner", "note_id", weight.alias("weight")).where("weight > 0")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def resolve_routes(wanted: DataFrame, candidates: DataFrame, policy: DataFrame) -> DataFrame:
    """workspace, operation, model, status, rejected: the first allowed model of each operation.

    wanted: workspace, operation. candidates: operation, position, model. policy: workspace, blocked
    (array), allowed (array; empty allows all).
    """
    rows = wanted.join(candidates, "operation", "left").join(policy, "workspace", "left")
    blocked = F.coalesce(F.array_contains("blocked", F.col("model")), F.lit(False))
    listed = F.coalesce((F.size("allowed") <= 0) | F.array_contains("allowed", F.col("model")), F.lit(True))
    rows = rows.withColumn("ok", F.col("model").isNotNull() & ~blocked & listed)
    picked = rows.groupBy("workspace", "operation").agg(
        F.min_by("model", F.when(F.col("ok"), F.col("position"))).alias("chosen"), F.bool_or("ok").alias("any"), F.count("model").alias("known"), F.count_if(F.col("model").isNotNull() & ~F.col("ok")).alias("rejected")
    )
    status = F.when(F.col("any"), "selected").when(F.col("known") > 0, "blocked").otherwise("not_found")
    return picked.select("workspace", "operation", F.when(F.col("any"), F.col("chosen")).alias("model"), status.alias("status"), "rejected")


IDENTITY = ("doc_id", "chunk_index", "page_number", "file_name")


def attach_evidence(citations: DataFrame, contexts: DataFrame, by: str = "answer_id") -> DataFrame:
    """citations with evidence: the text of the first context that fits.

    Both have by, rank and some of IDENTITY; contexts have position and text. Where either has a
    rank, ranks must agree; else document and chunk; and no identity that both give may differ.
    """
    shared = [c for c in IDENTITY if c in citations.columns and c in contexts.columns]
    numbered = citations.withColumn("citation_no", F.row_number().over(Window.partitionBy(by).orderBy(F.col("rank").isNull(), "rank", *shared)))
    found = contexts.select(by, F.col("rank").alias("c_rank"), "position", "text", *[F.col(c).alias(f"c_{c}") for c in shared])
    ranked = numbered.where("rank IS NOT NULL").join(found.where("c_rank IS NOT NULL"), by).where("rank = c_rank")
    both = numbered.where("rank IS NULL").join(found.where("c_rank IS NULL"), by).where("doc_id = c_doc_id AND chunk_index = c_chunk_index") if {"doc_id", "chunk_index"} <= set(shared) else None
    met = ranked if both is None else ranked.unionByName(both)
    for c in shared:
        met = met.where(F.col(c).isNull() | F.col(f"c_{c}").isNull() | (F.col(c) == F.col(f"c_{c}")))
    first = met.groupBy(by, "citation_no").agg(F.min_by("text", "position").alias("evidence"))
    return numbered.join(first, [by, "citation_no"], "left")


def changed_rows(before: DataFrame, after: DataFrame, keys: tuple[str, ...], watched: tuple[str, ...]) -> DataFrame:
    """keys of rows in both snapshots in which a watched column is distinct (nulls compared)."""
    old = before.select(*keys, *[F.col(c).alias(f"old_{c}") for c in watched])
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return after.select(*keys, *watched).join(old, list(keys)).where(differs).select(*keys)


def match_duplicates(arrivals: DataFrame, existing: DataFrame, keys: tuple[str, ...], id_col: str = "doc_id", earlier: bool = False) -> DataFrame:
    """arrivals' ids with the least existing id that agrees in the first of the keys to match, and
    the name of that key. A null key matches nothing. Each key of existing is folded to one id
    before it is joined, so a value that many rows share costs one. earlier: only smaller ids match,
    so that existing may be the arrivals themselves."""
    rows = arrivals.select(id_col, *keys)
    for k in keys:
        folded = existing.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(id_col).alias(f"by_{k}"))
        rows = rows.join(folded, k, "left")
        if earlier:
            rows = rows.withColumn(f"by_{k}", F.when(F.col(f"by_{k}") < F.col(id_col), F.col(f"by_{k}")))
    which = F.coalesce(*[F.when(F.col(f"by_{k}").isNotNull(), F.lit(k)) for k in keys])
    return rows.select(id_col, F.coalesce(*[f"by_{k}" for k in keys]).alias("match_id"), which.alias("matched_by"))


def citations_by_document(citations: DataFrame, by: str = "query_id") -> DataFrame:
    """by, doc_id, citations, places (distinct, ascending, joined by commas)."""
    places = F.array_join(F.transform(F.array_sort(F.collect_set("chunk_index")), lambda p: p.cast("string")), ",")
    return citations.groupBy(by, "doc_id").agg(F.count(F.lit(1)).alias("citations"), places.alias("places"))


def within_budget(steps: DataFrame, limit: int, by: str = "run_id", order: str = "seq", counted: Column | None = None) -> DataFrame:
    """The steps whose running count of counted steps stays within the limit."""
    n = F.sum((counted if counted is not None else F.lit(True)).cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("used", n).where(F.col("used") <= limit)


def recoverable_steps(steps: DataFrame, safe_types: list[str]) -> DataFrame:
    """run_id, reason, step: the first paused, pending or running step of a safe type, unless an
    approval is open. steps: run_id, seq, type, status."""
    open_ = F.col("status").isin("paused", "pending", "running")
    gate = F.bool_or(open_ & (F.col("type") == "approval_gate"))
    safe = open_ & F.col("type").isin(safe_types)
    rows = steps.groupBy("run_id").agg(gate.alias("gate"), F.min(F.when(safe, F.col("seq"))).alias("first_safe"), F.bool_or(open_).alias("any"))
    reason = F.when(F.col("gate"), "pending_approval_gate").when(F.col("first_safe").isNotNull(), "safe_step_ready").when(F.col("any"), "unsafe_step_type").otherwise("no_safe_recoverable_step")
    return rows.select("run_id", reason.alias("reason"), F.when(~F.col("gate"), F.col("first_safe")).alias("step"))


def rank_experience(notes: DataFrame, question: str, least: float = 0.45, limit: int = 6) -> DataFrame:
    """owner, note_id, weight, place: shared terms of the question plus the note's confidence."""
    from tessera.functions.scores import fixed, keyword_score
    from tessera.functions.text import term_set

    share = F.coalesce(keyword_score(term_set(F.lit(question)), term_set(F.col("text"))), F.lit(0.0))
    rows = notes.where(F.col("confidence") >= least).select("owner", "note_id", share.alias("share"), "confidence").where("share > 0")
    rows = rows.select("owner", "note_id", fixed(F.col("share") + F.col("confidence"), 6).alias("weight"))
    order = Window.partitionBy("owner").orderBy(F.desc("weight"), "note_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def expired_uploads(parts: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """upload_id of uploads whose newest part is older than so many hours. parts: upload_id, modified."""
    newest = parts.groupBy("upload_id").agg(F.max("modified").alias("newest"))
    return newest.where(F.col("newest") < now - F.expr(f"INTERVAL {hours} HOURS")).select("upload_id")


def retained(rows: DataFrame, now: Column, days: int = 90, created: str = "created_at") -> DataFrame:
    """Rows not older than so many days; rows without a time stay."""
    return rows.where(F.col(created).isNull() | (F.col(created) >= now - F.expr(f"INTERVAL {days} DAYS")))


def compare_and_set(stored: DataFrame, changes: DataFrame, key: str = "run_id") -> DataFrame:
    """key, revision, applied of each change (key, expected_revision): it applies if the stored
    revision is the expected one (a missing row counts 0), and then raises it by one. Of several
    changes with one key and expectation the first by change_id applies."""
    turn = F.row_number().over(Window.partitionBy(key, "expected_revision").orderBy("change_id"))
    rows = changes.withColumn("turn", turn).join(stored.select(key, F.col("revision").alias("held")), key, "left")
    held = F.coalesce("held", F.lit(0))
    applied = (held == F.col("expected_revision")) & (F.col("turn") == 1)
    return rows.select(key, "change_id", applied.alias("applied"), (held + applied.cast("int")).alias("revision"))


def upsert_memories(stored: DataFrame, arrivals: DataFrame) -> DataFrame:
    """note_id touched or null for a new note, for each arrival: matched by (owner, category, key),
    else by (owner, category, text), among notes that are not archived.

    stored: note_id, owner, category, key, text, archived. arrivals: arrival_id and the same.
    """
    live = stored.where(~F.coalesce("archived", F.lit(False)))
    by_key = live.where("key IS NOT NULL").groupBy("owner", "category", "key").agg(F.min("note_id").alias("k"))
    by_text = live.groupBy("owner", "category", "text").agg(F.min("note_id").alias("t"))
    rows = arrivals.join(by_key, ["owner", "category", "key"], "left").join(by_text, ["owner", "category", "text"], "left")
    return rows.select("arrival_id", F.coalesce("k", "t").alias("note_id"), F.coalesce("k", "t").isNull().alias("is_new"))


def compare_batches(batches: DataFrame, selected: DataFrame, most: int = 5) -> DataFrame:
    """query_id, batch_no, doc_ids: the first batches of two or more documents, else all selected as one.

    batches: query_id, batch_no, doc_ids. selected: query_id, doc_ids.
    """
    order = Window.partitionBy("query_id").orderBy("batch_no")
    good = batches.withColumn("doc_ids", F.array_distinct("doc_ids")).where(F.size("doc_ids") >= 2).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
    single = selected.join(good.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(1).alias("turn"), F.array_distinct("doc_ids").alias("doc_ids"))
    return good.select("query_id", "turn", "doc_ids").unionByName(single).withColumnRenamed("turn", "batch_no")


def claim_states(tasks: DataFrame, now: Column) -> DataFrame:
    """task_id, state (claimable, waiting, leased, done), wait_ms: how long until a task may be claimed.

    tasks: task_id, status, due_at, lease_until.
    """
    until = F.when(F.col("status") == "queued", F.col("due_at")).when(F.col("status") == "running", F.col("lease_until"))
    ms = F.greatest(F.lit(0), F.ceil((F.unix_micros(until.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1000)).cast("long")
    open_ = F.col("status").isin("queued", "running")
    rows = tasks.withColumn("wait_ms", F.when(open_, F.coalesce(ms, F.lit(0))))
    kind = F.when(~open_, "done").when(F.col("wait_ms") == 0, "claimable").when(F.col("status") == "queued", "waiting").otherwise("leased")
    return rows.select("task_id", kind.alias("state"), "wait_ms")


# How a user asks for a language, a length, or that something be kept.
ASKS_CHINESE = r"(?i)\b(?:reply|answer|respond)\s+in\s+chinese\b|用中文|中文回答|中文回复"
ASKS_ENGLISH = r"(?i)\b(?:reply|answer|respond)\s+in\s+english\b|用英文|英文回答|英文回复"
ASKS_SHORT = r"(?i)\b(?:concise|brief|short)\s+(?:answers?|repl(?:y|ies)|responses?)\b|\bkeep\s+(?:it|answers?)\s+(?:short|brief|concise)\b|简洁|简短"
ASKS_LONG = r"(?i)\b(?:detailed|thorough)\s+(?:answers?|repl(?:y|ies)|responses?)\b|\bin\s+detail\b|详细"
REMEMBER = r"(?i)(?:\bremember(?:\s+that)?\s+|(?:请)?记住[:：\s]*)(.+)$"


def memory_candidates(messages: DataFrame, least: int = 6) -> DataFrame:
    """owner, message_id, category, key, value: preferences a message states, and notes to keep.

    messages: owner, message_id, text. A note shorter than `least`, or that only states a
    preference, is none.
    """
    tidy = F.trim(F.regexp_replace("text", r"\s+", " "))
    one = lambda when, category, key, value: F.when(when, F.struct(F.lit(category).alias("category"), F.lit(key).alias("key"), value.alias("value")))
    note = F.trim(F.regexp_extract("tidy", REMEMBER, 1))
    preference = lambda t: t.rlike(ASKS_CHINESE) | t.rlike(ASKS_ENGLISH) | t.rlike(ASKS_SHORT) | t.rlike(ASKS_LONG)
    t = F.col("tidy")
    found = F.array_compact(
        F.array(
            one(t.rlike(ASKS_CHINESE), "preference", "reply_language", F.lit("zh")),
            one(t.rlike(ASKS_ENGLISH), "preference", "reply_language", F.lit("en")),
            one(t.rlike(ASKS_SHORT), "preference", "answer_style", F.lit("concise")),
            one(t.rlike(ASKS_LONG), "preference", "answer_style", F.lit("detailed")),
            one((F.length(note) >= least) & ~preference(note), "note", None, note),
        )
    )
    rows = messages.where("text IS NOT NULL").select("owner", "message_id", tidy.alias("tidy"))
    return rows.select("owner", "message_id", F.explode(found).alias("m")).select("owner", "message_id", "m.category", "m.key", "m.value")
