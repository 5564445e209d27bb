"""Runs of agents: what a question asks for, and steps, tasks and artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Wordings by which a question asks for each kind of work.
ARXIV = r"(?i)(?:\barxiv\b.*\b(fetch|download|import|ingest|collect|search)\b|\b(fetch|download|import|ingest|collect|search)\b.*\barxiv\b|\barxiv\b.*\b(papers?|pdfs?|preprints?)\b)|(?:arxiv|论文|预印本).*(?:抓取|下载|导入|收集|检索|搜索)|(?:抓取|下载|导入|收集|检索|搜索).*(?:arxiv|论文|预印本)"
ACTIONS = {
    "task.create": r"(?i)\b(create|add|generate|make)\b.*\b(task|todo|to-do|follow[-\s]?up)\b|\b(task|todo|to-do|follow[-\s]?up)\b.*\b(create|add|generate|make)\b|(?:创建|生成|新增|添加).*(?:任务|待办|事项)|(?:任务|待办|事项).*(?:创建|生成|新增|添加)",
    "document.organize": r"(?i)\b(organize|organise|arrange|group|folder|cluster)\b.*\b(documents?|files?|workspace)\b|\b(documents?|files?|workspace)\b.*\b(organize|organise|arrange|group|folder|cluster)\b|整理.*(?:文档|文件|资料)|(?:文档|文件|资料).*整理",
    "summary.create": r"(?i)\b(create|save|record|store)\b.*\b(summary|summaries)\b|\b(summary|summaries)\b.*\b(create|save|record|store)\b|(?:创建|保存|记录).*(?:摘要|总结)|(?:摘要|总结).*(?:创建|保存|记录)",
    "external.import": r"(?i)\b(import|ingest|add)\b.*\b(external|url|source|link|web document)\b|\b(external|url|source|link|web document)\b.*\b(import|ingest|add)\b|导入.*(?:外部|链接|资料|来源)|(?:外部|链接|资料|来源).*导入",
}
INVENTORY = r"(?i)\b(what documents|which documents|list documents|show documents|workspace documents|uploaded documents|what files|which files|list files)\b|有哪些(?:文档|资料|文件)|列出.*(?:文档|资料|文件)|当前.*(?:文档|资料|文件)|上传.*(?:文档|资料|文件)"
DISCOVERY = r"(?i)\b(which document|which file|what document|what file|find document|find file|document covers|file covers|covers .*document|about)\b|哪份(?:文档|资料|文件)|哪个(?:文档|资料|文件)|(?:文档|资料|文件).*?(讲|包含|关于|提到)"
RESEARCH = r"(?i)\b(research|brief|report|analy[sz]e|analysis|investigate|study|risk|risks|key findings|executive summary)\b|研究|简报|报告|分析|调研|风险|结论|发现|梳理"
CHRONOLOGY = r"(?i)\b(timeline|chronology|chronological|sequence|milestones?|key dates?|event order|date order)\b|时间线|时间顺序|按时间|大事记|里程碑|事件顺序|关键日期"
RISK_REVIEW = r"(?i)\b(risk review|review risks?|risk analysis|gaps?|exceptions?|conflicts?|contradictions?|uncertaint(?:y|ies)|red flags?|missing terms?)\b|风险审查|风险|缺口|例外|冲突|矛盾|不确定|遗漏"
CONTRACT_SUMMARY = r"(?i)\b(summarize|summary|summarise|contract summary|agreement summary|key terms?|parties|obligations?|deadlines?|effective date|renewal|termination)\b.*\b(contract|agreement|policy|terms|msa|sow|nda)\b|\b(contract|agreement|msa|sow|nda)\b.*\b(summarize|summary|summarise|key terms?|parties|obligations?|deadlines?|renewal|termination)\b|合同摘要|协议摘要|合同总结|关键条款|合同义务|协议义务|合同期限|续约|终止"
COMPARE = r"(?i)\b(compare|comparison|differences?|different|versus|vs|same|similar|contrast|common ground|missing terms?|across|between)\b|对比|比较|差异|不同|相同|一致|共同点|缺失条款|遗漏条款|之间"
CONTRACT_REVIEW = r"(?i)\b(review|audit|assess|analy[sz]e)\b.*\b(contract|agreement|msa|sow|nda)\b|\b(contract|agreement|msa|sow|nda)\b.*\b(review|audit|assess|analy[sz]e)\b|审查.*(?:合同|协议)|审核.*(?:合同|协议)|(?:合同|协议).*审查|(?:合同|协议).*审核"
RISKS = r"(?i)\brisks?\b|风险|risk review|risk analysis"
PROJECT_CHANGE = r"(?i)\b(project changes?|change log|change history|changes across|evolution|what changed|changed across)\b|项目变化|项目变更|整理.*(?:变化|变更)|(?:变化|变更).*整理"
WEB = r"(?i)\b(latest|current|currently|today|now|recent|news|live|online|internet|web|search the web|real[-\s]?time)\b|最新|当前|现在|今天|近日|实时|联网|网页|网络|新闻"
# Replay policies by step type: safe without asking, idempotency, needs approval, needed input.
RAG, BOUND = "read_only_rag", "approved_capability_gate"
REPLAY = {
    "arxiv_import": (False, "deduped_workspace_write", True, ["topic"]),
    "capability_call": (False, "capability_defined", True, ["approvedGate.capabilityId", "approvedGate.approvalObjectHash", "step.approvalGateId", "step.detail.approvalObjectHash"]),
    "custom_skill": (True, RAG, False, ["docIds", "question", "skillId"]),
    "document_rag": (True, RAG, False, ["docIds", "question"]),
    "follow_up_retrieval": (True, RAG, False, ["docIds", "question"]),
    "research_question": (True, RAG, False, ["docIds", "question"]),
    "web_search": (False, "external_read_nondeterministic", True, ["question"]),
}


def intent_candidates(question: Column, has_documents: Column) -> Column:
    """The kinds of work a question may ask for, the likeliest first; never empty."""
    says = lambda pattern: F.coalesce(question.rlike(pattern), F.lit(False))
    action = F.coalesce(*[F.when(says(p), F.lit(name)) for name, p in ACTIONS.items()])
    arxiv, changes = says(ARXIV), says(PROJECT_CHANGE)
    found = [
        ("arxiv_import", arxiv),
        ("workspace_action", ~arxiv & action.isNotNull() & ~((action == "document.organize") & changes)),
        ("skill_chain_compare_risk", says(COMPARE) & says(RISKS)),
        ("skill_chain_contract_review", (says(RISK_REVIEW) & says(CONTRACT_SUMMARY)) | says(CONTRACT_REVIEW)),
        ("skill_chain_project_change", changes),
        ("extract_timeline", says(CHRONOLOGY)),
        ("compare_documents", says(COMPARE)),
        ("risk_review", says(RISK_REVIEW)),
        ("summarize_contract", says(CONTRACT_SUMMARY)),
        ("research_brief", says(RESEARCH)),
        ("inventory", says(INVENTORY) & ~has_documents),
        ("document_discovery", says(DISCOVERY) & ~has_documents),
        ("web", says(WEB) & ~has_documents),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(yes, F.lit(False)), F.lit(name)) for name, yes in found], F.when(says(WEB), "document_web").otherwise("document")))


def replay_safety(steps: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """run_id, step_id, safe, reasons of steps (run_id, step_id, type, inputs: names of those present,
    approved: by a gate bound to the step). allowed: types that may replay by themselves (all safe
    ones, if None)."""
    allowed = [k for k, v in REPLAY.items() if v[0]] if allowed is None else allowed
    kind = F.lower(F.trim(F.col("type")))
    of = lambda i, cast: F.create_map(*[x for k, v in REPLAY.items() for x in (F.lit(k), F.lit(v[i]).cast(cast) if not isinstance(v[i], list) else F.array(*map(F.lit, v[i])))])[kind]
    known, manner = kind.isin(*REPLAY), of(1, "string")
    missing = F.size(F.array_except(of(3, None), F.coalesce("inputs", F.array().cast("array<string>")))) > 0
    unapproved = of(2, "boolean") & ~((kind == "capability_call") & F.coalesce("approved", F.lit(False)))
    named = [("unsupported_step_type", ~known), ("missing_input", known & missing), ("requires_approval", known & unapproved), ("external_write", manner == "deduped_workspace_write"), ("non_idempotent", manner.isin("external_read_nondeterministic", "capability_defined"))]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(yes, F.lit(False)), F.lit(name)) for name, yes in named]))
    policy = F.when((F.size(codes) == 0) & ~(of(0, "boolean") & kind.isin(*allowed)), F.array(F.lit("unsafe_by_policy"))).otherwise(codes)
    return steps.select("run_id", "step_id", policy.alias("codes")).select("run_id", "step_id", (F.size("codes") == 0).alias("safe"), F.array_join("codes", ",").alias("reasons"))


def normalize_steps(steps: DataFrame) -> DataFrame:
    """run_id, seq, step_id, type, status, label, attempt: steps (run_id, seq, step_id, type, status,
    label, attempt) with defaults in place of what is blank."""
    filled = lambda c, default: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), default)
    kind = filled("type", F.lit("step"))
    return steps.select(
        "run_id", "seq", filled("step_id", F.concat(F.lit("step:"), F.col("seq"), F.lit(":"), kind)).alias("step_id"), kind.alias("type"), filled("status", F.lit("pending")).alias("status"),
        filled("label", kind).alias("label"), F.when(F.col("attempt") >= 1, F.floor("attempt")).otherwise(1).cast("long").alias("attempt"),
    )


def upsert_steps(steps: DataFrame, changes: DataFrame) -> DataFrame:
    """Normalised steps with those of changes (run_id, step_id and fields) in their place, blank
    fields left as they were; further steps follow after the last."""
    keys = ["run_id", "step_id"]
    fields = [c for c in steps.columns if c not in (*keys, "seq")]
    new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in fields])
    both = steps.join(new, keys, "full_outer")
    last = F.coalesce(F.max("seq").over(Window.partitionBy("run_id")), F.lit(0))
    turn = F.row_number().over(Window.partitionBy("run_id", F.col("seq").isNull()).orderBy("step_id"))
    seq = F.coalesce(F.col("seq"), last + turn).cast("long").alias("seq")
    return both.select("run_id", seq, "step_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in fields]).select(steps.columns)


def retry_steps(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_id, step_id, retry_of, attempt, status of the retries of wanted steps (run_id, step_id):
    numbered after the step and its earlier retries (steps: run_id, step_id, retry_of)."""
    tries = steps.select("run_id", F.coalesce(F.nullif("retry_of", F.lit("")), F.col("step_id")).alias("step_id")).groupBy("run_id", "step_id").agg(F.count(F.lit(1)).alias("tries"))
    there = steps.join(wanted.select("run_id", "step_id").distinct(), ["run_id", "step_id"], "left_semi").select("run_id", "step_id").distinct()
    rows = there.join(tries, ["run_id", "step_id"]).withColumn("attempt", F.col("tries") + 1)
    return rows.select("run_id", F.concat("step_id", F.lit(":retry:"), "attempt").alias("step_id"), F.col("step_id").alias("retry_of"), "attempt", F.lit("pending").alias("status"))


def overall_status(parts: DataFrame, by: str = "run_id") -> DataFrame:
    """by, status of parts (by, status): error before warn (unavailable, fail) before ok."""
    worst = F.max(F.when(F.col("status") == "error", 2).when(F.col("status").isin("warn", "fail", "unavailable"), 1).otherwise(0))
    return parts.groupBy(by).agg(worst.alias("w")).select(by, F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("error")), F.col("w") + 1).alias("status"))


def claim_tasks(tasks: DataFrame, now, worker: str, lease_seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """The tasks after a worker took those that are due, and the event of each claim.

    tasks: task_id, status, due_at, leased_until, attempt, worker. A task is due if it is queued and
    its time has come, or runs under a lease that ended; it is taken with one attempt more. As one
    table is made from the other, a claim never stands without its event.
    """
    at = F.lit(now).cast(tasks.schema["due_at"].dataType)
    due = ((F.col("status") == "queued") & (F.coalesce("due_at", at) <= at)) | ((F.col("status") == "running") & (F.col("leased_until") <= at))
    due = F.coalesce(due, F.lit(False))
    changed = {"status": F.lit("running"), "attempt": F.col("attempt") + 1, "worker": F.lit(worker), "leased_until": (at + F.expr(f"INTERVAL {lease_seconds} SECONDS")).cast(tasks.schema["leased_until"].dataType)}
    after = tasks.select(*[F.when(due, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in tasks.columns], due.alias("claimed"))
    events = after.where("claimed").select("task_id", F.lit("claimed").alias("event"), "attempt", "worker")
    return after.drop("claimed"), events


def archive(artifacts: DataFrame, ids: DataFrame, id_col: str = "artifact_id") -> DataFrame:
    """artifacts with the status archived for those ids; an archived one stays as it is."""
    gone = ids.select(id_col, F.lit(True).alias("is_gone")).distinct()
    rows = artifacts.join(gone, id_col, "left")
    return rows.select(*[F.when(F.col("is_gone"), "archived").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in artifacts.columns])


def rerank_metrics(pairs: DataFrame) -> DataFrame:
    """query_id, candidates, query_characters, text_characters: what a rerank call is given."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.max(size("query")).cast("long").alias("query_characters"), F.sum(size("text")).cast("long").alias("text_characters"))


def supplemental_queries(queries: DataFrame, evidence: DataFrame, text_col: str = "chunk_text", least: float = 0.6) -> DataFrame:
    """query_id, query: for queries whose best evidence covers less than `least` of their terms, the
    terms that no evidence holds, as a second query."""
    from tessera.functions.text import term_set

    asked = queries.select("query_id", term_set(F.col("query")).alias("wanted"))
    found = evidence.select("query_id", term_set(F.col(text_col)).alias("held"))
    rows = asked.join(found, "query_id", "left").withColumn("share", F.coalesce(F.size(F.array_intersect("wanted", "held")) / F.size("wanted"), F.lit(0.0)))
    seen = rows.groupBy("query_id").agg(F.max("share").alias("share"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("seen"), F.first("wanted").alias("wanted"))
    left = F.array_except("wanted", "seen")
    return seen.where((F.col("share") < least) & (F.size(left) > 0)).select("query_id", F.array_join(left, " ").alias("query"))
