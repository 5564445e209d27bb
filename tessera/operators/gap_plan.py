"""Evidence gaps: what a question needs, which results meet it, what to search for next.

A question needs its topic, each of its anchors, and by its wording a time, a number, a scope or a
plain answer. A result meets a need directly, by its heading only, or in part; the best result
decides. Needs that none meets directly give up to three searches, whose results join the first
ones before the needs are judged again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import fixed
from tessera.functions.text import CODE_LIKE, ascii_words, normalize_search, searchable, strip, term_set

# What a question asks for, and what counts as evidence of it.
DATE_LIKE = r"(?i)\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b"
NUMBER_LIKE = r"(?i)\b(?:\d[\d,./-]*%?|\$?\d[\d,./-]*|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b"
ASKS = {
    "time": r"(?i)\b(when|effective|start|starting|begin|beginning|end|ending|expire|expiration|date|dated|validity|timeline|window)\b|何时|什么时候|生效|开始|截止|到期|日期|时间|有效期",
    "number": r"(?i)\b(how many|how much|amount|price|cost|fee|limit|cap|ceiling|minimum|maximum|percent|percentage|days|months|years)\b|多少|金额|费用|价格|上限|下限|比例|百分比|几天|几个月|几年",
    "scope": r"(?i)\b(scope|applicable|applies|eligibility|eligible|region|regions|country|countries|audience|who|which users)\b|适用|范围|对象|用户|地区|国家|哪些人|哪些地区",
    "explicit_answer": r"(?i)^(?:is|are|can|does|do|will|should|may|must)\b|是否|能否|可否|可不可以|有没有|是否可以",
}
HOLDS = {
    "time": r"(?i)\b(effective|effective date|start date|end date|expires?|expiration|valid from|valid until|as of|dated?)\b|生效|截止|到期|日期|有效期",
    "number": r"(?i)\b(amount|price|cost|fee|limit|cap|ceiling|minimum|maximum|percent|percentage|days|months|years)\b|金额|费用|价格|上限|下限|比例|百分比|天|月|年",
    "scope": r"(?i)\b(scope|applicable|applies|eligibility|eligible|region|regions|regional|country|countries|audience|coverage|available in|used by)\b|适用|范围|对象|地区|国家|覆盖",
    "explicit_answer": r"(?i)\b(allow|allows|allowed|permit|permits|permitted|prohibit|prohibits|prohibited|deny|denies|denied|require|requires|required|must|may|eligible|includes?|excludes?|covered|not covered)\b|允许|可以|不得|禁止|需要|必须|适用|不适用|包含|不包含",
}
HEADING_HINTS = {
    "time": ["effective", "date", "term", "timeline", "valid", "duration", "生效", "日期", "期限", "时间", "有效"],
    "number": ["amount", "price", "cost", "fee", "limit", "cap", "ceiling", "refund", "金额", "费用", "价格", "上限", "下限", "比例"],
    "scope": ["scope", "eligibility", "eligible", "applicable", "region", "country", "audience", "coverage", "适用", "范围", "对象", "地区", "国家", "资格"],
    "explicit_answer": ["policy", "rule", "requirement", "exception", "terms", "政策", "规则", "要求", "例外", "条款"],
}
TOPIC_STOP_WORDS = [
    "when", "what", "which", "who", "how", "much", "many", "take", "takes", "effect", "apply", "applies", "does", "do", "it", "effective", "date", "dates", "scope", "applicable",
    "eligibility", "eligible", "region", "regions", "country", "countries", "amount", "price", "cost", "fee", "limit", "cap", "ceiling", "minimum", "maximum", "percent", "percentage",
    "days", "months", "years", "policy", "please", "tell", "show", "何时", "什么时候", "生效", "开始", "截止", "到期", "日期", "时间", "有效期", "适用", "范围", "对象", "用户", "地区", "国家",
    "多少", "金额", "费用", "价格", "上限", "下限", "比例", "几天", "几个月", "几年",
]
LABELS = {
    "time": ("effective date or timing", "生效日期或时间条件"),
    "number": ("amount, percentage, or duration", "金额、比例或期限"),
    "scope": ("scope, audience, or region", "适用范围、对象或地区"),
    "explicit_answer": ("clear answer", "明确结论"),
}
SEARCHES = {
    "time": ("{topic} effective date timing", "{topic} 生效日期 时间"),
    "number": ("{topic} amount percentage duration", "{topic} 金额 比例 期限"),
    "scope": ("{topic} scope region eligibility", "{topic} 适用范围 适用地区"),
    "explicit_answer": ("{topic} allowed required prohibited", "{topic} 是否允许 是否要求"),
    "anchor": ("{label}", "{label}"),
    "topic": ("{topic}", "{topic}"),
}
FOLLOW_UPS = {
    "time": ("Look only for the effective date or timing for {topic}.", "请只找这份文档里的生效日期或时间条件，不要展开解释其他条款。"),
    "number": ("Look only for the amount, percentage, or duration for {topic}.", "请只找这份文档里的金额、比例或期限，不要总结整段政策。"),
    "scope": ("Look only for the scope, audience, or region for {topic}.", "请只找这份文档里的适用对象、适用范围或适用地区。"),
    "explicit_answer": ("Answer only whether the document allows, requires, or prohibits this, and cite the page.", "请只回答是否允许、要求或禁止，并附上对应页码。"),
    "anchor": ('Find whether "{label}" appears in the selected documents and cite the page.', "请只查“{label}”是否在文档里出现，并给出页码。"),
    "topic": ("Find passages that directly mention {topic}.", "请只找和“{topic}”直接相关的段落，并给出页码。"),
}
REASONS = {
    "anchor": ('The retrieved passages do not explicitly mention "{label}".', "检索到的内容里没有明确提到“{label}”。"),
    "heading": ("I only found hints in file names or section headings, not enough body evidence yet.", "目前只在文件名或章节标题里看到相关线索，正文证据还不够。"),
    "partial": ("I found related material, but it still does not directly answer this part.", "目前只找到相关内容，但还不能直接回答这一点。"),
    "none": ("The current retrieval results do not contain direct evidence for this point.", "当前检索结果里没有找到这一点的直接证据。"),
}
SUMMARIES = {
    "related": ("I found material related to {topic}, but I still cannot confirm {labels} reliably.", "我找到了一些和“{topic}”相关的内容，但还不能可靠确认{labels}。"),
    "related_only": ("I found material related to {topic}, but the answer is still not reliable enough.", "我找到了一些和“{topic}”相关的内容，但还不能可靠作答。"),
    "nothing": ("I have not found reliable evidence that directly answers {topic}.", "我还没有找到能直接回答“{topic}”的可靠证据。"),
}
LOW_RELEVANCE, STRONG_TOPIC, SOME_TOPIC = 0.2, 0.6, 0.25
DIRECT, BY_HEADING, IN_PART = 3, 2, 1
#: Results that are judged, needs that are searched for, and places that are named.
JUDGED, SEARCHED, PLACES = 6, 3, 3

_NEED = "array<struct<kind:string,label:string,phrase:string,terms:array<string>>>"


def _filled(texts: tuple[str, str], language: Column, **values: Column) -> Column:
    """The English or Chinese text with {name} replaced by a value."""

    def one(text: str) -> Column:
        out = F.lit(text)
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    return F.when(language == "zh", one(texts[1])).otherwise(one(texts[0]))


def _by_kind(texts: dict[str, tuple[str, str]], kind: Column, language: Column, **values: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pair in texts.items():
        out = F.when(kind == name, _filled(pair, language, **values)).otherwise(out)
    return out


def named_anchors(text: Column) -> Column:
    """Codes, then quoted phrases, as needs: label as written, phrase as search text, terms. Of equal
    phrases of one kind the first stays."""

    def needs(found: Column) -> Column:
        each = F.transform(found, lambda x: F.struct(F.lit("anchor").alias("kind"), strip(x).alias("label"), normalize_search(x).alias("phrase"), term_set(x).alias("terms")))
        phrases = F.transform(found, normalize_search)
        return F.filter(each, lambda x, i: (F.array_position(phrases, x["phrase"]) == i + 1) & (F.size(x["terms"]) > 0))

    codes = F.regexp_extract_all(text, F.lit(f"({ascii_words(CODE_LIKE)})"), F.lit(1))
    quotes = F.regexp_extract_all(text, F.lit('("[^"\\n]{2,}"|“[^”\\n]{2,}”)'), F.lit(1))
    return F.concat(needs(codes), needs(F.transform(quotes, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))))


def needs(questions: DataFrame) -> DataFrame:
    """query_id, need (from 0), kind, label, phrase, terms, topic, language.

    questions: query_id, query; where a column missing_anchors (needs, as of named_anchors()) stands
    and isn't empty, it replaces the anchors of the query. A question without terms has no topic need;
    null and empty questions need nothing.
    """
    query = F.coalesce("query", F.lit(""))
    own = named_anchors(query)
    asked = F.when(F.size("missing_anchors") > 0, F.col("missing_anchors")).otherwise(own) if "missing_anchors" in questions.columns else own
    language = F.when(query.rlike("[一-鿿]"), "zh").otherwise("en")
    rows = questions.select("query_id", query.alias("query"), language.alias("language"), asked.cast(_NEED).alias("anchors"))
    words = F.filter(term_set(F.col("query")), lambda t: ~t.isin(TOPIC_STOP_WORDS))
    some = F.when(F.col("language") == "zh", F.array_join(F.slice(words, 1, 8), "")).otherwise(F.array_join(F.slice(words, 1, 4), " "))
    bare = F.substring(F.regexp_replace(strip(F.col("query")), r"[?？。!！]+\z", ""), 1, 48)
    label = F.when(F.size("anchors") > 0, F.col("anchors")[0]["label"]).when(F.size(words) > 0, some).otherwise(bare)
    rows = rows.withColumn("label", label).withColumn("topic_terms", term_set(F.col("label")))
    none = F.array().cast(_NEED)

    def need(kind: str, label: Column, terms: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), label.alias("label"), F.lit("").alias("phrase"), terms.alias("terms"))).cast(_NEED)

    empty = F.array().cast("array<string>")
    optional = [F.when(F.col("query").rlike(ascii_words(ASKS[k])), need(k, _filled(LABELS[k], F.col("language")), empty)).otherwise(none) for k in ASKS]
    topic = F.when(F.size("topic_terms") > 0, need("topic", F.col("label"), F.col("topic_terms"))).otherwise(none)
    named = F.when(F.size("topic_terms") > 0, F.col("label")).otherwise(strip(F.col("query")))
    rows = rows.select("query_id", "language", named.alias("topic"), F.concat(topic, F.col("anchors"), *optional).alias("needs"))
    each = rows.select("query_id", "language", "topic", F.posexplode("needs").alias("need", "n"))
    return each.select("query_id", "need", "n.kind", "n.label", "n.phrase", "n.terms", "topic", "language")


def graded(asked: DataFrame, results: DataFrame) -> DataFrame:
    """asked (of needs()) by result, with grade: direct, by heading, in part, or 0.

    results: query_id, place (from 1; those up to JUDGED count), keys, score, keyword, file_name,
    section_heading, chunk_text. A need without results keeps one row of grade 0. The body is the text without the heading that it begins with.
    """
    text = F.coalesce("chunk_text", F.lit(""))
    head = F.coalesce("section_heading", F.lit(""))
    opens = (head != "") & (F.lower(F.substring(text, F.lit(1), F.length(head))) == F.lower(head))
    found = results.where(F.col("place") <= JUDGED).withColumns({
        "body": F.when(opens, strip(F.substring(text, F.length(head) + 1, F.length(text)))).otherwise(text),
        "all_text": normalize_search(searchable(F.col("file_name"), F.col("section_heading"), text)),
        "heading_text": normalize_search(searchable(F.col("file_name"), F.col("section_heading"), F.lit(None).cast("string"))),
    }).drop("chunk_text", "file_name", "section_heading")
    rows = asked.join(found, "query_id", "left")
    held = F.size(F.filter("terms", lambda t: F.col("all_text").contains(t)))
    share = held / F.greatest(F.size("terms"), F.lit(1))
    body = lambda pattern: F.col("body").rlike(ascii_words(pattern))
    direct = {"time": body(DATE_LIKE) | body(HOLDS["time"]), "number": body(NUMBER_LIKE), "scope": body(HOLDS["scope"]), "explicit_answer": body(HOLDS["explicit_answer"])}
    hinted = {k: F.exists(F.array(*map(F.lit, hints)), lambda h: F.col("heading_text").contains(h)) for k, hints in HEADING_HINTS.items()}
    whole = (F.size("terms") > 0) & (held == F.size("terms"))
    grade = (
        F.when(F.col("all_text").isNull(), 0)
        .when(F.col("kind") == "topic", F.when(share >= STRONG_TOPIC, DIRECT).when(share >= SOME_TOPIC, IN_PART).otherwise(0))
        .when(F.col("kind") == "anchor", F.when(F.col("all_text").contains(F.col("phrase")) | whole, DIRECT).when(held > 0, IN_PART).otherwise(0))
    )
    for k in ASKS:
        part = F.when(body(HOLDS[k]), IN_PART).otherwise(0) if k == "number" else F.lit(0)
        grade = grade.when(F.col("kind") == k, F.when(direct[k], DIRECT).when(hinted[k], BY_HEADING).otherwise(part))
    return rows.withColumn("grade", grade.otherwise(0)).drop("body", "all_text", "heading_text")


def judged(grades: DataFrame) -> DataFrame:
    """query_id, need, kind, label, topic, language, direct, by_heading, in_part (results), status
    (covered, partial, missing), reason (of needs that aren't covered)."""
    counts = grades.groupBy("query_id", "need").agg(
        *[F.first(c).alias(c) for c in ("kind", "label", "topic", "language")],
        *[F.count_if(F.col("grade") == g).alias(name) for g, name in ((DIRECT, "direct"), (BY_HEADING, "by_heading"), (IN_PART, "in_part"))],
    )
    status = F.when(F.col("direct") > 0, "covered").when(F.col("by_heading") + F.col("in_part") > 0, "partial").otherwise("missing")
    why = F.when(F.col("kind") == "anchor", "anchor").when(F.col("by_heading") > 0, "heading").when(F.col("in_part") > 0, "partial").otherwise("none")
    reason = F.when(F.col("direct") == 0, _by_kind(REASONS, why, F.col("language"), label=F.col("label")))
    return counts.withColumns({"status": status, "reason": reason})


def searches(verdicts: DataFrame, most: int = SEARCHED) -> DataFrame:
    """query_id, search_no (from 1), kind, label, search: what to look for next, for the first `most`
    needs that aren't covered. Of equal searches the first stays; empty ones go."""
    order = Window.partitionBy("query_id").orderBy("need")
    text = _by_kind(SEARCHES, F.col("kind"), F.col("language"), topic=F.col("topic"), label=F.col("label"))
    rows = verdicts.where("status <> 'covered'").withColumn("search_no", F.row_number().over(order)).where(F.col("search_no") <= most)
    rows = rows.select("query_id", "search_no", "kind", "label", text.alias("search")).withColumn("key", normalize_search(F.col("search"))).where("key <> ''")
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("search_no"))
    return rows.withColumn("turn", first).where("turn = 1").drop("turn", "key")


def search_terms(asked: DataFrame) -> DataFrame:
    """term (distinct): every term that a question's searches can hold, known before anything is
    judged, so that one table of postings serves the first search and the second."""
    pair = _by_kind(SEARCHES, F.col("kind"), F.col("language"), topic=F.col("topic"), label=F.col("label"))
    return asked.select(F.explode(term_set(pair)).alias("term")).distinct()


def joined_labels(labels: Column, language: Column) -> Column:
    """Distinct labels as a list in words."""
    few = F.array_distinct(F.filter(labels, lambda x: x != ""))
    count, head, last = F.size(few), F.array_join(F.slice(few, 1, F.greatest(F.size(few) - 1, F.lit(0))), ", "), F.coalesce(F.element_at(few, -1), F.lit(""))
    words = F.when(count <= 1, F.array_join(few, "")).when(count == 2, F.concat_ws(" and ", few)).otherwise(F.concat(head, F.lit(", and "), last))
    return F.when(language == "zh", F.array_join(few, "、")).otherwise(words)


def plans(verdicts: DataFrame, grades: DataFrame) -> DataFrame:
    """query_id, topic, related, covered, missing (labels in words), summary, follow_ups (one a line).

    Related evidence is any need met at all, or any result that holds a fifth of the query's terms.
    """
    close = grades.groupBy("query_id").agg(F.max(F.coalesce("keyword", F.lit(0.0))).alias("keyword"))
    question = _by_kind(FOLLOW_UPS, F.col("kind"), F.col("language"), topic=F.col("topic"), label=F.col("label"))
    open_need = F.when(F.col("status") != "covered", F.struct("need", "label", question.alias("question")))
    rows = verdicts.groupBy("query_id").agg(
        F.first("topic").alias("topic"), F.first("language").alias("language"), F.count_if(F.col("status") == "covered").alias("covered"),
        F.count_if(F.col("status") != "missing").alias("met"), F.array_sort(F.collect_list(open_need)).alias("open"),
    ).join(close, "query_id")
    related = (F.col("met") > 0) | (F.col("keyword") >= LOW_RELEVANCE)
    rows = rows.withColumns({"related": related, "labels": joined_labels(F.transform("open", lambda o: o["label"]), F.col("language"))})
    which = F.when(~F.col("related"), "nothing").when(F.col("labels") == "", "related_only").otherwise("related")
    summary = _by_kind(SUMMARIES, which, F.col("language"), topic=F.col("topic"), labels=F.col("labels"))
    asked = F.array_join(F.array_distinct(F.transform(F.slice("open", 1, SEARCHED), lambda o: o["question"])), "\n")
    return rows.select("query_id", "topic", "related", "covered", F.col("labels").alias("missing"), summary.alias("summary"), asked.alias("follow_ups"))


def locations(grades: DataFrame, verdicts: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """query_id, place (from 1), keys, score, reason: where the missing parts may stand.

    Results that meet open needs by heading or in part, at 3 + keyword + score for each such need; a
    question without any takes results that hold a fifth of its terms. Ties go to what was met first.
    """
    worth = F.coalesce("keyword", F.lit(0.0)) + F.greatest("score", F.lit(0.0))
    rows = grades.where(F.col(keys[0]).isNotNull()).join(verdicts.select("query_id", "need", "status"), ["query_id", "need"]).withColumn("worth", worth)
    rows = rows.withColumn("hint", (F.col("status") != "covered") & F.col("grade").isin(BY_HEADING, IN_PART))
    each = rows.groupBy("query_id", *keys).agg(
        fixed(F.sum(F.when(F.col("hint"), F.col("worth") + 3)), 6).alias("hinted"), F.max("worth").alias("worth"), F.max("keyword").alias("keyword"), F.first("language").alias("language"),
        F.min(F.when(F.col("hint"), F.struct("need", (-F.col("grade")).alias("by"), F.col("place").alias("at")))).alias("seen"), F.min("place").alias("at"),
        F.array_sort(F.collect_list(F.when(F.col("hint"), F.struct("need", "label")))).alias("needs"),
    )
    any_hint = F.max(F.col("hinted").isNotNull()).over(Window.partitionBy("query_id"))
    each = each.withColumn("any_hint", any_hint).where(F.when(F.col("any_hint"), F.col("hinted").isNotNull()).otherwise(F.col("keyword") >= LOW_RELEVANCE))
    each = each.withColumn("score", F.coalesce("hinted", fixed(F.col("worth"), 6)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("seen").asc_nulls_last(), "at"))
    labels = joined_labels(F.transform("needs", lambda n: n["label"]), F.col("language"))
    fill = _filled(("This may help fill: {labels}.", "这里可能补到：{labels}。"), F.col("language"), labels=labels)
    near = _filled(("This is one of the closest related passages retrieved so far.", "这是当前最接近问题的相关段落。"), F.col("language"))
    reason = F.when(F.size("needs") > 0, fill).otherwise(near)
    return each.withColumns({"place": place, "reason": reason}).where(F.col("place") <= PLACES).select("query_id", "place", *keys, "score", "reason")
