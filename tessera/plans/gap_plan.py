"""Gap plans of questions about passages, before and after a second search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.operators import gap_plan, index
from tessera.operators.chunking import fixed_windows
from tessera.operators.retrieval import merge_queries
from tessera.plans import retrieval
from tessera.plans.tables import chunks, documents, table
from tessera.sources.scratch import kept

DEPTH = 4
KEYS = retrieval.KEYS
#: Wordings of a question about a passage's first words, by the remainder of its id.
WORDINGS = [
    "When does {five} take effect?", "How much is the fee for {five}?", "Which users and regions is {five} for?", "Is {five} allowed?", 'Find "{two}" and {code} in {five}', "“{two}”何时生效",
    "{five}", "Must {five} be paid, how much and when?", '{all} And "{other}"?',
]


def gap_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: every passage as a question in one of the wordings; other is two words of the
    passage of the next id, if there is one, so that a question may need what its own words don't find."""
    words = F.split("text", r"\s+")
    named = {"all": F.col("text"), "five": F.array_join(F.slice(words, 1, 5), " "), "two": F.array_join(F.slice(words, 1, 2), " "), "code": F.array_join(F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})")), 1, 2), "-"), "other": F.coalesce("other", F.lit(""))}
    query = F.lit(None).cast("string")
    for k, wording in enumerate(WORDINGS):
        said = F.lit(wording)
        for name, value in named.items():
            said = F.replace(said, F.lit("{" + name + "}"), value)
        query = F.when(F.col("item_id") % len(WORDINGS) == k, said).otherwise(query)
    passages = table(spark, sf_dir, "benchmark").select("item_id", "text")
    following = passages.select((F.col("item_id") - 1).alias("item_id"), F.array_join(F.slice(words, 3, 2), " ").alias("other"))
    return passages.join(following, "item_id", "left").select(F.col("item_id").alias("query_id"), query.alias("query"))


def _with_text(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    """results (kept) with chunk_text, the source as file_name and the document's first line as section_heading."""
    docs = retrieval.only(documents(spark, sf_dir), results.select("doc_id").distinct())
    titles = docs.select("doc_id", F.col("source").alias("file_name"), F.substring(F.substring_index("text", "\n", 1), 1, 90).alias("section_heading"))
    return results.join(fixed_windows(docs).select(*KEYS, "chunk_text"), list(KEYS)).join(titles, "doc_id")


def _best(weighed: DataFrame, asked: DataFrame) -> DataFrame:
    """The best DEPTH chunks of each query (query_id, term)."""
    scores = index.scores_of(weighed, asked)
    return index.top_k(scores, DEPTH, ties=(F.desc("keyword"), *KEYS)).withColumnRenamed("rank", "place")


class _Searched:
    """The needs of the questions, the postings of all terms that either search asks for, and the first results."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        asked = gap_questions(spark, sf_dir)
        self.needs = kept(gap_plan.needs(asked))
        terms = index.query_terms(asked)
        wanted = terms.select("term").union(gap_plan.search_terms(self.needs)).distinct()
        self.weighed = kept(index.weighed_postings(chunks(spark, sf_dir), wanted))
        self.first = kept(_best(self.weighed, terms))
        self.grades = kept(gap_plan.graded(self.needs, _with_text(spark, sf_dir, self.first)))
        self.verdicts = gap_plan.judged(self.grades)


def typed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Searched(spark, sf_dir).verdicts.drop("language", "topic")


def gap_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Searched(spark, sf_dir)
    return gap_plan.plans(found.verdicts, found.grades)


def gap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Searched(spark, sf_dir)
    return retrieval.longs(gap_plan.locations(found.grades, found.verdicts), "place", "chunk_index")


def _second(spark: SparkSession, sf_dir: str) -> tuple[_Searched, DataFrame, DataFrame]:
    """The first round, the searches of its gaps, and their results (question_id, sub_query, position, keys, score, keyword)."""
    found = _Searched(spark, sf_dir)
    again = kept(gap_plan.searches(found.verdicts))
    named = again.select(F.struct("query_id", "search_no").alias("query_id"), F.col("search").alias("query"))
    results = kept(_best(found.weighed, index.query_terms(named)))
    return found, again, results.select(F.col("query_id.query_id").alias("question_id"), F.col("query_id.search_no").alias("sub_query"), F.col("place").alias("position"), *KEYS, "score", "keyword")


def gap_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches of open needs, with their results, and those of them that the first search didn't have."""
    found, again, results = _second(spark, sf_dir)
    seen = found.first.select(F.col("query_id").alias("question_id"), *KEYS, F.lit(1).alias("known"))
    counts = results.join(seen, ["question_id", *KEYS], "left").groupBy(F.col("question_id").alias("query_id"), F.col("sub_query").alias("search_no")).agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("known").isNull()).alias("new_results"))
    filled = again.join(counts, ["query_id", "search_no"], "left").fillna(0, ["results", "new_results"])
    return filled.withColumn("search_no", F.col("search_no").cast("long"))


def gap_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each need's status before and after the results of the second search join the first."""
    found, _, results = _second(spark, sf_dir)
    first = found.first.select(F.col("query_id").alias("question_id"), F.lit(0).alias("sub_query"), F.col("place").alias("position"), *KEYS, "score", "keyword")
    merged = kept(merge_queries(first.unionByName(results)).withColumnRenamed("question_id", "query_id"))
    after = gap_plan.judged(gap_plan.graded(found.needs, _with_text(spark, sf_dir, merged.drop("from_query"))))
    return found.verdicts.select("query_id", "need", "kind", F.col("status").alias("before")).join(after.select("query_id", "need", F.col("status").alias("after")), ["query_id", "need"])


QUERIES = {f.__name__: f for f in (typed_gaps, gap_plans, gap_locations, gap_followups, gap_closure)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _filled(texts: tuple[str, str], **values: str) -> str:
    def one(text: str) -> str:
        out = _text(text)
        for name, value in values.items():
            out = f"replace({out}, '{{{name}}}', {value})"
        return out

    return f"CASE WHEN language = 'zh' THEN {one(texts[1])} ELSE {one(texts[0])} END"


def _by_kind(texts: dict[str, tuple[str, str]], kind: str, **values: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {_filled(pair, **values)}" for k, pair in texts.items()) + " END"


def _wording(text: str) -> str:
    out = _text(text)
    for name, value in (("all", "text"), ("five", "array_to_string(w[1:5], ' ')"), ("two", "array_to_string(w[1:2], ' ')"), ("code", "array_to_string(regexp_extract_all(text, '[A-Za-z]{2,}')[1:2], '-')"), ("other", "coalesce(other, '')")):
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


_QUERY = "CASE item_id % " + str(len(WORDINGS)) + " " + " ".join(f"WHEN {k} THEN {_wording(w)}" for k, w in enumerate(WORDINGS)) + " END"


def _anchors(found: str) -> str:
    return f"list_transform({found}, lambda x: {{'kind': 'anchor', 'label': {sql.strip('x')}, 'phrase': {sql.normalize_search('x')}, 'terms': {sql.term_set('x')}}})"


_CODES = _anchors(r"regexp_extract_all(query, '(?i)\b[a-z0-9]{2,}(?:-[a-z0-9]{1,})+\b')")
_QUOTES = _anchors(r"""list_transform(regexp_extract_all(query, '"[^"\n]{2,}"|“[^”\n]{2,}”'), lambda q: q[2:-2])""")
_FIRST = "list_filter(list_transform({xs}, lambda x, i: CASE WHEN list_position(list_transform({xs}, lambda y: y.phrase), x.phrase) = i AND len(x.terms) > 0 THEN x END), lambda x: x IS NOT NULL)"
_DISTINCT = "list_filter(list_transform({x}, lambda l, i: CASE WHEN list_position({x}, l) = i THEN l END), lambda l: l IS NOT NULL)"
_STOP = ", ".join(map(_text, gap_plan.TOPIC_STOP_WORDS))
_NEED = "[{{'kind': '{kind}', 'label': {label}, 'phrase': '', 'terms': {terms}}}]"
_OPTIONAL = " || ".join(
    f"CASE WHEN {sql.matches('query', gap_plan.ASKS[k])} THEN {_NEED.format(kind=k, label=_filled(gap_plan.LABELS[k]), terms='CAST([] AS VARCHAR[])')} ELSE [] END" for k in gap_plan.ASKS
)
_NEEDS = rf"""
    asked AS MATERIALIZED (SELECT item_id AS query_id, {_QUERY} AS query FROM (SELECT b.*, regexp_split_to_array(b.text, '\s+') AS w, array_to_string(regexp_split_to_array(f.text, '\s+')[3:4], ' ') AS other FROM benchmark b LEFT JOIN benchmark f ON f.item_id = b.item_id + 1)),
    anchored AS (
        SELECT *, CASE WHEN regexp_matches(query, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language, {_FIRST.format(xs="codes")} || {_FIRST.format(xs="quotes")} AS anchors,
               list_filter({_DISTINCT.format(x="said")}, lambda t: t NOT IN ({_STOP})) AS words
        FROM (SELECT query_id, query, {_CODES} AS codes, {_QUOTES} AS quotes, {sql.terms("query")} AS said FROM asked)
    ),
    named AS (
        SELECT *, {sql.term_set("label")} AS topic_terms FROM (
            SELECT *, CASE WHEN len(anchors) > 0 THEN anchors[1].label WHEN len(words) > 0 AND language = 'zh' THEN array_to_string(words[1:8], '') WHEN len(words) > 0 THEN array_to_string(words[1:4], ' ')
                           ELSE substring(regexp_replace({sql.strip("query")}, '[?？。!！]+\z', ''), 1, 48) END AS label
            FROM anchored
        )
    ),
    listed AS (
        SELECT query_id, language, CASE WHEN len(topic_terms) > 0 THEN label ELSE {sql.strip("query")} END AS topic,
               CASE WHEN len(topic_terms) > 0 THEN {_NEED.format(kind="topic", label="label", terms="topic_terms")} ELSE [] END || anchors || {_OPTIONAL} AS needs
        FROM named
    ),
    needs AS MATERIALIZED (SELECT query_id, language, topic, need, n.kind AS kind, n.label AS label, n.phrase AS phrase, n.terms AS terms FROM (SELECT query_id, language, topic, unnest(needs) AS n, generate_subscripts(needs, 1) - 1 AS need FROM listed))
"""
_SCORE = sql.fixed("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))", 6)


def _best_sql(name: str, asked: str, by: str) -> str:
    """name: the best chunks of each query (by columns, wanted) of asked."""
    return f"""
    {name} AS MATERIALIZED (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, keyword DESC, doc_id, chunk_index) AS place FROM (
            SELECT {by}, doc_id, chunk_index, {_SCORE} AS score, {sql.fixed("count(*) / any_value(k)", 6)} AS keyword
            FROM tf JOIN (SELECT {by}, unnest(wanted) AS term, len(wanted) AS k FROM {asked}) USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY {by}, doc_id, chunk_index
        )) WHERE place <= {DEPTH}
    )"""


_HITS = "len(list_filter(terms, lambda t: contains(all_text, t)))"
_GRADES = {
    "topic": f"CASE WHEN {_HITS} / len(terms) >= 0.6 THEN 3 WHEN {_HITS} / len(terms) >= 0.25 THEN 1 ELSE 0 END",
    "anchor": f"CASE WHEN contains(all_text, phrase) OR {_HITS} = len(terms) THEN 3 WHEN {_HITS} > 0 THEN 1 ELSE 0 END",
}
_DIRECT = {
    "time": f"{sql.matches('body', gap_plan.DATE_LIKE)} OR {sql.matches('body', gap_plan.HOLDS['time'])}", "number": sql.matches("body", gap_plan.NUMBER_LIKE),
    "scope": sql.matches("body", gap_plan.HOLDS["scope"]), "explicit_answer": sql.matches("body", gap_plan.HOLDS["explicit_answer"]),
}
for _kind, _hints in gap_plan.HEADING_HINTS.items():
    _part = f"WHEN {sql.matches('body', gap_plan.HOLDS['number'])} THEN 1" if _kind == "number" else ""
    _GRADES[_kind] = f"CASE WHEN {_DIRECT[_kind]} THEN 3 WHEN {' OR '.join(f'contains(heading_text, {_text(h)})' for h in _hints)} THEN 2 {_part} ELSE 0 END"


def _judged_sql(name: str, results: str) -> str:
    """name_grades (a row for each need and result) and name (a row for each need) of results."""
    body = f"CASE WHEN head <> '' AND lower(chunk_text[1:length(head)]) = lower(head) THEN {sql.strip('chunk_text[length(head) + 1:]')} ELSE chunk_text END"
    return f"""
    {name}_grades AS MATERIALIZED (
        SELECT *, CASE WHEN all_text IS NULL THEN 0 ELSE CASE kind {" ".join(f"WHEN '{k}' THEN {g}" for k, g in _GRADES.items())} END END AS grade
        FROM needs LEFT JOIN (
            SELECT query_id, place, doc_id, chunk_index, score, keyword, {body} AS body, {sql.normalize_search("source || chr(10) || CASE WHEN head <> '' THEN head || chr(10) ELSE '' END || chunk_text")} AS all_text,
                   {sql.normalize_search("source || chr(10) || head")} AS heading_text
            FROM (SELECT r.*, chunk_text, source, string_split(text, chr(10))[1][1:90] AS head FROM {results} r JOIN c USING (doc_id, chunk_index) JOIN documents USING (doc_id) WHERE place <= 6)
        ) USING (query_id)
    ),
    {name} AS MATERIALIZED (
        SELECT *, CASE WHEN direct > 0 THEN 'covered' WHEN by_heading + in_part > 0 THEN 'partial' ELSE 'missing' END AS status FROM (
            SELECT query_id, need, any_value(kind) AS kind, any_value(label) AS label, any_value(topic) AS topic, any_value(language) AS language,
                   count(*) FILTER (grade = 3) AS direct, count(*) FILTER (grade = 2) AS by_heading, count(*) FILTER (grade = 1) AS in_part
            FROM {name}_grades GROUP BY query_id, need
        )
    )"""


_CORPUS = f"""
    c AS MATERIALIZED (SELECT doc_id, chunk_index, chunk_text, {sql.terms("chunk_text")} AS terms FROM ({sql.chunks()})), stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM c),
    tf AS MATERIALIZED (SELECT doc_id, chunk_index, length, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, len(terms) AS length, unnest(terms) AS term FROM c) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
"""
_ONCE = f"WITH {_NEEDS}, {_CORPUS}, wanted AS (SELECT query_id, {sql.term_set('query')} AS wanted FROM asked), {_best_sql('first', 'wanted', 'query_id')}, {_judged_sql('v', 'first')}"
_AGAIN = f"""
    open AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY need) AS search_no FROM v WHERE status <> 'covered'),
    said AS (SELECT query_id, search_no, kind, label, {_by_kind(gap_plan.SEARCHES, "kind", topic="topic", label="label")} AS search FROM open WHERE search_no <= 3),
    again AS MATERIALIZED (
        SELECT query_id, search_no, kind, label, search, {sql.term_set("search")} AS wanted FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {sql.normalize_search("search")} ORDER BY search_no) AS turn FROM said)
        WHERE turn = 1 AND {sql.normalize_search("search")} <> ''
    ),
    {_best_sql("second", "again", "query_id, search_no")}
"""
_WORDS = "CASE WHEN language = 'zh' THEN array_to_string({x}, '、') WHEN len({x}) <= 1 THEN array_to_string({x}, '') WHEN len({x}) = 2 THEN array_to_string({x}, ' and ') ELSE array_to_string({x}[:-2], ', ') || ', and ' || {x}[-1] END"
_WHY = "CASE WHEN kind = 'anchor' THEN 'anchor' WHEN by_heading > 0 THEN 'heading' WHEN in_part > 0 THEN 'partial' ELSE 'none' END"

ORACLES = {
    "typed_gaps": f"{_ONCE} SELECT query_id, need, kind, label, direct, by_heading, in_part, status, CASE WHEN direct = 0 THEN {_by_kind(gap_plan.REASONS, _WHY, label='label')} END AS reason FROM v",
    "gap_plans": f"""
        {_ONCE}, o AS (SELECT query_id, list(label ORDER BY need) AS labels, list({_by_kind(gap_plan.FOLLOW_UPS, "kind", topic="topic", label="label")} ORDER BY need)[:3] AS asks FROM v WHERE status <> 'covered' GROUP BY query_id),
        p AS (
            SELECT query_id, any_value(topic) AS topic, any_value(language) AS language, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status <> 'missing') > 0 OR coalesce(any_value(k), 0) >= 0.2 AS related
            FROM v LEFT JOIN (SELECT query_id, max(keyword) AS k FROM first GROUP BY query_id) USING (query_id) GROUP BY query_id
        ),
        d AS (SELECT p.*, {_DISTINCT.format(x="coalesce(labels, [])")} AS few, {_DISTINCT.format(x="coalesce(asks, [])")} AS asks FROM p LEFT JOIN o USING (query_id)),
        m AS (SELECT *, {_WORDS.format(x="few")} AS labels FROM d)
        SELECT query_id, topic, related, covered, labels AS missing, {_by_kind(gap_plan.SUMMARIES, "CASE WHEN NOT related THEN 'nothing' WHEN labels = '' THEN 'related_only' ELSE 'related' END", topic="topic", labels="labels")} AS summary,
               array_to_string(asks, chr(10)) AS follow_ups FROM m
    """,
    "gap_locations": f"""
        {_ONCE}, e AS (SELECT g.*, status, keyword + greatest(score, 0) AS worth, status <> 'covered' AND grade IN (1, 2) AS hint FROM v_grades g JOIN v USING (query_id, need) WHERE g.doc_id IS NOT NULL),
        h AS (
            SELECT query_id, doc_id, chunk_index, any_value(language) AS language, {sql.fixed("sum(worth + 3) FILTER (hint)", 6)} AS hinted, max(worth) AS worth, max(keyword) AS keyword, min(place) AS top,
                   min((need, -grade, place)) FILTER (hint) AS seen, list(label ORDER BY need) FILTER (hint) AS labels
            FROM e GROUP BY query_id, doc_id, chunk_index
        ),
        a AS (SELECT *, bool_or(hinted IS NOT NULL) OVER (PARTITION BY query_id) AS any_hint FROM h),
        s AS (SELECT *, coalesce(hinted, {sql.fixed("worth", 6)}) AS score, {_DISTINCT.format(x="coalesce(labels, [])")} AS few FROM a WHERE CASE WHEN any_hint THEN hinted IS NOT NULL ELSE keyword >= 0.2 END),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen ASC NULLS LAST, top) AS place, {_WORDS.format(x="few")} AS said FROM s)
        SELECT query_id, place, doc_id, chunk_index, score, CASE WHEN len(few) > 0 THEN {_filled(("This may help fill: {labels}.", "这里可能补到：{labels}。"), labels="said")}
               ELSE {_filled(("This is one of the closest related passages retrieved so far.", "这是当前最接近问题的相关段落。"))} END AS reason
        FROM r WHERE place <= 3
    """,
    "gap_followups": f"""
        {_ONCE}, {_AGAIN}
        SELECT query_id, search_no, kind, label, search, count(s.doc_id) AS results, count(s.doc_id) FILTER (f.doc_id IS NULL) AS new_results
        FROM again LEFT JOIN second s USING (query_id, search_no) LEFT JOIN first f ON f.query_id = again.query_id AND f.doc_id = s.doc_id AND f.chunk_index = s.chunk_index GROUP BY ALL
    """,
    "gap_closure": f"""
        {_ONCE}, {_AGAIN},
        every AS (SELECT query_id, 0 AS sub_query, place, doc_id, chunk_index, score, keyword FROM first UNION ALL SELECT query_id, search_no, place, doc_id, chunk_index, score, keyword FROM second),
        merged AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id, chunk_index) AS place
            FROM (SELECT query_id, doc_id, chunk_index, min((sub_query, place)) AS seen, max(score) AS score, max(keyword) AS keyword FROM every GROUP BY query_id, doc_id, chunk_index)
        ), {_judged_sql("w", "merged")}
        SELECT query_id, need, v.kind, v.status AS before, w.status AS after FROM v JOIN w USING (query_id, need)
    """,
}
