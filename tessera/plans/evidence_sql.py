"""SQL of the queries that read evidence, compare documents, and check answers."""

from __future__ import annotations

from tessera import sql
from tessera.functions.text import NUMBER, STOP_WORDS
from tessera.operators import comparison, questions, state, verify
from tessera.plans import answers, retrieval
from tessera.plans.text import ORACLES as TEXT, _TAGS

_SIGNALS = f"""[
    CASE WHEN {sql.matches("text", comparison.REQUIRE)} AND NOT {sql.matches("text", comparison.OPTIONAL)} THEN 'require' END,
    CASE WHEN {sql.matches("text", comparison.OPTIONAL)} THEN 'optional' END,
    CASE WHEN {sql.matches("text", comparison.ALLOW)} AND NOT {sql.matches("text", comparison.PROHIBIT)} THEN 'allow' END,
    CASE WHEN {sql.matches("text", comparison.PROHIBIT)} THEN 'prohibit' END
]"""
_BOUND = f"""list_distinct(list_filter(list_transform({sql.raw_sentences("text")}, lambda s: {{
    's': {sql.canonical("s")}, 'n': array_to_string(list_transform(regexp_extract_all(s, '{NUMBER}'), lambda n: {sql.number("n")}), '|')
}}), lambda b: b.n <> ''))"""
_OPPOSED = " OR ".join(f"(list_contains(l.g, '{a}') AND list_contains(r.g, '{b}'))" for a, b in (("require", "optional"), ("optional", "require"), ("allow", "prohibit"), ("prohibit", "allow")))
_OF = "list_sort(list_transform(list_filter({side}.b, lambda {v}: {v}.s = x.s), lambda {v}: {v}.n))"
_MINUS = "array_to_string(list_sort(list_filter({a}.n, lambda x: NOT list_contains({b}.n, x))), '|')"
_SHARED_T, _SHARED_S = "len(list_intersect(l.t, r.t))", "len(list_intersect(l.s, r.s))"

#: Pairs of a question's documents with all that is said of them.
_PAIRS = f"""
    picked AS (SELECT query_id AS group_id, doc_id, count(*) AS results FROM sparse WHERE rank <= {retrieval.TOP_K} GROUP BY ALL),
    f AS MATERIALIZED (
        SELECT group_id, doc_id, {sql.term_set("text")} AS t, {sql.canonical_sentences("text")} AS s, {sql.numeric_tokens("text")} AS n, {_BOUND} AS b, {_SIGNALS} AS g
        FROM picked JOIN documents USING (doc_id) WHERE {sql.normalize_whitespace("text")} <> ''
    ),
    met AS (
        SELECT l.group_id, l.doc_id AS left_doc, r.doc_id AS right_doc,
               CASE WHEN len(l.t) + len(r.t) = 0 THEN 1 ELSE {_SHARED_T} / (len(l.t) + len(r.t) - {_SHARED_T}) END AS j,
               CASE WHEN least(len(l.s), len(r.s)) = 0 THEN 0 ELSE {_SHARED_S} / least(len(l.s), len(r.s)) END AS o,
               list_sort(l.s) = list_sort(r.s) AND list_sort(l.n) = list_sort(r.n) AND list_sort(l.b) = list_sort(r.b) AS exact_match,
               len(list_filter(l.b, lambda x: len({_OF.format(side="r", v="y")}) > 0 AND {_OF.format(side="l", v="y")} <> {_OF.format(side="r", v="y")})) > 0 AS binding_conflict,
               coalesce({_OPPOSED}, false) AS modality_conflict, {_MINUS.format(a="l", b="r")} AS only_left, {_MINUS.format(a="r", b="l")} AS only_right
        FROM f l JOIN f r ON l.group_id = r.group_id AND l.doc_id < r.doc_id
    ),
    pairs AS MATERIALIZED (
        SELECT group_id, left_doc, right_doc, {sql.fixed("j")} AS term_jaccard, {sql.fixed("o")} AS sentence_overlap, j >= 0.75 AND o >= 0.6 AS near_duplicate, j >= 0.85 AND o >= 0.75 AS strong_near_duplicate,
               exact_match, binding_conflict, modality_conflict, only_left, only_right,
               j >= 0.75 AND o >= 0.6 AND (only_left <> '' OR only_right <> '' OR binding_conflict OR modality_conflict) AS explicit_conflict
        FROM met
    ),
    verdicts AS (
        SELECT group_id, documents, CAST(0 AS BIGINT) AS missing, coalesce(pairs, 0) AS pairs, coalesce(conflicts, 0) AS conflicts, CASE WHEN spread > 1 THEN 'skewed' ELSE 'balanced' END AS balance,
               coalesce(all_match, false) AS no_difference
        FROM (SELECT group_id, count(*) AS documents, max(results) - min(results) AS spread FROM picked GROUP BY group_id)
        LEFT JOIN (SELECT group_id, count(*) AS pairs, count(*) FILTER (explicit_conflict) AS conflicts, bool_and(exact_match AND NOT explicit_conflict) AS all_match FROM pairs GROUP BY group_id) USING (group_id)
    )
"""
_R = retrieval._RANKED

#: Claims of answers against the sentences of the other turns. No turn of the driver's conversations holds a number, code, label or quoted phrase, so anchors and limits are empty.
def _modality(x: str) -> str:
    less = lambda p: "regexp_replace({}, '{}', '', 'g')".format(x, p.replace("'", "''"))
    after_all, double = sql.matches(x, verify.NEGATED_PROHIBITION), sql.matches(x, verify.DOUBLE_NEGATIVE)
    says = [
        ("allow", f"({after_all} OR {sql.matches(less(verify.NEGATED_PERMISSION), verify.ALLOW)})"), ("prohibit", f"(NOT {after_all} AND ({sql.matches(x, verify.NEGATED_PERMISSION)} OR {sql.matches(x, verify.PROHIBIT)}))"),
        ("require", f"({double} OR {sql.matches(less(verify.NEGATED_REQUIREMENT), verify.REQUIRE)})"), ("optional", f"({sql.matches(x, verify.NEGATED_REQUIREMENT)} AND NOT {double})"), ("recommend", sql.matches(x, verify.RECOMMEND)),
    ]
    return " || ".join(f"CASE WHEN {yes} THEN '{name},' ELSE '' END" for name, yes in says)


_CLAIMS = f"""
    claims AS MATERIALIZED (SELECT answer_id, claim_index, claim, {sql.term_set("claim")} AS t, {_modality("claim")} AS m, {sql.matches("claim", verify.NEGATIVE)} AS neg FROM ({answers.ORACLES["claims"]})),
    others AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text FROM conversations WHERE role <> 'assistant'),
    cited AS MATERIALIZED (SELECT a.conv_id * 1000 + a.turn AS answer_id, o.rank, o.turn AS doc_id, o.text FROM conversations a JOIN others o USING (conv_id) WHERE a.role = 'assistant'),
    held AS MATERIALIZED (
        SELECT answer_id, rank, {sql.term_set("s")} AS t, {_modality("s")} AS m, {sql.matches("s", verify.NEGATIVE)} AS neg
        FROM (SELECT answer_id, rank, unnest(list_filter(list_transform({sql.raw_sentences("text")}, lambda x: {sql.strip("x")}), lambda x: x <> '')) AS s FROM cited)
    ),
    against AS (
        SELECT answer_id, claim_index, rank, {sql.fixed("len(list_intersect(c.t, h.t)) / len(c.t)")} AS overlap,
               {sql.fixed("len(list_intersect(c.t, h.t)) / len(c.t)")} >= {verify.LEAST_OVERLAP} AND c.m = h.m AND c.neg = h.neg AS good
        FROM claims c JOIN held h USING (answer_id)
    ),
    best AS (SELECT answer_id, claim_index, bool_or(good) AS supported, max(overlap) AS overlap, max_by(rank, (CAST(good AS INTEGER), overlap, -rank)) AS best_rank FROM against GROUP BY ALL),
    checked AS MATERIALIZED (
        SELECT answer_id, claim_index, claim, coalesce(supported, false) AS supported, coalesce(overlap, 0) AS overlap, CAST(best_rank AS INTEGER) AS best_rank, CAST(0 AS BIGINT) AS missing_ranks
        FROM claims LEFT JOIN best USING (answer_id, claim_index)
    ),
    verdicts AS (
        SELECT *, CASE WHEN has_text THEN '' ELSE 'empty_answer,' END || CASE WHEN citations = 0 THEN 'no_citations,' ELSE '' END || CASE WHEN cited < least(greatest(documents, 1), 2) THEN 'document_coverage,' ELSE '' END
               || CASE WHEN claims > supported THEN 'unsupported_claims,' ELSE '' END AS why
        FROM (
            SELECT conv_id * 1000 + turn AS answer_id, {sql.strip("text")} <> '' AS has_text, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(citations, 0) AS citations,
                   coalesce(documents, 0) AS documents, coalesce(cited, 0) AS cited
            FROM conversations
            LEFT JOIN (SELECT answer_id, count(*) AS claims, count(*) FILTER (supported) AS supported FROM checked GROUP BY 1) k ON k.answer_id = conv_id * 1000 + turn
            LEFT JOIN (SELECT answer_id, count(*) AS citations, count(DISTINCT doc_id) AS documents FROM cited GROUP BY 1) d ON d.answer_id = conv_id * 1000 + turn
            LEFT JOIN (SELECT c.answer_id, count(DISTINCT doc_id) AS cited FROM checked c JOIN cited ON cited.answer_id = c.answer_id AND cited.rank = c.best_rank WHERE supported GROUP BY 1) u ON u.answer_id = conv_id * 1000 + turn
            WHERE role = 'assistant'
        )
    )
"""
_USER = "SELECT conv_id * 1000 + turn AS query_id, conv_id, text AS query, turn + 1 AS documents FROM conversations WHERE role = 'user'"
_TOPIC = rf"""{sql.strip(f"regexp_replace(regexp_extract(whole, '{questions.TOPIC}', 1), '{questions.FILLER}', '')")}"""
_SPLIT = questions.SPLIT
_PIECES = rf"list_filter(list_transform(regexp_split_to_array(whole, '{_SPLIT}'), lambda s: {sql.strip(rf"regexp_replace({sql.strip('s')}, '[?？.。!！]+\z', '')")}), lambda s: len({sql.terms('s')}) > 0)"
_WITH_TOPIC = f"""CASE WHEN topic = '' OR len(list_intersect({sql.term_set("s")}, {sql.term_set("topic")})) > 0 OR len({sql.term_set("topic")}) = 0 THEN s
    WHEN regexp_extract(s, '{questions.PRONOUN}', 1) <> '' THEN regexp_replace(s, '{questions.PRONOUN}', 'the ' || topic) ELSE s || ' for the ' || topic END"""
_CODES = r"regexp_extract_all(query, '(?i)\b[a-z]{2,}[-_]?\d+(?:[-_][a-z0-9]+)*\b')"
_PAIR_SCORE = f"""
    least(1, len(list_intersect(wanted, held)) / len(wanted) * 0.45
        + CASE WHEN (len(wanted) >= 2 AND contains(body, array_to_string(wanted, ' '))) OR (contains({sql.normalize_search("query")}, ' ') AND contains(body, {sql.normalize_search("query")})) THEN 0.25 ELSE 0 END
        + len(list_filter(list_intersect(wanted, held), lambda t: length(t) >= 6)) / greatest(1, len(wanted)) * 0.1)
"""
_BODIES = f"SELECT doc_id, chunk_index, list_distinct(terms) AS held, {sql.normalize_search('chunk_text')} AS body, chunk_text FROM c"
_LEVEL = "CASE WHEN {full} THEN 2 WHEN {part} THEN 1 ELSE 0 END"
_MESSAGES = """
    SELECT conv_id AS owner, turn AS message_id,
           trim(regexp_replace(CASE WHEN conv_id % 10 = 0 THEN 'Remember that ' ELSE '' END || CASE WHEN conv_id % 10 = 1 THEN 'Answer in English and keep it short. ' ELSE '' END || text, '\\s+', ' ', 'g')) AS t
    FROM conversations WHERE role = 'user' AND text IS NOT NULL
"""
_PREFERENCES = [
    (state.ASKS_CHINESE, "reply_language", "zh"), (state.ASKS_ENGLISH, "reply_language", "en"), (state.ASKS_SHORT, "answer_style", "concise"), (state.ASKS_LONG, "answer_style", "detailed"),
]
_NOTE = f"trim(regexp_extract(t, '{state.REMEMBER}', 1))"

ORACLES = {
    "pair_analysis": f"{_R}, {_PAIRS} SELECT * FROM pairs",
    "comparison_verdicts": f"{_R}, {_PAIRS} SELECT * FROM verdicts",
    "pair_diagnostics": f"""
        {_R}, {_PAIRS} SELECT group_id, left_doc, right_doc, concat_ws('; ',
            CASE WHEN explicit_conflict THEN 'explicit conflict' WHEN exact_match THEN 'same evidence' WHEN strong_near_duplicate THEN 'strong near-duplicate' WHEN near_duplicate THEN 'near-duplicate' ELSE 'different evidence' END,
            printf('term Jaccard %.4f', term_jaccard), printf('sentence overlap %.4f', sentence_overlap), CASE WHEN only_left <> '' THEN 'only left: ' || only_left END, CASE WHEN only_right <> '' THEN 'only right: ' || only_right END
        ) AS line FROM pairs
    """,
    "comparison_answers": f"""
        {_R}, {_PAIRS},
        said AS (
            SELECT group_id, string_agg('Documents ' || left_doc || ' and ' || right_doc || ' conflict' || CASE WHEN only_left <> '' OR only_right <> '' THEN
                ' (' || CASE WHEN only_left = '' THEN 'none' ELSE only_left END || ' against ' || CASE WHEN only_right = '' THEN 'none' ELSE only_right END || ')' ELSE '' END || '.', ' ' ORDER BY left_doc, right_doc) AS said
            FROM pairs WHERE explicit_conflict GROUP BY group_id
        )
        SELECT group_id, CASE WHEN no_difference THEN 'The documents show no material difference.' WHEN said IS NOT NULL THEN said ELSE 'The evidence differs without an explicit conflict.' END AS text
        FROM verdicts LEFT JOIN said USING (group_id)
    """,
    "compare_confidence": f"""
        {_R}, {retrieval._RERANKED},
        e AS (SELECT query_id, doc_id, r.score >= 0.32 AS strong, r.score >= 0.32 * 0.8 AS weak, {sql.fixed("len(list_intersect(wanted, terms)) / len(wanted)", 6)} >= 0.51 AS enough FROM reranked r JOIN c USING (doc_id, chunk_index) JOIN q USING (query_id) WHERE rank <= {retrieval.TOP_K}),
        u AS (SELECT query_id, doc_id, bool_or(weak AND enough) AS usable FROM e GROUP BY ALL)
        SELECT query_id, count(*) AS documents, count(*) FILTER (usable) AS covered, count(*) FILTER (usable) > 0 AND count(*) FILTER (usable) >= least(2, count(*)) AS confident
        FROM (SELECT DISTINCT query_id, doc_id FROM sparse) LEFT JOIN u USING (query_id, doc_id) GROUP BY query_id
    """,
    "source_bundle": f"""
        {_R},
        r AS MATERIALIZED (
            SELECT query_id AS group_id, doc_id, chunk_index, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS place,
                   list_transform({sql.numeric_tokens("chunk_text")}, lambda n: 'n' || n) || list_transform({sql.canonical_sentences("chunk_text")}, lambda s: 's' || s) AS items
            FROM sparse JOIN c USING (doc_id, chunk_index)
        ),
        i AS (SELECT group_id, doc_id, chunk_index, unnest(items) AS item FROM r),
        o AS (SELECT group_id, item, count(DISTINCT doc_id) AS owners FROM i GROUP BY ALL),
        a AS (
            SELECT group_id, doc_id, chunk_index, sum(CASE WHEN owners = 1 THEN CASE WHEN item LIKE 'n%' THEN 6 ELSE 3 END WHEN item LIKE 's%' THEN -0.5 ELSE 0 END) AS adds
            FROM i JOIN o USING (group_id, item) GROUP BY ALL
        ),
        v AS (SELECT r.*, CAST(coalesce(adds, 0) AS DOUBLE) + score * 0.01 - (place - 1) * CAST(0.1 AS DOUBLE) AS value FROM r LEFT JOIN a USING (group_id, doc_id, chunk_index)),
        x AS (
            SELECT group_id, doc_id, chunk_index, 'best' AS role, score AS value FROM r WHERE place = 1 UNION ALL
            SELECT group_id, doc_id, chunk_index, 'extra', value FROM (SELECT *, row_number() OVER (PARTITION BY group_id, doc_id ORDER BY value DESC, chunk_index) AS pick FROM v WHERE place > 1) WHERE pick = 1
        )
        SELECT group_id, source_rank, doc_id, chunk_index, role FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY role, value DESC, doc_id) AS source_rank FROM x) WHERE source_rank <= 8
    """,
    "lexical_rerank": f"""
        {_R}, b AS ({_BODIES}),
        m AS (SELECT query_id, doc_id, chunk_index, s.score AS original, {_PAIR_SCORE} AS model FROM sparse s JOIN b USING (doc_id, chunk_index) JOIN q USING (query_id)),
        w AS (SELECT *, min(model) OVER (PARTITION BY query_id) AS low, max(model) OVER (PARTITION BY query_id) AS high FROM m),
        again AS (SELECT query_id, doc_id, chunk_index, original, {sql.fixed("CASE WHEN high > low THEN (model - low) / (high - low) ELSE model END", 6)} AS rerank FROM w),
        mixed AS (SELECT *, {sql.fixed("original * 0.4 + rerank * 0.6", 6)} AS score FROM again)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rerank DESC, original DESC, doc_id, chunk_index) AS rank FROM mixed) WHERE rank <= {retrieval.TOP_K}
    """,
    "evidence_requirements": f"""
        {_R}, b AS ({_BODIES}),
        e AS (SELECT query_id, query, wanted, held, body, chunk_text FROM q LEFT JOIN (SELECT * FROM sparse JOIN b USING (doc_id, chunk_index) WHERE rank <= {retrieval.TOP_K}) USING (query_id)),
        n AS (
            SELECT query_id, 'topic' AS requirement, {_LEVEL.format(full="len(list_intersect(wanted, held)) / len(wanted) >= 0.6", part="len(list_intersect(wanted, held)) / len(wanted) >= 0.25")} AS grade FROM e WHERE len(wanted) > 0 UNION ALL
            SELECT query_id, 'time', {_LEVEL.format(full=sql.matches("chunk_text", questions.HAS_TIME), part="false")} FROM e WHERE {sql.matches("query", questions.ASKS_TIME)} UNION ALL
            SELECT query_id, 'number', {_LEVEL.format(full=sql.matches("chunk_text", "[0-9]"), part="false")} FROM e WHERE {sql.matches("query", questions.ASKS_NUMBER)}
        )
        SELECT query_id, requirement, CASE max(grade) WHEN 2 THEN 'covered' WHEN 1 THEN 'partial' ELSE 'missing' END AS status FROM n GROUP BY ALL
    """,
    "topic_phrases": f"""
        WITH s AS (SELECT doc_id, {sql.terms("summary")} AS w FROM ({TEXT["profile_summary"]})),
        g AS ({" UNION ALL ".join(f"SELECT doc_id, i, array_to_string(w[i + 1 : i + {n}], ' ') AS phrase, {0.8 if n == 1 else 1.35 * n} + 0.6 * {n - 1} + 1.0 / (i + 1) AS weight FROM (SELECT doc_id, w, unnest(range(0, len(w) - {n} + 1)) AS i FROM s WHERE len(w) >= {n})" for n in (1, 2, 3))}),
        t AS (SELECT doc_id, tag AS phrase, 8.0 - (tag_rank - 1) * 0.15 AS weight FROM ({_TAGS}) WHERE tag_rank <= 4),
        a AS (SELECT doc_id, phrase, CAST(weight AS DOUBLE) AS weight FROM t UNION ALL SELECT doc_id, phrase, CAST(weight AS DOUBLE) FROM g WHERE doc_id IN (SELECT doc_id FROM t)),
        p AS (SELECT doc_id, phrase, {sql.fixed("sum(weight)", 6)} AS weight FROM a GROUP BY ALL)
        SELECT doc_id, phrase, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, phrase) AS place FROM p) WHERE place <= 5
    """,
    "claim_support": f"WITH {_CLAIMS} SELECT * FROM checked",
    "answer_verdicts": f"WITH {_CLAIMS} SELECT answer_id, claims, supported, claims - supported AS unsupported, cited AS cited_documents, citations * 2 + cited + CAST(has_text AS INTEGER) + supported - (claims - supported) * 3 AS score, why = '' AS passed, rtrim(why, ',') AS reasons FROM verdicts",
    "grounded_answers": f"""
        WITH {_CLAIMS}
        SELECT answer_id, CASE WHEN count(*) FILTER (supported) > 0 THEN string_agg(claim || '.', chr(10) ORDER BY claim_index) FILTER (supported) ELSE 'The documents do not answer this.' END AS text,
               count(*) FILTER (supported) AS kept, count(*) FILTER (NOT supported) AS dropped
        FROM checked GROUP BY answer_id
    """,
    "remembered_claims": rf"WITH {_CLAIMS} SELECT answer_id, key, bool_or(supported) AS supported FROM (SELECT answer_id, supported, lower({sql.strip(r"regexp_replace(claim, '\s+', ' ', 'g')")}) AS key FROM checked) WHERE key <> '' GROUP BY ALL",
    "evidence_gaps": f"WITH {_CLAIMS} SELECT answer_id, unnest(string_split(rtrim(why, ','), ',')) AS gap, CAST(generate_subscripts(string_split(rtrim(why, ','), ','), 1) - 1 AS INTEGER) AS gap_no FROM verdicts WHERE why <> ''",
    "question_plans": f"""
        SELECT query_id, intent, CAST(CASE intent {" ".join(f"WHEN '{k}' THEN {a}" for k, (a, _) in questions.INTENT_DEPTH.items())} END AS INTEGER) AS top_k,
               CAST(CASE intent {" ".join(f"WHEN '{k}' THEN {b}" for k, (_, b) in questions.INTENT_DEPTH.items())} END AS INTEGER) AS per_document
        FROM (
            SELECT query_id, CASE WHEN {sql.matches("query", questions.TIMELINE)} THEN 'timeline' WHEN documents > 1 AND {sql.matches("query", questions.COMPARISON)} THEN 'comparison'
                                  WHEN {sql.matches("query", questions.ANALYSIS)} THEN 'analysis' ELSE 'fact' END AS intent FROM ({_USER})
        )
    """,
    "question_parts": f"""
        WITH w AS (SELECT query_id, {sql.normalize_whitespace("query")} AS whole FROM ({_USER}) WHERE query IS NOT NULL),
        t AS (SELECT query_id, whole, {_TOPIC} AS topic, {_PIECES} AS pieces FROM w),
        l AS (SELECT query_id, [whole] || CASE WHEN len(pieces) >= 2 THEN list_transform(pieces, lambda s: {_WITH_TOPIC})[1:4] ELSE [] END AS listed FROM t),
        e AS (SELECT query_id, unnest(listed) AS part, generate_subscripts(listed, 1) - 1 AS part_no FROM l)
        SELECT query_id, CAST(part_no AS INTEGER) AS part_no, part, part_no = 0 AS is_primary
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY part_no) AS turn FROM (SELECT *, {sql.normalize_search("part")} AS key FROM e) WHERE key <> '') WHERE turn = 1
    """,
    "external_queries": rf"""
        WITH u AS ({_USER}), secret AS (
            SELECT DISTINCT query_id, unnest({sql.term_set("c.text")}) AS term FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.role <> 'user'
        ),
        e AS (
            SELECT query_id, unnest(words) AS term, generate_subscripts(words, 1) AS place, codes
            FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(coalesce(query, '')), '[^\p{{L}}\p{{N}}_-]+'), lambda w: w <> '') AS words,
                         flatten(list_transform({_CODES}, lambda x: [lower(x)] || regexp_split_to_array(lower(x), '[-_]'))) AS codes FROM u)
        ),
        r AS (
            SELECT e.*, CASE WHEN NOT regexp_matches(term, '^[\p{{L}}][\p{{L}}\p{{N}}-]{{2,40}}$') THEN 'unsafe_query_term' WHEN term IN ({sql.quoted(STOP_WORDS)}) THEN 'generic_or_restricted_term'
                             WHEN secret.term IS NOT NULL THEN 'sensitive_profile_term' WHEN list_contains(codes, term) THEN 'internal_identifier' END AS reason
            FROM e LEFT JOIN secret USING (query_id, term)
        ),
        k AS (SELECT *, reason IS NULL AND place = min(place) OVER (PARTITION BY query_id, term) AS fresh FROM r),
        n AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY query_id ORDER BY place) AS turn FROM k)
        SELECT query_id, coalesce(string_agg(term, ' ' ORDER BY place) FILTER (fresh AND turn <= 8), '') AS safe_query, count(reason) AS removed,
               coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ','), '') AS reasons
        FROM u LEFT JOIN n USING (query_id) GROUP BY query_id
    """,
    "memory_candidates": f"""
        WITH m AS ({_MESSAGES})
        {" UNION ALL ".join(f"SELECT owner, message_id, 'preference' AS category, '{k}' AS key, '{v}' AS value FROM m WHERE {sql.matches('t', p)}" for p, k, v in _PREFERENCES)} UNION ALL
        SELECT owner, message_id, 'note', NULL, {_NOTE} FROM m WHERE length({_NOTE}) >= 6 AND NOT ({" OR ".join(sql.matches(_NOTE, p) for p, *_ in _PREFERENCES)})
    """,
}
