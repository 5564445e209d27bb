"""Text primitives as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "these", "those", "to", "was",
    "what", "when", "where", "which", "who", "why", "with", "vs", "versus", "can", "could", "should", "would", "will", "have", "has", "had", "do", "does", "did", "i", "you", "we",
    "they", "he", "she", "them", "our", "your", "his", "her", "its", "theirs", "ours", "yours", "about", "against", "between", "policy", "policies", "document", "documents", "file",
    "files", "than", "then", "there", "here", "also", "just", "compare", "comparison", "different", "difference", "same", "similar", "conflict", "contrast", "contradict", "not", "no",
    "yes", "比较", "区别", "差异", "哪些", "什么", "这个", "那个", "一下", "里面", "可以", "是否", "以及", "还是", "进行", "一个", "一种", "我们", "你们", "他们",
]
# Words that make no tag of a document.
TAG_STOP_WORDS = [
    "policy", "policies", "document", "documents", "employee", "employees", "requirement", "requirements", "section", "sections", "page", "pages", "must", "may", "with", "from", "per",
    "this", "that", "they", "their", "there", "where", "which", "about", "approved", "approval", "manager", "客户", "文档", "政策", "要求", "资料", "文件",
]

TOKEN = "[A-Za-z0-9]+|[一-鿿]"
CODE_LIKE = r"(?i)\b[a-z0-9]{2,}(?:-[a-z0-9]{1,})+\b"
NUMBER = r"\$?\d[\d,./-]*%?"
ENTITY = r"\b(?:[A-Z][A-Za-z0-9&/-]{2,}(?:\s+[A-Z][A-Za-z0-9&/-]{2,}){0,4}|[A-Z]{2,})\b"
# How headings begin, or read as a whole.
NUMBERED = r"^[0-9]+(\.[0-9]+)*\s+\S"
CHAPTER = "^第[一-龥0-9]+[章节部分条款]"
TITLE_CASE = r"^[A-Z][A-Za-z0-9/-]*( [A-Z][A-Za-z0-9/-]*){1,7}\z"
SENTENCE_END = r"(?<=[.!?。！？])\s+|\n+"


def ascii_words(pattern: str) -> str:
    """The pattern with word boundaries between ASCII words, where Java's own also know other letters."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def normalize_whitespace(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\x00"), F.lit("")), F.lit("\r"), F.lit(""))
    for pattern, by in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def tidy(text: Column) -> Column:
    """normalize_whitespace() of a column; texts that hold nothing to be changed are only stripped, as its patterns
    cost most of reading a text."""
    odd = ("  ", " \n", "\n\n\n", "\t", "\r", "\x00")
    changed = text.contains(odd[0])
    for what in odd[1:]:
        changed |= text.contains(what)
    return F.when(changed, normalize_whitespace(text)).otherwise(strip(text))


def clean_page(text: Column) -> Column:
    """A page's text: without NUL and CR, words joined that a line break hyphenates, tidy spaces."""
    for pattern, by in (("[\\x00\\r]", ""), ("-\\n(?=[a-z])", ""), (r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def normalize_search(text: Column) -> Column:
    """Lower case; runs of anything but letters, digits and CJK as one space."""
    return F.trim(F.regexp_replace(F.lower(normalize_whitespace(text)), "[^a-z0-9一-鿿]+", " "))


def normalize_token(token: Column) -> Column:
    """Lower case, without anything but letters, digits and CJK at either end."""
    return F.regexp_replace(F.lower(token), "^[^a-z0-9一-鿿]+|[^a-z0-9一-鿿]+\\z", "")


def tokens(text: Column) -> Column:
    """Words of ASCII letters and digits, and single CJK characters, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def is_meaningful(token: Column) -> Column:
    return ((F.length(token) > 1) | token.rlike("[一-鿿]")) & ~token.isin(STOP_WORDS)


def terms(text: Column) -> Column:
    """Meaningful tokens in order, repeats included; empty for null."""
    return F.coalesce(F.filter(tokens(text), is_meaningful), F.array().cast("array<string>"))


def term_set(text: Column) -> Column:
    return F.array_distinct(terms(text))


def sentences(text: Column) -> Column:
    """Non-empty sentences of normalised text."""
    return F.filter(F.transform(F.split(normalize_whitespace(text), SENTENCE_END), strip), lambda s: s != "")


def canonical_sentences(text: Column) -> Column:
    """Distinct sentences, lower-cased, numbers as <num>, white space collapsed."""

    def canonical(s: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(F.lower(s), NUMBER, "<num>"), r"\s+", " "))

    return F.array_distinct(F.filter(F.transform(F.split(normalize_whitespace(text), SENTENCE_END), canonical), lambda s: s != ""))


def normalize_number(token: Column) -> Column:
    """Without thousands separators, leading zeros and trailing decimal zeros; others unchanged."""
    plain = F.regexp_replace(F.lower(token), r"[.,]+\z", "")
    whole = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, r"^\$?(\d[\d,]*)", 1), ",", ""), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_extract(plain, r"^\$?\d[\d,]*\.(\d+)", 1), r"0+\z", "")
    dollar = F.when(plain.startswith("$"), "$").otherwise("")
    percent = F.when(plain.endswith("%"), "%").otherwise("")
    dotted = F.when(part == "", "").otherwise(F.concat(F.lit("."), part))
    return F.when(plain.rlike(r"^\$?\d[\d,]*(\.\d+)?%?\z"), F.concat(dollar, whole, dotted, percent)).otherwise(plain)


def numeric_tokens(text: Column) -> Column:
    """Distinct normalised numbers of the text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(normalize_whitespace(text), F.lit(f"({NUMBER})"), F.lit(1)), normalize_number))


def code_anchors(text: Column) -> Column:
    """Distinct hyphenated codes, lower-cased as search text."""
    found = F.regexp_extract_all(text, F.lit(f"({ascii_words(CODE_LIKE)})"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, normalize_search)), lambda a: F.size(terms(a)) > 0)


def quoted_anchors(text: Column) -> Column:
    """Distinct phrases in straight or curly quotes, as search text."""
    straight = F.regexp_extract_all(text, F.lit('"([^"\\n]{2,})"'), F.lit(1))
    curly = F.regexp_extract_all(text, F.lit("“([^”\\n]{2,})”"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(F.concat(straight, curly), normalize_search)), lambda a: F.size(terms(a)) > 0)


def anchors(text: Column) -> Column:
    """Codes and quoted phrases as structs of kind, phrase and terms."""
    named = lambda kind, xs: F.transform(xs, lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("phrase"), F.array_distinct(terms(a)).alias("terms")))
    return F.concat(named("code", code_anchors(text)), named("quoted_phrase", quoted_anchors(text)))


def matches_anchor(anchor: Column, search_text: Column, found_terms: Column) -> Column:
    """The phrase occurs, or all its terms do."""
    return search_text.contains(anchor["phrase"]) | (F.size(F.array_except(anchor["terms"], found_terms)) == 0)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(normalize_whitespace(text), r"\n+"), normalize_whitespace), lambda p: p != "")


def excerpt(text: Column, limit: int = 220) -> Column:
    """White space collapsed, cut to limit characters."""
    return F.substring(strip(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def searchable(file_name: Column, heading: Column, content: Column) -> Column:
    """File name, section heading and content on lines of their own, empty ones left out."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (file_name, heading, content)])


def is_heading(line: Column) -> Column:
    """Lines of 90 characters and twelve words at most that end in a colon, begin with a section number
    or a chapter, are two to eight words in title case, or whose letters are mostly capitals."""
    compact = strip(F.regexp_replace(line, r"\s+", " "))
    letters = F.length(F.regexp_replace(compact, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(compact, "[^A-Z]", ""))
    short = (compact != "") & (F.length(line) <= 90) & (F.size(F.split(compact, " ")) <= 12)
    form = compact.rlike("[:：]\\z") | compact.rlike(NUMBERED) | compact.rlike(CHAPTER) | compact.rlike(TITLE_CASE)
    return F.coalesce(short & (form | (capitals * 10 > letters * 7)), F.lit(False))


def html_text(html: Column) -> Column:
    """Visible text of a page: blocks on lines, scripts, styles, comments and tags removed."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(/?(p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|body|head)\b[^>]*|br\s*/?)>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(by))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def unnest(rows, keys: list, array: Column, name: str):
    """keys and one row per element. A plain explode makes Spark compute the array a second time, to
    drop empty ones early; where the array is costly, the nulls of an outer one are dropped instead."""
    return rows.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def unnest_numbered(rows, keys: list, array: Column, place: str, name: str):
    """unnest with the element's place, from 0."""
    return rows.select(*keys, F.posexplode_outer(array).alias(place, name)).where(F.col(name).isNotNull())
