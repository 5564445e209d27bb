"""Column functions on literal rows: CJK, punctuation, nulls, ties."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **literals):
        frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()], F.lit(1).alias("_"))
        return frame.select(column.alias("x")).first()["x"]

    return value




@pytest.mark.parametrize(
    ("given", "want"),
    [("a\r\nb  c\t\n\n\n\nd ", "a\nb c\n\nd"), ("", ""), ("  x\x00y ", "xy")],
)
def test_whitespace(one, given, want):
    assert one(text.normalize_whitespace(F.col("t")), t=given) == want


def test_clean_page_joins_hyphenated_words(one):
    assert one(text.clean_page(F.col("t")), t="exam-\nple and Non-\nProfit") == "example and Non-\nProfit"


@pytest.mark.parametrize(
    ("given", "tokens", "terms"),
    [
        ("The VPN-2 Policy, 漢字!", ["the", "vpn", "2", "policy", "漢", "字"], ["vpn", "漢", "字"]),
        ("", [], []),
        ("a I x", ["a", "i", "x"], []),
    ],
)
def test_tokens(one, given, tokens, terms):
    assert one(text.tokens(F.col("t")), t=given) == tokens and one(text.terms(F.col("t")), t=given) == terms


def test_null_text_has_no_terms(one):
    assert one(text.terms(F.lit(None).cast("string"))) == []


def test_sentences(one):
    given = "One two. Three 1,000.50 times!\nFour? 五。 Six"
    assert one(text.sentences(F.col("t")), t=given) == ["One two.", "Three 1,000.50 times!", "Four?", "五。", "Six"]
    assert one(text.canonical_sentences(F.col("t")), t="Pay $5 now. pay  $7 NOW.") == ["pay <num> now."]


@pytest.mark.parametrize(
    ("given", "want"),
    [("2.0", "2"), ("$1,000.50", "$1000.5"), ("007", "7"), ("0", "0"), ("50%", "50%"), ("1/2", "1/2"), ("10.", "10"), ("3.140,", "3.14"), ("000", "0")],
)
def test_numbers(one, given, want):
    assert one(text.normalize_number(F.col("t")), t=given) == want


def test_anchors(one):
    got = one(text.anchors(F.col("t")), t='See "travel budget" and ISO-27001, iso-27001; “remote work” but "of the"')
    assert [(a["kind"], a["phrase"]) for a in got] == [("code", "iso 27001"), ("quoted_phrase", "travel budget"), ("quoted_phrase", "remote work")]
    assert got[1]["terms"] == ["travel", "budget"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Scope:", True), ("1.2 Terms", True), ("1. Terms", False), ("IV. Payment", False), ("A", True), ("AB-1 OK", True), ("Terms & Rules", False), ("第二部 总则", True), ("第三款", True), ("第十一队", False), ("Remote Work Policy", True), ("TRAVEL AND MEALS", True), ("第三章 总则", True),
        ("This is an ordinary sentence of prose that ends in a full stop.", False), ("x" * 95 + ":", False), ("", False), ("word", False),
    ],
)
def test_headings(one, line, want):
    assert one(text.is_heading(F.col("t")), t=line) is want


def test_html(one):
    page = "<html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><h1>Top</h1><p>One <b>two</b><br>three</p></body></html>"
    assert one(text.html_text(F.col("t")), t=page) == "A & B\nTop\nOne two\nthree"


def test_scores(one):
    a, b = F.array(*map(F.lit, [1.0, 2.0])), F.array(*map(F.lit, [2.0, 4.0]))
    assert one(scores.cosine(a, b)) == pytest.approx(1.0)
    assert one(scores.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    assert one(scores.jaccard(words(), words())) == 1.0 and one(scores.jaccard(words("a", "b"), words("b"))) == 0.5
    assert one(scores.overlap(words("a", "b"), words("b"))) == 1.0 and one(scores.overlap(words(), words("b"))) == 0.0
    assert one(scores.keyword_score(words(), words("a"))) is None
    assert one(scores.combined_score(F.lit(0.5), F.lit(None).cast("double"))) == 0.5
    assert one(scores.combined_score(F.lit(0.5), F.lit(0.9))) == 0.9
    assert one(scores.fixed(F.lit(0.12345))) == 0.1235
    assert one(scores.ratio(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (4, 1), (5, 2), (None, None)])
def test_token_estimate(one, n, want):
    assert one(scores.token_estimate(F.lit(n).cast("int"))) == want


def test_embedding_forms_agree(one):
    from tessera.operators.retrieval import hash_embed

    given = ["alpha", "beta", "漢", "alpha"]
    assert one(scores.hash_embedding(F.array(*map(F.lit, given)))) == hash_embed([given])[0].tolist()
