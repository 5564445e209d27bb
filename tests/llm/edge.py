"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, h string, score double, class_id long, windows string, version int"

LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def rows():
    texts = [
        (1, "the cat sat on the mat with a hat and a bat"),
        (2, None),
        (3, ""),
        (4, "the cat sat on the mat with a hat and a bat"),
        (4, "the cat sat on the mat with a hat and a bat"),
        (5, "   \n\t "),
        (6, LONG),
        (7, LONG + " end"),
        (8, "start " + PASSAGE + " middle " + PASSAGE),
        (9, PASSAGE),
        (None, "text without id"),
        (None, PASSAGE),
        (10, "word"),
        (11, "漢字 😀 zoë"),
        (12, "1234 5678"),
        (12, "another text of the same id"),
    ]
    extra = (True, "h", 0.5, 7, "w", 1)
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src0", None if k % 3 == 0 else 1, *extra) for k, (i, t) in enumerate(texts)]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
