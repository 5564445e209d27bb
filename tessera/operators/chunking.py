"""Cutting documents into chunks: fixed windows and structure-aware chunks, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_heading, normalize_whitespace, paragraphs, strip, tidy, unnest_numbered

SIZE, OVERLAP = 900, 180


def fixed_windows(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, chunk_index, chunk_text: overlapping windows of the normalised text, blank ones left out.

    No window starts where the one before it has already reached the end. One narrow map: nothing
    is shuffled.
    """
    step = max(1, size - min(overlap, size - 1))
    # one pass of a pattern: substrings by position would each be counted from the beginning of the text
    windows = F.regexp_extract_all("body", F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    kept = F.filter(windows, lambda w, i: (i == 0) | (i * step + (size - step) < F.col("length")))
    cut = F.filter(F.transform(kept, strip), lambda c: c != "")
    rows = pages.where(F.col(text_col).isNotNull()).select(*keys, tidy(F.col(text_col)).alias("body"))
    rows = rows.select(*keys, "body", F.length("body").alias("length"))
    return unnest_numbered(rows, list(keys), cut, "chunk_index", "chunk_text")


def number_across_pages(chunks: DataFrame, doc_col: str = "doc_id", page_col: str = "page_number") -> DataFrame:
    """chunk_index runs on from page to page of a document."""
    from pyspark.sql import Window

    order = Window.partitionBy(doc_col).orderBy(page_col, "chunk_index")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1)


def section_lines(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, line_number, line, is_heading, section: each line with the heading it stands under."""
    from pyspark.sql import Window

    rows = unnest_numbered(docs.where(F.col(text_col).isNotNull()), list(keys), paragraphs(F.col(text_col)), "line_number", "line")
    rows = rows.withColumn("is_heading", is_heading(F.col("line")))
    before = Window.partitionBy(*keys).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(F.col("is_heading"), F.col("line")), ignorenulls=True).over(before))


def split_long(paragraph: Column, size: int) -> Column:
    """The paragraph, or beyond size its sentences packed up to size. A sentence that is too long is
    sliced where nothing is held before it; after others it stays whole, as a piece of its own."""
    normal = F.filter(F.transform(F.split(paragraph, r"(?<=[.!?。！？])\s+"), normalize_whitespace), lambda s: s != "")
    none = F.array().cast("array<string>")

    def slices(sentence: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.length(sentence) - 1, F.lit(size)), lambda i: strip(F.substring(sentence, i + 1, F.lit(size))))
        return F.filter(cuts, lambda c: c != "")

    def add(held: Column, sentence: Column) -> Column:
        alone = held["last"] == ""
        longer = F.when(alone, sentence).otherwise(F.concat(held["last"], F.lit(" "), sentence))
        state = lambda out, last: F.struct(out.alias("out"), last.alias("last"))
        return F.when(F.length(longer) <= size, state(held["out"], longer)).when(alone, state(F.concat(held["out"], slices(sentence)), F.lit(""))).otherwise(state(F.concat(held["out"], F.array(held["last"])), sentence))

    packed = F.aggregate(normal, F.struct(none.alias("out"), F.lit("").alias("last")), add, lambda h: F.when(h["last"] == "", h["out"]).otherwise(F.concat(h["out"], F.array(h["last"]))))
    return F.when(F.length(paragraph) <= size, F.array(paragraph)).otherwise(packed)


def pack_paragraphs(pieces: Column, size: int, overlap: int) -> Column:
    """Structs of section_heading and chunk_text from pieces (structs of text and head, in order).

    A heading closes the chunk before it and heads those after it. A chunk that the next piece would
    make longer than size is closed, and hands on its last pieces, as many as reach the overlap (one
    at least, all where they don't). A heading without text under it makes no chunk.
    """
    none = F.array().cast("array<string>")
    lengths = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))

    def closed(state: Column) -> Column:
        headed = F.when(state["heading"].isNull(), state["held"]).otherwise(F.concat(F.array(state["heading"]), state["held"]))
        chunk = F.struct(state["heading"].alias("section_heading"), F.array_join(headed, "\n\n").alias("chunk_text"))
        return F.when(F.size(state["held"]) > 0, F.concat(state["out"], F.array(chunk))).otherwise(state["out"])

    def add(state: Column, piece: Column) -> Column:
        held = state["held"]
        carried = F.filter(held, lambda x, i: (i + 1 == F.size(held)) | (lengths(F.slice(held, i + 2, F.size(held))) < overlap))
        full = (F.size(held) > 0) & (lengths(held) + 2 * F.size(held) + F.length(piece["text"]) > size)
        new = lambda out, heading, held: F.struct(out.alias("out"), heading.alias("heading"), held.alias("held"))
        one = F.array(piece["text"])
        return F.when(piece["head"], new(closed(state), piece["text"], none)).when(full, new(closed(state), state["heading"], F.concat(carried, one))).otherwise(new(state["out"], state["heading"], F.concat(held, one)))

    start = F.struct(F.array().cast("array<struct<section_heading:string,chunk_text:string>>").alias("out"), F.lit(None).cast("string").alias("heading"), none.alias("held"))
    return F.aggregate(pieces, start, add, closed)


def structured_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, chunk_index, section_heading, chunk_text: whole paragraphs under their heading.

    Headings are looked for after long paragraphs are split. One narrow map, without Python and
    without a shuffle; null and blank texts give no chunk.
    """
    pieces = F.flatten(F.transform(paragraphs(F.col(text_col)), lambda p: split_long(p, size)))
    rows = pages.where(F.col(text_col).isNotNull()).select(*keys, pieces.alias("pieces"))
    marked = F.transform("pieces", lambda p: F.struct(p.alias("text"), is_heading(p).alias("head")))
    rows = rows.select(*keys, marked.alias("pieces"))
    chunks = unnest_numbered(rows, list(keys), pack_paragraphs(F.col("pieces"), size, overlap), "chunk_index", "c")
    return chunks.select(*keys, "chunk_index", "c.section_heading", "c.chunk_text")
