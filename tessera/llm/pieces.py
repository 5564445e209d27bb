"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character (checked when the
model is loaded), so merges never cross from one marked word to the next. Each text is cut at its
markers, distinct marked words are segmented once, and ids are joined back by position:
  1. Spark counts the distinct chunks of all texts;
  2. the commonest, as many whole ranks of about equal counts as fit max_entries, are segmented, each once, by the tasks
     of a Spark stage, and their table of ids is broadcast;
  3. every text looks its chunks up by position. A chunk beyond the table is segmented by the task
     that meets it, at most once a run of rows.
Vocabularies grow with the corpus without bound, so a table of all chunks can't be broadcast, and
joining the rare ones by a shuffle of words and texts would move about two and a half times the
input, to spare each rare word, which occurs once or twice, its second segmentation (see README).
The table's size changes cost, never ids.

Defined results: a null text counts as empty and has no ids; a literal U+2581 is a marker, as in
the library; repeated rows each get the same result; empty tables give empty results; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.words import slices

MARK = "▁"
MAX_ENTRIES = 200_000
CHUNK = re.compile(r" +[^ ]*")


class Segmenter:
    """chunk -> (ids joined by commas and ended by one, decoded text)."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a whitespace marker; chunks can't be segmented alone")

    def segment(self, chunks: list[str]) -> dict[str, tuple[str, str]]:
        # a chunk starts with the marker that the library itself puts before a text
        ids = self.library.encode([c[1:] or " " for c in chunks], num_threads=1)
        words = self.library.decode(ids, num_threads=1)
        out = {}
        for c, i, w in zip(chunks, ids, words):
            if c == " ":
                i, w = self.alone()
            out[c] = ("".join(f"{x}," for x in i), " " + w)
        return out

    def alone(self) -> tuple[list[int], str]:
        """One marker with nothing after it, as at the end of a text."""
        ids = self.library.encode("a ", num_threads=1)
        first = self.library.encode("a", num_threads=1)
        return ids[len(first) :], ""

    def encode_all(self, texts: list[str], table: dict[str, tuple[str, str]]) -> Iterator[tuple[str, str]]:
        """Of each text the ids as decimals joined by commas, and the decoded text."""
        cut = [CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        rare = {c for chunks in cut for c in chunks if c not in table}
        known = self.segment(list(rare)) if rare else {}
        for chunks in cut:
            got = [table[c] if c in table else known[c] for c in chunks] if known else [table[c] for c in chunks]
            yield "".join([x[0] for x in got])[:-1], "".join([x[1] for x in got])[1:]


_segmenters: dict[str, Segmenter] = {}


def segmenter(model_file: str) -> Segmenter:
    if model_file not in _segmenters:
        _segmenters[model_file] = Segmenter(model_file)
    return _segmenters[model_file]


def chunk_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """chunk, n: the distinct marked words of all texts."""
    marked = F.concat(F.lit(" "), F.translate(F.col(f"`{text_col}`"), MARK, " "))
    chunks = F.explode(F.split(marked, "(?<=[^ ])(?= )")).alias("chunk")
    return docs.where(F.col(f"`{text_col}`") != "").select(chunks).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def segmented(chunks: DataFrame, model_file: str) -> DataFrame:
    """chunk, ids, word: each chunk segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = segmenter(model_file).segment(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found.values()], pa.string()) for k in (0, 1))], ["chunk", "ids", "word"])

    return chunks.select("chunk").mapInArrow(run, "chunk string, ids string, word string")


def chunk_table(docs: DataFrame, model_file: str, max_entries: int = MAX_ENTRIES, text_col: str = "text") -> Broadcast:
    """The table of the commonest chunks, max_entries at most, on every executor."""
    rank = F.floor(8 * F.log2("n")).cast("int")
    counts = stored(chunk_counts(docs, text_col).where("n > 1").withColumn("rank", rank))  # a chunk that occurs once is not worth its place
    left, least = max_entries, None
    for row in counts.groupBy("rank").count().orderBy(F.desc("rank")).collect():  # some hundreds at most
        left -= row["count"]
        if left < 0:
            break
        least = row["rank"]
    chosen = counts.where(F.col("rank") >= least if least is not None else F.lit(False))
    rows = segmented(chosen.repartition(docs.sparkSession.sparkContext.defaultParallelism), model_file).collect()
    return docs.sparkSession.sparkContext.broadcast({r[0]: (r[1], r[2]) for r in rows})


def _encoded(docs: DataFrame, model_file: str, max_entries: int, id_col: str, text_col: str, columns: str, describe: Callable[[str, str], tuple]) -> DataFrame:
    """doc_id and what describe(ids, decoded) gives for each text."""
    table = chunk_table(docs, model_file, max_entries, text_col)
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, known = segmenter(model_file), table.value
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [describe(ids, decoded) for ids, decoded in library.encode_all(texts, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), types))], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, {columns}")


def piece_codec(docs: DataFrame, model_file: str, max_entries: int = MAX_ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded: every text encoded, and its ids decoded again."""
    each = lambda ids, decoded: ([int(x) for x in ids.split(",")] if ids else [], decoded)
    return _encoded(docs, model_file, max_entries, id_col, text_col, "ids array<int>, decoded string", each)


def piece_digests(docs: DataFrame, model_file: str, max_entries: int = MAX_ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what piece_codec gives, without moving it."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    each = lambda ids, decoded: (ids.count(",") + 1 if ids else 0, sha(ids), sha(decoded))
    return _encoded(docs, model_file, max_entries, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", each)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op9_pieces": op9_pieces}
ORACLES: dict[str, str] = {}
