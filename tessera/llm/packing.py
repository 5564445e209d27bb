"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

A document of n ids is cut into pieces of max_length, then the binary digits of the rest, longest
first. Each piece is a sequence of its own. Sequences are bucketed by length: their ids run through
the longest bucket first, so equal lengths have neighbouring ids and a training run reads each
bucket with one batch shape. Within a bucket they are ordered by a block (a hash of the piece) and
then by document and place, so ids depend on the rows alone, not on how they are split into files
or tasks, and no task sees more than a block.

Ids are those of the tokenizers file; tiktoken computes them from the same vocabulary, as its
merges by rank give the same ids several times faster (tested against the tokenizers library on
every code point, and on long runs). Texts that hold the string of the special token go to the
tokenizers library itself.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are
packed each, with a sequence id each; a null id is kept; empty tables give empty results; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.words import slices

SPECIAL = "<|endoftext|>"
#: Ids of one block, on average.
BLOCK = 4_000_000


class ByteTokenizer:
    """text -> ids of the byte-level vocabulary."""

    def __init__(self, ranks_file: str, json_file: str, pattern: str):
        import tiktoken

        self.json_file, self.exact = json_file, None
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.json_file)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.encoding.encode_to_numpy(text)


_tokenizers: dict[tuple, ByteTokenizer] = {}


def byte_tokenizer(*files: str) -> ByteTokenizer:
    if files not in _tokenizers:
        _tokenizers[files] = ByteTokenizer(*files)
    return _tokenizers[files]


def piece_lengths(n: int, max_length: int) -> list[int]:
    """n as max_length's and then falling powers of two."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_binary(
    docs: DataFrame,
    ranks_file: str,
    json_file: str,
    pattern: str,
    max_length: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length (its bucket), ids_crc32, doc_tokens, sequence_id,
    offset, and with_ids the ids themselves. max_length is a power of two."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(ranks_file, json_file, pattern)
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            row, start, length, crc, total, ids_of = [], [], [], [], [], []
            for r, text in enumerate(batch.column(1)):
                ids = np.append(tokenizer.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                raw, at = memoryview(ids).cast("B"), 0
                for n in piece_lengths(len(ids), max_length):
                    row.append(r)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(ids))
                    at += n
                if with_ids:
                    ids_of.append(ids)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                values = np.concatenate(ids_of).astype(np.int32) if ids_of else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
    return bucketed(stored(pieces), block).withColumn("offset", F.lit(0).cast("long"))


def bucketed(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """pieces with sequence_id, from 0 without gaps, the longest first. Counts by length and block,
    summed over runs of blocks and within each, tell where each block's ids begin."""
    blocks = max(1, -(-(pieces.agg(F.sum("length")).first()[0] or 0) // block))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(blocks)))
    counts = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.expr("block DIV 1024"))
    before = lambda window: F.sum("n").over(window) - F.col("n")
    within = counts.withColumn("within", before(Window.partitionBy("length", "run").orderBy("block")))
    runs = counts.groupBy("length", "run").agg(F.sum("n").alias("n")).withColumn("base", before(Window.orderBy(F.desc("length"), "run")))
    begin = within.join(runs.select("length", "run", "base"), ["length", "run"]).select("length", "block", (F.col("base") + F.col("within")).alias("begin"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    numbered = dealt.withColumn("turn", F.row_number().over(order)).join(begin, ["length", "block"])
    return numbered.select(*pieces.columns, (F.col("begin") + F.col("turn") - 1).alias("sequence_id"))


def pack_documents(docs: DataFrame, with_ids: bool) -> DataFrame:
    """pack_binary with the public byte-level vocabulary."""
    import public_tokenizers as public

    return pack_binary(docs, public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN, with_ids=with_ids)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
