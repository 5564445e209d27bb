"""Line dedup: two Bloom filters find suspected repeats, only these are confirmed exactly.

A line's key is the line stripped of white space, in lower case. The filters have the same bits: one
of keys seen once, one of keys seen twice.
  1. Each task of the first pass turns the distinct keys of its documents into sorted bit positions,
     by segments of the filter; a segment's task counts how many tasks set each bit. A bit set once
     belongs to the first filter, a bit set twice, or by a key that one task saw in two documents,
     to the second. Only the second is used further: a key that two documents hold has all its bits there.
  2. The second filter is broadcast. Lines whose key it holds are suspects; each leaves its task as
     32 bytes of SHA-256 and a document id. Grouping these decides exactly (by SHA-256 of the key):
     how many documents hold a key, and which of them keeps it.
  3. A document without suspects is finished where it is read. The others meet the keys they lose.

Memory: the filter takes BITS_A_LINE bits for each line, as counted before, and at most MAX_BITS
(64 MB), whatever the corpus. Beyond that it fills up: more lines are suspects and 40 bytes of each are
shuffled, at worst of all lines. That costs time, never rows. A key that very many lines have is
one position a task in step 1; in step 2 its rows are dealt by key and document before they are counted.

Defined results: null and empty texts have one empty line; lines shorter than the least length stay;
rows of one id are one document, and all rows without id are one, of smaller id than any other; a key
repeated inside one document counts once, and all its lines go or stay together; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.terms import text_column
from tessera.llm.words import slices

BLANK = b" \t\n\x0b\x0c\r"
BITS_A_LINE = 4
MAX_BITS = 1 << 29
SEGMENT_BITS = 1 << 20
#: Keys that a task gathers before it hands their positions on.
GATHERED = 1 << 19


def line_keys(text: bytes, least: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and key of each line whose key has at least so many code points."""
    for line in re.finditer(rb"[^\n]{%d,}" % max(least, 1), text):
        key = line.group().strip(BLANK).lower()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            yield line.start(), line.end(), key


def bit_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each 64-bit hash among the bits, a power of two."""
    return np.concatenate([hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)])


def filter_size(lines: int, bits_a_line: int = BITS_A_LINE, max_bits: int = MAX_BITS) -> int:
    return max(SEGMENT_BITS, min(max_bits, 1 << max(lines * bits_a_line - 1, 1).bit_length()))


def twice_seen(docs: DataFrame, least: int, bits: int) -> Broadcast:
    """The filter of keys in two documents or more, as bytes of bits on every executor."""

    def handed_on(hashes: list[int]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
        once = np.unique(bit_positions(keys, bits)).astype(np.int64)
        twice = np.unique(bit_positions(keys[counts > 1], bits)).astype(np.int64)
        segment = np.arange(bits // SEGMENT_BITS + 1) * SEGMENT_BITS
        cuts = [np.searchsorted(found, segment) for found in (once, twice)]
        used = np.flatnonzero(np.diff(cuts[0]))
        parts = [[(found[c[s] : c[s + 1]] - s * SEGMENT_BITS).astype(np.uint32).tobytes() for s in used] for found, c in zip((once, twice), cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(p, pa.binary()) for p in parts)], ["segment", "once", "twice"])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        for batch in batches:
            for text in text_column(batch.column(0)):
                hashes.extend({xxhash.xxh3_64_intdigest(key) for _, _, key in line_keys(text, least)})
                if len(hashes) >= GATHERED:
                    yield from handed_on(hashes)
                    hashes = []
        if hashes:
            yield from handed_on(hashes)

    def counted(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        for batch in batches:
            for once, twice in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                at = np.frombuffer(once, np.uint32)
                second[at] |= first[at]
                first[at] = True
                second[np.frombuffer(twice, np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(second).tobytes()], pa.binary())], ["segment", "bits"])

    found = docs.select("text").mapInArrow(positions, "segment int, once binary, twice binary")
    parts = found.groupBy("segment").applyInArrow(counted, "segment int, bits binary").collect()
    whole = bytearray(bits // 8)
    for segment, data in parts:
        whole[segment * SEGMENT_BITS // 8 : (segment + 1) * SEGMENT_BITS // 8] = data
    return docs.sparkSession.sparkContext.broadcast(bytes(whole))


class Suspects:
    """Which lines of a text have keys that the second filter holds."""

    def __init__(self, filtered: bytes, least: int):
        self.filtered, self.mask, self.least = filtered, 8 * len(filtered) - 1, least

    def held(self, position: int) -> bool:
        return self.filtered[position >> 3] >> (7 - (position & 7)) & 1 == 1

    def of(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Start, end and key of each suspected line."""
        for start, end, key in line_keys(text, self.least):
            h = xxhash.xxh3_64_intdigest(key)
            if self.held(h & self.mask) and self.held(h >> 32 & self.mask):
                yield start, end, key


def suspected(docs: DataFrame, suspects: Broadcast, least: int) -> DataFrame:
    """doc_id, digest: the suspected keys of each document, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Suspects(suspects.value, least)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, digests = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch.column(1))):
                found = {hashlib.sha256(key).digest() for _, _, key in look.of(text)}
                ids += [doc_id] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(digests, pa.binary())], ["doc_id", "digest"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary")


def lost_keys(found: DataFrame, least_documents: int) -> DataFrame:
    """doc_id, lost: the digests of the keys that a document loses.

    The repeated keys are written, so that both sides of the join are plain shuffles, whose hot keys adaptive
    execution splits.
    """
    each = found.groupBy("digest", "doc_id").agg(F.lit(1).alias("one"))
    repeated = stored(each.groupBy("digest").agg(F.count("one").alias("documents"), F.max("doc_id").alias("keeper")).where(F.col("documents") >= least_documents).drop("documents"))
    lost = found.join(repeated, "digest").where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("lost"))


def without_repeats(docs: DataFrame, least_length: int = 20, least_documents: int = 3, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, with_text, kept: each text without its repeated lines.

    Keys of least_length code points in least_documents documents stay only in the document of the
    largest id.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    lines = base.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    suspects = twice_seen(base, least_length, filter_size(lines, max_bits=max_bits))
    lost = lost_keys(stored(suspected(base, suspects, least_length)), least_documents)
    kind = base.schema["doc_id"].dataType.simpleString()
    shape = "n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if with_text else "")
    names = ["doc_id", *(c.split()[0] for c in shape.split(", "))]

    def batch_of(ids: pa.Array, rows: list[tuple[int, int, bytes]], *more: pa.Array) -> pa.RecordBatch:
        columns = [ids, *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
        if with_text:
            columns.append(pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([*columns, *more], [*names, *["text"][: len(more)]])

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Suspects(suspects.value, least_length)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = text_column(batch.column(1))
            waits = [any(True for _ in look.of(t)) for t in texts]
            rows = [(t.count(b"\n") + 1, 0, b"" if w else t) for t, w in zip(texts, waits)]
            yield batch_of(batch.column(0), rows, pa.array([t if w else None for t, w in zip(texts, waits)], pa.binary()).cast(pa.string()))

    def second_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text, lost in zip(text_column(batch.column(1)), batch.column(2).to_pylist()):
                gone, kept, at, dropped = set(lost or ()), [], 0, 0
                if gone:
                    for start, end, key in line_keys(text, least_length):
                        if hashlib.sha256(key).digest() in gone:
                            kept.append(text[at:start])
                            at, dropped = end + 1, dropped + 1
                # what lies before a dropped line ends with \n, so only the last kept line may have one too many
                left = b"".join([*kept, text[at:]])
                if dropped and at > len(text) and left.endswith(b"\n"):
                    left = left[:-1]
                rows.append((text.count(b"\n") + 1, dropped, left))
            yield batch_of(batch.column(0), rows)

    looked = base.mapInArrow(first_look, f"doc_id {kind}, {shape}, text string")
    done = looked.where(F.col("text").isNull()).drop("text")
    waiting = looked.where(F.col("text").isNotNull()).select("doc_id", "text")
    met = waiting.join(lost, waiting.doc_id.eqNullSafe(lost.doc_id), "left").select(waiting.doc_id, "text", "lost")
    return done.unionByName(met.mapInArrow(second_look, f"doc_id {kind}, {shape}"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {
    "op11_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ),
        repeated AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < keeper) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
        FROM keyed LEFT JOIN repeated USING (key)
        GROUP BY doc_id
    """
}
