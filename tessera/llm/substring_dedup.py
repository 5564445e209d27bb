"""Substring dedup by suffix automata: words of passages that occur before are removed.

A suffix automaton over words gives, at each word of a document, the matching statistic: the length
of the longest passage that ends there and occurs in the reference. Two kinds of reference:

remove_reference_spans: a table of its own, of bounded size (held-out passages, a licence text, a
list of boilerplate). Its texts are dealt into shards, each shard becomes a suffix automaton, which
is broadcast (refused beyond max_bytes), and every document is streamed through all of them. Maximal
spans of at least min_words are removed.

remove_repeated_windows: the corpus itself: a window of min_words words goes if the same words also
start in a document of smaller id. This reference has no size bound that a broadcast could rely on,
so its shards are dealt to the tasks, each together with the passages that can meet it:
  1. documents with the same words are folded; all but the least id go as a whole;
  2. each window has a fingerprint, the least hash of the n-grams of half its length in it, so
     equal windows have equal fingerprints; only fingerprints of two or more documents go on;
  3. neighbouring windows of one fingerprint form chunks. Chunks of equal words are folded: one
     that occurs in a smaller document is removed as a whole;
  4. the distinct chunks of a fingerprint are a reference shard. A task streams them in the order
     of their ids through the automaton of those before, and adds them to it. Each state knows the
     least id whose words reach it, so a match of min_words tells whether a smaller document holds
     it. Shards are of bounded size: a fingerprint of more than max_chunks distinct chunks (the
     edge of a passage that very many documents share) would grow with the corpus, and the windows
     of its chunks are matched one by one by an aggregation over their 122-bit hashes instead.
Every other step is a join or an aggregation whose partial sums fold hot keys before the shuffle.

Chunks, windows and documents count as equal when two independent hashes of 61 bits agree (unlike
ones do with probability 2**-122 a pair); inside an automaton the words themselves are compared.

Defined results: null and empty texts have no words; texts shorter than a window lose none; null
ids (and the id 2**63 - 1, which stands for null) sort after all others; rows with the same id never
remove each other's words; empty tables give empty results; columns other than id and text pass
unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, fresh, stored, table
from tessera.llm.words import Words, range_hashes, slices

MIN_WORDS = 50
#: Distinct chunks of one fingerprint that an automaton takes, and words of the fingerprints dealt to one automaton.
MAX_CHUNKS, SHARD_WORDS = 256, 20_000
NO_ID = (1 << 63) - 1


class SuffixAutomaton:
    """Of word sequences, added one by one; words are any hashable values.

    holder[state] is the holder of the first sequence added that reaches the state.
    """

    def __init__(self, sequences: list[list] = ()):
        self.next: list[dict] = [{}]
        self.link, self.length, self.holder = [-1], [0], [None]
        for words in sequences:
            self.add(words)

    def add(self, words: list, holder=None) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word, holder)

    def _extend(self, last: int, word, holder) -> int:
        step, link, length = self.next, self.link, self.length
        known = step[last].get(word)
        if known is not None:  # an earlier sequence brought this word here
            return known if length[known] == length[last] + 1 else self._split(last, known, word)
        state = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.holder.append(holder)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = state
            p = link[p]
        if p >= 0:
            known = step[p][word]
            link[state] = known if length[known] == length[p] + 1 else self._split(p, known, word)
        return state

    def _split(self, p: int, old: int, word) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[old]))
        self.link.append(self.link[old])
        self.length.append(self.length[p] + 1)
        self.holder.append(self.holder[old])
        self.link[old] = clone
        while p >= 0 and self.next[p].get(word) == old:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def matches(self, words: list) -> Iterator[tuple[int, int]]:
        """At each word the longest match that ends there: its state and length."""
        step, link, length = self.next, self.link, self.length
        state = n = 0
        for word in words:
            following = step[state].get(word)
            while following is None and state:
                state = link[state]
                n = length[state]
                following = step[state].get(word)
            if following is not None:
                state, n = following, n + 1
            yield state, n

    def statistics(self, words: list) -> list[int]:
        """At each word the length of the longest match that ends there."""
        return [n for _, n in self.matches(words)]

    def holders(self, words: list, size: int) -> list:
        """For each window of `size` words its first holder, None where no sequence has it."""
        link, length, out = self.link, self.length, []
        for state, n in self.matches(words):
            if n < size:
                out.append(None)
                continue
            while length[link[state]] >= size:
                state = link[state]
            out.append(self.holder[state])
        return out[size - 1 :]


def covered(statistics: list[int], min_words: int) -> np.ndarray:
    """Which words lie in a match of at least min_words."""
    change = np.zeros(len(statistics) + 1, int)
    for end, n in enumerate(statistics):
        if n >= min_words:
            change[end - n + 1] += 1
            change[end + 1] -= 1
    return np.cumsum(change)[:-1] > 0


def kept_text(words: Words, row: int, gone: np.ndarray) -> bytes:
    """The words of a row that stay, joined by one space. gone: over the row's words."""
    first, after = words.first[row], words.first[row + 1]
    base = words.offsets[row]
    raw = words.raw[base : words.offsets[row + 1]].tobytes()
    starts, ends = (x[first:after][~gone] - base for x in (words.start, words.end))
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


def remove_reference_spans(docs: DataFrame, reference: DataFrame, min_words: int = MIN_WORDS, shards: int = 8, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: docs without the spans of the texts of `reference`.

    reference has a column text. It is broadcast, so it may hold max_bytes at most.
    """
    size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the reference has {size} bytes, more than {max_bytes}; use remove_repeated_windows")
    texts = [r["text"] for r in reference.select("text").where("text IS NOT NULL").collect()]
    held = docs.sparkSession.sparkContext.broadcast([SuffixAutomaton([t.encode().split() for t in texts[k::shards]]) for k in range(shards)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = held.value
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            words = Words(batch.column(1))
            n, removed, kept = [], [], []
            for r in range(words.rows):
                own = words.raw[words.offsets[r] : words.offsets[r + 1]].tobytes().split()
                gone = np.zeros(len(own), bool)
                for automaton in built:
                    gone |= covered(automaton.statistics(own), min_words)
                n.append(len(own))
                removed.append(int(gone.sum()))
                kept.append(kept_text(words, r, gone).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of span values, by doubling."""
    out, n = values, 1
    while 2 * n <= span:
        out, n = np.minimum(out[: len(out) - n], out[n:]), 2 * n
    if n < span:
        out = np.minimum(out[: len(out) - (span - n)], out[span - n :])
    return out


class Windows:
    """All windows of min_words words of a text array: row, first word, and fingerprint."""

    def __init__(self, words: Words, min_words: int):
        self.words, self.size = words, min_words
        self.hashes = words.hashes(0), words.hashes(1)
        half = max(1, min_words // 2)
        self.at, grams = words.grams(half, self.hashes[0])
        span = min_words - half + 1
        if len(grams) < span:
            self.at, self.print, self.row = self.at[:0], grams[:0], self.at[:0]
            return
        prints = least_of(grams, span)
        at = self.at[: len(prints)]
        row = words.row[at]
        whole = at + min_words <= words.first[row + 1]
        self.at, self.print, self.row = at[whole], prints[whole], row[whole]

    def chunks(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run of chosen, neighbouring windows of one
        row with one fingerprint."""
        index = np.flatnonzero(chosen)
        if not len(index):
            return index, index
        new = np.ones(len(index), bool)
        new[1:] = (np.diff(index) != 1) | (self.row[index[1:]] != self.row[index[:-1]]) | (self.print[index[1:]] != self.print[index[:-1]])
        starts = np.flatnonzero(new)
        return index[starts], np.diff(np.append(starts, len(index)))

    def hash_of(self, window: np.ndarray, count: np.ndarray | int = 1) -> list[np.ndarray]:
        """122 bits of the words that `count` windows from `window` on cover."""
        start = self.at[window]
        return self.hash_words(start, start + self.size - 1 + count)

    def hash_words(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [range_hashes(h, start, end, key).view(np.int64) for key, h in enumerate(self.hashes)]

    def bytes_of(self, window: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The text that `count` windows from `window` on cover."""
        start = self.at[window]
        raw = memoryview(self.words.raw)
        return [raw[a:b].tobytes() for a, b in zip(self.words.start[start].tolist(), self.words.end[start + self.size - 2 + count].tolist())]


def _version(text_col: str) -> Column:
    """A hash of the words: texts of one id that differ in whitespace only are one version, and all lose the same words."""
    return F.xxhash64(F.trim(F.regexp_replace(f"`{text_col}`", r"[\t-\r][\t-\r ]*| [\t-\r ]+", " ")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id without nulls, the version (an id may stand for several texts), and the text."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), _version(text_col).alias("version"), F.col(f"`{text_col}`").alias("text"))


def _fingerprints(keyed: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version, same1, same2 (122 bits of the words), n_words, prints (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words = Words(batch.column(2))
            windows = Windows(words, min_words)
            starts, _ = windows.chunks(np.ones(len(windows.at), bool))
            row, prints = windows.row[starts], windows.print[starts]
            order = np.lexsort((prints, row))
            row, prints = row[order], prints[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])
            row, prints = row[new], prints[new]
            offsets = np.searchsorted(row, np.arange(words.rows + 1)).astype(np.int32)
            same = windows.hash_words(words.first[:-1], words.first[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, same), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(prints.view(np.int64)))],
                ["doc_id", "version", "same1", "same2", "n_words", "prints"],
            )

    return keyed.mapInArrow(run, "doc_id long, version long, same1 long, same2 long, n_words long, prints array<long>")


def _chunks(keyed: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version, print, c1, c2 (the chunk's words), window (its first), count, and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            windows = Windows(Words(batch.column(2)), min_words)
            shared = batch.column(3)
            chosen = np.zeros(len(windows.at), bool)
            first = np.searchsorted(windows.row, np.arange(batch.num_rows + 1))
            values, offsets = np.asarray(shared.flatten()).view(np.uint64), np.asarray(shared.offsets) - shared.offsets[0].as_py()
            for r in range(batch.num_rows):
                chosen[first[r] : first[r + 1]] = np.isin(windows.print[first[r] : first[r + 1]], values[offsets[r] : offsets[r + 1]])
            start, count = windows.chunks(chosen)
            c1, c2 = windows.hash_of(start, count)
            row = pa.array(windows.row[start])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(row) for k in (0, 1)),
                    *map(pa.array, (windows.print[start].view(np.int64), c1, c2, start - first[windows.row[start]], count.astype(np.int64))),
                    pa.array(windows.bytes_of(start, count), pa.binary()),
                ],
                ["doc_id", "version", "print", "c1", "c2", "window", "count", "words"],
            )

    rows = keyed.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "prints")
    return rows.mapInArrow(run, "doc_id long, version long, print long, c1 long, c2 long, window long, count long, words binary")


def seen_before(chunks: list[bytes], lows: list[int], min_words: int) -> list[list[int]]:
    """For each chunk, in the order of lows, its windows that a chunk of smaller low holds."""
    automaton, out = SuffixAutomaton(), []
    for chunk, low in zip(chunks, lows):
        words = chunk.split()
        holders = automaton.holders(words, min_words)
        out.append([k for k, holder in enumerate(holders) if holder is not None and holder < low])
        if None in holders:  # else all its windows are there
            automaton.add(words, low)
    return out


def _by_automata(chunks: DataFrame, min_words: int, shard_words: int) -> DataFrame:
    """c1, c2 and turns (the windows that a smaller document holds) of distinct chunks (print, c1,
    c2, low, words). Whole fingerprints make a shard, of about shard_words words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("turns", pa.list_(pa.int32()))])
        held, size = [], 0

        def answer() -> pa.RecordBatch:
            shard = sorted(held, key=lambda r: r[1])
            turns = seen_before([r[2] for r in shard], [r[1] for r in shard], min_words)
            found = [(r[3], r[4], t) for r, t in zip(shard, turns) if t]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found) if found else [()] * 3, schema)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("print", "low", "words", "c1", "c2"))):
                if size > shard_words and row[0] != held[-1][0]:
                    yield answer()
                    held, size = [], 0
                held.append(row)
                size += row[2].count(b" ") + 1
        if held:
            yield answer()

    sorted_rows = chunks.select("print", "low", "words", "c1", "c2").repartition("print").sortWithinPartitions("print")
    return sorted_rows.mapInArrow(run, "c1 long, c2 long, turns array<int>")


def _by_windows(chunks: DataFrame, min_words: int) -> DataFrame:
    """What _by_automata gives, by an aggregation over the hashes of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = Windows(Words(batch.column(3)), min_words)
            row = pa.array(windows.row)
            first = np.searchsorted(windows.row, np.arange(batch.num_rows + 1))
            turn = np.arange(len(windows.at)) - first[windows.row]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(3)), pa.array(turn.astype(np.int32)), *map(pa.array, windows.hash_of(np.arange(len(windows.at))))], ["c1", "c2", "low", "turn", "w1", "w2"])

    windows = chunks.select("c1", "c2", "low", "words").mapInArrow(run, "c1 long, c2 long, low long, turn int, w1 long, w2 long")
    earliest = windows.groupBy("w1", "w2").agg(F.min("low").alias("earliest"), F.max("low").alias("latest")).where("earliest < latest").select("w1", "w2", "earliest")
    return windows.join(earliest, ["w1", "w2"]).where("earliest < low").groupBy("c1", "c2").agg(F.collect_list("turn").alias("turns"))


def removals(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", max_chunks: int = MAX_CHUNKS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, version, whole (all words go) and windows (those to remove), for documents that lose words."""
    keyed = _keyed(docs, id_col, text_col)
    prints = checkpointed(_fingerprints(keyed, min_words).where(F.col("n_words") >= min_words))
    same = prints.groupBy("same1", "same2").agg(F.min(F.struct("doc_id", "version", "prints")).alias("first"))
    least = checkpointed(same.select("same1", "same2", "first.*"))
    copies = prints.select("doc_id", "version", "same1", "same2").join(least.select("same1", "same2", F.col("doc_id").alias("least")), ["same1", "same2"])
    whole = copies.where("doc_id > least").select("doc_id", "version").distinct()
    each = least.select("doc_id", "version", F.explode("prints").alias("print"))
    shared = each.groupBy("print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("print")
    wanted = each.join(shared, "print").groupBy("doc_id", "version").agg(F.collect_list("print").alias("prints"))
    chunks = stored(_chunks(keyed, wanted, min_words))
    distinct = checkpointed(chunks.groupBy("c1", "c2").agg(F.min("doc_id").alias("low"), F.first("print").alias("print")))
    # equal windows have one fingerprint: where all its chunks are equal, no window is left to match
    contested = distinct.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    contested = distinct.join(contested, "print").select("c1", "c2", "low", "n")
    # one copy of each contested chunk, that of its least document, brings its words
    firsts = chunks.select("doc_id", "print", "c1", "c2", "words").join(contested, ["c1", "c2"]).where("doc_id = low").dropDuplicates(["c1", "c2"])
    firsts = stored(firsts.select("print", "c1", "c2", "low", "n", "words"))
    again = _by_automata(firsts.where(F.col("n") <= max_chunks), min_words, shard_words).unionByName(_by_windows(firsts.where(F.col("n") > max_chunks), min_words))
    placed = chunks.select("doc_id", "version", "c1", "c2", "window", "count").join(distinct.select("c1", "c2", "low"), ["c1", "c2"])
    found = placed.join(again, ["c1", "c2"], "left")
    turns = F.when(F.col("low") < F.col("doc_id"), F.sequence(F.lit(0), F.col("count").cast("int") - 1)).otherwise(F.col("turns"))
    found = found.withColumn("turns", turns).where("turns IS NOT NULL")
    starts = F.transform("turns", lambda t: t + F.col("window"))
    # rows of one id and words bring the same chunks
    by_document = found.groupBy("doc_id", "version").agg(F.flatten(F.collect_set(starts)).alias("windows"))
    whole = whole.select("doc_id", "version", F.lit(True).alias("whole"), F.array().cast("array<long>").alias("windows"))
    return whole.unionByName(by_document.select("doc_id", "version", F.lit(False).alias("whole"), "windows"))


def _gone(words: Words, row: int, whole: bool, starts: np.ndarray, min_words: int) -> np.ndarray:
    n = words.first[row + 1] - words.first[row]
    if whole:
        return np.ones(n, bool)
    change = np.zeros(n + 1, int)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + min_words, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and
    with_text kept (those words) and spans (pairs of first and last removed word)."""
    gone = removals(docs, min_words, id_col, text_col, max_chunks)
    rows = _keyed(docs, id_col, text_col).join(gone, ["doc_id", "version"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("windows", F.array().cast("array<long>")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for every in batches for part in slices(every)):
            words = Words(batch.column(1))
            out = []
            for r in range(words.rows):
                missing = _gone(words, r, batch.column(2)[r].as_py(), np.asarray(batch.column(3)[r].values), min_words)
                kept = kept_text(words, r, missing)
                edges = np.flatnonzero(np.diff(missing.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                texts = (kept.decode(), [[int(a), int(b) - 1] for a, b in edges]) if with_text else ()
                out.append((len(missing), int(missing.sum()), hashlib.sha256(kept).hexdigest(), *texts))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())))
            names = ["n_words", "n_removed", "kept_sha256", "kept", "spans"][: 5 if with_text else 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", *names])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<array<long>>" * with_text
    return rows.mapInArrow(run, schema).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def strip_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns: texts that lose words become the kept words joined by one space,
    others stay as they are; rows that lose all their words go."""
    key, of_version, is_whole, starts = (fresh(docs, n) for n in ("gone_id", "gone_version", "gone_whole", "gone_windows"))
    gone = removals(docs, min_words, id_col, text_col).toDF(key, of_version, is_whole, starts)
    same = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)) == F.col(key)) & (_version(text_col) == F.col(of_version))
    rows = docs.join(gone, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], is_whole, starts)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for every in batches for part in slices(every, f"c{at}")):
            words, texts, stay = Words(batch.column(at)), batch.column(at).to_pylist(), []
            whole, windows = batch.column(len(names)), batch.column(len(names) + 1)
            for r in range(words.rows):
                if not whole[r].is_valid:
                    stay.append(True)
                    continue
                missing = _gone(words, r, whole[r].as_py(), np.asarray(windows[r].values), min_words)
                texts[r] = kept_text(words, r, missing).decode()
                stay.append(not missing.all())
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, plain).filter(pa.array(stay, pa.bool_()))

    plain = [f"c{k}" for k in range(len(names))]  # no name that needs quotes reaches the workers
    made = rows.toDF(*plain, "whole", "windows").mapInArrow(run, docs.toDF(*plain).schema)
    return made.toDF(*names)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {
    "op2_substring_dedup": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        windows AS MATERIALIZED (
            SELECT doc_id, k, md5(array_to_string(words[k : k + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS k FROM d)
        ),
        earliest AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
        again AS (SELECT DISTINCT doc_id, k FROM windows JOIN earliest USING (h) WHERE low < doc_id),
        each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
        flagged AS (
            SELECT doc_id, each.k, word, max(CASE WHEN again.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY each.k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
            FROM each LEFT JOIN again USING (doc_id, k)
        ),
        kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM flagged GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """
}
