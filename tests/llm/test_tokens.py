"""Pieces against the sentencepiece library, packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, pieces
from tests.llm.edge import documents, rows

MODEL = public.path("piece_bpe_32k.model")
ALPHABET = " \t\n  ▁aébtheéñß漢字😀  \u200b<s>0'sx.-́\x00ﬁÅ"
ODD = ["", " ", "  ", "a ", " a", "▁", "a▁ b", "<s> </s> <unk> <0x0A>", "a<|endoftext|>b", "\r\n\x0b\x0c", "don't we'll"]


def texts():
    r = random.Random(3)
    return ODD + ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 60))) for _ in range(3000)]


@pytest.mark.parametrize("listed", [0, 50, 10**6])
def test_chunks_equal_the_library(listed):
    """With a table of no, some, or all chunks."""
    own = pieces.segmenter(MODEL)
    chunks = sorted({c for t in texts() for c in pieces.CHUNK.findall(" " + t.replace(pieces.MARK, " "))})
    table = own.segment(chunks[:listed])
    for text, got in zip(texts(), own.encode_all(texts(), table)):
        ids = own.library.encode(text)
        assert got == (",".join(map(str, ids)), own.library.decode(ids)), repr(text)


def test_distinct_chunks(spark):
    """Spark cuts texts as the segmenter does, and the table holds the commonest."""
    frame = spark.createDataFrame([(t,) for t in [*texts(), None, "the the the  the"]], "text string")
    want = {}
    for t in [*texts(), "the the the  the"]:
        for c in pieces.CHUNK.findall(" " + t.replace(pieces.MARK, " ")) if t else []:
            want[c] = want.get(c, 0) + 1
    counts = {r["chunk"]: r["n"] for r in pieces.chunk_counts(frame).collect()}
    assert counts == want
    table = pieces.chunk_table(frame, MODEL, 20).value
    assert 0 < len(table) <= 20 and min(want[c] for c in table) > max(n for c, n in want.items() if c not in table) / 2
    assert pieces.chunk_table(frame, MODEL).value.keys() == {c for c, n in want.items() if n > 1}


@pytest.mark.parametrize("max_entries", [0, 3, pieces.MAX_ENTRIES])
def test_piece_queries(spark, max_entries):
    docs = documents(spark)
    library = pieces.segmenter(MODEL).library
    full = pieces.piece_codec(docs, MODEL, max_entries).collect()
    short = pieces.piece_digests(docs, MODEL, max_entries).collect()
    assert len(full) == len(short) == len(rows())
    assert all(library.decode(f["ids"]) == f["decoded"] for f in full)
    by = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in short)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((r[0] or -1, len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for r in rows() for i in [library.encode(r[1] or "")])
    assert by == want
    assert pieces.piece_digests(documents(spark, []), MODEL).count() == 0


def test_ids_equal_the_tokenizers_library_on_every_code_point():
    own = packing.byte_tokenizer(public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN)
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(points[k : k + 997]) for k in range(0, len(points), 997)]  # neighbours side by side
    spaced = [f"a{x} {x}1{x}{x}\n{x}'s" for x in points[:0x3000]]  # every letter, mark and number of the common scripts in context
    long = ["x" * 5000, " " * 5000, "\n" * 3000, "ab" * 3000, "é" * 3000, "1" * 3000, "漢" * 2000]
    for part in (blocks, spaced, long):
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
            assert own.ids(text).tolist() == want.ids, repr(text[:40])


def test_ids_equal_the_tokenizers_library():
    own = packing.byte_tokenizer(public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN)
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for text in texts():
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_piece_lengths(n):
    lengths = packing.piece_lengths(n, 2048)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths) and lengths == sorted(lengths, reverse=True)
    assert len([x for x in lengths if x < 2048]) == len({x for x in lengths if x < 2048})


def test_packing_round_trip(spark):
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = documents(spark)
    out = packing.pack_documents(docs, with_ids=True).toPandas()
    assert sorted(out.sequence_id) == list(range(len(out))) and (out.offset == 0).all()
    assert out.sort_values("sequence_id").length.is_monotonic_decreasing
    for r in out.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    want = sorted((tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (1,) for r in rows()), key=len)
    assert sorted(out.length.tolist()) == sorted(x for ids in want for x in packing.piece_lengths(len(ids), 2048))
    one = out[out.doc_id == 6].sort_values("start")
    assert one.start.tolist() == [0, *one.length.cumsum()[:-1]]
    text = next(r[1] for r in rows() if r[0] == 6)
    assert [i for x in one.ids for i in x] == library.encode(text, add_special_tokens=False).ids + [1]
    assert packing.pack_documents(documents(spark, []), with_ids=False).count() == 0


@pytest.mark.parametrize("block", [1, 3, packing.BLOCK])
def test_sequence_ids_depend_on_rows_alone(spark, block):
    frame = spark.createDataFrame([(i, 0, 1 << (i % 4), i * 7, 9) for i in range(40)] + [(3, 0, 8, 21, 9), (None, 0, 8, 5, 9), (None, 4, 8, 5, 9)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    one = packing.bucketed(frame.repartition(1), block).toPandas()
    other = packing.bucketed(frame.orderBy("ids_crc32").repartition(5), block).toPandas()
    assert sorted(one.sequence_id) == list(range(43)) and one.sort_values("sequence_id").length.is_monotonic_decreasing
    key = ["sequence_id", "doc_id", "start", "length"]
    assert one[key].sort_values(key).fillna(-1).values.tolist() == other[key].sort_values(key).fillna(-1).values.tolist()
    assert packing.bucketed(frame.limit(0)).count() == 0


def test_length_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack_binary(documents(spark), "", "", "", max_length=1000)
