"""Token ids, packing and token files against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from docloom.llm import tokenize
from docloom.llm.packing import SumOfSquares, _Piece, pack
from docloom.llm.token_files import crc32_of_ids, read_tokens, write_tokens
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

BYTE, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
ODD = ["", " ", "a", " a ", "\n", "a\n", "\na", "x  y", "x  y", "x\n  y", "x\n\ny z", "it's  a\n b\r\nc", "  lead", "trail  ", "a　b c", "<|endoftext|> x", "1 2 3\n4", "İ Å b", "é\né", "a\n'll b", "..\n..", "a \x1cb\x1c c\n\x1dd", "~ a~b ~", "x ~ y", " ~", "\n \n ~", "Å K", "x\n  y", "\U0001f600 \U0001f600\n\U0001f600"]


def library(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def plain(path, texts, end):
    return [e.ids + [end] for e in library(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def fuzz(seed, n):
    draw = random.Random(seed)
    parts = ["a", "B", "word", " ", "  ", "\n", "\t", "é", " ", " ", "'s", "~", "1", ".", "́", "École", "\x85", "\x1f"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_ids_equal_the_library(path):
    texts = ODD + fuzz(1, 1500) + [None]
    got = []
    for _, ids, offsets in tokenize.encoded(pa.array(texts), path, 2):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == plain(path, texts, 2)


def test_table_fills_and_forgets(monkeypatch):
    monkeypatch.setattr(tokenize, "CACHE_PIECES", 50)
    encoder = tokenize.Encoder(BYTE, 2)
    texts = [" ".join(f"w{i * 31 % 997}" for i in range(k, k + 150)) for k in range(0, 900, 90)]
    from docloom.llm.textvec import slices

    got = []
    for piece in slices(pa.array(texts), 500):
        ids, offsets = encoder.encode(piece)
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == plain(BYTE, texts, 2)


def test_sum_of_squares_choice():
    draw = random.Random(5)
    packer = SumOfSquares(16)
    for k in range(300):
        before = packer.level.copy()
        size = draw.randrange(1, 16)
        list(packer.add(_Piece(k, 0, np.zeros(size, np.uint32), size)))

        def cost(h, before=before, size=size):
            after = before.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 16
            return (after[1:16] ** 2).sum()

        best = min(cost(h) for h in range(17 - size) if h == 0 or before[h] > 0)
        assert (packer.level[1:16] ** 2).sum() == best
        assert [len(x) for x in packer.open] == packer.level.tolist()


def test_pack(spark):
    texts = [*ODD, *fuzz(2, 60), "word " * 5000, None, "x" * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = pack(df, WORDS, 1, capacity=64, with_ids=True).collect()
    ids = dict(enumerate(plain(WORDS, texts, 1)))
    seen, windows = {i: 0 for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and [x & 0xFFFFFFFF for x in r.ids] == ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    short = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        short += at < 64
    assert short <= df.rdd.getNumPartitions()
    assert pack(df.where("false"), WORDS, 1).count() == 0
    one = spark.createDataFrame([(None, None, "s"), (3, "a", "t"), (3, "a", "t")], "doc_id long, text string, start string")
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pack(one, WORDS, 1).collect()) == [("3", 2), ("3", 2), ("None", 1)]


def test_token_files(spark, tmp_path):
    texts = [*ODD, *fuzz(4, 200), "word " * 3000, None]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(i * 3, texts[i]) for i in order], "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/t"
    write_tokens(df, path, BYTE, 2, parts=5)
    ids = plain(BYTE, texts, 2)
    at, expected = 0, {}
    for i, x in enumerate(ids):
        expected[i * 3] = (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in crc32_of_ids(read_tokens(spark, path)).collect()} == expected
    some = read_tokens(spark, path, F.col("doc_id").between(30, 60), ids=False)
    assert {r.doc_id: (r.start, r.n_tokens) for r in some.collect()} == {k: v[:2] for k, v in expected.items() if 30 <= k <= 60}
    assert "ids" not in some.columns and "GreaterThanOrEqual(doc_id,30)" in some._jdf.queryExecution().executedPlan().toString()
    write_tokens(df.where("false"), f"{path}2", BYTE, 2)
    assert read_tokens(spark, f"{path}2").count() == 0
    write_tokens(spark.createDataFrame([(None, None), (1, "a"), (1, "b")], "doc_id long, text string"), f"{path}3", BYTE, 2)
    assert [(r.doc_id, r.start, r.n_tokens) for r in read_tokens(spark, f"{path}3").orderBy("start").collect()] == [(None, 0, 1), (1, 1, 2), (1, 3, 2)]


def test_layout(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(3000).selectExpr("id as doc_id", "repeat(concat('word ', id % 7, ' '), 30) as text")
    write_tokens(rows, f"file://{tmp_path}/t", BYTE, 2, parts=2, page_rows=500)
    meta = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/t/*.parquet"))[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
