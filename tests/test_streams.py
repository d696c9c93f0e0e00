"""Many block-sorted streams at once: the same bytes as one by one, in less time and memory."""

import random
import time
import tracemalloc

import duckdb
import pytest
from compare import differences

from foliant.functions import streams
from foliant.functions.coder import compress, decompress
from foliant.operators import tables
from foliant.plans.catalog import ORACLE_SQL, QUERIES


def texts(n: int, most: int = 900) -> list[bytes]:
    r = random.Random(7)
    words = [r.randbytes(r.randrange(1, 8)) if k % 9 == 0 else "".join(r.choices("etaoinshrdlu", k=r.randrange(1, 9))).encode() for k in range(200)]
    return [b" ".join(r.choices(words, k=most))[: r.randrange(most)] for _ in range(n)]


ODD = [b"", b"a", b"aa", b"\0", b"\0\0\xff", b"ab" * 300, bytes(range(256)) * 2]


@pytest.mark.parametrize("few", [1, 8, 1000])
@pytest.mark.parametrize("block", [1 << 16, 100])
def test_streams_are_the_same(monkeypatch, few, block):
    """However many of them end in plain Python, and in one block or several."""
    monkeypatch.setattr(streams, "FEW", few)
    data = ODD + texts(40)
    packed = streams.compress_all(data, block)
    assert packed == [compress(x, block) for x in data]
    assert streams.decompress_all([*packed, None]) == [*(x or None for x in data), None]


def test_broken_streams_have_the_same_result():
    r = random.Random(2)
    whole = streams.compress_all(texts(30))
    broken = [x[: len(x) // 2] for x in whole] + [x[:6] + r.randbytes(4) + x[10:] for x in whole] + [b"", b"\0\0\0", b"\xff" * 9]
    assert streams.decompress_all(broken + whole) == [decompress(x) for x in broken + whole]


def test_a_large_block_is_sorted_in_little_memory():
    """A list of all suffixes of 40,000 bytes would hold 800 MB."""
    data = random.Random(1).choices(b"abcdefgh ", k=40_000)
    tracemalloc.start()
    packed = streams.compress_all([bytes(data)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20 and decompress(packed[0]) == bytes(data)


def test_unpacking_many_streams_takes_less_than_one_by_one(spark, monkeypatch):
    """unpack_stream hands whole batches on."""
    packed = streams.compress_all(texts(2000, 600))
    began = time.process_time()
    expected = [decompress(x) for x in packed]
    plain, began = time.process_time() - began, time.process_time()
    assert streams.decompress_all(packed) == expected
    assert time.process_time() - began < 0.7 * plain
    frame = spark.createDataFrame(list(enumerate(map(bytearray, packed))), "i int, payload binary")
    assert [r.raw and bytes(r.raw) for r in tables.unpack_stream(frame).orderBy("i").collect()] == expected


def test_documents_without_text_or_id(spark, tmp_path):
    """The query text_streams against its SQL: empty texts come back empty, null as null, whatever lies between them."""
    rows = [(0, ""), (1, None), (2, "a"), (None, "no id"), (None, None), (3, "é\0 " * 50), (4, ""), (5, "x" * 70_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(spark, con, QUERIES["text_streams"], ORACLE_SQL["text_streams"], str(tmp_path)) is None


def test_empty_and_corrupt_streams_differ(spark):
    """Both are null by default; `empty` is for streams that end before a block."""
    packed = streams.compress_all([b"", b"text of some length" * 9])
    frame = spark.createDataFrame([(0, bytearray(packed[0])), (1, bytearray(packed[1])), (2, bytearray(packed[1][:9])), (3, bytearray(b"\0\0\0")), (4, bytearray()), (5, None)], "i int, payload binary")
    found = [r.raw if r.raw is None else bytes(r.raw) for r in tables.unpack_stream(frame, empty=b"").orderBy("i").collect()]
    assert found == [b"", b"text of some length" * 9, decompress(packed[1][:9]), decompress(b"\0\0\0"), None, None]
    assert [r.raw for r in tables.unpack_stream(frame.where("i = 0")).collect()] == [None]
