import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import read
from tokenizers import Tokenizer

from cohortwarn.llm import records
from cohortwarn.llm.queries import QUERIES
from cohortwarn.session import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def test_checksums():
    crc = records.crc32c()
    # Known values of CRC-32C.
    assert crc.of(b"123456789") == 0xE3069283
    assert crc.many([b"", b"\0" * 32, b"\xff" * 32]) == [0, 0x8A9136AA, 0x62A8AB43]
    for n in (1, 3, 4, 5, 1023, 1024, 1025, 5000):
        data = bytes(i * 7 % 256 for i in range(n))
        assert crc.of(data) == crc._short(data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=50), max_size=4))
def test_any_text_as_the_library(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in records.encoder(PATH).encode_all(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_pieces_are_not_looked_up_one_by_one():
    texts = ["Some words, and more words.", "a b  c\n", "more Some é"]
    mine = records.PieceEncoder(PATH)
    found, looked = mine.encode_all(texts), []
    mine._look = lambda pieces: looked.extend(pieces) or []
    assert mine.encode_all(texts) == found and looked == []


def test_few_kept_pieces_as_the_library():
    """Tables of few places: pieces that want the same one, more pieces than are kept, and pieces that were forgotten."""
    rng = np.random.default_rng(3)
    letters = list("ab\0é .,\n0")
    for kept in (1, 8, 40):
        mine = records.PieceEncoder(PATH)
        mine.short = records.ShortPieces(kept)
        for _ in range(30):
            texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(5)] + ["long" * 5 + " longer" * 2]
            got = [np.frombuffer(x, "<u4").tolist() for x in mine.encode_all(texts)]
            assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
            assert mine.short.count <= kept


def test_frames_and_damage():
    payloads = [records.payload(i or None, np.arange(n, dtype="<u4") * 3) for i, n in enumerate((0, 1, 5, 30_000))]
    framed = records.frame(payloads)
    data, offsets = b"".join(framed), np.cumsum([0, *map(len, framed)]).tolist()
    assert records.unframe(data, offsets, "here") == payloads
    assert [records.parse(p)[0] for p in payloads] == [None, 1, 2, 3]
    assert records.parse(payloads[3])[1].tolist() == [3 * i for i in range(30_000)]
    for at in (0, 9, offsets[2] + 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken), offsets, "here")


def expected(rows):
    out, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_odd_rows(spark, odd, clashing, empty, odd_rows):
    named = [r for r in odd_rows if r[0] is not None]
    for docs in (odd, clashing):
        folder = new_folder(spark, "test-records")
        records.write_records(docs.filter("doc_id is not null"), folder, PATH)
        found = records.read_records(spark, folder).orderBy("start").collect()
        assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == expected(named)
    folder = new_folder(spark, "test-records")
    records.write_records(odd, folder, PATH)
    found = records.read_records(spark, folder, ids=False).orderBy("start").collect()
    assert len(found) == len(odd_rows) and [r.doc_id for r in found[:2]] == [None, None]
    folder = new_folder(spark, "test-records")
    assert records.write_records(empty, folder, PATH).count() == 0
    assert records.read_records(spark, folder).count() == 0


def test_any_record_alone_through_the_index(spark, odd):
    folder = new_folder(spark, "test-records")
    manifest = records.write_records(odd.filter("doc_id > 4"), folder, PATH).collect()
    whole = {r.doc_id: r.token_ids for r in records.read_records(spark, folder).collect()}
    for shard in manifest:
        for doc_id, ids in records.read_at(shard.path, list(range(shard.records))[::-1]):
            assert whole[doc_id] == ids.tolist()


def test_query_over_many_shards(spark, small):
    rows = read(spark, small).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = QUERIES["op4_token_records"](spark, small).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == expected([(r.doc_id, r.text) for r in rows])


def test_one_doc_id_throughout_makes_several_shards(spark, tmp_path):
    rows = [(5, f"text number {i}") for i in range(400)] + [(None, "no id"), (9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = records.write_records(df, str(tmp_path / "r"), PATH, shards=8).collect()
    assert len(manifest) >= 6 and sum(m.records for m in manifest) == len(rows)
    found = sorted(records.read_records(spark, str(tmp_path / "r")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] + [5] * 400 + [9]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(found, found[1:], strict=False))
