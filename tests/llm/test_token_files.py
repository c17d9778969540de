"""Token id files: exact round trips, and the library's own ids."""

import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from carbonhaul.llm import token_files
from carbonhaul.llm.common import scratch_path, text_session, tokenizer_file

from .cases import DOCUMENTS, documents


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    for case in range(400):
        ids = rng.integers(0, 2 ** int(rng.integers(1, 33)), int(rng.integers(0, 300)), dtype="u8").astype("u4")
        if case % 3 == 0:
            ids = np.repeat(ids, rng.integers(0, 200, len(ids)))
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 4), len(ids))) if len(ids) else np.array([0])
        words, offsets = token_files.packed(ids, ends)
        assert (token_files.unpacked(words) == ids).all()
        starts, stops = np.append(0, ends[:-1]), np.append(offsets[1:], len(words))
        for a, b, first, last in zip(offsets, stops, starts, ends):
            assert (token_files.unpacked(words[a:b]) == ids[first:last]).all()


def test_words_hold_as_many_as_fit():
    assert len(token_files.packed(np.arange(2, dtype="u4") % 2, [2])[0]) == 1
    assert len(token_files.packed(np.arange(60) % 2, [60])[0]) == 1
    assert len(token_files.packed(np.full(50_000, 7), [50_000])[0]) == 1
    assert len(token_files.packed(np.full(50_000, 7), [25_000, 50_000])[0]) == 2
    assert len(token_files.packed(np.array([2**32 - 1, 2**31]), [2])[0]) == 2


def test_segments_and_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 100)
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 50_000, n, dtype="u4") for n in (1, 100, 101, 7, 950)]
    data = b"".join(
        token_files.segment(ids, [p.tobytes() for p in parts]) + token_files.TRAILER
        for ids in ([1, 2, 3, 4, None], [5] * 5)
    )
    first, second = token_files.segments(data)
    assert first.missing.tolist() == [0, 0, 0, 0, 1] and second.doc_ids.tolist() == [5] * 5
    assert first.block_sizes.tolist() == [1, 100, 100, 1, 7, *[100] * 9, 50]
    assert (first.block(14) == parts[4][900:]).all() and (second.block(2) == parts[2][:100]).all()
    with pytest.raises(ValueError):
        token_files.Segment(data, 8)


def test_files_of_documents(spark):
    df = documents(text_session(spark)).withColumn("row", token_files.F.lit("clash"))
    df = df.unionByName(df.limit(1).withColumn("text", token_files.F.lit("<|endoftext|> special")))
    path = scratch_path(spark, "test-token-files")
    token_files.write_files(df, path, file_segments=1)
    got = token_files.read_files(spark, path, with_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = sorted(
        ((d, array("I", [*library.encode(t or "", add_special_tokens=False).ids, 2]).tobytes())
         for d, t, *_ in df.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0),
    )
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted(
        (d is not None, d or 0, ids) for d, ids in want
    )
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    files = token_files.index(spark, path).orderBy("start").collect()
    assert sum(f.ids for f in files) == at and len(files) > 0


def test_empty_table(spark):
    path = scratch_path(spark, "test-token-files")
    token_files.write_files(spark.createDataFrame([], DOCUMENTS), path)
    assert token_files.read_files(spark, path).count() == 0
