"""Token ids, shards and packing against the library and plain recomputation."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from navspark.llm import packing, sstable
from navspark.llm.common import new_path
from navspark.llm.tokens import WordEncoder, default_tokenizer


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(default_tokenizer())


def ids_of(encoder, text):
    return encoder.whole(text or "") + (1).to_bytes(4, "little")


def test_words_give_the_librarys_ids(encoder, monkeypatch):
    monkeypatch.setattr("navspark.llm.tokens.CACHED_WORDS", 50)
    rng = random.Random(3)
    letters = "aAbBzZ'sStT éÉ́ǅ ßẞİΣς.,!12 \x0b\x1c\x85 日本ñÑ<|startoftext|><|STARTOFTEXT|>\n\t’“½²ªµ×"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert encoder(text.encode()) == encoder.whole(text), ascii(text)


@pytest.mark.parametrize("shards", [1_000_000, 0])
def test_shards_round_trip(spark, make, corpus, encoder, monkeypatch, shards):
    """With the shards' list broadcast, and joined."""
    monkeypatch.setattr(sstable, "BROADCAST_SHARDS", shards)
    path = new_path(spark, "test-sst")
    sstable.write(make(corpus), path, shard_bytes=3000, block_bytes=600)
    got = sstable.read(spark, path).collect()
    assert len(got) == len(corpus) and sstable.files(spark, path).count() > 3
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("part", "seq").collect()
    assert sum(r.docs for r in manifest) == len(corpus) and all(a.last <= b.first for a, b in zip(manifest, manifest[1:]))
    expect = defaultdict(list)
    for i, t in corpus:
        raw = ids_of(encoder, t)
        expect[i].append((len(raw) // 4, zlib.crc32(raw)))
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and (r.n_tokens, r.ids_crc32) in expect[r.doc_id]
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    for by_place in (True, False):  # files opened by place, and whole
        if not by_place:
            monkeypatch.setattr(sstable, "ranged", lambda _: False)
            again = sstable.manifest_of(spark, path).orderBy("part", "seq").collect()
            assert again == manifest
        found = sstable.lookup(spark, path, [76, 0, None, 12345]).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == [(False, 0), (True, 0), (True, 0), (True, 76)]
        assert sstable.lookup(spark, path, [-5, 10**15]).count() == 0
        for r in found:
            raw = np.array(r.ids, "<u4").tobytes()
            assert (len(r.ids), zlib.crc32(raw)) in expect[r.doc_id]
        # a table of keys, repeated ones among them: every row once
        asked = make(corpus).unionByName(make(corpus))
        assert Counter(r.doc_id for r in sstable.lookup(spark, path, asked).collect()) == Counter(i for i, _ in corpus)
        assert sstable.lookup(spark, path, []).count() == 0


def test_keys_of_columns(spark):
    ids = [None, 0, 1, -1, 2**63 - 1, -(2**63), 255, -256]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", sstable.key_column(F.col("doc_id")).alias("key")).collect()
    assert {r.doc_id: bytes(r.key) for r in got} == {i: sstable.key_of(i) for i in ids}


def test_a_lookup_reads_the_footer_the_index_and_one_block():
    w, read = sstable.ShardWriter(0, 0, 2, block_bytes=4000), []
    rng = np.random.default_rng(1)
    for i in range(2000):
        w.add(sstable.key_of(i), rng.integers(0, 60000, 100))
    content = w.finish() + b"\n"
    shard = sstable.Shard(lambda at, n: read.append(n) or content[at : at + n], len(content))
    up_front = sum(read)
    assert len(read) == 2 and up_front == sstable.FOOTER_SIZE + len(shard.index) * sstable.INDEX_SIZE + len(shard.bloom)
    assert [k for k, _, _ in shard.find(sstable.key_of(1234))] == [sstable.key_of(1234)]
    assert len(read) - 2 <= 2 and sum(read) - up_front < 12000 < len(content) / 20


def test_a_shard_finds_keys_by_search():
    w = sstable.ShardWriter(0, 0, 2)
    for i in range(0, 4000, 2):
        w.add(sstable.key_of(i - 2000), np.arange(i % 50))
    shard = sstable.Shard.of(w.finish() + b"\n")
    assert len(shard.index) > 1 and shard.docs == 2000
    assert [len(ids) for _, _, ids in shard.find(sstable.key_of(-2000 + 34))] == [34]
    assert shard.find(sstable.key_of(-1999)) == [] and shard.find(sstable.key_of(9999)) == []
    assert sum(shard.may_hold(sstable.key_of(i)) for i in range(-1999, 1999, 2)) < 200


def test_empty_table(spark, make):
    path = new_path(spark, "test-sst")
    none = make([])
    sstable.write(none, path)
    assert sstable.read(spark, path).count() == 0
    assert packing.pack(none).count() == 0


def test_packing(make, corpus, encoder):
    length = 128
    got = packing.pack(make(corpus), length).toPandas()
    want = sorted(r for _, t in corpus for r in [ids_of(encoder, t)])
    assert sorted((bytes(x), n, d) for x, n, d in zip(got.ids, got.length, got.doc_tokens)) == sorted(
        (r[a : a + 4 * length], len(r[a : a + 4 * length]) // 4, len(r) // 4) for r in want for a in range(0, len(r), 4 * length)
    )
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= length
    assert got.length.sum() / (length * got.sequence_id.nunique()) > 0.9


def test_first_fit_decreasing_is_that():
    rng = random.Random(1)
    for _ in range(50):
        sizes = np.array([rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))])
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if b == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - free[b])
            free[b] -= sizes[i]


def test_groups_are_bounded(make, corpus, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 8)
    got = packing.pack(make(corpus), 512).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 512 and len(got) >= len(corpus)


@pytest.mark.parametrize("name", ["op2_sstable_ids", "op6_ffd_packing"])
def test_queries_give_the_librarys_ids(spark, corpus, encoder, tmp_path, name):
    from navspark.llm import queries

    rows = [(i, t) for i, t in dict(corpus).items() if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()[name](spark, str(tmp_path)).collect()
    want, start = {}, 0
    for i, t in sorted(rows):
        raw = ids_of(encoder, t)
        if name.startswith("op2"):
            want[i, start] = len(raw) // 4, zlib.crc32(raw)
            start += len(raw) // 4
        else:
            for a in range(0, len(raw), 4 * packing.LENGTH):
                part = raw[a : a + 4 * packing.LENGTH]
                want[i, a // 4] = len(part) // 4, zlib.crc32(part)
    assert len(got) == len(want)
    assert {(r.doc_id, r.start): (r.n_tokens if name.startswith("op2") else r.length, r.ids_crc32) for r in got} == want


def test_other_tokenizers_go_to_the_library_whole(encoder):
    from tokenizers import Tokenizer

    path = default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    other, library = WordEncoder(path), Tokenizer.from_file(path)
    text = "Two  words, and\nMORE"
    assert encoder.by_word and not other.by_word
    assert np.frombuffer(other(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
