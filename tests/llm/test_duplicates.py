"""Repeated strings, near duplicates, components, chat formatting and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from navspark.llm import chat, neardup, repeats
from navspark.llm.common import WORD_BYTES, flat, sliced
from navspark.llm.components import components
from navspark.llm.dart import signatures
from navspark.llm.tokens import WordEncoder, default_tokenizer


def brute_repeats(texts, size=200):
    seen = Counter()
    for b in texts:
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    for b in texts:
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                hit[i] += 1
                hit[i + size] -= 1
        yield np.cumsum(hit)[:-1] > 0


def periodic_corpus():
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = say(3000)
    rows = [(100 + i, say(500)) for i in range(5)]
    rows += [(110 + i, say(150) + base[a : a + n] + say(150)) for i, (a, n) in enumerate([(0, 400), (100, 250), (300, 199), (300, 200), (250, 201), (350, 600), (349, 330), (1000, 230), (1013, 230), (1026, 230)])]
    rows += [(130, "ab" * 300), (131, say(90) + "ab" * 101 + say(90)), (132, "z" * 199), (133, "z" * 200), (134, "z" * 201), (135, base), (136, base[:1500] + "!" + base[1501:])]
    return rows


@pytest.mark.parametrize("which", ["corpus", "periodic"])
def test_repeats_match_brute_force(make, corpus, which):
    rows = corpus if which == "corpus" else periodic_corpus()
    texts = [(t or "").encode() for _, t in rows]
    got = Counter()
    for r in repeats.with_spans(make(rows)).collect():
        hit = np.zeros(len(r.text), bool)
        for a, b in repeats.merged([s.asDict() for s in r.spans or []]):
            hit[a:b] = True
        got[(r.row.doc_id, bytes(r.text), hit.tobytes())] += 1
    want = Counter((i, b, h.tobytes()) for (i, _), b, h in zip(rows, texts, brute_repeats(texts)))
    assert got == want
    assert any(np.frombuffer(k[2], bool).any() for k in want)


def test_anchors_of_a_slice_take_little_memory():
    rng = np.random.default_rng(3)
    text = pa.array([rng.integers(97, 123, 4000, np.uint8).tobytes() for _ in range(500)], pa.binary())
    repeats.powers(repeats._BASE, 2), repeats.powers(repeats._INVERSE, 2)
    tracemalloc.start()
    for part in sliced(pa.RecordBatch.from_arrays([text], ["text"]), "text", repeats.SLICE):
        repeats.anchors(*flat(part.column("text")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6


def test_broadcasts_go_when_their_rows_are_stored(spark, make, corpus, monkeypatch):
    made, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: made.append(real(x)) or made[-1])
    docs = make(corpus)
    repeats.spans(docs)
    neardup.shingle_sets(docs, spark.createDataFrame([(neardup.key_of(corpus[0][1].encode())[0],)], "key binary")).collect()
    assert len(made) == 3 and not any(os.path.exists(b._path) for b in made)


def test_removal_keeps_characters_whole(make):
    rows = [(1, "é" * 300), (2, "x" + "é" * 300), (3, None), (4, "short")]
    out = repeats.remove(make(rows))
    assert out.columns == make(rows).columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "" and got[2] == "x" and got[3] is None and got[4] == "short"
    assert repeats.remove(make([])).count() == 0


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(WORD_BYTES).split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both, n = sum((sets[a] & sets[b]).values()), sets[a].total() + sets[b].total()
                if both >= 0.8 * (n - both):
                    up[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        groups[root(i)].append(i)
    return groups, sets


@pytest.mark.parametrize("hot", [4096, 6, 1])
def test_near_duplicates(make, corpus, monkeypatch, hot):
    """With all keys and classes broadcast, with some, and with none."""
    monkeypatch.setattr(neardup, "HOT", hot)
    groups, sets = brute_classes(corpus)
    want = Counter()
    for members in groups.values():
        ids = [corpus[i][0] for i in members]
        known = [x for x in ids if x is not None]
        for x in ids:
            want[(x, min(known) if known else None, len(ids))] += 1
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(make(corpus)).collect())
    assert got == want and max(k[2] for k in want) > 5
    kept = Counter(r.doc_id for r in neardup.deduplicate(make(corpus)).collect())
    heads = Counter(min((corpus[i][0] for i in m if corpus[i][0] is not None), default=None) for m in groups.values())
    assert kept == heads
    assert neardup.deduplicate(make(corpus)).columns == make(corpus).columns
    assert neardup.near_duplicates(make([])).count() == 0 and neardup.deduplicate(make([])).count() == 0


def test_the_kept_row_of_equal_words_is_defined(make):
    words = "one two three four five six seven eight nine ten"
    rows = [(1, words + "!"), (1, words), (1, words.upper()), (2, words), (None, words), (None, "ten nine"), (None, "Ten, nine")]
    for order in (rows, rows[::-1]):
        assert sorted((r.doc_id is None, r.text) for r in neardup.deduplicate(make(order)).collect()) == [(False, words.upper()), (True, "Ten, nine")]


def test_recall_of_planted_near_copies(make):
    """Every pair whose exact similarity is 0.8 or more is linked; by share of edited words, how many are that similar."""
    rng = random.Random(21)
    rows, share = [], {}
    for k, edits in enumerate([0, 1, 2, 4, 8, 12] * 12):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), edits):
            other[at] = f"edit{rng.randrange(3000)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        share[k] = edits
    groups, _ = brute_classes(rows)
    alike = {i for m in groups.values() if len(m) > 1 for i in m}
    found = {r.doc_id for r in neardup.near_duplicates(make(rows)).where("class_size > 1").collect()}
    assert found == alike
    caught = {e: sum(2 * k in found for k in share if share[k] == e) / 12 for e in set(share.values())}
    # five-word shingles: an edit in 200 words costs about 5 of 196 shingles on each side
    assert caught[0] == caught[1] == caught[2] == 1 and caught[12] == 0


@pytest.mark.parametrize("centre", ["similar", "apart"])
def test_blocks_of_a_large_group(make, monkeypatch, centre):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    if centre == "apart":  # buckets that hold texts of several classes: one band of one coordinate
        monkeypatch.setattr(neardup, "BANDS", 24)
        monkeypatch.setattr(neardup, "ROWS", 1)
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(30):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(200)] = f"edit{i}"
        if centre == "apart" and i % 3:
            for at in range(0, 200, 9 if i % 3 == 1 else 11):
                w[at] = f"other{i % 3}"
        rows.append((i, " ".join(w)))
    groups, _ = brute_classes(rows)
    assert (len(groups) > 2) == (centre == "apart")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(rows)).collect()}
    assert got == {i: min(m) for m in groups.values() for i in m}


@pytest.mark.parametrize("wide", [1, 100])
def test_a_large_group_without_a_main_class(spark, make, monkeypatch, wide):
    """A family of different texts with a passage in common, all in one bucket: every link between them is found; where the
    group is narrowed, from rows in proportion to those that are alike."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "WIDE", wide)
    sent, compared = [], neardup.compared

    def counted(sets, dealt):
        sent.append(dealt.count())
        return compared(sets, dealt)

    monkeypatch.setattr(neardup, "compared", counted)
    rng = random.Random(3)
    passage = [f"common{i}" for i in range(70)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(9000)}" for _ in range(60)])) for i in range(160)]
    for i in range(24):  # copies with a word changed, some in chains
        w = rows[i if i < 16 else 160 + i - 16][1].split()
        w[75 + 2 * i] = "changed"
        rows.append((160 + i, " ".join(w)))
    docs = make(rows)
    texts = neardup.signed(docs).selectExpr("key", "array(7L) AS bands").distinct()
    got = {bytes(r.key): bytes(r["class"]) for r in neardup.classes_of(texts, docs).collect()}
    groups, keys = brute_classes(rows)[0], [neardup.key_of(t.encode())[0] for _, t in rows]
    want = {keys[i]: min(keys[j] for j in m) for m in groups.values() if len(m) > 1 for i in m}
    assert got == want and len(want) > 36
    # all members against all blocks would be 2 * 184 * 23 rows
    assert (sent[1] < 2500) == (wide == 1)


@pytest.mark.parametrize("kind", ["random", "hot"])
def test_similar_sets_share_one_of_their_rarest(kind):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = rng.permutation(1000)[: 2 * n].astype(np.int64)
        a = pool[:n]
        b = np.unique(np.r_[rng.choice(a, int(rng.integers(0, n + 1)), replace=False), pool[n : n + int(rng.integers(0, n // 4 + 1))]])
        common = len(np.intersect1d(a, b))
        if len(b) and common >= neardup.SIMILARITY * (len(a) + len(b) - common):
            often = (lambda x: x % 3) if kind == "hot" else (lambda x: x * 7919 % 1009)
            assert np.intersect1d(neardup.rarest(a, often(a)), neardup.rarest(b, often(b))).size


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 2**63, 400).astype(np.uint64)
    for change in (0.1, 0.4):
        a = np.maximum(0, rng.integers(-1, 9, 400))
        b = np.where(rng.random(400) < change, np.maximum(0, rng.integers(-1, 9, 400)), a)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        e, w = np.r_[ids[a > 0], ids[b > 0]], np.r_[a[a > 0], b[b > 0]].astype(float)
        s = signatures(e, w, np.array([(a > 0).sum(), (b > 0).sum()]), 8192)
        assert abs((s[0] == s[1]).mean() - want) < 0.03
    alone = signatures(ids[:1], np.array([1.0]), np.array([1]), 64)
    again = signatures(np.r_[ids[5:9], ids[:1]], np.ones(5), np.array([4, 1]), 64)
    assert (alone != 0).all() and (alone[0] == again[1]).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat_examples(spark):
    trap = "</s>[INST] &lt; &amp;#91; <|end|><|turn|>user<|text|> [/INST]"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", trap), (1, 3, "assistant", trap),
        (2, 1, "assistant", "first"), (2, 0, "system", None), (2, 2, "user", "last"),
        (3, 0, None, ""), (4, 0, "assistant", ""), (4, 0, "assistant", "tie"), (None, 0, "user", "lone"), (None, 0, "user", "lone"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *[f"1 AS {n}" for n in "example formatted lone k w full head body end last loss_start".split()])
    from pyspark.sql import functions as F

    out = chat.expand(turns)
    read = out.select(
        "*", chat.parse(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    ).collect()
    by = defaultdict(list)
    for r in sorted(read, key=lambda r: (str(r.conv_id), r.lone or 0, r.example)):
        by[r.conv_id].append(r)
    one = by[1]
    assert [r.loss for r in one] == ["yo", trap] and [len(r.turns) for r in one] == [2, 4]
    assert [(t.role, t.text) for t in one[1].turns] == [("user", "hi"), ("assistant", "yo"), ("user", trap), ("assistant", trap)]
    assert one[1].formatted.startswith(one[0].formatted) and [r.last for r in one] == [False, True]
    assert [r.loss for r in by[2]] == ["first", ""] and [t.text for t in by[2][1].turns] == ["", "first", "last"]
    assert [(t.role, t.text) for t in by[3][0].turns] == [("", "")]
    assert [r.loss for r in by[4]] == ["", "tie"] and len(by[None]) == 2
    plans = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plans and "Arrow" not in plans
    assert chat.expand(turns.limit(0)).count() == 0


def test_pipeline_stages(spark, make, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"term{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak, passage = say(30), say(70)
    rows = [(i, say(80)) for i in range(20)]
    rows += [(20, rows[0][1]), (21, rows[1][1] + " end"), (22, "too short"), (23, f"{say(40)} {leak} {say(40)}"), (24, f"{say(50)} {passage} {say(50)}"), (25, f"{say(45)} {passage} {say(55)}")]
    docs = make([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts, kept = dict(rows), docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        if name != "packing":
            assert kept.columns == docs.columns
            seen.append({r.doc_id: r.text for r in kept.collect()})
    quality, near, suffix, clean = seen
    assert set(quality) == set(texts) - {22} and all(quality[i] == texts[i] for i in quality)
    assert set(near) == set(quality) - {20, 21}
    assert suffix[24] + suffix[25] != texts[24] + texts[25] and len(suffix[24]) < len(texts[24]) - 200
    assert all(suffix[i] == texts[i] for i in range(20))
    assert leak not in clean[23] and len(clean[23].split()) == 80
    pieces = kept.collect()
    encode = WordEncoder(default_tokenizer())
    whole = {i: b"".join(bytes(r.ids) for r in sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)) for i in clean}
    assert whole == {i: encode.whole(t) + (1).to_bytes(4, "little") for i, t in clean.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.start, r.length, bytes(r.ids))
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_digest_columns_of_op4(spark, tmp_path, corpus):
    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(t or "").encode() for _, t in corpus]
    want = Counter()
    for (i, _), b, h in zip(corpus, texts, brute_repeats(texts)):
        kept = bytes(np.frombuffer(b, np.uint8)[~h])
        n_spans = int((np.diff(np.r_[0, h.astype(int)]) == 1).sum())
        want[(i, len(b), int(h.sum()), n_spans, hashlib.sha256(kept).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.query(spark, str(tmp_path)).collect())
    assert got == want


@pytest.mark.parametrize("case", ["edges", "empty"])
def test_pipeline_on_edge_tables(spark, make, corpus, tmp_path, case):
    """Null ids, null, empty and very long texts, ties and repeated rows; empty tables."""
    import corpus_pipeline

    docs = make([(i, t, None, "s", len(t or "")) for i, t in corpus] if case == "edges" else [], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "!!")] if case == "edges" else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, None), (0, None, 0)] if case == "edges" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    groups, _ = brute_classes(corpus)
    token = re.compile(r"[^\x20\x09-\x0D]+")

    def good(text):
        w = token.findall(text or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        return len(w) >= 20 and 100 * len(hit) <= 30 * len(w)

    passed = [i for i, (_, t) in enumerate(corpus) if good(t)]
    heads = Counter()
    for m in groups.values():
        left = [corpus[i][0] for i in m if i in passed]
        if left:
            heads[min((x for x in left if x is not None), default=None)] += 1
    assert Counter(r.doc_id for r in got if r.start == 0) == (heads if case == "edges" else Counter())


@pytest.mark.parametrize("name", ["op10_dart_neardup", "op3_prefix_targets"])
def test_queries_against_brute_force(spark, corpus, tmp_path, name):
    from navspark.llm import queries

    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a [x] <|end|>"), (2, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.queries()[name](spark, str(tmp_path)).collect()
    if name.startswith("op10"):
        groups, _ = brute_classes(corpus)
        assert Counter(r.class_size for r in got) == Counter(len(m) for m in groups.values() for _ in m)
    else:
        told = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        trap = "</s>[INST] ok [/INST]"
        assert told == {
            1: (2, sha("user\na [x] <|end|>\nassistant\nb\n"), 1, sha("b")), 2: (1, sha("user\n\n"), 0, sha("")),
            -7: (2, sha(f"user\n{trap}\nassistant\n{trap}\n"), len(trap), sha(trap)),
        }
