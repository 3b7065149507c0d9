"""Merkle manifest, pieces and spelling variants against brute force and the library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from navspark.llm import charmap, merkle, pieces, spelling

# Merkle manifest


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text), shown text -> sorted result rows."""
    groups: dict = {}
    for row, shown in rows:
        bad = row if shown is None else (*row[:4], shown)
        groups.setdefault(row[2], []).append((row[0], leaf_of(row), leaf_of(bad)))

    def tree(leaves):
        """The root, and the path of each leaf as (place, siblings)."""
        level, paths, owners = list(leaves), [[] for _ in leaves], [[i] for i in range(len(leaves))]
        while len(level) > 1:
            up, above = [], []
            for a in range(0, len(level), 8):
                run = level[a : a + 8]
                for k, mine in enumerate(owners[a : a + 8]):
                    for i in mine:
                        paths[i].append((k, run[:k] + run[k + 1 :]))
                up.append(digest(*run))
                above.append([i for mine in owners[a : a + 8] for i in mine])
            level, owners = up, above
        return level[0], paths

    out, order = [], sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    if not order:
        return []
    root, tops = tree([trees[g][0] for g in order])
    for g, top in zip(order, tops):
        subroot, paths = trees[g]
        for (id_, own, shown), path in zip(groups[g], paths):
            found = shown
            for k, others in path + top:
                found = digest(*others[:k], found, *others[k:])
            proof = digest(*[x for _, others in path + top for x in others])
            out.append((id_, own, subroot, root, proof, found, found == root))
    return sorted(out, key=str)


def manifest_rows(frame):
    made = merkle.manifest(frame, F.when(merkle.fold("doc_id", 3) == 0, merkle.ascii_lower(F.col("text"))))
    got = sorted((tuple(r) for r in merkle.checked(made, frame.sparkSession).collect()), key=str)
    return made, got


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("parts", [1, 7])
def test_manifest(spark, make, parts):
    rng = random.Random(3)
    langs = ["en"] * 150 + ["de"] * 9 + [None] * 8 + ["", "é", "z", "fr"] + ["x"] * 65
    rows = [(i if i % 29 else None, rng.choice(["s", None, ""]), g, rng.choice([None, -5, 12]), rng.choice([None, "", "Text É\x00 A", "y" * 300_000, str(i)]))
            for i, g in enumerate(langs)]
    rows += rows[:20] + [(7, "other", "en", 1, "same id"), (7, "other", "en", 1, "same id")]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made, got = manifest_rows(make(rows, COLUMNS).repartition(5))
        lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        shown = [None if r[4] is None or zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 3 else r[4].encode().translate(lower).decode() for r in rows]
        assert got == brute_manifest(list(zip(rows, shown)))
        assert 0 < sum(not r[-1] for r in got) < len(rows)
        for r in merkle.proofs(made, spark).collect():
            found = bytes.fromhex(r.leaf)
            for place, siblings in r.path:
                found = merkle.h(*[bytes.fromhex(x) for x in siblings[:place]], found, *[bytes.fromhex(x) for x in siblings[place:]])
            assert found == made.root and found.hex() == r.root
        made.shelf.clear()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_manifest_of_few_rows(make):
    assert manifest_rows(make([], COLUMNS))[1] == []
    one = [(4, "s", None, 1, None)]
    assert manifest_rows(make(one, COLUMNS))[1] == brute_manifest([(one[0], None)])


# pieces


def variant(rules: dict[int, int | bytes], trainer: bytes = b"", drop_bytes: bool = False) -> bytes:
    """The default model with other rules."""
    with open(pieces.default_model(), "rb") as f:
        top = list(pieces.wire(f.read()))
    kept = [v for f, v in top if f == 1 and not (drop_bytes and dict(pieces.wire(v)).get(3) == pieces.BYTE)]
    spec = b"".join(pieces.wired(f, v) for f, v in rules.items())
    old = next(v for f, v in top if f == 2)
    old = old.replace(pieces.wired(35, 1), pieces.wired(35, 0)) if drop_bytes else old
    return b"".join(pieces.wired(1, v) for v in kept) + pieces.wired(2, old + trainer) + pieces.wired(3, spec)


def compiled_map() -> bytes:
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return dict(pieces.wire(dict(pieces.wire(proto))[3]))[2]


def hard_texts(n: int) -> list[str]:
    rng = random.Random(1)
    parts = [*"ab  eé▁ ｱｲﾞ①ﬁ\t\n\r 　​中文😀é각가<>/sthe THE㍿\x00İⅷ½", " the", " of", "<0x0A>", "</s>", "  ", "日本", "�", "ｶﾞ"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 50))) for _ in range(n)]
    return ["", "   ", " ", "▁", "a ", "　", "é", "x" * 3000, "é " * 2000, *made]


@pytest.mark.parametrize("kind", ["own", "map", "map_squeezed", "squeezed", "suffix", "no_bytes", "no_prefix"])
def test_pieces_are_the_librarys(kind):
    nfkc = compiled_map()
    proto = {
        "own": variant({3: 1, 4: 0}), "map": variant({2: nfkc, 3: 1, 4: 0}), "map_squeezed": variant({2: nfkc, 3: 1, 4: 1}),
        "squeezed": variant({3: 1, 4: 1}), "suffix": variant({2: nfkc, 3: 1, 4: 1}, pieces.wired(24, 1)),
        "no_bytes": variant({2: nfkc, 3: 1, 4: 1}, drop_bytes=True), "no_prefix": variant({2: nfkc, 3: 0, 4: 0}),
    }[kind]
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Model(proto)
    texts = hard_texts(400)
    for text, (ids, starts, ends) in zip(texts, model.encode([t.encode() for t in texts])):
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want]
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want]
        assert model.decode(ids).decode() == library.decode(ids.tolist())
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, library.get_piece_size())]) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_the_map_is_the_librarys():
    spec = pieces.wired(1, b"x") + pieces.wired(2, compiled_map()) + pieces.wired(3, 0) + pieces.wired(4, 0)
    model = pieces.Model(variant({2: compiled_map(), 3: 0, 4: 0, 5: 0}))
    library = sentencepiece.SentencePieceNormalizer(model_proto=pieces.wired(3, spec + pieces.wired(5, 0)))
    texts = hard_texts(400)
    assert [raw.decode() for raw, _ in model.normalize([t.encode() for t in texts])] == [library.normalize(t) for t in texts]


def test_invalid_bytes_are_characters_of_their_own():
    rules = charmap.Rules(pieces.Model(variant({2: compiled_map(), 3: 0, 4: 0})).rules.charmap, False, False, False)
    raw, places = charmap.normalize([b"a\xff\xc3\xe4\xb8b\xe4\xb8\xad"], rules)[0]
    assert raw.decode() == "a����b中" and places.tolist() == [0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 6, 9]


def test_pieces_of_a_table(spark, make):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [None, *hard_texts(30), "words and words " * 30_000, "repeated", "repeated"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    frame = make(rows)
    encoded = pieces.encode(frame)
    assert encoded.select("row.*").columns == frame.columns
    got = {r.id: (r.ids, r.starts, r.ends) for r in encoded.select(F.col("row.doc_id").alias("id"), "ids", "starts", "ends").collect()}
    back = {r.id: r.text for r in pieces.decode(encoded).select(F.col("row.doc_id").alias("id"), "text").collect()}
    told = {r.doc_id: r for r in pieces.digests(frame).collect()}
    for i, t in rows:
        ids = library.encode(t or "")
        assert got[i][0] == ids and back[i] == library.decode(ids)
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (told[i].n_tokens, told[i].ids_sha256, told[i].decoded_sha256) == (len(ids), *want)
        assert told[i].span_bytes == len((t or "").encode())  # this model leaves no byte out
    assert pieces.digests(make([])).count() == pieces.encode(make([])).count() == 0


# spelling variants


def brute_variants(rows, every):
    counts: Counter = Counter()
    for id_, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for word in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if id_ is None else id_}:{word}".encode())
            k = h % len(word)
            counts[word[:k] + word[k + 1 :] if h % every == 0 else word] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, close = {}, {}
    for w, n in known.items():
        others = [v for v in known if abs(len(v) - len(w)) < 2 and v != w and near(v, w)]
        close[w] = len(others)
        best = min(others, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, close[w], known.get(form[w])) for w, n in known.items())


def variants_of(frame, every):
    return sorted(tuple(r) for r in spelling.variants(frame, every=every).collect())


@pytest.mark.parametrize("held", [5, 100_000])
def test_spelling_variants(spark, make, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    rng = random.Random(4)
    base = ["aaaaaaa", "aaaaaaaa", "aaabaaa", "bananas", "straßen×", "naïvetés", "abcdefgh", "étérnité", "short", "a" * 3000, "a" * 2999 + "b", "z" * 3001]
    base += ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(60)]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "ÿ" + w[k + 1 :], w.upper()])

    rows = [(i if i % 7 else None, rng.choice(" -.1_\n").join(slip(rng.choice(base[:40])) for _ in range(60))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "commona " * 4000), (502, " ".join(base * 2)), (502, " ".join(base * 2)), (503, "commonx " * 30), (504, "commoxx " * 2)]
    frame = make(rows).repartition(6)
    for every in (31, 2):
        got = variants_of(frame, every)
        assert got == brute_variants(rows, every)
        assert any(r[2] not in (r[0], r[1]) for r in got) or every == 2  # a root two steps away
    assert variants_of(make([]), 31) == []


def test_deletion_keys_are_those_of_the_strings():
    texts = ["", "a", "aa", "abcabc", "aabbaa", "éÿ", "ab" * 500]
    owner, key, low, high = spelling.deletion_keys(texts)
    found: dict = {}
    for w, k, a, b in zip(owner.tolist(), key.tolist(), low.tolist(), high.tolist()):
        left = {texts[w][:i] + texts[w][i + 1 :] for i in range(a, b)} if a >= 0 else {texts[w]}
        assert len(left) == 1
        found.setdefault(k, set()).update(left)
    assert all(len(x) == 1 for x in found.values()) and len(found) == len({s for x in found.values() for s in x})


def test_colliding_keys_are_told_apart_by_the_strings(make, monkeypatch):
    rows = [(1, "alphabet alphabets alphabit betaware betawarx gammaray gammarays unalike " * 2)]
    want = brute_variants(rows, 31)
    real = spelling.deletion_keys
    monkeypatch.setattr(spelling, "mix64", lambda x: x & np.uint64(1))
    owner, key, low, high = real([w for w, *_ in want])
    assert len(set(key.tolist())) <= 2
    group = [(want[w][0], want[w][3], a, b) for w, a, b in zip(owner.tolist(), low.tolist(), high.tolist())]
    met: Counter = Counter()
    for word, n, _ in spelling.near_in(group):
        met[word] += n
    assert met == Counter({w: n for w, _, _, _, n, _ in want if n})
