"""License scan, decontamination, quality, toxicity and language model against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from navspark.llm import decontamination, licenses, lm, quality, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


@pytest.mark.parametrize("rows", [200_000, 1])
def test_license_scan(spark, make, corpus, monkeypatch, rows):
    """With the templates' prefixes broadcast, and exchanged."""
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    lines = ["Licensed under CC BY-NC 4.0.", "All rights\nreserved! all rights reserved", "the General PUBLIC license", "Released under the MIT license", "cc by cc by cc"]
    extra = []
    for k, line in enumerate(lines):
        base = (corpus[k][1] or "").split()
        at = rng.randrange(len(base))
        extra.append((200 + k, " ".join(base[:at]) + " " + line + " " + " ".join(base[at:])))
    extra.append((210, "x " * 31 + "all rights reserved " + "y " * 40 + "general public license"))
    extra.append((211, "licensed under some other apache license of version 2 0"))
    for k, (t, label) in enumerate(licenses.TEMPLATES.items()):  # whole licenses at any place, also with changed words
        w = t.split()
        for at in rng.sample(range(len(w)), len(w) // 20):
            w[at] = f"changed{at}"
        extra.append((220 + k, "x " * rng.randrange(2000) + " ".join(w) + " y" * rng.randrange(100)))
    rows = corpus + extra
    docs, matches = licenses.scan(make(rows))
    assert docs.count() == len(rows)
    text = dict(rows[-len(extra):])
    ids = {r.row: r.doc_id for r in docs.collect()}
    places = {}
    for m in matches.where("phrase").collect():
        places.setdefault((ids[m.row], m.label), []).extend(m.places)
    for d, t in text.items():
        w = words(t)
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            want = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            assert sorted(places.get((d, label), [])) == want, (d, label)
    # containment in a block, by brute force
    found = {(ids[m.row], m.step, m.block, m.label) for m in matches.where("not phrase").collect()}
    want = set()
    for template, label in licenses.TEMPLATES.items():
        need, step = set(words(template)), licenses.step_of(len(words(template)))
        for d, t in rows:
            w = words(t)
            for b in range(0, max(1, len(w)), step):
                if len(set(w[b : b + 2 * step]) & need) >= licenses.THRESHOLD * len(need) - 1e-9:
                    want.add((d, step, b // step, label))
    assert found == want and {x[3] for x in want} == set(licenses.TEMPLATES.values())
    assert len({x[1] for x in want}) > 2
    assert licenses.scan(make([]))[0].count() == 0


def brute_hits(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[j : j + window]), set()).add("" if i is None else str(i))
    out = []
    for _, t in rows:
        w = words(t)
        hit, got = [False] * len(w), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    got |= wins[tuple(w[j : j + n])]
                    hit[j : j + n] = [True] * n
        out.append((len(w), sum(hit), sorted(got), hit))
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, make, corpus, block):
    items = [(1, " ".join(corpus[3][1].split()[5:30])), (2, " ".join(corpus[7][1].split()[:12]).upper()), (3, "alpha1 beta2"), (4, "Kappa7"), (5, None), (6, "!!"),
             (1, " ".join(corpus[9][1].split()[3:20])), (None, " ".join(corpus[60 - 14][1].split()[22:40])), (9, "tau1 " * 25)]
    rows = [*corpus, (300, "tau1 " * 40 + "then tau1"), (301, corpus[3][1].replace(" ", ", "))]
    docs, bench = make(rows), spark.createDataFrame(items, "item_id long, text string")
    windows = decontamination.windows_of(bench)
    for whole in (False, True):
        out = decontamination.annotate(docs, windows, block, whole=whole).cache()
        found = {r.row_id: r.items for r in decontamination.items_of(out, windows).collect()}
        got = sorted(out.collect(), key=lambda r: r.row_id)
        assert len(got) == len(rows)
        for (n, n_hit, items_, hit), r in zip(brute_hits(rows, items), got):
            marked = [False] * n
            for s in r.spans:
                marked[s.first : s.first + s.words] = [True] * s.words
            assert (r.n_words, sum(marked), found.get(r.row_id, [])) == (n, n_hit, items_) and marked == hit
    clean = decontamination.decontaminate(docs, bench, block_windows=block)
    assert clean.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, [w for w, h in zip(words(t), hit) if not h], t if not n_hit else None) for (i, t), (_, n_hit, _, hit) in zip(rows, brute_hits(rows, items))), key=key)
    for (i, left, same), r in zip(want, sorted(((r.doc_id, words(r.text), r.text) for r in clean.collect()), key=key)):
        assert (i, left) == r[:2] and same in (None, r[2])
    assert decontamination.annotate(make([]), windows).count() == 0
    assert decontamination.annotate(docs, windows.limit(0)).where("size(spans) > 0").count() == 0


def test_runs_are_few_and_lose_no_occurrence(spark, make, corpus):
    """What several blocks of windows search is cut out of the texts once; clean texts leave nothing."""
    say = random.Random(9)
    clean = [(1000 + i, " ".join(f"clean{say.randrange(500)}" for _ in range(200))) for i in range(20)]
    items = [(1, " ".join(corpus[3][1].split()[5:30])), (2, "Kappa7"), (3, " ".join(corpus[7][1].split()[:12]))]
    rows = [*corpus, *clean]
    docs = spark.createDataFrame([(i, (t or "").encode()) for i, (_, t) in enumerate(rows)], "row_id long, text binary")
    windows = decontamination.windows_of(spark.createDataFrame(items, "item_id long, text string"))
    cut: dict[int, list[tuple[int, list[str]]]] = {}
    for r in decontamination.runs_of(docs, windows.select("window").distinct()).collect():
        cut.setdefault(r.row_id, []).append((r.at, words(bytes(r.text).decode())))
    total = 0
    for i, ((_, t), (n, _, _, hit)) in enumerate(zip(rows, brute_hits(rows, items))):
        inside = [False] * n
        for at, run in cut.get(i, []):
            assert words(t)[at : at + len(run)] == run
            inside[at : at + len(run)] = [True] * len(run)
        assert all(inside[k] for k in range(n) if hit[k])
        total += sum(inside) - sum(hit)
    assert total < 30 and not any(i in cut for i in range(len(corpus), len(rows)))


def test_decontamination_query(spark, corpus, tmp_path):
    rows = [(i, t) for i, t in dict(corpus).items() if i is not None]
    items = [(12, " ".join(corpus[3][1].split()[5:30])), (5, "one"), (7, " ".join(corpus[3][1].split()[8:25]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in decontamination.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for (i, _), (n, n_hit, found, _) in zip(rows, brute_hits(rows, items)):
        sha = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert tuple(got[i])[1:] == (n, n_hit, len(found), sha, n_hit > 0)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(4)
    for size in (3, 6, 20):
        text = np.r_[rng.integers(1, size, 300), 0]
        index = decontamination.FMIndex(text, size)
        for m in (1, 2, 3):
            patterns = np.array([rng.integers(1, size, m) for _ in range(40)])
            which, lo, hi = index.search(patterns)
            got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, lo, hi)}
            for k, p in enumerate(patterns):
                want = [i for i in range(301 - m) if (text[i : i + m] == p).all()]
                assert got.get(k, []) == want


def brute_cutoff(good, bad, risk, level):
    """The bin with the most caught, from the most lenient on while the exact tail holds."""
    n, best, caught = len(good), None, 0
    for b in range(quality.BINS, 0, -1):
        lost = sum(x >= b for x in good)
        if not n or lost >= n * risk:
            break
        p = Fraction(risk)
        if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(lost + 1)) > level:
            break
        if sum(x >= b for x in bad) > caught:
            best, caught = b, sum(x >= b for x in bad)
    return best


@pytest.mark.parametrize("n_good, strata", [(100, 4096), (300, 4096), (1700, 4096), (700, 1)])
def test_quality_query_against_brute_force(spark, tmp_path, monkeypatch, n_good, strata):
    """Counts, cutoffs by an independent exact tail, and verdicts, in two strata or one pooled, with repeated rows."""
    monkeypatch.setattr(quality, "MAX_STRATA", strata)
    rng = random.Random(n_good)
    rows, labels = [], []
    for i in range(n_good + n_good // 4):
        w = [rng.choice(("plain", "words", "HERE", "again", "now")) + str(rng.randrange(99)) for _ in range(rng.randrange(15, 60))]
        if i >= n_good:
            w = [x + "#" * rng.randrange(4) for x in w]
        rows.append((i, " ".join(w) + rng.choice(("", "\n" + w[0] + "\n" + w[0])), "en" if i % 3 else "de"))
        labels.append((i, int(i < n_good)))
    copies = [r for r in rows[: n_good // 3] for _ in range(9)]
    spark.createDataFrame(rows + copies, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + labels[:50], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality.query(spark, str(tmp_path)).collect()}
    rates, base = {}, {}
    for i, t, _ in rows:
        w, lines = TOKEN.findall(t), [x for x in t.split("\n") if TOKEN.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
        symbols, upper = len(re.findall(r"[#*$%&|<>]", t)), sum("A" <= c <= "Z" for c in t)
        base[i] = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert tuple(got[i])[1:7] == (len(w), chars, symbols, dup, len(hit), base[i])
        values = {"symbols": symbols / chars, "dup_lines": dup / len(lines), "repeats": len(hit) / len(w), "upper": upper / chars, "long_words": chars / len(w)}
        rates[i] = [min(quality.BINS, int(values[r] * quality.BINS / quality.TOPS[r])) for r in quality.RULES]
    groups = [["en"], ["de"]] if strata > 1 else [["en", "de"]]
    for group in groups:
        of = [i for i, _, x in rows if x in group]
        good, bad = ([i for i in of if not base[i] and (i < n_good) == y] for y in (True, False))
        cut = brute_cutoff([max(rates[i]) for i in good], [max(rates[i]) for i in bad], quality.RISK, quality.DELTA / len(groups))
        for i in of:
            assert got[i].kept == (not base[i] and (cut is None or max(rates[i]) < cut)), i
    if n_good >= 300:
        assert any(not r.kept and not r.base_failed for r in got.values())


def test_quality_counts(make, corpus):
    rows = quality.counts(make(corpus), ["doc_id", "lang"]).collect()
    assert len(rows) == len(corpus)
    for r, (_, t) in zip(rows, corpus):
        w = TOKEN.findall(t or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = [False] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                hit[i : i + 8] = [True] * 8
        lines = [x for x in (t or "").split("\n") if TOKEN.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(hit))
        assert tuple(r[c] for c in quality.COUNTS[:5]) == want


@pytest.mark.parametrize("own", [["en"], []])
def test_cutoffs_start_no_python_workers(make, corpus, own):
    counted = quality.counts(make(corpus))
    judged = quality.judge(counted, own, [(s, 5) for s in own])
    python_rows = [df._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") for df in (counted, judged)]
    assert python_rows[0] == python_rows[1] and judged.count() == len(corpus)


def test_quality_cutoffs_hold_their_risk(spark, make):
    rng = random.Random(6)
    good = [" ".join(rng.choice(("plain", "words", "here", "again", "now")) + str(rng.randrange(99)) for _ in range(40)) for _ in range(3000)]
    bad = [" ".join(x + "###" for x in t.split()) for t in good[:400]]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(i < 3000)) for i, _ in rows] + [(0, 0), (1, None)], "doc_id long, quality int")
    out = quality.keep(docs, labels)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert len([i for i in range(3000) if i in kept]) >= 3000 * (1 - quality.RISK)
    assert not [i for i in range(3000, 3400) if i in kept]
    # few labels: nothing but the base rule rejects
    assert quality.keep(docs, labels.where("doc_id % 200 = 0")).count() == 3400
    assert quality.keep(docs, labels.limit(0)).count() == 3400
    assert quality.keep(make([]), labels).count() == 0


def test_quality_cutoffs_of_small_strata(spark, make):
    """A few hundred good labels reject bad documents, as whole rule sets are tested."""
    rng = random.Random(7)
    good = [" ".join(rng.choice(("plain", "words", "here", "again", "now")) + str(rng.randrange(99)) for _ in range(40)) for _ in range(300)]
    bad = [" ".join(x + "###" for x in t.split()) for t in good[:60]]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(360)], "doc_id long, quality int")
    docs = make(list(enumerate(good + bad)))
    assert {r.doc_id for r in quality.keep(docs, labels).collect()} == set(range(300))
    # one label under the minimum of a single stratum keeps everything: 0.98 ** 148 > 0.05
    assert quality.keep(docs, labels.where("doc_id >= 152")).count() == 360


def test_binomial_tail_is_exact():
    for n, p, k in ((20, 0.1, 0), (20, 0.1, 3), (200, 0.02, 5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.exp(quality.log_tail(k, n, p)) == pytest.approx(want)


def toxic_rows(n=600):
    rng = random.Random(8)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(6)]
        if i % 3 == 0:
            for _ in range(2):
                sentences[rng.randrange(6)] += " " + rng.choice(("nastiest", "nastily", "awful"))
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(i % 3 == 0)))
    return rows, labels


def test_toxicity_held_out_and_located(spark, make):
    rows, labels = toxic_rows()
    docs = make(rows)
    learn = spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id >= 150")
    model = toxicity.fit(docs, learn)
    got = {r.row.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = range(150)
    assert sum((got[i].score >= 0.5) == (i % 3 == 0) for i in held) >= 147
    text = dict(rows)
    for i in held:
        for s in got[i].offending:
            bag = toxicity.sentences(text[i].encode())[s.sentence]
            assert any(w.startswith((b"nasti", b"awful")) for w in bag)


def test_toxicity_edges(spark, make, corpus):
    docs = make(corpus)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    rows, labels = toxic_rows(60)
    model = toxicity.fit(make(rows), spark.createDataFrame([*labels, (0, 0), (1, None)], "doc_id long, toxic int"))
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert toxicity.score(make([]), model).count() == 0
    assert got[70] == got[71] == got[73] == 0 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_scores_are_the_noisy_or(make):
    """From given weights: sentences' logistic scores, combined by 1 - prod(1 - score); certainty gives no warning."""
    weights, bias = {"bad": 3.0, "5nasti": 2.5, "4nast": 1.0, "good": -2.0, "sure": 1000.0}, -2.0
    rows = [(1, "bad words. nasty good! nastiest bad nastily\nfine"), (2, "fine. fine"), (3, "sure"), (4, None), (5, " .! "), (6, "good " * 4000 + ". bad")]

    def of(word):
        return {word} | ({"4" + word[:4]} if len(word) > 4 else set()) | ({"5" + word[:5]} if len(word) > 5 else set())

    got = {r.row.doc_id: r for r in toxicity.score(make(rows), (weights, bias)).collect()}
    for i, t in rows:
        left, offending = 1.0, []
        for k, sentence in enumerate(s for s in re.split(r"[.!?\n]", t or "") if words(s)):
            p = 1 / (1 + math.exp(-min(500, bias + sum(weights.get(f, 0) for f in set().union(*map(of, words(sentence)))))))
            left *= 1 - p
            offending += [(k, p)] if p >= 0.5 else []
        assert got[i].score == pytest.approx(1 - left if words(t) else 0.0)
        assert [(o.sentence, pytest.approx(o.score)) for o in got[i].offending] == offending


def test_toxicity_sample(spark, make, monkeypatch):
    """Repeated rows of drawn ids count once and push no class out; beyond the cap the class shares still count."""
    rows, labels = toxic_rows(300)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    copies = rows + [rows[1]] * 400
    assert toxicity.fit(make(copies), marks) == toxicity.fit(make(rows), marks)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, words, toxic, share: seen.append((len(bags), int(toxic.sum()), share)))
    toxicity.fit(make(copies), marks, 50)
    assert seen == [(100, 50, pytest.approx(1 / 3))]


def test_toxicity_query(spark, tmp_path):
    rows, labels = toxic_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("frequent", [524_288, 40])
def test_base_model(make, corpus, monkeypatch, frequent):
    """With the counts of all words broadcast, and with most of them joined."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = make(corpus).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    got = lm.score(docs, lm.counted(docs.where("not held_out"))).collect()
    tokens = lambda t: [*TOKEN.findall(lower(t)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(x for i, t in corpus if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t))) for i, t in corpus), key=key)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known) for r in got), key=key) == want
    text = {i: t for i, t in corpus}
    for r in got:
        assert r.train_tokens == n and r.score < 0
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(text[r.doc_id]))
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert lm.score(docs.limit(0), lm.counted(docs.limit(0))).count() == 0


def test_context_tree_is_the_weighted_mixture():
    """Against the recursive definition, for one decision tree and all bytes of short contexts."""
    rng = random.Random(3)
    text = bytes(rng.choice(b"abc") for _ in range(400))
    counts = Counter()
    padded = bytes(3) + text
    for i in range(len(text)):
        counts[padded[i : i + 3], padded[i + 3]] += 1
    cells = [(3, int.from_bytes(ctx, "big"), b, n) for (ctx, b), n in counts.items()]
    own3 = sorted({c for _, c, _, _ in cells})
    own2 = sorted({c & 0xFFFF for c in own3})
    tree = lm.ContextTree(cells, own2, own3)
    leaf = tree.leaves()
    assert np.allclose((10.0 ** tree.logp.astype(float)).sum(1), 1, atol=1e-4)

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def decision(ctx, prefix, bits):
        """Probability of a one at a node of the bit tree after bytes ctx, by the definition."""
        def tally(suffix):
            z = o = 0
            for (c, b), n in counts.items():
                if c.endswith(suffix) and (b | 256) >> (8 - bits) == prefix:
                    if b >> (7 - bits) & 1:
                        o += n
                    else:
                        z += n
            return z, o

        def node(suffix):  # log weighted probability and probability of a one on the path of ctx
            z, o = tally(suffix)
            own, p = kt(z, o), (o + 0.5) / (z + o + 1)
            kids = sorted({c[len(c) - len(suffix) - 1 :] for c, _ in counts if c.endswith(suffix)}) if len(suffix) < 3 else []
            if not kids:
                return own, p
            parts = {k: node(k) for k in kids}
            below = sum(w for w, _ in parts.values())
            share = 1 / (1 + math.exp(below - own))
            child = next((q for k, (_, q) in parts.items() if ctx.endswith(k)), 0.5)
            return np.logaddexp(own, below) - math.log(2), share * p + (1 - share) * child

        return node(b"")[1]

    for ctx in (b"abc", b"caa", b"bbb"):
        for byte in b"abc":
            want, prefix = 0.0, 1
            for bits in range(8):
                p = decision(ctx, prefix, bits)
                bit = byte >> (7 - bits) & 1
                want += math.log10(p if bit else 1 - p)
                prefix = prefix << 1 | bit
            got = tree.logp[leaf[int.from_bytes(ctx, "big")], byte]
            assert got == pytest.approx(want, abs=1e-3)


def test_scores_are_those_of_every_context(make, monkeypatch):
    """Against the definition with all contexts of DEPTH bytes: rare ones count, also among many bytes of others."""
    monkeypatch.setattr(lm, "CHUNK", 3000)
    monkeypatch.setattr(lm, "HELD_GRAMS", 500)
    rng, depth = random.Random(12), lm.DEPTH
    rows = [(i, "".join(rng.choice("ab ") for _ in range(150))) for i in range(300)]
    rows += [(400, "a rare phrase, twice"), (401, "a rare phrase, twice"), (402, None), (403, "qqé"), (404, "zzzz zz"), (405, "")]
    rows += [(500, "another rare phrase, twice"), (500, "a rare phrasing unseen \u0001"), (None, "ab ba")]
    docs = make(rows).withColumn("held_out", F.coalesce(F.col("doc_id"), F.lit(500)) == 500)
    got = {}
    for r in lm.score(docs, lm.counted(docs.where("not held_out"))).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.bits_per_byte))

    def grams(text):
        raw = bytes(depth) + (text or "").encode() + b"\0"
        return [(raw[j - depth : j], raw[j]) for j in range(depth, len(raw))]

    tally, kids = {}, {}
    for i, t in rows:
        for ctx, byte in grams(t) if i not in (500, None) else ():
            for d in range(depth + 1):
                suffix = ctx[depth - d :]
                if d:
                    kids.setdefault(suffix[1:], set()).add(suffix)
                for bit in range(8):
                    tally.setdefault((suffix, (byte | 256) >> (8 - bit)), [0, 0])[byte >> (7 - bit) & 1] += 1
    memo = {}

    def weighted(suffix, prefix):
        """Log weighted probability, share of the own estimate and the estimate of a one."""
        if (suffix, prefix) not in memo:
            z, o = tally.get((suffix, prefix), (0, 0))
            own = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
            if len(suffix) == depth:
                memo[suffix, prefix] = own, 1.0, (o + 0.5) / (z + o + 1)
            else:
                below = sum(weighted(k, prefix)[0] for k in kids.get(suffix, ()))
                memo[suffix, prefix] = np.logaddexp(own, below) - math.log(2), 1 / (1 + math.exp(min(700, below - own))), (o + 0.5) / (z + o + 1)
        return memo[suffix, prefix]

    def log10p(ctx, byte):
        out = 0.0
        for bit in range(8):
            p = 0.5
            for d in range(depth, -1, -1):
                _, share, one = weighted(ctx[depth - d :], (byte | 256) >> (8 - bit))
                p = share * one + (1 - share) * p
            out += math.log10(p if byte >> (7 - bit) & 1 else 1 - p)
        return out

    want = {}
    for i, t in rows:
        s = sum(log10p(*g) for g in grams(t))
        want.setdefault(i, []).append((s, -s / math.log10(2) / len(grams(t))))
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-4), i
    # without training every decision is even
    even = lm.score(docs, lm.counted(docs.limit(0))).collect()
    assert len(even) == len(rows) and all(r.bits_per_byte == pytest.approx(8) for r in even)
