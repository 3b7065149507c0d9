"""Language-model scoring: context-tree weighting over bytes, and the add-one word model as base.

Context-tree weighting.  Each byte is eight binary decisions; a decision is conditioned on the bytes before it, up to
``DEPTH`` of them.  Every context of every depth has a Krichevsky-Trofimov estimate of the decision, and a context's
weighted probability is half its own estimate and half the product of its children's, so all depths are mixed.  The
counts come from all training texts; a text is then scored with the frozen mixture: walking from the deepest context
to the root, ``p = (b * kt + p_child) / (b + 1)`` with ``b = KT / product of the children's``.  A text ends with a zero
byte and starts after zero bytes.

Every context that occurs has a node, however rare; what a context has not seen is even.  The model is a table, never
whole in one place: a gram (the bytes before a byte, nearest first, and the byte) belongs to one of ``CELLS`` cells by
the two nearest bytes, and a cell's task weighs the subtrees below these.  Only the tree's top, at most 256 contexts of
one byte and the root, is built on the driver and broadcast.  Texts are scored in chunks of about ``CHUNK`` bytes: a
chunk asks each cell once for its different grams, and the answers come back to the chunk's texts.

Base.  Words' counts are joined to the texts' words.  Words that make up at least 1 / ``FREQUENT`` of the tokens (at
most FREQUENT of them) are broadcast; all others are joined by key.

Defined cases: a null text is empty and has the end token only; repeated rows are scored each; with no training rows
every estimate is uniform; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, fold, forget, mix64, released, sliced, stored, table, text_bytes

#: Bytes of context: at most 7, as a gram is one 64-bit number.
DEPTH, CELLS, CHUNK, FREQUENT = 5, 256, 1 << 24, 524_288
HELD_WORDS, HELD_GRAMS = 200_000, 4_000_000
END = b""


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of the texts and their ends: the bytes before it, nearest first, and the byte as a number; the offsets
    of the texts."""
    lead, sizes = bytes(depth), np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer(b"".join([lead + t + b"\0" for t in texts]) or lead, np.uint8)
    key = raw[depth:].astype(np.uint64)
    for k in range(1, depth + 1):
        key |= raw[depth - k : len(raw) - k].astype(np.uint64) << np.uint64(8 * (depth + 1 - k))
    offsets = np.r_[0, np.cumsum(sizes)]
    # the zeros before every text but the first are no bytes of a text
    inside = np.ones(len(key), bool)
    for k in range(depth):
        inside[offsets[1:-1] + np.arange(len(texts) - 1) * depth + k] = False
    return key[inside], offsets


def encoded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, and each one's index."""
    found = pa.array(key, pa.uint64()).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def tallied(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, sorted, and how often each occurs."""
    key = np.sort(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.diff(np.r_[first, len(key)])


def cells_of(key: np.ndarray, depth: int) -> np.ndarray:
    return (mix64(key >> np.uint64(8 * depth - 8)) % np.uint64(CELLS)).astype(np.uint16)


def by_cell(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of different grams by cell and number; the CELLS + 1 offsets of the cells."""
    order = np.argsort(key)
    cell = cells_of(key[order], depth)
    order = order[np.argsort(cell, kind="stable")]
    return order, np.r_[0, np.cumsum(np.bincount(cell, minlength=CELLS))]


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, which compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed_keys(key: np.ndarray) -> bytes:
    return packed(np.diff(key, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different grams and their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def counted_words(docs: DataFrame) -> DataFrame:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = [pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
            words.clear()
            return pa.RecordBatch.from_arrays(out, ["key", "n"])

        for whole in batches:
            for batch in sliced(whole, "text"):
                for text in batch.column("text").to_pylist():
                    words.update(tokens(text))
                words[END] += batch.num_rows
                if len(words) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(text_bytes().alias("text"))
    return rows.mapInArrow(released(count), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def counted_grams(docs: DataFrame, depth: int) -> DataFrame:
    """cell, grams, counts: one row a cell, packed."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = merged(held)
            held.clear()
            order, at = by_cell(key, depth)
            some = np.flatnonzero(np.diff(at)).tolist()
            parts = [order[at[c] : at[c + 1]] for c in some]
            out = [
                pa.array(some, pa.int64()), pa.array([packed_keys(key[i]) for i in parts], pa.binary()),
                pa.array([packed(n[i]) for i in parts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(out, ["cell", "grams", "counts"])

        for whole in batches:
            for batch in sliced(whole, "text"):
                held.append(tallied(grams(batch.column("text").to_pylist(), depth)[0]))
                size += len(held[-1][0])
                if size > HELD_GRAMS:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, size, least = None, [], 0, HELD_GRAMS

        def done() -> pa.RecordBatch:
            key, n = merged(held)
            out = [pa.array([cell], pa.int64()), pa.array([packed_keys(key)], pa.binary()), pa.array([packed(n)], pa.binary())]
            return pa.RecordBatch.from_arrays(out, ["cell", "grams", "counts"])

        for batch in batches:
            for c, key, n in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell and cell is not None:
                    yield done()
                    held, size, least = [], 0, HELD_GRAMS
                cell = c
                held.append((unpacked_keys(key), unpacked(n, np.int64)))
                size += len(held[-1][0])
                if size > least:
                    held = [merged(held)]
                    size = len(held[0][0])
                    least = max(HELD_GRAMS, 2 * size)
        if cell is not None:
            yield done()

    schema = "cell long, grams binary, counts binary"
    rows = docs.select(text_bytes().alias("text")).mapInArrow(released(count), schema)
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(released(merge), schema)


def counted(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Of all texts: kind 'word', key, n: words with the end token; kind 'gram', n, key, counts: a cell's grams."""
    words = counted_words(docs).select(F.lit("word").alias("kind"), "key", "n", F.lit(None).cast("binary").alias("counts"))
    cells = counted_grams(docs, depth)
    return words.unionByName(cells.select(F.lit("gram").alias("kind"), F.col("grams").alias("key"), F.col("cell").alias("n"), "counts"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from 0.5 on."""
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def decisions(counts: np.ndarray) -> np.ndarray:
    """Counts of ones and zeros at the 255 inner nodes of the byte's bit tree, from counts of the 256 bytes."""
    out = np.zeros((len(counts), 256, 2))
    level = counts
    for bit in range(7, -1, -1):
        pairs = level.reshape(len(counts), 1 << bit, 2)
        out[:, 1 << bit : 2 << bit] = pairs
        level = pairs.sum(2)
    return out


class ContextTree:
    """The weighted tree of depth three in one place, by which tests check the formulas that Cell shares: ``leaf`` maps the three bytes before a byte to a row of ``logp``, log10 probabilities."""

    def __init__(self, cells: list[tuple[int, int, int, int]], own2: list[int], own3: list[int]):
        """cells: (depth, context, byte, n) at the deepest own or shared node; a shared node is its parent's depth and
        context.  own2 and own3: contexts of two and three bytes with nodes of their own."""
        names = [(1, c) for c in range(256)] + [(2, c) for c in sorted(own2)] + [(3, c) for c in sorted(own3)]
        row = {x: i for i, x in enumerate(names)}
        counts = np.zeros((len(names), 256), np.float64)
        for depth, context, byte, n in cells:
            counts[row[depth, context], byte] += n
        # rows of leaves come first, then the inner nodes: contexts of two bytes, of one, and none
        n1, n2 = 256, 256 + len(own2)
        parent = np.empty(len(names), np.int64)  # of a leaf: the inner node above it
        parent[:n1] = np.arange(n1)
        parent[n1:n2] = np.arange(n1, n2)
        of2 = {c: n1 + i for i, c in enumerate(sorted(own2))}
        parent[n2:] = [of2[c & 0xFFFF] for c in sorted(own3)]
        above2 = np.array([c & 0xFF for c in sorted(own2)], np.int64)
        inner = np.zeros((n2, 256))
        np.add.at(inner, parent, counts)
        np.add.at(inner, above2, inner[n1:n2].copy())
        leaf_kt, leaf_p = self.estimate(counts)
        inner_kt, inner_p = self.estimate(inner)
        root_kt, root_p = self.estimate(inner[:n1].sum(0, keepdims=True))
        below = np.zeros((n2, 256))
        np.add.at(below, parent, leaf_kt)
        weighted2, gain2 = self.weigh(inner_kt[n1:], below[n1:])
        np.add.at(below, above2, weighted2)
        weighted1, gain1 = self.weigh(inner_kt[:n1], below[:n1])
        _, gain0 = self.weigh(root_kt, weighted1.sum(0, keepdims=True))
        p = leaf_p
        deep = parent >= n1
        p[deep] = self.blend(gain2[parent[deep] - n1], inner_p[parent[deep]], p[deep])
        up1 = parent.copy()
        up1[deep] = above2[parent[deep] - n1]
        p = self.blend(gain1[up1], inner_p[up1], p)
        p = self.blend(gain0, root_p, p)
        self.logp = self.bytes_of(p)
        two = np.tile(np.arange(256), 256)  # contexts of two bytes to rows: shared with the one-byte context at first
        for c in own2:
            two[c] = row[2, c]
        self.two, self.three = two.astype(np.uint16), [(c, row[3, c]) for c in own3]

    @staticmethod
    def estimate(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log KT probabilities of all decisions' counts, and the KT estimates of a one."""
        d = decisions(counts)
        zeros, ones = d[:, :, 0], d[:, :, 1]
        kt = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)
        return kt, (ones + 0.5) / (zeros + ones + 1)

    @staticmethod
    def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weighted probability, and the share of a context's own estimate."""
        return np.logaddexp(own, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    @staticmethod
    def blend(share: np.ndarray, own: np.ndarray, child: np.ndarray) -> np.ndarray:
        return share * own + (1 - share) * child

    @staticmethod
    def bytes_of(p: np.ndarray) -> np.ndarray:
        """log10 of the bytes' probabilities from those of their decisions."""
        out = np.zeros((len(p), 1))
        for bit in range(8):
            node = p[:, 1 << bit : 2 << bit]
            out = np.stack([out + np.log10(1 - node), out + np.log10(node)], 2).reshape(len(p), -1)
        return out.astype(np.float32)

    def leaves(self) -> np.ndarray:
        leaf = np.tile(self.two, 256)
        for c, r in self.three:
            leaf[c] = r
        return leaf


HALVES, WHOLES = log_gamma(np.arange(1 << 14) + 0.5), log_gamma(np.arange(1 << 14) + 1.0)


def log_gamma_at(table_: np.ndarray, n: np.ndarray, more: float) -> np.ndarray:
    """Log gamma of n + more, from a table where it reaches."""
    out = table_[np.minimum(n, len(table_) - 1)]
    big = n >= len(table_)
    if big.any():
        out[big] = log_gamma(n[big] + more)
    return out


class Cell:
    """The subtrees of a cell's grams from depth two on: per depth and bit the nodes, as sorted numbers of context and
    bits before, their shares and estimates."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        self.depth = depth
        levels = [(key, n, None)]  # from the deepest: grams, counts, and the first row and parent of the rows below
        for d in range(depth - 1, 1, -1):
            k, m, _ = levels[-1]
            of, up = np.unique(self.at(k, d + 1, d), return_inverse=True)
            levels.append((of, np.bincount(up, m, minlength=len(of)).astype(np.int64), up))
        self.nodes: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.tops = []  # per bit: nodes of depth two and their log weighted probabilities
        for bit in range(8):
            out, weighted, first, node = [], None, None, None
            for k, m, up in levels:
                prefix = k >> np.uint64(8 - bit)
                begins = np.r_[True, prefix[1:] != prefix[:-1]][: len(k)]
                of_row, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
                ones = np.bincount(of_row, m * ((k >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64), minlength=len(starts)).astype(np.int64)
                zeros = np.bincount(of_row, m, minlength=len(starts)).astype(np.int64) - ones
                kt = log_gamma_at(HALVES, zeros, 0.5) + log_gamma_at(HALVES, ones, 0.5) - log_gamma_at(WHOLES, zeros + ones, 1.0) - math.log(math.pi)
                share = np.ones(len(starts))
                if weighted is None:
                    weighted = kt
                else:
                    below = np.bincount(of_row[up[first]], weighted, minlength=len(starts))
                    weighted, share = ContextTree.weigh(kt, below)
                out.append((prefix[starts], share, (ones + 0.5) / (zeros + ones + 1)))
                first = starts
            self.nodes.append(out)
            self.tops.append((out[-1][0], weighted))
        self.key, self.counts2 = key, levels[-1][:2]

    @staticmethod
    def at(key: np.ndarray, of: int, depth: int) -> np.ndarray:
        """Grams of depth ``of`` at a smaller depth."""
        return key >> np.uint64(8 * (of + 1 - depth)) << np.uint64(8) | key & np.uint64(255)

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the nearest byte: numbers of it and of a decision, and the sum of log weighted probabilities; numbers of
        it and of the byte, and the count."""
        places = [(k >> np.uint64(8 + bit)) << np.uint64(8) | np.uint64(1 << bit) | k & np.uint64((1 << bit) - 1) for bit, (k, _) in enumerate(self.tops)]
        place, at = np.unique(np.concatenate(places), return_inverse=True)
        k, n = self.counts2
        gram, which = np.unique(self.at(k, 2, 1), return_inverse=True)
        return place, np.bincount(at, np.concatenate([w for _, w in self.tops])), gram, np.bincount(which, n).astype(np.int64)

    def logp(self, key: np.ndarray, own: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 probabilities of grams; own and left: of the nearest byte's decisions, what the top adds, and the share
        of what is below."""
        total, near = np.zeros(len(key)), (key >> np.uint64(8 * self.depth)).astype(np.int64)
        for bit, levels in enumerate(self.nodes):
            p = np.full(len(key), 0.5)
            for d, (nodes, share, estimate) in zip(range(self.depth, 1, -1), levels):
                want = self.at(key, self.depth, d) >> np.uint64(8 - bit) if d < self.depth else key >> np.uint64(8 - bit)
                i = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1) if len(nodes) else None
                if i is not None:
                    p = np.where(nodes[i] == want, ContextTree.blend(share[i], estimate[i], p), 0.5)
            decision = 1 << bit | (key & np.uint64(255)).astype(np.int64) >> (8 - bit)
            p = own[near, decision] + left[near, decision] * p
            one = (key >> np.uint64(7 - bit)) & np.uint64(1) == 1
            total += np.log10(np.where(one, p, 1 - p))
        return total


def top_of(counts: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What the root and the contexts of one byte add to a decision's probability, and the share left to the rest."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n in zip(batch.column("key").to_pylist(), batch.column("counts").to_pylist()):
                place, w, gram, m = Cell(unpacked_keys(key), unpacked(n, np.int64), depth).top()
                out = [
                    pa.array(np.r_[np.zeros(len(place), bool), np.ones(len(gram), bool)]),
                    pa.array(np.r_[place, gram].astype(np.int64)), pa.array(np.r_[w, np.zeros(len(gram))]),
                    pa.array(np.r_[np.zeros(len(place), np.int64), m]),
                ]
                yield pa.RecordBatch.from_arrays(out, ["gram", "place", "w", "n"])

    cells = counts.where("kind = 'gram'").select("key", "counts")
    rows = cells.mapInArrow(released(weigh), "gram boolean, place long, w double, n long")
    below, inner = np.zeros((256, 256)), np.zeros((256, 256))
    # at most 2 * 65,536 rows
    for gram, place, w, n in rows.groupBy("gram", "place").agg(F.sum("w"), F.sum("n")).collect():
        if gram:
            inner[place >> 8, place & 255] = n
        else:
            below[place >> 8, place & 255] = w
    kt, p = ContextTree.estimate(inner)
    root_kt, root_p = ContextTree.estimate(inner.sum(0, keepdims=True))
    weighted, gain = ContextTree.weigh(kt, below)
    _, gain0 = ContextTree.weigh(root_kt, weighted.sum(0, keepdims=True))
    return gain0 * root_p + (1 - gain0) * gain * p, (1 - gain0) * (1 - gain)


def answered(asked: DataFrame, counts: DataFrame, depth: int) -> DataFrame:
    """chunk, cell, logp (packed) for chunk, cell, grams."""
    held = asked.sparkSession.sparkContext.broadcast(top_of(counts, depth))

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, model, known = None, None, None
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for c, chunk, key, n in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:  # a cell's model comes before its questions, if it has one
                    empty = np.zeros(0, np.uint64)
                    trained = (unpacked_keys(key), unpacked(n, np.int64)) if chunk is None else (empty, empty.astype(np.int64))
                    cell, model = c, Cell(*trained, depth)
                    known = model.logp(model.key, *held.value)
                if chunk is None:
                    continue
                key = unpacked_keys(key)
                i = np.minimum(np.searchsorted(model.key, key), max(0, len(model.key) - 1))
                hit = model.key[i] == key if len(model.key) else np.zeros(len(key), bool)
                p = np.zeros(len(key))
                p[hit] = known[i[hit]]
                p[~hit] = model.logp(key[~hit], *held.value)
                out.append((chunk, c, p.astype(np.float32).tobytes()))
            chunks, cells, ps = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(cells, pa.int64()), pa.array(ps, pa.binary())], ["chunk", "cell", "logp"])

    model = counts.where("kind = 'gram'").select(F.col("n").alias("cell"), F.lit(None).cast("long").alias("chunk"), F.col("key").alias("grams"), "counts")
    both = model.unionByName(asked.select("cell", "chunk", "grams", F.lit(None).cast("binary").alias("counts")))
    dealt = both.repartition("cell").sortWithinPartitions("cell", F.col("chunk").asc_nulls_first())
    return dealt.mapInArrow(released(answer), "chunk long, cell long, logp binary")


def summed(texts: DataFrame, answers: DataFrame, frequent: dict[bytes, float], depth: int) -> DataFrame:
    """row, doc_id, held_out, n_tokens, known, part, size, rare, score of texts (chunk, row, doc_id, held_out, text)."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)
    id_kind = texts.schema["doc_id"].dataType.simpleString()
    rare_kind = pa.list_(pa.struct([("key", pa.binary()), ("tf", pa.int64())]))
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "part", "size", "rare", "score"]

    def words(text: bytes) -> tuple[int, int, float, list[dict]]:
        known, bag = held.value, Counter(tokens(text))
        bag[END] += 1
        rest, k, s = [], 0, 0.0
        for w, tf in bag.items():
            if (lp := known.get(w)) is None:
                rest.append({"key": w, "tf": tf})
            else:
                k += tf
                s += tf * lp
        return bag.total(), k, s, rest

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, pending, size, slices, logp = None, [], [], 0, [], []

        def take() -> None:
            nonlocal rows, pending, size
            each, offsets = grams(pending, depth)
            slices.append((*encoded(each), offsets, [pa.array(c, t) for c, t in zip(zip(*rows), types)]))
            rows, pending, size = [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if pending:
                take()
            key = tallied(np.concatenate([x[0] for x in slices]))[0]
            order, _ = by_cell(key, depth)
            p = np.empty(len(key))
            p[order] = np.frombuffer(b"".join(logp), np.float32)
            for k, at, offsets, columns in slices:
                total = np.r_[0.0, np.cumsum(p[np.searchsorted(key, k)][at])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(total[offsets]))], names)

        types: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.column(i).type for i in (2, 3, 4)]  # of row, doc_id and held_out
            types = [*kinds, pa.int64(), pa.int64(), pa.float64(), pa.int64(), rare_kind]
            for c, _, row, doc_id, held_out, text, p in zip(*(x.to_pylist() for x in batch.columns)):
                if c != chunk and chunk is not None:
                    yield from done()
                    slices, logp = [], []
                chunk = c
                if p is None:
                    n, known, part, rare = words(text)
                    rows.append((row, doc_id, held_out, n, known, part, len(text) + 1, rare))
                    pending.append(text)
                    size += len(text)
                    if size >= SLICE_BYTES:
                        take()
                else:
                    logp.append(p)
        if chunk is not None:
            yield from done()

    none = lambda kind: F.lit(None).cast(kind)
    both = texts.select(
        "chunk", F.lit(-1).cast("long").alias("cell"), "row", "doc_id", "held_out", "text", none("binary").alias("logp")
    ).unionByName(
        answers.select(
            "chunk", "cell", none("long").alias("row"), none(id_kind).alias("doc_id"), none("boolean").alias("held_out"),
            none("binary").alias("text"), "logp",
        )
    )
    return both.repartition("chunk").sortWithinPartitions("chunk", "cell", "row").mapInArrow(
        released(add),
        f"row long, doc_id {id_kind}, held_out boolean, n_tokens long, known long, part double, size long, "
        "rare array<struct<key: binary, tf: long>>, score double",
    )


def score(docs: DataFrame, counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, a row for each of docs.

    docs: doc_id, text, held_out; counts: of the training texts, at the same depth.
    """
    spark = docs.sparkSession
    words = counts.where("kind = 'word'").select("key", "n")
    n_all, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = n_all + n_words + 1
    often = words.where(F.col("n") * FREQUENT >= max(1, n_all))
    frequent = {bytes(k): math.log10((n + 1) / base) for k, n in often.collect()}  # at most FREQUENT rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, text binary, chunk long, cell long, grams binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, pending, size = 0, [], 0  # the chunk's number is that of its first row
        names = ["row", "doc_id", "held_out", "text", "chunk", "cell", "grams"]

        def ask(like: pa.RecordBatch) -> pa.RecordBatch:
            key = tallied(np.concatenate(pending))[0]
            order, at = by_cell(key, depth)
            some = np.flatnonzero(np.diff(at)).tolist()
            parts = [packed_keys(key[order[at[c] : at[c + 1]]]) for c in some]
            own = {"chunk": pa.array([chunk] * len(some), pa.int64()), "cell": pa.array(some, pa.int64()), "grams": pa.array(parts, pa.binary())}
            return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(some), f.type)) for f in like.schema], names)

        out = None
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts, rows = batch.column("text").to_pylist(), batch.num_rows
                if not pending:
                    chunk = batch.column("row")[0].as_py()
                own = [batch.column(c) for c in names[:4]]
                out = pa.RecordBatch.from_arrays(
                    [*own, pa.array([chunk] * rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())], names
                )
                yield out
                pending.append(tallied(grams(texts, depth)[0])[0])
                size += sum(map(len, texts))
                if size >= CHUNK:
                    yield ask(out)
                    pending, size = [], 0
        if pending:
            yield ask(out)

    rows = docs.select("doc_id", "held_out", F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))
    chunks = stored(rows.mapInArrow(released(run), schema), "lm-chunks")
    answers = answered(chunks.where("cell IS NOT NULL").select("chunk", "cell", "grams"), counts, depth)
    seen = stored(summed(chunks.where("row IS NOT NULL"), answers, frequent, depth), "lm-scored")
    forget(chunks)
    seldom = words.where(F.col("n") * FREQUENT < max(1, n_all))
    each = seen.select("row", F.explode("rare").alias("w")).select("row", "w.*").join(seldom, "key", "left")
    n = F.coalesce("n", F.lit(0))
    sums = each.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("more"),
        F.sum(F.col("tf") * F.log10((n + 1) / F.lit(float(base)))).alias("rest"),
    )
    return seen.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / F.col("size")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    return score(docs, stored(counted(docs.where(~F.col("held_out"))), "lm-counts"))
