"""Packing of tokenized documents into sequences by first-fit decreasing.

Documents are dealt at random (by a hash of the row's number) over tasks and, inside a task, in hash order; every
``GROUP`` documents in that order form a group that is packed alone.  So a group is bounded whatever the ids and copies
are, and no task waits for another.  In a group the pieces go, longest first, into the first bin with room, which a
tournament tree over the bins' free space finds in a logarithm of steps.

A document is cut into full sequences and at most one rest; a full piece is a sequence of its own and leaves at once, so
a task holds the rests of one group: at most GROUP * LENGTH ids.

Defined cases: a null text is the end id alone; repeated rows are packed each; equal lengths keep the hash order;
an empty table gives no piece.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import released, sliced, table, text_bytes
from .tokens import WordEncoder, default_tokenizer

LENGTH, GROUP = 2048, 16_384
END = (1).to_bytes(4, "little")
PIECES = "deal long, doc_id long, start long, length long, doc_tokens long, ids binary"


class Tournament:
    """A complete binary tree over bins; each inner node has the larger free space of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and its free space before."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        before = free[at]
        free[at] = before - size
        leaf, at = at - self.leaves, at >> 1
        while at:
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at], at = best, at >> 1
        return leaf, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree = Tournament(n, capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], before = tree.place(int(lengths[i]))
        offsets[i] = capacity - before
    return bins, offsets


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Documents' ids with the end id (little-endian unsigned 32-bit), cut at multiples of the length; deal: a hash that
    the document's pieces share."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = WordEncoder(tokenizer), 4 * length
        for whole in batches:
            for batch in sliced(whole, "text"):
                rows: list[tuple] = []
                for deal, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    raw = encode(text) + END
                    rows += [(deal, doc_id, at // 4, len(raw[at : at + step]) // 4, len(raw) // 4, raw[at : at + step]) for at in range(0, len(raw), step)]
                kinds = [pa.int64()] * 5 + [pa.binary()]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["deal", "doc_id", "start", "length", "doc_tokens", "ids"])

    deal = F.xxhash64(F.monotonically_increasing_id())  # so that copies and repeated ids spread too
    rows = docs.select(deal.alias("deal"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(released(cut), PIECES)


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset (its place in the sequence)."""
    cut = pieces(docs, length, tokenizer)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids of sequences: the task's number above, a running number below
        next_id, held, n = TaskContext.get().partitionId() << 40, [], 0

        def placed(rows: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            rows = rows.drop_columns(["deal"]).append_column("sequence_id", pa.array(ids, pa.int64()))
            return rows.append_column("offset", pa.array(offsets, pa.int64()))

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            bins, offsets = first_fit_decreasing(np.concatenate([x.column("length").to_numpy() for x in held]), length)
            at = 0
            for rows in held:
                yield placed(rows, bins[at : at + rows.num_rows] + next_id, offsets[at : at + rows.num_rows])
                at += rows.num_rows
            next_id += int(bins.max()) + 1

        for batch in batches:
            full = pc.equal(batch.column("length"), length)
            whole, rests = batch.filter(full), batch.filter(pc.invert(full))
            if whole.num_rows:
                yield placed(whole, np.arange(next_id, next_id + whole.num_rows), np.zeros(whole.num_rows, np.int64))
                next_id += whole.num_rows
            while rests.num_rows:
                held.append(rests.slice(0, GROUP - n))
                n += held[-1].num_rows
                rests = rests.slice(held[-1].num_rows)
                if n == GROUP:
                    yield from packed()
                    held, n = [], 0
        if held:
            yield from packed()

    dealt = cut.repartition("deal").sortWithinPartitions("deal", "doc_id", "start")
    return dealt.mapInArrow(released(deal), PIECES.removeprefix("deal long, ") + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
