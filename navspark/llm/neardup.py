"""Near-duplicate classes: DartMinHash signatures of weighted word shingles in a banded join, verified exactly.

Texts are their words (A-Z lower-cased, digits, letters); five words in a row are a shingle with the number of its
places as weight; texts of one to four words are one shingle.  Two texts are linked if their weighted Jaccard similarity
is at least ``SIMILARITY``; classes are the connected components.

1. Equal texts (by md5 of their words) are one node from here on; each gets a signature of BANDS * ROWS coordinates.
2. Texts that share a band are candidates.  A bucket is a star around its smallest node, so its rows are linear in its
   size.  The stars of one centre are a group: it holds every pair that shares a bucket with that centre.
3. A group of up to ``BLOCK`` texts is compared in one task.  A larger one is cut into blocks, each with the centre
   beside it.  Components of the links so far then tell which texts of a large group still stand outside its largest
   component; only these meet the group's other blocks, so a group of copies costs rows in proportion to its size.
   A group with more than ``WIDE`` blocks outside, one without a main class, is narrowed first: similar texts share an item
   among the first fifth of their items in any one order of all items, here rarest first (``narrowed``), so its members meet
   only where they share such an item.  Both ways are exact.  Every candidate pair in different components is compared; no pair is emitted but links of a spanning forest.
4. Components of all links are the classes.

A pair at similarity s shares no band with probability (1 - s^ROWS)^BANDS: 6e-5 at 0.8, nothing at 0.9.

Defined cases: texts without words (null too) are alone, each row; repeated rows share a class; the class id is the
smallest doc_id in it (null only if all are); an empty table gives no row; of rows with one id and the same words
``deduplicate`` keeps the one with the smallest text (by bytes; then by a hash of the whole row); input columns pass
through it, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BITS, WORD_BYTES, bitmap, carried, forget, likely, mix64, released, sliced, stored, table, text_bytes
from .components import components
from .dart import signatures

SHINGLE, SIMILARITY, BANDS, ROWS, BLOCK = 5, 0.8, 32, 6, 512
SLICE = 1 << 18
#: A group with more than WIDE blocks outside its main class is narrowed; up to there all against all costs 2 * WIDE rows a
#: member at most, about what narrowing costs.
WIDE = 16
#: Counts of items in large groups are kept in 2**COUNT_BITS places.
COUNT_BITS = 20
#: A key with 1 / HOT of all rows or more is joined by broadcast: there are at most HOT of them.
HOT = 4096


def key_of(text: bytes) -> tuple[bytes | None, list[bytes]]:
    words = text.translate(WORD_BYTES).split()
    return (hashlib.md5(b" ".join(words)).digest() if words else None), words


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Hashes that do not differ between processes; known keeps those of frequent words."""
    if len(known) > 100_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        out = mix64(out * np.uint64(3) + h[j : j + n])
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, bands (hashes; null without words)."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                keys, elements, weights, sizes = [], [], [], []
                for text in batch.column("text").to_pylist():
                    key, words = key_of(text)
                    keys.append(key)
                    if key:
                        e, w = np.unique(shingles(word_hashes(words, known)), return_counts=True)
                        elements.append(e)
                        weights.append(w)
                        sizes.append(len(e))
                bands: list[np.ndarray | None] = [None] * len(keys)
                if sizes:
                    sig = signatures(
                        np.concatenate(elements), np.concatenate(weights).astype(float), np.array(sizes), BANDS * ROWS
                    ).reshape(len(sizes), BANDS, ROWS)
                    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
                    for j in range(ROWS):
                        h = mix64(h * np.uint64(3) + sig[:, :, j])
                    rows = iter(h.view(np.int64))
                    bands = [next(rows) if k else None for k in keys]
                cols = [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(released(sign), f"doc_id {kind}, key binary, bands array<long>")


def with_key(docs: DataFrame) -> DataFrame:
    """row, key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(t.as_py())[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(keys, pa.binary())], ["row", "key"])

    rows = carried(docs)
    return rows.mapInArrow(released(run), T.StructType([rows.schema["row"], T.StructField("key", T.BinaryType())]))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored key, items: sorted hashes of (shingle, number of its place), of one document for each wanted key.

    One pass over the texts: a bitmap of fixed size leaves out most keys that are not wanted, the join the others.
    """
    first_bits = (F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") / (1 << 32 - BITS)).cast("long")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, first_bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        bits = held.value
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                keys, items = [], []
                for text in batch.column("text").to_pylist():
                    key, words = key_of(text)
                    if key:
                        at = int.from_bytes(key[:4], "big") >> 32 - BITS
                        if bits[at >> 3] >> (at & 7) & 1:
                            s = np.sort(shingles(word_hashes(words, known)))
                            place = np.arange(len(s))
                            nth = place - np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], place, 0))
                            hashes = mix64(s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                            keys.append(key)
                            items.append(np.sort(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["key", "items"]
                )

    found = docs.select(text_bytes().alias("text")).mapInArrow(released(run), "key binary, items array<long>")
    out = stored(found.join(wanted, "key").groupBy("key").agg(F.first("items").alias("items")), "neardup-sets")
    held.destroy()
    return out


def linked(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links in a group (key, items, side): those of rows of side 0 to rows of side 0 and 1."""
    n, out = len(group), []
    items, keys, side = [np.asarray(x, np.int64) for x in group["items"]], group["key"].tolist(), group["side"].to_numpy()
    sizes = np.array([len(x) for x in items])
    codes = np.unique(np.concatenate(items), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)]
    mark, label = np.zeros(int(codes.max()) + 1, bool), np.arange(n)
    order = np.lexsort((group["key"].to_numpy(), side))
    for i, x in enumerate(order.tolist()):
        if side[x]:
            break
        others = order[i + 1 :]
        low, high = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[(label[others] != label[x]) & (low >= SIMILARITY * high)]
        if not len(others):
            continue
        mark[codes[starts[x] : starts[x + 1]]] = True
        there = np.concatenate([codes[starts[y] : starts[y + 1]] for y in others.tolist()])
        common = np.add.reduceat(mark[there], np.r_[0, np.cumsum(sizes[others])[:-1]], dtype=np.int64)
        mark[codes[starts[x] : starts[x + 1]]] = False
        for y in others[common >= SIMILARITY * (sizes[x] + sizes[others] - common)].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((keys[x], keys[y]))
    return pd.DataFrame(out, columns=["a", "b"])


def compared(sets: DataFrame, dealt: DataFrame) -> DataFrame:
    """Links (a, b) inside the groups of dealt (centre, i, j, key, side)."""
    return sets.join(dealt, "key").groupBy("centre", "i", "j").applyInPandas(linked, "a binary, b binary")


def groups_of(texts: DataFrame) -> DataFrame:
    """centre, key, blocks: the members of each centre's group, the centre among them."""
    bands = texts.select("key", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("key").alias("centre"), F.max("key").alias("z")).where("centre != z")
    stars = bands.join(buckets.select("band", "centre"), "band").where("key != centre").select("centre", "key").distinct()
    stars = stored(stars, "neardup-stars")
    sizes = stars.groupBy("centre").agg(F.ceil((F.count("*") + 1) / BLOCK).cast("int").alias("blocks"))
    members = stars.join(sizes, "centre").unionByName(sizes.select("centre", F.col("centre").alias("key"), "blocks"))
    members = stored(members, "neardup-groups")
    forget(stars)
    return members


def place_of(items: np.ndarray, centre: bytes) -> np.ndarray:
    """Where a group's items are counted, of 2**COUNT_BITS places."""
    salt = np.uint64(int.from_bytes(centre[:8], "little"))
    return (mix64(items.view(np.uint64) ^ salt) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def rarest(items: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of a text's items the first by (often, item), as many as two texts of SIMILARITY must share one of: a text of n
    items has ceil(n * SIMILARITY) in common with one so similar."""
    n = len(items) - math.ceil(SIMILARITY * len(items) - 1e-9) + 1
    return items[np.lexsort((items, often))[:n]]


def narrowed(sets: DataFrame, hard: DataFrame) -> DataFrame:
    """The members of large groups (centre, key, outside) dealt to groups of their own by centre and item: one for each
    item that a member outside the main class and another member have among their rarest.

    How often an item stands in a group is counted in a table of fixed size; items that meet there by chance only look
    more frequent, which changes an order that may be any.
    """
    members = stored(sets.join(hard, "key").select("centre", "key", "outside", "items"), "neardup-narrowed")

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, bool, np.ndarray]]:
        for i in range(batch.num_rows):
            centre, key, outside, items = (batch.column(c)[i] for c in range(4))
            yield centre.as_py(), key.as_py(), outside.as_py(), items.values.to_numpy(zero_copy_only=False)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for centre, _, _, items in rows_of(batch):
                np.add.at(sums, place_of(items, centre), 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["place", "n"])

    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for place, n in members.mapInArrow(released(count), "place long, n long").groupBy("place").agg(F.sum("n")).toLocalIterator():
        counts[place] = n
    held = hard.sparkSession.sparkContext.broadcast(counts)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, keys, sides = [], [], []
            for centre, key, outside, items in rows_of(batch):
                some = rarest(items, held.value[place_of(items, centre)])
                centres += [centre + x.tobytes() for x in some]
                keys += [key] * len(some)
                sides += [outside] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(centres, pa.binary()), pa.array(keys, pa.binary()), pa.array(sides, pa.bool_())], ["centre", "key", "outside"])

    dealt = stored(members.mapInArrow(released(deal), "centre binary, key binary, outside boolean"), "neardup-dealt")
    held.destroy()
    forget(members)
    sizes = dealt.groupBy("centre").agg(F.count("*").alias("all"), F.count_if("outside").alias("out")).where("all > 1 and out > 0")
    sizes = sizes.select("centre", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(name) for c, name in (("all", "blocks"), ("out", "parts"))])
    return dealt.join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))


def crossed(groups: DataFrame) -> DataFrame:
    """(centre, i, j, key, side) by which members outside of groups (centre, key, outside, block, blocks, parts) meet all
    members."""
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = groups.where("outside").select("centre", "key", part.alias("i"), numbers("blocks").alias("j"), F.lit(0).alias("side"))
    # in a group of one block those outside meet each other as they are
    others = groups.where("not outside or blocks > 1").select("centre", "key", numbers("parts").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    return first.unionByName(others)


def classes_of(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """key, class (the smallest key of the class), for texts (key, bands) that have a link to a different text."""
    members = groups_of(texts)
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = members.withColumn("block", block)
    first = placed.where("key != centre or blocks = 1").select("centre", "key", F.col("block").alias("i"))
    centres = placed.where("key = centre and blocks > 1").select(
        "centre", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    )
    dealt = first.unionByName(centres).withColumns({"j": F.col("i"), "side": F.lit(0)})
    sets = shingle_sets(docs, members.select("key").distinct())
    links = stored(compared(sets, dealt), "neardup-links")
    classes = components(links)
    large = placed.where("blocks > 1")
    # of each large group: the members outside its largest component meet all blocks
    labelled = large.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    labelled = stored(labelled, "neardup-large")
    by_label = labelled.groupBy("centre", "label").agg(F.count("*").alias("n"))
    main = by_label.groupBy("centre").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.where("all > most").withColumn("parts", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
    left = labelled.join(main.select("centre", "main", "parts"), "centre").withColumn("outside", F.col("label") != F.col("main"))
    left = left.select("centre", "key", "outside", "block", "blocks", "parts")
    hard = stored(left.where(F.col("parts") > WIDE).select("centre", "key", "outside"), "neardup-hard")
    late = crossed(left.where(F.col("parts") <= WIDE))
    if not hard.isEmpty():
        late = late.unionByName(crossed(narrowed(sets, hard)))
    late = stored(compared(sets, late).where("a != b"), "neardup-links")
    if not late.isEmpty():
        forget(classes)
        classes = components(links.unionByName(late))
    forget(members, sets, labelled, hard, links, late)
    return classes.withColumnsRenamed({"node": "key", "label": "class"})


def by_key(rows: DataFrame, keyed: DataFrame, total: int) -> DataFrame:
    """rows left-joined with keyed (key, rows_of, ...) by key.  Keys that hold 1 / HOT of all rows or more, at most HOT,
    are broadcast; in the exchange for the others no key is hot."""
    hot = F.col("rows_of") * HOT >= F.lit(total)
    few, many = F.broadcast(keyed.where(hot)), keyed.where(~hot)
    return rows.join(few, "key").unionByName(rows.join(few.select("key"), "key", "left_anti").join(many, "key", "left"))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Stored rows (doc_id, key), keys with their class (key, rows_of, class, class_size, class_id), the number of rows."""
    seen = stored(signed(docs), "neardup-signed")
    texts = seen.where("key is not null").groupBy("key").agg(
        F.first("bands").alias("bands"), F.count("*").alias("rows_of"), F.min("doc_id").alias("least")
    )
    texts = stored(texts, "neardup-texts")
    keyed = texts.drop("bands").join(classes_of(texts, docs), "key", "left").withColumn("class", F.coalesce("class", "key"))
    keyed = stored(keyed, "neardup-keyed")
    rows = stored(seen.select("doc_id", "key"), "neardup-rows")
    total = rows.count()
    heads = keyed.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("rows_of").alias("class_size"))
    heads = stored(heads.where("class_size > 1"), "neardup-class-heads")
    # as in by_key: the largest classes, at most HOT, are broadcast
    hot = F.col("class_size") * HOT >= F.lit(total)
    few, many = F.broadcast(heads.where(hot)), heads.where(~hot)
    rest = keyed.join(few.select("class"), "class", "left_anti")
    out = stored(keyed.join(few, "class").unionByName(rest.join(many, "class")), "neardup-classes")
    forget(seen, texts, keyed, heads)
    return rows, out, total


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, a row for each of docs."""
    rows, keyed, total = placed(docs)
    named = by_key(rows.where("key is not null"), keyed, total).unionByName(rows.where("key is null"), allowMissingColumns=True)
    alone = F.col("class").isNull()
    return named.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without those that have a document with a smaller id, or an equal one before, in their class.

    Documents that are alone in their class are kept where they are; only others are joined with the classes' heads.
    """
    rows, keyed, total = placed(docs)
    # the head's words: the smallest key among the texts with the class's id
    shared = by_key(rows.where("key is not null"), keyed, total).where("class is not null")
    heads = shared.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("key").alias("head_key"))
    heads = stored(heads, "neardup-heads")
    ids = shared.groupBy("doc_id", "key").agg(F.first("class").alias("class"), F.first("class_id").alias("class_id"), F.count("*").alias("n"))
    ids = ids.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "key", "n", F.lit(True).alias("gone")).unionByName(
        ids.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).join(heads, "class").select("doc_id", "key", "n", (F.col("key") != F.col("head_key")).alias("gone"))
    )
    # rows that go, and heads that stand there more than once; every other row stays where it is
    special = stored(ids.where("gone or n > 1"), "neardup-special")
    some, rest = likely(
        with_key(docs), F.xxhash64("row.doc_id", "key"), special.select(F.xxhash64("doc_id", "key").alias("h")), "h", F.col("key").isNotNull()
    )
    gone = special.where("gone").select(F.col("doc_id").alias("id"), F.col("key").alias("gone_key"))
    kept = some.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    # repeats of a head, and rows let through by chance, which are alone with their id and key
    once = kept.groupBy(F.col("row.doc_id").alias("id"), "key").agg(
        F.min_by("row", F.struct(F.col("row.text").cast("binary"), F.xxhash64("row"))).alias("row")
    )
    return rest.select("row.*").unionByName(once.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
