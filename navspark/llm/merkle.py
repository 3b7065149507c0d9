"""A Merkle manifest of a dataset by Pregel-style supersteps over RDDs.

Each row is a leaf, the sha256 of its columns.  A tree of every language has its leaves in ascending order of doc_id and at
most FAN children a vertex; the languages' roots are the leaves of one more tree, whose root names the dataset.

Ranks come from one range partitioning by (group, order): only a partition's first and last group can go on in
others, so the driver adds up two numbers a partition, and a language with any share of the rows is many tasks.  A tree
grows by supersteps: the vertices of a level send their digests to their parents, a parent that has as many messages as
children (which the group's size tells) hashes them and goes on to the next level; a group with one vertex left has
found its root.  The way down reverses this: a vertex that knows the path above it sends each child that path with the
digests of the child's siblings, until it reaches the leaves.  A superstep joins a level with messages of one level, at
most FAN a key, and each level is written to the shared folder before the next, so a lost executor costs one superstep.
Leaves travel inside their parents (families), so that paths are exchanged once a family and not once a leaf.

Levels shrink eightfold, and so do the tasks and files that hold them: a task takes at most VERTICES of their vertices.

Digests are raw bytes inside and hexadecimal text in hashes and results.

Defined cases: a null column counts as ``-``; null languages are a group of their own, the first; null ids come first in their
group; rows with one id are ordered by their digests, and equal rows are interchangeable, so ties change no result; a
group of one row has that leaf as its root; an empty table has no rows and no root.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import RDD, SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fold, new_path, shared_dir, stored, table

FAN, VERTICES = 8, 20_000
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: (place among its siblings, their digests from left to right) of each level above a leaf, from the lowest.
Path = tuple[tuple[int, tuple[bytes, ...]], ...]


def h(*inputs: bytes) -> bytes:
    """sha256 of digests, each as its hexadecimal text."""
    return hashlib.sha256(b"".join(x.hex().encode() for x in inputs)).digest()


def field_bytes(c: Column) -> Column:
    """``-`` for null, else the number of the value's UTF-8 bytes, a colon and the value."""
    value = c.cast("string").cast("binary")
    sized = F.concat(F.octet_length(value).cast("string").cast("binary"), F.lit(b":"), value)
    return F.coalesce(sized, F.lit(b"-"))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row, with another text if given."""
    values = [text if c == "text" and text is not None else docs[c] for c in COLUMNS]
    return F.unhex(F.sha2(F.concat(*[field_bytes(v) for v in values]), 256))


def fold_path(digest: bytes, path: Path) -> bytes:
    """The root that a leaf's digest and its path lead to."""
    for place, siblings in path:
        digest = h(*siblings[:place], digest, *siblings[place:])
    return digest


@dataclass
class Shelf:
    """RDDs written to the shared folder, to be deleted together."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)

    def put(self, rdd: RDD, rows: int | None = None) -> RDD:
        """rows: at most how many the RDD has, if known."""
        path = new_path(self.spark, "merkle")
        most = rdd.getNumPartitions() if rows is None else max(1, -(-rows // VERTICES))
        (rdd.coalesce(most) if most < rdd.getNumPartitions() else rdd).saveAsPickleFile(path)
        self.paths.append(path)
        return self.spark.sparkContext.pickleFile(path)

    def clear(self) -> None:
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


@dataclass
class Ranked:
    """rows: (group, place in the group from 0, size of the group, value); the largest size; rows and groups in all."""

    rows: RDD
    largest: int
    total: int
    groups: int


def ranked(sc: SparkContext, rows: RDD, parts: int) -> Ranked:
    """((group, order), value) rows ranked in their groups."""
    ordered = rows.sortByKey(numPartitions=parts)

    def ends(k: int, part: Iterable) -> Iterator[tuple]:
        first = last = None
        n = head = most = total = groups = 0
        for (group, _), _ in part:
            total += 1
            if first is None:
                first = last = group
                groups = 1
            if group != last:
                head, most, last, n = head if last != first else n, max(most, n), group, 0
                groups += 1
            n += 1
        if first is not None:
            yield k, first, head if last != first else n, last, n, max(most, n), total, groups

    before: dict[int, int] = {}
    sizes: dict = {}
    largest = total = groups = 0
    for k, first, head, last, tail, most, n, m in sorted(ordered.mapPartitionsWithIndex(ends).collect()):
        before[k] = sizes.get(first, 0)
        sizes[first] = before[k] + head
        if last != first:
            sizes[last] = tail
        largest, total, groups = max(largest, most, sizes[first]), total + n, groups + m
    known = sc.broadcast((before, sizes))  # two numbers and a group a partition

    def place(k: int, part: Iterable) -> Iterator[tuple]:
        before, sizes = known.value
        run: list = []
        group, at = None, None
        for (g, _), value in part:
            if at is None or g != group:
                yield from ((group, i, len(run), v) for i, v in enumerate(run))
                group, run, at = g, [], before[k] if at is None else 0
            if g in sizes:
                yield g, at, sizes[g], value
            else:  # a group inside one partition, whose size is known at its end
                run.append(value)
            at += 1
        yield from ((group, i, len(run), v) for i, v in enumerate(run))

    return Ranked(ordered.mapPartitionsWithIndex(place), largest, total, groups)


def messages(vertex: tuple) -> tuple:
    """A vertex (group, place, vertices of its level, value) to (its parent, (place there, level's size, value))."""
    group, at, size, value = vertex
    return (group, at // FAN), (at % FAN, size, value)


@dataclass
class Tree:
    """families: ((group, place), (digest, size, leaves)) of the lowest level, leaves as (digest, value); levels: ((group,
    place), (digest, size, children)) of each level above; roots: (group, (height, digest)), height 0 for families."""

    families: RDD
    levels: list[RDD]
    roots: RDD
    total: int
    groups: int

    def vertices(self, level: int) -> int:
        """At most how many vertices a level has; families are level 0."""
        return self.total // FAN ** (level + 1) + self.groups


def complete(received: Iterable[tuple], at: int) -> tuple[int, list]:
    """The size of a parent's level and what its children sent, in their order."""
    sent = sorted(received, key=lambda m: m[0])
    size = sent[0][1]
    if len(sent) != min(FAN, size - FAN * at):
        raise ValueError(f"{len(sent)} children of vertex {at} on a level over {size}")
    return -(-size // FAN), [m[2] for m in sent]


def grow(shelf: Shelf, ranks: Ranked, parts: int) -> Tree:
    """The trees of all groups of ranked rows with values (digest, anything)."""

    def family(key: tuple, received: Iterable) -> tuple:
        alone = (received := list(received))[0][1] == 1
        size, leaves = complete(received, key[1])
        return key, (leaves[0][0] if alone else h(*[x[0] for x in leaves]), size, leaves)

    def parent(key: tuple, received: Iterable) -> tuple:
        size, children = complete(received, key[1])
        return key, (h(*children), size, children)

    families = shelf.put(ranks.rows.map(messages).groupByKey(parts).map(lambda x: family(*x)))
    tree = Tree(families, [], families, ranks.total, ranks.groups)
    level, roots, largest = families, [], -(-ranks.largest // FAN)
    while True:
        height = len(tree.levels)
        roots.append(level.filter(lambda v: v[1][1] == 1).map(lambda v, height=height: (v[0][0], (height, v[1][0]))))
        if largest <= 1:
            tree.roots = shelf.put(families.context.union(roots), ranks.groups)
            return tree
        on = level.filter(lambda v: v[1][1] > 1).map(lambda v: messages((*v[0], v[1][1], v[1][0])))
        level = shelf.put(on.groupByKey(parts).map(lambda x: parent(*x)), tree.vertices(height + 1))
        tree.levels.append(level)
        largest = -(-largest // FAN)


def siblings(children: list[bytes], at: int) -> tuple[int, tuple[bytes, ...]]:
    return at, tuple(children[:at] + children[at + 1 :])


def descend(shelf: Shelf, tree: Tree, seeds: RDD, parts: int) -> RDD:
    """(leaf's value, leaf's digest, seed's value, path to the top) of all leaves.

    seeds: (group, (height of its root, value, path above its root)).
    """

    def send(vertex: tuple) -> Iterator[tuple]:
        (group, at), ((_, _, children), (value, path)) = vertex
        for k in range(len(children)):
            yield (group, at * FAN + k), (value, (siblings(children, k), *path))

    def deliver(family: tuple) -> Iterator[tuple]:
        _, ((top, _, leaves), (value, path)) = family
        digests = [x[0] for x in leaves]
        for k, (digest, own) in enumerate(leaves):
            # a group of one row is not hashed, so nothing lies between it and its root
            yield own, digest, value, path if digest == top else (siblings(digests, k), *path)

    def entering(height: int) -> RDD:
        return seeds.filter(lambda s: s[1][0] == height).map(lambda s: ((s[0], 0), s[1][1:]))

    below = None
    for height in range(len(tree.levels), 0, -1):
        told = entering(height) if below is None else entering(height).union(below)
        below = shelf.put(tree.levels[height - 1].join(told, parts).flatMap(send), tree.vertices(height - 1))
    told = entering(0) if below is None else entering(0).union(below)
    return tree.families.join(told, parts).flatMap(deliver)


@dataclass
class Manifest:
    """root: the dataset's; paths: ((doc_id, presented digest), leaf, (subroot, root), path) of each row; both read what lies
    on the shelf, which the caller clears once they are used."""

    root: bytes | None
    paths: RDD
    shelf: Shelf


def manifest(docs: DataFrame, presented: Column | None = None) -> Manifest:
    """The tree over docs.  presented: the text to check a row with; where it is null, the row's own counts."""
    spark = docs.sparkSession
    shared_dir(spark)
    shelf, sc = Shelf(spark), spark.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shown = leaf(docs) if presented is None else F.when(presented.isNull(), leaf(docs)).otherwise(leaf(docs, presented))
    digests = stored(docs.select(docs["lang"].alias("lang"), docs["doc_id"].alias("id"), leaf(docs).alias("leaf"), shown.alias("shown")), "merkle-leaves")
    shelf.paths.append(digests.stored_path)

    def keyed(row: tuple) -> tuple:
        lang, id_, digest, shown = row
        digest, shown = bytes(digest), bytes(shown)
        group = "" if lang is None else f"={lang}"
        return (group, (id_ is not None, id_ or 0, digest)), (digest, (id_, shown if shown != digest else None))

    ranks = ranked(sc, digests.rdd.map(keyed), parts)
    if not ranks.total:
        return Manifest(None, sc.emptyRDD(), shelf)
    tree = grow(shelf, ranks, parts)
    tops = tree.roots.map(lambda r: (("", r[0]), (r[1][1], (r[0], r[1][0]))))
    few = tree.roots.getNumPartitions()
    top = grow(shelf, ranked(sc, tops, few), few)
    group, (height, root) = top.roots.first()
    heads = descend(shelf, top, sc.parallelize([(group, (height, root, ()))], 1), few)
    seeds = shelf.put(heads.map(lambda x: (x[0][0], (x[0][1], (x[1], x[2]), x[3]))), ranks.groups)
    return Manifest(root, descend(shelf, tree, seeds, parts), shelf)


def proofs(made: Manifest, spark: SparkSession) -> DataFrame:
    """doc_id, leaf, subroot, root, path: what a holder of one row needs to check it, lazily."""

    def row(x: tuple) -> tuple:
        (id_, _), digest, (subroot, root), path = x
        steps = [(place, [s.hex() for s in others]) for place, others in path]
        return id_, digest.hex(), subroot.hex(), root.hex(), steps

    schema = "doc_id long, leaf string, subroot string, root string, path array<struct<place: int, siblings: array<string>>>"
    return spark.createDataFrame(made.paths.map(row), schema, verifySchema=False)


def checked(made: Manifest, spark: SparkSession) -> DataFrame:
    """Each row's digests, its proof's digest, the root that the presented digest leads to, and whether that is the root."""

    def row(x: tuple) -> tuple:
        (id_, shown), digest, (subroot, root), path = x
        found = fold_path(shown or digest, path)
        proof = h(*[s for _, others in path for s in others])
        return id_, digest.hex(), subroot.hex(), root.hex(), proof.hex(), found.hex(), found == root

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(made.paths.map(row), schema, verifySchema=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = manifest(docs, F.when(fold("doc_id", 3) == 0, ascii_lower(F.col("text"))))
    out = stored(checked(made, spark), "merkle-checked")
    made.shelf.clear()
    return out


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _levels(name: str, n: int) -> str:
    """CTEs from {name}_0 (grp, place, h, item, folded, proof) to {name}_n, a tree's levels followed for each item, and {name}_root."""
    out = []
    for k in range(n):
        out.append(f"""{name}_v{k} AS (SELECT grp, place, any_value(h) AS h FROM {name}_{k} GROUP BY grp, place),
{name}_c{k} AS (SELECT grp, place // {FAN} AS up, list(h ORDER BY place) AS hs, max(n) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}_v{k}) GROUP BY grp, place // {FAN}),
{name}_{k + 1} AS (SELECT i.grp, i.item, CASE WHEN n = 1 THEN i.place ELSE c.up END AS place,
    CASE WHEN n = 1 THEN i.h ELSE sha256(array_to_string(hs, '')) END AS h,
    CASE WHEN n = 1 THEN folded ELSE sha256(array_to_string(hs[1:place % {FAN}], '') || folded
        || array_to_string(hs[place % {FAN} + 2:], '')) END AS folded,
    CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[1:place % {FAN}], '') || array_to_string(hs[place % {FAN} + 2:], '')
        END AS proof
    FROM {name}_{k} i JOIN {name}_c{k} c ON i.grp = c.grp AND i.place // {FAN} = c.up)""")
    return ",\n".join(out)


def oracle_sql(levels: int = 8) -> str:
    """For at most FAN ** levels rows a language; crc32 by its table of 256 remainders."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    row = " || ".join(_field(c) for c in COLUMNS)
    shown = row.replace("(text AS", f"({lower} AS")
    return f"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS item, doc_id, coalesce('=' || lang, '') AS grp, sha256({row}) AS leaf,
    CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''),
        lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0
        THEN sha256({shown}) ELSE sha256({row}) END AS shown FROM documents, crc),
leaf_0 AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS h,
    shown AS folded, '' AS proof FROM docs),
{_levels("leaf", levels)},
top_0 AS (SELECT item, '' AS grp, dense_rank() OVER (ORDER BY grp) - 1 AS place, h, folded, proof FROM leaf_{levels}),
{_levels("top", 4)}
SELECT doc_id, leaf, l.h AS subroot, t.h AS root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root,
    t.folded = t.h AS verified
FROM docs JOIN leaf_{levels} l USING (item) JOIN top_4 t USING (item)"""
