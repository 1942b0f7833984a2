"""A Merkle manifest of a dataset, with proofs made by octopus multiproofs.

Every row is a leaf: the SHA-256 of its columns, each written as ``-`` if null and else as its number of UTF-8 bytes, a colon and its
value. The leaves of a group, in order of id, form a tree in which every ``FANOUT`` consecutive nodes have the digest of their
digests (hex text, joined) as parent; the last run may be shorter. The groups' roots, in order of group (null first, bytewise), form
another tree, whose root stands for the dataset. A lone node is its own root.

Leaves are numbered by a range sort and sums per partition, and trees grow ``LEVELS`` levels per round inside blocks of
``FANOUT ** LEVELS`` aligned leaves, so neither a giant group nor many groups end up in one task.

To prove leaves, each leaf partition (such a block) works out the smallest set of nodes that it cannot derive from its own wanted
leaves, on every level up to the dataset's root. Those coordinates are fetched once for the whole partition; shared
interior nodes are derived once, and the proof of each leaf is expanded from them where it lies.

Null ids come first in their group; rows with equal ids are ordered by leaf. No rows: no root and no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import key_runs, landed, record_batch, schema, tasks

FANOUT = 8
LEVELS = 4  # of a block; 4096 leaves
BLOCK = FANOUT**LEVELS
TOP = -1  # the tree over the groups' roots
NODES = schema("tree long, level int, place long, digest string, width long")
WANTED = schema("for_tree long, for_block long, tree long, level int, place long")
PROOFS = schema("id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, siblings string")


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The leaf of a row from its columns, in this order."""

    def written(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[written(c) for c in columns]), 256)


@dataclass(frozen=True)
class Manifest:
    """Stored tables of a dataset's trees.

    ``leaves``: ``tree, place, id, digest`` and carried columns; ``nodes``: ``tree, level, place, digest, width`` of every
    node above the leaves and of the whole tree ``TOP``; ``trees``: ``tree, group, n``. ``width`` is the number of nodes on a level.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int

    def root(self) -> str | None:
        """The digest of the dataset."""
        top = self.nodes.filter((F.col("tree") == TOP) & (F.col("width") == 1)).first()
        return top["digest"] if top else None


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``group, id, digest, salt, ..``) with ``tree`` and ``place``, and the trees."""
    order = ["group", "id", "digest", "salt"]  # the salt lets the border between two tasks fall among equal rows
    dealt = rows.repartitionByRange(tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    dealt = dealt.select("*", F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("at"))
    dealt = landed(dealt, "merkle-sorted")
    own = dealt.groupBy("part", "group").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first_at"))
    own = landed(own, "merkle-segments")  # a row per partition and group that meet
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    # Groups are numbered in order: those that begin in earlier partitions first, then by rank inside one.
    groups = own.groupBy("group").agg(F.min("part").alias("part"), F.sum("rows").alias("n"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("group"))
    begun = groups.groupBy("part").agg(F.count(F.lit(1)).alias("begun"))
    earlier = F.sum("begun").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    begun = begun.select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    trees = groups.withColumn("rank", rank).join(begun, "part")
    trees = landed(trees.select((F.col("earlier") + F.col("rank") - 1).alias("tree"), "group", "n"), "merkle-trees")
    segments = own.join(trees.withColumnRenamed("group", "g"), F.col("group").eqNullSafe(F.col("g")))
    segments = segments.select(F.col("part").alias("p"), "g", "tree", "n", (F.col("start") - F.col("first_at")).alias("shift"))
    here = (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g"))
    placed = dealt.join(segments, here).withColumn("place", F.col("at") + F.col("shift"))
    return placed.drop("part", "at", "p", "g", "shift", "salt"), trees


def parents(digests: list[str]) -> list[str]:
    return [_h("".join(digests[i : i + FANOUT])) for i in range(0, len(digests), FANOUT)]


def _grown(level: int):
    """Blocks of nodes on ``level`` (``tree, block, place, digest, width``, sorted) grown ``LEVELS`` levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in key_runs(batches, "tree", "block"):
            tree, start, width = (block.column(c)[0].as_py() for c in ("tree", "place", "width"))
            digests = block.column("digest").to_pylist()
            for up in range(1, LEVELS + 1):
                if width == 1:
                    break
                digests, start, width = parents(digests), start // FANOUT, -(-width // FANOUT)
                n = len(digests)
                yield record_batch(NODES, [[tree] * n, [level + up] * n, list(range(start, start + n)), digests, [width] * n])

    return run


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """All nodes above ``nodes`` (``tree, place, digest, width``, level 0), some levels at a time."""
    out, level = [], 0
    while True:
        dealt = nodes.select("tree", F.expr(f"place div {BLOCK}").alias("block"), "place", "digest", "width")
        dealt = dealt.filter("width > 1").repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        grown = landed(dealt.mapInArrow(_grown(level), NODES), "merkle-nodes")
        out.append(grown)
        level += LEVELS
        nodes = grown.filter((F.col("level") == level) & (F.col("width") > 1))
        if not nodes.head(1):
            return out


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def build(rows: DataFrame, leaf: Column, group_col: str, id_col: str, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows``; ``carry`` names further columns to keep beside each leaf."""
    narrow = rows.select(
        F.col(group_col).cast("string").alias("group"),
        F.col(id_col).cast("long").alias("id"),
        leaf.alias("digest"),
        *[c.alias(name) for name, c in (carry or {}).items()],
        F.monotonically_increasing_id().alias("salt"),
    )
    placed, trees = _numbered(landed(narrow, "merkle-leaves"))
    leaves = landed(placed, "merkle-placed")
    n_trees = trees.count()
    grown = _grow(leaves.select("tree", "place", "digest", F.col("n").alias("width")))
    lone = leaves.filter("n = 1").select("tree", "digest")
    subroots = _union([lone, *[g.filter("width = 1").select("tree", "digest") for g in grown]])
    base = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), "digest")
    base = landed(base.withColumn("width", F.lit(n_trees).cast("long")), "merkle-subroots")
    return Manifest(leaves, _union([*grown, base, *_grow(base)]), trees, n_trees)


def missing_nodes(places: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """Per level of a tree of ``width`` leaves, the nodes needed to reach its root that do not follow from the leaves at ``places``."""
    out, level, known = [], 0, np.unique(places)
    while width > 1:
        above = np.unique(known // FANOUT)
        children = (above[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        out.append((level, np.setdiff1d(children[children < width], known, assume_unique=True)))
        known, width, level = above, -(-width // FANOUT), level + 1
    return out


def _coordinates(n_trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_runs(batches, "tree", "block"):
            tree, block, width = (part.column(c)[0].as_py() for c in ("tree", "block", "n"))
            needed = [(tree, *x) for x in missing_nodes(part.column("place").to_numpy(), width)]
            needed += [(TOP, *x) for x in missing_nodes(np.array([tree]), n_trees)]
            for of, level, places in needed:
                n = len(places)
                yield record_batch(WANTED, [[tree] * n, [block] * n, [of] * n, [level] * n, places])

    return run


class Partition:
    """The nodes one leaf partition knows: its own leaves, what was fetched, and all that follows."""

    def __init__(self, tree: int, width: int, n_trees: int, fetched: dict[tuple[int, int, int], str], leaves: dict[int, str]):
        self.tree = tree
        self.runs: list[dict[int, list[str]]] = []  # per step of the way up: parent's place to its children's digests
        self.shared: dict[tuple[int, int], str] = {}
        known = dict(leaves)
        for of, start, count in ((tree, None, width), (TOP, tree, n_trees)):
            if start is not None:
                known = {start: self.subroot}
            level = 0
            while count > 1:
                runs = {}
                for above in {p // FANOUT for p in known}:
                    children = range(above * FANOUT, min(count, (above + 1) * FANOUT))
                    runs[above] = [known[c] if c in known else fetched[of, level, c] for c in children]
                self.runs.append(runs)
                known = {p: _h("".join(run)) for p, run in runs.items()}
                count, level = -(-count // FANOUT), level + 1
            (top,) = known.values()
            if start is None:
                self.subroot, self.height = top, len(self.runs)
        self.root = top

    def _onward(self, step: int, place: int) -> int:
        return self.tree if step == self.height else place

    def siblings(self, place: int, step: int = 0) -> str:
        """Digests of all siblings on the way from a node to the root."""
        if step == len(self.runs):
            return ""
        place = self._onward(step, place)
        above = place // FANOUT
        if (step + 1, above) not in self.shared:
            self.shared[step + 1, above] = self.siblings(above, step + 1)
        run, own = self.runs[step][above], place % FANOUT
        return "".join(run[:own]) + "".join(run[own + 1 :]) + self.shared[step + 1, above]

    def fold(self, place: int, digest: str) -> str:
        """The root that follows if the leaf at ``place`` is ``digest``."""
        for step, runs in enumerate(self.runs):
            place = self._onward(step, place)
            run, own = runs[place // FANOUT], place % FANOUT
            digest = _h("".join(run[:own]) + digest + "".join(run[own + 1 :]))
            place //= FANOUT
        return digest


def _expanded(n_trees: int, with_siblings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_runs(batches, "tree", "block"):
            tree = part.column("tree")[0].as_py()
            rows = part.select(["of", "level", "place", "digest", "claimed", "id", "n"]).to_pydict()
            listed = list(zip(*rows.values(), strict=True))
            fetched = {(of, level, place): digest for of, level, place, digest, *_ in listed if of is not None}
            own = [(place, digest, claimed, key) for of, _, place, digest, claimed, key, _ in listed if of is None]
            width = next(n for n in rows["n"] if n is not None)
            known = Partition(tree, width, n_trees, fetched, {place: digest for place, digest, _, _ in own})
            out: list[list] = [[] for _ in PROOFS]
            for place, digest, claimed, key in own:
                proof = known.siblings(place)
                folded = known.root if claimed == digest else known.fold(place, claimed)
                values = (key, digest, known.subroot, known.root, _h(proof), folded, proof if with_siblings else None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield record_batch(PROOFS, out)

    return run


def prove(manifest: Manifest, wanted: DataFrame, claimed: str = "digest", with_siblings: bool = False) -> DataFrame:
    """Proofs of the ``wanted`` rows of ``manifest.leaves``: ``id, leaf, subroot, root, proof_sha256, folded_root, siblings``.

    ``folded_root`` is the root that follows from the column ``claimed`` (a digest) and the stored siblings: a leaf that was tampered with
    leads elsewhere. ``siblings`` is the proof itself if asked for: hex digests, level by level, left to right.
    """
    block = F.expr(f"place div {BLOCK}").alias("block")
    leaves = wanted.select("tree", block, "place", "n", "id", "digest", F.col(claimed).alias("claimed"))
    dealt = leaves.select("tree", "block", "place", "n").repartition("tree", "block").sortWithinPartitions("tree", "block")
    needed = landed(dealt.mapInArrow(_coordinates(manifest.n_trees), WANTED), "merkle-wanted")
    stored = manifest.nodes.select("tree", "level", "place", "digest")
    if needed.filter(f"level = 0 AND tree <> {TOP}").head(1):  # not where whole blocks are proven
        stored = stored.unionByName(manifest.leaves.select("tree", F.lit(0).alias("level"), "place", "digest"))
    fetched = needed.join(stored, ["tree", "level", "place"]).select(
        F.col("for_tree").alias("tree"), F.col("for_block").alias("block"), F.col("tree").alias("of"), "level", "place", "digest"
    )
    both = fetched.unionByName(leaves, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block")
    return both.mapInArrow(_expanded(manifest.n_trees, with_siblings), PROOFS)
