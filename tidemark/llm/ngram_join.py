"""Exact similarity join on word n-grams: universe partition, pigeonhole, exact check.

A document's set holds the hashes of its distinct word n-grams. Sets are grouped by size into bands; within a band the
universe of n-grams is hashed into segments. Two sets that are similar enough differ in at most ``H`` n-grams, so with
weights adding up to more than ``H`` they agree in a segment of weight 1 or differ by at most one n-gram
in a segment of weight 2. Segments of weight 1 are indexed by their subset, those of weight 2 also by each subset with
one n-gram left out. How many segments get weight 2 is chosen per band by estimated cost. There are more
segments than needed, so each document leaves out its costliest subsets: those with the fewest n-grams that are not
frequent in the corpus, empty ones first. Equal subsets cost the same everywhere, so similar sets still meet (prefix filter).

Documents that share an index entry are compared exactly. Equal sets form one class and only its first document takes part. Within
an entry all are compared with the first one, then, in rounds, with more of the others as long as they are not yet
connected; pairs inside one component need no check, so a large group of near copies costs a star and not all pairs.

Null and empty texts, and texts without words, have no n-grams and are linked with nothing. Rows that repeat an id are one
document; a null id is one as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, discard, landed, record_batch, schema, unused
from tidemark.llm.components import connected_components
from tidemark.llm.words import U64, byte_values, mixed, span_hashes, text_buffer, window_hashes, word_spans

FREQUENT_SHARE = 1 / 500  # of all documents; bounds the frequent n-grams by 500 times a document's mean number
SPARE = 0.25  # segments beyond those the pigeonhole needs
ROUND = 16  # how many times more members of an entry each round compares with the others
NULL_ID = -(1 << 63)
CELLS = 1024  # of the sketch each set has; long sets have a finer one beside their n-grams
SKETCH = [f"s{i}" for i in range(CELLS // 64)]
TABLES = schema(
    "id long, n_shingles long, digest_1 long, digest_2 long, shingle long, documents long, "
    + ", ".join(f"{s} long" for s in SKETCH)
)
SIGNATURES = schema("digest_1 long, signature long")
SEEN = 1_000_000  # digests a task remembers so as to index equal sets once; more only cost repeated entries
SETS = schema("id long, n_shingles long, fine array<long>, shingles array<long>")
VALUES = byte_values(21, fold_case=True)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Per text the ascending hashes of its distinct word n-grams, A-Z lower-cased."""
    data, borders = text_buffer(column)
    if not len(data):
        return [np.zeros(0, dtype=U64)] * len(column)
    starts, ends, before = word_spans(data, borders)
    words = span_hashes(data, starts, ends, VALUES)
    windows = window_hashes(words, n)
    sets = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(windows[a : b - n + 1]))
        elif b > a:
            sets.append(mixed(window_hashes(words[a:b], b - a) + U64(b - a)))
        else:
            sets.append(np.zeros(0, dtype=U64))
    return sets


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    one, two = mixed(shingles + U64(0x51)).sum(dtype=U64), mixed(shingles ^ U64(0xA7)).sum(dtype=U64)
    return tuple(int(x) for x in np.array([one, two], dtype=U64).view(np.int64))


def sketch(shingles: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Parity of the n-grams in each cell. Two sets differ in at least as many n-grams as their sketches in bits."""
    cell = (mixed(shingles ^ U64(0x3D)) & U64(cells - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def fine_cells(size: int) -> int:
    """Cells that tell a set of this size from dissimilar ones: a power of two, one cell per n-gram at least."""
    return max(CELLS, 1 << (size - 1).bit_length())


@dataclass(frozen=True)
class Similarity:
    """Jaccard of at least ``percent`` / 100 over word ``n``-grams."""

    n: int = 5
    percent: int = 80

    def __post_init__(self):
        if self.n < 1 or not 1 <= self.percent <= 100:
            raise ValueError("n must be 1 or more, and percent from 1 to 100")

    def max_difference(self, sizes: int) -> int:
        """Most n-grams in which two similar sets with this sum of sizes can differ."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def bands(self, size: int) -> list[int]:
        """Bands a set takes part in: its own, and those above in which a set can be similar to it."""
        return list(range(size.bit_length() - 1, self.largest_partner(size).bit_length()))


@dataclass(frozen=True)
class Allocation:
    """Segments of one band: the first ``pairs`` have weight 2, the others weight 1."""

    weight: int
    pairs: int

    @property
    def segments(self) -> int:
        return self.weight - self.pairs


def allocate(similarity: Similarity, band: int, documents: int, frequent: float) -> Allocation:
    """The cheapest split of a band's weight.

    Cost is entries plus documents met by chance in them. Segments hold about ``k`` n-grams each, Poisson spread; one is shared by
    chance if all its n-grams are frequent ones, ``frequent`` being their share, so with probability ``exp(-k * (1 - frequent))``.
    Of the segments of weight 1 such bare ones are left out first, so they cost nothing while there are not more of them than may be
    left out. Those of weight 2 are all indexed, with ``k`` more entries each, which are bare if at most the n-gram left out is rare.
    """
    largest = (2 << band) - 1
    need = similarity.max_difference(2 * largest) + 1
    weight = need + int(SPARE * need)
    size = 0.75 * largest
    agree = weight - similarity.max_difference(int(2 * size))
    best, chosen = None, 0
    for pairs in sorted({round(weight * s / 16) for s in range(9)}):
        if pairs * 2 > weight:
            continue
        singles, k = weight - 2 * pairs, size / (weight - pairs)
        bare = math.exp(-k * (1 - frequent))
        kept = max(0, singles - agree + 1)
        met = max(0.0, singles * bare - (singles - kept)) + pairs * bare * (1 + k * (2 - frequent))
        cost = kept + pairs * (1 + k) + documents * met
        if best is None or cost < best:
            best, chosen = cost, pairs
    return Allocation(weight, chosen)


def signatures(
    shingles: np.ndarray, similarity: Similarity, allocations: dict[int, Allocation], frequent: np.ndarray
) -> np.ndarray:
    """Index entries of one set."""
    size = len(shingles)
    if not size:
        return np.zeros(0, dtype=np.int64)
    rare = np.ones(size, dtype=bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rare = frequent[at] != shingles
    marks = mixed(shingles + U64(0x1F))
    out = []
    for band in similarity.bands(size):
        plan = allocations[band]
        m = plan.segments
        spread = mixed(shingles ^ U64(0x2545F491 + band)) >> U64(32)
        segment = ((spread * U64(m)) >> U64(32)).astype(np.int64)
        sums = np.zeros(m, dtype=U64)
        np.add.at(sums, segment, marks)
        sizes = np.bincount(segment, minlength=m)
        place = (np.arange(m, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(band)
        entry = mixed((sums ^ place) + sizes.astype(U64))
        partner = min(similarity.largest_partner(size), (2 << band) - 1)
        agree = plan.weight - similarity.max_difference(size + partner)  # weight that agrees at least
        keep = max(0, (m - plan.pairs) - agree + 1)
        single = entry[plan.pairs :]
        if keep < len(single):
            rares = np.bincount(segment, weights=rare, minlength=m)[plan.pairs :]
            order = np.lexsort((single, -sizes[plan.pairs :], -rares))
            single = single[order[:keep]]
        out.append(single)
        if plan.pairs:
            of = segment < plan.pairs
            s = segment[of]
            without = mixed(((sums[s] - marks[of]) ^ place[s]) + (sizes[s] - 1).astype(U64))
            out += [entry[: plan.pairs], without]
    return np.unique(np.concatenate(out)).view(np.int64)


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in byte_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"), n)
            digests = [digest(s) for s in sets]
            none = [None] * len(sets)
            one, two = zip(*digests, strict=True)
            cells = list(np.stack([sketch(s) for s in sets], axis=1))
            sizes = [len(s) for s in sets]
            yield record_batch(TABLES, [batch.column("id"), sizes, list(one), list(two), none, none, *cells])
            seen, times = np.unique(np.concatenate(sets), return_counts=True)
            often = times >= max(3, FREQUENT_SHARE * len(sets))
            for s, t in zip(seen[often].view(np.int64).tolist(), times[often].tolist(), strict=True):
                counts[s] = counts.get(s, 0) + t
            if len(counts) > 500_000:
                yield _counted(counts)
        if counts:
            yield _counted(counts)

    return run


def _counted(counts: dict[int, int]) -> pa.RecordBatch:
    none = [None] * len(counts)
    batch = record_batch(TABLES, [none, none, none, none, list(counts), list(counts.values()), *[none] * len(SKETCH)])
    counts.clear()
    return batch


def _signed(similarity: Similarity, allocations: dict[int, Allocation], frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in byte_batches(batches, "text"):
            new = {}
            for one in shingle_sets(batch.column("text"), similarity.n):
                new.setdefault(digest(one), one)
            sets = {d: one for d, one in new.items() if d not in seen}
            if not sets:
                continue
            entries = [signatures(one, similarity, allocations, frequent) for one in sets.values()]
            owners = np.repeat(np.array([d[0] for d in sets], dtype=np.int64), [len(e) for e in entries])
            yield record_batch(SIGNATURES, [owners, np.concatenate(entries)])
            if len(seen) > SEEN:
                seen.clear()
            seen.update(sets)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"), n)
            sizes = [len(s) for s in sets]
            fine = _lists([sketch(s, fine_cells(n)) for s, n in zip(sets, sizes, strict=True)])
            yield record_batch(SETS, [batch.column("id"), sizes, fine, _lists([s.view(np.int64) for s in sets])])

    return run


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    borders = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(rows)))


def _with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with ``columns`` of both ends, as ``<column>_a`` and ``<column>_b``."""
    left = sets.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = sets.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(left, "a").join(right, "b")


def _folded(fine: Column, words: Column) -> Column:
    """A sketch brought to ``words`` words, of which it has some power of two times as many."""
    parts = F.sequence(F.lit(0), (F.size(fine) / words).cast("int") - 1)
    first = F.transform(F.sequence(F.lit(1), words), lambda i: F.lit(0).cast("long"))
    folded = F.aggregate(
        parts, first, lambda out, part: F.zip_with(out, F.slice(fine, part * words + 1, words), lambda x, y: x.bitwiseXOR(y))
    )
    return F.when(F.size(fine) > words, folded).otherwise(fine)


def similar(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that are similar, decided on the whole sets.

    Sketches that grow with the set, a bit or two per n-gram, rule out most others before any whole set is moved.
    """
    words = F.least(F.size("fine_a"), F.size("fine_b"))
    bits = F.zip_with(
        _folded(F.col("fine_a"), words), _folded(F.col("fine_b"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y))
    )
    differ = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    allowed = (100 - similarity.percent) * (F.col("n_shingles_a") + F.col("n_shingles_b"))
    near = _with_both(pairs, sets, "n_shingles", "fine").filter(differ * (100 + similarity.percent) <= allowed)
    both = _with_both(near.select("a", "b"), sets, "shingles")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return both.filter(100 * common >= similarity.percent * union).select("a", "b")


def _split(members: DataFrame) -> DataFrame:
    """Members of entries that hold more than one component."""
    split = members.groupBy("signature").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")
    )
    return members.drop("size").join(split.filter("lo <> hi").select("signature", "size"), "signature")


def _ranked(members: DataFrame) -> DataFrame:
    """Members in an order by hash, ``rank`` being about the place in it; the first of the entry has 1, the others more.

    The place follows from the hash and the size of the entry, so that no task sees a whole entry.
    """
    hashed = F.shiftrightunsigned(F.xxhash64("signature", "id"), 11) + 1  # 53 bits
    rank = F.when(F.col("id") == F.col("pivot"), 1.0).otherwise(1 + hashed / float(1 << 53) * F.col("size"))
    return members.withColumn("rank", rank).drop("pivot")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    found = members.drop("component").join(labels, F.col("id") == F.col("node"), "left")
    return found.withColumn("component", F.coalesce("component", "id")).drop("node")


def _plausible(similarity: Similarity):
    """Whether sizes and sketches of rows ``a`` and ``b`` allow them to be similar; it never rules out similar ones."""
    differ = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in SKETCH), F.lit(0))
    smaller, larger = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
    allowed = (100 - similarity.percent) * (smaller + larger)
    return (smaller * 100 >= similarity.percent * larger) & (differ * (100 + similarity.percent) <= allowed)


def _with_first(members: DataFrame, nodes: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs of each member with the first of its entry."""
    pairs = members.filter("id <> pivot").select(F.least("pivot", "id").alias("x"), F.greatest("pivot", "id").alias("y"))
    found = pairs.distinct().join(nodes.alias("a"), F.col("x") == F.col("a.id"))
    found = found.join(nodes.alias("b"), (F.col("y") == F.col("b.id")) & _plausible(similarity))
    return found.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _candidates(members: DataFrame, nodes: DataFrame, step: int, similarity: Similarity) -> DataFrame:
    """Pairs not yet connected, of members ranked above ``step`` to ``ROUND * step`` with later ones of the same entry."""
    members = members.join(nodes, "id")
    a, b = members.alias("a"), members.alias("b")
    later = (
        (F.col("a.signature") == F.col("b.signature"))
        & ((F.col("b.rank") > F.col("a.rank")) | ((F.col("b.rank") == F.col("a.rank")) & (F.col("b.id") > F.col("a.id"))))
        & (F.col("a.component") != F.col("b.component"))
        & _plausible(similarity)
    )
    firsts = a.filter((F.col("a.rank") > step) & (F.col("a.rank") <= ROUND * step))
    pairs = firsts.join(b.filter(F.col("b.rank") > step), later)
    return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def similar_documents(
    docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_shingles``, ``class_id`` and ``component_id``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    tables = landed(rows.mapInArrow(_profile(similarity.n), TABLES), "profiles")
    profiles = tables.filter("id IS NOT NULL").select("id", "n_shingles", "digest_1", "digest_2")
    key = ["digest_1", "digest_2"]
    kinds = tables.filter("n_shingles > 0").groupBy(*key)
    kept = [F.first(c).alias(c) for c in ("n_shingles", *SKETCH)]
    classes = landed(kinds.agg(F.min("id").alias("class_id"), *kept), "classes")
    totals = profiles.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).first()
    counts = tables.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("documents").alias("n"))
    found = counts.filter(F.col("n") >= FREQUENT_SHARE * totals["n"]).toPandas()
    frequent = np.sort(found["shingle"].to_numpy(np.int64).view(U64))
    share = float(found["n"].sum()) / max(1, totals["shingles"] or 0)
    sizes = profiles.filter("n_shingles > 0").groupBy(F.floor(F.log2("n_shingles")).alias("band")).count().collect()
    held = {r["band"]: r["count"] for r in sizes}
    wanted = range(max(held, default=0) + similarity.largest_partner(2).bit_length() + 1)
    allocations = {b: allocate(similarity, b, held.get(b, 0), share) for b in wanted}

    signed = landed(rows.mapInArrow(_signed(similarity, allocations, frequent), SIGNATURES), "signatures")
    nodes = classes.select(F.col("class_id").alias("id"), "n_shingles", *SKETCH)
    # Entries that several sets have are found by a combined aggregate; only those are named. Sets go by half of their digest,
    # as two that share it are only compared once more.
    several = signed.groupBy("signature").agg(F.min("digest_1").alias("lo"), F.max("digest_1").alias("hi"))
    several = landed(several.filter("lo <> hi").select("signature"), "shared")
    owners = signed.join(several, "signature").join(classes.select(F.col("class_id").alias("id"), "digest_1"), "digest_1")
    named = landed(owners.select("signature", "id").distinct(), "entries")
    discard(signed)
    pivots = named.groupBy("signature").agg(F.min("id").alias("pivot"))
    members = landed(named.join(landed(pivots, "pivots"), "signature"), "members")
    sets = rows.join(members.select("id").distinct(), "id").mapInArrow(_sets(similarity.n), SETS)
    sets = landed(sets, "sets")

    tested = [landed(_with_first(members, nodes, similarity), "pairs")]
    links = [landed(similar(tested[0], sets, similarity), "links")]
    labels = landed(connected_components(links[0]), "labels")
    open_members, step = landed(_ranked(_split(_labelled(members, labels))), "unresolved"), 1
    while open_members.filter(F.col("rank") > step).head(1):
        more = _candidates(open_members, nodes, step, similarity)
        for done in tested:
            more = more.join(done, ["a", "b"], "left_anti")
        more, step = landed(more, "pairs"), ROUND * step
        if not more.head(1):
            continue
        tested.append(more)
        links.append(landed(similar(tested[-1], sets, similarity), "links"))
        every = links[0]
        for found_links in links[1:]:
            every = every.unionByName(found_links)
        labels = landed(connected_components(every), "labels")
        open_members = landed(_split(_labelled(open_members, labels)), "unresolved")

    out = profiles.join(classes.select("class_id", *key), key, "left").join(labels, F.col("class_id") == F.col("node"), "left")

    def shown(c):
        return F.when(c != NULL_ID, c)

    return out.select(
        shown(F.col("id")).alias("id"),
        "n_shingles",
        shown(F.coalesce("class_id", "id")).alias("class_id"),
        shown(F.coalesce("component", "class_id", "id")).alias("component_id"),
    )


def drop_similar(
    docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of similar ones, all columns kept: that of the smallest id, nulls first.

    It is decided by row: an id that occurs with several texts loses only those that are similar to a row that stays.
    """
    row, kept_row = unused(docs, "_row", "_kept_row")
    numbered = landed(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = similar_documents(numbered, similarity, row, text_col)
    found = found.select(F.col("id").alias(row), "component_id").join(numbered.select(row, F.col(id_col).alias("_id")), row)
    found = landed(found, "groups")
    groups = found.groupBy("component_id").agg(F.min(F.struct("_id", row))[row].alias(kept_row), F.count(F.lit(1)).alias("n"))
    groups = landed(groups.filter("n > 1").drop("n"), "kept")
    gone = landed(found.join(groups, "component_id").filter(F.col(row) != F.col(kept_row)).select(row), "gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
