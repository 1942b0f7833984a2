"""Near-duplicate vectors by NN-descent.

Equal vectors form a class and take part once. Sign codes of random planes order the classes a few times; neighbours in
such an order, compared in blocks, give a first neighbour graph and components. Further orders hold a few members of each
component only, so that their blocks show other components. Then neighbours of neighbours are joined: every vector compares
the vectors around it with each other, which improves its list, until few change. A list has places for the nearest vectors and
as many for the nearest outside the vector's component, so links inside a tight group never fill it. A list whose places outside are
all links is saturated: there may be more, so its places double for the next step. Whatever was compared anywhere and linked joins
its components, listed or not. Inside each component all links are counted exactly in blocks.

Vectors chosen by hash are then compared with all others, more of them until ``SEEN`` have links. If fewer than ``RECALL``
of these have all their links in their component, twice as many orders follow and other vectors are chosen; after
``ATTEMPTS`` every vector is compared with all, which is exact and takes the square of their number.

Vectors that are null, zero, of another length than most, or hold null or non-finite components link with nothing. Ids should be
unique; a null id is shown as null and stands for itself. Cosines are in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import landed, record_batch, schema, tasks
from tidemark.llm.components import connected_components

NEIGHBOURS, MOST_REVERSE = 8, 32
ORDERS, BITS = 6, 48
MEMBERS = 8  # of a component that an order holds once components are known, on average
BLOCK = 128
EXACT_BLOCK = 512
MAX_STEPS, MIN_CHANGE = 6, 0.02
AUDITED, SEEN, RECALL, ATTEMPTS = 500, 300, 0.95, 3
CHUNK_BYTES, TILE = 32 << 20, 1024  # vectors compared with all others at once, and in one product
NULL_ID = -(1 << 63)
EDGES = schema("u long, v long, cosine double, across boolean, link boolean")
CODES = schema("order int, code long, node long, component long, vector array<double>")
COUNTS = schema("node long, n_links long")
HITS = schema("node long, other long, pairs long, missed long")


def unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision; scaled first, so that no square overflows."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys``, whatever batches they come in, cut after ``most`` rows."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
        begin = 0
        for end in edges:
            key = tuple(c[begin] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            last = key
            while most and rows + end - begin >= most:
                held.append(batch.slice(begin, most - rows))
                begin += most - rows
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                rows += end - begin
            begin = end
    if held:
        yield pa.Table.from_batches(held)


def _nodes(table: pa.Table, name: str = "node") -> np.ndarray:
    return table.column(name).to_numpy()


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return record_batch(EDGES, [np.concatenate(x) for x in zip(*found, strict=True)])


def _buffered(pieces: Iterator[tuple], make: Callable, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= rows:
            yield make(held)
            held, size = [], 0
    if held:
        yield make(held)


def joining(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs of ``a`` and ``b`` that form a spanning forest: what all pairs join, with fewer than there are names."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pair = np.full((len(names), len(names)), -1, dtype=np.int32)
    pair[at[: len(a)], at[len(a) :]] = pair[at[len(a) :], at[: len(a)]] = np.arange(len(a))
    linked, out = pair >= 0, []
    np.fill_diagonal(linked, False)
    fresh = linked.any(axis=1)
    while fresh.any():
        here = np.array([np.argmax(fresh)])
        fresh[here] = False
        while len(here):
            near = linked[here] & fresh
            reached = np.flatnonzero(near.any(axis=0))
            out.append(pair[here[near[:, reached].argmax(axis=0)], reached])
            fresh[reached] = False
            here = reached
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def _best(
    nodes: np.ndarray, of: np.ndarray, cosines: np.ndarray, threshold: float, floors: tuple | None = None, room: int = NEIGHBOURS
) -> Iterator[tuple]:
    """The nearest of each row, those of other components (``of``), if above ``floors``; and the links that join components."""
    np.fill_diagonal(cosines, -2)
    other = of[:, None] != of
    a, b = np.nonzero(np.triu(other & (cosines >= threshold)))
    if len(a):
        chosen = joining(of[a], of[b])
        a, b = a[chosen], b[chosen]
        yield nodes[a], nodes[b], cosines[a, b], np.ones(len(a), dtype=bool), np.ones(len(a), dtype=bool)
    apart = other.sum() == other.size - len(of)  # the nearest of all are the nearest outside
    for mask, floor in zip((False, True), floors or (None, None), strict=True):
        if apart and not mask:
            continue
        values = np.where(other, cosines, -2) if mask else cosines
        k = min(room if mask else NEIGHBOURS, len(nodes) - 1)
        row = np.broadcast_to(np.arange(len(nodes))[:, None], (len(nodes), k))
        near = np.argpartition(-values, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(values, near, axis=1)
        wanted = value > (floor[:, None] if floor is not None else -2)
        i, j = row[wanted], near[wanted]
        yield nodes[i], nodes[j], value[wanted], other[i, j], np.zeros(len(i), dtype=bool)


def _drawn(nodes: np.ndarray, order: int) -> np.ndarray:
    """A number from 0 to 1 for each node, another in each order."""
    x = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((order + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)) / float(1 << 53)


def _codes(first: int, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, nodes, share = unit(batch.column("vector")), batch.column("node").to_numpy(), batch.column("share").to_numpy()
            for order in range(first, first + orders):
                planes = np.random.default_rng(order + 1).standard_normal((x.shape[1], BITS))
                code = ((x @ planes > 0) * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(axis=1)
                held = np.flatnonzero(_drawn(nodes, order) < share)
                rest = [batch.column(c).take(pa.array(held)) for c in ("node", "component", "vector")]
                yield record_batch(CODES, [[order] * len(held), code[held], *rest])

    return run


def _compare_blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for block in groups(batches, ["order"], BLOCK):
                if block.num_rows > 1:
                    x = unit(block.column("vector").combine_chunks())
                    yield from _best(_nodes(block), _nodes(block, "component"), x @ x.T, threshold)

        yield from _buffered(pieces(), _edges)

    return run


def _local_join(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for around in groups(batches, ["at"]):
                if around.num_rows > 1:
                    x = unit(around.column("vector").combine_chunks())
                    floors = around.column("floor").to_numpy(), around.column("floor_across").to_numpy()
                    room = int(around.column("room").to_numpy().max())
                    yield from _best(_nodes(around), _nodes(around, "component"), x @ x.T, threshold, floors, room)

        yield from _buffered(pieces(), _edges)

    return run


def ordered_edges(vectors: DataFrame, labels: DataFrame | None, first: int, orders: int, threshold: float) -> DataFrame:
    """What blocks of some orders give; with ``labels`` an order holds about ``MEMBERS`` members of a larger component."""
    if labels is None:
        held = vectors.withColumns({"component": F.col("node"), "share": F.lit(1.0)})
    else:
        large = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEMBERS)
        shares = labels.join(large, "component", "left").select("node", "component", F.coalesce(MEMBERS / F.col("n"), F.lit(1.0)).alias("share"))
        held = vectors.join(shares, "node", "left").fillna({"share": 1.0}).withColumn("component", F.coalesce("component", "node"))
    codes = held.select("node", "component", "share", "vector").mapInArrow(_codes(first, orders), CODES)
    dealt = codes.repartitionByRange(4 * tasks(codes.sparkSession), "order", "code", "node")
    return dealt.sortWithinPartitions("order", "code", "node").mapInArrow(_compare_blocks(threshold), EDGES)


def nearest(edges: DataFrame, rooms: DataFrame | None = None) -> DataFrame:
    """The best places of each list, those outside the own component, and all links that join components.

    ``rooms`` (``u``, ``room``) names the lists that have more than ``NEIGHBOURS`` places outside.
    """
    best = [F.max("cosine").alias("cosine"), F.min("across").alias("across"), F.max("link").alias("link")]
    once = edges.groupBy("u", "v").agg(*best)
    by = [F.desc("cosine"), "v"]
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(*by)))
    once = once.withColumn("place", F.row_number().over(Window.partitionBy("u", "across").orderBy(*by)))
    room = F.lit(NEIGHBOURS) if rooms is None else F.coalesce("room", F.lit(NEIGHBOURS))
    once = (once if rooms is None else once.join(rooms, "u", "left")).withColumn("room", room)
    listed = (F.col("rank") <= NEIGHBOURS) | (F.col("across") & (F.col("place") <= F.col("room")))
    return once.withColumn("listed", listed).filter("listed OR link")


def enlarged(lists: DataFrame, threshold: float) -> DataFrame:
    """``u, room`` of the lists with more than ``NEIGHBOURS`` places outside; saturated ones get twice as many as they had."""
    outside = lists.filter("listed AND across").groupBy("u").agg(
        F.max("room").alias("room"), F.count_if(F.col("place") <= F.col("room")).alias("held"), F.min("cosine").alias("least")
    )
    full = (F.col("held") >= F.col("room")) & (F.col("least") >= threshold)
    grown = outside.select("u", F.when(full, 2 * F.col("room")).otherwise(F.col("room")).alias("room"))
    return grown.filter(F.col("room") > NEIGHBOURS)


def descend(vectors: DataFrame, labels: DataFrame, edges: DataFrame, threshold: float, steps: int) -> DataFrame:
    """Refine neighbour lists (rows of ``nearest``) until few places change."""
    of = labels.select(F.col("node").alias("labelled"), "component")
    lists = landed(nearest(edges), "lists")
    size = lists.filter("listed").count()
    for _ in range(steps):
        listed = lists.filter("listed")
        back = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("cosine"), "u"))
        outside = F.row_number().over(Window.partitionBy("v", "across").orderBy(F.desc("cosine"), "u"))
        reverse = listed.withColumns({"back": back, "outside": outside})
        reverse = reverse.filter((F.col("back") <= MOST_REVERSE) | (F.col("across") & (F.col("outside") <= NEIGHBOURS)))
        around = listed.select(F.col("u").alias("at"), F.col("v").alias("node"))
        around = around.unionByName(reverse.select(F.col("v").alias("at"), F.col("u").alias("node")))
        around = around.unionByName(listed.select(F.col("u").alias("at"), F.col("u").alias("node"))).distinct()

        def floor(places, name):
            own = F.when(places, F.col("cosine"))
            return F.coalesce(F.when(F.count(own) >= NEIGHBOURS, F.min(own)), F.lit(-2.0)).alias(name)

        rooms = landed(enlarged(lists, threshold), "rooms")
        outside_at = F.when(F.col("across") & (F.col("place") <= F.col("room")), F.col("cosine"))
        lowest = F.when(F.count(outside_at) >= F.coalesce(F.max("more"), F.lit(NEIGHBOURS)), F.min(outside_at))
        floors = listed.join(rooms.select("u", F.col("room").alias("more")), "u", "left").groupBy("u").agg(
            floor(F.col("rank") <= NEIGHBOURS, "floor"),
            F.coalesce(lowest, F.lit(-2.0)).alias("floor_across"),
            F.coalesce(F.max("more"), F.lit(NEIGHBOURS)).cast("long").alias("room"),
        )
        floors = floors.join(of, F.col("u") == F.col("labelled"), "left").withColumn("component", F.coalesce("component", "u"))
        held = vectors.join(floors, vectors["node"] == floors["u"]).select("node", "component", "vector", "floor", "floor_across", "room")
        dealt = around.join(held, "node").repartition("at").sortWithinPartitions("at")
        better = dealt.select("at", "node", "component", "vector", "floor", "floor_across", "room").mapInArrow(_local_join(threshold), EDGES)
        after = landed(nearest(lists.select(*EDGES.names).unionByName(better), rooms), "lists")
        changed = after.filter("listed").join(listed, ["u", "v"], "left_anti").count()
        lists = after
        if changed <= MIN_CHANGE * size:
            break
    return lists


def _count_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for block in groups(batches, ["component", "lo", "hi"]):
                x, own = unit(block.column("vector").combine_chunks()), block.column("block").to_numpy()
                nodes, size = _nodes(block), block.column("size").to_numpy()
                lo, hi = block.column("lo")[0].as_py(), block.column("hi")[0].as_py()
                if lo == hi:
                    linked = x @ x.T >= threshold
                    np.fill_diagonal(linked, False)
                    yield nodes, linked @ size
                else:
                    a, b = own == lo, own == hi
                    linked = x[a] @ x[b].T >= threshold
                    yield nodes[a], linked @ size[b]
                    yield nodes[b], linked.T @ size[a]

        yield from _buffered(pieces(), lambda held: record_batch(COUNTS, [np.concatenate(c) for c in zip(*held, strict=True)]))

    return run


def count_links(vectors: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Exact number of links of each node inside its component, by pairs of blocks."""
    sizes = labels.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / EXACT_BLOCK).alias("blocks"))
    members = labels.join(sizes, "component").join(vectors, "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("partner")
    paired = members.select("component", "node", "vector", "size", "block", partner)
    paired = paired.withColumns({"lo": F.least("block", "partner"), "hi": F.greatest("block", "partner")})
    keys = ["component", "lo", "hi"]
    dealt = paired.repartition(*keys).sortWithinPartitions(*keys)
    counts = dealt.select(*keys, "node", "vector", "size", "block").mapInArrow(_count_links(threshold), COUNTS)
    return counts.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _compare_with(chosen: pa.Table, threshold: float):
    own, of = _nodes(chosen), _nodes(chosen, "component")
    x = unit(chosen.column("vector").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, missed = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, TILE):
                table = pa.Table.from_batches([whole.slice(start, TILE)])
                y, nodes, component = unit(table.column("vector").combine_chunks()), _nodes(table), _nodes(table, "component")
                for first in range(0, len(own), TILE):
                    at = slice(first, first + TILE)
                    i, j = np.nonzero(x[at] @ y.T >= threshold)
                    i, j = i[own[at][i] != nodes[j]], j[own[at][i] != nodes[j]]
                    if not len(i):
                        continue
                    pairs[at] += np.bincount(i, minlength=len(own[at]))
                    apart = of[at][i] != component[j]
                    i, j = i[apart], j[apart]
                    if len(i):
                        missed[at] += np.bincount(i, minlength=len(own[at]))
                        kept = joining(of[at][i], component[j])
                        zero = np.zeros(len(kept), dtype=np.int64)
                        yield record_batch(HITS, [own[at][i[kept]], nodes[j[kept]], zero, zero])
        some = np.flatnonzero(pairs)
        yield record_batch(HITS, [own[some], [None] * len(some), pairs[some], missed[some]])

    return run


@dataclass
class Audit:
    """Compares vectors chosen by hash with all; each is chosen once, so when none is left every link is known."""

    count: int
    rows: int  # most vectors compared at once
    threshold: float
    done: int = 0  # buckets of about AUDITED vectors

    @property
    def buckets(self) -> int:
        return -(-self.count // AUDITED)

    def compare(self, labelled: DataFrame, most: int) -> tuple[DataFrame, int, int]:
        """Links of about ``most`` vectors that join components; how many of them have links, and have all inside."""
        more = max(1, min(most, self.rows) // AUDITED)
        bucket = F.pmod(F.xxhash64("node"), F.lit(self.buckets))
        chosen = labelled.filter((bucket >= self.done) & (bucket < self.done + more)).toArrow()
        self.done += more
        hits = landed(labelled.mapInArrow(_compare_with(chosen, self.threshold), HITS), "audit")
        of_node = hits.filter("other IS NULL").groupBy("node").agg(F.sum("missed").alias("missed"))
        seen = of_node.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("missed") == 0).alias("whole")).first()
        return hits.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), *seen

    def run(self, labelled: DataFrame, everything: bool) -> tuple[list[DataFrame], bool]:
        """The links found, and whether the target is met by enough vectors with links, or all were compared."""
        links, seen, whole, most = [], 0, 0, AUDITED
        while self.done < self.buckets and (everything or seen < SEEN):
            more = self.compare(labelled, self.rows if everything else most)
            links, seen, whole, most = [*links, more[0]], seen + more[1], whole + more[2], 2 * most
        return links, self.done >= self.buckets or whole >= RECALL * seen


def near_duplicates(
    embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per row: ``id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable)."""
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("shown"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & (F.col("vector").isNotNull()))
    common = rows.filter("sound").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.withColumn("sound", F.col("sound") & (F.size("vector") == (common["d"] if common else 0)))
    marked = rows.select(
        "shown", "id", F.when(F.col("sound"), F.col("vector")).alias("vector"), F.xxhash64("vector").alias("h1"),
        F.xxhash64(F.lit(1), "vector").alias("h2"),
    )
    classes = marked.filter("vector IS NOT NULL").groupBy("h1", "h2")
    classes = classes.agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    classes = landed(classes, "classes")
    vectors = classes.select("node", "vector", "size")

    def labels_of(found: DataFrame, *more: DataFrame) -> DataFrame:
        for links in more:
            found = found.unionByName(links)
        return landed(connected_components(found), "labels")

    def linked(lists: DataFrame) -> DataFrame:
        return lists.filter("link").select(F.col("u").alias("a"), F.col("v").alias("b"))

    checked = Audit(classes.count(), max(AUDITED, CHUNK_BYTES // (8 * (common["d"] if common else 1))), threshold)
    lists = landed(nearest(ordered_edges(vectors, None, 0, ORDERS, threshold)), "lists")
    labels, first, complete = labels_of(linked(lists)), ORDERS, False
    for attempt in range(ATTEMPTS):
        own = labels.select(F.col("node").alias("u"), F.col("component").alias("of_u"))
        other = labels.select(F.col("node").alias("v"), F.col("component").alias("of_v"))
        known = lists.filter("listed").join(own, "u", "left").join(other, "v", "left")
        across = F.coalesce("of_u", "u") != F.coalesce("of_v", "v")
        known = known.select("u", "v", "cosine", across.alias("across"), F.lit(False).alias("link"))
        fresh = ordered_edges(vectors, labels, first, ORDERS << attempt, threshold)
        first += ORDERS << attempt
        lists = descend(vectors, labels, known.unionByName(fresh), threshold, MAX_STEPS << attempt)
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = labels_of(stars, linked(lists))
        for everything in (False, True) if attempt == ATTEMPTS - 1 else (False,):
            labelled = vectors.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            links, complete = checked.run(landed(labelled.select("node", "component", "vector"), "labelled"), everything)
            if links:
                stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
                labels = labels_of(stars, *links)
            if complete:
                break
        if complete:
            break
    counts = count_links(vectors, labels, threshold)
    known = classes.select("h1", "h2", "node", "size").join(labels, "node", "left").join(counts, "node", "left")
    out = marked.withColumn("sound", F.col("vector").isNotNull()).select("shown", "id", "sound", "h1", "h2")
    out = out.join(known.withColumn("sound", F.lit(True)), ["sound", "h1", "h2"], "left")
    component = F.coalesce("component", "node", "id")
    return out.select(
        F.col("shown").alias("id"),
        F.coalesce(F.col("size") - 1 + F.coalesce("n_links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NULL_ID, component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
