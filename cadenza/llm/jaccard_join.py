"""Exact Jaccard self-join of word 5-grams, as a join in a metric space.

1. Texts become sets of shingle hashes; texts with equal sets are one class, and
   a class is joined as its least document.
2. Blocks only narrow down what has to be joined: ordered by a frequency sketch,
   rarest first, two sets that link share one of their first shingles, their sizes are
   near, and parity bitmaps give a lower bound of every distance. What none of these can
   separate is a region.
3. Every region is joined by pivots. Each of its documents goes to the Voronoi cell
   of its nearest pivot and, where the triangle inequality leaves a link across the
   border possible, to the cells beyond; cells are joined in the same way until they
   are small. Documents that link to a common pivot are connected already and are
   not compared with each other.
4. Regions that fit into a task are split there; larger ones are split by tasks that
   each compare a part of a region with its pivots. A region that pivots do not make
   easier is cut into parts instead, and every two parts meet in a task.

Shingles are told apart by 64 bits of a hash, sets by 128.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import checkpointed, few, shipped, slices, spaced_words, stored, tidy

WORDS = 5
#: Links have at least this Jaccard similarity, in percent.
PERCENT = 80

#: Counters of the frequency sketch and the parts in which it is summed.
SKETCH_BITS, SKETCH_PARTS = 21, 64

#: A block with more members, or with more shingles in them, is a region without the bitmaps' help.
MAX_BLOCK, MAX_BLOCK_SHINGLES = 1000, 4_000_000
#: A region with more shingles is split by several tasks, each of which compares so many shingles with the pivots.
MAX_REGION, PART_SHINGLES = 250_000, 100_000
#: Pivots at once, members of a cell that is not split any more, and the share of a region's pairs that its cells may have left between them.
PIVOTS, LEAF, STUCK = 8, 16, 0.5

#: Ids up to this number are broadcast; of more a Bloom filter is, so that texts stay where they are.
MAX_BROADCAST_IDS = 1_000_000
#: Parts in which a Bloom filter is made, ids for each of its words of 64 bits, and its most words (32 MB).
MARK_PARTS, MARK_IDS, MARK_WORDS = 64, 4, 1 << 22

_SLICE = 1 << 20
_ODD = np.random.default_rng(9).integers(0, 1 << 63, 2 * WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    docs = [spaced_words(t) for t in texts]
    number: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(lengths.sum())
    if not total:
        return [np.zeros(0, np.uint64)] * len(docs)
    flat = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.int64, total)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    words = np.concatenate([own[flat], np.zeros(WORDS, np.uint64)])
    runs = np.full(total, _ODD[2 * WORDS], np.uint64)
    for j in range(WORDS):
        runs += words[j : j + total] * _ODD[j]
    runs = _mixed(runs)
    out, start = [], 0
    for n in lengths.tolist():
        if n >= WORDS:
            found = np.sort(runs[start : start + n - WORDS + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif n:
            whole = np.array([int(_ODD[WORDS + n])], np.uint64)
            for j in range(n):
                whole += words[start + j : start + j + 1] * _ODD[j]
            out.append(_mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def needed(n: np.ndarray | int):
    """Shingles that a set of n must share with any partner."""
    return -(-n * PERCENT // 100)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes | None]]]:
    ids, texts = batch.column(0), batch.column(1)
    for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _SLICE):
        yield ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()


_SETS = "doc_id bigint, n bigint, key binary, part int, counts binary"


def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and key of every set, and at the end of the partition its part of the frequency sketch."""
    names = ["doc_id", "n", "key", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    counts = None
    for batch in batches:
        for ids, texts in _texts(batch):
            sets = shingle_sets(texts)
            counts = np.zeros(1 << SKETCH_BITS, np.int32) if counts is None else counts
            slots, times = np.unique((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
            counts[slots] += times.astype(np.int32)
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            columns = [ids, [len(x) for x in sets], keys, [None] * len(ids), [None] * len(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        tidy()
    if counts is not None:
        parts = np.split(counts, SKETCH_PARTS)
        columns = [[None] * SKETCH_PARTS] * 3 + [list(range(SKETCH_PARTS)), [zlib.compress(p.astype(np.int64).tobytes(), 1) for p in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in table["counts"].to_pylist())
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def frequency_sketch(parts: DataFrame) -> np.ndarray:
    """Twice the log2 of every counter: 2 MB at any size of the corpus. Summed in two steps, so that no task holds them all."""
    salted = parts.select("part", F.pmod(F.hash("counts"), F.lit(64)).alias("salt"), "counts")
    once = salted.groupBy("part", "salt").applyInArrow(_added, "part int, salt int, counts binary")
    rows = once.groupBy("part").applyInArrow(_added, "part int, salt int, counts binary").select("part", "counts").collect()
    counts = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in rows:
        counts[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.round(2 * np.log2(1 + counts.reshape(-1))).astype(np.uint8)


def parity_bits(found: np.ndarray) -> np.ndarray:
    """One bit a slot, odd if an odd number of shingles falls there; the number of slots grows with the set, in powers of two. Two bitmaps differ in no more bits than the sets in elements, also when the larger is folded."""
    slots = 1 << max(8, int(2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Marks:
    """A Bloom filter of ids' hashes: a word for each, and four bits of it."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def held(self, hashes: np.ndarray) -> np.ndarray:
        bits = _mark_bits(hashes)
        return self.words[_mark_word(hashes, len(self.words))] & bits == bits


def _mark_word(hashes: np.ndarray, words: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(65 - words.bit_length())).astype(np.int64)


def _mark_bits(hashes: np.ndarray) -> np.ndarray:
    h, one = hashes.view(np.uint64), np.uint64(1)
    return np.bitwise_or.reduce([one << (h >> np.uint64(6 * j) & np.uint64(63)) for j in range(4)])


def marks(ids: DataFrame) -> Marks:
    """A Bloom filter of the integers in the only column of ``ids``. Up to 16,000,000 it lets about one other in a hundred through."""
    words = min(MARK_WORDS, max(MARK_PARTS, 1 << (ids.count() // MARK_IDS).bit_length()))
    each = words // MARK_PARTS

    def filled(table: pa.Table) -> pa.Table:
        hashes = table["h"].to_numpy()
        part = table["part"][0].as_py()
        own = np.zeros(each, np.uint64)
        np.bitwise_or.at(own, _mark_word(hashes, words) - part * each, _mark_bits(hashes))
        return pa.table({"part": pa.array([part], pa.int32()), "words": pa.array([own.tobytes()], pa.binary())})

    hashed = ids.select(F.xxhash64(ids.columns[0]).alias("h")).withColumn("part", F.shiftrightunsigned("h", 65 - MARK_PARTS.bit_length()).cast("int"))
    out = np.zeros((MARK_PARTS, each), np.uint64)
    for r in hashed.groupBy("part").applyInArrow(filled, "part int, words binary").collect():
        out[r["part"]] = np.frombuffer(r["words"], np.uint64)
    return Marks(out.reshape(-1))


def marked(spark, made: Marks, doc_id: Column) -> Column:
    """Whether an id is among those of ``marks``: true for all of them, and for a few others."""
    here = shipped(spark, made)

    def held(hashes: pa.Array) -> pa.Array:
        return pa.array(here().held(hashes.to_numpy(zero_copy_only=False)), pa.bool_())

    return F.arrow_udf(held, "boolean")(F.xxhash64(doc_id))


def _narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with a doc_id in ``ids``; if those are too many to be broadcast, a few others are left among them."""
    if few(ids, MAX_BROADCAST_IDS):
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.filter(marked(docs.sparkSession, marks(ids), F.col("doc_id")))


class Blocker:
    """Rows of one document each: its first shingles in the global order, and its bitmap."""

    def __init__(self, sketch: np.ndarray):
        self.sketch = sketch

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _texts(batch):
                sets = shingle_sets(texts)
                firsts, bits = [], []
                for x in sets:
                    rank = self.sketch[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    # x is sorted: a stable sort by frequency leaves ties in hash order.
                    firsts.append(x[np.argsort(rank, kind="stable")[: len(x) - needed(len(x)) + 1]].view(np.int64) if len(x) else x.view(np.int64))
                    bits.append(parity_bits(x).tobytes())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts), pa.int64())), pa.array(bits, pa.binary())],
                    ["x", "n", "firsts", "bits"],
                )
            tidy()


def _folded(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def undivided(sizes: np.ndarray, bitmaps: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that it may be connected with by links, as far as sizes and bitmaps tell."""
    root = np.full(len(sizes), -1, np.int64)
    widths = np.array([len(b) for b in bitmaps])
    groups = {}
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        rows = np.stack([bitmaps[i] for i in at])
        groups[w] = (at, rows, _folded(rows) if w > 1 else rows)
    where = np.zeros(len(sizes), np.int64)
    for at, _, _ in groups.values():
        where[at] = np.arange(len(at))
    open_ = {w: np.ones(len(g[0]), bool) for w, g in groups.items()}
    for first in range(len(sizes)):
        if root[first] >= 0:
            continue
        root[first] = first
        open_[widths[first]][where[first]] = False
        queue = [first]
        while queue:
            x = queue.pop()
            w = int(widths[x])
            for v in (w // 2, w, 2 * w):
                if v not in groups or not open_[v].any():
                    continue
                at, rows, halves = groups[v]
                left = np.flatnonzero(open_[v])
                n = sizes[at[left]]
                fit = (np.minimum(n, sizes[x]) * 100 >= np.maximum(n, sizes[x]) * PERCENT)
                left, n = left[fit], n[fit]
                if not len(left):
                    continue
                own = groups[w][1][where[x]] if v >= w else groups[w][2][where[x]]
                other = rows if v <= w else halves
                # A link needs |A xor B| <= (|A| + |B|) (1 - s) / (1 + s).
                apart = np.bitwise_count(other[left] ^ own).sum(axis=1, dtype=np.int64)
                near = left[apart * (100 + PERCENT) <= (n + sizes[x]) * (100 - PERCENT)]
                open_[v][near] = False
                root[at[near]] = first
                queue += at[near].tolist()
    return root


def _block_links(table: pa.Table) -> pa.Table:
    """Links (a, b) that may hold, from each member of a block to the first of its part."""
    ids = table["x"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, sizes = ids[order], table["n"].to_numpy()[order]
    raw = table["bits"].to_pylist()
    root = undivided(sizes, [np.frombuffer(raw[i], np.uint64) for i in order])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[root[moved]], pa.int64())})


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b) reaches.

    Each round gives a node the least root around it, then its root's root; both
    are joins and sums that combine before the shuffle.
    """
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    roots = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        around = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(around, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        lower = checkpointed(lower)
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        stepped = lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "old")
        roots = checkpointed(stepped)
        if roots.filter("root <> old").isEmpty():
            return roots.select("node", "root")


def _similar(shared: np.ndarray, n: np.ndarray, m) -> np.ndarray:
    return shared * 100 >= PERCENT * (n + m - shared)


def searched_components(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that it is connected with by links, for cells that pivots do not split.

    A breadth-first search over an inverted index: a set that was reached is a pivot for the
    sets that were not. It can reach only those whose distance from the search's
    first pivot is within the threshold of its own (triangle inequality).
    """
    total = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(total), sizes)
    words = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    root = np.full(total, -1, np.int64)

    def index(alive: np.ndarray):
        keep = alive[owner]
        order = np.argsort(words[keep], kind="stable")
        return owner[keep][order], np.searchsorted(words[keep][order], np.arange(words.max() + 2))

    alive = np.ones(total, bool)
    indexed = total
    posts, offsets = index(alive)
    far = 1 - PERCENT / 100 + 1e-9
    for first in range(total):
        if root[first] >= 0:
            continue
        queue, distance = [first], None
        root[first], alive[first] = first, False
        while queue:
            x = queue.pop()
            rest = int(alive.sum())
            if not rest:
                break
            if distance is not None and not (alive & (np.abs(distance - distance[x]) <= far)).any():
                continue
            if rest * 2 < indexed:
                posts, offsets = index(alive)
                indexed = rest
            own = words[ends[x] - sizes[x] : ends[x]]
            a, b = offsets[own], offsets[own + 1]
            n = b - a
            flat = posts[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            shared = np.bincount(flat, minlength=total)
            if distance is None:
                distance = 1 - shared / (sizes + sizes[x] - shared)
                distance[~alive] = 1 - PERCENT / 100  # those of other searches are compared with nothing
                distance[x] = 0
            near = np.flatnonzero(alive & _similar(shared, sizes, sizes[x]))
            root[near], alive[near] = first, False
            queue += near.tolist()
    return root


def pivot_distances(flat: np.ndarray, sizes: np.ndarray, pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every set from every pivot, and whether they link; ``flat`` has the sets' sorted shingles one after another."""
    starts = np.cumsum(sizes) - sizes
    distance, linked = np.empty((len(sizes), len(pivots))), np.empty((len(sizes), len(pivots)), bool)
    for j, p in enumerate(pivots):
        held = p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat
        shared = np.add.reduceat(held, starts, dtype=np.int64) if len(starts) else starts
        distance[:, j] = 1 - shared / (sizes + len(p) - shared)
        linked[:, j] = _similar(shared, sizes, len(p))
    return distance, linked


def voronoi_cells(distance: np.ndarray) -> list[np.ndarray]:
    """The members of each pivot's cell that still have to be compared.

    With t the threshold and d the distance from the nearest pivot, a document goes to
    every pivot within d + 2 t: two that link meet in the cell of either's nearest
    pivot. Inside a cell, those within t of the pivot are connected by it; the others
    can only link with documents within t of the nearest other's distance, or beyond.
    """
    far, slack = 1 - PERCENT / 100, 1e-9
    nearest = distance.min(axis=1)
    cells = []
    for d in distance.T:
        inside = np.flatnonzero(d <= nearest + 2 * far + slack)
        others = d[inside][d[inside] > far + slack]
        cells.append(inside[d[inside] >= others.min() - far - slack] if len(others) else inside[:0])
    return cells


def exact_components(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that it is connected with by links: Voronoi cells of cells, until they are small."""
    sizes = np.array([len(x) for x in sets], np.int64)
    root = np.arange(len(sets))

    def connect(members: np.ndarray, to: np.ndarray) -> None:
        """Joins each member's tree with that of its partner."""
        for x, y in zip(members.tolist(), to.tolist(), strict=True):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            root[max(x, y)] = min(x, y)

    def roots(members: np.ndarray) -> np.ndarray:
        up = root[members]
        while (root[up] != up).any():
            up = root[up]
        return up

    rng, open_ = np.random.default_rng(len(sets)), [np.arange(len(sets))]
    while open_:
        cell = open_.pop()
        if len(cell) < 2 or (roots(cell) == roots(cell[:1])).all():
            continue
        cells = None
        if len(cell) > LEAF:
            pivots = rng.choice(len(cell), PIVOTS, replace=False)
            distance, linked = pivot_distances(np.concatenate([sets[i] for i in cell]), sizes[cell], [sets[i] for i in cell[pivots]])
            member, pivot = np.nonzero(linked)
            connect(cell[member], cell[pivots[pivot]])
            # Pivots are compared with the whole cell now.
            rest = np.setdiff1d(np.arange(len(cell)), pivots)
            cells = [cell[rest[own]] for own in voronoi_cells(distance[rest])]
            cell = cell[rest]
        if cells is None or sum(len(c) ** 2 for c in cells) > STUCK * len(cell) ** 2:
            connect(cell, cell[searched_components([sets[i] for i in cell])])
        else:
            open_ += cells
    return roots(np.arange(len(sets)))


def _region_links(table: pa.Table) -> pa.Table:
    """Links that connect the region's members exactly as all its links do."""
    ids = table["x"].to_numpy()
    order = np.argsort(ids, kind="stable")
    raw = table["items"].to_pylist()
    root = exact_components([np.frombuffer(raw[i], np.uint64) for i in order])
    ids = ids[order]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[root[moved]], pa.int64())})


_CELLS = "cell string, x bigint, items binary, distance double, above double, link bigint"


def _cells(key: tuple, members: pa.Table, pivots: pa.Table) -> pa.Table:
    """Of some members of a region and its pivots: links to pivots, and memberships of cells with the distance from the cell's pivot."""
    far, region, names = 1 - PERCENT / 100, key[0].as_py(), pivots["px"].to_numpy()
    raw, xs, above = members["items"].to_pylist(), members["x"].to_numpy(), members["weight"].to_numpy()
    distance, linked = pivot_distances(np.frombuffer(b"".join(raw), np.uint64), np.array([len(r) // 8 for r in raw], np.int64), [np.frombuffer(p, np.uint64) for p in pivots["pitems"].to_pylist()])
    member, pivot = np.nonzero(linked & (xs[:, None] != names))
    links = pa.table({"cell": pa.nulls(len(member), pa.string()), "x": pa.array(xs[member], pa.int64()), "items": pa.nulls(len(member), pa.binary()), "distance": pa.nulls(len(member), pa.float64()), "above": pa.nulls(len(member), pa.float64()), "link": pa.array(names[pivot], pa.int64())})
    near = distance <= distance.min(axis=1)[:, None] + 2 * far + 1e-9
    near[np.isin(xs, names)] = False  # compared with the whole region now
    member, pivot = np.nonzero(near)
    inside = pa.table({"cell": pa.array([f"{region}/{n}" for n in names[pivot].tolist()], pa.string()), "x": pa.array(xs[member], pa.int64()), "items": pa.array([raw[i] for i in member.tolist()], pa.binary()), "distance": pa.array(distance[member, pivot], pa.float64()), "above": pa.array(above[member], pa.float64()), "link": pa.nulls(len(member), pa.int64())})
    return pa.concat_tables([links, inside])


def _small(table: DataFrame) -> DataFrame:
    """A table of at most MAX_BROADCAST_IDS keys is broadcast: the rows of a large region stay where they are."""
    return F.broadcast(table) if few(table, MAX_BROADCAST_IDS) else table


def joined_regions(members: DataFrame) -> list[DataFrame]:
    """Link tables (a, b) from regions (region, x, items): small ones joined in a task, others split by pivots, as ``voronoi_cells`` says, until none is left."""
    found, link, far, depth = [], "a bigint, b bigint", 1 - PERCENT / 100, 0
    weight = F.sum(F.octet_length("items") / 8)
    while True:
        large = checkpointed(members.groupBy("region").agg(weight.alias("weight"), F.count("*").alias("n")).filter((F.col("weight") > MAX_REGION) & (F.col("n") > 2 * PIVOTS)).select(F.col("region").alias("r"), "weight"))
        none = large.isEmpty()
        large = large if none else _small(large)
        small = members if none else members.join(large, F.col("region") == F.col("r"), "left_anti")
        found.append(small.select("region", "x", "items").groupBy("region").applyInArrow(_region_links, link))
        if none:
            return found
        # A large region goes in parts, each with all of its pivots: the members with the least hash of each slot.
        parts = (F.floor(F.col("weight") / F.lit(PART_SHINGLES)) + 1).cast("int")
        split = members.join(large, F.col("region") == F.col("r")).select("region", "x", "items", "weight", parts.alias("parts"))
        least = split.groupBy("region", "parts", F.pmod(F.xxhash64("x"), F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(F.xxhash64("x", F.lit(depth)).alias("h"), "x", "items")).alias("m"))
        pivots = least.select(F.col("region").alias("pr"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pp"), F.col("m.x").alias("px"), F.col("m.items").alias("pitems"))
        dealt = split.select("region", F.pmod(F.hash("x"), F.col("parts")).alias("part"), "x", "items", "weight")
        cells = checkpointed(dealt.groupBy("region", "part").cogroup(pivots.groupBy("pr", "pp")).applyInArrow(_cells, _CELLS))
        found.append(cells.filter("link IS NOT NULL").select(F.col("x").alias("a"), F.col("link").alias("b")))
        inside = cells.filter("cell IS NOT NULL")
        others = checkpointed(inside.filter(F.col("distance") > far + 1e-9).groupBy(F.col("cell").alias("c")).agg(F.min("distance").alias("d")))
        beside = checkpointed(inside.join(_small(others), F.col("cell") == F.col("c")).filter(F.col("distance") >= F.col("d") - far - 1e-9).select(F.col("cell").alias("region"), "x", "items", "above"))
        # Regions whose cells have too many of its pairs left: any two of its parts meet in a task instead.
        parent = F.regexp_replace("region", "/[^/]*$", "")
        stuck = beside.groupBy("region").agg(weight.alias("w"), F.max("above").alias("above")).groupBy(parent.alias("s")).agg(F.sum(F.col("w") * F.col("w")).alias("left"), F.max("above").alias("above"))
        stuck = checkpointed(stuck.filter(F.col("left") > STUCK * F.col("above") * F.col("above")).select("s"))
        members = beside.select("region", "x", "items")
        if not stuck.isEmpty():
            stuck = _small(stuck)
            members = checkpointed(members.join(stuck, parent == F.col("s"), "left_anti"))
            halves = split.join(stuck, F.col("region") == F.col("s"), "left_semi").withColumn("k", F.ceil(F.col("weight") * 2 / F.lit(MAX_REGION)).cast("int")).withColumn("p", F.pmod(F.hash("x"), F.col("k")))
            met = halves.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).filter("p <> q").select(F.concat_ws(" ", "region", F.least("p", "q"), F.greatest("p", "q")).alias("region"), "x", "items")
            found.append(met.groupBy("region").applyInArrow(_region_links, link))
        depth += 1


def component_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For (doc_id bigint, text) without repeated or null ids: the sets (doc_id, n, key), the classes (key, rep), and (node, root) of linked classes."""
    spark = docs.sparkSession
    seen = checkpointed(docs.mapInArrow(summarised, _SETS))
    sets = seen.filter("part IS NULL").select("doc_id", "n", "key")
    classes = checkpointed(sets.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep")))
    sketch = frequency_sketch(seen.filter("part IS NOT NULL").select("part", "counts"))
    here = shipped(spark, Blocker(sketch))

    def rows(batches):
        return here().rows(batches)

    # A copy that is left among the representatives only links with its own.
    blocked = _narrowed(docs, classes.select(F.col("rep").alias("doc_id"))).mapInArrow(rows, "x bigint, n bigint, firsts array<bigint>, bits binary")
    blocks = checkpointed(blocked.filter("n > 0"))
    # Of those that have a shingle first, ordered by size, one much larger than the last begins a group of its own; one alone joins nothing.
    alike = Window.partitionBy("s").orderBy("n", "x")
    firsts = blocks.select("x", "n", F.explode("firsts").alias("s")).withColumn("last", F.lag("n").over(alike))
    heads = firsts.withColumn("head", F.when(F.col("last").isNull() | (F.col("n") * PERCENT > F.col("last") * 100), F.col("x")))
    pivots = heads.withColumn("pivot", F.last("head", ignorenulls=True).over(alike.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pairs = checkpointed(pivots.filter("x <> pivot").select("pivot", "x", "n").distinct())
    wide = checkpointed(pairs.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("n").alias("n")).filter((F.col("m") > MAX_BLOCK) | (F.col("n") > MAX_BLOCK_SHINGLES)).select(F.col("pivot").alias("wide")))
    pairs = pairs.select("pivot", "x")
    members = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("x")).distinct())
    narrow = members if wide.isEmpty() else members.join(wide, F.col("pivot") == F.col("wide"), "left_anti")
    possible = narrow.join(blocks.select("x", "n", "bits"), "x").groupBy("pivot").applyInArrow(_block_links, "a bigint, b bigint")
    if narrow is not members:
        possible = possible.unionByName(pairs.join(wide, F.col("pivot") == F.col("wide"), "left_semi").select(F.col("x").alias("a"), F.col("pivot").alias("b")))
    regions = connected(possible)

    def items(batches):
        for batch in batches:
            for ids, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in shingle_sets(texts)], pa.binary())], ["x", "items"])
            tidy()

    linked = regions.select(F.col("node").alias("doc_id"))
    found = _narrowed(docs, linked).mapInArrow(items, "x bigint, items binary")
    whole = checkpointed(found.join(regions, F.col("x") == F.col("node")).select(F.col("root").cast("string").alias("region"), "x", "items"))
    links = None
    for part in joined_regions(whole):
        links = part if links is None else links.unionByName(part)
    return sets, classes, connected(links)


def _numbered(docs: DataFrame, doc_id: str) -> tuple[DataFrame, bool]:
    """``docs`` with ``__row``, a number of its own for every row, and whether that is the id.

    Ids that repeat, are null or are no integers cannot tell rows apart; such a table is written once with numbers.
    """
    ids = docs.select(F.col(doc_id).alias("i"))
    if ids.dtypes[0][1] in ("tinyint", "smallint", "int", "bigint") and ids.groupBy("i").count().filter("i IS NULL OR count > 1").isEmpty():
        return docs.withColumn("__row", F.col(doc_id).cast("bigint")), True
    return stored(docs.withColumn("__row", F.monotonically_increasing_id())), False


def _row_components(numbered: DataFrame, text: str) -> DataFrame:
    """(row, n, key, root): the least row of every row's component; a row without shingles is its own."""
    sets, classes, roots = component_roots(numbered.select(F.col("__row").alias("doc_id"), F.col(text).cast("string").alias("text")))
    reached = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("k"), F.coalesce("root", "rep").alias("root"))
    return sets.join(reached, F.col("key") == F.col("k"), "left").select(F.col("doc_id").alias("row"), "n", "key", F.coalesce("root", "doc_id").alias("root"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    ``component_id`` is the least id among the rows that links reach, null if none of
    them has an id. Null or blank text has no shingles and links with nothing; a text of
    fewer than five words is one shingle; rows are told apart also where they share an
    id, and repeated rows link like other copies; an empty table gives no rows.
    """
    numbered, plain = _numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    found = _row_components(numbered, "text")
    if plain:
        return found.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    own = checkpointed(found.join(numbered.select(F.col("__row").alias("row"), "doc_id"), "row"))
    least = own.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"))
    return own.join(least, F.col("root") == F.col("r")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``, that with the least id, in their own columns.

    Rows without words stay, as they link with nothing. Rows that share an id, or have
    none, are judged each by its own text; where even the ids of a component's rows
    are alike or null, one of them stays. An empty table gives no rows.
    """
    columns = docs.columns
    at = {name: f"c{i}" for i, name in enumerate(columns)}
    numbered, plain = _numbered(docs.toDF(*at.values()), at[doc_id])
    found = checkpointed(_row_components(numbered, at[text]))
    if plain:
        gone = found.filter("root <> row").select(F.col("row").alias("__gone"))
    else:
        own = found.join(numbered.select(F.col("__row").alias("row"), F.col(at[doc_id]).alias("id")), "row")
        first = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("m"))
        gone = own.join(first.select(F.col("root").alias("r"), F.col("m.row").alias("stays")), F.col("root") == F.col("r")).filter("row <> stays").select(F.col("row").alias("__gone"))
    if few(gone, MAX_BROADCAST_IDS):
        kept = numbered.join(F.broadcast(gone), F.col("__row") == F.col("__gone"), "left_anti")
    else:
        # What a Bloom filter says stays; of what it says goes, only ids are joined, to find those that stay nevertheless.
        made = marks(gone)
        stay = found.select(F.col("row").alias("__stays")).join(gone, F.col("__stays") == F.col("__gone"), "left_anti")
        stay = checkpointed(stay.filter(marked(docs.sparkSession, made, F.col("__stays"))))
        told = numbered.withColumn("__told", marked(docs.sparkSession, made, F.col("__row")))
        kept = told.join(_small(stay), F.col("__row") == F.col("__stays"), "left").filter("NOT __told OR __stays IS NOT NULL")
    return kept.select(*(F.col(at[c]).alias(c) for c in columns))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract query 9: the component of every document."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
