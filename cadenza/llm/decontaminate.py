"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a bounded slice of the texts. Its word sequence becomes a suffix array;
every distinct window of the benchmark is found in it by binary search, once,
however many items hold it, which gives all its places. From each place the longest
verbatim match with any item is found by binary search among the items' own suffixes.
Words that no item has end a run: a suffix that starts in a run shorter than every
window cannot match, so the array holds only the other suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import alnum_words, checkpointed, shipped, slices, stored, tidy

#: Words of a window; a shorter item is one window.
WINDOW = 10

#: Benchmark words that are sent to the tasks at once; a larger benchmark goes in blocks, one pass each.
BLOCK_WORDS = 1_000_000

#: Item names and spans that one batch of results holds, beyond its first row.
ROWS_OUT = 100_000

_SHARD = 4 << 20
_STRIDE = 32
_SPAN = "item string, item_start bigint, doc_start bigint, n_words bigint"
_SPANS = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of what follows them, at least to ``depth`` words, by prefix doubling."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth and rank.max(initial=0) + 1 < len(rank):
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:] + 1
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return np.argsort(rank, kind="stable")


class Items:
    """A block of benchmark items: word numbers, the order of all suffixes, and the distinct windows with the items that hold them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.names, texts = [], []
        for name, text in items:
            if words := alnum_words(text):
                self.names.append(name)
                texts.append(words)
        self.window = window
        self.number: dict[bytes, int] = {}
        flat = [self.number.setdefault(w, len(self.number) + 1) for t in texts for w in t]
        lengths = np.array([len(t) for t in texts], np.int64)
        sizes = np.minimum(lengths, window)
        self.least = int(sizes.min(initial=window))
        # Zeros behind the last word, so that reads past an item's end compare as smaller.
        self.words = np.array([*flat, *[0] * _STRIDE], np.int32)
        owner = np.repeat(np.arange(len(texts)), lengths)
        starts = np.cumsum(lengths) - lengths
        offset = np.arange(len(flat)) - starts[owner] if len(flat) else np.zeros(0, np.int64)
        left = lengths[owner] - offset if len(flat) else np.zeros(0, np.int64)
        # Suffixes that are long enough for a window, in order; each item is followed by a mark that no word has.
        ended = np.zeros(len(flat) + len(texts), np.int64)
        ended[np.arange(len(flat)) + owner] = flat
        order = suffix_array(ended, int(lengths.max(initial=0)) + 1)
        at = np.full(len(ended), -1, np.int64)
        at[np.arange(len(flat)) + owner] = np.arange(len(flat))
        order = at[order][at[order] >= 0]
        order = order[left[order] >= sizes[owner[order]]]
        # Windows by size, then by words: equal ones are neighbours, and one number.
        order = order[np.argsort(sizes[owner[order]], kind="stable")]
        size = sizes[owner[order]]
        told = np.zeros(len(order), bool)
        if len(order):
            told[0] = True
            shared = self.common(order[1:], self.words, order[:-1], size[1:])[0]
            told[1:] = (shared < size[1:]) | (size[1:] != size[:-1])
        self.order, self.item, self.offset, self.left = order, owner[order], offset[order], left[order]
        self.first = np.flatnonzero(told)
        self.end = np.append(self.first[1:], len(order))
        self.size = size[self.first]
        # The distinct items of each window, in one list.
        number = np.cumsum(told) - 1
        pairs = np.unique(number * max(1, len(texts)) + self.item) if len(order) else np.zeros(0, np.int64)
        self.holders = pairs % max(1, len(texts))
        self.held = np.searchsorted(pairs // max(1, len(texts)), np.arange(len(self.first) + 1))

    def common(self, suffixes: np.ndarray, shard: np.ndarray, places: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that each suffix of the items shares with a place, up to its limit, and whether the place's text sorts before it there."""
        shared, below = np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), bool)
        open_ = np.arange(len(suffixes))
        step = np.arange(_STRIDE)
        while len(open_):
            done = shared[open_]
            s = (suffixes[open_] + done)[:, None] + step
            p = (places[open_] + done)[:, None] + step
            a = self.words[np.minimum(s, len(self.words) - 1)]
            b = shard[np.minimum(p, len(shard) - 1)]
            room = (limit[open_] - done)[:, None] > step
            differs = ~room | (a != b)
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), _STRIDE)
            shared[open_] += first
            ended = first < _STRIDE
            rows = np.flatnonzero(ended)
            inside = room[rows, first[rows]]
            below[open_[rows]] = inside & (b[rows, first[rows]] < a[rows, first[rows]])
            open_ = open_[~ended]
        return shared, below

    def bound(self, windows: np.ndarray, shard: np.ndarray, order: np.ndarray, after: bool) -> np.ndarray:
        """Binary search: where each window would stand in the shard's suffix array; ``after`` its equals or before them."""
        suffixes, limit = self.order[self.first[windows]], self.size[windows]
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order))
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            shared, below = self.common(suffixes[open_], shard, order[mid], limit[open_])
            up = below | (shared >= limit[open_]) if after else below
            low[open_[up]] = mid[up] + 1
            high[open_[~up]] = mid[~up]
        return low

    def longest(self, windows: np.ndarray, shard: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a place of each window: the longest match with an item that holds the window, and that suffix' number in ``order``."""
        low, high = self.first[windows].copy(), self.end[windows].copy()
        start, size = low.copy(), self.size[windows]
        # An item of fewer words than a window is matched whole.
        high = np.where(size < self.window, low, high)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            _, below = self.common(self.order[mid], shard, places[open_], self.left[mid])
            low[open_[~below]] = mid[~below] + 1
            high[open_[below]] = mid[below]
        best, which = size.copy(), start.copy()
        for near in (low - 1, low):
            ok = np.flatnonzero((near >= start) & (near < self.end[windows]) & (size >= self.window))
            shared = self.common(self.order[near[ok]], shard, places[ok], self.left[near[ok]])[0]
            more = shared > best[ok]
            best[ok[more]], which[ok[more]] = shared[more], near[ok[more]]
        return best, which

    def matches(self, docs: list[list[bytes]]) -> tuple[list[list[dict]], list[np.ndarray]]:
        """For each document its maximal verbatim matches that hold a window (one item that has it, its start there, start here, words), and the numbers of the distinct windows that it holds."""
        none: tuple[list[list[dict]], list[np.ndarray]] = ([[] for _ in docs], [np.zeros(0, np.int64)] * len(docs))
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        total = int(lengths.sum())
        if not total or not len(self.first):
            return none
        get = self.number.get
        ids = np.fromiter((get(w, 0) for d in docs for w in d), np.int32, total)
        owner = np.repeat(np.arange(len(docs)), lengths)
        starts = np.cumsum(lengths) - lengths
        # Runs of known words inside one document.
        known = ids > 0
        breaks = np.flatnonzero(np.diff(np.where(known, owner, -1), prepend=-2, append=-2))
        run_starts, run_ends = breaks[:-1], breaks[1:]
        usable = known[run_starts] & (run_ends - run_starts >= self.least)
        run_starts, run_ends = run_starts[usable], run_ends[usable]
        if not len(run_starts):
            return none
        size = run_ends - run_starts
        base = np.repeat(np.cumsum(size + 1) - size - 1, size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text_at = np.repeat(run_starts, size) + inner
        slot = base + inner
        shard = np.zeros(int((size + 1).sum()), np.int32)
        shard[slot] = ids[text_at]
        source = np.full(len(shard), -1, np.int64)
        source[slot] = text_at
        order = suffix_array(shard, self.window)
        order = order[source[order] >= 0]

        # Windows of which the shard lacks a word need no search.
        here = np.zeros(len(self.number) + 1, bool)
        here[shard] = True
        here[0] = False
        lacks = np.append(0, np.cumsum(~here[self.words]))
        suffix = self.order[self.first]
        windows = np.flatnonzero(lacks[suffix + self.size] == lacks[suffix])
        low, high = (self.bound(windows, shard, order, after) for after in (False, True))
        times = high - low
        window = np.repeat(windows, times)
        if not len(window):
            return none
        place = order[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        n_words, which = self.longest(window, shard, place)
        hit = source[place]
        doc = owner[hit]
        # A match that an earlier one of the same document covers is no maximal one; at one place the longest comes first.
        ranked = np.lexsort((which, -n_words, hit))
        ends = (hit + n_words)[ranked]
        before = np.append(-1, np.maximum.accumulate(ends)[:-1])
        found: list[list[dict]] = [[] for _ in docs]
        for k in ranked[ends > before].tolist():
            d, w = int(doc[k]), int(which[k])
            found[d].append({"item": self.names[self.item[w]], "item_start": int(self.offset[w]), "doc_start": int(hit[k] - starts[d]), "n_words": int(n_words[k])})
        own = np.unique(doc * len(self.first) + window)
        cuts = np.searchsorted(own // len(self.first), np.arange(len(docs) + 1))
        own %= len(self.first)
        return found, [own[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The distinct ids of the items that hold any of the windows, in order; null ids are left out."""
        rows = np.unique(np.concatenate([self.holders[self.held[w] : self.held[w + 1]] for w in windows.tolist()] or [np.zeros(0, np.int64)]))
        return sorted({n for n in map(self.names.__getitem__, rows.tolist()) if n is not None})

    def searched(self, texts: pa.Array) -> Iterator[tuple[int, int, list[int], list[list[dict]], list[np.ndarray]]]:
        """By slices (from, to): the words of each text, its spans and its windows."""
        for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _SHARD):
            docs = [alnum_words(t) for t in texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()]
            yield (a, b, list(map(len, docs)), *self.matches(docs))

    def reports(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (..., text): the other columns with n_words, spans and items; so few rows at once that what they list stays bounded."""
        known: dict[bytes, list[str]] = {}
        kept = 0
        for batch in batches:
            texts, rest = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
            for a, b, counts, spans, windows in self.searched(texts):
                start, listed, items = 0, 0, []
                for i, own in enumerate(windows):
                    key = own.tobytes()
                    if key not in known:
                        if kept > ROWS_OUT:
                            known.clear()
                            kept = 0
                        known[key] = self.items_of(own)
                        kept += 1 + len(known[key])
                    if listed and listed + len(known[key]) + len(spans[i]) > ROWS_OUT:
                        yield self._batch(rest.slice(a + start, i - start), counts[start:i], spans[start:i], items)
                        start, listed, items = i, 0, []
                    items.append(known[key])
                    listed += len(known[key]) + len(spans[i])
                yield self._batch(rest.slice(a + start, b - a - start), counts[start:], spans[start:], items)
            tidy()

    @staticmethod
    def _batch(rest: pa.RecordBatch, counts: list[int], spans: list[list[dict]], items: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rest.columns, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], [*rest.schema.names, "n_words", "spans", "items"])

    def held_by(self, texts: pa.Array) -> pa.Array:
        """Whether each text holds a window."""
        return pa.array([len(w) > 0 for _, _, _, _, windows in self.searched(texts) for w in windows], pa.bool_())


def item_blocks(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark, a bounded number of words at a time, read row by row."""
    block, words = [], 0
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        item = (r["t"] or "").encode("utf-8", "surrogatepass")
        n = len(alnum_words(item))
        if block and words + n > most:
            yield Items(block)
            block, words = [], 0
        block.append((r["i"], item))
        words += n
    yield Items(block)


def _reported(rows: DataFrame, items: Items) -> DataFrame:
    """``rows``, whose last column is the text, with n_words, spans and items in its place."""
    here = shipped(rows.sparkSession, items)

    def reports(batches):
        return here().reports(batches)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(reports, f"{kept}, n_words bigint, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>, items array<string>")


def hit_words(spans: Column) -> Column:
    """How many words the spans cover together."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["doc_start"].alias("a"), (s["doc_start"] + s["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(ordered, zero, lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")), lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, longest, spans, contaminated) for every row.

    ``spans`` are the maximal verbatim matches that hold a window, each with one of the
    items that have it; ``items`` are the ids of all items with a window in the text.
    Null or empty text has no words and is clean; an item without words matches
    nothing; an item whose id is null contaminates, but is in no list of items;
    repeated rows and items are all kept; empty tables give no rows, or clean ones.
    Nothing is shuffled while the benchmark fits into one block. With more, the texts
    are searched once for each, and what they hold meets by 128 bits of the text's hash.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(128), "text").alias("k2"), "text")
    parts, found = [], None
    for items in item_blocks(benchmark, item_id, item_text, block_words):
        if found is not None:
            parts.append(checkpointed(found.filter(F.size("spans") > 0).select("k1", "k2", "spans", "items").dropDuplicates(["k1", "k2"])))
        found = _reported(keyed, items)
    if parts:
        rest = parts[0]
        for p in parts[1:]:
            rest = rest.unionByName(p)
        rest = rest.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("others"))
        none = lambda c, like: F.coalesce(F.col(c), F.filter(F.col(like), lambda _: F.lit(False)))
        found = found.join(rest, ["k1", "k2"], "left").select("doc_id", "n_words", F.concat("spans", none("more", "spans")).alias("spans"), F.array_sort(F.array_distinct(F.concat("items", none("others", "items")))).alias("items"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_words"])), F.lit(0).cast("bigint")).alias("longest"),
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, in their own columns.

    Null or empty text is clean, repeated rows are judged alike, and an empty table
    or benchmark takes nothing away. With more than one block, what a block leaves is
    written before the next is searched.
    """
    columns = docs.columns
    inner, first = docs.toDF(*(f"c{i}" for i in range(len(columns)))), True
    own = F.col(f"c{columns.index(text)}").cast("string")
    for items in item_blocks(benchmark, "item_id", "text", block_words):
        inner = (inner if first else stored(inner)).filter(~_holds(docs.sparkSession, items, own))
        first = False
    return inner.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def _holds(spark, items: Items, text: Column) -> Column:
    here = shipped(spark, items)

    def held(t: pa.Array) -> pa.Array:
        told = here().held_by(t)
        tidy()
        return told

    return F.arrow_udf(held, "boolean")(text)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query 2: benchmark windows in every document."""
    rows = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
w AS (SELECT k, i, words[i] AS w FROM (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
dw AS (SELECT k, i, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM d), sizes WHERE i + size - 1 <= len(words)),
m AS (SELECT k, i, size, item_id FROM dw JOIN bw USING (size, win)),
h AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT k, i, size FROM m)) GROUP BY k),
t AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""
