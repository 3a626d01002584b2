"""Language-model scores: a unigram base, and prediction by partial matching over bytes.

One pass over the texts counts the tokens of each chunk of documents and the byte
sequences of the training documents. What a chunk's documents hold stays together in
one row; only (token, chunk, number in the chunk) is shuffled, gets the token's count in
the whole corpus, and goes back to the chunk, which adds up its documents' base scores:
no vocabulary is collected or broadcast, and a token that all documents have is a row
a chunk.

The byte model is a trie of contexts up to ORDER bytes, with every context that the
training documents have. Escapes are estimated by the number of distinct symbols
(method D: each gives up half a count), and symbols that a longer context could have coded are excluded from
the shorter ones. The trie is frozen after training, so a text's code length is a
sum over its positions, and positions that are alike are looked up once. If there are
more contexts than one part of the model may hold, they are split by a hash of their
last bytes, the texts are scored part by part and the sums added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import checkpointed, id_remainder, shipped, slices, spaced_words, stored, tidy

#: Bytes of the longest context; six at most, as a context and a symbol are one number.
ORDER = 5

#: Entries (a longest context and a symbol after it) of one part of the model. More parts mean more passes, nothing is left out.
PART_ENTRIES = 3_000_000

#: Bytes by which contexts are dealt to parts.
DEALT = 3

#: Additive smoothing of the base score.
SMOOTHING = 0.1

#: Text of one chunk, in bytes, and its documents: a place in a chunk has 16 bits.
CHUNK_BYTES, CHUNK_DOCS = 12 << 20, 1 << 16
_SLICE = 2 << 20

#: Token that ends every text; no word can hold a line break. Symbol before and after every text.
END_TOKEN, EDGE = b"\n", 256
_ROWS_OUT = 50_000
_MIX = 2_654_435_761
_COLUMNS = "kind tinyint, token binary, chunk bigint, n bigint, place int, held binary"


def byte_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for every byte and end of every text, nine bits a symbol: the byte before it, the one before that and so on, then itself; and how many a text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = order + 1
    row = np.full(int(lengths.sum()) + gap * len(texts) + order, EDGE, np.int64)
    starts = np.cumsum(lengths) - lengths
    row[np.arange(lengths.sum()) + np.repeat(gap * np.arange(len(texts)) + order, lengths)] = np.frombuffer(b"".join(texts), np.uint8)
    n = len(row) - order
    codes = row[order:].copy()
    for j in range(1, order + 1):
        codes |= row[order - j : order - j + n] << (9 * (order + 1 - j))
    # Behind each text its end is a position, the other marks are not.
    keep = np.ones(n, bool)
    ends = np.cumsum(lengths + gap) - order
    for j in range(order):
        keep[ends[ends + j < n] + j] = False
    return codes[keep], lengths + 1


class Counter:
    """Counts one partition; rows come out at the end of every chunk."""

    def __init__(self, task: int, order: int):
        self.task, self.chunk, self.order = task, 0, order
        self.begin()

    def begin(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pairs: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.held: list[bool] = []
        self.tokens: list[int] = []
        self.codes = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.bytes = 0

    def add(self, texts: list[bytes], keys: np.ndarray, held: list[bool]) -> None:
        base = len(self.held)
        words = [spaced_words(t) for t in texts]
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        number = self.number
        flat = np.fromiter((number.setdefault(w, len(number)) for d in words for w in (*d, END_TOKEN)), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(base, base + len(texts)), lengths)
        found, times = np.unique(flat << 32 | owner, return_counts=True)
        self.pairs.append(np.stack([found, times]))
        self.keys.append(keys)
        self.held += held
        self.tokens += lengths.tolist()
        codes, counts = np.unique(byte_codes([t for t, h in zip(texts, held, strict=True) if not h], self.order)[0], return_counts=True)
        codes = np.concatenate([self.codes[0], codes])
        both, inverse = np.unique(codes, return_inverse=True)
        self.codes = both, np.bincount(inverse, np.concatenate([self.codes[1], counts]), len(both)).astype(np.int64)
        self.bytes += sum(map(len, texts))

    def rows(self) -> Iterator[pa.RecordBatch]:
        chunk = self.task << 20 | self.chunk
        self.chunk += 1
        held = np.array(self.held, bool)
        if len(held):
            pairs = np.concatenate(self.pairs, axis=1)
            pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
            token, doc, times = pairs[0] >> 32, pairs[0] & 0xFFFFFFFF, pairs[1]
            starts = np.searchsorted(token, np.arange(len(self.number)))
            train = np.add.reduceat(np.where(held[doc], 0, times), starts)
            parts = [np.concatenate(self.keys).astype(np.int64), np.array(self.tokens, np.int64), np.diff(starts, append=len(doc)).astype(np.int32), doc.astype(np.uint16), times.astype(np.uint32)]
            packed = np.array([len(held), len(starts), len(doc)], np.int64).tobytes() + b"".join(x.tobytes() for x in parts)
            yield self._batch(2, [None], [chunk], [len(held)], [0], [zlib.compress(packed, 1)])
            del pairs, token, doc, times, parts, packed
            words = list(self.number)
            for a in range(0, len(words), _ROWS_OUT):
                own = words[a : a + _ROWS_OUT]
                yield self._batch(0, own, [chunk] * len(own), train[a : a + _ROWS_OUT], np.arange(a, a + len(own)), [None] * len(own))
        codes, counts = self.codes
        for a in range(0, len(codes), _ROWS_OUT):
            part = codes[a : a + _ROWS_OUT]
            yield self._batch(1, [None] * len(part), part, counts[a : a + _ROWS_OUT], [0] * len(part), [None] * len(part))
        self.begin()

    @staticmethod
    def _batch(kind, token, chunk, n, place, held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(chunk), kind, np.int8)), pa.array(token, pa.binary()), pa.array(chunk, pa.int64()), pa.array(n, pa.int64()), pa.array(place, pa.int32()), pa.array(held, pa.binary())], ["kind", "token", "chunk", "n", "place", "held"]
        )


def _counted(order: int):
    """From (text, k1, k2, held): token rows, byte-code rows and one row of documents for every chunk; the order goes along with the function."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(TaskContext.get().partitionId(), order)
        for batch in batches:
            texts, held = batch.column(0), batch.column(3)
            keys = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _SLICE):
                for x in range(a, b, CHUNK_DOCS // 2):
                    n = min(b - x, CHUNK_DOCS // 2)
                    some = [t or b"" for t in texts.slice(x, n).cast(pa.large_binary()).to_pylist()]
                    counter.add(some, keys[x : x + n], held.slice(x, n).to_pylist())
                    if counter.bytes >= CHUNK_BYTES or len(counter.held) > CHUNK_DOCS // 2:
                        yield from counter.rows()
                        tidy()
        yield from counter.rows()
        tidy()

    return counted


_SUMS = "k1 bigint, k2 bigint, n_tokens bigint, n_known bigint, logs double, firsts bigint"


def _chunk_sums(documents: pa.Table, told: pa.Table) -> pa.Table:
    """Of one chunk: for every document its tokens, known tokens and summed log counts; ``firsts`` has the distinct training tokens that this chunk answers for."""
    raw = zlib.decompress(documents["held"][0].as_py())
    docs, words, pairs = np.frombuffer(raw, np.int64, 3).tolist()
    at, parts = 24, []
    for kind, n in ((np.int64, 2 * docs), (np.int64, docs), (np.int32, words), (np.uint16, pairs), (np.uint32, pairs)):
        parts.append(np.frombuffer(raw, kind, n, at))
        at += parts[-1].nbytes
    keys, tokens, sizes, doc, times = parts
    counts = np.zeros(words, np.int64)
    counts[told["place"].to_numpy()] = told["c"].to_numpy()
    logs = np.bincount(doc, times * np.repeat(np.log10(counts + SMOOTHING), sizes), docs)
    seen = np.bincount(doc, times * np.repeat(counts > 0, sizes), docs).astype(np.int64)
    firsts = np.zeros(docs, np.int64)
    firsts[0] = int(pc.sum(told["first"]).as_py() or 0)
    keys = keys.reshape(-1, 2)
    out = pa.table({"k1": pa.array(keys[:, 0], pa.int64()), "k2": pa.array(keys[:, 1], pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(seen, pa.int64()), "logs": pa.array(logs, pa.float64()), "firsts": pa.array(firsts, pa.int64())})
    tidy()
    return out


def base_scores(seen: DataFrame) -> tuple[DataFrame, int]:
    """(k1, k2, n_tokens, n_known, base_score), and the number of training tokens."""
    tokens = seen.filter("kind = 0").select("token", "chunk", "n", "place")
    counts = tokens.groupBy("token").agg(F.sum("n").alias("c"), F.min("chunk").alias("home"))
    told = tokens.join(counts, "token").select("chunk", "place", "c", ((F.col("c") > 0) & (F.col("chunk") == F.col("home"))).alias("first"))
    documents = seen.filter("kind = 2").select(F.col("chunk").alias("whole"), "held")
    sums = checkpointed(documents.groupBy("whole").cogroup(told.groupBy("chunk")).applyInArrow(_chunk_sums, _SUMS))
    total = tokens.agg(F.sum("n").alias("n")).first()["n"] or 0
    distinct = sums.agg(F.sum("firsts").alias("v")).first()["v"] or 0
    rest = F.log10(F.lit(total + SMOOTHING * (distinct + 1)))
    return sums.select("k1", "k2", "n_tokens", "n_known", (F.col("logs") - F.col("n_tokens") * rest).alias("base_score")), total


def part_of(dealt: np.ndarray, parts: int) -> np.ndarray:
    """Which part of the model has contexts with these last bytes; ``learned`` says the same to Spark."""
    return ((dealt * _MIX & 0xFFFFFFFF) >> 16) % parts


def escapes(total: np.ndarray, kinds: np.ndarray, left) -> np.ndarray:
    """Method D: the probability that a context's own symbols don't code the next one, half a count for each of them."""
    return np.where(kinds == 0, 1.0, np.where(kinds >= left, 0.0, kinds / np.maximum(2 * total, 1)))


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


class Trie:
    """The frozen byte model, or one of its parts.

    Of every length there are the contexts, sorted, and the entries (a context and a
    symbol after it), sorted, with the log10 of their counts less a half. A context has four numbers,
    log10 as well: its escape, what a count is worth in it, and the same two of the
    context one shorter when what this one has seen is excluded there. Exclusion needs
    no more, as a shorter context has seen all that a longer one has.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None, part: int = 0, parts: int = 1):
        """From the counts by code; ``low`` has those of all parts for contexts shorter than DEALT, by codes of that order."""
        self.order, self.part, self.parts = order, part, parts
        levels, (entries, times) = [], (codes, counts)
        for k in range(order, -1, -1):
            if low is not None and k == DEALT - 1:
                entries, times = low
            elif k < order:
                # The context one shorter: its farthest byte goes.
                entries = (entries >> 18 << 9) | (entries & 511)
            ranked = np.argsort(entries)
            entries, times = entries[ranked], times[ranked]
            del ranked
            first = np.flatnonzero(np.diff(entries, prepend=-1))
            if len(first) < len(entries):
                entries, times = entries[first], np.add.reduceat(times, first)
            fresh = np.diff(entries >> 9, prepend=-1) != 0
            contexts, row = entries[fresh] >> 9, np.cumsum(fresh, dtype=np.int32) - 1
            levels.append((contexts, row, entries, times, np.bincount(row, times, len(contexts)), np.bincount(row, minlength=len(contexts))))
        self.contexts, self.told, self.entries, self.logs = [], [], [], []
        above = None
        while levels:
            contexts, row, entries, times, total, kinds = levels.pop()
            escape = escapes(total, kinds, 257)
            told = np.zeros((len(contexts), 4), np.float32)
            told[:, 0], told[:, 1] = _log(escape), _log((1 - escape) / np.maximum(total - kinds / 2, 0.5))
            if above is not None:
                # The context one shorter without the symbols of this one.
                parents, their_entries, their_times, their_total, their_kinds = above
                parent = np.searchsorted(parents, contexts >> 9)
                at = np.searchsorted(their_entries, (entries >> 18 << 9) | (entries & 511))
                left = their_total[parent] - np.bincount(row, their_times[at], len(contexts))
                others = their_kinds[parent] - kinds
                escape = escapes(left, others, 257 - kinds)
                told[:, 2], told[:, 3] = _log(escape), _log((1 - escape) / np.maximum(left - others / 2, 0.5))
            above = contexts, entries, times, total, kinds
            self.contexts.append(contexts)
            self.told.append(told)
            self.entries.append(entries)
            self.logs.append(_log(times - 0.5).astype(np.float32))
        # A symbol that training has not seen is as likely as all others of that sort.
        self.unseen = float(-np.log10(max(1, 257 - len(self.entries[0]))))

    def coded(self, codes: np.ndarray) -> np.ndarray:
        """log10 probabilities of positions by their sorted distinct codes."""
        out = np.full(len(codes), -np.log10(257.0))
        # What a symbol costs in contexts shorter than the one in hand, without what that has seen.
        below, open_ = np.full(len(codes), self.unseen), np.arange(len(codes))
        before = np.full(len(codes), np.nan)
        for k, (contexts, told, entries, logs) in enumerate(zip(self.contexts, self.told, self.entries, self.logs, strict=True)):
            if not len(contexts):
                break
            short = codes[open_] >> 9 * (self.order - k + 1)
            at = np.minimum(np.searchsorted(contexts, short), len(contexts) - 1)
            seen = contexts[at] == short
            open_, short, own = open_[seen], short[seen], told[at[seen]]
            if k:
                found = before[open_]
                below[open_] = np.where(np.isnan(found), own[:, 2] + below[open_], own[:, 3] + found)
            whole = short << 9 | (codes[open_] & 511)
            at = np.minimum(np.searchsorted(entries, whole), len(entries) - 1)
            hit = entries[at] == whole
            before[open_] = np.where(hit, logs[at], np.nan)
            out[open_] = np.where(hit, own[:, 1] + logs[at], own[:, 0] + below[open_])
        return out

    def scores(self, texts: pa.Array) -> pa.Array:
        """log10 probability of every text and its end, as far as its contexts are this part's; null counts as empty."""
        out = []
        for x, y in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _SLICE):
            codes, sizes = byte_codes([t or b"" for t in texts.slice(x, y - x).cast(pa.large_binary()).to_pylist()], self.order)
            distinct, inverse = np.unique(codes, return_inverse=True)
            each = self.coded(distinct)
            if self.parts > 1:
                each[part_of(distinct >> 9 * (self.order - DEALT + 1), self.parts) != self.part] = 0
            out.append(np.add.reduceat(each[inverse], np.cumsum(sizes) - sizes))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())


def learned(seen: DataFrame, order: int = ORDER) -> Iterator[Trie]:
    """The parts of the trie of all byte counts; the driver holds one at a time."""
    codes = checkpointed(seen.filter("kind = 1").groupBy(F.col("chunk").alias("code")).agg(F.sum("n").alias("n")))
    parts = max(1, -(-codes.count() // PART_ENTRIES))

    def pair(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = rows.toArrow()  # columns as they are, whatever the session says of pandas
        return table["code"].to_numpy(), table["n"].to_numpy()

    if parts == 1:
        yield Trie(*pair(codes), order)
        return
    short = F.shiftright("code", 9 * (order - DEALT + 2)) * F.lit(512) + F.col("code").bitwiseAND(511)
    low = pair(codes.groupBy(short.alias("code")).agg(F.sum("n").alias("n")))
    dealt = F.shiftright((F.shiftright("code", 9 * (order - DEALT + 1)) * F.lit(_MIX)).bitwiseAND(F.lit(0xFFFFFFFF)), 16) % parts
    for part in range(parts):
        yield Trie(*pair(codes.filter(dealt == part)), order, low, part, parts)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 10, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Documents whose crc32(id) mod ``modulus`` is 0 are held out, the others are what
    both models learn from. Null text is scored as empty: one end token. Without
    training documents every token is unknown and bytes are equally likely. Rows that
    are the same in id and text score alike; ids may be of any type, null or repeated;
    an empty table gives no rows.
    """
    inner = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    held = id_remainder(F.col("id"), modulus) == 0
    name, whole = F.col("id").cast("string"), F.coalesce("text", F.lit(""))
    keyed = inner.withColumns({"k1": F.xxhash64(name, whole), "k2": F.xxhash64(F.lit(128), name, whole), "held_out": held})
    seen = stored(keyed.select("text", "k1", "k2", "held_out").mapInArrow(_counted(order), _COLUMNS))
    base, total = base_scores(seen)

    def scored(trie: Trie) -> Column:
        here = shipped(docs.sparkSession, trie)

        def score(t: pa.Array) -> pa.Array:
            told = here().scores(t)
            tidy()
            return told

        return F.arrow_udf(score, "double")("text")

    own, sums = keyed, None
    for trie in learned(seen, order):
        if trie.parts == 1:
            own = own.withColumn("score", scored(trie))
        else:
            # One pass over the texts a part; what it leaves is a number a document.
            once = stored(own.select("k1", "k2", scored(trie).alias("score"))).groupBy("k1", "k2").agg(F.first("score").alias("score"))
            sums = once if sums is None else checkpointed(sums.unionByName(once).groupBy("k1", "k2").agg(F.sum("score").alias("score")))
    if sums is not None:
        own = own.join(sums, ["k1", "k2"], "left")
    own = own.select("id", "k1", "k2", "held_out", "score")
    once = base.groupBy("k1", "k2").agg(F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"), F.first("base_score").alias("base_score"))
    return own.join(once, ["k1", "k2"], "left").select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    """Contract query 6: base and model scores of every document."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
