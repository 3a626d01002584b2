"""Language identification by cross-parsing with suffix automata.

For every language a bounded number of labelled documents, whole, becomes a suffix
automaton. A text is cut greedily into the longest phrases that the automaton knows;
the language that needs the fewest phrases, normalised by the length and the size of
its sample, wins. Automata are kept as sparse rows that share one array. Texts are
parsed whole: lanes of fixed width start in parallel, and each is then parsed again
from the state in which the lane before it ended, up to the first place where both
parses begin a phrase, so that counts are those of one parse from start to end.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import checkpointed, few, id_remainder, shipped, slices, tidy

#: Labelled documents a language that are learned from, each whole; ones of more code points are taken only if a language has too few others.
SAMPLE_DOCS, LONG_TEXT = 48, 16_384

#: Languages up to this number are broadcast to the documents; more are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 100_000

#: Letters that are parsed at once; no phrase ends there for that.
LANE = 1024

#: Phrases a character from which on a text is no language that was learned, whatever the labelled documents say.
MAX_RATE = 0.7

#: What a text's strangeness may be, by the largest of the labelled documents to models that have not seen them.
MARGIN = 1.2

UNKNOWN = "und"

#: Bytes of text that are parsed at once, by the number of languages.
_SLICE = 16 << 20


#: Stands for a letter that no sample has; no letter itself.
UNSEEN = 1


@functools.cache
def lower_letters() -> np.ndarray:
    """Code point to the lower case of a letter, 0 for everything else."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def letter_bytes(text: str, lower: np.ndarray) -> np.ndarray:
    """UTF-8 of a text's lower-case letters, whatever their script; runs of non-letters are one 0."""
    cps = lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    cps = cps[(cps != 0) | (np.concatenate([[1], cps[:-1]]) != 0)] if len(cps) else cps
    size = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - size] = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size] | cps >> 6 * (size - 1)
    for k in range(1, 4):
        some = size > k
        out[(ends - size)[some] + k] = 0x80 | cps[some] >> 6 * (size[some] - 1 - k) & 0x3F
    return out


def byte_classes(samples: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Byte to class: 0 is everything but letters, 1 what no sample has and no automaton knows, then all others."""
    known = [b for b in np.unique(np.concatenate([np.zeros(1, np.uint8), *samples])).tolist() if b]
    table = np.ones(256, np.uint8)
    table[0] = 0
    table[known] = np.arange(2, len(known) + 2)
    return table, len(known) + 2


def suffix_automaton(kinds: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all factors of the sequence; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in kinds.tolist():
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


class Automata:
    """The transitions of all automata in one array, a slot being (state, next state).

    A state is a number s so that its transition by class c is in slot s + c, if that slot
    is marked with s. States with many transitions are placed first, at random until they
    fit; those with one go where there is room. State 0 has none: a phrase always ends there.
    """

    def __init__(self, automata: list[list[dict[int, int]]], n_classes: int):
        sizes = [len(states) for states in automata]
        shift = np.cumsum([0, *sizes])[:-1].tolist()
        degree = np.array([len(out) for states in automata for out in states], np.int64)
        count = int(degree.sum())
        kind = np.fromiter((c for states in automata for out in states for c in out), np.int64, count)
        target = np.fromiter((k + t for k, states in zip(shift, automata, strict=True) for out in states for t in out.values()), np.int64, count)
        first = np.cumsum(degree) - degree
        slots = count * 3 // 2 + len(degree) // 4 + 4 * n_classes
        names = np.zeros(len(degree), np.int64)
        owner = np.full(slots + 2 * n_classes, -1, np.int64)
        used = np.zeros(slots + n_classes, bool)
        rng = np.random.default_rng(4)
        for k in np.unique(degree)[::-1].tolist():
            open_ = np.flatnonzero(degree == k)
            while len(open_):
                at = first[open_][:, None] + np.arange(k)
                if k == 1:
                    room = rng.permutation(n_classes + np.flatnonzero(owner[n_classes:slots] < 0))[: len(open_)]
                    told = np.zeros(len(open_), np.int64)
                    told[: len(room)] = room - kind[at[: len(room), 0]]
                else:
                    told = rng.integers(n_classes, slots, len(open_))
                fits = np.flatnonzero((told > 0) & ~used[told])
                fits = fits[np.sort(np.unique(told[fits], return_index=True)[1])]
                where = told[fits][:, None] + kind[at[fits]]
                free = (owner[where] < 0).all(axis=1)
                fits, where = fits[free], where[free]
                once = np.zeros(where.size, bool)
                once[np.unique(where.ravel(), return_index=True)[1]] = True
                whole = once.reshape(where.shape).all(axis=1)
                fits, where = fits[whole], where[whole]
                names[open_[fits]] = told[fits]
                used[told[fits]] = True
                owner[where] = told[fits][:, None]
                open_ = np.delete(open_, fits)
        self.slots = owner << 32
        states = np.repeat(np.arange(len(degree)), degree)
        self.slots[names[states] + kind] |= names[target]
        self.roots = np.zeros((len(automata), n_classes), np.int64)
        for lang, (k, states) in enumerate(zip(shift, automata, strict=True)):
            for c, t in states[0].items():
                self.roots[lang, c] = names[k + t]

    def step(self, state: np.ndarray, kinds: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase began with this letter; ``root`` has each entry's offset into the roots."""
        found = self.slots.take(state + kinds)
        fails = (found >> 32) != state
        return np.where(fails, self.roots.reshape(-1).take(root + kinds), found & 0xFFFFFFFF), fails


def phrase_counts(texts: list[np.ndarray], automata: Automata) -> np.ndarray:
    """Phrases of each text in each language: the greedy parse, a letter that the sample lacks being a phrase of its own."""
    langs, n_classes = automata.roots.shape
    out = np.zeros((len(texts), langs), np.int64)
    lanes = [(i, a) for i, x in enumerate(texts) for a in range(0, len(x), LANE)]
    if not lanes or not langs:
        return out
    owner = np.array([i for i, _ in lanes])
    width = np.array([min(LANE, len(texts[i]) - a) for i, a in lanes])
    order = np.argsort(-width, kind="stable")
    rank = np.empty(len(lanes), np.int64)
    rank[order] = np.arange(len(lanes))
    grid = np.zeros((int(width.max()), len(lanes)), np.uint8)
    for column, k in enumerate(order.tolist()):
        i, a = lanes[k]
        grid[: width[k], column] = texts[i][a : a + LANE]
    follows = np.append(owner[1:] == owner[:-1], False)
    width, owner = width[order], owner[order]
    after = np.where(follows, np.append(rank[1:], -1), -1)[order]

    # Every lane from its own start.
    alive = np.searchsorted(-width, -np.arange(len(grid)), side="left")
    root = np.arange(langs)[:, None] * n_classes
    state = np.zeros((langs, len(lanes)), np.int64)
    began = np.zeros((len(grid), langs, len(lanes)), bool)
    for step, kinds in enumerate(grid):
        m = int(alive[step])
        state[:, :m], began[step, :, :m] = automata.step(state[:, :m], kinds[:m], root)
    counts = began.sum(axis=0, dtype=np.int64)

    # Again from where the lane before ended, until both parses begin a phrase at one place; a lane that ends otherwise hands its state on.
    lang, lane = (x.ravel() for x in np.meshgrid(np.arange(langs), np.flatnonzero(after >= 0), indexing="ij"))
    ends = state.copy()
    entry = state[lang, lane]
    lane = after[lane]
    first = np.zeros((langs, len(lanes)), np.int64)
    while len(lane):
        now, at, extra = entry, np.arange(len(lane)), np.zeros(len(lane), np.int64)
        settled = np.ones(len(lane), bool)
        final = ends[lang, lane]
        for step in range(len(grid)):
            over = step >= width[lane[at]]
            if over.any():
                final[at[over]], settled[at[over]] = now[over], False
                at, now = at[~over], now[~over]
            if not len(at):
                break
            x, y = lang[at], lane[at]
            now, fails = automata.step(now, grid[step, y], x * n_classes)
            own = began[step, x, y]
            extra[at] += fails.astype(np.int64) - own
            same = fails & own
            at, now = at[~same], now[~same]
        if len(at):
            final[at], settled[at] = now, False
        first[lang, lane] = extra
        # Where the parse has not come back to the lane's own, what follows it starts from another state.
        moved = np.flatnonzero((final != ends[lang, lane]) & (after[lane] >= 0))
        # A lane that is settled again ends as it did from its own start.
        ends[lang, lane] = np.where(settled, state[lang, lane], final)
        back = np.flatnonzero(settled & (after[lane] >= 0) & (final != state[lang, lane]))
        go = np.union1d(moved, back)
        entry = ends[lang[go], lane[go]]
        lang, lane = lang[go], after[lane[go]]
    np.add.at(out, owner, (counts + first).T)
    return out


def strangeness(phrases: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Phrases a character beyond the first, less two standard deviations of a count: short texts are not judged by chance."""
    return (np.sqrt(np.maximum(phrases, 1)) - 1) ** 2 / np.maximum(length, 1)


def strangest(samples: dict[str, list[str]]) -> float:
    """MARGIN times the largest strangeness of labelled documents to a model of the other half of them; infinite if a language has no two."""
    if not samples or min(map(len, samples.values())) < 2:
        return np.inf
    worst = 0.0
    for half in (0, 1):
        model = Model({name: texts[half::2] for name, texts in samples.items()})
        told = model.predict(pa.array([t for texts in samples.values() for t in texts[1 - half :: 2]]))
        worst = max(worst, *(r["strange"] for r in told.to_pylist() if r["lang"] != UNKNOWN), 0.0)
    return worst * MARGIN or np.inf


class Model:
    """Automata of all languages; small enough to be sent to every task."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        self.most_strange = np.inf
        self.lower = lower_letters().copy()
        seen = np.zeros(0x110000, bool)
        for t in (t for name in self.names for t in samples[name]):
            seen[self.lower[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]] = True
        self.lower[(self.lower != 0) & ~seen[self.lower]] = UNSEEN
        texts = [np.concatenate([np.append(letter_bytes(t, self.lower), 0).astype(np.uint8) for t in samples[name]]) for name in self.names]
        self.classes, n = byte_classes(texts)
        texts = [self.classes[x] for x in texts]
        self.automata = Automata([suffix_automaton(x) for x in texts], n)
        self.sizes = np.array([max(2, len(x)) for x in texts], float)

    def predict(self, texts: pa.Array) -> pa.Array:
        """(lang, score, rate, strange) of each text."""
        langs, scores, rates, strange = [], [], [], []
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for a, b in slices(lengths, max(_SLICE // 64, _SLICE // max(4, len(self.names)))):
            kinds = [self.classes[letter_bytes(t or "", self.lower)] for t in texts.slice(a, b - a).to_pylist()]
            counts = phrase_counts(kinds, self.automata)
            for x, row in zip(kinds, counts, strict=True):
                if not len(row) or not x.any():
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rates.append(1.0)
                    strange.append(1.0)
                    continue
                cost = row * np.log2(self.sizes) / len(x)
                ranked = np.argsort(cost, kind="stable")
                best = ranked[0]
                langs.append(self.names[best])
                scores.append(1.0 if len(ranked) < 2 else float(1 - cost[best] / cost[ranked[1]]))
                rates.append(float(row[best] / len(x)))
                strange.append(float(strangeness(row[best], len(x))))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()), pa.array(strange, pa.float64())], names=["lang", "score", "rate", "strange"])


def sample(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> dict[str, list[str]]:
    """Of each language SAMPLE_DOCS whole documents whose crc32(id) mod 3 is not 1, by the hash of id and text.

    Languages are counted first, so that only documents whose hash lies under a
    threshold, a few times as many as are wanted, are ranked: what one task gets
    depends neither on the number of documents nor on that of tasks.
    """
    told = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").filter(id_remainder(F.col("id"), 3) != 1)
    long = F.length("text") > LONG_TEXT
    counts = told.groupBy("lang").agg(F.sum(F.when(long, 0).otherwise(1)).alias("short"), F.count("*").alias("all"))
    share = F.lit(8.0 * SAMPLE_DOCS) / F.when(F.col("short") >= SAMPLE_DOCS, F.col("short")).otherwise(F.col("all"))
    bounds = checkpointed(counts.select(F.col("lang").alias("l"), (F.col("short") >= SAMPLE_DOCS).alias("only_short"), F.when(share < 1, share).otherwise(1.0).alias("share")))
    # Without this the texts would be shuffled before they are filtered.
    bounds = F.broadcast(bounds) if few(bounds, MAX_BROADCAST_LANGUAGES) else bounds
    h = F.shiftrightunsigned(F.xxhash64("id", "text"), 1)
    near = told.withColumn("h", h).join(bounds, F.col("lang") == F.col("l")).filter((F.col("h") <= F.col("share") * float(2**63)) & ~(F.col("only_short") & long))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(long, "h", "id", "text"))).filter(F.col("n") <= SAMPLE_DOCS)
    samples: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "n").select("lang", "text").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return samples


def learn(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", judged: bool = False) -> Model:
    """A model of the sample; ``judged``: with the bound of strangeness that ``kept_documents`` uses."""
    samples = sample(docs, doc_id, lang, text)
    model = Model(samples)
    if judged:
        model.most_strange = strangest(samples)
    return model


def prediction(spark, model: Model, text: Column) -> Column:
    here = shipped(spark, model)

    def predicted(t: pa.Array) -> pa.Array:
        told = here().predict(t)
        tidy()
        return told

    return F.arrow_udf(predicted, "struct<lang:string,score:double,rate:double,strange:double>")(text.cast("string"))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rate) for every row.

    ``score`` is how much cheaper the winner is than the next, from 0 (a tie, which
    the first language by code point wins) to 1; ``rate`` is its phrases a character.
    Null text, or text without a letter, is ``und`` with score 0; so is everything if
    nothing was learned. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), prediction(docs.sparkSession, model, F.col(text)).alias("p"))
    return rows.select("doc_id", F.col("p.lang").alias("lang_pred"), "p.score", "p.rate")


def kept_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a language that was learned, in their own columns.

    A text goes if it is stranger to the model than labelled documents that a model
    has not seen are, by more than MARGIN, or if its rate is above MAX_RATE. Null text
    and text without a letter go; repeated rows are judged alike; if nothing was
    learned nothing stays.
    """
    columns = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(columns)))).withColumn("p", prediction(docs.sparkSession, model, F.col(f"c{columns.index(text)}")))
    return inner.filter((F.col("p.lang") != UNKNOWN) & (F.col("p.rate") <= MAX_RATE) & (F.col("p.strange") <= float(model.most_strange))).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query 4: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    model = learn(docs)
    held = docs.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), prediction(spark, model, F.col("text")).alias("p"))
    return held.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rate").alias("rate"))
