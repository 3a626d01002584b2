"""A quality classifier learned from trusted positives and unlabelled web text.

The model minimises the non-negative unbiased risk of positive-unlabelled learning
with the logistic loss: the risk on positives, weighted by the class prior, plus
what the unlabelled texts would cost as negatives, less the share of that which
positives explain, kept from falling below zero. The prior is estimated from positives
and unlabelled texts alone. Texts are seen as shares of byte classes, of hashed words
and of hashed byte trigrams, and by how much they repeat.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import id_remainder, slices

#: Bounds of the training sample.
MAX_POSITIVES, MAX_UNLABELLED = 6000, 6000

#: Slots of hashed words and of hashed byte trigrams.
WORD_SLOTS, GRAM_SLOTS = 256, 256

#: A class prior is assumed where none can be estimated, and kept off 0 and 1.
DEFAULT_PRIOR, LEAST_PRIOR = 0.5, 0.05

#: Rows of either kind below which the prior's estimate is not trusted.
LEAST_ROWS = 20

THRESHOLD = 0.3
_SLICE = 2 << 20
_PAIRS, _WORDS = 8, 2


def _byte_kinds() -> tuple[np.ndarray, int]:
    """A class for every byte: each punctuation sign its own; digits, upper and lower case, space, newline, control, non-ASCII."""
    table = np.zeros(256, np.uint8)
    table[32], table[10] = 1, 2
    table[48:58], table[65:91], table[97:123], table[128:] = 3, 4, 5, 6
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for i, b in enumerate(signs):
        table[b] = 7 + i
    return table, 7 + len(signs)


_KINDS, _N_KINDS = _byte_kinds()
N_DENSE = _N_KINDS + _PAIRS + _WORDS
N_FEATURES = N_DENSE + WORD_SLOTS + GRAM_SLOTS


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text: square roots of the shares of byte classes, of a few neighbourhoods and of repeated words, sizes, and square roots of the shares of hashed words and byte trigrams. An empty text is all zeros."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    if not lengths.sum():
        return out
    flat = np.frombuffer(b"".join(texts), np.uint8)
    kinds = _KINDS[flat]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    counts = np.bincount(owner.astype(np.int64) * _N_KINDS + kinds, minlength=len(texts) * _N_KINDS).reshape(len(texts), _N_KINDS).astype(float)
    n = np.maximum(lengths, 1).astype(float)
    left, right, same = kinds[:-1], kinds[1:], owner[:-1] == owner[1:]

    def near(test: np.ndarray) -> np.ndarray:
        return np.bincount(owner[:-1][test & same], minlength=len(texts)) / n

    gap = (right == 1) | (right == 2)
    signs = lambda k: k >= 7
    words = near(~((left == 1) | (left == 2)) & gap) * n + 1
    out[:, :_N_KINDS] = np.sqrt(counts / n[:, None])
    out[:, _N_KINDS : N_DENSE - _WORDS] = np.sqrt(
        np.stack([near((left == 4) & (right == 4)), near(signs(left) & (left == right)), near(signs(left) & signs(right)), near(signs(left) & gap), near((left == 5) & (right == 4)), near((left == 2) & (right == 2)), 0.01 * np.log1p(n), 0.01 * n / words], axis=1)
    )
    slot: dict[bytes, int] = {}
    for i, text in enumerate(texts):
        if own := text.lower().split():
            # Words that are their neighbours, and words that came before.
            out[i, N_DENSE - 2] = np.sqrt(sum(map(eq, own[1:], own)) / len(own))
            out[i, N_DENSE - 1] = np.sqrt(1 - len(set(own)) / len(own))
            for w in own:
                if w not in slot:
                    slot[w] = xxhash.xxh3_64_intdigest(w) % WORD_SLOTS
            at = np.fromiter(map(slot.__getitem__, own), np.int64, len(own))
            out[i, N_DENSE : N_DENSE + WORD_SLOTS] = np.sqrt(np.bincount(at, minlength=WORD_SLOTS) / len(own))
    low = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint32)
    grams = (low[:-2] | low[1:-1] << 8 | low[2:] << 16) * np.uint32(2654435761) >> np.uint32(24)
    inside = owner[:-2] == owner[2:]
    counts = np.bincount(owner[:-2][inside].astype(np.int64) * GRAM_SLOTS + grams[inside] % GRAM_SLOTS, minlength=len(texts) * GRAM_SLOTS)
    out[:, N_DENSE + WORD_SLOTS :] = np.sqrt(counts.reshape(len(texts), GRAM_SLOTS) / n[:, None])
    out[lengths == 0] = 0
    return out


def _scales(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is subtracted from features and what they are divided by; hashed ones count for less each, as they are many."""
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    scale[N_DENSE:] = np.maximum(scale[N_DENSE:], 1e-3) * 4
    return mean, scale


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, squares of those that are not hashed, and 1."""
    z = np.clip((x - mean) / scale, -4, 4).astype(np.float32)
    return np.concatenate([z, z[:, :N_DENSE] ** 2 / 4, np.ones((len(z), 1), np.float32)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the direction to step against: that of the risk, or away from what made its second part negative."""
    zp, zu = p @ w, u @ w
    as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    of_positive = -(p.T @ sigmoid(-zp)) / len(p) * prior
    of_negative = (u.T @ sigmoid(zu)) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, as_negative)
    return value, of_positive + of_negative if as_negative >= 0 else -of_negative


def separated(w: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[float, np.ndarray]:
    """The logistic risk of telling positives from unlabelled texts, both counting as much, and its slope."""
    zp, zu = p @ w, u @ w
    return np.logaddexp(0, -zp).mean() + np.logaddexp(0, zu).mean(), (u.T @ sigmoid(zu)) / len(u) - (p.T @ sigmoid(-zp)) / len(p)


def descended(slope, size: int, steps: int, rate: float, decay: float) -> np.ndarray:
    """Weights after so many Adam steps; all but the last are drawn to 0."""
    w = np.zeros(size, np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = slope(w) + decay * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g**2
        w = (w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 250, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a linear model over ``expanded`` features; the last weight is the bias."""
    mean, scale = _scales(np.concatenate([positives, unlabelled]))
    p, u = expanded(positives, mean, scale), expanded(unlabelled, mean, scale)
    return mean, scale, descended(lambda w: risk(w, p, u, prior)[1], p.shape[1], steps, rate, decay)


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, steps: int = 150) -> float:
    """The share of positives among unlabelled texts, from both alone.

    One half of the rows learns to tell the two kinds apart. In the other half, whatever
    scores above a threshold is at most all positive: the share of unlabelled texts
    above it, by that of positives, bounds the prior, and the threshold at which that
    bound, with its error of sampling, is least gives the estimate.
    """
    if min(len(positives), len(unlabelled)) < LEAST_ROWS:
        return DEFAULT_PRIOR
    mean, scale = _scales(np.concatenate([positives[::2], unlabelled[::2]]))
    p, u = expanded(positives[::2], mean, scale), expanded(unlabelled[::2], mean, scale)
    w = descended(lambda w: separated(w, p, u)[1], p.shape[1], steps, 0.03, 1e-3)
    sp, su = (np.sort(expanded(x[1::2], mean, scale) @ w) for x in (positives, unlabelled))
    at = np.concatenate([sp, su])
    above_p, above_u = (1 - np.searchsorted(s, at) / len(s) for s in (sp, su))
    error = np.sqrt(np.log(40) / 2 / len(sp)) + np.sqrt(np.log(40) / 2 / len(su))
    bound = np.where(above_p > 0, (above_u + error) / np.maximum(above_p, 1e-9), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(above_u[best] / above_p[best], LEAST_PRIOR, 1 - LEAST_PRIOR))


def scored(texts: pa.Array, model) -> pa.Array:
    """The probability of label 1 for every text; null counts as empty."""
    out = []
    for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _SLICE):
        x = features([t or b"" for t in texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()])
        if model is None:
            out.append(np.full(len(x), 0.5))
        else:
            mean, scale, w = model
            out.append(sigmoid((expanded(x, mean, scale) @ w).astype(np.float64)))
    return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())


def _feature_rows(df: DataFrame, most: int) -> np.ndarray:
    """The features of at most so many rows of (id, text), by the hash of both; one row for rows that are alike.

    Rows are counted first, and only those whose hash lies under a threshold, a few
    times as many as are wanted, are put in order: what one task gets does not grow.
    """

    def rows(t: pa.Array) -> pa.Array:
        x = features([v or b"" for v in t.cast(pa.large_binary()).to_pylist()])
        return pa.array([r.tobytes() for r in x], pa.binary())

    share = min(1.0, 4.0 * most / max(1, df.select("id").count()))
    hashed = df.select(F.shiftrightunsigned(F.xxhash64("id", "text"), 1).alias("h"), F.col("text").cast("string").alias("text")).filter(F.col("h") <= F.lit(share * 2.0**63))
    chosen = hashed.dropDuplicates(["h", "text"]).orderBy("h", "text").limit(most)
    got = chosen.select("h", F.arrow_udf(rows, "binary")("text").alias("x")).collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in sorted(got, key=lambda r: (r["h"], r["x"]))], np.float32).reshape(-1, N_FEATURES)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality"):
    """A model, or None without positives or unlabelled texts.

    Labels count only where crc32(id) mod 5 is not 0; of the positives the
    MAX_POSITIVES with the smallest id hash, and as unlabelled MAX_UNLABELLED such
    documents, whatever their labels. Negative labels are not used. Documents that
    share an id are told apart by their texts, and bounded like all others.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(quality).alias("q")).filter((id_remainder(F.col("id"), 5) != 0) & (F.col("q") == 1) & F.col("id").isNotNull())
    chosen = known.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(MAX_POSITIVES)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(id_remainder(F.col("id"), 5) != 0)
    positives = _feature_rows(texts.join(F.broadcast(chosen), "id"), MAX_POSITIVES)
    unlabelled = _feature_rows(texts, MAX_UNLABELLED)
    return fit(positives, unlabelled, estimated_prior(positives, unlabelled)) if len(positives) and len(unlabelled) else None


def score_column(spark, model, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(model)

    def score(t: pa.Array) -> pa.Array:
        return scored(t, sent.value)

    return F.arrow_udf(score, "double")(text.cast("string"))


def classify(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row.

    Null text is scored as empty text; without a model every score is 0.5; repeated
    rows score alike; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), score_column(docs.sparkSession, model, F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Contract query 10: the quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score_column(spark, model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
