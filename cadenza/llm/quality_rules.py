"""Quality rules per document, and host verdicts from shrunk failure rates.

Texts are measured once, in Arrow batches, row by row in slices of bounded size.
Failures are summed per host (two numbers each, combined before the shuffle), the
hosts' rates shrink towards the corpus by an empirical beta prior, whose variance is
what hosts differ by beyond chance, and the verdicts join back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import checkpointed, few, slices, tidy

# Fixed values of the contract: least words, and the share of repeated words in percent.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

#: Soft rules: symbols per word, upper-case share of ASCII letters, share of repeated lines.
MAX_SYMBOLS_PER_WORD, MAX_UPPER, MAX_DUP_LINES = 0.25, 0.5, 0.5

#: A host whose shrunk failure rate is above STRICT loses every document with a failure; above BANNED, all of them.
STRICT, BANNED = 0.1, 0.8

#: Hosts up to this number are broadcast to the documents; more are joined by a shuffle. Texts only meet hosts above STRICT.
MAX_BROADCAST_HOSTS = 100_000

#: Documents that a prior counts as where hosts do not differ beyond chance: every rate is that of the corpus.
POOLED = 1e12

_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SLICE = 1 << 20
_MIX = np.random.default_rng(20).integers(1, 1 << 63, WINDOW + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

METRICS = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")])
_TYPE = "struct<" + ",".join(f"{f.name}:bigint" for f in METRICS) + ">"


def repeated_words(docs: list[list[bytes]]) -> np.ndarray:
    """For each list of words, how many stand in a window of eight that the list holds twice or more.

    Windows are told apart by 64 bits of a random linear hash over word numbers.
    """
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    out = np.zeros(len(docs), np.int64)
    if n < WINDOW:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.uint64, n)
    owner = np.repeat(np.arange(len(docs)), lengths)
    starts = np.flatnonzero(np.arange(n) + WINDOW <= ends[owner])
    if not len(starts):
        return out
    key = owner[starts].astype(np.uint64) * _MIX[WINDOW]
    for j in range(WINDOW):
        key += ids[starts + j] * _MIX[j]
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[again], 1)
    np.add.at(edge, starts[again] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(docs))


def _measures(text: bytes | None, n_words: int) -> tuple:
    text = text or b""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return (
        n_words,
        len(text.translate(None, _SPACES + _CONTINUATION)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        len(text) - len(text.translate(None, _LETTERS)),
    )


def measure(texts: pa.Array) -> pa.Array:
    """The metrics of every text; null counts as empty."""
    rows, repeats = [], []
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in slices(lengths, _SLICE):
        some = texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()
        words = [t.split() if t else [] for t in some]
        repeats.append(repeated_words(words))
        rows += [_measures(t, len(w)) for t, w in zip(some, words, strict=True)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    again = np.concatenate(repeats) if repeats else np.zeros(0, np.int64)
    arrays = [pa.array(c, pa.int64()) for c in columns]
    return pa.StructArray.from_arrays([*arrays[:4], pa.array(again, pa.int64()), *arrays[4:]], fields=list(METRICS))


def metrics_column(text: Column) -> Column:
    def measured(t: pa.Array) -> pa.Array:
        told = measure(t)
        tidy()
        return told

    return F.arrow_udf(measured, _TYPE)(text.cast("string"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def soft_failures(m: Column) -> Column:
    """How many of the three soft rules a document fails."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return one(m["n_symbols"] > m["n_words"] * MAX_SYMBOLS_PER_WORD) + one(m["n_upper"] > m["n_letters"] * MAX_UPPER) + one(m["n_dup_lines"] > m["n_lines"] * MAX_DUP_LINES)


def host_verdicts(measured: DataFrame, host: str, metrics: str) -> DataFrame:
    """(host, n_docs, n_failed, rate), rates shrunk by a beta prior fitted to all hosts; one row per host, null is a host of its own.

    Moments of the beta-binomial distribution: with k hosts, N documents and the corpus
    rate m, the squares n (p - m)^2 sum to m (1 - m) ((k - 1) + r (N - sum n^2 / N - (k - 1))),
    r being the correlation inside a host, so what hosts of few documents differ by chance
    is not taken for a difference of hosts. The prior weighs 1 / r - 1 documents.
    """
    m = F.col(metrics)
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.when(base_failed(m) | (soft_failures(m) > 0), 1).otherwise(0)).alias("n_failed"))
    hosts = checkpointed(hosts)
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    seen = hosts.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.sum(f).alias("f"), F.sum(f * f / n).alias("f2")).first()
    mean, weight = prior(seen["k"], seen["n"] or 0.0, seen["n2"] or 0.0, seen["f"] or 0.0, seen["f2"] or 0.0)
    return hosts.withColumn("rate", (f + F.lit(mean * weight)) / (n + F.lit(weight)))


def prior(k: int, n: float, n2: float, f: float, f2: float) -> tuple[float, float]:
    """(mean, weight) from the number of hosts and the sums over hosts of n, n^2, failures f and f^2 / n."""
    mean = f / n if n else 0.0
    spread, room = mean * (1 - mean), n - (n2 / n if n else 0.0) - (k - 1)
    if spread <= 0 or room <= 0:
        return mean, POOLED
    r = ((f2 - n * mean * mean) / spread - (k - 1)) / room
    return mean, POOLED if r <= 0 else min(max(1 / r - 1, 0.0), POOLED)


def judged(measured: DataFrame, hosts: DataFrame, host: str, metrics: str) -> DataFrame:
    """``measured`` with ``__base_failed``, ``__host_rate`` and ``__kept``; a host that is not in ``hosts`` has no rate and passes."""
    verdicts = hosts.select(F.col("host").alias("__host"), F.col("rate").alias("__host_rate"))
    if few(verdicts, MAX_BROADCAST_HOSTS):
        verdicts = F.broadcast(verdicts)
    m, rate = F.col(metrics), F.col("__host_rate")
    soft = soft_failures(m)
    above = lambda most: F.coalesce(rate > most, F.lit(False))
    kept = ~base_failed(m) & (soft < 2) & ~((soft > 0) & above(STRICT)) & ~above(BANNED)
    return measured.join(verdicts, F.col(host).eqNullSafe(F.col("__host")), "left").withColumn("__base_failed", base_failed(m)).withColumn("__kept", kept).drop("__host")


def assess(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per row: the metrics, base_failed, host_rate and kept.

    A document that fails the base rules or two soft rules goes; one that fails a
    soft rule goes if its host's shrunk rate is above STRICT, and every document of
    a host above BANNED. Null or empty text has no words and fails; null is a host
    of its own; repeated rows are judged alike; an empty table gives no rows.
    """
    measured = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), metrics_column(F.col(text)).alias("m")))
    rows = judged(measured, host_verdicts(measured, "host", "m"), "host", "m")
    return rows.select("doc_id", "m.*", F.col("__base_failed").alias("base_failed"), F.col("__host_rate").alias("host_rate"), F.col("__kept").alias("kept"))


def kept_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, in their own columns.

    Texts are measured again rather than shuffled, and meet only the hosts above
    STRICT. Null and empty texts go, null is a host of its own, repeated rows are judged
    alike, and an empty table gives no rows.
    """
    columns = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at = {name: f"c{i}" for i, name in enumerate(columns)}
    measured = inner.withColumn("m", metrics_column(F.col(at[text])))
    hosts = host_verdicts(measured.select(at[host], "m"), at[host], "m").filter(F.col("rate") > STRICT)
    return judged(measured, hosts, at[host], "m").filter("__kept").select(*(F.col(at[c]).alias(c) for c in columns))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query 8: rule counts and verdicts of every document."""
    rows = assess(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = r"[^ \t\n\x0B\f\r]+"
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(regexp_extract_all(text, '{_WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS i FROM d),
g AS (SELECT k, i, [{", ".join(f"lead(w, {j}) OVER o" for j in range(8))}] AS win, lead(w, 7) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, whole AND count(*) OVER (PARTITION BY k, win) >= 2 AS again FROM g),
c AS (SELECT k, max(again::INT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM r),
n AS (SELECT k, sum(hit)::BIGINT AS n_repeat_words, count(*) AS n_words FROM c GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY k),
m AS (SELECT d.k, doc_id, source, coalesce(n_words, 0)::BIGINT AS n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN n USING (k) LEFT JOIN l USING (k)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  (n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words)::INT + (n_upper > {MAX_UPPER} * n_letters)::INT + (n_dup_lines > {MAX_DUP_LINES} * n_lines)::INT AS soft FROM m),
h AS (SELECT source, count(*) AS n, sum((base_failed OR soft > 0)::INT) AS f FROM s GROUP BY source),
v AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS n2, sum(f)::DOUBLE AS f, sum(f * f / n)::DOUBLE AS f2 FROM h),
x AS (SELECT f / n AS mean, CASE WHEN f > 0 AND f < n AND n - n2 / n - (k - 1) > 0 THEN ((f2 - f * f / n) / (f / n * (1 - f / n)) - (k - 1)) / (n - n2 / n - (k - 1)) END AS r FROM v),
p AS (SELECT mean, CASE WHEN r > 0 THEN least(greatest(1 / r - 1, 0), {POOLED}) ELSE {POOLED} END AS weight FROM x),
q AS (SELECT source, (f + mean * weight) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND soft < 2 AND NOT (soft > 0 AND rate > {STRICT}) AND rate <= {BANNED} AS kept
FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
"""
