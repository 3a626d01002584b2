"""Mixing sources to target weights with hash-threshold histograms.

Every document's id hashes to a number of 60 bits. A source's budget is met by the
documents under a threshold, which is found from histograms: tokens are summed by
source and leading hash bits, the bucket in which the budget ends is found, and
only that bucket is split further. Where several rows share the last bucket, as rows
of one id do, the hash of their texts splits it, and then their numbers. Nothing is
sorted, and no rows of a source meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import SPACED_WORD, checkpointed, few, stored

# The contract's weights by position, share and ceiling.
WEIGHTS, SHARE_NUM, SHARE_DEN, CEILING = (3, 1, 2), 3, 2, 2

#: Hash bits, and bits by which each pass splits the boundary bucket.
HASH_BITS, PASS_BITS = 60, 12

#: What tells documents apart, each where all before it are alike: hash of the id, hash of the text, number of the row.
KEYS = ("h", "t", "u")

#: Sources up to this number are broadcast to the documents; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def hash60(value: Column) -> Column:
    """60 bits of the md5 of a value as text; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


#: Sources up to this number are put in order by one task; more by ranges, one task each.
MAX_ORDERED_SOURCES = 100_000


def _before(rows: DataFrame, order: list[Column], sums: list[str], ranged: bool) -> DataFrame:
    """Adds ``rank`` from 0 and ``before_<sum>``: how many rows, and how much, come before each in the order."""
    if not ranged:
        rows, offsets = rows.withColumn("__range", F.lit(0)), None
    else:
        rows = checkpointed(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
        # One row a range.
        earlier = Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        whole = rows.groupBy(F.col("__range").alias("r")).agg(F.count("*").alias("o_rank"), *(F.sum(c).alias(f"o_{c}") for c in sums))
        offsets = whole.select("r", *(F.coalesce(F.sum(f"o_{c}").over(earlier), F.lit(0)).alias(f"o_{c}") for c in ("rank", *sums)))
        rows = rows.join(F.broadcast(offsets), F.col("__range") == F.col("r"))
    inside = Window.partitionBy("__range").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.col(f"o_{c}") if offsets is not None else F.lit(0)
    told = {"rank": F.row_number().over(inside) - 1 + offset("rank")} | {f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) + offset(c) for c in sums}
    return rows.withColumns(told).drop("__range", "r", *(f"o_{c}" for c in ("rank", *sums)))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources weigh 3, 1, 2 in turn, by code point with null last, and share 150 %
    of all sizes. A target stops at twice its source's size and the excess goes to
    the others by weight: water-filling, solved in one pass over the sources in
    the order in which they fill up.
    """
    sizes = checkpointed(sizes)
    ranged = not few(sizes, MAX_ORDERED_SOURCES)
    ranked = _before(sizes, [F.col("source").asc_nulls_last()], [], ranged)
    weighed = checkpointed(ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("bigint")).withColumn("ratio", F.col("source_size") / F.col("w")).withColumnRenamed("rank", "place"))
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    solved = checkpointed(_before(weighed, [F.col("ratio").asc(), F.col("place").asc()], ["source_size", "w"], ranged))
    # A source's share if all before it in filling order are full: it, and all after it, stay open from the first that isn't above its ceiling.
    left = F.lit((whole["size"] or 0) * SHARE_NUM) - F.col("before_source_size") * CEILING * SHARE_DEN
    open_w = F.lit(whole["w"] or 0) - F.col("before_w")
    fits = left * F.col("w") <= F.col("source_size") * CEILING * SHARE_DEN * open_w
    first = solved.filter(fits).agg(F.min(F.struct("rank", left.alias("left"), open_w.alias("w"))).alias("f")).first()["f"]
    full = F.col("source_size").cast("double") * CEILING
    target = full if first is None else F.when(F.col("rank") >= first["rank"], (F.col("w") * F.lit(first["left"])).cast("double") / F.lit(first["w"] * SHARE_DEN)).otherwise(full)
    return solved.select("source", "source_size", target.alias("target"))


def _sizes(docs: DataFrame, doc_id: str, source: str, text: str, number: Column) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("bigint").alias("size"),
        hash60(F.col(doc_id)).alias("h"),
        hash60(F.col(text)).alias("t"),
        number.alias("u"),
    )


def source_bounds(sized: DataFrame) -> tuple[DataFrame, int]:
    """(source, source_size, target, rounds, bound_h, bound_t, bound_u, fits), what decides on each document of a source, and how many keys that took.

    ``sized`` has (source, size, h, t, u). One pass sums sizes by source and leading
    bits; every other pass reads only the bucket in which a budget ends.
    """
    targets = checkpointed(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    # The budget of the last, partial round; sizes are non-negative and below 2**53.
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    budget = targets.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    bounds = [f"bound_{k}" for k in KEYS]
    found = budget.select("source", *(F.lit(None).cast("bigint").alias(b) for b in bounds), F.col("budget").alias("left"))
    inside, depth = sized.select(F.col("source").alias("s"), "size", *KEYS), 0
    while True:
        key, bound = KEYS[depth], bounds[depth]
        for shift in range(HASH_BITS - PASS_BITS, -1, -PASS_BITS):
            bucket = F.shiftright(key, shift)
            histogram = inside.groupBy(F.col("s"), bucket.alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
            running = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
            # The budget ends in the last bucket that starts within it.
            cut = (
                histogram.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
                .join(found.select("source", "left", *bounds), F.col("s").eqNullSafe(F.col("source")))
                .filter(F.col("before") <= F.col("left"))
                .groupBy("source")
                .agg(F.max_by(F.struct(F.col("b").alias(bound), (F.col("left") - F.col("before")).alias("left"), "n", "rows", *(b for b in bounds if b != bound)), "b").alias("c"))
                .select("source", "c.*")
            )
            found = checkpointed(cut)
            last = shift == 0
            if last and (depth == len(KEYS) - 1 or found.filter("rows > 1").isEmpty()):
                # All keys known: the last document is in if at least half of it fits.
                told = found.select(F.col("source").alias("s"), *bounds, (F.col("left") * 2 >= F.col("n")).alias("fits"))
                return checkpointed(budget.join(told, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "budget")), depth + 1
            wanted = found.select("source", F.col(bound).alias("bucket"))
            inside = checkpointed(inside.join(F.broadcast(wanted) if few(wanted, MAX_BROADCAST_SOURCES) else wanted, F.col("s").eqNullSafe(F.col("source")) & (bucket == F.col("bucket"))).select("s", "size", *KEYS))
        depth += 1


def _copies() -> Column:
    within = F.col("fits")
    for k in reversed(KEYS):
        own, bound = F.col(k), F.col(f"bound_{k}")
        within = (own < bound) | ((own == bound) & within) if k == KEYS[0] else F.when(bound.isNull(), F.col("fits")).otherwise((own < bound) | ((own == bound) & within))
    return F.when(F.col("target") >= F.col("source_size") * CEILING, F.lit(CEILING)).otherwise(F.col("rounds") + F.when(within, 1).otherwise(0)).cast("int")


def _joined(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with their source's bounds, which are broadcast while there are few sources."""
    bounds = bounds.withColumnRenamed("source", "__key")
    return rows.join(F.broadcast(bounds) if few(bounds, MAX_BROADCAST_SOURCES) else bounds, F.col("source").eqNullSafe(F.col("__key")))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row.

    ``copies`` is how often the mix takes the document: whole rounds of its source,
    and one more if its hash lies under the source's threshold. The last document
    is taken if the sum then ends nearer to the target. Rows that share an id, or have
    none, are told apart by their texts; of rows that are alike in both, as many are
    taken as fit. Null text has size 0, null is a source of its own, and an empty
    table gives no rows.
    """
    sized = checkpointed(_sizes(docs, doc_id, source, text, F.monotonically_increasing_id()))
    return _joined(sized, source_bounds(sized)[0]).select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes them, in their own columns and ``copy``, from 1.

    Awkward rows are treated as there. Only where a budget ends among rows that are alike
    in id and text is the table written once, with a number for each row.
    """
    columns = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at = {name: f"c{i}" for i, name in enumerate(columns)}
    own, number = (at[doc_id], at[source], at[text]), F.monotonically_increasing_id()
    bounds, keys = source_bounds(checkpointed(_sizes(inner, *own, number)))
    if keys == len(KEYS):
        inner, number = stored(inner.withColumn("u", number)), F.col("u")
        bounds, _ = source_bounds(checkpointed(_sizes(inner, *own, number)))
    rows = inner.withColumns({"source": F.col(at[source]).cast("string"), "h": hash60(F.col(at[doc_id])), "t": hash60(F.col(at[text])), "u": number})
    taken = _joined(rows, bounds).withColumn("copies", _copies()).filter("copies > 0")
    return taken.select(*(F.col(at[c]).alias(c) for c in columns), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query 5: the words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS t, row_number() OVER () AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS r
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
    2 * coalesce(sum(source_size) OVER f, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS open_w,
    row_number() OVER (ORDER BY source_size / w, r) AS k
  FROM s WINDOW f AS (ORDER BY source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_open AS (
  SELECT k AS k0, 3 * total - 2 * filled AS rest, open_w AS w0 FROM o
  WHERE (3 * total - 2 * filled) * w <= 4 * source_size * open_w ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN k >= k0 THEN (w * rest)::DOUBLE / (2 * w0)::DOUBLE ELSE 2.0 * source_size END::DOUBLE AS target
  FROM o LEFT JOIN first_open ON true
), g AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, t, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
)
SELECT g.doc_id, g.size, t.source_size::BIGINT AS source_size, t.target,
  (g.size * CASE WHEN t.target >= 2 * t.source_size THEN 2
    ELSE (CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END)
      + CASE WHEN 2 * g.before + g.size <= 2 * (t.target - (CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END) * t.source_size) THEN 1 ELSE 0 END END)::BIGINT AS taken
FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
"""
