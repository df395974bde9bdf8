"""Mixing sources to target weights by entropy balancing.

For every source s the rates r_i of its documents minimise sum(r log r - r) under the token constraint
sum(size_i * r_i) = target_s and the bound r_i <= cap. The dual is convex with one multiplier per source and
r_i = min(cap, exp(lambda_s * size_i / scale_s)): exponentially tilted rates. Safeguarded Newton steps run for all
sources at once over the (source, size) histogram, one aggregate per step; nothing but scalars reaches the driver.
Rates become copies by systematic rounding along the sizes, so a source misses its target by about one document.
DataFrame functions only.

Defined results: null text has size 0; null source is a source of its own, last in order; documents of size 0 have
rate 1 while their source has a target, and take no words; repeated rows are separate documents; an empty table
gives an empty result. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import clash_free, global_rank, materialize, release, word_count

#: Weights of the sources in order, repeating; share of all words that is taken; most copies of a document.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Least hash buckets into which documents of one source and size are split, and documents for each.
SPLITS, SPLIT_ROWS = 256, 1_000_000
#: Newton steps between two writes; relative width of a bracket that holds no other number.
STRIDE, NARROW = 4, 1e-15


def source_targets(hist: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source of hist(source, size, n): sid, source, source_size, target.

    The level L with sum(min(cap * source_size, L * weight)) = share * all sizes comes from repeated resharing of the
    excess; each round is one scalar aggregate over the sources."""
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.max("size").alias("largest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "sid")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", w), "sources")
    limit = F.col("source_size") * F.lit(float(cap))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, wanted = 0.0, share * total
    while total:
        capped = limit <= F.lit(level) * F.col("weight")
        spent, free = ranked.agg(F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free or (wanted - spent) / free <= level:
            break
        level = (wanted - spent) / free
    return ranked.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def newton_step(cells: DataFrame, state: DataFrame, cap: int, tolerance: float) -> DataFrame:
    """state after one safeguarded step of every source: one join and one partially aggregated sum over the cells.

    Sums are decimals, so that no order of rows changes a bit of them. The bracket [low, high] always holds the root; a step
    that leaves it, or comes from a gap that the step before has not halved, becomes a bisection."""
    top, z = F.lit(float(cap)), F.col("size") / F.col("scale")
    r = F.least(top, F.exp(F.least(F.col("lam") * z, F.lit(50.0))))
    exact = lambda c: F.sum(c.cast("decimal(38,15)")).cast("double")
    sums = cells.join(state, "sid").groupBy("sid", "target", "scale", "lam", "low", "high", "gap").agg(
        exact(F.col("n") * z * r).alias("got"), exact(F.when(r < top, F.col("n") * z * z * r).otherwise(0.0)).alias("slope")
    )
    now = sums.withColumn("now", F.col("got") - F.col("target") / F.col("scale"))
    low, high = F.when(F.col("now") <= 0, F.col("lam")).otherwise(F.col("low")), F.when(F.col("now") >= 0, F.col("lam")).otherwise(F.col("high"))
    step = F.when(F.col("slope") > 0, F.col("lam") - F.col("now") / F.col("slope"))
    miss = F.when(F.col("target") > 0, F.abs("now") * F.col("scale") / F.col("target")).otherwise(0.0)
    moved = now.select("sid", "target", "scale", "lam", low.alias("low"), high.alias("high"), step.alias("step"), miss.alias("miss"), F.col("gap").alias("old"), F.abs("now").alias("gap"))
    good = F.col("step").isNotNull() & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high")) & (F.col("gap") <= F.col("old") / 2)
    done = (F.col("miss") <= tolerance) | (F.col("high") - F.col("low") <= NARROW * F.greatest(F.abs("low"), F.abs("high")))
    to = F.when(done, F.col("lam")).when(good, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
    return moved.select("sid", "target", "scale", to.alias("lam"), "low", "high", "gap", done.alias("done"))


def tilted_rates(hist: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = 1e-7, stride: int = STRIDE, most_steps: int = 600) -> DataFrame:
    """hist(sid, size, n) plus rate: the dual's solution by safeguarded Newton steps, until every source meets its target
    or its bracket has no number left inside.

    The multipliers are written to the shared folder after each stride of steps. Every step halves the gap or the
    bracket, so most_steps is never reached; if it were, an error tells."""
    top = F.lit(float(cap))
    state = targets.filter("source_size > 0").select(
        "sid", "target", F.col("largest").cast("double").alias("scale"), F.lit(0.0).alias("lam"),
        F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) * F.col("largest") / F.col("least") - 1e-9).alias("low"),
        (F.log(top) * F.col("largest") / F.col("least")).alias("high"), F.lit(float("inf")).alias("gap"),
    )
    for _ in range(0, most_steps, stride):
        before = state
        for _ in range(stride):
            state = newton_step(hist, state.drop("done"), cap, tolerance)
        state = materialize(state, "newton")
        release(before)
        if state.filter(~F.col("done")).isEmpty():
            break
    else:
        raise ArithmeticError("source weights do not converge")
    rate = F.when(F.col("lam").isNull(), 1.0).otherwise(F.least(top, F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    return hist.join(state.select("sid", "lam", "scale"), "sid", "left").withColumn("rate", rate).drop("lam", "scale")


def entropy_mix(rows: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """rows(source, size, key, ...) plus source_size, target, rate and copies (0 to cap).

    rows should be cheap to read twice. Copies of a (source, size) cell are dealt in the order of a hash of the key,
    ranked over hash buckets with prefix counts, so a cell with a third of all rows is spread over SPLITS groups or more."""
    spark = rows.sparkSession
    rows = rows.drop("source_size", "target", "rate", "copies", "taken")
    hist = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    targets = materialize(source_targets(hist, weights, share, cap), "targets")
    cells = hist.join(targets.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size", "n")
    cells = materialize(cells, "cells")
    cells = tilted_rates(cells, targets, cap)
    run = F.sum(F.col("n") * F.col("rate")).over(W.partitionBy("sid").orderBy("size"))
    owed = F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("n") * F.col("rate") + 0.5)
    owed = F.greatest(F.lit(0), F.least(owed.cast("long"), F.col("n") * cap))
    cells = cells.withColumn("run", run).withColumn("owed", owed).select("sid", "size", "rate", F.floor(F.col("owed") / F.col("n")).alias("each"), (F.col("owed") % F.col("n")).alias("more"))
    cells = materialize(cells.join(targets.select("sid", "source", "source_size", "target"), "sid"), "dealt")

    mark = F.xxhash64(F.col(key))
    many = hist.agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(mark, F.lit(max(SPLITS, many // SPLIT_ROWS)))
    places = rows.groupBy("source", "size", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("source", "size").orderBy("_b")) - F.col("_n")
    places = places.withColumn("_before", before).drop("_n")
    cells = cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", "each", "more")
    places = materialize(places.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z"), "places")
    places = places.select(*(F.col(c).alias(f"_{c}" if c in ("source", "size", "_b") else c) for c in places.columns))

    held = rows.withColumn("_b", bucket)
    held = held.withColumn("_k", F.row_number().over(W.partitionBy("source", "size", "_b").orderBy(F.xxhash64(F.col(key), F.lit(7)), F.col(key))))
    joined = held.join(places, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_b") == F.col("__b")))
    copies = (F.col("each") + (F.col("_k") + F.col("_before") <= F.col("more")).cast("long")).cast("int")
    return joined.withColumn("copies", copies).drop("_b", "__b", "_k", "_before", "_source", "_size", "each", "more")


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken, and the rate and copies behind them."""
    docs = clash_free(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mixed = entropy_mix(rows)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.round("rate", 6).alias("rate"))
