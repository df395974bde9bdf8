"""Packing into optimal length buckets.

Documents of more than MAX_TOKENS tokens are cut into pieces of that length and a rest. Dynamic programming over the
global histogram of piece lengths, which has at most MAX_TOKENS cells, chooses the bucket widths that minimise padding.
Inside each bucket, pieces in a hashed order fill batches of BATCH_TOKENS // width slots. A bucket with a third of all
pieces is ranked over SPLITS hash groups or more with prefix counts.

Defined results: null and empty text has no tokens and no pieces; repeated rows are separate documents; ties in the hashed
order fall by identifier and piece; an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import clash_free, materialize
from tessella.llm.longest_match import VOCABULARY, token_counts

#: Longest sequence; number of buckets; tokens of a batch, padding included; least hash groups of a bucket, pieces for each.
MAX_TOKENS, BUCKETS, BATCH_TOKENS, SPLITS, SPLIT_ROWS = 2048, 16, 65536, 256, 1_000_000


def bucket_widths(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Widths that minimise total padding; counts[l] pieces have length l, counts[0] is ignored.

    best[j] is the least padding of lengths up to j with the buckets so far; one more bucket (i, j] costs
    j * pieces(i, j] - tokens(i, j]. One vector step for each j and bucket."""
    n = len(counts) - 1
    present = np.flatnonzero(counts[1:]) + 1
    if not len(present):
        return []
    edges = np.append(0, present)
    pieces = np.concatenate(([0], np.cumsum(counts[1:])))[edges].astype(np.float64)
    tokens = np.concatenate(([0], np.cumsum(counts[1:] * np.arange(1, n + 1))))[edges].astype(np.float64)
    m = len(edges)
    cost = edges[None, :] * (pieces[None, :] - pieces[:, None]) - (tokens[None, :] - tokens[:, None])
    cost[np.tril_indices(m)] = np.inf
    best, back = cost[0].copy(), []
    best[0] = 0
    for _ in range(min(buckets, len(present)) - 1):
        total = best[:, None] + cost
        step = total.argmin(axis=0)
        new = total[step, np.arange(m)]
        step = np.where(new < best, step, -1)
        back.append(step)
        best = np.minimum(best, new)
    widths, j = [], m - 1
    for step in reversed(back):
        if step[j] >= 0:
            widths.append(int(edges[j]))
            j = int(step[j])
    widths.append(int(edges[j]))
    return sorted(w for w in widths if w)


def pack(sized: DataFrame, key: str = "doc_id", length: str = "n_tokens", most: int = MAX_TOKENS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece of sized(key, length, ...): piece, start, tokens, width, batch, slot added.

    sized should be cheap to read three times. The driver gets the histogram, at most `most` numbers."""
    added = ("piece", "start", "tokens", "width", "batch", "slot")
    kept = [c for c in sized.columns if c not in added or c in (key, length)]
    starts = F.sequence(F.lit(0), F.ceil(F.col(length) / most).cast("long") - 1)
    pieces = sized.select(*kept).filter(F.col(length) > 0).select(*kept, F.explode(starts).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * most).withColumn("tokens", F.least(F.lit(most), F.col(length) - F.col("start")))
    counts = np.zeros(most + 1, np.int64)
    for r in pieces.groupBy("tokens").count().collect():
        counts[r["tokens"]] = r["count"]
    widths = bucket_widths(counts, buckets)
    if not widths:
        return pieces.withColumn("width", F.lit(None).cast("long")).withColumn("batch", F.lit(None).cast("string")).withColumn("slot", F.lit(None).cast("long"))
    width = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        width = F.when(F.col("tokens") <= w, F.lit(w)).otherwise(width)
    mark = F.xxhash64(key, "piece")
    pieces = pieces.withColumn("width", width.cast("long")).withColumn("_g", F.pmod(mark, F.lit(max(SPLITS, int(counts.sum()) // SPLIT_ROWS))))
    groups = pieces.groupBy("width", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = (F.sum("_n").over(W.partitionBy("width").orderBy("_g")) - F.col("_n")).alias("_before")
    groups = materialize(groups.select("width", "_g", before), "groups")
    ranked = pieces.withColumn("_k", F.row_number().over(W.partitionBy("width", "_g").orderBy(F.xxhash64(key, "piece", F.lit(3)), key, "piece")))
    at = F.col("_before") + F.col("_k") - 1
    slots = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("width"))).cast("long")
    batch = F.concat_ws("-", F.col("width"), F.floor(at / slots))
    return ranked.join(groups, ["width", "_g"]).withColumn("batch", batch).withColumn("slot", at % slots).select(*kept, *added)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document, lengths in longest-match tokens."""
    docs = clash_free(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    sized = materialize(token_counts(docs, VOCABULARY).select("doc_id", "n_tokens"), "lengths")
    return pack(sized)
