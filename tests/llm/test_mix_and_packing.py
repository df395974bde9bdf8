import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, packing
from tessella.llm import source_mix as sm


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, left, target = share * sum(sizes.values()), set(names), {}
    while left:
        level = (total - sum(target.values())) / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in left}
        target |= {s: cap * sizes[s] for s in over}
        left -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, got, n_rows):
    sizes = defaultdict(int)
    for s, t in rows:
        sizes[s] += words(t)
    target, taken = water_fill(dict(sizes)), defaultdict(int)
    assert len(got) == n_rows
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    return target, taken


def test_mix_of_edge_rows(spark, docs, corpus):
    rows = docs.withColumn("size", common.word_count(F.col("text"))).select("doc_id", "source", "size")
    got = [r.asDict() | {"taken": r["size"] * r["copies"]} for r in sm.entropy_mix(rows).collect()]
    assert sorted(r["size"] for r in got) == sorted(words(r[1]) for r in corpus)
    target, taken = check_mix([(r[3], r[1]) for r in corpus], got, len(corpus))
    largest = max(words(r[1]) for r in corpus)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in target)


def test_mix_meets_targets_and_repeats(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"s{rng.choice([1, 1, 1, 2, 3, 10, 20])}", "w " * int(rng.lognormvariate(4, 1))) for i in range(4000)] + [(i, "hot", "w " * 30) for i in range(4000, 6000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sm.op6_source_mix(spark, str(tmp_path)).collect()
    sources = {i: s for i, s, _ in rows}
    told = [r.asDict() | {"source": sources[r["doc_id"]]} for r in got]
    target, taken = check_mix([(s, t) for _, s, t in rows], told, len(rows))
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 600 for s in target)
    again = sm.op6_source_mix(spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(again)
    for r in got:  # rates solve the dual: log rate is proportional to size below the cap
        assert 0 <= r["rate"] <= 2
    for s in set(sources.values()):
        mine = sorted({(r["size"], r["rate"]) for r in got if sources[r["doc_id"]] == s and r["size"] > 20 and 0.01 < r["rate"] < 1.99})
        slopes = [np.log(rate) / size for size, rate in mine]
        assert not slopes or max(slopes) - min(slopes) < 1e-4 + 0.02 * abs(np.mean(slopes))


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert sm.entropy_mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert sorted((r["copies"], r["target"]) for r in sm.entropy_mix(blank).collect()) == [(1, 0.0), (1, 0.0)]


def test_ranks(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 500)] + [(None,)], "v int")
    got = sorted((r["k"], r["v"]) for r in common.global_rank(df, [F.col("v").asc_nulls_last()], "k").collect())
    assert [k for k, _ in got] == list(range(501)) and got[-1][1] is None
    assert [v for _, v in got[:-1]] == sorted(v for _, v in got[:-1])


def padding(counts, widths):
    return sum(c * (min(w for w in widths if w >= n) - n) for n, c in enumerate(counts) if n and c)


@pytest.mark.parametrize("seed", range(6))
def test_widths_are_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = np.append(0, rng.integers(0, 9, 11))
    for k in (1, 2, 3, 20):
        got = packing.bucket_widths(counts, k)
        top = int(np.flatnonzero(counts).max())
        best = min(padding(counts, [*c, top]) for r in range(k) for c in itertools.combinations(range(1, top), min(r, top - 1)))
        assert len(got) <= k and padding(counts, got) == best
    assert packing.bucket_widths(np.zeros(5, int), 3) == []


def test_batches(spark):
    rng = random.Random(3)
    sizes = [0, 1, 2048, 2049, 10_000] + [rng.choice([17, 300, int(rng.lognormvariate(5, 1))]) for _ in range(800)]
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(sizes)] + [(5, sizes[5], "clash")], "doc_id long, n_tokens long, batch string")
    got = packing.pack(df, buckets=5, batch_tokens=8192).collect()
    total = defaultdict(int)
    for r in got:
        total[r["doc_id"]] += r["tokens"]
        assert 0 < r["tokens"] <= r["width"] and r["start"] == r["piece"] * 2048
    assert {i: n for i, n in total.items() if i != 5} == {i: n for i, n in enumerate(sizes) if n and i != 5}
    assert total[5] == 2 * sizes[5]
    slots = defaultdict(list)
    for r in got:
        slots[r["batch"], r["width"]].append(r["slot"])
    per_width = defaultdict(list)
    for (_, w), s in slots.items():
        assert sorted(s) == list(range(len(s))) and len(s) * w <= max(8192, w)
        per_width[w].append(len(s))
    for w, counts in per_width.items():
        assert sum(c < max(1, 8192 // w) for c in counts) <= 1  # only a bucket's last batch is short


def test_packing_documents(spark, folder, corpus, nothing):
    got = packing.op9_packing(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in corpus if words(r[1])}
    assert packing.pack(nothing.select("doc_id", F.lit(3).cast("long").alias("n_tokens"))).count() == 0


@pytest.mark.parametrize("sizes, target", [
    ({1: 10, 1_000_000: 1}, 1_000_100.0), ({1: 1_000_000, 50_000: 40}, 2_999_000.0), ({7: 3}, 41.9999999), ({5: 10, 6: 10}, 1e-6), ({1: 5, 2: 5}, 30.0),
])
def test_slow_sources_reach_their_targets(spark, sizes, target):
    """Sizes that differ by six orders of magnitude, targets at the bound or near nothing: no step limit ends early."""
    hist = spark.createDataFrame([(1, s, n) for s, n in sizes.items()], "sid long, size long, n long")
    total = sum(s * n for s, n in sizes.items())
    targets = spark.createDataFrame([(1, "a", total, max(sizes), min(sizes), target)], "sid long, source string, source_size long, largest long, least long, target double")
    rates = {r["size"]: r["rate"] for r in sm.tilted_rates(hist, targets).collect()}
    assert sum(s * n * rates[s] for s, n in sizes.items()) == pytest.approx(target, rel=2e-7)


def test_packed_batches_by_brute_force(spark):
    """Every piece once, in the narrowest bucket that holds it; slots of a batch are distinct and within its tokens."""
    rng = random.Random(7)
    sized = [(i, rng.choice([0, 1, 5, 40, 41, 300, 2048, 2049, 5000])) for i in range(500)] + [(9, 41), (9, 41)]
    got = packing.pack(spark.createDataFrame(sized, "doc_id long, n_tokens long")).collect()
    want = sorted((d, p, p * 2048, min(2048, n - p * 2048)) for d, n in sized for p in range(-(-n // 2048)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["tokens"]) for r in got) == want
    counts = np.bincount([w[3] for w in want], minlength=2049)
    widths = packing.bucket_widths(counts)
    assert all(r["width"] == min(w for w in widths if w >= r["tokens"]) for r in got)
    batches = defaultdict(list)
    for r in got:
        batches[r["batch"]].append((r["slot"], r["width"]))
    for slots in batches.values():
        assert len({s for s, _ in slots}) == len(slots) and len({w for _, w in slots}) == 1
        assert len(slots) * slots[0][1] <= packing.BATCH_TOKENS
    for w in widths:  # all batches of a bucket are full but the last
        sizes = sorted(len(s) for s in batches.values() if s[0][1] == w)
        assert all(n == packing.BATCH_TOKENS // w for n in sizes[1:])
