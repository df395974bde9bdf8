"""Near-duplicate groups by banded MinHash with odd sketches.

Documents with equal shingle sets form classes first; each class is one node, named by its smallest document. MinHash
bands propose candidates, parity bitmaps of the MinHash samples (odd sketches) estimate their similarity by XOR
population counts. A parity bitmap of the whole set then gives a bound that loses nothing: its XOR population count never
exceeds the symmetric difference. What may reach the threshold is confirmed on the full sets, read anew from the texts.

A bucket never becomes all pairs of its rows. First each node meets its bucket's smallest node. Buckets that still hold
several components then compare sketches in blocks of BLOCK rows: nodes meet their most similar node of another
component, and at last every remaining pair across components whose sketches allow it is confirmed. Components come
from alternating star contractions written to the shared folder.

Defined results: null, empty or blank text has an empty set and is linked with nothing; rows with a null identifier are
their own group with a null component; rows that share an identifier are one document, linked if any of their texts is;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_view, clash_free, materialize, release, slices

#: Words a shingle, unless near_groups is told otherwise; similarity threshold in percent.
WORDS, PERCENT = 2, 80
#: Bands, rows a band (a pair at 0.8 is missed with probability 5e-7); bits of an odd sketch and of a set's parity bitmap,
#: powers of two from 64.
BANDS, ROWS, BITS, SET_BITS = 48, 6, 1024, 2048
#: Standard deviations below the threshold that a sketch may estimate before a pair is dropped.
SLACK = 5.0
#: Rows compared side by side; partners of a node in one group; most requests that are broadcast.
BLOCK, PARTNERS, BROADCAST_ROWS = 512, 128, 100_000
CHUNK, CACHE = 1 << 16, 200_000


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash, remembering a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(raw: bytes, words: WordHash, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text; a shorter text is one shingle."""
    split = raw.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = max(1, len(w) - size + 1)
    h = np.full(n, len(w) if len(w) < size else size, np.uint64)
    for k in range(min(size, len(w))):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(h)


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(sets, n) samples; sets must not be empty."""
    a, b = coefficients(n)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint64)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(flat * a[i] + b[i], starts)
    return out


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(rows, bits / 64) words; bit p is the parity of the samples that fall on it."""
    rows, n = samples.shape
    place = (mixed(samples + np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)) % np.uint64(bits)
    parity = np.zeros((rows, bits), np.uint8)
    np.bitwise_xor.at(parity, (np.repeat(np.arange(rows), n), place.ravel().astype(np.int64)), 1)
    return np.packbits(parity, axis=1).view(">u8").astype(np.uint64)


def parities(sets: list[np.ndarray], bits: int = SET_BITS) -> np.ndarray:
    """(sets, bits / 64) words; bit p is the parity of the set's members that fall on it."""
    flat = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)) * bits, [len(s) for s in sets]) + (flat & np.uint64(bits - 1)).astype(np.int64)
    parity = (np.bincount(place, minlength=len(sets) * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(sets), bits), axis=1).view(">u8").astype(np.uint64)


def most_different(percent: int = PERCENT, samples: int = BANDS * ROWS, bits: int = BITS, slack: float = SLACK) -> int:
    """Largest XOR population count of two sketches that may belong to a pair at the threshold."""
    j = percent / 100
    differing = 2 * (samples * (1 - j) + slack * np.sqrt(samples * j * (1 - j)))
    spread = np.sqrt(bits) / 2 * np.sqrt(1 - np.exp(-4 * differing / bits))
    return int(np.ceil(bits * (1 - np.exp(-2 * differing / bits)) / 2 + spread))


def signatures(batches: Iterator[pa.RecordBatch], size: int = WORDS) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_shingles, set_key, bands, sketch, parity (the last three null for an empty set)."""
    words, n = WordHash(), BANDS * ROWS
    salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for piece in slices(batches, "text"):
        data, offsets = byte_view(piece.column("text"))
        whole, ends = data.tobytes(), offsets.tolist()
        sets = [shingles(whole[a:b], words, size) for a, b in zip(ends, ends[1:])]
        sizes = np.array([len(s) for s in sets])
        full = np.flatnonzero(sizes)
        bands, sketch, parity = ([None] * len(sets) for _ in range(3))
        group = np.cumsum(sizes[full]) // CHUNK
        for g in np.unique(group):
            rows = full[group == g]
            own = [sets[i] for i in rows]
            samples = minhashes(own, n)
            h = np.broadcast_to(salt, (len(rows), BANDS)).copy()
            for k in range(ROWS):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + samples[:, k::ROWS])
            odd = odd_sketches(samples)
            for i, x, y, z in zip(rows.tolist(), h.view(np.int64), odd.view(np.int64), parities(own).view(np.int64)):
                bands[i], sketch[i], parity[i] = x, y, z
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        arrays = [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands", "sketch", "parity"])


def confirm(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    One join brings texts to requests; partners of a node are dealt over groups of about PARTNERS, each of which streams
    through one task after the node's own text, so memory holds two sets at a time."""
    groups = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("groups")).filter("groups > 1"), "hubs")
    hubs = groups.limit(BROADCAST_ROWS + 1).count()
    pairs = pairs.select("a", "b").join(F.broadcast(groups) if hubs <= BROADCAST_ROWS else groups, "a", "left")
    pairs = pairs.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("groups")), F.lit(0)).cast("int").alias("salt"))
    first = pairs.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct()
    asked = materialize(first.unionByName(pairs.select(F.col("b").alias("doc_id"), "a", "salt", "b")), "requests")
    small = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = docs.select("doc_id", "text").join(F.broadcast(asked) if small else asked, "doc_id")
    dealt = found.select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own, of = WordHash(), [], None
        for piece in slices(batches, "text"):
            data, offsets = byte_view(piece.column("text"))
            whole, ends, out = data.tobytes(), offsets.tolist(), []
            for i, (a, salt, b) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("a", "salt", "b")))):
                s = shingles(whole[ends[i] : ends[i + 1]], words, size)
                if (a, salt) != of:
                    own, of = [], (a, salt)
                if b is None:
                    own.append(s)
                    continue
                for t in own:
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        out.append((a, b))
                        break
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return materialize(dealt.mapInArrow(run, "a long, b long").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges(a, b) that is not itself the smallest, by
    alternating star contractions.

    The smallest neighbour of each node is a partially aggregated minimum; it is written, so that the join that follows
    can be split when one node has very many edges. Rounds go on until the edges are stars: every node has one edge
    to a smaller one, and no centre has an edge of its own."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(small.filter("u <> v").distinct(), "stars")
        release(edges, least, large, low)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def stars(edges: DataFrame) -> bool:
    """Whether every u of edges(u, v) has one edge and no v is a u."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(node, ...) plus component."""
    return rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def proposals(batches: Iterator[pa.RecordBatch], limit: int, nearest: bool, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Pairs across components from sorted block rows (key, i, j, side, node, component, n, sketch, parity).

    A block pair has at most 2 * BLOCK rows; nearest keeps each node's most similar partner only."""

    def pairs_of(node, part, n, side, sketch, parity):
        rows, cols = (side == 0, side == 1) if (side == 1).any() else (side == 0, side == 0)
        differ = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[cols][None, :, :]).sum(axis=2, dtype=np.int64)
        low, high = np.minimum(n[rows][:, None], n[cols][None, :]), np.maximum(n[rows][:, None], n[cols][None, :])
        ok = (part[rows][:, None] != part[cols][None, :]) & (differ <= limit) & (100 * low >= percent * high)
        x, y = np.nonzero(ok)
        for k in range(0, len(x), 1 << 14):  # the exact bound on what is left
            i, j = np.flatnonzero(rows)[x[k : k + (1 << 14)]], np.flatnonzero(cols)[y[k : k + (1 << 14)]]
            least = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
            ok[x[k : k + (1 << 14)], y[k : k + (1 << 14)]] = least * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
        if nearest:
            differ = np.where(ok, differ, BITS + 1)
            keep = np.zeros_like(ok)
            keep[np.arange(len(keep)), differ.argmin(axis=1)] = True
            keep[differ.argmin(axis=0), np.arange(keep.shape[1])] = True
            ok &= keep
        x, y = np.nonzero(ok)
        return node[rows][x], node[cols][y]

    held, of = [], None

    def flush():
        if not held:
            return None
        table = pa.Table.from_batches(held)
        part = [table.column(c).to_numpy() for c in ("node", "component", "n", "side")]
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        parity = table.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        a, b = pairs_of(*part, sketch, parity)
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))}) if len(a) else None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if (now := tuple(keys[:, s])) != of:
                if (out := flush()) is not None:
                    yield out
                held, of = [], now
            held.append(batch.slice(s, e - s))
    if (out := flush()) is not None:
        yield out


def open_blocks(rows: DataFrame, reps: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of buckets with several components, dealt over pairs of blocks of about BLOCK rows.

    Rows of a bucket's largest component meet only blocks of the others, so that a large group with a few strays costs
    a copy of each row per block of strays."""
    told = labelled(rows.filter("m > 2").select("node", "key", "n"), parts)
    sizes = told.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    buckets = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    buckets = materialize(buckets.select("key", F.col("m") - F.col("top.c"), "top.c", "top.component").toDF("key", "few", "many", "largest"), "open")
    blocks = lambda c: F.ceil(F.col(c) / (0.8 * BLOCK)).cast("int")
    wide = told.join(buckets, "key").join(reps, "node").withColumn("a", blocks("few")).withColumn("b", blocks("many"))
    stray, mark = F.col("component") != F.col("largest"), F.xxhash64("node")
    own = F.when(stray, F.pmod(mark, F.col("a"))).otherwise(F.col("a") + F.pmod(mark, F.col("b"))).cast("int")
    others = F.sequence(F.lit(0), F.when(stray, F.col("a") + F.col("b") - 1).otherwise(F.col("a") - 1))
    dealt = wide.select("key", "node", "component", "n", "sketch", "parity", own.alias("own"), F.explode(others).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = (F.col("own") > F.col("other")).cast("int")
    return dealt.select("key", i.alias("i"), j.alias("j"), side.alias("side"), "node", "component", "n", "sketch", "parity")


def differing(x: str, y: str) -> Column:
    """Population count of the XOR of two word arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def near_groups(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for docs(doc_id, text); size: words a shingle."""
    docs = clash_free(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sig = docs.mapInArrow(lambda batches: signatures(batches, size), "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>, parity array<long>")
    sig = materialize(sig, "signatures")
    held = sig.filter("n_shingles > 0 and doc_id is not null")
    again = materialize(sig.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    repeated = not again.isEmpty()
    if repeated:
        held = materialize(held.dropDuplicates(["doc_id", "set_key"]), "held")
    copies = held.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).filter("rep <> top").drop("top")
    copies = materialize(copies, "copies")  # read anew, the join's skewed side can be split
    placed = sig.select("doc_id", "n_shingles", "set_key").join(copies, "set_key", "left")
    placed = materialize(placed.select("doc_id", "n_shingles", "set_key", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("node")), "placed")

    others = placed.filter("node <> doc_id").select("doc_id", "set_key").distinct()
    reps = held.select(F.col("doc_id").alias("node"), "sketch", "parity")
    rows = held.join(others, ["doc_id", "set_key"], "left_anti").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    leads = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    rows = materialize(rows.join(materialize(leads, "leads"), "key"), "buckets")
    alike = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    pairs = rows.filter((F.col("lead.node") != F.col("node")) & alike)
    pairs = pairs.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), (F.col("n") + F.col("lead.n")).alias("sizes")).distinct()
    both = pairs.join(reps.toDF("b", "sb", "pb"), "b").join(reps.toDF("a", "sa", "pa"), "a")
    may = (differing("sa", "sb") <= most_different(percent)) & (differing("pa", "pb") * (100 + percent) <= F.col("sizes") * (100 - percent))
    checked = materialize(both.filter(may).select("a", "b"), "pairs")
    edges = confirm(docs, checked, percent, size)
    if repeated:  # the texts of one identifier belong together
        edges = edges.unionByName(placed.join(again, "doc_id", "left_semi").filter("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct())
    parts = components(edges)

    limit = most_different(percent)
    for nearest in (True, False):
        blocks = open_blocks(rows, reps, parts).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = blocks.mapInArrow(lambda batches, n=nearest: proposals(batches, limit, n, percent), "a long, b long").distinct()
        fresh = materialize(found.join(checked, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            continue
        more = confirm(docs, fresh, percent, size)
        checked, edges = checked.unionByName(fresh), edges.unionByName(more)
        if not more.isEmpty():
            parts = components(edges)

    out = labelled(placed.drop("set_key"), parts)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
