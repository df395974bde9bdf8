import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import near_dedup as nd
from tessella.llm import suffix_dedup as sd


def word_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            sets[i].add(word_set(t))
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}, sets


def check_groups(got, rows):
    want, sets = brute_groups(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
            assert any(len(s) == r["n_shingles"] for s in sets[r["doc_id"]])


def test_near_groups_equal_brute_force(docs, corpus):
    check_groups(nd.near_groups(docs).collect(), [(r[0], r[1]) for r in corpus])


def test_chained_near_copies(spark):
    """A chain in which most members are far apart, so that the bucket's smallest node links few of them."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        words[(k * 7) % 120] = f"v{k}"
        rows.append((k * 13 % 60, " ".join(words)))
    check_groups(nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_words_a_shingle(spark):
    """Three changed words of sixty: alike by pairs of words, not by five; one changed word: alike by both."""
    words = [f"w{i}" for i in range(60)]
    far, near = (" ".join("v" if i in at else w for i, w in enumerate(words)) for at in ((10, 30, 50), (30,)))
    df = spark.createDataFrame([(1, " ".join(words)), (2, far), (3, "p q r"), (4, near.upper())], "doc_id long, text string")
    two, five = ({r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_groups(df, size=k).collect()} for k in (2, 5))
    assert two == {1: (59, 1), 2: (59, 1), 3: (2, 3), 4: (59, 1)}
    assert five == {1: (56, 1), 2: (56, 2), 3: (1, 3), 4: (56, 1)}


def test_texts_of_one_identifier_belong_together(spark):
    a, b, c = ("a b c d e f g h", "p q r s t u v w", "k l m n o k l m")
    rows = [(1, a), (5, a), (5, b), (9, b + " b"), (9, b), (9, b), (7, c)]
    got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1), (9, 1), (9, 1)]


def test_near_groups_of_nothing(nothing):
    assert nd.near_groups(nothing).count() == 0


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900, np.uint64))
    b = np.unique(np.concatenate([a[:850], rng.integers(0, 2**63, 50, np.uint64)]))
    far = np.unique(rng.integers(0, 2**63, 900, np.uint64))
    odd = nd.odd_sketches(nd.minhashes([a, b, far], nd.BANDS * nd.ROWS))
    xor = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    assert xor(odd[0], odd[1]) <= nd.most_different() < xor(odd[0], odd[2])
    full = nd.parities([a, b, far])
    assert xor(full[0], full[1]) <= len(np.setxor1d(a, b))
    assert xor(full[0], full[0]) == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["component"] for r in nd.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}


def brute_repeats(rows):
    """rows of unique identifiers, in order; what each loses."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - sd.LENGTH + 1):
            g = b[p : p + sd.LENGTH]
            if g in seen:
                gone[p : p + sd.LENGTH] = True
            seen.add(g)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(docs, corpus):
    want = brute_repeats({(r[0], r[1]) for r in corpus if r[0] is not None})
    got = sd.drop_repeats(docs, with_text=True).collect()
    assert len(got) == len(corpus)
    for r in got:
        told = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert told == want[r["doc_id"]]
            assert len(r["kept_text"].encode()) <= r["n_bytes"] - r["n_removed"]


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_are_one_document(spark, parts):
    """Rows that repeat identifier and text, alone, with copies under other identifiers and beside another text."""
    rng = np.random.default_rng(6)
    a, b, c, d = ("".join(chr(97 + x) for x in rng.integers(0, 26, 400)) for _ in range(4))
    alone = [(1, a), (2, b), (3, b), (4, c + a[:150]), (5, d), (6, d[:200] + c)]
    want = brute_repeats(alone)
    rows = [r for r in alone for _ in range(1 if r[0] == 6 else 3)]
    df = spark.createDataFrame(rows[::2] + rows[1::2], "doc_id long, text string").repartition(parts)
    got = sd.drop_repeats(df).collect()
    assert len(got) == len(rows) and want[1][1] == 0
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_repeats_of_nothing(nothing):
    assert sd.drop_repeats(nothing).count() == 0


def test_an_anchor_in_several_shards(spark, monkeypatch):
    """Small shards, so that one passage's units are cut and later shards search earlier ones."""
    rng = np.random.default_rng(3)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 26, 150))
    rows = [(i, "".join(chr(97 + x) for x in rng.integers(0, 26, 200)) + passage[: 100 + i % 50] + "".join(chr(97 + x) for x in rng.integers(0, 26, 100))) for i in range(60)]
    want = brute_repeats(rows)
    monkeypatch.setattr(sd, "SHARD_BYTES", 600)
    got = sd.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_hot_anchors_travel_by_window(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(sd, "MOST_UNITS", 2)
    want = brute_repeats({(r[0], r[1]) for r in corpus if r[0] is not None})
    for r in sd.drop_repeats(docs).collect():
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_long_texts_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 3000))
    rows = [(1, text + text[500:900]), (2, "zz" + text[1000:2500]), (3, "ab" * 700)]
    monkeypatch.setattr(sd, "PIECE", 700)
    got = sd.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_suffix_arrays(strings):
    shard = sd.Shard(strings)
    base = np.cumsum([0, *map(len, strings)])
    suffixes = sorted((strings[k][i:], k, base[k] + i) for k in range(len(strings)) for i in range(len(strings[k])))
    suffixes.sort(key=lambda s: (s[0], s[1]))  # a terminator is below all bytes, in string order
    assert shard.order.tolist() == [at for _, _, at in suffixes]

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    lcp = shard.common().tolist()
    assert lcp[1:] == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]


@pytest.mark.parametrize("k", [0, 1, 5])
def test_search(k):
    rng = np.random.default_rng(k)
    text = bytes(rng.integers(0, 4, 600, np.uint8))
    shard = sd.Shard([text])
    slots = np.flatnonzero(shard.end[shard.order] - shard.order >= sd.LENGTH)
    probes = np.stack([np.frombuffer(text[i : i + 100], np.uint8) for i in (0, 77, 500)] + [rng.integers(0, 4, 100, np.uint8)])
    assert sd.search(shard, slots, probes).tolist() == [True, True, True, False]


def test_components_of_a_long_path_and_a_star(spark):
    """A path of 5,000 nodes in shuffled numbering, a star, and a cycle: no limit of rounds."""
    rng = random.Random(3)
    names = rng.sample(range(10_000, 20_000), 5000)
    edges = list(zip(names, names[1:])) + [(1, k) for k in range(2, 600)] + [(700, 701), (701, 702), (702, 700)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(names) for n in names if n != min(names)} | {k: 1 for k in range(2, 600)} | {701: 700, 702: 700}
    assert got == want


def test_different_texts_of_one_identifier(spark):
    """One of the two keeps the passage that they share, and nothing else goes."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    shared = noise(300)
    rows = [(4, noise(200) + shared + noise(150)), (4, noise(250) + shared + noise(170))]
    got = sd.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted(r["n_removed"] for r in got)
    assert removed[0] == 0 and 300 <= removed[1] <= 303
