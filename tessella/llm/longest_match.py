"""Greedy longest-match token counts by a linear automaton.

The vocabulary becomes a byte trie. Every node v has a failure link, the node reached after the greedy matcher gives up
at v, and a count of the pieces popped on the way. A word is then counted in time linear in its length, without ever
building a piece: follow trie edges, and on a miss add the popped count and take the failure link.

A word is a run without ASCII white space, matched with a leading space as the vocabulary writes word starts. A word
that no sequence of greedy pieces covers counts as one unknown token. Words met again come from a bounded cache.

Defined results: null and empty text has no words or tokens; long words are matched whole; repeated rows count alike;
an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import byte_view, clash_free, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "n_words long, n_tokens long, n_unknown long"
#: Words of more bytes are matched one by one, shorter ones side by side; most words a worker remembers.
LONG_WORD, CACHE = 64, 250_000


@dataclass
class Automaton:
    """edges: node * 256 + byte of each trie edge; to: its child; fail, popped: per node, fail -1 where there is none.
    keys, targets: the edges as an open-addressing hash table with at most 1 in 4 slots taken, -1 where free."""

    edges: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    popped: np.ndarray

    def __post_init__(self):
        self.shift = np.uint64(64 - max(4, int(4 * len(self.edges) - 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.targets = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left, slot = np.arange(len(self.edges)), self.slots(self.edges)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            where, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[where], self.targets[where] = self.edges[left[won]], self.to[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def near(self, word: bytes) -> dict[int, int]:
        """Edges by any of the word's bytes, at most one per node and byte; kept for the latest word."""
        if getattr(self, "_near", (None,))[0] != word:
            pick = np.isin(self.edges & 255, list(word))
            self._near = (word, dict(zip(self.edges[pick].tolist(), self.to[pick].tolist())))
        return self._near[1]

    def parts(self) -> dict:
        return {"edges": self.edges, "to": self.to, "fail": self.fail, "popped": self.popped}


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a .tiktoken file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def build(pieces: Iterable[bytes]) -> Automaton:
    """Trie by insertion, then failure links level by level."""
    child: list[dict[int, int]] = [{}]
    ends = [False]
    for piece in pieces:
        v = 0
        for b in piece:
            nxt = child[v].get(b)
            if nxt is None:
                nxt = child[v][b] = len(child)
                child.append({})
                ends.append(False)
            v = nxt
        ends[v] = bool(piece)
    fail, popped = [-1] * len(child), [0] * len(child)
    level = [0]
    while level:
        below = []
        for u in level:
            for b, v in child[u].items():
                below.append(v)
                if ends[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and b not in child[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], popped[v] = child[z][b], n
        level = below
    flat = sorted((v << 8 | b, to) for v, edges in enumerate(child) for b, to in edges.items())
    edges, to = np.array(flat, np.int64).reshape(-1, 2).T
    return Automaton(edges.copy(), to.copy(), np.array(fail), np.array(popped))


def step(a: Automaton, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Children by symbol, -1 where there is none."""
    keys = nodes << 8 | symbols
    slot = a.slots(keys)
    found = a.keys[slot]
    out = np.where(found == keys, a.targets[slot], -1).astype(np.int64)
    lane = np.flatnonzero((found != keys) & (found >= 0))
    while len(lane):
        slot[lane] = (slot[lane] + 1) & (len(a.keys) - 1)
        found = a.keys[slot[lane]]
        hit = found == keys[lane]
        out[lane[hit]] = a.targets[slot[lane[hit]]]
        lane = lane[~hit & (found >= 0)]
    return out


def count_together(a: Automaton, words: list[bytes], lead: bytes = b"") -> np.ndarray:
    """Tokens of each word after lead, -1 if unknown; all words advance one byte per round."""
    start, before = walk(a.near(lead), a, lead)
    n = len(words)
    if start < 0:
        return np.full(n, -1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words), np.uint8)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    node, count, dead = np.full(n, start), np.full(n, before), np.zeros(n, bool)

    def give_up(lanes: np.ndarray) -> np.ndarray:
        """Pop what the nodes hold and follow their links; the lanes that go on."""
        back = a.fail[node[lanes]]
        count[lanes] += a.popped[node[lanes]]
        dead[lanes[back < 0]] = True
        node[lanes] = np.maximum(back, 0)
        return lanes[back >= 0]

    live = n
    for k in range(int(lengths[0]) if n else 0):
        while live and lengths[live - 1] <= k:
            live -= 1
        lanes = np.flatnonzero(~dead[:live])
        while len(lanes):
            nxt = step(a, node[lanes], flat[begin[lanes] + k].astype(np.int64))
            ok = nxt >= 0
            node[lanes[ok]] = nxt[ok]
            lanes = give_up(lanes[~ok])
    lanes = np.flatnonzero(~dead & (node > 0))
    while len(lanes):
        lanes = give_up(lanes)
        lanes = lanes[node[lanes] > 0]
    out = np.empty(n, np.int64)
    out[order] = np.where(dead, -1, count)
    return out


def walk(edges: dict[int, int], a: Automaton, word: bytes) -> tuple[int, int]:
    """Node and popped tokens after reading word from the root; node -1 if the word cannot be matched."""
    v = n = 0
    for b in word:
        while (nxt := edges.get(v << 8 | b)) is None:
            n += int(a.popped[v])
            v = int(a.fail[v])
            if v < 0:
                return -1, n
        v = nxt
    return v, n


def count_one(edges: dict[int, int], a: Automaton, word: bytes) -> int:
    """Tokens of one word, -1 if unknown."""
    v, n = walk(edges, a, word)
    while v > 0:
        n += int(a.popped[v])
        v = int(a.fail[v])
    return -1 if v < 0 else n


class Counter:
    """Counts words, remembering the latest."""

    def __init__(self, automaton: Automaton, lead: bytes = b" "):
        self.a, self.lead, self.known, self.edges = automaton, lead, {}, None

    def learn(self, words: set[bytes]) -> None:
        fresh = words - self.known.keys()
        if len(self.known) + len(fresh) > CACHE:
            self.known, fresh = {}, words
        short = [w for w in fresh if len(w) <= LONG_WORD]
        for i in range(0, len(short), 1 << 16):
            part = short[i : i + (1 << 16)]
            self.known.update(zip(part, count_together(self.a, part, self.lead).tolist()))
        self.long = [w for w in fresh if len(w) > LONG_WORD]  # counted now, forgotten after use
        if self.long and self.edges is None:
            self.edges = dict(zip(self.a.edges.tolist(), self.a.to.tolist()))
        for w in self.long:
            self.known[w] = count_one(self.edges, self.a, self.lead + w)

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and unknown words of each text."""
        words = [t.split() for t in texts]
        self.learn(set().union(*words))
        get, n = self.known.__getitem__, len(texts)
        sizes = np.fromiter(map(len, words), np.int64, n)
        each = np.fromiter(map(get, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        for w in self.long:
            del self.known[w]
        row = np.repeat(np.arange(n), sizes)
        unknown = np.bincount(row, each < 0, minlength=n).astype(np.int64)
        return sizes, np.bincount(row, np.where(each < 0, 1, each), minlength=n).astype(np.int64), unknown


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, lead: bytes = b" ", text: str = "text") -> DataFrame:
    """docs plus n_words, n_tokens, n_unknown. The automaton's size is bounded by the vocabulary's; no shuffle."""
    added = T._parse_datatype_string(SCHEMA)
    docs = docs.drop(*(c for c in added.names if c != text))
    schema = T.StructType(docs.schema.fields + added.fields)
    shared = docs.sparkSession.sparkContext.broadcast(build(read_vocabulary(vocabulary)).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Automaton(**shared.value), lead)
        for piece in slices(batches, text):
            data, offsets = byte_view(piece.column(text))
            whole, ends = data.tobytes(), offsets.tolist()
            found = counter.count([whole[a:b] for a, b in zip(ends, ends[1:])])
            yield pa.RecordBatch.from_arrays(piece.columns + [pa.array(x) for x in found], names=piece.schema.names + added.names)

    return docs.mapInArrow(run, schema)


def op4_longest_match(spark, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of every document."""
    return token_counts(clash_free(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")).drop("text")
