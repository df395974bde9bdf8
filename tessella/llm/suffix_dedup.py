"""Removal of repeated passages by per-shard suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts earlier is removed (earlier: in a document of smaller
identifier, or before in the same one; judged on the input). Three narrow steps lead to the suffix arrays:

1. Winnowing. Each window of LENGTH bytes is anchored at the least hash among its GRAM-byte grams. The anchor depends on
   the window's bytes only, so equal windows have equal anchors. Windows that follow each other and share an anchor form
   a unit. Anchors that occur once in the corpus cannot belong to a repeated window and drop out.
2. The other units travel with their bytes to the shard of their anchor. Units of equal bytes meet early, in the task
   that reads them, where the first stands for all and the rest is removed; a passage in very many documents therefore
   sends few rows.
3. Each shard builds a suffix array of its distinct units by Larsson-Sadakane refinement, common prefixes by Kasai's
   rule in its permuted form, and marks all but the earliest window of each run. An anchor with more bytes than one
   shard is cut into several, in document order; later ones look their windows up in earlier ones by binary search.

Exact copies of a text are settled with their first copy: a copy of at least LENGTH bytes is removed whole.

Defined results: null and empty text has no bytes; a row with a null identifier is compared with nothing and keeps its
bytes; rows that repeat an identifier and text are one document; different texts under one identifier are documents of
their own, and one of them keeps a passage that they share; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import byte_view, clash_free, materialize, slices
from tessella.llm.near_dedup import mixed

#: Bytes of a removable string; bytes of a gram; bytes of units that one suffix array holds; texts of an anchor that one
#: task takes; most anchors whose list is broadcast.
LENGTH, GRAM, SHARD_BYTES, MOST_UNITS, BROADCAST_ROWS = 100, 32, 1 << 20, 20_000, 100_000
#: Gram starts of one window.
WINDOW = LENGTH - GRAM + 1
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Positions share a word with truncated hashes, so a text is handled in pieces of at most this many bytes.
PIECE = 1 << 22
#: Bytes of texts handled side by side; their arrays take some 100 times as many.
SLICE = 1 << 20
PLACE = np.uint64((1 << 24) - 1)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(max(n, 1 << 16), BASE)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = INVERSE
            self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up[:n], self.down[:n]


def prefix_hash(data: np.ndarray, powers: Powers) -> np.ndarray:
    """n + 1 running sums; (s[b] - s[a]) * down[a] identifies data[a:b]."""
    up, _ = powers.get(len(data) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))


def units(data: np.ndarray, offsets: np.ndarray, powers: Powers):
    """Of all texts in data: row, anchor hash, first and last window start (absolute) of each unit; and the prefix hash."""
    sums = prefix_hash(data, powers)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < LENGTH:
        return *empty, sums
    _, down = powers.get(len(data) + 1)
    n = len(data) - GRAM + 1
    h = mixed((sums[GRAM : GRAM + n] - sums[:n]) * down[:n])
    m = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < WINDOW:
        m = np.minimum(m[: len(m) - (WINDOW - width)], m[WINDOW - width :])
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - LENGTH + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[rows]
    anchor = (m[at] & PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return *empty, sums
    last = np.append(first[1:], len(at)) - 1
    return rows[first], h[anchor[first]], at[first], at[last], sums


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Slices with their bytes, offsets, row of each part and start of each part in its text, and whether the text is
    parted. Texts longer than PIECE are, with LENGTH - 1 bytes of overlap, so that each window is in exactly one part."""
    for batch in slices(batches, "text", SLICE):
        data, offsets = byte_view(batch.column("text"))
        if len(data) <= PIECE:
            yield batch, data, offsets, np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), False
            continue
        for row in range(batch.num_rows):
            own = data[offsets[row] : offsets[row + 1]]
            for start in range(0, max(len(own), 1), PIECE - LENGTH + 1):
                part = own[start : start + PIECE]
                if start and len(part) < LENGTH:
                    break
                yield batch, part, np.array([0, len(part)]), np.array([row]), np.array([start]), len(own) > PIECE


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, tkey -> route, hash, tkey, texts. Of an anchor met with several texts here, one row goes to the anchor's task
    and tells how many there were; the rest are dealt anywhere, with texts = 0."""
    powers = Powers()
    for batch, data, offsets, rows_of, _, parted in pieces(batches):
        row, h, _, _, _ = units(data, offsets, powers)
        if not len(row):
            continue
        tkey = batch.column("tkey").to_numpy()[rows_of][row]
        order = np.lexsort((tkey, h))
        h, tkey = h[order], tkey[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        fresh = new.copy()
        fresh[1:] |= tkey[1:] != tkey[:-1]
        group = np.cumsum(new) - 1
        texts = np.bincount(group, fresh).astype(np.int64)
        often = np.bincount(group) > 1  # or more than once in a text, or perhaps in several parts of one
        texts = np.where(often | parted, np.maximum(texts, 2), texts)[group][fresh]
        h, tkey, lead = h[fresh], tkey[fresh], new[fresh]
        texts = np.where(lead, texts, 0)
        route = np.where(lead, h, mixed(h ^ tkey.view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(h.view(np.int64)), pa.array(tkey), pa.array(texts)], names=["route", "hash", "tkey", "texts"])


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash -> tkey, hash of anchors that are known to be shared or come with several texts, and whether
    the anchor has more than MOST_UNITS of them."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "tkey", "texts")]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            end = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        else:
            if held is None:
                return
            now, end = held, len(held[0])
        held = [x[end:] for x in now]
        h, tkey, texts = (x[:end] for x in now)
        if not end:
            continue
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = (np.minimum.reduceat(tkey, start) != np.maximum.reduceat(tkey, start)) | np.logical_or.reduceat(texts != 1, start)
        sizes = np.diff(np.append(start, end))
        out, hot = np.repeat(many, sizes), np.repeat(np.add.reduceat(texts, start) > MOST_UNITS, sizes)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(tkey[out]), pa.array(h[out]), pa.array(hot[out])], names=["tkey", "hash", "hot"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


UNIT_SCHEMA = "route long, hash long, doc_id long, tkey long, lo long, hi long, bytes binary"


def listed(lists: pa.Array, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is in the list of its row."""
    ends = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[ends[0] : ends[-1]]
    owner = np.repeat(np.arange(len(lists), dtype=np.uint64), np.diff(ends))
    salt = np.uint64(0xD6E8FEB86659FD93)
    return np.isin(mixed(h ^ (row.astype(np.uint64) * salt)), mixed(flat ^ (owner * salt)))


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tkey, text, hashes, hots -> units with shared anchors, those of hots as single windows. Of equal units the earliest travels with its bytes; the
    others are settled here and travel without (null bytes: remove windows lo..hi)."""
    powers = Powers()
    for batch, data, offsets, rows_of, shift, _ in pieces(batches):
        row, h, lo, hi, sums = units(data, offsets, powers)
        hit = listed(batch.column("hashes"), rows_of[row], h)
        row, h, lo, hi = row[hit], h[hit], lo[hit], hi[hit]
        if not len(row):
            continue
        hot = listed(batch.column("hots"), rows_of[row], h)
        if hot.any():
            spread = np.where(hot, hi - lo + 1, 1)
            step = np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)
            row, h, hot, lo, hi = (np.repeat(x, spread) for x in (row, h, hot, lo, hi))
            lo = lo + step
            hi = np.where(hot, lo, hi)
            _, down = powers.get(len(data) + 1)
            h = np.where(hot, mixed(mixed((sums[lo + LENGTH] - sums[lo]) * down[lo]) + BASE), h)
        _, down = powers.get(len(data) + 1)
        identity = mixed((sums[hi + LENGTH] - sums[lo]) * down[lo]) ^ mixed(h + (hi - lo).astype(np.uint64))
        doc = batch.column("doc_id").to_numpy()[rows_of[row]]
        local = lo - offsets[row] + shift[row]
        tkey = batch.column("tkey").to_numpy()[rows_of[row]]
        order = np.lexsort((local, doc, identity))
        later = np.zeros(len(order), bool)
        later[order[1:]] = identity[order[1:]] == identity[order[:-1]]
        whole = data.tobytes()
        content = [None if x else whole[a:b] for a, b, x in zip(lo.tolist(), (hi + LENGTH).tolist(), later.tolist())]
        joins = np.zeros(len(row), bool)  # settled units that follow each other in a text travel as one row
        joins[1:] = later[1:] & later[:-1] & (row[1:] == row[:-1]) & (lo[1:] == hi[:-1] + 1)
        head = np.flatnonzero(~joins)
        tail = np.append(head[1:], len(row)) - 1
        route = np.where(later, mixed(h ^ mixed(doc.view(np.uint64) + local.astype(np.uint64))), h).view(np.int64)
        arrays = [route[head], h.view(np.int64)[head], doc[head], tkey[head], local[head], (local + hi - lo)[tail]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array([content[i] for i in head.tolist()], pa.binary())], names=[c.split()[0] for c in UNIT_SCHEMA.split(", ")])


SYMBOLS = 7


class Shard:
    """Suffix array of strings, each ended by a terminator of its own that sorts before all bytes, in string order."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings])
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(strings)), sizes)
        self.end = (self.starts + sizes)[self.owner]
        self.key = self.packed()
        self.order = self.sort()

    def packed(self) -> np.ndarray:
        """SYMBOLS bytes from each position on, 9 bits each, 0 from the terminator on."""
        n, key = len(self.text), np.zeros(len(self.text), np.int64)
        at, wide = np.arange(n), np.append(self.text.astype(np.int64) + 1, np.zeros(SYMBOLS, np.int64))
        for k in range(SYMBOLS):
            key = key << 9 | np.where(at + k < self.end, wide[k : k + n], 0)
        return key

    def sort(self) -> np.ndarray:
        """Larsson-Sadakane: sort by SYMBOLS bytes, then double the depth, sorting again only groups not yet single."""
        n = len(self.text)
        order = np.argsort(self.key, kind="stable")
        sorted_key = self.key[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        new |= (sorted_key & 0x1FF) == 0  # a terminator inside: the stable order is final
        rank = np.empty(n, np.int64)
        slot = np.arange(n)
        head = np.maximum.accumulate(np.where(new, slot, 0))
        rank[order] = head
        depth = SYMBOLS
        open_slots = np.flatnonzero(~new | np.append(~new[1:], False))
        while len(open_slots):
            place = order[open_slots]
            beyond = place + depth
            over = beyond >= self.end[place]  # exactly at the terminator, which is below all bytes
            follow = np.where(over, self.owner[place] - len(self.starts), rank[np.minimum(beyond, n - 1)])
            again = np.lexsort((follow, head[open_slots]))
            place, follow, group = place[again], follow[again], head[open_slots][again]
            order[open_slots] = place
            new = np.ones(len(place), bool)
            new[1:] = (follow[1:] != follow[:-1]) | (group[1:] != group[:-1])
            top = open_slots[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
            head[open_slots] = top
            rank[place] = top
            still = ~new | np.append(~new[1:], False)
            open_slots = open_slots[still]
            depth *= 2
        return order

    def common(self) -> np.ndarray:
        """Common prefix of each sorted suffix with the one before it.

        Kasai's rule, PLCP[i] >= PLCP[i - 1] - 1, holds with equality wherever the bytes before both suffixes agree;
        only the other positions are compared byte by byte, the rest follows from a running maximum."""
        n = len(self.text)
        before = np.full(n, -1)
        before[self.order[1:]] = self.order[:-1]
        at = np.arange(n)
        inner = (at > self.starts[self.owner]) & (before >= 0)
        inner &= before > self.starts[self.owner[np.maximum(before, 0)]]
        inner[inner] &= self.text[at[inner] - 1] == self.text[before[inner] - 1]
        lane = np.flatnonzero(~inner & (before >= 0))
        found = np.zeros(n, np.int64)
        x, y, out = lane.copy(), before[lane], lane
        while len(out):
            a, b = self.key[x], self.key[y]
            differ = a ^ b
            bits = np.frexp(differ.astype(np.float64))[1]
            bits = np.where((differ >> np.maximum(bits - 1, 0)) == 0, bits - 1, bits)  # rounding up to the next power
            same = np.where(differ == 0, SYMBOLS, (9 * SYMBOLS - bits) // 9)
            same = np.minimum(same, np.minimum(self.end[x] - x, self.end[y] - y))
            found[out] += same
            go = (differ == 0) & (x + SYMBOLS < self.end[x]) & (y + SYMBOLS < self.end[y])
            x, y, out = x[go] + SYMBOLS, y[go] + SYMBOLS, out[go]
        run = np.where(~inner, found + at, 0)
        plcp = np.maximum.accumulate(run) - at
        return plcp[self.order]

    def words(self, at: np.ndarray) -> np.ndarray:
        """(len(at), LENGTH) bytes from the given positions."""
        return self.text[at[:, None] + np.arange(LENGTH)]


def search(shard: Shard, slots: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Whether each probe (rows of LENGTH bytes) begins one of the sorted suffixes in slots: one bisection for all."""
    low, high = np.zeros(len(probes), np.int64), np.full(len(probes), len(slots))
    hit = np.zeros(len(probes), bool)
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        found = shard.words(shard.order[slots[mid]])
        differ = found != probes[live]
        col = differ.argmax(axis=1)
        lane = np.arange(len(live))
        equal = ~differ[lane, col]
        less = ~equal & (found[lane, col] < probes[live][lane, col])
        hit[live] |= equal
        low[live] = np.where(less, mid + 1, low[live])
        high[live] = np.where(less, high[live], mid)
        live = live[~equal & (low[live] < high[live])]
    return hit


class Marker:
    """Collects the units of one shard at a time, in the order hash, document, position, and says what to remove."""

    def __init__(self):
        self.rows, self.size, self.earlier = [], 0, []

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[4])

    def close(self, more: bool) -> list[tuple[int, int, int, int]]:
        """(doc_id, tkey, start, end) of windows' bytes to remove. more: the next rows continue the last anchor."""
        out, classes, kinds = [], {}, Counter()
        for h, doc, tkey, lo, content in self.rows:
            if content in classes:
                out.append((doc, tkey, lo, lo + len(content)))
            else:
                classes[content] = (h, doc, tkey, lo)
                kinds[h] += 1
        # A unit that is alone with its anchor has no equal windows: they would have anchors of their own. An anchor
        # that goes on before or after this shard may still meet others.
        goes_on = {self.rows[-1][0]} if more else set()
        goes_on |= {self.rows[0][0]} if self.earlier else set()
        classes = {content: x for content, x in classes.items() if kinds[x[0]] > 1 or x[0] in goes_on}
        continued = self.rows[-1][0] if more else None
        self.rows, self.size = [], 0
        if not classes:
            self.earlier = [] if not more else self.earlier
            return out
        strings, facts = list(classes), [x[1:] for x in classes.values()]
        anchors = [x[0] for x in classes.values()]
        shard = Shard(strings)
        doc, start = np.array([f[0] for f in facts]), np.array([f[2] for f in facts])
        long = shard.end[shard.order] - shard.order >= LENGTH
        run = np.cumsum(shard.common() < LENGTH)
        slots = np.flatnonzero(long)
        at = shard.order[slots]
        own = shard.owner[at]
        where = start[own] + at - shard.starts[own]
        order = np.lexsort((where, doc[own], run[slots]))
        first = np.ones(len(order), bool)
        first[1:] = run[slots][order][1:] != run[slots][order][:-1]
        gone = np.zeros(len(shard.text), bool)
        gone[at[order[~first]]] = True
        for other, others in self.earlier:
            left = np.flatnonzero(~gone & (shard.end - np.arange(len(gone)) >= LENGTH))
            for k in range(0, len(left), 1 << 15):
                part = left[k : k + (1 << 15)]
                gone[part[search(other, others, shard.words(part))]] = True
        edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for b, e in zip(begins.tolist(), ends.tolist()):  # windows of one string end LENGTH - 1 before it does
            d, t, lo = facts[shard.owner[b]]
            shift = lo - int(shard.starts[shard.owner[b]])
            out.append((d, t, b + shift, e - 1 + shift + LENGTH))
        if more:
            inside = np.array([h == continued for h in anchors])
            keep = slots[inside[own] & ~gone[at]]
            self.earlier.append((shard, keep))
        else:
            self.earlier = []
        return out


def removed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted unit rows -> doc_id, tkey, start, end of removed bytes."""
    marker, last = Marker(), None

    def table(found):
        columns = list(zip(*found)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "tkey", "start", "end"])

    for batch in batches:
        settled = batch.filter(batch.column("bytes").is_null())
        if settled.num_rows:
            yield pa.RecordBatch.from_arrays([settled.column("doc_id"), settled.column("tkey"), settled.column("lo"), pc.add(settled.column("hi"), LENGTH)], names=["doc_id", "tkey", "start", "end"])
        open_rows = batch.filter(batch.column("bytes").is_valid())
        for row in zip(*(open_rows.column(c).to_pylist() for c in ("hash", "doc_id", "tkey", "lo", "bytes"))):
            if marker.size >= SHARD_BYTES:
                yield table(marker.close(more=row[0] == last))
            elif marker.earlier and row[0] != last:
                yield table(marker.close(more=False))
            marker.add(row)
            last = row[0]
    yield table(marker.close(more=False))


def kept_rows(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...] = (), with_text: bool = False) -> Iterator[pa.RecordBatch]:
    """doc_id, carried columns, text, spans(start, end), copy -> the result, with the text of the kept bytes on demand.
    Bytes of a character that is cut into are left out of that text."""
    for batch in slices(batches, "text", SLICE):
        data, offsets = byte_view(batch.column("text"))
        out = []
        for i, (spans, copy) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("copy").to_pylist())):
            own = data[offsets[i] : offsets[i + 1]]
            n = len(own)
            if copy and n >= LENGTH:
                out.append((n, n, 1, b""))
                continue
            if not spans:
                out.append((n, 0, 0, own.tobytes()))
                continue
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, [s["start"] for s in spans], 1)
            np.add.at(edge, [s["end"] for s in spans], -1)
            gone = np.cumsum(edge)[:n] > 0
            starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((n, int(gone.sum()), starts, own[~gone].tobytes()))
        n, removed, spans, kept = zip(*out)
        digest = [hashlib.sha256(k).hexdigest() for k in kept]
        arrays = [batch.column(c) for c in ("doc_id", *carry)] + [pa.array(x, pa.int64()) for x in (n, removed, spans)] + [pa.array(digest, pa.string())]
        names = ["doc_id", *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays, names = arrays + [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())], names + ["kept_text"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, spans, copy for docs(doc_id, text) of which something is removed."""
    keyed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    anchors = keyed.select("text", "tkey").mapInArrow(anchor_rows, "route long, hash long, tkey long, texts long")
    shared = materialize(anchors.repartition("route").sortWithinPartitions("hash").mapInArrow(shared_rows, "tkey long, hash long, hot boolean"), "shared")
    wanted = shared.groupBy("tkey").agg(F.collect_list("hash").alias("hashes"))
    hot = materialize(shared.filter("hot").select("hash").distinct(), "hot")
    few = hot.limit(BROADCAST_ROWS + 1).count()
    if few:
        hots = shared.join(F.broadcast(hot) if few <= BROADCAST_ROWS else hot, "hash", "left_semi").groupBy("tkey").agg(F.collect_list("hash").alias("hots"))
        wanted = wanted.join(hots, "tkey", "left")
    else:
        wanted = wanted.withColumn("hots", F.lit(None).cast("array<long>"))
    wanted = materialize(wanted.withColumn("hots", F.coalesce("hots", F.expr("cast(array() as array<long>)"))), "anchors")

    names = materialize(keyed.select("doc_id", "tkey", F.xxhash64("text", F.lit(1)).alias("tkey2")), "names")
    classes = names.groupBy("tkey", "tkey2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"))
    copied = materialize(classes.filter("rep <> top").drop("top"), "copied")  # read anew, the join's skewed side can be split
    copies = names.join(copied, ["tkey", "tkey2"]).filter("doc_id <> rep").select("doc_id", "tkey").distinct()
    reps = materialize(wanted.join(classes.select("tkey", F.col("rep").alias("doc_id")).distinct(), "tkey"), "wanted")

    # Rows that repeat identifier and text send their units once, or each would remove the other's.
    again = materialize(names.groupBy("doc_id", "tkey").count().filter("count > 1").select("doc_id", "tkey"), "again")
    if again.isEmpty():
        sent = keyed.join(reps, ["doc_id", "tkey"])
    else:
        once = keyed.join(again, ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"])
        sent = keyed.join(reps.join(again, ["doc_id", "tkey"], "left_anti"), ["doc_id", "tkey"]).unionByName(once.join(reps, ["doc_id", "tkey"]))
    found = sent.select("doc_id", "tkey", "text", "hashes", "hots").mapInArrow(unit_rows, UNIT_SCHEMA)
    dealt = found.repartition("route").sortWithinPartitions("hash", "doc_id", "lo")
    spans = dealt.mapInArrow(removed_rows, "doc_id long, tkey long, start long, end long")
    spans = materialize(spans.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    both = spans.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    return materialize(both, "removed")


def drop_repeats(docs: DataFrame, carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """doc_id, carried columns, n_bytes, n_removed, n_spans, kept_sha256 and kept_text for docs(doc_id, text, ...)."""
    docs = clash_free(docs, "doc_id", "text", *carry).withColumn("doc_id", F.col("doc_id").cast("long"))
    gone = repeated_spans(docs.select("doc_id", "text"))
    keyed = docs.withColumn("_tkey", F.xxhash64("text"))
    joined = keyed.join(gone.withColumnRenamed("tkey", "_tkey"), ["doc_id", "_tkey"], "left").select("doc_id", *carry, "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    told = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    schema = T.StructType([docs.schema[c] for c in ("doc_id", *carry)] + told.fields)
    return joined.mapInArrow(lambda batches: kept_rows(batches, carry, with_text), schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What removal of repeated 100-byte strings leaves of every document."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
