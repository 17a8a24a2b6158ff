"""Suffix-array dedup: remove bytes that lie in a long string which an earlier document also holds.

1. Of equal texts (by SHA-256) the one of the smallest document goes on; the others lose all their bytes.
2. Every 50-byte window has an anchor, its leftmost 24-byte string of the smallest hash.  Equal windows have equal anchors, so a
   window can only repeat if its anchor stands in two texts; anchors that do not are dropped (this drops most of the text).
3. The windows of each anchor left are cut out as one short snippet, equal snippets become one with their smallest
   document, and snippets go to partitions by anchor: equal windows meet there.  Anchors that stand in very many places are
   split: each of their windows is a snippet by itself and goes by its own hash, so no anchor fills a task.
4. A partition takes its anchors a few at a time.  Windows whose hash no other snippet of the anchor holds are left out; the
   stretches that remain are split into shards, and each shard's suffixes are sorted into its Burrows-Wheeler
   transform.  The shards' transforms are merged by refining an interleave: it starts as one shard after the other, and each
   pass sorts it stably by the two bytes before each suffix, after which it is right for two more bytes.  Marks at
   places where neighbours differ give the common prefixes; after 25 passes the intervals between marks are
   the strings of 50 bytes, and each gets the smallest document in it.  No suffixes are sorted again.
5. Snippets hand these documents back to where they stand; windows that a smaller document holds are joined into spans.

What passes between tasks is packed, a row for each task and range of hashes or block of texts, so rows do not grow with texts times ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, documents, materialize, own_name, tidy

#: Bytes of a repeated string and of an anchor; anchors of a window.
LENGTH, ANCHOR = 50, 24
SPAN = LENGTH - ANCHOR + 1
#: Bytes that are scanned at once (longer texts are cut, with overlaps), bytes of a shard, and bytes of snippets that a task holds at once.
PIECE, SHARD, HELD = 1 << 18, 1 << 19, 1 << 23
#: Places of an anchor beyond which its windows go each by itself.
HOT = 4096
#: Ranges of hashes for each partition, anchors that a task packs before it hands them on, and bits of a text's number within its block.
RANGES, PACKED, BLOCK_BITS = 4, 1 << 21, 12
#: The id of rows without one: no document is larger, so such rows are never the first to hold a string.
NO_ID = (1 << 63) - 1
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def string_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes, at least 1: hashes of powers of two of bytes, put one after the other."""
    step, have, power = buf.astype(np.uint64), 1, _BASE
    h, got = None, 0
    while True:
        if width & have:
            h = step if h is None else h[: len(step) - got] * np.uint64(power) + step[got:]
            got += have
        if 2 * have > width:
            break
        step = step[:-have] * np.uint64(power) + step[have:]
        power = power * power % (1 << 64)
        have *= 2
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1), out=h)


class Buffer:
    """Texts, or pieces of them, one after the other; windows that reach across an end do not count."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        self.doc = np.array([p[0] for p in parts])
        self.start = np.array([p[1] for p in parts])
        size = np.array([len(p[2]) for p in parts])
        self.base = np.cumsum(size) - size
        self.raw = b"".join(p[2] for p in parts)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.hash = string_hashes(self.bytes, ANCHOR)
        self.inside = np.ones(len(self.raw), bool)
        for k in range(1, LENGTH):
            self.inside[self.base + size - k] = False
        self.inside = self.inside[: len(self.raw) - LENGTH + 1]
        self.least = _slide(self.hash, SPAN, np.minimum)

    def part_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, "right") - 1

    def anchors(self) -> np.ndarray:
        """Places that are the smallest of some window (equal ones too)."""
        least = np.where(self.inside, self.least, np.uint64(0))
        edge = np.zeros(SPAN - 1, np.uint64)
        return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), SPAN, np.maximum) == self.hash)

    def anchor_of_window(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows, and the leftmost anchor of each."""
        windows = np.flatnonzero(self.inside)
        k = np.searchsorted(anchors, windows)
        want, wrong = self.least[windows], np.arange(len(windows))
        while len(wrong):
            wrong = wrong[self.hash[anchors[k[wrong]]] != want[wrong]]
            k[wrong] += 1
        return windows, anchors[k]


def buffers(parts: Iterator[tuple[int, int, bytes]]) -> Iterator[Buffer]:
    """From (number, place of the first byte, bytes): buffers of about ``PIECE`` bytes; long ones are cut with overlaps, short ones hold no window."""
    held, size = [], 0
    for i, start, raw in parts:
        for at in range(0, len(raw) - LENGTH + 1, PIECE):
            held.append((i, start + at, raw[at : at + PIECE + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield Buffer(held)
                held, size = [], 0
    if held:
        yield Buffer(held)


def _binary(items: list) -> pa.Array:
    return pa.array(items, pa.binary())


def _packed(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols), names.split())


def _in_turn(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[list]]]:
    """From batches sorted by ``key``: each value, and its rows of the other columns as lists; one value is held at a time."""
    last, rows = None, []
    for batch in batches:
        names = [c for c in batch.schema.names if c != key]
        for k, *cols in zip(*(batch[c].to_pylist() for c in (key, *names))):
            if k != last and rows:
                yield last, rows
                rows = []
            last = k
            rows.append(cols)
    if rows:
        yield last, rows


def shared_anchors(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """From ``tid, raw``: ``tid, places`` where each text has anchors that stand in two texts at least (packed 32-bit places; the top bit is set for anchors with more than ``hot`` places)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES * n

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def pack() -> pa.RecordBatch:
            h, tid, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            to = ((h >> np.uint64(48)) % np.uint64(ranges)).astype(np.uint16 if ranges < 1 << 16 else np.uint32)
            order = np.argsort(to, kind="stable")
            base = int(tid.min())
            parts = [(h & np.uint64(0xFFFFFFFF)).astype("<u4"), (h >> np.uint64(32)).astype("<u2"), (tid - base).astype("<u4"), place.astype("<u4")]
            parts = [x[order] for x in parts]
            cuts = np.searchsorted(to[order], np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cuts))
            cols = [_binary([x[cuts[k] : cuts[k + 1]].tobytes() for k in some]) for x in parts]
            return _packed("range base low high tid place", pa.array(some, pa.int32()), pa.array(np.full(len(some), base), pa.int64()), *cols)

        count = 0
        for batch in batches:
            tids = batch["tid"].to_numpy()
            for buf in buffers((i, 0, raw.as_buffer().to_pybytes()) for i, raw in enumerate(batch["raw"])):
                at = buf.anchors()
                part = buf.part_of(at)
                tid, place = tids[buf.doc[part]], at - buf.base[part] + buf.start[part]
                # numbers of texts from two files lie far apart
                for some in np.split(np.arange(len(at)), np.flatnonzero(np.abs(np.diff(tid)) >= 1 << 30) + 1):
                    if held and len(some) and (count > PACKED or abs(int(tid[some[0]] - held[0][1][0])) >= 1 << 30):
                        yield pack()
                        count = 0
                    if len(some):
                        held.append((buf.hash[at[some]], tid[some], place[some]))
                        count += len(some)
        if held:
            yield pack()

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _in_turn(batches, "range"):
            base, low, high, tid, place = zip(*rows)
            tid = np.concatenate([np.frombuffer(t, "<u4").astype(np.int64) + b for b, t in zip(base, tid)])
            low, high, place = (np.frombuffer(b"".join(x), kind) for x, kind in ((low, "<u4"), (high, "<u2"), (place, "<u4")))
            h = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
            order = np.argsort(h)
            h, tid, place = h[order], tid[order], place[order]
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[cuts, len(h)])
            some = np.minimum.reduceat(tid, cuts) != np.maximum.reduceat(tid, cuts)
            keep = np.repeat(some, count)
            place = place | np.repeat(np.where(count > hot, np.uint32(1 << 31), np.uint32(0)), count)
            tid, place = tid[keep], place[keep]
            if len(tid):
                block = tid >> BLOCK_BITS
                order = np.argsort(block, kind="stable")
                block, low, place = block[order], (tid[order] & ((1 << BLOCK_BITS) - 1)).astype("<u2"), place[order]
                cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                ends = np.r_[cuts[1:], len(block)]
                yield _packed("block low place", pa.array(block[cuts]), *(_binary([x[a:b].tobytes() for a, b in zip(cuts, ends)]) for x in (low, place)))

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _in_turn(batches, "block"):
            low, place = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows), ("<u2", "<u4")))
            order = np.lexsort((place & np.uint32((1 << 31) - 1), low))
            low, place = low[order], place[order]
            cuts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            ends = np.r_[cuts[1:], len(low)]
            yield _packed("tid places", pa.array((block << BLOCK_BITS) + low[cuts].astype(np.int64)), _binary([place[a:b].tobytes() for a, b in zip(cuts, ends)]))

    sent = texts.select("tid", "raw").mapInArrow(send, "range int, base long, low binary, high binary, tid binary, place binary")
    met = sent.repartition(n, "range").sortWithinPartitions("range").mapInArrow(meet, "block long, low binary, place binary")
    return met.repartition(n, "block").sortWithinPartitions("block").mapInArrow(gather, "tid long, places binary")


def snippets(found: DataFrame) -> DataFrame:
    """From ``tid, doc, raw, places`` the snippets ``tid, doc, start, anchor, snippet``."""

    def around(raw: bytes, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The stretches of a text that hold all windows of its shared anchors."""
        a, b = np.maximum(places - (SPAN - 1), 0), np.minimum(places + LENGTH, len(raw))
        b = np.maximum.accumulate(b)
        cut = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
        for x, y in zip(a[cut].tolist(), b[np.r_[cut[1:], len(a)] - 1].tolist()):
            yield x, raw[x:y]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, doc = batch["tid"].to_numpy(), batch["doc"].to_numpy()
            marked = [np.frombuffer(x, "<u4") for x in batch["places"].to_pylist()]
            places = [(x & np.uint32((1 << 31) - 1)).astype(np.int64) for x in marked]
            parts = ((i, x, part) for i, raw in enumerate(batch["raw"]) for x, part in around(raw.as_buffer().to_pybytes(), places[i]))
            for buf in buffers(parts):
                shared, hot = np.zeros(len(buf.raw), bool), np.zeros(len(buf.raw), bool)
                for d, start, base, end in zip(buf.doc.tolist(), buf.start.tolist(), buf.base.tolist(), np.r_[buf.base[1:], len(buf.raw)].tolist()):
                    lo, hi = np.searchsorted(places[d], (start, start + end - base))
                    at = places[d][lo:hi] - start + base
                    shared[at] = True
                    hot[at] = marked[d][lo:hi] >> np.uint32(31)
                windows, anchor = buf.anchor_of_window(buf.anchors())
                some = shared[anchor]
                windows, anchor = windows[some], anchor[some]
                if not len(windows):
                    continue
                alone = hot[anchor]
                cut = np.r_[True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)] | alone
                first = np.flatnonzero(cut)
                a, b = windows[first], windows[np.r_[first[1:], len(windows)] - 1] + LENGTH
                key = buf.hash[anchor[first]]
                if alone.any():
                    key = np.where(alone[first], string_hashes(buf.bytes, LENGTH)[a], key)
                raw = buf.raw
                cutout = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
                part = buf.part_of(a)
                who = buf.doc[part]
                cols = [tid[who], doc[who], a - buf.base[part] + buf.start[part], key.view(np.int64)]
                for k in range(0, len(cutout), 20_000):
                    yield _packed("tid doc start anchor snippet", *(pa.array(c[k : k + 20_000]) for c in cols), _binary(cutout[k : k + 20_000]))

    return found.select("tid", "doc", "raw", "places").mapInArrow(run, "tid long, doc long, start long, anchor long, snippet binary")


def sort_rotations(text: np.ndarray) -> np.ndarray:
    """Order of a shard's rotations by their first 64 bytes, by prefix doubling."""
    n = len(text)
    wide = np.concatenate([text, np.resize(text, 8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | wide[k : n + k]
    have = 8
    while True:
        order = np.argsort(key)
        if have >= 64:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]]).astype(np.uint64)
        key = rank << np.uint64(32) | np.roll(rank, -have)
        have *= 2


def merge_shards(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the shards joined) of all suffixes in merged order, and for each the number of its interval of a common prefix of ``LENGTH`` bytes."""
    orders = [sort_rotations(x) for x in shards]
    # the two bytes before each suffix of a shard, in the shard's order: its transform, two steps at once
    before = np.concatenate([np.roll(x, 2)[o].astype(np.uint16) << np.uint16(8) | np.roll(x, 1)[o] for x, o in zip(shards, orders)])
    sizes = [len(x) for x in shards]
    kind = np.uint8 if len(shards) <= 256 else np.uint16
    which = np.repeat(np.arange(len(shards), dtype=kind), sizes)
    interval = np.zeros(len(which), np.int32)
    chars = np.empty(len(which), np.uint16)
    for _ in range(LENGTH // 2):
        chars[np.argsort(which, kind="stable")] = before
        step = np.argsort(chars, kind="stable")
        which, interval, sorted_chars = which[step], interval[step], chars[step]
        mark = (sorted_chars[1:] != sorted_chars[:-1]) | (interval[1:] != interval[:-1])
        interval = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)]).astype(np.int32)
    place = np.empty(len(which), np.int64)
    place[np.argsort(which, kind="stable")] = np.concatenate([o + a for o, a in zip(orders, np.cumsum([0, *sizes[:-1]]))])
    return place, interval


def first_documents(snips: list[bytes], docs: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all snippets, one after the other: the smallest document with an equal window.  Also the number of windows of each snippet.

    Snippets are parted by a byte that no UTF-8 text holds, so windows across an end equal no others that count.
    """
    size = np.fromiter(map(len, snips), np.int64, len(snips))
    count = size - LENGTH + 1
    joined = np.frombuffer(b"\xff".join(snips) + b"\xff", np.uint8)
    base = np.cumsum(size + 1) - size - 1
    # shards end where a snippet ends
    of = (base // shard).astype(np.int64)
    cuts = base[np.flatnonzero(np.r_[True, of[1:] != of[:-1]])]
    place, interval = merge_shards(np.split(joined, cuts[1:]))
    owner = np.repeat(np.arange(len(snips)), size + 1)
    inside = np.arange(len(joined)) - np.repeat(base, size + 1) < np.repeat(count, size + 1)
    value = np.where(inside, docs[owner], NO_ID)[place]
    heads = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    first = np.empty(len(joined), np.int64)
    first[place] = np.repeat(np.minimum.reduceat(value, heads), np.diff(np.r_[heads, len(value)]))
    return first[inside], count


def _runs(anchor: np.ndarray, snips: list[bytes], sh: np.ndarray, least: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
    """The runs of windows that a smaller document holds than some document of their snippet; anchors are whole and sorted."""
    differs = anchor[1:] != anchor[:-1]
    lone = np.r_[True, differs] & np.r_[differs, True]
    size = np.fromiter(map(len, snips), np.int64, len(snips))
    # the only snippet of its anchor has no windows in common with others
    whole = np.flatnonzero(lone & (most > least))
    out = [(whole, np.zeros(len(whole), np.int64), size[whole] - LENGTH + 1, least[whole])]
    many = np.flatnonzero(~lone)
    if len(many):
        size, least, most = size[many], least[many], most[many]
        joined = b"".join([snips[i] for i in many.tolist()])
        base, count = np.cumsum(size) - size, size - LENGTH + 1
        owner = np.repeat(np.arange(len(many)), count)
        begin = np.cumsum(count) - count
        at = np.arange(len(owner)) - begin[owner] + base[owner]
        # a window that repeats has a hash that repeats within its anchor
        group = np.cumsum(np.r_[0, anchor[many][1:] != anchor[many][:-1]]).astype(np.uint64)[owner]
        h = string_hashes(np.frombuffer(joined, np.uint8), LENGTH)[at] ^ group * _MIX
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order] = np.r_[False, same] | np.r_[same, False]
        first = least[owner]
        kept = np.flatnonzero(twice)
        if len(kept):
            new = np.r_[True, (kept[1:] != kept[:-1] + 1) | (owner[kept[1:]] != owner[kept[:-1]])]
            a = kept[new]
            b = kept[np.r_[np.flatnonzero(new)[1:], len(kept)] - 1]
            parts = [joined[x:y] for x, y in zip(at[a].tolist(), (at[b] + LENGTH).tolist())]
            first[kept] = first_documents(parts, least[owner[a]])[0]
        cuts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])])
        who = owner[cuts]
        lo, hi = cuts - begin[who], np.r_[cuts[1:], len(owner)] - begin[who]
        useful = first[cuts] < most[who]
        out.append((many[who[useful]], lo[useful], hi[useful], first[cuts][useful]))
    row, lo, hi, first = (np.concatenate(x) for x in zip(*out))
    return _packed("anchor sh lo hi first", *(pa.array(x.astype(np.int64)) for x in (anchor[row], sh[row], lo, hi, first)))


def repeated_windows(unique: DataFrame) -> DataFrame:
    """From distinct snippets (``anchor, snippet, sh, least, most``) the runs of windows with their first document: ``anchor, sh, lo, hi, first``.

    A task holds about ``HELD`` bytes of snippets at a time, whole anchors each.
    """
    n = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            return _runs(t["anchor"].to_numpy(), t["snippet"].to_pylist(), t["sh"].to_numpy(), t["least"].to_numpy(), t["most"].to_numpy())

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD:
                t = pa.Table.from_batches(held)
                anchor = t["anchor"].to_numpy()
                end = int(np.searchsorted(anchor, anchor[-1]))
                if end:
                    yield done(t.slice(0, end))
                    held = t.slice(end).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if size:
            yield done(pa.Table.from_batches(held))

    sorted_rows = unique.repartition(n, "anchor").sortWithinPartitions("anchor")
    return sorted_rows.select("anchor", "snippet", "sh", "least", "most").mapInArrow(run, "anchor long, sh long, lo long, hi long, first long")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _raw() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def _sha(raw: Column) -> Column:
    return F.unhex(F.sha2(raw, 256))


def _first_texts(keys: DataFrame) -> DataFrame:
    """From ``doc, sha, n_bytes``: ``sha, least, n`` of texts that can hold a window: the smallest document of each text, and how many rows of that document hold it."""
    own = keys.where(F.col("n_bytes") >= LENGTH).groupBy("sha", "doc").agg(F.count("*").alias("n"))
    return own.groupBy("sha").agg(F.min(F.struct("doc", "n")).alias("v")).select("sha", F.col("v.doc").alias("least"), F.col("v.n").alias("n"))


def _distinct_texts(docs: DataFrame, first: DataFrame) -> DataFrame:
    """``tid, doc, sha, raw``: each text once, under the document of ``first``."""
    rows = docs.select(_doc().alias("doc"), _sha(_raw()).alias("sha"), _raw().alias("raw")).where(F.octet_length("raw") >= LENGTH)
    # dealt by text and document, so copies under other ids do not gather
    found = rows.join(first.withColumnRenamed("least", "doc"), ["sha", "doc"])
    if not first.where("n > 1").isEmpty():
        found = found.where("n = 1").unionByName(found.where("n > 1").dropDuplicates(["sha", "doc"]))
    return materialize(found.select(F.monotonically_increasing_id().alias("tid"), "doc", "sha", "raw"), "suffix-texts")


def _cut(raw: bytes, spans: list) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    gone = np.zeros(len(raw) + 1, np.int32)
    a, b = (np.array(x, np.int64) for x in zip(*((s["a"], s["b"]) for s in spans)))
    np.add.at(gone, a, 1)
    np.add.at(gone, b, -1)
    out = np.cumsum(gone[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~out].tobytes(), int(out.sum()), int((out & ~np.r_[False, out[:-1]]).sum())


def removals(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """From ``tid, doc, sha, raw`` of distinct texts: ``sha, kept`` (bytes)``, n_removed, n_spans`` of those that lose bytes."""
    shared = materialize(shared_anchors(texts, hot), "suffix-anchors")
    cut = materialize(snippets(texts.join(shared, "tid")), "suffix-snippets")
    discard(shared)
    keyed = cut.withColumn("sh", F.xxhash64("snippet"))
    unique = keyed.groupBy("anchor", "snippet", "sh").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    runs = materialize(repeated_windows(unique), "suffix-runs")
    hits = keyed.drop("snippet").join(runs, ["anchor", "sh"]).where(F.col("doc") > F.col("first"))
    span = F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") + LENGTH - 1).alias("b"))
    spans = hits.groupBy("tid").agg(F.collect_list(span).alias("spans"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_cut(raw, s) for raw, s in zip(batch["raw"].to_pylist(), batch["spans"].to_pylist())]
            if kept:
                k, n, m = zip(*kept)
                yield _packed("sha kept n_removed n_spans", batch["sha"], _binary(k), pa.array(n, pa.int64()), pa.array(m, pa.int64()))

    return texts.select("tid", "sha", "raw").join(spans, "tid").select("sha", "raw", "spans").mapInArrow(run, "sha binary, kept binary, n_removed long, n_spans long")


def removal_report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null counts as empty.  Rows that repeat an id are one document as far as matches go: neither is smaller.  A
    null id is larger than any other.  An empty table gives an empty result.
    """
    keys = materialize(docs.select("doc_id", _doc().alias("doc"), _sha(_raw()).alias("sha"), F.octet_length(_raw()).cast("long").alias("n_bytes")), "suffix-keys")
    first = materialize(_first_texts(keys), "suffix-first")
    gone = removals(_distinct_texts(docs, first), hot).select("sha", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"))
    gone = materialize(first.join(gone, "sha", "left").drop("n"), "suffix-removals")
    out = keys.join(gone, "sha", "left")
    zero, copy = F.lit(0).cast("long"), F.col("doc") > F.col("least")
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"), F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (and ``n_chars``, if it is there, counted again for those texts).

    Where a cut splits a character, what is left of it goes too.  A text that loses all its bytes stays as an empty one.
    """

    def plain(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    doc, sha, kept = own_name(docs, "key_doc"), own_name(docs, "key_sha"), own_name(docs, "kept_text")
    keys = materialize(docs.select(_doc().alias("doc"), _sha(_raw()).alias("sha"), F.octet_length(_raw()).cast("long").alias("n_bytes")), "suffix-keys")
    first = materialize(_first_texts(keys), "suffix-first")
    copies = keys.join(first, "sha").where("doc > least").select("sha", "doc", F.lit("").alias(kept)).distinct()
    gone = removals(_distinct_texts(docs, first), hot).select("sha", F.pandas_udf(plain, "string")("kept").alias(kept)).join(first, "sha").select("sha", F.col("least").alias("doc"), kept)
    gone = materialize(gone.unionByName(copies).select(F.col("doc").alias(doc), F.col("sha").alias(sha), kept), "suffix-kept")
    keyed = docs.withColumns({doc: _doc(), sha: _sha(_raw())})
    changes: dict[str, Column] = {"text": F.coalesce(F.col(kept), F.col("text"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.coalesce(F.length(kept).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return keyed.join(gone, [doc, sha], "left").withColumns(changes).select(*docs.columns)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))
