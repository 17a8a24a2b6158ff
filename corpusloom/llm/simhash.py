"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join.

Two fingerprints that differ in at most ``budget`` bits agree in full in one of ``budget + 1`` blocks of bits.  So every
fingerprint is dealt out once for each block, with that block turned to the front, and fingerprints that share
it meet in one partition.  There the sorted fingerprints are a binary trie; node pairs are traversed together
from the root down, differing bits are added up along the way, and a pair is dropped as soon as it exceeds the
budget.  A partition returns a spanning forest of its links (as many rows as fingerprints at most); components of all links are
found by repeated star contraction over DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, documents, materialize, own_name, tidy

#: Words in a shingle, differing bits that still link, and fingerprints of one block value that may meet in one task.
SHINGLE, BUDGET, HEAVY = 4, 4, 200_000
SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hash of every run of ``shingle`` words (a shorter text: of all its words; none: nothing), A-Z in lower case."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))


def majority(h: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of the hashes in each row of ``h``, as one number a row.

    Every eighth bit is counted in the byte lanes of a word, 255 hashes at a time, so that no lane overflows.
    """
    rows, n = h.shape
    chunks = -(-n // 255)
    padded = np.zeros((rows, chunks * 255), np.uint64)
    padded[:, :n] = h
    lanes, out = np.uint64(0x0101010101010101), np.zeros(rows, np.uint64)
    place = np.arange(8, dtype=np.uint64) * np.uint64(8)
    for j in range(8):
        counts = ((padded >> np.uint64(j)) & lanes).reshape(rows, chunks, 255).sum(2, dtype=np.uint64)
        set_bits = counts.view(np.uint8).reshape(rows, chunks, 8).sum(1, dtype=np.int64) * 2 > n
        out |= (set_bits.astype(np.uint64) << (place + np.uint64(j))).sum(1, dtype=np.uint64)
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number; 0 for a text without words."""
    h = shingle_hashes(text, shingle)
    return int(majority(h[None]).view(np.int64)[0]) if len(h) else 0


def wide_fingerprint(text: str | None, shingle: int, words: int) -> bytes:
    """``words`` independent fingerprints of 64 bits, one after the other, of the set of shingles: repeats do not vote again."""
    h = np.unique(shingle_hashes(text, shingle))
    if not len(h):
        return bytes(8 * words)
    odd = np.arange(1, 2 * words, 2, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = (h[None] ^ (h[None] >> np.uint64(31))) * odd
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return majority(x ^ (x >> np.uint64(32))).tobytes()


def fingerprints(docs: DataFrame, col: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a long column of fingerprints; whole texts, null counts as empty."""

    @F.arrow_udf("long")
    @tidy
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((fingerprint(x.as_py(), shingle) for x in texts), pa.int64())

    return docs.withColumn(col, of(F.col("text")))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """Start and width of each of the ``budget + 1`` blocks of the 64 bits."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(edges[:-1], np.diff(edges).tolist()))


class _Forest:
    """Smallest-index labels of linked positions, and the links that joined two components when they came."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[np.ndarray] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if len(a):
                # each larger label is joined to the smallest that it meets, by one link: no round of links
                high, low = np.maximum(x, y), np.minimum(x, y)
                order = np.lexsort((low, high))
                joins = order[np.unique(high[order], return_index=True)[1]]
                self.links.append(np.stack([a[joins], b[joins]]))
                label[high[joins]] = low[joins]
            while not np.array_equal(up := label[label], label):
                label = up
        self.label = label


class _Across:
    """Fixed labels of positions, and all links between different labels since they were last taken."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.links: list[np.ndarray] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        if apart.any():
            self.links.append(np.stack([a[apart], b[apart]]))


def trie_links(group: np.ndarray, value: np.ndarray, budget: int = BUDGET, bits: int = 64, near=None, chunk: int = 1 << 18) -> np.ndarray:
    """For positions sorted by group and 64-bit value, links (two rows of positions) that span each linked component within its group."""
    return np.concatenate([np.zeros((2, 0), np.int64), *_traverse(group, value, _Forest(len(value)), budget, bits, near, chunk)], 1)


def trie_pairs(group: np.ndarray, value: np.ndarray, label: np.ndarray, budget: int = BUDGET, bits: int = 64, near=None, chunk: int = 1 << 16) -> Iterator[np.ndarray]:
    """As :func:`trie_links`, but every link between positions of different labels, a part at a time."""
    return _traverse(group, value, _Across(label), budget, bits, near, chunk)


def _traverse(group: np.ndarray, value: np.ndarray, forest: _Forest | _Across, budget: int, bits: int, near, chunk: int) -> Iterator[np.ndarray]:
    """The links of ``forest`` as they are found.

    Nodes are ranges of positions that agree in their first ``depth`` bits.  Differing bits count in the first ``bits``
    bits; further ones only part the positions.  Two leaves are linked if they are within the budget and ``near``, given their positions,
    agrees.  A node pair is skipped once all its positions have one label.
    """
    n = len(value)
    if n < 2:
        return
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[cuts[1:], n]
    many = ends - cuts > 1
    stack = [(0, np.stack([cuts[many], ends[many], cuts[many], ends[many], np.zeros(many.sum(), np.int64)]))]
    ones: dict[int, np.ndarray] = {}
    mask = np.uint64((1 << 64) - (1 << (64 - bits)))

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """The first position of each range whose next bit is 1: ranges are sorted, so their ones stand last."""
        if depth not in ones:
            if len(ones) > 8:
                ones.clear()
            ones[depth] = np.r_[0, np.cumsum((value >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        return hi - (ones[depth][hi] - ones[depth][lo])

    def compare(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> None:
        width = y1 - y0
        count = (x1 - x0) * width
        of = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        i, j = x0[of] + k // width[of], y0[of] + k % width[of]
        some = (forest.label[i] != forest.label[j]) & (np.bitwise_count((value[i] ^ value[j]) & mask) <= budget)
        i, j = i[some], j[some]
        if near is not None and len(i):
            some = near(i, j)
            i, j = i[some], j[some]
        forest.link(i, j)

    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > chunk:
            stack.append((depth, pairs[:, chunk:]))
            pairs = pairs[:, :chunk]
        label = forest.label
        changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        a0, a1, b0, b1, _ = pairs
        done = (label[a0] == label[b0]) & (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0])
        a0, a1, b0, b1, off = pairs[:, ~done]
        leaves = (a1 - a0) * (b1 - b0) <= 16
        compare(a0[leaves], a1[leaves], b0[leaves], b1[leaves])
        yield from forest.links
        forest.links.clear()
        a0, a1, b0, b1, off = a0[~leaves], a1[~leaves], b0[~leaves], b1[~leaves], off[~leaves]
        if not len(a0):
            continue
        if depth == 64:  # equal values: each one of the left with all of the right
            for w, x, y, z in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist()):
                for i in range(w, x):
                    compare(*(np.array([v]) for v in (i, i + 1, y, z)))
                    yield from forest.links
                    forest.links.clear()
            continue
        am, bm = split(a0, a1, depth), split(b0, b1, depth)
        same, more = a0 == b0, int(depth < bits)
        children = [
            np.stack([a0, am, b0, bm, off]),
            np.stack([am, a1, bm, b1, off]),
            np.stack([a0, am, bm, b1, off + more]),
            np.stack([am, a1, b0, bm, off + more])[:, ~same],
        ]
        nxt = np.concatenate(children, 1)
        alive = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget) & ((nxt[0] != nxt[2]) | (nxt[1] - nxt[0] > 1))
        if alive.any():
            stack.append((depth + 1, nxt[:, alive]))


def _deal(dealt: DataFrame, key: list[str], node: str, heavy: int) -> DataFrame:
    """Rows with the pair of parts (``p``, ``q``) of their group to meet in: groups of more than ``heavy`` rows are met part by part."""
    large = dealt.groupBy(*key).count().where(F.col("count") > heavy).select(*key, F.ceil(F.col("count") / heavy).cast("int").alias("parts"))
    dealt = dealt.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64(node), F.col("parts")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")}).drop("parts", "mine", "other")


def links(prints: DataFrame, budget: int = BUDGET, heavy: int = HEAVY) -> DataFrame:
    """A spanning forest of all links between distinct fingerprints: ``a, b`` with ``a`` above ``b``; from distinct ``fp``.

    A block value of more than ``heavy`` fingerprints is dealt over several tasks: its fingerprints get parts by hash, and each pair
    of parts meets in one task.
    """
    signed = F.col("fp")
    turned = [
        # the block's bits in front, without sign; the rest keeps its order
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft(signed, at), 64 - width).alias("front"))
        for i, (at, width) in enumerate(_blocks(budget))
    ]
    dealt = prints.select("fp", F.explode(F.array(*turned)).alias("k")).select("fp", "k.block", "k.front")
    dealt = _deal(dealt, ["block", "front"], "fp", heavy)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @tidy
    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        f = pd.concat(got, ignore_index=True)
        group = f.groupby(["block", "front", "p", "q"], sort=False).ngroup().to_numpy()
        at = np.array([b[0] for b in _blocks(budget)], np.uint64)[f["block"].to_numpy()]
        fp = f["fp"].to_numpy().view(np.uint64)
        back = (np.uint64(64) - at) % np.uint64(64)
        value = np.where(at == 0, fp, (fp << at) | (fp >> back))
        order = np.lexsort((value, group))
        a, b = trie_links(group[order], value[order], budget)
        fp = fp[order].view(np.int64)
        yield pd.DataFrame({"a": fp[a], "b": fp[b]})

    met = dealt.repartition(n, "block", "front", "p", "q").mapInPandas(join, "a long, b long")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component of each node that has an edge (``a``, ``b``).

    Star contraction: in turn every node hands its larger neighbours, then its smaller ones, to the smallest node that it knows,
    until nothing changes.  Hub nodes are aggregated before they are joined, so none is gathered in one task.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())

    before = mark(edges)
    while before[0]:
        # larger neighbours of u go to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.where("a <> b"), "links")
        # u and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        small = materialize(small.where("a <> b").distinct(), "links")
        discard(edges)
        discard(large)
        edges, now = small, mark(small)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components_with(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots``, as :func:`components` gives them, once ``edges`` are added.

    Only edges between different roots are contracted, so a group that is joined already costs one row a node, however many edges lie in it.
    """
    ends = edges.select("a", "b")
    for c in "ab":
        top = roots.select(F.col("node").alias(c), F.col("root").alias("top"))
        ends = ends.join(top, c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
    # roots have no row in ``roots``, so the nodes that move are others than those below them
    moved = components(ends)
    below = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return materialize(below.select("node", F.coalesce("top", "root").alias("root")).unionByName(moved), "links", False)


def near_groups(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """For rows (``doc_id``, ``fp``) the table ``fp, component_id``: the smallest id reachable over links, null if all are null."""
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(own.select("fp"), budget))
    placed = own.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.select("fp", "root").join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    A document of fewer words than a shingle has its whole word sequence as the one shingle; null, empty and wordless
    texts have fingerprint zero and link like any other.  Repeated rows belong to one component; null ids are
    never the smallest.  An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "doc-prints")
    groups = near_groups(prints, budget)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Similar texts: words in a shingle, and the Jaccard similarity of their sets that links.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Candidates among fingerprints of so many words of 64 bits: a byte in front is equal and at most so many of the other bits of its 32-bit block differ (two
#: bytes of each block take the front in turn), and at most so many of all 512 bits.  At a similarity of 0.8 about 76 of them differ, 92 in one case of a hundred;
#: at 0.85 about 63.
WIDE_WORDS, BLOCK_BUDGET, CLOSE, LOOSE = 8, 3, 78, 108
#: Bits of a map of a text's shingles, which bounds the similarity of two texts from above.
MAP_BITS = 4096


def shingle_map(h: np.ndarray) -> bytes:
    """A bit for each of the distinct hashes, after their number (32 bits)."""
    bits = np.zeros(MAP_BITS, bool)
    bits[((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.int64)] = True
    return np.array([len(h)], "<u4").tobytes() + np.packbits(bits).tobytes()


def may_be_similar(n: np.ndarray, held: np.ndarray, maps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two texts can have a similarity of 0.8: a shared shingle sets a shared bit, or one that another shingle of both has set."""
    shared = np.bitwise_count(maps[i] & maps[j]).sum(1, dtype=np.int64) + np.minimum(n[i] - held[i], n[j] - held[j])
    return (1 + SIMILARITY) * shared >= SIMILARITY * (n[i] + n[j]) - 1e-6


def wide_candidates(prints: DataFrame, limit: int = LOOSE, heavy: int = HEAVY) -> DataFrame:
    """Pairs (``a``, ``b``) of rows ``node, wide`` whose fingerprints differ in at most ``limit`` bits: enough to span every group of such pairs.

    If rows have a ``root`` and a ``map``, all pairs of different roots that their maps allow.
    A pair at a similarity of 0.8 meets the block condition in one of 16 blocks in 98 of 100 cases.
    """
    blocks = 2 * WIDE_WORDS
    extra = [c for c in ("root", "map") if c in prints.columns]
    dealt = prints.select("node", "wide", *extra, F.explode(F.sequence(F.lit(0), F.lit(2 * blocks - 1))).alias("k"))
    own = F.substring(F.col("wide"), (F.floor(F.col("k") / 2) * 4 + 1).cast("int"), F.lit(4))
    # byte 0 or 2 of a block of four bytes in front
    dealt = dealt.select("node", *extra, "k", "wide", F.substring(own, (2 * (F.col("k") % 2) + 1).cast("int"), F.lit(1)).alias("front"))
    dealt = _deal(dealt, ["k", "front"], "node", heavy)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        node, k = t["node"].to_numpy(), t["k"].to_numpy().astype(np.int64)
        wide = np.frombuffer(b"".join(t["wide"].to_pylist()), np.uint64).reshape(len(node), -1)
        row = np.arange(len(node))
        block = wide.view(np.uint8).reshape(len(node), blocks, 4)[row, k // 2]
        first = 2 * (k % 2)
        key = (block[row, first].astype(np.int64) | k << 8) << 40 ^ (t["p"].to_numpy().astype(np.int64) << 20 | t["q"].to_numpy())
        b = [block[row, (first + i) % 4].astype(np.uint64) for i in (1, 2, 3)]
        value = b[0] << np.uint64(56) | b[1] << np.uint64(48) | b[2] << np.uint64(40) | wide[:, 0] >> np.uint64(24)
        order = np.lexsort((value, key))
        wide, node = wide[order], node[order]
        if "map" in extra:
            raw = np.frombuffer(b"".join(t["map"].take(pa.array(order)).to_pylist()), np.uint8).reshape(len(node), -1)
            size, maps = raw[:, :4].copy().view("<u4")[:, 0].astype(np.int64), raw[:, 4:].copy().view(np.uint64)
            held = np.bitwise_count(maps).sum(1, dtype=np.int64)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            some = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64) <= limit
            if "map" in extra and some.any():
                some[some] = may_be_similar(size, held, maps, i[some], j[some])
            return some

        if "root" in extra:
            found = trie_pairs(key[order], value[order], t["root"].to_numpy()[order], BLOCK_BUDGET, 24, near)
        else:
            found = [trie_links(key[order], value[order], BLOCK_BUDGET, 24, near)]
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    met = dealt.repartition(n, "k", "front", "p", "q").mapInArrow(join, "a long, b long")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def wide_node(text: Column) -> tuple[Column, Column]:
    """The wide fingerprint of a text, and its hash, by which texts are told apart."""

    @F.arrow_udf("binary")
    @tidy
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((wide_fingerprint(x.as_py(), WIDE_SHINGLE, WIDE_WORDS) for x in texts), pa.binary())

    wide = of(text)
    return wide, F.xxhash64(wide)


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, node, component_id`` (``node``: hash of the wide fingerprint) over links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidate pairs come from the trie self-join and are compared by their whole texts.  The first pairs only span the groups of
    candidates.  Where some of them are not similar, pairs that span the groups of close fingerprints are compared next; after that, all candidate pairs between
    texts not yet joined by similar ones are, but for those that maps of their shingles rule out.
    """

    @F.arrow_udf("boolean")
    def similar(one: pa.Array, two: pa.Array) -> pa.Array:
        sets = ([np.unique(shingle_hashes(x.as_py(), WIDE_SHINGLE)) for x in side] for side in (one, two))
        return pa.array([jaccard(a, b) >= SIMILARITY for a, b in zip(*sets)], pa.bool_())

    prints = materialize(docs.select("doc_id", wide_node(F.col("text"))[0].alias("wide")).withColumn("node", F.xxhash64("wide")), "wide-prints")
    own = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("wide").alias("wide"))

    @F.arrow_udf("binary")
    def map_of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_map(np.unique(shingle_hashes(x.as_py(), WIDE_SHINGLE))) for x in texts], pa.binary())

    def texts_of(nodes: DataFrame) -> DataFrame:
        """``node, text`` of one row for each node."""
        ends = nodes.select("node").distinct().join(own.select("node", "least"), "node")
        # an id may stand on several texts, so each row's own node decides
        rows = docs.join(ends.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
        rows = rows.select("text", wide_node(F.col("text"))[1].alias("node"))
        return rows.join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def mapped_nodes(nodes: DataFrame) -> DataFrame:
        return materialize(nodes.join(texts_of(nodes), "node").select("node", "wide", map_of("text").alias("map")), "wide-maps")

    def compared(pairs: DataFrame) -> DataFrame:
        """``a, b, alike`` by their texts."""
        texts = materialize(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "wide-texts")
        left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", similar("text_a", "text_b").alias("alike")), "wide-compared")

    first = compared(materialize(wide_candidates(own.select("node", "wide")), "wide-pairs"))
    roots = components(first.where("alike"))
    unlike = first.where("NOT alike")
    if not unlike.isEmpty():
        # groups of candidates that similar pairs do not join into one; two nodes have no other pair
        families = components_with(roots, unlike).select("node", F.col("root").alias("family"))
        families = families.unionByName(families.select(F.col("family").alias("node"), "family").distinct())
        loose = families.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = loose.groupBy("family").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("n > 2 AND x <> y")
        left_open = materialize(loose.join(apart.select("family"), "family", "left_semi").join(own.select("node", "wide"), "node").select("node", "wide"), "wide-open")
        if not left_open.isEmpty():
            close = wide_candidates(left_open, CLOSE).join(first.select("a", "b"), ["a", "b"], "left_anti")
            close = compared(materialize(close, "wide-pairs"))
            roots = components_with(roots, close.where("alike"))
            mapped = mapped_nodes(left_open).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            more = wide_candidates(mapped).join(first.select("a", "b").unionByName(close.select("a", "b")), ["a", "b"], "left_anti")
            roots = components_with(roots, compared(materialize(more, "wide-pairs")).where("alike"))
    placed = own.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "node").join(placed.join(least, "root").select("node", "component_id"), "node").select("doc_id", "node", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of similar texts the one with the smallest id.

    Null, empty and wordless texts are alike.  Each row goes or stays by its own text, also where an id is null or stands on several texts.  Rows that repeat the smallest id stay together; so do the rows of a group without any id.
    An empty table gives an empty result.
    """
    groups = similar_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone, node, gone_node = (own_name(docs, c) for c in ("gone_id", "own_node", "gone_node"))
    goes = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone), F.col("node").alias(gone_node)).distinct()
    goes = materialize(goes, "wide-gone")
    # only rows with an id of ``goes`` need their node; the others stay
    ids = goes.select(gone).distinct()
    marked = docs.join(ids.withColumn(gone_node, F.lit(True)), docs["doc_id"].cast("long").eqNullSafe(ids[gone]), "left").drop(gone)
    marked = marked.withColumn(node, wide_node(F.when(F.col(gone_node), F.col("text")))[1]).drop(gone_node)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(gone)) & (F.col(node) == F.col(gone_node))
    return marked.join(goes, same, "left_anti").select(*docs.columns)


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
