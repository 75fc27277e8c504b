"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints are cut into segments; each segment gives the indices of nearby Golay
codewords as keys, and a pair of segments is joined on a pair of keys.

* Exact search (64 bits, at most 3 differing): of three segments two have at most one
  error each, so every link shares the key of some pair of segments.  One side takes all
  keys of the first segment and the nearest codeword of the second, the other side the
  reverse.
* Similarity search (256 bits): two sets of at least a Jaccard similarity share one of
  the first shingles of both in any one order, so these are the keys, the rarer first;
  within each component of close fingerprints all pairs are then verified by their texts'
  sets of shingles.

Equal fingerprints are one node from the start.  Rows that share a key are compared in
numpy and only a spanning forest of the links leaves a task, never all pairs of a group;
keys with very many rows are dealt out in blocks.  Connected components are then found by
contraction, and told to the rows by a join that a fingerprint of very many rows does not
slow down.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kind, pieces, saved, small_batches, spread_join
from .golay import decode, near

#: Rows of a key above which it is dealt out in blocks of this many; a row of n is copied n / HOT times.
HOT = 8192
#: Hot keys (8 bytes each) that are broadcast; beyond, a merge join finds them.
BROADCAST = 1_000_000
#: Nodes, of some hundred bytes, that are broadcast with their components; beyond, they are shuffled.
NODES = 20_000
#: Rows and bytes of shingle sets of a component above which it is dealt out in blocks.
BLOCK = (512, 8 << 20)
#: Sets of at most so many shingles are candidates whatever their fingerprints.
SHORT = 32
#: Documents from which the shingles that come last in the order are learnt, and how many of these at most.
ORDER = (20_000, 250_000)
#: Mixing multipliers for the further words of a long fingerprint: odd constants of the public SplitMix64 finaliser.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _bit_counts(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many hashes have each bit set; further words of 64 bits are mixed from the first."""
    out = []
    for w in range(words):
        x = hashes
        if w:
            x = hashes + np.uint64((0x9E3779B97F4A7C15 * w) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
            x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
            x = x ^ (x >> np.uint64(31))
        out.append(sum(np.unpackbits(x[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(x), 4096)))
    return np.concatenate(out)


def shingle_hashes(w: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles; a shorter text is one shingle."""
    joined = b" ".join(w)
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip([0, *[g + 1 for g in gaps]], [*gaps[shingle - 1 :], len(joined)], strict=False)], np.uint64)


def fingerprint(text: bytes, shingle: int = 3, words: int = 1, distinct: bool = False) -> bytes:
    """Big-endian SimHash of 64 * ``words`` bits over XXH64 (seed 42) of word shingles; a text without words has zero."""
    w = text.lower().split()
    if not w:
        return bytes(8 * words)
    values = shingle_hashes(w, shingle)
    if distinct:
        values = np.unique(values)
    return np.packbits(_bit_counts(values, words) * 2 > len(values)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id, t (the text's hash) and fp (binary) of every row; null texts count as empty."""

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t, shingle, words, distinct) for t in as_bytes(b.column(2))], pa.binary())], ["doc_id", "t", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, t bigint, fp binary")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(text.lower().split(), shingle))


def first_shingles(values: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """32-bit keys of the first of a set's hashes, the ``common`` ones after the others: sets of at least the similarity share one."""
    last = np.isin(values, common, assume_unique=True)
    ordered = np.concatenate([values[~last], values[last]])[: len(values) - math.ceil(similarity * len(values) - 1e-9) + 1]
    return np.unique((ordered ^ (ordered >> np.uint64(32))).astype(np.uint32)).view(np.int32)


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that several of a sample of documents share; they only order shingles, whatever they are no link is lost."""
    share = min(1.0, ORDER[0] / max(1, docs.count()))

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, shingle) for t in as_bytes(b.column(0))]).view(np.int64))], ["h"])

    some = docs.select("text").filter(F.xxhash64(F.lit(5), "text") <= F.lit(int((2 * share - 1) * 2**63) if share < 1 else 2**63 - 1))
    found = some.mapInArrow(run, "h bigint").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(ORDER[1]).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def signatures(docs: DataFrame, shingle: int, words: int, similarity: float) -> DataFrame:
    """doc_id, t and fp of every row as ``fingerprints``, node (fp, number of shingles and a hash of their set) and first (keys of its first shingles)."""
    common = common_shingles(docs, shingle)

    def run(batches):
        for b in pieces(batches):
            fp, node, first = [], [], []
            for t in as_bytes(b.column(2)):
                values = shingle_set(t, shingle)
                fp.append(np.packbits(_bit_counts(values, words) * 2 > len(values)).tobytes() if t.split() else bytes(8 * words))
                node.append(fp[-1] + np.array([len(values), xxhash.xxh64_intdigest(values.tobytes(), 42)], np.uint64).tobytes())
                first.append(first_shingles(values, similarity, common).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.binary()) for x in (fp, node, first)]], ["doc_id", "t", "fp", "node", "first"])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, t bigint, fp binary, node binary, first binary")


#: Segments of a fingerprint: (first bit, bits), counted from the most significant.
EXACT_SEGMENTS = ((0, 22), (22, 21), (43, 21))
EXACT_PAIRS = ((0, 1), (0, 2), (1, 2))


def _segments(bits: np.ndarray, cuts) -> list[np.ndarray]:
    return [bits[:, a : a + n].astype(np.int64) @ (1 << np.arange(n - 1, -1, -1)) for a, n in cuts]


def _pair_keys(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], pair: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a pair of segments and the rows they belong to."""
    keys = (pair << 24) | (a[0][:, :, None] << 12) | b[0][:, None, :]
    there = a[1][:, :, None] & b[1][:, None, :]
    return keys[there], np.nonzero(there)[0]


def _exact_keys(bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    segments = _segments(bits, EXACT_SEGMENTS)
    every = [near(s, n) for s, (_, n) in zip(segments, EXACT_SEGMENTS, strict=True)]
    own = [(decode(s)[:, None], np.ones((len(s), 1), bool)) for s in segments]
    for p, (i, j) in enumerate(EXACT_PAIRS):
        yield *_pair_keys(every[i], own[j], p), 0
        yield *_pair_keys(own[i], every[j], p), 1


def _key_rows(keys: Callable):
    def run(batches):
        for b in pieces(batches, 1024):
            fps = b.column(0).cast(pa.binary())
            bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1), axis=1)
            for key, row, side in keys(bits):
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(np.full(len(key), side, np.int8)), fps.take(pa.array(row))], ["key", "side", "fp"])

    return run


def _first_rows(batches):
    for b in pieces(batches, 128):
        keys = [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]
        row, key = np.repeat(np.arange(len(keys)), [len(x) for x in keys]), np.concatenate(keys)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), 2, np.int8)), b.column(0).cast(pa.binary()).take(pa.array(row))], ["key", "side", "fp"])


def _near(a: np.ndarray, b: np.ndarray, most: int, similarity: float | None) -> np.ndarray:
    """Which nodes (last axis: words) are linked: different fingerprints with at most ``most`` differing bits; with a similarity, what may reach it by size and by fingerprint."""
    apart = lambda n: sum(np.bitwise_count(a[..., w] ^ b[..., w]).astype(np.uint16) for w in range(n))
    if similarity is None:
        d = apart(a.shape[-1])
        return (d <= most) & (d > 0)
    few, many = np.minimum(a[..., -2], b[..., -2]), np.maximum(a[..., -2], b[..., -2])
    return ((few <= SHORT) | (apart(a.shape[-1] - 2) <= most)) & (few >= similarity * many - 1e-9) & (a[..., -1] != b[..., -1])


class Forest:
    """Links that connect what all links seen connect, by union-find."""

    def __init__(self):
        self.parent: dict[bytes, bytes] = {}
        self.links: list[tuple[bytes, bytes]] = []

    def root(self, x: bytes) -> bytes:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[p]
        return x

    def joins(self, a: bytes, b: bytes) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
        return ra != rb

    def add(self, a: bytes, b: bytes) -> None:
        if self.joins(a, b):
            self.links.append((a, b))


def _compare(left: np.ndarray, right: np.ndarray, most: int, similarity: float | None, found: Forest, tile: int = 1024) -> None:
    """Adds the links between two sets of nodes (rows of uint64 words), a tile at a time."""
    for i in range(0, len(left), tile):
        a = left[i : i + tile]
        for j in range(0, len(right), tile):
            b = right[j : j + tile]
            near_ = _near(a[:, None], b[None], most, similarity)
            rows, cols = np.nonzero(near_)
            if len(rows) > 8 * (len(a) + len(b)):
                rows, cols = _spanning(near_)
            for x, y in zip(rows.tolist(), cols.tolist(), strict=True):
                found.add(a[x].tobytes(), b[y].tobytes())


def _spanning(near_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the matrix connects: labels spread from row to column and back, and each step that changes a label keeps its link."""
    n, m = near_.shape
    rows, cols = np.arange(n), np.full(m, n + m)
    out_r, out_c = [], []
    big = n + m
    while True:
        spread = np.where(near_, rows[:, None], big)
        best, at = spread.min(axis=0), spread.argmin(axis=0)
        new = best < cols
        out_r.append(at[new]), out_c.append(np.flatnonzero(new))
        cols = np.minimum(cols, best)
        spread = np.where(near_, cols[None, :], big)
        best, at = spread.min(axis=1), spread.argmin(axis=1)
        moved = best < rows
        out_r.append(np.flatnonzero(moved)), out_c.append(at[moved])
        rows = np.minimum(rows, best)
        if not moved.any():
            return np.concatenate(out_r), np.concatenate(out_c)


def _links(width: int, most: int, similarity: float | None):
    """Reads rows sorted by key, block and side; yields links that connect all that its groups connect."""

    def group(sides: np.ndarray, fps: np.ndarray, found: Forest) -> None:
        if len(sides) < 2:
            return
        if sides[0] == 2:
            left = right = fps
        else:
            left, right = fps[sides == 0], fps[sides == 1]
        if len(left) and len(right):
            _compare(left, right, most, similarity, found)

    def small(starts: np.ndarray, sizes: np.ndarray, sides: np.ndarray, fps: np.ndarray, found: Forest) -> None:
        """Groups of a few rows all at once: rows 1, 2, 3 ... apart."""
        last = np.repeat(starts + sizes, sizes)
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]) if len(starts) else np.zeros(0, int)
        step = 1
        while len(at):
            live = at + step < last
            at, last = at[live], last[live]
            other = at + step
            pick = ((sides[at] == 2) | (sides[at] != sides[other])) & _near(fps[at], fps[other], most, similarity)
            for x, y in zip(at[pick].tolist(), other[pick].tolist(), strict=True):
                found.add(fps[x].tobytes(), fps[y].tobytes())
            step += 1

    def run(batches):
        found = Forest()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(keys, sides, fps):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(keys)))
            few = (sizes > 1) & (sizes <= 32)
            small(starts[few], sizes[few], sides, fps, found)
            for a, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
                group(sides[a : a + n], fps[a : a + n], found)

        for b in batches:
            if not b.num_rows:
                continue
            keys = (b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) << 32) | b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            sides = b.column(2).to_numpy(zero_copy_only=False)
            fps = np.frombuffer(b"".join(b.column(3).cast(pa.binary()).to_pylist()), np.uint64).reshape(-1, width)
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut or (held and held[-1][0][-1] != keys[0]):
                whole = [*held, (keys[:cut], sides[:cut], fps[:cut])]
                flush(*(np.concatenate(x) for x in zip(*whole, strict=True)))
                held = []
            held.append((keys[cut:], sides[cut:], fps[cut:]))
        if held:
            flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(found.links), 65536):
            a, b = zip(*found.links[i : i + 65536], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def find_links(nodes: DataFrame, words: int, most: int, exact: bool, similarity: float = 0.8) -> DataFrame:
    """a, b: links between distinct ``nodes.fp``, enough of them to connect all that are connected.

    ``exact``: fingerprints with at most ``most`` differing bits.  Else signatures' nodes that share one of
    ``nodes.first`` and are close enough in size and, but for short ones, in fingerprint.
    """
    rows = (nodes.select("fp").mapInArrow(_key_rows(_exact_keys), "key int, side byte, fp binary") if exact else nodes.select("fp", "first").mapInArrow(_first_rows, "key int, side byte, fp binary"))
    sides = [F.count_if(F.col("side") != 1 - i).alias(f"n{i}") for i in (0, 1)]  # side 2 is both
    blocks = lambda i: F.ceil(F.greatest(F.lit(1), F.col(f"n{i}") / HOT)).cast("int").alias(f"blocks{i}")
    hot = saved(rows.groupBy("key").agg(*sides).filter((F.greatest("n0", "n1") > HOT) & (F.least("n0", "n1") > 0)).select("key", blocks(0), blocks(1)))
    few = hot.count() <= BROADCAST  # then the rows are shuffled once, with their blocks
    rows = rows.join(F.broadcast(hot) if few else hot.hint("merge"), "key", "left").withColumns({f"blocks{i}": F.coalesce(f"blocks{i}", F.lit(1)) for i in (0, 1)})
    mine = lambda i: F.pmod(F.xxhash64("fp"), F.col(f"blocks{i}")).cast("int")
    each = lambda i: F.sequence(F.lit(0), F.col(f"blocks{i}") - 1)
    if exact:  # a grid: each block of the one side with each of the other
        block = F.when(F.col("side") == 0, F.transform(each(1), lambda j: mine(0) * F.col("blocks1") + j)).otherwise(F.transform(each(0), lambda j: j * F.col("blocks1") + mine(1)))
    else:  # pairs of blocks
        block = F.transform(each(0), lambda j: F.least(mine(0), j) * F.col("blocks0") + F.greatest(mine(0), j))
    block = F.when(F.col("blocks0") * F.col("blocks1") == 1, F.array(F.lit(0))).otherwise(block)  # nearly all keys
    rows = rows.select("key", F.explode(block).alias("block"), "side", "fp").repartition("key", "block").sortWithinPartitions("key", "block", "side")
    return rows.mapInArrow(_links(words if exact else words + 2, most, None if exact else similarity), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of a link the same root in one component.

    Each round every node moves to the neighbour (or itself) first by hash, links move
    along and those within one node go; at least a constant share of the nodes goes each
    round.  The rounds' moves are then followed from the first to the last.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("fp"))
    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    moves = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = saved(both.groupBy("a").agg(F.min(first("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), first("a"))["fp"].alias("next")))
        moves.append(move)
        links = links.join(move, links["a"] == move["node"]).select(F.col("next").alias("a"), "b")
        links = links.join(move, links["b"] == move["node"]).select("a", F.col("next").alias("b"))
        links = saved(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].withColumnRenamed("next", "root")
    for move in moves[1:]:
        step = move.withColumnRenamed("node", "m_node")
        out = out.join(step, out["root"] == step["m_node"], "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def distance_for(similarity: float, bits: int) -> int:
    """Differing bits expected of sets with this Jaccard similarity and equal sizes, and six standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def alike(sets: list[np.ndarray], sides: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links that connect all pairs of sets with at least the Jaccard similarity; where both sides occur, of pairs across them.

    Each set reached is compared with all that are not, by the postings of their members.
    """
    sizes, across = np.array([len(x) for x in sets]), len(np.unique(sides)) > 1
    left, built, todo = np.arange(len(sets)), 0, []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        elif not built or 2 * len(left) < built:
            built, member, owner = len(left), np.concatenate([sets[i] for i in left]), np.repeat(left, sizes[left])
            order = np.argsort(member, kind="stable")
            member, owner = member[order], owner[order]
        else:
            x = todo.pop()
            low = np.searchsorted(member, sets[x])
            n = np.searchsorted(member, sets[x], "right") - low
            both = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))[left]
            hit = both >= similarity * (sizes[x] + sizes[left] - both) - 1e-9
            if across:
                hit &= sides[left] != sides[x]
            new, left = left[hit].tolist(), left[~hit]
            todo += new
            yield from ((x, y) for y in new)


def similar_links(docs: DataFrame, nodes: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: links that connect all pairs within a component of ``links`` whose texts' shingle sets have at least the similarity.

    ``nodes`` names a row (rep: doc_id and t, the text's hash) for each fingerprint.  Every
    pair of a component is tested, linked or not; large components are dealt out in pairs of blocks.
    """
    roots = components(links)
    ends = saved(roots.join(nodes.select("fp", "rep"), roots["node"] == F.col("fp")).select("fp", "root", "rep"))
    few = ends.count() <= NODES

    def sets(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_set(t, shingle).tobytes() for t in as_bytes(b.column(2))], pa.binary())], ["fp", "root", "s"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    texts = texts.join(F.broadcast(ends) if few else ends.hint("merge"), (F.col("t") == F.col("rep.t")) & F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))).select("fp", "root", "text")
    held = saved(texts.mapInArrow(sets, "fp binary, root binary, s binary").groupBy("fp").agg(F.first("root").alias("root"), F.first("s").alias("s")))  # a row may be repeated

    def run(batches):
        key, rows = None, []

        def flush():
            fps, sides, found = zip(*rows, strict=True)
            got = [(fps[x], fps[y]) for x, y in alike([np.frombuffer(x, np.uint64) for x in found], np.array(sides), similarity)]
            if got:
                a, b = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            for b in pieces([batch]):
                for root, block, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if rows and (root, block) != key:
                        yield from flush()
                        rows = []
                    key = (root, block)
                    rows.append(row)
        if rows:
            yield from flush()

    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK[0], F.sum(F.length("s")) / BLOCK[1])).cast("int")
    sizes = saved(held.groupBy("root").agg(blocks.alias("blocks")).filter("blocks > 1"))
    dealt = spread_join(held, sizes, "root").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.least(mine, i) * F.col("blocks") + F.greatest(mine, i))
    dealt = dealt.select("root", F.explode(pair).alias("block"), "fp", mine.alias("side"), "s").repartition("root", "block").sortWithinPartitions("root", "block")
    return dealt.mapInArrow(run, "a binary, b binary")


def grouped(docs: DataFrame, shingle: int = 5, similarity: float | None = 0.8, words: int = 4, radius: int = 3) -> DataFrame:
    """As ``near_duplicates``, with t (the text's hash) and root (the same for all rows of a component)."""
    small_batches(docs.sparkSession)
    exact = similarity is None
    words = 1 if exact else words
    most = radius if exact else distance_for(similarity, 64 * words)
    prints = saved(fingerprints(docs, shingle, words).withColumn("node", F.col("fp")) if exact else signatures(docs, shingle, words, similarity))
    held = [F.min("doc_id").alias("least"), F.max(F.struct("doc_id", "t")).alias("rep"), *([] if exact else [F.first("first").alias("first")])]
    nodes = saved(prints.groupBy("node").agg(*held).withColumnRenamed("node", "fp"))
    links = find_links(nodes, words, most, exact, similarity)
    if not exact:
        links = similar_links(docs, nodes, links, shingle, similarity)
    roots = components(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "c_root")
    named = saved(rooted.join(least, rooted["root"] == least["c_root"]).select(F.col("fp").alias("node"), "root", "component_id"))
    return spread_join(prints, named, "node", "inner", limit=NODES).select("doc_id", "t", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float | None = 0.8, words: int = 4, radius: int = 3) -> DataFrame:
    """doc_id, fp (binary) and component_id, the smallest doc_id of the row's component, of every row.

    ``similarity`` None: 64-bit fingerprints over all shingles, links at ``radius`` (at most
    3) differing bits, none lost.  Else fingerprints of 64 * ``words`` bits over distinct
    shingles; texts link when their sets of shingles have at least the Jaccard
    ``similarity``.  Texts that share one of their first shingles, and lie within six
    standard deviations of the distance expected, are proposed, and every pair of what
    these connect is verified.  Texts of fewer words than a shingle
    are one shingle, null and wordless ones have fingerprint zero and link like others;
    without ``similarity`` texts with equal fingerprints count as alike.  Null ids are passed over for
    component_id unless a component has no other; repeated rows and an empty table work;
    other columns are not read.
    """
    return grouped(docs, shingle, similarity, words, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all their columns, one row of each component: the one with the smallest doc_id, null ids last (of rows with that id, one by their text's hash)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t"))
    kept = saved(grouped(docs, **how).groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("k_doc"), F.col("k.t").alias("k_t")))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("r_doc"), F.xxhash64("text").alias("r_t"))
    rows = whole.join(kept, (F.col("r_t") == F.col("k_t")) & F.col("r_doc").eqNullSafe(F.col("k_doc")), "left_semi")
    if not whole.groupBy("r_doc", "r_t").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("r_doc", "r_t").agg(F.first("row").alias("row"))  # rows equal in id and text
    return rows.select("row.*")
