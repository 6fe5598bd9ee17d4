"""N-gram Jaccard join by prefix trees.

Each document is the set of its distinct word n-grams (64-bit fingerprints). Documents
with equal sets form a class; classes are joined.

1. *Order.* Every task counts the fingerprints of its documents in a table of
   ``2**bits`` counters; the summed counters, rounded to steps of an eighth octave in one
   byte each, give the global order (rare first, then by fingerprint). The table covers
   all documents; its size is fixed by ``bits`` and it is all that the driver holds.
2. *Candidates.* In that order, two sets with Jaccard similarity t or more share at least
   l of the first ``n - ceil(t * n) + l`` n-grams of the one whose prefix ends first. With
   l a tenth of a set, a set whose prefix shares fewer n-grams than the smallest partner's
   l, with anybody of a size that a link allows, has no link and goes. Classes that still
   share an n-gram are chained by size, n-gram by n-gram; a chain breaks where the smaller
   of two neighbours has less than t of the larger one's size. The connected components of
   these chains are the candidate clusters: every link lies inside a cluster. Chains of
   n-grams that the counters call frequent are salted; their parts meet in nodes that
   stand for the n-gram and a band of sizes. Clusters too large for a task take the step
   again, with counters of their own, as long as that makes them smaller: in a large
   corpus a counter holds many n-grams, and common passages chain what shares no more.
3. *Trees.* The sets of a cluster meet in one task. There they are ordered by the
   cluster's own frequencies and stored in a prefix tree. Groups of sets walk the tree
   level by level, sharing the overlaps of common prefixes; a subtree is left where the
   remaining lengths cannot reach the threshold, or where all its sets are in the
   walker's component already. The components of a cluster in one task are final.
4. *Large clusters* are cut into blocks. Each block first meets the cluster's ``PIVOTS``
   pivots, which joins the bulk of a group of copies. Then every set outside its
   cluster's largest component is compared, in blocks, with the whole cluster. No pair
   between different components is left out, and copies are not expanded into pairs.

Similarities are exact for the fingerprints; at 10**9 different n-grams the chance that
any two share a fingerprint is about 3 %, and it would move one set by one element.

Defined results: null or empty texts (and those without words) have an empty set and are
linked with nothing; texts with fewer words than n have one n-gram, the whole sequence;
repeated rows are one class; rows with a null id take the component of equal texts, and a
class without any id is linked with nothing and has a null component; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import chunks, give_back, light, spread_join, written

CHUNK_BYTES = 1 << 20
#: Frequencies from which an n-gram's chain is salted, in all and inside large clusters; sets and n-grams that meet in a task.
HOT, HOT_INSIDE = 20_000, 500
UNIT_SETS = 1_000
UNIT_GRAMS = 2_000_000
PIVOTS = 32
#: Rows (of 48 bytes) that may be broadcast.
SENT_ROWS = 500_000
#: Edges (of 16 bytes) that a task unites at a time.
EDGES = 1_000_000
#: Bits of the counters' number. More of them cost as many bytes a task on disk.
LEAST_BITS, MOST_BITS = 18, 22

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWER = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Fingerprints of the n-grams of many texts at once."""

    def __init__(self, n: int) -> None:
        self.n = n
        letters = mixed(np.arange(1, 257, dtype=U))
        letters[65:91] = letters[97:123]  # A-Z as a-z
        self.letters = letters
        self.up, self.down = np.ones(0, U), np.ones(0, U)

    def _powers(self, size: int) -> None:
        if len(self.up) < size:
            size = max(size, 2 * CHUNK_BYTES)
            self.up, self.down = np.full(size, U(_POWER)), np.full(size, U(pow(_POWER, -1, 2**64)))
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def _words(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of the words; the last byte is white space."""
        self._powers(len(flat) + 1)
        space = _SPACE[flat]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        total = np.zeros(len(flat) + 1, U)
        np.cumsum(self.letters[flat] * self.up[: len(flat)], out=total[1:])
        return starts, mixed((total[ends] - total[starts]) * self.down[starts] + U(1))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct fingerprints of each text."""
        flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in texts])
        if len(flat) <= 4 * CHUNK_BYTES:
            starts, word = self._words(flat)
        else:  # a very long text goes in pieces that end with white space
            found, at = [], 0
            while at < len(flat):
                end = min(len(flat), at + 2 * CHUNK_BYTES)
                while not _SPACE[flat[end - 1]]:
                    end += 1
                found.append(self._words(flat[at:end]))
                found[-1] = (found[-1][0] + at, found[-1][1])
                at = end
            starts, word = (np.concatenate(x) for x in zip(*found, strict=True))
        upto = np.searchsorted(starts, ends_of)  # words up to the end of each text
        count = np.diff(np.concatenate(([0], upto)))
        n = self.n
        grams = np.zeros(max(0, len(word) - n + 1), U)
        for i in range(n):
            grams = mixed(grams + word[i : len(word) - n + 1 + i])
        out = []
        for first, words in zip((upto - count).tolist(), count.tolist(), strict=True):
            if words == 0:
                out.append(np.zeros(0, U))
            elif words < n:
                g = np.full(1, U(words))
                for w in word[first : first + words]:
                    g = mixed(g + w)
                out.append(g)
            else:
                g = np.sort(grams[first : first + words - n + 1])
                out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        return out


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, the first other than 0; 0 for empty sets."""
    out, other = np.zeros(len(sets), U), np.zeros(len(sets), U)
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    if len(full):
        flat, ends = np.concatenate(sets), np.cumsum(size[full])
        a = np.add.reduceat(mixed(flat ^ U(0x243F6A8885A308D3)), ends - size[full])
        b = np.add.reduceat(mixed(flat + U(0x13198A2E03707344)), ends - size[full])
        out[full] = np.maximum(mixed(a ^ mixed(b + size[full].astype(U))), U(1))
        other[full] = mixed(b ^ mixed(a + U(0x452821E638D01377)))
    return out.view(np.int64), other.view(np.int64)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of about a megabyte, with their texts as bytes."""
    col = batch.column(column)
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]).tolist() if len(col) else []
    for i, j in chunks(sizes, CHUNK_BYTES):
        yield i, j, [x or b"" for x in col.slice(i, j - i).to_pylist()]
        give_back()


PROFILE = "doc_id long, n long, node long, other long, part int, counts binary"
FIELDS = ["doc_id", "n", "node", "other", "part", "counts"]
PARTS = 16


def _packed(counts: np.ndarray) -> bytes:
    """Counters, the low bytes of all before the next: the high ones are nearly all 0."""
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(piece: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(piece), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _pieces(counts: np.ndarray) -> list[pa.Array]:
    """part and counts of a task's counters."""
    return [pa.array(range(PARTS), pa.int32()), pa.array([_packed(c) for c in np.split(counts, PARTS)], pa.binary())]


def _profiles(n: int, bits: int, keep: tuple[str, ...]):
    """Documents' set sizes and names; after them this task's counters, in PARTS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(n), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for i, j, texts in _texts(batch, "text"):
                sets = shingler.sets(texts)
                grams = np.concatenate(sets)
                np.add.at(counts, (grams >> U(64 - bits)).astype(np.int64), np.uint32(1))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), sizes, *set_names(sets), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary()), *(batch.column(c).slice(i, j - i) for c in keep)], names=[*FIELDS, *keep])
        if counts.any():
            yield pa.record_batch([*(pa.nulls(PARTS, pa.int64()) for _ in FIELDS[:4]), *_pieces(counts), *(pa.nulls(PARTS, pa.int64()) for _ in keep)], names=[*FIELDS, *keep])

    return run


def _summed(bits: int, last: bool):
    """Sums of the counters of each part, one part's counters at a time where rows are sorted."""
    size = (1 << bits) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def summed() -> pa.RecordBatch:
            if last:  # steps of an eighth octave
                out = [zlib.compress(np.minimum(255, np.floor(8 * np.log2(1.0 + t))).astype(np.uint8).tobytes(), 1) for t in total.values()]
            else:
                out = [_packed(np.minimum(t, 2**32 - 1).astype(np.uint32)) for t in total.values()]
            return pa.record_batch([pa.array([*total], pa.int32()), pa.array(out, pa.binary())], names=["part", "counts"])

        for batch in batches:
            for part, piece in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if last and total and part not in total:
                    yield summed()
                    total = {}
                total.setdefault(part, np.zeros(size, np.uint64))
                total[part] += _unpacked(piece)
        if total:
            yield summed()

    return run


def frequency_order(profiles: DataFrame, bits: int) -> np.ndarray:
    """The counters of all tasks, summed by readers and then by part; ``2**bits`` bytes."""
    spread = profiles.filter("part IS NOT NULL").select("part", "counts")
    summed = spread.mapInArrow(light(_summed(bits, False)), "part int, counts binary").repartition("part").sortWithinPartitions("part")
    rows = summed.mapInArrow(light(_summed(bits, True)), "part int, counts binary").collect()  # PARTS rows
    order, step = np.zeros(1 << bits, np.uint8), (1 << bits) // PARTS
    for r in rows:
        order[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return order


def least_shared(n: int, extra: int) -> int:
    """How many n-grams of its prefix a set of n shares with each partner of its size or more."""
    return max(1, extra * n // 100)


def smallest_partner(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def prefix_size(n: int, percent: int, extra: int) -> int:
    return n - smallest_partner(n, percent) + least_shared(n, extra)


ENTRY = "gram long, salt int, node long, n int"


def _entries(sets: list[np.ndarray], keys: list[np.ndarray], nodes: list[int], rank: np.ndarray, bits: int, percent: int, extra: int, often_from: int) -> pa.RecordBatch:
    """(gram, salt, node, n) for the prefix of every set. Each n-gram is counted and named by its key."""
    hot = int(8 * np.log2(1.0 + often_from))
    grams, salts, own, size = [], [], [], []
    for s, key, node in zip(sets, keys, nodes, strict=True):
        p = min(len(s), prefix_size(len(s), percent, extra))
        often = rank[(key >> U(64 - bits)).astype(np.int64)]
        first = np.argsort(often, kind="stable")[:p]
        grams.append(key[first].view(np.int64))
        ways = np.where(often[first] >= hot, np.exp2(np.maximum(0, often[first].astype(np.int64) - hot) / 8).astype(np.int64) * 2, 0)
        salts.append(np.where(ways > 0, 1 + node % np.maximum(ways, 1), 0))
        own.append(np.full(p, node, np.int64))
        size.append(np.full(p, len(s), np.int32))
    return pa.record_batch([np.concatenate(grams), np.concatenate(salts).astype(np.int32), np.concatenate(own), np.concatenate(size)], names=["gram", "salt", "node", "n"])


def _prefixes(n: int, bits: int, percent: int, extra: int, order):
    """(gram, salt, node, n) for the prefix of every text's set; a set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rank, seen = Shingler(n), order.value, set()
        for batch in batches:
            for _, _, texts in _texts(batch, "text"):
                sets, nodes, every = [], [], shingler.sets(texts)
                for s, node, other in zip(every, *(x.tolist() for x in set_names(every)), strict=True):
                    if not len(s) or (node, other) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add((node, other))
                    sets.append(s)
                    nodes.append(node)
                if sets:
                    yield _entries(sets, sets, nodes, rank, bits, percent, extra, HOT)

    return run


def _clustered(entries: DataFrame, percent: int, extra: int, edges: int) -> DataFrame:
    """(node, comp): the candidate clusters of prefixes (gram, salt, node, n).

    The nodes that share an n-gram are chained by size. A chain breaks where no link can
    cross; the parts of a salted chain meet in nodes of their own, one for each band of
    sizes, which hold the sets of the band and of the one below: sizes that a link allows
    are at most a band apart.
    """
    chain = Window.partitionBy("gram", "salt").orderBy("n", "node")
    prev = F.when(100 * F.lag("n").over(chain).cast("long") >= percent * F.col("n").cast("long"), F.lag("node").over(chain))
    after = F.when(100 * F.col("n").cast("long") >= percent * F.lead("n").over(chain).cast("long"), F.lead("node").over(chain))
    near = entries.withColumn("prev", prev).withColumn("next", after)
    shared = near.filter("salt > 0 OR prev <> node OR next <> node").select(*entries.columns)
    own = Window.partitionBy("node")  # a set's own prefix
    need = F.min(F.expr(f"greatest(1, {extra} * (({percent}L * n + 99) div 100) div 100)")).over(own)
    kept = shared.withColumn("held", F.count("*").over(own)).withColumn("need", need).filter("held >= need").drop("held", "need")
    band = F.floor(F.log(F.col("n")) / math.log(101 / percent))  # wider than percent, for rounding
    hub = lambda k: F.xxhash64("gram", F.col("band") + k)
    first = (F.col("salt") > 0) & ~F.lag("band").over(chain).eqNullSafe(F.col("band"))
    ends = F.when(first, F.array(prev, hub(0), hub(1))).otherwise(F.array(prev))
    chained = kept.withColumn("band", band).select(F.col("node").alias("a"), ends.alias("ends")).filter("size(ends) > 1 OR ends[0] <> a")
    return components(chained.select("a", F.explode("ends").alias("b")).filter("a <> b"), edges)


def _forest(names_of: tuple[str, str], with_roots: bool):
    """The edges (a, b) of a task as stars with the same components, ``EDGES`` at a time.

    ``with_roots`` adds a row for each centre, for a task that holds all edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def contracted(roots: bool = False) -> tuple[np.ndarray, np.ndarray]:
            a, b = (np.concatenate(x) for x in zip(*kept, strict=True))
            names, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
            root = _roots(len(names), flat[: len(a)], flat[len(a) :])
            far = slice(None) if roots else root != np.arange(len(root))
            return names[far], names[root[far]]

        for batch in batches:
            kept.append(tuple(batch.column(k).to_numpy() for k in ("a", "b")))
            n += batch.num_rows
            if n > EDGES:
                kept = [contracted()]
                n = len(kept[0][0])
                if 2 * n > EDGES and not with_roots:
                    yield pa.record_batch([*kept[0]], names=[*names_of])
                    kept, n = [], 0
        if n:
            yield pa.record_batch([*contracted(with_roots)], names=[*names_of])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each vertex's component: hooking to smaller roots, then jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def components(edges: DataFrame, bound: int = EDGES) -> DataFrame:
    """(node, comp): the smallest node that each end of the edges (a, b) can reach.

    Every task first replaces the edges it holds by stars, without a shuffle. Up to
    ``bound`` of these (of 16 bytes, a checked size) are united by one task. Beyond it
    each node is contracted into the first of its neighbours and itself, in an order by
    hash that changes every round, so that the nodes left shrink by a constant factor;
    the contracted graph is solved the same way and its labels are looked up. Joins keep
    nodes of very many edges apart (:func:`spread_join`).
    """
    labels, least = _labels(edges, bound, 0)
    if least:
        return labels
    names = written(labels.groupBy("comp").agg(F.min("node").alias("least"), F.count("*").alias("k")), "least")
    return written(spread_join(labels, names, ["comp"], ["least"]).select("node", F.col("least").alias("comp")), "labels")


def _labels(edges: DataFrame, bound: int, turn: int) -> tuple[DataFrame, bool]:
    """(node, comp) with one comp for each component, and whether it is the smallest node."""
    stars = written(edges.mapInArrow(light(_forest(("a", "b"), False)), "a long, b long"), "stars")
    if stars.count() <= bound:
        return written(stars.coalesce(1).mapInArrow(light(_forest(("node", "comp"), True)), "node long, comp long"), "labels"), True
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
    hooks = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("k"), F.min(first("b")).alias("near"))
    hooks = written(hooks.select("node", "k", F.least(first("node"), F.col("near"))["v"].alias("to")), "hooks")
    left = stars.select(F.col("a").alias("node"), F.col("b").alias("far"))
    left = spread_join(left, hooks, ["node"], ["to"]).select(F.col("to").alias("a"), F.col("far").alias("node"))
    left = spread_join(left, hooks, ["node"], ["to"]).select("a", F.col("to").alias("b")).filter("a <> b")
    inner, _ = _labels(left, bound, turn + 1)
    many = written(hooks.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("k")).join(inner, "node").select("node", "comp", "k"), "many")
    out = spread_join(hooks.select(F.col("node").alias("own"), F.col("to").alias("node")), many, ["node"], ["comp"])
    return written(out.select(F.col("own").alias("node"), F.coalesce("comp", "node").alias("comp")), "labels"), False


class Trie:
    """Sets in a common order as a path-compressed tree over their sorted sequences.

    Nodes are rows of arrays: sets lo to hi, depth above and below the path, sizes of the
    sets, children (a range of nodes) and the place of the path's tokens.
    """

    WIDTH = 64
    HELD = 1 << 24

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets)
        names, token, often = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, -often))] = np.arange(len(names))  # frequent first: long common prefixes
        token = rank[token]
        at, seqs = 0, []
        for s in sets:
            seqs.append(np.sort(token[at : at + len(s)]))
            at += len(s)
        self.vocabulary = len(names)
        self.order = np.array(sorted(range(len(sets)), key=lambda i: seqs[i].astype(">i8").tobytes()))
        self.seqs = [seqs[i] for i in self.order]
        self.size = np.array([len(s) for s in self.seqs])
        common = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.seqs[i - 1], self.seqs[i]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            common[i] = differ.argmax() if differ.any() else m
        self._grow(common)

    def _grow(self, common: np.ndarray) -> None:
        lo, hi, above, depth, child, last = [0], [len(self.seqs)], [0], [], [], []
        i = 0
        while i < len(lo):  # breadth first: the children of a node are a range
            x, y = lo[i], hi[i]
            child.append(len(lo))
            if y - x == 1:
                depth.append(len(self.seqs[x]))
            else:
                inner = common[x + 1 : y]
                depth.append(int(inner.min()))
                cuts = [x, *(np.flatnonzero(inner == depth[i]) + x + 1).tolist(), y]
                lo += cuts[:-1]
                hi += cuts[1:]
                above += [depth[i]] * (len(cuts) - 1)
            last.append(int(self.seqs[x][depth[i] - 1]) if depth[i] else -1)
            i += 1
        child.append(len(lo))
        self.lo, self.hi, self.depth, self.child, self.last = (np.array(x) for x in (lo, hi, depth, child, last))
        self.least = np.array([self.size[x:y].min() for x, y in zip(lo, hi, strict=True)])
        self.most = np.array([self.size[x:y].max() for x, y in zip(lo, hi, strict=True)])
        paths = [self.seqs[x][a:d] for x, a, d in zip(lo, above, depth, strict=True)]
        self.path_size = np.array([len(p) for p in paths])
        self.path_at = np.cumsum(self.path_size) - self.path_size
        self.paths = np.concatenate(paths)

    def components(self, percent: int, queries: np.ndarray | None = None) -> np.ndarray:
        """Component labels of the sets (in the order given), joining linked sets.

        With ``queries`` (a mask) only pairs with at least one query are looked at. The
        sets that ask walk the tree in groups, which grow as components settle.
        """
        comp, width, at = np.arange(len(self.seqs)), 1, 0
        asks = np.arange(len(comp)) if queries is None else np.flatnonzero(queries[self.order])
        while at < len(asks):
            block = asks[at : at + width]
            at += len(block)
            width = max(1, min(2 * width, self.WIDTH, self.HELD // self.vocabulary))
            q, leaf = self._walk(block, comp, percent, queries is None)
            if len(q):
                comp = _roots(len(comp), comp[q], comp[leaf])[comp]
        out = np.empty(len(comp), np.int64)
        out[self.order] = comp
        return out

    def _walk(self, block: np.ndarray, comp: np.ndarray, percent: int, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
        """Linked (query, set) pairs of a group of queries, level by level."""
        sizes = self.size[block]
        tokens = np.concatenate([self.seqs[i] for i in block])
        start = np.cumsum(sizes) - sizes
        held = np.zeros((len(block), self.vocabulary), bool)
        held[np.repeat(np.arange(len(block)), sizes), tokens] = True
        ordered = np.repeat(np.arange(len(block)), sizes) * self.vocabulary + tokens
        run = np.concatenate(([0], np.cumsum(comp[1:] != comp[:-1])))  # equal where all between are of one component
        q, node, overlap = np.arange(len(block)), np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        found_q, found = [], []
        while len(q):
            own = block[q]
            hi = np.minimum(self.hi[node], own) if ahead else self.hi[node]
            fit = self.lo[node] < hi
            fit &= 100 * np.minimum(sizes[q], self.most[node]) >= percent * np.maximum(sizes[q], self.least[node])
            fit &= (run[np.maximum(hi - 1, 0)] != run[self.lo[node]]) | (comp[self.lo[node]] != comp[own])
            q, node, overlap = q[fit], node[fit], overlap[fit]
            if not len(q):
                break
            count = self.path_size[node]
            row = np.repeat(np.arange(len(q)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.path_at[node], count)
            overlap = overlap + np.bincount(row[held[q[row], self.paths[place]]], minlength=len(q))
            used = np.searchsorted(ordered, q * self.vocabulary + self.last[node], "right") - start[q]
            rest = np.where(self.last[node] < 0, sizes[q], sizes[q] - used)
            best = overlap + np.minimum(rest, self.most[node] - self.depth[node])
            fit = (100 + percent) * best >= percent * (sizes[q] + self.least[node])  # 100 i >= percent (a + b - i)
            q, node, overlap = q[fit], node[fit], overlap[fit]
            leaf = self.hi[node] - self.lo[node] == 1
            linked = leaf & (self.lo[node] != block[q])
            found_q.append(block[q[linked]])
            found.append(self.lo[node[linked]])
            q, node, overlap = q[~leaf], node[~leaf], overlap[~leaf]
            count = self.child[node + 1] - self.child[node]
            row = np.repeat(np.arange(len(q)), count)
            node = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.child[node], count)
            q, overlap = q[row], overlap[row]
        return (np.concatenate(found_q), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _joined_units(percent: int):
    """Components of two sets and more, from rows of units sorted by unit, part and class: each
    set's class, the smallest class of its component, and the smallest rep there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            if len(sets) < 2:
                return None
            labels = Trie(sets).components(percent, None if all(asks) else np.array(asks))
            own, least, rep = np.array(classes), np.full(len(classes), 2**63 - 1), np.full(len(classes), 2**63 - 1)
            np.minimum.at(least, labels, own)
            np.minimum.at(rep, labels, np.array(reps))
            more = np.bincount(labels, minlength=len(own))[labels] > 1
            return pa.record_batch([own[more], least[labels][more], rep[labels][more]], names=["a", "b", "rep"])

        unit, sets, classes, reps, asks = None, [], [], [], []
        for batch in batches:
            for u, p, c, rep, ask, grams in zip(*(batch.column(k).to_pylist() for k in ("unit", "part", "class", "rep", "ask", "grams")), strict=True):
                if (u, p) != unit:
                    if (out := close()) is not None:
                        yield out
                    unit, sets, classes, reps, asks = (u, p), [], [], [], []
                if classes and classes[-1] == c:
                    asks[-1] |= ask
                    continue
                sets.append(np.frombuffer(grams, U))
                classes.append(c)
                reps.append(rep)
                asks.append(ask)
        if (out := close()) is not None:
            yield out

    return run


def _links(units: DataFrame, percent: int) -> DataFrame:
    dealt = units.repartition("unit", "part").sortWithinPartitions("unit", "part", "class")
    return dealt.mapInArrow(light(_joined_units(percent)), "a long, b long, rep long")


KEPT = ["class", "rep", "cluster", "m", "blocks"]


def _grams(n: int):
    """The sets of texts whose name is the one expected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for i, j, texts in _texts(batch, "text"):
                sets = shingler.sets(texts)
                rows = batch.slice(i, j - i)
                names, others = set_names(sets)
                fit = pa.array((names == rows.column("node").to_numpy()) & (others == rows.column("other").to_numpy()))
                yield pa.record_batch([*(rows.column(k) for k in KEPT), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*KEPT, "grams"]).filter(fit)

    return run


def _units(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The sets of the members' documents; few members are sent to the texts."""
    if members.count() <= SENT_ROWS:
        members = F.broadcast(members)
    texts = docs.withColumnRenamed("doc_id", "rep").join(members, "rep").select(*KEPT, "node", "other", "text")
    return texts.mapInArrow(light(_grams(n)), "class long, rep long, cluster long, m long, blocks long, grams binary")


def _sized(members: DataFrame, unit_sets: int, unit_grams: int) -> tuple[DataFrame, int]:
    """Members (cluster, n) with the sets and blocks of their clusters, and how many clusters are large."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    blocks = F.ceil(F.greatest(F.col("m") / unit_sets, F.col("all") / unit_grams)).cast("long")
    large = written(sizes.select("cluster", "m", blocks.alias("blocks")).filter("blocks > 1"), "large")
    some = large.count()  # at most a class in 1,000, or an n-gram in UNIT_GRAMS
    wide = F.broadcast(large) if some <= SENT_ROWS else large
    return members.join(wide, "cluster", "left").fillna(1, ["blocks"]), some


def _keys(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], list[int]]]:
    """Sets of about a megabyte, their n-grams' keys inside their clusters, and their classes."""
    for i, j in chunks([len(g) for g in batch.column("grams").to_pylist()], CHUNK_BYTES):
        part = batch.slice(i, j - i)
        sets = [np.frombuffer(g, U) for g in part.column("grams").to_pylist()]
        names = mixed(part.column("cluster").to_numpy().view(U))
        yield sets, [mixed(s ^ c) for s, c in zip(sets, names, strict=True)], part.column("class").to_pylist()


def _counted(bits: int):
    """This task's counters of the n-grams of clusters' sets, in PARTS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, keys, _ in _keys(batch):
                np.add.at(counts, (np.concatenate(keys) >> U(64 - bits)).astype(np.int64), np.uint32(1))
        if counts.any():
            yield pa.record_batch(_pieces(counts), names=["part", "counts"])

    return run


def _own_prefixes(bits: int, percent: int, extra: int, order):
    """(gram, salt, node, n) for the prefix of every set, by the order of its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets, keys, classes in _keys(batch):
                yield _entries(sets, keys, classes, order.value, bits, percent, extra, HOT_INSIDE)

    return run


def _split(large: DataFrame, percent: int, extra: int, edges: int) -> DataFrame:
    """(class, rep, cluster, n, grams): the candidate clusters inside large ones, by an order
    from counters of their sets alone; sets that share too little with any other go."""
    grams = large.agg(F.sum(F.octet_length("grams").cast("long"))).first()[0] // 8
    bits = int(np.clip(2 + np.ceil(np.log2(max(1, grams))), LEAST_BITS, MOST_BITS))
    sets = large.select("class", "cluster", "grams")
    order = large.sparkSession.sparkContext.broadcast(frequency_order(sets.mapInArrow(light(_counted(bits)), "part int, counts binary"), bits))
    found = _clustered(sets.mapInArrow(light(_own_prefixes(bits, percent, extra, order)), ENTRY), percent, extra, edges)
    found = found.select(F.col("node").alias("class"), F.col("comp").alias("cluster"))
    found = F.broadcast(found) if found.count() <= SENT_ROWS else found
    return large.select("class", "rep", "grams").join(found, "class").withColumn("n", (F.octet_length("grams") / 8).cast("long"))


def near_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, extra: int = 10, bits: int | None = None, unit_sets: int = UNIT_SETS, unit_grams: int = UNIT_GRAMS, pivots: int = PIVOTS, edges: int = EDGES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, group_id) of every row of ``docs``.

    Documents are linked if ``100 * |intersection| >= percent * |union|``; component_id is
    the smallest doc_id that links reach. group_id tells components apart
    whose smallest doc_id is the same because rows share an id (null for empty sets).
    ``keep`` names further columns of whole numbers that the result has too.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    if bits is None:
        bits = int(np.clip(16 + np.ceil(np.log2(max(1, plain.rdd.getNumPartitions()))), LEAST_BITS, MOST_BITS))
    as_bytes = plain.select("doc_id", F.col("text").cast("binary").alias("text"), *keep)
    profiles = written(as_bytes.mapInArrow(light(_profiles(n, bits, keep)), ", ".join([PROFILE, *(f"`{c}` long" for c in keep)])), "profiles")
    as_bytes = as_bytes.select("doc_id", "text")
    order = spark.sparkContext.broadcast(frequency_order(profiles, bits))  # 2**bits bytes, 4 MB at most
    rows = profiles.filter("part IS NULL").select("doc_id", "n", "node", "other", *keep)
    classes = rows.filter("n > 0").groupBy("node", "other").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("k"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    entries = as_bytes.select("text").mapInArrow(light(_prefixes(n, bits, percent, extra, order)), ENTRY)
    clusters = _clustered(entries, percent, extra, edges)

    members = written(clusters.withColumnRenamed("comp", "cluster").join(classes.filter("rep IS NOT NULL"), "node"), "members")
    members, left = _sized(members, unit_sets, unit_grams)
    small = _units(as_bytes, members.filter("blocks = 1"), n)
    if left:
        large = written(_units(as_bytes, members.filter("blocks > 1"), n), "sets")
        left = large.count()
    while left:  # sets in large clusters
        split, _ = _sized(_split(large, percent, extra, edges), unit_sets, unit_grams)
        split = written(split.select(*KEPT, "grams"), "split")
        small, large = small.unionByName(split.filter("blocks = 1")), split.filter("blocks > 1")
        before, left = left, large.count()
        if 10 * left > 9 * before:
            break
    small = small.select(F.col("cluster").alias("unit"), F.lit(0).cast("long").alias("part"), "class", "rep", F.lit(True).alias("ask"), "grams")
    joined = _links(small, percent).select(F.col("a").alias("class"), F.col("b").alias("group_id"), F.col("rep").alias("component_id"))  # a cluster in one unit: its components
    if left:
        links = _large_links(large, percent, unit_sets, pivots, edges)
        named = components(links, edges).select(F.col("node").alias("class"), F.col("comp").alias("group_id")).join(classes.select("class", "rep"), "class")
        least = written(named.groupBy("group_id").agg(F.min("rep").alias("component_id"), F.count("*").alias("k")), "least")
        joined = joined.unionByName(spread_join(named.drop("rep"), least, ["group_id"], ["component_id"]))

    known = classes.join(joined, "class", "left")
    known = written(known.select("node", "other", "k", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("group_id", "class").alias("group_id")), "known")
    out = spread_join(rows.filter("n > 0"), known, ["node", "other"], ["component_id", "group_id"])
    names = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "group_id", *keep]
    empty = rows.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "group_id": F.lit(None).cast("long")})
    return out.select(*names).unionByName(empty.select(*names))


def _large_links(large: DataFrame, percent: int, unit_sets: int, pivots: int, edges: int) -> DataFrame:
    """Links of clusters of several blocks: against pivots, then what is left, in blocks."""
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    every = large.select(F.col("cluster").alias("unit"), "blocks", block.alias("part"), "class", "rep", "grams")
    # Pivots: the smallest names by hash, found by a bounded aggregate on each cluster.
    chosen = large.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("class", F.lit(7)), F.greatest(F.col("m") / (4 * pivots), F.lit(1)).cast("long")) == 0, F.col("class")))), 1, pivots).alias("pivots"))
    pivot = every.join(F.broadcast(chosen.select(F.explode("pivots").alias("class"))) if large.count() <= SENT_ROWS else chosen.select(F.explode("pivots").alias("class")), "class")
    spread = pivot.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first = every.unionByName(spread.select(every.columns)).select("unit", "part", "class", "rep", F.lit(True).alias("ask"), "grams")
    links = written(_links(first, percent).select("a", "b").filter("a <> b"), "links")

    # Queries are the sets outside their cluster's largest component, in blocks; each block
    # meets every block of its cluster.
    comp = components(links, edges).withColumnRenamed("node", "class")
    labelled = every.join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    count = labelled.groupBy("unit", "comp").agg(F.count("*").alias("k"))
    main = count.groupBy("unit").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("total"), F.max("k").alias("most"))
    main = main.filter("total > most").withColumn("ways", F.ceil((F.col("total") - F.col("most")) / unit_sets))
    left = written(labelled.join(main, "unit"), "left")
    way = F.pmod(F.xxhash64("class", F.lit(11)), F.col("ways"))
    number = (F.col("way") * F.col("blocks") + F.col("part")).alias("part")
    asks = left.filter("comp <> main").withColumn("way", way).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rest = left.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    units = asks.select("unit", number, "class", "rep", F.lit(True).alias("ask"), "grams").unionByName(rest.select("unit", number, "class", "rep", F.lit(False).alias("ask"), "grams"))
    return links.unionByName(written(_links(units, percent).select("a", "b").filter("a <> b"), "links"))
