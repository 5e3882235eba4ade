"""N-gram Jaccard join: sets of word shingles that overlap by a threshold, and the components they form.

Documents with the same set become one node. Shingles have one order for all: those that a single document holds, then
those of several, then those of very many, each by their hash. Of n shingles, two sets of similarity t share one of the
first n - ceil(t * n) + 1; these make the tiles. A tile holds the nodes that have a shingle among their first ones, cut
into bands of like size and these into pieces of bounded size; a piece meets the pieces of its own band and of those whose
sizes leave room. Pairs of pieces with one least component mostly hold the same nodes: they are dealt together, so that
a task gets the bitmap of a node once, however many tiles it is in. Within a pair of pieces hashed bitmaps of some bits per shingle are compared: the bits in which
two bitmaps differ bound the overlap from above, and most pairs end there. Pairs that pass are settled by intersecting
the sorted arrays of both, of 128 bits a shingle. No link is missed: order, bands and bitmaps only leave out what cannot
be one.

What is sought are components, so pairs that are already connected need no test. To begin with, every node is compared
with one other, which leads most of the groups that share a minimum of hashed shingles with it; this settles groups of
thousands of copies at a cost linear in their size. Tiles whose nodes are all connected then need no look.

How many documents hold a shingle is counted over all of them: hashes are packed by bucket, combined per batch, and
counted per bucket. Two filters of bounded size, for shingles of several documents and for those of very many, give the
order. Over more shingles than they suit, more of them count as frequent: tiles grow, the result is the same.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, join_dealt, join_groups, lean, share, stored, text_batches, text_parts
from .components import components, merged
from .words import both_hashes, bucket_of, filter_of, in_filter, mix, spread, window_hashes, word_hashes

#: Words of a shingle, similarity in percent, minima that find a leader.
WORDS, PERCENT, KEYS = 5, 75, 6
#: Nodes and shingles of a piece of a tile, and nodes of it that are compared at once; the ratio of sizes within a band.
TILE, TILE_SHINGLES, ROWS, BAND = 1024, 1 << 20, 256, 1.1
#: Rows of the pairs of pieces that are dealt together, about.
DEALT = 2 * TILE
#: Bits of a bitmap per shingle at least; bytes of bitmaps or arrays that one task takes at a time, about.
SPARE, PART_BYTES = 4, 24_000_000
#: Documents per bucket of shingles; bits of a filter per bucket and in all (both are sent to every executor).
DOCS_PER_BUCKET, BUCKET_BITS, MAX_BITS = 2000, 1 << 19, 1 << 28
#: A shingle of more documents than this is common; beyond 2**24 times so many shingles, of more.
COMMON = 64
_ODD = np.random.default_rng(5).integers(1, 1 << 62, KEYS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = np.random.default_rng(6).integers(1, 1 << 62, KEYS, dtype=np.int64).astype(np.uint64)


def shingles(text: str | None, n: int = WORDS, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes each of the distinct n-word shingles of a text, sorted, A-Z in lower case; of fewer words, one for all of them."""
    a, b = both_hashes((text or "").encode(), lower=True)
    if not len(a):
        return a, b
    x, y = (window_hashes(h, min(n, len(a)), k) for k, h in enumerate((a, b)))
    x = x & np.uint64((1 << hash_bits) - 1)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    keep = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    return x[keep], y[keep]


def bitmap(s: np.ndarray) -> bytes:
    """SPARE to 2 * SPARE bits per shingle, a power of two of them; a larger bitmap folds to a smaller one by halves."""
    bits = max(64, SPARE << int(len(s) - 1).bit_length())
    at = ((s >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(bits, bool)
    out[at] = True
    return np.packbits(out, bitorder="little").tobytes()


def _fold(m: np.ndarray, size: int) -> np.ndarray:
    while m.shape[-1] > size:
        half = m.shape[-1] // 2
        m = m[..., :half] | m[..., half:]
    return m


def similar(inter, a, b, percent: int = PERCENT):
    return 100 * inter >= percent * (a + b - inter)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many rows two sorted arrays of shape (2, n) share."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    if not a.shape[1]:
        return 0
    x, y = b[0], a[0]
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    if (x[1:] == x[:-1]).any() or (y[1:] == y[:-1]).any():  # one first hash with several second ones
        return len(set(zip(*a.tolist(), strict=True)) & set(zip(*b.tolist(), strict=True)))
    return int(((x[at] == y) & (b[1][at] == a[1])).sum())


def packed(x: np.ndarray, y: np.ndarray) -> bytes:
    return x.tobytes() + y.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64).reshape(2, -1)


def _emit_counts(n: int, buckets: int, hash_bits: int):
    """Rows (bucket, rest, many): 32-bit values of the shingles of a batch of documents, and (value, more) of those in several."""

    def run(batches):
        for part in text_parts(batches):
            hashes = [np.unique(window_hashes(w, min(n, len(w))) & np.uint64((1 << hash_bits) - 1)) for _, t in part if len(w := word_hashes(t, lower=True))]
            if not hashes:
                continue
            h, count = np.unique(np.concatenate(hashes), return_counts=True)
            bucket, rest = bucket_of(h, buckets)
            several = np.flatnonzero(count > 1)
            order, runs = spread(bucket)
            more, more_runs = spread(bucket[several])
            pairs = np.stack([rest[several], (count[several] - 1).astype(np.uint32)], axis=1)[more]
            out = [(b, rest[order[lo:hi]].tobytes(), b"") for b, lo, hi in runs] + [(b, b"", pairs[lo:hi].tobytes()) for b, lo, hi in more_runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[k] for r in out], pa.binary()) for k in (1, 2)]], ["bucket", "rest", "many"])

    return run


def _count(bits: int, limit: int):
    """Per bucket: the filters of shingles in several documents and of those in more than `limit`."""

    def run(key, t):
        rest, n = np.unique(np.frombuffer(b"".join(t.column("rest").to_pylist()), np.uint32), return_counts=True)
        pairs = np.frombuffer(b"".join(t.column("many").to_pylist()), np.uint32).reshape(-1, 2)
        n = n + np.bincount(np.searchsorted(rest, pairs[:, 0]), pairs[:, 1], len(rest)).astype(np.int64)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "several": pa.array([filter_of(rest[n > 1], bits)], pa.binary()), "common": pa.array([filter_of(rest[n > limit], bits)], pa.binary())})

    return run


def _sketch(percent: int, n: int, buckets: int, bits: int, shared, hash_bits: int):
    def first_ones(x: np.ndarray, fields) -> np.ndarray:
        """Those of a set's first shingles, in the order of all, that other documents hold."""
        many = len(x) - -(-percent * len(x) // 100) + 1
        bucket, rest = bucket_of(x, buckets)
        rank = in_filter(fields[0], bucket, rest, bits).astype(np.int64)
        at = np.flatnonzero(rank)
        rank[at] += in_filter(fields[1], bucket[at], rest[at], bits)
        chosen = np.argsort(rank, kind="stable")[:many]
        return np.unique(x[chosen[rank[chosen] > 0]].view(np.int64))

    def run(batches):
        fields = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [shingles(t.as_py(), n, hash_bits) for t in part.column(1)]
                sizes = np.array([len(x) for x, _ in sets], np.int64)
                full = np.flatnonzero(sizes)
                mins = np.zeros((len(sets), KEYS), np.int64)
                if len(full):
                    flat = np.concatenate([sets[i][0] for i in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for k in range(KEYS):
                        mins[full, k] = np.minimum.reduceat(mix((flat ^ _FLIP[k]) * _ODD[k]), starts).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes),
                        pa.array([hashlib.blake2b(packed(x, y), digest_size=16).digest() for x, y in sets], pa.binary()),
                        pa.array([bitmap(x) if len(x) else b"" for x, _ in sets], pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(mins.ravel()), KEYS).cast(pa.list_(pa.int64())),
                        pa.array([first_ones(x, fields) if len(x) else [] for x, _ in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "n", "same", "map", "mins", "first"],
                )

    return run


def _arrays(n: int, hash_bits: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed(*shingles(t.as_py(), n, hash_bits)) for t in part.column(1)], pa.binary())], ["id", "set"])

    return run


def _intersect(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                keep.append(bool(similar(overlap(x, y), x.shape[1], y.shape[1], percent)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep)], ["a", "b", "ok"])

    return run


def _bounded(percent: int):
    """Rows (a, b, na, nb, ma, mb): whether the bitmaps leave room for the overlap that is asked for."""

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, ma, mb in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                na, nb = na.as_py(), nb.as_py()
                x, y = np.frombuffer(ma.as_buffer(), np.uint8), np.frombuffer(mb.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                keep.append(bool(similar((na + nb - apart) // 2, na, nb, percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep)], ["a", "b", "ok"])

    return run


def _compare(comps: np.ndarray, sizes: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray, percent: int):
    """Pairs (i, j, bits apart) of left x right, of different components, whose sizes and bitmaps leave room.

    Both sides are taken in the order of size, so that a few rows meet only the stretch of the other side whose sizes
    suit. Their bitmaps are compared twice: folded to about a bit per shingle, and those that pass in full.
    """
    out = []
    left, right = left[np.argsort(sizes[left], kind="stable")], right[np.argsort(sizes[right], kind="stable")]
    known = sizes[right]
    for lo in range(0, len(left), ROWS):
        xs = left[lo : lo + ROWS]
        first = np.searchsorted(known, -(-percent * sizes[xs[0]] // 100))
        last = np.searchsorted(known, 100 * sizes[xs[-1]] // percent, side="right")
        ys = right[first:last]
        if not len(ys):
            continue
        nx, ny = sizes[xs][:, None], sizes[ys][None, :]
        i, j = np.nonzero((100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (comps[xs][:, None] != comps[ys][None, :]))
        full = min(len(maps[k]) for k in (xs[0], ys[0]))
        for size in (max(8, full // SPARE), full):
            if not len(i):
                break
            mx, my = (np.stack([_fold(np.frombuffer(maps[k], np.uint8), size) for k in s]).view(np.uint64) for s in (xs, ys))
            keep, apart = [], []
            step = max(1024, (1 << 22) // size)
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                d = np.bitwise_count(mx[p] ^ my[q]).sum(1, dtype=np.int64)
                n, m = sizes[xs[p]], sizes[ys[q]]
                keep.append(similar((n + m - d) // 2, n, m, percent))
                apart.append(d)
            good = np.concatenate(keep)
            i, j, d = i[good], j[good], np.concatenate(apart)[good]
        if len(i):
            out.append((xs[i], ys[j], d))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def _by_tile(t: pa.Table):
    """For each pair of pieces, the table's rows of its left and of its right side (both all rows of a piece that meets itself)."""
    tile, side = t.column("tile").to_numpy(), t.column("side").to_numpy()
    order = np.lexsort((side, tile))
    starts = np.r_[np.flatnonzero(np.r_[True, tile[order][1:] != tile[order][:-1]]), len(tile)] if len(tile) else np.zeros(1, np.int64)
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        here, two = order[lo:hi], side[order[lo:hi]] == 2
        yield (here[~two], here[two]) if two.any() else (here, here)


def _places(t: pa.Table, nodes: pa.Table) -> list[int]:
    """For each row of t, the row of `nodes` that its node has."""
    ids = nodes.column("id").to_numpy()
    order = np.argsort(ids)
    return order[np.searchsorted(ids[order], t.column("node").to_numpy())].tolist()


def _of_rows(t: pa.Table, nodes: pa.Table, column: str) -> list:
    """A column of `nodes` for each row of t; rows of one node share the value."""
    known = nodes.column(column).to_pylist()
    return [known[k] for k in _places(t, nodes)]


def _candidates(percent: int):
    """Rows of pairs of pieces, and the bitmaps of their nodes: those rows that are in a pair whose bitmaps leave room.

    A pair counts in the first tile only that it shares: that of the least of its common first shingles.
    """

    def run(t: pa.Table, nodes: pa.Table) -> pa.Table:
        comps, sizes, keys = (t.column(c).to_numpy() for c in ("comp", "n", "key"))
        maps, firsts = _of_rows(t, nodes, "map"), _of_rows(t, nodes, "first")
        wanted = np.zeros(t.num_rows, bool)
        for left, right in _by_tile(t):
            i, j, _ = _compare(comps, sizes, maps, left, right, percent)
            key = keys[left[0]] if len(left) else 0
            before = {k: {x for x in firsts[k] if x < key} for k in {*i.tolist(), *j.tolist()}}
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if not (wanted[p] and wanted[q]) and before[p].isdisjoint(before[q]):
                    wanted[p] = wanted[q] = True
        return t.select(["tile", "side", "node", "comp", "n", "deal"]).filter(pa.array(wanted))

    return run


def _linked(percent: int):
    """Rows of pairs of pieces, and the sorted arrays of their nodes: links enough to connect whatever of them is connected.

    Likely pairs come first; a pair whose components have met by then is not intersected.
    """

    def run(t: pa.Table, arrays: pa.Table) -> pa.Table:
        nodes, comps = t.column("node").to_numpy(), t.column("comp").to_numpy()
        known = [unpacked(x) for x in arrays.column("set").to_pylist()]
        at = _places(t, arrays)
        sets = [known[k] for k in at]
        sizes = np.array([x.shape[1] for x in sets], np.int64)
        drawn = [bitmap(x[0]) for x in known]
        maps = [drawn[k] for k in at]
        found = []
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        for left, right in _by_tile(t):
            i, j, apart = _compare(comps, sizes, maps, left, right, percent)
            for k in np.argsort(apart, kind="stable").tolist():
                p, q = int(i[k]), int(j[k])
                a, b = root(int(comps[p])), root(int(comps[q]))
                if a != b and similar(overlap(sets[p], sets[q]), sizes[p], sizes[q], percent):
                    parent[b] = a
                    found.append((nodes[p], nodes[q]))
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    return run


class JaccardJoin:
    """The join of one table. `sets`: a row per document; `nodes`: a row per distinct set.

    hash_bits: of the first hash of a shingle, which proposes; whatever it is, the second one settles. Fewer make more work.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, hash_bits: int = 64):
        if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
            raise ValueError("ids must be integers")
        text_batches(docs.sparkSession)
        self.words, self.percent, self.hash_bits = words, percent, hash_bits
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        buckets, bits, shared = self._filters()
        sets = self.docs.mapInArrow(lean(_sketch(percent, words, buckets, bits, shared, hash_bits)), "id long, n long, same binary, map binary, mins array<long>, first array<long>")
        sets = stored(sets, "sets")
        self.sets = sets.select("id", "n", "same")
        full = sets.where("n > 0 and id is not null")
        self.same = full.groupBy("same").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
        nodes = full.groupBy("same").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("n", "map", "mins", "first")])
        self.nodes = stored(nodes.drop("same"), "nodes")
        self.n_nodes = self.nodes.count()

    def _filters(self):
        """Buckets, bits per bucket, and the filters of shingles that several and that very many documents hold."""
        got = self.docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        buckets = max(16, got[0] // DOCS_PER_BUCKET)
        bits = min(BUCKET_BITS, 1 << max(8, (MAX_BITS // buckets).bit_length() - 1))
        limit = max(COMMON, (got[1] or 0) // 6 >> 24)  # of some six bytes to a word
        emitted = self.docs.mapInArrow(lean(_emit_counts(self.words, buckets, self.hash_bits)), "bucket int, rest binary, many binary")
        counted = emitted.groupBy("bucket").applyInArrow(_count(bits, limit), "bucket int, several binary, common binary")
        fields = np.zeros((2, buckets, bits // 8), np.uint8)
        for r in counted.toLocalIterator():  # at most 2 * MAX_BITS / 8 bytes in all
            for k in (0, 1):
                fields[k, r["bucket"]] = np.frombuffer(bytes(r[k + 1]), np.uint8)
        return buckets, bits, share(self.docs.sparkSession, fields)

    def _passing(self, pairs: DataFrame) -> DataFrame:
        """Stored pairs (a, b), each b once, whose bitmaps leave room."""
        of = lambda c, n, m: self.nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("map").alias(m))
        rows = join_dealt(pairs, of("a", "na", "ma"), "a", "b", self.n_nodes).join(of("b", "nb", "mb"), "b").select("a", "b", "na", "nb", "ma", "mb")
        return rows.mapInArrow(lean(_bounded(self.percent)), "a long, b long, ok boolean").where("ok").drop("ok")

    def arrays(self, ids: DataFrame) -> DataFrame:
        """id, set: the sorted arrays of the nodes in ids(id), hashed anew from their texts.

        A Bloom filter finds the texts, so that neither all arrays are stored nor all texts shuffled; a few other nodes
        may come along.
        """
        found = Bloom(ids, "id", ids.count()).mark(self.docs.where("id is not null"), "id", "hit").where("hit").drop("hit")
        return found.mapInArrow(lean(_arrays(self.words, self.hash_bits)), "id long, set binary").dropDuplicates(["id"])

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets overlap enough, by intersecting their sorted arrays."""
        pairs = stored(pairs.select("a", "b"), "pairs")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        arrays = self.arrays(ids)
        both = join_dealt(pairs, arrays.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a", "b", pairs.count())
        both = both.join(arrays.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        checked = both.select("a", "b", "sa", "sb").mapInArrow(lean(_intersect(self.percent)), "a long, b long, ok boolean")
        return stored(checked.where("ok").drop("ok"), "links")

    def _led(self) -> DataFrame:
        """Pairs (a, b): for each node b the node that leads most of the groups that share a minimum with it."""
        keys = self.nodes.select("node", F.posexplode("mins").alias("k", "m")).select("node", F.xxhash64("k", "m").alias("key"))
        groups = stored(keys.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1"), "groups")
        shared = stored(join_groups(keys, groups, "key", F.col("mates"), self.n_nodes), "shared")
        # a group is led by the node with the most mates over all its groups: the one from which the others were made
        weight = shared.groupBy("node").agg(F.sum(F.log("mates")).alias("weight"))
        lead = shared.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("lead"), F.count("*").alias("mates"))
        led = join_groups(shared.drop("mates"), stored(lead, "leads"), "key", F.col("mates"), self.n_nodes).where("node <> lead")
        mates = led.groupBy("node", "lead").agg(F.count("*").alias("groups"))
        return mates.groupBy(F.col("node").alias("b")).agg(F.max_by("lead", F.struct("groups", -F.col("lead"))).alias("a"))

    def _pieces(self, labels: DataFrame | None) -> DataFrame:
        """key, band, piece, node, comp, n: the nodes of the tiles that hold several components."""
        nodes = self.nodes.where(F.size("first") > 0).select("node", "n", "first")
        if labels is None:
            nodes = nodes.withColumn("comp", F.col("node"))
        else:
            nodes = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        rows = nodes.select("node", "comp", "n", F.explode("first").alias("key"))
        several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("mates")).where("low < high").select("key", "mates")
        rows = join_groups(rows, stored(several, "tiles"), "key", F.col("mates"), self.n_nodes).drop("mates")
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")
        rows = stored(rows.withColumn("band", band).withColumn("cell", F.xxhash64("key", "band")), "tile_rows")
        cells = rows.groupBy("cell").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"))
        cells = cells.select("cell", "many", F.greatest(F.ceil(F.col("many") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).alias("cuts"))
        cut = join_groups(rows, stored(cells, "cells"), "cell", F.col("many"), self.n_nodes)
        return stored(cut.select("key", "band", F.pmod(F.xxhash64("comp", F.when(F.col("cuts") > 1, F.col("node"))), F.col("cuts")).alias("piece"), "node", "comp", "n"), "pieces")

    def _met(self, rows: DataFrame) -> DataFrame:
        """Rows of pieces for each pair of pieces that may hold a link: tile (the pair's), side, key, node, comp, n, deal.

        Pairs with one least component have one deal, or several, each of about DEALT rows.
        """
        pieces = rows.groupBy("key", "band", "piece").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.count("*").alias("many"))
        pieces = stored(pieces, "piece_sizes")
        reach = math.ceil(math.log(100 / self.percent) / math.log(BAND)) + 1 if self.percent else 0
        near = pieces.withColumn("own", F.col("band")).withColumn("band", F.explode(F.sequence(F.col("band"), F.col("band") + reach)))
        others = pieces.select("key", "band", *[F.col(c).alias(f"{c}_") for c in ("band", "piece", "c0", "c1", "n0", "n1", "many")])
        room = (100 * F.col("n1") >= self.percent * F.col("n0_")) & (100 * F.col("n1_") >= self.percent * F.col("n0"))
        one = (F.col("c0") == F.col("c1")) & (F.col("c0_") == F.col("c1_")) & (F.col("c0") == F.col("c0_"))
        before = (F.col("own") < F.col("band_")) | (F.col("piece") <= F.col("piece_"))
        met = near.join(others, ["key", "band"]).where(before & ~one & room)
        met = met.withColumn("same", (F.col("own") == F.col("band_")) & (F.col("piece") == F.col("piece_")))
        met = met.withColumn("tile", F.xxhash64("key", "own", "piece", "band_", "piece_"))
        met = met.withColumn("low", F.least("c0", "c0_")).withColumn("many", F.col("many") + F.when(F.col("same"), 0).otherwise(F.col("many_")))
        met = stored(met.select("key", "own", "piece", "band_", "piece_", "same", "tile", "low", "many"), "meetings")
        lows = met.groupBy("low").agg(F.count("*").alias("meetings"), F.ceil(F.sum("many") / DEALT).alias("cuts"))
        met = join_groups(met, stored(lows, "lows"), "low", F.col("meetings"), met.count()).withColumn("deal", F.xxhash64("low", F.pmod("tile", "cuts")))
        first = met.select("key", F.col("own").alias("band"), "piece", "tile", "deal", F.lit(1).alias("side"))
        second = met.where(~F.col("same")).select("key", F.col("band_").alias("band"), F.col("piece_").alias("piece"), "tile", "deal", F.lit(2).alias("side"))
        return stored(rows.join(first.unionByName(second), ["key", "band", "piece"]).select("tile", "side", "key", "node", "comp", "n", "deal"), "met")

    def _tile_links(self, labels: DataFrame | None) -> DataFrame:
        """Links between nodes of different components that share a tile."""
        met = self._met(self._pieces(labels))

        def by_part(df: DataFrame, each: int):
            """df by part, and once for each part the nodes that it has there; parts for `each` bytes a shingle of every row."""
            parts = max(8, int((df.agg(F.sum("n")).first()[0] or 0) * each // PART_BYTES))
            dealt = df.withColumn("part", F.pmod("deal", F.lit(parts)))
            return dealt.groupBy("part"), dealt.select(F.col("part").alias("at"), F.col("node").alias("id")).distinct()

        rows, there = by_part(met, 4)
        maps = there.join(self.nodes.select(F.col("node").alias("id"), "map", "first"), "id").groupBy("at")
        near = stored(rows.cogroup(maps).applyInArrow(lean(_candidates(self.percent)), "tile long, side int, node long, comp long, n long, deal long"), "candidates")
        arrays = self.arrays(near.select(F.col("node").alias("id")).distinct())
        rows, there = by_part(near, 16)
        sets = there.join(arrays, "id").groupBy("at")
        return stored(rows.cogroup(sets).applyInArrow(lean(_linked(self.percent)), "a long, b long").distinct(), "links")

    def links(self) -> tuple[DataFrame, DataFrame | None]:
        """Verified pairs of nodes (a, b), enough to connect whatever is connected, and the labels (node, label)."""
        links = self.verified(self._passing(stored(self._led(), "led")))
        labels = components(links) if links.limit(1).count() else None
        more = self._tile_links(labels)
        if more.limit(1).count():
            links = links.unionByName(more).distinct()
            labels = merged(labels, more)
        return links, labels

    def documents(self) -> DataFrame:
        """id, n_shingles, component_id for every document."""
        _, labels = self.links()
        if labels is None:
            labels = self.nodes.select("node", F.col("node").alias("label")).limit(0)
        same = self.same.join(labels, "node", "left").select("same", "copies", F.coalesce("label", "node").alias("component_id"))
        known = self.sets.where("n > 0 and id is not null")
        found = join_groups(known, stored(same, "same"), "same", F.col("copies"), self.n_nodes).select("id", F.col("n").alias("n_shingles"), "component_id")
        alone = self.sets.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
        return found.unionByName(alone)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Null and empty texts, and texts without words, have no shingles and are components of their own. Rows without an id
    take no part and have a null component. Rows repeated with one id are copies of each other. Whole texts count; other
    columns are ignored; an empty table gives an empty result. percent: at least 1.
    """
    return JaccardJoin(docs, id_col, text_col, words, percent).documents().withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all columns, without those that a component's row of smallest id stands for.

    Rows without an id and texts without words stay, as do rows repeated with the id that stays. Whole texts count;
    columns may have any names; an empty table gives an empty result.
    """
    from .common import Scope, without_ids

    with Scope() as made:
        linked = jaccard_components(docs, id_col, text_col, words, percent).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast(docs.schema[id_col].dataType))
    found = stored(linked, "dropped")
    made.release()  # the ids are written: nothing reads the tables of the join any more
    return without_ids(docs, id_col, found, found.count())
