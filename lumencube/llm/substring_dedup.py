"""Substring dedup over a De Bruijn graph of words.

The edges of the graph are the windows of LENGTH consecutive words. An edge that several documents hold has a source
coordinate: document and position where it starts first. Consecutive edges of a document whose source coordinates are
consecutive as well form a nonbranching path; paths are compacted, first within the runs that share a minimizer, then
across runs by a window over the document. Every path is verified against the words at its source coordinates and then
joined back to its document, where the words that it covers are removed.

Edges are not shuffled one by one. A window belongs to the smallest hash of its shorter word runs (its minimizer), and so
equal windows have equal minimizers. A first pass finds minimizers that occur in two documents, 4 bytes each, and puts
them into a Bloom filter of bounded size. The second pass shuffles only the windows of those, dealt by minimizer, so that
a run of windows stays together; of equal windows in one batch of documents only the first moves, as the others are
resolved where they are. Windows are told apart by two independent 64-bit hashes. A passage in very many documents thus costs a reducer one row per batch. A short line between
many different neighbours makes many windows with one minimizer: the first pass counts them, and windows of a minimizer
with more than HOT_WINDOWS are dealt by their own hash, so that equal ones still meet but no reducer has them all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Bloom, lean, share, stored, text_batches, text_parts
from .words import both_hashes, bucket_of, filter_of, in_filter, spread, window_hashes, word_hashes

LENGTH, SHORT = 13, 7
#: Documents per bucket of minimizers; bits of the filter per bucket and in all (it is sent to every executor).
DOCS_PER_BUCKET, BUCKET_BITS, MAX_BITS = 2000, 1 << 18, 1 << 29
#: Bytes of text that are resolved together before anything moves.
BATCH_BYTES = 6_000_000
#: Windows of one minimizer beyond which they are dealt one by one; windows in a batch from which on they are counted singly.
HOT_WINDOWS, COUNTED = 1 << 16, 8
PATH = "doc long, start long, n long, source long, at long"


def _minimizers(words: np.ndarray, length: int, short: int) -> np.ndarray:
    """For each window of `length` words, the smallest hash of its runs of `short` words."""
    h = window_hashes(words, short)
    n = len(words) - length + 1
    out = h[:n].copy()
    for k in range(1, length - short + 1):
        np.minimum(out, h[k : k + n], out=out)
    return out


def _hot_keys(bucket, rest: np.ndarray) -> np.ndarray:
    return np.asarray(bucket, np.uint64) << np.uint64(32) | rest.astype(np.uint64)


def _emit_minimizers(length: int, short: int, buckets: int):
    def run(batches):
        for part in text_parts(batches, BATCH_BYTES):
            found = [np.unique(_minimizers(w, length, short), return_counts=True) for _, t in part if len(w := word_hashes(t)) >= length]
            if not found:
                continue
            m, owner, n = np.unique(np.concatenate([u for u, _ in found]), return_inverse=True, return_counts=True)
            sizes = np.bincount(owner, np.concatenate([k for _, k in found])).astype(np.int64)
            once = np.minimum(n, 2)
            bucket, rest = bucket_of(m, buckets)
            many = np.flatnonzero(sizes >= COUNTED)
            more, more_runs = spread(bucket[many])
            pairs = np.stack([rest[many], np.minimum(sizes - once, (1 << 32) - 1)[many].astype(np.uint32)], axis=1)[more]
            bucket, rest = np.repeat(bucket, once), np.repeat(rest, once)
            order, runs = spread(bucket)
            out = [(b, rest[order[lo:hi]].tobytes(), b"") for b, lo, hi in runs] + [(b, b"", pairs[lo:hi].tobytes()) for b, lo, hi in more_runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[k] for r in out], pa.binary()) for k in (1, 2)]], ["bucket", "rest", "many"])

    return run


def _repeated(bits: int, limit: int):
    """Per bucket: the filter's bits of minimizers in two documents, and those (hot) with more than `limit` windows."""

    def run(key, t):
        rest, n = np.unique(np.frombuffer(b"".join(t.column("rest").to_pylist()), np.uint32), return_counts=True)
        pairs = np.frombuffer(b"".join(t.column("many").to_pylist()), np.uint32).reshape(-1, 2)
        total = n + np.bincount(np.searchsorted(rest, pairs[:, 0]), pairs[:, 1], len(rest)).astype(np.int64)
        hot = rest[(n > 1) & (total > limit)].tobytes()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([filter_of(rest[n > 1], bits)], pa.binary()), "hot": pa.array([hot], pa.binary())})

    return run


def _chains(doc, start, source, at):
    """Compact rows in the order of (doc, start): maximal runs with consecutive positions and source positions."""
    if not len(doc):
        return doc, start, start, source, at
    cut = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(cut)
    return doc[first], start[first], np.diff(np.r_[first, len(doc)]), source[first], at[first]


def _windows(first: np.ndarray, second: np.ndarray, length: int, hash_bits: int):
    """Both hashes of every window, from both hashes of the words."""
    return window_hashes(first, length) & np.uint64((1 << hash_bits) - 1), window_hashes(second, length, 1)


def _first_of(h, g, *then):
    """For each row, the row that comes first in the order of `then` among those with the same two hashes."""
    order = np.lexsort((*then[::-1], g, h))
    x, y = h[order], g[order]
    first = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    at = np.empty(len(h), np.int64)
    at[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    return at


def _resolve(h, g, doc, start):
    """Of windows (two hashes, document, position): for each, its source, the least (document, position) of its hashes."""
    at = _first_of(h, g, doc, start)
    return doc[at], start[at]


def _emit_windows(length: int, short: int, buckets: int, bits: int, shared, hash_bits: int = 64):
    def run(batches):
        field, hot = shared.value
        for part in text_parts(batches, BATCH_BYTES):
            hs, gs, ds, ps, bs = [], [], [], [], []
            for i, t in part:
                w = word_hashes(t)
                if i is None or len(w) < length:
                    continue
                m = _minimizers(w, length, short)
                new = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
                bucket, rest = bucket_of(m[new], buckets)
                known = in_filter(field, bucket, rest, bits)
                sizes = np.diff(np.r_[new, len(m)])
                at = np.flatnonzero(np.repeat(known, sizes))
                if not len(at):
                    continue
                h, g = (x[at] for x in _windows(w, word_hashes(t, which=1), length, hash_bits))
                once = np.unique(_first_of(h, g, at))  # windows that a document repeats count once
                hs.append(h[once])
                gs.append(g[once])
                ps.append(at[once])
                ds.append(np.full(len(once), i, np.int64))
                dealt = np.repeat(bucket, sizes)[at[once]]
                if len(hot):
                    apart = np.repeat(np.isin(_hot_keys(bucket, rest), hot), sizes)[at[once]]
                    dealt[apart] = bucket_of(h[once][apart], buckets)[0]
                bs.append(dealt)
            if not hs:
                continue
            h, g, doc, start, bucket = (np.concatenate(x) for x in (hs, gs, ds, ps, bs))
            source, at = _resolve(h, g, doc, start)
            here = source != doc  # a smaller document of this batch has it
            paths = _chains(doc[here], start[here], source[here], at[here])
            h, g, doc, start, bucket = (x[~here] for x in (h, g, doc, start, bucket))
            order, runs = spread(bucket)
            out = [(b, h[o].tobytes(), g[o].tobytes(), doc[o].tobytes(), start[o].astype(np.int32).tobytes(), b"") for b, lo, hi in runs for o in (order[lo:hi],)]
            if len(paths[0]):
                out.append((int(paths[0][0] % buckets), b"", b"", b"", b"", np.stack(paths).astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[k] for r in out], pa.binary()) for k in range(1, 6)]], ["bucket", "hash", "other", "doc", "start", "paths"])

    return run


def _paths(t: pa.Table) -> pa.Table:
    get = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    h, g, doc, start = get("hash", np.uint64), get("other", np.uint64), get("doc", np.int64), get("start", np.int32).astype(np.int64)
    found = [np.frombuffer(p, np.int64).reshape(5, -1) for p in t.column("paths").to_pylist() if p]
    if len(h):
        source, at = _resolve(h, g, doc, start)
        rows = np.flatnonzero(source != doc)
        rows = rows[np.lexsort((start[rows], doc[rows]))]
        found.append(np.stack(_chains(doc[rows], start[rows], source[rows], at[rows])).astype(np.int64))
    every = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    return pa.table(dict(zip(("doc", "start", "n", "source", "at"), every, strict=True)))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_digests(length: int):
    """Rows (id, text, spans of (at, n windows)): the digest of the words of each span."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                out = []
                for i, t, spans in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    words = (t.as_py() or "").encode().split()
                    out += [(i, s["at"], s["n"], _digest(words[s["at"] : s["at"] + s["n"] + length - 1])) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["source", "at", "n", "digest"])

    return run


def _remove(length: int, hash_bits: int = 64):
    """Rows (id, text, paths of (start, n windows, digest) or null): counts of words, and the text that is left."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                counts, removed, kept = [], [], []
                for t, paths in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    data = (t.as_py() or "").encode()
                    words = data.split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    starts = [np.arange(p["start"], p["start"] + p["n"]) for p in paths or () if _digest(words[p["start"] : p["start"] + p["n"] + length - 1]) == p["digest"]]
                    if starts:
                        first = _first_of(*(w := _windows(*both_hashes(data), length, hash_bits)), np.arange(len(w[0])))
                        at = np.flatnonzero(np.isin(first, first[np.concatenate(starts)]))  # and wherever the document repeats them
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + length, -1)
                    covered = np.cumsum(gone[:-1]) > 0
                    counts.append(len(words))
                    removed.append(int(covered.sum()))
                    kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c] if starts else words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def repeated_paths(docs: DataFrame, length: int = LENGTH, short: int = SHORT, hash_bits: int = 64) -> DataFrame:
    """doc, start, n, source, at: n windows of doc from word `start` on that the smaller document `source` has from `at` on.

    docs: (id, text). Windows that a document repeats are listed where they stand first.
    hash_bits: of the first hash of a window; the second, independent one has 64.
    """
    buckets = max(16, docs.count() // DOCS_PER_BUCKET)
    bits = min(BUCKET_BITS, 1 << (MAX_BITS // buckets).bit_length() - 1)
    counted = docs.mapInArrow(lean(_emit_minimizers(length, short, buckets)), "bucket int, rest binary, many binary").groupBy("bucket").applyInArrow(_repeated(bits, HOT_WINDOWS), "bucket int, bits binary, hot binary")
    hot = [np.zeros(0, np.uint64)]  # one key per HOT_WINDOWS windows of the table at most
    field = np.zeros((buckets, bits // 8), np.uint8)
    for r in counted.toLocalIterator():  # at most MAX_BITS / 8 bytes in all
        field[r["bucket"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
        hot.append(_hot_keys(r["bucket"], np.frombuffer(bytes(r["hot"]), np.uint32)))
    shared = share(docs.sparkSession, (field, np.concatenate(hot)))
    windows = docs.mapInArrow(lean(_emit_windows(length, short, buckets, bits, shared, hash_bits)), "bucket int, hash binary, other binary, doc binary, start binary, paths binary")
    pieces = windows.groupBy("bucket").applyInArrow(lean(_paths), PATH)
    order = Window.partitionBy("doc").orderBy("start")
    end = F.lag(F.col("start") + F.col("n")).over(order)
    follows = (end == F.col("start")) & (F.lag("source").over(order) == F.col("source")) & (F.lag(F.col("at") + F.col("n")).over(order) == F.col("at"))
    numbered = pieces.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("new").over(order))
    return numbered.groupBy("doc", "path").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("source").alias("source"), F.min("at").alias("at")).drop("path")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int = SHORT, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs; kept: the words that are left, joined by one space.

    A word is removed when a window of `length` words that covers it also starts in a document of smaller id. Null text
    has no words; texts of fewer words than a window lose none. Rows without an id lose nothing and make no others
    lose anything. Rows repeated with one id and text lose the same words, none to each other; ids are meant to be
    unique otherwise. Other columns are ignored; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    paths = stored(repeated_paths(texts, length, short, hash_bits), "paths")
    n = paths.count()
    spans = paths.select("source", "at", "n").distinct().groupBy("source").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    holding = Bloom(paths.select("source").distinct(), "source", n).mark(texts, "id", "__hit").where("__hit").drop("__hit").dropDuplicates(["id"])
    digests = holding.join(spans, F.col("id") == F.col("source")).select("id", "text", "spans").mapInArrow(lean(_source_digests(length)), "source long, at long, n long, digest binary")
    verified = paths.join(digests, ["source", "at", "n"]).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "digest")).alias("paths"))
    marked = Bloom(paths.select("doc").distinct(), "doc", n).mark(texts, "id", "__hit")
    none = F.lit(None).cast("array<struct<start: long, n: long, digest: binary>>")
    rows = marked.where("__hit").join(verified, F.col("id") == F.col("doc"), "left").select("id", "text", "paths")
    rest = marked.where("not __hit").select("id", "text", none.alias("paths"))
    result = "id long, n_words long, n_removed long, kept string"
    out = rows.mapInArrow(lean(_remove(length, hash_bits)), result).unionByName(rest.mapInArrow(lean(_remove(length, hash_bits)), result))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")
