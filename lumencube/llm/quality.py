"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every word and every word shape (letters, digits and signs as patterns) has a sparse random index vector. A word's
vector is the sum of the index vectors of the words and shapes around it in the fit's texts, set to unit length, beside
the index vector of its own shape; a word that the fit has not seen has its shape only. A document's vector is the mean
of its words' vectors, with its length, share of distinct words and share of words that follow themselves. A network with one hidden layer turns it into a logit, and a
temperature, found on labelled rows that its weights were not fitted on, turns that into a probability.

The fit reads a bounded sample of labelled rows (FIT_ROWS) on the driver; scoring reads every whole text where it is.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_name, lean, share, text_batches

#: Labelled rows that the fit reads at most, and words that have a vector of their own.
FIT_ROWS, VOCABULARY = 4000, 30_000
#: Bytes of fit texts collected at most, and of a single one: longer texts, and rows beyond the sum, are left out of the fit.
FIT_BYTES, FIT_TEXT = 60_000_000, 1_000_000
DIM, SHAPE_DIM, NONZERO, HIDDEN = 48, 32, 6, 32
WINDOW = 2
#: Words that a worker remembers beyond the vocabulary; beyond, it starts anew.
REMEMBERED = 1 << 16

_SHAPE = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Letters as a or A, digits as 0, other signs as they are; runs as one."""
    return _RUN.sub(rb"\1", word.translate(_SHAPE))


def index_vector(key: bytes, dim: int) -> np.ndarray:
    """NONZERO entries of +-1, drawn by a hash of the key."""
    rng = np.random.default_rng(zlib.crc32(key))
    out = np.zeros(dim, np.float32)
    out[rng.choice(dim, NONZERO, replace=False)] = rng.integers(0, 2, NONZERO) * 2 - 1
    return out


class Vectors:
    """Word vectors; `rows` maps a word to its row, and unseen words to the row of their shape."""

    def __init__(self, texts: list[bytes]):
        seen: dict[bytes, int] = {}  # words in the order in which they come
        parts = [np.fromiter((seen.setdefault(w, len(seen)) for w in t.split()), np.int32) for t in texts]
        total = np.zeros(len(seen), np.int64)
        for p in parts:
            total += np.bincount(p, minlength=len(seen))
        every = sorted(seen)
        counts = {w: int(total[seen[w]]) for w in every}
        number = {w: i + 1 for i, w in enumerate(every)}  # 0 stands between documents
        renumber = np.zeros(len(seen), np.int32)
        for w, i in seen.items():
            renumber[i] = number[w]
        del seen
        shapes = sorted({shape(w) for w in every})
        shape_index = {s: index_vector(b"s" + s, DIM) for s in shapes}
        index = np.zeros((len(every) + 1, DIM), np.float32)
        for w, i in number.items():
            index[i] = shape_index[shape(w)] + (index_vector(b"w" + w, DIM) if counts[w] > 1 else 0)
        gap = np.zeros(WINDOW, np.int32)
        ids = np.concatenate([x for p in parts for x in (renumber[p], gap)])
        context = np.zeros((len(every) + 1, DIM), np.float32)
        for d in range(DIM):
            values = index[ids, d].astype(np.float64)
            around = np.zeros(len(ids))
            for o in range(1, WINDOW + 1):
                around[o:] += values[:-o] if len(values) > o else 0
                around[:-o] += values[o:] if len(values) > o else 0
            context[:, d] = np.bincount(ids, around, len(every) + 1)
        context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-6
        kept = sorted((w for w in every if counts[w] > 1), key=lambda w: (-counts[w], w))[:VOCABULARY]
        self.rows: dict[bytes, int] = {}
        self.shape_rows: dict[bytes, int] = {}
        rows = [np.zeros(DIM + SHAPE_DIM, np.float32)]  # row 0: words of unseen shape
        for s in shapes:
            self.shape_rows[s] = len(rows)
            rows.append(np.concatenate([np.zeros(DIM, np.float32), index_vector(b"o" + s, SHAPE_DIM)]))
        for w in kept:
            self.rows[w] = len(rows)
            rows.append(np.concatenate([context[number[w]], index_vector(b"o" + shape(w), SHAPE_DIM)]))
        self.table = np.stack(rows)
        self.memory: dict[bytes, int] = {}

    def _unseen(self, word: bytes) -> int:
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        row = self.memory[word] = self.shape_rows.get(shape(word), 0)
        return row

    def pooled(self, text: bytes) -> np.ndarray:
        """Mean vector of the words of a whole text; its logarithmic length, share of distinct words and of words said twice."""
        words, known, memory = text.split(), self.rows, self.memory
        total = np.zeros(DIM + SHAPE_DIM + 3, np.float64)
        for at in range(0, len(words), 1 << 15):
            part = words[at : at + (1 << 15)]
            ids = [known.get(w) or memory.get(w) for w in part]
            if None in ids:
                ids = [i if i is not None else self._unseen(w) for i, w in zip(ids, part, strict=True)]
            total[:-3] += self.table[ids].sum(0)
        n = max(1, len(words))
        total[:-3] /= n
        total[-3:] = np.log1p(len(words)), len(set(words)) / n, sum(map(eq, words, islice(words, 1, None))) / n
        return total


class Network:
    """standardised input -> tanh layer -> logit / temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, **how):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.temperature = 1.0
        if check.any():  # the temperature comes from weights that have not seen the rows to check
            self._fit(x[~check], y[~check], **how)
            logits = self.logits(x[check])
            loss = lambda t: np.mean(np.logaddexp(0, np.where(y[check] > 0.5, -1, 1) * logits / t))
            self.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
        self._fit(x, y, **how)

    def _fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, steps: int = 1500, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 1) -> None:
        """Adam over at least `epochs` passes and `steps` steps."""
        rng = np.random.default_rng(seed)
        n = x.shape[1]
        self.p = [rng.standard_normal((n, HIDDEN)) / np.sqrt(n), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(v) for v in self.p], [np.zeros_like(v) for v in self.p], 0
        z = (x - self.mean) / self.scale
        epochs = max(epochs, -(-steps // -(-len(x) // batch)))
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                h = np.tanh(z[i] @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[i]) / len(i)
                back = e[:, None] * self.p[2] * (1 - h * h)
                step += 1
                for k, g in enumerate((z[i].T @ back, back.sum(0), h.T @ e, e.sum(keepdims=True))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    lr = rate * (1 - epoch / epochs)
                    self.p[k] -= lr * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + decay * self.p[k])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class Classifier:
    """Vectors and network; without labels of both kinds every score is the share of label 1 (one half without labels)."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        y = np.array(labels, np.float64)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.vectors = self.network = None
        if len(y) >= 4 and 0 < self.prior < 1:
            self.vectors = Vectors(texts)
            x = np.stack([self.vectors.pooled(t) for t in texts])
            self.vectors.memory.clear()
            check = np.arange(len(y)) % 5 == 4
            self.network = Network(x, y, check if 0 < y[~check].mean() < 1 else np.zeros(len(y), bool))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        return self.network.scores(np.stack([self.vectors.pooled(t) for t in texts])) if texts else np.zeros(0)


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit_classifier(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Classifier:
    """A classifier from at most `rows` labelled rows (those first in the order of a hash of the id) where usable holds.

    Null labels are left out; of several labels of an id the larger counts, and of several texts of an id the shortest;
    null text counts as empty. Texts over FIT_TEXT bytes are no part of the fit, nor what exceeds FIT_BYTES in sum: the
    driver gets no more than that. Fewer than four rows, or rows of one label only, give a constant score.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & usable).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y"))
    chosen = F.broadcast(known.withColumn("h", F.xxhash64("i", F.lit(17))).orderBy("h", "i").limit(rows))  # at most `rows` small rows
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(chosen, "i")
    sized = texts.select("i", "y", "h", F.octet_length("t").cast("long").alias("n"), F.xxhash64("t").alias("x")).where(F.col("n") <= FIT_TEXT)
    one = sized.groupBy("i", "y", "h").agg(F.min(F.struct("n", "x")).alias("of")).select("i", "y", "h", "of.n", "of.x")  # of rows of one id, the shortest
    upto = F.sum("n").over(Window.orderBy("h", "i"))  # at most `rows` small rows
    fitting = F.broadcast(one.withColumn("upto", upto).where(F.col("upto") <= FIT_BYTES).select("i", F.col("n").alias("n_"), F.col("x").alias("x_")))
    same = (F.octet_length("t") == F.col("n_")) & (F.xxhash64("t") == F.col("x_"))
    picked = texts.join(fitting, "i").where(same).groupBy("i", "y", "h").agg(F.min("t").alias("t"))
    found = [(r["t"].encode(), int(r["y"])) for r in sorted(picked.collect(), key=lambda r: (r["h"], r["i"]))]
    return Classifier([t for t, _ in found], [y for _, y in found])


def score_documents(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column; every whole text is read, null and empty texts get a score as well. No shuffle."""
    text_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        classifier = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                scores = classifier.scores([(t or "").encode() for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], schema.names)
        if classifier.vectors is not None:
            classifier.vectors.memory.clear()

    return docs.mapInArrow(lean(run), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score, predicted for every row of docs.

    Rows whose crc32(id as text) mod 4 is 2 are held out of the fit. Ids, languages, sources and labels are no inputs of
    a score, so repeated texts have equal scores, and ties of scores are no matter. Null text counts as empty. Whole
    texts are read, however long. An empty table gives an empty result. With fewer than four usable labels, or labels of
    one kind only, every score is the share of label 1 (one half without labels). Other columns are dropped.
    """
    model = fit_classifier(docs, labels, ~is_held_out(F.col(id_col)), id_col, text_col, label_col)
    scored = score_documents(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns, whatever these are called.

    Nulls, repeats, long texts and empty tables as for quality_scores; a repeated row is kept or dropped with its like.
    """
    model = fit_classifier(docs, labels, ~is_held_out(F.col(id_col)), id_col, text_col)
    score = free_name(docs, "score")
    return score_documents(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)
