"""Spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

Two words one edit apart share, in order and shifted by no more than one place, all but Q of the Q-grams of the longer
one. Distribution: with the grams of every word in one order, rare ones first, the first shared gram of such a pair is
among the first Q + 1 of either word. So every word is posted in Q + 1 tiles (gram, position, length), and asks in those
that a word one letter longer can hold one of its first Q grams in. Tiles of more than CELL words are cut into pieces that
meet in pairs: no group outgrows a task, and no pair of words is emitted before it has been verified. Search: a tile holds
a positional inverted index of all grams of its posted words. A word's grams select postings under the limits of length
and position. Of a bound of T shared grams, the T - 1 longest postings alone cannot reach it, so the shorter ones are
merged by a heap, and the words met there are verified.
"""

from __future__ import annotations

import heapq
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, share, stored

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a gram; one edit touches at most that many grams, so words need at least 2 * Q letters.
Q = 3
#: Words of a cell, rows of a bucket of cells on average, and large tiles up to which their list is broadcast.
CELL, BUCKET, LARGE_TILES = 2048, 16384, 50_000


def lower_ascii(run: Column) -> Column:
    """A-Z to a-z, nothing else; lower() would also change accented capitals."""
    return F.when(run.rlike("[À-Þ]"), F.translate(run, UPPER, LOWER)).otherwise(F.lower(run))


def noisy_words(docs: DataFrame, least: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """word: one row per run of letters, in some of which (by a hash of id and run) one letter is deleted; short ones left out."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    run = F.col("run")
    hashed = runs.select("i", lower_ascii(run).alias("run")).select("run", F.crc32(F.encode(F.concat("i", F.lit(":"), run), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(run).alias("word")).where(F.length("word") >= least)


def grams(word: str) -> list[str]:
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


def bound(longer: int) -> int:
    """Grams that two words one edit apart share at least, the longer one having so many letters."""
    return longer - 2 * Q + 1


def replaced(a: str, b: str) -> bool:
    """Whether two different words of one length differ in one letter only."""
    k = 0
    while a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :]


def inserted(a: str, b: str) -> bool:
    """Whether b, one letter longer, is a with a letter more."""
    k, n = 0, len(a)
    while k < n and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :]


class Index:
    """Postings of words of one length: by position, gram -> numbers of the words, ascending."""

    def __init__(self, length: int):
        self.words: list[str] = []
        self.postings: list[dict[str, list[int]]] = [{} for _ in range(length - Q + 1)]
        self.least = bound(length)

    def add(self, word: str) -> None:
        for at, g in zip(self.postings, grams(word), strict=True):
            at.setdefault(g, []).append(len(self.words))
        self.words.append(word)

    def met(self, lists: list[list[int]]) -> list[str]:
        """The words that may be on at least `least` of the lists."""
        if len(lists) < self.least:
            return []
        lists.sort(key=len)
        short = lists[: len(lists) - self.least + 1]
        return [self.words[k] for k, _ in groupby(heapq.merge(*short) if len(short) > 1 else short[0])]

    def same(self, word: str) -> list[str]:
        """Words that are one replaced letter away from another word of their length."""
        found = self.met([at[g] for at, g in zip(self.postings, grams(word), strict=True) if g in at])
        return [w for w in found if replaced(word, w)]

    def longer(self, word: str) -> list[str]:
        """Words that are a word one letter shorter with a letter more: its grams stand where they stood or one place on."""
        found = self.met([at[g] for i, g in enumerate(grams(word)) for at in self.postings[i : i + 2] if g in at])
        return [w for w in found if inserted(word, w)]


#: What a row is in its cell: posted and compared with those posted before, posted, asking for its length, for one more.
EACH, POSTED, SAME, LONGER = range(4)


def cell_pairs(words: list[str], kinds: list[int]) -> list[tuple[str, str]]:
    """The near pairs of a cell, the shorter word (of two alike, the first) first."""
    posted = sorted((w, k) for w, k in zip(words, kinds, strict=True) if k <= POSTED)
    if not posted:
        return []
    index, pairs = Index(len(posted[0][0])), []
    for w, k in posted:
        if k == EACH and index.words:
            pairs += [(v, w) for v in index.same(w)]
        index.add(w)
    for w, k in zip(words, kinds, strict=True):
        if k == LONGER:
            pairs += [(w, v) for v in index.longer(w)]
        elif k == SAME:
            pairs += [(min(v, w), max(v, w)) for v in index.same(w)]
    return pairs


def _ranks(words: DataFrame) -> dict[str, int]:
    """The order of the grams, rare ones first; their number is bounded by the alphabet (90 ** Q), whatever the table."""
    pieces = F.transform(F.sequence(F.lit(1), F.length("word") - (Q - 1)), lambda i: F.substring(F.col("word"), i, F.lit(Q)))
    counted = words.select(F.explode(pieces).alias("gram")).groupBy("gram").count()
    return {r["gram"]: (r["count"], r["gram"]) for r in counted.toLocalIterator()}


def _tiles(words: DataFrame) -> DataFrame:
    """word, tile, asks: the tiles that a word is posted in, and those of longer words that it asks in."""
    ranks = {g: k for k, g in enumerate(g for g, _ in sorted(_ranks(words).items(), key=lambda x: x[1]))}
    shared = share(words.sparkSession, ranks)

    def run(batches):
        order = shared.value
        for b in batches:
            out: list[tuple[str, str, bool]] = []
            for w in b.column(0).to_pylist():
                n = len(w)
                first = sorted((order[g], i, g) for i, g in enumerate(grams(w)))
                out += [(w, f"{g}{i}:{n}", False) for _, i, g in first[: Q + 1]]
                out += [(w, t, True) for t in {f"{g}{i + k}:{n + 1}" for _, i, g in first[:Q] for k in (0, 1)}]
            w, t, a = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(t, pa.string()), pa.array(a, pa.bool_())], ["word", "tile", "asks"])

    return words.select("word").mapInArrow(lean(run), "word string, tile string, asks boolean")


def _cells(rows: DataFrame) -> DataFrame:
    """word, cell, kind: the rows of tiles, those of large tiles dealt to cells of some CELL posted and CELL asking words each."""
    sizes = rows.groupBy("tile").agg(F.count_if(~F.col("asks")).alias("posted"), F.count_if("asks").alias("asking"))
    large = sizes.where((F.col("posted") > CELL) | ((F.col("posted") > 0) & (F.col("asking") > CELL)))
    large = stored(large.select("tile", *[F.ceil(F.greatest(F.col(c), F.lit(1)) / CELL).cast("int").alias(c) for c in ("posted", "asking")]), "large")
    n_large = large.count()
    whole = lambda df: df.select("word", F.col("tile").alias("cell"), F.when(F.col("asks"), LONGER).otherwise(EACH).alias("kind"))
    if not n_large:
        return whole(rows)
    known = rows.join(F.broadcast(large) if n_large <= LARGE_TILES else large, "tile", "left")
    mine = F.pmod(F.xxhash64("word"), F.when(F.col("asks"), F.col("asking")).otherwise(F.col("posted"))).cast("int")
    known = known.withColumn("mine", mine)
    cells = lambda of, n, kind, name: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct(F.concat_ws("/", "tile", F.lit(of), *name(k)).alias("cell"), kind(k).alias("kind")))
    mine = F.col("mine")
    role = lambda k: F.when(k == mine, EACH).when(k < mine, POSTED).otherwise(SAME)
    among = cells("same", "posted", role, lambda k: (F.least(k, mine), F.greatest(k, mine)))
    asked = cells("longer", "asking", lambda _: F.lit(POSTED), lambda k: (k, mine))
    asking = cells("longer", "posted", lambda _: F.lit(LONGER), lambda k: (mine, k))
    dealt = known.where("posted is not null").select("word", F.explode(F.when(F.col("asks"), asking).otherwise(F.concat(among, asked))).alias("c")).select("word", "c.*")
    return dealt.unionByName(whole(known.where("posted is null")))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every pair of distinct words that are one edit apart, once, the shorter one (of two alike, the first in order) as a.

    Words (a column of distinct words) have at least 2 * Q letters.
    """
    rows = stored(_tiles(words), "tiles")
    buckets = max(1, rows.count() // BUCKET)
    cells = _cells(rows).withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell")
        words, kinds = t.column("word").to_pylist(), t.column("kind").to_pylist()
        number = t.column("cell").combine_chunks().dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(words)]
        pairs = [p for lo, hi in pairwise(edges) if hi > lo + 1 for p in cell_pairs(words[lo:hi], kinds[lo:hi])]
        a, b = zip(*set(pairs), strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return cells.groupBy("bucket").applyInArrow(lean(run), "a string, b string").dropDuplicates(["a", "b"])


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from rows of (word, form): forms are followed to their end by doubling; each is ten times as frequent, so few rounds do."""
    roots = stored(forms.withColumnRenamed("form", "root"), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, least: int = 7, times: int = 2, factor: int = 10, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the table.

    Words are runs of letters of at least `least` code points (2 * Q or more) that occur `times` or more in all texts,
    a letter deleted in one of `every` of them. Near words differ by one inserted, deleted or replaced code point. The form
    of a word is its near word of largest n, ties to the smallest, if that is `factor` times as frequent, else null; the
    root is where forms end. Repeated rows count each time; null and empty texts hold no words; a null id counts as empty.
    Whole texts count, however long. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    if least < 2 * Q or factor < 2:
        raise ValueError("words need at least 2 * Q letters, and forms at least twice the occurrences")
    words = noisy_words(docs, least, every, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)
    words = stored(words, "words")
    pairs = stored(near_pairs(words), "pairs")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    others = links.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    known = words.join(others.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "word", "left")
    is_form = -F.col("best.n") >= F.col("n") * factor
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "known")
    roots = _roots(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
