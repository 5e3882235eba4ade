"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

A source's documents, in the order of a hash, form one stream of words that is read as often as its target asks, to the
word. The stream is cut at every `block` words into blocks, wherever in a document that falls; only the block at a
stream's end may be shorter. Slot j of the mix gets the point frac((j + 1/2) / golden ratio); the source whose stretch
of the cumulative weights (its share of all blocks) holds that point fills the slot. Slots are ranked per source, a
source's blocks are shuffled, and the slot of rank r holds the r-th of the shuffled blocks. A source gets as many slots
as it has blocks: points beyond that stay unused, and the few that the sequence lacks come behind the others. What is
taken of a document is the sum of its words in the joined blocks. Nothing here needs a source in one task: ranks,
shuffled blocks and stream offsets are running totals over slices of a hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, running_total, stored

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: Words of a block: at most BLOCK, fewer in small mixes so that these have SLOTS slots.
BLOCK, SLOTS = 512, 1 << 10
#: Up to so many sources, the table of sources is broadcast (some 100 bytes each).
BROADCAST_SOURCES = 50_000
#: Rows of a source that one task puts in order.
SLICE = 512


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), ceiling: int = 3) -> DataFrame:
    """source, number, weight, source_size, target, goal: one row per source, from rows of (source, size); goal: the target in whole words.

    Sources are numbered by code point, null last; weights repeat. All words of the table are shared out by weight, no
    source above `ceiling` times its size: with the sources in the order of ceiling * size / weight, those before the
    first that can hold its share of what is left stop at their ceiling, and all others share by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.col("source_size") * ceiling
    t = by_source.withColumn("number", number).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    rising = Window.orderBy((cap / F.col("weight")).asc(), "number")
    full = F.coalesce(F.sum(cap).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(everything) - full) / left).withColumn("at", F.row_number().over(rising))
    holds = F.col("level") <= cap / F.col("weight")
    level = F.min(F.when(holds, F.struct("at", "level"))).over(everything)["level"]
    target = F.least(cap.cast("double"), F.col("weight") * F.col("fill"))
    return t.withColumn("fill", F.coalesce(level, F.lit(0.0))).select("source", "number", "weight", "source_size", target.alias("target"), F.round(target).cast("long").alias("goal"))


def _schedule(spark, targets: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """slot, number (the source's), rank (per source), block: what fills the mix, in order. targets: number, blocks (how many), ..."""
    cells = max(1024, 4 * n_sources)
    used = targets.where("blocks > 0").select("number", "blocks")
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum("blocks").over(upto)
    shares = used.withColumn("low", (high - F.col("blocks")) / slots).withColumn("high", F.when(high == slots, F.lit(2.0)).otherwise(high / slots))
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    stretches = shares.select("number", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    turn = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(slots).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("point")).withColumn("cell", cell(F.col("point")))
    filled = points.join(stretches, "cell").where("low <= point and point < high").select("slot", "number", "blocks")
    ranked = stored(running_total(filled, ["number"], [], F.col("slot") * (2**62 // max(1, slots)), F.lit(1), slots, "rank", SLICE), "slots")
    got = used.join(ranked.groupBy("number").agg(F.count("*").alias("got")), "number", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    rest = got.where("got < blocks").select("number", "got", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("rank"))
    behind = rest.select((slots + (F.col("rank") - F.col("got")) * n_sources + F.col("number")).cast("long").alias("slot"), "number", "rank")
    fitting = ranked.where("rank < blocks").select("slot", "number", "rank").unionByName(behind)
    return running_total(fitting, ["number"], [F.col("rank")], stream_order(F.col("rank")) * 4, F.lit(1), slots, "block", SLICE)


def stream_order(key: Column) -> Column:
    """A long in [0, 2**60) by which a source's documents, or its blocks, are put in order."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of whole rows: rows of the same keys are equal in every column that can be hashed (all but maps)."""
    fields = [F.col(f"`{f.name.replace('`', '``')}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(F.lit(k), *fields) for k in (1, 2)]


class Mix:
    """A mix of a table: `targets`, `schedule` (slots in order), `documents` (the streams) and `pieces` (what is read of them)."""

    def __init__(self, docs: DataFrame, weights=(5, 2, 1), ceiling: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        spark = docs.sparkSession
        p, q = _row_keys(docs)
        sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), p.alias("p"), q.alias("q")), "sizes")
        targets = source_targets(sizes, weights, ceiling)
        words = int(sizes.agg(F.sum("size")).first()[0] or 0)
        #: Words of every block but the last of a source.
        self.block = max(1, min(BLOCK, words // SLOTS))
        self.targets = stored(targets.withColumn("blocks", F.ceil(F.col("goal") / self.block).cast("long")), "targets")
        got = self.targets.agg(F.sum("blocks"), F.count("*")).first()
        self.slots, n_sources = int(got[0] or 0), got[1]
        self.schedule = stored(_schedule(spark, self.targets, self.slots, n_sources), "schedule")
        small = F.broadcast(self.targets) if n_sources <= BROADCAST_SOURCES else self.targets
        known = sizes.join(small.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight", "blocks")
        self.empty = known.where("size = 0")
        rows = known.where("size > 0").withColumn("order", stream_order(F.col("id")))
        self.documents = running_total(rows, ["number"], [F.col("id"), F.col("size"), F.col("p"), F.col("q")], F.col("order") * 4, F.col("size"), sizes.count(), "start", SLICE)

    @property
    def pieces(self) -> DataFrame:
        """The columns of documents, with block, slot, skip and words: the part of a document in a block, and the slot that holds it.

        The part has `words` words behind the first `skip` ones. Documents that are not read have one row without a block.
        """
        each = F.lit(self.block)
        last = F.ceil((F.col("goal") - F.col("start")) / F.col("source_size")).cast("long") - 1
        passes = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))
        read = self.documents.withColumn("pass", F.explode_outer(passes)).withColumn("first", F.col("pass") * F.col("source_size") + F.col("start"))
        read = read.withColumn("end", F.least(F.col("first") + F.col("size"), F.col("goal")))
        read = read.withColumn("block", F.explode_outer(F.sequence(F.expr(f"first div {self.block}"), F.expr(f"(end - 1) div {self.block}"))))
        begins, ends = F.greatest(F.col("block") * each, F.col("first")), F.least((F.col("block") + 1) * each, F.col("end"))
        read = read.withColumn("skip", begins - F.col("first")).withColumn("words", ends - begins).drop("end")
        return read.join(self.schedule.select("number", "block", "slot"), ["number", "block"], "left")

    @property
    def taken(self) -> DataFrame:
        """id, source, size, source_size, target, taken, first_slot: the words of each document in the blocks that slots hold."""
        keys = ["id", "source", "size", "source_size", "target"]
        words = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("long")
        taken = self.pieces.groupBy(*keys, "number", "start").agg(words.alias("taken"), F.min("slot").alias("first_slot")).drop("number", "start")
        return taken.unionByName(self.empty.select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot")))


def mix(docs: DataFrame, weights=(5, 2, 1), ceiling: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot for every row of docs.

    Every source takes its target to the word (rounded); no document is taken more than `ceiling` times. Null text has
    size 0, as an empty one; rows of size 0 take nothing. A null source is a source like any other, numbered last. Rows
    repeated with the same id, source and size each take a stretch of their own; ids of one hash are ordered by id. Other
    columns are ignored. Very long texts are only counted where they are. An empty table gives an empty result.
    """
    return Mix(docs, weights, ceiling, id_col, text_col, source_col).taken.withColumnRenamed("id", id_col)


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), ceiling: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, block by block in the order of its slots, with the columns of docs: a row for each part of a document in a block.

    The text of a row is the part as it stands, from its first word to the next part's first word, with all white space;
    the first part starts where the text does. So a document that lies in one block comes unchanged, and the parts of one
    that was read whole make it up again. Rows of two sources stay apart whatever else they share; rows repeated with equal
    columns stand for each other. Null and empty texts are left out; an empty table gives an empty result. Parts of a very
    long text are cut from one list of its words. Columns may have any names. Partitions hold stretches of the schedule.
    """
    slot, skip, p, q, row, parts = (free_name(docs, f"mix_{c}") for c in ("slot", "skip", "p", "q", "row", "parts"))
    part = F.struct(F.col("slot"), F.col("skip").cast("int").alias("skip"), F.col("words").cast("int").alias("words"))
    read = Mix(docs, weights, ceiling, id_col, text_col, source_col).pieces.where("slot is not null")
    read = read.groupBy("number", "start", F.col("p").alias(p), F.col("q").alias(q)).agg(F.collect_list(part).alias(parts)).drop("number", "start")
    one, two = _row_keys(docs)
    rows = docs.select(one.alias(p), two.alias(q), F.struct(*docs.columns).alias(row)).groupBy(p, q).agg(F.first(row).alias(row))
    text = F.col(row)[text_col]
    words = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    cut = lambda of: F.transform(parts, lambda x: F.struct(x["slot"].alias("slot"), x["skip"].alias("skip"), F.concat(F.when(x["skip"] == 0, lead).otherwise(""), F.array_join(F.slice(of, x["skip"] + 1, x["words"]), "")).alias("text")))
    listed = read.join(rows, [p, q]).withColumn(q, words)
    found = listed.select(row, F.explode(cut(F.col(q))).alias(parts))
    found = found.select(F.col(parts)["slot"].alias(slot), F.col(parts)["skip"].alias(skip), *[(F.col(parts)["text"] if c == text_col else F.col(row)[c]).alias(c) for c in docs.columns])
    return found.repartitionByRange(slot).sortWithinPartitions(slot, id_col, skip).drop(slot, skip)
