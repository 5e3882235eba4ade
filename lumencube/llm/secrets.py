"""Secret scans over an incremental ledger of blobs; DataFrame functions only.

Every version of a text is content-addressed by its SHA-256. The ledger holds, for each blob, the rule versions it has
been scanned with and the spans they found. A run scans only the blob and rule-version pairs that the ledger lacks,
each distinct text once, and joins the findings back to all paths that hold the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_groups, shared_dir, stored


@dataclass(frozen=True)
class Rule:
    """A pattern; its matches count where the group has at least `least` characters. `hint` must match wherever it does."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# In `access` and `hex` the least length stands in the pattern: both match maximal runs, so the same matches are left.
_WORDS = "(password|passwd|secret|token|api_?key)"
BASE = (
    Rule("assign", 1, rf"""(?i:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, rf"""(?i:{_WORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
LEDGER = "blob string, rules array<string>, spans array<struct<rule: string, start: int, end: int>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(rule: Rule, number: int) -> Column:
    """Lengths of what stands before each match, of the match and of its group, in order."""
    parts = F.arrays_zip(F.split("text", rule.pattern, -1).alias("a"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("b"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("c"))
    lengths = F.transform(parts, lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("at"), F.length(x["a"]).alias("gap"), F.length(x["b"]).alias("match"), F.length(x["c"]).alias("value")))
    return F.filter(lengths, lambda x: x["match"].isNotNull())


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans for every blob with a finding, from rows of (blob, text, rules): the keys of the rules to apply."""
    none = F.array().cast("array<struct<rule: int, at: int, gap: int, match: int, value: int>>")
    wanted = [F.when(F.array_contains("rules", r.key) & F.col("text").rlike(r.hint or r.pattern), _matches(r, n)).otherwise(none) for n, r in enumerate(rules)]
    hits = blobs.select("blob", F.explode(F.concat(*wanted)).alias("m")).select("blob", "m.*")
    w = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("match")).over(w).cast("int")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    key = F.element_at(F.array(*[F.lit(r.key) for r in rules]), F.col("rule") + 1)
    found = hits.withColumn("end", end).where(F.col("value") >= least).select("blob", F.struct(key.alias("rule"), (F.col("end") - F.col("match")).alias("start"), F.col("end").alias("end")).alias("span"))
    return found.groupBy("blob").agg(F.collect_list("span").alias("spans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for rows of (blob, pick, text): one per blob with rule versions that the ledger lacks for it.

    pick: a long that tells the copies of a blob apart, such as a hash of their path; without that column all are alike.
    Hashes alone decide which copy of a blob is scanned, that of least pick. Texts are dealt by blob and pick, so copies
    of one blob never meet in a task; rows of equal blob and pick are combined before they move.
    """
    if "pick" not in versions.columns:
        versions = versions.withColumn("pick", F.lit(0).cast("long"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    chosen = versions.groupBy("blob").agg(F.min("pick").alias("pick"))
    if ledger is None:
        todo = chosen.withColumn("rules", keys)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = chosen.join(seen, "blob", "left").select("blob", "pick", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    todo = stored(todo, "unseen")
    texts = versions.groupBy("blob", "pick").agg(F.coalesce(F.first("text"), F.lit("")).alias("text"))
    found = scan(texts.join(todo, ["blob", "pick"]).select("blob", "text", "rules"), rules)
    return todo.join(found, "blob", "left").select("blob", "rules", F.coalesce("spans", F.array().cast("array<struct<rule: string, start: int, end: int>>")).alias("spans"))


def _run(versions: DataFrame, path_col: str, text_col: str, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, new ledger rows, whole ledger."""
    blob = blob_id(F.col(text_col)).alias("blob")
    paths = stored(versions.select(F.col(path_col).alias("path"), blob), "paths")
    texts = versions.select(blob, F.xxhash64(path_col).alias("pick"), F.col(text_col).alias("text"))
    new = stored(update_ledger(texts, ledger, rules), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    number = F.array_position(F.array(*[F.lit(r.key) for r in rules]), F.col("span.rule")).cast("int") - 1
    span = F.struct(F.col("span.start").alias("start"), number.alias("kind"), F.col("span.end").alias("end"))
    # A ledger that two writers filled at once may hold a blob's spans twice.
    spans = whole.select("blob", F.explode("spans").alias("span")).where(number >= 0).groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    blobs = paths.groupBy("blob").agg(F.count("*").alias("n_paths")).join(spans, "blob", "left")
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    found = join_groups(paths, blobs, "blob", F.col("n_paths"), paths.count()).select(F.col("path").alias(path_col), "blob", F.coalesce("spans", none).alias("spans"))
    return found, new, whole


def find_secrets(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): one findings row per row of versions, and the ledger with this run's scans added.

    findings: path, blob, spans (array of kind number in `rules`, start, end; by start, then kind; code points, end
    exclusive). Null text counts as empty. Repeated rows each get their row; other columns are ignored. Whole texts are
    scanned, however long. Empty tables give empty results. The ledger may be None (nothing scanned yet) or what an earlier
    call returned, for the same rules or others; `scan_into` keeps it in a table.
    """
    found, _, whole = _run(versions, path_col, text_col, ledger, rules)
    return found, whole


def scan_into(ledger_path: str, versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of find_secrets, with the ledger taken from and left in the Parquet table at `ledger_path`.

    The table is made by the first run and appended to by later ones, only with what they scanned themselves; a run that
    failed before it appended is simply run again. Any folder of a Hadoop file system that all executors share will do.
    """
    spark = versions.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    ledger = stored(spark.read.schema(LEDGER).parquet(ledger_path), "before") if known else None
    found, new, _ = _run(versions, path_col, text_col, ledger, rules)
    new.write.mode("append").parquet(ledger_path)
    return found


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_digests(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text, for every row.

    Runs twice, as a scanner of a growing repository does: about half of the paths (by a hash) are taken as its earlier
    state and fill a ledger of this call; the run over all rows then scans the blobs that the ledger lacks and finds the others in it.
    """
    ledger_path = f"{shared_dir(versions.sparkSession)}/stored/secrets-{uuid.uuid4().hex}"
    scan_into(ledger_path, versions.where(F.xxhash64(path_col) < 0), path_col, text_col)
    found = scan_into(ledger_path, versions, path_col, text_col)
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(path_col, *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
