"""Fill-in-middle transformation of whole texts: prefix, suffix and middle cut at the borders of units.

A unit is a run of letters A-Z or any other single code point. In an Arrow-batched pandas UDF the `regex` library walks a
text once and leaves the end offsets of its units in a compact array; a cut after k units is a lookup in it, so two
lookups slice the text. Cuts and form follow from a SHA-256 of the document's id: no state, no shuffle, and a task that is
run again gives the same rows. Batches are bounded by bytes; a text longer than that makes a batch of its own.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the documents that stay plain, and of the others that come suffix first.
PLAIN, SPM = 10, 20
FIELDS = "n long, form string, prefix_chars long, middle_chars long"


def seeds(doc_id: str) -> list[int]:
    """Four 32-bit numbers from the id in decimal."""
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def ends(text: str) -> array:
    """End offsets of the units of a text, 4 bytes each."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def transform(doc_id: str, text: str) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, lengths of prefix and middle (None if plain) and the output of one text."""
    at, h = ends(text), seeds(doc_id)
    n = len(at)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - PLAIN:
        return n, "plain", None, None, text
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    lo, hi = (at[k - 1] if k else 0 for k in (min(one, two), max(one, two)))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < SPM:
        return n, "spm", lo, hi - lo, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", lo, hi - lo, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text from an output and its form. The parts of a text that was cut hold no mark, so each mark is found once."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output[len(first) :].split(MIDDLE)
    a, b = head.split(second)
    return a + middle + b if form == "psm" else b + middle + a


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output for every row of docs.

    Null counts as empty; empty texts and texts that hold a mark stay plain. Cuts depend on the id alone, so rows repeated
    come out alike and equal texts of other ids are cut elsewhere; rows without an id share the cuts of an empty id. Whole
    texts are cut, however long. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf(f"{FIELDS}, output string")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(i, t) for i, t in zip(ids.fillna(""), texts.fillna(""), strict=True)]
        return _frame(rows, "output")

    return docs.select(F.col(id_col), cut(F.col(id_col).cast("string"), F.col(text_col)).alias("fim")).select(id_col, "fim.*")


def fill_in_middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: fill_in_middle() with digests instead of outputs.

    The restored text is rebuilt from the output and its form alone. Outputs are hashed where they are made and do not leave
    the task. Rows as in fill_in_middle().
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf(f"{FIELDS}, output_sha256 string, restored_sha256 string")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        rows = []
        for i, t in zip(ids.fillna(""), texts.fillna(""), strict=True):
            *fields, output = transform(i, t)
            rows.append((*fields, sha(output), sha(restore(output, fields[1]))))
        return _frame(rows, "output_sha256", "restored_sha256")

    return docs.select(F.col(id_col), cut(F.col(id_col).cast("string"), F.col(text_col)).alias("fim")).select(id_col, "fim.*")


def _frame(rows: list[tuple], *more: str) -> pd.DataFrame:
    got = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", *more])
    return got.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
