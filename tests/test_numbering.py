"""Places of rows over a whole table: right in any order, and in no task all at once."""

import random

import pytest
from pyspark.sql import functions as F

from lumencube.operators import numbering
from lumencube.plans.registry import QUERIES
from lumencube.sources import fits

SF = "/root/testdata/sf0.001"


def test_numbered_cuts_a_key_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SORTED", 100)
    taken, plain = [], numbering.stored
    monkeypatch.setattr(numbering, "stored", lambda df, label: taken.append(plain(df, label)) or taken[-1])
    rng = random.Random(2)
    rows = [(None if i < 3 else 7 if i < 900 else rng.randrange(50), f"t{i}") for i in range(1200)]
    rng.shuffle(rows)
    got = numbering.numbered(spark.createDataFrame(rows, "k int, t string").repartition(6), ["k"]).collect()
    assert sorted(r["row_id"] for r in got) == list(range(1200)) and {(r["k"], r["t"]) for r in got} == set(rows)
    keys = [r["k"] for r in sorted(got, key=lambda r: r["row_id"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    per_range = [r["count"] for r in taken[0].groupBy(F.shiftright("__place", 33)).count().collect()]
    assert len(per_range) > 6 and max(per_range) < 400
    assert numbering.numbered(spark.createDataFrame([], "k int, t string"), ["k"]).collect() == []


@pytest.mark.parametrize("name", ["fits_table_rows", "votable_rows"])
def test_no_task_numbers_the_whole_table(spark, monkeypatch, name):
    monkeypatch.setattr(numbering, "SORTED", 2 if name == "votable_rows" else 100)
    monkeypatch.setattr(fits, "SORTED", 100)
    saved, plain = [], fits.save_table
    monkeypatch.setattr(fits, "save_table", lambda df, path: saved.append(df) or plain(df, path))
    got = QUERIES[name](spark, SF)
    held = [len(p) for p in (saved[0] if saved else got).rdd.glom().collect()]
    assert max(held) < sum(held) == got.count()
