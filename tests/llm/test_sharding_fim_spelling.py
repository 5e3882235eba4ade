"""Sharding, fill-in-middle and spelling variants against brute force, on small tables with all that may go wrong in them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumencube.llm import fim, sharding, spelling

from .test_llm_operators import make

ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "b"), (5, "x<P>y and more text to cut", "b"), (6, "ends with <", "b"), (7, "S> begins <S", None),
    (8, "Überraschung! " * 40 + "é́ 🙂 中文", "c"), (9, "word " * 60_000, "c"), (9, "word " * 60_000, "c"), (10, "same text", "a"), (11, "same text", "a"), (None, "no id here", "a"), (None, "nor here", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    more = [(i, " ".join(rng.choice(["alpha", "beta<M>", "gamma-delta", "Ωmega", "\n", "12"]) for _ in range(rng.randrange(40))), rng.choice("abc")) for i in range(100, 400)]
    return make(spark, ROWS + more).repartition(3).cache()


def draw(key, shards):
    """The shard of a key, level by level, from the list of shards alone."""
    inside = [(s, None) for s in shards]
    names = (lambda s: f"{s.region}", lambda s: f"{s.region}.{s.rack}", lambda s: f"{s.region}.{s.rack}.{s.number}")
    inside = shards
    for name in names:
        weights = Counter()
        for s in inside:
            weights[f"{name(s)}@{s.opening}"] += s.weight
        u = lambda n: (int(hashlib.md5(f"{n}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        won = min(weights, key=lambda n: -math.log(u(n)) / weights[n])
        inside = [s for s in inside if f"{name(s)}@{s.opening}" == won]
    return inside[0].number


def test_shards_as_drawn(docs):
    old, new = sharding.layout(16), sharding.layout(17)
    got = sharding.place_shards(docs, old, new).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    assert len(got) == docs.count() and {r["law"] for r in got} == {"key"}
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == draw(key, old) and r["grown_shard"] == draw(key, new) and r["grown_shard"] in (r["shard"], 16)
        if key:
            data = texts[r["doc_id"]].encode()
            assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_trees_grow_into_the_new_shard_only(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    sizes = range(14, 27)
    placed = keys.select(*[sharding.Tree(sharding.layout(n, 14)).place(F.col("k")).alias(str(n)) for n in sizes]).collect()
    for n in sizes[:-1]:
        moved = [r[str(n + 1)] for r in placed if r[str(n)] != r[str(n + 1)]]
        assert set(moved) == {n} and abs(len(moved) - 4000 / (n + 1)) < 6 * math.sqrt(4000 / (n + 1))
    for n in (14, 26):
        assert max(abs(c - 4000 / n) for c in Counter(r[str(n)] for r in placed).values()) < 6 * math.sqrt(4000 / n)


def test_a_heavier_shard_moves_rows_within_its_path_only(spark):
    keys = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    old = [sharding.Shard(n // 4, n // 2 % 2, n, 1.0 + n % 3) for n in range(8)]
    new = [s if s.number != 5 else sharding.Shard(s.region, s.rack, 5, 6.0) for s in old]
    a, b = ([r[0] for r in keys.select(sharding.Tree(t).place(F.col("k"))).collect()] for t in (old, new))
    moved = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert moved and all(y // 4 == 1 for _, y in moved)  # into its region
    assert all(y // 2 == 2 for x, y in moved if x // 4 == 1)  # within the region, into its rack
    assert all(y == 5 for x, y in moved if x // 2 == 2)  # within the rack, onto it
    total = sum(s.weight for s in old)
    for s in old:
        assert abs(a.count(s.number) - 6000 * s.weight / total) < 6 * math.sqrt(6000 * s.weight / total)


@pytest.mark.parametrize("bad", [[], [sharding.Shard(0, 0, 0), sharding.Shard(0, 1, 0)], [sharding.Shard(0, 0, 0, 0.0)]])
def test_trees_refused(bad):
    with pytest.raises(ValueError):
        sharding.Tree(bad)


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs):
    cut = fim.fill_in_middle(docs)
    assert cut.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    order = lambda x: (str(x[0]), x[-1])
    want = sorted(((r["doc_id"], *brute_fim(r["doc_id"], r["text"])) for r in docs.collect()), key=order)
    assert sorted((tuple(r) for r in cut.collect()), key=order) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {(r["doc_id"], sha(r["text"] or "")) for r in docs.collect()}
    digests = fim.fill_in_middle_digests(docs).collect()
    assert {(r["doc_id"], r["output_sha256"]) for r in digests} == {(w[0], sha(w[-1])) for w in want}
    assert {(r["doc_id"], r["restored_sha256"]) for r in digests} == texts
    for w in want:
        assert (w[0], sha(fim.restore(w[-1], w[2]))) in texts


def brute_variants(rows):
    count = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}

    def one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in n if one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9]))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Àÿ×÷ßàÉ", "àÿ×÷ßàé"]
    rows = [(None, None, "a"), (2, "", "a"), (3, "short words only", "a"), (4, "chained " * 600 + "chainer " * 40 + "Chaixer CHAIXER chaixer", "a")]
    for i in range(10, 130):
        rows.append((i, " ".join(rng.choice(stems[: 2 + i // 2]).title() if rng.random() < 0.2 else rng.choice(stems) for _ in range(60)), "b"))
    return rows + [(131, " ".join(stems[:5] * 3000), "b"), (131, "extract extract", "b"), (None, "nothing nothing2nothing", "b")]


@pytest.mark.parametrize("cell", [2048, 3])
def test_spelling_variants(spark, spelled, cell, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", cell)
    got = sorted((tuple(r) for r in spelling.spelling_variants(make(spark, spelled).repartition(3)).collect()), key=lambda r: r[0])
    want = brute_variants(spelled)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 3


def test_spelling_needs_long_words(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(make(spark, ROWS), least=5)


def test_empty_tables(spark):
    none = make(spark, [])
    assert sharding.place_shards(none, sharding.layout(16), sharding.layout(17)).count() == 0
    assert fim.fill_in_middle(none).count() == fim.fill_in_middle_digests(none).count() == 0
    assert spelling.spelling_variants(none).count() == 0
