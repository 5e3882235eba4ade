"""Queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from lumencube.llm import quality
from lumencube.llm.oracles import ORACLES
from lumencube.llm.queries import QUERIES, tokenizer_path

from .test_llm_operators import SF, brute_components, brute_groups, brute_targets

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    nulls_first = lambda row: [(v is not None, v) for v in row]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=nulls_first)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=nulls_first)


def test_all_operators_have_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    run = lambda k, df: stages[k](spark, df, SF).cache()
    rows = lambda df: sorted((r["doc_id"], r["text"], r["source"]) for r in df.collect())

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, labels).collect()}
    good = run("quality_filter", docs)
    assert good.columns == names and {i for i, *_ in rows(good)} == {i for i, p in scored.items() if p}
    clean = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    assert sum(scored[i] for i in clean) > 0.95 * len(clean)

    unique = run("exact_dedup", good)
    assert unique.columns == names and {i for i, *_ in rows(unique)} == {k for k, _ in brute_groups(rows(good)).values()}

    apart = run("near_dedup", unique)
    assert apart.columns == names and {i for i, *_ in rows(apart)} == {i for i, (_, c) in brute_components(rows(unique)).items() if i == c}

    mixed = run("source_mix", apart)
    assert mixed.columns == names
    sizes, taken = {}, {}
    for _, t, s in rows(apart):
        sizes[s] = sizes.get(s, 0) + len(t.encode().split())
    for _, t, s in rows(mixed):
        taken[s] = taken.get(s, 0) + len(t.encode().split())
    for s, t in brute_targets(sizes).items():
        assert taken[s] == pytest.approx(t, rel=0.02, abs=20)
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = sorted((i, ",".join(map(str, library.encode(t)))) for i, t, _ in rows(mixed))
    assert sorted((r["doc_id"], r["ids_text"]) for r in run("sentencepiece", mixed).collect()) == want
    assert hashlib.sha256(str(sorted((r["doc_id"], r["ids_text"]) for r in corpus_pipeline.run(spark, SF).collect())).encode()).hexdigest() == hashlib.sha256(str(want).encode()).hexdigest()


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
