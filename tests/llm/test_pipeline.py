"""The pipeline on planted cases, and the registered queries against their SQL."""

import random

import corpus_pipeline
import pytest
from codeloom.llm import queries as Q

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_stages_on_planted_cases(spark, tmp_path):
    r = random.Random(4)
    vocabulary = ["".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = text(60)
    rows = [(i, text(r.randint(30, 120)), "en") for i in range(120)]
    near = rows[5][1].split()
    near[3] = "zzz"
    rows += [(200, rows[4][1], "en"), (201, " ".join(near), "en"), (202, f"{text(40)} {passage} {text(40)}", "en"), (203, f"{text(40)} {passage} {text(40)}", "en"), (204, f'{text(30)} token = "{HEX}" {text(30)}', "en"), (205, "12 34 ## 56", "en"), (206, "жзи клм нопр " * 20, None)]
    spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
        assert all(x.n_chars == len(x.text) for x in docs.collect())
    first = {i: t for i, t, _ in rows}
    clean = set(range(120)) | {202}
    assert seen["language"].keys() == first.keys() - {205, 206}
    assert seen["near_duplicates"].keys() == seen["language"].keys() - {200, 201}
    assert seen["passages"].keys() == seen["near_duplicates"].keys()
    assert passage in seen["passages"][202] and passage not in seen["passages"][203]
    assert all(seen["secrets"][i] == first[i] for i in clean)
    assert HEX not in seen["secrets"][204] and first[204].replace(HEX, "[SECRET]") == seen["secrets"][204]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == seen["secrets"].keys()
    assert sum(x.length for x in packed) == sum(len(t.split()) for t in seen["secrets"].values())


def test_an_empty_table_passes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_names():
    assert [n.split("_")[0] for n in sorted(Q.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert Q.ORACLES.keys() <= Q.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    df = Q.QUERIES[name](spark, d)
    want = con.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows), key=repr)
    assert key(df.select(*sorted(df.columns)).collect()) == key(want.select(", ".join(f'"{c}"' for c in sorted(want.columns))).fetchall())
