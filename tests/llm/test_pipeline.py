"""The pipeline, stage by stage, against brute force on each stage's input."""

import duckdb
import pytest
from test_operators import WORD, brute_components, brute_quality, brute_repeats, texts_of

import __spark_entry__ as entry_point
import corpus_pipeline as P
from newsflow.llm.common import stage
from newsflow.llm.queries import ORACLE, QUERIES


def test_registered():
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())
    assert {f"op{n}_" for n in range(1, 14)} == {q.partition("_")[0] + "_" for q in QUERIES if q.startswith("op")}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, function in P.STAGES:
        out.append(stage(function(spark, out[-1], sf_dir), name))
    return out


def test_stages(stages):
    columns = stages[0].columns
    assert all(s.columns == columns for s in stages[1:-1])
    texts = [texts_of(s) for s in stages[:-1]]
    assert set(texts[1]) == {d for d, t in texts[0].items() if not brute_quality(t)[-1]}
    groups = brute_components(texts[1], 5, 80)
    assert set(texts[2]) == {d for d, (_, c) in groups.items() if c == d} and len(texts[2]) < len(texts[1])
    removed = brute_repeats(texts[2], 100)
    assert set(texts[3]) == set(texts[2])
    for d, t in texts[3].items():
        assert (t == texts[2][d]) == (removed[d][1] == 0)
        assert len(t.encode()) <= removed[d][0] - removed[d][1]
    assert any(removed[d][1] for d in texts[2])
    assert set(texts[4]) < set(texts[3])
    packed = stages[-1].collect()
    assert {r.doc_id for r in packed} == set(texts[4])
    assert sum(r.n_tokens for r in packed) == sum(len(WORD.findall(t or "")) + 1 for t in texts[4].values())


def test_run_equals_its_stages(spark, sf_dir, stages):
    key = ("doc_id", "piece", "batch_id", "slot", "n_tokens")
    assert sorted(P.run(spark, sf_dir).select(*key).collect()) == sorted(stages[-1].select(*key).collect())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    import os

    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    df = QUERIES[name](spark, sf_dir)
    expected = con.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)

    def cells(row):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in row)

    got = sorted((cells(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((cells(r) for r in expected.fetchall()), key=repr)
