"""What the stages leave in the shared folder, and odd rows in each of them."""

import os

import pytest
from test_operators import LONG, ODD

import corpus_pipeline as P
from newsflow.llm import common
from newsflow.llm.jaccard import jaccard_components
from newsflow.session import scratch_dir

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def left(spark):
    folder = f"{scratch_dir(spark)}/newsflow"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_run_leaves_only_what_its_result_reads(spark, sf_dir):
    before = left(spark)
    out = P.run(spark, sf_dir)
    rows = out.count()
    more = {n.rsplit("-", 1)[0] for n in left(spark) - before}
    assert rows and more <= {"sequences", "parts", "firsts"}


def odd(spark, texts):
    rows = [(i, t, ("en", None)[i % 2], ("a", None, "")[i % 3], i) for i, t in enumerate(texts)]
    rows += [(None, "no id " * 30, "en", "a", 1), (None, None, None, None, None), (3, "one", "en", "a", 3), (3, "another", "en", "a", 3)]
    rows += [(50 + i, " ".join(f"g{i}x{k * k}" for k in range(60)), "de", "good host", 60) for i in range(12)]
    return spark.createDataFrame([(*r, "x") for r in rows], KINDS + ", kept string")


@pytest.mark.parametrize("name, function", P.STAGES)
def test_stages_take_odd_rows(spark, sf_dir, name, function):
    docs = odd(spark, [*ODD, LONG, LONG + " more"])
    out = function(spark, docs, sf_dir)
    rows = out.collect()
    if name != "packing":
        assert tuple(out.columns) == P.COLUMNS
    assert len(rows) >= (9 if name == "mixing" else 12)
    assert function(spark, docs.limit(0), sf_dir).count() == 0


def test_repeated_ids_count_as_their_largest_text(spark):
    base = [f"w{i}" for i in range(60)]
    b, a, other = " ".join(base), "short text of few words", " ".join(["y", *base[:-1]])
    rows = [(1, b), (2, a), (2, b), (3, b + " z"), (4, other), (4, a), (4, other), (5, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_components(docs).collect()}
    assert got == {1: (57, 1), 2: (57, 1), 3: (58, 1), 4: (57, 1), 5: (0, 5)}


def test_components_raise_when_steps_run_out(spark, monkeypatch):
    chain = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    assert {r.component for r in common.components(chain).collect()} == {0}
    monkeypatch.setattr(common, "STEPS", 1)
    before = left(spark)
    with pytest.raises(RuntimeError):
        common.components(chain)
    assert left(spark) == before
