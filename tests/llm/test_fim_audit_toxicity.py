"""Fill-in-the-middle, filter audit and toxicity against brute force, and odd rows."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from test_operators import LONG, ODD, WORD, corpus, documents

from newsflow.llm import fim, toxicity
from newsflow.llm.filter_audit import filter_audit
from newsflow.llm.queries import op13_toxicity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -------------------------------------------------------------------- 11: FIM
def brute_fim(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:" + ("" if doc is None else str(doc)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINES = "\n".join(f"line {i} é漢\U0001f600 <" for i in range(4000))
FIM = [*ODD, "\n", "\n\n", "a\n<P>b\n", "<\nP>\n<S\n>", "<<<\nP>>\n<", LINES, LINES + "\n", "a\r\nb\x85c d\n", "x\n" * 500]


def fim_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [7, fim.CHUNK])
def test_fim_equals_brute_force(spark, chunk):
    docs = documents(spark, FIM)
    expected = [(i, *brute_fim(i, t)) for i, t in enumerate(FIM)]
    got = fim_rows(fim.fim_digests(docs, chunk=chunk))
    assert got == sorted([(*e[:-1], sha(e[-1]), sha(t or "")) for e, t in zip(expected, FIM, strict=True)], key=repr)
    whole = {r.doc: (r.form, r.output) for r in fim.fim_texts(docs, chunk=chunk).collect()}
    assert whole == {e[0]: (e[2], e[-1]) for e in expected}
    assert {f for f, _ in whole.values()} == {"plain", "psm", "spm"}


def test_fim_pieces_are_small_and_in_order(spark):
    rows = fim.fim_pieces(documents(spark, FIM), chunk=1000).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc, []).append(r)
    assert max(len(r.data) for r in rows if r.data is not None) <= 1003  # a mark comes on top
    for own in by.values():
        assert [r.place for r in own] == list(range(-1, len(own) - 1))
    assert len(by[FIM.index(LINES)]) > 50


def test_fim_odd_rows(spark):
    kinds = "doc_id long, text string, form string, n int, data binary"
    rows = [(1, "a\nb\n"), (1, "a\nb\n"), (1, "c\nd\ne"), (None, "x\ny"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", 3, b"z") for r in rows], kinds)
    got = sorted(((r[0], r[2], r[5], r[6]) for r in fim_rows(fim.fim_digests(docs))), key=repr)
    expected = [(d, brute_fim(d, t)[1], sha(brute_fim(d, t)[-1]), sha(t or "")) for d, t in rows]
    assert got == sorted(expected, key=repr)
    none = fim.fim_digests(docs.limit(0))
    assert none.count() == 0 and none.columns == [
        "doc", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    some = fim.fim_digests(documents(spark, FIM), rate=50, spm=0, seed=11)
    assert {r.doc: r.form for r in some.collect()} == {i: brute_fim(i, t, 11, 50, 0)[1] for i, t in enumerate(FIM)}
    with pytest.raises(ValueError):
        fim.fim_pieces(docs, marks=("<P>", "<P>", "<M>"))


@pytest.mark.parametrize("cut", [1, 2, 3, 5, 1000])
def test_restoring_finds_marks_across_chunks(cut):
    for form, order in (("psm", "PSM"), ("spm", "SPM")):
        parts = {"P": "<<", "S": "S><M", "M": ">P<"}
        output = "".join(f"<{m}>{parts[m]}" for m in order).encode()
        restorer = fim._Restorer(form, fim.MARKS)
        found = {0: b"", 1: b"", 2: b""}
        for at in range(0, len(output), cut):
            for section, data in restorer.feed(output[at : at + cut]):
                found[section] += data
        for section, data in restorer.feed(b"", last=True):
            found[section] += data
        assert found == {0: b"<<", 1: b">P<", 2: b"S><M"}


def test_fim_shuffles_texts_once(spark):
    plan = fim.fim_digests(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 3


# ------------------------------------------------------------ 12: filter audit
def brute_audit(rows, labels):
    """rows: (doc, text, part); labels: (doc, quality, toxic)."""
    rows = [(d, t or "", p or "") for d, t, p in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, x in labels if x == 1 and d is not None}
    fails = []
    for d, t, p in rows:
        w = WORD.findall(t)
        copies = [e for e, u, _ in rows if u == t and e is not None and d is not None and e < d]
        fails.append({c for c, f in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": bool(copies)}.items() if f})
    out = []
    for part in {p for _, _, p in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if r[2] == part]
        shares = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shares[c] += len(gone)
                found.append([
                    part, "".join(order), step, len(left), len(gone), sum(c in f for _, f in own) - len(gone),
                    sum(f == {c} for _, f in own), sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone)])
        out += [(*f, shares[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame(
        [(*r, "s", False) for r in rows], "doc_id long, text string, lang string, cell string, quality boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit(docs, marks).collect())


def test_audit_equals_brute_force(spark):
    texts = [*ODD, "Word " * 300, "word " * 300, "A#b", "A#b", "A#b", " ".join(f"w{i}" for i in range(250)),
             " ".join(f"W{i}" for i in range(250)), "%" + " ".join(f"W{i}" for i in range(250)), LONG]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [(40, "A#b", "en"), (40, "A#b", "en"), (40, "A#b", "de"), (None, "A#b", "en"), (None, "A#b", "fr"),
             (3, "A#b", "es"), (3, "A#b", "es"), (50, None, None), (None, None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 45)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (99, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    assert audited(spark, [(1, None, None)], []) == brute_audit([(1, None, None)], [])


def test_audit_moves_no_text(spark):
    docs, labels = documents(spark), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    plan = filter_audit(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join LeftOuter")]
    assert not re.search(r"\btext#", joined)


# ---------------------------------------------------------------- 13: toxicity
def test_windows_cover_texts(spark):
    rng = np.random.default_rng(5)
    texts = [b"", b"a", b"word " * 50, bytes(rng.integers(97, 123, 1000, np.uint8)), b"  \n " * 40, b"ab cd"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    bounds, doc = toxicity.windows(data, offsets)
    assert set(offsets) <= set(bounds) and np.diff(bounds).max() <= 2 * toxicity.WINDOW
    assert all(offsets[d] <= a and b <= offsets[d + 1] for a, b, d in zip(bounds[:-1], bounds[1:], doc, strict=True))


def test_saved_bytes_equal_one_by_one_compression():
    import zstandard

    found = toxicity.Dictionaries(b"the quick brown fox jumps over the lazy dog " * 20, b" vermin  parasites ")
    texts = [b"", b"the quick brown vermin over the lazy parasites dog " * 3, b"nothing of the kind " * 9]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    got = found.features(data, offsets)
    for i, t in enumerate(texts):
        own = toxicity._LOWER[np.frombuffer(t, np.uint8)] if t else np.zeros(0, np.uint8)
        bounds, _ = toxicity.windows(own, np.array([0, len(own)]))
        saved = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            size = []
            for content in (found.ordinary, found.toxic + found.ordinary):
                parameters = zstandard.ZstdCompressionParameters.from_level(
                    toxicity.LEVEL, window_log=17, min_match=toxicity.MATCH, strategy=zstandard.STRATEGY_BTLAZY2,
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                    format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size.append(len(zstandard.ZstdCompressor(
                    dict_data=dictionary, compression_params=parameters).compress(own[a:b].tobytes())))
            saved.append(size[0] - size[1])
        n = len(saved)
        expected = [max([0, *saved]), np.log1p(n)]
        hits = [sum(s >= k for s in saved) for k in toxicity.STEPS]
        assert np.allclose(got[i], expected + [np.log1p(h) for h in hits] + [h / max(n, 1) for h in hits])
    assert got[1][0] > 2 > got[2][0]


def test_toxicity_of_held_out_documents(spark):
    """Toxic documents that training hasn't seen are found, clean ones left alone."""
    found = op13_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic, clean = ([r.predicted for r in out if r.toxic == t] for t in (1, 0))
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.02
    english = " ".join(f"thing{i % 7} of the matter" for i in range(40))
    planted = [english, english.replace("thing3", "idiot moron"), None, ""]
    docs = corpus(spark, "/root/testdata/sf0.1").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(documents(spark, planted), model).collect()}
    assert scores[1] > 0.3 > scores[0] and scores[2] == scores[3] < 0.3


def test_toxicity_uses_no_other_column(spark, sf_dir):
    docs, labels = corpus(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    base = {r.doc_id: r.score for r in toxicity.toxicity(docs.select("doc_id", "text"), labels).collect()}
    # other ids of held-out rows, other languages, more columns, labels of held-out rows changed
    more = docs.selectExpr("doc_id", "text", "'xx' AS lang", "doc_id AS score", "1 AS predicted", "'a' AS row")
    other = labels.withColumn("toxic", toxicity.F.expr("if(crc32(cast(string(doc_id) AS binary)) % 4 = 2, 1 - toxic, toxic)"))
    rows = toxicity.toxicity(more, other).collect()
    assert {r.doc_id: r.score for r in rows} == base and set(rows[0].asDict()) == {
        "doc_id", "text", "lang", "score", "predicted", "row", "held_out"}


def test_toxicity_odd_rows(spark):
    schema = "doc_id long, quality int, toxic int"
    docs = documents(spark, [*ODD, "vermin " * 40])
    for labels in ([], [(3, 1, None)], [(3, 1, 1)], [(3, 0, 0), (4, 0, 0)], [(i, 0, i % 2) for i in range(30)] + [(None, 1, 1), (3, 1, 0)]):
        rows = toxicity.toxicity(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
        by = {r.doc_id: r.score for r in rows}
        assert by[0] == by[1] and by[5] == by[6]  # empty texts, equal texts
    none = toxicity.toxicity(docs.limit(0), spark.createDataFrame([(3, 1, 1)], schema))
    assert none.count() == 0
    twice = toxicity.toxicity(docs.unionByName(docs), spark.createDataFrame([(3, 0, 0)], schema))
    assert twice.count() == 2 * (len(ODD) + 1)
