"""Operators against brute force, and their defined results on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import chat, fingerprints, licenses, mixing, packing, quality, suffix_dedup, url_filter
from newsflow.llm.common import components
from newsflow.llm.jaccard import first_of_groups, jaccard_components
from newsflow.llm.ngram_model import score_held_out
from newsflow.llm.queries import op2_ngram_score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))
ODD = [None, "", " \n\t ", "one", "One  two", "a b c d e", "a b c d e", "Éa ß 漢字 \U0001f600 x", LONG, LONG + " end"]


def documents(spark, texts=ODD, **more):
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# ------------------------------------------------------------------ 5: join
def brute_components(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    for a, b in {(a, b) for own in by.values() for a in own for b in own if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard_equals_brute_force(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_components(docs).collect()}
    assert got == brute_components(texts_of(docs), 4, 85)


def test_jaccard_blocks_of_unlinked_members(spark, monkeypatch):
    # copies of one text with more and more words changed: linked in chains, not to the first
    from newsflow.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SETS", 6)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        own = list(base)
        for k in rng.choice(200, int(rng.integers(0, 12)), replace=False):
            own[k] = f"x{i}-{k}"
        texts.append(" ".join(own))
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_components(documents(spark, texts)).collect()}
    assert got == brute_components(dict(enumerate(texts)), 4, 85)


def test_jaccard_odd_rows(spark):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 5"))  # a repeated row
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_components(docs).collect()}
    assert got == brute_components(dict(enumerate(ODD)), 4, 85)
    kept = first_of_groups(docs, width=4, percent=85)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x)
    assert ids == [None, 0, 1, 2, 3, 4, 5, 5, 7, 8]  # 6 is a copy of 5, 9 is close to 8
    assert jaccard_components(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (20, 21), (30, 31), (31, 32), (32, 30), (4, 4)]
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in components(df).collect()} == {
        5: 4, 6: 4, 7: 4, 8: 4, 9: 4, 21: 20, 31: 30, 32: 30}
    assert components(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 4: suffix dedup
def brute_repeats(texts, length):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(b, mark) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out[d] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_equals_brute_force(spark, sf_dir, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = corpus(spark, sf_dir)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_repeats(texts_of(docs), 100)


def test_suffix_dedup_odd_rows(spark):
    texts = [*ODD, "é" * 150, "x" + "é" * 150, "ab" * 300]
    docs = documents(spark, texts).withColumn("n_spans", F.lit("clash"))
    out = suffix_dedup.suffix_dedup(docs.unionByName(docs.where("doc_id = 8")))
    rows = out.collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == brute_repeats(dict(enumerate(texts)), 100) and len(rows) == len(texts) + 1
    assert {r.text for r in rows if r.doc_id == 8} == {LONG}  # a repeated row is no repeat of itself
    assert sorted(out.columns) == sorted([*documents(spark).columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 9: quality
def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {k for i, x in enumerate(windows) if often[x] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_equals_brute_force(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    rows = quality.quality_rules(docs, drop=("text",)).collect()
    texts = texts_of(docs)
    assert {r.doc_id: tuple(r[c] for c in quality.STATS) for r in rows} == {d: brute_quality(t) for d, t in texts.items()}
    assert all(r.kept == (not r.base_failed) for r in rows)  # no host of the test data is bad


def test_quality_odd_rows(spark):
    loop = " ".join(["a b c d e f g h i"] * 9)
    texts = [*ODD, loop, "x y\n\nx y\n \n \nx y", "# * $ <|> %&" + " q" * 30, "q " * 8]
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("source", F.lit(None).cast("string"))
    out = quality.document_stats(docs)
    assert {r.doc_id: tuple(r[c] for c in quality.STATS) for r in out.collect()} == {
        i: brute_quality(t) for i, t in enumerate(texts)}
    assert quality.quality_rules(docs).count() == len(texts)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_bad_host_is_rejected_small_one_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 50 else "short", "en", f"good{i % 5}", 0) for i in range(300)]
    rows += [(1000 + i, good if i % 10 == 0 else "short", "en", "bad", 0) for i in range(100)]
    rows += [(2000, "short", "en", "tiny", 0), (2001, good, "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert not out[1000].kept and not out[1000].base_failed and 0.5 < out[1000].host_rate < 0.9
    assert out[2001].kept and out[2001].host_rate < 0.5
    assert out[1].kept


# ------------------------------------------------------------------ 10: fingerprints
def test_fingerprints(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    texts = texts_of(docs)
    order = sorted(texts, reverse=True)
    own = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    by_text = {}
    for i, d in enumerate(order):
        t, following = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        assert rows[d].n_chars == len(t) and rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[d].fingerprint == own[d] == by_text.setdefault(t, own[d])
        assert 0 <= rows[d].near_edited <= 1 and 0 <= rows[d].near_next <= 1
        if edited == t:
            assert rows[d].near_edited == 1
    long = [r for r in rows.values() if r.n_chars > 600]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.15



def test_likeness_falls_with_edits_and_sees_order(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 5000, 2000)]
    blocks = [words[i : i + 100] for i in range(0, 2000, 100)]
    moved = [w for b in reversed(blocks) for w in b]
    texts = [" ".join(words), " ".join(words[:1900] + ["x"] * 100), " ".join(words[:1000] + moved[:1000]), " ".join(moved)]
    df = documents(spark, texts).select("doc_id", fingerprints.order_minhash(F.col("text")).alias("s"))
    a = df.where("doc_id = 0").select(F.col("s").alias("a"))
    near = {r.doc_id: r.n for r in df.join(a).select("doc_id", fingerprints.likeness(F.col("s"), F.col("a")).alias("n")).collect()}
    assert near[0] == 1 and near[1] > 0.7
    assert near[3] < 0.7  # nearly the same k-mers, in another order: half of the pairs turn round
    assert near[1] > near[2]


@pytest.mark.parametrize("n", [30, 60, 120, 200])
def test_short_texts_see_order(spark, n):
    """Halves swapped: the likeness of order MinHash with its own permutation of all k-mers for each tuple."""
    rng = np.random.default_rng(n)
    cases, expected = [], []
    for case in range(60):
        words = [f"w{case}x{i}" for i in rng.permutation(n)]
        pair = words, words[n // 2 :] + words[: n // 2]
        cases.append((*[" ".join(w) for w in pair],))
        a, b = [{tuple(w[i : i + 3]): i for i in range(n - 2)} for w in pair]
        both = sorted(a.keys() | b.keys())
        for _ in range(64):
            drawn = [both[i] for i in rng.permutation(len(both))]
            own = [sorted([k for k in drawn if k in x][:2], key=x.get) for x in (a, b)]
            expected.append(own[0] == own[1])
    df = spark.createDataFrame(cases, "a string, b string")
    a, b = [fingerprints.order_minhash(F.col(c)) for c in "ab"]
    got = df.select(a.alias("a"), b.alias("b")).select("a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).collect()
    assert all([x >> 32 for x in r.a] == list(range(64)) for r in got)
    assert np.mean([r.n for r in got]) == pytest.approx(np.mean(expected), abs=0.06)


def test_selected_tuples_equal_brute_force(spark):
    """Two k-mers from each bin's start on, around the circle of hashes."""
    texts = ["a", "a b c d", " ".join(f"v{i}" for i in range(40)), "a b c " * 20, LONG[:20_000]]
    df = documents(spark, texts).select(
        fingerprints.numbered(fingerprints.kmers(F.col("text"))).alias("k"), fingerprints.order_minhash(F.col("text")).alias("s"))
    rows = df.collect()
    chosen, names = [], []
    for r in rows:
        hashes = [((x >> 31) + (1 << 32), x & fingerprints.PLACE) for x in r.k]
        for b in range(64):
            near = sorted(hashes, key=lambda x: (x[0] - (b << 27)) % (1 << 33))[:2]
            chosen.append(([h - (1 << 32) & (1 << 33) - 1 for h, _ in sorted(near, key=lambda x: x[1])],))
        names += [(b << 32, x) for b, x in enumerate(r.s)]
    hashed = spark.createDataFrame(chosen, "c array<bigint>").select(F.xxhash64("c")).collect()
    assert [x for _, x in names] == [b | h[0] & 0xFFFFFFFF for (b, _), h in zip(names, hashed, strict=True)]


def test_occurrences_are_numbered(spark):
    texts = ["a b c " * 5, "a b c " * 6, "a b c"]
    got = documents(spark, texts).select("doc_id", fingerprints.numbered(fingerprints.kmers(F.col("text"))).alias("k")).collect()
    for r in got:
        assert len({x >> 31 for x in r.k}) == len(r.k) == len(texts[r.doc_id].split()) - 2


def test_fingerprint_odd_rows(spark):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 5"))
    docs = docs.unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert len(rows) == len(ODD) + 2
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[1].fingerprint == "" and by[1].near_next == 1
    assert by[5].fingerprint == by[6].fingerprint and by[None].edited_sha256 is None
    assert by[8].near_next < 0.1 and by[9].near_next > 0.9
    one = fingerprints.edited_fingerprints(docs.where("doc_id = 8")).first()
    assert one.near_next == 1  # its own next document
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 7: URLs
def test_hosts_paths_rules(spark):
    cases = {
        "https://A.Example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://b.www.example.com/en/1#f": ("b.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "https://x.net/ES/1": ("x.net", "/ES/1", None, None),
        "https://notcom": ("notcom", "", None, None),
        "https://x.com": ("x.com", "", None, None),
        "https://com/": ("com", "/", "com/", "allow"),
        "https://x.org?a=http://y.com/": ("x.org", "", None, None),
        "ftp://h\u00c9.com/p?x": ("h\u00c9.com", "/p", "com/", "allow"),
        "no scheme.com/": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    rule, verdict = url_filter.first_rule(F.col("host"), F.col("path"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in df.withColumns({"rule": rule, "verdict": verdict}).orderBy("page_id").collect()]
    assert got == list(cases.values())


def test_markov_scores_equal_brute_force(spark):
    grams = {"^^^a": (5, 0), "^^ab": (3, 1), "^aba": (0, 4), "abab": (2, 2), "^^^b": (1, 7), "zzzz": (0, 0)}
    df = spark.createDataFrame([(g, *c) for g, c in grams.items()], "gram string, accepted long, rejected long")
    got = {r.gram: r.score for r in url_filter.markov_scores(df).collect()}
    for g in grams:
        p = []
        for side in (0, 1):
            low = 1 / url_filter.SYMBOLS
            for k in range(4):
                tails = Counter()
                for other, c in grams.items():
                    if other[3 - k : 3] == g[3 - k : 3]:
                        tails[other[3]] += c[side]
                seen, types = sum(tails.values()), sum(v > 0 for v in tails.values())
                low = (tails[g[3]] + types * low) / (seen + types) if seen else low
            p.append(low)
        assert got[g] == pytest.approx(np.log(p[0]) - np.log(p[1]))


def test_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.lit(1).alias("host"))
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "https://x.org/\u6f22" + "y" * 5000), (-2, "https://x.org/1")],
                                "page_id long, url string").withColumn("host", F.lit(1))
    rows = url_filter.url_filter(pages.unionByName(odd)).collect()
    assert len(rows) == pages.count() + 4 and all(r.verdict in ("allow", "block") for r in rows)
    again = {r.page_id: r.verdict for r in url_filter.url_filter(pages.unionByName(odd)).collect()}
    assert again == {r.page_id: r.verdict for r in rows}
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_url_model_tells_held_out_urls_apart(spark):
    """Without its rules' verdicts, the method agrees with them on most URLs."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = url_filter.url_filter(pages).where("rule IS NOT NULL AND pmod(crc32(cast(url AS binary)), 5) = 0").collect()
    right = {v: [(r.score >= 0) == (v == "allow") for r in rows if r.verdict == v] for v in ("allow", "block")}
    assert np.mean([np.mean(x) for x in right.values()]) > 0.9


# ------------------------------------------------------------------ 1: chat
def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "\\\\[INST]\\", "[[INST]]", "<<s>>", "", None, "[", "<", "[INST", "]\n",
              "[ROLE]x[TEXT]y[/ROLE]", "\\[/INST]", "é漢\U0001f600"]
    roles = ["user", "assistant", "system", "tool", None, "[ROLE]", "", "a\\b"]
    rows = [(c, t, roles[(c + t) % len(roles)], tricky[(c * 7 + t) % len(tricky)]) for c in range(8) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("segments")))
    for r in out.collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(b.role, b.text) for b in r.back] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_rows == len(own)


def test_chat_state_machine(spark, monkeypatch):
    good = ["system", "user", "assistant", "user", "assistant"]
    cases = {1: good, 2: good[1:], 3: good[:4], 4: ["assistant"], 5: ["user", "user", "assistant"], 6: good[1:] * 300,
             7: ["user", "tool", "assistant"], 8: [None]}
    rows = [(c, t, r, "x") for c, own in cases.items() for t, r in enumerate(own)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.first_error) for r in chat.format_conversations(df).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, None), 4: (False, 0), 5: (False, 1), 6: (True, None),
                   7: (False, 1), 8: (False, 0)}


def test_chat_odd_rows(spark):
    rows = [(None, None, "user", "a"), (None, 1, "assistant", "b"), (0, 5, "user", "x"), (0, 5, "user", "x"), (0, -1, "user", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert got == {None: "[INST]a[/INST]<s>b</s>", 0: "[INST]w[/INST][INST]x[/INST][INST]x[/INST]"}
    assert chat.format_conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(turns={"user": chat.Turn("<a>", "</a><b>")})


# ------------------------------------------------------------------ 3: licenses
def test_licenses_equal_brute_force(spark, sf_dir):
    docs = corpus(spark, sf_dir)

    def shingles(t):
        w = [x for x in re.split("[^a-z0-9]+", (t or "").translate(LOWER)) if x]
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    notices = {k: shingles(v) for k, v in licenses.NOTICES.items()}
    expected = set()
    for d, t in texts_of(docs).items():
        own = shingles(t)
        expected |= {(d, k, len(own & s)) for k, s in notices.items() if len(own & s) >= 0.8 * len(s)}
    rows = licenses.license_scan(docs).collect()
    assert {(r.doc_id, r.license, r.n_found) for r in rows} == expected and expected


def test_usual_notices_are_found(spark):
    gpl = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public"
           " License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
           " any later version.")
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    cases = {
        gpl.format("program", ""): {"GPL-header"},
        gpl.format("library", "Lesser "): {"LGPL-header"},
        gpl.format("program", "Affero "): {"AGPL-header"},
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": {"MPL-2.0"},
        cc.format(""): {"CC-BY-4.0"}, cc.format("-ShareAlike"): {"CC-BY-SA-4.0"},
        cc.format("-NonCommercial"): {"CC-BY-NC-4.0-long"}, cc.format("-NonCommercial-ShareAlike"): set(),
        "Licensed under CC BY 4.0.": {"CC-BY-4.0-short"}, "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"},
        "Dedicated under CC0 1.0 Universal Public Domain Dedication.": {"CC0-1.0"},
        "This is free and unencumbered software released into the public domain.": {"Unlicense"},
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice appears in all copies.": {"ISC"},
        "Released under the GNU General Public License, version 2.": {"GPL-2.0-short"},
    }
    around = " ".join(f"w{i}" for i in range(100))
    rows = licenses.license_scan(documents(spark, [f"{around} {t} {around}" for t in cases])).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add(r.license)
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    alone = licenses.license_scan(documents(spark, list(licenses.NOTICES.values()))).where("containment = 1").collect()
    assert {r.license for r in alone if r.license == list(licenses.NOTICES)[r.doc_id]} == set(licenses.NOTICES)
    with pytest.raises(ValueError, match="shingles"):
        licenses.license_scan(documents(spark), notices={"x": "two words"})


def test_licenses_odd_rows(spark):
    line = "Released under the MIT License."
    docs = documents(spark, [*ODD, line, "x " * 5000 + line.upper() + " y" * 5000, line + "\n" + line, "released under the"])
    rows = licenses.license_scan(docs.unionByName(docs.where("doc_id = 10")).withColumn("license", F.lit(0))).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(10, "MIT"), (10, "MIT"), (11, "MIT"), (12, "MIT")]
    assert licenses.license_scan(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 2: language model
def brute_model(texts, held):
    train = [[*WORD.findall((t or "").translate(LOWER)), None] for d, t in texts.items() if d not in held]
    uni, bi, tri = Counter(), Counter(), Counter()
    for w in train:
        uni.update(w)
        padded = ["<", *w]
        bi.update(zip(padded, padded[1:]))
        tri.update(zip(padded, padded[1:], padded[2:]))
    n, v = sum(uni.values()), len(uni)
    bi = {k: c for k, c in bi.items() if c >= 2}
    tri = {k: c for k, c in tri.items() if c >= 2}
    d = 0.75
    left = defaultdict(lambda: 1.0)
    for (a, _), c in bi.items():
        left[a] -= (c - d) / (uni[a] if a != "<" else len(train))
    left2 = defaultdict(lambda: 1.0)
    for (a, b, _), c in tri.items():
        left2[a, b] -= (c - d) / bi[a, b]

    def p1(w):
        return (uni[w] + 1) / (n + v + 1)

    def p2(a, w):
        seen = uni[a] if a != "<" else len(train)
        own = (bi[a, w] - d) / seen if (a, w) in bi else 0
        return own + left[a] * p1(w)

    def p3(a, b, w):
        own = (tri[a, b, w] - d) / bi[a, b] if (a, b, w) in tri else 0
        return own + left2[a, b] * p2(b, w)

    out = {}
    for doc, t in texts.items():
        w = [*WORD.findall((t or "").translate(LOWER)), None]
        padded = ["<", *w]
        base = sum(np.log10(p1(x)) for x in w)
        score = np.log10(p2("<", w[0])) + sum(np.log10(p3(*padded[i : i + 3])) for i in range(len(w) - 1))
        out[doc] = (len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out


def test_ngram_scores_equal_brute_force(spark, sf_dir):
    import zlib

    docs = corpus(spark, sf_dir)
    texts = texts_of(docs)
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    expected = brute_model(texts, held)
    rows = score_held_out(docs.select("doc_id", "text"), least=2).collect()
    assert {r.doc_id for r in rows if r.held_out} == held
    for r in rows:
        n, known, total, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-12)
        assert r.score == pytest.approx(score, abs=n * 0.001)  # quantised
    outside = [r for r in rows if r.held_out]
    assert sum(r.score for r in outside) > sum(r.base_score for r in outside)


def test_ngrams_seen_once_count(spark, tmp_path):
    """The query's model against probabilities from the counts of all n-grams."""
    import zlib

    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    free = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    texts = {free[0]: "a b c d a b e", free[1]: "c a b c", held: "a b e c d"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    train = [[*texts[i].split(), "$"] for i in free]
    uni, bi, tri = Counter(), Counter(), Counter()
    for w in train:
        uni.update(w)
        bi.update(zip(["<", *w], w))
        tri.update(zip(["<", *w], w, w[1:]))
    n, v, d = sum(uni.values()), len(uni), 0.75

    def mixed(counts, context, word, lower):
        own = {g[-1]: c for g, c in counts.items() if g[:-1] == context}
        seen = sum(own.values())
        return (max(own.get(word, 0) - d, 0) + d * len(own) * lower) / seen if seen else lower

    def p2(a, w):
        return mixed(bi, (a,), w, (uni[w] + 1) / (n + v + 1))

    for r in op2_ngram_score(spark, str(tmp_path)).collect():
        w = [*texts[r.doc_id].split(), "$"]
        expected = p2("<", w[0]) * np.prod([mixed(tri, (a, b), c, p2(b, c)) for a, b, c in zip(["<", *w], w, w[1:])])
        assert r.score == pytest.approx(np.log10(expected), abs=len(w) * 0.001)


def test_ngram_odd_rows(spark):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 5"))
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("score", F.lit("x"))
    rows = score_held_out(docs).collect()
    assert len(rows) == len(ODD) + 2 and all(r.n_tokens == len(WORD.findall(ODD[r.doc_id or 0] or "")) + 1 for r in rows)
    assert all(r.score < 0 for r in rows)
    assert score_held_out(docs.limit(0)).count() == 0
    alone = docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))
    assert score_held_out(alone).first().n_known == 30_001


# ------------------------------------------------------------------ 8: mixing
def test_raking_meets_targets(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    targets = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, "source": {"src0": 0.1}}
    marked, mix = mixing.described(docs)
    cells = marked.groupBy(*[F.col(mix)[d].alias(d) for d in mixing.DIMENSIONS]).agg(F.sum(F.col(mix)["tokens"]).alias("tokens"))
    raked = mixing.rake(cells, targets)
    total = cells.agg(F.sum("tokens")).first()[0]
    mass = F.sum(F.col("tokens") * F.col("weight")) / total
    lang = {r.lang: r.m for r in raked.groupBy("lang").agg(mass.alias("m")).collect()}
    source = {r.source: r.m for r in raked.groupBy("source").agg(mass.alias("m")).collect()}
    assert lang == pytest.approx(targets["lang"], abs=1e-3) and source["src0"] == pytest.approx(0.1, abs=1e-3)
    # the same weights as plain proportional fitting
    rows = cells.collect()
    goals = {d: {r[d]: r.share for r in mixing._targets(cells, d, targets.get(d)).collect()} for d in mixing.DIMENSIONS}
    weight = {i: 1.0 for i in range(len(rows))}
    for _ in range(200):
        for d in mixing.DIMENSIONS:
            margin = Counter()
            for i, r in enumerate(rows):
                margin[r[d]] += r.tokens * weight[i]
            for i, r in enumerate(rows):
                weight[i] *= goals[d][r[d]] * total / margin[r[d]]
    expected = {tuple(r[d] for d in mixing.DIMENSIONS): weight[i] for i, r in enumerate(rows)}
    got = {tuple(r[d] for d in mixing.DIMENSIONS): r.weight for r in raked.collect()}
    assert got == pytest.approx(expected, rel=2e-2)
    assert {r.deviation <= mixing.TOLERANCE for r in raked.select("deviation").distinct().collect()} == {True}


def test_raking_reports_targets_that_contradict(spark):
    # language and topic say the same thing, their targets don't
    cells = spark.createDataFrame(
        [("a", "en", "x", 30), ("b", "en", "x", 10), ("a", "de", "y", 20), ("b", "de", "y", 40)],
        "source string, lang string, topic string, tokens long")
    raked = mixing.rake(cells, {"lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.8, "y": 0.2}}).collect()
    assert {round(r.deviation, 6) for r in raked} == {round((0.8 - 0.5) / 0.5, 6)}


def test_probabilities_match_the_exact_scale(spark):
    rng = np.random.default_rng(3)
    rows = [(int(n), float(w)) for n, w in zip(rng.integers(1, 90, 80), rng.lognormal(0, 2, 80), strict=True)]
    got = mixing.probabilities(spark.createDataFrame(rows, "tokens long, weight double"), 0.8).collect()
    want = 0.8 * sum(n for n, _ in rows)
    low, high = 0.0, 1e9
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(n * min(1, middle * w) for n, w in rows) < want else (low, middle)
    assert sorted(r.probability for r in got) == pytest.approx(sorted(min(1.0, low * w) for _, w in rows), rel=1e-9)


def test_mixing_draw(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(0 < r.probability <= 1 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(mixing.SHARE * total, rel=1e-6)
    assert sum(r.n_tokens for r in rows if r.sampled) == pytest.approx(mixing.SHARE * total, rel=0.1)
    assert all(r.sampled for r in rows if r.probability == 1)


def test_mixing_odd_rows(spark):
    docs = documents(spark).unionByName(documents(spark).where("doc_id < 3").withColumn("source", F.lit(None).cast("string")))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("weight", F.lit("clash"))
    rows = mixing.mix_sources(docs, targets={"lang": {"en": 1.0, "xx": 0.0}}).collect()
    assert len(rows) == len(ODD) + 3
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    topic = documents(spark, ["The LICENSE, please", "call my phone now license", "nothing", None])
    assert [r.topic for r in mixing.mix_sources(topic).orderBy("doc_id").collect()] == ["legal", "contact", "other", "other"]


# ------------------------------------------------------------------ 6: packing
@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    from itertools import combinations

    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
    counts = rng.integers(1, 30, 9)
    got = packing.optimal_bounds(lengths, counts, 4)

    def padding(bounds):
        return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

    best = min(padding((*c, lengths[-1])) for k in range(4) for c in combinations(lengths[:-1], k))
    assert len(got) <= 4 and got[-1] == lengths[-1] and padding(got) == best
    assert packing.optimal_bounds(lengths[:0], counts[:0], 4) == []


def test_packing(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)  # several parts to number
    docs = corpus(spark, sf_dir)
    rows = packing.pack(docs, max_tokens=256, budget=2048).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.n_tokens))
    for d, t in texts_of(docs).items():
        n = len(WORD.findall(t or "")) + 1
        assert sorted(pieces[d]) == [(k, k * 256, min(256, n - k * 256)) for k in range(-(-n // 256))]
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded_to
        batches[r.bucket, r.padded_to, r.batch_id].append(r.slot)
    partial = Counter()
    for (bucket, bound, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bound <= 2048
        partial[bucket] += len(slots) < 2048 // bound
    assert max(partial.values()) <= 1


def test_packing_odd_rows(spark):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 8")).withColumn("bucket", F.lit("clash"))
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.pack(docs).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(WORD.findall(t or "")) + 1 for t in [*ODD, LONG, None])
    assert len({(r.batch_id, r.slot) for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, budget=10)
