"""Numpy kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from newsflow.llm import kernels as K
from newsflow.llm.array_files import map_arrays, write_arrays
from newsflow.llm.elias_fano import EliasFano
from newsflow.llm.prefix_tree import PrefixTree
from newsflow.llm.run_index import RunIndex
from newsflow.llm.setjoin_kernels import segment_signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_hashes():
    texts = ["", "a", " a  B\tb\n", "été é\u00a0x", None, "  ", "a b c d e f a b c d", "x\x0by\x0cz"]
    data, offsets = K.buffers(pa.array(texts))
    starts, ends, first = K.words(data, offsets)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
        assert got == WORD.findall(text or "")
    hashes, first = K.word_hashes(data, offsets)
    assert hashes[first[1]] == hashes[first[2]] and hashes[first[2] + 1] == hashes[first[2] + 2]
    grams, start = K.shingles(hashes, first, 4)
    assert np.diff(start).tolist() == [0, 1, 1, 1, 0, 0, 7, 1]
    assert grams[start[6]] == grams[start[6] + 6]


def test_word_hashes_do_not_depend_on_the_batch():
    one, _ = K.word_hashes(*K.buffers(pa.array(["needle"])))
    many, _ = K.word_hashes(*K.buffers(pa.array(["hay hay", "and a needle", "x"])))
    assert one[0] == many[4]


@pytest.mark.parametrize("seed", range(4))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    top = [50, 5000, 1 << 40, (1 << 64) - 1][seed]
    values = np.sort(rng.integers(0, top, 2000, dtype=np.uint64, endpoint=True))
    e = EliasFano.of(values)
    assert (e.get(np.arange(2000)) == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
    place = e.search(asked, np.zeros(2500, np.int64), np.full(2500, 2000))
    for v, p in zip(asked, place):
        assert (values[p] == v) if p >= 0 else (v not in values)
    assert (e.search(values[500:510], np.full(10, 1500), np.full(10, 2000)) >= 1500).sum() == np.isin(
        values[500:510], values[1500:]).sum()
    assert EliasFano.of(np.zeros(0, np.uint64)).search(values[:3], np.zeros(3, int), np.zeros(3, int)).tolist() == [-1] * 3


def test_opening_a_mapped_sequence_copies_nothing(tmp_path):
    """A task opens every shard it touches: what isn't asked for must not be read or copied."""
    values = np.cumsum(np.random.default_rng(5).integers(0, 900, 3000)).astype(np.uint64)
    write_arrays(f"{tmp_path}/e", EliasFano.of(values).parts)
    e = EliasFano(map_arrays(f"{tmp_path}/e"))
    held = [a for a in vars(e).values() if isinstance(a, np.ndarray)]
    assert held and all(any(np.shares_memory(a, p) for p in e.parts.values()) for a in held)
    for kind in (np.uint32, np.uint64):  # counts of short and of very long sequences
        parts = e.parts | {k: e.parts[k].astype(kind) for k in ("count", "zeros")}
        assert (EliasFano(parts).get(np.arange(3000)) == values).all()
        asked = np.concatenate([values[::7], values[-1:] + np.arange(1, 9, dtype=np.uint64), [np.uint64(2**64 - 1)]])
        place = EliasFano(parts).search(asked, np.zeros(len(asked), np.int64), np.full(len(asked), 3000))
        assert (place >= 0).tolist() == np.isin(asked, values).tolist()
    assert "zeros" not in EliasFano.of(values, searched=False).parts


def test_array_files(tmp_path):
    arrays = {"a": np.arange(5), "none": np.zeros(0, np.uint16), "b": np.array([7], np.uint8)}
    for uri in (f"file://{tmp_path}/x/y", f"{tmp_path}/x/z"):
        write_arrays(uri, arrays)
        back = map_arrays(uri)
        assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in arrays.items())


def _mutated(rng, base, universe):
    out = set(base.tolist())
    for _ in range(rng.integers(0, max(1, len(out) // 6) + 1)):
        if out and rng.random() < 0.5:
            out.discard(int(rng.choice(list(out))))
        else:
            out.add(int(rng.integers(0, universe)))
    return np.array(sorted(out), np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_prefix_tree(seed):
    rng = np.random.default_rng(seed)
    universe = int(rng.integers(5, 400))
    bases = [np.unique(rng.integers(0, universe, rng.integers(0, 200))) for _ in range(4)]
    a = [_mutated(rng, bases[rng.integers(4)], universe) for _ in range(rng.integers(0, 30))]
    b = [_mutated(rng, bases[rng.integers(4)], universe) for _ in range(rng.integers(0, 30))]
    expected = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b)
                if len(x) and len(y) and 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))]
    assert sorted(PrefixTree(a).links(b, universe, 85)) == expected


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(60):
        n = int(rng.integers(1, 90))
        base = K.mix(rng.integers(0, 1 << 62, n).astype(np.uint64))
        sets = [np.unique(base)]
        for _ in range(12):
            own = set(base.tolist())
            for _ in range(rng.integers(0, max(1, n // 10) + 1)):
                if rng.random() < 0.5 and len(own) > 1:
                    own.discard(next(iter(own)))
                else:
                    own.add(int(K.mix(rng.integers(0, 1 << 62, 1).astype(np.uint64))[0]))
            sets.append(np.array(sorted(own), np.uint64))
        start = np.cumsum([0, *map(len, sets)])
        signature, owner = segment_signatures(np.concatenate(sets), start, percent)
        of = [set(signature[owner == i].tolist()) for i in range(len(sets))]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    assert of[i] & of[j]


@pytest.mark.parametrize("seed", range(12))
def test_run_index(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(3, 12))
    base = rng.integers(0, 3, 60).astype(np.uint8).tobytes()
    texts = []
    for _ in range(rng.integers(1, 20)):
        a = int(rng.integers(0, 50))
        t = bytearray(base[a : a + rng.integers(0, 40)])
        if t and rng.random() < 0.6:
            t[rng.integers(len(t))] = 7
        texts.append(bytes(t))
    got = [x.tolist() for x in RunIndex(texts, length).long_matches()]
    seen, expected = set(), []
    for t in texts:
        own = []
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                own.append(i)
            seen.add(t[i : i + length])
        expected.append(own)
    assert got == expected


def test_runs_are_fewer_than_symbols_in_repetitive_text():
    text = bytes(np.random.default_rng(0).integers(97, 123, 400).astype(np.uint8))
    index = RunIndex([text] * 50, 100)
    assert len(index.run) < 50 * 401 / 20
