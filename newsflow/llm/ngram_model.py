"""N-gram language model in an Elias-Fano trie, trained and queried by Spark tasks.

Levels of the trie, each cut into shards by parent range, one file per shard in
the shared folder:

* level 1: hashes of all training words and the end mark (Elias-Fano), their
  counts as a running sum (Elias-Fano);
* level k: for each parent node a monotone pointer to its first child, the
  children's words, their running counts, their probabilities in 16 bits, and
  the parents' back-off weights in 16 bits.

From level 3 on a word is stored relative to its context: as its place among
the successors of the context without its first word.  Values of a parent start
from the last value of the parent before, so a whole level is one monotone
sequence.  All n-grams are kept; a caller may
ask for those of two and more words from ``least`` occurrences on.

Probabilities are interpolated with absolute discounts down to add-one unigrams,
and what pruning takes off goes to the back-off weight, so every distribution
sums to one over the vocabulary and one unknown word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import kernels as K
from newsflow.llm.array_files import map_arrays, write_arrays
from newsflow.llm.common import text_batches, travels
from newsflow.llm.elias_fano import EliasFano
from newsflow.session import fresh_path

travels(__name__)
travels("newsflow.llm.array_files")
travels("newsflow.llm.elias_fano")
travels("newsflow.llm.kernels")

ORDER = 3
DISCOUNT = 0.75
LEAST = 1  # occurrences of a kept n-gram of two or more words, unless the caller says otherwise
UNIT = 1 / 2048  # of a quantised log10 probability; the smallest is -32
END = np.uint64(0x8F1BBCDCBFA53E0B)  # hash of the end mark; words have other hashes
HELD = 3 << 20  # distinct n-grams a task holds before it hands them on


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / UNIT), 0, 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * -UNIT


def tokens(batch: pa.RecordBatch, column: int):
    """Per block of documents: rows, word hashes with an end mark after each
    document, and the first token of each document."""
    data, offsets = K.buffers(batch.column(column))
    for first, last in K.blocks(offsets):
        hashes, start = K.word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        n = last - first
        out = np.empty(len(hashes) + n, np.uint64)
        at = start + np.arange(n + 1)  # one end mark for each document before
        is_end = np.zeros(len(out), bool)
        is_end[at[1:] - 1] = True
        out[is_end] = END
        out[~is_end] = hashes
        yield slice(first, last), out, at


# ------------------------------------------------------------ counted n-grams
def _planes(a: np.ndarray) -> bytes:
    """Bytes by significance: the high ones of small numbers compress to nothing."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _from_planes(raw: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def _merged(keys: np.ndarray, counts: np.ndarray, extra: np.ndarray | None = None):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    summed = np.add.reduceat(counts, head) if len(head) else counts
    return keys[head], summed, None if extra is None else extra[order][head]


def _handed_on(keys, counts, extra, shard_of) -> pa.RecordBatch:
    shard = shard_of(keys)
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    ends = np.append(cut[1:], len(keys))
    rows = []
    for a, b in zip(cut, ends, strict=True):
        own = keys[a:b]
        rows.append((int(shard[a]), b - a, _planes(np.diff(own, prepend=np.uint64(0))),
                     _planes(counts[a:b].astype(np.uint32)), b"" if extra is None else extra[a:b].tobytes()))
    names, kinds = ("shard", "n", "keys", "counts", "extra"), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))


COUNTED = "shard bigint, n bigint, keys binary, counts binary, extra binary"


def _counting(pieces, shard_of, with_extra=False):
    """Sum (keys, extra) pieces of a task and hand them on in sorted blobs."""
    held, size = [], 0

    def flush():
        keys = np.concatenate([h[0] for h in held])
        counts = np.concatenate([h[1] for h in held])
        extra = np.concatenate([h[2] for h in held]) if with_extra else None
        return _merged(keys, counts, extra)

    for keys, extra in pieces:
        if not len(keys):
            continue
        held.append(_merged(keys, np.ones(len(keys), np.int64), extra))
        size += len(held[-1][0])
        if size > HELD:
            held = [flush()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield _handed_on(*held[0], shard_of)
                held, size = [], 0
    if held:
        yield _handed_on(*flush(), shard_of)


def _gathered(table: pa.Table, with_extra=False):
    keys, counts, extra = [], [], []
    for row in table.select(["n", "keys", "counts", "extra"]).to_pylist():
        keys.append(np.cumsum(_from_planes(row["keys"], row["n"], np.uint64), dtype=np.uint64))
        counts.append(_from_planes(row["counts"], row["n"], np.uint32).astype(np.int64))
        if with_extra:
            extra.append(np.frombuffer(row["extra"], np.uint16))
    return _merged(np.concatenate(keys), np.concatenate(counts), np.concatenate(extra) if with_extra else None)


def _stored(parts: dict[str, EliasFano | np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, p in parts.items():
        if isinstance(p, EliasFano):
            out |= {f"{name}.{k}": v for k, v in p.parts.items()}
        else:
            out[name] = p
    return out


def _sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k.partition(".")[2]: v for k, v in arrays.items() if k.startswith(name + ".")})


# ---------------------------------------------------------------- the model
class Model:
    """Where the levels lie and how many nodes their shards have; the files
    themselves are opened by whoever looks something up."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.total = 0  # training tokens
        self.texts = 0  # training documents
        self.nodes: list[list[int]] = []  # per level, nodes of each shard
        self.span: list[int] = []  # per level from 2 on, parents of a shard
        self._open: dict[tuple[int, int], dict] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def path(self, level: int, shard: int) -> str:
        return f"{self.folder}/level-{level}-{shard}"

    def first(self, level: int) -> np.ndarray:
        return np.cumsum([0, *self.nodes[level - 1]])

    @property
    def vocabulary(self) -> int:
        return sum(self.nodes[0])

    def level(self, level: int, shard: int) -> dict:
        key = (level, shard)
        if key not in self._open:
            if not self.nodes[level - 1][shard] and level == 1:
                self._open[key] = {}
            else:
                a = map_arrays(self.path(level, shard))
                names = ("hash", "sum") if level == 1 else ("pointer", "word", "sum")
                self._open[key] = {n: _sequence(a, n) for n in names} | {
                    k: a[k] for k in ("probability", "backoff") if k in a}
        return self._open[key]

    def _by_shard(self, shard: np.ndarray):
        """Ranges of equal shards in a sorted array."""
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        for a, b in zip(cut, np.append(cut[1:], len(shard)), strict=True) if len(shard) else ():
            yield int(shard[a]), slice(int(a), int(b))

    def hash_shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        first = self.first(1)
        for shard, at in self._by_shard(self.hash_shard(hashes)):
            if not self.nodes[0][shard]:
                continue
            level = self.level(1, shard)
            n = at.stop - at.start
            place = level["hash"].search(hashes[at], np.zeros(n, np.int64), np.full(n, level["hash"].n))
            known = place >= 0
            ids[at] = np.where(known, place + first[shard], -1)
            own = place[known]
            if len(own):
                low, high = level["sum"].get(np.concatenate([own, own + 1])).astype(np.int64).reshape(2, -1)
                counts[np.flatnonzero(known) + at.start] = high - low
        return ids, counts

    def counts(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Counts of sorted node numbers."""
        first = self.first(level)
        out = np.zeros(len(nodes), np.int64)
        for shard, at in self._by_shard(np.searchsorted(first, nodes, "right") - 1):
            own = nodes[at] - first[shard]
            sums = self.level(level, shard)["sum"]
            out[at] = (sums.get(own + 1) - sums.get(own)).astype(np.int64)
        return out

    def children(self, level: int, parents: np.ndarray, words: np.ndarray):
        """Of sorted parents: node, place among its parent's children and
        quantised probability of each child; node -1 where there is none.  And
        the parents' quantised back-off weights."""
        node, place = np.full(len(parents), -1), np.full(len(parents), -1)
        q, backoff = np.zeros(len(parents), np.uint16), np.zeros(len(parents), np.uint16)
        span, first = self.span[level - 2], self.first(level)
        for shard, at in self._by_shard(parents // span):
            part = self.level(level, shard)
            own, of = _runs(parents[at] - shard * span)
            backoff[at] = part["backoff"][own][of]
            low, high = part["pointer"].get(np.concatenate([own, own + 1])).astype(np.int64).reshape(2, -1)
            some, sequence = np.flatnonzero(low < high), part["word"]
            if not len(some):
                continue
            base = np.zeros(len(own), np.uint64)
            base[some] = np.where(low[some] > 0, sequence.get(np.maximum(low[some] - 1, 0)), 0)
            use = np.flatnonzero((low < high)[of] & (words[at] >= 0))
            if not len(use):
                continue
            low, high, base = low[of[use]], high[of[use]], base[of[use]]
            found = sequence.search(base + words[at][use].astype(np.uint64), low, high)
            hit = found >= 0
            target = at.start + use[hit]
            node[target] = found[hit] + first[shard]
            place[target] = found[hit] - low[hit]
            q[target] = part["probability"][found[hit]]
        return node, place, q, backoff

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.vocabulary + 1))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of sorted values and each one's place among them."""
    head = np.append(True, values[1:] != values[:-1])
    return values[head], np.cumsum(head) - 1


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and each one's place among them; only the distinct are sorted."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[coded.indices.to_numpy()]


def _unique(*columns: np.ndarray):
    """Distinct sorted (a, b) pairs and each row's place among them."""
    key = columns[0].astype(np.uint64) << np.uint64(32) | columns[1].astype(np.uint64)
    distinct, back = np.unique(key, return_inverse=True)
    return (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64), back


def _identified(model: Model, hashes: np.ndarray):
    distinct, back = _distinct(hashes)
    ids, counts = model.words(distinct)
    return ids[back], counts[back]


def _contexts(model: Model, ids: np.ndarray, start: np.ndarray, reach: int) -> list[np.ndarray]:
    """The ``reach`` words before each token, nearest first; before a text
    stands its begin mark, whose id follows the vocabulary.  -2: nothing."""
    out, begin = [], model.vocabulary
    offset = np.arange(len(ids)) - np.repeat(start[:-1], np.diff(start))
    for k in range(1, reach + 1):
        before = np.full(len(ids), -2)
        before[k:] = ids[: len(ids) - k] if k <= len(ids) else before[k:]
        before = np.where(offset >= k, before, np.where(offset == k - 1, begin, -2))
        out.append(before)
    return out


def _chain(model: Model, ids: np.ndarray, start: np.ndarray, depth: int):
    """Walk all tokens down the trie to level ``depth``.

    Returns, per level from 2 on, node, place and quantised probability of the
    n-gram that ends at each token (node -1: not kept), and the back-off weight
    of its context, 0 where the context has no node.
    """
    contexts = _contexts(model, ids, start, depth - 1)
    levels = []
    parent, word = contexts[0] if depth > 1 else ids, ids
    for level in range(2, depth + 1):
        node, place = np.full(len(ids), -1), np.full(len(ids), -1)
        q, backoff = np.zeros(len(ids), np.uint16), np.zeros(len(ids), np.uint16)
        use = np.flatnonzero(parent >= 0)
        if len(use):
            a, b, back = _unique(parent[use], word[use] + 1)
            got = model.children(level, a, b - 1)
            for into, values in zip((node, place, q, backoff), got, strict=True):
                into[use] = values[back]
        levels.append((node, place, q, backoff))
        # next: the context is the n-gram before this token, the word its place under the shorter context
        parent, word = _one_back(node, start), place
    return levels


def _one_back(node: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each token what belongs to the one before it in its text, or -1."""
    out = np.full(len(node), -1)
    out[1:] = node[:-1]
    out[start[:-1]] = -1
    return out


# ------------------------------------------------------------------ training
def _count_words(model: Model):
    def run(batches):
        yield from _counting(
            ((hashes, None) for batch in batches for _, hashes, _ in tokens(batch, 0)), model.hash_shard)

    return run


def _build_words(model: Model):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts, _ = _gathered(table)
        write_arrays(model.path(1, shard), _stored({
            "hash": EliasFano.of(keys), "sum": EliasFano.of(np.concatenate([[0], np.cumsum(counts)]), searched=False)}))
        return pa.table({"shard": [shard], "nodes": [len(keys)], "tokens": [int(counts.sum())],
                         "texts": [int(counts[keys == END].sum())]})

    return run


def _count_grams(model: Model, level: int):
    span = model.span[level - 2]

    def pieces(batches):
        for batch in batches:
            for _, hashes, start in tokens(batch, 0):
                ids, counts = _identified(model, hashes)
                if level == 2:
                    parent, word = _contexts(model, ids, start, 1)[0], ids
                    lower = quantised(model.unigram(counts))
                else:
                    node, word, lower, _ = _chain(model, ids, start, level - 1)[-1]
                    parent = _one_back(node, start)
                use = (parent >= 0) & (word >= 0)
                yield parent[use].astype(np.uint64) << np.uint64(32) | word[use].astype(np.uint64), lower[use]

    def run(batches):
        yield from _counting(pieces(batches), lambda keys: ((keys >> np.uint64(32)) // np.uint64(span)).astype(np.int64), True)

    return run


def _build_grams(model: Model, level: int, least: int):
    span = model.span[level - 2]
    parents = model.vocabulary + 1 if level == 2 else sum(model.nodes[level - 2])

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts, lower = _gathered(table, True) if table.num_rows and table.column("n")[0].as_py() else (
            np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16))
        use = counts >= least
        keys, counts, lower = keys[use], counts[use], lower[use]
        first, n = shard * span, max(min(span, parents - shard * span), 0)
        parent = (keys >> np.uint64(32)).astype(np.int64) - first
        word = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = first + np.arange(n)
        if level == 2:
            seen = np.append(model.counts(1, at[at < model.vocabulary]), [model.texts] * int((at == model.vocabulary).sum()))
        else:
            seen = model.counts(level - 1, at)
        taken = np.bincount(parent, counts - DISCOUNT, minlength=n) if len(parent) else np.zeros(n)
        left = 1 - taken / np.maximum(seen, 1)  # > 0: each child leaves DISCOUNT, whatever is kept
        probability = (counts - DISCOUNT) / np.maximum(seen[parent], 1) + left[parent] * 10 ** restored(lower)
        pointer = np.searchsorted(parent, np.arange(n + 1))
        # a parent's values go on from the last one of the parent before
        top = np.zeros(n, np.int64)
        full = np.flatnonzero(np.diff(pointer))
        top[full] = word[pointer[full + 1] - 1]
        base = np.cumsum(top) - top
        write_arrays(model.path(level, shard), _stored({
            "pointer": EliasFano.of(pointer, searched=False), "word": EliasFano.of(base[parent] + word),
            "sum": EliasFano.of(np.concatenate([[0], np.cumsum(counts)]), searched=False),
            "probability": quantised(np.log10(probability)),
            "backoff": quantised(np.log10(np.maximum(left, 1e-30)))}))
        return pa.table({"shard": [shard], "nodes": [len(keys)]})

    return run


def train(texts: DataFrame, order: int = ORDER, least: int = LEAST) -> Model:
    """Model of the only column of ``texts``; nulls are empty texts.  N-grams of
    two and more words that occur less than ``least`` times are left out.

    Level by level: tasks count the n-grams of their documents, each shard sums
    its range and writes one file.  Only the shards' sizes come to the driver.
    """
    spark = texts.sparkSession
    text_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(fresh_path(spark, "ngrams"), shards)
    counted = texts.mapInArrow(_count_words(model), COUNTED).groupBy("shard").applyInArrow(
        _over(_build_words(model)), "shard bigint, nodes bigint, tokens bigint, texts bigint").collect()
    model.total, model.texts = sum(r["tokens"] for r in counted), sum(r["texts"] for r in counted)
    sizes = {r["shard"]: r["nodes"] for r in counted}
    model.nodes.append([sizes.get(s, 0) for s in range(shards)])
    if model.vocabulary >= 1 << 32:
        raise ValueError("more than 2**32 different words")
    for level in range(2, order + 1):
        parents = model.vocabulary + 1 if level == 2 else sum(model.nodes[level - 2])
        model.span.append(max(1, -(-parents // shards)))
        nothing = spark.range(shards).select(
            F.col("id").alias("shard"), F.lit(0).cast("bigint").alias("n"),
            *[F.lit(b"").alias(c) for c in ("keys", "counts", "extra")])  # every shard gets its file
        counted = texts.mapInArrow(_count_grams(model, level), COUNTED).unionByName(nothing).groupBy("shard").applyInArrow(
            _over(_build_grams(model, level, least)), "shard bigint, nodes bigint").collect()
        sizes = {r["shard"]: r["nodes"] for r in counted}
        model.nodes.append([sizes.get(s, 0) for s in range(shards)])
        if level < order and sum(model.nodes[-1]) >= 1 << 32:  # parents of the next level, in 32 bits
            raise ValueError(f"more than 2**32 different {level}-grams")
    return model


def _over(run):
    """applyInArrow looks at the number of arguments."""

    def with_rows(table: pa.Table) -> pa.Table:
        own = table.filter(pc.greater(table.column("n"), 0))
        return run(own if own.num_rows else table.slice(0, 1))

    return with_rows


# ------------------------------------------------------------------- scoring
def _score(model: Model, order: int):
    def run(batches):
        for batch in batches:
            for rows, hashes, start in tokens(batch, 1):
                ids, counts = _identified(model, hashes)
                base = model.unigram(counts)
                best = base.copy()
                for node, _, q, backoff in _chain(model, ids, start, order) if model.total else ():
                    best = np.where(node >= 0, restored(q), best + restored(backoff))
                head = start[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(np.diff(start)),
                     pa.array(np.add.reduceat((counts > 0).astype(np.int64), head)),
                     pa.array(np.add.reduceat(base, head)), pa.array(np.add.reduceat(best, head))],
                    names=["row", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, *, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, base_score and score:
    log10 probabilities of the whole text and its end under the unigrams and
    under the model.  Same-named columns are replaced.
    """
    text_batches(docs.sparkSession)
    added = ("n_tokens", "n_known", "base_score", "score")
    kept = [c for c in docs.columns if c != text_col and c.lower() not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(
        _score(model, order), f"row {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *added)


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    """True for the documents the model does not learn from; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_held_out(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, least: int = LEAST,
) -> DataFrame:
    """Train on the documents not held out and score all: ``docs`` without its
    text, with held_out, train_tokens and the columns of ``score``."""
    marked = docs.withColumn("held_out", held_out(id_col))
    model = train(marked.where(~F.col("held_out")).select(F.col(f"`{text_col}`").cast("string")), order, least)
    return score(marked, model, text_col=text_col, order=order).withColumn(
        "train_tokens", F.lit(model.total).cast("bigint"))
