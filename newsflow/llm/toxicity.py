"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what
toxic text has and ordinary text hasn't.  Every text is cut into short windows
at blanks, and each window is compressed twice: with the ordinary dictionary,
and with the toxic one laid before it.  The bytes that the toxic dictionary
saves are the window's distance.  Thresholds on it, and their weights, are
calibrated on documents that the dictionaries in question haven't seen.

Training takes a bounded sample of labelled rows and runs in one task; the
model, some 20 KB, goes to the scoring tasks with their code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm import kernels as K
from newsflow.llm.common import replace_columns, text_batches, travels

travels(__name__)
travels("newsflow.llm.kernels")

WINDOW = 32  # bytes after which a window ends at the next blank, or after as many again
ORDINARY_BYTES = 16 << 10  # of the ordinary dictionary
TOXIC_BYTES = 1 << 10  # of the toxic one; what only it explains is little
TOXIC_ROWS, ORDINARY_ROWS = 1_000, 4_000  # of the training sample
SAMPLE_BYTES = 24 << 20  # of its texts; rows beyond it are left out whole
FOLDS = 3
GRAM = 6  # bytes of a string that is compared between the classes
LIFT = 10  # how much more frequent it must be in toxic text
DOCUMENT_LIFT = 3  # and in how many times the share of documents
SUPPORT = 0.03  # of all toxic documents hold it
STEPS = (1, 2, 3, 4, 5)  # thresholds in bytes saved
THRESHOLD = 0.3
HELD_OUT = (4, 2)  # divisor and remainder of the ids that training leaves out

LEVEL, MATCH = 12, 4  # of the compressor
RIDGE = 1.0
_BLANK = np.array(sorted(K.BLANKS), np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all windows, and the document of each; they cover all bytes."""
    lengths = np.diff(offsets)
    counts = np.maximum((lengths - 1) // size, 0)
    grid = np.repeat(offsets[:-1], counts) + (K.run_lengths(counts) + 1) * size
    blanks = np.append(np.flatnonzero(np.isin(data, _BLANK)), len(data) + 2 * size)
    cut = blanks[np.searchsorted(blanks, grid)]
    stop = np.repeat(offsets[1:], counts)
    cut = np.where((cut - grid <= size) & (cut < stop), cut, grid)
    bounds = np.unique(np.concatenate([cut, offsets]))
    doc = np.searchsorted(offsets, bounds[:-1], "right") - 1
    return bounds, doc


def _compressor(content: bytes) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Compressed lengths of windows, the dictionary being raw content: windows
    are too short for tables of their own."""
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, window_log=17, min_match=MATCH, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False,
        write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    compressor = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def lengths(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        if n <= 0:
            return np.zeros(0, np.int64)
        segments = np.stack([bounds[:-1], np.diff(bounds)], 1).astype(np.uint64)
        packed = compressor.multi_compress_to_buffer(
            zstandard.BufferWithSegments(data.tobytes(), segments.tobytes()), threads=1)
        return np.fromiter((len(packed[i]) for i in range(n)), np.int64, n)

    return lengths


def _gram_keys(data: np.ndarray) -> np.ndarray:
    """Every ``GRAM`` bytes of a text between two blanks, as one number."""
    wide = np.concatenate([[32], data, [32]]).astype(np.uint64)
    n = len(wide) - GRAM + 1
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        key = key << np.uint64(8) | wide[k : k + n]
    return key


def _telling(toxic: list[np.ndarray], ordinary: list[np.ndarray], support: float, lift: float) -> np.ndarray:
    """Grams of the toxic class that the ordinary one lacks, in order."""
    if not toxic:
        return np.zeros(0, np.uint64)
    own = [np.unique(_gram_keys(t), return_counts=True) for t in toxic]
    grams, at = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
    counts = np.concatenate([c for _, c in own])
    documents = np.bincount(at, minlength=len(grams))
    times = np.bincount(at, counts, minlength=len(grams))
    total = max(times.sum(), 1)
    often = documents >= max(4, support * len(toxic))
    grams, documents, times = grams[often], documents[often], times[often]
    other, other_documents, other_total = np.zeros(len(grams)), np.zeros(len(grams)), 1
    for text in ordinary:
        keys = _gram_keys(text)
        other_total += len(keys)
        if len(grams) and len(keys):
            place = np.searchsorted(grams, keys).clip(max=len(grams) - 1)
            found = np.bincount(place[grams[place] == keys], minlength=len(grams))
            other += found
            other_documents += found > 0
    frequent = times / total >= lift * (other + 1) / other_total
    widespread = documents / len(toxic) >= DOCUMENT_LIFT * (other_documents + 1) / (len(ordinary) + 1)
    return grams[frequent & widespread]


def _stretches(text: np.ndarray, grams: np.ndarray) -> bytes:
    """What the grams cover of a text."""
    keys = _gram_keys(text)
    if not len(grams) or not len(keys):
        return b""
    place = np.searchsorted(grams, keys).clip(max=len(grams) - 1)
    hit = np.flatnonzero(grams[place] == keys)
    covered = np.zeros(len(text) + 2, bool)
    for k in range(GRAM):
        covered[hit + k] = True
    return np.concatenate([[32], text, [32]]).astype(np.uint8)[covered].tobytes()


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; the trainer gives up when asked for much more than
    the samples hold, so less is asked for then."""
    samples = [s for s in samples if s]
    while size >= 256 and samples:
        try:
            found = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
        except zstandard.ZstdError:
            found = b""
        if len(found) >= 0.9 * size:
            return found
        size //= 2
    return b"".join(dict.fromkeys(samples))[-256:]


@dataclass
class Dictionaries:
    """Contents of the two dictionaries."""

    ordinary: bytes
    toxic: bytes
    _lengths: tuple = field(default=(), repr=False, compare=False)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per document: the largest saving, the number of windows, and
        the number and share of windows that reach each threshold."""
        if not self._lengths:
            self._lengths = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        data = _LOWER[data]
        bounds, doc = windows(data, offsets)
        saved = self._lengths[0](data, bounds) - self._lengths[1](data, bounds)
        n = len(offsets) - 1
        number = np.bincount(doc, minlength=n)[:n].astype(float)
        most = np.zeros(n)
        np.maximum.at(most, doc, saved)
        hits = np.stack([np.bincount(doc[saved >= s], minlength=n)[:n] for s in STEPS], 1)
        share = hits / np.maximum(number, 1)[:, None]
        return np.concatenate([most[:, None], np.log1p(number)[:, None], np.log1p(hits), share], 1)


def train_dictionaries(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> Dictionaries:
    """Dictionaries of lower-cased texts of the two classes."""
    pieces = []
    for text in ordinary:
        bounds, _ = windows(text, np.array([0, len(text)]))
        pieces += [text[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    grams = _telling(toxic, ordinary, SUPPORT, LIFT)
    return Dictionaries(
        _trained(pieces, ORDINARY_BYTES, 64, 8),
        _trained([_stretches(t, grams) for t in toxic], TOXIC_BYTES, 64, GRAM) if len(grams) else b"")


@dataclass
class Model:
    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = (self.dictionaries.features(data, offsets) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic weights of standardised features, by Newton
    steps; the intercept isn't penalised."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    design = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], 1)
    penalty = np.full(design.shape[1], RIDGE)
    penalty[0] = 1e-3
    weights = np.zeros(design.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + penalty * weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, weights


def train(texts: list[np.ndarray], toxic: np.ndarray) -> Model:
    """Model of labelled, lower-cased texts.  Each fold is measured with
    dictionaries of the others, so the weights hold for unseen text; the
    dictionaries of the model come from all of them."""
    fold = np.arange(len(texts)) % FOLDS

    def fitted(use: np.ndarray) -> Dictionaries:
        return train_dictionaries(*([texts[i] for i in np.flatnonzero(use & (toxic == c))] for c in (1, 0)))

    rows, marks = [], []
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        if len(own):
            data = np.concatenate([texts[i] for i in own]).astype(np.uint8)
            offsets = np.append(0, np.cumsum([len(texts[i]) for i in own]))
            rows.append(fitted(fold != k).features(data, offsets))
            marks.append(toxic[own])
    every = fitted(np.ones(len(texts), bool))
    if not rows:
        n = 2 + 2 * len(STEPS)
        return Model(every, np.zeros(n), np.ones(n), np.append(-30.0, np.zeros(n)))  # nothing is known to be toxic
    return Model(every, *_logistic(np.concatenate(rows), np.concatenate(marks).astype(float)))


MODEL = "ordinary binary, toxic binary, mean array<double>, scale array<double>, weights array<double>"


def _train_task(sample_bytes: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        texts, toxic, held = [], [], 0
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            marks = batch.column("toxic").to_pylist()
            for i, mark in enumerate(marks):
                own = _LOWER[data[offsets[i] : offsets[i + 1]]]
                if held + len(own) <= sample_bytes:
                    texts.append(own)
                    toxic.append(mark)
                    held += len(own)
        model = train(texts, np.array(toxic, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.dictionaries.ordinary], pa.binary()), pa.array([model.dictionaries.toxic], pa.binary()),
             *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (model.mean, model.scale, model.weights))],
            names=["ordinary", "toxic", "mean", "scale", "weights"])

    return run


def held_out(doc_id: Column, parts: tuple[int, int] = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts[0] == parts[1]


def training_sample(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, parts: tuple[int, int] = HELD_OUT,
) -> DataFrame:
    """(doc, toxic, rank, text): of each class the labelled documents with the
    smallest hashes of their ids, those held out apart.  An id with several
    labels is toxic if one of them says so, and one with several texts has the
    first of them."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col), parts))
    ids = ids.select(F.col(id_col).cast("bigint").alias("doc"), "toxic").groupBy("doc").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("rank", F.xxhash64("doc"))
    own = [ids.where(F.col("toxic") == c).orderBy("rank", "doc").limit(n) for c, n in ((1, toxic_rows), (0, ordinary_rows))]
    # bounded by the two row numbers
    chosen = F.broadcast(own[0].unionByName(own[1]))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.join(chosen, "doc").groupBy("doc", "toxic", "rank").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, sample_bytes: int = SAMPLE_BYTES, **options) -> Model:
    """The model of a training sample (see ``training_sample``), trained in one
    task.  The sample's size is bounded by rows and bytes, whatever the corpus."""
    text_batches(docs.sparkSession)
    sample = training_sample(docs, labels, **options)
    found = sample.repartition(1).sortWithinPartitions("rank", "doc").mapInArrow(_train_task(sample_bytes), MODEL).collect()
    if not found:  # an empty sample has no task
        return train([], np.zeros(0, np.int64))
    row = found[0]
    return Model(Dictionaries(bytes(row.ordinary), bytes(row.toxic)), *(np.array(v) for v in row[2:]))


def _score_task(model: Model):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            for first, last in K.blocks(offsets):
                scores = model.scores(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, last - first), pa.array(scores)], names=["row", "score"])

    return run


def score_toxicity(
    docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` without the columns of ``drop``, with ``score`` (0 to 1) and
    ``predicted`` (1 from ``threshold`` on); columns of these names are replaced.

    Every row is scored by its whole text and nothing else; a null text is
    empty, and an empty one has the score of a text in which nothing was found.
    """
    text_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in drop]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(_score_task(model), f"row {kind}, score double")
    left = [c for c in keep if c.lower() not in ("score", "predicted")]
    out = scored.select(*[F.col("row")[c].alias(c) for c in left], "score")
    return replace_columns(out, {"predicted": (F.col("score") >= threshold).cast("int")})


def toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", drop: tuple[str, ...] = (), **options
) -> DataFrame:
    """``score_toxicity`` of all rows by a model of the labelled ones that are
    not held out, and ``held_out``.  Without labelled rows all scores are near 0."""
    model = train_toxicity(docs, labels, id_col=id_col, **options)
    scored = score_toxicity(docs, model, drop=drop)
    return replace_columns(scored, {"held_out": held_out(F.col(f"`{id_col}`"))})
