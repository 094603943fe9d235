"""Fill-in-the-middle transformation by secondary sort.

A document is cut into units (lines) and the units into prefix, middle and
suffix.  Its output is never built in one piece: each section leaves the scan
as chunks of whole units, keyed by document and output position.  One exchange
by document, sorted by (document, position) inside its partitions -- the
DataFrame form of ``repartitionAndSortWithinPartitions`` -- brings the chunks
into output order, and a task streams them into a running digest.

Restoring reads nothing but that stream and the form: the marks are found where
they are, also across chunks, and the chunks between them are given the
positions they had in the text.  Sorting them again inside the same partitions,
without another exchange, streams the text back.

A task holds one batch of chunks at a time, whatever a document's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm import kernels as K
from newsflow.llm.common import text_batches, travels

travels(__name__)
travels("newsflow.llm.kernels")

MARKS = ("<P>", "<S>", "<M>")
CHUNK = 1 << 16  # bytes of a piece
SEED = 7
RATE = 100  # per cent of documents that are transformed
SPM = 50  # per cent of these in suffix-prefix-middle order

# Sections in output order; they are numbered prefix 0, middle 1, suffix 2.
ORDERS = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}
END = 3  # a document's closing row is sorted behind its sections

PIECE = "doc bigint, tag bigint, place bigint, form string, n bigint, prefix_chars bigint, middle_chars bigint, data binary"
PART = (
    "doc bigint, tag bigint, section int, place bigint, copies bigint, form string, n bigint, prefix_chars bigint, "
    "middle_chars bigint, output_sha256 string, data binary")
DIGEST = (
    "doc bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, "
    "restored_sha256 string")
TEXT = "doc bigint, form string, output string"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _chunks(data: bytes, size: int) -> Iterator[bytes]:
    """Whole units, as many as fit; a longer unit is cut."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            end = data.rfind(b"\n", at, end) + 1 or end
        yield data[at:end]
        at = end


def _cut(marks: tuple[str, ...], rate: int, spm: int, size: int):
    """Pieces of each document: a head with its form and measures, then chunks
    numbered in output order, the marks in front of their sections."""
    codes = [m.encode() for m in marks]

    def rows(doc, tag, text: bytes, draws) -> Iterator[tuple]:
        data = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero(data == 10) + 1
        if len(data) and (not len(ends) or ends[-1] < len(data)):
            ends = np.append(ends, len(data))
        n = len(ends)
        plain = not text or any(c in text for c in codes) or draws[2] % 100 >= rate
        form = "plain" if plain else "spm" if draws[3] % 100 < spm else "psm"
        if plain:
            sections, counts = [text], (None, None)
        else:
            bounds = np.append(0, ends)
            a, b = sorted(int(bounds[draw % (n + 1)]) for draw in draws[:2])
            sections = [text[:a], text[a:b], text[b:]]
            counts = _code_points(data[:a]), _code_points(data[a:b])
        yield doc, tag, -1, form, n, *counts, None
        place = 0
        for section in ORDERS[form]:
            own = sections[section]
            if not plain:
                own = codes[(0, 2, 1)[section]] + own
            for chunk in _chunks(own, size):
                yield doc, tag, place, None, None, None, None, chunk
                place += 1

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("data"))
            docs, tags = batch.column("doc").to_pylist(), batch.column("tag").to_pylist()
            draws = batch.column("draws").to_pylist()
            for first, last in K.blocks(offsets):
                out = []
                for i in range(first, last):
                    out += rows(docs[i], tags[i], data[offsets[i] : offsets[i + 1]].tobytes(), draws[i])
                yield _batch(PIECE, out)

    return run


def _documents(batches) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of each document of a sorted stream, as they come."""
    key, own = None, None

    def stream():
        for batch in batches:
            for row in batch.to_pylist():
                yield row

    rows = stream()
    row = next(rows, None)
    while row is not None:
        key = row["doc"], row["tag"]

        def own(key=key):
            nonlocal row
            while row is not None and (row["doc"], row["tag"]) == key:
                yield row
                row = next(rows, None)

        yield key, own()


def _once(rows: Iterator[dict], heads: list[dict]) -> Iterator[bytes]:
    """Chunks in order; heads are kept aside.  Equal rows of the input bring
    every piece as often as they come: it counts once."""
    last = -1
    for row in rows:
        if row["place"] < 0:
            heads.append(row)
        elif row["place"] > last:
            last = row["place"]
            yield row["data"]


class _Restorer:
    """Sections of an output that arrives in chunks."""

    def __init__(self, form: str, marks: tuple[str, ...]):
        codes = [m.encode() for m in marks]
        self.wanted = [] if form == "plain" else [(codes[(0, 2, 1)[s]], s) for s in ORDERS[form]]
        self.section, self.rest = 0, b""

    def feed(self, chunk: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        data = self.rest + chunk
        while self.wanted:
            mark, section = self.wanted[0]
            at = data.find(mark)
            if at < 0:
                break
            if at:
                yield self.section, data[:at]
            self.section, data = section, data[at + len(mark) :]
            del self.wanted[0]
        keep = 0 if last or not self.wanted else min(len(self.wanted[0][0]) - 1, len(data))
        if len(data) > keep:
            yield self.section, data[: len(data) - keep]
        self.rest = data[len(data) - keep :]


def _bounded(schema: str, rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += 200 + (len(row[-1]) if isinstance(row[-1], (bytes, str)) else 0)
        if held > size:
            yield _batch(schema, out)
            out, held = [], 0
    if out:
        yield _batch(schema, out)


def _digest_output(marks: tuple[str, ...]):
    """Output digests, and the sections that the output holds."""

    def parts(batches):
        for (doc, tag), rows in _documents(batches):
            heads: list[dict] = []
            digest, restorer, place = hashlib.sha256(), None, 0
            for chunk in _once(rows, heads):
                digest.update(chunk)
                restorer = restorer or _Restorer(heads[0]["form"], marks)
                for section, data in restorer.feed(chunk):
                    yield doc, tag, section, place, None, None, None, None, None, None, data
                    place += 1
            for section, data in restorer.feed(b"", last=True) if restorer else ():
                yield doc, tag, section, place, None, None, None, None, None, None, data
                place += 1
            head = heads[0]
            yield (doc, tag, END, place, len(heads), head["form"], head["n"], head["prefix_chars"],
                   head["middle_chars"], digest.hexdigest(), None)

    return lambda batches: _bounded(PART, parts(batches))


def _digest_restored(batches):
    def digests():
        for (doc, _), rows in _documents(batches):
            digest = hashlib.sha256()
            for row in rows:
                if row["section"] < END:
                    digest.update(row["data"])
                else:
                    for _ in range(row["copies"]):
                        yield (doc, row["n"], row["form"], row["prefix_chars"], row["middle_chars"],
                               row["output_sha256"], digest.hexdigest())

    return _bounded(DIGEST, digests())


def _whole(batches):
    def texts():
        for (doc, _), rows in _documents(batches):
            heads: list[dict] = []
            output = b"".join(_once(rows, heads)).decode()
            for head in heads:
                yield doc, head["form"], output

    return _bounded(TEXT, texts())


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)])


def fim_pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
    spm: int = SPM, marks: tuple[str, str, str] = MARKS, chunk: int = CHUNK,
) -> DataFrame:
    """The outputs as pieces in order: (doc, tag, place, form, n, prefix_chars,
    middle_chars, data), all of a document in one partition, sorted by place.

    Place -1 is a document's head, which alone has form and measures.  A
    document that is empty, contains a mark or isn't drawn keeps its text: form
    ``plain``.  A null text is empty; documents without an id share one draw.
    ``tag`` is a hash of the text: rows that repeat an id with another text are
    documents of their own, and equal rows bring equal pieces.  Other columns
    of ``docs`` aren't read.
    """
    if len(set(marks)) != 3 or any(len(set(m)) != len(m) or not m for m in marks):
        raise ValueError("marks: three different texts, each without a repeated character")
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.xxhash64(text).alias("tag"),
        draws(F.col(f"`{id_col}`"), seed).alias("draws"), text.cast("binary").alias("data"))
    return rows.mapInArrow(_cut(marks, rate, spm, chunk), PIECE).repartition("doc", "tag").sortWithinPartitions(
        "doc", "tag", "place")


def fim_digests(docs: DataFrame, *, marks: tuple[str, str, str] = MARKS, **options) -> DataFrame:
    """(doc, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256), one row for each row of ``docs``; the last is the digest
    of the text rebuilt from output and form alone.  Options and odd rows: see
    ``fim_pieces``."""
    parts = fim_pieces(docs, marks=marks, **options).mapInArrow(_digest_output(marks), PART)
    return parts.sortWithinPartitions("doc", "tag", "section", "place").mapInArrow(_digest_restored, DIGEST)


def fim_texts(docs: DataFrame, **options) -> DataFrame:
    """(doc, form, output): the outputs as whole texts, one row for each row of
    ``docs``.  Options and odd rows: see ``fim_pieces``."""
    return fim_pieces(docs, **options).mapInArrow(_whole, TEXT)
