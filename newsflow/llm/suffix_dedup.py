"""Removal of long byte strings that occur earlier in the corpus.

Every window of ``length`` bytes is named by the smallest hash of the ``GRAM``-
byte strings in it; equal windows have the same name at the same place, so
neighbouring windows with one anchor are handled together: their bytes, some
130, are the anchor's context.

Anchors that occur once in the corpus cannot be part of a repeat.  Where all
contexts of an anchor are equal, all but the first repeat as a whole.  Only
anchors with different contexts need their bytes; these go to the bucket of the
anchor's hash, where a run-length index marks the windows that occur earlier.

An anchor with different contexts and very many occurrences (a frequent line)
is not gathered in one bucket: its windows are compared by hash in an
aggregation that is reduced before it is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import kernels as K
from newsflow.llm.common import fresh_name, small_side, stage, staging, text_batches, travels
from newsflow.llm.run_index import RunIndex

travels(__name__)
travels("newsflow.llm.kernels")
travels("newsflow.llm.run_index")

GRAM = 32  # bytes of an anchor
HOT = 20_000  # occurrences of one anchor that a task can index, some 200 MB while it sorts
BUCKET = 8_000  # contexts indexed together
PLACE = 31  # bits of a position within a text
VARIANT = 40  # a position has the document's variant above this bit
AGAIN = 1 << 48  # marks, in a shape, a context that its own document had before


def _variants(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A few hash bits of each whole text: rows that repeat an id with another
    text are different documents."""
    sums = K.prefix_hash(data)
    return (K.span_hash(sums, offsets[:-1].clip(0, max(len(data) - 1, 0)), offsets[1:]) >> np.uint64(44)).astype(np.int64)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """For each run of windows with the same anchor: anchor hash, hash of its
    context, document, first window, place of the anchor after it, and bytes of
    the context."""
    grams = min(GRAM, length)
    span = length - grams + 1  # anchors to choose from in a window
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    sums = K.prefix_hash(data)
    begin = np.arange(len(data) - grams + 1)
    hashes = K.span_hash(sums, begin, begin + grams)
    low = np.uint64((1 << PLACE) - 1)
    best = (hashes & ~low) | begin.astype(np.uint64)
    reach = 1
    while reach * 2 <= span:
        best = np.minimum(best[: len(best) - reach], best[reach:])
        reach *= 2
    if reach < span:
        rest = span - reach
        best = np.minimum(best[: len(best) - rest], best[rest:])
    sizes = (np.diff(offsets) - length + 1).clip(0)
    window = np.repeat(offsets[:-1], sizes) + K.run_lengths(sizes)
    if not len(window):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    place = (best[window] & low).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = place[1:] != place[:-1]
    heads = np.flatnonzero(new)
    first, place = window[heads], place[heads]
    last = window[np.append(heads[1:], len(window)) - 1]
    doc = np.searchsorted(offsets, first, "right") - 1
    size = last - first + length
    context = K.span_hash(sums, first, first + size) ^ K.mix((place - first << 32 | size).astype(np.uint64))
    return hashes[place], context, doc, first - offsets[doc], place - first, size


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, z in K.blocks(offsets):
                own = offsets[a : z + 1] - offsets[a]
                block = data[offsets[a] : offsets[z]]
                name, context, doc, first, place, size = anchor_runs(block, own, length)
                if len(name):
                    at = _variants(block, own)[doc] << VARIANT | first
                    # a context that its own document had before
                    order = np.lexsort((first, context, doc))
                    again = np.zeros(len(name), bool)
                    again[order[1:]] = (context[order[1:]] == context[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name.view(np.int64)), pa.array(context.view(np.int64)),
                         pa.array(ids[a:z][doc], pa.int64()), pa.array(at),
                         pa.array((again * np.int64(AGAIN) | place << 32 | size).astype(np.int64))],
                        names=["h", "context", "doc", "at", "shape"],
                    )

    return run


ANCHOR = "h bigint, context bigint, doc bigint, at bigint, shape bigint"


def _contexts(batches):
    """Bytes around each wanted anchor: (doc, text, runs) to one row per run."""
    for batch in batches:
        data, offsets = K.buffers(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        runs = batch.column(2)
        ends = runs.offsets.to_numpy()
        field = {k: runs.values.field(k).to_numpy(zero_copy_only=False) for k in ("h", "at", "shape", "copies")}
        for a, z in K.blocks(offsets):
            own = offsets[a : z + 1] - offsets[a]
            block = data[offsets[a] : offsets[z]]
            variant = _variants(block, own)
            row = np.repeat(np.arange(z - a), np.diff(ends[a : z + 1]))
            part = slice(ends[a], ends[z])
            at = field["at"][part]
            use = at >> VARIANT == variant[row]
            row, at = row[use], at[use]
            size = field["shape"][part][use] & 0xFFFFFFFF
            begin = own[row] + (at & ((1 << VARIANT) - 1))
            raw = block[np.repeat(begin, size) + K.run_lengths(size)]
            cuts = np.cumsum(np.append(0, size)).astype(np.int32)
            text = pa.BinaryArray.from_buffers(
                pa.binary(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(field["h"][part][use]), pa.array(ids[a:z][row], pa.int64()), pa.array(at),
                 pa.array(field["shape"][part][use] >> 32 & 0xFFFF), pa.array(field["copies"][part][use]), text],
                names=["h", "doc", "at", "place", "copies", "text"],
            )


CONTEXT = "h bigint, doc bigint, at bigint, place bigint, copies bigint, text binary"
SPANS = "doc bigint, start bigint, stop bigint"


def _spans(doc, start, stop) -> pa.Table:
    kind = pa.int64()
    return pa.table({"doc": pa.array(doc, kind), "start": pa.array(start, kind), "stop": pa.array(stop, kind)})


def _bucket(length: int):
    """Windows of a bucket that occur earlier, as spans of (variant and) bytes."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("at").to_numpy(), table.column("doc").to_numpy()))
        doc, at = table.column("doc").to_numpy()[order], table.column("at").to_numpy()[order]
        single = np.ones(len(doc), bool)  # a repeated row brings its windows twice
        single[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        table, doc, at = table.take(pa.array(order[single])), doc[single], at[single]
        data, offsets = K.buffers(table.column("text"))
        name = table.column("h").to_numpy()
        doc_out, start_out, stop_out = [doc[:0]], [at[:0]], [at[:0]]
        # anchors with more than one distinct context
        _, group, n = np.unique(name, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(n[group] > 1)
        raw = data.tobytes()
        index = RunIndex([raw[offsets[i] : offsets[i + 1]] for i in kept], length) if len(kept) else None
        for i, starts in zip(kept, index.long_matches() if index else (), strict=True):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1) + 1
                low, high = starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)]
                doc_out.append(np.full(len(low), doc[i]))
                start_out.append(at[i] + low)
                stop_out.append(at[i] + high + length)
        return _spans(*(np.concatenate(x) for x in (doc_out, start_out, stop_out)))

    return run


def _hot_spans(hot: DataFrame, length: int, own) -> DataFrame:
    """Repeated windows of anchors with very many occurrences, by aggregation.
    Their contexts are distinct already."""
    where = F.struct("doc", "at")
    shift = F.explode(F.sequence(F.lit(0), F.octet_length("text") - length)).alias("o")
    part = F.expr(f"substring(text, o + 1, {length})")
    window = own(
        hot.select("h", "place", "doc", "at", "text", shift).select(
            "h", (F.col("place") - F.col("o")).alias("place"), "doc", (F.col("at") + F.col("o")).alias("at"),
            F.xxhash64(part).alias("a"), F.xxhash64(F.lit(1), part).alias("b")),
        "hot-windows",
    )
    keys = ["h", "place", "a", "b"]
    first = window.groupBy(*keys).agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1")
    return window.join(first.drop("n"), keys).where(where != F.col("first")).select(
        "doc", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))


def repeated_spans(docs: DataFrame, *, id_col: str, text_col: str, length: int) -> DataFrame:
    """(doc, spans array<struct<start, stop>>): bytes covered by a ``length``-byte
    string that starts earlier too.  Start and stop carry the variant."""
    text_batches(docs.sparkSession)
    with staging(docs.sparkSession) as own:
        return stage(_spans_of(docs, id_col, text_col, length, own), "spans")


def _spans_of(docs: DataFrame, id_col: str, text_col: str, length: int, own) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length))
    anchors = rows.mapInArrow(_anchors(length), ANCHOR)
    names = own(
        anchors.groupBy("h").agg(
            F.count("*").alias("copies"), F.min("doc").alias("first"),
            (F.min("context") == F.max("context")).alias("uniform"),
        ).where("copies > 1"),
        "anchors",
    )
    found = own(
        anchors.join(names, "h").where(f"NOT uniform OR doc > first OR shape >= {AGAIN}").select(
            "doc", "at", "shape", F.when(~F.col("uniform"), F.col("h")).alias("h"),
            F.when(~F.col("uniform"), F.col("context")).alias("context"),
            F.when(~F.col("uniform"), F.col("copies")).alias("copies")),
        "repeated-anchors",
    )
    span = ["doc", F.col("at").alias("start"),
            (F.col("at") + F.col("shape").bitwiseAND(F.lit(0xFFFFFFFF))).alias("stop")]
    # of an anchor with different contexts, equal ones again repeat as a whole but for the first
    mixed = found.where("h IS NOT NULL")
    first = mixed.groupBy("h", "context").agg(F.min("doc").alias("first"))
    placed = own(
        mixed.join(first, ["h", "context"]).withColumn("whole", F.expr(f"doc > first OR shape >= {AGAIN}"))
        .drop("first", "context"),
        "mixed-anchors",
    )
    whole = found.where("h IS NULL").select(*span).unionByName(placed.where("whole").select(*span))
    wanted = placed.where("NOT whole")
    ids = small_side(own(wanted.select("doc").distinct(), "mixed-docs"))
    runs = wanted.groupBy("doc").agg(F.collect_set(F.struct("h", "at", "shape", "copies")).alias("runs"))
    contexts = rows.join(ids, "doc", "left_semi").join(runs, "doc").select("doc", "text", "runs").mapInArrow(
        _contexts, CONTEXT)
    buckets = max(1, -(-wanted.where(F.col("copies") <= HOT).count() // BUCKET))
    cold = contexts.where(F.col("copies") <= HOT).groupBy(F.pmod("h", F.lit(buckets)).alias("bucket"))
    spans = whole.unionByName(cold.applyInArrow(lambda t: _bucket(length)(t), SPANS))
    if wanted.where(F.col("copies") > HOT).limit(1).count():
        spans = spans.unionByName(_hot_spans(contexts.where(F.col("copies") > HOT), length, own))
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return listed.mapInArrow(_merged_spans, listed.schema)


def _merged_spans(batches):
    """Spans of each document in order, overlapping and touching ones joined."""
    for batch in batches:
        spans = batch.column(1)
        start = spans.values.field("start").to_numpy(zero_copy_only=False)
        stop = spans.values.field("stop").to_numpy(zero_copy_only=False)
        ends = spans.offsets.to_numpy()
        row = np.repeat(np.arange(len(batch)), np.diff(ends))
        start, stop = start[ends[0] : ends[-1]], stop[ends[0] : ends[-1]]
        order = np.lexsort((start, row))
        row, start, stop = row[order], start[order], stop[order]
        reach = _reach(row, stop)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(row) - 1)
        cuts = np.searchsorted(row[first], np.arange(len(batch) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(reach[last])], names=["start", "stop"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), values)], names=["doc", "spans"])


def _reach(row: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Running maximum of ``stop`` within each row."""
    out = stop.copy()
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
    for a, b in zip(heads, np.append(heads[1:], len(row)), strict=True) if len(row) else ():
        np.maximum.accumulate(stop[a:b], out=out[a:b])
    return out


def _cut(batches):
    """Remaining bytes of each text, and what was taken out; the spans are in
    order and apart."""
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(),
             "kept": pa.string()}
    low = (1 << VARIANT) - 1
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        spans = batch.column("spans")
        ends = spans.offsets.to_numpy()
        has = spans.is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) > 0)
        start_all = spans.values.field("start").to_numpy(zero_copy_only=False)
        stop_all = spans.values.field("stop").to_numpy(zero_copy_only=False)
        for first, last in K.blocks(offsets):
            out = {k: [] for k in kinds}
            for i in range(first, last):
                own_bytes = data[offsets[i] : offsets[i + 1]]
                text = own_bytes.tobytes()
                start = stop = ends[:0]
                if has[i]:
                    part = slice(ends[i], ends[i + 1])
                    own = start_all[part] >> VARIANT == _variants(own_bytes, np.array([0, len(text)]))[0]
                    start, stop = start_all[part][own] & low, stop_all[part][own] & low
                pieces, at = [], 0
                for x, y in zip(start.tolist(), stop.tolist(), strict=True):
                    pieces.append(text[at:x])
                    at = y
                pieces.append(text[at:])
                kept = b"".join(pieces)
                whole = "".join(p.decode("utf-8", "ignore") for p in pieces)
                for k, v in zip(kinds, (len(text), len(text) - len(kept), len(start),
                                        hashlib.sha256(kept).hexdigest(), whole), strict=True):
                    out[k].append(v)
            plain = [k for k in batch.schema.names if k not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(first, last - first) for k in plain),
                 *(pa.array(out[k], t) for k, t in kinds.items())],
                names=[*plain, *kinds])


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``docs`` with the text cut and the columns n_bytes, n_removed, n_spans
    (maximal removed runs) and kept_sha256 (of the remaining bytes).

    Each byte is removed that lies in a ``length``-byte string which also starts
    earlier: in a document with a smaller id, or earlier in the same one.
    Matches do not cross documents; the input decides, not what is left.  The
    text column holds the remaining bytes without characters that were cut in
    two.  A null text counts as empty.  Rows without an id are left as they are
    and compared with nothing.  Equal rows are one document.  Rows that repeat an
    id with another text are documents of their own, which are cut against all
    other documents but not reliably against each other.  Columns of ``docs``
    with the names of the added ones are replaced.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length)
    rest = [c for c in docs.columns if c != text_col]
    joined = docs.join(small_side(spans.withColumnRenamed("doc", fresh_name(docs, "span_doc"))),
                       docs[id_col] == F.col(fresh_name(docs, "span_doc")), "left")
    joined = joined.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
                           F.col(f"`{text_col}`").cast("string").alias("text"), "spans")
    kind = joined.schema["row"].dataType.simpleString()
    cut = joined.mapInArrow(_cut, f"row {kind}, {RESULT}")
    added = {"n_bytes", "n_removed", "n_spans", "kept_sha256"}
    out = cut.select(
        *[(F.col("kept") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c.lower() not in added],
        *sorted(added),
    )
    return out
