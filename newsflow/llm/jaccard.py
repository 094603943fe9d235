"""N-gram Jaccard join over whole texts, by prefix trees.

A document's set holds the hashes of its distinct word n-grams in ascending
order, which is the global order of the join.  The order is cut into segments;
two linked sets must agree in at least one segment (see
``segment_signatures``), so documents are brought together by equal segments.
Around the smallest document of each segment, all documents that share one with
it form a unit.  Units are joined exactly: first every member against the
unit's smallest document; then, in blocks, members that are not yet in one
component.  Each block is stored in a prefix tree, and the other block's sets
walk down it together.

Nothing is collected, no pairs of a group are written out, and a unit of any
size is cut into blocks of bounded size.  Exact copies are reduced to one
representative first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import kernels as K
from newsflow.llm.common import components, small_side, stage, staging, text_batches, travels
from newsflow.llm.prefix_tree import PrefixTree
from newsflow.llm.setjoin_kernels import segment_signatures

travels(__name__)
travels("newsflow.llm.kernels")
travels("newsflow.llm.prefix_tree")
travels("newsflow.llm.setjoin_kernels")

BLOCK_SETS = 256  # sets in a block
BLOCK_MEMBERS = 400_000  # members of all sets in a block
NONE = -(1 << 63)  # stands for no component


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, set members and the first member of each set, block by block."""
    data, offsets = K.buffers(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for first, last in K.blocks(offsets):
        own = offsets[first : last + 1] - offsets[first]
        hashes, word = K.word_hashes(data[offsets[first] : offsets[last]], own)
        grams, start = K.shingles(hashes, word, width)
        distinct = [np.unique(grams[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
        start = np.cumsum([0, *map(len, distinct)])
        yield ids[first:last], np.concatenate(distinct), start


def _sized(width: int):
    """Sizes of the sets of tagged rows."""

    def run(batches):
        for batch in batches:
            tags, at = batch.column(2), 0
            for ids, _, start in _sets(batch, width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), tags.slice(at, len(ids)), pa.array(np.diff(start), pa.int64())],
                    names=["doc", "tag", "n"])
                at += len(ids)

    return run


def _described(width: int, percent: int):
    def run(batches):
        for batch in batches:
            for ids, members, start in _sets(batch, width):
                n = np.diff(start)
                high, low = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    high[full] = np.add.reduceat(K.mix(members), start[full])
                    low[full] = np.add.reduceat(K.mix(members ^ np.uint64(0x5851F42D4C957F2D)), start[full])
                signatures, owner = segment_signatures(members, start, percent)
                order = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[order], np.arange(len(n) + 1))
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(signatures[order].view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(high.view(np.int64)),
                     pa.array(low.view(np.int64)), lists],
                    names=["doc", "n", "high", "low", "signatures"],
                )

    return run


def _packed(width: int):
    """Sets as binary: six bytes of each hash, enough to compare two sets."""

    def run(batches):
        for batch in batches:
            for ids, members, start in _sets(batch, width):
                raw = (members >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                ends = pa.py_buffer((start * 6).astype(np.int64))
                column = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(ids), [None, ends, pa.py_buffer(raw.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), column.cast(pa.binary())], names=["doc", "members"]
                )

    return run


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    data, offsets = K.buffers(column)
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = data.reshape(-1, 6)
    values, ends = wide.view("<u8").ravel(), offsets // 6
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _tile(percent: int):
    """Links between the sets of one side and those of the other; a document on
    both sides meets itself, which links nothing.  Sets already in the same
    component are linked without being compared."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_numpy()
        part = table.column("part").to_numpy()
        members = _unpacked(table.column("members").combine_chunks())
        ranks = np.unique(np.concatenate(members)) if members else np.zeros(0, np.uint64)
        sets = [np.searchsorted(ranks, m) for m in members]
        left, right = np.flatnonzero(part != 2), np.flatnonzero(part != 1)
        tree = PrefixTree([sets[i] for i in left])
        found = tree.links([sets[j] for j in right], len(ranks), percent)
        pairs = {(docs[left[i]], docs[right[j]]) for i, j in found}
        # a spanning forest says the same with fewer rows
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(int(a)), find(int(b))
            root[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in list(root) if find(x) != x]
        return pa.table({"u": pa.array([r[0] for r in rows], pa.int64()),
                         "v": pa.array([r[1] for r in rows], pa.int64())})

    return run


def _join_tiles(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``tiles``: (tile columns..., doc, part) with part 1, 2 or 3 for left,
    right or both."""
    keys = [c for c in tiles.columns if c not in ("doc", "part")]
    return tiles.join(sets, "doc").groupBy(*keys).applyInArrow(
        lambda t: _tile(percent)(t), "u bigint, v bigint"
    )


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85
) -> DataFrame:
    """(doc, n_shingles, component) for every document id.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their
    sets of ``width``-word shingles (A-Z lower-cased, whole text); the component
    is the smallest id reachable by links.  Null or empty texts have an empty
    set and link with nothing.  Rows without an id are left out; rows that
    repeat an id count as one document, the one with the largest set, of equally
    large ones that whose text has the smallest hash.  Columns other than id and
    text aren't read; a table without rows gives none.
    """
    spark = docs.sparkSession
    text_batches(spark)
    with staging(spark) as own:
        return _components(docs, id_col, text_col, width, percent, own)


def _one_text(rows: DataFrame, width: int, own) -> DataFrame:
    """One text for each id: of different ones that with the largest set, then
    the smallest hash.  Ids are compared by narrow rows; most corpora have none
    that need more."""
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    several = own(tagged.groupBy("doc").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a <> b").select("doc"),
                  "several")
    if several.isEmpty():
        return rows
    sets = tagged.join(several, "doc", "left_semi").select("doc", "text", "tag").mapInArrow(
        _sized(width), "doc bigint, tag bigint, n bigint")
    best = own(sets.groupBy("doc").agg(F.max("n").alias("n")), "largest")
    best = own(sets.join(best, ["doc", "n"]).groupBy("doc").agg(F.min("tag").alias("tag")), "chosen")
    return rows.join(several, "doc", "left_anti").unionByName(
        tagged.join(best, ["doc", "tag"], "left_semi").select("doc", "text"))


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, own) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = _one_text(rows.where("doc IS NOT NULL"), width, own)
    described = own(
        rows.mapInArrow(
            _described(width, percent),
            "doc bigint, n bigint, high bigint, low bigint, signatures array<bigint>",
        ),
        "sets",
    )
    # 1. exact copies: one representative for each distinct set
    filled = described.where("n > 0")
    first = filled.groupBy("high", "low").agg(F.min("doc").alias("first"), F.count("*").alias("copies"))
    copies = own(
        filled.select("doc", "high", "low").join(first.where("copies > 1"), ["high", "low"])
        .where("doc <> first").select(F.col("doc").alias("u"), F.col("first").alias("v")),
        "copies",
    )
    # 2. units: documents that share a segment with the smallest one that has it
    signs = filled.select("doc", F.explode("signatures").alias("s"))
    groups = own(
        signs.groupBy("s").agg(F.min("doc").alias("hub"), F.max("doc").alias("last"), F.count("*").alias("docs"))
        .where("hub <> last").select(F.when(F.col("docs") > 2, F.col("s")).alias("s"), "hub", "last"),
        "groups",
    )
    # most groups are two documents; the members of the others are looked up
    pairs = groups.where("s IS NULL").select("hub", F.col("last").alias("doc"))
    hubs = own(groups.where("s IS NOT NULL").select("s", "hub"), "hubs")
    shared = signs.join(small_side(hubs), "s").select("hub", "doc").unionByName(pairs).distinct()
    lone = small_side(copies.select(F.col("u").alias("doc")))
    members = own(shared.where("hub <> doc").join(lone, "doc", "left_anti"), "members")
    # a hub may be a copy: its representative shares the same segments
    members = members.join(copies.select(F.col("u").alias("hub"), F.col("v").alias("rep")), "hub", "left").select(
        F.coalesce("rep", "hub").alias("hub"), "doc").where("hub <> doc").distinct()
    members = own(members, "members")
    wanted = own(members.select(F.explode(F.array("hub", "doc")).alias("doc")).distinct(), "wanted")
    sets = rows.join(small_side(wanted), "doc", "left_semi").select("doc", "text").mapInArrow(
        _packed(width), "doc bigint, members binary"
    )
    sizes = described.select("doc", "n")
    # 3. every member against its hub, so many members at once
    load = members.join(sizes, "doc").groupBy("hub").agg(F.sum("n").alias("load"), F.count("*").alias("docs"))
    cuts = F.ceil(F.greatest(F.col("docs") / BLOCK_SETS, F.col("load") / BLOCK_MEMBERS)).cast("bigint")
    load = own(load.select("hub", cuts.alias("cuts")), "load")
    cut = members.join(load, "hub").withColumn("cut", F.pmod(F.xxhash64("doc"), "cuts"))
    probe = cut.select("hub", "cut", "doc", F.lit(2).alias("part"))
    index = load.select("hub", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")).select(
        "hub", "cut", F.col("hub").alias("doc"), F.lit(1).alias("part"))
    stars = own(_join_tiles(probe.unionByName(index), sets, percent), "stars")
    settled = components(stars)
    # 4. the rest: blocks of members in different components, pair by pair
    named = members.unionByName(members.select("hub", F.col("hub").alias("doc")).distinct())
    named = named.join(settled.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc"))
    open_units = named.groupBy("hub").agg(F.min("component").alias("a"), F.max("component").alias("b"),
                                          F.count("*").alias("docs")).where("a <> b AND docs > 2")
    open_rows = own(
        named.join(open_units.select("hub"), "hub").join(sizes, "doc")
        .select("hub", "doc", "component", "n"), "open")
    # a component with many members in a unit has blocks of its own
    mixed = F.lit(NONE).cast("bigint")
    parts = open_rows.groupBy("hub", "component").agg(F.count("*").alias("docs"))
    parts = parts.withColumn(
        "own", F.when(F.col("docs") >= BLOCK_SETS // 2, F.col("component")).otherwise(mixed))
    blocked = open_rows.join(parts.drop("docs"), ["hub", "component"])
    cuts = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_MEMBERS)).cast("bigint")
    groups = own(blocked.groupBy("hub", "own").agg(cuts.alias("cuts")), "groups")
    block = F.struct("own", "cut").alias("block")
    blocks = groups.select("hub", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    blocks = blocks.select("hub", block)
    pairs = blocks.alias("a").join(blocks.alias("b"), "hub").where(
        (F.col("a.block") <= F.col("b.block"))
        & ((F.col("a.block.own") != F.col("b.block.own")) | (F.col("a.block.own") == mixed))
    ).select("hub", F.col("a.block").alias("left"), F.col("b.block").alias("right"))
    both = F.array(F.struct(F.col("left").alias("block"), F.lit(3).alias("part")))
    each = F.array(F.struct(F.col("left").alias("block"), F.lit(1).alias("part")),
                   F.struct(F.col("right").alias("block"), F.lit(2).alias("part")))
    side = F.explode(F.when(F.col("left") == F.col("right"), both).otherwise(each))
    tiles = pairs.select("hub", "left", "right", side.alias("s")).select("hub", "left", "right", "s.*")
    placed = blocked.join(groups, ["hub", "own"]).withColumn("cut", F.pmod(F.xxhash64("doc"), "cuts"))
    placed = placed.select("hub", "doc", block)
    rest = own(_join_tiles(tiles.join(placed, ["hub", "block"]).drop("block"), sets, percent), "links")
    links = stars.unionByName(rest).unionByName(copies)
    found = components(links)
    ids = stage(described.groupBy("doc").agg(F.max("n").alias("n_shingles")), "sizes")
    return ids.join(small_side(found.withColumnRenamed("node", "doc")), "doc", "left").select(
        "doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def first_of_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are linked to an earlier one.

    Rows without an id stay.
    """
    found = stage(
        jaccard_components(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
        .where("component <> doc").select("doc"),
        "dropped",
    )
    return docs.join(small_side(found), docs[id_col] == found["doc"], "left_anti")
