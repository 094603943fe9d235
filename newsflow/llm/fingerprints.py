"""Order MinHash fingerprints, in column expressions only.

The k-mers of a text, ``k`` consecutive words, are numbered by occurrence, so
that each is unique, and hashed.  The hash range is a circle, cut into 2 **
``BIN_BITS`` equal bins; for each bin the first ``TUPLE`` k-mers of the whole text
from the bin's start on, past its end where the bin holds fewer, are selected and
put back into text order, and the ordered tuple is hashed.  The distance from a
bin's start is a hash function of its own, so every bin is an order MinHash of the
whole text, however short.  Two texts agree in a bin only if they select the same
k-mers in the same order, so the share of agreeing bins falls with edit distance
and not only with the overlap of the k-mer sets.  Bins of a text with few k-mers
select from the same ones: the expected likeness is that of independent hash
functions, its spread is larger.

One hash per k-mer serves all bins.  A k-mer is kept as one long: hash bits
above, position in the low 31 bits, so sorting groups the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.arrays import bind
from newsflow.llm.common import stage
from newsflow.llm.quality import words_of

KMER = 3  # words of a k-mer
TUPLE = 2  # k-mers selected for a bin; texts with fewer have all of theirs
BIN_BITS = 6  # 2 ** 6 = 64 bins
BINS = 1 << BIN_BITS
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1
RANGE = 200_000  # ids ordered in one task


def _hash_of(e: Column) -> Column:
    return F.shiftright(e, PLACE_BITS)


def _bin_of(e: Column) -> Column:
    """0 to BINS - 1, in the order of the k-mers."""
    return (F.shiftright(e, 64 - BIN_BITS) + (BINS >> 1)).cast("int")


def _placed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)


def kmers(text: Column) -> Column:
    """Sorted k-mers of a text.  One with fewer than ``KMER`` words is a single
    k-mer; one without words has none."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (KMER - 1), F.lit(1)))
        all_of = F.transform(
            starts, lambda i: _placed(F.xxhash64(F.slice(w, i, KMER)), (i - 1).cast("bigint")))
        return F.when(F.size(w) > 0, F.sort_array(all_of)).otherwise(F.array().cast("array<bigint>"))

    return bind(words_of(text), of)


def numbered(ordered: Column) -> Column:
    """The same, second and later occurrences hashed with their number."""

    def of(s: Column) -> Column:
        def again(e, i):
            return (i > 0) & (_hash_of(F.get(s, i - 1)) == _hash_of(e))

        def renumbered(d: Column) -> Column:
            heads = F.filter(
                F.sequence(F.lit(0), F.size(d) - 1),
                lambda j: (j == 0) | (_hash_of(F.get(d, j - 1)) != _hash_of(F.get(d, j))))

            def runs(h: Column) -> Column:
                def one(a, q):
                    stop = F.coalesce(F.get(h, q + 1), F.size(d))
                    return F.transform(
                        F.slice(d, a + 1, stop - a),
                        lambda e, n: _placed(F.xxhash64(_hash_of(e), n), e.bitwiseAND(F.lit(PLACE))))

                return F.flatten(F.transform(h, one))

            first = F.filter(s, lambda e, i: ~again(e, i))
            return F.when(F.size(d) == 0, s).otherwise(F.sort_array(F.concat(first, bind(heads, runs))))

        return bind(F.filter(s, again), renumbered)

    return bind(ordered, of)


def order_minhash(text: Column) -> Column:
    """Sketch of a text: one long per bin, bin above, tuple hash in the low 32
    bits; none for a text without words."""

    def select(s: Column) -> Column:
        return F.filter(s, lambda e, i: (i < TUPLE) | (_bin_of(F.get(s, i - TUPLE)) != _bin_of(e)))

    def tuples(p: Column) -> Column:
        def from_place(i: Column) -> Column:
            """Name of the ``TUPLE`` k-mers from place ``i`` on, around the circle."""
            tuple_ = F.transform(
                F.sequence(F.lit(0), F.least(F.size(p), F.lit(TUPLE)) - 1), lambda j: F.get(p, F.pmod(i + j, F.size(p))))
            in_text = F.sort_array(F.transform(tuple_, lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), 64 - PLACE_BITS)
                                               .bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS))))
            name = F.xxhash64(F.transform(in_text, lambda x: x.bitwiseAND(F.lit((1 << (64 - PLACE_BITS)) - 1))))
            return name.bitwiseAND(F.lit(0xFFFFFFFF))

        def named(first: Column, last: Column, name: Column) -> Column:
            return bind(name, lambda n: F.transform(
                F.sequence(first, last), lambda b: F.shiftleft(b.cast("bigint"), 32).bitwiseOR(n)))

        def of(e, i):
            # a bin's first k-mer is also the first of the empty bins before it
            after = F.when(i == 0, F.lit(0)).otherwise(_bin_of(F.get(p, i - 1)) + 1)
            return F.when(after <= _bin_of(e), named(after, _bin_of(e), from_place(i)))

        # the empty bins at the end go on with the smallest k-mer
        last = _bin_of(F.get(p, F.size(p) - 1))
        end = F.when(last < BINS - 1, named(last + 1, F.lit(BINS - 1), from_place(F.lit(0))))
        return F.when(F.size(p) > 0, F.flatten(F.filter(
            F.concat(F.transform(p, of), F.array(end)), lambda x: x.isNotNull()))).otherwise(p)

    return bind(bind(numbered(kmers(text)), select), tuples)


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: ten hexadecimal digits per bin."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing bins; 1 for two texts without words, 0 if only one has
    none."""
    agree = F.size(F.array_intersect(a, b))
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)),
                                F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(agree / bins)


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with its ``fingerprint``, row by row; a null text is empty, a
    column of that name is replaced."""
    sketch = order_minhash(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "fingerprint"]
    return docs.select(*kept, fingerprint(sketch).alias("fingerprint"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc, next_doc) for the distinct ids of a one-column table: the largest
    smaller one, and for the smallest the largest.

    The ids are sorted in ranges; a range's last id follows from the range
    before it, of which there is one row each.
    """
    distinct = stage(ids.distinct(), "ids")
    ranges = max(1, -(-distinct.count() // RANGE))
    placed = stage(distinct.repartitionByRange(ranges, "doc").withColumn("range", F.spark_partition_id()), "ranges")
    bounds = placed.groupBy("range").agg(F.max("doc").alias("last"))
    top = placed.agg(F.max("doc")).first()[0]
    before = F.coalesce(F.lag("last").over(Window.orderBy("range")), F.lit(top))
    bounds = bounds.select("range", before.alias("before"))
    own = F.lag("doc").over(Window.partitionBy("range").orderBy("doc"))
    return placed.withColumn("own", own).join(bounds, "range").select(
        "doc", F.coalesce("own", "before").alias("next_doc"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    Edited: the last third of the code points replaced by the first as many (or
    all) of the next document in descending id; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.  Null texts are empty.  Rows that repeat an id
    all come back; as a next document they count once, with the smallest text.
    Rows without an id have no next document: their edited columns are null.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), text.alias("text"))
    # both joins below read exactly these columns, so Spark sketches and shuffles the texts once for both
    base = rows.where("doc IS NOT NULL").select("doc", "text", order_minhash(F.col("text")).alias("sketch"))
    third = F.expr("cast(n_chars div 3 as int)")
    needs = rows.where("doc IS NOT NULL").groupBy("doc").agg(F.max(F.length("text")).alias("n_chars"))
    needs = stage(needs.select("doc", third.alias("need")), "needs")
    following = stage(next_ids(needs.select("doc")).join(needs, "doc"), "following")
    owners = following.select(F.col("doc").alias("owner"), F.col("next_doc").alias("doc"), "need")
    heads = base.join(owners.hint("merge"), "doc").select(
        F.col("owner").alias("doc"), F.expr("left(text, need)").alias("head"), F.col("sketch").alias("next_sketch"))
    if needs.count() < rows.where("doc IS NOT NULL").count():  # ids repeat: the smallest text counts
        heads = heads.groupBy("doc").agg(F.min(F.struct("head", "next_sketch")).alias("h")).select("doc", "h.*")
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 3 as int))"),
                      F.expr("left(head, cast(n_chars div 3 as int))"))
    joined = base.join(heads.hint("merge"), "doc").withColumn("n_chars", F.length("text").cast("bigint")).withColumn(
        "edited", edited)
    both = joined.select(
        "doc", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch",
        F.explode(F.array(order_minhash(F.col("edited")))).alias("edited_sketch"))
    known = both.select(
        F.col("doc").alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
    none = F.lit(None)
    alone = rows.where("doc IS NULL").select(
        F.col("doc").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"),
        none.cast("string").alias("edited_sha256"), fingerprint(order_minhash(F.col("text"))).alias("fingerprint"),
        none.cast("string").alias("edited_fingerprint"), none.cast("double").alias("near_edited"),
        none.cast("double").alias("near_next"))
    return known.unionByName(alone)
