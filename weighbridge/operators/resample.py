"""Cluster resampling by blocks: replicates are vectors, and a block of clusters is a matrix.

A replicate is linear in the sums of the clusters that it draws. Clusters are numbered, and so are the slots that draw them: a
task takes a range of slots and replicates and deals their draws to the blocks of BLOCK clusters that they fall on, a byte a
draw. The range of slots grows with the number of clusters and that of replicates shrinks, so what a draw costs does not depend
on the number of clusters. A block counts its draws to a (replicates x clusters) matrix of weights and multiplies it by the
(clusters x cells) matrix of its sums. Only partial sums of (replicate, cell) are exchanged after that, added up in each task
first. A task holds one block at a time, whatever the number of clusters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weighbridge.ship import ship

#: Clusters of a block (256 at most, as a place is a byte), the least slots whose draws are dealt at once, and replicates that are
#: multiplied at once.
BLOCK, SLOTS, CHUNK = 256, 64, 2_500
#: Draws that are dealt at once, and the part of the slots that they cover at least: a replicate then has about so many on a block.
DRAWS, PART = 1 << 19, 16
#: Digests that are put together at once.
HASHED = 4_096


def numbered(clusters: DataFrame, cluster: str, strata: Sequence[str] = ()) -> DataFrame:
    """clusters(strata, cluster), one row each, with its number `at` and the number of clusters `size` of its stratum. Clusters
    are numbered by the first three digits of their digest, then by themselves: a task sorts one of 4,096 buckets, never all. They
    are joined by sorting, here and to their sums: by the size of their files, millions would be broadcast through the driver."""
    dealt = clusters.select(*strata, cluster, F.coalesce(F.substring(F.sha2(F.col(cluster).cast("string"), 256), 1, 3), F.lit("")).alias("bucket"))
    whole = Window.partitionBy(*strata)  # over the sizes of buckets only
    held = dealt.groupBy(*strata, "bucket").agg(F.count("*").alias("held"))
    before = held.select(*strata, "bucket", (F.sum("held").over(whole.orderBy("bucket")) - F.col("held")).alias("before"), F.sum("held").over(whole).alias("size"))
    place = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*strata, "bucket").orderBy(cluster)))
    return place.hint("merge").join(before, [*strata, "bucket"]).select(*strata, cluster, (F.col("before") + F.col("place") - 1).cast("long").alias("at"), "size")


def draws(slots: range, replicates: range, size: int, stratum: Sequence[str] = ()) -> np.ndarray:
    """(slots x replicates) what a slot draws in a replicate: a hash of replicate, stratum and slot modulo the size, alike in any
    engine. Digests are put together whole, by HASHED, and their first words taken at once: a draw is a hash and little else."""
    numbers = [b"%d" % s for s in slots]
    middle = "".join(f"|{s}" for s in stratum if s is not None).encode()
    heads = np.empty((len(replicates), len(numbers)), np.uint32)
    for row, replicate in zip(heads, replicates, strict=True):
        start = b"%d%b|" % (replicate, middle)
        for at in range(0, len(numbers), HASHED):
            digests = b"".join([sha256(start + n).digest() for n in numbers[at : at + HASHED]])
            row[at : at + HASHED] = np.frombuffer(digests, ">u4")[::8]
    return (heads.astype(np.int64) % size).T


def packed(drawn: np.ndarray, size: int, block: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The draws of a range by the blocks they fall on: block, how many each replicate has there, and their places in it, by
    replicate."""
    slots, replicates = drawn.shape
    flat, n = drawn.T.reshape(-1), -(-size // block)
    which = flat // block
    order = np.argsort(which.astype(np.min_scalar_type(n)), kind="stable")
    counts = np.bincount(which * replicates + np.repeat(np.arange(replicates), slots), minlength=n * replicates).astype("<u2")
    ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))]).astype(np.int32)
    there = np.flatnonzero(np.diff(ends))
    places = (flat % block).astype(np.uint8)[order]
    as_binary = lambda at, data: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    every = as_binary(np.arange(n + 1) * 2 * replicates, counts), as_binary(ends, places)
    return there, *(x.take(pa.array(there)) for x in every)


def weights_of(dealt: pa.Table, replicates: int, block: int) -> np.ndarray:
    """(replicates x clusters of a block): how often each is drawn."""
    at = []
    for first, counts, places in zip(*(dealt.column(c).to_pylist() for c in ("first", "counts", "places")), strict=True):
        n = np.frombuffer(counts, "<u2")
        at.append(np.repeat(np.arange(first, first + len(n)) * block, n) + np.frombuffer(places, np.uint8))
    return np.bincount(np.concatenate(at), minlength=replicates * block).reshape(replicates, block)


def dealt_out(clusters: DataFrame, replicates: int, own: Sequence[str]) -> DataFrame:
    """(own, block, first, counts, places): all draws of the slots of clusters(own, _c), by block; own are the strata. Ranges of
    slots and replicates come from the sizes of the strata alone."""
    spark = clusters.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = clusters.groupBy(*own).agg(F.count("*").alias("size")).where(" and ".join(["size > 0", *(f"{o} is not null" for o in own)]))
    ranges = sizes.withColumn("slots", F.expr(f"greatest({SLOTS}L, least(65535L, (size + {PART - 1}) div {PART}))"))
    ranges = ranges.withColumn("slot", F.expr("explode(sequence(0L, size - 1, slots))")).withColumn("rounds", F.expr(f"greatest(1L, {DRAWS}L div slots)"))
    ranges = ranges.withColumn("first", F.expr(f"explode(sequence(0L, {replicates - 1}L, rounds))")).repartition(tasks, *own, "slot", "first")
    texts = [F.col(o).cast("string").alias(f"_t{n}") for n, o in enumerate(own)]
    strata = "".join(f"{o} {clusters.schema[o].dataType.simpleString()}, " for o in own)
    size_of = BLOCK

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, x in enumerate(b.select(["slot", "slots", "first", "rounds", "size", *(f"_t{n}" for n in range(len(own)))]).to_pylist()):
                slots, those = (range(x[a], min(x[a] + x[by], most)) for a, by, most in (("slot", "slots", x["size"]), ("first", "rounds", replicates)))
                there, counts, places = packed(draws(slots, those, x["size"], [x[f"_t{k}"] for k in range(len(own))]), x["size"], size_of)
                same = pa.array(np.full(len(there), n))
                yield pa.RecordBatch.from_arrays([*(b.column(o).take(same) for o in own), pa.array(there, pa.int64()), pa.array(np.full(len(there), x["first"], np.int32)), counts, places], [*own, "block", "first", "counts", "places"])

    return ranges.select(*own, *texts, "slot", "slots", "first", "rounds", "size").mapInArrow(deal, strata + "block long, first int, counts binary, places binary")


def weights(clusters: DataFrame, cluster: str, replicates: int, strata: Sequence[str] = ()) -> DataFrame:
    """(replicate, strata, cluster, w) of clusters(strata, cluster), one row each: how often each replicate draws a cluster, where
    it does. Each block lists its own."""
    ship(clusters.sparkSession)
    own = [f"_s{n}" for n in range(len(strata))]
    mine = clusters.select(*(F.col(s).alias(o) for s, o in zip(strata, own, strict=True)), F.col(cluster).alias("_c"))
    placed = numbered(mine, "_c", own).select(*own, F.expr(f"at div {BLOCK}").alias("block"), (F.col("at") % BLOCK).cast("int").alias("place"), "_c")
    kinds = {c: mine.schema[c].dataType for c in [*own, "_c"]}
    schema = pa.schema([("replicate", pa.int32()), *((c, to_arrow_type(k)) for c, k in kinds.items()), ("w", pa.int64())])

    def weigh(dealt: pa.Table, there: pa.Table) -> pa.Table:
        if not (dealt.num_rows and there.num_rows):
            return schema.empty_table()
        weight = weights_of(dealt, replicates, BLOCK)[:, there.column("place").to_numpy()]
        parts = []
        for r in range(0, replicates, CHUNK):
            replicate, at = np.nonzero(weight[r : r + CHUNK])
            rows = there.take(pa.array(at))
            columns = [pa.array((replicate + r).astype(np.int32)), *(rows.column(c).combine_chunks().cast(schema.field(c).type) for c in kinds), pa.array(weight[replicate + r, at])]
            parts.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(parts)

    shown = "replicate int, " + "".join(f"{c} {k.simpleString()}, " for c, k in kinds.items()) + "w long"
    out = dealt_out(mine, replicates, own).groupBy(*own, "block").cogroup(placed.groupBy(*own, "block")).applyInArrow(weigh, shown)
    return out.select("replicate", *(F.col(o).alias(s) for o, s in zip(own, strata, strict=True)), F.col("_c").alias(cluster), "w")


def resampled(sums: DataFrame, clusters: DataFrame, cluster: str, replicates: int, keys: Sequence[str], values: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """The sums of each replicate and cell (keys) over the clusters that it draws, from the integer sums of each cluster and
    cell; a cell of which a replicate draws no cluster has no row. Clusters are drawn within strata, with a null stratum of no
    use. Sums must stay under 2**53."""
    ship(sums.sparkSession)
    own = [f"_s{n}" for n in range(len(strata))]  # no name of ours clashes with one of theirs
    named = [F.col(s).alias(o) for s, o in zip(strata, own, strict=True)]
    slim = clusters.select(*named, F.col(cluster).alias("_c"))
    known = numbered(slim, "_c", own)
    cells = [f"_k{n}" for n in range(len(keys))]
    adds = [f"_v{n}" for n in range(len(values))]
    kinds = {new: sums.schema[old].dataType for new, old in zip([*cells, *adds], [*keys, *values], strict=True)}

    def weigh(dealt: pa.Table, there: pa.Table) -> pa.Table:
        schema = pa.schema([("replicate", pa.int32()), *((c, to_arrow_type(kinds[c])) for c in [*cells, *adds])])
        if not (dealt.num_rows and there.num_rows):
            return schema.empty_table()
        weight = weights_of(dealt, replicates, BLOCK).astype(np.float64)
        names = list(zip(*(there.column(c).to_pylist() for c in cells), strict=True)) if cells else [()] * there.num_rows
        number: dict[tuple, int] = {}
        at = np.array([number.setdefault(n, len(number)) for n in names], np.int64)
        place = there.column("place").to_numpy()
        matrix = np.zeros((BLOCK, len(number) * (1 + len(adds))))
        np.add.at(matrix, (place, at), 1.0)  # whether a cluster has the cell
        for v, c in enumerate(adds):
            np.add.at(matrix, (place, (v + 1) * len(number) + at), there.column(c).to_numpy(zero_copy_only=False).astype(np.float64))
        parts = []
        for r in range(0, replicates, CHUNK):
            total = weight[r : r + CHUNK] @ matrix
            replicate, cell = np.nonzero(total[:, : len(number)])
            columns = [pa.array((replicate + r).astype(np.int32))]
            keys_ = list(number)
            columns += [pa.array([k[n] for k in keys_], schema.field(c).type).take(pa.array(cell)) for n, c in enumerate(cells)]
            columns += [pa.array(total[replicate, (v + 1) * len(number) + cell]).cast(schema.field(c).type) for v, c in enumerate(adds)]
            parts.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(parts)

    mine = sums.select(*named, F.col(cluster).alias("_c"), *(F.col(k).alias(c) for k, c in zip(keys, cells, strict=True)), *(F.col(v).alias(c) for v, c in zip(values, adds, strict=True)))
    placed = mine.join(known.drop("size").hint("merge"), [*own, "_c"]).select(*own, F.expr(f"at div {BLOCK}").alias("block"), (F.col("at") % BLOCK).cast("int").alias("place"), *cells, *adds)
    schema = "replicate int, " + ", ".join(f"{c} {kinds[c].simpleString()}" for c in [*cells, *adds])
    out = dealt_out(slim, replicates, own).groupBy(*own, "block").cogroup(placed.groupBy(*own, "block")).applyInArrow(weigh, schema)
    grouped = out.groupBy("replicate", *cells).agg(*(F.sum(c).alias(c) for c in adds))
    return grouped.select("replicate", *(F.col(c).alias(k) for c, k in zip(cells, keys, strict=True)), *(F.col(c).alias(v) for c, v in zip(adds, values, strict=True)))


def paired_differences(rows: DataFrame, keys: Sequence[str], arm: str, values: Sequence[str]) -> DataFrame:
    """For each two arms of a group the later's values minus the earlier's, as arm_a, arm_b and the values; a null makes a null.
    The arms of a group meet once, in a list that is as long as there are arms."""
    met = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(arm, *values))).alias("_m"))
    after = lambda a, i: F.transform(F.slice("_m", i + 2, F.size("_m")), lambda b: F.struct(a[arm].alias("arm_a"), b[arm].alias("arm_b"), *((b[v] - a[v]).alias(v) for v in values)))
    return met.select(*keys, F.inline(F.flatten(F.transform("_m", after))))
