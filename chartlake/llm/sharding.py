"""Sharding by minimax contiguous partition of atomic groups (DataFrame functions only).

Rows of equal text are one group that no cut divides. Groups are ordered by a hash of their text, and the ordered
sizes are cut into contiguous shards so that the largest shard is as small as that order allows: the least capacity
is found by binary search, a capacity is checked by filling shards greedily, and the cuts are where the greedy
filling puts them.

The group table is never collected. The search sees *units*: blocks of groups with a common hash prefix, and single
groups. It runs twice over the units: once as if a block could be cut anywhere (a lower bound of the capacity, and
the latest place of each cut), once as if it could not be cut at all (an upper bound, and the earliest place). Only
the blocks between the earliest and the latest place of some cut are split by further bits of the hash, until both
bounds agree; that capacity is exact. A round therefore holds some thousand units, whatever the table's size.

Groups of at least a fair share take a shard each before the search, so that one hot group neither empties nor
overfills the other shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.llm.common import stored, text_or_empty

#: Bits of the hash that order groups.
KEY_BITS = 63
#: Blocks of the first round are 2^BLOCK_BITS; a group of 2^-BLOCK_BITS of all bytes is a unit by itself.
BLOCK_BITS = 12
#: Each round splits a block into 2^STEP_BITS.
STEP_BITS = 5
#: Rows of a shard that are numbered in one task.
CELL_ROWS = 100_000
#: Beyond so many shards the blocks of the first round would be too coarse for a bounded search.
MOST_SHARDS = 128


def _position(block: Column, heavy: Column, o: Column, cut) -> Column:
    """Whether a group lies at or behind a cut in the order (block, heavy, o)."""
    b, h, c = cut
    return (block > b) | ((block == b) & ((heavy > h) | ((heavy == h) & (o >= c))))


def _search(units: DataFrame, k: int) -> DataFrame:
    """One row: bounds ``lo`` and ``hi`` of the least capacity of ``k`` shards, and the earliest and latest place of each cut."""
    order = Window.orderBy("block", "heavy", "o")
    ends = units.select(F.sum("size").over(order).alias("end"), "size", (F.col("n") > 1).alias("loose"))
    row = ends.agg(
        F.sort_array(F.collect_list(F.struct("end", (F.col("end") - F.col("size")).alias("start"), "loose"))).alias("u"),
        F.max("size").alias("most"), F.sum("size").alias("total"))

    def tight(at: Column) -> Column:
        return F.array_max(F.transform("u", lambda x: F.when(x["end"] <= at, x["end"]).otherwise(0)))

    def loose(at: Column) -> Column:
        return F.array_max(F.transform("u", lambda x: F.when(x["end"] <= at, x["end"]).when(
            x["loose"] & (x["start"] < at), at).otherwise(0)))

    turns = F.sequence(F.lit(1), F.lit(k))

    def fits(step, capacity: Column) -> Column:
        return F.aggregate(turns, F.lit(0).cast("long"), lambda p, _: step(p + capacity)) >= F.col("total")

    def least(step, lo: Column, hi: Column) -> Column:
        def halve(s, _):
            mid = F.shiftright(s["lo"] + s["hi"], 1)
            return F.when(s["lo"] >= s["hi"], s).when(fits(step, mid), F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(
                F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.struct(lo.alias("lo"), hi.alias("hi")), halve, lambda s: s["lo"])

    def places(step, capacity: Column) -> Column:
        return F.aggregate(turns, F.array(F.lit(0).cast("long")), lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1) + capacity))))

    fair = F.ceil(F.col("total") / k).cast("long")
    got = row.withColumn("lo", least(loose, fair, (fair + F.col("most")).cast("long")))
    got = got.withColumn("hi", least(tight, F.col("lo"), (fair + F.col("most")).cast("long")))
    return got.select("lo", "hi", places(tight, F.col("lo")).alias("early"), places(loose, F.col("hi")).alias("late"))


def _cuts(groups: DataFrame, k: int, block_bits: int, step_bits: int) -> list[tuple[int, int, int]]:
    """Order keys (block, heavy, o) at which the shards 2, 3, ... begin. ``groups``: o, block, heavy, size."""
    shift = KEY_BITS - block_bits
    blocks = lambda rows, s: rows.groupBy("block", "heavy", F.shiftright("o", s).alias("_p")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("o").alias("o")).select(
        "block", "heavy", "o", "size", "n", F.lit(s).alias("shift"))
    single = groups.filter("heavy = 1").select("block", "heavy", "o", "size", F.lit(1).cast("long").alias("n"), F.lit(shift).alias("shift"))
    light = groups.filter("heavy = 0")
    units = stored(blocks(light, shift).unionByName(single))
    while True:
        found = _search(units, k).first()
        order = Window.orderBy("block", "heavy", "o")
        placed = units.withColumn("_end", F.sum("size").over(order)).withColumn("_start", F.col("_end") - F.col("size"))
        if found is None or found.lo is None:
            return []
        if found.lo == found.hi:
            starts = placed.filter(F.col("_start").isin([p for p in set(found.early[1:]) if p > 0]))
            return sorted((r.block, r.heavy, r.o) for r in starts.select("block", "heavy", "o").collect())
        near = F.lit(False)
        for early, late in zip(found.early[1:], found.late[1:]):
            near = near | ((F.col("_start") < late) & (F.col("_end") > early))
        split = stored(placed.withColumn("_near", near & (F.col("n") > 1)).drop("_start", "_end"))
        finer = shift - step_bits if shift > step_bits else 0
        parts = split.filter("_near").select(F.col("block").alias("_b"), F.shiftright("o", shift).alias("_q"))
        inside = light.join(F.broadcast(parts), (F.col("block") == F.col("_b")) & (F.shiftright("o", shift) == F.col("_q")), "left_semi")
        units = stored(split.filter("not _near").drop("_near").unionByName(blocks(inside, finer)))
        shift = finer


def assign_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                  block_bits: int = BLOCK_BITS, step_bits: int = STEP_BITS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and, where ``keep`` names
    columns, a struct ``kept`` of them.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` its unsigned CRC-32, ``law`` is ``bytes`` and so
    ``grown_shard`` null. Groups of equal texts lie in one shard; the largest shard is the least possible for the groups'
    order. ``slot`` numbers a shard's rows from 0 without gaps.

    A null text is an empty one (size 1, CRC 0). Ids may be null or repeated: every row gets its own slot. Texts of any
    length are hashed whole inside the JVM. An empty table gives no rows; with fewer groups than shards, the last
    shards stay empty. Other columns are not read, whatever their names. Shards depend on texts alone; which row of a
    shard gets which slot follows the partitions of the input. ``shards`` may be up to 128.

    Sizes: a group row is three numbers; heavy groups (at most 2^block_bits) are broadcast; a search round holds at
    most a few thousand units. A hot group's rows are numbered in cells of ``CELL_ROWS``, in parallel.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")
    t = text_or_empty(text)
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(t), 64 - KEY_BITS).alias("o"), *kept))
    groups = rows.groupBy("o").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    block = F.shiftright("o", KEY_BITS - block_bits)
    groups = stored(groups.withColumn("block", block))
    total, n_rows = groups.agg(F.sum("size"), F.sum("rows")).first()
    heavy = F.col("size") * F.lit(1 << block_bits) >= F.lit(total or 0)
    groups = groups.withColumn("heavy", heavy.cast("int"))
    large = groups.filter("heavy = 1")
    alone, rest, k = [], total or 0, shards
    for g in large.orderBy(F.col("size").desc(), "o").limit(shards).collect():
        if k > 1 and g["size"] * k >= rest:
            alone.append(g["o"])
            rest, k = rest - g["size"], k - 1
    cuts = _cuts(groups.filter(~F.col("o").isin(alone)) if alone else groups, k, block_bits, step_bits) if total else []
    shard = F.lit(len(alone))
    for cut in cuts:
        shard = shard + _position(F.col("block"), F.col("heavy"), F.col("o"), cut).cast("int")
    for i, o in enumerate(alone):
        shard = F.when(F.col("o") == o, i).otherwise(shard)
    cells = max(1, -(-(n_rows or 0) // CELL_ROWS))
    dealt = (
        rows.join(F.broadcast(large.select("o", "heavy")), "o", "left").withColumn("heavy", F.coalesce("heavy", F.lit(0)))
        .withColumn("block", block).withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells))))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row"))
    return dealt.withColumn("_in", inner).join(offsets, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_in") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *(["kept"] if keep else []))


def write_shards(docs: DataFrame, path: str, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write whole rows into one folder a shard (``path/shard=<n>``), in slot order within each file; returns the table read back.

    Each shard's rows are dealt to files by range of the slot, so a large shard is several files in order. Columns
    are those of ``docs``, whose names may be any but ``shard`` and ``slot``.
    """
    got = assign_shards(docs, shards, doc_id, text, keep=tuple(docs.columns)).select("kept.*", "shard", "slot")
    got.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
