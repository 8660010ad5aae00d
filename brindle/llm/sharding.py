"""Sharding by minimax contiguous partition: smallest feasible capacity, then cuts.

Equal texts form atomic groups, ordered by the 64-bit hash of the text. The smallest
capacity C for which ``n_shards`` contiguous shards hold all groups is found by binary
search; a greedy pass checks a capacity. The group sizes stay distributed: the driver
holds sums over ranges of hashes (2**12 at first) and asks Spark for finer sums only
of those ranges in which a cut can lie, until every cut falls between two known groups.
A pass that cuts at known borders only gives an upper bound of C, one that cuts anywhere
inside a coarse range a lower bound; what lies between their cuts is refined.

Many partitions have the smallest capacity, and greedy filling would leave the last shard
short. So each cut is laid at the border nearest to an equal part of what is left (groups
above an equal part, which have a shard of their own, not counted), where what follows still fits into the remaining shards (a greedy pass from the end says from where on).

Defined results: a null text counts as an empty one (size 1, crc of no bytes, in one group
with empty texts); repeated rows get their own slots; texts of any length are hashed whole; a group above total / n_shards sets the
capacity alone; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut

FIRST_BITS, MORE_BITS = 12, 8


class _Ranges:
    """Ordered ranges of hashes with their sums; a range of one group is atomic."""

    def __init__(self, rows: list[tuple[int, int, int]], bits: int) -> None:
        self.parts = [(node, bits, total, groups) for node, total, groups in sorted(rows)]
        self._sum()

    def _sum(self) -> None:
        self.ends = [0]
        for _, _, total, _ in self.parts:
            self.ends.append(self.ends[-1] + total)

    def greedy(self, capacity: int, shards: int, anywhere: bool) -> tuple[list[int], bool]:
        """End of each shard, and whether all groups found room."""
        at, cuts, whole = 0, [], self.ends[-1]
        for _ in range(shards):
            limit = at + capacity
            i = bisect_right(self.ends, limit) - 1
            at = limit if anywhere and i < len(self.parts) and self.parts[i][3] > 1 else max(at, self.ends[i])
            cuts.append(min(at, whole))
        return cuts, at >= whole

    def smallest(self, low: int, high: int, shards: int, anywhere: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.greedy(mid, shards, anywhere)[1] else (mid + 1, high)
        return low

    def coarse_between(self, lows: list[int], highs: list[int]) -> set[int]:
        out = set()
        for a, b in zip(lows, highs, strict=True):
            i = max(0, bisect_right(self.ends, a) - 1)
            while i < len(self.parts) and self.ends[i] <= b:
                if self.parts[i][3] > 1 and self.ends[i] < b:
                    out.add(i)
                i += 1
        return out

    def even(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """End of each shard within a feasible capacity, and coarse ranges that may hold better borders."""
        whole, unsure = self.ends[-1], set()

        def border(at: float) -> int:
            """The first known border from ``at`` on; a coarse range around ``at`` is unsure."""
            i = bisect_left(self.ends, at)
            if self.ends[i] > at and self.parts[i - 1][3] > 1:
                unsure.add(i - 1)
            return i

        large = [i for i, (_, _, total, _) in enumerate(self.parts) if total * shards > whole]  # fewer than the shards
        unsure |= {i for i in large if self.parts[i][3] > 1}
        earliest = [whole]
        while len(earliest) < shards:
            earliest.append(self.ends[border(max(0, earliest[-1] - capacity))])
        earliest.reverse()
        cuts = [0]
        for k in range(shards - 1):
            prev = cuts[-1]
            low = max(earliest[k], prev)
            high = max(low, min(prev + capacity, self.ends[max(0, len(self.parts) - (shards - 1 - k))]))  # no later shard is left without a group
            own = [i for i in large if self.ends[i] >= prev]
            part = (whole - prev - sum(self.parts[i][2] for i in own)) / max(1, shards - k - len(own))
            run = (self.ends[own[0]] if own else whole) - prev  # up to the next large group
            part = run / max(1, round(run / part)) if part and run else self.parts[own[0]][2] if own else 0
            target = min(max(low, prev + part), high)
            i = border(target)
            near = [at for at in self.ends[max(0, i - 1) : i + 1] if low <= at <= high and (at > prev or prev == whole)]
            cuts.append(min(near, key=lambda at: abs(at - target)) if near else low)
        return [*cuts[1:], whole], unsure

    def refine(self, which: set[int], finer: dict[int, list[tuple[int, int, int]]], bits: dict[int, int]) -> None:
        parts = []
        for i, part in enumerate(self.parts):
            parts += [(n, bits[i], t, g) for n, t, g in sorted(finer[i])] if i in which else [part]
        self.parts = parts
        self._sum()


def _node(key: Column, bits: int) -> Column:
    return F.shiftright(key, 64 - bits)


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, first hash of each shard after the first) of (th, total) rows."""

    def sums(df: DataFrame, bits: int) -> DataFrame:
        return df.groupBy(_node(F.col("th"), bits).alias("node")).agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("n"))

    known = _Ranges([tuple(r) for r in sums(groups, FIRST_BITS).collect()], FIRST_BITS)
    whole = known.ends[-1]
    if not whole:
        return 0, []
    largest = groups.agg(F.max("total")).head()[0]
    low, high = max(largest, -(-whole // n_shards)), whole

    def look_into(todo: set[int]) -> None:
        by_bits: dict[int, list[int]] = {}
        for i in todo:
            by_bits.setdefault(known.parts[i][1], []).append(i)
        finer: dict[int, list] = {i: [] for i in todo}
        new_bits = {i: min(64, known.parts[i][1] + MORE_BITS) for i in todo}
        for bits, parts in by_bits.items():
            of = {known.parts[i][0]: i for i in parts}
            more = min(64, bits + MORE_BITS)
            for node, total, n in sums(groups.filter(_node(F.col("th"), bits).isin(list(of))), more).collect():
                finer[of[node >> (more - bits)]].append((node, total, n))
        known.refine(todo, finer, new_bits)

    while True:
        low = known.smallest(low, high, n_shards, anywhere=True)
        high = known.smallest(low, high, n_shards, anywhere=False)
        lows, highs = known.greedy(low, n_shards, False)[0], known.greedy(high, n_shards, True)[0]
        todo = known.coarse_between(lows, highs)
        if not todo:
            break
        look_into(todo)
    cuts, todo = known.even(high, n_shards)
    while todo:
        look_into(todo)
        cuts, todo = known.even(high, n_shards)
    firsts = []
    for at in cuts[:-1]:
        i = bisect_right(known.ends, at) - 1
        if i < len(known.parts):
            node, bits, _, _ = known.parts[i]
            firsts.append(node << (64 - bits))
    return high, firsts


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) under the law ``bytes``.

    ``slot`` counts from 0 within the shard, in order of text hash, id, size. Slots come from
    a range sort (a hot text is split by id) plus the number of rows of earlier partitions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("th"),
        )
    )
    groups = cut(rows.groupBy("th").agg(F.sum("size").alias("total")))  # read again in every round of refinement
    _, firsts = minimax_cuts(groups, n_shards)
    shard = sum((F.when(F.col("th") >= t, 1).otherwise(0) for t in firsts), F.lit(0)).cast("int")

    dealt = rows.repartitionByRange("th", "id").sortWithinPartitions("th", "id", "size")
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("shard", shard))
    part, local = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumns({"part": part, "local": local})
    # One row for each partition and shard in it: bounded by the number of partitions plus n_shards.
    counts = dealt.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("local").alias("from"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "shard", "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    slot = F.col("before") + F.col("local") - F.col("from")
    return dealt.join(F.broadcast(counts), ["part", "shard"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
