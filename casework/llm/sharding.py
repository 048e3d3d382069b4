"""Balanced shards of whole groups: the smallest capacity that contiguous runs of groups need.

Groups of equal texts are ordered by the text's MD5. A capacity is feasible when filling shards greedily along that order
needs no more than the wanted number; the smallest one is found by binary search. The driver never holds the groups: it
searches over sums of key prefixes (at first 4096), which bound every greedy cut from both sides, and splits only the
prefixes between the bounds further, until both bounds meet. Shards are then cut as evenly as the capacity allows.

Defined cases: null text counts as empty; a group larger than the mean fills a shard and sets the capacity; repeated rows are
rows of one group; null ids keep a slot like any other; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import stored

FIRST_DIGITS = 3
CELL_ROWS = 100_000


class Prefixes:
    """Sums by key prefix, in key order; ``atomic`` ones are single groups."""

    def __init__(self, nodes: list[tuple[str, int, bool]]) -> None:
        self.nodes = sorted(nodes)
        self.sizes = [n[1] for n in self.nodes]
        self.ends = [0, *accumulate(self.sizes)]  # ends[i]: sum before node i
        self.total = self.ends[-1]
        self.largest = max((n[1] for n in self.nodes if n[2]), default=0)

    def inner_cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts at node borders only (never beyond the true ones); None if they need more shards."""
        cuts, at = [], 0
        while self.ends[at] < self.total:
            if len(cuts) == shards:
                return None
            nxt = bisect_right(self.ends, self.ends[at] + capacity) - 1
            if nxt == at:
                return None
            cuts.append(nxt)
            at = nxt
        return cuts

    def ends_of_inner(self, capacity: int, shards: int) -> list[int]:
        """Sums at greedy cuts at node borders; a cut stays where one node alone is too large."""
        out, at = [], 0
        for _ in range(shards):
            at = max(at, bisect_right(self.ends, self.ends[at] + capacity) - 1)
            out.append(self.ends[at])
        return out

    def outer_ends(self, capacity: int, shards: int) -> list[int] | None:
        """Sums at greedy cuts if prefixes that hold several groups could be cut anywhere (never before the true ones)."""
        if capacity < self.largest:
            return None
        out, at = [], 0
        while at < self.total:
            if len(out) == shards:
                return None
            at = min(self.total, at + capacity)
            i = bisect_right(self.ends, at) - 1
            if at < self.total and self.nodes[i][2]:
                at = self.ends[i]
            out.append(at)
        return out

    def smallest(self, feasible, shards: int, low: int, high: int) -> int:  # noqa: ANN001
        while low < high:
            mid = (low + high) // 2
            if feasible(mid, shards) is None:
                low = mid + 1
            else:
                high = mid
        return low


def smallest_capacity(first: list[tuple[str, int, bool]], split, shards: int) -> tuple[int, Prefixes]:  # noqa: ANN001
    """The exact minimum; ``split(prefixes)`` gives the next finer sums of some prefixes."""
    known = Prefixes(first)
    while True:
        least = -(-known.total // shards)
        low = known.smallest(known.outer_ends, shards, least, max(least, known.total))
        high = known.smallest(known.inner_cuts, shards, low, max(low, known.total))
        if low >= high:
            return high, known
        # true cuts for any capacity in between lie between these
        early, late = known.ends_of_inner(low, shards), known.outer_ends(high, shards)
        open_ = set()
        for k, end in enumerate(late):
            begin = early[k] if k < len(early) else early[-1]
            for i in range(max(0, bisect_right(known.ends, begin) - 2), min(len(known.nodes), bisect_left(known.ends, end) + 1)):
                if not known.nodes[i][2]:
                    open_.add(known.nodes[i][0])
        if not open_:
            return high, known
        known = Prefixes([n for n in known.nodes if n[0] not in open_] + split(sorted(open_)))


def even_cuts(known: Prefixes, capacity: int, shards: int) -> list[int]:
    """Node numbers at which shards 1.. begin: no shard above ``capacity``, each as near its share of the rest as can be."""
    latest = [len(known.nodes)]  # from the right: where the last k shards may begin at the earliest
    for _ in range(shards - 1):
        latest.append(bisect_left(known.ends, known.ends[latest[-1]] - capacity))
    cuts, at = [], 0
    for k in range(1, shards):
        want = known.ends[at] + (known.total - known.ends[at]) / (shards - k + 1)
        low, high = max(at, latest[shards - k]), bisect_right(known.ends, known.ends[at] + capacity) - 1
        i = bisect_left(known.ends, want)
        if i > 0 and want - known.ends[i - 1] <= known.ends[min(i, len(known.nodes))] - want:
            i -= 1
        at = max(low, min(high, i))
        cuts.append(at)
    return cuts


def assign(groups: DataFrame, shards: int, key: str = "key", size: str = "size") -> tuple[int, list[str]]:
    """Capacity and the keys (prefixes) at which shards 1.. begin, for one row per group with a hexadecimal key."""
    sums = lambda df, digits: [
        (r[0], r[1], r[2] == 1)
        for r in df.groupBy(F.substring(key, 1, digits).alias("p")).agg(F.sum(size).cast("long"), F.count("*")).collect()
    ]

    def split(prefixes: list[str]) -> list[tuple[str, int, bool]]:
        out = []
        for digits in sorted({len(p) for p in prefixes}):
            own = [p for p in prefixes if len(p) == digits]
            out += sums(groups.where(F.substring(key, 1, digits).isin(own)), digits + 1)
        return out

    capacity, known = smallest_capacity(sums(groups, FIRST_DIGITS), split, shards)
    begins = [known.nodes[i][0] if i < len(known.nodes) else "g" for i in even_cuts(known, capacity, shards)] if known.nodes else []
    return capacity, begins


def shard_of(key: Column, begins: list[str]) -> Column:
    shard = F.lit(0)
    for b in begins:
        shard = shard + F.when(key >= b, 1).otherwise(0)
    return shard


def with_slots(df: DataFrame, order: str, tie: str, shard: str = "shard", slot: str = "slot", rows: int = 0) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps: cells by hash of ``order``, numbered inside, shifted by the cells before."""
    cells = max(256, -(-rows // CELL_ROWS))
    df = df.withColumn("__cell", F.pmod(F.xxhash64(order), F.lit(cells)).cast("int"))
    before = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(shard, "__cell").count().select(shard, "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy(shard, "__cell").orderBy(order, tie)) - 1
    return df.withColumn("__inside", inside).join(shift, [shard, "__cell"]).withColumn(slot, (F.col("__inside") + F.col("__shift")).cast("long")).drop("__cell", "__inside", "__shift")


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, shard, slot of every row."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("key")
    )
    slim = stored(slim, "shard-rows")
    groups = stored(slim.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, begins = assign(groups, shards)
    rows = slim.withColumn("shard", shard_of(F.col("key"), begins))
    return with_slots(rows, "doc_id", "key", rows=slim.count()).drop("key")
