"""Ordered state over very long sequences: one associative scan over row positions.

A plain window puts a whole sequence (one log, one journal, one run) into one task. Here the rows of all sequences are cut, in
the order (sequence, position), into chunks that hold about equally many rows, wherever they lie: the cut points are quantiles of
the rows, so gaps between positions do not matter, and a sequence holding a third of all rows spreads over many tasks. A window
folds a composite state (the row before, sums, last values, maxima) inside every chunk; only sequences that a cut divides have
states to carry, one per chunk, and their prefix is joined back. Rows are written once before, so that whatever they come from
is not derived again for the cut points and the states, and are shuffled once.

Defined cases: positions are unique integers inside a sequence, with any gaps, negative ones included; null keys are a
sequence of their own; a table without rows stays empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from casework.session import shared_dir

#: Least rows of a chunk, and most chunks per shuffle partition, where no width is asked for.
CHUNK_ROWS, CHUNKS_PER_PARTITION = 100_000, 4
SAMPLES_PER_CHUNK = 30
DEFAULT_WIDTH = None


@dataclass(frozen=True)
class Carry:
    """State carried to a row from the rows before it.

    ``sum``  running total (0 before the first row)
    ``last`` last non-null value
    ``max``  greatest value
    """

    kind: str
    value: Column
    inclusive: bool = False


def _then(kind: str, earlier: Column, later: Column) -> Column:
    """The state of two stretches of rows, one behind the other."""
    if kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0))
    return F.coalesce(later, earlier) if kind == "last" else F.greatest(earlier, later)


def _fold(kind: str, v: Column, order: str) -> Column:
    if kind == "sum":
        return F.sum(v)
    return F.max_by(v, F.when(v.isNotNull(), F.col(order))) if kind == "last" else F.max(v)


def _over(kind: str, v: Column, w) -> Column:  # noqa: ANN001
    if kind == "sum":
        return F.sum(v).over(w)
    return F.last(v, ignorenulls=True).over(w) if kind == "last" else F.max(v).over(w)


def _written(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``df`` from a written table, and how many they are."""
    path, counted = shared_dir(df.sparkSession, "ordered"), Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(counted.get.get("n") or 0)


def cut_points(rows: DataFrame, n: int, sequence: Column, order: str, width: int | None) -> list[tuple[int, int]]:
    """(hash of sequence, position) at which chunks begin, from a sample of rows by hash: it decides on balance, not on results."""
    most = CHUNKS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = -(-n // width) if width else min(-(-n // CHUNK_ROWS), most)
    if chunks <= 1:
        return []
    wanted = SAMPLES_PER_CHUNK * chunks
    places = rows.select(sequence.alias("h"), F.col(order).cast("bigint").alias("o"))
    some = places.where(F.pmod(F.xxhash64("o", "h"), F.lit(max(1, n // wanted))) == 0).limit(4 * wanted)
    found = sorted((r.h, r.o) for r in some.collect() if r.o is not None)
    return sorted({found[i * len(found) // chunks] for i in range(1, chunks)}) if found else []


def _chunk(sequence: Column, order: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many cut points lie at or before a row, by binary search."""
    if not cuts:
        return F.lit(0)
    hashes, orders = (F.from_json(F.lit(str([c[k] for c in cuts])), "array<bigint>") for k in (0, 1))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def further(i: Column, step: Column) -> Column:
        h, o = F.get(hashes, i + step - 1), F.get(orders, i + step - 1)
        return F.when((h < sequence) | ((h == sequence) & (o <= order)), i + step).otherwise(i)

    return F.aggregate(steps, F.lit(0), further)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    previous: Mapping[str, Column] | None = None,
    carries: Mapping[str, Carry] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Adds to every row values of the row right before it in its sequence, and states carried from all rows before it.

    ``previous`` are columns of the row before (null on the first row); the values of ``carries`` may use them by name, so that
    a running sum of "does not continue the row before" is one scan. ``width`` is the number of rows of a chunk.
    """
    keys, previous, carries = list(keys), dict(previous or {}), dict(carries or {})
    m = "__"  # begins the names of columns that only live here
    while any(c.startswith(m) for c in (*df.columns, *previous, *carries)):
        m += "_"
    rows, n = _written(df)
    sequence = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    cuts = cut_points(rows, n, sequence, order, width)
    # one struct for window, fold and join: the same partitioning, and null keys compare equal
    rows = rows.withColumn(f"{m}at", F.struct(*keys, _chunk(sequence, F.col(order).cast("bigint"), cuts).alias(f"{m}chunk")))
    inside = Window.partitionBy(f"{m}at").orderBy(order)
    own = [F.col(c) for c in df.columns]
    state = F.struct(*[c.alias(n) for n, c in previous.items()]) if previous else F.lit(None)

    def with_previous(source: str) -> list[Column]:
        return [F.col(f"{source}.{n}").alias(n) for n in previous]

    all_rows = rows
    if previous:
        rows = rows.withColumn(f"{m}prev", F.lag(state).over(inside))
    if cuts:
        divided = all_rows.where(sequence.isin(sorted({c[0] for c in cuts})))
        if previous:  # what the first row of a chunk adds is known once the chunk before is
            divided = divided.withColumn(f"{m}prev", F.lag(state).over(inside)).select(*own, f"{m}at", *with_previous(f"{m}prev"), F.col(f"{m}prev").isNull().alias(f"{m}head"))
        else:
            divided = divided.withColumn(f"{m}head", F.lit(False))
        folded = divided.groupBy(f"{m}at").agg(
            F.max_by(state, F.col(order)).alias(f"{m}last") if previous else F.lit(None).alias(f"{m}last"),
            F.min_by(F.struct(*own), F.col(order)).alias(f"{m}first") if previous else F.lit(None).alias(f"{m}first"),
            *[_fold(c.kind, F.when(~F.col(f"{m}head"), c.value), order).alias(f"{m}rest_{n}") for n, c in carries.items()],
        )
        folded = folded.withColumns({f"{m}sequence": F.struct(F.lit(0), *[F.col(f"{m}at.{k}") for k in keys]), f"{m}no": F.col(f"{m}at.{m}chunk")})
        along, rest = Window.partitionBy(f"{m}sequence").orderBy(f"{m}no"), [f"{m}rest_{n}" for n in carries]
        if previous:
            folded = folded.withColumn(f"{m}in", F.lag(f"{m}last").over(along))
            folded = folded.select(f"{m}at", f"{m}sequence", f"{m}no", f"{m}in", *rest, *[F.col(f"{m}first.{c}").alias(c) for c in df.columns], *with_previous(f"{m}in"))
        totals = folded.select(
            f"{m}at", f"{m}sequence", f"{m}no", *([f"{m}in"] if previous else []),
            *[(_then(c.kind, c.value, F.col(f"{m}rest_{n}")) if previous else F.col(f"{m}rest_{n}")).alias(f"{m}total_{n}") for n, c in carries.items()],
        )
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select(
            F.col(f"{m}at").alias(f"{m}to"), *([f"{m}in"] if previous else []), *[_over(c.kind, F.col(f"{m}total_{n}"), before).alias(f"{m}base_{n}") for n, c in carries.items()]
        )
        # at most one row per cut point and divided sequence
        rows = rows.join(F.broadcast(bases), F.col(f"{m}at") == F.col(f"{m}to"), "left")
    if previous:
        rows = rows.withColumn(f"{m}prev", F.coalesce(f"{m}prev", f"{m}in")) if cuts else rows
        rows = rows.select(*own, f"{m}at", *with_previous(f"{m}prev"), *([f"{m}base_{n}" for n in carries] if cuts else []))

    def carried(n: str, c: Carry) -> Column:
        local = _over(c.kind, c.value, inside.rowsBetween(Window.unboundedPreceding, 0 if c.inclusive else -1))
        base = F.col(f"{m}base_{n}") if cuts else F.lit(None)
        return _then(c.kind, base, local).alias(n) if c.kind == "sum" or cuts else local.alias(n)

    return rows.select(*own, *previous, *[carried(n, c) for n, c in carries.items()])


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, carries: Mapping[str, Carry], width: int | None = None) -> DataFrame:
    """Add one column per carry, computed over the preceding rows of the same ``keys``."""
    return scan(df, keys, order, carries=carries, width=width)


def lagged(df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, Column], width: int | None = None) -> DataFrame:
    """Add values of the immediately preceding row (null on the first row of a sequence)."""
    return scan(df, keys, order, previous=columns, width=width)


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str = "rn", width: int | None = None) -> DataFrame:
    """Add the 1-based rank of every row inside its sequence."""
    return scan(df, keys, order, carries={name: Carry("sum", F.lit(1), inclusive=True)}, width=width)


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Column) -> DataFrame:
    """First row per key by ``order``, as a map-side-combined aggregate instead of a window."""
    row = F.struct(*df.columns)
    names = [f"__g{i}" for i in range(len(keys))]
    grouped = df.groupBy(
        *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)]
    ).agg(F.min_by(row, order).alias("__row"))
    return grouped.select("__row.*")
