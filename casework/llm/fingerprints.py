"""Document fingerprints: bottom-k sketches of word shingles.

A fingerprint is the k smallest of the 64-bit hashes of a text's distinct shingles. Those of parts merge into that of the
whole (union, again the k smallest), so they can be made by page and added up by document, source or corpus, in any order.
From two of them follow the resemblance of the texts, how much of one the other contains, and from one the number of distinct
shingles; sketches that hold fewer than k hashes are whole sets and give exact answers.

Fingerprints are arrays of k bigints in ascending unsigned order of the hashes with the sign bit flipped, so that signed
comparison sorts them. ``packed`` gives them as text.

Defined cases: null text counts as empty; an empty text has an empty fingerprint; two empty fingerprints are alike (1), an
empty and another one are not (0).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import partitions
from .shingles import WordHashes, shingle_hashes

K = 128
WORDS = 5
SIGN = np.uint64(1 << 63)


def sketch(text: bytes | None, k: int, words: int, known: WordHashes) -> np.ndarray:
    return shingle_hashes(text, words, known)[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Resemblance: the share of common hashes among the k smallest of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def packed(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, words: int = WORDS) -> DataFrame:
    """``docs`` and a fingerprint of each row's text; a column that has the name already is replaced."""
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            each = [sketch(t, k, words, known) for t in batch.column("__body").to_pylist()]
            flat = np.concatenate([*each, np.empty(0, np.uint64)]) ^ SIGN
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
            yield pa.record_batch([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("__body", F.col(text).cast("binary")).mapInArrow(run, f"{schema}, `{out}` array<bigint>")


def merged(sketches: DataFrame, by: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per group. Hashes are counted off by rank, never gathered: a group may be of any size."""
    from pyspark.sql import Window

    hashes = sketches.select(*by, F.explode(column).alias("__h")).distinct()
    # the smallest k of each of 64 parts of a group, then of the group
    part = Window.partitionBy(*by, "__p").orderBy("__h")
    some = hashes.withColumn("__p", F.pmod(F.xxhash64("__h"), F.lit(64))).withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= k)
    least = some.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the texts of two fingerprints."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k - 1) over the k-th smallest hash on the scale from 0 to 1."""
    kth = (F.element_at(a, -1).cast("double") + float(2**63)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: the common part of the union, by the size of a."""
    union = distinct_shingles(F.slice(F.sort_array(F.array_union(a, b)), 1, k), k)
    share = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def edited_pairs(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every document, of an edit of it and their likeness, and the likeness to the next document.

    The edit puts the first code points of the next document, by ascending id, in place of the last half; the last document is
    followed by the first. Documents are dealt to ranges of ids once; the first document of each range also goes to the range
    before it, so that no row needs another range. Rows with the same id follow each other by text; rows without id come first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = partitions(spark)
    cuts = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [1.0], 10 * max(parts, 1000))).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64)) if parts > 1 else np.empty(0, np.int64)

    def part_of(ids: pa.Array) -> np.ndarray:
        part = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        part[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return part

    def parts_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"part": pa.array(part_of(batch.column(0)), pa.int32()), "doc_id": batch.column(0)})

    # first id of each range: as many rows as there are ranges
    has_null = not docs.where("doc_id IS NULL").isEmpty()
    least = docs.select("doc_id").mapInArrow(parts_only, "part int, doc_id bigint").groupBy("part").agg(F.min("doc_id")).collect()
    first = {p: i for p, i in least}
    if has_null:
        first[0] = None
    filled = sorted(first)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}  # the first range follows the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one range travel together, compressed."""
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            part, ids = part_of(batch.column(0)), batch.column(0).to_pylist()
            lent = [i for i, (p, x) in enumerate(zip(part.tolist(), ids, strict=True)) if x == first[p]]
            rows = pa.Table.from_batches([batch]).append_column("next", pa.array([False] * len(ids)))
            more = rows.take(pa.array(lent, pa.int64())).set_column(2, "next", pa.array([True] * len(lent), pa.bool_()))
            to = np.concatenate([part, np.array([before[int(p)] for p in part[lent]], part.dtype)])
            rows = pa.concat_tables([rows, more])
            parts, blobs = [], []
            for p in np.unique(to):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_table(rows.take(np.flatnonzero(to == p)).combine_chunks())
                parts.append(p)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.record_batch({"part": pa.array(parts, pa.int32()), "rows": pa.array(blobs, pa.binary())})

    dealt = docs.mapInArrow(deal, "part int, rows binary").repartition(parts, "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, tables = WordHashes(), None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at and tables:
                    yield from one_range(tables, known)
                    tables = []
                at = part
                tables.append(pa.ipc.open_stream(blob).read_all())
        if tables:
            yield from one_range(tables, known)

    def one_range(tables: list[pa.Table], known: WordHashes) -> Iterator[pa.RecordBatch]:
        """A range of ids in order, and behind it the first document of the next."""
        import hashlib

        table = pa.concat_tables(tables)
        order = pa.compute.sort_indices(table, sort_keys=[("next", "ascending"), ("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        table = table.take(order).select(["doc_id", "text", "next"])
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
        row = None  # the row whose next one has not come yet
        for batch in table.to_batches(2000):
            out: dict[str, list] = {name: [] for name in names}
            for doc_id, text, lent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row is None and lent:
                    break  # only the first of several rows with the id that was lent
                own = sketch(text.encode(), k, words, known)
                if row is not None:
                    last_id, last, mark = row
                    half = len(last) // 2
                    edited = (last[: len(last) - half] + text[:half]).encode()
                    other = sketch(edited, k, words, known)
                    facts = (last_id, len(last), hashlib.sha256(edited).hexdigest(), packed(mark), packed(other), likeness(mark, other, k), likeness(mark, own, k))
                    for name, v in zip(names, facts, strict=True):
                        out[name].append(v)
                row = None if lent else (doc_id, text, own)
            yield pa.record_batch({name: pa.array(v, types.get(name, pa.string())) for name, v in out.items()})
            if row is None:
                break

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
