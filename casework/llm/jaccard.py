"""N-gram Jaccard join: a size-aware heavy-light join with exact verification.

A text is the set of its word shingles. Equal sets are joined first; the rest of the work is on distinct sets. Shingles have
one global order, rarest first (by counts in a fixed number of hash buckets). Two sets whose overlap is at least o share their
first common element among the first n - o + 1 of either, and their first two among the first n - o + 2. Light sets (up to a
boundary size) are filed under all two-element subsets of that prefix, which are selective but many; heavy sets are filed
under its single elements and scan those lists, also for the light sets whose size allows a link with a heavy one. The boundary
is the one that costs least, by the sizes of all documents and the mean length of a list.

A file of k sets would hold k * k / 2 pairs. Only the pairs with its most central set (whose rank of the shared element is
lowest) are checked first; components of the links found follow, and then only pairs that lie in different components and pass
the bounds on size and rank are checked. Components therefore are exact, while pairs inside a group need not be listed.

Defined cases: null or empty text has no shingle and is its own component; a text with fewer words than a shingle is one shingle
of all its words; rows with the same id are one document; rows without id are linked with nothing (component null).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import stored
from .shingles import WordHashes, mixed, shingle_hashes

BUCKETS = 1 << 22
BLOCK = 1 << 12  # buckets in one row of counts
SAMPLE = 1024  # one shingle in so many, chosen by hash, measures the mean length of lists
FILTER_BITS = 1 << 20


def least_overlap(n: Column | int, m: Column | int, percent: int):  # noqa: ANN201
    """Smallest overlap of linked sets of n and m elements: ceil(p (n + m) / (100 + p))."""
    top = percent * (n + m) + 99 + percent
    return F.floor(top / (100 + percent)) if isinstance(top, Column) else top // (100 + percent)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: a = id, b = set hash, c = set size; kind 1: a = block, blob = its buckets' counts in a task; kind 2: a = sampled shingle."""

    def rows(kind: int, a: pa.Array, **more: pa.Array) -> pa.RecordBatch:
        none = {"b": pa.nulls(len(a), pa.int64()), "c": pa.nulls(len(a), pa.int64()), "blob": pa.nulls(len(a), pa.binary())}
        return pa.record_batch({"kind": pa.array(np.full(len(a), kind, np.int8)), "a": a, **(none | more)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), np.zeros(BUCKETS, np.int32)
        for batch in batches:
            each = [shingle_hashes(text, n, known) for text in batch.column(1).to_pylist()]
            flat = np.concatenate([*each, np.empty(0, np.uint64)])
            bucket, times = np.unique((flat & np.uint64(BUCKETS - 1)).astype(np.int32), return_counts=True)
            counts[bucket] += times.astype(np.int32)
            yield rows(0, batch.column(0), b=_signed(np.array([set_hash(h) for h in each], np.uint64)), c=pa.array([len(h) for h in each], pa.int64()))
            yield rows(2, _signed(flat[(flat >> np.uint64(32)) % np.uint64(SAMPLE) == 0]))
        blocks = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield rows(1, pa.array(some), blob=pa.array([blocks[i].tobytes() for i in some], pa.binary()))

    return docs.mapInArrow(run, "kind tinyint, a bigint, b bigint, c bigint, blob binary")


def bucket_ranks(facts: DataFrame) -> np.ndarray:
    """Count of each bucket over all documents on a logarithmic scale: BUCKETS bytes, whatever the input."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for blob in rows.column("blob").to_pylist():
            total += np.frombuffer(blob, np.int32)
        scaled = np.minimum(255, np.round(6 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"a": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([scaled.tobytes()], pa.binary())})

    out = np.zeros(BUCKETS, np.uint8)
    for a, blob in facts.where("kind = 1").select("a", "blob").groupBy("a").applyInArrow(add, "a bigint, blob binary").collect():
        out[a * BLOCK : (a + 1) * BLOCK] = np.frombuffer(blob, np.uint8)
    return out


def set_hash(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(h.tobytes())


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int, most: int = 256) -> int:
    """Largest size of a light set: the boundary with the fewest rows filed and list entries visited. ``sizes``: sets by size."""
    kept = lambda n: n - -(-percent * n // 100)
    light = {n: c * comb(kept(n) + 2, 2) for n, c in sizes.items()}
    heavy = {n: c * (kept(n) + 1) * (1 + list_length) for n, c in sizes.items()}

    def cost(x: int) -> float:
        near = -(-percent * (x + 1) // 100)  # light sets from here on are also found by heavy ones
        return sum(light[n] if n <= x else heavy[n] for n in sizes) + sum(c * (kept(n) + 1) for n, c in sizes.items() if near <= n <= x)

    return min(range(most), key=cost)


def file_keys(docs: DataFrame, n: int, percent: int, boundary: int, counts: np.ndarray) -> DataFrame:
    """Each distinct set under the keys of its prefix: (key, h, facts); facts packs what ``unpacked`` gives."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), shared.value
        for batch in batches:
            seen: set[int] = set()
            parts: list[tuple[np.ndarray, bool, np.ndarray, int, int]] = []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, n, known)
                if len(h) < 2 or (name := set_hash(h)) in seen:
                    continue
                seen.add(name)
                size, keep = len(h), len(h) - -(-percent * len(h) // 100)
                c = counts[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
                first = np.argpartition(c, keep + 2)[: keep + 3] if keep + 3 < size else np.arange(size)
                # all elements that tie with the last one of the prefix take part in the order
                first = np.flatnonzero(c <= c[first].max())
                first = first[np.lexsort((h[first], c[first]))]
                if size <= boundary:
                    e = h[first[: keep + 2]]
                    i, j = np.triu_indices(len(e), 1)
                    parts.append((mixed(mixed(e[i]) * np.uint64(0x9E3779B97F4A7C15) + e[j]), False, j, name, size))
                if size > boundary or size >= -(-percent * (boundary + 1) // 100):
                    e = h[first[: keep + 1]]
                    parts.append((e, True, np.arange(len(e)), name, size))
            each = [len(p[0]) for p in parts]
            flat = lambda k: np.repeat(np.array([p[k] for p in parts], np.uint64), each)
            if parts:
                pos = np.concatenate([p[2] for p in parts]).astype(np.uint64)
                facts = (pos << np.uint64(32)) | (flat(4) << np.uint64(2)) | (flat(1) << np.uint64(1)) | (flat(4) > boundary)
                yield pa.record_batch({"key": _signed(np.concatenate([p[0] for p in parts])), "h": _signed(flat(3)), "facts": _signed(facts)})

    return docs.mapInArrow(run, "key bigint, h bigint, facts bigint")


def unpacked(df: DataFrame) -> DataFrame:
    """Rank of the key in the set (pos), size of the set (n), whether the key is an element (listed), whether the set is heavy."""
    f = F.col("facts")
    return df.select(
        "key", "h", F.shiftright(f, 32).cast("int").alias("pos"), F.shiftright(f, 2).bitwiseAND(F.lit((1 << 30) - 1)).cast("int").alias("n"),
        (F.shiftright(f, 1).bitwiseAND(F.lit(1)) == 1).alias("listed"), (f.bitwiseAND(F.lit(1)) == 1).alias("heavy"),
    )


def may_link(a: str, b: str, percent: int) -> Column:
    """Bounds on size and rank, of two sets in one file."""
    c = lambda side, name: F.col(f"{side}.{name}")
    o = least_overlap(c(a, "n"), c(b, "n"), percent)
    spare = F.when(c(a, "listed"), 0).otherwise(1)
    sizes = (100 * c(a, "n") >= percent * c(b, "n")) & (100 * c(b, "n") >= percent * c(a, "n"))
    ranks = (c(a, "pos") <= c(a, "n") - o + spare) & (c(b, "pos") <= c(b, "n") - o + spare)
    return sizes & ranks & (~c(a, "listed") | c(a, "heavy") | c(b, "heavy"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (ah, an, bh, bn) whose sets link, as vertices (a, b).

    Documents that may be wanted (by a filter of FILTER_BITS buckets over their ids) give their sets once more; an exact join follows.
    """
    spark = pairs.sparkSession
    wanted = pairs.select(F.col("ah").alias("h"), F.col("an").alias("n")).union(pairs.select("bh", "bn")).distinct().join(sets, ["h", "n"]).select("h", "n", "v")
    wanted = stored(wanted, "wanted-sets")
    bit = F.pmod(F.xxhash64("v"), F.lit(FILTER_BITS)).cast("int")
    bits = np.zeros(FILTER_BITS, bool)
    bits[[r[0] for r in wanted.select(bit.alias("v")).distinct().collect()]] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(2).to_numpy()]))
            seen: dict[int, np.ndarray] = {}
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, n, known)
                seen[set_hash(h)] = h
            yield pa.record_batch({
                "h": _signed(np.array(list(seen), np.uint64)), "n": pa.array([len(x) for x in seen.values()], pa.int32()),
                "elements": pa.array([x.tobytes() for x in seen.values()], pa.binary()),
            })

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    found = docs.select("id", "body", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int").alias("bit")).mapInArrow(run, "h bigint, n int, elements binary")
    elements = stored(found.join(wanted, ["h", "n"]).dropDuplicates(["h", "n"]), "wanted-elements")
    side = lambda s: elements.select(F.col("h").alias(f"{s}h"), F.col("n").alias(f"{s}n"), F.col("v").alias(s), F.col("elements").alias(f"{s}e"))
    both = pairs.join(side("a"), ["ah", "an"]).join(side("b"), ["bh", "bn"])
    return both.select("a", "b", "ae", "be").mapInArrow(check, "a bigint, b bigint")


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("body"))
    facts = stored(describe(docs, n), "jaccard-facts")
    rows = facts.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("h"), F.col("c").cast("int").alias("n"))
    sets = stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("h", "n").agg(F.min("doc_id").alias("v")), "jaccard-sets")
    counts = bucket_ranks(facts)
    distinct, total = facts.where("kind = 2").groupBy("a").count().agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    sizes = {r[0]: r[1] for r in sets.groupBy(F.least("n", F.lit(256)).alias("n")).count().collect()}
    boundary = choose_boundary(sizes, total / max(1, distinct), percent)

    keys = stored(file_keys(docs, n, percent, boundary, counts), "jaccard-keys")
    # most keys are of one set only: they go before anything else is looked at
    files = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max(F.col("facts").bitwiseAND(F.lit(3)) != 2).alias("useful"))
    files = files.where((F.col("lo") != F.col("hi")) & F.col("useful")).select("key")
    shared = stored(unpacked(keys.join(files, "key")), "jaccard-files")
    # heavy ones first, then the lowest rank, then the largest
    order = F.when(F.col("heavy"), 0).otherwise(1) * F.lit(1 << 62) + F.col("pos") * F.lit(1 << 31) - F.col("n")
    center = shared.groupBy("key").agg(F.min_by(F.struct("pos", "h", "n", "heavy"), F.struct(order, "h")).alias("m"))
    center = center.select("key", F.col("m.pos").alias("cpos"), F.col("m.h").alias("ch"), F.col("m.n").alias("cn"), F.col("m.heavy").alias("cheavy"))
    row = shared.join(center, "key").select(
        F.struct("listed", "heavy", "pos", "h", "n").alias("a"),
        F.struct("listed", F.col("cheavy").alias("heavy"), F.col("cpos").alias("pos"), F.col("ch").alias("h"), F.col("cn").alias("n")).alias("b"),
    ).where("a.h <> b.h OR a.n <> b.n").where(may_link("a", "b", percent))
    stars = row.select(F.col("a.h").alias("ah"), F.col("a.n").alias("an"), F.col("b.h").alias("bh"), F.col("b.n").alias("bn")).distinct()
    links = stored(verified(stored(stars, "jaccard-stars"), docs, sets, n, percent), "jaccard-links")
    roots = components(links)

    # files that still hold several components: pairs between them
    named = shared.join(sets, ["h", "n"]).join(roots.withColumnRenamed("vertex", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = stored(named.select("key", "listed", "heavy", "pos", "h", "n", "root").distinct(), "jaccard-members")
    several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = stored(named.join(several, "key"), "jaccard-open")
    x, y = open_.alias("a"), open_.alias("b")
    cross = x.join(
        y,
        (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & may_link("a", "b", percent),
    ).select(F.col("a.h").alias("ah"), F.col("a.n").alias("an"), F.col("b.h").alias("bh"), F.col("b.n").alias("bn")).distinct()
    stars_too = stars.select("ah", "an", "bh", "bn").union(stars.select("bh", "bn", "ah", "an"))
    cross = stored(cross.join(stars_too, ["ah", "an", "bh", "bn"], "left_anti"), "jaccard-cross")
    if not cross.isEmpty():
        more = verified(cross, docs, sets, n, percent)
        roots = components(stored(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).union(more), "jaccard-links"))

    named = sets.join(roots.withColumnRenamed("vertex", "v"), "v", "left").select("h", "n", F.coalesce("root", "v").alias("component"))
    out = rows.join(named, ["h", "n"], "left")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )
