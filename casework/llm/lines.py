"""Line dedup: lines found in many documents go from all of them.

Distinct line hashes with their document counts are dealt to shards of bounded size. Each shard becomes a minimal perfect
hash (bit levels: a key sits at its position on the first level where no other remaining key wants it, its index is the rank
of that bit) over two compact arrays, fingerprints and counts. Documents send line hashes, never lines, to the shards and
get back the hashes to drop, each task once for rows of the same text; shards that many documents ask are copied, so that no task
answers for a common line alone.

Defined cases: null or empty text is one empty line; lines are compared stripped of ASCII white space and in ASCII lower case;
lines with fewer than ``least_chars`` code points are never dropped; every row is a document, so repeated rows count
repeatedly; other columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .scratch import partitions, stored

SHARD_KEYS = 4096
GAMMA = 1.6
MOST_TEXTS = 500_000  # whose asking a task remembers


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def keys_of(text: bytes | None, least_chars: int) -> list[bytes]:
    """Hash of each line, b"" for lines too short to be dropped."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line_key(line)
        long = len(key) >= least_chars and (least_chars <= 1 or len(key.decode("utf-8", "replace")) >= least_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else b"")
    return out


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A fresh hash of 128-bit keys for each level."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) * (keys[:, 1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys, given as an (n, 2) array of uint64."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        ones = np.unpackbits(bits, bitorder="little")
        self.ones, self.rank = ones, np.cumsum(ones, dtype=np.int64) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            m = max(8, int(len(left) * GAMMA + 7) // 8 * 8)
            at = (_mixed(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.empty(0, np.uint8))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for some keys outside the set, any index for others."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = base + (_mixed(keys[left], level) % np.uint64(m)).astype(np.int64)
            hit = self.ones[at] == 1
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + int(m)
        return out


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def line_counts(docs: DataFrame, text: str = "text", least_chars: int = 1) -> DataFrame:
    """Line hash and in how many documents it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            for t in batch.column(0).to_pylist():
                for k in set(keys_of(t, least_chars)):
                    seen[k] = seen.get(k, 0) + 1
            seen.pop(b"", None)
            yield pa.record_batch({"line": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    found = docs.select(F.col(text).cast("binary")).mapInArrow(count, "line binary, n bigint")
    return found.groupBy("line").agg(F.sum("n").alias("n"))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys[:, 0] >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def build_index(counts: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """One row per shard: perfect hash, fingerprints, counts, and the sum of counts (how often it will be asked)."""
    shards = max(1, -(-n_keys // SHARD_KEYS))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _shard_of(_pairs(batch.column(0).to_pylist()), shards) if batch.num_rows else []
            yield pa.record_batch({"shard": pa.array(at, pa.int64()), "line": batch.column(0), "n": batch.column(1)})

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        keys, n = _pairs(rows.column("line").to_pylist()), rows.column("n").to_numpy()
        mph = PerfectHash.build(keys)
        at = mph.index(keys)
        prints, counts = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
        prints[at], counts[at] = (keys[:, 1] >> np.uint64(32)).astype(np.uint32), n
        blobs = (mph.sizes.tobytes(), mph.bits.tobytes(), prints.tobytes(), counts.tobytes())
        return pa.table({
            "shard": [key[0].as_py()], "asked": pa.array([int(n.sum())], pa.int64()),
            **{name: pa.array([b], pa.binary()) for name, b in zip(("sizes", "bits", "prints", "counts"), blobs, strict=True)},
        })

    schema = "shard bigint, asked bigint, sizes binary, bits binary, prints binary, counts binary"
    dealt = counts.mapInArrow(shard, "shard bigint, line binary, n bigint")
    return dealt.groupBy("shard").applyInArrow(build, schema), shards


def questions(batches: Iterator[pa.RecordBatch], shards: int, copies: dict[int, int], least_chars: int) -> Iterator[pa.RecordBatch]:
    """Of (text_key, text): which copy of which shard is asked for which line; a task asks once for rows with the same text."""
    asked: set[bytes] = set()
    for batch in batches:
        owner, lines = [], []
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key in asked:
                continue
            if len(asked) >= MOST_TEXTS:
                asked.clear()
            asked.add(key)
            mine = set(keys_of(t, least_chars)) - {b""}
            lines += mine
            owner += [key] * len(mine)
        shard = _shard_of(_pairs(lines), shards) if lines else np.empty(0, np.int64)
        turn = np.frombuffer(b"".join(owner), np.uint32)[::4] if lines else np.empty(0, np.uint32)
        many = np.array([copies.get(s, 1) for s in shard.tolist()], np.int64)
        yield pa.record_batch({
            "shard": pa.array(shard), "copy": pa.array(turn.astype(np.int64) % np.maximum(many, 1)),
            "text_key": pa.array(owner, pa.binary()), "line": pa.array(lines, pa.binary()),
        })


def common_lines(docs: DataFrame, least_docs: int, text: str = "text", least_chars: int = 1) -> DataFrame:
    """For each text (md5) that has any: the hashes of its lines found in at least ``least_docs`` documents."""
    spark = docs.sparkSession
    counts = stored(line_counts(docs, text, least_chars), "line-counts")
    n_keys, asked = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    index, shards = build_index(counts, n_keys)
    index = stored(index, "line-index")
    # a shard that is asked more than its share is copied; at most 2 * parts shards can be
    parts = partitions(spark)
    share = max(1, asked // (2 * parts))
    copies = {r[0]: -(-r[1] // share) for r in index.where(F.col("asked") > share).select("shard", "asked").collect()}
    several = F.lit(1)
    if copies:
        several = F.when(F.col("asked") > share, F.ceil(F.col("asked") / F.lit(share))).otherwise(1)
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), several.cast("bigint") - 1)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return questions(batches, shards, copies, least_chars)

    def answer(key: tuple, asking: pa.Table, shard: pa.Table) -> pa.Table:
        blob = {c: shard.column(c)[0].as_py() for c in ("sizes", "bits", "prints", "counts")} if shard.num_rows else None
        if blob is None or not asking.num_rows:
            return asking.select(["text_key", "line"]).slice(0, 0)
        mph = PerfectHash(np.frombuffer(blob["sizes"], np.int64), np.frombuffer(blob["bits"], np.uint8))
        keys = _pairs(asking.column("line").to_pylist())
        at = mph.index(keys)
        same = np.frombuffer(blob["prints"], np.uint32)[at] == (keys[:, 1] >> np.uint64(32)).astype(np.uint32)
        hit = (at >= 0) & same & (np.frombuffer(blob["counts"], np.int64)[at] >= least_docs)
        return asking.select(["text_key", "line"]).filter(pa.array(hit))

    texts = docs.select(text_key(text).alias("text_key"), F.col(text).cast("binary").alias("text"))
    asking = texts.mapInArrow(ask, "shard bigint, copy bigint, text_key binary, line binary")
    found = asking.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInArrow(answer, "text_key binary, line binary")
    return found.groupBy("text_key").agg(F.collect_set("line").alias("lines"))


def text_key(text: str):  # noqa: ANN201
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def drop_common_lines(docs: DataFrame, least_docs: int = 10, text: str = "text", least_chars: int = 1) -> DataFrame:
    """``docs`` with the text's remaining lines joined by newlines (null becomes empty), and __n_lines, __n_dropped."""
    # stored, so that the join has a shuffle of its own and a text that very many rows share can be split
    common = stored(common_lines(docs, least_docs, text, least_chars), "common-lines").select(F.col("text_key").alias("__key"), F.col("lines").alias("__drop"))
    joined = docs.withColumn("__key", text_key(text)).join(common, "__key", "left").drop("__key")
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            at = batch.schema.get_field_index(text)
            for t, drop in zip(batch.column(at).to_pylist(), batch.column("__drop").to_pylist(), strict=True):
                t = t or ""
                n_lines.append(t.count("\n") + 1)
                n_dropped.append(0)
                if drop:
                    drop = set(drop)
                    lines = [x for x, k in zip(t.split("\n"), keys_of(t.encode(), least_chars), strict=True) if k not in drop]
                    n_dropped[-1] = n_lines[-1] - len(lines)
                    t = "\n".join(lines)
                kept.append(t)
            cols = [pa.array(kept, pa.string()) if i == at else batch.column(i) for i in range(len(schema))]
            yield pa.record_batch(
                [*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*schema.names, "__n_lines", "__n_dropped"]
            )

    order = [F.col(c) for c in schema.names]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return joined.select(*order, "__drop").mapInArrow(keep, f"{out}, __n_lines bigint, __n_dropped bigint")
