"""Ranked lexical search over K2-treaps of term-document grids.

``build_index`` cuts the documents of each task into blocks of bounded size; no row is shuffled. A block's grid has a row for each
of its terms, frequent ones first so that neighbours are alike, a column for each of its documents by ascending id, and in each
cell the term's impact in the document: 10 ** 9 * tf div (1000 * tf + 12 * m), where m grows with the document's length against the
mean. ``search`` weighs the terms of each item by their rarity among all documents and lets the item's row paths descend
together, best document range first, in every block; a task keeps the best of all its blocks, so a block is left as soon as it
cannot add to them. What is shuffled are document frequencies of the items' terms and ``k`` documents per item and task.

Defined cases: null and empty texts, and texts without terms, are in no index and match nothing; so do items without known terms;
terms that nearly all documents hold may weigh 0, and documents with score 0 are not listed; equal scores go by ascending id, rows
without id last; repeated document rows rank each, repeated item rows are answered each; very long texts fill a block alone; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import stored
from .text import lower_ascii
from .treap import Treap

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for UTF-8 bytes: letters A to Z become lower case, other ASCII characters but letters and digits a blank.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
BLOCK_DOCS, BLOCK_TERMS = 2048, 1_000_000
ITEMS_PER_PACK, MOST_HELD = 256, 50_000
BROADCAST_BYTES = 8 << 20
GROUP_BYTES = 16 << 20  # of the stored tables, whose rows have several MB each
LAST_ID = np.iinfo(np.int64).max
SALTS = 256

GRID = "n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>, vocabulary array<string>, df array<int>, documents binary, tf binary"
BLOCK = "ids array<bigint>, vocabulary array<string>, df array<int>, treap binary"


@dataclass(frozen=True)
class Index:
    blocks: DataFrame  # BLOCK
    n_docs: int  # with at least one term
    n_terms: int


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Gathered:
    """Documents of one block to be. Terms are numbered as they come, so that a document is an array of numbers and one of counts."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.docs: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts, number = Counter(words), self.number
        own = np.fromiter((number.setdefault(t, len(number)) for t in counts), np.uint32, len(counts))
        self.docs.append((doc_id, own, np.fromiter(counts.values(), np.uint32, len(counts))))
        self.size += len(words)

    def grid(self) -> pa.RecordBatch:
        """One row: postings ordered by term (frequent first) and document (by id)."""
        docs = sorted(self.docs, key=lambda d: (d[0] is None, d[0] or 0))
        numbers, tf = (np.concatenate([d[i] for d in docs]) for i in (1, 2))
        names = sorted(self.number)
        known = np.fromiter((self.number[t] for t in names), np.int64, len(names))
        df = np.bincount(numbers, minlength=len(names))[known]
        frequent = np.argsort(-df, kind="stable")
        place = np.empty(len(names), np.uint32)
        place[known[frequent]] = np.arange(len(names), dtype=np.uint32)
        order = np.argsort(place[numbers], kind="stable")
        columns = np.repeat(np.arange(len(docs), dtype="<u4"), [len(d[1]) for d in docs])
        lengths = [int(d[2].sum(dtype=np.int64)) for d in docs]
        row = [
            len(docs), sum(lengths), [d[0] for d in docs], lengths, [names[i].decode() for i in frequent.tolist()], df[frequent],
            *(zstandard.compress(numbers[order].astype("<u4").tobytes(), 1) for numbers in (columns, tf)),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, GRID_TYPES.types, strict=True)], schema=GRID_TYPES)


GRID_TYPES = pa.schema([
    ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("vocabulary", pa.list_(pa.string())),
    ("df", pa.list_(pa.int32())), ("documents", pa.binary()), ("tf", pa.binary()),
])
HIT_TYPES = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> Index:
    """Indexes every row. Texts are read once: counts by block are stored, and become treaps when the corpus sums are known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1)):
                words = terms(t.as_py())
                if not words:
                    continue
                held.add(d.as_py(), words)
                if len(held.docs) >= block_docs or held.size >= block_terms:
                    yield held.grid()
                    held = Gathered()
        if held.docs:
            yield held.grid()

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    grids = stored(slim.mapInArrow(count, GRID), "search-grids", GROUP_BYTES)
    n_docs, n_terms = grids.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield grown(batch.slice(i, 1))

    def grown(one: pa.RecordBatch) -> pa.RecordBatch:
        lengths, df = (one.column(c)[0].values.to_numpy() for c in ("lengths", "df"))
        at, tf = (np.frombuffer(zstandard.decompress(one.column(c)[0].as_py()), "<u4") for c in ("documents", "tf"))
        m, tf = 75 + 25 * lengths * n_docs // n_terms, tf.astype(np.int64)
        impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[at])
        treap = Treap.of(np.repeat(np.arange(len(df), dtype=np.uint32), df), at, impacts, (len(df), len(m))).packed()
        return pa.record_batch([*(one.column(c) for c in ("ids", "vocabulary", "df")), pa.array([treap], pa.binary())], names=["ids", "vocabulary", "df", "treap"])

    return Index(stored(grids.mapInArrow(grow, BLOCK), "search-index", GROUP_BYTES), n_docs, n_terms)


def rarity(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * df + 1))).cast("bigint")


def weighted_items(index: Index, items: DataFrame, text: str) -> DataFrame:
    """item, terms (array of term and weight): each item's terms that some document holds, repeats added up."""
    found = items.select("item", F.explode(F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(TERM), F.lit(0))).alias("term"))
    asked = stored(found.groupBy("item", "term").agg(F.count("*").alias("n")), "search-terms")
    known = index.blocks.select(F.explode(F.arrays_zip("vocabulary", "df")).alias("t")).select(F.col("t.vocabulary").alias("term"), F.col("t.df").alias("df"))
    df = known.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weights = asked.join(df, "term").withColumn("weight", F.col("n") * rarity(F.col("df"), index.n_docs)).where("weight > 0")
    return weights.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))


def waves(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Packs in groups whose bytes stay below the bound."""
    out, total = [], 0
    for pack, size in sorted(sizes):
        if not out or total + size > BROADCAST_BYTES:
            out, total = [*out, []], 0
        out[-1].append(pack)
        total += size
    return out


class Asked:
    """The items of a pack: their terms as numbers among the pack's terms, and weights."""

    def __init__(self, items: list[dict]) -> None:
        self.terms = pa.array(sorted({t["term"] for i in items for t in i["terms"]}), pa.string())
        number = {t: n for n, t in enumerate(self.terms.to_pylist())}
        self.items = [(i["item"], np.array([number[t["term"]] for t in i["terms"]], np.int64), np.array([t["weight"] for t in i["terms"]], np.int64)) for i in items]

    def rows_in(self, vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each item with rows of the block's grid and weights of those terms that the block has."""
        rows = pc.fill_null(pc.index_in(self.terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        for item, terms_, weights in self.items:
            own = rows[terms_]
            here = own >= 0
            if here.any():
                yield item, own[here], weights[here]


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item, exactly.

    Items travel in packs of about ITEMS_PER_PACK, and each block meets each pack once. Packs are broadcast in waves of at most
    BROADCAST_BYTES (a pack that is larger goes alone), so more items mean more passes over the index and no larger broadcast.
    """
    numbered = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "search-items")
    many = max(1, -(-numbered.count() // ITEMS_PER_PACK))
    pack_of = F.pmod(F.xxhash64("item"), F.lit(many)).cast("int")
    size = F.aggregate("terms", F.lit(0).cast("bigint"), lambda acc, t: acc + F.octet_length(t["term"]) + 24)
    packs = weighted_items(index, numbered, "text").groupBy(pack_of.alias("pack")).agg(F.collect_list(F.struct("item", "terms")).alias("items"), F.sum(size).alias("bytes"))
    packs = stored(packs, "search-packs")
    blocks = index.blocks.select("ids", "vocabulary", "treap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by item: scores and ids, best first
        asked: dict[int, Asked] = {}  # by pack of this wave
        for batch in batches:
            for i in range(batch.num_rows):
                pack = batch.column("pack")[i].as_py()
                if pack not in asked:
                    asked[pack] = Asked(batch.column("items")[i].as_py())
                treap, vocabulary = Treap.unpacked(batch.column("treap")[i].as_py()), batch.column("vocabulary")[i].values
                ids = pc.fill_null(batch.column("ids")[i].values, LAST_ID).to_numpy()
                for item, rows, weights in asked[pack].rows_in(vocabulary):
                    scores, found = best.get(item, (none, none))
                    columns, more = treap.best_columns(rows, weights, k, int(scores[-1]) if len(scores) == k else 1)
                    if len(more):
                        scores, found = np.concatenate([scores, more]), np.concatenate([found, ids[columns]])
                        order = np.lexsort((found, -scores))[:k]
                        best[item] = scores[order], found[order]
                del treap  # before the next one is unpacked
                if len(best) > MOST_HELD:
                    yield hits(best)
                    best = {}
        yield hits(best)

    def hits(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        none = np.empty(0, np.int64)
        scores, ids = (np.concatenate([none, *(b[i] for b in best.values())]) for i in (0, 1))
        numbers = np.concatenate([none, *(np.full(len(s), item) for item, (s, _) in best.items())])
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(ids, mask=ids == LAST_ID), pa.array(scores)], schema=HIT_TYPES)

    met = [
        blocks.withColumn("pack", F.explode(F.array(*map(F.lit, wave)))).join(F.broadcast(packs.where(F.col("pack").isin(wave)).drop("bytes")), "pack")
        for wave in waves(packs.select("pack", "bytes").collect())
    ]
    if not met:
        return numbered.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    found = reduce(DataFrame.unionAll, [m.mapInArrow(run, "item bigint, doc_id bigint, score bigint") for m in met])
    found = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
