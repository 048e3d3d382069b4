"""Language-model scoring by a hierarchical Pitman-Yor model over the bytes of tokens.

Tokens are words and one end per text; a word is spelled byte by byte and closed by a space, the last one by the end, so the
probability of a text is the product over its bytes and no word is unknown. Contexts of eight bytes reach into the word before. A restaurant belongs to a context of up to
``order`` - 1 bytes and shares its parent with all contexts that end alike; the root's base is uniform over bytes. Each
table of a restaurant is a customer of its parent. Seating is sampled by Gibbs sweeps: the tables of one dish in one restaurant
are drawn anew, given those of all others and the parent's predictive probabilities. Dishes of one sweep are drawn side by
side. Probabilities are averaged over samples.

On the cluster, documents are packed into byte streams of bounded size (``pack_bytes``, or one text). A pack asks each bucket for
its distinct n-grams and words there: sorted, with training counts, byte by byte in one compressed cell. Restaurants whose contexts share
the last three bytes lie in one bucket together with their parent and are sampled there; the contexts of at most two bytes (256 ** 3
dishes at most) are sampled in one task. A bucket's first samples only hand their tables up; they are drawn again, alike, when the last
is, so that no probabilities wait on disk. Every n-gram that occurs in any text, trained on or not, gets its probability, and packs get
back those they asked for, in the order asked, as whole numbers of 1 / STEP of log10.

Defined cases: null text counts as empty and is one end token; rows without id are trained on; equal texts get equal scores;
without training rows every byte has probability 1/256 and base counts are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .scratch import stored
from .shingles import PRIME, mixed

ORDER = 9
PACK_BYTES = 32 << 20
BUCKET_BYTES = 1 << 20  # of text for each bucket: some 100,000 distinct n-grams
SENT_ROWS = 64  # at a time
SLICE = 1 << 18
GROUP = 6 << 20
SENT_BASES = 1_000_000  # trigrams of all buckets up to which they are broadcast
EXACT = 32  # customers up to which the number of tables is drawn from its exact distribution
SWEPT = 20_000  # rows at a time
CONCENTRATION = 1.0
SAMPLES = 3
SWEEPS = 4
END = b"\n"
WIDEST = 9  # bytes: one before the last, and a number of the others
STEP = 4096


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def stirling_steps(d: float, n: int = EXACT) -> np.ndarray:
    """Row t, column c: how many more ways, as a factor, the generalised Stirling numbers S_d have to seat c customers at t tables than at t - 1."""
    s = np.zeros((n + 1, n + 1))
    s[0, 0] = 1
    for c in range(1, n + 1):
        s[c, 1 : c + 1] = s[c - 1, :c] + (c - 1 - d * np.arange(1, c + 1)) * s[c - 1, 1 : c + 1]
    steps = np.zeros((n + 1, n + 1))
    for t in range(2, n + 1):
        steps[t, t:] = s[t:, t] / s[t:, t - 1]
    return steps


def discount(c: np.ndarray) -> float:
    """From how many dishes have one and two customers."""
    one, two = int((c == 1).sum()), int((c == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


class Level:
    """All restaurants of one context length: rows are (restaurant, dish)."""

    def __init__(self, restaurant: np.ndarray, customers: np.ndarray, d: float | None = None, numbered: bool = False) -> None:
        self.r = restaurant if numbered else np.unique(restaurant, return_inverse=True)[1]
        self.n = int(self.r.max()) + 1 if len(self.r) else 0
        self.seat(customers, d)

    def seat(self, customers: np.ndarray, d: float | None = None) -> None:
        """New customers; at first one table per dish."""
        self.c = customers.astype(np.int64)
        self.d = discount(self.c) if d is None else d
        self.steps = stirling_steps(self.d)
        self.t = np.minimum(self.c, 1)
        self.total = np.bincount(self.r, self.c, self.n)

    def sweep(self, base: np.ndarray, rng: np.random.Generator) -> None:
        """Draws the tables of every dish, given those of the restaurant's others and the parent's probabilities."""
        d, tables = self.d, np.bincount(self.r, self.t, self.n)
        new, many = np.minimum(self.c, 1), np.flatnonzero(self.c > 1)
        others = np.zeros_like(self.t)
        others[many] = tables[self.r[many]] - self.t[many]
        first = np.minimum(self.c[many], EXACT).astype(np.uint8)
        by_size = np.argsort(first, kind="stable")[::-1]  # rows with more customers first: those that can have t tables lead
        for x in range(0, len(many), SWEPT):
            rows, sizes = many[by_size[x : x + SWEPT]], first[by_size[x : x + SWEPT]].astype(np.int64)
            more, base_ = CONCENTRATION + d * others[rows], base[rows]
            weight, share = np.ones(len(rows)), np.ones(len(rows))  # of t tables and of at most t, where one table weighs 1
            for t in range(2, EXACT + 1):
                n = len(sizes) - int(np.searchsorted(sizes[::-1], t))
                weight, share = weight[:n] * self.steps[t].take(sizes[:n]) * (more[:n] + d * (t - 1)) * base_[:n], share[:n]
                share = share + weight
                new[rows[:n][rng.random(n) * share < weight]] = t
                if t % 3 == 0:  # weights rise, then fall ever faster: what is left of those that have vanished is below rounding
                    some = weight > 1e-18 * share
                    rows, sizes, more, base_, weight, share = rows[:n][some], sizes[:n][some], more[:n][some], base_[:n][some], weight[some], share[some]
                if not n:
                    break
        # further customers sit down in blocks that grow with the number seated
        rows, seated = np.flatnonzero(self.c > EXACT), EXACT
        while len(rows):
            block = np.minimum(max(1, seated // 8), self.c[rows] - seated)
            fresh = (CONCENTRATION + d * (others[rows] + new[rows])) * base[rows]
            new[rows] += rng.binomial(block, fresh / (fresh + seated + (block - 1) / 2 - d * new[rows]))
            seated += max(1, seated // 8)
            rows = rows[self.c[rows] > seated]
        self.t = new

    def seat_more(self, customers: np.ndarray) -> None:
        """Customers after a sweep of the children; tables stay within them until the next sweep."""
        self.c = customers.astype(np.int64)
        self.t = np.clip(self.t, np.minimum(self.c, 1), self.c)
        self.total = np.bincount(self.r, self.c, self.n)

    def predict(self, base: np.ndarray) -> np.ndarray:
        tables = np.bincount(self.r, self.t, self.n)
        total, tables = self.total[self.r], tables[self.r]
        back = np.where(total > 0, CONCENTRATION + self.d * tables, 1.0)
        return (np.maximum(self.c - self.d * self.t, 0.0) + back * base) / np.where(total > 0, CONCENTRATION + total, 1.0)


Grams = tuple[np.ndarray, np.ndarray]


def _taken(g: Grams, at: np.ndarray) -> Grams:
    return g[0][at], g[1][at]


class Lookup:
    """Values of distinct n-grams: a table by hash, and another of those whose slot was taken."""

    def __init__(self, keys: Grams, values: np.ndarray, turn: int = 0) -> None:
        n, self.turn = len(values), turn
        self.bits = max(4, int(np.ceil(np.log2(max(1, n) * 2))))
        self.near, self.far = np.full(1 << self.bits, ~np.uint64(0), np.uint64), np.zeros(1 << self.bits, np.uint16)
        self.values = np.zeros(1 << self.bits, np.float32)
        slot = self.slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.near[slot[first]], self.far[slot[first]], self.values[slot[first]] = *_taken(keys, first), values[first]
        rest = np.ones(n, bool)
        rest[first] = False
        self.rest = Lookup(_taken(keys, rest), values[rest], turn + 1) if rest.any() else None

    def slot(self, keys: Grams) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(mixed(keys[0] + np.uint64(self.turn)) + keys[1]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: Grams) -> np.ndarray:
        slot = self.slot(keys)
        out = self.values[slot].astype(np.float64)
        miss = np.flatnonzero((self.near[slot] != keys[0]) | (self.far[slot] != keys[1])) if self.rest else []
        if len(miss):
            out[miss] = self.rest[_taken(keys, miss)]
        return out


def word_keys(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and how many each has."""
    keys = [np.fromiter(map(xxhash.xxh3_64_intdigest, w := [*b.split(), END]), np.uint64, len(w)) for b in bodies]
    return np.concatenate(keys), np.fromiter(map(len, keys), np.int64, len(keys))


def _body(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split()) + END


def _pressed(a: np.ndarray, before: bytes = b"") -> bytes:
    """Unsigned numbers as one compressed cell: first all their highest bytes, last all their lowest."""
    planes = a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.compress(before + planes.tobytes(), 3)


def _planes(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(cell), np.uint8).reshape(-1, n)


def _numbers(planes: np.ndarray) -> np.ndarray:
    kind = f"u{len(planes)}"
    return np.ascontiguousarray(planes.T).view(f">{kind}").ravel().astype(kind)


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _heads(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = sorted_[0][1:] != sorted_[0][:-1]
    for x in sorted_[1:]:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _counted(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is trained on."""
    learned = np.sort(keys[trained])
    at = _heads(learned)
    every = np.sort(np.concatenate([learned[at], keys[~trained]]))
    every = every[_heads(every)]
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, learned[at])] = np.diff(at, append=len(learned))
    return every, n


def _stream(bodies: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts behind order - 1 ends each, where they begin, and their lengths."""
    pad = END * (order - 1)
    length = np.fromiter(map(len, bodies), np.int64, len(bodies))
    return np.frombuffer(pad + pad.join(bodies), np.uint8), np.cumsum(length + len(pad)) - length, length


def _by_context(stream: np.ndarray, begin: np.ndarray, length: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each byte and the byte before it: that byte, the positions in texts that follow the two, and the n-grams that end there.

    An n-gram's number has the context from its second last byte backwards and then the dish, so numbers in order have restaurants together.
    Bytes are taken some at a time, so that at most GROUP positions, or those of one byte, are held.
    """
    pad = order - 1
    inside = np.repeat(np.tile([False, True], len(begin)), np.stack([np.full(len(begin), pad), length], 1).ravel())
    slices = range(pad, len(stream), SLICE)
    present = sum(np.bincount(stream[x - 1 : min(x + SLICE, len(stream)) - 1], minlength=256) for x in slices)
    group = np.where(present > 0, np.cumsum(present) // GROUP, -1)
    for g in np.unique(group[present > 0]).tolist():
        found: dict[int, list[Grams]] = {v: [] for v in np.flatnonzero(group == g).tolist()}
        for x in slices:
            end = min(x + SLICE, len(stream))
            last = stream[x - 1 : end - 1]
            at = np.flatnonzero((group == g)[last] & inside[x:end])
            last = last[at]
            by_last = np.argsort(last, kind="stable")
            at = at[by_last]
            key, slice_ = np.zeros(len(at), np.uint64), stream[x - pad : end]
            for j in range(2, WIDEST):
                key <<= np.uint64(8)
                if j < order:
                    key |= slice_[at + (pad - j)]
            key = key << np.uint64(8) | slice_[at + pad]
            at = (at + x).astype(np.int32 if len(stream) < 1 << 31 else np.int64)
            cuts = _heads(last[by_last]).tolist() if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=False):
                found[int(last[by_last[a]])].append((key[a:b], at[a:b]))
        for v in sorted(found):
            parts = found.pop(v)
            if parts:
                key, at = (np.concatenate(p) for p in zip(*parts, strict=True))
                del parts
                second = (key >> np.uint64(56)).astype(np.uint8)
                by_second = np.argsort(second, kind="stable")
                ends = np.cumsum(np.bincount(second, minlength=256)).tolist()
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    if b > a:
                        yield v, at[by_second[a:b]], key[by_second[a:b]]


def _buckets_of(v: int, grams: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of each run of sorted n-grams whose contexts share three bytes."""
    top = grams >> np.uint64(48)
    at = _heads(top)
    with np.errstate(over="ignore"):
        bucket = mixed(mixed(top[at] | np.uint64(v << 16)) + np.uint64(PRIME)) % np.uint64(buckets)
    return zip(bucket.tolist(), at.tolist(), [*at[1:].tolist(), len(grams)], strict=True)


def _word_cuts(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted words of each bucket begin, and the last one's end."""
    return np.searchsorted((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _texts(body: bytes) -> list[bytes]:
    return [b + END for b in zstandard.decompress(body).split(END)[:-1]]


def packs(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """Texts and ids, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0

        def pack(bodies: list[bytes], ids: list[int | None]) -> pa.RecordBatch:
            body = zstandard.compress(b"".join(bodies), 6)
            return pa.record_batch({"pack": pa.array([(task << 32) + made]), "body": pa.array([body], pa.binary()), "ids": pa.array([ids], pa.list_(pa.int64()))})

        bodies, ids, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = _body(text)
                if bodies and size + len(body) > pack_bytes:
                    yield pack(bodies, ids)
                    bodies, ids, size, made = [], [], 0, made + 1
                bodies.append(body)
                ids.append(doc_id)
                size += len(body)
        if bodies:
            yield pack(bodies, ids)

    return docs.mapInArrow(run, "pack bigint, body binary, ids array<bigint>")


ASKED = "pack bigint, n_grams int, grams binary, counts binary, n_words int, words binary, word_counts binary"


def asked(found: DataFrame, order: int, buckets: int) -> DataFrame:
    """Of each bucket what packs ask it for: their distinct n-grams and words there, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from pack(batch.column("pack")[i].as_py(), _texts(batch.column("body")[i].as_py()), batch.column("ids")[i].as_py())

    def pack(number: int, bodies: list[bytes], ids: list[int | None]) -> Iterator[pa.RecordBatch]:
        learned = np.array([not held_out(i) for i in ids])
        keys, tokens = word_keys(bodies)
        words, word_n = _counted(keys, np.repeat(learned, tokens))
        del keys
        stream, begin, length = _stream(bodies, order)
        del bodies
        trained = np.repeat(np.tile([False, True], len(begin)) & np.repeat(learned, 2), np.stack([np.full(len(begin), order - 1), length], 1).ravel())
        parts: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for v, at, key in _by_context(stream, begin, length, order):
            grams, n = _counted(key, trained[at])
            n = _narrow(n)
            for bucket, a, b in _buckets_of(v, grams, buckets):
                parts.setdefault(bucket, []).append((v, grams[a:b], n[a:b]))
        cuts, rows = _word_cuts(words, buckets), []
        for bucket in range(buckets):
            a, b = cuts[bucket : bucket + 2]
            some = parts.pop(bucket, [])
            if some or b > a:
                grams = np.concatenate([g for _, g, _ in some]) if some else np.empty(0, np.uint64)
                n = _narrow(np.concatenate([n for _, _, n in some])) if some else np.empty(0, np.uint8)
                rows.append({
                    "bucket": bucket, "pack": number, "n_grams": len(grams), "grams": _pressed(grams, b"".join(bytes([v]) * len(g) for v, g, _ in some)), "counts": _pressed(n),
                    "n_words": int(b - a), "words": _pressed(np.diff(words[a:b], prepend=np.uint64(0))), "word_counts": _pressed(_narrow(word_n[a:b])),
                })
            if len(rows) == SENT_ROWS or rows and bucket == buckets - 1:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows = []

    kinds = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("n_grams", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int32()), ("words", pa.binary()), ("word_counts", pa.binary())])
    rows = found.mapInArrow(run, f"bucket int, {ASKED}")
    return rows.groupBy("bucket").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "bucket"])).alias("asks"))


class Bucket:
    """Distinct n-grams and words of a bucket, and where the asked ones of each pack are among them."""

    def __init__(self, asks: list[dict], order: int) -> None:
        self.asks, self.order = sorted(asks, key=lambda a: a["pack"]), order
        keys = [np.cumsum(_numbers(_planes(a["words"], a["n_words"])), dtype=np.uint64) if a["n_words"] else np.empty(0, np.uint64) for a in self.asks]
        self.words, self.word_at, self.word_n = self._united([k for k in keys], [(a["word_counts"], a["n_words"]) for a in self.asks])
        lasts, keys = [], []
        for a in self.asks:
            planes = _planes(a["grams"], a["n_grams"]) if a["n_grams"] else np.empty((WIDEST, 0), np.uint8)
            lasts.append(planes[0])
            keys.append(_numbers(planes[1:]))
        # n-grams after one byte at a time, so that the rest is a number
        last, gram, count, at = [], [], [], [[] for _ in self.asks]
        size = 0
        for v in sorted({int(x) for some in lasts for x in some[_heads(some)]} if any(map(len, lasts)) else ()):
            cuts = [np.searchsorted(x, [v, v + 1]) for x in lasts]
            every, where, _ = self._united([k[a:b] for k, (a, b) in zip(keys, cuts, strict=True)], None)
            last.append(np.full(len(every), v, np.uint8))
            gram.append(every)
            for x, w in zip(at, where, strict=True):
                x.append(w + size)
            size += len(every)
        whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        self.last, self.gram, self.at = whole(last, np.uint8), whole(gram, np.uint64), [whole(x, np.int64) for x in at]
        self.n = self._sums([(a["counts"], a["n_grams"]) for a in self.asks], self.at, size)

    @staticmethod
    def _sums(cells: list[tuple[bytes, int]], at: list[np.ndarray], size: int) -> np.ndarray:
        n = np.zeros(size, np.int64)
        for (cell, m), where in zip(cells, at, strict=True):
            if m:
                n[where] += _numbers(_planes(cell, m)).astype(np.int64)
        return n

    @classmethod
    def _united(cls, keys: list[np.ndarray], cells: list[tuple[bytes, int]] | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
        every = np.sort(np.concatenate(keys))
        every = every[_heads(every)]
        at = [np.searchsorted(every, k) for k in keys]
        return every, at, cls._sums(cells, at, len(every)) if cells else None

    def build(self) -> None:
        """Restaurants of all context lengths, the longest first, and the parent of each row."""
        last, context, dish, c = self.last, self.gram >> np.uint64(8), self.gram & np.uint64(255), self.n
        context >>= np.uint64(8 * (WIDEST - self.order))
        self.levels, self.up = [], []
        r = np.zeros(len(last), np.int64)
        r[_heads(last, context)] = 1
        r = np.cumsum(r) - 1
        for n in range(self.order, 3, -1):
            self.levels.append(Level(r, c, numbered=True))
            if n == 4:
                break
            context = context >> np.uint64(8)
            short = np.zeros(len(last), np.uint64)
            short[_heads(last, context)] = 1
            short = np.cumsum(short, dtype=np.uint64) - np.uint64(1)
            row = np.sort((short << np.uint64(8) | dish) << np.uint64(28) | np.arange(len(last), dtype=np.uint64))
            pair, row = row >> np.uint64(28), (row & np.uint64((1 << 28) - 1)).astype(np.int64)
            at = _heads(pair)
            up = np.empty(len(row), np.int64)
            up[row] = np.repeat(np.arange(len(at)), np.diff(at, append=len(row)))
            self.up.append(up)
            c = np.bincount(up, np.minimum(c, 1), len(at)).astype(np.int64)
            r, row = (pair[at] >> np.uint64(8)).astype(np.int64), row[at]
            last, context, dish = last[row], context[row], dish[row]
        self.seats = [level.c for level in self.levels]
        # their parents are trigrams: the two bytes before, and the dish
        self.three = ((context >> np.uint64(8)) << np.uint64(16) | last.astype(np.uint64) << np.uint64(8) | dish).astype(np.int64)

    def sample(self, base: dict[str, np.ndarray], value: str, sweeps: int, rng: np.random.Generator) -> np.ndarray:
        """Probabilities of all n-grams; the tables of the shortest contexts are left in the last level."""
        for level, c in zip(self.levels, self.seats, strict=True):
            level.seat(c)
        return _sampled(self.levels, self.up, base[value][np.searchsorted(base["key"], self.three)], sweeps, rng)

    def tables(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams and how many tables their children have here."""
        key, at = np.unique(self.three, return_inverse=True)
        return key, np.bincount(at, t, len(key)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "base"} | ({"base": batch.column("base")[i].values} if "base" in batch.schema.names else {})


def _bases(row: dict) -> dict[str, np.ndarray]:
    base = {f.name: row["base"].field(i).to_numpy() for i, f in enumerate(row["base"].type)}
    order = np.argsort(base["key"])
    return {name: x[order] for name, x in base.items()}


def _handed_up(asks: DataFrame, order: int, sweeps: int, seed: int, sample: int | None) -> DataFrame:
    """Trigrams of each bucket with their children's tables, at first (no sample) one per dish; then also the sums over its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Bucket(row["asks"], order)
            b.build()
            if sample is None or not len(b.gram):
                t = np.minimum(b.seats[-1], 1)
            else:
                b.sample(_bases(row), f"p{sample}", sweeps, np.random.default_rng([seed, sample, row["bucket"] + 1]))
                t = b.levels[-1].t
            key, n = b.tables(t)
            key, n = np.append(key, [-1, -2]), np.append(n, [b.word_n.sum(), (b.word_n > 0).sum()])
            yield pa.record_batch({"bucket": pa.array(np.full(len(key), row["bucket"], np.int32)), "key": pa.array(key), "n": pa.array(n.astype(np.int64))})

    return stored(asks.mapInArrow(run, "bucket int, key bigint, n bigint"), "hpylm-tables")


def _upper(tables: DataFrame, sweeps: int, seed: int, sample: int) -> DataFrame:
    """Probabilities of trigrams, from the tables of their children."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        k, rng = table.column("key").to_numpy().astype(np.uint64), np.random.default_rng([seed, sample, 0])
        chain = [(k, table.column("n").to_numpy())]
        up = []
        for keep in (2, 1):
            k2, at = np.unique(chain[-1][0] & np.uint64((1 << 8 * keep) - 1), return_inverse=True)
            up.append(at)
            chain.append((k2, np.bincount(at, np.minimum(chain[-1][1], 1), len(k2))))
        levels = [Level(kk >> np.uint64(8), c) for kk, c in chain]
        p = _sampled(levels, up, np.full(len(chain[-1][0]), 1 / 256), sweeps, rng)
        return pa.table({"key": table.column("key"), f"p{sample}": pa.array(p)})

    tables = tables.where("key >= 0").groupBy("key").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    return stored(tables.groupBy("all").applyInArrow(run, f"key bigint, p{sample} double"), "hpylm-base")


def fit(asks: DataFrame, order: int = ORDER, samples: int = SAMPLES, sweeps: int = SWEEPS, seed: int = 7) -> tuple[DataFrame, int, int]:
    """(pack, bucket, n_grams, values, n_words, words): log10 of the averaged probability of the last byte of each n-gram asked for, negative
    and times STEP, and the training counts of the words; then how many tokens and words were trained on."""
    tables = first = _handed_up(asks, order, sweeps, seed, None)
    n_train, n_types = first.agg(*[F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0)) for k in (-1, -2)]).first()
    needed = first.where("key >= 0").select("bucket", "key")
    few = needed.count() <= SENT_BASES
    for sample in range(samples):
        needed = needed.join(_upper(tables, sweeps, seed, sample), "key")
        # at most a row per context of three bytes and dish; while there are few, the asked n-grams need no shuffle
        base = F.sort_array(F.collect_list(F.struct("key", *[f"p{s}" for s in range(sample + 1)]))).alias("base")
        bases = stored(needed.groupBy("bucket").agg(base), "hpylm-bases")
        rows = asks.join(F.broadcast(bases) if few else bases, "bucket", "left")
        if sample < samples - 1:
            tables = _handed_up(rows, order, sweeps, seed, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Bucket(row["asks"], order)
            b.build()
            if len(b.gram):
                base, p = _bases(row), np.zeros(len(b.gram))
                for s in range(samples):
                    p += b.sample(base, f"p{s}", sweeps, np.random.default_rng([seed, s, row["bucket"] + 1]))
                value = np.rint(-STEP * np.log10(p / samples)).astype(np.int64)
            else:
                value = np.zeros(0, np.int64)
            for x in range(0, len(b.asks), SENT_ROWS):
                some = range(x, min(x + SENT_ROWS, len(b.asks)))
                yield pa.record_batch({
                    "pack": pa.array([b.asks[i]["pack"] for i in some], pa.int64()), "bucket": pa.array([row["bucket"]] * len(some), pa.int32()),
                    "n_grams": pa.array([len(b.at[i]) for i in some], pa.int32()), "values": pa.array([_pressed(_narrow(value[b.at[i]])) for i in some], pa.binary()),
                    "n_words": pa.array([len(b.word_at[i]) for i in some], pa.int32()), "words": pa.array([_pressed(_narrow(b.word_n[b.word_at[i]])) for i in some], pa.binary()),
                })

    return rows.mapInArrow(run, "pack bigint, bucket int, n_grams int, values binary, n_words int, words binary"), n_train, n_types


def _sampled(levels: list[Level], up: list[np.ndarray], root: np.ndarray, sweeps: int, rng: np.random.Generator) -> np.ndarray:
    """Sweeps over levels, longest contexts first, each handing its tables up; the mean prediction of the later half."""
    mean, taken = np.zeros(len(levels[0].c)), 0
    for s in range(sweeps):
        bases = [root]  # probabilities by the parents, from the root down
        for level, at in zip(reversed(levels[1:]), reversed(up), strict=True):
            bases.append(level.predict(bases[-1])[at])
        for i, level in enumerate(levels):
            level.sweep(bases[len(levels) - 1 - i], rng)
            if i < len(up):
                parent = levels[i + 1]
                parent.seat_more(np.bincount(up[i], level.t, len(parent.c)))
        if 2 * s >= sweeps - 1:
            p = root
            for i in range(len(levels) - 1, -1, -1):
                p = levels[i].predict(p)
                p = p[up[i - 1]] if i else p
            mean, taken = mean + p, taken + 1
    return mean / taken


def score(docs: DataFrame, order: int = ORDER, pack_bytes: int = PACK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    if not 4 <= order <= WIDEST:
        raise ValueError("order must be 4 to 9 bytes")
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    # fewer, fuller packs ask for fewer n-grams; small inputs still keep every core busy
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // pack_bytes)))
    found = stored(packs(docs, pack_bytes), "hpylm-packs")
    buckets = max(1, -(-total // BUCKET_BYTES))
    answers, n_train, n_types = fit(stored(asked(found, order, buckets), "hpylm-asked"), order)

    def run(key: tuple, pack: pa.Table, answers: pa.Table) -> pa.Table:
        ids, bodies = pack.column("ids")[0].as_py(), _texts(pack.column("body")[0].as_py())
        keys, tokens = word_keys(bodies)
        words = np.unique(keys)
        cuts, counts = _word_cuts(words, buckets), np.zeros(len(words), np.float32)
        values: dict[int, np.ndarray] = {}
        for i, bucket in enumerate(answers.column("bucket").to_pylist()):
            if m := answers.column("n_words")[i].as_py():
                counts[cuts[bucket] : cuts[bucket + 1]] = _numbers(_planes(answers.column("words")[i].as_py(), m))
            if m := answers.column("n_grams")[i].as_py():
                values[bucket] = _numbers(_planes(answers.column("values")[i].as_py(), m))
        by_word = Lookup((words, np.zeros(len(words), np.uint16)), counts)
        stream, begin, length = _stream(bodies, order)
        of = np.zeros(len(stream), max((v.dtype for v in values.values()), key=lambda t: t.itemsize, default=np.uint8))
        used = dict.fromkeys(values, 0)
        for v, at, grams in _by_context(stream, begin, length, order):
            every = np.sort(grams)
            every = every[_heads(every)]
            value = np.empty(len(every), of.dtype)
            for bucket, a, b in _buckets_of(v, every, buckets):
                value[a:b] = values[bucket][used[bucket] : used[bucket] + b - a]
                used[bucket] += b - a
            of[at] = value[np.searchsorted(every, grams)]
        total = np.add.reduceat(of, begin, dtype=np.int64) / -STEP
        c = by_word[keys, np.zeros(len(keys), np.uint16)]
        at = np.cumsum(tokens) - tokens
        n_known = np.add.reduceat(c > 0, at, dtype=np.int64)
        base = np.add.reduceat(np.log10((c + 0.1) / (n_train + 0.1 * (n_types + 1))), at)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids]), "n_tokens": pa.array(tokens),
            "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(len(ids), n_train)), "base_score": pa.array(base), "score": pa.array(total),
        })

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return found.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, schema)
