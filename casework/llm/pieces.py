"""SentencePiece encoding and decoding by a max-plus scan.

The model merges pairs of pieces, best score first. Its result is the one segmentation in which every two neighbours are a
pair that merging alone would leave as it is; so it is the best path through all pieces of the text if such a joint is worth 0
and any other one minus infinity, which is how it is searched here. A text longer than ``chunk`` characters is split, anywhere.
The state at a border is the piece that ends at it or lies across it, so a chunk is a matrix of values from each such piece at
its begin to each at its end. Matrices combine by max-plus products, which are associative: blocks of chunks are multiplied in
parallel, level by level, the states are read off from the top down, and every chunk is then traced back on its own
between its two states. A shorter text is a single chunk.

No piece has a space mark behind another character, so every path passes in front of a word: between such places words are
looked up, not searched, and matrices need a search at the two rims only.

Defined cases: null and empty texts have no pieces; equal texts have equal pieces; a character without a piece becomes its
UTF-8 byte pieces; decoding restores a text but for the space mark U+2581, which stands for a space; other columns pass through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import free_names, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
BLOCK = 256  # matrices multiplied in one group
MARK = "\u2581"
NONE = -(1 << 30)  # minus infinity
MOST_WORDS = 250_000
MOST_IDS = 2_000_000  # of all words that are known
MOST_JOINTS = 300_000
ROWS = 50  # texts or chunks whose words are held at a time
GATHER = 1 << 18  # runs copied in one call


#: Every path passes at line ends, in front of a run of marks, and where letters and other characters meet.
WORD = re.compile(rf"\n|{MARK}*[^\W\d_²]+|{MARK}*(?:(?![^\W\d_²])[^\n{MARK}])+|{MARK}+")


@dataclass
class Model:
    """Pieces by text, as plain values that travel to tasks."""

    score: dict[str, tuple[int, int]]  # piece -> id, score
    byte: list[int]  # id of each byte's piece
    surface: list[bytes]  # what each id decodes to
    longest: int

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score, byte, surface = {}, [0] * 256, []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
                surface.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                score[piece] = (i, round(sp.get_score(i)))
                surface.append(piece.replace(MARK, " ").encode())
        if any(len(WORD.findall(p)) > 1 for p in score):
            raise ValueError("a piece holds parts of two words: this model's texts cannot be cut there")
        return cls(score, byte, surface, max(map(len, score)))

    @cached_property
    def surfaces(self) -> tuple[np.ndarray, np.ndarray]:
        """What all ids decode to, end to end, and where each begins."""
        return np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum([0, *map(len, self.surface)])

    def decode(self, rows: pa.ListArray) -> list[str | None]:
        """The text of each list of ids."""
        ids = rows.flatten().to_numpy(zero_copy_only=False)
        body, ends = gathered(*self.surfaces, ids)
        counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        borders = ends[np.cumsum([0, *counts])].tolist()
        texts = [body[a:b].tobytes().decode("utf-8", "replace").removeprefix(" ") for a, b in zip(borders, borders[1:])]  # noqa: B905
        return [t if known else None for t, known in zip(texts, rows.is_valid().to_pylist(), strict=True)]


def gathered(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (run k lies from starts[k] to starts[k + 1]) side by side, and where each begins, the end included."""
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(starts[which + 1] - starts[which], out=ends[1:])
    out = np.empty(ends[-1], flat.dtype)
    for a in range(0, len(which), GATHER):
        some, to = which[a : a + GATHER], ends[a : a + GATHER + 1]
        out[to[0] : to[-1]] = flat[np.arange(to[0], to[-1]) + np.repeat(starts[some] - to[:-1], np.diff(to))]
    return out, ends


class Words(dict):
    """Numbers of words in the order they are met, and their ids end to end."""

    def __init__(self, ids_of: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.ids_of, self.ids, self.starts, self.uses = ids_of, array("i"), array("q", [0]), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self.ids.extend(self.ids_of(word))
        self.starts.append(len(self.ids))
        number = self[word] = len(self)
        return number

    def use(self, which: np.ndarray) -> None:
        """Counts uses; when there are too many words, the half (or quarter of their ids) that was met most often stays."""
        uses = np.bincount(which, minlength=len(self))
        uses[: len(self.uses)] += self.uses
        self.uses = uses

    def trim(self) -> None:
        if len(self) < MOST_WORDS and len(self.ids) < MOST_IDS:
            return
        self.use(np.empty(0, np.int64))
        order = np.argsort(-self.uses, kind="stable")[: MOST_WORDS // 2]
        order = order[np.cumsum(np.diff(np.array(self.starts))[order]) <= MOST_IDS // 4]
        texts = list(self)
        ids, ends = gathered(np.array(self.ids, np.int32), np.array(self.starts), order)
        self.clear()
        self.update((texts[k], i) for i, k in enumerate(order.tolist()))
        self.ids, self.starts, self.uses = array("i", ids.tolist()), array("q", ends.tolist()), self.uses[order] // 2


def normal(text: str | None) -> str:
    return "" if not text else MARK + text.replace(" ", MARK)


Span = tuple[int, int]  # begin and end of a piece
START: Span = (0, 0)


@dataclass
class Encoder:
    model: Model
    joints: dict[tuple[str, str], bool] = field(default_factory=dict)

    @cached_property
    def whole(self) -> dict[str, bool]:
        """Every begin of a piece, and whether it is a piece."""
        return {p[:i]: p[:i] in self.model.score for p in self.model.score for i in range(1, len(p) + 1)}

    def merge(self, text: str) -> list[str]:
        """A few characters by the model's own rule."""
        parts, score = list(text), self.model.score
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s[1] > best):
                    best, at = s[1], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joint(self, left: str, right: str) -> bool:
        """Whether merging leaves the border between two pieces (or before the first, left empty) and the right one whole."""
        key = (left, right)
        ok = self.joints.get(key)
        if ok is None:
            if len(self.joints) >= MOST_JOINTS:
                self.joints.clear()
            ok = self.joints[key] = self.merge(left + right) == ([left, right] if left else [right])
        return ok

    def spans(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that begin at a place; a character that no piece begins with is one by itself."""
        whole, ends = self.whole, [at + 1]
        for end in range(at + 1, len(text) + 1):
            known = whole.get(text[at:end])
            if known is None:
                break
            if known and end > at + 1:
                ends.append(end)
        return ends

    def search(self, text: str, entry: Span, stop: int) -> dict[Span, Span]:
        """The pieces on a path from ``entry`` that begin before ``stop``, each with the one before it."""
        back: dict[Span, Span] = {}
        ending: dict[int, list[tuple[Span, str]]] = {entry[1]: [(entry, text[entry[0] : entry[1]])]}
        joints = self.joints
        for at in range(entry[1], stop):
            before = ending.pop(at, None)
            if before is None:
                continue
            for end in self.spans(text, at):
                piece = text[at:end]
                for span, left in before:
                    ok = joints.get((left, piece))
                    if self.joint(left, piece) if ok is None else ok:
                        back[(at, end)] = span
                        ending.setdefault(end, []).append(((at, end), piece))
                        break
        return back

    def trace(self, text: str, back: dict[Span, Span], entry: Span, last: Span) -> list[int]:
        out: list[int] = []
        while last != entry:
            piece = text[last[0] : last[1]]
            known = self.model.score.get(piece)
            out += [known[0]] if known else [self.model.byte[b] for b in reversed(piece.encode())]
            last = back[last]
        return out[::-1]

    def path(self, text: str) -> list[int]:
        """Ids on the best path through one word. Joints are worth 0 or minus infinity, so the first path found that has a value is the
        best: pieces are tried longest first, and a piece from which no path goes on is not tried again."""
        size, dead, joints, score = len(text), set(), self.joints, self.model.score
        ends: list[int] = []  # of the pieces so far
        begin, untried = 0, self.spans(text, 0)
        waiting: list[list[int]] = []
        left = ""
        while begin < size:
            while untried:
                end = untried.pop()
                piece = text[begin:end]
                ok = joints.get((left, piece))
                if (self.joint(left, piece) if ok is None else ok) and (begin, end) not in dead:
                    waiting.append(untried)
                    ends.append(end)
                    left, begin, untried = piece, end, self.spans(text, end) if end < size else []
                    break
            else:
                end = ends.pop()
                begin = ends[-1] if ends else 0
                dead.add((begin, end))
                left = text[ends[-2] if len(ends) > 1 else 0 : begin]
                untried = waiting.pop()
        out: list[int] = []
        for a, e in zip([0, *ends], ends):  # noqa: B905
            known = score.get(text[a:e])
            out += [known[0]] if known else [self.model.byte[b] for b in text[a:e].encode()]
        return out

    @cached_property
    def words(self) -> Words:
        return Words(self.path)

    def word(self, w: str) -> list[int]:
        k, known = self.words[w], self.words
        return known.ids[known.starts[k] : known.starts[k + 1]].tolist()

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].as_py()

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text: its words become numbers, and the words' ids are copied side by side."""
        self.words.trim()
        which, counts = array("q"), [0]
        for t in texts:
            which.extend(map(self.words.__getitem__, WORD.findall(normal(t))))
            counts.append(len(which))
        numbers = np.array(which, np.int64)
        self.words.use(numbers)
        ids, ends = gathered(np.array(self.words.ids, np.int32), np.array(self.words.starts), numbers)
        return pa.ListArray.from_arrays(pa.array(ends[counts].astype(np.int32)), pa.array(ids))

    def borders(self, text: str, border: int, last: bool = False) -> list[Span]:
        """All pieces of the text that could be the state at a border, in a fixed order; at the end none reaches further."""
        if border == 0:
            return [START]
        some = [(a, e) for a in range(max(0, border - self.model.longest), border) for e in self.spans(text, a) if e >= border]
        return [x for x in some if x[1] == border] if last else some

    def starts(self, text: str, begin: int, size: int) -> list[int]:
        """Word begins of a chunk at which any state has ended and from which the whole rim is seen."""
        return [m.start() for m in WORD.finditer(text) if begin + self.model.longest <= m.start() < begin + size]

    def transfer(self, text: str, begin: int, size: int, last: bool) -> np.ndarray:
        """Values from each piece at the begin of a chunk to each at its end. ``text`` has the chunk at ``begin`` and what lies near."""
        rows, columns = self.borders(text, begin), self.borders(text, begin + size, last)
        cuts, stop = self.starts(text, begin, size), begin + size
        out = np.full((len(rows), len(columns)), NONE, np.int64)
        if not cuts:
            for i, entry in enumerate(rows):
                back = {entry: entry} | self.search(text, entry, stop)
                out[i] = [0 if c in back else NONE for c in columns]
            return out
        back = self.search(text, (cuts[-1], cuts[-1]), stop)
        tail = np.array([0 if c in back else NONE for c in columns], np.int64)
        for i, entry in enumerate(rows):
            if any(end == cuts[0] for _, end in self.search(text, entry, cuts[0])):
                out[i] = tail
        return out

    def between(self, text: str, begin: int, size: int, last: bool, state: int, to: int) -> list[int]:
        """Ids of the pieces that begin in a chunk, from one state to another."""
        entry, end = self.borders(text, begin)[state], self.borders(text, begin + size, last)[to]
        cuts, stop = self.starts(text, begin, size), begin + size
        if end == entry:
            return []
        if not cuts:
            return self.trace(text, self.search(text, entry, stop), entry, end)
        back = self.search(text, entry, cuts[0])
        out = self.trace(text, back, entry, next(x for x in back if x[1] == cuts[0]))
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            out += self.word(text[a:b])
        final = (cuts[-1], cuts[-1])
        return out + self.trace(text, self.search(text, final, stop), final, end)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str, model: Model) -> Encoder:
    """One for each model and worker, which keeps the words it has met for the worker's next task."""
    return _encoders.setdefault(path, Encoder(model))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None]).max(1), NONE)


def states(matrices: list[np.ndarray], begin: int, end: int | None) -> list[int]:
    """Best states at the borders of consecutive chunks, from one state to another (the best one if None), both included."""
    v = np.full((1, matrices[0].shape[0]), NONE, np.int64)
    v[0, begin] = 0
    vectors = [v]
    for m in matrices:
        vectors.append(product(vectors[-1], m))
    out = [int(vectors[-1][0].argmax()) if end is None else end]
    for m, v in zip(reversed(matrices), reversed(vectors[:-1]), strict=True):
        out.append(int((v[0] + m[:, out[-1]]).argmax()))
    return out[::-1]


def _lists(each: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*each, np.empty(0, np.int32)])))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _giants(docs: DataFrame, text: str, shared, model: str, chunk: int) -> DataFrame:  # noqa: ANN001
    """key (MD5 of the text) and ids of texts longer than a chunk."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 2 * shared.value.longest
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = normal(t)
                begins = list(range(0, len(t), chunk))
                yield pa.record_batch({
                    "key": pa.array([key] * len(begins)), "at": pa.array(range(len(begins)), pa.int64()),
                    "last": pa.array([b + chunk >= len(t) for b in begins]), "begin": pa.array([min(b, n) for b in begins], pa.int64()),
                    "size": pa.array([min(chunk, len(t) - b) for b in begins], pa.int64()),
                    "body": pa.array([t[max(0, b - n) : b + chunk + n] for b in begins], pa.string()),
                })

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model, shared.value)
        for batch in _few(batches):
            each = [encoder.transfer(r["body"], r["begin"], r["size"], r["last"]) for r in batch.to_pylist()]
            yield pa.record_batch({
                "key": batch.column("key"), "at": batch.column("at"), "rows": pa.array([len(m) for m in each], pa.int32()), "matrix": pa.array([m.tobytes() for m in each], pa.binary()),
            })

    def matrices(rows: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        rows = rows.sort_by("at")
        each = zip(rows.column("rows").to_pylist(), rows.column("matrix").to_pylist(), strict=True)
        return rows.column("at").to_pylist(), [np.frombuffer(m, np.int64).reshape(n, -1) for n, m in each]

    def multiply(key: tuple, rows: pa.Table) -> pa.Table:
        _, ms = matrices(rows)
        while len(ms) > 1:  # a balanced tree
            ms = [product(*ms[i : i + 2]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
        return pa.table({
            "key": [key[0].as_py()], "at": pa.array([key[1].as_py()], pa.int64()), "rows": pa.array([len(ms[0])], pa.int32()), "matrix": pa.array([ms[0].tobytes()], pa.binary()),
        })

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ms = matrices(pa.Table.from_batches([batch]))
            ends = [states([m], 0, None)[1] for m in ms]
            yield pa.record_batch({"key": batch.column("key"), "at": batch.column("at"), "state": pa.array([0] * len(ms), pa.int32()), "to": pa.array(ends, pa.int32())})

    def descend(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        at, ms = matrices(rows)
        s = states(ms, above.column("state")[0].as_py(), above.column("to")[0].as_py())
        return pa.table({"key": pa.array([key[0].as_py()] * len(at)), "at": pa.array(at, pa.int64()), "state": pa.array(s[:-1], pa.int32()), "to": pa.array(s[1:], pa.int32())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model, shared.value)
        for batch in _few(batches):
            encoder.words.trim()
            each = [np.array(encoder.between(r["body"], r["begin"], r["size"], r["last"], r["state"], r["to"]), np.int32) for r in batch.to_pylist()]
            yield pa.record_batch({"key": batch.column("key"), "at": batch.column("at"), "ids": _lists(each)})

    rows = docs.select(F.md5(F.col(text).cast("binary")).alias("key"), F.col(text).alias("body"))
    chunks = rows.mapInArrow(split, "key string, at bigint, last boolean, begin bigint, size bigint, body string")
    chunks = stored(chunks.dropDuplicates(["key", "at"]), "piece-chunks")
    matrix_schema = "key string, at bigint, rows int, matrix binary"
    levels = [stored(chunks.mapInArrow(transfer, matrix_schema), "piece-matrices")]
    block = F.floor(F.col("at") / BLOCK).cast("bigint").alias("block")
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        levels.append(stored(levels[-1].groupBy("key", block).applyInArrow(multiply, matrix_schema), "piece-matrices"))
    known = levels.pop().mapInArrow(top, "key string, at bigint, state int, to int")
    while levels:
        above = known.withColumnRenamed("at", "block").groupBy("key", "block")
        known = levels.pop().groupBy("key", block).cogroup(above).applyInArrow(descend, "key string, at bigint, state int, to int")
        known = stored(known, "piece-states")
    parts = chunks.join(known, ["key", "at"]).mapInArrow(finish, "key string, at bigint, ids array<int>")
    # one text's pieces, as large as the text's own cell
    gathered = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return gathered.select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``docs`` and the piece ids of each row's text; a column that has the name already is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(Model.load(model))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model, shared.value)
        for batch in _few(batches):
            ids = encoder.encode_all(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.record_batch([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    giant = F.coalesce(F.length(text) > chunk, F.lit(False))
    body, key, found_ids = free_names(docs, "body", "key", "ids")
    short = docs.where(~giant).withColumn(body, F.col(text)).mapInArrow(run, f"{schema}, `{out}` array<int>")
    giants = docs.where(giant)
    if giants.isEmpty():
        return short
    found = stored(_giants(giants, text, shared, model, chunk), "piece-ids").select(F.col("key").alias(key), F.col("ids").alias(found_ids))
    long = giants.withColumn(key, F.md5(F.col(text).cast("binary"))).join(found, key)
    long = long.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(found_ids).alias(out))
    return short.union(long)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` and the text of each row's piece ids; null ids give null; a column that has the name already is replaced."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(Model.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in _few(batches):
            yield pa.record_batch([*batch.columns, pa.array(m.decode(batch.column(ids)), pa.string())], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` string")
