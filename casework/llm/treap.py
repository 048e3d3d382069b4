"""K2-treap: a grid of few non-zero integers as a compressed quadtree whose cells know the largest value below them.

The grid is padded to a square of 2 ** height. A cell that holds a value is divided into quadrants, level by level, down to
single grid points. Per cell there are four bits (which quadrants hold something) and its maximum, kept as the difference from
the cell above; cells of a level follow each other in Z-order, so a child's place is found by counting bits.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import zstandard

#: How many bits of a four-bit mask are set, in all and below bit q.
ONES = np.array([m.bit_count() for m in range(16)], np.uint8)
ONES_BELOW = np.array([[(m & ((1 << q) - 1)).bit_count() for q in range(4)] for m in range(16)], np.uint8)


def spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers moved to the even places of 64-bit ones."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Cells of all levels, the root first: ``masks``, ``maxima`` and ``first``, the place of each cell's first child."""

    def __init__(self, height: int, masks: np.ndarray, maxima: np.ndarray) -> None:
        """Arrays without the empty cell at the end; it is added here."""
        self.height, self.masks, self.maxima = height, np.append(masks, np.uint8(0)), np.append(maxima, maxima.dtype.type(0))

    @cached_property
    def first(self) -> np.ndarray:
        """Only searches need it; cells are millions, so places take four bytes where they can."""
        many = ONES[self.masks]
        out = np.cumsum(many, dtype=np.int32 if len(many) < 1 << 31 else np.int64)
        out -= many
        out += 1
        return out

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> Treap:
        """From distinct grid points with positive values; at least one."""
        height = max(int(max(shape) - 1).bit_length(), 1)
        codes = (spread(rows) << np.uint64(1)) | spread(columns)
        order = np.argsort(codes)
        codes, maxima = codes[order], values[order].astype(np.uint32 if values.max() < 1 << 32 else np.int64)
        levels = [(np.zeros(len(codes), np.uint8), maxima)]
        for _ in range(height):
            above = codes >> np.uint64(2)
            begins = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            bits = np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8)
            maxima = np.maximum.reduceat(maxima, begins)
            levels.append((np.bitwise_or.reduceat(bits, begins), maxima))
            codes = above[begins]
        levels.reverse()
        return cls(height, np.concatenate([m for m, _ in levels]), np.concatenate([v for _, v in levels]))

    def child(self, cells: np.ndarray, quadrants: np.ndarray) -> np.ndarray:
        """Places of the given quadrants (2 * lower half + right half); -1 where a quadrant is empty or the cell is -1.

        Place -1 is also the last place of the arrays, where an empty cell stands.
        """
        masks = self.masks[cells]
        return np.where((masks >> quadrants) & 1, self.first[cells] + ONES_BELOW[masks, quadrants], -1)

    def packed(self) -> bytes:
        """Masks as nibbles, maxima as differences from the cell above."""
        own, maxima = self.masks[:-1], self.maxima[:-1]
        drops = np.empty(len(own), "<u4")
        drops[0] = maxima[0]
        begin, end = 0, 1
        while end < len(own):  # by levels, so that no place of a parent is written down
            many = ONES[own[begin:end]]
            size = int(many.sum(dtype=np.int64))
            drops[end : end + size] = np.repeat(maxima[begin:end], many) - maxima[end : end + size]
            begin, end = end, end + size
        masks = np.append(own, np.zeros(len(own) % 2, np.uint8))
        planes = drops.view(np.uint8).reshape(-1, 4).T  # equal places of all numbers together
        body = struct.pack("<II", self.height, len(own)) + (masks[::2] | masks[1::2] << np.uint8(4)).tobytes() + planes.tobytes()
        return zstandard.compress(body, 3)

    @classmethod
    def unpacked(cls, data: bytes) -> Treap:
        body = zstandard.decompress(data)
        height, n = struct.unpack_from("<II", body)
        nibbles = np.frombuffer(body, np.uint8, (n + 1) // 2, 8)
        masks = np.empty(2 * len(nibbles), np.uint8)
        masks[::2], masks[1::2] = nibbles & 15, nibbles >> 4
        planes = np.frombuffer(body, np.uint8, 4 * n, 8 + len(nibbles)).reshape(4, n)
        maxima = np.ascontiguousarray(planes.T).view("<u4").ravel()
        masks = masks[:n]
        begin, end = 0, 1
        while end < n:  # a level's maxima follow from the level above
            many = ONES[masks[begin:end]]
            size = int(many.sum(dtype=np.int64))
            maxima[end : end + size] = np.repeat(maxima[begin:end], many) - maxima[end : end + size]
            begin, end = end, end + size
        return cls(height, masks, maxima)

    def best_columns(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Columns with the ``k`` largest weighted sums over ``rows``, and the sums: largest first, equal ones by column.

        A range of columns is bounded by the weighted maxima of its cells in each row's path. The best ranges are halved first, many
        at a time, until no range left can reach the k-th sum. Sums below ``least`` are not looked for.
        """
        exact = int(self.maxima[0]) * int(weights.sum()) < 1 << 53  # then sums are whole numbers in doubles too, and faster
        kind = np.float64 if exact else np.int64
        maxima, weights = self.maxima, weights.astype(kind)
        sum_of = lambda cells: maxima[cells].astype(kind) @ weights
        lower = [2 * ((rows >> (self.height - 1 - d)) & 1) for d in range(self.height)]
        lower = np.stack(lower).astype(np.uint8)
        found, sums = np.empty(0, np.int64), np.empty(0, kind)
        cells = np.zeros((1, len(rows)), np.int64)
        at, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bounds = sum_of(cells)
        while len(bounds):
            keep = bounds >= least
            if not keep.all():
                bounds, at, depth, cells = bounds[keep], at[keep], depth[keep], cells[keep]
                if not len(bounds):
                    break
            if len(bounds) > batch:
                order = np.argpartition(-bounds, batch)
                now, later = order[:batch], order[batch:]
            else:
                now, later = np.arange(len(bounds)), np.empty(0, np.int64)
            left = lower[depth[now]]
            new_cells = np.concatenate([self.child(cells[now], left), self.child(cells[now], left + np.uint8(1))])
            new_bounds = sum_of(new_cells)
            new_at = np.concatenate([2 * at[now], 2 * at[now] + 1])
            new_depth = np.tile(depth[now] + 1, 2)
            possible = new_bounds >= least
            done = possible & (new_depth == self.height)
            if done.any():
                found, sums = np.concatenate([found, new_at[done]]), np.concatenate([sums, new_bounds[done]])
                order = np.lexsort((found, -sums))[:k]
                found, sums = found[order], sums[order]
                if len(sums) == k:
                    least = max(least, int(sums[-1]))
            more = possible & ~done
            bounds, at, depth, cells = (
                np.concatenate([old[later], new[more]]) for old, new in ((bounds, new_bounds), (at, new_at), (depth, new_depth), (cells, new_cells))
            )
        return found, sums.astype(np.int64)
