"""Hashes of the k-grams of many texts at once, over code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the texts' offsets in them; null is an empty text."""
    flat = np.frombuffer("".join(x or "" for x in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0)).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def gram_hashes(points: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """The hash of each k consecutive code points, by doubling: the hash of 2n is made of two of n. ``base`` selects an independent hash."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(n, np.uint64), 0
    with np.errstate(over="ignore"):
        power = _BASE * np.uint64(2 * base + 1)
        part, span = mixed(points.astype(np.uint64) + power), 1
        while True:
            if k & span:
                out = out * power + part[done : done + n]
                done += span
            if done == k:
                return mixed(out)
            part = part[:-span] * power + part[span:]
            power, span = power * power, span * 2


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values."""
    span, part = 1, values
    while span * 2 <= width:
        part, span = best(part[:-span], part[span:]), span * 2
    rest = width - span
    return best(part[: len(part) - rest], part[rest:]) if rest else part
