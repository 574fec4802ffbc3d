"""SetSketch registers of 64-bit shingles, their bands and the joint likelihood of two sketches.

A register keeps the smallest of independent exponential values of a set's elements,
truncated to whole powers of `base`. Registers of a union are the larger ones of both
sets' registers, so sketches merge; two sets agree in a register about as often as their
Jaccard similarity says.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class SetSketch:
    """`bands` x `rows` registers of one byte each; `rate` places the smallest sets above 0."""

    bands: int = 24
    rows: int = 4
    base: float = 1.1
    rate: float = 32.0
    seed: int = 11

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def _factors(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.Generator(np.random.PCG64(self.seed))
        return (
            random.integers(0, 1 << 32, self.size, np.uint32) | np.uint32(1),
            random.integers(0, 1 << 32, self.size, np.uint32),
        )

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of registers a set; an empty set has zeros."""
        factor, flip = self._factors()
        least = np.full((len(sets), self.size), np.uint32(0xFFFFFFFF))
        for row, values in enumerate(sets):
            for low in range(0, len(values), 4096):
                x = (values[low : low + 4096] >> np.uint64(32)).astype(np.uint32)[:, None] ^ flip
                x *= factor
                x ^= x >> np.uint32(15)
                np.minimum(least[row], x.min(axis=0), out=least[row])
        waits = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / self.rate
        out = np.clip(np.floor(1 - np.log(waits) / np.log(self.base)), 0, 255).astype(np.uint8)
        out[[not len(s) for s in sets]] = 0
        return out

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(a, b)

    def similarity(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 101) -> np.ndarray:
        """Most likely Jaccard similarity of pairs of sketches of sets of known sizes.

        With shares s = n_a / (n_a + n_b) and t = 1 - s, a register of a is the larger one
        with probability q(s - t J), of b with q(t - s J), and else both are equal, where
        q(x) = -log_base(1 - x (base - 1) / base).
        """
        more, less = (a > b).sum(axis=-1)[:, None], (a < b).sum(axis=-1)[:, None]
        same = a.shape[-1] - more - less
        s = (n_a / (n_a + n_b))[:, None]
        most = np.minimum(s / (1 - s), (1 - s) / s)
        guess = most * np.linspace(0, 1, steps)

        def chance(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.maximum(x, 0) * (self.base - 1) / self.base) / np.log(self.base)

        up, down = chance(s - (1 - s) * guess), chance((1 - s) - s * guess)
        tiny = 1e-12
        likely = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
        return np.take_along_axis(guess, likely.argmax(axis=1)[:, None], axis=1)[:, 0]

    def possible(self, a: np.ndarray, rows: np.ndarray, n_a: float, n: np.ndarray, likely: float) -> np.ndarray:
        """Places of the rows whose sets may reach the similarity `likely` with one set.

        First the sizes must allow it, then the share of equal registers (which is never
        below the similarity but for chance), then the joint likelihood.
        """
        at = np.flatnonzero(np.minimum(n, n_a) >= likely * np.maximum(n, n_a))
        at = at[(rows[at] == a).mean(axis=1) >= likely - 0.05]
        if not len(at):
            return at
        again = np.broadcast_to(a, (len(at), self.size))
        return at[self.similarity(again, rows[at], np.full(len(at), n_a), n[at]) >= likely]
