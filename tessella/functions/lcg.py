"""Reproducible draws as SQL text that any engine with 64-bit integers evaluates alike.

Step n of s' = (1103515245 s + 12345) mod 2**31 has a closed form, so a draw needs no state.
"""

from __future__ import annotations

import numpy as np

_A, _C, M = 1103515245, 12345, 1 << 31


def _step(n: int) -> tuple[int, int]:
    a, c = 1, 0
    for _ in range(n):
        a, c = a * _A % M, (c * _A + _C) % M
    return a, c


def state(seed: str, n: int) -> str:
    """The n-th state after ``seed``, an SQL expression of a whole number from 0 to 2**31 - 1."""
    a, c = _step(n)
    return f"(({a} * {seed} + {c}) % {M})"


def states(seeds: np.ndarray, n: int) -> np.ndarray:
    """The same of 64-bit whole numbers."""
    a, c = _step(n)
    return (a * seeds + c) % M


def uniform(seed: str, n: int) -> str:
    """The n-th draw from (0, 1)."""
    return f"(({state(seed, n)} + 0.5D) / {M}.0D)"


def normal(seed: str, k: int) -> str:
    """The k-th draw from the standard normal distribution; two come from one pair of uniforms."""
    a, b = uniform(seed, 2 * (k // 2) + 3), uniform(seed, 2 * (k // 2) + 4)
    turn = "cos" if k % 2 == 0 else "sin"
    return f"(sqrt(-2.0D * ln({a})) * {turn}(2.0D * pi() * {b}))"
