"""The generator of ``faults`` number by number, free of Spark, for passes that draw as they go."""

from __future__ import annotations

from collections.abc import Iterator

_MASK = (1 << 32) - 1


def stream(label: str) -> Iterator[float]:
    """All numbers of a label's generator, one after another."""
    h = 0x811C9DC5
    for c in label.encode():
        h = (h ^ c) * 0x01000193 & _MASK
    while True:
        h = h + 0x6D2B79F5 & _MASK
        t = (h ^ h >> 15) * (h | 1) & _MASK
        t ^= t + ((t ^ t >> 7) * (t | 61) & _MASK) & _MASK
        yield (t ^ t >> 14) / float(1 << 32)
