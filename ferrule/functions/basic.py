"""Disjoint sets, sizes with suffixes, cost formulas and process maps."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


class DisjointSet:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def union(self, a: int, b: int) -> int:
        self.root[self.find(b)] = self.find(a)
        return self.find(a)


def parse_size(text: str) -> int:
    """``4k``, ``2m``, ``1g``, ``1t``, ``12b`` or a plain number of bytes."""
    text = text.strip().lower()
    power = {"b": 0, "k": 1, "m": 2, "g": 3, "t": 4}.get(text[-1:])
    return int(text) if power is None else int(float(text[:-1]) * 1024**power)


def common_divisor(values: list[int]) -> int:
    return gcd(*values) if values else 0


def process_map(kind: str, i: Column, j: Column, p: int) -> Column:
    """The process of block (i, j) among ``p``; square grids use the largest square that fits.

    FANOUT and FANIN are names of ROW2D and COL2D. The tree map needs the tree: see ``plans.mapping.tree_map``.
    """
    side = max(1, int(p**0.5))
    low, high = F.least(i, j), F.greatest(i, j)
    forms = {
        "ROW2D": F.pmod(i, F.lit(p)),
        "COL2D": F.pmod(j, F.lit(p)),
        "ANTIDIAG2D": F.pmod(i + j, F.lit(p)),
        "WRAP2D": F.pmod(i, F.lit(side)) + side * F.pmod(j, F.lit(side)),
        "WRAP2DFORCED": F.when(i == j, F.pmod(j, F.lit(side * side))).otherwise(F.pmod(i, F.lit(side)) + side * F.pmod(j, F.lit(side))),
        "MODWRAP2D": F.pmod(low, F.lit(side)) + side * F.pmod(F.floor(high / side), F.lit(side)),
        "MODWRAP2DNS": F.pmod(i, F.lit(side)) + side * F.pmod(F.floor(j / side), F.lit(side)),
    }
    kind = {"FANOUT": "ROW2D", "FANIN": "COL2D"}.get(kind, kind)
    if kind not in forms:
        raise ValueError(f"unknown process map {kind}")
    return forms[kind]


def panel_flops(width, height):
    """Operations to factor a panel: its triangle, the solve below, and the update it causes. Numbers or columns."""
    below = height - width
    return width * width * width / 3 + width * width * below + width * below * below
