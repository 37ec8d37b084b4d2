"""Factorization and sweeps of the top of the elimination tree by square cells of bounded size.

The columns above the subtrees are numbered anew, and cut into blocks of at most ``SIZE`` (see ``plans.mapping.block_levels``). A cell (bi, bj) is a dense block, a row of a DataFrame; the
factor's fill between blocks gives a tree of block columns. The first levels are tiers of parts (see ``plans.mapping.tiers``): a task factors all block columns of a part, one after
another, and gives what they subtract elsewhere; that is one job a tier. Above them are panels of some blocks (see ``plans.mapping.panels``); those of one level don't depend on each other, and a level is three jobs:
a task factors a panel's own square; rows of cells below it are dealt out and solved against it; then what all columns of the panel subtract to their right is found at once, by tasks that have two classes of those rows each,
so that a cell is changed once a panel and a long panel isn't one task's work.
What is subtracted from a cell is written beside it, and added up when its level comes: no level writes cells anew that it doesn't change.
Vectors are cut in the same blocks. Nothing here grows with the matrix but the number of cells and levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import dense
from ferrule.operators.store import Steps, checkpointed

SIZE = 256
#: Blocks of a panel above the parts, at most, unless one supernode has more.
PANEL = 8
#: Cells that a task adds products up in before it sends them on.
HELD = 64
#: Pieces of subtrees that a task adds up into one cell, about.
PIECES = 512
#: Entries that a task of a part holds for cells elsewhere, and gives back at a time.
ELSEWHERE, GIVEN = 8_000_000, 2_000_000
#: Numbers of a vector of the top that each task may have.
NEAR = 4_000_000
CELL = "lvl long, part long, bi long, bj long, val array<double>"
FACTORED = "lvl long, done int, part long, bi long, bj long, val array<double>, diag array<double>, inv array<double>"
PIECE = "lvl long, done int, part long, b long, val array<double>"
_CELL, _FACTORED, _PIECE = ([x.split()[0] for x in names.split(", ")] for names in (CELL, FACTORED, PIECE))


def columns(plan: DataFrame) -> DataFrame:
    """i, t, lvl, part of the columns of the top: number in the factor, number in the top, level of the block, part that one task has (even and under -1: a panel)."""
    return plan.where("step > 0").select("fc", "top", "part", F.posexplode("levels").alias("at", "lvl")).select((F.col("fc") + F.col("at")).alias("i"), (F.col("top") + F.col("at")).alias("t"), "lvl", "part")


#: Of cells: whether they are below the square of a panel. Their part is one less than the panel's, which is even.
_BELOW = "part < -1 AND part % 2 <> 0"


def _rows(frame: pd.DataFrame, *names: str):
    return zip(*(frame[n].tolist() for n in names), strict=True)


class _Sums:
    """Adds arrays by key, and gives up the oldest when it holds too many."""

    def __init__(self, columns: list[str], most: int = HELD):
        self.columns, self.most, self.held = columns, most, {}

    def add(self, key: tuple, val: np.ndarray):
        if key in self.held:
            self.held[key] += val
            return
        if len(self.held) >= self.most:
            yield self.frame([self.held.popitem()])
        self.held[key] = val

    def frame(self, items) -> pd.DataFrame:
        return pd.DataFrame([(*k, v.ravel()) for k, v in items], columns=self.columns)

    def rest(self, at_once: int = HELD):
        items = list(self.held.items())
        for a in range(0, len(items), max(1, at_once)):
            yield self.frame(items[a : a + max(1, at_once)])


@dataclass
class Top:
    """The factored top: ``cells`` by level, ``column`` (i, t, lvl)."""

    cells: Steps
    column: DataFrame
    levels: dict[int, int]  # of each block
    heights: dict[int, int]  # its columns
    parts: dict[int, int]
    size: int

    @property
    def depth(self) -> int:
        return max(self.levels.values()) + 1

    def _sized(self) -> DataFrame:
        """All cells with their rows (h) and columns (w)."""
        side = self.column.groupBy(F.floor(F.col("t") / self.size).alias("b")).agg(F.count(F.lit(1)).alias("n"))  # one row a block
        h, w = side.select(F.col("b").alias("bi"), F.col("n").alias("h")), side.select(F.col("b").alias("bj"), F.col("n").alias("w"))
        return self.cells.every().join(F.broadcast(h), "bi").join(F.broadcast(w), "bj")

    def to_coo(self) -> DataFrame:
        p = self._sized().select("bi", "bj", "w", F.posexplode("val").alias("at", "v"))
        p = p.select((F.col("bi") * self.size + F.floor(F.col("at") / F.col("w"))).alias("ti"), (F.col("bj") * self.size + F.col("at") % F.col("w")).alias("tj"), "v").where("ti >= tj")
        rows, cols = (self.column.select(F.col("t").alias(f"t{x}"), F.col("i").alias(x)) for x in "ij")
        return p.join(rows, "ti").join(cols, "tj").select("i", "j", "v")

    def product(self, pattern: DataFrame) -> DataFrame:
        """What the top adds to the entries (i, j) of L L' or L D L', of those of ``pattern``: a part's block columns in one task, others each in one of its own."""
        from ferrule.operators.factor import added_products

        size, height = self.size, self.heights.__getitem__
        task = F.when(F.col("part") >= 0, F.col("part")).otherwise(-2 - F.col("bj"))
        own = self.cells.every().select(task.alias("task"), "bi", "bj", "val", "diag")
        rows_of = self.cells.every().select(task.alias("task"), "bi").distinct()
        rows, cols = (self.column.select(F.col("i").alias(x), F.col("t").alias(f"t{x}")) for x in "ij")
        pairs = pattern.join(rows, "i").join(cols, "j").select(F.greatest("ti", "tj").alias("a"), F.least("ti", "tj").alias("b")).withColumn("bi", F.floor(F.col("b") / size))
        pairs = pairs.join(rows_of, "bi").select("task", "a", "b")

        def run(key, cells, pairs):
            pairs = pairs.sort_values("b")
            a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
            columns: dict[int, list] = {}
            for bi, bj, val, d in _rows(cells, "bi", "bj", "val", "diag"):
                columns.setdefault(bj, []).append((bi, val, d))

            def pieces():
                for bj, column in columns.items():
                    column.sort(key=lambda x: x[0])
                    d = column[0][2]
                    val = np.concatenate([np.asarray(v).reshape(height(bi), height(bj)) for bi, v, _ in column])
                    yield np.concatenate([bi * size + np.arange(height(bi)) for bi, _, _ in column]), val, d if d is None else np.asarray(d)

            total, reached = added_products(a, b, pieces())
            return pd.DataFrame({"a": a[reached], "b": b[reached], "v": total[reached]})

        found = own.groupBy("task").cogroup(pairs.groupBy("task")).applyInPandas(run, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
        a, b = (self.column.select(F.col("t").alias(x), F.col("i").alias(f"i{x}")) for x in "ab")
        return found.join(a, "a").join(b, "b").select(F.greatest("ia", "ib").alias("i"), F.least("ia", "ib").alias("j"), "v")

    def diagonal(self) -> DataFrame:
        own = self._sized().where("bi = bj")
        d = own.where("diag is not null").select("bj", F.posexplode("diag").alias("at", "v")).select((F.col("bj") * self.size + F.col("at")).alias("t"), "v")
        l = own.where("diag is null").select("bj", "w", F.posexplode("val").alias("at", "v")).where(F.col("at") % (F.col("w") + 1) == 0)
        both = d.unionByName(l.select((F.col("bj") * self.size + F.col("at") % F.col("w")).alias("t"), "v"))
        return both.join(self.column.select("t", F.col("i").alias("j")), "t").select("j", "v")

    def dump(self) -> DataFrame:
        return self._sized().select(F.lit("cell").alias("kind"), (F.col("bi") * self.size).alias("first_row"), (F.col("bj") * self.size).alias("first_col"), F.col("h").alias("n_rows"), F.col("w").alias("n_cols"), F.aggregate("val", F.lit(0.0), lambda s, x: s + x * x).alias("square"))

    def solve(self, b: DataFrame, nrhs: int) -> DataFrame:
        """x(i, k, v) on the columns of the top, for b(i, k, v); what b has elsewhere is passed over, and rows that it has more than once add up."""
        spark, size, levels, parts, height = b.sparkSession, self.size, self.levels, self.parts, self.heights.__getitem__
        in_parts = {levels[blk] for blk, part in parts.items() if part >= 0}
        flat = b.join(self.column, "i").select("lvl", "part", F.floor(F.col("t") / size).alias("b"), (F.col("t") % size).cast("int").alias("r"), "k", "v")

        def gather(key, frame):
            val = np.zeros((height(key[2]), nrhs))
            np.add.at(val, (frame["r"].to_numpy(), frame["k"].to_numpy()), frame["v"].to_numpy())
            return pd.DataFrame([(key[0], 0, key[1], key[2], val.ravel())], columns=_PIECE)

        down = Steps(spark, PIECE, "forward")
        # every block is there, with zeros where b has nothing
        zero = self.column.select("lvl", "part", F.floor(F.col("t") / size).alias("b"), F.lit(0).alias("r"), F.lit(0).alias("k"), F.lit(0.0).alias("v")).distinct()
        down.add(flat.unionByName(zero).groupBy("lvl", "part", "b").applyInPandas(gather, PIECE))

        def columns_of(own):
            """Cells of each block column, the diagonal one first."""
            out: dict[int, list] = {}
            for bi, bj, val, inv, d in sorted(_rows(own, "bi", "bj", "val", "inv", "diag"), key=lambda x: (x[1], x[0])):
                out.setdefault(bj, []).append((bi, np.asarray(inv if bi == bj else val).reshape(height(bi), height(bj)), d))
            return out

        def part_down(key, own, pieces):
            y: dict[int, np.ndarray] = {}
            for blk, val in _rows(pieces, "b", "val"):
                val = np.asarray(val).reshape(-1, nrhs)
                y[blk] = y[blk] + val if blk in y else val
            out = []
            for blk, ((_, inv, _), *below) in columns_of(own).items():
                x = inv @ y.pop(blk)
                out.append((levels[blk], 1, key[0], blk, x.ravel()))
                for bi, cell, _ in below:
                    y[bi] = (y[bi] if bi in y else 0) - cell @ x
            return pd.DataFrame([*out, *((levels[blk], 0, parts[blk], blk, val.ravel()) for blk, val in y.items())], columns=_PIECE)

        def part_up(key, own, pieces):
            y, sent = {}, {}
            for blk, val, below_it in _rows(pieces, "b", "val", "below"):
                val = np.asarray(val).reshape(-1, nrhs)
                if below_it:
                    sent[blk] = sent[blk] + val if blk in sent else val
                else:
                    y[blk] = val
            out = []
            for blk, ((_, inv, d), *below) in reversed(columns_of(own).items()):
                right = (y[blk] if d is None else y[blk] / np.asarray(d)[:, None]) - sent.get(blk, 0)
                for bi, cell, _ in below:
                    right = right - cell.T @ y[bi]
                y[blk] = inv.T @ right
                out.append((levels[blk], 1, key[0], blk, y[blk].ravel()))
            return pd.DataFrame(out, columns=_PIECE)

        def below(frames):
            sums = _Sums(_PIECE)
            for f in frames:
                for bi, bj, cell, y in _rows(f, "bi", "bj", "cell", "val"):
                    yield from sums.add((levels[bi], 0, parts[bi], bi), -np.asarray(cell).reshape(height(bi), height(bj)) @ np.asarray(y).reshape(-1, nrhs))
            yield from sums.rest()

        def above(frames):
            sums = _Sums(["part", "b", "val"])
            for f in frames:
                for bi, bj, cell, x in _rows(f, "bi", "bj", "cell", "val"):
                    yield from sums.add((parts[bj], bj), np.asarray(cell).reshape(height(bi), height(bj)).T @ np.asarray(x).reshape(-1, nrhs))
            yield from sums.rest()

        # where the vector of the top is small, cells stay where they are
        near = F.broadcast if sum(self.heights.values()) * nrhs <= NEAR else lambda df: df
        for level in range(self.depth):
            own, rhs = self.cells.at(level), down.at(level, 0)
            inside = own if level in in_parts else own.where(f"NOT ({_BELOW})")
            down.add(inside.groupBy("part").cogroup(rhs.groupBy("part")).applyInPandas(part_down, PIECE))
            if level not in in_parts and level < self.depth - 1:
                done = near(down.at(level).select(F.col("b").alias("bj"), "val"))
                down.add(own.where(_BELOW).select("bi", "bj", F.col("val").alias("cell")).join(done, "bj").mapInPandas(below, PIECE))

        up, piece = Steps(spark, PIECE, "backward"), "part long, b long, val array<double>"
        for level in range(self.depth - 1, -1, -1):
            own, y = self.cells.at(level), down.at(level).select("part", "b", "val")
            sent = None
            if level < self.depth - 1:  # what is solved of other blocks
                known = near(up.every().where(f"lvl > {level}").select(F.col("b").alias("bi"), "val"))
                if level in in_parts:
                    y = y.unionByName(own.select("part", "bi").distinct().join(known, "bi").select("part", F.col("bi").alias("b"), "val"))
                else:
                    sent = own.where(_BELOW).select("bi", "bj", F.col("val").alias("cell")).join(known, "bi").mapInPandas(above, piece)
            y = y.withColumn("below", F.lit(False))
            y = y if sent is None else y.unionByName(sent.withColumn("below", F.lit(True)))
            inside = own if level in in_parts else own.where(f"NOT ({_BELOW})")
            up.add(inside.groupBy("part").cogroup(y.groupBy("part")).applyInPandas(part_up, PIECE))
        x = up.every().select("b", F.posexplode("val").alias("at", "v")).select((F.col("b") * size + F.floor(F.col("at") / nrhs)).alias("t"), (F.col("at") % nrhs).cast("int").alias("k"), "v")
        return x.join(self.column.select("i", "t"), "t").select("i", "k", "v")


def factorize(coo: DataFrame, plan: DataFrame, updates: DataFrame, ldl: bool = False, size: int = SIZE) -> Top | None:
    """``updates``: bi, bj, grp, r, s, v: dense pieces (rows r, columns s of a cell) that subtrees add; ``coo``: the permuted matrix."""
    spark = coo.sparkSession
    column = checkpointed(columns(plan))
    # one row a block of at most SIZE columns
    blocks = column.groupBy(F.floor(F.col("t") / size).alias("b"), "lvl", "part").agg(F.count(F.lit(1)).alias("n")).collect()
    if not blocks:
        return None
    levels, heights, parts_of = ({r["b"]: r[c] for r in blocks} for c in ("lvl", "n", "part"))
    in_parts = {levels[b] for b, part in parts_of.items() if part >= 0}
    height = heights.__getitem__
    rows, cols = (column.select(F.col("i").alias(x), F.col("t").alias(f"t{x}")) for x in "ij")
    t = coo.join(rows, "i").join(cols, "j").select(F.greatest("ti", "tj").alias("ti"), F.least("ti", "tj").alias("tj"), "v")
    own = t.groupBy(F.floor(F.col("ti") / size).alias("bi"), F.floor(F.col("tj") / size).alias("bj")).agg(F.collect_list(F.struct((F.col("ti") % size).cast("int").alias("r"), (F.col("tj") % size).cast("int").alias("s"), "v")).alias("x"))  # a cell's at most
    own = own.select("bi", "bj", F.lit(-1).cast("long").alias("grp"), F.col("x.r").alias("r"), F.col("x.s").alias("s"), F.col("x.v").alias("v"))
    diagonal = column.select(F.floor(F.col("t") / size).alias("bi")).distinct().select("bi", F.col("bi").alias("bj"), F.lit(-1).cast("long").alias("grp"), F.array().cast("array<int>").alias("r"), F.array().cast("array<int>").alias("s"), F.array().cast("array<double>").alias("v"))

    def part_at(bi: int, bj: int) -> int:
        """The part of a cell."""
        own = parts_of[bj]
        return own - 1 if own < -1 and levels[bi] != levels[bj] else own

    def assemble(key, frame):
        bi, bj = key[:2]
        val = np.zeros((height(bi), height(bj)))
        for grp, r, s, v in _rows(frame, "grp", "r", "s", "v"):
            if grp < 0:
                np.add.at(val, (np.asarray(r, int), np.asarray(s, int)), np.asarray(v))
            else:
                val[np.ix_(r, s)] += np.asarray(v).reshape(len(r), len(s))
        return pd.DataFrame([(levels[bj], part_at(bi, bj), bi, bj, val.ravel())], columns=_CELL)

    # where subtrees add many pieces to one cell, they are added up by so many at a time first
    pieces = F.broadcast(updates.groupBy("bi", "bj").agg(F.ceil(F.count(F.lit(1)) / PIECES).alias("parts")))  # one row a cell
    split = updates.withColumn("_h", F.pmod(F.xxhash64("grp", "r", "s"), F.lit(2**31))).join(pieces, ["bi", "bj"]).select("bi", "bj", "grp", "r", "s", "v", (F.col("_h") % F.col("parts")).alias("salt"))
    parts = split.unionByName(own.unionByName(diagonal).withColumn("salt", F.lit(0).cast("long")))
    out = Steps(spark, FACTORED, "cells", max(1, GIVEN // size**2))

    def changed(df: DataFrame) -> DataFrame:
        return df.select("lvl", F.when(F.expr(_BELOW), 2).otherwise(0).alias("done"), "part", "bi", "bj", "val", *(F.lit(None).cast("array<double>").alias(c) for c in ("diag", "inv")))

    out.add(changed(parts.groupBy("bi", "bj", "salt").applyInPandas(assemble, CELL)))

    def part(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells of a part, some of them more than once: factored ones, and what they subtract elsewhere."""
        held: dict[int, dict[int, np.ndarray]] = {}
        for f in frames:
            for bi, bj, val in _rows(f, "bi", "bj", "val"):
                val, own = np.asarray(val).reshape(height(bi), height(bj)), held.setdefault(bj, {})
                own[bi] = own[bi] + val if bi in own else val
        sums, given, size_of = _Sums(_CELL, max(HELD, ELSEWHERE // size**2)), [], 0
        elsewhere = lambda frame: pd.DataFrame({"done": 2 * ((frame["part"] < -1) & (frame["part"] % 2 == 1)), "diag": None, "inv": None} | {c: frame[c] for c in _CELL})[_FACTORED]
        for bj in sorted(held):
            own = held.pop(bj)
            a, names = own.pop(bj), [f"{bj * size + k} above the subtrees" for k in range(height(bj))]
            a = np.tril(a) + np.tril(a, -1).T
            l, d = dense.ldl(a, names) if ldl else (dense.cholesky(a, names), None)
            inv = dense.triangular_inverse(l)
            given.append((levels[bj], 1, key[0], bj, bj, l.ravel(), d, inv.ravel()))
            below = sorted(own)
            x = [own.pop(bi) @ inv.T / (1 if d is None else d) for bi in below]
            given.extend((levels[bj], 1, key[0], bi, bj, y.ravel(), d, None) for bi, y in zip(below, x, strict=True))
            size_of += sum(y.size for y in (l, inv, *x))
            every, at = np.concatenate(x) if x else None, np.cumsum([0, *(len(y) for y in x)]).tolist()
            for n, j in enumerate(below):
                z = -every[at[n] :] @ (x[n] if d is None else x[n] * d).T
                for m in range(n, len(below)):
                    i, change = below[m], z[at[m] - at[n] : at[m + 1] - at[n]]
                    if not change.any():
                        continue
                    if parts_of[j] == key[0]:
                        to = held.setdefault(j, {})
                        to[i] = to[i] + change if i in to else change
                    else:
                        for frame in sums.add((levels[j], part_at(i, j), i, j), change.copy()):
                            yield elsewhere(frame)
            if size_of > GIVEN:
                yield pd.DataFrame(given, columns=_FACTORED)
                given, size_of = [], 0
        yield pd.DataFrame(given, columns=_FACTORED)
        for frame in sums.rest(GIVEN // size**2):
            yield elsewhere(frame)

    def below(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of cells below a panel, some cells more than once, solved against its square."""
        square, rows = {}, {}
        for f in frames:
            for done, bi, bj, val, d, inv in _rows(f, "done", "bi", "bj", "val", "diag", "inv"):
                val = np.asarray(val).reshape(height(bi), height(bj))
                if done == 1:
                    square[bi, bj] = (np.asarray(inv).reshape(val.shape), d if d is None else np.asarray(d)) if bi == bj else val
                else:
                    rows[bi, bj] = rows[bi, bj] + val if (bi, bj) in rows else val
        every = sorted({bi for bi, _ in rows})
        at = np.cumsum([0, *map(height, every)]).tolist()
        solved: dict[int, np.ndarray] = {}
        for bj in sorted(b for b, j in square if b == j) if every else ():
            x = np.zeros((at[-1], height(bj)))
            for n, bi in enumerate(every):
                if (bi, bj) in rows:
                    x[at[n] : at[n + 1]] = rows.pop((bi, bj))
            for k, y in solved.items():
                if (bj, k) in square:
                    d = square[k, k][1]
                    x -= (y if d is None else y * d) @ square[bj, k].T
            inv, d = square[bj, bj]
            solved[bj] = x = x @ inv.T / (1 if d is None else d)
            cells = ((bi, x[at[n] : at[n + 1]]) for n, bi in enumerate(every))
            yield pd.DataFrame([(levels[bj], 1, parts_of[bj] - 1, bi, bj, c.ravel(), d, None) for bi, c in cells if c.any()], columns=_FACTORED)

    def products(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a panel subtracts from the cells whose row is of one of two classes and whose column is of the other."""
        found, diag = {}, {}
        for f in frames:
            for bi, bj, val, d in _rows(f, "bi", "bj", "val", "diag"):
                found.setdefault(bi, {})[bj] = np.asarray(val).reshape(height(bi), height(bj))
                diag[bj] = None if d is None else np.asarray(d)
        first = dict(zip(sorted(diag), np.cumsum([0, *map(height, sorted(diag))]).tolist()[:-1], strict=True))
        total, d = sum(map(height, diag)), None
        if diag and next(iter(diag.values())) is not None:
            d = np.concatenate([diag[bj] for bj in sorted(diag)])
        classes: dict[int, list[int]] = {key[1]: [], key[2]: []}
        for bi in sorted(found):
            classes[bi % key[3]].append(bi)
        joined = {}
        for c, rows in classes.items():
            joined[c], at = np.zeros((sum(map(height, rows)), total)), 0
            for bi in rows:
                for bj, val in found.pop(bi).items():
                    joined[c][at : at + height(bi), first[bj] : first[bj] + height(bj)] = val
                at += height(bi)
        given, size_of = [], 0
        for c, other in {(key[1], key[2]), (key[2], key[1])}:
            at = 0
            for bi in classes[c]:
                x = joined[c][at : at + height(bi)]
                at += height(bi)
                cols = [bj for bj in classes[other] if bj <= bi]
                ends = np.cumsum([0, *map(height, cols)]).tolist()
                z = -(x if d is None else x * d) @ joined[other][: ends[-1]].T
                for n, bj in enumerate(cols):
                    change = z[:, ends[n] : ends[n + 1]]
                    # where no column has rows in both blocks, the product is zero
                    if change.any():
                        given.append((levels[bj], part_at(bi, bj), bi, bj, change.ravel()))
                        size_of += change.size
                if size_of > GIVEN:
                    yield pd.DataFrame(given, columns=_CELL)
                    given, size_of = [], 0
        yield pd.DataFrame(given, columns=_CELL)

    depth, slots = max(levels.values()) + 1, spark.sparkContext.defaultParallelism
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    for level in range(depth):
        out.add(out.at(level, 0).groupBy("part").applyInPandas(part, FACTORED))
        if level in in_parts or level == depth - 1:
            continue
        higher = sum(v > level for v in levels.values())
        n = min(2 * slots, higher)
        own = out.at(level).withColumn("task", every(n)).unionByName(out.at(level, 2).withColumn("part", F.col("part") + 1).withColumn("task", F.pmod("bi", F.lit(n)).cast("int")))
        out.add(own.repartition(4 * n, "part", "task").groupBy("part", "task").applyInPandas(below, FACTORED))
        g = min(next(k for k in range(1, 2 * slots + 1) if k * (k + 1) >= 4 * slots), higher)
        own, other = F.pmod("bi", F.lit(g)).cast("int"), F.col("other")
        rows = out.at(level).where(_BELOW).withColumn("other", every(g)).select("part", F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), F.lit(g).alias("g"), "bi", "bj", "val", "diag")
        pair = ["part", "a", "b", "g"]
        out.add(changed(rows.repartition(2 * g * (g + 1), *pair).groupBy(*pair).applyInPandas(products, CELL)))
    return Top(out, column, levels, heights, parts_of, size)
