"""LL' and LDL' factorization and triangular sweeps: whole subtrees in one task each, and what is above them by cells.

``plan`` is one row a supernode (see ``ferrule.plans.solver``). Supernodes of step 0 belong to subtrees, some of them a group: one grouped kernel factors
a group multifrontally and gives its panels and, cut along the cells above, what it subtracts there. All other supernodes are the top: ``cells`` factors it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import cells, dense
from ferrule.operators.ordering import expanded
from ferrule.operators.store import checkpointed

#: Entries that a task has at hand before it gives them back; a supernode counts as some of them at least.
GIVEN, LEAST = 2_000_000, 100
#: Panels and pieces that a reader has at a time; a piece has up to the square of a cell's side.
TOGETHER = 256
_OUT = "is_panel boolean, grp long, sid long, fc long, width long, rows array<long>, nzval array<double>, diag array<double>, bi long, bj long, r array<int>, s array<int>"


def factor_front(front: np.ndarray, width: int, fc: int, ldl: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Panel (rows x width), diagonal, and what remains for the ancestors."""
    a11, a21, column = front[:width, :width], front[width:, :width], np.arange(fc, fc + width)
    a11 = np.tril(a11) + np.tril(a11, -1).T
    if ldl:
        l11, d = dense.ldl(a11, column)
        l21 = dense.triangular_solve(l11, a21.T).T / d
        rest = front[width:, width:] - (l21 * d) @ l21.T
    else:
        l11, d = dense.cholesky(a11, column), None
        l21 = dense.triangular_solve(l11, a21.T).T
        rest = front[width:, width:] - l21 @ l21.T
    return np.vstack([l11, l21]), d, rest


def _factor_group(ldl: bool, size: int):
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Plan rows of a bundle of subtrees, and its matrix entries (sid, i, j, v); panels are given back as they are made."""
        metas, entries = [], []
        for f in frames:
            is_entry = f["i"].notna()
            metas.append(f.loc[~is_entry, ["sid", "fc", "width", "rows", "parent", "trows"]])
            entries.append(f.loc[is_entry, ["sid", "i", "j", "v"]].astype({"i": np.int64, "j": np.int64}))
        meta, data = pd.concat(metas).sort_values("sid"), pd.concat(entries).sort_values("sid", kind="stable")
        del metas, entries
        at = np.searchsorted(data["sid"].to_numpy(), meta["sid"].to_numpy(), side="left")
        to = np.searchsorted(data["sid"].to_numpy(), meta["sid"].to_numpy(), side="right")
        ei, ej, ev = (data[c].to_numpy() for c in "ijv")
        below: dict[int, list] = {int(s): [] for s in meta["sid"]}
        out, held = [], 0
        for (sid, fc, width, rows, parent, trows), a, b in zip(meta[["sid", "fc", "width", "rows", "parent", "trows"]].itertuples(index=False), at, to, strict=True):
            if held > GIVEN:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
            rows, fc, width = np.asarray(rows, np.int64), int(fc), int(width)
            held += len(rows) * (width if int(parent) in below else len(rows)) + LEAST
            front = np.zeros((len(rows), len(rows)))
            np.add.at(front, (np.searchsorted(rows, ei[a:b]), np.searchsorted(rows, ej[a:b])), ev[a:b])
            for r, u in below.pop(int(sid)):
                where = np.searchsorted(rows, r)
                front[np.ix_(where, where)] += u
            panel, d, rest = factor_front(front, width, fc, ldl)
            out.append((True, key[0], sid, fc, width, rows, panel.ravel(), d, None, None, None, None))
            if len(rows) == width:
                continue
            if int(parent) in below:
                below[int(parent)].append((rows[width:], rest))
                continue
            t = np.asarray(trows, np.int64)
            block, first = np.unique(t // size, return_index=True)
            ends = np.append(first[1:], len(t))
            for x, (bi, a1, b1) in enumerate(zip(block.tolist(), first, ends, strict=True)):
                for bj, a2, b2 in zip(block[: x + 1].tolist(), first, ends):  # noqa: B905
                    out.append((False, key[0], sid, fc, 0, None, rest[a1:b1, a2:b2].ravel(), None, bi, bj, (t[a1:b1] % size).astype(np.int32), (t[a2:b2] % size).astype(np.int32)))
        yield pd.DataFrame(out, columns=names)

    return run


@dataclass
class Factor:
    """``panels`` of the subtrees, ``top`` of what is above (None if nothing is)."""

    panels: DataFrame
    top: cells.Top | None
    plan: DataFrame


def factorize(coo: DataFrame, plan: DataFrame, ldl: bool = False, size: int = cells.SIZE) -> Factor:
    """The factor of the permuted matrix ``coo``."""
    low = plan.where("step = 0")
    owner = low.select("sid", "grp", F.explode(F.sequence("fc", F.col("fc") + F.col("width") - 1)).alias("j"))
    data = coo.join(owner, "j").select("grp", "sid", "i", "j", "v")
    meta = low.select("grp", "sid", "fc", "width", "rows", "parent", "trows")
    done = checkpointed(meta.unionByName(data, allowMissingColumns=True).groupBy("grp").applyInPandas(_factor_group(ldl, size), _OUT), TOGETHER)
    panels = done.where("is_panel").select("grp", "sid", "fc", "width", "rows", "nzval", "diag")
    return Factor(panels, cells.factorize(coo, plan, done.where("not is_panel").select("bi", "bj", "grp", "r", "s", F.col("nzval").alias("v")), ldl, size), plan)


def to_coo(f: Factor) -> DataFrame:
    """L as entries, its unit diagonal included for LDL'."""
    p = f.panels.select("fc", "width", "rows", F.posexplode("nzval").alias("at", "v"))
    r, c = F.floor(F.col("at") / F.col("width")).cast("int"), (F.col("at") % F.col("width"))
    low = p.select(F.element_at("rows", r + 1).alias("i"), (F.col("fc") + c).alias("j"), "v").where("i >= j")
    return low if f.top is None else low.unionByName(f.top.to_coo())


def diagonal(f: Factor) -> DataFrame:
    """Diagonal of D, or of L."""
    d = f.panels.where("diag is not null").select("fc", F.posexplode("diag").alias("at", "v")).select((F.col("fc") + F.col("at")).alias("j"), "v")
    own = to_coo(Factor(f.panels.where("diag is null"), None, f.plan)).where("i = j").select("j", "v")
    both = d.unionByName(own)
    return both if f.top is None else both.unionByName(f.top.diagonal())


def block_dump(f: Factor) -> DataFrame:
    """Each block of the factor with its place and size: what there is to look at without the entries."""
    low = f.panels.select(F.lit("panel").alias("kind"), F.col("fc").alias("first_row"), F.col("fc").alias("first_col"), F.size("rows").cast("long").alias("n_rows"), F.col("width").alias("n_cols"), F.aggregate("nzval", F.lit(0.0), lambda s, x: s + x * x).alias("square"))
    return low if f.top is None else low.unionByName(f.top.dump())


def added_products(a: np.ndarray, b: np.ndarray, pieces) -> tuple[np.ndarray, np.ndarray]:
    """What panels (rows in order, values, diagonal or None) add to the entries (a, b) of L L' or L D L', and which entries they reach; ``b`` is in order."""
    total, reached = np.zeros(len(a)), np.zeros(len(a), bool)
    for rows, val, d in pieces:
        low, high = np.searchsorted(b, rows, "left"), np.searchsorted(b, rows, "right")
        pair, column = expanded(low, high), np.repeat(np.arange(len(rows)), high - low)
        row = np.searchsorted(rows, a[pair])
        there = np.append(rows, -1)[row] == a[pair]
        pair, row, column = pair[there], row[there], column[there]
        total[pair] += np.einsum("pk,pk->p", val[row], (val if d is None else val * d)[column])
        reached[pair] = True
    return total, reached


def _products(key, panels: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    pairs = pairs.sort_values("b")
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    pieces = ((np.asarray(r, np.int64), np.asarray(v).reshape(len(r), -1), d if d is None else np.asarray(d)) for r, v, d in zip(panels["rows"], panels["nzval"], panels["diag"], strict=True))
    total, reached = added_products(a, b, pieces)
    return pd.DataFrame({"i": a[reached], "j": b[reached], "v": total[reached]})


def product(f: Factor, pattern: DataFrame) -> DataFrame:
    """L L' or L D L' at the entries (i, j), i >= j, of ``pattern``, each once: panels and cells are multiplied where they are, as single entries of L would be many more."""
    low = f.plan.where("step = 0")
    own = low.select("grp", F.explode(F.sequence("fc", F.col("fc") + F.col("width") - 1)).alias("j"))
    above = low.where("trows is not null").select("grp", "fc", "width", F.explode("rows").alias("j")).where("j >= fc + width").select("grp", "j").distinct()
    pairs = pattern.join(own.unionByName(above), "j").select("grp", F.col("i").alias("a"), F.col("j").alias("b"))
    out = f.panels.groupBy("grp").cogroup(pairs.groupBy("grp")).applyInPandas(_products, "i long, j long, v double")
    out = out if f.top is None else out.unionByName(f.top.product(pattern))
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


_SWEPT = "i long, k int, v double, is_final boolean"


def _matrix(x: pd.DataFrame, rows: np.ndarray, nrhs: int) -> np.ndarray:
    out = np.zeros((len(rows), nrhs))
    if len(x):
        np.add.at(out, (np.searchsorted(rows, x["i"].to_numpy()), x["k"].to_numpy()), x["v"].to_numpy())
    return out


def _sweep_group(nrhs: int, forward: bool):
    def run(key, panels: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(panels):
            return pd.DataFrame({"i": [], "k": [], "v": [], "is_final": []}).astype({"i": "int64", "k": "int32", "v": "float64", "is_final": bool})
        rows = [np.asarray(r, np.int64) for r in panels["rows"]]
        every = np.unique(np.concatenate(rows))
        y = _matrix(x, every, nrhs)
        own = np.zeros(len(every), bool)
        widths, values, diagonals = (panels[c].tolist() for c in ("width", "nzval", "diag"))
        for n in np.argsort(panels["sid"].to_numpy())[:: 1 if forward else -1].tolist():
            w, d = widths[n], diagonals[n]
            l = np.asarray(values[n]).reshape(-1, w)
            at = np.searchsorted(every, rows[n])
            own[at[:w]] = True
            if forward:
                y[at[:w]] = z = dense.triangular_solve(l[:w], y[at[:w]])
                y[at[w:]] -= l[w:] @ z
            else:
                z = y[at[:w]] if d is None else y[at[:w]] / np.asarray(d)[:, None]
                y[at[:w]] = dense.triangular_solve(l[:w], z - l[w:].T @ y[at[w:]], True)
        keep = np.ones(len(every), bool) if forward else own
        return pd.DataFrame({"i": np.repeat(every[keep], nrhs), "k": np.tile(np.arange(nrhs, dtype=np.int32), int(keep.sum())), "v": y[keep].ravel(), "is_final": np.repeat(own[keep], nrhs)})

    return run


def solve(f: Factor, b: DataFrame, nrhs: int) -> DataFrame:
    """x(i, k, v) of L L' x = b or L D L' x = b, for b(i, k, v) in the factor's order."""
    low = f.plan.where("step = 0")
    column = low.select("grp", F.explode(F.sequence("fc", F.col("fc") + F.col("width") - 1)).alias("i"))
    b = b.select("i", F.col("k").cast("int").alias("k"), F.col("v").cast("double").alias("v"))
    done = checkpointed(f.panels.groupBy("grp").cogroup(b.join(column, "i").groupBy("grp")).applyInPandas(_sweep_group(nrhs, True), _SWEPT))
    y = done.where("is_final").select("i", "k", "v")
    top = None
    if f.top is not None:
        sent = done.where("not is_final").select("i", "k", "v")
        top = f.top.solve(b.unionByName(sent), nrhs)
    mine = y.join(column, "i").select("grp", "i", "k", "v")
    if top is not None:
        # rows that a subtree has above it: those of its roots
        need = low.where("trows is not null").select("grp", "fc", "width", F.explode("rows").alias("i")).where("i >= fc + width").select("grp", "i").distinct()
        mine = mine.unionByName(need.join(top, "i").select("grp", "i", "k", "v"))
    x = f.panels.groupBy("grp").cogroup(mine.groupBy("grp")).applyInPandas(_sweep_group(nrhs, False), _SWEPT)
    x = checkpointed(x.where("is_final").drop("is_final"))
    return x if top is None else x.unionByName(top)
