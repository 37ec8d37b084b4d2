"""Elimination trees, column counts, supernodes and their structure, in array form and as DataFrames.

The array functions run inside one task; ``analyse`` is the one that calls them, on an executor. What is declarative (fundamental supernodes from counts,
block statistics, update counts, tree levels of a supernode table) is done in DataFrame operations.
"""

from __future__ import annotations

from array import array
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrule.functions.scan import prefix_sum
from ferrule.operators import ordering
from ferrule.operators.ordering import Lists, expanded
from ferrule.operators.store import checkpointed, gathered, given_back, in_one_task


def _filled(value: int, n: int) -> array:
    """A list of small integers in 4 bytes each."""
    return array("i", [value]) * n


def columns_of(n: int, i: np.ndarray, j: np.ndarray) -> Lists:
    """For each row, the smaller columns with an entry."""
    keep = i > j
    return Lists.of(n, i[keep], j[keep])


def etree(cols: Lists) -> np.ndarray:
    """parent[j] = min{i > j: l_ij != 0}, -1 for roots; with path compression over ancestors."""
    n = len(cols)
    parent, ancestor = _filled(-1, n), _filled(-1, n)
    for i, row in enumerate(cols):
        for k in row:
            while k != -1 and k < i:
                up = ancestor[k]
                ancestor[k] = i
                if up == -1:
                    parent[k] = i
                k = up
    return np.array(parent, np.int32)


def postorder(parent: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """order[new] = old; siblings by ``key``, then number."""
    n = len(parent)
    by = np.lexsort((parent,)) if key is None else np.lexsort((key, parent))
    up = parent[by]
    same = up[1:] == up[:-1]
    # the largest child first; of roots, the smallest
    head, following = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    following[by[1:][same]] = by[:-1][same]
    last = np.append(~same, True)[:n] & (up >= 0)
    head[up[last]] = by[last]
    roots = by[: int((up < 0).sum())]
    following[roots] = np.append(roots[1:], -1)[: len(roots)]
    head, following = array("i", head.tobytes()), array("i", following.tobytes())
    out, stack = _filled(-1, n), [int(roots[0])] if n else []
    for at in range(n - 1, -1, -1):
        v = stack.pop()
        out[at] = v
        if following[v] >= 0:
            stack.append(following[v])
        if head[v] >= 0:
            stack.append(head[v])
    return np.array(out, np.int32)


def counts(cols: Lists, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each column and row of the factor, diagonal included, in about the matrix's entries many steps: each row's subtree is known by
    its leaves (the skeleton), and the paths from two leaves that follow one another meet at their least common ancestor."""
    n = len(cols)
    order = postorder(parent)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    post, up, place = array("i", order.tobytes()), array("i", np.asarray(parent, np.int32).tobytes()), array("i", place.tobytes())
    first, level, change = place[:], _filled(0, n), _filled(0, n)
    for v in post:  # children before parents
        if up[v] >= 0 and first[v] < first[up[v]]:
            first[up[v]] = first[v]
    for v in reversed(post):
        level[v] = level[up[v]] + 1 if up[v] >= 0 else 0
        change[v] = int(first[v] == place[v])  # a leaf of the tree begins a column of its own
    below = cols.transposed(n)
    ptr, values = array("q", below.ptr.tobytes()), array("i", below.values.tobytes())
    rc, last_first, last_leaf, ancestor = _filled(1, n), _filled(-1, n), _filled(-1, n), array("i", np.arange(n, dtype=np.int32).tobytes())
    for j in post:
        if up[j] >= 0:
            change[up[j]] -= 1
        for i in values[ptr[j] : ptr[j + 1]]:
            if first[j] <= last_first[i]:
                continue  # no leaf of row i's subtree
            last_first[i] = first[j]
            before, last_leaf[i] = last_leaf[i], j
            change[j] += 1
            if before < 0:
                rc[i] += level[j] - level[i]
                continue
            meet = before
            while ancestor[meet] != meet:
                ancestor[meet] = ancestor[ancestor[meet]]
                meet = ancestor[meet]
            change[meet] -= 1
            rc[i] += level[j] - level[meet]
        if up[j] >= 0:
            ancestor[j] = up[j]
    for v in post:
        if up[v] >= 0:
            change[up[v]] += change[v]
    return np.array(change, np.int32), np.array(rc, np.int32)


def supernodes(parent: np.ndarray, cc: np.ndarray, max_size: int = 0) -> np.ndarray:
    """First columns of the fundamental supernodes, and n."""
    n = len(parent)
    if not n:
        return np.zeros(1, np.int64)
    at = np.arange(n)
    new = np.append(True, (parent[:-1] != at[1:]) | (cc[:-1] != cc[1:] + 1))
    if max_size:
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % max_size == 0
    return np.append(np.flatnonzero(new), n).astype(np.int64)


def relax(parent: np.ndarray, cc: np.ndarray, xsuper: np.ndarray, max_size: int = 150, widths=(8, 32, 64), zeros=(0.8, 0.1, 0.05)) -> np.ndarray:
    """Merges a supernode with the next one, its parent, where few zeros come in; one with a single row below its own, also if its parent is merged with the next one already: so leaves of
    one star become one. Others than those aren't, as where subtrees have a fixed limit, wider supernodes would leave more to the top."""
    ns = len(xsuper) - 1
    width, height, extra = (array("q", np.asarray(x, np.int64).tobytes()) for x in (np.diff(xsuper), cc[xsuper[:-1]], np.zeros(ns)))
    joined = bytearray(ns)  # with the next one
    up, last = array("q", super_parents(parent, xsuper).astype(np.int64).tobytes()), ns - 1
    for k in range(ns - 2, -1, -1):
        q, end = k + 1, last  # those from q to end are one by now
        last = k
        if up[k] != q and not (q < up[k] <= end and height[k] == width[k] + 1):
            continue
        w = width[k] + width[q]
        if max_size and w > max_size:
            continue
        tall = width[k] + height[q]
        new = extra[k] + extra[q] + width[k] * (tall - height[k])
        total = w * (w + 1) / 2 + w * (height[q] - width[q])
        z = new / total
        if w <= widths[0] or new == extra[k] + extra[q] or (w <= widths[1] and z < zeros[0]) or (w <= widths[2] and z < zeros[1]) or z < zeros[2]:
            joined[k], last = True, end
            width[k], height[k], extra[k] = w, tall, new
    begins = np.append(True, np.frombuffer(joined, np.uint8)[:-1] == 0)[:ns]
    return np.append(xsuper[:-1][begins], xsuper[-1]).astype(np.int64)


def super_parents(parent: np.ndarray, xsuper: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(xsuper) - 1, dtype=np.int32), np.diff(xsuper))
    up = parent[xsuper[1:] - 1]
    return np.where(up >= 0, owner[up], -1)


class Runs:
    """Rows of each supernode as runs of consecutive ones: run k of supernode s, ``ptr[s] <= k < ptr[s + 1]``, is ``start[k]`` to ``end[k] - 1``. Indexed, it
    gives rows one by one."""

    def __init__(self, ptr: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.ptr, self.start, self.end = ptr, start, end

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def __getitem__(self, s: int) -> np.ndarray:
        if not 0 <= s < len(self):
            raise IndexError(s)
        return expanded(self.start[self.ptr[s] : self.ptr[s + 1]], self.end[self.ptr[s] : self.ptr[s + 1]])

    def heights(self) -> np.ndarray:
        return np.add.reduceat((self.end - self.start).astype(np.int64), self.ptr[:-1]) if len(self) else np.zeros(0, np.int64)


def rows_of(starts: str, ends: str) -> Column:
    """The rows of a supernode whose runs begin at ``starts`` and end before ``ends``."""
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.sequence(a, b - 1)))


def structures(n: int, i: np.ndarray, j: np.ndarray, xsuper: np.ndarray, sparent: np.ndarray) -> Runs:
    """Rows of each supernode, its own columns first: those of the matrix and of its children."""
    ns = len(xsuper) - 1
    owner = np.repeat(np.arange(ns, dtype=np.int32), np.diff(xsuper))
    below = i >= xsuper[1:][owner[j]]
    own = iter(Lists.of(max(n, 1), owner[j[below]], i[below], ns))
    bounds = array("q", xsuper.astype(np.int64).tobytes())
    child, sibling, up = _filled(-1, ns), _filled(-1, ns), array("i", sparent.astype(np.int32).tobytes())
    ptr, start, end = array("q", [0]), array("i"), array("i")
    for s in range(ns):
        low = bounds[s + 1]
        found = [(r, r + 1) for r in next(own)]
        c = child[s]
        while c >= 0:
            for k in range(ptr[c], ptr[c + 1]):
                if end[k] > low:
                    found.append((start[k] if start[k] > low else low, end[k]))
            c = sibling[c]
        found.sort()
        a, b = bounds[s], low
        for x, y in found:
            if x > b:
                start.append(a)
                end.append(b)
                a, b = x, y
            elif y > b:
                b = y
        start.append(a)
        end.append(b)
        ptr.append(len(start))
        if up[s] >= 0:
            sibling[s], child[up[s]] = child[up[s]], s
    return Runs(np.array(ptr), np.array(start), np.array(end))


REFINEMENTS = ("SET", "TSPB")


def refine(xsuper: np.ndarray, rows: Runs, method: str = "SET") -> np.ndarray:
    """order[new] = old inside supernodes, so that columns that the same descendants hold stand together: by partition
    refinement (SET), or by nearest insertion on the Hamming distance of those sets (TSPB)."""
    if method not in REFINEMENTS:
        raise ValueError(f"unknown refinement {method}")
    n, ns = int(xsuper[-1]), len(xsuper) - 1
    by = np.repeat(np.arange(ns, dtype=np.int32), np.diff(rows.ptr))
    start = np.maximum(rows.start, xsuper[1:][by])
    keep = start < rows.end
    size = (rows.end - start)[keep]
    holders = Lists.of(max(ns, 1), expanded(start[keep], rows.end[keep]).astype(np.int32), np.repeat(by[keep], size), n)  # of each column, by number
    order = np.arange(n)
    for a, b in pairwise(xsuper.tolist()):
        if b - a < 2:
            continue
        held = [holders[c] for c in range(a, b)]
        if method == "TSPB":
            every = np.unique(np.concatenate(held))
            has = np.zeros((b - a, len(every)))
            for k, h in enumerate(held):
                has[k, np.searchsorted(every, h)] = 1
            many = has.sum(1)
            apart = many[:, None] + many[None, :] - 2 * has @ has.T
            tour = np.zeros(1, np.int64)
            for c in range(1, b - a):
                between = apart[tour[:-1], c] + apart[c, tour[1:]] - apart[tour[:-1], tour[1:]]
                tour = np.insert(tour, np.argmin(np.concatenate([[apart[c, tour[0]]], between, [apart[tour[-1], c]]])), c)
            order[a:b] = a + tour
        else:  # split by the holders from the last to the first, those that are held first: the order of their lists
            keys = [h[::-1].tolist() for h in held]
            order[a:b] = [a + k for k in sorted(range(b - a), key=keys.__getitem__, reverse=True)]
    return order


def analyse_arrays(n: int, i: np.ndarray, j: np.ndarray, method: str = "MMD", order: np.ndarray | None = None, max_size: int = 150, relaxed: bool = True, refinement: str | None = None) -> dict:
    """The whole symbolic phase: order (order[new] = old), parent, cc, rc, xsuper, sparent, rows."""
    order = ordering.order_array(method, n, i, j) if order is None else order

    def relabel(order):
        new = np.empty(n, np.int32)
        new[order] = np.arange(n, dtype=np.int32)
        return np.maximum(new[i], new[j]), np.minimum(new[i], new[j])

    def pattern(order):
        a, b = relabel(order)
        cols = columns_of(n, a, b)
        parent = etree(cols)
        return a, b, parent, *counts(cols, parent)

    a, b, parent, cc, rc = pattern(order)
    for sort_children in (False, method != "NATURAL"):  # neither tree nor counts change but in number
        post = postorder(parent, cc if sort_children else None)
        new = np.empty(n, np.int32)
        new[post] = np.arange(n, dtype=np.int32)
        order, up, cc, rc = order[post], parent[post], cc[post], rc[post]
        parent = np.where(up >= 0, new[up], np.int32(-1))
    a, b = relabel(order)
    while True:
        xsuper = supernodes(parent, cc, max_size)
        if relaxed:
            xsuper = relax(parent, cc, xsuper, max_size)
        sparent = super_parents(parent, xsuper)
        rows = structures(n, a, b, xsuper, sparent)
        if refinement is None:
            return {"order": order, "parent": parent, "cc": cc, "rc": rc, "xsuper": xsuper, "sparent": sparent, "rows": rows}
        order, refinement = order[refine(xsuper, rows, refinement)], None
        a, b, parent, cc, rc = pattern(order)


def columns(coo: DataFrame, n: int, perm: DataFrame | None = None) -> DataFrame:
    """j, parent (null for roots), cc, rc of the matrix as numbered, or as ``perm`` numbers it; no postorder is put on top. Found once and kept."""
    from ferrule.operators import matrix

    coo = coo if perm is None else matrix.permute(coo.select("i", "j"), perm)

    def run(batches):
        i, j = gathered(batches, "i", "j")
        cols = columns_of(n, i, j)
        del i, j
        parent = etree(cols)
        cc, rc = counts(cols, parent)
        yield from given_back({"j": np.arange(n), "parent": parent, "cc": cc, "rc": rc}, {"parent": -1})

    return checkpointed(in_one_task(coo.where("i <> j").select("i", "j"), run, "j long, parent long, cc long, rc long"))


def fundamental(columns: DataFrame, max_size: int = 0) -> DataFrame:
    """sid, fc, lc, width of the fundamental supernodes of ``columns``: a column joins the one before it by a join, and runs are numbered in two levels."""
    before = columns.select((F.col("j") + 1).alias("j"), F.col("parent").alias("_p"), F.col("cc").alias("_c"))
    same = (F.col("_p") == F.col("j")) & (F.col("_c") == F.col("cc") + 1)
    flagged = columns.select("j", "cc").join(before, "j", "left").select("j", F.when(same, 0).otherwise(1).alias("_new"))
    run = prefix_sum(flagged, "j", "_new", "_before").withColumn("_run", F.col("_before") + F.col("_new"))
    if max_size:
        first = run.groupBy("_run").agg(F.min("j").alias("_first"))
        run = run.join(first, "_run").withColumn("_part", F.floor((F.col("j") - F.col("_first")) / max_size))
    else:
        run = run.withColumn("_part", F.lit(0))
    own = run.groupBy("_run", "_part").agg(F.min("j").alias("fc"), F.max("j").alias("lc"), F.count(F.lit(1)).alias("width"))
    return prefix_sum(own.withColumn("_one", F.lit(1)), "fc", "_one", "sid").select(F.col("sid").cast("long").alias("sid"), "fc", "lc", "width")


def statistics(columns: DataFrame) -> DataFrame:
    """nnz and flops of the factor."""
    return columns.agg(F.sum("cc").alias("nnz"), F.sum(F.col("cc") * F.col("cc")).alias("flops"))


def blocks(lstruct: DataFrame, snode: DataFrame) -> DataFrame:
    """sid, tgt, first_row, n_rows: maximal runs of consecutive rows of a supernode inside one target supernode."""
    rows = lstruct.select("sid", F.explode("rows").alias("row"))
    owner = snode.select(F.col("sid").alias("tgt"), F.explode(F.sequence("fc", "lc")).alias("row"))
    order = W.partitionBy("sid", "tgt").orderBy("row")
    run = rows.join(owner, "row").withColumn("_g", F.col("row") - F.row_number().over(order))
    return run.groupBy("sid", "tgt", "_g").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n_rows")).drop("_g")


def block_statistics(blocks: DataFrame, snode: DataFrame) -> DataFrame:
    """One row: how many cells (supernode, target) and blocks (maximal runs of rows in a cell) there are, and their mean sizes."""
    sized = blocks.join(snode.select("sid", "width"), "sid")
    wide = snode.agg(F.count(F.lit(1)).alias("supernodes"), F.sum("width").alias("columns"))
    own = sized.agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("sid", "tgt").alias("cells"), F.sum("n_rows").alias("_rows"), F.sum(F.col("n_rows") * F.col("width")).alias("_nnz"))
    return own.crossJoin(wide).select(  # a row each
        "supernodes", "cells", "blocks", (F.col("blocks") / F.col("supernodes")).alias("blocks_per_supernode"), (F.col("blocks") / F.col("columns")).alias("blocks_per_column"),
        (F.col("_rows") / F.col("cells")).alias("rows_per_cell"), (F.col("_nnz") / F.col("blocks")).alias("entries_per_block"),
    )


def update_counts(blocks: DataFrame, snode: DataFrame) -> DataFrame:
    """For each supernode that is updated: by how many others, in how many blocks, the most rows that one brings, and the widest and tallest of them."""
    per = blocks.where("sid <> tgt").groupBy("sid", "tgt").agg(F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("n"))
    return per.join(snode.select("sid", "width", "height"), "sid").groupBy("tgt").agg(F.count(F.lit(1)).alias("updates"), F.sum("n").alias("blocks"), F.max("rows").alias("max_rows"), F.max("width").alias("max_width"), F.max("height").cast("long").alias("max_height"))


def aggregate_counts(blocks: DataFrame, owner: DataFrame) -> DataFrame:
    """For each supernode with updates from elsewhere: aggregates it gets if every process adds up its own updates first, and single updates if none does.
    ``owner``: sid, process."""
    pair = blocks.where("sid <> tgt").select("sid", "tgt").distinct().join(owner.select("sid", F.col("process").alias("_from")), "sid").join(owner.select(F.col("sid").alias("tgt"), F.col("process").alias("_to")), "tgt")
    return pair.groupBy("tgt").agg(F.count_if(F.col("_from") != F.col("_to")).alias("updates"), F.countDistinct(F.when(F.col("_from") != F.col("_to"), F.col("_from"))).alias("aggregates"))


class Reach:
    """Which supernodes each one updates, as ranges of them: pairs aren't written out, of which the natural order of a grid has its side a column.

    ``sid``, ``first``, ``last``: a range of targets for each run of rows below a supernode's own columns. Where two runs of a supernode end and begin in
    one target, ``again`` has that target, and ``again_sid`` the supernode, once for each run after the first."""

    def __init__(self, xsuper: np.ndarray, rows: Runs):
        ns = len(xsuper) - 1
        self.ns, self.xsuper = ns, xsuper
        owner = np.repeat(np.arange(ns, dtype=np.int32), np.diff(xsuper))
        sid = np.repeat(np.arange(ns, dtype=np.int32), np.diff(rows.ptr))
        start = np.maximum(rows.start, xsuper[1:][sid]).astype(np.int32)
        keep = start < rows.end
        self.sid, self.start, self.end = sid[keep], start[keep], rows.end[keep]
        self.first, self.last = owner[self.start], owner[self.end - 1]
        more = (self.sid[1:] == self.sid[:-1]) & (self.first[1:] == self.last[:-1])
        self.again, self.again_sid = self.first[1:][more], self.sid[1:][more]

    def cover(self, of: np.ndarray | None = None) -> np.ndarray:
        """How many runs reach each target; ``of``: of these runs."""
        first, last = (self.first, self.last) if of is None else (self.first[of], self.last[of])
        return np.cumsum(np.bincount(first, minlength=self.ns + 1) - np.bincount(last.astype(np.int64) + 1, minlength=self.ns + 1))[: self.ns]

    def sources(self, process: np.ndarray | None = None, p: int = 0) -> np.ndarray:
        """How many supernodes (of process ``p``) update each target."""
        of, twice = (None, self.again) if process is None else (process[self.sid] == p, self.again[process[self.again_sid] == p])
        return self.cover(of) - np.bincount(twice, minlength=self.ns)

    def greatest(self, value: np.ndarray) -> np.ndarray:
        """The greatest ``value`` (of each supernode) among those that update a target; 0 if none does. A range is two that overlap, of a power of two
        targets, and those are halved down to single ones."""
        power = np.frexp((self.last - self.first + 1).astype(float))[1] - 1
        best = np.zeros(self.ns, np.int64)
        for k in range(int(power.max(initial=-1)), -1, -1):
            at, of = power == k, value[self.sid]
            np.maximum.at(best, self.first[at], of[at])
            np.maximum.at(best, self.last[at] - (1 << k) + 1, of[at])
            if k:
                half = 1 << (k - 1)
                lower = best.copy()
                lower[half:] = np.maximum(lower[half:], best[: self.ns - half])
                best = lower
        return best

    def most_rows(self) -> np.ndarray:
        """The most rows that one supernode has in a target: all, where a run passes over it; what runs have at their ends is added up."""
        begin, finish, wide = self.xsuper[:-1], self.xsuper[1:], np.diff(self.xsuper)
        out = np.zeros(self.ns, np.int64)
        inner = self.last - self.first > 1
        d = np.bincount(self.first[inner] + 1, minlength=self.ns + 1)[: self.ns + 1] - np.bincount(self.last[inner], minlength=self.ns + 1)[: self.ns + 1]
        out[np.cumsum(d)[: self.ns] > 0] = wide[np.cumsum(d)[: self.ns] > 0]
        two = self.last > self.first
        sid = np.concatenate([self.sid, self.sid[two]])
        tgt = np.concatenate([self.first, self.last[two]])
        n = np.concatenate([np.minimum(self.end, finish[self.first]) - self.start, self.end[two] - begin[self.last[two]]])
        key = sid.astype(np.int64) * self.ns + tgt
        by = np.argsort(key, kind="stable")
        key, n = key[by], n[by]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if len(key):
            np.maximum.at(out, key[new] % self.ns, np.add.reduceat(n, new))
        return out


def _reached(structure: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the ``Reach`` of ``structure`` (sid, fc, width, height, starts, ends), in one task; gives named arrays of all supernodes, those with
    updates are kept."""

    def task(batches):
        parts: dict[str, list] = {k: [] for k in ("sid", "width", "starts", "ends", "runs")}
        for b in batches:
            for k in ("sid", "width"):
                parts[k].append(b.column(k).to_numpy(zero_copy_only=False).astype(np.int32))
            for k in ("starts", "ends"):
                parts[k].append(b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int32))
            parts["runs"].append(b.column("starts").value_lengths().to_numpy(zero_copy_only=False).astype(np.int32))
        sid, width, start, end, runs = (np.concatenate([*parts.pop(k), np.zeros(0, np.int32)]) for k in ("sid", "width", "starts", "ends", "runs"))
        by = np.argsort(sid)
        before = np.append(0, np.cumsum(runs))
        at = expanded(before[:-1][by], before[1:][by])
        x = np.append(0, np.cumsum(width[by], dtype=np.int64))
        rows = Runs(np.append(0, np.cumsum(runs[by])), start[at], end[at])
        del start, end, at, before
        out = {"tgt": np.arange(len(sid))} | run(Reach(x, rows), np.diff(x), rows.heights())
        keep = out["blocks"] > 0
        yield from given_back({k: v[keep] for k, v in out.items() if k in schema.split()})

    return in_one_task(structure.select("sid", "width", "starts", "ends"), task, schema)


def updates_reached(structure: DataFrame) -> DataFrame:
    """As ``update_counts``, from supernodes with their runs of rows, whose memory it needs."""

    def run(r: Reach, width: np.ndarray, height: np.ndarray) -> dict:
        return {"updates": r.sources(), "blocks": r.cover(), "max_rows": r.most_rows(), "max_width": r.greatest(width), "max_height": r.greatest(height)}

    return _reached(structure, run, "tgt long, updates long, blocks long, max_rows long, max_width long, max_height long")


def aggregates_reached(structure: DataFrame, processes: int) -> DataFrame:
    """As ``aggregate_counts``, with supernodes dealt out to ``processes`` in turn."""

    def run(r: Reach, width: np.ndarray, height: np.ndarray) -> dict:
        process = np.arange(r.ns, dtype=np.int32) % processes
        updates, aggregates = np.zeros(r.ns, np.int64), np.zeros(r.ns, np.int64)
        for p in range(processes):
            n = r.sources(process, p) * (process != p)
            updates += n
            aggregates += n > 0
        return {"updates": updates, "aggregates": aggregates, "blocks": r.cover()}

    return _reached(structure, run, "tgt long, updates long, aggregates long")


def statistics_reached(structure: DataFrame) -> DataFrame:
    """As ``block_statistics``: a supernode's own columns are a cell and a block."""
    found = updates_reached(structure).agg(F.coalesce(F.sum("updates"), F.lit(0)).alias("_cells"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("_blocks"))
    whole = structure.agg(F.count(F.lit(1)).alias("supernodes"), F.sum("width").alias("columns"), F.sum("height").alias("_rows"), F.sum(F.col("height") * F.col("width")).alias("_nnz"))
    both = whole.crossJoin(found).withColumn("cells", F.col("supernodes") + F.col("_cells")).withColumn("blocks", F.col("supernodes") + F.col("_blocks"))  # a row each
    return both.select(
        "supernodes", "cells", "blocks", (F.col("blocks") / F.col("supernodes")).alias("blocks_per_supernode"), (F.col("blocks") / F.col("columns")).alias("blocks_per_column"),
        (F.col("_rows") / F.col("cells")).alias("rows_per_cell"), (F.col("_nnz") / F.col("blocks")).alias("entries_per_block"),
    )
