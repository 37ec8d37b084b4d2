"""``SymMatrix``: analyse, factorize, solve."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import cells, factor, matrix, ordering, symbolic
from ferrule.operators.store import checkpointed, gathered, in_one_task
from ferrule.plans import mapping


@dataclass(frozen=True)
class Options:
    ordering: str = "MMD"
    fact: str = "LL"
    max_size: int = 150
    relaxed: bool = True
    refine: str | None = None
    slots: int | None = None  # tasks at a time; None: the session's
    limit: float | None = None  # operations of a subtree that is one task; None: see mapping.cut
    cell: int = cells.SIZE  # side of the cells above the subtrees
    refinement_steps: int = 0
    tiers: bool = True  # whether tasks have whole parts of the top; if not, all of it goes level by level
    panel: int | None = None  # columns of the top that are one step where it goes level by level; None: cells.PANEL cells, or with no tiers a supernode

    def __post_init__(self):
        for name, value, known in (("factorization", self.fact, ("LL", "LDL")), ("refinement", self.refine, (None, *symbolic.REFINEMENTS)), ("ordering", self.ordering, ordering.NAMES)):
            if value not in known:
                raise ValueError(f"unknown {name} {value}")


_STRUCTURE = "old array<long>, sid long, fc long, width long, height long, starts array<long>, ends array<long>, parent long"
_PLAN = _STRUCTURE + ", grp long, step long, nnz long, flops long, top long, part long, levels array<long>, trows array<long>"


class SymMatrix:
    def __init__(self, coo: DataFrame, n: int, options: Options | None = None):
        self.coo, self.n, self.options = coo, n, options or Options()
        self.plan = self.factor = None

    @classmethod
    def from_csc(cls, spark: SparkSession, colptr, rowind, nzval, options: Options | None = None, base: int | None = None):
        from ferrule.sources.readers import from_csc

        coo, n = from_csc(spark, colptr, rowind, nzval, base)
        return cls(coo, n, options)

    def analyse(self, perm: DataFrame | None = None) -> SymMatrix:
        """The symbolic phase, in one task on an executor; ``perm`` replaces the ordering."""
        slots = self.options.slots or self.coo.sparkSession.sparkContext.defaultParallelism
        self.plan = checkpointed(self._analysed(perm, slots, _PLAN))
        return self

    def structured(self) -> SymMatrix:
        """The symbolic phase without its division into tasks: ``perm``, ``structure`` and the supernodes, but no factor."""
        self.plan = checkpointed(self._analysed(None, 0, _STRUCTURE))
        return self

    def _analysed(self, perm: DataFrame | None, slots: int, schema: str) -> DataFrame:
        o, n = self.options, self.n
        matrix.validate(self.coo, n)
        given = self.coo.select(F.lit(0).alias("kind"), "i", "j")
        if perm is not None:
            perm = ordering.user(perm, n)
            given = given.unionByName(perm.select(F.lit(1).alias("kind"), F.col("old").alias("i"), F.col("new").alias("j")))

        def run(batches):
            kind, i, j = gathered(batches, "kind", "i", "j")
            order = None
            if kind.any():
                order = np.empty(n, np.int32)
                order[j[kind == 1]] = i[kind == 1]
                i, j = i[kind == 0], j[kind == 0]
            del kind
            s = symbolic.analyse_arrays(n, i, j, o.ordering, order, o.max_size or (cells.PANEL * o.cell if slots else 0), o.relaxed, o.refine)
            del i, j
            x, rows, cc = s["xsuper"], s["rows"], s["cc"].astype(np.int64)
            width, height = np.diff(x), rows.heights()
            sums = [np.add.reduceat(v, x[:-1]) if len(width) else v for v in (cc, cc * cc)]
            del s["rc"], s["cc"], s["parent"], cc
            plan = {}
            if slots:
                grp, step = mapping.cut(s["sparent"], width, height, slots, o.limit)
                grp = mapping.bundles(grp, step, width, height, slots)
                tier, part = mapping.tiers(s["sparent"], width, height, step, slots) if o.tiers else (np.full(len(width), -1),) * 2
                most = (cells.PANEL * o.cell if o.tiers else 0) if o.panel is None else o.panel
                tier, part = mapping.panels(s["sparent"], width, step, tier, part, most)
                top, levels, trows = mapping.block_levels(rows, width, step, o.cell, tier, part)
                plan = {"grp": grp, "step": step, "nnz": sums[0], "flops": sums[1], "top": top, "part": part, "levels": levels, "trows": trows}
            plan = {"sid": np.arange(len(width)), "fc": x[:-1], "width": width, "height": height, "parent": s["sparent"]} | plan
            lists = {"old": (x, s["order"]), "starts": (rows.ptr, rows.start), "ends": (rows.ptr, rows.end)}
            names = [c.split()[0] for c in schema.split(", ")]
            for a in range(0, len(width), 4096):
                b = min(a + 4096, len(width))
                part = {k: pa.array(v[a:b], pa.list_(pa.int64())) if k in ("levels", "trows") else pa.array(np.asarray(v[a:b], np.int64)) for k, v in plan.items()}
                for k, (ptr, values) in lists.items():
                    part[k] = pa.ListArray.from_arrays(pa.array((ptr[a : b + 1] - ptr[a]).astype(np.int32)), pa.array(values[ptr[a] : ptr[b]].astype(np.int64)))
                yield pa.record_batch([part[k] for k in names], names=names)

        return in_one_task(given, run, schema)

    @property
    def perm(self) -> DataFrame:
        return self.plan.select("fc", F.posexplode("old").alias("at", "old")).select("old", (F.col("fc") + F.col("at")).alias("new"))

    @property
    def supernodes(self) -> DataFrame:
        return self.plan.select("sid", "fc", (F.col("fc") + F.col("width") - 1).alias("lc"), "width", "height", "parent", *(c for c in ("grp", "step") if c in self.plan.columns))

    @property
    def structure(self) -> DataFrame:
        return self.plan.select("sid", symbolic.rows_of("starts", "ends").alias("rows"))

    def factorize(self) -> SymMatrix:
        if self.plan is None:
            self.analyse()
        self.factor = factor.factorize(matrix.permute(self.coo, self.perm), self.plan.withColumn("rows", symbolic.rows_of("starts", "ends")), self.options.fact == "LDL", self.options.cell)
        return self

    def solve(self, b: DataFrame, nrhs: int | None = None) -> DataFrame:
        """x(i, k, v) for b(i, k, v), in the matrix's own numbering; the factor is kept for further calls."""
        if self.factor is None:
            self.factorize()
        nrhs = (b.agg(F.max("k")).first()[0] or 0) + 1 if nrhs is None else nrhs
        if not nrhs:  # no right-hand side: nothing is solved
            return b.select("i", "k", "v").limit(0)
        x = self._solve(b, nrhs)
        for _ in range(self.options.refinement_steps):
            r = matrix.axpy(-1.0, matrix.multiply(self.coo, x), b)
            x = checkpointed(matrix.axpy(1.0, self._solve(r, nrhs), x))
        return x

    def _solve(self, b: DataFrame, nrhs: int) -> DataFrame:
        x = factor.solve(self.factor, matrix.permute_rows(b, self.perm), nrhs)
        return x.join(self.perm, x["i"] == F.col("new")).select(F.col("old").alias("i"), "k", "v")

    def logdet(self) -> float:
        scale = 1.0 if self.options.fact == "LDL" else 2.0
        return float(factor.diagonal(self.factor).agg(F.sum(F.log(F.abs("v"))) * scale).first()[0])

    def inertia(self) -> DataFrame:
        """Numbers of positive and negative pivots of LDL'."""
        return factor.diagonal(self.factor).agg(F.count_if(F.col("v") > 0).alias("positive"), F.count_if(F.col("v") < 0).alias("negative"))

    def factor_coo(self) -> DataFrame:
        return factor.to_coo(self.factor)

    def with_options(self, **changes) -> SymMatrix:
        return SymMatrix(self.coo, self.n, replace(self.options, **changes))
