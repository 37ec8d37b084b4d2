"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.basic import panel_flops, process_map
from ferrule.operators import factor, matrix, ordering, symbolic
from ferrule.operators.store import shared_path
from ferrule.plans.solver import Options, SymMatrix
from ferrule.sources import readers
from ferrule.sources.fixtures import GRID_SQL, central_stars, dirichlet_grid, exact_solution, order_stars, part_grid, part_path

QUERIES: dict = {}
SQL: dict[str, str] = {}
_R = lambda c: F.round(c, 6) + F.lit(0.0)
_X = "CASE WHEN (p.k * {n} + r.k) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def _grid(body: str) -> str:
    return f"WITH RECURSIVE {GRID_SQL} {body}"


@query(_grid("SELECT i, j, round(v, 6) + 0.0 AS v FROM coo"))
def grid_matrix(spark, d):
    return part_grid(spark, d)[0].select("i", "j", _R("v").alias("v"))


@query(_grid("SELECT i, j, round(v, 6) + 0.0 AS v FROM sym"))
def expand_symmetric(spark, d):
    return matrix.expand(part_grid(spark, d)[0]).select("i", "j", _R("v").alias("v"))


@query(_grid("SELECT i, j, round(v, 6) + 0.0 AS v FROM sym WHERE i >= j"))
def lower_triangle(spark, d):
    return matrix.lower(matrix.expand(part_grid(spark, d)[0])).select("i", "j", _R("v").alias("v"))


@query(_grid("SELECT i AS node, sum(CASE WHEN i <> j THEN 1 ELSE 0 END)::BIGINT AS degree FROM sym GROUP BY i"))
def degrees(spark, d):
    return matrix.degree(part_grid(spark, d)[0])


@query(_grid("SELECT count(DISTINCT j)::BIGINT AS columns, count(*)::BIGINT AS entries FROM coo"))
def matrix_counts(spark, d):
    return matrix.counts(part_grid(spark, d)[0])


@query(_grid("SELECT j, string_agg(i::VARCHAR, ',' ORDER BY i) AS \"rows\" FROM coo GROUP BY j"))
def column_structure(spark, d):
    return matrix.structure(part_grid(spark, d)[0]).select("j", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


@query(_grid("SELECT greatest(n1, n2) AS i, least(n1, n2) AS j, round(v, 6) + 0.0 AS v FROM (SELECT (SELECT count(*) FROM part) - 1 - i AS n1, (SELECT count(*) FROM part) - 1 - j AS n2, v FROM coo)"))
def permute_reversed(spark, d):
    coo, n = part_grid(spark, d)
    perm = spark.range(n).select(F.col("id").alias("old"), (n - 1 - F.col("id")).alias("new"))
    return matrix.permute(coo, perm).select("i", "j", _R("v").alias("v"))


@query(_grid("SELECT i + 1 AS i, j + 1 AS j, round(v, 6) + 0.0 AS v FROM coo WHERE i <> j"))
def off_diagonal_from_one(spark, d):
    return matrix.set_base(matrix.without_diagonal(part_grid(spark, d)[0]), 1).select("i", "j", _R("v").alias("v"))


@query(_grid("SELECT sym.i, round(sum(v * CASE WHEN sym.j % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END), 6) + 0.0 AS v FROM sym GROUP BY sym.i"))
def spmv(spark, d):
    coo, n = part_grid(spark, d)
    return matrix.multiply(coo, exact_solution(spark, n, 1)).select("i", _R("v").alias("v"))


@query(_grid("SELECT sym.i, r.k, round(sum(v * CASE WHEN (sym.j * 3 + r.k) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END), 6) + 0.0 AS v FROM sym, (SELECT unnest([0, 1, 2]) AS k) r GROUP BY sym.i, r.k"))
def spmm(spark, d):
    coo, n = part_grid(spark, d)
    return matrix.multiply(coo, exact_solution(spark, n, 3)).select("i", "k", _R("v").alias("v"))


@query(_grid("SELECT round(sqrt(sum(v * v)), 6) + 0.0 AS norm FROM sym"))
def frobenius_norm(spark, d):
    return matrix.frobenius(part_grid(spark, d)[0]).select(_R("norm").alias("norm"))


@query(_grid(", b AS (SELECT sym.i, sum(v * (1 - 2 * (sym.j % 2))) AS v FROM sym GROUP BY sym.i), y AS (SELECT sym.i, sum(v * (0.5::DOUBLE - sym.j % 2)) AS v FROM sym GROUP BY sym.i) SELECT round(sqrt(sum((y.v - b.v) * (y.v - b.v))) / sqrt(sum(b.v * b.v)), 6) + 0.0 AS residual FROM y JOIN b USING (i)"))
def residual_of_half(spark, d):
    coo, n = part_grid(spark, d)
    x = exact_solution(spark, n, 1)
    b = matrix.multiply(coo, x)
    half = x.withColumn("v", F.col("v") / 2)
    return matrix.residual(coo, half, b).select(_R("residual").alias("residual"))


def _solve(method: str, fact: str, nrhs: int = 1, **more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        coo, n = part_grid(spark, d)
        coo = coo.repartition("j")
        x = SymMatrix(coo, n, Options(ordering=method, fact=fact, **more)).solve(matrix.multiply(coo, exact_solution(spark, n, nrhs)), nrhs)
        return x.select("i", F.col("k").cast("int").alias("k"), _R("v").alias("v"))

    return run


def _solution_sql(nrhs: int) -> str:
    return f"SELECT p_partkey AS i, r.k, {_X.format(n=nrhs).replace('p.k', 'p_partkey')} AS v FROM part, (SELECT unnest(range({nrhs}))::INTEGER AS k) r"


for _m in ("NATURAL", "MMD", "AMD", "RCM", "NDGRID", "NDBOX", "ND"):
    query(_solution_sql(1), f"solve_ll_{_m.lower()}")(_solve(_m, "LL"))
for _m in ("METIS", "PARMETIS", "SCOTCH", "PTSCOTCH"):
    query(_solution_sql(1), f"solve_ll_{_m.lower()}")(_solve(_m, "LL"))
query(_solution_sql(3), "solve_ll_mmd_rhs3")(_solve("MMD", "LL", 3))
query(_solution_sql(3), "solve_ldl_amd_rhs3")(_solve("AMD", "LDL", 3))
query(_solution_sql(1), "solve_ll_distributed")(_solve("ND", "LL", limit=20_000.0))
query(_solution_sql(2), "solve_ldl_distributed")(_solve("ND", "LDL", 2, limit=50_000.0))
query(_solution_sql(1), "solve_refined_set")(_solve("MMD", "LL", refine="SET"))
query(_solution_sql(1), "solve_refined_tspb")(_solve("MMD", "LL", refine="TSPB"))
query(_solution_sql(1), "solve_with_refinement")(_solve("RCM", "LL", refinement_steps=1))


@query("SELECT p_partkey AS i, round(p_retailprice, 4) + 0.0 AS v FROM part")
def solve_prices(spark, d):
    """A x for the x that solves A x = price."""
    coo, n = part_grid(spark, d)
    b = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.lit(0).alias("k"), F.col("p_retailprice").alias("v"))
    x = SymMatrix(coo, n).solve(b, 1)
    return matrix.multiply(coo, x).select("i", (F.round("v", 4) + F.lit(0.0)).alias("v"))


def _reconstruction(**options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """L L' or L D L' on the matrix's own pattern, back in its own numbering."""
        coo, n = part_grid(spark, d)
        a = SymMatrix(coo, n, Options(**options)).factorize()
        product = factor.product(a.factor, matrix.permute(coo.select("i", "j"), a.perm))
        return matrix.permute(product, ordering.inverse(a.perm)).select("i", "j", _R("v").alias("v"))

    return run


_COO = _grid("SELECT i, j, round(v, 6) + 0.0 AS v FROM coo")
query(_COO, "factor_reconstruction")(_reconstruction())
query(_COO, "factor_reconstruction_ldl")(_reconstruction(fact="LDL"))
query(_COO, "factor_reconstruction_cells")(_reconstruction(ordering="ND", limit=20_000.0, cell=32))
query(_COO, "factor_reconstruction_ldl_cells")(_reconstruction(ordering="ND", fact="LDL", limit=20_000.0, cell=48))


_FILL = """, r(s, x) AS (SELECT j, i FROM sym WHERE i <> j UNION SELECT r.s, sym.i FROM r JOIN sym ON sym.j = r.x WHERE r.x < r.s AND sym.i <> sym.j),
f AS (SELECT s AS j, x AS i FROM r WHERE x > s),
c AS (SELECT p.k AS j, min(f.i) AS parent, 1 + count(f.i) AS cc, (SELECT count(*) + 1 FROM f g WHERE g.i = p.k) AS rc FROM p LEFT JOIN f ON f.j = p.k GROUP BY p.k)"""


@query(_grid(_FILL + " SELECT j, parent, cc::BIGINT AS cc, rc::BIGINT AS rc FROM c"))
def elimination_tree(spark, d):
    coo, n = part_grid(spark, d)
    return symbolic.columns(coo, n)


@query(_grid(_FILL + " SELECT sum(cc)::BIGINT AS nnz, sum(cc * cc)::BIGINT AS flops FROM c"))
def factor_size(spark, d):
    coo, n = part_grid(spark, d)
    return symbolic.statistics(symbolic.columns(coo, n))


@query(_grid(_FILL + """, t AS (SELECT *, CASE WHEN lag(parent) OVER (ORDER BY j) = j AND lag(cc) OVER (ORDER BY j) = cc + 1 THEN 0 ELSE 1 END AS first FROM c),
u AS (SELECT *, sum(first) OVER (ORDER BY j) AS g FROM t)
SELECT row_number() OVER (ORDER BY min(j)) - 1 AS sid, min(j) AS fc, max(j) AS lc, count(*) AS width FROM u GROUP BY g"""))
def fundamental_supernodes(spark, d):
    coo, n = part_grid(spark, d)
    return symbolic.fundamental(symbolic.columns(coo, n))


@query("SELECT positive::BIGINT AS positive, negative::BIGINT AS negative, shift FROM (SELECT s.shift, sum(CASE WHEN 4 - 2 * cos(pi() * a.i / 21) - 2 * cos(pi() * b.i / 21) > s.shift THEN 1 ELSE 0 END) AS positive, sum(CASE WHEN 4 - 2 * cos(pi() * a.i / 21) - 2 * cos(pi() * b.i / 21) < s.shift THEN 1 ELSE 0 END) AS negative FROM range(1, 21) a(i), range(1, 21) b(i), (SELECT unnest([0.5::DOUBLE, 1.7::DOUBLE, 3.3::DOUBLE]) AS shift) s GROUP BY s.shift)")
def inertia(spark, d):
    out = None
    for shift in (0.5, 1.7, 3.3):
        coo, n = dirichlet_grid(spark, 20, shift)
        one = SymMatrix(coo, n, Options(fact="LDL")).factorize().inertia().withColumn("shift", F.lit(shift))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT i, CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS v FROM (SELECT unnest(range((SELECT max(o_orderkey) - min(o_orderkey) + 1 + max(o_custkey) + 1 FROM orders))) AS i)")
def solve_stars(spark, d):
    coo, n = order_stars(spark, d)
    coo = coo.repartition("j")
    x = SymMatrix(coo, n, Options(ordering="NATURAL")).solve(matrix.multiply(coo, exact_solution(spark, n, 1)), 1)
    return x.select("i", _R("v").alias("v"))


@query(_grid("SELECT k AS old, k AS new FROM p"))
def compose_with_inverse(spark, d):
    coo, n = part_grid(spark, d)
    perm = ordering.order(coo, n, "RCM")
    return ordering.compose(perm, ordering.inverse(perm))


def _less_fill(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Whether the ordering is one of all nodes, and its factor smaller than that of the natural one, whose size is given."""
        coo, n = part_grid(spark, d)
        perm = factor.checkpointed(ordering.order(coo, n, method))
        natural = symbolic.statistics(symbolic.columns(coo, n)).select(F.col("nnz").alias("nnz_natural"))
        own = symbolic.statistics(symbolic.columns(coo, n, perm)).select("nnz")
        whole = perm.agg(F.countDistinct("old").alias("olds"), F.countDistinct("new").alias("news"), F.max("new").alias("high"))
        return whole.crossJoin(natural).crossJoin(own).select("olds", "news", "high", "nnz_natural", (F.col("nnz") < F.col("nnz_natural")).alias("is_less"))  # a row each

    return run


_TEST_FILL = "SELECT count(*)::BIGINT AS olds, count(*)::BIGINT AS news, (count(*) - 1)::BIGINT AS high, sum(cc)::BIGINT AS nnz_natural, true AS is_less FROM c"
for _m in ("MMD", "AMD", "ND", "NDGRID"):
    query(_grid(_FILL + _TEST_FILL), f"order_{_m.lower()}")(_less_fill(_m))
for _m in ("MMD", "AMD", "RCM", "ND", "NDGRID", "NDBOX"):
    # the ordering itself, which SQL can't express
    query(None, f"perm_{_m.lower()}")(lambda spark, d, m=_m: ordering.order(*part_grid(spark, d), m).select("old", "new"))


def _star_fill(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Entries of the factor of a forest whose centres are numbered first: orderings by degree leave no fill."""
        coo, n = central_stars(spark, d)
        return symbolic.statistics(symbolic.columns(coo, n, ordering.order(coo, n, method))).select("nnz")

    return run


for _m in ("MMD", "AMD"):
    query("SELECT (count(*) + (SELECT max(o_orderkey) - min(o_orderkey) + 1 + max(o_custkey) + 1 FROM orders))::BIGINT AS nnz FROM orders", f"fill_of_stars_{_m.lower()}")(_star_fill(_m))


@query("SELECT 1::BIGINT AS bandwidth, (2 * count(*) - 1)::BIGINT AS entries FROM part")
def order_rcm(spark, d):
    """The bandwidth that the ordering leaves of a path through scattered nodes: one."""
    coo, n = part_path(spark, d)
    found = matrix.permute(coo, ordering.order(coo, n, "RCM"))
    return found.agg(F.max(F.col("i") - F.col("j")).alias("bandwidth"), F.count(F.lit(1)).alias("entries"))


def _moved(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    ids = spark.range(n).withColumnRenamed("id", "old")
    return ids.select("old", (n - 1 - F.col("old")).alias("new")), ids.select("old", ((F.col("old") + 7) % n).alias("new"))


@query(_grid("SELECT k AS old, (n - 1 - k + 7) % n AS new FROM p"))
def compose_orders(spark, d):
    return ordering.compose(*_moved(spark, part_grid(spark, d)[1]))


@query(_grid("SELECT n - 1 - k AS old, (k + 7) % n AS new FROM p"))
def relative_order(spark, d):
    return ordering.relative(*_moved(spark, part_grid(spark, d)[1]))


@query(_grid("SELECT k AS old, (k + 7) % n AS new FROM p"))
def user_order(spark, d):
    """A caller's numbering from 1, checked and moved to 0."""
    n = part_grid(spark, d)[1]
    one = _moved(spark, n)[1].select((F.col("old") + 1).alias("old"), (F.col("new") + 1).alias("new"))
    return ordering.user(one, n)


@query("SELECT true AS is_permuted, false AS other")
def is_permuted(spark, d):
    coo, n = part_grid(spark, d)
    one, other = _moved(spark, n)
    there = matrix.permute(coo, one)
    return matrix.is_permuted(coo, one, there).crossJoin(matrix.is_permuted(coo, other, there).select(F.col("is_permuted").alias("other")))  # a row each


@query(_grid("SELECT i, j, CASE WHEN i = j THEN 0.0::DOUBLE ELSE round(v, 6) + 0.0 END AS v FROM coo"))
def with_diagonal(spark, d):
    coo, n = part_grid(spark, d)
    return matrix.with_diagonal(matrix.without_diagonal(coo), n).select("i", "j", _R("v").alias("v"))


def _file(fmt: str, write, name: str = ""):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Written to the shared folder in this format, and read back."""
        coo, n = part_grid(spark, d)
        path = shared_path(spark, fmt.lower())
        write(coo, n, path)
        got, size = readers.read_matrix(spark, path + name, fmt)
        if size != n:
            raise ValueError(f"{size} columns of {n}")
        return got.select("i", "j", _R("v").alias("v"))

    return run


query(_COO, "file_harwell_boeing")(_file("HB", readers.write_harwell_boeing))
query(_COO, "file_rutherford_boeing")(_file("RB", lambda coo, n, path: readers.write_harwell_boeing(coo, n, path, "rb")))
query(_COO, "file_binary_csc")(_file("CSC", readers.write_binary_csc, "/matrix.csc"))
query(_COO, "file_text")(_file("matrix", readers.write_text))
query(_COO, "file_matrix_market")(_file("mm", readers.write_matrix_market))
query(_COO, "file_parquet")(_file("parquet", lambda coo, n, path: coo.write.parquet(path)))


@query(_COO)
def file_matlab(spark, d):
    path = shared_path(spark, "matlab")
    readers.matlab_text(part_grid(spark, d)[0]).write.text(path)
    x = F.split("value", " ")
    back = spark.read.text(path).select(x[0].cast("long").alias("i"), x[1].cast("long").alias("j"), x[2].cast("double").alias("v"))
    return matrix.set_base(back, -1).select("i", "j", _R("v").alias("v"))


_MAPS = {"ROW2D": "i % 16", "COL2D": "j % 16", "ANTIDIAG2D": "(i + j) % 16", "WRAP2D": "i % 4 + 4 * (j % 4)", "WRAP2DFORCED": "CASE WHEN i = j THEN j % 16 ELSE i % 4 + 4 * (j % 4) END", "MODWRAP2D": "least(i, j) % 4 + 4 * (CAST(floor(greatest(i, j) / 4) AS BIGINT) % 4)", "MODWRAP2DNS": "i % 4 + 4 * (CAST(floor(j / 4) AS BIGINT) % 4)"}
for _k, _s in _MAPS.items():
    query(_grid(f"SELECT ({_s})::BIGINT AS process, count(*)::BIGINT AS blocks FROM coo GROUP BY 1"), f"map_{_k.lower()}")(
        lambda spark, d, k=_k: part_grid(spark, d)[0].groupBy(process_map(k, F.col("i"), F.col("j"), 16).cast("long").alias("process")).agg(F.count(F.lit(1)).alias("blocks"))
    )


_SNODE = _FILL + """, t AS (SELECT *, CASE WHEN lag(parent) OVER (ORDER BY j) = j AND lag(cc) OVER (ORDER BY j) = cc + 1 THEN 0 ELSE 1 END AS first FROM c),
u AS (SELECT *, sum(first) OVER (ORDER BY j) AS g FROM t),
s AS (SELECT row_number() OVER (ORDER BY min(j)) - 1 AS sid, min(j) AS fc, max(j) AS lc, count(*) AS width FROM u GROUP BY g),
h AS (SELECT s.sid, f.i AS x FROM s JOIN f ON f.j = s.fc UNION ALL SELECT sid, fc FROM s),
o AS (SELECT h.sid, w.sid AS tgt, h.x, h.x - row_number() OVER (PARTITION BY h.sid, w.sid ORDER BY h.x) AS g FROM h JOIN s w ON h.x BETWEEN w.fc AND w.lc),
b AS (SELECT sid, tgt, count(*) AS n_rows FROM o GROUP BY sid, tgt, g),
e AS (SELECT s.sid, any_value(s.width) AS width, count(*) AS height, min(w.sid) FILTER (WHERE h.x > s.lc) AS parent FROM s JOIN h ON h.sid = s.sid JOIN s w ON h.x BETWEEN w.fc AND w.lc GROUP BY s.sid)
"""


def _fundamental(spark: SparkSession, d: str) -> SymMatrix:
    """The grid in its own order, with supernodes as they are: neither cut nor relaxed."""
    coo, n = part_grid(spark, d)
    return SymMatrix(coo, n, Options(ordering="NATURAL", relaxed=False, max_size=0)).structured()


@query(_grid(_SNODE + "SELECT sid, width::BIGINT AS width, height::INTEGER AS height, coalesce(parent, -1) AS parent, round(width * width * width / 3.0 + width * width * (height - width) + width * (height - width) * (height - width), 3) + 0.0::DOUBLE AS cost FROM e"))
def supernode_plan(spark, d):
    cost = panel_flops(F.col("width").cast("double"), F.col("height").cast("double"))
    return _fundamental(spark, d).supernodes.select("sid", "width", F.col("height").cast("int").alias("height"), "parent", (F.round(cost, 3) + F.lit(0.0)).alias("cost"))


@query(_grid(_SNODE + "SELECT (SELECT count(*) FROM s)::BIGINT AS supernodes, count(DISTINCT (sid, tgt))::BIGINT AS cells, count(*)::BIGINT AS blocks, round(count(*) / (SELECT count(*) FROM s), 6) + 0.0::DOUBLE AS blocks_per_supernode, round(count(*) / (SELECT sum(width) FROM s), 6) + 0.0::DOUBLE AS blocks_per_column, round(sum(n_rows) / count(DISTINCT (sid, tgt)), 6) + 0.0::DOUBLE AS rows_per_cell, round(sum(n_rows * width) / count(*), 6) + 0.0::DOUBLE AS entries_per_block FROM b JOIN (SELECT sid, width FROM s) USING (sid)"))
def block_statistics(spark, d):
    found = symbolic.statistics_reached(_fundamental(spark, d).plan)
    return found.select("supernodes", "cells", "blocks", *(_R(c).alias(c) for c in ("blocks_per_supernode", "blocks_per_column", "rows_per_cell", "entries_per_block")))


@query(_grid(_SNODE + "SELECT tgt, count(*)::BIGINT AS updates, sum(n)::BIGINT AS blocks, max(r)::BIGINT AS max_rows, max(width)::BIGINT AS max_width, max(height)::BIGINT AS max_height FROM (SELECT sid, tgt, sum(n_rows) AS r, count(*) AS n FROM b WHERE sid <> tgt GROUP BY sid, tgt) JOIN e USING (sid) GROUP BY tgt"))
def update_counts(spark, d):
    return symbolic.updates_reached(_fundamental(spark, d).plan)


@query(_grid(_SNODE + "SELECT tgt, count(*) FILTER (WHERE sid % 4 <> tgt % 4)::BIGINT AS updates, count(DISTINCT sid % 4) FILTER (WHERE sid % 4 <> tgt % 4)::BIGINT AS aggregates FROM (SELECT DISTINCT sid, tgt FROM b WHERE sid <> tgt) GROUP BY tgt"))
def aggregate_counts(spark, d):
    """With supernodes dealt out to four processes in turn."""
    return symbolic.aggregates_reached(_fundamental(spark, d).plan, 4)


@query(_grid("SELECT k AS i, 0::INTEGER AS k, CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS v FROM p"))
def axpy_of_solution(spark, d):
    _, n = part_grid(spark, d)
    x = exact_solution(spark, n, 1)
    return matrix.axpy(-0.5, x, x)


@query(_grid("SELECT i, j, 0.0::DOUBLE AS v FROM coo"))
def pattern_copy(spark, d):
    return matrix.copy_pattern(part_grid(spark, d)[0])
