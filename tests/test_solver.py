"""DataFrame operators and the distributed solver against dense algebra and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ferrule.functions.basic import process_map
from ferrule.operators import factor, matrix, ordering
from ferrule.plans import catalog
from ferrule.plans.solver import Options, SymMatrix
from ferrule.sources import readers
from ferrule.sources.fixtures import exact_solution, part_grid, part_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["spmm", "permute_reversed", "elimination_tree", "fundamental_supernodes", "solve_ll_distributed", "solve_ldl_distributed", "map_modwrap2d", "residual_of_half", "factor_reconstruction_ldl_cells", "file_harwell_boeing", "file_text", "file_binary_csc", "order_rcm", "update_counts", "block_statistics", "relative_order", "is_permuted"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def dense(spark, a):
    i, j = np.nonzero(np.tril(a))
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "i long, j long, v double")


@pytest.mark.parametrize("a", [np.array([[4.0]]), np.diag([1.0, 2.0, 3.0]), np.array([[2e-8, 1e-8], [1e-8, 3e-8]])])
def test_small(spark, a):
    n = len(a)
    m = SymMatrix(dense(spark, a), n)
    x = m.solve(matrix.multiply(m.coo, exact_solution(spark, n, 2)), 2)
    assert all(abs(r["v"] - (1 if (r["i"] * 2 + r["k"]) % 2 == 0 else -1)) < 1e-9 for r in x.collect())
    assert abs(m.logdet() - np.linalg.slogdet(a)[1]) < 1e-9


def test_refuses(spark):
    bad = np.array([[1.0, 2.0], [2.0, 1.0]])
    with pytest.raises(Exception, match="not positive definite"):
        SymMatrix(dense(spark, bad), 2).factorize().panels.count()
    assert SymMatrix(dense(spark, bad), 2, Options(fact="LDL")).factorize().inertia().first()[:] == (1, 1)
    with pytest.raises(ValueError):
        Options(fact="QR")
    with pytest.raises(ValueError):
        ordering.user(spark.createDataFrame([(0, 0), (0, 1)], "old long, new long"))
    with pytest.raises(ValueError):
        matrix.validate(spark.createDataFrame([(0, 1, 1.0)], "i long, j long, v double"), 2)


def test_orderings_are_in_the_result(spark):
    coo, n = part_grid(spark, SF)
    i, j = (np.array(x) for x in zip(*((r["i"], r["j"]) for r in coo.collect()), strict=True))
    got = {}
    for name in ("mmd", "amd", "rcm", "nd", "ndgrid", "ndbox"):
        rows = sorted(map(tuple, catalog.QUERIES[f"perm_{name}"](spark, SF).select("new", "old").collect()))
        assert [new for new, _ in rows] == sorted(old for _, old in rows) == list(range(n))
        got[name] = [old for _, old in rows]
        assert got[name] == ordering.order_array(name.upper(), n, i, j).tolist() != list(range(n))
    assert got["mmd"] != got["rcm"] != got["ndgrid"]


def test_unknown_names_are_refused(spark):
    for name in ("MODWRAP2DTREE", "ROW", ""):
        with pytest.raises(ValueError, match="unknown process map"):
            process_map(name, F.col("i"), F.col("j"), 16)
    for wrong in ({"ordering": "XYZ"}, {"refine": "SET10"}, {"fact": "QR"}):
        with pytest.raises(ValueError, match="unknown"):
            Options(**wrong)
    both = np.array([[2.0, 1], [1, 2]])
    i, j = np.nonzero(both)
    with pytest.raises(ValueError, match="outside"):
        SymMatrix(spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(i, j, strict=True)], "i long, j long, v double"), 2).analyse()
    with pytest.raises(ValueError, match="not a permutation"):
        SymMatrix(dense(spark, both), 2).analyse(spark.createDataFrame([(0, 0), (2, 1)], "old long, new long"))
    assert SymMatrix(dense(spark, both), 2).solve(spark.createDataFrame([], "i long, k int, v double"), 0).count() == 0


@pytest.mark.parametrize(("fact", "cell", "limit"), [("LL", 4, 0.0), ("LDL", 4, 60.0), ("LDL", 7, 300.0), ("LL", 64, 0.0)])
def test_cells_equal_dense_algebra(spark, fact, cell, limit):
    r = np.random.RandomState(cell)
    a = np.tril(r.rand(50, 50) < 0.08, -1) * r.randn(50, 50)
    a = a + a.T + np.diag(r.choice([-1.0, 1.0], 50) if fact == "LDL" else np.ones(50)) * (1 + np.abs(a + a.T).sum(1))
    m = SymMatrix(dense(spark, a), 50, Options(ordering="ND", fact=fact, cell=cell, limit=limit)).factorize()
    b = r.randn(50, 2)
    rhs = spark.createDataFrame([(i, k, float(b[i, k])) for i in range(50) for k in range(2) if i != 3], "i long, k int, v double")  # row 3 has none: zero
    b[3] = 0
    x = np.zeros((50, 2))
    for row in m.solve(rhs).collect():
        x[row["i"], row["k"]] += row["v"]
    assert np.allclose(a @ x, b)
    new = {row["old"]: row["new"] for row in m.perm.collect()}
    p = np.argsort([new[k] for k in range(50)])
    l, d = np.zeros((50, 50)), np.ones(50)
    for row in m.factor_coo().collect():
        l[row["i"], row["j"]] = row["v"]
    if fact == "LDL":
        d = np.array([row["v"] for row in sorted(factor.diagonal(m.factor).collect(), key=lambda row: row["j"])])
        assert m.inertia().first()[:] == ((np.linalg.eigvalsh(a) > 0).sum(), (np.linalg.eigvalsh(a) < 0).sum())
    assert np.allclose((l * d) @ l.T, a[np.ix_(p, p)]) and abs(m.logdet() - np.linalg.slogdet(a)[1]) < 1e-8
    assert abs(factor.block_dump(m.factor).agg({"square": "sum"}).first()[0] - (l * l).sum()) < 1e-6


def test_harwell_boeing_variants(spark, tmp_path):
    def read(name, text, **more):
        (tmp_path / name).write_text(text)
        coo, n = readers.read_matrix(spark, str(tmp_path / name), "RB", **more)
        return n, sorted(map(tuple, coo.collect()))

    want = (2, [(0, 0, 2.0), (1, 0, -1.0), (1, 1, 3.0)])
    ptr, row = "   1   3   4\n", "   1   2   2\n"
    assert read("real", f"title\n 3 1 1 1 0\nRSA 2 2 3 0\n(3I4) (3I4) (3E12.4)\n{ptr}{row}  2.0000D+00 -1.0000E+00  3.0000E+00\n") == want
    assert read("rhs", f"title\n 3 1 1 1 1\nRSA 2 2 3 0\n(3I4) (3I4) (1P,3E12.4)\nF 1 0\n{ptr}{row}  2.0000E+00 -1.0000E+00  3.0000E+00\n".replace("(1P,3E12.4)", "(3E12.4)")) == want
    assert read("pattern", f"title\n 2 1 1 0 0\nPSA 2 2 3 0\n(3I4) (3I4)\n{ptr}{row}") == (2, [(0, 0, 1.0), (1, 0, 1.0), (1, 1, 1.0)])
    complex_ = f"title\n 3 1 1 2 0\nCSA 2 2 3 0\n(3I4) (3I4) (4E8.1)\n{ptr}{row} 2.0E+00 0.0E+00-1.0E+00 0.0E+00\n 3.0E+00 4.0E+00\n"
    assert read("complex", complex_) == want
    assert read("abs", complex_, use_abs=True) == (2, [(0, 0, 2.0), (1, 0, 1.0), (1, 1, 5.0)])
    assert read("whole", "t\n 3 1 1 1 0\nRUA 2 2 4 0\n(3I4) (4I4) (4E8.1)\n   1   3   5\n   1   2   1   2\n 2.0E+00-1.0E+00-1.0E+00 3.0E+00\n") == want
    with pytest.raises(ValueError, match="neither"):
        read("odd", "t\n 3 1 1 1 0\nRUA 3 3 5 0\n(4I4) (5I4) (5E8.1)\n   1   4   5   6\n   1   2   3   1   3\n 2.0E+00-1.0E+00-1.0E+00-1.0E+00 3.0E+00\n")


def test_lines_and_words_of_split_files(spark, tmp_path):
    from ferrule.functions.scan import numbered_lines, numbered_words

    text = [f"{k} " * (k % 7) for k in range(3000)]
    (tmp_path / "f").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = numbered_lines(spark, str(tmp_path / "f"))
        assert lines.select("at").distinct().count() > 5
        assert [r["value"] for r in sorted(lines.collect(), key=lambda r: r["line"])] == text
        words = sorted(map(tuple, numbered_words(lines).collect()))
        assert [w for _, w in words] == " ".join(text).split() and [p for p, _ in words] == list(range(len(words)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_matrix_market_round_trip(spark, tmp_path):
    a = np.array([[2.0, -1, 0], [-1, 2, -1], [0, -1, 2]])
    readers.write_matrix_market(dense(spark, a), 3, f"{tmp_path}/m")
    coo, n = readers.read_matrix(spark, f"{tmp_path}/m", "mm")
    assert n == 3 and sorted(map(tuple, coo.collect())) == sorted(map(tuple, dense(spark, a).collect()))
    same, n = readers.from_csc(spark, [1, 3, 5, 6], [1, 2, 2, 3, 3], [2.0, -1, 2, -1, 2])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, coo.collect()))


def test_path_is_one_at_a_million_parts(spark, tmp_path):
    """Over so many rows, two evaluations of a range partitioning don't number its partitions alike."""
    parts = spark.range(0, 1_200_000, 1, 12).select(F.col("id").alias("p_partkey"), (1 + F.pmod(F.xxhash64("id"), F.lit(50))).cast("int").alias("p_size"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    coo, n = part_path(spark, str(tmp_path))
    edges = coo.where("i <> j")
    ends = edges.select("i").unionByName(edges.select(F.col("j").alias("i"))).groupBy("i").count().groupBy("count").count()
    assert n == 1_200_000 and sorted(map(tuple, ends.collect())) == [(1, 2), (2, n - 2)]


@pytest.mark.parametrize(("fact", "cell", "limit"), [("LL", 4, 0.0), ("LDL", 7, 300.0)])
def test_tiers_and_levels_of_the_top_give_the_same(spark, fact, cell, limit):
    """A task has whole parts of the top: a tier is one job, and there are fewer tiers than levels."""
    r = np.random.RandomState(cell)
    a = np.tril(r.rand(60, 60) < 0.06, -1) * r.randn(60, 60)
    a = a + a.T + np.diag(1 + np.abs(a + a.T).sum(1))
    b = spark.createDataFrame([(i, k, float(r.randn())) for i in range(60) for k in range(3)], "i long, k int, v double")
    got = []
    for tiers in (True, False):
        m = SymMatrix(dense(spark, a), 60, Options(ordering="ND", fact=fact, cell=cell, limit=limit, tiers=tiers)).factorize()
        l = {(row["i"], row["j"]): row["v"] for row in m.factor_coo().where("abs(v) > 1e-12").collect()}
        got.append((m.factor.top.depth, l, {(row["i"], row["k"]): row["v"] for row in m.solve(b, 3).collect()}))
    (few, l, x), (many, l2, x2) = got
    assert few < many and l.keys() == l2.keys() and x.keys() == x2.keys()
    assert all(abs(l[k] - l2[k]) < 1e-9 for k in l) and all(abs(x[k] - x2[k]) < 1e-9 for k in x)


@pytest.mark.parametrize(("fact", "cell", "panel"), [("LL", 4, 12), ("LDL", 5, 20), ("LL", 8, 64), ("LDL", 4, 1)])
def test_thin_supernodes_of_the_top_go_together(spark, fact, cell, panel):
    """Panels of several blocks are one step each, and give what dense algebra does."""
    r = np.random.RandomState(panel)
    a = np.tril(r.rand(60, 60) < 0.1, -1) * r.randn(60, 60)
    a = a + a.T + np.diag(r.choice([-1.0, 1.0], 60) if fact == "LDL" else np.ones(60)) * (1 + np.abs(a + a.T).sum(1))
    m = SymMatrix(dense(spark, a), 60, Options(ordering="ND", fact=fact, cell=cell, limit=0.0, max_size=2, tiers=False, panel=panel)).factorize()
    steps = m.plan.agg({"step": "max"}).first()[0]
    assert m.factor.top.depth <= (steps if panel < 4 else steps // 2)
    b = r.randn(60, 2)
    x = np.zeros((60, 2))
    for row in m.solve(spark.createDataFrame([(i, k, float(b[i, k])) for i in range(60) for k in range(2)], "i long, k int, v double")).collect():
        x[row["i"], row["k"]] += row["v"]
    assert np.allclose(a @ x, b)
    new = {row["old"]: row["new"] for row in m.perm.collect()}
    p = np.argsort([new[k] for k in range(60)])
    found = np.zeros((60, 60))
    i, j = np.tril_indices(60)
    for row in factor.product(m.factor, spark.createDataFrame([(int(c), int(d)) for c, d in zip(i, j, strict=True)], "i long, j long")).collect():
        found[row["i"], row["j"]] = row["v"]
    assert np.allclose(found, np.tril(a[np.ix_(p, p)]))


def test_rows_of_cells_are_read_some_at_a_time(spark):
    """A reader decodes up to 4096 rows together unless row groups are smaller: of the largest cells, 2 GB."""
    import pyarrow.parquet as pq

    a = np.diag(np.full(120, 9.0)) + np.diag(np.full(119, -1.0), -1)
    m = SymMatrix(dense(spark, a), 120, Options(ordering="ND", cell=2, limit=0.0)).factorize()
    held = type(m.factor.top.cells)(spark, m.factor.top.cells.schema, "cells", 5)
    held.add(m.factor.top.cells.every().coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in held.every().inputFiles()]
    sizes = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(sizes) == m.factor.top.cells.every().count() > 50 and max(sizes) <= 5
    assert m.factor.top.cells.together * m.options.cell**2 * 8 <= 16_000_000


@pytest.mark.parametrize("options", [{"fact": "LDL", "cell": 8}, {"cell": 8, "tiers": False}])
def test_products_at_a_pattern(spark, options):
    """Entries of the pattern come back whether they lie in subtrees, in parts of the top or in what goes level by level."""
    coo, n = part_grid(spark, SF)
    m = SymMatrix(coo, n, Options(ordering="ND", limit=2000.0, max_size=8, **options)).analyse()
    assert m.plan.where("step > 0").where("part < 0" if "tiers" in options else "part >= 0").count() > 1
    m.factorize()
    want = {(r["i"], r["j"]): r["v"] for r in matrix.permute(coo, m.perm).collect()}
    found = factor.product(m.factor, matrix.permute(coo.select("i", "j"), m.perm))
    got = [(r["i"], r["j"], r["v"]) for r in found.collect()]
    assert len(got) == len(want)
    assert all(abs(want[i, j] - v) < 1e-12 for i, j, v in got)


def test_reconstruction_takes_no_factor_apart(spark, monkeypatch):
    def refused(f):
        raise AssertionError("the factor is taken apart into entries")

    monkeypatch.setattr(factor, "to_coo", refused)
    assert catalog.QUERIES["factor_reconstruction"](spark, SF).columns == ["i", "j", "v"]
