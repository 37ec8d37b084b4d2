"""The array kernels against dense algebra."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.functions.basic import DisjointSet, common_divisor, parse_size
from ferrule.operators import dense, factor, ordering, symbolic
from ferrule.plans import mapping
from ferrule.sources import readers


def random_matrix(n: int, seed: int, density: float = 0.15):
    r = np.random.RandomState(seed)
    a = np.tril(r.rand(n, n) < density, -1) * -r.rand(n, n)
    a = a + a.T
    return a + np.diag(1 + np.abs(a).sum(1))


def fill(a: np.ndarray) -> np.ndarray:
    s = a != 0
    for k in range(len(a)):
        below = np.flatnonzero(s[k + 1 :, k]) + k + 1
        s[np.ix_(below, below)] = True
    return np.tril(s)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 30), st.integers(0, 10**6), st.sampled_from(["NATURAL", "MMD", "AMD", "RCM", "ND", "NDGRID", "NDBOX"]))
def test_symbolic_matches_elimination(n, seed, method):
    a = random_matrix(n, seed)
    i, j = np.nonzero(np.tril(a))
    s = symbolic.analyse_arrays(n, i, j, method, max_size=4)
    assert sorted(s["order"].tolist()) == list(range(n))
    f = fill(a[np.ix_(s["order"], s["order"])])
    assert s["cc"].tolist() == f.sum(0).tolist() and s["rc"].tolist() == f.sum(1).tolist()
    parent = [next((r for r in range(c + 1, n) if f[r, c]), -1) for c in range(n)]
    assert s["parent"].tolist() == parent
    for k, rows in enumerate(s["rows"]):
        need = np.flatnonzero(f[:, s["xsuper"][k] : s["xsuper"][k + 1]].any(1))
        assert set(need) <= set(rows.tolist())


@pytest.mark.parametrize("ldl", [False, True])
def test_front_and_errors(ldl):
    a = random_matrix(12, 3, 0.5)
    panel, d, rest = factor.factor_front(np.tril(a), 5, 0, ldl)
    l = panel * (np.sqrt(d) if ldl else 1)
    assert np.allclose(l @ l.T + np.pad(np.tril(rest) + np.tril(rest, -1).T, ((5, 0), (5, 0))), a)
    with pytest.raises(ValueError, match="column 7"):
        factor.factor_front(np.zeros((1, 1)), 1, 7, ldl)


@pytest.mark.parametrize("method", ["SET", "TSPB"])
def test_refinement_stays_inside_supernodes(method):
    a = random_matrix(40, 5)
    i, j = np.nonzero(np.tril(a))
    s = symbolic.analyse_arrays(40, i, j, "MMD")
    order = symbolic.refine(s["xsuper"], s["rows"], method)
    for a, b in zip(s["xsuper"][:-1], s["xsuper"][1:], strict=True):
        assert sorted(order[a:b].tolist()) == list(range(a, b))


def test_cut_runs_children_first():
    sparent = np.array([2, 2, 6, 5, 5, 6, -1])
    grp, step = mapping.cut(sparent, np.full(7, 3), np.array([6, 6, 6, 6, 6, 6, 3]), 1, limit=200.0)
    for s, p in enumerate(sparent.tolist()):
        assert p < 0 or grp[s] == grp[p] or step[s] < step[p]
    assert mapping.balance(np.array([5, 4, 3, 2]), 2).tolist() == [0, 1, 1, 0]
    assert all(0 <= a < b <= 4 for a, b in mapping.proportional(sparent, np.full(7, 3.0), 4))


def test_orderings_reduce():
    n, m = 100, 10
    i = [k + 1 for k in range(n) if k % m != m - 1] + [k + m for k in range(n - m)]
    j = [k for k in range(n) if k % m != m - 1] + list(range(n - m))
    i, j = np.array(i), np.array(j)
    size = {x: symbolic.analyse_arrays(n, i, j, x)["cc"].sum() for x in ("NATURAL", "MMD", "AMD", "ND", "NDGRID")}
    assert all(size[x] < size["NATURAL"] for x in ("MMD", "AMD", "NDGRID"))
    new = np.argsort(ordering.order_array("RCM", n, i, j))
    assert np.abs(new[i] - new[j]).max() <= 2 * m


def test_basic():
    assert [parse_size(x) for x in ("7", "2k", "1m", "3b")] == [7, 2048, 1 << 20, 3]
    assert common_divisor([12, 18]) == 6 and common_divisor([]) == 0
    d = DisjointSet(4)
    d.union(0, 1), d.union(2, 3), d.union(1, 3)
    assert len({d.find(x) for x in range(4)}) == 1


def test_binary_parser():
    want = [(0, 0, 2.0), (1, 0, -1.0), (1, 1, 3.0)]
    rows = lambda p: list(p[["i", "j", "v"]].itertuples(index=False, name=None))
    i4 = lambda *x: np.array(x, "<i4").tobytes()
    raw = i4(2, 3, 3) + i4(1, 3, 4) + i4(3) + i4(1, 2, 2) + i4(3)
    assert rows(readers.parse_binary_csc(raw + np.array([2.0, -1.0, 3.0]).tobytes())) == want
    values = np.array([2.0, -1.0, 3 + 4j])
    assert rows(readers.parse_binary_csc(raw + values.tobytes(), True))[2] == (1, 1, 5.0) and rows(readers.parse_binary_csc(raw + values.tobytes(), True, False)) == want


@pytest.mark.parametrize("n", [1, 31, 33, 100])
def test_dense_kernels(n):
    a = random_matrix(n, n, 0.4)
    names = np.arange(n)
    l = dense.cholesky(a, names)
    b = np.random.RandomState(0).randn(n, 3)
    assert np.allclose(l @ dense.triangular_solve(l, b), b) and np.allclose(l.T @ dense.triangular_solve(l, b, True), b)
    assert np.allclose(dense.triangular_inverse(l) @ l, np.eye(n))
    u, d = dense.ldl(a - 2 * np.diag(np.arange(n) % 2) * a.diagonal(), names)
    assert np.allclose((u * d) @ u.T, a - 2 * np.diag(np.arange(n) % 2) * a.diagonal()) and np.allclose(np.tril(u), u)


def test_block_levels_rise_along_the_factor():
    for seed in range(6):
        a = random_matrix(60, seed, 0.06)
        i, j = np.nonzero(np.tril(a))
        s = symbolic.analyse_arrays(60, i, j, "ND", max_size=5, relaxed=False)
        width = np.diff(s["xsuper"])
        height = np.array([len(r) for r in s["rows"]])
        grp, step = mapping.cut(s["sparent"], width, height, 2, limit=60.0)
        first, levels, above = mapping.block_levels(s["rows"], width, step, 4)
        number, level = {}, {}
        for k in np.flatnonzero(step > 0):
            for at in range(width[k]):
                number[s["xsuper"][k] + at] = first[k] + at
                level[(first[k] + at) // 4] = levels[k][at]
        assert len(set(number.values())) == len(number)
        for k in np.flatnonzero(step > 0):
            assert len({number[s["xsuper"][k] + at] // 4 for at in range(width[k])}) == -(-width[k] // 4)
        f = fill(a[np.ix_(s["order"], s["order"])])
        for c in number:
            for r in np.flatnonzero(f[:, c]):
                x, y = number[c] // 4, number[int(r)] // 4
                assert x == y or level[x] < level[y]
        for k in np.flatnonzero(step == 0):
            if above[k] is not None:
                assert above[k].tolist() == [number[int(r)] for r in s["rows"][k][width[k] :]]


def test_panels_hold_chains():
    """A chain of thin supernodes is as many steps as its panels; a panel waits for those below it alone."""
    sparent = np.append(np.arange(1, 40), -1)
    none = np.full(40, -1)
    tier, part = mapping.panels(sparent, np.full(40, 150), np.arange(1, 41), none, none, 2048)
    assert tier.tolist() == [k // 13 for k in range(40)] and len(np.unique(part)) == 4 and (part < -1).all() and (part % 2 == 0).all()
    tree = np.array([2, 2, 6, 5, 5, 6, -1])
    tier, part = mapping.panels(tree, np.full(7, 3), np.array([0, 1, 2, 1, 1, 2, 3]), np.full(7, -1), np.full(7, -1), 9)
    assert tier.tolist() == [-1, 0, 0, 0, 0, 0, 1] and part[1] == part[2] != part[3] == part[4] == part[5] != part[6] and part[0] == -1


def test_balancers_and_tree_map():
    sparent = np.array([2, 2, 6, 5, 5, 6, -1])
    rows = [np.array(x) for x in ([0, 2], [1, 2, 6], [2, 6], [3, 5], [4, 5, 6], [5, 6], [6])]
    width = np.ones(7, np.int64)
    to, by = (mapping.update_costs(rows, width, np.arange(7), fan_in=x) for x in (False, True))
    assert to.tolist() == [0, 0, 2 + 4, 0, 0, 2 + 4, 2 + 2 + 2 + 2] and by.tolist() == [2, 4 + 2, 2, 2, 4 + 2, 2, 0]
    for kind in mapping.BALANCERS:
        owner = mapping.assign(kind, sparent, rows, width, 3)
        assert len(owner) == 7 and set(owner.tolist()) <= {0, 1, 2}
    with pytest.raises(ValueError):
        mapping.assign("OTHER", sparent, rows, width, 3)
    assert mapping.find_least(np.array([5.0, 1.0, 0.5]), [0, 1]) == 1
    owner = np.array([0, 1, 0, 2, 2, 2, 1])
    # the subtree of 2 is 0..2: block (2, 2) is at its place 2 of 3 on a grid of 2
    # (2, 2): place min(2, 0 + 2 * 1); (1, 2): place min(2, 1 + 2 * 1), of supernodes 0, 1, 2
    assert mapping.tree_map(sparent, owner, np.array([2, 1]), np.array([2, 2])).tolist() == [owner[2], owner[2]]
    assert mapping.tree_map(sparent, owner, np.array([0]), np.array([0])).tolist() == [0]


def grid_pattern(n: int):
    m = int(np.ceil(n**0.5))
    k = np.arange(n)
    right, down = k[(k % m != m - 1) & (k + 1 < n)], k[k + m < n]
    return np.concatenate([right + 1, down + m]), np.concatenate([right, down])


def peak_per_node(n: int, run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / n
    finally:
        tracemalloc.stop()


def test_symbolic_phase_holds_few_bytes_a_column():
    """Some numbers a column, not Python objects; and no row lists, which in the natural order have the side of the grid in each."""
    n = 10_000
    i, j = grid_pattern(n)

    def fill_counts():
        cols = symbolic.columns_of(n, i, j)
        symbolic.counts(cols, symbolic.etree(cols))

    assert peak_per_node(n, fill_counts) < 250
    assert peak_per_node(n, lambda: symbolic.analyse_arrays(n, i, j, "NATURAL", max_size=0, relaxed=False)) < 400


@pytest.mark.parametrize("method", ["NATURAL", "MMD", "ND"])
def test_updates_are_counted_from_runs_of_rows(method):
    """Against single pairs of supernodes; a grid in its own order has runs, and pairs by the side of the grid as many."""
    for seed in range(12):
        n = 5 + 9 * seed
        i, j = np.nonzero(np.tril(random_matrix(n, seed, 0.05)))
        s = symbolic.analyse_arrays(n, i, j, method, max_size=6 * (seed % 2), relaxed=bool(seed % 2))
        width, height = np.diff(s["xsuper"]), s["rows"].heights()
        owner, ns = np.repeat(np.arange(len(width)), width), len(width)
        held: dict = {}
        for k, rows in enumerate(s["rows"]):
            for c in rows[width[k] :].tolist():
                held.setdefault((k, int(owner[c])), []).append(c)
        want = np.zeros((7, ns), np.int64)
        for (k, t), c in held.items():
            want[0, t] += 1
            want[1, t] += 1 + sum(b != a + 1 for a, b in zip(c, c[1:], strict=False))
            for row, x in ((2, len(c)), (3, width[k]), (4, height[k])):
                want[row, t] = max(want[row, t], x)
            want[5, t] += k % 3 == 1
        r = symbolic.Reach(s["xsuper"], s["rows"])
        got = [r.sources(), r.cover(), r.most_rows(), r.greatest(width), r.greatest(height), r.sources(np.arange(ns) % 3, 1)]
        assert all((a == b).all() for a, b in zip(got, want, strict=False))
    n = 2500
    s = symbolic.analyse_arrays(n, *grid_pattern(n), "NATURAL", max_size=0, relaxed=False)
    assert len(s["rows"].start) < 3 * n and s["rows"].heights().sum() > 40 * n


@pytest.mark.parametrize("method", ["MMD", "AMD", "RCM", "ND"])
def test_orderings_hold_few_bytes_a_node(method):
    n = 10_000
    i, j = grid_pattern(n)
    assert peak_per_node(n, lambda: ordering.order_array(method, n, i, j)) < 400


@pytest.mark.parametrize("method", ["MMD", "AMD"])
def test_leaves_go_at_once_and_leave_trees_without_fill(method, monkeypatch):
    for many in (1, 5, 1024):
        monkeypatch.setattr(ordering, "MANY", many)
        for seed in range(8):
            r = np.random.RandomState(seed)
            n = 2 + 40 * seed
            i, j = np.arange(1, n), np.array([r.randint(0, k) for k in range(1, n)])
            new = np.argsort(ordering.order_array(method, n, i, j))
            cols = symbolic.columns_of(n, np.maximum(new[i], new[j]), np.minimum(new[i], new[j]))
            assert symbolic.counts(cols, symbolic.etree(cols))[0].sum() == 2 * n - 1


def test_a_chain_is_few_steps():
    """In the natural order the tree is a chain, as deep as it has supernodes; what fits one task is one step."""
    n = 120_000
    height = np.minimum(411, 64 * np.arange(n // 64, 0, -1))
    width, sparent = np.full(len(height), 64), np.append(np.arange(1, len(height)), -1)
    grp, step = mapping.cut(sparent, width, height, 12)
    assert step.max() == 0 and len(set(grp.tolist())) == 1
    grp, step = mapping.cut(sparent, np.full(len(height), 640), height + 640, 12)  # ten times the entries aren't one task's
    assert (640 * (height + 640))[step == 0].sum() <= mapping.WHOLE and step.max() > 1000
    stars = np.append(np.full(100_000, 100_000), -1)
    one = np.ones(len(stars), np.int64)
    grp, step = mapping.cut(stars, one, one + 1, 2)
    assert np.bincount(mapping.bundles(np.arange(len(stars)), np.zeros(len(stars), np.int64), one, one + 1, 1)).max() <= mapping.SUPERNODES


def test_panels_are_given_back_as_they_are_made(monkeypatch):
    """A task holds some panels at a time, not all of its subtrees'."""
    n = 400
    i, j = grid_pattern(n)
    s = symbolic.analyse_arrays(n, i, j, "NATURAL")
    width, owner = np.diff(s["xsuper"]), np.repeat(np.arange(len(s["xsuper"]) - 1), np.diff(s["xsuper"]))
    meta = pd.DataFrame({"sid": np.arange(len(width)), "fc": s["xsuper"][:-1], "width": width, "rows": list(s["rows"]), "parent": s["sparent"], "trows": None})
    data = pd.DataFrame({"sid": owner[np.append(j, np.arange(n))], "i": np.append(i, np.arange(n)), "j": np.append(j, np.arange(n)), "v": np.append(np.full(len(i), -1.0), np.full(n, 5.0))})
    frame = pd.concat([meta, data])
    whole = pd.concat(factor._factor_group(False, 256)((0,), iter([frame])))
    monkeypatch.setattr(factor, "GIVEN", 500)
    parts = list(factor._factor_group(False, 256)((0,), iter([frame[:3], frame[3:]])))
    assert len(parts) > 5 and max(len(p) for p in parts) < len(width) / 2
    assert all(np.array_equal(a, b) for a, b in zip(whole["nzval"], pd.concat(parts)["nzval"], strict=True))


@pytest.mark.parametrize("refinement", [None, *symbolic.REFINEMENTS])
def test_leaves_of_a_star_are_one_supernode(refinement):
    leaves, stars = 9, 4
    j = np.concatenate([s * (leaves + 1) + np.arange(leaves) for s in range(stars)])
    i = np.repeat(np.arange(stars) * (leaves + 1) + leaves, leaves)
    n = stars * (leaves + 1)
    s = symbolic.analyse_arrays(n, i, j, "NATURAL", refinement=refinement)
    assert np.diff(s["xsuper"]).tolist() == [leaves + 1] * stars
    assert [s["rows"][k].tolist() for k in range(stars)] == [list(range(k * (leaves + 1), (k + 1) * (leaves + 1))) for k in range(stars)]
    assert len(symbolic.analyse_arrays(n, i, j, "NATURAL", relaxed=False)["xsuper"]) - 1 == stars * leaves  # a last leaf and its centre are one as they are
