import numpy as np
import pytest

from tensorloom.operators import linalg as L

RNG = np.random.default_rng(0)
A = RNG.standard_normal((6, 4))
S = RNG.standard_normal((5, 5))
T = RNG.standard_normal((4, 3, 5))


@pytest.mark.parametrize("a", [A, A.T, S, np.zeros((3, 3)), np.array([[0.0, 1], [2, 3]])])
def test_lu(a):
    p, low, up = L.lu(a)
    assert np.allclose(p @ low @ up, a) and np.allclose(np.tril(low), low) and np.allclose(np.triu(up), up)


def test_cholesky_needs_symmetry():
    m = S @ S.T + np.eye(5)
    assert np.allclose(L.cholesky(m) @ L.cholesky(m).T, m)
    with pytest.raises(ValueError):
        L.cholesky(S)


def test_norms():
    assert np.isclose(L.l2_norm(np.array([3.0, 4.0])), 5) and np.isclose(L.l2_norm(np.diag([3.0, 4.0])), 4)
    assert np.isclose(L.nuclear_norm(np.diag([3.0, -4.0])), 7)
    with pytest.raises(ValueError):
        L.l2_norm(T)


def test_unfold_fold_and_mode_product():
    for k in range(3):
        assert np.allclose(L.fold(L.unfold(T, k), k, T.shape), T)
        m = RNG.standard_normal((2, T.shape[k]))
        assert np.allclose(L.unfold(L.mode_product(T, m, k), k), m @ L.unfold(T, k))


def test_cp_recovers_low_rank():
    factors = [RNG.random((d, 2)) for d in (4, 3, 5)]
    t = L.from_cp(factors)
    assert np.allclose(t, np.einsum("ir,jr,kr->ijk", *factors))
    assert np.linalg.norm(L.from_cp(L.cp(t, 2, 500)) - t) < 1e-3 * np.linalg.norm(t)
    own = L.cp(t, 2, 3000, nonnegative=True)
    assert all((f >= 0).all() for f in own) and np.linalg.norm(L.from_cp(own) - t) < 0.05 * np.linalg.norm(t)
    with pytest.raises(ValueError):
        L.cp(-t, 2, nonnegative=True)


def test_exact_decompositions():
    assert np.allclose(L.from_tucker(*L.tucker(T, [4, 3, 5])), T) and np.allclose(L.from_tucker(*L.hosvd(T)), T)
    assert np.allclose(L.from_train(L.tensor_train(T, 20)), T)
    assert np.allclose(L.from_train(L.tensor_ring(T, 20, 2)), T) and np.allclose(L.from_train(L.tensor_ring(T, 20)), T)
    assert np.allclose(L.from_hierarchical(L.hierarchical_tucker(T, 20), T.shape), T)
    terms = L.block_terms(T, [(2, 2, 2), (4, 3, 5)])
    assert np.allclose(sum(L.from_tucker(*t) for t in terms), T)
    with pytest.raises(ValueError):
        L.tucker(T, [5, 3, 5])


def test_nonnegative_tucker():
    t = np.abs(T)
    core, factors = L.tucker(t, [3, 3, 3], 60, nonnegative=True)
    assert (core >= 0).all() and all((f >= 0).all() for f in factors)
    assert np.linalg.norm(L.from_tucker(core, factors) - t) < 0.6 * np.linalg.norm(t)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_t_svd(depth):
    a = RNG.standard_normal((4, 3, depth))
    u, s, v = L.t_svd(a)
    assert np.allclose(L.t_product(L.t_product(u, s), L.t_transpose(v)), a)


@pytest.mark.parametrize("mode", ["full", "valid", "same"])
def test_convolution(mode):
    x, w = RNG.standard_normal(9), RNG.standard_normal(4)
    want = {"full": np.convolve(x, w), "valid": np.convolve(x, w, "valid"), "same": np.convolve(x, w)[1:-1]}[mode]
    assert np.allclose(L.convolve(x, w, mode), want)
    image, kernel = RNG.standard_normal((6, 5)), RNG.standard_normal((3, 2))
    full = sum(kernel[a, b] * np.pad(image, ((a, 2 - a), (b, 1 - b))) for a in range(3) for b in range(2))
    assert np.allclose(L.convolve(image, kernel, "full"), full)
    assert L.convolve(RNG.standard_normal((4, 4, 4)), np.ones((2, 2, 2)), "valid").shape == (3, 3, 3)


def test_gradient_and_jacobian():
    x = RNG.standard_normal((2, 3))
    assert np.allclose(L.gradient(lambda v: (v**2).sum(), x), 2 * x, atol=1e-5)
    m = RNG.standard_normal((4, 3))
    assert np.allclose(L.jacobian(lambda v: m @ v, np.ones(3)), m, atol=1e-5)


def test_contraction_similarity():
    assert np.isclose(L.contraction_similarity(T, T, 2), 1) and L.contraction_similarity(T, T[:3], 2) == 0
    base = RNG.standard_normal((8, 2))
    one, two, other = base @ RNG.standard_normal((2, 8)), base @ RNG.standard_normal((2, 8)), RNG.standard_normal((8, 8))
    assert L.contraction_similarity(one, two, 2) > L.contraction_similarity(one, other / np.linalg.norm(other) * np.linalg.norm(two), 2)


def test_forecast_of_a_line():
    assert np.allclose(L.ar_forecast(np.arange(50.0), 2, 1, 5), np.arange(50, 55), atol=1e-6)
    assert len(L.ar_forecast(np.array([1.0]), 5, 0, 3)) == 3


def test_matrix_facts():
    f = L.matrix_facts(np.array([[1.0, 2, 3], [2, 4, 5], [3, 5, 6]]))
    assert f["is_symmetric"] and not f["is_positive_definite"] and f["rank"] == 3
    f = L.matrix_facts(np.eye(3))
    assert f["is_positive_definite"] and f["is_orthogonal"] and f["is_diagonal"] and f["determinant"] == 1
    assert L.matrix_facts(np.outer([1.0, 2], [1, 2]))["rank"] == 1 and "trace" not in L.matrix_facts(A)


def test_results_of_a_kernel_go_out_in_pieces(monkeypatch):
    """A batch whose results are large is never held as a whole; rows that fail or are null stay in their place."""
    import pandas as pd

    monkeypatch.setattr(L.F, "pandas_udf", lambda kind: lambda f: lambda *columns: f)
    monkeypatch.setattr(L, "PIECE", 100_000)
    run = L.array_udf(lambda a: np.diag(np.linalg.inv(a).ravel()), "data", shapes=[[8, 8]])
    rows = [(np.eye(8) * (i + 1)).ravel() if i % 9 else None for i in range(40)] + [np.zeros(64), np.zeros(3)]
    pieces = list(run(iter([pd.Series(rows[:30], dtype="object"), pd.Series(rows[30:], dtype="object"), pd.Series([], dtype="object")])))
    assert max(sum(x.nbytes for x in p if x is not None) for p in pieces) < 100_000 + 8 * 64 * 64
    out = [x for p in pieces for x in p]
    assert len(out) == 42 and out[-1] is None and out[-2] is None
    assert all(x is None if i % 9 == 0 else np.allclose(x[0], 1 / (i + 1)) and len(x) == 4096 for i, x in enumerate(out[:40]))


def test_stacks_give_what_single_tensors_give(monkeypatch):
    """One call of the kernel serves many rows; a row that fails, or is null, spoils no other."""
    import pandas as pd

    monkeypatch.setattr(L.F, "pandas_udf", lambda kind: lambda f: lambda *columns: f)
    calls = []

    def kernel(a):
        calls.append(len(a))
        return L.from_tuckers(*L.tuckers(a, [2, 2, 1], 3, nonnegative=True))

    x = np.abs(RNG.standard_normal((600, 4, 3, 5)))
    rows = [v.ravel() for v in x] + [None, -x[0].ravel(), np.zeros(3)]
    out = [y for p in L.stacked_udf(kernel, "data", shapes=[[4, 3, 5]])(iter([pd.Series(rows, dtype="object")])) for y in p]
    assert len(calls) < 60 and len(out) == 603 and out[600] is None and out[601] is None and out[602] is None
    for i in (0, 511, 512, 599):
        assert np.allclose(out[i], L.from_tucker(*L.tucker(x[i], [2, 2, 1], 3, nonnegative=True)).ravel())


def test_block_terms_of_stacks():
    x = RNG.standard_normal((7, 4, 3, 5))
    terms = L.block_terms_of(x, [(1, 2, 1), (2, 1, 2)])
    for i in range(7):
        for (core, factors), (own, own_factors) in zip(terms, L.block_terms(x[i], [(1, 2, 1), (2, 1, 2)])):
            assert np.allclose(L.from_tuckers(core, factors)[i], L.from_tucker(own, own_factors))
    with pytest.raises(ValueError):
        L.tuckers(x, [9, 1, 1])
