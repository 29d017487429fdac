"""Dense linear algebra of one tensor at a time: numpy kernels, applied to columns by Arrow-batched UDFs.

Kernels take and return numpy arrays; signs and orders of factors are as numpy gives them, so compare invariants
(singular values, reconstruction errors), not factors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.functions import dual

# matrices


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L, U with a = P L U, by rows with partial pivoting."""
    u, m, n = a.astype(float).copy(), *a.shape
    low, order = np.eye(m), np.arange(m)
    for k in range(min(m, n)):
        pivot = k + int(np.argmax(np.abs(u[k:, k])))
        if pivot != k:
            u[[k, pivot]], order[[k, pivot]] = u[[pivot, k]], order[[pivot, k]]
            low[[k, pivot], :k] = low[[pivot, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    p = np.zeros((m, m))
    p[order, np.arange(m)] = 1
    r = min(m, n)
    return p, low[:, :r], u[:r]


def cholesky(a: np.ndarray) -> np.ndarray:
    if not np.allclose(a, a.T):
        raise ValueError("the matrix isn't symmetric")
    return np.linalg.cholesky(a)


def square(a: np.ndarray) -> np.ndarray:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("the matrix isn't square")
    return a


def l2_norm(a: np.ndarray) -> float:
    """Euclidean norm of a vector, spectral norm of a matrix."""
    if a.ndim > 2:
        raise ValueError("only vectors and matrices have this norm")
    return float(np.linalg.norm(a, 2))


def nuclear_norm(a: np.ndarray) -> float:
    return float(np.linalg.svd(a, compute_uv=False).sum())


# unfoldings and products


def unfold(a: np.ndarray, mode: int) -> np.ndarray:
    return np.moveaxis(a, mode, 0).reshape(a.shape[mode], -1)


def fold(m: np.ndarray, mode: int, shape: tuple[int, ...]) -> np.ndarray:
    rest = [shape[mode], *[d for k, d in enumerate(shape) if k != mode]]
    return np.moveaxis(m.reshape(rest), 0, mode)


def mode_product(a: np.ndarray, m: np.ndarray, mode: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(m, a, (1, mode)), 0, mode)


def khatri_rao(factors: list[np.ndarray]) -> np.ndarray:
    out = factors[0]
    for f in factors[1:]:
        out = (out[:, None, :] * f[None]).reshape(-1, out.shape[1])
    return out


def t_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of 3-way tensors: slices of their Fourier transforms along the last axis are multiplied."""
    fa, fb = np.fft.fft(a, axis=2), np.fft.fft(b, axis=2)
    return np.real(np.fft.ifft(np.einsum("ijk,jlk->ilk", fa, fb), axis=2))


def tensor_trace(a: np.ndarray, one: int = 0, other: int = 1) -> np.ndarray:
    return np.trace(a, axis1=one, axis2=other)


def convolve(signal: np.ndarray, kernel: np.ndarray, mode: str = "valid") -> np.ndarray:
    """True convolution in any number of dimensions; ``same`` pads half the kernel on either side."""
    if signal.ndim != kernel.ndim:
        raise ValueError("signal and kernel have different numbers of dimensions")
    pad = {"valid": [0] * kernel.ndim, "same": [k // 2 for k in kernel.shape], "full": [k - 1 for k in kernel.shape]}[mode]
    signal = np.pad(signal, [(p, p) for p in pad])
    if any(s < k for s, k in zip(signal.shape, kernel.shape)):
        raise ValueError("the kernel is larger than the signal")
    windows = np.lib.stride_tricks.sliding_window_view(signal, kernel.shape)
    return np.tensordot(windows, np.flip(kernel), axes=kernel.ndim)


def gradient(function: Callable, x: np.ndarray) -> np.ndarray:
    """Exact derivatives of a scalar function of arrays (see ``functions.dual`` for what it may use)."""
    value, slope = dual.derivatives(function, x)
    if value.shape not in ((), (1,)):
        raise ValueError("the function isn't scalar")
    return slope.reshape(np.shape(x))


def jacobian(function: Callable, x: np.ndarray) -> np.ndarray:
    """Exact derivatives of an array's elements with respect to the input's."""
    return dual.derivatives(function, x)[1]


def differences(function: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Central differences, for scalar functions that dual numbers can't pass through."""
    out = np.zeros_like(x, float)
    for at in np.ndindex(x.shape):
        up, down = x.astype(float).copy(), x.astype(float).copy()
        up[at] += step
        down[at] -= step
        out[at] = (function(up) - function(down)) / (2 * step)
    return out


def array_of(entries: list[tuple[list[int], float]], shape: list[int]) -> np.ndarray:
    """A dense array of (position, value) entries."""
    out = np.zeros(shape)
    for at, value in entries:
        out[tuple(at)] = value
    return out


# decompositions


def cp(a: np.ndarray, rank: int, rounds: int = 200, tolerance: float = 1e-10, seed: int = 0, nonnegative: bool = False) -> list[np.ndarray]:
    """Factors of a sum of ``rank`` outer products: alternating least squares, or multiplicative updates if nonnegative."""
    if rank < 1 or a.ndim < 2:
        raise ValueError("the rank must be positive and the tensor have two dimensions at least")
    if nonnegative and (a < 0).any():
        raise ValueError("the tensor has negative elements")
    rng = np.random.default_rng(seed)
    factors = [rng.random((d, rank)) for d in a.shape]
    last = np.inf
    for _ in range(rounds):
        for k in range(a.ndim):
            others = khatri_rao([f for m, f in enumerate(factors) if m != k])
            if nonnegative:
                factors[k] *= (unfold(a, k) @ others) / np.maximum(factors[k] @ (others.T @ others), 1e-12)
            else:
                factors[k] = unfold(a, k) @ np.linalg.pinv(others).T
        error = np.linalg.norm(a - from_cp(factors))
        if abs(last - error) < tolerance * max(1.0, np.linalg.norm(a)):
            break
        last = error
    return factors


def from_cp(factors: list[np.ndarray]) -> np.ndarray:
    return khatri_rao(factors).sum(1).reshape([len(f) for f in factors])


def tucker(a: np.ndarray, ranks: list[int], rounds: int = 30, seed: int = 0, nonnegative: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Core and factors: higher-order orthogonal iteration from the higher-order SVD, or multiplicative updates."""
    core, factors = tuckers(a[None], ranks, rounds, seed, nonnegative)
    return core[0], [f[0] for f in factors]


def _unfolds(a: np.ndarray, mode: int) -> np.ndarray:
    return np.moveaxis(a, mode + 1, 1).reshape(len(a), a.shape[mode + 1], -1)


def _mode_products(a: np.ndarray, m: np.ndarray, mode: int) -> np.ndarray:
    rest = [d for k, d in enumerate(a.shape[1:]) if k != mode]
    return np.moveaxis((m @ _unfolds(a, mode)).reshape(len(a), m.shape[1], *rest), 1, mode + 1)


def tuckers(a: np.ndarray, ranks: list[int], rounds: int = 30, seed: int = 0, nonnegative: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """``tucker`` of each tensor of a stack: cores and factors are stacks too."""
    shape = a.shape[1:]
    if len(ranks) != len(shape) or any(not 1 <= r <= d for r, d in zip(ranks, shape)):
        raise ValueError("one rank for each dimension, between 1 and its size, is needed")
    turned = lambda f: f.swapaxes(1, 2)
    if nonnegative:
        if (a < 0).any():
            raise ValueError("the tensor has negative elements")
        rng = np.random.default_rng(seed)
        factors, core = [np.repeat(rng.random((1, d, r)), len(a), 0) for d, r in zip(shape, ranks)], np.repeat(rng.random((1, *ranks)), len(a), 0)
        for _ in range(10 * rounds):
            for k in range(len(shape)):
                rest = core
                for m, f in enumerate(factors):
                    rest = rest if m == k else _mode_products(rest, f, m)
                rest = _unfolds(rest, k)
                factors[k] *= (_unfolds(a, k) @ turned(rest)) / np.maximum(factors[k] @ (rest @ turned(rest)), 1e-12)
            up, down = a, core
            for k, f in enumerate(factors):
                up, down = _mode_products(up, turned(f), k), _mode_products(down, turned(f) @ f, k)
            core = core * (up / np.maximum(down, 1e-12))
        return core, factors
    factors = [np.linalg.svd(_unfolds(a, k), full_matrices=False)[0][:, :, :r] for k, r in enumerate(ranks)]
    for _ in range(rounds):
        for k in range(len(shape)):
            rest = a
            for m, f in enumerate(factors):
                rest = rest if m == k else _mode_products(rest, turned(f), m)
            factors[k] = np.linalg.svd(_unfolds(rest, k), full_matrices=False)[0][:, :, : ranks[k]]
    core = a
    for k, f in enumerate(factors):
        core = _mode_products(core, turned(f), k)
    return core, factors


def from_tuckers(core: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for k, f in enumerate(factors):
        core = _mode_products(core, f, k)
    return core


def partial_tucker(a: np.ndarray, ranks: list[int | None], rounds: int = 30) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Core and factors of the modes that have a rank; a mode with None stays as it is and has no factor."""
    if len(ranks) != a.ndim or any(r is not None and not 1 <= r <= d for r, d in zip(ranks, a.shape)):
        raise ValueError("one rank for each dimension, between 1 and its size, or None, is needed")
    modes = [k for k, r in enumerate(ranks) if r is not None]
    factors: list[np.ndarray | None] = [np.linalg.svd(unfold(a, k), full_matrices=False)[0][:, :r] if r is not None else None for k, r in enumerate(ranks)]
    for _ in range(rounds if len(modes) > 1 else 0):
        for k in modes:
            rest = a
            for m in modes:
                rest = rest if m == k else mode_product(rest, factors[m].T, m)
            factors[k] = np.linalg.svd(unfold(rest, k), full_matrices=False)[0][:, : ranks[k]]
    core = a
    for k in modes:
        core = mode_product(core, factors[k].T, k)
    return core, factors


def from_partial_tucker(core: np.ndarray, factors: list[np.ndarray | None]) -> np.ndarray:
    for k, f in enumerate(factors):
        core = core if f is None else mode_product(core, f, k)
    return core


def hosvd(a: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    factors = [np.linalg.svd(unfold(a, k), full_matrices=False)[0] for k in range(a.ndim)]
    core = a
    for k, f in enumerate(factors):
        core = mode_product(core, f.T, k)
    return core, factors


def from_tucker(core: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for k, f in enumerate(factors):
        core = mode_product(core, f, k)
    return core


def tensor_train(a: np.ndarray, rank: int | list[int]) -> list[np.ndarray]:
    """Cores (r, d, r') by successive truncated SVDs."""
    ranks = [rank] * (a.ndim - 1) if isinstance(rank, int) else list(rank)
    if len(ranks) != a.ndim - 1:
        raise ValueError("one rank for each inner bond is needed")
    cores, rest, left = [], a.astype(float), 1
    for k, d in enumerate(a.shape[:-1]):
        u, s, v = np.linalg.svd(rest.reshape(left * d, -1), full_matrices=False)
        r = min(ranks[k], len(s))
        cores.append(u[:, :r].reshape(left, d, r))
        rest, left = s[:r, None] * v[:r], r
    return [*cores, rest.reshape(left, a.shape[-1], 1)]


def from_train(cores: list[np.ndarray]) -> np.ndarray:
    out = cores[0]
    for c in cores[1:]:
        out = np.tensordot(out, c, (-1, 0))
    return out[0, ..., 0] if out.shape[0] == 1 else np.trace(out, axis1=0, axis2=-1)


def tensor_ring(a: np.ndarray, rank: int, split: int = 1) -> list[np.ndarray]:
    """Cores of a ring whose first and last bond is ``split``: an SVD of the first unfolding, then a train."""
    u, s, v = np.linalg.svd(a.reshape(a.shape[0], -1), full_matrices=False)
    r = max(1, min(rank, len(s) // split)) * split
    first = u[:, :r].reshape(a.shape[0], split, r // split).transpose(1, 0, 2)
    rest = (s[:r, None] * v[:r]).reshape(split, r // split, *a.shape[1:])
    rest = np.moveaxis(rest, 0, -1)
    left, cores = r // split, [first]
    for d in a.shape[1:-1]:
        u, s, v = np.linalg.svd(rest.reshape(left * d, -1), full_matrices=False)
        k = min(rank, len(s))
        cores.append(u[:, :k].reshape(left, d, k))
        rest, left = s[:k, None] * v[:k], k
    return [*cores, rest.reshape(left, a.shape[-1], split)]


def hierarchical_tucker(a: np.ndarray, ranks: int) -> dict:
    """A balanced dimension tree: frames at the leaves, transfer tensors above, from truncated SVDs."""

    def node(modes: list[int]) -> dict:
        whole = np.moveaxis(a, modes, range(len(modes))).reshape(int(np.prod([a.shape[m] for m in modes])), -1)
        u = np.linalg.svd(whole, full_matrices=False)[0]
        frame = u[:, : min(ranks, u.shape[1])] if len(modes) < a.ndim else whole
        if len(modes) == 1:
            return {"modes": modes, "frame": frame}
        left, right = node(modes[: len(modes) // 2]), node(modes[len(modes) // 2 :])
        shaped = frame.reshape(left["frame"].shape[0], right["frame"].shape[0], -1)
        transfer = np.einsum("abk,al,br->lrk", shaped, left["frame"], right["frame"])
        return {"modes": modes, "left": left, "right": right, "transfer": transfer, "frame": np.einsum("lrk,al,br->abk", transfer, left["frame"], right["frame"]).reshape(frame.shape[0], -1)}

    return node(list(range(a.ndim)))


def from_hierarchical(tree: dict, shape: tuple[int, ...]) -> np.ndarray:
    return tree["frame"].reshape(shape)


def block_terms(a: np.ndarray, ranks: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Greedy: each term is a Tucker decomposition of what the terms before leave."""
    return [(core[0], [f[0] for f in factors]) for core, factors in block_terms_of(a[None], ranks)]


def block_terms_of(a: np.ndarray, ranks: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """``block_terms`` of each tensor of a stack."""
    terms, rest = [], a.astype(float)
    for r in ranks:
        terms.append(tuckers(rest, list(r)))
        rest = rest - from_tuckers(*terms[-1])
    return terms


def t_svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, S, V with a = U * S * transpose(V) in the t-product, from the SVDs of the Fourier slices."""
    f = np.fft.fft(a, axis=2)
    m, n, depth = a.shape
    r = min(m, n)
    u, s, v = np.zeros((m, r, depth), complex), np.zeros((r, r, depth), complex), np.zeros((n, r, depth), complex)
    for k in range(depth // 2 + 1):
        x, d, y = np.linalg.svd(f[:, :, k], full_matrices=False)
        u[:, :, k], s[:, :, k], v[:, :, k] = x, np.diag(d), y.conj().T
        if 0 < k < (depth + 1) // 2:  # the other half are conjugates
            u[:, :, depth - k], s[:, :, depth - k], v[:, :, depth - k] = x.conj(), np.diag(d), y.T
    return tuple(np.real(np.fft.ifft(x, axis=2)) for x in (u, s, v))


def t_transpose(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a[:, :, :1], a[:, :, :0:-1]], axis=2).transpose(1, 0, 2)


# sketches and their similarity


def sketch(a: np.ndarray, rank: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Core and leading left singular vectors of each mode, at most ``rank`` of them."""
    factors = []
    for k in range(a.ndim):
        m = unfold(a, k)
        factors.append(np.linalg.svd(m, full_matrices=False)[0][:, : max(1, min(rank, *m.shape))])
    core = a
    for k, f in enumerate(factors):
        core = mode_product(core, f.T, k)
    return core, factors


def grassmannian(ua: np.ndarray, ub: np.ndarray) -> float:
    s = np.clip(np.linalg.svd(ua.T @ ub, compute_uv=False), -1, 1)
    return float(np.sqrt((np.arccos(s) ** 2).sum()))


def core_distance(a: tuple[np.ndarray, list[np.ndarray]], b: tuple[np.ndarray, list[np.ndarray]]) -> float:
    """Distance of the cores once each mode of b is turned towards a."""
    core = b[0]
    for k, (ua, ub) in enumerate(zip(a[1], b[1])):
        u, _, v = np.linalg.svd(ua.T @ ub)
        core = mode_product(core, u @ v, k)
    return float(np.linalg.norm(a[0] - core))


def contraction_similarity(a: np.ndarray, b: np.ndarray, rank: int = 4) -> float:
    """exp of minus 0.6 times the mean subspace distance and 0.4 times the core distance; 0 for different shapes."""
    if a.shape != b.shape:
        return 0.0
    return sketch_similarity(sketch(a, rank), sketch(b, rank))


def sketch_similarity(x: tuple[np.ndarray, list[np.ndarray]], y: tuple[np.ndarray, list[np.ndarray]]) -> float:
    if any(p.shape != q.shape for p, q in zip(x[1], y[1])):
        return 0.0
    angle = float(np.mean([grassmannian(p, q) for p, q in zip(x[1], y[1])]))
    return float(np.exp(-(0.6 * angle + 0.4 * core_distance(x, y))))


def spectral_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """By singular values where the padded length is a square, else by Frobenius distance."""
    n = max(a.size, b.size)
    a, b = (np.pad(np.ravel(x), (0, n - x.size)) for x in (a, b))
    side = int(round(n**0.5))
    if side * side == n:
        a, b = (np.linalg.svd(x.reshape(side, side), compute_uv=False) for x in (a, b))
    return float(1 / (1 + np.linalg.norm(a - b)))


# forecasts


def ar_forecast(series: np.ndarray, p: int = 5, d: int = 1, n: int = 30) -> np.ndarray:
    """AR(p) with intercept on the d-th differences by least squares, an approximation of ARIMA(p, d, 0)."""
    levels = [np.asarray(series, float)]
    for _ in range(d):
        levels.append(np.diff(levels[-1]))
    x = levels[-1]
    p = max(0, min(p, (len(x) - 1) // 2))
    rows = len(x) - p
    design = np.column_stack([np.ones(rows), *[x[p - k - 1 : len(x) - k - 1] for k in range(p)]]) if rows > 0 else np.ones((0, 1))
    weights = np.linalg.lstsq(design, x[p:], rcond=None)[0] if rows > 0 else np.zeros(1)
    past = list(x)
    out = []
    for _ in range(n):
        value = weights[0] + sum(w * past[-k - 1] for k, w in enumerate(weights[1:]))
        past.append(value)
        out.append(value)
    out = np.array(out)
    for level in reversed(levels[:-1]):
        out = level[-1] + np.cumsum(out)
    return out


# descriptors


def matrix_facts(a: np.ndarray) -> dict:
    """Facts of a matrix in float64; those that only square matrices have are null for others."""
    s = np.linalg.svd(a, compute_uv=False)
    rank = int((s > 1e-10).sum())
    out = {"rank": rank, "condition_number": float(s[0] / s[-1]) if len(s) and s[-1] > 1e-10 else None, "spectral_norm": float(s[0]) if len(s) else None, "nuclear_norm": float(s.sum())}
    if a.shape[0] != a.shape[1]:
        return out
    eye = np.eye(len(a))
    symmetric = bool(np.allclose(a, a.T, rtol=1e-5, atol=1e-8))
    values = np.linalg.eigvalsh(a) if symmetric else np.linalg.eigvals(a).real
    return out | {
        "trace": float(np.trace(a)), "determinant": float(np.linalg.det(a)), "eigen_min": float(values.min()), "eigen_max": float(values.max()), "is_symmetric": symmetric,
        "is_positive_definite": bool(symmetric and values.min() > 0), "is_orthogonal": bool(np.allclose(a @ a.T, eye, rtol=1e-5, atol=1e-8)), "is_diagonal": bool((np.abs(a - np.diag(np.diag(a))) <= 1e-8).all()),
    }


FACTS = "rank int, condition_number double, spectral_norm double, nuclear_norm double, trace double, determinant double, eigen_min double, eigen_max double, is_symmetric boolean, is_positive_definite boolean, is_orthogonal boolean, is_diagonal boolean"


#: Bytes of results that a kernel's rows make before they go out.
PIECE = 1 << 22
#: Rows that a kernel over stacks gets at once.
STACK = 512


def _tensor(data, shape) -> np.ndarray:
    return np.asarray(data, float).reshape([int(d) for d in shape])


def facts(data, shape) -> Column:
    """A struct of matrix facts for 2-D rows, null for others, in one Arrow UDF."""
    names = [f.split()[0] for f in FACTS.split(", ")]

    @F.pandas_udf(FACTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for d, s in batches:
            rows = [matrix_facts(_tensor(x, y)) if x is not None and len(y) == 2 and len(x) else {} for x, y in zip(d, s)]
            frame = pd.DataFrame(rows, columns=names, index=d.index)
            yield frame.astype({"rank": "Int32", **{n: "boolean" for n in names if n.startswith("is_")}})

    d, s = (F.col(c) if isinstance(c, str) else c for c in (data, shape))
    return F.when(F.size(s) == 2, run(d, s))


def scalar_udf(kernel: Callable[..., float], *columns, shapes: list[list[int]]) -> Column:
    """A double from a kernel over dense columns of known shapes; rows where the kernel fails are null."""

    @F.pandas_udf("double")
    def run(*batch: pd.Series) -> pd.Series:
        out = []
        for row in zip(*batch):
            try:
                out.append(None if any(x is None for x in row) else float(kernel(*[_tensor(x, s) for x, s in zip(row, shapes)])))
            except (ValueError, np.linalg.LinAlgError):
                out.append(None)
        return pd.Series(out, dtype="float64")

    return run(*columns)


def array_udf(kernel: Callable[..., np.ndarray], *columns, shapes: list[list[int]]) -> Column:
    """A flat array of doubles from a kernel over dense columns of known shapes; rows where the kernel fails are null.

    Results go out in pieces of at most about PIECE bytes, so that memory doesn't depend on how large they are.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch if isinstance(batch, tuple) else (batch,))):
                try:
                    out.append(None if any(x is None for x in row) else np.ravel(kernel(*[_tensor(x, s) for x, s in zip(row, shapes)])).astype(float))
                except (ValueError, np.linalg.LinAlgError):
                    out.append(None)
                held += 8 if out[-1] is None else out[-1].nbytes
                if held >= PIECE:
                    yield pd.Series(out, dtype="object")
                    out, held = [], 0
            yield pd.Series(out, dtype="object")

    return run(*columns)


def _each(kernel: Callable[..., np.ndarray], rows: list[tuple], shapes: list[list[int]]) -> list[np.ndarray | None]:
    """The kernel's result of each row, all at once; where that fails, of halves, so that only rows which fail alone are null."""
    try:
        out = kernel(*[np.stack([_tensor(x, s) for x in column]) for column, s in zip(zip(*rows), shapes)])
        return list(np.reshape(out, (len(rows), -1)).astype(float))
    except (ValueError, np.linalg.LinAlgError):
        half = len(rows) // 2
        return _each(kernel, rows[:half], shapes) + _each(kernel, rows[half:], shapes) if half else [None]


def stacked_udf(kernel: Callable[..., np.ndarray], *columns, shapes: list[list[int]]) -> Column:
    """``array_udf`` with a kernel over stacks of tensors, STACK rows at a time."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = list(zip(*(batch if isinstance(batch, tuple) else (batch,))))
            for part in range(0, len(rows), STACK):
                out = [None] * len(rows[part : part + STACK])
                whole = [i for i, row in enumerate(rows[part : part + STACK]) if all(x is not None for x in row)]
                for i, own in zip(whole, _each(kernel, [rows[part + i] for i in whole], shapes) if whole else []):
                    out[i] = own
                yield pd.Series(out, dtype="object")

    return run(*columns)


def matmul_udf(a, b, left: list[int], right: list[int]) -> Column:
    """The products of dense matrices of known shapes, a batch at a time."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        own = np.flatnonzero(x.notna() & y.notna())
        out = pd.Series([None] * len(x), dtype="object")
        if len(own):
            p, q = (np.stack(s.iloc[own].to_numpy()).astype(float).reshape(-1, *d) for s, d in ((x, left), (y, right)))
            for i, row in zip(own.tolist(), (p @ q).reshape(len(own), -1)):
                out.iloc[i] = row
        return out

    return run(a, b)
