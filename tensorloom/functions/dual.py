"""Forward derivatives by dual numbers: arrays that carry their derivatives along one input element each.

``derivatives(f, x)`` runs f once on a ``Dual`` whose derivatives are the unit vectors of x. Functions may use
arithmetic, powers, slices, ``sum``, ``dot``, ``@`` with plain arrays, and the functions of this module.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Dual:
    """value, and slope of shape (inputs, *value.shape)."""

    __array_ufunc__ = None  # plain arrays leave operators to this class

    def __init__(self, value, slope):
        self.value, self.slope = np.asarray(value, float), np.asarray(slope, float)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def _of(self, other) -> Dual:
        if isinstance(other, Dual):
            return other
        other = np.asarray(other, float)
        return Dual(other, np.zeros((len(self.slope), *other.shape)))

    def __add__(self, other):
        o = self._of(other)
        value = self.value + o.value
        return Dual(value, _wide(self, value) + _wide(o, value))

    __radd__ = __add__

    def __neg__(self):
        return Dual(-self.value, -self.slope)

    def __sub__(self, other):
        return self + -self._of(other)

    def __rsub__(self, other):
        return -self + other

    def __mul__(self, other):
        o = self._of(other)
        value = self.value * o.value
        return Dual(value, _wide(self, value) * o.value + _wide(o, value) * self.value)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self * self._of(other) ** -1

    def __rtruediv__(self, other):
        return self._of(other) * self**-1

    def __pow__(self, p):
        if isinstance(p, Dual):
            return exp(p * log(self))
        return Dual(self.value**p, self.slope * (p * self.value ** (p - 1) if p else 0.0))

    def __getitem__(self, key):
        key = key if isinstance(key, tuple) else (key,)
        return Dual(self.value[key], self.slope[(slice(None), *key)])

    def __len__(self) -> int:
        return len(self.value)

    def sum(self, axis: int | None = None) -> Dual:
        if axis is None:
            return Dual(self.value.sum(), self.slope.reshape(len(self.slope), -1).sum(1))
        axis %= self.value.ndim
        return Dual(self.value.sum(axis), self.slope.sum(axis + 1))

    def reshape(self, *shape) -> Dual:
        value = self.value.reshape(*shape)
        return Dual(value, self.slope.reshape(len(self.slope), *value.shape))

    def __matmul__(self, other):
        o = self._of(other)
        return Dual(self.value @ o.value, np.stack([s @ o.value + self.value @ t for s, t in zip(self.slope, o.slope)]))

    def __rmatmul__(self, other):
        return self._of(other) @ self

    dot = __matmul__


def _wide(x: Dual, value: np.ndarray) -> np.ndarray:
    """The slope, with dimensions of 1 where broadcasting adds some."""
    slope = x.slope.reshape(len(x.slope), *[1] * (value.ndim - x.value.ndim), *x.value.shape)
    return np.broadcast_to(slope, (len(slope), *value.shape))


def _applied(function: Callable, slope: Callable) -> Callable:
    def run(x):
        return Dual(function(x.value), x.slope * slope(x.value)) if isinstance(x, Dual) else function(x)

    return run


exp = _applied(np.exp, np.exp)
log = _applied(np.log, lambda v: 1 / v)
sin = _applied(np.sin, np.cos)
cos = _applied(np.cos, lambda v: -np.sin(v))
tanh = _applied(np.tanh, lambda v: 1 - np.tanh(v) ** 2)
sqrt = _applied(np.sqrt, lambda v: 0.5 / np.sqrt(v))


def derivatives(function: Callable, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The function's value at x, and its derivatives, of shape (*value.shape, *x.shape)."""
    x = np.asarray(x, float)
    out = function(Dual(x, np.eye(x.size).reshape(x.size, *x.shape)))
    if not isinstance(out, Dual):  # a constant
        out = Dual(out, np.zeros((x.size, *np.shape(out))))
    return out.value, np.moveaxis(out.slope, 0, -1).reshape(*out.value.shape, *x.shape)
