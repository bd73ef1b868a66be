"""Shapes of variograms and covariances."""

from __future__ import annotations

import math

import numpy as np


def bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """The modified Bessel function of the second kind: its integral by the trapezoid rule."""
    t = np.linspace(0, 32, 257)
    shape, flat = np.shape(x), np.ravel(np.asarray(x, float))
    out = np.empty(len(flat))
    with np.errstate(under="ignore"):
        for at in range(0, len(flat), 1000):  # bounds the table of places by steps
            f = np.exp(np.log(np.cosh(nu * t)) - flat[at : at + 1000, None] * np.cosh(t))
            out[at : at + 1000] = (f.sum(1) - (f[:, 0] + f[:, -1]) / 2) * (t[1] - t[0])
    return out.reshape(shape)


def rise(h: np.ndarray, kind: str, smoothness: float = 1.5) -> np.ndarray:
    """From 0 to 1: the share of the structured sill that a lag of ``h`` ranges has reached."""
    h = np.asarray(h, float)
    if kind == "exponential":
        return 1 - np.exp(-3 * h)
    if kind == "gaussian":
        return 1 - np.exp(-3 * h * h)
    if kind == "spherical":
        return np.where(h < 1, 1.5 * h - 0.5 * h**3, 1.0)
    if kind == "matern":
        u = np.maximum(h, 1e-12) * math.sqrt(smoothness)
        return 1 - 2 / math.gamma(smoothness) * (2 * u) ** smoothness * bessel_k(smoothness, 4 * u)
    raise ValueError(f"no variogram model {kind!r}")
