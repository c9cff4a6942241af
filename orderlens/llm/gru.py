"""Gated recurrent units in numpy: forward pass, backpropagation through time and Adam.

Inputs arrive as projections ``gx`` (time, lane, 3 x units: reset, update, candidate gates), so an embedding and the
input weights are one table. An update gate forced to 1 (``HOLD``) leaves the state as it is: padding uses that.
"""

from __future__ import annotations

import numpy as np

HOLD = 30.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(gx: np.ndarray, u: np.ndarray, reverse: bool = False, keep: bool = False):
    """States (time, lane, units); with ``keep`` also what ``backward`` needs."""
    steps, lanes, k = gx.shape[0], gx.shape[1], u.shape[0]
    states = np.empty((steps, lanes, k), gx.dtype)
    h = np.zeros((lanes, k), gx.dtype)
    saved = []
    gates, gh, cand = np.empty((lanes, 2 * k), gx.dtype), np.empty((lanes, 3 * k), gx.dtype), np.empty((lanes, k), gx.dtype)
    for t in (range(steps - 1, -1, -1) if reverse else range(steps)):
        np.dot(h, u, out=gh)
        np.add(gx[t, :, :2 * k], gh[:, :2 * k], out=gates)
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        np.multiply(gates[:, :k], gh[:, 2 * k:], out=cand)
        cand += gx[t, :, 2 * k:]
        np.tanh(cand, out=cand)
        new = states[t]
        np.subtract(h, cand, out=new)
        new *= gates[:, k:]
        new += cand
        if keep:
            saved.append((t, h.copy(), gates.copy(), cand.copy(), gh[:, 2 * k:].copy()))
        h = new
    return (states, saved) if keep else states


def backward(grad: np.ndarray, saved: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input projections and of the recurrent weights, through all time steps."""
    k = u.shape[0]
    dgx, du = np.empty((*grad.shape[:2], 3 * k), grad.dtype), np.zeros_like(u)
    dh = np.zeros(grad.shape[1:], grad.dtype)
    for t, before, gates, cand, ghn in reversed(saved):
        dh = dh + grad[t]
        r, z = gates[:, :k], gates[:, k:]
        dn = dh * (1 - z) * (1 - cand * cand)
        dz = dh * (before - cand) * z * (1 - z)
        dr = dn * ghn * r * (1 - r)
        dgx[t, :, :k], dgx[t, :, k:2 * k], dgx[t, :, 2 * k:] = dr, dz, dn
        dgh = np.concatenate([dr, dz, dn * r], axis=1)
        du += before.T @ dgh
        dh = dh * z + dgh @ u.T
    return dgx, du


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.02):
        self.p, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            step = self.m[k] / (1 - 0.9 ** self.t) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-8)
            self.p[k] -= (self.rate * scale * step).astype(self.p[k].dtype)


def init(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)


def scan(table: np.ndarray, x: np.ndarray, u: np.ndarray, reverse: bool = False):
    """Forward pass for scoring: yields (t, state) with states (units, lanes), valid until the next step.

    ``table`` (inputs, 3 x units) holds the projections of every possible input, ``x`` (time, lanes) input numbers.
    Gates are kept as tanh of half their input, which saves the shifts of the logistic function, and lanes lie
    in memory side by side.
    """
    k, lanes = u.shape[0], x.shape[1]
    half = np.concatenate([np.full(2 * k, 0.5), np.ones(k)]).astype(np.float32)
    by_row = table.shape[0] > 4096                   # a large table is read row by row, a small one column by column
    rows = np.ascontiguousarray(table * half) if by_row else np.ascontiguousarray((table * half).T)
    ut = np.ascontiguousarray((u * 0.5).T.astype(np.float32))
    h = np.zeros((k, lanes), np.float32)
    gx, gh = np.empty((3 * k, lanes), np.float32), np.empty((3 * k, lanes), np.float32)
    cand, away = np.empty((k, lanes), np.float32), np.empty((k, lanes), np.float32)
    for t in (range(x.shape[0] - 1, -1, -1) if reverse else range(x.shape[0])):
        if by_row:
            gx[:] = rows[x[t]].T
        else:
            np.take(rows, x[t], axis=1, out=gx, mode="clip")
        np.dot(ut, h, out=gh)
        gates = gx[:2 * k]
        gates += gh[:2 * k]
        np.tanh(gates, out=gates)
        np.multiply(gates[:k], gh[2 * k:], out=cand)
        cand += gh[2 * k:]
        cand += gx[2 * k:]
        np.tanh(cand, out=cand)
        np.subtract(h, cand, out=away)
        away *= gates[k:]
        h += cand
        h += away
        h *= 0.5
        yield t, h
