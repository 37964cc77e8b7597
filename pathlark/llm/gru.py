"""A bidirectional gated recurrent unit in numpy: forward steps for whole batches, and backpropagation through time.

Arrays are (gate, batch, hidden), so each gate is one contiguous block. The squashing function is the
softsign s(x) = x / (1 + |x|) in place of tanh, and (1 + s(x)) / 2 in place of the logistic function:
numpy runs it several times faster, at the same accuracy here. The reset gate acts after the
recurrent product.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def init(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    """Recurrent weights (gate, in, out) of both directions."""
    return {d: (rng.standard_normal((3, hidden, hidden)) * 0.5 / np.sqrt(hidden)).astype(F32) for d in ("uf", "ub")}


def run(u: np.ndarray, tables: np.ndarray, ids: np.ndarray, out: np.ndarray, backward: bool) -> None:
    """One direction. u: (3, H, H); tables: (3, rows, H) inputs; ids: (steps, batch); out: (steps, batch, H)."""
    steps, n = ids.shape
    h = u.shape[1]
    g, x, a = (np.empty((3, n, h), F32) for _ in range(3))
    u_n = u[2] * F32(0.5)
    rz, r, z, c, state = g[:2], g[0], g[1], g[2], np.zeros((n, h), F32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        for k in range(3):
            np.take(tables[k], ids[t], axis=0, out=x[k], mode="clip")
        np.matmul(state, u[0], out=r)
        np.matmul(state, u[1], out=z)
        np.matmul(state, u_n, out=c)
        rz += x[:2]
        np.abs(rz, out=a[:2])
        a[:2] += F32(1)
        rz /= a[:2]
        rz += F32(1)  # twice the gates
        c *= r
        c += x[2]
        np.abs(c, out=a[2])
        a[2] += F32(1)
        c /= a[2]
        state = np.subtract(state, c, out=out[t])
        state *= z
        state *= F32(0.5)
        state += c


def train_forward(u: np.ndarray, gx: np.ndarray, backward: bool, kind: type = F32) -> dict:
    """One direction with what the way back needs. gx: (steps, 3, batch, H); kind: the precision."""
    steps, _, n, h = gx.shape
    keep = {k: np.empty((steps, n, h), kind) for k in ("prev", "r", "z", "n", "gn", "out", "dr", "dz", "dn")}
    state = np.zeros((n, h), kind)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        g = np.matmul(state, u)
        ar, az = gx[t, 0] + g[0], gx[t, 1] + g[1]
        keep["dr"][t], keep["dz"][t] = 0.5 / (1 + np.abs(ar)) ** 2, 0.5 / (1 + np.abs(az)) ** 2
        r, z = 0.5 + 0.5 * ar / (1 + np.abs(ar)), 0.5 + 0.5 * az / (1 + np.abs(az))
        an = gx[t, 2] + r * g[2]
        c = an / (1 + np.abs(an))
        keep["dn"][t] = (1 - np.abs(c)) ** 2
        keep["prev"][t], keep["r"][t], keep["z"][t], keep["n"][t], keep["gn"][t] = state, r, z, c, g[2]
        state = keep["out"][t] = c + z * (state - c)
    return keep


def train_backward(u: np.ndarray, keep: dict, d_out: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of u, gradient of gx) from the gradient of the outputs, through time."""
    steps, n, h = d_out.shape
    kind = keep["out"].dtype
    du, dgx, dh = np.zeros_like(u), np.empty((steps, 3, n, h), kind), np.zeros((n, h), kind)
    dg = np.empty((3, n, h), kind)
    turned = u.transpose(0, 2, 1)
    for t in range(steps) if backward else range(steps - 1, -1, -1):
        prev, r, z, c, gn = (keep[k][t] for k in ("prev", "r", "z", "n", "gn"))
        dh = dh + d_out[t]
        dan = dh * (1 - z) * keep["dn"][t]
        dg[0] = dan * gn * keep["dr"][t]
        dg[1] = dh * (prev - c) * keep["dz"][t]
        dg[2] = dan * r
        dgx[t, :2], dgx[t, 2] = dg[:2], dan
        du += np.matmul(prev.T, dg)
        dh = dh * z + np.matmul(dg, turned).sum(0)
    return du, dgx


class Adam:
    """Adam over a dict of arrays; `sparse` names hold (rows, gradient rows) of tables."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        a = (rate or self.rate) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = F32(min(1.0, 5.0 / (size + 1e-9)))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += F32(0.1) * (g - self.m[k])
            self.v[k] += F32(0.001) * (g * g - self.v[k])
            self.p[k] -= F32(a) * self.m[k] / (np.sqrt(self.v[k]) + F32(1e-8))


def table_gradient(ids: np.ndarray, dgx: np.ndarray, rows: int) -> np.ndarray:
    """(3, rows, H) sums of dgx (steps, 3, batch, H) by ids (steps, batch)."""
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    keys, at = np.unique(flat[order], return_index=True)
    grad = dgx.transpose(1, 0, 2, 3).reshape(3, len(flat), -1)[:, order]
    out = np.zeros((3, rows, grad.shape[2]), F32)
    out[:, keys] = np.add.reduceat(grad, at, axis=1)
    return out
