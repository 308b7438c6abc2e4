"""A small causal self-attention language model in numpy: forward, gradients, Adam.

The output is a two-level softmax: a class, then its member. Its logits are the network's plus a prior, the
logarithm of the smoothed training frequencies after the id just before, so the network learns what
the longer context adds.
"""

from __future__ import annotations

import math

import numpy as np

WIDTH, HIDDEN, SPAN, STEP = 16, 32, 24, 19
CLASSES = MEMBERS = 28
LEAVES = CLASSES * MEMBERS - 1  # the last leaf stands for all rarer ids
BEGIN = LEAVES + 1
SHAPES = {
    "emb": (LEAVES + 2, WIDTH), "pos": (SPAN, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "out": (WIDTH, WIDTH),
    "up_1": (WIDTH + 1, HIDDEN), "down": (HIDDEN, WIDTH), "cls_1": (WIDTH + 1, CLASSES), "mem_1": (CLASSES, WIDTH + 1, MEMBERS),
}
#: The last row of these is the bias, for states with a 1 at their end.
BIASED = ("up", "cls", "mem")
SIZE = sum(math.prod(s) for s in SHAPES.values())
_PAST = np.tril(np.ones((SPAN, SPAN), np.float32))
#: Sums of exponentials up to which (and down to one over which) scores need no shift; others are shifted by their row's largest.
SAFE = 1e25
_ONES = np.ones((1 << 16, 1), np.float32)
QUERY = np.float32(WIDTH**-0.5)
_CELL = np.arange((LEAVES + 2) * WIDTH).reshape(-1, WIDTH)
CLASS_OF = (np.arange(LEAVES + 1) // MEMBERS).astype(np.int8)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as views of one flat vector."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = flat[at : at + n].reshape(s)
        at += n
    for k in BIASED:
        out[k], out[f"{k}_b"] = out[f"{k}_1"][..., :WIDTH, :], out[f"{k}_1"][..., WIDTH, :]
    return out


def start(seed: int = 5) -> np.ndarray:
    """Random small weights; the output begins as the prior alone."""
    flat = np.random.default_rng(seed).normal(0, 0.2, SIZE).astype(np.float32)
    p = views(flat)
    p["cls"][:] = p["mem"][:] = p["up_b"][:] = p["cls_b"][:] = p["mem_b"][:] = 0
    return flat


def prior(pairs: np.ndarray, strength: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of class and member after each leaf, from counts (previous, next).

    Counts after one leaf are smoothed by ``strength`` times the overall shares.
    """
    share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * pairs.shape[1])
    p = (pairs + strength * share) / (pairs.sum(axis=1, keepdims=True) + strength)
    p = p.reshape(len(pairs), CLASSES, MEMBERS)
    cls = p.sum(axis=2)
    return np.log(cls).astype(np.float32), np.log(p / cls[:, :, None]).astype(np.float32)


def _sums(a: np.ndarray) -> np.ndarray:
    """The rows' sums as a column; for short rows a product with ones is fastest."""
    return a @ _ONES[: a.shape[1]]


def _with_ones(a: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), a.shape[1] + 1), a.dtype)
    out[:, :-1] = a
    out[:, -1] = 1
    return out


def _exp(z: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of z less a shift, where keep is 1, the sums of the last axis as a column, and the shift: 0, or a number a row."""
    width = z.shape[-1]
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(z)
        if keep is not None:
            e *= keep
        total = _sums(e.reshape(-1, width))
    if len(total) and not (total.min() > 1 / SAFE and total.max() < SAFE):
        top = (z if keep is None else np.where(keep > 0, z, -np.inf)).max(axis=-1, keepdims=True)
        e = np.exp(np.minimum(z - top, 0))
        if keep is not None:
            e *= keep
        return e, _sums(e.reshape(-1, width)), top
    return e, total, 0.0


def _softmax(z: np.ndarray, own: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the log probabilities of the column own of each row, added up with the weights w, and the gradient for z."""
    at = own + np.arange(0, z.size, z.shape[1])
    e, total, top = _exp(z)
    e = e.reshape(-1)
    lost = w @ ((np.log(total) + top)[:, 0] - z.reshape(-1).take(at))
    d = e.reshape(z.shape)
    d *= w[:, None] / total
    e[at] -= w
    return float(lost), d


def first_counted(counts: np.ndarray) -> int:
    """The first places of the windows that count nowhere are only looked back at; up to SPAN - STEP of them need no queries."""
    return 0 if counts[:, : SPAN - STEP].any() else SPAN - STEP


def attended(p: dict, x: np.ndarray, lo: int = 0) -> tuple:
    """States after attention of the places from lo on of the windows x (n, SPAN) of leaves, with what the gradients need (weights before division by their sums, and one over these)."""
    n = len(x)
    h0 = p["emb"].take(x, axis=0)
    h0 += p["pos"]
    w = p["qkv"].copy()
    w[:, :WIDTH] *= QUERY
    qkv = (h0.reshape(-1, WIDTH) @ w).reshape(n, SPAN, 3 * WIDTH)
    e = qkv[:, lo:, :WIDTH] @ qkv[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1)
    e, total, _ = _exp(e, _PAST[lo:])
    z = (e @ qkv[:, :, 2 * WIDTH :]).reshape(-1, WIDTH)
    np.divide(1, total, out=total)
    z *= total
    h1 = z @ p["out"]
    h1.reshape(n, SPAN - lo, WIDTH)[...] += h0[:, lo:]
    return h1, (h0, w, qkv, e, total, z)


def fed(p: dict, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after the feed-forward layer, row by row, and its inner activations."""
    u = _with_ones(h1) @ p["up_1"]
    np.maximum(u, 0, out=u)
    h2 = u @ p["down"]
    h2 += h1
    return h2, u


def hidden(p: dict, x: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Final states of the positions of the windows x that count, all by default (the others are only looked back at), with their inner activations."""
    if counts is None:
        return fed(p, attended(p, x)[0])
    lo = first_counted(counts)
    h1 = attended(p, x, lo)[0]
    at = np.flatnonzero(counts[:, lo:])
    return fed(p, h1 if len(at) == len(h1) else h1.take(at, axis=0))


def _log_probability(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log probability of the column own of each row of scores."""
    out = z.reshape(-1).take(own + np.arange(0, z.size, z.shape[1]))
    _, total, top = _exp(z)
    return out - (np.log(total) + top)[:, 0]


def log_probs(p: dict, prior: tuple, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of the leaves y after x in states h: of the class, then of its member."""
    order = np.argsort(CLASS_OF.take(y), kind="stable")
    y, x, h = y.take(order), x.take(order), _with_ones(h.take(order, axis=0))
    c = CLASS_OF.take(y).astype(np.intp)
    ends = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    z = prior[0].take(x, axis=0)
    z += h @ p["cls_1"]
    lp = _log_probability(z, c)
    z = prior[1].reshape(-1, MEMBERS).take(x * CLASSES + c, axis=0)
    own = np.empty_like(z)
    for j in range(CLASSES):
        if ends[j] < ends[j + 1]:
            s = slice(ends[j], ends[j + 1])
            np.matmul(h[s], p["mem_1"][j], out=own[s])
    z += own
    lp += _log_probability(z, y - c * MEMBERS)
    out = np.empty_like(lp)
    out[order] = lp
    return out


def loss_and_gradient(flat: np.ndarray, prior: tuple, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted mean negative log probability and its gradient; weight is 0 at padding."""
    p, grad = views(flat), np.zeros_like(flat)
    g = views(grad)
    n, lo = len(x), first_counted(weight)
    x = x.astype(np.intp)
    h1_all, (h0, qkv_w, qkv, a, total, z) = attended(p, x, lo)
    q, k, v = (qkv[:, :, i : i + WIDTH] for i in range(0, 3 * WIDTH, WIDTH))
    a *= total.reshape(n, -1, 1)
    # only positions that count get an output; they stand by class, so that each class is one slice
    weight, y = weight[:, lo:].ravel(), y[:, lo:].ravel()
    at = np.flatnonzero(weight > 0)
    at = at[np.argsort(CLASS_OF.take(y[at]), kind="stable")]
    own_x, own_y = x[:, lo:].ravel().take(at), y.take(at)
    w = (weight[at] / max(weight.sum(), 1)).astype(np.float32)
    c = CLASS_OF.take(own_y).astype(np.intp)
    m = own_y - c * MEMBERS
    ends = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    slices = [(j, slice(ends[j], ends[j + 1])) for j in range(CLASSES) if ends[j] < ends[j + 1]]
    h1 = h1_all.take(at, axis=0)
    h2, u = fed(p, h1)
    h2 = _with_ones(h2)
    z2 = h2 @ p["cls_1"]
    z2 += prior[0].take(own_x, axis=0)
    loss, d = _softmax(z2, c, w)
    np.matmul(h2.T, d, out=g["cls_1"])
    dh = d @ p["cls"].T
    own_x *= CLASSES
    own_x += c
    z2 = np.empty((len(at), MEMBERS), np.float32)
    for j, s in slices:
        np.matmul(h2[s], p["mem_1"][j], out=z2[s])
    z2 += prior[1].reshape(-1, MEMBERS).take(own_x, axis=0)
    more, d = _softmax(z2, m, w)
    back = np.empty_like(dh)
    for j, s in slices:
        d_j = d[s]
        np.matmul(h2[s].T, d_j, out=g["mem_1"][j])
        np.matmul(d_j, p["mem"][j].T, out=back[s])
    dh += back
    np.matmul(u.T, dh, out=g["down"])
    du = dh @ p["down"].T
    du *= u > 0
    np.matmul(_with_ones(h1).T, du, out=g["up_1"])
    dh += du @ p["up"].T
    dh1 = np.zeros_like(h1_all)
    dh1[at] = dh
    np.matmul(z.T, dh1, out=g["out"])
    dz = dh1 @ p["out"].T
    mean = _sums(dz * z)  # of the gradients of a row's weights, by those weights
    dz = dz.reshape(n, -1, WIDTH)
    ds = dz @ v.transpose(0, 2, 1)
    ds -= mean.reshape(n, -1, 1)
    ds *= a
    dqkv = np.empty_like(qkv)
    dqkv[:, :lo, :WIDTH] = 0
    np.matmul(ds, k, out=dqkv[:, lo:, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q[:, lo:], out=dqkv[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dz, out=dqkv[:, :, 2 * WIDTH :])
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    np.matmul(h0.reshape(-1, WIDTH).T, dqkv, out=g["qkv"])
    g["qkv"][:, :WIDTH] *= QUERY
    dh0 = dqkv @ qkv_w.T
    dh0.reshape(n, SPAN, WIDTH)[:, lo:] += dh1.reshape(n, -1, WIDTH)
    np.matmul(np.ones(n, np.float32), dh0.reshape(n, -1), out=g["pos"].reshape(-1))
    cell = _CELL.take(x.ravel(), axis=0).ravel()
    g["emb"][...] = np.bincount(cell, weights=dh0.ravel(), minlength=g["emb"].size).reshape(g["emb"].shape)
    return loss + more, grad


class Adam:
    def __init__(self, rate: float = 4e-3):
        self.rate, self.t, self.m, self.v = rate, 0, np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        """One step; grad is overwritten."""
        self.t += 1
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * grad
        grad *= grad
        grad *= np.float32(0.01)
        self.v *= np.float32(0.99)
        self.v += grad
        scale = math.sqrt(1 - 0.99**self.t)
        np.sqrt(self.v, out=grad)
        grad += np.float32(1e-8 * scale)
        np.divide(self.m, grad, out=grad)
        grad *= np.float32(self.rate * scale / (1 - 0.9**self.t))
        flat -= grad


def windows(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and mask of the overlapping windows over one text; each target counts once.

    Windows begin STEP apart and count their last STEP places; those before the text hold BEGIN.
    """
    n = len(leaves)
    back = SPAN - STEP
    count = max(1, -(-n // STEP))
    pad = count * STEP + back
    x, y = np.full(pad, BEGIN, np.int32), np.full(pad, LEAVES, np.int32)
    x[back + 1 : back + n], y[back : back + n] = leaves[:-1], leaves
    at = np.arange(count)[:, None] * STEP + np.arange(SPAN)
    mask = at < back + n
    mask[:, :back] = False
    return x[at], y[at], mask
