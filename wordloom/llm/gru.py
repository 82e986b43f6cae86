"""A gated recurrent language model in numpy, with a class-factored output softmax.

The output is P(class) times P(token | class). Classes are runs of tokens by falling frequency with about equal mass, so
that frequent tokens share small classes and a step costs about classes + size/classes outputs. Biases begin as the unigram
model; training only has to find what context adds. Many documents run side by side, each in a lane; a lane's state goes
from window to window of a document, and is zero where a document begins.
"""

from __future__ import annotations

import numpy as np

F4 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, F4(0.5), out=x)
    np.tanh(x, out=x)
    x += F4(1)
    x *= F4(0.5)
    return x


def softmax(x: np.ndarray) -> None:
    """In place. Logits are clipped instead of shifted; with states in (-1, 1) they stay far from the limit."""
    np.minimum(x, F4(60), out=x)
    np.exp(x, out=x)
    x *= F4(1) / np.maximum(x @ np.ones((x.shape[1], 1), x.dtype), F4(1e-30))


class Model:
    """Parameters, all in one flat vector, so that models can be averaged."""

    def __init__(self, counts: np.ndarray, hidden: int, classes: int, seed: int = 1):
        """counts: of each token, in falling order."""
        n = len(counts)
        self.size, self.hidden = n, hidden
        mass = np.cumsum(counts.astype(np.float64) + 0.1)
        of = np.minimum((mass / mass[-1] * classes - 1e-9).astype(np.int64), classes - 1)
        _, of = np.unique(of, return_inverse=True)
        self.of, self.classes = of.astype(np.int64), int(of[-1]) + 1
        self.first = np.searchsorted(of, np.arange(self.classes))
        self.last = np.searchsorted(of, np.arange(self.classes), "right")
        h = hidden
        shapes = {"emb": (n, h), "w": (h, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "oc": (h, self.classes), "bc": (self.classes,), "ow": (n, h), "bw": (n,)}
        self.vector = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), F4)
        at = 0
        self.p: dict[str, np.ndarray] = {}
        self.slices = {}
        for k, s in shapes.items():
            size = int(np.prod(s))
            self.p[k] = self.vector[at : at + size].reshape(s)
            self.slices[k] = (at, at + size, s)
            at += size
        rng = np.random.default_rng(seed)
        self.p["emb"][:] = rng.normal(0, 0.3, (n, h))
        self.p["w"][:] = rng.normal(0, 0.5 / np.sqrt(h), (h, 3 * h))
        self.p["u"][:] = rng.normal(0, 0.5 / np.sqrt(h), (h, 3 * h))
        self.p["b"][:h] = -1  # keep most of the state at first
        prob = (counts + 0.1) / (counts + 0.1).sum()
        by = np.bincount(self.of, prob)
        self.p["bc"][:] = np.log(by)
        self.p["bw"][:] = np.log(prob / by[self.of])

    def load(self, vector: np.ndarray) -> "Model":
        self.vector[:] = vector
        return self

    def run(self, x: np.ndarray, state: np.ndarray, keep: bool) -> tuple:
        """x: input tokens (time, lanes), -1 at a document's start. Returns states after each step and, with keep, what
        the way back needs: the states before each step, the gates z and r, the candidates, and what r is multiplied by."""
        p, h = self.p, self.hidden
        steps, lanes = x.shape
        table = np.concatenate([p["emb"] @ p["w"], np.zeros((1, 3 * h), F4)])  # last row: no input
        table += p["b"]
        first = x < 0
        some = first.any(1)
        a = table.take(np.where(first, self.size, x), 0)
        states = np.empty((steps, lanes, h), F4)
        befores, gates, cs, gcs = (np.empty((steps, lanes, n * h), F4) for n in (1, 2, 1, 1)) if keep else (None,) * 4
        for t in range(steps):
            if some[t]:
                state = np.where(first[t][:, None], F4(0), state)
            g = state @ p["u"]
            zr = sigmoid(a[t, :, : 2 * h] + g[:, : 2 * h])
            gc = g[:, 2 * h :]
            c = zr[:, h:] * gc
            c += a[t, :, 2 * h :]
            np.tanh(c, out=c)
            new = states[t]
            np.subtract(c, state, out=new)
            new *= zr[:, :h]
            new += state
            if keep:
                befores[t], gates[t], cs[t], gcs[t] = state, zr, c, gc
            state = new
        return states, state.copy(), (befores, gates[..., :h], gates[..., h:], cs, gcs) if keep else None

    def logits(self, s: np.ndarray, y: np.ndarray, learn: bool) -> tuple:
        """Log probability of each target token, and with learn the gradients of its sum by state and output parameters.
        Rows are sorted by class first, so that each class is a slice of them."""
        p = self.p
        cls = self.of.take(y)
        order = np.argsort(cls.astype(np.int16), kind="stable")  # 16 bits: sorted by radix
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1))
        s, y = s.take(order, 0), y.take(order)
        c = s @ p["oc"]
        c += p["bc"]
        softmax(c)
        rows, cls = np.arange(len(y)), cls.take(order)
        log = np.log(np.maximum(c[rows, cls], F4(1e-30)))
        grads = None
        if learn:
            d = np.negative(c, out=c)
            d[rows, cls] += 1
            ds = d @ p["oc"].T
            grads = {"oc": s.T @ d, "bc": d.sum(0), "ow": np.zeros_like(p["ow"]), "bw": np.zeros_like(p["bw"])}
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = self.first[k], self.last[k]
            if b - a == 1:
                continue
            i = slice(cuts[k], cuts[k + 1])
            q = s[i] @ p["ow"][a:b].T
            q += p["bw"][a:b]
            softmax(q)
            at, hit = rows[: len(q)], y[i] - a
            log[i] += np.log(np.maximum(q[at, hit], F4(1e-30)))
            if learn:
                np.negative(q, out=q)
                q[at, hit] += 1
                ds[i] += q @ p["ow"][a:b]
                grads["ow"][a:b] = q.T @ s[i]
                grads["bw"][a:b] = q.sum(0)
        back = np.empty_like(order)
        back[order] = rows
        return log.take(back), ds.take(back, 0) if learn else None, grads

    def window(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (time, lanes) of targets y, and the state after the window."""
        states, state, _ = self.run(x, state, False)
        out = np.zeros(y.shape, F4)
        if live.any():
            out[live] = self.logits(states[live], y[live], False)[0]
        return out, state

    def gradient(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of the mean log probability within the window (truncated back-propagation), the state after it, and the mean."""
        p, h = self.p, self.hidden
        states, end, saved = self.run(x, state, True)
        n = int(live.sum())
        flat = np.zeros_like(self.vector)
        g = {k: flat[a:b].reshape(s) for k, (a, b, s) in self.slices.items()}
        if not n:
            return flat, end, 0.0
        log, ds, out = self.logits(states[live], y[live], True)
        for k, v in out.items():
            g[k][...] = v
        dstates = np.zeros_like(states)
        dstates[live] = ds
        before, z, r, c, gc = saved
        by_c, by_z, by_r, rest = z * (1 - c * c), (c - before) * z * (1 - z), gc * r * (1 - r), 1 - z
        carry = np.zeros_like(state)
        first = x < 0
        some = first.any(1)
        dg_all, da_c = np.empty((*x.shape, 3 * h), F4), np.empty((*x.shape, h), F4)
        back = np.ascontiguousarray(p["u"].T)
        for t in range(len(x) - 1, -1, -1):
            d = dstates[t]
            d += carry
            dg, dc = dg_all[t], da_c[t]
            np.multiply(d, by_c[t], out=dc)
            np.multiply(d, by_z[t], out=dg[:, :h])
            np.multiply(dc, by_r[t], out=dg[:, h : 2 * h])
            np.multiply(dc, r[t], out=dg[:, 2 * h :])
            carry = dg @ back
            d *= rest[t]
            carry += d
            if some[t]:
                carry[first[t]] = 0
        g["u"] += before.reshape(-1, h).T @ dg_all.reshape(-1, 3 * h)
        dg_all[:, :, 2 * h :] = da_c
        flat_x, flat_a = x.ravel(), dg_all.reshape(-1, 3 * h)
        g["b"] += flat_a.sum(0)
        seen = flat_x >= 0
        tokens, a = flat_x[seen], flat_a[seen]
        g["w"] += p["emb"][tokens].T @ a
        de = a @ p["w"].T
        order = np.argsort(tokens.astype(np.int16) if self.size < 1 << 15 else tokens, kind="stable")
        if len(order):
            first = np.flatnonzero(np.diff(tokens[order], prepend=-1))
            g["emb"][tokens[order][first]] += np.add.reduceat(de[order], first, 0)
        flat /= n
        return flat, end, float(log.mean())


class Adagrad:
    """Steps with a rate for each parameter; biases of the output move little, since they begin at the unigram model."""

    def __init__(self, model: Model, rate: float = 0.1):
        self.model, self.rate, self.sum = model, rate, np.full_like(model.vector, 1e-6)

    def step(self, gradient: np.ndarray) -> None:
        size = float(np.sqrt((gradient * gradient).sum()))
        if size > 1:
            gradient *= F4(1 / size)
        self.sum += gradient * gradient
        self.model.vector += F4(self.rate) * gradient / np.sqrt(self.sum)


def lanes(docs: list[np.ndarray], width: int, steps: int):
    """Windows over documents in lanes. Yields x, y, live, owner: inputs (the token before, -1 at a start), targets, where there is a
    target, and each target's place in docs. Documents are dealt longest first to the shortest lane, whole, one after another."""
    if not docs:
        return
    longest, total = max(map(len, docs)), sum(map(len, docs))
    width = max(1, min(width, len(docs), -(-total // max(1, longest))))
    load, lane_docs = np.zeros(width, np.int64), [[] for _ in range(width)]
    if len(docs) > 4 * width:
        for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
            j = int(load.argmin())
            lane_docs[j].append(k)
            load[j] += len(docs[k])
    else:
        for j, k in enumerate(sorted(range(len(docs)), key=lambda k: -len(docs[k]))):
            j = j if j < width else int(load.argmin())
            lane_docs[j].append(k)
            load[j] += len(docs[k])
    total = int(load.max())
    y = np.zeros((total, width), np.int32)
    x = np.full((total, width), -1, np.int32)
    owner = np.full((total, width), -1, np.int32)
    for j, own in enumerate(lane_docs):
        at = 0
        for k in own:
            n = len(docs[k])
            y[at : at + n, j] = docs[k]
            x[at + 1 : at + n, j] = docs[k][:-1]
            owner[at : at + n, j] = k
            at += n
    # Long lanes first; columns that have ended are left out.
    order = np.argsort(-load, kind="stable")
    load = load[order]
    for t in range(0, total, steps):
        on = order[: int((load > t).sum())]
        part = slice(t, t + steps)
        own = owner[part][:, on]
        yield x[part][:, on], y[part][:, on], own >= 0, own, len(on)
