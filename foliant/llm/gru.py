"""A small gated recurrent language model in numpy, with a class-factored softmax.

Token ids are ranks by frequency; CLASS consecutive ids make a class, and P(token) = P(class) P(token | class).
Documents flow through lanes that step side by side: a lane takes the next document when it has ended one, so
what is held is one document a lane, however many and however long they are. A lane's state is carried from window
to window and set to zero where a document begins, so a document's log-likelihood covers it from its first to its
last token. Training is truncated backpropagation within windows, with Adagrad steps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np

CLASS = 48
WINDOW = 32
LANES = 256
HELD_TOKENS = 1_000_000  # tokens of documents that wait for a lane; the longest goes first
f32 = np.float32


def sorted_places(ids: np.ndarray, size: int) -> np.ndarray:
    """Where the ids stand in their order, equal ones in place; narrow ids are sorted digit by digit."""
    return np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")


class Gru:
    NAMES = ("x", "uzr", "un", "wc", "bc", "wo", "bo")

    def __init__(self, size: int, hidden: int, p: dict[str, np.ndarray]):
        self.size, self.hidden, self.p = size, hidden, p
        self.classes = -(-size // CLASS)

    @classmethod
    def new(cls, counts: np.ndarray, hidden: int, seed: int = 7) -> Gru:
        """Starts as the unigram model of ``counts`` (by id)."""
        r, m = np.random.default_rng(seed), len(counts)
        c = -(-m // CLASS)
        mass = np.zeros(c * CLASS)
        mass[:m] = counts + 0.1
        by_class = mass.reshape(c, CLASS).sum(1)
        with np.errstate(divide="ignore"):
            bo = np.maximum(np.log(mass / np.repeat(by_class, CLASS)), -60.0)
        p = {
            "x": r.normal(0, 0.3, (m, 3 * hidden)), "uzr": r.normal(0, hidden**-0.5, (hidden, 2 * hidden)), "un": r.normal(0, hidden**-0.5, (hidden, hidden)),
            "wc": np.zeros((hidden, c)), "bc": np.log(by_class / by_class.sum()), "wo": np.zeros((c, hidden, CLASS)), "bo": bo.reshape(c, CLASS),
        }
        p["x"][:, :hidden] -= 1.0  # the update gate starts mostly closed: the state remembers
        return cls(m, hidden, {k: v.astype(f32) for k, v in p.items()})

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def with_vector(self, v: np.ndarray) -> Gru:
        out, at = {}, 0
        for k in self.NAMES:
            n = self.p[k].size
            out[k] = v[at : at + n].reshape(self.p[k].shape).astype(f32)
            at += n
        return Gru(self.size, self.hidden, out)

    # ---------------------------------------------------------------- forward

    def states(self, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States [T, B, H] after each input; ``keep`` is 0 where a document begins."""
        n, un = self.hidden, self.p["un"]
        steps, lanes = inputs.shape
        gates = np.stack([self.p["uzr"][:, :n], self.p["uzr"][:, n:]])
        a = np.take(self.p["x"].reshape(-1, 3, n).transpose(1, 0, 2).copy(), inputs, axis=1)
        out, whole = np.empty((steps, lanes, n), h.dtype), keep.all(1)
        for t in range(steps):
            if not whole[t]:
                h = h * keep[t][:, None]
            g = h @ gates
            g += a[:2, t]
            np.negative(g, g)
            np.exp(g, g)
            g += 1
            np.reciprocal(g, g)
            rh = g[1] * h
            new = rh @ un
            new += a[2, t]
            np.tanh(new, new)
            if tape is not None:
                tape.append((h, g, rh, new))
            after = out[t]
            np.subtract(new, h, after)
            after *= g[0]
            after += h
            h = after
        return out

    def output(self, h: np.ndarray, ids: np.ndarray, grad: bool = False):
        """Natural log P(id) for rows of states; with ``grad`` also the gradients of the mean loss."""
        p, n = self.p, len(ids)
        order = sorted_places(ids, self.size)  # by class: rows of one class lie together
        h, cls, within = h[order], ids[order] // CLASS, ids[order] % CLASS
        rows = np.arange(n)
        lc = h @ p["wc"]  # states are within -1..1 and log shares below 0: no exponential overflows
        lc += p["bc"]
        mine = rows * self.classes + cls  # where each row's class stands
        at = lc.ravel().take(mine)
        np.exp(lc, lc)
        s = lc @ np.ones(self.classes, lc.dtype)
        logp = at - np.log(s)
        own = rows * CLASS
        starts, one = np.searchsorted(cls, np.arange(self.classes + 1)), np.ones(CLASS, lc.dtype)
        if grad:
            lc *= (1 / (s * n))[:, None]
            lc.ravel()[mine] -= 1 / n
            g = {"wc": h.T @ lc, "bc": np.ones(n, lc.dtype) @ lc, "wo": np.zeros_like(p["wo"]), "bo": np.zeros_like(p["bo"])}
            dh = lc @ p["wc"].T
        for c in np.flatnonzero(np.diff(starts)):
            i = slice(starts[c], starts[c + 1])
            lo = h[i] @ p["wo"][c]
            lo += p["bo"][c]
            k = own[i] - own[starts[c]]
            k += within[i]
            at = lo.ravel().take(k)
            np.exp(lo, lo)
            s = lo @ one
            logp[i] += at - np.log(s)
            if grad:
                lo *= (1 / (s * n))[:, None]
                lo.ravel()[k] -= 1 / n
                np.matmul(h[i].T, lo, g["wo"][c])
                g["bo"][c] = np.ones(len(lo), lo.dtype) @ lo
                dh[i] += lo @ p["wo"][c].T
        back = np.empty(n, np.int64)
        back[order] = rows
        return (logp[back], dh[back], g) if grad else logp[back]

    # ---------------------------------------------------------------- training

    def gradients(self, inputs, keep, h0, ids, real):
        """Gradients of one window and the state after it; ``real`` marks the tokens that count."""
        n, (steps, lanes) = self.hidden, inputs.shape
        tape: list = []
        hs = self.states(inputs, keep, h0, tape)
        flat = np.flatnonzero(real.ravel())
        _, dflat, g = self.output(hs.reshape(-1, n)[flat], ids.ravel()[flat], grad=True)
        dh_out = np.zeros((steps * lanes, n), hs.dtype)
        dh_out[flat] = dflat
        dh_out = dh_out.reshape(steps, lanes, n)
        uz, ur, un = self.p["uzr"][:, :n].T.copy(), self.p["uzr"][:, n:].T.copy(), self.p["un"].T.copy()
        da, whole = np.empty((3, steps, lanes, n), hs.dtype), keep.all(1)
        dh = np.zeros((lanes, n), hs.dtype)
        for t in range(steps - 1, -1, -1):
            h, gates, rh, new = tape[t]
            z, r = gates
            shut = 1 - gates
            dh += dh_out[t]
            dz, dr, dnew = da[0, t], da[1, t], da[2, t]
            np.multiply(new, new, dnew)
            np.subtract(1, dnew, dnew)
            dnew *= dh
            dnew *= z
            drh = dnew @ un
            np.subtract(new, h, dz)
            dz *= dh
            np.multiply(drh, h, dr)
            dh *= shut[0]
            drh *= r
            dh += drh
            shut *= gates
            dz *= shut[0]
            dr *= shut[1]
            dh += dz @ uz
            dh += dr @ ur
            if not whole[t]:
                dh *= keep[t][:, None]
        before = np.stack([x[0] for x in tape]).reshape(-1, n)
        flat_da = da.reshape(3, -1, n)
        g["un"] = np.stack([x[2] for x in tape]).reshape(-1, n).T @ flat_da[2]
        g["uzr"] = np.concatenate([before.T @ flat_da[0], before.T @ flat_da[1]], 1)
        order = sorted_places(inputs.ravel(), self.size)
        rows = inputs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g["x"] = (rows[first], np.add.reduceat(flat_da.take(order, axis=1).transpose(1, 0, 2).reshape(-1, 3 * n), first, axis=0))
        return g, hs[-1]


class Adagrad:
    def __init__(self, model: Gru, rate: float):
        self.m, self.rate = model, rate
        self.seen = {k: np.full(v.shape, 1e-8, f32) for k, v in model.p.items()}

    def apply(self, g: dict) -> None:
        for k, v in g.items():
            at, d = v if isinstance(v, tuple) else (Ellipsis, v)  # the rows of embeddings that the window reads
            d = np.clip(d, -0.05, 0.05)
            seen = self.seen[k][at] + d * d
            self.seen[k][at] = seen
            np.sqrt(seen, seen)
            d /= seen
            d *= self.rate
            self.m.p[k][at] -= d


def longest_first(docs: Iterable[np.ndarray], most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, document) of those that have tokens; about ``most`` tokens wait, and the longest that waits comes next."""
    heap: list[tuple[int, int, np.ndarray]] = []
    waiting = 0
    for i, d in enumerate(docs):
        if not len(d):
            continue
        heapq.heappush(heap, (-len(d), i, d))
        waiting += len(d)
        while waiting > most:
            n, j, longest = heapq.heappop(heap)
            waiting += n
            yield j, longest
    while heap:
        yield heapq.heappop(heap)[1:]


def windows(docs: Iterable[np.ndarray], start: int, most: int = LANES) -> Iterator[tuple]:
    """Yields (inputs, keep, targets, real, owner, lanes) for windows of WINDOW steps over all lanes still going.

    Each document's inputs are ``start`` and then its tokens but the last; owner is the document's place in ``docs``.
    ``lanes`` are the window's lanes, as places among those of the window before (all of them in the first one).
    """
    source = longest_first(docs, HELD_TOKENS)
    held: list[list] = []  # for each lane: document, next token, place in docs
    last: list[int] = []
    for i, d in source:
        held.append([d, 0, i])
        if len(held) == most:
            break
    lanes = np.arange(len(held))
    while held:
        y, owner = np.zeros((len(held), WINDOW), np.int32), np.zeros((len(held), WINDOW), np.int64)
        keep, real = np.ones((len(held), WINDOW), f32), np.ones((len(held), WINDOW), bool)
        going = []
        for k, lane in enumerate(held):
            d, p, i = lane
            to = p + WINDOW
            if p and to <= len(d):  # the window lies within the lane's document
                y[k] = d[p:to]
                owner[k] = i
                lane[1] = to
                going.append(k)
                continue
            at = 0
            while at < WINDOW:
                d, p, i = lane
                if p == len(d):
                    i, d = next(source, (-1, None))
                    if d is None:
                        real[k, at:] = False
                        break
                    lane[:], p = (d, 0, i), 0
                if not p:
                    keep[k, at] = 0
                n = min(WINDOW - at, len(d) - p)
                y[k, at : at + n] = d[p : p + n]
                owner[k, at : at + n] = i
                lane[1] = p + n
                at += n
            else:
                going.append(k)
        if not real.any():
            return  # every lane's document ended with the window before
        x = np.empty_like(y)
        x[:, 1:] = y[:, :-1]
        x[:, 0] = last if len(last) else start
        x[keep == 0] = start
        yield x.T, keep.T, y.T, real.T, owner.T, lanes
        lanes = np.array(going, np.int64)
        last = y[lanes, -1]
        held = [held[k] for k in going]


def trained(model: Gru, docs: Iterable[np.ndarray], start: int, opt: Adagrad) -> int:
    """One pass; every window takes a step and carries the state. Returns the tokens of the steps."""
    h, done = None, 0
    for x, keep, y, real, _, lanes in windows(docs, start):
        h = np.zeros((x.shape[1], model.hidden), f32) if h is None else h[lanes]
        g, h = model.gradients(x, keep, h, y, real)
        opt.apply(g)
        done += int(real.sum())
    return done


def scored(model: Gru, docs: Iterable[np.ndarray], start: int) -> Iterator[tuple[int, float]]:
    """(place, natural log-likelihood) of each document of at least one token, as soon as its last token is read."""
    h, sums = None, {}
    for x, keep, y, real, owner, lanes in windows(docs, start):
        h = np.zeros((x.shape[1], model.hidden), f32) if h is None else h[lanes]
        hs = model.states(x, keep, h)
        h = hs[-1]
        real, owner = real.T.ravel(), owner.T.ravel()  # lane by lane: a document's tokens lie together
        flat = np.flatnonzero(real)
        logp = model.output(hs.transpose(1, 0, 2).reshape(-1, model.hidden)[flat], y.T.ravel()[flat])
        whose = owner[flat]
        first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        for i, s in zip(whose[first].tolist(), np.add.reduceat(logp.astype(np.float64), first).tolist(), strict=True):
            sums[i] = sums.get(i, 0.0) + s
        open_ = set(owner.reshape(-1, WINDOW)[real.reshape(-1, WINDOW)[:, -1], -1].tolist())
        for i in [i for i in sums if i not in open_]:
            yield i, sums.pop(i)
    yield from sums.items()


def log_likelihoods(model: Gru, docs: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log-likelihood of each document."""
    out = np.zeros(len(docs))
    for i, s in scored(model, docs, start):
        out[i] = s
    return out
