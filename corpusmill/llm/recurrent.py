"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output.

Documents are laid end to end in parallel lanes; the state is carried from window to window
of a lane and set to zero where a document begins, so a document of any length is read as one
sequence. A token's probability is that of its class times that within its class, each a small
softmax. Output biases start from counts, so that an untrained model is the unigram model.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np

LANES = 512
STEPS = 32
LOSS_EVERY = 1
# Weights stay within this, so that no exponential overflows (state units lie in [-1, 1]).
BOUND = 4.0


class Shape:
    """Sizes of the model: ``classes`` * ``members`` token ids and ``hidden`` state units."""

    def __init__(self, hidden: int = 16, classes: int = 32, members: int = 32):
        self.hidden, self.classes, self.members = hidden, classes, members
        self.vocabulary = classes * members
        self.parts = {
            "X": (self.vocabulary, 3 * hidden),
            "U": (hidden, 3 * hidden),
            "c": (3 * hidden,),
            "Wc": (hidden, classes),
            "bc": (classes,),
            "Wo": (classes, hidden, members),
            "bo": (classes, members),
        }
        self.size = sum(int(np.prod(s)) for s in self.parts.values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        found, at = {}, 0
        for name, shape in self.parts.items():
            n = int(np.prod(shape))
            found[name] = flat[at : at + n].reshape(shape)
            at += n
        return found

    def start(self, counts: np.ndarray, seed: int = 7) -> np.ndarray:
        """Parameters whose output is the unigram distribution of ``counts`` (0: never)."""
        rng = np.random.default_rng(seed)
        flat = np.zeros(self.size, np.float32)
        p = self.views(flat)
        p["X"][:] = rng.normal(0, 0.3, p["X"].shape)
        p["U"][:] = rng.normal(0, 0.7 / np.sqrt(self.hidden), p["U"].shape)
        # A state is kept unless the model learns to drop it.
        p["c"][self.hidden : 2 * self.hidden] = 2.0
        table = counts.reshape(self.classes, self.members).astype(np.float64)
        with np.errstate(divide="ignore"):
            p["bc"][:] = np.maximum(np.log(table.sum(1) / max(table.sum(), 1e-9)), -30)
            p["bo"][:] = np.maximum(np.log(table / np.maximum(table.sum(1, keepdims=True), 1e-9)), -30)
        return flat


class Lanes:
    """Documents dealt to lanes, longest first to the shortest lane; lanes by falling length."""

    def __init__(self, docs: list[np.ndarray], lanes: int | None = None):
        if lanes is None:
            lanes = lanes_for(sum(map(len, docs)))
        heap = [(0, i) for i in range(min(lanes, max(1, len(docs))))]
        dealt: list[list[int]] = [[] for _ in heap]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            length, lane = heapq.heappop(heap)
            dealt[lane].append(d)
            heapq.heappush(heap, (length + len(docs[d]), lane))
        dealt.sort(key=lambda lane: -sum(len(docs[d]) for d in lane))
        order = [d for lane in dealt for d in lane]
        sizes = np.array([len(docs[d]) for d in order], np.int64)
        self.lengths = np.array([sum(len(docs[d]) for d in lane) for lane in dealt], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # Lanes lie one after the other; a last place stands for what is past a lane's end.
        self.laid = np.concatenate([docs[d] for d in order] + [np.array([-1])], dtype=np.int32)
        self.owners = np.append(np.repeat(np.array(order, np.int64), sizes), -1)
        self.first = np.zeros(len(self.laid), bool)
        self.first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True

    @property
    def tokens(self) -> list[np.ndarray]:
        return np.split(self.laid[:-1], self.starts[1:])

    def windows(self, steps: int = STEPS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number, tokens, documents, whether a document goes on) of each window; -1 past a lane's end.

        The lanes with anything left are always the first ones.
        """
        for number, at in enumerate(range(0, int(self.lengths.max(initial=0)), steps)):
            active = int((self.lengths > at).sum())
            places = np.arange(at, at + steps)[:, None] + self.starts[:active]
            if self.lengths[active - 1] < at + steps:
                places[np.arange(at, at + steps)[:, None] >= self.lengths[:active]] = len(self.laid) - 1
            yield number, self.laid.take(places), self.owners.take(places), (~self.first.take(places)).astype(np.float32)


def lanes_for(tokens: int) -> int:
    """Enough lanes to fill the arithmetic, few enough that lanes are long."""
    return int(min(LANES, max(16, tokens // 2_048)))


class Rooms:
    """Arrays used again by the next window, so that their memory is not asked for anew."""

    def __init__(self):
        self.held: dict = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: type) -> np.ndarray:
        size, held = math.prod(shape), self.held.get(name)
        if held is None or held.dtype != dtype or len(held) < size:
            held = self.held[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)


def _by_step(mask: np.ndarray) -> list[np.ndarray]:
    """The lanes marked at each step."""
    steps, lanes = np.nonzero(mask)
    return np.split(lanes, np.searchsorted(steps, np.arange(1, len(mask)))) if len(lanes) else [lanes] * len(mask)


def forward(p: dict, tokens: np.ndarray, goes_on: np.ndarray, state: np.ndarray, keep: bool, rooms: Rooms | None = None):
    """States before each token, the state after the last, and what backpropagation needs.

    Each gate has a block of its own, so that a step's arithmetic runs over whole blocks. Weights
    of the sigmoid gates are halved (exactly) for sigmoid(x) = tanh(x / 2) / 2 + 1 / 2. The
    states lie in ``rooms`` and last until the next window.
    """
    (steps, lanes), hidden, rooms = tokens.shape, state.shape[1], rooms or Rooms()
    kind, vocabulary = p["U"].dtype, len(p["X"])
    half = np.array([0.5, 0.5, 1], kind)[:, None, None]
    inputs = p["X"].reshape(vocabulary, 3, hidden).transpose(1, 0, 2) * half
    weights = p["U"].reshape(hidden, 3, hidden).transpose(1, 0, 2) * half
    bias = rooms("bias", (3, lanes, hidden), kind)
    bias[:] = p["c"].reshape(3, 1, hidden) * half
    ids = np.maximum(tokens, 0)[:, None, :] + np.arange(0, 3 * vocabulary, vocabulary)[:, None]
    given = inputs.reshape(-1, hidden).take(ids, axis=0, out=rooms("given", (steps, 3, lanes, hidden), kind), mode="clip")
    states = rooms("states", (steps + 1, lanes, hidden), kind)
    saved = rooms("saved", (steps if keep else 1, 4, lanes, hidden), kind)
    starts = _by_step(goes_on == 0)
    states[0] = state
    for t in range(steps):
        state, after, own = states[t], states[t + 1], saved[t if keep else 0]
        (r, z, gn, n), gates, products = own, own[:2], own[:3]
        if len(starts[t]):
            state[starts[t]] = 0
        np.matmul(state, weights, out=products)
        products += bias
        gates += given[t, :2]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(r, gn, out=n)
        n += given[t, 2]
        np.tanh(n, out=n)
        np.subtract(state, n, out=after)
        after *= z
        after += n
    return states[:steps], states[steps].copy(), saved if keep else None


def output(p: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None = None, rooms: Rooms | None = None):
    """Natural log probability of each target; with ``grads``, their sums and the states' gradient.

    Everything is laid out by target class once, so that each class works on a slice.
    """
    classes, members = p["bo"].shape
    rooms, size = rooms or Rooms(), len(targets)
    kind = (targets // members).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    kind, member = kind[order].astype(np.intp), (targets % members)[order]
    states = states.take(order, axis=0, out=rooms("by class", states.shape, states.dtype), mode="clip")
    every = np.arange(size)
    logits = np.matmul(states, p["Wc"], out=rooms("logits", (size, classes), p["Wc"].dtype))
    logits += p["bc"]
    np.exp(logits, out=logits)
    total = logits @ np.ones(classes, logits.dtype)
    share = logits.ravel()[every * classes + kind] / total
    back = None
    if grads is not None:
        logits /= total[:, None]
        logits.ravel()[every * classes + kind] -= 1
        grads["Wc"] += states.T @ logits
        grads["bc"] += logits.sum(0)
        back = np.matmul(logits, p["Wc"].T, out=rooms("back by class", states.shape, logits.dtype))
    inner, ones = rooms("inner", (size, members), logits.dtype), np.ones(members, logits.dtype)
    ends = np.cumsum(np.bincount(kind, minlength=classes))
    slices = [(k, slice(int(b - n), int(b))) for k, (b, n) in enumerate(zip(ends, np.diff(ends, prepend=0), strict=True)) if n]
    for k, own in slices:
        np.matmul(states[own], p["Wo"][k], out=inner[own])
        inner[own] += p["bo"][k]
    np.exp(inner, out=inner)
    total = inner @ ones
    share *= inner.ravel()[every * members + member] / total
    found = np.empty(size, share.dtype)
    found[order] = np.log(np.maximum(share, 1e-37))
    if grads is None:
        return found, None
    inner /= total[:, None]
    inner.ravel()[every * members + member] -= 1
    for k, own in slices:
        grads["Wo"][k] += states[own].T @ inner[own]
        grads["bo"][k] += inner[own].sum(0)
        back[own] += inner[own] @ p["Wo"][k].T
    place = np.empty(size, np.intp)
    place[order] = every
    return found, back.take(place, axis=0, out=rooms("back", back.shape, back.dtype), mode="clip")


def window_gradient(
    shape: Shape, p: dict, tokens: np.ndarray, goes_on: np.ndarray, state: np.ndarray, phase: int, every: int = LOSS_EVERY, rooms: Rooms | None = None
):
    """(summed gradient, tokens counted, state after) of one window; loss at every ``every``-th token."""
    (steps, lanes), hidden, rooms = tokens.shape, shape.hidden, rooms or Rooms()
    before, after, saved = forward(p, tokens, goes_on, state, True, rooms)
    kind = before.dtype
    flat = np.zeros(shape.size, np.float32)
    grads = shape.views(flat)
    counted = np.zeros(tokens.shape, bool)
    counted[phase % every :: every] = True
    counted &= tokens >= 0
    n = int(counted.sum())
    if n == counted.size:
        back = output(p, before.reshape(-1, hidden), tokens.ravel(), grads, rooms)[1].reshape(before.shape)
    else:
        back = np.zeros_like(before)
        if n:
            back[counted] = output(p, before[counted], tokens[counted], grads, rooms)[1]
    # By gate for the inputs' gradient, by lane for the state's.
    da_all = rooms("da", (3, steps, lanes, hidden), kind)
    dg_all = rooms("dg", (steps, lanes, 3, hidden), kind)
    dh, part = np.zeros_like(after), np.empty_like(after)
    starts, ended = _by_step(goes_on == 0), _by_step(tokens < 0)
    for t in range(steps - 1, -1, -1):
        r, z, gn, n_ = saved[t]
        dr, dz, dan = da_all[:, t]
        dg = dg_all[t]
        if len(ended[t]):
            dh[ended[t]] = 0
        np.subtract(1, z, out=part)
        np.multiply(dh, part, out=dan)
        np.subtract(before[t], n_, out=dz)
        dz *= dh
        dz *= z
        dz *= part
        np.multiply(n_, n_, out=part)
        np.subtract(1, part, out=part)
        dan *= part
        np.multiply(dan, gn, out=dr)
        dr *= r
        np.subtract(1, r, out=part)
        dr *= part
        np.multiply(dan, r, out=part)
        dg[:, 0], dg[:, 1], dg[:, 2] = dr, dz, part
        dh *= z
        dh += np.matmul(dg.reshape(lanes, 3 * hidden), p["U"].T, out=part)
        dh += back[t]
        if len(starts[t]):
            dh[starts[t]] = 0
    dg_flat = dg_all.reshape(-1, 3 * hidden)
    grads["U"] += before.reshape(-1, hidden).T @ dg_flat
    grads["c"] += dg_flat.sum(0)
    ids = np.maximum(tokens, 0).ravel()
    # Small integers are sorted in linear time.
    order = np.argsort(ids.astype(np.uint16) if shape.vocabulary <= 1 << 16 else ids, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0]))
    rows = order[:, None] + np.arange(0, 3 * len(order), len(order))
    da = da_all.reshape(-1, hidden).take(rows, axis=0, out=rooms("sorted", (*rows.shape, hidden), kind), mode="clip")
    grads["X"][ids[order][heads]] += np.add.reduceat(da.reshape(-1, 3 * hidden), heads, axis=0)
    return flat, n, after


class Adam:
    def __init__(self, size: int, rate: float = 0.01):
        self.first, self.second, self.step, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, rate

    def move(self, flat: np.ndarray, gradient: np.ndarray) -> None:
        self.step += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.01 * (gradient * gradient - self.second)
        rate = self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        flat -= np.float32(rate) * self.first / (np.sqrt(self.second) + np.float32(1e-8))


def train(shape: Shape, flat: np.ndarray, docs: list[np.ndarray], optimizer: Adam, lanes: int | None = None) -> int:
    """One pass over ``docs``, changing ``flat``; returns the number of tokens read.

    Windows in which few lanes have anything left are gathered until they make half a full
    window's tokens, lest one long document steer the model alone.
    """
    laid = Lanes(docs, lanes)
    p, state, rooms = shape.views(flat), None, Rooms()
    enough = len(laid.lengths) * STEPS // LOSS_EVERY // 2
    gathered, counted = np.zeros(shape.size, np.float32), 0

    def move() -> None:
        optimizer.move(flat, gathered / max(counted, enough))
        for name in ("Wc", "Wo"):
            np.clip(p[name], -BOUND, BOUND, out=p[name])
        for name in ("bc", "bo"):
            np.minimum(p[name], BOUND, out=p[name])

    for number, tokens, _, goes_on in laid.windows():
        active = tokens.shape[1]
        state = np.zeros((active, shape.hidden), np.float32) if state is None else state[:active]
        gradient, n, state = window_gradient(shape, p, tokens, goes_on, state, number, rooms=rooms)
        gathered += gradient
        counted += n
        if counted >= enough and counted:
            move()
            gathered[:] = 0
            counted = 0
    # The rest is learnt from too, by its share of a step's tokens.
    if counted:
        move()
    return int(sum(map(len, docs)))


def score(shape: Shape, flat: np.ndarray, docs: list[np.ndarray], lanes: int | None = None) -> np.ndarray:
    """Natural log probability of each document."""
    p, state, found, rooms = shape.views(flat), None, np.zeros(len(docs)), Rooms()
    for _, tokens, owners, goes_on in Lanes(docs, lanes).windows():
        active = tokens.shape[1]
        state = np.zeros((active, shape.hidden), np.float32) if state is None else state[:active]
        before, state, _ = forward(p, tokens, goes_on, state, False, rooms)
        before, real = before.reshape(-1, shape.hidden), tokens.ravel() >= 0
        tokens, owners = tokens.ravel(), owners.ravel()
        if not real.all():
            before, tokens, owners = before[real], tokens[real], owners[real]
        logs, _ = output(p, before, tokens, rooms=rooms)
        found += np.bincount(owners, logs.astype(np.float64), len(docs))
    return found
