"""A gated recurrent unit with a class-factored softmax, trained by truncated backpropagation, in NumPy.

Symbols are the head words, CLASSES classes of PER_CLASS words each in order of frequency, and after them one symbol
for each further class, whose words share it. Numbers from SYMBOLS on are the words of further classes by frequency. The
output gives the class by a softmax over all classes, and the word of a head class by a softmax over that class; a word
of a further class by a softmax at each node of its path in the class's tree (`Tree`), so that the state decides about
every word that has a number. What a symbol of a further class stands for beyond these is left to the caller.

Documents are laid end to end in streams that advance side by side. The state is zeroed where a document starts and is
carried from window to window, so that a document is read whole; gradients stop at the start of a window.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASSES, PER_CLASS, FURTHER, HIDDEN = 8, 32, 9, 16
HEAD = CLASSES * PER_CLASS
SYMBOLS, ALL_CLASSES = HEAD + FURTHER, CLASSES + FURTHER
# Children of a node as a power of two, nodes with weights, and input rows for words of further classes.
FAN_BITS, SLOTS, INPUTS = 4, 1_024, 4_096
FAN = 1 << FAN_BITS
SHAPES = {
    "x": (SYMBOLS + INPUTS, 3 * HIDDEN),
    "u": (HIDDEN, 3 * HIDDEN),
    "c": (HIDDEN, ALL_CLASSES),
    "cb": (ALL_CLASSES,),
    "w": (CLASSES, HIDDEN, PER_CLASS),
    "wb": (CLASSES, PER_CLASS),
    "t": (SLOTS, FAN, HIDDEN),
}
NEVER, HALF = -30.0, np.float32(0.5)
LANES, WINDOW, RATE = 256, 16, 0.2
SCORE_LANES, SCORE_WINDOW = 512, 64
PIECE, CROWD = 2_048, 8


def shared(places: np.ndarray, room: int) -> np.ndarray:
    """Numbers below `room`: half of it for the first places, one each, and half for all others by hash."""
    half = room // 2
    return np.where(places < half, places, half + ((places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % half)


class Tree:
    """Of each further class a tree with its words as leaves, in order; FAN a node, children start from their words' counts.

    The SLOTS // 2 nodes of the largest counts have weights of their own, others share theirs by hash. Starts are exact.
    """

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        """Symbols (ascending) and counts (none zero) of the words from SYMBOLS on."""
        self.symbols = symbols.astype(np.int16)
        which, first, sizes = np.unique(symbols, return_index=True, return_counts=True)
        self.first, self.depth = np.zeros(FURTHER, np.int64), np.zeros(FURTHER, np.int64)
        self.first[which - HEAD] = first
        self.depth[which - HEAD] = [max(1, -(-int(n - 1).bit_length() // FAN_BITS)) for n in sizes]
        self.base = np.zeros((FURTHER, int(self.depth.max(initial=1))), np.int64)
        nodes = 0
        for c, n in zip((which - HEAD).tolist(), sizes.tolist()):
            for level in range(self.depth[c]):
                self.base[c, level] = nodes
                nodes += ((n - 1) >> (FAN_BITS * int(self.depth[c] - level))) + 1
        mass = np.zeros(nodes * FAN)
        for at, node, child in self.paths(np.arange(len(symbols))):
            mass += np.bincount(node * FAN + child, counts[at], nodes * FAN)
        mass = mass.reshape(nodes, FAN)
        whole = mass.sum(1)
        with np.errstate(divide="ignore"):  # children without words
            self.start = np.log(mass / whole[:, None]).astype(np.float32)
        self.slots = np.empty(nodes, np.int16)
        self.slots[np.argsort(-whole, kind="stable")] = shared(np.arange(nodes), SLOTS)

    def paths(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By level (place in words, node, child) of the way from the class to these words."""
        kinds = self.symbols[words].astype(np.int64) - HEAD
        place, depth, found = words - self.first[kinds], self.depth[kinds], []
        for level in range(int(depth.max(initial=0))):
            at = np.flatnonzero(depth > level)
            own = place[at] >> (FAN_BITS * (depth[at] - 1 - level))
            found.append((at, self.base[:, level].take(kinds[at]) + (own >> FAN_BITS), own & (FAN - 1)))
        return found


def input_rows(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < SYMBOLS, symbols, SYMBOLS + shared(np.maximum(symbols - SYMBOLS, 0), INPUTS))


def class_of(symbols: np.ndarray) -> np.ndarray:
    """Class of each symbol, in 16 bits, which sort fast."""
    return np.where(symbols < HEAD, symbols // PER_CLASS, symbols - HEAD + CLASSES).astype(np.int16)


class Model:
    """Parameters and the sums of squared gradients that scale their steps."""

    def __init__(self, values: dict[str, np.ndarray], squares: dict[str, np.ndarray] | None = None, tree: Tree | None = None):
        self.values, self.tree = values, tree
        self.squares = squares or {k: np.full(s, 1e-3, np.float32) for k, s in SHAPES.items()}

    @classmethod
    def initial(cls, symbol_counts: np.ndarray, seed: int, tree: Tree | None = None) -> Model:
        """Small random weights; biases are the logarithms of counts, so that an untrained model is a unigram one."""
        rng = np.random.default_rng(seed)
        draw = lambda k, width: (rng.standard_normal(SHAPES[k]) * width).astype(np.float32)
        values = {"x": draw("x", 0.1), "u": draw("u", HIDDEN**-0.5), "c": draw("c", 0.05), "w": draw("w", 0.05)}
        head = symbol_counts[:HEAD].reshape(CLASSES, PER_CLASS).astype(np.float64)
        each = np.append(head.sum(1), symbol_counts[HEAD:])
        values["cb"] = np.log((each + 1) / (each + 1).sum()).astype(np.float32)
        values["wb"] = np.where(head > 0, np.log(np.maximum(head, 1) / np.maximum(head.sum(1, keepdims=True), 1)), NEVER).astype(np.float32)
        values["t"] = np.zeros(SHAPES["t"], np.float32)
        return cls(values, tree=tree)

    def flat(self) -> np.ndarray:
        return np.concatenate([d[k].reshape(-1) for d in (self.values, self.squares) for k in SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray, tree: Tree | None = None) -> Model:
        parts, at = [], 0
        for _ in range(2):
            parts.append({})
            for k, shape in SHAPES.items():
                n = int(np.prod(shape))
                parts[-1][k] = flat[at : at + n].reshape(shape).astype(np.float32)
                at += n
        return cls(*parts, tree)

    def step(self, gradients: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        """One adaptive step; of some tables only these rows have a gradient."""
        for k, g in gradients.items():
            at = rows.get(k, slice(None))
            self.squares[k][at] += g * g
            self.values[k][at] -= RATE * g / np.sqrt(self.squares[k][at])


class Streams:
    """Documents (arrays of symbols, none empty) dealt into `lanes` streams, the longest first, longest stream first."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        lanes = min(lanes, len(docs))
        loads, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
            load, k = heapq.heappop(loads)
            dealt[k].append(i)
            heapq.heappush(loads, (load + len(docs[i]), k))
        dealt.sort(key=lambda d: -sum(len(docs[i]) for i in d))
        self.order = [i for d in dealt for i in d]
        self.lengths = np.array([sum(len(docs[i]) for i in d) for d in dealt], np.int64)
        self.symbols = np.concatenate([docs[i] for i in self.order]).astype(np.int32)
        self.doc_starts = np.cumsum([0] + [len(docs[i]) for i in self.order])[:-1]
        starts = np.zeros(len(self.symbols), bool)
        starts[self.doc_starts] = True
        self.first = np.cumsum(self.lengths) - self.lengths
        before = np.append(self.symbols[:1], self.symbols[:-1])
        before[starts] = 0  # the end symbol comes before every document
        self.before, self.keep = input_rows(before).astype(np.int16), (~starts).astype(np.float32)

    def windows(self, size: int):
        """(places of the tokens, which of them are real) as time by lane, for the lanes that are not yet done."""
        for at in range(0, int(self.lengths[0]), size):
            lanes = int(np.searchsorted(-self.lengths, -at, side="left"))
            steps = min(size, int(self.lengths[0]) - at)
            t = at + np.arange(steps)[:, None]
            real = t < self.lengths[None, :lanes]
            yield np.where(real, self.first[None, :lanes] + t, self.first[None, :lanes]), real


class Saved:
    """What the backward pass needs of the forward one: states before each step, gates, new states and their recurrent part."""

    def __init__(self, steps: int, lanes: int):
        self.h, self.new, self.g = (np.empty((steps, lanes, HIDDEN), np.float32) for _ in range(3))
        self.gates = np.empty((steps, lanes, 2 * HIDDEN), np.float32)


def forward(model: Model, x: np.ndarray, keep: np.ndarray, h: np.ndarray, saved: Saved | None = None) -> np.ndarray:
    """States after every step of a window."""
    u, n = model.values["u"], HIDDEN
    inputs, out = model.values["x"].take(x, axis=0), np.empty((*x.shape, HIDDEN), np.float32)
    saved = saved or Saved(1, x.shape[1])
    for t, a in enumerate(inputs):
        at = t % len(saved.h)  # without a backward pass one step's room is enough
        gates, new, own = saved.gates[at], saved.new[at], saved.h[at]
        np.multiply(h, keep[t][:, None], out=own)
        g = own @ u
        saved.g[at] = g[:, 2 * n :]
        np.add(a[:, : 2 * n], g[:, : 2 * n], out=gates)
        gates *= HALF
        np.tanh(gates, out=gates)
        gates *= HALF
        gates += HALF
        np.multiply(gates[:, n:], g[:, 2 * n :], out=new)
        new += a[:, 2 * n :]
        np.tanh(new, out=new)
        h = np.subtract(own, new, out=out[t])
        h *= gates[:, :n]
        h += new
    return out


def backward(model: Model, x: np.ndarray, keep: np.ndarray, saved: Saved, dout: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the input table (its rows are the second result) and of the recurrent weights.

    All factors of a state's gradient are known before the walk back, so that a step is one product and one sum.
    """
    back, n = model.values["u"].T, HIDDEN
    z, r = saved.gates[..., :n], saved.gates[..., n:]
    to_new = (1 - z) * (1 - saved.new * saved.new)
    factors = np.empty((*x.shape, 3, n), np.float32)
    factors[..., 0, :] = (saved.h - saved.new) * z * (1 - z)
    factors[..., 1, :] = to_new * saved.g * r * (1 - r)
    factors[..., 2, :] = to_new * r
    dg, dstates = np.empty((*x.shape, 3, n), np.float32), np.empty((*x.shape, n), np.float32)
    dh = np.zeros((x.shape[1], n), np.float32)
    for t in range(len(x) - 1, -1, -1):
        now = np.add(dh, dout[t], out=dstates[t])
        np.multiply(now[:, None], factors[t], out=dg[t])
        dh = now * z[t]
        dh += dg[t].reshape(-1, 3 * n) @ back
        dh *= keep[t][:, None]
    recurrent = saved.h.reshape(-1, n).T @ dg.reshape(-1, 3 * n)
    dg[..., 2, :] = dstates * to_new  # the input adds to the new state itself, not through the gate r
    order = np.argsort(x, axis=None, kind="stable")
    sorted_x = x.reshape(-1)[order]
    first = np.flatnonzero(np.diff(sorted_x, prepend=-1))
    by_symbol = np.ascontiguousarray(dg.reshape(-1, 3 * n).take(order, axis=0).T)  # sums along rows are the faster ones
    return {"x": np.add.reduceat(by_symbol, first, axis=1).T, "u": recurrent}, sorted_x[first]


def _softmax(logits: np.ndarray, chosen: np.ndarray, learn: bool) -> np.ndarray:
    """Log-probability of the chosen row of each column; with `learn`, logits become the gradient of the loss."""
    columns = np.arange(logits.shape[1])
    logits -= logits.max(axis=0)
    logp = logits[chosen, columns]
    np.exp(logits, out=logits)
    sums = logits.sum(axis=0)
    logp -= np.log(sums)
    if learn:
        logits /= sums
        logits[chosen, columns] -= 1
    return logp


def _in_tree(model: Model, h: np.ndarray, words: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of these words (from 0) in their classes; with `learn`, gradients by states and by slots, which are the last.

    Nodes that CROWD words of a level pass on average are products of matrices, one a node; others take their weights a word.
    """
    tree, weights = model.tree, model.values["t"]
    total, dh, by_slot, touched = np.zeros(len(words)), np.zeros_like(h), [], []
    for at, node, child in tree.paths(words):
        slot = tree.slots.take(node)
        order = np.argsort(slot, kind="stable")
        at, node, child, slot = at[order], node[order], child[order], slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        slots, states = slot[first], h.take(at, axis=0)
        groups = list(zip(slots.tolist(), first.tolist(), [*first[1:].tolist(), len(at)])) if CROWD * len(first) < len(at) else None
        logits = tree.start.take(node, axis=0).astype(h.dtype, copy=False)
        if groups:
            for k, a, b in groups:
                logits[a:b] += states[a:b] @ weights[k].T
        else:
            own = weights.take(slot, axis=0)
            logits += np.matmul(own, states[:, :, None])[:, :, 0]
        rows = np.arange(len(at))
        logits -= logits.max(axis=1, keepdims=True)
        found = logits[rows, child]
        np.exp(logits, out=logits)
        sums = logits.sum(axis=1, keepdims=True)
        total[at] += found - np.log(sums[:, 0])
        if not learn:
            continue
        logits /= sums
        logits[rows, child] -= 1
        if groups:
            back, by = np.empty_like(states), np.empty((len(groups), FAN, HIDDEN), h.dtype)
            for n, (k, a, b) in enumerate(groups):
                g = logits[a:b]
                back[a:b] = g @ weights[k]
                by[n] = g.T @ states[a:b]
        else:
            back = np.matmul(logits[:, None, :], own)[:, 0, :]
            products = (logits[:, :, None] * states[:, None, :]).reshape(len(at), -1)
            by = np.add.reduceat(products, first, axis=0).reshape(-1, FAN, HIDDEN)
        dh[at] += back  # a level has a word once
        by_slot.append(by)
        touched.append(slots)
    if not learn:
        return total, dh, h, words
    slots, place = np.unique(np.concatenate(touched), return_inverse=True)
    gradient = np.zeros((len(slots), FAN, HIDDEN), h.dtype)
    a = 0
    for by in by_slot:
        gradient[place[a : a + len(by)]] += by
        a += len(by)
    return total, dh, gradient, slots


def output(model: Model, h: np.ndarray, symbols: np.ndarray, learn: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Log-probability of each symbol after its state; with `learn`, gradients of the loss by weights and states.

    Tokens stand in the order of their classes and logits in rows, so that sums run along whole rows. Of the tree's
    weights only the rows "slots" have a gradient.
    """
    v, words = model.values, symbols
    if model.tree is not None:
        symbols = np.where(words < SYMBOLS, words, model.tree.symbols.take(np.maximum(words - SYMBOLS, 0), mode="clip") if len(model.tree.symbols) else words)
    kinds = class_of(symbols)
    order = np.argsort(kinds, kind="stable")
    h, symbols, kinds, words = h.take(order, axis=0), symbols[order], kinds[order], words[order]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    cuts = np.searchsorted(kinds, np.arange(CLASSES + 1, dtype=np.int16))
    logits = v["c"].T @ h.T + v["cb"][:, None]
    sorted_logp = _softmax(logits, kinds, learn)
    gradients, dh = {}, np.zeros(0, np.float32)
    if learn:
        dh = logits.T @ v["c"].T
        gradients = {"c": (logits @ h).T, "cb": logits.sum(axis=1), "w": np.zeros(SHAPES["w"], np.float32), "wb": np.zeros(SHAPES["wb"], np.float32)}
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if a == b:
            continue
        inner = v["w"][k].T @ h[a:b].T + v["wb"][k][:, None]
        sorted_logp[a:b] += _softmax(inner, symbols[a:b] - k * PER_CLASS, learn)
        if learn:
            gradients["w"][k], gradients["wb"][k] = (inner @ h[a:b]).T, inner.sum(axis=1)
            dh[a:b] += inner.T @ v["w"][k].T
    far = np.flatnonzero(words >= SYMBOLS)
    for a in range(0, len(far), max(len(far), 1) if learn else PIECE):
        some = far[a:] if learn else far[a : a + PIECE]
        logp, dstates, by_slot, slots = _in_tree(model, h.take(some, axis=0), (words[some] - SYMBOLS).astype(np.int64), learn)
        sorted_logp[some] += logp
        if learn:
            dh[some] += dstates
            gradients |= {"t": by_slot, "slots": slots}
    return sorted_logp[back], gradients, dh.take(back, axis=0) if learn else dh


def train(model: Model, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> None:
    """One pass over the documents, a step for each window."""
    if not docs:
        return
    streams = Streams(docs, lanes)
    h = np.zeros((len(streams.lengths), HIDDEN), np.float32)
    for at, real in streams.windows(window):
        h = h[: at.shape[1]]
        x, keep, saved = streams.before[at], streams.keep[at], Saved(*at.shape)
        states = forward(model, x, keep, h, saved)
        _, gradients, dh = output(model, states[real], streams.symbols[at[real]], learn=True)
        dout = np.zeros_like(states)
        dout[real] = dh
        recurrent, rows = backward(model, x, keep, saved, dout)
        touched = {"x": rows, "t": gradients.pop("slots", None)}
        tokens = real.sum(dtype=np.float32)
        # A node's few words would take long steps in the short windows that a long document leaves at the end.
        model.step({k: g / (max(tokens, np.float32(LANES * WINDOW)) if k == "t" else tokens) for k, g in (gradients | recurrent).items()}, touched)
        h = states[-1]


def log_probabilities(model: Model, docs: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Natural log-probability of the symbols of each document."""
    if not docs:
        return np.zeros(0)
    streams = Streams(docs, lanes)
    found = np.zeros(len(streams.symbols))
    h = np.zeros((len(streams.lengths), HIDDEN), np.float32)
    for at, real in streams.windows(window):
        states = forward(model, streams.before[at], streams.keep[at], h[: at.shape[1]])
        h, places = states[-1], at[real]
        found[places] = output(model, states[real], streams.symbols[places])[0]
    out = np.zeros(len(docs))
    out[streams.order] = np.add.reduceat(found, streams.doc_starts)
    return out
