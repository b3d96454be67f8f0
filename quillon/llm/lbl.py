"""A log-bilinear model of symbol sequences in numpy, trained by noise-contrastive estimation.

The POSITIONS symbols before a place, each with its vector and its position's weights, add up to a prediction vector.
The HEAD most frequent symbols are groups of their own, the others are dealt into groups of consecutive symbols.
Products of the prediction with the vectors of all groups, and with those of all symbols of a group, each with a bias,
go through a softmax.  A symbol's probability is its group's times its own inside the group: normalised exactly, at a
cost of about the square root of the number of symbols.

Training tells what follows from noise, at both levels: NOISE groups from the unigram distribution of groups, and NOISE
symbols from that inside a group, are drawn for each batch.  Steps are Adagrad's, with one rate for each row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WIDTH, POSITIONS, NOISE, HEAD = 32, 3, 16, 32
#: Adagrad's rate, and the weight of the squared vector of a symbol against the sum over all its occurrences.
RATE, RIDGE = 0.1, 3.0
#: Places that a matrix product of scoring takes at once.
BATCH = 4096
#: A log-weight that stands for symbols that don't occur.
ABSENT = np.float32(-40)
#: The symbol of the end of a text, which also stands before its start.
END = 0


def pad(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts one behind the other with POSITIONS ends before each, and which places are the texts' own."""
    flat = np.full(len(symbols) + POSITIONS * len(lengths), END, np.int32)
    real = np.ones(len(flat), bool)
    starts = np.cumsum(lengths + POSITIONS) - lengths - POSITIONS
    real[(starts[:, None] + np.arange(POSITIONS)).reshape(-1)] = False
    flat[real] = symbols
    return flat, real


def log_of(weights: np.ndarray) -> np.ndarray:
    return np.where(weights > 0, np.log(np.maximum(weights, 1e-30)), ABSENT).astype(np.float32)


def symbols_for(bits: int) -> int:
    """Symbols of a model whose groups, but for the head, hold 2 ** bits."""
    return HEAD + (1 << bits)


@dataclass
class Shape:
    """How symbols are dealt into groups."""

    symbols: int
    size: int = field(init=False)  # symbols in a group behind the head
    groups: int = field(init=False)

    def __post_init__(self) -> None:
        bits = (self.symbols - HEAD).bit_length() - 1
        self.size = 1 << (bits + 1) // 2
        self.groups = HEAD + (self.symbols - HEAD) // self.size

    def group_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < HEAD, symbol, HEAD + (symbol - HEAD) // self.size)

    def rows(self, group: int) -> slice:
        start = HEAD + (group - HEAD) * self.size
        return slice(start, start + self.size)

    def by_group(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all groups, and counts inside the groups behind the head."""
        inside = counts[HEAD:].reshape(-1, self.size).astype(float)
        return np.concatenate([counts[:HEAD], inside.sum(axis=1)]), inside


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


@dataclass
class Model:
    context: np.ndarray  # symbols x WIDTH
    position: np.ndarray  # POSITIONS x WIDTH, the nearest first
    group: np.ndarray  # groups x WIDTH
    group_bias: np.ndarray
    target: np.ndarray  # symbols x WIDTH; unused in the head
    bias: np.ndarray

    @staticmethod
    def unigram(counts: np.ndarray, seed: int = 7) -> Model:
        """The model before training: probabilities in proportion to counts."""
        shape = Shape(len(counts))
        groups, inside = shape.by_group(counts)
        inside = np.where(inside.sum(axis=1, keepdims=True) > 0, inside, 1)
        rng = np.random.default_rng(seed)
        vectors = lambda n: (rng.standard_normal((n, WIDTH)) * 0.1).astype(np.float32)
        return Model(
            vectors(len(counts)),
            (np.ones((POSITIONS, WIDTH)) / (1 + np.arange(POSITIONS))[:, None]).astype(np.float32),
            vectors(shape.groups),
            log_of(shares(groups)) if groups.any() else np.zeros(shape.groups, np.float32),
            vectors(len(counts)),
            np.concatenate([np.zeros(HEAD, np.float32), log_of(shares(inside)).reshape(-1)]),
        )

    @property
    def shape(self) -> Shape:
        return Shape(len(self.context))

    def copy(self) -> Model:
        return Model(*(a.copy() for a in self.arrays()))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.position, self.group, self.group_bias, self.target, self.bias]

    def predictions(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all symbols, and the prediction for each place from POSITIONS on."""
        x = self.context.take(flat, axis=0)
        n = len(flat) - POSITIONS
        out = x[POSITIONS - 1 : POSITIONS - 1 + n] * self.position[0]
        for k in range(1, POSITIONS):
            out += x[POSITIONS - 1 - k : POSITIONS - 1 - k + n] * self.position[k]
        return x, out

    def log_probabilities(self, flat: np.ndarray, real: np.ndarray, window: int = 8 * BATCH) -> np.ndarray:
        """Natural logarithm of the probability of the symbol at each place; 0 where a place is not real."""
        out, shape = np.zeros(len(flat), np.float32), self.shape
        for at in range(POSITIONS, len(flat), window):
            _, h = self.predictions(flat[at - POSITIONS : at + window])
            symbol = flat[at : at + window]
            order = np.argsort(symbol.astype(np.int16) if shape.symbols < 1 << 15 else symbol, kind="stable")
            order = order[real[at : at + window][order]]
            h, symbol = h.take(order, axis=0), symbol[order]
            of_group = shape.group_of(symbol)
            found = np.empty(len(order), np.float32)
            for a in range(0, len(order), BATCH):
                found[a : a + BATCH] = log_softmax(h[a : a + BATCH], self.group, self.group_bias, of_group[a : a + BATCH])
            stops = np.searchsorted(of_group, np.arange(HEAD, shape.groups + 1))
            for k in np.flatnonzero(np.diff(stops)).tolist():
                rows = shape.rows(HEAD + k)
                part = slice(int(stops[k]), int(stops[k + 1]))
                found[part] += log_softmax(h[part], self.target[rows], self.bias[rows], symbol[part] - rows.start)
            out[at + order] = found
        return out


def log_softmax(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen column's log-probability in each row of a product."""
    scores = h @ vectors.T
    scores += bias
    own = scores[np.arange(len(scores)), chosen]
    if len(scores) and np.abs(scores).max() > 80:  # beyond what single precision can add up
        top = scores.max(axis=1)
        scores -= top[:, None]
        own = own - top
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    return np.divide(x, 1 + x, out=x)


class Trainer:
    """Steps of noise-contrastive estimation on a model, in place.  counts: of each symbol, for the noise."""

    def __init__(self, model: Model, counts: np.ndarray, seed: int, squares: list[np.ndarray] | None = None):
        self.model, self.shape, self.rng = model, model.shape, np.random.default_rng(seed)
        groups, inside = self.shape.by_group(counts)
        self.group_steps, self.steps = np.cumsum(shares(groups)), np.cumsum(shares(inside), axis=1)
        self.group_odds, self.odds = log_of(NOISE * shares(groups)), log_of(NOISE * shares(inside))
        self.ridge = (RIDGE / np.maximum(counts, 1)).astype(np.float32)
        self.squares = squares or [np.full(len(a), 1e-6, np.float32) for a in model.arrays()]

    def draw(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Noise: the columns drawn, and how often each."""
        times = np.bincount(np.minimum(np.searchsorted(steps, self.rng.random(NOISE), side="right"), len(steps) - 1))
        drawn = np.flatnonzero(times)
        return drawn, times[drawn].astype(np.float32)

    def move(self, k: int, rows, gradient: np.ndarray) -> None:
        table, squares = self.model.arrays()[k], self.squares[k]
        wide = gradient.ndim > 1
        squares[rows] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1] if wide else np.square(gradient)
        speed = RATE / np.sqrt(squares[rows])
        table[rows] += gradient * (speed[:, None] if wide else speed)

    def learn(self, flat: np.ndarray, real: np.ndarray, batch: int) -> None:
        """Steps over all places of padded texts."""
        for at in range(POSITIONS, len(flat), batch):
            self.step(flat[at - POSITIONS : at + batch], real[at : at + batch])

    def contrast(self, h: np.ndarray, own: np.ndarray, own_bias: np.ndarray, drawn: np.ndarray, times: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How strongly each place pulls its own vector, and pushes each drawn one away.  Biases are those of the model
        less the odds of noise."""
        pull = sigmoid(-(np.einsum("ij,ij->i", h, own) + own_bias))
        push = h @ drawn.T
        push += bias
        sigmoid(push)
        push *= -times
        return pull, push

    def step(self, flat: np.ndarray, real: np.ndarray) -> None:
        m, shape = self.model, self.shape
        x, h = m.predictions(flat)
        symbol = flat[POSITIONS:]
        order = np.argsort(symbol.astype(np.int16) if shape.symbols < 1 << 15 else symbol, kind="stable")
        order = order[real[order]]
        if not len(order):
            return
        hs, symbol = h.take(order, axis=0), symbol[order]
        first = np.flatnonzero(np.diff(symbol, prepend=-1))
        of_group = shape.group_of(symbol)
        # Groups.
        drawn, times = self.draw(self.group_steps)
        bias = m.group_bias - self.group_odds
        own = m.group.take(of_group, axis=0)
        pull, push = self.contrast(hs, own, bias[of_group], m.group[drawn], times, bias[drawn])
        back = push @ m.group[drawn]
        own *= pull[:, None]
        back += own
        up, up_bias = np.zeros_like(m.group), np.zeros_like(m.group_bias)
        group_first = np.flatnonzero(np.diff(of_group, prepend=-1))
        used = of_group[group_first]
        up[used], up_bias[used] = sums(hs, pull, group_first), np.add.reduceat(pull, group_first)
        up[drawn] += push.T @ hs
        up_bias[drawn] += push.sum(axis=0)
        # Symbols inside their groups, for those behind the head.
        tail = int(np.searchsorted(symbol, HEAD))
        gradient, gradient_bias = np.zeros_like(m.target), np.zeros_like(m.bias)
        if tail < len(symbol):
            bias = m.bias[HEAD:] - self.odds.reshape(-1)
            own = m.target.take(symbol[tail:], axis=0)
            own_bias = bias[symbol[tail:] - HEAD]
            inner = np.empty(len(own), np.float32)
            stops = [*group_first[np.searchsorted(group_first, tail) :].tolist(), len(symbol)]
            for a, b in zip(stops, stops[1:]):
                rows = shape.rows(int(of_group[a]))
                drawn, times = self.draw(self.steps[int(of_group[a]) - HEAD])
                drawn += rows.start
                inner[a - tail : b - tail], push = self.contrast(hs[a:b], own[a - tail : b - tail], own_bias[a - tail : b - tail], m.target[drawn], times, bias[drawn - HEAD])
                back[a:b] += push @ m.target[drawn]
                gradient[drawn] += push.T @ hs[a:b]
                gradient_bias[drawn] += push.sum(axis=0)
            own *= inner[:, None]
            back[tail:] += own
            own_first = first[np.searchsorted(first, tail) :] - tail
            used = symbol[tail:][own_first]
            gradient[used] += sums(hs[tail:], inner, own_first)
            gradient_bias[used] += np.add.reduceat(inner, own_first)
        # What vectors weigh, in proportion to how many of the symbol's occurrences are here.
        seen, times = symbol[first], np.diff(first, append=len(symbol))
        cost = (self.ridge[seen] * times)[:, None]
        gradient[seen] -= cost * m.target[seen]
        # Contexts: what a place's prediction asks of the symbols before it.
        whole = np.zeros_like(h)
        whole[order] = back
        ask, weights = np.zeros_like(x), np.empty_like(m.position)
        for k in range(POSITIONS):
            before = slice(POSITIONS - 1 - k, POSITIONS - 1 - k + len(h))
            ask[before] += whole * m.position[k]
            weights[k] = np.einsum("ij,ij->j", whole, x[before])
        asked = sums(ask[POSITIONS:].take(order, axis=0), None, first) - cost * m.context[seen]
        touched = np.flatnonzero(gradient_bias)
        self.move(0, seen, asked)
        self.move(1, slice(None), weights)
        self.move(2, slice(None), up)
        self.move(3, slice(None), up_bias)
        self.move(4, touched, gradient[touched])
        self.move(5, touched, gradient_bias[touched])


def sums(rows: np.ndarray, weights: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """Weighted sums of runs of rows, which begin at `first`: products with rows of weights for long runs, additions for
    short ones."""
    out = np.empty((len(first), rows.shape[1]), np.float32)
    stops = np.append(first[1:], len(rows))
    long = stops - first > 32
    for k in np.flatnonzero(long).tolist():
        part = rows[first[k] : stops[k]]
        out[k] = (weights[first[k] : stops[k]] if weights is not None else np.ones(len(part), np.float32)) @ part
    short = np.flatnonzero(~long)
    if len(short):
        lengths = (stops - first)[short]
        begin = np.cumsum(lengths) - lengths
        places = np.repeat(first[short] - begin, lengths) + np.arange(int(lengths.sum()))
        some = rows.take(places, axis=0)
        if weights is not None:
            some *= weights[places, None]
        out[short] = np.add.reduceat(some, begin)
    return out
