"""A causal self-attention model over symbols, in numpy: forward pass, gradients and training.

A text is a stream of symbols cut into blocks of ``BLOCK``. The window of a block is the block
before it and itself, so windows overlap by half, every position is a query exactly once and
sees between ``BLOCK`` and 2 * ``BLOCK`` - 1 earlier symbols. The output is a distribution
over classes of the next symbol: logits are the log of a count-based prior for the last symbol
plus a linear map of the hidden layer, which sees the attended values and the last two symbols.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16
#: Widths of keys, values and the hidden layer.
KEY, VALUE, HIDDEN = 16, 16, 24
PAD, BEGIN = 0, 1
_AWAY = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_SEEN = _AWAY >= 0

Params = dict[str, np.ndarray]


def start_params(symbols: int, classes: int, seed: int = 42) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype("f4")
    return {
        "key": draw(symbols, KEY, scale=0.3), "key_before": draw(symbols, KEY, scale=0.3), "query": draw(symbols, KEY, scale=0.3),
        "value": draw(symbols, VALUE, scale=0.3), "hidden": draw(symbols, HIDDEN, scale=0.3), "hidden_before": draw(symbols, HIDDEN, scale=0.3),
        "mix": draw(VALUE, HIDDEN, scale=0.3), "out": draw(HIDDEN, classes, scale=0.02), "distance": np.zeros(2 * BLOCK, "f4"),
    }


def layout(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """First place of each text in a stream of whole blocks, an empty block before each text; and the stream's size."""
    blocks = 1 + -(-lengths // BLOCK)
    ends = np.cumsum(blocks)
    return (ends - blocks + 1) * BLOCK, int(ends[-1]) * BLOCK if len(ends) else 0


def stream(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts laid out in blocks, ``PAD`` elsewhere; and the place of each symbol."""
    first, size = layout(lengths)
    place = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(symbols))
    out = np.full(size, PAD, np.int64)
    out[place] = symbols
    return out, place


def _window(p: Params, x: np.ndarray, blocks: np.ndarray) -> dict[str, np.ndarray]:
    """Masked attention of the given query blocks of a stream (rows of ``BLOCK`` symbols) up to the logits' hidden layer."""
    m = len(blocks)
    flat = x.reshape(-1)
    at = (blocks[:, None] * BLOCK - BLOCK) + np.arange(2 * BLOCK)
    sym, before = flat[at], flat[at - 1]
    before[:, 0] = np.where(at[:, 0] > 0, before[:, 0], PAD)
    own, own_before = sym[:, BLOCK:], before[:, BLOCK:]
    keys = p["key"][sym] + p["key_before"][before]
    values, queries = p["value"][sym], p["query"][own]
    weight = np.matmul(queries, keys.transpose(0, 2, 1))
    np.exp(weight, out=weight)
    weight *= np.exp(p["distance"])[np.where(_SEEN, _AWAY, 0)] * _SEEN
    weight[sym[:, 0] == PAD, :, :BLOCK] = 0
    total = weight.sum(axis=2, keepdims=True)
    seen = np.matmul(weight, values) / total
    hidden = seen.reshape(m * BLOCK, VALUE) @ p["mix"]
    hidden += (p["hidden"][own] + p["hidden_before"][own_before]).reshape(m * BLOCK, HIDDEN)
    np.maximum(hidden, 0, out=hidden)
    return {"sym": sym, "before": before, "own": own, "own_before": own_before, "keys": keys, "values": values, "queries": queries,
            "weight": weight, "total": total, "seen": seen, "hidden": hidden}


#: ``_power`` of x * _SCALE + _ZERO is close to exp(x).
_SCALE, _ZERO = np.float32(2**23 / np.log(2)), np.float32(127 * 2**23)


def _power(x: np.ndarray) -> np.ndarray:
    """2**(x / 2**23 - 127), linear between powers of two: within 7 % of it, and always positive."""
    return x.astype(np.int32).view(np.float32)


class Scorer:
    """Forward pass of fixed parameters over whole streams: keys and values once for each position, tables side by side.

    Its exponentials are ``_power``, whose scale and offset lie in the tables; the shares are
    divided by their sum, so they remain a distribution. ``train`` bounds the attention's scores.
    """

    def __init__(self, p: Params, prior: np.ndarray, first: int):
        self.own = np.concatenate([p["key"], p["value"], np.ones((len(prior), 1), "f4"), p["query"] * _SCALE, p["hidden"]], axis=1)
        self.before = np.concatenate([p["key_before"], p["hidden_before"]], axis=1)
        self.mask = (np.exp(p["distance"])[np.where(_SEEN, _AWAY, 0)] * _SEEN).astype("f4")
        self.mix, self.out, self.prior = p["mix"], p["out"] * _SCALE, prior * _SCALE + _ZERO
        #: Sums over all classes and over the first ones.
        self.sums = np.stack([np.ones(prior.shape[1]), np.arange(prior.shape[1]) < first], axis=1).astype("f4")

    def __call__(self, x: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log share of the class ``goal`` and of the first classes at every position of a stream that begins with an empty block."""
        n = len(x) // BLOCK - 1
        own, before = self.own[x], self.before[np.concatenate([[PAD], x[:-1]])]
        own[:, :KEY] += before[:, :KEY]
        at = KEY + VALUE + 1
        step, width = own.strides
        view = lambda low, high: np.lib.stride_tricks.as_strided(own[:, low:high], (n, 2 * BLOCK, high - low), (BLOCK * step, step, width))
        queries = own[BLOCK:, at : at + KEY].reshape(n, BLOCK, KEY)
        weight = np.matmul(queries, view(0, KEY).transpose(0, 2, 1))
        weight += _ZERO
        weight = _power(weight)
        weight *= self.mask
        weight[x[: n * BLOCK : BLOCK] == PAD, :, :BLOCK] = 0
        seen = np.matmul(weight, view(KEY, at)).reshape(n * BLOCK, VALUE + 1)
        hidden = (seen[:, :VALUE] / np.maximum(seen[:, VALUE:], 1e-30)) @ self.mix
        hidden += own[BLOCK:, at + KEY :]
        hidden += before[BLOCK:, KEY:]
        np.maximum(hidden, 0, out=hidden)
        logits = hidden @ self.out
        logits += self.prior[x[BLOCK:]]
        np.clip(logits, 40 * 2**23, 210 * 2**23, out=logits)
        logits = _power(logits)
        total = logits @ self.sums
        picked = logits[np.arange(n * BLOCK), goal[BLOCK:]]
        none = np.zeros(BLOCK, "f4")
        return np.concatenate([none, np.log(picked / total[:, 0])]), np.concatenate([none, np.log(total[:, 1] / total[:, 0])])


def _scatter(size: int, rows: np.ndarray, grad: np.ndarray) -> np.ndarray:
    rows, grad = rows.reshape(-1), grad.reshape(rows.size, -1)
    by = np.argsort(rows.astype(np.int16) if size < 1 << 15 else rows, kind="stable")
    rows = rows[by]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    out = np.zeros((size, grad.shape[1]), "f4")
    out[rows[first]] = np.add.reduceat(grad[by], first, axis=0)
    return out


def gradients(p: Params, prior: np.ndarray, x: np.ndarray, blocks: np.ndarray, target: np.ndarray) -> tuple[Params, float]:
    """Gradients of the mean negative log-likelihood of the classes ``target`` (-1: no target) of these blocks' positions."""
    g, chosen, _ = _gradients(p, prior, x, blocks, target, 1)
    return g, float(-chosen.mean())


def _gradients(p: Params, prior: np.ndarray, x: np.ndarray, blocks: np.ndarray, target: np.ndarray, first: int) -> tuple[Params, np.ndarray, np.ndarray]:
    """Gradients, and the log shares of the target and of the ``first`` classes at the positions that have a target."""
    w = _window(p, x, blocks)
    m, size = len(blocks), len(prior)
    prob = w["hidden"] @ p["out"]
    prob += prior[w["own"].reshape(-1)]
    prob -= prob.max(axis=1, keepdims=True)
    np.exp(prob, out=prob)
    prob /= prob.sum(axis=1, keepdims=True)
    row = np.flatnonzero(target >= 0)
    chosen = np.log(prob[row, target[row]] + 1e-30)
    before = np.log(prob[:, :first].sum(axis=1)[row] + 1e-30)
    prob[row, target[row]] -= 1
    prob[target < 0] = 0
    prob /= len(row)
    g: Params = {"out": w["hidden"].T @ prob}
    d_hidden = (prob @ p["out"].T) * (w["hidden"] > 0)
    seen = w["seen"].reshape(m * BLOCK, VALUE)
    g["mix"] = seen.T @ d_hidden
    d_seen = (d_hidden @ p["mix"].T).reshape(m, BLOCK, VALUE)
    share = w["weight"]
    share /= w["total"]
    d_score = np.matmul(d_seen, w["values"].transpose(0, 2, 1))
    d_score -= (d_seen * w["seen"]).sum(axis=2, keepdims=True)
    d_score *= share
    # tables that are looked up by the same symbols are added up together
    at_own = _scatter(size, w["own"], np.concatenate([d_hidden, np.matmul(d_score, w["keys"]).reshape(m * BLOCK, KEY)], axis=1))
    g["hidden"], g["query"] = at_own[:, :HIDDEN], at_own[:, HIDDEN:]
    g["hidden_before"] = _scatter(size, w["own_before"], d_hidden)
    d_keys = np.matmul(d_score.transpose(0, 2, 1), w["queries"])
    at_sym = _scatter(size, w["sym"], np.concatenate([np.matmul(share.transpose(0, 2, 1), d_seen), d_keys], axis=2))
    g["value"], g["key"] = at_sym[:, :VALUE], at_sym[:, VALUE:]
    g["key_before"] = _scatter(size, w["before"], d_keys)
    g["distance"] = np.bincount(np.where(_SEEN, _AWAY, 0).reshape(-1), (d_score.sum(axis=0) * _SEEN).reshape(-1), 2 * BLOCK).astype("f4")
    return g, chosen, before


class Learner:
    """Adam on parameters that it changes in place."""

    def __init__(self, p: Params):
        self.p, self.steps = p, 0
        self.mean = {k: np.zeros_like(v) for k, v in p.items()}
        self.square = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, prior: np.ndarray, x: np.ndarray, blocks: np.ndarray, target: np.ndarray, rate: float, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """One step; the log shares of ``_gradients``, from before it."""
        g, chosen, before = _gradients(self.p, prior, x, blocks, target, first)
        self.steps += 1
        now = rate * min(1, self.steps / 20)
        for k, p in self.p.items():
            self.mean[k] += 0.1 * (g[k] - self.mean[k])
            self.square[k] += 0.01 * (g[k] ** 2 - self.square[k])
            p -= now * (self.mean[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.square[k] / (1 - 0.99**self.steps)) + 1e-8)
        return chosen, before


def bound(p: Params) -> None:
    """Keep the scores of the attention within the range of exp."""
    reach = np.linalg.norm(p["query"], axis=1).max() * (np.linalg.norm(p["key"], axis=1).max() + np.linalg.norm(p["key_before"], axis=1).max())
    p["query"] *= min(1, 40 / max(reach, 1e-6))


def train(
    prior: np.ndarray, classes: int, symbols: np.ndarray, targets: np.ndarray, lengths: np.ndarray, *,
    steps: int = 400, batch: int = 256, rate: float = 0.01, seed: int = 42,
) -> tuple[Params, list[float]]:
    """Adam over random blocks of the texts; symbols and target classes of all texts one after another."""
    p = start_params(len(prior), classes, seed)
    x, place = stream(symbols, lengths)
    goal = np.full(len(x), -1, np.int64)
    goal[place] = targets
    goal = goal.reshape(-1, BLOCK)
    usable = np.flatnonzero((goal >= 0).any(axis=1))
    rng, losses, learner = np.random.default_rng(seed), [], Learner(p)
    for step in range(1, steps + 1 if len(usable) else 1):
        blocks = rng.choice(usable, min(batch, len(usable)), replace=False)
        chosen, _ = learner.step(prior, x, blocks, goal[blocks].reshape(-1), rate * max(0.02, 1 - step / steps))
        losses.append(float(-chosen.mean()))
    bound(p)
    return p, losses
