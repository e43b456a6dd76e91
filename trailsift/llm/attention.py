"""A causal self-attention language model in numpy, small enough to score every token of a corpus.

The next token's distribution is a mixture of ``COMPONENTS`` distributions over the
vocabulary. A window's tokens attend to themselves and what stands before them (masked,
with a learned bias by distance); what they read, plus a direct term of the current token,
gives the mixture's gate. Queries, keys and values are functions of the token alone, so
they are tables, and since the components are normalised once, the probability of a token
is a dot product: no softmax over the vocabulary is needed when scoring.

Windows have ``WINDOW`` inputs, of which the last ``FRESH`` are scored; windows overlap, so
each token is scored once and sees at least WINDOW - FRESH tokens of context.

The gate is trained by Adam on the log likelihood, the components by online expectation
maximisation.
"""

from __future__ import annotations

import numpy as np

WINDOW, FRESH = 24, 16
HEAD, COMPONENTS = 16, 64
#: Windows in one step of training; share of the corpus unigram in every probability.
BATCH, UNIGRAM_SHARE = 256, 0.01
#: Windows of a text that are scored together, since each gathers what the next one needs.
RUN = 8
#: Windows whose arrays are worked on at once: they fit a core's cache.
_AT_ONCE = 32
_MASKED = np.float32(-1e9)
#: Scores and logits beyond this are held there, which keeps exp() finite.
_HIGHEST, _TINY = np.float32(60), np.float32(1e-30)
#: Window row of the scored inputs, and how far back each input of the window lies.
_BACK = (np.arange(WINDOW - FRESH, WINDOW)[:, None] - np.arange(WINDOW)[None, :])
#: Inputs of a window before its scored ones.
_CONTEXT = WINDOW - FRESH
#: Columns of a token's row of parameters.
_QUERY, _KEY = slice(0, HEAD), slice(HEAD, 2 * HEAD)
_VALUE = slice(2 * HEAD, 2 * HEAD + COMPONENTS)
_DIRECT = slice(2 * HEAD + COMPONENTS, 2 * HEAD + 2 * COMPONENTS)
_WIDTH = 2 * HEAD + 2 * COMPONENTS
_ONES = np.ones(COMPONENTS, np.float32)
#: Adam's decays a step, and how a step without a gradient goes on from the one before.
_FIRST, _SECOND = 0.9, 0.98
_COAST = _FIRST / _SECOND ** 0.5


class Attention:
    """``size`` tokens, of which ``size - 1`` closes and opens a text; ``unigram`` sums to 1."""

    NAMES = ("query", "key", "value", "direct", "counts")

    def __init__(self, unigram: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = len(unigram)
        self.unigram = unigram.astype(np.float32)
        self.query = (rng.standard_normal((size, HEAD)) * 0.3).astype(np.float32)
        self.key = (rng.standard_normal((size, HEAD)) * 0.3).astype(np.float32)
        self.value = (rng.standard_normal((size, COMPONENTS)) * 0.1).astype(np.float32)
        self.direct = (rng.standard_normal((size, COMPONENTS)) * 0.5).astype(np.float32)
        self.distance = np.linspace(0, -2, WINDOW).astype(np.float32)
        # Expected counts of each token in each component.
        self.counts = (unigram[:, None] * np.exp(rng.standard_normal((size, COMPONENTS)) * 0.5)).astype(np.float32)

    def components(self) -> np.ndarray:
        """(size, COMPONENTS): every column a distribution, none of whose entries is 0."""
        c = self.counts / np.maximum(self.counts.sum(axis=0), 1e-30)
        return ((1 - UNIGRAM_SHARE) * c + UNIGRAM_SHARE * self.unigram[:, None]).astype(np.float32)

    def table(self) -> np.ndarray:
        """(size, _WIDTH): queries, keys, values and direct terms, one row a token."""
        return np.concatenate([self.query, self.key, self.value, self.direct], axis=1)

    def probabilities(self, inputs, real, targets, components) -> np.ndarray:
        """P(target) for the FRESH scored places of each window. ``real`` is false before a text's start."""
        e, _ = _gates(self.table()[inputs], real, self.distance)
        e = e[:, 0]
        return (e * components[targets]).sum(axis=2) / e.sum(axis=2)

    def run_probabilities(self, runs: np.ndarray, real: np.ndarray, table: np.ndarray, components: np.ndarray):
        """runs (n, k * FRESH + _CONTEXT + 1): k windows each, one beginning FRESH after the other.
        Returns P of the targets at places _CONTEXT + 1 on, (n, k * FRESH)."""
        out = np.empty((len(runs), runs.shape[1] - _CONTEXT - 1), np.float32)
        for some in _parts(runs):
            ids = runs[some]
            e, _ = _gates(table.take(ids[:, :-1], axis=0), real[some, :-1], self.distance)
            e = e.reshape(-1, COMPONENTS)
            total = e @ _ONES
            e *= components.take(ids[:, _CONTEXT + 1:].ravel(), axis=0)
            np.divide(e @ _ONES, total, out=out[some].reshape(-1))
        return out

    def train(self, windows: np.ndarray, real: np.ndarray, passes: int = 1, rate: float = 0.01,
              floor: float = 0.002, seed: int = 5) -> "Attention":
        """windows (n, WINDOW + 1): inputs, and one more target at the end. Places that are not
        ``real`` stand before the start or after the end of a text.

        A step works on the rows of its own tokens. Adam would also move the others, by what is left of their
        last gradients; a row makes up for those steps when its token comes again, or at the end.
        """
        rng = np.random.default_rng(seed)
        table = self.table()
        size = len(table)
        first, second = np.zeros_like(table), np.zeros_like(table)
        around = np.zeros((2, WINDOW))  # moments of the distances
        seen = np.zeros(size, np.int64)  # the step a row is brought up to
        held, sums = 1.0, self.counts.sum(axis=0, dtype=float)  # counts are held * self.counts; their sums
        steps = max(1, -(-passes * len(windows) // BATCH))
        order = np.concatenate([rng.permutation(len(windows)) for _ in range(passes)])

        def coast(rows, step, lr):
            """Bring ``rows`` to the state after ``step`` steps, had the missing ones had no gradient."""
            gap = (step - seen[rows])[:, None].astype(np.float32)
            p, m, v = (x.take(rows, axis=0) for x in (table, first, second))
            if step:
                # Bias corrections are those of now.
                far = lr * _COAST * (1 - _COAST ** gap) / (1 - _COAST) * (1 - _SECOND ** step) ** 0.5 / (1 - _FIRST ** step)
                p -= far * m / (np.sqrt(v) + np.float32(1e-8))
                m *= np.float32(_FIRST) ** gap
                v *= np.float32(_SECOND) ** gap
            return p, m, v

        lr = rate
        for step in range(1, steps + 1):
            pick = order[(step - 1) * BATCH:step * BATCH]
            ok = real[pick]
            rows, place = _distinct(windows[pick], size)
            p, m, v = coast(rows, step - 1, lr)
            components = self._components_of(rows, held, sums)
            g, distance, found, used = _sums(place, ok, scored_places(ok), p, components, self.distance)
            # Components: counts move to the expected counts of the batch.
            speed = max(0.02, 1.0 / (step + 2) ** 0.6) if used else 0.0
            held *= 1 - speed
            found *= speed / max(used, 1)
            sums = sums * (1 - speed) + found.sum(axis=0, dtype=float)
            self.counts[rows] += found / np.float32(held)
            if held < 1e-12:
                self.counts *= np.float32(held)
                held = 1.0
            lr = floor + (rate - floor) * (1 - step / steps)
            g *= np.float32(1 / max(used, 1))
            far = lr * (1 - _SECOND ** step) ** 0.5 / (1 - _FIRST ** step)
            m *= np.float32(_FIRST)
            m += np.float32(1 - _FIRST) * g
            g *= g
            v *= np.float32(_SECOND)
            v += np.float32(1 - _SECOND) * g
            first[rows], second[rows] = m, v
            m *= np.float32(far)
            m /= np.sqrt(v, out=v) + np.float32(1e-8)
            p -= m
            table[rows], seen[rows] = p, step
            distance = distance / max(used, 1)
            around[0] += (1 - _FIRST) * (distance - around[0])
            around[1] += (1 - _SECOND) * (distance ** 2 - around[1])
            self.distance = (self.distance - far * around[0] / (np.sqrt(around[1]) + 1e-8)).astype(np.float32)
        for a in range(0, size, 1024):
            rows = np.arange(a, min(a + 1024, size))
            table[rows] = coast(rows, steps, lr)[0]
        self.counts *= np.float32(held)
        self.query, self.key, self.value, self.direct = (
            table[:, c].copy() for c in (_QUERY, _KEY, _VALUE, _DIRECT))
        return self

    def _components_of(self, rows: np.ndarray, held: float, sums: np.ndarray) -> np.ndarray:
        """The rows of ``components()``, counts being ``held * self.counts`` with column sums ``sums``."""
        c = self.counts[rows] * ((1 - UNIGRAM_SHARE) * held / np.maximum(sums, 1e-30)).astype(np.float32)
        c += np.float32(UNIGRAM_SHARE) * self.unigram[rows, None]
        return c

    def _gradients(self, ids, ok, components):
        """Of the mean negative log likelihood, as whole tables; the expected counts; how many places were scored."""
        g, distance, found, used = _sums(ids, ok, scored_places(ok), self.table(), components, self.distance)
        g /= max(used, 1)
        return {"query": g[:, _QUERY], "key": g[:, _KEY], "value": g[:, _VALUE], "direct": g[:, _DIRECT],
                "distance": distance / max(used, 1)}, found, used


def _parts(runs: np.ndarray):
    """Slices of about _AT_ONCE windows."""
    size = max(1, _AT_ONCE * FRESH // (runs.shape[1] - _CONTEXT - 1))
    return [slice(a, a + size) for a in range(0, len(runs), size)]


def _windows(x: np.ndarray, length: int, first: int = 0) -> np.ndarray:
    """A view of (n, places, columns) as windows: (n, k, length, columns), FRESH from each other."""
    x = x[:, first:]
    n, places, columns = x.shape
    a, b, c = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, (places - length) // FRESH + 1, length, columns), (a, FRESH * b, b, c))


def _gates(x: np.ndarray, real: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of parameters (n, places, _WIDTH) -> gates before they are divided by their sums
    (n, k, FRESH, COMPONENTS), and attention (n, k, FRESH, WINDOW)."""
    inside = _windows(x, WINDOW)
    score = np.matmul(inside[:, :, _CONTEXT:, _QUERY], inside[..., _KEY].swapaxes(2, 3))
    score += np.where(_BACK >= 0, distance[np.maximum(_BACK, 0)], _MASKED)
    if not real.all():
        score += np.where(_windows(real[:, :, None], WINDOW)[..., 0], np.float32(0), _MASKED)[:, :, None, :]
    np.exp(np.minimum(score, _HIGHEST, out=score), out=score)
    score /= score.sum(axis=3, keepdims=True) + _TINY
    logit = np.matmul(score, inside[..., _VALUE])
    logit += inside[:, :, _CONTEXT:, _DIRECT]
    np.exp(np.clip(logit, -_HIGHEST, _HIGHEST, out=logit), out=logit)
    return logit, score


def _sums(place, ok, scored, table, components, distance):
    """Sums over the scored places of windows: gradients by row of ``table`` and of the distances, and
    expected counts by row of ``components``; how many places were scored."""
    n, places = place.shape
    wide = _WIDTH + COMPONENTS
    rows = np.zeros((n, places, wide), np.float32)
    by_distance = np.zeros((FRESH, WINDOW))
    for some in _parts(place):
        ids, out = place[some], rows[some]
        x = table.take(ids[:, :-1], axis=0)
        e, a = _gates(x, ok[some, :-1], distance)
        inside, flat = _windows(x, WINDOW), e.reshape(-1, COMPONENTS)
        joint = components.take(ids[:, _CONTEXT + 1:].ravel(), axis=0)
        joint *= flat
        weight = scored[some].ravel().astype(np.float32)
        joint *= (weight / np.maximum(joint @ _ONES, _TINY))[:, None]
        flat *= (weight / (flat @ _ONES))[:, None]
        flat -= joint
        out[:, _CONTEXT + 1:, _WIDTH:] = joint.reshape(len(ids), -1, COMPONENTS)
        out[:, _CONTEXT:-1, _DIRECT] = flat.reshape(len(ids), -1, COMPONENTS)
        d_a = np.matmul(e, inside[..., _VALUE].swapaxes(2, 3))
        d_a -= np.einsum("nkij,nkij->nki", a, d_a)[..., None]
        d_a *= a
        at = _windows(out[:, :-1], FRESH, _CONTEXT)
        np.matmul(d_a, inside[..., _KEY], out=at[..., _QUERY])
        d_key = np.matmul(d_a.swapaxes(2, 3), inside[:, :, _CONTEXT:, _QUERY])
        d_value = np.matmul(a.swapaxes(2, 3), e)
        at[..., _KEY], at[..., _VALUE] = d_key[:, :, _CONTEXT:], d_value[:, :, _CONTEXT:]
        # The context of a window lies among the scored places of the one before.
        before = _windows(out[:, :_CONTEXT - FRESH - 1], _CONTEXT)
        before[..., _KEY] += d_key[:, :, :_CONTEXT]
        before[..., _VALUE] += d_value[:, :, :_CONTEXT]
        by_distance += d_a.sum(axis=(0, 1))
    found = _sum_by(place.ravel(), rows.reshape(-1, wide), len(table))
    lags = np.bincount(np.maximum(_BACK, 0).ravel(), by_distance.ravel(), WINDOW)
    return found[:, :_WIDTH], lags, found[:, _WIDTH:], int(scored.sum())


def _distinct(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and each id's place among them."""
    there = np.zeros(size, bool)
    there[ids] = True
    rows = np.flatnonzero(there)
    place = np.zeros(size, np.int64)
    place[rows] = np.arange(len(rows))
    return rows, place[ids]


def _sum_by(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``rows`` by id, (size, columns)."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    count = np.diff(np.r_[first, len(ids)])
    by = np.argsort(-count, kind="stable")
    first, count = first[by], count[by]
    # One row of every id at a time; the ids that have more are summed one by one.
    found = rows.take(order[first], axis=0)
    for k in range(1, 10):
        more = int(np.searchsorted(-count, -k, side="left"))
        found[:more] += rows.take(order[first[:more] + k], axis=0)
    for i in range(int(np.searchsorted(-count, -10, side="left"))):
        found[i] += np.add.reduce(rows.take(order[first[i] + 10:first[i] + count[i]], axis=0), axis=0)
    out[ids[first]] = found
    return out


def window_count(n_tokens: int) -> int:
    return -(-(n_tokens + 1) // FRESH)


def text_windows(tokens: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW + 1) ids and whether each place lies within the text.

    The text is opened and closed by ``closing``; window i scores the FRESH targets that
    follow input i * FRESH.
    """
    line = np.concatenate([[closing], tokens, [closing]]).astype(np.int64)
    at = (np.arange(window_count(len(tokens))) * FRESH)[:, None] + np.arange(-(WINDOW - FRESH), FRESH + 1)[None, :]
    real = (at >= 0) & (at < len(line))
    return line[np.clip(at, 0, len(line) - 1)], real


def text_line(tokens: np.ndarray, closing: int, outside: int) -> np.ndarray:
    """The opened and closed text with ``outside`` at both ends: window i of the text starts at i * FRESH."""
    length = (window_count(len(tokens)) - 1) * FRESH + WINDOW + 1
    line = np.full(length, outside, np.int64)
    first = WINDOW - FRESH
    line[first], line[first + 1 + len(tokens)] = closing, closing
    line[first + 1:first + 1 + len(tokens)] = tokens
    return line


def line_span(line: np.ndarray, first: int, end: int) -> np.ndarray:
    """The part of a ``text_line`` that holds its windows ``first`` to ``end - 1``."""
    return line[first * FRESH:(end - 1) * FRESH + WINDOW + 1]


def span_windows(span: np.ndarray) -> np.ndarray:
    """(n, WINDOW + 1) ids: the windows of a span."""
    return np.lib.stride_tricks.sliding_window_view(span, WINDOW + 1)[::FRESH]


def scored_places(real: np.ndarray) -> np.ndarray:
    """Which targets of windows or of runs of windows are scored."""
    return real[:, _CONTEXT + 1:] & real[:, _CONTEXT:-1]


def span_runs(spans: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans end to end, cut into runs of RUN windows: ids (n, RUN * FRESH + _CONTEXT + 1), which places are real,
    which targets are scored, and where each span's targets begin among all targets."""
    lengths = np.array([len(s) // FRESH + 1 for s in spans], np.int64) * FRESH
    starts = np.cumsum(lengths) - lengths
    step = RUN * FRESH
    line = np.full(-(-int(lengths.sum()) // step) * step + _CONTEXT + 1, outside, np.int64)
    for start, span in zip(starts.tolist(), spans):
        line[start:start + len(span)] = span
    real = line != outside
    counted = real.copy()  # what stands before a span's first target is context only
    counted[(starts[:, None] + np.arange(_CONTEXT + 1)).ravel()] = False
    line[~real] = 0
    cut = np.lib.stride_tricks.sliding_window_view
    scored = cut(counted[_CONTEXT + 1:] & real[_CONTEXT:-1], step)[::step]
    return cut(line, step + _CONTEXT + 1)[::step], cut(real, step + _CONTEXT + 1)[::step], scored, starts
