"""Plain numpy forms of the recursions, one read at a time: what tests hold the library against.

Scores of n bases have 2n(n+1) entries: row-major "to flip b from any state", then "to flop b from flip b", then "to
flop b from flop b". All recursions share the dense (step, to, from) form of ``dense``.
"""

from __future__ import annotations

import numpy as np

NEVER, FLOP_START = -1e30, -50000.0


def bases_of(n_scores: int) -> int:
    n = int(round(np.sqrt(0.25 + n_scores / 2) - 0.5))
    if 2 * n * (n + 1) != n_scores:
        raise ValueError(f"{n_scores} scores fit no alphabet")
    return n


def dense(scores: np.ndarray) -> np.ndarray:
    """(T, 2n, 2n) scores of going to a state from a state."""
    n = bases_of(scores.shape[1])
    out = np.full((len(scores), 2 * n, 2 * n), NEVER)
    out[:, :n, :] = scores[:, : 2 * n * n].reshape(-1, n, 2 * n)
    b = np.arange(n)
    out[:, n + b, b] = scores[:, 2 * n * n + b]
    out[:, n + b, n + b] = scores[:, 2 * n * n + n + b]
    return out


def undense(m: np.ndarray) -> np.ndarray:
    n = m.shape[1] // 2
    b = np.arange(n)
    return np.concatenate([m[:, :n, :].reshape(len(m), -1), m[:, n + b, b], m[:, n + b, n + b]], axis=1)


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True)), axis)


def viterbi(scores: np.ndarray) -> np.ndarray:
    """Best path of T + 1 states that starts in a flip state."""
    a = dense(scores)
    n = a.shape[1] // 2
    v = np.where(np.arange(2 * n) < n, 0.0, NEVER)
    back = np.empty((len(a), 2 * n), int)
    for t, step in enumerate(a):
        x = step + v
        back[t], v = x.argmax(1), x.max(1)
    path = [int(v.argmax())]
    for t in reversed(range(len(a))):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def forward(a: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = [start]
    for step in a:
        out.append(lse(step + out[-1], 1))
    return np.array(out)


def backward(a: np.ndarray) -> np.ndarray:
    out = [np.zeros(a.shape[1])]
    for step in a[::-1]:
        out.append(lse(step + out[-1][:, None], 0))
    return np.array(out[::-1])


def log_partition(scores: np.ndarray, free_start: bool = False) -> float:
    a = dense(scores)
    n = a.shape[1] // 2
    start = np.zeros(2 * n) if free_start else np.where(np.arange(2 * n) < n, 0.0, FLOP_START)
    return float(lse(forward(a, start)[-1], 0))


def posterior(scores: np.ndarray) -> np.ndarray:
    """Probability of each transition: the gradient of the log partition."""
    a = dense(scores)
    n = a.shape[1] // 2
    f, b = forward(a, np.where(np.arange(2 * n) < n, 0.0, FLOP_START)), backward(a)
    return undense(np.exp(f[:-1, None, :] + a + b[1:, :, None] - lse(f[-1], 0)))


def sequence_indices(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(step, stay) indices of a sequence of flip-flop codes."""
    return codes[:-1] + np.minimum(codes[1:], n) * 2 * n, codes + np.minimum(codes, n) * 2 * n


def flipflop_codes(labels: np.ndarray, n: int) -> np.ndarray:
    new = np.concatenate([[True], labels[1:] != labels[:-1]])
    place = np.arange(len(labels)) - np.maximum.accumulate(np.where(new, np.arange(len(labels)), 0))
    return labels + n * (place % 2)


def sequence_cost(scores: np.ndarray, codes: np.ndarray, sharp: float = 1.0) -> float:
    """-log of the summed weight of all paths that spell the sequence, a step and sharpness."""
    step, stay = sequence_indices(codes, bases_of(scores.shape[1]))
    v = np.full(len(codes), NEVER)
    v[0] = 0.0
    for s in scores * sharp:
        v = np.logaddexp(v + s[stay], np.concatenate([[NEVER], v[:-1] + s[step]]))
    return float(-v[-1] / (len(scores) * sharp))


def sequence_gradient(scores: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Gradient of sequence_cost at sharpness 1: minus the posterior of each score, a step."""
    step, stay = sequence_indices(codes, bases_of(scores.shape[1]))
    T, L = len(scores), len(codes)
    f, b = np.full((T + 1, L), NEVER), np.full((T + 1, L), NEVER)
    f[0, 0] = b[T, L - 1] = 0.0
    for t in range(T):
        f[t + 1] = np.logaddexp(f[t] + scores[t, stay], np.concatenate([[NEVER], f[t, :-1] + scores[t, step]]))
    for t in reversed(range(T)):
        b[t] = np.logaddexp(b[t + 1] + scores[t, stay], np.concatenate([b[t + 1, 1:] + scores[t, step], [NEVER]]))
    g = np.zeros_like(scores)
    for t in range(T):
        np.add.at(g[t], stay, np.exp(f[t] + scores[t, stay] + b[t + 1] - f[T, -1]))
        np.add.at(g[t], step, np.exp(f[t, :-1] + scores[t, step] + b[t + 1, 1:] - f[T, -1]))
    return -g / T


def remap(scores: np.ndarray, codes: np.ndarray, localpen: float) -> tuple[float, np.ndarray]:
    """Best alignment of the steps to a sequence: score, and T + 1 positions (-1 where clipped).

    A start state may be stayed in and left at -localpen, an end state entered at -localpen. Ties
    prefer staying, and the end state over the last position."""
    step, stay = sequence_indices(codes, bases_of(scores.shape[1]))
    L, T = len(codes), len(scores)
    v, start, end = np.full(L, NEVER), 0.0, NEVER
    v[0] = 0.0
    moved = np.zeros((T + 1, L), bool)
    from_start, into_end = np.zeros(T + 1, bool), np.zeros(T + 1, bool)
    for t, s in enumerate(scores, 1):
        stayed, came = v + s[stay], np.concatenate([[start - localpen], v[:-1] + s[step]])
        moved[t] = stayed < came
        from_start[t] = moved[t, 0]
        leave = v[-1] - localpen
        into_end[t] = leave > end
        end = max(end, leave)
        start += max(s[stay[0]], -localpen)
        v = np.where(moved[t], came, stayed)
    path = np.full(T + 1, -1)
    score, t, at = v[-1], T, L - 1
    if end >= v[-1]:
        score = end
        t = int(np.flatnonzero(into_end)[-1]) - 1
    while t >= 0:
        path[t] = at
        if from_start[t] and at == 0:
            break
        at -= int(moved[t, at])
        t -= 1
    return float(score), path


def beam_search(scores: np.ndarray, width: int = 5, guided: bool = True) -> tuple[float, tuple[int, ...]]:
    """Most probable sequence of states entered, over ``width`` prefixes; equal prefixes are merged
    by the sum of their weights, and ranked with the backward scores as a guide."""
    a = dense(scores)
    n = a.shape[1] // 2
    b = backward(a) if guided else np.zeros((len(a) + 1, 2 * n))
    beams = {(s,): 0.0 for s in range(2 * n)}
    for t, step in enumerate(a):
        grown: dict[tuple[int, ...], float] = {}
        for prefix, w in beams.items():
            for to in np.flatnonzero(step[:, prefix[-1]] > NEVER / 2).tolist():
                p = prefix if to == prefix[-1] else (*prefix, to)
                grown[p] = np.logaddexp(grown.get(p, -np.inf), w + step[to, prefix[-1]])
        best = sorted(grown, key=lambda p: (-(grown[p] + b[t + 1, p[-1]]), p))[:width]
        beams = {p: grown[p] for p in best}
    best = max(beams, key=lambda p: (beams[p], p))
    return float(beams[best]), best


def ctc_cost(log_probs: np.ndarray, labels: np.ndarray, blank: int) -> float:
    """-log probability of the labels under a CTC model, a step."""
    ext = np.full(2 * len(labels) + 1, blank)
    ext[1::2] = labels
    skip = np.zeros(len(ext), bool)
    skip[2:] = (ext[2:] != blank) & (ext[2:] != ext[:-2])
    v = np.full(len(ext), NEVER)
    v[:2] = log_probs[0, ext[:2]]
    for s in log_probs[1:]:
        came = np.logaddexp(v, np.concatenate([[NEVER], v[:-1]]))
        came = np.where(skip, np.logaddexp(came, np.concatenate([[NEVER, NEVER], v[:-2]])), came)
        v = came + s[ext]
    return float(-np.logaddexp(v[-1], v[-2]) / len(log_probs)) if len(ext) > 1 else float(-v[-1] / len(log_probs))


def squiggle_emission(signal: np.ndarray, params: np.ndarray) -> np.ndarray:
    """(T, L) Laplace log densities: columns of params are location, log scale, log-odds of moving."""
    loc, logsd = params[:, 0], params[:, 1]
    return -np.log(2) - logsd - np.abs(signal[:, None] - loc) * np.exp(-logsd)


def _squiggle_moves(params: np.ndarray, back: float) -> tuple[np.ndarray, np.ndarray]:
    move = (1 - back) / (1 + np.exp(-params[:, 2]))
    return np.log(move), np.log(np.maximum(1 - move - back, 1e-300))


def squiggle_cost(signal: np.ndarray, params: np.ndarray, back: float = 1e-15) -> float:
    """-log density of a signal that runs over all positions, steps back being possible."""
    e = squiggle_emission(signal, params)
    move, stay = _squiggle_moves(params, back)
    lb, half = np.log(back), np.log(0.5)
    L = len(params)
    v, w = np.full(L, NEVER), np.full(L, NEVER)  # in a position; in it after a step back
    v[0] = e[0, 0]
    for x in e[1:]:
        came = np.logaddexp(v + stay, np.concatenate([[NEVER], v[:-1] + move[:-1]]))
        came = np.logaddexp(came, np.concatenate([[NEVER], w[:-1] + half]))
        w = np.logaddexp(w + half, np.concatenate([v[1:] + lb, [NEVER]])) + x
        v = came + x
    return float(-np.logaddexp(v[-1], w[-1]))


def squiggle_path(signal: np.ndarray, params: np.ndarray, localpen: float = 0.0, back: float = 1e-15) -> tuple[float, np.ndarray]:
    """Best position of each sample; the signal may begin and end anywhere at localpen a position."""
    e = squiggle_emission(signal, params)
    move, stay = _squiggle_moves(params, back)
    L = len(params)
    v = e[0] - localpen * np.arange(L)
    from_left = np.zeros((len(e), L), bool)
    for t, x in enumerate(e[1:], 1):
        stayed, came = v + stay, np.concatenate([[NEVER], v[:-1] + move[:-1]])
        from_left[t] = came > stayed
        v = np.where(from_left[t], came, stayed) + x
    final = v - localpen * np.arange(L)[::-1]
    at = int(final.argmax())
    score, path = float(final[at]), []
    for t in reversed(range(len(e))):
        path.append(at)
        at -= int(from_left[t, at])
    return score, np.array(path[::-1])


def error_probs(post: np.ndarray, path: np.ndarray) -> np.ndarray:
    """1 - share of the transitions into the base called at each step; NaN at the first entry."""
    n = bases_of(post.shape[1])
    base = path[1:] % n
    flip = post[:, : 2 * n * n].reshape(-1, n, 2 * n).sum(2)
    flop = post[:, 2 * n * n :].reshape(-1, 2, n).sum(1)
    total = (flip + flop).sum(1) + 1e-10
    return np.concatenate([[np.nan], 1 - (flip + flop)[np.arange(len(base)), base] / total])
