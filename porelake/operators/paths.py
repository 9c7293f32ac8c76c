"""Recursions over the transition scores of a read as array functions of the engine itself.

A read is a row: ``steps`` holds the scores of its steps, each 2n(n + 1) for n bases: row-major "to
flip b from any state", then "to flop b from flip b", then "to flop b from flop b". States are the n
flips and then the n flops. Everything is an expression, so reads run in the JVM, beside each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER, FLOP_START = -1e30, -50000.0


def steps_of(scores: DataFrame, by: str = "read_id", t: str = "t", x: str = "scores") -> DataFrame:
    """(by, steps): the scores of each read's steps, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x"))))
    return scores.groupBy(by).agg(F.transform(rows, lambda r: r["x"]).alias("steps"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def logsumexp(x: Column) -> Column:
    def of(c: Column) -> Column:
        return let(F.array_max(c), lambda top: top + F.ln(F.aggregate(c, F.lit(0.0), lambda a, u: a + F.exp(u - top))))

    return let(x, of)


def start(n: int, flop: float = FLOP_START) -> Column:
    """Paths begin in a flip."""
    return F.array(*[F.lit(0.0)] * n, *[F.lit(flop)] * n)


def _into(v: Column, x: Column, n: int) -> list[Column]:
    """Of each state the weights of the ways into it, by the state they come from."""
    flips = [F.zip_with(v, F.slice(x, 2 * n * b + 1, 2 * n), lambda p, q: p + q) for b in range(n)]
    flops = [F.array(v[b] + x[2 * n * n + b], v[n + b] + x[2 * n * n + n + b]) for b in range(n)]
    return flips + flops


def _out_of(v: Column, x: Column, n: int) -> list[Column]:
    """Of each state the weights of the ways out of it; v: of the states they lead to."""
    return [F.array(*[x[2 * n * b + s] + v[b] for b in range(n)], x[2 * n * n + s] + v[n + s % n]) for s in range(2 * n)]


def _all(steps: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The vectors after each step, the first one before any."""
    return F.aggregate(steps, F.array(first), lambda a, x: F.array_append(a, step(F.element_at(a, -1), x)))


def forward(steps: Column, n: int, first: Column) -> Column:
    """Log weights of all paths to each state, before each step and after the last."""
    return _all(steps, first, lambda v, x: F.array(*map(logsumexp, _into(v, x, n))))


def backward(steps: Column, n: int) -> Column:
    """Log weights of all paths from each state on, before each step and after the last."""
    none = F.array(*[F.lit(0.0)] * (2 * n))
    return F.reverse(_all(F.reverse(steps), none, lambda v, x: F.array(*map(logsumexp, _out_of(v, x, n)))))


def log_partition(steps: Column, n: int, first: Column) -> Column:
    """Log weight of all paths; only one vector is held."""
    return logsumexp(F.aggregate(steps, first, lambda v, x: F.array(*map(logsumexp, _into(v, x, n)))))


def normalised(steps: Column, log_z: Column) -> Column:
    """Scores whose paths' weights sum to 1."""
    share = log_z / F.size(steps)
    return F.transform(steps, lambda x: F.transform(x, lambda s: s - share))


def viterbi(steps: Column, n: int) -> Column:
    """States of the best path, one more than steps; at ties the first state."""
    def step(a: Column, x: Column) -> Column:
        ways = F.array(*_into(a["v"], x, n))
        best = F.transform(ways, lambda c: F.array_max(c))
        # a flop's ways come from its flip and from itself
        place = F.transform(ways, lambda c, s: F.when(s < n, F.array_position(c, F.array_max(c)).cast("int") - 1).otherwise(s - n + n * (F.array_position(c, F.array_max(c)).cast("int") - 1)))
        return F.struct(best.alias("v"), F.array_append(a["back"], place).alias("back"))

    begin = F.struct(start(n, NEVER).alias("v"), F.array().cast("array<array<int>>").alias("back"))
    last = lambda a: F.array_position(a["v"], F.array_max(a["v"])).cast("int") - 1
    trace = lambda a: F.aggregate(F.reverse(a["back"]), F.array(last(a)), lambda p, b: F.array_append(p, F.element_at(b, F.element_at(p, -1) + 1)))
    return F.reverse(F.aggregate(steps, begin, step, trace))


def posterior(steps: Column, n: int, ahead: Column, back: Column, log_z: Column) -> Column:
    """Probability of every transition of every step, in the order of the scores."""
    ways = [(s, b) for b in range(n) for s in range(2 * n)] + [(s, n + s % n) for s in range(2 * n)]  # from, to
    at = F.arrays_zip(steps.alias("x"), F.slice(ahead, F.lit(1), F.size(steps)).alias("f"), F.slice(back, F.lit(2), F.size(steps)).alias("b"))
    return F.transform(at, lambda r: F.array(*[F.exp(r["f"][s] + r["x"][i] + r["b"][to] - log_z) for i, (s, to) in enumerate(ways)]))


def beam_search(steps: Column, n: int, back: Column | None = None, width: int = 5, cut: float = 0.0) -> Column:
    """struct(p, w): the states entered of the most probable sequence, and its log weight. After each step
    the ``width`` best sequences are kept; those that paths reach in several ways are one, by the sum of
    their weights. ``back``, of ``backward``, guides the choice; ties go to the sequence that sorts first.
    With a ``cut`` above 0, sequences as much as that or more below a step's best one go as well; it is
    compared with the best of all of the step's sequences, whatever their order."""
    guide = F.transform(steps, lambda x: F.array(*[F.lit(0.0)] * (2 * n))) if back is None else F.slice(back, F.lit(2), F.size(steps))
    begin = F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda s: F.struct(F.array(s).alias("p"), F.lit(0.0).alias("w")))

    def grown(b: Column, x: Column) -> Column:
        """A sequence's ways on: into every flip, and into the flop of its base."""
        def of(s: Column) -> Column:
            def to(state: Column, i: Column) -> Column:
                return F.struct(F.when(state == s, b["p"]).otherwise(F.array_append(b["p"], state)).alias("p"), (b["w"] + F.element_at(x, i + 1)).alias("w"))

            flips = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: to(k, 2 * n * k + s))
            return F.array_append(flips, to(n + s % n, 2 * n * n + s))

        return let(F.element_at(b["p"], -1), of)

    def step(beams: Column, r: Column) -> Column:
        def best(ways: Column) -> Column:
            total = lambda p: logsumexp(F.transform(F.filter(ways, lambda c: c["p"] == p), lambda c: c["w"]))
            whole = F.transform(F.array_distinct(F.transform(ways, lambda c: c["p"])), lambda p: F.struct(p.alias("p"), total(p).alias("w")))
            ranked = F.transform(whole, lambda c: F.struct((-(c["w"] + F.element_at(r["g"], F.element_at(c["p"], -1) + 1))).alias("k"), c["p"].alias("p"), c["w"].alias("w")))
            sorted_ = F.slice(F.array_sort(ranked), 1, width)
            if cut > 0:
                sorted_ = let(sorted_, lambda cs: F.filter(cs, lambda c: c["k"] - cs[0]["k"] < cut))
            return F.transform(sorted_, lambda c: F.struct(c["p"].alias("p"), c["w"].alias("w")))

        return let(F.flatten(F.transform(beams, lambda b: grown(b, r["x"]))), best)

    end = F.aggregate(F.arrays_zip(steps.alias("x"), guide.alias("g")), begin, step)
    by_weight = F.array_max(F.transform(end, lambda c: F.struct(c["w"].alias("w"), c["p"].alias("p"))))
    return let(by_weight, lambda c: F.struct(c["p"].alias("p"), c["w"].alias("w")))


def _but_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.size(a) - 1)


def _but_first(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.size(a) - 1)


def _places(codes: Column, n: int) -> tuple[Column, Column]:
    """Where in a step's scores, from 1: staying at each code, and moving on to each code but the first."""
    stay = F.transform(codes, lambda c: (c + F.least(c, F.lit(n)) * 2 * n + 1).cast("int"))
    return stay, F.zip_with(_but_last(codes), _but_first(codes), lambda c, d: (c + F.least(d, F.lit(n)) * 2 * n + 1).cast("int"))


def _either(a: Column, b: Column) -> Column:
    """Log weights of two sets of paths to each place, together."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))))


def _plus(v: Column, x: Column, places: Column, sharp: float = 1.0) -> Column:
    return F.zip_with(v, places, lambda w, i: w + sharp * F.element_at(x, i))


def _only(codes: Column, place: Column) -> Column:
    return F.transform(codes, lambda c, i: F.when(i == place, F.lit(0.0)).otherwise(F.lit(NEVER)))


def sequence_cost(steps: Column, n: int, codes: Column, sharp: float = 1.0, entered: Column | None = None, weights: Column | None = None) -> Column:
    """-log weight of the paths that spell a sequence of flip-flop codes, a step and sharpness. With
    ``entered``, moving on to a code adds the score at its place there, times its weight."""
    stay, move = _places(codes, n)
    never = F.array(F.lit(NEVER))

    def step(v: Column, x: Column) -> Column:
        moved = _plus(_but_last(v), x, move, sharp)
        if entered is not None:
            extra = F.zip_with(_but_first(entered), _but_first(weights), lambda i, w: sharp * w * F.element_at(x, i))
            moved = F.zip_with(moved, extra, lambda a, b: a + b)
        return _either(_plus(v, x, stay, sharp), F.concat(never, moved))

    return -F.element_at(F.aggregate(steps, _only(codes, F.lit(0)), step), -1) / (F.size(steps) * sharp)


def spelled(steps: Column, n: int, codes: Column) -> tuple[Column, Column]:
    """Log weights, before each step and after the last, of the paths that spell the codes up to each
    of them, and of those that spell the rest."""
    stay, move = _places(codes, n)
    never = F.array(F.lit(NEVER))
    ahead = _all(steps, _only(codes, F.lit(0)), lambda v, x: _either(_plus(v, x, stay), F.concat(never, _plus(_but_last(v), x, move))))
    back = _all(F.reverse(steps), _only(codes, F.size(codes) - 1), lambda v, x: _either(_plus(v, x, stay), F.concat(_plus(_but_first(v), x, move), never)))
    return ahead, F.reverse(back)


def sequence_gradient(steps: Column, n: int, codes: Column, ahead: Column, back: Column) -> Column:
    """Gradient of sequence_cost at sharpness 1 by each score of each step; ahead, back: of ``spelled``."""
    stay, move = _places(codes, n)
    log_z = F.element_at(F.element_at(ahead, -1), -1)
    at = F.arrays_zip(steps.alias("x"), F.slice(ahead, F.lit(1), F.size(steps)).alias("f"), F.slice(back, F.lit(2), F.size(steps)).alias("b"))

    def of(r: Column) -> Column:
        share = lambda s, i: F.struct(i.alias("i"), F.exp(s + F.element_at(r["x"], i) - log_z).alias("p"))
        both = lambda f, b, places: F.zip_with(F.zip_with(f, b, lambda x, y: x + y), places, share)
        ways = F.concat(both(r["f"], r["b"], stay), both(_but_last(r["f"]), _but_first(r["b"]), move))
        total = lambda ws, k: F.aggregate(F.filter(ws, lambda w: w["i"] == k), F.lit(0.0), lambda a, w: a + w["p"])
        return let(ways, lambda ws: F.transform(F.sequence(F.lit(1), F.lit(2 * n * (n + 1))), lambda k: -total(ws, k) / F.size(steps)))

    return F.transform(at, of)


def spelling_steps(n: int, codes: Column, entered: Column | None = None, weights: Column | None = None) -> tuple[Callable, Callable]:
    """Steps of the log weights of the paths that spell the codes up to each of them, and, from the last
    step to the first, of those that spell the rest; with modifications as in ``sequence_cost``."""
    stay, move = _places(codes, n)
    never = F.array(F.lit(NEVER))

    def moved(v: Column, x: Column) -> Column:
        found = _plus(v, x, move)
        if entered is None:
            return found
        extra = F.zip_with(_but_first(entered), _but_first(weights), lambda i, w: w * F.element_at(x, i))
        return F.zip_with(found, extra, lambda a, b: a + b)

    ahead = lambda v, x: _either(_plus(v, x, stay), F.concat(never, moved(_but_last(v), x)))
    return ahead, lambda v, x: _either(_plus(v, x, stay), F.concat(moved(_but_first(v), x), never))


def spelled_gradient(steps: Column, n: int, codes: Column, ahead: Column, back: Column, log_z: Column, n_steps: Column, entered: Column | None = None, weights: Column | None = None) -> Column:
    """Of each of some steps of a read the gradient of its sequence's cost by each score. A modified
    move's probability counts for its transition, and its weight's share for the modification's score."""
    stay, move = _places(codes, n)
    at = F.arrays_zip(steps.alias("x"), F.slice(ahead, F.lit(1), F.size(steps)).alias("f"), F.slice(back, F.lit(2), F.size(steps)).alias("b"))

    def of(r: Column) -> Column:
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        share = lambda s, i: F.struct(i.alias("i"), F.exp(s + F.element_at(r["x"], i) - log_z).alias("p"))
        moving = add(_but_last(r["f"]), _but_first(r["b"]))
        if entered is not None:
            moving = add(moving, F.zip_with(_but_first(entered), _but_first(weights), lambda i, w: w * F.element_at(r["x"], i)))
        moves = F.zip_with(moving, move, share)
        ways = F.concat(F.zip_with(add(r["f"], r["b"]), stay, share), moves)

        def all_of(ways: Column) -> Column:
            total = lambda k: F.aggregate(F.filter(ways, lambda w: w["i"] == k), F.lit(0.0), lambda a, w: a + w["p"])
            return F.transform(F.sequence(F.lit(1), F.size(r["x"])), lambda k: -total(k) / n_steps)

        if entered is None:
            return let(ways, all_of)
        more = F.zip_with(F.zip_with(moves, _but_first(weights), lambda m, w: m["p"] * w), _but_first(entered), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
        return let(F.concat(ways, more), all_of)

    return F.transform(at, of)


def ctc_states(labels: Column, blank: int) -> Column:
    """The labels with a blank before, between and after them."""
    return F.concat(F.flatten(F.transform(labels, lambda c: F.array(F.lit(blank), c.cast("int")))), F.array(F.lit(blank)))


def ctc_cost(log_probs: Column, states: Column, blank: int) -> Column:
    """-log probability, a step, of the labels that ``ctc_states`` made states of; at least one label.
    A path may pass over a blank between two labels that differ."""
    begin = F.transform(states, lambda c, i: F.when(i == 0, F.lit(0.0)).otherwise(F.lit(NEVER)))

    def step(v: Column, x: Column) -> Column:
        before = lambda i, k: F.coalesce(F.get(v, i - k), F.lit(NEVER))
        over = lambda c, i: (i > 1) & (c != blank) & (c != F.get(states, i - 2))
        return F.transform(states, lambda c, i: logsumexp(F.array(F.get(v, i), before(i, 1), F.when(over(c, i), before(i, 2)).otherwise(F.lit(NEVER)))) + F.element_at(x, c + 1))

    end = F.aggregate(log_probs, begin, step)
    return -logsumexp(F.slice(end, F.size(states) - 1, F.lit(2))) / F.size(log_probs)


def error_prob(p: Column, n: int, state: Column) -> Column:
    """1 - share of the transitions into the base of a state among a step's probabilities."""
    b = state % n
    flips = F.aggregate(F.slice(p, (2 * n * b + 1).cast("int"), F.lit(2 * n)), F.lit(0.0), lambda a, v: a + v)
    into = flips + F.element_at(p, (2 * n * n + b + 1).cast("int")) + F.element_at(p, (2 * n * n + n + b + 1).cast("int"))
    return 1 - into / (F.aggregate(p, F.lit(0.0), lambda a, v: a + v) + 1e-10)


def error_probs(posteriors: Column, n: int, path: Column) -> Column:
    """``error_prob`` of the base called at each step."""
    return F.zip_with(posteriors, F.slice(path, F.lit(2), F.size(path) - 1), lambda p, s: error_prob(p, n, s))
