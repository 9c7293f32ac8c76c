"""Best monotone alignments of a read's steps to a sequence of states, and densities of squiggles.

A step stays in a state or moves on from the one before it; a gain stands for each. One fold over the
read keeps the best scores every ``size`` steps. Blocks between are then expanded beside each other:
each tells for every state after it which one a best path was in before it; these maps are scanned
from the last block to the first, and the paths inside the blocks follow.

Of equal scores staying is preferred.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelake.operators import blocks
from porelake.operators import paths as P
from porelake.storage import materialize

Step = Callable[[Column, Column], Column]


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _shifted(u: Column) -> Column:
    return F.concat(F.array(F.lit(P.NEVER)), F.slice(u, F.lit(1), F.size(u) - 1))


def best_states(reads: DataFrame, by: str, first: Column, step: Step, last: Callable[[Column], Column], size: int = 64, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(by, t, state) and (by, score) of reads (by, steps, and what ``step`` refers to, named in ``keep``).

    ``first``: scores of the states before the first step; ``step(scores, x)``: struct(u, back) of the
    scores after a step and the state each comes from; ``last(scores)``: the state to end in."""
    keep = keep or []
    only_scores = lambda u, x: step(u, x)["u"]
    rows = blocks.once(reads.select(by, "steps", *keep), chunks=F.when(F.size("steps") > 0, blocks.chunks_of(F.col("steps"), size)).otherwise(F.array(F.slice("steps", 1, 0))), first=first)
    rows = blocks.once(rows, us=blocks.checkpointed(F.col("chunks"), F.col("first"), only_scores))
    rows = materialize(rows.drop("steps"), "aligned-reads")
    ends = blocks.once(rows.select(by, *keep, F.element_at("us", -1).alias("u")), v=last(F.col("u")))
    parts = rows.select(by, *keep, F.posexplode(F.arrays_zip(F.col("chunks").alias("steps"), F.slice("us", F.lit(1), F.size("chunks")).alias("u"))).alias("block", "c"))
    parts = parts.select(by, *keep, F.col("block").cast("long").alias("block"), "c.steps", "c.u").repartition(by, "block")
    begin = F.struct(F.col("u").alias("u"), F.array().cast("array<array<int>>").alias("back"))

    def noted(a: Column, x: Column) -> Column:
        return P.let(step(a["u"], x), lambda r: F.struct(r["u"].alias("u"), F.array_append(a["back"], r["back"]).alias("back")))

    parts = blocks.once(parts, back=F.aggregate("steps", begin, noted, lambda a: a["back"]))
    every = F.sequence(F.lit(0), F.size("u") - 1)
    to_first = F.aggregate(F.reverse("back"), every, lambda ss, m: F.transform(ss, lambda s: F.element_at(m, s + 1)))
    parts = materialize(parts.select(by, "block", "back", to_first.alias("m")), "aligned-blocks")
    compose = lambda a, b: F.transform(b, lambda s: F.element_at(a, s + 1))
    n_blocks = parts.agg(F.max("block")).first()[0] or 0
    exits = blocks.scanned(parts.select(by, "block", "m"), [by], ends.select(by, "v"), lambda s, m: F.element_at(m, s + 1), compose, n_blocks, backwards=True)
    found = parts.join(exits, [by, "block"])
    trace = F.reverse(F.aggregate(F.reverse("back"), F.array("v"), lambda p, m: F.array_append(p, F.element_at(m, F.element_at(p, -1) + 1))))
    path = found.select(by, "block", F.posexplode(trace).alias("k", "state")).where("k > 0 OR block = 0")
    path = path.select(by, (F.col("block") * size + F.col("k")).cast("long").alias("t"), "state")
    return path, ends.select(by, F.element_at("u", F.col("v") + 1).alias("score"))


def remap(reads: DataFrame, n: int, localpen: float, by: str = "read_id", size: int = 64) -> tuple[DataFrame, DataFrame]:
    """(by, t, position) and (by, score): the steps of reads (by, steps, codes) along their flip-flop codes,
    from before the first step to after the last; position -1 where clipped.

    A state before the codes may be stayed in at a step's own stay score or -localpen, and left at
    -localpen; one after them is entered at -localpen, and preferred at ties with the last code."""
    stay, move = P._places(F.col("codes"), n)
    pen = F.array(F.lit(-float(localpen)))
    rows = blocks.once(reads.select(by, "steps", "codes"), stay=stay, move=move)

    def step(u: Column, x: Column) -> Column:
        """A state is stayed in, or moved on into from the one before it."""
        at = lambda places: F.transform(places, lambda i: F.element_at(x, i))
        before = F.greatest(F.element_at(x, F.col("stay")[0]), F.lit(-float(localpen)))
        stayed = _plus(u, F.concat(F.array(before), at(F.col("stay")), F.array(F.lit(0.0))))
        came = _plus(_shifted(u), F.concat(F.array(F.lit(P.NEVER)), pen, at(F.col("move")), pen))
        both = F.zip_with(stayed, came, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return P.let(both, lambda c: F.struct(F.transform(c, lambda r: F.greatest(r["a"], r["b"])).alias("u"), F.transform(c, lambda r, s: s - (r["a"] < r["b"]).cast("int")).alias("back")))

    first = F.concat(F.array(F.lit(0.0), F.lit(0.0)), F.array_repeat(F.lit(P.NEVER), F.size("codes")))
    last = lambda u: F.when(F.element_at(u, -1) >= F.element_at(u, -2), F.size(u) - 1).otherwise(F.size(u) - 2)
    path, score = best_states(rows, by, first, step, last, size, ["codes", "stay", "move"])
    states = rows.select(by, F.size("codes").alias("_n"))
    position = F.when((F.col("state") > 0) & (F.col("state") <= F.col("_n")), F.col("state") - 1).otherwise(-1)
    return path.join(states, by).select(by, "t", position.cast("long").alias("position")), score


def emission(x: Column, levels: Column) -> Column:
    """Laplace log densities of a sample at every level; levels: array of struct(location, logsd, rate)."""
    return F.transform(levels, lambda p: F.lit(-0.6931471805599453) - p["logsd"] - F.abs(x - p["location"]) * F.exp(-p["logsd"]))


def _moves(levels: Column, back: float) -> tuple[Column, Column]:
    """Log probabilities of moving on, by a position's rate, and of staying in it."""
    move = lambda p: (1 - back) / (1 + F.exp(-p["rate"]))
    return F.transform(levels, lambda p: F.ln(move(p))), F.transform(levels, lambda p: F.ln(1 - move(p) - back))


def _never(a: Column) -> Column:
    return F.transform(a, lambda _: F.lit(P.NEVER))


def _sums(levels: Column, move: Column, stay: Column, back: float) -> tuple[Step, Step, Column, Column]:
    """Steps of the log weights of all ways to, and from, every position (v) and every position after a
    step back (w), from the first sample on and from the last; and the weights both begin with.

    A position is entered at its own log probability of moving; a signal begins before the first
    position's first sample, and ends in the last position."""
    never, half, lb = F.array(F.lit(P.NEVER)), F.ln(F.lit(0.5)), F.ln(F.lit(back))
    plus = lambda a, c: F.transform(a, lambda x: x + c)

    def ahead(a: Column, x: Column) -> Column:
        came = P._either(_plus(a["v"], stay), F.concat(never, _plus(P._but_last(a["v"]), P._but_first(move))))
        came = P._either(came, F.concat(never, plus(P._but_last(a["w"]), half)))
        stepped = P._either(plus(a["w"], half), F.concat(plus(P._but_first(a["v"]), lb), never))
        return P.let(emission(x, levels), lambda e: F.struct(_plus(came, e).alias("v"), _plus(stepped, e).alias("w")))

    def behind(a: Column, x: Column) -> Column:
        def of(r: Column) -> Column:
            v = P._either(_plus(r["v"], stay), F.concat(P._but_first(_plus(r["v"], move)), never))
            v = P._either(v, F.concat(never, plus(P._but_last(r["w"]), lb)))
            return F.struct(v.alias("v"), P._either(plus(r["w"], half), F.concat(plus(P._but_first(r["v"]), half), never)).alias("w"))

        return P.let(P.let(emission(x, levels), lambda e: F.struct(_plus(a["v"], e).alias("v"), _plus(a["w"], e).alias("w"))), of)

    only = lambda k: F.struct(F.transform(levels, lambda p, i: F.when(i == k, F.lit(0.0)).otherwise(F.lit(P.NEVER))).alias("v"), _never(levels).alias("w"))
    return ahead, behind, only(F.lit(0)), only(F.size(levels) - 1)


def squiggle_cost(signal: Column, levels: Column, back: float = 1e-15) -> Column:
    """-log density of a signal that runs over all positions; it may step back at probability ``back``,
    and then further back, or on again, at even odds."""
    move, stay = _moves(levels, back)
    ahead, _, first, _ = _sums(levels, move, stay, back)
    return -F.element_at(F.aggregate(signal, first, ahead)["v"], -1)


def squiggle_gradient(reads: DataFrame, back: float = 1e-15, by: str = "read_id", size: int = 64) -> DataFrame:
    """(by, pos, location, logsd, rate): gradient of ``squiggle_cost`` of reads (by, signal, levels) by every
    parameter. Weights are kept every ``size`` samples; blocks are expanded and added up by themselves."""
    move, stay = _moves(F.col("levels"), back)
    rows = blocks.once(reads.where(F.size("signal") > 0).select(by, "signal", "levels"), move=move, stay=stay, chunks=blocks.chunks_of(F.col("signal"), size))
    ahead, behind, first, last = _sums(F.col("levels"), F.col("move"), F.col("stay"), back)
    reverse = F.transform(F.reverse("chunks"), lambda c: F.reverse(c))
    rows = blocks.once(rows, fs=blocks.checkpointed(F.col("chunks"), first, ahead), bs=F.reverse(blocks.checkpointed(reverse, last, behind)))
    z = F.element_at(F.element_at("fs", -1)["v"], -1)
    parts = F.arrays_zip(F.col("chunks").alias("x"), F.slice("fs", F.lit(1), F.size("chunks")).alias("f"), F.slice("bs", F.lit(2), F.size("chunks")).alias("b"))
    parts = rows.select(by, "levels", "move", "stay", z.alias("z"), F.explode(parts).alias("c")).select(by, "levels", "move", "stay", "z", "c.*").repartition(by, F.xxhash64("x"))
    expanded = {"ahead": blocks.expanded(F.col("x"), F.col("f"), ahead), "behind": F.reverse(blocks.expanded(F.reverse("x"), F.col("b"), behind))}
    parts = blocks.once(parts, **expanded).drop("f", "b")
    z = F.col("z")

    def of(r: Column) -> Column:
        """What one sample adds for every position."""
        before, after, on, x = r["f"], r["g"], r["b"], r["x"]

        def at(p: Column, i: Column) -> Column:
            get = lambda a, k: F.get(a, k)
            here = F.exp(get(after["v"], i) + get(on["v"], i) - z) + F.exp(get(after["w"], i) + get(on["w"], i) - z)
            near = F.exp(-p["logsd"])
            e = F.lit(-0.6931471805599453) - p["logsd"] - F.abs(x - p["location"]) * near
            odds = 1 / (1 + F.exp(-p["rate"]))
            moved = (1 - back) * odds * (1 - odds)
            came = F.coalesce(F.exp(F.get(before["v"], F.when(i > 0, i - 1)) + get(on["v"], i) + e - z), F.lit(0.0))
            rate = (came - F.exp(get(before["v"], i) + get(on["v"], i) + e - z)) * moved
            return F.struct((-here * F.signum(x - p["location"]) * near).alias("location"), (-here * (F.abs(x - p["location"]) * near - 1)).alias("logsd"), (-rate).alias("rate"))

        return F.transform("levels", at)

    steps = F.arrays_zip(F.col("x"), F.slice("ahead", F.lit(1), F.size("x")).alias("f"), F.slice("ahead", F.lit(2), F.size("x")).alias("g"), F.slice("behind", F.lit(2), F.size("x")).alias("b"))
    zero = F.transform("levels", lambda p: F.struct(*[F.lit(0.0).alias(c) for c in ("location", "logsd", "rate")]))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in ("location", "logsd", "rate")])
    total = F.aggregate(steps, zero, lambda a, r: F.zip_with(a, of(r), add))
    found = parts.select(by, F.posexplode(total).alias("pos", "g")).select(by, F.col("pos").cast("long").alias("pos"), "g.*")
    return found.groupBy(by, "pos").agg(*[F.sum(c).alias(c) for c in ("location", "logsd", "rate")])


def squiggle_path(reads: DataFrame, localpen: float = 0.0, back: float = 1e-15, minscore: float = 1e30, by: str = "read_id", size: int = 64) -> tuple[DataFrame, DataFrame]:
    """(by, t, pos) and (by, score): the best position of each sample of reads (by, signal, levels), -1 for
    samples before or after the levels.

    Each such sample costs localpen, and so does each position that is left out when the levels are
    entered or left. A sample's density counts as exp(-minscore) at least. The state before and the one
    after the levels are left and stayed in at the mean of the positions' log probabilities. At ties
    staying comes first, then the position before, the state before the levels, and a step back's
    return; the state after the levels is preferred to the last position."""
    pen, half, lb = float(localpen), F.ln(F.lit(0.5)), F.ln(F.lit(back))
    move, stay = _moves(F.col("levels"), back)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    rows = blocks.once(reads.where(F.size("signal") > 0).select(by, F.col("signal").alias("steps"), "levels", F.size("levels").alias("n")), move=move, stay=stay)
    rows = blocks.once(rows, on=mean(F.col("move")), still=mean(F.col("stay")))
    n, on, still = F.col("n"), F.col("on"), F.col("still")

    def step(u: Column, x: Column) -> Column:
        """States: before, the positions, after, the positions after a step back."""
        at = lambda k: F.element_at(u, (k + 1).cast("int"))
        way = lambda score, state: F.struct(score.alias("s"), state.cast("int").alias("from"))
        never = F.lit(P.NEVER)
        before = F.array(F.array(way(at(F.lit(0)) + still, F.lit(0))))

        def into(m: Column, i: Column) -> Column:
            entered = F.when(i > 0, F.get("move", F.greatest(i - 1, F.lit(0)))).otherwise(on)
            later = i > 0
            return F.array(
                way(at(i + 1) + F.get("stay", i), i + 1),
                way(at(i) + entered, i),
                way(F.when(later, at(F.lit(0)) + on - pen * i).otherwise(never), F.lit(0)),
                way(F.when(later, at(F.greatest(n + 1 + i, n + 2)) + half).otherwise(never), n + 1 + i),
            )

        after = F.concat(
            F.array(way(at(n + 1) + still, n + 1), way(at(n) + F.element_at("move", -1), n)),
            F.transform(F.slice("move", F.lit(1), n - 1), lambda m, i: way(at(i + 1) + m - pen * (n - 1 - i), i + 1)),
        )
        returned = lambda m, i: F.array(way(at(n + 2 + i) + half, n + 2 + i), way(F.when(i < n - 1, at(F.least(i + 2, n)) + lb).otherwise(never), i + 2))
        ways = F.concat(before, F.transform("move", into), F.array(after), F.transform("move", returned))
        e = F.transform(emission(x, F.col("levels")), lambda d: F.greatest(F.lit(-float(minscore)), d))
        own = F.concat(F.array(F.lit(-pen)), e, F.array(F.lit(-pen)), e)

        def best(ws: Column) -> Column:
            top = F.transform(ws, lambda c: F.array_max(F.transform(c, lambda w: w["s"])))
            source = F.zip_with(ws, top, lambda c, b: F.element_at(F.filter(c, lambda w: w["s"] == b), 1)["from"])
            return F.struct(_plus(top, own).alias("u"), source.alias("back"))

        return P.let(ways, best)

    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(P.NEVER), 2 * n + 1))
    last = lambda u: F.when(F.element_at(u, n + 1) > F.element_at(u, n + 2), n).otherwise(n + 1)
    path, score = best_states(rows, by, first, step, last, size, ["levels", "n", "move", "stay", "on", "still"])
    at = path.where("t > 0").join(rows.select(by, "n"), by)
    pos = F.when((F.col("state") == 0) | (F.col("state") == n + 1), -1).when(F.col("state") > n + 1, F.col("state") - n - 2).otherwise(F.col("state") - 1)
    return at.select(by, (F.col("t") - 1).alias("t"), pos.cast("long").alias("pos")), score
