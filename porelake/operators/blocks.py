"""The recursions of ``paths`` over long reads: blocks of steps instead of one row a read.

A block of ``size`` steps is summed up by its transfer matrix: the weight of all paths (log-sum-exp), or
of the best one (max), from each state before it to each state after it. Matrices multiply, so products
of ``fan`` blocks stand for larger blocks, as often as a read's length asks for; what enters the large
blocks gives what enters those inside them, and then every block is expanded by itself. Blocks are
rows: one read spreads over tasks, no array is longer than a block or ``fan`` matrices, and nothing is
copied at each step, so time grows with the number of steps.

Where steps have no such product (gates of recurrent layers, weights of a long sequence), ``checkpointed``
folds over a read once, keeps the state every ``size`` steps and expands the blocks likewise.

Steps of a read are numbered from 0 without gaps. A read without steps has no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelake.operators import paths as P
from porelake.storage import materialize

def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Columns that later ones refer to, computed once: a generator is not folded into them."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_x")).select(*df.columns, "_x.*")


def cut(scores: DataFrame, by: list[str], t: str = "t", x: str = "scores", size: int = 64) -> DataFrame:
    """(by, block, steps): the scores of at most ``size`` steps, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x"))))
    return scores.groupBy(*by, F.floor(F.col(t) / size).cast("long").alias("block")).agg(F.transform(rows, lambda r: r["x"]).alias("steps"))


def scanned(rows: DataFrame, by: list[str], first: DataFrame, act: Callable[[Column, Column], Column], compose: Callable[[Column, Column], Column], last: int, fan: int = 64, backwards: bool = False) -> DataFrame:
    """(by, block, v): what has become of ``first`` (by, v) before each block; ``act`` applies the m of a
    row (by, block, m), ``compose`` joins those of neighbours. Backwards from the last block on."""
    above = [] if last < fan else ["_above"]
    named = rows.withColumn("_above", F.floor(F.col("block") / fan).cast("long"))
    lists = named.groupBy(*by, *above).agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("ms"))  # at most ``fan``
    starts = first
    if above:
        lists = materialize(lists, "scan-lists")
        rest = F.slice("ms", F.lit(2), F.size("ms"))
        whole = F.aggregate(rest, F.col("ms")[0]["m"], lambda a, r: compose(a, r["m"]))
        larger = materialize(lists.select(*by, F.col("_above").alias("block"), whole.alias("m")), "scan-products")
        starts = scanned(larger, by, first, act, compose, last // fan, fan, backwards).withColumnRenamed("block", "_above")
    met = lists.join(starts, [*by, *above]).withColumn("ms", F.reverse("ms") if backwards else F.col("ms"))
    vs = F.aggregate("ms", F.array("v"), lambda a, r: F.array_append(a, act(F.element_at(a, -1), r["m"])))
    pairs = F.zip_with("ms", F.slice(vs, F.lit(1), F.size("ms")), lambda r, v: F.struct(r["block"].alias("block"), v.alias("v")))
    return met.select(*by, F.explode(pairs).alias("r")).select(*by, "r.block", "r.v")


def _zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * (2 * n))


def _through(v: Column, m: Column, n: int, total: Callable[[Column], Column]) -> Column:
    """A vector before a block to one after it."""
    return F.array(*[total(F.array(*[v[s] + m[s][j] for s in range(2 * n)])) for j in range(2 * n)])


def _back_through(w: Column, m: Column, total: Callable[[Column], Column]) -> Column:
    return F.transform(m, lambda row: total(F.zip_with(row, w, lambda a, b: a + b)))


@dataclass
class Blocks:
    """The written blocks of reads: ``rows`` (by, block, steps, m), m the transfer matrix."""

    rows: DataFrame
    by: list[str]
    n: int
    last: int
    size: int
    fan: int
    total: Callable[[Column], Column]

    @classmethod
    def of(cls, scores: DataFrame, n: int, total: Callable[[Column], Column] = P.logsumexp, by: list[str] | None = None, t: str = "t", x: str = "scores", size: int = 64, fan: int = 64) -> Blocks:
        """``total``: logsumexp, or array_max for best paths."""
        by = by or ["read_id"]
        steps = materialize(cut(scores, by, t, x, size), "blocks-steps")
        states = F.sequence(F.lit(0), F.lit(2 * n - 1))
        only = lambda s: F.transform(states, lambda j: F.when(j == s, F.lit(0.0)).otherwise(F.lit(P.NEVER)))
        m = F.transform(states, lambda s: F.aggregate("steps", only(s), lambda v, x: F.array(*map(total, P._into(v, x, n)))))
        rows = materialize(steps.select(*by, "block", "steps", m.alias("m")), "blocks")
        return cls(rows, by, n, rows.agg(F.max("block")).first()[0] or 0, size, fan, total)

    def starts(self, first: Column) -> DataFrame:
        """(by, block, v): weights of the paths to each state before each block."""
        begin = self.rows.where("block = 0").select(*self.by, first.alias("v"))
        compose = lambda a, b: F.transform(a, lambda row: _through(row, b, self.n, self.total))
        return scanned(self.rows.select(*self.by, "block", "m"), self.by, begin, lambda v, m: _through(v, m, self.n, self.total), compose, self.last, self.fan)

    def ends(self) -> DataFrame:
        """(by, block, v): weights of the paths from each state after each block on."""
        begin = self.rows.where("block = 0").select(*self.by, _zeros(self.n).alias("v"))
        compose = lambda a, b: F.transform(a, lambda row: _through(row, b, self.n, self.total))
        return scanned(self.rows.select(*self.by, "block", "m"), self.by, begin, lambda w, m: _back_through(w, m, self.total), compose, self.last, self.fan, backwards=True)

    def _with(self, found: DataFrame, name: str) -> DataFrame:
        return self.rows.select(*self.by, "block", "steps").join(found.withColumnRenamed("v", name), [*self.by, "block"])

    def _step(self, v: Column, x: Column) -> Column:
        return F.array(*map(self.total, P._into(v, x, self.n)))

    def _out(self, w: Column, x: Column) -> Column:
        return F.array(*map(self.total, P._out_of(w, x, self.n)))

    def _at(self, k: Column) -> Column:
        return (F.col("block") * self.size + k).cast("long")

    def forward(self, first: Column) -> DataFrame:
        """(by, t, v): log weights of all paths to each state before step t; after the last one, too."""
        met = self._with(self.starts(first), "v")
        after = F.aggregate("steps", F.array("v"), lambda a, x: F.array_append(a, self._step(F.element_at(a, -1), x)))
        rows = met.select(*self.by, "block", F.posexplode(after).alias("k", "v"))
        # the first of a block is the last of the block before
        return rows.where("k > 0 OR block = 0").select(*self.by, self._at(F.col("k")).alias("t"), "v")

    def backward(self) -> DataFrame:
        """(by, t, v): log weights of all paths from each state before step t on; zeros after the last step."""
        met = self._with(self.ends(), "w")
        before = F.reverse(F.aggregate(F.reverse("steps"), F.array("w"), lambda a, x: F.array_append(a, self._out(F.element_at(a, -1), x))))
        rows = met.select(*self.by, "block", F.size("steps").alias("size"), F.posexplode(before).alias("k", "v"))
        # the last of a block is the first of the next one; only a read's last block keeps it
        last = self.rows.groupBy(*self.by).agg(F.max("block").alias("_last"))
        return rows.join(last, self.by).where("k < size OR block = _last").select(*self.by, self._at(F.col("k")).alias("t"), "v")

    def log_partition(self, first: Column) -> DataFrame:
        """(by, log_z, n): log weight of all paths, and the number of steps."""
        return self._partition(self._with(self.starts(first), "v"))

    def _partition(self, met: DataFrame) -> DataFrame:
        after = F.aggregate("steps", F.col("v"), self._step)
        return met.groupBy(*self.by).agg(F.max_by(after, "block").alias("v"), F.sum(F.size("steps")).cast("long").alias("n")).select(*self.by, self.total(F.col("v")).alias("log_z"), "n")

    def posteriors(self, first: Column) -> DataFrame:
        """(by, t, p): the probability of every transition of step t, in the order of the scores."""
        starts = self._with(materialize(self.starts(first), "block-starts"), "v")
        met = starts.join(self.ends().withColumnRenamed("v", "w"), [*self.by, "block"])
        met = met.join(self._partition(starts).select(*self.by, "log_z"), self.by)
        ahead = F.aggregate("steps", F.array("v"), lambda a, x: F.array_append(a, self._step(F.element_at(a, -1), x)))
        back = F.reverse(F.aggregate(F.reverse("steps"), F.array("w"), lambda a, x: F.array_append(a, self._out(F.element_at(a, -1), x))))
        met = once(met, f=ahead, b=back)
        p = P.posterior(F.col("steps"), self.n, F.col("f"), F.col("b"), F.col("log_z"))
        return met.select(*self.by, "block", F.posexplode(p).alias("k", "p")).select(*self.by, self._at(F.col("k")).alias("t"), "p")


def viterbi(scores: DataFrame, n: int, by: list[str] | None = None, t: str = "t", x: str = "scores", size: int = 64, fan: int = 64) -> DataFrame:
    """(by, t, state): the states of the best path, one more than steps; at ties the first state.

    Best weights before each block come from products of matrices. Each block then has pointers back
    from every state; together they map the state after a block to the one before it, and these maps
    are scanned from a read's last block to its first."""
    blocks = Blocks.of(scores, n, F.array_max, by, t, x, size, fan)
    by = blocks.by
    met = blocks._with(blocks.starts(P.start(n, P.NEVER)), "v")

    def step(a: Column, x: Column) -> Column:
        ways = F.array(*P._into(a["v"], x, n))
        # a flop's ways come from its flip and from itself
        place = F.transform(ways, lambda c, s: F.when(s < n, F.array_position(c, F.array_max(c)).cast("int") - 1).otherwise(s - n + n * (F.array_position(c, F.array_max(c)).cast("int") - 1)))
        return F.struct(F.transform(ways, lambda c: F.array_max(c)).alias("v"), F.array_append(a["back"], place).alias("back"))

    begin = F.struct(F.col("v").alias("v"), F.array().cast("array<array<int>>").alias("back"))
    met = once(met, a=F.aggregate("steps", begin, step))
    every = F.sequence(F.lit(0), F.lit(2 * n - 1))
    to_first = F.aggregate(F.reverse(F.col("a")["back"]), every, lambda m, b: F.transform(m, lambda s: F.element_at(b, s + 1)))
    met = materialize(met.select(*by, "block", F.col("a")["v"].alias("v"), F.col("a")["back"].alias("back"), to_first.alias("m")), "viterbi-blocks")
    ends = met.groupBy(*by).agg(F.max_by("v", "block").alias("v")).select(*by, (F.array_position("v", F.array_max("v")).cast("int") - 1).alias("v"))
    compose = lambda a, b: F.transform(b, lambda s: F.element_at(a, s + 1))
    exits = scanned(met.select(*by, "block", "m"), by, ends, lambda s, m: F.element_at(m, s + 1), compose, blocks.last, fan, backwards=True)
    found = met.select(*by, "block", "back").join(exits.withColumnRenamed("v", "exit"), [*by, "block"])
    trace = F.reverse(F.aggregate(F.reverse("back"), F.array("exit"), lambda p, b: F.array_append(p, F.element_at(b, F.element_at(p, -1) + 1))))
    rows = found.select(*by, "block", F.posexplode(trace).alias("k", "state")).where("k > 0 OR block = 0")
    return rows.select(*by, (F.col("block") * size + F.col("k")).cast("long").alias("t"), "state")


def called(scores: DataFrame, n: int, by: str = "read_id", size: int = 64) -> DataFrame:
    """(by, t, base, error): the bases that the best path over the posteriors moves into, at the steps
    where it does, with the share of the step's transitions that lead elsewhere."""
    post = materialize(Blocks.of(scores, n, by=[by], size=size).posteriors(P.start(n)), "posteriors")
    logs = post.select(by, "t", F.transform("p", lambda v: F.ln(v + 1e-8)).alias("scores"))
    path = materialize(viterbi(logs, n, [by], size=size), "best-path")
    before = path.select(by, (F.col("t") + 1).alias("t"), F.col("state").alias("before"))
    moves = path.join(before, [by, "t"]).where("state != before")
    at = post.select(by, (F.col("t") + 1).alias("t"), "p")
    return moves.join(at, [by, "t"]).select(by, "t", (F.col("state") % n).alias("base"), P.error_prob(F.col("p"), n, F.col("state")).alias("error"))


def chunks_of(steps: Column, size: int) -> Column:
    """An array in parts of ``size``."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(steps) / size).cast("int") - 1)), lambda b: F.slice(steps, b * size + 1, F.lit(size)))


def checkpointed(chunks: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state before each part: one is kept a part, so few are copied."""
    return F.aggregate(chunks, F.array(first), lambda a, c: F.array_append(a, F.aggregate(c, F.element_at(a, -1), step)))


def expanded(steps: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each step of a part, the first one before any."""
    return F.aggregate(steps, F.array(first), lambda a, x: F.array_append(a, step(F.element_at(a, -1), x)))


def gradient_rows(reads: DataFrame, n: int, by: str = "read_id", size: int = 64, entered: Callable[[Column], Column] | None = None, weights: Callable[[Column], Column] | None = None) -> DataFrame:
    """(by, t, g): gradient of ``sequence_cost`` by each score of each step, of (by, steps, codes) rows.
    With modifications (see ``paths.sequence_cost``) moving on to a code also has the score at its
    ``entered`` place, times its weight; both are functions of the codes.

    Weights of the codes before and after every ``size`` steps are kept; then blocks are expanded."""
    more = {} if entered is None else {"entered": entered(F.col("codes")), "weights": weights(F.col("codes"))}
    rows = once(reads.where(F.size("steps") > 0), chunks=chunks_of(F.col("steps"), size), first=P._only(F.col("codes"), F.lit(0)), end=P._only(F.col("codes"), F.size("codes") - 1), **more)
    columns = [F.col(c) for c in more]
    ahead, back = P.spelling_steps(n, F.col("codes"), *columns)
    reverse = F.transform(F.reverse("chunks"), lambda c: F.reverse(c))
    rows = once(rows, fs=checkpointed(F.col("chunks"), F.col("first"), ahead), bs=F.reverse(checkpointed(reverse, F.col("end"), back)))
    log_z = F.element_at(F.element_at("fs", -1), -1)
    each = F.zip_with(F.zip_with("chunks", F.slice("fs", F.lit(1), F.size("chunks")), lambda c, f: F.struct(c.alias("steps"), f.alias("f"))), F.slice("bs", F.lit(2), F.size("chunks")), lambda c, b: F.struct(c["steps"].alias("steps"), c["f"].alias("f"), b.alias("b")))
    parts = rows.select(by, "codes", *more, log_z.alias("log_z"), F.size("steps").alias("n_steps"), F.posexplode(each).alias("block", "c")).select(by, "codes", *more, "log_z", "n_steps", "block", "c.*")
    parts = parts.repartition(by, "block")  # a read's blocks are worked on side by side
    parts = once(parts, ahead=expanded(F.col("steps"), F.col("f"), ahead), back=F.reverse(expanded(F.reverse("steps"), F.col("b"), back)))
    g = P.spelled_gradient(F.col("steps"), n, F.col("codes"), F.col("ahead"), F.col("back"), F.col("log_z"), F.col("n_steps"), *columns)
    return parts.select(by, "block", F.posexplode(g).alias("k", "g")).select(by, (F.col("block") * size + F.col("k")).cast("long").alias("t"), "g")
