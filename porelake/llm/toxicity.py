"""Operator 5: toxicity by a linear-chain conditional random field.

The labels mark whole documents. Token labels come from them by weak supervision: in a toxic
document of the fitting sample those tokens count as toxic that carry strong evidence, a word or word
beginning far more frequent in toxic documents than in others, and so does a token between two such
ones. A two-state chain (clean, toxic) is then fitted to the labelled tokens; its gradient is summed
over Spark tasks. The chain weighs each token with its neighbours, so it also tags the plain words
inside a span, which a list of words can't. Scoring runs forward and backward over every whole
document; the marginals give the offending offsets, and their sum and maximum, calibrated by a
logistic regression on the sample, give the document's score.

Features of a token are its words and their beginnings of 3 to 6 letters, which stand for inflected
forms. A feature is kept if at least ``least`` documents of the sample have it (1 in 100 toxic ones,
3 at least) and its log odds are beyond 1 either way; nothing else bounds their number.

The fitting sample is bounded: ``fit_toxic`` toxic and ``fit_clean`` other labelled documents, those
with the smallest hashes of doc_id. Everything else covers all documents. Only words are read:
labels, lang, source and doc_id never enter a score.

Defined results: a null or empty text has no tokens and the score of a text without evidence. If the
training rows lack one of the two classes, every score is the share of toxic ones among them (0
without any), empty tables included. A label repeated for a doc_id counts once, as toxic if any says
so; null labels are ignored; of equal texts in the sample one counts. Rows with a null doc_id are
scored, never fitted. Repeated rows are scored one by one; further columns are ignored. A very long
text is scored with the texts that fit beside it in 4 MB, and costs some 100 bytes a token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from porelake.llm._shared import Recent, id_and_text, materialize, slices, table

SCORE_SCHEMA = "doc_id long, score double, n_toxic long, starts array<int>, ends array<int>"
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)


class Model(NamedTuple):
    weights: dict[str, float]  # of features, for the toxic state
    bias: float
    chain: tuple[float, float, float]  # log weights of clean-toxic, toxic-clean, toxic-toxic; clean-clean is 0
    scale: tuple[float, float, float]  # logistic: constant, log(1 + sum of marginals), largest marginal
    constant: float | None = None  # the score of every text where nothing could be fitted


def features(token: str) -> list[str]:
    """The words in a token (which ends at white space), and their beginnings."""
    out = []
    for w in LETTERS.findall(token.lower()):
        out += [w + "$", *(w[:n] for n in PREFIXES if len(w) >= n)]
    return out


def emissions(weights: dict[str, float], bias: float, limit: int = 200_000) -> Recent:
    """Token -> weight of the toxic state."""
    return Recent(lambda token: bias + sum(weights.get(f, 0.0) for f in set(features(token))), limit)


def _time_major(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Layout in which all sequences advance together, the longest first: their order, how many are
    left at each step, where each step begins, and the place of every token."""
    order = np.argsort(-lens, kind="stable")
    active = np.searchsorted(-lens[order], -np.arange(int(lens[order[0]])), "left")
    first = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(lens), np.int64)
    rank[order] = np.arange(len(lens))
    step = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    return order, active, first, first[step] + np.repeat(rank, lens)


def _transfer(e: np.ndarray, n: int, size: int, a: float, b: float, t: float) -> np.ndarray:
    """Of n sequences of ``size`` tokens: the matrix of the fraction that takes the message before
    the first token to the one after the last, one step being g -> (a + t e g) / (1 + b e g)."""
    m = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    for x in e.reshape(n, size).T:
        up, low = x[:, None] * m[:, 0], m[:, 1]
        m = np.stack([t * up + a * low, b * up + low], axis=1)
        m /= m.max(axis=(1, 2), keepdims=True)
    return m


def _borders(e: np.ndarray, lens: np.ndarray, size: int, chain: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Messages at the borders of the pieces of ``size`` tokens that sequences are cut into: into the
    first token of each piece from the left, and into its last one from the right; 1 at the ends."""
    ct, tc, tt = chain
    pieces = -(-lens // size)
    lead, tail = np.ones(pieces.sum()), np.ones(pieces.sum())
    ends = np.cumsum(pieces)
    for i in np.flatnonzero(pieces > 1):
        at, n = int(lens[:i].sum()), int(pieces[i]) - 1
        whole, p0 = e[at : at + n * size], ends[i] - pieces[i]
        for k, m in enumerate(_transfer(whole, n, size, ct, tc, tt)):
            g = lead[p0 + k]
            lead[p0 + k + 1] = (m[0, 0] * g + m[0, 1]) / (m[1, 0] * g + m[1, 1])
        rest = e[at + n * size : at + lens[i]]
        last = _transfer(rest[::-1], 1, len(rest), tc, ct, tt)
        later = _transfer(e[at + size : at + n * size].reshape(n - 1, size)[:, ::-1], n - 1, size, tc, ct, tt) if n > 1 else last[:0]
        for k, m in reversed(list(enumerate(np.concatenate([later, last])))):
            g = tail[p0 + k + 1]
            tail[p0 + k] = (m[0, 0] * g + m[0, 1]) / (m[1, 0] * g + m[1, 1])
    return lead, tail


def marginals(emit: np.ndarray, lens: np.ndarray, chain: tuple[float, float, float], size: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token given all tokens, and given those up to it.

    ``emit`` holds the sequences one after another. With two states the forward and backward messages
    are odds, and each step is one fraction. Long sequences are cut into pieces of ``size`` tokens:
    the messages at their borders come from products of the steps' matrices, all pieces of a sequence
    at once, and then all pieces advance together. So a very long text costs no step of its own for
    each of its tokens."""
    if not len(emit):
        return np.zeros(0), np.zeros(0)
    ct, tc, tt = np.exp(chain)
    raw = np.exp(np.clip(emit, -30, 30))
    pieces = -(-lens // size)
    lead, tail = _borders(raw, lens, size, (ct, tc, tt))
    cut = np.full(pieces.sum(), size)
    cut[(np.cumsum(pieces) - 1)[pieces > 0]] = (lens - (pieces - 1) * size)[pieces > 0]
    order, active, first, place = _time_major(cut)
    e = np.empty(len(emit))
    e[place] = raw
    ahead = np.empty_like(e)
    ahead[: active[0]] = e[: active[0]] * lead[order]
    for t in range(1, len(active)):
        o = ahead[first[t - 1] : first[t - 1] + active[t]]
        ahead[first[t] : first[t + 1]] = e[first[t] : first[t + 1]] * (ct + tt * o) / (1 + tc * o)
    back = np.empty_like(e)
    back[first[cut[order] - 1] + np.arange(len(cut))] = tail[order]
    for t in range(len(active) - 2, -1, -1):
        x = e[first[t + 1] : first[t + 2]] * back[first[t + 1] : first[t + 2]]
        back[first[t] : first[t] + active[t + 1]] = (tc + tt * x) / (1 + ct * x)
    odds = ahead * back
    return (odds / (1 + odds))[place], (ahead / (1 + ahead))[place]


def _evidence(sample: DataFrame, n_toxic: int, n_clean: int, least: int) -> list[tuple[str, float, int]]:
    """(feature, log odds, toxic documents) of the features in at least ``least`` documents of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                for f in set(features(text or "")):
                    seen.setdefault(f, [0, 0])[toxic] += 1
            yield pa.record_batch({"f": pa.array(list(seen), pa.string()), "clean": pa.array([v[0] for v in seen.values()], pa.int64()), "toxic": pa.array([v[1] for v in seen.values()], pa.int64())})

    counts = sample.select("toxic", "text").mapInArrow(run, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    found = counts.where(F.col("toxic") + F.col("clean") >= least).select("f", odds.alias("odds"), "toxic").where("abs(odds) > 1").orderBy("f")
    rows = found.toArrow()
    return list(zip(*(rows[c].to_pylist() for c in ("f", "odds", "toxic"))))


def _varied(sample: DataFrame, toxic_in: dict[str, int]) -> set[str]:
    """The features whose tokens stand between many different words. Copies of one passage would lend
    any rare word the evidence of many documents, but they repeat its neighbours too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for text in b.column("text").to_pylist():
                tokens = (text or "").lower().split()
                for i, token in enumerate(tokens):
                    for f in features(token):
                        if f in toxic_in:
                            seen.add((f, f"{tokens[i - 1] if i else ''} {tokens[i + 1] if i + 1 < len(tokens) else ''}"))
            yield pa.record_batch({"f": pa.array([f for f, _ in seen], pa.string()), "around": pa.array([c for _, c in seen], pa.string())})

    rows = sample.where("toxic = 1").select("text").mapInArrow(run, "f string, around string").distinct().groupBy("f").agg(F.count("*").alias("n")).collect()
    return {r.f for r in rows if 2 * r.n >= toxic_in[r.f]}


def _sequences(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of coded documents: token counts, features per token, features, token labels, document labels."""
    per_token = b.column("n_features")
    lens = per_token.value_lengths().to_numpy(zero_copy_only=False)
    return lens, per_token.flatten().to_numpy(), b.column("feature").flatten().to_numpy(), b.column("label").flatten().to_numpy(), b.column("toxic").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, fit_toxic: int = 2000, fit_clean: int = 4000, rounds: int = 15) -> Model:
    """A model from the labelled training documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(is_training)
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):
        return Model({}, 0.0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), totals.get(1, 0) / max(1, sum(totals.values())))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(fit_toxic).union(known.where("toxic = 0").orderBy(*by_hash).limit(fit_clean))
    near = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most fit_toxic + fit_clean ids
    sample = materialize(near.groupBy("toxic", F.xxhash64("text").alias("h")).agg(F.min_by("text", "doc_id").alias("text")).repartition(16, "h"), "toxicity-sample")
    n_toxic, n_clean = (sample.where(F.col("toxic") == k).count() for k in (1, 0))
    if not (n_toxic and n_clean):
        return Model({}, 0.0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), totals[1] / sum(totals.values()))
    least = max(3, round(0.01 * n_toxic))  # documents: rarer words say nothing about toxicity itself
    found = _evidence(sample, n_toxic, n_clean, least)
    number = {f: n for n, (f, _, _) in enumerate(found)}
    strong = _varied(sample, {f: toxic for f, odds, toxic in found if odds > 3 and toxic >= least})
    n = len(found)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens as feature numbers, with their weak labels."""
        for b in batches:
            out: dict[str, list] = {"toxic": [], "n_features": [], "feature": [], "label": []}
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                counts, flat, marks = [], [], []
                for token in (text or "").split():
                    fs = [f for f in set(features(token)) if f in number]
                    counts.append(len(fs))
                    flat += [number[f] for f in fs]
                    marks.append(int(toxic and any(f in strong for f in fs)))
                marks = [int(m or (0 < i < len(marks) - 1 and marks[i - 1] and marks[i + 1])) for i, m in enumerate(marks)]
                for k, v in zip(out, (toxic, counts, flat, marks)):
                    out[k].append(v)
            kind = pa.list_(pa.int32())
            yield pa.record_batch({"toxic": pa.array(out["toxic"], pa.int32()), **{k: pa.array(out[k], kind) for k in ("n_features", "feature", "label")}})

    coded = materialize(sample.select("toxic", "text").mapInArrow(code, "toxic int, n_features array<int>, feature array<int>, label array<int>"), "toxicity-coded")

    def gradient(w: np.ndarray) -> np.ndarray:
        """Observed minus expected counts of features, bias and the three transitions."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros(n + 4)
            for b in batches:
                lens, per_token, feature, y, _ = _sequences(b)
                if not len(y):
                    continue
                owner = np.repeat(np.arange(len(y)), per_token)
                emit = w[n] + np.bincount(owner, w[feature], len(y))
                p, ahead = marginals(emit, lens, tuple(w[n + 1 :]))
                g[:n] += np.bincount(feature, (y - p)[owner], n)
                g[n] += (y - p).sum()
                inner = np.ones(len(y), bool)
                inner[np.cumsum(lens)[lens > 0] - 1] = False
                at = np.flatnonzero(inner)
                # pair marginals: given the next state j, the filtered state i before it has weight ahead * T
                ct, tc, tt = np.exp(w[n + 1 :])
                a, q = ahead[at], p[at + 1]
                from_toxic_if_1 = a * tt / (a * tt + (1 - a) * ct)
                from_toxic_if_0 = a * tc / (a * tc + (1 - a))
                g[n + 1] += (y[at + 1] * (1 - y[at])).sum() - (q * (1 - from_toxic_if_1)).sum()
                g[n + 2] += ((1 - y[at + 1]) * y[at]).sum() - ((1 - q) * from_toxic_if_0).sum()
                g[n + 3] += (y[at + 1] * y[at]).sum() - (q * from_toxic_if_1).sum()
            yield pa.record_batch({"g": pa.array([g.tobytes()], pa.binary())})

        return np.sum([np.frombuffer(r.g) for r in coded.mapInArrow(run, "g binary").collect()], axis=0)

    w = np.array([0.5 * odds for _, odds, _ in found] + [-6.0, -3.0, 0.0, 0.0])
    m, v = np.zeros(n + 4), np.zeros(n + 4)
    for r in range(1, rounds + 1):  # Adam on the penalised log likelihood
        g = gradient(w) - 0.1 * w
        m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
        w = w + 0.3 * (m / (1 - 0.8**r)) / (np.sqrt(v / (1 - 0.95**r)) + 1e-6)
    chain = tuple(map(float, w[n + 1 :]))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens, per_token, feature, y, toxic = _sequences(b)
            emit = w[n] + np.bincount(np.repeat(np.arange(len(y)), per_token), w[feature], len(y)) if len(y) else np.zeros(0)
            total, top = document_sums(marginals(emit, lens, chain)[0], lens)
            yield pa.record_batch({"toxic": pa.array(toxic, pa.int32()), "total": pa.array(total), "top": pa.array(top)})

    rows = coded.mapInArrow(summarise, "toxic int, total double, top double").toPandas()  # three numbers a sample row
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows["total"]), rows["top"]])
    t = rows["toxic"].to_numpy(float)
    share = totals[1] / sum(totals.values())
    weight = np.where(t > 0, share / t.mean(), (1 - share) / (1 - t.mean()))
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps of the weighted, penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (weight * (t - p)) - 0.05 * beta)
    return Model({f: float(w[k]) for f, k in number.items()}, float(w[n]), chain, tuple(map(float, beta)))


def document_sums(p: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum of the marginals of each sequence; 0 for empty ones."""
    total, top = np.zeros(len(lens)), np.zeros(len(lens))
    full = lens > 0
    if full.any():
        starts = (np.cumsum(lens) - lens)[full]
        total[full], top[full] = np.add.reduceat(p, starts), np.maximum.reduceat(p, starts)
    return total, top


def score(docs: DataFrame, model: Model, group: int = 2000) -> DataFrame:
    """(doc_id, score, n_toxic, starts, ends): offsets (code points, ends exclusive) of the tokens
    that are rather toxic than not. One pass, no shuffle; the model is as large as the sample's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit_of = emissions(model.weights, model.bias)
        for whole in batches:
            for b in slices(whole, group):
                texts = [t or "" for t in b.column("text").to_pylist()]
                values, lens = [], np.zeros(len(texts), np.int64)
                for i, t in enumerate(texts):
                    words = t.split()
                    lens[i] = len(words)
                    values.append(np.fromiter(map(emit_of.__getitem__, words), float, len(words)))
                p, _ = marginals(np.concatenate(values) if values else np.zeros(0), lens, model.chain)
                total, top = document_sums(p, lens)
                c, s, m = model.scale
                scores = 1 / (1 + np.exp(-np.clip(c + s * np.log1p(total) + m * top, -500, 500))) if model.constant is None else np.full(len(texts), model.constant)
                first = np.cumsum(lens) - lens
                hits = np.flatnonzero(p > 0.5)
                owner = np.searchsorted(first, hits, "right") - 1
                starts, ends = [[] for _ in texts], [[] for _ in texts]
                for i in np.unique(owner):
                    spans = [m.span() for m in re.finditer(r"\S+", texts[i])]
                    for h in hits[owner == i] - first[i]:
                        starts[i].append(spans[h][0])
                        ends[i].append(spans[h][1])
                kind = pa.list_(pa.int32())
                yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(scores, pa.float64()), "n_toxic": pa.array([len(x) for x in starts], pa.int64()), "starts": pa.array(starts, kind), "ends": pa.array(ends, kind)})

    return id_and_text(docs).mapInArrow(run, SCORE_SCHEMA)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    spans = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))), ",")
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", spans.alias("spans"))
