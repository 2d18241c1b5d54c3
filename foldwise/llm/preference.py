"""Quality scores from preference pairs: a Bradley-Terry model on feature differences.

Features are built-in expressions over the whole text, computed once per document.  Pairs say
that a document labelled 1 is preferred to one labelled 0; logistic loss on the difference of
their features gives one weight per feature.  The threshold is the quantile of training scores
that errs least, and scores are mapped so that it falls on ``CUT``.

The fit sees every labelled row that is not held out.  Rows of either kind are dealt in the order of
a hash to groups of about ``GROUP`` rows, where each row of the larger kind meets ``PARTNERS`` of the
other, so pairs grow with the rows; a Newton step adds up what the groups tell.  Quantiles are exact order
statistics.  Defined results: null and empty texts have all ratios 0 and get a score; without
labels of both kinds every weight is 0 and the score is ``CUT`` or more for all; repeated rows
score alike; null ids are scored and never learned from; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm import quality_rules
from foldwise.llm.text import let, small_batches, whole, words
from foldwise.session import materialize

CUT = 0.3
GROUP = 20_000
PARTNERS = 20
CHUNK = 1 << 17
CUTS = 400
STEPS = 50
RIDGE = 1e-2
SLOPES = tuple(2.0**k for k in range(-3, 3))
START = math.log(CUT / (1 - CUT))
NAMES = (
    "log_words", "symbols", "exclamations", "stop_words", "word_chars", "repeated_windows", "duplicate_lines", "upper", "digits", "twins",
    "different", "marks",
)


def features(text: str = "text") -> Column:
    """Array of doubles in the order of ``NAMES``, each between 0 and about 1."""
    t = whole(text)

    def left_by(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    def of_words(w: Column) -> Column:
        same = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: a == b)
        return F.struct(F.when(F.size(w) > 1, F.size(F.filter(same, lambda x: x))).otherwise(0).alias("twins"), F.size(F.array_distinct(w)).alias("different"))

    def build(x: Column) -> Column:
        m = x["m"]
        n, chars = m["n_words"], x["chars"]

        def ratio(a, b, top=1.0) -> Column:
            return F.least(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)) / top, F.lit(1.0))

        return F.array(
            F.log1p(n.cast("double")) / 10.0, ratio(m["n_symbols"], n), ratio(m["n_exclamations"], n), ratio(m["n_stop_words"], n),
            ratio(m["word_chars"], n, 20.0), ratio(m["n_repeat_words"], n), ratio(m["n_dup_lines"], m["n_lines"]), ratio(x["upper"], chars),
            ratio(x["digits"], chars), ratio(x["w"]["twins"], n), ratio(x["w"]["different"], n), ratio(x["marks"], n),
        )

    return let(
        F.struct(
            quality_rules.measures(text).alias("m"), let(words(F.col(text)), of_words).alias("w"), F.length(t).alias("chars"),
            left_by("[^A-ZÀ-ÖØ-Þ]+").alias("upper"), left_by("[^0-9]+").alias("digits"), left_by(r"[^\p{Punct}]+").alias("marks"),
        ),
        build,
    )


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(folds)) == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float

    def score(self, x: Column) -> Column:
        """Probability-like score of a feature array; ``CUT`` at the threshold."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(START) + F.lit(self.slope) * (self.raw(x) - F.lit(self.threshold)))))

    def raw(self, x: Column) -> Column:
        """Weighted sum of a feature array."""
        raw = F.lit(0.0)
        for k, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights, strict=True)):
            raw = raw + (x[k] - F.lit(m)) * F.lit(w / s)
        return raw


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs of one group, then gradient and Hessian of its log-likelihood at ``w``."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    out = np.zeros(1 + len(w) + len(w) ** 2)
    n = max(len(good), len(bad)) * min(PARTNERS, len(good), len(bad))
    for start in range(0, n, CHUNK):
        k = np.arange(start, min(start + CHUNK, n))
        # both sides are walked in full; the shift changes the partner each time round
        d = z[good[k % len(good)]] - z[bad[(k + k // len(good)) % len(bad)]]
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        out += np.concatenate([[len(k)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
    return out


def newton(size: int, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Ridge weights of the largest likelihood; ``sums`` adds up :func:`pair_sums` over all groups."""
    w = np.zeros(size)
    for _ in range(STEPS):
        s = sums(w)
        grad, hess = s[1 : 1 + size] / s[0] - RIDGE * w, s[1 + size :].reshape(size, size) / s[0] + RIDGE * np.eye(size)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    """Bradley-Terry weights, the threshold quantile and the slope from feature rows and 0/1 labels: one group."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    w, t, slope = np.zeros(len(mean)), 0.0, 1.0
    if len(x) and 0 < (y == 1).sum() < len(y):
        z = (x - mean) / scale
        w = newton(len(mean), lambda w: pair_sums(z, y, w))
        s = z @ w
        cuts = np.quantile(s, np.linspace(0, 1, CUTS + 1))
        wrong = np.array([np.sum((s >= c) != (y == 1)) for c in cuts])
        best = cuts[wrong == wrong.min()]
        t = float((best[0] + best[-1]) / 2)
        loss = [np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * (START + a * (s - t)))) for a in SLOPES]
        slope = SLOPES[int(np.argmin(loss))]
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), t, slope)


def _placed(rows: DataFrame, order: list, size: Column) -> DataFrame:
    """``rows`` in ascending order of ``order`` over range partitions, with ``part`` and the sum of ``size`` in ``earlier`` parts."""
    laid = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *rows.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
    ))
    earlier, at = [], 0
    for r in sorted(laid.groupBy("part").agg(F.sum(size).alias("n")).collect()):
        earlier.append((r["part"], at))
        at += r["n"]
    return laid.join(laid.sparkSession.createDataFrame(earlier, "part int, earlier long"), "part")


def groups(train: DataFrame, good: int, bad: int, group: int) -> DataFrame:
    """One row per group: ``y`` and, one after the other, the feature arrays ``x`` in the order of ids.

    Every row is in a group.  The larger kind is cut into equal runs; the other kind too, but a run that is shorter than
    ``PARTNERS`` goes on with the next rows, those of the following runs.
    """
    h = F.xxhash64("doc_id")
    ranked = _placed(train, [F.col("y"), h, F.col("doc_id"), F.col("x")], F.lit(1))
    rank = F.col("at") + F.col("earlier") - F.when(F.col("y") == 1, F.lit(bad)).otherwise(F.lit(0))
    ranked = ranked.select("doc_id", "y", "x", rank.alias("rank"))
    many, few, larger = max(good, bad), min(good, bad), int(good >= bad)
    count = -(-(good + bad) // group)
    own = ranked.filter(F.col("y") == larger).withColumn("g", F.expr(f"rank * {count} div {many}"))
    start, end = F.expr(f"id * {few} div {count}"), F.expr(f"(id + 1) * {few} div {count}")
    taken = F.greatest(end - start, F.lit(min(PARTNERS, few)))
    wanted = train.sparkSession.range(count).select(F.col("id").alias("g"), F.explode(F.sequence(start, start + taken - 1)).alias("rank"))
    other = ranked.filter(F.col("y") != larger).join(wanted.withColumn("rank", F.pmod("rank", F.lit(few))), "rank")
    both = own.select("g", "doc_id", "y", "x").unionByName(other.select("g", "doc_id", "y", "x"))
    packed = both.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("doc_id", "y", "x"))).alias("r"))
    return materialize(packed.select(F.col("r.y").alias("y"), F.flatten("r.x").alias("x")))


def _added(rows: DataFrame, length: int, tell: Callable) -> np.ndarray:
    """Sum over all rows of what ``tell`` makes of a record batch; a task sends one array."""
    small_batches(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(length)
        for b in batches:
            total += tell(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    told = np.array([r["s"] for r in rows.mapInArrow(run, "s array<double>").collect()])
    return np.array([math.fsum(c) for c in told.reshape(-1, length).T])


def fit_weights(packed: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    size = len(mean)

    def sums(w):
        def tell(b):
            out = np.zeros(1 + size + size * size)
            for y, x in zip(b.column("y"), b.column("x"), strict=True):
                z = (x.values.to_numpy().reshape(-1, size) - mean) / scale
                out += pair_sums(z, y.values.to_numpy(), w)
            return out

        return _added(packed, 1 + size + size * size, tell)

    return newton(size, sums)


def quantile_cuts(scores: DataFrame, n: int) -> np.ndarray:
    """The ``CUTS`` + 1 evenly spaced quantiles of ``s``; ``scores`` has each value once and its ``n`` rows."""
    laid = _placed(scores, [F.col("s")], F.col("n"))
    before = F.col("earlier") + F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = laid.select("s", before.alias("lo"), (before + F.col("n")).alias("hi"))
    # those whose ranks lo to hi - 1 hold the rank below or above one of the quantiles
    first = F.when(F.col("lo") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"(lo - 1) * {CUTS} div {n - 1} + 1"))
    needed = sorted(tuple(r) for r in spans.filter((first <= CUTS) & (first * (n - 1) < F.col("hi") * CUTS)).collect())
    value, hi = np.array([r[0] for r in needed]), np.array([r[2] for r in needed])
    k = np.arange(CUTS + 1)
    low, part = k * (n - 1) // CUTS, (k * (n - 1) % CUTS) / CUTS
    a = value[np.searchsorted(hi, low, "right")]
    b = value[np.searchsorted(hi, np.minimum(low + (part > 0), n - 1), "right")]
    return np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part))


def fit(featured: DataFrame, labels: DataFrame, x: str = "x", doc_id: str = "doc_id", label: str = "quality", group: int = GROUP) -> Model:
    """Learn from all labelled rows of ``featured`` that are not held out; ``group`` bounds the rows that meet in one task."""
    y = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    train = featured.filter(~held_out(doc_id)).select(F.col(doc_id).alias("doc_id"), F.col(x).alias("x"))
    train = materialize(train.join(y, "doc_id").select("doc_id", "y", "x"))
    size, at = len(NAMES), [F.col("x")[k] for k in range(len(NAMES))]
    n, good, *moments = train.agg(F.count(F.lit(1)), F.sum("y"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if not n:
        return Model((0.0,) * size, (1.0,) * size, (0.0,) * size, 0.0, 1.0)
    mean, scale = np.array(moments[:size]), np.array(moments[size:]) + 1e-6
    model = Model(tuple(mean.tolist()), tuple(scale.tolist()), (0.0,) * size, 0.0, 1.0)
    if not 0 < good < n:
        return model
    model = replace(model, weights=tuple(fit_weights(groups(train, good, n - good, group), mean, scale).tolist()))
    scores = train.select(model.raw(F.col("x")).alias("s"), "y").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))
    scores = materialize(scores)
    cuts = quantile_cuts(scores.select("s", "n"), n)

    def tell(b):
        below = np.searchsorted(cuts, b.column("s").to_numpy(), "right")
        rows, ones = (b.column(c).to_numpy() for c in ("n", "good"))
        return np.concatenate([np.bincount(below, c, len(cuts) + 1) for c in (ones, rows - ones)])

    ones, zeros = _added(scores, 2 * len(cuts) + 2, tell).reshape(2, -1)
    # a cut errs on the good rows below it and on the others from it on
    wrong = np.cumsum(ones)[:-1] + zeros.sum() - np.cumsum(zeros)[:-1]
    best = cuts[wrong == wrong.min()]
    t = float((best[0] + best[-1]) / 2)

    def soft(v: Column) -> Column:
        return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))

    u = [F.lit(START) + F.lit(a) * (F.col("s") - F.lit(t)) for a in SLOPES]
    loss = scores.agg(*[F.sum(F.col("good") * soft(-v) + (F.col("n") - F.col("good")) * soft(v)) for v in u]).first()
    return replace(model, threshold=t, slope=SLOPES[int(np.argmin(loss))])
