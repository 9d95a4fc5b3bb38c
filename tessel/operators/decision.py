"""Long-only mean-variance weights, month after month.

A month's weights depend on the month before, so a score source is a sequence of months; sources run side by side. Within
a month the work is spread over its names: the covariance comes from a few past months, so the optimum is described by
one price for each of them and one for the sum of weights. Those dozen prices live on the driver, each Newton step on the
dual is one aggregate over the month's names, and given the prices each name's weight is a formula of its own row. The
weights are written and joined to the next month's names. No task holds a month, let alone a panel.

Few names get a weight, and which ones decides the prices. So the prices are found on a few names first (START_NAMES, drawn
by hash) by an interior point method; a pass over the month sums the dual there and returns the names that would get a
weight at these prices, which join the few until no name is left out. Where the few would become more than HELD_NAMES, the
steps on the dual go on from there. The sums over all names alone tell when a month is solved.

optimal_weights solves one month whose names are at hand as arrays, as a function of its own and as a check of the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.tables import remove, scratch_path, written
from tessel.functions.windows import nan_to_null
from tessel.operators import portfolio

#: Names of a month that one task takes, about.
TASK_NAMES = 100_000
#: Names of a month, drawn by hash, that its prices are first found on.
START_NAMES = 1_000
#: Names that a task adds to these in a pass, and names that the driver holds at most.
NEW_NAMES, HELD_NAMES = 1_000, 20_000


def _prox(v: np.ndarray, before: np.ndarray, penalty: float, cap: float) -> np.ndarray:
    """argmin of penalty * |w - before| + |w - v|^2 / 2 over sum(w) = 1 and 0 <= w <= cap, by bisection on the sum's price."""

    def at(price: float) -> np.ndarray:
        d = v - price - before
        return np.clip(before + np.sign(d) * np.maximum(np.abs(d) - penalty, 0.0), 0.0, cap)

    lo, hi = float(v.min() - before.max() - penalty - cap - 2), float(v.max() + penalty + 2)
    for _ in range(100):
        mid = (lo + hi) / 2
        if at(mid).sum() > 1.0:
            lo = mid
        else:
            hi = mid
    return at((lo + hi) / 2)


@dataclass(frozen=True)
class LowRank:
    """A covariance rows' rows + ridge I, never made as a matrix: a dozen months say no more about any number of names."""

    rows: np.ndarray
    ridge: float

    @staticmethod
    def of(covariance: np.ndarray) -> LowRank:
        values, vectors = np.linalg.eigh(covariance)
        keep = values > 0
        return LowRank(np.sqrt(values[keep])[:, None] * vectors[:, keep].T, 0.0)

    def dense(self) -> np.ndarray:
        return self.rows.T @ self.rows + self.ridge * np.eye(self.rows.shape[1])

    def times(self, y: np.ndarray) -> np.ndarray:
        return self.rows.T @ (self.rows @ y) + self.ridge * y

    def top(self) -> float:
        return self.ridge + (float(np.linalg.eigvalsh(self.rows @ self.rows.T)[-1]) if len(self.rows) else 0.0)


def _dual_weights(expected: np.ndarray, risk: LowRank, before: np.ndarray, ra: float, tp: float, cp: float, cap: float, steps: int = 200) -> np.ndarray | None:
    """The minimiser by Newton steps on the dual, with one price for each of the covariance's rows.

    Given these prices the price of the sum follows from sorted break points, and each weight in closed form; the dual
    is strongly concave and of a dozen dimensions. None where the steps don't settle.
    """
    curve = 2 * (cp + ra * risk.ridge)
    if curve <= 0:
        return None
    rows = risk.rows if ra > 0 else risk.rows[:0]
    own, k = 1 / (2 * ra) if ra > 0 else 0.0, tp / curve
    before = np.clip(before, 0.0, cap)
    ends = np.concatenate([np.full(len(before), -k), before - k, before + k, np.full(len(before), cap + k)]) * curve
    turns = np.repeat([1.0, -1.0, 1.0, -1.0], len(before))  # weights rise between the first two ends and the last two

    def at(price: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        pull = expected - price @ rows
        t = ends - np.tile(pull, 4)
        order = np.argsort(t)
        t, rise = t[order], np.cumsum(turns[order])
        total = np.concatenate([[0.0], np.cumsum(np.diff(t) * rise[:-1])]) / curve
        j = min(max(1, int(np.searchsorted(total, 1.0))), len(t) - 1)
        level = t[j - 1] + (1.0 - total[j - 1]) * curve / max(rise[j - 1], 1.0)
        v = (pull + level) / curve
        d = v - before
        moved = before + np.sign(d) * np.maximum(np.abs(d) - k, 0.0)
        w = np.clip(moved, 0.0, cap)
        free = (np.abs(d) > k) & (moved > 0) & (moved < cap)
        value = float((curve / 2 * w * w - pull * w + tp * np.abs(w - before)).sum() - own * (price @ price) / 2)
        return w, free, rows @ w - own * price, value

    price = np.zeros(len(rows))
    w, free, slope, value = at(price)
    for _ in range(steps):
        if not len(rows) or np.abs(slope).max() < 1e-11 * (1 + np.abs(rows).max()):
            return w
        a = rows[:, free]
        mean = a.sum(axis=1)
        bend = (a @ a.T - np.outer(mean, mean) / max(1, a.shape[1])) / curve + own * np.eye(len(rows))
        step, size = np.linalg.solve(bend, slope), 1.0
        gain = float(step @ slope)
        found = at(price + step)
        while found[3] < value + 1e-4 * size * gain and size > 1e-10:
            size /= 2
            found = at(price + size * step)
        if size <= 1e-10:
            break
        price = price + size * step
        w, free, slope, value = found
    return w if np.abs(slope).max() < 1e-7 * (1 + np.abs(rows).max()) else None


def _proximal_weights(expected: np.ndarray, risk: LowRank, before: np.ndarray, ra: float, tp: float, cp: float, cap: float, steps: int) -> np.ndarray:
    """The same by accelerated proximal gradient steps."""
    step = 1.0 / max(2 * ra * risk.top() + 2 * cp, 1e-3)
    w = y = np.full(len(expected), 1.0 / len(expected))
    t = 1.0
    for _ in range(steps):
        grad = -expected + 2 * ra * risk.times(y) + 2 * cp * y
        new = _prox(y - step * grad, before, step * tp, cap)
        if (y - new) @ (new - w) > 0:
            t = 1.0  # restart where momentum points uphill
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / nt * (new - w)
        done = np.abs(new - w).max() < 1e-12
        w, t = new, nt
        if done:
            break
    return w


def optimal_weights(expected: np.ndarray, covariance: np.ndarray | LowRank, before: np.ndarray, risk_aversion: float = 5.0, turnover_penalty: float = 0.05, concentration_penalty: float = 0.01, max_weight: float = 0.25, steps: int = 3000) -> np.ndarray:
    """Minimise -mu'w + ra w'Cw + tp |w - before| + cp |w|^2 with sum 1 and 0 <= w <= min(max_weight, 1).

    Equal weights where the cap can't hold or the input isn't finite.
    """
    n, cap = len(expected), min(max_weight, 1.0)
    held = covariance.rows if isinstance(covariance, LowRank) else covariance
    if n * cap < 1.0 or not (np.isfinite(expected).all() and np.isfinite(held).all()):
        return np.full(n, 1.0 / n)
    risk = covariance if isinstance(covariance, LowRank) else LowRank.of(covariance)
    given = (risk_aversion, turnover_penalty, concentration_penalty, cap)
    w = _dual_weights(expected, risk, before, *given)
    if w is None:
        w = _proximal_weights(expected, risk, before, *given, steps)
    w = np.clip(w, 0.0, None)
    return w / w.sum()


def trailing_covariance(history: np.ndarray, lookback: int) -> LowRank:
    """Covariance (ddof 1) of the last `lookback` rows, missing values as 0, plus 1e-6 on the diagonal; 0.05 I for under two rows."""
    past = history[-lookback:]
    if len(past) < 2:
        return LowRank(np.zeros((0, history.shape[1])), 0.05)
    past = np.nan_to_num(past)
    return LowRank((past - past.mean(axis=0)) / np.sqrt(len(past) - 1), 1e-6)


@dataclass(frozen=True)
class Terms:
    """The objective's settings for a month: curvature of a weight's own square, risk, turnover penalty, cap."""

    curve: float
    own: float
    penalty: float
    cap: float

    @staticmethod
    def of(months: int, risk_aversion: float, turnover_penalty: float, concentration_penalty: float, max_weight: float) -> Terms:
        ridge = 1e-6 if months > 1 else 0.05
        return Terms(max(2 * (concentration_penalty + risk_aversion * ridge), 1e-9), 1 / (2 * risk_aversion) if risk_aversion > 0 else 0.0, turnover_penalty, min(max_weight, 1.0))

    def weights(self, pull: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Each name's weight under its pull (expected value less the prices of its risk, plus the sum's price)."""
        move = pull / self.curve - before
        return np.clip(before + np.sign(move) * np.maximum(np.abs(move) - self.penalty / self.curve, 0.0), 0.0, self.cap)


@dataclass
class Point:
    """Prices (of past months, and last of the sum of weights) with the dual's value, slope and curvature there."""

    prices: np.ndarray
    value: float = -np.inf
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bend: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    total: float = 0.0

    def steepness(self) -> float:
        return float(np.abs(self.slope).max())


def _columns(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected, before, past deviations) of a batch of names; k of the deviations count."""
    deviations = batch.column("past").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if k else np.zeros((batch.num_rows, 0))
    return batch.column("score").to_numpy(zero_copy_only=False), np.clip(batch.column("before").to_numpy(zero_copy_only=False), 0.0, None), deviations


def _sums(names: tuple[np.ndarray, np.ndarray, np.ndarray], points: list[np.ndarray], terms: Terms, k: int) -> np.ndarray:
    """For each point the sums over names that the dual is made of: value, weights, free names, and deviations of both."""
    expected, before, past = names
    before = np.minimum(before, terms.cap)
    out = np.zeros((len(points), 3 + 2 * k + k * k))
    for s, p in zip(out, points):
        pull = expected - past @ p[:k] + p[k]
        w = terms.weights(pull, before)
        free = (w > 0) & (w < terms.cap) & (np.abs(pull / terms.curve - before) > terms.penalty / terms.curve)
        own = past[free]
        s[:3] = (terms.curve / 2 * w * w - pull * w + terms.penalty * np.abs(w - before)).sum(), w.sum(), free.sum()
        s[3 : 3 + k], s[3 + k : 3 + 2 * k], s[3 + 2 * k :] = w @ past, own.sum(axis=0), (own.T @ own).ravel()
    return out


def _point(p: np.ndarray, s: np.ndarray, terms: Terms, k: int) -> Point:
    price, bend = p[:k], np.zeros((k + 1, k + 1))
    bend[:k, :k] = s[3 + 2 * k :].reshape(k, k) / terms.curve + terms.own * np.eye(k)
    bend[:k, k] = bend[k, :k] = -s[3 + k : 3 + 2 * k] / terms.curve
    bend[k, k] = max(s[2], 1.0) / terms.curve
    return Point(p, float(s[0] + p[k] - terms.own * (price @ price) / 2), np.append(s[3 : 3 + k] - terms.own * price, 1.0 - s[1]), bend, float(s[1]))


def _summed(names: DataFrame, points: list[np.ndarray], terms: Terms, k: int) -> np.ndarray:
    """_sums over a month's names in Spark; a task returns (k + 3)^2 numbers of each point."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(points), 3 + 2 * k + k * k))
        for batch in batches:
            sums += _sums(_columns(batch, k), points, terms, k)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["point", "sums"])

    total = np.zeros((len(points), 3 + 2 * k + k * k))
    for r in names.select("score", "before", "past").mapInArrow(partial, "point int, sums array<double>").collect():
        total[r["point"]] += r["sums"]
    return total


def climb(summed: Callable[[list[np.ndarray]], np.ndarray], points: list[np.ndarray], terms: Terms, k: int, tolerance: float, steps: int = 2_000) -> Point:
    """The maximiser of a month's dual from the best of `points`: Newton steps, each tried at several lengths in one pass."""
    best, shrink, sizes = None, 1.0, [2.0**-i for i in range(10)]
    for _ in range(steps):
        found = [_point(p, s, terms, k) for p, s in zip(points, summed(points))]
        top = max(p.value for p in found)
        near = min((p for p in found if p.value >= top - 1e-14 * (1 + abs(top))), key=Point.steepness)
        if best is None or near.value > best.value or (near.value >= best.value - 1e-13 * (1 + abs(best.value)) and near.steepness() < best.steepness()):
            best, shrink = near, 1.0
        else:  # each length goes too far, past a kink
            shrink *= 2.0 ** -len(sizes)
            if shrink < 1e-12:
                break
        if best.steepness() < tolerance:
            break
        step = np.linalg.solve(best.bend + 1e-14 * np.trace(best.bend) / (k + 1) * np.eye(k + 1), best.slope)
        points = [best.prices + shrink * size * step for size in sizes]
    return best


def interior_prices(names: tuple[np.ndarray, np.ndarray, np.ndarray], terms: Terms, k: int, tolerance: float = 1e-10, steps: int = 100) -> np.ndarray:
    """The prices of a few names by a predictor-corrector interior point method, close to the dual's maximiser.

    Each name's weight is what it held, plus what is bought, less what is sold; both have bounds and the same curvature.
    """
    expected, before, past = names
    before, curve = np.minimum(before, terms.cap), terms.curve
    buys, sells = np.flatnonzero(before < terms.cap), np.flatnonzero(before > 0)
    who, sign = np.concatenate([buys, sells]), np.repeat([1.0, -1.0], [len(buys), len(sells)])
    most = np.where(sign > 0, terms.cap - before[who], before[who])
    cost = sign * (curve * before[who] - expected[who]) + terms.penalty
    pulls = np.column_stack([-past[:, :k], np.ones(len(expected))])
    unit = np.abs(pulls).max(axis=0)
    unit[unit == 0] = 1.0
    want, own = (np.append(np.zeros(k), 1.0) - before @ pulls) / unit, np.append(np.full(k, terms.own), 0.0) / unit**2
    pulls, large = sign[:, None] * pulls[who] / unit, 1 + np.abs(cost).max()
    x, prices = most / 2, np.zeros(k + 1)
    low, high = np.full(len(x), large), np.full(len(x), large)  # multipliers of the bounds

    def room(v: np.ndarray, step: np.ndarray) -> float:
        return float((-v[step < 0] / step[step < 0]).min(initial=1.0))

    for _ in range(steps):
        rest, gap = most - x, float(x @ low + (most - x) @ high)
        slope, off = curve * x + cost - pulls @ prices - low + high, pulls.T @ x + own * prices - want
        if gap < tolerance / 100 * large and max(np.abs(slope).max() / large, np.abs(off).max()) < tolerance:
            break
        bend = curve + low / x + high / rest
        matrix = (pulls.T / bend) @ pulls + np.diag(own)
        matrix += 1e-15 * np.diag(np.diag(matrix))

        def move(to_low, to_high) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            pulled = slope + low - to_low / x - high + to_high / rest
            d = np.linalg.solve(matrix, pulls.T @ (pulled / bend) - off)
            dx = (pulls @ d - pulled) / bend
            return d, dx, (to_low - low * (x + dx)) / x, (to_high - high * (rest - dx)) / rest

        _, dx, dl, dh = move(0.0, 0.0)
        a, b = min(room(x, dx), room(rest, -dx)), min(room(low, dl), room(high, dh))
        after = (x + a * dx) @ (low + b * dl) + (rest - a * dx) @ (high + b * dh)
        centre = (after / gap) ** 3 * gap / (2 * len(x))
        d, dx, dl, dh = move(centre - dx * dl, centre + dx * dh)
        size = 0.995 * min(room(x, dx), room(rest, -dx), room(low, dl), room(high, dh))
        if not np.isfinite(d).all() or size < 1e-12:
            break
        x, low, high, prices = x + size * dx, low + size * dl, high + size * dh, prices + size * d
        if min(x.min(), (most - x).min(), low.min(), high.min()) <= 0:  # as far as the numbers' precision goes
            break
    return prices / unit


def _wanted(names: DataFrame, known: pa.Array, prices: np.ndarray, terms: Terms, k: int) -> tuple[np.ndarray, pa.Table]:
    """_sums at one point over a month's names in Spark, and NEW_NAMES other names than the known at most that get a weight there, by their pull."""
    most, schema = NEW_NAMES, "sums array<double>, symbol string, score double, before double, past array<double>, pull double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept = np.zeros((1, 3 + 2 * k + k * k)), None
        for batch in batches:
            own = expected, held, past = _columns(batch, k)
            total += _sums(own, [prices], terms, k)
            pull = expected - past @ prices[:k] + prices[k]
            weighty = terms.weights(pull, np.minimum(held, terms.cap)) > 0
            found = pa.Table.from_batches([batch]).append_column("pull", pa.array(pull)).filter(pa.array(weighty))
            found = found.filter(pc.invert(pc.is_in(found.column("symbol"), known)))
            kept = found if kept is None else pa.concat_tables([kept, found])
            if kept.num_rows > most:
                kept = kept.sort_by([("pull", "descending"), ("symbol", "ascending")]).slice(0, most).combine_chunks()
        none = pa.nulls(1, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(total.tolist(), pa.list_(pa.float64())), pa.nulls(1, pa.string()), none, none, pa.nulls(1, pa.list_(pa.float64())), none], ["sums", "symbol", "score", "before", "past", "pull"])
        if kept is not None:
            past = pa.array(kept.column("past").to_pylist(), pa.list_(pa.float64()))
            yield from pa.table({"sums": pa.nulls(kept.num_rows, past.type), "symbol": kept.column("symbol").cast(pa.string()), "score": kept.column("score"), "before": kept.column("before"), "past": past, "pull": kept.column("pull")}).to_batches()

    out = names.select("symbol", "score", "before", "past").mapInArrow(partial, schema).toArrow()
    sums = np.array([s for s in out.column("sums").to_pylist() if s is not None]).sum(axis=0)
    found = out.filter(out.column("sums").is_null()).sort_by([("pull", "descending"), ("symbol", "ascending")])
    return sums, found.slice(0, most).select(["symbol", "score", "before", "past"])


def dual_prices(names: DataFrame, n: int, terms: Terms, k: int, low: float, high: float, sample: int | None = None) -> Point:
    """The maximiser of the dual of a month's n names, whose expected values lie between low and high; with no sample, by steps over all names alone."""
    sample = START_NAMES if sample is None else sample
    reach = terms.curve * (terms.cap + 1) + terms.penalty
    points = [np.append(np.zeros(k), x) for x in np.linspace(-high - reach, reach - low, 24)]
    tolerance = 1e-11
    if sample:
        draw = min(1.0, max(sample, min(4 / terms.cap, HELD_NAMES)) / n)  # so many that their caps leave room for a sum of 1
        few = names.where(F.pmod(F.xxhash64("symbol"), F.lit(1 << 30)) < int(draw * (1 << 30))).select("symbol", "score", "before", "past").toArrow()
        drawn = _columns(few.combine_chunks().to_batches()[0], k) if few.num_rows else None
        start: list[np.ndarray] = []
        while few.num_rows and few.num_rows <= HELD_NAMES and few.num_rows * terms.cap > 1:
            own = _columns(few.combine_chunks().to_batches()[0], k)
            tolerance = 1e-11 * (1 + np.abs(own[2]).max(initial=0.0))
            near = climb(lambda p: _sums(own, p, terms, k), [interior_prices(own, terms, k)], terms, k, tolerance)
            known = few.column("symbol").combine_chunks()
            sums, new = _wanted(names, known, near.prices, terms, k)
            best = _point(near.prices, sums, terms, k)
            if best.steepness() < tolerance:
                return best
            start = [near.prices]
            if not new.num_rows:
                break
            few = pa.concat_tables([few, new.cast(few.schema)])
        if drawn:  # too many names have a weight: each drawn one stands for its share
            tolerance = max(tolerance, 1e-11 * (1 + np.abs(drawn[2]).max(initial=0.0)))
            share = n / len(drawn[0])
            points = [*start, climb(lambda p: _sums(drawn, p, terms, k) * share, points, terms, k, tolerance).prices, *points[::6]]
    best = climb(lambda p: _summed(names, p, terms, k), points, terms, k, tolerance)
    if best.steepness() > 1e-6 * (1 + tolerance * 1e11):
        raise ArithmeticError(f"the weights' prices did not settle: {best.steepness()}")
    return best


def _problem(scores: DataFrame, steps: DataFrame, lookback: int, path: str) -> None:
    """Write the names of each month by (s, m): symbol, score, ret, past (deviations of the months before, over a root)."""
    clean = scores.select("source", "month_end", "symbol", *[nan_to_null(F.col(c).cast("double")).alias(c) if c == "fwd_1m_ret" else F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("score", "fwd_1m_ret")])
    rows = clean.join(F.broadcast(steps), (clean["source"].eqNullSafe(steps["src"])) & (clean["month_end"] == steps["month"]))
    names = Window.partitionBy("s", "symbol").orderBy("m")
    twice = F.lag("m").over(names) == F.col("m")
    seen = F.map_from_entries(F.collect_list(F.struct("m", F.coalesce("fwd_1m_ret", F.lit(0.0)))).over(names.rangeBetween(-lookback, -1)))
    rows = rows.withColumns({"m": F.when(twice, F.raise_error(F.concat(F.lit("two rows of a month and symbol: "), F.col("month").cast("string"), F.lit(" "), "symbol")).cast("int")).otherwise(F.col("m"))})
    rows = rows.withColumn("__seen", seen).withColumn("__l", F.least(F.col("m"), F.lit(lookback)))
    rows = rows.where("score is not null and fwd_1m_ret is not null")
    dense = F.transform(F.sequence(F.col("m") - F.col("__l"), F.col("m") - 1), lambda j: F.coalesce(F.try_element_at("__seen", j), F.lit(0.0)))
    rows = rows.withColumn("__r", F.when(F.col("__l") > 1, dense))
    mean = F.aggregate("__r", F.lit(0.0), lambda a, x: a + x) / F.col("__l")
    past = F.transform("__r", lambda x: (x - F.col("__mean")) / F.sqrt(F.col("__l") - 1.0))
    rows = rows.withColumn("__mean", mean).select("s", "m", "symbol", "score", F.col("fwd_1m_ret").alias("ret"), F.coalesce(past, F.array().cast("array<double>")).alias("past"))
    parts = F.ceil(F.col("n") / TASK_NAMES)
    rows = rows.join(F.broadcast(steps.select("s", "m", "n")), ["s", "m"])
    rows.withColumn("__part", F.pmod(F.xxhash64("symbol"), parts)).repartition("s", "m", "__part").drop("__part", "n").write.partitionBy("s", "m").parquet(path)


def _month(spark: SparkSession, month: dict, path: str, out: str, before: str | None, lookback: int, options: dict) -> None:
    """Write a month's weights (symbol, weight, before, ret) to `out`."""
    names = spark.read.schema("symbol string, score double, ret double, past array<double>").parquet(f"{path}/s={month['s']}/m={month['m']}")
    if before:
        held = spark.read.schema("symbol string, weight double").parquet(before).withColumnRenamed("weight", "before")
        names = names.join(held, "symbol", "left").na.fill(0.0, ["before"])
    else:
        names = names.withColumn("before", F.lit(0.0))
    length, n = min(month["m"], lookback), month["own"]
    k = length if length > 1 and options["risk_aversion"] > 0 else 0
    terms = Terms.of(length, **options)
    if n * terms.cap < 1.0 or month["odd"]:
        names.select("symbol", F.lit(1.0 / n).alias("weight"), "before", "ret").write.parquet(out)
        return
    names = names.persist()
    try:
        best = dual_prices(names, n, terms, k, month["low"], month["high"])
        prices, total = best.prices, best.total

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                expected, held, past = _columns(batch, k)
                w = terms.weights(expected - past @ prices[:k] + prices[k], np.minimum(held, terms.cap)) / total
                yield pa.RecordBatch.from_arrays([batch.column("symbol"), pa.array(w), batch.column("before"), batch.column("ret")], ["symbol", "weight", "before", "ret"])

        names.mapInArrow(weigh, "symbol string, weight double, before double, ret double").write.parquet(out)
    finally:
        names.unpersist()


def optimize_panel(scores: DataFrame, lookback: int = 12, cost_bps: float = 15.0, risk_aversion: float = 5.0, turnover_penalty: float = 0.05, concentration_penalty: float = 0.01, max_weight: float = 0.25) -> DataFrame:
    """source, month_end, symbol, weight, month_return, month_turnover, net_return for scores (source, month_end, symbol, score, fwd_1m_ret).

    Names without a score or a realised return are out of the month. Turnover counts the month's names alone. Weights are
    equal where the cap can't hold or a score isn't finite; two rows of a source, month and symbol are an error.
    """
    spark, scores = scores.sparkSession, written(scores.select("source", "month_end", "symbol", "score", "fwd_1m_ret"), "scores")
    options = {"risk_aversion": risk_aversion, "turnover_penalty": turnover_penalty, "concentration_penalty": concentration_penalty, "max_weight": max_weight}
    score, ret = F.nullif(F.col("score").cast("double"), F.lit(float("nan"))), nan_to_null(F.col("fwd_1m_ret").cast("double"))
    own = score.isNotNull() & ret.isNotNull()
    months = scores.groupBy("source", "month_end").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("own"), F.min(F.when(own, score)).alias("low"), F.max(F.when(own, score)).alias("high"))
    found = months.where("month_end is not null").orderBy("source", "month_end").collect()  # a row of each source and month
    sources = list(dict.fromkeys(r["source"] for r in found))
    plan = []
    for s, source in enumerate(sources):
        for m, r in enumerate(r for r in found if r["source"] == source):
            plan.append(r.asDict() | {"s": s, "m": m, "odd": bool(r["own"]) and not np.isfinite([r["low"], r["high"]]).all()})
    root = scratch_path(spark, "decision")
    schema = "s int, m int, symbol string, weight double, before double, ret double"
    known = spark.createDataFrame([(p["source"], p["month_end"], p["s"], p["m"], p["n"]) for p in plan], "src string, month date, s int, m int, n long")
    if any(p["own"] for p in plan):
        _problem(scores, known, lookback, f"{root}/names")

        def run(s: int) -> None:
            before = None
            for p in plan:
                if p["s"] == s and p["own"]:
                    out = f"{root}/weights/s={s}/m={p['m']}"
                    _month(spark, p, f"{root}/names", out, before, lookback, options)
                    before = out

        with ThreadPool(min(8, len(sources))) as pool:
            pool.map(inheritable_thread_target(spark)(run), range(len(sources)), chunksize=1)
        remove(spark, f"{root}/names")
        rows = spark.read.schema(schema).parquet(f"{root}/weights")
    else:
        rows = spark.createDataFrame([], schema)
    sums = rows.groupBy("s", "m").agg(F.sum(F.col("weight") * F.col("ret")).alias("month_return"), (F.sum(F.abs(F.col("weight") - F.col("before"))) / 2).alias("month_turnover"))
    sums = sums.withColumn("net_return", F.col("month_return") - F.col("month_turnover") * cost_bps / 1e4)
    met = rows.join(F.broadcast(known.join(sums, ["s", "m"])), ["s", "m"])  # a row of each source and month
    return met.select(F.col("src").alias("source"), F.col("month").alias("month_end"), "symbol", "weight", "month_return", "month_turnover", "net_return")


def long_weights(decided: DataFrame) -> DataFrame:
    return decided.where(F.abs("weight") > 1e-12).select("source", "month_end", "symbol", "weight")


def month_returns(decided: DataFrame) -> DataFrame:
    """source, month_end, turnover, gross, net."""
    return decided.groupBy("source", "month_end").agg(F.first("month_turnover").alias("turnover"), F.first("month_return").alias("gross"), F.first("net_return").alias("net"))


def performance(decided: DataFrame) -> DataFrame:
    rows = month_returns(decided).unpivot(["source", "month_end"], ["gross", "net"], "kind", "ret")
    return portfolio.performance(rows, ("source", "kind"))


def score_panels(panel: DataFrame, predictions: DataFrame | None = None, model: str = "logistic") -> DataFrame:
    """Factor scores, and a model's scores where there are any, by source."""
    out = portfolio.scored_panel(panel).withColumn("source", F.lit("factor_score"))
    if predictions is not None:
        own = predictions.where(F.col("model") == model)
        if own.take(1):
            out = out.unionByName(own.select("month_end", "symbol", "score", F.col("target").alias("fwd_1m_ret"), F.lit("ml_score").alias("source")))
    return out


def trailing_risk(panel: DataFrame, lookback: int = 12) -> DataFrame:
    """month_end, symbol, var, cov_all of every panel row over the `lookback` panel months before (two at least), missing returns as 0.

    var is the symbol's variance and cov_all the sum of its covariances with all symbols, itself included: a row sum of
    the trailing covariance, without the matrix. Covariances with a sum need that sum's deviations alone.
    """
    steps = panel.select("month_end").distinct().withColumn("m", F.row_number().over(Window.orderBy("month_end")))
    rows = panel.join(F.broadcast(steps), "month_end").select("m", "month_end", "symbol", F.coalesce("fwd_1m_ret", F.lit(0.0)).alias("r"))
    total = rows.groupBy("m").agg(F.sum("r").alias("total"))
    past = total.withColumnRenamed("m", "at")
    frame = steps.select("m").join(past, (F.col("at") < F.col("m")) & (F.col("at") >= F.col("m") - lookback))
    whole = Window.partitionBy("m")
    frame = frame.select("m", "at", (F.col("total") - F.avg("total").over(whole)).alias("d"), F.count(F.lit(1)).over(whole).alias("n")).where("n > 1")
    seen = rows.select(F.col("m").alias("at"), "symbol", "r")
    met = rows.select("m", "month_end", "symbol").join(F.broadcast(frame), "m").join(seen, ["symbol", "at"], "left").na.fill(0.0, ["r"])
    return met.groupBy("month_end", "symbol").agg(F.var_samp("r").alias("var"), (F.sum(F.col("r") * F.col("d")) / (F.first("n") - 1)).alias("cov_all"))
