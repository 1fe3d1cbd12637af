"""Window functions of the formula language over one entity's rows in time order, as Spark columns.

``Series(entity, order)`` holds one window specification, so that Spark sorts once for all functions of a query.
A window is "full" once it has n rows; ``*_by`` variants take the period from a column, up to a constant cap.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.semantics import EPS, div, flag, ge, le, num


#: Rows that a recursive mean may fold for each row; longer ones are made by ``smoothed``.
FOLD_ROWS = 400


def ema_weight(n: int) -> float:
    return 2.0 / (max(int(n), 1) + 1)


def sma_weight(n: int, m: float) -> float:
    return min(max(m / max(int(n), 1), 0.0), 1.0)


def smoothed(df: DataFrame, entity: str, order: str, value: str, weight: float, out: str, *again: str, dealt: bool = False) -> DataFrame:
    """``df`` with the recursive mean ``out`` of ``value``: s = value * weight + s * (1 - weight) in the entity's order.

    A null gives null and starts afresh. One pass over rows sorted by entity and order, the state carried from batch to
    batch, so that the period doesn't matter and no entity's rows are held together. Each name of ``again`` is the mean of
    the one before it. With ``dealt`` an entity's rows are in one partition already and are not shuffled.
    """
    names = (out, *again)
    inner = df.withColumns({c: F.col(value).cast("double") for c in names})
    at, who = [inner.columns.index(c) for c in names], inner.columns.index(entity)

    def run(batches):
        state, last, begun = [], None, False
        for batch in batches:
            done = [[] for _ in at]
            for name, v in zip(batch.column(who).to_pylist(), batch.column(at[0]).to_pylist(), strict=True):
                if not begun or name != last:
                    state, last, begun = [None] * len(at), name, True
                for i, s in enumerate(state):
                    v = None if v is None else v if s is None else v * weight + s * (1 - weight)
                    state[i] = v
                    done[i].append(v)
            for i, values in zip(at, done, strict=True):
                batch = batch.set_column(i, batch.schema.field(i), pa.array(values, pa.float64()))
            yield batch

    rows = inner if dealt else inner.repartition(entity)
    return rows.sortWithinPartitions(entity, order).mapInArrow(run, inner.schema)


class Series:
    def __init__(self, entity: str, *order: str):
        self.entity, self.order = entity, order

    @property
    def w(self):
        return Window.partitionBy(self.entity).orderBy(*self.order)

    @property
    def every(self):
        return self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def _last(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    @staticmethod
    def _n(n: int, least: int = 1) -> int:
        return max(int(n), least)

    def _row(self) -> Column:
        return F.row_number().over(self.w)

    def _values(self, x: Column, n: int) -> Column:
        """The last n values, nulls included, oldest first."""
        return F.transform(F.collect_list(F.struct(x.alias("v"))).over(self._last(n)), lambda s: s.v)

    # fixed periods
    def ref(self, x, n: int) -> Column:
        return F.lag(num(x), self._n(n, 0)).over(self.w)

    def last(self, x, n: int) -> Column:
        """The n-th value from the entity's end, for all of its rows; looks ahead."""
        back = Window.partitionBy(self.entity).orderBy(*[F.desc(c) for c in self.order])
        return F.nth_value(num(x), self._n(n, 0) + 1).over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def total(self, x, n: int) -> Column:
        x, n = num(x), self._n(n)
        return F.when(F.count(x).over(self._last(n)) == n, F.sum(x).over(self._last(n)))

    def mean(self, x, n: int) -> Column:
        return self.total(x, n) / self._n(n)

    def deviation(self, x, n: int) -> Column:
        """Population standard deviation."""
        x, n = num(x), self._n(n)
        return F.when(F.count(x).over(self._last(n)) == n, F.stddev_pop(x).over(self._last(n)))

    def highest(self, x, n: int) -> Column:
        """Null unless the window is full and its first value is there; a first NaN sticks, later nulls and NaN are skipped."""
        x, n = num(x), self._n(n)
        first = F.lag(x, n - 1).over(self.w)
        return F.when(F.isnan(first), first).when(first.isNotNull(), F.max(F.when(~F.isnan(x), x)).over(self._last(n)))

    def lowest(self, x, n: int) -> Column:
        x, n = num(x), self._n(n)
        first = F.lag(x, n - 1).over(self.w)
        return F.when(F.isnan(first), first).when(first.isNotNull(), F.min(F.when(~F.isnan(x), x)).over(self._last(n)))

    def count(self, c, n: int) -> Column:
        return F.sum(flag(c).cast("double")).over(self._last(self._n(n)))

    def exists(self, c, n: int) -> Column:
        return F.max(flag(c)).over(self._last(self._n(n)))

    def cross(self, a, b) -> Column:
        a, b = num(a), num(b)
        return F.coalesce((a > b) & (F.lag(a).over(self.w) <= F.lag(b).over(self.w)), F.lit(False))

    def bars_since(self, c) -> Column:
        """Rows since c was last true; NaN before the first time."""
        row = self._row()
        hit = F.last(F.when(flag(c), row), ignorenulls=True).over(self.w.rowsBetween(Window.unboundedPreceding, 0))
        return F.coalesce((row - hit).cast("double"), F.lit(math.nan))

    def rsv(self, c, h, l, n: int) -> Column:
        c, h, l, n = num(c), num(h), num(l), self._n(n)
        w = self._last(n)
        full = (F.count(c).over(w) == n) & (F.count(h).over(w) == n) & (F.count(l).over(w) == n)
        low, high = F.min(l).over(w), F.max(h).over(w)
        return F.when(full, F.when(high - low < EPS, 0.0).otherwise(F.try_divide((c - low) * 100, high - low)))

    def ema(self, x, n: int) -> Column:
        return self._smooth(num(x), ema_weight(n))

    def sma(self, x, n: int, m: int) -> Column:
        return self._smooth(num(x), sma_weight(n, m))

    def _smooth(self, x: Column, a: float) -> Column:
        """Recursive mean; a null gives null and starts afresh.

        Rows further back than the double's precision can't change a value, so the fold is over a bounded window. Where
        that window is long, ``smoothed`` does the same in one pass.
        """
        reach = 1 if a >= 1 else math.ceil(math.log(1e-18) / math.log(1 - a)) + 1 if a > 0 else math.inf
        if reach > FOLD_ROWS:
            raise ValueError("period too long for a column: use smoothed()")
        return F.aggregate(self._values(x, reach), F.lit(None).cast("double"), lambda s, v: F.when(v.isNull(), None).when(s.isNull(), v).otherwise(v * a + s * (1 - a)))

    def rank_high(self, x, n: int) -> Column:
        """1 + earlier values of the window that are at least the current one."""
        return self._rank(num(x), self._n(n), ge)

    def rank_low(self, x, n: int) -> Column:
        return self._rank(num(x), self._n(n), le)

    def _rank(self, x: Column, n: int, test) -> Column:
        values = self._values(x, n)
        full = F.count(x).over(self._last(n)) == n
        return F.when(full, (F.size(F.filter(F.slice(values, 1, n - 1) if n > 1 else F.array().cast("array<double>"), lambda v: test(v, x))) + 1).cast("double"))

    def top_count(self, x, c, n: int, k: int, largest: bool = True) -> Column:
        """How often c holds among the k largest (smallest) values of a full window; on ties the later row comes first."""
        x, n = num(x), self._n(n)
        full = F.count(x).over(self._last(n)) == n
        return F.when(full, self._top(x, c, n, F.lit(n), k, largest))

    def _top(self, x: Column, c, n: int, period: Column, k: int, largest: bool) -> Column:
        key = (-x if largest else x).alias("key")
        rows = F.collect_list(F.struct(key, (-self._row()).alias("late"), flag(c).alias("hit"))).over(self._last(n))
        rows = F.slice(rows, F.greatest(F.size(rows) - period + 1, F.lit(1)), period)
        best = F.slice(F.array_sort(rows), 1, max(int(k), 1))
        return F.size(F.filter(best, lambda s: s.hit)).cast("double")

    def get(self, c, x, n: int) -> Column:
        """x at the latest of the n rows before the current one where c held."""
        kept = F.last(F.when(flag(c), F.struct(num(x).alias("v"))), ignorenulls=True)
        return kept.over(self.w.rowsBetween(-self._n(n), -1))["v"]

    # periods by row
    def _period(self, p, cap: int, least: int = 1) -> Column:
        """Rounded-down period; null if it is null, not finite or above the cap; below ``least`` it is ``least``."""
        p = num(p)
        ok = ~F.isnan(p) & (F.abs(p) < 1e15) & (F.floor(p) <= cap)
        return F.when(ok, F.greatest(F.floor(p), F.lit(least)).cast("int"))

    def _window(self, x: Column, p: Column, cap: int) -> Column:
        """The last p values, or null where there aren't as many or one is null."""
        values = self._values(x, cap)
        part = F.when(F.size(values) >= p, F.slice(values, F.size(values) - p + 1, p))
        return F.when(~F.exists(part, lambda v: v.isNull()), part)

    def ref_by(self, x, p, cap: int) -> Column:
        values, k = self._values(num(x), cap + 1), self._period(p, cap, 0)
        return F.when(F.size(values) > k, F.element_at(values, F.greatest(F.size(values) - k, F.lit(1))))

    def total_by(self, x, p, cap: int) -> Column:
        return F.aggregate(self._window(num(x), self._period(p, cap), cap), F.lit(0.0), lambda s, v: s + v)

    def mean_by(self, x, p, cap: int) -> Column:
        return self.total_by(x, p, cap) / self._period(p, cap)

    def deviation_by(self, x, p, cap: int) -> Column:
        k = self._period(p, cap)
        part = self._window(num(x), k, cap)
        mean = F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / k
        return F.sqrt(F.aggregate(F.transform(part, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / k)

    def _extreme_by(self, x, p, cap: int, largest: bool) -> Column:
        values, k = self._values(num(x), cap), self._period(p, cap)
        part = F.when(F.size(values) >= k, F.slice(values, F.size(values) - k + 1, k))
        first = F.try_element_at(part, F.lit(1))
        real = F.filter(part, lambda v: v.isNotNull() & ~F.isnan(v))
        return F.when(F.isnan(first), first).when(first.isNotNull(), F.array_max(real) if largest else F.array_min(real))

    def highest_by(self, x, p, cap: int) -> Column:
        return self._extreme_by(x, p, cap, True)

    def lowest_by(self, x, p, cap: int) -> Column:
        return self._extreme_by(x, p, cap, False)

    def count_by(self, c, p, cap: int) -> Column:
        """Windows at the start may be short; null where the period is not valid."""
        values, k = self._values(flag(c), cap), self._period(p, cap)
        part = F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), k)
        return F.size(F.filter(part, lambda v: v)).cast("double") + F.when(k.isNotNull(), 0.0)

    def exists_by(self, c, p, cap: int) -> Column:
        return F.coalesce(self.count_by(c, p, cap) > 0, F.lit(False))

    def rsv_by(self, c, h, l, p, cap: int) -> Column:
        k = self._period(p, cap)
        cs, hs, ls = (self._window(num(v), k, cap) for v in (c, h, l))
        low, high = F.array_min(ls), F.array_max(hs)
        return F.when(cs.isNotNull() & hs.isNotNull() & ls.isNotNull(), F.when(high - low < EPS, 0.0).otherwise(F.try_divide((num(c) - low) * 100, high - low)))

    def _rank_by(self, x, p, cap: int, test) -> Column:
        x = num(x)
        part = self._window(x, self._period(p, cap), cap)
        earlier = F.slice(part, F.lit(1), F.size(part) - 1)
        return F.when(part.isNotNull(), (F.size(F.filter(earlier, lambda v: test(v, x))) + 1).cast("double"))

    def rank_high_by(self, x, p, cap: int) -> Column:
        return self._rank_by(x, p, cap, ge)

    def rank_low_by(self, x, p, cap: int) -> Column:
        return self._rank_by(x, p, cap, le)

    def top_count_by(self, x, c, p, k: int, cap: int, largest: bool = True) -> Column:
        x, period = num(x), self._period(p, cap)
        return F.when(self._window(x, period, cap).isNotNull(), self._top(x, c, cap, period, k, largest))

    def get_by(self, c, x, p, cap: int) -> Column:
        rows = F.collect_list(F.struct(flag(c).alias("hit"), num(x).alias("v"))).over(self.w.rowsBetween(-cap, -1))
        k = self._period(p, cap)
        part = F.slice(rows, F.greatest(F.size(rows) - k + 1, F.lit(1)), k)
        return F.try_element_at(F.transform(F.filter(part, lambda s: s.hit), lambda s: s.v), F.lit(-1))


def efficiency_ratio(s: Series, c, n: int = 20) -> Column:
    """Signed net change over the sum of absolute changes."""
    c = num(c)
    return div(c - s.ref(c, n), s.total(F.abs(c - s.ref(c, 1)), n))


def kdj_j(df: DataFrame, entity: str, order: str, c, h, l, n: int = 9, m: int = 3, dealt: bool = False) -> DataFrame:
    """(entity, order, j): 3k - 2d; k is the recursive mean of the rsv, d that of k, both from one pass over an entity's rows."""
    s = Series(entity, order)
    rows = df.select(entity, order, s.rsv(c, h, l, n).alias("_rsv"))
    return smoothed(rows, entity, order, "_rsv", sma_weight(m, 1), "_k", "_d", dealt=dealt).select(entity, order, (F.col("_k") * 3 - F.col("_d") * 2).alias("j"))
