"""Designs around two factors: matching, paired and bootstrapped effects, null tests, calibration, holdouts, gates.

Work on one pair's rows, where it is sequential by nature (matching, resampling), runs in ``applyInPandas`` by pair: a
pair's rows are bounded by its treated rows. Everything else is plain aggregation.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.stats import group_cells, isotonic, t_p


def quantile_bins(rows: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """``rows`` with the bin of ``value`` among interior percentile edges: the outermost two on each side are one. -1 for null.

    Bins count from 0 to ``bins`` - 3, as an edge is searched from the right, less one, clipped to the inner edges.
    """
    inner = rows.agg(F.array_distinct(F.percentile(value, [i / bins for i in range(1, bins)])).alias("edges"))
    at = F.size(F.filter("edges", lambda e: e <= F.col(value))) - 1
    clipped = F.greatest(F.lit(0), F.least(F.size("edges") - 2, at))
    return rows.join(F.broadcast(inner)).withColumn(name, F.when(F.col(value).isNull(), -1).when(F.size("edges") < 2, 0).otherwise(clipped)).drop("edges")


def column_gate(rows: DataFrame, columns: list[str], least_variance: float = 1e-8, least_distinct: int = 50) -> DataFrame:
    """(column, variance, n_distinct, kept): which columns vary enough."""
    aggs = [f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("v", F.var_samp), ("d", F.countDistinct))]
    one = rows.agg(*aggs)
    each = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v_{i}").alias("variance"), F.col(f"d_{i}").alias("n_distinct")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    return each.withColumn("kept", (F.coalesce("variance", F.lit(0.0)) >= least_variance) & (F.col("n_distinct") >= least_distinct))


def relaxed(pairs: DataFrame, strict: Column, loose: Column, least: int) -> DataFrame:
    """Pairs that pass ``strict``; where fewer than ``least`` do, those that pass ``loose``. Tells which rule held."""
    marked = pairs.withColumns({"__strict": F.coalesce(strict, F.lit(False)), "__loose": F.coalesce(loose, F.lit(False))})
    n = marked.agg(F.count_if("__strict").alias("__n"))
    out = marked.join(F.broadcast(n)).withColumn("rule", F.when(F.col("__n") >= least, "strict").otherwise("relaxed"))
    return out.where(F.when(F.col("rule") == "strict", F.col("__strict")).otherwise(F.col("__loose"))).drop("__strict", "__loose", "__n")


def paired_did(rows: DataFrame, by: list[str], ab: str, a: str, b: str, none: str) -> DataFrame:
    """Mean of AB - A - B + none over matched rows, its standard error, t and two-sided p with n - 1 degrees of freedom."""
    d = F.col(ab) - F.col(a) - F.col(b) + F.col(none)
    out = rows.groupBy(*by).agg(F.avg(d).alias("did"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"), F.count(d).alias("n"))
    out = out.withColumn("t", F.try_divide("did", "se"))
    return out.withColumn("p", t_p(F.col("t"), F.col("n") - 1))


def group_did_p(rows: DataFrame, by: list[str], a: str, b: str, y: str) -> DataFrame:
    """did, se, t and p of group means; degrees of freedom are those of the smallest cell."""
    cells = group_cells(rows, by, a, b, y)
    cells = cells.withColumns({"did": F.expr("m11 - m10 - m01 + m00"), "se": F.sqrt(F.expr(" + ".join(f"q{k} / (n{k} - 1) / n{k}" for k in ("11", "10", "01", "00")))), "least": F.expr("least(n11, n10, n01, n00)")})
    out = cells.withColumn("t", F.try_divide("did", "se"))
    return out.select(*by, "did", "se", "t", t_p(F.col("t"), F.col("least") - 1).alias("p"), F.col("n11").alias("n_ab"), F.col("n10").alias("n_a"), F.col("n01").alias("n_b"), F.col("n00").alias("n_none"))


def _nearest(x: np.ndarray, pool: np.ndarray, near: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function of a point: the ``near`` rows of ``pool`` nearest to it in ``x``, ties by row.

    Finite rows are in order of the feature of most values. From the point outwards they are taken until the next row on
    either side is farther in that feature alone than the last of the nearest.
    """
    finite = pool[np.isfinite(x[pool]).all(axis=1)]
    by = max(range(x.shape[1]), key=lambda c: len(np.unique(x[finite, c])))
    order = finite[np.argsort(x[finite, by], kind="stable")]
    points, line = x[order], x[order, by]

    def whole(point: np.ndarray) -> np.ndarray:
        return pool[np.argsort(((x[pool] - point) ** 2).sum(axis=1), kind="stable")[:near]]

    def nearest(point: np.ndarray) -> np.ndarray:
        if np.isnan(point).any():  # no distance is known: all rows tie
            return pool[:near]
        if len(order) < near or not np.isfinite(point).all():
            return whole(point)
        at, wide = int(np.searchsorted(line, point[by])), 2 * near
        while True:
            low, high = max(0, at - wide), min(len(order), at + wide)
            d = ((points[low:high] - point) ** 2).sum(axis=1)
            if len(d) >= near:
                last = np.partition(d, near - 1)[near - 1]
                if not np.isfinite(last):
                    return whole(point)
                if (low == 0 or (line[low - 1] - point[by]) ** 2 > last) and (high == len(order) or (line[high] - point[by]) ** 2 > last):
                    some = np.flatnonzero(d <= last)
                    return order[low + some[np.lexsort((order[low + some], d[some]))[:near]]]
            wide *= 2

    return nearest


class _Free:
    """The free rows of a pool: gives the nearest to a point, ties by row, and takes it.

    Rows of finite features are in a tree of halves along the widest feature, searched by (least distance to the box of a
    node's free rows, first of these rows), so each answer is exact, and among rows alike one path leads to the first.
    Of the others, those with the same features finite, infinite or missing are equally far from any point.
    """

    LEAF = 64

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.x, self.odd = x, {}
        kinds = np.isnan(x[rows]) + 2 * np.isposinf(x[rows]) + 3 * np.isneginf(x[rows]).astype(np.int8)
        odd = kinds.any(axis=1)
        for row, kind in zip(rows[odd].tolist(), kinds[odd], strict=True):
            self.odd.setdefault(kind.tobytes(), []).append(row)
        self.odd = [rows[::-1] for rows in self.odd.values()]  # the first is the last, to be popped
        parts, depth = [rows[~odd]], 0
        while len(parts[0]) > self.LEAF:
            parts, depth = [half for part in parts for half in self._halves(part)], depth + 1
        self.base = 2**depth - 1  # children of node i are 2 i + 1 and 2 i + 2, leaves follow base
        self.rows = [np.sort(part).tolist() for part in parts]
        self.points = [np.ascontiguousarray(x[part].T) for part in self.rows]
        self.nodes = [None] * self.base + [self._box(k) for k in range(len(parts))]
        for i in reversed(range(self.base)):
            self.nodes[i] = self._both(i)

    def _halves(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, middle = self.x[part], (len(part) + 1) // 2
        order = np.argpartition(points[:, np.ptp(points, axis=0).argmax()], middle - 1)
        return part[order[:middle]], part[order[middle:]]

    def _box(self, k: int) -> tuple[int, tuple, tuple] | None:
        """First row, least and greatest features of the free rows of a leaf."""
        return (self.rows[k][0], tuple(self.points[k].min(axis=1).tolist()), tuple(self.points[k].max(axis=1).tolist())) if self.rows[k] else None

    def _both(self, i: int) -> tuple[int, tuple, tuple] | None:
        one, other = self.nodes[2 * i + 1], self.nodes[2 * i + 2]
        if one is None or other is None:
            return one or other
        return min(one[0], other[0]), tuple(map(min, one[1], other[1])), tuple(map(max, one[2], other[2]))

    def _search(self, point: list[float]) -> tuple[float, int, int, int]:
        """Distance, row, leaf and place in it of the nearest free row of the tree to a finite point."""
        column, base, nodes = np.array(point)[:, None], self.base, self.nodes
        best, heap = (math.inf, math.inf), [(0.0, nodes[0][0], 0)]
        while heap:
            least, first, i = heapq.heappop(heap)
            if (least, first) > best[:2]:
                break
            if i >= base:
                gaps = self.points[i - base] - column
                gaps *= gaps
                d = gaps[0]
                for more in gaps[1:]:
                    d = d + more
                j = int(d.argmin())
                best = min(best, (float(d[j]), self.rows[i - base][j], i - base, j))
                continue
            for child in (2 * i + 1, 2 * i + 2):
                if box := nodes[child]:
                    least = 0.0  # summed as the distances are, so that none is below it by rounding
                    for p, low, high in zip(point, box[1], box[2], strict=True):
                        gap = low - p if p < low else p - high if p > high else 0.0
                        least += gap * gap
                    if (least, box[0]) <= best[:2]:
                        heapq.heappush(heap, (least, box[0], child))
        return best

    def _remove(self, k: int, j: int) -> None:
        points = self.points[k]
        points[:, j:-1] = points[:, j + 1 :]
        del self.rows[k][j]
        self.points[k] = points[:, :-1]
        i = self.base + k
        self.nodes[i] = self._box(k)
        while i:
            i = (i - 1) // 2
            if (box := self._both(i)) == self.nodes[i]:
                break
            self.nodes[i] = box

    def take(self, point: np.ndarray) -> int:
        known = bool(np.isfinite(point).all())
        d, row, k, j = self._search(point.tolist()) if known and self.nodes[0] else (math.inf, -1, -1, -1)
        if d < math.inf:
            self._remove(k, j)
            return row
        # all distances are infinite or unknown, the latter last
        heads = [(bool(np.isnan(((self.x[rows[-1]] - point) ** 2).sum())), rows[-1], rows) for rows in self.odd if rows]
        if self.nodes[0]:
            heads.append((bool(np.isnan(point).any()), self.nodes[0][0], None))
        _, row, rows = min(heads, key=lambda h: h[:2])
        if rows is not None:
            return rows.pop()
        i = 0
        while i < self.base:  # to the leaf of the first free row
            i = 2 * i + 1 if self.nodes[2 * i + 1] and self.nodes[2 * i + 1][0] == row else 2 * i + 2
        self._remove(i - self.base, 0)
        return row


def matched(rows: DataFrame, by: list[str], key: str, group: str, features: list[str], near: int | None = None) -> DataFrame:
    """Greedy one-to-one matching without replacement, by each set of ``by``: (key, a, b, none).

    Treated rows (group "ab") are taken in order of key; each takes the nearest free row of each of the pools "a", "b"
    and "none" (distance over ``features``, ties by key, unknown distances last), until a pool has no free row left.
    With ``near``, only rows among the ``near`` nearest of all pools may be taken, and a treated row that does not find
    all three there takes none.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable").reset_index(drop=True)
        x, label, keys = part[features].to_numpy(float), part[group].to_numpy(), part[key]
        treated, pools = np.flatnonzero(label == "ab"), [np.flatnonzero(label == g) for g in ("a", "b", "none")]
        found = _all_near(x, label, treated, near) if near is not None else []
        if near is None and (n := min(map(len, pools))):
            with np.errstate(invalid="ignore", over="ignore"):
                free = [_Free(x, pool) for pool in pools]
                found = [(i, *(f.take(x[i]) for f in free)) for i in treated[:n].tolist()]  # after n the smallest pool is used up
        return pd.DataFrame([(*name, *(keys[j] for j in four)) for four in found], columns=[*by, key, "a", "b", "none"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, key, group, *features).groupBy(*by).applyInPandas(run, f"{kinds}, {key} {kind}, a {kind}, b {kind}, none {kind}")


def _all_near(x: np.ndarray, label: np.ndarray, treated: np.ndarray, near: int) -> list[tuple[int, int, int, int]]:
    """Treated rows and their matches where all three are among the ``near`` nearest rows of all pools."""
    taken, found, nearest = np.zeros(len(x), dtype=bool), [], _nearest(x, np.flatnonzero(label != "ab"), near)
    for i in treated.tolist():
        near_rows = nearest(x[i])
        free = [next((j for j in near_rows.tolist() if label[j] == g and not taken[j]), None) for g in ("a", "b", "none")]
        if None not in free:
            taken[free] = True
            found.append((i, *free))
    return found


def bootstrap_did(rows: DataFrame, by: list[str], a: str, b: str, y: str, reps: int = 200, seed: int = 0, least: float = 0.01) -> DataFrame:
    """did with its percentile interval, two-sided p (1 / (reps + 1) at least) and stability: the share of replicates of
    the same sign and at least ``least``. Rows of each of the four cells are drawn anew within the cell."""

    def run(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([a, b, y])
        cells = [part.loc[(part[a] == i) & (part[b] == j), y].to_numpy(float) for i, j in ((1, 1), (1, 0), (0, 1), (0, 0))]
        if min(map(len, cells)) < 2:
            return pd.DataFrame([(*name, *[np.nan] * 5)], columns=columns)
        rng, did = np.random.default_rng(list(str((seed, *name)).encode())), lambda m: m[0] - m[1] - m[2] + m[3]
        seen = did([c.mean() for c in cells])
        draws = np.array([did([rng.choice(c, len(c)).mean() for c in cells]) for _ in range(reps)])
        p = min(1.0, 2 * (1 + min((draws <= 0).sum(), (draws >= 0).sum())) / (reps + 1))
        stable = float(((np.sign(draws) == np.sign(seen)) & (np.abs(draws) >= least)).mean())
        return pd.DataFrame([(*name, seen, *np.percentile(draws, (2.5, 97.5)), max(p, 1 / (reps + 1)), stable)], columns=columns)

    columns = [*by, "did", "low", "high", "p", "stability"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, a, b, y).where(F.col(y).isNotNull()).groupBy(*by).applyInPandas(run, f"{kinds}, did double, low double, high double, p double, stability double")


def null_did(rows: DataFrame, by: list[str], a: str, b: str, y: str, key: str, seed: int, within: list[str] | None = None) -> DataFrame:
    """did of each group with the outcomes shuffled among its rows, or within strata of it: hashed order against key order."""
    inside = [*by, *(within or [])]
    order = Window.partitionBy(*inside)
    dealt = rows.withColumns({"__r": F.row_number().over(order.orderBy(key)), "__s": F.row_number().over(order.orderBy(F.xxhash64(F.lit(seed), key), key))})
    left = dealt.select(*inside, a, b, F.col("__r").alias("__k"))
    right = dealt.select(*inside, F.col(y).alias("__y"), F.col("__s").alias("__k"))
    cells = group_cells(left.join(right, [*inside, "__k"]), by, a, b, "__y")
    return cells.select(*by, F.expr("m11 - m10 - m01 + m00").alias("did"), F.expr("n11 + n10 + n01 + n00").alias("n"))


def fdr_sanity(rows: DataFrame, p: str = "p", q: str = "q", alpha: float = 0.05) -> DataFrame:
    """One row: tests, shares significant by p and by q, whether all q are within 0 and 1 and none below its p."""
    return rows.agg(
        F.count("*").alias("n"), F.avg((F.col(p) <= alpha).cast("double")).alias("share_p"), F.avg((F.col(q) <= alpha).cast("double")).alias("share_q"),
        F.bool_and((F.col(q) >= 0) & (F.col(q) <= 1)).alias("in_range"), F.bool_and(F.col(q) >= F.col(p) - 1e-12).alias("not_below_p"),
    )


def holdout_share(top: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many of the top pairs are in the training part, and their share."""
    known = train.select(*keys).distinct().withColumn("__k", F.lit(1))
    return top.join(known, keys, "left").agg(F.count("*").alias("n_top"), F.count("__k").alias("n_train")).withColumn("share", F.try_divide("n_train", "n_top"))


def greedy_split(groups: DataFrame, group: str, size: str, target: float) -> DataFrame:
    """(group, size, split): whole groups, largest first, go to train while they fit into ``target`` of all rows; others to test.

    Only the histogram of sizes is gathered (N rows have at most sqrt(2 N) sizes); groups of a size go in order of key.
    """
    sizes = sorted(groups.groupBy(size).count().collect(), reverse=True)
    room, taken = int(sum(s * n for s, n in sizes) * target), {}
    for s, n in sizes:
        taken[s] = min(n, room // s) if s else n
        room -= s * taken[s]
    most = F.element_at(F.create_map(*[F.lit(x) for pair in taken.items() for x in pair]), F.col(size)) if taken else F.lit(0)
    place = F.row_number().over(Window.partitionBy(size).orderBy(group))
    return groups.withColumn("__r", place).select(group, size, F.when(F.col("__r") <= most, "train").otherwise("test").alias("split"))


def outliers(rows: DataFrame, key: str, features: list[str], most: int) -> DataFrame:
    """The ``most`` rows farthest (Euclidean) from the mean of all."""
    centre = rows.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(features)])
    distance = F.sqrt(sum((F.pow(F.col(c) - F.col(f"__m{i}"), F.lit(2.0)) for i, c in enumerate(features)), F.lit(0.0)))
    return rows.join(F.broadcast(centre)).select(key, distance.alias("distance")).orderBy(F.desc("distance"), key).limit(most)


def mean_correlation(rows: DataFrame, profile: str, dim: str, value: str) -> DataFrame:
    """One row: profiles that vary, pairs of them and their mean Pearson correlation, dimensions absent from one as 0.

    No pair is formed: of unit vectors, the sum over pairs is half of the squared length of their sum less their number.
    """
    own = rows.groupBy(profile, dim).agg(F.sum(value).alias("v"))
    dims = own.agg(F.countDistinct(dim).cast("double").alias("d"))
    each = own.groupBy(profile).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(F.broadcast(dims))
    each = each.select(profile, "d", (F.col("s") / F.col("d")).alias("m"), F.sqrt(F.col("q") - F.col("s") * F.col("s") / F.col("d")).alias("z")).where("z > 1e-12")
    shift = each.agg(F.sum(F.col("m") / F.col("z")).alias("shift"), F.count("*").alias("n"), F.max("d").alias("d"))
    along = own.join(each.select(profile, "z"), profile).groupBy(dim).agg(F.sum(F.col("v") / F.col("z")).alias("b"))
    total = along.agg(F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum("b").alias("b"))
    length = F.expr("bb - 2 * shift * b + d * shift * shift")
    return shift.join(F.broadcast(total)).select("n", F.expr("cast(n * (n - 1) / 2 as long)").alias("n_pairs"), F.try_divide(length - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_r"))


def calibrated(confidence: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through isotonic points (score, observed rate), level beyond them."""
    out = F.when(confidence <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(confidence <= x1, F.lit(y0) + (confidence - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(points[-1][1])


def logistic(points: list[tuple[float, float, float]], steps: int = 50) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve through (score, rate, weight) by Newton's method."""
    x, y, w = (np.array(c, dtype=float) for c in zip(*points, strict=True))
    design, beta = np.stack((x, np.ones_like(x)), axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = design.T @ (design * (w * p * (1 - p))[:, None]) + 1e-9 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, design.T @ (w * (y - p)))
    return float(beta[0]), float(beta[1])


def scaled(points: list[tuple[float, float]], whole: float, part: float) -> list[tuple[float, float]]:
    """Rates brought from one evaluation to a harder one: times part / whole, then non-decreasing."""
    return isotonic([(x, y * (part / whole if whole else 1.0), 1.0) for x, y in points])


def regression(rows: DataFrame, by: list[str], x: list[str], y: str, last: str, least: int = 30) -> DataFrame:
    """beta, se, t, p and HC3 se of ``last`` in y ~ 1 + x + last, ordinary least squares, by group.

    Categorical covariates come as 0/1 columns. Groups below ``least`` rows give none; collinear columns share weight
    (pseudo-inverse). Two passes: the group's cross products are summed by Spark, residuals need its betas.
    """
    terms = ["__one", *x, last]
    base = rows.where(F.col(y).isNotNull()).select(*by, *[F.col(c).cast("double").alias(c) for c in [*x, last, y]]).withColumn("__one", F.lit(1.0))
    k = len(terms)
    products = [F.sum(F.col(terms[i]) * F.col(terms[j])).alias(f"__x{i}_{j}") for i in range(k) for j in range(i, k)]
    products += [F.sum(F.col(t) * F.col(y)).alias(f"__y{i}") for i, t in enumerate(terms)]
    moments = base.groupBy(*by).agg(F.count("*").alias("n"), *products).where(F.col("n") >= max(least, k + 1))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def solve(batches):
        for part in batches:
            betas, inverses = [], []
            for _, r in part.iterrows():
                m = np.array([[r[f"__x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
                inverse = np.linalg.pinv(m, hermitian=True)
                betas.append((inverse @ np.array([r[f"__y{i}"] for i in range(k)], dtype=float)).tolist())
                inverses.append(inverse.ravel().tolist())
            yield part[[*by, "n"]].assign(beta=betas, inverse=inverses)

    fitted = moments.mapInPandas(solve, f"{kinds}, n long, beta array<double>, inverse array<double>")
    row = F.array(*[F.col(t) for t in terms])
    joined = base.join(fitted, by)
    residual = F.col(y) - F.aggregate(F.zip_with(row, F.col("beta"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    # one row of the inverse times x, and x' inverse x
    along = F.aggregate(F.zip_with(row, F.slice("inverse", k * (k - 1) + 1, k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    leverage = sum((F.col(terms[i]) * F.col(terms[j]) * F.col("inverse")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))
    out = joined.withColumns({"__e": residual, "__z": along, "__h": leverage}).groupBy(*by).agg(
        F.first("n").alias("n"), F.first(F.col("beta")[k - 1]).alias("beta"), F.first(F.col("inverse")[k * k - 1]).alias("__v"), F.sum(F.expr("__e * __e")).alias("__sse"),
        F.sum(F.expr("power(__z * __e / (1 - least(__h, 0.999999D)), 2)")).alias("__hc3"),
    )
    out = out.withColumns({"se": F.sqrt(F.col("__sse") / (F.col("n") - k) * F.col("__v")), "se_hc3": F.sqrt("__hc3")})
    out = out.withColumn("t", F.try_divide("beta", "se"))
    return out.select(*by, "beta", "se", "se_hc3", "t", t_p(F.col("t"), F.col("n") - k).alias("p"), "n")


def grid_sample(rows: DataFrame, cells: list[str], key: str, per_cell: int, target: int, seed: int) -> DataFrame:
    """``per_cell`` rows of each cell in a hashed order, topped up in that order to ``target`` rows in all; with how each came in."""
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), key))
    placed = hashed.withColumn("__r", F.row_number().over(Window.partitionBy(*cells).orderBy("__h", key)))
    first = placed.where(F.col("__r") <= per_cell)
    n = first.count()  # at most cells * per_cell
    rest = placed.where(F.col("__r") > per_cell).orderBy("__h", key).limit(max(0, target - n))
    return first.withColumn("how", F.lit("grid")).unionByName(rest.withColumn("how", F.lit("top-up"))).drop("__h", "__r")


def mediation_bootstrap(rows: DataFrame, by: list[str], key: str, x: str, m: str, y: str, reps: int = 200, seed: int = 0) -> DataFrame:
    """Mean indirect effect, its 95 % interval and p (twice the smaller tail) over Poisson resamples.

    A row's weight in a resample comes from a hash of its key, so moments are summed on the map side; groups too small or
    singular give nulls.
    """
    from weftline.operators.stats import poisson_weight

    base = rows.select(*by, key, F.col(x).alias("x"), F.col(m).alias("m"), F.col(y).alias("y")).na.drop(subset=["x", "m", "y"])
    drawn = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", poisson_weight(F.lit(seed), F.col("rep"), F.col(key))).where("w > 0")
    sums = {"w": "w", "x": "w*x", "m": "w*m", "y": "w*y", "xx": "w*x*x", "mm": "w*m*m", "xm": "w*x*m", "xy": "w*x*y", "my": "w*m*y"}
    s = drawn.groupBy(*by, "rep").agg(*[F.sum(F.expr(e).cast("double")).alias(f"s_{n}") for n, e in sums.items()])
    cov = lambda a, b, ab: F.expr(f"s_{ab} / s_w - s_{a} / s_w * s_{b} / s_w")
    s = s.withColumns({"xx": cov("x", "x", "xx"), "mm": cov("m", "m", "mm"), "xm": cov("x", "m", "xm"), "xy": cov("x", "y", "xy"), "my": cov("m", "y", "my")})
    indirect = F.try_divide("xm", "xx") * F.try_divide(F.expr("my * xx - xy * xm"), F.expr("mm * xx - xm * xm"))
    each = s.select(*by, indirect.alias("i"))
    tails = 2 * F.least(F.avg((F.col("i") <= 0).cast("double")), F.avg((F.col("i") >= 0).cast("double")))
    return each.groupBy(*by).agg(F.avg("i").alias("indirect"), F.percentile("i", 0.025).alias("low"), F.percentile("i", 0.975).alias("high"), F.least(F.lit(1.0), tails).alias("p"))
