"""Sequential realisations of a Gaussian process from neighbours that are found once for all of them.

Which points a step is drawn from depends on places and on the order of visits, not on values. So each query gets, before anything is
drawn, its nearest known points and those other queries that can come before them (blocks along a curve, as in ``nearest``). A task
then takes some realisations of a group: it marks in each query's list what has been visited before, solves each set of neighbours once for all
of its realisations, and goes through the steps in waves, each of those whose neighbours have their values. The few steps whose list does
not tell, as with hardly any known points, search the queries visited before them. Orders of visits, neighbours, ties and random numbers are those of
``kriging.simulate``, which goes from step to step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators.blocks import cut, dealt, numbered
from lodecast.operators.cells import AXES, BOX
from lodecast.operators.nearest import measured
from lodecast.operators.pair_blocks import blocks
from lodecast.operators.spatial import in_ellipsoid, turned
from lodecast.operators.tiles import kinds

#: Points of a block, blocks of queries that a task searches for together, points of a leaf there, and points that tell how far it has to look.
SIZE, BLOCKS, LEAF, PROBED = 64, 16, 32, 256
#: Points and queries up to which a group is searched in one task.
WHOLE = 2**16
#: Queries of a list at most, and queries whose lists are laid out together.
LISTED, TOGETHER = 24, 2**14
#: Steps of a task, at least and at most (of one realisation if that has more), and tasks for each core.
TASK_STEPS, FINER = (2**16, 2**20), 4
#: Systems solved together, and distances made together.
SYSTEMS, DISTANCES = 2**13, 2**21
_PLACE = [f"_p{a}" for a in AXES]


@dataclass(frozen=True)
class Search:
    """The ``least`` + 1 nearest and up to ``k`` in the ellipsoid of these radii, turned by ``angles``, as ``ellipsoid_search`` takes them."""

    k: int
    radii: tuple[float, float, float]
    angles: tuple[float, float, float]
    least: int = 2

    def ball(self, places: np.ndarray) -> np.ndarray:
        """Places, axis by axis, in coordinates in which the ellipsoid is the unit ball."""
        return np.array([c / r for c, r in zip(turned(*places, self.angles), self.radii, strict=True)])

    def lags(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.sqrt(sum((c / r) ** 2 for c, r in zip(turned(x, y, z, self.angles), self.radii, strict=True)))

    def taken(self, number: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Whether the point of this number, from 0 on and nearest first, is one of the neighbours."""
        return (number < self.k) & ((number <= self.least) | (lag <= 1))


def smallest(lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and number in its row of the ``k`` least finite values of each row, in order; ties go by column."""
    kept = lag < np.inf
    if k < lag.shape[1]:
        kept &= lag <= np.partition(lag, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero(kept)
    order = np.lexsort((lag[row, column], row))
    row, column = row[order], column[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    return row[number < k], column[number < k], number[number < k]


def listed(places: np.ndarray, known: np.ndarray, values: np.ndarray, others: np.ndarray, rows: np.ndarray, bound: np.ndarray, search: Search) -> pd.DataFrame:
    """``known, near, lags, reach`` of each query: lag, place and value of its nearest known points, and rows and lags of the other queries that
    can be nearer than these. Where that is not all of them, it is all those nearer than ``reach``.

    Places are axis by axis; known points come in the order that ties go by; all other queries up to ``bound`` are among ``others``.
    Queries at the very same place are left out: all but the first visited of them take its value.
    """
    n, k = places.shape[1], search.k
    lag = search.lags(*(known[i] - places[i, :, None] for i in range(3)))
    row, column, number = smallest(lag, k)
    last = np.full((n, k), np.inf)
    last[row, number] = lag[row, column]
    kept = search.taken(number, lag[row, column])
    row, column = row[kept], column[kept]
    told = np.column_stack([lag[row, column], *known[:, column], values[column]])
    told = np.split(told, np.searchsorted(row, np.arange(1, n)))

    first, most = last[:, min(search.least, k - 1)], last[:, k - 1]
    delta = [others[i] - places[i, :, None] for i in range(3)]
    lag = search.lags(*delta)
    nearer = (lag < most[:, None]) & ((lag <= 1) | (lag < first[:, None])) & ~((delta[0] == 0) & (delta[1] == 0) & (delta[2] == 0))
    row, column, number = smallest(np.where(nearer, lag, np.inf), LISTED + 1)
    reach = np.where(bound >= np.where(most <= 1, most, np.maximum(1, first)), np.inf, bound)
    over = number == LISTED
    reach[row[over]] = np.minimum(reach[row[over]], lag[row[over], column[over]])
    kept = lag[row, column] < reach[row]
    row, column = row[kept], column[kept]
    edges = np.searchsorted(row, np.arange(1, n))
    return pd.DataFrame({"known": [t.ravel() for t in told], "near": np.split(rows[column], edges) if n else [], "lags": np.split(lag[row, column], edges) if n else [], "reach": reach})


class Leaves:
    """Points, axis by axis, cut in halves until no part has more than LEAF, and the boxes of the parts in the coordinates of ``Search.ball``."""

    def __init__(self, points: np.ndarray, search: Search):
        self.points, self.search, self.parts = points, search, []
        self.ball = search.ball(points)
        open_ = [np.arange(points.shape[1])] if points.shape[1] else []
        while open_:
            part = open_.pop()
            if len(part) <= LEAF:
                self.parts.append(part)
                continue
            own = self.ball[:, part]
            half = np.argpartition(own[np.argmax(own.max(1) - own.min(1))], len(part) // 2)
            open_ += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
        self.low, self.high = (np.array([f(self.ball[:, part], axis=1) for part in self.parts]).reshape(-1, 3) for f in (np.min, np.max))
        self.sizes = np.array([len(part) for part in self.parts], int)

    def furthest(self, places: np.ndarray, low: np.ndarray, high: np.ndarray, counts: list[int]) -> list[float]:
        """How far, at the most, this many nearest points of any of the places in the box are; by the points of the leaves around it."""
        order = np.argsort((((self.low + self.high) - (low + high)) ** 2).sum(1))
        near = np.concatenate([np.zeros(0, int), *(self.parts[i] for i in order[: 1 + np.searchsorted(np.cumsum(self.sizes[order]), max(PROBED, *counts))])])
        lag = self.search.lags(*(self.points[i, near] - places[i, :, None] for i in range(3)))
        return [float(np.partition(lag, n - 1, axis=1)[:, n - 1].max()) if n <= len(near) else np.inf for n in counts]

    def within(self, low: np.ndarray, high: np.ndarray, limit: float) -> np.ndarray:
        """The points, in their order, of all leaves up to this far from a box, and not many more."""
        off = np.maximum(0, np.maximum(self.low - high, low - self.high))
        # Lags are made of differences that are turned, boxes of turned coordinates: both round, by parts of the coordinates.
        slack = 1e-14 * max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0), np.abs(low).max(), np.abs(high).max())
        met = np.flatnonzero(np.sqrt((off * off).sum(1)) <= limit * (1 + 1e-12) + slack)
        return np.sort(np.concatenate([np.zeros(0, int), *(self.parts[i] for i in met)]))


def searched(places: np.ndarray, known: np.ndarray, values: np.ndarray, others: np.ndarray, rows: np.ndarray, bound: np.ndarray, search: Search) -> pd.DataFrame:
    """What ``listed`` tells of each query, by leaves of queries, each of which meets the leaves of points that can be near enough."""
    told, asked, own, found = Leaves(known, search), Leaves(others, search), Leaves(places, search), []
    for part, low, high in zip(own.parts, own.low, own.high, strict=True):
        most, first = told.furthest(places[:, part], low, high, [search.k, min(search.least + 1, search.k)])
        limit = min(most, max(1.0, first))
        nearest = min(limit, *asked.furthest(places[:, part], low, high, [LISTED + 1]))
        near, others_near = told.within(low, high, limit), asked.within(low, high, nearest)
        lists = listed(places[:, part], known[:, near], values[near], others[:, others_near], rows[others_near], np.minimum(nearest, bound[part]), search)
        found.append(lists.assign(at=part))
    return pd.concat(found).sort_values("at").drop(columns="at")


def weights(points: np.ndarray, places: np.ndarray, kernel, jitter: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the values of n neighbours each (m, n, 3), their mean's share included, and deviations, noise included."""
    m, n = points.shape[:2]
    left = kernel.at(points[:, :, None] - points[:, None])
    left[:, np.arange(n), np.arange(n)] += kernel.noise + jitter
    low, w = np.linalg.cholesky(left), kernel.at(points - places[:, None])
    for i in range(n):
        w[:, i] = (w[:, i] - (low[:, i, :i] * w[:, :i]).sum(1)) / low[:, i, i]
    deviation = np.sqrt(np.maximum(0.0, kernel.amplitude + kernel.noise - (w * w).sum(1)))
    for i in reversed(range(n)):
        w[:, i] = (w[:, i] - (low[:, i + 1 :, i] * w[:, i + 1 :]).sum(1)) / low[:, i, i]
    return w + (1 - w.sum(1, keepdims=True)) / n, deviation


def _laid(counts: np.ndarray, flat: np.ndarray, width: int, fill) -> np.ndarray:
    """Rows of these counts, one after another in ``flat``, side by side in an array of this width."""
    out = np.full((len(counts), width, *flat.shape[1:]), fill, flat.dtype)
    out[np.arange(width) < counts[:, None]] = flat
    return out


class Lists:
    """What some queries' lists say, nearest first: lag, number of a query (or -1), place and value."""

    def __init__(self, rows: np.ndarray, at: np.ndarray, known: list[np.ndarray], near: list[np.ndarray], lags: list[np.ndarray], reach: np.ndarray, search: Search):
        told = np.concatenate(known).reshape(-1, 5)
        counts = np.array([len(x) // 5 for x in known], int), np.array([len(x) for x in near], int)
        widths = [int(c.max(initial=0)) for c in counts]
        self.rows, self.places, self.reach, self.search = rows, at[rows], reach, search
        self.known = _laid(counts[0], told, widths[0], np.inf)
        numbers = _laid(counts[1], np.concatenate(near).astype(int), widths[1], -1)
        lag = np.concatenate([self.known[..., 0], _laid(counts[1], np.concatenate(lags), widths[1], np.inf)], 1)
        order = np.argsort(lag, axis=1, kind="stable")[:, : int(np.max(counts[0] + counts[1], initial=0))]  # a known point comes before a query as near
        each = np.arange(len(rows))[:, None]
        self.lag = lag[each, order]
        self.number = np.concatenate([np.full(self.known.shape[:2], -1), numbers], 1)[each, order]
        self.points = np.concatenate([self.known[..., 1:4], at[numbers]], 1)[each, order]
        self.values = np.concatenate([self.known[..., 4], np.zeros(numbers.shape)], 1)[each, order]
        self.told = self.number < 0
        self.valid = self.lag < reach[:, None]
        self.same = _same(self.points, self.places)
        tie = (self.lag[:, 1:] == self.lag[:, :-1]) & ~self.told[:, 1:] & ~self.told[:, :-1]
        self.tied = np.flatnonzero(tie.any(1)) if tie.size else np.zeros(0, int)
        self.place = np.cumsum(np.pad(~tie, ((0, 0), (1, 0)))[self.tied], axis=1) if len(self.tied) else None

    def chosen(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which of each list are the neighbours, by ranks of visits; which is the first, whether there is one, and whether the list tells."""
        visited = rank[self.number]
        there = self.valid & (self.told | (visited < rank[self.rows, None]))
        total = there.sum(1)
        kept = there & self.search.taken(np.cumsum(there, 1) - 1, self.lag)
        first = np.argmax(there, 1) if there.shape[1] else np.zeros(len(there), int)
        if len(self.tied):  # queries as far as each other go by their visits
            t = self.tied
            order = np.argsort(self.place * (len(rank) + 1) + np.where(self.told[t], 0, visited[t]), axis=1, kind="stable")
            own = np.take_along_axis(there[t], order, 1)
            part = np.empty_like(own)
            np.put_along_axis(part, order, own & self.search.taken(np.cumsum(own, 1) - 1, np.take_along_axis(self.lag[t], order, 1)), 1)
            kept[t] = part
            first[t] = order[np.arange(len(t)), np.argmax(own, 1)]
        some = total > 0
        tells = (self.reach == np.inf) | (total >= self.search.k) | ((total > self.search.least) & (self.reach > 1))
        return kept, first, some, tells | (some & self.first(self.same, first, False))

    def first(self, of: np.ndarray, first: np.ndarray, fill) -> np.ndarray:
        return of[np.arange(len(first)), first] if of.shape[1] else np.full(len(first), fill)

    def searched(self, own: np.ndarray, rank: np.ndarray, visits: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, and for each row numbers, places, values and lags of its neighbours, from the known ones of its list and all queries visited before it."""
        k, own = self.search.k, own[np.argsort(rank[self.rows[own]])]
        while len(own):
            step = max(1, DISTANCES // max(1, int(rank[self.rows[own[-1]]])))
            part, own = own[-step:], own[:-step]
            before = visits[: int(rank[self.rows[part[-1]]])]
            lag = self.search.lags(*(at[before, i] - self.places[part, i, None] for i in range(3)))
            lag[(np.arange(len(before)) >= rank[self.rows[part], None]) | np.isnan(lag)] = np.inf
            row, column, number = smallest(lag, k)
            near = np.full((len(part), k), np.inf)
            numbers = np.full((len(part), k), -1)
            near[row, number], numbers[row, number] = lag[row, column], before[column]
            known = self.known[part]
            near = np.concatenate([known[..., 0], near], 1)
            order = np.argsort(near, axis=1, kind="stable")[:, :k]
            each = np.arange(len(part))[:, None]
            points = np.concatenate([known[..., 1:4], at[numbers]], 1)[each, order]
            values = np.concatenate([known[..., 4], np.zeros(numbers.shape)], 1)[each, order]
            yield part, np.concatenate([np.full(known.shape[:2], -1), numbers], 1)[each, order], points, values, near[each, order]


def _same(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (np.abs(points - places[:, None]) <= 1e-8 + 1e-5 * np.abs(places[:, None])).all(2)


class Sets:
    """Sets of neighbours, solved: numbers of the queries among them, with weights, what the known ones come to, and deviations."""

    def __init__(self, kernel, jitter: float, k: int, none: int):
        self.kernel, self.jitter, self.k, self.none, self.size = kernel, jitter, k, none, 0
        self.parts: list[tuple] = []

    def add(self, places: np.ndarray, numbers: np.ndarray, points: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The numbers of these sets, whose first ``counts`` neighbours count."""
        w, deviation = np.zeros((len(places), self.k)), np.zeros(len(places))
        for n in np.unique(counts):
            of = np.flatnonzero(counts == n)
            for s in range(0, len(of), SYSTEMS):
                own = of[s : s + SYSTEMS]
                w[own, :n], deviation[own] = weights(points[own, :n], places[own], self.kernel, self.jitter)
        inside = np.arange(self.k) < counts[:, None]
        asked = inside & (numbers >= 0)
        told = np.where(inside & ~asked, w * np.where(inside, values, 0.0), 0.0).sum(1)
        self.parts.append((np.where(asked, numbers, self.none), np.where(asked, w, 0.0), told, deviation))
        self.size += len(places)
        return np.arange(self.size - len(places), self.size)

    def all(self) -> list[np.ndarray]:
        empty = (np.zeros((0, self.k), int), np.zeros((0, self.k)), np.zeros(0), np.zeros(0))
        return [np.concatenate(x) for x in zip(empty, *self.parts, strict=True)]


def _wide(array: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` columns, or as many, filled up with the last."""
    missing = k - array.shape[1]
    return array[:, :k] if missing <= 0 else np.pad(array, [(0, 0), (0, missing)] + [(0, 0)] * (array.ndim - 2), "edge")


def realisations(at: np.ndarray, known: list, near: list, lags: list, reach: np.ndarray, mean: float, kernel, jitter: float, search: Search, seed: int, sims: range) -> np.ndarray:
    """Values of these realisations (a row each) at a group's queries, which lie at ``at``; ``near`` names them by number.

    ``mean`` is that of draws without a neighbour. A query without finite coordinates has no value and is nobody's neighbour.
    """
    m, k = len(at), search.k
    fine = np.isfinite(at).all(1)
    at = np.where(fine[:, None], at, np.nan)
    place = np.zeros(m, int)
    place[fine] = np.unique(at[fine], axis=0, return_inverse=True)[1].ravel()
    rngs = [np.random.default_rng([seed, s]) for s in sims]
    visits = [rng.permutation(m) for rng in rngs]
    ranks = np.empty((len(sims), m), int)
    for rank, visit in zip(ranks, visits, strict=True):
        rank[visit] = np.arange(m)
    # What a step is: a set of neighbours, the copy of a query or of a known value, or a draw without neighbours.
    of, source, drawn = np.full(ranks.shape, -1), np.full(ranks.shape, -1), np.ones(ranks.shape, bool)
    base = np.full(ranks.shape, np.where(fine, mean, np.nan))
    sets = Sets(kernel, jitter, k, m)
    for s, visit in enumerate(visits):
        leader = np.empty(m, int)
        back = visit[fine[visit]][::-1]
        leader[place[back]] = back  # the first visited comes last
        follows = fine & (leader[place] != np.arange(m))
        source[s, follows], drawn[s, follows] = leader[place[follows]], False

    for c in range(0, m, TOGETHER):
        rows = np.arange(c, min(c + TOGETHER, m))
        lists = Lists(rows, at, known[c : c + TOGETHER], near[c : c + TOGETHER], lags[c : c + TOGETHER], reach[rows], search)
        words = [slice(w, w + 62) for w in range(0, lists.lag.shape[1], 62)]
        asked, masks = [], []

        def copy(s: int, own: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> None:
            source[s, own], drawn[s, own] = numbers, False
            base[s, own] = np.where(numbers < 0, values, 0.0)

        for s, rank in enumerate(ranks):
            kept, first, some, tells = lists.chosen(rank)
            left = fine[rows] & drawn[s, rows]
            at_one = left & some & lists.first(lists.same, first, False)
            copy(s, rows[at_one], lists.first(lists.number, first, -1)[at_one], lists.first(lists.values, first, 0.0)[at_one])
            left &= ~at_one
            own = np.flatnonzero(left & tells & some)
            asked.append(np.column_stack([np.full(len(own), s), own]))
            masks.append(np.column_stack([kept[own, w] @ (1 << np.arange(kept[own, w].shape[1])) for w in words]) if words else np.zeros((len(own), 0), int))
            for part, numbers, points, values, lag in lists.searched(np.flatnonzero(left & ~tells), rank, visits[s], at):
                counts = (search.taken(np.arange(lag.shape[1]), lag) & (lag < np.inf)).sum(1)
                same = (counts > 0) & _same(points[:, :1], at[rows[part]])[:, 0]
                copy(s, rows[part[same]], numbers[same, 0], values[same, 0])
                rest = (counts > 0) & ~same
                of[s, rows[part[rest]]] = sets.add(at[rows[part[rest]]], _wide(numbers[rest], k), points[rest], _wide(values[rest], k), counts[rest])
        pairs, masks = np.concatenate(asked), np.concatenate(masks)
        order = np.lexsort((*masks.T, pairs[:, 1]))
        told = np.column_stack([pairs[order, 1], masks[order]])
        new = np.concatenate([[True], (told[1:] != told[:-1]).any(1)]) if len(told) else np.zeros(0, bool)
        row, bits = told[new, 0], told[new, 1:]
        kept = np.concatenate([(bits[:, i, None] >> np.arange(lists.lag[:1, w].shape[1])) & 1 for i, w in enumerate(words)], 1) if words else np.zeros((len(row), 0), int)
        columns = np.argsort(-kept, axis=1, kind="stable")[:, :k]
        one = row[:, None]
        numbers = sets.add(at[rows[row]], _wide(lists.number[one, columns], k), lists.points[one, columns], _wide(lists.values[one, columns], k), kept.sum(1)) if len(row) else row
        of[pairs[order, 0], rows[pairs[order, 1]]] = numbers[np.cumsum(new) - 1] if len(row) else 0

    numbers, factors, told, deviations = sets.all()
    out, prior = np.empty(ranks.shape), math.sqrt(kernel.amplitude + kernel.noise)
    for s, (rng, visit) in enumerate(zip(rngs, visits, strict=True)):
        normal = np.zeros(m)
        steps = visit[drawn[s, visit]]
        normal[steps] = rng.standard_normal(len(steps))
        inner, alone = of[s] >= 0, drawn[s] & (of[s] < 0)
        value, after, share = base[s], np.full((m, k), m), np.zeros((m, k))
        own = of[s, inner]
        after[inner], share[inner], value[inner] = numbers[own], factors[own], told[own] + deviations[own] * normal[inner]
        value[alone] += prior * normal[alone]
        copies = source[s] >= 0
        after[copies, 0], share[copies, 0], value[copies] = source[s, copies], 1.0, 0.0
        out[s] = _waves(value, after, share)
    return out


def _waves(value: np.ndarray, after: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Each value plus the shares of those it comes after, which have to be there first; the number beyond the last is none."""
    m = len(value)
    out, done, open_ = np.zeros(m + 1), np.zeros(m + 1, bool), np.arange(m)
    done[m] = True
    while len(open_):
        ready = done[after[open_]].all(1)
        now = open_[ready]
        out[now] = value[now] + (share[now] * out[after[now]]).sum(1)
        done[now] = True
        open_ = open_[~ready]
    return out[:m]


def simulate(queries: DataFrame, known: DataFrame, keys: list[str], kernel, jitter: float, sims: int, seed: int, search: Search) -> DataFrame:
    """``keys, sim, block_id, value``: realisations at the queries, each drawn from known points and the queries visited before it."""
    rows = cut(kinds(queries, known.where(F.abs("v") < float("inf")), keys).withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = {key: f"_k{i}" for i, key in enumerate(keys)}
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("_asked") == 1).alias("_m"), F.count("*").alias("_all"), F.avg("v").alias("_mean")).where("_m > 0")
    groups = numbered(sizes.withColumnsRenamed(named), "_g")
    same = F.lit(True)
    for key, name in named.items():
        same = same & rows[key].eqNullSafe(groups[name])
    own = rows.join(groups, same).select("_g", "_all", "_asked", "_row", "block_id", *AXES, *(F.col(a).alias(p) for a, p in zip(AXES, _PLACE, strict=True)), F.coalesce("v", F.lit(float("nan"))).alias("v"))
    asks, largest = groups.agg(F.coalesce(F.sum("_m"), F.lit(0)), F.coalesce(F.max("_all"), F.lit(0))).first()
    lists = _lists(in_ellipsoid(own, search.radii, search.angles), search, largest > WHOLE)

    steps = sims * asks
    least, most = TASK_STEPS
    of_task = min(max(steps // (FINER * queries.sparkSession.sparkContext.defaultParallelism), least), most)
    together = F.greatest(F.lit(1), F.least(F.lit(sims), F.floor(of_task / F.col("_m")))).cast("int")
    asked = lists.join(groups, "_g").withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(sims - 1), together))).withColumn("_sims", together)
    schema = rows.select(*keys).schema.add("sim", "integer").add(rows.schema["block_id"]).add("value", "double")
    asked = asked.withColumnsRenamed({name: key for key, name in named.items()})

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block_id", "_row"])
        ids = frame["_row"].to_numpy()
        order = np.argsort(ids)
        near = [order[np.searchsorted(ids, x, sorter=order)] for x in frame["near"]]
        first, mean = int(frame["_from"].iloc[0]), float(frame["_mean"].iloc[0])
        own = range(first, min(first + int(frame["_sims"].iloc[0]), sims))
        told = (frame["known"].to_list(), near, frame["lags"].to_list(), frame["reach"].to_numpy(float))
        values = realisations(frame[_PLACE].to_numpy(float), *told, 0.0 if math.isnan(mean) else mean, kernel, jitter, search, seed, own)
        out = frame[[*keys, "block_id"]].iloc[np.tile(np.arange(len(frame)), len(own))]
        return out.assign(sim=np.repeat(np.array(own, "int32"), len(frame)), value=values.ravel())[schema.names]

    return dealt(asked, ["_g", "_from"]).groupBy("_g", "_from").applyInPandas(draw, schema)


def _lists(placed: DataFrame, search: Search, large: bool) -> DataFrame:
    """``_g, _row, block_id``, places and what ``listed`` tells of each query; coordinates are those in which the ellipsoid is the unit ball.

    Groups of up to WHOLE points and queries are searched in a task each, others, if there are ``large`` ones, by blocks.
    """
    finite = F.coalesce(F.expr(" AND ".join(f"abs({a}) < double('infinity')" for a in AXES)), F.lit(False))
    none = {"known": "array<double>", "near": "array<long>", "lags": "array<double>"}
    lost = placed.where(~finite & (F.col("_asked") == 1)).select("_g", "_row", "block_id", *_PLACE, *(F.expr(f"cast(array() AS {t})").alias(c) for c, t in none.items()), F.lit(float("inf")).alias("reach"))
    schema = lost.schema

    def answers(g: int, places: list, rows: np.ndarray, ids: np.ndarray, bound: np.ndarray, known: list, known_ids: np.ndarray, values: np.ndarray, others: list, other_rows: np.ndarray) -> pd.DataFrame:
        order = np.argsort(pd.factorize(known_ids, sort=True)[0], kind="stable")
        places, known, others = (np.array(x, float) for x in (places, known, others))
        found = searched(places, known[:, order], values.astype(float)[order], others, other_rows.astype(int), bound, search)
        return found.assign(**{"_g": g, "_row": rows, "block_id": ids}, **dict(zip(_PLACE, places, strict=True)))[schema.names]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        q, t = frame[frame["_asked"] == 1], frame[frame["_asked"] == 0]
        if q.empty:
            return pd.DataFrame({name: [] for name in schema.names})
        places, points = ([f[c].to_numpy() for c in _PLACE] for f in (q, t))
        rows = q["_row"].to_numpy()
        return answers(q["_g"].iloc[0], places, rows, q["block_id"].to_numpy(), np.full(len(q), np.inf), points, t["block_id"].to_numpy(), t["v"].to_numpy(), places, rows)

    placed = placed.where(finite)
    alone = dealt(placed.where(f"_all <= {WHOLE}"), ["_g"]).groupBy("_g").applyInPandas(whole, schema).unionByName(lost)
    if not large:
        return alone
    part, block = F.shiftleft(F.col("_id._part").cast("long"), 32), F.col("_id._block")
    cuts = blocks(placed.where(f"_all > {WHOLE}").drop("_all").withColumn("_tie", F.struct("block_id")), ["_g", "_asked"], 0, SIZE, body=("_row", "_tie", *_PLACE, "v"))
    made = cuts.withColumns({"_t": part + block, "_s": part + F.floor(block / BLOCKS)}).drop("_id")
    heads = made.where("_asked = 1").select("_g", F.col("_t").alias("_q"), *(F.col(b).alias(f"_q{b}") for b in BOX)).join(made.select("_g", "_asked", "_t", "_n", *BOX), "_g")
    # Lags are made of differences that are turned, boxes of turned coordinates: both round, by parts of the coordinates.
    off = F.greatest(*(F.abs(F.col(b)) for box in BOX for b in (box, f"_q{box}"))) * 1e-14
    met = cut(measured(heads).select("_g", "_q", "_asked", "_t", "_n", (F.col("_near") - off).alias("_near"), (F.col("_far") * (1 + 1e-12) + off).alias("_far")), "met")
    upto = met.withColumn("_all", F.sum("_n").over(Window.partitionBy("_g", "_q", "_asked").orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)))

    def bound(asked: int, count: int):
        return F.coalesce(F.min(F.when((F.col("_asked") == asked) & (F.col("_all") >= count), F.col("_far"))), F.lit(float("inf")))

    told = F.least(bound(0, search.k), F.greatest(bound(0, min(search.least + 1, search.k)), F.lit(1.0)))
    limits = upto.groupBy("_g", "_q").agg(told.alias("_told"), bound(1, LISTED + 1).alias("_bound"))
    asked = made.where("_asked = 1").withColumnRenamed("_t", "_q").join(limits, ["_g", "_q"])
    each = ["_g", "_s"]
    pairs = met.join(asked.select("_g", "_q", "_s", "_told", "_bound"), ["_g", "_q"]).where("_near <= IF(_asked = 0, _told, least(_told, _bound))").select(*each, "_asked", "_t").distinct()
    names = [f"_{p}s" for p in _PLACE]
    body = ["__rows", F.col("__ties.block_id").alias("_ids"), *names]
    bodies = pairs.join(made.select("_g", "_asked", "_t", *body, "_vs"), ["_g", "_asked", "_t"]).drop("_t")
    asked = asked.select(*each, "_bound", *body)

    def joined(frame: pd.DataFrame, column: str) -> np.ndarray:
        return np.concatenate([np.asarray(x) for x in frame[column]]) if len(frame) else np.zeros(0)

    def chosen(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty:
            return pd.DataFrame({name: [] for name in schema.names})
        known, others = t[t["_asked"] == 0], t[t["_asked"] == 1]
        places, points, asked_points = ([joined(of, c) for c in names] for of in (q, known, others))
        bound = np.repeat(q["_bound"].to_numpy(float), q["__rows"].map(len))
        return answers(q["_g"].iloc[0], places, joined(q, "__rows"), joined(q, "_ids"), bound, points, joined(known, "_ids"), joined(known, "_vs"), asked_points, joined(others, "__rows"))

    asked, bodies = (dealt(f.toDF(*f.columns), each) for f in (asked, bodies))
    return asked.groupBy(*each).cogroup(bodies.groupBy(*each)).applyInPandas(chosen, schema).unionByName(alone)
