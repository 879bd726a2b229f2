"""The small linear programme of one scenario: the columns chosen so far, a few hundred at most.

Spark prices the whole candidate table against the duals found here (see diets.py);
this only ever sees the columns that pricing lets in.

Each nutrient is one row, amounts @ x = level, and its level a variable of its own between the bounds. A basis says
which columns and levels solve the rows; other levels sit on a bound. Columns that come in later leave a basis as it
is, so the next round starts from the last one's: after an optimum no step looks for feasibility again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TOLERANCE = 1e-9
INFEASIBLE = 1e-7
PIVOT = 1e-9
REFRESH = 32  # steps between fresh inverses of the basis
STALLED = 40  # steps without progress after which the smallest index goes first, which can't cycle


@dataclass(frozen=True)
class Basis:
    """Basic variables: columns by index, and levels as -1 - row. raised: rows whose level sits on its upper bound."""

    members: list[int]
    raised: list[bool]


@dataclass
class Solved:
    """x: quantities; prices: net price of each nutrient, so that weight * cost - prices @ amounts are reduced costs.

    weight is 0 while the bounds can't be met by these columns, else 1. steps: changes of the basis or of a bound.
    """

    status: str
    x: np.ndarray
    prices: np.ndarray
    weight: float
    basis: Basis | None = None
    steps: int = 0


class _Stuck(Exception):
    """More steps than bases that a programme of this size plausibly visits."""


def solve(cost: np.ndarray, amounts: np.ndarray, lower: np.ndarray, upper: np.ndarray):
    """min cost.x with lower <= amounts.x <= upper and x >= 0: (status, x, prices, weight), from no basis."""
    got = solve_from(cost, amounts, lower, upper)
    return got.status, got.x, got.prices, got.weight


def solve_from(cost: np.ndarray, amounts: np.ndarray, lower: np.ndarray, upper: np.ndarray, start: Basis | None = None) -> Solved:
    """min cost.x with lower <= amounts.x <= upper and x >= 0, from a basis of some of the columns.

    amounts is nutrients x columns; infinite bounds are left out. Where rounding leaves no basis to go
    on from, neither from `start` nor from none, the status is 'unsolved'.
    """
    for basis in [start, None] if start is not None else [None]:
        try:
            return _Programme(cost, amounts, lower, upper, basis).run()
        except (np.linalg.LinAlgError, _Stuck):
            continue
    return Solved("unsolved", np.zeros(amounts.shape[1]), np.zeros(len(lower)), 0.0)


@dataclass
class _Programme:
    cost: np.ndarray
    amounts: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    start: Basis | None
    steps: int = field(default=0, init=False)

    def __post_init__(self):
        self.given = np.flatnonzero(np.isfinite(self.lower) | np.isfinite(self.upper))
        rows = self.amounts[self.given]
        m, self.n = rows.shape
        finite = [np.where(np.isfinite(b), np.abs(b), 0.0) for b in (self.lower[self.given], self.upper[self.given])]
        scale = np.maximum(np.maximum(*finite), np.abs(rows).max(axis=1, initial=0.0))
        scale[scale == 0] = 1.0
        self.factor = 1.0 / scale
        # Columns, then levels: amounts @ x - level = 0.
        self.table = np.hstack([rows * self.factor[:, None], -np.eye(m)])
        self.low = np.concatenate([np.zeros(self.n), self.lower[self.given] * self.factor])
        self.high = np.concatenate([np.full(self.n, np.inf), self.upper[self.given] * self.factor])
        self.costs = np.concatenate([self.cost, np.zeros(m)])
        self.basis = self.n + np.arange(m)
        self.raised = ~np.isfinite(self.low[self.n :])
        if self.start is not None:
            place = {row: k for k, row in enumerate(self.given)}
            self.basis = np.array([v if v >= 0 else self.n + place[-1 - v] for v in self.start.members], dtype=int)
            self.raised = np.array([self.start.raised[row] for row in self.given], bool)

    def run(self) -> Solved:
        if not len(self.given):
            status = "unbounded" if (self.cost < 0).any() else "optimal"
            return Solved(status, np.zeros(self.n), np.zeros(len(self.lower)), 1.0, Basis([], [False] * len(self.lower)))
        status, y, missed = self._iterate(False)
        weight = 0.0
        if missed > INFEASIBLE:
            status = "infeasible"
        else:
            status, y, _ = self._iterate(True)
            weight = 1.0
        x = np.zeros(self.n)
        own = self.basis < self.n
        x[self.basis[own]] = np.maximum(self.level[own], 0.0)
        prices, raised = np.zeros(len(self.lower)), [False] * len(self.lower)
        prices[self.given] = y * self.factor
        for k, row in enumerate(self.given):
            raised[row] = bool(self.raised[k])
        members = [int(v) if v < self.n else -1 - int(self.given[v - self.n]) for v in self.basis]
        return Solved(status, x, prices, weight, Basis(members, raised), self.steps)

    def _levels(self) -> np.ndarray:
        """Basic values, other levels being on their bounds and other columns at zero."""
        m = len(self.given)
        at = np.where(self.raised, self.high[self.n :], self.low[self.n :])
        at[self.basis[self.basis >= self.n] - self.n] = 0.0
        return self.inverse @ np.where(np.isfinite(at), at, 0.0).reshape(m)

    def _iterate(self, priced: bool) -> tuple[str, np.ndarray, float]:
        """Steps until nothing improves: the cost if `priced`, else the sum by which basic values miss their bounds.

        Without prices the basic values beyond a bound pull towards it, and one that reaches it stays within.
        """
        total, m = self.table.shape[1], len(self.given)
        stalled = since = 0
        self.inverse = np.linalg.inv(self.table[:, self.basis])
        for _ in range(1000 + 100 * total):
            if since >= REFRESH:
                self.inverse, since = np.linalg.inv(self.table[:, self.basis]), 0
            self.level = self._levels()
            low, high = self.low[self.basis], self.high[self.basis]
            below, above = self.level < low - TOLERANCE, self.level > high + TOLERANCE
            missed = float((low - self.level)[below].sum() + (self.level - high)[above].sum())
            pull = above.astype(float) - below
            costs = self.costs if priced else np.zeros(total)
            y = (self.costs[self.basis] if priced else pull) @ self.inverse
            if not priced and missed == 0.0:
                return "optimal", y, 0.0
            products = y[:, None] * self.table
            reduced = costs - products.sum(axis=0)
            size = np.abs(costs) + np.abs(products).sum(axis=0)
            reduced[self.basis] = 0.0
            # A level on its upper bound improves by falling.
            sign = np.ones(total)
            sign[self.n :][self.raised] = -1.0
            movable = self.high - self.low > 0
            improving = np.flatnonzero((sign * reduced < -TOLERANCE * size) & movable)
            if improving.size == 0:
                return "optimal", y, missed
            gain = sign[improving] * reduced[improving] / size[improving]
            entering = int(improving[0] if stalled > STALLED else improving[np.argmin(gain)])
            change = -sign[entering] * (self.inverse @ self.table[:, entering])  # of basic values, for each unit of the step
            # How far until a basic value meets a bound: one that is beyond it meets the bound it misses.
            room = np.full(m, np.inf)
            up, down = change > PIVOT, change < -PIVOT
            target = np.where(below, low, high)
            can = up & np.isfinite(target) & ~above
            room[can] = np.maximum(target[can] - self.level[can], 0.0) / change[can]
            target = np.where(above, high, low)
            can = down & np.isfinite(target) & ~below
            room[can] = np.maximum(self.level[can] - target[can], 0.0) / -change[can]
            step = room.min(initial=np.inf)
            across = self.high[entering] - self.low[entering]
            if not np.isfinite(min(step, across)):
                return "unbounded", y, missed
            self.steps += 1
            if across <= step:  # from one bound to the other
                self.raised[entering - self.n] = ~self.raised[entering - self.n]
                stalled = 0
                continue
            ties = np.flatnonzero(room <= step + 1e-12)
            leaving = int(ties[np.argmin(self.basis[ties])] if stalled > STALLED else ties[np.argmax(np.abs(change[ties]))])
            gone = self.basis[leaving]
            if gone >= self.n:
                rising = change[leaving] > 0
                self.raised[gone - self.n] = bool(~below[leaving] if rising else above[leaving])
            self.basis[leaving] = entering
            column = self.inverse @ self.table[:, entering]
            if abs(column[leaving]) < PIVOT:
                raise _Stuck
            eta = -column / column[leaving]
            eta[leaving] = 1.0 / column[leaving]
            pivot = self.inverse[leaving].copy()
            self.inverse = self.inverse + eta[:, None] * pivot[None, :]
            self.inverse[leaving] = eta[leaving] * pivot
            since += 1
            stalled = stalled + 1 if step <= 1e-12 else 0
        raise _Stuck
