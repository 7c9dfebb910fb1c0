"""Numbers of tables in Chinese restaurants, drawn by blocked Gibbs steps."""

from __future__ import annotations

import math

import numpy as np

EXACT_CUSTOMERS = 4096  # up to here Stirling numbers come from their recursion, beyond from closed forms
MATRIX = 1 << 21
TERMS = 40  # of the series, and so many more as its largest one is late
DIGITS = 19.0  # natural logarithm of the cancellation that the series may have
FIRST = 160  # numbers of tables that are tried first
GRID = 200
WINDOW = 20_000  # numbers of tables that are looked at one by one
FAR = 40.0  # natural logarithm under the top from which a number of tables is out of reach


def stirling_rows(counts: np.ndarray, discount: float):
    """``(n, row)`` for each of the ascending ``counts``: logarithms of the generalised Stirling
    numbers of ``n`` customers at 1 .. n tables, each row from the one before it."""
    row, n, wanted = np.zeros(1), 1, iter(counts.tolist())
    target = next(wanted, None)
    while target is not None:
        if n == target:
            yield n, row
            target = next(wanted, None)
            continue
        tables = np.arange(1, n + 1)
        stay = row + np.log(n - tables * discount)
        longer = np.full(n + 1, -np.inf)
        longer[:n] = stay
        longer[1:] = np.logaddexp(longer[1:], row)
        row, n = longer, n + 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, np.float64)
    y, shift = x + 8, np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_LOG_FACTORIALS = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """Logarithms of factorials of whole numbers that are not negative."""
    x = x.astype(np.int64)
    small = _LOG_FACTORIALS[np.minimum(x, len(_LOG_FACTORIALS) - 1)]
    return small if not len(x) or x.max() < len(_LOG_FACTORIALS) else np.where(x < len(_LOG_FACTORIALS), small, log_gamma(x + 1.0))


def log_stirling(n: int, tables: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of many customers, for any numbers of tables.

    ``n! / (t! d**t)`` times the coefficient of ``z**n`` in ``(1 - (1 - z)**d)**t``. While t is
    of the order of ``n**d``, that is a finite sum of gamma functions whose terms fall quickly;
    beyond, where they cancel, a saddle point, shifted to meet the sum where it takes over.
    """
    t = np.asarray(tables, np.float64)
    scaled = t / n**discount
    power = 1 / (1 - discount)
    decay = (1 - discount) * discount ** (discount * power)
    by_sum = 2 * scaled + decay * scaled**power < DIGITS
    out = np.empty(len(t))
    out[by_sum] = _by_series(n, t[by_sum], discount)
    rest = ~by_sum
    if rest.any():
        edge = _last_by_sum(n, discount, power, decay)
        meet = np.array([edge], np.float64)
        shift = _by_series(n, meet, discount) - _by_saddle(n, meet, discount) if edge > 1 else 0.0
        out[rest] = _by_saddle(n, t[rest], discount) + shift * (edge / t[rest])
    return out


def _last_by_sum(n: int, discount: float, power: float, decay: float) -> int:
    low, high = 1, n
    while low < high:
        middle = (low + high + 1) // 2
        x = middle / n**discount
        low, high = (middle, high) if 2 * x + decay * x**power < DIGITS else (low, middle - 1)
    return low


def _by_series(n: int, t: np.ndarray, discount: float) -> np.ndarray:
    if not len(t):
        return t
    largest = (t.max() / n**discount * discount**discount) ** (1 / (1 - discount))
    j = np.arange(1, min(TERMS + int(4 * largest), int(t.max())) + 1, dtype=np.float64)
    j = j[discount * j < n]
    sign = np.where(j % 2 == 1, 1.0, -1.0) * np.sin(np.pi * discount * j)
    size = log_gamma(1 + discount * j) + log_gamma(n - discount * j) - math.log(math.pi) - math.lgamma(n + 1) - log_factorial(j)
    more = (t[:, None] - j[None, :]).astype(np.int64)
    ways = np.where(more >= 0, log_factorial(t)[:, None] - log_factorial(np.maximum(more, 0)), -np.inf)
    terms = size[None, :] + ways
    top = terms.max(axis=1)
    total = (sign[None, :] * np.exp(terms - top[:, None])).sum(axis=1)
    coefficient = np.log(np.maximum(total, 1e-300)) + top
    return coefficient + math.lgamma(n + 1) - log_factorial(t) - t * math.log(discount)


def _by_saddle(n: int, t: np.ndarray, discount: float) -> np.ndarray:
    """The coefficient by a Gaussian around the saddle, in the logarithm of ``1 - z``."""
    d = discount
    low, high = np.full(len(t), -700.0), np.full(len(t), -1e-12)
    for _ in range(80):
        middle = (low + high) / 2
        slope = np.log(t * d * -np.expm1(middle)) + (d - 1) * middle - np.log(-np.expm1(d * middle))
        small = slope < math.log(n)  # z has to come nearer to 1
        high, low = np.where(small, middle, high), np.where(small, low, middle)
    s = (low + high) / 2
    y, z, f = np.exp(s), -np.expm1(s), -np.expm1(d * s)
    first = z * d * y ** (d - 1) / f
    second = z * z * d * (1 - d) * y ** (d - 2) / f
    spread = t * (first + second - first * first)
    coefficient = t * np.log(f) - n * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-300))
    return coefficient + math.lgamma(n + 1) - log_factorial(t) - t * math.log(d)


def table_chances(customers: int, weight: float, rest: float, discount: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables of a dish with many customers, and their probabilities.

    The law is that of ``draw_tables``. If it does not lie among the first ``FIRST`` numbers, a
    grid finds where it does; there every number counts, or, if these are too many, evenly
    spaced ones that stand for their neighbours.
    """

    def logs(t: np.ndarray) -> np.ndarray:
        grow = log_gamma(strength / discount + rest + t) + t * math.log(discount) + t * math.log(weight)
        return log_stirling(customers, t, discount) + grow

    spots = np.arange(1, FIRST + 1)
    values = logs(spots)
    if values[-1] < values.max() - FAR:  # the rest is out of reach, as of most dishes
        chance = np.exp(values - values.max())
        return spots, chance / chance.sum()
    grid = np.unique(np.geomspace(1, customers, GRID).astype(np.int64))
    values = logs(grid)
    near = np.flatnonzero(values > values.max() - FAR)
    low, high = grid[max(0, near[0] - 1)], grid[min(len(grid) - 1, near[-1] + 1)]
    spots = np.arange(low, high + 1) if high - low < WINDOW else np.unique(np.linspace(low, high, WINDOW).astype(np.int64))
    values = logs(spots)
    chance = np.exp(values - values.max()) * np.gradient(spots.astype(np.float64)) if len(spots) > 1 else np.ones(1)
    return spots, chance / chance.sum()


def draw_tables(
    customers: np.ndarray, weight: np.ndarray, rest: np.ndarray, discount: float, strength: float, rng: np.random.Generator
) -> np.ndarray:
    """Tables of each dish, drawn from their distribution given all else.

    ``customers`` of a dish sit in a restaurant whose other dishes have ``rest`` tables; the
    parent serves the dish with probability ``weight``. The seats of a dish are drawn as one
    block: with S(c, t) seatings of c customers at t tables, t has the probability
    S(c, t) weight**t (strength + discount rest) (strength + discount (rest + 1)) ...
    The numbers S come from their recursion, and for a dish with more than
    ``EXACT_CUSTOMERS`` customers from closed forms of the same numbers.
    """
    out = np.ones(len(customers), np.int64)
    few = np.flatnonzero(customers <= EXACT_CUSTOMERS)
    order = few[np.argsort(customers[few], kind="stable")]
    values, starts = np.unique(customers[order], return_index=True)
    stops = np.append(starts[1:], len(order))
    first = np.searchsorted(values, 2)
    for (n, row), a, b in zip(stirling_rows(values[first:], discount), starts[first:], stops[first:]):
        step = max(1, MATRIX // n)
        for at in range(a, b, step):
            some = order[at : min(b, at + step)]
            grow = np.log(strength + discount * (rest[some, None] + np.arange(n)[None, :]))
            chance = row[None, :] + np.cumsum(grow + np.log(weight[some, None]), axis=1)
            chance = np.cumsum(np.exp(chance - chance.max(axis=1, keepdims=True)), axis=1)
            spot = rng.random(len(some)) * chance[:, -1]
            out[some] = 1 + (chance < spot[:, None]).sum(axis=1)
    for i in np.flatnonzero(customers > EXACT_CUSTOMERS).tolist():
        spots, chance = table_chances(int(customers[i]), float(weight[i]), float(rest[i]), discount, strength)
        out[i] = spots[min(len(spots) - 1, int(np.searchsorted(np.cumsum(chance), rng.random())))]
    return out
