"""Best cuts of a sequence into a fixed number of segments, without a table of steps times segments.

Each segment is given a price. For one price the best segmentation of any number of segments takes quadratic time, and its value plus the
price of the wanted number bounds what that number can reach. Starts and ends whose best segmentation through them stays below the bound
by more than the gap to a known solution lie on no best path; the exact recursion over the number of segments runs on the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from spanforge.operators import kernel_blocks
from spanforge.operators.kernel_blocks import STRIP

# Prices tried in one pass, passes at most, steps of the beginning on which the first price is looked for.
PRICES, PASSES, BEGINNING = 8, 16, 1_024
# Segments, and values by step and number of segments, that the exact recursion may keep.
KEPT_SPANS, KEPT_VALUES = 8_000_000, 16_000_000
# Sums that differ by rounding only differ by less than this share.
ROUNDING = 1e-9


def gains(x: np.ndarray, sigma: float) -> Iterator[tuple[int, np.ndarray]]:
    """For every end e the kernel mass over length of all segments [s, e), s < e.

    The mass of [s, e) is that of [s, e - 1) and what the row of e - 1 adds, so one vector follows from the one
    before and no square matrix is kept.
    """
    n = len(x)
    mass = np.zeros(n)
    norms = (x * x).sum(axis=1)
    alone = n <= kernel_blocks.ALONE
    strip = STRIP if alone else max(16, STRIP * kernel_blocks.ALONE // n)
    for at in range(0, n, strip):
        own = x[at : at + strip]
        seen = at + len(own)
        gaps = (own @ x.T)[:, :seen] if alone else own @ x[:seen].T
        gaps = norms[at:seen, None] + norms[None, :seen] - 2.0 * gaps
        kernel = np.exp(-gaps / (2.0 * sigma * sigma))
        for row, last in zip(kernel, range(at, seen), strict=True):
            added = 2.0 * np.cumsum(row[last::-1])[::-1] - row[last]
            mass[: last + 1] += added
            yield last + 1, mass[: last + 1] / np.arange(last + 1, 0, -1)


def _priced(x: np.ndarray, sigma: float, prices: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(best values up to every end less the price of each segment, numbers of segments up to the last end), price by price."""
    value = np.full((len(prices), len(x) + 1), -np.inf)
    number = np.zeros(value.shape, np.int32)
    value[:, 0] = 0.0
    rows = np.arange(len(prices))
    for end, gain in gains(x, sigma):
        usable = end - min_len + 1
        if usable <= 0:
            continue
        through = value[:, :usable] + gain[:usable]
        at = through.argmax(axis=1)
        value[:, end] = through[rows, at] - prices
        number[:, end] = number[rows, at] + 1
    return value, number[:, -1]


def _find_price(x: np.ndarray, sigma: float, n_segments: int, min_len: int) -> tuple[float, np.ndarray] | None:
    """The price whose bound for ``n_segments`` is least, as near as the passes come, and its best values up to every end."""
    n = len(x)
    # At these prices the fewest and the most segments are best: all values lie between 0 and n.
    outer = [n + 1.0, -(n + 1.0)]
    grid = [1.0, 0.5, 0.25, 0.1, 0.02, 0.0]
    if n > 2 * BEGINNING:
        near = _find_price(x[:BEGINNING], sigma, max(1, n_segments * BEGINNING // n), min_len)
        if near is not None:
            grid = [near[0] + w * max(abs(near[0]), 0.01) for w in (0.3, 0.06, 0.01, -0.01, -0.06, -0.3)]
    prices, high, low, best = [*outer, *grid], None, None, None
    for _ in range(PASSES):
        value, number = _priced(x, sigma, np.array(prices), min_len)
        if not np.isfinite(value[:, -1]).all():
            return None
        for p, v, k in zip(prices, value, number.tolist(), strict=True):
            if best is None or v[-1] + p * n_segments < best[0]:
                best = (v[-1] + p * n_segments, p, v.copy())
            if k == n_segments:
                return p, v.copy()
            if k < n_segments and (high is None or p < high[0]):
                high = (p, k, v[-1] + p * k)
            if k > n_segments and (low is None or p > low[0]):
                low = (p, k, v[-1] + p * k)
        if high is None or low is None:
            break
        # Where the line through both neighbours is a side of the hull, no price has a lower bound.
        slope = (low[2] - high[2]) / (low[1] - high[1])
        if best[0] <= high[2] + slope * (n_segments - high[1]) + ROUNDING * (1.0 + abs(best[0])) or not low[0] < high[0]:
            break
        inner = np.linspace(low[0], high[0], PRICES + 1)[1:-1].tolist()
        prices = [slope, *inner] if low[0] < slope < high[0] else inner
    return best[1], best[2]


def _spans(x: np.ndarray, sigma: float, price: float, before: np.ndarray, after: np.ndarray, slack: float, min_len: int):
    """Starts and gains, by end, of the segments through which the bound falls by at most ``slack``; None if they are too many."""
    least = before[-1] - slack
    kept, count = {}, 0
    for end, gain in gains(x, sigma):
        usable = end - min_len + 1
        if usable <= 0 or before[end] + after[end] < least:
            continue
        at = np.flatnonzero(before[:usable] + gain[:usable] >= least + price - after[end])
        if len(at):
            kept[end] = (at, gain[at])
            count += len(at)
            if count > KEPT_SPANS:
                return None
    return kept


def _by_number(spans: dict, n: int, n_segments: int) -> tuple[float, list[int]] | None:
    """(best value, starts) of ``n_segments`` of the given segments, of equal ones the first; None if the table would be too large."""
    far = n + 1
    fewest, most = np.full(n + 1, far), np.full(n + 1, -far)
    fewest[0] = most[0] = 0
    for end, (at, _) in spans.items():
        fewest[end], most[end] = fewest[at].min() + 1, most[at].max() + 1
    fewest_on, most_on = np.full(n + 1, far), np.full(n + 1, -far)
    fewest_on[n] = most_on[n] = 0
    for end, (at, _) in reversed(spans.items()):
        fewest_on[at] = np.minimum(fewest_on[at], fewest_on[end] + 1)
        most_on[at] = np.maximum(most_on[at], most_on[end] + 1)
    first = np.maximum(fewest, n_segments - most_on)
    last = np.minimum(most, n_segments - fewest_on)
    if np.maximum(last - first + 1, 0).sum() > KEPT_VALUES:
        return None
    values, origins = {0: np.zeros(1)}, {}
    for end, (at, gain) in spans.items():
        low, high = int(first[end]), int(last[end])
        if low > high:
            continue
        value, origin = np.full(high - low + 1, -np.inf), np.full(high - low + 1, -1, np.int32)
        for start, g in zip(at.tolist(), gain.tolist(), strict=True):
            if start not in values:
                continue
            a, b = max(low, int(first[start]) + 1), min(high, int(last[start]) + 1)
            if a > b:
                continue
            through = values[start][a - 1 - int(first[start]) : b - int(first[start])] + g
            own = slice(a - low, b - low + 1)
            better = through > value[own]
            value[own][better] = through[better]
            origin[own][better] = start
        values[end], origins[end] = value, origin
    if n not in origins or not first[n] <= n_segments <= last[n] or not np.isfinite(values[n][n_segments - first[n]]):
        return -np.inf, []
    starts, end = [], n
    for k in range(n_segments, 0, -1):
        end = int(origins[end][k - first[end]])
        starts.append(end)
    return float(values[n][n_segments - first[n]]), starts[::-1]


def priced_cuts(x: np.ndarray, sigma: float, n_segments: int, min_len: int = 1) -> list[int] | None:
    """Starts of the segments that maximize the sum of kernel mass over length, or None.

    The result is that of the full recursion, whose ties and roundings included: every segment of a path that comes within
    the rounding of the best one is kept. None if too many are (of equal vectors all cuts are alike) or values are not finite.
    Time is quadratic, whatever the number of segments.
    """
    if n_segments == 1:
        return [0]
    n = len(x)
    found = _find_price(x, sigma, n_segments, min_len)
    if found is None:
        return None
    price, before = found
    after = _priced(x[::-1], sigma, np.array([price]), min_len)[0][0][::-1]
    bound = before[-1] + price * n_segments
    rounding = ROUNDING * (1.0 + abs(bound) + abs(price) * n_segments)
    slack = rounding + 2.0 / n
    while True:
        spans = _spans(x, sigma, price, before, after, slack, min_len)
        solved = None if spans is None else _by_number(spans, n, n_segments)
        if solved is None:
            return None
        value, starts = solved
        if bound - value + rounding <= slack:
            return starts
        slack = 8.0 * slack if value == -np.inf else min(8.0 * slack, bound - value + 2.0 * rounding)
