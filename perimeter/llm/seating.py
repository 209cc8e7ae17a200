"""Tables of Chinese restaurants, drawn for many dishes at once.

A dish with n customers sits at t tables with probability in proportion to S(n, t) * a^t: S are the generalised Stirling
numbers of the discount, a is the weight of a new table. A draw from that law seats all n customers of a dish
anew, so it is a Gibbs move for the whole dish, whatever its size.

Up to `EXACT` customers the numbers come from their recursion. Beyond, t tables whose sizes follow
(1 - (1 - z)^discount) add up to n with a probability that the saddle point gives, corrected by its error at `EXACT` customers;
from about `FEW` tables on the law is close to a normal one around its greatest value. Work per dish is bounded.

All random numbers are hashes of the dish and the move, so re-run tasks repeat them."""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np

EXACT, FEW, WIDTHS = 256, 40, (2, 4, 8, 16, 32, 96)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(h: np.ndarray, step: int) -> np.ndarray:
    return ((mix(h ^ mix(np.full(1, step, np.uint64))) >> np.uint64(11)) + 0.5) * 2.0 ** -53


def normal(h: np.ndarray, step: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(h, 2 * step))) * np.cos(2 * np.pi * uniform(h, 2 * step + 1))


def gamma(shape: np.ndarray, h: np.ndarray, step: int) -> np.ndarray:
    """Gamma variables by the cube of a normal one (for shapes below 1, of shape + 1 and a power)."""
    k = np.where(shape < 1, shape + 1, shape)
    x = k * np.maximum(1e-9, 1 - 1 / (9 * k) + normal(h, step) / (3 * np.sqrt(k))) ** 3
    return np.where(shape < 1, x * uniform(h, 1_000_000 + step) ** (1 / np.maximum(shape, 1e-9)), x)


class Law:
    """Log weights of table counts for one discount (between 0 and 1)."""

    def __init__(self, discount: float) -> None:
        d = self.discount = discount
        log = np.full((EXACT + 1, EXACT + 1), -np.inf)
        log[1, 1] = 0
        for n in range(1, EXACT):
            t = np.arange(1, n + 1)
            log[n + 1, 1:n + 1] = log[n, 1:n + 1] + np.log(n - d * t)
            log[n + 1, 2:n + 2] = np.logaddexp(log[n + 1, 2:n + 2], log[n, 1:n + 1])
        self.most = WIDTHS[-1]
        self.rows = log[:, 1:self.most + 1]
        # Mean size of a table against the saddle point.
        y = -np.geomspace(600, 1e-6, 20_000)
        z = np.log(-np.expm1(y))
        self._mean, self._y = (np.log(d) + z + (d - 1) * y - np.log(-np.expm1(d * y)))[::-1], y[::-1]
        self._tables = np.arange(1, self.most + 1)
        self._fixed = np.array([-lgamma(t + 1) - t * np.log(d) for t in self._tables])
        self._error = self.rows[EXACT] - self._saddle(np.array([EXACT]))[0]

    def _at(self, mean: np.ndarray) -> np.ndarray:
        """Log of the saddle point for a mean table size."""
        return np.interp(np.log(mean), self._mean, self._y)

    def _spread(self, mean: np.ndarray, y: np.ndarray) -> np.ndarray:
        return mean * (1 + (1 - self.discount) * np.expm1(-y) - mean)

    def _saddle(self, n: np.ndarray) -> np.ndarray:
        mean = n[:, None] / self._tables
        y = self._at(mean)
        return (self._fixed + self._tables * np.log(-np.expm1(self.discount * y)) - n[:, None] * np.log(-np.expm1(y))
                - 0.5 * np.log(2 * np.pi * self._tables * np.maximum(self._spread(mean, y), 1e-12)))

    def weights(self, n: np.ndarray, width: int) -> np.ndarray:
        """Log S(n, t) for t from 1 to `width`, up to a number per n."""
        out = self.rows[np.minimum(n, EXACT), :width]
        big = n > EXACT
        if big.any():
            out[big] = (self._saddle(n[big]) + self._error)[:, :width]
        return out

    def draw(self, n: np.ndarray, log_a: np.ndarray, h: np.ndarray, step: int) -> np.ndarray:
        """Tables of dishes with n customers, weight exp(log_a) of a new table and hash h."""
        out = np.minimum(n, 1)
        many = np.flatnonzero(n > 1)
        u, small = uniform(h[many], 3 * step), np.ones(len(many), bool)
        large = np.flatnonzero(n[many] > self.most)
        if len(large):
            at = many[large]
            t, sd = self._mode(n[at].astype(float), log_a[at])
            lie = t >= FEW
            small[large[lie]] = False
            x = np.rint(t + sd * normal(h[at], 3 * step + 1))[lie]
            out[at[lie]] = np.clip(x, 1, n[at[lie]])
        low = 1
        for width in WIDTHS:
            pick = np.flatnonzero(small & (n[many] > low) & ((n[many] <= width) | (width == self.most)))
            for some in np.array_split(pick, 1 + len(pick) * width // 2_000_000):
                at = many[some]
                w = self.weights(n[at], width) + log_a[at][:, None] * self._tables[:width]
                w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
                out[at] = np.minimum(1 + (w < (u[some] * w[:, -1])[:, None]).sum(axis=1), n[at])
            low = width
        return out

    def _mode(self, n: np.ndarray, log_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centre and deviation of the law, by halving the range of log t."""
        low, high = np.zeros(len(n)), np.log(n)
        for _ in range(30):
            mid = (low + high) / 2
            t = np.exp(mid)
            more = log_a - np.log(self.discount) - np.log(t + 0.5) + np.log(-np.expm1(self.discount * self._at(n / t))) > 0
            low, high = np.where(more, mid, low), np.where(more, high, mid)
        t = np.exp(low)
        mean = n / t
        y = self._at(mean)
        var = 1 / (1 / t + mean ** 2 / (t * np.maximum(self._spread(mean, y), 1e-12)))
        return t + 0.5 * var / (1 - self.discount) / t, np.sqrt(var)


@lru_cache(4)
def law(discount: float) -> Law:
    return Law(discount)
