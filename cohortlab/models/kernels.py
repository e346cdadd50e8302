"""Per-task statistics of the regression models, and their update steps.

A model is a small object. ``local`` turns the rows of one batch into a vector
of sums; the vectors of all tasks are added by Spark; ``advance`` takes the
total and moves the coefficients. Nothing here sees more than a batch of rows
or one vector of sums.
"""

from __future__ import annotations

import math

import numpy as np

ALIAS_TOL = 1e-9
#: Log dispersion from which a settled count model is reported as at the Poisson boundary.
POISSON_FROM = 10.0


def independent_columns(gram: np.ndarray, tol: float = ALIAS_TOL) -> list[int]:
    """Columns not spanned by earlier ones, read off their cross products."""
    scale = np.sqrt(np.clip(np.diag(gram), 0, None))
    kept: list[int] = []
    rows: list[np.ndarray] = []
    g = gram / np.outer(np.where(scale > 0, scale, 1.0), np.where(scale > 0, scale, 1.0))
    for j in range(len(g)):
        if scale[j] == 0 or not np.isfinite(scale[j]):
            continue
        w = np.array([g[j, k] for k in kept])
        coef = []
        for i, row in enumerate(rows):
            coef.append((w[i] - np.dot(coef, row[: len(coef)])) / row[i])
        left = g[j, j] - float(np.dot(coef, coef)) if coef else g[j, j]
        if left > tol:
            kept.append(j)
            rows.append(np.array([*coef, math.sqrt(left)]))
    return kept


def scaled_inverse(gram: np.ndarray) -> np.ndarray:
    d = 1.0 / np.sqrt(np.clip(np.diag(gram), 1e-300, None))
    return np.linalg.pinv(gram * np.outer(d, d), hermitian=True) * np.outer(d, d)


#: Logarithm of the least mean that a deviance tells from zero.
LEAST_LOG = math.log(1e-300)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


#: Counts up to which tables by count are laid out for a block.
TABLED = 4096


# plain tables: tasks get the kernels by value, and wrappers of functools travel by name only
_FACTORIALS: dict[int, np.ndarray] = {}


def log_factorials(n: int) -> np.ndarray:
    if n not in _FACTORIALS:
        _FACTORIALS[n] = log_gamma(np.arange(n) + 1.0)
    return _FACTORIALS[n]


def count_mean(eta: np.ndarray) -> np.ndarray:
    """exp within the range of doubles, in fitting and scoring alike."""
    return np.exp(np.clip(eta, -700, 700))


#: Magnitude from which sums and products of base columns are looked at row by row.
HUGE = 1e100
#: Matrices of a block that are held at once; models of one design follow each other.
HELD = 4


_USED: dict[tuple, tuple[frozenset, bool]] = {}


def used_columns(columns) -> tuple[frozenset, bool]:
    """The base columns behind these products, and whether all are of three columns at most."""
    if columns not in _USED:
        if len(_USED) >= 4096:
            _USED.clear()
        _USED[columns] = frozenset(i for idx in columns for i in idx), all(len(idx) <= 3 for idx in columns)
    return _USED[columns]


def products(columns, base, n: int) -> np.ndarray:
    out = np.empty((len(columns), n))
    for j, idx in enumerate(columns):
        if len(idx) > 1:
            np.multiply(base[idx[0]], base[idx[1]], out=out[j])
        else:
            out[j] = base[idx[0]] if idx else 1.0
        for i in idx[2:]:
            out[j] *= base[i]
    return out


class Block:
    """One batch of the design table; design rows are built once per term set."""

    def __init__(self, base, outcomes):
        self.base = base  # arrays of the base columns
        self.outcomes = outcomes  # outcome column -> array
        self.built = {}
        self.kept = {}
        self.holes = None

    def once(self, key, make):
        """Something small of this block that several models need."""
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    def held(self, key, make):
        """A matrix that the next models may need; older ones go."""
        if key not in self.built:
            if len(self.built) >= HELD:
                del self.built[next(iter(self.built))]
            self.built[key] = make()
        return self.built[key]

    def incomplete(self, columns) -> list[int] | None:
        """The base columns with unknown values among those used; None where numbers are so large
        that only the products themselves tell."""
        if self.holes is None:
            self.holes, self.huge = {}, set()
            for i, c in enumerate(self.base):
                least, most = (c.min(), c.max()) if len(c) else (0.0, 0.0)
                if not (np.isfinite(least) and np.isfinite(most)):
                    ok = self.holes[i] = np.isfinite(c)
                    least, most = (f(c, initial=0.0, where=ok) for f in (np.min, np.max))
                if max(-least, most) >= HUGE:
                    self.huge.add(i)
        used, short = used_columns(columns)
        return sorted(used & self.holes.keys()) if short and not used & self.huge else None

    def design(self, columns):
        """Design as (columns x rows) and which rows are complete."""
        columns = tuple(columns)

        def make():
            n = len(next(iter(self.outcomes.values())))
            out, holes = products(columns, self.base, n), self.incomplete(columns)
            if holes is None:
                return out, np.isfinite(out.sum(axis=0))
            ok = np.ones(n, bool)
            for i in holes:
                ok &= self.holes[i]
            return out, ok

        return self.held(columns, make)

    def rows(self, columns, y, outcome):
        """Complete rows: design as (columns x rows), the outcome, and a name for those rows or None."""
        values = self.once(("values", y, outcome), lambda: outcome(self.outcomes[y]))
        holes = self.incomplete(columns)
        if holes is None:
            a, ok = self.design(columns)
            ok = ok & np.isfinite(values)
            return a[:, ok], values[ok], None

        def complete():
            ok = np.isfinite(values)
            for i in holes:
                ok &= self.holes[i]
            name = ok.tobytes()  # rows known for several reasons are the same rows
            if ok.all():
                return name, dict(enumerate(self.base)), None, values
            return name, self.once(name, dict), (at := np.flatnonzero(ok)), values[at]

        name, base, at, values = self.once(("rows", y, outcome, *holes), complete)
        if at is not None:
            for i in used_columns(columns)[0]:
                if i not in base:
                    base[i] = self.base[i][at]
        return self.held((name, columns), lambda: products(columns, base, len(values))), values, (y, outcome, name)


#: Room for one weighted design, used again by the next.
_ROOM = [np.empty(0)]


def weighted_products(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cross products of columns under weights that are not negative, half of them formed."""
    if len(_ROOM[0]) < a.size:
        _ROOM[0] = np.empty(a.size)
    b = np.multiply(a, np.sqrt(w), out=_ROOM[0][: a.size].reshape(a.shape))
    return b @ b.T


class Model:
    """Shared bookkeeping; subclasses say what to add up and how to move."""

    max_rounds = 25
    tol = 1e-10

    def __init__(self, labels, columns, y):
        self.labels = list(labels)
        self.columns = [tuple(c) for c in columns]  # base column indices to multiply
        self.y = y
        self.keep = list(range(len(columns)))
        self.beta = None
        self.cov = None
        self.n = 0.0
        self.rounds = 0
        self.done = False
        self.converged = False
        self.boundary = False

    @property
    def status(self) -> str:
        """How the fit ended; `max_rounds` bounds the scans of one sweep."""
        if self.boundary:
            return "Poisson boundary"
        return "converged" if self.converged else "stopped early"

    @staticmethod
    def outcome(y: np.ndarray) -> np.ndarray:
        """The modelled outcome; NaN leaves a row out."""
        return y

    def terms(self) -> tuple:
        """The products of base columns behind the design that is left."""
        return tuple(map(self.columns.__getitem__, self.keep))

    def rows(self, block: Block):
        """Complete cases: design as (columns x rows), the outcome, and a name for them or None."""
        # models of one design and outcome share their rows
        return block.rows(self.terms(), self.y, self.outcome)

    def size(self) -> int:
        p = len(self.keep)
        return 2 + p + p * p

    def pack(self, n, value, score, info) -> np.ndarray:
        return np.concatenate([[n, value], score, info.ravel()])

    def unpack(self, total):
        p = len(self.keep)
        return total[0], total[1], total[2 : 2 + p], total[2 + p :].reshape(p, p)

    def drop_aliased(self, info, score):
        """Remove spanned columns after the first pass."""
        kept = independent_columns(info)
        self.keep = [self.keep[j] for j in kept]
        return info[np.ix_(kept, kept)], score[kept]

    def results(self):
        """(term, estimate, standard error) in design order."""
        se = np.sqrt(np.clip(np.diag(self.cov), 0, None))
        return [
            (self.labels[j], float(b), float(s)) for j, b, s in zip(self.keep, self.beta, se)
        ]


class Linear(Model):
    """Least squares from one pass of cross products."""

    def local(self, block):
        a, y, _ = self.rows(block)
        return self.pack(len(y), float(y @ y), a @ y, a @ a.T)

    def advance(self, total):
        self.n, yy, xy, info = self.unpack(total)
        info, xy = self.drop_aliased(info, xy)
        inv = scaled_inverse(info)
        self.beta = inv @ xy
        rss = max(yy - float(self.beta @ xy), 0.0)
        free = self.n - len(self.keep)
        self.cov = inv * (rss / free if free > 0 else float("nan"))
        self.done = self.converged = True


class Glm(Model):
    """Iteratively reweighted least squares with the canonical link."""

    def mean(self, eta):
        raise NotImplementedError

    def weight(self, mu):
        raise NotImplementedError

    def start(self, y):
        """First fitted means, taken from the data as in classical GLM code."""
        raise NotImplementedError

    def link(self, mu):
        raise NotImplementedError

    @staticmethod
    def facts(y):
        """What the deviance needs of the outcome alone; models of the same rows share it."""
        raise NotImplementedError

    def deviance(self, facts, mu, eta):
        raise NotImplementedError

    def misfit(self, block, y, name, mu, eta) -> float:
        facts = self.facts(y) if name is None else block.once((self.facts, *name), lambda: self.facts(y))
        return float(self.deviance(facts, mu, eta))

    def local(self, block):
        a, y, name = self.rows(block)
        if self.beta is None:
            mu = self.start(y)
            w = self.weight(mu)
            # weighted working response; its link is that of the starting mean
            score = a @ (w * self.link(mu) + (y - mu))
            return self.pack(len(y), 0.0, score, weighted_products(a, w))
        eta = self.beta @ a
        mu = self.mean(eta)
        w = self.weight(mu)
        return self.pack(len(y), self.misfit(block, y, name, mu, eta), a @ (y - mu), weighted_products(a, w))

    def advance(self, total):
        self.n, dev, score, info = self.unpack(total)
        self.rounds += 1
        if self.beta is None:
            info, score = self.drop_aliased(info, score)
            self.beta = scaled_inverse(info) @ score
            self.last, self.prev, self.halved = float("inf"), None, 0
            return
        worse = not np.isfinite(dev) or dev > self.last * (1 + 1e-8) + 1e-8
        if worse and self.prev is not None and self.halved < 10:
            self.halved += 1
            self.beta = (self.beta + self.prev) / 2
            return
        self.cov = scaled_inverse(info)
        change = abs(dev - self.last) / (abs(dev) + 0.1)
        self.last, self.prev, self.halved = dev, self.beta, 0
        self.beta = self.beta + self.cov @ score
        self.converged = change < self.tol
        self.done = self.converged or self.rounds >= self.max_rounds


class Logistic(Glm):
    def mean(self, eta):
        out = np.maximum(eta, -700)
        np.minimum(out, 700, out=out)
        np.negative(out, out=out)
        np.exp(out, out=out)
        out += 1.0
        return np.divide(1.0, out, out=out)

    def weight(self, mu):
        out = 1 - mu
        out *= mu
        return np.maximum(out, 1e-15, out=out)

    def start(self, y):
        return (y + 0.5) / 2

    def link(self, mu):
        return np.log(mu / (1 - mu))

    @staticmethod
    def facts(y):
        return y > 0.5

    def deviance(self, facts, mu, eta):
        hit = np.where(facts, mu, 1 - mu)
        np.maximum(hit, 1e-300, out=hit)
        return -2 * np.log(hit, out=hit).sum()


class Positive(Logistic):
    """Logistic model of ``y > 0``, the zero part of a hurdle model."""

    @staticmethod
    def outcome(y):
        return np.where(np.isfinite(y), (y > 0).astype(float), y)


class Poisson(Glm):
    def mean(self, eta):
        return count_mean(eta)

    def weight(self, mu):
        return mu

    def start(self, y):
        return y + 0.1

    def link(self, mu):
        return np.log(mu)

    @staticmethod
    def facts(y):
        positive = np.maximum(y, 0)
        return positive, float((positive * np.log(np.where(y > 0, y, 1.0))).sum() - y.sum())

    def deviance(self, facts, mu, eta):
        positive, own = facts
        # the logarithm of a mean is its linear predictor
        log_mu = np.maximum(eta, LEAST_LOG)
        return 2 * (own - positive @ np.minimum(log_mu, 700, out=log_mu) + mu.sum())


#: Columns of a bias-reduced model up to which its third moments are added up.
THIRD_MOMENTS = 6
#: Rounds in which a bias-reduced model takes its leverages from the round before.
LAGGED = 12


class BiasReduced(Logistic):
    """Logistic model with the mean bias-reducing adjusted score.

    The score of a column is adjusted by its sum of leverage times (1/2 - mean), and a
    leverage needs the inverse information of all rows. In the first ``LAGGED`` rounds that
    is the one of the round before, so a scan gives a step; where the steps vanish, both
    inverses are the same and so is the solution. With separated groups such steps circle
    around the solution and never settle. A model that has not settled by then goes on with
    exact leverages. They are the contraction of the inverse with the third moments, the sums
    of weight x (1/2 - mean) times three columns: added up beside the information, they
    give the leverages of the current coefficients in the same scan. They cost the cube of
    the columns for every row, so models of more than ``THIRD_MOMENTS`` columns take two
    scans a step instead: one adds up the information and the penalised likelihood, the
    next the score. Both make the same steps.
    """

    max_rounds = 100
    lagged = LAGGED
    moved = float("inf")  # the last step in standard errors

    @property
    def in_one(self) -> bool:
        return not self.lagged and len(self.keep) <= THIRD_MOMENTS

    def size(self):
        p = len(self.keep)
        more = p * p * (p + 1) // 2 if self.beta is not None and self.in_one else 0
        return super().size() + more

    def local(self, block):
        a, y, name = self.rows(block)
        p = len(a)
        if self.beta is None:
            return super().local(block)
        eta = self.beta @ a
        mu = self.mean(eta)
        w = self.weight(mu)
        if self.in_one:
            one, other = np.triu_indices(p)
            third = (a[one] * a[other]) @ (a * (w * (0.5 - mu))).T
            first = self.pack(len(y), self.misfit(block, y, name, mu, eta), a @ (y - mu), weighted_products(a, w))
            return np.concatenate([first, third.ravel()])
        if self.wants_info and not self.lagged:
            return self.pack(len(y), self.misfit(block, y, name, mu, eta), np.zeros(p), weighted_products(a, w))
        lev = w * np.einsum("ij,ij->j", self.cov @ a, a)
        score = a @ (y - mu + lev * (0.5 - mu))
        if self.lagged:
            return self.pack(len(y), self.misfit(block, y, name, mu, eta), score, weighted_products(a, w))
        return self.pack(len(y), 0.0, score, np.zeros((p, p)))

    def advance(self, total):
        p = len(self.keep)
        basic = total[: 2 + p + p * p]
        self.n, dev, score, info = self.unpack(basic)
        self.rounds += 1
        if self.beta is None:
            info, score = self.drop_aliased(info, score)
            self.cov = scaled_inverse(info)
            self.beta = self.cov @ score
            self.wants_info, self.best, self.held, self.halved = True, -float("inf"), None, 0
            return
        if self.lagged or self.in_one or self.wants_info:
            value = -0.5 * dev + 0.5 * np.linalg.slogdet(info)[1]
            if not value >= self.best - 1e-9 * abs(self.best) and self.halved < 20:
                self.halved += 1
                self.beta = (self.beta + self.held) / 2 if self.held is not None else self.beta / 2
                return
            self.best, self.held, self.halved = value, self.beta, 0
            self.cov = scaled_inverse(info)
            if not self.lagged:
                self.wants_info = False
                if not self.in_one:
                    return
                one, other = np.triu_indices(p)
                pairs = self.cov[one, other] * np.where(one == other, 1.0, 2.0)
                score = score + pairs @ total[2 + p + p * p :].reshape(-1, p)
        step = self.cov @ score
        self.beta = self.beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        spread = np.sqrt(np.clip(np.diag(self.cov), 1e-300, None))
        before, self.moved = self.moved, float(np.abs(step / spread).max())
        # leverages of the round before are right once that round's step was short, too
        self.converged = self.moved < 1e-7 and (not self.lagged or before < 1e-5)
        # two scans make one step where the moments are too many
        self.done = self.converged or self.rounds >= self.max_rounds
        if self.rounds > LAGGED:
            self.lagged = 0
        self.wants_info = True


class TruncatedCount(Model):
    """Zero-truncated negative binomial: the count part of a hurdle model.

    Newton steps in the coefficients and the log of the dispersion together.
    """

    max_rounds = 100

    @staticmethod
    def outcome(y):
        return np.where(y > 0, y, np.nan)

    def size(self):
        if self.beta is None:
            return super().size()
        p = len(self.keep) + 1
        return 2 + p + p * p

    def unpack(self, total):
        p = len(self.keep) + (0 if self.beta is None else 1)
        return total[0], total[1], total[2 : 2 + p], total[2 + p :].reshape(p, p)

    @staticmethod
    def tabled(y):
        """Counts, each row's place among them, and the logarithms of their factorials."""
        back = y.astype(np.int64)
        top = int(back.max(initial=0))
        if top < TABLED and bool((back == y).all()):
            return np.arange(top + 1), back, log_factorials(TABLED)[: top + 1]
        counts, back = np.unique(y, return_inverse=True)
        return counts, back, log_gamma(counts + 1)

    @classmethod
    def facts(cls, y):
        """Counts, how many rows have each, and the sum of the logarithms of their factorials."""
        counts, back, factorials = cls.tabled(y)
        times = np.bincount(back, minlength=len(counts)).astype(float)
        return counts, times, float(times @ factorials)

    def local(self, block):
        a, y, name = self.rows(block)
        if self.beta is None:
            mu = y + 0.1
            return self.pack(len(y), 0.0, a @ (mu * np.log(mu) + y - mu), weighted_products(a, mu))
        th = math.exp(self.log_theta)
        eta = np.clip(self.beta @ a, -700, 700)
        mu = count_mean(eta)
        inverse = 1 / (th + mu)
        over = np.log1p(mu / th)  # log of (theta + mu) / theta, also for a very large theta
        zero = np.exp(-th * over)
        some = np.maximum(-np.expm1(-th * over), 1e-300)
        odds = zero / some
        counts, times, factorials = self.facts(y) if name is None else block.once((self.facts, *name), lambda: self.facts(y))
        # gamma(y + theta) / gamma(theta) as a product over the counts below y
        below = th + np.arange(counts[-1] if len(counts) else 0)
        upto = [np.concatenate([[0.0], np.cumsum(x)]) for x in (np.log(below / th), 1 / below, -1 / below**2)]
        rising, dg, tg = (float(times @ x[counts.astype(int)]) for x in upto)
        value = rising - factorials + y @ eta - (y + th) @ over - np.log(some).sum()
        # derivatives of the log zero probability, by the parts mu / s and theta / s of s = theta + mu
        part, rest, away = mu * inverse, th * inverse, (y - mu) * inverse
        za, zt = -th * part, part - over
        pull = odds * (1 + odds)
        ge = th * away + odds * za
        gt = dg - over.sum() - away.sum() + odds @ zt
        hee = pull * za * za - part * rest * (y + th + odds * th)
        het = part * (away - odds * part) + pull * za * zt
        htt = tg + part.sum() / th + away @ inverse + pull @ (zt * zt) + odds @ (part * part) / th
        gl, hel, hll = th * gt, th * het, th**2 * htt + th * gt
        p = len(a)
        hess = np.empty((p + 1, p + 1))
        hess[:p, :p] = -weighted_products(a, -hee) if hee.max(initial=0.0) <= 0 else (a * hee) @ a.T
        hess[:p, p] = hess[p, :p] = a @ hel
        hess[p, p] = hll
        return self.pack(len(y), float(value), np.append(a @ ge, gl), -hess)

    def advance(self, total):
        self.n, value, score, info = self.unpack(total)
        self.rounds += 1
        if self.beta is None:
            info, score = self.drop_aliased(info, score)
            self.beta = scaled_inverse(info) @ score
            self.log_theta = 0.0
            self.best, self.held, self.halved = -float("inf"), None, 0
            return
        if (not np.isfinite(value) or value < self.best - 1e-8) and self.halved < 20:
            beta, log_theta = self.held if self.held else (self.beta * 0, 0.0)
            self.halved += 1
            self.beta = (self.beta + beta) / 2
            self.log_theta = (self.log_theta + log_theta) / 2
            return
        change = abs(value - self.best) / (abs(value) + 0.1)
        self.best, self.halved = value, 0
        self.held = (self.beta, self.log_theta)
        d = np.sqrt(np.clip(np.abs(np.diag(info)), 1e-12, None))
        values, vectors = np.linalg.eigh(info / np.outer(d, d))
        usable = np.clip(np.abs(values), 1e-8, None)  # saddle-free outside the concave region
        step = (vectors @ ((vectors.T @ (score / d)) / usable)) / d
        self.cov = scaled_inverse(info)
        self.gradient = score
        step = step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-300))
        self.beta = self.beta + step[:-1]
        self.log_theta = self.log_theta + step[-1]
        settled = bool(change < 1e-11)
        # a dispersion that no longer changes the likelihood: the counts are Poisson
        self.boundary = settled and self.log_theta > POISSON_FROM
        self.converged = settled and (self.boundary or bool(values.min() > 0))
        self.done = self.converged or self.rounds >= self.max_rounds

    def results(self):
        se = np.sqrt(np.clip(np.diag(self.cov), 0, None))
        out = [(self.labels[j], float(b), float(s)) for j, b, s in zip(self.keep, self.beta, se)]
        spread = float("nan") if self.boundary else float(se[-1])
        return [*out, ("Log(theta)", float(self.log_theta), spread)]


def predict(kind: str, parts: dict, block: Block, response: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of one fitted model for a block, and which rows are complete."""

    def link(model):
        a, ok = block.design(model.terms())
        return model.beta @ a, ok

    if kind == "hurdle":
        (eta, ok), (zero, ok_zero) = link(parts["count"]), link(parts["zero"])
        theta, mu = math.exp(parts["count"].log_theta), count_mean(eta)
        positive = 1.0 / (1.0 + np.exp(-zero))
        return positive * mu / -np.expm1(-theta * np.log1p(mu / theta)), ok & ok_zero
    eta, ok = link(parts[None])
    if not response or kind == "lm":
        return eta, ok
    return (count_mean(eta) if kind == "Poisson" else 1.0 / (1.0 + np.exp(-eta))), ok
