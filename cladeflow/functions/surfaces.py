"""The search of ``Reference.thorough`` for many sequences at once, on tables of log-likelihood surfaces.

On one edge, the log-likelihood of a sequence is a sum over its sites of functions of the place on the edge and the
pendant length, one function for each site and symbol. These functions are laid down once, as coefficients of a
product basis: combinations of Chebyshev polynomials of the logarithms of both lengths, as many of them as singular
value decompositions ask for. A matrix product with the symbols of the sequences then yields the coefficients of each
sequence's own surface, on which grid, Newton's method and golden section run as in ``Reference.thorough``, without a
loop over sites.

Nothing is left out: sequences with symbols for several states, searches that stop below the pendant length from which
the surfaces of an edge keep ``ACCURACY``, and references whose tables would not fit ``MAX_BYTES`` are scored by
``Reference.thorough`` itself.
"""

from __future__ import annotations

import numpy as np

from cladeflow.functions import likelihood as L
from cladeflow.functions.likelihood import Reference

SHORT = 0.01  # shortest pendant length of a surface
PLACES, PENDANTS = 32, 64  # nodes along an edge and along the pendant lengths
NODES = 1024  # of Newton's method, which goes on from the nearest by a Taylor series
ACCURACY = 1e-8  # of the log-likelihood of a site and symbol
RANK = 1e-7  # singular values below this are dropped
USUAL = 0.4  # below this pendant length, few searches end and less accuracy will do
COLUMNS, MAX_BYTES = 800, 64 << 20  # of an edge's tables, by reckoning; of all tables


def _terms(x: np.ndarray, n: int) -> np.ndarray:
    """(point, term) Chebyshev polynomials."""
    out = np.empty((n, len(x)))
    out[0], out[1] = 1.0, x
    twice = 2 * x
    for k in range(2, n):
        np.multiply(twice, out[k - 1], out=out[k])
        out[k] -= out[k - 2]
    return out.T


def _nodes(n: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5) / n)


def _fit(n: int) -> np.ndarray:
    """(term, node) matrix from values at the nodes to coefficients."""
    out = 2 / n * _terms(_nodes(n), n).T
    out[0] /= 2
    return out


class _Edge:
    """Grid and surface of one edge. Rows of the tables: symbol by symbol, all sites of each."""

    def __init__(self, reference: Reference, edge: int, symbols: np.ndarray):
        self.search = search = reference.search(edge)
        self.grid = self._rows(search.logs(search.places, search.pendants, symbols))
        self.low, self.high = np.log(search.first + SHORT), np.log(search.last + SHORT)
        pendants = np.exp(_center() + _half() * _nodes(PENDANTS))
        logs = search.logs(self.distal(_nodes(PLACES)), pendants, symbols)
        weight = np.minimum(1.0, (pendants / USUAL) ** 4)
        flat = (logs * weight).reshape(-1, PLACES, PENDANTS)
        up, along = self._basis(flat.swapaxes(1, 2).reshape(-1, PLACES))
        flat = np.einsum("xdp,dk->xkp", flat, up, optimize=True)
        out, outward = self._basis(flat.reshape(-1, PENDANTS))
        surface = (flat @ out).reshape(*logs.shape[:2], -1)
        self.along_basis = along
        basis = _fit(PENDANTS) @ (out / weight[:, None])
        self.shape = along.shape[1], basis.shape[1]
        self.table = self._rows(surface)
        self.basis = np.ascontiguousarray(basis)
        # first to fourth derivatives of the functions by the logarithm of the pendant length, at NODES of it
        at, derivatives = _terms(np.linspace(-1, 1, NODES), PENDANTS), []
        for k in range(1, 5):
            basis = np.polynomial.chebyshev.chebder(basis) / _half()
            derivatives.append(at[:, : len(basis)] @ basis / (1, 1, 2, 6)[k - 1])
        self.slopes = np.ascontiguousarray(np.stack(derivatives, axis=1))
        # between the nodes
        pendants = np.exp(_center() + _half() * np.linspace(-1, 1, 120))
        distal = self.distal(np.linspace(-1, 1, 50))
        want = search.logs(distal, pendants, symbols)
        surface = surface.reshape(*logs.shape[:2], *self.shape)
        got = np.einsum("dk,sckr,pr->scdp", self.along(distal), surface, self.outward(pendants) @ self.basis, optimize=True)
        bad = np.flatnonzero(~(np.abs(got - want) < ACCURACY).all(axis=(0, 1, 2)))
        self.trusted = float(pendants[bad[-1]]) if len(bad) else SHORT  # an end of a search must lie above

    @staticmethod
    def _basis(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, function) main directions of the rows, and the coefficients of their Chebyshev polynomials."""
        square = np.linalg.qr(rows, mode="r")
        _, s, v = np.linalg.svd(square)
        found = v[: int((s > RANK).sum())].T
        return found, np.ascontiguousarray(_fit(len(found)) @ found)

    @staticmethod
    def _rows(values: np.ndarray) -> np.ndarray:
        """Symbol by symbol: first a row for the sequence of the first symbol alone, then what another changes at a site."""
        rows = values.reshape(*values.shape[:2], -1).swapaxes(0, 1)
        change = np.concatenate([rows[1:-1] - rows[0], -rows[:1], rows[-1:] - rows[0]])
        return np.concatenate([rows[0].sum(axis=0)[None], change.reshape(-1, rows.shape[2])])

    def distal(self, x: np.ndarray) -> np.ndarray:
        return np.exp((self.low + self.high) / 2 + (self.high - self.low) / 2 * x) - SHORT

    def along(self, distal: np.ndarray) -> np.ndarray:
        """(place, function) of places on the edge."""
        return _terms((np.log(distal + SHORT) - (self.low + self.high) / 2) / ((self.high - self.low) / 2), PLACES) @ self.along_basis

    def outward(self, pendant: np.ndarray) -> np.ndarray:
        return _terms((np.log(pendant) - _center()) / _half(), PENDANTS)

    def newton(self, line: np.ndarray, start: np.ndarray) -> np.ndarray:
        """As ``Reference._newton``, on (sequence, function) lines; lengths below ``SHORT`` mean that a search left the surface."""
        x = start.copy()
        low, high = np.full(len(x), L.SHORTEST), np.full(len(x), L.LONGEST)
        live, own = np.arange(len(x)), line
        step_of, start_of = 2 * _half() / (NODES - 1), np.log(SHORT)
        for _ in range(30):
            at = x[live]
            far = (np.log(at) - start_of) / step_of
            node = np.rint(far).astype(np.int64)
            far = (far - node) * step_of
            c1, c2, c3, c4 = np.matmul(self.slopes[node], own[:, :, None])[:, :, 0].T
            d1 = ((c4 * far + c3) * far + c2) * far + c1
            d2 = (3 * c4 * far + 2 * c3) * far + c2
            slope, bend = d1 / at, (d2 - d1) / (at * at)
            up = slope > 0
            least, most = np.where(up, at, low[live]), np.where(up, high[live], at)
            low[live], high[live] = least, most
            step = np.where(bend < 0, at - slope / np.where(bend < 0, bend, 1), -1)
            new = np.where((step > least) & (step < most), step, np.sqrt(least * most))
            x[live] = new
            moved = (np.abs(new - at) >= np.maximum(L.SHORTEST / 10, 1e-3 * at)) & (new >= SHORT)
            if not moved.any():
                break
            live, own = live[moved], own[moved]
        return x

    def thorough(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(logl, distal, pendant, whether the search stayed on the surface) of sequences given by their symbols."""
        search, rows = self.search, hot.shape[1]
        grid = hot @ self.grid[:rows]
        found = grid.argmax(axis=1)
        best = np.take_along_axis(grid, found[:, None], axis=1)[:, 0]
        distal, pendant = search.places[found // len(search.pendants)], search.pendants[found % len(search.pendants)]
        stayed = pendant >= SHORT
        own = np.arange(len(hot))
        surface = (hot @ self.table[:rows]).reshape(len(own), *self.shape)
        gap, golden = search.gap, (5**0.5 - 1) / 2
        for _ in range(L.SMOOTHINGS):
            if not len(own):
                break
            at, start = distal[own], np.where(stayed[own], pendant[own], SHORT)
            line = np.einsum("nk,nkr->nr", self.along(at), surface)
            new_pendant = self.newton(line, start)
            on = (new_pendant > self.trusted) & stayed[own]
            stayed[own[~on]] = False
            new_pendant = np.where(on, new_pendant, SHORT)
            outward = self.outward(new_pendant) @ self.basis
            across = np.einsum("nkr,nr->nk", surface, outward)

            def score(places, across=across):
                return np.einsum("nk,nk->n", self.along(places), across)

            low, high = np.maximum(at - gap, search.first), np.minimum(at + gap, search.last)
            x1, x2 = high - golden * (high - low), low + golden * (high - low)
            f1, f2 = score(x1), score(x2)
            for _ in range(L.SECTIONS):
                left = f1 > f2
                low, high = np.where(left, low, x1), np.where(left, x2, high)
                fresh = np.where(left, high - golden * (high - low), low + golden * (high - low))
                f = score(fresh)
                x1, x2, f1, f2 = np.where(left, fresh, x2), np.where(left, x1, fresh), np.where(left, f, f2), np.where(left, f1, f)
            new_distal, now = np.where(f1 > f2, x1, x2), np.maximum(f1, f2)
            stay = np.einsum("nr,nr->n", line, outward)
            new_distal, now = np.where(stay >= now, at, new_distal), np.maximum(stay, now)
            gain = now - best[own]
            better = (gain > 0) & on
            into = own[better]
            distal[into], pendant[into], best[into] = new_distal[better], new_pendant[better], now[better]
            more = better & (gain >= L.TOLERANCE)
            own, surface = own[more], surface[more]
        return best, distal, pendant, stayed


def _center() -> float:
    return float(np.log(SHORT) + np.log(L.LONGEST)) / 2


def _half() -> float:
    return float(np.log(L.LONGEST) - np.log(SHORT)) / 2


class Surfaces:
    """Surfaces of all edges of a reference, for sequences of single states and gaps."""

    def __init__(self, reference: Reference, lookup: np.ndarray):
        states = L.tip_table(reference.states).sum(axis=1)
        gap = L.alphabet(reference.states).index("-")
        self.symbols = np.array([*np.flatnonzero(states == 1), gap])
        self.states = reference.states
        self.lookup = _Edge._rows(lookup[:, self.symbols])
        self.edges = [_Edge(reference, e, self.symbols) for e in range(reference.tree.n_edges)]
        self.nbytes = sum(e.grid.nbytes + e.table.nbytes for e in self.edges)

    @classmethod
    def of(cls, reference: Reference, lookup: np.ndarray) -> Surfaces | None:
        """None if the tables could outgrow ``MAX_BYTES``."""
        cells = reference.tree.n_edges * reference.width * (reference.states + 1)
        if cells * COLUMNS * 8 > MAX_BYTES:
            return None
        if not hasattr(reference, "surfaces"):  # a stream asks for them with every batch
            reference.surfaces = cls(reference, lookup)
        return reference.surfaces

    def hot(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sequences, their symbols by site) of those that the tables can say: without gaps, with gaps at the ends, and inside."""
        mask, gaps = L.valid_sites(codes, self.states), codes == self.symbols[-1]
        kind = np.where(gaps.any(axis=1), np.where((gaps & mask).any(axis=1), 2, 1), 0)
        plain, out = np.isin(codes, self.symbols).all(axis=1), []
        for k in range(3):
            rows = np.flatnonzero(plain & (kind == k))
            if not len(rows):
                continue
            own = codes[rows]
            hot = np.empty((len(rows), len(self.symbols) - 2 + k, codes.shape[1]))
            for i, symbol in enumerate(self.symbols[1:-1]):
                hot[:, i] = own == symbol
            if k > 0:
                hot[:, len(self.symbols) - 2] = ~mask[rows]
            if k > 1:
                hot[:, len(self.symbols) - 1] = gaps[rows] & mask[rows]
            one = np.ones((len(rows), 1))
            out.append((rows, np.concatenate([one, hot.reshape(len(rows), -1)], axis=1)))
        return out

    def prescore(self, hot: np.ndarray) -> np.ndarray:
        return hot @ self.lookup[: hot.shape[1]]
