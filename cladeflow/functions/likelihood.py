"""Likelihoods of insertions into a reference tree, in numpy.

``Reference`` holds, for every edge, the conditional likelihoods of the reference alignment seen from either
end. A sequence inserted on an edge of length e at distance d from the lower end, on a pendant edge of length
p, has the likelihood  sum_k w_k sum_x pi_x [P(d r_k) lower]_x [P((e-d) r_k) upper]_x [P(p r_k) tip]_x  at a
site. Sites are scaled by their largest entry at each step, the logarithms being kept, so no tree underflows.
"""

from __future__ import annotations

import numpy as np

from cladeflow.functions.models import AMINO_ACIDS, Model
from cladeflow.functions.sites import NUCLEOTIDES
from cladeflow.functions.trees import DEFAULT_LENGTH, Tree

# Fixed value: amino acid symbols of lookups; B and Z stand for two acids each, X and the gap for any.
PROTEIN_SYMBOLS = "ACDEFGHIKLMNPQRSTVWY-XBZ"
SHORTEST, LONGEST, USUAL = 1e-4, 100.0, 0.1
SMOOTHINGS, TOLERANCE = 32, 0.1
SECTIONS = 7


def alphabet(states: int) -> str:
    return NUCLEOTIDES if states == 4 else PROTEIN_SYMBOLS


def tip_table(states: int) -> np.ndarray:
    """(symbol, state): which states each symbol may stand for."""
    if states == 4:
        codes = np.arange(16)
        codes[0] = 15
        return np.stack([(codes >> b) & 1 for b in (3, 2, 1, 0)], axis=1).astype(float)
    sets = {"-": AMINO_ACIDS, "X": AMINO_ACIDS, "B": "DN", "Z": "EQ"}
    return np.array([[float(a in sets.get(c, c)) for a in AMINO_ACIDS] for c in PROTEIN_SYMBOLS])


def symbol_codes(states: int) -> np.ndarray:
    """Symbol number of every byte, after normalisation; 255 where there is none."""
    table = np.full(256, 255, np.uint8)
    for k, c in enumerate(alphabet(states)):
        table[[ord(c), ord(c.lower())]] = k
    gaps = "?XO." if states == 4 else "?"
    for c in gaps:
        table[[ord(c), ord(c.lower())]] = alphabet(states).index("-")
    if states == 4:
        table[[ord("U"), ord("u")]] = NUCLEOTIDES.index("T")
    return table


def encode(sequences: list[str], states: int) -> np.ndarray:
    """(sequence, site) symbol numbers; raises ValueError on other symbols or widths."""
    if len({len(s) for s in sequences}) > 1:
        raise ValueError("sequences differ in width")
    data = np.frombuffer("".join(sequences).encode("latin-1", "replace"), np.uint8)
    codes = symbol_codes(states)[data].reshape(len(sequences), -1) if sequences else np.zeros((0, 0), np.uint8)
    if (codes == 255).any():
        raise ValueError("a sequence holds an unknown symbol")
    return codes


def valid_sites(codes: np.ndarray, states: int) -> np.ndarray:
    """(sequence, site) mask of what lies between the first and the last symbol that is no gap."""
    solid = codes != alphabet(states).index("-")
    return np.logical_or.accumulate(solid, axis=1) & np.logical_or.accumulate(solid[:, ::-1], axis=1)[:, ::-1]


class Search:
    """One edge as ``Reference.thorough`` sees it: its grid, shares of the edge by pendant lengths, and the likelihoods
    of the rest of the tree from any place on it."""

    def __init__(self, reference: Reference, edge: int):
        n_cat = len(reference.rates)
        self.site_logs = reference._site_logs
        self.vectors, inverse, self.turn = reference._blocks()
        self.lower = reference.lower[edge].reshape(reference.width, -1) @ inverse.T
        self.upper = reference.upper[edge].reshape(reference.width, -1) @ inverse.T
        self.scale, self.length = reference.scale[edge], float(reference.lengths[edge])
        self.table = tip_table(reference.states)
        self.tips = np.tile(self.table @ reference.inverse.T, n_cat)
        self.shared = reference._shared(self.table)
        self.weight = np.repeat(reference.weights, reference.states) * np.tile(reference.freqs, n_cat)
        self.first = min(SHORTEST / 2, self.length / 2)
        self.last = self.length - self.first / 10
        self.places = self.first + (self.length - 2 * self.first) * np.linspace(0, 1, 7)
        self.pendants = np.append(DEFAULT_LENGTH, np.geomspace(SHORTEST, 3.0, 13))
        self.gap = (self.length - 2 * self.first) / 6

    def middle(self, distal: np.ndarray) -> np.ndarray:
        """(place, site, state) likelihoods of the rest of the tree at places on the edge."""
        a = np.exp(distal[:, None] * self.turn)[:, None, :] * self.lower
        b = np.exp((self.length - distal)[:, None] * self.turn)[:, None, :] * self.upper
        size = self.vectors.shape[0]
        a, b = a.reshape(-1, size) @ self.vectors.T, b.reshape(-1, size) @ self.vectors.T
        return ((a * b * self.weight) @ self.vectors).reshape(len(distal), -1, size)

    def logs(self, places: np.ndarray, pendants: np.ndarray, symbols: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(site, symbol, place, pendant) log-likelihoods."""
        at_tip = np.exp(pendants[:, None] * self.turn)[:, None, :] * self.tips[symbols]
        likelihood = np.einsum("dsk,pck->scdp", self.middle(places), at_tip, optimize=True)
        return self.site_logs(likelihood, self.scale[:, None, None, None], self.shared[:, symbols, None, None])


class Reference:
    """Tree, model and alignment ready for insertions. sequences: sites by tip label; conditionals: whether they are
    computed, or only given room to be filled from a store."""

    def __init__(self, tree: Tree, model: Model, sequences: dict[str, str], conditionals: bool = True):
        missing = [t.label for t in tree.tips if t.label not in sequences]
        if missing:
            raise ValueError("tips without a sequence: " + ", ".join(sorted(missing)))
        self.tree, states = tree, model.states
        codes = encode([sequences[t.label] for t in tree.tips], states)
        table = tip_table(states)
        if model.freqs is None:
            weights = table / table.sum(1, keepdims=True)
            counts = np.bincount(codes.ravel(), minlength=len(table)).astype(float)
            model = model.with_freqs(list(counts @ weights))
        self.model, self.states, self.width = model, states, codes.shape[1]
        self.freqs = np.array(model.freqs)
        self.rates = np.array(model.cat_rates) / (1 - model.pinv)
        self.weights = np.array(model.cat_weights)
        self.values, self.vectors, self.inverse = model.eigen()
        self.tips = {t.number: table[codes[k]] for k, t in enumerate(tree.tips)}
        self.lengths = np.array([n.length for n in tree.edges])
        same = np.ones((self.width, states))
        for k in range(len(tree.tips)):
            same *= table[codes[k]]
        self.invariant = (same * self.freqs).sum(1) if model.pinv else np.zeros(self.width)
        if conditionals:
            self._conditionals()
        else:
            shape = (tree.n_edges, self.width, len(self.rates), states)
            self.lower, self.upper, self.scale = np.empty(shape), np.empty(shape), np.empty(shape[:2])

    def transitions(self, length: np.ndarray | float) -> np.ndarray:
        """(..., category, state, state) of the given lengths."""
        exponent = np.exp(np.asarray(length, float)[..., None, None] * self.rates[:, None] * self.values)
        return np.einsum("ij,...kj,jl->...kil", self.vectors, exponent, self.inverse)

    def _along(self, node: int, partial: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.einsum("kij,skj->ski", self.transitions(self.lengths[node]), partial[0])

    def _join(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Product of likelihoods, with the scale of each site."""
        product, scale = parts[0]
        for p, s in parts[1:]:
            product, scale = product * p, scale + s
        top = product.max(axis=(1, 2), keepdims=True)
        top[top == 0] = 1
        return product / top, scale + np.log(top[:, 0, 0])

    def _conditionals(self) -> None:
        """lower: seen from each edge's lower end downwards; upper: from its upper end upwards."""
        none = np.zeros(self.width)
        n_cat = len(self.rates)
        lower: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for node in self.tree.edges:
            if node.children:
                parts = [(self._along(c.number, lower[c.number]), lower[c.number][1]) for c in node.children]
                lower[node.number] = self._join(parts)
            else:
                tip = np.repeat(self.tips[node.number][:, None, :], n_cat, axis=1)
                lower[node.number] = (tip, none)
        upper: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for node in [self.tree.top, *reversed(self.tree.edges)]:
            for child in node.children:
                parts = [(self._along(c.number, lower[c.number]), lower[c.number][1]) for c in node.children if c is not child]
                if node is not self.tree.top:
                    parts.append((self._along(node.number, upper[node.number]), upper[node.number][1]))
                upper[child.number] = self._join(parts)
        self.lower = np.array([lower[e][0] for e in range(self.tree.n_edges)])
        self.upper = np.array([upper[e][0] for e in range(self.tree.n_edges)])
        self.scale = np.array([lower[e][1] + upper[e][1] for e in range(self.tree.n_edges)])

    def _site_logs(self, likelihood: np.ndarray, scale: np.ndarray, invariant: np.ndarray) -> np.ndarray:
        """Logarithms of site likelihoods. Rounding may leave tiny numbers below zero; others mean a broken model."""
        if not (likelihood > -1e-9).all():
            raise ValueError("a likelihood is negative or no number: the model is broken")
        if self.model.pinv:
            p = self.model.pinv
            constant = np.where(invariant > 0, np.log(np.maximum(p * invariant, 1e-300)), -np.inf)
            return np.logaddexp(np.log((1 - p) * np.maximum(likelihood, 1e-300)) + scale, constant)
        return np.log(np.maximum(likelihood, 1e-300)) + scale

    def tree_logl(self, edge: int = 0) -> float:
        """Log-likelihood of the tree, computed at an edge; it is the same at all of them."""
        moved = np.einsum("kij,skj->ski", self.transitions(self.lengths[edge]), self.lower[edge])
        sites = np.einsum("k,i,ski,ski->s", self.weights, self.freqs, moved, self.upper[edge])
        if not self.model.pinv and (sites <= 0).any():
            raise ValueError("a site of the reference alignment is impossible under the model")
        return float(self._site_logs(sites, self.scale[edge], self.invariant).sum())

    def lookup(self) -> np.ndarray:
        """(site, symbol, edge) log-likelihoods of a symbol in the middle of an edge, on a pendant edge of usual length."""
        pendant = self.transitions(DEFAULT_LENGTH)
        table = tip_table(self.states)
        at_tip = np.einsum("kij,cj->kci", pendant, table)
        out = np.empty((self.width, len(table), self.tree.n_edges), np.float64)
        for e in range(self.tree.n_edges):
            half = self.transitions(self.lengths[e] / 2)
            middle = np.einsum("kij,skj->ski", half, self.lower[e]) * np.einsum("kij,skj->ski", half, self.upper[e])
            sites = np.einsum("k,i,ski,kci->sc", self.weights, self.freqs, middle, at_tip)
            invariant = (self.invariant[:, None] > 0) * self._shared(table)
            out[:, :, e] = self._site_logs(sites, self.scale[e][:, None], invariant)
        return out

    def _shared(self, table: np.ndarray) -> np.ndarray:
        """(site, symbol) frequency of the states that a site's constant column and a symbol share."""
        same = np.ones((self.width, self.states))
        for tip in self.tips.values():
            same = same * tip
        return (same * self.freqs) @ table.T

    def _blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvectors and inverse of all categories as one matrix, and the exponents of a unit of length."""
        n = len(self.rates)
        return np.kron(np.eye(n), self.vectors), np.kron(np.eye(n), self.inverse), np.outer(self.rates, self.values).ravel()

    def search(self, edge: int) -> Search:
        return Search(self, edge)

    def thorough(self, edge: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logl, distal, pendant) at the best place on an edge, of several sequences at once.

        All sequences are scored on a small grid of places by one matrix product; from its best point the
        pendant length is improved by Newton's method and the distal length by golden section, in turns,
        until the log-likelihood gains less than ``TOLERANCE``; a turn that makes it worse is undone.
        """
        search = self.search(edge)
        table, mask, turn = search.table, valid_sites(codes, self.states), search.turn
        n = len(codes)
        scale, length, edge_of, middle = search.scale, search.length, search.first, search.middle
        places, pendants, gap = search.places, search.pendants, search.gap
        tips = search.tips[codes]  # in the basis of the eigenvectors
        shared = search.shared
        invariant = np.take_along_axis(shared, codes.astype(np.int64).T, axis=1).T if self.model.pinv else None

        def logl(summed: np.ndarray, pendant: np.ndarray, own: np.ndarray) -> np.ndarray:
            sites = np.einsum("nsk,nk->ns", summed, np.exp(pendant[:, None] * turn))
            logs = self._site_logs(sites, scale, None if invariant is None else invariant[own])
            return np.where(mask[own], logs, 0.0).sum(axis=1)

        def score(distal: np.ndarray, pendant: np.ndarray, own: np.ndarray) -> np.ndarray:
            return logl(middle(distal) * tips[own], pendant, own)

        logs = search.logs(places, pendants)
        hot = np.zeros((n, self.width, len(table)))
        np.put_along_axis(hot, codes[:, :, None].astype(np.int64), 1.0, axis=2)
        hot *= mask[:, :, None]
        found = (hot.reshape(n, -1) @ logs.reshape(self.width * len(table), -1)).argmax(axis=1)
        distal, pendant = places[found // len(pendants)], pendants[found % len(pendants)]
        every = np.arange(n)
        best, own = score(distal, pendant, every), every
        for _ in range(SMOOTHINGS):
            summed = middle(distal[own]) * tips[own]
            new_pendant = self._newton(summed, pendant[own], mask[own], turn, scale, None if invariant is None else invariant[own])
            low = np.maximum(distal[own] - gap, edge_of)
            high = np.minimum(distal[own] + gap, search.last)
            golden = (5**0.5 - 1) / 2
            x1, x2 = high - golden * (high - low), low + golden * (high - low)
            f1, f2 = score(x1, new_pendant, own), score(x2, new_pendant, own)
            for _ in range(SECTIONS):
                left = f1 > f2
                low, high = np.where(left, low, x1), np.where(left, x2, high)
                fresh = np.where(left, high - golden * (high - low), low + golden * (high - low))
                f = score(fresh, new_pendant, own)
                x1, x2, f1, f2 = (
                    np.where(left, fresh, x2),
                    np.where(left, x1, fresh),
                    np.where(left, f, f2),
                    np.where(left, f1, f),
                )
            new_distal, now = np.where(f1 > f2, x1, x2), np.maximum(f1, f2)
            # the middle that was there before may still be the better one
            stay = logl(summed, new_pendant, own)
            new_distal, now = np.where(stay >= now, distal[own], new_distal), np.maximum(stay, now)
            gain = now - best[own]
            better = gain > 0
            distal[own[better]], pendant[own[better]], best[own[better]] = new_distal[better], new_pendant[better], now[better]
            own = own[better & (gain >= TOLERANCE)]
            if not len(own):
                break
        return best, distal, pendant

    def _newton(self, summed, start, mask, turn, scale, invariant) -> np.ndarray:
        """Best pendant lengths, by Newton's method kept within a bracket of the derivative's sign."""
        x = np.where((start < SHORTEST) | (start > LONGEST), USUAL, start)
        low, high = np.full(len(x), SHORTEST), np.full(len(x), LONGEST)
        live = np.arange(len(x))
        for _ in range(30):
            part = np.exp(x[live][:, None] * turn)
            own = summed[live]
            f = np.maximum(np.einsum("nsk,nk->ns", own, part), 1e-300)
            d1, d2 = np.einsum("nsk,nk->ns", own, part * turn), np.einsum("nsk,nk->ns", own, part * turn * turn)
            if invariant is not None:
                p = self.model.pinv
                f = (1 - p) * f + p * invariant[live] * np.exp(-scale)
                d1, d2 = (1 - p) * d1, (1 - p) * d2
            slope = np.where(mask[live], d1 / f, 0).sum(axis=1)
            bend = np.where(mask[live], d2 / f - (d1 / f) ** 2, 0).sum(axis=1)
            low[live], high[live] = np.where(slope > 0, x[live], low[live]), np.where(slope > 0, high[live], x[live])
            step = np.where(bend < 0, x[live] - slope / np.where(bend < 0, bend, 1), -1)
            inside = (step > low[live]) & (step < high[live])
            new = np.where(inside, step, np.sqrt(low[live] * high[live]))
            moved = np.abs(new - x[live]) >= np.maximum(SHORTEST / 10, 1e-3 * x[live])
            x[live] = new
            live = live[moved]
            if not len(live):
                break
        return x


class Prescorer:
    """Log-likelihoods of many sequences on all edges as one matrix product."""

    def __init__(self, lookup: np.ndarray, states: int):
        self.width, self.symbols, self.edges = lookup.shape
        self.states = states
        self.matrix = lookup.reshape(-1, self.edges)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """(sequence, edge): sums over each sequence's valid range."""
        n = len(codes)
        hot = np.zeros((n, self.width, self.symbols))
        np.put_along_axis(hot, codes[:, :, None].astype(np.int64), 1.0, axis=2)
        hot *= valid_sites(codes, self.states)[:, :, None]
        return hot.reshape(n, -1) @ self.matrix
