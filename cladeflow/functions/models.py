"""Substitution models: the model string, discrete rate categories, and parameter files of other programs."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

# Which of the six exchange rates (AC AG AT CG CT GT) are equal, and whether base frequencies are.
DNA_MODELS = {
    "JC": ("000000", True),
    "F81": ("000000", False),
    "K80": ("010010", True),
    "HKY": ("010010", False),
    "TN93ef": ("010020", True),
    "TN93": ("010020", False),
    "K81": ("012210", True),
    "K81uf": ("012210", False),
    "TPM2": ("010212", True),
    "TPM2uf": ("010212", False),
    "TPM3": ("012012", True),
    "TPM3uf": ("012012", False),
    "TIM1": ("012230", True),
    "TIM1uf": ("012230", False),
    "TIM2": ("010232", True),
    "TIM2uf": ("010232", False),
    "TIM3": ("012032", True),
    "TIM3uf": ("012032", False),
    "TVMef": ("012314", True),
    "TVM": ("012314", False),
    "SYM": ("012345", True),
    "GTR": ("012345", False),
}
NUCLEOTIDES = "ACGT"
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
ALIASES = {"DNA": "GTR+G+F"}


# --- rate categories -------------------------------------------------------------------------------------


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return scale * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - scale * h


def gamma_quantile(p: float, a: float) -> float:
    """x with P(a, x) = p, by bisection on a logarithmic scale."""
    low, high = -700.0, math.log(a + 40 * math.sqrt(a) + 100)
    for _ in range(200):
        middle = (low + high) / 2
        if lower_gamma(a, math.exp(middle)) < p:
            low = middle
        else:
            high = middle
    return math.exp((low + high) / 2)


def gamma_rates(alpha: float, categories: int, mode: str = "mean") -> list[float]:
    """Rates of equally likely categories of a gamma distribution with mean 1."""
    if categories == 1:
        return [1.0]
    if mode == "median":
        rates = [gamma_quantile((2 * i + 1) / (2 * categories), alpha) / alpha for i in range(categories)]
        scale = categories / sum(rates)
        return [r * scale for r in rates]
    cuts = [gamma_quantile(i / categories, alpha) for i in range(1, categories)]
    below = [0.0, *(lower_gamma(alpha + 1, c) for c in cuts), 1.0]
    return [(b - a) * categories for a, b in zip(below[:-1], below[1:])]


# --- models ----------------------------------------------------------------------------------------------


@dataclass
class Model:
    """A reversible substitution model with its rate categories."""

    name: str
    rates: list[float]  # upper triangle, row by row
    freqs: list[float] | None  # None: to be counted in the alignment
    freq_mode: str = "model"
    pinv: float = 0.0
    pinv_mode: str = "none"
    alpha: float | None = None
    gamma_mode: str = "mean"
    cat_rates: list[float] = field(default_factory=lambda: [1.0])
    cat_weights: list[float] = field(default_factory=lambda: [1.0])
    ascertainment: str | None = None

    @property
    def states(self) -> int:
        return 20 if len(self.rates) == 190 else 4

    @property
    def categories(self) -> int:
        return len(self.cat_rates)

    def with_freqs(self, freqs: list[float]) -> Model:
        total = sum(freqs)
        return Model(**{**self.__dict__, "freqs": [f / total for f in freqs]})

    def __str__(self) -> str:
        text = f"{self.name}{_write(self.rates)}"
        if self.freq_mode == "count":
            text += "+FC"
        elif self.freqs is not None:
            text += f"+FU{_write(self.freqs)}"
        if self.pinv:
            text += f"+IU{{{self.pinv:g}}}"
        if self.alpha is not None:
            text += f"+G{self.categories}{'a' if self.gamma_mode == 'median' else 'm'}{{{self.alpha:g}}}"
        elif self.categories > 1:
            text += f"+R{self.categories}{_write(self.cat_rates)}{_write(self.cat_weights)}"
        return text

    def report(self) -> str:
        """For people."""
        lines = [f"Substitution model: {self.name}, {self.states} states", "  rates: " + " ".join(f"{r:g}" for r in self.rates)]
        lines.append("  frequencies: " + (" ".join(f"{f:g}" for f in self.freqs) if self.freqs else "counted in the alignment"))
        kind = f"gamma ({self.gamma_mode}), alpha {self.alpha:g}" if self.alpha is not None else "free" if self.categories > 1 else "none"
        lines.append(f"  rate categories: {self.categories}, {kind}; invariant share {self.pinv:g}")
        return "\n".join(lines)

    def eigen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, right vectors, their inverse) of the rate matrix, scaled to one change per unit of length."""
        n, pi = self.states, np.array(self.freqs)
        exchange = np.zeros((n, n))
        exchange[np.triu_indices(n, 1)] = self.rates
        exchange += exchange.T
        q = exchange * pi
        np.fill_diagonal(q, -q.sum(1))
        q /= -(pi * np.diag(q)).sum()
        root = np.sqrt(pi)
        values, vectors = np.linalg.eigh(root[:, None] * q / root)
        return values, vectors / root[:, None], vectors.T * root


def _write(values: list[float]) -> str:
    return "{" + "/".join(f"{v:g}" for v in values) + "}"


def _read(text: str) -> tuple[list[float] | None, str]:
    """The values of a leading {..} or [..] list, and the rest."""
    m = re.match(r"[{\[]([^}\]]*)[}\]]", text)
    if not m:
        return None, text
    return [float(v) for v in m[1].split("/")], text[m.end() :]


def _mode(text: str, allowed: str) -> tuple[str, str]:
    return (text[0], text[1:]) if text and text[0] in allowed else ("", text)


def parse_model(text: str) -> Model:
    """NAME[{rates}](+OPTION)*; raises ValueError on anything that is not understood."""
    text = ALIASES.get(text.strip(), text.strip())
    m = re.match(r"[^+{\[]*", text)
    name, rest = m[0], text[m.end() :]
    if name in DNA_MODELS:
        symmetry, equal = DNA_MODELS[name]
        states = 4
    elif name == "PROTGTR":
        symmetry, equal, states = None, False, 20
    else:
        raise ValueError(f"unknown model {name!r}")
    pairs = states * (states - 1) // 2
    given, rest = _read(rest)
    classes = [int(c) for c in symmetry] if symmetry else list(range(pairs))
    if given is None:
        given = [0.5] * (max(classes) + 1)
        given[classes[-1]] = 1.0
    if len(given) != max(classes) + 1:
        raise ValueError(f"{name} has {max(classes) + 1} rates, not {len(given)}")
    rates = [given[c] / given[classes[-1]] for c in classes]
    model = Model(name, rates, [1 / states] * states, "model" if equal else "ML")
    seen = set()
    while rest:
        if rest[0] != "+":
            raise ValueError(f"unexpected {rest!r} in a model")
        rest = rest[1:]
        kind = rest[:1]
        if rest.startswith("ASC_"):
            m = re.match(r"ASC_(LEWIS|FELS|STAM)", rest)
            if not m:
                raise ValueError(f"unknown ascertainment correction {rest!r}")
            model.ascertainment = m[1]
            values, rest = _read(rest[m.end() :])
            if (values is None) != (m[1] == "LEWIS"):
                raise ValueError(f"weights of ASC_{m[1]} are wrong")
            continue
        if kind in seen or not kind:
            raise ValueError(f"option {kind!r} is given twice or empty")
        seen.add(kind)
        rest = rest[1:]
        if kind == "F":
            mode, rest = _mode(rest, "COEU")
            if mode in ("", "C"):
                model.freqs, model.freq_mode = None, "count"
            elif mode == "E" or mode == "O":
                model.freqs, model.freq_mode = [1 / states] * states, "equal" if mode == "E" else "ML"
            else:
                values, rest = _read(rest)
                if values is None or len(values) != states or not all(0 < v < 1 for v in values):
                    raise ValueError("FU needs a frequency in (0, 1) for each state")
                model.freqs, model.freq_mode = [v / sum(values) for v in values], "user"
        elif kind == "I":
            mode, rest = _mode(rest, "OCU")
            model.pinv_mode = {"": "ML", "O": "ML", "C": "count", "U": "user"}[mode]
            if mode == "U":
                values, rest = _read(rest)
                if values is None or len(values) != 1 or not 0 <= values[0] < 1:
                    raise ValueError("IU needs one share in [0, 1)")
                model.pinv = values[0]
        elif kind == "G":
            m = re.match(r"(\d*)([am]?)", rest)
            count, model.gamma_mode = int(m[1] or 4), "median" if m[2] == "a" else "mean"
            values, rest = _read(rest[m.end() :])
            model.alpha = values[0] if values else 1.0
            if count < 1 or model.alpha <= 0:
                raise ValueError("G needs categories and a positive alpha")
            model.cat_rates, model.cat_weights = gamma_rates(model.alpha, count, model.gamma_mode), [1 / count] * count
        elif kind == "R":
            m = re.match(r"\d*", rest)
            values, rest = _read(rest[m.end() :])
            weights, rest = _read(rest) if values else (None, rest)
            count = int(m[0] or (len(values) if values else 4))
            values = values or gamma_rates(1.0, count)
            weights = weights or [1 / count] * count
            if len(values) != count or len(weights) != count:
                raise ValueError("R needs a rate and a weight for each category")
            weights = [w / sum(weights) for w in weights]
            mean = sum(r * w for r, w in zip(values, weights))
            model.cat_rates, model.cat_weights = [r / mean for r in values], weights
        else:
            raise ValueError(f"unknown option {kind!r}")
    return model


# --- parameter files -------------------------------------------------------------------------------------


def _values(text: str, pattern: str, symbols: str) -> list[str]:
    """The value after pattern for every pair of symbols."""
    out = []
    for i, a in enumerate(symbols):
        for b in symbols[i + 1 :]:
            out.append(_one(text, pattern.format(a=a, b=b)))
    return out


def _one(text: str, key: str) -> str:
    m = re.search(re.escape(key) + r"([^\r\n]*)", text)
    if not m:
        raise ValueError(f"no {key!r} in the file")
    return m[1].strip()


def _has(text: str, key: str) -> bool:
    return key in text


def read_parameters(text: str) -> str:
    """The model string of a parameter file; the program that wrote it is told by its text."""
    if text.startswith("IQ-TREE "):
        return _from_report(text)
    if "This is RAxML version 8." in text:
        return _from_info(text)
    first = text.split("\n", 1)[0].split(",")
    if len(first) < 2:
        raise ValueError("no model string in the file")
    return first[0]


def _assemble(name: str, rates: list[str], freqs: list[str], pinv: str | None, gamma: str | None) -> str:
    text = name + "{" + "/".join(rates) + "}+FU{" + "/".join(freqs) + "}"
    if pinv is not None:
        text += "+IU{" + pinv + "}"
    return text + (gamma or "")


def _from_info(text: str) -> str:
    dna = _one(text, "DataType: ") == "DNA"
    name = _one(text, "Substitution Matrix: ")
    symbols = NUCLEOTIDES if dna else AMINO_ACIDS
    tail = text[text.index("Substitution Matrix: ") :]
    gamma = "+G4{" + _one(tail, "\nalpha: ") + "}" if _has(tail, "\nalpha: ") else None
    pinv = _one(tail, "\ninvar: ") if _has(tail, "\ninvar: ") else None
    rates = _values(tail, "rate {a} <-> {b}: ", symbols)
    freqs = [_one(tail, f"freq pi({c}): ") for c in symbols]
    return _assemble("PROTGTR" if not dna and name == "GTR" else name, rates, freqs, pinv, gamma)


def _from_report(text: str) -> str:
    name = _one(text, "Model of substitution: ").split("+")[0]
    symbols = NUCLEOTIDES if name in DNA_MODELS else AMINO_ACIDS
    rates = _values(text, "{a}-{b}: ", symbols)
    freqs = [_one(text, f"pi({c}) = ") for c in symbols]
    pinv = _one(text, "Proportion of invariable sites: ") if _has(text, "Proportion of invariable sites: ") else None
    gamma = None
    m = re.search(r"Gamma with (\d+) categories", text)
    if m:
        gamma = f"+G{m[1]}{{" + _one(text, "Gamma shape alpha: ") + "}"
    return _assemble(name, rates, freqs, pinv, gamma)
