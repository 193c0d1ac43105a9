"""Toxicity scores of deobfuscated texts (operator 5).

1. A character trigram model is counted over all documents (a map with one small table per task, summed).
2. Noisy channel: words that look disguised (digits or signs among letters, letters repeated three times or
   more, letters kept apart by dots, dashes or spaces) become lattices of their whole length. Each observed
   sign may stand for itself or for the letters it imitates, a run of one letter for one or two of it, a gap
   (separators in a row) for nothing or for the border of two words, the latter where it is wider than others
   of its token; Viterbi decoding under the trigram model and the costs of the channel restores the words.
   As the model knows no words, borders are uncertain: of a token with gaps, the joined letters count, and
   every word whose probability over all ways to set the borders is at least ``LIKELY``.
3. Features of a text are its restored words in lower case and their first 4 to 8 bytes. Their log-odds
   are counted on labelled rows, about ``SAMPLE`` of each label, chosen by a hash of doc_id; only rows outside
   the held-out fold (crc32 of doc_id modulo 5 is not 0) are learnt from. All features that tell for label 1 and
   that ``MIN_TOXIC`` toxic rows of the sample have are kept and broadcast; the sample bounds their number.
4. A text is scored by a logistic function, fitted on the same sample, of its strongest feature, of how many
   and how strong its features are, and of its length. Sampled rows are weighted by the labelled rows of
   their label they stand for, so the share of each label, and with it the cut, stays that of all usable labels
   whatever the size of the table. Nothing but the text enters a score.

Scoring is a map over rows. Null and empty texts get the score of a text without features; null ids count as
not held out and are never learnt from; rows with equal ids are scored separately; of several labels of one
id the largest counts. Without labelled rows of both kinds every score is the share of label 1, or 0.0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.textops import BYTE_CODES, Hasher, Words, all_chunks, as_column, buffer, distinct, mix, small_batches

SAMPLE = 8000
PREFIXES = (4, 5, 6, 7, 8)
MIN_TOXIC = 3
MIN_WEIGHT = 1.0
STATISTICS = 7
FOLDS = 5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

# Symbols of the character model: 0 is the border of a word, 1 any other sign.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SYMBOL = {c: i + 2 for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 2
# Letters that a sign imitates.
LOOKS_LIKE = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
}
SEPARATORS = set("._-*~ \t\n\v\f\r")
SUBSTITUTE, SHORTEN, SKIP = -1.0, -0.5, -0.5
NARROW = -8.0  # a wide gap stands for nothing
BORDER = -2.0  # a narrow gap stands for a border
LIKELY = 0.01


# --- character model -------------------------------------------------------------------------------------


def _symbols() -> np.ndarray:
    """Model symbol of every code point below 0x250."""
    table = np.full(0x250, 1, np.int64)
    for code in range(0x250):
        table[code] = SYMBOL.get(chr(code).lower()[0], 1)
    table[[32, *range(9, 14)]] = 0
    return table


SYMBOLS = _symbols()


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of (symbol, symbol, symbol) over all words, with two borders before and one after each."""
    codes = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = SYMBOLS[np.minimum(codes, 0x24F)]
    keep = np.ones(len(s), bool)  # between words exactly two borders
    keep[2:] = ~((s[2:] == 0) & (s[1:-1] == 0) & (s[:-2] == 0))
    s = s[keep]
    single = np.flatnonzero((s[1:-1] == 0) & (s[:-2] != 0) & (s[2:] != 0)) + 1
    s = np.insert(s, single, 0)
    return np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)


class CharModel:
    """Log-probabilities of a symbol after two others, interpolated with shorter contexts."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)
        self.log = np.log(p3).astype(np.float32)

    def decode(self, observed: str) -> str:
        """The likeliest words behind what was observed, with spaces between them."""
        return "".join(self._read(observed)[0])

    def _read(self, observed: str) -> tuple[list[str], list[int]]:
        """The pieces of the likeliest reading, and of each: 0 if it was seen, 1 for a narrow gap, 2 for a wide one.
        Time is linear in the length."""
        runs: list[tuple[str, int]] = []
        for c in observed.lower():
            gap = c in SEPARATORS
            if runs and (runs[-1][0] == " " if gap else runs[-1][0] == c):
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((" " if gap else c, 1))
        narrow = min((n for c, n in runs if c == " "), default=0)
        log = self.log
        # (score, what was read: the last piece and, nested, those before it) by the last two symbols
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for c, n in runs:
            options: list[tuple[str, float]] = []
            kind = 0
            if c in SYMBOL:
                options = [(c * n, 0.0)] if n < 3 else [(c, SHORTEN), (c * 2, SHORTEN)]
            elif c == " ":
                wide = n > narrow
                kind = 1 + wide
                options = [("", NARROW if wide else SKIP), (" ", SKIP if wide else BORDER)]
            else:
                options = [(x * m, SUBSTITUTE * n) for x in LOOKS_LIKE.get(c, "") for m in {1, min(n, 2)}]
                options.append((c * n, 0.0))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, read) in best.items():
                for text, cost in options:
                    u, v, total = a, b, score + cost
                    if text == " ":
                        total += float(log[u, v, 0])
                        u = v = 0
                    else:
                        for x in text:
                            k = SYMBOL.get(x, 1)
                            total += float(log[u, v, k])
                            if k == 1:
                                total -= 3.0  # which of the other signs it is
                            u, v = v, k
                    old = after.get((u, v))
                    if old is None or total > old[0]:
                        after[u, v] = (total, (text, kind, read))
            best = after
        _, _, _, read = max((score + float(log[a, b, 0]), a, b, read) for (a, b), (score, read) in best.items())
        pieces, kinds = [], []
        while read is not None:
            piece, kind, read = read
            pieces.append(piece)
            kinds.append(kind)
        return pieces[::-1], kinds[::-1]

    def words(self, observed: str) -> list[str]:
        """The distinct words of what was observed; of the readings of its gaps, all likely ones."""
        pieces, kinds = self._read(observed)
        found = "".join(pieces).split()
        if any(kinds):
            letters, gaps = "", {}
            for piece, kind in zip(pieces, kinds):
                if not kind:
                    letters += piece
                elif letters:
                    gaps[len(letters)] = kind
            gaps.pop(len(letters), None)
            found += [letters, *self._likely(letters, gaps)]
        return list(dict.fromkeys(found))

    def _likely(self, letters: str, gaps: dict[int, int]) -> list[str]:
        """Words between borders at some of the gaps, each of probability ``LIKELY`` or more, by sums over all choices.

        States are the letters since the last border: none, one, or more. At most 1 / LIKELY beginnings are
        likely to reach any one letter, so time is linear in the length.
        """
        n, log, least = len(letters), self.log, math.log(LIKELY)
        if not n:
            return []
        s = [0, 0, *(SYMBOL.get(c, 1) for c in letters)]
        before = [((0, 0), (0, s[t + 1]), (s[t], s[t + 1])) for t in range(n + 1)]
        step = [[float(log[u, v, s[t + 2]]) for u, v in before[t]] for t in range(n)]
        end = [[float(log[u, v, 0]) for u, v in before[t]] for t in range(n + 1)]
        costs = {t: (SKIP, BORDER) if kind == 1 else (NARROW, SKIP) for t, kind in gaps.items()}
        rest = [[0.0] * 3 for _ in range(n)]  # all that may follow, by state
        for t in range(n - 1, -1, -1):
            after = end[n] if t + 1 == n else rest[t + 1]
            if t + 1 in costs:
                join, border = costs[t + 1]
                after = [_add(join + after[d], border + end[t + 1][d] + after[0]) for d in range(3)]
            rest[t] = [step[t][d] + after[min(d + 1, 2)] for d in range(3)]
        total = rest[0][0]
        here = [0.0, -math.inf, -math.inf]  # all that may come before, by state
        found = []
        for i in range(n):
            if i and i in costs:
                join, border = costs[i]
                start = -math.inf
                for d in (1, 2):
                    start = _add(start, here[d] + border + end[i][d])
                here = [start, here[1] + join, here[2] + join]
            run, d = here[0], 0
            for j in range(i + 1, n + 1):
                if run + rest[j - 1][d] - total < least:
                    break
                run, d = run + step[j - 1][d], min(d + 1, 2)
                if j == n:
                    done = run + end[n][d]
                elif j in costs:
                    done = run + costs[j][1] + end[j][d] + rest[j][0]
                    run += costs[j][0]
                else:
                    continue
                if done - total >= least:
                    found.append(letters[i:j])
            here = [-math.inf, here[0] + step[i][0], _add(here[1] + step[i][1], here[2] + step[i][2])]
        return found


def _add(a: float, b: float) -> float:
    """The logarithm of the sum of two numbers given by theirs."""
    high, low = max(a, b), min(a, b)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


# --- features --------------------------------------------------------------------------------------------


def _lower(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    out[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


LETTER = _flags(bytes([*range(97, 123), *range(128, 256)]))
DIGIT = _flags(b"0123456789")
SIGN = _flags(b"@$!|+(")
SEPARATOR = _flags(b"._-*~")


def disguised(words: Words) -> np.ndarray:
    """Words that the channel may have changed; words: of lower-case bytes."""
    data, n = words.data, len(words.data)
    letter = LETTER[data]
    before = lambda flags: np.append(0, np.cumsum(flags))
    letters, digits = before(letter), before(DIGIT[data])
    s, e = words.starts, words.ends
    has = (letters[e] > letters[s]) & (digits[e] > digits[s])
    # a sign with a letter right after it
    follows = np.zeros(n, bool)
    follows[:-1] = SIGN[data[:-1]] & letter[1:]
    follows[:-1] |= SIGN[data[:-1]] & SIGN[data[1:]] & np.append(letter[2:], False)
    triple = np.zeros(n, bool)
    triple[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (data[2:] < 128)
    apart = np.zeros(n, bool)
    apart[1:-1] = SEPARATOR[data[1:-1]] & letter[:-2] & letter[2:]
    marks, triples, gaps = before(follows), before(triple), before(apart)
    return has | (marks[e] > marks[s]) | (triples[e] - triples[np.minimum(s + 2, e)] > 0) | (gaps[e] - gaps[s] > 1)


class Features:
    """(row, feature) pairs of all texts of a chunk; words that look disguised are restored first."""

    def __init__(self, column: pa.Array, model: CharModel | None, memory: dict[str, list[str]] | None = None):
        data, offsets = buffer(column)
        words = Words(_lower(data), offsets)
        odd = disguised(words)
        restored, rows = [], []
        if model is not None:
            memory = {} if memory is None else memory
            texts = words.data.tobytes()
            plain = [(w, texts[words.starts[w] : words.ends[w]].decode("utf-8", "replace")) for w in np.flatnonzero(odd).tolist()]
            # letters on their own, three or more in a row, are one token; up to two thirds may be signs in their stead
            second = words.data[np.minimum(words.starts + 1, len(words.data) - 1)]
            size = words.ends - words.starts
            head = words.data[words.starts] if len(odd) else words.data[:0]
            alone = (size == 1) | ((size == 2) & (second < 128) & ~LETTER[second])
            single = np.flatnonzero((LETTER | DIGIT | SIGN)[head] & alone)
            if len(single) > 2:
                run = np.append(True, (np.diff(single) != 1) | (np.diff(words.rows[single]) != 0))
                first = np.flatnonzero(run)
                for a, b in zip(first.tolist(), np.append(first[1:], len(single)).tolist()):
                    at = single[a:b]
                    if b - a > 2 and 3 * LETTER[head[at]].sum() >= b - a:
                        plain.append((int(at[0]), texts[words.starts[at[0]] : words.ends[at[-1]]].decode("utf-8", "replace")))
            for w, text in plain:
                found = memory.get(text)
                if found is None:
                    if len(memory) > 50_000:
                        memory.clear()
                    found = memory[text] = model.words(text.strip(".,;:!?\"'`*%&#()[]{}"))
                restored += found
                rows += [int(words.rows[w])] * len(found)
        kept = ~odd if model is not None else np.ones(len(odd), bool)
        s, e = words.starts[kept], words.ends[kept]
        own = self._hash(words.data, words.bytes, s, e, words.rows[kept])
        if restored:
            joined = pa.array(restored, pa.large_string())
            d, o = buffer(joined)
            more = self._hash(d, Hasher(BYTE_CODES[d]), o[:-1], o[1:], np.array(rows))
            own = [np.concatenate(x) for x in zip(own, more)]
        self.rows, self.keys = own
        self.n_words = words.counts
        self.restored = restored

    @staticmethod
    def _hash(data, hasher, s, e, rows):
        """Words without what surrounds their letters: the whole and its beginnings."""
        n = len(data)
        place = np.arange(n)
        letter = LETTER[data]
        following = np.minimum.accumulate(np.where(letter, place, n)[::-1])[::-1] if n else place
        preceding = np.maximum.accumulate(np.where(letter, place, -1)) if n else place
        s2 = following[np.minimum(s, n - 1)] if n else s
        e2 = preceding[np.maximum(e - 1, 0)] + 1 if n else e
        good = (s2 < e) & (e2 > s2)
        s2, e2, rows = s2[good], e2[good], rows[good]
        keys, owners = [hasher.ranges(s2, e2)], [rows]
        for k in PREFIXES:
            long = e2 - s2 > k
            keys.append(mix(hasher.ranges(s2[long], s2[long] + k) + np.uint64(k)))
            owners.append(rows[long])
        return np.concatenate(owners), np.concatenate(keys)


class Scorer:
    """Feature weights and the logistic function over what a text has of them."""

    def __init__(self, counts: np.ndarray | None, keys: np.ndarray, weights: np.ndarray, curve: np.ndarray):
        self.model = CharModel(counts) if counts is not None else None
        order = np.argsort(keys)
        self.keys, self.weights, self.curve = keys[order], weights[order], curve
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.memory: dict[str, list[str]] = {}

    def statistics(self, column: pa.Array) -> np.ndarray:
        """Per row: the strongest weight; logarithms of the number of distinct features, of the sum of their
        weights, of that over all occurrences, of the number of words, and of both sums over that number."""
        found = Features(column, self.model, self.memory)
        n = len(column)
        out = np.zeros((n, STATISTICS))
        out[:, 4] = found.n_words
        if not len(self.keys):
            return np.log1p(out)
        maybe = np.flatnonzero(self.hint[(found.keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, found.keys[maybe])
        inside = at < len(self.keys)
        maybe, at = maybe[inside], at[inside]
        hit = self.keys[at] == found.keys[maybe]
        pairs = distinct((found.rows[maybe][hit].astype(np.uint64) << np.uint64(32)) | at[hit].astype(np.uint64))
        rows, which = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        strongest = np.zeros(n)
        np.maximum.at(strongest, rows, self.weights[which])
        out[:, 1] = np.bincount(rows, minlength=n)
        out[:, 2] = np.bincount(rows, self.weights[which], minlength=n)
        out[:, 3] = np.bincount(found.rows[maybe][hit], self.weights[at[hit]], minlength=n)
        out[:, 5:] = 100 * out[:, 2:4] / (out[:, 4:5] + 1)
        out = np.log1p(out)
        out[:, 0] = strongest
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return logistic(self.statistics(column), self.curve)


def logistic(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ curve[1:] + curve[0], -30, 30)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.05, weight: np.ndarray | None = None
) -> np.ndarray:
    """Intercept and weights, by Newton's method on scaled columns with a small ridge; rows may have weights."""
    weight = np.ones(len(x)) if weight is None else weight
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    scale[scale < 1e-6] = np.inf  # a column that does not vary tells nothing
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + penalty, z.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale)


# --- Spark -----------------------------------------------------------------------------------------------


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all documents; one table of fixed size for each task goes over the network."""

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for part in all_chunks(batches):
            total += trigram_counts([t or "" for t in part.column("text").to_pylist()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3, np.int64)
    counts[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """What ``Scorer`` is made of."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = count_trigrams(docs)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # the hash of an id is below a share of its range: no order of all labels is needed
    rate = lambda t: F.lit(min(1.0, sample / max(1, labelled.get(t, 0))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.where(draw < F.when(F.col("toxic") == 1, rate(1)).otherwise(rate(0)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    shared = spark.sparkContext.broadcast(counts)

    def count(batches):
        model, memory = CharModel(shared.value), {}
        for part in all_chunks(batches):
            found = Features(as_column(part.column("text")), model, memory)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)
            order = np.lexsort((found.rows, found.keys))
            keys, owners = found.keys[order], found.rows[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]))[: len(keys)]
            keys, label = keys[new], toxic[owners[new]]
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            ones = np.add.reduceat(label, head).astype(np.int64) if len(head) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(head, len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[head].view(np.int64)), pa.array(ones), pa.array(sizes - ones)], ["key", "ones", "zeros"]
            )

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    none = np.zeros(0, np.uint64), np.zeros(0)
    if not n1 or not n0:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return counts, *none, np.append(np.log((share + 1e-9) / (1 - share + 1e-9)), np.zeros(STATISTICS))
    half = F.lit(0.5)
    weight = F.log((F.col("ones") + half) / F.lit(n1 + 1.0)) - F.log((F.col("zeros") + half) / F.lit(n0 + 1.0))
    features = (
        rows.mapInArrow(count, "key long, ones long, zeros long")
        .groupBy("key")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .where(F.col("ones") >= MIN_TOXIC)
        .select("key", weight.alias("weight"))
        .where(F.col("weight") >= MIN_WEIGHT)
    )
    features = features.toPandas().sort_values("key")
    keys, weights = features["key"].to_numpy(np.int64).view(np.uint64), features["weight"].to_numpy(float)
    flat = spark.sparkContext.broadcast((counts, keys, weights, np.zeros(STATISTICS + 1)))

    def measure(batches):
        scorer = Scorer(*flat.value)
        for part in all_chunks(batches):
            x = scorer.statistics(as_column(part.column("text")))
            columns = {f"x{k}": x[:, k] for k in range(STATISTICS)}
            yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), **columns})

    names = [f"x{k}" for k in range(STATISTICS)]
    seen = rows.mapInArrow(measure, "toxic int, " + ", ".join(f"{c} double" for c in names)).toPandas()
    seen = seen.sort_values(["toxic", *names])
    sizes = seen.groupby("toxic").size()
    stands_for = seen["toxic"].map({t: labelled[t] / n for t, n in sizes.items()})
    curve = fit_logistic(seen[names].to_numpy(float), seen["toxic"].to_numpy(float), weight=stands_for.to_numpy(float))
    return counts, keys, weights, curve


_scorers: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    if shared.id not in _scorers:
        _scorers.clear()
        _scorers[shared.id] = Scorer(*shared.value)
    return _scorers[shared.id]


class _Shared:
    """A broadcast with a number that is the same in all workers."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    shared = _Shared(docs.sparkSession, train(docs, labels, sample))

    def run(batches):
        for part in all_chunks(batches):
            found = _scorer(shared).score(as_column(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def filter_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below the limit, all columns unchanged."""
    shared = _Shared(docs.sparkSession, train(docs, labels, sample))

    def run(batches):
        for part in all_chunks(batches):
            yield part.filter(pa.array(_scorer(shared).score(as_column(part.column("text"))) < limit))

    return docs.mapInArrow(run, docs.schema)
