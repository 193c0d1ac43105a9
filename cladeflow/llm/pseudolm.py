"""Masked pseudo-likelihood of documents under a bidirectional window network (operator 3).

1. Words of all documents are counted; the table of counts grows with the corpus. Words above a count that at
   most ``LISTED`` words reach go to all tasks; the ``KNOWN`` most frequent of them (ties by word) get numbers
   of their own, in order of frequency, all others share ``OTHERS`` numbers by hash.
2. The network sees ``REACH`` words on either side of a masked one: embeddings, one tanh layer, and the number
   of the word as three digits in base 16, each given those before it, so a prediction costs 48 outputs
   instead of 4,096 and still is a distribution over all numbers.
3. Documents become rows of numbers, dealt by a hash of text and id to shards of about ``SHARD_WORDS`` words
   and sorted by it there. Over each shard the network is trained in numpy by stochastic gradient descent from
   the common start, and the parameters are averaged, weighted by words; ``ROUNDS`` times. The average is summed
   in each task, then in a few groups of tasks, then as a whole; only it reaches the driver. As a shard
   depends on its rows alone, scores do not depend on files or partitions, but for rounding (and for rows
   with null ids and equal texts, which are dealt at random).
4. A document's score is the sum of the log-probabilities of its words, each given both sides. That of a word
   with a shared number is the network's for the number plus that of the word among all that share it, from
   the table of counts: n / (total + 1), the one being for all words never counted. Counts of words that are
   not listed come by a join on the word's hash; each such word is rare, so no task gets much of one.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and score 0.0 (null per word); null ids and
repeated rows are scored like others and counted in training; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.storage import cut_lineage
from cladeflow.llm.textops import BYTE_CODES, Hasher, Words, all_chunks, as_column, buffer, one_thread, small_batches

KNOWN = 3072
OTHERS = 1024
SIZE = KNOWN + OTHERS
LISTED = 1 << 18
REACH = 2
WIDTH = 16
HIDDEN = 32
BASE = 16
BATCH = 4096
ROUNDS = 2
RATE = 0.1
SHARD_WORDS = 2_000_000
GROUPS = 64
LIMIT = 60.0  # of logits
FLUSH = 300_000


def shapes() -> dict[str, tuple[int, ...]]:
    out = BASE
    return {
        "embed": (SIZE + 1, WIDTH),  # the last row stands beyond the ends of a text
        "third_bias": (out * out, out),
        "inner": (2 * REACH * WIDTH, HIDDEN),
        "inner_bias": (HIDDEN,),
        "outer": (HIDDEN, 3 * out),
        "first_bias": (out,),
        "second_bias": (out, out),
    }


class Network:
    """Parameters in one vector, with views of its parts. Work arrays are kept, as fresh ones would cost most of the time."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 1):
        total = sum(int(np.prod(s)) for s in shapes().values())
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.zeros(total, np.float32)
            at = 0
            for name, shape in shapes().items():
                size = int(np.prod(shape))
                if name in ("embed", "inner", "outer"):
                    flat[at : at + size] = rng.normal(0, 0.3 if name == "embed" else 1 / np.sqrt(shape[0]), size)
                at += size
        self.flat = flat.astype(np.float32)
        self.moment, self.slopes, self.spare = (np.zeros_like(self.flat) for _ in range(3))
        self.parts, self.grads = self._views(self.flat), self._views(self.slopes)
        self.x = np.empty((BATCH, 2 * REACH * WIDTH), np.float32)
        self.h, self.back = np.empty((BATCH, HIDDEN), np.float32), np.empty((BATCH, HIDDEN), np.float32)
        self.logits, self.bias = np.empty((BATCH, 3 * BASE), np.float32), np.empty((BATCH, BASE), np.float32)
        self.columns = np.empty((max(WIDTH, BASE), 2 * REACH * BATCH))

    @staticmethod
    def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in shapes().items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def _forward(self, context: np.ndarray, word: np.ndarray):
        """Inputs, hidden layer, exponentials of the logits, and of each digit its slice of them and its values."""
        p, n = self.parts, len(word)
        x, h, logits, bias = self.x[:n], self.h[:n], self.logits[:n], self.bias[:n]
        np.take(p["embed"], context, axis=0, out=x.reshape(n, 2 * REACH, WIDTH), mode="clip")
        np.matmul(x, p["inner"], out=h)
        h += p["inner_bias"]
        np.tanh(h, out=h)
        np.matmul(h, p["outer"], out=logits)
        parts = [slice(k * BASE, (k + 1) * BASE) for k in range(3)]
        logits[:, parts[0]] += p["first_bias"]
        for part, table, given in ((parts[1], "second_bias", word >> 8), (parts[2], "third_bias", word >> 4)):
            logits[:, part] += np.take(p[table], given, axis=0, out=bias, mode="clip")
        np.clip(logits, -LIMIT, LIMIT, out=logits)
        np.exp(logits, out=logits)
        return x, h, logits, list(zip(parts, (word >> 8, (word >> 4) & 15, word & 15)))

    def log_probs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log-probability of each of at most ``BATCH`` words given its context."""
        total, place = np.zeros(len(word)), np.arange(len(word))
        _, _, e, digits = self._forward(context, word)
        for part, digit in digits:
            total += np.log(e[place, part.start + digit] / e[:, part].sum(axis=1))
        return total

    def learn(self, context: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One step of Adagrad on the mean loss of at most ``BATCH`` words."""
        p, g, n = self.parts, self.grads, len(word)
        x, h, delta, digits = self._forward(context, word)
        place = np.arange(n)
        for part, digit in digits:
            delta[:, part] /= n * delta[:, part].sum(axis=1, keepdims=True)
            delta[place, part.start + digit] -= 1 / n
        np.matmul(h.T, delta, out=g["outer"])
        g["first_bias"][:] = delta[:, :BASE].sum(0)
        self._sums(word >> 8, delta[:, BASE : 2 * BASE], g["second_bias"])
        self._sums(word >> 4, delta[:, 2 * BASE :], g["third_bias"])
        back = np.matmul(delta, p["outer"].T, out=self.back[:n])
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        back *= h
        np.matmul(x.T, back, out=g["inner"])
        g["inner_bias"][:] = back.sum(0)
        np.matmul(back, p["inner"].T, out=x)
        self._sums(context.ravel(), x.reshape(-1, WIDTH), g["embed"])
        np.multiply(self.slopes, self.slopes, out=self.spare)
        self.moment += self.spare
        np.sqrt(self.moment, out=self.spare)
        self.spare += np.float32(1e-6)
        np.divide(self.slopes, self.spare, out=self.spare)
        self.spare *= np.float32(rate)
        self.flat -= self.spare

    def _sums(self, at: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
        """Sums of the rows of values by place."""
        columns = self.columns[: values.shape[1], : len(values)]
        np.copyto(columns, values.T)
        for k, column in enumerate(columns):
            out[:, k] = np.bincount(at, column, len(out))


class Vocabulary:
    """Numbers of words by their hashes, and what is known of the counts of those that share a number.

    words: the listed words, the most frequent first; counts: theirs; totals: of all words with a shared number.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, totals: np.ndarray):
        hashes = word_hashes(pa.array(words, pa.large_binary()))
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], order
        self.logs = np.log(np.maximum(counts, 1).astype(np.float64))[order]
        self.totals = -np.log(totals + 1.0)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, log-probabilities among those that share the number, whether the word's count is missing there)."""
        numbers = (hashes % np.uint64(OTHERS)).astype(np.int64)
        more = self.totals[numbers]
        numbers += KNOWN
        missing = np.ones(len(hashes), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            listed = self.hashes[at] == hashes
            more[listed] += self.logs[at[listed]]
            ranks = self.ranks[at]
            known = listed & (ranks < KNOWN)
            numbers[known], more[known] = ranks[known], 0.0
            missing = ~listed
        return numbers, more, missing


def word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = buffer(words)
    return Hasher(BYTE_CODES[data]).ranges(offsets[:-1], offsets[1:])


def contexts(numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers around every position, those of other rows replaced by ``SIZE``."""
    n = len(numbers)
    row = np.pad(rows, REACH, constant_values=-1)
    padded = np.pad(numbers, REACH, constant_values=SIZE)
    out = np.empty((n, 2 * REACH), np.int64)
    for k, d in enumerate(d for d in range(-REACH, REACH + 1) if d):
        place = slice(REACH + d, REACH + d + n)
        out[:, k] = np.where(row[place] == rows, padded[place], SIZE)
    return out


# --- counts ----------------------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents; counts are summed per task before they are shuffled."""

    def run(batches):
        def out(total):
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )

        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update((text or "").encode().split())
            if len(total) > FLUSH:
                yield out(total)
                total = Counter()
        if total:
            yield out(total)

    counts = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return cut_lineage(counts)


def listed_words(counts: DataFrame, most: int = LISTED) -> tuple[list[bytes], np.ndarray]:
    """Words and counts, the most frequent first: all words from some count on, at most ``most``.

    The count comes from a histogram, in steps of an eighth of a power of two.
    """
    level = F.floor(F.log2("n") * 8)
    sizes = {r["level"]: r["size"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()}
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    if least is None:
        return [], np.zeros(0, np.int64)
    top = counts.where(level >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return [bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64)


@dataclass
class Model:
    """words, counts, totals: see ``Vocabulary``; flat: the network's parameters; rest: (key, n) of words that
    are not listed and occur more than once."""

    words: list[bytes]
    counts: np.ndarray
    totals: np.ndarray
    rest: DataFrame
    flat: np.ndarray

    def shared(self):
        return self.words, self.counts, self.totals


def count_model(docs: DataFrame, most: int = LISTED) -> Model:
    """All of a model that is counted, with the network that training starts from."""
    table = count_words(docs)
    words, counts = listed_words(table, most)
    known = table.sparkSession.sparkContext.broadcast(words)
    unlisted = F.col("n") < (int(counts[-1]) if len(counts) else F.lit(2**62))

    def run(batches):
        frequent = np.sort(word_hashes(pa.array(known.value[:KNOWN], pa.large_binary())))
        for batch in batches:
            hashes = word_hashes(batch.column("word").cast(pa.large_binary()))
            share = ~np.isin(hashes, frequent)
            n = batch.column("n").filter(pa.array(share))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[share].view(np.int64)), pa.array((hashes[share] % np.uint64(OTHERS)).astype(np.int64)), n],
                ["key", "shared", "n"],
            )

    rare = cut_lineage(table.mapInArrow(run, "key long, shared long, n long"))
    sums = rare.groupBy("shared").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(OTHERS, np.int64)
    totals[sums["shared"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return Model(words, counts, totals, rare.where(unlisted & (F.col("n") > 1)).select("key", "n"), Network().flat)


# --- documents as numbers --------------------------------------------------------------------------------


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """(key, doc_id, n_words, numbers, more, missing) of every row: a hash of the row, the numbers of its words as
    16-bit integers, the sum of what counts add to their log-probabilities, and the hashes of unlisted words."""
    shared = docs.sparkSession.sparkContext.broadcast(model.shared())

    def run(batches):
        vocabulary = Vocabulary(*shared.value)
        for part in all_chunks(batches):
            words = Words(*buffer(as_column(part.column("text"))))
            hashes = words.hashes()
            numbers, more, missing = vocabulary(hashes)
            total = np.append(0.0, np.cumsum(more))
            lacks = np.append(0, np.cumsum(missing))[words.first].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(words.counts.astype(np.int64)),
                    _slices(numbers.astype("<u2"), words.first),
                    pa.array(total[words.first[1:]] - total[words.first[:-1]]),
                    pa.ListArray.from_arrays(pa.array(lacks), pa.array(hashes[missing].view(np.int64))),
                ],
                ["key", "doc_id", "n_words", "numbers", "more", "missing"],
            )

    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.rand(3))).otherwise(F.xxhash64("text", "doc_id"))
    return docs.select("doc_id", "text", key.alias("key")).mapInArrow(
        run, "key long, doc_id long, n_words long, numbers binary, more double, missing array<bigint>"
    )


def _slices(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The values between the offsets, as binary."""
    offsets = (first * values.itemsize).astype(np.int64)
    out = pa.Array.from_buffers(
        pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    )
    return out.cast(pa.binary())


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows end to end, and their rows."""
    data, offsets = buffer(column.cast(pa.large_binary()))
    return data.view("<u2").astype(np.int64), np.repeat(np.arange(len(column)), np.diff(offsets) // 2)


class Trainer:
    """Trains a network on the rows of one shard, in steps of ``BATCH`` positions however the rows arrive."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.net, self.rate, self.seen = Network(flat.copy()), rate, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, context: np.ndarray, word: np.ndarray) -> None:
        self.held.append((context, word))
        self.waiting += len(word)
        if self.waiting >= 16 * BATCH:
            self._step(self.waiting // BATCH * BATCH)

    def _step(self, size: int) -> None:
        context, word = (np.concatenate(x) for x in zip(*self.held))
        for a in range(0, size, BATCH):
            b = min(size, a + BATCH)
            self.net.learn(context[a:b], word[a:b], self.rate)
        self.seen += size
        self.held, self.waiting = [(context[size:], word[size:])], len(word) - size

    def done(self) -> tuple[np.ndarray, int]:
        """The parameters times the positions seen, and their number."""
        if self.waiting:
            self._step(self.waiting)
        return self.net.flat.astype(np.float64) * self.seen, self.seen


def _add_up(rows: DataFrame, by: str) -> DataFrame:
    """Sums of the rows (group, total: binary doubles, seen) with equal ``by``, as rows of group 0."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for group, total, seen in zip(*(batch.column(c).to_pylist() for c in (by, "total", "seen"))):
                held = sums.setdefault(group, [0.0, 0])
                held[0] = held[0] + np.frombuffer(total, np.float64)
                held[1] += seen
        yield _totals([(0, t, s) for t, s in sums.values()])

    return rows.repartition(by).mapInArrow(run, TOTALS)


TOTALS = "group int, total binary, seen long"


def _totals(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([g for g, _, _ in rows], pa.int32()),
            pa.array([t.tobytes() for _, t, _ in rows], pa.binary()),
            pa.array([s for _, _, s in rows], pa.int64()),
        ],
        ["group", "total", "seen"],
    )


def train(encoded: DataFrame, flat: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """The parameters after some rounds over all rows of a table made by ``encode``."""
    spark = encoded.sparkSession
    n_words = encoded.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-n_words // SHARD_WORDS))
    dealt = encoded.where("n_words > 0").select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "numbers")
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(flat)
        step = rate / (number + 1)

        def run(batches, shared=shared, step=step):
            one_thread()
            shard, trainer, total, seen = None, None, 0.0, 0

            def close():
                nonlocal total, seen
                if trainer is not None:
                    more, n = trainer.done()
                    total, seen = total + more, seen + n

            for batch in batches:
                numbers = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b:
                        continue
                    if numbers[a] != shard:
                        close()
                        shard, trainer = numbers[a], Trainer(shared.value, step)
                    for k in range(a, b, 256):
                        word, rows = _unpack(batch.column("numbers").slice(k, min(256, b - k)))
                        trainer.add(contexts(word, rows), word)
            close()
            if seen:
                yield _totals([(TaskContext.get().partitionId() % GROUPS, total, seen)])

        sums = dealt.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(run, TOTALS)
        # a task adds up those of a group; what is left of them is added up by one, and is GROUPS networks at most
        whole = _add_up(_add_up(sums, "group").withColumn("group", F.lit(0)), "group").collect()
        if whole:
            flat = (np.frombuffer(whole[0]["total"], np.float64) / whole[0]["seen"]).astype(np.float32)
    return flat


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """A model of ``docs``, and their numbers."""
    small_batches(docs.sparkSession)
    model = count_model(docs)
    encoded = cut_lineage(encode(docs, model))
    model.flat = train(encoded, model.flat, rounds)
    return model, encoded


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, per_word) of every row; the model is trained on ``docs`` if not given."""
    small_batches(docs.sparkSession)
    if model is None:
        model, encoded = fit(docs)
    else:
        encoded = encode(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model.flat)

    def run(batches):
        one_thread()
        net = Network(shared.value)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                word, rows = _unpack(part.column("numbers"))
                context = contexts(word, rows)
                found = [net.log_probs(context[a : a + BATCH], word[a : a + BATCH]) for a in range(0, len(word), BATCH)]
                found = np.bincount(rows, np.concatenate(found), part.num_rows) if found else np.zeros(part.num_rows)
                log_prob = found + part.column("more").to_numpy()
                row = pa.array(np.arange(number, number + part.num_rows))
                columns = [row, part.column("doc_id"), part.column("n_words"), pa.array(log_prob), part.column("missing")]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "log_prob", "missing"])
                number += part.num_rows

    # log_prob is still without the counts of unlisted words, the logarithm of which is 0 for those seen once
    rows = encoded.select("doc_id", "n_words", "numbers", "more", "missing").mapInArrow(
        run, "row long, doc_id long, n_words long, log_prob double, missing array<bigint>"
    )
    rows = cut_lineage(rows)
    more = rows.select("row", F.explode("missing").alias("key")).join(model.rest, "key")
    more = more.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    log_prob = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    return (
        rows.drop("missing")
        .join(more, "row", "left")
        .select("doc_id", "n_words", log_prob.alias("log_prob"))
        .withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
    )
