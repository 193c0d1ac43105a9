"""Best-fit packing with a grouping genetic algorithm on islands (operator 10).

Documents become token ids plus a closing 0; those longer than a sequence are cut, the first piece being the
shorter one. Pieces are dealt by hash to blocks of about ``BLOCK`` pieces. On every block, ``ISLANDS``
populations evolve independently: an individual is a partition of the pieces into bins; crossover takes whole
well-filled bins of one parent into the other, empties the bins of the other that hold a piece twice, exchanges
displaced pieces for smaller ones where that fills a bin better, and places those left by best fit, largest
first. After each epoch the best individual of an island moves to the next one. A population that reaches the
lower bound on sequences stops. The best partition of a block becomes its sequences; blocks are independent, so any
number of them runs at once, and each wastes at most part of one sequence more than a joint packing.

The ids are those of ``tokenizers`` for the given file. Where the file is plain byte-level BPE whose ids
follow its merges, as is checked when it is read, the same ids are computed by rank with tiktoken, which is
about fifteen times faster; pre-tokens repeat and are kept in a table. Added tokens of the file are found first,
as ``tokenizers`` finds them: texts that hold one are its own work. Token ids never leave the worker: a piece is
a row of numbers.

Null and empty texts are one piece holding the closing id. Null ids and repeated rows are pieces like any
other. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.pretokens import Pieces, PreTokenCache
from cladeflow.llm.storage import cut_lineage
from cladeflow.llm.textops import all_chunks, small_batches

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 12
TRIES = 256
WELL_FILLED = 0.99
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_rank(model: dict) -> dict[bytes, int] | None:
    """Ranks of a vocabulary whose merges come in the order of their ids, otherwise None."""
    letters, vocab = byte_letters(), model["vocab"]
    last = -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        number = vocab.get(left + right, -1)
        if number <= last:
            return None
        last = number
    made = len(model["merges"]) + 256
    ranks = {bytes(letters[c] for c in word): n for word, n in vocab.items() if n < made and all(c in letters for c in word)}
    return ranks if len(ranks) == made else None


class Encoder:
    """Ids of many texts by a ``tokenizers`` file; added: whether its added tokens are looked for in the texts."""

    def __init__(self, content: bytes, added: bool = False):
        spec = json.loads(content)
        step = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and step.get("type") == "ByteLevel" and not step.get("add_prefix_space")
        ranks = by_rank(spec["model"]) if plain and step.get("use_regex", True) and not spec["model"].get("dropout") else None
        self.cache = self.tokenizer = self.holds_added = None
        tokens = spec.get("added_tokens") or []
        if ranks:
            import tiktoken

            encoding = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            self.cache = PreTokenCache(lambda texts: [encoding.encode_ordinary(t) for t in texts])
            if added and tokens:
                self.holds_added = re.compile("|".join(re.escape(t["content"]) for t in tokens)).search
        if not ranks or self.holds_added:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(content.decode())
            self.tokenizer.encode_special_tokens = not added

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.cache is not None:
            held = [k for k, t in enumerate(texts) if self.holds_added(t)] if self.holds_added else []
            if not held:
                return self.cache.ids(Pieces(texts))
            rest = set(held)
            flat, first = self.cache.ids(Pieces(["" if k in rest else t for k, t in enumerate(texts)]))
            ids = [flat[a:b] for a, b in zip(first[:-1], first[1:])]
            for k, e in zip(held, self.tokenizer.encode_batch([texts[k] for k in held], add_special_tokens=False)):
                ids[k] = np.array(e.ids, np.int32)
            return np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids]))
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        first = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=first[1:])
        return np.array([t for x in ids for t in x], np.int32), first


_encoders: dict[int, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    key = zlib.crc32(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content, added=True)
    return _encoders[key]


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for part in all_chunks(batches):
            flat, first = encoder(shared.value)([t or "" for t in part.column("text").to_pylist()])
            flat, rows = flat.astype("<u4"), []
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                ids = flat[a:b].tobytes() + b"\0\0\0\0"
                for number, (start, length) in enumerate(cut_points(b - a + 1, capacity)):
                    rows.append((doc_id, number, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Packing:
    """Bins over items 0..n-1 with a given capacity, with best-fit placement by a bit set of free spaces."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has r places free
        for items in bins or []:
            self._add(items, capacity - sum(sizes[i] for i in items))

    def _add(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.bins))
        self.bins.append(items)
        self.rooms |= 1 << room

    def place(self, items: list[int]) -> None:
        """Best fit in the given order."""
        sizes, by_room = self.sizes, self.by_room
        for item in items:
            size = sizes[item]
            open_rooms = self.rooms >> size
            if not open_rooms:
                self._add([item], self.capacity - size)
                continue
            left = (open_rooms & -open_rooms).bit_length() - 1
            room = left + size
            number = by_room[room].pop()
            if not by_room[room]:
                self.rooms &= ~(1 << room)
            self.bins[number].append(item)
            by_room[left].append(number)
            self.rooms |= 1 << left

    def fitness(self) -> float:
        """Fewer bins first, then fuller ones: the mean of squared fill, less the number of bins."""
        fills = [sum(self.sizes[i] for i in b) / self.capacity for b in self.bins]
        return sum(f * f for f in fills) / max(1, len(fills)) - len(fills)


def best_fit(sizes: list[int], capacity: int, noise: float, rng: random.Random) -> Packing:
    """Best fit by decreasing size, the order blurred by noise."""
    keys = [s * (1 + noise * rng.uniform(-1, 1)) for s in sizes]
    packing = Packing(sizes, capacity)
    packing.place(sorted(range(len(sizes)), key=lambda i: -keys[i]))
    return packing


def crossover(into: Packing, donor: Packing, rng: random.Random, well_filled: float = WELL_FILLED) -> Packing:
    """Well-filled bins of the donor enter whole; what they displace is placed by best fit."""
    sizes, capacity = into.sizes, into.capacity
    full = [b for b in donor.bins if sum(sizes[i] for i in b) >= well_filled * capacity]
    taken = [b for b in full if rng.random() < 0.5]
    moved = {i for b in taken for i in b}
    kept, displaced = [], []
    for b in into.bins:
        if moved.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in moved]
    # the emptiest bin is opened too, so that its pieces may find room elsewhere
    if kept:
        emptiest = min(range(len(kept)), key=lambda k: sum(sizes[i] for i in kept[k]))
        displaced += kept.pop(emptiest)
    kept = [list(b) for b in kept]
    displaced = improve(sizes, capacity, kept, displaced, rng)
    child = Packing(sizes, capacity, [list(b) for b in taken] + kept)
    child.place(sorted(displaced, key=lambda i: -sizes[i]))
    return child


def improve(sizes: list[int], capacity: int, bins: list[list[int]], displaced: list[int], rng: random.Random) -> list[int]:
    """Fill some of the bins better: a displaced item takes the place of one or two smaller ones, which are displaced
    in its stead and, being smaller, find room more easily. Gives what is displaced then."""
    waiting = sorted(displaced, key=lambda i: sizes[i])
    order = [sizes[i] for i in waiting]
    for b in rng.sample(bins, min(TRIES, len(bins))):
        free = capacity - sum(sizes[i] for i in b)
        if not free:
            continue
        best, out = 0, ()
        for gone in [(i,) for i in b] + list(itertools.combinations(b, 2)):
            size = sum(sizes[i] for i in gone)
            at = bisect.bisect_right(order, size + free) - 1  # the largest that fits in their place
            if at >= 0 and order[at] - size > best:
                best, out, chosen = order[at] - size, gone, at
        if best:
            b.append(waiting.pop(chosen))
            order.pop(chosen)
            for i in out:
                b.remove(i)
                at = bisect.bisect_left(order, sizes[i])
                waiting.insert(at, i)
                order.insert(at, sizes[i])
    return waiting


def labels(packing: Packing) -> list[int]:
    """Bin number of each item."""
    out = [0] * len(packing.sizes)
    for number, items in enumerate(packing.bins):
        for i in items:
            out[i] = number
    return out


def unlabel(sizes: list[int], capacity: int, numbers: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(numbers):
        bins.setdefault(b, []).append(i)
    return Packing(sizes, capacity, list(bins.values()))


def evolve(
    sizes: list[int], capacity: int, population: list[Packing], seed: int, generations: int = GENERATIONS, wanted: int = POPULATION
) -> list[Packing]:
    """Some generations of one island, the best individual first. The lower bound on bins ends it early."""
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    while len(population) < wanted:
        population.append(best_fit(sizes, capacity, 0.0 if not population and seed % 2 == 0 else 0.05, rng))
    scored = sorted(((p.fitness(), k, p) for k, p in enumerate(population)), reverse=True)[:wanted]
    for step in range(generations):
        if len(scored[0][2].bins) <= bound:
            break
        a, b = rng.sample(range(len(scored)), 2)
        child = crossover(scored[a][2], scored[b][2], rng)
        scored = sorted([*scored, (child.fitness(), wanted + step, child)], key=lambda x: (-x[0], x[1]))[:wanted]
    return [p for _, _, p in scored]


def one_by_one(batches) -> Iterator[dict]:
    """Rows as Python values, one at a time: each holds a whole block, a batch of them as objects would be gigabytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def pack(found: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Sequences for the rows of a pieces table, which is read twice and should be materialised."""
    spark = found.sparkSession
    n_blocks = max(1, -(-found.count() // block))
    dealt = found.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.rand(7)), F.lit(n_blocks)).alias("block"))
    blocks = dealt.agg(F.sort_array(F.collect_list(F.struct("length", "doc_id", "piece", "start", "ids_crc32"))).alias("items"))
    blocks = cut_lineage(blocks)
    state = blocks.select("block", F.col("items.length").alias("sizes")).withColumn(
        "island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    )
    state = state.withColumn("people", F.array().cast("array<array<int>>"))
    parts = max(1, min(n_blocks * islands, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for epoch in range(epochs):

        def run(batches, epoch=epoch):
            for r in one_by_one(batches):
                small = [s for s in r["sizes"] if s < capacity]
                start = [unlabel(small, capacity, p) for p in r["people"]]
                seed = (r["block"] * islands + r["island"]) * epochs + epoch
                best = evolve(small, capacity, start, seed)
                r["people"] = [labels(p) for p in best]
                r["fitness"] = best[0].fitness()
                yield pa.RecordBatch.from_pylist([r], schema=TYPES)

        evolved = state.repartition(parts, "block", "island").select("block", "island", "sizes", "people").mapInArrow(
            run, "block long, island int, sizes array<bigint>, people array<array<int>>, fitness double"
        )
        evolved = cut_lineage(evolved)
        if epoch + 1 < epochs:
            elites = evolved.select(
                "block", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.element_at("people", 1).alias("elite")
            )
            state = evolved.drop("fitness").join(elites, ["block", "island"]).withColumn(
                "people", F.concat(F.array("elite"), F.slice("people", 1, POPULATION - 1))
            )
    best = evolved.groupBy("block").agg(
        F.max_by(F.element_at("people", 1), F.struct("fitness", -F.col("island"))).alias("bins")
    )

    def lay_out(batches):
        for r in one_by_one(batches):
            bins, top = iter(r["bins"]), max(r["bins"], default=-1) + 1
            used: dict[int, int] = {}
            for item in r["items"]:
                if item["length"] < capacity:
                    number = next(bins)
                else:
                    number, top = top, top + 1
                item["sequence_id"], item["offset"] = (r["block"] << 20) + number, used.get(number, 0)
                used[number] = item["offset"] + item["length"]
            yield pa.RecordBatch.from_pylist(r["items"], schema=OUTPUT)

    return blocks.join(best, "block").select("block", "items", "bins").mapInArrow(
        lay_out, PIECES + ", sequence_id long, offset long"
    )


TYPES = pa.schema(
    [
        ("block", pa.int64()),
        ("island", pa.int32()),
        ("sizes", pa.list_(pa.int64())),
        ("people", pa.list_(pa.list_(pa.int32()))),
        ("fitness", pa.float64()),
    ]
)
OUTPUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece of ``docs``, with its sequence and place there."""
    found = cut_lineage(pieces(docs, read_vocabulary(path), capacity))
    return pack(found, capacity, **options)
