"""Exact n-gram Jaccard self-join with PartEnum signatures (operator 7).

A document's set is its distinct word shingles. Two sets are linked when ``den * |A and B| >= num * |A or B|``.

* Equal sets are one class; everything below works on classes, so copies cost nothing more.
* Sizes fall into bands that grow by half. A tag stands for the pairs whose larger set lies in its band; a set
  carries its own band's tag, and the next one's if it is large enough to be linked to a set there. For a tag,
  linked sets differ in at most k elements.
* PartEnum: the domain of the 64-bit shingle hashes is cut into n1 equal ranges and each into n2; of linked
  sets some first-level range differs in at most k2 elements, k < n1 (k2 + 1), so they agree on some n2 - k2 of
  its parts. Every choice of n2 - k2 parts gives one signature. Here n2 = 3 and k2 = 1 where k > 2, so a
  signature holds two parts of three; there are a few ranges more than needed, and choices of empty parts are
  left out unless a set has so many that an agreement could consist of them alone. A set of n shingles has
  about 0.4 n signatures.
* Classes that share a signature meet in a bucket. Buckets with the same content are one. Within a bucket a
  set is compared with the others by odd sketches (bits that flip with each element): two sketches differ in
  no more bits than the sets differ in elements, so a pair that they rule out is not linked. Of what is left,
  each class proposes a few classes of components with smaller numbers; whole sets decide. Links thus form a
  forest, whose roots pointer jumping finds. Rounds go on until no bucket holds an undecided pair of different
  components. Thus no pair within a group is compared once the group is joined, and no link between components
  is missed.
* A bucket of more than ``CHUNK`` classes is dealt by hash into chunks, which meet in pairs, as in a
  tournament: in phase t chunk c meets chunk c xor t. Each row is in one pair of chunks at a time, so rows do not
  multiply and no task compares more than about two chunks. Phases 1, 2, 4 ... come first: they join a group of
  near copies whole, and a bucket with one component left is done.

The rows moved are signatures (16 bytes each, equal ones of an Arrow batch merged before) and, for classes
that share a signature with another one, sketches and sets. Only tables of numbers are broadcast, and only
when counted below ``BROADCAST_ROWS``; beyond, they are joined by shuffles. Class numbers are 64-bit hashes of
whole sets; a second hash finds numbers that stand for several sets (one pair is expected in some billions of
documents), and the classes with such a number get others made of both hashes.

Null and empty texts, and texts of white space, have an empty set and are linked with nothing: their
component is their own id. Rows with equal ids are separate rows of one id. Null ids never represent a
component that has others; where all ids are null the component is null. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cladeflow.llm.storage import cut_lineage, drop_table, release
from cladeflow.llm.textops import Hasher, Words, all_chunks, as_column, buffer, fresh_name, mix, small_batches

SHINGLE = 4
NUM, DEN = 85, 100
BROADCAST_ROWS = 1_000_000
CHUNK = 1024
MAX_CLASHES = 1_000_000
SURE = 0.75
NEAREST = 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GOLD, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- sets ------------------------------------------------------------------------------------------------


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row end to end, and the rows' offsets into them."""
    data, offsets = buffer(column)
    words = Words(LOWER[data], offsets)
    hasher = Hasher(words.hashes())
    windows = hasher.windows(size)
    first, counts = words.first, words.counts
    short = (counts > 0) & (counts < size)
    whole = hasher.ranges(first[:-1][short], first[1:][short])
    at, parts = np.zeros(len(counts) + 1, np.int64), []
    k = 0
    for row, (a, n) in enumerate(zip(first[:-1].tolist(), counts.tolist())):
        if n >= size:
            part = np.sort(windows[a : a + n - size + 1])
            part = part[np.append(True, part[1:] != part[:-1])]
            parts.append(part)
        elif n:
            parts.append(whole[k : k + 1])
            k += 1
        at[row + 1] = len(parts[-1]) if n else 0
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(at)


def class_numbers(elements: np.ndarray, first: np.ndarray, clashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set that depend on its elements alone, the first being its number; 0 for the empty one.

    clashes: numbers that several sets have; those get a number made of both hashes.
    """
    sizes = np.diff(first).astype(np.uint64)
    out = []
    for salt in (_GOLD, _SECOND):
        sums = np.zeros(len(elements) + 1, np.uint64)
        np.cumsum(mix(elements + salt), out=sums[1:])
        out.append(np.where(sizes > 0, mix(sums[first[1:]] - sums[first[:-1]] + sizes * salt) | np.uint64(1), np.uint64(0)))
    numbers, checks = out
    if clashes is not None and len(clashes):
        again = np.isin(numbers.view(np.int64), clashes) & (sizes > 0)
        numbers[again] = mix(numbers[again] ^ mix(checks[again])) | np.uint64(1)
    return numbers.view(np.int64), checks.view(np.int64)


# --- signatures ------------------------------------------------------------------------------------------


class Bands:
    """Size bands, and the parameters of PartEnum for each."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * 3 // 2))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def most(self, total: int) -> int:
        """Elements in which linked sets of that total size differ at most."""
        return (self.den - self.num) * total // (self.den + self.num)

    def tags(self, size: int) -> list[int]:
        own = self.of(size)
        return [own, own + 1] if self.den * size >= self.num * self.lows[own + 1] else [own]

    def parameters(self, tag: int) -> tuple[int, int, int, int, int]:
        """(k, n1, n2, k2, how many of the n1 ranges differ in at most k2 elements at least)."""
        k = self.most(2 * (self.lows[tag + 1] - 1))
        if k <= 2:
            return k, 1, k + 2, k, 1
        spare = 2 + k // 24
        n1 = k // 2 + 1 + spare
        return k, n1, 3, 1, n1 - k // 2


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of one set (sorted hashes)."""
    size, out = len(elements), []
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(mix(elements ^ _GOLD), out=sums[1:])
    high = elements >> np.uint64(32)
    for tag in bands.tags(size):
        k, n1, n2, k2, good = bands.parameters(tag)
        if k == 0:  # only equal sets, which are one class
            continue
        parts = n1 * n2
        cuts = np.searchsorted(high * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        part = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(n1, n2)
        empty = (cuts[1:] == cuts[:-1]).reshape(n1, n2)
        choices = CHOICES[n2, k2]
        # a range in which an agreement may consist of empty parts alone; if not all good ranges can be such, none is needed
        hollow = empty.sum(axis=1) >= n2 - k2
        keep = ~empty[:, choices].all(axis=2) if hollow.sum() < good else np.ones((n1, len(choices)), bool)
        salt = (np.arange(n1 * len(choices), dtype=np.uint64) << np.uint64(8)) + np.uint64(tag)
        whole = part[:, choices].sum(axis=2, dtype=np.uint64) + mix(salt + _GOLD).reshape(n1, -1)
        out.append(mix(whole[keep]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# Choices of n2 - k2 out of n2 parts, by (n2, k2).
CHOICES = {(n, k): np.array(list(itertools.combinations(range(n), n - k))) for n, k in ((2, 0), (3, 1), (4, 2))}


def sketch(elements: np.ndarray) -> np.ndarray:
    """Odd sketch: one bit for each of at least four times as many places as elements, flipped by each element there."""
    places = max(64, 1 << (4 * len(elements) - 1).bit_length())
    flips = np.bincount((mix(elements + np.uint64(7)) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch that fewer places would have given."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(both) - common)


# --- buckets ---------------------------------------------------------------------------------------------


def _bits(sketches: list[bytes]) -> list[int]:
    """Sketches as whole numbers, folded to the shortest one."""
    size = 8 * min(map(len, sketches))
    out = []
    for s in sketches:
        value, width = int.from_bytes(s, "little"), 8 * len(s)
        while width > size:
            width //= 2
            value = (value >> width) ^ (value & ((1 << width) - 1))
        out.append(value)
    return out


def propose(classes: list[int], comps: list[int], sizes: list[int], sketches: list[bytes], failed: list, bands: Bands) -> list:
    """(class, its component, class of a smaller component that sketches do not rule out, that one, rank) within
    a bucket.

    Of the partners that differ in at most ``SURE`` of the allowed bits, that of the smallest component is
    proposed, so that a group gathers around one class; where there is none, the ``NEAREST`` nearest ones. A
    class without a proposal has no partner left in the bucket.
    """
    if min(comps) == max(comps):
        return []
    order = sorted(range(len(classes)), key=lambda i: (comps[i], classes[i]))
    values = _bits([sketches[i] for i in order])
    classes, comps, sizes = ([x[i] for i in order] for x in (classes, comps, sizes))
    wide = len(order) > 24
    if wide:
        step = (max(v.bit_length() for v in values) + 63) // 64 or 1
        table = np.array([np.frombuffer(v.to_bytes(8 * step, "little"), np.uint64) for v in values])
        number, size = np.array(classes), np.array(sizes)
    out, before = [], 0
    for i in range(1, len(order)):
        if comps[i] != comps[i - 1]:
            before = i
        if not before:
            continue
        lost = failed[order[i]]
        if wide:
            apart = np.bitwise_count(table[:before] ^ table[i]).sum(axis=1, dtype=np.int64)
            allowed = (bands.den - bands.num) * (size[:before] + size[i]) // (bands.den + bands.num)
            fits = apart <= allowed
            if lost:
                fits &= ~np.isin(number[:before], lost)
            found = [(j, int(apart[j]), int(allowed[j])) for j in np.flatnonzero(fits).tolist()]
        else:
            found = []
            for j in range(before):
                allowed = bands.most(sizes[j] + sizes[i])
                apart = (values[j] ^ values[i]).bit_count()
                if apart <= allowed and not (lost and classes[j] in lost):
                    found.append((j, apart, allowed))
        if not found:
            continue
        sure = next((j for j, apart, allowed in found if apart <= SURE * allowed), None)
        if sure is not None:
            chosen = [(sure, 0)]
        else:
            chosen = [(j, 1 + apart) for j, apart, _ in sorted(found, key=lambda f: f[1])[:NEAREST]]
        out += [(classes[i], comps[i], classes[j], comps[j], rank) for j, rank in chosen]
    return out


def _buckets(batches, bands: Bands):
    """Stream of rows sorted by bucket; proposals carry the bucket they come from."""
    names = ("cls", "comp", "n", "sketch", "failed")
    bucket, held, rows = None, [[] for _ in names], []

    def batch_of(rows):
        columns = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sig", "cls", "comp", "other", "into", "apart"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        for k, number in enumerate(batch.column("sig").to_pylist()):
            if number != bucket:
                if len(held[0]) > 1:
                    rows += [(bucket, *r) for r in propose(*held, bands)]
                bucket, held = number, [[] for _ in names]
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            for to, column in zip(held, columns):
                to.append(column[k])
    if len(held[0]) > 1:
        rows += [(bucket, *r) for r in propose(*held, bands)]
    yield batch_of(rows)


def _set_rows(docs: DataFrame, size: int, clashes: np.ndarray, emit, schema: str) -> DataFrame:
    """A map over rows: emit(ids, elements, first, numbers, checks) gives a batch for each chunk."""

    def run(batches):
        for part in all_chunks(batches):
            elements, first = shingle_sets(as_column(part.column("text")), size)
            yield emit(part.column("doc_id").cast(pa.int64()), elements, first, *class_numbers(elements, first, clashes))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _members(docs: DataFrame, size: int, clashes: np.ndarray) -> DataFrame:
    def emit(ids, elements, first, numbers, checks):
        columns = [ids, pa.array(np.diff(first)), pa.array(numbers), pa.array(checks)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cls", "check"])

    return _set_rows(docs, size, clashes, emit, "doc_id long, n long, cls long, check long")


def members_of(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, cls, check) of every row, and the numbers that several sets had before they got others."""
    clashes = np.zeros(0, np.int64)
    members = cut_lineage(_members(docs, size, clashes))
    found = members.groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("cls")
    rows = found.limit(MAX_CLASHES + 1).collect()
    if len(rows) > MAX_CLASHES:
        raise ValueError("too many sets with equal hashes")
    if rows:
        clashes = np.sort(np.array([r["cls"] for r in rows], np.int64))
        members = cut_lineage(_members(docs, size, clashes))
    return members, clashes


def _rows_of_classes(numbers: np.ndarray, first: np.ndarray) -> list[int]:
    """One row of each class but the empty one."""
    _, rows = np.unique(numbers, return_index=True)
    return [r for r in rows.tolist() if first[r + 1] > first[r]]


def _signature_rows(docs: DataFrame, size: int, clashes: np.ndarray, bands: Bands) -> DataFrame:
    def emit(ids, elements, first, numbers, checks):
        rows = _rows_of_classes(numbers, first)
        found = [signatures(elements[first[r] : first[r + 1]], bands) for r in rows]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(flat.view(np.int64)), pa.array(np.repeat(numbers[rows], list(map(len, found))).astype(np.int64))],
            ["sig", "cls"],
        )

    return _set_rows(docs, size, clashes, emit, "sig long, cls long")


def _profiles(docs: DataFrame, size: int, clashes: np.ndarray) -> DataFrame:
    def emit(ids, elements, first, numbers, checks):
        rows = _rows_of_classes(numbers, first)
        sets = [elements[first[r] : first[r + 1]] for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(numbers[rows]),
                pa.array(np.diff(first)[rows]),
                pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            ["cls", "n", "sketch", "elements"],
        )

    return _set_rows(docs, size, clashes, emit, "cls long, n long, sketch binary, elements binary")


def _broadcast(rows: DataFrame, n: int) -> DataFrame:
    """The rows, with a broadcast hint if their number allows it."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _verify(pairs: DataFrame, n_pairs: int, profiles: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (cls, other, ...) with whether their whole sets are linked. Only sets that occur in a pair move."""
    sets = profiles.select("cls", "elements")
    targets = pairs.select("other").distinct()
    right = sets.join(_broadcast(targets, n_pairs), sets["cls"] == targets["other"], "left_semi")
    left = sets.withColumnRenamed("elements", "x").join(_broadcast(pairs, n_pairs), "cls")
    both = left.join(right.select(F.col("cls").alias("other"), F.col("elements").alias("y")), "other")

    def run(batches):
        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            hit = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(xs, ys)]
            names = ["cls", "comp", "other", "into"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hit, pa.bool_())], [*names, "linked"])

    return both.select("cls", "comp", "other", "into", "x", "y").mapInArrow(
        run, "cls long, comp long, other long, into long, linked boolean"
    )


def _roots(moves: DataFrame) -> DataFrame:
    """(comp, root) for a forest (comp, into) whose links all lead to smaller numbers, by pointer jumping."""
    moves = cut_lineage(moves)
    while True:
        above = moves.select(F.col("comp").alias("into"), F.col("into").alias("next"))
        jumped = cut_lineage(moves.join(above, "into", "left").select("comp", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")))
        moves = jumped.select("comp", "into")
        if jumped.where("moved").isEmpty():
            return moves.withColumnRenamed("into", "root")


def _representatives(docs: DataFrame, members: DataFrame, wanted: DataFrame, size: int, clashes: np.ndarray) -> tuple[DataFrame, int]:
    """(cls, n, sketch, elements) of each wanted class, made from the row with its smallest id, and their number."""
    reps = cut_lineage(members.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")))
    n_reps = reps.count()
    ids = reps.where("doc_id is not null").select("doc_id")
    rows = docs.join(_broadcast(ids, n_reps), "doc_id", "left_semi").select("doc_id", "text")
    if not reps.where("doc_id is null").isEmpty():  # classes of which no row has an id
        rows = rows.unionByName(docs.where("doc_id is null").select("doc_id", "text"))
    profiles = _profiles(rows, size, clashes).join(_broadcast(reps.select("cls"), n_reps), "cls", "left_semi")
    profiles = cut_lineage(profiles)
    if profiles.count() > n_reps:  # several rows of one id, or without ids
        profiles = cut_lineage(profiles.dropDuplicates(["cls"]))
    return profiles, n_reps


def phases(chunks: int) -> list[int]:
    """The order in which chunks meet: with themselves, with those a power of two away, then with all others."""
    powers = [1 << i for i in range(max(0, (chunks - 1).bit_length()))]
    return [0, *powers, *(t for t in range(3, chunks) if t & (t - 1))]


def _meeting(buckets: DataFrame, phase: int) -> DataFrame:
    """(sig, cls) of what meets in a phase, each pair of chunks under a number of its own."""
    chunk = F.pmod(F.xxhash64("cls"), F.col("chunks"))
    pair = F.least(chunk, chunk.bitwiseXOR(F.lit(phase).cast("long")))
    own = F.when(F.col("chunks") == 1, F.col("sig")).otherwise(F.xxhash64("sig", pair))
    return buckets.where(F.col("chunks") > phase).select(own.alias("sig"), "cls")


def _with_components(buckets: DataFrame, comps: DataFrame | None, n_comps: int) -> DataFrame:
    """The rows with their component, of buckets that have several."""
    if comps is None:
        return buckets.withColumn("comp", F.col("cls"))
    state = buckets.join(_broadcast(comps, n_comps), F.col("cls") == F.col("node"), "left")
    state = state.select(*buckets.columns, F.coalesce("component", "cls").alias("comp"))
    spans = state.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    return state.join(spans.select("sig"), "sig", "left_semi")


def class_components(
    docs: DataFrame, members: DataFrame, size: int, num: int, den: int, clashes: np.ndarray, chunk: int = CHUNK
) -> DataFrame | None:
    """(node, component) of the classes that belong to another one's component; None if there are none."""
    bands = Bands(num, den)
    by_sig = Window.partitionBy("sig")
    rows = (
        _signature_rows(docs, size, clashes, bands)
        .withColumn("least", F.min("cls").over(by_sig))
        .withColumn("most", F.max("cls").over(by_sig))
        .where("least <> most")
        .distinct()
        .withColumn("count", F.count("*").over(by_sig))
        .withColumn("content", F.expr("bit_xor(xxhash64(cls))").over(by_sig))
    )
    shared = cut_lineage(rows)
    one_each = shared.groupBy("count", "content", "least", "most").agg(F.min("sig").alias("sig")).select("sig")
    chunks_of = F.when(F.col("count") <= chunk, 1).otherwise(F.expr(f"shiftleft(1L, cast(ceil(log2(count / {chunk})) as int))"))
    buckets = cut_lineage(shared.join(one_each, "sig", "left_semi").select("sig", "cls", chunks_of.cast("long").alias("chunks")))
    drop_table(shared)
    most = buckets.agg(F.max("chunks")).first()[0]
    if most is None:
        return None
    profiles, n_reps = _representatives(docs, members, buckets.select("cls").distinct(), size, clashes)
    release(docs.sparkSession)
    links = _Links(profiles, n_reps, bands)
    for phase in phases(most):
        if phase:
            buckets = cut_lineage(_with_components(buckets.where(F.col("chunks") > 1), links.comps, n_reps).drop("comp"))
            most = buckets.agg(F.max("chunks")).first()[0]
            if most is None:
                break
            if phase >= most:
                continue
        links.settle(_meeting(buckets, phase))
    drop_table(profiles)
    return links.comps


class _Links:
    """Components found so far, and pairs known not to be linked."""

    def __init__(self, profiles: DataFrame, n_classes: int, bands: Bands):
        self.profiles, self.n_classes, self.bands = profiles, n_classes, bands
        self.comps: DataFrame | None = None
        self.failed: DataFrame | None = None
        self.n_failed = 0

    def settle(self, buckets: DataFrame) -> None:
        """Rounds until no bucket of (sig, cls) holds an undecided pair of different components."""
        bands = self.bands
        light = self.profiles.select("cls", "n", "sketch")
        kinds = "sig long, cls long, comp long, other long, into long, apart long"
        while True:
            state = _with_components(buckets, self.comps, self.n_classes)
            if self.failed is None:
                state = state.withColumn("failed", F.lit(None).cast("array<bigint>"))
            else:
                sides = self.failed.unionByName(self.failed.select(F.col("other").alias("cls"), F.col("cls").alias("other")))
                sides = sides.groupBy("cls").agg(F.collect_set("other").alias("failed"))
                state = state.join(_broadcast(sides, 2 * self.n_failed), "cls", "left")
            state = state.join(light, "cls").repartition("sig").sortWithinPartitions("sig")
            proposed = cut_lineage(state.mapInArrow(lambda batches: _buckets(batches, bands), kinds))
            # a bucket without a proposal has no undecided pair, and never will have one again
            buckets = cut_lineage(buckets.join(proposed.select("sig").distinct(), "sig", "left_semi"))
            offers = F.array_sort(F.collect_set(F.struct("apart", "into", "other", "comp")))
            chosen = proposed.groupBy("cls").agg(offers.alias("p"))
            few = F.when(F.col("p")[0]["apart"] == 0, F.slice("p", 1, 1)).otherwise(F.slice("p", 1, 2 * NEAREST))
            chosen = chosen.withColumn("p", few)
            pairs = cut_lineage(chosen.select("cls", F.explode("p").alias("p")).select("cls", "p.comp", "p.other", "p.into"))
            drop_table(proposed)
            n_pairs = pairs.count()
            if not n_pairs:
                return
            decided = cut_lineage(_verify(pairs, n_pairs, self.profiles, bands.num, bands.den))
            bad = decided.where("not linked").select("cls", "other")
            self.n_failed += bad.count()
            self.failed = bad if self.failed is None else cut_lineage(self.failed.unionByName(bad))
            roots = _roots(decided.where("linked").groupBy("comp").agg(F.min("into").alias("into")))
            if self.comps is None:
                self.comps = roots.select(F.col("comp").alias("node"), F.col("root").alias("component"))
            else:
                # classes of moved components follow them; components that were a class alone come in
                comps = self.comps
                old = comps.join(roots, comps["component"] == roots["comp"], "left").select(
                    "node", F.coalesce("root", "component").alias("component")
                )
                fresh = roots.join(comps, roots["comp"] == comps["node"], "left_anti").select(
                    F.col("comp").alias("node"), F.col("root").alias("component")
                )
                self.comps = cut_lineage(old.unionByName(fresh))
            release(self.profiles.sparkSession)


def _with_classes(docs: DataFrame, size: int, clashes: np.ndarray) -> tuple[DataFrame, str, str]:
    """All columns of ``docs``, the number of shingles and the class; and the names of these two."""
    n, cls = fresh_name("n_shingles", docs.columns), fresh_name("class_id", docs.columns)

    def run(batches):
        for part in all_chunks(batches):
            elements, first = shingle_sets(as_column(part.column("text")), size)
            more = [pa.array(np.diff(first)), pa.array(class_numbers(elements, first, clashes)[0])]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, n, cls])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(n, LongType()), StructField(cls, LongType())])), n, cls


def join_components(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of ``docs`` (doc_id, text)."""
    return _components(docs, size, num, den)[0].drop("component")


def _components(docs: DataFrame, size: int, num: int, den: int, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """As ``join_components``, with a number of the component that is there for null ids too; and the clashes."""
    small_batches(docs.sparkSession)
    members, clashes = members_of(docs, size)
    comps = class_components(docs, members, size, num, den, clashes, chunk)
    classes = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    if comps is None:
        named = classes.select("cls", F.col("least").alias("component_id"), F.col("cls").alias("component"))
    else:
        named = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "component", F.coalesce("component", "cls")
        )
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(least, "component").select("cls", "component_id", "component")
    found = members.join(named, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("cls").alias("class_id"),
        "component",
    )
    return found, clashes


def keep_one_each(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each component, that with its smallest id, a null one if there is no other; all columns unchanged.
    Rows without words stay. Of rows of one id and different texts, each is judged by its own text."""
    found, clashes = _components(docs, size, num, den)
    found = cut_lineage(found)
    n_rows, n_ids = found.count(), found.where("doc_id is not null").select("doc_id").distinct().count()
    if n_ids == n_rows:
        drops = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
        n_drops = drops.count()
        return docs.join(F.broadcast(drops) if n_drops <= BROADCAST_ROWS else drops, "doc_id", "left_anti").select(*docs.columns)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_id"))
    best = found.where("n_shingles > 0").groupBy("component").agg(best.alias("best"))
    rows, n, cls = _with_classes(docs, size, clashes)
    own, best_class = fresh_name("best_id", rows.columns), fresh_name("best_class", rows.columns)
    best = best.select(F.col("best.doc_id").alias(own), F.col("best.class_id").alias(best_class))
    each = rows.where(F.col(n) > 0).dropDuplicates(["doc_id", cls])  # merged per task before the shuffle
    each = each.join(best, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(cls) == F.col(best_class)), "left_semi")
    return rows.where(F.col(n) == 0).unionByName(each).select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k:k + 3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.other)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.id = d.doc_id GROUP BY d.doc_id, n.n
"""
