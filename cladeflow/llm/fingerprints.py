"""Document fingerprints from closed syncmers (operator 1).

A k-mer of code points is an anchor when the smallest hash of its inner s-mers lies at its first or last
place. That depends on the k-mer alone, so an edit disturbs anchors only where it touches them, and at most
``k - s`` code points separate two anchors. The fingerprint lists all anchors in text order, ten hex digits
each: two for the distance from the anchor before (from the text's start for the first), eight for the
k-mer's hash; positions can be summed up from it. A text shorter than ``k`` is one anchor as a whole; an
empty or null one has the empty fingerprint. Matching is positional: anchors match when both their k-mers and
their distances from the anchors before them agree, so anchors in other surroundings do not. Likeness is the
share of distinct anchors that match, 2|A and B| / (|A| + |B|), 1.0 between two empty fingerprints.

``fingerprint_edits`` needs each document's successor in descending id order. Rows are dealt to ranges of
ids whose bounds come from a sample of the ids by hash, and are found by binary search; the first row of each
range is copied to the range before it, and every range is sorted and streamed with one chunk in memory. The
text crosses the network once; no window over the whole table is made. The driver holds ``SAMPLED`` ids per
range, of which there are at most ``MAX_PARTS``; larger tables get larger ranges. Null ids come last; rows
with equal ids are ordered by text, so repeated rows follow each other, and are in one range. An empty table
gives no rows; a single row is its own successor. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.textops import CHUNK_BYTES, Hasher, codepoints, distinct, mix, sliding_min, small_batches

K, S = 16, 6
MAX_PARTS = 400_000
SAMPLED = 10
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_anchors long"
)


class Anchors:
    """Anchors of many texts: row, position and 32-bit hash of each, in text order."""

    def __init__(self, rows: np.ndarray, positions: np.ndarray, hashes: np.ndarray, n: int):
        self.rows, self.positions, self.hashes = rows, positions, hashes
        self.first = np.searchsorted(rows, np.arange(n + 1))
        gaps = np.diff(positions, prepend=0)
        fresh = np.diff(rows, prepend=-1) != 0
        gaps[fresh] = positions[fresh]
        self.marks = hashes ^ (gaps.astype(np.uint32) * np.uint32(0x9E3779B1))
        self.packed = np.empty((len(rows), 5), np.uint8)
        self.packed[:, 0] = gaps
        self.packed[:, 1:] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)

    @classmethod
    def of(cls, texts: list[str], k: int = K, s: int = S) -> Anchors:
        return cls(*_find(texts, k, s, True), len(texts))

    def spliced(self, kept: list[int], changed: list[str], k: int = K, s: int = S) -> Anchors:
        """Anchors of texts that agree with these ones in their first ``kept`` code points."""
        kept = [a if len(c) >= k else 0 for a, c in zip(kept, changed)]
        back = np.array([max(0, a - k + 1) if len(c) > a else len(c) for a, c in zip(kept, changed)], np.int64)
        rows, at, hashes = _find([c[b:] for b, c in zip(back.tolist(), changed)], k, s, False)
        old = (self.rows < len(kept)) & (
            self.positions + k <= np.array([*kept, 0])[np.minimum(self.rows, len(kept))]
        )
        short = np.flatnonzero([0 < len(c) < k for c in changed])
        whole = _find([changed[i] for i in short], k, s, True)
        rows = np.concatenate([self.rows[old], rows, short])
        at = np.concatenate([self.positions[old], at + back[rows[old.sum() : len(rows) - len(short)]], whole[1]])
        hashes = np.concatenate([self.hashes[old], hashes, whole[2]])
        order = np.argsort(rows, kind="stable")
        return Anchors(rows[order], at[order], hashes[order], len(changed))

    def strings(self) -> list[str]:
        digits, first = self.packed.tobytes().hex(), self.first * 10
        return [digits[a:b] for a, b in zip(first[:-1], first[1:])]

    def keys(self) -> np.ndarray:
        """Sorted distinct (row, hash of k-mer and distance) pairs as one number each."""
        return distinct((self.rows.astype(np.uint64) << np.uint64(32)) | self.marks)


def _find(texts: list[str], k: int, s: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of all anchors; whole: texts shorter than k are anchors themselves."""
    codes, offsets = codepoints(texts)
    hasher = Hasher(mix(codes.astype(np.uint64) + np.uint64(1)))
    span = k - s + 1
    at = np.zeros(0, np.int64)
    if len(codes) >= k:
        inner = hasher.windows(s)
        least = sliding_min(inner, span)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[span - 1 :] == least))
    rows = np.searchsorted(offsets, at, side="right") - 1
    inside = at + k <= offsets[rows + 1]
    starts, rows = at[inside], rows[inside]
    ends = starts + k
    lengths = np.diff(offsets)
    short = np.flatnonzero((lengths > 0) & (lengths < k)) if whole else []
    if len(short):
        starts, ends = np.concatenate([starts, offsets[short]]), np.concatenate([ends, offsets[short + 1]])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        starts, ends, rows = starts[order], ends[order], rows[order]
    return rows, starts - offsets[rows], (hasher.ranges(starts, ends) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Shares of anchors in common of rows 0 to n-1 of two sets of keys."""
    count = lambda x: np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n)[:n]
    both = np.concatenate([a, b])
    both.sort()
    common = count(both[1:][both[1:] == both[:-1]])
    total = count(a) + count(b)
    return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _slices(texts):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(a, b - a),
                        "n_chars": np.array([len(t) for t in texts[a:b]], np.int64),
                        "fingerprint": pa.array(Anchors.of(texts[a:b], k, s).strings(), pa.string()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _slices(texts: list[str]):
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(ids: list, texts: list[str], k: int, s: int) -> pa.RecordBatch:
    """Results of all rows but the last, which is only the successor of the one before it."""
    n = len(texts) - 1
    changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
    own = Anchors.of(texts, k, s)
    other = own.spliced([len(t) - len(t) // 3 for t in texts[:n]], changed, k, s)
    keys, names = own.keys(), own.strings()
    one = np.uint64(1 << 32)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids[:n], pa.int64()),
            "n_chars": np.array([len(t) for t in texts[:n]], np.int64),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            "fingerprint": pa.array(names[:n], pa.string()),
            "edited_fingerprint": pa.array(other.strings(), pa.string()),
            "near_edited": likeness(keys[keys < np.uint64(n) * one], other.keys(), n),
            "near_next": likeness(keys[keys < np.uint64(n) * one], keys[keys >= one] - one, n),
            "n_anchors": np.diff(own.first)[:n].astype(np.int64),
        }
    )


def _stream(batches, k: int, s: int):
    """Rows sorted by (part, copied, doc_id descending, text): compare each with the one after it."""
    ids, texts, part, held = [], [], None, 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "copied", "doc_id", "text"))
        for number, copied, doc_id, text in zip(*columns):
            if number != part:
                if len(texts) > 1:
                    yield _compare(ids, texts, k, s)
                ids, texts, part, held = [], [], number, 0
            ids.append(doc_id)
            texts.append(text or "")
            held += len(texts[-1])
            if held > CHUNK_BYTES and len(texts) > 1:
                yield _compare(ids, texts, k, s)
                ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield _compare(ids, texts, k, s)


def range_bounds(docs: DataFrame, n_rows: int, n_parts: int) -> np.ndarray:
    """About n_parts - 1 ids that cut the table into ranges of about equal numbers of rows, in ascending order."""
    if n_parts < 2:
        return np.zeros(0, np.int64)
    every = max(1, n_rows // (SAMPLED * n_parts))
    sample = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0))
    sample = sample.groupBy("doc_id").agg(F.count("*").alias("n")).toPandas().sort_values("doc_id")
    if not len(sample):
        return np.zeros(0, np.int64)
    ids, total = sample["doc_id"].to_numpy(np.int64), np.cumsum(sample["n"].to_numpy(np.int64))
    return np.unique(ids[np.searchsorted(total, np.arange(1, n_parts) * total[-1] // n_parts, side="right")])


def _range_of(bounds) -> Callable:
    """A column function: how many of the bounds (a broadcast) are above an id; one range more for null ids."""

    def run(ids: pa.Array) -> pa.Array:
        cuts = bounds.value
        values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        found = len(cuts) - np.searchsorted(cuts, values, side="right")
        found[pc.is_null(ids).to_numpy(zero_copy_only=False)] = len(cuts) + 1
        return pa.array(found.astype(np.int32))

    return F.arrow_udf(run, "int")


def fingerprint_edits(docs: DataFrame, k: int = K, s: int = S, rows_per_part: int = 500) -> DataFrame:
    """Fingerprints of every row, of its edited text, and their likeness; see the module's text."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_rows = docs.count()
    n_parts = min(MAX_PARTS, max(1, -(-n_rows // rows_per_part)))
    part = _range_of(spark.sparkContext.broadcast(range_bounds(docs, n_rows, n_parts)))
    rows = docs.withColumn("part", part("doc_id"))
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    # every range also gets the first row of the one after it, the last range that of the first
    table = spark.createDataFrame([(p, h, heads[i - 1][0]) for i, (p, h) in enumerate(heads)], "part int, head long, before int")
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    copies = (
        rows.join(F.broadcast(table), "part")
        .where(is_head)
        .groupBy("before", "doc_id")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select(F.col("before").alias("part"), F.lit(1).alias("copied"), "doc_id", "text")
    )
    everything = rows.select("part", F.lit(0).alias("copied"), "doc_id", "text").unionByName(copies)
    dealt = everything.repartition(max(1, n_parts // 4), "part").sortWithinPartitions(
        "part", "copied", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()
    )
    return dealt.mapInArrow(lambda batches: _stream(batches, k, s), SCHEMA)
