"""Quality rules from repeated passages, found with suffix arrays (operator 8).

For each text a suffix array over its words is built by prefix doubling; all texts of a chunk are sorted
together, the row number being part of the first key, so suffixes of different rows never compare equal.
Longest-common-prefix values of neighbours give each suffix its longest repeat: those with a length of at
least ``min_repeat`` words are the maximal repeated substrings, whose spans are united. A text is rejected
when its base rules fail, when the united spans cover more than ``max_covered`` of its words, or when the
longest repeat is longer than ``max_longest`` words.

Everything is a map over rows: no shuffle, memory bounded by one chunk (or one text, if that is longer).
Null and empty texts have no words and fail the base rules (fewer than ten words); null ids pass through;
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeflow.llm.suffixes import sort_suffixes
from cladeflow.llm.textops import Words, all_chunks, as_column, buffer, row_sums, small_batches

MIN_REPEAT = 8
MAX_COVERED = 0.2
MAX_LONGEST = 50
BASE_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, covered_words long, base_failed boolean, kept boolean"
)


def longest_repeats(codes: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every position, the length of the longest substring from there that occurs twice in its row.

    codes: 64-bit word codes; rows: row of each; ends: where each one's row ends.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((codes, rows))
    same = (codes[order][1:] == codes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    rank, levels = sort_suffixes(order, same, ends)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][1][a] == levels[0][1][b])
    a, b = a[live], b[live]
    got = np.zeros(len(live), np.int64)
    limit = ends[np.minimum(a, n - 1)] if len(a) else a
    for width, names in reversed(levels):
        inside = (a < limit) & (b < limit)
        hit = inside & (names[np.minimum(a, n - 1)] == names[np.minimum(b, n - 1)])
        step = np.where(hit, width, 0)
        got += step
        a += step
        b += step
    common[live] = got
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, suffixes[:-1], common)
    np.maximum.at(longest, suffixes[1:], common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    delta = np.bincount(starts, minlength=n + 1).astype(np.int64)
    np.subtract.at(delta, starts + lengths, 1)
    return np.cumsum(delta[:n]) > 0


def duplicate_lines(words: Words) -> np.ndarray:
    """Number of each row's lines with a word that equal an earlier line of the row."""
    data, offsets = words.data, words.offsets
    stop = np.zeros(len(data) + 1, bool)
    stop[:-1] = data == 10
    breaks = np.flatnonzero(stop)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(data))
    ends = np.where((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10), ends - 1, ends)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~words.blank, out=total[1:])
    full = total[ends] > total[starts]
    starts, ends, rows = starts[full], ends[full], rows[full]
    hashes = words.bytes.ranges(starts, ends)
    order = np.lexsort((hashes, rows))
    same = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return np.bincount(rows[order][1:][same], minlength=len(offsets) - 1).astype(np.int64)


def measures(column: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of the rows of a large_string column."""
    words = Words(*buffer(column))
    data, offsets, first = words.data, words.offsets, words.first
    n, rows = len(words.starts), words.rows
    letter = ~words.blank & ((data & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    ends = np.repeat(first[1:], words.counts)
    repeats = longest_repeats(words.hashes(), rows, ends)
    short = np.flatnonzero(repeats >= BASE_WINDOW)
    long = np.flatnonzero(repeats >= min_repeat)
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, rows, repeats)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": row_sums(letter, offsets),
        "n_symbols": row_sums(symbol[data], offsets),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": row_sums(covered(short, np.full(len(short), BASE_WINDOW), n), first),
        "longest_repeat": longest,
        "covered_words": row_sums(covered(long, repeats[long], n), first),
    }


def verdicts(found: dict[str, np.ndarray], max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each row."""
    n = found["n_words"]
    failed = (n < 10) | (100 * found["n_repeat_words"] > 20 * n)
    rejected = (found["covered_words"] > max_covered * n) | (found["longest_repeat"] > max_longest)
    return failed, ~failed & ~rejected


def quality(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for part in all_chunks(batches):
            found = measures(as_column(part.column("text")), min_repeat)
            failed, kept = verdicts(found, max_covered, max_longest)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id").cast(pa.int64()), **found, "base_failed": failed, "kept": kept}
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def filter_quality(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    schema = docs.schema
    small_batches(docs.sparkSession)
    min_repeat = limits.get("min_repeat", MIN_REPEAT)
    max_covered, max_longest = limits.get("max_covered", MAX_COVERED), limits.get("max_longest", MAX_LONGEST)

    def run(batches):
        for part in all_chunks(batches):
            found = measures(as_column(part.column("text")), min_repeat)
            kept = verdicts(found, max_covered, max_longest)[1]
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, schema)
