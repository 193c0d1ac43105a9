"""Removal of repeated passages with FM-indexes over shards of the corpus (operator 4).

A window is ``width`` consecutive words. A word goes if a window that covers it has the same words as a
window that starts earlier, by (doc_id, start).

* Every window has an anchor, the least hashed ``ANCHOR`` words in it, so equal windows have equal anchors.
  Consecutive windows with one anchor form a passage. Copies of a passage are merged in each Arrow batch and
  then by a grouped minimum, so that a passage with any number of copies is one row: the index holds its first
  copy, which all windows of the others repeat. Which of its own windows repeat is for the index to find.
* A passage can only repeat windows of passages with the same anchor. Passages whose anchor has several go to
  the shard of their anchor, as text; those whose anchor has no other passage are done.
* A shard holds about ``SHARD_WORDS`` words. Over its passages an FM-index is built: the Burrows-Wheeler
  transform in a wavelet matrix, and of the suffix array, which is dropped, the intervals of suffixes that
  agree in a whole window, each with its earliest place. Passages are streamed against it from their ends,
  many side by side: backward search gives the interval of the last window, and matching statistics, held at
  the width of a window, are carried on to the left: one step of backward search adds a word in front, and the
  interval that agrees in a whole window is that of the word dropped behind. Windows whose interval has an
  earlier place are reported.
* An anchor with more than ``SPLIT`` passages could not be searched in one shard. Its windows are merged like
  passages, by 128-bit hashes and a grouped minimum of their places: all but the first repeat.
* The windows found, and the starts of first copies, return to their documents by doc_id.

Tables between the steps lie in the shared folder. Texts cross the network twice.

Null and empty texts have no words. Null ids stand for ids from 2**62 on, by hash of the text, so they come
after all others and equal texts without ids count as one document. Rows with equal ids count as one document
too: a window does not repeat itself in another row of its id. Extra columns are ignored by ``repeats`` and
kept by ``remove_repeats``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.storage import cut_lineage, release
from cladeflow.llm.suffixes import sort_suffixes
from cladeflow.llm.textops import Hasher, Words, all_chunks, as_column, buffer, chunks, fresh_name, mix, sliding_min, small_batches, trim

WIDTH = 20
ANCHOR = 5
SPLIT = 20_000
SHARD_WORDS = 400_000
NO_ID = 1 << 62


# --- FM-index --------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many queries at once."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = []
        for level in reversed(range(max(1, int(symbols).bit_length()))):
            bits = (values >> level) & 1
            words = np.zeros((len(values) >> 6) + 1, np.uint64)
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = int(len(values) - bits.sum())
            self.levels.append((level, words, before, zeros))
            values = np.concatenate([values[bits == 0], values[bits == 1]])
        self.begin = self._descend(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.levels:
            block, bit = place >> 6, (place & 63).astype(np.uint64)
            ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << bit) - np.uint64(1)))
            place = np.where((symbol >> level) & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place."""
        return self._descend(symbol, place) - self.begin[symbol]


class FMIndex:
    """Index of many sequences of symbols 1..n that stand end to end; first: their offsets.

    What is kept is the wavelet matrix of the transform and, for windows of ``width`` symbols that occur several
    times, the interval of their suffixes and the least of the ``places`` (one number per symbol) where they begin.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, width: int, places: np.ndarray):
        n, count = len(symbols), len(first) - 1
        rows = np.repeat(np.arange(count, dtype=np.int32), np.diff(first))
        ends = first[1:][rows]
        order = np.argsort(symbols, kind="stable")
        same = symbols[order][1:] == symbols[order][:-1]
        rank, levels = sort_suffixes(order, same, ends, rows.astype(np.int64) - count - 1)
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        before = np.zeros(n, np.int32)
        before[1:] = symbols[:-1]
        before[first[:-1]] = 0  # sequences begin after a separator
        # the separators come first in the suffix order, one for each sequence
        top = int(symbols.max()) if n else 0
        transform = np.concatenate([symbols[first[1:] - 1], before[suffixes]])
        self.less = count + np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.tree, self.count, self.size, self.width = WaveletMatrix(transform, top), count, count + n, width
        self.low, self.high, self.earliest = self._windows(suffixes, ends, levels, places)

    def _windows(self, suffixes, ends, levels, places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of the intervals of several suffixes that agree in a window, and the least place of each."""
        half = 1 << (self.width.bit_length() - 1)  # two prefixes of this length make a window up
        ranks = next((r for w, r in levels if w == half), None)
        none = np.zeros(0, np.int64)
        if ranks is None or len(suffixes) < 2:
            return none, none, none
        long = ends[suffixes] - suffixes >= self.width
        begin = ranks[suffixes]
        end = np.where(long, ranks[np.minimum(suffixes + self.width - half, len(suffixes) - 1)], -1)
        same = long[1:] & long[:-1] & (begin[1:] == begin[:-1]) & (end[1:] == end[:-1])
        edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if not len(low):
            return none, none, none
        inside = np.stack([low, high], axis=1).ravel()
        own = places[suffixes]
        least = np.minimum.reduceat(np.append(own, own[-1]), inside)[::2]
        return low + self.count, high + self.count, least

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.less[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def search(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of the patterns symbols[start:end], and how many of their last symbols match."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        matched = np.zeros(len(starts), np.int64)
        live, step = np.arange(len(starts)), 0
        while len(live):
            live = live[ends[live] - step > starts[live]]
            if not len(live):
                break
            a, b = self.extend(low[live], high[live], symbols[ends[live] - step - 1])
            found = a < b
            live = live[found]
            low[live], high[live] = a[found], b[found]
            matched[live] += 1
            step += 1
        return low, high, matched

    def reports(self, symbols: np.ndarray, first: np.ndarray):
        """Streams sequences that are in the index from their ends. Gives (begins of windows, least place where each
        occurs) for the windows that occur several times, some at a time."""
        at = first[1:] - self.width
        live = np.flatnonzero(at >= first[:-1])
        at, stop = at[live], first[:-1][live]
        low, high, _ = self.search(symbols, at, at + self.width)
        while len(at):
            number = np.searchsorted(self.low, low, side="right") - 1
            known = (number >= 0) & (low < self.high[number]) if len(self.low) else np.zeros(len(low), bool)
            if known.any():
                yield at[known], self.earliest[number[known]]
            # the interval of the window, which is one suffix or one of those kept; then one more symbol in front
            low = np.where(known, self.low[number] if len(self.low) else low, low)
            high = np.where(known, self.high[number] if len(self.low) else high, low + 1)
            on = at > stop
            at, stop = at[on] - 1, stop[on]
            low, high = self.extend(low[on], high[on], symbols[at])


def repeated_windows(codes: np.ndarray, first: np.ndarray, docs: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each passage of a shard, bits of its windows that occur earlier.

    codes: word codes of all passages; first: offsets; docs, starts: where each passage begins.
    """
    count = len(docs)
    ordered = np.sort(codes)
    alphabet = ordered[np.append(True, ordered[1:] != ordered[:-1])]
    symbols = (np.searchsorted(alphabet, codes) + 1).astype(np.int32)
    rows = np.repeat(np.arange(count), np.diff(first))
    place = starts[rows] + np.arange(len(codes)) - first[rows]
    order = np.lexsort((place, docs[rows]))
    step = (np.diff(docs[rows][order]) != 0) | (np.diff(place[order]) != 0)
    key = np.empty(len(codes), np.int32)
    key[order] = np.append(0, np.cumsum(step))
    index = FMIndex(symbols, first, width, key)
    out = np.zeros(count, np.int64)
    for begin, least in index.reports(symbols, first):
        begin = begin[least < key[begin]]
        np.bitwise_or.at(out, rows[begin], np.int64(1) << (begin - first[rows[begin]]))
    return out


# --- passages --------------------------------------------------------------------------------------------


class Passages:
    """Passages of all rows of a chunk: row, first window's word (within the row), windows, anchor, hash."""

    def __init__(self, column: pa.Array, width: int = WIDTH, anchor: int = ANCHOR):
        self.words = words = Words(*buffer(column))
        codes = words.hashes()
        hasher = Hasher(codes)
        n = len(codes)
        ends = np.repeat(words.first[1:], words.counts)
        windows = np.flatnonzero(np.arange(n) + width <= ends)
        if not len(windows):
            self.rows = self.starts = self.windows = self.anchors = self.hashes = np.zeros(0, np.int64)
            return
        grams = hasher.windows(anchor)
        low = np.uint64(max(1, n.bit_length()))
        ranked = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(ranked, width - anchor + 1)[windows]
        at = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        rows = words.rows[windows]
        new = np.append(True, (at[1:] != at[:-1]) | (rows[1:] != rows[:-1]))
        begin = windows[new]
        count = np.diff(np.append(np.flatnonzero(new), len(windows)))
        self.rows, self.windows = rows[new], count
        self.starts = begin - words.first[self.rows]
        self.anchors = grams[at[new]].view(np.int64)
        content = hasher.ranges(begin, begin + count + width - 1)
        self.hashes = mix(content + (at[new] - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _occurrences(docs: DataFrame, width: int) -> DataFrame:
    """Passages, the first copy of each in an Arrow batch."""

    def run(batches):
        for batch in batches:
            parts = []
            for part in chunks(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                p = Passages(as_column(part.column("text")), width)
                parts.append((p.anchors, p.hashes, ids[p.rows], p.starts, p.windows))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
            order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
            columns = [c[order] for c in columns]
            first = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))[: len(order)]
            columns = [c[first] for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns[:3]), pa.array(columns[3].astype(np.int32)), pa.array(columns[4].astype(np.int32))],
                ["anchor", "passage", "doc_id", "start", "windows"],
            )

    return docs.mapInArrow(run, "anchor long, passage long, doc_id long, start int, windows int")


def _cut(docs: DataFrame, width: int) -> DataFrame:
    """Texts of the wanted passages of each row of (text, doc_id, wanted: start, windows, anchor)."""

    def run(batches):
        for part in all_chunks(batches):
            out = []
            words = Words(*buffer(as_column(part.column("text"))))
            for row, (doc_id, wanted) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("wanted").to_pylist())):
                base, limit = int(words.first[row]), int(words.first[row + 1])
                for w in wanted or []:
                    a, b = base + w["start"], base + w["start"] + w["windows"] + width - 1
                    if b <= limit:  # another row of the same id may be shorter
                        text = words.data[words.starts[a] : words.ends[b - 1]].tobytes()
                        out.append((w["anchor"], doc_id, w["start"], w["windows"], text.decode()))
            columns = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "doc_id", "start", "windows", "text"]
            )

    return docs.mapInArrow(run, "anchor long, doc_id long, start int, windows int, text string")


def _split_windows(docs: DataFrame, width: int) -> DataFrame:
    """Hashes and places of all windows of the wanted passages: (a, b, doc_id, at, i), window i of its passage."""

    def run(batches):
        for part in all_chunks(batches):
            words = Words(*buffer(as_column(part.column("text"))))
            codes = words.hashes()
            both = [Hasher(c).windows(width).view(np.int64) for c in (codes, mix(codes))]
            wanted = part.column("wanted")
            rows = pc.list_parent_indices(wanted).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(wanted)
            starts, windows = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "windows"))
            fits = words.first[rows] + starts + windows + width - 1 <= words.first[rows + 1]
            rows, starts, windows = rows[fits], starts[fits], windows[fits]
            which = np.repeat(np.arange(len(rows)), windows)
            i = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = starts[which] + i
            place = words.first[rows[which]] + at
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            columns = [both[0][place], both[1][place], ids[rows[which]], at, i.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["a", "b", "doc_id", "at", "i"])

    return docs.mapInArrow(run, "a long, b long, doc_id long, at long, i int")


def _search(batches, width: int):
    """Stream of passages sorted by shard; an index for each shard."""

    def done(tables):
        table = pa.Table.from_batches(tables)
        words = Words(*buffer(as_column(table.column("text"))))
        docs, starts = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "start"))
        bits = repeated_windows(words.hashes(), words.first, docs, starts, width)
        hit = bits != 0
        trim()
        return pa.RecordBatch.from_arrays(
            [pa.array(docs[hit]), pa.array(starts[hit].astype(np.int32)), pa.array(bits[hit])], ["doc_id", "start", "bits"]
        )

    held, shard = [], None
    for batch in batches:
        numbers = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if shard is not None and numbers[a] != shard:
                yield done(held)
                held = []
            shard = numbers[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield done(held)


def _decisions(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, firsts: start, bits, clear) - the passages of each document that are first copies. Windows whose
    bits are set and not cleared repeat; several entries of one start hold together."""
    spark = docs.sparkSession
    occurrences = _occurrences(docs, width).repartition("anchor")
    firsts = occurrences.groupBy("anchor", "passage").agg(
        F.min(F.struct("doc_id", "start", "windows")).alias("at")
    )
    by_anchor = Window.partitionBy("anchor")
    firsts = cut_lineage(
        firsts.withColumn("others", F.count("*").over(by_anchor)).select(
            F.when(F.col("others") > 1, F.col("anchor")).alias("anchor"),
            (F.col("others") > SPLIT).alias("split"),
            "at.doc_id",
            "at.start",
            "at.windows",
        )
    )
    release(spark)
    shared = firsts.where("anchor is not null")

    def wanted(rows, *columns):
        lists = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
        return docs.join(lists, "doc_id").select("doc_id", "text", "wanted")

    passages = _cut(wanted(shared.where("not split"), "start", "windows", "anchor"), width)
    total = shared.where("not split").agg(F.sum(F.col("windows") + width - 1)).first()[0]
    shards = max(1, -(-int(total or 0) // SHARD_WORDS))
    passages = passages.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = cut_lineage(
        passages.repartition("shard").sortWithinPartitions("shard").mapInArrow(
            lambda batches: _search(batches, width), "doc_id long, start int, bits long"
        )
    )
    release(spark)
    none = F.lit(0).cast("long")
    all_bits = F.when(F.col("split"), F.expr("shiftleft(1L, windows) - 1")).otherwise(none)
    marks = firsts.select("doc_id", "start", all_bits.alias("bits"), none.alias("clear"))
    marks = marks.unionByName(found.withColumn("clear", none))
    split = shared.where("split")
    if not split.isEmpty():
        windows = _split_windows(wanted(split, "start", "windows"), width)
        single = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "at", "i")).alias("w"))
        start = (F.col("w.at") - F.col("w.i")).cast("int").alias("start")
        marks = marks.unionByName(single.select("w.doc_id", start, none.alias("bits"), F.expr("shiftleft(1L, w.i)").alias("clear")))
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "bits", "clear")).alias("firsts"))


def removed_words(column: pa.Array, firsts: pa.Array, width: int) -> tuple[Words, np.ndarray]:
    """The words of the rows, and which of them go."""
    p = Passages(column, width)
    n = len(p.words.starts)
    gone = np.zeros(n + 1, np.int64)
    if not len(p.rows):
        return p.words, gone[:n] > 0
    lists = pc.list_flatten(firsts)
    parents = pc.list_parent_indices(firsts).to_numpy(zero_copy_only=False).astype(np.int64)
    own = (parents << 32) | lists.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    bits, clear = (lists.field(c).to_numpy(zero_copy_only=False) for c in ("bits", "clear"))
    order = np.argsort(own)
    own, bits, clear = own[order], bits[order], clear[order]
    if len(own):  # several entries of one start are joined
        new = np.append(True, own[1:] != own[:-1])
        bits, clear = (np.bitwise_or.reduceat(x, np.flatnonzero(new)) for x in (bits, clear))
        own, bits = own[new], bits & ~clear
    mine = (p.rows.astype(np.int64) << 32) | p.starts
    at = np.searchsorted(own, mine)
    known = np.zeros(len(mine), bool)
    inside = at < len(own)
    known[inside] = own[at[inside]] == mine[inside]
    mask = np.where(known, 0, (np.int64(1) << p.windows) - 1)
    mask[known] = bits[at[known]]
    base = p.words.first[p.rows] + p.starts
    for i in range(int(p.windows.max())):
        hit = base[(mask >> i) & 1 == 1] + i
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + width, -1)
    return p.words, np.cumsum(gone)[:n] > 0


def _with_decisions(docs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """``docs`` with the first copies of each row in one more column, and that column's name."""
    key, firsts = fresh_name("key", docs.columns), fresh_name("firsts", docs.columns)
    no_id = F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), no_id))
    decisions = _decisions(keyed.select(F.col(key).alias("doc_id"), "text"), width)
    decisions = decisions.select(F.col("doc_id").alias(key), F.col("firsts").alias(firsts))
    return keyed.join(decisions, key, "left").drop(key), firsts


def _kept(part, firsts: str, width: int):
    """(word counts, removed counts, kept words of each row as bytes) of a chunk."""
    column = as_column(part.column("text"))
    words, gone = removed_words(column, part.column(firsts), width)
    keep = (~gone).tolist()
    texts = words.data.tobytes()
    kept = []
    for a, b, i, j in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), words.first[:-1].tolist(), words.first[1:].tolist()):
        kept.append(b" ".join(compress(texts[a:b].split(), keep[i:j])))
    total = np.append(0, np.cumsum(gone))
    return words.counts.astype(np.int64), total[words.first[1:]] - total[words.first[:-1]], kept


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    small_batches(docs.sparkSession)
    rows, firsts = _with_decisions(docs.select("doc_id", "text"), width)

    def run(batches):
        for part in all_chunks(batches):
            n_words, n_removed, kept = _kept(part, firsts, width)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(n_words),
                    pa.array(n_removed),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the repeated words; a text that loses words is the others joined by one space."""
    small_batches(docs.sparkSession)
    names = docs.columns
    rows, firsts = _with_decisions(docs, width)

    def run(batches):
        for part in all_chunks(batches):
            _, n_removed, kept = _kept(part, firsts, width)
            old = part.column("text").to_pylist()
            text = [k.decode() if n else t for k, n, t in zip(kept, n_removed.tolist(), old)]
            columns = {c: part.column(c) for c in names}
            columns["text"] = pa.array(text, pa.string())
            if "n_chars" in columns:
                sizes = [len(t) if n else c for t, n, c in zip(text, n_removed.tolist(), columns["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM d),
v AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM w),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS nth FROM v WHERE k + 19 <= n),
m AS (SELECT w.doc_id, w.k, w.word, coalesce(max(CASE WHEN r.nth > 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.k = r.k),
a AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
