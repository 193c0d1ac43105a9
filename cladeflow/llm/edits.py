"""Token counts that follow edits (operator 6).

A document is kept as a segment tree: its leaves are blocks of pre-tokens (text, length and token count of
each), its inner nodes hold the characters, tokens and leaves below them. An edit replaces the blocks that it
touches. Only the touched region is split and encoded again: from the last pre-token that ends well before
the edit, since the pattern looks at most ``CONTEXT`` characters ahead, to the first border of old pre-tokens
behind it that the new split has as well; from there on the split cannot differ, for it depends on the
text ahead alone. Blocks of up to twice ``BLOCK`` pre-tokens stay as they are, larger ones are cut evenly, and
inner nodes of more than ``FAN`` children split where that happens, as in a B-tree; small neighbours merge. Sums
are then updated on the path to the root, never elsewhere.

``edited_counts`` builds the tree of every text, applies edits, and returns counts before and after.
``count_trees`` makes a table of trees, which keeps them between jobs, and ``edit_trees`` edits such a table without
encoding anything but the regions touched. Null and empty texts have no tokens; null ids, repeated rows and other
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cladeflow.llm.bpe import parse_ranks, read_ranks
from cladeflow.llm.pretokens import Pieces, PreTokenCache
from cladeflow.llm.textops import all_chunks, small_batches

BLOCK = 32
FAN = 16
CONTEXT = 3
# Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PATTERN = regex.compile(PATTERN)
SCHEMA = "doc_id long, n_tokens long, n_edits int, edited_n_tokens long, edited_sha256 string, reencoded_chars long"

Edit = tuple[int, int, str]


class Block:
    """A leaf."""

    __slots__ = ("text", "lengths", "counts", "chars", "tokens")
    leaves = 1

    def __init__(self, text: str, lengths: list[int], counts: list[int]):
        self.text, self.lengths, self.counts = text, lengths, counts
        self.chars, self.tokens = len(text), sum(counts)


class Node:
    """An inner node of blocks or of nodes."""

    __slots__ = ("below", "chars", "tokens", "leaves")

    def __init__(self, below: list):
        self.below = below
        self.add_up()

    def add_up(self) -> None:
        self.chars = sum(c.chars for c in self.below)
        self.tokens = sum(c.tokens for c in self.below)
        self.leaves = sum(c.leaves for c in self.below)


def _layer(nodes: list) -> list[Node]:
    """Nodes above these, evenly filled."""
    n = -(-len(nodes) // FAN)
    return [Node(nodes[len(nodes) * i // n : len(nodes) * (i + 1) // n]) for i in range(n)]


def _replace(node: Node, low: int, high: int, fresh: list[Block]) -> list[Node]:
    """Nodes to stand for this one when its leaves low to high - 1 have been replaced. Only nodes on the way change."""
    below = node.below
    if isinstance(below[0], Block):
        below[low:high] = fresh
    else:
        at, k, pending = 0, 0, fresh
        while k < len(below):
            child, size = below[k], below[k].leaves
            last = k + 1 == len(below)
            if low < at + size or (pending and (low == high == at + size and last)):
                made = _replace(child, max(0, low - at), min(size, max(0, high - at)), pending)
                below[k : k + 1] = made
                pending = []
                k += len(made)
            else:
                k += 1
            at += size
            if at >= high and not pending:
                break
        k = 0
        while k + 1 < len(below):  # merge small neighbours
            if len(below[k].below) + len(below[k + 1].below) <= FAN // 2:
                below[k : k + 2] = [Node(below[k].below + below[k + 1].below)]
            else:
                k += 1
    if not below:
        return []
    if len(below) > FAN:
        return _layer(below)
    node.add_up()
    return [node]


class TokenTree:
    """Token count of a text under edits. count: number of tokens of one pre-token."""

    def __init__(self, text: str, lengths: list[int], counts: list[int], count: Callable[[str], int]):
        self.count, self.reencoded, self.rebuilt = count, 0, 0
        self.root = self._grown(self._blocks(text, lengths, counts))

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> TokenTree:
        parts = _PATTERN.findall(text)
        return cls(text, list(map(len, parts)), list(map(count, parts)), count)

    @staticmethod
    def _blocks(text: str, lengths: list[int], counts: list[int]) -> list[Block]:
        """Blocks of about ``BLOCK`` pre-tokens; up to twice as many stay together."""
        n = len(lengths)
        parts = -(-n // BLOCK) if n > 2 * BLOCK else min(1, n)
        out, at = [], 0
        for k in range(parts):
            i, j = n * k // parts, n * (k + 1) // parts
            size = sum(lengths[i:j])
            out.append(Block(text[at : at + size], lengths[i:j], counts[i:j]))
            at += size
        return out

    @staticmethod
    def _grown(nodes: list) -> Node:
        while len(nodes) != 1 or isinstance(nodes[0], Block):
            nodes = _layer(nodes) if nodes else [Node([])]
        while len(nodes[0].below) == 1 and isinstance(nodes[0].below[0], Node):
            nodes = nodes[0].below
        return nodes[0]

    def __len__(self) -> int:
        return self.root.chars

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def blocks(self) -> list[Block]:
        layer: list = [self.root]
        while layer and isinstance(layer[0], Node):
            layer = [c for n in layer for c in n.below]
        return layer

    @property
    def text(self) -> str:
        return "".join(b.text for b in self.blocks)

    def state(self) -> tuple[str, list[int], list[int]]:
        """Text, lengths and counts of all pre-tokens: what a tree is made of again."""
        blocks = self.blocks
        return "".join(b.text for b in blocks), [x for b in blocks for x in b.lengths], [x for b in blocks for x in b.counts]

    def _find(self, place: int) -> tuple[int, int]:
        """Number of the block that holds the place, and where it begins."""
        node, begin, number = self.root, 0, 0
        while isinstance(node, Node):
            for child in node.below[:-1]:
                if place < begin + child.chars:
                    break
                begin += child.chars
                number += child.leaves
            else:
                child = node.below[-1]
            node = child
        return number, begin

    def _block(self, number: int) -> Block:
        node = self.root
        while isinstance(node, Node):
            for child in node.below:
                if number < child.leaves:
                    break
                number -= child.leaves
            node = child
        return node

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace text[start:stop]."""
        if not 0 <= start <= stop <= len(self):
            raise ValueError("edit out of range")
        n_blocks = self.root.leaves
        if not n_blocks:
            fresh = TokenTree.of(new, self.count)
            self.reencoded += len(new)
            self.root = fresh.root
            return
        first, begin = self._find(max(0, start - CONTEXT))
        # the first pre-token of the block that may be split differently
        old = [self._block(first)]
        kept, at = 0, begin
        for size in old[0].lengths:
            if at + size > start - CONTEXT:
                break
            at += size
            kept += 1
        last, _ = self._find(min(stop, len(self) - 1))
        take = last + 1
        while True:
            old += [self._block(i) for i in range(first + len(old), take)]
            body = "".join(b.text for b in old)[at - begin :]
            changed = body[: start - at] + new + body[stop - at :]
            shift = len(new) - (stop - start)
            whole = take >= n_blocks
            ahead = "" if whole else self._block(take).text[:CONTEXT]
            borders, place = {}, begin
            index = 0
            for b in old:
                for size in b.lengths:
                    borders[place] = index
                    place += size
                    index += 1
            borders[place] = index
            lengths, counts, here, joined = [], [], at, None
            for part in _PATTERN.findall(changed + ahead):
                if here >= start + len(new) and here - shift >= stop and here - shift in borders:
                    joined = borders[here - shift]
                    break
                if here + len(part) > at + len(changed):
                    break  # reaches into what is only looked at
                lengths.append(len(part))
                counts.append(self.count(part))
                here += len(part)
            if joined is None and whole and here == at + len(changed):
                joined = index
            if joined is not None:
                break
            take = min(n_blocks, take + max(1, take - first))
        self.reencoded += here - at
        old_lengths = [x for b in old for x in b.lengths]
        old_counts = [x for b in old for x in b.counts]
        text = "".join(b.text for b in old)
        text = text[: at - begin] + changed
        lengths = old_lengths[:kept] + lengths + old_lengths[joined:]
        counts = old_counts[:kept] + counts + old_counts[joined:]
        if len(lengths) < BLOCK // 2 and take < n_blocks:  # too small a block takes in the next one
            after = self._block(take)
            text, lengths, counts = text + after.text, lengths + after.lengths, counts + after.counts
            take += 1
        self.rebuilt += take - first
        self.root = self._grown(_replace(self.root, first, take, self._blocks(text, lengths, counts)))


def sample_edits(text: str) -> Iterable[Edit]:
    """The edits of the registered query, each against the text that the one before it left: a word goes in
    after the first half, a twelfth of the text is cut out from the first quarter on, the last tenth is
    replaced by the beginning of the text."""
    n = len(text)
    if not n:
        return []
    cut, tenth = n // 12, n // 10
    grown = n + len(" edited")
    left = grown - cut
    return [(n // 2, n // 2, " edited"), (n // 4, n // 4 + cut, ""), (left - tenth, left, text[:tenth])]


def apply_edits(text: str, edits: Iterable[Edit]) -> str:
    for start, stop, new in edits:
        text = text[:start] + new + text[stop:]
    return text


class Counter:
    """Token counts of pre-tokens by a rank file."""

    def __init__(self, content: bytes):
        import tiktoken

        encoding = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=parse_ranks(content), special_tokens={})
        self.cache = PreTokenCache(lambda texts: [encoding.encode_ordinary(t) for t in texts])
        self.one = lambda text: len(encoding.encode_ordinary(text))

    def trees(self, texts: list[str]) -> Iterable[TokenTree]:
        pieces = Pieces(texts)
        counts = self.cache.lookup(pieces)[1].tolist()
        lengths = (pieces.ends - pieces.starts).tolist()
        for text, a, b in zip(texts, pieces.first[:-1].tolist(), pieces.first[1:].tolist()):
            yield TokenTree(text, lengths[a:b], counts[a:b], self.one)


_counters: dict[str, Counter] = {}


def counter(content: bytes) -> Counter:
    key = hashlib.sha256(content).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(content)
    return _counters[key]


def edited_counts(docs: DataFrame, path: str, edits: Callable[[str], Iterable[Edit]] = sample_edits) -> DataFrame:
    """Token counts of every row before and after its edits."""
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        for part in all_chunks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            columns: list[list] = [[], [], [], [], []]
            for text, tree in zip(texts, counter(ranks.value).trees(texts)):
                before, todo = tree.total, list(edits(text))
                for e in todo:
                    tree.edit(*e)
                digest = hashlib.sha256(tree.text.encode()).hexdigest()
                for to, value in zip(columns, (before, len(todo), tree.total, digest, tree.reencoded)):
                    to.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_tokens", "n_edits", "edited_n_tokens", "edited_sha256", "reencoded_chars"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


TREES = "doc_id long, text string, lengths array<int>, counts array<int>, n_tokens long, reencoded_chars long"


def _tree_rows(ids: pa.Array, trees: Iterable[TokenTree]) -> pa.RecordBatch:
    rows = [(*t.state(), t.total, t.reencoded) for t in trees]
    types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns], [c.split()[0] for c in TREES.split(", ")])


def count_trees(docs: DataFrame, path: str) -> DataFrame:
    """A tree of every row, as its text and the lengths and token counts of its pre-tokens."""
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        for part in all_chunks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield _tree_rows(part.column("doc_id"), counter(ranks.value).trees(texts))

    return docs.select("doc_id", "text").mapInArrow(run, TREES)


def edit_trees(trees: DataFrame, path: str, edits: Callable[[str], Iterable[Edit]] = sample_edits) -> DataFrame:
    """The trees of such a table after edits; ``reencoded_chars`` counts the characters encoded for them."""
    small_batches(trees.sparkSession)
    ranks = trees.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        for part in all_chunks(batches):
            made = []
            for row in zip(*(part.column(c).to_pylist() for c in ("text", "lengths", "counts"))):
                tree = TokenTree(*row, counter(ranks.value).one)
                for e in edits(row[0]):
                    tree.edit(*e)
                made.append(tree)
            yield _tree_rows(part.column("doc_id"), made)

    return trees.select("doc_id", "text", "lengths", "counts").mapInArrow(run, TREES)
