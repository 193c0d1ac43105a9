"""Byte-level BPE encoding and decoding with finite-state machines (operator 2).

``Transducer`` compiles the merges (here: the ranks) into a transducer. Its nondeterministic form reads
bytes along a trie of the tokens and may close a token and start the next wherever the two may stand side by
side; a token sequence is the BPE encoding of its bytes exactly when every adjacent pair may. Determinised, a
state is the set of runs that are still open: each is the tokens it has closed but not yet emitted, and the
trie node of its open token. States and transitions are made when first met and kept. Tokens that all open
runs agree on are emitted at once; a run whose open token cannot go on dies, so the lookahead is at most the
longest token.

``Utf8Decoder`` turns a stream of ids into text: whole characters go out, and the state of the automaton of
UTF-8, at most three bytes of an unfinished one, is carried from token to token and between calls.

``encode`` is a map over rows. Pre-tokens are encoded separately and repeat often, so each worker keeps their
ids in a bounded table and the transducer reads those that miss it. The rank file is read on the driver and
broadcast (1 MB). Null texts count as empty; an empty text has no ids; repeated rows and null ids pass
through; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeflow.llm.pretokens import Pieces, PreTokenCache
from cladeflow.llm.textops import all_chunks, small_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MAX_STATES = 200_000


def read_ranks(path: str) -> bytes:
    """The content of a rank file (token in base64, rank)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Transducer:
    """Text bytes to token ids, by a lazily determinised transducer."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.halves: dict[int, tuple[int, int]] = {}  # the merge that makes a token
        self.merged: dict[tuple[int, int], int] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.pairs: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            node = 0
            for byte in token:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = below
            self.token_at[node] = rank
            if len(token) > 1:
                left, right = self._merge_of(token, rank)
                self.halves[rank] = left, right
                self.merged[left, right] = rank
        self._forget()

    def _merge_of(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: what is left when all earlier merges are done."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                raise ValueError(f"rank {rank} is no merge of two earlier tokens")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether no merge across their border would come before those that make the tokens up.

        Merges are undone from the latest; what then stands at the border must not have been merged by
        a rank lower than that of the merges still in force.
        """
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self._adjacent(a, b)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        bound = 1 << 62  # merges from here on have been undone
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            # undo the later of the two merges at the border; of equal ones BPE does the left one first
            l_rank = left if left in self.halves else -1
            r_rank = right if right in self.halves else -1
            if l_rank < 0 and r_rank < 0:
                return True
            if l_rank > r_rank:
                bound, left = l_rank, self.halves[left][1]
            else:
                bound, right = r_rank + 1, self.halves[right][0]

    def _forget(self) -> None:
        # a run: last emitted or closed token, tokens closed but not emitted, trie node of the open token
        self.states: list[tuple] = [((-1, (), 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.tails: dict[int, tuple[int, ...]] = {}

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Runs stay in the order in which their open tokens began; at most one of them closes a token."""
        runs, whole, children, token_at = [], None, self.children, self.token_at
        for before, closed, node in self.states[state]:
            below = children[node].get(byte)
            if below is None:
                continue
            if children[below]:
                runs.append((before, closed, below))
            token = token_at[below]
            if token >= 0 and whole is None and (before < 0 or self.adjacent(before, token)):
                whole = (token, (*closed, token), 0)
        if whole is not None:
            runs.append(whole)
        common = runs[0][1]
        if common:
            for _, closed, _ in runs:
                same = 0
                while same < len(common) and same < len(closed) and closed[same] == common[same]:
                    same += 1
                common = common[:same]
            if common:
                cut = len(common)
                runs = [(before, closed[cut:], node) for before, closed, node in runs]
        key = tuple(runs)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number, common

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self._forget()
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in data:
            key = state << 8 | byte
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        tail = self.tails.get(state)
        if tail is None:  # the one run that has closed all it read
            tail = self.tails[state] = next(closed for _, closed, node in self.states[state] if node == 0)
        out += tail
        return out


class Utf8Decoder:
    """Ids to text, in pieces, by the automaton of UTF-8.

    Its state is the bytes of an unfinished character, three at most, which wait between calls. A step reads a
    whole token: it goes through the automaton byte by byte when first met in a state and is kept, in ``steps`` and,
    for the empty state, in ``fresh``, which the decoders of a vocabulary share. Bytes that no character can have
    become U+FFFD, one for the longest beginning of a character.
    """

    def __init__(self, tokens: list[bytes], like: Utf8Decoder | None = None):
        self.tokens, self.state = tokens, b""
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {} if like is None else like.steps
        self.fresh: list[tuple[str, bytes] | None] = [None] * len(tokens) if like is None else like.fresh

    @staticmethod
    def next_bytes(state: bytes) -> tuple[int, int]:
        """Least and greatest byte that may follow the beginning of a character."""
        if len(state) == 1:
            return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(state[0], (0x80, 0xBF))
        return 0x80, 0xBF

    def _step(self, state: bytes, token: bytes) -> tuple[str, bytes]:
        out = []
        for byte in token:
            if state:
                low, high = self.next_bytes(state)
                if low <= byte <= high:
                    state += bytes([byte])
                    length = 2 + (state[0] >= 0xE0) + (state[0] >= 0xF0)
                    if len(state) == length:
                        code = state[0] & (0x7F >> length)
                        for more in state[1:]:
                            code = code << 6 | more & 0x3F
                        out.append(chr(code))
                        state = b""
                    continue
                out.append("\ufffd")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                state = bytes([byte])
            else:
                out.append("\ufffd")
        return "".join(out), state

    def feed(self, ids: list[int]) -> str:
        state, steps, fresh, out = self.state, self.steps, self.fresh, []
        for number in ids:
            step = steps.get((state, number)) if state else fresh[number]
            if step is None:
                step = self._step(state, self.tokens[number])
                if not state:
                    fresh[number] = step
                else:
                    if len(steps) > MAX_STATES:
                        steps.clear()
                    steps[state, number] = step
            text, state = step
            out.append(text)
        self.state = state
        return "".join(out)

    def close(self) -> str:
        rest, self.state = self.state, b""
        return "\ufffd" if rest else ""


class Codec:
    """Texts to ids and back, with the ids of frequent pre-tokens at hand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.transducer = Transducer(ranks)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = list(map(str, range(len(self.tokens))))
        self.automaton = Utf8Decoder(self.tokens)
        self.cache = PreTokenCache(lambda texts: [self.transducer.encode(t.encode()) for t in texts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.ids(Pieces(texts))

    def decode(self, ids: list[int], step: int = 4096) -> str:
        decoder = Utf8Decoder(self.tokens, self.automaton)
        return "".join([*(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)), decoder.close()])


_codecs: dict[str, Codec] = {}


def codec(content: bytes) -> Codec:
    """One codec for a worker and rank file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(content))
    return _codecs[key]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row."""
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        for part in all_chunks(batches):
            ids, first = codec(ranks.value).encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(first.astype(np.int32), ids)],
                ["doc_id", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Number and digest of each row's ids, and the digest of what they decode to."""
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        for part in all_chunks(batches):
            both = codec(ranks.value)
            flat, first = both.encode([t or "" for t in part.column("text").to_pylist()])
            flat, first = flat.tolist(), first.tolist()
            digests, decoded = [], []
            for a, b in zip(first[:-1], first[1:]):
                ids = flat[a:b]
                digests.append(hashlib.sha256(" ".join(map(both.names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(both.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").cast(pa.int64()),
                    "n_tokens": np.diff(first).astype(np.int64),
                    "ids_sha256": pa.array(digests, pa.string()),
                    "decoded_sha256": pa.array(decoded, pa.string()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
