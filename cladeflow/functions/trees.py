"""Reference trees: newick, edge numbers, and the way between rooted and unrooted numbering.

An unrooted tree is three subtrees around a top node. Edges are numbered in postorder; an edge is named by
its lower end. A rooted tree is unrooted by joining the two edges at its root, and its own numbers, in
postorder of the rooted tree, are kept beside.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

DEFAULT_LENGTH = -math.log(0.9)
_TOKEN = re.compile(r"\s*(?:(\[[^\]]*\])|(\()|(\))|(,)|(;)|:\s*([^\s,();\[{]+)|'((?:[^']|'')*)'|([^\s,():;\[\]{]+)|\{(\d+)\})")


@dataclass
class Node:
    label: str = ""
    length: float | None = None
    children: list[Node] = field(default_factory=list)
    number: int = -1

    def postorder(self) -> Iterator[Node]:
        stack: list[tuple[Node, int]] = [(self, 0)]
        while stack:
            node, k = stack.pop()
            if k < len(node.children):
                stack.append((node, k + 1))
                stack.append((node.children[k], 0))
            else:
                yield node


def parse_newick(text: str) -> Node:
    """The top node; deep trees need no recursion."""
    stack: list[Node] = []
    node, at, done = Node(), 0, False
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m or done:
            raise ValueError(f"no newick at position {at}")
        at = m.end()
        comment, opens, closes, comma, end, length, quoted, label, number = m.groups()
        if opens:
            stack.append(node)
            node = Node()
            stack[-1].children.append(node)
        elif comma or closes:
            if not stack:
                raise ValueError("unbalanced newick")
            if comma:
                node = Node()
                stack[-1].children.append(node)
            else:
                node = stack.pop()
        elif length is not None:
            node.length = float(length)
        elif quoted is not None:
            node.label = quoted.replace("''", "'")
        elif label is not None:
            node.label = label
        elif number is not None:
            node.number = int(number)
        elif end:
            done = True
    if stack or not done:
        raise ValueError("unbalanced newick")
    return node


@dataclass
class Rooting:
    """How edges of the unrooted tree are numbered in the rooted one."""

    numbers: list[int]  # of the edges; that of the joined edge is the distal one
    root_edge: int
    distal_edge: int
    distal_length: float
    proximal_edge: int
    proximal_length: float

    def of(self, edge: int, distal: float) -> tuple[int, float]:
        """Rooted edge and distal length of a placement."""
        if edge != self.root_edge:
            return self.numbers[edge], distal
        if distal > self.distal_length:
            return self.proximal_edge, self.proximal_length - (distal - self.distal_length)
        return self.distal_edge, distal


class Tree:
    """A binary reference tree with numbered edges."""

    def __init__(self, newick: str, preserve_rooting: bool = True):
        top = parse_newick(newick)
        self.rooted_top: Node | None = None
        self.rooting: Rooting | None = None
        if len(top.children) == 2:
            self.rooted_top = top
            top = self._unroot(top, preserve_rooting)
        if len(top.children) != 3 or any(len(n.children) not in (0, 2) for n in top.postorder() if n is not top):
            raise ValueError("the tree is not binary")
        self.top = top
        self.edges = [n for n in top.postorder() if n is not top]
        for number, node in enumerate(self.edges):
            node.number = number
            if not node.length:
                node.length = DEFAULT_LENGTH
        self.tips = [n for n in self.edges if not n.children]
        if len(self.tips) < 3:
            raise ValueError("the tree has fewer than three tips")
        if len({t.label for t in self.tips}) < len(self.tips):
            raise ValueError("two tips have one label")

    def _unroot(self, root: Node, preserve: bool) -> Node:
        left, right = root.children
        numbers = {id(n): k for k, n in enumerate(n for n in root.postorder() if n is not root)}
        near, far = (right, left) if left.children else (left, right)  # near: whose edge keeps its lower end
        if not far.children:
            raise ValueError("the tree has fewer than three tips")
        joined = Node(near.label, (left.length or 0.0) + (right.length or 0.0), near.children)
        kept = list(far.children)
        top = Node(far.label, None, [*kept, joined] if left.children else [joined, *kept])
        if preserve:
            order = [n for n in top.postorder() if n is not top]
            self.rooting = Rooting(
                [numbers[id(near)] if n is joined else numbers[id(n)] for n in order],
                order.index(joined),
                numbers[id(near)],
                near.length or 0.0,
                numbers[id(far)],
                far.length or 0.0,
            )
        return top

    def set_lengths(self, lengths: dict[int, float]) -> None:
        """Other lengths for some edges. The joined edge of a tree whose rooting is kept has two parts and stays."""
        for number, length in lengths.items():
            if length <= 0:
                raise ValueError("lengths must be positive")
            if self.rooting is not None and number == self.rooting.root_edge:
                raise ValueError("the edge holds the root")
            self.edges[number].length = length

    @property
    def n_edges(self) -> int:
        return len(self.edges)

    @property
    def total_length(self) -> float:
        return sum(n.length for n in self.edges)

    def newick(self, precision: int = 10) -> str:
        """With edge numbers in braces, of the rooted tree if its rooting is kept."""
        if self.rooting is not None:
            order = [n for n in self.rooted_top.postorder() if n is not self.rooted_top]
            return self._write(self.rooted_top, {id(n): k for k, n in enumerate(order)}, precision)
        return self._write(self.top, {id(n): n.number for n in self.edges}, precision)

    @staticmethod
    def _write(top: Node, numbers: dict[int, int], precision: int) -> str:
        done: dict[int, str] = {}
        for node in top.postorder():
            inner = "(" + ",".join(done.pop(id(c)) for c in node.children) + ")" if node.children else ""
            text = inner + node.label
            if node is not top:
                text += f":{node.length or 0.0:.{precision}f}{{{numbers[id(node)]}}}"
            done[id(node)] = text
        return done[id(top)] + ";"

    def rows(self) -> list[tuple[int, str, float, bool, list[int]]]:
        """(edge, label of the lower end, length, whether it is a tip, edges below) of every edge."""
        return [(n.number, n.label, n.length, not n.children, [c.number for c in n.children]) for n in self.edges]
