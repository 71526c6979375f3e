"""Phylogenetic trees in Newick notation: binary, small, kept on the driver and broadcast."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_TOKEN = re.compile(r"\s*([(),;:]|[^(),;:\s]+)")


@dataclass
class Node:
    label: str = ""
    length: float = -1.0
    children: list[Node] = field(default_factory=list)
    prob: Any = None

    def leaves(self) -> list[str]:
        return [self.label] if not self.children else [x for c in self.children for x in c.leaves()]

    def nodes(self) -> list[Node]:
        return [self, *(x for c in self.children for x in c.nodes())]

    def copy(self) -> Node:
        return Node(self.label, self.length, [c.copy() for c in self.children])

    def scaled(self, times: float) -> Node:
        """A tree whose positive branch lengths are multiplied."""
        out = self.copy()
        for n in out.nodes():
            n.length *= times if n.length > 0 else 1
        return out

    def rows(self) -> list[tuple]:
        """(node, parent, side, label, length, leaf index), nodes numbered from the root on, -1 where there is none."""
        out, leaf = [], 0

        def visit(node: Node, parent: int, side: int) -> None:
            nonlocal leaf
            own = len(out)
            out.append(None)
            index = -1
            if not node.children:
                index, leaf = leaf, leaf + 1
            out[own] = (own, parent, side, node.label, node.length, index)
            for s, c in enumerate(node.children):
                visit(c, own, s)

        visit(self, -1, -1)
        return out


def parse(text: str) -> Node:
    """The root. Of more than two children the first two stay; a missing length is -1."""
    tokens = _TOKEN.findall(text.strip().rstrip(";"))
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def node() -> Node:
        nonlocal at
        out = Node()
        if peek() == "(":
            at += 1
            kids = [node()]
            while peek() == ",":
                at += 1
                kids.append(node())
            if peek() != ")":
                raise ValueError("unbalanced tree")
            at += 1
            out.children = kids[:2]
        if peek() not in ("", "(", ")", ",", ":"):
            out.label, at = peek(), at + 1
        if peek() == ":":
            out.length, at = float(tokens[at + 1]), at + 2
        return out

    root = node()
    if at != len(tokens):
        raise ValueError("text after the tree")
    return root
