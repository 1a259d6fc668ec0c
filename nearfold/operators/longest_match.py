"""Longest-match-first splitting of words into pieces in linear time.

The pieces form two tries, one for the beginning of a word and one for its rest. Every node knows where to go on when
the next letter has no edge: the longest-match pieces that cover what has been read, as far as they are then sure, and
the node for what is left. So a word is read once, letter by letter, whatever its length, while trying every end for
every start takes the square of it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

#: A node and a letter as one number.
_SHIFT = 21


class Matcher:
    """Pieces by name: those that continue a word begin with ``continues``. Holds plain dicts and lists only."""

    def __init__(self, ids: dict[str, int], continues: str) -> None:
        self.edges: dict[int, int] = {}
        #: Per node: piece that ends there (or -1), node to go on with (or -1), pieces that are sure then.
        self.piece, self.link, self.sure = [-1, -1], [-1, -1], [(), ()]
        self.begin, self.rest = 0, 1
        for token, number in ids.items():
            self._insert(self.begin, token, number)
            if token.startswith(continues):
                self._insert(self.rest, token[len(continues) :], number)
        self._connect()

    def _insert(self, node: int, letters: Iterable[str], number: int) -> None:
        start = node
        for letter in letters:
            key = node << _SHIFT | ord(letter)
            node = self.edges.setdefault(key, len(self.piece))
            if node == len(self.piece):
                self.piece.append(-1)
                self.link.append(-1)
                self.sure.append(())
        if node != start:
            self.piece[node] = number

    def _connect(self) -> None:
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.edges.items():
            children.setdefault(key >> _SHIFT, []).append((key & ((1 << _SHIFT) - 1), node))
        queue = deque([self.begin, self.rest])
        while queue:
            parent = queue.popleft()
            for letter, node in children.get(parent, ()):
                queue.append(node)
                if self.piece[node] >= 0:
                    self.link[node], self.sure[node] = self.rest, (self.piece[node],)
                    continue
                back, sure = self.link[parent], self.sure[parent]
                while back >= 0 and back << _SHIFT | letter not in self.edges:
                    back, sure = self.link[back], sure + self.sure[back]
                if back >= 0:
                    self.link[node], self.sure[node] = self.edges[back << _SHIFT | letter], sure

    def split(self, word: str) -> list[int] | None:
        """The pieces of ``word``, or None when a rest matches no piece."""
        edges, link, sure = self.edges, self.link, self.sure
        found: list[int] = []
        node = self.begin
        for letter in map(ord, word):
            next_ = edges.get(node << _SHIFT | letter)
            while next_ is None:
                if link[node] < 0:
                    return None
                found += sure[node]
                node = link[node]
                next_ = edges.get(node << _SHIFT | letter)
            node = next_
        while node > self.rest:
            if link[node] < 0:
                return None
            found += sure[node]
            node = link[node]
        return found
