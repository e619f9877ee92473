"""Substring dedup with suffix automata.

Reference shards are the passages that share a gram (see ``repeats``); since the reference is the corpus itself and
grows with it, each shard's automaton is shipped to the documents that need it by the shuffle instead of to everyone.
An automaton holds the distinct passages of one shard; streaming a passage through it gives, at every word, the length of
the longest match that occurs at least twice. Windows of ``length`` words inside such matches are removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from strata.llm.repeats import Unit, remove_repeats


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the number of places of each state."""

    def __init__(self) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places = [0]

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.edges.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.link) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """A copy of target for the strings that at's strings give with word."""
        copy = self._state(self.edges[target].copy(), self.length[at] + 1, self.link[target])
        self.link[target] = copy
        while at >= 0 and self.edges[at].get(word) == target:
            self.edges[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            target = self.edges[last].get(word)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
            else:
                new = self._state({}, self.length[last] + 1, 0)
                at = last
                while at >= 0 and word not in self.edges[at]:
                    self.edges[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    target = self.edges[at][word]
                    self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
                last = new
            self.places[last] += 1

    def close(self) -> None:
        """Adds up places along suffix links; ``twice`` is the longest suffix of a state that occurs twice."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for v in order:
            if self.link[v] > 0:
                self.places[self.link[v]] += self.places[v]
        self.twice = [0] * len(self.link)
        for v in reversed(order):
            self.twice[v] = self.length[v] if self.places[v] > 1 else self.twice[self.link[v]]

    def matching_statistics(self, sequence: list[int]) -> list[int]:
        """For each word of an added sequence: length of the longest match ending there that occurs at two places."""
        out, v = [], 0
        for i, word in enumerate(sequence):
            v = self.edges[v][word]
            out.append(min(i + 1, self.twice[v]))
        return out


class AutomatonMatcher:
    def __init__(self, length: int) -> None:
        self.length = length

    def __call__(self, groups: list[list[bytes]]) -> list[list[np.ndarray]]:
        return [self._group(g) for g in groups]

    def _group(self, contents: list[bytes]) -> list[np.ndarray]:
        ids: dict[bytes, int] = {}
        shard = [[ids.setdefault(w, len(ids)) for w in x.split(b" ")] for x in contents]
        automaton = SuffixAutomaton()
        for sequence in shard:
            automaton.add(sequence)
        automaton.close()
        return [np.flatnonzero(np.array(automaton.matching_statistics(s)) >= self.length) - self.length + 1 for s in shard]


def substring_dedup(docs: DataFrame, *, length: int = 35, doc_id: str = "doc_id", text: str = "text", frequent: int = 1024) -> DataFrame:
    """Removes every word that a window of ``length`` words covers whose words also start anywhere else.

    Gives doc_id, n_words, n_removed, spans (word ranges), kept (UTF-8, words joined by one space). Null texts and texts
    of fewer words than a window keep all they have; rows of equal doc_id and text each get their row; all places of a repeated
    window go, so no tie arises; an empty table gives an empty result; other columns are ignored.
    """
    gram = 1 << max(0, (length // 4).bit_length() - 1)
    out = remove_repeats(docs, Unit(True, length, gram), AutomatonMatcher(length), doc_id=doc_id, text=text, frequent=frequent)
    return out.withColumnRenamed("n_units", "n_words").drop("repeats")
