"""A lexicon of words with id outputs as a minimal acyclic transducer.

Words with equal sets of endings share their states (the automaton is minimal), each transition carries the number of
words that sort before those it leads to, and the sum along a word's path is the word's place in the list of outputs.
The arrays lie in one file, which every worker on a machine maps into memory.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_FIELDS = (("keys", np.int64), ("weights", np.int64), ("targets", np.int64), ("finals", np.int64), ("starts", np.int64), ("ids", np.int64))


def compile_lexicon(entries: dict[bytes, Sequence[int]], path: str) -> None:
    """Write the transducer of ``entries`` (word -> ids) to ``path``."""
    register: dict[tuple, int] = {}
    counts: list[int] = []

    def frozen(final: bool, edges: list[tuple[int, int]]) -> int:
        """The number of the state with this finality and these edges; equal states are one."""
        key = (final, *edges)
        if key not in register:
            register[key] = len(counts)
            counts.append(final + sum(counts[to] for _, to in edges))
        return register[key]

    words = sorted(entries)
    path_edges: list[list[tuple[int, int]]] = [[]]
    path_final = [False]
    last = b""

    def freeze(depth: int) -> None:
        while len(path_edges) > depth + 1:
            state = frozen(path_final.pop(), path_edges.pop())
            path_edges[-1].append((last[len(path_edges) - 1], state))

    for word in words:
        shared = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        freeze(shared)
        last = word
        for _ in word[shared:]:
            path_edges.append([])
            path_final.append(False)
        path_final[-1] = True
    freeze(0)
    root = frozen(path_final[0], path_edges[0])
    keys, weights, targets = [], [], []
    finals = np.zeros(len(counts) + 1, np.int64)
    finals[-1] = root
    for (final, *edges), state in register.items():
        finals[state] = before = int(final)
        for byte, to in edges:
            keys.append(state * 256 + byte)
            weights.append(before)
            targets.append(to)
            before += counts[to]
    order = np.argsort(np.array(keys, np.int64))
    ids = [entries[w] for w in words]
    arrays = {
        "keys": np.array(keys, np.int64)[order], "weights": np.array(weights, np.int64)[order], "targets": np.array(targets, np.int64)[order],
        "finals": finals, "starts": np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]), "ids": np.array([i for x in ids for i in x], np.int64),
    }
    with open(path, "wb") as out:
        np.array([len(arrays[name]) for name, _ in _FIELDS], np.int64).tofile(out)
        for name, kind in _FIELDS:
            arrays[name].astype(kind).tofile(out)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str) -> None:
        sizes = np.fromfile(path, np.int64, len(_FIELDS))
        at = sizes.nbytes
        for (name, kind), n in zip(_FIELDS, sizes.tolist(), strict=True):
            setattr(self, name, np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind))
            at += n * np.dtype(kind).itemsize

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """The place of each word in the list of outputs, -1 where the lexicon lacks it. All words walk in step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), np.uint8)
        found = np.full(len(words), -1, np.int64)
        state, total = np.full(len(words), self.finals[-1]), np.zeros(len(words), np.int64)
        walking = np.arange(len(words))
        level = 0
        while len(walking):
            done = lengths[walking] == level
            ended = walking[done]
            found[ended] = np.where(self.finals[state[ended]] == 1, total[ended], -1)
            walking = walking[~done]
            if not len(walking) or not len(self.keys):
                break
            keys = state[walking] * 256 + text[starts[walking] + level]
            edge = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            there = self.keys[edge] == keys
            walking, edge = walking[there], edge[there]
            state[walking] = self.targets[edge]
            total[walking] += self.weights[edge]
            level += 1
        return found

    def outputs(self, places: np.ndarray) -> list[bytes]:
        """The ids at these places, as little-endian unsigned 32-bit integers."""
        data = np.asarray(self.ids).astype("<u4").tobytes() if len(places) > len(self.starts) else None
        ends = self.starts[places + 1].tolist()
        begins = self.starts[places].tolist()
        if data is None:
            return [self.ids[a:b].astype("<u4").tobytes() for a, b in zip(begins, ends, strict=True)]
        return [data[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)]
