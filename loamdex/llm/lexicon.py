"""A minimal acyclic transducer from words (byte strings) to sequences of ids, in flat arrays that can be memory-mapped.

Words are added in sorted order and equal suffixes are shared as they become final (incremental minimisation). Each
state holds the number of words below it, so that the sum of what is passed over on the way numbers the word: the
transducer's output. The ids of all words stand in one array at that number.
"""

from __future__ import annotations

import io
import mmap
import tempfile

import numpy as np

PARTS = ("first", "label", "target", "skip", "final", "offset", "ids")


def build(entries: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton of distinct words. State s has the arcs first[s] to first[s + 1], by ascending label."""
    entries = sorted(entries)
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    register: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # states not final yet: is an end, arcs

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            end, arcs = path.pop()
            key = (end, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            parent = path[-1][1]
            parent[-1] = (parent[-1][0], register[key])

    before = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        close(same)
        for byte in word[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        before = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))  # the root is the last state
    below: list[int] = []
    first, label, target, skip = [0], [], [], []
    for end, arcs in states:  # targets come before their parents
        total = int(end)
        for byte, to in arcs:
            label.append(byte)
            target.append(to)
            skip.append(total)
            total += below[to]
        below.append(total)
        first.append(len(label))
    ids = [x for _, xs in entries for x in xs]
    offset = np.cumsum([0, *(len(xs) for _, xs in entries)])
    return {
        "first": np.array(first, "<i4"), "label": np.array(label, "u1"), "target": np.array(target, "<i4"), "skip": np.array(skip, "<i4"),
        "final": np.array([end for end, _ in states], "u1"), "offset": offset.astype("<i4"), "ids": np.array(ids, "<u4"),
    }


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    out.write(np.array([arrays[p].nbytes for p in PARTS], "<i8").tobytes())
    for p in PARTS:
        out.write(arrays[p].tobytes())
        out.write(b"\0" * (-arrays[p].nbytes % 8))
    return out.getvalue()


class Lexicon:
    """Looks words up in a memory-mapped automaton."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # it has no name, so nothing is left behind
            f.write(data)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self._map, "<i8", len(PARTS))
        at, kinds = 8 * len(PARTS), dict(first="<i4", label="u1", target="<i4", skip="<i4", final="u1", offset="<i4", ids="<u4")
        for p, size in zip(PARTS, sizes, strict=True):
            setattr(self, p, np.frombuffer(self._map, kinds[p], int(size) // np.dtype(kinds[p]).itemsize, at))
            at += int(size) + -int(size) % 8
        self.root = len(self.final) - 1
        # Arcs stand by state, then label, so that one sorted key finds an arc.
        self._arcs = (np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first)) << 8) | self.label

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, its transducer output; -1 if it isn't there. All words take a step at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, begin = np.frombuffer(b"".join(words) or b"\0", np.uint8), np.cumsum(size) - size
        state, out, live, step = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), np.arange(len(words)), 0
        missing = np.zeros(len(words), bool)
        while True:
            live = live[size[live] > step]
            if not len(live):
                break
            key = (state[live] << 8) | data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self._arcs, key), max(0, len(self._arcs) - 1))
            good = self._arcs[arc] == key if len(self._arcs) else np.zeros(len(live), bool)
            missing[live[~good]] = True
            live, arc = live[good], arc[good]
            out[live] += self.skip[arc]
            state[live] = self.target[arc]
            step += 1
        return np.where(missing | (self.final[state] == 0), -1, out)

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        numbers = self.numbers(words)
        begin, end = self.offset[numbers].tolist(), self.offset[numbers + 1].tolist()
        return [None if n < 0 else self.ids[b:e].tolist() for n, b, e in zip(numbers.tolist(), begin, end, strict=True)]
