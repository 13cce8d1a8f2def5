"""Minimal acyclic transducers: sorted byte strings to their lexicographic ordinals.

Nodes of the trie of the keys that have equal futures are one state (Revuz, "Minimisation of
acyclic deterministic automata in linear time", 1992: by height, leaves first). An edge
carries how many keys lie before it in its state, so the sum along a key's path is the
key's ordinal. Building and walking are array operations over all nodes of a height and
over all strings at once.
"""

from __future__ import annotations

import io

import numpy as np


def _trie(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent, byte, depth, does a key end here) of every node in preorder; the root is node 0. Keys ascend and differ."""
    last, parent, label, depth, path, at, before = [], [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)], [0], 1, b""
    for key in keys:
        most, same = min(len(before), len(key)), 0
        if before[:most] == key[:most]:
            same = most
        else:
            step = 16
            while before[same : same + step] == key[same : same + step]:
                same += step
            while before[same] == key[same]:
                same += 1
        new = len(key) - same
        ids = np.arange(at, at + new)
        up = ids - 1
        if new:
            up[0] = path[same]
        path[same + 1 :] = range(at, at + new)
        parent.append(up)
        label.append(np.frombuffer(key, np.uint8)[same:])
        depth.append(np.arange(same + 1, len(key) + 1))
        at, before = at + new, key
        last.append(at - 1)
    # keys ascend, so none is a prefix of one before: it ends at its last own node, the empty key at the root
    final = np.zeros(at, dtype=bool)
    final[last] = True
    return np.concatenate(parent), np.concatenate(label), np.concatenate(depth), final


class Transducer:
    """``walk`` gives each string its ordinal among the keys, or -1."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    @classmethod
    def build(cls, keys: list[bytes]) -> Transducer:
        """Of keys in ascending order without repeats."""
        parent, label, depth, final = _trie(keys)
        m = len(parent)
        height, count = np.zeros(m, np.int64), final.astype(np.int64)
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, depth.max() + 2))
        for d in range(len(cuts) - 1, 0, -1):
            at_d = by_depth[cuts[d - 1] : cuts[d]]
            np.maximum.at(height, parent[at_d], height[at_d] + 1)
            np.add.at(count, parent[at_d], count[at_d])

        # edges of a node are consecutive, their bytes ascending
        child = 1 + np.argsort(parent[1:], kind="stable")
        degree = np.bincount(parent[1:], minlength=m)
        first = np.concatenate(([0], np.cumsum(degree)[:-1]))
        state, made = np.full(m, -1, np.int64), 0
        reps: list[np.ndarray] = []
        by_height = np.lexsort((degree, height))
        h, g = height[by_height], degree[by_height]
        runs = np.flatnonzero(np.concatenate(([True], (np.diff(h) != 0) | (np.diff(g) != 0), [True])))
        for lo, hi in zip(runs[:-1], runs[1:]):
            nodes = by_height[lo:hi]
            sig = final[nodes].astype(np.int64)
            for k in range(int(g[lo])):
                edge = child[first[nodes] + k]
                code = (state[edge] << 8) | label[edge]
                _, code = np.unique(code, return_inverse=True)
                _, sig = np.unique(sig * (len(nodes) + 1) + code, return_inverse=True)
            _, rep, own = np.unique(sig, return_index=True, return_inverse=True)
            state[nodes] = made + own
            reps.append(nodes[rep])
            made += len(rep)

        rep = np.concatenate(reps)
        n = degree[rep]
        owner = np.repeat(np.arange(made), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        edge = child[first[rep][owner] + nth]
        byte, less = label[edge].astype(np.int64), np.cumsum(count[edge]) - count[edge]
        start = np.repeat(less[np.minimum(np.cumsum(n) - n, max(len(less) - 1, 0))], n) if len(less) else less
        add = less - start + final[rep][owner]
        # a state's edges lie in a row from its least byte to its greatest
        low, width = np.zeros(made, np.int64), np.zeros(made, np.int64)
        some = n > 0
        if some.any():
            low[some] = byte[(np.cumsum(n) - n)[some]]
            width[some] = byte[np.cumsum(n)[some] - 1] - low[some] + 1
        off = np.cumsum(width) - width
        slots = int(width.sum())
        to, plus = np.full(slots, -1, np.int32), np.zeros(slots, np.int32)
        place = off[owner] + byte - low[owner]
        to[place], plus[place] = state[edge], add
        a = {"off": off.astype(np.int64), "low": low.astype(np.int16), "width": width.astype(np.int16), "final": final[rep], "to": to, "plus": plus}
        return cls(a | {"root": np.array([state[0]], np.int64), "n": np.array([count[0]], np.int64)})

    def __len__(self) -> int:
        return int(self.a["n"][0])

    @property
    def states(self) -> int:
        return len(self.a["off"])

    @property
    def root(self) -> int:
        return int(self.a["root"][0])

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state or -1, what the edge adds) for states >= 0."""
        a = self.a
        i = byte.astype(np.int16) - a["low"][state]
        ok = (i >= 0) & (i < a["width"][state])
        e = np.where(ok, a["off"][state] + i, 0)
        if not len(a["to"]):
            return np.full(len(state), -1, np.int32), np.zeros(len(state), np.int32)
        return np.where(ok, a["to"][e], -1), a["plus"][e]

    def lead(self, prefix: bytes) -> tuple[int, int]:
        """(state, ordinal so far) after a prefix; state -1 if no key has it."""
        state, ordinal = np.array([self.root]), 0
        for b in prefix:
            state, more = self.step(state, np.array([b]))
            if state[0] < 0:
                return -1, 0
            ordinal += int(more[0])
        return int(state[0]), ordinal

    def walk(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
        """Ordinals (or -1) of the strings data[start : start + length], each read from its own state on."""
        out = np.full(len(start), -1, np.int64)
        live = np.flatnonzero(state >= 0)
        state, ordinal, start, left = state[live], ordinal[live], start[live], length[live]
        while len(live):
            end = left == 0
            if end.any():
                at = end.copy()
                at[end] = self.a["final"][state[end]]
                out[live[at]] = ordinal[at]
                on = ~end
                live, state, ordinal, start, left = live[on], state[on], ordinal[on], start[on], left[on]
            to, more = self.step(state, data[start])
            on = to >= 0
            live, state, ordinal, start, left = live[on], to[on], ordinal[on] + more[on], start[on] + 1, left[on] - 1
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.a)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        with np.load(io.BytesIO(data)) as z:
            return cls({k: z[k] for k in z.files})
