"""Deep-shallow sorting of suffixes held in one byte buffer.

Shallow: multikey sorting on eight-byte super-characters, refining only groups
that are still tied, down to ``SHALLOW`` bytes. Deep: suffixes that still agree
share a long prefix; a blind trie orders each such group. A blind trie branches
only at the bytes that tell its members apart; a new suffix goes down without
looking at the bytes between, is compared once with the leaf it reaches, and
branches where the two first differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as big-endian numbers (zeros past the end): a view, no copy for each."""
    return np.ndarray(len(buf), ">u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))


class BlindTrie:
    """Orders byte strings that share a long prefix; equal strings share a leaf."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [-1, [0]]  # leaf: [-1, members]; branch: [depth, {byte: child}]
        for k in range(1, len(strings)):
            self.insert(k)

    def insert(self, k: int) -> None:
        s, node = self.strings[k], self.root
        while node[0] >= 0:  # blind: only the branching bytes are looked at
            depth, children = node
            child = children.get(s[depth] if depth < len(s) else -1)
            node = child if child is not None else next(iter(children.values()))
        other = self.strings[node[1][0]]
        if s == other:
            node[1].append(k)
            return
        same = common_prefix(s, other)
        node, parent, at = self.root, None, None
        while 0 <= node[0] < same:
            parent, at = node, s[node[0]] if node[0] < len(s) else -1
            node = parent[1][at]
        mine = s[same] if same < len(s) else -1
        if node[0] == same:
            node[1][mine] = [-1, [k]]
            return
        branch = [same, {(other[same] if same < len(other) else -1): node, mine: [-1, [k]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][at] = branch

    def ordered(self) -> list[list[int]]:
        """Groups of equal strings, in order of the strings."""
        out, stack = [], [self.root]
        while stack:
            depth, below = stack.pop()
            if depth < 0:
                out.append(below)
            else:
                stack += [below[b] for b in sorted(below, reverse=True)]
        return out


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def deep_shallow(buf: np.ndarray, start: np.ndarray, length: np.ndarray, word: np.ndarray | None = None, first: np.ndarray | None = None, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings buf[start : start + length], and a flag where a string equals the one before it.

    ``first`` is an optional number by which the strings are set apart before any byte;
    ``shallow`` the bytes (in eights) that are sorted before the tries.
    """
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    word = words_at(buf) if word is None else word
    order = np.arange(n) if first is None else np.argsort(first, kind="stable")
    new = np.ones(n, bool)  # a place in the order where a group starts
    new[1:] = False if first is None else first[order[1:]] != first[order[:-1]]
    for depth in range(0, shallow, 8):
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group, who = np.cumsum(new)[tied], order[tied]
        left = np.clip(length[who] - depth, 0, 8)
        at = np.minimum(start[who] + depth, max(len(word) - 1, 0))
        key = word[at].astype(np.uint64) >> ((8 - left) * 8).astype(np.uint64) % np.uint64(64)
        key = np.where(left > 0, key << ((8 - left) * 8).astype(np.uint64) % np.uint64(64), np.uint64(0))
        sub = np.lexsort((left, key, group))
        order[tied] = who[sub]
        g, v, m = group[sub], key[sub], left[sub]
        new[tied[1:]] |= (v[1:] != v[:-1]) | (m[1:] != m[:-1]) | (g[1:] != g[:-1])
    equal = np.zeros(n, bool)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    if len(tied):  # groups whose members are all equal need no trie
        head = starts[np.cumsum(new)[tied] - 1]
        alike = length[order[tied]] == length[order[head]]
        group = np.cumsum(new)[tied] - 1
        odd = np.zeros(len(starts), bool)
        odd[group[~alike]] = True
        for depth in range(shallow, int(length[order[tied]].max()), 8):
            at = np.flatnonzero(~odd[group] & (length[order[tied]] > depth) & (tied != head))
            if not len(at):
                break
            who, first_ = order[tied[at]], order[head[at]]
            back = np.maximum(0, depth + 8 - length[who])  # the last eight bytes may overlap the ones before
            differ = word[start[who] + depth - back] != word[start[first_] + depth - back]
            odd[group[at[differ]]] = True
        same = tied[~odd[group] & (tied != head)]
        equal[same] = True
    else:
        odd = np.zeros(len(starts), bool)
    raw = buf.tobytes() if odd.any() else b""
    for a, b in zip(starts[odd].tolist(), ends[odd].tolist()):
        who = order[a:b].copy()
        at = a
        for members in BlindTrie([raw[s + shallow : s + m] for s, m in zip(start[who].tolist(), length[who].tolist())]).ordered():
            order[at : at + len(members)] = who[members]
            equal[at + 1 : at + len(members)] = True
            at += len(members)
    return order, equal


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of the suffixes of a text in sorted order."""
    buf = np.frombuffer(text, np.uint8)
    start = np.arange(len(buf))
    return deep_shallow(buf, start, len(buf) - start)[0]
