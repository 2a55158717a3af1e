"""Deep-shallow sorting of windows: multikey quicksort to a shallow depth, blind tries below it.

Both parts work on all groups at once, in NumPy. The multikey part splits each group of windows by its next eight
bytes, down to SHALLOW bytes. A group that is still together has a long common prefix; it gets a blind trie: one
window is the path from the root, and every other window hangs off it where it first differs, at a depth and
by a byte. Only those two are kept of a branch (the trie is blind to what lies between). Windows with the same
branch are a group of their own, which gets a trie in turn; a window that never leaves the path equals it.
"""

from __future__ import annotations

import numpy as np

from cloudweave.llm.common import unaligned_u64

SHALLOW = 32


def _classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, ascending by the first key, and the class number of each place."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _several(numbers: np.ndarray) -> np.ndarray:
    """Where a class of sorted numbers has more than one member."""
    same = numbers[1:] == numbers[:-1]
    out = np.zeros(len(numbers), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def suffix_classes(buf: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that equal another of their group in length bytes: their numbers, class by class, and the classes.

    buf holds length bytes from each place of at on, and 16 to spare.
    """
    words = unaligned_u64(buf)
    live = np.arange(len(at))
    part = group
    # Multikey quicksort, a super-letter of eight bytes at a time. Order matters within a class alone, so the
    # machine's byte order will do for its letters.
    depth = 0
    while depth < min(SHALLOW, length - 8) and len(live):
        order, part = _classes(part, words[at[live] + depth])
        live = live[order]
        keep = _several(part)
        live, part = live[keep], part[keep]
        depth += 8
    done: list[tuple[np.ndarray, np.ndarray]] = []
    base = 0
    from_ = np.full(len(live), depth)
    while len(live):
        # Each class's first member is the path of its trie.
        first = np.append(True, part[1:] != part[:-1])
        number = np.cumsum(first) - 1
        path = live[np.flatnonzero(first)][number]
        # Where each member leaves the path: eight bytes at a time, then the byte itself.
        leave = from_.copy()
        going = np.arange(len(live))
        while len(going):
            a, b = at[live[going]] + leave[going], at[path[going]] + leave[going]
            over = leave[going] + 8 > length
            x, y = words[np.minimum(a, len(words) - 1)], words[np.minimum(b, len(words) - 1)]
            mask = np.where(over, (np.uint64(1) << (np.uint64(8) * (length - leave[going]).clip(0, 7).astype(np.uint64))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
            diff = (x ^ y) & mask
            stop = diff != 0
            if stop.any():
                low = diff[stop] & (~diff[stop] + np.uint64(1))
                leave[going[stop]] += np.log2(low.astype(np.float64)).astype(np.int64) // 8
            ended = ~stop & (leave[going] + 8 >= length)
            leave[going[ended]] = length
            going = going[~stop & ~ended]
            leave[going] += 8
        equal = leave >= length
        # Members that stay on the path are its equals, if there are any besides the path itself.
        on = np.flatnonzero(equal)
        mates = _several(number[on])
        if mates.any():
            done.append((live[on[mates]], number[on[mates]] + base))
        base += int(number[-1]) + 1
        off = np.flatnonzero(~equal)
        branch = buf[at[live[off]] + leave[off]]
        order, cls = _classes(number[off], leave[off], branch)
        off = off[order]
        keep = _several(cls)
        off, part = off[keep], cls[keep]
        live, from_ = live[off], leave[off] + 1
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def repeated_windows(buf: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window whether it equals another of its group, and whether it is the first of its equals."""
    again, first = np.zeros(len(at), bool), np.zeros(len(at), bool)
    members, classes = suffix_classes(buf, at, group, length)
    again[members] = True
    if len(members):
        order = np.lexsort((members, classes))
        m, c = members[order], classes[order]
        first[m[np.append(True, c[1:] != c[:-1])]] = True
    return again, first
