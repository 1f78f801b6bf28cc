"""Repeated strings of one block of text, from its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Ends every string; no byte of UTF-8.
TERMINATOR = 255


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``depth`` bytes, by doubling the length that ranks stand for."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:k + n]
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, dtype=np.uint64)
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank[order] = new + 1
        if known >= depth or int(new[-1]) == n - 1:
            return order
        following = np.zeros(n, dtype=np.uint64)
        following[:n - known] = rank[known:]
        key = (rank << np.uint64(32)) | following
        known *= 2


def shared_prefix_groups(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where, in suffix order, a group of suffixes with the same first ``length`` bytes begins.

    Intervals of suffixes with a common prefix are extended to the left by one byte at a time, all intervals of one prefix
    length together. An interval of prefix length l + 1 ends where neighbours share l bytes; an end that was not known
    before is noted, and its interval is extended in turn. After prefix length ``length`` every end that is not noted
    stands between suffixes that share that many bytes, so the search stops there.
    """
    n = len(text)
    before = text[order - 1]  # the transform: the byte before each suffix
    step = np.empty(n, dtype=np.int64)  # where the suffix one byte longer stands
    step[np.argsort(before, kind="stable")] = np.arange(n)
    ends = np.zeros(n + 1, dtype=bool)
    ends[[0, n]] = True
    low, high = np.zeros(1, dtype=np.int64), np.full(1, n, dtype=np.int64)
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        upto = np.cumsum(sizes)
        inside = np.repeat(low - upto + sizes, sizes) + np.arange(int(upto[-1]))
        owner = np.repeat(np.arange(len(low)), sizes)
        # Suffixes of one interval with one byte before them stand together in the longer prefix's interval.
        moved = np.sort((step[inside].astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64))
        place, owner = (moved >> np.uint64(32)).astype(np.int64), moved & np.uint64(0xFFFFFFFF)
        byte = text[order[place]]
        last = np.ones(len(place), dtype=bool)
        last[:-1] = (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])
        at = np.flatnonzero(last)
        first = np.concatenate([[0], at[:-1] + 1])
        low, high = place[first], place[at] + 1
        fresh = ~ends[high]
        low, high = low[fresh], high[fresh]
        ends[high] = True
    return np.flatnonzero(ends[:-1])


def repeats(strings: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(string, begin, end) of the runs of bytes covered by ``length``-byte strings that also start earlier, be it in an
    earlier string or earlier in the same one."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), dtype=np.uint8)
    sizes = np.array([len(s) + 1 for s in strings])
    begins = np.cumsum(sizes) - sizes
    order = suffix_array(text, length)
    groups = shared_prefix_groups(text, order, length)
    earliest = np.repeat(np.minimum.reduceat(order, groups), np.diff(groups, append=len(order)))
    late = order[order != earliest]
    late.sort()
    owner = np.searchsorted(begins, late, side="right") - 1
    whole = late + length <= begins[owner] + sizes[owner] - 1
    late, owner = late[whole], owner[whole]
    if not len(late):
        return []
    start = np.ones(len(late), dtype=bool)
    start[1:] = (owner[1:] != owner[:-1]) | (late[1:] > late[:-1] + length)
    at = np.flatnonzero(start)
    final = np.append(at[1:] - 1, len(late) - 1)
    return list(zip(owner[at].tolist(), (late[at] - begins[owner[at]]).tolist(),
                    (late[final] - begins[owner[at]] + length).tolist()))
