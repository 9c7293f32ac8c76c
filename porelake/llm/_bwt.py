"""Repeated intervals of a set of short byte strings by merging Burrows-Wheeler transforms."""

from __future__ import annotations

import numpy as np


def stable_order(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys below 2 ** (63 - bits), for fewer than 2 ** bits of them: key and place
    are sorted as one integer, which is several times faster than an argsort."""
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Positions of ``text`` (strings of symbols 1..255, each closed by a 0) in the order of the
    suffixes that end at the next 0; equal suffixes stay in the order of their strings. Ranks of
    four symbols at once, then doubled until ``longest`` symbols are covered."""
    n = len(text)
    bits = n.bit_length()
    padded = np.concatenate([text, np.zeros(4, np.uint8)])
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(4):
        c = np.where(alive, padded[j : j + n], 0)
        key = key << 8 | c
        alive &= c != 0
    to_end = np.flatnonzero(text == 0)
    room = np.repeat(to_end, np.diff(to_end, prepend=-1)) - np.arange(n)  # symbols from a position to the end of its string
    covered, rank = 4, np.empty(n, np.int64)
    if bits + 32 > 63 or 3 * bits > 63:
        raise ValueError("shards of under two million bytes are needed")
    while True:
        order = stable_order(key, bits)
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        if covered >= longest or rank[order[-1]] + 1 == n:
            return order
        after = np.where(room > covered, rank[np.minimum(np.arange(n) + covered, n - 1)] + 1, 0)
        key = rank * (n + 1) + after
        covered *= 2


def merge(bwts: list[np.ndarray], firsts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, interval): the shards' rows, numbered one shard after another, in the order of the merged
    transform, and the interval each is in. ``firsts``: rows of a shard that begin its strings.

    Only the interleave of the shards' rows is refined, no suffix is sorted again. A round deals the
    rows by the symbols before them (up to five), keeping their order, and thereby orders all suffixes by
    as many symbols more. Rows part into different intervals in the round in which their common prefix
    ends, so the intervals left after ``depth`` symbols have common prefixes of depth or more."""
    one, at = np.concatenate(bwts), 0
    to = np.empty(len(one), np.int64)  # row of the suffix that begins with the symbol before a row
    closers = []  # rows of the closing symbols: in each shard they come first, in the order of its strings
    for b, begins in zip(bwts, firsts):
        closers.append(np.arange(at, at + len(begins)))
        to[at + begins] = closers[-1]
        others = np.flatnonzero(b)
        to[at + others[np.argsort(b[others], kind="stable")]] = np.arange(at + len(begins), at + len(b))
        at += len(b)
    closers = np.concatenate(closers)
    m, n = len(closers), len(one)
    bits = n.bit_length()
    most = max(1, min(5, (63 - bits) // 8))
    steps = [(one.astype(np.int64), to)]  # by symbols: key (a closing symbol blots out what stood below it), row reached
    while len(steps) < most:
        key, reached = steps[-1]
        c = one[reached].astype(np.int64)
        steps.append((np.where(c == 0, 0, c << 8 * len(steps) | key), to[reached]))
    row, interval, low = np.arange(n), np.zeros(n, np.int32), (1 << bits) - 1
    while depth:
        k = min(most, depth)
        depth -= k
        key, reached = steps[k - 1]
        key, reached = key[row], reached[row]
        # closing symbols all differ: what a string's end closes stands in the order of the strings
        closed = key & 255 == 0
        dealt = np.sort(key << bits | np.where(closed, reached, np.arange(n)))
        place, dealt = dealt & low, dealt >> bits
        closed = dealt & 255 == 0
        row = np.where(closed, place, reached[place])
        row[:m] = closers
        came = interval[place]
        new = closed
        new[1:] |= closed[:-1] | (dealt[1:] != dealt[:-1]) | (came[1:] != came[:-1])
        new[0] = True
        interval = np.cumsum(new, dtype=np.int32)
    return row, interval


def repeated_intervals(strings: list[bytes], depth: int, shard_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of every window of ``depth`` bytes that occurs more than once.

    Strings must not hold the byte 255 (no UTF-8 text does). They are cut into shards, each with a
    Burrows-Wheeler transform of its own, which are then merged."""
    bwts, firsts, places, at = [], [], [], 0
    while at < len(strings):
        end, size = at, 0
        while end < len(strings) and (size == 0 or size + len(strings[end]) < shard_bytes):
            size += len(strings[end]) + 1
            end += 1
        text = np.frombuffer(b"\xff".join(strings[at:end]) + b"\xff", np.uint8) + np.uint8(1)  # 255 closes: it turns into 0
        order = suffix_order(text, max(map(len, strings[at:end])) + 1)
        lens = np.fromiter(map(len, strings[at:end]), np.int64, end - at) + 1
        starts = np.cumsum(lens) - lens
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text))
        bwts.append(text[order - 1])
        firsts.append(rank[starts])
        string = np.repeat(np.arange(len(lens)), lens)[order]
        places.append((string + at, order - starts[string]))
        at = end
    if not bwts:
        return (np.zeros(0, np.int64),) * 3
    row, interval = merge(bwts, firsts, depth)
    again = np.zeros(len(row), bool)
    again[1:] = interval[1:] == interval[:-1]
    again[:-1] |= again[1:]
    row = row[again]
    return np.concatenate([p[0] for p in places])[row], np.concatenate([p[1] for p in places])[row], interval[again].astype(np.int64)
