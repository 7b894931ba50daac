"""Byte windows and their order: content-defined cutting, and deep-shallow suffix sorting.  Pure functions of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a gram; the least gram of a window is its key.
GRAM = 32
#: Windows of one segment at most.
MOST_WINDOWS = 256
#: Bytes that are hashed at a time (positions fit 24 bits).
BLOCK = 1 << 20
#: Words of eight bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 3
ODD = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= ODD[3]
    x ^= x >> np.uint64(29)
    return x


def grams(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that begin at each position."""
    x = text.astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[: len(x) - width] << np.uint64(8 * width)) | x[width:]
    for width, odd in ((8, ODD[0]), (16, ODD[1])):
        x = mixed(x[: len(x) - width] * odd + x[width:] * ODD[2])
    return x


def sliding_minimum(x: np.ndarray, span: int) -> np.ndarray:
    """The least of the ``span`` values from each position on."""
    done = 1
    while 2 * done <= span:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = span - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, windows, key, inner of the runs of neighbouring windows that share a key.

    ``text``: texts after one another, which end at ``ends``; a window (``length`` bytes)
    lies within one of them.  A window's key is a hash of its least gram, so equal
    windows have equal keys wherever they lie.  inner: some windows of the run may equal
    each other; without it none do (equal windows hold their first least gram at equal offsets).
    """
    n = len(text) - length + 1
    nothing = np.empty(0, np.int64)
    if n <= 0:
        return nothing, nothing, np.empty(0, np.uint64), np.empty(0, bool)
    g = grams(text)
    low = np.uint64((1 << 24) - 1)
    least = sliding_minimum((g & ~low) | np.arange(len(g), dtype=np.uint64), length - GRAM + 1)
    at = (least & low).astype(np.int64)
    key = g[at]
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(text))  # bytes to the end of the text
    fits = left[:n] >= length
    begins = fits.copy()
    begins[1:] &= ~fits[:-1] | (key[1:] != key[:-1])
    start = np.flatnonzero(begins)
    if not len(start):
        return nothing, nothing, np.empty(0, np.uint64), np.empty(0, bool)
    stops = np.flatnonzero(fits & ~np.r_[fits[1:], False]) + 1  # where stretches of windows end
    stop = np.minimum(np.r_[start[1:], n], stops[np.searchsorted(stops, start, "right")])
    pieces = -(-(stop - start) // MOST_WINDOWS)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop, start = np.repeat(stop, pieces), np.repeat(start, pieces) + nth * MOST_WINDOWS
        # windows of different pieces may equal each other, so the flag is the whole run's
        inner = np.repeat(at[start[nth == 0]] != at[stop[nth == 0] - 1], pieces)
        stop = np.minimum(stop, start + MOST_WINDOWS)
    else:
        inner = at[start] != at[stop - 1]
    return start, stop - start, key[start], inner


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of at most about BLOCK, the ends of the texts in them, and the text and offset each begins at.

    A text longer than a block is cut so that every window lies in one block.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            piece = text[at : at + BLOCK + length - 1]
            if held and size + len(piece) > BLOCK:
                yield _joined(held)
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for _, _, p in held])
    return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), ends, np.array([i for i, _, _ in held]), np.array([a for _, a, _ in held])


def words(text: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each position on as one number; ``more`` zero bytes follow the text."""
    x = np.concatenate([text, np.zeros(more + 8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[: len(x) - width] << np.uint64(8 * width)) | x[width:]
    return x


def word_at(w: np.ndarray, at: np.ndarray, nth: int, length: int) -> np.ndarray:
    """The nth word of the strings at ``at``, without what lies beyond ``length`` bytes."""
    x = w[at + 8 * nth]
    spare = 8 * (nth + 1) - length
    return x >> np.uint64(8 * spare) << np.uint64(8 * spare) if spare > 0 else x


def sorted_within(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions by group, then value."""
    order = np.argsort(value)
    small = group.astype(np.uint16) if len(group) and group[-1] < 1 << 16 else group
    return order[np.argsort(small[order], kind="stable")]


def deep_shallow(text: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of ``length`` bytes at ``starts`` within their groups (ascending), and whether each equals the one before it.

    Multikey quicksort down to SHALLOW words: strings are ordered by one word, those that
    agree in it go on to the next.  Groups that agree beyond that depth have long common
    prefixes; blind tries order them.
    """
    w = words(text, length + 8)
    order = np.arange(len(starts))
    new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.empty(0, bool)
    shallow = min(SHALLOW, -(-length // 8))
    for nth in range(shallow):
        where = np.flatnonzero(~(new & np.r_[new[1:], True]))  # in groups of two and more
        if not len(where):
            return order, ~new
        number = np.cumsum(new[where]) - 1
        value = word_at(w, starts[order[where]], nth, length)
        at = sorted_within(number, value)
        order[where] = order[where[at]]
        value = value[at]
        new[where[1:]] |= value[1:] != value[:-1]
    where = np.flatnonzero(~(new & np.r_[new[1:], True]))
    if len(where):
        order[where], new[where] = blind_tries(w, starts, order[where], new[where], 8 * shallow, length)
    return order, ~new


def common(w: np.ndarray, a: np.ndarray, b: np.ndarray, known: int, length: int) -> np.ndarray:
    """Bytes that the strings at a and b have in common, at most ``length``; ``known`` (whole words) are."""
    out = np.full(len(a), length)
    left = np.arange(len(a))
    for nth in range(known // 8, -(-length // 8)):
        x = word_at(w, a[left], nth, length) ^ word_at(w, b[left], nth, length)
        differ = x != 0
        if differ.any():
            x = x[differ]
            out[left[differ]] = 8 * nth + 7 - np.searchsorted(BYTES, x, "right")
            left = left[~differ]
            if not len(left):
                break
    return out


#: The least numbers with two, three ... eight bytes.
BYTES = np.array([1 << (8 * i) for i in range(1, 8)], dtype=np.uint64)


def blind_tries(w: np.ndarray, starts: np.ndarray, order: np.ndarray, new: np.ndarray, known: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders groups whose strings agree in ``known`` bytes; new marks where a string differs from the one before it.

    All groups' tries grow together, a level at a time.  A trie is blind: a node holds
    but the depth at which its strings part, found from what each has in common with one
    of them, and the bytes there; what lies between two nodes is not looked at again.
    """
    order, new = order.copy(), new.copy()
    where = np.arange(len(order))  # strings in nodes that may part yet
    head = new.copy()  # where a node begins
    shared = np.full(len(order), -1)  # bytes in common with the node's first string; -1: not known
    while len(where):
        first = np.flatnonzero(head)
        node = np.cumsum(head) - 1
        mine = order[where]
        ask = np.flatnonzero(shared < 0)
        if len(ask):
            shared[ask] = common(w, starts[mine[ask]], starts[mine[first[node[ask]]]], known, length)
        depth = np.minimum.reduceat(shared, first)
        # nodes of equal strings are leaves
        live = np.flatnonzero((depth < length)[node])
        where, head, shared, mine, node = where[live], head[live], shared[live], mine[live], node[live]
        if not len(where):
            break
        branch = depth[node]
        at = starts[mine] + branch
        letter = (w[at] >> np.uint64(56)).astype(np.int64)
        renumbered = np.cumsum(head) - 1
        by = np.argsort(renumbered * 256 + letter, kind="stable")
        # a child that holds the node's first string knows what is shared with it
        knows = shared > branch
        order[where], shared, letter = mine[by], np.where(knows, shared, -1)[by], letter[by]
        node = renumbered[by]
        head = np.r_[True, (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])]
        new[where] |= head
        many = ~(head & np.r_[head[1:], True])
        where, head, shared = where[many], head[many], shared[many]
    return order, new
