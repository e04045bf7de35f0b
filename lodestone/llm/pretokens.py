"""Pre-tokenisation without regex, as the byte-level BPE vocabularies expect it.

The split is that of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.  It is computed for a whole chunk of
documents at once:

1. every code point gets a class (letter, digit, space, apostrophe, ...);
2. every class is a transition function on a nine-state automaton.  Functions
   compose associatively, so the state at every position comes from a doubling
   scan over a composition table.  After a few steps every composed function is
   constant and the scan is over, whatever the length of the text;
3. a piece starts where the table of (state before, class) says so.

A document's first position holds a constant function, so nothing leaks from one
document into the next.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from ._text import slice_hashes

# Classes of code points.
SPACE, WHITE, APOS, OTHER, DIGIT, SHORT, LETTER, PAIR = range(8)
_R, _V, _L, _E = 8, 9, 10, 11  # letters that matter in pairs; folded into PAIR, SHORT or LETTER
# States: what the automaton knows after a code point.
_BEGIN, _SPACE, _WHITE, _OTHER, _DIGIT, _LETTER, _QUOTE, _HALF, _DONE = range(9)


def _step(state: int, cls: int) -> int:
    if cls in (SPACE, WHITE):
        return _SPACE if cls == SPACE else _WHITE
    if cls == DIGIT:
        return _DIGIT
    if cls == APOS:
        return _OTHER if state in (_OTHER, _QUOTE, _SPACE) else _QUOTE
    if cls == OTHER:
        return _OTHER
    if state == _QUOTE and cls == SHORT:
        return _DONE
    if state == _QUOTE and cls == PAIR:
        return _HALF
    return _DONE if state == _HALF else _LETTER


def _starts(state: int, cls: int) -> bool:
    """Whether a piece starts at a code point of this class; white space after white space is settled later."""
    if cls in (SPACE, WHITE):
        return state not in (_SPACE, _WHITE)
    if cls == DIGIT:
        return state not in (_DIGIT, _SPACE)
    if cls in (APOS, OTHER):
        return state not in (_OTHER, _QUOTE, _SPACE)
    if state in (_LETTER, _SPACE, _HALF):
        return False
    return not (state == _QUOTE and cls in (SHORT, PAIR))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The monoid that the class functions generate: composition, images, which are constant, ids of classes."""
    functions: list[tuple[int, ...]] = []
    index: dict[tuple[int, ...], int] = {}

    def add(f: tuple[int, ...]) -> int:
        if f not in index:
            index[f] = len(functions)
            functions.append(f)
        return index[f]

    of_class = [add(tuple(_step(s, c) for s in range(9))) for c in range(8)]
    at_begin = [add((_step(_BEGIN, c),) * 9) for c in range(8)]
    done = 0
    while done < len(functions):
        for g in list(functions):
            for a, b in ((g, functions[done]), (functions[done], g)):
                add(tuple(b[a[s]] for s in range(9)))
        done += 1
    n = len(functions)
    compose = np.zeros((n, n), np.uint8)  # compose[later, earlier]
    for i, later in enumerate(functions):
        for j, earlier in enumerate(functions):
            compose[i, j] = index[tuple(later[earlier[s]] for s in range(9))]
    constant = np.array([len(set(f)) == 1 for f in functions])
    value = np.array([f[0] for f in functions], np.uint8)
    start = np.array([[_starts(s, c) for c in range(8)] for s in range(9)])
    return compose, constant, value, start, np.array(of_class, np.uint8), np.array(at_begin, np.uint8)


def _newer_letters(table: np.ndarray) -> None:
    """Code points that this Python's Unicode data doesn't know get the class that the tokenizers library gives them."""
    from tokenizers.pre_tokenizers import ByteLevel

    unknown = [c for c in range(0x20000) if unicodedata.category(chr(c)) == "Cn"]
    split = ByteLevel(add_prefix_space=False, use_regex=True)
    for before, cls in (("a", LETTER), ("1", DIGIT)):
        ends = dict(span for _, span in split.pre_tokenize_str("".join(f"{before}{chr(c)}\n" for c in unknown)))
        for i, c in enumerate(unknown):
            if ends.get(3 * i) == 3 * i + 2:
                table[c] = cls


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x40000):  # behind these planes there are no letters
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = DIGIT
    _newer_letters(table)
    for c in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = WHITE
    table[0x20] = SPACE
    table[ord("'")] = APOS
    for c in "stmd":
        table[ord(c)] = SHORT
    for c, k in zip("rvle", (_R, _V, _L, _E), strict=True):
        table[ord(c)] = k
    return table


def piece_starts(points: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Positions at which a piece starts; ``documents`` holds the position at which each document starts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    compose, constant, value, start, of_class, at_begin = _tables()
    cls = class_table()[points]
    following = np.empty(n, np.uint8)
    following[:-1] = cls[1:]
    following[-1] = WHITE
    documents = documents[documents < n]
    last = documents[documents > 0] - 1
    following[last] = WHITE  # the end of a text ends a run of white space without cutting it
    odd = np.flatnonzero(cls >= _R)
    kind, nxt = cls[odd], following[odd]
    folded = np.where(((kind == _R) | (kind == _V)) & (nxt == _E) | (kind == _L) & (nxt == _L), PAIR, LETTER)
    white = cls <= WHITE
    tail = white & (following > WHITE)  # white space before something else in the same text
    cls[odd] = folded
    f = of_class[cls]
    f[documents] = at_begin[cls[documents]]
    left = np.flatnonzero(~constant[f])
    step = 1
    while len(left):
        f[left] = compose[f[left], f[left - step]]
        left = left[~constant[f[left]]]
        step *= 2
    before = np.empty(n, np.uint8)
    before[1:] = value[f[:-1]]
    before[documents] = _BEGIN
    begins = start[before, cls]
    begins |= tail
    begins[documents] = True
    return np.flatnonzero(begins)


_POINT = np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Splits a chunk of UTF-8 texts.

    Returns the chunk's text, piece starts and ends in code points, the number of
    the first piece of each document, and for each piece its number among the
    chunk's distinct pieces with the first place and the 64-bit hash of each of those.
    """
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        places = offsets
    else:
        heads = np.empty(len(data) + 1, np.int64)
        heads[0] = 0
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        places = heads[offsets]
    starts = piece_starts(points, places[:-1][np.diff(places) > 0])
    ends = np.append(starts[1:], len(points))
    first = np.searchsorted(starts, places)
    if not len(starts):
        return text, starts, ends, first, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    import pandas as pd

    codes, keys = pd.factorize(slice_hashes((points.astype(np.uint64) + np.uint64(1)) * _POINT, starts, ends))
    top = np.maximum.accumulate(codes)
    fresh = np.flatnonzero(np.concatenate(([True], top[1:] > top[:-1])))
    return text, starts, ends, first, codes, fresh, keys
