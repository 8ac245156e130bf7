"""Words, shingles and sets of Arrow text columns as NumPy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multiplier of the rolling word hash; odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at a time; bounds the memory of the 8-byte temporaries.
PIECE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _hash_piece(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of raw (lower-cased bytes); starts: offsets where a document begins."""
    word = ~_WHITE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[starts] = True
    cut[-1] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    first = np.flatnonzero(word & (~before | cut[:-1]))
    if not len(first):
        return np.empty(0, np.uint64), first, first
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = np.flatnonzero(word & (~after | cut[1:])) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=total[1:])
    h = (total[last] - total[first]) * _power(_INVERSE, len(raw))[first]
    return mix(h + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first, last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.empty(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    at = at - at[0]
    return at, raw


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, so that arrays of words stay small; a longer text is alone."""
    at, _ = text_bytes(batch.column("text"))
    low = 0
    while low < len(batch):
        high = min(len(batch), max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1))
        yield batch.slice(low, high - low)
        low = high


def _words(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, A-Z lower-cased; at: where rows begin in raw.

    Bytes are hashed PIECE at a time, cut at white space, so memory beyond the words' own 24 bytes is
    bounded unless one word is longer than a piece.
    """
    found, where, low = [], [], 0
    while low < len(raw):
        high = min(len(raw), low + PIECE)
        while high < len(raw):  # back to a white byte or a document's start, else further on
            window = _WHITE[raw[low:high]]
            back = int(window[::-1].argmax()) if window.any() else -1
            doc = int(np.searchsorted(at, high, "right")) - 1
            options = [high - back if back >= 0 else -1, int(at[doc])]
            best = max(options)
            if best > low:
                high = best
                break
            high = min(len(raw), high + PIECE)
        begins = at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low
        h, first, last = _hash_piece(_LOWER[raw[low:high]], begins)
        found.append(h)
        where.append((first + low, last + low))
        low = high
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate([x for x, _ in where]), np.concatenate([x for _, x in where])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of all rows, A-Z lower-cased, as hashes in order, and the rows' offsets into them."""
    at, raw = text_bytes(column)
    hashes, first, _ = _words(at, raw)
    return hashes, np.searchsorted(first, at)


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and the first character of each word in its row and the one after its last."""
    at, raw = text_bytes(column)
    hashes, first, last = _words(at, raw)
    offsets = np.searchsorted(first, at)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    before = np.repeat(chars[at[:-1]], np.diff(offsets))
    return hashes, offsets, chars[first] - before, chars[last] - before


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row, and offsets; a shorter, non-empty row gives its whole sequence as one."""
    n = len(words) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        rolled += words[j : j + n] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
        rolled = (rolled << np.uint64(7)) | (rolled >> np.uint64(57))
    rolled = mix(rolled)
    counts = np.diff(offsets)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(out_offsets[-1]), np.uint64)
    full = np.flatnonzero(counts >= k)
    if len(full):
        keep = np.zeros(len(rolled) + 1, np.int64)
        np.add.at(keep, offsets[:-1][full], 1)
        np.add.at(keep, offsets[1:][full] - k + 1, -1)
        inside = np.cumsum(keep)[:-1] > 0
        place = np.repeat(counts >= k, sizes)
        out[place] = rolled[inside]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[offsets[i] : offsets[i + 1]]
        out[out_offsets[i]] = mix(np.array([hash_sequence(own)], np.uint64))[0]
    return out, out_offsets


def hash_sequence(words: np.ndarray) -> int:
    h = len(words) * 0xA24BAED4963EE407 + 1
    for w in words.tolist():
        h = ((h ^ w) * _BASE + 0x632BE59BD9B4E019) & ((1 << 64) - 1)
    return h


def row_sets(hashes: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row."""
    for i in range(len(offsets) - 1):
        own = np.sort(hashes[offsets[i] : offsets[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        yield own


def set_digest(members: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of hashes, independent of their order."""
    n = len(members)
    total = int(np.add.reduce(mix(members ^ np.uint64(0x5851F42D4C957F2D)))) if n else 0
    return int(mix(np.array([(total + n * _BASE) % (1 << 64)], np.uint64)).view(np.int64)[0])


def packed(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of each part, every column as bytes; one shuffled row then carries many."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if part.max() < 65536 else part, kind="stable")
    sorted_part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1], [True]]))
    columns = [c[order] for c in columns]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(sorted_part[low]), [c[low:high].tobytes() for c in columns]


def unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """What packed() made, of all rows of a group."""
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype)


#: Probes of a membership filter.
_PROBES = 4


def member_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a membership filter of `bits` bits that each key sets."""
    h = mix(keys.view(np.uint64) ^ np.uint64(0x6D656D62657273))
    return (h[:, None] + ((h >> np.uint64(32)) | np.uint64(1))[:, None] * np.arange(_PROBES, dtype=np.uint64)) % np.uint64(bits)


def maybe_members(filters: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter: all that are, and a few others. filters: packed bits of all segments, `bits` in each."""
    segments = len(filters) * 8 // bits
    at = member_places(keys, bits) + ((keys.view(np.uint64) % np.uint64(segments)) * np.uint64(bits))[:, None]
    return ((filters[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.concatenate([start, [len(sorted_values)]]))
