"""BPE encoding and decoding, equal to the tokenizers library; long texts by tree concatenation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orequarry.llm.storage import shuffle_parts

#: Characters for which lower() and the word pattern below do what the library does; other texts go to the library.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ňŊ-ž–—‘’“”…]*")
#: The vocabulary's own splitting pattern.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Texts up to so many characters are encoded in one piece; longer ones in leaves of at most so many.
LEAF = 32_768
_CACHE_WORDS = 300_000
#: So many tokens in a row must agree on each side of a join that lies inside a word.
_AGREE = 8


#: If a vocabulary's rules give these what the rules below do, words may be looked up one by one.
_PROBES = ("The quick  Brown fox's 12 jumps\tover 3.5% of it!\n", " don't WE'LL (a-b) x_y ...  é Ñandú “so” – it", "", "A", "supercalifragilistic 2024-01-02 http://a.b/c?d=e&f")


class _Words(dict):
    """Word -> (its ids as int32 bytes, its tokens joined by a space); forgets all when full."""

    def __init__(self, model: Tokenizer):
        super().__init__()
        self.model = model

    def __missing__(self, word: str):
        if len(self) >= _CACHE_WORDS:
            self.clear()
        made = self.model.encode(word)
        self[word] = value = (np.array(made.ids, np.int32).tobytes(), " ".join(made.tokens))
        return value


class Codec:
    """One vocabulary file; `path` is read on each worker."""

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.bare = Tokenizer(self.full.model)  # no normaliser and no added tokens: for text that is normalised
        self.bare.pre_tokenizer = self.full.pre_tokenizer
        added = sorted((t.content for t in self.full.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.words = _Words(self.bare)
        self.names = {}
        self.plain = True
        self.plain = all(self.encode(t) == self.library(t) for t in _PROBES)  # else the library does every text

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as int32 bytes, and the decoded text."""
        if self.plain and _PLAIN.fullmatch(text) and not (self.added and self.added.search(text)):
            words = [self.words[w] for w in _WORD.findall(text.lower())]
            return b"".join([w[0] for w in words]), " ".join([w[1] for w in words])
        made = self.full.encode(text, add_special_tokens=False)
        return np.array(made.ids, np.int32).tobytes(), self.decode(made.ids)

    def library(self, text: str) -> tuple[bytes, str]:
        """As encode(), by the library alone."""
        made = self.full.encode(text, add_special_tokens=False)
        return np.array(made.ids, np.int32).tobytes(), self.full.decode(made.ids, skip_special_tokens=False)

    def decode(self, ids) -> str:
        """As the library's decode with skip_special_tokens=False: a vocabulary without a decoder joins its tokens by a space."""
        if not self.plain:
            return self.full.decode(list(ids), skip_special_tokens=False)
        names = self.names
        for i in set(ids):
            if i not in names:
                names[i] = self.full.decode([i], skip_special_tokens=False)
        return " ".join([names[i] for i in ids])

    def segments(self, text: str) -> list[tuple[int | None, str]]:
        """(id of an added token, "") or (None, normalised text between them)."""
        out, at = [], 0
        for m in self.added.finditer(text) if self.added else ():
            out += [(None, text[at : m.start()]), (self.full.token_to_id(m[0]), "")]
            at = m.end()
        out.append((None, text[at:]))
        normal = self.full.normalizer.normalize_str if self.full.normalizer else str
        return [(i, normal(t) if t else t) for i, t in out if t or i is not None]

    def leaf(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each token's first character and the one after its last, in normalised text."""
        made = self.bare.encode(text)
        spans = np.array(made.offsets, np.int64).reshape(-1, 2)
        return np.array(made.ids, np.int64), spans[:, 0], spans[:, 1]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    return halves(text[: len(text) // 2], most) + halves(text[len(text) // 2 :], most)


def join(c: Codec, a: tuple, b: tuple) -> tuple:
    """Two encoded neighbours (text, ids, starts, ends) as one.

    A window round the join is encoded again. It holds the truth where it agrees with each side: on
    _AGREE tokens in a row away from the window's own ends. Until it does, it is doubled; at last it
    is the whole of both texts.
    """
    text, offset = a[0] + b[0], len(a[0])
    ids = np.concatenate([a[1], b[1]])
    starts, ends = np.concatenate([a[2], b[2] + offset]), np.concatenate([a[3], b[3] + offset])
    split, reach = len(a[1]), 64
    while True:
        low, high = max(0, offset - reach), min(len(text), offset + reach)
        w_ids, w_starts, w_ends = c.leaf(text[low:high])
        w_starts, w_ends = w_starts + low, w_ends + low
        left = 0 if low == 0 else _meet(w_ids, w_starts, w_ends, ids[:split], starts[:split], ends[:split], range(len(w_ids)))
        right = len(w_ids) if high == len(text) else _meet(w_ids, w_starts, w_ends, ids[split:], starts[split:], ends[split:], range(len(w_ids) - _AGREE, -1, -1))
        if left is not None and right is not None and (low == 0 or high == len(text) or left + _AGREE <= right + _AGREE):
            keep = 0 if low == 0 else int(np.searchsorted(starts[:split], w_starts[left]))
            keep = keep if low == 0 else _at(starts[:split], ends[:split], ids[:split], w_starts[left], w_ends[left], w_ids[left])
            tail = len(ids) if high == len(text) else split + _at(starts[split:], ends[split:], ids[split:], w_starts[right], w_ends[right], w_ids[right])
            parts = lambda x, w: np.concatenate([x[:keep], w[left:right], x[tail:]])
            return text, parts(ids, w_ids), parts(starts, w_starts), parts(ends, w_ends)
        reach *= 2


def _at(starts, ends, ids, start, end, token) -> int:
    i = int(np.searchsorted(starts, start))
    while i < len(ids) and starts[i] == start:
        if ends[i] == end and ids[i] == token:
            return i
        i += 1
    return -1


def _meet(w_ids, w_starts, w_ends, ids, starts, ends, order) -> int | None:
    """A place in the window from which _AGREE tokens are the same as on this side; none touches an end of the window or side."""
    for p in order:
        if p == 0 or p + _AGREE >= len(w_ids) or w_starts[p] < w_ends[p - 1]:
            continue
        q = _at(starts, ends, ids, w_starts[p], w_ends[p], w_ids[p])
        if q < 1 or q + _AGREE >= len(ids):
            continue
        same = slice(p, p + _AGREE), slice(q, q + _AGREE)
        if (w_ids[same[0]] == ids[same[1]]).all() and (w_starts[same[0]] == starts[same[1]]).all() and (w_ends[same[0]] == ends[same[1]]).all():
            return p
    return None


def tree(c: Codec, leaves: list[tuple]) -> tuple:
    """Joins neighbours round by round until one is left."""
    while len(leaves) > 1:
        paired = [join(c, leaves[i], leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = paired + leaves[2 * len(paired) :]
    return leaves[0]


_OUT = "doc_id long, ids array<int>, decoded string"
#: Ids in one Arrow batch that a worker gives back.
_BATCH_IDS = 500_000


def _batch(doc_ids: list, ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
    flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
    offsets = pa.array(np.cumsum([0] + [len(x) // 4 for x in ids]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def _encode_short(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            doc_ids, ids, decoded, n = [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                made, said = c.encode(text.as_py() or "")
                doc_ids.append(doc_id)
                ids.append(made)
                decoded.append(said)
                n += len(made) // 4
                if n >= _BATCH_IDS:
                    yield _batch(doc_ids, ids, decoded)
                    doc_ids, ids, decoded, n = [], [], [], 0
            if doc_ids:
                yield _batch(doc_ids, ids, decoded)

    return run


def _cut(path: str, most: int):
    def run(batches):
        c = codec(path)
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(x).to_pylist() for x in ("row", "doc_id", "text")), strict=True):
                leaves = [(s, i, part) for s, (i, t) in enumerate(c.segments(text)) for part in halves(t, most)]
                n = len(leaves)
                arrays = [[row] * n, [doc_id] * n, list(range(n)), *map(list, zip(*leaves, strict=True))]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], ["row", "doc_id", "leaf", "segment", "added", "text"])

    return run


def _encode_leaves(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            made = [c.leaf(t) if a is None else tuple(np.array([x], np.int64) for x in (a, 0, 0)) for a, t in zip(batch.column("added").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            extra = [pa.array([m[i].tobytes() for m in made], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("row", "doc_id", "leaf", "segment", "text")] + extra, ["row", "doc_id", "leaf", "segment", "text", "ids", "starts", "ends"])

    return run


def _join_leaves(path: str):
    def run(table: pa.Table) -> pa.Table:
        c = codec(path)
        rows = sorted(table.to_pylist(), key=lambda r: r["leaf"])
        by_segment: dict[int, list] = {}
        for r in rows:
            by_segment.setdefault(r["segment"], []).append((r["text"], *(np.frombuffer(r[x], np.int64) for x in ("ids", "starts", "ends"))))
        ids = np.concatenate([tree(c, leaves)[1] for leaves in by_segment.values()])
        return pa.Table.from_batches([_batch([rows[0]["doc_id"]], [ids.astype(np.int32).tobytes()], [c.decode(ids.tolist())])])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, ids, decoded: one row per row of docs; `path` is a vocabulary file of the tokenizers library.

    ids are those of encode(text, add_special_tokens=False) without truncation or padding, decoded is
    decode(ids, skip_special_tokens=False). Null, empty and blank texts have no ids and decode to "".
    Repeated rows and ids, and a null id, are kept as they are; other columns are ignored.

    Where the vocabulary proves to lower-case, split and decode by the fixed rules of this module (each
    worker probes it), texts of plain characters are cut by that pattern and their words looked up in a
    bounded cache; others, and all with another vocabulary, up to `leaf` characters go to the library as they are. Longer ones are
    normalised, halved until no piece is longer than `leaf`, and the pieces, which may cut words, are
    dealt out, encoded in parallel, and joined again pairwise in rounds (see join()).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    short = rows.where(F.coalesce(F.char_length("text"), F.lit(0)) <= leaf).mapInArrow(_encode_short(path), _OUT)
    long = rows.where(F.char_length("text") > leaf).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = long.mapInArrow(_cut(path, leaf), "row long, doc_id long, leaf long, segment long, added long, text string")
    leaves = cut.repartition(shuffle_parts(docs.sparkSession, 1), "row", "leaf").mapInArrow(
        _encode_leaves(path), "row long, doc_id long, leaf long, segment long, text string, ids binary, starts binary, ends binary"
    )
    return short.union(leaves.groupBy("row").applyInArrow(_join_leaves(path), _OUT))


def bpe_digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids where asked, of what bpe_encode() gives."""
    return encoded.select(
        "doc_id",
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
