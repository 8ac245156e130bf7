"""LM scoring with a log-frequency Bloom filter: quantised n-gram counts, read back by repeated probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orequarry.llm import textnum as T
from orequarry.llm.storage import materialize, shuffle_parts

#: Stand for the start and the end of a text; no word hashes to them but by chance.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Bits set for each stored level, and bits of filter for each level.
HASHES, BITS_PER_ITEM = 5, 8
#: Weight of the lower order in the interpolation.
BACKOFF = 0.4
#: Up to so many pieces of a filter stay loaded in a worker; more are loaded in turn.
HELD = 4
#: Stands for the level of a text's start.
_FIRST = 255
#: Tokens handled at a time.
_SLICE = 400_000


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for 1, 2 for 2-3, 3 for 4-7 and so on."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def expected_count(level: np.ndarray) -> np.ndarray:
    """The middle of a level; 0 for level 0."""
    return np.where(level > 0, 2.0 ** (level - 1) * np.where(level > 1, 1.5, 1.0), 0.0)


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = T.mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    bits = np.asarray(bits, np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(0xFFFFFFFFFFFF)) % (bits[:, None] if bits.ndim else bits)


def build_segment(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[bytes, int]:
    """A filter of `bits` bits with levels 1..q of each key, and the least count it holds.

    If all levels don't fit at BITS_PER_ITEM, the rarest keys stay out and need a filter of their own.
    """
    q = levels(counts)
    least = 1
    while int(q[counts >= least].sum()) * BITS_PER_ITEM > bits:
        least += 1
    keys, q = keys[counts >= least], q[counts >= least]
    table = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        own = keys[q >= level]
        for low in range(0, len(own), 1 << 17):
            table[_places(own[low : low + (1 << 17)], level, bits).ravel()] = True
    return np.packbits(table).tobytes(), least


def room(counts: np.ndarray) -> int:
    """Bits of a filter that holds all levels of keys with these counts."""
    return max(64, -(-int(levels(counts).sum()) * BITS_PER_ITEM // 64) * 64)


def probe_at(filters: np.ndarray, base: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of the keys, each in the `bits` bits of filters from `base` on."""
    out = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys))
    level = 0
    while len(alive):
        level += 1
        at = _places(keys[alive], level, bits[alive]) + base[alive, None]
        hit = ((filters[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)
        alive = alive[hit]
        out[alive] = level
    return out


def _slices(batch: pa.RecordBatch):
    """Slices of the batch with about _SLICE tokens, their tokens (each text's END last) and offsets."""
    column = batch.column("text")
    at, _ = T.text_bytes(column)
    low = 0
    while low < len(batch):
        high = max(low + 1, int(np.searchsorted(at, at[low] + _SLICE * 6, "right")) - 1)
        high = min(high, len(batch))
        words, offsets = T.word_hashes(column.slice(low, high - low))
        counts = np.diff(offsets) + 1
        ends = np.cumsum(counts)
        tokens = np.empty(int(ends[-1]), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends - 1] = True
        tokens[is_end] = END
        tokens[~is_end] = words
        yield low, high, tokens, np.concatenate([[0], ends])
        low = high


def _pairs(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each (START for a text's first) and the key of the pair."""
    before = np.concatenate([[START], tokens[:-1]])
    before[offsets[:-1]] = START
    return before, T.mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + T.mix(tokens))


class _Counter:
    """Distinct keys with counts, handed out in packs whenever they are many."""

    def __init__(self, kind: int, segments: int, parts: int):
        self.kind, self.segments, self.parts, self.keys, self.counts, self.held = kind, segments, parts, [], [], 0

    def add(self, keys: np.ndarray):
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        if self.held > 3_000_000:
            yield from self.flush()

    def flush(self):
        if not self.keys:
            return
        k, c = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(k, kind="stable")
        start, _ = T.runs_of(k[order])
        k, c = k[order][start], np.add.reduceat(c[order], start)
        times = -(-c // 255)  # a count is sent in bytes
        sent = np.full(int(times.sum()), 255, np.uint8)
        sent[np.cumsum(times) - 1] = (c - 1) % 255 + 1
        k = np.repeat(k, times)
        self.keys, self.counts, self.held = [], [], 0
        segment = (k % np.uint64(self.segments)).astype(np.int64)
        packs = list(T.packed(segment % self.parts, [k, sent]))
        arrays = [pa.array([self.kind] * len(packs), pa.int32()), pa.array([p for p, _ in packs], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array([x[i] for _, x in packs], pa.binary()) for i in (0, 1)], ["kind", "part", "ks", "ns"])


def _count(segments: int, parts: int):
    def run(batches):
        words, pairs = _Counter(1, segments, parts), _Counter(2, segments, parts)
        for batch in batches:
            for _, _, tokens, offsets in _slices(batch):
                yield from words.add(tokens)
                yield from pairs.add(_pairs(tokens, offsets)[1])
        yield from words.flush()
        yield from pairs.flush()

    return run


def _reduce(segments: int, parts: int, pair_bits: int):
    """Exact counts of the words of a part; of each segment a filter of all, for pairs one of at most pair_bits and one for the rest."""

    def run(table: pa.Table) -> pa.Table:
        kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
        k, c = T.unpacked(table["ks"], np.uint64), T.unpacked(table["ns"], np.uint8)
        order = np.argsort(k, kind="stable")
        start, _ = T.runs_of(k[order])
        k, c = k[order][start], np.add.reduceat(c[order].astype(np.int64), start)
        where = (k % np.uint64(segments)).astype(np.int64)
        own, made, rest = list(range(part, segments, parts)), [], []
        for s in own:
            keys, counts = k[where == s], c[where == s]
            bits, least = build_segment(keys, counts, room(counts) if kind == 1 else min(room(counts), pair_bits))
            made.append(bits)
            rare = counts < least
            rest.append(build_segment(keys[rare], counts[rare], room(counts[rare]))[0] if rare.any() else b"")
        exact = kind == 1
        histogram = np.bincount(levels(c), minlength=64)
        return pa.table({
            "kind": pa.array([kind] * len(own), pa.int32()), "segment": pa.array(own, pa.int64()), "bits": pa.array(made, pa.binary()), "rest": pa.array(rest, pa.binary()),
            "part": pa.array([part] * len(own), pa.int64()), "tokens": pa.array([int(c.sum())] + [0] * (len(own) - 1), pa.int64()), "types": pa.array([len(k)] + [0] * (len(own) - 1), pa.int64()),
            "words": pa.array([k.tobytes() if exact else b""] + [b""] * (len(own) - 1), pa.binary()), "counts": pa.array([c.tobytes() if exact else b""] + [b""] * (len(own) - 1), pa.binary()),
            "histogram": pa.array([histogram.tolist()] + [[]] * (len(own) - 1), pa.list_(pa.int64())),
        })

    return run


_REDUCED = "kind int, segment long, bits binary, rest binary, part long, tokens long, types long, words binary, counts binary, histogram array<long>"


def _at_least(least: int):
    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column("words"), batch.column("counts"), strict=True):
                k, c = np.frombuffer(k.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k[c >= least].tobytes()], pa.binary()), pa.array([c[c >= least].tobytes()], pa.binary())], ["words", "counts"])

    return run


class PiecedFilter:
    """A filter in broadcast pieces of whole segments: piece, first bit and bits of each segment."""

    def __init__(self, pieces: list, piece: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.pieces, self.piece, self.start, self.size = pieces, piece, start, size

    def probe(self, keys: np.ndarray) -> np.ndarray:
        segment = (keys % np.uint64(len(self.size))).astype(np.int64)
        order = np.argsort(self.piece[segment], kind="stable")
        cuts = np.searchsorted(self.piece[segment[order]], np.arange(len(self.pieces) + 1))
        out = np.zeros(len(keys), np.int64)
        for held, low, high in zip(self.pieces, cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            own = order[low:high]
            at = segment[own]
            out[own] = probe_at(np.frombuffer(held.value, np.uint8), self.start[at], self.size[at], keys[own])
            if len(self.pieces) > HELD and getattr(held, "_path", None):  # can be loaded again
                held.__dict__.pop("_value", None)
        return out


def log_probability(pair_level: np.ndarray, level: np.ndarray, history_level: np.ndarray, tokens: int, types: int, texts: int) -> np.ndarray:
    """log10 of (1 - b) * c(h, w) / c(h) + b * P(w), counts from their levels; P(w) alone after an unseen h."""
    count = expected_count(level)
    low = (count + 1) / (tokens + types + 1)
    first = history_level == _FIRST
    history = np.where(first, float(texts), expected_count(np.where(first, 0, history_level)))
    pair = np.minimum(expected_count(pair_level), np.minimum(history, np.maximum(count, 1.0)))
    high = np.where(history > 0, pair / np.maximum(history, 1.0), 0.0)
    return np.log10(np.where(history > 0, (1 - BACKOFF) * high + BACKOFF * low, low))


class Scorer:
    """What a worker needs: the frequent words with exact counts, and the filters of words and pairs; more: segments with rarer pairs elsewhere."""

    def __init__(self, hot: bytes, hot_counts: bytes, more: np.ndarray, tokens: int, types: int, texts: int, words: PiecedFilter, pairs: PiecedFilter):
        self.hot, self.hot_counts = np.frombuffer(hot, np.uint64), np.frombuffer(hot_counts, np.int64)
        self.words, self.pairs = words, pairs
        self.more, self.tokens, self.types, self.texts = more, tokens, types, texts

    def exact(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of frequent words, and which tokens are none of them."""
        if not len(self.hot):
            return np.zeros(len(tokens), np.int64), np.ones(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.hot, tokens), len(self.hot) - 1)
        tail = self.hot[at] != tokens
        return np.where(tail, 0, self.hot_counts[at]), tail

    def score(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log_probability of the tokens, 0 where the pair must be looked up in its part; where; and of those the keys and both levels."""
        _, keys = _pairs(tokens, offsets)
        distinct, back = np.unique(tokens, return_inverse=True)
        level = self.words.probe(distinct)[back]
        history = np.concatenate([[0], level[:-1]])
        history[offsets[:-1]] = _FIRST
        pair = self.pairs.probe(keys)
        ask = (pair == 0) & self.more[(keys % np.uint64(len(self.more))).astype(np.int64)]
        ask &= np.where(history == _FIRST, self.texts, history) > 0  # after an unseen word the pair is not read
        made = np.where(ask, 0.0, log_probability(pair, level, history, self.tokens, self.types, self.texts))
        return made, ask, keys[ask], (history[ask] * 256 + level[ask]).astype(np.uint16)


#: Kinds of packs: what is known of rows at once; rare words and pairs to look up.
_ROWS, _WORDS, _RARE_PAIRS = 0, 1, 2
_PACKS = "kind int, part long, start long, xs array<binary>"


def _pack_batch(kind: int, part: np.ndarray, columns: list[np.ndarray], start: int = 0) -> pa.RecordBatch:
    packs = list(T.packed(part, columns))
    arrays = [pa.array([kind] * len(packs), pa.int32()), pa.array([p for p, _ in packs], pa.int64()), pa.array([start] * len(packs), pa.int64())]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([x for _, x in packs], pa.list_(pa.binary()))], ["kind", "part", "start", "xs"])


def _columns(table: pa.Table, dtypes: tuple) -> list[np.ndarray]:
    xs = table["xs"].to_pylist()
    return [np.frombuffer(b"".join(x[i] for x in xs), d) for i, d in enumerate(dtypes)]


def _row_parts(rows: np.ndarray, parts: int) -> np.ndarray:
    return (T.mix(rows.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _score(shared, word_pieces: list, pair_pieces: list, segments: int, parts: int):
    """Rows with what is read at once, and the rare words and pairs, with offsets of their rows, for where they were counted."""

    def run(batches):
        *values, words, pairs = shared.value
        scorer = Scorer(*values, PiecedFilter(word_pieces, *words), PiecedFilter(pair_pieces, *pairs))
        per_token = np.log10(float(scorer.tokens + scorer.types + 1))
        for batch in batches:
            rows, ids = batch.column("row").to_numpy(), batch.column("doc_id")
            valid = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy()
            for low, high, tokens, offsets in _slices(batch):
                count, tail = scorer.exact(tokens)
                n, own = np.diff(offsets), rows[low:high]
                sums = lambda x: np.add.reduceat(x, offsets[:-1])
                made, ask, pairs, at = scorer.score(tokens, offsets)
                base = sums(np.log10(count + 1.0)) - n * per_token
                yield _pack_batch(_ROWS, _row_parts(own, parts), [own, ids[low:high], valid[low:high], n.astype(np.int64), sums((count > 0).astype(np.int64)), base, sums(made)])
                start = int(own[0])
                row = np.repeat((own - start).astype(np.int32), n)
                for kind, k, more in ((_WORDS, tokens[tail], [row[tail]]), (_RARE_PAIRS, pairs, [row[ask], at])):
                    if len(k):
                        yield _pack_batch(kind, (k % np.uint64(segments)).astype(np.int64) % parts, [k, *more], start)

    return run


def _look_up(segments: int, parts: int, tokens: int, types: int, texts: int):
    """Of one part: rare words in the exact counts, rare pairs in the rest of the filter, summed by text. Rows go through."""

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        if not len(asked):
            return pa.table({"kind": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "xs": pa.array([], pa.list_(pa.binary()))})
        if kind == _ROWS:
            return asked.select(["kind", "part", "start", "xs"])
        k, offset, *at = _columns(asked, (np.uint64, np.int32) if kind == _WORDS else (np.uint64, np.int32, np.uint16))
        times = np.array([len(x[0]) // 8 for x in asked["xs"].to_pylist()])
        row = offset + np.repeat(asked["start"].to_numpy(), times)
        if kind == _WORDS:
            words, counts = T.unpacked(held["words"], np.uint64), T.unpacked(held["counts"], np.int64)
            count = np.zeros(len(k), np.int64)
            if len(words):
                found = np.minimum(np.searchsorted(words, k), len(words) - 1)
                count = np.where(words[found] == k, counts[found], 0)
            row, value = row[count > 0], np.log10(count[count > 0] + 1.0)
        else:
            rest = [x.as_py() for x in held["rest"]]
            sizes, start = np.zeros(segments, np.uint64), np.zeros(segments, np.uint64)
            own = held["segment"].to_numpy()
            sizes[own] = [len(x) * 8 for x in rest]
            start[own] = np.cumsum([0] + [len(x) * 8 for x in rest])[:-1]
            filters = np.frombuffer(b"".join(rest), np.uint8)
            value = np.empty(len(k))
            for low in range(0, len(k), _SLICE):
                some = slice(low, low + _SLICE)
                s = (k[some] % np.uint64(segments)).astype(np.int64)
                level = probe_at(filters, start[s], sizes[s], k[some])
                value[some] = log_probability(level, (at[0][some] & 255).astype(np.int64), (at[0][some] >> 8).astype(np.int64), tokens, types, texts)
        order = np.lexsort((value, row))
        first, length = T.runs_of(row[order])
        total = np.add.reduceat(value[order], first) if len(first) else np.empty(0)
        row = row[order][first]
        return pa.Table.from_batches([_pack_batch(kind, _row_parts(row, parts), [row, length.astype(np.int64), total])])

    return run


def _by_row(train_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        row, ids, valid, n, known, base, score = _columns(table.filter(pa.array(kind == _ROWS)), (np.int64, np.int64, np.uint8, np.int64, np.int64, np.float64, np.float64))
        order = np.argsort(row, kind="stable")
        row, ids, valid, n, known, base, score = (x[order] for x in (row, ids, valid, n, known, base, score))
        for of, to in ((_WORDS, base), (_RARE_PAIRS, score)):
            r, m, v = _columns(table.filter(pa.array(kind == of)), (np.int64, np.int64, np.float64))
            if len(r):
                order = np.lexsort((v, r))
                start, _ = T.runs_of(r[order])
                at = np.searchsorted(row, r[order][start])
                to[at] += np.add.reduceat(v[order], start)
                if of == _WORDS:
                    known[at] += np.add.reduceat(m[order], start)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=valid == 0), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(row), train_tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    return run


def _pieces(reduced: DataFrame, kind: int, segments: int, most: int) -> tuple[list, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A kind's filter as broadcasts of about `most` bits, gathered one after the other; piece, start and size of each segment."""
    context = reduced.sparkSession.sparkContext
    piece, start, size = np.zeros(segments, np.int64), np.zeros(segments, np.uint64), np.full(segments, 64, np.uint64)
    pieces, held, bits = [], [bytes(8)], 64  # segments of which nothing was counted read the empty first bits
    rows = reduced.where(f"kind = {kind}").select("segment", "bits").orderBy("segment").toLocalIterator()
    for r in rows:
        own = len(r["bits"]) * 8
        if bits + own > most and bits > 64:
            pieces.append(context.broadcast(b"".join(held)))
            held, bits = [], 0
        piece[r["segment"]], start[r["segment"]], size[r["segment"]] = len(pieces), bits, own
        held.append(bytes(r["bits"]))
        bits += own
    pieces.append(context.broadcast(b"".join(held)))
    return pieces, (piece, start, size)


def lm_scores(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_bits: int = 1 << 27,
    pair_filter_bits: int = 1 << 33,
    hot_words: int = 1 << 18,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Tokens are words (A-Z lower-cased), then one end. `training` says which rows of docs are learnt
    from; null counts as no. A null, empty or blank text is one end token. Without training rows all
    counts are 0. Repeated rows and a null id are scored as they are; other columns are ignored; no
    rows give no rows.

    n_known and base_score use exact counts over all training texts: those of the at most `hot_words`
    most frequent words are broadcast, the others are looked up where they were counted, each text's
    rare words dealt by hash. score is an interpolated bigram model that reads all its counts from two
    log-frequency Bloom filters, which grow with the counted n-grams: none is left out. Their segments
    are built where the n-grams of a hash range are counted, so no table of n-grams is gathered. Both
    filters are broadcast in pieces of about `piece_bits` (16 MB), of which a worker holds a few at a
    time. Of the pairs at most `pair_filter_bits` (1 GB) are broadcast, the most frequent; beyond that
    the others stay in filters where they were counted, and pairs not found in the first are looked up
    there. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    segments = 1 << max(10, (parts - 1).bit_length())  # each belongs to one part
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("t"))
    counted = rows.where("t").select("text").mapInArrow(_count(segments, parts), "kind int, part long, ks binary, ns binary")
    bits = max(64, pair_filter_bits // segments // 64 * 64)
    reduced = materialize(counted.groupBy("kind", "part").applyInArrow(_reduce(segments, parts, bits), _REDUCED))
    sums = reduced.where("kind = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    word_pieces, words_at = _pieces(reduced, 1, segments, piece_bits)
    pair_pieces, pairs_at = _pieces(reduced, 2, segments, piece_bits)
    more = np.zeros(segments, bool)
    more[[r["segment"] for r in reduced.where("kind = 2 AND length(rest) > 0").select("segment").collect()]] = True
    exact = reduced.where("kind = 1 AND length(words) > 0").select("part", "words", "counts")
    histogram = [r["n"] for r in reduced.where("kind = 1").select(F.posexplode("histogram").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).orderBy("level").collect()]
    level, held = len(histogram), 0
    while level > 1 and held + histogram[level - 1] <= hot_words:
        level -= 1
        held += histogram[level]
    hot = exact.select("words", "counts").mapInArrow(_at_least(1 << max(0, level - 1)), "words binary, counts binary").toArrow()  # at most hot_words
    words, counts = T.unpacked(hot["words"], np.uint64), T.unpacked(hot["counts"], np.int64)
    order = np.argsort(words)
    texts = int(counts[words == END].sum()) if (words == END).any() else rows.where("t").count()
    tokens, types = int(sums["n"]), int(sums["v"])
    shared = spark.sparkContext.broadcast((words[order].tobytes(), counts[order].tobytes(), more, tokens, types, texts, words_at, pairs_at))
    scored = rows.select("row", "doc_id", "text").mapInArrow(_score(shared, word_pieces, pair_pieces, segments, parts), _PACKS)
    kept = reduced.where("length(words) > 0 OR length(rest) > 0").select("kind", "part", "segment", "rest", "words", "counts")
    found = scored.groupBy("kind", "part").cogroup(kept.groupBy("kind", "part")).applyInArrow(_look_up(segments, parts, tokens, types, texts), _PACKS)
    return found.groupBy("part").applyInArrow(_by_row(tokens), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
