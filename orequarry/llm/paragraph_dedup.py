"""Substring deduplication: paragraphs cut by content that meet in MinHash bands, exact Jaccard, removals by component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orequarry.llm import textnum as T
from orequarry.llm.jaccard_join import TASK_MEMBERS, bucket_components
from orequarry.llm.membership import membership_filter
from orequarry.llm.storage import materialize, shuffle_parts

#: A paragraph begins at the smallest word-pair hash within so many words on each side.
REACH = 6
#: MinHash values in a band.
ROWS = 3
#: Paragraphs that a task holds before it hands them out combined.
_HELD = 400_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def tune_bands(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The fewest bands of `rows` MinHash values that bring a pair at the threshold together with that recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def cut_paragraphs(words: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the paragraphs into the words, and the row of each.

    A paragraph begins with a row, and at each word whose hash with the word before it is smaller than
    those of the `reach` words before and not larger than those of the `reach` after. So cuts depend on
    words near by only, wherever lines end, and equal passages are cut alike but for their ends.
    """
    counts = np.diff(offsets)
    full = np.flatnonzero(counts)
    if not len(full):
        return np.zeros(1, np.int64), np.empty(0, np.int64)
    begins = offsets[:-1][full]
    pair = np.full(len(words), _NONE)
    pair[1:] = T.mix(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:])
    pair[begins] = _NONE
    place = np.arange(len(words)) + reach * np.repeat(np.arange(1, len(full) + 1), counts[full])  # rows stand `reach` apart
    wide = np.full(len(words) + reach * (len(full) + 1), _NONE)
    wide[place] = pair
    before, after = np.full(len(wide), _NONE), wide.copy()
    for d in range(1, reach + 1):
        before[d:] = np.minimum(before[d:], wide[:-d])
        after[:-d] = np.minimum(after[:-d], wide[d:])
    cut = ((wide < before) & (wide <= after))[place]
    cut[begins] = True
    start = np.flatnonzero(cut)
    return np.concatenate([start, [len(words)]]), full[np.searchsorted(begins, start, "right") - 1]


def sequence_digests(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A signed fingerprint of each row's word sequence; rows without words get any."""
    counts = np.diff(offsets)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], counts)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(T.mix(words + T.mix(place.astype(np.uint64) + np.uint64(11))), out=total[1:])
    return T.mix(total[offsets[1:]] - total[offsets[:-1]] + counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _numbered(row: np.ndarray) -> np.ndarray:
    """The number of each paragraph in its row."""
    start, length = T.runs_of(row)
    return np.arange(len(row)) - np.repeat(start, length)


def _first_of(cls: np.ndarray, doc: np.ndarray, para: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each class once: how often it occurs, and its smallest place."""
    order = np.lexsort((para, doc, cls))
    start, _ = T.runs_of(cls[order])
    return cls[order][start], np.add.reduceat(times[order], start) if len(start) else times[:0], doc[order][start], para[order][start]


def _list():
    """Every paragraph of every row, with its place in words and characters."""

    def run(batches):
        for batch in (piece for whole in batches for piece in T.slices(whole)):
            words, offsets, first, last = T.word_spans(batch.column("text"))
            at, row = cut_paragraphs(words, offsets)
            arrays = [
                batch.column("doc_id").take(pa.array(row)), batch.column("sig").take(pa.array(row)), pa.array(_numbered(row), pa.int64()), pa.array(first[at[:-1]], pa.int64()),
                pa.array(last[at[1:] - 1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sequence_digests(words, at), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sig", "para", "start", "end", "n_words", "cls"])

    return run


#: Kinds of packs: classes with their counts and places; a class for each band key; classes known to share a key.
_CLASSES, _KEYS, _PAIRS = 0, 1, 2
_PACKS = "kind int, part long, a binary, b binary, c binary, d binary"
#: Bits of a band key; sent without those that its part tells, in five bytes.
_KEY_BITS = 44


def _packs(kind: int, part: np.ndarray, columns: list[np.ndarray]):
    made = list(T.packed(part, columns))
    if made:
        of = lambda i: pa.array([c[i] if i < len(columns) else b"" for _, c in made], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(made), pa.int32()), pa.array([p for p, _ in made], pa.int64()), *map(of, range(4))], ["kind", "part", "a", "b", "c", "d"])


def band_keys(grams: np.ndarray, at: np.ndarray, bands: int, rows: int = ROWS, seed: int = 20) -> list[np.ndarray]:
    """One key of `rows` MinHash values per band for each row of shingle hashes."""
    draw = np.random.default_rng(seed)
    a = draw.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    folded, keys = grams ^ (grams >> np.uint64(29)), []
    for band in range(bands):
        key = np.full(len(at) - 1, band + 1, np.uint64)
        for j in range(band * rows, band * rows + rows):
            key = T.mix(key + np.minimum.reduceat(folded * a[j], at[:-1]))
        keys.append(key >> np.uint64(64 - _KEY_BITS))
    return keys


def _emit(k: int, least: int, bands: int, parts: int):
    """Of each task the classes with counts; of each piece of text one class for a band key, and all that share one there."""

    def run(batches):
        held: list[tuple] = []
        seen: set[int] = set()

        def classes():
            if held:
                cls, times, doc, para = _first_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
                yield from _packs(_CLASSES, cls.view(np.uint64) % np.uint64(parts), [cls, times.astype(np.int32), doc, para.astype(np.int32)])

        for batch in (piece for whole in batches for piece in T.slices(whole)):
            words, offsets = T.word_hashes(batch.column("text"))
            at, row = cut_paragraphs(words, offsets)
            if not len(row):
                continue
            cls, para = sequence_digests(words, at), _numbered(row)
            held.append((cls, batch.column("doc_id").to_numpy()[row], para, np.ones(len(cls), np.int64)))
            if sum(len(x[0]) for x in held) > _HELD:
                yield from classes()
            _, one = np.unique(cls, return_index=True)
            new = np.array([i for i in np.sort(one).tolist() if (c := int(cls[i])) not in seen and not seen.add(c)], np.int64)
            if len(seen) > _HELD:
                seen.clear()  # a class sent twice is merged by the receiver
            if not len(new):
                continue
            inside = np.zeros(len(cls), bool)
            inside[new] = True
            counts = np.diff(at)
            grams, own = T.shingle_hashes(words[np.repeat(inside, counts)], np.concatenate([[0], np.cumsum(counts[inside])]), k)
            made, mine = band_keys(grams, own, bands), cls[inside]
            many = np.diff(own) >= least  # smaller sets are alike only if they are equal, and then meet in any band
            flat, whose = np.concatenate([made[0], *(x[many] for x in made[1:])]), np.concatenate([mine, *([mine[many]] * (bands - 1))])
            order = np.argsort(flat, kind="stable")
            flat, whose = flat[order], whose[order]
            start, length = T.runs_of(flat)
            met = np.repeat(length > 1, length)
            if met.any():
                yield from _packs(_PAIRS, whose[met].view(np.uint64) % np.uint64(parts), [flat[met], whose[met]])
            flat, whose = flat[start], whose[start]
            left = flat // np.uint64(parts)
            yield from _packs(_KEYS, flat % np.uint64(parts), [left.astype(np.uint32), (left >> np.uint64(32)).astype(np.uint8), whose])
        yield from classes()

    return run


def _merge(parts: int):
    """Classes that occur more than once, with count and smallest place; pairs of a band key and a class, of keys that classes share."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, part = key[0].as_py(), key[1].as_py()
        if kind == _CLASSES:
            cls, times, doc, para = (T.unpacked(table[x], t) for x, t in zip("abcd", (np.int64, np.int32, np.int64, np.int32), strict=True))
            cls, times, doc, para = _first_of(cls, doc, para, times.astype(np.int64))
            keep = times > 1
            columns = [cls[keep], times[keep], doc[keep], para[keep].astype(np.int64)]
        else:
            if kind == _KEYS:
                low, high, cls = (T.unpacked(table[x], t) for x, t in zip("abc", (np.uint32, np.uint8, np.int64), strict=True))
                band = ((high.astype(np.uint64) << np.uint64(32)) + low) * np.uint64(parts) + np.uint64(part)
            else:
                band, cls = (T.unpacked(table[x], t) for x, t in zip("ab", (np.uint64, np.int64), strict=True))
            order = np.lexsort((cls, band))
            band, cls = band[order], cls[order]
            new = np.concatenate([[True], (band[1:] != band[:-1]) | (cls[1:] != cls[:-1])])
            band, cls = band[new], cls[new]
            if kind == _KEYS:
                _, length = T.runs_of(band)
                many = np.repeat(length > 1, length)
                band, cls = band[many], cls[many]
            columns = [band.astype(np.int64), cls, np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)]
        return pa.table({"kind": pa.array([min(kind, _KEYS)] * len(columns[0]), pa.int32())} | {x: pa.array(c, pa.int64()) for x, c in zip("abcd", columns, strict=True)})

    return run


def _sets_of(k: int, shared, bits: int):
    """Of the classes in the filter: set, and of each piece of text count and smallest place."""

    def run(batches):
        filters = np.frombuffer(shared.value, np.uint8)
        for batch in (piece for whole in batches for piece in T.slices(whole)):
            words, offsets = T.word_hashes(batch.column("text"))
            at, row = cut_paragraphs(words, offsets)
            cls, para = sequence_digests(words, at), _numbered(row)
            hit = np.flatnonzero(T.maybe_members(filters, bits, cls)) if len(cls) else np.empty(0, np.int64)
            if not len(hit):
                continue
            doc = batch.column("doc_id").to_numpy()[row[hit]]
            names, times, docs, paras = _first_of(cls[hit], doc, para[hit], np.ones(len(hit), np.int64))
            _, one = np.unique(cls, return_index=True)
            one = one[np.isin(cls[one], names)]  # in the order of names
            counts = np.diff(at)
            inside = np.concatenate([np.arange(at[i], at[i + 1]) for i in one])
            sets = list(T.row_sets(*T.shingle_hashes(words[inside], np.concatenate([[0], np.cumsum(counts[one])]), k)))
            arrays = [pa.array(x, pa.int64()) for x in (names, times, docs, paras, [len(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "copies", "doc_id", "para", "n", "set"])

    return run


def paragraph_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 20,
    words: int = 5,
    percent: int = 80,
    recall: float = 0.999,
    task_members: int = TASK_MEMBERS,
) -> DataFrame:
    """doc_id, para, paras, start, end, n_words, cluster_doc, cluster_para, n_copies, removed, text_hash: one row per stretch of repeated text.

    Texts are cut into paragraphs by content (see cut_paragraphs: about nine words, seven or more but at
    the ends of a text), so a passage is cut alike in every text, inside a line or across lines. Two
    paragraphs are alike when 100 * |A and B| >= percent * |A or B| over their distinct shingles of
    `words` words (A-Z lower-cased). A cluster is a component of alike paragraphs; its first place
    (smallest doc_id, then number in the text) stays, the others are to be removed. Neighbouring
    repeated paragraphs of a text make a chain; chains of at least `min_words` words are given, cut where
    removed changes: the first paragraph and their number, first character and the one after the last,
    the cluster's first place, the most copies of a paragraph in it. Repeats inside one text count as
    those across texts. text_hash (xxhash64 of the text) tells rows apart that repeat an id.

    Null, empty and blank texts have no paragraphs; rows without an id take no part; a row that repeats
    id and text is a repeat whose places are the same, so the first stays in both; other columns are
    ignored; no repeats or no rows give no rows.

    Equal paragraphs are one class, counted in each task first, so a passage in very many texts is not
    gathered. Classes meet in bands of three MinHash values, as many as the recall asks for. A piece of
    text sends one class for a band key; classes that share a key there are known to and go elsewhere,
    so a key of very many classes is not gathered. Sets of those that meet are read from the texts through
    a broadcast membership filter of bounded size, exact Jaccard is decided in each band key by a prefix
    tree, in blocks where a key has many, and only verified links make components.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("sig")
    )
    least = -(-percent // max(1, 100 - percent))
    emitted = rows.select("doc_id", "text").mapInArrow(_emit(words, least, tune_bands(percent / 100, recall), parts), _PACKS)
    merged = materialize(emitted.groupBy("kind", "part").applyInArrow(_merge(parts), "kind int, a long, b long, c long, d long"))
    pairs = materialize(merged.where(F.col("kind") == _KEYS).select(F.col("a").alias("canopy"), F.col("b").alias("cls")).distinct())
    asked = materialize(pairs.select("cls").distinct())
    shared, bits = membership_filter(asked.select(F.col("cls").alias("key")), asked.count())
    kind = "cls long, copies long, doc_id long, para long, n long, set binary"
    sets = rows.select("doc_id", "text").mapInArrow(_sets_of(words, shared, bits), kind).groupBy("cls").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "para")).alias("first"), F.first("n").alias("n"), F.first("set").alias("set")
    )
    sets = materialize(sets.join(asked, "cls"))
    linked = bucket_components(pairs.join(sets.select("cls", "n", "set"), "cls"), percent, parts, task_members).withColumnRenamed("node", "cls")
    met = materialize(sets.select("cls", "copies", "first").join(linked, "cls"))
    clusters = met.groupBy("component").agg(F.min("first").alias("head"), F.sum("copies").alias("n_copies"))
    equal = merged.where(F.col("kind") == _CLASSES).select(F.col("a").alias("cls"), F.col("b").alias("copies"), F.struct(F.col("c").alias("doc_id"), F.col("d").alias("para")).alias("head"))
    alone = equal.join(met.select("cls"), "cls", "left_anti").select("cls", "head", F.col("copies").alias("n_copies"))
    named = alone.union(met.join(clusters, "component").select("cls", "head", "n_copies"))
    listed = rows.mapInArrow(_list(), "doc_id long, sig long, para long, start long, end long, n_words long, cls long")
    return chains(listed.join(named, "cls"), min_words)


def chains(repeats: DataFrame, min_words: int) -> DataFrame:
    """Neighbouring repeated paragraphs of each text as one row, where they have at least min_words words."""
    text = ["doc_id", "sig"]
    own = Window.partitionBy(*text).orderBy("para")
    once = repeats.repartition(*text).withColumn("again", F.row_number().over(Window.partitionBy(*text, "para").orderBy("start"))).where("again = 1")
    marked = once.withColumn("removed", F.struct("doc_id", "para") != F.col("head"))
    begins = F.coalesce(F.lag("para").over(own) != F.col("para") - 1, F.lit(True))
    turns = begins | F.coalesce(F.lag("removed").over(own) != F.col("removed"), F.lit(True))
    marked = marked.withColumn("begins", begins.cast("long")).withColumn("turns", turns.cast("long"))
    marked = marked.withColumn("chain", F.sum("begins").over(own)).withColumn("stretch", F.sum("turns").over(own))
    marked = marked.withColumn("whole", F.sum("n_words").over(Window.partitionBy(*text, "chain"))).where(F.col("whole") >= min_words)
    out = marked.groupBy(*text, "stretch").agg(
        F.min("para").alias("para"), F.count(F.lit(1)).alias("paras"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.min("head").alias("head"), F.max("n_copies").alias("n_copies"), F.first("removed").alias("removed"),
    )
    return out.select("doc_id", "para", "paras", "start", "end", "n_words", F.col("head.doc_id").alias("cluster_doc"), F.col("head.para").alias("cluster_para"), "n_copies", "removed", F.col("sig").alias("text_hash"))


def remove_spans(docs: DataFrame, duplicates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed stretches cut out of the text; the other columns, and texts without any, stay as they are."""
    gone = duplicates.where("removed").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__gone"))
    text, n = F.col(text_col), F.size("__gone")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__gone", i - 1)["end"])
    end = lambda i: F.when(i == n, F.char_length(text)).otherwise(F.get("__gone", i)["start"])
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(text, (begin(i) + 1).cast("int"), (end(i) - begin(i)).cast("int")))
    joined = docs.join(gone, (docs[id_col] == F.col("__id")) & (F.xxhash64(text.cast("string")) == F.col("__hash")), "left")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(pieces, ""))).select(*docs.columns)
