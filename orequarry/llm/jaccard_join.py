"""N-gram Jaccard join: global order by rarity, prefix keys, then prefix-tree joins of the few sets that meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.llm import textnum as T
from orequarry.llm.components import connected_components, spanning_edges
from orequarry.llm.storage import materialize, shuffle_parts

#: Set members (8 bytes each) that one task joins in memory; larger canopies are dealt to blocks.
TASK_MEMBERS = 1_000_000

#: Classes of one key up to which all its pairs are looked at together; pairs and words of bitmaps compared at once.
PAIRED, OPENED, WORDS = 64, 1_000_000, 4_000_000


def low_share(percent: int) -> float:
    """Share of the hash range whose shingles are counted, and come first in the global order.

    It is a bit over twice the prefix, so that most sets fill their prefix with shingles that no other set holds.
    """
    return min(1.0, 0.022 * (100 - percent))


def low_limit(percent: int) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(low_share(percent) * 2**64)))


def prefix_length(n, percent: int):
    """Sets of size n that reach the threshold share one of their first so many members, in any common order."""
    return n - (-(-percent * n // 100)) + 1


# --- the trie


class SetTrie:
    """Ordered sets as a compressed prefix tree: sorted rows and the length each shares with the next."""

    def __init__(self, sets: list[np.ndarray]):
        members, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(members), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(members))  # common members first: long shared paths
        cuts = np.cumsum([0, *map(len, sets)])
        ranked = [np.sort(rank[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        self.rows = [ranked[i] for i in self.order]
        self.sizes = np.array([len(r) for r in self.rows], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate(self.rows)
        self.shared = np.array([_common(a, b) for a, b in zip(self.rows, self.rows[1:], strict=False)], np.int64)
        self.universe = len(members)
        # how common the members of a row are among all rows: the first row has the most in common with the rest
        self.central = np.argsort(-np.add.reduceat(np.sort(counts)[::-1][self.flat], self.at[:-1]) / self.sizes, kind="stable")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


#: Subtrees of at most so many sets are finished at once, below the path they share.
BUNDLE = 512


def trie_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of the smallest set it is linked with, directly or through others.

    Sets walk the tree of all. Overlaps with a shared path are counted once. A subtree is left when no
    set below can reach the threshold with what remains of it and of the query, or when all sets below
    are in the query's component already. Sets that are in the first walker's component when their turn
    comes need not walk: any two such sets are in one component, and all others do walk.
    """
    if len(sets) == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        linked = 100 * both >= percent * (len(a) + len(b) - both)
        return np.array([0, 0 if linked else 1])
    trie = SetTrie(sets)
    label = np.arange(len(sets))  # by position in the tree
    inside = np.zeros(trie.universe, bool)
    first = int(trie.central[0])
    for q in trie.central.tolist():
        if q != first and label[q] == label[first]:
            continue
        query = trie.rows[q]
        inside[query] = True
        stack = [(0, len(sets), 0, 0)]
        while stack:
            low, high, depth, overlap = stack.pop()
            if (label[low:high] == label[q]).all():
                continue
            if high - low <= BUNDLE:
                at = trie.at[low : high + 1]
                seen = np.concatenate([[0], np.cumsum(inside[trie.flat[at[0] : at[-1]]])])
                at = at - at[0]
                total = overlap + seen[at[1:]] - seen[at[:-1] + depth]
                linked = (100 + percent) * total >= percent * (len(query) + trie.sizes[low:high])
                label[np.isin(label, label[low:high][linked])] = label[q]
                continue
            row = trie.rows[low]
            end = int(trie.shared[low : high - 1].min())
            overlap += int(inside[row[depth:end]].sum())
            left = len(query) - int(np.searchsorted(query, row[end - 1], "right")) if end else len(query)
            sizes = trie.sizes[low:high]
            best = int(min(max(end + left, sizes.min()), sizes.max()))
            if (100 + percent) * (overlap + min(best - end, left)) < percent * (len(query) + best):
                continue
            cuts = [low, *(low + 1 + np.flatnonzero(trie.shared[low : high - 1] == end)).tolist(), high]
            if len(cuts) > 3:  # many branches here: take them in bundles, else each on its own
                bundled, begin = [], cuts[0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b - begin > BUNDLE and a > begin:
                        bundled.append((begin, a))
                        begin = a
                bundled.append((begin, cuts[-1]))
                stack += [(a, b, end, overlap) for a, b in bundled]
            else:
                stack += [(a, b, end, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        inside[query] = False
    order = np.array(trie.order)
    head: dict[int, int] = {}
    for position in np.argsort(order):
        head.setdefault(int(label[position]), int(order[position]))
    out = np.empty(len(sets), np.int64)
    out[order] = [head[int(x)] for x in label]
    return out


# --- tasks


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for piece in T.slices(batch):
        words, offsets = T.word_hashes(piece.column("text"))
        yield from T.row_sets(*T.shingle_hashes(words, offsets, k))


def _classes(k: int):
    def run(batches):
        for batch in batches:
            made = [(len(s), T.set_digest(s)) for s in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), *(pa.array([m[i] for m in made], pa.int64()) for i in (0, 1))], ["doc_id", "sig", "n", "cls"])

    return run


def _emit(k: int, percent: int, parts: int):
    limit = low_limit(percent)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            hashes, cls, size, slack = [], [], [], []
            for own in _sets(batch, k):
                n = len(own)
                if n == 0 or (digest := T.set_digest(own)) in seen:
                    continue
                seen.add(digest)
                low, p = int(np.searchsorted(own, limit)), prefix_length(n, percent)
                own = own[:low].copy() if low >= p else own  # a copy lets go of the rest
                hashes.append(own)
                for to, value in ((cls, digest), (size, n), (slack, low - p)):
                    to.append(value)
            if len(seen) > 500_000:
                seen.clear()  # a class emitted twice is merged by the receiver
            if not hashes:
                continue
            times = [len(h) for h in hashes]
            flat = np.concatenate(hashes)
            columns = [flat, *(np.repeat(np.array(v, d), times) for v, d in ((cls, np.int64), (size, np.int32), (slack, np.int32)))]
            yield from _rows(T.packed((flat & np.uint64(0xFFFFFFFF)) % np.uint64(parts), columns), "hs cs ns ss")

    return run


def _rows(packs, names: str) -> Iterator[pa.RecordBatch]:
    packs = list(packs)
    if packs:
        names = names.split()
        arrays = [pa.array([p for p, _ in packs], pa.int64())] + [pa.array([c[i] for _, c in packs], pa.binary()) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(arrays, ["part", *names])


def _as_table(batches, schema: dict) -> pa.Table:
    batches = list(batches)
    return pa.Table.from_batches(batches) if batches else pa.schema(list(schema.items())).empty_table()


def _shared_only(parts: int):
    """Of a part of the shingles, those that more than one class holds, with that number; dealt by class."""

    def run(table: pa.Table) -> pa.Table:
        h, c = T.unpacked(table["hs"], np.uint64), T.unpacked(table["cs"], np.int64)
        n, s = T.unpacked(table["ns"], np.int32), T.unpacked(table["ss"], np.int32)
        order = np.lexsort((c, h))
        h, c, n, s = h[order], c[order], n[order], s[order]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        h, c, n, s = h[once], c[once], n[once], s[once]
        _, length = T.runs_of(h)
        df = np.repeat(length, length)
        many = df > 1
        columns = [x[many] for x in (c, h, df.astype(np.int32), n, s)]
        return _as_table(_rows(T.packed(columns[0].view(np.uint64) % np.uint64(parts), columns), "cs hs ds ns ss"), {"part": pa.int64()} | dict.fromkeys("cs hs ds ns ss".split(), pa.binary()))

    return run


def _prefix_keys(percent: int, parts: int):
    """Of each class the shingles of its prefix that others share; classes whose prefix is theirs alone drop out."""
    limit = low_limit(percent)

    def run(table: pa.Table) -> pa.Table:
        c, h = T.unpacked(table["cs"], np.int64), T.unpacked(table["hs"], np.uint64)
        d, n, s = (T.unpacked(table[x], np.int32) for x in ("ds", "ns", "ss"))
        high = h >= limit
        order = np.lexsort((h, d, high, c))
        c, h, n, s, high = c[order], h[order], n[order].astype(np.int64), s[order].astype(np.int64), high[order]
        start, length = T.runs_of(c)
        if not len(start):
            return _as_table([], {"part": pa.int64(), "hs": pa.binary(), "cs": pa.binary(), "ns": pa.binary()})
        highs = np.add.reduceat(high.astype(np.int64), start)
        lows, spare = length - highs, s[start]
        # members held alone come first in each region, so the shared ones in the prefix are what is left of it
        from_low = np.where(spare >= 0, np.clip(lows - spare, 0, lows), lows)
        from_high = np.where(spare >= 0, 0, np.clip(highs - (n[start] - prefix_length(n[start], percent)), 0, highs))
        place = np.arange(len(c)) - np.repeat(start, length)
        keep = place < np.repeat(from_low, length)
        at_high = place - np.repeat(lows, length)
        keep |= (at_high >= 0) & (at_high < np.repeat(from_high, length))
        columns = [h[keep], c[keep], n[keep].astype(np.int32)]
        return _as_table(_rows(T.packed((columns[0] & np.uint64(0xFFFFFFFF)) % np.uint64(parts), columns), "hs cs ns"), {"part": pa.int64(), "hs": pa.binary(), "cs": pa.binary(), "ns": pa.binary()})

    return run


def _key_edges(percent: int):
    """Edges that join the classes of each key, in order of size and not across a gap that no link crosses."""

    def run(table: pa.Table) -> pa.Table:
        h, c, n = T.unpacked(table["hs"], np.uint64), T.unpacked(table["cs"], np.int64), T.unpacked(table["ns"], np.int32).astype(np.int64)
        order = np.lexsort((c, n, h))
        h, c, n = h[order], c[order], n[order]
        next_to = (h[1:] == h[:-1]) & (100 * n[:-1] >= percent * n[1:])
        a, b = spanning_edges(c[:-1][next_to], c[1:][next_to])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


# --- pairs that cannot link, told by bitmaps


def bitmap(members: np.ndarray) -> bytes:
    """Parity of the members on so many bits, a power of two and at least twice their number.

    Two bitmaps, the larger folded to the size of the smaller, differ in no more bits than their sets in members.
    """
    bits = 1 << max(6, (2 * len(members) - 1).bit_length())
    return np.packbits((np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of sets, one matrix for each size."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes, percent
        self.words = np.array([len(m) // 8 for m in maps], np.int64)
        self.place = np.empty(len(maps), np.int64)
        self.folded = {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.place[own] = np.arange(len(own))
            self.folded[w, w] = np.frombuffer(b"".join(maps[i] for i in own.tolist()), np.uint64).reshape(-1, w)

    def _rows(self, at: np.ndarray, words: int) -> np.ndarray:
        out = np.empty((len(at), words), np.uint64)
        for w in np.unique(self.words[at]).tolist():
            if (w, words) not in self.folded:
                self.folded[w, words] = np.bitwise_xor.reduce(self.folded[w, w].reshape(-1, w // words, words), 1)
            here = self.words[at] == w
            out[here] = self.folded[w, words][self.place[at[here]]]
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False for the pairs whose sets differ in too many members to reach the threshold."""
        small, large = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        out = 100 * small >= self.percent * large
        words = np.minimum(self.words[i], self.words[j])
        for w in np.unique(words[out]).tolist():
            own = np.flatnonzero(out & (words == w))
            for at in np.split(own, range(WORDS // w + 1, len(own), WORDS // w + 1)):
                differ = np.bitwise_count(self._rows(i[at], w) ^ self._rows(j[at], w)).sum(1, dtype=np.int64)
                out[at] = (100 + self.percent) * differ <= (100 - self.percent) * (small[at] + large[at])
        return out


def _marks(batches):
    for batch in batches:
        made = [bitmap(np.frombuffer(s, np.uint64)) for s in batch.column("set").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(made, pa.binary())], ["cls", "n", "bits"])


def _key_rows(batches):
    for batch in batches:
        h, c = T.unpacked(batch.column("hs"), np.uint64), T.unpacked(batch.column("cs"), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "cls"])


def _likely_edges(percent: int):
    """Edges that join the classes of each key as far as their bitmaps let them link."""

    def run(table: pa.Table) -> pa.Table:
        h, (cls, first, at) = table["h"].to_numpy(), np.unique(table["cls"].to_numpy(), return_index=True, return_inverse=True)
        sizes = table["n"].to_numpy()[first]
        maps = Bitmaps(table["bits"].take(pa.array(first)).to_pylist(), sizes, percent)
        order = np.lexsort((at, sizes[at], h))
        h, at = h[order], at[order]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])])
        h, at = h[once], at[once]
        start, length = T.runs_of(h)
        a, b = [at[:0]], [at[:0]]
        few = np.repeat(length <= PAIRED, length)
        left = np.flatnonzero(few)
        later = np.repeat(start + length, length)[left] - left - 1
        for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(later) // OPENED)) + 1):
            n = later[part]
            i = np.repeat(left[part], n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            good = maps.may_link(at[i], at[j])
            a.append(at[i[good]])
            b.append(at[j[good]])
        for low, n in zip(start[length > PAIRED].tolist(), length[length > PAIRED].tolist(), strict=True):
            own, label, lead = at[low : low + n], np.arange(n), n // 2
            for q in [lead, *range(n)]:
                if q != lead and label[q] == label[lead]:  # as in trie_components
                    continue
                near = np.arange(*np.searchsorted(sizes[own], [-(-percent * sizes[own[q]] // 100), 100 * sizes[own[q]] // max(percent, 1) + 1]))
                near = near[label[near] != label[q]]
                near = near[maps.may_link(np.full(len(near), own[q]), own[near])]
                if len(near):
                    a.append(np.full(len(near), own[q]))
                    b.append(own[near])
                    label[np.isin(label, label[near])] = label[q]
        a, b = spanning_edges(cls[np.concatenate(a)], cls[np.concatenate(b)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _fetch(k: int):
    def run(batches):
        for batch in (piece for whole in batches for piece in T.slices(whole)):
            out = [(g, c, len(s), s.tobytes()) for g, c, s in zip(batch.column("canopy").to_pylist(), batch.column("cls").to_pylist(), _sets(batch, k), strict=True) if T.set_digest(s) == c]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["canopy", "cls", "n", "set"])

    return run


def _join_group(percent: int):
    """All canopies that were dealt to one task, one after the other: (class, class it is linked with)."""

    def run(table: pa.Table) -> pa.Table:
        canopy, cls = table["canopy"].to_numpy(), table["cls"].to_numpy()
        order = np.lexsort((cls, canopy))
        start, length = T.runs_of(canopy[order])
        a, b = [], []
        for at, size in zip(start.tolist(), length.tolist(), strict=True):
            own = order[at : at + size]
            own = own[np.concatenate([[True], cls[own][1:] != cls[own][:-1]])]
            if len(own) > 1:
                root = trie_components([np.frombuffer(table["set"][int(i)].as_py(), np.uint64) for i in own], percent)
                moved = np.flatnonzero(root != np.arange(len(own)))
                a.append(cls[own[moved]])
                b.append(cls[own[root[moved]]])
        join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.table({"a": join(a), "b": join(b)})

    return run


# --- the operator


def _canopies(docs: DataFrame, k: int, percent: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """cls, canopy: classes that share a key of their prefixes, directly or through others; and the keys."""
    binary = lambda names: "part long, " + ", ".join(f"{x} binary" for x in names.split())
    emitted = docs.mapInArrow(_emit(k, percent, parts), binary("hs cs ns ss"))
    shared = emitted.groupBy("part").applyInArrow(_shared_only(parts), binary("cs hs ds ns ss"))
    keys = materialize(shared.groupBy("part").applyInArrow(_prefix_keys(percent, parts), binary("hs cs ns")))
    edges = keys.groupBy("part").applyInArrow(_key_edges(percent), "a long, b long")
    return connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("canopy")), keys


def _parted(sets: DataFrame, keys: DataFrame, large: DataFrame, percent: int, parts: int) -> DataFrame:
    """The sets with the canopies in `large` parted: classes stay together only through keys of pairs that may link."""
    hot = sets.join(large.select("canopy"), "canopy")
    marks = materialize(hot.mapInArrow(_marks, "cls long, n long, bits binary").dropDuplicates(["cls"]))
    # a class has a key for each 100 / (100 - percent) members at most, and half a byte at most for each member
    room = marks.agg(F.sum(F.col("n") * F.col("n"))).first()[0] * (100 - percent) // 200
    tasks = max(parts, room // 64_000_000 + 1)
    met = keys.mapInArrow(_key_rows, "h long, cls long").join(marks, "cls").withColumn("task", F.pmod("h", F.lit(tasks)))
    edges = met.groupBy("task").applyInArrow(_likely_edges(percent), "a long, b long")
    found = materialize(connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("canopy")))
    parted = hot.drop("canopy").join(found, "cls").select(*sets.columns)
    return materialize(sets.join(large.select("canopy"), "canopy", "left_anti").select(*sets.columns).union(parted))


def _small_links(sets: DataFrame, large: DataFrame | None, percent: int, parts: int) -> DataFrame:
    """a, b: a star for each component inside the canopies that one task can join."""
    ready = sets if large is None else sets.join(large.select("canopy"), "canopy", "left_anti")
    return materialize(ready.withColumn("task", F.pmod(F.xxhash64("canopy"), F.lit(parts))).groupBy("task").applyInArrow(_join_group(percent), "a long, b long"))


def _large_links(sets: DataFrame, large: DataFrame, percent: int, task_members: int) -> DataFrame:
    """a, b: links that join the components inside canopies (canopy, total, leader) of more members than a task takes.

    Each block of a canopy also gets the leader, so blocks of near copies hang together. What isn't in
    the leader's component after that meets every block; nothing else can add a link.
    """
    hot = sets.join(large, "canopy").withColumn("blocks", F.expr(f"total div {task_members} + 1"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    dealt = hot.withColumn("block", F.explode(F.when(F.col("cls") == F.col("leader"), every("blocks")).otherwise(F.array(block))))
    links = materialize(dealt.groupBy("canopy", "block").applyInArrow(_join_group(percent), "a long, b long"))
    found = connected_components(links)
    own = hot.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lead = own.where("cls = leader").select("canopy", F.col("component").alias("led")).distinct()
    rest = own.join(lead, "canopy").where("component <> led")
    if rest.isEmpty():
        return links
    chunks = rest.groupBy("canopy").agg((F.expr(f"sum(n) div {task_members}") + 1).alias("chunks"))
    base = hot.join(chunks, "canopy").withColumn("block", block).withColumn("chunk", F.explode(every("chunks")))
    asked = rest.join(chunks, "canopy").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks"))).withColumn("block", F.explode(every("blocks")))
    columns = ["canopy", "cls", "set", "block", "chunk"]
    both = base.select(*columns).union(asked.select(*columns))
    return links.union(both.groupBy("canopy", "block", "chunk").applyInArrow(_join_group(percent), "a long, b long"))


def _too_large(sets: DataFrame, task_members: int) -> DataFrame | None:
    """canopy, total, leader of the canopies above task_members, if there are any."""
    weight = sets.groupBy("canopy").agg(F.sum("n").alias("total"), F.min("cls").alias("leader"))
    sized = materialize(weight.where(F.col("total") > task_members))
    return None if sized.isEmpty() else sized


def canopy_components(sets: DataFrame, percent: int, parts: int, task_members: int) -> DataFrame:
    """node, component: the linked classes of canopies (canopy, cls, n, set), each class in one; a class linked with none may be missing."""
    large = _too_large(sets, task_members)
    stars = _small_links(sets, large, percent, parts)
    done = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
    return done if large is None else done.union(connected_components(_large_links(sets, large, percent, task_members)))


def bucket_components(sets: DataFrame, percent: int, parts: int, task_members: int) -> DataFrame:
    """As canopy_components, for classes in any number of buckets: only verified links make components."""
    large = _too_large(sets, task_members)
    links = _small_links(sets, large, percent, parts)
    return connected_components(links if large is None else links.union(_large_links(sets, large, percent, task_members)))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    task_members: int = TASK_MEMBERS,
    runs: int = 64,
) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, group_class, text_hash: one row per row of docs.

    class_id tells sets apart, group_class components (null for a text without words), text_hash
    (xxhash64 of the text) rows that repeat an id.

    Two texts link when 100 * |A and B| >= percent * |A or B| over their sets of distinct shingles of
    `words` words (A-Z lower-cased). A text with fewer words has its whole sequence as its only shingle;
    null, empty and blank texts have an empty set and link with nothing. component_id is the smallest
    id reachable by links, the row's own included. A null id gives back the row with a null
    component_id and takes no part; rows that repeat an id share a component only if their texts link.
    Other columns are ignored; no rows give no rows.

    The join is exact up to collisions of 64-bit hashes:
    1. Texts with equal sets are one class, however many copies there are.
    2. Shingles get a global order: a low part of the hash range first, rarest first in each part, where
       rarity is counted over all classes. Only the prefix that links must meet in is kept, and of it
       only shingles that another class holds; most classes drop out here.
    3. Classes that share such a key form canopies. Sets of a canopy are fetched from the texts and
       joined in a prefix tree. A canopy above `task_members` is parted first: bitmaps of its sets tell
       which pairs that share a key cannot link. What is still above is dealt to blocks, in two rounds
       that compare all that the first leaves outside its leader's component with every block.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = rows.withColumn("sig", F.xxhash64("text"))
    table = materialize(signed.mapInArrow(_classes(words), "doc_id long, sig long, n long, cls long"))
    table = table.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    real = rows.where(F.col("doc_id").isNotNull())
    leaves = table.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls", "run").agg(F.min("doc_id").alias("first"))
    reps = leaves.groupBy("cls").agg(F.min("first").alias("first"))
    canopy, keys = _canopies(real, words, percent, parts)
    canopy = materialize(canopy)
    wanted = canopy.join(reps, "cls").select(F.col("first").alias("doc_id"), "cls", "canopy")
    few = canopy.count() <= 200_000
    sets = real.join(F.broadcast(wanted) if few else wanted, "doc_id").select("canopy", "cls", "text")
    sets = materialize(sets.mapInArrow(_fetch(words), "canopy long, cls long, n long, set binary"))
    if (large := _too_large(sets, task_members)) is not None:
        sets = _parted(sets, keys, large, percent, parts)
    linked = canopy_components(sets, percent, parts, task_members)
    classes = reps.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "component").select("cls", "component_id", "component")
    per_run = leaves.select("cls", "run").join(named, "cls")
    out = table.join(per_run, ["cls", "run"], "left")
    alone = F.when((F.col("n") == 0) | F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.col("cls").alias("class_id"), F.col("component").alias("group_class"), F.col("sig").alias("text_hash"))
