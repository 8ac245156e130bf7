"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.llm.storage import materialize

WORD = regex.compile(r"\p{L}+")
#: What ASCII characters become before words are split at blanks.
_ASCII = "".join(chr(i).lower() if chr(i).isalpha() else " " for i in range(128))
#: predicted is 1 from this score on.
CUT = 0.7
#: Examples in one block of the index.
BLOCK = 64
#: Blocks opened before any cosine is known.
_FIRST = 4
#: At most so many of the longest lists, each held by an eighth of the examples or more, are kept as rows of a matrix.
_FULL = 192
#: Texts scored against them at once: 16 x 192 x 64 is a product too small for BLAS to wake further threads.
_TOGETHER = 16
#: Weight of a word that toxic examples don't favour, against 1 for each standard deviation by which they do.
FLOOR = 0.2
_CACHE = 300_000
_TEXTS = 20_000


def _bag(text: str | None) -> Counter:
    text = text or ""
    return Counter(text.translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower()))


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def _bags(batches):
    """Sorted word hashes and counts of each example."""
    for batch in batches:
        flat, tf, cuts = [], [], [0]
        for text in batch.column("text"):
            own = sorted((_hash(w), n) for w, n in _bag(text.as_py()).items())
            flat += [x[0] for x in own]
            tf += [x[1] for x in own]
            cuts.append(len(flat))
        at = pa.array(cuts, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(flat, pa.int64())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "terms", "tf"])


class _Reader:
    """Texts as positions in the sorted vocabulary and counts; words outside it are left out."""

    def __init__(self, vocab: np.ndarray):
        self.vocab, self.known = vocab, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        bag = _bag(text)
        try:
            t = list(map(self.known.__getitem__, bag))
        except KeyError:
            self._learn(bag)
            t = list(map(self.known.__getitem__, bag))
        t, tf = np.array(t, np.int32), np.fromiter(bag.values(), np.int32, len(bag))
        order = np.argsort(t, kind="stable")
        order = order[np.searchsorted(t, 0, sorter=order) :]
        return t[order], tf[order]

    def _learn(self, bag: Counter) -> None:
        if len(self.known) > _CACHE:
            self.known.clear()
        new = [w for w in bag if w not in self.known]
        h = np.array([_hash(w) for w in new], np.int64)
        at = np.searchsorted(self.vocab, h)
        there = np.zeros(len(h), bool)
        inside = at < len(self.vocab)
        there[inside] = self.vocab[at[inside]] == h[inside]
        self.known.update(zip(new, np.where(there, at, -1).tolist(), strict=True))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    cuts = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))


def _vectors(vocab):
    """Each row's terms and their counts."""

    def run(batches):
        read = _Reader(vocab.value)
        for batch in batches:
            made = [read(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists([m[0] for m in made]), _lists([m[1] for m in made])], ["doc_id", "terms", "tf"])

    return run


def _held(n_terms: int):
    """Per task: how many rows there are (term -1) and how many hold each term."""

    def run(batches):
        counts, rows = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            counts += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(counts[held], rows))], ["term", "n"])

    return run


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


class BlockMaxIndex:
    """Unit vectors of the examples as inverted lists; each list knows its largest weight in every block it reaches.

    The longest lists reach every block with much the same weight, so their bounds shut nothing: they are full rows of
    each block, whose part of all cosines is a matrix product, and only the others are read block by block.
    """

    def __init__(self, doc_ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.doc_ids, self.labels = np.array(doc_ids, np.int64), np.array(labels, float)
        self.blocks = -(-len(doc_ids) // BLOCK)
        term = np.concatenate([t for t, _ in vectors]).astype(np.int64) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        at = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        length = np.bincount(term, minlength=n_terms)
        long = np.argsort(-length, kind="stable")[:_FULL]
        long = long[8 * length[long] >= max(len(doc_ids), 1)]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[long] = np.arange(len(long))
        self.full = np.zeros((self.blocks, len(long), BLOCK))
        mine = self.row[term] >= 0
        self.full[at[mine] // BLOCK, self.row[term[mine]], at[mine] % BLOCK] = weight[mine]
        term, at, weight = term[~mine], at[~mine], weight[~mine]
        order = np.argsort(term, kind="stable")
        term, self.at, self.own = term[order], at[order], weight[order]
        self.lists = np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int32)
        # A run: the part of one list that lies in one block.
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (self.at[1:] // BLOCK != self.at[:-1] // BLOCK)
        self.start = np.flatnonzero(first).astype(np.int32)
        self.block = self.at[self.start] // BLOCK
        self.most = np.maximum.reduceat(self.own, self.start) if len(term) else np.empty(0)
        self.runs = np.searchsorted(term[self.start], np.arange(n_terms + 1)).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(term)))

    def _listed(self, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Every example's sum over the given parts of lists, a row for each block."""
        length = ends - starts
        posts = _ranges(starts, length)
        sums = np.bincount(self.at[posts], weights=np.repeat(weight, length) * self.own[posts], minlength=self.blocks * BLOCK)
        return sums.reshape(-1, BLOCK)

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each text."""
        made = []
        for i in range(0, len(texts), _TOGETHER):
            group = texts[i : i + _TOGETHER]
            asked = np.zeros((len(group), self.full.shape[1]))
            for j, (t, w) in enumerate(group):
                row = self.row[t]
                asked[j, row[row >= 0]] = w[row >= 0]
            sums = (asked @ self.full).swapaxes(0, 1)
            made += [self._nearest(t, w, own, k) for (t, w), own in zip(group, sums, strict=True)]
        return made

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest with a positive cosine, nearest first, ties to the lower position.

        The blocks of the highest bounds are opened first, then all others whose bound reaches the k-th cosine found;
        the rest stay shut. Where most blocks are open, whole lists are read instead of their runs. Cosines are rounded
        to 12 places, so that equal examples tie.
        """
        return self.nearest_of([(t, w)], k)[0]

    def _nearest(self, t: np.ndarray, w: np.ndarray, full: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """full: what the full rows give each example, a row for each block."""
        found, sims = np.empty(0, np.int64), np.empty(0)
        if not len(t) or not len(self.doc_ids):
            return found, sims
        listed = self.row[t] < 0
        t, w = t[listed], w[listed]
        many = self.runs[t + 1] - self.runs[t]
        runs, weight = _ranges(self.runs[t], many), np.repeat(w, many)
        block = self.block[runs]
        bounds = np.bincount(block, weights=weight * self.most[runs], minlength=self.blocks) + full.max(1)
        left = bounds > 0
        for group in (np.argsort(-bounds, kind="stable")[:_FIRST], slice(None)):
            wanted = np.zeros(self.blocks, bool)
            wanted[group] = left[group]
            if len(found) == k:
                wanted &= bounds >= sims[-1] - 1e-9
            opened = np.flatnonzero(wanted)
            if not len(opened):
                break
            if 2 * len(opened) > self.blocks:
                sums = self._listed(self.lists[t], self.lists[t + 1], w)
            else:
                mine = wanted[block]
                sums = self._listed(self.start[runs[mine]], self.start[runs[mine] + 1], weight[mine])
            left[opened] = False
            scores = np.round(sums[opened] + full[opened], 12).ravel()
            least = sims[-1] if len(found) == k else np.partition(scores, -k)[-k] if len(scores) > k else 0.0
            hit = np.flatnonzero((scores >= least) & (scores > 0))
            found, sims = np.concatenate([found, opened[hit // BLOCK] * BLOCK + hit % BLOCK]), np.concatenate([sims, scores[hit]])
            keep = np.lexsort((found, -sims))[:k]
            found, sims = found[keep], sims[keep]
        return found, sims

    def vote(self, at: np.ndarray, sims: np.ndarray, prior: float) -> tuple[float, list[tuple[int, float]]]:
        """Share of toxic among neighbours, each weighted by closeness, with one far vote for the prior."""
        weight = 1 / (1.05 - np.minimum(sims, 1.0))
        score = (float(weight @ self.labels[at]) + prior) / (float(weight.sum()) + 1)
        return score, list(zip(self.doc_ids[at[:3]].tolist(), sims[:3].tolist(), strict=True))


def _unit(t: np.ndarray, tf: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(tf)) * weights[t]
    return t, w / max(float(np.sqrt(w @ w)), 1e-12)


def _favour(terms: list[np.ndarray], toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """By how many standard deviations more toxic examples hold each term than their share of all that hold it; 0 if fewer."""
    held, bad = np.zeros(n_terms), np.zeros(n_terms)
    for own, label in zip(terms, toxic, strict=True):
        held[own] += 1
        bad[own] += label
    share = float(toxic.sum()) / max(len(toxic), 1)
    return np.maximum((bad - held * share) / np.sqrt(held * share * (1 - share) + 1), 0)


def _examples(rows: DataFrame, chosen: DataFrame, postings: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """doc_ids, labels and (word hashes, counts) of the chosen rows, while their words fit in `postings`."""
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    bags = materialize(one.mapInArrow(_bags, "doc_id long, label int, terms array<long>, tf array<int>").withColumn("h", F.xxhash64("doc_id")))
    sizes = bags.select("h", "doc_id", F.size("terms").alias("n")).toPandas().sort_values(["h", "doc_id"], kind="stable")
    fits = sizes[sizes["n"].cumsum() <= postings]
    if not len(fits):
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    last = F.struct(F.lit(int(fits["h"].iloc[-1])).alias("h"), F.lit(int(fits["doc_id"].iloc[-1])).alias("doc_id"))
    table = bags.where(F.struct("h", "doc_id") <= last).drop("h").toArrow().combine_chunks().sort_by("doc_id")
    flat = [(row.values.to_numpy(), tf.values.to_numpy().astype(float)) for row, tf in zip(table["terms"], table["tf"], strict=True)]
    return table["doc_id"].to_numpy(), table["label"].to_numpy(), flat


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 16,
    sample: int = 8192,
    postings: int = 4_000_000,
) -> DataFrame:
    """doc_id, score (0 to 1), predicted, evidence: one row per row of docs; labels: doc_id, label of the rows to learn from.

    At most `sample` labelled documents (smallest hashes of their ids, as many of them as have at most `postings`
    different words together) are the examples. Every word of theirs is a term, all of them are in the index, and each
    text is compared by all such words that it holds; words that no example holds have no place in the vectors. Weight
    of a term: 1 + log of its count, times its inverse document frequency over all of docs, times FLOOR plus the
    standard deviations by which toxic examples favour it. Words are told apart by 64-bit hashes.

    evidence: id and cosine of the three nearest examples, never the row itself. A text without any term, null and
    empty texts included, has no neighbours and gets the share of toxic examples. Of rows that repeat an example's id,
    the one with the smallest hash of its text is the example. Repeated rows and a null id are scored as they are;
    other columns are ignored; no rows give no rows; without labels the score is 0.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # bounded, so it may be broadcast
    ids, marks, bags = _examples(rows, chosen, postings)
    vocab, term = np.unique(np.concatenate([np.empty(0, np.int64), *(t for t, _ in bags)]), return_inverse=True)
    terms = np.split(term, np.cumsum([len(t) for t, _ in bags])[:-1]) if bags else []
    favour = _favour(terms, marks, len(vocab))
    words = context.broadcast(vocab)
    texts = materialize(rows.mapInArrow(_vectors(words), "doc_id long, terms array<int>, tf array<int>"))
    held = texts.select("terms").mapInArrow(_held(len(vocab)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term
    held = dict(zip(held["term"].to_pylist(), held["n"].to_pylist(), strict=True))
    total = held.pop(-1, 0)
    counts = np.zeros(len(vocab))
    counts[list(held)] = list(held.values())
    weights = (np.log((total + 1) / (counts + 1)) + 1) * (FLOOR + favour)
    vectors = [_unit(t, tf, weights) for t, (_, tf) in zip(terms, bags, strict=True)]
    # Like examples share blocks, so bounds are tight: by label and strongest term.
    order = sorted(range(len(ids)), key=lambda i: (marks[i], vectors[i][0][np.argmax(vectors[i][1])] if len(vectors[i][0]) else -1, ids[i]))
    index = BlockMaxIndex([ids[i] for i in order], [marks[i] for i in order], [vectors[i] for i in order], len(vocab))
    prior = float(marks.sum()) / (len(marks) + 1)
    shared = context.broadcast((index, weights, prior))

    def run(batches):
        index, weights, prior = shared.value
        known: dict[bytes, tuple] = {}
        for batch in batches:
            keys, asked = [], {}
            for t, tf in zip(batch.column("terms"), batch.column("tf"), strict=True):
                t, tf = t.values.to_numpy(zero_copy_only=False), tf.values.to_numpy(zero_copy_only=False)
                keys.append(xxhash.xxh3_128_digest(t.tobytes() + tf.tobytes()))
                if keys[-1] not in known:
                    asked[keys[-1]] = _unit(t, tf, weights)
            got = {key: known[key] for key in keys if key in known}
            if len(known) > _TEXTS:
                known.clear()
            got.update(zip(asked, index.nearest_of(list(asked.values()), k + 1), strict=True))
            known.update(got)
            scores, evidence = [], []
            for doc_id, key in zip(batch.column("doc_id").to_pylist(), keys, strict=True):
                at, sims = got[key]
                other = index.doc_ids[at] != doc_id  # an example is no neighbour of itself
                score, near = index.vote(at[other][:k], sims[other][:k], prior)
                scores.append(score)
                evidence.append([{"doc_id": a, "cosine": b} for a, b in near])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    made = texts.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double>>")
    return made.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
