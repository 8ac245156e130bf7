"""Language identification: words first, then ever shorter character n-grams for words never seen."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = regex.compile(r"\p{L}+")
#: Longest character n-gram.
LONGEST = 5
#: Words that add evidence up to this number; more only make the mean more exact.
EVIDENCE = 10
UNKNOWN = "und"
#: Runs of more letters are no word of the model; all their n-grams are counted and read.
LONG = 256
#: Words whose scores a worker keeps.
_CACHE = 200_000


@dataclass
class Model:
    """Log frequencies by language; table 0 holds words, table n the n-grams. Tables give rows of one matrix."""

    langs: list[str]
    tables: list[dict[str, int]]
    values: np.ndarray
    floors: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    @classmethod
    def fit(cls, langs: list[str], rows: list[tuple[int, str, str, int]]) -> Model:
        """rows: (n, text, language, count)."""
        at = {x: i for i, x in enumerate(langs)}
        tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        order: list[int] = []
        for n, text, _, _ in rows:
            if text not in tables[n]:
                tables[n][text] = len(order)
                order.append(n)
        counts = np.zeros((len(order), len(langs)))
        for n, text, lang, count in rows:
            counts[tables[n][text], at[lang]] += count
        of, floors = np.array(order, np.int64), np.zeros((LONGEST + 1, len(langs)))
        values = np.zeros(counts.shape, np.float32)
        for n in range(LONGEST + 1):
            total = counts[of == n].sum(0) + 0.5 * (len(tables[n]) + 1)
            values[of == n] = np.log((counts[of == n] + 0.5) / total)
            floors[n] = np.log(0.5 / total)
        return cls(langs, tables, values, floors)

    def word(self, word: str) -> np.ndarray:
        """Log scores of one word in every language, centred on their mean."""
        row = self.tables[0].get(word)
        if row is not None:
            found = self.values[row].astype(float)
        else:
            padded, i, pieces, found = f"^{word}$", 0, 0, np.zeros(len(self.langs))
            while i < len(padded):
                for n in range(min(LONGEST, len(padded) - i), 0, -1):
                    row = self.tables[n].get(padded[i : i + n])
                    if row is not None or n == 1:
                        found = found + (self.floors[1] if row is None else self.values[row])
                        i, pieces = i + n, pieces + 1
                        break
            found = found / max(1, pieces) * 1.5
        return found - found.mean()

    def score(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall((text or "").lower())
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if self.rows is None:
            self.rows = np.zeros((_CACHE, len(self.langs)), np.float32)
        total, known, at, times = np.zeros(len(self.langs)), self.known, [], []
        for w, n in Counter(words).items():
            row = known.get(w)
            if row is None and len(w) > 40:  # odd and long: not worth keeping
                total += self.word(w) * n
                continue
            if row is None:
                if len(known) == _CACHE:  # what was looked up so far is summed before the rows are used again
                    total += np.array(times, float) @ self.rows[at] if at else 0.0
                    known.clear()
                    at, times = [], []
                row = known[w] = len(known)
                self.rows[row] = self.word(w)
            at.append(row)
            times.append(n)
        if at:
            total += np.array(times, float) @ self.rows[at]
        mean = total / len(words) * min(len(words), EVIDENCE)
        odds = np.exp(mean - mean.max())
        best = int(np.argmax(odds))  # ties: the language first in code point order
        return self.langs[best], float(odds[best] / odds.sum())


def _count(batches):
    """Per task and language, how often each word and n-gram occurs."""
    counts: dict[str, Counter] = {}

    def table(lang: str, n: int, found: Counter):
        size = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * size, pa.string()), pa.array([n] * size, pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
            ["lang", "n", "gram", "count"],
        )

    def out():
        for lang, words in counts.items():
            yield table(lang, 0, Counter({w: times for w, times in words.items() if len(w) <= LONG}))
            for n in range(1, LONGEST + 1):  # one length at a time, to hold one table only
                grams: Counter = Counter()
                for w, times in words.items():
                    padded = f"^{w}$"
                    for i in range(len(padded) - n + 1):
                        grams[padded[i : i + n]] += times
                yield table(lang, n, grams)
        counts.clear()

    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = WORD.findall((text or "").lower())
            counts.setdefault(lang, Counter()).update(found)
            held += sum(len(w) for w in found if len(w) > LONG)
            if held > 4_000_000 or sum(map(len, counts.values())) > 50_000:
                yield from out()
                held = 0
    yield from out()


def train(docs: DataFrame, sample: int = 12_000, words: int = 20_000, grams: int = 8_000) -> Model:
    """From doc_id, text, lang: a fit on at most `sample` documents (smallest hashes of their ids).

    Per language the `words` most frequent words and `grams` most frequent n-grams of each length make
    the model, so its size is bounded by the parameters and the number of languages.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = labelled.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    chosen = labelled.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").select("lang", "text")
    counted = chosen.repartition(16).mapInArrow(_count, "lang string, n int, gram string, count long")
    totals = counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    best = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram")
    kept = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.when(F.col("n") == 0, words).otherwise(grams))
    table = kept.select("n", "gram", "lang", "count").toArrow().to_pydict()
    langs = sorted(set(table["lang"]))
    return Model.fit(langs, list(zip(*(table[x] for x in ("n", "gram", "lang", "count")), strict=True)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """docs' id as doc_id, lang_pred and score (0 to 1), and text_hash (xxhash64 of the text) where asked: one row per row of docs.

    Words are read to their last letter, however long. Null texts and texts without a letter get `und` and 0.0; ties go to the language first in code
    point order. A model without languages answers `und` for all. Repeated rows and a null id are answered
    each; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables, model.values, model.floors))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            made = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), *([batch.column("text_hash")] if text_hash else [])],
                ["doc_id", "lang_pred", "score", *(["text_hash"] if text_hash else [])],
            )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([F.xxhash64(text).alias("text_hash")] if text_hash else []))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double" + (", text_hash long" if text_hash else ""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds
