"""Statistics of all pairs of items that users rated together, block by block of items.

The rows of pairs never travel: a user's ratings are one row, which goes to each block of items that it touches. There the
sums of a stripe of items are dense arrays, and what is asked about those items is answered from them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.operators.scratch import written

#: Pairs of ratings in a block, as far as one item alone has not more; cells of a stripe's arrays; pairs opened at once.
BLOCK, CELLS, OPENED = 16_000_000, 2_000_000, 1_000_000


def profiles(rated: DataFrame) -> DataFrame:
    """user, seen: the ratings (item, stars, asked) of a user in the order of items, a null item first. rated: user, item, stars, asked."""
    seen = F.struct("item", F.col("stars").cast("double").alias("stars"), "asked")
    return written(rated.groupBy("user").agg(F.array_sort(F.collect_list(seen)).alias("seen")))


def _items(held: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Items in order, null first; the mean of each over the ratings that are not asked; which have none; the block of each.

    Ratings without a user count in the mean of their item, as in SQL, and nowhere else; null has no mean.
    """
    flat = held.select(F.size("seen").cast("long").alias("size"), F.explode("seen").alias("x")).select("size", "x.*")
    stats = flat.groupBy("item").agg(F.avg(F.when(~F.col("asked"), F.col("stars"))).alias("mean"), F.sum("size").alias("pairs"))
    table = stats.orderBy("item").toArrow().combine_chunks()
    values = [table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type) for c in table.column_names]
    items, means, pairs = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in values)
    pairs = pairs.to_numpy(zero_copy_only=False).astype(np.int64)
    none = means.is_null().to_numpy(zero_copy_only=False) | items.is_null().to_numpy(zero_copy_only=False)
    return items, means.to_numpy(zero_copy_only=False).astype(float), none, ((np.cumsum(pairs) - pairs) // BLOCK).astype(np.int32)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - starts, lens)


def _lists(values: np.ndarray | pa.Array, lens: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(values))


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), lens


def _dealt(held: DataFrame, known, whole: bool) -> DataFrame:
    """block, user, user_mean, item (its number, -1 less if asked), stars: the ratings of a user, once for each block that holds one of its items.

    whole: all ratings go, and what is asked in the block; else those from the block's first item on. Ratings without an item
    count in their user's mean only, those without a user don't go; what is asked about either goes, and finds no neighbours.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, _, _, block_of = known.value
        for batch in batches:
            seen, lens = _flat(batch.column("seen"))
            if not len(seen):
                continue
            item = pc.index_in(seen.field("item"), value_set=items).to_numpy(zero_copy_only=False).astype(np.int64)
            stars = seen.field("stars").to_numpy(zero_copy_only=False).astype(float)
            missing = seen.field("stars").is_null().to_numpy(zero_copy_only=False)
            asked = seen.field("asked").to_numpy(zero_copy_only=False).astype(bool)
            row, nobody = np.repeat(np.arange(len(lens)), lens), batch.column("user").is_null().to_numpy(zero_copy_only=False)
            counts = ~asked & ~missing & ~nobody[row]
            n = np.bincount(row[counts], minlength=len(lens))
            with np.errstate(invalid="ignore"):
                means = np.bincount(row[counts], stars[counts], len(lens)) / n
            goes = asked | ~(nobody[row] | seen.field("item").is_null().to_numpy(zero_copy_only=False))
            if not goes.any():
                continue
            item, stars, missing, asked, row = (x[goes] for x in (item, stars, missing, asked, row))
            lens = np.bincount(row, minlength=len(lens))
            ends, block = np.cumsum(lens), block_of[item]
            first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(block) != 0)))
            start = (ends - lens)[row[first]] if whole else first
            size = ends[row[first]] - start
            at, part = _ranges(start, size), np.repeat(np.arange(len(first)), size)
            kept = ~asked[at] | (block[at] == block[first][part])
            at, size = at[kept], np.bincount(part[kept], minlength=len(first))
            numbers = np.where(asked[at], -1 - item[at], item[at]).astype(np.int32)
            users, mean = batch.column("user").take(pa.array(row[first])), means[row[first]]
            columns = [pa.array(block[first]), users, pa.array(mean, mask=n[row[first]] == 0), _lists(numbers, size), _lists(pa.array(stars[at], mask=missing[at]), size)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "user", "user_mean", "item", "stars"])

    kind = held.schema["user"].dataType.simpleString()
    made = held.mapInArrow(deal, f"block int, user {kind}, user_mean double, item array<int>, stars array<double>")
    return made.repartition("block").sortWithinPartitions("block")


class Block:
    """The rows of a block as flat arrays; ratings to learn from lie in `item` and `d` (stars less the item's mean)."""

    def __init__(self, rows: list[pa.RecordBatch], known: tuple, number: int):
        _, means, _, block_of = known
        table = pa.Table.from_batches(rows)
        column = lambda c: pa.concat_arrays(table.column(c).chunks)
        (item, lens), (stars, _) = _flat(column("item")), _flat(column("stars"))
        item, missing, stars = item.to_numpy(zero_copy_only=False), stars.is_null().to_numpy(zero_copy_only=False), stars.to_numpy(zero_copy_only=False)
        row, learn = np.repeat(np.arange(len(lens)), lens), item >= 0
        self.user, self.user_mean = column("user"), column("user_mean")
        self.asked_row, self.asked_item, self.asked_stars = row[~learn], -1 - item[~learn].astype(np.int64), pa.array(stars[~learn], mask=missing[~learn])
        self.item, self.stars = item[learn].astype(np.int64), stars[learn]
        self.lens = np.bincount(row[learn], minlength=len(lens))
        self.starts = np.cumsum(self.lens) - self.lens
        with np.errstate(invalid="ignore"):
            self.row, self.d = row[learn], self.stars - means[self.item]
        self.missing = missing[learn]
        self.d[self.missing] = 0
        self.no_number = bool(np.isnan(self.d).any())
        self.columns, self.column = np.unique(self.item, return_inverse=True)
        here = np.flatnonzero(block_of[self.item] == number)
        self.left = here[np.argsort(self.item[here], kind="stable")]
        self.first, self.last = np.searchsorted(block_of, [number, number + 1])

    def stripes(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """first item, item after the last, positions of their ratings: so that a stripe has few cells."""
        step = max(1, CELLS // max(1, len(self.columns)))
        for low in range(self.first, self.last, step):
            high = min(low + step, self.last)
            yield low, high, self.left[slice(*np.searchsorted(self.item[self.left], [low, high]))]

    def opened(self, lefts: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of both ratings of each pair: with all of the user's, or only those after the left one."""
        end = self.starts[self.row[lefts]] + self.lens[self.row[lefts]]
        start = self.starts[self.row[lefts]] if whole else lefts + 1
        sizes = end - start
        cut = np.cumsum(sizes) // OPENED
        for part in np.split(np.arange(len(lefts)), np.flatnonzero(np.diff(cut)) + 1):
            yield np.repeat(lefts[part], sizes[part]), _ranges(start[part], sizes[part])

    def sums(self, low: int, high: int, lefts: np.ndarray, whole: bool, own_means: bool) -> tuple[np.ndarray, np.ndarray]:
        """n and similarity of (item - low, column), n 0 where no user has both."""
        width = len(self.columns)
        cells = (high - low) * width
        n, up, xx, yy = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells), np.zeros(cells)
        if own_means:
            m, x1, y1 = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells)
            least = np.full((2, cells), np.inf)
            most = -least
        elif self.no_number:
            given = np.zeros((2, cells), np.int64)
        for x, y in self.opened(lefts, whole):
            key = (self.item[x] - low) * width + self.column[y]
            n += np.bincount(key, minlength=cells)
            if own_means:
                good = ~(self.missing[x] | self.missing[y])
                x, y, key = x[good], y[good], key[good]
            dx, dy = self.d[x], self.d[y]
            for into, values in ((up, dx * dy), (xx, dx * dx), (yy, dy * dy)):
                into += np.bincount(key, values, cells)
            if own_means:
                m += np.bincount(key, minlength=cells)
                for k, (into, values) in enumerate(((x1, dx), (y1, dy))):
                    into += np.bincount(key, values, cells)
                    np.minimum.at(least[k], key, values)
                    np.maximum.at(most[k], key, values)
            elif self.no_number:
                for k, z in enumerate((x, y)):
                    given[k] += np.bincount(key[~self.missing[z]], minlength=cells)
        same = (np.arange(low, high)[:, None] == self.columns).ravel()
        n[same] = 0
        with np.errstate(all="ignore"):
            if own_means:
                flat = (m == 0) | (least >= most).any(0)
                sim = np.where(flat, np.nan, (up - x1 * y1 / m) / (np.sqrt(xx - x1 * x1 / m) * np.sqrt(yy - y1 * y1 / m)))
            else:
                down = np.sqrt(xx) * np.sqrt(yy)
                sim = np.where(down <= 0, 0.0, up / down)
                if self.no_number:  # NaN, unless a side has no stars at all
                    sim[(given == 0).any(0)] = 0.0
        return n, sim


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """block, its rows: of a partition where a block's rows lie together."""
    held, at = [], None
    for batch in batches:
        number = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(np.append(len(number) > 0, np.diff(number) != 0)), len(number))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if at is not None and number[a] != at:
                yield at, held
                held = []
            at = int(number[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield at, held


def adjusted(n: np.ndarray, raw: np.ndarray, least_common: int, rule: str) -> np.ndarray:
    """The similarity by rule, see similarity.pearson."""
    amplified = np.where(raw < 0, raw * 0.1, raw * 1.1)
    if rule == "plain":
        return np.where(n < least_common, 0.0, raw)
    if rule == "amplified":
        return np.where(n < least_common, 0.0, amplified)
    if rule == "floor":
        return np.where(n <= 1, 0.0, np.where(n < 10, 0.05, amplified))
    if rule == "strict":
        return np.where((n <= 20) | (raw < 0), 0.0, raw * 1.1)
    raise ValueError(f"no such rule: {rule}")


def similarities(ratings: DataFrame, least_common: int, rule: str | None, without_user: bool = False) -> DataFrame:
    """a < b, n, sim of all pairs that a user rated both; rule None: the correlation about the means over common users, NaN where one side is constant.

    without_user: ratings without a user count in the means of items.
    """
    if rule is not None:
        adjusted(np.zeros(0), np.zeros(0), least_common, rule)
    rated = ratings if without_user else ratings.where(F.col("user").isNotNull())
    held = profiles(rated.select("user", "item", "stars", F.lit(False).alias("asked")))
    known = ratings.sparkSession.sparkContext.broadcast(_items(held))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value[0]
        for block in (Block(rows, known.value, at) for at, rows in by_block(batches)):
            for low, high, lefts in block.stripes():
                n, sim = block.sums(low, high, lefts, False, rule is None)
                sim = sim if rule is None else adjusted(n, sim, least_common, rule)
                found = np.flatnonzero(n)
                for at in np.split(found, range(200_000, len(found), 200_000)):
                    a, b = at // len(block.columns) + low, block.columns[at % len(block.columns)]
                    yield pa.RecordBatch.from_arrays([items.take(pa.array(a)), items.take(pa.array(b)), pa.array(n[at]), pa.array(sim[at])], ["a", "b", "n", "sim"])

    kind = ratings.schema["item"].dataType.simpleString()
    return _dealt(held, known, False).mapInArrow(pairs, f"a {kind}, b {kind}, n long, sim double")


def answers(rated: DataFrame, least_common: int, rule: str, ladder, strong_above: float = 0.9) -> DataFrame:
    """For each asked row of rated(user, item, stars, asked): user, item, stars, user_mean, item_mean, n, up, down, sims, strong.

    The other rows are learned from. n: neighbours that the ladder admits; up, down, sims: weighted sum, weights and
    similarities (largest first) of its best (up: null if none of them has stars); strong: all rated items more similar than strong_above.
    """
    adjusted(np.zeros(0), np.zeros(0), least_common, rule)
    held = profiles(rated)
    known = rated.sparkSession.sparkContext.broadcast(_items(held))
    nonzero, sign = ladder.nonzero_only and ladder.above == 0, -1 if ladder.most_similar else 1

    def near(block: Block, sim: np.ndarray, n: np.ndarray, low: int, asked: np.ndarray) -> pa.RecordBatch:
        rows = block.asked_row[asked]
        sizes = block.lens[rows]
        other, query = _ranges(block.starts[rows], sizes), np.repeat(np.arange(len(asked)), sizes)
        cell = np.repeat(block.asked_item[asked] - low, sizes) * len(block.columns) + block.column[other]
        value, common = sim[cell], n[cell] > 0
        # NaN is above every number, as in Spark and SQL
        strong = np.bincount(query[common & ~(value <= strong_above)], minlength=len(asked))
        good = common & ((value != 0) if nonzero else ~(value <= ladder.above))
        query, value, other = query[good], value[good], other[good]
        rank = lambda v, sign: np.where(np.isnan(v), sign * np.inf, sign * v)
        order = np.lexsort((block.item[other], rank(value, sign), query))
        query, value, other = query[order], value[order], other[order]
        count = np.bincount(query, minlength=len(asked))
        best = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) < ladder.top
        query, value, other = query[best], value[best], other[best]
        # a neighbour without stars has no part in the weighted sum
        has = ~block.missing[other]
        up = np.bincount(query[has], (value * block.stars[other])[has], len(asked)).astype(float)  # whole numbers if empty
        no_sum = np.bincount(query[has], minlength=len(asked)) == 0
        down = np.bincount(query, np.abs(value), len(asked)).astype(float)
        by_size = np.lexsort((rank(value, -1), query))
        items, means, none, _ = known.value
        item = block.asked_item[asked]
        columns = [
            block.user.take(pa.array(rows)), items.take(pa.array(item)), block.asked_stars.take(pa.array(asked)), block.user_mean.take(pa.array(rows)),
            pa.array(means[item], mask=none[item]), pa.array(count), pa.array(up, mask=no_sum), pa.array(down), _lists(value[by_size], np.bincount(query, minlength=len(asked))), pa.array(strong),
        ]
        return pa.RecordBatch.from_arrays(columns, ["user", "item", "stars", "user_mean", "item_mean", "n", "up", "down", "sims", "strong"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (Block(rows, known.value, at) for at, rows in by_block(batches)):
            by_item = np.argsort(block.asked_item, kind="stable")
            for low, high, lefts in block.stripes():
                asked = by_item[slice(*np.searchsorted(block.asked_item[by_item], [low, high]))]
                if not len(asked):
                    continue
                n, raw = block.sums(low, high, lefts, True, False)
                sim = adjusted(n, raw, least_common, rule)
                cut = np.cumsum(block.lens[block.asked_row[asked]]) // OPENED
                for part in np.split(asked, np.flatnonzero(np.diff(cut)) + 1):
                    yield near(block, sim, n, low, part)

    user, item = (rated.schema[c].dataType.simpleString() for c in ("user", "item"))
    out = f"user {user}, item {item}, stars double, user_mean double, item_mean double, n long, up double, down double, sims array<double>, strong long"
    return _dealt(held, known, True).mapInArrow(predict, out)
