import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from awkward_rows import AWKWARD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orequarry.llm import bpe, mixing, vector_search

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_mix(docs, near, **how):
    got = mixing.mix_sources(docs, **how).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORD.findall(r.text or ""))
    targets = brute.mix_targets(sizes, 1.5, 2.0, (3.0, 1.0, 2.0))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.source_size)
    want = [(r.doc_id, len(brute.WORD.findall(r.text or "")), sizes[r.source]) for r in rows]
    assert sorted(key(r) for r in got) == sorted((i is None, i or 0, n, m) for i, n, m in want)
    assert all(0 <= r.taken <= 2 * r.size and (r.taken > 0) == (r.first_slot is not None) for r in got)
    groups: dict = {}  # sources of one size and target together
    for s, n in sizes.items():
        groups.setdefault((n, round(targets[s], 6)), []).append(targets[s])
    for (n, t), own in groups.items():
        taken = sum(r.taken for r in got if r.source_size == n and r.target == pytest.approx(t))
        assert abs(taken - sum(own)) <= sum(near(x) for x in own)
    return got


def test_mix_comes_near_its_targets(documents):
    check_mix(documents, lambda t: 6 + 0.02 * t)
    check_mix(documents, lambda t: 6 + 0.02 * t, ranges=3)
    again = [{tuple(r) for r in mixing.mix_sources(documents.repartition(n)).collect()} for n in (2, 5)]
    assert again[0] == again[1]


def test_mix_on_awkward_rows(awkward, nothing):
    assert len(check_mix(awkward, lambda t: 1)) == len(AWKWARD)
    assert mixing.mix_sources(nothing).count() == 0
    assert {r.taken for r in mixing.mix_sources(awkward.where("doc_id in (1, 2, 3)")).collect()} == {0}


def test_mix_of_repeated_and_null_ids_agrees_between_runs(spark):
    random.seed(9)
    rows = [(random.choice([None, 1, 2, 3]), " ".join(f"w{random.randrange(50)}" for _ in range(random.randrange(40))), random.choice(["a", "b", None])) for _ in range(140)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string")
    made = [sorted(map(str, check_mix(docs.repartition(n), lambda t: 1))) for n in (1, 3, 7)]
    assert made[0] == made[1] == made[2]


def test_sources_below_a_block_give_their_targets(spark, documents):
    """Far fewer slots than sources, and blocks far above most targets."""
    docs = spark.range(900).selectExpr("id AS doc_id", "repeat('w ', 3 + int(id % 5)) AS text", "CASE WHEN id % 3 = 0 THEN 'large' ELSE concat('s', id div 2) END AS source")
    for rows in (docs, documents):
        check_mix(rows, lambda t: 1, slots=16)
        check_mix(rows, lambda t: 1)
    got = mixing.mix_sources(docs, slots=16).collect()
    assert all((r.first_slot or 0) < 16 for r in got)
    large = sorted(r.first_slot for r in got if r.source_size > 1000 and r.taken)
    assert len(set(large)) > 1


def test_slots_are_spread(spark):
    rows = [("a", 300, 600.0, 1000.0, 1), ("b", 300, 100.0, 1000.0, 1), ("c", 300, 300.0, 1000.0, 1)]
    targets = spark.createDataFrame(rows, "source_key string, source_size long, target double, total double, block long")
    slots = sorted((r.slot, r.source_key, r.turn) for r in mixing.slot_schedule(targets, 1 << 12).collect())
    assert [s[0] for s in slots] == list(range(1000))
    for part in (100, 500, 1000):  # every prefix of the schedule is in proportion
        for key, weight in (("a", 0.6), ("b", 0.1), ("c", 0.3)):
            assert abs(sum(s[1] == key for s in slots[:part]) - part * weight) <= 4


def test_bpe_equals_the_library(documents, awkward, nothing):
    library = Tokenizer.from_file(PATH)
    for docs, leaf in ((documents, bpe.LEAF), (awkward, bpe.LEAF), (awkward, 300)):
        got = bpe.bpe_encode(docs, PATH, leaf=leaf).collect()
        texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        made = {(r.doc_id, tuple(r.ids), r.decoded) for r in got}
        want = set()
        for i, t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            want.add((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
        assert len(got) == len(texts) and made == want
    assert bpe.bpe_encode(nothing, PATH).count() == 0


def test_digests(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.bpe_digests(bpe.bpe_encode(docs, PATH)).collect()}
    ids = Tokenizer.from_file(PATH).encode("Hello world", add_special_tokens=False).ids
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, empty, empty)


def test_joins_of_cut_texts_are_exact():
    codec = bpe.codec(PATH)
    random.seed(3)
    for k in range(120):
        n = random.randrange(1, 500)
        text = {
            0: "".join(random.choice("abcdeth") for _ in range(n)),
            1: "".join(random.choice("abc é'sΣ İ\n12!日本 ") for _ in range(n)),
            2: "".join(random.choice(["<|endoftext|>", "don't ", "It'S", "''s", "  ", " é", "日本語", "x" * 50, "!!!", "123 "]) for _ in range(n // 4)),
            3: random.choice("ax!é日") * n,
        }[k % 4]
        want = codec.full.encode(text, add_special_tokens=False).ids
        for leaf in (7, 50, 200):
            got = []
            for added, part in codec.segments(text):
                got += [added] if added is not None else bpe.tree(codec, [(p, *codec.leaf(p)) for p in bpe.halves(part, leaf)])[1].tolist()
            assert got == want
        ids, decoded = codec.encode(text)
        assert np.frombuffer(ids, np.int32).tolist() == want and decoded == codec.full.decode(want, skip_special_tokens=False)


def brute_nearest(rows, k):
    """rows: (id, vector) that take part; queries: ids divisible by 20."""
    out = set()
    for q, x in rows:
        if q % 20 == 0:
            best = sorted((-float((np.array(x) * np.array(v)).sum()), i) for i, v in rows if i != q and len(v) == len(x))[:k]
            out |= {(q, n + 1, i) for n, (_, i) in enumerate(best)}
    return out


def search(vectors, **how):
    return vector_search.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"), **how)


def test_small_shards_are_exact(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute_nearest(rows, 20)
    for shard_rows in (8192, 40):
        got = search(vectors, shard_rows=shard_rows).collect()
        assert {(r.query_id, r["rank"], r.vec_id) for r in got} == want


def test_graph_recall(spark):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(12, 24))
    x = centres[draw.integers(0, 12, 3000)] + 0.6 * draw.normal(size=(3000, 24))
    x[500:900] = x[500]  # many copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=2000, block_queries=64).collect()
    scores: dict = {}
    for r in got:
        scores.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = n = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        own = sorted(scores[q])
        assert [o[0] for o in own] == list(range(1, 21)) and all(abs(o[2] - s[o[1]]) < 1e-9 for o in own)
        hits += len({o[1] for o in own} & set(best.tolist()))
        n += 20
    assert hits / n >= 0.9
    assert [o[1] for o in sorted(scores[520])][:5] == [o for o in range(500, 506) if o != 520][:5]


def test_vectors_that_take_no_part(spark):
    bad = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0, 1.0])]
    got = search(spark.createDataFrame(bad, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 3.0), (0, 2, 2, 3.0)]
    assert search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
