import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from awkward_rows import AWKWARD
from pyspark.sql import functions as F

from orequarry.llm import language_id, language_model, quality, toxicity


def auc(y, s):
    good, bad = [a for a, b in zip(s, y, strict=True) if b == 1], [a for a, b in zip(s, y, strict=True) if b == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_language_id_on_held_out_documents(documents):
    fold = language_id.fold(F.col("doc_id"), 5)
    model = language_id.train(documents.where(fold != 0))
    got = language_id.predict(documents.where(fold == 0), model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_on_awkward_rows(awkward, nothing):
    model = language_id.train(awkward)
    got = language_id.predict(awkward, model).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 8):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[17].lang_pred in ("en", "fr")
    assert language_id.predict(nothing, language_id.train(nothing)).count() == 0
    assert {r.lang_pred for r in language_id.predict(awkward, language_id.train(nothing)).collect()} == {"und"}


def test_words_back_off_to_shorter_grams():
    rows = [(0, "haus", "de", 5), (0, "house", "en", 5), (3, "aus", "de", 5), (3, "ous", "en", 5), (1, "h", "de", 1), (1, "h", "en", 1)]
    model = language_id.Model.fit(["de", "en"], rows)
    assert model.score("Haus")[0] == "de"  # a known word
    assert model.score("laus")[0] == "de" and model.score("mouse")[0] == "en"  # unseen words by their grams
    assert model.score("...") == ("und", 0.0)


def labelled(labels, column, folds, held):
    return labels.select("doc_id", F.col(column).alias("label")).where(language_id.fold(F.col("doc_id"), folds) != held)


def held_out(labels, column, folds, held, got):
    truth = {r.doc_id: r[column] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % folds == held}
    pairs = [(truth[r.doc_id], r.score) for r in got if r.doc_id in truth]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def test_quality_on_held_out_labels(documents, labels):
    got = quality.quality_scores(documents, labelled(labels, "quality", 5, 0)).collect()
    y, s = held_out(labels, "quality", 5, 0, got)
    assert auc(y, s) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_on_awkward_rows(awkward, nothing, spark):
    marks = spark.createDataFrame([(9, 1), (11, 1), (17, 0), (4, 0), (5, None), (None, 1), (9, 1)], "doc_id long, label int")
    got = quality.quality_scores(awkward, marks).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    none = quality.quality_scores(awkward, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(nothing, marks).count() == 0


def test_pairs_rank_good_above_bad():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 3] + 0.2 * draw.normal(size=400) > -1).astype(int)
    model = quality.Ranker.fit(x, y, pairs=5000)
    assert auc(y, model.score(x)) > 0.95
    assert abs((model.score(x) >= quality.CUT).mean() - y.mean()) < 0.03  # the quantile threshold


def test_toxicity_on_held_out_labels(documents, labels, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity_scores(docs, labelled(marks, "toxic", 3, 1)).collect()
    y, s = held_out(marks, "toxic", 3, 1, got)
    assert auc(y, s) > 0.85
    assert sum(a == 0 and b >= toxicity.CUT for a, b in zip(y, s, strict=True)) <= 2


def test_toxicity_on_awkward_rows(awkward, nothing, spark):
    marks = spark.createDataFrame([(9, 1), (10, 1), (11, 1), (4, 0), (7, None)], "doc_id long, label int")
    got = toxicity.toxicity_scores(awkward, marks).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert all(e.doc_id != r.doc_id for r in got for e in r.evidence)
    assert {r.score for r in toxicity.toxicity_scores(awkward, marks.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(nothing, marks).count() == 0


def test_toxicity_equals_plain_cosines(documents, labels):
    marks = labelled(labels, "toxic", 3, 1)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = dict(brute.toxicity(rows, {r.doc_id: r.label for r in marks.collect()}, 16, toxicity.FLOOR))
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(documents, marks).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_words_of_ascii_texts_follow_the_pattern():
    every = "".join(map(chr, range(128)))
    for text in (every, every[::-1] + "B-a_B 7up\x1cUP\x00up", "", " ", *(t or "" for _, t in AWKWARD)):
        for t in (text, text + "Él"):
            assert toxicity._bag(t) == Counter(toxicity.WORD.findall(t.lower()))


@pytest.mark.parametrize("full", [192, 0])
def test_block_max_search_is_exact(full, monkeypatch):
    """With the longest lists as full rows, and with none."""
    monkeypatch.setattr(toxicity, "_FULL", full)
    draw = np.random.default_rng(3)
    terms, n = 40, 700
    vectors = []
    for _ in range(n):
        t = np.sort(draw.choice(terms, draw.integers(1, 8), replace=False))
        w = draw.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    dense = np.zeros((n, terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(list(range(n)), [0] * n, vectors, terms)
    for q in range(50):
        t, w = vectors[q]
        cosines = dense[:, t] @ w
        want = np.lexsort((np.arange(n), -np.round(cosines, 12)))[:10]
        at, sims = index.nearest(t, w, 10)
        assert np.allclose(sims, cosines[want]) and np.allclose(np.sort(cosines[at]), np.sort(cosines[want]))


def brute_lm(rows, trained):
    counts = Counter()
    for i, t in rows:
        if trained(i):
            counts.update([*brute.words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*brute.words(t), None]
        yield i, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)


@pytest.mark.parametrize("hot_words", [1 << 18, 5, 0])
def test_language_model_counts_are_exact(awkward, hot_words):
    """With few or no words broadcast, the rest is looked up where it was counted."""
    got = language_model.lm_scores(awkward, F.col("doc_id") % 3 != 0, hot_words=hot_words, piece_bits=1 << 20, pair_filter_bits=1 << 20).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(brute_lm(AWKWARD, lambda i: i is not None and math.fmod(i, 3) != 0), key=key)
    made = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [m[:4] for m in made] == [w[:4] for w in want]
    assert np.allclose([m[4] for m in made], [w[4] for w in want])
    assert all(r.score < 0 for r in got)


def quantised_lm(rows, trained):
    """The bigram model on exact counts, rounded as the filters round them."""
    rows = [(i, [*brute.words(t), None]) for i, t in rows]
    one, two, texts = Counter(), Counter(), 0
    for i, tokens in rows:
        if trained(i):
            texts += 1
            one.update(tokens)
            two.update(zip(["<"] + tokens[:-1], tokens, strict=True))
    rounded = lambda c: float(language_model.expected_count(language_model.levels(np.array([c])))[0])
    whole = sum(one.values()) + len(one) + 1
    for i, tokens in rows:
        score = 0.0
        for h, w in zip(["<"] + tokens[:-1], tokens, strict=True):
            count, history = rounded(one[w]), texts if h == "<" else rounded(one[h])
            low = (count + 1) / whole
            pair = min(rounded(two[h, w]), history, max(count, 1.0))
            score += math.log10(0.6 * pair / history + 0.4 * low if history else low)
        yield i, score / len(tokens)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 16])
def test_language_model_keeps_all_counts(documents, bits):
    """Filters far smaller than the corpus lose no word and no pair."""
    got = {r.doc_id: r.score / r.n_tokens for r in language_model.lm_scores(documents, F.col("doc_id") % 7 != 2, piece_bits=bits, pair_filter_bits=bits).collect()}
    want = dict(quantised_lm([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], lambda i: i % 7 != 2))
    assert got.keys() == want.keys()
    assert np.mean([abs(got[i] - want[i]) for i in want]) < 0.1
    assert np.mean([abs(got[i] - want[i]) for i in want if i % 7 != 2]) < 0.04


def test_language_model_without_rows(nothing, awkward):
    assert language_model.lm_scores(nothing, F.lit(True), piece_bits=1 << 18, pair_filter_bits=1 << 18).count() == 0
    untrained = language_model.lm_scores(awkward, F.lit(None).cast("boolean"), piece_bits=1 << 18, pair_filter_bits=1 << 18).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)}


def test_language_model_prefers_what_it_has_seen(documents):
    trained = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = language_model.lm_scores(documents, trained, piece_bits=1 << 22, pair_filter_bits=1 << 23).where(~trained)
    r = got.agg((F.sum("score") / F.sum("n_tokens")).alias("model"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).first()
    assert r.model > r.base


def test_filter_holds_quantised_counts():
    draw = np.random.default_rng(6)
    keys = draw.integers(1, 1 << 62, 3000).astype(np.uint64)
    counts = np.minimum(draw.zipf(1.7, 3000), 5000)
    bits = 1 << 17
    segment, least = language_model.build_segment(keys, counts, bits)
    probe = lambda k: language_model.probe_at(np.frombuffer(segment, np.uint8), np.zeros(len(k), np.uint64), np.full(len(k), bits, np.uint64), k)
    level = probe(keys)
    assert least == 1 and (level >= language_model.levels(counts)).all()  # never less than was stored
    assert (level == language_model.levels(counts)).mean() > 0.9
    other = probe(draw.integers(1, 1 << 62, 3000).astype(np.uint64))
    assert (other > 0).mean() < 0.06
    small, least = language_model.build_segment(keys, counts, 1 << 12)
    assert least > 1


def test_slices_hold_all_tokens():
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in AWKWARD])], ["text"])
    old, language_model._SLICE = language_model._SLICE, 50
    made = [(low, high, np.diff(offsets).tolist()) for low, high, _, offsets in language_model._slices(batch)]
    language_model._SLICE = old
    assert [n for _, _, ns in made for n in ns] == [len(brute.words(t)) + 1 for _, t in AWKWARD]
