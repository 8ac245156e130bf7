import brute
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def pairs(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_each_stage_against_a_plain_version(spark, documents):
    docs = documents
    for name, stage in P.STAGES[:-1]:
        before, made = pairs(docs), stage(spark, docs, SF).cache()
        assert made.columns == P.COLUMNS, name
        after = pairs(made)
        assert set(after) <= set(before)
        if name == "language ID":
            assert set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact dedup":
            assert set(after) == {own[0] for own in brute.exact_groups(list(before.items())).values()}
        elif name == "n-gram Jaccard join":
            linked = brute.jaccard_components(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in linked.items() if i == c}
        else:
            assert made.count() >= len(after) > 0.5 * len(before)
        docs = made
    out = P.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = pairs(docs)
    assert len(out) == docs.count()
    assert all(r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids for r in out)


def test_stages_take_awkward_and_no_rows(spark, awkward, nothing):
    lettered = [(r.doc_id, r.text) for r in awkward.collect() if r.doc_id is not None and any(c.isalpha() for c in r.text or "")]
    docs, want = awkward, {"language ID": len(lettered), "exact dedup": len(brute.exact_groups(lettered))}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.count() == want.get(name, docs.count()) and docs.count() > 0
        assert all(r.doc_id is not None for r in docs.collect())
    for _, stage in P.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_rows_that_repeat_an_id_are_told_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a text"), (1, "a text"), (1, "atext"), (1, "other"), (3, "a text"), (3, base), (3, base + " end"), (3, base), (4, base + " more"), (5, "123"), (5, "letters"), (6, None), (6, " "), (None, "lost")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda stage: sorted((r.doc_id, r.text or "") for r in stage(spark, docs, SF).collect())
    assert got(P.drop_exact_copies) == sorted([(1, "a text"), (1, "other"), (3, base), (3, base + " end"), (4, base + " more"), (5, "123"), (5, "letters"), (6, " ")])
    near = got(P.drop_near_copies)
    assert near == sorted([(1, "a text"), (1, "atext"), (1, "other"), (3, base + " end"), (5, "123"), (5, "letters"), (6, ""), (6, " ")])
    known = got(P.keep_known_language)
    assert known == sorted((i, t) for i, t in rows if i is not None and any(c.isalpha() for c in t or ""))


def test_mixing_stage_follows_the_operator(spark, documents):
    taken = {r.doc_id: (r.size, r.taken) for r in P.mixing.mix_sources(documents).collect()}
    made: dict = {}
    for r in P.mix_to_weights(spark, documents, SF).collect():
        made[r.doc_id] = made.get(r.doc_id, 0) + 1
    want = {i: 2 if 2 * t >= 3 * n else 1 for i, (n, t) in taken.items() if n and 2 * t >= n}
    assert made == want


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert "op4_exact_dedup" in __spark_entry__.oracle_sql()
