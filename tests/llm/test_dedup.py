import hashlib
import random

import brute
import numpy as np
import pytest
from awkward_rows import AWKWARD

from orequarry.llm import components, exact_dedup, jaccard_join, paragraph_dedup
from orequarry.llm import textnum as T


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def check_exact(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = brute.exact_groups(rows_of(docs))
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == docs.count()
    for r in got:
        own = by_digest[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (own[0], len(own), r.doc_id == own[0])


def test_exact_dedup_on_awkward_rows(awkward, nothing):
    check_exact(awkward)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_merges_any_number_of_runs(documents):
    want = {tuple(r) for r in exact_dedup.exact_dedup(documents).collect()}
    for runs, fan_in in ((1, 2), (7, 2), (30, 3)):
        assert {tuple(r) for r in exact_dedup.exact_dedup(documents, runs=runs, fan_in=fan_in).collect()} == want


def test_exact_dedup_stays_in_the_jvm(awkward):
    plan = exact_dedup.exact_dedup(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = [t for _, t in AWKWARD] + ["a" * 50 + " " + "b" * 3000, "\x0bx\x1cy "]
    for piece in (7, 64, 1 << 20):
        old, T.PIECE = T.PIECE, piece
        words, offsets = T.word_hashes(pa.array(texts))
        T.PIECE = old
        assert np.diff(offsets).tolist() == [len(brute.words(t)) for t in texts]
        names = {}
        for w, h in zip([w for t in texts for w in brute.words(t)], words.tolist(), strict=True):
            assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_sliced_and_wide_columns_hash_alike():
    import pyarrow as pa

    column = pa.array(["a b", None, "c d e", "f"])
    want = T.word_hashes(column.slice(2))
    for other in (column.cast(pa.large_string()).slice(2), pa.array(["c d e", "f"])):
        got = T.word_hashes(other)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_trie_components_equal_pairwise_comparison():
    draw = np.random.default_rng(1)
    for bundle in (2, 5, 512):
        old, jaccard_join.BUNDLE = jaccard_join.BUNDLE, bundle
        for _ in range(40):
            base = draw.integers(0, 60, 30).astype(np.uint64)
            noise = lambda: np.where(draw.random(30) < draw.random() * 0.4, draw.integers(0, 80, 30).astype(np.uint64), base)
            sets = [np.unique(noise())[: draw.integers(1, 30)] for _ in range(draw.integers(2, 40))]
            for percent in (60, 85):
                n, parent = len(sets), list(range(len(sets)))

                def find(x):
                    while parent[x] != x:
                        x = parent[x]
                    return x

                for i in range(n):
                    for j in range(i):
                        both = len(np.intersect1d(sets[i], sets[j]))
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            a, b = find(i), find(j)
                            parent[max(a, b)] = min(a, b)
                assert jaccard_join.trie_components(sets, percent).tolist() == [find(i) for i in range(n)]
        jaccard_join.BUNDLE = old


def check_jaccard(docs, **how):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, **how).collect() if r.doc_id is not None}
    want = brute.jaccard_components([r for r in dict(rows_of(docs)).items() if r[0] is not None], how["words"], how["percent"])
    assert got == want


def test_jaccard_join_on_awkward_rows(awkward, nothing):
    check_jaccard(awkward, words=4, percent=85)
    assert jaccard_join.jaccard_components(nothing).count() == 0
    lost = [r for r in jaccard_join.jaccard_components(awkward).collect() if r.doc_id is None]
    assert len(lost) == 1 and lost[0].component_id is None


@pytest.mark.parametrize("paired", [jaccard_join.PAIRED, 2])
def test_canopies_of_chance_meetings_are_parted(spark, monkeypatch, paired):
    """Texts of few words meet by many keys and link with few; they are told apart before any canopy is dealt to blocks."""
    sized, too_large = [], jaccard_join._too_large
    monkeypatch.setattr(jaccard_join, "_too_large", lambda *a: sized.append(too_large(*a)) or sized[-1])
    monkeypatch.setattr(jaccard_join, "_large_links", lambda *a: pytest.fail("every set meets every block"))
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices("abcdef", k=draw.randrange(20, 60)))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " g") for i in range(30)] + [(300 + i, "a " + rows[i][1] + " g") for i in range(15)]
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85, task_members=2000)
    assert sized[0].first().total > 2000 and sized[1] is None


def test_bitmaps_differ_in_no_more_bits_than_sets_in_members():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (1, 2, 31, 33, 400, 5000)]
    sets += [np.unique(np.concatenate([s[len(s) // 9 :], rng.integers(0, 2**64, k, np.uint64)])) for s in sets for k in (0, 1, len(s) // 12, len(s))]
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(len(sets))])
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in pairs])
    sizes = np.array([len(s) for s in sets])
    for percent in (20, 85, 100):
        likely = jaccard_join.Bitmaps([jaccard_join.bitmap(s) for s in sets], sizes, percent).may_link(*pairs.T)
        linked = 100 * both >= percent * (sizes[pairs].sum(1) - both)
        assert likely[linked].all() and (percent == 20 or likely.sum() < 2 * linked.sum())


@pytest.mark.parametrize("task_members", [jaccard_join.TASK_MEMBERS, 60])
def test_jaccard_join_equals_brute_force(spark, documents, task_members):
    """With few members a task, canopies are dealt to blocks and joined in two rounds."""
    random.seed(4)
    rows = [tuple(r) for r in documents.limit(150).select("doc_id", "text").collect()]
    base = [f"w{random.randrange(40)}" for _ in range(60)]
    for i in range(60):  # a chain of near copies that drifts, and some at its edge
        base = [w if random.random() > 0.015 else f"v{random.randrange(1000)}" for w in base]
        rows.append((10_000 + i, " ".join(base)))
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85, task_members=task_members)


def test_components_equal_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(7, i) for i in range(1000, 1100)] + [(1, 1), (None, 3)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in components.connected_components(table).collect()}
    assert got == {r.node: r.component for r in components.connected_components(table, task_edges=30).collect()}  # in rounds
    parent: dict = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
            parent.setdefault(min(ra, rb), min(ra, rb))
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def pair_hash(a: str, b: str) -> int:
    import pyarrow as pa

    h, _ = T.word_hashes(pa.array([f"{a} {b}"]))
    return int(T.mix(h[:1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])[0])


def check_paragraphs(docs, **how):
    found = paragraph_dedup.paragraph_duplicates(docs, recall=1 - 1e-9, **how).collect()
    rows = rows_of(docs)
    got = sorted((r.doc_id, r.para, r.paras, r.n_words, r.cluster_doc, r.cluster_para, r.n_copies, r.removed) for r in found)
    assert got == sorted(brute.repeated_chains(rows, how.get("min_words", 20), 5, 80, paragraph_dedup.REACH, pair_hash))
    own = {i: [brute.words(t) for j, t in rows if j == i] for i, _ in rows}
    for r in found:  # the characters are those of the words
        text = [t for i, t in rows if i == r.doc_id and r.end <= len(t or "")]
        assert any(w[at : at + r.n_words] == brute.words(t[r.start : r.end]) for t in text for w in own[r.doc_id] for at in range(len(w)))
    return got


def test_paragraph_dedup_equals_brute_force(documents, awkward, nothing):
    """With repeated ids, rows and texts, and a hot key joined in blocks."""
    assert any(r[0] == 12 for r in check_paragraphs(awkward))
    check_paragraphs(documents.limit(60), min_words=8)
    check_paragraphs(documents.limit(40).union(documents.limit(3)), task_members=200)
    assert paragraph_dedup.paragraph_duplicates(nothing).count() == 0


def test_passages_are_found_inside_and_across_lines(spark):
    random.seed(8)
    word = lambda: f"w{random.randrange(10**6)}"
    some = lambda n: [word() for _ in range(n)]
    rows = []
    for i in range(40):  # each passage stands in two texts, with lines broken elsewhere, and in one of them twice
        passage = some(55)
        rows.append((2 * i, " ".join(some(80) + passage + some(70))))
        broken = "".join(w + ("\n" if random.random() < 0.2 else " ") for w in passage)
        rows.append((2 * i + 1, " ".join(some(30)) + " " + broken + " ".join(some(90)) + "\n" + " ".join(passage)))
    rows += [(1000 + i, " ".join(some(200))) for i in range(40)]
    found = paragraph_dedup.paragraph_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in found}) >= 78 and max(r.doc_id for r in found) < 1000
    inside = {r.doc_id: 0 for r in found}
    for r in found:
        inside[r.doc_id] += r.n_words
    assert min(inside.values()) >= 20 and sum(inside.values()) > 0.6 * 55 * 120


def test_bands_reach_their_recall():
    n = paragraph_dedup.tune_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**3) ** n >= 0.999 > 1 - (1 - 0.8**3) ** (n - 1)


def test_removed_stretches_are_cut_out(spark):
    line = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a\n{line}\nb é", 5), (2, f"ü x {line}\nc", 6), (3, None, 7), (4, "d", 8)], "doc_id long, text string, start long")
    found = paragraph_dedup.paragraph_duplicates(docs)
    (gone,) = [r for r in found.collect() if r.removed]
    kept = {r.doc_id: (r.text, r.start) for r in paragraph_dedup.remove_spans(docs, found).collect()}
    text = f"ü x {line}\nc"
    assert kept == {1: (f"a\n{line}\nb é", 5), 2: (text[: gone.start] + text[gone.end :], 6), 3: (None, 7), 4: ("d", 8)}
    assert gone.doc_id == 2 and gone.n_words > 30
