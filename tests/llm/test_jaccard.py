import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcframe.llm import jaccard

from .data import ODD_TEXTS, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^ \t-\r]+")


def shingles(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def groups(sets, percent):
    """The smallest id reachable by links, comparing all pairs."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def corpus(seed, families=12, copies=9, unrelated=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=25)
    texts = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randrange(3, 160))
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                at = rng.randrange(len(words))
                action = rng.randrange(3)
                if action == 0:
                    words[at] = rng.choice(vocabulary)
                elif action == 1:
                    words.insert(at, rng.choice(vocabulary))
                elif len(words) > 1:
                    del words[at]
            texts.append(" ".join(words))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 80)) + passage * rng.randrange(2)) for _ in range(unrelated)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60), (4, 4, 85), (5, 3, 95)])
def test_groups(spark, seed, words, percent):
    texts = [*ODD_TEXTS, *corpus(seed)]
    rows = jaccard.jaccard_groups(documents(spark, texts), words, percent).collect()
    sets = {i: shingles(t, words) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in rows} == groups(sets, percent)
    assert len(rows) == len(texts)


@pytest.mark.parametrize(("block", "hubs", "tokens", "hold"), [(16, 6, 1 << 22, 1 << 25), (4, 2, 2000, 1), (5, 1, 1 << 22, 1000)])
def test_large_groups_meet_in_blocks(spark, monkeypatch, block, hubs, tokens, hold):
    for name, value in (("BLOCK", block), ("GROWTH", 0), ("LATER", 0), ("HUBS", hubs), ("TOKENS", tokens), ("HOLD", hold), ("CROWD", block)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 60
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(documents(spark, texts), 4, 85).collect()}
    want = groups(sets, 85)
    assert got == want and 1 < len(set(want.values())) < 100


@pytest.mark.parametrize("share", [1, 1 << 20])
def test_hot_ngrams_go_another_way(spark, monkeypatch, share):
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "HOT_SHARE", share)
    line = " ".join(f"common{i}" for i in range(9))
    texts = [t if i % 3 else f"{line} {t}" for i, t in enumerate(corpus(6))] + [line] * 3 + [line + " end"] * 2
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(documents(spark, texts), 4, 85).collect()}
    assert got == groups(sets, 85)


def test_odd_ids(spark):
    long = "one two three four five six seven eight nine ten"
    docs = documents(spark, [long, long, long, "other words here", None, long + " eleven"], [7, 7, None, 3, None, 2])
    rows = sorted(map(tuple, jaccard.jaccard_groups(docs, 4, 85).collect()), key=str)
    assert rows == sorted([(7, 7, 2), (7, 7, 2), (None, 7, None), (3, 1, 3), (None, 0, None), (2, 8, 2)], key=str)
    # texts of one id are one document
    both = documents(spark, [long, "a b c d e f", "a b c d e f"], [7, 7, 9])
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_groups(both, 4, 85).collect()} == {7: 7, 9: 7}


def test_empty_table(spark):
    assert jaccard.jaccard_groups(documents(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.sampled_from([50, 80, 85, 99, 100]))
def test_bounds(n, m, percent):
    shared = next((s for s in range(min(n, m) + 1) if jaccard.linked(s, n, m, percent)), None)
    if shared is not None:  # the least that links shares what each side needs
        assert shared >= jaccard.least_shared(n, percent) and shared >= jaccard.least_shared(m, percent)
    assert 1 <= jaccard.longest(np.int64(n), percent) <= max(1, n)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 40)), min_size=1, max_size=40))
def test_every_pair_of_an_ngrams_groups_has_one_spot(postings):
    lead = np.array([a for a, _ in postings], np.uint64)
    lead = np.unique(lead)
    df = np.full(len(lead), 1 + max(d for _, d in postings))
    token = np.full(len(lead), 77, np.uint64)
    crowd, jaccard.CROWD = jaccard.CROWD, 4
    try:
        spot, at, side = jaccard.spots(token, lead, df)
    finally:
        jaccard.CROWD = crowd
    met = [(min(x, y), max(x, y)) for i, x in enumerate(at) for j, y in enumerate(at) if i < j and spot[i] == spot[j] and x != y and (side[i] != side[j] or side[i] == 2)]
    assert sorted(met) == [(x, y) for x in range(len(lead)) for y in range(x + 1, len(lead))]


def test_spanning_links_connect_what_links_connect():
    rng = random.Random(3)
    for _ in range(60):
        base = rng.sample(range(10**6), 40)
        sets = [np.array(sorted({*rng.sample(base, rng.randrange(28, 41)), *rng.sample(range(10**6, 2 * 10**6), rng.randrange(4))}), np.uint64) for _ in range(14)]
        count = rng.randrange(1, 14)  # members; the others visit
        members = jaccard.Members(list(range(count)), sets[:count], 80)
        links = [*members.among(), *(link for i in range(count, 14) for link in members.connect(i, sets[i])[1])]

        def parts(edges):
            label = list(range(14))
            for a, b in edges:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
            return label

        every = [(a, b) for a in range(14) for b in range(count) if a != b and jaccard.linked(len(set(sets[a].tolist()) & set(sets[b].tolist())), len(sets[a]), len(sets[b]), 80)]
        assert set(links) <= set(every) and parts(links) == parts(every)


def test_a_crowd_of_near_copies_and_a_common_line(spark, monkeypatch):
    """With the constants as they are: 8000 near copies, and 20000 other documents that share a line. No task gets many of either."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(8000):
        words = list(base)
        words[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(words))
    line = " ".join(f"common{i}" for i in range(7))
    texts += [f"{rng.randrange(10**9)} {rng.randrange(10**9)} {line} {rng.randrange(10**9)} {rng.randrange(10**9)}" for _ in range(20_000)]
    most = []
    verify = jaccard.verify

    def watched(rows, *args, **options):
        most.append(rows.groupBy("lead", "block", "chunk").count().agg({"count": "max"}).first()[0] or 0)
        return verify(rows, *args, **options)

    monkeypatch.setattr(jaccard, "verify", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, 4, 85).collect()}
    assert {got[i] for i in range(8000)} == {0} and all(got[i] == i for i in range(8000, 28_000))
    assert max(most) < 1500
