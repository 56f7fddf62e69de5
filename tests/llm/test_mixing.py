import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcframe.llm import mixing, ranks

from .data import ODD_TEXTS, documents

WORDS = re.compile(r"[^ \t-\r]+")


def reachable(lengths, counts, budget):
    sums = {0}
    for size, n in zip(lengths, counts, strict=True):
        sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= budget}
    return max(sums)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 400))
def test_budget(histogram, budget):
    lengths, counts = sorted(histogram), [histogram[k] for k in sorted(histogram)]
    take = mixing.fit_budget(lengths, counts, budget)
    total = sum(a * b for a, b in zip(lengths, take, strict=True))
    assert all(0 <= a <= b for a, b in zip(take, counts, strict=True)) and total <= budget
    # an equal share of each length is fixed first; what is left is fitted exactly
    whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
    first = [c if budget >= whole else c * budget // whole for c in counts]
    rest = [c - f for c, f in zip(counts, first, strict=True)]
    spent = sum(a * b for a, b in zip(lengths, first, strict=True))
    assert total == spent + reachable(lengths, rest, budget - spent)


def test_large_budgets_end_close():
    lengths = list(range(50, 20_000, 7))
    counts = [1 + 10**6 // n for n in lengths]
    budget = sum(a * b for a, b in zip(lengths, counts, strict=True)) * 2 // 5
    take = mixing.fit_budget(lengths, counts, budget)
    assert 0 <= budget - sum(a * b for a, b in zip(lengths, take, strict=True)) < 50


def expected_targets(totals, share=1.5, cap=2):
    """Share and reshare by weight, step by step."""
    names = sorted((k for k in totals if k is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, full, out = share * sum(totals.values()), set(), dict.fromkeys(names, 0.0)
    while True:
        open_ = [k for k in names if k not in full]
        if not open_:
            return out
        give = left - sum(out[k] for k in full)
        for k in open_:
            out[k] = give * weight[k] / sum(weight[x] for x in open_)
        above = [k for k in open_ if out[k] >= cap * totals[k]]
        if not above:
            return out
        for k in above:
            out[k] = cap * totals[k]
            full.add(k)


@pytest.mark.parametrize("slices", [1, 1024])
def test_query_rows(spark, monkeypatch, slices):
    monkeypatch.setattr(ranks, "SLICES", slices)
    # without the very long text: a source that is mostly one document can only come near by whole copies of it
    texts = [*(t for t in ODD_TEXTS if len(t or "") < 10_000), *("w " * (i * i % 83) for i in range(400)), *["one two three"] * 90]
    docs = documents(spark, texts)
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mixing.mix_sources(docs).collect()
    totals, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORDS.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r["size"]
        assert r.taken == 0 or r.taken % r["size"] == 0
        totals[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
    want = expected_targets(totals)
    for r in rows:
        assert r.source_size == totals[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    assert len(rows) == len(texts) and all(abs(taken[k] - want[k]) < 5 for k in totals)
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_tables_without_words(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    rows = mixing.mix_sources(documents(spark, [None, "", " "], [None, 1, 1])).collect()
    assert len(rows) == 3 and {(r["size"], r.target, r.taken) for r in rows} == {(0, 0.0, 0)}


def test_very_long_texts(spark):
    rows = mixing.mix_sources(documents(spark, ["long word " * 200_000, "a b", "c"])).collect()
    assert {r.doc_id: r["size"] for r in rows} == {0: 400_000, 1: 2, 2: 1} and all(r.taken <= 2 * r["size"] for r in rows)


def test_what_lies_above_the_table_is_spread_over_lengths():
    lengths = list(range(1000, 3000))
    budget = sum(lengths) // 2
    take = mixing.fit_budget(lengths, [1] * 2000, budget)
    assert sum(a * b for a, b in zip(lengths, take, strict=True)) == budget
    assert all(0.4 < sum(take[i : i + 500]) / 500 < 0.6 for i in range(0, 2000, 500))
    assert mixing.fit_budget(lengths, [1] * 2000, budget) == take != mixing.fit_budget(lengths, [1] * 2000, budget, 1)


@pytest.mark.parametrize("share", [0.5, 1.5])
def test_equal_rows_are_taken_as_often_as_they_are_together(spark, share):
    docs = documents(spark, ["a b c"] * 5 + ["d e"] * 3 + ["f"], [None] * 9).selectExpr("doc_id", "text", "'s' as source")
    named = docs.selectExpr("xxhash64(text) as doc_id", "text", "source")
    taken = sum(r.taken for r in mixing.mix_sources(named, share=share).collect())
    got = [r.text for r in mixing.mixed(docs, share=share).collect()]
    assert sum(len(t.split()) for t in got) == taken == share * 22
    assert {t: got.count(t) for t in got}["a b c"] in ((2, 3) if share < 1 else (7, 8))


def test_every_decile_of_lengths_gives_its_share():
    """Nine tenths to eleven tenths of the mean share, for lengths that are common and long ones that occur once."""
    lengths = [*range(5, 400), *range(400, 40_000, 13)]
    counts = [4000 // n + 1 for n in lengths]
    words = [n * c for n, c in zip(lengths, counts, strict=True)]
    budget = sum(words) * 2 // 5
    take = mixing.fit_budget(lengths, counts, budget)
    assert sum(n * k for n, k in zip(lengths, take, strict=True)) == budget
    step = len(lengths) // 10
    for i in range(0, 10 * step, step):
        share = sum(n * k for n, k in zip(lengths[i : i + step], take[i : i + step], strict=True)) / sum(words[i : i + step])
        assert 0.36 < share < 0.44, (i, share)
