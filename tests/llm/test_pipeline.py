"""Each stage of the pipeline on its own input, against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from arcframe.llm import langid, mixing, packing

from arcframe.llm.common import WORD

from .data import ODD_TEXTS, documents
from .test_jaccard import groups, shingles
from .test_packing import check_rows
from .test_secrets import base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": "th ing wh ough the er", "de": "sch ung ver lich zu ein"}


def prose(lang, n, rng):
    parts = PARTS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        text = prose(lang, rng.randrange(15, 120), rng)
        if k % 10 == 1:
            text = rows[-1][1] + " " + rng.choice(PARTS["en"].split())  # a near copy
        if k % 10 == 2:
            text = rows[-2][1]  # a copy
        if k % 15 == 4:
            text += f" password=abc{k:05}x and more"
        if k % 9 == 5:
            text += " token = \"examplevalue\" as shown"
        rows.append((k, text, lang, f"src{rng.randrange(5)}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, "123 456", "en", "src1", 7)]
    return rows


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input of each stage, and the result of the last."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.createDataFrame(corpus(), SCHEMA)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_columns(steps):
    assert all(d.dtypes == steps[0].dtypes for d in steps[:-1])


def test_language_id(steps):
    kept = Counter(rows_of(steps[1]))
    judged = {r.doc_id: r.lang_pred != "und" and not r.ambiguous for r in langid.identify_languages(steps[0]).collect()}
    assert kept == Counter(r for r in rows_of(steps[0]) if judged[r[0]])
    assert {r[0] for r in kept} >= set(range(150)) and not {r[0] for r in kept} & {150, 151, 152}


def test_near_duplicates(steps):
    before = {r[0]: r for r in rows_of(steps[1])}
    want = groups({i: shingles(r[1], 5) for i, r in before.items()}, 80)
    assert sorted(rows_of(steps[2])) == sorted(before[i] for i in set(want.values()))
    assert len(set(want.values())) < len(want)


def test_secret_scan(steps):
    before, after = {r[0]: r for r in rows_of(steps[2])}, {r[0]: r for r in rows_of(steps[3])}
    owners = defaultdict(set)
    for r in before.values():
        for *_, value in base(r[1]):
            owners[value].add(r[3])
    assert before.keys() == after.keys()
    masked = 0
    for i, r in before.items():
        text = r[1]
        for start, _, end, _, value in sorted(base(text), reverse=True):
            if len(owners[value]) <= 2:
                text = text[:start] + "[secret]" + text[end:]
                masked += 1
        assert after[i] == (r[0], text, *r[2:])
    assert masked and any("examplevalue" in r[1] for r in after.values())


def test_source_mix(steps):
    taken = Counter(rows_of(steps[4]))
    want = {r.doc_id: r for r in mixing.mix_sources(steps[3].select("doc_id", "text", "source")).collect()}
    sizes = defaultdict(int)
    for r, n in taken.items():
        assert n <= 2
        sizes[r[3]] += n * len(r[1].split())
    targets = {r[3]: want[r[0]].target for r in rows_of(steps[3])}
    assert set(taken) <= set(rows_of(steps[3])) and all(abs(sizes[s] - t) < 130 for s, t in targets.items())


def test_packing(steps):
    texts = [r[1] for r in sorted(rows_of(steps[4]))]
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    numbered = steps[4].withColumn("doc_id", F.row_number().over(Window.orderBy(*steps[4].columns)).cast("long") - 1)
    n = check_rows(packing.pack_documents(numbered, packing_path()).collect(), texts)
    rows = steps[5].collect()
    assert len({r.sequence_id for r in rows}) == n and {r.doc_id for r in rows} == {r.doc_id for r in steps[4].collect()}


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_run(spark, steps, tmp_path):
    steps[0].write.parquet(str(tmp_path / "documents.parquet"))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.count() == steps[5].count() and again.columns == steps[5].columns


@pytest.mark.parametrize("k", range(5))
def test_odd_tables(spark, k):
    """Nulls in any column, repeated rows, other columns, no rows."""
    stage = corpus_pipeline.STAGES[k][1]
    texts = [*ODD_TEXTS, *ODD_TEXTS, "token=abcdefgh", "token=abcdefgh"]
    docs = documents(spark, texts, [None if i % 5 == 0 else i % 17 for i in range(len(texts))])
    got = stage(spark, docs, "")
    assert k == 4 or got.dtypes == docs.dtypes
    rows, all_rows = Counter(rows_of(got)), Counter(rows_of(docs))
    if k == 0:  # some stay, each as often as it was there
        assert rows and all(rows[r] == all_rows[r] and r[1] for r in rows)
    elif k == 1:  # of each id one row at most, of those without one all
        ids = Counter(r[0] for r in rows.elements())
        assert set(rows) <= set(all_rows) and ids[None] == sum(n for r, n in all_rows.items() if r[0] is None) and all(n == 1 for i, n in ids.items() if i is not None)
    elif k == 2:  # none goes, only texts with a secret change
        assert rows.total() == all_rows.total() and sum(n for r, n in all_rows.items() if r not in rows) == sum(n for r, n in all_rows.items() if "token=" in (r[1] or ""))
    elif k == 3:  # as many words as the mix takes
        named = docs.selectExpr("monotonically_increasing_id() as doc_id", "text", "source")
        assert sum(len(re.findall(WORD, r[1] or "")) * n for r, n in rows.items()) == sum(r.taken for r in mixing.mix_sources(named).collect()) > 0
    else:  # every row's first piece
        assert got.where("start = 0").count() == docs.count()
    assert stage(spark, docs.where("false"), "").count() == 0
