"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit of it a linear classifier over hashed n-grams of bytes says
which side a text is on. Decoding weighs each bit's loss by how well that bit was learned for a language
and takes the nearest codeword; a text that lies about as near to a second one is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches

#: Hashed n-gram features, orders of the n-grams, and the labelled rows that the model is fitted on at most (about).
FEATURES, ORDERS, TRAIN_ROWS, TRAIN_PER_LANGUAGE = 4096, 4, 2400, 400
#: Rows of a language that are always taken if they are drawn.
SPARE = 50
#: Weight decay of the classifiers, sharpness of the score, and the score below which a text is ambiguous.
DECAY, SHARPNESS, AMBIGUOUS = 0.05, 4.0, 0.5
UNKNOWN = "und"
#: Features that the fit turns into double precision at a time.
BLOCK = 256
#: Longer texts are counted piece by piece, the pieces overlapping by an n-gram.
PIECE = 1 << 20

LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}']+")


def features(text: str) -> np.ndarray | None:
    """Unit vector of log counts of the hashed byte n-grams of the text's words, None without a letter."""
    if not LETTER.search(text):
        return None
    data = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(FEATURES, np.int64)
    for start in range(0, len(data), PIECE):
        piece = data[start : start + PIECE + ORDERS - 1].astype(np.uint32)
        gram = np.zeros(len(piece), np.uint32)
        for order in range(1, ORDERS + 1):
            # gram[i] stands for the bytes i to i + order - 1; those that start in the overlap belong to the next piece
            gram = gram[: len(piece) - order + 1] * np.uint32(0x01000193) + piece[order - 1 :] + np.uint32(order)
            mine = gram[:PIECE]
            counts += np.bincount((mine * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=FEATURES)
    x = np.log1p(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: all splits up to 7 languages, the best of random codes beyond."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 7:
        splits = [(1, *bits) for bits in itertools.product((-1, 1), repeat=n - 1) if -1 in bits]
        return np.array(splits, float).T
    rng, best, widest = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        agree = np.abs(code.T @ code)
        np.fill_diagonal(agree, 0)
        apart = min((length - code @ code.T)[~np.eye(n, dtype=bool)].min() / 2, n - agree.max())
        if (np.abs(code.sum(0)) < n).all() and apart > widest:
            best, widest = code, apart
    return best


@dataclass
class Model:
    """languages and their code; weights and bias of each bit's classifier; trust of each bit for a language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Weighted exponential loss of each row of x against each codeword."""
        margins = np.clip(x @ self.weights + self.bias, -4, 4)
        return np.einsum("rkj,kj->rk", np.exp(-margins[:, None, :] * self.code), self.trust)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The nearest language and its score, from the distances of all."""
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        if len(self.languages) == 1:
            return [self.languages[0]] * len(x), np.ones(len(x))
        near = -SHARPNESS * self.distances(x)
        p = np.exp(near - near.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[k] for k in best], p[np.arange(len(x)), best]


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Ridge regression of each bit, the bias apart; a bit's trust for a language is the share it gets right there.

    x stays as it is, in half precision or more; only a block of its columns at a time is centred and weighted.
    """
    languages = sorted(set(labels))
    code = codewords(len(languages))
    index = np.array([languages.index(v) for v in labels], int)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((FEATURES, 0)), np.zeros(0), np.zeros((len(languages), 0)))
    # languages count alike, however many rows each has
    weight = 1 / np.bincount(index)[index]
    weight = weight / weight.mean()
    root = np.sqrt(weight)[:, None]
    y = code[index]
    offset = (weight[:, None] * y).sum(0) / weight.sum()
    mean = np.zeros(x.shape[1])

    def centred() -> Iterator[tuple[slice, np.ndarray]]:
        for start in range(0, x.shape[1], BLOCK):
            at = slice(start, start + BLOCK)
            part = x[:, at].astype(np.float64)
            mean[at] = weight @ part / weight.sum()
            part -= mean[at]
            part *= root
            yield at, part

    gram = np.zeros((len(x), len(x)))
    for _, part in centred():
        gram += part @ part.T
    gram[np.diag_indices(len(x))] += DECAY
    dual = np.linalg.solve(gram, (y - offset) * root)
    margins = gram @ dual  # of the centred rows, with what decay adds
    margins -= DECAY * dual
    del gram
    w = np.zeros((x.shape[1], code.shape[1]))
    for at, part in centred():
        w[at] = part.T @ dual
    bias = offset - mean @ w
    right = (margins / root + offset) * y > 0
    trust = np.stack([right[index == k].mean(0) for k in range(len(languages))]) + 1e-6
    return Model(languages, code, w.astype(np.float32), bias, trust / trust.sum(1, keepdims=True))


def train(rows: DataFrame, seed: int = 3, total: int = TRAIN_ROWS, each: int = TRAIN_PER_LANGUAGE) -> Model:
    """A model from a bounded sample of rows (id, text, lang): about min(each, total / languages) of each language.

    Which rows are drawn is a seeded hash of the id. Executors turn texts into features; the driver gets
    a vector of fixed length for each sampled row, of no language more than twice as many as meant and SPARE: an
    id that very many rows have may be drawn with all of them.
    """
    rows = rows.where("lang is not null and text is not null")
    per_language = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per_language:
        return fit(np.zeros((0, FEATURES)), [])
    quota = min(each, max(1, total // len(per_language)))
    share = F.create_map(*[v for lang, n in sorted(per_language.items()) for v in (F.lit(lang), F.lit(min(1.0, quota / n)))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each_batch(batch: pa.RecordBatch) -> Iterator[dict]:
            kept = [(lang, x.astype(np.float16).tobytes()) for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) if (x := features(text.as_py())) is not None]
            yield {"lang": [k for k, _ in kept], "x": [x for _, x in kept]}

        return each_batch

    drawn = map_batches(rows.where(draw).select("text", "lang"), make, "lang string, x binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("x")))  # cut on the map side first
    got = drawn.withColumn("place", place).where(F.col("place") <= 2 * quota + SPARE).select("lang", "x").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.x)))  # the same model in any order of partitions
    labels, x = [r.lang for r in got], np.empty((len(got), FEATURES), np.float16)
    for k, r in enumerate(got):
        x[k] = np.frombuffer(r.x, np.float16)
    del got
    return fit(x, labels)


def held_out(id_col: str) -> Column:
    """Every fifth row by the checksum of its id is never learned from. A null id counts as held out."""
    return F.coalesce(F.expr(f"crc32(cast(`{id_col}` as string)) % 5 = 0"), F.lit(True))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the labelled rows that aren't held out and predicts the language of every whole text.

    Returns id_col, held_out, lang_pred, score (0 to 1) and ambiguous, one row for each input row, null and
    repeated ids included. lang_pred is ``und`` with score 0 where a text is null or has no letter, or
    where no row has a label. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out("id"))
    model = train(rows.where("not held_out"))
    return classify(rows.drop("lang"), model).withColumnRenamed("id", id_col)


def classify(rows: DataFrame, model: Model) -> DataFrame:
    """rows (id, text, held_out) with lang_pred, score and ambiguous in place of text."""

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            langs, scores = [], []
            for start in range(0, batch.num_rows, 256):
                found = [features(t.as_py() or "") for t in batch.column("text")[start : start + 256]]
                known = [x for x in found if x is not None]
                pairs = iter(list(zip(*model.predict(np.array(known)), strict=True)) if known else [])
                for x in found:
                    lang, score = (UNKNOWN, 0.0) if x is None else next(pairs)
                    langs.append(lang)
                    scores.append(float(score))
            doubt = [lang != UNKNOWN and score < AMBIGUOUS for lang, score in zip(langs, scores, strict=True)]
            yield {"id": batch.column("id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores, "ambiguous": doubt}

        return each

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows.select("id", "text", "held_out"), make, f"id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text has a language that isn't in doubt; columns are kept.

    Rejected are texts that are null or have no letter, and those that lie between two codewords. One map:
    rows never move, so that repeated rows and null ids are judged one by one.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    model = train(rows.where(~held_out("id")))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [features(str(t) if (t := v.as_py()) is not None else "") for v in part.column(place)]
                at = [i for i, x in enumerate(found) if x is not None]
                if at and model.languages:
                    _, scores = model.predict(np.array([found[i] for i in at]))
                    yield part.take(pa.array([i for i, s in zip(at, scores, strict=True) if s >= AMBIGUOUS], pa.int64()))

    return docs.mapInArrow(run, docs.schema)
