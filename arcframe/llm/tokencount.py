"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast hash table with the token counts of the most frequent pre-tokens, taken from a
bounded sample of rows; tier two is a cache in each Python worker, filled by encoding the pre-tokens
that the table lacks. Counts are exact whatever the table holds, no pre-token is ever shuffled, and the
plan is one map over the documents.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches

#: Fixed value: the pre-token pattern that byte-level vocabularies of this kind are built with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of the sample, entries of the broadcast table, entries of a worker's cache.
SAMPLE_ROWS, TABLE_SIZE, CACHE_SIZE = 2000, 65_536, 400_000
#: Texts longer than this are matched piecewise, this many pre-tokens at a time.
LONG_TEXT, LONG_STEP = 4 << 20, 1 << 18


class PreTokens:
    """Splits texts as a byte-level tokenizer does, and encodes single pre-tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)

    def parts(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and how many special strings there are."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def lists(self, text: str) -> Iterator[list[str]]:
        if len(text) < LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while piece := list(islice(found, LONG_STEP)):
            yield piece

    def lengths(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)]


def is_byte_level(path: str) -> bool:
    """Whether the two-tier lookup applies: byte-level BPE with its usual pattern and no normalizer."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    return plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def frequent_lengths(texts: DataFrame, text: str, path: str, rows: int = SAMPLE_ROWS, size: int = TABLE_SIZE) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a seeded sample of about ``rows`` rows.

    Each task counts its rows on its own and sends its most frequent ones, twice the table's size for the
    whole sample; the driver adds them up. The table only saves time, it can't change a count.
    """
    n = texts.count()
    if not n:
        return {}
    sample = texts.select(F.col(text).alias("text")).sample(min(1.0, rows / n), seed=7).where("text is not null")

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        pre = PreTokens(path)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            seen: Counter[str] = Counter()
            for value in batch.column(0).to_pylist():
                for part in pre.parts(value)[0]:
                    for found in pre.lists(part):
                        seen.update(found)
            top = seen.most_common(max(64, 2 * size * batch.num_rows // rows))
            yield {"pre": [t for t, _ in top], "n": [c for _, c in top]}

        return each

    total: Counter[str] = Counter()
    for row in map_batches(sample, make, "pre string, n long").collect():
        total[row.pre] += row.n
    top = [t for t, _ in total.most_common(size)]
    return dict(zip(top, PreTokens(path).lengths(top), strict=True)) if top else {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """Exact token count of every text under the tokenizer at ``path`` (``.json`` or ``.model``).

    Returns id_col, n_bytes (of UTF-8), n_tokens and over_limit (n_tokens > limit), one row for each
    input row. A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are treated
    as the library does by default. Null ids, repeated rows and empty tables pass through; other columns,
    whatever their names, are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if is_byte_level(path):
        frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, "text", path, size=table_size))
        make = lambda: _two_tier(path, frequent)
    else:
        make = lambda: _whole(path)

    def with_bytes() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        count = make()

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            ids, texts = batch.columns
            n = []
            for chunk in chunks([t or "" for t in texts.to_pylist()]):
                n += count(chunk)
            yield {"id": ids, "n_bytes": pc.fill_null(pc.binary_length(texts), 0), "n_tokens": n, "over_limit": [x > limit for x in n]}

        return each

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, with_bytes, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def _two_tier(path: str, frequent) -> Callable[[list[str]], list[int]]:
    pre, table = PreTokens(path), frequent.value
    cache = dict(table)

    def total(found: list[str]) -> int:
        return sum(map(cache.__getitem__, found))

    def learn(found: list[list[str]]) -> None:
        misses = list(set().union(*found).difference(cache))
        if misses:
            if len(cache) + len(misses) > CACHE_SIZE + len(table):
                cache.clear()
                cache.update(table)
                misses = list(set().union(*found).difference(cache))
            cache.update(zip(misses, pre.lengths(misses), strict=True))

    def count(texts: list[str]) -> list[int]:
        split = [pre.parts(t) for t in texts]
        if sum(map(len, texts)) >= LONG_TEXT:
            out = []
            for parts, special in split:
                n = special
                for part in parts:
                    for found in pre.lists(part):
                        learn([found])
                        n += total(found)
                out.append(n)
            return out
        found = [[pre.pattern.findall(p) for p in parts] for parts, _ in split]
        learn([x for lists in found for x in lists])
        return [special + sum(map(total, lists)) for (_, special), lists in zip(split, found, strict=True)]

    return count


def _whole(path: str) -> Callable[[list[str]], list[int]]:
    """Tokenizers whose pre-tokens don't stand alone encode whole texts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
