"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds the adjacent pairs that have a merge rank. The pair of
lowest rank (leftmost on ties) is popped and merged until none is left: the count is the initial symbols minus
the merges, and no identifiers are made. Words recur, so each worker keeps the counts of a bounded number of them.

Text is normalised and split as the tokenizer's file says (NFC, white space to one space, lower case character by
character; contractions, letter runs, single digits, runs of other marks); its special strings count as one token
each, as the library counts them. Python's tables of characters and the library's are of different Unicode versions:
texts with characters on which they might not agree are normalised and split by the library, and merged here like any
other. Null text counts as empty. Repeated rows and null ids are passed through.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.common import table
from lumisift.llm.ids import byte_symbols, groups_of, texts_of

LIMIT = 2048
CACHE_WORDS = 400_000


class Counter:
    """Counts the tokens that the word-level tokenizer in the file gives."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.byte = {c: b for b, c in enumerate(self.symbols)}
        marks = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, marks))) if marks else None
        self.held: dict[str, int] = {}
        # where Python's own, faster engine surely agrees: ASCII and the Latin letters
        self.plain = re.compile("[\t-\r -~\xa0\xa1\xbf-ſ‐-‧]*")
        self.quick = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

        # where both surely have the same classes, cases and compositions: scripts and signs long in Unicode
        self.sure = re.compile(
            "[\t-\r -~\xa0-\u02af\u0300-\u0345\u0370-\u0377\u037a-\u037f\u0384-\u03ff\u0400-\u052f\u05d0-\u05ea\u0620-\u064a"
            "\u0660-\u0669\u0e01-\u0e2f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2100-\u214f\u2190-\u27bf\u3001-\u3029"
            "\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\ufe0f\uff01-\uff9f\U0001f300-\U0001f64f\U0001f680-\U0001f6c5]*"
        )

    def word(self, word: str) -> int:
        """Initial symbols minus merges."""
        sym: list[str | None] = [self.symbols[b] for b in word.encode()]
        n = len(sym)
        if not n:
            return 0
        sym[-1] += self.end
        if n == 1:
            return 1
        rank, left, right = self.rank, list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, p) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # an earlier merge took one of them
            sym[i], sym[j], merges = a + b, None, merges + 1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get(p := (sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := left[i]) >= 0 and (r := rank.get(p := (sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, p))
        return n - merges

    def words(self, text: str) -> list[str]:
        if not self.plain.fullmatch(text) and not self.sure.fullmatch(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte.__getitem__, p)).decode() for p, _ in pieces]
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # no final form: each character is lowered by itself
        return (self.quick if self.plain.fullmatch(text) else self.split).findall(text)

    def segment(self, text: str) -> int:
        words, held = self.words(text), self.held
        try:
            return sum(map(held.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for w in words:
            c = held.get(w)
            if c is None:
                c = self.word(w)
                if len(held) < CACHE_WORDS:
                    held[w] = c
            total += c
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One a worker process, whose tasks share it."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for whole in it:
            for b in groups_of(whole, 1):
                texts = texts_of(b.column(1))
                sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(map(count, texts), pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
