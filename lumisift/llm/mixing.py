"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a in [0, 1] and normalised. The exponent is bisected: to the least
for which no source is repeated more than `max_repetition` times, or to the one at which the weights' entropy meets
`target_entropy` bits. The budget is such that no source is read less than once, or the one given. A source's
passes are realised over BLOCKS blocks of its documents: each pass is an affine permutation of the blocks, and a
partial pass takes, in that pass's order, each block that fits in what is left and passes over the others: it falls
short of the plan by less than the least block it left out.

Only sums a block and a row a source leave the executors, and the texts are read once; documents never move. Tokens
are runs of other than white space; null text has none, a null source is a source of its own, a source without tokens
is read once, and rows that share a doc_id share a block. Tied blocks cannot occur: a pass gives each its own place.
Other columns are kept by mix() as they are, but one named `mixed` gives way to the new one. An empty table gives an
empty plan and no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import discard, table, written

BLOCKS = 1024
MAX_REPETITION = 2.0
SEED = 7
BROADCAST_SOURCES = 10_000


def weights(tokens: list[float], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent if t > 0 else 0.0 for t in tokens]
    whole = sum(raised)
    return [r / whole for r in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log2(x) for x in w if x > 0)


def repetitions(tokens: list[float], w: list[float], budget: float | None = None) -> list[float]:
    """Passes over each source; without a budget the least-read source is read once."""
    if budget is None:
        budget = max(t / x for t, x in zip(tokens, w, strict=True) if t > 0)
    return [budget * x / t if t > 0 else 1.0 for t, x in zip(tokens, w, strict=True)]


def temper(tokens: list[float], max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None) -> float:
    """The bisected exponent."""
    if not any(t > 0 for t in tokens):
        return 1.0

    def flat(a: float) -> bool:  # whether a is too flat
        w = weights(tokens, a)
        return entropy(w) > target_entropy if target_entropy is not None else max(repetitions(tokens, w)) > max_repetition

    if target_entropy is None and max_repetition is None or not flat(0.0):
        return 1.0 if target_entropy is None and max_repetition is None else 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if flat(mid) else (low, mid)
    return high


def _tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _block(doc_id: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(BLOCKS)).cast("int")


def _place(source: Column, turn: Column, block: Column, seed: int) -> Column:
    """Where a pass has a block: an affine permutation of the blocks, drawn for the source and pass."""
    odd = F.pmod(F.xxhash64(source, turn, F.lit(seed), F.lit("a")), F.lit(BLOCKS // 2)) * 2 + 1
    return F.pmod(odd * block + F.pmod(F.xxhash64(source, turn, F.lit(seed), F.lit("c")), F.lit(BLOCKS)), F.lit(BLOCKS)).cast("int")


_PLAN = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("tokens", T.DoubleType()), T.StructField("weight", T.DoubleType()),
    T.StructField("repetition", T.DoubleType()), T.StructField("realised", T.DoubleType()), T.StructField("whole", T.IntegerType()),
    T.StructField("taken", T.ArrayType(T.LongType())),
])


def plan(
    docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED
) -> DataFrame:
    """A row a source: tokens, weight, repetition planned and realised, whole passes, and the places of the partial
    pass, 64 a word."""
    spark = docs.sparkSession
    rows = docs.select(F.col("source").cast("string").alias("source"), _block("doc_id", seed).alias("block"), _tokens().alias("n"))
    blocks = written(rows.groupBy("source", "block").agg(F.sum("n").alias("n")), "mixing-blocks")
    sums = blocks.groupBy("source").agg(F.sum("n").alias("n"))
    found = sorted(((r["source"], float(r["n"])) for r in sums.collect()), key=lambda x: (x[0] is not None, x[0]))
    tokens = [n for _, n in found]
    w = weights(tokens, temper(tokens, max_repetition, target_entropy)) if any(tokens) else [0.0] * len(tokens)
    rep = [round(r, 9) for r in repetitions(tokens, w, budget)] if any(tokens) else [1.0] * len(tokens)
    rest = [(r - math.floor(r)) * n for r, n in zip(rep, tokens, strict=True)]
    took: dict[str | None, tuple[list[int], float]] = {}
    if any(rest):
        # the partial pass's blocks in its order, each taken if it fits: at most BLOCKS rows a source
        few = spark.createDataFrame([(s, math.floor(r), x) for (s, _), r, x in zip(found, rep, rest, strict=True)], "source string, whole int, rest double")
        s = F.col("b.source")
        seen = blocks.alias("b").join(F.broadcast(few).alias("p") if len(found) <= BROADCAST_SOURCES else few.alias("p"), s.eqNullSafe(F.col("p.source")))
        seen = seen.select(s.alias("source"), "n", "rest", _place(s, F.col("whole"), F.col("block"), seed).alias("place"))
        fits = F.expr("""aggregate(array_sort(collect_list(struct(place, n))), named_struct('left', max(rest), 'out', cast(array() as array<int>)),
            (a, x) -> if(x.n <= a.left, named_struct('left', a.left - x.n, 'out', concat(a.out, array(x.place))), a))""")
        words = F.expr(f"transform(sequence(0, {BLOCKS // 64 - 1}), w -> aggregate(filter(fits.out, p -> p div 64 = w), 0L, (a, p) -> a | shiftleft(1L, p % 64)))")
        passes = seen.groupBy("source").agg(fits.alias("fits")).select("source", words.alias("taken"), "fits.left")
        took = {r["source"]: (r["taken"], r["left"]) for r in passes.collect()}
    discard(blocks)
    data = []
    for (s, n), x, r, more in zip(found, w, rep, rest, strict=True):
        taken, left = took[s] if more else ([], 0.0)
        data.append((s, n, x, r, (math.floor(r) * n + more - left) / n if n else r, math.floor(r), taken))
    return spark.createDataFrame(data, _PLAN)


def mix(docs: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with a column `mixed` (copy, block, place, weight, repetition, realised): a row for each time a document is read."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    p = sources.select(F.col("source").alias("of"), F.struct("weight", "repetition", "realised", "whole", "taken").alias("plan"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("own"), _block("doc_id", seed).alias("block"))
    joined = rows.join(F.broadcast(p) if few else p, F.col("own").eqNullSafe(F.col("of")))
    last = _place(F.col("own"), F.col("plan.whole"), F.col("block"), seed)
    copies = F.col("plan.whole") + F.coalesce(F.getbit(F.get("plan.taken", F.floor(last / 64).cast("int")), last % 64).cast("int"), F.lit(0))
    read = joined.withColumn("turn", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    place = _place(F.col("own"), F.col("turn"), F.col("block"), seed)
    out = F.struct(F.col("turn").alias("copy"), "block", place.alias("place"), *(F.col(f"plan.{c}").alias(c) for c in ("weight", "repetition", "realised")))
    return read.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "mixed"], out.alias("mixed"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    read = mix(docs.select("doc_id", "source"), plan(docs))
    return read.select("doc_id", "source", "mixed.copy", "mixed.block", "mixed.place", F.round("mixed.weight", 9).alias("weight"), F.round("mixed.repetition", 9).alias("repetition"), F.round("mixed.realised", 9).alias("realised"))
