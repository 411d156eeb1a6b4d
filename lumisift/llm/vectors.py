"""Near-duplicate vectors by product quantisation.

Coarse centroids and residual subspace codewords are fitted on a bounded sample (FIT_ROWS smallest hashes of
vec_id). Every usable vector is indexed: unit length, nearest centroid (its inverted list), one code byte a
subspace, and the exact length e of what the codes leave. As a query, a vector probes every list that can hold a
neighbour: with d the distance of a cosine's threshold, list c of a query whose nearest centroid is c0 is needed
only if |y-c|^2 - |y-c0|^2 <= 2 d |c-c0| (a point of cell c lies beyond the bisecting plane). Within a list,
distances to the coded points come from a lookup table a query; a point stays while its table distance is at most
d + e. Both bounds are necessary conditions, so recall is 1; what stays is reranked by the exact cosine in double
precision. Lists split into blocks of BLOCK_ROWS meet block by block, and a block pair returns counts a query and a
spanning forest of its links, never the pairs.

Equal vectors of a label are one point of the index, whose links count as often as it occurs, so a group of copies
costs as much as one vector.

Vectors that are null, zero, or hold null or non-finite components, and rows with null label, link with nothing;
lengths may differ: each has its own index, and vectors are compared within their label and length. Rows that share a
vec_id count as one vector, their smallest (label, embedding); each row is returned. A null vec_id has n_links 0 and
component null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.common import components, discard, forest, partitions_for, table, written

LEAST = 0.98
FIT_ROWS = 16_384
SUBSPACES, CODEWORDS = 16, 64
BLOCK_ROWS = 4_096
_SLACK = 1e-9


@dataclass
class Index:
    coarse: np.ndarray  # lists x dims
    words: np.ndarray  # subspaces x codewords x dims of a subspace

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _square(x, self.coarse)

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code bytes of residuals, and the length of what they leave."""
        m, _, k = self.words.shape
        parts = np.pad(rest, ((0, 0), (0, m * k - rest.shape[1]))).reshape(len(rest), m, k)
        out, left = np.empty((len(rest), m), np.uint8), np.zeros(len(rest))
        for i in range(m):
            d = _square(parts[:, i], self.words[i])
            out[:, i] = d.argmin(1)
            left += ((parts[:, i] - self.words[i][out[:, i]]) ** 2).sum(1)
        return out, np.sqrt(left)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances of residuals to each subspace's codewords."""
        m, _, k = self.words.shape
        parts = np.pad(rest, ((0, 0), (0, m * k - rest.shape[1]))).reshape(len(rest), m, k)
        return np.stack([_square(parts[:, i], self.words[i]) for i in range(m)], 1)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None], 0)


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _square(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Index:
    coarse = _means(sample, min(lists, len(sample)))
    rest = sample - coarse[_square(sample, coarse).argmin(1)]
    dims = -(-sample.shape[1] // subspaces)
    parts = np.pad(rest, ((0, 0), (0, subspaces * dims - rest.shape[1]))).reshape(len(rest), subspaces, dims)
    return Index(coarse, np.stack([_means(parts[:, i], min(codewords, len(sample))) for i in range(subspaces)]))


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): a row a vec_id, only vectors that can link, components as doubles.

    Vectors whose squares would leave the range of doubles are scaled by a power of two, which changes no digit.
    """
    one = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    one = one.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    finite = "label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    one = one.where(finite).withColumn("most", F.expr("array_max(transform(v, x -> abs(x)))")).where("most > 0")
    scale = "pow(2D, greatest(-1000, least(1000, -floor(log2(most)))))"
    v = F.expr(f"if(most between 1e-140 and 1e140, v, zip_with(v, array_repeat({scale}, size(v)), (x, s) -> x * s))")
    return one.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"))


def block_links(
    index: Index, cell: int, dv: np.ndarray, did: np.ndarray, dn: np.ndarray, qv: np.ndarray, qid: np.ndarray, least: float = LEAST
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Links of each query to a block of a list whose points occur dn times, and a spanning forest of them."""
    reach = np.sqrt(2 - 2 * least)
    du, qu = dv / np.linalg.norm(dv, axis=1)[:, None], qv / np.linalg.norm(qv, axis=1)[:, None]
    code, left = index.codes(du - index.coarse[cell])
    limit = (reach + left + 1e-6) ** 2
    count = np.zeros(len(qid), np.int64)
    us, vs, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for s in range(0, len(qid), 256):
        q = qu[s : s + 256]
        lookup = index.tables(q - index.coarse[cell]).astype(np.float32)
        near = np.zeros((len(q), len(did)), np.float32)
        for m in range(lookup.shape[1]):
            near += lookup[:, m][:, code[:, m]]
        x, y = np.nonzero(near <= limit[None].astype(np.float32) + 1e-5)
        for k in range(0, len(x), 1 << 16):
            i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            a, b = qv[s + i], dv[j]
            cos = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            ok = (cos >= least) & (qid[s + i] != did[j])
            np.add.at(count, s + i[ok], dn[j[ok]])
            us.append(qid[s + i[ok]])
            vs.append(did[j[ok]])
            held += int(ok.sum())
            if held > 1 << 20:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], len(u)
    return count, forest(np.concatenate(us), np.concatenate(vs))


def near_vectors(rows: DataFrame, least: float = LEAST, lists: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    parts = partitions_for(rows)
    every = written(usable(rows), "vectors")
    fine = written(every.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m")).select("vec_id", "label", "v", "m"), "points")
    indexes: dict[int, Index] = {}  # one a length; a point alone in its length links only with its copies
    for dims, total in fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect():
        sample = fine.where(F.size("v") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow().column(0).combine_chunks()
        x = _units(sample)
        indexes[dims] = fit(x / np.linalg.norm(x, axis=1)[:, None], lists or int(np.clip(np.sqrt(total) / 4, 4, 1024)))
    reach = np.sqrt(2 - 2 * least) + _SLACK
    spans = {dims: np.sqrt(_square(i.coarse, i.coarse)) for dims, i in indexes.items()}

    def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        size = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        for dims in np.unique(size).tolist():
            if dims in indexes:
                yield dims, b if (size == dims).all() else b.take(pa.array(np.flatnonzero(size == dims)))

    def unit(b: pa.RecordBatch) -> np.ndarray:
        v = _units(b.column(2))
        return v / np.linalg.norm(v, axis=1)[:, None]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for dims, b in by_length(whole):
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.full(b.num_rows, dims, np.int32)), pa.array(indexes[dims].cells(unit(b)).argmin(1).astype(np.int32))], names=["label", "dims", "cell"])

    counts = fine.select("vec_id", "label", "v").mapInArrow(place, "label string, dims int, cell int").groupBy("label", "dims", "cell").count()
    # lists that need more than one block: at most rows / block_rows of them
    split = {(r["label"], r["dims"], r["cell"]): -(-r["count"] // block_rows) for r in counts.where(F.col("count") > block_rows).collect()}
    kind = "label string, dims int, cell int, db int, qb int, query boolean, vec_id long, v array<double>, m long"
    schema = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("cell", pa.int32()), ("db", pa.int32()), ("qb", pa.int32()), ("query", pa.bool_()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("m", pa.int64())])

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for k in range(0, whole.num_rows, 2000):
                for dims, b in by_length(whole.slice(k, 2000)):
                    d = indexes[dims].cells(unit(b))
                    own = d.argmin(1)
                    least_d = d[np.arange(len(d)), own]
                    row, cell = np.nonzero(d - least_d[:, None] <= 2 * reach * spans[dims][own] + _SLACK)
                    vec, label = np.asarray(b.column(0)), b.column(1).to_pylist()
                    at, cells, dbs, qbs, query = [], [], [], [], []

                    def put(r: int, c: int, i: int, j: int, q: bool) -> None:
                        at.append(r), cells.append(c), dbs.append(i), qbs.append(j), query.append(q)

                    mix = (vec.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).tolist()
                    for r, c in zip(row.tolist(), cell.tolist(), strict=True):
                        n = split.get((label[r], dims, c), 1)
                        for i in range(n):
                            put(r, c, i, mix[r] % n, True)
                    for r, c in enumerate(own.tolist()):
                        n = split.get((label[r], dims, c), 1)
                        for j in range(n):
                            put(r, c, mix[r] % n, j, False)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column(1).take(take), pa.array(np.full(len(at), dims, np.int32)), pa.array(cells, pa.int32()), pa.array(dbs, pa.int32()), pa.array(qbs, pa.int32()), pa.array(query), b.column(0).take(take), b.column(2).take(take), b.column(3).take(take)], schema=schema)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks in turn, their list's points before their queries, which stream."""
        key, points, block = None, [], None
        for b in it:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
            is_query = np.asarray(b.column(5).to_numpy(zero_copy_only=False), bool)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or is_query[i] != is_query[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if keys[s] != key:
                    key, points, block = keys[s], [], None
                part = b.slice(s, e - s)
                v, ids_ = _units(part.column(7)), np.asarray(part.column(6))
                if not is_query[s]:
                    points.append((v, ids_, np.asarray(part.column(8))))
                    block = None
                    continue
                if not points:
                    continue
                if block is None:
                    block = tuple(np.concatenate([p[i] for p in points]) for i in range(3))
                    points = [block]
                n, (u, w) = block_links(indexes[key[1]], key[2], *block, v, ids_, least)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids_[some], u])), pa.array(np.concatenate([ids_[some], w])), pa.array(np.concatenate([n[some], np.zeros(len(u), np.int64)]))], names=["u", "v", "n"])

    at = ["label", "dims", "cell", "db", "qb"]
    dealt = fine.select("vec_id", "label", "v", "m").mapInArrow(deal, kind).repartition(parts, *at).sortWithinPartitions(*at, "query")
    found = written(dealt.mapInArrow(compare, "u long, v long, n long"), "vector-links")
    links = found.groupBy(F.col("u").alias("point")).agg(F.sum("n").alias("n"))
    near = components(found.where("u <> v").select("u", "v"), "vectors").withColumnRenamed("node", "point")
    point = F.col("vec_id").alias("point")
    named = fine.select(point, "m").join(links, "point", "left").join(near, "point", "left")
    named = written(named.select("point", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "point").alias("component"), "m"), "vector-points")
    discard(found)
    copies = every.join(fine.where("m > 1").select(point, "label", "v"), ["label", "v"]).select("vec_id", "point").where("vec_id <> point")
    known = copies.join(named.where("m > 1").select("point", "n", "component"), "point").select("vec_id", "n", "component")
    known = known.union(named.where("m > 1 or n > 0").select("point", "n", "component"))
    out = ids.join(known, "vec_id", "left")
    kept = F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), kept.alias("kept"))


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
