"""Problem 4: clusters of texts about the same subject, with their sizes and most typical members."""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize

FINE, DIMENSIONS = 1 << 20, 512
MIN_TEXTS = 5
#: Seeds that a round of the seeding draws, as a multiple of the root of the number of texts; and the number of rounds.
OVERSAMPLING, SEED_ROUNDS = 2.0, 3
STEPS = 8
#: Centroids of a cosine from this one on are one cluster.
JOIN = 0.72
#: A text below this cosine to every centroid is about none of the subjects.
MIN_SIMILARITY = 0.4
#: The share of a cluster's hints that its name must have; a cluster of all sorts of hints has no subject.
MIN_VOTE = 0.35
BLOCK = 1024
_MARKUP = re.compile(r"<[^<>]*>|&[a-z]+;")
_WORD = re.compile(r"[^\W\d_]{3,}")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) & (FINE - 1)
        return h


_hashes = _Hashes()


def words(text: str | None) -> Counter:
    """Hashed words of three letters or more, in lower case and without markup, with their counts."""
    return Counter(map(_hashes.__getitem__, _WORD.findall(_MARKUP.sub(" ", (text or "").lower()))))


def weights(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Inverse document frequency of each of the 2^20 word hashes over all texts, 0 for hashes of fewer than ``MIN_TEXTS`` texts; the number of texts with words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(FINE + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                bag = list(words(t))
                n[bag] += 1
                n[FINE] += bool(bag)
        h = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n[h])], ["h", "n"])

    # at most 2^20 + 1 rows of two numbers come to the driver, whatever the size of the corpus
    rows = df.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS).toArrow()
    h, n = rows.column("h").to_numpy(), rows.column("n").to_numpy().astype(float)
    total = int(n[h == FINE].sum())
    out = np.zeros(FINE, np.float32)
    out[h[h < FINE]] = np.log((total + 1) / (n[h < FINE] + 1))
    return out, total


def vectors(df: DataFrame, record: str, text: str, hint: str) -> DataFrame:
    """(record, hint, vec): unit vectors of words weighted by (1 + ln count) * idf and hashed with a sign; texts without such words are left out.

    ``vec`` holds the places (two bytes) and then the values (two-byte floats) that are not zero.
    """
    idf = weights(df, text)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                bag = words(t)
                h = np.fromiter(bag, np.int64, len(bag))
                w = (1 + np.log(np.fromiter(bag.values(), np.float64, len(bag)))) * idf[h]
                v = np.bincount(h & (DIMENSIONS - 1), np.where(h >> 19, w, -w), DIMENSIONS)
                norm = np.linalg.norm(v)
                at = np.flatnonzero(v)
                out.append(at.astype("<u2").tobytes() + (v[at] / norm).astype("<f2").tobytes() if norm else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.binary())], ["record", "hint", "vec"])

    good = df.where(F.col(record).isNotNull()).select(F.col(record).cast("bigint").alias("record"), F.col(hint).cast("int").alias("hint"), F.col(text).cast("string"))
    return good.mapInArrow(run, "record bigint, hint int, vec binary").where("vec IS NOT NULL")


def dense(vecs: pa.Array) -> np.ndarray:
    out = np.zeros((len(vecs), DIMENSIONS), np.float32)
    for k, v in enumerate(vecs.to_pylist()):
        half = len(v) // 2
        out[k, np.frombuffer(v, "<u2", half // 2)] = np.frombuffer(v, "<f2", half // 2, half)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their vectors, their nearest centroid (the first on ties) and their cosine with it."""
    for whole in batches:
        for lo in range(0, len(whole), BLOCK):
            part = whole.slice(lo, BLOCK)
            x = dense(part.column("vec"))
            s = x @ centres.T
            at = s.argmax(1) if len(centres) else np.zeros(len(x), np.int64)
            yield part, x, at, s[np.arange(len(x)), at] if len(centres) else np.zeros(len(x), np.float32)


def _dice(records: pa.Array, salt: int) -> np.ndarray:
    x = np.asarray(records).astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def seeding(vecs: DataFrame, n: int, seed: int) -> np.ndarray:
    """Seeds by parallel oversampling: each round draws about ``OVERSAMPLING`` * sqrt(n) texts, with chances in proportion to their squared distance to the seeds so far.

    The dice are thrown on the record, so the partitioning changes nothing.
    """
    most = OVERSAMPLING * math.sqrt(n)
    seeds, cost = np.zeros((0, DIMENSIONS), np.float32), 2.0 * n
    for rnd in range(SEED_ROUNDS):

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for part, x, _, s in _blocks(batches, seeds):  # noqa: B023
                far = np.maximum(2 - 2 * s, 0)
                total += float(far.sum())
                hit = np.flatnonzero(_dice(part.column("record"), seed * 100 + rnd) < most * far / cost)  # noqa: B023
                yield pa.RecordBatch.from_arrays([part.column("record").take(pa.array(hit)), part.column("vec").take(pa.array(hit)), pa.nulls(len(hit), pa.float64())], ["record", "vec", "cost"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total])], ["record", "vec", "cost"])

        got = vecs.select("record", "vec").mapInArrow(draw, "record bigint, vec binary, cost double").orderBy("record", "vec").toArrow()
        new = got.filter(got.column("vec").is_valid())
        cost = max(float(np.nansum(got.column("cost").to_numpy())), 1e-9)
        seeds = np.unique(np.concatenate([seeds, dense(new.column("vec").combine_chunks())]), axis=0)
    return seeds


def step(vecs: DataFrame, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the texts nearest each centroid and their number, of those of cosine ``least`` or more: one sum for each task and centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((len(centres), DIMENSIONS), np.float32), np.zeros(len(centres), np.int64)
        for _, x, at, s in _blocks(batches, centres):
            good = s >= least
            order = np.argsort(at[good], kind="stable")
            to, first = np.unique(at[good][order], return_index=True)
            if len(to):
                sums[to] += np.add.reduceat(x[good][order], first, axis=0)
                n += np.bincount(at[good], minlength=len(centres))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array([sums[k].tobytes() for k in used], pa.binary())], ["c", "n", "sum"])

    def add(rows: pa.Table) -> pa.Table:
        c, total = np.unique(rows.column("c").to_numpy(), return_inverse=True)
        sums = np.zeros((len(c), DIMENSIONS), np.float32)
        for k, s in zip(total.tolist(), rows.column("sum").to_pylist()):
            sums[k] += np.frombuffer(s, np.float32)
        return pa.table({"c": c, "n": np.bincount(total, rows.column("n").to_numpy()).astype(np.int64), "sum": pa.array([s.tobytes() for s in sums], pa.binary())})

    schema = "c bigint, n bigint, sum binary"
    got = vecs.select("record", "vec").mapInArrow(run, schema).groupBy(F.pmod("c", F.lit(64))).applyInArrow(add, schema).orderBy("c").toArrow()
    return _unit(np.array([np.frombuffer(s, np.float32) for s in got.column("sum").to_pylist()], np.float32).reshape(-1, DIMENSIONS)), got.column("n").to_numpy()


def joined(centres: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Centroids, the largest first, of which no two are nearer than ``least``: a smaller one is added to the nearest larger one, by their sizes."""
    order = np.argsort(-n, kind="stable")
    sums, kept = np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32)
    for k in order.tolist():
        near = kept @ centres[k] if len(kept) else np.zeros(0)
        if len(near) and near.max() >= least:
            at = int(near.argmax())
            sums[at] += n[k] * centres[k]
            kept[at] = _unit(sums[at : at + 1])[0]
        else:
            sums, kept = np.concatenate([sums, n[k] * centres[k : k + 1]]), np.concatenate([kept, centres[k : k + 1]])
    return kept


def kmeans(vecs: DataFrame, n: int, seed: int = 11) -> np.ndarray:
    """Unit centroids of spherical k-means; their number comes from the texts alone.

    Oversampled seeds are the first centroids, so that every subject of some texts has several. After each step
    centroids of fewer than ``MIN_TEXTS`` texts go and centroids nearer than ``JOIN`` become one; from the second step on
    texts below half of ``MIN_SIMILARITY`` do not move a centroid, from the fourth those below it.
    """
    centres = seeding(vecs, n, seed)
    for k in range(STEPS):
        if not len(centres):
            break
        centres, size = step(vecs, centres, -1.0 if k == 0 else MIN_SIMILARITY / 2 if k < 3 else MIN_SIMILARITY)
        if k:
            centres, size = centres[size >= MIN_TEXTS], size[size >= MIN_TEXTS]
        centres = joined(centres, size, JOIN)
    return centres


def nearest(vecs: DataFrame, centres: np.ndarray) -> DataFrame:
    """(record, hint, cluster, similarity) of the texts that have a centroid of ``MIN_SIMILARITY`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, at, s in _blocks(batches, centres):
            out = pa.RecordBatch.from_arrays([part.column("record"), part.column("hint"), pa.array(at.astype(np.int32)), pa.array(s.astype(np.float64))], ["record", "hint", "cluster", "similarity"])
            yield out.filter(pa.array(s >= MIN_SIMILARITY))

    return vecs.mapInArrow(run, "record bigint, hint int, cluster int, similarity double")


def names(members: DataFrame) -> DataFrame:
    """(cluster, topic): the hint that most texts of a cluster of ``MIN_TEXTS`` or more carry, if it has ``MIN_VOTE`` of the hints given; -1 and null are none."""
    votes = members.groupBy("cluster", F.when(F.col("hint") >= 0, F.col("hint")).alias("topic")).agg(F.count("*").alias("n"))
    size = votes.groupBy("cluster").agg(F.sum("n").alias("size"), F.sum(F.when(F.col("topic").isNotNull(), F.col("n"))).alias("given")).where(F.col("size") >= MIN_TEXTS)
    first = Window.partitionBy("cluster").orderBy(F.desc("n"), "topic")
    best = votes.where("topic IS NOT NULL").withColumn("r", F.row_number().over(first)).where("r = 1")
    return best.join(size, "cluster").where(F.col("n") >= MIN_VOTE * F.col("given")).select("cluster", "topic")


def subject_clusters(df: DataFrame, record: str = "doc_id", text: str = "Document", hint: str = "Topic", seed: int = 11) -> DataFrame:
    """(record, topic, similarity): the texts of every cluster of ``MIN_TEXTS`` or more about one subject.

    Texts are vectorised by hashed weighted words and divided by distributed k-means with parallel oversampled seeding.
    Clusters, their number and their members come from the texts alone: hints only name finished clusters (the most
    frequent one; clusters of one name count as one). A text whose cosine with its centroid is below ``MIN_SIMILARITY`` is
    about none of the subjects.

    To the driver come the word frequencies (2^20 at most), the seeds (a multiple of the root of the number of texts)
    and the centroids, of 2 KB each. Defined cases: null, blank and wordless texts and null records belong to no
    cluster; repeated rows stay; equal votes go to the smaller hint; a cluster without any hint has no name and is left
    out; no rows give no rows.
    """
    vecs = materialize(vectors(df, record, text, hint), "vectors")
    n = vecs.count()
    centres = kmeans(vecs, n, seed) if n else np.zeros((0, DIMENSIONS), np.float32)
    if not len(centres):
        return vecs.select(F.col("record").alias(record), F.col("hint").alias("topic"), F.lit(0.0).alias("similarity")).limit(0)
    members = materialize(nearest(vecs, centres), "members")
    discard(vecs)
    return members.join(names(members), "cluster").select(F.col("record").alias(record), "topic", "similarity")


def typical(members: DataFrame, record: str = "doc_id", most: int = 5) -> DataFrame:
    """(topic, size, rank, record, similarity): of each cluster its size and the ``most`` members nearest its centroid."""
    w = Window.partitionBy("topic").orderBy(F.desc("similarity"), record)
    near = members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return near.join(members.groupBy("topic").agg(F.count("*").alias("size")), "topic").select("topic", "size", "rank", record, "similarity")
