"""Problem 5: records that differ only in layout, case, punctuation or the order of their fields."""

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: What a bucket may hold, whatever the size of the corpus.
BUCKET_BYTES = 4 << 20
#: Bytes by which records are split first; each further level looks at twice as many.
FIRST_BYTES = 2
#: The first bytes of a record are kept beside it, so that the first levels need not read the whole of it.
HEAD_BYTES = 64
_DROP = bytes(b for b in range(128) if not chr(b).isalnum())
_NOT_KEPT = re.compile(r"[\W_]+")


def canonical(text: str) -> bytes:
    """Letters and digits of ``text`` in order, without case and Unicode presentation."""
    if text.isascii():
        return text.lower().encode().translate(None, _DROP)
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return _NOT_KEPT.sub("", t).encode("utf-8", "surrogatepass")


def canonical_record(fields: tuple[str | None, ...]) -> bytes | None:
    """The sorted canonical fields, or null if a field is null or blank."""
    if any(f is None or not f.strip() for f in fields):
        return None
    return b"\n".join(sorted(map(canonical, fields)))


def keyed(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """(record, canon) of the rows whose fields are all filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canon = [canonical_record(f) for f in zip(*(c.to_pylist() for c in b.columns[1:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(canon, pa.binary())], ["record", "canon"])

    return df.select(F.col(record).cast("bigint").alias("record"), *[F.col(f).cast("string") for f in fields]).where("record IS NOT NULL").mapInArrow(run, "record bigint, canon binary").where("canon IS NOT NULL")


class Trie:
    """Path-compressed trie of byte strings; a terminal counts its strings and keeps the first one's record."""

    def __init__(self) -> None:
        self.root: dict[int, list] = {}

    def add(self, key: bytes, record: int) -> tuple[int, int]:
        """(first record of this key, its count so far)."""
        key += b"\xff\xff"  # no UTF-8 text has this byte: a key is never the beginning of another
        node, at = self.root, 0
        while True:
            edge = node.get(key[at])
            if edge is None:
                node[key[at]] = [key[at:], None, 1, record]
                return record, 1
            label = edge[0]
            if key.startswith(label, at):
                at += len(label)
                if edge[1] is None:
                    edge[2] += 1
                    return edge[3], edge[2]
                node = edge[1]
                continue
            low, high = 1, min(len(label), len(key) - at)  # the labels share at least their first byte
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if key.startswith(label[:mid], at) else (low, mid - 1)
            rest = [label[low:], edge[1], edge[2], edge[3]]
            edge[0], edge[1], edge[2], edge[3] = label[:low], {label[low]: rest}, 0, None


def count_bucket(rows: pa.Table) -> pa.Table:
    """Counts the rows of some whole buckets, or of a share of the texts too frequent for one, in a trie: a row for each row.

    ``copies``, the terminal's counter, comes on the first row of its text only.
    """
    record, canon = rows.column("record").to_numpy(), rows.column("canon").to_pylist()
    order = np.argsort(record, kind="stable")
    trie, first = Trie(), np.zeros(len(order), np.int64)
    counters: dict[int, int] = {}
    for at, k in enumerate(order.tolist()):
        first[at], n = trie.add(canon[k], at)
        counters[int(first[at])] = n
    copies = np.zeros(len(order), np.int64)
    copies[list(counters)] = list(counters.values())
    record = record[order]
    key = [hashlib.sha256(canon[k]).digest() for k in order.tolist()] if rows.num_rows and rows.column("hot")[0].as_py() else pa.nulls(len(order), pa.binary())
    return pa.table({"first_index": record[first], "row_index": record, "copies": pa.array(copies, mask=copies == 0), "key": pa.array(key, pa.binary())})


def copy_groups(df: DataFrame, record: str, fields: list[str], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(first_index, row_index, copies): every record with filled fields and the smallest record of its copies; on the row of the latter, and there only, their number.

    Records are partitioned by the first bytes of their canonical fields; a bucket of more than ``bucket_bytes`` is split by
    further bytes, twice as many at each level, until every bucket fits or holds one text alone. The sizes of a level
    are one map-side combined aggregation over the records still open, the oversized prefixes a table that Spark joins by its
    own size check. Buckets that fit are put on shelves of about ``bucket_bytes``, each counted by a trie whose terminals are
    counters. A single text larger than a bucket, with all its copies, is spread by record over many shelves; the
    counters of its tries are then added up, so no task gets more than a shelf.

    Defined cases: a row with a null or blank field, or a null record, is left out; fields without any letter or
    digit count as empty and equal; a record given twice counts once for each row; no rows give no rows. Texts are
    read whole.
    """
    size = F.octet_length("canon") + 64
    rows = materialize(keyed(df, record, fields).select("record", "canon", F.substring("canon", 1, HEAD_BYTES).alias("head"), size.alias("size")), "canon")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shelves = max(1, -(-total // bucket_bytes))
    prefix = lambda depth: F.substring("head" if depth <= HEAD_BYTES else "canon", 1, depth)
    open_, depth, levels = rows, FIRST_BYTES, []
    while True:
        sizes = open_.groupBy(prefix(depth).alias("prefix")).agg(F.sum("size").alias("bytes"))
        over = materialize(sizes.where(F.col("bytes") > bucket_bytes).select("prefix"), "oversized")
        whole, n = over.agg(F.count_if(F.octet_length("prefix") < depth), F.count("*")).first()
        if n:
            levels.append((depth, over))
        if whole == n:  # none left, or single texts only: a prefix shorter than the depth is all of its text
            break
        open_ = open_.join(over, prefix(depth) == F.col("prefix"), "left_semi")
        depth *= 2
    at: DataFrame = rows
    bucket: Column = F.struct(F.lit(depth).alias("depth"), prefix(depth).alias("prefix"))
    hot: Column = F.lit(False)
    for d, over in levels:
        at = at.join(over.select(F.col("prefix").alias(f"over_{d}")), prefix(d) == F.col(f"over_{d}"), "left")
        hot = hot | (F.octet_length(f"over_{d}") < d)
    for d, _ in reversed(levels):
        bucket = F.when(F.col(f"over_{d}").isNull(), F.struct(F.lit(d).alias("depth"), prefix(d).alias("prefix"))).otherwise(bucket)
    hot = F.coalesce(hot, F.lit(False)) if levels else hot
    shelf = F.pmod(F.when(hot, F.xxhash64("record", F.lit(1))).otherwise(F.xxhash64(bucket)), F.lit(shelves))
    shelved = at.select("record", "canon", hot.alias("hot"), shelf.alias("shelf"))
    parts = max(1, min(shelves, 4 * df.sparkSession.sparkContext.defaultParallelism))
    counted = shelved.repartition(parts, "hot", "shelf").groupBy("hot", "shelf").applyInArrow(count_bucket, "first_index bigint, row_index bigint, copies bigint, key binary")
    if not levels:
        return counted.drop("key")
    counted = materialize(counted, "counted")
    for _, over in levels:
        discard(over)
    discard(rows)
    spread = counted.where("key IS NOT NULL")
    sums = spread.where("copies IS NOT NULL").groupBy("key").agg(F.min("first_index").alias("least"), F.sum("copies").alias("sum"))
    merged = spread.join(sums, "key").select(F.col("least").alias("first_index"), "row_index", F.when((F.col("row_index") == F.col("least")) & F.col("copies").isNotNull(), F.col("sum")).alias("copies"))
    return counted.where("key IS NULL").drop("key").unionByName(merged)
