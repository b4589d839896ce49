"""All pairs of records of high TF-IDF cosine, by an exact prefix filter over packed lists of terms."""

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import STOP_WORDS, WORD
from ..scratch import discard, materialize, materialize_alone

#: The terms of most records, as many as 16 bits can tell; all others are told by hash and frequency.
TOP = 1 << 16
#: Occurrences of terms that are counted at once, packed bytes of a bucket, records of a term that meet in one block, pairs that are measured at once.
CHUNK_TERMS, BUCKET_BYTES, BLOCK_ROWS, MEASURED = 1 << 21, 6 << 20, 1 << 15, 20_000
#: Rows of a result that are sent at once, ends of pairs that are held until only the nearest of each record stay.
SENT, HELD = 10_000, 1 << 20
#: Dimensions of a record's outline, of which so many belong to one term each; groups of more rows are multiplied as matrices, so many rows at once.
DIMS, OWN, SMALL, SIDE = 512, 256, 32, 512
EPS = 1e-5
DOC = np.dtype([("id", "<i8"), ("norm", "<f8"), ("terms", "<u4"), ("rest", "<u4")])
REST = np.dtype([("term", "<i8"), ("df", "<u4")])
BIG = np.dtype([("at", "<u4"), ("tf", "<u4")])


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``CHUNK_TERMS`` terms, at least one row each."""
    part = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // CHUNK_TERMS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)] if len(batch) else []
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def _small(raw: bytes) -> bytes:
    """Compressed, behind its size."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _size(blob: bytes) -> int:
    return int.from_bytes(blob[:8], "little")


def _whole(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], decompressed_size=_size(blob), codec="zstd", asbytes=True)


def _stored(column: pa.Array) -> bytes:
    return _small(pa.RecordBatch.from_arrays([column], ["carried"]).serialize().to_pybytes())


def _restored(blob: bytes, kind: pa.DataType) -> pa.Array:
    return pa.ipc.read_record_batch(pa.py_buffer(_whole(blob)), pa.schema([("carried", kind)])).column(0)


def _counted(docs: DataFrame, carries: pa.DataType | None) -> DataFrame:
    """(chunk, term, n, blob, carried): of each chunk of records a row for each 64-bit term with the number of its records, and one row with the counts of all records.

    Function words are dropped here, where each word is looked up once a batch. carries: the type of what the records carry along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, stop = TaskContext.get().partitionId() << 32, set(STOP_WORDS)
        for whole in batches:
            for b in _runs(whole):
                ids, lists = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
                doc = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                seen = lists.flatten().dictionary_encode()
                names, at = seen.dictionary.to_pylist(), seen.indices.to_numpy(zero_copy_only=False)
                telling = np.fromiter((w not in stop for w in names), bool, len(names))
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64).view(np.int64)
                term, place = np.unique(hashes[telling], return_inverse=True)
                m, number = len(term), np.zeros(len(names), np.int64)
                number[telling] = place
                doc, at = doc[telling[at]], number[at[telling[at]]]
                both, tf = np.unique(doc * max(m, 1) + at, return_counts=True)
                doc, at = both // max(m, 1), both % max(m, 1)
                kind = "<u2" if m <= 1 << 16 else "<u4"
                big = np.flatnonzero(tf > 255)
                blob = np.array([len(ids), len(both), len(big), m], "<i8").tobytes() + ids.tobytes() + np.bincount(doc, minlength=len(ids)).astype("<u4").tobytes() + at.astype(kind).tobytes() + np.minimum(tf, 255).astype("u1").tobytes() + _big(big, tf).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * (m + 1), pa.int64()), pa.array([*term.tolist(), None], pa.int64()), pa.array([*np.bincount(at, minlength=m).tolist(), None], pa.int64()), pa.array([None] * m + [blob], pa.binary()), pa.array([None] * m + [carries and _stored(b.column(2).cast(carries))], pa.binary())],
                    ["chunk", "term", "n", "blob", "carried"],
                )
                chunk += 1

    return docs.mapInArrow(run, "chunk bigint, term bigint, n bigint, blob binary, carried binary")


def _big(at: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """The counts that a byte cannot hold."""
    out = np.zeros(len(at), BIG)
    out["at"], out["tf"] = at, tf[at]
    return out


def _uncounted(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k, many, m = np.frombuffer(blob, "<i8", 4).tolist()
    o, out = 32, []
    for kind, size in (("<i8", n), ("<u4", n), ("<u2" if m <= 1 << 16 else "<u4", k), ("u1", k), (BIG, many)):
        out.append(np.frombuffer(blob, kind, size, o))
        o += size * np.dtype(kind).itemsize
    tf = out[3].astype(np.int64)
    tf[out[4]["at"]] = out[4]["tf"]
    return out[0], np.repeat(np.arange(n), out[1]), out[2].astype(np.int64), tf


class Terms:
    """Records as flat arrays of their terms in order of rising frequency: ``doc`` (position), ``term``, ``df`` and ``tf``; of each record ``ids`` and ``norm``."""

    def __init__(self, ids: np.ndarray, norm: np.ndarray, doc: np.ndarray, term: np.ndarray, df: np.ndarray, tf: np.ndarray) -> None:
        self.ids, self.norm, self.doc, self.term, self.df, self.tf = ids, norm, doc, term, df, tf
        self.code: np.ndarray | None = None
        self.n = np.bincount(doc, minlength=len(ids))
        self.first = np.cumsum(self.n) - self.n


class Coder:
    """Packs records: terms of ``TOP`` as positions in that list, most frequent first; weights follow from the counts."""

    def __init__(self, top: np.ndarray, df: np.ndarray, documents: int, t: float) -> None:
        """``top``, ``df``: the terms of most records and their numbers of records, by falling frequency, then falling term."""
        self.top, self.df, self.documents, self.t = top, df, documents, t
        self.order = np.argsort(top)
        self.sorted = top[self.order]

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log((1.0 + self.documents) / (1.0 + df)) + 1.0

    def code(self, term: np.ndarray) -> np.ndarray:
        """The position in the list of each term, -1 if it is not there."""
        if not len(self.top):
            return np.full(len(term), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, term), len(self.sorted) - 1)
        return np.where(self.sorted[at] == term, self.order[at], -1)

    def pack(self, x: Terms, docs: np.ndarray) -> bytes:
        """``docs``: rising positions of the records that are packed."""
        mine = np.repeat(x.first[docs], x.n[docs]) + np.arange(x.n[docs].sum()) - np.repeat(np.cumsum(x.n[docs]) - x.n[docs], x.n[docs])
        code, tf = self.code(x.term[mine]), x.tf[mine]
        head = np.zeros(len(docs), DOC)
        head["id"], head["norm"], head["terms"] = x.ids[docs], x.norm[docs], x.n[docs]
        head["rest"] = np.bincount(np.repeat(np.arange(len(docs)), x.n[docs])[code < 0], minlength=len(docs))
        rest = np.zeros(int((code < 0).sum()), REST)
        rest["term"], rest["df"] = x.term[mine][code < 0], x.df[mine][code < 0]
        big = np.flatnonzero(tf > 255)
        planes = code[code >= 0].astype("<u2").view("u1").reshape(-1, 2).T
        return _small(np.array([len(docs), len(mine), len(rest), len(big)], "<u4").tobytes() + head.tobytes() + rest.tobytes() + planes.tobytes() + np.minimum(tf, 255).astype("u1").tobytes() + _big(big, tf).tobytes())

    def unpack(self, blobs: list[bytes]) -> Terms:
        heads, terms, dfs, tfs = [np.zeros(0, DOC)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        codes = [np.zeros(0, np.int64)]
        for b in map(_whole, blobs):
            n, k, r, many = np.frombuffer(b, "<u4", 4).tolist()
            o, got = 16, []
            for kind, size in ((DOC, n), (REST, r), ("u1", 2 * (k - r)), ("u1", k), (BIG, many)):
                got.append(np.frombuffer(b, kind, size, o))
                o += size * np.dtype(kind).itemsize
            head, rest, planes, tf = got[0], got[1], got[2].astype(np.int64).reshape(2, -1), got[3].astype(np.int64)
            code = planes[0] + (planes[1] << 8)
            tf[got[4]["at"]] = got[4]["tf"]
            size, few = head["terms"].astype(np.int64), head["rest"].astype(np.int64)
            is_rest = np.arange(k) - np.repeat(np.cumsum(size) - size, size) < np.repeat(few, size)
            term, df = np.zeros(k, np.int64), np.zeros(k, np.int64)
            term[is_rest], df[is_rest] = rest["term"], rest["df"]
            term[~is_rest], df[~is_rest] = self.top[code], self.df[code]
            codes.append(np.full(k, -1, np.int64))
            codes[-1][~is_rest] = code
            heads.append(head)
            terms.append(term)
            dfs.append(df)
            tfs.append(tf)
        head = np.concatenate(heads)
        x = Terms(head["id"].astype(np.int64), head["norm"].astype(float), np.repeat(np.arange(len(head)), head["terms"]), np.concatenate(terms), np.concatenate(dfs), np.concatenate(tfs))
        x.code = np.concatenate(codes)
        return x

    def weights(self, x: Terms) -> np.ndarray:
        return x.tf * self.idf(x.df) / x.norm[x.doc]

    def behind(self, x: Terms, w: np.ndarray) -> np.ndarray:
        """The length of the record from each of its terms on."""
        square = (w * w)[::-1]
        total = np.cumsum(square)[::-1]
        last = x.first + x.n
        after = np.append(total, 0.0)[last]
        return np.sqrt(np.maximum(total - after[x.doc], 0.0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weighed(counted: DataFrame, frequency: DataFrame, coder: Coder, most: float, carries: pa.DataType | None) -> DataFrame:
    """(blob, bytes, carried, rows, docs, code, n): the packed records of a chunk, with the rows of their prefixes; of each common term the number of its rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blob, carried = next((b, c) for b, c in zip(table.column("blob").to_pylist(), table.column("carried").to_pylist()) if b is not None)
        known = table.filter(pc.is_valid(table.column("term")))
        term, df = known.column("term").to_numpy(), known.column("df").to_numpy()
        order = np.argsort(term)
        term, df = term[order], df[order]
        ids, doc, at, tf = _uncounted(blob)
        use = df[at] <= most
        doc, at, tf = doc[use], at[use], tf[use]
        # in one order of the terms, so that records of the same counts get the same weights to the last bit
        order = np.lexsort((term[at], df[at], doc))
        doc, at, tf = doc[order], at[order], tf[order]
        w = tf * coder.idf(df[at])
        norm = np.sqrt(np.bincount(doc, w * w, minlength=len(ids)))
        # a term of one record adds to its length alone
        shared = df[at] > 1
        x = Terms(ids, np.where(norm > 0, norm, 1.0), doc[shared], term[at[shared]], df[at[shared]], tf[shared])
        rows = np.flatnonzero(coder.behind(x, coder.weights(x)) >= coder.t - EPS)
        docs = np.unique(x.doc[rows])
        packed = coder.pack(x, docs)
        code, n = np.unique(coder.code(x.term[rows]), return_counts=True)
        m = len(code)
        carried = carries and _stored(_restored(carried, carries).take(pa.array(docs)))
        return pa.table({"blob": pa.array([packed] + [None] * m, pa.binary()), "bytes": pa.array([_size(packed)] + [None] * m, pa.int64()), "carried": pa.array([carried] + [None] * m, pa.binary()), "rows": pa.array([len(rows)] + [None] * m, pa.int64()), "docs": pa.array([len(docs)] + [None] * m, pa.int64()), "code": pa.array([None, *code.tolist()], pa.int64()), "n": pa.array([None, *n.tolist()], pa.int64())})

    terms = counted.where("term IS NOT NULL").select("chunk", "term").join(frequency, "term").select("chunk", "term", "df", F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("binary").alias("carried"))
    blobs = counted.where("blob IS NOT NULL").select("chunk", F.lit(None).cast("bigint").alias("term"), F.lit(None).cast("bigint").alias("df"), "blob", "carried")
    return terms.unionByName(blobs).groupBy("chunk").applyInArrow(run, "blob binary, bytes bigint, carried binary, rows bigint, docs bigint, code bigint, n bigint")


class Meeting:
    """Rows of records in buckets: a record has one for each term of its prefix, for a term of very many rows one for each pair of blocks."""

    def __init__(self, coder: Coder, blocks: np.ndarray, buckets: int) -> None:
        """``blocks``: into how many blocks the rows of each of the terms of most records are cut."""
        self.coder, self.blocks, self.buckets = coder, blocks, buckets

    def rows(self, x: Terms, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position among the terms, key and bucket of each row."""
        at = np.flatnonzero(behind >= self.coder.t - EPS)
        key, code = _mix(x.term[at].view(np.uint64)), self.coder.code(x.term[at])
        parts = np.where(code >= 0, self.blocks[code], 1) if len(self.blocks) else np.ones(len(at), np.int64)
        ats, keys = [at[parts == 1]], [key[parts == 1]]
        for m in np.unique(parts[parts > 1]).tolist():
            hot = np.flatnonzero(parts == m)
            mine = (_mix(x.ids[x.doc[at[hot]]].view(np.uint64) + np.uint64(77)) % np.uint64(m)).astype(np.int64)
            for other in range(m):
                block = np.minimum(mine, other) * m + np.maximum(mine, other) + 1
                ats.append(at[hot])
                keys.append(_mix(key[hot] + _mix(block.astype(np.uint64))))
        at, key = np.concatenate(ats), np.concatenate(keys)
        return at, key, ((key >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def spread(self, blob: bytes) -> tuple[list[int], list[bytes], list[np.ndarray]]:
        """Buckets, what is sent to each, and the positions of its records."""
        x = self.coder.unpack([blob])
        at, _, to = self.rows(x, self.coder.behind(x, self.coder.weights(x)))
        both = np.unique(to * max(len(x.ids), 1) + x.doc[at])
        to, doc = both // max(len(x.ids), 1), both % max(len(x.ids), 1)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(to) > 0])) if len(to) else np.zeros(0, np.int64)
        parts = np.split(doc, cuts[1:]) if len(cuts) else []
        return to[cuts].tolist(), [self.coder.pack(x, d) for d in parts], parts

    def pairs(self, bucket: int, x: Terms) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Two positions and the cosine of the pairs that reach the threshold and whose first common term is in this bucket, bit by bit."""
        t = self.coder.t
        w = self.coder.weights(x)
        behind = self.coder.behind(x, w)
        at, key, to = self.rows(x, behind)
        at, key = at[to == bucket], key[to == bucket]
        order = np.lexsort((-behind[at], key))
        at, key = at[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(key)))
        doc, mine = x.doc[at], w[at].astype(np.float32)
        rest = np.sqrt(np.maximum(behind[at] ** 2 - w[at] ** 2, 0.0)).astype(np.float32)
        # the list is in falling order of frequency and term, and all other terms come before it in rising order
        other = np.flatnonzero(x.code < 0)
        terms, first, place = np.unique(x.term[other], return_index=True, return_inverse=True)
        order = np.empty(len(terms), np.int64)
        order[np.lexsort((terms, x.df[other[first]]))] = np.arange(len(terms))
        rank, many = len(terms) + len(self.coder.top) - 1 - x.code, len(terms) + len(self.coder.top) + 1
        rank[other] = order[place]
        index = x.doc * many + rank
        cell = np.where((x.code >= 0) & (x.code < OWN), x.code, OWN + (_mix(x.term.view(np.uint64)) % np.uint64(DIMS - OWN)).astype(np.int64))
        # of the terms that fall together the length: by Cauchy and Schwarz the product of two outlines is the cosine at least
        outline = np.zeros((len(x.ids), DIMS), np.float32)
        for lo in range(0, len(x.ids), 4096):
            hi = min(len(x.ids), lo + 4096)
            a, b = x.first[lo], x.first[hi - 1] + x.n[hi - 1]
            outline[lo:hi] = np.sqrt(np.bincount((x.doc[a:b] - lo) * DIMS + cell[a:b], w[a:b] ** 2, minlength=(hi - lo) * DIMS)).reshape(-1, DIMS)

        def measure(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for lo in range(0, len(i), MEASURED):
                a, b, first = doc[i[lo : lo + MEASURED]], doc[j[lo : lo + MEASURED]], rank[at[i[lo : lo + MEASURED]]]
                n = x.n[b]
                pair = np.repeat(np.arange(len(a)), n)
                of = np.repeat(x.first[b] - (np.cumsum(n) - n), n) + np.arange(len(pair))
                ask = a[pair] * many + rank[of]
                got = np.minimum(np.searchsorted(index, ask), len(index) - 1)
                hit = index[got] == ask
                pair, of, got = pair[hit], of[hit], got[hit]
                cosine = np.bincount(pair, w[of] * w[got], minlength=len(a))
                _, one = np.unique(pair, return_index=True)  # each pair shares the term of its key, so has a first one
                keep = (cosine >= t - 1e-12) & (rank[of[one]] == first)
                yield a[keep], b[keep], cosine[keep]

        def close(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for lo in range(0, len(i), MEASURED):
                p, q = i[lo : lo + MEASURED], j[lo : lo + MEASURED]
                ok = np.einsum("ij,ij->i", outline[doc[p]], outline[doc[q]]) >= t - EPS
                yield from measure(p[ok], q[ok])

        left = np.repeat(starts + size, size) - np.arange(len(key)) - 1  # rows of the same key after this one
        i = np.flatnonzero(np.repeat(size <= SMALL, size))
        for step in range(1, SMALL):
            i = i[left[i] >= step]
            if not len(i):
                break
            j = i + step
            ok = mine[i] * mine[j] + rest[i] * rest[j] >= t - EPS
            yield from close(i[ok], j[ok])
        for lo, m in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
            for a in range(lo, lo + m, SIDE):
                b = min(a + SIDE, lo + m)
                for c in range(a, lo + m, 8 * SIDE):
                    d = min(c + 8 * SIDE, lo + m)
                    # lengths fall within a key: no later row can meet the first of these
                    if behind[at[a]] * behind[at[c]] < t - EPS:
                        break
                    d = c + int(np.searchsorted(-behind[at[c:d]], -(t - EPS) / behind[at[a]], "right"))
                    bound = mine[a:b, None] * mine[None, c:d] + rest[a:b, None] * rest[None, c:d] >= t - EPS
                    bound &= outline[doc[a:b]] @ outline[doc[c:d]].T >= t - EPS
                    i, j = np.nonzero(bound)
                    i, j = i + a, j + c
                    yield from measure(i[i < j], j[i < j])


def nine_places(s: np.ndarray) -> np.ndarray:
    """``s`` in units of 1e-9, halves away from zero, to the last digit as Spark rounds the number that is written."""
    near = s * 1e9
    out = np.floor(near + 0.5).astype(np.int64)
    for k in np.flatnonzero(np.abs(near - np.floor(near) - 0.5) < 1e-4).tolist():
        out[k] = int(Decimal(repr(float(s[k]))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return out


def nearest(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, id of another, cosine): the ``k`` nearest of each record among these pairs; ties (to 9 places) go to the smaller id. All pairs are never held at once."""
    ends, n, least = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0, HELD

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, s = map(np.concatenate, zip(*ends))
        order = np.lexsort((j, -nine_places(s), i))
        i, j, s = i[order], j[order], s[order]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        near = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < k
        return i[near], j[near], s[near]

    for a, b, cosine in found:
        ends += [(ids[a], ids[b], cosine), (ids[b], ids[a], cosine)]
        n += 2 * len(a)
        if n > least:
            ends = [cut()]
            n, least = len(ends[0][0]), max(HELD, 2 * len(ends[0][0]))
    return cut()


def enriched(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, carried: pa.Array, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of both ids and, for each row of either record, its columns, as they are found."""
    n, rows = pc.list_value_length(carried).to_numpy(zero_copy_only=False).astype(np.int64), carried.flatten()
    first = np.cumsum(n) - n
    parts = dict(zip(columns, rows.flatten()))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def send() -> Iterator[pa.RecordBatch]:
        a, b = map(np.concatenate, zip(*held))
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        upto = np.cumsum(n[a] * n[b])
        for lo in range(0, int(upto[-1]) if len(upto) else 0, SENT):
            row = np.arange(lo, min(lo + SENT, int(upto[-1])))
            pair = np.searchsorted(upto, row, "right")
            nth = row - (upto[pair] - n[a[pair]] * n[b[pair]])
            sides = (first[a[pair]] + nth // n[b[pair]], first[b[pair]] + nth % n[b[pair]])
            at = [pa.array(s) for s in sides]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[pair]]), pa.array(ids[b[pair]]), *(parts[c].take(s) for s in at for c in columns)], ["id_1", "id_2", *(f"{c}_{k}" for k in (1, 2) for c in columns)])
        held.clear()

    for a, b, _ in found:
        held.append((a, b))
        if sum(len(p) for p, _ in held) >= SENT:
            yield from send()
    if held:
        yield from send()


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links that connect all that the links connect, without a circle."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.setdefault(v, v)) != v:
            root[v] = root[up]
            v = up
        return v

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def cosine_pairs(df: DataFrame, record: str, text: str, threshold: float, max_df: float, links: bool = False, near: int = 0, columns: list[str] | None = None) -> DataFrame:
    """(id_1, id_2, similarity), each pair once; with ``links`` only pairs enough to connect whatever the pairs connect.

    With ``near`` (id_1, id_2, similarity) of pairs in either direction: at least the ``near`` nearest of each record, and as many
    from each bucket at most. With ``columns`` (id_1, id_2, columns of both) for each row of either record: they go along with the records to the
    buckets, where the rows of the result are made as the pairs are found; no pair is written or joined.

    The records of a batch are counted into one packed row; only the distinct terms of a batch are joined with their
    numbers of records, which come back to the batch. Terms are told by 64-bit hashes. A record is then packed in two bytes for each of the
    ``TOP`` terms of most records and twelve for others, and sent to the buckets of the terms of its prefix, once to each bucket.
    """
    if dict(df.dtypes)[record] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{record} must be a whole number")
    documents = df.count()
    carries = pa.list_(pa.struct([(c, to_arrow_type(df.schema[c].dataType)) for c in columns])) if columns else None
    carry = [F.struct(*[F.col(c) for c in columns]).alias("carried")] if columns else []
    docs = df.where(F.col(record).isNotNull()).select(F.col(record).cast("bigint").alias("id"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)).alias("w"), *carry)
    if df.groupBy(record).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        docs = docs.groupBy("id").agg(F.flatten(F.collect_list("w")).alias("w"), *(F.collect_list("carried").alias("carried") for _ in carry))
    else:
        docs = docs.where("w IS NOT NULL").select("id", "w", *(F.array("carried").alias("carried") for _ in carry))
    counted = materialize(_counted(docs, carries), "counted")
    frequency = materialize(counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")), "frequency")
    top = frequency.where((F.col("df") > 1) & (F.col("df") <= max_df * documents)).orderBy(F.desc("df"), F.desc("term")).limit(TOP).toArrow()
    coder = Coder(top.column("term").to_numpy(), top.column("df").to_numpy(), documents, threshold)
    weighed = materialize_alone(_weighed(counted, frequency, coder, max_df * documents, carries), "weighed")
    discard(counted)
    discard(frequency)
    total = weighed.where("blob IS NOT NULL").agg(F.sum(F.col("rows") * F.col("bytes") / F.greatest("docs", F.lit(1)))).first()[0] or 0
    blocks = np.ones(len(coder.top), np.int64)
    for r in weighed.where("code >= 0").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK_ROWS).collect():
        blocks[r.code] = -(-r.n // BLOCK_ROWS)
    buckets = max(df.sparkSession.sparkContext.defaultParallelism, int(-(-total // BUCKET_BYTES)))
    meeting = Meeting(coder, blocks, buckets)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, carried in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                to, packed, docs = meeting.spread(blob)
                every = carries and _restored(carried, carries)
                along = [carries and _stored(every.take(pa.array(d))) for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(packed, pa.binary()), pa.array(along, pa.binary())], ["bucket", "packed", "carried"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        x = meeting.coder.unpack(table.column("packed").to_pylist())
        found = meeting.pairs(key[0].as_py(), x)
        if near:
            i, j, cosine = nearest(found, x.ids, near)
            return pa.table({"id_1": pa.array(i), "id_2": pa.array(j), "similarity": pa.array(cosine, pa.float64())})
        a, b, cosine = map(np.concatenate, zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *found))
        a, b = x.ids[a], x.ids[b]
        if links:
            k = forest(a, b)
            a, b, cosine = a[k], b[k], cosine[k]
        return pa.table({"id_1": pa.array(np.minimum(a, b)), "id_2": pa.array(np.maximum(a, b)), "similarity": pa.array(cosine, pa.float64())})

    def enrich(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for bucket, packed, carried in zip(*(c.to_pylist() for c in batch.columns)):
                got.setdefault(bucket, []).append((packed, carried))
        while got:
            bucket, blobs = got.popitem()
            x = meeting.coder.unpack([packed for packed, _ in blobs])
            carried = pa.concat_arrays([_restored(c, carries) for _, c in blobs])
            yield from enriched(meeting.pairs(bucket, x), x.ids, carried, columns)

    sent = weighed.where("blob IS NOT NULL").select("blob", "carried").mapInArrow(spread, "bucket int, packed binary, carried binary").repartitionById(buckets, F.col("bucket"))
    if columns:
        whole = [StructField(f"id_{k}", LongType()) for k in (1, 2)] + [StructField(f"{c}_{k}", df.schema[c].dataType) for k in (1, 2) for c in columns]
        pairs = sent.mapInArrow(enrich, StructType(whole))
    else:
        pairs = materialize_alone(sent.groupBy("bucket").applyInArrow(meet, "id_1 bigint, id_2 bigint, similarity double"), "pairs")
        discard(weighed)
    return pairs.withColumns({c: F.col(c).cast(df.schema[record].dataType) for c in ("id_1", "id_2")})
