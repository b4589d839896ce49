"""Problem 6: token ids of whole texts by a public byte-level BPE vocabulary."""

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART_CHARS = 1 << 16
#: White space of the tokenizer's pattern; runs longer than LONG_RUN overflow the stack of its regex engine.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LONG_RUN = 1 << 15
_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def parts(text: str, chars: int = PART_CHARS) -> Iterator[str]:
    """Cuts of a long text that no token crosses: in front of a blank or newline that follows a visible character."""
    at = 0
    while len(text) - at > chars:
        cut = _CUT.search(text, at + chars)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, ranks: str = RANKS) -> list[int]:
    """Ids of ``text`` without special tokens; null and empty texts have none."""
    if not text:
        return []
    enc = encoding(ranks)
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in _RUN.finditer(text):
        # the run up to its last character is one piece; the last one belongs to what follows, if anything does
        end = run.end() if run.end() == len(text) else run.end() - 1
        for part in parts(text[at : run.start()]):
            out += enc.encode_ordinary(part)
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    for part in parts(text[at:]):
        out += enc.encode_ordinary(part)
    return out


def _each(df: DataFrame, columns: list[str], text: str, schema: str, run) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [*columns, *run(b.column(len(columns)).slice(0, 0).to_pylist())]
            step = 512
            for lo in range(0, len(b), step):
                part = b.slice(lo, step)
                new = run(part.column(len(columns)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new.values()], names)

    return df.select(*columns, F.col(text).cast("string").alias("__text")).mapInArrow(go, schema)


def token_ids(df: DataFrame, record: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(record, ids): the ids of each text, one row per row of ``df``, in a single pass without a shuffle.

    Strings that look like special tokens are ordinary text. Defined cases: null and empty texts give the empty list;
    white space is encoded like any text; repeated rows stay; a null record keeps its row; texts are encoded
    whole, a long one part by part between cuts that no token crosses.
    """
    return _each(df, [record], text, f"{record} bigint, ids array<int>", lambda ts: {"ids": pa.array([encode(t, ranks) for t in ts], pa.list_(pa.int32()))})


def token_counts(df: DataFrame, record: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(record, n_tokens)."""
    return _each(df, [record], text, f"{record} bigint, n_tokens bigint", lambda ts: {"n_tokens": pa.array([len(encode(t, ranks)) for t in ts], pa.int64())})


def round_trip(df: DataFrame, record: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(record, n_tokens, same): whether the raw bytes of the ids, joined, are the bytes of the text."""

    def run(ts: list) -> dict:
        ids = [encode(t, ranks) for t in ts]
        same = [encoding(ranks).decode_bytes(i) == (t or "").encode() for i, t in zip(ids, ts)]
        return {"n_tokens": pa.array(map(len, ids), pa.int64()), "same": pa.array(same, pa.bool_())}

    return _each(df, [record], text, f"{record} bigint, n_tokens bigint, same boolean", run)
