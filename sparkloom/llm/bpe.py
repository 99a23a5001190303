"""Byte-level BPE encoding and decoding by a local rank file, with tiktoken.

Rules of the edge cases: a null text encodes as the empty text (no ids); a null id
list decodes to empty bytes; ids unknown to the rank file raise an error. Rows are
independent, so ties and repeated rows need no rule; an empty table gives an empty
result. Extra columns pass through, and an output name that is already taken by an
input column is refused with ValueError instead of shadowing it.

Very long texts are cut before encoding at places where the splitting pattern
always ends a match: after a non-space and before a space, after a letter before a
non-letter, after a digit before a non-digit. A white-space run too long for the
regex engine is taken out by hand, as the pattern would match it: all of the run
but its last character, or all of it at the end of the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import released, ship, slices

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
LIMIT = 16_384  # characters given to the regex at once
RUN = 2_048  # white-space runs from this length on are matched by hand

_SPACE = r"\t-\r \x85\xa0  -     　"  # Unicode White_Space


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _patterns():
    import regex

    return (
        regex.compile(rf"[{_SPACE}]{{{RUN},}}"),
        regex.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])"),
        regex.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})"),
    )


def safe_cuts(text: str, limit: int = LIMIT) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut at safe boundaries only."""
    _, gap, any_edge = _patterns()
    at = 0
    while len(text) - at > limit:
        near = None
        for m in gap.finditer(text, at + limit // 2, at + limit):
            near = m.start()
        if near is None:
            found = any_edge.search(text, at + limit // 2)
            near = found.start() if found else len(text)
        yield text[at:near]
        at = near
    if at < len(text):
        yield text[at:]


def encode_text(enc, text: str, limit: int = LIMIT) -> list[int]:
    """The ids of the whole ``text``; equal to one ``encode_ordinary`` call."""
    if len(text) <= RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in _patterns()[0].finditer(text):
        for part in safe_cuts(text[at : m.start()], limit):
            ids += enc.encode_ordinary(part)
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc._encode_single_piece(text[m.start() : end].encode())
        at = end
    for part in safe_cuts(text[at:] if at else text, limit):
        ids += enc.encode_ordinary(part)
    return ids


def rank_path(name: str = DEFAULT_RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"output columns already exist: {sorted(taken)}")


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` with the column ``ids`` (array<int>) of the encoded whole texts."""
    _free(df, ids)
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path(ranks), split_pattern())
        for big in batches:
            for b in slices(big, text):
                got = [encode_text(enc, t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                yield b.append_column(ids, pa.array(got, pa.list_(pa.int32())))

    return df.mapInArrow(released(run), schema)


def count_tokens(df: DataFrame, text: str = "text", count: str = "n_tokens", keep: tuple[str, ...] = (), ranks: str = DEFAULT_RANKS) -> DataFrame:
    """The columns ``keep`` and the encoded length of each whole text."""
    ship(df.sparkSession)
    src = df.select(*keep, text)
    schema = T.StructType([*(src.schema[c] for c in keep), T.StructField(count, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path(ranks), split_pattern())
        for big in batches:
            for b in slices(big, text):
                got = [len(encode_text(enc, t or "")) for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(got, pa.int64())], [*keep, count])

    return src.mapInArrow(released(run), schema)


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` with the column ``out`` (binary): the raw bytes that the ids stand for."""
    _free(df, out)
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path(ranks), split_pattern())
        for b in batches:
            got = [enc.decode_bytes(x) if x else b"" for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield b.append_column(out, pa.array(got, pa.binary()))

    return df.mapInArrow(released(run), schema)


def round_trip(df: DataFrame, text: str = "text", ids: str = "token_ids", out: str = "decoded", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` without ``text``, with the ids of each text and the bytes they decode to.

    One pass over Arrow batches: both directions run in the same Python call, so the
    ids cross to the JVM once.
    """
    _free(df, ids, out)
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != text]
    src = df.select(*kept, text)
    schema = T.StructType([*(src.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path(ranks), split_pattern())
        for big in batches:
            for b in slices(big, text):
                got = [encode_text(enc, t or "") for t in b.column(len(kept)).to_pylist()]
                raw = [enc.decode_bytes(x) for x in got]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(got, pa.list_(pa.int32())), pa.array(raw, pa.binary())], [*kept, ids, out])

    return src.mapInArrow(released(run), schema)
