"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import named, with_fields
from quern.llm.hashing import slices, text_bytes

#: The end of a run of letters, digits or marks: the pre-tokeniser's match ends there, and what matches from there on doesn't
#: depend on what stands before it. Not between a mark and a letter, where 's and the like begin. A text without such
#: a place is one match, whose byte pairs may merge over all of it, or white space, and is never cut.
SAFE = regex.compile(r"(?<=\p{L})(?=[ \n\t\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[ \n\t\p{L}\p{P}\p{S}])|(?<=[\p{P}\p{S}])(?=[ \n\t\p{N}])")
CHUNK = 1 << 16
#: Text that becomes Python strings at once.
SLICE_BYTES = 8 << 20


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; built once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("quern", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``chunk`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > chunk:
        found = SAFE.search(text, start + chunk)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def encode_text(text: str, coder, chunk: int = CHUNK) -> list[int]:
    if len(text) <= chunk:
        return coder.encode_ordinary(text)
    return [i for part in pieces(text, chunk) for i in coder.encode_ordinary(part)]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", chunk: int = CHUNK) -> DataFrame:
    """Add ``ids`` (array of int): the whole text's tokens. Null counts as the empty text, with no tokens.

    Works row by row, so repeated rows, ties and empty tables need no care; a column already named
    ``ids`` is replaced. Texts over ``chunk`` characters are cut at safe boundaries first.
    """
    kept = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for whole in batches:
            for low, high in slices(np.diff(text_bytes(whole.column(kept.index(text)))[1]), SLICE_BYTES, 512):
                batch = whole.slice(low, high - low)
                texts = batch.column(kept.index(text)).to_pylist()
                out = pa.array([encode_text(t or "", coder, chunk) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*kept, ids])

    rows = docs.select(*named(kept))
    return rows.mapInArrow(run, with_fields(rows, **{ids: "array<int>"}))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """Add ``data`` (binary): the bytes of the tokens. Null ids give null; an unknown id is an error."""
    kept = [c for c in docs.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            rows = batch.column(kept.index(ids)).to_pylist()
            out = pa.array([None if r is None else coder.decode_bytes(r) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*kept, data])

    rows = docs.select(*named(kept))
    return rows.mapInArrow(run, with_fields(rows, **{data: "binary"}))


def digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Encode, decode and hash in one pass, so that neither ids nor bytes leave the worker.

    Returns key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and
    round_trip (whether the decoded bytes are the text). Null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        names = [str(i).encode() for i in range(coder.max_token_value + 1)]
        for batch in (whole.slice(low, high - low) for whole in batches for low, high in slices(np.diff(text_bytes(whole.column(1))[1]), SLICE_BYTES)):
            counts, ids_sha, bytes_sha, same = [], [], [], []
            for t in batch.column(1).to_pylist():
                ids = encode_text(t or "", coder, chunk)
                raw = coder.decode_bytes(ids)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(b",".join([names[i] for i in ids])).hexdigest())
                bytes_sha.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == (t or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string()), pa.array(same, pa.bool_())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
