"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split beforehand at safe boundaries: between a letter or digit and a
following space or line feed no match of the pattern can reach over, so the ids of the
parts, one after the other, are the ids of the text, and no single call grows with the
text. A text without such a place stays whole, but for long runs of white space: there the
pattern takes all but the last character of a run in one match (all of it at the end of the
text), so that match is encoded by itself and the rest goes on from the last character. Decoding joins the raw bytes of the ids,
so ids that cut a character in two decode as well.

Null texts count as empty: no ids, no bytes. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tasktrail.llm.common import documents_of, released

PART_CHARACTERS = 20_000
# Rows of one result batch hold about this many bytes of text.
BATCH_BYTES = 4 << 20

# White space as the pattern's \\s has it, by the Unicode White_Space property.
_SPACE = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Shorter runs are left to the library.
LONG_RUN = 2000
_RUN = regex.compile(f"{_SPACE}{{{LONG_RUN},}}+")

_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")
# How a pattern ends that takes runs of white space as said above.
_LAST_MATCHES = r"|\s+(?!\S)|\s+"
_CODECS: dict = {}


def codec(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, built once per Python worker."""
    key = ranks_path, pattern
    if key not in _CODECS:
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {
                base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)
            }
        _CODECS[key] = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _CODECS[key]


def safe_parts(text: str, size: int = PART_CHARACTERS) -> Iterator[str]:
    """The text in parts of at least ``size`` characters, cut at safe boundaries."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def encode_text(encoding, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    found: list[bytes] = []

    def plain(text: str) -> None:
        for part in safe_parts(text):
            ids = encoding.encode_to_numpy(part, disallowed_special=())
            found.append(ids.astype("<u4").tobytes())

    start = 0
    if len(text) >= LONG_RUN and encoding._pat_str.endswith(_LAST_MATCHES):
        for run in _RUN.finditer(text):
            low, high = run.span()
            high -= high < len(text)
            plain(text[start:low])
            ids = encoding._encode_single_piece(text[low:high])
            found.append(np.array(ids, "<u4").tobytes())
            start = high
    plain(text[start:])
    return b"".join(found)


def decode_ids(encoding, ids: bytes) -> bytes:
    return encoding.decode_bytes(memoryview(ids).cast("I").tolist()) if ids else b""


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, 32-bit little-endian) and the bytes ``decoded`` from them."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(ranks_path, pattern)
        for batch in batches:
            rows: list[tuple[int | None, bytes, bytes]] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode_text(encoding, text.as_py())
                rows.append((doc_id.as_py(), ids, decode_ids(encoding, ids)))
                held += len(ids)
                if held > BATCH_BYTES:
                    yield _coded(rows)
                    rows, held = [], 0
            if rows:
                yield _coded(rows)

    return documents_of(docs).mapInArrow(released(code), "doc_id long, ids binary, decoded binary")


def _coded(rows: list[tuple[int | None, bytes, bytes]]) -> pa.RecordBatch:
    doc_ids, ids, decoded = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
        ["doc_id", "ids", "decoded"],
    )
