"""SentencePiece encoding and decoding of whole texts, merge-type (BPE) models.

A text is normalised as the model file says and cut where no piece reaches over: in front
of a space mark that follows another character. Each distinct part is encoded once per
worker by backtracking over pieces:

- one Aho-Corasick pass finds the longest piece that starts at each place;
- a piece is put down if it fits the one before: merging the characters of both again
  must give exactly these two (answers are kept per pair of pieces);
- if not, the next shorter piece is tried, and when none is left the place is marked in
  a bitfield as failed and the piece before it is taken back. No place fails twice, so the
  work is linear in the part.

A merge-type encoding is the only sequence whose neighbours all fit, so what is found is
what merging the best-scored neighbours, leftmost first, would give. Characters without a
piece become the byte pieces of their UTF-8 bytes, or the unknown piece.

Null texts count as empty: no pieces, only the end id. Repeated rows give repeated
results, very long texts are worked off part by part, further columns are left out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tasktrail.llm.common import documents_of, released

SPACE = "▁"
# Bytes of kept parts (twice) and of kept answers per worker; an entry's own overhead.
FIT_BYTES = 64 << 20
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200
# Longer parts are rare and not kept.
LONGEST_KEPT = 64
# Rows of one result batch hold about this many bytes of text.
BATCH_BYTES = 4 << 20

_MERGE_MODEL = 2
_NEVER = float("-inf")
_NORMAL, _UNKNOWN, _USER_DEFINED, _UNUSED, _BYTE = 1, 2, 4, 5, 6


class PieceEncoder:
    """Ids of texts under one model file. Caches are bounded in bytes and only save work."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        if spec.trainer_spec.model_type != _MERGE_MODEL:
            raise ValueError(f"{path} is not a merge-type model")
        kinds = {piece.type for piece in spec.pieces}
        if kinds & {_USER_DEFINED, _UNUSED}:
            raise ValueError(f"{path} has user-defined or unused pieces, which are not merged")
        rule = spec.normalizer_spec
        # Whether normalising only marks spaces and puts one in front.
        self.plain = (
            rule.add_dummy_prefix
            and rule.escape_whitespaces
            and not rule.remove_extra_whitespaces
            and not rule.precompiled_charsmap
        )
        self.text = [piece.piece for piece in spec.pieces]
        self.length = list(map(len, self.text))
        self.id_of = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == _NORMAL}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == _UNKNOWN)
        self.byte = {
            int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == _BYTE
        }
        self.automaton = ahocorasick.Automaton()
        for piece, number in self.id_of.items():
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.shorter = {number: self._shorter(piece) for piece, number in self.id_of.items()}
        # Only characters that are pieces, or parts of pieces, can take part in a merge.
        letters = sorted({letter for piece in self.id_of for letter in piece})
        if any(letter not in self.id_of for letter in letters):
            raise ValueError(f"{path} has pieces whose characters are no pieces")
        known = "".join(map(re.escape, letters))
        self.runs = re.compile(f"[{known}]+|[^{known}]")
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id_of)
        self.parts = re.compile("(?s:.+)" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.letters = set(letters)
        self.cache = Parts(self)
        self.fits: dict[int, bool] = {}

    def _shorter(self, piece: str) -> int | None:
        """The longest other piece that ``piece`` starts with."""
        for size in range(len(piece) - 1, 0, -1):
            if piece[:size] in self.id_of:
                return self.id_of[piece[:size]]
        return None

    def merged(self, text: str) -> list[str]:
        """The plain rule on a short text: merge the best-scored neighbours, leftmost first."""
        parts = list(text)
        score = self.score.get
        scores = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == _NEVER:
                break
            place = scores.index(best)
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
            del scores[place]
            if place:
                scores[place - 1] = score(parts[place - 1] + parts[place], _NEVER)
            if place < len(scores):
                scores[place] = score(parts[place] + parts[place + 1], _NEVER)
        return parts

    def fit(self, before: int, piece: int) -> bool:
        """Whether merging both texts again gives exactly these pieces; -1: no piece before."""
        if len(self.fits) * ENTRY_BYTES > FIT_BYTES:
            self.fits.clear()
        texts = [self.text[piece]] if before < 0 else [self.text[before], self.text[piece]]
        found = self.fits[before * len(self.text) + piece] = self.merged("".join(texts)) == texts
        return found

    def backtracked(self, text: str) -> list[int]:
        """The ids of a text of known characters."""
        size = len(text)
        longest = [-1] * (size + 1)
        lengths = self.length
        for end, number in self.automaton.iter(text):
            longest[end - lengths[number]] = number  # of one start, longer ones end later
        failed = 0 if size <= LONGEST_KEPT else bytearray(size // 8 + 1)
        found: list[int] = []
        # A piece from place p is kept at p - 1: the automaton gives last characters.
        place, piece, base = 0, longest[-1], -len(self.text)
        known, count, shorter = self.fits.get, len(self.text), self.shorter
        while True:
            end = place + lengths[piece]
            if not failed or not (
                failed >> end if size <= LONGEST_KEPT else failed[end >> 3] >> (end & 7)
            ) & 1:
                fits = known(base + piece)
                if fits or fits is None and self.fit(base // count, piece):
                    found.append(piece)
                    if end == size:
                        return found
                    place, base, piece = end, piece * count, longest[end - 1]
                    continue
            piece = shorter[piece]
            while piece is None:
                if size <= LONGEST_KEPT:
                    failed |= 1 << place
                else:
                    failed[place >> 3] |= 1 << (place & 7)
                piece = found.pop()
                base = found[-1] * count if found else -count
                place -= lengths[piece]
                piece = shorter[piece]

    def of_part(self, part: str) -> list[int]:
        """The ids of normalised text that neighbouring text cannot merge with."""
        if self.letters.issuperset(part):
            return self.backtracked(part)
        found: list[int] = []
        for run in self.runs.findall(part):
            if run[0] in self.letters:
                found += self.backtracked(run)
            elif self.byte:
                found += [self.byte[byte] for byte in run.encode()]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers, without begin or end."""
        if self.cache.held > CACHE_BYTES:
            self.cache = Parts(self, self.cache)
        if not self.plain:
            text = self.library.normalize(text)
        elif text:
            text = SPACE + text.replace(" ", SPACE)
        return b"".join(map(self.cache.__getitem__, self.parts.findall(text)))


class Parts(dict):
    """Ids of parts. A full one serves once more as the ``older`` of the next, so that what
    recurs stays and what does not goes."""

    def __init__(self, encoder: PieceEncoder, older: Parts | None = None):
        super().__init__()
        self.encoder = encoder
        self.older = {} if older is None else dict(older)
        self.held = 0

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array("i", self.encoder.of_part(part)).tobytes()
        if len(part) <= LONGEST_KEPT:
            self[part] = ids
            self.held += ENTRY_BYTES + len(part) + len(ids)
        return ids


_OPENED: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of a model file, built once per Python worker."""
    if path not in _OPENED:
        _OPENED.clear()
        _OPENED[path] = PieceEncoder(path)
    return _OPENED[path]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int, the end id last) and the text ``decoded`` from them."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model_path)
        end = np.array([encoder.library.eos_id()], "<i4").tobytes()
        decode = encoder.library.decode
        for batch in batches:
            doc_ids: list[int | None] = []
            ids: list[bytes] = []
            decoded: list[str] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own = encoder.ids(text.as_py()) + end
                doc_ids.append(doc_id.as_py())
                ids.append(own)
                decoded.append(decode(np.frombuffer(own, "<i4").tolist()))
                held += len(own)
                if held > BATCH_BYTES:
                    yield _coded(doc_ids, ids, decoded)
                    doc_ids, ids, decoded, held = [], [], [], 0
            if doc_ids:
                yield _coded(doc_ids, ids, decoded)

    return documents_of(docs).mapInArrow(released(code), "doc_id long, ids array<int>, decoded string")


def _coded(doc_ids: list[int | None], ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(own) // 4 for own in ids])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), values),
            pa.array(decoded, pa.string()),
        ],
        ["doc_id", "ids", "decoded"],
    )
