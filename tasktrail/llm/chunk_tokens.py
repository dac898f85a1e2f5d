"""Token ids by the tokenizers library, each distinct piece of text encoded once per worker.

Texts are cut in front of every run of white space that starts with a space or a line
feed and follows a visible character. No pre-token of the two tokenizers used here
reaches over such a cut (white space either starts a pre-token or is dropped, added
tokens hold none), so the ids of a text are the ids of its pieces one after the other.
Natural text repeats most of its pieces, which makes this several times faster than
encoding text by text. The cache is bounded and only saves work.

Where only ids are wanted, texts are also cut between a Latin-1 letter and the mark
behind it, and for a tokenizer that lower-cases, A-Z and line feeds are folded first, so
that a word is encoded once however its line writes it. Folding leaves out letters in
front of a character that might combine with them, and texts that may hold added tokens.

Pieces of Latin-1 characters, for which lower case and composition are plain, go to the
library's model right away with the pre-tokens of the file's own pattern; all others go
through the library's whole chain. Both give the same ids.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed: the split of byte-level tokenizers whose file names no other.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed: the split of the word tokenizer.
_WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Marks that end the word before them in both splits and stand in no added token.
_MARKS = ".,;:!?"

# White space beyond ASCII, fixed by the Unicode White_Space property; texts with any of
# it are encoded as one piece.
_WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_OPENED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, read once per Python worker."""
    if path not in _OPENED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _OPENED[path] = Tokenizer.from_file(path)
        _OPENED[path].no_truncation()
        _OPENED[path].no_padding()
    return _OPENED[path]


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the other bytes in order for the
    characters from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {byte: byte for byte in plain} | {byte: 256 + i for i, byte in enumerate(others)}


class LatinSplit:
    """Pre-tokens of Latin-1 text for a tokenizer file; ``None`` from ``of`` for another chain."""

    def __init__(self, pattern: str, lower: bool):
        self.find = regex.compile(pattern).findall
        self.lower = lower
        self.letters = _byte_letters()
        self.space = chr(self.letters[0x20])

    @classmethod
    def of(cls, path: str) -> LatinSplit | None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normalizer = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        kinds = [part["type"] for part in normalizer.get("normalizers", [normalizer])]
        added = [token["content"] for token in spec["added_tokens"]]
        if any(token[:2] != "<|" or set(token) & set(_MARKS) for token in added):
            return None
        splitter = spec["pre_tokenizer"]
        parts = splitter.get("pretokenizers", [splitter])
        if any(part.get("add_prefix_space") for part in parts) or spec["model"]["type"] != "BPE":
            return None
        if not kinds and [part["type"] for part in parts] == ["ByteLevel"]:
            return cls(_BYTE_LEVEL, lower=False) if parts[0]["use_regex"] else None
        if kinds == ["NFC", "Replace", "Lowercase"] and [part["type"] for part in parts] == [
            "Split",
            "ByteLevel",
        ]:
            known = parts[0]["invert"] and parts[0]["pattern"].get("Regex") == _WORD_LEVEL
            return cls(_WORD_LEVEL, lower=True) if known else None
        return None

    def __call__(self, text: str) -> list[str] | None:
        plain = text.isascii()
        if not plain and (max(text) > "\u00ff" or "\u0085" in text or "\u00a0" in text):
            return None
        spaced = text[:1] == " "
        word = text[1:] if spaced else text
        if word.isalpha():
            # Both splits take a run of letters whole; most pieces are one.
            if self.lower:
                word = word.lower()
            if not plain:
                word = word.encode().decode("latin-1").translate(self.letters)
            return [self.space + word if spaced and not self.lower else word]
        if "<|" in text:
            return None
        found = self.find(text.lower() if self.lower else text)
        return [part.encode().decode("latin-1").translate(self.letters) for part in found]


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each place of a run of UTF-8 bytes."""
    found = np.zeros(len(data), bool)
    if len(data) > 1:
        after, before = data[1:], data[:-1]
        np.logical_or(after == 0x20, after == 0x0A, out=found[1:])
        found[1:] &= (before > 0x20) & (before != 0x7F)
    return found


def _table(letters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(letters.encode())] = True
    return table


_MARK_BYTES = _table(_MARKS)
_LETTER_BYTES = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def mark_cuts(data: np.ndarray) -> np.ndarray:
    """Whether a mark directly follows a letter, ASCII or U+00C0 to U+00FF, at each place."""
    letter = _LETTER_BYTES[data]
    last = data[1:]
    letter[1:] |= (data[:-1] == 0xC3) & (last != 0x97) & (last != 0xB7)
    found = _MARK_BYTES[data]
    found[1:] &= letter[:-1]
    found[:1] = False
    return found


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased and line feeds as spaces, where composition cannot tell."""
    if ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():
        return data
    upper = (data >= 0x41) & (data <= 0x5A)
    upper[:-1] &= data[1:] < 0xC4
    return np.where(data == 0x0A, np.uint8(0x20), data | (upper.view(np.uint8) << 5))


def _may_hold_wide_space(data: np.ndarray) -> bool:
    """False only if no character beyond ASCII can be white space."""
    if ((data >= 0xE1) & (data <= 0xE3)).any():
        return True
    second = data[1:][data[:-1] == 0xC2]
    return bool(((second == 0x85) | (second == 0xA0)).any())


def _listed(values: pa.Array) -> list[bytes]:
    return values.to_numpy(zero_copy_only=False).tolist()


# Bytes of kept pieces, twice, and an entry's own overhead.
CACHE_BYTES = 40 << 20
ENTRY_BYTES = 180
# Longer pieces are rare and not kept.
LONGEST_KEPT = 256


class ChunkEncoder:
    """Ids (little-endian 32 bits) of whole texts; the cache is bounded in bytes."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        # Pieces met of late, and those before them: what recurs stays, what does not goes.
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        self.split = LatinSplit.of(path)
        self.model = self.tokenizer.model

    def encoded(self, pieces: list[bytes]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.older, self.cache, self.held = self.cache, {}, 0
        known, older = self.cache, self.older
        found = list(map(known.get, pieces))
        fresh = [place for place, ids in enumerate(found) if ids is None]
        rest: list[int] = []
        split, tokenize = self.split, self.model.tokenize
        for place in fresh:
            piece = pieces[place]
            ids = older.get(piece)
            if ids is None:
                parts = split(piece.decode()) if split else None
                if parts is None:
                    rest.append(place)
                    continue
                ids = array("I", [token.id for part in parts for token in tokenize(part)]).tobytes()
            found[place] = ids
        for start in range(0, len(rest), 20_000):
            part = rest[start : start + 20_000]
            texts = [pieces[place].decode() for place in part]
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for place, one in zip(part, encoded):
                found[place] = array("I", one.ids).tobytes()
        for place in fresh:
            piece, ids = pieces[place], found[place]
            if len(piece) <= LONGEST_KEPT and self.held <= CACHE_BYTES:
                known[piece] = ids
                self.held += ENTRY_BYTES + len(piece) + len(ids)
        return found

    def pieces(
        self, texts: pa.Array, words: bool = False
    ) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Piece codes, the first piece of each text (one more at the end), distinct pieces.

        With ``words``, pieces are also cut in front of marks and may be folded: their ids
        are those of the text, their bytes need not be.
        """
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[
            texts.offset : texts.offset + len(texts) + 1
        ]
        low, high = int(offsets[0]), int(offsets[-1])
        buffer = texts.buffers()[2]
        data = (
            np.frombuffer(buffer, np.uint8)[low:high] if buffer is not None else np.empty(0, np.uint8)
        )
        starts = offsets - low
        begins = cuts(data)
        if words and self.split:
            begins |= mark_cuts(data)
        if _may_hold_wide_space(data):
            wide = pc.match_substring_regex(texts.cast(pa.large_string()), _WIDE_SPACE)
            wide = np.asarray(wide.to_numpy(zero_copy_only=False), bool)
            inside = np.flatnonzero(begins)
            begins[inside[wide[np.searchsorted(starts, inside, "right") - 1]]] = False
        begins[starts[starts < len(data)]] = True
        edges = np.append(np.flatnonzero(begins), len(data))
        if words and self.split and self.split.lower:
            data = folded(data)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(),
            max(0, len(edges) - 1),
            [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())],
        )
        coded = pieces.dictionary_encode()
        return (
            coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            np.searchsorted(edges, starts),
            coded.dictionary,
        )

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        codes, first, distinct = self.pieces(texts, words=True)
        sizes = np.fromiter(map(len, self.encoded(_listed(distinct))), np.int64) // 4
        total = np.concatenate([[0], np.cumsum(sizes[codes])]) if len(codes) else np.zeros(1, np.int64)
        return total[first[1:]] - total[first[:-1]]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        codes, first, distinct = self.pieces(texts, words=True)
        encoded = pa.array(self.encoded(_listed(distinct)), pa.large_binary())
        _, offsets, data = encoded.take(pa.array(codes)).buffers()
        ends = np.frombuffer(offsets, np.int64, len(codes) + 1) // 4
        flat = np.frombuffer(data or b"", "<u4", int(ends[-1]))
        for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist()):
            yield flat[a:b]
