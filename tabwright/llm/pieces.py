"""Token ids of whole texts, the tokenizer being asked once for each distinct piece.

A text is cut only where no token can reach across, so the joined ids of its
pieces are the ids of the whole text:

* before one space between a character other than a space and an ASCII letter,
  digit or mark (the space begins the next word);
* around a single newline between such characters;
* between a letter, a digit and an ASCII mark, but never after an apostrophe.

A byte-level BPE with the usual word pattern splits there by its pattern.  A
sentencepiece BPE never merges across two characters that stand together in
none of its pieces; this is looked up in its vocabulary.  A tokenizer of
another kind gets whole texts.  Pieces are found and counted with NumPy and Arrow
over a chunk of texts at once.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa

#: Ids of this many pieces at most are remembered, in two generations; longer pieces than ``_LONG`` bytes are not.
CACHE_PIECES, _LONG = 350_000, 64
CHUNK_BYTES = 4 << 20

_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _NEWLINE = 1, 2, 3, 4, 5, 6


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        table[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _MARK
    table[0x20], table[0x0A] = _SPACE, _NEWLINE
    return table


_CLASS = _classes()
_SOLID = {bytes([b]) for b in range(33, 127)} | {b"\xc3"}      # second bytes of pieces that begin with a space
_PAIR = np.zeros(64, bool)       # (left class, right class): a cut lies between
for _left in (_LETTER, _DIGIT, _MARK):
    for _right in (_LETTER, _DIGIT, _MARK, _QUOTE):
        _PAIR[_left * 8 + _right] = _left != _right and (_left, _right) != (_MARK, _QUOTE)


def cuts(buf: np.ndarray) -> np.ndarray:
    """For every byte, whether a piece may begin there."""
    n = len(buf)
    cls = np.zeros(n + 4, np.uint8)                     # two neighbours of no class on either side
    mid = cls[2:-2]
    np.take(_CLASS, buf, out=mid)
    latin = np.flatnonzero(buf[:-1] == 0xC3)            # U+00C0 to U+00FF but the two signs among them are letters
    latin = latin[(buf[latin + 1] != 0x97) & (buf[latin + 1] != 0xB7)]
    mid[latin] = mid[latin + 1] = _LETTER
    solid = (cls >= _LETTER) & (cls <= _QUOTE)
    before, after = slice(1, n + 1), slice(3, n + 3)
    cut = _PAIR[cls[before] * 8 + mid]
    cut |= (mid == _SPACE) & (cls[before] != _SPACE) & solid[after]
    lone = (mid == _NEWLINE) & solid[before] & solid[after]
    cut |= lone
    cut[1:] |= lone[:-1]
    return cut


class Remembered:
    """What was computed of a piece, in two generations."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size // 2, {}, {}

    def lookup(self, keys: list[bytes], compute) -> list:
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        gone = [i for i, v in enumerate(found) if v is None]
        new = []
        for i in gone:
            v = old.get(keys[i])
            if v is None:
                new.append(i)
            else:
                found[i] = young[keys[i]] = v
        if new:
            for i, v in zip(new, compute([keys[i] for i in new])):
                found[i] = v
                if len(keys[i]) <= _LONG:
                    young[keys[i]] = v
        if len(young) > self.size:
            self.young, self.old = {}, young
        return found


class ByteBpe:
    """A byte-level BPE of the tokenizers library."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole_if = [] if plain_specials else [s.encode() for s in added if s]
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        kind = str(self.tokenizer.pre_tokenizer)
        self.cuttable = (self.tokenizer.normalizer is None and kind.startswith("ByteLevel")
                         and "add_prefix_space=False" in kind and "use_regex=True" in kind)
        self._bytes: list[bytes] | None = None
        self._sizes: np.ndarray | None = None

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        if self._bytes is None:
            shown = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
            hidden = [b for b in range(256) if b not in set(shown)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
            special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            words = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
            self._bytes = [special[i].encode() if i in special else bytes(map(byte_of.__getitem__, w))
                           for i, w in enumerate(words)]
        return self._bytes

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        strings = [t.decode("utf-8", "replace") for t in texts]
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece.  Words that begin with a space are joined a hundred at a time and their ids dealt by bytes."""
        out: list[bytes | None] = [None] * len(pieces)
        if self._sizes is None:
            self._sizes = np.array([len(b) for b in self.token_bytes()])
        joined = [i for i, p in enumerate(pieces) if p[:1] == b" " and p[1:2] in _SOLID] if self.cuttable else []
        groups = [joined[k : k + 100] for k in range(0, len(joined), 100)]
        for group, ids in zip(groups, self._ids([b"".join(map(pieces.__getitem__, g)) for g in groups])):
            upto = np.cumsum(self._sizes[ids])
            want = np.cumsum([len(pieces[i]) for i in group])
            ends = np.searchsorted(upto, want) + 1
            if ends[-1] == len(upto) and np.array_equal(upto[ends - 1], want):      # else bytes were replaced in decoding
                for i, lo, hi in zip(group, [0, *ends[:-1].tolist()], ends.tolist()):
                    out[i] = ids[lo:hi].tobytes()
        rest = [i for i, v in enumerate(out) if v is None]
        for i, ids in zip(rest, self._ids([pieces[i] for i in rest])):
            out[i] = ids.tobytes()
        return out


class PieceBpe:
    """A sentencepiece BPE with byte fallback that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        self.size = p.get_piece_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.whole_if = ["▁".encode()]          # merges with spaces
        letter, mark = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
        across = re.compile("[^▁]▁|\n|" + "|".join(
            f"[{a}][{b}]" for a in (letter, "0-9", mark) for b in (letter, "0-9", mark) if a != b))
        plain = [p.id_to_piece(i) for i in range(self.size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        start = p.encode("\na")[:2]
        self.lead = start if p.id_to_piece(start) == ["▁", "<0x0A>"] else None
        self.cuttable = self.lead is not None and not any(map(across.search, plain))
        self._bytes: list[bytes] | None = None

    def token_bytes(self) -> list[bytes]:
        if self._bytes is None:
            p = self.processor
            self._bytes = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i)
                           else p.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]
        return self._bytes

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; the library's own space stands for a piece's leading one, others follow a newline."""
        spaced = [p[:1] == b" " for p in pieces]
        texts = [(p[1:] if s else b"\n" + p).decode("utf-8", "replace") for p, s in zip(pieces, spaced)]
        drop = len(self.lead or ())
        return [np.array(ids if s else ids[drop:], self.dtype).tobytes()
                for ids, s in zip(self.processor.encode(texts, num_threads=1), spaced)]


class Pieces:
    """The distinct pieces of a chunk of texts, and where they stand."""

    def __init__(self, texts: list[bytes], *models):
        n = np.array([len(t) for t in texts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        joined = b"".join(texts)
        self.buf = np.frombuffer(joined, np.uint8)
        cut = cuts(self.buf) if len(joined) and all(m.cuttable for m in models) else np.zeros(len(joined), bool)
        for s in {s for m in models for s in m.whole_if}:
            if s in joined:
                for k in (k for k, t in enumerate(texts) if s in t):
                    cut[self.bounds[k] : self.bounds[k + 1]] = False
        cut[self.bounds[:-1][n > 0]] = True
        self.starts = np.flatnonzero(cut)
        ends = np.append(self.starts[1:], len(joined))
        if len(joined) > 1 << 30:
            kind, offsets = pa.large_binary(), np.append(self.starts, len(joined)).astype(np.int64)
        else:
            kind, offsets = pa.binary(), np.append(self.starts, len(joined)).astype(np.int32)
        arr = pa.Array.from_buffers(kind, len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        words = arr.dictionary_encode()
        self.sizes = ends - self.starts
        self.codes = words.indices.to_numpy(zero_copy_only=False)
        self.words = words.dictionary.to_pylist()
        self.first_piece = np.searchsorted(self.starts, self.bounds)      # of each text; the last is the total

    def ids(self, values, dtype) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin, from the ids of the distinct pieces."""
        flat = np.frombuffer(b"".join(values), dtype)
        n = np.fromiter(map(len, values), np.int64, len(values)) // dtype.itemsize
        first = np.cumsum(n) - n
        count = n[self.codes]
        upto = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(first[self.codes] - upto[:-1], count)
        at += np.arange(upto[-1])
        return flat[at], upto[self.first_piece]


class Encoder:
    """Ids of texts by one model, with remembered pieces."""

    def __init__(self, model, size: int = CACHE_PIECES):
        self.model, self.known = model, Remembered(size)

    def values(self, words: list[bytes]) -> list[bytes]:
        return self.known.lookup(words, self.model.encode)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, n + 1 bounds) of the texts."""
        p = Pieces(texts, self.model)
        return p.ids(self.values(p.words), self.model.dtype)


_ENCODERS: dict[tuple, Encoder] = {}


def byte_encoder(path: str, plain_specials: bool = False) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    key = (path, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ByteBpe(path, plain_specials))
    return _ENCODERS[key]


def chunks(arr: pa.Array, max_bytes: int = CHUNK_BYTES):
    """(first row, texts as bytes) runs of a string array near ``max_bytes``; nulls are empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    values = iter(arr.cast(pa.binary()) if not pa.types.is_binary(arr.type) else arr)
    start = 0
    while run := list(_run(values, max_bytes)):
        yield start, run
        start += len(run)


def _run(values, max_bytes: int):
    size = 0
    for v in islice(values, None):
        b = v.as_py() or b""
        size += len(b)
        yield b
        if size >= max_bytes:
            return
