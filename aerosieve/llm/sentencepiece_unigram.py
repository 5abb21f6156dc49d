"""Operator 6: SentencePiece encoding and decoding, unigram.

The pieces, their log scores and the normaliser flags are read from a .model file; nothing
is trained. Pieces are laid out as a double-array trie over UTF-8 bytes. The best
segmentation is Viterbi's: at every byte position the best sum of scores, the first found
among equals (longest piece from the leftmost start). A character that no piece starts with costs the smallest score less 10 and is
written as its byte pieces, or as the unknown piece where the model has none.

No piece crosses the start of a word mark, so words are segmented apart; many distinct
words go through the trie together, one vector step per position, and a bounded
cache keeps their ids. Decoding joins pieces, turns byte pieces into text and word marks
into spaces, and drops the mark that encoding puts before a text.

Null counts as the empty text, which has no pieces. Each row has a result, repeated rows and null ids too; very long texts are
encoded whole, word by word; an empty table gives an empty one, and other columns are ignored, whatever their names. Models with user-defined pieces, which
would come before any score, raise.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # piece types of the file format
UNKNOWN_PENALTY = 10.0
WIDE = 48  # longer words are segmented one at a time
CACHE = 300_000


def _fields(b: bytes):
    """(field, value) of a protobuf message: ints, or raw bytes."""
    i = 0

    def number():
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            if c < 128:
                return x
            shift += 7

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            n = number() if kind == 2 else 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def double_array(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value of a trie: from state s over byte c to base[s] + c, if check there is s. value is -1 where no word ends."""
    size, window = 1 << 18, 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    words = sorted(words)
    check[0], free[0] = 0, False
    low = 1
    todo = [(0, 0, len(words), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if len(words[lo][0]) == depth:
            value[state] = words[lo][1]
            lo += 1
        kids: list[tuple[int, int, int]] = []
        i = lo
        while i < hi:
            c, j = words[i][0][depth], i
            while j < hi and words[j][0][depth] == c:
                j += 1
            kids.append((c, i, j))
            i = j
        if not kids:
            continue
        codes = [c for c, *_ in kids]
        while not free[low]:
            low += 1
        b = max(1, low - codes[0])
        while True:  # the first place where all children are free, a window at a time
            if b + window + 256 >= len(free):
                base, check, value, free = (np.concatenate([x, np.full(len(x), f, x.dtype)]) for x, f in ((base, 0), (check, -1), (value, -1), (free, True)))
            fits = free[b + codes[0] : b + codes[0] + window].copy()
            for c in codes[1:]:
                fits &= free[b + c : b + c + window]
            if fits.any():
                b += int(fits.argmax())
                break
            b += window
        base[state] = b
        at = b + np.array(codes)
        check[at], free[at] = state, False
        todo += [(b + c, i, j, depth + 1) for c, i, j in kids]
    return base, check, value


@dataclass
class Pieces:
    texts: list[bytes]  # what decoding puts out; byte pieces are one byte
    scores: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    bytes_at: np.ndarray  # id of each byte's piece, -1 without
    unknown: int
    prefix: bool
    by_word: bool

    @classmethod
    def load(cls, path: str) -> Pieces:
        """path: a local .model file on the driver (the parsed table is what tasks get)."""
        pieces, prefix = [], True
        with open(path, "rb") as f:
            data = f.read()
        for field, v in _fields(data):
            if field == 1:
                d = dict(_fields(v))
                pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)))
            elif field == 3:
                rules = dict(_fields(v))
                prefix = bool(rules.get(3, 1))
                # what is not rebuilt here must not be mis-encoded silently
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only models without a character map and without removal of extra white space are read")
        bytes_at = np.full(256, -1, np.int64)
        texts = []
        for k, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                bytes_at[int(p[3:5], 16)] = k
            texts.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else p.encode() if kind in (NORMAL, USER) else b"")
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("user-defined pieces are not read: they would have to win over any score")
        unknown = next(k for k, x in enumerate(pieces) if x[2] == UNKNOWN)
        words = [(p.encode(), k) for k, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        by_word = not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER))
        return cls(texts, np.array([s for _, s, _ in pieces]), *double_array(words), bytes_at, unknown, prefix, by_word)

    def _unknown_ids(self, raw: bytes) -> list[int]:
        own = self.bytes_at[list(raw)]
        return [self.unknown] if (own < 0).any() else own.tolist()

    def _back(self, raw: bytes, start, piece) -> list[int]:
        out, at = [], len(raw)
        while at:
            s, k = int(start[at]), int(piece[at])
            out += [k] if k >= 0 else self._unknown_ids(raw[s:at])[::-1]
            at = s
        return out[::-1]

    def segment(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (marks in place of spaces), by Viterbi over all words at once."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        cheap = [k for k in order if 0 < len(words[k]) <= WIDE]
        for i in range(0, len(cheap), 20_000):
            part = cheap[i : i + 20_000]
            start, piece = self._viterbi([words[k] for k in part])
            for row, k in enumerate(part):
                out[k] = self._back(words[k], start[row], piece[row])
        for k in order:
            if len(words[k]) > WIDE:
                out[k] = self._back(words[k], *self._viterbi_one(words[k]))
        return out

    def _viterbi(self, words: list[bytes]):
        n, width = len(words), max(map(len, words))
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.int32)
        size = np.array([len(w) for w in words])
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        floor = self.scores[self.value[self.value >= 0]].min() - UNKNOWN_PENALTY
        for i in range(width):
            lead = text[:, i]
            rows = np.flatnonzero((size > i) & (best[:, i] > -np.inf) & ((lead & 0xC0) != 0x80))
            if not len(rows):
                continue
            char = np.where(lead[rows] < 0x80, 1, np.where(lead[rows] < 0xE0, 2, np.where(lead[rows] < 0xF0, 3, 4)))
            whole = np.zeros(n, bool)  # a piece spans just the first character
            state, live, j = np.zeros(len(rows), np.int32), rows, i
            chars = np.zeros(n, np.int32)
            chars[rows] = char
            while len(live) and j < width:
                to = self.base[state] + text[live, j]
                ok = (j < size[live]) & (to < len(self.check)) & (self.base[state] > 0)
                ok &= self.check[np.where(ok, to, 0)] == state
                live, state = live[ok], to[ok]
                j += 1
                k = self.value[state]
                end = k >= 0
                r, kk = live[end], k[end]
                whole[r] |= chars[r] == j - i
                score = best[r, i] + self.scores[kk]
                better = score > best[r, j]
                r, kk = r[better], kk[better]
                best[r, j], start[r, j], piece[r, j] = score[better], i, kk
            r = rows[~whole[rows]]
            j = np.minimum(i + chars[r], size[r])
            score = best[r, i] + floor
            better = score > best[r, j]
            r, j = r[better], j[better]
            best[r, j], start[r, j], piece[r, j] = score[better], i, -1
        return start, piece

    def _viterbi_one(self, word: bytes):
        """The same for one long word: time in proportion to its length."""
        n = len(word)
        base, check, value, scores = self._lists()
        best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        floor = self._floor
        for i in range(n):
            c = word[i]
            if best[i] == -np.inf or c & 0xC0 == 0x80:
                continue
            char = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            state, whole, j, here = 0, False, i, best[i]
            while j < n and base[state] > 0:
                to = base[state] + word[j]
                if to >= len(check) or check[to] != state:
                    break
                state, j = to, j + 1
                k = value[state]
                if k >= 0:
                    whole |= j - i == char
                    if here + scores[k] > best[j]:
                        best[j], start[j], piece[j] = here + scores[k], i, k
            j = min(i + char, n)
            if not whole and here + floor > best[j]:
                best[j], start[j], piece[j] = here + floor, i, -1
        return start, piece

    def _lists(self):
        if not hasattr(self, "_cached"):
            self._cached = tuple(x.tolist() for x in (self.base, self.check, self.value, self.scores))
            self._floor = float(self.scores[self.value[self.value >= 0]].min() - UNKNOWN_PENALTY)
        return self._cached


_RUNS = re.compile(r" +[^ ]*|[^ ]+")


class Encoder:
    """text -> ids as little-endian int32 bytes. Holds at most CACHE words between batches."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.pieces.by_word:
            return [(" " if self.pieces.prefix else "") + text]
        if self.pieces.prefix:
            text = " " + text
        if "  " in text or not self.pieces.prefix or text[-1] == " ":
            return _RUNS.findall(text)
        # the usual case: single spaces; the space before each word is understood
        return text.split(" ")[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        plain = [bool(t) and self.pieces.by_word and self.pieces.prefix and "  " not in t and t[0] != " " and t[-1] != " " for t in texts]
        spaced, bare = self.known.setdefault(True, {}), self.known.setdefault(False, {})
        missing = {True: set(), False: set()}
        for words, p in zip(split, plain, strict=True):
            missing[p].update(words)
        for p, cache in ((True, spaced), (False, bare)):
            new = [w for w in missing[p] if w not in cache]
            raw = [((" " + w) if p else w).replace(" ", MARK).encode("utf-8", "replace") for w in new]
            for w, ids in zip(new, self.pieces.segment(raw), strict=True):
                cache[w] = np.array(ids, "<i4").tobytes()
        out = [b"".join(map((spaced if p else bare).__getitem__, words)) for words, p in zip(split, plain, strict=True)]
        if len(spaced) + len(bare) > CACHE:
            self.known.clear()
        return out


class Decoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lead = (MARK if pieces.prefix else "").encode()

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.pieces.texts.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        if self.lead and raw.startswith(self.lead):
            raw = raw[len(self.lead) :]
        return raw.replace(MARK.encode(), b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))  # the vocabulary: fixed size

    def make():
        encoder = Encoder(pieces.value)

        def f(batch):
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32))
            return pa.table([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=[id_col, "ids"])

        return f

    d = docs.select(id_col, text_col)
    return map_rows(d, make, f"`{id_col}` {d.schema[0].dataType.simpleString()}, ids array<int>", max_bytes=4 << 20)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) from (id_col, ids); null ids give the empty text."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def make():
        decoder = Decoder(pieces.value)

        def f(batch):
            text = [decoder.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column(1).to_pylist()]
            return pa.table([batch.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

        return f

    d = encoded.select(id_col, "ids")
    return map_rows(d, make, f"`{id_col}` {d.schema[0].dataType.simpleString()}, text string", max_bytes=4 << 20)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_pieces, n_byte_pieces, ids_crc32, text_crc32 of the decoded text, same): encodes and decodes in one pass."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def make():
        p = pieces.value
        encoder, decoder = Encoder(p), Decoder(p)
        is_byte = np.zeros(len(p.texts), bool)
        is_byte[p.bytes_at[p.bytes_at >= 0]] = True

        def f(batch):
            raw = [t or "" for t in batch.column(1).to_pylist()]
            ids = encoder.encode(raw)
            back = [decoder.decode(x) for x in ids]
            return pa.table([
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([int(is_byte[np.frombuffer(x, "<i4")].sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in back], pa.int64()),
                pa.array([a == b for a, b in zip(raw, back, strict=True)]),
            ], names=[id_col, "n_pieces", "n_byte_pieces", "ids_crc32", "text_crc32", "same"])

        return f

    d = docs.select(id_col, text_col)
    return map_rows(d, make, f"`{id_col}` {d.schema[0].dataType.simpleString()}, n_pieces long, n_byte_pieces long, ids_crc32 long, text_crc32 long, same boolean", max_bytes=4 << 20)
