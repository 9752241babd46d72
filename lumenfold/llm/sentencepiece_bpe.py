"""Exact merge-type encoding and decoding with a SentencePiece BPE vocabulary, without its library at run time.

Encoding is by backtracking. Aho-Corasick over the reversed pieces gives the longest piece that starts at each
position; a piece is taken if its pair with the one before is compatible, that is if re-merging the two gives the
two again; else the next shorter piece is tried, and where none is left the position is marked in a bitfield of
failed positions and the piece before is shortened. A text whose adjacent pairs are all compatible is the one that
merging gives, so the result equals the library's. Characters that are no piece become byte pieces, and they, as
well as a space mark after another character (no piece has one there), part a text into segments that are encoded
on their own; short segments are kept in a bounded cache.

Edge cases: a null text counts as empty; an empty text has only the begin and end ids; lone surrogates can't occur
in a column; texts of any length are encoded whole; repeated rows stay; other columns are carried by name only where
asked for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import carried, map_batches

MARK = "▁"
CACHED_CHARS, CACHED_SEGMENTS, CACHED_PAIRS = 48, 400_000, 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protobuf message; fixed-width values as bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces of a model file: text, score and kind by id."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bos, self.eos, self.unk, self.dummy_prefix = 1, 2, 0, True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, 1)))
            elif number == 2:
                f = dict(_fields(value))
                if f.get(3, 1) != 2:
                    raise ValueError("only BPE models are supported")
            elif number == 3:
                f = dict(_fields(value))
                self.dummy_prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("only models that keep white space and don't normalise are supported")
        self.bytes = [-1] * 256
        for i, (text, _, kind) in enumerate(self.pieces):
            if kind == self.BYTE:
                self.bytes[int(text[3:5], 16)] = i
            elif kind in (self.USER, self.UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")


class Codec:
    """Encoder and decoder of one model; made once in each Python worker."""

    def __init__(self, model: bytes):
        v = self.vocabulary = Vocabulary(model)
        self.score = {t: s for t, s, kind in v.pieces if kind == v.NORMAL}
        self.id_of = {t: i for i, (t, _, kind) in enumerate(v.pieces) if kind == v.NORMAL}
        self.text = [t for t, _, _ in v.pieces]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.segments: dict[str, bytes] = {}
        own = {c for t in self.score for c in t}
        if any(MARK in t.lstrip(MARK) for t in self.score):
            raise ValueError("a piece has a space mark after another character")
        # Only pieces that merging can make take part; longest first through shorter prefixes.
        self.usable = {t for t in self.score if len(t) == 1 or self.merge(t) == [t]}
        self.shorter: dict[str, str | None] = {t: next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in self.usable), None) for t in self.usable}
        self.trie = ahocorasick.Automaton()
        for t in self.usable:
            self.trie.add_word(t[::-1], t)
        self.trie.make_automaton()
        self.single = {t for t in self.usable if len(t) == 1}
        known = "".join(map(re.escape, sorted(own - {MARK})))
        # Runs of marks with the known characters after them, or one unknown character.
        self.split = re.compile(f"{MARK}+[{known}]*|[{known}]+|[^{known}{MARK}]", re.S)
        # What the decoder writes for each id.
        self.out = [b"" if kind == v.CONTROL else " ⁇ ".encode() if kind == v.UNKNOWN else bytes([int(t[3:5], 16)]) if kind == v.BYTE else t.replace(MARK, " ").encode() for t, _, kind in v.pieces]

    def merge(self, text: str) -> list[str]:
        """Merging as the library does it: the adjacent pair of the best score first, ties from the left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return found

    def pieces_of(self, segment: str) -> list[str]:
        """The pieces of a segment of known characters by backtracking."""
        n = len(segment)
        longest: list[str | None] = [None] * n
        for end, t in self.trie.iter(segment[::-1]):
            at = n - 1 - end
            if longest[at] is None or len(t) > len(longest[at]):
                longest[at] = t
        failed, out, at = bytearray(n // 8 + 1), [], 0
        t = longest[0]
        while at < n:
            last = out[-1] if out else None
            while t is not None:
                end = at + len(t)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self.fits(last, t)):
                    break
                t = self.shorter[t]
            if t is not None:
                out.append(t)
                at += len(t)
                t = longest[at] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError(f"no encoding of {segment[:80]!r}")
                t = out.pop()
                at -= len(t)
        return out

    def segment(self, s: str) -> bytes:
        if s[0] in self.single or len(s) > 1:
            ids = [self.id_of[t] for t in self.pieces_of(s)]
        else:
            of_bytes = [self.vocabulary.bytes[b] for b in s.encode("utf-8", "replace")]
            ids = of_bytes if min(of_bytes) >= 0 else [self.vocabulary.unk]
        packed = np.array(ids, "<u4").tobytes()
        if len(s) <= CACHED_CHARS:
            if len(self.segments) >= CACHED_SEGMENTS:
                self.segments.clear()
            self.segments[s] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers, begin and end included."""
        v, known = self.vocabulary, self.segments
        body = b""
        if text:
            marked = text.replace(" ", MARK)
            body = b"".join([known.get(s) or self.segment(s) for s in self.split.findall(MARK + marked if v.dummy_prefix else marked)])
        return v.bos.to_bytes(4, "little") + body + v.eos.to_bytes(4, "little")

    def decode(self, packed: bytes) -> str:
        """The text of ids; byte pieces that are no UTF-8 become U+FFFD each, as in the library."""
        ids = np.frombuffer(packed, "<u4").tolist()
        raw = b"".join(map(self.out.__getitem__, ids))
        kinds = self.vocabulary.pieces
        first = next((i for i in ids if kinds[i][2] != Vocabulary.CONTROL), None)
        cut = first is not None and self.vocabulary.dummy_prefix and kinds[first][2] == Vocabulary.NORMAL and kinds[first][0].startswith(MARK)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_parts(ids)
        return text[1:] if cut else text

    def _decode_parts(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + k]).decode())
                        at += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.vocabulary.pieces[i][2] == Vocabulary.BYTE:
                run += self.out[i]
            else:
                flush()
                out.append(self.out[i].decode())
        flush()
        return "".join(out)


_codecs: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    if name not in _codecs:
        with open(SparkFiles.get(name), "rb") as f:
            _codecs[name] = Codec(f.read())
    return _codecs[name]


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns (one named as those to come: NAME_kept), ids (binary: little-endian unsigned 32-bit integers), decoded (string).

    model is a path on the driver; the file is sent to every executor once. ``ids_array`` makes an array of ids.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(model)
    name = os.path.basename(model)
    rows, keep, schema = carried(docs, keep, text, "ids binary, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())], [*keep, "ids", "decoded"])

    return map_batches(rows, run, schema)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def ids_array(ids: Column) -> Column:
    """Packed ids as array<int>."""
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + 1 + k, F.lit(1))), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1), lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)
