"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled once into three machines: the normaliser (its character map as a trie with outputs, white space, the dummy
prefix), the pieces as a trie whose final states write a piece, and the byte fallback, which reads a character that no piece spells and
writes its bytes' pieces. Their composition with an input is a lattice whose states are positions with the piece that ends
there. An arc weighs one, or infinitely much where a byte-pair encoder could not leave its piece beside the last one. That is read off
the two pieces' compiled derivations: of the last piece the ever longer parts that end it, of the next one those that begin it, each with
the rank of the merge that takes it; two parts that merge across the border before either is taken make the weight infinite. Each
position has one finite path from the start, so arcs are relaxed in the order of positions, in time linear in the input's
length, and the tropical semiring's shortest path is the encoder's own result.

Pieces never join two words, so that the lattice falls apart before each word's white space and around each character
that no longer piece contains. The paths of words and the weights of pairs are kept in bounded tables.

Byte-pair models with byte fallback are compiled, with any character map; others raise a ValueError, as do user-defined pieces and models that
don't write spaces as a piece's mark. Control pieces are never read from a text and decode to nothing.

Null text is empty and has no ids. An empty table gives an empty result. Rows, repeated ones too, are encoded each for itself; a very long
text or word takes time and memory in proportion. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from skein.llm import common as C

SPACE = "▁"
#: Paths of words and weights of pairs kept before a table is emptied; words of more characters than LONGEST are not kept.
PATHS, PAIRS, LONGEST = 600_000, 600_000, 64
_NORMAL, _UNKNOWN, _DEFINED, _BYTE = 1, 2, 4, 6


def _fields(b: bytes):
    """(number, value) of a protocol buffer's fields."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if b[i - 1] < 128:
                return value

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, b[i : i + n]
            i += n


def character_map(blob: bytes) -> dict[bytes, str]:
    """What a precompiled character map reads and writes: a double-array trie of 32-bit units after its size, then the outputs, each ended by a zero."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, outputs = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    found = {}

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    todo = [(b"", offset(units[0]))]
    while todo:
        read, base = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at >= len(units) or units[at] & 0x800000FF != c:
                continue
            below = at ^ offset(units[at])
            if units[at] >> 8 & 1:
                start = units[below] & 0x7FFFFFFF
                found[read + bytes([c])] = outputs[start : outputs.index(b"\0", start)].decode()
            todo.append((read + bytes([c]), below))
    return found


class Normaliser:
    """Reads a text and writes it as the pieces spell it: the longest entry of the character map at each place, white space as U+2581."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool):
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.written = {read.decode(): text for read, text in character_map(charsmap).items()}
        longest_first = sorted(self.written, key=len, reverse=True)
        by_first: dict[str, list[str]] = {}
        for read in longest_first:
            by_first.setdefault(read[0], []).append(read)
        self._one = {ord(c): self.written[c] for c, own in by_first.items() if own == [c]}
        several = [re.escape(read) for own in by_first.values() if len(own) > 1 or len(own[0]) > 1 for read in own]
        self._several = re.compile("|".join(several)) if several else None

    def __call__(self, text: str) -> str:
        if self._several:
            # Places that start longer entries first; what stands between them goes through the map of single characters.
            out, at = [], 0
            for m in self._several.finditer(text):
                out += [text[at : m.start()].translate(self._one), self.written[m[0]]]
                at = m.end()
            text = "".join(out) + text[at:].translate(self._one)
        elif self._one:
            text = text.translate(self._one)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE)


class Transducer:
    def __init__(self, path: str):
        self.pieces: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        dummy_prefix, squeeze, charsmap, model_type, suffix = True, True, b"", 1, 0
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                if own.get(3, _NORMAL) == _DEFINED:
                    raise ValueError("user-defined pieces aren't supported")
                piece, kind, at = own[1].decode(), own.get(3, _NORMAL), len(self.text)
                self.text.append(bytes([int(piece[3:5], 16)]) if kind == _BYTE else piece.encode() if kind == _NORMAL else " ⁇ ".encode() if kind == _UNKNOWN else b"")
                if kind == _BYTE:
                    self.bytes[int(piece[3:5], 16)] = at
                elif kind == _NORMAL:
                    self.pieces[piece] = at
                    self.rank[piece] = -float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
            elif number == 2:
                own = dict(_fields(value))
                model_type, suffix = own.get(3, 1), own.get(24, 0)
            elif number == 3:
                own = dict(_fields(value))
                dummy_prefix, squeeze, charsmap = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
                if not own.get(5, 1):
                    raise ValueError("models that keep spaces as they are aren't supported")
        if model_type != 2 or len(self.bytes) != 256 or suffix:
            raise ValueError("only byte-pair models with byte fallback and white space before words are compiled")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces that join words aren't supported")
        self.dummy_prefix = dummy_prefix
        self.normalised = Normaliser(charsmap, dummy_prefix, squeeze)
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        self._parts = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._paths: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}
        self._compile()

    def _compile(self) -> None:
        """The trie of the pieces that stand by themselves, and the parts that end and that begin each with the ranks of the merges that take them."""
        self._next: list[dict[str, int]] = [{}]
        self._final: list[int] = [-1]
        self._names: list[str] = []
        self._ids: list[bytes] = []
        self._ends: list[list[tuple[str, float]] | None] = []
        self._begins: list[list[tuple[str, float]] | None] = []
        for piece, at in self.pieces.items():
            merges: list[tuple[str, str]] = []
            if self.merged(piece, merges) != [piece]:
                continue
            state = 0
            for c in piece:
                if c not in self._next[state]:
                    self._next[state][c] = len(self._next)
                    self._next.append({})
                    self._final.append(-1)
                state = self._next[state][c]
            self._final[state] = len(self._names)
            self._names.append(piece)
            self._ids.append(np.array([at], "<u4").tobytes())
            ranks = [self.rank[a + b] for a, b in merges]
            if ranks != sorted(ranks):  # merges in another order than their ranks: left to the definition
                self._ends.append(None)
                self._begins.append(None)
                continue
            end, begin, ends, begins = piece[-1], piece[0], [], []
            right, left = len(piece) - 1, 0  # where the part that ends the piece starts; how far the part that begins it goes
            for (a, b), r in zip(merges, ranks):
                if b == end and a + b == piece[right - len(a) :]:
                    ends.append((end, r))
                    end, right = a + b, right - len(a)
                if a == begin and a + b == piece[: len(a + b)] and len(a) == left + 1:
                    begins.append((begin, r))
                    begin, left = a + b, len(a + b) - 1
            exact = end == piece and begin == piece
            self._ends.append([*ends, (piece, np.inf)] if exact else None)
            self._begins.append([*begins, (piece, np.inf)] if exact else None)

    def merged(self, text: str, merges: list | None = None) -> list[str]:
        """Byte-pair encoding by its definition: the best pair first, of equal pairs the first one. merges gets the pairs in order."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if merges is not None:
                merges.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the weight of going from piece a to piece b is finite."""
        ends, begins = self._ends[a], self._begins[b]
        if ends is None or begins is None:
            return self.merged(self._names[a] + self._names[b]) == [self._names[a], self._names[b]]
        rank, i, j = self.rank, 0, 0
        while True:
            (x, takes_x), (y, takes_y) = ends[i], begins[j]
            across = rank.get(x + y)
            # Of equal merges the first in the text comes first: that which takes x, then the one across.
            if across is not None and across < takes_x and across <= takes_y:
                return False
            if takes_x == takes_y == np.inf:
                return True
            if takes_x <= takes_y:
                i += 1
            else:
                j += 1

    def shortest(self, word: str) -> list[int]:
        """The pieces of the shortest path through a word's lattice; -1 is a character that no piece spells."""
        n, follow, final, pairs = len(word), self._next, self._final, self._pairs
        if len(pairs) > PAIRS:
            pairs.clear()
        last: list[int | None] = [None] * (n + 1)  # of each position, the piece that ends there
        for i in range(n):
            before, state, j = last[i] if i else -1, 0, i
            while j < n:
                state = follow[state].get(word[j], 0)
                if not state:
                    break
                j += 1
                piece = final[state]
                if piece >= 0 and last[j] is None:
                    if before >= 0:
                        key = before << 32 | piece
                        ok = pairs.get(key)
                        if ok is None:
                            ok = pairs[key] = self.side_by_side(before, piece)
                        if not ok:
                            continue
                    last[j] = piece
            if last[i + 1] is None:
                last[i + 1] = -1
        out, at = [], n
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(self._names[piece]) if piece >= 0 else 1
        return out[::-1]

    def _path(self, word: str) -> bytes:
        pieces, ids = self.shortest(word), self._ids
        if -1 not in pieces:
            return b"".join([ids[p] for p in pieces])
        out, at = [], 0
        for p in pieces:
            size = len(self._names[p]) if p >= 0 else 1
            out.append(ids[p] if p >= 0 else np.array([self.bytes[x] for x in word[at].encode()], "<u4").tobytes())
            at += size
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The text's ids, little-endian unsigned 32-bit."""
        words = self._parts.findall(self.normalised(text))
        found = list(map(self._paths.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    word = words[i]
                    x = self._paths.get(word)
                    if x is None:
                        if len(self._paths) > PATHS:
                            self._paths.clear()
                        x = self._path(word)
                        if len(word) <= LONGEST:
                            self._paths[word] = x
                    found[i] = x
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the transducer the other way round."""
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One for each worker and file."""
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip (whether decoding gives the text back), and ids if asked for."""
    C.prepare(docs.sparkSession)

    def run(batches):
        m = machine(model)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                own = pdf.iloc[i : i + 256]
                rows = []
                for doc, raw in zip(own["doc_id"], own["text"]):
                    text = raw.decode("utf-8", "replace")
                    ids = m.encode(text)
                    a = np.frombuffer(ids, "<u4")
                    rows.append((doc, len(a), zlib.crc32(ids), m.decode(a) == text, *([a] if keep_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_crc32", "round_trip"] + ["ids"] * keep_ids)

    return C.shown(C.texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<long>" * keep_ids))


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column text decoded from ids (null: null); a column of that name is replaced."""
    C.prepare(rows.sparkSession)
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        m = machine(model)
        return column.map(lambda ids: None if ids is None else m.decode(np.asarray(ids, np.int64)))

    return rows.withColumn("text", text_of(ids_col))
