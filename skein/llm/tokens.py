"""Whole-text token ids from a public tokenizer file, a piece at a time with a bounded table of pieces already encoded.

A byte-level BPE pre-tokenizer starts a new token wherever white space follows another character, and one that drops
white space starts one at any; so encoding such pieces apart gives the ids of the whole text. Texts with the few
characters that Python alone calls white space are encoded whole, and so are texts that hold the string of an added token in any case: as the
library does by default, such a string is that token's id. With special=False the strings of special tokens are ordinary text.

Whether a file's normaliser and pre-tokenizer are of these kinds is tried when it is loaded, on texts of many kinds against
the library; if any differs, that file's texts are always encoded whole. An empty text has no ids; a very long one is held whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from skein.llm import common as C

#: Pieces kept before the table is emptied: some 180 MB.
PIECES = 700_000
#: Unknown pieces encoded at once, and the longest piece that is kept.
BATCH, LONGEST = 4096, 256

_WHOLE = "\x00\x1c\x1d\x1e\x1f"
#: White space other than the space and the line feed, and those of _WHOLE: one scan tells that a text has none.
_odd = re.compile(r"[\x00-\x09\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_piece = re.compile(r"\s*\S+|\s+")
#: A word of Latin letters and the punctuation after it: pre-tokenizers always part them.
_word, _MARKS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,!?;:*#$%&|"


def _flat(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _letters_of_bytes() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a character: printable ones as themselves, the others as those from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_byte_letters = _letters_of_bytes()


def _trials(vocabulary: dict[str, int]) -> list[str]:
    """Texts that show what a tokenizer does with cases, marks, digits, spaces, lines, joined marks, other scripts and the starts and ends of its own entries."""
    words = ["Hello", "hello", "HELLO", "don't", "it's", "a1b2", "x_y", "café", "Ünder", "naïve.", "end.", "(so)", "10,000", "#tag", "日本語", "Ελλάδα", "мир", "😀", "e\u0301", "ﬁx", "İ", "<s>", "\u200b"]
    entries = [x.strip("Ġ▁") for x in sorted(vocabulary, key=vocabulary.get)[:: max(1, len(vocabulary) // 300)]]
    joined = [f"{a}{gap}{b}" for a in words for b in words[::3] for gap in (" ", "  ", "\n", "\t", "\n\n", " \n ", "")]
    return ["", " ", "\n", " a", "a ", "\r\n", "...", "!?", *words, *joined, " ".join(words), " ".join(entries), *entries]


class PieceEncoder:
    """encode(texts) gives each text's ids as unsigned 32-bit arrays. keep_space: a space belongs to the piece after it.

    A piece's key is the piece after a zero byte; of a piece that starts with a single space, what follows the space.
    A word with punctuation behind it is put together from the two, and a tokenizer that lowers case sees a word in lower
    case only; so far fewer pieces than there are spellings go through the tokenizer.
    """

    def __init__(self, path: str, keep_space: bool, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.keep_space, self.known, self.parts, self.whole = keep_space, {}, {}, False
        trials = _trials(self.tokenizer.get_vocab()) + [x for t in added for x in (t, f"a{t}b", f"so {t} it is", f"{t.upper()} {t}")]
        try:
            self.whole = self.encode(trials) != self._whole(trials)
        except Exception:  # an entry that the model can't read apart
            self.whole = True
        self.known.clear()

    def keys(self, text: str) -> list[str]:
        if self.added is not None and self.added.search(text) is not None:
            return ["\0" + text]
        if not self.keep_space:
            if any(c in text for c in _WHOLE):
                return ["\0" + text]
            # A tokenizer of this kind lowers case; up to U+00FF, text may be lowered at once.
            return (text.lower() if text.isascii() or len(text.encode("latin-1", "ignore")) == len(text) else text).split()
        odd = _odd.search(text) is not None
        if odd and any(c in text for c in _WHOLE):
            return ["\0" + text]
        if odd or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace():
            return ["\0" + p for p in _piece.findall(text)]
        out: list[str] = []
        for line in text.split("\n"):
            if out:
                out.append("\0\n")
            words = line.split(" ")
            words[0] = "\0" + words[0]
            out += words
        return out

    def _learned(self, keys: list[str]) -> dict[str, bytes]:
        """The ids of keys that the table doesn't have. A bare word needs no normaliser or pre-tokenizer: the model itself reads it."""
        if len(self.parts) > PIECES // 2:
            self.parts.clear()
        parts, out, odd, space = self.parts, {}, [], self.keep_space
        for k in keys:
            word = k.rstrip(_MARKS)
            tail = k[len(word) :]
            if not space:
                word = word.lower()
            ids = parts.get(word)
            if ids is None:
                if _word.fullmatch(word) is None:
                    odd.append(k)
                    continue
                read = word if word.isascii() else word.encode().decode("latin-1").translate(_byte_letters)
                ids = parts[word] = _flat([t.id for t in self.model.tokenize("Ġ" + read if space else read)])
            if tail:
                end = parts.get("\0" + tail)
                if end is None:
                    end = parts["\0" + tail] = self._encoded(["\0" + tail])[0]
                ids += end
            out[k] = ids
        for i in range(0, len(odd), BATCH):
            out.update(zip(odd[i : i + BATCH], self._encoded(odd[i : i + BATCH])))
        return out

    def _encoded(self, keys: list[str]) -> list[bytes]:
        pieces = [k[1:] if k[:1] == "\0" else " " + k if self.keep_space else k for k in keys]
        e = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, "<u4").tobytes()
        ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(keys) + 1)).tolist()
        return [ids[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        if self.whole:
            return self._whole(texts)
        if len(self.known) > PIECES:
            self.known.clear()
        keys = [self.keys(t) for t in texts]
        found = [list(map(self.known.get, own)) for own in keys]
        missing = [(own, ids, [i for i, x in enumerate(ids) if x is None]) for own, ids in zip(keys, found) if None in ids]
        new = list({own[i] for own, _, at in missing for i in at})
        learned = self._learned(new)
        for own, ids, at in missing:
            for i in at:
                ids[i] = learned[own[i]]
        self.known.update(x for x in learned.items() if len(x[0]) <= LONGEST)
        return [b"".join(ids) for ids in found]


_encoders: dict[tuple[str, bool, bool], PieceEncoder] = {}
C.held_tables.append(_encoders)


def encoder(path: str, keep_space: bool, special: bool = True) -> PieceEncoder:
    """One for each worker, file and reading of special tokens' strings."""
    key = path, keep_space, special
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]
