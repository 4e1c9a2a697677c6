"""Byte-pair encoding with the vocabulary files of the tokenizers library, exact and fast.

``Codec`` gives for every text the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.  A text
of plain Latin characters is cut into pieces by the pattern of the tokenizer's own pre-tokenizer, and the ids
of each different piece are computed once by the library's model and kept in a bounded table; all other texts
go through the library as they are.

A piece that is longer than ``LEAF`` symbols is encoded as a tree: its halves apart, then joined.  A join
re-encodes a window of a few tokens on either side of the cut and doubles it until the window's first token
is the left half's token there and some later token of the window is one of the right half's.  Byte-pair
encoding is fixed by which neighbours are stable, so such a join is exactly the encoding of the whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import numpy as np

from cellward.llm import textops as t

#: A longer unsplit piece is encoded in halves; a text with a longer one than DEAL is dealt out over tasks for it.
LEAF, DEAL = 16, 4096
#: Entries of a worker's table of pieces, about 250 bytes each.
TABLE = 250_000

#: Texts of the characters below are cut by a pattern here; others go through the library whole.
LATIN = 0x250
#: Fixed value: the byte-level pre-tokenizer's own pattern, which its file only names; letters and digits go before the
#: contractions, which start unlike them, so that words are found at the first attempt.
BYTE_LEVEL = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _SPECIAL = re.compile(f"[^\\x00-{chr(LATIN - 1)}]"), "<|"


def _classes() -> dict[str, str]:
    """The pattern's character classes, for characters below LATIN, from the Unicode categories."""
    kinds: dict[str, str] = {r"\p{L}": "", r"\p{N}": "", r"\s": ""}
    for c in map(chr, range(LATIN)):
        kind = unicodedata.category(c)[0]
        # white space but for the information separators, which Python alone counts as such
        name = r"\p{L}" if kind == "L" else r"\p{N}" if kind == "N" else r"\s" if c.isspace() and not "\x1c" <= c <= "\x1f" else ""
        if name:
            kinds[name] += c
    return kinds


def latin_pattern(pattern: str) -> re.Pattern[str]:
    """A tokenizer's pattern for texts below LATIN, without Unicode properties."""
    inside = False
    out, at, classes = [], 0, _classes()
    while at < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, at)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            at += len(name)
        elif pattern.startswith(r"\S", at):
            out.append(f"[^{classes[chr(92) + 's']}]")
            at += 2
        else:
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at])
            at += 1
    return re.compile("".join(out))


class Pieces(dict):
    """Ids of pieces, computed when first asked for.  When full it keeps the older half, in which frequent pieces are."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= TABLE:
            for old in list(self)[TABLE // 2 :]:
                del self[old]
        ids = self.compute(piece)
        self[piece] = ids
        return ids


def codec(path: str, leaf: int = LEAF) -> Codec:
    """The worker's codec for a vocabulary file; it stays until the worker needs another or a model."""
    return t.held(("codec", path, leaf), lambda: Codec(path, leaf))


class Codec:
    def __init__(self, path: str, leaf: int = LEAF):
        self.leaf = leaf
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.bpe = self.library.model
        self.mapper = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.suffix = self.bpe.end_of_word_suffix or ""
        self.lower = self.library.normalizer is not None
        self.pattern = latin_pattern(self._written_pattern() or BYTE_LEVEL)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.token = [self.library.id_to_token(i) for i in range(size)]
        self.table = Pieces(self._piece)
        # each byte's letter in the model's alphabet, learnt from the mapper itself; bytes that UTF-8 never has stay out
        sample = "".join(map(chr, range(0x80))) + "".join(chr(c) for c in range(0x80, 0x250))
        self.letters = dict(zip(sample.encode(), self.mapper.pre_tokenize_str(sample)[0][0]))
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_pattern = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or r"(?!)")

    def _written_pattern(self) -> str | None:
        """The pattern of a splitting pre-tokenizer, if the file has one."""
        kind = json.loads(self.library.to_str())["pre_tokenizer"]
        parts = kind.get("pretokenizers", [kind])
        return next((x["pattern"]["Regex"] for x in parts if x["type"] == "Split"), None)

    # -- encoding -------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, get = [], self.table.__getitem__
        for text in texts:
            low = text.lower() if self.lower else text
            # a letter may be lower-cased to one beyond LATIN, so both are looked at
            if _SPECIAL in text or (not text.isascii() and (_OTHER.search(text) or _OTHER.search(low))):
                out.append(self._other(text))
            else:
                out.append(b"".join(map(get, self.pattern.findall(low))))
        return out

    def _piece(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1").translate(self.letters)
        ids = self.leaf_ids(symbols) if len(symbols) <= self.leaf else self.tree(symbols)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _other(self, text: str) -> bytes:
        if not re.search(rf"\S{{{DEAL + 1}}}|\s{{{DEAL + 1}}}", text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids: list[int] = []
        for kind, symbols in self.split(text):
            ids += [int(symbols)] if kind == "id" else self.tree(symbols)
        return np.array(ids, "<u4").tobytes()

    def symbols(self, piece: str) -> str:
        """A piece in the model's alphabet, in which a character stands for a byte."""
        return self.mapper.pre_tokenize_str(piece)[0][0]

    def split(self, text: str):
        """("id", special token's id) and ("piece", symbols) in the order of the text."""
        at = 0
        for m in [*self.special_pattern.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                if self.library.normalizer is not None:
                    part = self.library.normalizer.normalize_str(part)
                for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                    yield "piece", symbols
            if m:
                yield "id", str(self.special[m[0]])
                at = m.end()

    # -- the tree -------------------------------------------------------------------------------------

    def leaves(self, symbols: str, leaf: int = LEAF) -> list[str]:
        """Halves of halves, none longer than ``leaf``."""
        if len(symbols) <= leaf:
            return [symbols]
        half = len(symbols) // 2
        return self.leaves(symbols[:half], leaf) + self.leaves(symbols[half:], leaf)

    def leaf_ids(self, symbols: str) -> list[int]:
        return [t.id for t in self.bpe.tokenize(symbols)] if symbols else []

    def tree(self, symbols: str, leaf: int = LEAF) -> list[int]:
        return self.concatenate([self.leaf_ids(x) for x in self.leaves(symbols, leaf)])

    def concatenate(self, parts: list[list[int]]) -> list[int]:
        """Ids of one piece from those of consecutive parts of it, joined pair by pair."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def _text(self, i: int) -> str:
        return self.token[i].removesuffix(self.suffix) if self.suffix else self.token[i]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of a piece from those of its two parts, each encoded as a piece."""
        if not left or not right:
            return left or right
        k = 4
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = self.leaf_ids("".join(map(self._text, left[-a:])) + "".join(map(self._text, right[:b])))
            cut = sum(len(self._text(i)) for i in left[-a:])
            from_left = a == len(left) or (a > 1 and window[0] == left[-a])
            ends, at = {}, cut
            for n, i in enumerate(right[:b]):
                ends[at, i] = n
                at += len(self._text(i))
            if b == len(right):
                tail = len(window), b
            else:
                tail, at = None, at
                places, p = [], 0
                for i in window:
                    places.append(p)
                    p += len(self._text(i))
                for n in range(len(window) - 2, -1, -1):  # the last token was cut, so it proves nothing
                    if (places[n], window[n]) in ends:
                        tail = n + 1, ends[places[n], window[n]] + 1
                        break
            if from_left and tail:
                return left[: len(left) - a] + window[: tail[0]] + right[tail[1] :]
            if a == len(left) and b == len(right):
                return window
            k *= 2

    # -- decoding -------------------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.library.decoder is not None:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
