"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is one token that its encoding ends with. An Aho-Corasick
automaton over the vocabulary gives the tokens that end at a position; a token is the
last one of the prefix if it goes with the last token of the prefix before it, that
is, if merging the two would not have made another token across their border first.
Back-pointers from the end then give the ids.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, mapped

# Ranges that the tokenizer's Unicode tables (16.0) leave unassigned and
# newer ones do not.
LATER = (
    "\\u0558 \\u058b-\\u058c \\u088f \\u0c5c \\u0cdc \\u208f \\u209d-\\u209f \\ua7ce-\\ua7cf \\ua7d2 \\ua7d4 \\ua7dd "
    "\\ua7e2 \\ua7f1 \\uab6c-\\uab6d \\U000107bb-\\U000107bf \\U00010940-\\U00010959 \\U00010ec5-\\U00010ec7 "
    "\\U00010ed9-\\U00010eee \\U00011b0a \\U00011db0-\\U00011ddb \\U00011de0-\\U00011de9 \\U00011df1 \\U0001246f "
    "\\U00012475-\\U0001247f \\U00012550-\\U00012686 \\U00016ea0-\\U00016eb8 \\U00016ebb-\\U00016ed3 "
    "\\U00016ff2-\\U00016ff6 \\U000187f8-\\U000187ff \\U00018cd6-\\U00018cda \\U00018d09-\\U00018d20 "
    "\\U00018d80-\\U00018df2 \\U00018e00-\\U00019191 \\U000191a0-\\U000191d2 \\U0001b123-\\U0001b128 \\U0001b168 "
    "\\U0001d6a6 \\U0001df1f-\\U0001df24 \\U0001df2b-\\U0001df81 \\U0001df90-\\U0001df96 \\U0001dfcd-\\U0001dfff "
    "\\U0001e6c0-\\U0001e6de \\U0001e6e0-\\U0001e6e2 \\U0001e6e4-\\U0001e6e5 \\U0001e6e7-\\U0001e6ed "
    "\\U0001e6f0-\\U0001e6f4 \\U0001e6fe-\\U0001e6ff \\U0002b73a-\\U0002b73f \\U0002b81e \\U0002cea2-\\U0002cead "
    "\\U000323b0-\\U00033479 \\U0003d000-\\U0003fc3f"
).replace(" ", "")
_LETTER, _NUMBER = rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]"
#: The format's rule for cutting text into pieces that are encoded on their own.
PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?(?:(?!{_LETTER}|{_NUMBER})\S)+|\s+(?!\S)|\s+", regex.V1
)
#: The same for text whose letters are all of Latin alphabets, where it is quicker.
_LATIN = re.compile(r"[\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\u01ff]*")
_LATIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")

#: Words, pieces and pairs that an encoder remembers: so many of each twice.
_REMEMBERED = 240_000
#: Marks that are a piece of their own behind a letter and at the end of a word.
_MARKS = frozenset(".,;:!?)")
_FIRST_LATER = "\u0558"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(shown)))
    return [letters[b] for b in range(256)]


def pieces(text: str) -> list[str]:
    return (_LATIN_PIECE if _LATIN.fullmatch(text) else PIECE).findall(text)


class _Spaced(Exception):
    """A run of white space that cannot be cut at single spaces."""


class Bpe:
    """A byte-level vocabulary with its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.letters = bytes.maketrans(b"", b"").decode("latin-1").translate(dict(enumerate(letters)))
        to_byte = {letter: b for b, letter in enumerate(letters)}
        self.rank: dict[int, int] = {}  # by left * size + right
        self.size = size = 1 + max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        made = [-1] * size  # merge that makes the token, -1 for single bytes
        parts = [(i, i) for i in range(size)]
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left * size + right] = k
            if made[whole] < 0:
                made[whole], parts[whole] = k, (left, right)
        self.made, self.parts = made, parts
        self.bytes: list[bytes] = [b""] * size
        self.single = {letter: self.vocab[letter] for letter in letters if letter in self.vocab}
        self.automaton = ahocorasick.Automaton()
        whole = set()  # tokens that their own text is encoded as
        for token, i in sorted(self.vocab.items(), key=lambda item: made[item[1]]):
            if all(letter in to_byte for letter in token):
                self.bytes[i] = bytes(map(to_byte.get, token))
                a, b = parts[i]
                if made[i] < 0 or a in whole and b in whole and self.goes_with(a, b, made[i]):
                    whole.add(i)
                    if len(token) > 1:
                        self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in added.items():
            self.bytes[i] = content.encode()
        self.added = added
        self.starts = np.cumsum([0, *map(len, self.bytes)])
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.split_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def goes_with(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge across the border would have come before those that made the two.

        Undoes the merges next to the border, latest first. A pair across the border
        that ranks before the merge just undone would have been merged instead; of
        equal ranks the one further left comes first.
        """
        rank, made, size = self.rank, self.made, self.size
        while True:
            across = rank.get(left * size + right)
            if across is not None and across < before:
                return False
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.parts[left][1]
            else:
                before, right = b + 1, self.parts[right][0]

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are not UTF-8 become replacement characters."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        starts = self.starts[tokens]
        lengths = self.starts[tokens + 1] - starts
        ends = np.cumsum(lengths)
        shift = np.repeat(starts - ends + lengths, lengths)
        return self.joined[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace")


class Encoder:
    """Encodes texts; remembers pieces, so it should not outlive a task."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.size = bpe.size
        #: Whether two tokens go together, by left * size + right.
        self.known: dict[int, bool] = {}
        self.piece = Recent(lambda piece: self._encode_letters(piece.encode().decode("latin-1").translate(bpe.letters)))
        self.after_space = Recent(self._encode_after_space, _REMEMBERED)
        self.space = bpe.letters[0x20]

    def _encode_letters(self, text: str) -> bytes:
        """Ids of a piece, given in the vocabulary's letters, as little-endian 32-bit integers."""
        n, known, size = len(text), self.known, self.size
        # The token that the prefix up to each letter ends with, and the letter before it.
        # Longer tokens are tried first; if none fits, it is the letter's own.
        last, before = list(map(self.bpe.single.__getitem__, text)), list(range(-1, n - 1))
        settled = -1
        for end, (length, token) in self.bpe.automaton.iter(text):
            if end == settled:
                continue
            start = end - length
            if start >= 0:
                pair = last[start] * size + token
                try:
                    fits = known[pair]
                except KeyError:
                    fits = self._fits(pair)
                if not fits:
                    continue
            last[end], before[end], settled = token, start, end
        ids, end = [], n - 1
        while end >= 0:
            ids.append(last[end])
            end = before[end]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _fits(self, pair: int) -> bool:
        if len(self.known) >= 2 * _REMEMBERED:
            self.known.clear()
        fits = self.known[pair] = self.bpe.goes_with(*divmod(pair, self.size))
        return fits

    def _encode_after_space(self, word: str) -> bytes:
        # Letters that bytes and vocabulary share, with a mark behind them or not.
        if word.isascii():
            if word.isalpha():
                return self._encode_letters(self.space + word)
            if word[-1:] in _MARKS and word[:-1].isalpha():
                return self.after_space[word[:-1]] + self.piece[word[-1]]
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Spaced
        found = [" " + word] if word.isalpha() and max(word) < _FIRST_LATER else pieces(" " + word)
        if len(found) == 1:  # remembered as a word
            return self._encode_letters(found[0].encode().decode("latin-1").translate(self.bpe.letters))
        return b"".join(map(self.piece.__getitem__, found))

    def _encode_plain(self, text: str) -> bytes:
        # A single space between other letters always starts a piece, so the words
        # after it are cut and remembered on their own; other text is cut as a whole.
        first, *words = text.split(" ")
        try:
            if first and not first[-1].isspace():
                rest = b"".join(map(self.after_space.__getitem__, words))
                return b"".join(map(self.piece.__getitem__, pieces(first))) + rest
        except _Spaced:
            pass
        return b"".join(map(self.piece.__getitem__, pieces(text)))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian 32-bit integers."""
        if not self.bpe.split_added or not any(content in text for content in self.bpe.added):
            return self._encode_plain(text) if text else b""
        out, at = [], 0
        for found in self.bpe.split_added.finditer(text):
            out.append(self._encode_plain(text[at : found.start()]) if found.start() > at else b"")
            out.append(struct.pack("<I", self.bpe.added[found[0]]))
            at = found.end()
        out.append(self._encode_plain(text[at:]) if at < len(text) else b"")
        return b"".join(out)


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: the text's ids as packed little-endian 32-bit integers.

    NULL is encoded as empty text. Strings of special tokens in a text become these.
    A column ``ids`` of the input is replaced. ``path`` names a vocabulary file that
    every executor can open.
    """
    
    def start():
        encoder = Encoder(load(path))
        return lambda texts: [pa.array([encoder.encode(t or "") for t in texts], pa.binary())]

    return mapped(df, text, {ids: "binary"}, start)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``: what packed ``ids`` stand for, special tokens included; NULL is empty."""
    
    def start():
        bpe = load(path)
        return lambda packed: [pa.array([bpe.decode(p or b"") for p in packed], pa.string())]

    return mapped(df, ids, {text: "string"}, start)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass."""

    def start():
        bpe = load(path)
        encoder = Encoder(bpe)

        def both(texts: list[str | None]) -> list[pa.Array]:
            packed = [encoder.encode(t or "") for t in texts]
            return [pa.array(packed, pa.binary()), pa.array(map(bpe.decode, packed), pa.string())]

        return both

    return mapped(df, text, {ids: "binary", decoded: "string"}, start)


def op2_bpe(docs: DataFrame, path: str) -> DataFrame:
    """Length and digests of every text's ids and of the text decoded from them."""
    both = round_trip(docs.select("doc_id", "text"), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
