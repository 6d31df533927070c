"""Byte-pair encoding by dynamic programming over prefixes, and decoding (operator 4).

A text is cut into pieces by the tokenizer's pattern. For each prefix of a piece one token alone can be
the last of the prefix's encoding. An automaton whose suffix links lead from a token to its longest
suffix that is a token as well yields the tokens that end at a place; a token is the last one there if
it is compatible with the last token of the prefix before it, that is if byte-pair merging would leave
the two side by side. Back-pointers from the end give the exact ids. The work is linear in the text.

The vocabulary file is a parameter (the ``tokenizers`` library's JSON) and is read once per worker.

Defined cases: a null text is an empty one, with no ids; null ids decode to an empty text; ids that the
vocabulary lacks decode to nothing, null ids within an array likewise; bytes that are no UTF-8 decode to
U+FFFD; strings of added tokens inside a text become those tokens; repeated rows and empty tables need no
care.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of byte-level pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the pattern's \s means.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that need no look at Unicode tables.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: A run of space and the word after it, if an ASCII character that is no letter follows; else a run of
#: space and all that follows it. A piece never reaches from other characters into space, nor from
#: letters into such characters, so these chunks hold whole pieces.
CHUNK = re.compile(rf"[{SPACE}]*[{LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A chunk that is one piece.
WORD = re.compile(f" ?[{LETTERS}]+")
#: Chunks, pieces and pairs that a worker remembers in each of two generations.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the others
    for the letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Remembered(dict):
    """Results of ``make`` by argument, bounded in number: what was not asked for while ``most`` others
    were is forgotten."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class BytePairs:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        # rank at which a token is made by merging, and the two tokens that it is made of
        self.made, self.left, self.right, self.rank = [-1] * size, [0] * size, [0] * size, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = rank
            self.made[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
        self.length = [len(b) for b in self.bytes_of]
        self.suffixes = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.suffixes.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.suffixes.make_automaton()
        self.size = size
        self.pair = Remembered(lambda key: self._compatible(*divmod(key, size)))
        self.piece = Remembered(self._piece)
        self.chunk = Remembered(self._chunk)
        self.pattern = regex.compile(PIECES)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the two tokens apart. Their inner sides are taken back merge by merge,
        the latest first; at each state a merge across the border would have come first if it ranks
        before the merge just taken back. Among equal merges the one further left comes first."""
        until_a = until_b = float("inf")
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < until_a and across <= until_b:
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_b >= made_a:
                until_b, b = made_b, self.left[b]
            else:
                until_a, a = made_a, self.right[a]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as int32 bytes."""
        letters = piece.encode().decode("latin-1")
        last, length, pair, size = [-1] * len(letters), self.length, self.pair, self.size
        for end, token in self.suffixes.iter(letters):
            if last[end] < 0:
                before = end - length[token]
                if before < 0 or pair[last[before] * size + token]:
                    last[end] = token
        ids, at = array("i"), len(letters) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids.tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if WORD.fullmatch(chunk):
            return self._piece(chunk)
        return b"".join([self.piece[p] for p in self.pattern.findall(chunk)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32 bytes. Long chunks and pieces are not remembered."""
        if self.between and any(t in text for t in self.added):
            return b"".join([array("i", [self.added[p]]).tobytes() if p in self.added else self._plain(p) for p in self.between.split(text)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        chunk = self.chunk
        return b"".join([chunk[c] if len(c) < 64 else self._long(c) for c in CHUNK.findall(text)])

    def _long(self, chunk: str) -> bytes:
        return b"".join([self.piece[p] if len(p) < 64 else self._piece(p) for p in self.pattern.findall(chunk)])

    def decode(self, ids: np.ndarray) -> str:
        table, n = self.bytes_of, len(self.bytes_of)
        return b"".join([table[i] for i in ids.tolist() if 0 <= i < n]).decode("utf-8", "replace")


@lru_cache(2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _ids(pairs: BytePairs, texts: pa.Array) -> pa.ListArray:
    coded = [pairs.encode(t.as_py() or "") for t in texts]
    offsets = np.zeros(len(coded) + 1, np.int32)
    np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _texts(pairs: BytePairs, lists: pa.ListArray) -> pa.StringArray:
    return pa.array([pairs.decode(x.values.drop_null().to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in lists], pa.string())


def encode(text: Column, path: str) -> Column:
    """Token ids of a text (array of int)."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        return _ids(byte_pairs(path), texts)

    return ids_of(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        return _texts(byte_pairs(path), lists)

    return text_of(ids)


def round_trip(text: Column, path: str) -> Column:
    """Struct of the ids of a text and of what these decode to. One call for both: Spark would run the
    encoder again inside ``decode(encode(text))`` if the ids are wanted as well."""

    @F.arrow_udf("ids array<int>, decoded string")
    def both(texts: pa.Array) -> pa.Array:
        pairs = byte_pairs(path)
        ids = _ids(pairs, texts)
        return pa.StructArray.from_arrays([ids, _texts(pairs, ids)], ["ids", "decoded"])

    return both(text)
