"""BPE encoding and decoding with a contiguous array of ranks.

A word is held as its part ids, cut at the part boundaries, beside the ranks of all adjacent
parts.  The least rank is sought by a scan, its boundary deleted, and the two neighbouring
ranks are refreshed, until no adjacent parts can be merged.  Words longer than ``LONG`` parts
go by a heap over the same ranks instead, since scans of a long array would be quadratic;
both orders are least rank first, then leftmost, so the results are equal.

Spark deals the texts; in a task, words already seen come from a cache of two bounded halves,
of which the older goes when the newer is full: words in use move over and outlive rare ones.  Special
tokens are found in the raw text first.  The library's Unicode tables are older than those
here: what it does not know is stated as fixed values, and pieces of text that hold such a
character go by patterns that leave it out.  Defined results: null and empty texts have no
tokens and decode to the empty text; each row stands for itself.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import fresh

LONG = 64
#: Words kept by a worker, about 400 bytes each, and texts encoded at a time.
CACHE = 150_000
HALF = CACHE // 2
TEXTS = 512
# Code points, in hexadecimal, whose later Unicode properties the library lacks.
# Letters and numbers that are neither to it:
LATE_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8
16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
LATE_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Marks that combine with nothing and reorder nothing there; 11930 joins to 11938 only here:
LATE_MARKS = """
7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27
10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930
1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1
1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
# Capitals that only the library lowers: first, last, and the lower case of the first.
LATE_CAPITALS = """
1C89-1C89:1C8A A7CB-A7CB:264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5
A7DA-A7DA:A7DB A7DC-A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"""
# End of the fixed values.


def _class(ranges: str) -> str:
    """The members of a character class, from ranges of code points."""
    ends = (r.split("-") for r in ranges.split())
    return "".join(f"\\U{int(e[0], 16):08X}-\\U{int(e[-1], 16):08X}" for e in ends)


def _lowered(capitals: str) -> dict[int, int]:
    found = {}
    for rule in capitals.split():
        span, to = rule.split(":")
        first, last = (int(x, 16) for x in span.split("-"))
        found.update(zip(range(first, last + 1), range(int(to, 16), 0x110000)))
    return found


LOWERED = _lowered(LATE_CAPITALS)
_MARK = regex.compile(f"([{_class(LATE_MARKS)}])")
_LATE = regex.compile(f"[{_class(LATE_LETTERS)}{_class(LATE_NUMBERS)}{_class(LATE_MARKS)}"
                      f"{''.join(map(chr, LOWERED))}]")
_WIDE = re.compile("[\U00010000-\U0010FFFF]")
#: A character class, and a property that a class of code points can stand for inside one.
_IN_BRACKETS = re.compile(r"\[(?:\\.|[^\]\\])*\]")
_PROPERTY = re.compile(r"\\p\{\w+\}|\\s")
NO_RANK = 1 << 60


def _listed(kind: str) -> str:
    """The code points up to FFFF of a property, as ranges inside a character class."""
    narrow = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    spans = (m.span() for m in regex.finditer(f"(?:{kind})+", narrow))
    return "".join(f"\\u{ord(narrow[a]):04X}-\\u{ord(narrow[b - 1]):04X}" for a, b in spans)


_NARROW_LATE = re.compile(f"[{_listed(_LATE.pattern)}]")


def plain(pattern: str):
    """The pattern with its properties written out, which the faster ``re`` can match in pieces
    without code points beyond FFFF; None if a property stands outside a character class."""
    if _PROPERTY.search(_IN_BRACKETS.sub("", pattern)):
        return None
    return re.compile(_PROPERTY.sub(lambda m: _listed(m[0]), pattern))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one beyond Latin-1."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return letters


class WordPieces:
    """A vocabulary with its merges, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        #: The rank of a pair of parts, and the part that a rank makes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks[self.vocab[left], self.vocab[right]] = rank
            self.made.append(self.vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        (split,) = (p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.plain_words = plain(pattern) or self.words
        letters, numbers = _class(LATE_LETTERS), _class(LATE_NUMBERS)
        self.strict_words = regex.compile(
            pattern.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]")
            .replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]"), regex.V1)
        self.marks = regex.compile("|".join(
            f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        self.seen: dict[str, tuple[bytes, str, str]] = {}
        self.older: dict[str, tuple[bytes, str, str]] = {}

    def _parts(self, word: str) -> list[int]:
        said = word.encode()
        parts = [self.inner[b] for b in said]
        parts[-1] = self.last[said[-1]]
        return parts

    def merge(self, parts: list[int]) -> list[int]:
        """Scan, delete the boundary of least rank, refresh its neighbours, repeat."""
        if len(parts) > LONG:
            return self._merge_long(parts)
        rank_of, made = self.ranks.get, self.made
        ranks = list(map(rank_of, zip(parts, parts[1:]), repeat(NO_RANK)))
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank_of, made = len(parts), self.ranks.get, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        pairs = enumerate(map(rank_of, zip(parts, parts[1:])))
        heap = [(rank, i) for i, rank in pairs if rank is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            end = after[at]
            if not alive[at] or end < 0 or rank_of((parts[at], parts[end])) != rank:
                continue
            parts[at], alive[end], after[at] = made[rank], False, after[end]
            if after[at] >= 0:
                before[after[at]] = at
            for i in (before[at], at):
                if i >= 0 and after[i] >= 0:
                    found = rank_of((parts[i], parts[after[i]]))
                    if found is not None:
                        heapq.heappush(heap, (found, i))
        return [p for p, here in zip(parts, alive, strict=True) if here]

    def word(self, word: str) -> tuple[bytes, str, str]:
        """A word's ids as packed integers, as decimal text, and its tokens."""
        found = self.seen.get(word)
        if found is None:
            found = self.older.get(word) or self._entry(self.merge(self._parts(word)))
            if len(word) <= LONG:
                if len(self.seen) >= HALF:
                    self.older, self.seen = self.seen, {}
                self.seen[word] = found
        return found

    def _entry(self, ids: list[int]) -> tuple[bytes, str, str]:
        return (array("i", ids).tobytes(), " ".join(map(str, ids)),
                " ".join([self.tokens[i] for i in ids]))

    def encode(self, text: str | None) -> list[tuple[bytes, str, str]]:
        """The entries of all words and special tokens of a whole text, in order."""
        out: list[tuple[bytes, str, str]] = []
        if not text:
            return out
        look_up = self.word
        # split() with groups hands over the marks; groups that did not take part are None.
        for piece in filter(None, self.marks.split(text)):
            if piece in self.special:
                out.append(self._entry([self.special[piece]]))
            else:
                known = self.seen.get  # may be of the older half before the piece ends
                out += [known(w) or look_up(w) for w in self.split(piece)]
        return out

    def split(self, piece: str) -> list[str]:
        """The words of a text without special tokens.  Blanks, runs of which the library makes
        one space, are in no word."""
        if piece.isascii():
            return self.plain_words.findall(piece.lower())
        late = (_LATE if _WIDE.search(piece) else _NARROW_LATE).search(piece)
        if late:
            # A mark that combines with nothing ends what is normalised together.
            piece = "".join([unicodedata.normalize("NFC", x) for x in _MARK.split(piece)])
            piece = piece.translate(LOWERED)
        else:
            piece = unicodedata.normalize("NFC", piece)
        # Letter by letter, so that a final sigma is like any other.
        piece = piece.replace("Σ", "σ").lower()
        if late:
            return self.strict_words.findall(piece)
        # Looked at again, as normalising makes some code points wide.
        return (self.words if _WIDE.search(piece) else self.plain_words).findall(piece)


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordPieces:
    return WordPieces(path)


def decode(path: str, ids: list[int]) -> str:
    """The text of token ids: the file names no decoder, so tokens are joined by a space."""
    tokens = load(path).tokens
    return " ".join(tokens[i] for i in ids if i in tokens)


def encode(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """The given columns without the text, and: ``ids`` (array<int>), ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256``, the digests of ids and decoded text."""
    others = [c for c in docs.columns if c != text_column]
    names = fresh(docs.select(others), "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    (text,) = fresh(docs.select(others), "whole_text")
    frame = docs.select(*others, F.col(text_column).alias(text))
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.StringType(), T.StringType())
    schema = frame.select(others).schema
    for name, kind in zip(names, kinds, strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                yield _encoded(pieces, batch.slice(start, TEXTS), len(others), names)

    return frame.mapInArrow(run, schema)


def _encoded(pieces: WordPieces, batch: pa.RecordBatch, n: int, names: list[str]) -> pa.RecordBatch:
    packed, sizes, of_ids, of_text = [], [0], [], []
    for text in batch.column(n).to_pylist():
        entries = pieces.encode(text)
        ids = b"".join([e[0] for e in entries])
        packed.append(ids)
        sizes.append(len(ids) // 4)
        of_ids.append(hashlib.sha256(" ".join([e[1] for e in entries]).encode()).hexdigest())
        of_text.append(hashlib.sha256(" ".join([e[2] for e in entries]).encode()).hexdigest())
    values = np.frombuffer(b"".join(packed), "<i4")
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values))
    made = [lists, pa.array(sizes[1:], pa.int64()), pa.array(of_ids, pa.string()),
            pa.array(of_text, pa.string())]
    own = [batch.column(i) for i in range(n)]
    return pa.RecordBatch.from_arrays([*own, *made], [*batch.schema.names[:n], *names])
