"""Merge-type piece encoding by backtracking, and decoding.

A piece sequence is the merge result of a text exactly if every two neighbours, merged anew from characters, come out as the
same two pieces. So a text is encoded from left to right with the longest piece that an Aho-Corasick automaton finds at a
position; if it does not go with the piece before, shorter ones are tried; if none does, the piece before is given up
and its end position is marked in a bitfield, so that no position fails twice.

Texts are cut beforehand where no piece can span: between two characters that stand next to each other in no piece. Such
stretches are encoded once and kept in a table (dropped when it is full).
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rowtide.llm.common import by_bytes
from rowtide.llm.token_store import texts_of

SPACE = "▁"
#: From here on a number in a piece sequence stands for a character that is no piece.
RAW = 1 << 24
#: Words whose ids a worker keeps at most, and neighbours of which it keeps whether they go together. A worker lives on between tasks
#: and stages, and its tables with it.
MOST_WORDS, MOST_PAIRS = 250_000, 500_000


class PieceModel:
    """Pieces, scores and byte pieces of a model file; the library reads the file, merging is done here."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.pieces = [lib.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.unknown = lib.unk_id()
        self.end = lib.eos_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in ids if lib.is_byte(i)}
        #: What a piece looks like in a decoded text.
        self.shown = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            self.shown[i] = bytes([b])
        for i in ids:
            if lib.is_control(i):
                self.shown[i] = b""
        self.shown[self.unknown] = " ⁇ ".encode()
        self.ids = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: lib.get_score(i) for i in normal}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
        self.automaton.make_automaton()
        self.pairs = {a + b for p in self.ids for a, b in itertools.pairwise(p)}
        self.sizes = [len(p) for p in self.pieces]
        self.good: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Greedy merging from characters: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def text(self, i: int) -> str:
        return self.pieces[i] if i < RAW else chr(i - RAW)

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces, merged anew, stay the two pieces (or ``right``, alone, if ``left`` is -1)."""
        key = left << 32 | right
        known = self.good.get(key)
        if known is None:
            if len(self.good) > MOST_PAIRS:
                self.good.clear()
            both = [self.text(i) for i in (left, right) if i >= 0]
            known = self.good[key] = self.merge("".join(both)) == both
        return known

    def encode_stretch(self, text: str) -> list[int]:
        """Backtracking over one stretch; characters that stay alone and are no piece become bytes (or unknown)."""
        i = self.ids.get(text)
        if i is not None and self.fits(-1, i):
            return [i]
        # what starts at each position, shorter first: the automaton's ends come in ascending order
        found: list[list[int]] = [[] if c in self.ids else [RAW + ord(c)] for c in text]
        for end, (i, size) in self.automaton.iter(text):
            found[end - size + 1].append(i)
        n, sizes, good, out, at = len(text), self.sizes, self.good, [], 0
        failed = bytearray(n // 8 + 1)
        while at < n:
            # a prefix has one encoding at most, so what a position has tried need not be tried again
            options, last = found[at], out[-1] if out else -1
            while options:
                i = options.pop()
                to = at + (sizes[i] if i < RAW else 1)
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                fit = good.get(last << 32 | i)
                if fit if fit is not None else self.fits(last, i):
                    out.append(i)
                    at = to
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                i = out.pop()
                at -= sizes[i] if i < RAW else 1
        if max(out, default=0) < RAW:
            return out
        return [x for i in out for x in ([i] if i < RAW else [self.bytes[b] for b in chr(i - RAW).encode()] if self.bytes else [self.unknown])]

    def stretches(self, text: str) -> list[str]:
        """Cut where no piece spans."""
        pairs = self.pairs
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs), len(text)]
        return [text[a:b] for a, b in itertools.pairwise(cuts)]


class PieceEncoder(dict):
    """Encodes whole texts: a word (with the space mark before it) -> its ids as decimals; ``shown``: -> its decoded bytes, of words that
    do not decode to themselves."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        super().__init__()
        self.most, self.model = most, PieceModel(path)
        self.small: dict[str, array] = {}
        self.shown: dict[str, bytes] = {}
        # a space mark after another character is in no piece, so words stand alone
        if any(p[1:].strip(SPACE) != p[1:] and p.strip(SPACE) for p in self.model.ids if SPACE in p[1:]):
            raise ValueError("the model has pieces that go on after a space")

    def ids_of(self, marked: str) -> list[int]:
        out, small = [], self.small
        for x in self.model.stretches(marked):
            ids = small.get(x)
            if ids is None:
                if len(small) > self.most // 2:
                    small.clear()
                ids = small[x] = array("H" if len(self.model.pieces) < 1 << 16 else "I", self.model.encode_stretch(x))
            out += ids
        return out

    def __missing__(self, word: str) -> bytes:
        ids = self.ids_of(SPACE + word)
        shown = b"".join([self.model.shown[i] for i in ids])
        if shown != b" " + word.encode():
            self.shown[word] = shown
        out = self[word] = " ".join(map(str, ids)).encode()
        return out

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        if not text:
            return [self.model.end]
        return [*self.ids_of(SPACE + text.replace(" ", SPACE)), self.model.end]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, space marks turned to spaces, the mark before the text removed, bytes read as UTF-8."""
        return b"".join([self.model.shown[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str, bytes]:
        """Number of ids with the end id, sha256 of the ids as decimals, sha256 of the decoded text, the ids as decimals.

        Where every space stands alone inside the text, a word at a time: encoding and decoding both go word by word.
        """
        end = str(self.model.end).encode()
        if not text or "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            found = self.encode(text)
            ids, n, decoded = " ".join(map(str, found)).encode(), len(found), self.decode(found).encode()
        else:
            if len(self) > self.most:
                self.clear()
                self.shown.clear()
            words = text.split(" ")
            ids = b" ".join([*map(self.__getitem__, words), end])
            n, decoded, odd = ids.count(b" ") + 1, text.encode(), self.shown
            if odd and not odd.keys().isdisjoint(words):
                decoded = b"".join([odd[w] if w in odd else b" " + w.encode() for w in words]).removeprefix(b" ")
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids


#: Bytes of text that are encoded before they are handed on (one longer text is taken alone).
PIECE = 1 << 19

_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, model: str, ids: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of its whole texts (and ``ids``, if asked for).

    Columns of ``docs`` with these names are replaced. A null text is empty; it has the end id alone and decodes to nothing.
    """
    new = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()} | ({"ids": ArrayType(IntegerType())} if ids else {})
    docs = docs.drop(*new)
    schema = StructType([*docs.schema.fields, *(StructField(k, t) for k, t in new.items())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model)
        for batch in batches:
            for part in by_bytes(batch, "text", PIECE):
                rows = [pieces.digest(x.decode()) for x in texts_of(part)]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                if ids:
                    numbers = np.fromstring(b" ".join([r[3] for r in rows]), np.int32, sep=" ")
                    made.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([r[0] for r in rows])), pa.int32()), pa.array(numbers)))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *new])

    return docs.mapInArrow(encode, schema)
