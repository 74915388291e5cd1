"""Token ids in binary files with random access: directly addressable codes.

An id is split into chunks of ``CHUNK_BITS`` bits, lowest first. Level k holds the k-th chunks of the ids that have one, a
bitmap that says which of them go on in level k + 1, and a rank directory: the number of set bits before every block of
``RANK_BITS`` bits. Token i is read from level 0 at i, and from the next level at the rank of its bit, and so on; nothing else
is decoded.

File, little-endian: magic ``RTD1``; uint32 levels; uint64 tokens, documents; then 8-byte aligned sections, each a uint64 byte
count and its bytes: document ids (int64), document starts (int64, one more than documents), id-is-null (uint8), and for
each level chunks (uint8), continuation bitmap (little bit order), rank directory (uint64).

Files lie in the folder that the cluster shares. A file's name is its place in the order and its content is determined by
the input, so a task that runs again after a lost executor writes the same file again, under a name of its own until whole.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import by_bytes, byte_view
from rowtide.operators.totals import running_totals
from rowtide.sources.shared import cut, new_folder

CHUNK_BITS = 8
RANK_BITS = 512
MAGIC = b"RTD1"
#: A file is closed once it holds this many tokens (a longer text is not split).
FILE_TOKENS = 2 << 20


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, continuation bitmap and rank directory of each level."""
    out, left = [], ids.astype(np.uint64)
    while True:
        rest = left >> np.uint64(CHUNK_BITS)
        more = rest > 0
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, bool)
        padded[: len(more)] = more
        ranks = np.concatenate(([0], np.cumsum(padded.reshape(-1, RANK_BITS).sum(1)))).astype("<u8")
        out.append(((left & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8), np.packbits(padded, bitorder="little"), ranks))
        if not more.any():
            return out
        left = rest[more]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file."""
    levels = levels_of(ids)
    sections = [np.array([x or 0 for x in doc_ids], "<i8"), np.concatenate(([0], np.cumsum(lengths))).astype("<i8"), np.array([x is None for x in doc_ids], np.uint8)]
    sections += [x for level in levels for x in level]
    parts = [MAGIC, struct.pack("<IQQ", len(levels), len(ids), len(doc_ids))]
    parts.append(b"\0" * (-sum(map(len, parts)) % 8))
    for x in sections:
        raw = x.tobytes()
        parts += [struct.pack("<Q", len(raw)), raw, b"\0" * (-len(raw) % 8)]
    return b"".join(parts)


class TokenFile:
    """Random access to a file's bytes."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a token file")
        count, self.tokens, self.documents = struct.unpack_from("<IQQ", raw, 4)
        at, sections = 24, []
        for _ in range(3 + 3 * count):
            (size,) = struct.unpack_from("<Q", raw, at)
            sections.append(memoryview(raw)[at + 8 : at + 8 + size])
            at += 8 + size + -size % 8
        self.doc_ids, self.starts = (np.frombuffer(x, "<i8") for x in sections[:2])
        self.null_ids = np.frombuffer(sections[2], np.uint8)
        self.levels = [(np.frombuffer(c, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(r, "<u8")) for c, b, r in zip(*[iter(sections[3:])] * 3, strict=True)]

    @staticmethod
    def _rank(level: tuple, i: int) -> int:
        """Set bits of the level's bitmap before bit i."""
        _, bitmap, ranks = level
        block = i // RANK_BITS
        return int(ranks[block]) + int(np.unpackbits(bitmap[block * RANK_BITS // 8 : -(-i // 8)], bitorder="little")[: i - block * RANK_BITS].sum())

    def token(self, i: int) -> int:
        """Token i; other tokens are not decoded."""
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level[0][i]) << shift
            if not level[1][i >> 3] >> (i & 7) & 1:
                return value
            i, shift = self._rank(level, i), shift + CHUNK_BITS
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo..hi-1: in each level one stretch, found by rank."""
        out = np.zeros(max(0, hi - lo), np.uint64)
        at, shift = np.arange(len(out)), 0
        for level in self.levels:
            if lo >= hi:
                break
            out[at] |= level[0][lo:hi].astype(np.uint64) << np.uint64(shift)
            bits = np.unpackbits(level[1][lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            lo = self._rank(level, lo)
            hi, at, shift = lo + int(bits.sum()), at[bits], shift + CHUNK_BITS
        return out


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop-style URI or a plain path."""
    if urlparse(folder).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(folder).path
    return pafs.FileSystem.from_uri(folder)


#: Upper to lower case and white space to blanks; white space alone.
_LOWER = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))


#: Bytes of texts that lower-casing A-Z first cannot change otherwise: ASCII and composed Latin-1 letters, no combining marks.
_PLAIN = bytes([*range(0xC0), 0xC3])
#: Between an ASCII letter or digit and an ASCII sign, where the vocabulary's pattern always splits.
_EDGE = re.compile(rb"(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])|(?<=[!-/:-@\[-`{-~])(?=[A-Za-z0-9])")


class WordEncoder(dict):
    """Ids of whole texts from the ids of their words, as little-endian uint32 bytes.

    The vocabulary drops white space before it merges, so a text's ids are those of its words one after another, and a
    word's are those of its letters and signs apart (but for apostrophes and special tokens). Words of letters alone
    come from the library many at a time and are told apart by the word-end marks. The table is dropped when it exceeds
    ``most`` words.
    """

    def __init__(self, path: str, most: int = 1_400_000):
        from tokenizers import Tokenizer

        super().__init__({b"": b""})
        self.most, self.library = most, Tokenizer.from_file(path)
        ends = [v for k, v in self.library.get_vocab(with_added_tokens=False).items() if k.endswith("</w>")]
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.ends[ends] = True

    @staticmethod
    def parts(word: bytes) -> list[bytes]:
        return [word] if word.isalpha() or b"'" in word or b"<|" in word else _EDGE.split(word)

    def __missing__(self, word: bytes) -> bytes:
        parts = self.parts(word)
        ids = b"".join([self[x] for x in parts]) if len(parts) > 1 else self.alone(word)
        self[word] = ids
        return ids

    def alone(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Encode the unknown words of letters at once."""
        new = {x for word in words if word not in self for x in self.parts(word)}
        new = sorted(x for x in new if x not in self and x.decode().isalpha())
        groups = [new[i : i + 512] for i in range(0, len(new), 512)]
        for group, found in zip(groups, self.library.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):  # a letter that is decomposed: its word is several pieces
                self.update((word, self.alone(word)) for word in group)
                continue
            raw = ids.tobytes()
            for word, lo, hi in zip(group, [0, *(ends[:-1] * 4).tolist()], (ends * 4).tolist(), strict=True):
                self[word] = raw[lo:hi]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > self.most:
            self.clear()
            self[b""] = b""
        split = [x.translate(_BLANK if x.translate(None, _PLAIN) else _LOWER).split(b" ") for x in texts]
        self.learn(set(itertools.chain.from_iterable(split)))
        return [b"".join(map(self.__getitem__, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that the words of one task serve the next."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def texts_of(part: pa.RecordBatch) -> list[bytes]:
    data, offsets = byte_view(part.column("text"))
    raw = data.tobytes()
    return [raw[a:b] for a, b in itertools.pairwise(offsets.tolist())]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ``folder``, in ascending doc_id order; returns the list of files, in order.

    Null texts are empty: such a document has the end id alone. Null ids come first; documents of one id follow each other
    in the order of a hash of their texts. An empty table writes no file.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        task, words, made = TaskContext.get(), encoder(tokenizer), 0
        end = struct.pack("<I", end_id)
        held: tuple[list, list] = ([], [])

        def close() -> pa.RecordBatch:
            nonlocal made, held
            doc_ids, coded = held
            lengths = np.array([len(x) // 4 for x in coded], np.int64)
            # each attempt has files of its own and the list names those of the one that counts: nothing is renamed or overwritten
            name = f"{task.partitionId():07d}-{made:06d}-{task.taskAttemptId()}.tok"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(pack(doc_ids, lengths, np.frombuffer(b"".join(coded), "<u4")))
            row = {"part": [task.partitionId()], "seq": [made], "path": [name], "documents": [len(doc_ids)], "tokens": [int(lengths.sum())]}
            made, held = made + 1, ([], [])
            return pa.RecordBatch.from_pydict(row)

        size = 0
        for batch in batches:
            for part in by_bytes(batch, "text"):
                coded = [x + end for x in words.encode(texts_of(part))]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coded, strict=True):
                    held[0].append(doc_id)
                    held[1].append(ids)
                    size += len(ids) // 4
                    if size >= FILE_TOKENS:
                        yield close()
                        size = 0
        if held[0]:
            yield close()

    return cut(dealt.mapInArrow(write, "part long, seq long, path string, documents long, tokens long"))


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 of each document."""
    placed = running_totals(files, [F.col("part"), F.col("seq")], {"offset": "tokens"})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, offset in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    file = TokenFile(f.read())
                starts = file.starts.tolist()
                crcs = [zlib.crc32(file.slice(a, b).astype("<u4").tobytes()) for a, b in itertools.pairwise(starts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, pa.int64(), mask=file.null_ids.astype(bool)),
                        pa.array(file.starts[:-1] + offset, pa.int64()),
                        pa.array(np.diff(file.starts), pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a number of its own: a short list of files must not end up in one task
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "offset").repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the documents' tokens (to a new folder in the shared one unless ``folder`` is given) and read them back."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, folder, tokenizer, end_id), folder)
