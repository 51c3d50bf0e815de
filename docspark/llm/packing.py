"""Packing documents into sequences of at most ``LENGTH`` tokens.

The cost of a piece of n tokens in a sequence is estimated as n + n * n / ``BALANCE``: linear work, and attention
within the piece. Pieces go in descending length, each to the sequence of least cost that still has room; pieces are cut
only where no room holds them whole. The room of a group of documents is exactly their tokens: full sequences, and at the
end of a task shorter ones whose lengths are powers of two, which need no padding.

Each task tokenizes and packs its own rows, in groups of at most ``GROUP_TOKENS`` tokens and the part of a document
that goes beyond; nothing is shuffled, a large source or document only fills more sequences, and a lost task is
done again by itself.

Defined results
* null and empty texts: a document of one token, the end mark.
* repeated rows and equal ids: each row is packed by itself.
* very long texts: cut into full sequences first; the rest is packed with the others.
* empty tables: an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import documents, text_or_empty

LENGTH = 2048
END = 1
BALANCE = 2048
GROUP_TOKENS = 1_000_000
#: Texts of these characters are split by the JVM; classes of others may differ between Unicode versions.
PLAIN = r"[^\x00-ɏ‐-‧]"
SPACE = r"\t-\r\x20\x85\xA0"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class Vocabulary:
    """Ids of texts. A piece of text is looked up once for each distinct piece in a batch of rows."""

    def __init__(self, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def of_text(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(np.uint32)

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and for each piece how many it has."""
        coded = pieces.dictionary_encode()
        ids = [self.encoding._encode_single_piece(x) for x in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum()))
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = sizes[at]
        begin = (np.cumsum(sizes) - sizes)[at]
        where = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return flat[where], n


def token_ids(batch: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """The ids of each row of a batch (pieces, text), with the end mark."""
    pieces, texts = batch.column("pieces"), batch.column("text")
    flat, n = vocabulary.of_pieces(pieces.flatten())
    lengths = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(lengths)))]
    end = np.array([END], dtype=np.uint32)
    for k in range(len(texts)):
        ids = vocabulary.of_text(texts[k].as_py()) if texts[k].is_valid else flat[bounds[k] : bounds[k + 1]]
        yield np.concatenate((ids, end))


def balanced(lengths: list[int], rooms: list[int]) -> list[tuple[int, int, int, int]]:
    """Fill the rooms exactly: (piece, its start, length, room). The lengths sum to the rooms' sum.

    Pieces in descending length; each to the room of least cost that holds it. If none does, the piece is cut to fill the room of
    least cost that is left, and its rest goes on.
    """
    left, cost, out = np.array(rooms, dtype=np.int64), np.zeros(len(rooms)), []
    queue = [(-n, k, 0) for k, n in enumerate(lengths)]
    heapq.heapify(queue)
    while queue:
        n, k, start = heapq.heappop(queue)
        n = -n
        fits = left >= n
        room = int(np.argmin(np.where(fits if fits.any() else left > 0, cost, np.inf)))
        take = min(n, int(left[room]))
        out.append((k, start, take, room))
        left[room] -= take
        cost[room] += take + take * take / BALANCE
        if take < n:
            heapq.heappush(queue, (take - n, k, start + take))
    return out


def powers(n: int) -> list[int]:
    """The powers of two whose sum is n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs one task's documents, group by group."""

    def __init__(self, length: int, first: int) -> None:
        self.length, self.sequence = length, first
        self.held: list[tuple[object, int, np.ndarray, int]] = []  # id, start, ids, tokens of the document
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, key: object, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for start in range(0, whole, self.length):
            self._place(key, start, ids[start : start + self.length], len(ids), self.sequence, 0)
            self.sequence += 1
        if whole < len(ids):
            self.held.append((key, whole, ids[whole:].copy(), len(ids)))
            self.tokens += len(ids) - whole
            if self.tokens >= GROUP_TOKENS:
                self.flush(last=False)

    def flush(self, last: bool) -> None:
        """Pack what is held. Before the last group, tokens beyond full sequences are left for the next."""
        back = []
        if not last:  # the shortest remainders wait
            spare = self.tokens % self.length
            self.held.sort(key=lambda x: -len(x[2]))
            while spare and self.held:
                key, start, ids, n = self.held.pop()
                if len(ids) > spare:
                    self.held.append((key, start, ids[: len(ids) - spare], n))
                    start, ids = start + len(ids) - spare, ids[len(ids) - spare :]
                back.append((key, start, ids, n))
                spare -= len(ids)
        lengths = [len(x[2]) for x in self.held]
        total = sum(lengths)
        rooms = [self.length] * (total // self.length) + powers(total % self.length)
        offsets = [0] * len(rooms)
        for k, at, n, room in balanced(lengths, rooms):
            key, start, ids, whole = self.held[k]
            self._place(key, start + at, ids[at : at + n], whole, self.sequence + room, offsets[room])
            offsets[room] += n
        self.sequence += len(rooms)
        self.held, self.tokens = back, sum(len(x[2]) for x in back)

    def _place(self, key: object, start: int, ids: np.ndarray, whole: int, sequence: int, offset: int) -> None:
        n = len(ids)
        self.rows.append((key, start, n, zlib.crc32(ids.astype("<u4").tobytes()), whole, sequence, offset, n + n * n / BALANCE))


def pack(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str | Column = "text", length: int = LENGTH) -> DataFrame:
    """A row for each piece: the document, the piece and its place in a sequence.

    ``sequence_id`` holds the task's number above 2 ** 33, so that ids are one sequence's alone.
    """
    t = text_or_empty(text)
    odd = t.rlike(PLAIN) | t.contains(SPECIAL)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.when(~odd, F.regexp_extract_all(t, F.lit(SPLIT), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("pieces"),
        F.when(odd, t).alias("text"),
    )
    kind = docs.schema[key].dataType
    schema = SCHEMA.format(id=kind.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, packer = Vocabulary(ranks_path), Packer(length, TaskContext.get().partitionId() << 33)

        def given() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(names)
            packer.rows = []
            types = [id_type, *[pa.int64()] * 6, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k, ids in zip(part.column("doc_id").to_pylist(), token_ids(part, vocabulary), strict=True):
                    packer.add(k, ids)
            if packer.rows:
                yield given()
        packer.flush(last=True)
        if packer.rows:
            yield given()

    return rows.mapInArrow(packed, schema)


def default_ranks() -> str:
    """The vocabulary of the contract, as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack(documents(spark, sf_dir).select("doc_id", "text"), default_ranks())
