"""Removing word sequences that repeat anywhere in the corpus.

Every window of ``WINDOW`` words is hashed twice (64-bit polynomial hashes from one prefix sum each). The texts lie in chunks of
some megabytes, the hash space in slices; both grow in number with the corpus, so that no task, message or table does.

1. Each chunk counts its windows in a count-min sketch of its own and sends every slice the cells it has filled. The slice merges the
   sketches of all chunks by saturating addition and answers each chunk which of its cells stand at two or more. Estimates are never
   too low: a window whose least cell stands at one occurs once.
2. A chunk sends only windows estimated repeated on, by 80 bits of their hashes, to be grouped exactly; the answer names those that other chunks
   have too. What a chunk holds twice itself it knows without asking.

Nothing is broadcast. A window costs about one byte a sketch row on the way to its slice and a bit on the way back, a suspect ten
bytes each way. The chunks' texts are shuffled once; all three passes over them read that shuffle.

Defined results
* null text: no words; 0 words, 0 removed, the hash of the empty text. Texts of fewer than ``WINDOW`` words lose nothing.
* repeated rows and equal ids: every row is a document of its own; rows that agree in id and text get the same result.
* a window that overlaps its own repeat within one document counts as repeated.
* very long texts: linear time and memory in the one text. Empty tables: an empty result.
* other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.arrow_words import mix, word_hashes
from docspark.llm.common import documents, text_or_empty

WINDOW = 35
DEPTH = 2
#: Bytes of text in a chunk, about, and words for each bucket of suspects.
CHUNK_BYTES, BUCKET_WORDS = 4 << 20, 1 << 20
#: Cells of a slice in each row of the sketch: a slice holds two bytes a cell while it merges.
SLICE_CELLS = 1 << 21
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(flat: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of all windows of all documents in order: prefix sums of a polynomial modulo 2 ** 64."""
    ends = np.cumsum(lengths)
    is_start = np.ones(len(flat) + 1, dtype=bool)
    for k in range(1, window):  # no window starts within the last words of a document
        is_start[ends[lengths >= k] - k] = False
    at = np.flatnonzero(is_start[: len(flat)])
    found = []
    for k, base in enumerate(_BASES):
        sums = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum((flat if k == 0 else mix(flat)) * _powers(base, len(flat)), out=sums[1:])
        found.append(mix((sums[at + window] - sums[at]) * _powers(pow(base, -1, 1 << 64), len(flat))[at]))
    return found[0], found[1]


def _small(steps: np.ndarray) -> bytes:
    """Non-negative steps as bytes: below 255 one byte each, the others after them in four."""
    large = steps >= 255
    return np.where(large, 255, steps).astype(np.uint8).tobytes() + steps[large].astype("<u4").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(raw[:n], dtype=np.uint8).astype(np.int64)
    steps[steps == 255] = np.frombuffer(raw[n:], dtype="<u4")
    return steps


def _edges(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal numbers."""
    at = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])).tolist()
    return zip(at[:-1], at[1:], strict=True) if len(part) else iter(())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def filled_cells(hashes: tuple[np.ndarray, np.ndarray], depth: int, slices: int, cells: int) -> np.ndarray:
    """The cell of each window in one row of the sketch, numbered through all slices. All rows have a window in one slice, by its first hash."""
    return (hashes[0] >> np.uint64(32)) % np.uint64(slices) * np.uint64(cells) + (hashes[depth] & np.uint64(cells - 1))


ASK = pa.schema([("slice", pa.int32()), ("depth", pa.int32()), ("chunk", pa.int64()), ("steps", pa.binary()), ("more", pa.binary()), ("n", pa.int32())])
ANSWER = pa.schema([("chunk", pa.int64()), ("slice", pa.int32()), ("depth", pa.int32()), ("repeated", pa.binary()), ("n", pa.int32())])
SUSPECT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("known", pa.binary())])
FOUND = pa.schema([("chunk", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def sketched(chunks: DataFrame, slices: int, cells: int, window: int) -> DataFrame:
    """The merged sketch as answers: a row (chunk, slice, depth, repeated) with a bit for each cell that the chunk has filled there."""

    def local(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [word_hashes(b.column("_text")) for b in table]
        hashes = window_hashes(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), window)
        for depth in range(DEPTH):
            cell, times = np.unique(filled_cells(hashes, depth, slices, cells), return_counts=True)
            part, inner = cell // np.uint64(cells), (cell % np.uint64(cells)).astype(np.uint32)
            out = []
            for a, b in _edges(part):
                out.append((int(part[a]), depth, key[0].as_py(), _small(np.diff(inner[a:b], prepend=np.uint32(0))), np.packbits(times[a:b] > 1).tobytes(), b - a))
            for k in range(0, len(out), 1024):
                yield _batch(out[k : k + 1024], ASK)

    def merged(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, more = np.zeros(cells, dtype=bool), np.zeros(cells, dtype=bool)
        asked = []
        for batch in table:
            for chunk, steps, twice, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "steps", "more", "n")), strict=True):
                cell = np.cumsum(_large(steps, n))
                more[cell] |= ones[cell] | np.unpackbits(np.frombuffer(twice, dtype=np.uint8), count=n).astype(bool)
                ones[cell] = True
                asked.append((chunk, steps, n))
        for k in range(0, len(asked), 1024):
            yield _batch([(chunk, key[0].as_py(), key[1].as_py(), np.packbits(more[np.cumsum(_large(steps, n))]).tobytes(), n) for chunk, steps, n in asked[k : k + 1024]], ANSWER)

    parts = chunks.groupBy("chunk").applyInArrow(local, _sql(ASK))
    return parts.groupBy("slice", "depth").applyInArrow(merged, _sql(ANSWER))


def repeated_elsewhere(chunks: DataFrame, answers: DataFrame, slices: int, cells: int, buckets: int, window: int) -> DataFrame:
    """Rows (chunk, one, two): the sorted hashes of the chunk's windows that other chunks have too.

    A hash that a chunk holds more than once goes out once, marked as known to be repeated. So even a passage in a third of all documents
    gives its bucket no more than an entry for each chunk.
    """

    def suspects(key: tuple, texts: pa.Table, answer: pa.Table) -> pa.Table:
        if not texts.num_rows or not answer.num_rows:
            return SUSPECT.empty_table()
        one, two = window_hashes(*word_hashes(texts.column("_text").combine_chunks()), window)
        keep = np.ones(len(one), dtype=bool)
        for depth in range(DEPTH):
            order = np.lexsort((answer.column("slice").to_numpy(), answer.column("depth").to_numpy() != depth))
            rows = answer.take(order[: int((answer.column("depth").to_numpy() == depth).sum())])
            bits = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(rows.column("repeated").to_pylist(), rows.column("n").to_pylist(), strict=True)])
            keep &= bits[np.unique(filled_cells((one, two), depth, slices, cells), return_inverse=True)[1]] == 1
        one, two = one[keep], (two[keep] >> np.uint64(48)).astype(np.uint16)
        one, two, known = distinct(one, two)
        bucket = ((one >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # within a bucket the order by hash stays
        one, two, known, bucket = one[order], two[order], known[order], bucket[order]
        chunk = texts.column("chunk")[0].as_py()
        out = [(int(bucket[a]), chunk, one[a:b].tobytes(), two[a:b].tobytes(), known[a:b].tobytes()) for a, b in _edges(bucket)]
        return pa.Table.from_batches([_batch(out, SUSPECT)])

    def settled(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for batch in table:
            for chunk, one, two, known in zip(*(batch.column(c).to_pylist() for c in ("chunk", "one", "two", "known")), strict=True):
                h = np.frombuffer(one, dtype=np.uint64)
                own.append((np.full(len(h), chunk, dtype=np.int64), h, np.frombuffer(two, dtype=np.uint16), np.frombuffer(known, dtype=bool)))
        chunk, one, two, known = (np.concatenate(x) for x in zip(*own, strict=True))
        own.clear()
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        again = np.zeros(len(one), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        tell = np.flatnonzero(again & ~known)
        out = [(int(chunk[tell[a]]), one[tell[a:b]].tobytes(), two[tell[a:b]].tobytes()) for a, b in _edges(chunk[tell])]
        for k in range(0, len(out), 1024):
            yield _batch(out[k : k + 1024], FOUND)

    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(suspects, _sql(SUSPECT))
    return found.groupBy("bucket").applyInArrow(settled, _sql(FOUND))


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hash pairs in order, and whether each stood more than once."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    starts = np.flatnonzero(new)
    return one[starts], two[starts], np.diff(np.append(starts, len(one))) > 1


def members(one: np.ndarray, two: np.ndarray, known_one: np.ndarray, known_two: np.ndarray) -> np.ndarray:
    """Which of the hash pairs are among the known ones."""
    every_one, every_two = np.concatenate((one, known_one)), np.concatenate((two, known_two))
    order = np.lexsort((every_two, every_one))
    one_, two_ = every_one[order], every_two[order]
    new = np.ones(len(one_), dtype=bool)
    new[1:] = (one_[1:] != one_[:-1]) | (two_[1:] != two_[:-1])
    group = np.cumsum(new) - 1
    told = np.zeros(int(group[-1]) + 1 if len(group) else 0, dtype=bool)
    told[group[order >= len(one)]] = True
    out = np.zeros(len(every_one), dtype=bool)
    out[order] = told[group]
    return out[: len(one)]


def chunked(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Rows (chunk, _key, _text), and about how many words they have.

    A chunk is drawn by a hash of the row and of the input partition that holds it, so that not even equal rows meet in one.
    """
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    chunks = max(1, size // chunk_bytes)
    return rows.select(F.pmod(F.xxhash64("_key", "_text", F.spark_partition_id()), F.lit(chunks)).alias("chunk"), "_key", "_text"), size // 6


def sketch_shape(n: int, slice_cells: int = SLICE_CELLS) -> tuple[int, int]:
    """Slices, and cells of a slice in each row: about two cells for each of ``n`` words, in 16 slices at least."""
    cells = 1024
    while cells < slice_cells and 16 * cells < 2 * n:
        cells *= 2
    return max(16, -(-2 * n // cells)), cells


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, slice_cells: int = SLICE_CELLS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """A row (key, n_words, n_removed, kept_text) for each document, without the words that repeated windows cover."""
    chunks, n = chunked(docs, key, text, chunk_bytes)
    slices, cells = sketch_shape(n, slice_cells)
    buckets = max(16, n // bucket_words)
    found = repeated_elsewhere(chunks, sketched(chunks, slices, cells, window), slices, cells, buckets, window)
    kind = docs.schema[key].dataType.simpleString()

    def cut(group: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        flat, lengths = word_hashes(texts.column("_text").combine_chunks())
        one, two = window_hashes(flat, lengths, window)
        two = (two >> np.uint64(48)).astype(np.uint16)
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        again = np.zeros(len(one), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        if found.num_rows:
            far = [np.frombuffer(b"".join(found.column(c).to_pylist()), dtype=t) for c, t in (("one", np.uint64), ("two", np.uint16))]
            again |= members(one, two, *far)
        n_removed, kept, w = [], [], 0
        for text_, n in zip(texts.column("_text").to_pylist(), lengths.tolist(), strict=True):
            own = text_.encode("utf-8", "surrogatepass").split()
            m = max(n - window + 1, 0)
            first = np.flatnonzero(again[w : w + m])
            w += m
            if len(first):
                change = np.zeros(n + 1, dtype=np.int64)
                change[first] += 1
                change[first + window] -= 1
                own = [x for x, gone in zip(own, np.cumsum(change[:n]).tolist(), strict=True) if not gone]
            n_removed.append(n - len(own))
            kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
        return pa.table([texts.column("_key"), pa.array(lengths, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept_text"])

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, f"`{key}` {kind}, n_words long, n_removed long, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words covered by repeated windows."""
    cut = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, i + o AS pos FROM s SEMI JOIN r ON s.k = r.k, range(35) t(o)),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
a AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
    string_agg(CASE WHEN g.pos IS NULL THEN e.word END, ' ' ORDER BY e.pos) AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""
