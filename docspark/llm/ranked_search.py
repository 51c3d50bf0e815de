"""Ranked lexical search over an inverted index: document at a time, with a heap merge of postings.

Index. Runs of documents, about ``SHARD_BYTES`` of text each, are shards; a task indexes one shard at a time. A shard numbers its documents by doc_id.
For each of its terms it has a row with the numbers of the documents in order, as gaps, and the occurrences, both as variable-byte integers; the
row of the empty term has the ids and the documents' counts of terms. Every term of every document is indexed. Nothing is shuffled.

Search. Queries are taken in blocks of bounded size. A pass over the index sums how many documents hold each of the block's terms. Then the block's
postings come together by shard, whose size is bounded. For each query its lists merge on a heap, least document first; the best documents
are kept on a bounded heap by score, then doc_id. Lists whose greatest scores together can't lift a document over the least of
a full heap don't drive the merge; they are looked up only for documents of the others, so no result is missed. The best of all shards meet in a rank
by query, of which each task sends on its own best only.

Defined results
* null text and texts without terms: not in the index, and not in N. Null or wordless queries, and an empty table: no rows.
* equal scores: by ascending doc_id, null last; rows that agree in id and score have ranks in any order. Repeated rows are documents of their own.
* equal item ids: each row of the query table is a query of its own. Very long texts: a shard of their own.
* other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import documents, materialize

#: Bytes of text in a shard, and of queries in a block.
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 1 << 20
TOP = 10
#: What a byte becomes: digits, letters and bytes beyond ASCII stay, A-Z in lower case; all else parts terms.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(FOLD).split()


def packed(x: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Variable-byte forms of runs of numbers of 0 or more, each from one of ``starts`` to the next.

    Seven bits a byte, low ones first, with the high bit on all but a number's last byte.
    """
    x = x.astype(np.uint64)
    shifts = np.arange(0, 70, 7, dtype=np.uint64)[: max(1, -(-int(x.max(initial=0)).bit_length() // 7))]
    parts = x[:, None] >> shifts
    kept = parts > 0
    kept[:, 0] = True
    out = (parts & np.uint64(127)).astype(np.uint8)
    out[:, :-1] |= kept[:, 1:].astype(np.uint8) << 7
    ends = np.concatenate(([0], np.cumsum(kept.sum(axis=1))))
    offsets = ends[np.append(starts, len(x))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out[kept])])


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of one run of ``packed``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, dtype=np.int64)


class _Shard:
    """The documents of a shard under way: term codes, documents and occurrences, text by text."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.names: list = []
        self.lengths: list[int] = []
        self.bytes = 0

    def add(self, names: list, texts: list[bytes]) -> None:
        """Some documents with terms, about a megabyte at a time."""
        found: list[bytes] = []
        counts = []
        for name, text in zip(names, texts, strict=True):
            if own := terms(text):
                self.names.append(name)
                self.lengths.append(len(own))
                counts.append(len(own))
                found += own
        self.bytes += sum(map(len, texts))
        if found:
            coded = pa.array(found, pa.binary()).dictionary_encode()
            code = np.array([self.codes.setdefault(t, len(self.codes)) for t in coded.dictionary.to_pylist()], dtype=np.int64)
            docs = np.repeat(np.arange(len(self.names) - len(counts), len(self.names)), counts)
            key, tf = np.unique(code[coded.indices.to_numpy(zero_copy_only=False)] << 32 | docs, return_counts=True)
            self.parts.append((key >> 32, key & 0xFFFFFFFF, tf))

    def rows(self, shard: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.names)), key=lambda k: (self.names[k] is None, self.names[k]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        code, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        at = np.lexsort((rank[doc], code))
        code, doc, tf = code[at], rank[doc[at]], tf[at]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        ends = np.append(starts[1:], len(code))
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts]
        lengths = np.array(self.lengths)[order]
        one = np.zeros(1, dtype=np.int64)
        columns = {
            "shard": pa.array(np.full(len(starts) + 1, shard)),
            "term": pa.array([b"", *self.codes], pa.binary()).cast(pa.string()),
            "docs": pa.array(np.append(len(order), ends - starts)),
            "uses": pa.array(np.append(lengths.sum(), np.add.reduceat(tf, starts))),
            "gaps": pa.concat_arrays([pa.array([b""], pa.binary()), packed(gaps, starts)]),
            "counts": pa.concat_arrays([packed(lengths, one), packed(tf, starts)]),
            "names": pa.concat_arrays([pa.array([[self.names[k] for k in order]], pa.list_(kind)), pa.nulls(len(starts), pa.list_(kind))]),
        }
        whole = pa.RecordBatch.from_pydict(columns)
        for at in range(0, len(starts) + 1, 8192):
            yield whole.slice(at, 8192)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of all texts: (shard, term, docs, uses, gaps, counts, names)."""
    kind = docs.schema[key].dataType.simpleString()

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shard, number = TaskContext.get().partitionId() << 32, _Shard(), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):  # a megabyte, or one text
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20))))
                shard.add(batch.column("name").slice(at, to - at).to_pylist(), [t or b"" for t in texts.slice(at, to - at).to_pylist()])
                at = to
                if shard.bytes >= SHARD_BYTES and shard.names:
                    yield from shard.rows(first + number, batch.column("name").type)
                    shard, number = _Shard(), number + 1
            kept = batch.column("name").type
        if shard.names:
            yield from shard.rows(first + number, kept)

    rows = docs.select(F.col(key).alias("name"), F.col(text).alias("text")).filter("text is not null")
    return materialize(rows.mapInArrow(indexed, f"shard long, term string, docs long, uses long, gaps binary, counts binary, names array<{kind}>"), "search-index")


class Postings(NamedTuple):
    """The documents that hold a term, in order, and what each of them scores for it."""

    docs: list[int]
    scores: list[int]
    top: int


def best(lists: list[tuple[int, Postings]], k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, document) of weighted postings: greatest score first, then least document."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    below = list(accumulate((w * p.top for w, p in lists), initial=0))  # what the lists before one can add at most
    at = [0] * len(lists)
    heads = [(p.docs[0], i) for i, (_, p) in enumerate(lists)]
    heapq.heapify(heads)
    kept: list[tuple[int, int]] = []  # least score first, of equal scores the greatest document
    first = 0  # lists before it don't drive the merge
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            i = heads[0][1]
            if i < first:
                heapq.heappop(heads)
                continue
            w, p = lists[i]
            score += w * p.scores[at[i]]
            at[i] += 1
            if at[i] < len(p.docs):
                heapq.heapreplace(heads, (p.docs[at[i]], i))
            else:
                heapq.heappop(heads)
        bar = kept[0][0] if len(kept) == k else 0
        if not score:
            continue
        for i in range(first - 1, -1, -1):
            if score + below[i + 1] <= bar:
                break
            w, p = lists[i]
            at[i] = bisect_left(p.docs, doc, at[i])
            if at[i] < len(p.docs) and p.docs[at[i]] == doc:
                score += w * p.scores[at[i]]
        if score > bar:  # documents come in order, so one that ties with the least kept comes after it
            (heapq.heappushpop if len(kept) == k else heapq.heappush)(kept, (score, -doc))
            while len(kept) == k and first < len(lists) and below[first + 1] <= kept[0][0]:
                first += 1
    return [(s, -d) for s, d in sorted(kept, reverse=True)]


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    """Queries (id, occurrences of each term), about ``BLOCK_BYTES`` of text at a time."""
    block, size = [], 0
    for item in items.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").toLocalIterator():
        if own := Counter(t.decode() for t in terms(item["text"].encode())):
            block.append((item["key"], own))
            size += len(item["text"])
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """(key, rank, doc_id, score): the ``k`` best documents of each query with a score above 0."""
    spark = index.sparkSession
    kind, doc_kind = items.schema[key].dataType.simpleString(), index.schema["names"].dataType.elementType.simpleString()
    total = index.filter("term = ''").agg(F.sum("docs").alias("n"), F.sum("uses").alias("l")).first()
    out = None
    for block in blocks(items, key, text) if total["n"] else ():
        found = _block(index, block, k, total["n"], total["l"])
        keys = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, `{key}` {kind}")
        named = found.join(F.broadcast(keys), "query").select(key, "rank", F.col("name").alias("doc_id"), "score")
        out = named if out is None else out.unionByName(named)
    return spark.createDataFrame([], f"`{key}` {kind}, rank int, doc_id {doc_kind}, score long") if out is None else out


def _block(index: DataFrame, block: list[tuple[object, Counter]], k: int, n: int, length: int) -> DataFrame:
    """(query, rank, name, score) of a block of queries, numbered as they come."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted(set().union(*(own for _, own in block)))], "term string")
    held = index.select("term", "docs").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    weight = {r["term"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["docs"] + 1))) for r in held}
    # Terms that weigh nothing, or that no document holds, can't score.
    queries = [(i, {t: c * weight[t] for t, c in own.items() if weight.get(t)}) for i, (_, own) in enumerate(block)]
    needed = spark.createDataFrame([("",), *((t,) for t, w in weight.items() if w)], "term string")
    schema = index.schema["names"].dataType.elementType

    def ranked(table: pa.Table) -> pa.Table:
        postings: dict[str, Postings] = {}
        rows = table.sort_by("term").select(["term", "gaps", "counts", "names"])
        own = rows.slice(0, 1)
        names, n_terms = own.column("names")[0], unpacked(own.column("counts")[0].as_py())
        slow = 25 + np.array([75 * x * n // length for x in n_terms.tolist()], dtype=np.int64)
        for term, gaps, counts in zip(*(rows.column(c).slice(1).to_pylist() for c in ("term", "gaps", "counts")), strict=True):
            docs, tf = np.cumsum(unpacked(gaps)), unpacked(counts)
            scores = 1_000_000_000 * tf // (1000 * tf + 8 * slow[docs])
            postings[term] = Postings(docs.tolist(), scores.tolist(), int(scores.max()))
        found = [(i, d, s) for i, w in queries for s, d in best([(w[t], postings[t]) for t in w if t in postings], k)]
        i, d, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query": pa.array(i, pa.int32()), "name": names.values.take(pa.array(d, pa.int64())), "score": pa.array(s, pa.int64())})

    near = index.join(F.broadcast(needed), "term", "left_semi")
    tops = near.groupBy("shard").applyInArrow(ranked, f"query int, name {schema.simpleString()}, score long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("name").asc_nulls_last()))
    return tops.withColumn("rank", nth).filter(F.col("rank") <= k)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    index = build_index(documents(spark, sf_dir).select("doc_id", "text"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP11_SQL = """
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM d),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, nn),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // l)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY ALL
),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
