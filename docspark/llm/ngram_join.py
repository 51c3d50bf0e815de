"""N-gram Jaccard join by grouped prefixes: links of documents whose sets of four-word shingles are at least 85 % alike.

Two sets that reach the threshold share a shingle early in any one order of all shingles: within the first ``n - ceil(85 n / 100) + 1`` of the larger
set and the first ``n - ceil(170 n / 185) + 1`` of the smaller (prefix filtering). The order is used twice. By hash first, which
needs no counts: of twice that many first shingles a document with a link shares about half at least, and documents that share fewer, with
whatever others, drop out. For the others shingles are counted over their whole sets, and the order is by that count, rarest first, so that
common passages come last.

Documents with equal sets are one class. Classes with the same size and prefix are one group, and only groups meet on shingles; a pair of groups is
kept if sizes fit and what is left of either set from the shared shingle on can hold all they need in common. Pairs expand to members at the end. Members of a
group are first compared with its least member, and groups with the least group of a shingle; what is then compared is only
members of different components, of which one at least is outside the largest component at the shingle. So a family of near copies costs about one
comparison for each, and no link between components is missed.

Defined results
* null text and texts without words: an empty set, linked with nothing, its own component.
* fewer than four words: the whole sequence is the one shingle.
* null and equal ids: a node is a row's id and text together, as in near dedup. A component's id is the least of its ids; null only where all are null.
* very long texts: linear time; one text's set is in memory at once. Empty tables: an empty result.
* other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import discard, documents, materialize, text_or_empty
from docspark.llm.near_dedup import apart, components, confirmed, full_sets, linked, named_components, node_of, representatives, shingle_sets

WIDTH = 4
THRESHOLD = (85, 100)


def probe_length(n):  # noqa: ANN001, ANN201
    """Shingles of a set, of numbers or a Column of them, in which it meets any set of its size or smaller that it links with."""
    low, high = THRESHOLD
    return n - (n * low + (high - 1)) // high + 1


def head_length(n):  # noqa: ANN001, ANN201
    """Shingles, least hash first, that a first look takes: the probe length twice, of which a linked set shares ``head_need`` within its partner's."""
    return np.minimum(n, 2 * probe_length(n))


def head_need(n):  # noqa: ANN001, ANN201
    """Shingles of a head that a set with a link shares at least.

    If sets link with o shingles in common, the first ``head - (n - o)`` common ones, the lesser of the two numbers, are in both heads, and n - o is
    below the probe length; one is taken off for the rounding of unequal sizes.
    """
    return np.maximum(head_length(n) - probe_length(n), 1)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def _lengths(n: Column) -> tuple[Column, Column]:
    """The early part of a set as the larger and as the smaller of two."""
    low, high = THRESHOLD
    both = low + high
    return n - _div(n * low + (high - 1), high) + 1, n - _div(n * (2 * low) + (both - 1), both) + 1


def heads(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row (node, name, n_shingles, digest, need, head) for each document; ``head`` has the first of its shingles by hash, null for empty sets as the digest is."""
    kind = docs.schema[key].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, digest, head = [], [], []
                for s in shingle_sets(part.column("text"), WIDTH):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    head.append(np.sort(s.view(np.int64))[: head_length(len(s))] if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("name"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(head_need(np.array(n, dtype=np.int64))), pa.array(head, pa.list_(pa.int64()))], names=["node", "name", "n_shingles", "digest", "need", "head"])

    rows = docs.select(node_of(key, text).alias("node"), F.col(key).alias("name"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(signed, f"node long, name {kind}, n_shingles long, digest binary, need long, head array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """The shingles that more than one of ``rows`` (shingle, ...) have."""
    return rows.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")


def spread(sets: DataFrame) -> DataFrame:
    """A row (id, shingle) for each shingle of ``sets`` (id, hashes)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                own = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in part.column("hashes")]
                which = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([part.column("id").take(which), pa.array(np.concatenate(own))], names=["id", "shingle"])

    return sets.mapInArrow(each, "id long, shingle long")


def prefixes(sets: DataFrame) -> DataFrame:
    """(id, n, prefix) of each set: its rarest shingles among these sets, in one order for all; shingles of one set alone come first."""
    counts = _shared(spread(sets))
    common = spread(sets).join(counts, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("common"))
    sizes = sets.select("id", (F.octet_length("hashes") / 8).cast("long").alias("n"))
    return sizes.join(common, "id").select("id", "n", F.col("common")["shingle"].alias("common"))


def groups(prefixed: DataFrame) -> DataFrame:
    """A written table (id, gid, n, alone, common): sets of one size and prefix have the least id as their group's. ``common`` is the part of the prefix that others have too.

    Shingles of one set alone make a prefix unlike all others, so such a set is a group of its own; ``alone`` counts them.
    """
    probe, _ = _lengths(F.col("n"))
    early = prefixed.select("id", "n", (F.col("n") - F.size("common")).alias("alone"), F.slice("common", F.lit(1), F.greatest(probe - (F.col("n") - F.size("common")), F.lit(0)).cast("int")).alias("common")).filter(F.size("common") > 0)
    own = F.when(F.col("alone") > 0, F.col("id"))
    keyed = early.withColumn("_own", own).withColumn("_x", F.xxhash64("common")).withColumn("_y", F.xxhash64(F.lit("y"), "common"))
    keyed = materialize(keyed, "join-prefixes")
    least = keyed.filter("_own is null").groupBy("n", "_x", "_y").agg(F.min("id").alias("gid"))
    out = materialize(keyed.join(least, ["n", "_x", "_y"], "left").select("id", F.when(F.col("_own").isNotNull(), F.col("id")).otherwise(F.col("gid")).alias("gid"), "n", "alone", "common"), "join-groups")
    discard(keyed)
    return out


def _fits(n1: str, rest1: str, at1: str, n2: str, rest2: str, at2: str) -> Column:
    """Whether two sets, by size, what is left from a shared shingle on, and its place, can reach the threshold there."""
    low, high = THRESHOLD
    a, b = F.col(n1), F.col(n2)
    sizes = F.least(a, b) * high >= F.greatest(a, b) * low
    room = F.least(F.col(rest1), F.col(rest2)) * (low + high) >= (a + b) * low
    index1, index2 = _lengths(a)[1], _lengths(b)[1]
    early = ((a <= b) & (F.col(at1) < index1)) | ((b <= a) & (F.col(at2) < index2))
    return sizes & room & early


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (node, id, n_shingles, component_id, kept) for each document; ``kept`` holds for the node of a component's least id."""
    signed = materialize(heads(docs, key, text), "join-heads")
    members, reps = representatives(signed, "need", "head")
    discard(signed)

    early = reps.select("id", "need", F.explode("head").alias("shingle"))
    near = materialize(early.join(_shared(early), "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("id"), "join-near")
    sets = materialize(full_sets(docs, key, text, reps.join(near, "id", "left_semi").select("node", "id"), WIDTH), "join-sets")
    grouped = groups(prefixes(sets))
    tokens = grouped.filter("id = gid").select("gid", "n", "alone", F.posexplode("common").alias("at", "shingle")).select("gid", "n", (F.col("alone") + F.col("at")).alias("at"), "shingle")
    tokens = materialize(tokens.join(_shared(tokens), "shingle", "left_semi").select("shingle", "gid", "n", "at", (F.col("n") - F.col("at")).alias("rest")), "join-tokens")

    # A group's least member for its members; for groups the least group of a shingle, first the one met most often.
    centre = tokens.groupBy("shingle").agg(F.min(F.struct("gid", "n", "at", "rest")).alias("c")).select("shingle", F.col("c.gid").alias("b"), F.col("c.n").alias("nb"), F.col("c.at").alias("pb"), F.col("c.rest").alias("rb"))
    met = tokens.join(centre, "shingle").filter((F.col("gid") != F.col("b")) & _fits("n", "rest", "at", "nb", "rb", "pb"))
    stars = materialize(met.groupBy(F.col("gid").alias("a"), "b").agg(F.count("*").alias("shared")), "join-stars")
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    within = grouped.filter("id != gid").select(F.col("id").alias("a"), F.col("gid").alias("b"))
    first = materialize(best.unionByName(within), "join-first")
    edges = materialize(confirmed(first, sets, THRESHOLD), "join-edges")
    labels = reps.select("id", F.col("id").alias("label")).distinct()
    if not edges.isEmpty():
        found = components(edges)
        labels = materialize(labels.select("id").join(found.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label")), "near-labels")
        discard(found)
    labels = linked(labels, apart(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), labels), sets, THRESHOLD)

    across = materialize(expanded(tokens, grouped, labels), "join-across")
    labels = linked(labels, across, sets, THRESHOLD)
    discard(near, sets, grouped, tokens, stars, first, edges, across)
    return named_components(members, reps, labels)


def expanded(tokens: DataFrame, grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of members with different labels, of one group or of two groups that may link through a shingle."""
    parts = grouped.join(labels, "id").select("id", "gid", "label")
    units = parts.select("gid", "label").distinct()
    # Shingles at which more than one label stands, with the label that most groups there have; only units outside it look for partners.
    placed = tokens.join(units, "gid")
    counted = placed.groupBy("shingle", "label").agg(F.count("*").alias("n_label"))
    mixed = counted.groupBy("shingle").agg(F.max_by("label", F.struct("n_label", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("shingle", "most")
    here = placed.join(mixed, "shingle")
    x = here.filter("label != most").select("shingle", F.col("gid").alias("gx"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("at").alias("px"), F.col("rest").alias("rx"))
    y = here.select("shingle", F.col("gid").alias("gy"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("at").alias("py"), F.col("rest").alias("ry"))
    pairs = x.join(y, "shingle").filter((F.col("lx") != F.col("ly")) & _fits("nx", "rx", "px", "ny", "ry", "py")).select("gx", "lx", "gy", "ly").distinct()
    # Groups that hold several labels themselves.
    split = units.groupBy("gid").agg(F.max("label").alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("gid", "most")
    inner = units.join(split, "gid").filter("label != most").select("gid", F.col("label").alias("lx"))
    inner = inner.join(units.withColumnRenamed("label", "ly"), "gid").filter("lx != ly").select(F.col("gid").alias("gx"), "lx", F.col("gid").alias("gy"), "ly")
    both = pairs.unionByName(inner).distinct()
    left = parts.select(F.col("id").alias("x"), F.col("gid").alias("gx"), F.col("label").alias("lx"))
    right = parts.select(F.col("id").alias("y"), F.col("gid").alias("gy"), F.col("label").alias("ly"))
    return both.join(left, ["gx", "lx"]).join(right, ["gy", "ly"]).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of linked documents of every document."""
    found = join_components(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP12_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * p.c >= 85 * (na.c + nb.c - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.doc_id),
m AS (SELECT doc_id, min(low) AS component_id FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, component_id
FROM w JOIN m ON w.doc_id = m.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
