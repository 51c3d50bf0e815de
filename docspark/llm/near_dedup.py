"""Near-duplicate documents by HyperMinHash.

A document is the set of its shingles, five words in a row. Shingle hashes fall into ``BUCKETS`` buckets; of each bucket the least
hash is stored as a register: its count of leading zeros and the next ``MANTISSA`` bits. Empty buckets borrow the register
of another bucket by a fixed series of probes, the same for every document. Registers, four at a time, make
band keys; documents that agree in a band are candidates. The share of equal registers, corrected for chance
collisions, estimates the Jaccard likeness; candidates that cannot reach the threshold (five standard errors) are
dropped and the others are confirmed on their full sets.

Work on groups. Documents with equal sets are one class and stand as one representative. In a band's group
every member is first compared with the least member only; members that this joins are one component. What is then
compared is only members of different components that share a rare shingle early enough (``sharing_rare``). A group of
thousands of near copies so costs about one comparison each, and no link between components is missed.

Defined results
* null text and texts without words: an empty set, linked with nothing, its own component.
* fewer than five words: the whole sequence is the one shingle.
* a node is a row's id and text together, by a 64-bit hash with null apart: equal ids with different texts are different
  nodes, null is an id like any other. Rows that agree in both are one node and get equal results.
* the kept node of a component is that of the least id (null last), of equal ids that of the least hash; its id names the component.
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

from docspark.llm.arrow_words import mix, word_hashes
from docspark.llm.common import discard, documents, materialize, text_or_empty

SHINGLE = 5
THRESHOLD = (75, 100)
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
BAND = 4
#: Chance that two different least hashes leave equal registers: half of them agree in leading zeros.
COLLISION = 0.5 / (1 << MANTISSA)
#: Five standard errors below the threshold.
LEAST_ESTIMATE = 0.75 - 5 * (0.75 * 0.25 / BUCKETS) ** 0.5
PROBES = 64


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words."""
    flat, counts = word_hashes(texts, lower=True)
    up = np.uint64(0x9E3779B97F4A7C15)
    n = len(flat)
    h = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        h = mix(h * up + flat[k : k + len(h)])
    ends = np.cumsum(counts)
    for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        size = end - begin
        if size >= width:
            yield np.unique(h[begin : end - width + 1])
        elif size:
            x = np.full(1, size, dtype=np.uint64)
            for w in flat[begin:end]:
                x = mix(x * up + w)
            yield x
        else:
            yield np.zeros(0, dtype=np.uint64)


def _probe_table() -> np.ndarray:
    x = np.arange(BUCKETS * PROBES, dtype=np.uint64) + np.uint64(1)
    return (mix(x) % np.uint64(BUCKETS)).astype(np.int64).reshape(BUCKETS, PROBES)


def registers(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The registers of a non-empty sorted set: leading zeros above the mantissa bits."""
    rest_bits = 64 - BUCKET_BITS
    bucket = (hashes >> np.uint64(rest_bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = hashes[first] & np.uint64((1 << rest_bits) - 1)
    # frexp of the top bits is exact enough for the exponent once halves are taken apart.
    high, low = (rest >> np.uint64(29)).astype(np.int64), (rest & np.uint64((1 << 29) - 1)).astype(np.int64)
    length = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 29, np.frexp(low.astype(np.float64))[1])
    zeros = rest_bits - length
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(BUCKETS, dtype=np.uint16)
    out[bucket[first]] = (np.minimum(zeros, 63).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    if len(first) < BUCKETS:
        full = np.zeros(BUCKETS, dtype=bool)
        full[bucket[first]] = True
        empty = np.flatnonzero(~full)
        tried = full[probes[empty]]
        source = probes[empty, tried.argmax(axis=1)]
        for k in np.flatnonzero(~tried.any(axis=1)):  # no probe met a full bucket: the next full one in a circle
            source[k] = (empty[k] + np.argmax(np.roll(full, -empty[k]))) % BUCKETS
        out[empty] = out[source]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, with the share of chance collisions taken out."""
    return np.maximum(((a == b).mean(axis=1) - COLLISION) / (1 - COLLISION), 0.0)


def node_of(key: str, text: str) -> Column:
    """A hash of a row's id and text; the flag tells a null id from a null text."""
    return F.xxhash64(F.col(key).isNull(), F.col(key), F.col(text))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row (node, name, n_shingles, digest, registers) for each document, ``name`` its id; digest and registers are null for empty sets."""
    kind = docs.schema[key].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probe_table()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, digest, regs = [], [], []
                for s in shingle_sets(part.column("text")):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(registers(s, probes).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("name"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["node", "name", "n_shingles", "digest", "registers"])

    rows = docs.select(node_of(key, text).alias("node"), F.col(key).alias("name"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(signed, f"node long, name {kind}, n_shingles long, digest binary, registers binary")


def bands(reps: DataFrame) -> DataFrame:
    """A row (band, id) for each band of each representative; ``band`` hashes the band's number and registers."""
    step = 2 * BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // BAND - 1)), lambda k: F.xxhash64(k, F.substring(F.col("registers"), k * step + 1, F.lit(step))))
    return reps.select("id", F.explode(keys).alias("band"))


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers allow the threshold, with their estimate."""
    regs = reps.select("id", "registers")
    both = pairs.join(regs.select(F.col("id").alias("a"), F.col("registers").alias("ra")), "a").join(regs.select(F.col("id").alias("b"), F.col("registers").alias("rb")), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            est = estimate(ra, rb)
            good = pa.array(est >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(est).filter(good)], names=["a", "b", "estimate"])

    return both.select("a", "b", "ra", "rb").mapInArrow(kept, f"a {kind}, b {kind}, estimate double")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Of the pairs (a, b) those whose full sets reach the threshold. The side that many pairs share comes last."""
    low, high = threshold
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("sb")), "b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) * high >= low * max(len(a), len(b)) else 0
                good.append(high * shared >= low * (len(a) + len(b) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(checked, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """A written table (id, label) with a row for each end of an edge; the label is the least id of its component.

    Labels fall to the least label among neighbours, then jump to their label's label, until nothing moves. Each round is written to
    the shared folder and the one before deleted.
    """
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "near-edges")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "near-labels")
    while True:
        old = labels.select("id", "label")
        near = both.join(old.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("low"))
        lower = old.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        to = old.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = materialize(lower.join(to, "label", "left").select("id", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "near-labels")
        discard(labels)
        labels = moved
        if labels.filter("was != label").isEmpty():
            discard(both)
            return labels


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components that ``links`` (a, b: labels) connect."""
    found = components(links)
    new = found.select(F.col("id").alias("label"), F.col("label").alias("low"))
    out = materialize(labels.join(new, "label", "left").select("id", F.coalesce("low", "label").alias("label")), "near-labels")
    discard(found, labels)
    return out


def representatives(signed: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Written tables of all rows with the node ``rep`` of their class of equal sets, and of the representatives (id, node, name, ...), numbered in order."""
    full = signed.filter("digest is not null")
    first = F.min(F.struct(F.col("name").isNull().alias("none"), "name", "node"))
    classes = full.groupBy("digest").agg(first["node"].alias("rep"))
    members = materialize(signed.select("node", "name", "n_shingles", "digest").join(classes, "digest", "left").select("node", "name", "n_shingles", F.coalesce("rep", "node").alias("rep"), "digest"), "near-members")
    one = members.filter("node = rep and digest is not null").select("node").distinct()
    single = full.join(one, "node", "left_semi").select("node", "name", *columns).dropDuplicates(["node"])
    return members, materialize(single.orderBy(F.col("name").asc_nulls_last(), "node").withColumn("id", F.monotonically_increasing_id()), "near-reps")


def named_components(members: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, id, n_shingles, component_id, kept) of all rows, from the labels (id, label) of representatives."""
    joined = labels.filter("id != label").join(reps.select(F.col("id").alias("label"), F.col("node").alias("lead"), F.col("name").alias("lead_name")), "label")
    named = joined.join(reps.select("id", F.col("node").alias("rep")), "id").select("rep", "lead", "lead_name")
    # A class that no other joins is led by its own representative.
    classes = members.filter("node = rep").select("rep", F.col("name").alias("rep_name")).distinct()
    own = members.join(classes, "rep").join(named, "rep", "left")
    component = F.when(F.col("lead").isNull(), F.col("rep_name")).otherwise(F.col("lead_name"))
    return own.select("node", F.col("name").alias("id"), "n_shingles", component.alias("component_id"), (F.col("node") == F.coalesce("lead", "rep")).alias("kept"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (node, id, n_shingles, component_id, kept) for each document; ``kept`` holds for one node of each component.

    Representatives are numbered in order of id and node, so that a component's least number is that of its kept node.
    """
    signed = materialize(signatures(docs, key, text), "near-signatures")
    members, reps = representatives(signed, "registers")
    discard(signed)

    banded = bands(reps)
    centre = banded.groupBy("band").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("band", "b")
    stars = banded.join(centre, "band").filter("id != b").select(F.col("id").alias("a"), "b").distinct()
    stars = materialize(likely(stars, reps), "near-stars")

    grouped = banded.join(centre.select("band"), "band", "left_semi").select("id").distinct()
    sets = materialize(full_sets(docs, key, text, reps.join(grouped, "id", "left_semi").select("node", "id")), "near-sets")
    best = materialize(stars.groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b")), "near-best")
    edges = materialize(confirmed(best, sets), "near-edges")
    labels = reps.select("id", F.col("id").alias("label")).distinct()
    if not edges.isEmpty():
        found = components(edges)
        labels = materialize(labels.select("id").join(found.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label")), "near-labels")
        discard(found)

    # Other stars whose ends are still apart, then members of one band group that are still apart.
    labels = linked(labels, apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), labels), sets)
    placed = banded.join(labels, "id")
    mixed = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band")
    held = placed.join(mixed, "band", "left_semi").select("id", "label").distinct()
    across, rare = sharing_rare(sets, held)
    labels = linked(labels, likely(across, reps).select("a", "b"), sets)
    discard(stars, best, edges, sets, rare)
    return named_components(members, reps, labels)


def sharing_rare(sets: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different labels among ``held`` (id, label) that may reach the threshold; none that does is missed. And the table they are read from.

    Each set is ordered by how many of the held sets a shingle is in, rarest first. Two sets that reach three quarters share a
    shingle within the first quarter and one of both (prefix filtering). At the first shingle they share, what is left of
    either set from there on must still hold all they need in common (positional filtering): shingles before it are in no
    common part. Families that share only a common passage, and copies each edited too far from the others, have
    shingles of their own first and do not meet, however many they are.

    Of two members with different labels one at least is outside the largest label among the members with a shingle. Only those outside
    look for partners: once a family's links are found, its members are not compared with each other.
    """
    kind = sets.schema["id"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                own = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in part.column("hashes")]
                n = np.array([len(x) for x in own])
                which = pa.array(np.repeat(np.arange(len(own)), n))
                yield pa.RecordBatch.from_arrays([part.column("id").take(which), part.column("label").take(which), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(np.concatenate(own))], names=["id", "label", "n", "shingle"])

    low, high = THRESHOLD
    each = sets.join(held, "id").select("id", "label", "hashes").mapInArrow(spread, f"id {kind}, label {kind}, n int, shingle long")
    often = each.groupBy("shingle").agg(F.count("*").cast("int").alias("often")).filter("often > 1")
    shared = each.join(often, "shingle").groupBy("id", "label", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("own"))
    # Shingles of this set alone come first and meet nobody; ``rest`` counts the shared ones from a position on.
    room = F.size("own") - F.ceil(F.col("n") * low / high).cast("int") + 1
    placed = shared.withColumn("room", room).filter("room > 0").select("id", "label", "n", F.size("own").alias("c"), F.posexplode(F.slice("own", F.lit(1), F.col("room"))["shingle"]).alias("at", "shingle"))
    placed = placed.select("shingle", "id", "label", "n", (F.col("c") - F.col("at")).alias("rest"))
    counted = placed.groupBy("shingle", "label").agg(F.count("*").alias("n_label"))
    mixed = counted.groupBy("shingle").agg(F.max_by("label", F.struct("n_label", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("shingle", "most")
    first = materialize(placed.join(mixed, "shingle"), "near-rare")
    x = first.filter("label != most").select("shingle", F.col("id").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("rest").alias("rx"))
    y = first.select("shingle", F.col("id").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("rest").alias("ry"))
    total = F.col("nx") + F.col("ny")
    near = (F.least("rx", "ry") * (low + high) >= total * low) & (F.least("nx", "ny") * high >= F.greatest("nx", "ny") * low) & (F.col("lx") != F.col("ly"))
    met = x.join(y, "shingle").filter(near)
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), first


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a").join(lb, "b").filter("la != lb").select("a", "b")


def linked(labels: DataFrame, pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Labels after confirming pairs of different labels and joining their components."""
    good = materialize(confirmed(pairs, sets, threshold), "near-edges")
    if good.isEmpty():
        discard(good)
        return labels
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    out = _relabelled(labels, good.join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a != b").distinct())
    discard(good)
    return out


def full_sets(docs: DataFrame, key: str, text: str, ids: DataFrame, width: int = SHINGLE) -> DataFrame:
    """A row (id, hashes) with the full set of each of ``ids`` (node, id)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), width)], pa.binary())], names=["id", "hashes"])

    rows = docs.select(node_of(key, text).alias("node"), text_or_empty(text).alias("text")).join(ids, "node").select("id", "text")
    return rows.mapInArrow(full, "id long, hashes binary").dropDuplicates(["id"])


def keep_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of the least id (null last); all columns. Of rows that agree in id and text, one is kept."""
    kept = near_components(docs, key, text).filter("kept").select(F.col("node").alias("_node")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), node_of(key, text).alias("_node"))
    return rows.join(kept, "_node", "left_semi").dropDuplicates(["_node"]).select("_doc.*")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = near_components(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * p.c >= 75 * (na.c + nb.c - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.doc_id),
m AS (SELECT doc_id, min(low) AS component_id FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m ON w.doc_id = m.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
