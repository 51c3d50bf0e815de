"""Document fingerprints by winnowing [native].

Every ``GRAM`` successive characters of a text are hashed; of each window of ``WINDOW`` successive hashes the least is
selected, the rightmost of equal ones, with its position. Two texts that share ``WINDOW + GRAM - 1`` characters, at whatever offsets
and in whatever script, share at least one selected hash.

All of this is array expressions on one row. One pass of a regular expression with a look-ahead rolls over the text and gives the gram at every
character. A hash and its position are packed into one long, hash first and position reversed, so that the least long of a window is its
rightmost least hash; minima of windows are built up from those of shorter ones. An edited text shares its first half with its original, and
only what is new in it is hashed.

Defined results
* null text: the empty text. Empty texts have an empty fingerprint; two empty fingerprints have likeness 1, one
  empty and one other 0.
* texts of fewer characters than a gram: the whole text is the one gram. Fewer grams than a window: one window.
* repeated rows and equal ids: the order is descending id (null last), then a hash of the text; each row has a next row. Rows of a hot id
  are dealt to many ranges by that hash.
* a single document is its own next one; an empty table gives an empty result.
* very long texts: linear time; the grams of one text are in memory at once.
* other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from docspark.llm.common import documents, text_or_empty

GRAM = 12
#: A window of hashes, and how its minima are built: of the hash at hand and those so far ahead, then of these minima, and so on.
WINDOW = 32
AHEAD = ((1, 2, 3), (4, 8, 12), (16,))
_HASH_BITS = 0x7FFFFFFF00000000
_LAST = 0x7FFFFFFF
NO_LONGS = "array<bigint>"
#: Characters at a place and after it; a look-ahead, so that the next match starts one character on. Halves of a surrogate pair start no gram.
_GRAMS = r"(?s)(?=([^\x{DC00}-\x{DFFF}].{%d}))" % (GRAM - 1)


def _none() -> Column:
    return F.array().cast(NO_LONGS)


def _packed(text: Column, first: Column) -> Column:
    """The hashes of all grams with their positions, the first gram's being ``first``."""
    grams = F.when(F.char_length(text) >= GRAM, F.regexp_extract_all(text, F.lit(_GRAMS), F.lit(1))).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(_HASH_BITS)).bitwiseOR(F.lit(_LAST) - first - i))


def _least_of(array: str, steps: tuple[int, ...]) -> Column:
    return F.transform(array, lambda x, i: F.least(x, *(F.get(F.col(array), i + s) for s in steps)))


def _with_least(rows: DataFrame, packed: str, into: str) -> DataFrame:
    """Add the least of the window that starts at each hash. Each level is its own projection, so that it is computed once."""
    at = packed
    for k, steps in enumerate(AHEAD):
        rows = rows.withColumn(f"{into}_{k}", _least_of(at, steps))
        at = f"{into}_{k}"
    return rows.withColumn(into, F.col(at)).drop(*(f"{into}_{k}" for k in range(len(AHEAD))))


def _windows(packed: str) -> Column:
    """How many windows a text has."""
    return F.when(F.size(packed) == 0, 0).otherwise(F.greatest(F.size(packed) - (WINDOW - 1), F.lit(1)))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add ``into``: the selected packed hashes of ``text``, in order of position."""
    rows = docs.withColumn("_p", _packed(text_or_empty(text), F.lit(0)))
    return _with_least(rows, "_p", "_m").withColumn(into, F.array_distinct(F.slice("_m", F.lit(1), _windows("_p")))).drop("_p", "_m")


def position(packed: Column) -> Column:
    return F.lit(_LAST) - packed.bitwiseAND(F.lit(_LAST))


def shown(chosen: Column) -> Column:
    """Hashes in hexadecimal with their positions: hash@position, in order of position."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 32))), F.lit("@"), position(x).cast("string"))), ",")


def hash_set(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard likeness of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def in_circle(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, WindowSpec]:
    """The rows of ``docs`` with ``_guest``, and a window in which each row's next one is that in descending ``key``, after the last the first.

    Whoever has taken what he needs from the next row filters on ``_guest = 0``: guests are the first rows of the next range.

    Rows are dealt by ranges of the key, whose bounds are approximate quantiles; each range sees
    its successor's first row as a guest. There are about as many ranges as rows in a range, and the driver sees their bounds only. Rows
    without a key come last, in ranges of the hash that orders them. A key that holds several quantiles is dealt by that hash too; only rows
    that agree in key and text stay together.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_tie", F.bitwise_not(F.xxhash64(text)))
    n, none = docs.agg(F.count(key), F.count_if(F.col(key).isNull())).first()
    ranges = max(1, math.isqrt(n))
    found = docs.agg(F.percentile_approx(key, [k / ranges for k in range(ranges)], max(10_000, 10 * ranges))).first()[0]
    bounds = sorted(set(found or []))
    times = Counter(found or [])
    part = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + part] for i in range(0, len(bounds), part)]
    # Ranges of null keys: the top bits of the hash, in order.
    bits = min(62, (max(1, math.isqrt(none)) - 1).bit_length())
    nulls = F.shiftright("_tie", 63 - bits) - F.lit(1 << bits) - 1
    of = nulls
    if bounds:
        # The bounds are one literal, a JSON text that Spark parses while it optimizes: however many there are, the plan has the same size.
        kind = docs.schema[key].dataType.simpleString()
        kinds = f"parts array<array<{kind}>>, firsts array<{kind}>, hot array<{kind}>"
        held = spark.createDataFrame([(parts, [p[0] for p in parts], [b for b in bounds if times[b] > 1])], kinds)
        held = F.from_json(F.lit(held.select(F.to_json(F.struct("*"))).first()[0]), kinds)
        at = F.greatest(F.size(F.filter(held["firsts"], lambda b: b <= F.col(key))), F.lit(1))
        inner = F.element_at(held["parts"], at)
        of = at * part + F.size(F.filter(inner, lambda b: b <= F.col(key)))
        # A hot key is the least of its range: its pieces, by the top bits of the hash, come before the range's other keys.
        more = (max(times.values()) - 1).bit_length()
        piece = F.when(F.array_contains(held["hot"], F.col(key)), F.shiftright("_tie", 63 - more) + F.lit(1 << more)).otherwise(F.lit(2 << more))
        of = of.cast("long") * ((2 << more) + 1) + piece
        of = F.when(F.col(key).isNull(), nulls).otherwise(of)
    dealt = docs.withColumn("_range", of.cast("long"))
    heads = dealt.groupBy("_range").agg(F.max(F.struct(key, "_tie")).alias("head")).orderBy(F.desc("_range")).collect()
    guests = [(h["head"][0], h["head"][1], heads[i - 1]["_range"]) for i, h in enumerate(heads)]
    to = spark.createDataFrame(guests, f"_head {docs.schema[key].dataType.simpleString()}, _head_tie long, _to long")
    is_head = F.col(key).eqNullSafe(F.col("_head")) & (F.col("_tie") == F.col("_head_tie"))
    guest = docs.join(F.broadcast(to), is_head).select(*docs.columns, F.col("_to").alias("_range"), F.lit(1).alias("_guest"))
    w = Window.partitionBy("_range").orderBy("_guest", F.col(key).desc_nulls_last(), F.col("_tie").desc())
    both = dealt.select(*docs.columns, "_range", F.lit(0).alias("_guest")).unionByName(guest)
    return both, w


def with_next(docs: DataFrame, key: str, carry: str) -> DataFrame:
    """Add ``next_<carry>``: the value of ``carry`` in the row next in descending ``key``, after the last the first."""
    rows, window = in_circle(docs, key, carry)
    return rows.withColumn(f"next_{carry}", F.lead(carry).over(window)).filter("_guest = 0").drop("_guest", "_range", "_tie")


def edited_fingerprints(rows: DataFrame) -> DataFrame:
    """Rows with ``text`` and ``next_text``: add ``n``, the edited text's hash ``edited_sha256``, and the fingerprints ``fp`` and ``edited_fp``.

    The edited text keeps the first ``stay`` characters. Its first ``a`` grams are those of the text, and so are its first ``b`` windows.
    """
    rows = rows.withColumn("n", F.char_length("text")).withColumn("stay", (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, stay)"), F.expr("substring(next_text, 1, n - stay)")))
    rows = rows.withColumn("a", F.greatest(F.col("stay") - (GRAM - 1), F.lit(0))).withColumn("b", F.greatest(F.col("a") - (WINDOW - 1), F.lit(0)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("rest", F.expr("substring(edited, a + 1)")).drop("edited", "next_text")
    rows = _with_least(rows.withColumn("p", _packed(F.col("text"), F.lit(0))).drop("text"), "p", "m")
    new = F.when((F.col("a") == 0) | (F.char_length("rest") >= GRAM), _packed(F.col("rest"), F.col("a"))).otherwise(_none())
    rows = rows.withColumn("q", F.concat(F.slice("p", F.col("b") + 1, F.col("a") - F.col("b")), new)).drop("rest")
    rows = rows.withColumn("fp", F.array_distinct(F.slice("m", F.lit(1), _windows("p")))).withColumn("old", F.slice("m", F.lit(1), F.col("b"))).drop("p", "m")
    rows = _with_least(rows, "q", "mq")
    more = F.when(F.col("b") > 0, F.greatest(F.size("q") - (WINDOW - 1), F.lit(0))).otherwise(_windows("q"))
    return rows.withColumn("edited_fp", F.array_distinct(F.concat("old", F.slice("mq", F.lit(1), more)))).drop("q", "mq", "old", "stay", "a", "b")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty("text").alias("text"))
    rows, window = in_circle(docs, "doc_id", "text")
    rows = rows.withColumn("next_text", F.coalesce(F.lead("text").over(window), F.lit("")))
    # Guests keep their fingerprint for the row before them; the same window finds it without another shuffle or sort.
    rows = edited_fingerprints(rows).withColumn("next_fp", F.lead("fp").over(window)).filter("_guest = 0")
    rows = rows.withColumns({"s": hash_set(F.col("fp")), "t": hash_set(F.col("edited_fp")), "u": hash_set(F.col("next_fp"))})
    return rows.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        "edited_sha256",
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("t")).alias("near_edited"),
        likeness(F.col("s"), F.col("u")).alias("near_next"),
    )
