"""Removing runs of lines that repeat earlier ones, by winnowing over line hashes [native].

Lines without a word are set aside. What is deleted is the longest run of lines that stands earlier too, if it has ``RUN`` lines, or one line
of ``LONG_WORDS`` words.

Of every ``RUN`` successive line hashes of a text the least, the rightmost of equal
ones, is selected; two runs of ``RUN`` equal lines select the same line, so a repeated run always shares a selected
fingerprint. A long line is a fingerprint of its own. Only fingerprints that occur more than once are followed up: their positions meet
by the stretches of ``RUN`` lines that hold them, on either side, and every stretch is set against its first occurrence, by id and position.
Each line further on is held by the next stretch, so that stretches that meet extend a match both ways as far as its
lines agree. Stretches meet by 96 bits, two hashes of their lines.

Defined results
* null text: stays null. Empty texts lose nothing.
* order of first and later: id (null first), then a hash of the text, then position. Rows that agree in id and text are one
  occurrence: they are treated alike and do not delete each other.
* a text that repeats itself keeps its first run. Lines without a word always stay.
* very long texts: linear time. Empty tables: an empty result.
* other columns, whatever their names, are carried through ``remove_repeated_lines``; ``n_chars``, where there is one, is renewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import documents, materialize, text_or_empty, words

RUN = 3
LONG_WORDS = 50
_HASH_BITS = 0x7FFFFFFF00000000
_LAST = 0x7FFFFFFF


def _least_ahead(packed: Column, reach: int) -> Column:
    return F.transform(packed, lambda x, i: F.least(x, *(F.get(packed, i + k) for k in range(1, reach))))


def fingerprints(lines: DataFrame, run: int = RUN) -> DataFrame:
    """A row (id, mark, line, stretches) for each selected line and each long one.

    ``lines`` has (id, mark, h), h the hashes of a text's lines: ``one``, ``two`` and whether the line is ``long``. ``stretches`` are (start, n,
    key, check): the stretches of ``run`` lines that hold the line, or the long line itself, with two hashes of their lines.
    """
    h = F.col("h")
    packed = lines.withColumn("p", F.transform(h, lambda x, i: x["one"].bitwiseAND(F.lit(_HASH_BITS)).bitwiseOR(F.lit(_LAST) - i)))
    least = F.when(F.size("p") >= run, F.array_distinct(F.slice(_least_ahead(F.col("p"), run), F.lit(1), F.greatest(F.size("p") - (run - 1), F.lit(1))))).otherwise(F.array().cast("array<bigint>"))
    chosen = packed.select("id", "mark", "h", F.transform(least, lambda m: (F.lit(_LAST) - m.bitwiseAND(F.lit(_LAST))).cast("int")).alias("ats"))
    hash_of = lambda s, n: (F.xxhash64(F.lit(n), *(F.get(h, s + k)["one"] for k in range(n))), F.hash(F.lit(n), *(F.get(h, s + k)["two"] for k in range(n))))

    def stretch(s: Column, n: int) -> Column:
        key, check = hash_of(s, n)
        return F.struct(s.cast("int").alias("start"), F.lit(n).alias("n"), key.alias("key"), check.alias("check"))

    def around(at: Column) -> Column:
        starts = F.sequence(F.greatest(at - (run - 1), F.lit(0)), F.least(at, F.size("h") - run))
        return F.struct(F.get(h, at)["one"].alias("line"), F.transform(starts, lambda s: stretch(s, run)).alias("stretches"))

    whole = F.array_compact(F.transform(h, lambda x, i: F.when(x["long"], F.struct(F.xxhash64(x["one"]).alias("line"), F.array(stretch(i, 1)).alias("stretches")))))
    return chosen.select("id", "mark", F.inline(F.concat(F.transform("ats", around), whole)))


def later_stretches(lines: DataFrame, run: int = RUN) -> DataFrame:
    """The stretches (id, mark, start, n) that occur earlier."""
    marks = materialize(fingerprints(lines, run), "line-marks")
    twice = marks.groupBy("line").count().filter("count > 1").select("line")
    near = marks.join(twice, "line", "left_semi").select("id", "mark", F.inline("stretches"))
    place = F.struct("id", "mark", "start")
    # Written, so that the join below is free to deal a hot stretch to several tasks.
    first = materialize(near.groupBy("key", "check").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").select("key", "check", "first"), "line-firsts")
    return near.join(first, ["key", "check"]).filter(~place.eqNullSafe(F.col("first"))).select("id", "mark", "start", "n").distinct()


def _with_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.withColumns({"_mark": F.xxhash64(text), "_lines": F.split(text_or_empty(text), "\n")})
    worded = F.transform("_lines", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i))
    return rows.withColumn("_worded", F.array_compact(worded))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with two more columns: ``_lines``, all lines of the text, and ``_kept``, the indexes of those that stay."""
    rows = _with_lines(docs, key, text)
    lines_ = F.col("_lines")
    # So many words have so many characters at least; few lines are split to be counted.
    long = lambda x: F.when(F.octet_length(x) >= 2 * long_words - 1, F.size(words(x)) >= long_words).otherwise(False)
    hashed = F.transform(F.transform("_worded", lambda i: F.get(lines_, i)), lambda x: F.struct(F.xxhash64(x).alias("one"), F.hash(x).alias("two"), long(x).alias("long")))
    hashes = rows.select(F.col(key).alias("id"), F.col("_mark").alias("mark"), hashed.alias("h"))
    gone = later_stretches(hashes, run).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("_gone"))
    gone = gone.select(F.col("id").alias("_id"), F.col("mark").alias("_m"), "_gone")
    both = rows.join(gone, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m")), "left")
    worded = F.col("_worded")
    covered = F.flatten(F.transform("_gone", lambda s: F.transform(F.sequence(s["start"], s["start"] + s["n"] - 1), lambda k: F.get(worded, k))))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.when(F.col("_gone").isNull(), every).otherwise(F.array_except(every, covered))
    return both.withColumn("_kept", kept).drop("_id", "_m", "_gone", "_worded", "_mark")


def kept_text() -> Column:
    lines_ = F.col("_lines")
    return F.array_join(F.transform("_kept", lambda i: F.get(lines_, i)), "\n")


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """The documents with repeated runs deleted from ``text``; their columns are those of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    cut = without_repeats(rows, "_key", "_text", run)
    changed = F.size("_kept") < F.size("_lines")
    cut = cut.withColumn("_new", F.when(changed, kept_text()).otherwise(F.col("_text")))
    renewed = {text: F.col("_new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        renewed["n_chars"] = F.when(changed, F.char_length("_new").cast(kind)).otherwise(F.col("_doc")["n_chars"])
    return cut.select(*(renewed.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps: its lines, those removed, and the hash of the text that stays."""
    cut = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("bigint").alias("n_removed_lines"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


OP2_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
n AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM e WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
w AS (
  SELECT a.doc_id, a.j, a.line || chr(10) || b.line || chr(10) || c.line AS k
  FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.j = a.j + 1 JOIN n c ON a.doc_id = c.doc_id AND c.j = a.j + 2
),
r AS (SELECT doc_id, j, row_number() OVER (PARTITION BY k ORDER BY doc_id, j) AS nth FROM w),
b AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY line ORDER BY doc_id, j) AS nth
  FROM n WHERE len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) >= 50
),
x AS (
  SELECT doc_id, j + o AS j FROM r, (VALUES (0), (1), (2)) v(o) WHERE nth > 1
  UNION SELECT doc_id, j FROM b WHERE nth > 1
),
g AS (SELECT n.doc_id, n.i FROM n JOIN x ON n.doc_id = x.doc_id AND n.j = x.j)
SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed_lines,
  sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN e.line END, chr(10) ORDER BY e.i), '')) AS kept_sha256
FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i
GROUP BY e.doc_id
"""
