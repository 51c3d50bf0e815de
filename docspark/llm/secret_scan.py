"""Secret scanning with a blob ledger [native].

Every version of every text is addressed by its content (SHA-256). A ledger, a Parquet table,
remembers which rule versions have scanned which blob and what they found. A scan looks only at
pairs of blob and rule version that the ledger lacks; findings join back to every path that
ever held the blob.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind: they follow
from the lengths of the gaps between matches, summed by a window over the matches of a blob. No row leaves the JVM, a text is read once
for each rule, and only lengths are shuffled.

Defined results
* null text: the empty text; empty texts have no spans.
* repeated rows and equal texts: one blob, scanned once; each row gets the findings.
* ties (spans of several kinds at one start): in the order of ``RULES``.
* very long texts: matching is linear; placing sorts the matches of a blob.
* a changed rule: findings carry the version that made them; those of other versions are not returned.
* empty tables: an empty result and an empty ledger part. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import discard, documents, materialize, shared_dir, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url_password", r"://[^\s/:@]++:[^\s/:@]{3,}+@", version=2),
)
RULES = BASE_RULES + MORE_RULES
LENGTHS = "array<struct<rank:int,gap:int,hit:int,part:int>>"
FINDING = "struct<start:int,rank:int,end:int,kind:string,version:int>"


def _lengths(text: Column, rule: Rule, rank: int) -> Column:
    """For each match of a rule the characters between it and the one before, those of the match, and those of its group."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part")
    )
    each = lambda x: F.struct(F.lit(rank).alias("rank"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), F.char_length(x["part"]).alias("part"))
    return F.when(text.rlike(rule.pattern), F.filter(F.transform(zipped, each), lambda x: x["hit"].isNotNull())).otherwise(F.array().cast(LENGTHS))


def _placed(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row (blob, findings) for each blob with findings: matches long enough, at the sums of the lengths before them."""
    hits = scanned.select("blob", F.posexplode("lengths").alias("at", "x")).select("blob", "at", "x.*")
    end = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("blob", "rank").orderBy("at"))
    of = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("rank") + 1)
    found = hits.withColumn("end", end.cast("int")).filter(F.col("part") >= of([r.least for r in rules]))
    finding = F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", "end", of([r.kind for r in rules]).alias("kind"), of([r.version for r in rules]).alias("version"))
    return found.groupBy("blob").agg(F.array_sort(F.collect_list(finding.cast(FINDING))).alias("findings"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: a row for each scan of a blob, with the rule versions it ran and what they found."""
    schema = f"blob string, rules array<string>, findings array<{FINDING}>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no scan has been written yet
        return spark.createDataFrame([], schema)


def scan_new_blobs(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what the ledger lacks, append it to the ledger and return the ledger.

    A blob's text is taken from one of the rows that hold it: the least key of each blob is found by a
    partial aggregation, so thousands of copies cost one scan and no more than a row for each task in the shuffle.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumn("blob", F.sha2(F.col("_text"), 256))
    ledger = read_ledger(spark, ledger_path)
    known = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    todo = (
        rows.groupBy("blob")
        .agg(F.min("_key").alias("_key"))
        .join(known, "blob", "left")
        .withColumn("todo", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))))
        .filter(F.size("todo") > 0)
        .select(F.col("blob").alias("_blob"), F.col("_key").alias("_first"), "todo")
    )
    one = rows.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("_blob")) & F.col("_key").eqNullSafe(F.col("_first"))).select("blob", "todo", "_text")
    lengths = F.concat(*(F.when(F.array_contains("todo", r.key), _lengths(F.col("_text"), r, k)).otherwise(F.array().cast(LENGTHS)) for k, r in enumerate(rules)))
    scanned = materialize(one.select("blob", F.col("todo").alias("rules"), lengths.alias("lengths")), "secret-lengths")
    once = scanned.dropDuplicates(["blob"])  # rows of equal key and text are scanned each
    found = _placed(once.filter(F.size("lengths") > 0), rules)
    fresh = once.select("blob", "rules").join(found, "blob", "left").select("blob", "rules", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias("findings"))
    fresh.write.mode("append").parquet(ledger_path)
    discard(scanned)
    return read_ledger(spark, ledger_path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (key, findings) for each row of ``versions``; findings of other rule versions are left out."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    ranks = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)))
    name = lambda x: F.concat_ws("@", x["kind"], x["version"])
    own = F.filter("findings", lambda x: F.array_contains(keys, name(x)))
    # A later scan may have numbered its rules in another order: ranks are those of ``rules``.
    ranked = F.transform(own, lambda x: F.struct(x["start"], ranks[name(x)].alias("rank"), x["end"], x["kind"], x["version"]).cast(FINDING))
    one = (
        ledger.filter(F.arrays_overlap("rules", keys) & (F.size("findings") > 0))
        .select("blob", F.explode(ranked).alias("x"))
        .distinct()  # two scans that ran at the same time may have found the same
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list("x")).alias("findings"))
    )
    rows = versions.select(key, F.sha2(text_or_empty(text), 256).alias("blob"))
    return rows.join(one, "blob", "left").select(key, F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias("findings"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: x["kind"] == kind)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets in every document, by a scan that starts with an empty ledger."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ledger = scan_new_blobs(docs, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    found = F.col("findings")
    base = F.filter(found, lambda x: x["rank"] < len(BASE_RULES))
    return findings_by_path(docs, ledger).select(
        "doc_id",
        *(F.size(_of_kind(found, r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(found).alias("spans"),
    )
