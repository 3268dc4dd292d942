"""Secret scans through an incremental ledger of blobs, in DataFrame functions only.

Every version of a path is named by the SHA-256 of its content (a blob). The ledger holds which
(blob, rule version) pairs were scanned and what was found. A run scans the distinct blobs that the
ledger lacks under the present rules, appends, and joins the findings back to all paths.

A rule is a pattern, matched from the left without overlap, and the least length of one of its
groups; matches that are too short are dropped after matching. Positions are code points.

Cases: a null text is empty; repeated rows come out as often as they went in; an empty table gives
an empty result; other columns are ignored; blobs without findings are remembered too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rainspark.session import materialise


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    at_least: int
    #: a plain test that every text with a match passes
    hint: str


# fixed values: the three base rules
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         "(?i)password|passwd|secret|token|api_?key"),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20, "AKIA"),
    Rule("hex", r"([0-9a-f]+)", 1, 24, "[0-9a-f]{24}"),
)
ADDED = (
    Rule("private_key", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, 1, "PRIVATE KEY-----"),
    Rule("web_token", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 40, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("prefixed", r"((?:gh[pousr]_|xox[abprs]-|glpat-|sk_live_)[A-Za-z0-9_-]+)", 1, 20, "gh[pousr]_|xox[abprs]-|glpat-|sk_live_"),
)
RULES = BASE + ADDED
RULE_VERSION = "2"
SCANNED = "blob binary, rules string"
FOUND = "blob binary, rules string, kind_no int, start long, end long"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, kind_no, start, end of every match in blobs(blob, text)."""
    lists = [
        F.struct(
            F.lit(n).alias("kind_no"),
            # each element is the gap since the last match, and the match
            F.when(F.col("text").rlike(r.hint), F.regexp_extract_all("text", F.lit(rf"\G[\s\S]*?(?:{r.pattern})"), 0)).alias("parts"),
        )
        for n, r in enumerate(rules)
    ]
    parts = (
        blobs.select("blob", F.explode(F.array(*lists)).alias("rule"))
        .select("blob", "rule.kind_no", "rule.parts")
        .where(F.size("parts") > 0)
        .select("blob", "kind_no", F.posexplode("parts").alias("n", "part"))
    )
    match, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    least = F.lit(None).cast("int")
    for n, r in enumerate(rules):
        mine = F.col("kind_no") == n
        match = F.when(mine, F.regexp_extract("part", r.pattern, 0)).otherwise(match)
        value = F.when(mine, F.regexp_extract("part", r.pattern, r.group)).otherwise(value)
        least = F.when(mine, F.lit(r.at_least)).otherwise(least)
    so_far = Window.partitionBy("blob", "kind_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.select(
            "blob", "kind_no", "n", F.length("part").cast("long").alias("part_length"), F.length(match).alias("match_length"),
            (F.length(value) >= least).alias("long_enough"),
        )
        .withColumn("end", F.sum("part_length").over(so_far))
        .where("long_enough")
        .select("blob", "kind_no", (F.col("end") - F.col("match_length")).alias("start"), "end")
    )


class Ledger:
    """What was scanned and found, in two tables below `path`, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION):
        self.spark, self.rules, self.version = spark, rules, version
        self.scanned_path, self.found_path = f"{path}/scanned", f"{path}/found"
        spark.createDataFrame([], SCANNED).write.mode("append").parquet(self.scanned_path)
        spark.createDataFrame([], FOUND).write.mode("append").parquet(self.found_path)

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(self.scanned_path).where(F.col("rules") == self.version).distinct()

    def found(self) -> DataFrame:
        return self.spark.read.schema(FOUND).parquet(self.found_path).where(F.col("rules") == self.version).distinct()

    def update(self, blobs: DataFrame) -> None:
        """Scan the distinct blobs(blob, text) that have no entry under these rules.

        Findings are appended before the entry: a run that is lost between the two is repeated, and
        what it has found twice counts once.
        """
        # copies meet in the partial aggregate before the shuffle
        unseen = blobs.dropDuplicates(["blob"]).join(self.scanned(), "blob", "left_anti")
        rules = F.lit(self.version).alias("rules")
        scan(unseen, self.rules).select("blob", rules, "kind_no", "start", "end").write.mode("append").parquet(self.found_path)
        new = blobs.select("blob").distinct().join(self.scanned(), "blob", "left_anti")
        new.select("blob", rules).write.mode("append").parquet(self.scanned_path)


def secret_findings(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """doc_id and found, an array of (start, kind_no, end) in that order, of every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    versions = docs.select("doc_id", blob_of(text).alias("blob"), text.alias("text"))
    ledger.update(versions.select("blob", "text"))
    found = ledger.found().groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end"))).alias("found"))
    # written out, the rows of a blob that a third of all rows hold can be split over tasks in the join
    found = materialise(found, "findings")
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")
    return versions.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", F.coalesce("found", none).alias("found"))
