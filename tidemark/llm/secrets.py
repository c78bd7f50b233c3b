"""Secret scans over an incremental blob ledger."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.scratch import fresh, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the match of ``pattern``, kept if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: The rules; their order breaks ties of start. A run of hex digits or of an access key is the whole
#: run, so its least length stands in the pattern; an assignment that fails still uses up its text.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
)
#: Matches whose spans are made at a time.
SPANS = 256

LEDGER_SCHEMA = "blob string, rule_version string, findings array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def rule_version(rules=RULES) -> str:
    """A digest of the rules, so that changed rules make the ledger scan old blobs anew."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least, r.base) for r in rules]).encode()).hexdigest()[:16]


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches in code points. What stands between matches comes from split(), the
    matches from regexp_extract_all(); running sums of their lengths are the positions, taken over lots
    of matches first, so that texts with very many cost no more than in proportion."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    lengths = F.zip_with(F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), whole, lambda gap, m: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("len"))), part, lambda x, p: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (F.length(p) >= rule.least).alias("ok")))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + x["len"]).alias("end"))
        return F.struct((begin + x["len"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zero = F.lit(0).cast("bigint")
    lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / SPANS).cast("int")), lambda i: F.slice(lengths, i * SPANS + 1, SPANS))
    ahead = lambda acc, lot: F.struct((acc["at"] + F.aggregate(lot, zero, lambda n, x: n + x["gap"] + x["len"])).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), lot.alias("lot")))).alias("out"))
    none = F.array().cast("array<struct<at:bigint,lot:array<struct<gap:bigint,len:bigint,ok:boolean>>>>")
    placed = F.aggregate(lots, F.struct(zero.alias("at"), none.alias("out")), ahead, lambda acc: acc["out"])
    found = F.flatten(F.transform(placed, lambda p: F.aggregate(p["lot"], F.struct(p["at"].alias("at"), empty.alias("out")), add, lambda acc: acc["out"])))
    return F.when(text.rlike(rule.pattern), found).otherwise(empty)


def scan_blobs(blobs: DataFrame, rules=RULES, version: str | None = None) -> DataFrame:
    """(blob, text) -> ledger rows (blob, rule_version, findings), findings by start, then rule."""
    found = F.concat(*[_spans(F.col("text"), r, i) for i, r in enumerate(rules)])
    return blobs.select("blob", F.lit(version or rule_version(rules)).alias("rule_version"), F.sort_array(found).alias("findings"))


def secret_ledger(versions: DataFrame, ledger: DataFrame | None = None, *, text_column: str = "text", rules=RULES, version: str | None = None) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs that ``ledger`` lacks; each blob is scanned once.

    ``versions`` holds every historical version of every path; a version's address is the SHA-256 of
    its bytes. Copies of a blob are folded before the shuffle, so a blob with a third of all rows
    costs one row a task.
    """
    version = version or rule_version(rules)
    blobs = versions.select(F.sha2(text_of(text_column).cast("binary"), 256).alias("blob"), text_of(text_column).alias("text"))
    if ledger is not None:
        done = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
        blobs = blobs.join(done, "blob", "left_anti")
    return scan_blobs(blobs.groupBy("blob").agg(F.first("text").alias("text")), rules, version)


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, *, keep=("doc_id",), text_column: str = "text", rules=RULES, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows). findings: the columns ``keep`` of each version, its blob and its
    findings array (empty where there are none); the last two have underscores behind their names where
    a kept column is called so.

    The new ledger rows are written to the shared folder once and joined back to all paths; append
    them to the ledger table for the next run. Null texts count as empty; an empty text and a text
    without secrets have no findings; very long texts are scanned whole; matches that start together
    come in the order of the rules; repeated rows each get theirs; an empty table gives no rows;
    other columns are not read, so none can clash.
    """
    version = version or rule_version(rules)
    new = written(secret_ledger(versions, ledger, text_column=text_column, rules=rules, version=version), "ledger")
    known = new if ledger is None else new.unionByName(ledger.filter(F.col("rule_version") == version).select(new.columns))
    return _of_paths(versions, known, keep, text_column), new


def _of_paths(versions: DataFrame, ledger: DataFrame, keep, text_column: str) -> DataFrame:
    kept = versions.select(*keep)
    blob, findings, known, told = fresh(kept, "blob", "findings", "_blob", "_findings")
    some = ledger.filter(F.size("findings") > 0).select(F.col("blob").alias(known), F.col("findings").alias(told))
    paths = versions.select(*keep, F.sha2(text_of(text_column).cast("binary"), 256).alias(blob))
    found = paths.join(some, F.col(blob) == F.col(known), "left").drop(known)
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return found.withColumn(findings, F.coalesce(told, none)).drop(told)


def scan_into(path: str, versions: DataFrame, *, keep=("doc_id",), text_column: str = "text", rules=RULES) -> tuple[DataFrame, int]:
    """scan_history() with a ledger kept as Parquet under ``path``: (findings, blobs scanned now).

    What the ledger lacks is scanned and appended by Spark's commit protocol; run again over the same
    versions and rules, nothing is. One writer at a time: two that overlap scan some blobs twice, and
    the ledger's copies of a pair are folded when it is read. Matches that start together come in the
    order of the rules; other awkward rows as in scan_history().
    """
    spark, version = versions.sparkSession, rule_version(rules)
    try:
        ledger = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    new = secret_ledger(versions, ledger, text_column=text_column, rules=rules, version=version)
    added = written(new, "ledger")
    added.write.mode("append").parquet(path)
    known = spark.read.schema(LEDGER_SCHEMA).parquet(path).filter(F.col("rule_version") == version).dropDuplicates(["blob"])
    return _of_paths(versions, known, keep, text_column), added.count()


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def secret_report(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans as text."""
    found, _ = scan_history(versions, ledger, rules=rules)
    base = [r for r in rules if r.base]
    line = lambda keep: F.array_join(F.transform(F.filter("findings", keep), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    is_base = lambda x: x["kind"].isin([r.kind for r in base])
    return found.select(
        "doc_id",
        *[F.size(F.filter("findings", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules],
        F.sha2(line(is_base).cast("binary"), 256).alias("base_sha256"),
        line(lambda x: F.lit(True)).alias("spans"),
    )
