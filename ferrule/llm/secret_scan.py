"""Secret scans over a ledger of blobs, in DataFrame functions only.

A version of a file is named by the SHA-256 of its text. The ledger holds every (blob, rule@version) pair that
was ever scanned (a row a blob and scan, with the scan's rules), with what was found; a scan takes the blobs for which some pair is missing, one text a blob, applies just
the missing rules, and joins findings back to every path that holds the blob. Raising a rule's version makes its pairs unseen again.

Positions come from the lengths of the matches and of the text between them, so no text leaves its first stage.
Offsets are code points, end exclusive. A rule's ``least`` drops matches whose group is shorter, after matching.

Null text: empty, no findings. Null path: kept as a path. Repeated rows: each gets its blob's findings. Empty table:
no rows. Extra columns are ignored. Texts are scanned whole, at any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrule.llm.shared import materialise, shared_dir


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    needs: str = ""  # text without this literal holds no match

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans at one place are listed. The bounds in access and hex cut no match short: a run that is too short holds no longer one.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True, needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needs="eyJ"),
    Rule("git_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
)
_SPAN = "array<struct<kind:string,version:int,no:int,i:int,gap:int,size:int,held:int>>"


def _raw(text: Column, no: int, rule: Rule, wanted: Column | None) -> Column:
    """For each match: its number, the code points between it and the one before, its own, and its group's."""
    p = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    held = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else whole
    rows = F.transform(
        F.arrays_zip(whole.alias("m"), F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("g"), held.alias("h")),
        lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(no).alias("no"), i.alias("i"), F.length(x[F.lit("g")]).alias("gap"), F.length(x[F.lit("m")]).alias("size"), F.length(x[F.lit("h")]).alias("held")),
    )
    hit = text.rlike(rule.pattern)
    hit = F.contains(text, F.lit(rule.needs)) & hit if rule.needs else hit
    hit = wanted & hit if wanted is not None else hit
    return F.when(hit, rows.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def blob_of(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """blob, text, todo: one row a blob with a pair that the ledger lacks; ``todo`` null: all rules."""
    blobs = versions.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs.withColumn("todo", F.lit(None).cast("array<string>"))
    names = F.array(*(F.lit(r.name) for r in rules))
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("_seen"))  # no pair is there twice
    todo = F.array_except(names, F.coalesce("_seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


#: ``rules``: the names applied by the scan that wrote the row; ``found``: all that they found, rule by rule.
LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:bigint,end:bigint>>"


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Rows of the ledger for ``unseen`` blobs: one a blob, whether something was found or not."""
    wanted = lambda r: F.col("todo").isNull() | F.array_contains("todo", r.name)
    names = F.array(*(F.lit(r.name) for r in rules))
    raw = blobs.select("blob", F.coalesce("todo", names).alias("rules"), F.explode_outer(F.concat(*(_raw(F.col("text"), k, r, wanted(r)) for k, r in enumerate(rules)))).alias("x")).select("blob", "rules", "x.*")
    # all of it is dealt by blob already, so nothing is shuffled after the texts
    upto = F.sum(F.col("gap").cast("long") + F.col("size")).over(W.partitionBy("blob", "no").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("no") + 1)
    placed = raw.withColumn("end", upto).withColumn("x", F.when(F.col("held") >= least, F.struct(F.element_at(names, F.col("no") + 1).alias("rule"), (F.col("end") - F.col("size")).alias("start"), "end")))
    return placed.groupBy("blob").agg(F.first("rules").alias("rules"), F.sort_array(F.collect_list("x")).alias("found")).select("blob", "rules", F.col("found").cast("array<struct<rule:string,start:bigint,end:bigint>>").alias("found"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in the folder ``path``; without rows if nothing was written there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.range(0).select(F.from_json(F.lit("{}"), LEDGER).alias("x")).select("x.*")
    return spark.read.schema(LEDGER).parquet(path)


def record(versions: DataFrame, path: str, rules=RULES) -> DataFrame:
    """Scans the pairs of ``versions`` that the ledger in ``path`` lacks, appends them to it, and returns the ledger."""
    known = read_ledger(versions.sparkSession, path)
    blobs = unseen(versions, known if known.take(1) else None, rules)
    scan(blobs, rules).write.mode("append").parquet(path)
    return read_ledger(versions.sparkSession, path)


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """blob, kind, version, no (of the rule), start, end of what the ledger holds for these rules, one row a finding."""
    of = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(k).alias("no")))))
    each = ledger.select("blob", F.explode("found").alias("x")).withColumn("of", F.try_element_at(of, F.col("x.rule"))).where(F.col("of").isNotNull())
    return each.select("blob", "of.*", "x.start", "x.end")


def by_path(versions: DataFrame, found: DataFrame, path: str = "doc_id", rules=RULES) -> DataFrame:
    """path, n_assign, n_access, n_hex, base_sha256, spans for every row of ``versions``."""
    spans = lambda which: F.array_join(F.transform(F.filter("_all", which), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = [k for k, r in enumerate(rules) if r.base]
    own = found.groupBy("blob").agg(
        *(F.sum((F.col("no") == k).cast("long")).alias(f"n_{rules[k].kind}") for k in base),
        F.sort_array(F.collect_list(F.struct("start", "no", "end", "kind"))).alias("_all"),
    )
    own = own.select("blob", *(f"n_{rules[k].kind}" for k in base), spans(lambda x: x["no"].isin(base)).alias("_base"), spans(lambda x: F.lit(True)).alias("spans"))
    own = materialise(own)  # written out, or the join would keep the aggregate's partitioning and Spark couldn't split a hot blob's paths
    paths = versions.select(path, blob_of().alias("blob"))
    joined = paths.join(own, "blob", "left")
    return joined.select(path, *(F.coalesce(f"n_{rules[k].kind}", F.lit(0).cast("long")).alias(f"n_{rules[k].kind}") for k in base), F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob")


def scan_all(versions: DataFrame, path: str | None = None, rules=RULES) -> DataFrame:
    """Findings by path, through the ledger in the folder ``path``, or through a new one in the shared folder."""
    ledger = record(versions, path or shared_dir(versions.sparkSession), rules)
    return by_path(versions, findings(ledger, rules), rules=rules)
