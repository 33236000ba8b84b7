"""Secret scans with an incremental blob ledger.

Every version of a path is addressed by the SHA-256 of its content (its blob). The ledger remembers, for each blob,
which versions of which rules have scanned it, and what they found. A scan reads only blobs with a rule version that
the ledger doesn't hold, once for each blob whatever number of paths and versions share it, appends to the ledger,
and joins the findings back to all paths.

DataFrame functions only. Spans come from `split` (the texts between matches) and `regexp_extract_all` (the matches):
their lengths in code points add up to the positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import shared_dir


@dataclass(frozen=True)
class Rule:
    """`pattern` finds leftmost non-overlapping candidates; one stays if `group` of it has `least` code points.

    A new `version` makes the ledger scan every blob again for this rule."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which equal starts are listed. Runs of a single class match whole, so their least length is part of
#: the pattern; the assignment has to match short values too, since a dropped match still uses up its text.
RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Matches of a text that are added up one after the other.
STRETCH = 128
SCANNED = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, start long, end long"


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, rule: Rule) -> Column:
    """The spans of a rule in a text: an array of (key of the rule, start, end), in code points.

    Where a match begins follows from the lengths of all before it. They are added up in stretches of STRETCH matches, first
    over the stretches and then within each, so that no array is rebuilt for more than a stretch: linear in the matches."""
    pattern = F.lit(rule.pattern)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    checked = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.filter(F.arrays_zip(between.alias("gap"), found.alias("n"), checked.alias("c")), lambda x: x["n"].isNotNull())  # a text after the last match has none
    begin, none = F.lit(0).cast("long"), F.array().cast("array<struct<start:long,end:long,checked:int>>")

    def after(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["c"].alias("checked")))).alias("out"))

    def walked(stretches: Column) -> Column:
        lengths = F.transform(stretches, lambda s: F.aggregate(s, begin, lambda sum_, x: sum_ + x["gap"] + x["n"]))
        starts = F.aggregate(lengths, F.struct(begin.alias("at"), F.array().cast("array<long>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.transform(F.arrays_zip(stretches.alias("s"), starts.alias("at")), lambda p: F.aggregate(p["s"], F.struct(p["at"].alias("at"), none.alias("out")), after)["out"]))

    cut = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / STRETCH).cast("int")), lambda k: F.slice(m, k * STRETCH + 1, STRETCH))
    every = _bound(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(_bound(cut(m), walked)))
    return F.transform(
        F.filter(every, lambda x: x["checked"] >= rule.least),
        lambda x: F.struct(F.lit(rule.key).alias("rule"), x["start"].alias("start"), x["end"].alias("end")),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs: blob, text, rules (keys to apply). One row for each blob and span found."""
    none = F.array().cast("array<struct<rule:string,start:long,end:long>>")
    each = [F.when(F.array_contains("rules", r.key) & F.col("text").rlike(r.pattern), spans(F.col("text"), r)).otherwise(none) for r in rules]
    return blobs.select("blob", F.explode(F.concat(*each)).alias("s")).select("blob", "s.*")


class BlobLedger:
    """Two append-only Parquet tables in a shared folder: `scanned` (blob, rule keys) and `findings` (blob, rule key, span).

    Findings carry the version of the rule that made them, so a reader gets those of the rules it asks for, in its order of
    rules: what older versions found, or rules no longer asked for, stays in the ledger and out of the result.

    A scan's findings are written before its blobs are noted as scanned, and spans are deduplicated when read, so a scan
    that fails between the two is simply repeated by the next one."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # not written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def is_new(self) -> bool:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scanned")
        return not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)

    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS)

    def pending(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, the row that lends its text, and the rule keys still to apply; versions: path, blob."""
        blobs = versions.groupBy("blob").agg(F.min("path").alias("path"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        if self.is_new:
            return blobs.withColumn("rules", keys)
        done = self.scanned().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        left = blobs.join(done, "blob", "left").withColumn("rules", F.when(F.col("done").isNull(), keys).otherwise(F.array_except(keys, "done")))
        return left.filter(F.size("rules") > 0).drop("done")

    def scan(self, docs: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Bring the ledger up to date with these versions. Returns path and blob of every row."""
        content = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(F.col(path).alias("path"), content.alias("text"), F.unhex(F.sha2(content, 256)).alias("blob"))
        versions = rows.select("path", "blob")
        pending = self.pending(versions, rules)
        # The text comes from one row of each blob, found by path and content, so no text is shuffled by a hot blob.
        at = [F.col("r.path").eqNullSafe(F.col("p.path")), F.col("r.blob") == F.col("p.blob")]
        blobs = rows.alias("r").join(pending.alias("p"), at).select("r.blob", "r.text", "p.rules")
        scan_blobs(blobs, rules).dropDuplicates().write.mode("append").parquet(f"{self.path}/findings")
        pending.select("blob", "rules").write.mode("append").parquet(f"{self.path}/scanned")
        return versions

    def current(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """For each blob with findings by these very versions of the rules: its spans in order, equal starts as the rules stand."""
        asked = F.map_from_arrays(F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.struct(F.lit(i).alias("position"), F.lit(r.kind).alias("kind")) for i, r in enumerate(rules)]))
        found = self.findings().filter(F.col("rule").isin(*[r.key for r in rules])).dropDuplicates().withColumn("of", asked[F.col("rule")])
        return found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", F.col("of.position").alias("position"), "end", F.col("of.kind").alias("kind")))).alias("spans"))


def secret_scan(docs: DataFrame, ledger: BlobLedger | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and spans (array of start, position, end, kind; empty if none) of every row of docs.

    Keys of the rules (kind and version) must differ. Null texts count as empty. Repeated rows, and rows without a path, each get a row of their own. Very long texts are
    scanned whole. An empty table gives no rows. Other columns of docs are ignored, whatever their names."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    versions = ledger.scan(docs, path, text, rules)
    none = F.array().cast("array<struct<start:long,position:int,end:long,kind:string>>")
    return versions.join(ledger.current(rules), "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame, path: str = "doc_id") -> DataFrame:
    """The columns of the query: counts by kind, the SHA-256 of the base rules' spans as text, and all spans as text."""
    base = [r.kind for r in RULES]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return scanned.select(path, *[count(k).alias(f"n_{k}") for k in base], F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
