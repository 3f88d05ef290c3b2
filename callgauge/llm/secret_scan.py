"""Secret scans over an incremental blob ledger.

A text is content-addressed by its SHA-256 (a blob). The ledger, a Parquet table that only grows, has a row a blob and
scan: the rules in their versions that the blob was scanned by, and their findings. A scan takes the blobs and rules that
it lacks and appends such rows; each is whole in itself, so of a scan that is cut off some blobs are done and the
others are scanned by the next one. Findings are joined back to every row that holds the blob. All of it is DataFrame
operations: copies of a text fall together in the map-side half of an aggregation by (blob, text), and positions
are running sums over the lengths of the segments that end with each match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm.common import shared_dir, small, text_of, written


@dataclass(frozen=True)
class Rule:
    """``value``: the group of ``pattern`` that needs ``least`` characters; matches that fail are dropped."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds that the result contract counts, in its order.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # within a run the first AKIA has the longest rest, so the bound can stand in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: Kinds that this method adds.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE

#: What redaction takes: of a key all up to its END line, where none follows the header and the lines of base64 below it.
_PEM_END = r"(?:(?!-----BEGIN )(?s:.))*?-----END [A-Z ]*PRIVATE KEY-----"
_PEM_CUT = r"(?:\s+[A-Za-z0-9+/=]{16,})*+"
REDACTED = tuple(Rule("pem", 2, rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_PEM_END}|{_PEM_CUT})") if r.kind == "pem" else r for r in RULES)


class BlobLedger:
    """The table below ``path``: of each blob and scan its rules and their findings."""

    FOUND = "array<struct<kind:string,version:int,start:bigint,end:bigint>>"
    SCHEMA = f"blob BINARY, rules ARRAY<STRING>, found {FOUND}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """``versions`` (distinct _blob, perhaps _t) that still need rules, with their keys in _todo."""
        wanted = F.array(*[F.lit(r.key) for r in rules])
        if not self.exists():
            return versions.withColumn("_todo", wanted)
        seen = self.rows().select("blob", F.explode("rules").alias("_r")).groupBy("blob").agg(F.collect_set("_r").alias("_seen"))
        open_ = F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>")))
        return versions.join(seen, F.col("_blob") == F.col("blob"), "left").withColumn("_todo", open_).filter("size(_todo) > 0").drop("blob", "_seen")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...]) -> None:
        """``versions``: _blob, _t. Appends what the ledger lacks."""
        todo = self.unseen(versions.groupBy("_blob", "_t").agg(F.count(F.lit(1)).alias("_n")).select("_blob", "_t"), rules)
        tried = F.array(*[
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("_todo", r.key), F.regexp_extract_all("_t", F.lit(r.pattern), F.lit(0))).alias("found"))
            for r in rules
        ])
        hits = todo.select("_blob", "_t", F.explode(tried).alias("_x")).filter("size(_x.found) > 0").select("_blob", "_t", "_x.*")
        segments = F.coalesce(*[F.when(F.col("kind") == r.kind, F.regexp_extract_all("_t", F.lit(rf"\G(?s).*?(?:{r.pattern})"), F.lit(0))) for r in rules])
        one = hits.select("_blob", "kind", "version", F.posexplode(F.arrays_zip(F.transform("found", lambda m: m).alias("m"), segments.alias("s"))).alias("_i", "_z"))
        lengths = one.select("_blob", "kind", "version", "_i", F.col("_z.m").alias("_m"), F.char_length("_z.s").cast("long").alias("_s"))
        upto = Window.partitionBy("_blob", "kind").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        placed = lengths.select("_blob", "kind", "version", "_m", F.sum("_s").over(upto).alias("_end"))
        value = F.coalesce(*[F.when(F.col("kind") == r.kind, F.char_length(F.regexp_extract("_m", r.pattern, r.value)) >= r.least) for r in rules])
        spans = placed.filter(value).select("_blob", F.struct("kind", "version", (F.col("_end") - F.char_length("_m")).alias("start"), F.col("_end").alias("end")).alias("_f"))
        found = spans.groupBy("_blob").agg(F.collect_list("_f").alias("found"))  # of one text
        # all blobs again, without their texts
        rows = self.unseen(versions.select("_blob").distinct(), rules).join(found, "_blob", "left")
        rows = rows.select(F.col("_blob").alias("blob"), F.col("_todo").alias("rules"), F.coalesce("found", F.array().cast(self.FOUND)).alias("found"))
        rows.write.mode("append").option("compression", "zstd").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, spans): of each blob with any its findings by these rules in these versions, by start and order of rules."""
        of = lambda x: F.coalesce(*[F.when((x["kind"] == r.kind) & (x["version"] == r.version), F.lit(i)) for i, r in enumerate(rules)])
        held = self.rows().filter("size(found) > 0").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))  # two scans at once may find the same
        spans = F.transform(F.filter("found", lambda x: of(x).isNotNull()), lambda x: F.struct(x["start"].alias("start"), of(x).alias("ord"), x["kind"].alias("kind"), x["end"].alias("end")))
        return held.select("blob", F.sort_array(spans).alias("spans")).filter("size(spans) > 0")


def _scanned(docs: DataFrame, ledger_path: str | None, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """(blob, spans) of the texts of ``docs``, and of others that the ledger knows."""
    ledger = BlobLedger(docs.sparkSession, ledger_path or shared_dir(docs.sparkSession, "blob-ledger"))
    texts = docs.select(text_of(text_col).alias("_t"))
    ledger.scan(texts.select(F.unhex(F.sha2("_t", 256)).alias("_blob"), "_t"), rules)
    # written, so that both sides of the join to it come straight from a shuffle and a hot blob's rows can be split
    return written(ledger.findings(rules), "secret-spans")


def scan_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, blob, spans (array of start, ord, kind, end by start and order of rules).

    Positions count code points from 0, ends are exclusive. A null text counts as empty, repeated rows
    each get their spans, an empty table gives no rows; other columns are ignored. Without
    ``ledger_path`` a fresh ledger in the shared folder is used.
    """
    by_blob = _scanned(docs, ledger_path, rules, text_col)
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    held = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("_blob")).join(small(by_blob, 128 + 64 * F.size("spans")), F.col("_blob") == F.col("blob"), "left")
    return held.select(F.col("_id").alias(id_col), F.col("_blob").alias("blob"), F.coalesce("spans", none).alias("spans"))


def span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", ledger_path: str | None = None, rules: tuple[Rule, ...] = REDACTED) -> DataFrame:
    """``docs`` with each span in the text replaced by ``<kind>``; overlapping spans by that of the first.

    Rows without a finding, null texts among them, are unchanged, and no row goes. Other columns stay.
    """
    by_blob = _scanned(docs, ledger_path, rules, text_col).select(F.col("blob").alias("_cg_found"), F.col("spans").alias("_cg_spans"))
    joined = docs.join(small(by_blob, 128 + 64 * F.size("_cg_spans")), F.unhex(F.sha2(text_of(text_col), 256)) == F.col("_cg_found"), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        before = F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    clean = F.when(F.col("_cg_spans").isNull(), F.col(text_col)).otherwise(F.aggregate("_cg_spans", start, step, rest))
    return joined.withColumn(text_col, clean).select(*docs.columns)
