"""Secret scans: an incremental blob ledger.

Every version of a path is content-addressed by the SHA-256 of its text. The ledger is a Parquet table with one row for each
(blob, rule version) that was scanned, findings included. A scan takes the blobs of the given versions that the ledger does
not have for the current rule version, fetches each one's text once, scans it, appends to the ledger, and joins findings
back to all paths. Texts move only for unseen blobs; the join back carries blob ids and findings, and rows of blobs
without findings do not need a match. DataFrame functions only.

Skew: copies collapse in the map-side part of the aggregation by blob; the text of a blob is fetched by the unique id of one
of its rows; in the join back AQE splits a blob that very many paths share.

Defined results: a null text is the empty blob; rows that are equal are returned as often as they come; a null path
is a path of its own; an empty table gives an empty result; columns besides path and text are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, scratch, table
from .spans import Rule, add_spans, joined, redact

RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m, g: F.length(g) >= 12, group=2),
    Rule("access", r"AKIA[A-Z0-9]{14,}", guard=lambda t: t.contains("AKIA")),
    Rule("hex", r"[0-9a-f]{16,}+"),
    Rule("private_key", r"-----BEGIN\x20(?:(?!PRIVATE\x20KEY-----)[A-Z0-9]++\x20)*+PRIVATE\x20KEY-----", guard=lambda t: t.contains("PRIVATE KEY-----")),
    Rule("forge_token", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", guard=lambda t: t.contains("gh")),
    Rule("chat_token", r"(?<![A-Za-z0-9_])xox[abeoprs]-[A-Za-z0-9-]{10,}+", guard=lambda t: t.contains("xox")),
    Rule("jwt", r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", guard=lambda t: t.contains("eyJ")),
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]{3,}+@", guard=lambda t: t.contains("://")),
]
KINDS = [r.kind for r in RULES]
BASE = 3
#: Changes with any rule, so that the blobs are scanned anew.
RULE_VERSION = hashlib.sha256(repr([(r.kind, r.regex) for r in RULES]).encode()).hexdigest()[:16]
SPANS = "array<struct<s:int,k:int,e:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where nothing has been written yet. A lost writer leaves no rows, as Spark commits whole jobs."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rule_version"])


def update(versions: DataFrame, ledger: str, path: str = "path", text: str = "text") -> DataFrame:
    """Scans what the ledger lacks and returns (path, blob) for each row of versions."""
    spark = versions.sparkSession
    rows = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"))
    seen = ledger_at(spark, ledger).where(F.col("rule_version") == RULE_VERSION).select("blob")
    # One path stands for each unseen blob; its row's text is the one that moves.
    unseen = rows.groupBy("blob").agg(F.min("path").alias("rep")).join(seen, "blob", "left_anti")
    texts = versions.select(F.col(path).alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("text_"), blob_id(F.col(text)).alias("blob"))
    todo = texts.join(unseen.select("rep", "blob"), [texts["rep"].eqNullSafe(unseen["rep"]), texts["blob"] == unseen["blob"]], "left_semi")
    found = add_spans(todo, "text_", RULES).select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.array_sort(F.flatten(F.array(*(F.transform(f"span_{i}", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))) for i in range(len(RULES)))))).cast(SPANS).alias("spans"))
    # Rows equal in path and text are scanned each, but the ledger gets a blob once.
    found.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return rows


def scan(versions: DataFrame, ledger: str | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, spans) for each row of versions; spans: (start, kind number, end) by start."""
    spark = versions.sparkSession
    ledger = ledger or scratch(spark, "ledger")
    rows = materialize(update(versions, ledger, path, text), "versions")
    hits = ledger_at(spark, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    return rows.join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redacted(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with findings in the text replaced by [SECRET]; other texts as they were. Scans by blob, then redacts by blob."""
    spark = docs.sparkSession
    ledger = scratch(spark, "ledger")
    update(docs, ledger, path, text)
    hits = ledger_at(spark, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select(F.col("blob").alias("blob_"), F.col("spans").alias("spans_"))
    joined_ = docs.join(hits, blob_id(F.col(text)) == F.col("blob_"), "left")
    return redact(joined_, text, "spans_", lambda x: F.lit("[SECRET]")).drop("blob_", "spans_")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents"), path="doc_id")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < BASE)
    return df.select(
        F.col("path").alias("doc_id"), *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"),
    )


def _sql() -> str:
    """The same in SQL. Each rule's matches are set between marks, so that every second piece of the marked text is a match. A look-behind becomes a
    group for the character before the match; matches end in other characters than that group takes, but for url_login's @."""
    word = "(^|[^A-Za-z0-9_])"
    rules = [
        ("()", r"""((?:(?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+))""", True),
        ("()", r"(AKIA[A-Z0-9]{14,})", False),
        ("()", r"([0-9a-f]{16,})", False),
        ("()", r"(-----BEGIN\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY-----)", False),
        (word, r"(gh[pousr]_[A-Za-z0-9]{36,})", False),
        (word, r"(xox[abeoprs]-[A-Za-z0-9-]{10,})", False),
        (word, r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", False),
        ("(^|[^a-z0-9+.-])", r"([a-z][a-z0-9+.-]{1,20}://[^ \t\n\x0B\f\r/:@]+:[^ \t\n\x0B\f\r/:@]{3,}@)", False),
    ]
    mark, quoted = "chr(57344)", lambda x: x.replace("'", "''")
    parts, spans = [], []
    for k, (before, regex, group) in enumerate(rules):
        parts.append(f"string_split(regexp_replace(t, '{quoted(before + regex)}', '\\1' || {mark} || '\\2' || {mark}, 'g'), {mark}) AS p{k}")
        keep = f" IF length(regexp_extract(p{k}[2 * j], '{quoted(regex)}', 2)) >= 12" if group else ""
        spans.append(f"[{{'s': list_sum([length(x) for x in p{k}[1 : 2 * j - 1]]), 'k': {k}, 'n': length(p{k}[2 * j])}} for j in range(1, len(p{k}) // 2 + 1){keep}]")
    name = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = lambda x: f"coalesce(array_to_string([{name}[x.k + 1] || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT) for x in {x}], ','), '')"
    counts = ", ".join(f"CAST(len([x for x in spans IF x.k = {k}]) AS BIGINT) AS n_{KINDS[k]}" for k in range(BASE))
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {mark}, chr(57345)) AS t FROM documents),
p AS (SELECT doc_id, {", ".join(parts)} FROM d),
s AS (SELECT doc_id, list_sort({" || ".join(spans)}) AS spans FROM p)
SELECT doc_id, {counts}, sha256({text(f"[y for y in spans IF y.k < {BASE}]")}) AS base_sha256, {text("spans")} AS spans FROM s
"""


OP3_SQL = _sql()
