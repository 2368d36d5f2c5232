"""Secret scan with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a Parquet
table with one row per (blob, rule version): what the scan found there, nothing included. A run
scans only blobs that have no row for the current rules, appends them, and joins findings back to
all paths that ever held the blob. Copies are pre-aggregated to one content each before the shuffle.

Defined results: NULL content counts as empty; an empty text has no findings; repeated rows each get
the findings of their content; an empty table gives an empty result; other columns are ignored by reports and pass
:func:`redact` unchanged, whatever their names. Rows that two runs at once appended for one blob count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gatewise.llm.columns import unused_name
from gatewise.session import scratch_dir

# The kinds in their order and the patterns the findings are defined by.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Changes with the rules, so that an edited pattern is looked for in every blob again.
RULES_VERSION = hashlib.sha256(repr((KINDS, ASSIGN, ACCESS, HEX, MIN_ASSIGN, MIN_ACCESS, MIN_HEX)).encode()).hexdigest()[:16]

FINDING = "struct<kind:string,start:int,end:int>"
_ASSIGN = re.compile(ASSIGN, re.ASCII)
# A run that is too short holds no long enough one, so the length bound may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """Findings (kind, start, end) in code points, by start and kind.

    The keywords of an assignment are looked for as plain bytes first; few texts hold one.
    """
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(frames):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in frames:
        found = [[dict(zip(("kind", "start", "end"), x)) for x in find_secrets(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["_blob", "_found"])


def blob_id(content: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(content), F.lit("")), 256))


def update_ledger(history: DataFrame, ledger: str, content: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """Scan what the ledger has not seen under ``version``; return the ledger's rows of that version.

    ``ledger`` is a folder; a first run creates it. A run that is repeated after a failure scans
    again only what had not been appended.
    """
    spark = history.sparkSession
    blobs = history.select(blob_id(content).alias("_blob"), F.coalesce(F.col(content), F.lit("")).alias("_text"))
    unseen = blobs.groupBy("_blob").agg(F.first("_text").alias("_text"))
    schema = f"_blob binary, _found array<{FINDING}>, _version string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        seen = spark.read.schema(schema).parquet(ledger).where(F.col("_version") == version)
        unseen = unseen.join(seen.select("_blob"), "_blob", "left_anti")
    scanned = unseen.mapInArrow(_scan, f"_blob binary, _found array<{FINDING}>")
    scanned.withColumn("_version", F.lit(version)).write.mode("append").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).where(F.col("_version") == version)


def _findings(rows: DataFrame) -> DataFrame:
    """One row per blob that holds something, however often it stands in the ledger."""
    return rows.where(F.size("_found") > 0).groupBy("_blob").agg(F.first("_found").alias("_found"))


def scan_history(
    history: DataFrame, keys: Sequence[str], content: str = "text", ledger: str | None = None,
    version: str = RULES_VERSION,
) -> DataFrame:
    """``keys`` of every row of ``history`` and ``findings`` (kind, start, end) of its content."""
    ledger = ledger or scratch_dir(history.sparkSession, "ledger")
    rows = update_ledger(history, ledger, content, version)
    paths = history.select(*keys, blob_id(content).alias("_blob"))
    found = _findings(rows).select("_blob", F.col("_found").alias("findings"))
    empty = F.array().cast(f"array<{FINDING}>")
    return paths.join(found, "_blob", "left").select(*keys, F.coalesce("findings", empty).alias("findings"))


def redact(docs: DataFrame, mark: str = "[REDACTED]", ledger: str | None = None) -> DataFrame:
    """Every document with each found secret replaced by ``mark`` and ``n_chars`` recounted.

    The findings of a blob depend on its content only, so they are joined by content.
    """
    ledger = ledger or scratch_dir(docs.sparkSession, "ledger")
    rows = update_ledger(docs, ledger)
    blob, spans, at = (unused_name(docs, n) for n in ("_blob", "_found", "_at"))
    found = _findings(rows).select(F.col("_blob").alias(blob), F.col("_found").alias(spans))
    joined = docs.withColumn(blob, blob_id("text")).join(found, blob, "left")
    # Overlapping spans of different kinds are one: walk them by start and keep the furthest end.
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s.at, x.end).alias("at"),
            F.when(x.start >= s.at, F.concat(s.out, F.substring("text", s.at + 1, x.start - s.at), F.lit(mark))).otherwise(s.out).alias("out"),
        ),
    )
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(walked.out, F.expr(f"substring(text, `{at}` + 1)")))
    joined = joined.withColumn(at, F.when(F.col(spans).isNotNull(), walked.at))
    cleaned = joined.withColumn("text", text)
    columns = [F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cleaned.select(*columns)


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of its findings and the findings as text."""
    found = scan_history(docs, ["doc_id"])
    shown = F.concat_ws(",", F.transform("findings", lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown, 256).alias("base_sha256"), shown.alias("spans"))
