"""Secret scans with an incremental blob ledger.

Every text, of every version of a path, is content-addressed by SHA-256. The ledger says which rules, by version, have
been run over which blob and what they found. A scan reads only blobs with a rule version that they have not
seen, one copy of each, appends what it finds, and joins the findings of the blobs in use back to every path (doc_id).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop, folder, keep

# The patterns of the base kinds and of known token formats.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_HUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _assign(text: str, raw: bytes) -> list[tuple[int, int]]:
    low = raw.lower()
    if not any(w in low for w in _WORDS):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]


def _spans(pattern: re.Pattern, least: int = 0, hint: bytes = b"") -> Callable[[str, bytes], list[tuple[int, int]]]:
    return lambda text, raw: [m.span() for m in pattern.finditer(text) if m.end() - m.start() >= least] if hint in raw else []


#: Kinds in the order in which equal starts are listed, with the version of each; the first three are the base kinds.
RULES: dict[str, tuple[int, Callable[[str, bytes], list[tuple[int, int]]]]] = {
    "assign": (1, _assign),
    "access": (1, _spans(_ACCESS, 20, b"AKIA")),
    "hex": (1, _spans(_HEX)),
    "pem": (1, _spans(_PEM, 0, b"PRIVATE KEY")),
    "jwt": (1, _spans(_JWT, 0, b"eyJ")),
    "github": (1, _spans(_HUB, 0, b"gh")),
}
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:int,end:int>>"


def rule_ids(kinds: tuple[str, ...] | None = None) -> list[str]:
    """The current version of each rule (or of those kinds) as kind@version."""
    return [f"{kind}@{version}" for kind, (version, _) in RULES.items() if kinds is None or kind in kinds]


def find(text: str, kinds: list[str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    raw = text.encode()
    found = [(a, i, kind, b) for i, kind in enumerate(kinds) for a, b in RULES[kind][1](text, raw)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
    for batch in batches:
        found = []
        for text, rules in zip(batch.column("text"), batch.column("rules"), strict=True):
            by_kind = {r.split("@")[0]: r for r in rules.as_py()}
            hits = find(text.as_py() or "", list(by_kind))
            found.append([{"rule": by_kind[k], "start": a, "end": b} for k, a, b in hits])
        yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules").cast(kinds.field(1).type), pa.array(found, kinds.field(2).type)], schema=kinds)


class Ledger:
    """A table of (blob, rules, found) in a folder (without one: for this session). Rows are only ever appended; a blob has a row for each scan of it."""

    def __init__(self, spark: SparkSession, at: str | None = None):
        self.spark, self.at = spark, at or f"{folder(spark)}/ledger-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        self._store, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path
        if at is None:
            self._store.deleteOnExit(path)

    def rows(self) -> DataFrame:
        if not self._store.exists(self._path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.at)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").parquet(self.at)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def versions(docs: DataFrame) -> DataFrame:
    """none (no doc_id), of (the doc_id), tag and blob (SHA-256 of the text's UTF-8; null: of nothing) of every row of docs."""
    return docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("of"), F.xxhash64(_text()).alias("tag"), F.sha2(_text().cast("binary"), 256).alias("blob"))


def unseen(at: DataFrame, ledger: Ledger, rules: list[str]) -> DataFrame:
    """none, of, tag, blob, rules: for each blob of at (versions) that some of the rules have not seen, one row that has it, and those rules."""
    seen = ledger.rows().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))  # a blob's rule versions
    copy = at.groupBy("blob").agg(F.min(F.struct("none", "of", "tag")).alias("copy"))
    left = F.array_except(F.array(*[F.lit(x) for x in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    return copy.join(seen, "blob", "left").select("copy.none", "copy.of", "copy.tag", "blob", left.alias("rules")).filter(F.size("rules") > 0)


def update(docs: DataFrame, at: DataFrame, ledger: Ledger, rules: list[str] | None = None) -> int:
    """Scan what the rules (the current versions, unless others are given) have not seen of docs (at: their versions) and append it; the number of blobs.

    Only the texts to be scanned are exchanged, one copy of each blob, even of a row repeated with its doc_id.
    """
    todo = keep(unseen(at, ledger, rules or rule_ids()), "ledger-todo")
    n = todo.count()
    if n:
        key = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("of"), F.xxhash64(_text()).alias("tag")]
        text = docs.select(*key, _text().alias("text")).join(todo, ["none", "of", "tag"])
        ledger.append(text.dropDuplicates(["none", "of", "tag"]).select("text", "blob", "rules").mapInArrow(_scan, LEDGER))
    drop(todo)
    return n


def findings(at: DataFrame, ledger: Ledger) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of at (versions), from the findings of the current rule versions."""
    ids, order = rule_ids(), {k: i for i, k in enumerate(RULES)}
    hits = F.filter(F.flatten(F.collect_list("found")), lambda x: x["rule"].isin(ids))
    kind = lambda x: F.split_part(x["rule"], F.lit("@"), F.lit(1))
    rank = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), kind(x))
    # most blobs hold nothing; only findings travel, and only those of blobs in use meet a path
    some = ledger.rows().filter(F.size("found") > 0).groupBy("blob").agg(hits.alias("found"))
    some = some.select("blob", F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), kind(x).alias("kind"), x["end"].alias("end")))).alias("found"))
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_kind = lambda k: F.filter("found", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    digest = F.sha2(listed(F.filter("found", lambda x: x["kind"].isin(list(BASE)))).cast("binary"), 256)
    table = keep(some.select(F.col("blob").alias("in_blob"), *counts, digest.alias("base_sha256"), listed(F.col("found")).alias("spans")), "findings")
    none = {"base_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": F.lit(""), **{f"n_{k}": F.lit(0).cast("long") for k in BASE}}
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    return at.join(table, F.col("blob") == F.col("in_blob"), "left").select(F.when(~F.col("none"), F.col("of")).alias("doc_id"), *(F.coalesce(n, none[n]).alias(n) for n in names))


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: list[str] | None = None) -> DataFrame:
    """The secrets of every row of docs (doc_id, text), through the ledger (a fresh one if none is given).

    doc_id is a path, its rows are versions of it. A null text is an empty blob without findings; copies and repeated
    rows get the same findings each; a null doc_id is a path like others; texts of any length are scanned whole; spans that start at one place come in the order of their kinds;
    no rows give no rows; other columns are ignored.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    at = keep(versions(docs), "versions")
    update(docs, at, ledger, rules)
    return findings(at, ledger)


def scan_in_turn(docs: DataFrame) -> DataFrame:
    """The secrets of every row of docs (as scan() gives them), after two scans: of the table as it was when half its ids were given, and as it is.

    The second scan reads only the blobs that the first one has not seen.
    """
    ledger = Ledger(docs.sparkSession)
    at = keep(versions(docs), "versions")
    low, high = at.filter("not none").agg(F.min("of"), F.max("of")).first()
    earlier = at.filter(~F.col("none") & (F.col("of") <= F.lit(((low or 0) + (high or 0)) // 2)))
    update(docs, earlier, ledger)
    update(docs, at, ledger)
    return findings(at, ledger)


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE).encode()).hexdigest()
