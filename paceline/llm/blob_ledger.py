"""Secret scanning with a ledger of content-addressed blobs.

Every historical version of a document is addressed by the SHA-256 of its text. The ledger says which rule versions each blob
was scanned by and what they found; a run scans each blob once for the pairs of blob and rule version that the
ledger lacks, appends them, and joins the findings back to every path and version that holds the blob.

A ledger row: ``blob``, ``scanned`` (rule@version, ...), ``findings`` (start, rule@version, end: code points, end exclusive).
Appending commits as a Parquet write does; a pair scanned twice, as after a lost task, changes nothing. What is reported are the findings
of the rule versions that are asked for, in their order: those of an older version, or of a retired rule, stay in the ledger alone.

Defined cases: a null text is the empty text; null paths are paths; repeated rows are reported each; an empty table gives an
empty table and leaves the ledger as it is; other columns are ignored; texts of any length are scanned to the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import batches_of, bitmap, passes, whole_text
from paceline.session import materialise


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` is shorter than ``least`` are dropped. ``hints``: one is in any lower-cased match."""

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = 0
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


BASE = ("assign", "access", "hex")
RULES = (
    Rule(
        "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.I | re.A,
        ("passw", "secret", "token", "key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("private key",)),
    Rule("forge_token", 1, r"(?:gh[pousr]_|github_pat_|glpat-)[A-Za-z0-9_-]{20,}", hints=("gh", "glpat")),
    Rule("chat_token", 1, r"xox[abeoprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,100}@", flags=re.A, hints=("://",)),
)
FINDINGS = "array<struct<start: bigint, pair: string, end: bigint>>"
LEDGER = f"blob string, scanned array<string>, findings {FINDINGS}"


def scan_text(text: str, rules: tuple[Rule, ...], wanted: set[str] | None = None) -> list[tuple[int, int, str, int]]:
    """(start, number of the rule, its name, end) of all matches of the wanted rules, in order."""
    low, found = text.lower(), []
    for kind, rule in enumerate(rules):
        if wanted is not None and rule.key not in wanted or rule.hints and not any(h in low for h in rule.hints):
            continue
        for match in re.finditer(rule.pattern, text, rule.flags):
            if len(match[rule.group]) >= rule.least:
                found.append((match.start(), kind, rule.name, match.end()))
    return sorted(found)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(addressed: DataFrame, ledger: DataFrame, keys: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """blob, the keys of one row that holds it, and the rule versions it was never scanned by."""
    held = addressed.groupBy("blob").agg(F.min(F.struct(*keys)).alias("at"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
    nothing = F.array().cast("array<string>")
    missing = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("seen", nothing))
    return held.join(seen, "blob", "left").select("blob", "at", missing.alias("missing")).filter(F.size("missing") > 0)


def scan_unseen(versions: DataFrame, ledger_path: str, keys: list[str], rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger lacks and append it. Runs a job.

    Only digests are grouped; each unseen blob's text is then taken from one row that holds it. A bitmap of the unseen blobs keeps
    the texts of the others from being shuffled: with nothing unseen none are.
    """
    spark = versions.sparkSession
    addressed = versions.select(*keys, F.sha2(whole_text(), 256).alias("blob"))
    todo = unseen(addressed, read_ledger(spark, ledger_path), keys, rules).withColumnRenamed("blob", "todo_blob")
    todo = materialise(todo, "unseen-blobs")
    texts = versions.select(*keys, whole_text().alias("text")).withColumn("blob", F.sha2("text", 256))
    texts = texts.filter(passes(F.xxhash64("blob"), bitmap(todo.select(F.xxhash64("todo_blob").alias("hash")))))
    same = texts["blob"] == todo["todo_blob"]
    for key in keys:
        same = same & texts[key].eqNullSafe(todo["at"][key])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finding, key = pa.struct([("start", pa.int64()), ("pair", pa.string()), ("end", pa.int64())]), {r.name: r.key for r in rules}
        for batch in (piece for whole in batches for piece in batches_of(whole)):
            rows = []
            for text, missing in zip(batch["text"].to_pylist(), batch["missing"].to_pylist(), strict=True):
                rows.append([{"start": start, "pair": key[name], "end": end} for start, _, name, end in scan_text(text, rules, set(missing))])
            yield pa.RecordBatch.from_arrays([batch["blob"], batch["missing"], pa.array(rows, pa.list_(finding))], ["blob", "scanned", "findings"])

    texts.join(todo, same).select("blob", "text", "missing").mapInArrow(scan, LEDGER).write.mode("append").parquet(ledger_path)


def findings_by_path(versions: DataFrame, ledger_path: str, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The keys of every version, its ``blob``, and the ``findings`` of the given rule versions in it: (start, kind, rule, end), where
    ``kind`` is the place of the rule among those given."""
    ledger = read_ledger(versions.sparkSession, ledger_path)
    place = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)])
    name = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.name)])
    current = F.filter("findings", lambda x: x["pair"].isin([r.key for r in rules]))
    told = F.transform(current, lambda x: F.struct(x["start"].alias("start"), place[x["pair"]].cast("long").alias("kind"), name[x["pair"]].alias("rule"), x["end"].alias("end")))
    known = ledger.select("blob", told.alias("findings")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    # Written, so that the join's sides are dealt out for it alone and a blob that very many paths hold can be split.
    known = materialise(known, "findings")
    addressed = versions.select(*keys, F.sha2(whole_text(), 256).alias("blob"))
    return addressed.join(known, "blob").select(*keys, "blob", "findings")


def scan_versions(versions: DataFrame, ledger_path: str, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date, then report every version's findings."""
    scan_unseen(versions, ledger_path, keys, rules)
    return findings_by_path(versions, ledger_path, keys, rules)


def count_of(findings: str | Column, name: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["rule"] == name)).cast("long")


def spans_text(findings: str | Column, names: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the findings (of the named rules), comma-joined."""
    chosen = F.filter(findings, lambda x: x["rule"].isin(*names)) if names else findings
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")
