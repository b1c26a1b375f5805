"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is content-addressed (SHA-256 of its UTF-8 bytes).  The
ledger lists the (blob, rule, rule version) triples already scanned together with
their findings; ``update`` scans only triples that the ledger lacks, each distinct blob
once however many paths or versions carry it, and ``findings`` joins the ledger back to
all of them.  ``scan_history`` feeds a table to the ledger batch by batch: a blob that
an earlier batch had is not scanned again.

Positions come from splitting a text at a rule's matches: the pieces between matches
and the matches themselves alternate, so running sums of their lengths give every
start and end in code points.

Defined results: a null text is the empty blob; a null id is kept as a path of its
own; repeated rows each get their findings; empty tables give empty tables; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import columns_of, join_hot, written


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and the least length of it."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: Fixed patterns of the base rules.  For the access and hex kinds the least length is part of the
#: pattern: a run that is too short has no longer match within it, so the surviving matches are the same.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    Rule("hex", r"([0-9a-f]{16,})", 1, 16),
)

#: Batches in which a whole table is fed to the ledger.
BATCHES = 2

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def match_spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text: array of (start, end), in code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(whole, F.length)
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans")).cast(kind)

    found = F.aggregate(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), part.alias("part")), first, lambda s, x: F.when(x["size"].isNull(), s).otherwise(add(s, x)))
    return F.when(text.rlike(rule.pattern), found["spans"]).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def address(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, blob): every historical version with its content address."""
    rows = columns_of(versions, {id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))


def unseen(rows: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, text, todo): the distinct blobs of the rows, with the kinds that the ledger lacks at the rules' versions.

    Copies of a blob combine before the shuffle, so a hot blob is one row a task.
    """
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.where(_current(rules)).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def _current(rules) -> Column:
    """Ledger rows of the rules at their versions."""
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return now


def update(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's new rows: the spans of every (blob, rule, rule version) of the versions that it lacks."""
    todo = unseen(address(versions, id_col, text_col), ledger, rules)
    nothing = F.lit(None).cast("array<struct<start:int,end:int>>")
    scans = [F.when(F.array_contains("todo", r.kind), match_spans(F.col("text"), r)).otherwise(nothing).alias(r.kind) for r in rules]
    each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules])
    new = todo.select("blob", *scans).select("blob", F.explode(each).alias("x")).select("blob", "x.kind", "x.version", "x.spans")
    return written(new.where(F.col("spans").isNotNull()), "secret-ledger")


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans by kind of every path: doc_id, blob and a column for each kind, null where nothing is found."""
    paths = written(address(versions, id_col, text_col).select("doc_id", "blob"), "secret-paths")
    hits = ledger.where(_current(rules) & (F.size("spans") > 0))
    by_blob = hits.groupBy("blob").agg(*[F.max(F.when(F.col("kind") == r.kind, F.col("spans"))).alias(r.kind) for r in rules])
    return join_hot(paths, by_blob, "blob", "left")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, findings of every path of the versions) after one batch."""
    new = update(versions, ledger, rules, id_col, text_col)
    return new, findings(versions, new if ledger is None else new.unionByName(ledger.select(*new.columns)), rules, id_col, text_col)


def scan_history(versions: DataFrame, batches: int = BATCHES, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ledger, findings of every path) when the versions come in batches, each scanned against the ledger that the earlier ones left."""
    ledger = None
    for b in range(batches):
        own = versions.where(F.pmod(F.xxhash64(F.lit("batch"), id_col), F.lit(batches)) == b)
        new = update(own, ledger, rules, id_col, text_col)
        ledger = new if ledger is None else ledger.unionByName(new)
    return ledger, findings(versions, ledger, rules, id_col, text_col)


def digest(findings: DataFrame, rules=RULES) -> DataFrame:
    """Counts by kind, the spans in order of start then kind, and the hash of the base ones."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def ranked(rank: int, kind: str) -> Column:
        row = lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))
        return F.transform(F.coalesce(kind, empty), row)

    order = F.array_sort(F.flatten(F.array(*[ranked(i, r.kind) for i, r in enumerate(rules)])))
    joined = F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.coalesce(r.kind, empty)).cast("bigint").alias(f"n_{r.kind}") for r in rules]
    return findings.select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))
