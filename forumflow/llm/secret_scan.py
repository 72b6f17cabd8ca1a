"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every historical version of every path is addressed by the SHA-256 of its
text. The ledger holds the (blob, rule, version) pairs already scanned and
their findings; only unseen pairs are scanned, each blob once whatever the
number of paths or versions that hold it, and findings are joined back to all
paths. A changed rule gets a new version number, so that all blobs are unseen
for it and nothing else is scanned again.

Positions come without Python: a text split at a rule's pattern gives the
lengths of what lies between the matches; running sums over a blob's matches
turn lengths into code-point offsets.

The first three rules are the base rules; the others add spans. Matches are
leftmost and do not overlap within a rule; a match that fails ``keep`` is
dropped after matching, so it still consumes its text.

Defined results: null counts as the empty text, which has no findings;
repeated rows are paths of their own with the same findings; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from forumflow.llm.common import free_name, small_side, staged


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str                 # Java regular expression
    version: int = 1
    group: int = 0               # the group whose length is tested
    least: int = 1               # and its least length


# The rules' patterns.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES

#: What redact() hides of a private key: the header and all up to the END line; where that is missing
#: (cut off, or another "-----" comes first), its "Name: value" lines and its runs of base64.
_HEADER = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
_TO_END = r"(?s:(?:(?!-----).)*+)-----END [A-Z ]{0,20}PRIVATE KEY-----"
_BREAK = r"""(?:[\s"'`>#|,;+]|\\[nrt])*+"""       # line breaks, also as in source code or a quoted mail
_RUNS = (rf"(?:(?:{_BREAK}[A-Z][A-Za-z-]*+:\x20[^\r\n\\]*+(?=[\r\n\\]))*+"
         rf"(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+=*+)++"
         rf"""(?:(?:\r?\n|\\n)(?:[A-Za-z0-9+/]++=++|[A-Za-z0-9+/]++(?=\x20*+(?:\z|[\r\n\\"']))))?+)?+""")
#: Findings mark a key by its header; masking it takes the whole key.
MASK_RULES = tuple(Rule("pem", f"{_HEADER}(?:{_TO_END}|{_RUNS})", version=2) if r.name == "pem" else r for r in RULES)


def _matches(rule: Rule) -> Column:
    """array<struct(gap, len, keep)>: code points since the last match, of the match, and whether it stays."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    rows = F.transform(F.arrays_zip(hits.alias("h"), tested.alias("t"), F.slice(gaps, F.lit(1), F.size(hits)).alias("g")),
                       lambda x: F.struct(F.char_length(x["g"]).alias("gap"), F.char_length(x["h"]).alias("len"),
                                          (F.char_length(x["t"]) >= rule.least).alias("keep")))
    wanted = F.array_contains("rules", rule.name) & text.rlike(rule.pattern)
    return F.when(wanted, rows)


def unseen(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, path, rules): blobs with rules that the ledger has no scan of, and one path that holds the blob."""
    pairs = versions.groupBy("blob").agg(F.min("path").alias("path")).withColumn(
        "rule", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))
                                    for r in rules])))
    pairs = pairs.select("blob", "path", "rule.rule", "rule.version")
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule", "version").distinct(), ["blob", "rule", "version"], "left_anti")
    return pairs.groupBy("blob", "path").agg(F.collect_set("rule").alias("rules"))   # as many as rules at most


def scan_versions(versions: DataFrame, *, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
                  known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``versions`` (path, text) -> (paths, ledger, findings).

    paths: path, blob - a row per version. ledger: blob, rule, version - the
    pairs scanned by this call, to be appended to the ledger. findings: blob,
    rule, version, start, end - of this call's scans, in code points, end
    exclusive. ``known`` are the findings of the pairs in ``ledger``: those of
    these paths' blobs at the rules' versions then come with the new ones, so a
    new path with a blob scanned before shows its secrets.
    """
    hashed = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = staged(hashed.select("path", "blob"), "secret-paths")
    todo = staged(unseen(paths, rules, ledger), "secret-todo")
    numbers = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    scanned = todo.select("blob", F.explode("rules").alias("rule")).withColumn("version", numbers[F.col("rule")])
    hits = (hashed.join(todo.hint("shuffle_hash"), (hashed["path"].eqNullSafe(todo["path"])) & (hashed["blob"] == todo["blob"]))
            .select(hashed["blob"], "text", "rules")
            .select("blob", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
                                                         _matches(r).alias("found")) for r in rules])).alias("r"))
            .where("r.found is not null")
            .select("blob", "r.rule", "r.version", F.posexplode("r.found").alias("i", "m"))
            # a repeated (path, text) row was scanned more than once
            .groupBy("blob", "rule", "version", "i").agg(F.first("m").alias("m")))
    run = Window.partitionBy("blob", "rule", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    findings = (hits.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(run))
                .where("m.keep")
                .select("blob", "rule", "version", (F.col("end") - F.col("m.len")).cast("bigint").alias("start"),
                        F.col("end").cast("bigint").alias("end")))
    if known is not None:
        # a pair that is scanned now is not in the ledger, whatever ``known`` holds of it
        old = known.where(numbers[F.col("rule")] == F.col("version")).join(paths.select("blob").distinct(), "blob", "left_semi")
        findings = findings.unionByName(old.join(scanned, ["blob", "rule", "version"], "left_anti").select(*findings.columns).distinct())
    return paths, scanned, findings


def record(path: str, scanned: DataFrame, findings: DataFrame) -> None:
    """Append a call's pairs and findings to the ledger tables below ``path``; findings first, so that a pair in
    the ledger always has its findings there (a repeated finding counts once)."""
    findings.join(scanned, ["blob", "rule", "version"], "left_semi").write.mode("append").parquet(f"{path}/findings")
    scanned.write.mode("append").parquet(f"{path}/scanned")


def recorded(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The ledger below ``path`` as the options ``ledger`` and ``known``."""
    pair = "blob string, rule string, version int"
    return {"ledger": spark.read.schema(pair).parquet(f"{path}/scanned"),
            "known": spark.read.schema(f"{pair}, start bigint, end bigint").parquet(f"{path}/findings")}


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")


def blob_digest(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob with findings: count of each base rule, base and all spans as text ("rule:start:end,...")."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    one = F.struct("start", order[F.col("rule")].alias("k"), "end", "rule")
    base = F.col("rule").isin(*[r.name for r in BASE_RULES])
    return findings.groupBy("blob").agg(
        *[F.count_if(F.col("rule") == r.name).alias(f"n_{r.name}") for r in BASE_RULES],
        _joined(F.collect_list(F.when(base, one))).alias("base_spans"),
        _joined(F.collect_list(one)).alias("spans"))


def doc_findings(docs: DataFrame, **ledger) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans - a row per document."""
    paths, _, findings = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), **ledger)
    found = staged(blob_digest(findings), "secret-digest")
    zero = {f"n_{r.name}": F.coalesce(f"n_{r.name}", F.lit(0)).cast("bigint") for r in BASE_RULES}
    return (paths.join(found, "blob", "left")
            .select(F.col("path").alias("doc_id"), *[c.alias(n) for n, c in zero.items()],
                    F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans")))


def redact(docs: DataFrame, mark: str = "[SECRET]", **ledger) -> DataFrame:
    """The documents with every found span replaced by ``mark``; ``n_chars`` follows, other columns stay.

    A private key goes whole, not by its header only. Overlapping spans of
    several rules are replaced as one.
    """
    _, _, findings = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), rules=MASK_RULES, **ledger)
    spanned, blob, key = (free_name(n, docs) for n in ("_spans", "_blob", "_key"))
    run = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1))
    starts = findings.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1))
    joint = (starts.withColumn("g", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("blob", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    spans = staged(joint.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spanned)),
                   "secret-spans")
    # what lies between the spans, then the parts joined by the mark
    before = lambda k: F.when(k > 1, F.try_element_at(spanned, F.greatest(k - 1, F.lit(1)))["end"]).otherwise(0)
    cut = F.transform(F.sequence(F.lit(1), F.size(spanned) + 1), lambda k: F.substring(
        F.col("text"), (before(k) + 1).cast("int"),
        (F.coalesce(F.try_element_at(spanned, k)["start"], F.char_length("text")) - before(k)).cast("int")))
    text = F.when(F.col(spanned).isNull(), F.col("text")).otherwise(F.array_join(cut, mark))
    out = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256))
    longest = spans.agg(F.max(F.size(spanned))).first()[0] or 0
    spans = small_side(spans, row_bytes=128 + 16 * longest)
    out = out.join(spans.withColumnRenamed("blob", key), F.col(blob) == F.col(key), "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spanned).isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
