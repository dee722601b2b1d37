"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every text is content-addressed (SHA-256). The ledger is a table of (blob, rule_version, findings);
a scan reads only texts whose pair of blob and rule version is not in it yet, one row for each such blob, appends
what it found, and joins findings back to every path that holds the blob.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import owned
from .common import documents, new_path, text_column


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The finding stays if this group of the match has so many characters at least.
    group: int
    least: int
    #: A text without any of these has no match; compared in lower case where folded.
    hints: tuple[str, ...] = ()
    folded: bool = False


#: The base kinds in their listed order.
BASE_RULES = (
    Rule(
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        ("passw", "secret", "token", "api"),
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Spans that this scanner adds: keys with a known prefix, signed tokens and private key headers.
MORE_RULES = (
    Rule("repo", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("gh",)),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Rule("pay", r"[sr]k_live_[0-9A-Za-z]{16,}", 0, 24, ("k_live_",)),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, ("eyJ",)),
    Rule("private", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 27, ("-----BEGIN",)),
)
RULES = BASE_RULES + MORE_RULES

#: Parts that the paths of one blob are dealt into when findings are joined back.
PARTS = 16

SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, in code points. What stands between matches gives their places."""
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(pieces.alias("p"), matches.alias("m"), groups.alias("g"))
    empty = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.coalesce(F.char_length(x["p"]), F.lit(0))
        end = begin + F.coalesce(F.char_length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.coalesce(F.char_length(x["g"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(zipped, start, step, lambda acc: acc["found"])
    seen = F.lit(True)
    if rule.hints:
        within = F.lower(text) if rule.folded else text
        seen = F.lit(False)
        for h in rule.hints:
            seen = seen | F.contains(within, F.lit(h))
    return F.when(seen & F.rlike(text, F.lit(rule.pattern)), found).otherwise(empty)


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules, by start and then by the rules' order."""
    return F.array_sort(F.concat(*[_spans(text, r, i) for i, r in enumerate(rules)]))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Findings by blob under one version of the rules; a blob that two runs scanned at once counts once."""
    schema = f"blob string, rule_version string, findings array<{SPAN}>"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).select("blob", "findings")
    return spark.read.schema(schema).parquet(path).where(F.col("rule_version") == version).dropDuplicates(["blob"]).select("blob", "findings")


def unseen(versions: DataFrame, known: DataFrame) -> DataFrame:
    """One row (blob, text) or a few equal ones for each blob that is not known; versions has path, blob, text.

    Only ids are grouped; the texts move once, to meet the ids of those that must be read.
    """
    first = versions.groupBy("blob").agg(F.min("path").alias("path")).join(known.select("blob"), "blob", "left_anti")
    return versions.join(first.hint("shuffle_hash"), ["path", "blob"], "left_semi").select("blob", "text")


def scan(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date, then one row per row of docs: key, blob, findings.

    Several rows of a key are several versions. Null text counts as empty; a null key is kept; an empty table gives
    an empty one; columns other than key and text are left aside. Repeated rows each get their findings.
    """
    spark = docs.sparkSession
    version = rule_version(rules)
    body = text_column(docs, text)
    versions = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("text"))
    fresh = unseen(versions, read_ledger(spark, ledger, version))
    fresh.select("blob", F.lit(version).alias("rule_version"), findings(F.col("text"), rules).alias("findings")).write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger, version).where(F.size("findings") > 0)
    # a blob may have a third of all paths: paths are dealt by blob and part, and the few blobs with findings go to each part
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS))
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    paths = versions.select("key", "blob", part.alias("part"))
    return paths.join(found, ["blob", "part"], "left").select(F.col("key").alias(key), "blob", F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(documents(spark, sf_dir), owned(new_path(spark, "secret-ledger")))
    spans = F.col("findings")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def _sql() -> str:
    """The same spans in DuckDB, from all rows alike."""
    parts, quoted = [], lambda s: "'" + s.replace("'", "''") + "'"
    for i, r in enumerate(RULES):
        rx = quoted(r.pattern)
        parts.append(
            f"""SELECT rid, {i} AS rank, {quoted(r.kind)} AS kind, k,
  list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS s,
  length(m[k]) AS len, length(g[k]) AS glen, {r.least} AS least
FROM (SELECT rid, p, m, g, unnest(range(1, len(m) + 1)) AS k FROM (
  SELECT rid, string_split_regex(t, {rx}) AS p, regexp_extract_all(t, {rx}) AS m, regexp_extract_all(t, {rx}, {r.group}) AS g
  FROM d WHERE regexp_matches(t, {rx})))"""
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, rank, kind, CAST(s AS BIGINT) AS s, CAST(s + len AS BIGINT) AS e FROM (
{union}
) WHERE glen >= least),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""


SQL = _sql()
