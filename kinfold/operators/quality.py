"""Rules for result tables of id lists: (source1_entity_id, a comma list of matched or candidate ids)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tsv import read_ids

EXAMPLES = 5
MATCHING_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.errors


def header_error(line: str | None, expected: list[str]) -> str | None:
    """What is wrong with a header line, if anything is; case and outer spaces don't matter."""
    if not line:
        return "the file is empty"
    if "\t" not in line and "," in line:
        return "the header is separated by commas; tabs are needed"
    names = [c.strip().lower() for c in line.split("\t")]
    return None if names == expected else f"unexpected header {names}; expected {expected}"


def list_rows(lines: DataFrame) -> DataFrame:
    """(line) to (s1, ids, malformed): the first field, the list of ids (empty if blank), and whether a non-blank line has no tab."""
    rest = F.regexp_extract("line", r"(?s)^[^\t]*\t(.*)$", 1)
    out = lines.withColumn("tab", F.contains("line", F.lit("\t"))).where(F.col("tab") | (F.trim("line") != ""))
    ids = F.when(F.trim(rest) != "", F.split(rest, ",", -1)).otherwise(F.array().cast("array<string>"))
    return out.select(F.split("line", "\t", 2)[0].alias("s1"), ids.alias("ids"), (~F.col("tab")).alias("malformed"))


def findings(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(rule, n, examples): offenders of each broken rule, the first five in order. required, valid: (id)."""
    good = rows.where("not malformed")
    each = good.select("s1", F.explode("ids").alias("id"))
    seen = good.select(F.col("s1").alias("item")).distinct()
    parts = {
        "malformed_row": rows.where("malformed").select(F.col("s1").alias("item")),
        "duplicate_row": good.groupBy(F.col("s1").alias("item")).count().where("count > 1").select("item"),
        "repeated_id": good.where(F.size("ids") > F.size(F.array_distinct("ids"))).select(F.col("s1").alias("item")),
        "self_match": each.where(F.startswith("id", F.lit("S1-"))).select(F.col("id").alias("item")),
        "wrong_prefix": each.where(~F.col("id").rlike("^S[123]-")).select(F.col("id").alias("item")),
        "missing_s1": required.select(F.col("id").alias("item")).join(seen, "item", "left_anti"),
        "extra_s1": seen.join(required.select(F.col("id").alias("item")), "item", "left_anti"),
    }
    if valid is not None:
        known = each.where(F.col("id").rlike("^S[23]-")).select(F.col("id").alias("item"))
        parts["unknown_id"] = known.join(valid.select(F.col("id").alias("item")), "item", "left_anti")
    every = None
    for rule, items in parts.items():
        part = items.distinct().select(F.lit(rule).alias("rule"), "item")
        every = part if every is None else every.unionByName(part)
    first = every.withColumn("k", F.row_number().over(W.partitionBy("rule").orderBy("item"))).where(F.col("k") <= EXAMPLES)
    shown = first.groupBy("rule").agg(F.array_sort(F.collect_list("item")).alias("examples"))
    return every.groupBy("rule").agg(F.count("*").alias("n")).join(shown, "rule")


def not_candidates(matching: DataFrame, candidate: DataFrame) -> DataFrame:
    """(s1, extra): matched ids that aren't among an s1's candidates."""
    left = matching.where("not malformed").select("s1", "ids")
    right = candidate.where("not malformed").select("s1", F.col("ids").alias("cand"))
    extra = F.array_except("ids", F.coalesce("cand", F.array().cast("array<string>")))
    return left.join(right, "s1", "left").select("s1", extra.alias("extra")).where(F.size("extra") > 0)


def validate(spark: SparkSession, matching: str, required: DataFrame, candidate: str | None = None, valid: DataFrame | None = None) -> Report:
    """Checks the files; matches outside the candidates are a warning, all else is an error."""
    report, parsed = Report(), {}
    for path, expected in ((matching, MATCHING_HEADER), (candidate, CANDIDATE_HEADER)):
        if path is None:
            continue
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            report.errors.append(f"{path}: not found")
            continue
        first = spark.read.text(path).limit(1).collect()
        if problem := header_error(first[0][0] if first else None, expected):
            report.errors.append(f"{path}: {problem}")
            continue
        lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.col("value") != first[0][0])
        parsed[path] = list_rows(lines)
        for r in findings(parsed[path], required, valid).collect():  # one row for each rule
            more = f"{r['n']} in all, such as " if r["n"] > EXAMPLES else ""
            report.errors.append(f"{path}: {r['rule']}: {more}{', '.join(r['examples'])}")
    if matching in parsed and candidate in parsed:
        extra = not_candidates(parsed[matching], parsed[candidate]).select("s1").orderBy("s1").limit(EXAMPLES).collect()
        if extra:
            report.warnings.append("matches that are no candidates, for " + ", ".join(r["s1"] for r in extra))
    return report


def match_targets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id): ids of the sources that matches can point to."""
    out = read_ids(spark, paths[0])
    for path in paths[1:]:
        out = out.union(read_ids(spark, path))
    return out.distinct()
