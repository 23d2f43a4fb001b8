"""Sources: file scans with hashes, validated manifests, dictionaries and registries, and links of pages."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "company string, local_path string, sha256 string, directory_year string"


def year_and_hint(path: Column) -> tuple[Column, Column]:
    """The right-most part of a path that is a year, and the part before it; the first part if there is no year."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    years = F.transform(folders, lambda p, i: F.when(p.rlike(r"^(19|20)\d{2}$"), i))
    at = F.array_max(years)
    return F.get(folders, at).cast("int"), F.when(at.isNull(), F.get(folders, F.lit(0))).when(at > 0, F.get(folders, at - 1))


def scanned(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, file_bytes, sha256, directory_year, company_hint) of the files under root, each read once by an executor."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = F.lit(str(PurePosixPath(root.removeprefix("file:"))).rstrip("/") + "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    inner = F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
    year, hint = year_and_hint(inner)
    return files.select(inner.alias("path"), F.col("length").alias("file_bytes"), F.sha2("content", 256).alias("sha256"), year.alias("directory_year"), hint.alias("company_hint"))


def validated(manifest: DataFrame, companies: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to import, rejected rows with their reason). Rows that are stored by path or hash are skipped silently.

    manifest has MANIFEST's columns and row_number (the file's, from 2); the first of rows with equal path or hash counts.
    """
    ticker, digest, year = F.upper(F.trim("company")), F.lower(F.trim("sha256")), F.expr("try_cast(directory_year as int)")
    rows = manifest.select("row_number", ticker.alias("ticker"), F.trim("local_path").alias("local_path"), digest.alias("sha256"), year.alias("directory_year"))
    rows = rows.join(F.broadcast(companies.select(F.upper("ticker").alias("ticker"), F.lit(True).alias("known"))), "ticker", "left")
    same_path = F.row_number().over(Window.partitionBy("local_path").orderBy("row_number")) > 1
    same_hash = F.row_number().over(Window.partitionBy("sha256").orderBy("row_number")) > 1
    reason = (
        F.when(F.coalesce(F.length("ticker"), F.lit(0)) == 0, F.lit("no company")).when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("bad hash"))
        .when(~F.coalesce(F.col("directory_year").between(1900, 2100), F.lit(False)), F.lit("bad year")).when(F.col("known").isNull(), F.lit("unknown company"))
        .when(F.col("path_again"), F.lit("repeated path")).when(F.col("hash_again"), F.lit("repeated hash"))
    )
    judged = rows.withColumn("path_again", same_path).withColumn("hash_again", same_hash).withColumn("reason", reason).drop("known", "path_again", "hash_again")
    good = judged.where("reason is null").drop("reason")
    if stored is not None:
        for c in ("local_path", "sha256"):
            good = good.join(stored.select(c), c, "left_anti")
    return good.select("row_number", "ticker", "local_path", "sha256", "directory_year"), judged.where("reason is not null")


def registered(companies: DataFrame, given: DataFrame) -> DataFrame:
    """Companies with those of given that are new by ticker; a known name is never overwritten."""
    new = given.select(F.upper(F.trim("ticker")).alias("ticker"), "company_name").dropDuplicates(["ticker"]).join(companies.select("ticker"), "ticker", "left_anti")
    return companies.select("ticker", "company_name").unionByName(new)


def taxonomy(spark: SparkSession, nested: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Category, subcategory and term of a nested registry."""
    rows = [(c, s, t) for c, subs in nested.items() for s, terms in subs.items() for t in terms]
    return spark.createDataFrame(rows, "category string, subcategory string, term string")


def fingerprint(config: dict) -> str:
    """SHA-256 of a configuration as JSON with sorted keys."""
    from hashlib import sha256

    return sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def reviewed(reports: DataFrame, reviews: DataFrame) -> DataFrame:
    """Outcome of each confirmed or corrected review: applied, unchanged, or a conflict with this or another report.

    reports: report_id, company, period_end; reviews: report_id, decision, period_end.
    """
    given = reviews.where(F.col("decision").isin("CONFIRMED", "CORRECTED") & F.col("period_end").isNotNull()).select("report_id", F.col("period_end").alias("given"))
    joined = given.join(reports, "report_id", "left")
    owners = reports.where("period_end is not null").select("company", F.col("period_end").alias("given"), F.col("report_id").alias("owner"))
    joined = joined.join(owners, ["company", "given"], "left")
    outcome = (
        F.when(F.col("company").isNull(), F.lit("unknown report")).when(F.col("period_end") == F.col("given"), F.lit("unchanged")).when(F.col("period_end").isNotNull(), F.lit("conflict: another date is set"))
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("report_id")), F.lit("conflict: date is taken")).otherwise(F.lit("applied"))
    )
    return joined.select("report_id", "given", outcome.alias("outcome"))


def links(pages: DataFrame, include: str, exclude: str | None = None, first: int = 1990, last: int = 2100) -> DataFrame:
    """(page_id, url, text, year): anchors whose target or text matches include and not exclude and names a year; the last year counts."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0))
    a = pages.select("page_id", F.explode(anchors).alias("a"))
    a = a.select("page_id", F.regexp_extract("a", r"(?is)href=\"([^\"]*)\"", 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", ""), r"\s+", " ")).alias("text"))
    both = F.concat_ws(" ", "url", "text")
    keep = F.lower(both).rlike(include) if exclude is None else F.lower(both).rlike(include) & ~F.lower(both).rlike(exclude)
    years = F.filter(F.transform(F.regexp_extract_all(both, F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(first, last))
    return a.where(keep).withColumn("year", F.when(F.size(years) > 0, F.element_at(years, -1))).where("year is not null")


def best_by(candidates: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first candidate of each key."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
