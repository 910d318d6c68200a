"""Folders of documents, order lists and requirement texts, by any path that Spark's readers open."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import file_name, stem
from tamis.operators.criteria import split_requirements
from tamis.operators.ordering import by_precedence, parse_order
from tamis.providers import Parser


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, stem, raw, valid`` of each ``*.json``; files that do not parse stay, as not valid.  Sort where they are shown."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    named = files.select(file_name(F.col("_metadata.file_path")).alias("file_name"), F.col("value").alias("raw"))
    valid = F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")
    return named.select("file_name", stem(F.col("file_name")).alias("stem"), "raw", valid.alias("valid"))


def scan_folders(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """JSON files of several folders; of one name the first folder's counts."""
    return by_precedence([json_files(spark, p) for p in paths], "file_name")


def find_file(spark: SparkSession, paths: Sequence[str], name: str) -> DataFrame:
    """The one file of that name (without folders), or no row."""
    return scan_folders(spark, paths).where(F.col("file_name") == name.replace("\\", "/").rsplit("/", 1)[-1])


def parsed_files(spark: SparkSession, path: str, factory: Callable[[], Parser], pattern: str = "*.pdf") -> DataFrame:
    """``file_name, stem, text, warnings, error`` of binary files, read by a parser that each task makes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = factory()
        for batch in batches:
            rows = []
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    text, warnings = parser.parse(path_, content)
                    rows.append((path_, text, warnings, None))
                except Exception as failure:  # a file that cannot be read is a row that says why
                    rows.append((path_, None, [], f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=["path", "text", "warnings", "error"])

    read = files.mapInPandas(run, "path string, text string, warnings array<string>, error string")
    name = file_name(F.col("path"))
    return read.select(name.alias("file_name"), stem(name).alias("stem"), "text", "warnings", "error")


# Names of order lists, compared without regard to case.
ORDER_NAMES = ("evaluation_order.txt", "evaluation_order", ".evaluation_order", "evaluation_order.md", "evaluation-order.txt", "evaluation-order")


def find_order_list(spark: SparkSession, folders: Sequence[str]) -> str | None:
    """The path of an order list: in the first folder that has one by one of its names, in their order, else anywhere below the folders.

    Below a folder, a file whose name begins with ``evaluation_order`` counts too, the first by path.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in (jvm.org.apache.hadoop.fs.Path(f) for f in folders) if p.getFileSystem(conf).exists(p)]
    for folder in there:
        names = {s.getPath().getName(): str(s.getPath()) for s in folder.getFileSystem(conf).listStatus(folder) if s.isFile()}
        exact = next((names[n] for n in ORDER_NAMES if n in names), None)
        folded = next((names[n] for n in sorted(names) if n.lower() in ORDER_NAMES), None)
        if exact or folded:
            return exact or folded
    for folder in there:
        files, found = folder.getFileSystem(conf).listFiles(folder, True), []
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().lower() in ORDER_NAMES or path.getName().lower().startswith("evaluation_order"):
                found.append(str(path))
        if found:
            return min(found)
    return None


def order_list(spark: SparkSession, path: str) -> DataFrame:
    """``tier, place, item`` of an order list file."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return parse_order(lines, "at", "line")


def requirements(spark: SparkSession, text: str = "", path: str | None = None, hidden: str = "") -> DataFrame:
    """One row ``standard, hidden`` of a literal text or a file, cut at its first ``---``."""
    raw = spark.read.option("wholetext", True).text(path).select("value") if path else spark.createDataFrame([(text,)], "value string")
    return raw.select(split_requirements(F.col("value"), F.lit(hidden)).alias("r")).select("r.*")


def by_number(files: DataFrame, numbers: Sequence[int], pattern: str = r"(\d+)") -> DataFrame:
    """Files whose name's first number (by ``pattern``, whatever the case) is one of ``numbers``."""
    return files.where(F.regexp_extract("file_name", f"(?i){pattern}", 1).try_cast("long").isin(list(numbers)))


def with_twin(files: DataFrame, others: DataFrame) -> DataFrame:
    """Files that have a file of the same stem among the others."""
    return files.join(others.select("stem"), "stem", "left_semi")


def beside_twin(files: DataFrame, others: DataFrame) -> DataFrame:
    """``files`` with ``twin``, the first other file of the same stem by name, if any."""
    first = others.groupBy(F.col("stem").alias("__stem")).agg(F.min("file_name").alias("twin"))
    return files.join(first, F.col("stem") == F.col("__stem"), "left").drop("__stem")
