"""Advisory documents and asset ledgers."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.schemas import GRID, MERGED_RANGE
from exposure.sources.files import open_stream, paths_frame, qualified


def read_advisory_docs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Document files: ``path, size_bytes, head, sha256``. Uploads are size-limited, so a file fits a row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.col("length").alias("size_bytes"), F.substring("content", 1, 5).alias("head"),
        F.sha2("content", 256).alias("sha256"),
    )


def read_advisory_texts(spark: SparkSession, path: str) -> DataFrame:
    """Decoded documents, one text file per document with form feeds between pages."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"),
        F.col("value").alias("text"),
        F.size(F.split("value", "\f", -1)).alias("page_count"),
        F.sha2("value", 256).alias("sha256"),
    )


def read_asset_grid(spark: SparkSession, path: str) -> DataFrame:
    """Ledger cells: ``import_id, sheet, row_no, cells``."""
    return spark.read.schema(GRID).parquet(path)


def read_merged_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MERGED_RANGE).parquet(path)


def grid_from_csv(spark: SparkSession, path: str, import_id: int, sheet: str = "Sheet1") -> DataFrame:
    """A ledger saved as CSV, header lines included, as grid rows of any width.

    ``row_no`` counts the records of the file from 0, blank lines included, so line numbers and generated asset numbers follow
    the sheet. A ledger is one upload of limited size and is read by one task, record by record.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with open_stream(name) as f:
                    numbered = enumerate(csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline="")))
                    while some := list(islice(numbered, 1000)):
                        yield pd.DataFrame({"row_no": [n for n, _ in some], "cells": [[c or None for c in r] for _, r in some]})

    cells = paths_frame(spark, [qualified(spark, path)]).mapInPandas(rows, "row_no int, cells array<string>")
    return cells.select(F.lit(import_id).cast("bigint").alias("import_id"), F.lit(sheet).alias("sheet"), "row_no", "cells")
