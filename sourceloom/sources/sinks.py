"""Writers of the knowledge base and its by-products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import paths as P
from sourceloom.operators.kb import compact, survivors
from sourceloom.session import shared_dir
from sourceloom.sources.tree import write_files


def json_documents(built: DataFrame) -> DataFrame:
    """``(repo, json_path, kb_json)``: the compact document of every analysed file."""
    return compact(built.where(F.col("failure").isNull())).select(
        "repo",
        F.concat(P.without_extension(F.col("path")), F.lit(".json")).alias("json_path"),
        "language",
        "kb_json",
    )


def write_kb(built: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ("language",)) -> None:
    """The nested table as Parquet. Written by the map tasks themselves, without a shuffle."""
    built.write.mode(mode).partitionBy(*by).parquet(path)


def write_json(built: DataFrame, root: str) -> DataFrame:
    """One JSON file per path, ``<root>/<repo>/<path without extension>.json``: ``(file_id, repo, json_path, status, reason)``.

    Of files that share a path up to the extension, the greatest path is written. A file that cannot be written has the status
    ``write error``. The documents are made once, into a table in the
    shared folder, from which paths are compared and files are written. Each evaluation of the result writes the files.
    """
    good = built.where(F.col("failure").isNull())
    made = compact(good).select("file_id", "repo", "path", "kb_json")
    table = shared_dir(built.sparkSession, "kb-documents")
    made.write.parquet(table)
    made = built.sparkSession.read.schema(made.schema).parquet(table)
    chosen = survivors(made.select("repo", "path", "file_id")).select("repo", F.col("kb_file_id").alias("file_id"))
    documents = made.join(chosen, ["repo", "file_id"], "left_semi").select(
        "file_id", "repo", F.concat(P.without_extension(F.col("path")), F.lit(".json")).alias("json_path"), "kb_json"
    )
    named = documents.withColumn("_target", F.concat("repo", F.lit("/"), "json_path"))
    return write_files(named, root, "_target", "kb_json").drop("_target")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_snapshots(heads: DataFrame, path: str) -> None:
    """The head commit per repository at build time, as read back by the staleness check."""
    heads.select("repo", F.col("head_commit").alias("stored_commit")).write.mode("overwrite").parquet(path)
