"""Source trees as relations of files."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.extract import LANGUAGES


def resolve_path(root: str, path: str) -> str:
    """An absolute path; a relative one is taken from the root."""
    return os.path.abspath(os.path.join(root, path))


def _plain(root: str) -> str:
    """A local path or URI as the reader reports it."""
    text = root if "://" in root or root.startswith("file:") else "file:" + os.path.abspath(root)
    u = urlparse(text)
    return unquote(f"{u.scheme}://{u.netloc}{u.path}" if u.netloc else f"{u.scheme}:{u.path}").rstrip("/")


def relative(path: Column, root: str) -> Column:
    """Paths below the root, without it; an error for a path outside."""
    base = _plain(root) + "/"
    decoded = F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^file:///", "file:/"), r"\+", "%2B"))
    return F.when(F.startswith(decoded, F.lit(base)), decoded.substr(F.lit(len(base) + 1), F.length(decoded))).otherwise(F.raise_error(F.concat(F.lit("path lies outside of the project: "), path)))


def scan_project(spark: SparkSession, root: str, lang: str, relative_paths: bool = True) -> DataFrame:
    """files(file_path, lang, content) with the language's suffixes at any depth; nothing is left out."""
    suffixes = ",".join(e[1:] for e in LANGUAGES[lang].extensions)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{suffixes}}}").load(root)
    path = relative(F.col("path"), root) if relative_paths else F.regexp_replace("path", "^file:/+", "/")
    return found.select(path.alias("file_path"), F.lit(lang).alias("lang"), "content")


def scan_file(spark: SparkSession, path: str, lang: str, root: str | None = None) -> DataFrame:
    """One file whatever its suffix; no row where it is missing or cannot be read."""
    empty = spark.createDataFrame([], "file_path string, lang string, content binary")
    if "://" not in path and not os.path.isfile(path):
        return empty
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(path)
    name = relative(F.col("path"), root) if root else F.regexp_replace("path", "^file:/+", "/")
    return found.select(name.alias("file_path"), F.lit(lang).alias("lang"), "content")
