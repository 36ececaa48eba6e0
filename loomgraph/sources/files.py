"""Documents and source files from folders."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import DEFAULT_IGNORE


def _walk(spark: SparkSession, root: str, pattern: str, ignore: tuple[str, ...]) -> DataFrame:
    if "://" not in root and not os.path.exists(root):
        raise FileNotFoundError(root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", "^file:", "")
    inside = F.split(F.substring(path, len(root.rstrip("/")) + 2, 1 << 30), "/")
    folders = F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0)))
    return read.select(path.alias("source"), F.decode("content", "UTF-8").alias("text"), "modificationTime").filter(~F.exists(folders, lambda part: part.isin(*ignore)))


def markdown(spark: SparkSession, root: str, ignore: tuple[str, ...] = DEFAULT_IGNORE) -> DataFrame:
    """``(source, text, modificationTime)`` of the markdown files under ``root``, whatever the case of their ending, but those in folders to ignore.

    A root that doesn't exist is an error.
    """
    return _walk(spark, root, "*.[mM][dD]", ignore)


def typescript(spark: SparkSession, root: str, ignore: tuple[str, ...] = DEFAULT_IGNORE) -> DataFrame:
    """The same of TypeScript files; their ending must be in lower case."""
    return _walk(spark, root, "*.{ts,tsx}", ignore)


def repository_of(path: str) -> str:
    """The name of the repository around ``path``: that of the nearest folder with a ``.git`` folder in it."""
    at = os.path.abspath(path)
    while True:
        if os.path.isdir(os.path.join(at, ".git")):
            return os.path.basename(at)
        if os.path.dirname(at) == at:
            raise ValueError(f"{path} is in no repository")
        at = os.path.dirname(at)


def common_repository(paths: list[str]) -> str:
    """The one repository that all ``paths`` are in."""
    names = {repository_of(path) for path in paths}
    if len(names) != 1:
        raise ValueError(f"paths span multiple repositories: {', '.join(sorted(names))}")
    return names.pop()
