"""Folders of files as tables: listing, hashing and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sheafwork.functions.text import basename, extension

# Extensions that are taken in, and those whose content is text.
FILE_TYPES = (".pdf", ".tif", ".tiff", ".jpg", ".jpeg", ".png", ".bmp", ".gif", ".docx", ".xlsx", ".xlsm", ".csv", ".txt",
              ".json", ".eml", ".webp", ".jfif", ".avif")
TEXT_TYPES = (".txt", ".csv", ".json", ".md", ".log")
KNOWN_CONFIDENCE, UNKNOWN_CONFIDENCE = 1.0, 0.2


def allowed(path: Column, extensions: Iterable[str] = FILE_TYPES, root: str = "") -> Column:
    """Whether a path has an allowed extension and no hidden file or folder below ``root``."""
    bare = re.sub(r"^\w+:(//[^/]*)?(?=/)", "", root).rstrip("/")
    at = F.locate(bare, path) if bare else F.lit(0)
    below = F.when(at > 0, path.substr(at + len(bare), F.length(path))).otherwise(path)
    return extension(path).isin(*[e.lower() for e in extensions]) & ~below.rlike(r"(^|/)\.[^/]")


def scan_corpus(spark: SparkSession, folder: str, extensions: Iterable[str] = FILE_TYPES,
                listing: DataFrame | None = None) -> DataFrame:
    """Files below the folder (path, modificationTime, length, content), hidden ones and other extensions left out.

    Content is only read when a later step asks for it. Spark's own listing passes over names that start with an
    underscore; where such files are wanted, give a ``listing`` (path, modificationTime, length), for instance a store's
    inventory, and the files it names are read in the tasks.
    """
    if listing is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        return files.filter(allowed(F.col("path"), extensions, folder))
    wanted = listing.select("path", "modificationTime", "length").filter(allowed(F.col("path"), extensions, folder))
    return wanted.withColumn("content", content_of("path"))


@F.pandas_udf(BinaryType())
def content_of(paths: pd.Series) -> pd.Series:
    """The bytes of the files at these paths or addresses."""
    def read(path: str) -> bytes:
        system, name = fs.FileSystem.from_uri(path if re.match(r"\w+://", path) else f"file://{path.removeprefix('file:')}")
        with system.open_input_stream(name) as stream:
            return stream.read()

    return paths.map(read, na_action="ignore")


def hash_files(files: DataFrame, algorithm: str = "md5") -> DataFrame:
    """Add ``hash`` of the content: md5 or sha256."""
    kind = algorithm.lower()
    if kind == "md5":
        return files.withColumn("hash", F.md5("content"))
    if kind in ("sha256", "sha-256"):
        return files.withColumn("hash", F.sha2("content", 256))
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def decode_text_files(files: DataFrame) -> DataFrame:
    """Add ``text`` and ``confidence``: UTF-8 when the bytes are valid, else Latin-1; unknown extensions score 0.2."""
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    known = extension(basename(F.col("path"))).isin(*TEXT_TYPES)
    return files.withColumns({
        "text": F.coalesce(utf8, F.decode("content", "ISO-8859-1")),
        "confidence": F.when(known, KNOWN_CONFIDENCE).otherwise(UNKNOWN_CONFIDENCE),
    })
