"""Source trees: discovery, hashing, path rules."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas

# What is indexed, and what is not.
EXTENSIONS = ["js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "java", "rs", "cs", "json", "toml", "yaml", "yml"]
EXCLUDED = ["node_modules", "dist", "build", "target", "vendor", ".git", "bin", "obj", "out", "coverage"]
LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "cs": "csharp"}


def extension(file: str = "file") -> Column:
    return F.lower(F.regexp_extract(file, "\\.([^./]+)$", 1))


def accepted(file: str = "file", length: str = "length") -> Column:
    """A watched extension, no excluded folder, at most the size cap (where the size is known)."""
    small = F.coalesce(F.col(length) <= schemas.MAX_FILE_BYTES, F.lit(True))
    return extension(file).isin(*EXTENSIONS) & ~F.arrays_overlap(F.split(file, "/"), F.array(*map(F.lit, EXCLUDED))) & small


def language(file: str = "file") -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.element_at(table, extension(file)), F.lit("text"))


def discover(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """file (relative to root), length, content_hash, content of the accepted files.
    ignore: regular expressions over relative paths. The listing and the hashing run
    on executors; contents are read only where a later step asks for them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "^" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in posixpath.join(root.split("://")[-1].rstrip("/"), "")).replace("\\-", "-")
    file = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), base, "")
    rows = rows.select(file.alias("file"), "length", F.sha2("content", 256).alias("content_hash"), "content").where(accepted())
    for pattern in ignore or []:
        rows = rows.where(~F.col("file").rlike(pattern))
    return rows


def relative(path: str, root: str) -> str:
    """path relative to root; a path that leaves it is an error."""
    full = posixpath.normpath(posixpath.join(root, path))
    base = posixpath.normpath(root)
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    return posixpath.relpath(full, base)


def resolve_import(source_file: str, module: str) -> str:
    """A relative module path as seen from the file that names it; others as they are."""
    if not module.startswith("."):
        return module
    return posixpath.normpath(posixpath.join(posixpath.dirname(source_file), module))


def lines(files: DataFrame) -> DataFrame:
    """file, line (from 1), text of the files' contents."""
    text = F.split(F.make_valid_utf8(F.col("content").cast("string")), "\r?\n")
    return files.select("file", F.posexplode(text).alias("pos", "text")).select("file", (F.col("pos") + 1).cast("long").alias("line"), "text")
