"""Files in and out: folder listings, text decoding, questions, and the index on disk."""

from __future__ import annotations

import codecs
import contextlib
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .shared import written

# Fixed values of the data model.
SUFFIXES = "pdf|docx|txt|md"
QUESTION = "id string, lang string, question string, file string, page int"


def _local(folder: str) -> str | None:
    """The path of a folder that tasks can open themselves, null for other stores."""
    scheme, _, rest = folder.rpartition(":")
    return "/" + rest.lstrip("/") if scheme in ("", "file") and rest.startswith("/") else None


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.split("://")[-1].rstrip("/").removeprefix("file:") + "/"
    return files.withColumn("rel_path", F.element_at(F.split("path", root, 2), -1))


def _ignored(name: str) -> bool:
    return name.startswith((".", "~$"))


_ENTRY = "rel_path string, kind string, size long, mtime double"


def _entries(root: str, place: str) -> Iterator[tuple[str, str, int | None, float | None]]:
    """What a folder holds: folders, supported files, and places that can't be read. Links are left out, as they may lead out of the folder or back into it."""
    try:
        with os.scandir(os.path.join(root, place)) as found:
            for e in found:
                path = f"{place}/{e.name}" if place else e.name
                if _ignored(e.name) or e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    yield path, "folder", None, None
                elif re.search(rf"\.({SUFFIXES})$", e.name.lower()):
                    try:
                        info = e.stat(follow_symlinks=False)
                        yield path, "file", info.st_size, info.st_mtime
                    except OSError:
                        yield path, "failed", None, None
    except OSError:
        yield place or ".", "failed", None, None


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """``rel_path, kind, size, mtime`` of the supported files below a folder, and as ``kind`` failed the places that could not be read.

    Level by level, each level's folders are dealt to tasks, which list them; the rows of a level are written before the next. Executors see
    the folder at the same path. Names that begin with "." or "~$" are left out, with what is below them.
    """
    root = _local(folder)
    if root is None:
        raise ValueError(f"tasks can't list {folder}")

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place in frame["rel_path"]:
                found = _entries(root, place)
                while rows := list(itertools.islice(found, 10_000)):
                    yield pd.DataFrame(rows, columns=["rel_path", "kind", "size", "mtime"]).astype({"size": "Int64"})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, out = spark.createDataFrame([("",)], "rel_path string"), None
    while True:
        # dealt by name; files of one folder are one listing
        rows = written(level.repartition(n, "rel_path").mapInPandas(entries, _ENTRY), "walk")
        out = rows if out is None else out.unionByName(rows)
        level = rows.where("kind = 'folder'").select("rel_path")
        if not level.limit(1).count():
            return out.where("kind <> 'folder'")


def failed_places(found: DataFrame) -> DataFrame:
    """``place`` of each place that a ``walk`` could not read, as ``protect_unreadable`` takes them."""
    return found.where("kind = 'failed'").select(F.col("rel_path").alias("place"))


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``rel_path, size, mtime`` (seconds) of supported files below a folder; contents are not read.

    A folder that tasks can open is walked. In other stores Spark lists; its listing hides names that begin with "_" as well.
    """
    if _local(folder):
        return walk(spark, folder).where("kind = 'file'").drop("kind")
    rows = _listing(spark, folder)
    good = F.lower("rel_path").rlike(rf"\.({SUFFIXES})$") & ~F.col("rel_path").rlike(r"(^|/)(\.|~\$)")
    return rows.where(good).select("rel_path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def read_listed(listing: DataFrame, folder: str) -> DataFrame:
    """``rel_path, text, content_hash, error`` of listed text files (rel_path) below a folder that tasks can open; a file that can't be read has an error alone."""
    root = _local(folder)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["rel_path"]:
                try:
                    with open(os.path.join(root, name), "rb") as f:
                        data = f.read()
                    row = (name, decode_text(data), hashlib.sha256(data).hexdigest(), None)
                except OSError as e:
                    row = (name, None, None, e.strerror or type(e).__name__)
                yield pd.DataFrame([row], columns=["rel_path", "text", "content_hash", "error"])

    n = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listing.select("rel_path").repartition(n, "rel_path").mapInPandas(read, "rel_path string, text string, content_hash string, error string")


# The share of Thai among letters, and of vowel and tone marks that stand on a consonant or another mark.
THAI_SHARE, PLACED_SHARE = 0.3, 0.95
_THAI_MARK = "[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]"
_MARK = re.compile(_THAI_MARK)
_PLACED = re.compile(f"(?<=[\u0e01-\u0e2e]){_THAI_MARK}+")


def reads_as_thai(text: str) -> bool:
    letters = sum(map(str.isalpha, text))
    thai = sum(c.isalpha() for c in re.findall("[\u0e00-\u0e7f]", text))
    marks, placed = len(_MARK.findall(text)), sum(map(len, _PLACED.findall(text)))
    return letters > 0 and thai >= THAI_SHARE * letters and placed >= PLACED_SHARE * marks


#: (a file's first bytes, codec): the mark of each encoding that has one.
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: (codec, what its text must pass), tried in turn.
_TRIED = (("utf-8", lambda text: True), ("cp874", reads_as_thai), ("latin-1", lambda text: True))


def decode_text(data: bytes) -> str:
    """UTF-8 or UTF-16 with their marks, strict UTF-8, Thai cp874 if it reads as Thai, else Latin-1."""
    for mark, codec in _MARKS:
        if data.startswith(mark):
            return data.decode(codec, "replace")

    def attempts() -> Iterator[str]:
        for codec, passes in _TRIED:
            with contextlib.suppress(UnicodeDecodeError):
                if passes(text := data.decode(codec)):
                    yield text

    return next(attempts())


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``rel_path, text, content_hash`` of the text files below a folder. In stores that tasks can't open, only texts that are not plain UTF-8 pass through Python."""

    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: decode_text(bytes(b)))

    if _local(folder):
        texts = scan_corpus(spark, folder).where(F.lower("rel_path").rlike(r"\.(txt|md)$"))
        return read_listed(texts, folder).where("error is null").drop("error")
    rows = _listing(spark, folder).where(F.lower("rel_path").rlike(r"\.(txt|md)$"))
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    marked = F.hex(F.substring("content", 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    easy = rows.where(plain.isNotNull() & ~marked).select("rel_path", plain.alias("text"), F.sha2("content", 256).alias("content_hash"))
    hard = rows.where(plain.isNull() | marked).select("rel_path", decode("content").alias("text"), F.sha2("content", 256).alias("content_hash"))
    return easy.unionByName(hard)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet, a folder per project; a large project is spread over files."""
    chunks.repartition(F.col("project"), F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("project").parquet(path)


def swap_file_chunks(table: str, new: DataFrame, files: DataFrame, schema: str) -> int:
    """The chunks (file_id, ...) of the files in ``new`` are swapped for those in the versioned ``table``, all at once; files that left the table of ``files`` are ignored.

    A reader sees the old rows or the new ones; if anything fails on the way, the old ones stay.
    """
    current = new.join(files.select("file_id").distinct(), "file_id", "left_semi")
    return versions.swap(table, current, current.select("file_id").distinct(), "file_id", schema)
