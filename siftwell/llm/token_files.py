"""Token ids as Parquet files, written in document order and read back by column.

A file row is a document: ``doc_id``, ``n_tokens`` and ``ids`` (list of 32-bit integers, the end id last). Files
follow one another in ascending doc_id order. Row groups and pages are kept small enough that a reader
fetches few bytes besides the documents it asks for; ids are dictionary-encoded and metadata columns delta-encoded
(format version 2), and the page indexes that the writer adds let readers skip pages by doc_id.

Defined results: a null or empty text has the end id alone; an added token's literal in a text has that token's id; rows with equal doc_id stand in the order of
a hash of their text; null ids come first; a text of any length is one row; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_tasks, shared_folder, text_bytes

END = 2
#: Most words in a Python worker's cache of words already encoded.
CACHE = 1_000_000
#: Documents encoded at once, and sent to Python at once.
SLICE = 500
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000

FILE_SCHEMA = "doc_id long, n_tokens int, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])


#: Words that lower-casing and NFC leave alone and that the pattern keeps whole.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
# The steps of a tokenizer file under which a plain word is one token border to border and goes to the model as it is.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet as a table for str.translate: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return dict(zip((b for b in range(256) if b not in plain), map(chr, range(256, 512)), strict=False))


class Encoder:
    """Texts to ids with a ``tokenizers`` file whose words never reach over white space and which ignores case.

    Each new word between spaces goes through the library once; its ids are then kept as bytes. Plain words go to the
    library's model directly if the file's other steps are those of ``_STEPS``, which leave them as they are. The vocabulary's added tokens
    keep their own ids, as by the library's defaults: words that hold one in any case go to the library as they are written.
    """

    def __init__(self, tokenizer: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # matched on the raw text, so that lower-casing must not make one or break one
        self.added = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.marks = {b"": b""}
        self.cache = cache
        self.model = self.tokenizer.model
        steps = json.loads(tokenizer)
        self.direct = all(steps.get(k) == v for k, v in _STEPS.items())

    def _modelled(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, text: bytes | None) -> bytes:
        """Ids as 32-bit integers."""
        if not text:
            return b""
        if self.direct and self.added and self.added.search(text):
            words = [w if self.added.search(w) else w.lower() for w in text.split()]
        else:
            words = (text.lower() if self.direct else text).split()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(known.__getitem__, words))

    def _learn(self, words: list[bytes]) -> None:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.cache:
            known.clear()
            new = set(words)
        rest = []
        for w in new:
            stem, mark = (w[:-1], w[-1:]) if w[-1:] in (b".", b",") else (w, b"")
            # between a letter and a full stop or comma there is always a token border
            if self.direct and (ids := self._plain(stem)) is not None:
                known[w] = ids + self._mark(mark)
            else:
                rest.append(w)
        if rest:
            for w, ids in zip(rest, self._whole([w.decode() for w in rest]), strict=True):
                known[w] = array("i", ids).tobytes()

    def _plain(self, stem: bytes) -> bytes | None:
        if (ids := self.known.get(stem)) is not None and (stem.isalpha() or _PLAIN.fullmatch(stem.decode())):
            return ids
        if stem.isalpha():  # ASCII, and in lower case by now
            return array("i", [t.id for t in self.model.tokenize(stem.decode())]).tobytes()
        word = stem.decode()
        return array("i", self._modelled(word)).tobytes() if _PLAIN.fullmatch(word) else None

    def _mark(self, mark: bytes) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = array("i", self._whole([mark.decode()])[0]).tobytes()
        return self.marks[mark]


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encodes ``docs`` and writes the files. Range partitions bound what one task sorts."""

    with open(tokenizer, encoding="utf-8") as f:
        # the vocabulary file; a Python worker keeps its copy, and with it the words it knows, from task to task
        shared = docs.sparkSession.sparkContext.broadcast({"file": f.read()})
    last = array("i", [end]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        encoder = kept.setdefault("encoder", None) or Encoder(kept["file"])
        kept["encoder"] = encoder
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = [encoder(t) + last for t in text_bytes(batch)]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
                yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int32()), lists], schema=_ARROW)

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    (
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .transform(in_tasks, encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with the part number and name of their file and their place in it."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, "part-([0-9]+)", 1).cast("long")
    return spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_id", "n_tokens", "ids", F.struct(part.alias("part"), name.alias("name")).alias("file"), F.col("_metadata.row_index").alias("row"))


def fetch(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Documents of a doc_id range: statistics and page indexes keep other row groups and pages unread."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).where(F.col("doc_id").between(low, high))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` adds the tokens of earlier files to a running sum inside each file. The files' totals, a row
    per file, come from the ``n_tokens`` column alone.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64()), batch.column(2), batch.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    placed = _placed(spark, path)
    totals = sorted((r["file"]["part"], r["file"]["name"], r["n"]) for r in placed.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    before, offsets = 0, []
    for part, name, n in totals:
        offsets.append(((part, name), before))
        before += n
    earlier = spark.createDataFrame(offsets, "file struct<part:long,name:string>, earlier long")
    rows = placed.select("doc_id", "ids", "file", "row").transform(in_tasks, crc, "doc_id long, n_tokens long, ids_crc32 long, file struct<part:long,name:string>, row long")
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("inside", inside).join(F.broadcast(earlier), "file").select("doc_id", (F.col("earlier") + F.col("inside") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    path = shared_folder(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
