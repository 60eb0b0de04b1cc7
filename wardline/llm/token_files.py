"""A corpus as flat files of token ids with 64-bit offsets of its documents, for trainers that map files into memory.

Texts are dealt by ranges of doc_id, so that a task's documents are consecutive. Each task encodes them and writes two
files: ids as unsigned integers of two bytes (four for vocabularies beyond 65,536), one document after the other; and an
index of offsets. Its row in the manifest names them. A part's base, the ids before it, is the prefix sum of the parts
before it, so no task waits for another. Names are new for each attempt and only the manifest, which Spark commits, says
which count: a task that is run again leaves a file that nothing names.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SLICE_ROWS, documents, of_worker, shared_folder, slices, text_rows
from .tokens import _BEYOND_LATIN, PreTokenCache, _class, vocabulary_path

VOCABULARY, END = "word_bpe_49k.json", 1
#: The first bytes of an index; then, as 64-bit integers: bytes of an id, documents, documents without doc_id (the first
#: ones), the offsets (one more than documents, in ids from the part's first) and the doc_ids.
MAGIC = b"IDSFILE1"


class LowerWords(PreTokenCache):
    """Pre-tokens of a vocabulary of lower-case words with word ends: a text of Latin letters is lowered and split by the
    standard library; any other, or one whose letters leave that range when lowered, goes to the tokenizer whole."""

    def __init__(self, path: str, value, **more):
        super().__init__(path, value, **more)
        letter, digit, space = _class("L"), _class("N"), "\\t-\\r\\x20\\x85\\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+").findall

        self.leaving = re.compile(f"[{''.join(c for c in map(chr, range(0x250)) if max(c.lower()) >= chr(0x250))}]")

    def split(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special) or _BEYOND_LATIN.search(text) or not text.isascii() and self.leaving.search(text):
            return None
        return self.words(text.lower())


@dataclass(frozen=True)
class TokenFiles:
    """Where a written corpus lies, and its manifest: part, name, base, n_docs, n_tokens of each part, in order."""

    folder: str
    width: int
    parts: DataFrame


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, path: str, width: int, end_id: int | None) -> Iterator[pa.RecordBatch]:
    """One part: its two files, and a row that names them; nothing without documents."""
    kind = np.dtype(f"<u{width}")
    cache = of_worker((path, "flat", width), lambda: LowerWords(path, lambda ids: np.array(ids, dtype=kind).tobytes()))
    end = b"" if end_id is None else np.array([end_id], dtype=kind).tobytes()
    fs, base = _open(folder)
    name, offsets, docs, nulls, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", array("q", [0]), array("q"), 0, None
    for part in chain.from_iterable(map(slices, batches)):
        if out is None:
            out = fs.open_output_stream(f"{base}/{name}.ids")
        for doc, values in zip(part.column(0).to_pylist(), cache.values(part.column(1).to_pylist())):
            ids = b"".join(values) + end
            out.write(ids)
            offsets.append(offsets[-1] + len(ids) // width)
            docs.append(doc or 0)
            nulls += doc is None
    if out is None:
        return
    out.close()
    with fs.open_output_stream(f"{base}/{name}.idx") as index:
        index.write(MAGIC + np.array([width, len(docs), nulls, *offsets, *docs], dtype="<i8").tobytes())
    columns = {"part": (TaskContext.get().partitionId(), pa.int32()), "name": (name, pa.string()), "n_docs": (len(docs), pa.int64()), "n_tokens": (offsets[-1], pa.int64())}
    yield pa.RecordBatch.from_pydict({k: pa.array([v], t) for k, (v, t) in columns.items()})


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int | None = END) -> TokenFiles:
    """Write all documents, in ascending order of doc_id, into folder: a new one in the shared folder unless given, which
    executors must reach by path or by a store that Arrow opens.

    Null and empty texts hold the end id alone (without one, nothing). Rows without doc_id come first. Rows of one doc_id
    go by a hash of their texts, so however many there are they are dealt over tasks; repeated rows are written each.
    Other columns are ignored; an empty table gives a manifest without parts."""
    from tokenizers import Tokenizer

    path = path or vocabulary_path(VOCABULARY)
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id or 0) < 1 << 16 else 4
    fs, base = _open(folder)
    fs.create_dir(base)
    rows = text_rows(docs).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    parts = dealt.mapInArrow(lambda batches: _write_part(batches, folder, path, width, end_id), "part int, name string, n_docs long, n_tokens long")
    parts.write.parquet(f"{folder}/parts")
    named = spark.read.schema(parts.schema).parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    based = named.select("part", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_docs", "n_tokens")
    based.write.parquet(f"{folder}/manifest")
    return TokenFiles(folder, width, spark.read.schema(based.schema).parquet(f"{folder}/manifest"))


class Part:
    """The files of one part, mapped into memory where they are local, else read where asked."""

    def __init__(self, folder: str, name: str, base: int):
        fs, at = _open(folder)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.ids = pa.memory_map(f"{at}/{name}.ids") if local else fs.open_input_file(f"{at}/{name}.ids")
        with pa.memory_map(f"{at}/{name}.idx") if local else fs.open_input_file(f"{at}/{name}.idx") as file:
            if file.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{name}.idx isn't an index of token files")
            self.width, n, nulls = np.frombuffer(file.read(24), dtype="<i8").tolist()
            self.offsets = np.frombuffer(file.read(8 * (n + 1)), dtype="<i8")
            ids = np.frombuffer(file.read(8 * n), dtype="<i8").tolist()
        self.doc_ids, self.base = [None] * nulls + ids[nulls:], base

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end of this part."""
        self.ids.seek(int(start) * self.width)
        return np.frombuffer(self.ids.read_buffer(int(end - start) * self.width), dtype=f"<u{self.width}")


class TokenStore:
    """A written corpus for a trainer's process: any run of ids, any document, by its place in the whole. Only the
    manifest and the parts that are asked for are opened."""

    def __init__(self, files: TokenFiles):
        rows = sorted(files.parts.collect(), key=lambda r: r.part)
        self.folder, self.names, self.bases, self.sizes = files.folder, [r.name for r in rows], [r.base for r in rows], [r.n_tokens for r in rows]
        self.firsts = np.cumsum([0, *(r.n_docs for r in rows)]).tolist()
        self.opened: dict[int, Part] = {}

    def __len__(self) -> int:
        return sum(self.sizes)

    def _part(self, k: int) -> Part:
        if k not in self.opened:
            self.opened[k] = Part(self.folder, self.names[k], self.bases[k])
        return self.opened[k]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from start on (fewer at the end), across parts."""
        out, at, end = [np.zeros(0, dtype=np.uint32)], start, min(start + n, len(self))
        while at < end:
            k = bisect_right(self.bases, at) - 1
            stop = min(end, self.bases[k] + self.sizes[k])
            out.append(self._part(k).read(at - self.bases[k], stop - self.bases[k]).astype(np.uint32))
            at = stop
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        k = bisect_right(self.firsts, i) - 1
        part = self._part(k)
        return part.read(*part.offsets[i - self.firsts[k] : i - self.firsts[k] + 2])


def read_tokens(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document, read from the files: start counts the ids of all documents before,
    ids are little-endian unsigned 32-bit integers. A part is one task's; documents pass in batches of bounded size."""
    folder = files.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, base in chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches):
            part, at = Part(folder, name, base), 0
            while at < len(part.doc_ids):
                end = int(np.searchsorted(part.offsets, part.offsets[at] + SLICE_BYTES // 4, side="right")) - 1
                end = min(max(end, at + 1), at + SLICE_ROWS, len(part.doc_ids))
                cuts = part.offsets[at : end + 1]
                ids = part.read(cuts[0], cuts[-1]).astype("<u4")
                each = [ids[a:b].tobytes() for a, b in zip(cuts - cuts[0], cuts[1:] - cuts[0])]
                yield pa.RecordBatch.from_arrays([pa.array(part.doc_ids[at:end], pa.int64()), pa.array(base + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(each, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                at = end

    return files.parts.select("name", "base").repartition(max(1, files.parts.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, sf_dir))).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
