"""Files as tables: listings, content hashes, JSON side files."""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import VIDEO_EXTENSIONS

# File name endings of pictures (JPEG XL where its tools are there), and folders that hold no library files.
PICTURE_EXTENSIONS = (
    "jpg", "jpeg", "jpe", "jfif", "png", "webp", "tif", "tiff", "bmp", "gif", "ppm", "pgm", "tga", "ico", "jp2", "j2k", "jxl", "heic", "heif", "avif",
    "cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "raf", "orf", "rw2", "pef", "dng", "raw", "erf", "kdc", "mos", "mrw", "x3f", "3fr", "iiq", "rwl", "srw",
)
SKIPPED_FOLDERS = (".git", ".svn", ".hg", "node_modules", "__pycache__", ".cache", ".thumbnails", ".Trash", ".Trash-1000", "lost+found", ".stversions", ".stfolder", "@eaDir", ".@__thumb", "@Recycle")
HEAD_BYTES = 64 * 1024
PAGE_BYTES, CHUNK_BYTES = 64 * 1024, 1 << 20


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = (*PICTURE_EXTENSIONS, *VIDEO_EXTENSIONS)) -> DataFrame:
    """(path, filename, ext, bytes, mtime) of the pictures and videos below a root; contents aren't read.

    Hidden files and folders, and SKIPPED_FOLDERS, are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select("path", F.col("length").alias("bytes"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    parts = F.split(F.substring(F.col("path"), F.lit(1), F.length("path")), "/")
    rows = rows.withColumns({"filename": F.element_at(parts, -1), "ext": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})
    bad = F.exists(parts, lambda p: (F.startswith(p, F.lit(".")) & (F.length(p) > 1)) | p.isin(*SKIPPED_FOLDERS))
    return rows.where(F.col("ext").isin(*extensions) & ~bad).select("path", "filename", "ext", "bytes", "mtime")


class Ranged:
    """A file that is read where it is asked for: slices like bytes, in pages; ``taken`` counts the bytes read.

    The path is one that Spark lists (file:, hdfs:, s3: and so on), opened by Arrow in the task itself.
    """

    def __init__(self, path: str, page: int = PAGE_BYTES) -> None:
        from pyarrow import fs

        uri = re.sub(r"^file:/+", "file:///", path) if ":" in path.split("/", 1)[0] else "file://" + path
        store, inner = fs.FileSystem.from_uri(urllib.parse.quote(uri, safe=":/%+@") if uri.startswith("file:") else uri)
        self.file, self.page, self.pages, self.taken = store.open_input_file(inner), page, {}, 0
        self.size = self.file.size()

    def __len__(self) -> int:
        return self.size

    def read(self, start: int, end: int) -> bytes:
        """The bytes from start to end, not kept."""
        data = self.file.read_at(max(0, min(end, self.size) - start), start)
        self.taken += len(data)
        return data

    def __getitem__(self, at):
        if isinstance(at, int):
            return self[at : at + 1][0]
        start, end, _ = at.indices(self.size)
        out = b""
        for k in range(start // self.page, -(-end // self.page) if end > start else 0):
            if k not in self.pages:
                while len(self.pages) >= 4:
                    self.pages.pop(next(iter(self.pages)))
                self.pages[k] = self.read(k * self.page, (k + 1) * self.page)
            out += self.pages[k]
        first = start // self.page * self.page
        return out[start - first : end - first] if end > start else b""

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def opened(path: str) -> Ranged | None:
    """The file, or None if it can't be read."""
    try:
        return Ranged(path)
    except OSError:
        return None


def fingerprint(data: Ranged) -> str:
    """A quick hash: of the size, the first 64 KiB and, beyond twice that, the last."""
    h = hashlib.blake2b(struct.pack("<Q", len(data)), digest_size=16)
    h.update(data.read(0, HEAD_BYTES))
    if len(data) > 2 * HEAD_BYTES:
        h.update(data.read(len(data) - HEAD_BYTES, len(data)))
    return h.hexdigest()


def digest(data: Ranged) -> str:
    """A hash of all bytes, a chunk at a time."""
    h = hashlib.blake2b(digest_size=20)
    for at in range(0, len(data), CHUNK_BYTES):
        h.update(data.read(at, at + CHUNK_BYTES))
    return h.hexdigest()


def _hashed(files: DataFrame, column: str, of: Callable[[Ranged], str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                if (data := opened(path)) is not None:
                    with data:
                        out.append((path, of(data), data.taken))
            yield pd.DataFrame(out, columns=["path", column, "taken"])

    return files.select("path").mapInPandas(run, f"path string, {column} string, taken long")


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, fingerprint, taken) of listed files: 128 KiB at most are read of each (taken); unreadable ones are left out."""
    return _hashed(files, "fingerprint", fingerprint)


def digests(files: DataFrame) -> DataFrame:
    """(path, digest, taken) of listed files, read whole, in chunks; see dupes.to_hash for those that need it."""
    return _hashed(files, "digest", digest)


STATE = "path string, favorite int, rating int, hidden int, trashed_at double, title string, caption string, keywords string, taken_at double, date_source string, modified_at double"
STATE_COLUMNS = tuple(c.split()[0] for c in STATE.split(", "))


def write_state(photos: DataFrame, path: str) -> None:
    """Marks of photos that differ from the default, as JSON lines; a new folder each time."""
    marked = (F.coalesce("favorite", F.lit(0)) > 0) | (F.coalesce("rating", F.lit(0)) > 0) | (F.coalesce("hidden", F.lit(0)) > 0) | F.col("trashed_at").isNotNull() | F.coalesce("title", "caption", "keywords").isNotNull() | F.coalesce(F.col("date_source").isin("manual", "recorded"), F.lit(False))
    photos.where(marked).select(*STATE_COLUMNS).write.mode("errorifexists").json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).json(path)


def restored(photos: DataFrame, state: DataFrame) -> DataFrame:
    """Photos with the marks of a side file; a date from it only replaces one from a folder or the file's time."""
    named = state.select("path", *(F.col(c).alias("s_" + c) for c in STATE_COLUMNS if c != "path"))
    joined = photos.join(named, "path", "left")
    there = F.col("s_modified_at").isNotNull() | F.coalesce("s_favorite", "s_rating", "s_hidden").isNotNull()
    weak = F.coalesce(F.col("date_source").isin("folder", "mtime"), F.lit(True)) & F.col("s_taken_at").isNotNull()
    marks = {c: F.when(there, F.col("s_" + c)).otherwise(F.col(c)) for c in ("favorite", "rating", "hidden", "trashed_at", "title", "caption", "keywords")}
    dated = {"taken_at": F.when(weak, F.col("s_taken_at")).otherwise(F.col("taken_at")), "date_source": F.when(weak, F.coalesce("s_date_source", F.lit("recorded"))).otherwise(F.col("date_source"))}
    return joined.withColumns(marks | dated).select(*photos.columns)
