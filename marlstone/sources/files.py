"""What files are: signatures, and the members of archives."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of an archive and what its documents end in.
DOCUMENTS = (".pdf", ".html", ".htm", ".txt", ".doc", ".docx")
MOST_ENTRY, MOST_TOTAL, MOST_NAME = 268_435_456, 2_000_000_000, 95


def file_kind(content: Column, mime: Column) -> Column:
    """pdf, zip, html or binary, by the first bytes and, for html, the stated type."""
    head = F.decode(F.substring(content, 1, 2048), "iso-8859-1")
    bare = F.regexp_replace(head, r"^[ \t\n\r\f\x0B]+", "")
    pdf = F.regexp_replace(F.substring(head, 1, 1024), r"^[ \t\n\r\f\x0B]+", "").startswith("%PDF-")
    html = F.coalesce(F.contains(mime, F.lit("text/html")), F.lit(False)) | F.lower(bare).startswith("<!doctype html") | F.lower(bare).startswith("<html")
    return F.coalesce(F.when(pdf, "pdf").when(head.startswith("PK\u0003\u0004"), "zip").when(html, "html"), F.lit("binary"))


def slug(name: str) -> str:
    """Plain characters only, so that a name from outside leads nowhere else."""
    return re.sub(r"[^a-zA-Z0-9._-]+", "-", name).strip("-.")[:MOST_NAME] or "document"


def _members(data: bytes, suffixes: Sequence[str]) -> list[tuple]:
    """(entry, name, bytes, sha256, kind, error) of the documents in one archive."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return [(None, None, None, None, None, "not an archive")]
    with archive:
        entries = archive.infolist()
        if sum(e.file_size for e in entries) > MOST_TOTAL:
            return [(None, None, None, None, None, "the archive is over its limit")]
        out = []
        for entry in entries:
            last = entry.filename.rsplit("/", 1)[-1]
            suffix = "." + last.rsplit(".", 1)[-1].lower() if "." in last else ""
            if entry.is_dir() or suffix not in suffixes:
                continue
            if entry.file_size > MOST_ENTRY:
                out.append((entry.filename, None, entry.file_size, None, None, "the entry is over its limit"))
                continue
            body = archive.read(entry)
            sha = hashlib.sha256(body).hexdigest()
            metadata = "__MACOSX" in entry.filename.split("/") or last.startswith("._")
            wrong = suffix == ".pdf" and not metadata and not body[:1024].lstrip().startswith(b"%PDF-")
            out.append((entry.filename, f"{sha[:10]}--{slug(last)}", len(body), sha, "metadata" if metadata else "document", "not a PDF" if wrong else None))
        return out


def archive_members(files: DataFrame, suffixes: Sequence[str] = DOCUMENTS) -> DataFrame:
    """(path, entry, name, bytes, sha256, kind, error) of the document entries of archives
    (path, content): flat names, kind 'document' or 'metadata' (resource forks). Damaged or
    oversized archives give one row with the error."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rows = [], []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _members(data or b"", suffixes)
                paths += [path] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                                             names=["path", "entry", "name", "bytes", "sha256", "kind", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, entry string, name string, bytes long, sha256 string, kind string, error string")
