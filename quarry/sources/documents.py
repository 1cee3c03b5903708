"""Sources: text files, HTML archives (ePUB), pasted text; errors become a column."""

from __future__ import annotations

import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import HTML_STEPS, strip_html, trim_space

MOST_BYTES = 100 * 1024 * 1024
#: Sections of a file go on together up to so many characters.
FEW_CHARACTERS = 4_000_000
PARTS = "path string, kb_id string, pos int, label string, text string, html string, error string"


def _matches(pattern: str, text: str) -> list[str]:
    return re.findall(pattern, text)


def _attribute(name: str, tag: str) -> str | None:
    found = re.search(f'{name}="([^"]*)"', tag)
    return found.group(1) if found else None


def spine_files(opf: str) -> list[str]:
    """The files of a package in reading order; references that lead nowhere are left out, the last of equal ids counts."""
    items = {i: h for t in _matches("<item[^>]*>", opf) if (i := _attribute("id", t)) is not None and (h := _attribute("href", t)) is not None}
    return [items[r] for t in _matches("<itemref[^>]*>", opf) if (r := _attribute("idref", t)) in items]


def archive_entries(data: bytes) -> dict[str, list[tuple[int, int, int, int]]]:
    """Where the files of a ZIP archive are: by name (method, begin, packed size, stated size), the last one with a name last.

    The archive is walked from local header to local header, so a truncated one gives what stands before the cut. Nothing is inflated.
    """
    out: dict[str, list[tuple[int, int, int, int]]] = {}
    at = 0
    while data[at : at + 4] == b"PK\3\4" and at + 30 <= len(data):
        method, packed, size, name_size, extra = struct.unpack_from("<8xH8xIIHH", data, at)
        begin = at + 30 + name_size + extra
        name = _text(data[at + 30 : at + 30 + name_size])
        if not name_size or begin + packed > len(data):
            break
        at = begin + packed
        if name and not name.endswith("/") and method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            out.setdefault(name, []).append((method, begin, packed, size))
    return out


def inflated(data: bytes, places: list[tuple[int, int, int, int]] | None, most: int = MOST_BYTES) -> bytes | None:
    """One file of an archive, the last undamaged one of its name. Of a deflated file that is larger the first ``most`` bytes count, or as many as
    its header states."""
    for method, begin, packed, size in reversed(places or []):
        part = memoryview(data)[begin : begin + packed]
        if method == zipfile.ZIP_STORED:
            return bytes(part)
        try:
            return zlib.decompressobj(-15).decompress(part, min(max(size, 1024), most))
        except zlib.error:
            continue
    return None


def archive_files(data: bytes, most: int = MOST_BYTES) -> dict[str, bytes]:
    """All files of a ZIP archive in memory; stored and deflated ones, damaged ones passed over."""
    return {name: found for name, places in archive_entries(data).items() if (found := inflated(data, places, most)) is not None}


def _text(data: bytes | None) -> str | None:
    try:
        return None if data is None else data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _blank(html: str) -> bool:
    """Whether nothing is left of HTML as text; only the tags matter for that."""
    for pattern, by in HTML_STEPS[:6]:
        html = re.sub(pattern, by, html)
    return not html.strip()


def archive_sections(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(pos, label, html): chapters in spine order, or all HTML files by path where no chapter can be found. One file is inflated at a time."""
    entries = archive_entries(data)
    read = lambda name: _text(inflated(data, entries.get(name)))
    container = read("META-INF/container.xml")
    package = re.search('full-path="([^"]+)"', container) if container else None
    opf = read(package.group(1)) if package else None
    found = False
    if opf:
        folder = posixpath.dirname(package.group(1))
        for i, name in enumerate(spine_files(opf)):
            html = read(posixpath.normpath(posixpath.join(folder, name)))
            if html is not None and not _blank(html):
                found = True
                yield i, f"Chapter {i + 1}", html
    if not found:
        pages = sorted(n for n in entries if n.endswith((".xhtml", ".html", ".htm")) and inflated(data, entries[n]) is not None)
        for i, name in enumerate(pages):
            if (html := read(name)) is not None and not _blank(html):
                yield i, f"Section {i + 1}", html


def read_documents(spark: SparkSession, path: str, parse_pdf: Callable[[bytes], list[str]] | None = None, recursive: bool = False) -> DataFrame:
    """(path, kb_id, pos, label, text, error) of all files below ``path``: .txt, .epub, and .pdf where a parser of pages is given.

    A file that gives nothing has one row with its error. kb_id is a digest of path and content, so a second read gives equal ids.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return parsed(files, parse_pdf)


def parsed(files: DataFrame, parse_pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, kb_id, pos, label, text, error) of files (path, content), also of a stream of them.

    Parts of a file go on a few megabytes at a time, so of an archive that is unpacked there is little more in memory than its own bytes.
    """
    names = ["path", "kb_id", "pos", "label", "text", "html", "error"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, id_, content in zip(pdf["path"], pdf["kb_id"], pdf["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
                empty = [None, None, None]
                try:
                    if kind == "txt":
                        text = _text(bytes(content))
                        found = [(0, "Full Text", text, None)] if text and text.strip() else []
                    elif kind == "epub":
                        found = ((i, label, None, html) for i, label, html in archive_sections(bytes(content)))
                    elif kind == "pdf" and parse_pdf:
                        found = [(i, f"Page {i + 1}", text, None) for i, text in enumerate(parse_pdf(bytes(content))) if text.strip()]
                    else:
                        rows.append((name, id_, 0, *empty, f"Unsupported: .{kind}"))
                        continue
                    any_, held = False, 0
                    for i, label, text, html in found:
                        any_, held = True, held + len(text or html)
                        rows.append((name, id_, i, label, text, html, None))
                        if held > FEW_CHARACTERS:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if not any_:
                        rows.append((name, id_, 0, *empty, "No text content found"))
                except ValueError as e:
                    rows.append((name, id_, 0, *empty, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    ids = files.select("path", F.sha2(F.concat(F.col("path").cast("binary"), F.lit("\n").cast("binary"), F.col("content")), 256).alias("kb_id"), "content")
    parts = ids.mapInPandas(parse, PARTS)
    return parts.withColumn("text", F.coalesce("text", strip_html(F.col("html")))).select("path", "kb_id", "pos", "label", "text", "error")


def pasted(texts: DataFrame) -> DataFrame:
    """Sections of pasted texts (kb_id, name, text): trimmed, blank ones left out; with the size in bytes."""
    trimmed = trim_space(F.col("text"))
    return texts.where(trimmed != "").select("kb_id", "name", F.lit(0).alias("pos"), F.lit("Full Text").alias("label"), trimmed.alias("text"), F.octet_length(trimmed).cast("long").alias("file_size"))


def file_stem(path) -> object:
    """A path's file name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "\\.[^.]*$", "")


def export_name(name):
    """A knowledge base's export file name."""
    return F.concat(F.left(F.regexp_replace(name, "[/:]", "-"), F.lit(100)), F.lit(".kb.json"))


def exported_bases(bases: DataFrame, chunks: DataFrame, now) -> DataFrame:
    """(id, file_name, json): each knowledge base with its chunks, by index, as one JSON text.

    One document's chunks make one value, so a base must fit into a task, as it must into the file; larger ones go by ``write_exports``.
    """
    parts = [c for c in chunks.columns if c not in ("knowledge_base_id", "index", "embedding")]
    held = chunks.groupBy(F.col("knowledge_base_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("index", *parts))).alias("chunks"))
    out = bases.join(held, "id", "left")
    whole = F.to_json(F.struct(F.struct(*bases.columns).alias("knowledgeBase"), F.coalesce("chunks", F.array()).alias("chunks"), now.alias("exportDate")))
    return out.select("id", export_name(F.col("name")).alias("file_name"), whole.alias("json"))


def write_exports(bases: DataFrame, chunks: DataFrame, path: str) -> None:
    """The same as JSON lines, without a bound on a base: bases below ``path``/bases, chunks below ``path``/chunks, in a folder for each base
    and by index."""
    bases.write.json(f"{path}/bases")
    rows = chunks.drop("embedding").repartitionByRange("knowledge_base_id", "index").sortWithinPartitions("knowledge_base_id", "index")
    rows.write.partitionBy("knowledge_base_id").json(f"{path}/chunks")


def write_memories(memories: DataFrame, path: str) -> None:
    """As JSON lines, without vectors."""
    memories.drop("embedding").write.json(path)


def read_memories(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """Memories from JSON lines; vectors are null until they are filled. Where there is no such file, those of ``legacy`` are read and written
    there, once."""
    from pyspark.errors import AnalysisException

    from quarry.schemas import MEMORY

    try:
        return spark.read.schema(MEMORY).json(path)
    except AnalysisException:  # no such path
        old = spark.read.schema(MEMORY).json(legacy) if legacy else spark.createDataFrame([], MEMORY)
        if not legacy:
            return old
        write_memories(old, path)
        return spark.read.schema(MEMORY).json(path)
