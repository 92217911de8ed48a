"""Files as tables: text, DOCX (paragraphs, images), chord documents; and the sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import at

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_V = "{urn:schemas-microsoft-com:vml}"
PARAGRAPHS = "path string, line_no int, text string, runs array<string>, has_image boolean, error string"
IMAGES = "path string, image_no int, name string, content binary"


def input_files(spark: SparkSession, folder: str, pattern: str = "*.{docx,pdf,txt,cho,DOCX,PDF,TXT,CHO}", recursive: bool = False) -> DataFrame:
    """The files of a folder, one row a file, paths that differ in case only once: ``(path, length, content)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.withColumn("__k", F.lower("path")).dropDuplicates(["__k"]).drop("__k", "modificationTime")


def with_status(files: DataFrame) -> DataFrame:
    """Files with their kind and whether they are taken: unknown kinds and notation by name are SKIP."""
    name = at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    skip = F.when(~kind.isin("docx", "pdf", "txt", "cho"), "unknown kind").when(F.lower(name).contains("noten"), "notation by name")
    return files.withColumn("kind", kind).withColumn("message", skip).withColumn("status", F.when(skip.isNull(), "OK").otherwise("SKIP"))


def text_documents(files: DataFrame) -> DataFrame:
    """Text files decoded as UTF-8, byte-order mark and foreign line ends removed: ``(path, text)``."""
    text = F.decode("content", "UTF-8")
    return files.select("path", F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n").alias("text"))


def paragraphs(content: bytes) -> list[tuple[str, list[str], bool]]:
    """Top-level paragraphs of a DOCX: text with tabs, its runs, whether it holds an image."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        runs = []
        for r in p.iter(f"{_W}r"):
            runs.append("".join("\t" if x.tag == f"{_W}tab" else x.text or "" for x in r if x.tag in (f"{_W}t", f"{_W}tab")))
        image = any(x.tag.rsplit("}", 1)[-1] in ("drawing", "pict") for x in p.iter())
        out.append(("".join(runs), runs, image))
    return out


def docx_lines(files: DataFrame) -> DataFrame:
    """Paragraphs of DOCX files as rows of PARAGRAPHS; an unreadable file is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    got = [(path, i, t, r, im, None) for i, (t, r, im) in enumerate(paragraphs(content.as_py() or b""))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError) as e:
                    got = [(path, 0, "", [], False, f"{type(e).__name__}: {e}")]
                if got:
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], ["path", "line_no", "text", "runs", "has_image", "error"])

    return files.select("path", "content").mapInArrow(run, PARAGRAPHS)


def images(content: bytes) -> list[tuple[str, bytes]]:
    """Images that a DOCX embeds, in order of use, each relationship once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        rels = "word/_rels/document.xml.rels"
        targets = {x.get("Id", "").lower(): x.get("Target", "") for x in ElementTree.fromstring(z.read(rels))} if rels in names else {}
        used = [x.get(f"{_R}embed") or x.get(f"{_R}id") for x in ElementTree.fromstring(z.read("word/document.xml")).iter() if x.tag in (f"{_A}blip", f"{_V}imagedata")]
        out = []
        for rel in dict.fromkeys(u.lower() for u in used if u):
            name = "word/" + targets.get(rel, "").lstrip("/")
            if name in names:
                out.append((name, z.read(name)))
    return out


def docx_images(files: DataFrame) -> DataFrame:
    """Embedded images as rows of IMAGES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    got = images(content.as_py() or b"")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError):
                    continue
                for i, (name, data) in enumerate(got):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i], pa.int32()), pa.array([name]), pa.array([data], pa.binary())], ["path", "image_no", "name", "content"])

    return files.select("path", "content").mapInArrow(run, IMAGES)


def images_only(lines: DataFrame) -> DataFrame:
    """Documents whose paragraphs hold images and no text: ``(path, images_only)``."""
    return lines.groupBy("path").agg((F.bool_or("has_image") & ~F.bool_or(F.trim("text") != "")).alias("images_only"))


def reference_lines(lines: DataFrame) -> DataFrame:
    """The chorded lines of a reference document."""
    return lines.filter(F.col("line").startswith("["))


def reference_labels(lines: DataFrame) -> DataFrame:
    """The first comment label of each section: ``(doc_id, section, label)``."""
    from ..functions.sections import directive, parse_label

    label = directive(F.col("line"), "comment")
    rows = lines.withColumn("label", label).filter("label is not null").withColumn("section", parse_label(F.col("label"))["section"])
    return rows.filter("section is not null").groupBy("doc_id", "section").agg(F.min_by("label", "line_no").alias("label"))


def reference_sections(lines: DataFrame) -> DataFrame:
    """The lines of the first occurrence of each labelled section: ``(doc_id, section, line_no, line)``."""
    from ..functions.sections import directive
    from ..functions.text import is_blank
    from ..operators.sequence import DOC, Window, so_far

    label = F.lower(directive(F.col("line"), "comment"))
    rows = lines.withColumn("__l", label).withColumn("__seg", F.sum((F.col("__l").isNotNull() | is_blank(F.col("line"))).cast("int")).over(so_far()))
    rows = rows.withColumn("section", F.max("__l").over(Window.partitionBy(DOC, "__seg"))).filter("section is not null and __l is null")
    first = F.min("__seg").over(Window.partitionBy(DOC, "section"))
    return rows.withColumn("__first", first).filter("__seg = __first").select(DOC, "section", "line_no", "line")


def dump_sections(lines: DataFrame) -> DataFrame:
    """A processed dump as a chord document: section names become comments, the lines after them stay."""
    from ..functions.sections import prefix_section

    section = prefix_section(F.col("line"))
    return lines.withColumn("line", F.when(section.isNotNull(), F.concat(F.lit("{comment: "), section, F.lit("}"))).otherwise(F.col("line")))


def write_documents(documents: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """``(doc_id or path, text)`` as Parquet, the scalable form of one file a document."""
    documents.write.mode(mode).parquet(folder)


def write_text_files(documents: DataFrame, folder: str, name: str = "path", suffix: str = ".converted.cho") -> DataFrame:
    """Each document as one UTF-8 text file with a byte-order mark under ``folder``, by the executors; ``folder`` must be shared.

    Returns ``(path, written)``.  Existing files are replaced.
    """
    from ..functions.text import file_name

    rows = documents.select(F.concat(file_name(at(F.split(F.col(name).cast("string"), "/"), -1)), F.lit(suffix)).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            done = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = os.path.join(folder, path)
                with open(f"{target}.part", "w", encoding="utf-8-sig", newline="\n") as f:
                    f.write(text)
                os.replace(f"{target}.part", target)
                done.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array([True] * len(done))], ["path", "written"])

    return rows.mapInArrow(run, "path string, written boolean")


def plain_name(path: str) -> str:
    """A path's file name without its last extension."""
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def docx_media(files: DataFrame) -> DataFrame:
    """Raster images under ``word/media``: ``(path, name, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        got = [(n, z.read(n)) for n in z.namelist() if re.match(r"(?i)word/media/.*\.(png|jpe?g|bmp|pgm|ppm)$", n)]
                except zipfile.BadZipFile:
                    continue
                for name, data in got:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([data], pa.binary())], ["path", "name", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary")
