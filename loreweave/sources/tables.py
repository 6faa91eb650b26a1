"""Reading and writing: Parquet tables, whole files, line text, CSV; keyed upserts and deletes on Parquet."""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """filename, size, last_modified; the contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def file_exists(listing: DataFrame, names: DataFrame) -> DataFrame:
    return names.join(listing.select("filename"), "filename", "left_semi")


def file_size(listing: DataFrame, filename: str) -> DataFrame:
    return listing.where(F.col("filename") == filename).agg(F.coalesce(F.max("size"), F.lit(0)).alias("size"))


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """filename, mime, file_hash and content."""
    df = spark.read.format("binaryFile").load(folder).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return df.select("filename", T.mime(F.col("filename")).alias("mime"), T.file_hash(F.col("content"), F.col("length")).alias("file_hash"), "content")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files with their section title, period and table flag; HTML without its tags."""
    df = spark.read.text(folder, wholetext=True).withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1))
    plain = F.when(F.lower("filename").rlike(r"\.html?$"), html_text(F.col("value"))).otherwise(F.col("value"))
    return df.select("filename", plain.alias("text")).withColumn("section", T.section(F.col("text"))).withColumn("period", T.period(F.col("section"))).withColumn("type", F.when(T.is_markdown_table(F.col("text")), "table").otherwise("text"))


def docx_text(content: Column) -> Column:
    """Text of a docx file: paragraphs by empty lines, headings as markdown, tables as markdown rows; null where it is no such file."""

    def row(tr) -> str:
        return "| " + " | ".join(" ".join(t.text or "" for t in cell.iter(f"{WORD}t")).strip() for cell in tr.iter(f"{WORD}tc")) + " |"

    def of(raw: bytes) -> str | None:
        try:
            body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{WORD}body")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        parts = []
        for x in body if body is not None else ():
            if x.tag == f"{WORD}tbl":
                rows = [row(tr) for tr in x.iter(f"{WORD}tr")]
                parts.append("\n".join([*rows[:1], re.sub(r"[^|]+", " --- ", rows[0]) if rows else "", *rows[1:]]))
            elif x.tag == f"{WORD}p":
                style = next((s.get(f"{WORD}val", "") for s in x.iter(f"{WORD}pStyle")), "")
                text = "".join("\f" if t.tag == f"{WORD}br" and t.get(f"{WORD}type") == "page" else t.text or "" for t in x.iter() if t.tag in (f"{WORD}t", f"{WORD}br"))
                level = re.fullmatch(r"(?:Heading|Title)(\d?)", style)
                parts.append(("#" * min(3, int(level[1] or 1)) + " " if level and text.strip() else "") + text)
        return "\n\n".join(p for p in parts if p.strip())

    @F.arrow_udf("string")
    def run(files: pa.Array) -> pa.Array:
        return pa.array([None if f is None else of(f) for f in files.to_pylist()], pa.string())

    return run(content)


def html_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)<(?:/p|/div|/h[1-6]|br)\b[^>]*>", "\n\n"), r"<[^>]+>", " "))


def parse_files(blobs: DataFrame, pdf: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of files (filename, content): docx, txt, md and html by title, then by meaning; of a PDF, the pages of a parser.

    ``pdf`` is the boundary to that parser: from the bytes to an array of
    struct<page: string, text: string>. Without one, PDF files give nothing.
    """
    kind = T.extension(F.col("filename"))
    text = F.when(kind == ".docx", docx_text(F.when(kind == ".docx", F.col("content")))).when(kind.isin(".html", ".htm"), html_text(F.col("content").cast("string"))).when(kind.isin(".txt", ".md"), F.col("content").cast("string"))
    plain = C.semantic_chunks(C.title_chunks(blobs.select(F.col("filename").alias("source"), text.alias("text")).where("text IS NOT NULL")))
    out = plain.select("source", "chunk_id", "section", "period", "type", "page", "page_end", "page_range", "text")
    if pdf is None:
        return out
    pages = blobs.where(kind == ".pdf").select(F.col("filename").alias("source"), F.posexplode(pdf(F.col("content"))).alias("i", "p"))
    made = C.page_rows(pages.select("source", "i", F.col("p.page").alias("label"), F.col("p.text").alias("text")), F.col("label"), F.col("text"))
    return out.unionByName(made.select("source", F.col("i").cast("string").alias("chunk_id"), "section", "period", "type", "page", F.col("page").alias("page_end"), F.col("page").cast("string").alias("page_range"), "text"))


def uncached(blobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content isn't in the parse cache (column file_hash)."""
    return blobs.join(cache.select("file_hash").distinct(), "file_hash", "left_anti")


def add_to_cache(parsed: DataFrame, path: str) -> None:
    """Chunks with their file_hash, a folder for each; the same content again replaces its own folder only."""
    parsed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_hash").parquet(path)


def write_blobs(files: DataFrame, path: str) -> None:
    """Files (filename, content) with their MIME type as rows, a folder for each name: the same name again replaces the file."""
    rows = files.select("filename", T.mime(F.col("filename")).alias("mime"), F.length("content").cast("long").alias("size"), "content")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filename").parquet(path)


def read_blob(spark: SparkSession, path: str, filename: str) -> DataFrame:
    """One stored file with the headers it is sent with; only its folder is read."""
    return spark.read.parquet(path).where(F.col("filename") == filename).select("filename", "mime", F.concat(F.lit('inline; filename="'), "filename", F.lit('"')).alias("disposition"), "content")


def check_vectors(points: DataFrame, dims: int, columns: tuple[str, ...] = ("point_id", "source", "embedding")) -> None:
    """Refuses a table of points without the needed columns, or with a vector of another length."""
    lacking = [c for c in columns if c not in points.columns]
    if lacking:
        raise ValueError(f"the table of points has no column {', '.join(lacking)}")
    wrong = points.where(F.size("embedding") != dims).agg(F.count("*")).first()[0]
    if wrong:
        raise ValueError(f"{wrong} vectors haven't {dims} dimensions")


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A copy of each table in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def wipe(spark: SparkSession, path: str) -> None:
    """Leaves a table without rows."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


class Cached:
    """A result that is worked out again once it is older than ``seconds``, or after ``invalidate``."""

    def __init__(self, make: Callable[[], DataFrame], seconds: float = 30, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self.held: DataFrame | None = None
        self.until = 0.0

    def get(self) -> DataFrame:
        if self.held is None or self.clock() >= self.until:
            self.invalidate()
            self.held, self.until = self.make().cache(), self.clock() + self.seconds
        return self.held

    def invalidate(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.held = None


def upsert(current: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Current rows whose key isn't in the new ones, and the new ones, each key once: the last by ``order``, else by all its columns."""
    rows = F.struct(*[F.col(order)] if order else [], *[F.col(c) for c in new.columns])
    last = new.groupBy(key).agg(F.max(rows).alias("__r")).select(*[F.col(f"__r.{c}").alias(c) for c in new.columns])
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(last)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_points(df: DataFrame, path: str) -> None:
    """One row for each point_id, a folder for each source, so that a source can be replaced or dropped."""
    df.dropDuplicates(["point_id"]).write.mode("overwrite").partitionBy("source").parquet(path)
