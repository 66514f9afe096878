"""Files of a reading site as DataFrames, and DataFrames as such files."""

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import chunk_name

CHAPTER = "struct<number:int,title:string,paragraphs:array<string>,lazy:boolean,removedDuplicate:boolean>"
CATALOG = (
    "struct<id:string,title:string,author:string,genre:string,status:string,tags:array<string>,updated:date,synopsis:string,"
    f"lazyChunks:struct<prefix:string,capacity:int,global:string,numberFromTitle:boolean>,chapters:array<{CHAPTER}>>"
)


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, title, paragraphs, ...) of script files that append one JSON array of chapters."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    body = F.regexp_extract("value", r"(?s)\.concat\((\[.*\])\)\s*;?\s*$", 1)
    return files.select("file", F.inline(F.from_json(body, f"array<{CHAPTER}>")))


def catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per catalog object of script files ``... .push({...});`` or of plain JSON objects."""
    files = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)(\{.*\})", 1)
    return files.select(F.from_json(body, CATALOG).alias("c")).where("c.id IS NOT NULL").select("c.*")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of files, from their listing; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def chunk_texts(chapters: DataFrame, name: Column) -> DataFrame:
    """(novel_id, file, text): the chunk files of chapters with a ``chunk`` column, each of bounded capacity.

    ``chapters`` has novel_id, chapter_number, title, paragraphs (an array), chunk and prefix.
    """
    one = F.struct(F.col("chapter_number").alias("number"), "title", "paragraphs")
    grouped = chapters.groupBy("novel_id", "prefix", "chunk").agg(F.array_sort(F.collect_list(one)).alias("all"))
    json = F.replace(F.to_json("all"), F.lit("<"), F.lit("\\u003c"))
    text = F.concat(F.lit("window."), name, F.lit("=(window."), name, F.lit("||[]).concat("), json, F.lit(");\n"))
    return grouped.select("novel_id", chunk_name(F.col("prefix"), F.col("chunk")).alias("file"), text.alias("text"))


def write_chapters(chapters: DataFrame, path: str, files_per_novel: int = 16) -> None:
    """Chapters as Parquet by novel, sorted by number, so that a range of one novel reads few row groups.

    The rows of a novel are spread over up to ``files_per_novel`` tasks, so a novel may hold any share of them.
    """
    spread = F.pmod(F.floor(F.col("chapter_number") / 100), F.lit(files_per_novel))
    chapters.repartition(F.col("novel_id"), spread).sortWithinPartitions("novel_id", "chapter_number").write.mode("overwrite").partitionBy(
        "novel_id"
    ).parquet(path)


def upsert_statements(chapters: DataFrame, most_bytes: int = 95_000) -> DataFrame:
    """(novel_id, chapter_number, statement, fits): SQL text that stores a chapter, the last write wins."""

    def quoted(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))

    values = F.concat_ws(", ", quoted(F.col("novel_id")), F.col("chapter_number").cast("string"), quoted(F.col("title")), quoted(F.col("paragraphs_json")))
    statement = F.concat(
        F.lit("INSERT INTO chapters (novel_id, chapter_number, title, paragraphs_json) VALUES ("),
        values,
        F.lit(") ON CONFLICT (novel_id, chapter_number) DO UPDATE SET title = excluded.title, paragraphs_json = excluded.paragraphs_json;"),
    )
    return chapters.select("novel_id", "chapter_number", statement.alias("statement"), (F.octet_length(statement) <= most_bytes).alias("fits"))


def sitemap_pages(urls: DataFrame, url: str, per_page: int = 40_000) -> DataFrame:
    """``urls`` with the sitemap file of each: distinct URLs spread evenly by hash over as many files as are needed."""
    distinct = urls.select(url).distinct()
    # 10 % of room for the unevenness of the hash.
    pages = F.ceil(F.lit(max(1, distinct.count())) / F.lit(per_page * 0.9))
    return distinct.select(url, (F.pmod(F.xxhash64(url), pages) + 1).cast("int").alias("sitemap"))


def snapshot_name(content: Column, stem: str) -> Column:
    """A file name that holds the first 16 digits of the content's SHA-256, so that snapshots are never overwritten."""
    return F.concat(F.lit(f"{stem}."), F.substring(F.sha2(content, 256), 1, 16), F.lit(".json"))


_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}


def _documents(content: bytes) -> Iterator[tuple[int, str, str, str]]:
    """(position, path, book title, HTML) of the spine of an EPUB; parts that are missing are passed over."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        package = ElementTree.fromstring(book.read("META-INF/container.xml")).find(".//c:rootfile", _NS).get("full-path")
        root = ElementTree.fromstring(book.read(package))
        title = root.findtext(".//d:title", default="", namespaces=_NS)
        paths = {x.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), x.get("href"))) for x in root.iterfind(".//o:manifest/o:item", _NS)}
        for k, x in enumerate(root.iterfind(".//o:spine/o:itemref", _NS)):
            path = paths.get(x.get("idref"))
            if path in names:
                yield k, path, title, book.read(path).decode("utf-8", "replace")


def _books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                rows = [(path, *x, None) for x in _documents(content)]
            except (KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as problem:
                rows = [(path, None, None, None, None, type(problem).__name__)]
            yield pd.DataFrame(rows, columns=["book", "position", "path", "title", "html", "problem"]).astype({"position": "Int64"})


def epub_documents(spark: SparkSession, path: str) -> DataFrame:
    """(book, position, path, title, html, problem): the documents of EPUB files in reading order; a broken file gives its problem."""
    schema = "book string, position long, path string, title string, html string, problem string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_books, schema)
