"""Files to documents and chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.config import SOURCE_TYPES, Settings
from sievewright.functions.vectors import Embedder, HashingEmbedder, embedded
from sievewright.sources import parsers

FILES = "filename string, content binary, source_path string"
_PARSED = (
    "document_id string, filename string, source_type string, content_hash string, text string, title string, metadata map<string,string>, error string, "
    "chunks array<struct<chunk_index: int, text: string, search_text: string, token_count: int, char_start: int, char_end: int, metadata: map<string,string>>>"
)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` of the supported types: ``filename, content, source_path``."""
    pattern = "*.{" + ",".join(sorted(s[1:] for s in SOURCE_TYPES)) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("path").alias("source_path"))


def from_bytes(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """Uploaded files; only the last part of a name counts."""
    return spark.createDataFrame([(name.rsplit("/", 1)[-1], bytearray(data), None) for name, data in files], FILES)


def source_type(filename):
    """The source type of a file name column; null for unsupported ones."""
    table = F.create_map(*(F.lit(x) for pair in SOURCE_TYPES.items() for x in pair))
    return F.element_at(table, F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1)))


def document_id(filename, content_hash):
    """The same id for the same name and content, always."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(filename, F.char(F.lit(0)), content_hash), 256), 1, 16))


def _as_map(metadata: dict) -> dict[str, str]:
    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in metadata.items()}


def parsed(files: DataFrame, s: Settings = Settings(), read_pdf: parsers.PdfReader = parsers.read_pdf) -> DataFrame:
    """One row per file with its text and chunks, or an ``error``; errors end no job.

    Empty files and files beyond the size limit are errors that are never read.
    """
    size = F.octet_length("content")
    reason = F.when(F.coalesce(size, F.lit(0)) == 0, "empty file").when(size > s.max_upload_bytes, "file too large").when(source_type(F.col("filename")).isNull(), "unsupported file type")
    rows = files.select("filename", "content", F.sha2("content", 256).alias("content_hash"), reason.alias("error"))
    rows = rows.withColumn("document_id", document_id(F.col("filename"), F.col("content_hash"))).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                row = [r.document_id, r.filename, None, r.content_hash, None, None, None, r.error, None]
                if r.error is None:
                    try:
                        doc = parsers.parse(r.filename, bytes(r.content), read_pdf)
                        chunks = [(c.index, c.text, c.search_text, c.tokens, c.start, c.end, _as_map(c.metadata)) for c in parsers.chunks_of(doc, s.chunking)]
                        row = [r.document_id, r.filename, doc.source_type, r.content_hash, doc.text, doc.title, _as_map(doc.metadata), None, chunks]
                    except parsers.ParseError as e:
                        row[7] = str(e)
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ("document_id filename source_type content_hash text title metadata error chunks").split()])

    return rows.select("document_id", "filename", "content_hash", "content", "error").mapInPandas(run, _PARSED)


def documents_of(rows: DataFrame) -> DataFrame:
    good = rows.where("error is null").dropDuplicates(["filename", "content_hash"])
    return good.select("document_id", "filename", "source_type", "content_hash", F.current_timestamp().alias("created_at"), "text", "title", "metadata", F.size("chunks").alias("chunk_count"))


def chunks_of(rows: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with ids by their order, and embeddings of their search text."""
    good = rows.where("error is null").dropDuplicates(["filename", "content_hash"])
    flat = good.select("document_id", F.inline("chunks"))
    out = flat.withColumn("chunk_id", F.concat("document_id", F.format_string(":%04d", "chunk_index")))
    return out.withColumn("embedding", embedded(embedder or HashingEmbedder(), F.col("search_text")))


def without_known(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose name and content the documents do not have yet."""
    return rows.join(documents.select("filename", "content_hash"), ["filename", "content_hash"], "left_anti")


def plain_chunks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of plain texts as chunks, one each: ``chunk_id, document_id, text, search_text, metadata``."""
    own = F.col(id_col)
    return documents.select(own.alias("chunk_id"), own.alias("document_id"), F.col(text_col).alias("text"), F.col(text_col).alias("search_text"), F.create_map().cast("map<string,string>").alias("metadata"))
