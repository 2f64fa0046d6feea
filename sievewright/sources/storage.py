"""Tables of the engine as Parquet folders under one manifest.

A table is a list of folders.  The manifest names the folders of all tables; a
write adds folders and then a new manifest, so that readers see all of a change,
over however many tables, or none of it.  Appending writes the new rows alone.
Folders that no kept manifest and no snapshot names go when ``vacuum`` is
called; until then whoever reads an older state can go on.  Folders and
manifests are reached through Hadoop's file systems alone.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.sources.shared import stored

SCHEMAS = {
    "documents": "document_id string, filename string, source_type string, content_hash string, created_at timestamp, text string, title string, metadata map<string,string>, chunk_count int",
    "chunks": "chunk_id string, document_id string, chunk_index int, text string, search_text string, token_count int, char_start int, char_end int, metadata map<string,string>, embedding array<float>",
    "mentions": "mention_id string, chunk_id string, document_id string, surface string, entity_type string, char_start int, char_end int, extractor string, confidence double, entity_id string",
    "entities": "entity_id string, canonical_name string, entity_type string, aliases array<string>, mention_count long, document_count long, surface_groups long",
    "relationships": "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, supporting_chunk_id string, evidence string, method string",
    "decisions": "left string, right string, entity_type string, score double, decision string, features map<string,double>, reason string",
    "edges": "src string, dst string, weight double, relation_types array<string>, n_chunks long",
    "alias_index": "entity_id string, index string, key string",
    "postings": "chunk_id string, term string, tf long, dl long",
    "term_stats": "term string, df long",
    "corpus_stats": "n_docs long, avgdl double",
}


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a table in the shared folder."""
    return stored(df, "cut")


class TableStore:
    """Named tables below one folder; absent tables are empty."""

    #: Parts of a table from which an append binds them into one.
    MAX_PARTS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _load(self, name: str) -> dict[str, list[str]]:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, name: str, tables: dict[str, list[str]]) -> bool:
        """Whether the file is new and now there, whole."""
        target, draft = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        stream.close()
        self._fs.mkdirs(target.getParent())
        return not self._fs.exists(target) and self._fs.rename(draft, target)

    def _manifests(self) -> list[str]:
        return [n for n in self._names("_manifests") if n.endswith(".json")]

    def tables(self) -> dict[str, list[str]]:
        """The folders of every table, as of now."""
        found = self._manifests()
        return self._load(f"_manifests/{found[-1]}") if found else {}

    def _commit(self, change) -> None:
        """A new manifest with ``change`` made to the newest; again if another writer was faster."""
        while True:
            found = self._manifests()
            number = int(found[-1].split(".")[0]) + 1 if found else 1
            if self._save(f"_manifests/{number:010d}.json", change(self.tables() if found else {})):
                return

    def _write(self, name: str, df: DataFrame) -> str:
        if name in SCHEMAS:
            df = df.select(*(F.col(f.split(" ")[0]).cast(f.split(" ", 1)[1]) for f in SCHEMAS[name].split(", ")))
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    # Tables

    def exists(self, name: str) -> bool:
        return bool(self.tables().get(name))

    def read(self, name: str) -> DataFrame:
        parts = [f"{self.root}/{p}" for p in self.tables().get(name, [])]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*parts) if name in SCHEMAS else self.spark.read.parquet(*parts)

    def replace_all(self, frames: dict[str, DataFrame]) -> None:
        """All of ``frames`` as the new state of their tables, in one step."""
        new = {name: [self._write(name, df)] for name, df in frames.items()}
        self._commit(lambda tables: tables | new)

    def replace(self, name: str, df: DataFrame) -> None:
        self.replace_all({name: df})

    def append_all(self, frames: dict[str, DataFrame]) -> None:
        """The rows of ``frames`` behind those of their tables, in one step; what is there is not written again."""
        new = {name: self._write(name, df) for name, df in frames.items()}
        self._commit(lambda tables: tables | {name: [*tables.get(name, []), part] for name, part in new.items()})
        for name in new:
            if len(self.tables()[name]) > self.MAX_PARTS:
                self.compact(name)

    def append(self, name: str, df: DataFrame) -> None:
        self.append_all({name: df})

    def compact(self, name: str) -> None:
        """The table's parts bound into one; parts that come meanwhile stay as they are."""
        old = self.tables().get(name, [])
        if len(old) > 1:
            one = self._write(name, self.read(name))
            self._commit(lambda tables: tables | {name: [one, *(p for p in tables[name] if p not in old)]})

    def delete(self, name: str, keys: DataFrame, on: str) -> None:
        """Without the rows whose ``on`` is among ``keys``."""
        self.replace(name, self.read(name).join(keys.select(on).distinct(), on, "left_anti"))

    def delete_documents(self, keys: DataFrame) -> None:
        """Documents with all that hangs on them (chunks, mentions, relationships, postings), in one step."""
        keys = cut(keys.select("document_id").distinct())  # they may come from the tables that change here
        chunks = cut(self.read("chunks").join(keys, "document_id", "left_semi").select("chunk_id"))
        left = {name: self.read(name).join(keys, "document_id", "left_anti") for name in ("documents", "mentions", "chunks") if self.exists(name)}
        if self.exists("relationships"):
            left["relationships"] = self.read("relationships").join(chunks, F.col("supporting_chunk_id") == F.col("chunk_id"), "left_anti")
        if self.exists("postings"):
            left["postings"] = self.read("postings").join(chunks, "chunk_id", "left_anti")
        self.replace_all(left)

    def reset(self) -> None:
        """All tables empty."""
        self._commit(lambda _: {})

    # States

    def snapshot(self, label: str) -> None:
        """The state as of now under a name; no data is written."""
        if not self._save(f"_snapshots/{label}.json", self.tables()):
            raise ValueError(f"there is a snapshot {label!r}")

    def restore(self, label: str) -> None:
        """The state of a snapshot as the newest."""
        state = self._load(f"_snapshots/{label}.json")
        self._commit(lambda _: state)

    def vacuum(self, keep: int = 1) -> None:
        """Removes folders that the last ``keep`` manifests and all snapshots do not name, and the older manifests."""
        found = self._manifests()
        states = [f"_manifests/{n}" for n in found[-keep:]] + [f"_snapshots/{n}" for n in self._names("_snapshots")]
        used = {p for state in states for parts in self._load(state).values() for p in parts}
        for table in (n for n in self._names("") if not n.startswith("_")):
            for part in self._names(table):
                if f"{table}/{part}" not in used:
                    self._fs.delete(self._path(f"{self.root}/{table}/{part}"), True)
        for name in found[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{name}"), False)

    def counts(self) -> DataFrame:
        """Rows of every table: ``name, n``."""
        return counted({name: self.read(name) for name in ("documents", "chunks", "mentions", "entities", "relationships")})


def counted(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of every frame: ``name, n``."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in frames.items()))
