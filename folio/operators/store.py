"""Collections of documents with vectors, as Parquet tables under one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import is_blank
from folio.operators import search
from folio.operators.models import embedder
from folio.storage import drop, written


@dataclass(frozen=True)
class BatchConfig:
    """Write settings after clamping to what is allowed."""

    batch_size: int = 100
    max_batch_size: int = 1000
    embedding_batch_size: int = 32
    retries: int = 3

    def clamped(self) -> BatchConfig:
        top = max(1, self.max_batch_size)
        return BatchConfig(min(max(1, self.batch_size), top), top, max(1, self.embedding_batch_size), max(0, self.retries))


def resolve_name(collection: str | None = None, namespace: str | None = None, default: str = "documents") -> str:
    """Collection before namespace before the store's default."""
    return collection or namespace or default


def assign_ids(docs: DataFrame, content: str = "page_content") -> DataFrame:
    """``id``: the given one where it is not empty, else a hash of the content, so that a retry writes the same row."""
    given = F.col("id") if "id" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("id", F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(F.sha2(F.col(content), 256)))


def payloads(docs: DataFrame, content: str = "page_content", metadata: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``payload``: content and metadata columns as one JSON object with typed values; nulls are left out."""
    return docs.withColumn("payload", F.to_json(F.struct(F.col(content).alias("page_content"), *metadata)))


def documents(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with ``page_content`` and ``metadata`` (a map of the other values, lists as JSON) of a payload."""
    v = F.try_parse_json(F.col(payload))
    rest = F.map_filter(v.try_cast("map<string,variant>"), lambda k, x: k != "page_content")
    text = lambda k, x: F.coalesce(x.try_cast("string"), F.to_json(x))
    return rows.withColumn("page_content", F.try_variant_get(v, "$.page_content", "string")).withColumn("metadata", F.transform_values(rest, text))


class Store:
    """Named collections. A change writes what it adds and the ids it takes away beside the versions before it.

    Reading lays the versions over each other; once there are ``most`` of them
    they are merged into one. Merged versions stay until the next merge, so that
    readers which began before can end.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[Column], Column] | None = None, default: str = "documents", most: int = 8, connect: Callable | None = None, config: BatchConfig | None = None):
        """``embed`` is a column function; in its place, ``connect`` gives a batch call, used with the sizes and retries of ``config``."""
        self.spark, self.root, self.default, self.most = spark, root.rstrip("/"), default, most
        own = (config or BatchConfig()).clamped()
        self.embed = embed if embed or connect is None else embedder(connect, batch=own.embedding_batch_size, retries=own.retries)

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        root = path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()) if fs.exists(root) else []

    def collections(self) -> list[str]:
        return self._names(self.root)

    def exists(self, name: str) -> bool:
        return name in self.collections()

    def _versions(self, name: str) -> list[str]:
        """Finished versions, from the last merged one (``m``) on; others (``v``) are laid over it in order."""
        fs, path = self._fs()
        done = [v for v in self._names(f"{self.root}/{name}") if fs.exists(path(f"{self.root}/{name}/{v}/rows/_SUCCESS"))]
        order = sorted(done, key=lambda v: v[1:])
        merged = [k for k, v in enumerate(order) if v.startswith("m")]
        return order[merged[-1] :] if merged else order

    def drop(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/{name}"), True)

    def _part(self, name: str, version: str, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{version}/{part}")

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name) if self.exists(name) else []
        if not versions:
            raise KeyError(f"no collection {name}")
        out = self._part(name, versions[0], "rows")
        for version in versions[1:]:
            out = out.join(self._part(name, version, "gone"), "id", "left_anti").unionByName(self._part(name, version, "rows"), allowMissingColumns=True)
        return out

    def _write(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> str:
        """A new version: rows to add, and ids of which earlier versions' rows count no more."""
        fs, path = self._fs()
        every = self._names(f"{self.root}/{name}")
        number = max((int(v[1:].split("-")[0]) for v in every), default=-1) + 1
        version = f"{'v' if gone is not None else 'm'}{number:08d}-{uuid.uuid4().hex[:8]}"
        if gone is not None:
            gone.select("id").write.parquet(f"{self.root}/{name}/{version}/gone")
        rows.write.parquet(f"{self.root}/{name}/{version}/rows")  # last: its mark makes the version count
        if gone is None and every:  # merged: what the merge before this one had replaced goes
            last = max((int(v[1:].split("-")[0]) for v in every if v.startswith("m")), default=0)
            for old in every:
                if int(old[1:].split("-")[0]) < last:
                    fs.delete(path(f"{self.root}/{name}/{old}"), True)
        return version

    def _merge(self, name: str) -> None:
        if len(self._versions(name)) > self.most:
            self._write(name, self.read(name))

    def add(self, docs: DataFrame, collection: str | None = None, namespace: str | None = None) -> DataFrame:
        """Upserts documents by id and returns one row: how many were given, blank, and written (an id that repeats is written once)."""
        name = resolve_name(collection, namespace, self.default)
        seen = Observation()
        given = docs.observe(seen, F.count(F.lit(1)).alias("given"), F.count_if(is_blank("page_content")).alias("blank"))
        some = assign_ids(given.where(~is_blank("page_content"))).dropDuplicates(["id"])
        if "vector" not in some.columns:
            if self.embed is None:
                raise ValueError("documents need vectors or the store an embedder")
            some = some.withColumn("vector", self.embed(F.col("page_content")))
        if old := (self._versions(name) if self.exists(name) else []):
            size = self.read(name).select(F.size("vector").alias("d")).first()
            some = some.withColumn("vector", F.when(F.size("vector") == size["d"], F.col("vector")).otherwise(F.raise_error(F.lit("vector dimension differs from the collection's")))) if size else some
        rows = written(some, "upsert")
        self._write(name, rows, rows.select("id") if old else None)
        count = rows.count()
        drop(rows)
        self._merge(name)
        return self.spark.createDataFrame([(seen.get["given"], seen.get["blank"], count)], "given long, blank long, written long")

    def similar(self, queries: DataFrame, k: int, collection: str | None = None, threshold: float = 0.0, filters: Mapping[str, object] | None = None) -> DataFrame:
        """Top-k of each query row (query_id, query_vector), filters applied."""
        return search.top_k(self.read(resolve_name(collection, None, self.default)), queries, k, threshold, filters, "id", "vector")

    def retriever(self, k: int, collection: str | None = None, **options) -> Callable[[DataFrame], DataFrame]:
        """A function from query rows to their top-k documents, with k and the options fixed."""
        return lambda queries: self.similar(queries, k, collection, **options)

    def delete(self, ids: DataFrame, collection: str | None = None) -> None:
        name = resolve_name(collection, None, self.default)
        self._write(name, self.read(name).limit(0), ids.where("id is not null").select("id").distinct())
        self._merge(name)

    def delete_where(self, filters: Mapping[str, object], collection: str | None = None) -> None:
        name = resolve_name(collection, None, self.default)
        rows = self.read(name)
        self.delete(rows.join(search.delete_by_filter(rows, filters).select("id"), "id", "left_anti").select("id"), name)
