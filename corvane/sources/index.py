"""A persistent vector index: Parquet vectors by load and cell, a manifest of the loads, centroids, a one-row configuration.

An ``add`` writes its vectors once, in a folder of its own, and then a new version of the manifest; what is stored already is not read.
``compact`` writes small loads together and lets a version of the manifest put the new folder in their place.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corvane.functions import vectors as V
from corvane.functions.matrix import to_matrix
from corvane.operators.clustering import ivf_train
from corvane.operators.search import attach_metadata, ivf_assign, ivf_search, topk_ann, topk_exact, topk_labelled
from corvane.runtime import MAX_BROADCAST_CELLS, checkpoint
from corvane.sources.manifest import Ingest, Load, Manifest, Versions

INDEX_TYPES = ("Flat", "IVF", "HNSW")
# monotonically_increasing_id keeps the partition above these bits.
_ROW_BITS = 33
# Loads of about the same size (within this factor) are written together when there are so many of them.
TIER_FACTOR, TIER_LOADS = 4, 8


@dataclass
class IndexConfig:
    embedding_dim: int = 768
    index_type: str = "Flat"
    nlist: int = 100
    nprobe: int = 10

    def __post_init__(self):
        if self.index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {self.index_type!r}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class VectorIndex:
    """Vectors (row_id, vec_id, embedding, metadata..., ingest, cell) under ``path``.

    Every stored row has a ``row_id`` of its own: the same ``vec_id`` may be added again, and then is found
    again, with its own record.  "Flat" ranks everything, "IVF" the best ``nprobe`` cells, "HNSW" is served by hashed buckets.
    Nothing is de-duplicated, updated or deleted.  ``load`` takes the stored configuration.
    """

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig | None = None, metadata: str = ""):
        self.spark, self.path = spark, path.rstrip("/")
        self.config = config or IndexConfig()
        fields = T._parse_datatype_string(metadata) if metadata else T.StructType()
        self.schema = T.StructType(
            [T.StructField("row_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
            + fields.fields
            + [T.StructField("ingest", T.StringType()), T.StructField("cell", T.IntegerType())]
        )
        self.versions = Versions(spark, f"{self.path}/manifest")

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: IndexConfig | None = None, metadata: str = "") -> VectorIndex:
        """A new, empty index; ``metadata`` is the DDL of the stored record columns."""
        index = cls(spark, path, config, metadata)
        row = {**asdict(index.config), "metadata": metadata}
        spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{index.path}/config")
        index.clear()
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: IndexConfig | None = None) -> VectorIndex:
        """The stored configuration wins over the ``config`` passed in."""
        schema = "embedding_dim int, index_type string, nlist int, nprobe int, metadata string"
        row = spark.read.schema(schema).json(f"{path.rstrip('/')}/config").first().asDict()
        metadata = row.pop("metadata") or ""
        return cls(spark, path, IndexConfig(**row), metadata)

    def _folder(self, load: str) -> str:
        return f"{self.path}/vectors/load={load}"

    def _read(self, manifest: Manifest, loads: list[str]) -> DataFrame:
        """The rows of some loads, with their final numbers."""
        if not loads:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("load", T.StringType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/vectors").parquet(*map(self._folder, loads))
        for load in loads:
            if manifest.loads[load].dropped:
                rows = rows.where((F.col("load") != load) | ~F.col("ingest").isin(manifest.loads[load].dropped))
        offsets = [(load, int(part), first) for load in loads for part, first in manifest.loads[load].offsets.items()]
        if offsets:  # one small row for every partition that wrote
            parts = self.spark.createDataFrame(offsets, "load string, _part bigint, _first bigint")
            rows = rows.withColumn("_part", F.shiftright("row_id", _ROW_BITS)).join(F.broadcast(parts), ["load", "_part"], "left")
            local = F.col("row_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
            rows = rows.withColumn("row_id", F.coalesce(F.col("_first") + local, F.col("row_id")))
        return rows.select(self.schema.names)

    def vectors(self) -> DataFrame:
        manifest = self.versions.latest()
        return self._read(manifest, list(manifest.loads))

    def centroids(self) -> np.ndarray | DataFrame | None:
        """An array, or a table (cell, vec) if there are too many to go to every task."""
        if not _exists(self.spark, f"{self.path}/centroids"):
            return None
        rows = self.spark.read.schema("cell int, vec array<double>").parquet(f"{self.path}/centroids")
        n = rows.count()
        if n * self.config.embedding_dim > MAX_BROADCAST_CELLS:
            return rows
        table = rows.toArrow().sort_by("cell")
        return to_matrix(table["vec"]) if n else None

    def clear(self) -> None:
        """Drop all vectors and metadata, and the training."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/centroids")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.versions.commit(lambda old: Manifest())
        self.vacuum()

    def _assigned(self, rows: DataFrame) -> DataFrame:
        dim = self.config.embedding_dim
        checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
            F.raise_error(F.lit(f"embedding is not {dim} wide")).cast("array<float>")
        )
        unit = rows.withColumn("vec", V.l2_normalize(checked))
        if self.config.index_type != "IVF":
            return unit.withColumn("cell", F.lit(0))
        centroids = self.centroids()
        if centroids is None:
            unit = checkpoint(unit)  # every training round reads the vectors again
            centroids = ivf_train(unit, self.config.nlist)
            if not isinstance(centroids, DataFrame):
                if not len(centroids):  # nothing to train on: the next add will
                    return unit.withColumn("cell", F.lit(0))
                rows = [(i, [float(v) for v in row]) for i, row in enumerate(centroids)]
                table = self.spark.createDataFrame(rows, "cell int, vec array<double>").coalesce(1)
            else:
                table = centroids
            table.write.mode("overwrite").parquet(f"{self.path}/centroids")
        return ivf_assign(unit, centroids)

    def _write(self, rows: DataFrame) -> tuple[str, dict[int, int]]:
        """A new load, and how many rows each partition of the numbering has."""
        load = uuid.uuid4().hex
        # Rebalanced by cell: small cells share tasks, a large cell is split over several files.
        rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(self._folder(load))
        stored = self.spark.read.schema("row_id bigint").parquet(self._folder(load))
        sizes = stored.groupBy(F.shiftright("row_id", _ROW_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        return load, {r["part"]: r["n"] for r in sizes}

    def add(self, rows: DataFrame, ingest: str | None = None) -> None:
        """Normalize, assign cells (training them on the first add) and append.

        With ``ingest`` the rows of that name are replaced as a whole, so a retried or replayed load is not stored twice;
        it takes its old numbers again if it has no more rows than before.
        """
        out = self._assigned(rows).withColumns({"embedding": F.col("vec").cast("array<float>"), "ingest": F.lit(ingest or f"append-{uuid.uuid4().hex}")})
        out = out.withColumn("row_id", F.lit(None).cast("bigint")).select([F.col(f.name).cast(f.dataType) for f in self.schema])
        # Numbered in order of their ids; the hash orders rows that repeat one, so that a recomputed task numbers alike.
        out = out.withColumn("_tie", F.xxhash64(*out.columns)).repartitionByRange("vec_id", "_tie").sortWithinPartitions("vec_id", "_tie")
        load, sizes = self._write(out.withColumn("row_id", F.monotonically_increasing_id()).drop("_tie"))
        name, total = ingest or load, sum(sizes.values())

        def appended(old: Manifest) -> Manifest:
            before = old.ingests.get(name)
            first = before.first if before and total <= before.rows else old.next_row
            offsets, at = {}, first
            for part in sorted(sizes):
                offsets[str(part)] = at
                at += sizes[part]
            loads = {k: Load(v.rows, v.offsets, [*v.dropped]) for k, v in old.loads.items()}
            if before and before.load in loads:
                if any(k != name and i.load == before.load for k, i in old.ingests.items()):
                    loads[before.load].dropped.append(name)
                else:
                    del loads[before.load]
            loads[load] = Load(total, offsets)
            kept = max(total, before.rows) if before and first == before.first else total
            return Manifest(0, max(old.next_row, at), loads, old.ingests | {name: Ingest(load, first, kept)})

        if total:
            self.versions.commit(appended)

    def compact(self, loads: list[str] | None = None) -> None:
        """Write loads (by default all) together into one, with the numbers their rows have.

        Searches that began before go on reading the old folders, which stay until ``vacuum``.  Adds in the meantime are kept; an
        ingest replaced in the meantime does not come back.
        """
        seen = self.versions.latest()
        old_loads = [k for k in seen.loads if loads is None or k in loads]
        if len(old_loads) < 2 and not any(seen.loads[k].dropped for k in old_loads):
            return
        load, sizes = self._write(self._read(seen, old_loads))
        inside = {k for k, v in seen.ingests.items() if v.load in old_loads}

        def swapped(now: Manifest) -> Manifest:
            if not all(k in now.loads or not any(i.load == k for i in now.ingests.values()) for k in old_loads) or now.version < seen.version:
                return now
            moved = {k for k in inside if k in now.ingests and now.ingests[k].load in old_loads}
            kept = {k: v for k, v in now.loads.items() if k not in old_loads}
            ingests = {k: Ingest(load, v.first, v.rows) if k in moved else v for k, v in now.ingests.items()}
            if moved:
                kept[load] = Load(sum(sizes.values()), {}, sorted(inside - moved))
            return Manifest(0, now.next_row, kept, ingests)

        self.versions.commit(swapped)

    def compact_tiers(self, least: int = TIER_LOADS) -> None:
        """Write together loads of about one size where there are ``least`` of them or more, so that a row is written again only
        as often as the index grows by TIER_FACTOR, and many small adds leave few loads."""
        while True:
            tiers: dict[int, list[str]] = {}
            for name, load in self.versions.latest().loads.items():
                tiers.setdefault(int(math.log(max(load.rows, 1), TIER_FACTOR)), []).append(name)
            full = [names for names in tiers.values() if len(names) >= least]
            if not full:
                return
            self.compact(full[0])

    def vacuum(self) -> None:
        """Delete folders and versions that the latest version does not name."""
        now = self.versions.latest()
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/vectors")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root) if fs.exists(root) else []:
            if status.getPath().getName().removeprefix("load=") not in now.loads:
                fs.delete(status.getPath(), True)
        self.versions.forget(now.version)

    def ranked(self, queries: DataFrame, k: int = 10, where=None, label: str | None = None) -> DataFrame:
        """(query_id, row_id, score, rank) for queries(query_id, vec); ties go to the row stored first.

        ``where`` restricts the index before ranking; it is pushed to the Parquet scan.  ``label`` names a column of the
        records: a query ranks only records that have its own ``label`` there, all if that is null, and the index is read once
        for all labels.  Only ids and vectors are read here, metadata is joined to the hits.  Stored vectors are unit
        vectors already.
        """
        labels = [F.col("label")] if label else []
        queries = queries.select("query_id", V.l2_normalize(F.col("vec")).alias("vec"), *labels)
        named = [F.col(label).cast("string").alias("label")] if label else []
        items = self._rows(where).select(F.col("row_id").alias("vec_id"), F.col("embedding").alias("vec"), "cell", *named)
        return self._nearest(queries, items, k).withColumnRenamed("vec_id", "row_id")

    def _rows(self, where) -> DataFrame:
        return self.vectors() if where is None else self.vectors().where(where)

    def _nearest(self, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
        if self.config.index_type == "IVF":
            centroids = self.centroids()
            if centroids is not None:  # otherwise nothing was added yet and there is nothing to find
                return ivf_search(queries, items, centroids, k, self.config.nprobe, unit=False)
        if self.config.index_type == "HNSW":
            return topk_ann(queries, items, self.config.embedding_dim, k, unit=False)
        rank = topk_labelled if "label" in queries.columns else topk_exact
        return rank(queries, items, k, unit=False)

    def search(self, queries: DataFrame, k: int = 10, where=None, label: str | None = None) -> DataFrame:
        """(query_id, row_id, vec_id, score, rank): ``ranked`` with the ids the rows were added under."""
        hits = attach_metadata(self.ranked(queries, k, where, label), self._rows(where).select("row_id", "vec_id"), "row_id")
        return hits.select("query_id", "row_id", "vec_id", "score", "rank")

    def metadata(self) -> DataFrame:
        return self.vectors().drop("embedding", "cell", "ingest")

    def stats(self) -> DataFrame:
        """(cell, vectors): sums up to the index size."""
        return self.vectors().groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"))
