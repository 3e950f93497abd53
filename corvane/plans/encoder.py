"""A code encoder with frozen statistics: fitted once, stored as tables, the same vectors for a record wherever it comes.

``fit`` takes the layers' statistics from a corpus.  After that nothing depends on what else is encoded: a snippet that
arrives tomorrow lies in the space of the index built today, and encoding is one narrow pass.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import graph as G
from corvane.operators.gnn import Layer
from corvane.operators.graph_blocks import OutlineReader, Statistics
from corvane.operators.outline import outlined
from corvane.plans.retrieval import EncoderWeights, code_statistics, outline_reader, with_code_vector
from corvane.runtime import explode_once
from corvane.sources.index import VectorIndex

_TENSORS = "name string, shape array<int>, cells array<double>"


@dataclass
class CodeEncoder:
    """Weights, node types with their vectors, and a (mean, variance) pair for every layer."""

    weights: EncoderWeights
    reader: OutlineReader
    statistics: list[Statistics]
    dim: int
    max_nodes: int | None = G.MAX_NODES

    @classmethod
    def fit(cls, records: DataFrame, weights: EncoderWeights, dim: int, vocab: DataFrame | None = None, max_nodes: int | None = G.MAX_NODES) -> CodeEncoder:
        """Statistics, and without a ``vocab`` also the node types' ids, from ``records``, with their outline where it is there already.

        Types are then numbered in order of their first occurrence; ``weights.types`` has a vector for each id.
        """
        if vocab is None:
            vocab = first_seen_types(records)
        reader = outline_reader(weights, vocab)
        return cls(weights, reader, code_statistics(records, weights, reader, max_nodes), dim, max_nodes)

    def encode(self, records: DataFrame) -> DataFrame:
        """``records`` with ``vec``; their other columns stay, so nothing has to be joined to the vectors."""
        return with_code_vector(records, self.weights, self.reader, self.statistics, self.dim, self.max_nodes)

    def embed_snippets(self, records: DataFrame) -> DataFrame:
        """``records`` with ``embedding`` and its ``dimension``; a row without a language counts as Python."""
        known = records.withColumn("language", F.coalesce("language", F.lit("python")))
        return self.encode(known).withColumnRenamed("vec", "embedding").withColumn("dimension", F.size("embedding").cast("bigint"))

    # --- storage -------------------------------------------------------------------------------------------------

    def _tensors(self) -> dict[str, np.ndarray]:
        w = self.weights
        out = {"projection": w.projection, "types": self.reader.vectors, "output": w.output}
        for k, (layer, (mean, var)) in enumerate(zip(w.layers, self.statistics)):
            out |= {f"layers.{k}.weight": layer.weight, f"layers.{k}.residual": layer.residual, f"layers.{k}.mean": mean, f"layers.{k}.var": var}
            if layer.att_src is not None:
                out |= {f"layers.{k}.att_src": layer.att_src, f"layers.{k}.att_dst": layer.att_dst}
        for name, value in w.fusion_weights.items():
            if isinstance(value, dict):
                out |= {f"fusion.{name}.{part}": m for part, m in value.items()}
            elif value is not None and not np.isscalar(value):
                out[f"fusion.{name}"] = np.asarray(value)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights and statistics as one table, node types as another, the settings as one row of JSON."""
        settings = {
            "dim": self.dim, "max_nodes": self.max_nodes, "fusion": self.weights.fusion, "concat": [bool(layer.concat) for layer in self.weights.layers],
            "scalars": {k: v for k, v in self.weights.fusion_weights.items() if np.isscalar(v)}, "control_types": list(self.reader.control_types),
        }
        rows = [(n, list(m.shape), [float(v) for v in np.ravel(m)]) for n, m in self._tensors().items()]
        spark.createDataFrame(rows, _TENSORS).coalesce(1).write.mode("overwrite").parquet(f"{path}/tensors")
        spark.createDataFrame(list(enumerate(self.reader.types)), "type_id bigint, type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/types")
        spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeEncoder:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        # The size of a model, whatever the corpus.
        rows = spark.read.schema(_TENSORS).parquet(f"{path}/tensors").collect()
        m = {r["name"]: np.array(r["cells"], "f8").reshape(r["shape"]) for r in rows}
        layers, statistics = [], []
        for k, concat in enumerate(settings["concat"]):
            layers.append(Layer(m[f"layers.{k}.weight"], m[f"layers.{k}.residual"], m.get(f"layers.{k}.att_src"), m.get(f"layers.{k}.att_dst"), concat))
            statistics.append((m[f"layers.{k}.mean"], m[f"layers.{k}.var"]))
        fusion: dict = dict(settings["scalars"])
        for name, value in m.items():
            if name.startswith("fusion."):
                _, first, *rest = name.split(".")
                if rest:
                    fusion.setdefault(first, {})[rest[0]] = value
                else:
                    fusion[first] = value
        types = [r["type"] for r in spark.read.schema("type_id bigint, type string").parquet(f"{path}/types").orderBy("type_id").collect()]
        table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m["types"])], "type_id bigint, vec array<double>")
        weights = EncoderWeights(m["projection"], table, layers, m["output"], settings["fusion"], fusion)
        reader = OutlineReader(types, m["types"], m["projection"], tuple(settings["control_types"]))
        return cls(weights, reader, statistics, settings["dim"], settings["max_nodes"])


def first_seen_types(records: DataFrame) -> DataFrame:
    """(type, type_id) of the outlines of ``records``, which may be there already, in order of their first occurrence."""
    types = F.col("_types")
    # A type's first place in a record is enough, so a record gives a row a type, not a row a node.
    firsts = F.transform(F.array_distinct(types), lambda t: F.struct(t.alias("type"), (F.array_position(types, t) - 1).cast("int").alias("id")))
    seen = outlined(records).select("doc_id", explode_once(firsts).alias("s"))
    return G.node_type_vocab(seen.where(F.col("s").isNotNull()).select("doc_id", "s.id", "s.type"))


def index_code(index: VectorIndex, encoder: CodeEncoder, records: DataFrame, id_col: str = "doc_id", ingest: str | None = None) -> None:
    """Encode code records and add them with their fields; what the index holds already keeps its vectors."""
    fields = [f.name for f in index.schema if f.name in records.columns and f.name not in (id_col, "vec_id", "embedding")]
    rows = encoder.encode(records.select(id_col, *dict.fromkeys([*fields, "code", "language"])))
    index.add(rows.withColumnsRenamed({id_col: "vec_id", "vec": "embedding"}), ingest)
