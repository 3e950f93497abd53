import json
import re

import pytest
from pyspark.sql import functions as F

from corvane.sources import corpus as C
from corvane.sources.index import IndexConfig, VectorIndex
from corvane.streaming.ingest import stream_index


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.col("id").alias("vec_id"),
        F.array((F.col("id") + 1).cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
        F.concat(F.lit("f"), "id").alias("func_name"),
    )


def new_index(spark, tmp_path, kind="Flat", **config):
    return VectorIndex.create(spark, str(tmp_path / "index"), IndexConfig(2, kind, **config), "func_name string")


def size(index):
    return index.stats().agg(F.coalesce(F.sum("vectors"), F.lit(0))).first()[0]


def test_corpus_reads_arrays_of_a_file_or_folder(spark, tmp_path):
    record = {"code": "x", "docstring": "d", "language": "java", "func_name": "f"}
    (tmp_path / "sub").mkdir()
    for name, n in (("a.json", 2), ("b.json", 3), ("sub/c.json", 4), ("d.txt", 5)):
        (tmp_path / name).write_text(json.dumps([record] * n, indent=2))
    assert C.read_corpus(spark, str(tmp_path)).count() == 5
    got = C.read_corpus(spark, str(tmp_path / "a.json"))
    assert got.count() == 2 and got.first().asDict() == record
    with pytest.raises(ValueError):
        C.read_corpus(spark, str(tmp_path), format="xml")


def test_stored_configuration_wins(spark, tmp_path):
    index = new_index(spark, tmp_path, "IVF", nlist=3, nprobe=2)
    again = VectorIndex.load(spark, index.path, IndexConfig(99, "Flat", 1, 1))
    assert again.config == IndexConfig(2, "IVF", 3, 2)
    with pytest.raises(ValueError):
        IndexConfig(2, "LSH")


@pytest.mark.parametrize("kind", ["Flat", "IVF", "HNSW"])
def test_add_search_clear(spark, tmp_path, kind):
    index = new_index(spark, tmp_path, kind, nlist=4, nprobe=4)
    query = spark.createDataFrame([(0, [5.0, 1.0])], "query_id long, vec array<double>")
    assert index.search(query, 3).count() == 0
    index.add(rows(spark, 20))
    index.add(rows(spark, 10, 100))
    assert size(index) == 30
    best = index.search(query, 1).first()
    assert best.vec_id == 4 and best.score == pytest.approx(1.0, abs=1e-6)
    only = index.search(query, 3, where=F.col("func_name") == "f7")
    assert [r.vec_id for r in only.collect()] == [7]
    index.clear()
    assert size(index) == 0 and index.centroids() is None
    index.add(rows(spark, 5))
    assert size(index) == 5


def test_probed_cells_prune_partitions(spark, tmp_path):
    index = new_index(spark, tmp_path, "IVF", nlist=4, nprobe=1)
    index.add(rows(spark, 40))
    query = spark.createDataFrame([(0, [5.0, 1.0])], "query_id long, vec array<double>")
    hits = index.ranked(query, 1, where=F.col("func_name") == "f4")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan) and "PushedFilters: [IsNotNull(func_name)" in plan
    assert hits.count() <= 1


def test_wrong_width_fails(spark, tmp_path):
    bad = rows(spark, 1).withColumn("embedding", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="not 2 wide"):
        new_index(spark, tmp_path).add(bad)


def test_replayed_load_is_stored_once(spark, tmp_path):
    index = new_index(spark, tmp_path)
    for _ in range(2):
        index.add(rows(spark, 6), ingest="load-1")
    index.add(rows(spark, 6), ingest="load-2")
    assert size(index) == 12


def test_stream_continues_where_it_stopped(spark, tmp_path):
    index = new_index(spark, tmp_path)
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    for part in range(2):
        rows(spark, 4, 10 * part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows(spark, 1).schema).parquet(source)
        stream_index(stream, index, lambda batch: batch, progress).awaitTermination()
    assert sorted(r.vec_id for r in index.vectors().select("vec_id").collect()) == [0, 1, 2, 3, 10, 11, 12, 13]


def test_metrics_of_an_epoch_are_replaced(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for epoch, value in ((0, 1.0), (1, 2.0), (1, 3.0)):
        C.write_metrics(spark.createDataFrame([("loss", value)], "metric string, value double"), path, epoch)
    assert {(r.epoch, r.value) for r in C.read_metrics(spark, path).collect()} == {(0, 1.0), (1, 3.0)}


def test_sample_is_reproducible_and_covers_the_pool(spark):
    pool = spark.range(6).select(F.col("id").alias("doc_id"), F.lit("x").alias("code"))
    first, second = (C.sample_corpus(pool, 200, seed=1).orderBy("sample_id").collect() for _ in range(2))
    assert first == second and len(first) == 200 and len({r.doc_id for r in first}) == 6
