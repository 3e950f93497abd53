"""The manifest of an index: adds that read nothing back, replays, compaction beside searches and adds, files left by a stream."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.sources import manifest
from corvane.sources.index import IndexConfig, VectorIndex
from corvane.sources.manifest import Load, Manifest, Versions
from corvane.streaming.ingest import stream_index


def rows(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("vec_id"), F.array((F.col("id") + 1).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))


@pytest.fixture
def index(spark, tmp_path):
    return VectorIndex.create(spark, str(tmp_path / "index"), IndexConfig(2))


def numbers(index):
    return [(r.row_id, r.vec_id) for r in index.vectors().orderBy("row_id").collect()]


def folders(index):
    return sorted(p.name for p in Path(index.path, "vectors").glob("load=*"))


def test_add_reads_no_stored_vectors(spark, index):
    index.add(rows(spark, 0, 5))
    index.add(rows(spark, 5, 9))
    for folder in Path(index.path, "vectors").glob("load=*"):  # what is stored cannot be read any more
        folder.rename(folder.with_name("gone-" + folder.name))
    index.add(rows(spark, 9, 12), ingest="third")
    now = index.versions.latest()
    assert (now.next_row, now.ingests["third"].first) == (12, 9)
    assert numbers_of(index, now.ingests["third"].load) == [(9, 9), (10, 10), (11, 11)]


def numbers_of(index, load):
    return [(r.row_id, r.vec_id) for r in index._read(index.versions.latest(), [load]).orderBy("row_id").collect()]


def test_replay_of_an_earlier_ingest(spark, index):
    for name, lo, hi in (("a", 0, 3), ("b", 3, 6), ("a", 0, 3), ("c", 6, 8)):
        index.add(rows(spark, lo, hi), ingest=name)
    assert numbers(index) == [(k, k) for k in range(8)]
    index.add(rows(spark, 0, 1), ingest="a")  # fewer rows: the first of the old numbers
    assert numbers(index) == [(0, 0)] + [(k, k) for k in range(3, 8)]
    index.add(rows(spark, 0, 3), ingest="a")  # as many as at first
    index.add(rows(spark, 100, 104), ingest="b")  # more rows: new numbers, none twice
    assert [n for n, _ in numbers(index)] == [0, 1, 2, 6, 7, 8, 9, 10, 11]


def test_compaction_keeps_numbers_and_running_searches(spark, index):
    for name, lo, hi in (("a", 0, 3), ("b", 3, 6), ("c", 6, 9)):
        index.add(rows(spark, lo, hi), ingest=name)
    asked = spark.createDataFrame([(0, [5.0, 1.0])], "query_id long, vec array<double>")
    before = index.vectors()  # a plan made before compaction
    index.compact()
    assert len(index.versions.latest().loads) == 1 and len(folders(index)) == 4
    assert before.count() == 9 and numbers(index) == [(k, k) for k in range(9)]
    assert index.search(asked, 1).first().vec_id == 4
    index.add(rows(spark, 3, 6), ingest="b")  # replaced within the compacted load
    assert numbers(index) == [(k, k) for k in range(9)]
    index.compact()
    index.vacuum()
    assert len(folders(index)) == 1 and numbers(index) == [(k, k) for k in range(9)]
    assert len(list(Path(index.path, "manifest").glob("*.json"))) == 1


def test_changes_during_compaction(spark, index, monkeypatch):
    for name, lo, hi in (("a", 0, 3), ("b", 3, 6)):
        index.add(rows(spark, lo, hi), ingest=name)
    write, done = VectorIndex._write, []

    def write_and_others_add(self, out):
        result = write(self, out)
        if not done:
            done.append(True)
            self.add(rows(spark, 0, 3), ingest="a")
            self.add(rows(spark, 6, 8), ingest="c")
        return result

    monkeypatch.setattr(VectorIndex, "_write", write_and_others_add)
    index.compact()
    assert numbers(index) == [(k, k) for k in range(8)]


def test_two_writers_get_different_numbers(spark, index, monkeypatch):
    other = VectorIndex.load(spark, index.path)
    latest, done = Versions.latest, []

    def latest_then_another_commits(self):
        found = latest(self)
        if not done:
            done.append(True)
            other.add(rows(spark, 10, 13))
        return found

    monkeypatch.setattr(Versions, "latest", latest_then_another_commits)
    index.add(rows(spark, 0, 2))
    found = numbers(index)
    assert sorted(v for _, v in found) == [0, 1, 10, 11, 12] and len({n for n, _ in found}) == 5


def test_unfinished_version_does_not_count(spark, index, monkeypatch):
    index.add(rows(spark, 0, 2))
    at = index.versions.latest().version
    Path(index.path, "manifest", f"{at + 1:012d}.json").write_text('{"version": 99, "next')
    assert numbers(index) == [(0, 0), (1, 1)]
    monkeypatch.setattr(manifest, "WRITE_SECONDS", 1.0)
    index.add(rows(spark, 2, 3))  # the writer is dead: its version is removed
    assert numbers(index) == [(0, 0), (1, 1), (2, 2)] and index.versions.latest().version == at + 1


def test_manifest_round_trip():
    from dataclasses import asdict

    m = Manifest(3, 9, {"x": Load(4, {"0": 5}, ["a"])}, {})
    assert Manifest.parse(json.dumps(asdict(m))) == m


def test_stream_of_small_batches_leaves_few_loads(spark, index, tmp_path):
    source = str(tmp_path / "in")
    for part in range(12):
        rows(spark, part * 2, part * 2 + 2).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("vec_id bigint, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(source)
    stream_index(stream, index, lambda batch: batch, str(tmp_path / "progress")).awaitTermination()
    assert len(index.versions.latest().loads) < 8 and len(index.versions.latest().ingests) == 12
    assert sorted(v for _, v in numbers(index)) == list(range(24)) and [n for n, _ in numbers(index)] == list(range(24))
