"""Cases that the registered queries do not meet: shares at the ends, empty loads, damaged files, missing codes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.operators import graph as G
from corvane.operators.blocks import TopK, block_join
from corvane.operators.outline import _nest_batch, outline_nodes
from corvane.operators.sampling import split
from corvane.runtime import broadcast_checked, collect_bounded
from corvane.sources.corpus import read_corpus
from corvane.sources.index import INDEX_TYPES, IndexConfig, VectorIndex


@pytest.mark.parametrize("train, val, none", [(0.9, 0.1, {"test"}), (1.0, 0.0, {"val", "test"}), (0.0, 1.0, {"train", "test"}), (0.0, 0.0, {"train", "val"})])
def test_split_by_hash_with_shares_at_the_ends(spark, train, val, none):
    got = {r["split"]: r["count"] for r in split(spark.range(500), "id", 3, "hash", train, val).groupBy("split").count().collect()}
    assert not none & got.keys() and sum(got.values()) == 500


def test_split_checks_its_shares(spark):
    with pytest.raises(ValueError, match="shares"):
        split(spark.range(3), "id", 0, "hash", 0.9, 0.2)


@pytest.mark.parametrize("kind", INDEX_TYPES)
def test_empty_add_and_repeated_ids(spark, tmp_path, kind):
    index = VectorIndex.create(spark, str(tmp_path / kind), IndexConfig(2, kind, 2, 2), "name string")
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "vec_id bigint, embedding array<float>, name string")
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id bigint, vec array<double>")
    index.add(rows.where("false"))
    assert index.search(asked, 3).count() == 0
    index.add(rows)
    index.add(rows.where("vec_id = 1").withColumn("name", F.lit("again")))
    hits = index.search(asked, 2).join(index.metadata().drop("vec_id"), "row_id").orderBy("rank").collect()
    assert [(r.vec_id, r.name) for r in hits] == [(1, "a"), (1, "again")]
    assert index.vectors().select("row_id").distinct().count() == 3


def test_replayed_load_keeps_its_numbers(spark, tmp_path):
    index = VectorIndex.create(spark, str(tmp_path / "i"), IndexConfig(2))
    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)], "vec_id bigint, embedding array<float>")
    for name, part in (("a", rows.where("vec_id < 2")), ("b", rows.where("vec_id >= 2")), ("b", rows.where("vec_id >= 2"))):
        index.add(part, ingest=name)
    assert [(r.row_id, r.vec_id) for r in index.vectors().orderBy("row_id").collect()] == [(k, k) for k in range(4)]


def test_damaged_and_array_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"code": "a", "language": "python"}, {"code": "b"}]')
    assert sorted(r.code for r in read_corpus(spark, str(tmp_path)).collect()) == ["a", "b"]
    (tmp_path / "bad.json").write_text('[{"code": "c"}, {"code": ')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_corpus(spark, str(tmp_path)).collect()


def test_query_without_its_code_counts_as_zero(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (7, [0.0, 1.0])], "query_id bigint, vec array<double>")
    codes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, vec array<double>")
    ranks = E.rank_of_match(queries, codes)
    assert {r.query_id: r["rank"] for r in ranks.collect()} == {1: 1, 7: None}
    assert E.mrr(ranks).first()[0] == E.ndcg_at_10(ranks).first()[0] == E.recall_at_k(ranks, (1,)).first()[0] == 0.5


def test_nesting_of_lines():
    rows = [[0, 4, 8, 8, 4, 0], [], None, [0] * 1000, [8, 4, 0, 2, 2, 1], list(range(60))]
    got = _nest_batch(pa.array(rows, pa.list_(pa.int32()))).to_pylist()
    for row, nodes in zip(rows, got):
        parents = [None]
        for k, indent in enumerate(row or []):
            parents.append(next((j + 1 for j in range(k - 1, -1, -1) if row[j] < indent), 0))
        assert [n["parent_id"] for n in nodes] == parents
        depth = [0]
        for parent in parents[1:]:
            depth.append(depth[parent] + 1)
        assert [n["depth"] for n in nodes] == depth
        assert [n["child_count"] for n in nodes] == [parents.count(k) for k in range(len(parents))]


def test_graphs_without_a_cap(spark):
    code = "\n".join(f"x{k} = {k}" for k in range(700))
    nodes = outline_nodes(spark.createDataFrame([(1, code, "python")], "doc_id bigint, code string, language string"))
    assert G.cap_nodes(nodes).count() == G.MAX_NODES and G.cap_nodes(nodes, None).count() == 701
    assert G.graph_edges(nodes, None).where("kind = 'tree'").count() == 2 * 700


def test_large_grid_makes_few_copies(spark):
    rows = spark.range(20_000).select(F.col("id").alias("query_id"), F.array((F.col("id") % 7).cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    plan = block_join(rows, rows.withColumnRenamed("query_id", "vec_id"), TopK(1), broadcast_cells=0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1) as int) AS") == 2 and "sequence(0, " not in plan  # one block a side: every row is there once


def test_probes_measure_bytes(spark):
    small, wide = spark.range(10), spark.range(3).select(F.repeat(F.lit("x"), 30_000_000).alias("s"))
    hinted = lambda df: "ResolvedHint" in broadcast_checked(df)._jdf.queryExecution().analyzed().toString()
    assert hinted(small) and not hinted(wide)
    failing = spark.range(10).select(F.raise_error(F.lit("evaluated")).alias("vec"))
    assert collect_bounded(failing, 5) is None
