"""Outline, graph and propagation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import gnn as P
from corvane.operators import graph as G
from corvane.operators.outline import NODE_TYPES, OUTLINE_COLUMNS, node_types, outline_nodes, with_outline
from corvane.plans.catalog.fixtures import (
    SQL_CODE,
    code_records,
    long_form,
    r6,
    sql_embed,
    sql_layer_norm,
    sql_linear,
    sql_r6,
    sql_w,
    table,
    weight,
)
from corvane.plans.catalog.text import _lit, sql_remove_comments, sql_strip, sql_whitespace
from corvane.plans.encoder import CodeEncoder, first_seen_types, index_code
from corvane.plans.retrieval import EncoderWeights, encode_code, search
from corvane.runtime import checkpoint, scratch_path
from corvane.sources.index import IndexConfig, VectorIndex

HIDDEN, HEADS, BATCH, DIM, FUSED, N_LAYERS = 8, 2, 32, 16, 16, 3
CHANNELS = HIDDEN // HEADS
CONVERSATION_CONTROL = ("assistant",)


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline_nodes(code_records(spark, sf_dir))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, {_lit(p)}) THEN '{n}'" for n, p in NODE_TYPES) + " ELSE 'line' END"
# Parent by self-join of a file's lines, depth by recursion over levels.
SQL_OUTLINE = f"""{SQL_CODE},
raw AS (SELECT doc_id, unnest(string_split(code, chr(10))) AS raw, generate_subscripts(string_split(code, chr(10)), 1) - 1 AS row_no
        FROM code_fixture),
ln AS (SELECT *, {sql_strip('raw')} AS line FROM raw),
nz AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS id, row_no, line,
              instr(raw, substr(line, 1, 1)) - 1 AS indent FROM ln WHERE line <> ''),
par AS (SELECT a.doc_id, a.id, coalesce(max(b.id), 0) AS parent_id
        FROM nz a LEFT JOIN nz b ON b.doc_id = a.doc_id AND b.id < a.id AND b.indent < a.indent GROUP BY ALL),
dep AS (
  WITH RECURSIVE r AS (
    SELECT doc_id, id, 1 AS depth FROM par WHERE parent_id = 0
    UNION ALL
    SELECT p.doc_id, p.id, r.depth + 1 FROM par p JOIN r ON p.doc_id = r.doc_id AND p.parent_id = r.id)
  SELECT * FROM r),
kids AS (SELECT doc_id, parent_id AS id, count(*) AS n FROM par GROUP BY ALL),
nodes0 AS (
  SELECT doc_id, id, {_KIND} AS type, substr(line, 1, 100) AS text, row_no AS start_row, indent AS start_col,
         row_no AS end_row, indent + length(line) AS end_col, parent_id, depth
  FROM nz JOIN par USING (doc_id, id) JOIN dep USING (doc_id, id)
  UNION ALL
  SELECT doc_id, 0, 'module', substr(code, 1, 100), 0, 0, len(string_split(code, chr(10))) - 1,
         length(string_split(code, chr(10))[-1]), NULL, 0 FROM code_fixture),
nodes AS (
  SELECT nodes0.*, type <> 'bracket' AS is_named, coalesce(n, 0) AS child_count FROM nodes0 LEFT JOIN kids USING (doc_id, id))"""

# Conversations as trees: node 0 is the conversation, turn t is node t + 1 below it.
SQL_TURNS = """nodes AS (
  SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS id, 'conversation' AS type, CAST(NULL AS BIGINT) AS parent_id, 0 AS depth,
         true AS is_named, count(*) AS child_count FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT conv_id, turn + 1, role, 0, 1, true, 0 FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {SQL_TURNS} SELECT * FROM nodes".replace("conversations", "{c}"), c=table(spark, sf_dir, "conversations"))


SQL_CAPPED = "cap AS (SELECT * FROM nodes WHERE id < 500)"
SQL_TREE = "SELECT doc_id, unnest([parent_id, id]) AS src, unnest([id, parent_id]) AS dst, 'tree' AS kind FROM cap WHERE parent_id IS NOT NULL"
SQL_SIBLING = """SELECT doc_id, unnest([id, nxt]) AS src, unnest([nxt, id]) AS dst, 'sibling' AS kind FROM (
  SELECT doc_id, id, lead(id) OVER (PARTITION BY doc_id, parent_id ORDER BY id) AS nxt FROM cap WHERE parent_id IS NOT NULL)
  WHERE nxt IS NOT NULL"""


def sql_control(types=G.CONTROL_TYPES) -> str:
    names = ", ".join(f"'{t}'" for t in types)
    return f"""SELECT doc_id, id AS src, nxt AS dst, 'control' AS kind FROM (
  SELECT doc_id, id, lead(id) OVER (PARTITION BY doc_id ORDER BY id) AS nxt FROM cap WHERE type IN ({names})) WHERE nxt IS NOT NULL"""


def sql_edges(types=G.CONTROL_TYPES) -> str:
    return f"edges AS ({SQL_TREE} UNION ALL {SQL_SIBLING} UNION ALL {sql_control(types)})"


SQL_VOCAB = """vocab AS (
  SELECT type, row_number() OVER (ORDER BY f) - 1 AS type_id FROM (SELECT type, min({'d': doc_id, 'i': id}) AS f FROM nodes GROUP BY type))"""
SQL_FEATURES = """feat AS (
  SELECT doc_id, id, type_id, [type_id, depth, child_count, CASE WHEN is_named THEN 1 ELSE 0 END]::DOUBLE[] AS x
  FROM cap JOIN vocab USING (type))"""
SQL_EMPTY = """allfeat AS (
  SELECT * FROM feat UNION ALL
  SELECT doc_id, 0, 0, [0, 0, 0, 0]::DOUBLE[] FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM feat))"""

SQL_CODE_GRAPH = f"{SQL_OUTLINE}, {SQL_CAPPED}, {sql_edges()}, {SQL_VOCAB}, {SQL_FEATURES}"
SQL_TURN_GRAPH = f"{SQL_TURNS}, {SQL_CAPPED}, {sql_edges(CONVERSATION_CONTROL)}, {SQL_VOCAB}, {SQL_FEATURES}"


def _wide(df: DataFrame) -> DataFrame:
    """32-bit columns as bigint, which is what SQL's row numbers and lengths are."""
    return df.select([F.col(n).cast("bigint").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes])


def _flat_outline(spark, d):
    flat = outline(spark, d).select(
        "doc_id", "id", "type", "text",
        F.col("start_point.row").alias("start_row"), F.col("start_point.col").alias("start_col"),
        F.col("end_point.row").alias("end_row"), F.col("end_point.col").alias("end_col"),
        "parent_id", "depth", "is_named", "child_count",
    )
    return _wide(flat)


def _edges(fn):
    return lambda spark, d: _wide(fn(outline(spark, d)).select("doc_id", "src", "dst", "kind"))


def _edge_sql(body: str) -> str:
    return f"WITH {SQL_OUTLINE}, {SQL_CAPPED} {body}"


def _features_rows(df: DataFrame) -> DataFrame:
    x = [F.col("x")[i].alias(n) for i, n in enumerate(("f0", "f1", "f2", "f3"))]
    return df.select("doc_id", F.col("id").cast("bigint").alias("id"), *x)


_SQL_FEATURE_ROWS = "SELECT doc_id, id, x[1] AS f0, x[2] AS f1, x[3] AS f2, x[4] AS f3"


def features(spark, d):
    nodes = outline(spark, d)
    return _features_rows(G.node_features(nodes, G.node_type_vocab(nodes)))


def mixed_docs(spark, d) -> DataFrame:
    """Code records and prose documents: the latter have no rules, so no nodes."""
    prose = table(spark, d, "documents").select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("code"), F.col("lang").alias("language")
    )
    return code_records(spark, d).select("doc_id", "code", "language").unionByName(prose)


SQL_DOCS = "docs AS (SELECT doc_id FROM code_fixture UNION ALL SELECT -doc_id - 1 FROM documents)"


def empty_graphs(spark, d):
    records = mixed_docs(spark, d)
    nodes = outline_nodes(records)
    return _features_rows(G.with_empty_graphs(G.node_features(nodes, G.node_type_vocab(nodes)), records))


def batched(spark, d, which: int):
    nodes = outline(spark, d)
    feat = G.node_features(nodes, G.node_type_vocab(nodes))
    batches = code_records(spark, d).select("doc_id", F.expr(f"doc_id div {BATCH}").alias("batch_id"))
    out = G.graph_batch(feat, G.graph_edges(nodes), batches)[which]
    return out.drop("x").withColumn("id", F.col("id").cast("bigint")) if which == 0 else out


SQL_OFFSETS = f"""off AS (
  SELECT doc_id, doc_id // {BATCH} AS batch_id,
         coalesce(sum(n) OVER (PARTITION BY doc_id // {BATCH} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o
  FROM (SELECT doc_id, count(*) AS n FROM feat GROUP BY doc_id))"""


def type_vectors(vocab: DataFrame, width: int = HIDDEN) -> DataFrame:
    """(type_id, vec) from the weight formula, one row per type."""
    w = [((F.col("type_id") * 7 + k * 3 + 1) % 11 - 5) / F.lit(11.0) for k in range(width)]
    return vocab.select("type_id", F.array(*w).alias("vec"))


def turn_graph(spark, d):
    """Start vectors and edges of the conversation trees."""
    nodes = checkpoint(turns(spark, d))
    vocab = G.node_type_vocab(nodes)
    start = P.type_embedding(G.node_features(nodes, vocab), weight(HIDDEN, 4), type_vectors(vocab))
    return start, G.graph_edges(nodes, control_types=CONVERSATION_CONTROL)


def sql_start(source: str = "feat") -> str:
    return f"""x0 AS (
  SELECT doc_id, id, i AS d, sum(v * {sql_w('i', 'j')}) + {sql_w('type_id', 'i', 1)} AS x
  FROM (SELECT doc_id, id, type_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM {source}), range({HIDDEN}) r(i)
  GROUP BY doc_id, id, type_id, i)"""


SQL_LOOPS = "loops AS (SELECT doc_id, src, dst FROM edges WHERE src <> dst UNION ALL SELECT DISTINCT doc_id, id, id FROM x0)"


def sql_gcn(name: str, source: str, rows: int, shift: int | None) -> str:
    """CTEs ending in ``name(doc_id, id, d, x)``."""
    h = f"{name}_h AS (SELECT * FROM {source})" if shift is None else sql_linear(f"{name}_h", source, "doc_id, id", rows, shift)
    return f"""{h},
{name}_deg AS (SELECT doc_id, dst AS id, count(*)::DOUBLE AS deg FROM loops GROUP BY ALL),
{name} AS (
  SELECT l.doc_id, l.dst AS id, h.d, sum(h.x / sqrt(a.deg * b.deg)) AS x
  FROM loops l JOIN {name}_h h ON h.doc_id = l.doc_id AND h.id = l.src
  JOIN {name}_deg a ON a.doc_id = l.doc_id AND a.id = l.src JOIN {name}_deg b ON b.doc_id = l.doc_id AND b.id = l.dst
  GROUP BY ALL)"""


def sql_gat(name: str, source: str, heads: int, shift: int) -> str:
    return f"""{sql_linear(name + '_h', source, 'doc_id, id', heads * CHANNELS, shift)},
{name}_s AS (
  SELECT doc_id, id, d // {CHANNELS} AS head, sum(x * {sql_w(f'd // {CHANNELS}', f'd % {CHANNELS}', 2)}) AS s,
         sum(x * {sql_w(f'd // {CHANNELS}', f'd % {CHANNELS}', 3)}) AS t FROM {name}_h GROUP BY ALL),
{name}_e AS (
  SELECT l.doc_id, l.src, l.dst, a.head, CASE WHEN a.s + b.t > 0 THEN a.s + b.t ELSE 0.2::DOUBLE * (a.s + b.t) END AS e
  FROM loops l JOIN {name}_s a ON a.doc_id = l.doc_id AND a.id = l.src
  JOIN {name}_s b ON b.doc_id = l.doc_id AND b.id = l.dst AND b.head = a.head),
{name}_p AS (SELECT *, exp(e - max(e) OVER (PARTITION BY doc_id, dst, head)) AS p FROM {name}_e),
{name} AS (
  SELECT p.doc_id, p.dst AS id, h.d, sum(p * h.x) / sum(p) AS x
  FROM {name}_p p JOIN {name}_h h ON h.doc_id = p.doc_id AND h.id = p.src AND h.d // {CHANNELS} = p.head GROUP BY ALL)"""


def sql_layer(name: str, source: str, conv: str, width: int, shift: int) -> str:
    """Residual layer over the CTE ``conv`` of the same node set."""
    return f"""{sql_linear(name + '_res', source, 'doc_id, id', width, shift)},
{name} AS (
  SELECT r.doc_id, r.id, r.d, r.x + greatest((c.x - avg(c.x) OVER w) / sqrt(var_pop(c.x) OVER w + 1e-5::DOUBLE), 0) AS x
  FROM {name}_res r JOIN {conv} c USING (doc_id, id, d) WINDOW w AS (PARTITION BY d))"""


def gat_weights(heads: int) -> dict:
    return {"att_src": weight(heads, CHANNELS, 2), "att_dst": weight(heads, CHANNELS, 3)}


def gcn_layers(n: int) -> list[P.Layer]:
    return [P.Layer(weight(HIDDEN, HIDDEN, k), weight(HIDDEN, HIDDEN, k + 4)) for k in range(n)]


def gat_layers(n: int) -> list[P.Layer]:
    """Heads are concatenated but for the last layer, which has one head."""
    out, width = [], HIDDEN
    for k in range(n):
        heads = HEADS if k < n - 1 else 1
        out.append(P.Layer(weight(heads * CHANNELS, width, k), weight(heads * CHANNELS, width, k + 4), **gat_weights(heads)))
        width = heads * CHANNELS
    return out


def sql_layers(kind: str, n: int) -> str:
    """CTEs x1..xn over x0 and loops."""
    parts = []
    for k in range(n):
        heads = HEADS if k < n - 1 else 1
        width = HIDDEN if kind == "gcn" else heads * CHANNELS
        conv = sql_gcn(f"c{k}", f"x{k}", width, k) if kind == "gcn" else sql_gat(f"c{k}", f"x{k}", heads, k)
        parts += [conv, sql_layer(f"x{k + 1}", f"x{k}", f"c{k}", width, k + 4)]
    return ", ".join(parts)


SQL_TURN_START = f"{SQL_TURN_GRAPH}, {sql_start()}, {SQL_LOOPS}"
_NODE_KEYS = ["doc_id", "id"]


def _node_sql(ctes: str, source: str) -> str:
    return f"WITH {ctes} SELECT doc_id, id, d AS dim, {sql_r6('x')} AS value FROM {source}"


def _on_turns(fn, vec):
    return lambda spark, d: long_form(fn(*turn_graph(spark, d)), _NODE_KEYS, vec)


def pooled(spark, d):
    start, edges = turn_graph(spark, d)
    return long_form(P.graph_mean_max_pool(P.node_embeddings(start, edges, gcn_layers(1))), "doc_id")


def sql_pool(source: str, width: int) -> str:
    return f"""pool AS (
  SELECT doc_id, d, avg(x) AS x FROM {source} GROUP BY doc_id, d
  UNION ALL SELECT doc_id, d + {width}, max(x) FROM {source} GROUP BY doc_id, d)"""


def encoder_weights(vocab: DataFrame) -> EncoderWeights:
    return EncoderWeights(
        projection=weight(HIDDEN, 4),
        types=type_vectors(vocab),
        layers=gat_layers(N_LAYERS),
        output=weight(DIM, 2 * CHANNELS, 5),
        fusion="concat",
        fusion_weights={"weight": weight(FUSED, 2 * DIM, 6)},
    )


def encoded(spark, d):
    """Text and outline embeddings of the code records and the prose documents, fused."""
    records = mixed_docs(spark, d)
    vocab = checkpoint(first_seen_types(records))
    return long_form(encode_code(records, encoder_weights(vocab), vocab, DIM), "doc_id")


def fitted_encoder(spark, d) -> CodeEncoder:
    """Fitted on the code records and the prose documents, stored and loaded."""
    records = checkpoint(with_outline(mixed_docs(spark, d)).select("doc_id", *OUTLINE_COLUMNS))
    vocab = checkpoint(first_seen_types(records))
    path = scratch_path(spark, "encoder")
    CodeEncoder.fit(records, encoder_weights(vocab), DIM, vocab).save(spark, path)
    return CodeEncoder.load(spark, path)


def frozen_statistics(spark, d):
    """Mean and variance of every component of every layer, of the stored encoder."""
    rows = [
        (layer, k, float(m), float(v)) for layer, (mean, var) in enumerate(fitted_encoder(spark, d).statistics) for k, (m, v) in enumerate(zip(mean, var))
    ]
    return spark.createDataFrame(rows, "layer bigint, dim bigint, mean double, variance double").select("layer", "dim", r6(F.col("mean")).alias("mean"), r6(F.col("variance")).alias("variance"))


def snippets(spark, d):
    """Every code record embedded as a snippet that arrives: away from the corpus its statistics come from."""
    rows = fitted_encoder(spark, d).embed_snippets(code_records(spark, d).select("doc_id", "code", "language"))
    return long_form(rows.select("doc_id", "embedding", "dimension"), ["doc_id", "dimension"], "embedding")


def encoded_index(spark, d, loads: int = 2, index_type: str = "Flat") -> VectorIndex:
    """The code records as an index of encoded code, added in several loads."""
    encoder = fitted_encoder(spark, d)
    index = VectorIndex.create(spark, scratch_path(spark, "code_index"), IndexConfig(DIM, index_type, 20, 20), "code string, docstring string, language string, func_name string")
    records = code_records(spark, d)
    for k in range(loads):
        index_code(index, encoder, records.where(F.col("doc_id") % loads == k), ingest=f"load-{k}")
    return index


def indexed_code(spark, d):
    stored = encoded_index(spark, d).vectors().select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "language")
    return long_form(stored, ["doc_id", "language"])


def searched_code(spark, d):
    from corvane.plans.catalog.search import code_requests

    out = search(code_requests(spark, d), encoded_index(spark, d))
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "language", "func_name", F.md5("code").alias("code_md5"), F.round("score", 5).alias("score"))


SQL_ENCODED = f"""WITH {SQL_CODE_GRAPH}, {SQL_DOCS}, {SQL_EMPTY}, {sql_start('allfeat')}, {SQL_LOOPS}, {sql_layers('gat', N_LAYERS)},
{sql_pool(f'x{N_LAYERS}', CHANNELS)},
{sql_linear('o', 'pool', 'doc_id', DIM, 5, 'relu')}, {sql_layer_norm('gv', 'o', 'doc_id')},
src AS (SELECT doc_id, {sql_whitespace(sql_remove_comments())} AS code FROM code_fixture
        UNION ALL SELECT -doc_id - 1, {sql_whitespace('text')} FROM documents),
{sql_embed('tv', 'src', 'doc_id', 'code', DIM)},
ab AS (SELECT doc_id, d, x FROM tv UNION ALL SELECT doc_id, d + {DIM}, x FROM gv),
{sql_linear('y', 'ab', 'doc_id', FUSED, 6, 'relu')}, {sql_layer_norm('z', 'y', 'doc_id')}
SELECT doc_id, d AS dim, {sql_r6('x')} AS value FROM z"""

_SQL_Z, _SQL_LAST = SQL_ENCODED.rsplit("\n", 1)
SQL_STATISTICS = _SQL_Z + " " + " UNION ALL ".join(
    f"SELECT {k}::BIGINT AS layer, d AS dim, {sql_r6('avg(x)')} AS mean, {sql_r6('var_pop(x)')} AS variance FROM c{k} GROUP BY d" for k in range(N_LAYERS)
)
SQL_SNIPPETS = f"{_SQL_Z} SELECT doc_id, {FUSED}::BIGINT AS dimension, d AS dim, {sql_r6('x')} AS value FROM z WHERE doc_id >= 0"
SQL_UNIT_Z = f"{_SQL_Z}, uz AS (SELECT doc_id, d, (x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS x FROM z WHERE doc_id >= 0)"
SQL_INDEXED = f"{SQL_UNIT_Z} SELECT doc_id, language, d AS dim, {sql_r6('x')} AS value FROM uz JOIN code_fixture USING (doc_id)"


def sql_searched_code() -> str:
    return f"""{SQL_UNIT_Z},
req AS (SELECT item_id AS query_id, concat(text, ' return size price total ', item_id::VARCHAR) AS query,
          CASE WHEN item_id % 4 = 0 THEN 10 ELSE item_id % 4 * 5 END AS top_k,
          CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'python' ELSE 'java' END AS want FROM benchmark),
{sql_embed('qv', 'req', 'query_id', 'query', DIM)},
p AS (SELECT query_id, doc_id, sum(qv.x * uz.x) AS s FROM qv JOIN uz USING (d) GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id % 2, doc_id) AS rank FROM p)
SELECT query_id, rank, language, func_name, md5(code) AS code_md5, round(s, 5) + 0.0::DOUBLE AS score
FROM ranked JOIN req USING (query_id) JOIN code_fixture USING (doc_id) WHERE rank <= top_k AND (want IS NULL OR want = language)"""


QUERIES = {
    "outline_nodes": (
        _flat_outline,
        f"WITH {SQL_OUTLINE} SELECT doc_id, id, type, text, start_row, start_col, end_row, end_col, parent_id, depth::BIGINT AS depth, "
        "is_named, child_count FROM nodes",
    ),
    "node_types": (
        lambda spark, d: node_types(outline(spark, d)),
        f"WITH {SQL_OUTLINE} SELECT DISTINCT doc_id, type FROM nodes",
    ),
    "parent_child_edges": (
        lambda spark, d: _wide(G.parent_child_edges(outline(spark, d))),
        f"WITH {SQL_OUTLINE} SELECT doc_id, parent_id AS src, id AS dst FROM nodes WHERE parent_id IS NOT NULL",
    ),
    "cap_nodes": (
        lambda spark, d: _wide(G.cap_nodes(outline(spark, d)).select("doc_id", "id", "type")),
        f"WITH {SQL_OUTLINE} SELECT doc_id, id, type FROM nodes WHERE id < 500",
    ),
    "tree_edges": (_edges(G.tree_edges), _edge_sql(SQL_TREE)),
    "sibling_edges": (_edges(G.sibling_edges), _edge_sql(SQL_SIBLING)),
    "control_flow_edges": (_edges(G.control_flow_edges), _edge_sql(sql_control())),
    "graph_edges": (_edges(G.graph_edges), f"WITH {SQL_OUTLINE}, {SQL_CAPPED}, {sql_edges()} SELECT * FROM edges"),
    "graph_edges_conversations": (
        lambda spark, d: G.graph_edges(turns(spark, d), control_types=CONVERSATION_CONTROL).select("doc_id", "src", "dst", "kind"),
        f"WITH {SQL_TURN_GRAPH} SELECT * FROM edges",
    ),
    "node_type_vocab": (
        lambda spark, d: G.node_type_vocab(outline(spark, d)),
        f"WITH {SQL_OUTLINE}, {SQL_VOCAB} SELECT type, type_id FROM vocab",
    ),
    "vocab_size": (
        lambda spark, d: G.vocab_size(G.node_type_vocab(outline(spark, d))),
        f"WITH {SQL_OUTLINE} SELECT count(DISTINCT type) AS vocab_size FROM nodes",
    ),
    "node_features": (features, f"WITH {SQL_CODE_GRAPH} {_SQL_FEATURE_ROWS} FROM feat"),
    "with_empty_graphs": (
        empty_graphs,
        f"WITH {SQL_CODE_GRAPH}, {SQL_DOCS}, {SQL_EMPTY} {_SQL_FEATURE_ROWS} FROM allfeat",
    ),
    "graph_batch_nodes": (
        lambda spark, d: batched(spark, d, 0),
        f"WITH {SQL_CODE_GRAPH}, {SQL_OFFSETS} SELECT batch_id, o + id AS node, doc_id, id FROM feat JOIN off USING (doc_id)",
    ),
    "graph_batch_edges": (
        lambda spark, d: batched(spark, d, 1),
        f"WITH {SQL_CODE_GRAPH}, {SQL_OFFSETS} SELECT batch_id, o + src AS src, o + dst AS dst FROM edges JOIN off USING (doc_id)",
    ),
    "type_embedding": (_on_turns(lambda x, e: x, "x"), _node_sql(f"{SQL_TURN_GRAPH}, {sql_start()}", "x0")),
    "gcn_propagate": (
        _on_turns(lambda x, e: P.gcn_propagate(x, e, weight(HIDDEN, HIDDEN)), "h"),
        _node_sql(f"{SQL_TURN_START}, {sql_gcn('c', 'x0', HIDDEN, 0)}", "c"),
    ),
    "gcn_propagate_no_weight": (
        _on_turns(lambda x, e: P.gcn_propagate(x, e), "h"),
        _node_sql(f"{SQL_TURN_START}, {sql_gcn('c', 'x0', HIDDEN, None)}", "c"),
    ),
    "gat_propagate": (
        _on_turns(lambda x, e: P.gat_propagate(x, e, weight(HIDDEN, HIDDEN), **gat_weights(HEADS)), "h"),
        _node_sql(f"{SQL_TURN_START}, {sql_gat('c', 'x0', HEADS, 0)}", "c"),
    ),
    "gat_propagate_mean_heads": (
        _on_turns(lambda x, e: P.gat_propagate(x, e, weight(HIDDEN, HIDDEN), **gat_weights(HEADS), concat=False), "h"),
        _node_sql(
            f"{SQL_TURN_START}, {sql_gat('c', 'x0', HEADS, 0)}, "
            f"m AS (SELECT doc_id, id, d % {CHANNELS} AS d, avg(x) AS x FROM c GROUP BY ALL)",
            "m",
        ),
    ),
    "residual_layer": (
        _on_turns(lambda x, e: P.residual_layer(x, e, gcn_layers(1)[0]), "x"),
        _node_sql(f"{SQL_TURN_START}, {sql_layers('gcn', 1)}", "x1"),
    ),
    "node_embeddings_gcn": (
        _on_turns(lambda x, e: P.node_embeddings(x, e, gcn_layers(N_LAYERS)), "x"),
        _node_sql(f"{SQL_TURN_START}, {sql_layers('gcn', N_LAYERS)}", f"x{N_LAYERS}"),
    ),
    "node_embeddings_gat": (
        _on_turns(lambda x, e: P.node_embeddings(x, e, gat_layers(N_LAYERS)), "x"),
        _node_sql(f"{SQL_TURN_START}, {sql_layers('gat', N_LAYERS)}", f"x{N_LAYERS}"),
    ),
    "graph_mean_max_pool": (
        pooled,
        f"WITH {SQL_TURN_START}, {sql_layers('gcn', 1)}, {sql_pool('x1', HIDDEN)} "
        f"SELECT doc_id, d AS dim, {sql_r6('x')} AS value FROM pool",
    ),
    "encode_code": (encoded, SQL_ENCODED),
    "frozen_statistics": (frozen_statistics, SQL_STATISTICS),
    "embed_snippet": (snippets, SQL_SNIPPETS),
    "index_code": (indexed_code, SQL_INDEXED),
    "search_code": (searched_code, sql_searched_code()),
}
