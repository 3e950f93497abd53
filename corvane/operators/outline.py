"""Structural outline of source code: one node per non-blank line, nested by indentation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import language_guard, node_text, strip

# Node type by the first pattern found in the stripped line.
NODE_TYPES = (
    ("class_declaration", r"^(public |private |protected )?(abstract |final )?class\b"),
    ("function_definition", r"^(async )?def\b|^(async )?function\b"),
    ("method_declaration", r"^(public|private|protected)\b.*\("),
    ("if_statement", r"^(\} ?)?(if|elif|else)\b"),
    ("for_statement", r"^for\b"),
    ("while_statement", r"^while\b"),
    ("try_statement", r"^(\} ?)?(try|except|catch|finally)\b"),
    ("switch_statement", r"^(switch|match)\b"),
    ("return_statement", r"^return\b"),
    ("comment", r"^(#|//|/\*|\*)"),
    ("bracket", r"^[\[\](){};,]+$"),
)
ROOT_TYPE, OTHER_TYPE, UNNAMED_TYPE = "module", "line", "bracket"


def line_type(line: Column) -> Column:
    kind = None
    for name, pattern in NODE_TYPES:
        here = line.rlike(pattern)
        kind = F.when(here, F.lit(name)) if kind is None else kind.when(here, F.lit(name))
    return kind.otherwise(F.lit(OTHER_TYPE))


def _nest_batch(indents: pa.Array) -> pa.Array:
    """Parent (nearest earlier line of smaller indent), depth and child count; entry 0 is the root."""
    lengths = indents.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) + 1
    starts = np.cumsum(lengths) - lengths
    root = np.repeat(starts, lengths)
    place = np.arange(lengths.sum())
    is_root = place == root
    indent = np.full(len(place), -1, "i8")
    indent[~is_root] = indents.flatten().to_numpy(zero_copy_only=False)
    # The nearest earlier entry of smaller indent: a candidate that is not smaller gives way to its own candidate,
    # for all entries at once, so a run of equal indents takes as many steps as its length has binary digits.
    nearest = np.where(is_root, place, place - 1)
    open_ = np.flatnonzero(~is_root & (indent[nearest] >= indent))
    while len(open_):
        nearest[open_] = nearest[nearest[open_]]
        open_ = open_[indent[nearest[open_]] >= indent[open_]]
    depth, up = np.zeros(len(place), "i4"), nearest.copy()
    live = np.flatnonzero(~is_root)
    while len(live):
        depth[live] += 1
        live = live[up[live] != root[live]]
        up[live] = nearest[up[live]]
    children = np.bincount(nearest[~is_root], minlength=len(place)).astype("i4")
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("i4"))
    fields = [pa.array((nearest - root).astype("i4"), mask=is_root), pa.array(depth), pa.array(children)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["parent_id", "depth", "child_count"]))


def _nest(indents: Column) -> Column:
    return F.arrow_udf(_nest_batch, "array<struct<parent_id:int,depth:int,child_count:int>>")(indents)


def _lines(raw: Column) -> Column:
    """The lines that are not blank: row, column of the first character, stripped text."""
    found = F.filter(
        F.transform(raw, lambda line, row: F.struct(row.alias("row"), line.alias("raw"), strip(line).alias("line"))),
        lambda s: s["line"] != "",
    )
    return F.transform(
        found,
        lambda s: F.struct(s["row"].alias("row"), (F.instr(s["raw"], F.substring(s["line"], 1, 1)) - 1).alias("col"), s["line"].alias("line")),
    )


def with_outline(records: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """``records`` with the outline of their code in their own row: arrays ``_types, _parents, _depths, _children`` by node id.

    Without rules for the language, or without code, the arrays are empty; ``max_nodes`` keeps the first nodes.
    """
    known = language_guard(F.col("language")) & F.col("code").isNotNull()
    rows = records.withColumn("_lines", F.when(known, _lines(F.split("code", "\n", -1))))
    rows = rows.withColumn("_nest", _nest(F.transform("_lines", lambda s: s["col"])))
    kinds = F.concat(F.array(F.lit(ROOT_TYPE)), F.transform("_lines", lambda s: line_type(s["line"])))

    def of(array: Column, kind: str) -> Column:
        kept = array if max_nodes is None else F.slice(array, 1, max_nodes)
        return F.when(F.col("_lines").isNotNull(), kept).otherwise(F.array().cast(f"array<{kind}>"))

    nest = F.col("_nest")
    return rows.withColumns({
        "_types": of(kinds, "string"),
        "_parents": of(nest["parent_id"], "int"),
        "_depths": of(nest["depth"], "int"),
        "_children": of(nest["child_count"], "int"),
    }).drop("_lines", "_nest")


OUTLINE_COLUMNS = ("_types", "_parents", "_depths", "_children")


def outlined(records: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """``with_outline`` of records that may have their whole outline already: then only the first nodes are taken of it."""
    if not set(OUTLINE_COLUMNS) <= set(records.columns):
        return with_outline(records, max_nodes)
    return records if max_nodes is None else records.withColumns({c: F.slice(c, 1, max_nodes) for c in OUTLINE_COLUMNS})


def outline_nodes(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Node table (key, id, type, text, start_point, end_point, parent_id, depth, is_named, child_count).

    Ids are dense and in pre-order; node 0 is the file.  The nesting is one pass over the indents of
    a file inside its own row, so there is no self-join of lines and no shuffle.
    """
    known = language_guard(F.col("language")) & F.col("code").isNotNull()
    split = records.where(known).select(key, node_text(F.col("code")).alias("head"), F.split("code", "\n", -1).alias("raw"))
    raw = F.col("raw")
    lines = _lines(raw)
    spans = F.transform(
        "lines",
        lambda s: F.struct(s["row"], s["col"], s["line"], s["row"].alias("end_row"), (s["col"] + F.length(s["line"])).alias("end_col")),
    )
    root = F.struct(
        F.lit(0).alias("row"),
        F.lit(0).alias("col"),
        F.col("head").alias("line"),
        (F.size(raw) - 1).alias("end_row"),
        F.length(F.element_at(raw, -1)).alias("end_col"),
    )
    found = split.select(key, "head", "raw", lines.alias("lines"))
    # The file's text ends here: only its lines go on, one per row.
    nested = found.select(
        key, F.concat(F.array(root), spans).alias("src"), _nest(F.transform("lines", lambda s: s["col"])).alias("nest")
    )
    flat = nested.select(key, F.posexplode_outer(F.arrays_zip("src", "nest")).alias("id", "p")).select(key, "id", "p.src", "p.nest")
    kind = F.when(F.col("id") == 0, F.lit(ROOT_TYPE)).otherwise(line_type(F.col("src.line")))
    return flat.withColumn("type", kind).select(
        key,
        "id",
        "type",
        node_text(F.col("src.line")).alias("text"),
        F.struct(F.col("src.row").alias("row"), F.col("src.col").alias("col")).alias("start_point"),
        F.struct(F.col("src.end_row").alias("row"), F.col("src.end_col").alias("col")).alias("end_point"),
        F.col("nest.parent_id").alias("parent_id"),
        F.col("nest.depth").alias("depth"),
        (F.col("type") != UNNAMED_TYPE).alias("is_named"),
        F.col("nest.child_count").alias("child_count"),
    )


def node_types(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    return nodes.select(key, "type").distinct()
