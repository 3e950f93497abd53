"""Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf; the leaves of a language, in order of their id, are a tree of fixed fanout, and the roots of the
languages are the leaves of one more tree.  The leaves lie in aligned partitions of ``fanout ** LEVELS``, each of which is a whole
subtree.  The partitions then climb together: in every round the partitions below one parent swap their subtree roots, and each hashes
the parent for itself.  After the last round every partition holds the roots and all siblings above it, so proofs are
written where the leaves are and nothing is passed down again.

In a full butterfly partner partitions have the same number within their subtrees.  Subtrees of unequal size (the last of a run,
languages) take turns: of a subtree of m partitions the one with number i serves those whose number in the parent is i modulo m.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import join_counted, stored
from corvane.operators.positions import with_positions
from corvane.runtime import spread_small

FANOUT = 8
# Levels of a partition's own tree: 4,096 leaves a partition.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values, each ``-`` if null, else its bytes' number, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, probe: Column | None = None) -> DataFrame:
    """``doc_id, lang, leaf`` and ``probe``, the digest to be verified (by default the leaf's own).  Only digests go on."""
    probed = leaf_digest([F.col(c) for c in FIELDS]) if probe is None else probe
    rows = spread_small(docs.select(*FIELDS))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.unhex(leaf_digest([F.col(c) for c in FIELDS])).alias("leaf"), F.unhex(probed).alias("probe"))


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The levels of a tree, leaves first: ``height`` levels up, or until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        out.append([_hash(out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def rounds(most: int, fanout: int) -> int:
    n = 0
    while fanout**n < most:
        n += 1
    return n


def _exchange(state: DataFrame, fanout: int) -> DataFrame:
    """One round.  ``state`` has, per partition: ``g`` and what it carries; the range of its subtree (``start, size``), the
    subtree's slot among the parent's children, the parent's range (``above, above_size``); a null slot sits out.

    A partition gets one row from every child of its parent, at most ``fanout``, and hands its own state to itself.
    """
    carried = [c for c in state.columns if c not in ("g", "above", "above_size")]
    places = F.sequence(F.col("g") - F.col("start"), F.col("above_size") - 1, F.col("size"))
    to = F.when(F.col("slot").isNotNull(), F.transform(places, lambda o: F.col("above") + o)).otherwise(F.array().cast("array<bigint>"))
    own = state.select("g", F.lit(None).cast("struct<slot:bigint,digest:string>").alias("node"), F.struct(*carried, "above", "above_size").alias("own"))
    sent = state.select(F.explode(to).alias("g"), F.struct("slot", "digest").alias("node"), F.lit(None).cast(own.schema["own"].dataType).alias("own"))
    met = sent.unionByName(own).groupBy("g").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.first("own", ignorenulls=True).alias("own"))
    slot = F.col("own.slot")
    text = lambda keep: F.array_join(F.transform(F.filter("nodes", keep), lambda n: n["digest"]), "")
    idle = slot.isNull()
    risen = {
        "digest": F.when(idle, F.col("own.digest")).otherwise(F.sha2(text(lambda n: F.lit(True)), 256)),
        "left": F.when(idle, F.col("own.left")).otherwise(F.array_append(F.col("own.left"), text(lambda n: n["slot"] < slot))),
        "right": F.when(idle, F.col("own.right")).otherwise(F.array_append(F.col("own.right"), text(lambda n: n["slot"] > slot))),
        "start": F.when(idle, F.col("own.start")).otherwise(F.col("own.above")),
        "size": F.when(idle, F.col("own.size")).otherwise(F.col("own.above_size")),
    }
    return met.select("g", *[risen.get(c, F.col(f"own.{c}")).alias(c) for c in carried if c != "slot"])


def prove(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per row of ``leaves``: ``doc_id, lang, leaf, probe, subroot, root`` and the proof: for every level, from the leaf to the
    root, what stands ``left`` and ``right`` of the own node in its run (digests as hex text, joined).

    Languages are ordered bytewise, null first; rows by id, null first, then by digest, so that rows that repeat an id have a
    defined order and equal rows are told apart by their place alone.  No rows give no rows.
    """
    per = fanout**levels
    placed = with_positions(rows, "lang", "doc_id", "leaf", name="at")
    langs = placed.groupBy("lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    langs = stored(with_positions(langs.withColumn("blocks", F.ceil(F.col("n") / per).cast("bigint")), "lang", name="k"), "languages")
    blocks = langs.select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b"))
    blocks = stored(with_positions(blocks, "k", "b", name="g"), "partitions")
    begins = blocks.where(F.col("b") == 0).select("k", F.col("g").alias("g0"))
    langs = stored(langs.join(begins, "k"), "languages")
    n_langs, most = langs.agg(F.count(F.lit(1)), F.max("blocks")).first()

    key = langs.select(F.col("lang").alias("_lang"), "first", "n", "g0", "blocks")
    placed = join_counted(placed, key, F.col("lang").eqNullSafe(F.col("_lang")), "n")
    at = F.col("at") - F.col("first")
    dealt = stored(placed.select((F.col("g0") + F.floor(at / per)).alias("g"), "at", "doc_id", "lang", "leaf", "probe", (F.col("blocks") == 1).alias("alone")), "leaves")

    def subtree(table: pa.Table) -> tuple[pa.Table, list[list[str]]]:
        table = table.sort_by("at")
        return table, levels_of([x.hex() for x in table["leaf"].to_pylist()], fanout, None if table["alone"][0].as_py() else levels)

    def root_of(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "digest": [subtree(table)[1][-1][0]]})

    tops = dealt.select("g", "at", "leaf", "alone").groupBy("g").applyInArrow(root_of, "g bigint, digest string")
    state = blocks.join(tops, "g").join(langs.select("k", "g0", "blocks").hint("broadcast") if n_langs < 100_000 else langs.select("k", "g0", "blocks"), "k")
    state = state.select("g", "k", "b", "g0", "blocks", "digest", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"), F.col("g").alias("start"), F.lit(1).cast("bigint").alias("size"))

    # Rounds within the languages: ranges follow from the number of partitions.
    for r in range(rounds(most or 0, fanout)):
        node, up = F.floor(F.col("b") / fanout**r), fanout ** (r + 1)
        above = F.floor(F.col("b") / up) * up
        state = _exchange(
            state.withColumns({
                "slot": F.when(F.col("blocks") > fanout**r, node % fanout),
                "above": F.col("g0") + above,
                "above_size": F.least(F.lit(up), F.col("blocks") - above).cast("bigint"),
            }),
            fanout,
        )
    state = state.withColumns({"subroot": F.col("digest"), "start": F.col("g0"), "size": F.col("blocks")}).drop("b", "g0", "blocks")
    # Rounds over the languages: a subtree's range is that of its languages' partitions.
    for r in range(rounds(n_langs, fanout)):
        up = fanout ** (r + 1)
        ranges = langs.groupBy(F.floor(F.col("k") / up).alias("_up")).agg(F.min("g0").alias("above"), F.sum("blocks").alias("above_size"))
        slot = F.floor(F.col("k") / fanout**r) % fanout
        state = _exchange(join_counted(state.withColumn("slot", slot), ranges, F.floor(F.col("k") / up) == F.col("_up"), "above_size").drop("_up"), fanout)
    state = stored(state.select("g", "subroot", F.col("digest").alias("root"), "left", "right"), "proofs")

    kinds = pa.list_(pa.string())

    def write(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table, tree = subtree(table)
        upper = above.to_pylist()[0]
        lefts, rights = [], []
        for k in range(table.num_rows):
            left, right, at = [], [], k
            for level in tree[:-1]:
                first = at - at % fanout
                left.append("".join(level[first:at]))
                right.append("".join(level[at + 1 : first + fanout]))
                at //= fanout
            lefts.append(left + upper["left"])
            rights.append(right + upper["right"])
        many = table.num_rows
        return pa.table({
            "doc_id": table["doc_id"], "lang": table["lang"], "leaf": pa.array(tree[0], pa.string()), "probe": pa.array([x.hex() for x in table["probe"].to_pylist()], pa.string()),
            "subroot": pa.array([upper["subroot"]] * many, pa.string()), "root": pa.array([upper["root"]] * many, pa.string()), "left": pa.array(lefts, kinds), "right": pa.array(rights, kinds),
        })

    schema = "doc_id bigint, lang string, leaf string, probe string, subroot string, root string, left array<string>, right array<string>"
    return dealt.groupBy("g").cogroup(state.groupBy("g")).applyInArrow(write, schema)


def fold(digest: Column, left: Column, right: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    return F.aggregate(F.arrays_zip(left.alias("left"), right.alias("right")), digest, lambda own, level: F.sha2(F.concat(level["left"], own, level["right"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """sha256 of all siblings, level by level to the root, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def manifest(docs: DataFrame, probe: Column | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``probe`` is the digest (hex text) that is verified against the row's proof; by default, and where it is the row's own,
    ``verified`` is true.
    """
    out = prove(leaves(docs, probe))
    folded = out.withColumn("folded_root", fold(F.col("probe"), F.col("left"), F.col("right")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered_where_third(modulus: int = 3) -> Column:
    """A tampered leaf: A to Z of the text lower-cased where ``modulus`` divides the id's crc32; rows without an id stay."""
    odd = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % modulus == 0
    text = F.col("text").cast("string")
    lowered = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)
    return leaf_digest([lowered if c == "text" else F.col(c) for c in FIELDS])
