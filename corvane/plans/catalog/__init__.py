"""Registered queries: name -> (Spark query over a table folder, equivalent SQL or None)."""

from __future__ import annotations


def load() -> dict[str, tuple]:
    from corvane.plans.catalog import evaluation, examples, graphs, learning, search, storage, text, vectors

    out: dict[str, tuple] = {}
    for module in (text, vectors, graphs, search, learning, evaluation, examples, storage):
        overlap = out.keys() & module.QUERIES.keys()
        assert not overlap, overlap
        out.update(module.QUERIES)
    return out
