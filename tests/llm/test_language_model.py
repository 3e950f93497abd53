"""Kneser-Ney against a version over dictionaries; calibration and rejection."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import language as L

TEXTS = {"de": ["Der Hund läuft über die Straße.", "Das Haus, der Hof und der Hund", "Ein Haus"], "en": ["The dog runs over the road.", "A house, the yard and the dog", "THE HOUSE"], "x": ["zzz zzz"]}


def symbols(text):
    """Letters lower-cased, runs of anything else after a letter as one blank."""
    out = []
    for c in text:
        s = c.lower() if c.isalpha() else " "
        if s != " " or (out and out[-1] != " "):
            out.append(s)
    return out


def grams(text):
    padded = [" "] * (L.ORDER - 1) + symbols(text)
    return ["".join(padded[i : i + L.ORDER]) for i in range(len(padded) - L.ORDER + 1)]


def plain_models():
    counts = {lang: Counter(g for t in texts for g in grams(t)) for lang, texts in TEXTS.items()}
    alphabet = {g[-1] for c in counts.values() for g in c}
    models = {}
    for lang, top in counts.items():
        levels, own = {}, dict(top)
        for order in range(L.ORDER, 0, -1):
            total, kinds = defaultdict(float), Counter()
            for g, n in own.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            once, twice = (sum(n == c for n in own.values()) for c in (1, 2))
            d = min(0.95, max(0.1, (once + 0.5) / (once + 2 * twice + 1)))
            levels[order] = (own, total, kinds, d)
            shorter = Counter()
            for g in own:
                shorter[g[1:]] += 1
            own = shorter
        models[lang] = levels

    def p(lang, g):
        if not g:
            return 1 / (len(alphabet) + 1)
        own, total, kinds, d = models[lang][len(g)]
        lower, context = p(lang, g[1:]), g[:-1]
        if context not in total:
            return lower
        return max(own.get(g, 0) - d, 0) / total[context] + d * kinds[context] / total[context] * lower

    return p


def test_cross_entropy_against_dictionaries(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, texts in TEXTS.items() for t in texts)]
    model, _, _ = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    p = plain_models()
    for text in ["Der Hund", "the ROAD, again", "unseen words über alles", "q", "zz z"]:
        data = np.frombuffer(text.encode(), "u1")
        got, _ = model.cross_entropy(data, np.array([0, len(data)]))
        want = [-sum(math.log(p(lang, g)) for g in grams(text)) / len(grams(text)) for lang in model.langs]
        assert np.allclose(got[0], want, atol=1e-5), text


def test_probabilities_of_a_context_and_one_unseen_symbol_sum_to_one(spark):
    p = plain_models()
    alphabet = {g[-1] for texts in TEXTS.values() for t in texts for g in grams(t)}
    for context in ("der", " ha", "  t"):
        assert abs(sum(p("de", context + s) for s in alphabet) + p("de", context + "一") - 1) < 1e-9


def test_calibration_rows_are_not_counted_and_strangers_score_low(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    aside = rows.where(L.left_out(rows)).groupBy("lang").count().collect()
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    assert {r.lang for r in aside} == set(sizes) and all(0 < r["count"] < 0.2 * sizes[r.lang] for r in aside)
    few = rows.where("id < 10")
    assert few.where(L.left_out(few)).count() == 0  # a language of few documents is counted whole
    model, sharpness, highest = L.fit(docs, F.lit(True))
    assert np.isfinite(highest).all()
    strange = ["これは日本語の文章で、どの言語も知らない文字でできている。", "Это предложение написано по-русски и никому не знакомо.", "xqzw kjvq zzxw qqkj vwxz jqkx", "ψυχή και σώμα"]
    out = L.predict(spark.createDataFrame(list(enumerate(strange)), "doc_id bigint, text string"), model, sharpness, highest).collect()
    assert all(r.score < 0.5 and not r.accepted for r in out), out
    known = L.predict(docs, model, sharpness, highest).join(docs.select("doc_id", "lang"), "doc_id")
    assert known.where("accepted and lang_pred = lang").count() > 0.95 * docs.count()
