"""One query per operator over its whole table: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.common import crc_mod, table


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.html_blocks import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


SQL_OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw,
         replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') AS text,
         replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), '|>', '|\>') AS shown
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (
  SELECT t.*, speaker,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || shown || '|>' || chr(10) END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered,
         coalesce(sum(length(head || text || '<|end|>' || chr(10))) OVER (
           PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM r)
SELECT conv_id, speaker, turn, role, rendered, start, start + length(rendered) AS stop,
       CASE WHEN role = speaker THEN start + length(head) END AS mask_start,
       CASE WHEN role = speaker THEN start + length(head) + length(text) END AS mask_stop
FROM o
"""


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.exact_dedup import exact_dedup

    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL_OP4 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def op6_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.phrases import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_OP6 = rf"""
WITH b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, greatest(len(w) - 8, 2))]) AS k, least(len(w), 10) AS n
  FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, n, unnest([{{'s': i, 'k': array_to_string(w[i:i + n - 1], ' ')}} FOR i IN range(1, len(w) - n + 2)]) AS g
  FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT DISTINCT doc_id, item_id, g.s AS s, grams.n AS n FROM grams JOIN win ON g.k = win.k AND grams.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def ranks_path() -> str:
    """The vocabulary of op9 and of the pipeline's last stage."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.bpe import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), ranks_path())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def held_out(modulus: int, remainder: int) -> Column:
    return (crc_mod(F.col("doc_id"), modulus) == remainder).alias("held_out")


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import quality as q

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = q.train(*q.training_sample(docs, labels, crc_mod(F.col("id"), 5) != 0, "quality"))
    out = q.score_documents(docs, net)
    return out.select("doc_id", held_out(5, 0), "score", (F.col("score") >= q.THRESHOLD).cast("int").alias("predicted"))


def op7_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.language import fit, predict

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, *fit(docs, crc_mod(F.col("id"), 4) != 2))
    return out.select("doc_id", held_out(4, 2), "lang_pred", "score", "cross_entropy", "accepted")


def op10_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.suffix import remove_shared_passages

    return remove_shared_passages(table(spark, sf_dir, "documents"))


def op11_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.merkle import lowered_where_third, manifest

    return manifest(table(spark, sf_dir, "documents"), lowered_where_third())


# Levels of the trees in the SQL below: enough for 8 ** 8 leaves a language.
SQL_LEVELS = 8


def _sql_op11() -> str:
    """The levels of both trees written out; crc32 bit by bit."""
    def field(name: str) -> str:
        return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"

    def climb(tree: str, part: str, last: str) -> str:
        out = ""
        for k in range(SQL_LEVELS):
            own, up = f"{tree}{k}", f"{tree}{k + 1}"
            out += f"""
{own}n AS (SELECT *, count(*) OVER (PARTITION BY {part}) AS many FROM {own}),
{own}s AS (
  SELECT {part}, p, CASE WHEN many > 1 THEN p // 8 ELSE p END AS up,
         coalesce(string_agg(d, '') OVER (g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l{tree}{k},
         coalesce(string_agg(d, '') OVER (g ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r{tree}{k}, many > 1 AS on{tree}{k}
  FROM {own}n WINDOW g AS (PARTITION BY {part}, CASE WHEN many > 1 THEN p // 8 ELSE p END)),
{up} AS (
  SELECT {part}, CASE WHEN many > 1 THEN p // 8 ELSE p END AS p, CASE WHEN any_value(many) > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d
  FROM {own}n GROUP BY {part}, CASE WHEN many > 1 THEN p // 8 ELSE p END),"""
        return out

    def joins(tree: str, part: str, alias: str) -> str:
        out, at = "", f"{alias}.p0"
        for k in range(SQL_LEVELS):
            out += f"\n  JOIN {tree}{k}s ON {tree}{k}s.{part} IS NOT DISTINCT FROM {alias}.{part} AND {tree}{k}s.p = {at}"
            at = f"{tree}{k}s.up"
        return out

    names = [f"{t}{k}" for t in ("a", "b") for k in range(SQL_LEVELS)]
    siblings = " || ".join(f"l{n} || r{n}" for n in names)
    folded = "f0"
    steps = ""
    for k, n in enumerate(names):
        steps += f"\nfold{k + 1} AS (SELECT * REPLACE (CASE WHEN on{n} THEN sha256(l{n} || f0 || r{n}) ELSE f0 END AS f0) FROM fold{k}),"
    text_leaf = "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i:i])::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
    return f"""
WITH docs AS (
  SELECT *, {text_leaf.format(text="text")} AS leaf, {text_leaf.format(text="CASE WHEN odd THEN " + lowered + " ELSE text END")} AS probe
  FROM (SELECT *, coalesce({crc} % 3 = 0, false) AS odd FROM documents)),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS k FROM (SELECT DISTINCT lang FROM docs)),
placed AS (SELECT docs.*, k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p0 FROM docs JOIN langs ON docs.lang IS NOT DISTINCT FROM langs.lang),
a0 AS (SELECT k, p0 AS p, leaf AS d FROM placed),{climb("a", "k", "")}
tops AS (SELECT k, d AS subroot FROM a{SQL_LEVELS}),
b0 AS (SELECT 0 AS one, k AS p, subroot AS d FROM tops),{climb("b", "one", "")}
upper AS (
  SELECT t.k, t.subroot, (SELECT d FROM b{SQL_LEVELS}) AS root, {", ".join(f"lb{k}, rb{k}, onb{k}" for k in range(SQL_LEVELS))}
  FROM (SELECT k, subroot, k AS p0, 0 AS one FROM tops) t{joins("b", "one", "t")}),
fold0 AS (
  SELECT p.doc_id, p.leaf, subroot, root, p.probe AS f0, {", ".join(f"la{k}, ra{k}, ona{k}" for k in range(SQL_LEVELS))}, {", ".join(f"lb{k}, rb{k}, onb{k}" for k in range(SQL_LEVELS))}
  FROM placed p{joins("a", "k", "p")}
  JOIN upper ON upper.k = p.k),{steps}
done AS (SELECT *, sha256({siblings}) AS proof_sha256 FROM fold{len(names)})
SELECT doc_id, leaf, subroot, root, proof_sha256, {folded} AS folded_root, {folded} = root AS verified FROM done
"""


SQL_OP11 = _sql_op11()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.alignment import align_documents

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(table(spark, sf_dir, "documents"), *paths)[0]


# The rules of op13: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.url_rules import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL_OP13 = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT row, rhost || rpath AS rule, r.verdict, row_number() OVER (PARTITION BY row ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN f ON h.row = f.row AND k = 1
"""


QUERIES = {
    "op1_html_blocks": (op1_html_blocks, None),
    "op2_chat_rotation": (op2_chat_rotation, SQL_OP2),
    "op3_pii_crf": (op3_pii_crf, None),
    "op4_exact_dedup": (op4_exact_dedup, SQL_OP4),
    "op5_quality_cnn": (op5_quality_cnn, None),
    "op6_phrase_index": (op6_phrase_index, SQL_OP6),
    "op7_minhash_hamming": (op7_minhash_hamming, None),
    "op8_language_kn": (op8_language_kn, None),
    "op9_byte_bpe": (op9_byte_bpe, None),
    "op10_bwt_merge": (op10_bwt_merge, None),
    "op11_merkle_butterfly": (op11_merkle_butterfly, SQL_OP11),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_url_prefixes": (op13_url_prefixes, SQL_OP13),
}
