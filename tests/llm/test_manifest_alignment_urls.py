"""Merkle manifest, token alignment and URL rules: plain versions, edge cases, forced second ways."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from corvane.llm import alignment, common, merkle, url_rules
from corvane.llm.queries import QUERIES, URL_RULES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- URL rules ---------------------------------------------------------------------------------------------------


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    stop = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
    path = rest[stop:].split("?")[0].split("#")[0]
    fits = []
    for h, p, v in rules:
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h or "")
        if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            fits.append((len(h + (p or "")), len(h), h + (p or ""), v))
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, default)


URLS = [
    None, "", "example.net/en/", "://", "http://", "https://a.net", "https://a.net/", "https://NET/x", "https://net", "https://xnet/", "https://example.net/en/1?x=/de/", "https://www.EXAMPLE.net/en", "https://example.net/EN/",
    "https://example.com/de/", "https://m.example.com/de/x#y", "https://example.com/d", "https://a.b.c.org/fr/", "https://org/fr", "ftp://u@a.net:80/en/", "https://a.net:80/en/", "x://y://a.net/", "https://a.net./", "https://.net/",
    "https://a.net?q=/", "https://a.net#/", "https://é.net/ü", "https://a..org/fr/", "https://example.org//fr/", "https://" + "a." * 3000 + "net/" + "b/" * 3000, "https://example.com/\nde/",
]
MORE_RULES = [*URL_RULES, ("a.net", "", "allow"), ("Example.com", "/d", "allow"), ("org", "//fr", "block"), ("net", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("b.c.org", None, "block"), ("c.org", "/fr/x", None)]


def judged(spark, rules, urls=URLS, **more):
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id int, url string, host int")
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: tuple(r)[2:] for r in url_rules.judge(pages, rules, **more).collect()}


@pytest.mark.parametrize("rules", [URL_RULES, MORE_RULES, []])
def test_urls_against_plain_rules(spark, rules):
    # Of rules with the same host and path the blocking one stands.
    stands = {}
    for h, p, v in rules:
        key = ((h or "").lower(), p or "")
        stands[key] = max(v or "", stands.get(key, ""))
    plain = [(h, p, v) for (h, p), v in stands.items()]
    assert judged(spark, rules) == {k: plain_verdict(u, plain) for k, u in enumerate(URLS)}


def test_urls_salted_join_and_weak_prefix(spark, monkeypatch):
    want = judged(spark, MORE_RULES)
    monkeypatch.setattr(url_rules, "is_small", lambda df: False)
    monkeypatch.setattr(url_rules, "PREFIX_DIGITS", 1)  # many expressions share a prefix: the digest has to tell them apart
    assert judged(spark, MORE_RULES) == want


def test_urls_repeats_empty_table_and_filter(spark):
    pages = spark.createDataFrame([(1, "https://a.net/", "x"), (1, "https://a.net/", "y"), (None, None, None), (2, "https://b.org/", "z")], "page_id bigint, url string, row string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert sorted(map(str, url_rules.judge(pages, rules).select("page_id", "verdict").collect())) == sorted(
        ["Row(page_id=1, verdict='block')"] * 2 + ["Row(page_id=None, verdict='allow')", "Row(page_id=2, verdict='allow')"]
    )
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.row for r in url_rules.keep_allowed(pages, rules).collect()} == {None, "z"}
    assert {r.verdict for r in url_rules.judge(pages, rules, default="block").where("page_id = 2").collect()} == {"block"}


def test_urls_stay_in_the_jvm(spark):
    plan = QUERIES["op13_url_prefixes"][0](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- Merkle manifest ---------------------------------------------------------------------------------------------


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, fanout):
    """Root, and per leaf its proof as (left, right) of every level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, own in enumerate(at):
            first = own - own % fanout
            proofs[k].append(("".join(level[first:own]), "".join(level[own + 1 : first + fanout])))
        level, at = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)], [own // fanout for own in at]
    return level[0], proofs


def plain_manifest(rows, fanout=8):
    """Sorted results of (doc_id, text, lang, source, n_chars) rows."""
    langs = {}
    for doc_id, text, lang, source, n in rows:
        odd = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if odd and text is not None else text
        leaf, probe = (sha("".join(map(field, (doc_id, source, lang, n, t)))) for t in (text, low))
        langs.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), leaf, doc_id, probe))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_tree([r[1] for r in sorted(langs[x], key=lambda r: r[:2])], fanout) for x in order]
    root, upper = plain_tree([t[0] for t in trees], fanout)
    out = []
    for lang, (subroot, proofs), above in zip(order, trees, upper):
        for row, proof in zip(sorted(langs[lang], key=lambda r: r[:2]), proofs):
            folded = row[3]
            for left, right in proof + above:
                folded = sha(left + folded + right)
            out.append((row[2], row[1], subroot, root, sha("".join(x + y for x, y in proof + above)), folded, folded == root))
    return sorted(map(str, out))


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, left string"


def manifest(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    out = merkle.prove(merkle.leaves(docs, merkle.lowered_where_third()), **more)
    out = out.withColumn("folded", merkle.fold(out.probe, out.left, out.right))
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(out.left, out.right), "folded", out.folded == out.root)
    return sorted(str(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("fanout,levels", [(8, 4), (3, 1), (8, 0)])
def test_manifest_against_plain_trees(spark, fanout, levels):
    rng = random.Random(fanout)
    rows = [(k, f"Text {k} ÄB", rng.choice(["en"] * 20 + ["de", "fr", "x", "é", None]), "s", k) for k in range(60)]
    rows += [(5, "Text again", "en", "s", 1)] * 3 + [(5, None, "en", None, None), (None, "A", None, None, None), (7, "", "one", "", 0)]
    assert manifest(spark, rows, fanout=fanout, levels=levels) == plain_manifest(rows, fanout)


def test_manifest_of_one_row_many_languages_and_none(spark):
    one = [(3, "Abc", "en", "s", 3)]
    assert manifest(spark, one) == plain_manifest(one)
    many = [(k, "T", f"l{k:03}", None, None) for k in range(40)]
    assert manifest(spark, many, fanout=4, levels=1) == plain_manifest(many, 4)
    assert manifest(spark, []) == []


def test_manifest_languages_joined_by_count(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 150)  # a few languages are sent, the others shuffled
    rows = [(k, f"Text {k}", "en" if k % 3 else f"l{k % 20:02}", "s", k) for k in range(60)]
    assert manifest(spark, rows, fanout=4, levels=1) == plain_manifest(rows, 4)


def test_manifest_finds_any_change(spark):
    rows = [(k, f"text {k}", "en", "s", k) for k in range(30)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    from pyspark.sql import functions as F

    changed = merkle.leaf_digest([F.when(F.col("doc_id") == 11, F.lit(-1)).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    assert [r.doc_id for r in merkle.manifest(docs, changed).where("not verified").collect()] == [11]
    assert merkle.manifest(docs).where("not verified").count() == 0


# --- Token alignment ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = alignment.byte_level_alphabet()

    def tokens(text):
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        bytes_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b if (p := two.id_to_piece(i)) is not None]
        return a, [bytes(letters[c] for c in one.id_to_token(i)) for i in a], b, bytes_b

    return tokens


def plain_alignment(texts, tokens):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    out, holds = [], Counter()
    for text in texts:
        a, bytes_a, b, bytes_b = tokens(text or "")
        want = f" {text}".encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append(None)
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links, first = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, ia, ib = [], 0, 0
        for c in cuts:
            ja = next(k for k in range(ia, len(a)) if spans[0][k][1] == c) + 1
            jb = next(k for k in range(ib, len(b)) if spans[1][k][1] == c) + 1
            groups.append(",".join(map(str, a[ia:ja])) + "|" + ",".join(map(str, b[ib:jb])))
            ia, ib = ja, jb
        holds.update(set(links))
        out.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (x, _), n in holds.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(holds[p] == best[p[0]] for p in r[3]), sum(holds[p] for p in r[3]), sha(r[4]))
        for r in out
    ]


def aligned(spark, texts):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id int, text string, n_a int")
    out, _ = alignment.align_documents(docs, A, B)
    return [tuple(r)[1:] for r in out.orderBy("doc_id").collect()]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "Hello, world!", "hello  world\n\n\tend ", "<|endoftext|> and <s>x</s> <unk> <0x41>", "a▁b", "▁", "naïve café — “quotes” 日本語 🙂🙂 e\u0301", "\x00\x01", "\r\n", "aaaa" * 50,
    "Hello, world!", "1234567890 12,345.67", "\u00a0x\u3000y", "İstanbul ŉ ǅ", "I'm we've it's",
]


def test_alignment_against_plain_version(spark, plain_tokens):
    assert aligned(spark, ODD) == plain_alignment(ODD, plain_tokens)


def test_alignment_of_a_table(spark, plain_tokens):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_token_alignment"][0](spark, SF_DIR).collect()}
    want = plain_alignment([r.text for r in rows], plain_tokens)
    assert got == {r.doc_id: w for r, w in zip(rows, want)}


def test_alignment_in_parts_rare_pairs_shuffled(spark, plain_tokens, monkeypatch):
    """Long texts cut, links in several rows, counts handed on early, and few counts sent to every task."""
    words = [t for t in ODD if t] + ["over the hill"] * 20
    texts = [" ".join(random.Random(k).choices(words, k=40)) for k in range(6)] + ["x" * 700, "é" * 300, None, "a▁b " * 90]
    want = plain_alignment(texts, plain_tokens)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 4000)
    v, parts = alignment.vocabularies(A, B), alignment.parts
    for text, row in zip(texts, want):
        if not text:
            continue
        cut = parts(text, v.cuttable, 100)
        assert " ".join(cut) == text and (len(cut) > 1 or text[0] in "xé")
        monkeypatch.setattr(alignment, "parts", lambda t, c: cut)  # noqa: B023
        total, digest, links = alignment._long(text, v)
        assert (*total.values(), digest) == (*row[:4], row[6])
        assert sum(links["times"].to_pylist()) == row[3]
        whole = alignment.align([text], [False], v)[2] if row[0] else links.slice(0, 0)
        assert sorted(zip(links["pair"].to_pylist(), links["times"].to_pylist())) == sorted(zip(whole["pair"].to_pylist(), whole["times"].to_pylist()))
    monkeypatch.undo()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 4000)
    assert aligned(spark, texts) == want


def test_alignment_long_text_and_empty_table(spark, plain_tokens):
    text = "Ein langer Text über vieles, 1234 times over. " * 30000
    got = aligned(spark, [text, "short"])
    assert got == plain_alignment([text, "short"], plain_tokens)
    assert aligned(spark, [""]) == [(0,) * 6 + ("",)]
    assert spark.createDataFrame([], "doc_id int, text string").transform(lambda d: alignment.align_documents(d, A, B)[0]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_both_encoders_of_the_first_vocabulary(plain_tokens, text):
    assert alignment.vocabularies(A, B).encode_a([" " + text])[0].tolist() == plain_tokens(text)[0]
