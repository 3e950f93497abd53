"""The operators' queries on the smallest tables: against SQL, brute force, another library or held-out labels."""

import collections
import hashlib
import html
import re
import zlib

import pytest
from oracle import compare, connect

import corpus_pipeline
from corvane.llm.queries import QUERIES, ranks_path

SF_DIR, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def rows(spark, name, sf_dir=SF_DIR):
    return QUERIES[name][0](spark, sf_dir).collect()


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    query, sql = QUERIES[name]
    assert compare(spark, connect(SF_DIR), SF_DIR, query, sql) == ""


def test_html_is_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_MORE}/pages.parquet").collect()}
    out = rows(spark, "op1_html_blocks", SF_MORE)
    assert len(out) == len(pages)
    for r in out:
        page = pages[r.page_id]
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", article))]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def base_pii(text):
    """The patterns as they are written down."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits[::-1])) % 10 == 0
        if 14 <= len(digits) <= 19 and luhn:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_spans_stay(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").collect()}
    secrets = 0
    for r in rows(spark, "op3_pii_crf", SF_MORE):
        base = base_pii(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        joined = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == sha(",".join(joined).encode())
        spans = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(spans)
        secrets += sum(s.startswith("secret:") for s in spans)
        assert len(spans) - len(base) <= 5
    assert secrets > 5


def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    out = rows(spark, "op5_quality_cnn", SF_MORE)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [(labels[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_language_on_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").collect()}
    out = rows(spark, "op8_language_kn", SF_MORE)
    held = [langs[r.doc_id] == r.lang_pred for r in out if r.held_out]
    assert len(out) == len(langs) and sum(held) >= 0.98 * len(held)


def test_tokens_like_the_reference_encoder(spark, docs):
    import tiktoken

    from corvane.llm.bpe import PATTERN, read_ranks

    encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(ranks_path()))}, special_tokens={})
    for r in rows(spark, "op9_byte_bpe"):
        ids = encoder.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(b"".join(i.to_bytes(4, "little") for i in ids))
        assert r.decoded_sha256 == sha(docs[r.doc_id].encode())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return set(zip(words, words[1:], words[2:])) if len(words) >= 3 else {tuple(words)} if words else set()


def near_components(texts):
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in holders[g]).items():
            if i != j and 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_duplicates_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").collect()}
    want = near_components(texts)
    out = rows(spark, "op7_minhash_hamming", SF_MORE)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def without_shared(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        gone = [False] * len(data)
        strings = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, s in enumerate(strings):
            if s in seen:
                gone[k : k + 50] = [True] * 50
        seen.update(strings)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone) if not g)))
    return out


@pytest.mark.parametrize("heavy", [None, 1_000])
def test_shared_passages_by_brute_force(spark, docs, heavy, monkeypatch):
    from corvane.llm import suffix

    if heavy:
        monkeypatch.setattr(suffix, "HEAVY_BYTES", heavy)
        monkeypatch.setattr(suffix, "SHARD_SEGMENTS", 64)
    out = rows(spark, "op10_bwt_merge")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == without_shared(docs)


def test_pipeline_against_a_plain_version(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR).collect()}
    good = {i: docs[i] for i in docs if i in kept}
    groups = collections.defaultdict(list)
    for i, t in good.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append(i)
    left = {i: good[i] for i in (min(g, key=lambda i: (-len(good[i]), i)) for g in groups.values())}
    left = {i: left[i] for i, (_, c) in near_components(left).items() if i == c}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = words(r.text)
        windows.update(tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w)
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(t[k : k + n]) in windows for n in sizes for k in range(len(t) - n + 1))
    left = {i: t for i, t in left.items() if not hit(words(t))}
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: sha(t.encode()) for i, t in left.items()}
