"""Registered queries of the training-data operators at the smallest size, and the pipeline by brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from check_oracle import compare, duck
from tokenizers import Tokenizer

import corpus_pipeline
from weekloom.llm.queries import ORACLES, QUERIES, quality_model

SF = "/root/testdata/sf0.001"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, duck(SF), name, SF)[0] == "ok"


def test_packing(spark, texts):
    rows = QUERIES["op1_vector_packing"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and {r["law"] for r in rows} == {"bytes"}
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode()))
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tokens(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op2_pair_index_bpe"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_language_accuracy(spark):
    true = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op4_output_codes_language"](spark, SF).collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows) and len(rows) == len(true)
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95


def test_quality_accuracy(spark):
    true = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = QUERIES["op10_naive_bayes_support_vectors"](spark, SF).collect()
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == true[r["doc_id"]] for r in rows if r["doc_id"] in true]) > 0.9


def test_pages(spark):
    from html import unescape

    raw = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())

    def article(page):
        inside = page[page.index("<article>") : page.index("</article>")]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</p>|</h1>", inside))
        return "\n".join(b for b in blocks if b)

    rows = QUERIES["op9_boosted_dom_trees"](spark, SF).collect()
    assert len(rows) == len(raw)
    assert np.mean([r["text"] == article(raw[r["page_id"]]) for r in rows]) > 0.95


def test_pipeline(spark, texts):
    """Every stage by brute force on what the one before kept."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    scores = quality_model(spark, SF)
    import pyarrow as pa

    ids = sorted(texts)
    good = scores.scores(pa.array([texts[i] for i in ids])) >= 0.7
    docs = {i: texts[i] for i, ok in zip(ids, good) if ok}
    last = {}
    for i in sorted(docs):
        last[docs[i].translate(lower)] = i
    docs = {i: docs[i] for i in last.values()}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = {i: t for i, t in docs.items() if find(i) == i}

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))

    grams = set()
    for (text,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall():
        w = words(text)
        grams |= {tuple(w[p : p + 13]) for p in range(max(1, len(w) - 12))}

    def clean(text):
        w, hit = words(text), set()
        for p in range(len(w)):
            for n in {len(g) for g in grams}:
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
        return not hit or 20 * len(hit) < len(w)

    docs = {i: t for i, t in docs.items() if clean(t)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in rows} == {
        i: (library.encode(t, add_special_tokens=False).ids, t) for i, t in docs.items()
    }


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
