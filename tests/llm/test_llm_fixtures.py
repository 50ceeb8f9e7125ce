"""Operators for training data on small hand-made tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weekloom.llm import bpe, chat, contamination, exact, html, language, neardup, quality, repeats, sharding, words
from weekloom.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Further columns that repeat names operators use, or differ from one in case only.
ODD = "doc_id bigint, text string, shard int, kept boolean, tokens string, key string, id string, spans string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def invented(seed, n, vocabulary=400):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdeéñx") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    return [" ".join(r.choice(names) for _ in range(r.randint(0, 120))) for _ in range(n)]


def corpus(seed=5):
    """Texts with copies, near copies, shared passages, a hot group, empty ones and a very long one."""
    r = random.Random(seed)
    base = invented(seed, 40)
    passage = " ".join(f"shared{i}" for i in range(30))
    out = list(base)
    out += [t.upper() for t in base[:5]] + base[5:12]
    for t in base[12:24]:
        w = t.split()
        if w:
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{t} {passage} end{i}" for i, t in enumerate(base[24:32])] + [f"{passage} {passage}"]
    out += ["hot text of eight words said very often"] * 40
    out += [None, "", " \t\n", "one", "one", "ONE", "é É", " ".join(base) * 8]
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip(ids, out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, None, None, None, None) for i, t in corpus()]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, extra int")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, ids with several texts."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long), (1, long), (1, long), (2, None), (2, ""), (3, long + " more"), (3, "other words"), (None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def rows_by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# 1 sharding


def packed_well(rows, shards):
    slots, sizes, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return [sizes[s] for s in range(shards)], where


def test_packing_keeps_groups_together_and_sizes_even(spark, docs):
    rows = sharding.pack_documents(docs, 4).collect()
    texts = dict(corpus())
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.items()
    }
    sizes, where = packed_well(rows, 4)
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= largest
    hot = len("hot text of eight words said very often") + 8  # more rows than a shard should have
    assert all(len(s) == 1 for (_, size), s in where.items() if size != hot)


def test_packing_splits_a_group_larger_than_a_shard(spark, frame):
    rows = [(i, "the same text") for i in range(900)] + [(1000 + i, f"text {i} " * 3) for i in range(300)]
    packed = sharding.pack_documents(frame(rows, "doc_id bigint, text string"), 6).collect()
    sizes, where = packed_well(packed, 6)
    assert max(sizes) < 1.1 * min(sizes)
    counts = [sum(r["shard"] == s for r in packed) for s in range(6)]
    assert max(counts) < 1.3 * min(counts)


def test_packing_of_even_items_is_nearly_even():
    r = np.random.default_rng(0)
    sizes = np.c_[r.lognormal(5, 1, 3000), r.lognormal(3, 1, 3000), r.integers(1, 5, 3000)]
    shard = sharding.pack(sizes, 24)
    totals = np.stack([np.bincount(shard, sizes[:, k], 24) for k in range(3)])
    assert (totals.max(axis=1) / totals.min(axis=1) < 1.03).all()


@pytest.mark.parametrize("seed", range(8))
def test_packing_beside_every_other_packing(seed):
    """Nine items in three shards: hardly one of the 19,683 ways evens out bytes, tokens and rows better."""
    r = np.random.default_rng(seed)
    sizes = np.c_[r.lognormal(5, 0.6, 9), r.lognormal(3, 0.6, 9), r.integers(1, 5, 9)]
    every = np.stack(np.unravel_index(np.arange(3**9), [3] * 9), axis=1)
    share = sizes / sizes.sum(axis=0) * 3
    loads = np.stack([np.where((every == s)[:, :, None], share, 0).sum(axis=1) for s in range(3)], axis=1)
    cost = ((loads * [sharding.BYTES_FIRST, 1, 1]) ** 2).sum(axis=(1, 2))
    own = np.flatnonzero((every == sharding.pack(sizes, 3)).all(axis=1))[0]
    assert (cost < cost[own] - 1e-9).mean() < 0.01
    assert loads[own, :, 0].max() < 1.07 * loads[:, :, 0].max(axis=1).min()


def test_packing_evens_out_all_measures(frame):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(1, 12) + str(i) for _ in range(int(r.lognormvariate(3, 1))))) for i in range(1200)]
    packed = sharding.pack_documents(frame(rows, "doc_id bigint, text string"), 24).collect()
    for measure in (lambda x: x["size"], lambda x: x["tokens"], lambda x: 1):
        sums = np.bincount([x["shard"] for x in packed], [measure(x) for x in packed], 24)
        assert sums.max() < 1.05 * sums.min()


@pytest.mark.parametrize("hot", [None, 7])
def test_packing_cuts_a_group_of_one_id(frame, hot):
    rows = [(hot, "the same text")] * 900 + [(1000 + i, f"text {i} " * 3) for i in range(300)]
    packed = sharding.pack_documents(frame(rows, "doc_id bigint, text string"), 6).collect()
    sizes, _ = packed_well(packed, 6)
    assert len(packed) == 1200 and max(sizes) < 1.1 * min(sizes)
    counts = [sum(r["shard"] == s for r in packed) for s in range(6)]
    assert max(counts) < 1.1 * min(counts)


def test_packing_odd_rows(spark, none, odd):
    assert sharding.pack_documents(none, 4).count() == 0
    rows = sharding.pack_documents(odd, 3).collect()
    assert len(rows) == 9
    packed_well(rows, 3)
    again = sharding.pack_documents(odd, 3, tokens=F.char_length("text")).collect()
    assert sorted(str(r["size"]) for r in again) == sorted(str(r["size"]) for r in rows)


# 2 encoding


def test_tokens_equal_the_library(spark, docs):
    library = Tokenizer.from_file(TOKENIZER)
    found = rows_by_id(bpe.encode_documents(docs, TOKENIZER))
    digests = rows_by_id(bpe.token_digests(docs, TOKENIZER))
    for i, text in corpus():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids
        assert found[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i]["decoded_sha256"] == sha(found[i]["decoded"])


def test_tokens_of_odd_characters():
    library, own = Tokenizer.from_file(TOKENIZER), bpe.read_tokenizer(TOKENIZER)
    r = random.Random(3)
    alphabet = list("abcs tredvml'' \n\t  !!--  12９é²½ßñ—… 　 \x1c\x1f\x85😀👍🏽漢字кот")
    alphabet += ["'s", "'re", "'ll", "<|endoftext|>", "  ", "\r\n", "can't", "I'LL", "'ſ", "aaaa", "    "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "\n\n", "a ", "'", "''s", "'s", "a" * 3001, "<|endoftext|>" * 3]
    tokens, first = own.encode(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, first, first[1:]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert tokens[a:b].tolist() == ids, repr(text)
        assert own.decode(tokens[a:b]).decode() == (text or "")


def test_tokens_odd_rows(none, odd):
    assert bpe.encode_documents(none, TOKENIZER).count() == 0
    assert bpe.token_digests(odd, TOKENIZER).count() == 9


# 3 near duplicates


def shingles(text, n):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_by_force(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, n):
    found = rows_by_id(neardup.near_duplicates(docs, shingle=n))
    expected = near_by_force(corpus(), n)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def chains(seed=8, families=3, steps=25):
    r = random.Random(seed)
    rows = []
    for family in range(families):
        w = [f"f{family}w{i}" for i in range(60)]
        for step in range(steps):
            rows.append((len(rows), " ".join(w)))
            w[r.randrange(60)] = f"f{family}s{step}"
    return rows


@pytest.mark.parametrize("blocks", [None, (8, 3, 1 << 20), (1000, 1000, 200)])
def test_near_duplicates_that_miss_the_hub(spark, frame, monkeypatch, blocks):
    """Chains of small changes: most members are too far from the bucket's hub but not from each other. Buckets of
    one block and of several, by members and by shingles."""
    rows = chains()
    for name, size in zip(("SKETCH_BLOCK", "BLOCK", "BLOCK_SHINGLES"), blocks or ()):
        monkeypatch.setattr(neardup, name, size)
    found = rows_by_id(neardup.near_duplicates(frame(rows, "doc_id bigint, text string"), shingle=2))
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in found.items()} == near_by_force(rows, 2)


def test_blocks_get_sketches_and_only_close_members_texts(spark, frame, monkeypatch):
    """A family whose members are far enough from each other meets in blocks without its texts."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):  # about 0.55 alike: bands are shared, sketches are not close
        w = list(base)
        for k in r.sample(range(200), 28):
            w[k] = f"d{i}k{k}"
        rows.append((i, " ".join(w)))
    sent = []
    real = neardup._by_block
    monkeypatch.setattr(neardup, "_by_block", lambda met: sent.append(met) or real(met))
    found = rows_by_id(neardup.near_duplicates(frame(rows, "doc_id bigint, text string"), shingle=2))
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in found.items()} == near_by_force(rows, 2)
    sketches, texts = sent
    assert "text" not in sketches.columns and "text" in texts.columns
    assert sketches.count() > 2 * texts.count()


def test_odd_sketch_tells_similarities():
    r = np.random.default_rng(1)
    pool = words.random_words(4000, 9)
    for overlap in (0.95, 0.8, 0.4):
        gaps = []
        for k in range(30):
            some = r.permutation(pool)[:600]
            common = int(round(2 * 300 * overlap / (1 + overlap)))
            a, b = np.sort(some[:300]), np.sort(np.r_[some[:common], some[300 : 600 - common]])
            sketch = neardup.odd_sketch(np.stack([neardup.min_hashes(a), neardup.min_hashes(b)]))
            odd = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
            gaps.append(float(neardup.estimated_similarity(odd)) - overlap)
            if overlap >= 0.8:
                assert odd <= neardup.most_odd_bits(0.8)
        assert abs(np.mean(gaps)) < (0.03 if overlap > 0.5 else 0.2)


def test_near_duplicates_odd_rows(none, odd):
    assert neardup.near_duplicates(none).count() == 0
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == 9
    assert all(r["component_id"] is None or r["component_id"] in (1, 2, 3) for r in rows)
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == ["doc_id", "text"]


def test_components(frame):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)]
    root = {n: n for link in links for n in link}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r["node"]: r["component"] for r in connected_components(frame(links, "a bigint, b bigint")).collect()}
    alone = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: find(n) for n in root if n not in alone}


# 4 language


SAMPLES = {
    "en": "the house of that and with this was for there on thing ".split(),
    "de": "der die und das nicht mit für über schön ich auch einer ".split(),
    "fr": "le la les une des que dans pour été où ça même ".split(),
    "es": "el los una que por más año señor está también muy cómo ".split(),
    "nl": "het een van niet voor zijn maar ook deze naar wij ".split(),
    "pt": "não uma para com são mais também você então está ".split(),
}


@pytest.mark.parametrize("names", [("en", "de"), ("en", "de", "fr", "es"), tuple(SAMPLES)])
def test_language(spark, frame, names):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(SAMPLES[lang], k=r.randint(8, 40))), lang) for i, lang in enumerate(names * 60)]
    known = frame(rows, "doc_id bigint, text string, lang string")
    model = language.train(known.filter("doc_id % 5 <> 2"))
    found = rows_by_id(language.identify(known, model))
    held = [(i, lang) for i, _, lang in rows if i % 5 == 2]
    assert np.mean([found[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in found.values())


def test_language_of_a_text_alone_and_among_others(frame):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(SAMPLES[lang], k=9)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    model = language.train(frame(rows, "doc_id bigint, text string, lang string"))
    texts = ["A.", "the", "Re.", "ü", "", None, "où", "b", "und nicht", "I", "été"]
    names, score, ambiguous = model.predict(pa.array(texts))
    for i, text in enumerate(texts):
        alone = model.predict(pa.array([text], pa.string()))
        assert alone[0] == [names[i]] and alone[1][0] == pytest.approx(score[i], abs=1e-12) and alone[2][0] == ambiguous[i]


def test_language_odd_rows(none, odd, frame):
    model = language.fit(np.empty((0, language.WIDTH)), [])
    assert [r["lang_pred"] for r in language.identify(odd, model).collect()] == ["und"] * 9
    assert language.identify(none, model).count() == 0
    rows = frame([(1, None, "en"), (2, "", "en"), (3, "12 !", "en"), (4, "the house", "en"), (5, "é", None), (6, "кот", None)], "doc_id bigint, text string, lang string")
    found = rows_by_id(language.identify(rows, language.train(rows)))
    assert [found[i]["lang_pred"] for i in range(1, 7)] == ["und", "und", "und", "en", "en", "en"]
    assert language.train(none.withColumn("lang", F.lit("en"))).languages == []


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 40):
        code = language.code_words(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2)


# 5 decontamination


ITEMS = [
    (1, "The quick, brown fox; jumps over the lazy dog and then runs back home again today."),
    (2, "short item"),
    (3, None),
    (4, ""),
    (5, "the quick brown fox jumps over the lazy dog and then runs back to its den far away tonight"),
    (5, "the quick brown fox jumps over the lazy dog and then runs back to its den far away tonight"),
    (None, "ünïcode wörds here"),
]


def contaminated_by_force(docs, items, n=13):
    grams = defaultdict(set)
    for name, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for p in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[p : p + n])].add(str(name))
    out = {}
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for g, who in grams.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    names |= who
        out[i] = (len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w))
    return out


def passages(seed=6):
    r = random.Random(seed)
    out = []
    for i, t in enumerate(invented(seed, 30)):
        w = t.split()
        cut = r.randrange(len(w) + 1)
        said = r.choice([ITEMS[0][1], ITEMS[4][1], "Short ITEM", "short", "", "dog and then runs back home", "ÜNïcode wörds here", "ünïcode wörds here"])
        out.append((i, " ".join(w[:cut]) + " " + said + " " + " ".join(w[cut:])))
    return [*out, (100, None), (101, ""), (102, ITEMS[0][1]), (103, "back home again today. short"), (104, "item the quick")]


@pytest.mark.parametrize("block", [contamination.BLOCK_BYTES, 60])
def test_passages(frame, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    docs, items = passages(), frame(ITEMS, "item_id int, text string").withColumn("doc_id", F.lit("x"))
    found = rows_by_id(contamination.contamination(frame(docs, "doc_id bigint, text string"), items))
    expected = contaminated_by_force(docs, ITEMS)
    assert {i: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for i, r in found.items()} == expected
    assert found[102]["longest"] == 16
    wide = frame(docs, "doc_id bigint, text string").select("*", F.lit(1).alias("spans"), F.lit("x").alias("TEXT"))
    kept = contamination.drop_contaminated(wide, items)
    assert kept.columns == ["doc_id", "text", "spans", "TEXT"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in expected.items() if not x[3]}


def test_blocks_of_items_that_repeat_a_text(frame, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 200)
    items = [(i % 40, "one text of many items") for i in range(80)] + [(100, None), (101, ""), (None, "no id")]
    benchmark = frame(items, "item_id int, text string")
    blocks = list(contamination._blocks(benchmark, "item_id", "text"))
    assert len(blocks) > 5 and all(sum(len(t) + len(str(i or "")) + 8 for i, t in b) <= 240 for b in blocks)
    assert sorted(str(x) for b in blocks for x in b) == sorted(str(x) for x in set(items) if x[1])
    found = rows_by_id(contamination.contamination(frame([(1, "here one text of many items")], "doc_id bigint, text string"), benchmark))
    assert found[1]["items"] == sorted(str(i) for i in range(40))


def test_suffix_array_is_sorted():
    texts = pa.array([t for _, t in corpus()])
    read = words.read_words(texts, words.ALPHANUMERIC)
    array = contamination.SuffixArray(read, 13)
    codes = array.codes.tolist()

    def suffix(p):
        s = codes[p : p + 13]
        return s[: s.index(0)] if 0 in s else s

    order = array.order.tolist()
    assert sorted(order) == list(range(len(codes)))
    assert all(suffix(a) <= suffix(b) for a, b in zip(order, order[1:]))


def test_passages_odd_rows(none, odd, frame):
    items = frame(ITEMS, "item_id int, text string")
    assert contamination.contamination(none, items).count() == 0
    assert contamination.contamination(odd, items).count() == 9
    nothing = contamination.contamination(odd, items.limit(0)).collect()
    assert not any(r["contaminated"] or r["items"] for r in nothing)


# 6 exact duplicates


def test_exact_groups(docs):
    found = rows_by_id(exact.exact_groups(docs))
    groups = defaultdict(list)
    for i, t in corpus():
        groups[(t or "").translate(LOWER)].append(i)
    for text, ids in groups.items():
        for i in ids:
            assert found[i] == {
                "doc_id": i, "keep_id": max(ids), "group_size": len(ids), "kept": i == max(ids), "text_sha256": sha(text),
            }


def test_hot_groups_are_salted(frame, monkeypatch):
    rows = [(i, "Hot" if i % 2 else "hOT") for i in range(400)] + [(1000 + i, f"t{i % 50}") for i in range(100)]
    found = rows_by_id(exact.exact_groups(frame(rows, "doc_id bigint, text string")))
    assert found[3]["keep_id"] == 399 and found[3]["group_size"] == 400
    assert found[1000]["keep_id"] == 1050 and found[1000]["group_size"] == 2


def test_exact_odd_rows(none, odd):
    assert exact.exact_groups(none).count() == 0
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == 9
    long = [r for r in rows if r["group_size"] == 4]
    assert len(long) == 4 and {r["keep_id"] for r in long} == {1} and sum(r["kept"] for r in long) == 2
    empty = [r for r in rows if r["text_sha256"] == sha("")]
    assert len(empty) == 3 and {r["keep_id"] for r in empty} == {2}
    wide = odd.select("*", F.lit(1).alias("DOC_ID"), F.lit(2).alias("text"))
    kept = exact.drop_exact_copies(wide)
    assert kept.columns == ["doc_id", "text", "DOC_ID", "text"]
    assert sorted(str(r[0]) for r in kept.collect()) == ["1", "1", "2", "2", "3", "3"]


# 7 repeated passages


def repeats_by_force(rows, n):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = SPACED.findall(t or "")
        gone = set()
        for p in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[p : p + n]), (i, p)) != (i, p):
                gone |= set(range(p, p + n))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("n", [20, 5, 9])
def test_repeats(docs, n):
    found = rows_by_id(repeats.drop_repeats(docs, length=n))
    assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in found.items()} == repeats_by_force(corpus(), n)


def test_repeats_across_partitions_and_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 500)
    found = rows_by_id(repeats.drop_repeats(docs.repartition(7), digests=True))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found.items()} == {
        i: (a, b, sha(c)) for i, (a, b, c) in repeats_by_force(corpus(), 20).items()
    }


def test_repeats_odd_rows(none, odd):
    assert repeats.drop_repeats(none).count() == 0
    rows = repeats.drop_repeats(odd).collect()
    assert len(rows) == 9
    whole = [(r["doc_id"], r["n_removed"]) for r in rows if r["n_words"] == 60]
    assert sorted(whole, key=str) == sorted([(1, 0), (1, 0), (None, 60), (None, 60)], key=str)
    assert [r["n_removed"] for r in rows if r["n_words"] == 61] == [60]


# 8 conversations


def test_conversations(frame, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None), ("user", "bye")]
    logged = {1: a[:1], 2: a[:3], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [(None, "x")], 7: a[:4], 8: [("assistant", "hi")]}
    rows = [(c, 10 * t, role, text, "x") for c, turns in logged.items() for t, (role, text) in enumerate(turns)]
    rows += rows[:3]
    found = chat.render_conversations(frame(rows, "conv_id bigint, turn bigint, role string, text string, place string")).collect()
    assert {(r["conv_id"], r["turns"], r["copies"]) for r in found} == {(3, 5, 2), (5, 2, 1), (6, 1, 1), (8, 1, 1)}
    said = {r["conv_id"]: r["rendered"] for r in found}
    assert said[3].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n")
    assert said[6] == "<|im_start|>\nx<|im_end|>\n"


def test_conversations_whose_turns_share_a_number(frame, monkeypatch):
    """Blocks by rows give what blocks by number give."""
    turns = [(c, n, f"r{k % 3}", f"text {k:03d}") for c, n in ((1, 0), (2, None), (None, 0)) for k in range(40)]
    turns += [(4, 0, f"r{k % 3}", f"text {k:03d}") for k in range(39)] + turns[:5] + [(5, t, "user", str(t)) for t in range(5)]
    rows = frame(turns, "conv_id bigint, turn bigint, role string, text string")
    plain = sorted(map(str, chat.render_conversations(rows).collect()))
    assert len(plain) == 3
    cut, real = [], chat.cut_into_runs
    monkeypatch.setattr(chat, "CROWDED", 10)
    monkeypatch.setattr(chat, "cut_into_runs", lambda df, order: cut.append(real(df, order, 7)) or cut[-1])
    assert sorted(map(str, chat.render_conversations(rows).collect())) == plain
    assert cut[0].select("conv_id", chat.RUN).distinct().count() > 5


def test_conversations_odd_rows(frame):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert chat.render_conversations(frame([], schema)).count() == 0
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, None, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "a")]
    found = {r["conv_id"]: r["turns"] for r in chat.render_conversations(frame(rows, schema)).collect()}
    assert found == {None: 2, 1: 3}


# 9 pages


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Our site</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies. Please accept them.</p></div><div class="ad">Buy this.</div>
<article><h1>The   title</h1><p><b>First &amp; foremost, a text that has some words.<br><p>A second one, with
more words than the first. It has two sentences.</p><div class="advert"><p>Buy more.</p></div>
<ul><li>One thing that counts</li><li>Another thing that counts</li></ul></article>
<aside class="sidebar"><h3>Popular</h3><p>Some other text that is not part of it.</p></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>A nice text, I agree with all of it.</p></div></section>
<footer>&copy; Us</footer></body></html>"""


@pytest.fixture(scope="module")
def trees():
    return html.fit(invented(1, 60))


def test_main_text(trees):
    assert html.main_texts([PAGE], trees) == [
        "The title\nFirst & foremost, a text that has some words.\nA second one, with more words than the first. "
        "It has two sentences.\nOne thing that counts\nAnother thing that counts"
    ]


def test_head_without_end_tag(trees):
    whole = html.main_texts([PAGE], trees)
    assert html.main_texts([PAGE.replace("</head><body>", "").replace("</body>", "")], trees) == whole
    assert html.main_texts([PAGE.replace("</head>", "")], trees) == whole
    for inside in ("Some text.", "<b>Some text.</b>", "<br>Some text.", "<p>Some text.", "<title>T</title><meta name=x>Some text."):
        read = html.Pages()
        read.add(f"<head>\n{inside}")
        assert read.block_text == ["Some text."], inside


@pytest.mark.parametrize(
    ("markup", "shown"),
    [
        ('a <svg class="i"/> b', ["a b"]),
        ("a <svg/> b", ["a b"]),
        ("a <math/> b <math><mi>x</mi></math> c", ["a b c"]),
        ("a <svg><svg><text>in</text></svg>t</svg> b", ["a b"]),
        ("a <svg><text>in</text> b", ["a in b"]),
        ("a <video src=x> b", ["a b"]),
        ("a <iframe src=x><p>b</p>", ["a", "b"]),
        ("a <template><template>x</template>y</template> b", ["a b"]),
        ("a <object>x<object>y</object>z</object> b", ["a b"]),
        ("a <script>x = '<p>no</p>'", ["a"]),
        ("a <style>p {}</style> b <style>q", ["a b"]),
        ("a <textarea>typed</textarea> b", ["a b"]),
        ("a <!-- <p>no</p> --> b <!-- <p>no</p>", ["a b"]),
        ("a <p>b <c", ["a", "b <c"]),
        ('a <svg data-x="1>2"><text>no</text></svg> b', ["a b"]),
    ],
)
def test_elements_that_are_not_shown(markup, shown):
    """Self-closing, nested and never closed ones take no text along that is not theirs."""
    read = html.Pages(marked=False)
    read.add(f"{markup}")
    assert read.block_text == shown


@pytest.mark.parametrize("part", ["<a ", "<svg>", "<svg", "<video>", "<!-- ", "<!", "</script ", "<p", '<a b="', "<a b='<"])
def test_hostile_markup_takes_linear_time(part):
    import time

    taken = []
    for n in (20_000, 80_000):
        page = "<p>text</p>" + part * n
        start = time.process_time()
        html.Pages(marked=False).add(page)
        taken.append(time.process_time() - start)
    assert taken[1] < 12 * taken[0] + 0.5


def test_training_texts_are_whole_and_bounded(spark, frame):
    long = " ".join(f"word{i}" for i in range(400))
    texts = [r for b in html._block_texts([pa.record_batch([pa.array([f"<p>{long}</p><p>short</p>"])], ["html"])]) for r in b.column(0).to_pylist()]
    assert texts == ["short", long]
    seen = []
    pages = frame([(f"<p>text number {i}</p>",) for i in range(60)], "html string")
    fit, html.fit = html.fit, lambda texts: seen.append(texts)
    try:
        html.train(pages, blocks=25)
        html.train(pages)
    finally:
        html.fit = fit
    assert [len(x) for x in seen] == [25, 60] and set(seen[0]) < set(seen[1])


def test_foreign_marks_are_ignored(frame, trees):
    marks = ['"12.5"', '"top"', "''", "x", '"1"']
    rows = [(i, "u", PAGE.replace("<article>", f"<article data-y={m}>").replace("<li>", f"<li DATA-Y={m}>")) for i, m in enumerate(marks)]
    pages = frame(rows, "page_id bigint, url string, html string")
    assert {r["text"] for r in html.extract(pages, trees).collect()} == set(html.main_texts([PAGE], trees))
    assert html.train(pages).feature.shape == trees.feature.shape


def test_held_out_layouts(trees):
    layouts = html._Layouts(invented(2, 60), seed=77)
    pages = html.Pages()
    for _ in range(200):
        page, bare = layouts.page()
        pages.add(page)
        pages.mark[pages.first[-1]] = bare
    nodes = html.node_table(pages)
    kept = html.decode(nodes, trees.log_odds(nodes.features))
    block = np.array(pages.block_node)
    assert (kept[block] == np.array(pages.mark, bool)[block]).mean() > 0.97
    child = np.flatnonzero(nodes.parent >= 0)
    inner = child[nodes.parent[nodes.parent[child]] >= 0]
    assert (kept[nodes.parent[inner]] | ~kept[inner]).all()  # nothing stays below what goes


def test_pages_odd_rows(frame, trees):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<div"), (4, "u", "<" * 50), (5, "u", "<p>" * 3000), (6, "u", "</p></div>"), (1, "u", PAGE), (7, "u", "<!-- a"), (8, "u", "<script>x")]
    pages = frame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    found = html.extract(pages, trees).collect()
    assert len(found) == 10 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html.extract(pages.limit(0), html.train(pages.limit(0))).count() == 0


# 10 quality


def test_quality(frame):
    r = random.Random(9)
    good = [t for t in invented(11, 260) if t]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) if r.random() < 0.5 else " | ".join(t.split()) for t in invented(12, 130) if t]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < len(good))) for i, _ in rows]
    docs = frame(rows, "doc_id bigint, text string").withColumn("label", F.lit("x"))
    known = frame([*labels, (None, 1), (3, None), (4, 7)], "doc_id bigint, quality int")
    model = quality.train(docs, known.filter("doc_id % 4 <> 2 or doc_id is null"))
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if i % 4 == 2]
    assert np.mean([(found[i] >= 0.7) == y for i, y in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in found.items() if s >= 0.7}


def test_quality_of_ordinary_shape(frame):
    """Bad texts with the case, punctuation and lengths of good ones: their words tell them, in long texts too."""
    r = random.Random(4)
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    special = {0: ["cheap", "casino", "jackpot", "winner"], 1: ["theorem", "harvest", "parliament", "molecule"]}

    def text(y):
        n = r.choice([30, 60, 400])
        return " ".join(r.choice(special[y]) if r.random() < 0.1 else r.choice(common) for _ in range(n)).capitalize() + "."

    rows = [(i, text(int(i % 3 > 0))) for i in range(400)]
    docs = frame(rows, "doc_id bigint, text string")
    model = quality.train(docs, frame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int"))
    found = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    assert np.mean([(found[i] >= 0.7) == (i % 3 > 0) for i in range(300, 400)]) > 0.95
    texts = [t for _, t in rows[300:]]
    assert [model.scores(pa.array([t]))[0] for t in texts] == model.scores(pa.array(texts)).tolist()
    assert len(set(model.scores(pa.array(["Some casino opened here.", "Some theorem opened here."])).tolist())) == 2


def test_quality_odd_rows(none, odd, frame):
    docs = frame([(1, "a text"), (2, "b text")], "doc_id bigint, text string")
    ones = quality.train(docs, frame([(1, 1), (2, 1)], "doc_id bigint, quality int"))
    nothing = quality.train(none, frame([], "doc_id bigint, quality int"))
    for model in (ones, nothing):
        scores = [r["score"] for r in quality.score(odd, model).collect()]
        assert len(scores) == 9 and all(0 <= s <= 1 for s in scores)
        assert quality.score(none, model).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    rows = [np.sort(r.choice(30, 6, replace=False)) for _ in range(80)]
    labels = np.array([float(len(set(x.tolist()) & set(range(10))) > 1) for x in rows])
    ratio = np.ones(quality.WIDTH)
    weight, bias = quality.dual_coordinate_descent(rows, labels, ratio, passes=300)
    x = np.zeros((80, 31))
    for i, row in enumerate(rows):
        x[i, row] = 1 / 6**0.5
    x[:, 30] = 1
    sign = np.where(labels > 0, 1, -1)

    def cost(w):
        return w @ w / 2 + np.maximum(0, 1 - sign * (x @ w)).sum()

    best = cost(np.r_[weight[:30], bias])
    for _ in range(200):
        assert cost(np.r_[weight[:30], bias] + r.normal(0, 0.02, 31)) >= best - 1e-6
