"""Periodic runs, common lines and ranked search on small tables, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weekloom.llm import lines, runs, search
from weekloom.llm.perfecthash import PerfectHash
from weekloom.llm.suffixtree import Extensions, SuffixTree
from weekloom.llm.words import random_words

SPACE = " \t\n\v\f\r"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Further columns with names that the operators use themselves, and one that differs in case only.
ODD = "doc_id bigint, text string, runs string, id int, found string, n string, TEXT string, score int, item string"


def odd_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, None, "n", "other", 1, None) for i, t in rows], ODD)


def slow_runs(w, min_length, min_exponent):
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_collapsed(w, found):
    gone = {i for start, n, q in found for i in range(start + q, start + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(r, words):
    if len(words) < 4:
        return words
    a = r.randrange(len(words))
    p = 1 + r.randrange(max(1, (len(words) - a) // 3))
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def test_suffix_tree_ranks_and_extensions():
    r = random.Random(2)
    for _ in range(60):
        s = [r.randint(1, 3) for _ in range(r.randint(1, 70))]
        tree = SuffixTree(s)
        n = len(s)
        order = sorted(range(n + 1), key=lambda i: s[i:])
        assert np.argsort(tree.ranks()).tolist() == order
        turned = sorted(range(n + 1), key=lambda i: [-x for x in s[i:]])
        assert np.argsort(tree.ranks(descending=True)).tolist() == turned
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        i, j = np.array(pairs).T
        common = [next((k for k in range(n) if max(a, b) + k >= n or s[a + k] != s[b + k]), 0) for a, b in pairs]
        assert Extensions(tree).lengths(i, j).tolist() == common


@pytest.mark.parametrize("limits", [(24, 3), (2, 2), (6, 2), (9, 3), (10, 4)])
def test_runs_against_brute_force(limits):
    r = random.Random(3)
    for _ in range(250):
        w = [r.randint(1, r.randint(1, 4)) for _ in range(r.randint(0, 90))]
        if r.random() < 0.6:
            w = periodic(r, w)
        expected = slow_runs(w, *limits)
        assert [tuple(x) for x in runs.find_runs(w, *limits).tolist()] == expected
        text = " ".join(map(str, w))
        _, found = runs.text_runs(pa.array([None, text, "5 " + text, text + " 5"]), *limits)
        for t, words in ((1, w), (2, [5, *w]), (3, [*w, 5])):
            assert [tuple(x) for x in found.get(t, np.empty((0, 3), int)).tolist()] == slow_runs(words, *limits)


def test_collapse_runs_of_odd_rows(spark):
    r = random.Random(4)
    long = [f"w{r.randint(1, 5000)}" for _ in range(1500)] * 230  # 2 MB: longer than a piece
    texts = [None, "", " \t\n", "one", "la " * 23, "la " * 24, "la\tla\n" * 40, "a b c " * 8 + "a", "a b c " * 8 + "x"]
    texts += [" ".join(periodic(r, [r.choice("abcdefgh") for _ in range(r.randint(20, 300))])) for _ in range(60)]
    texts += [" ".join(long), "é ü " * 30, "A a " * 30, texts[-1], texts[-1], "x" * 3_000_000]
    rows = list(enumerate(texts)) + [(None, "la " * 30), (5, texts[5])]
    got = runs.collapse_runs(odd_frame(spark, rows)).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_words", "runs", "collapsed_text"}
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    result = sorted(((g["doc_id"], g["collapsed_text"], g["n_words"], [tuple(x) for x in g["runs"]]) for g in got), key=key)
    expected = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        found = slow_runs(w, 24, 3) if len(w) < 2000 else [(0, len(w), 1500)]
        expected.append((i, slow_collapsed(w, found), len(w), found))
    assert result == sorted(expected, key=key)
    assert runs.collapse_runs(odd_frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        runs.collapse_runs(odd_frame(spark, []), min_exponent=1)


def test_perfect_hash():
    for n in (0, 1, 2, 63, 64, 65, 5000):
        keys = random_words(n, 5)
        numbers = PerfectHash.build(keys).numbers(keys)
        assert sorted(numbers.tolist()) == list(range(n))
        others = PerfectHash.build(keys).numbers(random_words(500, 6))
        assert ((others >= -1) & (others < max(n, 1))).all()
    with pytest.raises(ValueError):
        PerfectHash.build(np.zeros(2, np.uint64))


def test_shard_tells_lines_of_one_place_apart():
    place, prints = np.array([7, 9, 7, 7], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    shard = lines.Shard.build(place, prints, np.array([10, 20, 30, 40]), pa.array([100, 200, 300, 400]))
    asked = np.array([7, 7, 7, 7, 9, 9, 8], np.uint64), np.array([1, 3, 4, 5, 2, 1, 2], np.uint64)
    counts, at = shard.find(*asked)
    assert counts.tolist() == [10, 30, 40, 0, 20, 0, 0]
    assert shard.keepers.take(pa.array(at[[0, 1, 2, 4]])).to_pylist() == [100, 300, 400, 200]


def slow_lines(rows, min_chars, min_docs):
    """(id, lines, dropped (number, documents), kept text) of every row."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    out = []
    for i, t in rows:
        split, dropped = (t or "").split("\n"), []
        for number, line in enumerate(split):
            ids = holders.get(key(line), [])
            known = [x for x in ids if x is not None]
            if len(ids) >= min_docs and i != (max(known) if known else None):
                dropped.append((number, len(ids)))
        gone = {x for x, _ in dropped}
        out.append((i, len(split), dropped, "\n".join(x for k, x in enumerate(split) if k not in gone)))
    return out


def line_rows(seed=6):
    r = random.Random(seed)
    common = [f"Common line number {k} " + "wörd " * r.randint(0, 8) for k in range(30)]
    texts = []
    for k in range(90):
        own = [f"own line {k} {j} " + "text " * r.randint(0, 9) for j in range(r.randint(0, 4))]
        chosen = [r.choice(common) for _ in range(r.randint(0, 6))]
        dressed = [r.choice(["", " ", "\t \r"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", "  "]) for x in chosen]
        both = own + dressed
        r.shuffle(both)
        texts.append("\n".join(both))
    texts += [None, "", "\n", "\n\n " + common[0] + "\n", " \n\t", common[1] * 20000, texts[3], texts[3]]
    texts += ["\n".join(["hot line of a third of all documents, in many copies"] * 3)] * 50
    texts += ["ÄÖÜ" * 13, "ÄÖÜ" * 13 + "x", "äöü" * 13 + "x"] * 6
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + [(None, common[0]), (None, "only rows without an id hold this one line"), (3, common[0])]


@pytest.mark.parametrize("sizes", [{}, {"shard_lines": 4, "table_bytes": 4000}])
def test_common_lines_against_brute_force(spark, sizes):
    rows = line_rows() + [(None, "only rows without an id hold this one line")] * 5
    frame = odd_frame(spark, rows).repartition(5)
    for kind, name in (("bigint", str), ("string", lambda x: x)):
        typed = frame.withColumn("doc_id", frame["doc_id"].cast(kind))
        cast = (lambda i: i) if kind == "bigint" else (lambda i: None if i is None else str(i))
        expected = slow_lines([(cast(i), t) for i, t in rows], 40, 5)
        got = lines.drop_common_lines(typed, **sizes).collect()
        seen = [(g["doc_id"], g["n_lines"], [tuple(x) for x in g["dropped"]], g["kept_text"]) for g in got]
        assert sorted(seen, key=repr) == sorted(expected, key=repr)
        assert any(d for _, _, d, _ in expected)
        if sizes:
            break


def test_common_lines_of_nothing(spark):
    assert lines.drop_common_lines(odd_frame(spark, [])).collect() == []
    got = lines.drop_common_lines(odd_frame(spark, [(1, None), (2, None)])).collect()
    assert sorted((g["doc_id"], g["n_lines"], g["dropped"], g["kept_text"]) for g in got) == [(1, 1, [], ""), (2, 1, [], "")]


def slow_ranks(docs, items, top):
    tokens = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs = sum(1 for _, c in tokens if c)
    length = sum(c.total() for _, c in tokens)
    df = Counter(t for _, c in tokens for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for i, c in tokens:
            if not c:
                continue
            m = 100 - 90 + (90 * c.total() * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(TERM.findall((text or "").translate(LOWER)))
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return sorted(out, key=repr)


def search_rows(seed=8):
    r = random.Random(seed)
    vocabulary = [f"{x}{k}" for k in range(60) for x in ("a", "É", "Z")]
    say = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.03)), 179)] for _ in range(n))
    texts = [say(r.randint(0, 60)) for _ in range(250)] + [say(12)] * 60 + [None, "", "-- !", "a0", "a0 A0 a0", say(20_000)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    docs = list(zip(ids, texts, strict=True)) + [(None, texts[0]), (None, texts[255]), (7, texts[255])]
    items = [(k, say(r.randint(1, 40))) for k in range(12)] + [(20, None), (21, ""), (22, "nothing-known"), (None, say(9))]
    return docs, items + [items[0], (0, say(7)), (30, texts[255]), (31, "a0")]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000}])
def test_ranks_against_brute_force(spark, sizes):
    docs, items = search_rows()
    frame = odd_frame(spark, docs).repartition(4)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, rank int")
    for top in (10, 1, 1000):
        got = [tuple(r) for r in search.rank_documents(frame, asked, top, **sizes).collect()]
        assert sorted(got, key=repr) == slow_ranks(docs, items, top)


def test_ranks_of_item_blocks_and_names(spark):
    docs, items = search_rows(9)
    docs = [(None if i is None else f"d{i:04}", t) for i, t in docs]
    frame = spark.createDataFrame(docs, "name string, body string")
    asked = spark.createDataFrame(items[:3], "q int, wanted string")
    columns = {"id_column": "name", "text_column": "body", "item_column": "q", "item_text_column": "wanted"}
    got = search.rank_documents(frame, asked, 5, **columns, item_bytes=100)
    assert got.columns == ["q", "rank", "name", "score"]
    tokens = [tuple(r) for r in got.collect()]
    keyed = slow_ranks([(i, t) for i, t in docs], items[:3], 5)
    assert [x[3] for x in sorted(tokens)] == [x[3] for x in sorted(keyed, key=lambda x: x[:2])]


def test_ranks_of_nothing(spark):
    docs, items = search_rows()
    asked = spark.createDataFrame(items[:2], "item_id int, text string")
    assert search.rank_documents(odd_frame(spark, []), asked).collect() == []
    assert search.rank_documents(odd_frame(spark, docs), asked.limit(0)).collect() == []


def test_search_scores_few_documents():
    """One document that is far better than all others is found without scoring them."""
    rows = [f"common{k % 7} filler{k}" for k in range(4000)] + ["rare word pair"]
    items = search.read_items(["rare word"])
    shard = search.Shard(pa.array(rows), items.terms, search.Statistics(4001, 8003, np.array([9000, 9000])))
    assert len(shard.document) == 2
    best = search._Best(1)
    search._search(shard, items.of_item[0], list(range(4001)), best)
    assert [r[2] for r in best.rows] == [4000]


def test_hashes_of_digests():
    high, low = lines._hashes([1, (3 << 64) + 5])
    assert high.tolist() == [0, 3] and low.tolist() == [1, 5]
