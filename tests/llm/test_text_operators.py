"""Operators on documents against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from treekin.llm import decontaminate, licenses, mixing, ngram_join, pii, quality, tokens
from treekin.llm.wordhash import ALNUM, SPACED, shingle_hashes, words_of
from treekin.shared import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
EXTRA = "n long, size string, label double, bucket string, text2 string"
ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c d", "Ä é ß Word word", "x" * 300_000, "word " * 4000, "\x00 nul", "a b c", "😀 😀 😀"]


def frame(spark, texts, extra=True, ids=None):
    """Documents with other columns whose names clash with those that operators use."""
    ids = range(len(texts)) if ids is None else ids
    kind = "doc_id long, text string, source string, lang string" + (", " + EXTRA if extra else "")
    rows = [(i, t, None if k % 7 == 3 else f"s{k % 3}", "en", *([1, "x", 0.5, None, "y"] if extra else [])) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, kind)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def near_copies(rng, text, n, edits):
    out = []
    for _ in range(n):
        words = text.split(" ")
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"E{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_words(monkeypatch, size):
    import treekin.llm.wordhash as module

    monkeypatch.setattr(module, "BLOCK", size)
    texts = [t or "" for t in ODD] + ["ab", "cd ef", "AB cd"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    seen: dict[bytes, int] = {}
    for table, pattern in ((SPACED, WORD), (ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        w = words_of(data, offsets, table, lower=True)
        for i, t in enumerate(texts):
            want = [x.encode() for x in pattern.findall(t.translate(LOWER))]
            hashes = w.hashes[w.first[i] : w.first[i + 1]].tolist()
            assert len(hashes) == len(want)
            assert all(seen.setdefault(x, h) == h for x, h in zip(want, hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


def thue_morse(k):
    """A word of 2 ** k letters whose complement has the same polynomial hash modulo 2 ** 64, whatever the base, from k = 10 on."""
    word = "a"
    for _ in range(k):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("k", [3, 10, 12])
def test_regular_words_have_hashes_of_their_own(k):
    data = "\n".join(thue_morse(k)).encode()
    for table in (SPACED, ALNUM):
        w = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), table)
        assert len(set(w.hashes.tolist())) == 2


def test_regular_words_in_operators(spark):
    """Documents that share no shingle, no item and no id but for two words that a weak hash takes for one."""
    x, y = thue_morse(10)
    texts = [f"{x} p q r t", f"{y} p q r t", f"{x} p q r t"]
    assert joined(frame(spark, texts)) == [(0, 1, 0), (1, 1, 1), (2, 1, 0)]
    items = spark.createDataFrame([(1, f"{x} one two three four")], "item_id long, text string")
    docs = frame(spark, [f"a b {w} one two three four c d" for w in (x, y)])
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {1}
    path = new_path(spark, "test-tokens")
    tokens.write_token_file(frame(spark, texts), path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    want = [zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()) for text in texts]
    assert [r["ids_crc32"] for r in tokens.read_token_file(spark, path).orderBy("doc_id").collect()] == want


def test_words_with_one_hash(monkeypatch):
    """Ids are those of the words, whatever the hashes."""
    from tokenizers import Tokenizer

    texts = ["the cat sat", "a mat", "the mat sat on the cat", "cat cat dog"]
    raw = [x.encode() for x in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    real = tokens.array_hashes
    for weak in (lambda w: real(w) % np.uint64(2), lambda w: real(w) % np.uint64(4)):
        monkeypatch.setattr(tokens, "array_hashes", weak)
        e, t = tokens.Encoder(tokens.tokenizer_path()), Tokenizer.from_file(tokens.tokenizer_path())
        for _ in range(3):
            out, stops = e.encode(data, offsets, 7)
            assert [out[a:b].tolist() for a, b in zip(stops, stops[1:], strict=False)] == [[*t.encode(x, add_special_tokens=False).ids, 7] for x in texts]


def test_words_that_stand_alone():
    import json

    spec = json.load(open(tokens.tokenizer_path()))
    assert tokens.words_stand_alone(spec)
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    changes = [
        {"normalizer": {"type": "Prepend", "prepend": "_"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}},
        {"pre_tokenizer": {**split, "behavior": "Isolated"}}, {"pre_tokenizer": {**split, "pattern": {"Regex": r"\s?[\p{L}]+"}}}, {"pre_tokenizer": {**split, "pattern": {"Regex": r"[^\p{L}]+"}}},
        {"added_tokens": [{"content": "a b"}]}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"truncation": {"max_length": 5}},
    ]
    assert not any(tokens.words_stand_alone(spec | c) for c in changes)


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) or ids[i] == ids[j]:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in range(len(sets)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least[root(i)]) for i in range(len(sets))]


def joined(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df).collect())


def corpus(rng):
    base = [prose(rng, n) for n in (5, 6, 20, 60, 90, 150)]
    passage = prose(rng, 60)
    texts = list(ODD) + base + base[:3]
    for b in base[2:]:
        texts += near_copies(rng, b, 6, 1) + near_copies(rng, b, 6, 3)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 10) for _ in range(25)]
    chain = prose(rng, 120).split(" ")
    for step in range(8):
        texts.append(" ".join(chain[3 * step : 3 * step + 90]))
    rng.shuffle(texts)
    return texts


def test_ngram_join(spark):
    for seed in (1, 2):
        texts = corpus(random.Random(seed))
        assert joined(frame(spark, texts).repartition(5)) == sorted(components(texts))


def test_ngram_join_with_small_blocks(spark, monkeypatch):
    """Large buckets, salted ones and pairs of blocks: the same components."""
    rng = random.Random(3)
    text = prose(rng, 80)
    texts = near_copies(rng, text, 60, 2) + near_copies(rng, prose(rng, 80), 40, 4) + corpus(rng)
    for name, value in (("BLOCK_DOCS", 6), ("LARGE", 10), ("BLOCK_SHINGLES", 700)):
        monkeypatch.setattr(ngram_join, name, value)
    assert joined(frame(spark, texts).repartition(3)) == sorted(components(texts))


def test_large_groups_of_near_copies_grow_in_rounds(spark, monkeypatch):
    """Groups spread one copy a partition, with far more near copies than a block holds: their shingles are seen, and few rows reach pass 2."""
    rng = random.Random(18)
    texts = near_copies(rng, prose(rng, 220), 150, 2) + near_copies(rng, prose(rng, 220), 90, 1) + corpus(rng)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    monkeypatch.setattr(ngram_join, "ROUND_DOCS", 5)
    seen = []
    blocks = ngram_join._blocks_joined
    monkeypatch.setattr(ngram_join, "_blocks_joined", lambda members, *rest: seen.append(members.count()) or blocks(members, *rest))
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 40), "doc_id long, text string")
    assert joined(df) == sorted(components(texts))
    grown = seen.pop()
    monkeypatch.setattr(ngram_join, "_grown", lambda members, near, *rest: (members, near))
    assert joined(df) == sorted(components(texts)) and grown < 0.5 * seen.pop()
    base = df.select("doc_id", "text")
    described = base.mapInArrow(ngram_join._describe(5), "doc_id long, n long, d1 long, d2 long, times long")
    tokens, counts = ngram_join._frequent(base, described, 5, len(texts))
    assert len(tokens) >= 80 and counts.max() >= 100


def test_links_are_counted(spark, monkeypatch):
    rng = random.Random(19)
    texts = corpus(rng) + near_copies(rng, prose(rng, 60), 12, 2) + [None, "a b"]
    ids = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    want = {i: sum(1 for j in ids if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in ids}
    for size in (512, 4):
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", size)
        rows = ngram_join.ngram_jaccard_join(frame(spark, texts).repartition(3), count_links=True).collect()
        assert {r["doc_id"]: r["n_links"] for r in rows} == want
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == sorted(components(texts))


def test_huge_classes_of_equal_sets(spark):
    texts = ["one text that is copied very often"] * 2500 + ["one text that is copied thrice only"] * 3
    assert joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == [(i, 3, 0 if i < 2500 else 2500) for i in range(2503)]


def test_ngram_join_of_copies_in_any_order(spark):
    """Groups of exact copies keep their near copies where the smallest doc_id of a partition is not read first."""
    rng = random.Random(16)
    texts = []
    for _ in range(4):
        text = prose(rng, 80)
        texts += [text] * 4 + near_copies(rng, text, 1, 1) * 3 + near_copies(rng, text, 2, 1)
    for ids in (range(len(texts))[::-1], rng.sample(range(len(texts)), len(texts))):
        assert joined(frame(spark, texts, ids=list(ids)).coalesce(1)) == sorted(components(texts, list(ids)))
    # a doc_id with two texts, one of them a copy of another document's
    a, b = prose(rng, 80), prose(rng, 80)
    texts, ids = [a, b, b, near_copies(rng, a, 1, 1)[0], a, b], [5, 5, 2, 1, 7, 8]
    assert joined(frame(spark, texts, ids=ids).coalesce(1)) == sorted(components(texts, ids)) and len({c for _, _, c in components(texts, ids)}) == 1


def test_ngram_join_of_rows_alone_in_a_salted_bucket(spark, monkeypatch):
    """A pair of near copies, each copied in every partition: its shingles count as frequent and get more salts than there are sets."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 1)
    rng = random.Random(17)
    texts = [x for text in (prose(rng, 80) for _ in range(8)) for x in (text, *near_copies(rng, text, 1, 1))]
    texts = (texts + [prose(rng, 80)]) * 4
    assert joined(spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 4), "doc_id long, text string")) == sorted(components(texts))


def test_trie_finds_all_links():
    rng = random.Random(9)
    for _ in range(200):
        sets = []
        for _ in range(rng.randrange(2, 14)):
            s = set(rng.sample(range(30), rng.randrange(1, 14)))
            sets.append(s)
            if rng.random() < 0.6:
                sets.append(set(list(s)[: len(s) - 1]) or s)
        order = [np.array(sorted(s)) for s in sets]
        parent = list(range(len(sets)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in ngram_join.linked(order, list(range(len(sets))), 80):
            assert 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            parent[max(root(i), root(j))] = min(root(i), root(j))
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    assert root(i) == root(j)


def test_ngram_join_edge_cases(spark):
    assert joined(frame(spark, [])) == []
    texts = ["a b c d e f", "a b c d e f", None, "q r s t u v", "a b c d e f"]
    ids = [5, 5, 5, 9, 2]
    got = joined(frame(spark, texts, ids=ids))
    assert got == sorted((i, len(shingles(t)), 9 if i == 9 else 2) for i, t in zip(ids, texts, strict=True))
    rows = ngram_join.ngram_jaccard_join(frame(spark, ["a b", "a b"], ids=[None, 3])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(None, None), (3, 3)}


def test_shingles_of_short_texts():
    h = np.arange(1, 8, dtype=np.uint64)
    out, begin = shingle_hashes(h, np.array([0, 0, 2, 7]))
    assert begin.tolist() == [0, 0, 1, 2] and len(set(out.tolist())) == 2


def test_mixing(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(300)] + list(ODD)
    docs = frame(spark, texts)
    sized = docs.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"), F.lit(1.0).alias("quality"), F.lit("kept").alias("bin"))
    rows = mixing.mix(sized).collect()
    assert len(rows) == len(texts) and all(r["bin"] == "kept" for r in rows)
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:  # share out, cap, share the rest out again
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else left * weights[s] / sum(weights[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        mine = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert sum(r["taken"] for r in mine) == int(target[s] + 1e-9)
    again = mixing.mix(sized.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_prefers_quality_and_takes_whole_documents(spark):
    rows = spark.createDataFrame([(i, "a" if i < 400 else "b", 10, 8.0 if i % 2 else 0.25) for i in range(800)], "doc_id long, source string, size long, quality double")
    got = mixing.mix(rows, weights=(1, 3), whole=True).where("source = 'a'").collect()
    good = sum(r["copies"] for r in got if r["doc_id"] % 2)
    assert good > 180 and sum(r["taken"] for r in got) == 2000 and {r["taken"] for r in got} <= {0, 10}
    assert mixing.mix(rows.where("size < 0")).count() == 0
    docs = frame(spark, ["a b c", None, "d e"] * 5)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("text IS NULL").count() <= 15
    assert mixing.mix_documents(docs.where("doc_id < 0")).count() == 0


def test_mixed_documents_are_those_of_the_mix(spark):
    rng = random.Random(21)
    docs = frame(spark, [prose(rng, rng.randrange(0, 50)) for _ in range(250)], extra=False)
    rows = docs.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"), mixing.text_quality(F.col("text")).alias("quality"))
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(rows, whole=True).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixing.mix_documents(docs).collect()) == want


def test_mixing_of_repeated_rows_and_null_ids(spark):
    """Equal rows, equal ids with other sizes, null ids and sources: rows keep their number, budgets hold, and reruns agree."""
    rows = [(None, "a", 5, 1.0), (None, "a", 5, 1.0), (3, "a", 5, 1.0), (3, "a", 9, 1.0), (3, "a", 5, 1.0), (4, None, 7, None), (4, None, 7, -1.0), (5, "b", 0, 1.0), *[(k, "b", 3, 1.0) for k in range(10, 40)]]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")
    got = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(r[:3] for r in rows)
    for source in ("a", "b", None):
        mine = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 1e-9) and all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


@pytest.mark.parametrize("same", [True, False])
def test_mixed_documents_with_one_id(spark, same):
    """All ids null or equal: each source's words come within half a document of its target."""
    rng = random.Random(31)
    rows = [(None if k % 2 else 7, "one two three four five six seven eight nine ten" if same else prose(rng, 10), "a" if k < 200 else "b" if k < 250 else None, k) for k in range(330)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k long").repartition(6)
    targets = {r["source"]: r["target"] for r in mixing.mix(docs.select("doc_id", "source", F.lit(10).cast("long").alias("size"), F.lit(1.0).alias("quality"))).collect()}
    out = mixing.mix_documents(docs).collect()
    taken = Counter(r["source"] for r in out)
    assert all(abs(10 * taken[s] - t) <= 5 for s, t in targets.items())
    assert max(Counter(r["k"] for r in out).values()) <= 3
    if not same:
        assert sorted(r["text"] for r in out) == sorted(r["text"] for r in mixing.mix_documents(docs.repartition(3)).collect())


def test_quality_weights(spark):
    docs = frame(spark, ["a", "b", "c"])
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 0)], "doc_id long, quality int")
    assert {r["doc_id"]: r["quality"] for r in mixing.with_quality(docs, labels).collect()} == {0: 1.0, 1: 2.0, 2: 0.5}


def test_mixing_limits_sources(spark):
    rows = spark.createDataFrame([(0, "a", 10, 1.0), (1, "b", 1000, 1.0), (2, "c", 500, 1.0)], "doc_id long, source string, size long, quality double")
    got = {r["source"]: r["target"] for r in mixing.mix(rows).collect()}
    assert got["a"] == 30 and abs(sum(got.values()) - 1510) < 1e-9 and abs(got["b"] - 2 * got["c"]) < 1e-9


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def spelled(text):
    return text.translate({48 + i: "abcdefghij"[i] for i in range(10)})


def test_quality(spark):
    rng = random.Random(8)
    texts = list(ODD) + ["x " * 100, "a b c a b c a b", "a\nb\na\na \n\n\na", "#|<> " * 60, "AB CD!! " * 50, prose(rng, 200, 10), spelled(prose(rng, 500)), "\n".join(spelled(prose(rng, 9)) for _ in range(20)), "12 34 " + " ".join(str(x) for x in range(100))]
    got = {r["doc_id"]: r for r in quality.quality_report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == stats(t), t and t[:40]
        assert not (r["base_failed"] and r["kept"])
    kept = quality.quality_filter(frame(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]} and kept.columns == frame(spark, texts).columns
    assert got[17]["kept"] and got[18]["kept"]
    assert quality.quality_report(frame(spark, [])).count() == 0


def test_quality_rules_are_ordered_by_rejection_per_cost(spark):
    df = frame(spark, ["some words and some more of them"] * 400)
    never, always = quality.Rule("never", lambda t, c: F.length(t) < 0), quality.Rule("always", lambda t, c: F.length(t) > 0)
    assert [r.name for r in quality.ordered_rules(df, "text", [never, always])] == ["always", "never"]
    # both reject all rows; one does two hundred times the work, which a job's overhead does not hide
    dear = quality.Rule("dear", lambda t, c: F.aggregate(F.sequence(F.lit(0), F.lit(200)), F.lit(0), lambda s, x: s + F.length(F.regexp_replace(t, "[aeiou]", ""))) > 0)
    cheap = quality.Rule("cheap", lambda t, c: F.length(F.regexp_replace(t, "[aeiou]", "")) > 0)
    (share, slow), (_, fast) = quality.measured(df.select("text"), [dear, cheap])
    assert share == 1.0 and slow > 20 * fast and [r.name for r in quality.ordered_rules(df, "text", [dear, cheap])] == ["cheap", "dear"]
    assert quality.ordered_rules(frame(spark, []), "text", [never, always]) == [never, always]


def test_quality_of_repeated_rows(spark):
    text = spelled(prose(random.Random(9), 120))
    df = frame(spark, [text, None, text, text], ids=[3, 3, 3, None])
    assert Counter((r["doc_id"], r["n_words"], r["kept"]) for r in quality.quality_report(df).collect()) == {(3, 120, True): 2, (3, 0, False): 1, (None, 120, True): 1}
    assert sorted(quality.quality_filter(df).select("doc_id").collect(), key=str) == sorted([(3,), (3,), (None,)], key=str)


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        if not text or kind == "email" and "@" not in text:
            continue
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(6)
    alphabet = ["a", "b.", "@", "@c.de", ".", "1", "22", "255", "256", "0", "-", " ", "+", "(", ")", "é", "😀", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "1.2.3.4", "x@y.z", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(700)]
    texts += list(ODD) + ["a@b.c+d@e.f", "x" * 6_000 + "@", "1" * 6_000, "1.2.3.4.5.6.7.8.9", "+1" * 500, "call +49 170 1234567 or (555) 123-4567", "a@b.c " * 300, "0 " * 3000]
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = [(s["start"], s["kind"], s["end"]) for s in got[i]["spans"] if s["base"]]
        assert spans == base_spans(t), t and t[:80]
        assert [(s["start"], s["kind"]) for s in got[i]["spans"]] == sorted((s["start"], s["kind"]) for s in got[i]["spans"])
    assert pii.find_pii(frame(spark, [])).count() == 0


def card_number(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_recall_and_precision_of_spans(spark):
    """On a corpus with known spans: forms of the base and others, beside what only looks like them."""
    rng = random.Random(41)
    n = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    word = lambda: rng.choice("lorem ipsum dolor sit amet elit sed".split())
    hexes = lambda k: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(k))
    forms = {
        "email": [lambda: f"{word()}.{n(2)}@{word()}.org", lambda: f"{word()}{n(2)} [at] {word()} [dot] com", lambda: f"{word()}(at){word()}.de", lambda: f"{word()}{n(1)} at {word()} dot net"],
        "ip": [lambda: f"{rng.randrange(1, 9)}{n(1)}.{n(2)}.{n(2)}.{n(1)}", lambda: f"2001:{hexes(7)}", lambda: f"2a02:{hexes(2)}::{hexes(1)}"],
        "card": [lambda: card_number(rng), lambda: " ".join(re.findall("....", card_number(rng))), lambda: ".".join(re.findall("....", card_number(rng)))],
        "phone": [lambda: f"+49 170 {n(7)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"0049 30 {n(6)}", lambda: f"01 {n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"030 {n(3)} {n(4)}", lambda: f"(0{n(2)}) {n(6)}"],
    }
    lead = {"email": "contact ", "ip": "server ", "card": "card ", "phone": "call "}
    false = [lambda: f"version 1.2.{n(1)}", lambda: f"12:{n(2)}:{n(2)}", lambda: f"order {n(5)}-{n(2)}", lambda: f"look at {word()}.", lambda: f"{n(4)}.{n(4)}", lambda: f"page {n(3)} of {n(3)}", lambda: f"{n(2)}/{n(2)}/{n(4)}", lambda: "std::vector"]
    texts, want = [], []
    for d in range(700):
        text, spans = "", []
        for _ in range(rng.randrange(6)):
            text += " ".join(word() for _ in range(rng.randrange(1, 12))) + " "
            if rng.random() < 0.6:
                kind = rng.choice(list(forms))
                f = rng.randrange(len(forms[kind]))
                x = forms[kind][f]()
                text += lead[kind] if rng.random() < 0.4 else ""
                spans.append((len(text), pii.KINDS.index(kind), len(text) + len(x), f > 0))
                text += x + rng.choice([" ", ", ", "\n"])
            else:
                text += rng.choice(false)() + " "
        texts.append(text)
        want.append(spans)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find_pii(frame(spark, texts)).collect()}
    for other in (False, True):
        wanted = [(d, x[:3]) for d, spans in enumerate(want) for x in spans if x[3] >= other]
        found = sum(x in got[d] for d, x in wanted)
        assert found >= 0.9 * len(wanted), (found, len(wanted), [texts[d][x[0] : x[2]] for d, x in wanted if x not in got[d]][:20])
    every = [(d, x) for d, spans in got.items() for x in spans]
    right = sum(x in {y[:3] for y in want[d]} for d, x in every)
    assert right >= 0.9 * len(every), (right, len(every), [texts[d][x[0] : x[2]] for d, x in every if x not in {y[:3] for y in want[d]}][:20])


def test_pii_query_columns(spark, monkeypatch):
    monkeypatch.setattr(pii, "table", lambda *a: frame(spark, ["é mail a@b.de, 10.0.0.1", None, "é mail a@b.de, 10.0.0.1", "é mail a@b.de, 10.0.0.1"], ids=[0, 1, 0, None]))
    every = pii.op4_pii(spark, "").collect()
    rows = {r["doc_id"]: r for r in every}
    assert Counter((r["doc_id"], r["spans"]) for r in every) == {(0, "email:7:13,ip:15:23"): 2, (None, "email:7:13,ip:15:23"): 1, (1, ""): 1}
    assert (rows[0]["n_spans"], rows[0]["has_personal_data"], rows[1]["has_personal_data"]) == (2, True, False)
    assert rows[0]["spans"] == "email:7:13,ip:15:23" and (rows[0]["n_email"], rows[0]["n_ip"], rows[0]["n_card"], rows[0]["n_phone"]) == (1, 1, 0, 0)
    assert rows[0]["base_sha256"] == hashlib.sha256(b"email:7:13,ip:15:23").hexdigest() and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pii_labelers_are_weighed(spark):
    """Of three labelers, two agree and one is noise: its reliability comes out near chance."""
    rows = [(0, 1, 1, 1, 450), (0, 1, 1, 0, 440), (0, 0, 0, 1, 460), (0, 0, 0, 0, 450), (0, 1, 0, 1, 10), (0, 0, 1, 0, 12)]
    got = {(r["a"], r["b"], r["c"]): r["p"] for r in pii.reliabilities(spark.createDataFrame(rows, "kind int, a int, b int, c int, n long")).collect()}
    assert got[1, 1, 1] > 0.95 and got[1, 1, 0] > 0.95 and got[0, 0, 1] < 0.05 and got[0, 0, 0] < 0.05


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 63, 64, 65, 500)]
    for r in spark.createDataFrame(rows, "x array<long>").select("x", pii.running_sums(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination(spark):
    rng = random.Random(11)
    items = [prose(rng, n, 3000) for n in (3, 20, 40, 59, 64, 65, 150, 300)] + [prose(rng, 30, 3000) + "\n" + prose(rng, 8, 3000), None, "", "?!"]
    clean = [prose(rng, 400, 3000) for _ in range(30)]
    texts, want = list(ODD) + clean, set()
    for k, item in enumerate(items[:9]):
        for place in (0, 40, 70, 395):
            words = prose(rng, 400, 3000).split(" ")
            want.add((len(texts), k))
            texts.append(" ".join(words[:place]) + " " + item.upper().replace(" ", ", ") + ". " + " ".join(words[place:]))
    docs = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    brute = set()
    for d, t in enumerate(texts):
        mine = {tuple(x) for w in [alnum(t)] for x in ([w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else [])}
        for k, item in enumerate(items):
            w = alnum(item)
            s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if len(w) >= 5 else set()
            if s and len(s & mine) >= 0.9 * len(s):
                brute.add((d, k))
    assert brute <= got and {(d, k) for d, k in want if k} <= got and all(d >= len(ODD) + len(clean) for d, _ in got)
    kept = decontaminate.decontaminate(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got} and kept.columns == docs.columns
    assert decontaminate.contaminated(docs, bench.where("item_id < 0")).count() == 0 and decontaminate.contaminated(docs.where("doc_id < 0"), bench).count() == 0


def test_decontamination_with_short_answers_and_items(spark):
    """Answers and whole items of 1 to 4 words are found where their words stand one after the other, and not where they are apart."""
    rng = random.Random(15)
    answers = [f"A{n}x A{n}y A{n}z A{n}t".split(" ")[:n] for n in range(1, 5)]
    questions = [prose(rng, 25, 3000) for _ in answers]
    items = [f"{q}\n{' '.join(a)}." for q, a in zip(questions, answers, strict=True)]
    items += [f"I{n}x I{n}y I{n}z I{n}t".split(" ")[:n] for n in range(1, 5)]
    items = [" ".join(x) if isinstance(x, list) else x for x in items]
    texts, want = [], set()
    for k, item in enumerate(items):
        for place in (0, 70, 300):
            words = prose(rng, 300, 3000).split(" ")
            want.add((len(texts), k))
            texts.append(" ".join([*words[:place], item.lower(), *words[place:]]))
        want.add((len(texts), k))
        texts.append(item)
    for q, a in zip(questions, answers, strict=True):  # the question alone, or beside the answer's words in another order
        texts += [f"{prose(rng, 100, 3000)} {q} {prose(rng, 100, 3000)}", *([f"{q} {' '.join(a[::-1])}"] if len(a) > 1 else [])]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and all(r["question_overlap"] == r["answer_overlap"] == 1.0 for r in rows)
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_scores_do_not_depend_on_shards(spark):
    rng = random.Random(22)
    items = [(k % 30, prose(rng, rng.randrange(1, 150), 300)) for k in range(40)] + [(None, "a b c"), (7, None)]
    texts = [prose(rng, 100, 300) + " " + items[k][1] for k in range(40)]
    docs, bench = frame(spark, texts, ids=[k % 25 for k in range(40)]), spark.createDataFrame(items, "item_id long, text string")

    def found(chars):
        out = []
        for index in decontaminate.indexes(bench, 0.5, 0.5, chars):
            words = decontaminate._words(texts)
            out += [(t, index.value.ids[i], round(s, 12)) for t, i, s in index.value.retrieve(np.concatenate(words), np.concatenate([[0], np.cumsum([len(w) for w in words])]))]
        return sorted(out)

    assert found(10**9) == found(2000) and len(list(decontaminate.indexes(bench, 0.5, 0.5, 2000))) > 3
    rows = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert all(rows[k % 25, items[k][0]] >= 1 for k in range(40))


def test_decontamination_query(spark, monkeypatch):
    """Repeated documents and items, and documents and items without an id or a text."""
    rng = random.Random(23)
    item, text = prose(rng, 30, 3000), prose(rng, 200, 3000)
    docs = frame(spark, [text + " " + item, text, None, text + "\n" + item, text + " " + item], ids=[1, 2, 3, 1, None])
    bench = spark.createDataFrame([(5, item), (5, item), (6, item), (None, item), (7, None), (8, "")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "table", lambda _, __, name: docs if name == "documents" else bench)
    rows = decontaminate.op6_benchmark_decontamination(spark, "").collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in rows) == {(d, i): n * m for d, n in ((1, 2), (None, 1)) for i, m in ((5, 2), (6, 1))}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3]


def test_wand_equals_exhaustive_scoring(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    items = [(i, prose(rng, rng.randrange(1, 90), 60)) for i in range(80)]
    index = decontaminate.Index(items, 0.3, 0.5)
    texts = [prose(rng, rng.randrange(1, 400), 60) for _ in range(60)]
    words = decontaminate._words(texts)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    got = {(t, i): s for t, i, s in index.retrieve(np.concatenate(words), first)}
    dense = np.zeros((len(index.terms), len(index.owner)))
    for t in range(len(index.terms)):
        for p in range(index.begin[t], index.begin[t + 1]):
            dense[t, index.segment[p]] = index.impact[p]
    want = {}
    for t, w in enumerate(words):
        stride = decontaminate.STRIDE
        for k in range(max(1, -(-(len(w) - stride) // stride))):
            terms = np.flatnonzero(np.isin(index.terms, w[k * stride : (k + 2) * stride]))
            for s in np.flatnonzero(dense[terms].sum(0) >= 0.3):
                key = (t, int(index.owner[s]))
                want[key] = max(want.get(key, 0), dense[terms].sum(0)[s])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def plain(template, rng=None):
    """A text that a template accepts: without its regions, or with random choices."""
    parts = licenses._MARKUP.findall(template)

    def sequence():
        out = []
        while parts and parts[0] not in ("]]", "|"):
            item = parts.pop(0)
            if item == "[[":
                choices = [sequence()]
                while parts.pop(0) == "|":
                    choices.append(sequence())
                out += rng.choice([[], *choices]) if rng else []
            elif item.startswith("<<"):
                k, _, words = item[2:-2].partition(":")
                options = [x.split() for x in words.split("|")] if words else []
                free = [[f"any{rng.randrange(9)}"] * n for n in range(0 if not words else 1, int(k) + 1)] if rng else []
                out += rng.choice([*options, *free]) if rng else options[0] if options else []
            else:
                out.append(item)
        return out

    return " ".join(sequence())


def pattern(template):
    """The template as a regular expression over words that each end in a space."""
    out, any_ = "", "(?:[^ ]+ )"
    for item in licenses._MARKUP.findall(template):
        if item in ("[[", "]]", "|"):
            out += {"[[": "(?:", "]]": ")?", "|": "|"}[item]
        elif item.startswith("<<"):
            k, _, words = item[2:-2].partition(":")
            options = ["".join(f"{w} " for w in x.split()) for x in words.split("|")] if words else []
            free = [f"{any_}{{{1 if words else 0},{k}}}"] if int(k) or not words else []
            out += "(?:" + "|".join(options + free) + ")"
        else:
            out += f"{item} "
    return out


def test_licenses(spark):
    rng = random.Random(31)
    own = [(label, t) for label, ts in licenses.TEMPLATES.items() for t in ts]
    texts = list(ODD) + [
        "Released under the MIT License. And the mit, license!", "Licensed under the Apache License, Version 2.0. More words.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "licensed under something else", "general public, (license) general public license apache\nlicense", "MIT license" * 3, "mit" + " " * 5000 + "license",
        plain(licenses.TEMPLATES["mit"][0]).title(), plain(licenses.TEMPLATES["mit"][0]).replace("granted", "given"),
        "Licensed under the GNU Lesser General Public License v2.1 or later", "gnu affero general public license", "SPDX-License-Identifier: GPL-2.0-only", "licensed under the gnu general public license version 3 or later",
    ] + [plain(t, rng).title() for _, t in own]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, places, labels, covered = alnum(t), [], set(), set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            covered |= {k + j for k in hits for j in range(len(p))}
            labels |= {label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        if len(w) > 60:
            continue
        line = "".join(f"{x} " for x in w)  # labels and score by regular expressions: of each template the longest texts, from left to right
        starts, found = [0, *(k + 1 for k, c in enumerate(line) if c == " ")], []
        for label, template in own:
            expression, at = re.compile(pattern(template)), 0
            for k in starts:
                if k >= at and (ends := [e for e in starts if e > k and expression.fullmatch(line, k, e)]):
                    at = max(ends)
                    found.append((k, at, label))
        found = [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and y[:2] != x[:2] for y in found)]
        labels |= {x[2] for x in found}
        covered |= {k for x in found for k in range(starts.index(x[0]), starts.index(x[1]))}
        assert set(r["labels"].split(",")) - {""} == labels and abs(r["score"] - (len(covered) / len(w) if w else 0)) < 1e-9, t
    n = len(ODD)
    assert [got[n + k]["labels"] for k in (3, 4, 8, 9, 10, 11, 12)] == ["cc-by-nc", "", "mit", "", "gpl,lgpl", "agpl,gpl", "gpl"]
    assert [got[n + k]["score"] for k in (8, 10, 11, 12, 13)] == [1.0] * 5
    assert all(label in got[n + 14 + k]["labels"].split(",") for k, (label, _) in enumerate(own))
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_common_notices(spark):
    openbsd = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    kernel = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
    conditions = "This file is free software; you can redistribute it and/or modify it under the terms and conditions of the GNU General Public License, version 2, as published by the Free Software Foundation"
    of_version = "this program is free software: you can redistribute it and/or modify it under the terms of version 3 of the GNU General Public License as published by the Free Software Foundation"
    four = (
        licenses._BSD.replace("[[1|a]]", "1.").replace("[[2|b]]", "2.") + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
        "This product includes software developed by the University. 4. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    )
    head = "SPDX-License-Identifier: "
    cases = [
        (openbsd, "isc", True), (kernel, "gpl", False), (conditions, "gpl", False), (of_version, "gpl", False), (four, "bsd", True), (head + "MIT OR Apache-2.0", "apache,mit", True),
        (head + "(GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause OR (MIT AND Zlib)", "bsd,gpl,mit,zlib", True), (head + " OR ".join(["MIT"] * 50 + ["ISC"]), "isc,mit", True),
        (head + "MIT OR Unheard-Of OR ISC", "mit", False), (head + "MIT and more", "mit", False), (head + "unknown", "", False), (head, "", False), (head + "MIT or", "mit", False),
        ("Licensed under the Eclipse Public License v2.0", "epl", True), ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl", True), ("released under the WTFPL", "wtfpl", True),
        ("distributed under the Artistic License 2.0", "artistic", True), ("under the PostgreSQL License", "postgresql", True),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, [c[0] for c in cases])).collect()}
    assert [(got[i]["labels"], got[i]["score"] == 1.0) for i in sorted(got)] == [c[1:] for c in cases]


def test_license_query(spark, monkeypatch):
    docs = frame(spark, ["Mit license, mit license", None, "Mit license, mit license", "Mit license, mit license"], ids=[4, 4, None, 4])
    monkeypatch.setattr(licenses, "table", lambda *a: docs)
    rows = sorted((tuple(r) for r in licenses.op10_license_scan(spark, "").collect()), key=str)
    assert rows == sorted([(4, 4, 2, 0, 2, "mit", "mit", 1.0)] * 2 + [(4, 0, 0, None, None, "", "", 0.0), (None, 4, 2, 0, 2, "mit", "mit", 1.0)], key=str)


def test_license_automata():
    def accepts(template, text):
        m = licenses.Automaton(template)
        h = np.array(licenses._hashes(text), np.uint64)
        places = licenses._places(h, np.zeros(len(h), int), m.anchor)
        return any(m.run(h, int(p), len(h), m.anchor_state) >= 0 for p in places)

    t = "under the [[x|y z]] license <<2>> holds"
    assert all(accepts(t, x) for x in ("under the license holds", "under the X license holds", "under the y z license a b holds", "so under the license a holds."))
    assert not any(accepts(t, x) for x in ("under the y license holds", "under the license a b c holds", "under license holds", ""))
    assert accepts("by <<0:cc by|gnu>> only", "by cc by only") and not accepts("by <<0:cc by|gnu>> only", "by bsd only")


def test_license_automata_equal_regular_expressions():
    rng = random.Random(32)

    def template(depth=0):
        out = []
        for _ in range(rng.randrange(1, 4)):
            x = rng.random()
            if x < 0.3 and depth < 2:
                out.append("[[" + "|".join(template(depth + 1) for _ in range(rng.randrange(1, 3))) + "]]")
            elif x < 0.5:
                out.append(rng.choice(["<<1>>", "<<2>>", "<<0:a|b c>>", "<<1:c>>"]))
            else:
                out.append(rng.choice("abc"))
        return " ".join(out)

    for _ in range(600):
        t = template()
        try:
            m = licenses.Automaton(t)
        except ValueError:  # no mandatory word
            continue
        words = [rng.choice("abcd") for _ in range(8)]
        h = np.array(licenses._hashes(" ".join(words)), np.uint64)
        for at in range(len(words)):
            ends = [e for e in range(at, len(words) + 1) if re.fullmatch(pattern(t), "".join(f"{w} " for w in words[at:e]))]
            assert m.run(h, at, len(h)) == max(ends, default=-1), (t, words[at:])


def test_token_files(spark):
    from tokenizers import Tokenizer

    rng = random.Random(13)
    texts = list(ODD) + [prose(rng, 50) for _ in range(40)] + ["Hello, <|endoftext|> it's", "ΑΣ Σας", "é ́e İ", "a b　c"]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    path = new_path(spark, "test-tokens")
    tokens.write_token_file(frame(spark, texts, ids=ids).repartition(4), path)
    got = {r["doc_id"]: r for r in tokens.read_token_file(spark, path).collect()}
    t = Tokenizer.from_file(tokens.tokenizer_path())
    start = 0
    for i, text in sorted(zip(ids, texts, strict=True)):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes())), text
        start += len(want)
    path = new_path(spark, "test-tokens")
    tokens.write_token_file(frame(spark, []), path)
    assert tokens.read_token_file(spark, path).count() == 0


def test_encoder_with_whole_texts_and_small_caches(monkeypatch):
    from tokenizers import Tokenizer

    texts = ["Hello  world", "", "a\nb é", "the the the"]
    raw = [x.encode() for x in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    monkeypatch.setattr(tokens, "WORDS_HELD", 3)
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = tokens.tokenizer_path(name)
        e, t = tokens.Encoder(path), Tokenizer.from_file(path)
        assert e.by_word == by_word
        for _ in range(2):
            out, stops = e.encode(data, offsets, 7)
            for i, text in enumerate(texts):
                assert out[stops[i] : stops[i + 1]].tolist() == [*t.encode(text, add_special_tokens=False).ids, 7]


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes(unit, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 100)
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 10), (99, 65535), (250, 65536), (1000, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        payload, index = tokens.pack_segment(ids, unit, 3)
        assert np.array_equal(tokens.read_segment(payload, index), ids)
        if n > 200:
            assert np.array_equal(tokens.read_segment(payload, index, range(1, 2)), ids[100:200])


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_token_counts(spark, block):
    rng = random.Random(block)
    want, blocks = {}, []
    for file in range(4):
        lengths = [rng.choice([0, 0, 1, 2, 5, 20]) for _ in range(15)]
        flat = [x for n in lengths for x in [*[rng.randrange(9) for _ in range(n)], 99]]
        if file == 1:
            flat += [1, 2, 3]
            lengths.append(3)
        if file == 2:
            flat, lengths = [5] * 20, [20]
        want |= {(file, i): n for i, n in enumerate(lengths)}
        blocks += [(file, k // block, bytearray(np.array(flat[k : k + block], "<u4").tobytes())) for k in range(0, len(flat), block)]
    df = spark.createDataFrame(blocks, "file int, block long, data binary").repartition(3)
    assert {(r["file"], r["doc_no"]): r["n_tokens"] for r in tokens.token_counts(df, 99).collect()} == want
    assert tokens.token_counts(df.where("file < 0"), 99).count() == 0


def test_flat_files(spark, tmp_path, monkeypatch):
    rng = random.Random(51)
    want = {}
    for name in ("a.bin", "b c.bin", "é.bin"):
        lengths = [rng.randrange(6) for _ in range(40)]
        ids = [x for n in lengths for x in [*[rng.randrange(9) for _ in range(n)], 99]]
        np.array(ids, "<u4").tofile(tmp_path / name)
        want |= {(name, i): n for i, n in enumerate(lengths)}
    (tmp_path / "empty.bin").write_bytes(b"")
    for schemes in (tokens.RANGED, ("none",)):  # byte ranges, and whole files
        monkeypatch.setattr(tokens, "RANGED", schemes)
        for block in (3, 1000):
            rows = tokens.token_counts(tokens.flat_blocks_from_files(spark, str(tmp_path), block), 99).collect()
            assert {(unquote(r["file"].rsplit("/", 1)[1]), r["doc_no"]): r["n_tokens"] for r in rows} == want


def test_tokens_of_repeated_documents(spark, monkeypatch):
    """Equal ids, ids that are null, repeated rows: each row is a document of its own."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    docs = frame(spark, ["b text", "a text", "a text", "none", None], ids=[7, 7, 7, None, 3])
    monkeypatch.setattr(tokens, "table", lambda *a: docs)
    rows = sorted(tokens.op9_token_output(spark, "").collect(), key=lambda r: r["start"])
    want, start = [], 0
    for i, text in ((None, "none"), (3, ""), (7, "a text"), (7, "a text"), (7, "b text")):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == want
    counts = Counter((r["doc_id"], r["n_tokens"]) for r in tokens.op3_token_counts(spark, "").collect())
    assert counts == Counter((i, n - 1) for i, _, n, _ in want)


def test_token_count_query(spark, monkeypatch):
    from tokenizers import Tokenizer

    texts = list(ODD) + ["some more words"] * 3
    monkeypatch.setattr(tokens, "table", lambda *a: frame(spark, texts).repartition(3))
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    t = Tokenizer.from_file(tokens.tokenizer_path())
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.op3_token_counts(spark, "").collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
