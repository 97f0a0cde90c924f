"""Spelling variants against all pairs compared one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from flowspark.llm import spelling
from flowspark.llm.spelling import SuffixRanks, count_words, near_words, roots, spelling_variants


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((v for v in counts if one_apart(w, v)), key=lambda v: (-counts[v], v))
        form = near[0] if near and counts[near[0]] >= 2 * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def vocabulary(seed, size, letters="abé"):
    dice = random.Random(seed)
    words = {"".join(dice.choice(letters) for _ in range(dice.randint(5, 11))) for _ in range(size)}
    return {w: dice.choice([3, 3, 4, 6, 12, 50, 200]) for w in words}


def test_the_index_finds_all_words_one_error_behind_the_exact_half():
    for seed, letters in enumerate(("ab", "abé", "abcdefgh", "a🙂ÿ")):
        words = sorted(vocabulary(seed, 250, letters))
        asking = words[::3] + sorted(vocabulary(seed + 90, 60, letters + "q"))
        of, target = SuffixRanks(words).near(asking)
        want = {(a, b) for a in asking for b in words if one_apart(a, b) and b.startswith(a[:len(a) // 2])}
        got = [(asking[i], words[j]) for i, j in zip(of, target, strict=True)]
        assert set(got) == want and len(set(zip(of, target, strict=True))) == len(got)


@pytest.mark.parametrize("shard,hot,chunk", [(50_000, 10_000, 8192), (60, 7, 11)])
def test_near_words_equal_all_pairs(spark, monkeypatch, shard, hot, chunk):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "LEAST_SHARD", shard)
    monkeypatch.setattr(spelling, "HOT_KEY", hot)
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    counts = vocabulary(7, 500) | vocabulary(8, 300, "xyzuvw") | {"x" * 3000: 3, "x" * 2999 + "y": 9, "x" * 2999: 4}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in near_words(words).collect()}
    want = {}
    for w in counts:
        near = sorted((v for v in counts if one_apart(w, v)), key=lambda v: (-counts[v], v))
        if near:
            want[w] = (len(near), counts[near[0]], near[0])
    assert got == want


def test_variants_of_documents_equal_a_plain_run(spark):
    dice = random.Random(3)
    base = sorted(vocabulary(11, 60, "aeioué"))
    docs = []
    for i in range(400):
        words = [dice.choice(base[:dice.choice([3, 20, 60])]) for _ in range(dice.randint(0, 60))]
        docs.append((dice.choice([i, i, None]), "".join(w + dice.choice([" ", ", ", "\n", "3", " X"]) for w in words).title()))
    docs += [(1, None), (2, ""), (3, "AAAAA×÷ Ünïçôdé ünïçôdé ünïçôdé"), docs[5], docs[5]]
    schema = "doc_id long, text string, word string, n long, name string, run string, key string, side int, root string"
    table = spark.createDataFrame([(*d, "w", 1, "n", "r", "k", 2, "z") for d in docs], schema)
    counts = plain_counts(docs)
    assert {r.word: r.n for r in count_words(table).collect()} == counts
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(table).collect()}
    assert got == plain_variants(counts)
    assert sum(form is not None for form, *_ in got.values()) > 20
    assert spelling_variants(table.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("other", "w7"), ("a", "b")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "other": "w40", "a": "b"}
