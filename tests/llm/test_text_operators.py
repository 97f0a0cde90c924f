"""Operators that SQL can express: the messy table against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from llm_tables import MESSY, MESSY_IDS, prose, table
from pyspark.sql import functions as F

from flowspark.llm import chunk_dedup, mixing, simhash
from flowspark.llm.decontaminate import contamination, drop_contaminated
from flowspark.llm.host_reputation import judge
from flowspark.llm.line_dedup import drop_repeated_lines, kept_lines
from flowspark.llm.quality_rules import keep_good, quality_rules

ROWS = [*zip(MESSY_IDS, MESSY, strict=True), (6, MESSY[6])]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def repeated_words(words):
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    return len({i + k for found in at.values() if len(found) > 1 for i in found for k in range(5)})


def test_quality_rules(messy, empty):
    want = []
    for doc, text in ROWS:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        again = repeated_words(words)
        want.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
                     again, len(words) < 10 or 100 * again > 20 * len(words)))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality_rules(messy)
    assert rows_of(got, *columns) == sorted(want, key=repr)
    assert quality_rules(empty).count() == 0
    assert all(not (r.base_failed and r.kept) for r in got.collect())
    kept = keep_good(messy)
    assert kept.columns == messy.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.where("kept").collect()}
    bad = quality_rules(table(messy.sparkSession, ["a%% b## " * 20 + prose(20, 3), "WHAT!! NOW!! " + prose(3, 1) + " SO!! YES!! " * 9]))
    assert [r.kept for r in bad.collect()] == [False, False]


def test_function_words_by_language(spark):
    plain = " ".join(f"xq{i}z" for i in range(60))
    english = " ".join(f"The xq{i}z," if i % 5 else f"xq{i}z of" for i in range(60))
    rows = [(1, plain, "en"), (2, plain, "fi"), (3, plain, None), (4, english.upper(), "en"), (5, english, "de"), (6, plain + " the", "en"), (7, plain[:200], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality_rules(docs).where("kept").collect()} == {2, 3, 4, 7}
    assert {r.doc_id for r in keep_good(docs.drop("lang")).collect()} == {1, 2, 3, 4, 5, 6, 7}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_line_dedup(spark, messy, empty, partitions):
    shared = "a line that very many documents hold"
    texts = [f"{shared}\n{prose(8, i)}\n{'  ' + shared.upper()}" for i in range(40)]
    docs = messy.unionByName(table(spark, texts, list(range(100, 140))))
    rows = [*ROWS, *zip(range(100, 140), texts, strict=True)]

    def key(line):
        k = lower(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 10 else None
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    first = {k: min(d, key=lambda x: (x is None, x or 0)) for k, d in holders.items() if k and len(d) > 1}
    want = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in first or first[key(x)] == doc]
        want.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = kept_lines(docs).withColumn("kept", F.coalesce("kept", F.lit("")))
        assert rows_of(got, "id", "n_lines", "n_dropped", "kept") == sorted(want, key=repr)
        assert rows_of(drop_repeated_lines(docs).na.fill("", ["text"]), "doc_id", "text") == sorted(((x[0], x[3]) for x in want), key=repr)
        left = [(x[0], x[3]) for x in want if not x[2] or len(x[3].split()) >= 10]
        assert rows_of(drop_repeated_lines(docs, least_words=10).na.fill("", ["text"]), "doc_id", "text") == sorted(left, key=repr)
        assert drop_repeated_lines(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("limit", [1000, 0])
def test_decontamination(spark, messy, empty, limit):
    """Broadcast and shuffled benchmark give the same; spans at both ends, short items, repeated items."""
    items = [prose(30, 50), prose(12, 51), "Two WORDS", "zebra", None, "", prose(30, 50), prose(10, 52)]
    texts = [prose(20, 60) + " " + prose(30, 50) + "!", prose(12, 51)[: len(prose(12, 51)) // 2], "say two-words now", "Zebra zebra",
             prose(10, 52) + ". " + prose(10, 52), prose(200, 61)]
    docs = messy.unionByName(table(spark, texts, list(range(200, 206))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def words(text):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or "")) if w]
    windows = defaultdict(set)
    for i, text in enumerate(items):
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(i)
    want = []
    for doc, text in [*ROWS, *zip(range(200, 206), texts, strict=True)]:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        want.append((doc, len(w), len(hit), sorted(found)))
    got = contamination(docs, bench, broadcast_rows=limit).withColumn("items", F.sort_array("items"))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    assert any(x[2] for x in want) and not all(x[2] for x in want)
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted([r.doc_id for r in clean.collect()], key=repr) == sorted([x[0] for x in want if not x[2]], key=repr)
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_a_large_benchmark_is_not_met_by_whole_texts(spark, messy):
    bench = spark.createDataFrame([(1, prose(30, 50))], "item_id long, text string")
    docs = messy.select("doc_id", "text")
    for settings in ({"broadcast_rows": 0}, {}):
        plan = contamination(docs, bench, **settings)._jdf.queryExecution().optimizedPlan().toString()
        by_mark = [x for x in plan.split("\n") if "Join" in x and "mark#" in x]
        assert by_mark and ("broadcast" in "".join(by_mark)) == (not settings)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = contamination(docs, bench, broadcast_rows=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [x for x in text.split("\n") if "Exchange hashpartitioning(mark#" in x]
    assert dealt
    lines = text.split("\n")
    for x in dealt:      # what lies below an exchange by mark gives out no array of words
        below = lines[lines.index(x) + 1]
        assert " w#" not in below.split("[", 1)[-1], below


def test_documents_carry_no_lists_of_items(spark, messy):
    """A passage of many items costs a document a number; fingerprints are sent out where whole windows are too many."""
    bench = spark.createDataFrame([(i, prose(30, 50)) for i in range(60)] + [(100, prose(30, 50) + " " + prose(9, 51))], "item_id long, text string")
    docs = messy.select("doc_id", "text").unionByName(table(spark, [prose(20, 60) + " " + prose(30, 50)], [300]).select("doc_id", "text"))
    for limit in (200_000, 5, 0):
        got = contamination(docs, bench, broadcast_rows=limit)
        hit = got.where("n_hit > 0").collect()
        assert [(r.doc_id, r.n_hit, sorted(r["items"])) for r in hit] == [(300, 30, [*range(60), 100])]
        plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
        met = [x for x in plan if "Aggregate [doc_id#" in x and "collect_set(" in x][-1]      # the lowest one
        assert "items#" not in met, met
        by_mark = "".join(x for x in plan if "Join" in x and "mark#" in x)
        assert ("broadcast" in by_mark) == (limit > 0)


CLASHING = ("row id key of_id of_key kept keep cut copies copy taken n_lines n_dropped spans later print first component_id least at w mark known place spot cell "
            "__own_key __id __key __keep __copies __copy __cut __spans __row __body __text __words text_key doc_key h1 h2 pos line gone kind").split()


def test_stages_bear_any_column_name(spark):
    texts = [prose(40, 1), prose(40, 1), prose(40, 2) + "\n" + prose(30, 3), prose(30, 3) + "\n" + prose(30, 4), prose(50, 5)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), *[f"{c}-{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *CLASHING])
    bench = spark.createDataFrame([(1, prose(50, 5))], "item_id long, text string")
    stages = {"rules": keep_good(docs), "lines": drop_repeated_lines(docs), "copies": simhash.keep_one_each(docs),
              "clean": drop_contaminated(docs, bench), "mix": mixing.mix(docs), "passages": chunk_dedup.drop_repeats(docs)}
    want = {"rules": {0, 1, 2, 3, 4}, "lines": {0, 1, 2, 3, 4}, "copies": {0, 2, 3, 4}, "clean": {0, 1, 2, 3}, "passages": {0, 1, 2, 3, 4}}
    for name, df in stages.items():
        mine = [c for c in docs.columns if name != "passages" or c != "__spans"]
        assert df.columns[:len(mine)] == mine
        got = df.collect()
        assert {r.doc_id for r in got} == want.get(name, {r.doc_id for r in got}) and got, name
        assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in mine if c in CLASHING), name


def test_mixing(spark, messy, empty):
    docs = messy.unionByName(table(spark, [prose(5 + i % 40, i) for i in range(600)], list(range(1000, 1600))))
    docs = docs.withColumn("source", F.when(F.col("doc_id") < 1300, F.lit("big")).when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.col("source")))
    got = mixing.copies(docs).collect()
    assert len(got) == docs.count()
    sources = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        name = sources[r.doc_id]
        sizes[name] += r["size"]
        taken[name] += r["size"] * r.copies
        target[name] = r.target
        assert 0 <= r.copies <= 2
    total = sum(sizes.values())
    assert math.isclose(sum(target.values()), 1.5 * total)
    longest = max(r["size"] for r in got)
    for name, goal in target.items():
        assert goal <= 2 * sizes[name] + 1e-6
        assert abs(taken[name] - goal) <= 2 * longest
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level = {target[s] / weight[s] for s in order if target[s] < 2 * sizes[s] - 1e-6}
    assert max(level) - min(level) < 1e-6 and all(2 * sizes[s] / weight[s] <= min(level) + 1e-6 for s in order if target[s] >= 2 * sizes[s] - 1e-6)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.copies(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.copies(empty).count() == 0


def test_host_reputation(spark):
    urls = [None, "", "nonsense", "http://Example.com/en/1?x", "https://www.example.com/en/2", "http://sub.example.com/fr/", "ftp://a.net/es/1",
            "http://a.net/de/1", "http://b.org", "http://b.co.uk/p#f", "http://10.0.0.1:80/x", "http://a.net/fr/2", "http://example.net/es"]
    pages = spark.createDataFrame([(i % 12, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.host + r.path: (r.rule, r.verdict) for r in judge(pages).collect()}
    assert got["example.com/en/1"] == ("example.com/en/", "block")
    assert got["www.example.com/en/2"] == ("www.example.com/en/", "allow")
    assert got["sub.example.com/fr/"] == ("com/", "allow")
    assert got["a.net/es/1"] == ("net/es/", "block") and got["example.net/es"][0] is None
    assert got[""][0] is None and got["b.org"] == (None, "allow")
    assert judge(pages).count() == len(urls)
    assert rows_of(judge(pages, broadcast_hosts=0), "page_id", "host", "verdict") == rows_of(judge(pages), "page_id", "host", "verdict")
    assert judge(pages.limit(0)).count() == 0


