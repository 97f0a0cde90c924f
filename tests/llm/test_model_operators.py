"""Operators without SQL: brute force, round trips and held-out quality on small tables."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_tables import MESSY, MESSY_IDS, prose, table

import corpus_pipeline
from flowspark.llm import chunk_dedup, cotraining, page_diff, recurrent_lm, simhash
from flowspark.llm.quality_rules import PUNCTUATION, STOP_WORDS

ROWS = [*zip(MESSY_IDS, MESSY, strict=True), (6, MESSY[6])]


# ---- SimHash -------------------------------------------------------------------------------------------------------

def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.UPPER_TO_LOWER))
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_simhash_documents(spark, messy, empty):
    text = prose(300, 70)
    near = [text, text.replace("lorem", "LOREM"), text + " tail", "start " + text, prose(300, 71)]
    docs = messy.unionByName(table(spark, near, [305, 304, 303, 302, 301]))
    rows = [*ROWS, *zip([305, 304, 303, 302, 301], near, strict=True)]
    prints = [slow_print(t) for _, t in rows]
    groups = defaultdict(list)
    for at, label in enumerate(slow_components(prints)):
        groups[label].append(at)
    least = {}
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        least |= {m: min(ids) if ids else None for m in members}
    got = simhash.near_duplicates(docs).collect()
    have = sorted(((r.doc_id, r["print"] % (1 << 64), r.component_id) for r in got), key=repr)
    assert have == sorted(((rows[i][0], prints[i], least[i]) for i in range(len(rows))), key=repr)
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("small", [512, 4])
def test_simhash_links(spark, small):
    """Dense clusters, chains and loners; with a small limit every posting is cut a second time."""
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    centre = int(rng.integers(0, 1 << 63))
    for _ in range(150):
        prints.append(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 7)), replace=False)))
    step = prints[0]
    for b in range(0, 60, 3):
        step ^= 0b111 << b
        prints.append(step)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(frame, small)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for p, label in zip(prints, slow_components(prints), strict=True):
        got[roots.get(p, p)].add(p)
        want[label].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ---- chunks --------------------------------------------------------------------------------------------------------

def test_gear_hash_and_chunks():
    gear = chunk_dedup.gear_table()
    data = np.frombuffer((prose(400, 9) + "z" * 3000).encode(), np.uint8)
    h, slow = np.uint16(0), []
    with np.errstate(over="ignore"):
        for byte in data:
            h = (h << np.uint16(1)) + gear[byte]
            slow.append(h)
    assert (chunk_dedup.gear_hashes(data, gear) == np.array(slow)).all()
    ends = chunk_dedup.boundaries(data, gear)
    assert ends[-1] == len(data) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= chunk_dedup.MAX_CHUNK
    shifted = np.frombuffer(b"something put in front " + data.tobytes(), np.uint8)
    assert len({*(chunk_dedup.boundaries(shifted, gear) - 23)} & {*ends}) > 0.9 * len(ends)


def test_substring_dedup(spark, messy, empty):
    passages = [prose(55 + i, 500 + i) for i in range(40)]
    texts = [prose(80, 600 + i) + " " + passages[i] + " " + prose(80, 700 + i) for i in range(40)]
    texts += [prose(30, 800 + i) + " " + passages[i] + "." for i in range(40)]
    clean = [prose(150, 900 + i) for i in range(20)]
    docs = messy.unionByName(table(spark, texts + clean, list(range(400, 500))))
    found = {(r.doc_id, s.later): (r, s) for r in chunk_dedup.repeated_passages(docs).collect() for s in r.spans}
    for i in range(40):
        assert (400 + i, False) in found and (440 + i, True) in found
        span = found[440 + i, True][1]
        assert passages[i].startswith(texts[40 + i][span.start:span.end].strip()[:30]) or texts[40 + i][span.start:span.end].strip() in passages[i] + "."
    assert not [d for d, _ in found if d is not None and d >= 480]
    cut = {(r.doc_id, len(r.text or "")): r.text for r in chunk_dedup.drop_repeats(docs).collect()}
    assert len(chunk_dedup.drop_repeats(docs).columns) == len(docs.columns) + 1
    assert any(d == 440 and passages[0][60:120] not in t for (d, _), t in cut.items())
    assert chunk_dedup.repeated_passages(empty).count() == 0


def test_substring_dedup_without_white_space_and_periodic(spark):
    """Shared Chinese passages, long tokens and periodic text are found at any offset, whatever surrounds them."""
    rng = np.random.default_rng(6)

    def han(n):
        return "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n)))

    def token(n):
        return "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), n))
    shared = [han(150), token(600), "buy now " * 200, "abc" * 700, "x" * 2500]
    texts = [before + passage + after for passage in shared for before, after in
             ((han(211), han(190)), (token(97) + " ", " " + prose(40, 31)), (prose(33, 32) + " ", ""))]
    texts += [han(900), token(2000)]
    got = {r.doc_id: r.spans for r in chunk_dedup.repeated_passages(table(spark, texts)).collect()}
    for at, passage in enumerate(shared):
        for doc in range(3 * at, 3 * at + 3):
            text = texts[doc]
            low = text.index(passage)
            high = low + len(passage)
            mine = [s for s in got.get(doc, []) if s.later == (doc > 3 * at)]
            assert sum(max(0, min(s.end, high) - max(s.start, low)) for s in mine) > 0.5 * len(passage), (at, doc, got.get(doc))
    assert 15 not in got and 16 not in got


def test_periodic_text_of_any_period(spark):
    """Passages that repeat a phrase of one to six words are found, whatever the phrase."""
    rng = np.random.default_rng(12)
    phrases = ["ha ", "no no yes "] + [" ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(1 + i % 6)) + " " for i in range(36)]
    passages = [p * (-(-2000 // len(p))) for p in phrases]
    texts = [prose(30, 2000 + 2 * i + k) + " . " + p + prose(25, 3000 + 2 * i + k) for i, p in enumerate(passages) for k in (0, 1)]
    got = {r.doc_id: r.spans for r in chunk_dedup.repeated_passages(table(spark, texts)).collect()}
    for i, p in enumerate(passages):
        for doc in (2 * i, 2 * i + 1):
            low = texts[doc].index(p)
            mine = [s for s in got.get(doc, []) if s.later == bool(doc % 2)]
            assert sum(max(0, min(s.end, low + len(p)) - max(s.start, low)) for s in mine) > 0.5 * len(p), (p[:40], got.get(doc))


def test_clean_documents_have_no_passages(spark):
    texts = [prose(200, 5000 + i) for i in range(200)]
    found = chunk_dedup.repeated_passages(table(spark, texts)).count()
    assert found <= 0.05 * len(texts)


# ---- pages ---------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><a>Home</a></nav>"
     "<div class='ad-box'>Buy <div>now</div></div><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>\n text<p>Second&nbsp;one<br>more"
     "<aside>side</aside><div id=\"comments\"><p>nice</p></div></article><form>Name</form><div class=cookie-notice>ok</div><footer>&copy; me", "Head & line First bold text Second one more"),
    ("<body><main><p>Only main</p><!-- no --></main><p>outside</p></body>", "Only main"),
    (None, ""), ("", ""), ("plain &lt;text&gt; ü", "plain <text> ü"), ("<p>unclosed 'quote <a href='x>y</a> z", None),
]


def test_pages_with_marked_article(spark):
    frame = spark.createDataFrame([(i, f"http://h{i}.org/a/{i}", h, "c") for i, (h, _) in enumerate(PAGES)] * 2,
                                  "page_id long, url string, html string, text string")
    got = page_diff.main_text(frame).collect()
    assert len(got) == 2 * len(PAGES)
    for r in got:
        if PAGES[r.page_id][1] is not None:
            assert r.text == PAGES[r.page_id][1]
    assert page_diff.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<body class='no-sidebar'><p>All</p></body>", "All"),
    ("<html class=has-menu><body class='comments-open menu'><article class='post has-comments comments'><p>Kept</p></article>", "Kept"),
    ("<div class='content ad-free'><p>One</p></div><div class='sidebar-widget'>no</div><p>Two", "One Two"),
    ("<article><p class=notice>gone<p>Stays<ul><li class=menu-item>gone<li>Item</ul><p>End</article>", "Stays Item End"),
    ("<html><head><title>T</title><meta charset=utf-8><body><p>Headless end</p>", "Headless end"),
    ("<main><section><div class=ad>gone<span class=share>gone</section><p>After</p></main>", "After"),
    ("<table><tr><td class=ad>gone<td>Cell<tr><td>Row</table><dl><dt class=promo>gone<dd>Term</dl>", "Cell Row Term"),
    ("<div class=nav><div>gone</div>gone</p></div><p>Rest</p>", "Rest"),
    ("<article><div data-id=\"menu\" data-role='nav'><p>Kept</p></div><p aria-id=ad>too</p></article>", "Kept too"),
    ("<article><h2 id=\"related\">Related work</h2><pre>x <span class=\"comment\"># note</span></pre><div id=related>gone</div></article>", "Related work x # note"),
    ("<div title='x'class='menu'>gone</div><p>Left</p>", "Left"),
])
def test_pages_lose_chrome_only(page, want):
    lines, inside, marked = page_diff.lines_of(page)
    assert " ".join(x for x, i in zip(lines, inside, strict=True) if i or not marked) == want


@pytest.mark.parametrize("partitions", ["1", "6"])
def test_pages_without_marked_article(spark, partitions):
    """Template lines go, whether the neighbour is in the same partition or not."""
    rows = []
    for host in ("a.org", "b.org"):
        for i in range(12):
            body = f"<div>Welcome to {host}</div><div>Menu of things</div><p>{prose(12, hash(host) % 50 + i)}</p><p>Own {i}</p><div>Imprint of {host}</div>"
            rows.append((len(rows), f"http://{host}/news/{i:03d}", body))
    rows.append((99, "http://alone.org/x", "<p>All</p><p>mine</p>"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.page_id: r.text for r in page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[99] == "All mine"
    for page, _, body in rows[:-1]:
        assert got[page] == " ".join(re.findall("<p>(.*?)</p>", body))


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_pages_differ_from_the_nearest_other_line_up(spark, partitions):
    """Template lines inside marked articles go, copies of whatever number are looked past, near copies are not emptied."""
    rows, want = [], {}

    def page(host, path, lines, own, marked):
        body = "".join(f"<p>{x}</p>" for x in lines)
        want[len(rows)] = " ".join(own)
        rows.append((len(rows), f"http://{host}/{path}", f"<article>{body}</article><p>outside</p>" if marked else body))
    for marked in (True, False):
        host = f"{marked}.org"
        for i in range(8):
            own = [prose(30, 100 * marked + i), prose(20, 300 + i)]
            page(host, f"a/{i}", ["Share this page", own[0], "Subscribe now", own[1]], own, marked)
        copied = [prose(40, 50 + marked), prose(30, 60)]
        for i in range(30):      # copies, then one with another line at its end
            page(host, f"b/{i:02d}", ["Share this page", *copied, "Subscribe now"], copied, marked)
        page(host, "b/99", ["Share this page", *copied, "Subscribe now", "One line more"], ["Share this page", *copied, "Subscribe now", "One line more"], marked)
    for i in range(12):
        page("copies.org", f"{i}", ["All", "the same"], ["All", "the same"], True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(rows + rows[:20], "page_id long, url string, html string")
        got = page_diff.main_text(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) + 20
    for r in got:
        assert r.text == want[r.page_id], r.page_id


def test_runs_beside_each_other_across_partitions():
    rows = [{"part": p, "run": r, "last": False, "host": h, "line_up": u} for p, r, h, u in
            [(0, 0, 1, 7), (0, 1, 1, 8), (2, 0, 1, 8), (3, 0, 1, 8), (5, 0, 1, 8), (5, 1, 1, 9), (5, 6, 2, 8), (5, 7, 2, 9), (6, 0, 3, 9)]]
    found = {x[:2]: (x[2:4], x[4:]) for x in page_diff._beside(rows)}
    none = (None, None)
    assert found[0, 0] == (none, (0, 1)) and found[0, 1] == ((0, 0), (5, 1))
    assert found[2, 0] == found[3, 0] == found[5, 0] == ((0, 0), (5, 1))
    assert found[5, 7] == ((5, 6), none) and found[6, 0] == (none, none)


def test_common_lines_is_longest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (list(map(str, rng.integers(0, 5, int(rng.integers(0, 12))))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = page_diff.common_lines(a, b)
        assert len(found) == best[-1][-1] and found == sorted(set(found))


# ---- models --------------------------------------------------------------------------------------------------------

def test_recurrent_gradient_and_normalisation():
    shape = recurrent_lm.Shape(np.array([50, 20, 9, 5, 3, 2, 7, 4]))
    vector = shape.start().astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 8, (5, 3)), rng.integers(0, 8, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[2, 1] = True
    h0 = rng.normal(0, 0.5, (3, recurrent_lm.HIDDEN))

    def loss(v):
        return recurrent_lm._backward(shape, shape.views(v), h0, x, y, fresh)[0] / y.size
    _, gradient, _ = recurrent_lm._backward(shape, shape.views(vector), h0, x, y, fresh)
    for at in rng.choice(shape.size, 60, replace=False):
        step = np.zeros(shape.size)
        step[at] = 1e-4
        slope = (loss(vector + step) - loss(vector - step)) / 2e-4
        assert abs(slope - gradient[at]) < 1e-3 + 0.02 * abs(slope)
    p = shape.views(shape.start())
    states = rng.normal(0, 1, (8, recurrent_lm.HIDDEN)).astype(np.float32)
    for s in states:
        total = np.exp(recurrent_lm.log_probabilities(shape, p, np.repeat(s[None], 8, 0), np.arange(8))).sum()
        assert abs(total - 1) < 1e-4


def test_recurrent_training_takes_every_token(spark, monkeypatch):
    """Every training document gives its gradient once, to its last token, by the defaults."""
    seen = []
    inner = recurrent_lm._backward

    def spy(shape, p, h0, x, y, fresh):
        seen.extend(y[y >= 0].tolist())
        return inner(shape, p, h0, x, y, fresh)
    monkeypatch.setattr(recurrent_lm, "_backward", spy)
    shape = recurrent_lm.Shape(np.arange(30, 0, -1) ** 2)
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 29, n), 29) for n in rng.integers(0, 400, 40)]
    assert sum(map(len, texts)) % (sum(map(len, texts)) // (recurrent_lm.SPAN * recurrent_lm.LEAST_STEPS))
    recurrent_lm.train(shape, shape.start(), texts)
    assert sorted(seen) == sorted(np.concatenate(texts).tolist())
    monkeypatch.setattr(recurrent_lm, "_backward", inner)
    words = [f"word{i}" for i in range(90)]
    lexicon = recurrent_lm.Lexicon([w.encode() for w in words], [1] * 90, 90, 180, 91)
    start = lexicon.shape.start()
    frame = spark.createDataFrame([(w,) for w in words], "text string").coalesce(1)
    end = lexicon.shape.views(recurrent_lm.fit(frame, lexicon))["embed"]
    # A word's embedding moves if its document was read, but for the first update: the output weights start at zero.
    moved = (end != lexicon.shape.views(start)["embed"]).any(axis=1)[:90]
    assert moved.sum() >= 90 - recurrent_lm.SPAN // 2


def test_recurrent_padding_adds_nothing():
    shape = recurrent_lm.Shape(np.array([50, 20, 9, 5, 3, 2, 7, 4]))
    vector = shape.start()
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 8, (5, 2)), rng.integers(0, 8, (5, 2))
    fresh, h0 = np.zeros((5, 2), bool), np.zeros((2, recurrent_lm.HIDDEN), np.float32)
    loss, gradient, _ = recurrent_lm._backward(shape, shape.views(vector), h0, x, y, fresh)
    wide = [np.concatenate([a, np.full((5, 1), fill, a.dtype)], axis=1) for a, fill in ((x, 7), (y, -1), (fresh, False))]
    more, padded, _ = recurrent_lm._backward(shape, shape.views(vector), np.zeros((3, recurrent_lm.HIDDEN), np.float32), *wide)
    assert abs(loss - more) < 1e-4 and np.allclose(gradient, padded, atol=1e-6)


def test_recurrent_scores_carry_the_state():
    """Lanes, windows and order change nothing: each text scored alone gives the same."""
    shape = recurrent_lm.Shape(np.arange(30, 0, -1) ** 2)
    vector, rng = shape.start(), np.random.default_rng(2)
    texts = [np.append(rng.integers(0, 29, n), 29) for n in (0, 1, 31, 32, 33, 200, 5, 700)]
    together = recurrent_lm.score_texts(shape, vector, texts)
    p = shape.views(vector)
    for text, value in zip(texts, together, strict=True):
        h, last, want = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 29, 0.0
        for symbol in text:
            h, _ = recurrent_lm._step(p["embed"][[last]] @ p["wx"] + p["b"], h, p["wh"])
            want += float(recurrent_lm.log_probabilities(shape, p, h, np.array([symbol]))[0])
            last = symbol
        assert abs(value - want) < 1e-3 * max(1, len(text))


def test_known_words_when_many_have_one_count(spark):
    counts = spark.createDataFrame([(f"w{i}", 1) for i in range(3000)] + [("often", 50), ("more", 40)], "word string, n long")
    for known in (2, 5, 1000):
        top = recurrent_lm._most_frequent(counts, known)
        assert [w for w, _ in top[:2]] == ["often", "more"] and abs(len(top) - known) < 0.2 * known + 6
    assert len(recurrent_lm._most_frequent(counts.where("n = 1"), 1000)) > 800
    assert len(recurrent_lm._most_frequent(counts, 5000)) == 3002


def test_lm_scoring(spark, messy, empty):
    texts = [" ".join(["alpha beta gamma delta"] * (5 + i % 7)) for i in range(200)] + [" ".join(["uno dos tres"] * (5 + i % 7)) for i in range(200)]
    docs = messy.unionByName(table(spark, texts, list(range(1000, 1400))))
    rows = [*ROWS, *zip(range(1000, 1400), texts, strict=True)]
    import zlib
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts, n = defaultdict(int), 0
    for d, t in rows:
        if not held[d]:
            for w in [*recurrent_lm.words_of(t), b""]:
                counts[w] += 1
                n += 1
    want = []
    for d, t in rows:
        tokens = [*recurrent_lm.words_of(t), b""]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in tokens)
        want.append((d, held[d], len(tokens), sum(w in counts for w in tokens), n, round(float(base), 6)))
    for known in (50_000, 20):     # all words in the tasks, or most of them joined
        got = recurrent_lm.score(docs.coalesce(2), known=known, sample=1, rounds=3).collect()
        have = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
        assert sorted(have, key=repr) == sorted(want, key=repr)
        tested = [r for r in got if r.held_out and r.doc_id >= 1000]
        assert tested and sum(r.score for r in tested) > 0.7 * sum(r.base_score for r in tested)
    assert recurrent_lm.score(empty).count() == 0


def test_cotraining(spark, messy, empty):
    good = [prose(80, 40 + i) for i in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in prose(60, 400 + i).split()) for i in range(100)]
    docs = messy.unionByName(table(spark, good + bad, list(range(2000, 2400))))
    labels = spark.createDataFrame([(i, int(i < 2300), 0) for i in range(2000, 2400, 2)] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotraining.quality_scores(docs, labels).collect()}
    tested = [i for i in range(2001, 2400, 2)]
    assert np.mean([got[i].kept == (i < 2300) for i in tested]) > 0.97
    assert cotraining.quality_scores(docs, labels).count() == docs.count()
    assert {round(r.score, 3) for r in cotraining.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert cotraining.quality_scores(empty, labels).count() == 0


# ---- the pipeline --------------------------------------------------------------------------------------------------

def slow_rules(rows):
    kept = []
    for doc, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        at = defaultdict(list)
        for i in range(len(words) - 4):
            at[tuple(words[i:i + 5])].append(i)
        again = len({i + k for found in at.values() if len(found) > 1 for i in found for k in range(5)})
        n = max(1, len(words))
        good = (len(words) >= 10 and 100 * again <= 20 * len(words) and 1.5 <= sum(map(len, words)) / n <= 25
                and len(re.findall(r"[#*$%&|<>]", text or "")) / n <= 0.3 and (text or "").count("!") / n <= 0.3
                and (len(words) <= 40 or sum(w.lower().strip(PUNCTUATION) in STOP_WORDS["en"] for w in words) / n >= 0.02) and (len(lines) - len(set(lines))) / max(1, len(lines)) <= 0.5)
        if good:
            kept.append((doc, text))
    return kept


def slow_lines(rows):
    def key(line):
        k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 10 else None
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    first = {k: min(d, key=lambda x: (x is None, x or 0)) for k, d in holders.items() if k and len(d) > 1}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in first or first[key(x)] == doc]
        if len(kept) == len(lines) or len("\n".join(kept).split()) >= 10:
            out.append((doc, "\n".join(kept)))
    return out


def slow_copies(rows):
    label = slow_components([slow_print(t) for _, t in rows])
    ids = defaultdict(list)
    for (doc, _), group in zip(rows, label, strict=True):
        ids[group].append(doc)
    return sorted((min((d for d in found if d is not None), default=None) for found in ids.values()), key=repr)


def slow_clean(rows, items):
    def words(text):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    windows = set()
    for text in items:
        w = words(text)
        n = min(10, len(w))
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1 if n else 0)}
    sizes = {len(x) for x in windows}
    return [(d, t) for d, t in rows for w in [words(t)] if not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))]


def test_pipeline_stages_equal_plain_versions(spark, messy, tmp_path):
    texts = [prose(300, 70), prose(300, 70) + " tail", prose(120, 71) + " " + prose(40, 72), "%%% ### " * 30, prose(90, 73), prose(90, 73),
             prose(20, 74) + "\n" + prose(60, 75), prose(60, 75) + "\n" + prose(9, 76), prose(60, 75) + "\n" + prose(12, 77), prose(14, 78)]
    docs = messy.unionByName(table(spark, texts, list(range(51, 61))))
    items = [prose(40, 72), prose(12, 99)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [*ROWS, *zip(range(51, 61), texts, strict=True)]
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        given = [(r.doc_id, r.text) for r in now.collect()]
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        got = sorted(((r.doc_id, r.text or "") for r in now.collect()), key=repr)
        kept[name] = [d for d, _ in got]
        if name == "near_dedup":
            assert sorted((d for d, _ in got), key=repr) == slow_copies(given)
        elif name == "source_mix":
            assert set(got) <= {(d, t or "") for d, t in given} and max(map(got.count, got)) <= 2
        else:
            slow = {"quality_rules": slow_rules, "line_dedup": slow_lines, "decontamination": lambda x: slow_clean(x, items)}[name]
            assert got == sorted(((d, t or "") for d, t in slow(given)), key=repr), name
    assert rows and 56 not in kept["line_dedup"] and 58 not in kept["line_dedup"] and {57, 59} <= set(kept["line_dedup"])
    assert 53 not in kept["decontamination"]


def test_pipeline_stages(spark, messy, empty, tmp_path):
    text = prose(300, 70)
    docs = messy.unionByName(table(spark, [text, text + " tail", prose(120, 71) + " " + prose(40, 72), "%%% ### " * 30, prose(90, 73)], [51, 52, 53, 54, 55]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(40, 72))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        kept[name] = sorted({r.doc_id for r in now.collect() if r.doc_id is not None})
    assert 54 not in kept["quality_rules"] and {51, 52, 53, 55} <= set(kept["line_dedup"])
    assert 51 in kept["near_dedup"] and 52 not in kept["near_dedup"]
    assert 53 not in kept["decontamination"] and {51, 55} <= set(kept["decontamination"])
    assert set(kept["source_mix"]) <= set(kept["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
