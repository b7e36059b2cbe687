"""Operators against brute force, with null, empty, long, tied and repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import (ann, decontaminate, html_extract, mixing, near_dedup, quality, suffix_dedup, token_output,
                           toxicity, url_filter)

SCHEMA = "doc_id long, text string, source string, size long, node string, row string, label int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = prose(60)
    passage = prose(40)
    near = base.split()
    near[10] = "changed"
    out = [None, "", " \n\t", "one", "One", "two words", base, base, " ".join(near), base.upper(),
           prose(30) + " " + passage + " " + prose(30), passage + ". " + prose(20), "a" * 1500, prose(20000),
           "x y " * 300, prose(12) + "  <|endoftext|>\n\n" + prose(3), passage]
    return [(i if i != 5 else None, t, f"s{i % 3}" if i % 5 else None, 0, "n", "r", 1) for i, t in enumerate(out)] + [
        (6, base, "s0", 0, "n", "r", 1)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, docs, empty, texts):
    items = [(1, texts[-2][1]), (2, "ONE"), (3, None), (4, ""), (None, texts[10][1]), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    spans = {}
    for i, t in items:
        w = word.findall(lower(t))
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            spans.setdefault(tuple(w[k:k + m]), set()).add(i)
    want = []
    for row in texts:
        w = word.findall(lower(row[1]))
        hit, ids = set(), set()
        for m in {len(s) for s in spans}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in spans:
                    hit.update(range(k, k + m))
                    ids |= spans[tuple(w[k:k + m])]
        want.append((row[0], len(w), len(hit), tuple(sorted(ids - {None})), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated)
           for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def brute_components(rows, percent=80):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r[1]))
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else set(w))
    top = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and 100 * len(a & b) >= percent * len(a | b) and top[i] != top[j]:
                    low, high = sorted((top[i], top[j]))
                    top = [low if t == high else t for t in top]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return out


def test_near_duplicates(docs, empty, texts):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()]
    want = brute_components(texts)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(w[0]) for w in want if w[0] == w[2]})


def test_near_duplicates_of_a_chain(spark):
    """Each text is near the next only; centres rarely are near, so links across components must be found."""
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[i * 6:i * 6 + 100]), None, 0, "", "", 0) for i in range(26)]
    got = {r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {w[2] for w in brute_components(rows)} == {0}


@pytest.mark.parametrize("rare", [2, 32])
def test_near_duplicates_of_an_edited_group(spark, monkeypatch, rare):
    """Copies of one text with few or many edits, from few or many words; about half of the pairs are links."""
    monkeypatch.setattr(near_dedup, "RARE", rare)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(90), rng.randint(0, 14)):
            words[k] = f"e{rng.randrange(40 if i % 2 else 4000)}"
        rows.append((i, " ".join(words), None, 0, "", "", 0))
    rows.sort(key=lambda r: -len(set(r[1].split()) - set(base)))     # the most edited have the smallest ids
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    want = brute_components(rows)
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select(
        "doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(want)
    assert 1 < len({w[2] for w in want}) < 100


def test_mixing_sums_and_ties(spark, docs, empty, texts):
    m = mixing.mix(docs).select("row.source", "mix.*").collect()
    total = sum(r.size for r in m)
    goal = {r.source: (r.source_size, r.target) for r in m}
    assert abs(sum(t for _, t in goal.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for s, t in goal.values()) and all(0 <= r.copies <= 3 for r in m)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns
    same = spark.createDataFrame([(1, "a b", "x", 0, "", "", 0)] * 3000 + [(2, "c " * 2000, "y", 0, "", "", 0)], SCHEMA)
    taken = {r.source: (r.t, r.taken) for r in mixing.mix(same).groupBy("row.source").agg(
        F.max("mix.target").alias("t"), F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken")).collect()}
    assert abs(taken["x"][1] - taken["x"][0]) < 0.1 * taken["x"][0]


def test_token_files(spark, docs, empty, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    token_output.write_tokens(docs, str(tmp_path / "t"), path, parts=3)
    rows = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    known = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in texts}
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        ids = known[r.doc_id]
        assert (list(r.ids), r.start, r.n_tokens) == (ids, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in texts), key=lambda i: (i is None, i))
    one = token_output.read_tokens(spark, str(tmp_path / "t"), wanted=[8]).collect()
    assert [list(r.ids) for r in one] == [known[8]]
    assert token_output.round_trip(empty, path).count() == 0


def test_suffix_dedup(docs, empty, texts):
    from collections import Counter
    data = [(t[1] or "").encode() for t in texts]
    seen = Counter(d[p:p + 400] for d in data for p in range(len(d) - 399))
    want = []
    for row, d in zip(texts, data):
        cover = np.zeros(len(d), bool)
        for p in range(len(d) - 399):
            if seen[d[p:p + 400]] > 1:
                cover[p:p + 400] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~cover])
        edges = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        want.append((row[0], len(d), int(cover.sum()), edges, hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.without_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"),
    ("<nav><a href=x>Menu</a></nav><article><h1>T&amp;t</h1><p>One\n two<br>three<p>Four <b>five</article><footer>f</footer>",
     "T&t\nOne two three\nFour five"),
    ("<body><header>Site</header><aside class=sidebar>s</aside><main><h1>A</h1><p>Long body text of the page, all of it."
     "</p><section class='comments'><p>first!</p></section></main><script>var a='</p>'</script></body>",
     "A\nLong body text of the page, all of it."),
    ("<div id=top><a href=1>One</a> <a href=2>Two</a></div><div id=content><p>A paragraph with enough words in it to be text."
     "</p><p>Another paragraph with enough words in it to be text.</p></div><div class='cookie-notice'>We use cookies</div>",
     "A paragraph with enough words in it to be text.\nAnother paragraph with enough words in it to be text."),
    ("<div class='content with-sidebar'><p>Body text of it.</p></div>", "Body text of it."),
    ("<article class='post no-comments'><p>Body text.</p></article>", "Body text."),
    ("<div id=related-work><p>Body.</p></div>", "Body."),
    ("<main><header><h1>Title</h1></header><p>Body text.</p></main>", "Title\nBody text."),
    ("<section><header><h1>T</h1></header><p>Body text.</p></section>", "T\nBody text."),
    ("<div class=cookie-notice>c</div><div class=comment-list>x</div><div class=site_footer>f</div><div class='box ad-slot-3'>a"
     "</div><ul class=related-posts><li>r</ul><p>Body text here.</p>", "Body text here."),
])
def test_html(page, text):
    assert html_extract.main_text(page) == text


def test_html_through_spark_and_deep_pages(spark):
    import time
    page = "<nav>menu</nav><article><p>Text of the article, long enough.</p></article>"
    rows = [(1, page, "t"), (1, page, "t"), (2, None, "t"), (3, "", None), (4, "<p>" + "word " * 200000 + "</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r["row"].page_id, r["row"].text or "", r.text) for r in html_extract.extract(pages).collect())
    want = "Text of the article, long enough."
    assert got == [(1, "t", want), (1, "t", want), (2, "t", ""), (3, "", ""), (4, "t", ("word " * 200000).strip())]
    assert html_extract.extract(pages.limit(0)).count() == 0
    began = time.perf_counter()
    assert html_extract.main_text("<div><p>x " * 20000).count("x") >= html_extract.SHARE * 20000
    html_extract.main_text("<div><b>" * 20000 + "</i></p></section>" * 20000)
    assert time.perf_counter() - began < 20               # in proportion to the page, not to its square


def brute_reputation(outcomes):
    """The posterior of every host in plain Python."""
    from collections import defaultdict
    total = [sum(b for _, b in outcomes), len(outcomes)]
    whole = total[0] / total[1]

    def strength(groups):                                 # (n, bad, parent's mean)
        groups = [g for g in groups if g[0]]
        scatter = sum(n * (b / n - m) ** 2 for n, b, m in groups)
        noise, size = sum(m * (1 - m) for _, _, m in groups), sum(n * m * (1 - m) for n, _, m in groups)
        between = (scatter - noise) / (size - noise) if size > noise else 0
        return min(1000, max(1, 1 / between - 1)) if between > 0 else 1000

    def level(names, means):                              # name -> parent; parent -> mean
        tally = defaultdict(lambda: [0, 0])
        for h, b in outcomes:
            tally[names(h)][0] += 1
            tally[names(h)][1] += b
        s = strength([(n, b, means(k)) for k, (n, b) in tally.items()])
        return {k: ((s * means(k) + b) / (s + n), n + s + 1) for k, (n, b) in tally.items()}

    suf = lambda h: ".".join(h.split(".")[-2:]) if h.endswith(".co.uk") else h.split(".")[-1]
    dom = lambda h: ".".join(h.split(".")[-1 - len(suf(h).split(".")):])
    suffixes = level(suf, lambda _: whole)
    domains = level(dom, lambda d: suffixes[suf(d)][0])
    hosts = level(lambda h: h, lambda h: domains[dom(h)][0])
    return {h: (m, m - 1.64 * (m * (1 - m) / n) ** 0.5) for h, (m, n) in hosts.items()}


def test_reputation_equals_brute_force(spark):
    rng = random.Random(11)
    hosts = ["a.x.com", "b.x.com", "x.com", "c.y.co.uk", "d.z.co.uk", "z.co.uk", "w.org", "v.w.org"]
    rate = dict(zip(hosts, [0.9, 0.8, 0.85, 0.1, 0.05, 0.2, 0.0, 0.3]))
    outcomes = [(h, int(rng.random() < rate[h])) for h in hosts for _ in range(rng.randint(1, 120))]
    got = {r["host"]: (r["mean"], r["bound"]) for r in url_filter.reputation(
        spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    want = brute_reputation(outcomes)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[h], want[h]) for h in want)


def test_pages_are_labelled_by_their_text(spark):
    rng = random.Random(2)
    words = [a + b for a in ("the", "hou", "wat", "gar", "sto", "nea", "old") for b in ("den", "se", "er", "ne", "r", "ing", "ly")]
    prose = lambda: " ".join(rng.choice(words) for _ in range(60)) + "."
    rows = [(i, "http://good.test/%d" % i, f"<article><p>{prose()}</p><p>{prose()}</p></article>") for i in range(300)]
    rows += [(1000 + i, "http://Junk.test/%d" % i, "<article><p>" + "BUY!! NOW!! " * 40 + "</p></article>") for i in range(40)]
    rows += [(2000, None, None), (2001, "http://new.test/", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["row"].page_id: r.verdict for r in url_filter.judge(pages, url_filter.page_outcomes(pages)).collect()}
    assert len(got) == len(rows)
    assert {got[i] for i in range(300)} == {"allow"} and {got[1000 + i] for i in range(40)} == {"block"}
    assert url_filter.page_outcomes(pages.limit(0)).count() == 0


def test_url_rules_and_reputation(spark):
    urls = ["http://A.net/x?q", "https://b.example.net/en/1", "ftp://example.com/de/", "x://sub.org/fr/#a", "no scheme", None,
            "http://bad.test/1", "http://good.test/2", "http://xnet/"]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id long, url string, host int")
    outcomes = spark.createDataFrame([("bad.test", 1)] * 40 + [("good.test", 0)] * 400, "host string, bad int")
    got = {r["row"].page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, outcomes).collect()}
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("b.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("example.com", "/de/", "example.com/de/", "block"), 3: ("sub.org", "/fr/", "org/fr/", "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("bad.test", "/1", None, "block"),
        7: ("good.test", "/2", None, "allow"), 8: ("xnet", "/", None, "allow")}
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0
    assert url_filter.judge(pages, outcomes.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert url_filter.judge(pages.union(pages), outcomes).groupBy("row.page_id").count().where("count != 2").count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    plain = ["table", "river", "stone", "garden", "paper", "window", "music", "walk", "you", "bread"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grobnik", "grobnak", "grobnos", "sl1mer"])
        rows.append((i, " ".join(words), "s", 0, "n", "r", int(bad)))
    rows += [(None, None, None, 0, "", "", 0), (601, "", "s", 0, "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], r[6]) for r in rows if r[0] is not None and r[0] < 600], "doc_id long, toxic int")
    model = toxicity.train_default(docs, labels)
    scored = toxicity.score(docs, model).select("row.doc_id", "row.label", "score").collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    out = [r for r in scored if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id < 600]
    assert sum((r.score >= 0.3) == bool(r.label) for r in out) >= 0.95 * len(out)
    none = toxicity.train_default(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.accepted(docs.limit(0), labels).columns == docs.columns


def test_quality_keeps_prose_and_drops_noise(spark, texts, empty):
    rng = random.Random(2)
    prose = [" ".join(rng.choice(["the", "house", "was", "old", "and", "near", "water"]) + str() for _ in range(30)) + "."
             for _ in range(200)]
    noise = ["CLICK!! NOW!! " * 20, "buy " * 80, "### $$$ %%% " * 20]
    rows = [(i, t, None, 0, "", "", 0) for i, t in enumerate(prose + noise * 10)] + [(999, None, None, 0, "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["row"].doc_id: r.score for r in quality.score(docs, quality.learn(docs)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] >= 0.5 for i in range(200)) and all(got[i] < 0.5 for i in range(200, 230))
    assert quality.score(empty, quality.learn(empty)).count() == 0


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(900, 12)).astype(np.float32)
    vecs[100:160] = vecs[100]                                         # equal vectors, more than k
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vecs)]
    rows += [(2000, None, ""), (2020, [0.0] * 12, ""), (2040, [float("nan")] + [1.0] * 11, ""), (2060, [None] + [1.0] * 11, ""), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    x, hit = vecs.astype(float), 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit >= 0.9 * 20 * len(got)
    few = ann.nearest(df.where("vec_id < 3")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(df.limit(0)).count() == 0
