"""Jaccard join, vector dedup, components, quote links, host reputation, DOM content and the pipeline."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociary.llm import dom_content, host_reputation, jaccard_join, quote_links, vector_dedup
from lociary.llm.components import connected_components
from lociary.llm.host_reputation import Rule


def joined(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def shingles(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = joined(range(len(rows)), links)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root[i]] = min(doc_id, smallest.get(root[i], doc_id))
    return sorted(((d, len(s), smallest.get(root[i]) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(rng, groups=12, size=14):
    rows, vocabulary = [], [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 70))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            rows.append(" ".join(text + (passage if rng.random() < 0.3 else [])).upper() if rng.random() < 0.5 else " ".join(text))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(jaccard_join, "WIDE", 2)
    rows = near_copies(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=repr)
    assert got == brute_join(rows)


def test_jaccard_join_of_odd_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (7, "é à"), (8, long), (9, long + " end"), (9, long), (10, "one two"), (None, "one two"), (11, "É à"), (12, "x" * 2_000_000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, set_key int").repartition(4)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=repr)
    assert got == brute_join(rows)
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 7, 8, 11, 12, None], key=repr)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0 and jaccard_join.keep_one_of_each(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == joined(nodes, [(a, b) for a, b in links if a != b])
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(rng, n=240, d=12):
    rows = []
    while len(rows) < n:
        base = [rng.gauss(0, 1) for _ in range(d)]
        for _ in range(rng.randint(1, 25)):
            noise = rng.choice([0.0, 0.02, 0.08])
            rows.append([x + rng.gauss(0, noise) for x in base] if noise else list(base))
    return [(i, v) for i, v in enumerate(rows[:n])]


@pytest.mark.parametrize("block", [3, 1024])
def test_vector_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vectors(random.Random(block))
    rows += [(900, None), (901, []), (902, [0.0] * 12), (903, [1.0] * 11 + [None]), (904, [1.0] * 11 + [float("nan")]), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [1e300] * 12), (908, [1e-300] * 12), (908, [1.0] * 12), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, key string").repartition(3)
    got = sorted((tuple(r) for r in vector_dedup.near_duplicates(table, recall=0.999999).collect()), key=repr)
    unit = []
    for _, v in rows:
        fine = bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / max(map(abs, v)) if fine else None)
        if fine:
            unit[-1] = unit[-1] / np.linalg.norm(unit[-1])
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    root, degree = joined(range(len(rows)), links), [0] * len(rows)
    for pair in links:
        for i in pair:
            degree[i] += 1
    name = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            name[root[i]] = min(v, name.get(root[i], v))
    want = sorted(((v, degree[i], name.get(root[i]), v is not None and v == name.get(root[i])) for i, (v, _) in enumerate(rows)), key=repr)
    assert got == want
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


def test_tables_follow_the_number_of_vectors():
    for n in (0, 1, 500, 10**6, 10**12):
        bits, tables = vector_dedup.plan_tables(n)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 <= bits <= 31 and 1 - (1 - meet) ** tables >= 0.999


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there everybody.\n\nHow do you do this today?"), (1, 1, "assistant", "I do it like so, step by step."),
        (1, 2, "user", "Bob wrote:\n> How do   you do THIS today?\nAs said before."), (1, 3, "user", ">> How do you do this today?\n> As said before.\nAgain."),
        (1, 4, "assistant", "> A first sentence that differs. I do it like so, step by step.\nPartly"),
        (2, 0, None, None), (2, None, "user", "x"), (None, 0, "user", "y"), (2, 0, "user", "> nothing known of this\nz"), (2, 0, None, None), (3, 5, "user", "bob wrote: no quote here"),
    ]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, position int").repartition(3)
    out = quote_links.reply_ordered(table)
    got = [tuple(r) for r in out.orderBy("conv_id", "position").collect()]
    assert len(got) == len(rows)
    first = [r for r in got if r[0] == 1]
    assert [(r[1], r[2], r[4], r[5], r[6], r[7], r[8], r[9]) for r in first] == [
        (0, 0, None, 0, 0, 0, 0, "Hello there everybody.\n\nHow do you do this today?"), (1, 1, 0, 0, 0, 0, 0, "I do it like so, step by step."),
        (2, 2, 0, 2, 1, 1, 1, "As said before."), (3, 3, 2, 2, 2, 2, 2, "Again."), (4, 4, 1, 4, 1, 1, 1, "Partly"),
    ]
    assert [r[9] for r in got if r[0] == 2] == ["x", "", "", "z"] and [r[9] for r in got if r[0] == 3] == ["bob wrote: no quote here"]
    assert quote_links.reply_ordered(table.limit(0)).count() == 0


def test_short_quotes_link(spark):
    rows = [
        (1, 0, "Thanks!"), (1, 1, "好的。"), (1, 2, "Yes. I will see to it."), (1, 3, "Well then."), (1, 4, "> Thanks!\na"), (1, 5, "> 好的。\nb"), (1, 6, "> Yes.\nc"),
        (1, 7, "> Changed words here. Yes.\nd"), (1, 8, "> I will see to it. Thanks!\ne"), (1, 9, "> \n> ok\nf"), (2, 0, "> Thanks!\ng"),
    ]
    table = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quotes"], r["n_linked"]) for r in quote_links.reply_ordered(table).collect()}
    assert [got[1, t] for t in range(4, 10)] == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1), (2, 1, 1), (8, 1, 0)] and got[2, 0] == (None, 1, 0)


def test_only_announcements_before_a_quote_go(spark):
    texts = [
        ("Ann wrote:\nno quote\nBob wrote:\n> q\nCarl schrieb:\nx", "Ann wrote:\nno quote\nCarl schrieb:\nx"), ("a\nBob wrote:\n\n> q", "a\n"),
        ("a\n" + "far " * 90 + "away, Bob wrote:\n> q\nb", "a\nb"), ("> q\nBob wrote:", "Bob wrote:"), ("Bob wrote:\n> q\nAnn wrote:\n> r", ""), ("Bob wrote:\r\n> q\r\nc", "c"), ("Ann wrote:\nBob wrote:\n> q", "Ann wrote:"),
    ]
    table = spark.createDataFrame([(1, i, "user", t) for i, (t, _) in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["content"] for r in quote_links.reply_ordered(table).collect()}
    assert [got[i] for i in range(len(texts))] == [own for _, own in texts]


def test_running_totals_over_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    out = quote_links.running(df, ["g"], ["i"], total=("sum", "v", True), top=("max", "v", False)).collect()
    for r in out:
        before = [v for g, i, v in rows if g == r["g"] and i < r["i"]]
        assert r["total"] == sum(before) + r["v"] and r["top"] == (max(before) if before else None)


def test_hosts_paths_and_rules(spark):
    rules = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/")]
    cases = [
        (1, "http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), (2, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), (4, "http://x.com/de/?a", "x.com", "/de/", "com/de/", "block"), (5, "http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        (6, "http://x.org", "x.org", "", None, None), (7, None, "", "", None, None), (8, "no scheme", "", "", None, None), (9, "http://x.net?u=://b/c", "x.net", "", None, None), (10, "http://É.Net#/z", "É.net", "", None, None), (10, "http:///p", "", "/p", None, None),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "h") for c in cases], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(1, 1), (2, None), (99, 0)], "page_id long, good int")
    got = {(r["page_id"], r["path"]): r for r in host_reputation.filter_urls(pages, outcomes, rules).collect()}
    for page, _, host, path, rule, verdict in cases:
        row = got[page, path]
        assert (row["host"], row["rule"]) == (host, rule)
        assert row["verdict"] == verdict if rule else row["verdict"] in ("allow", "block")
    assert host_reputation.filter_urls(pages.limit(0), outcomes, rules).count() == 0
    assert host_reputation.filter_urls(pages, outcomes.limit(0), rules).count() == len(cases)


def test_reputation_shrinks_towards_the_parent(spark):
    pages, outcomes, n = [], [], 0
    for host, good, total in [("bad.s.com", 2, 60), ("few.s.com", 0, 1), ("good.t.com", 58, 60), ("one.t.com", 1, 1), ("new.s.com", 0, 0), ("a.t.com", 30, 30)]:
        for i in range(max(total, 1)):
            pages.append((n, f"http://{host}/{i}"))
            outcomes += [(n, int(i < good))] if i < total else []
            n += 1
    page, outcome = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")
    mean = {r["host"]: r["mean"] for r in host_reputation.host_posteriors(page, outcome).collect()}
    assert 0.0 < mean["few.s.com"] < mean["new.s.com"] < 0.2 and 0.0 < mean["bad.s.com"] < 0.2
    assert 0.8 < mean["one.t.com"] < 1.0 and 0.9 < mean["good.t.com"] < 1.0
    verdict = {r["host"]: r["verdict"] for r in host_reputation.filter_urls(page, outcome, []).collect()}
    assert verdict["bad.s.com"] == "block" and verdict["good.t.com"] == "allow"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    parent, node, pairs = np.array([-1, 0, 0, 1, 1, 3, -1, 6]), rng.normal(size=8), rng.normal(size=(2, 2))
    got, joint = dom_content.marginals(parent, node, pairs)
    total, ones, both = 0.0, np.zeros(8), np.zeros((8, 2, 2))
    for y in itertools.product((0, 1), repeat=8):
        weight = math.exp(sum(node[i] * y[i] for i in range(8)) + sum(pairs[y[p], y[i]] for i, p in enumerate(parent) if p >= 0))
        total += weight
        ones += weight * np.array(y)
        for i, p in enumerate(parent):
            if p >= 0:
                both[i, y[p], y[i]] += weight
    assert np.allclose(got, ones / total) and np.allclose(joint[parent >= 0], both[parent >= 0] / total)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now, it is good.</div>%s<h1>Head &amp; line</h1><p><b>First   paragraph of the text, %d of many.<br><p>Second &lt;one&gt; goes on for a while.</p>
<P class='x>y'>Third one ends here.</article></div><section id="comments"><div class="comment"><p>Nice article, I liked to read it a lot today.</p></div></section>
<form><p>Your mail address, please.</p><input></form><footer><p>All rights reserved by nobody at all.</p></footer></body></html>"""
TEXT = "Head & line\nFirst paragraph of the text, %d of many.\nSecond <one> goes on for a while.\nThird one ends here."


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", PAGE % ("<article>", i)) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "<div>" * 5000 + "deep"), (102, "u", "plain words only")], "page_id long, url string, html string")
    documents = spark.createDataFrame([(i, TEXT % i) for i in range(60)], "doc_id long, text string")
    model = dom_content.train(pages, documents, pages.select("page_id", F.col("page_id").alias("doc_id")))
    got = dom_content.extract(pages.withColumn("text", F.lit("clash")), model).collect()
    by_id = {r["page_id"]: r for r in got}
    assert len(got) == 64 and all(by_id[i]["text"] == TEXT % i for i in range(60))
    assert by_id[100]["text"] == by_id[101]["text"] == "" and by_id[100]["url"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert dom_content.extract(pages.limit(0), model).count() == 0
    untrained = dom_content.train(pages.limit(0), documents, pages.select("page_id", F.col("page_id").alias("doc_id")).limit(0))
    assert dom_content.main_texts([PAGE % ("<article>", 3)], untrained) == [TEXT % 3]


def test_elements_without_an_end_tag_cut_only_themselves():
    model = dom_content.fit([(PAGE % ("<article>", i), TEXT % i) for i in range(60)])
    clean = dom_content.main_texts([PAGE % ("<article>", 3)], model)[0]
    broken = ["<button>Menu", "<span aria-hidden=true>Menu", "<i hidden>Menu", "<select><option>Menu", "<svg><path d='x'>", "<video>Menu", "<template><p>Menu", "<canvas>Menu", "<datalist><option>Menu"]
    for extra in broken:
        for old in ('<a href="/a">', "</ul></nav>"):
            assert dom_content.main_texts([PAGE.replace(old, extra + old) % ("<article>", 3)], model) == [clean], extra
    for extra in broken[:4]:
        assert dom_content.main_texts([PAGE.replace("<nav>", extra + "<nav>") % ("<article>", 3)], model) == [clean], extra


def test_texts_of_unshown_and_of_other_elements():
    def text(html):
        return [t for _, t in dom_content.parse(html).runs]

    assert text("<p>Let <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow></math> be.</p>") == ["Let x=1 be."]
    assert text("<p>One <button><div>no</div></button>two <svg><title>no</title><g><path/></g></svg>three.<p>Four") == ["One two three.", "Four"]
    assert text("<p>One <span hidden><span>no</span>no</span>two<object><p>inner</p></object>") == ["One two", "inner"]
    assert text("<p>One <noscript><img src=x></noscript> two</p><noscript>No script.</noscript><p>Three") == ["One two", "No script.", "Three"]
    assert text("<ul><li><button>no<li>Two</ul><template><p>no</p></template>Three<script>if (a<b) '</p>'") == ["Two", "Three"]


def test_vector_links_of_the_queries_and_pipeline(spark, tmp_path):
    import __spark_entry__ as entry
    import corpus_pipeline

    assert [n for n in entry.queries() if n.startswith("op")] and set(entry.oracle_sql()) <= set(entry.queries())
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    leak = " ".join(rng.choice(words) for _ in range(30))
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(50)]
        if i % 5 == 0:
            text[7] = "vile"
        labels.append((i, 1, int(i % 5 == 0)))
        docs.append((i, " ".join(text), "en", f"s{i % 3}", 1))
    docs += [(1000, docs[1][1] + " x", "en", "s", 1), (1001, docs[2][1] + " " + leak, "en", "s", 1), (1002, None, "en", "s", 1), (1003, "12 34", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i in range(400) if i % 5}
