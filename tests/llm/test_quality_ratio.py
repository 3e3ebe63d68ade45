"""Quality rules: measures and scores against plain Python, planted junk, and odd inputs."""

import math
import random
import zlib

import pytest

from lociary.llm import quality_ratio

SPACE = " \t\n\x0b\x0c\r"


def brute(texts, labels, buckets, bound):
    """Rows by place in ``texts`` (doc_id, text)."""
    trusted = {i for i, _ in labels if i is not None and all(q == 1 for j, q in labels if j == i and q is not None) and any(q is not None for j, q in labels if j == i)}
    words = [(t or "").encode().split() for _, t in texts]
    crc = [[zlib.crc32(w) for w in ws] for ws in words]
    grams = [[c % buckets for c in cs] + [(40503 * a + b) % buckets for a, b in zip(cs, cs[1:])] for cs in crc]
    raw, target = [0] * buckets, [0] * buckets
    for (i, _), bs in zip(texts, grams):
        for b in bs:
            raw[b] += 1
            target[b] += i in trusted
    share = sum(target) / max(1, sum(raw))
    weight = [round(math.log((t + 16) / (r * share + 16)) * 1_000_000) for t, r in zip(target, raw)]
    out = []
    for (_, text), ws, bs in zip(texts, words, grams):
        lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
        windows = list(zip(ws, ws[1:], ws[2:]))
        repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        failed = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
        total = sum(weight[b] for b in bs)
        out.append((
            len(ws), sum(len(w.decode()) for w in ws), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated),
            failed, not failed and total >= math.ceil(bound * 1_000_000) * len(bs), total / len(bs) / 1e6 if ws else None,
        ))
    return out


def some_texts(seed):
    rng = random.Random(seed)
    said = ["the", "of", "größe", "漢字", "a|b", "##", "<x>", "word", "$5", "😀"]
    texts = []
    for i in range(60):
        n = rng.choice([0, 3, 49, 50, 51, 120])
        words = [rng.choice(said) + (str(rng.randrange(30)) if rng.random() < 0.7 else "") for _ in range(n)]
        texts.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for w in words)))
    return texts + [(60, "same line\n" * 30 + " \nother\n"), (61, "a a a a a a"), (62, None), (62, ""), (None, "x y z " * 20), (5, texts[5][1])]


@pytest.mark.parametrize("bound", [-0.08, 0.0])
def test_rows_match_plain_python(spark, bound):
    texts = some_texts(3)
    labels = [(i, int(i % 3 > 0)) for i in range(0, 50, 2)] + [(2, 0), (4, None), (None, 1), (7, None)]
    docs = spark.createDataFrame([(k, i, t, "clash") for k, (i, t) in enumerate(texts)], "k int, doc_id long, text string, weights string")
    labels_table = spark.createDataFrame([(i, q, 9) for i, q in labels], "doc_id long, quality int, bucket int")
    want = brute(texts, labels, 64, bound)
    got = quality_ratio.quality_rules(docs.coalesce(1), labels_table, 64, bound)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    key = lambda r: (r[0] is not None, r[0] or 0, *[(v is not None, v or 0) for v in r[1:]])
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    for row, (i, wanted) in zip(rows, sorted(((i, w) for (i, _), w in zip(texts, want)), key=lambda r: key((r[0], *r[1])))):
        assert row[:-1] == (i, *wanted[:-1])
        assert row[-1] == wanted[-1] or math.isclose(row[-1], wanted[-1], abs_tol=1e-6)


def test_junk_goes_and_clean_texts_stay(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in ("ver", "an", "ge", "ton", "mi") for b in ("st", "la", "en", "or", "ka", "ti")]
    rows = []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(80)]
        rows.append((i, " ".join(w + rng.choice(["###", "$$$", "***"]) if i % 6 == 0 else w for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(0, 300, 5)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_ratio.quality_rules(docs, labels).collect()}
    assert all(kept[i] == (i % 6 > 0) for i in range(300))


def test_long_texts_empty_tables_and_no_trusted_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_ratio.quality_rules(none, no_labels).count() == 0
    texts = [(0, " ".join(str(k % 40_000) for k in range(120_000))), (1, "w " * 200_000), (2, " ".join(map(str, range(60))))]
    rows = {r["doc_id"]: r for r in quality_ratio.quality_rules(spark.createDataFrame(texts, "doc_id long, text string"), no_labels).collect()}
    assert [rows[i]["n_repeat_words"] for i in range(3)] == [120_000, 200_000, 0]
    assert all(rows[i]["score"] == 0 for i in range(3)) and rows[2]["kept"]
    plan = quality_ratio.quality_rules(spark.createDataFrame(texts, "doc_id long, text string"), no_labels)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
