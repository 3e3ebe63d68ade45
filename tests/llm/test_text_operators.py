"""Language ID, toxicity, token digests and counts, edit matching: against brute force, libraries and odd inputs."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociary.llm import byte_bpe, edit_match, language_id, token_counts, toxicity

ODD = [None, "", " \n\t ", "a", "Ünïcode 漢字 😀", "x" * 300_000, "word " * 60_000, "12345 !?", "same", "same"]


def odd_docs(spark, extra="label string"):
    rows = [(i if i != 3 else None, t, None, "clash") for i, t in enumerate(ODD)] + [(8, "same", "en", "clash")]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {extra}").repartition(3)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def brute_bits(texts, text):
    counts = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for t in texts:
        padded = b"\n\n\n" + t
        for i in range(3, len(padded)):
            for k in range(4):
                counts[k][padded[i - k : i]][padded[i]] += 1
    bits, padded = 0.0, b"\n\n\n" + text
    for i in range(3, len(padded)):
        for k in (3, 2, 1, 0):
            seen = counts[k].get(padded[i - k : i])
            if not seen:
                continue
            total, different = sum(seen.values()), len(seen)
            if padded[i] in seen:
                bits -= math.log2(seen[padded[i]] / (total + different))
                break
            bits -= math.log2(different / (total + different))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_code_lengths_match_brute_force(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    samples = {"a": [b"abracadabra", b"abc", b""], "b": [b"hello world", b"help"], "c": ["äöü".encode()]}
    model = language_id.fit(samples)
    texts = [b"abra hello", b"", b"zzz", "helpé äx".encode(), b"h"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language_id.code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    want = [[brute_bits(samples[name], t) for name in model.languages] for t in texts]
    assert np.allclose(got, want, atol=1e-9)


def test_language_of_held_out_documents(spark):
    words = {"en": "the of and with that from for this".split(), "de": "der die und nicht für über schön zur".split()}
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang if i % 5 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(240))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_more_languages_than_full_shares(spark):
    names = [f"l{k:02d}" for k in range(60)]
    words = {n: [chr(0x4E00 + 40 * k + j) * 2 for j in range(12)] for k, n in enumerate(names)}
    rng = random.Random(6)
    rows = [(60 * i + k, " ".join(rng.choice(words[n]) for _ in range(12)), n) for k, n in enumerate(names) for i in range(20 if k < 50 else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    assert language_id.keep_languages(docs).count() == len(rows)
    small = language_id.training_sample(docs, rows=4, size=100, languages=30)
    assert sorted(small) == names and all(1 <= len(texts) <= 2 for texts in small.values())


def test_language_of_odd_texts(spark):
    docs = odd_docs(spark, "score string")
    got = language_id.identify(docs).collect()
    assert len(got) == len(ODD) + 1
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 7)} == {"und"}
    kept = language_id.keep_languages(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 2, 7})
    none = empty(spark, "doc_id long, text string, lang string")
    assert language_id.identify(none).count() == 0 and language_id.keep_languages(none).count() == 0


def toxic_table(spark, n=900, label=True):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(plain) for _ in range(40)]
        if toxic:
            text[rng.randrange(40)] = rng.choice(["Nasty,", "nasty", "vile"])
        rows.append((i, " ".join(text), None))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 900 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)


def test_long_text_scores_like_its_parts():
    net = toxicity.fit([np.arange(i, i + 9, dtype=np.int32) for i in range(60)], np.arange(60) % 2, np.zeros(60, np.int64), 1, 0.3)
    words = np.random.default_rng(1).integers(0, toxicity.BUCKETS, 5000).astype(np.int32)
    whole = toxicity._block(net, words, np.array([5000]))
    assert np.allclose(whole, toxicity._block(net, words, np.array([5000]), step=700), atol=1e-4)


def test_scores_match_plain_loops():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 3, 9, 40)]
    net = toxicity.fit([rng.integers(0, 50, 12).astype(np.int32) for _ in range(80)], np.arange(80) % 2, np.arange(80) % 3, 3, 0.4)

    def plain(words):
        padded = [*(words if len(words) else [toxicity.PAD]), toxicity.PAD, toxicity.PAD, toxicity.PAD]
        total, at = net.output_bias, 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                places = range(max(1, len(words)))
                response = max(sum(float(net.embedding[padded[p + j]] @ net.filters[k][j][:, f]) for j in range(width)) for p in places) + net.biases[k][f]
                total += max(0.0, response) * net.output[at]
                at += 1
        mean = sum((net.embedding[w] for w in words), np.zeros(toxicity.DIMENSIONS)) / max(1, len(words))
        return total + net.shifts[int(np.argmax(mean @ net.language + net.language_bias))]

    counts = np.array([len(t) for t in texts])
    assert np.allclose(toxicity._block(net, np.concatenate(texts), counts), [plain(t) for t in texts], atol=1e-4)


def test_network_learns_from_random_embeddings():
    rng = np.random.default_rng(6)

    def some(n):
        labels = np.arange(n) % 4 == 0
        texts = [np.minimum(rng.geometric(0.01, 120), 3000).astype(np.int32) for _ in range(n)]
        for t, bad in zip(texts, labels):
            if bad:
                t[rng.integers(0, 120, 2)] = 5000 + rng.integers(0, 6)
        return texts, labels.astype(np.int64)

    texts, labels = some(1500)
    net = toxicity.fit(texts, labels, np.zeros(1500, np.int64), 1, 0.25, word_start=False, epochs=4, rate=0.3)
    unseen, wanted = some(400)
    margins = np.array([toxicity._block(net, t, np.array([len(t)]))[0] for t in unseen])
    assert ((margins >= toxicity.LOGIT_CUT) == wanted).mean() > 0.9


@pytest.mark.parametrize("shard", [4000, 60])
def test_every_labelled_text_teaches_toxicity(spark, monkeypatch, shard):
    """The words, the network and the cuts come from all labelled texts, not from a sample of them."""
    monkeypatch.setattr(toxicity, "MAX_BYTES", 300)
    monkeypatch.setattr(toxicity, "MAX_ROWS", 2)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", shard)
    docs, labels = toxic_table(spark)
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    chosen, rows, prior = toxicity.labelled_texts(docs.unionAll(docs.limit(50)), labels.unionAll(labels.limit(9)))
    assert sorted(r["doc_id"] for r in chosen.collect()) == ids and prior == sum(i % 4 == 0 for i in ids) / len(ids)
    texts = {r["doc_id"]: set(r["text"].split()) for r in docs.collect()}
    counts = toxicity._word_counts(rows)
    for word in ("vile", "w7"):
        bucket = toxicity.word_buckets(pa.array([word]))[0][0]
        assert list(counts[:, bucket]) == [sum(word in texts[i] and (i % 4 == 0) == bad for i in ids) for bad in (False, True)]
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)


def test_copies_of_a_labelled_text_count_once(spark):
    docs = spark.createDataFrame([(i, "vile copy" if i < 40 else f"good text {i}", "en") for i in range(80)] + [(0, "other text", "en"), (0, "other text", "xx")], "doc_id long, text string, lang string")
    chosen, rows, _ = toxicity.labelled_texts(docs, docs.selectExpr("doc_id", "int(doc_id < 40) AS toxic"))
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert 0 in ids and chosen.count() == sum(i >= 40 for i in ids) + 2
    counts = toxicity._word_counts(rows)
    assert [list(counts[:, toxicity.word_buckets(pa.array([w]))[0][0]]) for w in ("vile", "other")] == [[0, 1], [0, 1]]


def test_toxicity_of_odd_texts(spark):
    docs, labels = odd_docs(spark, "predicted string"), spark.createDataFrame([(0, 1), (4, 0), (5, 1), (6, None), (None, 1), (99, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ODD) + 1
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(ODD) + 1
    none = labels.limit(0)
    assert len({r["score"] for r in toxicity.toxicity(docs, none).collect()}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def ranks(spark):
    return byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_pieces_give_the_ids_of_the_whole_text(ranks):
    encoding = byte_bpe.encoder(ranks.value, public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", "!", "'s", "é", "漢", " x", "'"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        cut = list(byte_bpe.pieces(text, rng.randint(1, 9)))
        assert "".join(cut) == text
        assert [i for p in cut for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_long_runs_of_white_space(ranks):
    encoding = byte_bpe.encoder(ranks.value, public_tokenizers.PATTERN)
    rng = random.Random(11)
    for white in (" ", "\n", "\x1c", "\x1f", "\u3000", " \n\x0b"):
        for before, after in (("", ""), ("word", ""), ("", "word 12"), ("it's\x1d", "\x1e it"), ("a ", " b")):
            text = before + white * 70_000 + after
            assert byte_bpe.encode(encoding, text).tolist() == encoding.encode_ordinary(text)
    for _ in range(20):
        text = "".join(rng.choice(["x", "é", "1", ".", "漢"]) * rng.randrange(3) + rng.choice(" \n\t\x1c\xa0") * rng.choice([1, 2, 5000, 30_000]) for _ in range(9))
        assert byte_bpe.encode(encoding, text).tolist() == encoding.encode_ordinary(text)
    for white in (" ", "\n", "\x1c", " \x1f"):
        text = "begin" + white * 3_000_000 + "end"
        assert byte_bpe.decode(encoding, byte_bpe.encode(encoding, text)) == text.encode()


def test_token_digests_round_trip(spark, ranks):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.value.splitlines())}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    docs = odd_docs(spark, "n_tokens string")
    got = collections.Counter(tuple(r) for r in byte_bpe.token_digests(docs, ranks, public_tokenizers.PATTERN).collect())
    want = collections.Counter()
    for row in docs.collect():
        text = row["text"] or ""
        ids = plain.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want[row["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    encoded = byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN)
    back = sorted(bytes(r["bytes"]) for r in byte_bpe.decode_ids(encoded, ranks, public_tokenizers.PATTERN).collect())
    assert back == sorted((r["text"] or "").encode() for r in docs.collect())
    assert byte_bpe.token_digests(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_counts_match_the_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models

    pieces = token_counts.read_pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = [("<unk>", 0.0), *pieces.value.items(), *((f"<0x{i:02X}>", 0.0) for i in range(256))]
    reference = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "漢", "𝄞", "ก", "x", "▁", "ing", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ODD
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, pieces).collect()}
    for i, text in enumerate(texts):
        if text and len(text) < 1000:
            assert got[i] == len(reference.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids), text
        elif not text:
            assert got[i] == 0
    assert token_counts.count_tokens(docs.limit(0), pieces).count() == 0


def brute_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    letter = lambda: rng.choice("abcd ")
    items = [(n, edit_match.normalised("".join(letter() for _ in range(rng.randint(40, 90))))) for n in range(6)]
    docs = []
    for i in range(60):
        text = "".join(letter() for _ in range(60))
        for _ in range(2):
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 9)):
                at, kind = rng.randrange(len(copy)), rng.random()
                copy[at : at + (kind < 0.7)] = [] if 0.4 < kind < 0.7 else [rng.choice("abcd")]
            text += "".join(copy) + " " + "".join(letter() for _ in range(30))
        docs.append((i, text))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for block in (1, 10**6):
        got = {tuple(r)[:3] for r in edit_match.leaks(table, spark.createDataFrame(items, "item_id long, text string"), block_chars=block).collect()}
        want = set()
        for i, text in docs:
            for n, item in items:
                d = brute_distance(item, edit_match.normalised(text))
                if len(item) >= edit_match.MIN_CHARS and d <= int(edit_match.RATE * len(item)):
                    want.add((i, n, d))
        assert got == want


def test_short_items_are_found_as_whole_words(spark):
    items = spark.createDataFrame([(1, "two plus two"), (2, "ja"), (3, "光合作用"), (4, "C++?")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x Two  PLUS\ntwo."), (2, "two plus twos"), (3, "Ninja jazz"), (4, "ninja, ja!"), (5, "关于光合作用的问题"), (6, "why c++? x"), (7, "c++?why")], "doc_id long, text string"
    )
    assert sorted(tuple(r)[:3] for r in edit_match.leaks(docs, items).collect()) == [(1, 1, 0), (4, 2, 0), (5, 3, 0), (6, 4, 0), (7, 4, 0)]
    assert sorted(r["doc_id"] for r in edit_match.keep_clean(docs, items).collect()) == [2, 3]


def test_a_long_first_text_ends_no_sample(spark, monkeypatch):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, ("y" if k % 2 else "z") * 50_000 if k < 40 else f"{'good' if k % 2 else 'bad'} {i}", "en" if k % 3 else "xx", k % 2) for k, i in enumerate(ids)]
    rows.append((10_000 + next(i for i in range(9) if zlib.crc32(str(10_000 + i).encode()) % 3 != 1), "only " * 9000, "long", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    sample = language_id.training_sample(docs, size=20_000)
    assert set(sample) == {"en", "xx", "long"} and len(sample["long"]) == 1
    assert min(len(sample["en"]), len(sample["xx"])) > 50 and max(map(len, sample["en"] + sample["xx"])) < 100
    monkeypatch.setattr(toxicity, "MAX_BYTES", 60_000)
    chosen, _ = toxicity.training_rows(docs, docs.select("doc_id", F.col("label").alias("toxic")))
    counts = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert min(counts[0], counts[1]) > 90 and chosen.agg(F.max(F.length("text"))).first()[0] < 100
    monkeypatch.setattr(toxicity, "MAX_BYTES", 30)
    chosen, _ = toxicity.training_rows(docs, docs.select("doc_id", F.col("label").alias("toxic")))
    assert {r["label"] for r in chosen.collect()} == {0, 1}


def test_every_language_of_the_sample_has_a_cut(spark):
    rng = random.Random(3)
    words = [[chr(0x4E00 + 40 * k + j) * 2 for j in range(12)] for k in range(60)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, " ".join([rng.choice(words[k % 60]) for _ in range(20)] + ["vile"] * (k % 4 == 0)), f"l{k % 60}") for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, int(k % 4 == 0)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    assert len(toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).shifts) == 60


def test_leaks_of_odd_tables(spark):
    item = "a passage that is long enough to be searched for"
    docs = odd_docs(spark, "item_id string").unionAll(spark.createDataFrame([(20, f"x {item.upper()}  y", None, "c"), (20, f"x {item} y", None, "c")], "doc_id long, text string, lang string, item_id string"))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (None, item), (5, item)], "item_id long, text string")
    assert sorted(tuple(r)[:3] for r in edit_match.leaks(docs, items).collect()) == [(20, 1, 0), (20, 1, 0), (20, 5, 0), (20, 5, 0)]
    kept = edit_match.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD) + 1
    assert edit_match.leaks(docs, items.limit(0)).count() == 0 and edit_match.leaks(docs.limit(0), items).count() == 0
