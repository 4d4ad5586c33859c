import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from perilframe.llm import chat_format, language_id, license_scan, packing, queries, secret_scan, toxicity

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_chat_reads_back(spark):
    mean = "</s>[INST] ok \\0 \\1 <|im_end|>\n<|im_start|>user\n <<<|im_sep|>"
    rows = [(1, 0, "user", mean, 9), (1, 1, "assistant", mean, 9), (1, 2, "assistant", "", 9), (1, 3, "user", None, 9), (1, 3, "user", "b", 9),
            (2, None, None, "x\ny", 9), (2, 5, "assi\nstant", "é🙂", 9), (None, 0, "assistant", "z", 9), (3, 1, "assistant", "twice", 9), (3, 1, "assistant", "twice", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    done = chat_format.format_chats(turns)
    got = {r.conv_id: r for r in done.select("*", chat_format.read_back(F.col("formatted")).alias("turns"),
                                             chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    say = {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert say == {1: [("user", mean), ("assistant", mean), ("assistant", ""), ("user", ""), ("user", "b")], 2: [("", "x\ny"), ("assi\nstant", "é🙂")],
                   None: [("assistant", "z")], 3: [("assistant", "twice")] * 2}
    assert got[1].loss == mean and got[3].loss == "twicetwice" and got[2].loss == ""
    assert got[1].formatted.count("<|im_start|>") == 3 and "</s>" not in got[1].formatted
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_licenses(spark, odd, none):
    mit = license_scan.KNOWN[0][2]
    rows = [(1, "Copyright (c) 2020 Some Body\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub-license").replace("\n", "  ")), (3, mit + " more"),
            (4, "text\nReleased under the MIT Licence\nAll rights reserved"), (5, None), (6, "©  2019"), (4, "text\nReleased under the MIT Licence\nAll rights reserved")]
    got = [tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(got) == {(1, "MIT", "", 0), (2, "MIT", "MIT", 1), (3, None, "", 0), (4, None, "MIT,all-rights-reserved", 2), (5, None, "", 0), (6, None, "", 0)}
    assert len(got) == 7 and license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0


def test_full_licences_and_headers(spark):
    header = ("# Copyright 2020 Some Body\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n"
              "# you may not use this file except in compliance with the License.\nmore")
    folder = Path(license_scan.__file__).parent / "licenses"
    texts = {p.stem: p.read_text() for p in folder.glob("*.txt")}
    rows = [*texts.items(), ("header", header), ("part", texts["GPL-3.0"][:20000]), ("Unlicense", license_scan._UNLICENSE.format("https://unlicense.org"))]
    got = {r.doc_id: (r.license_id, r.notices) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(texts) == 7 and all(got[i][0] == i for i in [*texts, "Unlicense"])
    assert got["header"] == (None, "Apache-2.0") and got["part"][0] is None


def plain_base(text):
    out = []
    for k, (kind, p, group, least) in enumerate([("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
                                                 ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "") if len(m[group]) >= least]
    return [s for *_, s in sorted(out)]


def test_secrets(spark, odd, none):
    novel = "the Bearer pG7xQ2mZ9vLr4TnB8sKdW1cY and more"
    docs = spark.createDataFrame([(1, "token: secret: abcdefghij API_KEY='abcd1234'"), (2, novel), (3, "é password=" + "a" * 9 + " " + "0f" * 20), (4, None),
                                  (5, "the team keeps the bearer of get_element_by_identifier_2 here, and the element that the identifier names is got by the bearer in the end")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert got[2].spans == f"novel:{novel.index('pG7')}:{novel.index(' and')}" and got[2].base == "" and got[5].spans == ""
    assert all(got[r.doc_id].base == ",".join(plain_base(r.text)) for r in docs.collect())
    assert secret_scan.scan(odd).count() == odd.count() and secret_scan.scan(none).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r.base_sha256 == hashlib.sha256(",".join(plain_base(texts[r.doc_id])).encode()).hexdigest() for r in queries.op5_secret_scan(spark, SMALL).collect())


def test_random_secrets_of_any_alphabet_and_length():
    rnd, scanner = np.random.default_rng(3), secret_scan.Scanner()
    prose = "the members of the house were asked to read what had been written about the harbour and the weather there, and so on. " * 4
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [digits + "ABCDEF", upper + "234567", upper.lower() + digits, upper + upper.lower() + digits, upper + upper.lower() + digits + "-_"]
    novel = len(secret_scan.BASE)
    for alphabet in alphabets:
        for size in (24, 40, 64, 128, 256, 1024, 4096):
            for around in ("", prose[:60], prose[:400]):
                hit = 0
                for _ in range(10):
                    word = "".join(rnd.choice(list(alphabet), size))
                    word = (alphabet[10] if alphabet[10].isalpha() else "x") + "2" + word[2:]  # a letter and a digit at least
                    hit += any(k == novel for _, k, _ in scanner.spans(f"{around} Authorization: Bearer {word} {around}"))
                assert hit >= 9, (alphabet, size, len(around), hit)
    named = ["the_weather_of_the_harbour_and_the_house_2", "read-what-had-been-written-about-members-and-the-house-3/of/the/harbour-and-weather-there",
             "_".join(["members_of_the_house_2", "written_about_weather", "asked_to_read_the_harbour"] * 5)]
    assert not [w for w in named if any(k == novel for _, k, _ in scanner.spans(f"{prose} bearer {w} {prose}"))]


def test_texts_without_letters_are_und(spark):
    rows = [(1, "\U0001F600\U0001F680 \U0001F389"), (2, "\u3002\u3001\u300c\u300d"), (3, "\uff11\uff12\uff13"), (4, "\u65e5\u672c\u8a9e"), (5, "hello there")]
    docs = spark.createDataFrame([(i, t, "a" if i % 2 else "b") for i, t in rows], "doc_id long, text string, lang string")
    learned = language_id.prototypes(docs.where("doc_id > 3"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, learned, [F.col("doc_id")]).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "b" and got[5][0] == "a"
    assert language_id.prototypes(docs.where("doc_id < 4")) == {}


def test_language(spark, odd, none):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.95 * len(held)
    learned = language_id.prototypes(odd)
    rows = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd, learned, [F.col("doc_id")]).collect()]
    assert (3, "und", 0.0) in rows and (5, "und", 0.0) in rows and len(rows) == odd.count() and all(0 <= s <= 1 for *_, s in rows)
    assert language_id.prototypes(none) == {} and {r.lang_pred for r in language_id.predict(odd, {}, [F.col("doc_id")]).collect()} == {"und"}


def test_bundle_is_sum_of_bound_vectors():
    letters = language_id.letter_vectors()
    grams, counts = language_id.Profiles.grams("ab a")
    got = counts @ language_id.Profiles().vectors(grams)
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in [(0, 97, 98), (97, 98, 0), (98, 0, 97), (0, 97, 0)])
    assert np.array_equal(got, want)


def check_packing(rows, texts, window=2048):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(VOCABULARY)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array([*whole.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding


def test_packing(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_packing(packing.pack(docs, VOCABULARY).collect(), {r.doc_id: r.text for r in docs.collect()})
    rows = packing.pack(odd, VOCABULARY).collect()
    assert sum(r.length for r in rows if r.doc_id == 7) == 16 and [r.length for r in rows if r.doc_id == 3] == [1]
    assert packing.pack(none, VOCABULARY).count() == 0


def test_tokens_of_odd_texts():
    texts = ["", "it''s'll !!'re  x", "a'S Straße ΑΣ İx \x1c <|endoftext|> ok", "日本語 テスト 🙂🙂 a_b", "e\u0301t\u00e9 ½ ﬁ \x85 x\x0by"]
    words = packing.WordTokens(VOCABULARY)
    assert [i.tolist() for i in words.ids(texts)] == [words.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_sum_of_squares_choice():
    packer = packing.Packer(10)
    packer.level[[3, 5, 8]] = [1, 4, 2]
    plain = {h: (0 if h == 0 else 1 - 2 * packer.level[h]) + (0 if h + 2 == 10 else 1 + 2 * packer.level[h + 2]) for h in (0, 3, 5, 8)}
    assert packer.place(2) == min(plain, key=lambda h: (plain[h], -h))


def test_toxicity(spark, odd, none):
    found = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) > 0.95 * len(found)
    assert sum(r.predicted and r.toxic for r in found) > 0.7 * sum(r.toxic for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    empty = toxicity.learn(none.select("doc_id", "text", F.lit(1).alias("label")))
    rows = toxicity.score(odd, empty, [F.col("doc_id")]).collect()
    assert len(rows) == odd.count() and all(r.score < 0.5 for r in rows if r.doc_id != 9)


def test_noisy_or_finds_the_sentence(spark):
    rows = [(i, f"plain words {i}. " + ("you vile troll. " if i % 3 == 0 else "you kind soul. ") + f"other words {i % 7}.", int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    for r in toxicity.score(docs, toxicity.learn(docs), [F.col("text").alias("whole"), F.col("label")]).collect():
        assert (r.score >= 0.5) == bool(r.label)
        assert not r.label or "vile troll" in r.whole[r.worst_start:r.worst_end]
    assert toxicity.noisy_or(np.array([0.0, 0.0])) == pytest.approx(0.75)


def test_toxicity_of_long_texts_does_not_grow_with_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    learned, held, features = [], [], toxicity.Features()
    for r in docs.where("text is not null and toxic in (0, 1)").orderBy("doc_id").collect():
        (held if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else learned).append(([features.of(s) for s in features.sentences(r.text)], r.toxic))
    model = toxicity.fit(learned)

    def rejected(sentences):
        z = np.array([model.bias + model.weights[s].sum() for s in sentences]) - model.slope * np.log(len(sentences))
        return toxicity.noisy_or(z) >= 0.5
    for low, high in ((0, 31), (31, 63), (63, 255)):
        clean, toxic = ([rejected(s) for s, y in held if y == v and low <= len(s) < high] for v in (0, 1))
        assert sum(clean) <= 0.04 * len(clean) and sum(toxic) >= 0.7 * len(toxic), (low, sum(clean), len(clean), sum(toxic), len(toxic))
    clean, toxic = ([s for s, y in held if y == v and rejected(s) == bool(v)] for v in (0, 1))
    rnd = np.random.default_rng(1)
    for size in (363, 1817, 7282):
        bags = [[x for k in rnd.permutation(len(clean)) for x in clean[k]][:size] for _ in range(20)]
        assert sum(map(rejected, bags)) <= 1 and sum(rejected(b + toxic[rnd.integers(len(toxic))]) for b in bags) >= 16, size
