"""Language, quality, tokens, licenses, archives: against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import byte_bpe, language_id, license_scan, lm_scoring, quality_rules, token_counts, warc
from driftline.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens string, row string"
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \n\t ", "a", "Ünïcode — 日本語 😀 text", "x" * 70_000, "word " * 20_000, "a\x00b", "nórm   x",
    "<|endoftext|> and 's it's 12345  two  spaces\r\n\r\n", "tab\tand\x0bvt\x0cff",
]


def rows_of(texts, lang="en", source="s"):
    return [(i, t, lang, source, None, "k", "n", "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = rows_of(ODD)
    rows += [rows[4], rows[4], (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- byte-level BPE ---


def reference_codec():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(odd):
    enc = reference_codec()
    got = byte_bpe.round_trip(odd).collect()
    assert len(got) == odd.count()
    want = Counter()
    for r in odd.collect():
        ids = np.array(enc.encode_ordinary(r.text or ""), dtype="<u4")
        want[(r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_byte_bpe_random_and_decode(spark, empty):
    enc, bpe, rng = reference_codec(), byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(5)
    parts = ["a", "aa", " ", "  ", "\n", "é", "日本", "😀", "ing", "th", "1", "'s", "́", "-", "\x00", "Z", "zzz"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        packed = bpe.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(text)
        assert "".join(bpe.decode(packed, block=rng.randint(1, 5))) == text
    assert byte_bpe.round_trip(empty).count() == 0
    texts = spark.createDataFrame([(1, "déjà vu"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in byte_bpe.decode_documents(byte_bpe.encode_documents(texts)).collect()}
    assert back == {1: "déjà vu", 2: ""}


def test_machine_forgets_and_stays_right():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc, machine = reference_codec(), byte_bpe.MergeTransducer(ranks, max_transitions=50)
    for word in ["unbelievable", "tokenisation", "aaaaaaaaaaaa", "mississippi", "thhaheering"] * 3:
        assert machine.encode(word.encode()) == enc.encode_ordinary(word)


def test_utf8_stream_matches_replace():
    rng = random.Random(1)
    for _ in range(500):
        data = bytes(rng.choice(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xff\xed\xa0") for _ in range(rng.randint(0, 12)))
        stream, out, at = byte_bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = rng.randint(1, 3)
            out += stream.feed(data[at : at + step])
            at += step
        assert out + stream.close() == data.decode("utf-8", "replace")


# --- token counts ---


def test_token_counts_equal_the_library(odd, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in odd.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False))
        want[(r.doc_id, len((r.text or "").encode()), n, n > 2048)] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(odd).collect()) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_overlaps_resynchronise():
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    whole = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False))
    rng = random.Random(2)
    parts = ["a", "É", "  ", "\n", "日本", "😀", "Ab", "1", "'s", "́", "<|endoftext|>", "<|start", "İ", "Σ", " ", "\x85", " "]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert counter.count(text) == whole(text)
        assert counter.count_overlapping(text, chunk=rng.randint(1, 20), overlap=rng.randint(1, 6)) == whole(text)
    # No splice point at all: the overlap widens to the end.
    assert counter.count_overlapping("ab" * 5000, chunk=100, overlap=10) == whole("ab" * 5000)


# --- language ---


def test_language_held_out_accuracy(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs, ~fold(F.col("doc_id"), 4, 2)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if not r.train]
    assert held and all(r.train == (zlib.crc32(str(r.doc_id).encode()) % 4 != 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 for r in got)
    # Nothing to learn from; null, blank and letterless texts.
    assert {r.lang_pred for r in language_id.identify(odd, F.lit(False)).collect()} == {"und"}
    some = language_id.identify(odd, F.lit(True)).collect()
    assert len(some) == odd.count()
    by_id = {r.doc_id: r for r in some}
    assert [by_id[i].lang_pred for i in (0, 1, 2, 3)] == ["und", "und", "und", "en"]
    assert language_id.identify(empty, F.lit(True)).count() == 0


def test_narrow_margins_are_rejected():
    model = language_id.CompressionClassifier({"en": (2, ["the cat and the dog"] * 9), "de": (1, ["der hund und die katze"] * 9)})
    assert model.predict("the dog and the cat and the dog")[0::2] == ("en", True)
    assert model.predict("qqqq xxxx zzzz")[2] is False


def test_small_languages_shorten_no_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    small = [(90_000, "zo wurri kanta belo mirra sutto panka", "tiny")]
    small += [(90_001 + k, f"{k} 123 456", "none") for k in range(8)]
    train = ~fold(F.col("doc_id"), 4, 2) | (F.col("doc_id") >= 90_000)
    more = docs.unionByName(spark.createDataFrame(small, docs.schema))
    known = {r.doc_id: r.lang for r in docs.collect()}

    def right(rows):
        held = [r for r in rows if r.doc_id in known and not r.train]
        return sum(r.lang_pred == known[r.doc_id] for r in held) / len(held)

    got = language_id.identify(more, train).collect()
    assert right(got) == right(language_id.identify(docs, train).collect()) > 0.93
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert by_id[90_000] == "tiny" and {by_id[r[0]] for r in small[1:]} == {"und"}
    assert language_id.CompressionClassifier({"x": (1, ["a"]), "y": (9, ["1"])}).predict("a") == ("x", 1.0, True)


# --- quality rules ---


def plain_base(text):
    text = text or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def test_base_figures(odd, empty):
    rng = random.Random(4)
    texts = [r.text for r in odd.collect()] + [
        "".join(rng.choice(["a ", "b ", "c\n", "#", "é ", "\n", "\t"]) for _ in range(rng.randint(0, 80))) for _ in range(400)
    ]
    for t in texts:
        assert quality_rules.base_figures(t) == plain_base(t)
    got = quality_rules.apply_rules(odd, quality_rules.LineCrf()).collect()
    assert len(got) == odd.count()
    for r in got:
        n, rep = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(empty, quality_rules.LineCrf()).count() == 0
    assert quality_rules.keep_rows(empty, quality_rules.LineCrf()).columns == empty.columns


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(0)
    crf = quality_rules.LineCrf(rng.normal(size=(len(quality_rules.FEATURES), 2)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(6, len(quality_rules.FEATURES)))
    paths = [[m >> i & 1 for i in range(6)] for m in range(64)]
    score = lambda p: sum((x[i] @ crf.weights)[p[i]] for i in range(6)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:], strict=False))
    assert crf.decode(x).tolist() == max(paths, key=score)
    y = np.array([[1, 0, 1, 1, 0, 1]])
    mask = np.ones((1, 6), dtype=bool)
    like, gw, gm = crf.likelihood(x[None], mask, y)
    total = np.log(sum(np.exp(score(p)) for p in paths))
    assert like * 6 == pytest.approx(score(y[0].tolist()) - total)
    for index in [(0, 0), (3, 1)]:
        crf.weights[index] += 1e-6
        assert (crf.likelihood(x[None], mask, y)[0] - like) / 1e-6 == pytest.approx(gw[index], abs=1e-4)
        crf.weights[index] -= 1e-6
    crf.moves[0, 1] += 1e-6
    assert (crf.likelihood(x[None], mask, y)[0] - like) / 1e-6 == pytest.approx(gm[0, 1], abs=1e-4)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 <> 0")
    got = quality_rules.apply_rules(docs, quality_rules.train_crf(docs, train)).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert sum(r.kept for r in bad) / len(bad) < 0.1
    # Without labels the base rules decide alone.
    nothing = quality_rules.train_crf(docs, labels.limit(0))
    assert nothing.decode(np.ones((3, len(quality_rules.FEATURES)))).tolist() == [1, 1, 1]


def test_lines_learned_from_are_a_parameter(spark):
    # Junk only beyond the third line: three lines cannot tell the classes apart.
    head = "a plain line of words here.\n" * 3
    rows = [(i, head + ("BUY NOW $$$ ### !!!\n" * 9 if i % 2 else "more words in a plain line.\n" * 9)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(1 - doc_id % 2 AS INT) AS quality")
    bad = rows[1][1]
    whole = quality_rules.content_share(quality_rules.train_crf(docs, labels), bad)[0]
    short = quality_rules.content_share(quality_rules.train_crf(docs, labels, sample_lines=3), bad)[0]
    assert whole < short


# --- language model ---


def test_lm_scores(spark, odd, empty):
    train = ~fold(F.col("doc_id"), 7, 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # A small head, so that most words take the way through the join.
    got = lm_scoring.score(docs, train, head_words=300, own_classes=50, ending_classes=60, dim=8).collect()
    texts = {r.doc_id: lm_scoring.tokens_of(r.text) + [None] for r in docs.select("doc_id", "text").collect()}
    c = Counter(t for i, ts in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in ts)
    n, v = sum(c.values()), len(c)
    base, model = 0.0, 0.0
    for r in got:
        ts = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(c[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in ts))
        if not r.train:
            base, model = base + r.base_score, model + r.score
    assert model > base
    assert lm_scoring.score(empty, train).count() == 0
    alone = lm_scoring.score(odd, F.lit(False)).collect()
    assert len(alone) == odd.count() and all(r.score == 0 == r.base_score for r in alone)
    assert len(lm_scoring.score(odd, F.lit(True)).collect()) == odd.count()


def test_lm_is_normalised():
    rng = np.random.default_rng(3)
    model = lm_scoring.LogBilinear(rng.integers(1, 50, 12).astype(float), 4)
    c1, c2, w = (rng.integers(0, 12, 5000) for _ in range(3))
    model.train(c1, c2, w, batch=512, noise=8, least_steps=5)
    for a, b in [(0, 0), (3, 7), (11, 2)]:
        p = np.exp(model.log_probs(np.full(12, a), np.full(12, b), np.arange(12)))
        assert p.sum() == pytest.approx(1.0, abs=1e-5)


# --- archives ---


def test_archives_round_trip(spark, tmp_path):
    long = "<html>" + "y" * 1200
    rows = [
        (1, "http://a/1", long), (2, "http://a/2", long), (5, None, long), (3, "http://a/3 \r\nX: y", "short"),
        (4, "http://a/4", "short"), (6, "u", None), (7, "u", ""), (None, "n", long), (8, "é", "ü" * 999), (8, "é", "ü" * 999),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    written = warc.write_archives(pages, folder, archive_bytes=2000).collect()
    assert sum(r.records for r in written) == len(rows)
    got = warc.read_archives(spark, folder).collect()
    want = Counter()
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = html == long and page_id != 5
        want[(page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None, b"" if revisit else body)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    first = next((tmp_path / "w").glob("*.warc.zst")).read_bytes()
    assert int.from_bytes(first[:4], "little") == warc.DICTIONARY_MAGIC
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archive_with_trained_dictionary():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    records = [" ".join(rng.choice(words) for _ in range(200)).encode() for _ in range(400)]
    data = warc.write_archive(records)
    assert list(warc.read_archive(data)) == records
    size = int.from_bytes(data[4:8], "little")
    assert size > 1000 and data[8 + size : 12 + size] == warc.FRAME_MAGIC
    assert list(warc.read_archive(warc.write_archive([b"", b"x"]))) == [b"", b"x"]


# --- licenses ---


def test_licenses_against_plain_search(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {
        "MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    }
    want = {(r.doc_id, k) for r in docs.collect() for k, v in lines.items() if v in (r.text or "")}
    got = license_scan.scan_licenses(docs).collect()
    assert want and {(r.doc_id, r.license) for r in got} == want
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(empty).count() == 0


def test_license_wording_decides():
    scan = license_scan.LicenseScanner()
    names = lambda t: [f[2] for f in scan.scan(t)]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("x\nLicensed under CC BY-SA 4.0.\ny\nReleased under the MIT License.") != []
    assert sorted(names("a b\n" * 3 + "Released under the MIT License. " + "Licensed under CC BY 4.0.")) == ["CC-BY-4.0", "MIT"]
    assert names("This work is licensed under the GNU General Public License, version 7.") == []
    assert names("Our license to thrill. The copyright of spring.") == []
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation file"
    assert names(mit) == ["MIT"]
    assert names("word " * 30_000 + "Released under the MIT License." + " word" * 30_000) == ["MIT"]


def test_licenses_wrapped_at_every_word():
    scan = license_scan.LicenseScanner()
    filler = "the tide had turned before the boats came in " * 40
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        for k in range(1, len(words)):
            for line_end in ("\n", "\n * "):
                notice = " ".join(words[:k]) + line_end + " ".join(words[k:])
                assert name in {f[2] for f in scan.scan(f"{filler}\n{notice}\n{filler}")}, (notice, k)
        assert name in {f[2] for f in scan.scan("# " + "\n# ".join(words))}


def test_dense_licenses_are_all_found(spark):
    scan = license_scan.LicenseScanner()
    every = [t for _, t in license_scan.TEMPLATES]
    random.Random(3).shuffle(every)
    for between in ("\n", " "):
        for text in (between.join(every), between.join(every * 3)):
            assert {f[2] for f in scan.scan(text)} == {name for name, _ in license_scan.TEMPLATES}
    text = "Released under the MIT License. Licensed under CC BY 4.0. " * 300
    docs = spark.createDataFrame(rows_of([text, "x " * 9 + text]), SCHEMA)
    got = {(r.doc_id, r.license): (r.n_blocks, r.first_start) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {(0, "MIT"): (300, 0), (0, "CC-BY-4.0"): (300, 32), (1, "MIT"): (300, 18), (1, "CC-BY-4.0"): (300, 50)}
    # A word changed at any place of a long notice, its first and last included.
    words = license_scan.words_of(next(t for n, t in license_scan.TEMPLATES if n == "ISC"))
    for k in range(len(words)):
        changed = [*words[:k], "changed", *words[k + 1 :]]
        if not license_scan.FIXED.search(words[k]):
            assert [f[2] for f in scan.scan("so far. " + " ".join(changed) + " and on")] == ["ISC"], k


GNU = """{0} is free software{1} you can redistribute it and/or modify
 * it under the terms of the GNU {2} as published by
 * the Free Software Foundation{3} either version {4} of the License, or
 * (at your option) any later version.
"""
BSD = """Copyright (c) 2001, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GNU.format("This program", ":", "General Public License", ",", 3), {"GPL-3.0"}),
        (GNU.format("Frob", ";", "General Public License", ";", 2), {"GPL-2.0"}),
        (GNU.format("This library", ";", "Lesser General Public License", ";", "2.1"), {"LGPL-2.1"}),
        (GNU.format("Frob", ":", "Lesser General Public License", ",", 3), {"LGPL-3.0"}),
        (GNU.format("This program", ":", "Affero General Public License", ",", 3), {"AGPL-3.0"}),
        (GNU.format("This program", ":", "Affero General Public License", ",", 4), set()),
        (BSD.format(""), {"BSD", "BSD-2-Clause"}),
        (BSD.format("3. Neither the name of Frob Inc. nor the names of its contributors may be used to\n   endorse or promote products "
                    "derived from this software without specific\n   prior written permission.\n"), {"BSD", "BSD-3-Clause"}),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", {"GPL-2.0"}),
        ("This work is licensed under a Creative\nCommons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", {"GPL-2.0"}),
        ("                                 Apache License\n                           Version 2.0, January 2004\n", {"Apache-2.0"}),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
         "provided that the above\ncopyright notice and this permission notice appear in all copies.", {"ISC"}),
        ("Redistribution of power in the empire was permitted by law.", set()),
    ],
)
def test_published_license_wording(text, want):
    assert {f[2] for f in license_scan.LicenseScanner().scan("x = 1\n" * 50 + text + "\nx = 2" * 50)} == want


def test_compression_proposes_licenses():
    class Counted(license_scan.LicenseScanner):
        asked: list = []

        def savings(self, words, wanted):
            self.asked.append(len(wanted))
            return super().savings(words, wanted)

    text = "Licensed under the MIT License. " + "some words between " * 9 + "Licensed under the Apache License, Version 2.0."
    scan = Counted()
    assert [f[2] for f in scan.scan(text)] == ["MIT", "Apache-2.0"]
    # Every template is compressed, again after each winner; none stands in what is left.
    assert scan.asked[0] == len(scan.templates) and len(scan.asked) >= 3
    # What no template shortens enough is not looked for.
    assert license_scan.LicenseScanner(least=2.0).scan(text) == []


def test_ranking_loses_nothing_that_literal_search_finds():
    rng, scan = random.Random(12), license_scan.LicenseScanner()
    filler = "the ships of spring went far over licensed seas while nobody asked for copyright or permission".split()
    for k, (name, notice) in enumerate(license_scan.TEMPLATES):
        words = [rng.choice(filler) for _ in range(60)]
        other = rng.choice(license_scan.TEMPLATES)
        text = " ".join([*words[:30], notice, *words[30:], other[1]])
        assert {name, other[0]} <= {f[2] for f in scan.scan(text)}, (k, name, other)



def test_codecs_are_released_and_built_anew(spark):
    docs = spark.createDataFrame([(k, f"some text {k} Ünïcode") for k in range(20)], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.ids) for r in byte_bpe.encode_documents(docs, cache=1000).collect()}
    freed = {r.doc_id: bytes(r.ids) for r in byte_bpe.encode_documents(docs.repartition(3), cache=1000, keep=False).collect()}
    assert kept == freed and len(kept) == 20
    byte_bpe.release_codecs()
    assert byte_bpe.codec.cache_info().currsize == 0
