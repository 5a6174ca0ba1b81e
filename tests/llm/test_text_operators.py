"""Operators on single texts: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from tabloom.llm import licences, merkle, packing, rules, sequence_files, token_counts
from tabloom.llm.encoding import Kept, PieceEncoder
from tabloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", " ", "one two\nthree  four", "One, two.\n\nOne, two.\n", LONG, "one two\nthree  four", "é" * 50 + "<|endoftext|> a", "aaaa" * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", None if i == 3 else f"s{i % 2}", None, "r", "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)  # one row twice


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def noise(n, seed):
    rnd = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "'s", "<|endoftext|>", "1", "!", "　", "é", "word", "İ", "\r\n", "<|startoftext|>", "Σ", "​", "😀", "Word,"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(name):
    texts = [*noise(3000, 1), *(t or "" for t in TEXTS)]
    encoder, library = PieceEncoder(tokenizer(name)), Tokenizer.from_file(tokenizer(name))
    want = [np.array(e.ids, encoder.dtype).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.ids_of(texts) == want and encoder.ids_of(texts) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_letter_equals_the_library(name):
    """Alone, inside a word, behind punctuation: letters that normalisation splits or lower-cases to several are no plain words."""
    chars = [c for k in (*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)) if (c := chr(k)).isprintable() or c.isspace() or k < 0x300]
    texts = [x for c in chars for x in (c, f"x{c}y", f"q {c} z. {c}B,")] + ["x सड़क y", "ΟΔΟΣ ΟΔΟΣ.", "İstanbul", " \n\n ", "a   b", "a\n\n", "\n\na  b ", "a\x00b c"]
    encoder, library = PieceEncoder(tokenizer(name)), Tokenizer.from_file(tokenizer(name))
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.ids_of(texts)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    if name == "byte_bpe_50k.json":
        assert token_counts.MergeCounter(tokenizer(name)).counts(texts).tolist() == [*map(len, want)]


def test_a_bounded_store_changes_nothing():
    """A store that is emptied again and again, and pieces longer than it keeps."""
    texts = [*noise(400, 8), *(f"w{i} w{i % 7}, " + "long" * (i % 40) for i in range(400))]
    encoder, library = PieceEncoder(tokenizer("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = [np.array(e.ids, encoder.dtype).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder.words, encoder.others, encoder.tails = Kept(6), Kept(2), Kept(2)
    assert [x for at in range(0, len(texts), 9) for x in encoder.ids_of(texts[at : at + 9])] == want


def test_merge_counts_equal_the_library():
    texts = [*noise(3000, 2), *(t or "" for t in TEXTS)]
    counter, library = token_counts.MergeCounter(tokenizer("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    assert counter.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, none):
    out = token_counts.token_counts(docs, tokenizer("byte_bpe_50k.json"))
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r["n_bytes"] == len((TEXTS[r["doc_id"]] or "").encode()) for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[0] == 0 and any(r["over_limit"] for r in rows)
    assert token_counts.token_counts(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_packing_plan_holds_every_piece():
    rnd = random.Random(3)
    counts = {rnd.randint(1, 64): rnd.randint(1, 50) for _ in range(40)}
    made = packing.plan(counts, 64)
    used: dict = {}
    for fill, times in made:
        assert sum(fill) <= 64
        for x in fill:
            used[x] = used.get(x, 0) + times
    assert used == counts
    bins: list = []  # first fit, longest first
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        at = next((k for k, room in enumerate(bins) if room >= x), None)
        if at is None:
            bins.append(64 - x)
        else:
            bins[at] -= x
    assert sum(t for _, t in made) <= len(bins) * 1.01 + 1


def test_two_replace_the_smallest():
    # greedy takes 60 and 3; the 3 goes for 2 + 2, which fits the gap of 4 whole
    assert packing.plan({60: 1, 3: 1, 2: 2}, 64)[0] == ([60, 2, 2], 1)


def test_packed_documents(docs, none):
    path = tokenizer("byte_bpe_50k.json")
    rows = packing.best_two_fit(docs, path, 0, 256).collect()
    library = Tokenizer.from_file(path)
    seen: dict = {}
    for r in rows:
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        own = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and (r["length"] == 256 or r["piece"] == 0)
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.best_two_fit(none, path, 0, 256).count() == 0


def test_packing_follows_positions(spark):
    rnd = random.Random(9)
    path, n = tokenizer("byte_bpe_50k.json"), 300
    df = spark.createDataFrame([(i, " ".join(rnd.choice(["one", "two", "three"]) for _ in range(rnd.randint(1, 400)))) for i in range(n)] + [(None, "x y")], "doc_id long, text string")
    plain = packing.best_two_fit(df, path, 0, 256).collect()
    old, packing.RANGE = packing.RANGE, 64
    try:
        for sign in (1, -1):
            places = {i: (i * sign) % (n + 1) for i in [*range(n)]} | {None: n if sign == 1 else 0}
            at = spark.createDataFrame([*places.items()], "doc_id long, position long")
            rows = packing.best_two_fit(df, path, 0, 256, positions=at).collect()
            assert sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows))) == sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in plain)))
            firsts = [places[r["doc_id"]] for r in sorted(rows, key=lambda r: r["sequence_id"]) if r["offset"] == 0]
            assert firsts == sorted(firsts) and {r["sequence_id"] for r in rows} == set(range(len(firsts)))
    finally:
        packing.RANGE = old


def test_token_files_round_trip(spark, docs, none, tmp_path):
    path = tokenizer("word_bpe_49k.json")
    unique = docs.dropDuplicates(["doc_id"])
    shards = sequence_files.write_sequences(unique, path, 2, str(tmp_path), length=64, shards=3)
    rows = {r["doc_id"]: r for r in sequence_files.read_documents(spark, str(tmp_path), shards).collect()}
    library, start = Tokenizer.from_file(path), 0
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    reader = sequence_files.ShardReader(str(tmp_path), shards[-1][0])
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata  # a view of the file
    assert sequence_files.token_files(docs, path, 2).count() == len(TEXTS) + 1
    assert sequence_files.token_files(none, path, 2).count() == 0


def brute_likeness(a, b):
    """Runs of two texts held against each other one by one, without trees."""

    def runs(text):
        out = []
        for line in __import__("re").findall(rb"[^\n]*\n|[^\n]+", text.encode()):
            cut = []
            for word in __import__("re").findall(rb"[^ ]* |[^ ]+$", line) or [line]:
                cut.append(word)
                if len(cut) == 8 or len(cut) >= 2 and zlib.crc32(word.removesuffix(b" ")) % 3 == 0:
                    out.append(b"".join(cut))
                    cut = []
            out += [b"".join(cut)] if cut else []
        return [y for x in out for y in ([x] if len(x) <= 128 else [x[k : k + 16] for k in range(0, len(x), 16)])]

    if a == b:
        return 1.0
    x, y = runs(a), runs(b)
    total, common = sum(map(len, x + y)), 0
    for r in x:
        if r in y:
            y.remove(r)
            common += len(r)
    return min(2 * common / total, 1 - 1 / total)


def test_merkle_likeness_comes_from_fingerprints():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["é" * 3, "x" * 300, "。"]
    line = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))
    texts = ["", "a", "a b", "\n", "\n\n", " ", "y" * 1000, *("\n".join(line() for _ in range(rnd.randint(0, 12))) for _ in range(40))]
    texts += [merkle.edited(x, y) for x, y in zip(texts, texts[1:])]  # noqa: B905
    trees = [merkle.Tree(x) for x in texts]
    read = [merkle.Tree.read(t.fingerprint) for t in trees]
    assert [t.fingerprint for t in read] == [t.fingerprint for t in trees] and [t.size for t in read] == [len(x.encode()) for x in texts]
    for _ in range(600):
        i, j = rnd.randrange(len(texts)), rnd.randrange(len(texts))
        assert (trees[i].fingerprint == trees[j].fingerprint) == (texts[i] == texts[j])
        assert merkle.likeness(read[i], read[j]) == pytest.approx(brute_likeness(texts[i], texts[j]), abs=1e-12), (texts[i], texts[j])
        assert merkle.changes(read[i], read[j]) == merkle.changes(trees[i], trees[j])


def test_merkle_equality_and_likeness():
    a, b = merkle.Tree("x y z\nsecond line here\n"), merkle.Tree("x y z\nsecond line here\n")
    assert a.fingerprint == b.fingerprint and merkle.likeness(a, b) == 1.0
    text = "\n".join(f"line {i} has the words {i * 7} and {i * 13}" for i in range(200))
    changed = text.replace("line 77 has", "line 77 had")
    a, b = merkle.Tree(text), merkle.Tree(changed)
    assert merkle.changes(a, b) == [77] and 0.98 < merkle.likeness(a, b) < 1
    assert merkle.likeness(a, merkle.Tree("".join(chr(200 + i % 50) for i in range(500)))) < 0.05
    assert merkle.likeness(merkle.Tree(""), merkle.Tree("")) == 1.0 and merkle.likeness(merkle.Tree(""), merkle.Tree("a")) == 0.0
    assert merkle._lines(b"a\r\n\x0bb\x0c\n\nc") == [b"a\r\n", b"\x0bb\x0c\n", b"\n", b"c"]


def test_merkle_rows(docs, none):
    unique = docs.dropDuplicates(["doc_id"])
    for shards in (1, 3):
        rows = {r["doc_id"]: r for r in merkle.fingerprints(unique, shards).collect()}
        for i, t in enumerate(TEXTS):
            text, following = t or "", TEXTS[i - 1] or ""  # of the lowest id, the highest
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(text)
            assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["near_edited"] <= 1
        assert rows[3]["fingerprint"] == rows[6]["fingerprint"] and rows[0]["fingerprint"] == rows[1]["fingerprint"] != rows[2]["fingerprint"]
    assert merkle.fingerprints(docs, 3).count() == len(TEXTS) + 1 and merkle.fingerprints(none, 3).count() == 0


def brute_rules(text):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", text) if w]
    grams: dict = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if __import__("re").search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark, docs, none):
    texts = [*TEXTS, *noise(60, 4), "a b c d e f a b c d e g a b c d e", "x\nx\n x\nx | y <> #\n", "a b c d e a b c d e a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.quality_rules(df).collect():
        n_words, word_chars, n_symbols, n_dup, n_repeat = brute_rules(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, word_chars, n_symbols, n_dup, n_repeat), texts[r["doc_id"]]
        assert r["base_failed"] == (n_words < 10 or 100 * n_repeat > 20 * n_words) and not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(none).count() == 0


def test_cleaned_lines(spark):
    good = "This is a whole sentence of more than enough words to stay in the text.\nAnd here comes another one, which is of the same kind."
    df = spark.createDataFrame([(1, good + "\nHome | News | Sport | About | Contact"), (2, "\n".join(["HOME!! NEWS!! MORE!! STUFF!! TO!! BUY!!"] * 3)), (3, None)], "doc_id long, text string")
    rows = rules.cleaned(df).collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(1, good)]


def test_licences(spark, docs, none):
    texts = ["x.\nReleased under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy.\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "We licensed this reading.", None, "Released under CC BY-NC 4.0. Licensed under the MIT license."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(df).collect()}
    assert got == {0: "MIT", 1: "GPL-3.0-or-later", 2: "GPL-3.0", 3: "Apache-2.0", 4: "", 5: "", 6: "CC-BY-NC-4.0,MIT"}
    assert licences.licence_scan(docs).count() == len(TEXTS) + 1 and licences.licence_scan(none).count() == 0


def test_licence_notices_of_every_form(spark):
    verbs = ["licensed", "licenced", "released", "distributed", "published", "available", "made available", "provided", "shared"]
    things = ["work", "software", "project", "program", "file", "document", "package", "library", "code", "dataset", "material", "text", "content", "page", "site"]
    texts = [f"{lead}{verb} under{terms}{article} CC BY 4.0." for verb in verbs for terms in ("", " the terms of") for article in ("", " the", " a", " an") for lead in ("", "Also ", "This work is ", "The dataset ")]
    texts += [f"{which} {thing} is {verb} under CC BY 4.0." for which in ("This", "The") for thing in things for verb in ("published", "distributed")]
    texts += ["SPDX-License-Identifier: CC-BY-4.0", "License: CC BY 4.0", "Licence: CC BY 4.0", "Under the CC BY 4.0", "Under the terms of the CC BY 4.0", "License is the CC BY 4.0", "For license see the CC BY 4.0"]
    texts += ["released\nunder CC BY 4.0", "Shared\r\nunder the\tterms of\nCC BY 4.0."]
    rows = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [texts[r["doc_id"]] for r in rows if r["licences"] != "CC-BY-4.0"] == []
    texts = ["This code is made available under the GPL v2.", "This package is distributed under the terms of the GNU GPL v3.", "This dataset is published under CC BY-SA 4.0."]
    rows = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licences"] for r in rows} == {0: "GPL-2.0", 1: "GPL-3.0", 2: "CC-BY-SA-4.0"}
    texts = ["This project is distributed under MIT.", "Distributed under the GPL v3.", "This dataset is available under CC BY 4.0.", "Published under the GNU GPL v2.", "Licensed under GNU LGPL version 3.", "GPL v2 only code.", "Licensed under the GPL v2 only.", "Under the terms of the LGPL v2.1 or later", "SPDX-License-Identifier: AGPL-3.0-only"]
    rows = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["licences"] for r in sorted(rows)] == ["MIT", "GPL-3.0", "CC-BY-4.0", "GPL-2.0", "LGPL-3.0", "", "GPL-2.0-only", "LGPL-2.1-or-later", "AGPL-3.0-only"]


def test_the_filter_drops_nothing(spark):
    """Each known sentence and each word of a notice, with and without the look for WORDS first."""
    import re

    texts = [*licences.SENTENCES.values(), *licences.MORE, *(f"{x} mit" for x in ("license", "shared under", "under the", "for license see the", "spdx license identifier"))]
    assert [x for x in texts if not re.search(licences.WORDS, x)] == []
    df = spark.createDataFrame(list(enumerate(x.replace(" ", "\n", 3).capitalize() for x in texts)), "doc_id long, text string")
    assert sorted(licences.licence_scan(df).collect()) == sorted(licences.licence_scan(df, words="").collect())
    used = {x for _, ids, _ in licences.RULES for x in ids}
    assert {*licences.SENTENCES, *(y for x in licences.MORE.values() for y in x.split(" "))} == used  # every sentence is in a rule


def test_long_licensed_texts(spark):
    grant = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    texts = ["Released under MIT." + "\n" * 100_000 + "x", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + "Licensed under the ISC license.\n" * 100_000, grant + "\n" + "Licensed under MIT. " * 10_000, "license " + " " * 5_000_000 + "\n x" + "word. " * 1_000_000]
    rows = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r["licences"], r["n_sentences"]) for r in sorted(rows)] == [("MIT", 1), ("ISC", 100_001), ("GPL-2.0-or-later,MIT", 10_001), ("", 0)]


def test_whole_bsd_and_gnu_texts(spark):
    head = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    clauses = ["Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."]
    end = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.\n'
    texts, want = [], []
    for n, name in ((2, "BSD-2-Clause"), (3, "BSD-3-Clause")):
        for gap in ("", "\n"):
            for mark in ("{}. ", "* "):
                texts.append(head + gap + "".join(f"{mark.format(i + 1)}{c}\n{gap}" for i, c in enumerate(clauses[:n])) + end)
                want.append(name)
    grant = "This {} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {} as published by the Free Software Foundation; {}\n"
    later = "either\nversion {} of the License, or (at your option) any later version."
    for thing, name, version, licence in (("library", "Lesser General Public License", later.format("2.1"), "LGPL-2.1-or-later"), ("library", "Lesser General Public License", later.format(3), "LGPL-3.0-or-later"), ("program", "Affero General Public License", later.format(3), "AGPL-3.0-or-later"), ("program", "General Public License", "version 2 of the License.", "GPL-2.0"), ("program", "General Public License", "version 3.", "GPL-3.0"), ("program", "General Public License", later.format(2), "GPL-2.0-or-later")):
        texts.append(grant.format(thing, name, version))
        want.append(licence)
    rows = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["licences"] for r in sorted(rows)] == want
    texts = ["  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n", "To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/", "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work."]
    rows = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["licences"] for r in sorted(rows)] == ["GPL-3.0", "Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0"]


def test_shingle_hash_is_spark_s(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b c d", 42)
