"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns for every operator."""

import base64
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.llm import components, decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, ngram_join, queries, secret_scan, token_output, toxicity

LONG = "word " * 200_000
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


# --- 1 licences
def test_license_rules_and_edges(make_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, None), (2, ""), (3, "x. Released under the MIT License. y"), (4, "ALL RIGHTS RESERVED.\nThis work is licensed under the GNU General Public License, version 3."), (5, mit), (6, "the license was lost"), (7, LONG), (3, "x. Released under the MIT License. y")]
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in license_scan.scan_licenses(make_docs(rows, clash=["note"]).withColumn("licenses", F.lit("mine"))).collect()}
    assert got[1] == got[2] == got[6] == got[7] == ([], [])
    assert got[3] == (["mit_line"], ["MIT"]) and got[4] == (["reserved", "gpl3_line"], ["GPL-3.0-only"]) and got[5] == (["mit_grant", "mit_notice"], ["MIT"])
    assert license_scan.scan_licenses(make_docs([])).count() == 0


WRAPPED = {
    "MIT": """Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public\ndomain.",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "BSD-2-Clause": """Copyright (c) 2020, A. Author
All rights reserved.

SPDX-License-Identifier: BSD-2-Clause""",
    "Proprietary": "All rights\nreserved.",
}


def test_wrapped_licenses_are_found(make_docs):
    rows, want = [], {}
    for name, text in WRAPPED.items():
        lines = text.split("\n")
        for form in (text, "\r\n".join(lines), " ".join(x.strip() or "\n\n" for x in lines), *("\n".join(m + x for x in ["", *lines, ""]) for m in ("# ", "// ", " * ", ";; ", "    "))):
            want[len(rows)] = name
            rows.append((len(rows), form))
    cut = len(rows)  # no sentence runs over a blank line or begins within a piece
    rows += [(cut, "All rights\n\nreserved."), (cut + 1, "All rights\n#\nreserved."), (cut + 2, "Not all rights reserved."), (cut + 3, "All rights reserved here.")]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(make_docs(rows)).collect()}
    assert got == {**{i: [n] for i, n in want.items()}, **{cut + k: [] for k in range(4)}}
    ids = {r["doc_id"]: r["sentence_ids"] for r in license_scan.scan_licenses(make_docs(rows)).collect()}
    assert {i for r in ids.values() for i in r} >= {"mit_warranty", "apache2_basis", "apache2_see", "gpl_warranty", "gpl_see", "bsd_names"}


def test_wrapped_licenses_in_sql(make_docs, tmp_path):
    from tests.oracle import same

    rows = []
    for text in WRAPPED.values():
        lines = text.split("\n")
        for form in (text, "\r\n".join(lines), *("\n".join(m + x for x in ["", *lines, ""]) for m in ("# ", " * ")), text + "\n\nAll rights reserved.", f"a. {text} b"):
            rows.append((len(rows), form))
    rows += [(len(rows), "All rights\n\nreserved."), (len(rows) + 1, None), (len(rows) + 2, "License. All rights reserved. All rights reserved.")]
    make_docs(rows).write.parquet(f"{tmp_path}/d")
    pd.read_parquet(f"{tmp_path}/d").to_parquet(f"{tmp_path}/documents.parquet")
    same(make_docs([]).sparkSession, queries.op1_license_scan, license_scan.oracle(), str(tmp_path))


def test_every_sentence_is_reached_however_it_is_wrapped(make_docs):
    rows = [(k, form) for k, s in enumerate(license_scan.SENTENCES) for form in (s, s.upper().replace(" ", "\n# "), s.replace(" ", "; "))]
    got = {(r["doc_id"], r["text"]): r["sentence_ids"] for r in license_scan.scan_licenses(make_docs(rows)).collect()}
    assert list(got.values()) == [[list(license_scan.SENTENCES.values())[k]] for k, _ in got]


def test_sentences_hold_triggers_and_are_normal():
    for s in license_scan.SENTENCES:
        assert any(t in s for t in license_scan.TRIGGERS) and s == " ".join(s.split()).lower()
    assert {i for _, run in license_scan.RULES for i in run} <= set(license_scan.SENTENCES.values())


# --- 2 lines
def test_lines_with_variable_fields_are_dropped(make_docs):
    rows = [(i, f"user {i} logged in from host{i} at noon\nown text number {w} stays here {i}x{w}\n\nsame line everywhere") for i, w in enumerate(WORDS)]
    rows += [(100, None), (101, ""), (None, "same line everywhere"), (102, LONG), (103, "a\na\na\na\na")]
    out = {r["doc_id"]: r for r in line_dedup.drop_recurring(make_docs(rows, clash=["leaf", "line"])).collect()}
    assert out[0]["text"] == "own text number alpha stays here 0xalpha\n" or out[0]["n_dropped"] == 3
    assert out[0]["n_lines"] == 4 and "same line" not in out[0]["text"] and "logged" not in out[0]["text"]
    assert out[100]["text"] is None and out[100]["n_lines"] == 0 and out[101]["text"] == "" and out[None]["n_dropped"] == 1
    assert out[103]["n_dropped"] == 0 and out[102]["text"] == LONG
    assert line_dedup.drop_recurring(make_docs([])).count() == 0


def test_lines_of_one_document_do_not_recur(make_docs):
    menu = "\n".join(f"the recipe of the day is {x}" for x in ("soup", "bread", "cake", "salad"))
    two = ["a list of fine things: red", "a list of fine things: blue"]
    rows = [(1, menu), (1, menu), (2, "other"), (3, "\n".join(two)), (4, "\n".join([two[0], "a list of fine things: green"])), (5, two[1])]
    # in four documents, the null id among them, no line of it in more than one
    rows += [(None if k == 3 else 10 + k, f"we met {w} in the old town") for k, w in enumerate(WORDS[:4])]
    out = {r["doc_id"]: r for r in line_dedup.drop_recurring(make_docs(rows)).collect()}
    assert {i: out[i]["n_dropped"] for i in (1, 2, 3, 4, 5)} == dict.fromkeys((1, 2, 3, 4, 5), 0) and out[1]["text"] == menu
    assert [out[i]["n_dropped"] for i in (10, 11, 12, None)] == [1] * 4


def test_one_document_fixes_no_token(make_docs):
    # "x y same" has its third token fixed by one document only: with distinct documents, 2 of 4 tokens are fixed
    rows = [(1, "\n".join(f"x y same {w}" for w in WORDS[:6]))] + [(2 + k, f"x y {w} {w}") for k, w in enumerate(WORDS[6:10])]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_recurring(make_docs(rows)).collect()}
    assert set(out.values()) == {0}


def test_long_lines_recur_from_two_texts_on(make_docs):
    long = " ".join(f"{w}{w}" for w in WORDS * 6)
    short = " ".join(long.split()[:50])
    assert len(long.split()) > 50
    rows = [(1, f"one\n{long}\nend one"), (2, f"two\n{long}"), (3, f"three\n{short}"), (4, f"four\n{short}"), (5, f"copy\n{long} more"), (6, f"copy\n{long} more")]
    out = {r["doc_id"]: r for r in line_dedup.drop_recurring(make_docs(rows)).collect()}
    assert {i: r["n_dropped"] for i, r in out.items()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0} and out[1]["text"] == "one\nend one"


# --- 3 tokens
def test_token_files_round_trip(spark, make_docs, tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rows = [(5, "Hello, World... it's 3.14!! <|endoftext|> É́cole naïve ΣΑΣ İx é."), (2, None), (3, ""), (9, LONG[:90_000]), (7, "tab\tand\x0bmore"), (7, "twice")]
    manifest = token_output.write_shards(make_docs(rows, clash=["start", "path"]), queries.vocabulary(), 1, out_dir=str(tmp_path), length=64)
    got = token_output.read_back(manifest).orderBy("start").toPandas()
    assert got["doc_id"].tolist() == [2, 3, 5, 7, 7, 9] and got["n_tokens"].tolist()[:2] == [1, 1]
    t = Tokenizer.from_file(queries.vocabulary())
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in sorted(rows, key=lambda r: (r[0], r[1] or ""))]
    assert got["n_tokens"].tolist() == [len(w) for w in want]
    flat = []
    for shard, path in sorted({(r["shard"], r["path"]) for r in manifest.collect()}):
        batches = list(pa.ipc.open_stream(pa.memory_map(path)))
        assert batches[0].schema.field("tokens").type.list_size == 64
        tokens = np.concatenate([b.column("tokens").flatten().to_numpy() for b in batches])
        mask = np.concatenate([b.column("mask").flatten().to_numpy(zero_copy_only=False) for b in batches])
        assert not mask.any() or mask[: mask.sum()].all()
        flat += tokens[mask].tolist()
    assert flat == [i for w in want for i in w]
    reader = token_output.ShardReader(path)
    assert reader.sequence(0)[0].tolist() == np.concatenate(list(reader.ids(0, 64))).tolist()
    assert token_output.read_back(token_output.write_shards(make_docs([]), queries.vocabulary(), 1)).count() == 0


def test_chunk_encoder_is_exact():
    from hypothesis import given, settings, strategies as st

    enc = token_output.ChunkEncoder(queries.vocabulary())
    pieces = st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["it's", "a.", "..", "É.", "<|endoftext|>", "<|ENDOFTEXT|>", "don't,", "x…!", "ß?", "İ", "ª%", "́", "á.", " ", "\n"])), max_size=8)

    @settings(max_examples=300, deadline=None)
    @given(pieces)
    def check(parts):
        text = " ".join(parts).encode("utf-8", "ignore").decode()
        ids = np.frombuffer(enc([text])[0], enc.kind).tolist()
        assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids

    check()


# --- 4 n-gram join
def brute_components(rows, n, percent):
    import string

    sets = {}
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, t in rows:
        w = (t or "").translate(low).encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids, comp = list(sets), {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = root(a), root(b)
                    comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n, percent, small", [(4, 85, False), (5, 80, True)])
def test_join_equals_brute_force(make_docs, monkeypatch, n, percent, small):
    if small:  # large postings are dealt to blocks, and hubs are copied
        monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)
        monkeypatch.setattr(ngram_join, "HUB_ROWS", 2)
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(60)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(i + k, " ".join(shared + [rng.choice(vocab) for _ in range(k)])) for k in range(14)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one  TWO"), (505, "É x"), (506, "é x"), (507, LONG), (508, LONG)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(make_docs(rows, clash=["block", "token"]), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_join_edges(make_docs):
    assert ngram_join.jaccard_components(make_docs([])).count() == 0
    mixed = ngram_join.jaccard_components(make_docs([(1, "a b c d e f g h"), (1, "s t u v w x y z"), (2, "a b c d e f g h"), (3, "s t u v w x y z")])).collect()
    sizes = {(r["doc_id"], r["component_id"]) for r in mixed}  # one of the two texts stands for id 1
    assert sizes in ({(1, 1), (2, 1), (3, 3)}, {(1, 1), (2, 2), (3, 1)})
    got = ngram_join.jaccard_components(make_docs([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 1)]


@pytest.mark.parametrize("blocks", [1, 3])
def test_block_links_keep_components(blocks):
    """Documents in groups that earlier links made; the largest group is split over the blocks, others go to all."""
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(1 << 40, 200, replace=False).astype(np.uint64))
    sets = []
    for _ in range(60):
        drop = rng.choice(200, rng.integers(0, 40), replace=False)
        sets.append(np.unique(np.concatenate([np.delete(base, drop), rng.choice(1 << 40, len(drop) // 2).astype(np.uint64)])))

    def linked(a, b):
        k = len(np.intersect1d(sets[a], sets[b]))
        return 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k)

    def roots(links):
        comp = list(range(60))

        def find(x):
            while comp[x] != x:
                x = comp[x]
            return x

        for a, b in links:
            comp[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(60)]

    want = roots([(a, b) for a in range(60) for b in range(a) if linked(a, b)])
    known = [(a, 1) for a in range(3, 60, 2) if linked(a, 1)]
    group = roots(known)
    main = max(set(group), key=group.count)
    assert 1 < len(set(group)) < 60 and len(set(want)) < len(set(group))
    found = []
    for k in range(blocks):
        here = [i for i in range(60) if group[i] != main or i % blocks == k]
        found += ngram_join.block_links(here, [group[i] for i in here], [i % blocks == k for i in here], [sets[i] for i in here])
    assert all(linked(a, b) for a, b in found)
    assert roots(known + found) == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100 and 7 in got


# --- 5 toxicity
def test_toxicity_catches_unseen_misspellings(make_docs, spark):
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice(WORDS) for _ in range(40))
    rows, labels = [], []
    for i in range(160):
        bad = i % 2
        rows.append((i, prose() + (" " + rng.choice(["dumbfool", "dumbfools", "dumbfooled"]) + " " if bad else " ") + prose()))
        labels.append((i, bad))
    docs = make_docs(rows)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, lab))
    new = make_docs([(1, prose() + " dumbfoolz " + prose()), (2, prose()), (3, None), (4, ""), (5, LONG[:300_000])], clash=["predicted"]).withColumn("score", F.lit(9))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert got[1] > 0.7 > 0.5 > got[2] and got[3] == got[4] == 0.0 and 0 <= got[5] <= 1
    empty = toxicity.fit(toxicity.labelled_sample(docs, lab.where("doc_id < 0")))
    assert {r["score"] for r in toxicity.score(new, empty).collect()} == {0.0}


# --- 6 decontamination
def brute_hits(docs, items, window):
    out = {}
    for i, t in docs:
        w = decontaminate.words(t)
        hit, found = set(), set()
        for j, s in items:
            q = decontaminate.words(s)
            n = min(window, len(q))
            grams = {tuple(q[p : p + n]) for p in range(len(q) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found.add(str(j))
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("chars", [16_000_000, 60])
def test_decontamination_equals_brute_force(make_docs, spark, monkeypatch, chars):
    real = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda b, w: real(b, w, chars))
    rng = random.Random(9)
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, pick(rng.choice([2, 5, 9, 10, 14, 30]))) for k in range(12)] + [(50, None), (51, ""), (52, "?!"), (None, pick(12)), (53, "Ünï b c")]
    rows = [(k, pick(20) + " " + rng.choice(items[:12])[1].upper() + ", " + pick(9) + " " + rng.choice(items[:12])[1]) for k in range(40)]
    rows += [(100, None), (101, ""), (102, pick(3)), (103, "x ünï B c"), (104, LONG)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(decontaminate.find_matches(make_docs(rows, clash=["place", "item_id"]), bench)).collect()}
    assert got == brute_hits(rows, [x for x in items if x[0] is not None], 10)


def test_decontamination_finds_the_longest_match(make_docs, spark):
    item = " ".join(f"t{k}" for k in range(30))
    text = "a b " + " ".join(f"t{k}" for k in range(5, 25)) + " c"
    rows = decontaminate.find_matches(make_docs([(1, text)]), spark.createDataFrame([(7, item)], "item_id long, text string")).where("item_id is not null").collect()
    assert [(r["place"], r["item_place"], r["length"]) for r in rows] == [(2, 5, 20)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(decontaminate.find_matches(make_docs([(1, text)]), none)).first()["n_hit"] == 0
    assert decontaminate.contamination(decontaminate.find_matches(make_docs([]), none)).count() == 0


def test_large_items_are_cut_and_shared_windows_named(make_docs, spark, monkeypatch):
    rng = random.Random(5)
    common = " ".join(f"c{k}" for k in range(12))
    items = [(k, f"{common} " + " ".join(f"x{rng.randrange(300)}" for _ in range(60 + 40 * k))) for k in range(4)]
    texts = [(1, f"a {common} b"), (2, items[3][1]), (3, " ".join(items[2][1].split()[20:45])), (4, f"{common} {common}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(decontaminate.find_matches(make_docs(texts), bench)).collect()}
    assert whole == brute_hits(texts, items, 10) and whole[1][2] == ["0", "1", "2", "3"]
    small = [list(decontaminate.blocks(bench, 10, 150))]
    assert len(small[0]) > 4 and all(len(b.w_item) for b in small[0])
    got: dict = {}
    for b in small[0]:  # every window is in some block, at its place in the item
        _, hits = decontaminate.search_texts([t for _, t in texts], b)
        for d, i, p, q, n in zip(hits["doc"], hits["item"], hits["place"], hits["item_place"], hits["length"]):
            words_ = items[b.ids[i]][1].split()
            assert words_[q : q + n] == texts[d][1].split()[p : p + n]
            got.setdefault(texts[d][0], set()).update(range(p, p + n))
    assert {i: len(x) for i, x in got.items()} == {i: r[1] for i, r in whole.items()}


def test_null_ids_are_decontaminated(make_docs, spark):
    item, named = " ".join(f"t{k}" for k in range(12)), " ".join(f"u{k}" for k in range(10))
    bench = spark.createDataFrame([(None, item), (7, named)], "item_id long, text string")
    docs = make_docs([(1, f"a {item} b"), (None, f"x {named}"), (3, "clean"), (4, f"{item} {named}")])
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.contamination(decontaminate.find_matches(docs, bench)).collect()}
    assert got == {1: (12, []), None: (10, ["7"]), 3: (0, []), 4: (22, ["7"])}


# --- 7 exact dedup
def test_dedup_edges(make_docs):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, None), (5, ""), (6, " \n\t"), (7, LONG), (None, "ab"), (8, "solo"), (8, "solo"), (9, "a b")]
    got = exact_dedup.dedup(make_docs(rows, clash=["digest", "keep_id", "kept"])).collect()
    keep = {}
    for r in got:
        keep.setdefault(r["keep_id"], []).append((r["doc_id"], r["group_size"], r["kept"]))
    assert len(got) == len(rows) and sorted(x[0] or -1 for x in keep[2]) == [-1, 1, 2, 3] and {x[1] for x in keep[2]} == {4}
    assert [x[0] for x in keep[2] if x[2]] == [2] and {x[0] for x in keep[6]} == {4, 5, 6} and sum(x[2] for x in keep[8]) == 1
    assert exact_dedup.dedup(make_docs([])).count() == 0


def _content(n):
    out = np.zeros(n, dtype=exact_dedup.CONTENT)
    out["rows"] = 1
    return out


def test_cuckoo_filter_inserts_deletes_and_grows():
    f = exact_dedup.CuckooFilter(64)
    rng = random.Random(1)
    keys = np.array([rng.getrandbits(64) for _ in range(40)], dtype=np.uint64)
    assert f.insert(keys) and f.find(keys).all()
    f.delete(keys)
    assert f.size == 0 and not f.table.any()
    b = exact_dedup.DigestBucket(16)
    digests = np.array([rng.randbytes(32) for _ in range(30_000)], dtype=exact_dedup.DIGEST)
    for a in range(0, len(digests), 700):  # each batch twice: the second is a hit throughout
        for _ in range(2):
            b.add(digests[a : a + 700], _content(len(digests[a : a + 700])))
    held, content = b.content()
    assert sorted(held) == sorted(digests) and (content["rows"] == 2).all() and b.filter.find(b.keys(digests)).all()
    assert b.filter.size == len(digests) and (b.filter.table > 0).sum() == len(digests)
    other = np.array([rng.randbytes(32) for _ in range(5000)], dtype=exact_dedup.DIGEST)
    assert b.filter.find(b.keys(other)).mean() < 0.01  # new digests are seldom looked for
    first = digests[:50]
    assert not b.remove(first, np.ones(50, np.int64)).any() and b.remove(first, np.ones(50, np.int64)).all() and not b.remove(first, np.ones(50, np.int64)).any()
    assert len(b.content()[0]) == len(digests) - 50 == (b.filter.table > 0).sum() and b.filter.find(b.keys(digests[50:])).all()


def test_cuckoo_filter_survives_equal_keys():
    same = np.array([b"x" * 8 + random.Random(k).randbytes(24) for k in range(40)], dtype=exact_dedup.DIGEST)
    b = exact_dedup.DigestBucket(64)
    for d in same:
        b.add(np.array([d]), _content(1))
    assert sorted(b.content()[0]) == sorted(same) and b.level > 0 and b.filter.n_buckets < 1 << 12


def test_index_follows_insertions_and_deletions(make_docs):
    one = exact_dedup.digests(make_docs([(1, "a"), (2, "a"), (3, "b")]))
    index = exact_dedup.build_index(one)
    gone = exact_dedup.digests(make_docs([(1, "a"), (3, "b"), (9, "never")]))
    more = exact_dedup.digests(make_docs([(4, "c"), (5, "c")]))
    got = sorted(r["group_size"] for r in exact_dedup.update_index(index, more, gone).collect())
    assert got == [1, 2]


# --- 8 secrets
def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_structures_are_confirmed():
    pkcs8 = der(0x30, der(0x02, b"\x00") + der(0x30, der(0x06, bytes.fromhex("2b6570"))) + der(0x04, der(0x04, bytes(range(32)))))
    pkcs1 = der(0x30, der(0x02, b"\x00") + b"".join(der(0x02, bytes([5] * 20)) for _ in range(8)))
    ssh = b"openssh-key-v1\x00" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"x" * 40
    b64 = lambda x: base64.b64encode(x).decode()
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1'})}.c2ln"
    kinds = lambda t: [k for k, *_ in secret_scan.scan(t)]
    assert kinds(f"😀 {b64(pkcs8)} end") == ["der_key"] and secret_scan.scan(f"😀 {b64(pkcs8)} end")[0][1] == 2
    wrapped = "\n".join(b64(pkcs1)[i : i + 64] for i in range(0, len(b64(pkcs1)), 64))
    assert "der_key" in kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{wrapped}\n-----END") and "ssh_key" in kinds(b64(ssh)) and "der_key" in kinds(pkcs8.hex().upper())
    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    assert kinds(f"{url({'alg': 'HS256'})}.{deep}.c2ln") == [] and kinds(f"{deep}.{deep}.c2ln") == []
    public = der(0x30, der(0x30, der(0x06, bytes.fromhex("2a864886f70d010101")) + der(0x05, b"")) + der(0x03, bytes(60)))
    assert kinds(b64(public)) == [] and "der_key" not in kinds(public.hex().upper())
    assert kinds(jwt) == ["jwt"] and kinds(f"{url({'typ': 'x'})}.{url({})}.zz") == [] and kinds("M" + "A" * 80) == [] and kinds(b64(pkcs8[:-3] + b"\x00")) == []


def test_keys_are_found_in_all_their_forms():
    b64 = lambda x: base64.b64encode(x).decode()
    ssh_field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\x00" + ssh_field(b"none") + ssh_field(b"none") + ssh_field(b"") + (1).to_bytes(4, "big") + ssh_field(b"k" * 51) + ssh_field(b"p" * 140)
    keys = {}
    for extra in range(3):  # paddings of 0, 1 and 2
        body = b"".join(der(0x02, bytes([5] * 20)) for _ in range(7)) + der(0x02, bytes([6] * (20 + extra)))
        keys[b64(der(0x30, der(0x02, b"\x00") + body))] = "der_key"
        keys[b64(ssh[:-144] + ssh_field(b"p" * (140 + extra)))] = "ssh_key"
    assert {k.count("=") for k, kind in keys.items() if kind == "der_key"} == {0, 1, 2}
    for key, kind in keys.items():
        lines = [key[i : i + 64] for i in range(0, len(key), 64)]
        forms = [f"PRIVATE_KEY={key}", f"PRIVATE_KEY={key.rstrip('=')}\nNext words follow here", f"{key}\nMore words", "\n".join(lines) + "\nAnd\nso\non", "  key: |\n    " + "\n    ".join(lines) + "\n  other: 1"]
        forms += [f'"-----BEGIN PRIVATE KEY-----\\n{sep.join(lines)}{sep}-----END PRIVATE KEY-----"' for sep in ("\\n", "\\r\\n", "\n", "\r\n")]
        forms += ["\n".join(["M" + "A" * 50, *lines]), "\n".join([*lines, "z"])]
        for form in forms:
            spans = [x for x in secret_scan.scan(form) if x[0] in ("der_key", "ssh_key")]
            assert [x[0] for x in spans] == [kind], form
            start, end = form.index(key[:40]), spans[0][2]
            # the span is the key, whatever follows; padding is part of it
            plain = form[start:end].replace("\\n", "").replace("\\r", "")
            assert spans[0][1] == start and "".join(plain.split()).rstrip("=") == key.rstrip("="), form
        assert [k for k, *_ in secret_scan.scan(f"{key.rstrip('=')}\n{key}\n")].count(kind) == 2
        assert not [k for k, *_ in secret_scan.scan(key[: len(key) // 2]) if k == "der_key"]
    assert "ssh_key" in [k for k, *_ in secret_scan.scan(ssh.hex().upper())]
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).decode().rstrip("=")
    assert [k for k, *_ in secret_scan.scan(f"line\\n{url({'alg': 'HS256'})}.{url({'sub': '1'})}.c2ln")] == ["jwt"]


def test_secret_edges(make_docs):
    rows = [(1, None), (2, ""), (3, 'PassWord = "abcdefghijkl"'), (4, 'password = "short"'), (5, "AKIA" + "A" * 14), (6, "AKIA" + "A" * 13), (7, "f" * 16), (8, "f" * 15), (9, "API_KEY:0123456789abcdef0"), (10, LONG), (11, "toKen=abcdefghijkl")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.find_secrets(make_docs(rows, clash=["kind"]).withColumn("spans", F.lit(1))).collect()}
    assert got == {1: [], 2: [], 3: ["assign"], 4: [], 5: ["access"], 6: [], 7: ["hex"], 8: [], 9: ["assign", "hex"], 10: [], 11: ["assign"]}
    assert secret_scan.find_secrets(make_docs([])).count() == 0


# --- 9 language
def test_language_edges(make_docs):
    rows = [(i, "the cat and the dog with this thing", "en") for i in range(20)] + [(50 + i, "der hund und die katze nicht das ding", "de") for i in range(20)] + [(90, "x", None), (None, "le chat", "fr")]
    model = language_id.fit(make_docs(rows))
    docs = make_docs([(1, "this thing and that"), (2, "nicht die katze"), (3, None), (4, ""), (5, "123 !? 4"), (6, LONG)], clash=["slot"]).withColumn("score", F.lit("mine"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"] and got[3][1] == 0 and 0 < got[1][1] <= 1
    none = language_id.fit(make_docs([]))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


# --- 10 mixing
def test_rates_equal_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    n, p = rng.integers(1, 50, 80).astype(float), rng.dirichlet([0.5, 0.5, 0.5], 80)
    target = [0.6, 0.3, 0.1]
    rows = [(i, int(a), [float(x) for x in q]) for i, (a, q) in enumerate(zip(n, p))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    rated, reached = mixing.fit_rates(members, target)
    got = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
    a, g = n / n.sum(), np.zeros(3)
    for _ in range(20_000):  # the dual by small plain steps
        g += 0.5 * ((a * np.maximum(0, 1 - p @ g)) @ p - target)
    assert np.abs(got - np.maximum(0, 1 - p @ g)).max() < 0.01 and np.abs(np.array(reached) - target).max() < 0.001


def test_rates_solve_the_least_squares(spark):
    """Plain projected gradient on the rates themselves reaches the same totals; the fitted rates are the nearest to 1."""
    rng = np.random.default_rng(9)
    n, p = rng.integers(1, 50, 60).astype(float), rng.dirichlet([0.3, 0.6, 0.4], 60)
    target, a = np.array([0.15, 0.25, 0.6]), n / n.sum()
    members = spark.createDataFrame([(i, int(x), [float(v) for v in q]) for i, (x, q) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
    rated, reached = mixing.fit_rates(members, target.tolist())
    got = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
    w = np.ones(60)
    for _ in range(200_000):
        w = np.maximum(0, w - 20 * (a[:, None] * p) @ ((a * w) @ p - target))
    assert np.abs((a * w) @ p - target).max() < 1e-4 and np.abs(reached - target).max() < 1e-4 and (got >= 0).all()
    assert np.abs((a * got) @ p - reached).max() < 1e-9
    assert (a * (got - 1) ** 2).sum() <= (a * (w - 1) ** 2).sum() + 1e-6
    alone = spark.createDataFrame([(1, 10, [0.9, 0.1]), (2, 10, [0.8, 0.2])], "doc_id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="not met"):  # no rates give so much of the second domain
        _, far = mixing.fit_rates(alone, [0.1, 0.9])
    assert abs(far[0] - 0.1) > 0.01


def test_posteriors_equal_brute_force(make_docs, spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(WORDS[:8] if i % 2 else WORDS[4:]) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(99, None)]
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "doc_id long, domain string")
    docs = make_docs(texts).select("doc_id", "text")
    model = mixing.fit(docs, labels, ["a", "b"])
    seen = [{}, {}]
    for i, t in texts[:30]:
        for x in t.split():
            seen[i % 2][x] = seen[i % 2].get(x, 0) + 1
    vocabulary = {x for x in {*seen[0], *seen[1]} if seen[0].get(x, 0) + seen[1].get(x, 0) >= mixing.MIN_COUNT}
    for r in mixing.posteriors(docs, model).collect():
        words_ = (dict(texts)[r["doc_id"]] or "").split()
        x = []
        for c in seen:
            total, size = sum(c.values()), len(vocabulary) + 1
            inside = sum(c.get(v, 0) for v in vocabulary)
            logs = [np.log(((c.get(v, 0) if v in vocabulary else total - inside) + 0.5) / (total + 0.5 * size)) for v in words_]
            x.append(sum(logs) / np.sqrt(max(1, len(words_))) + np.log(16 / 32))
        want = np.exp(np.array(x) - max(x))
        assert np.allclose(r["p"], want / want.sum(), atol=1e-9) and r["n_tokens"] == len(words_)


def test_mixing_edges(make_docs, spark):
    rows = [(i, "good plain words here " * 3) for i in range(10)] + [(20 + i, "junk %%% noise ### " * 3) for i in range(10)] + [(40, None), (41, ""), (None, "good words"), (42, LONG)]
    labels = spark.createDataFrame([(i, "a") for i in range(5)] + [(20 + i, "b") for i in range(5)] + [(None, "a"), (1, None)], "doc_id long, domain string")
    docs = make_docs(rows, clash=["p", "rate"])
    out = {r["doc_id"]: r for r in mixing.mix(docs.select("doc_id", "text"), labels, {"a": 0.5, "b": 0.5}).collect()}
    assert len(out) == len(rows) and out[40]["n_tokens"] == 0 and out[1]["p"][0] > 0.9 > 0.1 > out[21]["p"][0]
    kept = mixing.apply_copies(docs, mixing.mix(docs.select("doc_id", "text"), labels, {"a": 0.5, "b": 0.5}))
    assert kept.columns == docs.columns
    assert mixing.mix(make_docs([]), labels, {"a": 1.0}).count() == 0
    alone = mixing.mix(docs.select("doc_id", "text"), labels.where("doc_id < 0"), {"a": 1.0, "b": 0.0})
    assert alone.count() == len(rows)
