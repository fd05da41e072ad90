"""Every operator against brute force or an exact inverse, on awkward rows, and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltlake.llm import op1_media as media
from voltlake.llm import op2_lines as lines
from voltlake.llm import op3_licences as licences
from voltlake.llm import op4_mixing as mixing
from voltlake.llm import op5_toxicity as tox
from voltlake.llm import op6_pii as pii
from voltlake.llm import op7_jaccard as jac
from voltlake.llm import op8_suffix as suf
from voltlake.llm import op9_decontam as dec
from voltlake.llm import op10_tokens as tok
from voltlake.llm.components import connected_components


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# 1


def test_media_round_trip_and_probe():
    for payload in (bytes(64), bytes(range(256)) * 40, b"a" * 64 * 17):
        stored = media.mux(payload)
        found = media.probe(stored)
        track = found["tracks"][0]
        assert media.track_bytes(stored, track) == payload and track["codec"] == "raw " and track["duration"] == len(payload)
        assert b"".join(stored[o : o + n] for o, n in track["keyframes"]) == b"".join(payload[k : k + 64] for k in range(0, len(payload), 64 * 16))
    for damaged in (stored[:100], b"\0\0\0\x04abcd", b"\0\0\0\0", b"abc", stored[:-5]):
        with pytest.raises(media.MediaError):
            media.probe(damaged)


def test_media_handles_large_and_open_boxes():
    inner = media._box(b"free", b"x")
    large = (1).to_bytes(4, "big") + b"free" + (17).to_bytes(8, "big") + b"y"
    assert [p[-1] for p, _, _ in media.walk(inner + large + b"\0\0\0\0mdatrest")] == [b"free", b"free", b"mdat"]
    deep = b""
    for _ in range(20):
        deep = media._box(b"moov", deep)
    with pytest.raises(media.MediaError, match="deep"):
        list(media.walk(deep))


def fragmented(payloads, base_flag=False):
    """A file whose samples all come in fragments: trex gives size 64 and no sync, each run's first sample is sync by its first flags."""
    box, full = media._box, media._full
    moov = media.mux(bytes(64))
    at = moov.index(b"moov") - 4
    head = moov[at : at + int.from_bytes(moov[at : at + 4], "big")]
    n = head.index(b"stbl") - 4
    size = int.from_bytes(head[n : n + 4], "big")
    inner = head[n + 8 : n + size]
    empty = box(b"stbl", inner[: int.from_bytes(inner[:4], "big")])
    grown = head.replace(head[n : n + size], empty)
    for kind in (b"minf", b"mdia", b"trak", b"moov"):
        k = grown.index(kind) - 4
        grown = grown[:k] + (int.from_bytes(grown[k : k + 4], "big") - size + len(empty)).to_bytes(4, "big") + grown[k + 4 :]
    trex = box(b"mvex", full(b"trex", b"".join(x.to_bytes(4, "big") for x in (1, 1, 64, 64, 0x10000))))
    grown = (len(grown) + len(trex)).to_bytes(4, "big") + grown[4:] + trex
    out, ranges = box(b"ftyp", b"iso5", bytes(4)) + grown, []
    for k, p in enumerate(payloads):
        sizes = b"".join((min(64, len(p) - a)).to_bytes(4, "big") for a in range(0, len(p), 64))
        count = -(-len(p) // 64)

        def moof(offset, at=0):
            tfhd = full(b"tfhd", (1).to_bytes(4, "big"), at.to_bytes(8, "big") if base_flag else b"", flags=0x1 if base_flag else 0x20000)
            return box(b"moof", full(b"mfhd", k.to_bytes(4, "big")), box(b"traf", tfhd, full(b"trun", count.to_bytes(4, "big"), offset.to_bytes(4, "big"), (0).to_bytes(4, "big"), sizes, flags=0x205)))

        offset = len(moof(0)) + 8
        ranges.append((len(out) + offset, min(64, len(p))))
        out += moof(offset, len(out)) + box(b"mdat", p)
    return out, ranges


def test_media_fragments():
    parts = [bytes(range(100)), b"z" * 64 * 5, b"q"]
    for base_flag in (False, True):
        stored, ranges = fragmented(parts, base_flag)
        found = media.probe(stored)
        track = found["tracks"][0]
        assert found["fragments"] == 3 and media.track_bytes(stored, track) == b"".join(parts)
        assert track["keyframes"] == ranges and len(track["sizes"]) == 2 + 5 + 1


def test_media_fuzz_never_fails_a_job(spark):
    rng = random.Random(7)
    base = [media.mux(bytes(64 * 40)), fragmented([bytes(300), b"a" * 100])[0]]
    broken = [b"\0\0\0\x08moov", b"\0\0\0\x10moov\0\0\0\x08mvhd", base[0].replace(b"stsz", b"stz2")]
    for _ in range(600):
        x = bytearray(rng.choice(base))
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(len(x))] = rng.choice([0, 1, 255, rng.randrange(256)])
        broken.append(bytes(x[: rng.choice([len(x), rng.randrange(len(x))])]))
    files = spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(broken)], "path string, content binary")
    got = media.scan_media(files).collect()
    assert len(got) == len(broken) and sum(r.error is not None for r in got) > 100
    for b in broken:
        try:
            for t in media.probe(b)["tracks"]:
                assert all(0 <= o and o + n <= len(b) for o, n in t["keyframes"])
        except (media.MediaError, ValueError, KeyError, IndexError, OverflowError, __import__("struct").error):
            pass



def test_media_digest(docs, empty, spark):
    for r in media.media_digest(docs).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0
    by_id = {r.doc_id: r for r in media.media_digest(docs).collect()}
    for d, t in plain(docs):
        if d is None or d == 5:
            continue
        raw = t.encode()
        padded = raw + bytes(64 if not raw else -len(raw) % 64)
        r = by_id[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.mux(padded)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert b"".join(stored[k.offset : k.offset + k.length] for k in r.keyframes) == b"".join(padded[k : k + 64] for k in range(0, len(padded), 64 * 16))
    assert media.media_digest(empty).count() == 0
    files = spark.createDataFrame([("a", bytearray(media.mux(bytes(64)))), ("b", bytearray(b"nope")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in media.scan_media(files).collect()}
    assert got["a"].tracks[0].keyframes[0].length == 64 and got["b"].error and got["c"].tracks == []


# 2


def chunks_of(text, window=3, divisor=4):
    ls = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls]
    out, start = [], 0
    for i in range(1, len(ls) + 1):
        v = 0
        if i >= window:
            for k in range(i - window, i):
                v = (v * lines.BASE + h[k]) % lines.PRIME
        if i == len(ls) or (i >= window and v % divisor == 0):
            out.append(ls[start:i])
            start = i
    return out


def test_line_dedup(docs, empty):
    rows = sorted({(d if d is not None else -(2**63) + 1, t) for d, t in plain(docs)})
    seen, counts, expected = {}, Counter(), {}
    hashed = {(r.d, r.text): r.k for r in docs.select(F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("d"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    for d, t in sorted(rows, key=lambda r: (r[0], hashed[r])):
        kept = []
        for c in chunks_of(t):
            key = "\n".join(c)
            if len(c) >= 2 and key in seen:
                counts[d, t] += len(c)
            else:
                if len(c) >= 2:
                    seen[key] = True
                kept += c
        expected[d, t] = "\n".join(kept)
    got = lines.dedupe_lines(docs.withColumn("original", F.coalesce("text", F.lit("")))).withColumn("n_lines", F.col("n_lines"))
    assert got.columns == [*docs.columns, "original", "n_lines", "n_removed_lines", "n_removed_chunks"] and got.count() == docs.count()
    for r in got.collect():
        k = (r.doc_id if r.doc_id is not None else -(2**63) + 1, r.original)
        assert (r.text or "") == expected[k] and r.n_removed_lines == counts[k], k
    assert sum(counts.values()) > 20
    assert lines.dedupe_lines(empty).count() == 0


def test_line_chunks_resist_shifts():
    rng = random.Random(1)
    body = "\n".join("".join(rng.choice("abcdef") for _ in range(12)) for _ in range(60))
    a, b = chunks_of(body), chunks_of("new first line\n" + body)
    assert len({tuple(c) for c in a} & {tuple(c) for c in b}) >= len(a) - 2


def test_every_repeated_passage_goes(docs, empty, spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(25))
    rows, passages = [], {}
    for size in (2, 3, 4, 5):
        for _ in range(6):
            shared = [line() for _ in range(size)]
            for copy in range(2):
                passages[len(rows)] = (shared, copy)
                rows.append((len(rows), "\n".join([*(line() for _ in range(2)), *shared[:1], *[""][: size % 2], *shared[1:], *(line() for _ in range(2))])))
    got = {r.doc_id: r for r in lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()}
    for d, text in rows:
        shared, copy = passages[d]
        kept = text.split("\n") if not copy else text.split("\n")[:2] + text.split("\n")[-2:]
        assert got[d].text.split("\n") == kept and got[d].n_removed_lines == len(text.split("\n")) - len(kept)

    first = {}  # awkward rows against brute force
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("d"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("k", F.xxhash64("text"))
    expected = {}
    for r in sorted(keyed.collect(), key=lambda r: (r.d, r.k)):
        ls = r.text.split("\n")
        solid = [i for i, x in enumerate(ls) if x.strip(" ")]
        gone = {i for a, b in zip(solid, solid[1:]) if first.setdefault("\n".join(ls[a : b + 1]), (r.d, r.k, a)) != (r.d, r.k, a) for i in range(a, b + 1)}
        expected[r.d, r.text] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    cleaned = lines.dedupe_lines(docs.withColumn("original", F.coalesce("text", F.lit(""))), passages=True).collect()
    assert len(cleaned) == docs.count() and lines.dedupe_lines(empty, passages=True).count() == 0
    for r in cleaned:
        assert (r.text or "") == expected[r.doc_id if r.doc_id is not None else -(2**63) + 1, r.original]


# 3


def test_licences(spark):
    rows = [("p/LICENSE", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."), ("p/a/x.py", "code only"), ("p/a/b/y.py", "# Released under the MIT License.\ncode"), ("p/a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("p/a/b/c/z.py", "more"), ("q/w.py", "nothing"), ("p/a/x2.py", None), (None, None), ("p/a/x.py", "code only")]
    files = spark.createDataFrame([(*r, 1, "k") for r in rows], "path string, text string, dir_name int, cosine string")
    got = {r.path: (r.licence, r.origin, r.licence_path) for r in licences.scan_licences(files).collect()}
    assert got["p/LICENSE"][:2] == ("Apache-2.0", "own") and got["p/a/x.py"] == ("Apache-2.0", "inherited", "p/LICENSE")
    assert got["p/a/b/y.py"][:2] == ("MIT", "own") and got["p/a/b/c/z.py"] == ("GPL-3.0", "inherited", "p/a/b/LICENSE")
    assert got["q/w.py"] == (None, None, None) and got["p/a/x2.py"][0] == "Apache-2.0" and got[None][0] is None
    assert licences.scan_licences(files).count() == len(rows) and licences.scan_licences(files.where("false")).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2021 Some One

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD_TEXT = """Copyright (c) 2020, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
ISC_TEXT = """Copyright 2019 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
APACHE_HEADER = """#!/bin/sh
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
"""
GPL_HEADER = """/* This program is free software: you can redistribute it
 * and/or modify it under the terms of the GNU
 * General Public License as published by the Free Software
 * Foundation, either version 3 of the License, or
 * (at your option) any later version. */
int main;
"""


def test_whole_licence_texts_and_header_blocks(spark):
    code = "def f(x):\n    return x + 1\n" * 40
    filler = "These words of a preamble speak of freedoms and of rights that others have in general terms. " * 300
    gpl = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\n" + filler
    rows = [("m/LICENSE", MIT_TEXT, "MIT"), ("b/COPYING", BSD_TEXT, "BSD-3-Clause"), ("i/LICENSE.md", ISC_TEXT, "ISC"), ("g/COPYING", gpl, "GPL-3.0"), ("x/run.sh", APACHE_HEADER + code, "Apache-2.0"), ("x/main.c", GPL_HEADER + code, "GPL-3.0"), ("n/a.py", code, None), ("n/LICENSE", code, None)]
    rows += [(f"{d}/sub/deep/a{k}.py", code, name) for d, name in (("m", "MIT"), ("b", "BSD-3-Clause"), ("g", "GPL-3.0")) for k in range(3)]
    got = {r.path: r.licence for r in licences.scan_licences(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert got == {p: name for p, _, name in rows}


GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."


def test_sibling_licences_and_versions(spark):
    bsd2 = BSD_TEXT[: BSD_TEXT.index("* Neither")] + BSD_TEXT[BSD_TEXT.index("\nTHIS") :]
    cases = {
        GNU.format("program", ":", "Affero General Public License", ",", 3): "AGPL-3.0",
        GNU.format("program", ";", "General Public License", ";", 2): "GPL-2.0",
        GNU.format("program", ":", "General Public License", ",", 3): "GPL-3.0",
        GNU.format("library", ";", "Lesser General Public License", ";", "2.1"): "LGPL-2.1",
        GNU.format("library", ":", "Lesser General Public License", ",", 3): "LGPL-3.0",
        bsd2: "BSD-2-Clause",
        BSD_TEXT: "BSD-3-Clause",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "This file is not licensed under the MIT License.": None,
        "Released under the MIT License.": "MIT",
    }
    tags = ("GPL-2.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "LGPL-2.1-or-later", "AGPL-3.0-only", "MIT", "CC-BY-SA-4.0")
    cases |= {f"// SPDX-License-Identifier: {tag}\nint x;": re.sub("-only|-or-later", "", tag) for tag in tags} | {"# SPDX-License-Identifier: Zlib": None}
    rows = [(f"d{k}/x.c", t) for k, t in enumerate(cases)]
    got = {r.text: r.licence for r in licences.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {t: got[t] for t in cases} == cases


def test_licence_files_of_any_name_are_compared_whole(spark):
    """The caller's licence file is found by its passages without a trigger word, whatever its name."""
    words = "to use, copy, modify, merge, publish, distribute, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
    files = spark.createDataFrame([("d/17.txt", "word " * 200 + words + " word" * 200), ("d/18.txt", "code")], "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in licences.scan_licences(files, is_licence_file=files["path"] == "d/17.txt").collect()}
    assert got == {"d/17.txt": ("MIT", "own"), "d/18.txt": ("MIT", "inherited")}
    assert {r.licence for r in licences.scan_licences(files).collect()} == {None}


def test_template_terms_agree(spark):
    rows = [(name, t) for name, texts in licences.TEMPLATES.items() for t in texts]
    spark_terms = spark.createDataFrame(rows, "n string, t string").select("t", licences.terms(F.col("t")).alias("w")).collect()
    assert all(licences.split_terms(r.t) == r.w for r in spark_terms)


def test_inheritance_matches_brute_force(spark):
    rng = random.Random(9)
    notices = {"MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    folders = ["/".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(60)]
    special = {d: rng.choice(list(notices)) for d in folders if rng.random() < 0.3}
    rows = [(f"{d}/LICENSE".lstrip("/"), notices[n]) for d, n in special.items()] + [(f"{d}/f{k}.py".lstrip("/"), "code" if k else None) for d in set(folders) for k in range(2)]
    got = {r.path: (r.licence, r.licence_path) for r in licences.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    for path, _ in rows:
        if path.endswith("LICENSE"):
            continue
        d, want = path.rpartition("/")[0], (None, None)
        while True:
            if d in special:
                want = (special[d], f"{d}/LICENSE".lstrip("/"))
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        assert got[path] == want, path


def test_licence_cosines_match_brute_force(spark):
    rows = [(f"f{i}", t) for i, t in enumerate(["Released under the MIT License.", "We use a licence of our own making here", "Licensed under CC BY-NC 4.0.\nCopyright holders may redistribute in source form"])]
    got = {r.path: (r.licence, r.cosine) for r in licences.scan_licences(spark.createDataFrame(rows, "path string, text string"), threshold=0.0).collect()}
    split = lambda t: [w for w in re.split(r"[^\w.+-]+|[.,;:]+(?=\s|$)", t.lower()) if w]
    windows = lambda ws: [ws[k : k + licences.WINDOW] for k in range(0, max(1, len(ws)), licences.STEP)]
    passages = [(p, split(x)) for p, t in rows for x in t.split("\n") if re.search(licences.TRIGGER, x)]
    passages += [(p, w) for p, t in rows if re.search(licences.TRIGGER, t) for w in windows(split(t)) if any(re.search(licences.TRIGGER, x) for x in w) or "public domain" in " ".join(w)]
    templates = [(n, split(x)) for n, ts in licences.TEMPLATES.items() for x in ts]
    df = Counter(w for _, ws in passages + templates for w in set(ws))
    n = len(passages) + len(templates)
    vec = lambda ws: {w: (1 + np.log(c)) * (np.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(ws).items()}
    cos = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items()) / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    for path, _ in rows:
        text = dict(rows)[path]
        may = lambda name, ws: licences.stated(name, " ".join(ws), bool(re.search(licences.THREE_CLAUSES, text)), "")  # noqa: E731, B023
        best = max(((round(cos(vec(ws), vec(ts)), 9), name) for p, ws in passages if p == path for name, ts in templates if may(name, ws)), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        assert got[path][1] == pytest.approx(best[0], abs=1e-8) and got[path][0] == best[1]


# 4


def mixed_docs(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        kind = i % 3
        vocabulary = (["the", "and", "house", "river", "tree"], ["###", "$$$", "&&&", "%%%"], ["scum", "idiot", "trash"])[kind]
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))))
        if i % 2 == 0:
            labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing_meets_targets(spark):
    d, labels = mixed_docs(spark)
    got = mixing.mix(d, labels, {"good": 0.7, "junk": 0.25, "toxic": 0.05}).toPandas()
    mass = [(got["rate"] * got["n_tokens"] * got[f"p_{k}"]).sum() for k in mixing.DOMAINS]
    assert np.allclose(np.array(mass) / got["n_tokens"].sum(), [0.7, 0.25, 0.05], atol=0.002) and (got["rate"] >= 0).all()
    held = got[got["doc_id"] % 2 == 1]
    assert (held[[f"p_{k}" for k in mixing.DOMAINS]].to_numpy().argmax(1) == held["doc_id"] % 3).mean() > 0.95


def scored_rows(spark, p, tokens):
    return spark.createDataFrame([(int(t), *map(float, row)) for row, t in zip(p, tokens, strict=True)], "n_tokens long, p_good double, p_junk double, p_toxic double")


@pytest.mark.parametrize(("most", "want"), [(float("inf"), (0.5, 0.3, 0.2)), (float("inf"), (0.98, 0.01, 0.01)), (1.5, (0.5, 0.3, 0.2))])
def test_projected_steps_match_a_direct_solver(spark, most, want):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 30)
    tokens = rng.integers(1, 50, 30)
    rows = scored_rows(spark, p, tokens)
    f = mixing.fit_rates(rows, dict(zip(mixing.DOMAINS, want, strict=True)), most=most, slack=1.0)
    r = np.array([x[0] for x in rows.select(mixing.rate_of(f["u"], most)).collect()])
    n = tokens.sum()
    m = np.linalg.inv((p * tokens[:, None]).T @ p / n)
    gap = lambda r: ((r * tokens) @ p - f["wanted"]) / n
    loss = lambda r: gap(r) @ m @ gap(r) + 1e-3 * (tokens / n * (r - 1) ** 2).sum()
    best = np.ones(30)
    for _ in range(20000):
        best = np.clip(best - 0.5 * (p @ (m @ gap(best)) + 1e-3 * (best - 1)), 0, most)
    assert loss(r) <= loss(best) + 1e-6 and np.abs(r - best).max() < 0.02 and f["steps"] < 25


def test_mixing_meets_targets_of_rare_domains(spark):
    p = np.array([(1, 0, 0), (0.9, 0.1, 0), (0, 1, 0), (0.1, 0.9, 0), (0, 0, 1)])
    rows = scored_rows(spark, p, [500_000, 200_000, 200_000, 100_000, 100])
    f = mixing.fit_rates(rows, {"good": 0.9, "junk": 0.09, "toxic": 0.01})
    assert np.allclose(f["reached"] / f["reached"].sum(), [0.9, 0.09, 0.01], atol=1e-3) and f["unmet"] == []
    for options, some in (({"most": 8.0}, rows), ({}, rows.where("p_toxic = 0"))):
        with pytest.warns(UserWarning, match="toxic 0.0[0-9]* of 0.01"):
            assert "toxic" in mixing.fit_rates(some, {"good": 0.9, "junk": 0.09, "toxic": 0.01}, **options)["unmet"]


def test_mixing_edges(docs, empty, spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 1), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, {"good": 1.0}, tuple(c for c in docs.columns if c != "text"))
    assert got.count() == docs.count() and got.where("rate < 0 OR rate IS NULL").count() == 0
    assert mixing.mix(empty, labels, {"good": 1.0}).count() == 0
    assert mixing.mix(docs, labels.where("false"), {"good": 1.0}).count() == docs.count()


# 5


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    y = rng.random(20000) < 0.2
    flip = lambda a: np.where(rng.random(20000) < a, y, ~y) * 2 - 1
    votes = np.stack([flip(0.9), flip(0.8), flip(0.7), flip(0.85)], 1)
    votes = np.column_stack([votes, np.where(rng.random(20000) < 0.95, votes[:, 2], -votes[:, 2])])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = tox.fit_label_model(patterns, counts)
    assert m["accuracy"][0] > m["accuracy"][1] > 0.6
    c = m["correlation"]
    assert c[2, 4] == c.max()
    guess = np.array([m["posterior"][tuple(int(x) for x in v)] for v in votes]) >= 0.5
    assert (guess == y).mean() > 0.9


def test_label_model_posteriors_match_bayes():
    rng = np.random.default_rng(6)
    prior, n = 0.15, 40_000
    hit, false = np.array([0.6, 0.5, 0.4, 0.55, 0.35]), np.array([0.02, 0.03, 0.01, 0.02, 0.05])
    y = rng.random(n) < prior
    votes = (rng.random((n, 5)) < np.where(y[:, None], hit, false)).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = tox.fit_label_model(patterns, counts)["posterior"]
    off = 0.0
    for p, c in zip(patterns, counts, strict=True):
        like = [q * np.prod(np.where(p == 1, r, 1 - r)) for q, r in ((prior, hit), (1 - prior, false))]
        off += c / n * abs(got[tuple(int(x) for x in p)] - like[0] / sum(like))
    assert off < 0.02


def test_lexicon_voters_share_no_cluster():
    first = tox.clusters({0: 10, 1: 9, 2: 10, 3: 4}, {(0, 1): 9, (0, 2): 3, (2, 3): 4})
    assert first == {0: 0, 1: 0, 2: 2, 3: 3}
    voters = tox.dealt({0: 50.0, 1: 40.0, 2: 45.0, 3: 1.0}, first, 20.0)
    assert voters[:2] == [[0, 1], [2]] and voters[tox.SURE] == [3] and sum(map(len, voters)) == 4


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        w = [rng.choice(words) for _ in range(40)]
        for _ in range(3 if toxic else 0):
            w.insert(rng.randint(0, 40), rng.choice(["idiot", "scum"]) if i % 2 else "zzqur" + rng.choice(words))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    got = tox.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = got[got["held_out"]]
    truth = held["doc_id"] % 9 == 0
    assert ((held["predicted"] == 1) & truth).sum() >= 0.9 * truth.sum() and ((held["predicted"] == 1) & ~truth).sum() <= 1


def test_toxicity_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = tox.toxicity(docs, none)
    assert got.count() == docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert tox.toxicity(empty, none).count() == 0
    odd = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, 1, 9), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert tox.toxicity(docs, odd).count() == docs.count()


# 6

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if ok[k](m.group())))


PII = ["a@b.cc_x@y.zz", "x@y x@y. a.b@c.d-e.f1@g.h", "1.2.3.4.5.6.7.8 300.1.2.3.4.5.6", "007.1.1.255 1.2.3.0000256", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 x +12 +123456789012345678 +1 2 3 4 5 6 7 8 9 0", "😀 mail: z@q.io 😀 10.0.0.1", "4" * 3000 + " " + "9." * 500 + "1", "@" * 50 + "a" * 5000 + "@", None, ""]


def test_pii_matches_base_patterns(spark, docs, empty):
    rng = random.Random(5)
    fuzz = ["".join(rng.choice("0123456789 .-+@a_()%") for _ in range(80)) for _ in range(400)]
    rows = list(enumerate(PII + fuzz + [" ".join(f"u{i}@h.de" for i in range(1500))]))
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert got[i].n_email == want.count("email:")
    assert pii.pii_digest(docs).count() == docs.count() and pii.pii_digest(empty).count() == 0


def test_pii_checksums_and_context(spark):
    rows = [(0, "IBAN DE89 3704 0044 0532 0130 00 end"), (1, "IBAN DE89 3704 0044 0532 0130 01 end"), (2, "social security 123-45-6789"), (3, "number 123-45-6789"), (4, "version 1.2.3.4")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.kind for s in got[0] if s.kind == "iban"] and not [s for s in got[1] if s.kind == "iban"]
    assert [s.kind for s in got[2]] == ["ssn"] and got[3] == [] and got[4][0].score == 0.4


# 7


def jaccard_truth(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = t.lower().split()
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent, links = list(range(len(rows))), Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], least[find(i)], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [4, 1000])
def test_jaccard_join(docs, empty, block):
    rows = [(d, t) for d, t in plain(docs) if d is not None and d != 5]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jac.jaccard_join(docs.where("doc_id != 5"), block=block).collect())
    assert got == jaccard_truth(rows)
    assert sum(n > 0 for _, _, n in got) > 15
    if block == 1000:
        near = [(1, " ".join(f"w{k}" for k in range(60))), (1, " ".join(f"w{k}" for k in range(61)))]
        twice = jac.jaccard_join(docs.sparkSession.createDataFrame(near, "doc_id long, text string"))
        assert collected(twice) == [(1, 1, 1, 1), (1, 1, 1, 1)]
        assert jac.jaccard_join(empty).count() == 0 and jac.jaccard_join(docs).count() == docs.count()
        odd = docs.sparkSession.createDataFrame([(7, "one two three four five six"), (7, "all other words in this second text"), (None, "one two three four five six"), (None, "alone without an id"), (3, None), (3, "")], "doc_id long, text string")
        got = [tuple(r) for r in jac.jaccard_join(odd).collect()]
        assert sorted(r[:1] + r[2:] for r in got if r[0] == 7) == [(7, 0, 0), (7, 1, 0)] and sum(r[0] is None for r in got) == 2
        assert all(r[1] == 3 for r in got if r[0] == 3) and sorted(r[2] for r in got if r[0] is None) == [0, 1]


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        b, r = jac.bands_and_rows(threshold, 0.99999, 512)
        assert 1 - (1 - threshold**r) ** b >= 0.99999 and b * r <= 512
    with pytest.raises(ValueError):
        jac.bands_and_rows(0.1, 0.999999, 8)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=2, max_size=9), st.integers(0, 8))
def test_matrix_links(sets, cut):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    got = jac.links_within(arrays, None, 0.8)
    assert all(got[i, j] == (i != j and want(sets[i], sets[j])) for i in range(len(sets)) for j in range(len(sets)))
    cut = min(max(1, cut), len(sets) - 1)
    got = jac.links_within(arrays[:cut], arrays[cut:], 0.8)
    assert all(got[i, j] == want(sets[i], sets[cut + j]) for i in range(cut) for j in range(len(sets) - cut))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 103), (7, 7), (200, 100)]
    got = dict(collected(connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert all(got[i] == 0 for i in range(31)) and {got[k] for k in (100, 103, 105, 200)} == {100} and len(got) == 35
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8


def removal_truth(rows, length):
    counts = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = []
    for d, b in rows:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((d, len(b), sum(mark), sum(1 for k in range(len(b)) if mark[k] and (not k or not mark[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_group", [10_000, 3])
def test_suffix_dedup(docs, empty, max_group):
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(-(2**63) + 1, "x" * 150 + "y" * 100), (900, "q" + "x" * 150 + "y" * 100)], "doc_id long, text string"))
    got = suf.suffix_dedup(more, max_group=max_group).drop("removed")
    want = removal_truth([(d, t.encode()) for d, t in plain(more)], 200)
    assert collected(got) == want and sum(r[2] for r in want) > 2000
    if max_group > 3:
        assert suf.suffix_dedup(empty).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), max_size=7))
def test_loser_tree_merges_front_coded_runs(runs):
    blobs = [suf.pack([(s, b"L", 1, 2, i) for i, s in enumerate(r)]) for r in runs]
    merged = list(suf.merge([suf.unpack(b) for b in blobs]))
    assert [m[0] for m in merged] == sorted(s for r in runs for s in r)
    last = b""
    for s, shared, payload in merged:
        assert shared == suf.common(last, s) and payload[0] == b"L"
        last = s


def test_hot_strings_are_spread_and_whole(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(0, 30))), passage[rng.randint(0, 40) :], *(word() for _ in range(rng.randint(0, 30)))])) for i in range(120)]
    want = removal_truth([(d, t.encode()) for d, t in rows], 200)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    flush = suf.FLUSH
    try:
        for suf.FLUSH in (flush, 40_000):
            assert collected(suf.suffix_dedup(d, max_group=10).drop("removed")) == want
    finally:
        suf.FLUSH = flush


def test_anchors_cover_every_window_and_ignore_place():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcd ") for _ in range(5000))
    at, _ = suf.anchors(data, 200)
    assert all(any(s <= a <= s + 200 - suf.ANCHOR for a in at) for s in range(len(data) - 199))
    moved, _ = suf.anchors(b"#" * 777 + data[1000:3000] + b"!" * 50, 200)
    inner = [a for a in at if 1000 + 136 <= a <= 3000 - 200]
    assert set(a - 1000 + 777 for a in inner) <= set(moved.tolist())
    old, suf.SEGMENT = suf.SEGMENT, 700
    try:
        assert suf.anchors(data, 200)[0].tolist() == at.tolist()
    finally:
        suf.SEGMENT = old


# 9


QUESTION = "If Anna buys 3 kg of apples for 12 dollars at the market in Rome, how much does Anna pay for 5 kg of apples there?"


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, ""), (3, None), (None, "x"), (4, "Two short words")], "item_id long, text string")
    copy = QUESTION.replace("Anna", "Boris").replace("3 kg", "7 kg").replace("12", "30").replace("5 kg", "9 kg").replace("Rome", "Oslo")
    clash = copy.replace("does Boris", "does Clara")
    rows = [(0, "Intro words. " + QUESTION + " Outro."), (1, "Some talk first. " + copy), (2, "Some talk first. " + clash), (3, "Nothing like it at all in this text"), (4, None), (5, ""), (6, "now Two short words here")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, items string")
    for bits in (24, 6):
        got = {r.doc_id: [x.item_id for x in r["items"]] for r in dec.contaminated(docs, bench, filter_bits=bits).collect()}
        assert [got[i] for i in range(7)] == [[1], [1], [], [], [], [], [4]], bits
    assert dec.contaminated(docs.where("false"), bench).count() == 0
    assert dec.contaminated(docs, bench.where("false")).where(F.size("items") > 0).count() == 0
    assert dec.contaminated(docs, bench, keep=("doc_id", "items", "text")).columns == ["doc_id", "text", "items"]


def test_window_hashes_match_templates():
    import xxhash

    for t in (QUESTION, "A b. C d! 3 km 4 kilometres (Anna) - x : Y 2 % z", "... !!! a", "", "5 5 kg kg"):
        kinds, _ = dec.template(t)
        assert dec.Canon(8).hashes(t).tolist() == [xxhash.xxh64_intdigest(k) for k in kinds]


def test_reparameterised_forms(spark):
    money = "Anna paid $12 for 3kg of rice at 10:30. Anna then sold 1/2 of the rice with a gain of 15% to a friend. How much did Anna get?"
    bench = spark.createDataFrame([(1, QUESTION), (2, money), (3, "What is the capital of France?"), (4, "Define photosynthesis")], "item_id long, text string")
    words = QUESTION.split()
    rows = [
        (QUESTION.replace("Rome", "New York"), [1]),
        (QUESTION.replace("Anna", "Mary Jane").replace("Rome", "San Juan"), [1]),
        (" ".join([*words[:13], "busy", *words[13:]]), [1]),
        (" ".join([*words[:12], *words[13:]]), [1]),
        (money.replace("$12", "$30.50").replace("3kg", "14 kg").replace("10:30", "9:15").replace("1/2", "3/4").replace("15%", "20%"), [2]),
        ("Talk. " + money.replace("Anna", "Boris"), [2]),
        (money.replace("Anna then", "Boris then"), []),
        ("What is the capital of Peru?", [3]),
        ("This is the capital of Peru.", []),
        ("However photosynthesis", []),
        ("We read: Define photosynthesis now", [4]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [x.item_id for x in r["items"]] for r in dec.contaminated(docs, bench).collect()}
    assert [got[i] for i in range(len(rows))] == [x for _, x in rows]
    for t in (money, "New York, Rome (Paris) 3 1/2 km 4 , 5 ... The Hague 10% % 7 . m", "...", "3 ... 4 kg"):
        assert dec.Canon(8).hashes(t).tolist() == [dec.Canon(8).hash(k) for k in dec.template(t)[0]]


def template_truth(texts, items, window=8, coverage=0.6):
    """Brute force: every pair of places of the two templates at which a window is equal, then the alignment."""
    out = []
    for text in texts:
        kinds, values = dec.template(text or "")
        found = []
        for item_id, question in items:
            item = dec.template(question)
            w = min(window, len(item[0]))
            hits = [(p, q) for p in range(len(kinds) - w + 1) for q in range(len(item[0]) - w + 1) if kinds[p : p + w] == item[0][q : q + w]]
            share = dec.aligned_share(item, dict(enumerate(v for v, _ in values)), hits, window, coverage)
            if share is not None:
                found.append((item_id, share))
        out.append(sorted(found))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(12)
    words = ["Anna", "Boris", "buys", "3", "12", "kg", "of", "rice", "in", "Rome", "then", "sells", "the", "rest", "for", "$5", "to", "friends", "every", "day."]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 9, 14, 30])))) for i in range(25)]
    texts = [" ".join([*(rng.choice(words) for _ in range(20)), *rng.choice(items)[1].replace("Anna", "Mary Jane").replace("12", "99").split(), *(rng.choice(words) for _ in range(20))]) for _ in range(60)]
    texts += texts[:5] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r["items"]] for r in dec.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = template_truth(texts, items)
    assert [got[i] for i in range(len(texts))] == want and sum(map(bool, want)) > 40


def test_every_filter_size_finds_the_same(spark):
    bench = spark.createDataFrame([(1, QUESTION), (4, "Two short words"), (5, "one"), (6, "Where was Anna born?")], "item_id long, text string")
    texts = ["now Two short words here", "Two short words", "one", "only one of many words in a rather long text", "Where was Boris born?", "I ask: Where was Mary Jane born? Two short words.", QUESTION + " Where was Rome born?", "short words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near, far = ({r.doc_id: [tuple(x) for x in r["items"]] for r in dec.contaminated(docs, bench, filter_bits=bits).collect()} for bits in (24, 6))
    assert near == far and [[k for k, _ in far[i]] for i in range(len(texts))] == [[4], [4], [5], [5], [6], [4, 6], [1, 6], [], [], []]


# 10


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_token_counts(docs, empty, spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    rng = random.Random(6)
    special = ["a<|endoftext|>b", "x  \n\n y\t\x1c\x85 z", "don't we'll I'M", "٣٤ ½ ²", "͸ำ" * 3, "<|endof" * 10]
    long = [" ".join(rng.choice(["hello", "worlds", "12345", "don't", "  ", "<|endoftext|>", "Ünïcödé", "😀"]) for _ in range(k)) for k in (400, 1500)] + ["a" * 3000, "ab" * 200 + " " * 900 + "c" * 10]
    rows = [(1000 + i, x) for i, x in enumerate(special + long)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    for options in ({}, {"huge_chars": 300, "chunk_chars": 256, "overlap_chars": 128}):
        got = collected(tok.count_tokens(more, tokenizer, **options))
        assert got == sorted(((r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in more.collect()), key=str)
    assert tok.count_tokens(empty, tokenizer).count() == 0
    with pytest.raises(ValueError):
        tok.count_tokens(docs, tokenizer, overlap_chars=10)


def test_widening_finds_a_boundary(tokenizer):
    c = tok.TokenCounter(tokenizer)
    for text in ("x" * 2000 + " tail words here " * 20, "word " * 700, "<|endoftext|>" * 90):
        assert tok.count_widening(c, text, 200) == c.library([text])[0] == c.counts([text])[0]


def test_native_operators_plan_no_python_and_no_cross_joins(docs):
    for df in (lines.dedupe_lines(docs), pii.pii_digest(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|MapInArrow|CartesianProduct|NestedLoop", plan)
