"""Top-k, decontamination, secrets and license scans against brute force."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gradeflow.llm import decontaminate, licenses, secrets, topk

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("queries,candidates,size", [(512, 8192, 64 << 20), (2, 20, 1 << 12)])
def test_top_k(spark, monkeypatch, queries, candidates, size):
    monkeypatch.setattr(topk, "QUERIES_A_TILE", queries)
    monkeypatch.setattr(topk, "CANDIDATES_A_TILE", candidates)
    monkeypatch.setattr(topk, "SHARD_BYTES", size)
    odd = [(1000, None), (1001, [float("nan")] * 64), (1050, [0.5] * 64), (1050, [0.4] * 64), (1050, [0.4] * 64), (None, [0.1] * 64), (1100, [1.0, 2.0]), (1101, [1.5, 2.0]), (1102, [1.0, None]), (1103, [])]
    ties = [(2000 + i, [1.0] * 64) for i in range(9)] + [(2003, [1.0] * 64)] * 3
    long = [(3000, [0.5] * 20_000), (3001, [0.25] * 20_000), (3050, [1e6] * 100), (3051, [-1e6] * 100), (3052, [1.25e6] * 100)]
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("score"))
    df = df.unionByName(spark.createDataFrame(odd + ties + long, "vec_id long, embedding array<float>").withColumn("score", F.lit(2)))
    rows = []
    for r in df.collect():
        x = r["embedding"]
        if r["vec_id"] is None or not x or any(y is None or not math.isfinite(y) for y in x):
            continue
        rows.append((r["vec_id"], [math.floor(256 * y) for y in x]))
    want = []
    for at, (q, x) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for other, (i, y) in enumerate(rows) if other != at and len(x) == len(y))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k_digest(df).collect())) == sorted(want)


def test_top_k_of_nothing(spark):
    assert topk.top_k_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_contamination(docs, bench):
    windows = {}
    for i, t in bench:
        w = WORDS.findall(lowered(t or ""))
        if w and i is not None:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = WORDS.findall(lowered(t or ""))
        hit, items = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    items |= own
                    hit[k : k + size] = [1] * size
        out.append((i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_bytes", [decontaminate.PASS_BYTES, 3000])
@pytest.mark.parametrize("extra", [[], [(900, "the of"), (901, "Für"), (902, None), (903, " ,. "), (905, "a"), (904, "x " * 14), (None, "the"), (900, "of the")]])
def test_contamination(spark, extra, pass_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(90001, None), (90002, ""), (90003, "X " * 13 + "FÜR für"), (90004, "a"), (None, "the of the"), (90003, "X " * 13 + "FÜR für")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("n_words", F.lit("clash"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    if extra:
        bench = bench.unionByName(spark.createDataFrame(extra, bench.schema))
    passes = decontaminate.pattern_passes(bench, pass_bytes=pass_bytes)
    assert (len(passes) > 1) == (pass_bytes == 3000)
    found = docs.select("doc_id", decontaminate.contamination(F.col("text"), passes).alias("f")).select("doc_id", "f.*")
    got = [(r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hit_runs"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["hit_runs"])) for r in found.collect()]
    want = brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], map(tuple, bench.collect()))
    assert sorted(got, key=str) == want


def test_contamination_by_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    row = decontaminate.contamination_digest(docs, spark.createDataFrame([], "item_id long, text string")).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (3, 0, False)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def entropy_spans(text):
    """Windows by plain counting."""
    base = [(int(a), int(b)) for _, a, b in (s.split(":") for s in base_spans(text).split(",") if s)]
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        c = m[0]
        if re.search(secrets.ALLOWED.removeprefix("(?i)"), c, re.I):
            continue
        kind = "entropy_hex" if re.fullmatch("[0-9a-fA-F]+", c) else "entropy_base64"
        runs = []
        for k in range(len(c) - secrets.WINDOW + 1):
            w = c[k : k + secrets.WINDOW]
            if sum(secrets.weight(w.count(x)) for x in set(w)) <= secrets.LIMITS[kind] and not re.search(secrets.PLACEHOLDER, w):
                if runs and runs[-1][1] >= k:
                    runs[-1][1] = k + secrets.WINDOW
                else:
                    runs.append([k, k + secrets.WINDOW])
        out += [(m.start() + a, kind, m.start() + b) for a, b in runs if not any(x <= m.start() + a and y >= m.start() + b for x, y in base)]
    return out


def test_secrets(spark):
    rng = random.Random(6)
    alphabet = "0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/_=-"
    texts = [None, "", "token=short secret=token: abcdefgh", "é😀 PASSWORD : 'abcDEF1'", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "token=abcdefgh," * 700, "f" * 23, "deadbeef" * 3]
    texts += ["".join(rng.choice(alphabet[:62] if rng.random() < 0.9 else " é\n") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += ["x " + "".join(rng.choice(alphabet) for _ in range(n)) + " api_key = zzzzzz9" for n in (19, 20, 21, 40, 900, secrets.STRETCH + 18, secrets.STRETCH + 19, 7000)]
    texts += ["sample_key=" + "".join(rng.choice(alphabet[:62]) for _ in range(60)), "".join(rng.choice(alphabet[:16]) + ("0000" if k % 40 == 0 else "") for k in range(3000))]
    texts += ["".join(rng.choice(alphabet) if k // 300 % 2 else "a" for k in range(6000)) + "9"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in secrets.secret_digest(df).collect()}
    added = 0
    for i, t in enumerate(texts):
        spans = [s for s in got[i]["spans"].split(",") if s]
        base = ",".join(s for s in spans if not s.startswith("entropy"))
        assert base == base_spans(t or ""), t
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        more = entropy_spans(t or "")
        added += len(more)
        assert [s for s in spans if s.startswith("entropy")] == [f"{k}:{a}:{b}" for a, k, b in more], t
    assert added > 10
    plan = secrets.secret_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_long_candidate(spark):
    """One candidate of 60,000 characters takes seconds, and an empty table gives an empty one."""
    import time

    rng = random.Random(8)
    alphabet = "0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/"
    df = spark.createDataFrame([(1, "".join(rng.choices(alphabet, k=60_000)))], "doc_id long, text string")
    began = time.time()
    spans = secrets.secret_digest(df).first()["spans"].split(",")
    assert time.time() - began < 60
    assert sum(int(b) - int(a) for _, a, b in (s.split(":") for s in spans if s.startswith("entropy"))) > 54_000
    assert secrets.secret_digest(df.where("false")).count() == 0


def test_masking_of_many(spark):
    text = "".join(f"é{k} token=abc{k:05}\n" for k in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secrets.redacted(secrets.with_secret_spans(df)).first()["text"]
    assert got == re.sub("token=abc[0-9]{5}", "[secret]", text)


def test_masking(spark):
    df = spark.createDataFrame([(1, 'é token = "abcdef123" end'), (2, None), (3, "plain")], "doc_id long, text string")
    got = secrets.redacted(secrets.with_secret_spans(df)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ['é [secret]" end', None, "plain"]


def test_licenses(spark):
    rows = [(1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "hello"), (3, "a/y.py", "filler text that is long enough\nLicensed under the Apache License, Version 2.0.\nand more of it here"), (4, "a/b/z", None), (5, None, "x"), (6, "top", ""), (8, "q/r/s/t", "none"), (2, "a/b/c/x.py", "hello")]
    got = sorted(tuple(r)[:3] + tuple(r)[4:] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    inherited = ("MIT", "inherited", "a/b/LICENSE")
    assert got == sorted([
        (1, "a/b/LICENSE", "MIT", "file", None), (2, "a/b/c/x.py", *inherited), (2, "a/b/c/x.py", *inherited), (3, "a/y.py", "Apache-2.0", "header", None),
        (4, "a/b/z", *inherited), (5, None, None, "none", None), (6, "top", None, "none", None), (8, "q/r/s/t", None, "none", None),
    ])


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


MIT_FILE = """MIT License

Copyright (c) 2021 A. Writer

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
GPL_HEADER = """A program that does something.
Copyright (C) 2020 Somebody

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful."""
APACHE_HEADER = """Copyright 2019 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
CODE = "\n\n" + "\n\n".join(f"def total{k}(x):\n    return sum{k}(x)" for k in range(60))


def test_real_license_files_and_headers(spark):
    bsd = licenses.TEMPLATES["BSD-3-Clause"][1]
    rows = [
        (1, "mit/LICENSE", MIT_FILE, "MIT", "file"),
        (2, "mit/src/a.py", CODE, "MIT", "inherited"),
        (3, "gpl/COPYING", GPL_FILE, "GPL-3.0", "file"),
        (4, "gpl/b.py", CODE, "GPL-3.0", "inherited"),
        (5, "gpl/c.py", commented(GPL_HEADER, "#") + CODE, "GPL-2.0", "header"),
        (6, "x/d.c", "/*\n" + commented(APACHE_HEADER, " *") + "\n */" + CODE, "Apache-2.0", "header"),
        (7, "x/e.c", "// SPDX-License-Identifier:  LGPL-2.1-or-later, as of today and so on" + CODE, "LGPL-2.1", "header"),
        (8, "x/f.c", "// SPDX-License-Identifier: EUPL-1.2" + CODE, None, "none"),
        (9, "y/LICENSE", "Copyright (c) 2020, Me. All rights reserved.\n\n" + bsd, "BSD-3-Clause", "file"),
        (10, "z/g.py", commented(MIT_FILE, "//") + CODE, "MIT", "header"),
        (11, "x/h.txt", "The license of the car was free software once. " * 50, None, "none"),
    ]
    found = licenses.license_scan(spark.createDataFrame([(*r[:3], "clash", "clash") for r in rows], "doc_id long, path string, text string, license string, folder string"))
    assert {(r["doc_id"], r["license"], r["origin"]) for r in found.collect()} == {(i, name, origin) for i, _, _, name, origin in rows}


def test_licenses_of_ties_and_nothing(spark):
    one = "Released under the MIT License."
    rows = [(1, "p/b/LICENSE", one), (2, "p/a/../LICENSE", None), (3, "p/b/COPYING", one), (4, "p/b/c/d.py", ""), (None, "p/b/e.py", None), (5, "p/b/f", "word " * 200_000 + "\n" + one)]
    schema = "doc_id long, path string, text string"
    got = {r["path"]: (r["license"], r["origin"], r["inherited_from"]) for r in licenses.license_scan(spark.createDataFrame(rows, schema)).collect()}
    assert got["p/b/c/d.py"] == got["p/b/e.py"] == ("MIT", "inherited", "p/b/COPYING")
    assert got["p/a/../LICENSE"] == (None, "none", None) and got["p/b/f"] == ("MIT", "header", None)
    assert licenses.license_scan(spark.createDataFrame([], schema)).count() == 0


def test_scan_by_brute_force(spark):
    """License, cosine and origin of every document, by plain scores of all units with all templates."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["license"], r["cosine"], r["origin"]) for r in licenses.corpus_licenses(docs).where("origin in ('file', 'header')").collect()}
    rows = docs.select("doc_id", "text")
    templates = licenses.all_templates()
    vocabulary = sorted({t for _, x, _ in templates for t in licenses.plain_terms(x)})
    n, idf = licenses.inverse_frequency(rows, "text", vocabulary)
    vectors, other = licenses.unit_vectors([x for _, x, _ in templates], idf), math.log(1 + n) + 1
    want = {}
    for r in rows.collect():
        text = r["text"] or ""
        paragraphs = re.split(licenses.GAP, re.sub(r"^[^A-Za-z0-9]+", "", text))
        for kind, units in [("whole", [text]), ("first", paragraphs[:1]), ("part", [*paragraphs[1:], *text.split("\n"), *re.findall(licenses.TAG, text.lower())])]:
            for unit in units:
                terms = licenses.plain_terms(unit)
                w = {t: (1 + math.log(terms.count(t))) * idf.get(t, other) for t in set(terms)}
                size = math.sqrt(sum(x * x for x in w.values()))
                if not size:
                    continue
                cosine, minus = max((round(sum(x * v.get(t, 0) for t, x in w.items()) / size, 9), -k) for k, v in enumerate(vectors))
                if cosine >= licenses.THRESHOLD:
                    name, _, head = templates[-minus]
                    standing = 2 if kind == "first" and head else int(kind == "whole")
                    want[r["doc_id"]] = max(want.get(r["doc_id"], (-1,)), (standing, cosine, minus, name))
    assert got == {i: (name, pytest.approx(cosine, abs=2e-6), "file" if standing else "header") for i, (standing, cosine, _, name) in want.items()} and want


def test_window_that_many_items_share():
    """One prompt sentence in thousands of items is one pattern: a hit takes no longer, and names all its items."""
    import time

    import pyarrow as pa

    from gradeflow.llm import decontaminate

    prompt = "answer the following question as well as you can please thanks"
    took = {}
    for n in (100, 4000):
        items = [(f"i{k}", f"{prompt} number{k} is what{k} of these{k} here") for k in range(n)]
        matcher = decontaminate.Matcher(items, 10)
        texts = pa.array([f"x{k} {prompt} y" for k in range(300)] + [prompt + " number7 is what7"], pa.string())
        found = decontaminate.Found(texts)
        began = time.process_time()
        found.search(matcher)
        took[n] = time.process_time() - began
        out = found.result().to_pylist()
        assert all(len(r["items"]) == n and r["hit_runs"] == [{"start": 1, "end": 12}] for r in out[:300])
        assert len(out[300]["items"]) == n and out[300]["hit_runs"] == [{"start": 0, "end": 14}]
    assert took[4000] < 20 * took[100] + 0.2  # the items themselves are forty times as many


def test_inheritance_by_plain_search(spark):
    """Nearest directories above, over random trees: license files by name or by length hand down, sentences in other files don't."""
    rng = random.Random(6)
    mit, bsd = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["BSD-3-Clause"][1]
    long_mit = max(mit, key=len)
    folders = ["", *{"/".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(40)}]
    rows = []
    for k in range(160):
        folder = rng.choice(folders)
        name, text = rng.choice([("x.py", "plain text"), ("y.py", None), (f"z{k}.txt", "Released under the MIT License."), ("LICENSE", "Released under the MIT License."), ("COPYING.md", bsd), ("about.txt", long_mit), ("x.py", "more text"), ("w.py", "")])
        rows.append((k, f"{folder}/{name}" if folder else name, text))
    rows = list({r[1]: r for r in rows}.values())
    got = {r["path"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(long_mit.split()) >= licenses.GIVES_FROM
    given = {}
    for _, path, text in rows:
        if got[path]["origin"] == "file" and (re.search(r"(LICENSE|COPYING\.md)$", path) or len(text.split()) >= licenses.GIVES_FROM):
            folder = path.rpartition("/")[0]
            best = (-got[path]["cosine"], path, got[path]["license"])
            given[folder] = min(given.get(folder, best), best)
    assert given and any(got[p]["origin"] == "file" and p.endswith(".txt") for p in got)
    for _, path, text in rows:
        if got[path]["origin"] in ("file", "header"):
            assert text and got[path]["inherited_from"] is None
            continue
        folder = path.rpartition("/")[0]
        while folder and folder not in given:
            folder = folder.rpartition("/")[0]
        want = given.get(folder)
        assert (got[path]["license"], got[path]["inherited_from"]) == ((want[2], want[1]) if want else (None, None)), path


def shuffled_bytes(spark):
    """Bytes that all jobs of the session have shuffled so far."""
    import time

    time.sleep(0.3)
    spark.range(4).repartition(2).count()  # an ended task brings the totals up to date
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_license_scan_shuffles_each_text_once(spark, monkeypatch):
    """Terms, products and sums of a unit stay where its text was dealt; rows of one key and path, equal ones too, are still one file."""
    monkeypatch.setattr(licenses, "FILES_A_DEAL", 20)
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"{rng.getrandbits(40):x}" for _ in range(12)) for _ in range(25)) + "\n\nReleased under the MIT License.\n" for _ in range(200)]
    apache = "some other text\nLicensed under the Apache License, Version 2.0.\n"
    rows = [(k, f"f{k}.txt", text) for k, text in enumerate(texts)]
    rows += [(0, "f0.txt", texts[0]), (1, "f1.txt", apache), (None, None, texts[2]), (None, None, texts[2]), (None, None, apache)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    before = shuffled_bytes(spark)
    got = licenses.license_scan(files).collect()
    assert 0 < shuffled_bytes(spark) - before < 1.5 * sum(len(r[2]) for r in rows)
    assert len(got) == len(rows)
    twice = {"f1.txt", None}  # the whole of the other text is a license
    assert all((r["license"], r["origin"]) == (("Apache-2.0", "file") if r["path"] in twice else ("MIT", "header")) for r in got)
