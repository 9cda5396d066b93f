"""Operators of the llm subpackage against brute force, on rows with every oddity."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compostat.llm import bpe, decontam, langid, licences, linededup, sharding, simhash, tiff, toxicity, warc
from compostat.llm import queries as Q

SF = "/root/testdata/sf0.001"


def odd_texts():
    rng = random.Random(7)
    words = "alpha beta gamma delta Épsilon zeta ETA theta iota 12 a's don't x y 　".split(" ")
    long = " ".join(rng.choice(words) for _ in range(4000))
    return [
        None, "", " ", "\n", "a", "one two", "Shared line number one\nother text here", "shared LINE number one  \nunique 77",
        long, long, long[:-9] + "changed!", "x" * 5000, " " * 3000 + "end", "it's 'quoted' we'll\r\n\r\n  tabs\there", "日本語の文章です。" * 200, "😀 emoji\x00nul \x1c sep \x85 next",
        "Shared line number one\nShared line number one\nzz", "\n\n\n",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0, "clash", 1) for i, t in enumerate(odd_texts())]
    rows += [(5, "one two", "en", "s", 0, "clash", 2), (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, fp int")


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def tokens(text):
    return np.array(bpe.coder(Q.ranks(), Q.pattern()).encoding.encode_ordinary(text or ""), "<u4")


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 512), (64, 16), (40, 8)])
def test_bpe_matches_library(docs, chunk, overlap):
    got = bpe.encode_documents(docs, Q.ranks(), Q.pattern(), chunk_chars=chunk, overlap_chars=overlap)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = tokens(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    if chunk == 64:
        back = bpe.decode_documents(got, Q.ranks(), Q.pattern())
        assert sorted((bytes(r["decoded"]) for r in back.collect())) == sorted((r["text"] or "").encode() for r in docs.collect())


def test_bpe_on_table_and_empty(spark, docs):
    table = Q.table(spark, SF, "documents")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in bpe.encode_documents(table, Q.ranks(), Q.pattern(), chunk_chars=700, overlap_chars=60).collect()}
    for r in table.collect():
        ids = tokens(r["text"])
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert bpe.encode_documents(docs.limit(0), Q.ranks(), Q.pattern()).count() == 0


def test_bpe_query_writes_few_files(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", "a few words " * 5000, "it's 'quoted' 日本 😀"] * 10)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20).write.parquet(f"{tmp_path}/documents.parquet")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # about a partition for each file
    try:
        docs = Q.table(spark, str(tmp_path), "documents")
        assert docs.rdd.getNumPartitions() > 15
        out = Q.op1_byte_bpe(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() <= 8
        got = rows_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    want = [(i, len(tokens(t)), hashlib.sha256(tokens(t).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert got == sorted(want, key=repr)


def test_stitch_without_common_boundary_is_one_piece():
    assert bpe.stitch(30, [0, 10, 20], [], [[], [12], []], [[12], [], []]) == [(0, 0, 0, 12), (1, 1, 12, 20), (2, 1, 20, 30)]
    assert bpe.stitch(5, [0], [], [[]], [[]]) == [(0, 0, 0, 5)]


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{fp:016x}", least.get(find(k))) for k, (i, fp) in enumerate(fps)), key=repr)


def test_simhash_matches_brute_force(spark, docs, monkeypatch):
    for df in (docs, Q.table(spark, SF, "documents")):
        want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()])
        assert rows_of(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == want
    monkeypatch.setattr(simhash, "_SLICE", 50)
    for t in odd_texts():
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pigeonring_finds_every_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp bigint")
    for bits, segments in ((3, 4), (1, 4), (0, 4), (5, 8)):
        want = {(min(a, b), max(a, b)) for (a,) in signed for (b,) in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
        got = [tuple(r) for r in simhash.links(df, bits, segments).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        simhash.links(df, 4, 4)


def test_links_broadcast_neither_side(spark):
    # Both sides hold a multiple of the rows that Spark estimates from the fingerprints.
    plan = simhash.links(spark.range(100).select(F.col("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = dict(simhash.components(pairs).collect())
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def brute_licences(rows, known=licences.SENTENCES, rules=licences.RULES, max_gap=3):
    ids, slots, out = {s: i for i, s in reversed(known)}, [], []
    for i, s in known:
        if "*" in s:
            before, after = (x.strip() for x in s.split("*"))
            slots.append((re.compile(f"{before} .{{1,160}}?" + (f" {after}" if after else "")), i))
            if len(after.split()) >= 8:
                ids.setdefault(after, i)
    for doc, t in rows:
        seq, strange = [], []
        for p, s in enumerate(re.sub(r"([.!?])[ \t\r\n]+", r"\1\n", t or "").split("\n")):
            low = s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            key = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", low).strip(" ")
            sid = ids.get(key) or next((i for pattern, i in slots if pattern.fullmatch(key)), None)
            if sid:
                seq.append((p, sid))
            elif len(key.split(" ")) >= 4 and not re.match("(https?|copyright) ", key) and not any(key.startswith(pattern.pattern.split(".{")[0]) for pattern, _ in slots):
                strange.append(p)
        runs, found = [], []  # (identifiers, whether an unknown sentence follows)
        for k, (p, i) in enumerate(seq):
            after = seq[k + 1][0] if k + 1 < len(seq) else 1 << 40
            odd = any(p < q < after and q - p <= max_gap for q in strange)
            if not k or runs[-1][1] is not None:
                runs.append([[], None])
            runs[-1][0].append(i)
            if odd or after - p > max_gap:
                runs[-1][1] = odd
        for licence, want in rules:
            want, calm = [w for w in want if w != "$"], want[-1] == "$"
            k = 0
            while k < len(runs):
                own, odd = runs[k]
                at = next((j for j in range(len(own) - len(want) + 1) if own[j : j + len(want)] == want and not (calm and odd and j + len(want) == len(own))), None)
                if at is None:
                    k += 1
                    continue
                found.append(licence)
                runs[k : k + 1] = [[own[:at], False], [own[at + len(want) :], odd]]
        out.append((doc, len(seq), ",".join(i for _, i in seq), ",".join(dict.fromkeys(found)), sum(len(r[0]) for r in runs)))
    return sorted(out, key=repr)


def filled(known=licences.SENTENCES):
    """Sentences by identifier, usual holders in their slots."""
    usual = {"bsd_endorse": "the copyright holder", "bsd_as_is": "the copyright holders and contributors", "mit_liability": "the authors or copyright holders", "bsd_acknowledge": "the University"}
    return {i: s.replace("*", usual.get(i, "the University")) for i, s in known}


def test_licence_scan_matches_brute_force(spark, docs):
    text = filled()
    mit = ". ".join(text[i].upper() for i in ("mit_grant", "mit_notice", "mit_as_is")) + "."
    bsd = ".\n".join(text[i] for i in ("bsd_grant", "bsd_source", "bsd_binary"))
    rows = [(1, mit + " All rights reserved."), (2, bsd), (3, bsd + "!\na\nb\nc\nd\n" + text["bsd_endorse"]), (4, "x. Licensed under the Apache License, Version 2.0. Licensed under the MIT License."), (5, text["mit_notice"]), (6, None), (6, None), (7, "All rights reserved.\n" * 3), (None, "(All, rights -- reserved)")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    cols = ("doc_id", "n_known", "sentence_ids", "licenses", "n_unmatched")
    for df in (made, docs, Q.table(spark, SF, "documents"), docs.limit(0)):
        assert rows_of(licences.scan(df), *cols) == brute_licences([(r["doc_id"], r["text"]) for r in df.collect()])
    got = {r["doc_id"]: (r["licenses"], r["n_unmatched"]) for r in licences.scan(made).collect()}
    assert got[1] == ("MIT,all rights reserved", 0) and got[2] == ("BSD-2-Clause", 0) and got[3] == ("BSD-2-Clause", 1) and got[5] == ("", 1)


def test_licence_scan_finds_wrapped_texts(spark):
    import textwrap

    text = filled()
    para = lambda i, mark="", width=72: "\n".join(mark + x for x in textwrap.wrap(text[i].capitalize() + ".", width))
    mit, bsd = ("mit_grant", "mit_notice", "mit_as_is"), ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 A\n\n" + "\n\n".join(para(i) for i in mit)),
        (2, "/*\n * Copyright 2020 A\n" + "\n *\n".join(para(i, " * ") for i in mit) + "\n */\nint main;"),
        (3, para(bsd[0])[:-1] + ":\n\n1. " + para(bsd[1], "   ").strip() + "\n\n2. " + para(bsd[2], "   ").strip()),
        (4, para(bsd[0])[:-1] + ":\n* " + para(bsd[1], "  ").strip() + "\n* " + para(bsd[2], "  ").strip() + "\n* " + para(bsd[3], "  ").strip()),
        (5, "\n#\n".join(para(i, "# ", 40) for i in ("gpl_free", "gpl_hope", "gpl_copy"))),
        (6, "\r\n\r\n".join(para(i).replace("\n", "\r\n") for i in ("gpl2_free", "gpl_hope", "gpl_copy"))),
        (7, "Licensed under the\nMIT License\nAll rights reserved\nmore"),
        (8, 'Licensed under the Apache License, Version 2.0\n(the "License");\nyou may not use this file except in\ncompliance with the License.\nYou may obtain a copy\nof the License at'),
        (9, "Licensed under the\n\nMIT License"),
        (10, "Licensed under the MIT.\nLicense"),
        (11, "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"),
        (12, "\n#\n".join(para(i, "# ") for i in ("lgpl21_free", "lgpl_hope", "lgpl_copy"))),
        (13, "filler line\n" * 500 + "\n\n".join(para(i) for i in ("isc_grant", "isc_as_is")) + "\nfiller line" * 500),
        (14, para(bsd[0])[:-1] + ":\n\n" + "\n\n".join(para(i) for i in (*bsd[1:], "bsd_as_is"))),
    ]
    got = {r["doc_id"]: (r["licenses"], r["n_known"], r["n_unmatched"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {1: ("MIT", 3, 0), 2: ("MIT", 3, 0), 3: ("BSD-2-Clause", 3, 0), 4: ("BSD-3-Clause", 4, 0), 5: ("GPL-3.0-or-later", 3, 0), 6: ("GPL-2.0-or-later", 3, 0), 7: ("MIT,all rights reserved", 2, 0), 8: ("Apache-2.0", 3, 0), 9: ("", 0, 0), 10: ("", 0, 0), 11: ("MPL-2.0", 2, 0), 12: ("LGPL-2.1-or-later", 3, 0), 13: ("ISC", 2, 0), 14: ("BSD-3-Clause", 5, 0)}
    assert got == want


def test_licences_with_holders_and_unknown_sentences(spark):
    text = filled()
    bsd2 = ". ".join(text[i] for i in ("bsd_grant", "bsd_source", "bsd_binary")) + ". "
    as_is = "THIS SOFTWARE IS PROVIDED BY {} ``AS IS\'\' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    endorse = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission. "
    odd = "You may not use this for weapons of any kind. "
    header = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; version 2 of the License.\n"
    texts = {
        bsd2 + endorse.format("Acme Inc.") + as_is.format("ACME INC."): "BSD-3-Clause", bsd2 + endorse.format("the University") + as_is.format("THE REGENTS"): "BSD-3-Clause",
        bsd2 + endorse.format("the\nUniversity of Somewhere"): "BSD-3-Clause", bsd2 + as_is.format("ACME CORP."): "BSD-2-Clause", bsd2 + as_is.format("JANE DOE"): "BSD-2-Clause",
        bsd2 + odd + as_is.format("JANE DOE"): "BSD, clauses unknown", bsd2 + odd: "BSD, clauses unknown", bsd2: "BSD-2-Clause", bsd2 + "All rights reserved.": "BSD-2-Clause,all rights reserved",
        bsd2 + "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University. " + endorse.format("the University"): "BSD-4-Clause",
        "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied.": "Apache-2.0",
        header: "GPL-2.0-only", header.replace("; version", "; either version").replace("License.\n", "License, or (at your option) any later version.\n"): "GPL-2.0-or-later",
        "// SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0", "# SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR ISC\nx = 1": "GPL-2.0-only,BSD-3-Clause,ISC",
        "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only", "SPDX-License-Identifier: BSL-1.0": "BSL-1.0", "Released under the MIT License, see LICENSE.": "MIT", "Tea OR coffee": "",
        "Licensed under the Eclipse Public License, version 2.0": "EPL-2.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["licenses"] for r in licences.scan(df).collect()}
    assert [(t, got[k], want) for k, (t, want) in enumerate(texts.items()) if got[k] != want] == []


def brute_lines(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(upper)
    owner, out, last = {}, [], 1 << 63
    for i, t in rows:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), last), last - 1 if i is None else i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (last - 1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "hot_lines"), [(1, 100_000), (7, 100_000), (4, 3)])
def test_line_dedup_matches_brute_force(spark, docs, batches, hot_lines):
    long = docs.limit(1).select(F.lit(77).cast("bigint").alias("doc_id"), F.lit("a line of some length\n" * 60_000 + "x" * 1_500_000).alias("text"))
    clashing = docs.unionByName(long, allowMissingColumns=True).withColumn("__text", F.lit(1)).withColumn("doc", F.lit("d")).withColumn("drop", F.lit(None).cast("int")).withColumn("__kept", F.lit("gone"))
    for df in (clashing, Q.table(spark, SF, "documents")):
        got = linededup.clean(df, batches=batches, fan_out=2, hot_lines=hot_lines)
        names = [c for c in df.columns if c != "__kept"]
        assert got.columns == [*names, "__kept", "__n_lines", "__n_dropped"]
        assert rows_of(got, "doc_id", "__n_lines", "__n_dropped", "__kept") == brute_lines([(r["doc_id"], r["text"]) for r in df.collect()])
        others = [c for c in names if c not in ("doc_id", "text")]
        assert rows_of(got, *others) == rows_of(df, *others)
    assert linededup.clean(docs.limit(0)).count() == 0


def test_runs_merge_without_shuffling_or_sorting_the_index(spark):
    runs = linededup.LineRuns(spark, buckets=4, fan_out=2)
    frame = lambda lo, hi: spark.range(lo, hi).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.col("id").alias("doc"))
    for k in range(5):
        runs.add(linededup.owners_of(frame(0, 10 * (k + 1))))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    held = [r["owner"] for t in runs.runs() for r in spark.table(t).collect()]
    assert sorted(held) == list(range(50))
    with runs.planned():
        for plan in (runs.unseen(linededup.owners_of(frame(0, 60))), runs.strangers(frame(0, 60))):
            lines = [x.strip(" :+-*") for x in plan._jdf.queryExecution().executedPlan().toString().splitlines()]
            assert sum("LeftAnti" in x and "SortMergeJoin" in x for x in lines) == 2 and sum("Bucketed: true" in x for x in lines) == 2
            # One shuffle and one sort: of the batch.
            assert sum(x.startswith("Exchange") for x in lines) == 1 and sum(x.startswith("Sort ") for x in lines) == 1
            assert plan.count() == 10
    tables, paths = runs.runs(), list(runs.paths.values())
    runs.close()
    from pathlib import Path

    assert not any(spark.catalog.tableExists(t) for t in tables) and not any(Path(p.removeprefix("file://")).exists() for p in paths)


def test_the_registered_line_dedup_compacts(spark, monkeypatch):
    seen, add = [], linededup.LineRuns.add
    monkeypatch.setattr(linededup.LineRuns, "add", lambda self, owners: (add(self, owners), seen.append([len(x) for x in self.levels]))[0])
    assert Q.op7_line_dedup(spark, SF).count() == Q.table(spark, SF, "documents").count()
    assert seen == [[1], [2], [0, 1], [1, 1]]


def brute_contamination(rows, items, window=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[k : k + window]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                got = wins.get(tuple(w[k : k + size]))
                if got:
                    hit |= set(range(k, k + size))
                    found |= got
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "shingle", "slice_bytes"), [(200_000, 3, 1 << 20), (50, 2, 64)])
def test_decontamination_matches_brute_force(spark, docs, monkeypatch, block, shingle, slice_bytes):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    bench = Q.table(spark, SF, "benchmark").unionByName(spark.createDataFrame([(900, "one two"), (901, "alpha beta"), (902, None), (None, "it's"), (903, "!!"), (904, "one two")], "item_id bigint, text string"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    if slice_bytes < 1 << 20:
        monkeypatch.setattr(decontam, "_SLICE", slice_bytes)
    for df in (docs, Q.table(spark, SF, "documents")):
        got = decontam.contamination(df, bench, shingle=shingle, block_records=block)
        assert rows_of(got, *cols) == brute_contamination([(r["doc_id"], r["text"]) for r in df.collect()], items)
    assert not decontam.contamination(docs, bench.limit(0)).filter("contaminated").count()
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_slices_keep_hits_across_cuts(monkeypatch):
    monkeypatch.setattr(decontam, "_SLICE", 30)
    records = {tuple(b"k%d" % k for k in range(10)): ["1"]}
    found = decontam.Records(records, 2, {})
    text = b" ".join(b"k%d" % (k % 10) for k in range(35))
    n, spans, items = found.scan(text)
    assert n == 35 and items == {"1"} and decontam._covered(spans) == 30


@pytest.mark.parametrize("broadcast", [True, False])
def test_warc_round_trip(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(warc, "_BROADCAST_BYTES", 0)
    rows = [(1, "http://a/", "same"), (2, "http://b/ c\n", "same"), (3, None, None), (4, "http://d/", ""), (5, "u", "é" * 9000), (5, "u", "é" * 9000), (None, "n", "same"), (9, "z", "\r\n\r\nContent-Length: 3\r\n\r\n")]
    rows = [(*r, b"clash") for r in rows]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha binary")
    got = warc.archive_round_trip(df).collect()
    assert all(r["digest_ok"] for r in got)
    want = [(1, 4, "response", None), (2, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 18000, "response", None), (5, 18000, "response", None), (None, 4, "revisit", 1), (9, 25, "response", None)]
    assert sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {r["payload_digest"] for r in got if r["page_id"] == 5} == {warc.payload_digest(("é" * 9000).encode())}
    few = warc.archive_round_trip(df, min_revisit_bytes=5).filter("record_type = 'revisit'")
    assert few.count() == 0
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_normaliser_reads_any_members(tmp_path):
    import io

    records = [warc.make_record(k, "u", b"p" * k * 1000, None, False, "D", "d") for k in range(6)]
    one = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = one.compress(b"".join(records[:3])) + one.flush()
    for r in records[3:]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        whole += z.compress(r) + z.flush()
    assert list(warc.inflate_records(io.BytesIO(whole))) == records
    with pytest.raises(ValueError):
        one = zlib.compressobj(6, zlib.DEFLATED, 31)
        list(warc.inflate_records(io.BytesIO(one.compress(records[2][:-50]) + one.flush())))


def test_min_cost_flow():
    flow = sharding.min_cost_flow([10, 0, 5], [4, 4, 4, 3], [[int(i != j) for j in range(4)] for i in range(3)])
    assert [sum(r) for r in flow] == [10, 0, 5] and sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j) == 7
    assert sharding.min_cost_flow([3, 3], [3, 3], [[5, 1], [1, 5]]) == [[0, 3], [3, 0]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([2], [1], [[0]])


def test_resharding(spark, docs):
    for df in (Q.table(spark, SF, "documents"), docs):
        got = sharding.documents_to_shards(df, new_shards=5, old_shards=3).toPandas()
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in texts)
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        sizes = got.groupby("shard")["size"].sum()
        assert sizes.max() - sizes.min() <= 4 * got["size"].max()
        old = got.assign(old=[zlib.crc32(str(i if i == i and i is not None else "null").removesuffix(".0").encode()) % 3 for i in got["doc_id"]])
        least = sum(max(0, s - got["size"].sum() / 5) for s in old.groupby("old")["size"].sum())
        assert got[got["moved"]]["size"].sum() <= least + 8 * got["size"].max()
    assert sharding.documents_to_shards(docs.limit(0)).count() == 0


def test_resharding_cuts_between_equal_rows(spark):
    rows = [(k, f"text {k}") for k in range(300)] + [(7, "the same row")] * 2000
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sharding.documents_to_shards(df, new_shards=16, old_shards=12).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    # A shard has at most one cut for each old shard that gives to it; a row a cut is the slack.
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 3 * got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_resharding_leaves_unaffected_shards(spark, tmp_path):
    from pathlib import Path

    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("x" * 6), F.lpad(F.col("id").cast("string"), 3, "0")).alias("text"), (F.col("id") % 3).cast("int").alias("at"))
    laid = sharding.layout(df, 3, "at")
    sharding.write_layout(laid, str(tmp_path / "old"), "__old", "__folder")
    old = spark.read.schema(laid.schema).parquet(str(tmp_path / "old"))
    plan = sharding.plan_transfers(old.select("__old", "__place", "__size"), 3, [1000, 1500, 500], 3)
    assert plan.moved_bytes == 500 and plan.affected(3, 3) == [1, 2]
    before = {f: f.stat().st_mtime_ns for f in Path(tmp_path / "old").rglob("*.parquet")}
    new = sharding.rewrite(old.withColumn("__shard", plan.shard_of("__old", "__place")), plan, str(tmp_path / "new"), 3, 3)
    assert {r["__shard"]: r["n"] for r in new.groupBy("__shard").agg(F.sum("__size").alias("n")).collect()} == {0: 1000, 1: 1500, 2: 500}
    # Only the files of shards 1 and 2 are new; those of shard 0 are read where they lie.
    assert sorted(x.name for x in (tmp_path / "new").iterdir() if x.is_dir()) == ["__folder=1", "__folder=2"]
    assert before == {f: f.stat().st_mtime_ns for f in Path(tmp_path / "old").rglob("*.parquet")}
    assert {Path(f).parent.name for f in new.filter("__shard = 0").inputFiles() if "/old/" in f} >= {"__folder=0"}
    assert rows_of(new, "doc_id", "text") == rows_of(df, "doc_id", "text")
    # The rows kept by a shard are those that the plan didn't move.
    moved = new.filter("__shard != __old").agg(F.sum("__size")).first()[0]
    assert moved == plan.moved_bytes


@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_round_trip(compression, tile, big):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 4, (37, 53), dtype=np.uint8), np.full((5, 300, 3), 7, np.uint8), rng.integers(0, 256, (64, 64, 4), dtype=np.uint8), np.repeat(rng.integers(0, 256, (90, 10), dtype=np.uint8), 9, axis=1)]
    got = list(tiff.read_pages(tiff.write_tiff(pages, compression, rows_per_strip=10, tile=tile, big_endian=big)))
    assert [p.samples for p in got] == [p.tobytes() for p in pages]
    assert [(p.width, p.height) for p in got] == [(p.shape[1], p.shape[0]) for p in pages]


def test_tiff_codecs_at_their_limits():
    rng = random.Random(1)
    for data in (b"", b"a", bytes(300), bytes(range(256)) * 40, bytes(rng.getrandbits(8) for _ in range(20000)), b"ab" * 9000):
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # PackBits example of the TIFF 6.0 text.
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_tiff_pages_and_text_media(spark, docs):
    media = spark.createDataFrame([(1, tiff.write_tiff([np.zeros((2, 2), np.uint8), np.ones((3, 1), np.uint8)])), (2, b"junk"), (3, None), (4, b"II*\0\x08\0\0\0\0\0\x08\0\0\0")], "doc_id int, media binary")
    assert [(r["doc_id"], r["page"], r["height"], r["error"] is None) for r in tiff.tiff_pages(media).orderBy("doc_id", "page").collect()] == [(1, 0, 2, True), (1, 1, 3, True), (2, None, None, False), (4, None, None, False)]
    got = rows_of(tiff.text_media(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for r in docs.collect():
        data = (r["text"] or "").encode()
        padded = data + b"\0" * (64 if not data else -len(data) % 64)
        want.append((r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert got == sorted(want, key=repr)


def brute_media(text):
    """Features of the padded bytes, counted one by one; the stored form only by its size and digest."""
    import json
    import math
    from collections import Counter

    data = (text or "").encode()
    padded = data + b"\0" * (64 if not data else -len(data) % 64)
    counts = Counter(padded)
    mean = sum(b * c for b, c in counts.items()) / len(padded)
    deviation = math.sqrt(max(0.0, sum(b * b * c for b, c in counts.items()) / len(padded) - mean * mean))
    entropy = -sum(c / len(padded) * math.log2(c / len(padded)) for c in counts.values())
    media = tiff.text_to_tiff(data)
    assert b"".join(p.samples for p in tiff.read_pages(media)) == padded
    return json.loads(json.dumps({"mean": mean, "deviation": deviation, "entropy": entropy, "levels": len(counts)})), len(media), hashlib.sha256(media).hexdigest()


def test_media_columns_match_brute_force(spark, docs):
    import json

    table = Q.table(spark, SF, "documents")
    long = spark.createDataFrame([(1, "y" * 70_000 * 64 + "end")], "doc_id bigint, text string")
    texts = [r["text"] for df in (docs, table, long) for r in df.collect()]
    assert {zlib.crc32((t or "").encode()) % len(tiff.WAYS) for t in texts} == set(range(len(tiff.WAYS)))
    for df in (docs, table, long):
        want = {r["text"]: brute_media(r["text"]) for r in df.collect()}
        for r in tiff.text_media(df).join(df.withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).dropDuplicates(["media_sha256", "text"]).collect():
            if (r["doc_id"], r["text"]) in {(x["doc_id"], x["text"]) for x in df.collect()} and hashlib.sha256(tiff.text_to_tiff((r["text"] or "").encode())).hexdigest() == r["media_sha256"]:
                features, size, digest = want[r["text"]]
                got = json.loads(r["feature"])
                assert (r["media_bytes"], r["media_sha256"]) == (size, digest) and got.keys() == features.keys()
                assert all(abs(got[k] - features[k]) < 1e-3 for k in got)
        assert sorted(r["media_sha256"] for r in tiff.text_media(df).collect()) == sorted(brute_media(r["text"])[2] for r in df.collect())
    assert tiff.text_media(docs.limit(0)).count() == 0


def test_malformed_tiffs_give_error_rows(spark):
    import struct

    page = np.arange(200, dtype=np.uint8).reshape(20, 10)

    def patched(data, tag, value):
        at = struct.unpack_from("<I", data, 4)[0]
        for k in range(struct.unpack_from("<H", data, at)[0]):
            spot = at + 2 + 12 * k
            if struct.unpack_from("<H", data, spot)[0] == tag:
                return data[: spot + 8] + struct.pack("<I", value) + data[spot + 12 :]
        raise KeyError(tag)

    strips, tiles = tiff.write_tiff([page], rows_per_strip=5), tiff.write_tiff([page], tile=(16, 16))
    bad = [patched(tiles, tiff.TILE_WIDTH, 0), patched(tiles, tiff.TILE_HEIGHT, 0), patched(strips, tiff.ROWS_PER_STRIP, 0), patched(strips, tiff.HEIGHT, 50), patched(strips, tiff.HEIGHT, 2**32 - 1),
           patched(strips, tiff.WIDTH, 2**32 - 1), patched(tiles, tiff.TILE_WIDTH, 2**31), patched(strips, tiff.STRIP_OFFSETS, 2**31), patched(tiles, tiff.TILE_COUNTS, 2), patched(strips, tiff.SAMPLES, 9)]
    bad.append(patched(tiff.write_tiff([np.zeros((4, 4, 3), np.uint8)]), tiff.PHOTOMETRIC, 2).replace(struct.pack("<HHI", 262, 3, 1), struct.pack("<HHI", 284, 3, 1)))
    got = tiff.tiff_pages(spark.createDataFrame(list(enumerate(bad)), "doc_id int, media binary")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(bad))) and all(r["error"] and r["samples"] is None for r in got)
    rng = random.Random(8)
    for _ in range(3000):
        data = bytearray(rng.choice([strips, tiles, tiff.write_tiff([page], "lzw"), tiff.write_tiff([page], "packbits")]))
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            assert all(len(p.samples) == p.width * p.height * p.samples_per_pixel for p in tiff.read_pages(bytes(data[: rng.choice([len(data), rng.randrange(len(data))])])))
        except ValueError:
            pass


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    y = np.array(labels) == 1
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / y.sum() / (~y).sum()


def compressed(content, level, min_match=0):
    """Plain zstandard: a function from bytes to the size of their frame."""
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == bytes.fromhex("37a430ec") else zstandard.DICT_TYPE_RAWCONTENT
    how = zstandard.ZstdCompressionParameters.from_level(level, source_size=512, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, **({"min_match": min_match} if min_match else {}))
    known = zstandard.ZstdCompressionDict(content, dict_type=kind)
    known.precompute_compress(compression_params=how)
    plain = zstandard.ZstdCompressor(compression_params=how, dict_data=known)
    return lambda data: len(plain.compress(data))


def letters(text):
    """Lower-case words of letters; other ASCII characters part them."""
    return re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())


def test_toxicity_matches_plain_zstandard(spark, docs):
    table = Q.table(spark, "/root/testdata/sf0.01", "documents")
    m = toxicity.fit(table, Q.table(spark, "/root/testdata/sf0.01", "labels"))
    assert 256 <= len(m.toxic) <= 1536 and len(m.ordinary) <= 98_304 and m.weights
    alone, both = compressed(m.ordinary + bytes(len(m.toxic)), m.level, m.min_match), compressed(m.ordinary + m.toxic, m.level, m.min_match)

    def brute(text):
        words = letters(text)
        saved = [alone(w) - both(w) for w in (b" " + b" ".join(words[k : k + m.window_words]) + b" " for k in range(0, len(words), m.window_words))]
        count, strong = sum(s >= m.least_saving for s in saved), sum(s >= min(m.least_saving + 2, 8) for s in saved)
        z = m.weights[0] + m.weights[1] * np.sqrt(count / max(1, len(saved))) + m.weights[2] * min(np.log1p(count), 4.0) + m.weights[3] * min(np.log1p(strong), 4.0)
        return float(1 / (1 + np.exp(-z)))

    for df in (docs, Q.table(spark, SF, "documents").filter("char_length(text) < 4000")):
        got = {(r["doc_id"], round(r["score"], 9), r["predicted"]) for r in toxicity.score(df, m).collect()}
        assert got == {(r["doc_id"], round(brute(r["text"]), 9), int(brute(r["text"]) >= 0.5)) for r in df.collect()}


def test_toxicity_learns_what_recurs(spark):
    rng = random.Random(4)
    plain = "river stone meadow cloud window paper candle silver garden winter".split()
    rows = [(k, " ".join(["grumbleface" if k % 4 == 0 and j % 9 == 4 else rng.choice(plain) for j in range(60)]), int(k % 4 == 0), "clash", None) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, score string, __text string")
    m = toxicity.fit(df.filter("doc_id < 300"))
    assert b"grumbleface" in m.toxic and b"meadow" not in m.toxic
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, m).collect()}
    assert got == {k: y for k, _, y, _, _ in rows}
    parts = toxicity.score(df.repartition(7), toxicity.fit(df.filter("doc_id < 300").repartition(5)))
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in toxicity.score(df, m).collect()}


def test_cuts_and_curves():
    y = np.array([True, True, False, False, True])
    assert toxicity.area_under_curve(np.array([3.0, 1.0, 1.0, 0.0, 2.0]), y) == (2 + 1.5 + 2) / 6
    cut = toxicity.best_cut(np.array([3.0, 1.0, 1.0, 0.0, 2.0]), y, np.ones(5))
    assert cut == 0.5
    assert langid.wrong_below([(0.1, False), (0.2, False), (0.3, True), (0.4, False), (5.0, True)]) == 0.3
    assert langid.wrong_below([(0.1, True), (3.0, False)]) == 0.0 and langid.wrong_below([]) == 0.0
    assert langid.wrong_below([(0.0, False), (0.0, True), (0.0, False), (2.0, True)]) == 2.0


def test_languages_match_plain_zstandard(spark, docs):
    m = Q.language_model(Q.table(spark, "/root/testdata/sf0.01", "documents"))
    known = [(lang, compressed(d, m.level), d[len(d) // 2 :][:64]) for lang, d in m.dictionaries]

    def brute(text):
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        data, totals = b" ".join(letters(text)), []
        for lang, size, lead in known:
            totals.append((sum(size(lead + b" " + data[k : k + m.window]) - size(lead) for k in range(0, len(data), m.window)), lang))
        totals.sort()
        return totals[0][1], round(100.0 * (totals[1][0] - totals[0][0]) / max(1, totals[0][0]), 9)

    for df in (docs, Q.table(spark, SF, "documents").filter("char_length(text) < 2000")):
        got = {(r["doc_id"], r["lang_pred"], round(r["margin"], 9)) for r in langid.identify(df, m).collect()}
        assert got == {(r["doc_id"], *brute(r["text"])) for r in df.collect()}


def test_language_and_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = Q.table(spark, sf, "documents").withColumn("n_words", F.size(F.split(F.trim("text"), r"\s+")))
    found = Q.op10_language(spark, sf)
    held = found.filter("held_out").join(docs.select("doc_id", "lang", "n_words"), "doc_id").filter("lang IS NOT NULL").toPandas()
    right = held["lang"] == held["lang_pred"]
    assert right.mean() > 0.99 and held["score"].between(0, 1).all()
    short = held["n_words"] < 8
    assert short.sum() > 10 and right[short].mean() >= 0.9
    tox = Q.op5_toxicity(spark, sf).filter("held_out").join(Q.table(spark, sf, "labels"), "doc_id").toPandas()
    # This small table has a few hundred toxic texts to learn from, in four languages.
    assert auc(tox["score"], tox["toxic"]) > 0.92 and tox["score"].between(0, 1).all()
    assert ((tox["predicted"] == 1) & (tox["toxic"] == 1)).sum() > 0.8 * (tox["toxic"] == 1).sum()
    assert ((tox["predicted"] == 1) & (tox["toxic"] == 0)).sum() < 0.1 * (tox["toxic"] == 0).sum()


def test_classifiers_on_odd_rows(spark, docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model, min_margin=0.1, keep=["ids", "text"]).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (0, 1, 2, 3))
    assert got[4]["lang_pred"] in ("en", "de") and got[6]["text"] == odd_texts()[6]
    none = langid.identify(docs, langid.fit(docs.filter("lang = 'xx'")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    labelled = docs.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    assert toxicity.score(docs, toxicity.fit(labelled)).filter("score BETWEEN 0 AND 1").count() == docs.count()
    one = toxicity.fit(labelled.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {0.0}
    assert langid.identify(docs.limit(0), model).count() == 0 and toxicity.score(docs.limit(0), one).count() == 0


def test_toxicity_fit_with_repeated_ids(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    some = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, some() + (" vile brute scum" if i < 9 else ""), int(i < 9)) for i in range(200)]
    # One id stands in the table 5,000 times, in the labels too.
    for repeated in (3, 150):
        many = [r for r in rows if r[0] != repeated] + [(repeated, f"{rows[repeated][1]} {k % 7}", rows[repeated][2]) for k in range(5000)]
        df = spark.createDataFrame(many, "doc_id bigint, text string, toxic int")
        drawn = []
        monkeypatch.setattr(toxicity, "trained", lambda parts, *a: drawn.append(parts) or b"x" * 300)
        model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), max_toxic=5, max_ordinary=20)
        assert model.weights and model.prior == pytest.approx(9 / 200)
        # Windows of at most 20 ordinary excerpts, and at most 5 toxic ones.
        assert max(map(len, drawn)) <= 20 * 10
