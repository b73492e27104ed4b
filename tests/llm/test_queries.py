"""The registered queries themselves, over small tables, against plain versions of their contracts."""

import hashlib
import html as entities
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from millrace.llm import privacy, quality, toxicity
from millrace.llm.registry import QUERIES
from pyspark.sql import functions as F

from .brute import base_spans, frame, near_duplicates, sample, words  # isort: skip
from .brute import quality as plain_quality  # isort: skip

PRIVATE = ["mail a.b@mail.example.com now", "from 10.0.0.255 and 300.1.1.1", "card 4111 1111 1111 1111 ok", "call +1 (414) 555-7134.", 'token = "' + "0a1b2c3d4e" * 4 + '" end']


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [(i, t) for i, t in sample(31, 40)]
    out += [(2000 + i, f"We said {rng.choice(PRIVATE)} and went on {rng.random()}, as ever, to the end of it.") for i in range(60)]
    out += [(3000, " ".join(rng.choice(PRIVATE) for _ in range(3000))), (3001, "4111 1111 " * 3000), (3002, "Home | News | About | Contact\nThis is a good line of text, with words.\nAnother good line follows, and it ends.")]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Tables with columns whose names operators use inside, and one folder of empty tables."""
    root = tmp_path_factory.mktemp("tables")
    docs = frame(spark, rows).withColumns({c: F.lit("c") for c in ("_h", "_n", "_row", "_map", "_piece", "_hit", "found", "spans", "base", "has_digit")})
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    pages = [(i, f"http://h{i % 3}.example/{i}", f"<body><ul><li><a href=x>m{i}</a></li></ul><article><h1>T{i}</h1><p>a &amp; b {i}<p>c{i}</article><div class=z>tail {i}</div></body>") for i in range(12)]
    spark.createDataFrame([*pages, (50, None, None), (51, "", "")], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root)


def collected(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def test_packing_query(spark, folder, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    found = collected(spark, folder, "op1_packing")
    at, sequences = dict.fromkeys(ids, 0), {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(at[i] == len(x) for i, x in ids.items())
    padding = 0
    for held in sequences.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding < 0.05 * sum(at.values())


def test_html_query(spark, folder):
    found = {r["page_id"]: r for r in collected(spark, folder, "op2_html")}
    assert len(found) == 14 and all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert all(found[i]["text"] == entities.unescape(f"T{i}\na &amp; b {i}\nc{i}") for i in range(12)) and found[50]["text"] == found[51]["text"] == ""


def test_privacy_query(spark, folder, rows):
    text = dict(rows)
    found = collected(spark, folder, "op5_privacy")
    assert sorted(r["doc_id"] for r in found) == sorted(text)
    for r in found:
        base = base_spans(text[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in privacy.BASE] == [sum(x[0] == k for x in base) for k in privacy.BASE]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and (r["spans"] == line or r["spans"].startswith(line + "," if line else ""))
        added = r["spans"][len(line) :].strip(",")
        assert r["n_added"] == (len(added.split(",")) if added else 0) and r["n_spans"] == len(base) + r["n_added"]
    hexed = [i for i, t in rows if 2000 <= i < 2060 and "token" in t]
    of = {r["doc_id"]: r["spans"] for r in found}
    assert hexed and all(f"secret:{text[i].index('0a1b')}:{text[i].index('0a1b') + 40}" in of[i] for i in hexed)
    assert all(r["n_added"] == 0 for r in found if 2000 <= r["doc_id"] < 2060 and r["doc_id"] not in hexed)


def test_privacy_choices_are_the_trees(spark, rows):
    """No span beyond the base ones is taken for its context alone: without reachable thresholds there are none."""
    found = privacy.stored(privacy.candidates(frame(spark, rows)), "t")
    judge = privacy.fit(found, rounds=4)
    size = F.size(privacy.chosen(judge)) - F.size("base")
    assert found.agg(F.sum(size)).first()[0] > 0
    none = privacy.Judge(judge.trees, dict.fromkeys(privacy.LOOSE, float("inf")))
    high = privacy.Judge(judge.trees, dict.fromkeys(privacy.LOOSE, 99.0))
    assert all(found.agg(F.sum(F.size(privacy.chosen(j)) - F.size("base"))).first()[0] == 0 for j in (none, high))


def test_privacy_is_linear_in_matches(spark):
    import time

    def seconds(n):
        text = " ".join(random.Random(n).choice(PRIVATE) for _ in range(n))
        began = time.perf_counter()
        f = privacy.stored(privacy.candidates(frame(spark, [(1, text)]), ("text",)), "t")
        assert f.select(F.size("base")).first()[0] == len(base_spans(text))
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16000) < 12 * max(seconds(4000), 1.0)


def test_toxicity_query(spark, folder, rows):
    """Each score is one less the product over sentences, whatever the order they're read in."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    text = dict(rows)
    found = collected(spark, folder, "op7_toxicity")
    assert sorted(r["doc_id"] for r in found) == sorted(text)
    for r in found:
        none = 1 - model.leak
        for s in re.findall(r"[^.!?\n]+", (text[r["doc_id"]] or "").lower()):
            held = {f for w in re.findall(r"[^\W\d_]+", s) for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)] if f in model.weights}
            if held:
                none *= 1 - 1 / (1 + np.exp(-np.clip(model.bias + sum(model.weights[f] for f in held), -30, 30)))
        assert abs(r["score"] - (1 - none)) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def verdict(text):
    """Which lines stay, and whether the document does: the rules, line by line, on characters."""
    lines, stay = (text or "").split("\n"), []
    for line in lines:
        n = len(words(line))
        bars = sum(c in "|»›·•→" for c in line)
        symbols = len(re.findall(r"[#*$%&<>]{2,}", line))
        shouts = len(re.findall(r"!!+(?=\s|$)", line))
        bad = n and (bars >= 3 and bars >= 0.2 * n or symbols > 0.3 * n or shouts > 0.3 * n and n > 3 or n >= 6 and not any(c in ".!?…:;。！？" for c in line))
        stay.append(not bad and not (n and n <= 25 and quality._BOILERPLATE.search(line)))
    solid = lambda x: sum(map(len, words(x)))
    kept = sum(solid(x) for x, s in zip(lines, stay, strict=True) if s)
    return not plain_quality(text)[5] and solid(text) - kept <= 0.5 * solid(text), "\n".join(x for x, s in zip(lines, stay, strict=True) if s)


def test_quality_query_and_stages(spark, folder, rows):
    text = dict(rows)
    found = collected(spark, folder, "op10_quality")
    assert sorted(r["doc_id"] for r in found) == sorted(text)
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(text[r["doc_id"]])
        assert r["kept"] == verdict(text[r["doc_id"]])[0]
    docs, stage = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, folder)
    assert good.columns == docs.columns and {r["doc_id"]: r["text"] for r in good.collect()} == {i: v[1] for i, t in rows if (v := verdict(t))[0]}
    kept = stage["near_duplicates"](spark, docs, folder)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in near_duplicates(rows, 5).items() if i == c}
    safe = {r["doc_id"]: r for r in stage["privacy"](spark, docs, folder).collect()}
    for r in collected(spark, folder, "op5_privacy"):
        spans, out, at = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)), "", 0
        whole = text[r["doc_id"]]
        for a, b, k in spans:
            if a >= at:
                out += whole[at:a] + f"[{k.upper()}]"
            at = max(at, -b)
        assert safe[r["doc_id"]]["text"] == (out + whole[at:] if spans else whole) and safe[r["doc_id"]]["found"] == "c"
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in collected(spark, folder, "op9_mixing") if r["size"]}
    mixed = stage["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and {r["doc_id"]: r["count"] for r in mixed.filter(F.col("doc_id").isin(list(copies))).groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    pieces = stage["packing"](spark, docs, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == len(text) and all(r["n"] == r["t"] for r in pieces)
