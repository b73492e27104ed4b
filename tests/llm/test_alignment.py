"""Cross-tokenizer alignment: against a plain version that looks at every pair of tokens, and bitmaps and counts by themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from millrace.llm import alignment

from .brute import frame, sample  # isort: skip

ODD = [
    (900, "<|endoftext|> and <s> </s> <unk> <0x41> ▁x"), (901, "tab\tline\n\n  two  spaces \n end "), (902, " leading"), (903, "ﬁne ½ ÅÅ é́ 日本語 🙂 𝒳"), (904, " "), (905, "\n"),
    (906, "don't can't we'll 12345 ---- ...!?"), (907, "a b c\x1cd\x85e"), (908, "x" * 4000), (909, "﻿bom ​ zero"), (910, "e\u0000f"),
]


def encodings(rows):
    """Ids and bytes of every text, by the libraries the vocabularies are made for."""
    import sentencepiece
    from tokenizers import Tokenizer

    import public_tokenizers

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = alignment.byte_chars()
    assert len(chars) == 256 and sorted(chars.values()) == list(range(256))
    for n, (doc_id, text) in enumerate(rows):
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text)
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        same = text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()
        yield (n, doc_id), list(zip(ids_a, bytes_a, strict=True)) if same else [], list(zip(ids_b, bytes_b, strict=True)) if same else []


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(rows):
    links, shape = {}, {}
    for key, a, b in encodings(rows):
        a, b = spans(a), spans(b)
        links[key] = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        text, start = [], 0
        for end in common:
            text.append(",".join(str(i) for i, s, e in a if start <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in b if start <= s and e <= end))
            start = end
        shape[key] = (len(a), len(b), len(common), ";".join(text))
    docs, total = Counter(p for x in links.values() for p in set(x)), Counter(p for x in links.values() for p in x)
    top = defaultdict(int)
    for (i, _), n in docs.items():
        top[i] = max(top[i], n)
    out = []
    for key, x in links.items():
        n_a, n_b, n_groups, text = shape[key]
        out.append((key[1], n_a, n_b, n_groups, len(x), sum(docs[p] == top[p[0]] for p in x), sum(docs[p] for p in x), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return out, {p: (n, total[p], n == top[p[0]]) for p, n in docs.items()}


@pytest.fixture(scope="module")
def rows():
    return [r for r in sample(11, 24) if len(r[1] or "") < 3500] + ODD + [(5, "a repeated row"), (5, "a repeated row"), (None, "no id")]


def test_alignment_is_that_of_all_pairs(spark, rows):
    want, pairs = plain(rows)
    assert sum(not r[1] for r in want) >= 3 and sum(r[1] > 0 for r in want) > 30
    docs, found = alignment.align(frame(spark, rows).repartition(3), chunk_docs=64, with_groups=True)
    order = lambda x: sorted(x, key=repr)
    assert order(tuple(r) for r in docs.collect()) == order(want)
    assert {(r["a"], r["b"]): (r["docs"], r["links"], r["best"]) for r in found.collect()} == pairs
    # small chunks change nothing
    docs, _ = alignment.align(frame(spark, rows).repartition(1), chunk_docs=64, chunk_postings=50)
    assert order(tuple(r)[:-1] for r in docs.collect()) == order(r[:-1] for r in want)


def test_all_characters(spark):
    """Every character whose bytes both tokenizers give back is linked, alone and between others."""
    rng = random.Random(2)
    chars = [chr(c) for c in [*range(1, 0x250), *rng.sample(range(0x250, 0xD800), 300), *rng.sample(range(0xE000, 0x20000), 200)]]
    rows = [(i, f"{c}") for i, c in enumerate(chars)] + [(10_000 + i, f"a{c} b {c}d  {c}") for i, c in enumerate(chars)]
    want = {r[0]: r[:5] + (r[7],) for r in plain(rows)[0]}
    docs, _ = alignment.align(frame(spark, rows))
    assert {r["doc_id"]: (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in docs.collect()} == want


def test_bitmaps():
    rng = np.random.default_rng(3)
    for size in (1, 7, 64, 5000, 65_536):
        for share in (0.0005, 0.05, 0.6, 1.0):
            numbers = np.flatnonzero(rng.random(size) < share)
            if len(numbers):
                links = rng.integers(1, 9, len(numbers))
                planes = alignment.planes_of(numbers, links, size)
                assert alignment.merged(planes, size).tolist() == numbers.tolist()
                assert sum(alignment.bits_of(p, size).astype(int) << k for k, p in enumerate(planes))[numbers].tolist() == links.tolist()
                assert all(len(p) <= 1 + min(2 * len(numbers), -(-size // 8)) for p in planes)


def test_empty_tables_and_texts(spark):
    docs, pairs = alignment.align(frame(spark, [(1, "a")]).limit(0))
    assert docs.count() == 0 and pairs.count() == 0 and docs.columns[0] == "doc_id"
    docs, pairs = alignment.align(frame(spark, [(1, None), (2, "")]))
    assert [tuple(r) for r in docs.orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "", None) for i in (1, 2)] and pairs.count() == 0
