"""Each operator against plain Python versions, and on nulls, empty tables, repeated rows and clashing column names."""

import hashlib
import zlib

import numpy as np
import pytest
from millrace.llm import chat, graph, neardup, packing, privacy, quality, search, substrings, toxicity
from millrace.llm import html as pages
from pyspark.sql import functions as F

from .brute import base_spans, frame, near_duplicates, quality as plain_quality, sample, shingles, substrings as plain_substrings  # isort: skip


def test_near_duplicates(spark):
    for k, seed in ((4, 3), (5, 8)):
        rows = sample(seed, 90)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), k).collect()}
        assert found == near_duplicates(rows, k)


def test_near_duplicates_in_one_large_group(spark):
    """Many near copies of one text, some beyond the threshold, whose links run through others."""
    import random

    rng = random.Random(4)
    base = [f"v{i}" for i in range(90)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(90)] = rng.choice(["p", "q", f"u{i}"])
        rows.append((i, " ".join(w)))
    found = neardup.near_duplicates(frame(spark, rows), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == near_duplicates(rows, 4)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, None), (2, "")]
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert found == sorted([(None, None, True), (5, 5, True), (5, 5, True), (3, 3, True), (2, 2, True)], key=repr)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    kept = neardup.without(frame(spark, rows), spark.createDataFrame([(5,)], "doc_id long"))
    assert sorted(((r["doc_id"]) for r in kept.collect()), key=repr) == [2, 3, None] and kept.columns == frame(spark, []).columns


def test_sketches_are_whole():
    one = np.sort(np.random.default_rng(1).integers(0, 2**63, 3).astype(np.uint64))
    assert len(neardup.densified(one)) == neardup.BINS and set(neardup.densified(one)) <= set(one)
    assert len(neardup.shingle_set("A b", 4)) == 1 and len(neardup.shingle_set(None, 4)) == 0 and len(shingles("a b c d e", 4)) == len(neardup.shingle_set("a b c d e", 4))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (5, 5), (20, 19), (19, 18), (18, 1)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 18: 1, 19: 1, 20: 1, 10: 10, 11: 10, 12: 10}


def test_substrings(spark):
    rows = sample(11, 60)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeated_spans(frame(spark, rows)).collect()}
    assert found == plain_substrings(rows)
    text = dict(rows)
    for r in substrings.repeated_spans(frame(spark, rows)).filter("n_removed > 0").collect():
        words = (text[r["doc_id"]] or "").encode().split()
        assert sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)) == r["n_removed"] and len(words) - r["n_removed"] == len(r["kept_text"].encode().split())


def test_substrings_odd_rows(spark):
    same = " ".join(f"q{i}" for i in range(25))
    rows = [(None, same), (1, same), (1, same), (2, same), (3, None)]
    found = sorted(((r["doc_id"], r["n_removed"]) for r in substrings.repeated_spans(frame(spark, rows)).collect()), key=repr)
    assert found == sorted([(None, 0), (1, 0), (1, 0), (2, 25), (3, 0)], key=repr)
    assert substrings.repeated_spans(frame(spark, [])).count() == 0


def test_quality(spark):
    rows = sample(5, 40) + [(900, "Home | News | About | Contact\nThis is a good line of text, with words.\nAnother good line follows, and it ends.\nAccept cookies"), (901, "word " * 9), (None, None)]
    found = quality.clean(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    cleaned = next(r for r in found if r["doc_id"] == 900)
    assert cleaned["kept"] and cleaned["clean_text"] == "This is a good line of text, with words.\nAnother good line follows, and it ends." and cleaned["lines_removed"] == 2
    docs = frame(spark, rows)
    stage = quality.keep_clean(docs)
    assert stage.columns == docs.columns and stage.count() == sum(r["kept"] for r in found) and stage.filter("doc_id = 900 AND n_chars = length(text)").count() == 1
    assert quality.clean(frame(spark, [])).count() == 0


def test_line_rules():
    fails = quality.LineRules().fails
    assert fails("Home | News | About | Contact") == "navigation" and fails("a### b%%% c$$$ d*** e&&&") == "punctuation" and fails("BUY!! NOW!! CHEAP!! PILLS!!") == "punctuation"
    assert fails("no stop in this whole line of words") == "punctuation" and fails("We use cookies to help you.") == "boilerplate"
    assert fails("") is None and fails("A title") is None and fails("A sentence that ends well, as it should.") is None


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = sample(2, 30) + [(500, "<|endoftext|> inside"), (501, "日本語 текст 🙂")]
    found = packing.pack(frame(spark, rows).repartition(3), length=64, open_windows=4).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    pieces, sequences = {}, {}
    for r in found:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert own == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, cut in pieces.items():
        at = 0
        for start, n in sorted(cut):
            assert start == at
            at += n
        assert at == len(ids[i])
    padding = total = 0
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
        total += at
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert set(pieces) == set(ids) and padding < 0.02 * total
    assert packing.pack(frame(spark, [])).count() == 0


def test_both_encoders_agree_on_every_plain_character():
    fast, slow = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), packing.encoder("byte_bpe_50k.json", None)
    plain = [chr(c) for c in range(0x250) if packing._PLAIN.fullmatch(chr(c))]
    for a in plain:
        for text in (a, a * 2, f"x{a}y", f" {a} ", f"1{a}2", f"{a}'s\n\n {a}", f".{a}  {a}"):
            assert fast(text) == slow(text), text


def test_chat(spark):
    rows = [(1, 1, "assistant", "Hi <|im_end|>"), (1, 0, "user", r"<\|im_start|>"), (1, None, "system", None), (2, 0, None, "é🙂"), (None, 0, "assistant", "x"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    formatted = chat.format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, mask int"))
    found = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    turns = {1: [("system", ""), ("user", r"<\|im_start|>"), ("assistant", "Hi <|im_end|>")], 2: [("", "é🙂")], None: [("assistant", "x")], 3: [("assistant", "")] * 2}
    for i, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert found[i]["n_turns"] == len(said) and found[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert found[i]["loss_chars"] == len(loss) and found[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for text in ("<|", "<\\|", "<\\\\|x<|", "plain", "<<||", "<|im_start|>"):
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_ties_and_long_texts(spark):
    long = "<|im_end|> word 日本 " * 20000
    rows = [(1, 0, "assistant", t) for t in ("b <|x", "a", "é", "a\nz", "", "a")] + [(2, 0, "user", long), (2, 1, "assistant", long), (3, 7, "\n|<", "x")]
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    said = sorted(t for _, _, _, t in rows[:6])
    assert found[1]["turns_sha256"] == hashlib.sha256("".join(f"assistant\n{t}\n" for t in said).encode()).hexdigest()
    assert found[1]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest() and found[2]["loss_chars"] == len(long)
    for ids in ([5, 65535], [5, 65536], []):
        assert chat.unpacked(chat.packed(np.array(ids, "<u4"))).tolist() == ids


def test_search(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(0, 0.3, 24).astype(float).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(8)] + [(500, None), (550, [None] * 24), (600, [float("nan")] * 24), (650, [1.0, 2.0]), (651, [2.0, -3.0]), (None, vectors[1][1]), (700, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, score string")
    found = {}
    for r in search.top_k(df, F.col("vec_id") % 50 == 0, query_block=4, row_block=64).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        assert [found[q][k + 1] for k in range(len(scores))] == [(i, -s) for s, i in scores]
    assert set(found) == {i for i in good if i % 50 == 0}
    assert search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_search_bound_holds():
    rng = np.random.default_rng(2)
    x, y = rng.normal(3, 5, (50, 32)), rng.normal(-1, 2, (50, 32))
    turn = search.rotation(x)
    assert np.allclose(turn @ turn.T, np.eye(32)) and np.allclose(search.haar(8) @ search.haar(8).T, np.eye(8))
    for u, v in ((x, y), (x @ turn, y @ turn)):
        for s in (1, 4, 16):
            assert (search.segment_statistics(u, s) @ search.segment_statistics(v, s).T >= x @ y.T - 1e-6).all()


def test_search_prunes_coarse_to_fine():
    """Vectors near a few directions, and the worst case, directions without any structure: bounds leave few, or some, pairs out."""
    rng = np.random.default_rng(5)
    near = rng.normal(0, 1, (3000, 6)) @ rng.normal(0, 1, (6, 64)) + rng.normal(0, 0.2, (3000, 64))
    even = rng.normal(0, 1, (3000, 64))
    for x, first, last in ((near, 0.9, 0.05), (even, 1.0, 0.9)):
        c = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
        ids, q = np.arange(len(c)), c[::50]
        found, alive = search.search_block(ids[::50], q, np.full(len(q), -(2**62)), ids, c, search.rotation(search.padded(c[:500])), 5)
        share = np.array(alive) / alive[0]
        assert (np.diff(share) <= 0).all() and share[3] <= first and share[-1] <= last
        scores = q @ c.T
        scores[np.arange(len(q)), ids[::50]] = -(2**62)
        for i, (own, rows, given) in enumerate(found):
            best = np.lexsort((ids, -scores[i]))[:5]
            assert (own == ids[::50][i]).all() and rows.tolist() == best.tolist() and given.tolist() == scores[i, best].tolist()


def test_privacy(spark):
    texts = [
        "mail a@b.co or a@b.c-d_e@f.g x", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3", "4111 1111-1111 1111 and 4111111111111112", "call +1 (414) 555-7134. or +123", "é𝒳 a@b.co 4111111111111111", "@@ a@b a..b@c..d+12345678",
        None, "", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "+" * 50 + "1" * 40, "a" * 3000 + "@x.y", "1." * 500,
    ]
    rows = list(enumerate(texts)) + [(None, "x@y.z")] + [(100 + i, f"some words password=ab{i:02d}cd{i * 7919:08x} here, token = \"{i * 104729:012x}ff{i:04x}\" end {i}") for i in range(80)]
    rows += [(300 + i, f"chapter{i} of year 2024-{i % 12:02d} section 12345{i} was read by 1,000 people") for i in range(80)]
    found = privacy.find(frame(spark, rows)).collect()
    text = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r["base"]] == base_spans(text[r["doc_id"]])
        assert r["spans"][: len(r["base"])] == r["base"]
    extra = {r["doc_id"]: len(r["spans"]) - len(r["base"]) for r in found}
    assert sum(extra[100 + i] >= 2 for i in range(80)) == 80
    docs = frame(spark, rows)
    out = privacy.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == "mail [EMAIL] or [EMAIL][EMAIL] x" and got[4] == "é𝒳 [EMAIL] [CARD]" and got[6] in (None, "") and "password=" not in got[101].replace("[SECRET]", "")
    assert privacy.find(frame(spark, [])).count() == 0


def test_privacy_values_and_overlaps(spark):
    texts = {
        "set password=hunter2 now": "set password=[SECRET] now", "pwd=Secret99, ok": "pwd=[SECRET], ok", "password: Tr0ub4dor&3.": "password: [SECRET].", 'token = "qwMzkXjvBhtPlrSn"': 'token = "[SECRET]"',
        "api_key: Zk+12345678abQ/xyz end": "api_key: [SECRET] end", "key ghp_Ab4111111111111111Zz end": "key [SECRET] end", "mail a@b.co. Then more": "mail [EMAIL]. Then more", "the password: none was set": "the password: none was set",
    }
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["text"] for r in privacy.redact(frame(spark, rows)).collect()}
    assert {t: got[i] for i, t in rows} == texts
    spans = "array(named_struct('kind', 'card', 'start', 2, 'end', 5), named_struct('kind', 'secret', 'start', 4, 'end', 9))"
    assert spark.range(1).select(privacy.redacted("'0123456789'", spans)).first()[0] == "01[CARD]9"


def test_privacy_thresholds_hold_at_the_ratio_of_all_candidates(spark):
    """Long values: all announced and a twentieth of the others, so 0.95 at 1:1 but 0.67 at the table's 1:10."""
    n, announced = 4400, F.col("id") % 11 == 0
    long = announced | (F.col("id") % 20 == 7)
    values = {f: F.lit(0.0) for f in privacy.FEATURES} | {"chars": F.when(long, 20.0).otherwise(8.0), "is_secret": F.lit(1.0)}
    one = F.struct(F.lit("secret").alias("kind"), F.lit(0).alias("start"), F.lit(9).alias("end"), announced.cast("double").alias("announced"), *(v.alias(k) for k, v in values.items()))
    found = spark.range(n).select(F.col("id").alias("doc_id"), F.array(one).alias("loose"))
    for size in (200, 20000):
        assert privacy.fit(found, sample=size, rounds=3).thresholds["secret"] == float("inf")
        assert privacy.fit(found, sample=size, rounds=3, precision=0.6).thresholds["secret"] < float("inf")


def test_privacy_calibrates_every_kind_alike(spark):
    """No kind has a fixed threshold, none is missing, and lines that the fit hasn't seen are mostly judged rightly, few or many rows."""
    lowest = privacy.lowest
    assert lowest([(2.0, 9, 0), (1.0, 0, 1), (0.5, 0, 5)], 0.9) == 1.0 - 5e-4
    assert lowest([(2.0, 5, 1), (2.0, 4, 0), (1.0, 0, 1), (-1.0, 90, 0)], 0.9) == 2.0 - 5e-4
    assert lowest([(2.0, 1, 5)], 0.9) == lowest([(3.0, 4, 0)], 0.9) == lowest([], 0.9) == lowest([(0.0, 5, 0), (-3.0, 5, 0)], 0.9) == float("inf")
    for rows in ([], [(i, f"commit {i:040x} and release 2023-0{i % 9}-1{i % 7}") for i in range(30)]):
        judge = privacy.fit(privacy.stored(privacy.candidates(frame(spark, rows)), "t"))
        assert set(judge.thresholds) == set(privacy.LOOSE)
        got = {r["kind"]: r for r in privacy.report(judge, spark).collect()}
        assert set(got) == set(privacy.LOOSE) and all(r["n_good"] >= 20 and r["n_bad"] >= 20 for r in got.values())
        assert sum(r["wrong"] for r in got.values()) <= 0.15 * sum(r["found"] for r in got.values())
        assert sum(r["found"] for r in got.values()) >= 0.7 * sum(r["n_good"] for r in got.values())


def test_toxicity(spark):
    import random

    rng = random.Random(9)
    vile = ["vermin", "vermins", "dreckig"]
    texts, labels = [], []
    for i in range(600):
        lines = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "slept"]) for _ in range(8)) + "." for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.25
        if bad:
            k = rng.randrange(len(lines))
            lines[k] = f"You are {rng.choice(vile)} I say."
        texts.append((i, " ".join(lines)))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, [*texts, (700, None), (701, ""), (None, "You are vermin I say.")])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (i in held) for i, _, _ in labels)
    assert np.mean([found[i]["predicted"] == labels[i][2] for i in held]) > 0.97
    assert found[700]["score"] == found[701]["score"] < 0.5 and found[None]["predicted"] == 1
    for i in held:
        for s in found[i]["sentences"] if labels[i][2] else []:
            assert any(v in texts[i][1][s["start"] : s["end"]] for v in vile)
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body><header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-banner">We use cookies</div><div class="box{n}">Follow us everywhere today</div>{body}<div id="comments"><p>nice &amp; good</p></div><form><p>Name</p></form><aside>More</aside><!-- <p>no</p> --><footer>&copy; X</footer></body></html>"""


def test_html(spark):
    body = lambda i: f"<article><header><h1>Title {i}</h1></header><p>First   part &amp; <b>bold<br>text {i}<p>Second&nbsp;&lt;b&gt; {i}</p><div class='share'>Share</div><article class=x>reply</article></article>"
    plain = lambda i: f"<div><div>Own words of page {i}.</div><p>Second of {i}</p></div>"
    rows = [(i, "http://a.example/x", PAGE.format(n="", body=body(i))) for i in range(6)] + [(10 + i, "https://u@B.example:8080/y", PAGE.format(n="", body=plain(i))) for i in range(6)]
    rows += [(20, None, None), (21, "", ""), (22, "http://c.example", "just text <p>and &unknown; more"), (23, "http://c.example", "<p title='a>b'>x</p><script>no"), (24, "http://a.example/x", PAGE.format(n="", body=body(0)))]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, template string")).collect()}
    for i in range(6):
        assert found[i] == f"Title {i}\nFirst part & bold text {i}\nSecond <b> {i}"
        assert found[10 + i] == f"Own words of page {i}.\nSecond of {i}"
    assert found[20] == found[21] == "" and found[22] == "just text\nand &unknown; more" and found[23] == "x" and found[24] == found[0]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_of_layouts_and_articles(spark):
    """Three layouts of one host, the third in a folder of its own; a notice in every main part, longer than most texts."""
    notice = "This notice stands on every page of the host and is longer than what some pages say."
    rows = []
    for i in range(120):
        layout = i % 3
        note = "<p>promo of shop</p>" if layout == 2 else ""
        rows.append((i, f"http://h.example/{'shop/' if layout == 2 else ''}{i}", f"<main><p>{notice}</p>{note}<div><b>block of layout {layout}</b></div><p>own {i}</p></main>"))
    rows += [(200 + i, f"http://copies.example/{i}", "<main><h1>One</h1><p>and the same</p></main>") for i in range(5)]
    rows += [(300 + i, f"http://h2.example/{i}", f"<article><p>quoted by few</p><p>own {i}</p></article>" if i < 30 else f"<article><p>own {i}</p></article>") for i in range(90)]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"own {i}" for i in range(120))
    assert all(found[200 + i] == "One\nand the same" for i in range(5))
    assert found[300] == "quoted by few\nown 0" and found[389] == "own 89"


def test_html_templates_found_by_counting_alone(spark):
    """No element or word of the rules: menus by links, blurbs and tails that say something else on every page by their place."""
    import random

    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(10**6)) for _ in range(n))
    rows, own = [], {}
    for i in range(40):
        own[i] = [said(rng.randint(20, 90)) for _ in range(rng.randint(1, 6))]
        top = "".join(f"<span><a href='/{x}'>{x}</a></span>" for x in said(5).split())
        body = "".join(f"<div class=para{k}>{p}</div>" for k, p in enumerate(own[i]))
        rows.append((i, "http://soup.example/x", f"<body><div id=top{i}>{top}</div><div class=blurb>{said(8)}</div><div class=story>{body}</div><div class=tail>&copy; {said(6)}</div></body>"))
    rows.append((99, "http://alone.example/x", "<body><div class=blurb>one page</div><div class=story>of its host</div></body>"))
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == "\n".join(own[i]) for i in own) and found[99] == "one page\nof its host"


def test_html_of_very_long_pages(spark):
    text = "<article>" + "".join(f"<div><p>word {k} &amp; more</p></div>" for k in range(20000)) + "<b>" * 3000 + "<div>" * 3000 + "deep</article>"
    found = pages.extract(spark.createDataFrame([(1, "http://l.example/1", text), (2, "http://l.example/2", "<" * 50000), (3, "http://l.example/3", "<a b='" * 3000)], "page_id long, url string, html string")).collect()
    first = next(r["text"] for r in found if r["page_id"] == 1)
    assert len(found) == 3 and first.startswith("word 0 & more\nword 1 & more") and first.endswith("deep") and first.count("\n") == 20000


def test_html_attributes():
    for kept in ('style="overflow:hidden"', "style='overflow-x: hidden'", 'title="Hidden gems"', 'data-x="a hidden" data-id="share"', 'data-role=menu', "title='class=\"nav\"'", "data-a=id=share"):
        assert pages.main_text(f"<article {kept}><h2 {kept}>A</h2><p>text</p></article>", frozenset()) == "A\ntext", kept
    for out in ("hidden", 'HIDDEN=""', 'title="" hidden', "class = 'x nav'", "id=share", 'role="menu"', "aria-hidden=true", 'data-x="a>b"id=share'):
        assert pages.main_text(f"<article><div {out}>A</div><p>text</p></article>", frozenset()) == "text", out


@pytest.mark.parametrize("seed", [1, 2])
def test_window_hashes(seed):
    from millrace.llm.common import covered, window_hashes

    h = np.random.default_rng(seed).integers(0, 4, 300).astype(np.uint64)
    for k in (1, 4, 20):
        w = window_hashes(h, k)
        same = {}
        for i in range(len(w)):
            assert same.setdefault(tuple(h[i : i + k].tolist()), w[i]) == w[i]
        assert len(set(same.values())) == len(same)
    assert covered(np.array([1, 2]), 2, 5).tolist() == [False, True, True, True, False]
