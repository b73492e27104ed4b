"""Plain Python versions of the contracts, and small documents with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rep long, key string"


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows):
    """A ``documents`` table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7, "k") for i, t in rows], SCHEMA)


def sample(seed=3, n=60):
    """Copies, near copies, shared passages, repeats inside a text, junk, null, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randint(0, 400)}" for _ in range(500)] + ["Wort.", "été,", "Über", "𝒳y", "a b", "x y"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base = [text(rng.choice([3, 8, 25, 60, 150, 400])) for _ in range(n)]
    passage = text(45)
    out = list(base)
    for k in range(n // 2):
        w = base[k].split(" ")
        for _ in range(max(1, len(w) // rng.choice([10, 25, 60]))):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        out.append(" ".join(w))
    out += [base[1], base[1], base[4].upper(), base[5] + " " + passage, passage + "\n" + base[6], base[7] + "\t" + passage + "  " + base[8]]
    out += ["", None, " \n\t ", "one", "one", "same same " * 30, "a b c", text(5000), "x" * 3000, "\x1c\x85", "#### $$$ |||"]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows


def shingles(text, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_duplicates(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    group[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def substrings(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def quality(text):
    w = words(text)
    grams = Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4))
    again = set()
    for s in range(len(w) - 4):
        if grams[tuple(w[s : s + 5])] > 1:
            again |= set(range(s, s + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out
