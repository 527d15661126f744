"""Small inputs and brute-force versions for the corpus operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text and extra columns with names that operators use themselves."""
    long_text = " ".join(f"word{i % 977}x{i % 13}" for i in range(30000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "the same text stands here twice and again", "en", "a"), (2, "the same text stands here twice and again", "en", "a"),
        (3, None, "en", "a"), (4, "", None, "a"), (5, " \t\n ", "en", None), (6, long_text, "en", "b"), (7, long_text + " end", "en", "b"),
        (8, "one", "en", None), (9, f"start here {passage} tail one", "en", "c"), (10, f"{passage} another tail", "en", "c"), (11, "a " * 80, "en", "a"),
        (12, "Ünïcode ÉCOLE straße “quotes” 1234 <|endoftext|> don't", "fr", "b"), (None, "a null id has text", "en", "a"), (13, "!!! ... ???", "en", "a"),
        (14, "the same text stands here twice and again", "en", "a"), (14, "the same text stands here twice and again", "en", "a"),
    ]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)
    for c in ("component", "row", "size", "win", "digest", "class", "score", "rep", "target", "words"):
        df = df.selectExpr("*", f"'x' as {c}")
    return df


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def brute_components(rows, percent=85):
    """{row index: (n_shingles, component)} over (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = [i for i, _ in rows]
    live = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    links = [(a, b) for n, a in enumerate(live) for b in live[n + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return [(i, len(s), c) for (i, _), s, c in zip(rows, sets, label, strict=True)]


def brute_repeats(rows, window=35):
    where = defaultdict(list)
    words = [SPACE.findall(t or "") for _, t in rows]
    for d, w in enumerate(words):
        for s in range(len(w) - window + 1):
            where[tuple(w[s : s + window])].append((d, s))
    gone = [set() for _ in words]
    for places in where.values():
        if len(places) > 1:
            for d, s in places:
                gone[d].update(range(s, s + window))
    return [(i, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for (i, _), w, g in zip(rows, words, gone, strict=True)]


def brute_contamination(rows, items, window=10):
    wins = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t))
        for s in range(max(1, len(w) - window + 1)) if w else []:
            wins[tuple(w[s : s + window])].add(item)
    sizes = sorted({len(k) for k in wins})
    out = []
    for i, t in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                if k in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


__all__ = ["ALNUM", "SPACE", "Counter", "brute_components", "brute_contamination", "brute_repeats", "crc", "documents", "key", "lower", "odd_docs"]
