"""Ranked search and phrase mining against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from ledgerlens.llm import phrases, reversed_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_ranks(docs, items, k=10):
    counts = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERM.findall(low(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


def test_search(spark, make_docs, corpus, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice((rng.choice(corpus)[1] or "x").split() or ["y"]) for _ in range(rng.randint(1, 30)))) for i in range(20)]
    items += [(30, None), (31, "  ?"), (3, items[3][1]), (None, "ka LO mi"), (40, "Ka ka ka ß-é")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = plain_ranks(corpus, items)
    found = reversed_search.search(make_docs(corpus), table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == want
    monkeypatch.setattr(reversed_search, "CELLS", 60)  # many small steps, several blocks of items
    assert Counter(map(tuple, reversed_search.search(make_docs(corpus), table, block_bytes=500).collect())) == want
    assert Counter(map(tuple, reversed_search.search(make_docs(corpus), table, k=3).collect())) == plain_ranks(corpus, items, 3)


def test_search_empty(spark, make_docs, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert reversed_search.search(make_docs(corpus), none).count() == 0
    some = spark.createDataFrame([(1, "ka")], "item_id long, text string")
    assert reversed_search.search(make_docs([]), some).count() == 0
    assert reversed_search.search(make_docs([(1, None), (2, "..")]), some).count() == 0


# ------------------------------------------------------------------ phrases

def plain_phrases(rows, threshold, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", low(text)):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, 6):
                f[lang or "und"].update(" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= threshold and " " in p}
        inside = set()
        for p, c in often.items():
            ws = p.split(" ")
            inside |= {(q, c) for m in range(2, len(ws)) for i in range(len(ws) - m + 1) for q in [" ".join(ws[i:i + m])]}
        rows = []
        for p, a in often.items():
            if (p, a) in inside:
                continue
            ws = p.split(" ")
            cuts = []
            for k in range(1, len(ws)):
                left, right = counts[" ".join(ws[:k])], counts[" ".join(ws[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            rows.append((-score, -a, p.encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return Counter(out)


def phrase_rows(rng):
    rows = []
    for i in range(300):
        words = [rng.choice(["a", "b", "the", "é", "x\x00", "-"]) if rng.random() < 0.6 else f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice([["of", "the", "new", "big", "Town"], ["new", "york"], ["in", "the", "long", "run"], ["in", "the", "long", "run", "of", "x", "y"]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!? "]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None]), text))
    rows += [("en", None), (None, ""), ("fr", " .\n"), ("en", "new york " * 3000), ("und", "a b a b a b"), *[("de", "One same text again and again.")] * 150]
    return rows


def test_phrases(spark, monkeypatch):
    rows = phrase_rows(random.Random(13))
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'x' AS shard", "'y' AS ids", "'z' AS hash", "1 AS number").repartition(7)
    for threshold, top, words in ((100, 2000, 2_000_000), (12, 40, 300), (3, 2000, 50)):
        monkeypatch.setattr(phrases, "BLOCK_WORDS", words)
        found = phrases.collocations(docs, threshold=threshold, top=top, slots=1 << 12)  # so few slots that many are shared
        assert Counter(map(tuple, found.collect())) == plain_phrases(rows, threshold, top)


def test_phrases_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0
