"""Operators that judge each text by itself: personal data, quality rules, benchmark windows, tokens."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from ledgerlens.llm import bpe, fm_index, pii, quality
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# ------------------------------------------------------------------ personal data

PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_spans(text):
    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return sorted((k, *m.span()) for k, p in PLAIN.items() for m in p.finditer(text or "") if holds(k, m[0]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(30_000):
        text = "".join(rng.choice("ab0123@@..--++ ()19é%") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.base_spans(text)) == plain_spans(text), text


def test_checksums_and_context():
    found = {s[0]: s for s in pii.spans_of('IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789; call (555) 123-4567. token = "1eb9c654e721b4f812088970e66a6345cee33dd6"')}
    assert set(found) == {"iban", "ssn", "local_phone", "secret"}
    assert pii.spans_of("IBAN GB82 WEST 1234 5698 7654 33, 123-45-6789 and 1eb9c654e721b4f812088970e66a6345cee33dd6") == []
    assert pii.masked("mail a@b.cd or +1 (555) 123-4567.", pii.spans_of("mail a@b.cd or +1 (555) 123-4567.")) == "mail [EMAIL] or [PHONE]."


def test_ibans_are_cut_where_they_hold():
    iban = "GB82 WEST 1234 5698 7654 32"
    for after in ("", " BIC MIDLGB22", " AND SO ON", f" {iban}", ".", " 12"):
        text = f"bank {iban}{after}"
        found = [text[a:b] for k, a, b, _ in pii.spans_of(text) if k == "iban"]
        assert found == [iban] * (1 + (iban in after)), text
    assert not [s for s in pii.spans_of("account GB82 WEST 1234 5698 7654 31 BIC MIDLGB22") if s[0] == "iban"]


def test_secrets_of_any_length():
    for n in (24, 128, 129, 140, 5_000):
        secret = ("aB3dE5gH7jK9" * 500)[:n]
        assert [(k, b - a) for k, a, b, _ in pii.spans_of(f"token = {secret};")] == [("secret", n)]


def test_long_hostile_text_is_linear():
    pii.spans_of("GB82" + " WEST 1234" * 30_000 + " GB82" * 30_000 + " token 1" + "a1b2c3d4" * 40_000)
    pii.spans_of("a" * 300_000 + "@ " + "1" * 300_000 + " " + "1.1." * 50_000 + "+ " * 50_000 + "@" * 50_000)


def test_pii_rows(make_docs, corpus):
    rows = [*corpus, (500, "x@y.zz 1.2.3.4 4465758382889437 +1 (545) 555-9193 é"), (500, "x@y.zz")]
    found = pii.find(make_docs(rows))
    assert found.count() == len(rows)
    def digest(x):
        spans = sorted(plain_spans(x), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert rows_of(found, "doc_id", "base_sha256") == Counter((i, digest(x)) for i, x in rows)
    clean = pii.redact(make_docs(rows))
    assert clean.columns[:2] == ["doc_id", "text"] and clean.where("text = '[EMAIL]'").count() == 1
    assert pii.find(make_docs(rows).limit(0)).count() == 0


# ------------------------------------------------------------------ quality rules

def plain_quality(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    repeat = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w)


def test_quality_counts_are_native_and_right(make_docs, corpus):
    rows = [*corpus, (500, "a b c d e f g h " * 9), (501, "x *# | y\nx *# | y\n\n \n"), (502, "w " * 40)]
    found = quality.judge(make_docs(rows))
    assert rows_of(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((i, *plain_quality(x)) for i, x in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert found.where("kept AND base_failed").count() == 0
    assert quality.judge(make_docs(rows).limit(0)).count() == 0


def test_line_rules(make_docs):
    good = "The first line of a good text ends well. It goes on for some more words, as texts do.\nA second line that is long enough to keep. All is fine here!"
    rows = [(1, good), (2, good + "\nAll rights reserved."), (3, "\n".join(["Home | News | About | Contact | Imprint | Login | Help | More"] * 5)),
            (4, " ".join(["word***"] * 30)), (5, " ".join(["SHOUT!!"] * 2 + [f"W{i}!!" for i in range(30)])), (6, " ".join(f"w{i}" for i in range(150))),
            (7, good.replace(".", "").replace("!", "."))]
    kept = {r["doc_id"] for r in quality.judge(make_docs(rows)).where("kept").collect()}
    assert kept == {1, 2}
    out = quality.keep_good(make_docs(rows))
    assert out.columns == make_docs(rows).columns and out.count() == 2


# ------------------------------------------------------------------ benchmark windows

def plain_hits(text, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w, hit, found = words(text), set(), set()
    for item, body in items:
        v = words(body)
        for k in range(max(1, len(v) - 12) if v else 0):
            window = v[k:k + 13]
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item) if item is not None else "")
    return len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("options", [{}, {"shard_words": 200, "sample": 3, "block_phrases": 40}])
def test_fm_index_equals_search(spark, make_docs, corpus, options):
    small = [(i, x) for i, x in corpus if len(x or "") < 20_000]
    items = [(1, " ".join((small[3][1]).split()[3:25])), (2, " ".join(small[4][1].split()[:6])), (12, small[5][1]), (3, None), (4, ""), (5, "no such words anywhere"), (2, " ".join(small[4][1].split()[:6])), (None, " ".join(small[9][1].split()[1:16]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = fm_index.judge(make_docs(small), benchmark, **options)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in found.collect())
    want = Counter((i, n, h, s, c) for i, x in small for n, h, s, c in [plain_hits(x, items)])
    assert got == want
    kept = fm_index.drop_contaminated(make_docs(small), benchmark, **options)
    assert kept.count() == sum(n for (_, _, _, _, c), n in want.items() if not c) and kept.columns == make_docs(small).columns
    assert fm_index.judge(make_docs(small).limit(0), benchmark).count() == 0
    assert fm_index.judge(make_docs(small), benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_cut_removes_the_words_of_spans():
    assert fm_index.cut("One two, (three) four.", [(1, 3)]) == "One ) four."


# ------------------------------------------------------------------ tokens

def test_bpe_equals_the_library(make_docs, corpus):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    odd = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|>" * 300, " " * 5000, "x" * 3000, "日本語 テスト " * 400, "it's we'll \n\n\n  foo bar \u0085 　 baz" * 50, "don't " * 900, "\U0001f600 " * 700 + " a"]
    rows = [*corpus, *[(600 + i, x) for i, x in enumerate(odd * 2)]]
    for limit in (200_000, 0):  # the list of shared chunks broadcast, and joined by a shuffle
        found = bpe.encode(make_docs(rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id", "text"], outputs="texts", broadcast_rows=limit).collect()
        assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in found) == Counter(rows)
        for r in found:
            want = tokenizer.encode(r["row"]["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["n_tokens"] == len(want)
            assert r["decoded"] == tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.encode(make_docs(rows).limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_chunks_of_shared_text_agree():
    rng = random.Random(5)
    shared = " ".join(str(rng.random()) for _ in range(2000)).encode()
    a, b = b"first text " + shared, b"quite another beginning " * 9 + shared
    pieces = lambda t: {t[x:y] for x, y in bpe.chunks(t)}
    assert len(pieces(a) & pieces(b)) > 5 and b"".join(a[x:y] for x, y in bpe.chunks(a)) == a
