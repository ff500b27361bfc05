"""Chat formatting against a plain version, and read back exactly."""

from __future__ import annotations

import hashlib
import random
import re

from ledgerlens.llm import chat
from pyspark.sql import functions as F

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[NAME]", "[NEXT]", "[", "<", "\\", "[\\INST]", "<\\\\/s>", "]", "a", "é😀", "\n", " "]
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("", "</s>")}


def escaped(text):
    return re.sub(chat.CONTROL, lambda m: m[1] + "\\" + m[2] + m[3], text)


def plain(turns):
    """(formatted, trained texts with their spans) of (role, text) turns."""
    out, spans, last = "<s>", [], None
    for i, (role, text) in enumerate(turns):
        opening, closing = MARKS.get(role, (f"[ROLE]{escaped(role)}[NAME]", "[/ROLE]"))
        out += "[NEXT]" if i and role == last else opening
        start = len(out)
        out += escaped(text)
        if role == "assistant":
            spans.append((start, len(out)))
        if i + 1 == len(turns) or turns[i + 1][0] != role:
            out += closing
        last = role
    return out, spans


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def make(rng):
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "[NAME]x", None, ""])
            text = rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))])
            rows.append((conv, rng.choice([turn, turn, None, 3]), role, text))
    rows += [(500, i, "assistant" if i % 2 else "user", f"t{i} </s>") for i in range(700)]
    rows += [(501, 0, "user", "x" * 300_000 + "[INST]" * 2_000), (502, 0, "assistant", ""), (503, 1, "user", "same"), (503, 1, "user", "same")]
    rng.shuffle(rows)
    return rows


def test_formats_and_reads_back(spark):
    rows = make(random.Random(5))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.select("*", *[F.lit("x").alias(c) for c in ("conv", "one", "turns", "formatted", "loss", "made")])
    chats = chat.format_turns(df)
    assert chats.columns == ["conv_id", "formatted", "loss"]
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == conv), key=lambda k: (k[0], k[1], k[2].encode(), k[3].encode()))
        want[conv] = [(role, x) for _, _, role, x in own]
    made = {r["conv_id"]: r for r in chats.collect()}
    assert set(made) == set(want)
    for conv, turns in want.items():
        formatted, spans = plain(turns)
        assert made[conv]["formatted"] == formatted and [tuple(s) for s in made[conv]["loss"]] == spans
    for r in chat.digests(chats).collect():
        turns = want[r["conv_id"]]
        trained = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha("".join(f"{role}\n{x}\n" for role, x in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(trained), sha(trained)) and r["formatted_chars"] == len(made[r["conv_id"]]["formatted"])
    assert "Python" not in chats._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(empty)).count() == 0


def test_running_sums(spark):
    df = spark.sql("SELECT array() AS a UNION ALL SELECT transform(sequence(1, 50), x -> CAST(x AS BIGINT)) UNION ALL SELECT array(7L)")
    found = [r[0] for r in df.select(chat.running(F.col("a").cast("array<long>"))).collect()]
    assert sorted(found) == sorted([[], [sum(range(1, i)) for i in range(1, 51)], [0]])
