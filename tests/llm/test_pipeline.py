"""The corpus pipeline on planted documents: every decision takes effect, clean documents stay whole."""

from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer


def prose(rng, sentences):
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sa"]) for _ in range(rng.randint(1, 4)))
    return "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(sentences))


def planted(spark, folder):
    rng = random.Random(11)
    clean = {i: prose(rng, 6) for i in range(12)}
    passage = prose(rng, 3).replace("\n", " ")
    rows = dict(clean)
    rows[20] = clean[0]  # a copy
    rows[21] = " ".join(["word***"] * 60)  # noise
    rows[22] = "too short."
    rows[23] = None
    rows[24] = f"{prose(rng, 4)}\n{passage}"  # contaminated
    rows[25] = f"{clean[3]}\nWrite to a.b@c.de or +1 (545) 555-9193 any time."
    rows[26] = " ".join(["again and"] * 40)
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return clean, rows


def test_run(spark, tmp_path):
    clean, rows = planted(spark, str(tmp_path))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) - {0, 20} == (set(clean) - {0}) | {25} and len({0, 20} & set(found)) == 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in found.items():
        text = rows[i].replace("a.b@c.de", "[EMAIL]").replace("+1 (545) 555-9193", "[PHONE]")
        assert r["ids"] == tokenizer.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_stages_keep_the_columns(spark, tmp_path):
    planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "personal_data", "bpe_tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
