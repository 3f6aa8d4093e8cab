import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np

import corpus_pipeline as pipeline
from codestrata.llm import langid, packing, simhash
from llm.test_simhash import brute_components
from llm.test_suffix_dedup import brute_spans

SOUNDS = {"aa": ["lo", "mi", "ta", "ru ", "ne"], "bb": ["gesch", "\u00fcber", "icht", "en ", "s"], "cc": ["eaux", "\u00e7on", "ment", "\u00e9 "]}


def text_of(rng, label, n):
    return "".join(rng.choice(SOUNDS[label]) for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(90):
        label = list(SOUNDS)[k % 3]
        rows.append((k, text_of(rng, label, rng.randint(40, 400)), label))
    passage = {label: text_of(rng, label, 150) for label in SOUNDS}
    for k in range(90, 120):
        label = list(SOUNDS)[k % 3]
        rows.append((k, text_of(rng, label, 60) + passage[label] + text_of(rng, label, 60), label))
    copies = [(200 + k, rows[k][1] + (" lo" if k % 2 else ""), rows[k][2]) for k in range(12)]
    odd = [(300, None, None), (301, "", "aa"), (302, "12 34 !!", None), (303, rows[5][1], "bb"), (303, rows[5][1], "bb")]
    return [(i, t, lang, f"src{i % 4}", len(t or "")) for i, t, lang in rows + copies + odd]


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    first = pipeline.language_id(spark, docs, "")
    known = sorted(first.collect())
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in known} == {r[0] for r in rows} - {300, 301, 302}  # nothing else is unclear
    second = pipeline.near_copies(spark, spark.createDataFrame(known, docs.schema), "")
    groups = brute_components([simhash.fingerprint(r["text"]) for r in known], 4)
    keepers = {}
    for r, g in zip(known, groups, strict=True):
        keepers.setdefault(g, r["doc_id"])
    kept = sorted(second.collect())
    assert sorted(r["doc_id"] for r in kept) == sorted(keepers.values())
    third = pipeline.repeated_passages(spark, spark.createDataFrame(kept, docs.schema), "")
    data = [r["text"].encode() for r in kept]
    shorter = {r["doc_id"]: r for r in third.collect()}
    removed = 0
    for r, text, flags in zip(kept, data, brute_spans(data, 200, "first"), strict=True):
        left = bytes(np.frombuffer(text, np.uint8)[~flags])
        got = shorter[r["doc_id"]]
        assert got["n_chars"] == len(got["text"]) and got["source"] == r["source"]
        assert 0 <= len(got["text"].encode()) - len(left) <= 6 * (1 + int(flags.any()))  # characters cut in part stay
        removed += int(flags.sum())
    assert removed > 1000
    pieces = pipeline.pack(spark, third, "").collect()
    tokenizer = packing.tokenizer_of(packing.default_tokenizer())
    for name, r in shorter.items():
        own = sorted((p for p in pieces if p["doc_id"] == name), key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in own), "<u4").tolist()
        assert ids == [*tokenizer.plain(r["text"]).tolist(), 1]


def test_run_and_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("full", documents(5)), ("empty", [])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        found = pipeline.run(spark, str(tmp_path / name))
        assert (found.count() > 0) == bool(rows)
        assert found.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def test_extra_columns_with_clashing_names(spark):
    rows = [(*r, 1.5, "k", 2) for r in documents(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp int")
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame((out := stage(spark, docs, "")).collect(), out.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "key", "fp"], name
    assert pipeline.pack(spark, docs, "").count() > 0


def test_without_labels_every_text_with_a_letter_stays(spark):
    rows = [(k, t, None, "s", len(t or "")) for k, t in enumerate(["words here", "½ 12", None, "", "你", "x"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipeline.language_id(spark, docs, "").collect()) == [0, 4, 5]


def test_texts_that_are_far_from_a_learned_language_leave(spark):
    """The best label has to score more than an even share; clean texts do."""
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs, settings=langid.Settings(window=32, per_label=40, epochs=8))
    for k in model.weights:
        model.weights[k][:] = 0  # every label now scores a third
    assert langid.drop_unknown(docs, model).count() == 0
    assert langid.drop_unknown(docs, model, excess=0.0).count() == docs.where("text rlike '[a-z]'").count()


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import corpus_pipeline
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
print("pieces", corpus_pipeline.run(spark, {data!r}).count())
"""


def test_runs_from_another_folder(spark, tmp_path):
    """Workers that cannot import the package get it from the driver."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents(5)[:40], schema).write.parquet(str(tmp_path / "data" / "documents.parquet"))
    root = str(Path(pipeline.__file__).resolve().parent)
    environment = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    code = SCRIPT.format(root=root, shared=str(tmp_path / "shared"), data=str(tmp_path / "data"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("pieces")[-1]) > 0
