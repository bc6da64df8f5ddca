import gc
import os
import random
import time
from pathlib import Path

import corpus_pipeline
import sentencepiece
from quadweave.llm import mixing
from quadweave.llm.common import durable, tokenizer_path


def test_stages(spark, tmp_path):
    text = lambda i: " ".join(random.Random(i).choices([f"w{j}" for j in range(900)], k=40 + i % 5))
    rows = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, text(i), "en", "s0", 0) for i in range(5)]
    rows += [(200 + i, text(300 + i) + " blorgh snarfle grumbax", "en", "s1", 0) for i in range(20)]
    rows += [(300, "write to someone.else@mail.example.com " + text(777), "en", None, 0), (301, None, None, "s2", None), (302, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(200 <= i < 300)) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {n: {r.doc_id for r in rs} for n, rs in seen.items()}
    assert ids["toxicity"] == {i for i, *_ in rows if not 200 <= i < 300}
    assert ids["simhash_near_dedup"] == (ids["toxicity"] - {100 + i for i in range(5)} - {302})
    hidden = next(r for r in seen["pii_surrogates"] if r.doc_id == 300)
    assert "someone.else" not in hidden.text and hidden.n_chars == len(hidden.text)
    times = {}
    for r in seen["mix_sources"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    plan = {r.doc_id: r.taken // r.size if r.size else 1 for r in mixing.mix_sources(spark.createDataFrame(seen["pii_surrogates"], spark.read.parquet(f"{tmp_path}/documents.parquet").schema)).collect()}
    assert times == {i: n for i, n in plan.items() if n}
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in seen["mix_sources"]}
    assert all(r.ids == lib.encode(texts[r.doc_id] or "", add_eos=True) for r in seen["sentencepiece"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, whole)) == sorted(map(key, seen["sentencepiece"]))



def test_odd_rows(spark, tmp_path):
    """Repeated and null ids, null and very long texts, equal rows and clashing columns, against plain rules."""
    text = lambda i, n=40: " ".join(random.Random(i).choices([f"w{j}" for j in range(900)], k=n))
    bad = " blorgh snarfle grumbax"
    rows = [(i, text(i), "s1") for i in range(30)] + [(200 + i, text(300 + i) + bad, "s1") for i in range(20)]
    odd = [(1, text(500), "s0"), (1, text(501) + bad, "s0"), (2, text(502), None), (2, text(502), None), (None, text(503), "s0"), (None, text(504) + bad, "s0"), (None, None, None), (60, None, "s2"), (61, "", "s2"), (62, text(505, 30_000), "s2")]
    cols = "doc_id long, text string, lang string, source string, n_chars long, fp string, kind int, h long, score double, size int, _h string"
    made = spark.createDataFrame([(i, t, "en", s, 0, "x", 1, 2, 0.5, 3, "y") for i, t, s in rows + odd], cols)
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), spark.read.parquet(f"{tmp_path}/documents.parquet").select(*corpus_pipeline.COLUMNS).schema)
        seen.append(sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str))
    clean = [(i, t, s) for i, t, s in rows + odd if bad not in (t or "")]
    assert seen[0] == sorted(clean, key=str)  # only toxic texts went, whatever shares their id
    one = [x for n, x in enumerate(clean) if x[0] is None or (x not in clean[:n] and x[0] != 61)]  # 60 and 61 are one group, without text
    assert seen[1] == sorted(one, key=str)
    assert seen[2] == seen[1]  # no personal data
    plan = {}
    for r in mixing.mix_sources(spark.createDataFrame(one, "doc_id long, text string, source string"), keep=["text"]).collect():
        plan[r.doc_id, r.text, r.source] = plan.get((r.doc_id, r.text, r.source), 0) + (r.taken // r.size if r.size else 1)
    assert seen[3] == sorted([x for x, n in plan.items() for _ in range(n)], key=str)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_driver_gives_native_memory_back(spark):
    """What the driver's JVM has freed doesn't stay with its allocator once a stage's intermediate table is there."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    resident = lambda: int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    taken = [spark._jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(4000)]
    taken = taken[::50]  # those that stay keep the allocator from shrinking by itself
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(1)
    before = resident()
    assert durable(spark.range(10)).count() == 10
    assert resident() < before - 100, len(taken)
