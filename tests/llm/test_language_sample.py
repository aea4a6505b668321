"""The sample of texts that training reads: never whole in the driver's memory, the same texts as by sorting all of them."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from lacuna.llm import language


def test_sample_passes_by_partitions(spark, monkeypatch):
    words = ["over", "sobre", "unter", "vers", "hill", "monte", "berg", "mont"]
    rows = [(k, " ".join(words[(k * j) % 8] for j in range(1, 6 + k % 9)) + f" {chr(97 + k % 26)}", f"l{k % 70:02d}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    frame, collected = type(docs), []
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.extend(self.columns) or plain(self))
    found = language.train(docs, rows=4)
    assert "places" not in collected and "counts" in collected

    hashes = {r.doc_id: r.h for r in plain(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")))}
    below = {r.lang: r.below for r in plain(language._share(docs.where(~held_out()), 4))}
    known = [(lang, hashes[k], k, text) for k, text, lang in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    df, best = np.zeros(1 << language.TABLE_BITS), {}
    for lang, h, k, text in sorted(known):
        df[language.counted(text)[0]] += 1
        if h % (1 << 30) < below[lang] and len(best.setdefault(lang, [])) < 4:
            best[lang].append((language.counted(text), lang))
    pairs = [x for lang in best for x in best[lang]]
    pairs = [pairs[i] for i in np.random.default_rng(0).permutation(len(pairs))]
    want = language.fit_counts([x for x, _ in pairs], [lang for _, lang in pairs], df, len(known))
    assert found.languages == want.languages and len(want.languages) > language.DENSE
    assert np.array_equal(found.table.value, want.table.value) and np.array_equal(found.table.column, want.table.column)
    assert np.array_equal(found.bias, want.bias) and found.temperature == want.temperature


def held_out():
    return language.id_crc32(F.col("doc_id"), language.HOLD_OUT) == language.HOLD_OUT_REST


def test_held_counts_in_any_order():
    held = language.HeldCounts()
    texts = ["a bird", "", "two birds and three birds", "x" * 300]
    for t in texts:
        place, count = language.counted(t)
        held.add(place.astype(np.int32).tobytes(), count.astype(np.int64).tobytes())
    for k, i in enumerate([2, 0, 3, 1]):
        place, count = held.arranged(np.array([2, 0, 3, 1]))[k]
        assert [a.tolist() for a in (place, count)] == [a.tolist() for a in language.counted(texts[i])]
    assert len(held) == 4
