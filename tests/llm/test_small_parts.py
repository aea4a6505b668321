"""Kernels without Spark: filters, sets, packing, scans, codes, records - against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as spark_functions

from lacuna.llm import language, near_duplicates, neighbours, packing, quality, quotient_filter, sentencepiece_scan, shared, warc
from lacuna.llm.shingles import shingle_set
from lacuna.llm.url_filter import RULES, Rule

# -- counting quotient filters ------------------------------------------------------------------


def filters_of(values):
    v = np.sort(np.array(values, np.uint64))
    prints, counts = quotient_filter.summed(v, np.ones(len(v), np.int64))
    blocks = quotient_filter.block_of(prints)
    return {int(b): quotient_filter.build(prints[blocks == b], counts[blocks == b]) for b in np.unique(blocks)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 300)), min_size=1), st.lists(st.integers(0, 300)))
def test_filters_merge_without_loss(one, two):
    a, b = filters_of(one), filters_of(two)
    got = Counter()
    for block in a.keys() | b.keys():
        merged = quotient_filter.merged(block, [f[block] for f in (a, b) if block in f])
        prints, counts = quotient_filter.entries(block, merged)
        got.update(dict(zip(prints.tolist(), counts.tolist(), strict=True)))
    assert got == Counter(one) + Counter(two)


def test_large_counts_survive():
    prints, counts = quotient_filter.entries(0, quotient_filter.build(np.array([3, 9], np.uint64), np.array([10**9, 1])))
    assert prints.tolist() == [3, 9] and counts.tolist() == [10**9, 1]


# -- shingles -----------------------------------------------------------------------------------


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAB \t\n\x0b é", max_size=60), st.text(alphabet="abAB \t\né", max_size=60))
def test_shingle_sets_equal_those_of_words(one, two):
    a, b = shingle_set(one), shingle_set(two)
    assert len(a) == len(brute_set(one)) and len(np.intersect1d(a, b)) == len(brute_set(one) & brute_set(two))


def test_long_texts_are_read_in_pieces(monkeypatch):
    from lacuna.llm import shingles

    text = " ".join(random.Random(0).choice(["ab", "c", "defg", "h" * 30]) for _ in range(3000))
    whole = shingle_set(text)
    monkeypatch.setattr(shingles, "PIECE", 97)
    assert (shingle_set(text) == whole).all() and shingle_set(None).size == shingle_set(" \n").size == 0


def test_t_occurrence_finds_exactly_the_similar_sets():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 4000, rng.integers(5, 80))).astype(np.uint64) for _ in range(40)]
    sets = [np.unique(np.where(rng.random(len(s)) < 0.05, rng.integers(0, 4000, len(s)).astype(np.uint64), s)) for s in base * 6]
    index = near_duplicates.TOccurrence(sets)
    for q in sets[:60]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert index.search(q).tolist() == want


@pytest.mark.parametrize("entries", [0, 1 << 10])
def test_links_within_connect_what_brute_force_connects(monkeypatch, entries):
    monkeypatch.setattr(near_duplicates, "HEAP_ENTRIES", entries)
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 3000, rng.integers(3, 60))).astype(np.uint64) for _ in range(25)]
    sets = [np.unique(np.where(rng.random(len(s)) < 0.08, rng.integers(0, 3000, len(s)).astype(np.uint64), s)) for s in base * 8]
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    want, got = near_duplicates.Forest(len(sets)), near_duplicates.Forest(len(sets))
    links = near_duplicates.links_within(sets)
    assert all((max(x), min(x)) in similar for x in links) and len(links) < len(sets)
    for i, j in similar:
        want.join(i, j)
    for i, j in links:
        assert got.join(i, j)
    assert [want.root(i) for i in range(len(sets))] == [got.root(i) for i in range(len(sets))]


@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=8).map(lambda x: sorted(set(x))), min_size=1, max_size=9), st.integers(1, 5))
def test_merge_skip_counts_as_counting_does(lists, need):
    want = Counter(x for one in lists for x in one)
    assert near_duplicates.merge_skip(lists, need) == sorted((x, n) for x, n in want.items() if n >= need)


# -- packing ------------------------------------------------------------------------------------


def test_word_encoder_equals_the_tokenizer():
    enc, rnd = packing.WordEncoder(packing.default_tokenizer()), random.Random(0)
    odd = ["", " ", "it's We'LL <|endoftext|> x<|endoftext|>y ÉÈ naïve_ 123 4a５ é a b İ ΣΑΣ ß a_b x² º ÷ 日本\x1c\x85q ``l'été 'S ''s a|b<c"]
    letters = "abcXYZ 019.,!?'|<>_-\t\n\x0b\x1d\x85é́Çßª²日'stremld"
    for text in odd + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]:
        want = enc.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == want, repr(text)


def naive_best_fit(lengths, window):
    rest = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rest if r >= n]
        if fits:
            rest[rest.index(min(fits))] -= n
        else:
            rest.append(window - n)
    return sorted(rest)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit_decreasing_equals_one_by_one(lengths):
    counts = dict(Counter(lengths))
    plan = packing.best_fit_decreasing(counts, 32)
    windows = {}
    for n, k in counts.items():
        for number in range(k):
            w, offset = plan.place(n, number)
            windows.setdefault(w, []).append((offset, n))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 32
    assert sorted(32 - sum(n for _, n in p) for p in windows.values()) == naive_best_fit(lengths, 32)


def test_padding_stops_at_a_power_of_two():
    assert [packing.padded_length(n) for n in (1, 3, 1024, 1025, 2048)] == [1, 2048, 1024, 2048, 2048]


# -- SentencePiece ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_scan.Vocabulary(sentencepiece_scan.default_model())


def brute_best(v, text):
    """The best score over all segmentations, by recursion on the first piece."""
    if not text:
        return 0.0
    return max(score + brute_best(v, text[n:]) for n, score, _ in v.arcs(text, 0))


def test_chunks_give_the_path_of_the_whole_text(vocabulary):
    v, rnd = vocabulary, random.Random(0)
    for _ in range(120):
        text = "".join(rnd.choice(["the", "ing", "a", "é", "日", "x y", " ", "  ", "\n", "▁", "Hello", "qz"]) for _ in range(rnd.randint(1, 60)))
        written = v.written(text)
        score, ids = v.best_path(written, 0, len(written))
        segments = [v.segment(s) for s in sentencepiece_scan._SEGMENT.findall(written)]
        assert sum(s[0] for s in segments) == score
        assert np.frombuffer(b"".join(s[1] for s in segments), np.uint32).tolist() == ids
        assert np.frombuffer(b"".join(s[2] for s in segments), np.uint32).tolist() == v.library.encode(text)
        assert v.decode(np.array(ids)) == text.replace("▁", " ")
        for size in (1, 3, 8, 21):
            starts = list(range(0, len(written), size))
            scores = sentencepiece_scan.entry_scores([v.matrix(written, a, min(a + size, len(written))) for a in starts])
            states = sentencepiece_scan.boundary_states([v.enter_map(written, a, min(a + size, len(written)), x) for a, x in zip(starts, scores, strict=True)])
            got = b"".join(v.trace(written, a, min(a + size, len(written)), states[k], states[k + 1]) for k, a in enumerate(starts))
            assert np.frombuffer(got, np.uint32).tolist() == ids


def test_best_path_is_best(vocabulary):
    for text in ("▁thein", "▁Hellowayq", "▁日x", "▁▁ab"):
        assert vocabulary.best_path(text, 0, len(text))[0] == brute_best(vocabulary, text)


def test_matrices_combine_associatively():
    a, b, c = (np.random.default_rng(k).integers(-9, 9, (4, 4)).astype(float) for k in range(3))
    one = sentencepiece_scan.combined(sentencepiece_scan.combined(a, b), c)
    assert (one == sentencepiece_scan.combined(a, sentencepiece_scan.combined(b, c))).all()


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_joined_crc(a, b):
    assert sentencepiece_scan.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# -- neighbours ---------------------------------------------------------------------------------


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, (20, 4)).astype(np.uint16)
    codes = np.repeat(base, 30, axis=0) ^ (1 << rng.integers(0, 16, (600, 4))).astype(np.uint16) * (rng.random((600, 4)) < 0.6)
    index = neighbours.BlockIndex(codes)
    for q in codes[::37]:
        for radius in (0, 3, 7, 20, 64):
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
            assert (index.within(q, radius) == want).all()


# -- WARC ---------------------------------------------------------------------------------------


def test_records_read_back():
    payload = "<p>é\r\n\r\nWARC/1.1</p>".encode()
    got = warc.parse(warc.record("response", "http://x.org/a b\nc", "urn:page:7:0", payload, "d"))
    assert got.payload == payload and got.headers["WARC-Type"] == "response" and got.headers["WARC-Target-URI"] == "http://x.org/a b%0Ac"
    revisit = warc.parse(warc.record("revisit", "http://x.org/", "urn:page:8:0", payload, "d", "urn:page:7:0"))
    assert revisit.payload == b"" and revisit.http["Content-Length"] == str(len(payload)) and revisit.headers["WARC-Refers-To"] == "<urn:page:7:0>"
    with pytest.raises(Exception):
        warc.parse(warc.record("response", "u", "i", payload, "d")[:-9])


def test_url_keys_sort_by_reversed_host():
    assert warc.url_key("https://www.Example.org:8080/a?b#c") == "org,example,www:8080)/a?b"
    assert warc.url_key(None) == ")" and warc.url_key("http://[bad") .startswith(")")
    assert warc.sort_key("http://a.b/", -5) < warc.sort_key("http://a.b/", 7) < warc.sort_key("http://a.b/", 70)


# -- models -------------------------------------------------------------------------------------


def test_quality_model_tells_two_kinds_apart():
    rnd = random.Random(0)
    good = [" ".join(rnd.choice(["the", "river", "stone", "under", "morning", "walks"]) for _ in range(80)) for _ in range(120)]
    bad = ["".join(rnd.choice("#%$!xq") for _ in range(300)) for _ in range(120)]
    model = quality.fit(good[:100] + bad[:100], [1] * 100 + [0] * 100)
    s = model.score(model.evidence(good[100:] + bad[100:] + [None, ""], model.compressors()))
    assert (s[:20] > 0.5).all() and (s[20:40] < 0.5).all() and ((s >= 0) & (s <= 1)).all()
    assert quality.fit(["a"], [1]).score(np.zeros((1, 2)))[0] == pytest.approx(2 / 3)


def test_language_model_and_its_edges():
    rnd = random.Random(0)
    words = {"aa": ["mor", "lat", "vex"], "bb": ["schu", "ung", "keit"]}
    rows = [(" ".join(rnd.choice(words[k]) for _ in range(30)), k) for k in words for _ in range(60)]
    rnd.shuffle(rows)
    model = language.fit([t for t, _ in rows[:90]], [k for _, k in rows[:90]])
    assert all(model.predict(t)[0] == k for t, k in rows[90:])
    assert model.predict(None) == model.predict("12 .,") == ("und", 0.0)
    long = " ".join(words["aa"]) * 20_000
    assert model.predict(long)[0] == "aa"
    assert language.fit([], []).predict("abc") == ("und", 0.0)


def test_slices_lose_no_gram(monkeypatch):
    monkeypatch.setattr(language, "SLICE", 10)
    text = "abcdefghijklmnopqrstuvwxyz"
    threes = {text[i : i + 3] for i in range(len(text) - 2)}
    assert threes == {p[i : i + 3] for p in language.slices(text) for i in range(len(p) - 2)}


def test_rules_are_cut_at_the_first_slash():
    assert [(r.host, r.path) for r in RULES] == [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")]
    assert Rule("A.b/C", "allow").host == "a.b" and not math.isnan(1.0)


def test_notes_lie_by_ranges_of_rows(spark, monkeypatch, tmp_path):
    """A table of one file gives several groups of notes, and a reader opens only those of its own rows."""
    monkeypatch.setattr(shared, "NOTED_ROWS", 100)
    path = f"file://{tmp_path}/one"
    spark.range(1000).coalesce(1).selectExpr("id AS doc_id", "'t' AS text").write.parquet(path)
    scratch = shared.Scratch(spark, "notes")
    rows, file, row = shared.placed(spark.read.parquet(path), scratch)
    noted = rows.where("doc_id % 7 = 0 AND doc_id < 650").select(file, row)
    folder = scratch.path("notes")
    shared.write_row_notes(noted, file, row, folder)
    files, base = shared.open_folder(folder)
    assert len(files.get_file_info(shared.pafs.FileSelector(base))) == 7
    batch = pa.RecordBatch.from_pylist([{file: r[file], row: r[row]} for r in rows.where("doc_id BETWEEN 130 AND 250").select(file, row).collect()])
    notes = shared.Notes(folder)
    runs = [(key, part.num_rows, notes.of(key, lambda t: t.num_rows)) for key, part in shared.noted_runs(batch, file, row)]
    assert [n for _, n, _ in runs] == [70, 51] and [n for _, _, n in runs] == [14, 14]
    kept = shared.picked_rows(rows, file, row, noted, scratch, "kept", True)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 650, 7))


def test_rows_that_a_join_or_an_explode_repeats_have_places_of_their_own(spark, tmp_path):
    from lacuna.llm.exact_dedup import exact_dedup

    F = spark_functions
    spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    times = spark.range(2).withColumnRenamed("id", "k")
    repeated = {"join": docs.crossJoin(times), "explode": docs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))}
    for name, rows in repeated.items():
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(rows.select((F.col("doc_id") + 10 * F.col("k")).alias("doc_id"), "text")).collect()}
        assert got == {1: (1, 4, True), 2: (1, 4, False), 11: (1, 4, False), 12: (1, 4, False), 3: (3, 2, True), 13: (3, 2, False)}, name
        assert not shared._row_by_row(rows)
    assert shared._row_by_row(docs) and shared._row_by_row(docs.where("doc_id > 1").withColumn("text", F.lower("text")))  # these are read where they lie


def test_stages_of_the_pipeline_on_awkward_rows_and_none(spark):
    """Every stage on what the one before kept, through Parquet; own columns with clashing names stay until the last."""
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "exact dedup", "n-gram Jaccard join", "packing"]
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 300")
    clean = base.orderBy("doc_id").limit(3).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in clean]
    rows += [(None, clean[0].text, None, None, None), (rows[0][0], rows[0][1], "x", "s", 1), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \t", None, "s", 2), (9004, "y" * 100_000, "en", "s", 9), (9005, "12 34 !", "en", "s", 7)]
    docs = spark.createDataFrame(rows, base.schema).withColumns({c: spark_functions.lit(1) for c in ("file", "row", "_file", "digest", "h")})
    for given in (docs, docs.where("false")):
        scratch, at = shared.Scratch(spark, "stages"), given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = at
            at = scratch.keep(stage(spark, before, "/root/testdata/sf0.001"), str(k))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == given.columns
                assert at.exceptAll(before).isEmpty()
        if given is docs:
            assert {r.doc_id for r in at.collect()} >= {r[0] for r in rows[:1]}
        else:
            assert at.isEmpty()
        scratch.close()
