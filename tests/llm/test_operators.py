"""The operators on small tables with awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import entries, exact_dedup, language, near_duplicates, neighbours, packing, quality, quotient_filter, sentencepiece_scan, sharding, url_filter, warc
from lacuna.llm.shared import Scratch
from tests.llm.test_small_parts import brute_set

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, sha string, fp bigint, vertex bigint"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang]); other columns have names that operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, "x", 1, 2) for r in rows], DOCS)


AWKWARD = [(5, "a  b"), (3, "a\t\nb"), (3, "a\t\nb"), (None, "a b"), (9, None), (8, ""), (7, " "), (6, "a b c"), (None, None), (2, "x" * 70_000), (1, "A b")]


def test_exact_dedup(spark):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in AWKWARD]
    groups = defaultdict(list)
    for (i, _), t in zip(AWKWARD, norm, strict=True):
        groups[t].append(i)
    got = exact_dedup.exact_dedup(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(documents(spark, AWKWARD[:1]).where("false")).count() == 0


def test_first_of_each(spark):
    left = exact_dedup.first_of_each(spark, documents(spark, AWKWARD), "")
    assert left.columns == documents(spark, AWKWARD).columns
    assert sorted((r.doc_id, r.text is None) for r in left.collect()) == [(1, False), (2, False), (3, False), (6, False), (7, False), (8, False)]


def test_first_of_each_leaves_one_of_equal_texts(spark):
    rows = [(3, "a b"), (3, "a\tb"), (5, None), (5, ""), (None, "x"), (None, "x"), (9, "a  b"), (4, "alone")]
    left = exact_dedup.first_of_each(spark, documents(spark, rows).withColumn("_file", F.lit("f")).withColumn("_row", F.lit(1)), "")
    got = left.collect()
    assert Counter(r.doc_id for r in got) == {3: 1, 5: 1, None: 1, 4: 1} and {(r._file, r._row, r.sha) for r in got} == {("f", 1, "x")}
    kept = exact_dedup.exact_dedup(documents(spark, rows)).where("kept").collect()
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in got)
    assert exact_dedup.first_of_each(spark, documents(spark, rows).where("false"), "").count() == 0


def test_hot_groups_and_many_filter_blocks(spark, monkeypatch):
    from lacuna.llm import shared

    monkeypatch.setattr(shared, "HOT_KEYS", 4)  # so groups of over a quarter of the rows are hot
    monkeypatch.setattr(quotient_filter, "BLOCK_ROWS", 1)
    rows = [(k, "hot  text" if k % 3 == 0 else f"text {k // 2 if k % 2 else k}") for k in range(90)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in rows}


def brute_components(rows):
    sets = [frozenset(brute_set(t)) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i]]
        out.append((doc_id, len(sets[i]), min((x for x in ids if x is not None), default=None)))
    return Counter(out)


def near_copies(seed, groups, size, words=120, edits=3):
    rnd, rows, n = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, edits)):
                text[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
            rows.append((n, " ".join(text)))
            n += 1
    return rows


def test_near_duplicates_with_a_large_group(spark):
    rows = near_copies(1, 1, 260) + [(1000 + i, t) for i, t in near_copies(2, 12, 4)]
    line = " ".join(f"common{k}" for k in range(40))
    rnd = random.Random(3)
    rows += [(2000 + k, line + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 30)))) for k in range(120)]
    rows += [(3000, None), (3001, ""), (3002, "one two"), (3003, "ONE\ttwo"), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (None, "lonely text without an id at all")]
    got = near_duplicates.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert near_duplicates.near_duplicates(documents(spark, rows).where("false")).count() == 0
    left = near_duplicates.one_of_each(spark, documents(spark, rows), "").collect()
    alone = Counter(r.component_id for r in got if r.n_shingles)
    assert len({r.doc_id for r in left if r.text}) >= len(alone) - 1 and {3000, 3001, 3002} <= {r.doc_id for r in left}


def test_blocks_of_large_neighbourhoods_lose_no_link(spark, monkeypatch):
    from lacuna.llm import shared

    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(shared, "HOT_KEYS", 5)
    rows = near_copies(11, 1, 150, 110, 14) + [(1000 + i, t) for i, t in near_copies(12, 3, 40, 60, 5)]
    chain = [f"c{k}" for k in range(200)]  # each links to the next only
    rows += [(5000 + k, " ".join(chain[3 * k : 3 * k + 60])) for k in range(30)]
    line = " ".join(f"common{k}" for k in range(50))
    rnd = random.Random(13)
    rows += [(7000 + k, line + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(3, 16)))) for k in range(150)]
    got = near_duplicates.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert len([r for r in got if r.stays]) == len({r.component_id for r in got})


def test_packing(spark):
    rows = AWKWARD + [(100 + k, " ".join(f"wort{j % 97}" for j in range(k * 37))) for k in range(60)]
    got = packing.pack(documents(spark, rows), packing.default_tokenizer(), with_ids=True).collect()
    encoder = packing.WordEncoder(packing.default_tokenizer())
    whole = Counter((i, encoder.ids(t or "") + b"\x01\0\0\0") for i, t in rows)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, bytes(r.ids)))
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(len(t) // 4 * n for (_, t), n in whole.items()) == sum(r.length for r in got)
    for (i, t), n in whole.items():
        found = pieces[(i, len(t) // 4)]
        assert Counter(p for _, p in found if t.startswith(p) or p in t)[t[: 4 * 2048]] >= n
    assert sorted(windows) == list(range(len(windows)))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in rows:  # the library's ids of whole documents
        assert whole[(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())]
    assert packing.pack(documents(spark, rows).where("false"), packing.default_tokenizer()).count() == 0


def test_sentencepiece_of_giants_equals_whole_paths(spark):
    rnd = random.Random(0)
    giant = " ".join(rnd.choice(["the", "walking", "Überzug", "x" * 9, "\n", "日本"]) for _ in range(12_000))
    rows = AWKWARD + [(50, giant), (51, "abcdefg" * 9000), (52, "▁ sign")]
    v = sentencepiece_scan.Vocabulary(sentencepiece_scan.default_model())
    want = Counter()
    for i, t in rows:
        w = v.written(t or "")
        ids = np.array(v.best_path(w, 0, len(w))[1] if w else [], np.uint32).tobytes()
        merged = np.array(v.library.encode(t or ""), np.uint32).tobytes()
        want[(i, len(ids) // 4, zlib.crc32(ids), len(merged) // 4, zlib.crc32(merged), "▁" not in (t or ""))] += 1
    got = sentencepiece_scan.encode(documents(spark, rows), sentencepiece_scan.default_model()).collect()
    assert Counter(tuple(r) for r in got) == want


def test_sentencepiece_gives_ids_and_texts_back(spark):
    rnd = random.Random(1)
    rows = AWKWARD + [(50, " ".join(rnd.choice(["the", "walking", "Überzug", "\n", "日本"]) for _ in range(12_000))), (51, "abcdefg" * 9000)]
    v = sentencepiece_scan.Vocabulary(sentencepiece_scan.default_model())
    encoded = sentencepiece_scan.encode_ids(documents(spark, rows), sentencepiece_scan.default_model())
    found = defaultdict(list)
    for n, r in enumerate(sentencepiece_scan.decode(encoded, sentencepiece_scan.default_model()).collect()):
        found[r.document or n].append((r.chunk, r.doc_id, bytes(r.ids), bytes(r.merge_ids or b""), r.decoded))
    got = Counter((parts[0][1], b"".join(p[2] for p in parts), b"".join(p[3] for p in parts), "".join(p[4] for p in parts)) for parts in map(sorted, found.values()))
    packed = lambda ids: np.array(ids, np.uint32).tobytes()
    want = Counter((i, packed(v.best_path(w := v.written(t or ""), 0, len(w))[1] if t else []), packed(v.library.encode(t or "")), t or "") for i, t in rows)
    assert sum(len(p) > 1 for p in found.values()) >= 2
    assert {(str(i), *x): n for (i, *x), n in got.items()} == {(str(i), *x): n for (i, *x), n in want.items()}


def test_url_rules_and_standing(spark):
    urls = ["http://a.NET/x", "https://b.example.net/en/1?q#f", "http://example.com/de/", "http://www.example.com/de", "x.org/fr/", None, "http://q.org/fr/z", "http://notexample.net", "ftp://example.net/en", "http://EXAMPLE.net/en/"]
    pages = spark.createDataFrame([(k, u, None, "h") for k, u in enumerate(urls)], "page_id int, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/", "example.com/de/", "block") and got[3][2] is None and got[4][:3] == ("", "", None)
    assert got[5] == ("", "", None, "allow") and got[6][2:] == ("org/fr/", "allow") and got[7] == ("notexample.net", "", None, "allow")
    assert got[8][2:] == ("net/", "block") and got[9][:3] == ("example.net", "/en/", "example.net/en/")
    assert url_filter.judge(pages.where("false")).count() == 0


@pytest.mark.parametrize("hot_keys", [4096, 3])
def test_ranks_solve_the_equations(spark, monkeypatch, hot_keys):
    from lacuna.llm import shared

    monkeypatch.setattr(shared, "HOT_KEYS", hot_keys)
    rnd = random.Random(0)
    hosts = [f"h{k}.org" for k in range(12)]
    edges = Counter((rnd.choice(hosts), rnd.choice(hosts)) for _ in range(60))
    edges = {(a, b): n for (a, b), n in edges.items() if a != b} | {("h0.org", "h1.org"): 9, ("h1.org", "h0.org"): 9}
    seeds = {h: (rnd.randint(0, 3), rnd.randint(0, 2)) for h in hosts}
    got = url_filter.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, allowed long, blocked long"), spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, links long"), Scratch(spark, "test"))
    place = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((12, 12))
    for (a, b), n in edges.items():
        m[place[b], place[a]] = n

    def rank(matrix, seed):
        weight = matrix.sum(axis=0)
        matrix = np.divide(matrix, weight, out=np.zeros_like(matrix), where=weight > 0)
        return np.linalg.solve(np.eye(12) - 0.85 * matrix, 0.15 * seed / seed.sum())

    trust, distrust = rank(m, np.array([seeds[h][0] for h in hosts], float)), rank(m.T, np.array([seeds[h][1] for h in hosts], float))
    rows = got.collect()
    assert len(rows) == 12
    for r in rows:
        assert r.trust == pytest.approx(trust[place[r.host]], abs=1e-6) and r.distrust == pytest.approx(distrust[place[r.host]], abs=1e-6)


def test_verdicts_equal_sql_where_hosts_link_to_each_other(spark, tmp_path):
    import duckdb

    rnd = random.Random(4)
    hosts = [f"{'www.' if k % 3 else ''}h{k}.{'net' if k % 5 == 0 else 'org' if k % 7 == 0 else 'com'}" for k in range(40)]
    paths = ["/", "/en/x", "/fr/y?q=1", "/de/z#f", ""]
    link = lambda: f'<a class="k" HREF="http://{rnd.choice(hosts)}{rnd.choice(paths)}">x</a> <a href=\'/own\'>y</a>'
    rows = [(k, None if k % 50 == 0 else f"http://{hosts[0] if k % 3 == 0 else rnd.choice(hosts)}{rnd.choice(paths)}", None if k % 9 == 0 else " ".join(link() for _ in range(rnd.randint(0, 3)))) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in entries.op1_url_filter(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == Counter(db.sql(entries.oracle_sql()["op1_url_filter"]).fetchall())
    assert len({v for *_, v in got}) == 2


def test_links_give_standing(spark):
    html = '<p><a class="x" href="http://spam.net/a">x</a> <a href=//good.org/>y</a><a href="/self">z</a>'
    pages = spark.createDataFrame([(1, "http://quiet.com/", html), (2, "http://spam.net/a", None), (3, "http://other.com/", "<a href='http://quiet.com/x'>")], "page_id int, url string, html string")
    links = url_filter.host_links(pages.select(url_filter.host_of(F.col("url")).alias("host"), "html"))
    assert {(r.src, r.dst, r.links) for r in links.collect()} == {("quiet.com", "spam.net", 1), ("quiet.com", "good.org", 1), ("other.com", "quiet.com", 1)}
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert got[1].distrust > got[3].distrust > 0 and got[1].verdict == "block"



def test_verdicts_do_not_depend_on_the_number_of_chains(spark):
    page = lambda host, to: F.struct(F.concat(F.lit("http://" + host), "id", F.lit(".net/" if host == "bad" else ".com/")).alias("url"), F.concat(F.lit('<a href="http://' + to), "id", F.lit(".net/\">" if to == "bad" else ".com/\">")).alias("html"))
    for copies in (3, 140_000):  # of three hosts: far links to near, near to bad
        pages = spark.range(copies).select("id", F.explode(F.array(page("far", "near"), page("near", "bad"), page("bad", "bad"))).alias("p")).select(F.col("id").alias("page_id"), "p.url", "p.html")
        got = url_filter.judge(pages).groupBy(F.regexp_extract("host", "^[a-z]+", 0).alias("kind"), "verdict").count().collect()
        assert {(r.kind, r.verdict, r["count"]) for r in got} == {(kind, "block", copies) for kind in ("far", "near", "bad")}


def test_warc(spark):
    big = "<p>" + "é" * 100
    rows = [(5, "http://b.org/", big), (3, "http://a.org/x", big), (7, None, big), (1, "http://a.org/", None), (2, "http://a.org/", ""), (4, "http://a.org/", "short"), (6, "http://c.org/", "short"), (3, "http://a.org/x", big), (None, "http://z.org/", big), (8, "http://[bad", big + "!")]
    got = Counter(tuple(r) for r in warc.archive_and_read(spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, key string")).collect())
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and h == big and i != 3
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert got == want
    assert warc.archive_and_read(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_every_reference_in_the_archives_leads_to_its_payload(spark, monkeypatch, tmp_path):
    from lacuna.llm import shared

    monkeypatch.setattr(shared, "HOT_KEYS", 3)  # so the payload of half the pages is hot
    body = "<html>" + "same " * 40
    rows = [(k, f"http://h{k % 7}.org/{k}\t", body if k % 2 else f"{'own ' * 30}{k // 4}") for k in range(5, 85)] + [(None, None, body), (None, None, "alone " * 30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    scratch = Scratch(spark, "test")
    archives = scratch.path("archives")
    captures = warc.write_archives(*warc.plan_records(pages, scratch), archives).collect()
    records, store = {}, warc.CaptureIndex(archives, [])
    for c in captures:
        got = warc.parse(store.range(c.archive, c.offset, c.length))
        records[got.headers["WARC-Record-ID"]] = got
    assert len(records) == len({c.key for c in captures}) == len(rows)
    revisits = [r for r in records.values() if r.headers["WARC-Type"] == "revisit"]
    for r in revisits:
        named = records[r.headers["WARC-Refers-To"]]
        assert named.headers["WARC-Type"] == "response" and named.headers["WARC-Payload-Digest"] == r.headers["WARC-Payload-Digest"]
        assert named.headers["WARC-Target-URI"] == r.headers["WARC-Refers-To-Target-URI"]
    payloads = [h for _, _, h in rows]
    assert len(revisits) == len(payloads) - len(set(payloads))
    got = Counter((r.page_id, r.payload_bytes, r.refers_to) for r in warc.archive_and_read(pages).collect())
    assert got == Counter((i, len(h), None if (first := min((j for j, _, t in rows if t == h and j is not None), default=None)) == i else first) for i, _, h in rows)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 32))
    vectors = (np.repeat(centres, 40, axis=0) + 0.4 * rng.normal(size=(1200, 32))).astype(np.float32).astype(float)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)]
    rows += [(2000 + k, vectors[0].tolist(), 0) for k in range(8)]  # ties
    rows += [(3000, None, 0), (3050, [0.0] * 32, 0), (3100, [None] + [1.0] * 31, 0), (3150, [float("nan")] * 32, 0), (3200, [1.0, 2.0], 0), (None, vectors[1].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = defaultdict(dict)
    for r in neighbours.search(table, table.where("vec_id % 50 = 0"), 5).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    ids = np.array([r[0] for r in rows[:1208]])
    x = np.array([r[1] for r in rows[:1208]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        order = [k for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hits += len({int(ids[k]) for k in order} & {v for v, _ in got[q].values()})
        total += 5
    assert hits / total >= 0.9 and set(got) == set(ids[ids % 50 == 0].tolist())
    assert [v for v, _ in (got[0][k] for k in range(1, 6))] == [2000, 2001, 2002, 2003, 2004]
    two = table.where("vec_id IN (0, 1)")
    assert neighbours.search(two, two, 5).count() == 2
    assert neighbours.search(table.where("vec_id >= 3000"), table.where("vec_id = 3000"), 5).count() == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_and_rows_retrieved_on_embeddings(spark, folder):
    rows = [r for r in spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect() if r.embedding and len(r.embedding) == 64 and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, retrieved = defaultdict(set), {}
    for r in entries.op9_nearest_neighbours(spark, f"/root/testdata/{folder}").collect():
        got[r.query_id].add(r.vec_id)
        retrieved[r.query_id] = r.retrieved
    hits = [len(got[q] & set(ids[[k for k in np.argsort(-(x @ x[ids == q][0])) if ids[k] != q][:5]].tolist())) for q in ids[ids % 50 == 0].tolist()]
    recall, share = sum(hits) / (5 * len(hits)), sum(retrieved.values()) / len(retrieved) / len(ids)
    print(f"{folder}: recall {recall:.3f}, {share:.1%} of all rows retrieved for a query")
    assert recall >= 0.9 and share < 0.35


def test_neighbours_with_clashing_columns_and_no_rows(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)], "c", k, 1.0, [1]) for k in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, vector string, query_id bigint, score double, code array<int>")
    got = neighbours.search(table, table.where("vec_id % 20 = 0"), 5).collect()
    assert Counter(r.query_id for r in got) == {0: 5, 20: 5, 40: 5}
    empty = table.where("false")
    assert neighbours.search(empty, empty, 5).collect() == [] and neighbours.search(table, empty, 5).collect() == []


def test_neighbours_of_every_length(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=8).tolist() for _ in range(40)] + [rng.normal(size=3).tolist() for _ in range(12)]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    got = Counter(r.query_id for r in neighbours.search(table, table, 5).collect())
    assert got == {i: 5 for i in range(52)}


def test_sharding(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    for k in range(5):
        store.append(documents(spark, [(100 * k + j, f"text {k} {j}") for j in range(40)]).coalesce(2))
    assert store.version() == 5 and store.manifest().count() == 10 and store.manifest(2).count() == 4
    before = store.read(5).select("doc_id").collect()
    store.compact(target=1 << 20)
    assert store.manifest().count() == 1 and store.version() > 5
    assert sorted(store.read().select("doc_id").collect()) == sorted(before) and len(before) == 200
    assert store.read(5).count() == 200  # an older version stays readable
    store.vacuum()
    assert store.read().count() == 200 and store.compact() == store.version()
    with pytest.raises(sharding.CommitConflict):
        store.commit(store.manifest(), store.version() - 1)
    with pytest.raises(FileNotFoundError):
        sharding.ShardStore(spark, f"file://{tmp_path}/none").read()


def test_sharding_of_awkward_tables(spark, tmp_path):
    names = "doc_id bigint, text string, shard string, shard_bytes bigint, generation int, __merge_group string, _metadata string"
    rows = [(k, None if k % 3 == 0 else "x" * (20_000 if k == 5 else k), "own", 1, 2, "mine", "meta") for k in [*range(30), 4, 4]] + [(None, "", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, names)
    store = sharding.shard([docs.where("false"), docs.repartition(4), docs.where("false")], f"file://{tmp_path}/store")
    assert Counter(store.read().collect()) == Counter(docs.collect()) and store.read().schema == docs.schema
    told = store.read(described=True)
    assert told.columns == [*docs.columns, "shard_", "shard_bytes_", "generation_"] and told.count() == len(rows)
    empty = sharding.shard([docs.where("false")], f"file://{tmp_path}/empty")
    assert empty.read().collect() == [] and empty.read(described=True).collect() == [] and empty.read().columns == docs.columns
    with pytest.raises(ValueError):
        store.append(docs.drop("text"))


def test_compaction_keeps_to_the_target(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    rnd = random.Random(0)
    rows = [(k, "".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(200))) for k in range(2000)]
    store.append(spark.createDataFrame(rows[:1500], "doc_id bigint, text string").coalesce(1))
    store.append(spark.createDataFrame(rows[1500:], "doc_id bigint, text string").repartition(30))
    target = 60_000
    assert store.oversized(target).count() == 1
    runs = defaultdict(int)
    sizes = {r.shard: r.bytes for r in store.manifest().collect()}
    for r in store.plan(target).collect():
        runs[r.merge_group] += sizes[r.shard]
    assert runs and max(runs.values()) < 2 * target  # no task reads more
    store.compact(target)
    after = [r.bytes for r in store.manifest().collect()]
    assert max(after) <= 2 * target and len(after) < 31 and store.oversized(target).isEmpty()
    assert Counter(map(tuple, store.read().collect())) == Counter(rows)


def test_vacuum_leaves_writers_at_work_alone(spark, tmp_path):
    store, docs = sharding.ShardStore(spark, f"file://{tmp_path}/store"), documents(spark, [(1, "a"), (2, "b")])
    store.append(docs)
    with store._writing() as folder:
        docs.write.parquet(folder)
        added = store._measured(folder, 0)
        added.collect()
        store.vacuum()  # between the write and the commit of another writer
        store._change(added, [])
    store.vacuum()
    assert store.read().count() == 4 and store.version() == 2
    other = sharding.ShardStore(spark, store.root)
    base = other.version()
    store.append(docs)
    other.append(docs)  # commits after a version that it has not seen begin
    assert other.version() == base + 2 and other.read().count() == 8


# -- models on the given tables -----------------------------------------------------------------

DATA = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = entries.op2_quality_classifier(spark, DATA)
    rows = got.where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("predicted", "quality", "score").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    assert got.count() == 1000


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 0), (6, None, 0), (3, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(documents(spark, AWKWARD), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert quality.classify(documents(spark, AWKWARD).where("false"), labels).count() == 0
    assert quality.classify(documents(spark, AWKWARD), labels.where("false")).count() == len(AWKWARD)


def test_language_on_held_out_rows(spark):
    got = entries.op3_language_id(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


def test_every_language_is_learned(spark):
    rnd = random.Random(5)
    rows = [(10 * k + j, " ".join("".join(chr(0x4E00 + 40 * k + rnd.randrange(40)) for _ in range(4)) for _ in range(30)), f"l{k:03}") for k in range(230) for j in range(8 if k < 200 else 6)]
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(documents(spark, rows)).collect()}
    right = Counter(lang for i, _, lang in rows if got[i] == lang)
    assert len(right) == 230 and sum(right.values()) > 0.95 * len(rows)


def test_letters_beyond_the_first_plane_tell_languages_apart(spark):
    rnd = random.Random(6)
    rows = [(10 * k + j, "".join(chr(start + rnd.randrange(30)) for _ in range(200)), f"l{k}") for k, start in enumerate((0x10400, 0x10330, 0x12000)) for j in range(9)]
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(documents(spark, rows)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= len(rows) - 1


def test_whole_texts_teach_languages(spark):
    rnd = random.Random(7)
    rows = [(k, "12345 " * 1000 + " ".join(rnd.choice(words) for _ in range(80)), lang) for k, (lang, words) in enumerate([("aa", ["mor", "lat", "vex"]), ("bb", ["schu", "ung", "keit"])] * 40)]
    rows += [rows[0]] * 30  # one document again and again is drawn once
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(documents(spark, rows)).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_stages_keep_columns_of_their_own_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).withColumns({c: F.lit("own") for c in ("quality_score", "lang_pred", "lang_score", "_file", "_row")})
    for stage in (quality.keep_accepted, language.keep_identified, exact_dedup.first_of_each, near_duplicates.one_of_each):
        left = stage(spark, docs, DATA)
        assert left.schema == docs.schema and {r for r in left.select("quality_score", "lang_pred", "lang_score", "_file", "_row").distinct().collect()} == {("own",) * 5}


def test_language_of_awkward_rows(spark):
    rows = [(i, t, "de" if k % 2 else None) for k, (i, t) in enumerate(AWKWARD)]
    got = language.predict_languages(documents(spark, rows)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"de", "und"}
    assert {r.lang_pred for r in got if r.doc_id in (8, 9, 7)} == {"und"}
    assert language.predict_languages(documents(spark, rows).where("false")).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    source, folder = "/root/testdata/sf0.001", tmp_path / "small"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in entries.op2_quality_classifier(spark, str(folder)).where("predicted = 1").collect()}
    known = {r.doc_id for r in entries.op3_language_id(spark, str(folder)).where(f"lang_pred != 'und' AND score >= {language.ACCEPT}").collect()}
    first = {}
    for i in sorted(good & known):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    rows = [(i, texts[i]) for i in first.values()]
    left = {i for i, n, c in brute_components(rows) if i == c or n == 0}
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert {r.doc_id for r in got} == left
    encoder = packing.WordEncoder(packing.default_tokenizer())
    for i in left:
        ids = encoder.ids(texts[i]) + b"\x01\0\0\0"
        assert sum(r.length for r in got if r.doc_id == i) == len(ids) // 4
    assert json.dumps([name for name, _ in corpus_pipeline.STAGES])
