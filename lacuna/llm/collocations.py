"""Collocations: frequent phrases of each language whose words occur together more often than apart.

Counting, by pivots: a phrase belongs to the rarest of its words (its pivot; of equally frequent words the one with the larger
number). A text is cut at words that are too rare to be in any frequent phrase. For each place of a pivot a
*fragment* goes to the pivot's bucket: the pivot and up to four words on either side, as far as they are more frequent than it
(on the right also the pivot itself again), so that each occurrence of a phrase lies in one fragment of its pivot only,
around the first place where it has it. A bucket counts the phrases of its pivots by growing them word by word, to the right and then to the left,
from those that are frequent so far, and gives only phrases that its pivots own. Pivots with more than ``HOT_WORDS``
occurrences have few words above them: phrases of such words only are counted in each chunk and summed by phrase instead, so
no bucket gets an unbounded share.

Scores and redundant phrases are joins of the table of frequent phrases, which is small against the corpus.

Texts are read once, into chunks of word numbers; words and their counts come from one exchange of each chunk's distinct
words (see ``chunks``). Texts longer than a piece are cut with four words of overlap, whose phrases are counted once more and taken off again.

Defined cases: null texts are empty, null languages are ``und``; ids play no part, repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.llm import chunks as sizes
from lacuna.llm.chunks import Splitter, by_bucket, chunks, distinct, mix, pack, runs, unpack
from lacuna.llm.shared import Scratch, free_shuffles, released, session_of

#: Words of the longest phrase; occurrences of a phrase; percent of its occurrences inside a longer phrase that make it redundant; phrases of a language.
LONGEST, LEAST, COVERED, PHRASES = 5, 100, 100, 2000
#: Occurrences above which a pivot's phrases are counted in the chunks; tokens of the corpus for one bucket.
HOT_WORDS, BUCKET_TOKENS = 1 << 21, 1 << 21

WORDS = Splitter(b" \t", b".,;:!?\n\v\f\r")


@lru_cache(maxsize=4096)
def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


# -- chunks ---------------------------------------------------------------------------------


def _chunked(docs: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """Rows of two kinds for each chunk: its tokens, and its distinct words with language, count and text."""
    limits = (sizes.CHUNK_BYTES, sizes.PIECE_BYTES)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            for batch in batches:
                for k in range(batch.num_rows):
                    yield (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), batch.column(2)[k].as_buffer().to_pybytes()

        for n, chunk in enumerate(chunks(texts(), WORDS, longest - 1, *limits)):
            langs = sorted({lang for _, lang in chunk.rows})
            lang_of_row = np.array([langs.index(lang) for _, lang in chunk.rows])
            lang = lang_of_row[np.array([p.row for p in chunk.pieces])][chunk.piece_of]
            keys = mix(chunk.hashes + np.array([_salt(x) for x in langs], np.uint64)[lang])
            hashes, first, place = np.unique(keys, return_index=True, return_inverse=True)
            # What the piece before has counted already, once more, to be taken off.
            ahead = np.array([p.ahead for p in chunk.pieces])
            at_piece = np.searchsorted(chunk.piece_of, chunk.piece_of)
            again = np.flatnonzero(np.arange(len(place)) - at_piece < ahead[chunk.piece_of])
            stretch = np.concatenate([chunk.stretch, chunk.stretch[again] + (chunk.stretch[-1] + 1 if len(place) else 0)])
            opens = np.zeros(len(stretch), bool)
            opens[runs(stretch)] = True
            tokens = np.concatenate([place, place[again]])
            off = np.arange(len(tokens)) >= len(place)
            counts = np.bincount(place, minlength=len(hashes)) - np.bincount(place[again], minlength=len(hashes))
            words = [chunk.word(i) for i in first]
            letters = np.frombuffer(b"".join(words), np.uint8)
            number = chunk.rows[0][0] * 512 + n % 512  # as in katz
            bodies = pack(np.array([len(hashes)]), tokens, opens, off), pack(hashes, counts, lang[first], np.array([len(w) for w in words], np.int64), letters)
            yield pa.record_batch([pa.array(["tokens", "words"]), pa.array([number] * 2, pa.int64()), pa.array([None, langs], pa.list_(pa.string())), pa.array(bodies, pa.binary())], names=["kind", "chunk", "langs", "body"])

    return scratch.keep(rows.mapInArrow(released(run), "kind string, chunk bigint, langs array<string>, body binary"), "chunks", "kind", compression="zstd")


def _word_messages(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            hashes, counts, lang, size, letters = unpack(row["body"])
            begin = np.cumsum(size) - size
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ranges, so that a chunk's answers follow each other
            for b, mine in by_bucket(bucket):
                lo, hi = mine[0], mine[-1] + 1
                body = pack(hashes[lo:hi], counts[lo:hi], lang[lo:hi], size[lo:hi], letters[begin[lo] : begin[hi - 1] + size[hi - 1]].astype(np.int64))
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([row["langs"]], pa.list_(pa.string())), pa.array([body])], names=["bucket", "chunk", "langs", "body"])


_WORD_TABLE = "kind string, bucket int, chunk bigint, body binary, number bigint, lang string, word string, count bigint"


def _merge_words(least: int, buckets: int):
    """A bucket's words: those that are frequent, an answer to each chunk, and how many words each language has."""

    def table(kind: str, bucket: int, n: int, **given) -> pa.Table:
        types = {"chunk": pa.int64(), "body": pa.binary(), "number": pa.int64(), "lang": pa.string(), "word": pa.string(), "count": pa.int64()}
        fixed = {"kind": pa.array([kind] * n, pa.string()), "bucket": pa.array([bucket] * n, pa.int32())}
        return pa.table(fixed | {c: pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in types.items()})

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        came = [unpack(b.as_py()) for b in group.column("body")]
        langs = sorted({x for names in group.column("langs").to_pylist() for x in names})
        own = [np.array([langs.index(x) for x in names])[m[2]] for names, m in zip(group.column("langs").to_pylist(), came)]
        hashes, counts, lang = np.concatenate([m[0] for m in came]), np.concatenate([m[1] for m in came]), np.concatenate(own)
        known, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, counts)
        often = total >= least
        number = np.where(often, np.cumsum(often) * buckets + bucket, 0)
        edges = np.cumsum([0, *(len(m[0]) for m in came)])
        words = []
        for i in first[often]:
            m = int(np.searchsorted(edges, i, side="right")) - 1
            at = i - edges[m]
            begin = int(came[m][3][:at].sum())
            words.append(came[m][4][begin : begin + came[m][3][at]].astype(np.uint8).tobytes().decode())
        sums = np.zeros(len(langs), np.int64)
        np.add.at(sums, lang, counts)
        bodies = [pack(np.where(often, total, 0)[place[lo:hi]], number[place[lo:hi]]) for lo, hi in zip(edges, edges[1:])]
        return pa.concat_tables(
            [
                table("word", bucket, len(words), number=number[often], lang=[langs[x] for x in lang[first[often]]], word=words, count=total[often]),
                table("total", bucket, len(langs), lang=langs, count=sums),
                table("answer", bucket, len(came), chunk=group.column("chunk").to_pylist(), body=bodies),
            ]
        )

    return run


# -- fragments ------------------------------------------------------------------------------


def fragments(rank: np.ndarray, opens: np.ndarray, chosen: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pivots, and how many words to the left and right belong to their fragments.

    ``rank``: 0 is the most frequent word, -1 too rare; ``opens``: where a stretch begins; ``chosen``: places that may be pivots.
    """
    n = len(rank)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    on = chosen & (rank >= 0)
    ok = on.copy()
    for k in range(1, min(reach, n - 1) + 1):
        ok[:k] = False
        ok[k:] &= ~opens[1 : n - k + 1] & (rank[: n - k] >= 0) & (rank[: n - k] < rank[k:])
        left += ok
    ok = on.copy()
    for k in range(1, min(reach, n - 1) + 1):
        ok[n - k :] = False
        ok[: n - k] &= ~opens[k:] & (rank[k:] >= 0) & (rank[k:] <= rank[: n - k])
        right += ok
    places = np.flatnonzero(on & (left + right > 0))
    return places, left[places], right[places]


def phrases_around(pivot: np.ndarray, left: np.ndarray, right: np.ndarray, sign: np.ndarray, words: np.ndarray, least: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The frequent phrases of fragments, as (rows of words, counts), for each length to the left and right of the pivot.

    ``words`` has each fragment's words but the pivot: those on the left from the pivot on, then those on the right.
    """
    begin = np.cumsum(left + right) - left - right
    width = int(max(words.max(initial=0), pivot.max(initial=0))) + 1
    alive: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {(0, 0): (np.arange(len(pivot)), distinct(pivot)[1])}

    def word(at: np.ndarray, side: int, k: int) -> np.ndarray:
        return words[begin[at] + (k - 1 if side < 0 else left[at] + k - 1)]

    for most in range(longest):
        for r in range(longest - most):
            if most == r == 0:
                continue
            side, k = (-1, most) if most else (1, r)
            at, key = alive.get((most - 1, r) if most else (0, r - 1), (None, None))
            if at is None:
                continue
            has = (left if most else right)[at] >= k
            at, key = at[has], key[has]
            if not len(at):
                continue
            if int(key.max()) * width >= 1 << 62:  # numbers too large for one key
                every, small = distinct(word(at, side, k))
                key = key * len(every) + small
            else:
                key = key * width + word(at, side, k)
            _, place = distinct(key)
            count = np.bincount(place, np.where(sign[at], -1, 1)).astype(np.int64)
            often = count >= least
            keep = often[place]
            at, place = at[keep], (np.cumsum(often) - 1)[place[keep]]
            if not len(at):
                continue
            alive[most, r] = at, place
            one = np.zeros(int(often.sum()), np.int64)
            one[place] = at
            yield np.stack([*(word(one, -1, j) for j in range(most, 0, -1)), pivot[one], *(word(one, 1, j) for j in range(1, r + 1))], axis=1), count[often]


_SENT = "kind string, bucket int, body binary, words array<bigint>, count bigint"


def _sent(kind: str, n: int, **given) -> pa.Table:
    types = {"bucket": pa.int32(), "body": pa.binary(), "words": pa.list_(pa.int64()), "count": pa.int64()}
    return pa.table({"kind": pa.array([kind] * n, pa.string())} | {c: given[c] if c in given else pa.nulls(n, t) for c, t in types.items()})


def _rows_of(words: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel()))


def _dealt(row: dict, answers: pa.Table, hot: int, buckets: int, longest: int) -> pa.Table:
    """A chunk's fragments by bucket, and its phrases of hot words only."""
    (n,), token, opens, off = unpack(row["body"])
    answer = [unpack(b) for b in answers.sort_by("bucket").column("body").to_pylist()]
    count, number = (np.concatenate([a[i] for a in answer]) if answer else np.zeros(0, np.int64) for i in (0, 1))
    rank = np.full(n, -1)
    order = np.lexsort((number, -count))
    rank[order] = np.where(count[order] > 0, np.arange(n), -1)
    out = []
    at, left, right = fragments(rank[token], opens, count[token] <= hot, longest - 1)
    pivot = number[token[at]]
    bucket = (mix(pivot.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pivot, bucket))
    at, left, right, pivot, bucket = at[order], left[order], right[order], pivot[order], bucket[order]
    size = left + right
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    mid, reach = np.repeat(at, size), np.repeat(left, size)
    words = number[token[np.where(step < reach, mid - 1 - step, mid + 1 + step - reach)]]
    begin = np.append(0, np.cumsum(size))
    edges = np.append(runs(bucket), len(bucket))
    bodies = [pack(np.diff(pivot[lo:hi], prepend=0), left[lo:hi] * 8 + right[lo:hi], off[at[lo:hi]], words[begin[lo] : begin[hi]]) for lo, hi in zip(edges, edges[1:])]
    out.append(_sent("fragments", len(bodies), bucket=pa.array(bucket[edges[:-1]].astype(np.int32)), body=pa.array(bodies, pa.binary())))
    is_hot = count[token] > hot
    start, key, held = np.flatnonzero(is_hot), token[is_hot], [token[is_hot]]
    for k in range(1, longest):
        on = start + k < len(token)
        on[on] &= is_hot[start[on] + k] & ~opens[start[on] + k]
        start, key, held = start[on], key[on], [h[on] for h in held]
        if not len(start):
            break
        held.append(token[start + k])
        _, first, key = np.unique(key * n + held[-1], return_index=True, return_inverse=True)
        sums = np.bincount(key, np.where(off[start], -1, 1)).astype(np.int64)
        out.append(_sent("hot", len(first), words=_rows_of(number[np.stack([h[first] for h in held], axis=1)]), count=pa.array(sums)))
    return pa.concat_tables(out)


def _mined(least: int, longest: int):
    def run(group: pa.Table) -> pa.Table:
        came = [unpack(b.as_py()) for b in group.column("body")]
        pivot, both, off, words = np.concatenate([np.cumsum(m[0]) for m in came]), *(np.concatenate([m[i] for m in came]) for i in (1, 2, 3))
        out = [pa.table({"words": pa.array([], pa.list_(pa.int64())), "count": pa.array([], pa.int64())})]
        for found, count in phrases_around(pivot, both >> 3, both & 7, off, words, least, longest):
            out.append(pa.table({"words": _rows_of(found), "count": pa.array(count)}))
        return pa.concat_tables(out)

    return run


# -- the operator ---------------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (number, lang, word, count), words of each language (lang, count), and frequent phrases of two and more words (numbers, count)."""
    spark = session_of(docs)
    made = _chunked(docs, longest, scratch)
    tokens, words = (made.where(F.col("kind") == kind).drop("kind") for kind in ("tokens", "words"))
    size = tokens.select(F.sum(F.length("body"))).first()[0] or 0
    hot, buckets = HOT_WORDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_TOKENS))  # a token takes one to two bytes
    sent = words.mapInArrow(released(lambda batches: _word_messages(batches, buckets)), "bucket int, chunk bigint, langs array<string>, body binary")
    merged = scratch.keep(sent.groupBy("bucket").applyInArrow(_merge_words(least, buckets), _WORD_TABLE), "words", "kind", compression="zstd")
    scratch.drop("chunks/kind=words")
    answers = merged.where("kind = 'answer'").select("bucket", "chunk", "body")

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([_dealt(row, right, hot, buckets, longest) for row in left.to_pylist()])

    dealt = scratch.keep(tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(deal, _SENT), "dealt", "kind", compression="zstd")
    free_shuffles(spark)
    cold = dealt.where("kind = 'fragments'").select("bucket", "body").groupBy("bucket").applyInArrow(_mined(least, longest), "words array<bigint>, count bigint")
    warm = dealt.where("kind = 'hot'").groupBy("words").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    phrases = scratch.keep(cold.unionByName(warm), "phrases")
    scratch.drop("dealt", "chunks")
    free_shuffles(spark)
    totals = merged.where("kind = 'total'").groupBy("lang").agg(F.sum("count").alias("count"))
    return merged.where("kind = 'word'").select("number", "lang", "word", "count"), totals, phrases


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, limit: int = PHRASES) -> DataFrame:
    """The best ``limit`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    a: occurrences of the phrase, n: of all words; l and r: of both parts at the cut with the lowest score floor(1000 a n / (l r)), of equal ones the first.
    A phrase is redundant if ``covered`` percent of its occurrences or more are inside one longer frequent phrase.
    """
    scratch = Scratch(session_of(docs), "collocations")
    words, totals, phrases = frequent_phrases(docs, scratch, least, longest)
    size = F.size("words")
    parts = phrases.unionByName(words.select(F.array("number").alias("words"), "count"))
    cuts = phrases.select("words", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("words", "a", "k", F.slice("words", 1, F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select(F.col("words").alias("first"), F.col("count").alias("l")), "first").join(parts.select(F.col("words").alias("rest"), F.col("count").alias("r")), "rest")
    of_lang = words.select(F.col("number").alias("opening"), "lang").join(totals.select("lang", F.col("count").alias("n")), "lang")
    cuts = cuts.withColumn("opening", F.element_at("words", 1)).join(of_lang, "opening")
    whole = [f"CAST({c} AS DECIMAL(18, 0))" for c in "anlr"]  # products of two have 36 digits
    cuts = cuts.withColumn("score", F.expr(f"(1000 * {whole[0]} * {whole[1]}) DIV ({whole[2]} * {whole[3]})"))
    best = cuts.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("lang").alias("lang"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m)))))
    inside = phrases.where(size > 2).select(inner.alias("words"), "count").groupBy("words").agg(F.max("count").alias("longer"))
    left = best.join(inside, "words", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    spelt = left.select("words", F.posexplode("words").alias("place", "number")).join(words.select("number", "word"), "number")
    spelt = spelt.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # ``longest`` words
    ranked = left.join(spelt, "words").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
