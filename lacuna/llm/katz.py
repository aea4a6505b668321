"""Language-model scores by Katz backoff, for any order.

Model: of counts up to ``DISCOUNTED`` a share is taken by Good-Turing's rule (counts of counts of all n-grams of that
length), and what is taken from the words seen after a context goes to the words that were not, in proportion to
their probability after the context shortened by its first word: P(w | h) = d(c) c(hw) / c(h) if hw was seen, else
b(h) P(w | h'). b(h) = (1 - sum of P(. | h) over the words seen) / (1 - sum of P(. | h') over the same words), so that P
sums to exactly 1 over all known words, the end, and one unknown word, whose probability is what the discounts of single
words leave. A context none of whose words is discounted counts one more occurrence, which nothing has. Discounts
that the counts of counts don't support (d outside (0, 1), a count that does not occur) make the range of discounted counts smaller.

Scale: texts are read once, into chunks of word numbers. Level by level (words, pairs, ...), each chunk sends its distinct
n-grams, with how often the texts to learn from have them, to buckets by their context; a bucket merges what it gets into its
part of the level's table and answers with counts and the sums behind b. One exchange a level, of distinct n-grams by chunk;
no text moves, and what is exchanged grows with the corpus, not with its square. A context with more than ``BUCKET_TOKENS`` occurrences
is spread over several buckets by its words; its sums are added up afterwards and joined to the chunks that have it.

The tables are kept as Parquet, partitioned by what they hold: a row for each context (and part) with its words, their
counts and its sums. ``Katz.score`` reads them instead of counting again.

Defined cases: null texts are empty (their only token is the end); null ids are allowed, repeated rows each count and each
get a row; with nothing to learn from, every token is the one unknown word, with probability 1. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import chunks as sizes
from lacuna.llm.chunks import Splitter, by_bucket, chunks, distinct, mix, pack, runs, unpack
from lacuna.llm.shared import Scratch, free_shuffles, released, session_of

ORDER = 2
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Tokens of the corpus for one bucket of a table; contexts that occur more often are spread.
BUCKET_TOKENS = 1 << 21

WORDS = Splitter(b" \t\n\v\f\r")
_END = int(mix(np.array([0x656E64], np.uint64))[0])
#: Numbers of the context before a text and of all n-grams that no table has; others are larger.
_BEFORE, _UNSEEN = 0, 1

_STATE = "kind string, chunk bigint, row_id array<bigint>, doc_id array<bigint>, learned array<boolean>, body binary"
_MERGED = "kind string, level int, bucket int, chunk bigint, body binary, ctx bigint, spread boolean, total bigint, few array<bigint>, lower double, words array<bigint>, counts array<bigint>"
_NAMES = [x.split()[0] for x in _MERGED.split(", ")]


def discounts(few: list[int]) -> np.ndarray:
    """What is left of the counts 0, 1, ... ``DISCOUNTED``, from how many n-grams occur 1, 2, ... ``DISCOUNTED`` + 1 times."""
    n = [0, *few]
    for top in range(DISCOUNTED, 0, -1):
        if all(n[1 : top + 1]):
            common = (top + 1) * n[top + 1] / n[1]
            left = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 1 for r in range(1, top + 1)]
            if all(0 < d < 1 for d in left):
                return np.array([1.0, *left, *[1.0] * (DISCOUNTED - top)])
    return np.ones(DISCOUNTED + 1)


def kept_share(counts: np.ndarray, left: np.ndarray) -> np.ndarray:
    return left[np.where(counts <= DISCOUNTED, counts, 0)]


def totals_and_mass(total: np.ndarray, few: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts are divided by, and the probability left for other words. ``few``: how many words occur 1, 2, ... times."""
    taken = few @ ((1 - left[1:]) * np.arange(1, DISCOUNTED + 1))
    whole = total + (taken <= 0)
    return whole, np.where(taken > 0, taken, 1.0) / np.maximum(whole, 1)


# -- chunks ---------------------------------------------------------------------------------


def _chunked(docs: DataFrame, learn: Column, order: int, scratch: Scratch) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learned"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    limits = (sizes.CHUNK_BYTES, sizes.PIECE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            for batch in batches:
                for k in range(batch.num_rows):
                    yield tuple(batch.column(c)[k].as_py() for c in range(3)), batch.column(3)[k].as_buffer().to_pybytes()

        for n, chunk in enumerate(chunks(texts(), WORDS, order - 1, *limits)):
            last = np.array([p.last for p in chunk.pieces])
            words = np.bincount(chunk.piece_of, minlength=len(chunk.pieces))
            tokens = np.full(len(chunk.hashes) + last.sum(), _END, np.uint64)
            tokens[np.arange(len(chunk.hashes)) + (np.cumsum(last) - last)[chunk.piece_of]] = chunk.hashes
            hashes, place = distinct(tokens)
            size, ahead, row = words + last, np.array([p.ahead for p in chunk.pieces]), np.array([p.row for p in chunk.pieces])
            counts = _counted(size, ahead) & np.array([r[2] for r in chunk.rows])[np.repeat(row, size)]
            given = np.bincount(place[counts], minlength=len(hashes))
            # Unique: the first row's number holds the task's, and a text (2 GB at most) reaches over fewer chunks.
            number = chunk.rows[0][0] * 512 + n % 512
            bodies = pack(np.array([len(hashes)]), place, size, ahead, row), pack(hashes, given)
            yield pa.record_batch([pa.array(["tokens", "words"]), pa.array([number] * 2, pa.int64()), *(pa.array([list(c), None]) for c in zip(*chunk.rows)), pa.array(bodies, pa.binary())], schema=schema)

    schema = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("row_id", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("learned", pa.list_(pa.bool_())), ("body", pa.binary())])
    return scratch.keep(rows.mapInArrow(released(run), _STATE), "chunks", "kind", compression="zstd")


def _counted(size: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Of each token, whether it is more than the context of what follows."""
    piece = np.repeat(np.arange(len(size)), size)
    return np.arange(len(piece)) - (np.cumsum(size) - size)[piece] >= ahead[piece]


def _bucket_of_hash(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so that sorted words lie bucket by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass
class Level:
    """What a chunk knows of its distinct n-grams of one length."""

    of_token: np.ndarray  # place of the n-gram that ends at each token, -1 if the text has no such context
    ctx: np.ndarray  # place of the context among those of the level below
    word: np.ndarray
    seen: np.ndarray  # in the chunk, in texts to learn from
    shorter: np.ndarray  # place of the n-gram without its first word, in the level below
    count: np.ndarray | None = None
    number: np.ndarray | None = None
    whole: np.ndarray | None = None  # what the count is divided by
    prob: np.ndarray | None = None  # 0: not in the table
    back: np.ndarray | None = None


@dataclass(frozen=True)
class Facts:
    """What is known of the whole of each level before the next: discounts; of words also tokens and distinct ones."""

    left: tuple[np.ndarray, ...] = ()
    tokens: int = 0
    words: int = 0
    texts: int = 0
    unknown: float = 1.0
    buckets: int = 1
    spread_from: int = BUCKET_TOKENS

    def whole(self) -> int:
        """What counts of words are divided by."""
        return max(1, self.tokens + bool((self.left[0][1:] == 1).all()))


class View:
    """A chunk, with what the tables have answered so far."""

    def __init__(self, row: dict, answers: pa.Table, facts: Facts, order: int):
        self.facts, self.order = facts, order
        (self.n,), self.word, size, ahead, row_of = unpack(row["body"])
        begin = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(size)), size)
        self.row = row_of[piece]
        self.counts = _counted(size, ahead)
        self.learned = np.array(row["learned"], bool)[self.row] & self.counts
        self.first = begin[size > 0]
        self.opens = (ahead < max(1, order - 1))[size > 0]
        n = self.n
        given = np.bincount(self.word[self.learned], minlength=n)
        self.levels = [Level(self.word, np.zeros(n, np.int64), np.arange(n), given, np.arange(n))]
        known = answers.column("level").to_numpy() if answers.num_rows else np.zeros(0, int)
        for k in range(1, len(facts.left) + 1):
            if k > 1:
                self.levels.append(self._longer(self.levels[-1], k))
            self._answered(k, answers.filter(pa.array(known == k)))
            if k == 1:
                self._reorder()

    def _reorder(self) -> None:
        """Words in the order of their numbers, so that messages are sorted runs."""
        at = self.levels[0]
        order = np.argsort(at.number, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.word = place[self.word]
        self.levels[0] = Level(self.word, at.ctx, np.arange(len(order)), at.seen[order], np.arange(len(order)), at.count[order], at.number[order], None, at.prob[order], at.back)

    def _longer(self, below: Level, k: int) -> Level:
        n = self.n
        ctx = np.concatenate([[-1], below.of_token])[: len(self.word)]
        ctx[self.first] = np.where(self.opens & (k == 2), n, -1)
        fits = ctx >= 0
        keys, place = distinct(ctx[fits] * n + self.word[fits])
        of_token = np.full(len(ctx), -1)
        of_token[fits] = place
        shorter = np.zeros(len(keys), np.int64)
        shorter[place] = below.of_token[fits]
        return Level(of_token, keys // n, keys % n, np.bincount(of_token[self.learned & fits], minlength=len(keys)), shorter)

    def _dealt(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams asked for, in the order of messages: their places, contexts, buckets, and whether the context is spread."""
        facts = self.facts
        ctx, word = self._numbers(k)
        size = self._context_counts(k)
        places = np.flatnonzero(ctx != _UNSEEN)
        ctx, word, parts = ctx[places], word[places], -(-size[places] // facts.spread_from)
        part = mix(word.astype(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)
        bucket = (mix(ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part) % np.uint64(facts.buckets)).astype(np.int64)
        return places, ctx, bucket, parts > 1  # n-grams are in the order of their contexts

    def _numbers(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.levels[k - 1]
        below = np.append(self.levels[k - 2].number, _BEFORE) if k == 2 else self.levels[k - 2].number
        return below[at.ctx], self.levels[0].number[at.word]

    def _context_counts(self, k: int) -> np.ndarray:
        below = self.levels[k - 2].count
        if k == 2:
            below = np.append(below, self.facts.texts)
        return below[self.levels[k - 1].ctx]

    def messages(self, k: int) -> Iterator[tuple[int, bytes]]:
        """To the buckets of level ``k``, 2 or more."""
        self.levels.append(self._longer(self.levels[-1], k))
        at = self.levels[k - 1]
        places, ctx, bucket, spread = self._dealt(k)
        word = self._numbers(k)[1]
        below = self.levels[k - 2]
        lower = np.where(at.seen > 0, below.count[at.shorter], 0)
        whole = np.where(lower > 0, below.whole[at.shorter], 0) if k > 2 else np.zeros_like(lower)  # of words, buckets know it
        for b, mine in by_bucket(bucket):
            here = places[mine]
            yield b, pack(np.diff(ctx[mine], prepend=0), word[here], at.seen[here], lower[here], whole[here], spread[mine])

    def _answered(self, k: int, answers: pa.Table) -> None:
        at, facts = self.levels[k - 1], self.facts
        left, n = facts.left[k - 1], len(at.word)
        at.count, at.number, at.back = np.zeros(n, np.int64), np.full(n, _UNSEEN), np.ones(n)
        whole = np.full(n, 1.0)
        rows = answers.select(["bucket", "body", "ctx", "total", "few", "lower"]).to_pylist()
        bodies = {r["bucket"]: r["body"] for r in rows if r["body"] is not None}
        apart = {r["ctx"]: (r["total"], np.array(r["few"]), r["lower"]) for r in rows if r["body"] is None}
        if k == 1:
            given = [unpack(bodies[b]) for b in sorted(bodies)]  # sorted words lie bucket by bucket
            at.count[:] = np.concatenate([count for count, _ in given] or [[]])
            if given and len(given[0][1]):
                at.number[:] = np.concatenate([number for _, number in given])
            # As for contexts: nothing discounted, one more.
            at.prob = kept_share(at.count, left) * at.count / facts.whole()
            return
        places, ctx, bucket, spread = self._dealt(k)
        for b, mine in by_bucket(bucket):
            here, own = places[mine], ctx[mine]
            count, number, *sums = unpack(bodies[b])
            at.count[here] = count
            if len(number):
                at.number[here] = number
            new = runs(own)
            total, lower, few = sums[0], sums[1], np.stack(sums[2:], axis=1).reshape(-1, DISCOUNTED)
            for i in np.flatnonzero(spread[mine][new]):
                if (found := apart.get(int(own[new[i]]))) is not None:
                    total[i], few[i], lower[i] = found
            size = np.diff([*new, len(own)])
            divide, mass = totals_and_mass(total, few, left)
            at.back[here] = np.repeat(np.where(total > 0, mass / (1 - lower), 1.0), size)
            whole[here] = np.repeat(divide, size)
        at.whole, at.prob = whole.astype(np.int64), kept_share(at.count, left) * at.count / whole

    def log_probabilities(self) -> np.ndarray:
        """log10 of each token's probability: the longest n-gram in the tables, after the weights of the contexts given up."""
        out, open_ = np.zeros(len(self.word)), np.ones(len(self.word), bool)
        for k in range(len(self.levels), 1, -1):
            at = self.levels[k - 1]
            has = np.flatnonzero(open_ & (at.of_token >= 0))
            gram = at.of_token[has]
            found = at.prob[gram] > 0
            out[has] += np.log10(np.where(found, at.prob[gram], at.back[gram]))
            open_[has[found]] = False
        rest = np.flatnonzero(open_)
        p = self.levels[0].prob[self.word[rest]]
        out[rest] += np.log10(np.where(p > 0, p, self.facts.unknown))
        return out


# -- tables ---------------------------------------------------------------------------------


def _lower(message: list[np.ndarray], facts: Facts) -> np.ndarray:
    """Probabilities after the shorter contexts: from counts and what these are divided by, or as a stored table gives their sums."""
    if len(message) > 6:
        return message[6]
    count, whole = message[3], message[4]
    return kept_share(count, facts.left[-1]) * count / np.where(whole > 0, whole, facts.whole())


def _columns(kind: str, level: int, bucket: int, n: int, **given: pa.Array) -> pa.Table:
    types = {"chunk": pa.int64(), "body": pa.binary(), "ctx": pa.int64(), "spread": pa.bool_(), "total": pa.int64(), "few": pa.list_(pa.int64()), "lower": pa.float64(), "words": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    fixed = {"kind": pa.array([kind] * n, pa.string()), "level": pa.array(np.full(n, level, np.int32)), "bucket": pa.array(np.full(n, bucket, np.int32))}
    return pa.table({c: fixed[c] if c in fixed else given[c].cast(types[c]) if c in given else pa.nulls(n, types[c]) for c in _NAMES})


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(np.int64) if values.dtype != np.uint64 else values.view(np.int64)))


def _few(counts: np.ndarray, group: np.ndarray, groups: int, most: int) -> np.ndarray:
    small = (counts >= 1) & (counts <= most)
    return np.bincount(group[small] * most + counts[small] - 1, minlength=groups * most).reshape(groups, most)


def _sorted(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by context and word; sorted runs are merged."""
    if len(ctx) and max(ctx.max(), word.max()) < 1 << 31:
        return np.argsort(ctx << 32 | word, kind="stable")
    return np.lexsort((word, ctx))


def _merge(level: int, last: bool, buckets: int, facts: Facts):
    """Merges the messages to a bucket: its part of the table, an answer to each message, counts of counts."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        came = [unpack(b.as_py()) for b in group.column("body")]
        if level == 1:
            came = [[np.zeros(len(m[0]), np.int64), m[0], m[1], np.zeros(0), np.zeros(0, bool)] for m in came]
        else:
            came = [[np.cumsum(m[0]), m[1], m[2], _lower(m, facts), m[5]] for m in came]
        sizes = [len(m[0]) for m in came]
        ctx, word, count = (np.concatenate([m[i] for m in came]) for i in range(3))
        order = _sorted(ctx, word) if level > 1 else np.argsort(word, kind="stable")
        ctx, word = ctx[order], word[order]
        new = runs(word, ctx)
        gram = np.empty(len(order), np.int64)
        gram[order] = np.repeat(np.arange(len(new)), np.diff([*new, len(order)]))
        total = np.add.reduceat(count[order], new)
        ctx, word, held = ctx[new], word[new], total > 0
        number = np.where(held, (np.cumsum(held) + 1) * buckets + bucket, _UNSEEN)  # from 2 on
        out = [_columns("facts", level, bucket, 1, total=pa.array([int(total.sum())]), few=_lists(_few(total, np.zeros(len(total), int), 1, DISCOUNTED + 1)[0], np.array([0])), chunk=pa.array([int(held.sum())]), lower=pa.array([float(total[word == np.uint64(_END)].sum()) if level == 1 else 0.0]))]
        none, edges, chunk_ids = np.zeros(0, np.int64), np.cumsum([0, *sizes]), group.column("chunk")
        if level == 1:
            starts = np.arange(0, int(held.sum()), 1 << 16)
            out.append(_columns("table", level, bucket, len(starts), words=_lists(word[held], starts), counts=_lists(total[held], starts)))
            bodies = [pack(total[gram[lo:hi]], none if last else number[gram[lo:hi]]) for lo, hi in zip(edges, edges[1:])]
            asks = []
        else:
            lower, spread = (np.concatenate([m[i] for m in came])[order] for i in (3, 4))
            lower, spread = np.maximum.reduceat(lower, new), np.logical_or.reduceat(spread, new)
            begin = runs(ctx)
            own = np.repeat(np.arange(len(begin)), np.diff([*begin, len(ctx)]))
            sums, weight, few, spread = np.add.reduceat(total, begin), np.add.reduceat(lower, begin), _few(total, own, len(begin), DISCOUNTED), spread[begin]
            at = np.flatnonzero(sums > 0)
            inside = np.flatnonzero(held)
            starts = np.searchsorted(own[inside], at)
            out.append(_columns("table", level, bucket, len(at), ctx=pa.array(ctx[begin[at]]), spread=pa.array(spread[at]), total=pa.array(sums[at]), few=_lists(few[at].ravel(), np.arange(len(at)) * DISCOUNTED), lower=pa.array(weight[at]), words=_lists(word[inside], starts), counts=_lists(total[inside], starts)))
            bodies, asks = [], []
            for lo, hi, m, chunk in zip(edges, edges[1:], came, chunk_ids):
                mine = gram[lo:hi]
                first = mine[runs(m[0])]
                c = own[first]
                # The sum over shorter contexts matters only where a word was not seen.
                wanted = np.logical_or.reduceat(total[mine] == 0, runs(m[0])) if len(mine) else np.zeros(0, bool)
                bodies.append(pack(total[mine], none if last else number[mine], sums[c], np.where(wanted, weight[c], 0.0), *few[c].T))
                if chunk.is_valid:
                    asks += [(chunk.as_py(), int(x)) for x in ctx[begin[c[spread[c]]]]]
        asked = [i for i, c in enumerate(chunk_ids) if c.is_valid]
        out.append(_columns("answer", level, bucket, len(asked), chunk=pa.array([chunk_ids[i].as_py() for i in asked], pa.int64()), body=pa.array([bodies[i] for i in asked], pa.binary())))
        out.append(_columns("ask", level, bucket, len(asks), chunk=pa.array([a for a, _ in asks], pa.int64()), ctx=pa.array([b for _, b in asks], pa.int64())))
        return pa.concat_tables(out)

    return run


_ANSWER = ["level", "chunk", "bucket", "body", "ctx", "total", "few", "lower"]


def _answers(merged: DataFrame) -> DataFrame:
    """Answers to messages; and for each chunk the whole sums of those of its contexts that are spread over buckets."""
    sums = merged.where("kind = 'table' AND spread").groupBy("level", "ctx").agg(F.sum("total").alias("total"), F.array(*(F.sum(F.col("few")[i]) for i in range(DISCOUNTED))).alias("few"), F.sum("lower").alias("lower"))
    asked = merged.where("kind = 'ask'").select("level", "chunk", "ctx").distinct().join(sums, ["level", "ctx"])
    return merged.where("kind = 'answer'").select(_ANSWER).unionByName(asked.select("level", "chunk", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("body"), "ctx", "total", "few", "lower"))


def _with_answers(state: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [work(row, right) for row in left.to_pylist()]
        return pa.concat_tables(out)

    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


# -- the operator ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Katz:
    """Tables of a model, and what is known of them as a whole."""

    tables: tuple[DataFrame, ...]
    facts: Facts
    order: int

    def contexts(self, level: int) -> DataFrame:
        """ctx, total (with one more where nothing is discounted), and the backoff weight, for each context of n-grams of ``level`` words."""
        left = self.facts.left[level - 1]
        few = [F.sum(F.col("few")[i]) for i in range(DISCOUNTED)]
        rows = self.tables[level - 1].where("kind = 'table'").groupBy("ctx").agg(F.sum("total").alias("seen"), F.sum("lower").alias("lower"), sum(f * float((1 - left[i + 1]) * (i + 1)) for i, f in enumerate(few)).alias("taken"))
        whole = F.col("seen") + F.when(F.col("taken") <= 0, 1).otherwise(0)
        mass = F.when(F.col("taken") > 0, F.col("taken")).otherwise(1.0) / whole
        return rows.select("ctx", whole.alias("total"), (mass / (1 - F.col("lower"))).alias("backoff"))

    def ngrams(self, level: int) -> DataFrame:
        """ctx (null for words), word (its number; its 64-bit hash for words), count, for each n-gram of ``level`` words."""
        return self.tables[level - 1].where("kind = 'table'").select("ctx", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("ctx", F.col("e.words").alias("word"), F.col("e.counts").alias("count"))

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` scored by this model, which learns nothing from them."""
        return fit_and_score(docs, F.lit(False), self.order, self)[0]


def _stored(model: Katz, level: int) -> DataFrame:
    """A level's table as messages that ask for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["words"])
                words, counts = np.array(r["words"], np.int64), np.array(r["counts"], np.int64)
                lower = np.zeros(n)
                if level > 1:
                    lower[0] = r["lower"]
                body = pack(words.view(np.uint64), counts) if level == 1 else pack(np.array([r["ctx"]] + [0] * (n - 1)), words, counts, np.zeros(n, int), np.zeros(n, int), np.full(n, r["spread"]), lower)
                yield pa.record_batch([pa.array([r["bucket"]], pa.int32()), pa.nulls(1, pa.int64()), pa.array([body])], names=["bucket", "chunk", "body"])

    return model.tables[level - 1].where("kind = 'table'").mapInArrow(run, "bucket int, chunk bigint, body binary")


def fit_and_score(docs: DataFrame, learn: Column, order: int = ORDER, model: Katz | None = None) -> tuple[DataFrame, Katz]:
    """Scores of all ``docs`` by a model of those that ``learn`` marks (or by a given one), and the model.

    The scores: doc_id, learned, n_tokens, n_known, train_tokens, base_score (one added to each word's count), score; one row for each row of ``docs``.
    """
    spark = session_of(docs)
    scratch = Scratch(spark, "katz")
    state = _chunked(docs, learn, order, scratch)
    state, words = (state.where(F.col("kind") == kind).drop("kind") for kind in ("tokens", "words"))
    if model:
        buckets = model.facts.buckets
    else:
        size = state.select(F.sum(F.length("body"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_TOKENS))  # a token takes one to two bytes
    facts, tables, answers = Facts(buckets=buckets, spread_from=model.facts.spread_from if model else BUCKET_TOKENS), [], None
    for level in range(1, order + 1):
        known, last = facts, level == order

        def messages(row: dict, given: pa.Table) -> pa.Table:
            sent = list(View(row, given, known, order).messages(level))  # noqa: B023 - run before the next level
            return pa.table({"bucket": pa.array([b for b, _ in sent], pa.int32()), "chunk": pa.array([row["chunk"]] * len(sent), pa.int64()), "body": pa.array([m for _, m in sent], pa.binary())})

        if level == 1:

            def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                        hashes, given = unpack(body.as_py())
                        sent = [(b, pack(hashes[mine], given[mine])) for b, mine in by_bucket(_bucket_of_hash(hashes, buckets))]
                        yield pa.record_batch([pa.array([b for b, _ in sent], pa.int32()), pa.array([chunk] * len(sent), pa.int64()), pa.array([m for _, m in sent], pa.binary())], names=["bucket", "chunk", "body"])

            sent = words.mapInArrow(released(first), "bucket int, chunk bigint, body binary")
        else:
            sent = _with_answers(state, answers, messages, "bucket int, chunk bigint, body binary")
        if model:
            sent = sent.unionByName(_stored(model, level))
        merged = scratch.keep(sent.groupBy("bucket").applyInArrow(_merge(level, last, buckets, facts), _MERGED), f"level{level}", "kind", compression="zstd")
        if level == 1:
            scratch.drop("chunks/kind=words")
        free_shuffles(spark)
        tables.append(merged)
        got = merged.where("kind = 'facts'").agg(F.sum("total"), F.sum("chunk"), F.sum("lower"), *(F.sum(F.col("few")[i]) for i in range(DISCOUNTED + 1))).first()
        few = [x or 0 for x in got[3:]]
        left = discounts(few)
        if level == 1:
            tokens, words, texts = (int(x or 0) for x in got[:3])  # as many texts begin as end
            taken = sum((1 - left[r]) * r * few[r - 1] for r in range(1, DISCOUNTED + 1))
            facts = replace(facts, tokens=tokens, words=words, texts=texts, unknown=taken / tokens if taken > 0 else 1 / (tokens + 1))
        facts = replace(facts, left=(*facts.left, left))
        answers = _answers(merged) if answers is None else answers.unionByName(_answers(merged))

    final = facts

    def scored(row: dict, given: pa.Table) -> pa.Table:
        view, n = View(row, given, final, order), len(row["row_id"])
        of, counted = view.row[view.counts], view.levels[0].count[view.word[view.counts]]
        base = np.log10((counted + 1) / (final.tokens + final.words + 1))
        sums = [np.bincount(of, w, minlength=n) for w in (base, view.log_probabilities()[view.counts])]
        whole = [np.bincount(x, minlength=n) for x in (of, of[counted > 0])]
        return pa.table({"row_id": row["row_id"], "doc_id": pa.array(row["doc_id"], pa.int64()), "learned": row["learned"], "n_tokens": whole[0], "n_known": whole[1], "base_score": sums[0], "score": sums[1]})

    parts = _with_answers(state, answers, scored, "row_id bigint, doc_id bigint, learned boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    rows = parts.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("learned").alias("learned"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    out = rows.select("doc_id", "learned", "n_tokens", "n_known", F.lit(final.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    return out, Katz(tuple(tables), final, order)
