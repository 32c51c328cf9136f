"""Problem 7: evaluation passages in training texts, by spaced-seed hashing.

1.  Fixed masks pick some positions of a window of tokens and ignore the others, so that a replaced word
    does not spoil every window over it.  The hashes of the items' windows are a table of seeds.
2.  All texts are read once.  The hashes of a text's windows go through a Bloom filter of the seeds, whose
    size is bounded; a text with hashes that pass is kept, with these (``seeded_texts``).
3.  Kept hashes and seeds are joined: the pairs of text and item that share a seed are the candidates.
4.  Around their hits the runs of equal tokens are chained into the longest stretch that keeps to the
    allowed number of errors (``longest_passage``).

The number of items only changes the table of seeds: neither items nor hashes are held in one place, and a
filter that is too small for them lets more hashes into the join, no fewer.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stages
from .text import words

#: Token positions that a seed looks at.  The first serves words dropped or added: a
#: passage of 12 words with one error, or 16 with two, has five words in a row untouched.
MASKS = ("11111", "1101101", "11100111", "110010111")
#: Words of a passage, and words for each error that it may have.
LEAST = 12
PER_ERROR = 8
#: Bits of the filter for each seed, and of the whole filter at most; probes of a hash.
SEED_BITS, MOST_BITS, PROBES = 32, 1 << 28, 6


# ------------------------------------------------------------------ seeds
class _Hashes(dict):
    """Token to its 64-bit hash; forgets all when it has a million."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= 1 << 20:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) | 1
        return h


def _seeds(lists: list[list[str]], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(number of the list, hash) of all windows under all masks of lists of tokens."""
    gap = max(map(len, MASKS))
    stream = np.zeros(sum(map(len, lists)) + gap * (len(lists) + 1), np.uint64)
    owner = np.zeros(len(stream), np.int64)
    k = 0
    for n, x in enumerate(lists):
        stream[k : k + len(x)] = list(map(hashes.__getitem__, x))
        owner[k : k + len(x)] = n
        k += len(x) + gap
    at, codes = [], []
    for number, mask in enumerate(MASKS):
        n = len(stream) - len(mask) + 1
        whole, code = np.ones(n, bool), np.full(n, number + 1, np.uint64)
        for j in range(len(mask)):
            # zeros lie between the lists
            whole &= stream[j : j + n] != 0
            if mask[j] == "1":
                code = (code ^ stream[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
        inside = np.flatnonzero(whole)
        at.append(owner[inside])
        codes.append(code[inside])
    return np.concatenate(at), np.concatenate(codes)


def _probe(codes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Places of the ``k``-th probe of the hashes in a filter of ``bits``, a power of two."""
    step = (codes * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(17)
    return (codes + np.uint64(k) * (step | np.uint64(1))) & np.uint64(bits - 1)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for b in batches:
        at, codes = _seeds([words(t)[0] for t in b.column(1).to_pylist()], hashes)
        ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)[at]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(codes.view(np.int64))], ["item", "code"])


def seed_filter(seeds: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bloom filter of the column ``code``: a bit array of ``SEED_BITS`` for each seed, at most ``most_bits`` in all.

    Its words are put together by the tasks; the driver gets the finished ones, at most most_bits / 64 rows.
    """
    n = seeds.count()
    bits = min(most_bits, max(1 << 13, 1 << (n * SEED_BITS - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            at = np.unique(np.concatenate([_probe(codes, k, bits) for k in range(PROBES)]))
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bit)], ["word", "bit"])

    made = seeds.select("code").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[made.column("word").to_numpy()] = made.column("bits").to_numpy()
    return out.view(np.uint64)


def _passing(codes: np.ndarray, words_: np.ndarray) -> np.ndarray:
    """Numbers of the hashes that the filter holds."""
    left = np.arange(len(codes))
    for k in range(PROBES):
        at = _probe(codes[left], k, len(words_) << 6)
        left = left[(words_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return left


def seeded_texts(docs: DataFrame, filter_words: np.ndarray) -> DataFrame:
    """(doc_id, text, codes): texts with a window whose hash passes the filter, and these hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                at, codes = _seeds([words(t)[0] for t in part.column(1).to_pylist()], hashes)
                kept = _passing(codes, filter_words)
                if not len(kept):
                    continue
                # one row for each text and hash, then lists of them by text
                both = np.unique(np.stack([at[kept], codes[kept].view(np.int64)], axis=1), axis=0)
                rows, first = np.unique(both[:, 0], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(both)), pa.int32()), pa.array(both[:, 1]))
                text = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([text.column(0), text.column(1), lists], ["doc_id", "text", "codes"])

    return docs.mapInArrow(run, "doc_id long, text string, codes array<long>")


# ------------------------------------------------------------------ verification
def may_hold(item: list[str], item_word: list[int], tokens: set[str], least: int = LEAST) -> bool:
    """Whether some stretch of at least ``least`` item words lacks no more of them in the text than it may have errors."""
    # the words that such a stretch must have in the text are tokens, too
    if sum(map(tokens.__contains__, item)) < least - least // PER_ERROR:
        return False
    n = item_word[-1] + 1
    missing = [1] * n
    for t, w in zip(item, item_word):
        if t in tokens:
            missing[w] = 0
    # PER_ERROR * missing - words, summed up to each word: a stretch is good if the sum doesn't grow
    sums, best = [0], -(1 << 30)
    for k, m in enumerate(missing):
        sums.append(sums[-1] + PER_ERROR * m - 1)
        if k + 1 >= least:
            best = max(best, sums[k + 1 - least])
            if sums[k + 1] <= best:
                return True
    return False


def _runs(item: list[int], item_word: list[int], text: list[int], text_word: list[int]) -> list[tuple[int, int, int]]:
    """(text start, item start, length) of the runs of equal tokens that a passage can be chained of.

    A passage always has a run of two or more tokens.  A single equal token counts only near one of
    these: from there a passage passes at most ``most`` errors and as many single tokens between them.
    """
    where = defaultdict(list)
    for i, t in enumerate(item):
        where[t].append(i)
    runs, single, last = [], [], {}
    for j, t in enumerate([*text, 0]):
        now = {}
        if t:
            for i in where.get(t, ()):
                now[i + 1] = last.get(i, 0) + 1
        for i, n in last.items():
            if now.get(i + 1, 0) != n + 1:
                (runs if n > 1 else single).append((j - n, i - n, n))
        last = now
    most = len(set(item_word)) // PER_ERROR
    reach, at, near = 2 * most + 1, [text_word[j] for j, _, _ in single], set()
    for j, i, n in runs:
        for y, x in ((text_word[j], item_word[i]), (text_word[j + n - 1], item_word[i + n - 1])):
            for k in range(bisect_left(at, y - reach), bisect_right(at, y + reach)):
                d = item_word[single[k][1]] - x
                if -reach <= d <= reach and -reach <= d - at[k] + y <= reach:
                    near.add(k)
    runs += [single[k] for k in near]
    return sorted(runs)


def longest_passage(item: list[int], item_word: list[int], text: list[int], text_word: list[int]) -> int:
    """Words of the longest stretch of the item in the text with at most one error in ``PER_ERROR`` words; 0 if none.

    An error is a word replaced, dropped or added.  A stretch begins and ends with equal words.  Runs
    are chained in the order of both; a chain's state is, for each number of errors, the earliest word
    it began with.
    """
    runs = _runs(item, item_word, text, text_word)
    most = len(set(item_word)) // PER_ERROR
    best, ends = 0, []
    for j, i, n in runs:
        start = {0: item_word[i]}
        for j0, i0, n0, states in ends:
            # a later run may begin inside the former one: then only its rest continues the chain
            cut = max(j0 + n0 - j, i0 + n0 - i, 0)
            if cut >= n:
                continue
            added = text_word[j + cut] - text_word[j0 + n0 - 1] - 1
            left = item_word[i + cut] - item_word[i0 + n0 - 1] - 1
            gap = max(added, left, 1)
            if gap > most:
                continue
            for e, s in states.items():
                if e + gap <= most and s < start.get(e + gap, 1 << 30):
                    start[e + gap] = s
        for e, s in start.items():
            length = item_word[i + n - 1] - s + 1
            if e * PER_ERROR <= length:
                best = max(best, length)
        ends.append((j, i, n, start))
    return best


def _verify(least: int):
    """Batches of (row, doc_id, text, item, item_id, item_text) to (doc_id, item_id, n_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, tuple] = {}
        row, tokens, word, held = None, [], [], set()
        for b in batches:
            found = []
            rows, docs, numbers, ids = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            texts, passages = b.column(2), b.column(5)
            for k, (r, item) in enumerate(zip(rows, numbers)):
                if r != row:
                    row = r
                    tokens, word = words(texts[k].as_py())
                    held = set(tokens)
                if item not in items:
                    if len(items) >= 20_000:
                        items.clear()
                    items[item] = words(passages[k].as_py())
                a, w = items[item]
                n = longest_passage(a, w, tokens, word) if may_hold(a, w, held, least) else 0
                if n >= least:
                    found.append((docs[k], ids[k], n))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in found], pa.int64()), "item_id": pa.array([x[1] for x in found], pa.int64()), "n_words": pa.array([x[2] for x in found], pa.int32())})

    return run


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id, n_words): documents that hold a passage of an item, and the longest one in words.

    Null and empty texts and items, and items shorter than a passage, give no rows; rows without an id
    give none; repeated ids give one row with the longest passage.  Case, punctuation, accents,
    spacing, markup, invisible characters and words broken at a line end make no difference.
    """
    stages = Stages(documents.sparkSession, "leakage")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "item_text").filter("item_id is not null and item_text is not null and item_text <> ''").distinct()
    known = stages.write(known.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = stages.write(known.select("item", "item_text").mapInArrow(_item_seeds, "item long, code long").distinct(), "seeds")
    kept = stages.write(seeded_texts(docs, seed_filter(seeds, most_bits)).withColumn("row", F.monotonically_increasing_id()), "texts")
    shared = kept.select("row", F.explode("codes").alias("code")).join(seeds, "code").select("row", "item").distinct()
    pairs = shared.join(kept.select("row", "doc_id", "text"), "row").join(known, "item").select("row", "doc_id", "text", "item", "item_id", "item_text")
    found = pairs.mapInArrow(_verify(least), "doc_id long, item_id long, n_words int")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(test_set, item_kind, n_items, n_leaked, n_documents): how much of each test set leaked."""
    kinds = items.select("item_id", F.coalesce("test_set", F.lit("unknown")).alias("test_set"), F.coalesce("item_kind", F.lit("unknown")).alias("item_kind")).distinct()
    hits = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(hits, "item_id", "left").groupBy("test_set", "item_kind").agg(F.countDistinct("item_id").alias("n_items"), F.count_if(F.col("n") > 0).alias("n_leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"))
