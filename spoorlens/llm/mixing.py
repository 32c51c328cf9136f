"""Problem 8: mixing sources to target weights, by soft membership.

1.  The words of labelled texts give a naive Bayes table of hashed words by source.  How many words of a
    text count as independent evidence is fitted on texts that the table hasn't seen (``fit_evidence``).
2.  One pass over the corpus counts each text's tokens with a public tokenizer and gives it a membership, a
    belief in each source: the words' evidence and, where the text has a label, the label's, which is wrong
    with the chance ``label_error``.  Labelled or not, every text of a target source or of none takes part
    with what it is believed to be.  Texts themselves are not written or moved.
3.  Texts of one label, one likeliest source and about one belief in it are a class; there are
    at most 10 n of them for n sources.  The tasks sum up, exactly, the tokens that each class is expected to
    hold of each source.
4.  Projected gradient least squares gives each class a rate, how often its texts are used on average,
    between 0 and max_repeats, so that the expected tokens of all sources match their shares; of the totals
    at which they do, the largest found is taken (``fit_rates``).
5.  Rates become whole numbers: each text gets the rate rounded down, and within a class the texts that
    come first in hash order one more, until their tokens make up the rest.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import known, label_form
from ..sources.stages import Stages

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets that words are hashed into, hash buckets of the running sums, steps of a class's belief.
WORDS, BUCKETS, GRID = 4096, 1024, 5
#: Labelled texts that the classifier is fitted on, at most; all texts are judged by it.
FIT_TEXTS = 200_000
#: Words of a text that may count as independent, of which the best number is taken.
EVIDENCE = (0.0, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
#: Gradient steps of one fit, and the share of the total by which a source may be missed.
STEPS, MISS = 5_000, 1e-6


def token_counter(path: str):
    """Function from texts to their numbers of tokens: a rank file (``.tiktoken``) or a tokenizer file (``.json``)."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are then ordinary text
    return lambda texts: [len(e) for lo in range(0, len(texts), 64) for e in made.encode_batch_fast(texts[lo : lo + 64], add_special_tokens=False)]


def _bucketed() -> Column:
    return F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int"))


def _half() -> Column:
    return F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2))


# ------------------------------------------------------------------ classifier
def fit_sample(docs: DataFrame, sources: list[str], fit_texts: int = FIT_TEXTS) -> DataFrame:
    """Labelled texts of the sources: all, or about ``fit_texts`` of them by their hash where there are more."""
    own = docs.filter(F.col("source").isin(sources))
    n = own.select("source").count()
    if n <= fit_texts:
        return own
    return own.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int(fit_texts / n * (1 << 30)))


def word_counts(sample: DataFrame, sources: list[str]) -> np.ndarray:
    """Counts of word buckets by half of the texts and source: halves x sources x buckets."""
    words = sample.select(_half().alias("half"), "source", F.explode(_bucketed()).alias("w"))
    seen = words.groupBy("half", "source", "w").agg(F.count(F.lit(1)).alias("n"))  # at most halves x sources x buckets rows
    counts = np.zeros((2, len(sources), WORDS))
    for r in seen.collect():
        counts[r["half"], sources.index(r["source"]), r["w"]] += r["n"]
    return counts


def word_table(counts: np.ndarray) -> np.ndarray:
    """Log probability of each word bucket by source, every bucket counted once more."""
    return np.log((counts + 1) / (counts + 1).sum(axis=1, keepdims=True))


def _evidence(column: pa.ListArray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean log probability of a text's words by source, number of words), a row a text."""
    size = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), len(table)))
    full = np.flatnonzero(size)
    if len(full):
        first = np.concatenate([[0], np.cumsum(size)[:-1]])[full]
        out[full] = np.add.reduceat(table.T[flat], first, axis=0) / size[full, None]
    return out, size


def _beliefs(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_evidence(sample: DataFrame, counts: np.ndarray, log_prior: np.ndarray, sources: list[str]) -> float:
    """Of ``EVIDENCE`` the number of words with which the first half's table says most of the second half's labels."""
    table, number = word_table(counts[0]), {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean, size = _evidence(b.column(1), table)
            at = np.array([number[s] for s in b.column(0).to_pylist()], int)
            gain = [float(np.log(np.maximum(_beliefs(log_prior + mean * np.minimum(size, e)[:, None])[np.arange(len(at)), at], 1e-12)).sum()) if len(at) else 0.0 for e in EVIDENCE]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(EVIDENCE)), pa.int32()), pa.array(gain)], ["k", "gain"])

    rows = sample.filter(_half() == 1).select("source", _bucketed().alias("w")).mapInArrow(run, "k int, gain double").groupBy("k").agg(F.sum("gain").alias("gain")).collect()  # a row a number
    return EVIDENCE[max(rows, key=lambda r: (r["gain"], -r["k"]))["k"]] if rows else 0.0


def memberships(docs: DataFrame, sources: list[str], table: np.ndarray, log_prior: np.ndarray, words: float, label_error: float, tokenizer: str) -> DataFrame:
    """(doc_id, label, tokens, q): tokens of each text and its belief in each source; ``label`` is the source's number or -1."""
    number, n = {s: k for k, s in enumerate(sources)}, len(sources)
    # evidence of a label: a row for each, the last for none
    said = np.zeros((n + 1, n))
    if n > 1:
        said[:n] = (np.log(label_error) + log_prior)[:, None]  # a wrong label is drawn as labels are in general
        said[np.arange(n), np.arange(n)] = np.log(1 - label_error)
        said[~np.isfinite(said)] = -1e3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for b in batches:
            mean, size = _evidence(b.column(3), table)
            label = np.array([number.get(s, -1) for s in b.column(1).to_pylist()], np.int32)
            q = _beliefs(log_prior + mean * np.minimum(size, words)[:, None] + said[label])
            tokens = pa.array(count([t or "" for t in b.column(2).to_pylist()]), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * n, pa.int32()), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label), tokens, lists], ["doc_id", "label", "tokens", "q"])

    return docs.select("doc_id", "source", "text", _bucketed().alias("w")).mapInArrow(run, "doc_id long, label int, tokens long, q array<double>")


# ------------------------------------------------------------------ rates
def _descended(held: np.ndarray, caps: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, float]:
    """Rates within 0 and caps whose expected tokens come nearest to the goal, and the largest miss.

    Projected gradient with momentum on least squares of the misses, each relative to its goal.  A step
    moves a class by what its texts are believed to be, not by how many they are, and the misses are weighed
    so that it undoes each of them alike; the weights are renewed for the classes that are still free to move.
    """
    a = held * caps[:, None] / goal  # classes x sources: share of a source's goal that a class gives at its cap
    way = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)

    def weight(free: np.ndarray) -> np.ndarray:
        square = a[free].T @ way[free]
        square = (square + square.T) / 2
        return np.linalg.pinv(square + 1e-10 * max(np.trace(square), 1e-300) * np.eye(len(goal)), hermitian=True)

    x = y = np.full(len(caps), 0.5)  # rates by their caps
    w, t, least, best = weight(np.full(len(caps), True)), 1.0, np.inf, x
    for k in range(STEPS):
        miss = np.abs(x @ a - 1.0).max()
        if miss < least:
            least, best = float(miss), x
        if miss <= MISS:
            break
        new = np.clip(y - way @ (w @ (y @ a - 1.0)), 0.0, 1.0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        # momentum starts anew where it points uphill
        uphill = (y - new) @ (new - x) > 0
        y, t = (new, 1.0) if uphill else (new + (t - 1) / after * (new - x), after)
        x = new
        if k % 50 == 49 and ((x > 0) & (x < 1)).any():
            w, y, t = weight((x > 0) & (x < 1)), x, 1.0
    return best * caps, least


def fit_rates(held: np.ndarray, caps: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
    """(rate of each class, largest miss by a source's goal) at the largest total that all shares can be met at.

    ``held`` is classes x sources: expected tokens.  Sources without any are left out.
    """
    there = held.sum(axis=0) > 0
    if not there.any():
        return np.zeros(len(caps)), 0.0
    held, shares = held[:, there], shares[there]
    most = float(((held * caps[:, None]).sum(axis=0) / shares).min())
    rates, miss = _descended(held, caps, shares * most)
    if miss <= MISS or most <= 0:
        return rates, miss
    lo, hi, best = 0.0, most, (np.zeros(len(caps)), 0.0)
    for _ in range(16):  # to within 1 / 65536 of the largest total
        mid = (lo + hi) / 2
        rates, miss = _descended(held, caps, shares * mid)
        if miss <= 10 * MISS:
            lo, best = mid, (rates, miss)
        else:
            hi = mid
    return best


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, label_error: float = 0.005, fit_texts: int = FIT_TEXTS, seed: int = 99) -> tuple[DataFrame, DataFrame]:
    """Allocation (doc_id, source, tokens, repeats) of the texts used, and the report of shares reached.

    Sources compare in label form.  Targets that are null, not positive or name no source are left out,
    and shares are taken relative to their sum.  The total is the largest at which every source with
    tokens can hold its share without a text being used more than max_repeats times (null: once).  A
    source without labelled texts can't be met and holds nothing.  Texts labelled with other sources and
    empty texts aren't used.  ``source`` is a text's label; without one it is null, and the text is used as
    often as the strictest source allows.  In the report, ``share`` counts labelled texts by their labels and
    others by belief, ``expected_share`` counts all by belief, and ``fit_miss`` is the largest miss of the
    fit, relative to a source's goal.
    """
    spark, stages = documents.sparkSession, Stages(documents.sparkSession, "mixing")
    rows = targets.select(known(label_form("source")).alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0")
    wanted = rows.groupBy("source").agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap")).orderBy("source").collect()  # a row a target
    sources, shares = [r["source"] for r in wanted], np.array([r["share"] for r in wanted], float)
    source_caps = np.array([max(r["cap"], 0) for r in wanted], float)
    shares = shares / shares.sum() if len(shares) else shares
    head, report_head = "doc_id long, source string, tokens long, repeats int", "source string, target_share double, share double, expected_share double, n_tokens long, n_documents long, most_used int, max_repeats int, fit_miss double"
    if not sources:
        return spark.createDataFrame([], head), spark.createDataFrame([], report_head)
    n = len(sources)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), known(label_form("source")).alias("source"), "text").filter("doc_id is not null and text is not null and text <> ''")
    sample = fit_sample(docs, sources, fit_texts)
    counts = word_counts(sample, sources)
    seen = counts.sum(axis=(0, 2))
    with np.errstate(divide="ignore"):
        log_prior = np.log(seen / max(seen.sum(), 1)) if seen.any() else np.zeros(n)
    words = fit_evidence(sample, counts, log_prior, sources) if seen.any() else 0.0
    part = docs.filter(F.col("source").isNull() | F.col("source").isin(sources)) if seen.any() else docs.limit(0)
    judged = memberships(part, sources, word_table(counts.sum(axis=0)), log_prior, words, label_error, tokenizer).filter("tokens > 0")
    top = F.array_max("q")
    k = F.when(F.col("label") >= 0, F.col("label")).otherwise((F.array_position("q", top) - 1).cast("int"))
    group = ((F.col("label") + 1) * n + k) * GRID + F.least(F.floor(F.element_at("q", k + 1) * GRID), F.lit(GRID - 1))
    judged = stages.write(judged.select("doc_id", "label", "tokens", "q", group.cast("int").alias("class")), "judged")
    # a row a class
    classes = judged.groupBy("class").agg(F.first("label").alias("label"), *[F.sum(F.col("tokens") * F.col("q")[j]).alias(f"t{j}") for j in range(n)]).orderBy("class").collect()
    held = np.array([[r[f"t{j}"] for j in range(n)] for r in classes]).reshape(-1, n)
    # a text of unknown source is used as often as the strictest source allows
    caps = np.array([source_caps[r["label"]] if r["label"] >= 0 else source_caps.min() for r in classes])
    rates, miss = fit_rates(held, caps, shares)
    rate_of = spark.createDataFrame([(r["class"], float(x)) for r, x in zip(classes, rates)], "class int, rate double")
    # whole numbers: running tokens in hash order, by bucket and then within a bucket
    h = F.xxhash64(F.lit(seed), "doc_id")
    placed = judged.select("doc_id", "tokens", "class", "label", "q").join(F.broadcast(rate_of), "class")
    placed = placed.withColumns({"whole": F.floor(F.col("rate") + 1e-9), "h": h, "bucket": F.pmod(h, F.lit(BUCKETS))}).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    sums = placed.groupBy("class", "bucket").agg(F.sum("tokens").alias("m"), F.sum(F.col("part") * F.col("tokens")).alias("p"))
    up = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("class", "bucket", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("before"), F.sum("p").over(Window.partitionBy("class")).alias("rest"))
    within = Window.partitionBy("class", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(sums, ["class", "bucket"])
    middle = F.col("before") + F.col("inner") + F.col("tokens") / 2
    repeats = (F.col("whole") + F.when((F.col("part") > 1e-9) & (middle <= F.col("rest")), 1).otherwise(0)).cast("int")
    name = F.get(F.array(*[F.lit(s) for s in sources]), F.col("label"))
    used = stages.write(ranked.select("doc_id", F.when(F.col("label") >= 0, name).alias("source"), "tokens", repeats.alias("repeats"), F.when(F.col("label") < 0, F.col("q")).alias("q")).filter("repeats > 0"), "allocation")
    # what is used of each source: whole texts by their labels, others by belief
    weight = F.col("tokens") * F.col("repeats")
    by = used.groupBy("source").agg(F.sum(weight).cast("double").alias("n"), F.count(F.lit(1)).alias("n_documents"), F.max("repeats").alias("most_used"))
    loose = used.filter("source is null").select(weight.alias("w"), F.posexplode("q").alias("k", "p")).groupBy("k").agg(F.sum(F.col("w") * F.col("p")).alias("loose"))
    loose = loose.select(F.get(F.array(*[F.lit(s) for s in sources]), F.col("k")).alias("source"), "loose")
    expected = rates @ held if len(rates) else np.zeros(n)
    expected = expected / max(expected.sum(), 1e-300)
    goals = spark.createDataFrame([(s, float(shares[k]), float(expected[k]), int(source_caps[k]), miss) for k, s in enumerate(sources)], "source string, target_share double, expected_share double, max_repeats int, fit_miss double")
    whole = Window.partitionBy(F.lit(0))  # a row a target
    report = goals.join(by, "source", "left").join(loose, "source", "left").fillna(0, ["n", "n_documents", "most_used", "loose"]).withColumn("n_tokens", F.col("n") + F.col("loose"))
    share = F.coalesce(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(whole)), F.lit(0.0))
    return used.drop("q"), report.select("source", "target_share", share.alias("share"), "expected_share", F.round("n_tokens").cast("long").alias("n_tokens"), "n_documents", "most_used", "max_repeats", "fit_miss")
