"""Problems 7, 8 and 9 on small texts."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from spoorlens.llm.leakage import leak_report, leaked_items, longest_passage, may_hold
from spoorlens.llm.mixing import TOKENIZER, mixture
from spoorlens.llm.spam import prose_words, spam_pages, spam_share
from spoorlens.llm.text import words
from spoorlens.sources.stages import Stages

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id long, tokens long, q string, kind string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 7, 1, "q", "k") for i, t, s in rows], DOCS)


ITEM = "Which würdig upper protocol mirrors the striped landmark of trail N-6655b, and why would 68 pale steps on a older frame change that sandbar"
OTHER = "Rank the cold mould by their rival cutoff given that every frozen crust follows some damp overlay near the lateral holt"
FILL = "we saw nothing else on that day apart from rain and a long grey bank of cloud over the valley"


def test_words_ignore_what_makes_no_difference():
    a = words("The <b>fur­row</b>​ shows Ängste -- N-6655b, and it is doub-\n led &amp; **done**")[0]
    assert a == words("the furrow shows angste n 6655b and it is doubled done")[0]
    assert words(None) == ([], []) and words("") == ([], [])
    assert words("porÃ©m")[0] == ["porem"]


def variants():
    w = ITEM.split()
    yield "whole", ITEM, True
    yield "upper, bare", ITEM.upper().replace(",", "").replace("-", " "), True
    yield "part of 13", " ".join(w[4:17]), True
    yield "part of 9", " ".join(w[4:13]), False
    yield "replaced", " ".join(w[:6] + ["xx"] + w[7:14]), True
    yield "dropped", " ".join(w[:7] + w[8:15]), True
    yield "added", " ".join(w[:7] + ["xx"] + w[7:14]), True
    yield "three of 14 replaced", " ".join("xx" if k in (3, 7, 11) else x for k, x in enumerate(w[:14])), False
    yield "two of 18 changed", " ".join(w[:6] + w[7:12] + ["xx"] + w[12:18]), True
    yield "other order", " ".join(reversed(w)), False
    yield "broken", ITEM.replace("landmark", "land-\nmark").replace(" ", "  "), True
    yield "few", "which upper protocol mirrors", False


def test_leaks(spark):
    rows, want = [], set()
    for k, (_, text, leak) in enumerate(variants()):
        rows.append((k, f"{FILL}. {text} {FILL}", "s"))
        if leak:
            want.add((k, 1))
    rows += [(100, None, "s"), (101, "", "s"), (102, f"{FILL} " * 4000 + ITEM, "s"), (None, ITEM, "s"), (103, f"{ITEM}. {OTHER}", "s"), (103, ITEM, "s")]
    want |= {(102, 1), (103, 1), (103, 2)}
    items = spark.createDataFrame([(1, ITEM, "en", "k", "a"), (2, OTHER, None, None, None), (3, None, None, None, None), (4, "", "en", "k", "a"), (5, "too short", "en", "k", "b")], "item_id long, item_text string, lang string, item_kind string, test_set string")
    found = leaked_items(docs(spark, rows), items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    # a filter that is far too small lets everything pass, and the rows are the same
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(docs(spark, rows), items, most_bits=64).collect()} == want
    report = {r["test_set"]: r.asDict() for r in leak_report(found, items).filter("item_kind = 'k'").collect()}
    assert report["a"]["n_leaked"] == 1 and report["a"]["n_items"] == 2
    assert leaked_items(docs(spark, rows), items.limit(0)).collect() == []
    assert leaked_items(docs(spark, []), items).collect() == []


def edits(item, text):
    """Brute force: longest item stretch that some stretch of the text matches with one error in eight words."""
    best = 0
    for i in range(len(item)):
        for e in range(len(item), i + max(best, 11), -1):
            part = item[i:e]
            row = [0] * (len(text) + 1)  # free start in the text
            for k, x in enumerate(part, 1):
                new = [k]
                for j, y in enumerate(text, 1):
                    new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
                row = new
            if min(row) * 8 <= len(part):
                best = len(part)
                break
    return best


def test_passages_against_edit_distance():
    rnd = random.Random(8)
    for _ in range(150):
        item = [rnd.randrange(1, 5000) for _ in range(rnd.randrange(14, 40))]
        lo = rnd.randrange(0, 4)
        text = [rnd.randrange(9000, 9999) for _ in range(10)]
        since = 9
        for x in item[lo:]:
            since += 1
            what = rnd.random()
            if since > 3 and what < 0.1:
                since = 0
                text += [[], [rnd.randrange(9000, 9999)], [rnd.randrange(9000, 9999), x]][rnd.randrange(3)]
            else:
                text.append(x)
        text += [rnd.randrange(9000, 9999) for _ in range(10)]
        mine = longest_passage(item, list(range(len(item))), text, list(range(len(text))))
        true = edits(item, text)
        # the chain begins and ends with a run, so it may lack edge words; it never finds a leak that isn't one
        assert (mine >= 12) <= (true >= 12)
        if true >= 16:
            assert mine >= 12


def stretch(n, wrong):
    """Words found of a passage of n words in which the words numbered in ``wrong`` are replaced."""
    text = [0] * 4 + [900 + k if k in wrong else k for k in range(1, n + 1)] + [0] * 4
    return longest_passage(list(range(1, n + 1)), list(range(n)), text, list(range(len(text))))


def test_every_short_passage_is_found(spark):
    """Twelve words with one error at any place within, sixteen with two: found by the seeds, not only by the chain."""
    w = [f"w{k}" for k in range(16)]
    rows = [(k, f"{FILL} " + " ".join("xx" if j == k else x for j, x in enumerate(w[:12])) + f" {FILL}", "s") for k in range(1, 11)]
    pairs = list(itertools.combinations(range(1, 15), 2))
    rows += [(100 + n, f"{FILL} " + " ".join("xx" if j in p else x for j, x in enumerate(w)) + f" {FILL}", "s") for n, p in enumerate(pairs)]
    rows += [(300 + k, " ".join(w[:k] + w[k + 1 : 13]), "s") for k in range(1, 12)] + [(400 + k, " ".join(w[:k] + ["xx"] + w[k:12]), "s") for k in range(1, 11)]
    items = spark.createDataFrame([(1, " ".join(w), "en", "k", "a"), (1, "another text of this number " + " ".join(w[:9]), "en", "k", "a")], "item_id long, item_text string, lang string, item_kind string, test_set string")
    assert {r["doc_id"] for r in leaked_items(docs(spark, rows), items).collect()} == {r[0] for r in rows}


def test_filter_before_the_chain_loses_nothing():
    rnd = random.Random(3)
    for _ in range(300):
        item = [f"i{k}" for k in range(rnd.randrange(8, 30))]
        text = [x if rnd.random() < 0.85 else "zz" for x in item if rnd.random() < 0.97]
        if longest_passage(item, list(range(len(item))), text, list(range(len(text)))) >= 12:
            assert may_hold(item, list(range(len(item))), set(text))
    assert not may_hold([], [], set()) and not may_hold(["a"] * 11, list(range(11)), {"a"})


def test_words_between_errors_count():
    assert [stretch(12, {k}) for k in range(2, 12)] == [12] * 10
    assert {stretch(16, set(p)) for p in itertools.combinations(range(2, 16), 2)} == {16}
    assert stretch(16, {5, 7, 9}) < 16  # three errors are too many
    assert stretch(40, {12, 14, 16, 18, 20}) == 40
    # a replaced word at an edge isn't part of the stretch
    assert stretch(12, {1}) == stretch(12, {12}) == 11


# ------------------------------------------------------------------ problem 9
PROSE = "Stride length averaged 28.9 cm over 16 steps on fresh snow, so both readers agreed. We kept photo R-21, since the gravel edge had preserved the second toe below the spruce row. A lone observer logged 9 casts from the bank, all taken with a levelled frame."
SAME = "The otter print beside the other otter print is shallow, and the otter left it at the ford. " * 12
KEYS = "tracks best, cast kit offer, tracks top 10, cast kit free shipping, night camera best, tracks near me, cast kit best, night camera offer, " * 4
LINKS = "\n".join(f"https://spot-{k}.example/cast-kit" for k in range(12))
TAGS = "\n".join(f"SKU-{10000 + 7 * k} | cast kit best | XL | {k},99 | offer" for k in range(10))
TABLE = "\n".join(f"M-{k}; dist{k % 3}; {k}.4; {k + 3}.1" for k in range(20))
COUNTS = "\n".join("Otter 9; Tiger 2; Tapir 6; Panda 1; Puma 8" for _ in range(10))
#: What the prose above teaches, and words of no keyword list.
GLUE = frozenset("a all and at averaged before before. both by cm from had in is it left levelled logged lone observer on over photo preserved readers since so steps stride the we with".split())
WALL = "field ruler casting stone paw print scale bar field ruler cast kit paw print scale bar casting stone field ruler " * 6


@pytest.mark.parametrize(
    "text, spam",
    [(PROSE, False), (SAME, False), (KEYS, True), (LINKS, True), (TAGS, True), (TABLE, False), (COUNTS, False), (WALL, True), (f"{PROSE} {PROSE}\n{LINKS[:150]}", False), (f"{PROSE}\n{TAGS}\n{WALL}", True), ("#cast #kit #cast #tracks #cast #kit #tracks", True), ("", False), (None, False), ("   \n ", False)],
)
def test_spam(text, spam):
    assert (spam_share(text, GLUE)[0] > 0.5) is spam


def keyword_lines(n, times, width, tail=""):
    """Lines of n keywords, each used so many times, in a seeded order."""
    words = [f"kw{chr(97 + k % 26)}{chr(97 + k // 26)}{tail}" for k in range(n)] * times
    random.Random(5).shuffle(words)
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def test_length_and_many_keywords_hide_no_spam():
    for n, times in ((40, 10), (80, 3), (120, 50), (300, 100)):
        assert all(spam_share(keyword_lines(n, times, width))[0] > 0.9 for width in (5, 14)), n
    # pages with keywords of their own, joined, and with less than half as much prose
    joined = "\n".join(keyword_lines(12, 12, 14, tail) for tail in ("a", "b", "c", "d", "e", "f", "g", "h"))
    assert spam_share(joined, GLUE)[0] > 0.9
    assert spam_share(f"{joined}\n" + f"{PROSE}\n" * 12, GLUE)[0] > 0.5
    assert spam_share(f"{PROSE} {SAME}\n" * 40, GLUE)[0] == 0


def test_many_shapes_are_no_list():
    """Half of the page has to lie in few shapes: the same amount over many shapes isn't a list."""
    few = "\n".join(f"https://spot-{k}.example/cast" for k in range(40))
    assert spam_share(few)[0] == 1.0 and spam_share(few)[1] == 1
    assert spam_share(f"{few}\n{TAGS}\n#cast #kit #cast #tracks")[1] == 3


@pytest.mark.parametrize("glue", [["the", "of", "and", "was"], ["das", "von", "und", "war"], ["blorp", "zun", "ik", "mave"]])
def test_prose_words_are_learnt_in_any_language(spark, glue):
    rnd = random.Random(1)
    stuff = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ara", "elo", "imu", "onte", "ulip")]
    rows = []
    for k in range(60):
        body = " ".join(" ".join([rnd.choice(stuff).capitalize()] + [x for _ in range(6) for x in (rnd.choice(glue), rnd.choice(stuff))]) + "." for _ in range(8))
        rows.append((k, body, "s"))
    keys = rnd.sample(stuff, 9)
    rows += [(100 + k, "\n".join(" ".join(rnd.choice(keys) for _ in range(12)) for _ in range(10)), "s") for k in range(6)]
    # prose about few things, said again and again
    rows.append((200, " ".join(" ".join([keys[0].capitalize()] + [x for _ in range(5) for x in (rnd.choice(glue), rnd.choice(keys[:4]))]) + "." for _ in range(30)), "s"))
    learnt = prose_words(docs(spark, rows).select("text"), Stages(spark, "t"))
    assert set(glue) <= learnt and not set(keys) & learnt
    assert sorted(r[0] for r in spam_pages(docs(spark, rows)).collect()) == [100 + k for k in range(6)]


def test_spam_pages(spark):
    rows = [(1, KEYS, "s"), (1, KEYS, "s"), (2, PROSE, "s"), (3, None, "s"), (4, "", "s"), (5, WALL * 300, "s"), (None, KEYS, "s")]
    assert sorted(r[0] for r in spam_pages(docs(spark, rows)).collect()) == [1, 5]
    assert spam_pages(docs(spark, [])).collect() == []


# ------------------------------------------------------------------ problem 8
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
TARGETS = "source string, target_share double, max_repeats int"


@needs_tokenizer
def test_mixture_meets_shares_and_limits(spark):
    rnd = random.Random(2)
    vocab = {s: [f"{s}{k}" for k in range(40)] for s in "abc"}
    rows = []
    for k in range(900):
        s = rnd.choices("abcz", [6, 3, 1, 1])[0]
        text = " ".join(rnd.choice(vocab.get(s, ["zz"])) for _ in range(rnd.randrange(5, 60)))
        rows.append((k, text, rnd.choice([s, s.upper(), f" {s} "]) if rnd.random() < 0.9 else None))
    rows += [(5000, "", "a"), (5001, None, "b"), (None, "a1 a2", "a")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("C ", 0.2, 3), (None, 0.4, 1), ("gone", 0.0, 1)], TARGETS)
    allocation, report = mixture(docs(spark, rows), targets)
    got = {r["source"]: r.asDict() for r in report.collect()}
    for s, share in {"a": 0.5, "b": 0.3, "c": 0.2}.items():
        assert abs(got[s]["share"] - share) < 0.02
        assert got[s]["most_used"] <= got[s]["max_repeats"]
    assert allocation.groupBy("doc_id").count().filter("count > 1").count() == 0
    source = {i: (s or "").strip().lower() for i, _, s in rows}
    rep = allocation.collect()
    assert all(source[r["doc_id"]] in (r["source"], "") for r in rep)
    assert any(source[r["doc_id"]] == "" for r in rep)  # unlabelled texts take part by their posterior


@needs_tokenizer
def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    a, r = mixture(docs(spark, []), targets)
    assert a.collect() == [] and r.first()["share"] == 0
    a, r = mixture(docs(spark, [(1, "x", "a")]), targets.limit(0))
    assert a.collect() == [] and r.collect() == []
    a, r = mixture(docs(spark, [(1, "x y", "a")]), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))
    assert [x["source"] for x in r.filter(F.col("n_tokens") > 0).collect()] == ["a"]
