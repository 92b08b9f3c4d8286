"""Substring, line and near-duplicate operators, and decontamination, against brute force."""

import random
import re

import pytest
from compare import assert_same, connect
from edge import documents, empty, strange
from pyspark.sql import functions as F

from ledgerloom.llm import components as CC
from ledgerloom.llm import decontamination as D
from ledgerloom.llm import jaccard_join as J
from ledgerloom.llm import line_dedup as L
from ledgerloom.llm import substring_dedup as S
from ledgerloom.llm.common import attach, hash_words
from ledgerloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), SQL[name])


def words(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def changed(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"x{rng.randrange(4000)}"
    return " ".join(w)


# --------------------------------------------------------------------------- substring
def test_a_passage_inside_lines_is_found(spark):
    rng = random.Random(1)
    passage = ". ".join(words(rng, 12) for _ in range(5)) + "."
    docs = documents(spark, [f"{words(rng, 20)} {passage} {words(rng, 9)}" for _ in range(6)] + [words(rng, 60) for _ in range(4)])
    got = S.repeated_units(docs).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5} and {r["keeper_doc_id"] for r in got} == {0}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] in passage for r in got)
    left = {r["doc_id"]: r["text"] for r in S.remove_spans(docs, S.repeated_units(docs)).collect()}
    assert left[0] == texts[0] and left[8] == texts[8] and len(left[3].split()) < 45


def test_a_passage_without_punctuation_is_found(spark):
    rng = random.Random(2)
    for _ in range(3):
        passage = words(rng, 60)
        docs = documents(spark, [f"{words(rng, 30)} {passage} {words(rng, 25)}" for _ in range(4)] + [words(rng, 200) for _ in range(6)])
        assert {r["doc_id"] for r in S.repeated_units(docs).collect()} == {1, 2, 3}


def covered_words(docs, rows):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = {(r["doc_id"], k) for r in rows for k in range(r["start"], r["end"])}
    return {d: [m[0] for m in re.finditer(r"\S+", t) if (d, m.start()) in at] for d, t in texts.items()}


def test_repeated_runs_of_short_sentences_are_found(spark):
    rng = random.Random(4)
    for sizes in [(4, 4, 4, 4), (7, 7), (9, 2), (3, 3, 3), (2, 9, 2), (1,) * 9, (7, 1)]:
        passage = rng.choice([". ", ".\n"]).join(words(rng, n) for n in sizes) + "."
        docs = documents(spark, [f"{words(rng, 5)}.\n{passage} {words(rng, 6)}.", f"{words(rng, 3)}. {words(rng, 2)}.\n{passage}\n{words(rng, 7)}."])
        assert covered_words(docs, S.repeated_units(docs, passage=8).collect()) == {0: [], 1: passage.split()}


def test_a_paragraph_with_other_line_ends_is_found(spark):
    rng = random.Random(8)
    w = words(rng, 30).split()
    docs = documents(spark, ["\n\n".join([words(rng, 9), "\n".join(" ".join(w[k : k + n]) for k in range(0, 30, n)), words(rng, 9)]) for n in (6, 5)])
    assert covered_words(docs, S.repeated_units(docs).collect()) == {0: [], 1: w}


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_other_units(spark, unit):
    a = "one two three four five six seven eight\n\nnine ten"
    docs = documents(spark, [a + "\n\nx", "y\n\n" + a, "z\n\n" + a.upper()])
    got = S.repeated_units(docs, unit, passage=8).select("doc_id", "start", "end", "keeper_doc_id", "keeper_start").distinct().collect()
    # the unit of eight words, and the run that ends with the two words after it
    assert sorted(map(tuple, got)) == [(d, 3, 3 + n, 0, 0) for d in (1, 2) for n in (39, 49)]


def test_short_repeats_stay_and_passages_go(spark):
    rng = random.Random(11)
    one, two = words(rng, 10) + ".", words(rng, 9) + "."
    docs = documents(spark, [f"{words(rng, 9)}. {one} {words(rng, 9)}. {two} {words(rng, 9)}."] * 1 + [f"{words(rng, 9)}. {one} {words(rng, 9)}.", f"{words(rng, 9)}. {one} {two} {words(rng, 9)}."])
    assert covered_words(docs, S.repeated_units(docs).collect()) == {0: [], 1: [], 2: (one + " " + two).split()}


def test_one_passage_alike_alone_and_amid_words(spark):
    rng = random.Random(12)
    for _ in range(3):
        passage = words(rng, 80)
        docs = documents(spark, [passage + ".", f"{words(rng, 25)} {passage}.", f"{words(rng, 3)}. {passage} {words(rng, 30)}"])
        got = covered_words(docs, S.repeated_units(docs).collect())
        assert not got[0] and min(len(got[1]), len(got[2])) >= 40


def test_repeated_ids_and_no_ids_with_other_texts(spark):
    rng = random.Random(13)
    shared = words(rng, 30) + "."
    texts = [f"{shared} {words(rng, 9)}." for _ in range(4)]
    docs = documents(spark, texts + texts[:1], [5, 5, None, None, 5])
    got = S.repeated_units(docs)
    held = {r["text"]: r["text"] for r in S.remove_spans(docs, got).collect() if shared in r["text"]}
    assert len(held) == 1  # whichever of the texts of id 5 ranks first
    assert {r["keeper_doc_id"] for r in got.collect()} == {5}


def test_substring_edges(spark):
    got = S.repeated_units(strange(spark), passage=8).collect()
    assert {(r["doc_id"], r["keeper_doc_id"]) for r in got} == {(7, 6)}
    assert S.repeated_units(empty(spark)).count() == 0
    assert S.remove_spans(strange(spark), S.repeated_units(strange(spark))).columns == strange(spark).columns


# --------------------------------------------------------------------------- lines
def plain_runs(texts, window, least):
    first, gone = {}, {}
    for d, t in enumerate(texts):
        lines = [x.strip() for x in (t or "").split("\n") if x.strip()]
        for a in range(len(lines) - window + 1):
            run = tuple(lines[a : a + window])
            if sum(len(x.split()) for x in run) >= least and first.setdefault(run, (d, a)) != (d, a):
                gone.setdefault(d, set()).update(range(a, a + window))
    return {d: sorted(x) for d, x in gone.items()}


@pytest.mark.parametrize("window", [1, 2, 3])
def test_runs_against_brute_force(spark, window):
    rng = random.Random(window)
    texts = ["\n".join(rng.choice(["a b c", "d e f", "g h", " a b c ", "", "i j k l", "m"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    got = L.repeated_runs(documents(spark, texts), window, 4).collect()
    assert {r["doc_id"]: r["lines"] for r in got} == plain_runs(texts, window, 4)


def plain_reach(texts, least):
    held = [[x.strip() for x in (t or "").split("\n") if x.strip()] for t in texts]
    seen, gone = set(), {}
    for d, lines in enumerate(held):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone.setdefault(d, set()).update(range(a, b))
                    seen.add(run)
    return {d: sorted(x) for d, x in gone.items()}


@pytest.mark.parametrize("least", [1, 4, 7])
def test_runs_of_any_number_of_lines_against_brute_force(spark, least):
    rng = random.Random(least)
    texts = ["\n".join(rng.choice(["a b c", "d e f", "g h", " a b c ", "", "i j k l", "m", "n o p q r s t"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    got = L.repeated_runs(documents(spark, texts), None, least).collect()
    assert {r["doc_id"]: r["lines"] for r in got} == plain_reach(texts, least)


def test_a_long_line_and_many_short_lines_are_found(spark):
    rng = random.Random(9)
    line, short = words(rng, 50), "\n".join(words(rng, 4) for _ in range(30))
    texts = [f"{words(rng, 5)}\n{x}\n{words(rng, 5)}" for x in (line, line, short, short)] + [line]
    got = {r["doc_id"]: r["lines"] for r in L.repeated_runs(documents(spark, texts), window=None).collect()}
    assert got == {1: [1], 3: [*range(1, 31)], 4: [0]}
    assert {r["doc_id"] for r in L.dedup_lines(documents(spark, texts), window=None).collect()} == {0, 1, 2, 3}


def test_matches_are_extended_to_the_longest_run(spark):
    rng = random.Random(10)
    lines = [words(rng, n) for n in (12, 1, 1, 12, 2)]
    texts = ["\n".join([words(rng, 6), *lines, words(rng, 5)]), "\n".join(lines[3:]), "\n".join([words(rng, 4), words(rng, 4), *lines])]
    got = {(r["doc_id"], r["first"], r["n_lines"], r["source_doc_id"], r["source_first"]) for r in L.matches(documents(spark, texts), window=None).collect()}
    assert got == {(1, 0, 2, 0, 4), (2, 2, 5, 0, 1)}


def test_repeated_ids_with_other_texts_lose_their_own_lines(spark):
    texts = ["a b c d e f\ng h i j k l", "q r s t u v\na b c d e f\ng h i j k l", "a b c d e f\ng h i j k l"]
    out = sorted(r["text"] for r in L.dedup_lines(documents(spark, texts, [3, 3, 3])).collect())
    assert out in ([texts[0], texts[0], "q r s t u v"], [texts[1]])


def test_first_line_occurrences_stay(spark):
    texts = ["x y z u v w\nx y z u v w\nx y z u v w", "a b c d e f\ng h i j k l\nq", "g h i j k l\na b c d e f\ng h i j k l", None, ""]
    out = {r["doc_id"]: r["text"] for r in L.dedup_lines(documents(spark, texts)).collect()}
    assert out == {0: "x y z u v w", 1: texts[1], 2: "g h i j k l", 3: None, 4: ""}


def test_line_edges(spark):
    assert L.repeated_runs(strange(spark)).count() == 0
    assert L.repeated_runs(empty(spark)).count() == 0 and L.dedup_lines(empty(spark)).count() == 0
    out = L.dedup_lines(strange(spark))
    assert out.count() == 11 and out.columns == strange(spark).columns


# --------------------------------------------------------------------------- near duplicates
def plain_join(texts, threshold=0.8):
    grams = {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        grams[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    first = {}
    for d, t in enumerate(texts):
        first.setdefault(t, d)
    links, parent = {d: 0 for d in first.values()}, {d: d for d in range(len(texts))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, t in enumerate(texts):
        if grams[d]:
            parent[d] = root(first[t])
    reps = [d for d in first.values() if grams[d]]
    for i, a in enumerate(reps):
        for b in reps[:i]:
            both = len(grams[a] & grams[b])
            if both and both / (len(grams[a]) + len(grams[b]) - both) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (root(d), links[first[t]] if grams[d] else 0) for d, t in enumerate(texts)}


def test_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 1000)
    rng = random.Random(3)
    base = [words(rng, 90) for _ in range(12)]
    texts = base + [changed(rng, rng.choice(base), rng.randrange(4)) for _ in range(150)] + [words(rng, n) for n in (1, 2, 3, 4, 5, 60)] + ["a b", "a b", "a b ", None, "", " "]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(documents(spark, texts)).collect()}
    assert got == plain_join(texts)


def test_join_edges(spark):
    got = J.jaccard_join(strange(spark)).collect()
    assert len(got) == 11
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    assert all(r["class_id"] is None for r in got if r["doc_id"] is None)
    assert J.jaccard_join(empty(spark)).count() == 0
    out = J.one_of_each(strange(spark))
    assert out.columns == strange(spark).columns and {r["doc_id"] for r in out.collect()} == {0, 1, 2, 3, 4, 5, 6, None}


def test_depth_follows_the_target():
    assert J.recall(J.least_depth(0.8, 24, 0.999), 24, 0.8) >= 0.999 > J.recall(J.least_depth(0.8, 24, 0.999) + 1, 24, 0.8)
    assert J.least_depth(0.8, 24, 0.9999) < J.least_depth(0.8, 24, 0.9)


def test_prefixes_are_shortened_until_the_target(spark, monkeypatch):
    """Pairs near the threshold are missed by long prefixes; the estimate says so and shorter ones find them."""
    used, links_at = [], J.links_at
    monkeypatch.setattr(J, "links_at", lambda *a: used.append(a[4]) or links_at(*a))
    rng = random.Random(14)
    texts = []
    for _ in range(60):
        t = words(rng, 200)
        w = t.split()
        w[50], w[100], w[150], w[180] = "a", "b", "c", "d"  # 20 of 196 shingles differ, so the similarity is 176 / 216
        texts += [t, " ".join(w)]
    got = {r["doc_id"]: r["class_id"] for r in J.jaccard_join(documents(spark, texts)).collect()}
    assert used == [8, 7, 6] and sum(got[k + 1] == k for k in range(0, 120, 2)) == 60
    used.clear()
    J.jaccard_join(documents(spark, [f"{t} end" for t in texts] + texts)).collect()
    assert used[0] == 8 and used[-1] > 5


def test_recall_on_the_whole_table(spark, sf):
    """Every link of the table by brute force over shared shingles."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    first = {}
    for d, t in rows:
        first.setdefault(t, d)
    sets = {d: set(s.tolist()) for d, s in zip(first.values(), J.shingle_sets(list(first)))}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = {(a, b) for held in where.values() for a in held for b in held if a < b}
    want = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    got = {r["doc_id"]: r["n_links"] for r in J.jaccard_join(docs).collect()}
    assert want and sum(got[d] for d in sets) >= 0.99 * 2 * len(want)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(150, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in CC.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[k] == 100 for k in range(101, 160)) and got[200] == 100


def test_attach_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("k is not null and k < 2500")
    inner = attach(rows, keyed, "k", "n").collect()
    assert len(inner) == 2500 and all(r["top"] == (1999 if r["k"] == 0 else r["id"]) for r in inner)
    left = attach(rows, keyed, "k", "n", how="left").collect()
    assert len(left) == 3001 and sum(r["top"] is None for r in left) == 501


# --------------------------------------------------------------------------- decontamination
def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_substituted_passages_are_found(spark):
    rng = random.Random(5)
    tests = [words(rng, n) for n in (40, 25, 15, 8, 3)]
    docs, want = [], set()
    for k, t in enumerate(tests):
        for n in (0, 1, 2) if len(t.split()) > 14 else (0,):
            want.add((len(docs), k))
            docs.append(f"{words(rng, 30)} {changed(rng, t, n).upper()}, {words(rng, 10)}")
    docs += [words(rng, 300) for _ in range(20)]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(documents(spark, docs), items(spark, tests)).collect()}
    assert got == want
    in_blocks = {(r["doc_id"], r["item_id"]) for r in D.contaminated(documents(spark, docs), items(spark, tests), block_tokens=30).collect()}
    assert in_blocks == want
    left = D.decontaminate(documents(spark, docs), items(spark, tests), block_tokens=30)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_exact_containment_on_the_whole_table(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    flat = lambda t: " ".join(t.split())
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if flat(b["text"]) in flat(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in D.op9_spaced_seed_decontamination(spark, sf).collect()}
    assert want and want <= got


def longest_overlap(item, doc, shift):
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    equal = [item[k] == doc[k + shift] for k in range(a, b)]
    fits = [j - i for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if 5 * sum(equal[i:j]) >= 4 * (j - i)]
    return max(fits, default=0)


def test_overlaps_at_the_limits_of_the_rule_count():
    rng = random.Random(6)
    for tokens, n in [(13, 2), (14, 1), (14, 2), (20, 2), (20, 4), (25, 5), (30, 6), (40, 8)] * 20:
        item = words(rng, 60).split()
        doc = words(rng, 7).split() + changed(rng, " ".join(item[20 : 20 + tokens]), n).split() + words(rng, 7).split()
        got, want = D.Index([(0, " ".join(item))]).verify(hash_words([" ".join(doc)], fold=True)[0], 0, -13), longest_overlap(item, doc, -13)
        assert want >= tokens and got is not None and got[2] == want and 5 * got[3] >= 4 * got[2]


def test_seeds_miss_no_overlap_that_counts(spark):
    rng = random.Random(7)
    tests = [words(rng, n) for n in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 40)]
    docs = ["".join(words(rng, 20))]
    for t in tests:
        w = t.split()
        for tokens in range(max(1, len(w) * 4 // 5), min(len(w), 25) + 1):
            for _ in range(4):
                at = rng.randrange(len(w) - tokens + 1)
                docs.append(f"{words(rng, 15)} {changed(rng, ' '.join(w[at : at + tokens]), tokens // 5)} {words(rng, 15)}")
        for at in range(len(w)):
            docs.append(" ".join([*w[:at], "other", *w[at + 1 :]]))
    split = [d.split() for d in docs]
    want = set()
    for k, d in enumerate(split):
        for i, t in enumerate(tests):
            w = t.split()
            if not set(w).isdisjoint(d):
                most = max(longest_overlap(w, d, shift) for shift in range(1 - len(w), len(d)))
                if most >= 13 or 5 * most >= 4 * len(w):
                    want.add((k, i))
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(documents(spark, docs), items(spark, tests)).collect()}
    assert got == want and {i for _, i in want} == set(range(len(tests)))
    left = D.decontaminate(documents(spark, docs), items(spark, tests))
    assert {r["doc_id"] for r in left.collect()} == set(range(len(docs))) - {k for k, _ in want}


def test_decontamination_edges(spark):
    bench = items(spark, [None, "", "one", "two words", "Same text here, the very same text in two rows"])
    got = D.contaminated(strange(spark), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(6, 4), (7, 4), (7, 4)]
    assert D.contaminated(empty(spark), bench).count() == 0 and D.contaminated(strange(spark), bench.limit(0)).count() == 0
    assert D.decontaminate(strange(spark), bench).columns == strange(spark).columns


def test_ids_keep_their_types(spark):
    text = "Same text here, the very same text in two rows"
    docs = documents(spark).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    bench = spark.createDataFrame([("gsm/7", text), ("b", text), (None, text)], "item_id string, text string")
    got = D.contaminated(docs, bench, block_tokens=12).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(d, i) for d in ("d6", "d7") for i in ("b", "gsm/7")]
