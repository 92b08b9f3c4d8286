"""Repetition measures, personal data and the compression classifier."""

import hashlib
import random
import re
import zlib

import numpy as np
from edge import documents, empty, strange
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pii, quality_classifier
from ledgerloom.llm import quality_rules as rules
from ledgerloom.llm.common import hash_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def measured(text):
    h, start, end, _ = hash_words([text])
    return rules.measure(text, h, rules.characters([text], start, end), rules.NGRAM_LIMITS, rules.LINE_LIMIT)


def plain_shares(text):
    """Share of characters in lines equal to an earlier one, shares in repeated n-grams, and the verdict."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    chars, of_lines = sum(map(len, words)), sum(map(len, lines))
    dup = sum(len(x) for k, x in enumerate(lines) if x in lines[:k]) / of_lines if of_lines else 0.0
    shares = []
    for n in sorted(rules.NGRAM_LIMITS):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(n)}
        shares.append(sum(len(words[k]) for k in inside) / chars if chars else 0.0)
    fine = dup <= rules.LINE_LIMIT and all(x <= rules.NGRAM_LIMITS[n] for n, x in zip(sorted(rules.NGRAM_LIMITS), shares))
    return dup, shares, fine and not plain_measures(text)[5]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bé", "c#", "\n", "日本", " ", "d", "e", "f", "g"]), max_size=90).map(" ".join), st.integers(0, 2))
def test_shares_and_verdict_against_plain_python(text, copies):
    text = text + "".join(f" w{k}" for k in range(60)) + f"\n{text[:20]}" * copies
    dup, shares, kept = plain_shares(text)
    got = measured(text)
    assert got[6] == dup and np.allclose(got[7], shares) and got[8] == kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bé", "c#", "\n", "日本", "\x0b", " ", "d"]), max_size=60).map(" ".join))
def test_repetition_against_plain_python(text):
    assert measured(text)[:6] == plain_measures(text)


def test_whole_table_of_repetition(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rules.op8_repetition_coverage(spark, sf).collect():
        assert tuple(r)[1:7] == plain_measures(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_repetition_edges(spark):
    got = rules.repetition_coverage(strange(spark)).collect()
    assert len(got) == 11 and sum(r["doc_id"] is None for r in got) == 2
    assert {r["doc_id"]: r["n_words"] for r in got if r["doc_id"] is not None and r["doc_id"] < 5} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}
    assert next(r for r in got if r["doc_id"] == 5)["kept"]
    assert rules.repetition_coverage(empty(spark)).count() == 0


# --------------------------------------------------------------------------- personal data
PATTERNS = [
    (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (2, r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"[^0-9]", "", s)) <= 19 and pii.luhn(re.sub(r"[^0-9]", "", s))),
    (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
]


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, p, ok in PATTERNS for m in re.finditer(p, text) if ok(m[0]))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ0159.@%+-_ ()é", max_size=60) | st.lists(st.sampled_from(["4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "a.b@c.de", "@", "+1 (555) 123-4567", ".", " ", "9", "x@y", "٣"]), max_size=8).map("".join))
def test_base_spans_against_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_known_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    added = 0
    for r in pii.op2_pii_weak_supervision(spark, sf).collect():
        spans = plain_spans(docs[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() == pii.base_digest(docs[r["doc_id"]])
        got = r["spans"].split(",") if r["spans"] else []
        assert set(filter(None, text.split(","))) <= set(got)
        planted = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer('token = "([0-9a-f]{40})"', docs[r["doc_id"]] or "")}
        assert set(got) - set(filter(None, text.split(","))) == planted
        added += len(planted)
    assert added > 0


def plain_em(votes, rounds=100):
    """The same expectation-maximisation, one candidate at a time."""
    m, n = len(votes[0]), len(votes)
    chance = [[list(pii.FIRST[c]) for c in (0, 1)] for _ in range(m)]
    prior, weight = pii.PRIOR, pii.BELIEF * n + 5
    for _ in range(rounds):
        post = []
        for v in votes:
            t, f = prior, 1 - prior
            for k, c in enumerate(v):
                t *= chance[k][0]["10-".index(c)]
                f *= chance[k][1]["10-".index(c)]
            post.append(t / (t + f))
        for k in range(m):
            for c in (0, 1):
                each = [weight * pii.FIRST[c][x] + sum(p if c == 0 else 1 - p for v, p in zip(votes, post) if v[k] == "10-"[x]) for x in range(3)]
                chance[k][c] = [x / sum(each) for x in each]
        prior = (sum(post) + weight * pii.PRIOR) / (n + weight)
    return post


def people_and_keys(n=60):
    """Texts with persons and keys of several looks, and with what only looks like them; and what is personal in each."""
    rng = random.Random(3)
    hexed = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(k))
    first, last = "James Mary Klaus Sabine Pierre Marie José Carmen".split(), "Smith Weber Dupont García Quandt Xylander Olafsson".split()
    texts, want = [], []
    for k in range(n):
        name, key = f"{rng.choice(first)} {rng.choice(last)}", (hexed(40), mixed(120), "eyJ" + mixed(20) + "." + mixed(90) + "." + mixed(30), mixed(360))[k % 4]
        cue, noun = rng.choice(["signed by", "contact", "Dear", "lieber Herr", "nombre:", "signé"]), rng.choice(["token = ", "Passwort: ", "clave = "])
        texts.append(f"it was {cue} {name} and {noun}\"{key}\" here. The Annual Report of {rng.choice(['Great', 'Old'])} Works said version 2024.10.{k:06d} was the great old annual one.")
        want.append({name, key})
    return texts, want


def test_pii_finds_people_and_keys_of_any_length(spark):
    texts, want = people_and_keys()
    docs = documents(spark, texts)
    found = {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["added"]} for r in pii.detect_pii(docs).collect()}
    hit = sum(len({x.removeprefix("Dear ").removeprefix("Herr ") for x in found[k]} & w) for k, w in enumerate(want))
    wrong = sum(len({x.removeprefix("Dear ").removeprefix("Herr ") for x in found[k]} - w) for k, w in enumerate(want))
    assert hit >= 0.95 * 2 * len(texts) and wrong <= 0.02 * len(texts)


def test_the_classifier_overrules_labelers_as_em_by_hand_says():
    texts, _ = people_and_keys()
    rows, against = [c for t in texts for c in pii.candidates(t, pii.base_spans(t))], 0
    for kind in (4, 5):
        own = [(v, f) for _, k, _, v, f in rows if k == kind]
        uniq = sorted(set(own))
        n = np.array([own.count(x) for x in uniq], float)
        post, _ = pii.reliabilities([v for v, _ in uniq], n)
        by_hand = dict(zip(own, plain_em([v for v, _ in own])))
        assert np.allclose(post, [by_hand[x] for x in uniq], atol=1e-6)
        weights = pii.fit([f for _, f in uniq], post, n)
        chosen = {(v, f): pii.decide(f, weights) for v, f in uniq}
        assert len({v for v, _ in uniq}) >= 3 and any(chosen.values())
        against += sum((v[0] == "1") != y for (v, _), y in chosen.items())
    assert against > 0  # decisions that are not the pattern labeler's


def test_pii_labelers_disagree_on_the_whole_table(spark):
    seen = pii.find_spans(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).selectExpr("explode(cand) AS c").select("c.kind", "c.votes").distinct().collect()
    assert len(seen) > 10


def test_pii_edges(spark):
    got = pii.detect_pii(strange(spark)).collect()
    assert len(got) == 11 and all(len(r["spans"]) == 0 for r in got)
    assert pii.detect_pii(empty(spark)).count() == 0


def test_em_tells_good_labelers_from_bad():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in (0.95, 0.9, 0.85, 0.55)], 1)
    texts = ["".join("1" if v else "0" for v in row) for row in votes]
    uniq, inverse, n = np.unique(texts, return_inverse=True, return_counts=True)
    post, acc = pii.reliabilities(list(uniq), n.astype(float))
    assert ((post[inverse] > 0.5) == truth).mean() > 0.95
    right = [(acc[k][0][0] + acc[k][1][1]) / 2 for k in range(4)]
    assert right[0] > right[2] > right[3]


# --------------------------------------------------------------------------- quality
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = bad = kept_bad = lost_good = 0
    for r in quality_classifier.op7_compression_classifier(spark, sf).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            if labels[r["doc_id"]]:
                good += 1
                lost_good += r["predicted"] == 0
            else:
                bad += 1
                kept_bad += r["predicted"] == 1
    assert good > 500 and bad > 50
    assert lost_good / good < 0.02 and kept_bad / bad < 0.15


def test_quality_edges(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(docs, quality_classifier.training_labels(labels))
    got = quality_classifier.classify(strange(spark), model).collect()
    assert len(got) == 11 and len({r["score"] for r in got if r["doc_id"] in (0, 1)}) == 1
    assert quality_classifier.classify(empty(spark), model).count() == 0
    kept = quality_classifier.accepted(strange(spark), model)
    assert kept.columns == strange(spark).columns
    none = quality_classifier.fit(docs.limit(0), labels.limit(0))
    assert quality_classifier.classify(strange(spark), none).count() == 11
