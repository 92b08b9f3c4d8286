"""Personal data: pattern, gazetteer, context and shape labelers, weighed by expectation-maximisation.

Candidates are found by loose scanners that decide nothing.  Labelers vote on each (1 personal, 0 not, or they
abstain); the votes of all documents are counted by vote pattern in Spark, expectation-maximisation estimates from the
counts how each labeler votes on either class, and a logistic span classifier, fitted on the posteriors, decides on
each candidate's features.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, text_batches, texts_to_python

#: The base patterns, and the order in which kinds are listed.
KINDS = ["email", "ip", "card", "phone", "secret", "person"]
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Loose scanners of what the base patterns do not cover; runs have no upper length, and possessive ones keep the scan linear.
KEYED = re.compile(r"[=:]\s{0,2}([\"']?)([^\s,;\"']{6,}+)")
OPAQUE = re.compile(r"(?<![A-Za-z0-9_/+.-])[A-Za-z0-9_/+.-]{12,}+")
NAMED = re.compile(r"(?<![\w-])[A-ZÀ-ÖØ-Þ][\w'-]*+(?:[ ][A-ZÀ-ÖØ-Þ][\w'-]*+)++")
#: Gazetteers of secret prefixes, of given names and of common words in English, German, French and Spanish.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "glpat-", "eyJ")
NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen "
    "anna peter hans julia klaus ursula wolfgang monika jürgen sabine dieter petra stefan andrea markus heike martin birgit "
    "pierre marie jean françoise michel monique philippe isabelle alain nathalie nicolas sylvie christophe valérie laurent martine olivier "
    "josé luis carmen lucía paul laura maría juan carlos ana antonio isabel francisco pilar manuel dolores javier teresa miguel rosa".split()
)
COMMON = frozenset(
    "the of and to in is that it for on with as was at by this be are from or an not but der die das und in zu den von mit ist des im nicht ein eine auf für dem es sich "
    "le la les de des du et en un une que qui dans pour est pas au el los las y del se por con no su al lo como más general public license".split()
)
#: Cue words before a secret, before a number that is none, and before a person, in the same languages.
SECRET_CUES = frozenset("password passwd pwd secret token key apikey api_key access_key credential auth login passwort kennwort schlüssel geheimnis clé jeton contraseña clave secreto".split())
NUMBER_CUES = frozenset("version page figure table section isbn chapter order invoice year line seite abbildung bestellung jahr figura página pedido año commande facture".split())
PERSON_CUES = frozenset("mr mrs ms dr prof by signed author contact name dear herr frau von gezeichnet kontakt monsieur madame mme signé cher señor señora don doña firmado contacto nombre nom".split())

MARKS = ["pattern", "gazetteer", "context", "shape"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        low = at  # the local part: the longest run before "@" that begins after the last match
        while low > last and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        if low < at and (m := DOMAIN.match(text, at + 1)):
            out.append((low, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entropy(s: str) -> float:
    _, n = np.unique(np.frombuffer(s.encode("utf-8", "replace"), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that could be a secret or a person, whatever speaks for or against it."""
    found = {(m.start(2), 4, m.end(2)) for m in KEYED.finditer(text)}
    for m in OPAQUE.finditer(text):
        end = m.start() + len(m[0].rstrip(".-/+"))
        s = text[m.start() : end]
        if len(s) >= 12 and (any("0" <= c <= "9" for c in s) or s != s.lower() and s[1:] != s[1:].lower()):
            found.add((m.start(), 4, end))
    found.update((m.start(), 5, m.end()) for m in NAMED.finditer(text))
    return sorted(found, key=lambda x: (x[0], x[1], -x[2]))


def secret_votes(s: str, before: str, cues: list[str]) -> tuple[str, str]:
    """Votes and features of a possible secret."""
    digits, letters = sum("0" <= c <= "9" for c in s), sum(c.isalpha() for c in s)
    ent, known, words = entropy(s), s.startswith(PREFIXES), [x for x in re.split(r"[^A-Za-z]+", s) if x]
    hexed, number = len(s) >= 20 and all(c in "0123456789abcdefABCDEF" for c in s), letters == 0
    assigned, quoted = before.rstrip()[-1:] in ("=", ":") or before.rstrip(" \"'")[-1:] == "=", before[-1:] in ("'", '"')
    cue, other = any(w in SECRET_CUES for w in cues), any(w in NUMBER_CUES for w in cues)
    mixed = digits >= 3 and letters >= 3
    votes = (
        ("1" if hexed and mixed or len(s) >= 20 and mixed and s != s.lower() else "0" if number or not digits else "-")
        + ("1" if known else "0" if words and len(max(words, key=len)) >= 0.8 * len(s) else "-")
        + ("1" if cue else "0" if other or not (assigned or quoted) else "-")
        + ("1" if ent >= 3.2 and mixed else "0" if ent < 2.5 or not letters else "-")
    )
    share = 4 * digits // max(1, len(s))
    return votes, f"secret|len{min(len(s) // 8, 8)}|ent{min(int(2 * ent), 10)}|digits{share}|hex{int(hexed)}|case{int(s != s.lower())}|pre{int(known)}|cue{int(cue)}|other{int(other)}|set{int(assigned)}|quote{int(quoted)}"


def person_votes(s: str, before: str, cues: list[str], words: set[str]) -> tuple[str, str]:
    """Votes and features of a possible person; `words` are the words of its text."""
    parts = s.split(" ")
    low = [p.lower() for p in parts]
    title = all(p[1:] == p[1:].lower() and len(p) > 1 for p in parts)
    named, common, plain = any(p in NAMES for p in low), any(p in COMMON for p in low), any(p in words for p in low)
    cue, opens, same = any(w in PERSON_CUES for w in cues), not before.strip() or before.rstrip()[-1:] in ".!?\n", len(set(low)) < len(low)
    votes = (
        ("1" if title and 2 <= len(parts) <= 3 and not same else "0" if same or len(parts) > 4 else "-")
        + ("1" if named and not common else "0" if common else "-")
        + ("1" if cue else "0" if opens else "-")
        + ("0" if plain else "1" if title and min(map(len, parts)) >= 3 and not opens else "-")
    )
    return votes, f"person|n{min(len(parts), 5)}|title{int(title)}|name{int(named)}|common{int(common)}|plain{int(plain)}|cue{int(cue)}|opens{int(opens)}|same{int(same)}"


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """(start, kind, end, votes, features) of loose spans that overlap no base span and no earlier candidate.

    Votes are one character for each of MARKS: 1, 0, or - (abstains).  Features are a short text of binned
    properties; both take a bounded number of values.
    """
    out, last, words = [], 0, None  # last: where the last candidate that was taken ends
    begins, reach = [s for s, _, _ in taken], list(itertools.accumulate((e for _, _, e in taken), max))
    for a, kind, b in scan(text):
        k = bisect.bisect_left(begins, b)  # base spans that begin before b, and how far they reach
        if a < last or (k and reach[k - 1] > a):
            continue
        s, before = text[a:b], text[max(0, a - 40) : a]
        cues = [w for w in re.split(r"[^\w]+", before.lower()) if w][-3:]
        if kind == 4:
            votes, features = secret_votes(s, before, cues)
        else:
            words = set(text.split()) if words is None else words
            votes, features = person_votes(s, before, cues, words)
        out.append((a, kind, b, votes, features))
        last = b
    return out


# --------------------------------------------------------------------------- weighing the labelers
#: How a labeler votes to begin with: chances of 1, 0 and - on what is personal, and on what is not.
FIRST = np.array([[0.55, 0.05, 0.40], [0.10, 0.45, 0.45]])
#: Weight of that belief against the counts, as a share of all candidates, and the share that is personal to begin with.
BELIEF, PRIOR = 0.2, 0.1


def reliabilities(votes: list[str], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: posterior of each pattern, and chances (labeler, class, vote), where class 0 is personal.

    Abstaining is a vote of its own: a labeler that mostly speaks up about one class says something by its silence.
    """
    m = len(votes[0]) if votes else 0
    seen = np.array([[[c == x for x in "10-"] for c in v] for v in votes], float).reshape(-1, m, 3)
    acc, prior, post = np.tile(FIRST, (m, 1, 1)), PRIOR, np.full(len(votes), PRIOR)
    weight = BELIEF * counts.sum() + 5
    for _ in range(rounds):
        like = np.einsum("pmv,mcv->pc", seen, np.log(acc)) + np.log([prior, 1 - prior])
        now = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -50, 50)))
        each = np.stack([counts * now, counts * (1 - now)], 1)
        acc = np.einsum("pc,pmv->mcv", each, seen) + weight * FIRST
        acc /= acc.sum(2, keepdims=True)
        prior = float(np.clip((each[:, 0].sum() + weight * PRIOR) / (counts.sum() + weight), 0.001, 0.999))
        done, post = np.abs(now - post).max(initial=0) < 1e-9, now
        if done:
            break
    return post, acc


def fit(features: list[str], target: np.ndarray, counts: np.ndarray, rounds: int = 400) -> dict[str, float]:
    """Logistic weights of the feature parts, on soft labels, with a small ridge."""
    parts = sorted({p for f in features for p in f.split("|")})
    at = {p: i for i, p in enumerate(parts)}
    x = np.zeros((len(features), len(parts)))
    for r, f in enumerate(features):
        for p in f.split("|"):
            x[r, at[p]] = 1
    w, n = np.zeros(len(parts)), counts / max(counts.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (n * (p - target)) + 1e-3 * w)
    return dict(zip(parts, map(float, w)))


def decide(feature: str, weights: dict[str, float]) -> bool:
    return sum(weights.get(p, 0.0) for p in feature.split("|")) >= 0


FOUND = "doc_id long, base array<struct<start:int,kind:int,end:int>>, cand array<struct<start:int,kind:int,end:int,votes:string,feature:string>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and voted candidates of every row's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in text_batches(batches):
            base = [base_spans(t or "") for t in b["text"]]
            cand = [candidates(t or "", s) for t, s in zip(b["text"], base)]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].to_numpy(),
                    "base": [[dict(zip(("start", "kind", "end"), s)) for s in x] for x in base],
                    "cand": [[dict(zip(("start", "kind", "end", "votes", "feature"), s)) for s in x] for x in cand],
                }
            )

    return texts_to_python(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInPandas(run, FOUND)


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, spans array<struct<start,kind,end,added>> by start, then kind.

    Offsets count code points, the end is exclusive.  `kind` is an index into KINDS.  Base spans are always
    there; the method adds candidates (secrets, names) that its classifier accepts.  A null text is empty and
    has no spans.  Repeated rows give repeated results, null ids stay null, an empty table gives an empty
    result, other columns are not read.  Only counts by vote pattern and feature text reach the driver: both
    take a fixed number of values at any input size (3^4 patterns a kind; features are products of small bins).
    """
    found = stage(find_spans(docs, id_col, text_col), "pii")
    seen = found.select(F.explode("cand").alias("c")).groupBy("c.kind", "c.votes", "c.feature").agg(F.count("*").alias("n")).collect()
    weights: dict[str, float] = {}
    for kind in sorted({r["kind"] for r in seen}):
        own = [r for r in seen if r["kind"] == kind]
        n = np.array([r["n"] for r in own], float)
        post, _ = reliabilities([r["votes"] for r in own], n)
        weights |= fit([r["feature"] for r in own], post, n)
    good = sorted({r["feature"] for r in seen if decide(r["feature"], weights)})
    span = lambda added: lambda c: F.struct(c["start"], c["kind"], c["end"], F.lit(added).alias("added"))
    added = F.filter("cand", lambda c: F.array_contains(F.array(*map(F.lit, good)), c["feature"])) if good else F.slice("cand", 1, 0)
    return found.select("doc_id", F.array_sort(F.concat(F.transform("base", span(False)), F.transform(added, span(True)))).alias("spans"))


def joined(spans, kinds: list[str] = KINDS):
    """Column text of spans: kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda k: F.size(F.filter("spans", lambda s: ~s["added"] & (s["kind"] == k))).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def base_digest(text: str | None) -> str:
    """What base_sha256 holds for a text; used by the tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text or "")).encode()).hexdigest()
