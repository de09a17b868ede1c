"""Toxicity scores from a weighted lexicon matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import cut, texts_of

# Look-alike letters and digits, as folded before matching.
_HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ѵ": "v",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
# Capitals look like the letter that their small form does, but for these.
_CAPITALS = {**{k.upper(): v for k, v in _HOMOGLYPHS.items() if ord(k) > 0x2FF and len(k.upper()) == 1}, "Β": "b", "Ζ": "z", "Η": "h", "Μ": "m", "Ν": "n", "Υ": "y"}
_FOLD = {**{ord(k): v for k, v in (_HOMOGLYPHS | _CAPITALS).items()}, **_INVISIBLE, **_WIDE}
_MIXED = re.compile(r"(?=[^\W\d_]*\d)(?=\d*[^\W\d_])[^\W_]+")
_SIGNS = re.compile(r"(?<=\w)[@$]+(?=\w)")
_OTHER = re.compile(r"[\W_]+")
_DIGIT_TABLE = str.maketrans(_DIGITS)
# Common words of abuse in English, German, French and Spanish, folded; a lexicon may start from them.
SEEDS = (
    "idiot idiots moron morons imbecile scum scumbag trash garbage filth vermin worthless pathetic disgusting stupid loser dumbass bastard "
    "abschaum trottel dummkopf schwachkopf vollidiot wertlos wertloser erbärmlich ekelhaft widerlich dreck dreckskerl versager ungeziefer mistkerl "
    "imbécile crétin ordure raclure vermine minable pitoyable dégoûtant débile salaud connard abruti bouffon "
    "idiota imbécil basura escoria estúpido estúpida cretino patético asqueroso despreciable inútil alimaña miserable"
).split()


def fold(text: str) -> str:
    """Lower case, look-alikes of either case and full-width forms to plain letters, digits within words to letters; words between single spaces."""
    t = text.translate(_FOLD).lower()
    if "@" in t or "$" in t:
        t = _SIGNS.sub(lambda m: m[0].replace("@", "a").replace("$", "s"), t)
    if any(d in t for d in "01345789"):
        t = _MIXED.sub(lambda m: m[0].translate(_DIGIT_TABLE), t)
    return f" {_OTHER.sub(' ', t).strip()} "


class Lexicon:
    """Weighted terms, with a trailing * for word beginnings, phrases that excuse a term inside them, and a calibration."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), calibration: tuple[float, float, float] = (-2.0, 1.5, 0.5)):
        self.weights, self.exceptions, self.calibration = weights, tuple(exceptions), calibration

    def matcher(self):
        """A function from a text to (weighted hits, words)."""
        machine = ahocorasick.Automaton()  # every key starts at the space before a word
        for term, weight in self.weights.items():
            key = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            machine.add_word(key, (len(key), weight))
        for phrase in self.exceptions:
            key = f" {phrase} "
            machine.add_word(key, (len(key), 0.0))
        if len(machine):
            machine.make_automaton()

        def hits(text: str) -> tuple[float, int]:
            t = fold(text)
            words = t.count(" ") - 1 if len(t) > 2 else 0
            total, excused, found = 0.0, [], {}
            if len(machine):
                for end, (size, weight) in machine.iter(t):
                    if weight:
                        found[end - size + 1] = max(found.get(end - size + 1, 0.0), weight)
                    else:
                        excused.append((end - size + 1, end))
            # one sweep: a hit is excused if a phrase that begins at it or before reaches beyond it
            excused.sort()
            i, reach = 0, -1
            for begin in sorted(found):
                while i < len(excused) and excused[i][0] <= begin:
                    reach = max(reach, excused[i][1])
                    i += 1
                if begin >= reach:
                    total += found[begin]
            return total, words

        return hits

    def score(self, total: float, words: int) -> float:
        """0 to 1: logistic in the weighted hits and in their number per hundred words."""
        a, b, c = self.calibration
        x = a + b * math.log1p(total) + c * math.log1p(100 * total / max(words, 1))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled documents, chosen by a hash of doc_id."""
    ids = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).orderBy(F.xxhash64("__id"), "y").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select(F.coalesce("text", F.lit("")).alias("text"), "y").dropDuplicates()


def _count_terms(sample: DataFrame) -> DataFrame:
    """(term, pos, neg): in how many toxic and other texts each word, each 3 to 6 letter beginning and each word pair occurs."""

    def run(batches):
        total: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(texts_of(batch), batch.column(1).to_pylist()):
                words = fold(text.decode("utf-8", "replace")).split()
                for term in {*words, *(w[:k] + "*" for w in {*words} for k in range(3, 7) if len(w) > k), *(f"{a} {b}" for a, b in zip(words, words[1:]))}:
                    total.setdefault(term, [0, 0])[0 if y else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([a for a, _ in total.values()], pa.int64()), pa.array([b for _, b in total.values()], pa.int64())], ["term", "pos", "neg"])

    return sample.mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, least: int = 4, surprise: float = 20.0, share: float = 0.03, lift: float = 40.0, seeds=(), prior: int = 2) -> Lexicon:
    """Learns a lexicon from at most `most` labelled documents (a bound of this fit, by hash of doc_id; scoring has none).

    A term is a word or a word's beginning that at least `least` toxic texts have and that is `lift` times likelier there, with a
    log-likelihood ratio of `surprise`, so that chance among some hundred thousand candidates does not reach it. Of a word
    and its beginnings the longest that still has nine tenths of the texts stands. Each toxic text then has one vote, shared
    by its candidates, and terms need `share` of the best term's votes: the many chance words of a text with many copies
    get next to none. A term's weight is its smoothed log odds. `seeds` are words known to be abuse, of which few tables have
    enough examples in every language: they count as if `prior` more toxic texts had them, and stand if their odds then speak
    for them. Word pairs around a term, or around a word that begins like one, that only other texts have become exception
    phrases. What reaches the driver are the terms and phrases that stand these tests in the bounded sample, all of them.
    Null texts are empty, repeated (text, label) rows count once; without toxic examples, so for an empty table, the lexicon
    is empty and all texts score the same.
    """
    sample = cut(_labelled(docs, labels, most))
    counts = cut(_count_terms(sample))
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    odds = lambda p, q: math.log((p + 0.5) / (pos + 1)) - math.log((q + 0.5) / (neg + 1))
    likelier = counts.where(f"pos >= {least} and instr(term, ' ') = 0").where(F.expr(f"(pos + 0.5) / {pos + 1} > {lift} * (neg + 0.5) / {neg + 1}"))
    found = {r.term: (r.pos, r.neg) for r in likelier.where(_surprise(F.col("pos"), pos, F.col("neg"), neg) >= surprise).collect()}
    found = _longest(found)
    support = _support(_incidence(sample.where("y = 1"), list(found)), list(found))
    floor = max([share * v for v in support.values()], default=0.0)
    chosen = {t: max(0.1, odds(*found[t])) for t in sorted(found) if support[t] >= floor}
    if pos and seeds:
        words = sorted({fold(w).strip() for w in seeds})
        had = {r.term: (r.pos, r.neg) for r in counts.where(F.col("term").isin(words)).collect()}
        for w in words:
            p, q = had.get(w, (0, 0))
            if w not in chosen and odds(p + prior, q) > math.log(lift):
                chosen[w] = odds(p + prior, q)
    exceptions = _exceptions(counts.where(f"pos = 0 and neg >= {least} and instr(term, ' ') > 0"), list(chosen)) if chosen else ()
    lexicon = Lexicon(chosen, exceptions)
    scored = _hits(sample.select(F.col("y").cast("long").alias("doc_id"), "text"), lexicon).collect()
    lexicon.calibration = _calibrate(scored)
    return lexicon


def _exceptions(pairs: DataFrame, terms: list[str]) -> tuple[str, ...]:
    """The word pairs of which one word is a term or begins like one."""
    whole = {t for t in terms if not t.endswith("*")}
    stems = tuple(t[:-1] for t in terms if t.endswith("*"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([any(w in whole or (stems and w.startswith(stems)) for w in t.split()) for t in batch.column(0).to_pylist()], pa.bool_()))

    return tuple(sorted(r.term for r in pairs.select("term").mapInArrow(run, "term string").collect()))


def _incidence(sample: DataFrame, terms: list[str]) -> list[set[int]]:
    """Which of the terms each text of the bounded sample has."""
    index = {t: i for i, t in enumerate(terms)}

    def run(batches):
        for batch in batches:
            out = []
            for text in texts_of(batch):
                words = set(fold(text.decode("utf-8", "replace")).split())
                out.append(sorted({index[t] for w in words for t in (w, *(w[:k] + "*" for k in range(3, 7) if len(w) > k)) if t in index}))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["terms"])

    return [set(r.terms) for r in sample.select("text").mapInArrow(run, "terms array<int>").collect()]


def _longest(found: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """The terms without beginnings that a longer term almost equals, and without what a standing beginning covers."""
    children: dict[str, int] = {}
    for term, (p, _) in found.items():
        stem = term.rstrip("*")
        for k in range(3, len(stem) + (not term.endswith("*"))):
            children[stem[:k]] = max(children.get(stem[:k], 0), p)
    stems = {t[:-1] for t in found if t.endswith("*") and children.get(t[:-1], 0) < 0.9 * found[t][0]}
    covered = lambda t: any(t.rstrip("*")[:k] in stems for k in range(3, len(t.rstrip("*")) + (not t.endswith("*"))))
    return {t: v for t, v in found.items() if (not t.endswith("*") or t[:-1] in stems) and not covered(t)}


def _support(texts: list[set[int]], names: list[str]) -> dict[str, float]:
    votes = dict.fromkeys(names, 0.0)
    for t in texts:
        for i in t:
            votes[names[i]] += 1 / len(t)
    return votes


def _surprise(p, pos: int, q, neg: int) -> F.Column:
    """The log-likelihood ratio statistic of a term in p of pos and q of neg texts."""
    rate = (p + q) / max(1, pos + neg)

    def part(k, n, r):
        return F.when((k > 0) & (r > 0), k * F.ln(k / F.greatest(n * r, F.lit(1e-300)))).otherwise(F.lit(0.0))

    return 2 * (part(p, pos, rate) + part(pos - p, pos, 1 - rate) + part(q, neg, rate) + part(neg - q, neg, 1 - rate))


def _calibrate(rows) -> tuple[float, float, float]:
    """Logistic regression by Newton steps on (weighted hits, hits per hundred words), with a small ridge."""
    if not rows or len({r.doc_id for r in rows}) < 2:
        return Lexicon({}).calibration
    t, w, y = (np.array([float(v) for v in c]) for c in zip(*((r.total, max(r.words, 1), r.doc_id) for r in rows)))
    x = np.stack([np.ones(len(t)), np.log1p(t), np.log1p(100 * t / w)], 1)
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3) * len(t) / 1000 + 1e-6 * np.eye(3), x.T @ (y - p) - 0.05 * b * len(t) / 1000)
        b += np.clip(step, -2, 2)
    return tuple(float(v) for v in b)


def _hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches):
        hits = lexicon.matcher()
        for batch in batches:
            found = [hits(t.decode("utf-8", "replace")) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.int64()), pa.array([lexicon.score(a, b) for a, b in found], pa.float64())], ["doc_id", "total", "words", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, total double, words long, score double")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, total, words, score) for each row of docs; nothing but the text counts. No shuffle; an empty table gives no rows.

    total: summed weights of the matched terms outside exception phrases, one per word; score: 0 to 1, see Lexicon.score.
    Null and empty texts have no words and get the score of a text without hits. Repeated rows keep a row each.
    """
    return _hits(docs, lexicon)
