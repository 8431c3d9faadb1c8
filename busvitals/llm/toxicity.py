"""Toxicity by a learned lexicon, misspellings included, weighed by context.

* Lexicon: words, and stems with many endings, that stand in toxic training documents far more often than chance would
  have it (a G-square test on document counts). They form a trie.
* Matching: a word is a Levenshtein automaton, run as bit masks of its positions, one mask per number of edits (insert,
  delete, replace, swap of neighbours). Automaton and trie are walked together, and a branch is left as soon as no
  position is alive, so a word is compared with the whole lexicon in a few steps.
* Context: each find is weighed by how often such finds (term, edits) were toxic in training, and by the words of a window
  around it and quotation marks at it, so that quoting a term counts less than using it.
* Score: a logistic model of a document's strongest find and of their sum.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched
from busvitals.sources.scratch import stored

FIT_ROWS = 24_000  # about so many labelled rows, chosen by hash, are fitted on
MOST_TERMS = 5_000  # of the lexicon, the most significant ones
SIGNIFICANT = 26.0  # least G-square of a term
ODDS_RATIO = 3.0  # least ratio of a term's frequency in toxic and in other documents
CLEARER = 1.0  # log-odds that a longer or shorter form of a term must add to be a term of its own
STEM_LETTERS = (4, 8)
STEM_ENDINGS = 4  # least number of different words of a stem
WINDOW = 4  # words before and after a find
THRESHOLD = 0.7
CACHE_WORDS = 300_000  # per worker; bounds memory only
QUOTES = "\"'`«»„“”‚‘’‹›"
QUOTE_PRIOR = -3.0  # log-odds of abuse for a find in quotation marks, until training says otherwise
#: Words that announce a quotation or speak about a word, in the four languages of the tables.
MENTION = frozenset(
    "said says quote quoted quotes quoting called wrote writes word words term terms termed cited "
    "sagte sagt zitat zitierte nannte schrieb wort begriff "
    "dit disait cite citation mot mots terme écrit appelé "
    "dijo dice cita citado palabra palabras término escribió llamó".split())
MENTION_PRIOR = -1.5  # likewise

COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType())])
FEATURES = T.StructType([
    T.StructField("most", T.DoubleType()), T.StructField("sum", T.DoubleType()), T.StructField("count", T.DoubleType()),
    T.StructField("label", T.IntegerType())])
SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()), T.StructField("n_finds", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_PARTS = re.compile(r"[^\W_]+")


def edits_allowed(letters: int) -> int:
    """Edits that a term of so many letters may differ by."""
    return 0 if letters < 4 else 1 if letters < 8 else 2


@dataclass
class Trie:
    """Terms letter by letter; ``term`` at a node where one ends, ``stem`` if anything may follow."""

    next: dict[str, "Trie"] = field(default_factory=dict)
    term: str | None = None
    stem: bool = False

    def add(self, term: str, stem: bool) -> None:
        node = self
        for c in term:
            node = node.next.setdefault(c, Trie())
        node.term, node.stem = term, stem

    def nearest(self, word: str, most: int) -> tuple[str, int] | None:
        """The term nearest to a word and the edits between, at most ``most`` and what the term allows; the longer term on
        ties."""
        full = 1 << len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 2 << i
        best: tuple[int, int, str] | None = None
        # bit i of the k-th mask: i letters of the word are used up with k edits
        todo = [(self, tuple((2 << k) - 1 for k in range(most + 1)), None, "")]
        while todo:
            node, live, before, last = todo.pop()
            if node.term is not None:
                allowed = min(most, edits_allowed(len(node.term)))
                for k in range(allowed + 1):
                    if live[k] & full or node.stem and live[k] >> max(len(node.term) - k, 1):
                        found = (k, -len(node.term), node.term)
                        best = found if best is None or found < best else best
                        break
            for c, child in node.next.items():
                here = masks.get(c, 0)
                made, previous = [], 0
                for k, mask in enumerate(live):
                    now = mask << 1 & here
                    if k:
                        now |= live[k - 1] | live[k - 1] << 1 | previous << 1
                        if before is not None:
                            now |= before[k - 1] << 2 & here << 1 & masks.get(last, 0)
                    previous = now & (full << 1) - 1
                    made.append(previous)
                if any(made):
                    todo.append((child, tuple(made), live, c))
        return (best[2], best[0]) if best else None


_ALL_KINDS = (1 << 61) - 1


def _kinds(word: str) -> int:
    """A bit for each kind of letter; some kinds share one."""
    out = 0
    for c in word:
        out |= 1 << ord(c) % 61
    return out


class Sieve:
    """Tells most words apart from the lexicon before the automaton runs.

    A term that may differ by d edits is cut into d + 1 pieces. An edit spoils one piece, or, where it swaps the letters at a
    cut, makes the swapped pair appear; so a word within d edits holds a piece or a swapped pair, at most d letters off its
    place. Each edit also adds or takes away one kind of letter at most, so no more than d kinds of a term are missing from the
    word, and, unless the term is a stem, none but d of the word's are foreign to it. Nothing within reach is ever sifted out.
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.pieces: dict[str, list[tuple[int, int, int, int, int, int, int]]] = {}
        for term, stem in terms:
            n, d, kinds = len(term), edits_allowed(len(term)), _kinds(term)
            cuts = [n * k // (d + 1) for k in range(d + 2)]
            parts = [(a, term[a:b]) for a, b in zip(cuts, cuts[1:])]
            parts += [(c - 1, term[c] + term[c - 1]) for c in cuts[1:-1]]
            for at, piece in parts:
                self.pieces.setdefault(piece, []).append((at - d, at + d, n - d, 1 << 30 if stem else n + d, d, kinds, _ALL_KINDS if stem else kinds))
        self.sizes = sorted({len(p) for p in self.pieces})

    def edits(self, word: str) -> int:
        """Most edits to look for in a word; -1 if no term can be near it."""
        most, n, pieces, kinds = -1, len(word), self.pieces, None
        for size in self.sizes:
            for k in range(n - size + 1):
                for low, high, short, long, d, own, known in pieces.get(word[k:k + size], ()):
                    if d > most and low <= k <= high and short <= n <= long:
                        kinds = _kinds(word) if kinds is None else kinds
                        if (own & ~kinds).bit_count() <= d and (kinds & ~known).bit_count() <= d:
                            most = d
        return most


@dataclass
class Model:
    """What is learned: a bounded lexicon and a few numbers."""

    terms: list[tuple[str, bool]]
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    bias: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.0)
    _trie: Trie | None = None
    _sieve: Sieve | None = None
    _cache: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_trie": None, "_sieve": None, "_cache": {}}

    def nearest(self, word: str) -> tuple[str, int] | None:
        if self._trie is None or self._sieve is None:
            self._trie, self._sieve = Trie(), Sieve(self.terms)
            for term, stem in self.terms:
                self._trie.add(term, stem)
        most = self._sieve.edits(word)
        return None if most < 0 else self._trie.nearest(word, most)

    def look_up(self, raw: str) -> tuple[str, int] | None:
        """The find of one word as it stands in a text, punctuation and all."""
        cache = self._cache
        if raw in cache:
            return cache[raw]
        if len(cache) >= CACHE_WORDS:
            cache.clear()
        whole = _EDGES.sub("", raw)
        found = self.nearest(whole)
        if (found is None or found[1]) and not whole.isalnum():
            for part in _PARTS.findall(whole):
                if (other := self.nearest(part)) and (found is None or other[1] < found[1]):
                    found = other
        cache[raw] = found
        return found

    def finds(self, text: str | None) -> list[tuple[str, int, frozenset[str]]]:
        """(term, edits, context) of each find in a text. Context: words around it, ``<quoted>``, ``<mention>``."""
        words = (text or "").lower().split()
        look_up, out = self.look_up, []
        for k, w in enumerate(words):
            hit = look_up(w)
            if hit is None:
                continue
            around = [_EDGES.sub("", x) for x in words[max(0, k - WINDOW):k] + words[k + 1:k + 1 + WINDOW]]
            marks = {x for x in around if x in self.context} if self.context else {x for x in around if x}
            if _quoted(words, k):
                marks.add("<quoted>")
            if not MENTION.isdisjoint(around):
                marks.add("<mention>")
            out.append((*hit, frozenset(marks)))
        return out

    def strength(self, find: tuple[str, int, frozenset[str]]) -> float:
        term, edits, marks = find
        return max(0.0, self.weights.get((term, edits), 0.0) + sum(self.context.get(m, 0.0) for m in marks))

    def features(self, text: str | None) -> tuple[tuple[float, float, float], list[tuple[str, int, frozenset[str]]]]:
        """The strongest find, the logarithm of their sum, that of their number in effect; and the finds."""
        found = self.finds(text)
        each = [x for f in found if (x := self.strength(f)) > 0]
        return (max(each, default=0.0), math.log1p(sum(each)), math.log1p(len(each))), found

    def score(self, features: tuple[float, ...]) -> float:
        at = self.bias[0] + sum(w * x for w, x in zip(self.bias[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))


def _quoted(words: list[str], k: int) -> bool:
    """Does a quotation mark open at or shortly before word k and close at or shortly after it?"""
    before = any(w[0] in QUOTES for w in words[max(0, k - WINDOW):k + 1])
    after = any(w.rstrip(".,;:!?)")[-1:] in QUOTES for w in words[k:k + 1 + WINDOW] if w.rstrip(".,;:!?)"))
    return before and after


def g_square(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """Evidence that a word's documents are toxic more often than others; 0 if they are not."""
    rate = all_pos / (all_pos + all_neg)
    if pos + neg == 0 or pos / (pos + neg) <= rate:
        return 0.0
    parts = ((pos, rate * (pos + neg)), (neg, (1 - rate) * (pos + neg)))
    return 2 * sum(n * math.log(n / e) for n, e in parts if n)


def _chosen(candidates: list[tuple[float, float, str, bool]]) -> list[tuple[str, bool]]:
    """Terms from (G-square, log-odds, term, is a stem): the most significant first, whole words before stems, longer ones
    before shorter. A term that begins or continues one chosen before joins only if its odds are clearly higher."""
    chosen: dict[str, tuple[float, bool]] = {}
    begun: dict[str, float] = {}  # beginnings of chosen terms, with the greatest odds
    for g, odds, term, stem in sorted(candidates, key=lambda c: (-c[0], c[3], -len(c[2]), c[2])):
        if g < SIGNIFICANT or term in chosen:
            continue
        above = [chosen[term[:n]][0] for n in range(1, len(term)) if term[:n] in chosen and chosen[term[:n]][1]]
        if any(odds < a + CLEARER for a in above) or stem and odds < begun.get(term, -9.0) + CLEARER:
            continue
        chosen[term] = odds, stem
        for n in range(1, len(term)):
            begun[term[:n]] = max(begun.get(term[:n], -9.0), odds)
    return [(t, stem) for t, (_, stem) in chosen.items()]


def _without_copies(labelled: DataFrame) -> DataFrame:
    """One row of each group of texts with the same least hash of a 3-word shingle: near copies of one toxic text would else
    make a term of every rare word in it. Each label keeps its own."""

    @F.pandas_udf("long")
    def least(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            w = (text or "").lower().split()
            out.append(min((zlib.crc32(" ".join(w[k:k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(w) - 2))), default=0))
        return pd.Series(out, dtype="int64")

    return labelled.withColumn("_least", least("text")).dropDuplicates(["_least", "label"]).drop("_least")


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the rows, by a hash of the text's id, so that reruns agree."""
    n = labelled.count()
    if n <= rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, most_terms: int = MOST_TERMS) -> Model:
    """A model from rows ``doc_id``, ``text``, ``label`` (0 or 1; others are ignored).

    At most about ``fit_rows`` rows are used. The driver gets at most ``most_terms`` terms, their counts, and a few numbers per
    row of the sample. Without toxic or without clean rows nothing is learned, and every score is low.
    """
    rows = stored(_sample(labelled.where(F.col("label").isin(0, 1)), fit_rows).select("doc_id", "text", F.col("label").cast("int").alias("label")), "sample")
    rows = stored(_without_copies(rows).select("text", "label"), "toxic")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_pos, all_neg = totals.get(1, 0), totals.get(0, 0)
    if not all_pos or not all_neg:
        return Model([])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                own = {_EDGES.sub("", w) for w in (text.as_py() or "").lower().split()}
                own = {w for w in own if 3 <= len(w) <= 40}
                counts[label].update(own)
                counts[label].update({w[:n] + "\t" for w in own for n in range(low, min(high, len(w)) + 1)})  # a tab marks a stem
        yield from batched(((w, counts[1][w], counts[0][w]) for w in counts[0].keys() | counts[1].keys()), COUNTS)

    low, high = STEM_LETTERS
    least = max(3, int(SIGNIFICANT / 2 / math.log((all_pos + all_neg) / all_pos)))
    each = stored(rows.mapInArrow(words, COUNTS).groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0"), "words")
    stem = F.col("word").endswith("\t")
    endings = (
        each.where(~stem & (F.length("word") >= low))
        .select(F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.length("word")))).alias("n"), "word")
        .groupBy(F.substring("word", F.lit(1), F.col("n")).alias("term")).agg(F.count(F.lit(1)).alias("endings"))
        .where(F.col("endings") >= STEM_ENDINGS)
    )
    stems = each.where(stem & (F.col("pos") >= least)).select(F.rtrim(F.col("word"), F.lit("\t")).alias("term"), "pos", "neg").join(
        endings, "term").select("term", F.lit(True).alias("stem"), "pos", "neg")
    alone = each.where(~stem).select(F.col("word").alias("term"), F.lit(False).alias("stem"), "pos", "neg")
    found = (
        stems.unionByName(alone).where((F.col("pos") >= least) & (F.col("pos") * float(all_neg) >= F.col("neg") * (ODDS_RATIO * all_pos)))
        .orderBy(F.desc("pos"), "neg", "term", "stem").limit(4 * most_terms).collect()
    )
    odds = lambda pos, neg: math.log((pos + 0.5) / (all_pos + 1)) - math.log((neg + 0.5) / (all_neg + 1))
    model = Model(_chosen([(g_square(r["pos"], r["neg"], all_pos, all_neg), odds(r["pos"], r["neg"]), r["term"], r["stem"]) for r in found])[:most_terms])

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                finds = model.finds(text.as_py())
                counts[label].update({f"{t}\t{d}" for t, d, _ in finds} | {f"\t{m}" for _, _, marks in finds for m in marks} | ({"\t"} if finds else set()))
        yield from batched(((k, counts[1][k], counts[0][k]) for k in counts[0].keys() | counts[1].keys()), COUNTS)

    seen = (
        rows.mapInArrow(found_in, COUNTS).groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(~F.col("word").startswith("\t") | (F.col("pos") + F.col("neg") >= 8)).orderBy(F.desc(F.col("pos") + F.col("neg")), "word")
        .limit(4 * most_terms).collect()
    )
    hits = next(((r["pos"], r["neg"]) for r in seen if r["word"] == "\t"), (0, 0))
    learned = {"<quoted>": QUOTE_PRIOR, "<mention>": MENTION_PRIOR}
    for r in seen:
        term, _, rest = r["word"].partition("\t")
        if term:
            model.weights[term, int(rest)] = max(-3.0, min(8.0, odds(r["pos"], r["neg"])))
        elif rest[:1] == "<":  # marks have weights of their own once training shows them
            rate = (hits[0] + 0.5) / (sum(hits) + 1)
            learned[rest] = max(-3.0, min(0.0, math.log((r["pos"] + rate) / (r["neg"] + 1 - rate)) - math.log(rate / (1 - rate))))
        elif rest and g_square(r["neg"], r["pos"], max(hits[1], 1), max(hits[0], 1)) >= SIGNIFICANT:
            model.context[rest] = max(-3.0, min(0.0, odds(r["pos"], r["neg"]) - odds(*hits)))
    for term, _ in model.terms:  # an edit of a term that training did not show counts somewhat less than the term
        sure = model.weights.get((term, 0), 0.0)
        for d in range(1, edits_allowed(len(term)) + 1):
            model.weights.setdefault((term, d), max(0.0, sure - 0.75 * d))
    model.context |= learned

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((*model.features(t.as_py())[0], y) for b in batches for t, y in zip(b.column(0), b.column(1).to_pylist())), FEATURES)

    data = np.array([tuple(r) for r in rows.mapInArrow(features, FEATURES).collect()], float)
    model.bias = logistic(data[:, :-1], data[:, -1])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``score``, ``predicted``, ``n_finds`` and the distinct ``terms`` found, of whole texts.

    ``held_out`` says that crc32(doc_id as text) mod 3 is 1. Null and empty texts have no finds and score lowest; a null id stays
    null (held out: false); repeated rows are scored each; other columns are not read; an empty table gives an empty
    result. A narrow pass without shuffle; the model is bounded (``MOST_TERMS``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    features, found = model.features(text.as_py())
                    value = model.score(features)
                    yield doc, out, value, int(value >= threshold), len(found), sorted({t for t, _, _ in found})

        yield from batched(rows(), SCORES)

    slim = docs.select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("h"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(run, SCORES)


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1
