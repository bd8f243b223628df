"""Toxicity from a lexicon trie intersected with Levenshtein automata.

The lexicon (whole words and word beginnings) is learnt from labelled documents: a term enters when
its documents are labelled toxic far more often than chance allows. Words of a text run through the
product of the trie and the edit automata of all its terms, which finds misspelt terms too. The
window around each hit tells quotation and report from abuse, and scales the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginwatch.llm.common import held_out, labelled, map_batches, staged

WORD = re.compile(r"\w+")
END = "$"
OPEN, CLOSE = "“„«‹", "”»›"

# Common insults known before any label is seen.
SEEDS = (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile "
    "dummkopf abschaum trottel blödmann crétin connard imbécile ordure idiota estúpido imbécil escoria"
).split()
# Words of report and citation.
REPORTS = frozenset(
    "said says quote quoted quotes cited called wrote word term sagte zitat zitierte wort dit cita citation mot dijo palabra".split()
)


@dataclass
class Term:
    """``text`` is a whole word, or with ``stem`` the beginning of words."""

    text: str
    stem: bool
    weight: float
    edits: int = 0


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    prior: float = -2.0
    quoted: float = 0.3
    misspelt: float = 0.8


def allowed_edits(term: str, stem: bool) -> int:
    """Edits that leave a term recognisable: none below five letters, two from ten on."""
    n = len(term) - stem
    return 0 if n < 5 else 1 if n < 10 else 2


class Matcher:
    """The trie of all terms intersected with their Levenshtein automata, determinised on demand.

    A state is a set of (trie node, edits spent), closed under skipping letters of the term. States
    and moves are kept once met, so a word costs one dictionary lookup per letter until no term is
    within reach of it.
    """

    def __init__(self, terms: list[Term]):
        self.children: list[dict[str, int]] = [{}]
        self.terms: list[list[int]] = [[]]
        self.stems: list[list[int]] = [[]]
        self.reach = [-1]
        self.edits = [t.edits for t in terms]
        for k, term in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], term.edits)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.terms.append([])
                    self.stems.append([])
                    self.reach.append(-1)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], term.edits)
            (self.stems if term.stem else self.terms)[node].append(k)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.at_stem: list[tuple] = []
        self.at_end: list[tuple] = []
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        work = list(found)
        while work:
            node, spent = work.pop()
            for child in self.children[node].values():
                if spent < self.reach[child] and (child, spent + 1) not in found:
                    found.add((child, spent + 1))
                    work.append((child, spent + 1))
        key = frozenset(found)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.at_stem.append(self._hits(key, self.stems))
            self.at_end.append(self._hits(key, self.terms))
        return self.ids[key]

    def _hits(self, key: frozenset, ends: list[list[int]]) -> tuple:
        best: dict[int, int] = {}
        for node, spent in key:
            for term in ends[node]:
                if spent <= self.edits[term]:
                    best[term] = min(spent, best.get(term, spent))
        return tuple(sorted(best.items()))

    def _step(self, state: int, letter: str) -> int:
        found: set[tuple[int, int]] = set()
        for node, spent in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None and spent <= self.reach[child]:
                found.add((child, spent))
            if spent < self.reach[node]:
                found.add((node, spent + 1))
                for other in self.children[node].values():
                    if spent < self.reach[other]:
                        found.add((other, spent + 1))
        self.moves[state][letter] = to = self._state(found)
        return to

    def match(self, word: str) -> dict[int, int] | None:
        """Edits spent for each term that ``word`` is, or begins with; None if there is none."""
        state, hits = self.start, None
        moves, at_stem, sets = self.moves, self.at_stem, self.sets
        for letter in word:
            to = moves[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if at_stem[state]:
                hits = hits or {}
                for term, spent in at_stem[state]:
                    hits[term] = min(spent, hits.get(term, spent))
            if not sets[state]:
                return hits
        for term, spent in self.at_end[state]:
            hits = hits or {}
            hits[term] = min(spent, hits.get(term, spent))
        return hits


def is_quoted(text: str, start: int, end: int, window: int) -> bool:
    """Whether the hit stands inside quotation marks of its window, or beside a word of report."""
    before, after = text[max(0, start - window) : start], text[end : end + window]
    if before.count('"') % 2 == 1 and '"' in after:
        return True
    opened = max(before.rfind(c) for c in OPEN)
    if opened >= 0 and opened > max(before.rfind(c) for c in CLOSE) and any(c in after for c in CLOSE):
        return True
    near = WORD.findall(before)[-3:] + WORD.findall(after)[:3]
    return not REPORTS.isdisjoint(near)


def find_terms(text: str, matcher: Matcher, window: int) -> dict[int, list[tuple[bool, int]]]:
    """Per term its hits in the whole text: (stands in quotation, edits spent)."""
    low = text.lower()
    hits = {}
    for word in set(WORD.findall(low)):
        found = matcher.match(word)
        if found:
            hits[word] = found
    out: dict[int, list[tuple[bool, int]]] = {}
    if hits:
        for m in WORD.finditer(low):
            found = hits.get(m.group())
            if found:
                quoted = is_quoted(low, m.start(), m.end(), window)
                for term, spent in found.items():
                    out.setdefault(term, []).append((quoted, spent))
    return out


def score_text(text: str, model: Model, matcher: Matcher, window: int) -> tuple[float, int, int]:
    """(score, hits, hits in quotation)."""
    logit, n, n_quoted = model.prior, 0, 0
    for term, found in find_terms(text, matcher, window).items():
        n += len(found)
        n_quoted += sum(q for q, _ in found)
        logit += model.terms[term].weight * max(
            (model.quoted if q else 1.0) * model.misspelt**spent for q, spent in found
        )
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), n, n_quoted


def _keys(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w[:k] for w in words for k in range(4, min(len(w), 10) + 1)} | {w + END for w in words if len(w) > 2}


def _log_odds(t: float, n: float, toxic: float, clean: float) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))


def _evidence(t: float, n: float, toxic: float, clean: float) -> float:
    """Likelihood ratio statistic of a term's document counts against no association."""
    total, share = t + n, (toxic + 0.5) / (toxic + clean + 1)
    return 2 * sum(c * math.log(c / (total * p)) for c, p in ((t, share), (n, 1 - share)) if c)


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int, max_terms: int) -> list[Term]:
    """Strongest keys first; of a key and its extensions only the strongest, the longest on ties."""
    order = sorted(counts, key=lambda c: (-round(_evidence(c[1], c[2], toxic, clean), 6), -len(c[0]), c[0]))
    taken: dict[str, Term] = {}
    inner: set[str] = set()
    for key, t, n in order:
        starts = {key[:k] for k in range(1, len(key))}
        if key in inner or not starts.isdisjoint(taken):
            continue
        stem = not key.endswith(END)
        taken[key] = Term(key.removesuffix(END), stem, _log_odds(t, n, toxic, clean))
        inner |= starts
        if len(taken) >= max_terms:
            break
    return list(taken.values())


def _count_keys(rows: DataFrame, known: list[Term], most: int) -> list[tuple[str, int, int]]:
    """Toxic and clean documents per key; toxic ones that a known term explains are left out."""

    def count():
        t, n = Counter(), Counter()
        matcher = Matcher(known)

        def each(batch):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                keys = _keys(text)
                if y != 1:
                    n.update(keys)
                elif not any(matcher.match(k.removesuffix(END)) for k in keys if k.endswith(END)):
                    t.update(keys)
            return []

        def finish():
            keys = list(t.keys() | n.keys())
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield {"key": part, "t": [t[k] for k in part], "n": [n[k] for k in part]}

        each.finish = finish
        return each

    counted = (
        map_batches(rows, "key string, t long, n long", count)
        .groupBy("key")
        .agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        .where((F.col("t") >= 3) & (F.col("t") >= 4 * F.col("n")))
    )
    best = counted.orderBy(F.desc(F.col("t") - 2 * F.col("n")), "key").limit(most)
    return [(r["key"], r["t"], r["n"]) for r in best.collect()]


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    max_rows: int = 20_000,
    max_terms: int = 4_096,
    min_evidence: float = 20.0,
    window: int = 60,
) -> Model:
    """Learn lexicon, tolerance for misspelling and the weight of quoted hits.

    ``max_rows`` bounds the labelled rows used, ``max_terms`` the size of the model. Without labels
    the seed words alone remain. Counting is distributed; the driver sees the terms only.
    """
    rows = staged(labelled(docs, labels, label, max_rows).dropDuplicates())
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    found: list[Term] = []
    for share in (0.1, 0.0) if toxic else ():
        counts = [c for c in _count_keys(rows, found, 16 * max_terms) if _evidence(*c[1:], toxic, clean) >= min_evidence]
        strongest = max((_evidence(*c[1:], toxic, clean) for c in counts), default=0)
        counts = [c for c in counts if _evidence(*c[1:], toxic, clean) >= share * strongest]
        found += choose_terms(counts, toxic, clean, max_terms - len(found))
    known = {t.text for t in found}
    seeds = [Term(w, False, _log_odds(2, 0, toxic, clean)) for w in SEEDS if w not in known]
    model = Model(found + seeds, math.log((toxic + 1) / (clean + 9)))
    for term in model.terms:
        term.edits = allowed_edits(term.text, term.stem)
    if not toxic:
        return model

    def probe():
        matcher = Matcher(model.terms)
        seen: Counter = Counter()

        def each(batch):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for term, found in find_terms(text, matcher, window).items():
                    if all(spent for _, spent in found):
                        seen[(term, "misspelt", y)] += 1
                    else:
                        seen[(-1, "quoted" if all(q for q, _ in found) else "plain", y)] += 1
            return []

        def finish():
            keys = list(seen)
            yield {
                "term": [k[0] for k in keys],
                "kind": [k[1] for k in keys],
                "y": [int(k[2] == 1) for k in keys],
                "n": [seen[k] for k in keys],
            }

        each.finish = finish
        return each

    probed = map_batches(rows, "term int, kind string, y int, n long", probe).groupBy("term", "kind", "y")
    seen = Counter({(r["term"], r["kind"], r["y"]): r["n"] for r in probed.agg(F.sum("n").alias("n")).collect()})
    for k, term in enumerate(model.terms):
        t, n = seen[(k, "misspelt", 1)], seen[(k, "misspelt", 0)]
        if n and t < 4 * n:
            term.edits = 0
    plain = _log_odds(seen[(-1, "plain", 1)] + 2, seen[(-1, "plain", 0)], toxic, clean)
    quoted = _log_odds(seen[(-1, "quoted", 1)] + 1, seen[(-1, "quoted", 0)] + 1, toxic, clean)
    model.quoted = max(0.0, min(1.0, quoted / plain)) if plain > 0 else 0.3
    return model


def score(docs: DataFrame, model: Model, *, window: int = 60) -> DataFrame:
    """All columns of ``docs`` are dropped but doc_id; adds score, n_hits and n_quoted.

    One pass without a shuffle. Null and empty texts have no hits and get the prior's score.
    """

    def scorer():
        matcher = Matcher(model.terms)

        def each(batch):
            found = [score_text(t or "", model, matcher, window) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "score": [f[0] for f in found],
                "n_hits": [f[1] for f in found],
                "n_quoted": [f[2] for f in found],
            }

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", "text"), f"doc_id {kind}, score double, n_hits int, n_quoted int", scorer
    )


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **training) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, n_quoted: one row per row of ``docs``."""
    return score(docs, train(docs, labels, **training)).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_hits",
        "n_quoted",
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **training) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns kept, no shuffle."""
    model = train(docs, labels, **training)

    def keeper():
        matcher = Matcher(model.terms)

        def each(batch):
            keep = [
                score_text(t or "", model, matcher, 60)[0] < threshold for t in batch.column("text").to_pylist()
            ]
            left = batch.filter(pa.array(keep, pa.bool_()))
            return {name: left.column(i) for i, name in enumerate(left.schema.names)}

        return each

    return map_batches(docs, docs.schema, keeper)
