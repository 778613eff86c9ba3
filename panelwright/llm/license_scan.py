"""License wording by templates whose optional and replaceable regions are compiled into token automata.

A template is wording with markup: ``<<beginOptional>>`` ... ``<<endOptional>>`` (nested at will) may be left out, and
``<<var;words=a..b>>`` stands for a to b words of any kind. It becomes an automaton over words: an edge a word, a free
edge past an optional region, a chain of edges for any word in a replaceable one. The sets of states that a text
reaches are made when first met and kept, so a further word costs two look-ups. A text is accepted where every mandatory word
stands in its place, no other word between. Base phrases are templates without markup, all of whose places count;
of the others, places are leftmost, then longest, without overlap by template.

A place can begin only where the first words (up to four) of a template stand, which are sought in the bytes of the
text; the automaton starts there and reads at most the template's longest form, so the cost grows with the text.
Texts are read whole, in slices of a megabyte while words are told apart; nothing is shuffled. The templates go to the
tasks with the function, and ``Scanner`` refuses more than ``MOST_STATES`` states of them.

Words are the maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.

Edge cases: a null or empty text has no words, no places and a score of 0; a repeated doc_id is judged a row each, a null one
too; places of different templates may overlap (words count once in the score); a template that may begin with a
replaceable region or match nothing is refused; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.license_templates import PHRASES, TEMPLATES
from panelwright.llm.pieces import chunks

#: ASCII letters lower-cased, digits and bytes beyond ASCII as they are, the others a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MARK = re.compile(r"<<(beginOptional|endOptional|var)[^>]*?(?:words=(\d+)\.\.(\d+))?>>")
MOST_STATES, HEAD_WORDS, SLICE = 100_000, 4, 1 << 20


def spaced(text: bytes) -> bytes:
    """The words of a text, each between single spaces; a text without words gives one space."""
    text, parts, at = text.translate(WORD_BYTES), [], 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        parts.append(b" ".join(text[at:end].split()))
        at = end
    return b" ".join([b"", *filter(None, parts), b""]) if any(parts) else b" "


class Automaton:
    """The words that a template accepts; sets of states are numbered as they are met."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = []  # of each state, the next one by word
        self.any: list[int | None] = []  # the next one by any word
        self.free: list[list[int]] = []  # those reached without a word
        open_at, last, at = [], self._state(), 0
        self.start = last
        for mark in [*MARK.finditer(template), None]:
            for word in spaced(template[at : mark.start() if mark else len(template)].encode()).split():
                last = self._edge(last, self.words, word)
            if mark is None:
                break
            at, kind = mark.end(), mark[1]
            if kind == "beginOptional":
                open_at.append(last)
            elif kind == "endOptional":
                before, after = open_at.pop(), self._state()
                self.free[last].append(after)
                self.free[before].append(after)
                last = after
            else:
                least, most = int(mark[2]), int(mark[3])
                after = self._state()
                for n in range(most + 1):
                    if n >= least:
                        self.free[last].append(after)
                    if n < most:
                        last = self._edge(last, self.any, None)
                last = after
        if open_at:
            raise ValueError("an optional region has no end")
        self.end = last
        self.sets: list[frozenset[int]] = []
        self.numbers: dict[frozenset[int], int] = {}
        self.steps: list[dict[bytes, int]] = []
        self.first = self._number(self._reached({self.start}))
        self.heads = sorted(self._heads(self.first, ()))

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.words) - 1

    def _edge(self, state: int, kind: list, word: bytes | None) -> int:
        new = self._state()
        if word is None:
            kind[state] = new
        else:
            kind[state][word] = new
        return new

    def _reached(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
        return self.numbers[states]

    def _step(self, number: int, word: bytes) -> int:
        states = self.sets[number]
        known = any(word in self.words[s] for s in states)
        key = word if known else b""  # words that no state names lead to the same set
        if key not in self.steps[number]:
            to = {self.words[s][word] for s in states if word in self.words[s]} | {self.any[s] for s in states if self.any[s] is not None}
            self.steps[number][key] = self._number(self._reached(to)) if to else -1
        return self.steps[number][key]

    def _heads(self, number: int, words: tuple[bytes, ...]) -> set[tuple[bytes, ...]]:
        states = self.sets[number]
        stop = self.end in states or any(self.any[s] is not None for s in states)
        if stop and not words:
            raise ValueError("a template must begin with wording")
        if stop or len(words) == HEAD_WORDS:
            return {words}
        return set().union(*(self._heads(self._step(number, w), (*words, w)) for s in states for w in self.words[s]))

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """(words, place after them) of the longest accepted text from the space at ``at``."""
        number, n, found = self.first, 0, None
        while (end := text.find(b" ", at + 1)) > 0:
            word = text[at + 1 : end]
            number = self.steps[number].get(word, -2) if word in self.steps[number] else self._step(number, word)
            if number < 0:
                break
            n, at = n + 1, end
            if self.end in self.sets[number]:
                found = (n, at)
        return found


class Scanner:
    """Automata side by side: (label, whether a base phrase, automaton) each, found by the first words of all of them."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.automata = [(label, True, Automaton(p)) for label, p in phrases.items()] + [(label, False, Automaton(t)) for label, ts in templates.items() for t in ts]
        if sum(len(a.words) for _, _, a in self.automata) > MOST_STATES:
            raise ValueError(f"the templates have more than {MOST_STATES} states")
        #: By the first two words of a head: (head, automata that may begin with it).
        self.heads: dict[bytes, dict[bytes, list[int]]] = {}
        for i, (_, _, automaton) in enumerate(self.automata):
            for head in automaton.heads:
                between = lambda words: b" " + b" ".join(words) + b" "
                self.heads.setdefault(between(head[:2]), {}).setdefault(between(head), []).append(i)

    def starts(self, text: bytes) -> dict[int, list[int]]:
        """By automaton the places where it may begin, each the byte of the space before."""
        found: dict[int, list[int]] = {}
        for pair, heads in self.heads.items():
            at = text.find(pair)
            while at >= 0:
                for head, automata in heads.items():
                    if text.startswith(head, at):
                        for i in automata:
                            found.setdefault(i, []).append(at)
                at = text.find(pair, at + 1)
        return found

    def places(self, text: str | bytes | None) -> tuple[int, list[tuple[str, bool, int, int]]]:
        """(number of words, (label, base, first word, words) of each place by first word)."""
        words, found = spaced(text.encode() if isinstance(text, str) else text or b""), []
        for i, starts in self.starts(words).items():
            label, base, automaton = self.automata[i]
            free_from = 0
            for at in sorted(set(starts)):
                if (base or at >= free_from) and (got := automaton.longest(words, at)):
                    found.append((at, got[0], label, base))
                    free_from = got[1]
        out, word, last = [], 0, 0
        for at, n, label, base in sorted(found):
            word, last = word + words.count(b" ", last, at), at
            out.append((label, base, word, n))
        return words.count(b" ") - 1, out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, places array<struct<label, base, first_word, n_words>>) of each row of ``docs`` (doc_id, text)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    Scanner(templates, phrases)  # refuses bad templates here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        for part in (p for batch in batches for p in chunks(batch)):
            got = [scanner.places(t.as_py()) for t in part.column("text")]
            rows = [[dict(zip(("label", "base", "first_word", "n_words"), p, strict=True)) for p in found] for _, found in got]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array([n for n, _ in got], pa.int64()), "places": pa.array(rows, kind)})

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, n_words long, places array<struct<label: string, base: boolean, first_word: long, n_words: long>>")


def summary(scanned: DataFrame) -> DataFrame:
    """Columns of ``op11``; the score is the share of a text's words within any place."""
    base = F.filter("places", lambda p: p["base"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"]))), ",")
    start = F.transform(base, lambda p: p["first_word"])
    # places come by first word: what each adds is what lies beyond the furthest end before it
    covered = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda a, p: F.struct(F.greatest(a["end"], p["first_word"] + p["n_words"]).alias("end"), (a["sum"] + F.greatest(F.lit(0).cast("long"), p["first_word"] + p["n_words"] - F.greatest(a["end"], p["first_word"]))).alias("sum")),
        lambda a: a["sum"],
    )
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), (covered / F.greatest(F.col("n_words"), F.lit(1))).cast("double").alias("score"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
