"""Licence scans: segments of normalised text against licence templates, by the Dice
coefficient over word bigrams.

A segment is a line, a paragraph of several lines (between blank ones), a whole
text of several paragraphs, or a span: a window of words anywhere in the text, over
lines and paragraphs, where no other segment has the match.  Normalised text is its words in lower case, without
punctuation.  With |A| and |B| bigrams, repeats included, the coefficient is at most
2 min / (|A| + |B|), so only templates whose size lies within a factor
``DICE / (2 - DICE)`` of the segment's are compared, and shared bigrams are counted
through an index of the templates' bigrams.  A match shares at least
``DICE / (2 - DICE)`` of a template's bigrams, so it holds one of a few long words
(anchors) that touch more than the rest of them; a text without any anchor is done.

One pass over the texts, row by row, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import workers_ready
from foldwise.llm.license_templates import TEMPLATES
from foldwise.llm.quality_rules import STOP_WORDS

#: the least coefficient of a match
DICE = 0.8
#: a notice with fewer bigrams is compared with spans of its own size or more, as each word counts in it
SHORT = 20
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Templates:
    """An index of the templates' bigrams, with size bounds and anchors."""

    def __init__(self, templates=None, least: float = DICE):
        if not 0 < least <= 1:
            raise ValueError("the least coefficient must be over 0 and at most 1")
        self.least, self.ratio = least, least / (2 - least)
        self.names, self.sizes, self.counts, self.index, self.anchors = [], [], [], {}, set()
        for name, texts in (TEMPLATES if templates is None else templates).items():
            for text in texts:
                words = words_of(text)
                pairs = list(zip(words, words[1:]))
                if not pairs:
                    raise ValueError(f"a template of {name} has fewer than two words")
                t = len(self.names)
                self.names.append(name)
                self.sizes.append(len(pairs))
                self.counts.append(Counter(pairs))
                for pair, n in Counter(pairs).items():
                    self.index.setdefault(pair, []).append((t, n))
                untouched, spare = list(pairs), (1 - self.ratio) * len(pairs)
                for word in sorted(set(words), key=lambda w: (w in STOP_WORDS, -len(w), w)):  # rare ones first
                    # a segment without any anchor has none of the touched bigrams
                    if len(pairs) - len(untouched) > spare + 1e-9:
                        break
                    self.anchors.add(word)
                    untouched = [p for p in untouched if word not in p]
        self.smallest, self.largest = min(self.sizes) * self.ratio, max(self.sizes) / self.ratio

    def match(self, words: list[str]) -> tuple[str, float] | None:
        """The licence with the greatest coefficient of ``least`` or more, ties to the
        smaller name."""
        n = len(words) - 1
        if n < 1 or not self.smallest - 1e-9 <= n <= self.largest + 1e-9:
            return None
        shared: Counter = Counter()
        for pair, count in Counter(zip(words, words[1:])).items():
            for t, own in self.index.get(pair, ()):
                shared[t] += min(count, own)
        found = [(2 * s / (n + self.sizes[t]), self.names[t]) for t, s in shared.items()
                 if n * self.ratio <= self.sizes[t] + 1e-9 and self.sizes[t] * self.ratio <= n + 1e-9]
        found = [f for f in found if f[0] >= self.least]
        if not found:
            return None
        dice, name = min(found, key=lambda f: (-f[0], f[1]))
        return name, dice

    def scan(self, text: str | None) -> list[tuple[str, str, int, int, float]]:
        """(licence, kind of segment, start, end, coefficient) of every matching segment,
        in characters of the whole text."""
        if not text or self.anchors.isdisjoint(WORD.findall(text.lower())):
            return []
        out, paragraph, paragraphs, every, at = [], [], 0, [], 0

        def look(kind, words, start, end):
            hit = self.match(words)
            if hit:
                out.append((hit[0], kind, start, end, hit[1]))

        def close():
            nonlocal paragraphs
            if paragraph:
                paragraphs += 1
                if len(paragraph) > 1:
                    look("paragraph", [w for p in paragraph for w in p[2]], paragraph[0][0], paragraph[-1][1])
                paragraph.clear()

        for line in text.split("\n"):
            words = words_of(line)
            if words:
                look("line", words, at, at + len(line))
                paragraph.append((at, at + len(line), words))
                every.extend(words if len(every) <= self.largest + 2 else ())
            else:
                close()
            at += len(line) + 1
        close()
        if paragraphs > 1:
            look("text", every, 0, len(text))  # beyond the largest size it can't match
        return out

    def _windows(self, t: int, hits: list[int], pairs: list, last: int):
        """(weight, coefficient, first, last bigram) of the windows that match template ``t`` best, each
        apart from the next.  ``hits``: where its bigrams are, ``last``: the number of bigrams of the text."""
        size, own = self.sizes[t], self.counts[t]
        need, longest = ceil(self.ratio * size - 1e-9), int(size / self.ratio + 1e-9)
        least = size if size < SHORT else 0

        def best(a):
            """(coefficient, -length, shared, index of the last hit) of the best window from hit ``a``."""
            first, end = hits[a], bisect_right(hits, hits[a] + longest - 1)
            if end - a < need or last < least:
                return None
            seen, shared, top = {}, 0, None
            for b in range(a, end):
                pair = pairs[hits[b]]
                seen[pair] = seen.get(pair, 0) + 1
                if seen[pair] <= own[pair]:
                    shared += 1
                    n = max(hits[b] - first + 1, least)
                    if shared >= need and (2 * shared / (n + size), -n) > (top or (0.0, 0))[:2]:
                        top = (2 * shared / (n + size), -n, shared, b)
            return top if top and top[0] >= self.least else None

        a = 0
        while a < len(hits):
            top, at = best(a), a
            if not top:
                a += 1
                continue
            b = a + 1
            while b <= top[3]:  # a later start may fit better
                other = best(b)
                if other and other[:2] > top[:2]:
                    top, at = other, b
                b += 1
            yield top[0] * top[2], top[0], hits[at], hits[top[3]]
            a = top[3] + 1

    def spans(self, text: str | None) -> list[tuple[str, str, int, int, float]]:
        """Like ``scan``, of windows of words over the whole text: for each template the best ones,
        apart from each other; of two that overlap that with the most shared bigrams times its
        coefficient."""
        if not text:
            return []
        words = [(w.lower(), m.start(), m.end()) for m in WORD.finditer(text) for w in (m.group(),)]
        if self.anchors.isdisjoint(w for w, _, _ in words):
            return []
        pairs = [(a[0], b[0]) for a, b in zip(words, words[1:])]
        hits: dict = {}
        for i, pair in enumerate(pairs):
            for t, _ in self.index.get(pair, ()):
                hits.setdefault(t, []).append(i)
        found = [(-weight, -dice, self.names[t], first, end) for t, at in hits.items()
                 for weight, dice, first, end in self._windows(t, at, pairs, len(pairs))]
        starts: list = []  # of the taken windows, which are apart, in order
        ends: list = []
        out = []
        for _, dice, name, first, end in sorted(found):
            k = bisect_right(starts, end + 1)
            if k and ends[k - 1] >= first:
                continue
            starts.insert(k, first)
            ends.insert(k, end + 1)
            out.append((name, "span", words[first][1], words[end + 1][2], -dice))
        return sorted(out, key=lambda s: s[2])

    def find(self, text: str | None) -> list[tuple[str, str, int, int, float]]:
        """Segments of ``scan``, and the spans of which none of them has half the characters or more."""
        out = self.scan(text)
        taken = [(s, e) for _, _, s, e, _ in out]
        return out + [span for span in self.spans(text) if not any(
            2 * (min(e, span[3]) - max(s, span[2])) >= span[3] - span[2] for s, e in taken)]


def scan_licenses(docs: DataFrame, templates=None, least: float = DICE, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """A row per matching segment of ``docs``: doc_id, license, segment (line, paragraph, text
    or span), start, end, dice.

    Null, empty and one-word texts match nothing; repeated rows have their matches each,
    null ids too; other columns are not read; an empty table has no rows.
    """
    workers_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        known = Templates(templates, least)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            rows = [(i, *hit) for i, text in zip(*(batch.column(c).to_pylist() for c in (0, 1))) for hit in known.find(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["doc_id", "license", "segment", "start", "end", "dice"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, segment string, start long, end long, dice double")
