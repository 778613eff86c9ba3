"""Cutting texts where no token of a byte-level BPE can span, so that each distinct piece is encoded once.

The public pattern joins one space to the word, number or signs after it, only runs of two or more
white-space characters make tokens of other shapes, and what holds a letter ends in a letter. So where every
space stands alone between other characters, a text may be cut before spaces, around the last line feed
of a run, and between a letter and a sign. Arrow cuts all texts of a batch at once and numbers their distinct
pieces, so Python sees a piece once a batch, not once an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A text with one of these isn't cut: white space beside white space or at an end, white space other than space and line feed, added tokens.
_OTHER = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_UNCUT = f"  | \n|\n |<\\||^ | $|[{_OTHER}]"
#: A letter (of blocks without unassigned places) before an ASCII sign.
_SIGNED = "([A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\\[-`{-~])"
_LINES = "(\n*)\n([^\n])"
_HERE = "\x1f"
#: Pieces longer than this are encoded but not remembered.
LONGEST = 48


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def cut(texts: pa.Array) -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """(entries, n_parts, index, first): text i is the concatenation of the ``entries`` numbered ``index[first[i] : first[i + 1]]``.

    Each entry may be encoded alone. Those after the first ``n_parts`` are whole texts that can't be cut.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    uncut = pc.match_substring_regex(texts, _UNCUT)
    plain = pc.replace_substring(texts.filter(pc.invert(uncut)), " ", _HERE + " ")
    plain = pc.replace_substring_regex(plain, _SIGNED, f"\\1{_HERE}\\2")
    plain = pc.replace_substring_regex(plain, _LINES, f"{_HERE}\\1{_HERE}\n{_HERE}\\2")
    lists = pc.split_pattern(plain, _HERE)
    coded = lists.values.dictionary_encode()
    entries = _strings(coded.dictionary) + _strings(texts.filter(uncut))
    whole = np.zeros(len(texts), bool) if not len(texts) else uncut.to_numpy(zero_copy_only=False)
    counts = np.ones(len(texts), np.int64)
    counts[~whole] = np.diff(lists.offsets.to_numpy())
    first = np.concatenate(([0], np.cumsum(counts)))
    index, inner = np.empty(first[-1], np.int64), np.ones(first[-1], bool)
    inner[first[:-1][whole]] = False
    index[inner] = coded.indices.to_numpy()
    index[~inner] = len(coded.dictionary) + np.arange(whole.sum())
    return entries, len(coded.dictionary), index, first


class Recent:
    """piece -> what ``make`` gives for a list of them, of bounded size in two generations: what was not asked for since the last turn is forgotten."""

    def __init__(self, make, most: int):
        self.make, self.new, self.old, self.most = make, {}, {}, most // 2

    def many(self, pieces: list[str]) -> list:
        """The values of different pieces."""
        found = list(map(self.new.get, pieces))
        missing = [i for i, value in enumerate(found) if value is None]
        for i in missing:
            found[i] = self.old.get(pieces[i])
        unseen = [i for i in missing if found[i] is None]
        for i, value in zip(unseen, self.make([pieces[i] for i in unseen]), strict=True):
            found[i] = value
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new.update((pieces[i], found[i]) for i in missing if len(pieces[i]) <= LONGEST)
        return found


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; a longer text is the last of its slice."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        total += n
        if total > most or i == len(size) - 1:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
