"""Fast splitting of texts into the pieces of a byte-level tokenizer, with memoised results.

With the byte-level pattern below a piece never runs from a character that is not
white space over a following space, so every space after such a character starts
a new piece. Batches of texts are therefore cut at spaces first, and the distinct cuts
are looked up in a memo, all in Arrow. A cut of Latin letters with one mark after them
is two pieces, so the memo has the letters only. The pattern itself only runs on other
cuts that were not met before. Other patterns run on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pattern of byte-level pre-tokenizers that the cuts are valid for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a memo after which the older half goes, and the longest text that is kept in it.
MEMO_ENTRIES = 800_000
MEMO_BYTES = 64

#: White space other than the space.
_OTHER_SPACE = frozenset(c for c in map(chr, range(0x10000)) if c != " " and (c.isspace() or regex.match(r"\s", c)))
#: Texts in which a space may belong to a longer run of white space.
_RUNS = "^ |[ " + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(_OTHER_SPACE)) + "] "
#: Marks that are a piece of their own after letters, and cuts of Latin letters with one mark after them at most.
_MARKS = ".,;:!?%*#&$|"
_PLAIN = r"^[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[.,;:!?%*#&$|]?$"


class PieceMemo:
    """Token ids (unsigned, 32 bits) of whole texts.

    encode: gives the ids of one piece, as a sequence of numbers.
    """

    def __init__(self, pattern: str, encode: Callable[[str], Sequence[int]], entries: int = MEMO_ENTRIES):
        self.find = regex.compile(pattern).findall
        self.cutting = pattern == BYTE_LEVEL
        self.encode = encode
        self.entries = entries
        #: Cuts without the space that they start with; of each where its ids begin and how many they are; the ids.
        self.cuts = pa.array([], pa.large_string())
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        #: Pieces of other cuts.
        self.pieces: dict[str, Sequence[int]] = {}
        self.marks = np.zeros(len(_MARKS) + 1, np.uint32)
        self.marks[1:] = [encode(m)[0] for m in _MARKS] if self.cutting else 0

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, bounds = self.flat(pa.array(texts, pa.large_string()))
        at = (bounds * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins, and the end. A null counts as empty."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        column = pc.fill_null(column.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(column, _RUNS) if self.cutting else pa.array(np.ones(len(column), bool))
        words = pc.split_pattern(pc.if_else(whole, "", column), " ")
        offsets = words.offsets.to_numpy()
        cuts = words.flatten()
        coded = cuts.dictionary_encode()
        codes = coded.indices.to_numpy().copy()
        starts, sizes, marks = self._entries(coded.dictionary)
        # What stands before the first cut has no space: one more entry for each text. A text that is not cut is all in it.
        heads = cuts.take(pa.array(offsets[:-1])).to_pylist()
        for i, text in zip(np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist(), column.filter(whole).to_pylist(), strict=True):
            heads[i] = text
        first = [np.array([x for p in self.find(h) for x in self._piece(p)], np.uint32) for h in heads]
        codes[offsets[:-1]] = np.arange(len(heads)) + len(starts)
        own = np.fromiter(map(len, first), np.int64, len(first))
        known = np.concatenate([self.ids, *first, np.zeros(1, np.uint32)])
        starts, sizes, marks = np.concatenate([starts, len(self.ids) + np.cumsum(own) - own]), np.concatenate([sizes, own]), np.concatenate([marks, np.zeros(len(own), np.int64)])
        marked = marks[codes]
        size = (sizes + (marks > 0))[codes]
        ends = np.cumsum(size)
        kind = np.int32 if max(len(known), int(ends[-1])) < 1 << 31 else np.int64
        ids = known[np.repeat((starts[codes] - (ends - size)).astype(kind), size) + np.arange(int(ends[-1]), dtype=kind)]
        at = np.flatnonzero(marked)
        ids[ends[at] - 1] = self.marks[marked[at]]
        return ids, np.concatenate([[0], ends])[offsets]

    def _entries(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct cut: where its ids begin in the memo, how many they are, and the number of a mark after them (0 for none)."""
        if len(self.cuts) > self.entries:
            self._shrink()
        marks = np.zeros(len(cuts), np.int64)
        if self.cutting:
            plain = pc.match_substring_regex(cuts, _PLAIN)
            bare = pc.if_else(plain, pc.utf8_rtrim(cuts, _MARKS), cuts)
            marked = pc.not_equal(pc.binary_length(bare), pc.binary_length(cuts))
            last = pc.utf8_slice_codeunits(cuts.filter(marked), -1)
            marks[np.flatnonzero(marked.to_numpy(zero_copy_only=False))] = pc.index_in(last, pa.array(list(_MARKS), pa.large_string())).to_numpy() + 1
            cuts = bare
        coded = cuts.dictionary_encode()
        bases, codes = coded.dictionary, coded.indices.to_numpy()
        place = pc.fill_null(pc.index_in(bases, self.cuts), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.cuts) + np.arange(len(new))
            self._learn(bases.take(pa.array(new)))
        return self.starts[place][codes], self.sizes[place][codes], marks

    def _learn(self, cuts: pa.Array) -> None:
        """Puts cuts that were not met before into the memo."""
        ids, sizes, encode = [], [], self.encode
        for cut in cuts.to_pylist():
            if cut.isascii() and cut.isalpha() and self.cutting:
                new = encode(" " + cut)
            else:
                new = [x for p in self.find(" " + cut) for x in self._piece(p)]
            ids += new
            sizes.append(len(new))
        sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
        self.cuts = pa.concat_arrays([self.cuts, cuts])

    def _shrink(self) -> None:
        """The newer half stays, but for very long cuts."""
        keep = np.arange(len(self.cuts) // 2, len(self.cuts))
        keep = keep[pc.binary_length(self.cuts).to_numpy()[keep] <= MEMO_BYTES]
        size = self.sizes[keep]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(self.starts[keep] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.cuts, self.starts, self.sizes = self.cuts.take(pa.array(keep)), ends - size, size

    def _piece(self, piece: str) -> Sequence[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(piece) <= MEMO_BYTES:
                if len(self.pieces) > self.entries // 8:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids
