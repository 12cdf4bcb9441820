"""Encoding text with a byte-level BPE vocabulary by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last of its encoding. An
automaton over the vocabulary lists, at every byte, the tokens that end there; the longest one
that is compatible with the last token of the prefix before it is that prefix's last token.
Two tokens are compatible if merging would not have crossed the border between them, which is
found by undoing their merges from the latest on. The ids follow from the last prefix by
back-pointers. The cost is linear in the length of the piece, so a piece of a million letters is no
worse than many short ones.

Defined cases: null and empty texts give an empty list; special tokens' spellings are ordinary
text; repeated ids and extra columns do no harm.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: The splitting pattern of byte-level vocabularies, white space being Unicode's property White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Pieces kept with their ids by each worker; a bound on memory only.
MEMO = 1 << 17


def byte_letters() -> dict[str, int]:
    """The letter each byte has in a byte-level vocabulary file: printable Latin-1 stays, the rest follows from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Vocabulary, automaton and merge tables of one tokenizer file."""

    def __init__(self, model: dict):
        import ahocorasick
        import regex

        letters, vocab = byte_letters(), model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts = {i: (i, i) for i in self.bytes_of}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = whole
            self.parts[whole] = (vocab[a], vocab[b])
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.whole = {b: i for i, b in self.bytes_of.items()}
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) == 1 or self.parts[i] != (i, i):  # a token no merge makes is never an id of ordinary text
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens may stand side by side in an encoding."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > MEMO:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges, latest first. While both sides stand, a merge across the border is due if it
        # ranks before the merge that closed over its own side.
        due = 1 << 60
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < due:
                return False
            left_open, right_open = self.parts[left] != (left, left), self.parts[right] != (right, right)
            if not left_open and not right_open:
                return True
            if left_open and (left > right or not right_open):
                due, left = left, self.parts[left][1]
            else:
                due, right = right + 1, self.parts[right][0]

    def piece(self, text: str) -> list[int]:
        data = text.encode()
        one = self.whole.get(data)
        if one is not None and (len(data) == 1 or self.parts[one] != (one, one)):
            return [one]
        n = len(data)
        ends: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(data.decode("latin-1")):
            ends[end].append(token)
        last = [-1] * (n + 1)
        length = self.length
        for end in range(n):
            for token in sorted(ends[end], key=length.__getitem__, reverse=True):
                start = end + 1 - length[token]
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                    last[end + 1] = token
                    break
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


def encode_corpus(documents: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): every text under the vocabulary file of a public tokenizer.

    The file's model (1.5 MB, fixed) goes to the executors once as a broadcast variable, so they
    need no copy of it. No shuffle; Arrow batches in and out.
    """
    model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]
    sent = documents.sparkSession.sparkContext.broadcast({"vocab": model["vocab"], "merges": model["merges"]})
    schema = documents.select(doc_id).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(sent.value)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids = pa.array([encoder.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[doc_id, "ids"])

    return documents.select(doc_id, text).mapInArrow(run, f"{doc_id} {schema[0].dataType.simpleString()}, ids array<int>")
