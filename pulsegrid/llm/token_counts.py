"""Token counts of whole texts with the whole-token shortcut.

For a SentencePiece BPE model it is first proved, from the vocabulary and with
the library, that no piece holds a space mark after another character, that a
line end is never part of a piece, and which words encode alone as one token.
Words are then counted on their own: proved ones are one token, and only the
rest is merged by the library, once per distinct word. A model without these
properties, and a tokenizers file, is counted by the library on whole texts.

Results: a null or empty text has 0 bytes and 0 tokens. Rows are counted one by one,
so repeated rows and equal or null ids are each returned; an empty table gives an
empty result, other columns are not read. The proof is made once by each worker.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.stages import bounded
from pulsegrid.llm.textops import HELD, released, slices

#: Distinct words that a worker remembers besides the proved ones, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
MARK = "▁"


class _Words(dict):
    """Tokens by word: the proved ones always, and others within a bound."""

    def __init__(self, count, proved: dict[str, int] | None = None):
        self.proved = proved or {}
        super().__init__(self.proved)
        self.count, self.most = count, REMEMBERED + len(self.proved)

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.proved)
            self[word] = n
        return n


class PieceCounter:
    """Counts like ``len(library.encode(text))`` for a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        size = lambda s: len(sp.encode(s))
        self.splits = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and not any("\n" in p for p in pieces)
            and sp.encode("a  b\n\nc ", out_type=str)[0].startswith(MARK)
            and size("\n\n") == 3
            and size("a  b ") == size("a") + size(" b") + 1
            and sp.decode(sp.encode("a  b ")) == "a  b "
        )
        #: after one space; at the start of a line but the first; runs of spaces before a word
        self.spaced = _Words(lambda w: size(w) if w else 1)
        self.bare = _Words(lambda w: size("\n" + w) - 2 if w else 0)
        self.runs = _Words(lambda w: size(w[1:]) if len(w) > 1 else 1)
        if self.splits:
            for p in pieces:
                word = p[1:] if p.startswith(MARK) else p
                if word and MARK not in word:
                    (self.spaced if p.startswith(MARK) else self.bare)[word] = size(word) if p.startswith(MARK) else size("\n" + word) - 2
        # a proved word is one that encodes alone as one token
        self.spaced = self._proved(self.spaced)
        self.bare = self._proved(self.bare)

    @staticmethod
    def _proved(words: _Words) -> _Words:
        return _Words(words.count, {w: n for w, n in words.items() if n == 1})

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.library.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        lines = text.split("\n")
        total, spaced = len(lines) - 1, self.spaced.__getitem__
        for at, line in enumerate(lines):
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                total += self._spacious(line, at == 0)
                continue
            parts = line.split(" ")
            if at:
                total += self.bare[parts[0]]
                total += sum(map(spaced, parts[1:])) if len(parts) > 1 else 0
            elif line:
                total += sum(map(spaced, parts))
            else:
                total += 1  # the mark alone before a line end
        return total

    def _spacious(self, line: str, first: bool) -> int:
        """A line with runs of spaces: each run goes with the word after it."""
        total, run = 0, 1 if first else 0
        parts = line.split(" ")
        for i, word in enumerate(parts):
            run += i > 0
            if word or i == len(parts) - 1:
                if run == 0:
                    total += self.bare[word]
                elif run == 1:
                    total += self.spaced[word]
                else:
                    total += self.runs[" " * run + word]
                run = 0
        return total


class LibraryCounter:
    """Counts with the tokenizers library on whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def __call__(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids) if text else 0


_counters: dict = {}
HELD["counters"] = _counters.clear


def counter(path: str):
    """The counter of a tokenizer file; a worker keeps it from task to task."""
    if path not in _counters:
        _counters[path] = LibraryCounter(path) if path.endswith(".json") else PieceCounter(path)
    return _counters[path]


def _counted(path: str, limit: int):
    def run(batches):
        count = counter(path)
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                texts = batch.column(1)[i:j]
                n = pa.array([count(t) if t else 0 for t in texts.to_pylist()], pa.int64())
                n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], n_bytes, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return released(run, "counters")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text; one pass, no shuffle."""
    texts = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(_counted(tokenizer, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
