"""Language identification with a linear-chain conditional random field.

Every word of a text is labelled with a language by forward-backward over the
whole chain, so a stretch in another language inside a text is seen as such.
A word's features are its affixes, its character n-grams and, if the lexicon
has it, the word itself; transitions are learned too. Labels for training come
from documents: a document's words carry its language, and chains spliced from
pieces of different documents teach what a switch looks like.

Training reads a bounded sample of labelled rows: ``sample_docs`` documents, those
with an id of the smallest hash, and of each up to
``sample_pieces`` pieces of PIECE words, chosen by their hash from anywhere in
the whole text. Prediction sees whole texts only. A text's language is the one with
the largest mean marginal over its words, which is the score (of equal ones the
first by name); ``certainty`` is the mean of each word's largest marginal, so a
text that changes language may be certain though no language has most of it.

Results: ``und`` with score and certainty 0 for a null or empty text, one without
letters, or a model without training rows. Null languages and rows without an id are never learned.
Repeated rows are told alike and each returned; an empty table gives an empty
result. Words are runs of letters of any length; a row's other columns are not read
but for those carried, whose names may not be the result's (see ``names``).
"""

from __future__ import annotations

import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.stages import bounded, cut
from pulsegrid.llm.textops import SLICE_BYTES, released, slices

#: Documents to learn from, pieces of each, hashed features, words in a piece, steps, and words a worker remembers.
SAMPLE_DOCS, SAMPLE_PIECES, BUCKETS, PIECE, ROUNDS, REMEMBERED = 1200, 24, 1 << 17, 24, 30, 300_000
#: Words that are worked on in one block of a chain, and in one group of chains that are learned from.
BLOCK, GROUP = 32, 1 << 14

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters; numerals that count as word characters, such as ² and ½, part them."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def word_features(word: str) -> list[int]:
    """Hashed features: the word, prefixes and suffixes of 1 to 3 letters, n-grams of 2 and 3 with word ends."""
    grams = ["w" + word]
    for n in (1, 2, 3):
        grams += ["p" + word[:n], "s" + word[-n:]]
    framed = f"^{word}$"
    grams += [framed[i : i + 2] for i in range(len(framed) - 1)]
    grams += ["3" + framed[i : i + 3] for i in range(len(framed) - 2)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in grams]


class Chains:
    """Forward-backward over many chains at once.

    Chains are cut into blocks of BLOCK words. Each block's transfer matrix is
    built for all blocks side by side; messages then run over the blocks of a
    chain, and inside the blocks again side by side. The result is exact.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths = np.asarray(lengths, np.int64)
        blocks = -(-lengths // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        g = int(self.first[-1])
        chain = np.repeat(np.arange(len(lengths)), blocks)
        rank = np.arange(g) - self.first[chain]
        at = (starts[chain] + rank * BLOCK)[:, None] + np.arange(BLOCK)
        self.live = at < starts[chain + 1][:, None]
        self.at = np.where(self.live, at, 0)
        self.head = rank == 0
        self.blocks, self.by_rank = blocks, [self.first[:-1][blocks > r] + r for r in range(int(blocks.max(initial=0)))]

    def marginals(self, emission: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
        """Marginals of every word, the chains' log partition and, if asked, expected moves (summed)."""
        k, g = emission.shape[1], len(self.at)
        top = emission.max(1, keepdims=True)
        psi = np.exp(emission - top)[self.at]
        a, pi = np.exp(move), np.exp(start)
        entry = np.ones((g, k, k)) * np.eye(k)
        through = entry
        logs = np.zeros(g)
        for t in range(BLOCK):
            nxt = (through.reshape(-1, k) @ a).reshape(g, k, k)
            if t == 0:
                nxt[self.head] = pi
            nxt *= psi[:, t, None, :]
            through = np.where(self.live[:, t, None, None], nxt, through)
            if t % 8 == 7 or t == BLOCK - 1:
                scale = through.max((1, 2), keepdims=True)
                through = through / scale
                logs += np.log(scale[:, 0, 0])
        fore, back = np.full((g, k), 1.0 / k), np.ones((g, k))
        fore_log = np.zeros(g)
        for r in range(1, len(self.by_rank)):
            x = self.by_rank[r]
            m = np.matmul(fore[x - 1][:, None, :], through[x - 1])[:, 0]
            s = m.sum(1, keepdims=True)
            fore[x] = m / s
            fore_log[x] = fore_log[x - 1] + np.log(s[:, 0]) + logs[x - 1]
        for r in range(len(self.by_rank) - 1, 0, -1):
            x = self.by_rank[r]
            m = np.matmul(through[x], back[x][:, :, None])[:, :, 0]
            back[x - 1] = m / m.sum(1, keepdims=True)
        alpha, beta = np.empty((BLOCK, g, k)), np.empty((BLOCK, g, k))
        now = fore
        for t in range(BLOCK):
            nxt = now @ a
            if t == 0:
                nxt[self.head] = pi
            nxt *= psi[:, t]
            nxt /= nxt.sum(1, keepdims=True)
            now = np.where(self.live[:, t, None], nxt, now)
            alpha[t] = now
        now = back
        for t in range(BLOCK - 1, -1, -1):
            beta[t] = now
            nxt = (now * psi[:, t]) @ a.T
            nxt /= nxt.sum(1, keepdims=True)
            now = np.where(self.live[:, t, None], nxt, now)
        both = alpha * beta
        both /= both.sum(2, keepdims=True)
        order = self.live.T
        out = np.empty_like(emission)
        out[self.at.T[order]] = both[order]
        moves = None
        if pairs:
            moves = np.zeros((k, k))
            before = fore
            for t in range(BLOCK):
                use = self.live[:, t] & ~(self.head & (t == 0))
                left, right = before[use], (psi[:, t] * beta[t])[use]
                norm = np.einsum("gi,ij,gj->g", left, a, right)
                moves += a * ((left / norm[:, None]).T @ right)
                before = np.where(self.live[:, t, None], alpha[t], before)
        return out, moves


class Model:
    """Learned weights: (BUCKETS, languages) for features, and transitions."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels, self.weights = labels, np.zeros((BUCKETS, k), np.float32)
        self.start, self.move = np.zeros(k), np.zeros((k, k))
        self._rows: dict[str, int] = {}
        self._table = np.zeros((0, k))

    def __getstate__(self):
        return self.__dict__ | {"_rows": {}, "_table": np.zeros((0, len(self.labels)))}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word; distinct words are scored once and remembered within a bound."""
        rows = self._rows
        new = set(words).difference(rows)
        if new:
            if len(rows) + len(new) > REMEMBERED:
                rows.clear()
                self._table, new = self._table[:0], set(words)
            new = list(new)
            ids = [word_features(w) for w in new]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])
            scores = np.add.reduceat(self.weights[np.concatenate(ids)], at, axis=0)
            rows.update(zip(new, range(len(self._table), len(self._table) + len(new)), strict=True))
            self._table = np.concatenate([self._table, scores])
        return self._table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]

    def fit(self, samples: list[tuple[str, str]], seed: int = 7, rounds: int = ROUNDS) -> Model:
        """Maximum likelihood with a small ridge; ``samples`` are (piece of text, label)."""
        rnd = random.Random(seed)
        pieces = []
        for text, label in samples:
            words = words_of(text)
            y = self.labels.index(label)
            pieces += [(words[i : i + PIECE], y) for i in range(0, len(words), PIECE)]
        if not pieces:
            return self
        rnd.shuffle(pieces)
        chains, i = [], 0
        while i < len(pieces):  # half of the words stay in chains of one piece, the rest are spliced
            n = 1 if len(chains) % 3 else 4
            chains.append(pieces[i : i + n])
            i += n
        chains = [[p for p in c if p[0]] for c in chains]
        chains = [c for c in chains if c]
        vocabulary: dict[str, int] = {}
        ids, y, lengths = array("i"), array("i"), []
        for c in chains:
            lengths.append(sum(len(p[0]) for p in c))
            for ws, label in c:
                y.extend([label] * len(ws))
                ids.extend([vocabulary.setdefault(w, len(vocabulary)) for w in ws])
        del pieces, chains
        ids, y, k, v = np.frombuffer(ids, np.int32), np.frombuffer(y, np.int32), len(self.labels), len(vocabulary)
        lexicon = np.bincount(ids, minlength=v) > 1
        features, sizes = array("i"), []
        for w, known in zip(vocabulary, lexicon, strict=True):
            found = word_features(w)
            features.extend(found if known else found[1:])
            sizes.append(len(found) - (not known))
        row = np.repeat(np.arange(v, dtype=np.int32), sizes)
        used, col = np.unique(np.frombuffer(features, np.int32), return_inverse=True)
        col = col.astype(np.int32)
        del vocabulary, features
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        w, start, move = np.zeros((len(used), k)), np.zeros(k), np.zeros((k, k))
        lengths, n = np.array(lengths), len(ids)
        ends = np.cumsum(lengths)
        heads = np.concatenate([[0], ends[:-1]])
        inner = np.ones(n, bool)
        inner[heads] = False
        seen_moves = np.zeros((k, k))
        np.add.at(seen_moves, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
        # chains are independent: a group of them at a time bounds what a round holds
        groups, first = [], 0
        while first < len(lengths):
            last = max(first + 1, int(np.searchsorted(ends, heads[first] + GROUP, "right")))
            groups.append((heads[first], ends[last - 1], heads[first:last] - heads[first], Chains(lengths[first:last])))
            first = last
        grads = [np.zeros_like(x) for x in (w, start, move)]
        for _ in range(rounds):
            scores = np.add.reduceat(w[col], at, axis=0)
            by_word, g_start, moves = np.zeros((v, k)), np.zeros(k), np.zeros((k, k))
            for low, high, own_heads, run in groups:
                p, m = run.marginals(scores[ids[low:high]], start, move, pairs=True)
                d = -p
                d[np.arange(high - low), y[low:high]] += 1
                by_word += np.stack([np.bincount(ids[low:high], d[:, j], v) for j in range(k)], 1)
                g_start += d[own_heads].sum(0)
                moves += m
            g_w = np.stack([np.bincount(col, by_word[row, j], len(used)) for j in range(k)], 1)
            for x, g, held, rate, ridge in ((w, g_w, grads[0], 0.4, 0.3), (start, g_start, grads[1], 0.2, 1.0), (move, seen_moves - moves, grads[2], 0.4, 1.0)):
                g = g - ridge * x
                held += g * g
                x += rate * g / (np.sqrt(held) + 1e-6)
        self.weights[used] = w
        self.start, self.move = start, move
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int, int]]:
        """(language, score, certainty, words, switches) of every text."""
        words = [words_of(t) for t in texts]
        if not self.labels:
            return [("und", 0.0, 0.0, len(w), 0) for w in words]
        lengths = np.array([len(w) for w in words])
        full = np.flatnonzero(lengths)
        out = [("und", 0.0, 0.0, 0, 0)] * len(texts)
        if not len(full):
            return out
        flat = [w for ws in words for w in ws]
        p, _ = Chains(lengths[full]).marginals(self.emissions(flat), self.start, self.move)
        at = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        mean = np.add.reduceat(p, at, axis=0) / lengths[full][:, None]
        best, said = mean.argmax(1), p.argmax(1)
        sure = np.add.reduceat(p.max(1), at) / lengths[full]
        turned = np.zeros(len(said), np.int64)
        turned[1:] = said[1:] != said[:-1]
        turned[at] = 0
        turns = np.add.reduceat(turned, at)
        for j, i in enumerate(full):
            out[i] = (self.labels[best[j]], float(min(1.0, max(0.0, mean[j, best[j]]))), float(min(1.0, max(0.0, sure[j]))), int(lengths[i]), int(turns[j]))
        return out


def _pieces(most: int):
    """(key, text, label) -> the label and up to ``most`` pieces of each text, those with the smallest hash."""

    def run(batches):
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                parts = [" ".join(words[i : i + PIECE]) for i in range(0, len(words), PIECE)]
                chosen = sorted(range(len(parts)), key=lambda i: (zlib.crc32(f"{i} {parts[i]}".encode("utf-8", "surrogatepass")), i))[:most]
                yield pa.RecordBatch.from_pydict({"piece": [parts[i] for i in sorted(chosen)], "label": [label] * len(chosen)}, schema=pa.schema([("piece", pa.string()), ("label", pa.string())]))

    return released(run)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_pieces: int = SAMPLE_PIECES) -> Model:
    """A model from at most ``sample_docs`` labelled documents and ``sample_pieces`` pieces of each."""
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where("id is not null and label is not null and text is not null")

    def least(df: DataFrame, key: str):
        return df.select(key).orderBy(key).limit(sample_docs).agg(F.max(key)).first()[0]

    # ids first: every task sends its smallest hashes, not its texts
    last = least(rows, "h")
    if last is None:
        return Model([])
    # an id may have many rows: those of one hash of everything are the same row again, and of the others the smallest hashes count
    chosen = cut(rows.where(F.col("h") <= last).select(F.xxhash64("h", "text", "label").alias("key"), "text", "label").dropDuplicates(["key"]), "sample")
    chosen = chosen.where(F.col("key") <= least(chosen, "key"))
    pieces = chosen.mapInArrow(_pieces(sample_pieces), "piece string, label string").collect()
    samples = sorted((r["piece"], r["label"]) for r in pieces)
    return Model([x for x, _ in sorted(Counter(label for _, label in samples).items())]).fit(samples)


#: What ``identify`` adds.
NAMES = ("lang_pred", "score", "certainty", "n_words", "n_switches")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), names: tuple[str, ...] = NAMES) -> DataFrame:
    """Language, score, certainty, words and switches of every text, under ``names``, beside the id and the carried columns; no shuffle."""
    if clash := set(names) & {id_col, *carry}:
        raise ValueError(f"carried columns named like results: {sorted(clash)}; give other names")
    # a carried text is not sent twice
    own = text_col not in carry or dict(docs.dtypes)[text_col] != "string"
    held = bounded(docs).select(F.col(id_col), *[F.col(c) for c in carry], *[F.col(text_col).cast("string").alias("__text")] * own)
    at = len(carry) + 1 if own else 1 + list(carry).index(text_col)
    kept = held.schema[: len(carry) + 1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    kinds, width = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), len(carry) + 1

    def run(batches):
        for batch in batches:
            for i, j, _, _ in slices(batch.column(at), SLICE_BYTES >> 2):
                part = batch.slice(i, j - i)
                got = zip(*model.predict(part.column(at).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *[pa.array(list(x), kind) for x, kind in zip(got, kinds, strict=True)]], names=[*part.schema.names[:width], *names])

    added = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "double", "long", "long"), strict=True))
    return held.mapInArrow(released(run), f"{schema}, {added}")


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op2_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), *NAMES)
