"""Token ids in a compact file format: canonical length-limited Huffman codes.

Texts are encoded once and staged. Global id counts give one code for the whole
file (its table is bounded by the vocabulary). Documents are range-partitioned
by id and packed, in ascending id order, into independent blocks: a block holds
whole documents, the coded bits, and the bit offset of every ``STEP``-th id, so
a reader decodes all stretches of a block side by side from one table. Blocks
and code lengths are rows of Parquet files, so Spark's committers write them
and any store that Spark reads will do.

Results: a null text counts as empty and has only the end id. Rows with equal
ids keep one row each, ordered by their token ids; null document ids come first.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.stages import bounded, cut, free, new_folder
from pulsegrid.llm.textops import _GAP, HELD, released, slices, words

#: Longest code in bits, ids between two checkpoints, ids in a block (a longer document has a block of its own).
MAX_BITS, STEP, BLOCK_IDS = 18, 64, 1 << 18
BLOCK = "part int, block int, part_offset long, doc_ids binary, counts binary, n_ids long, n_bits long, bits binary, checkpoints binary"


def id_type(tokenizer: str) -> str:
    """Two bytes hold an id of a vocabulary of up to 65,536."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def lowers(tokenizer: str) -> bool:
    """Whether the tokenizer composes (NFC) and lowers texts before anything else."""
    from tokenizers import Tokenizer

    steps = Tokenizer.from_file(tokenizer).normalizer
    return steps is not None and steps.normalize_str("E\u0301A \u0130") == "\u00e9a i\u0307"


class Chunks:
    """``ids``: bytes of the ids of a chunk without spaces, by its UTF-8. Bounded; kept from task to task of a worker.

    New chunks of a slice are found together: those of letters only are one
    pre-token each, so the library encodes many of them in one text; a word with
    ASCII marks after it is the word and the marks; any other goes alone. Words
    of plain lower-case Latin letters, which no normalizer changes, go to the
    same model without its normalizer, if that gives the same ids for a sample.
    """

    _PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
    _SAMPLE = ("the", "tions", "zebra", "été", "straße", "señor", "unthinkableness", "qzxv", "déjà")

    _MARKS = ".,;:!?*&$#%)\"]}-_/\\|+=~^`@"
    _known: dict[tuple[str, str], Chunks] = {}

    def __init__(self, path: str, kind: str, most: int = 500_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.ids: dict[bytes, bytes] = {b"": b""}
        self.library, self.kind, self.most = Tokenizer.from_file(path), kind, most
        self.library.no_truncation()
        self.library.no_padding()
        encoded = lambda t, w: t.encode(w, add_special_tokens=False).ids
        #: Whether marks at the end of a chunk always are tokens of their own after a letter.
        self.parts = all(encoded(self.library, w + m) == encoded(self.library, w) + encoded(self.library, m) for w in ("the", "zebra", "qzxv", "a.b", "--x", "1a", "it's", "été") for m in (*self._MARKS, self._MARKS, "...", ".,", "--"))
        self.plain = self.library
        if lowers(path):
            bare = Tokenizer.from_file(path)
            bare.normalizer = normalizers.Sequence([])
            bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            if all(encoded(bare, w) == encoded(self.library, w) for w in self._SAMPLE):
                self.plain = bare

    @classmethod
    def of(cls, path: str, kind: str) -> Chunks:
        if (path, kind) not in cls._known:
            cls._known[path, kind] = cls(path, kind)
        return cls._known[path, kind]

    def alone(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def found(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of ``chunks``, which are distinct; what a word with marks has is put together, not remembered."""
        known = self.ids
        out = list(map(known.get, chunks))
        new = [i for i, x in enumerate(out) if x is None]
        if not new:
            return out
        if len(known) + len(new) > self.most:
            # what came first comes often: the first half stays
            kept = dict(itertools.islice(known.items(), self.most // 2))
            known.clear()
            known.update(kept)
        words, marked = {}, []
        for i in new:
            c = chunks[i].decode("utf-8", "surrogatepass")
            core = c.rstrip(self._MARKS)
            if len(core) == len(c):
                if c.isalpha():
                    words[c] = i
                else:
                    out[i] = known[chunks[i]] = self.alone(c)
            elif self.parts and core.isalpha() and core.lower().isalpha():
                marks = c[len(core) :].encode()
                marked.append((i, chunks[i][: -len(marks)], marks))
                if marked[-1][1] not in known:
                    words.setdefault(core)
            else:
                out[i] = known[chunks[i]] = self.alone(c)
        plain = [w for w in words if self._PLAIN(w)]
        for library, many in ((self.plain, plain), (self.library, [w for w in words if not self._PLAIN(w)])):
            for i in range(0, len(many), 256):
                self._together(library, many[i : i + 256])
        for i in words.values():
            if i is not None:
                out[i] = known[chunks[i]]
        for i, core, marks in marked:
            if marks not in known:
                known[marks] = self.alone(marks.decode())
            out[i] = known[core] + known[marks]
        return out

    def _together(self, library, words: list[str]) -> None:
        """The ids of words of one pre-token each, told apart in one text by the pre-token of every id."""
        got = library.encode(" ".join(words), add_special_tokens=False)
        ids, of = np.array(got.ids, self.kind), np.array([-1 if x is None else x for x in got.word_ids], np.int64)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        if len(first) == len(words) and (of[first] == np.arange(len(words))).all():
            raw, width = ids.tobytes(), ids.itemsize
            at = (np.append(first, len(ids)) * width).tolist()
            self.ids.update(zip(map(str.encode, words), (raw[x:y] for x, y in zip(at, at[1:], strict=False)), strict=True))
        else:
            self.ids.update((w.encode(), self.alone(w)) for w in words)


HELD["chunks"] = Chunks._known.clear


def _lowered(raw: bytes) -> bytes:
    """UTF-8 with A-Z lowered, where a tokenizer that composes and lowers can't tell the difference."""
    low, text = raw.lower(), lambda x: x.decode("utf-8", "surrogatepass")
    if b"<|" in raw or not (low.isascii() or (is_normalized("NFC", text(low)) and is_normalized("NFC", text(raw)))):
        return raw
    return low


def splits(tokenizer: str) -> bool:
    """Whether the tokenizer drops white space before anything else and never joins across it, read from its file and tried.

    Its first step must split at white space, or keep only what a pattern matches
    that can match none; its normalizer may only compose, lower and rewrite white
    space; no added token may hold or strip white space.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        told = json.load(f)
    steps = lambda part: [] if part is None else [x for y in part.get("normalizers", part.get("pretokenizers", [])) for x in steps(y)] if part["type"] == "Sequence" else [part]
    first = steps(told.get("pre_tokenizer"))[:1]
    plain = all(x["type"] in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for x in steps(told.get("normalizer")))
    added = any(x["lstrip"] or x["rstrip"] or x["content"] != "".join(x["content"].split()) for x in told.get("added_tokens", []))
    if not first or not plain or added:
        return False
    if first[0]["type"] == "Split":
        # beside negated classes that rule white space out, nothing in the pattern may match it
        rest = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", first[0]["pattern"].get("Regex", "."))
        if first[0]["behavior"] != "Removed" or not first[0]["invert"] or re.search(r"\.|\s|\\[sSWDPnrtvf]|\[\^", rest):
            return False
    elif first[0]["type"] not in ("WhitespaceSplit", "BertPreTokenizer", "Whitespace"):
        return False
    library = Tokenizer.from_file(tokenizer)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    parts = ["the", "Zebra's", "1,234.5", "naïve", "###", "a_b", "x", "…", "中文", "😀", "<s>"]
    return all(ids(gap.join(parts)) == [i for p in parts for i in ids(p)] for gap in (" ", "\n", "\t", "\r", "\v", "\f", "  \n ")) and ids(" \n\t ") == []


def _encode_whole(path: str, end_id: int, kind: str):
    """Whole texts by the library, for a tokenizer whose texts may not be split."""

    def run(batches):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                got = library.encode_batch([t or "" for t in batch.column(1)[i:j].to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([np.array([*e.ids, end_id], kind).tobytes() for e in got], pa.binary())], names=["doc_id", "ids"])

    return released(run)


_MARK, _LETTER = (np.isin(np.arange(256), [*x]) for x in (Chunks._MARKS.encode(), b"abcdefghijklmnopqrstuvwxyz"))


def _marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the ASCII marks after the letter that ends a word begin; a word's end if there are none, or more than eight."""
    cut = ends.copy()
    at = np.flatnonzero(_MARK[data[ends - 1]])
    for _ in range(8):
        cut[at] -= 1
        at = at[cut[at] > starts[at]]
        at = at[_MARK[data[cut[at] - 1]]]
    return np.where((cut > starts) & _LETTER[data[cut - 1]], cut, ends)


def _encode(path: str, end_id: int, kind: str, lowers: bool):
    """Chunks between ASCII white space one by one, for a tokenizer that ``splits``."""

    def run(batches):
        chunks = Chunks.of(path, kind)
        end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                if lowers:
                    raw, at = data.tobytes(), offsets.tolist()
                    data = np.frombuffer(b"".join([_lowered(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]), np.uint8)
                starts, ends, of_text = words(data, offsets)
                # what is between gaps, end to end: each distinct chunk is looked up once
                stop = np.cumsum(ends - starts)
                if chunks.parts:
                    cut = _marks(data, starts, ends)
                    parted = cut < ends
                    of_text = of_text + np.append(0, np.cumsum(parted))[of_text]
                    stop = np.sort(np.concatenate([stop, (stop - ends + cut)[parted]]), kind="stable")
                held = [np.append(0, stop).astype(np.int32), data[~_GAP[data]]]
                coded = pa.StringArray.from_buffers(len(stop), *map(pa.py_buffer, held)).dictionary_encode()
                _, at, raw = coded.dictionary.buffers()
                raw, at = raw.to_pybytes() if raw else b"", np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1].tolist() if at else [0]
                found = [*chunks.found([raw[x:y] for x, y in zip(at, at[1:], strict=False)]), end]
                of = np.insert(coded.indices.to_numpy(), of_text[1:], len(found) - 1)
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
                n = sizes[of]
                stop = np.cumsum(n)
                ids = np.frombuffer(b"".join(found), kind)[np.repeat((np.cumsum(sizes) - sizes)[of] - stop + n, n) + np.arange(stop[-1])]
                bounds = np.append(0, stop[of_text[1:] + np.arange(j - i)] * width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])], names=["doc_id", "ids"])

    return released(run, "chunks")


def _flat(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw, width = column.to_pylist(), np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind), np.array([len(x) // width for x in raw], np.int64)


def _count(kind: str):
    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            got = np.bincount(_flat(batch.column(0), kind)[0])
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return released(run)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that never occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < len(leaves))
    take, got = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        got[:n] += 1
        take = 2 * (take - n)
    lengths[order] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Each id's code, by length and then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for i in order:
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every window of ``width`` bits: the id whose code begins it, and that code's length."""
    width = max(1, int(lengths.max(initial=1)))
    codes = canonical(lengths)
    ids, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    reach = (1 << (width - lengths[order].astype(np.int64))).astype(np.int64)
    filled = int(reach.sum())
    ids[:filled], sizes[:filled] = np.repeat(order, reach), np.repeat(lengths[order], reach)
    assert not len(order) or int(codes[order[0]]) == 0
    return ids, sizes, width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """The coded bits (most significant first), how many, and the offsets of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    total = int(end[-1]) if len(end) else 0
    wide = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word, n = at >> 5, (total >> 5) + 2
    # the bits of different ids are disjoint, so sums of doubles below 2**32 are exact
    out = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], total, at[::STEP].astype("<u4")


def unpack(bits: bytes, checkpoints: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    ids, sizes, width = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((len(at), STEP), np.uint32)
    for step in range(STEP):
        live = len(at) if step < (n_ids - 1) % STEP + 1 else len(at) - 1
        p = at[:live]
        found = (window[p >> 3] >> (32 - width - (p & 7)).astype(np.uint32)) & np.uint32((1 << width) - 1)
        out[:live, step] = ids[found]
        at[:live] += sizes[found]
    return out.ravel()[:n_ids]


def _blocks(lengths: np.ndarray, kind: str):
    def run(batches):
        width = np.dtype(kind).itemsize
        codes = canonical(lengths)
        context = TaskContext.get()
        part, block, offset = context.partitionId() if context else 0, 0, 0
        docs, counts, held, n = [], [], [], 0

        def flush():
            nonlocal block, offset, docs, counts, held, n
            ids = np.frombuffer(b"".join(held), kind)
            bits, n_bits, marks = pack(ids, codes, lengths)
            # null ids are told by their place: they sort first and are marked by a smallest long
            row = [part, block, offset, np.array(docs, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), len(ids), n_bits, bits, marks.tobytes()]
            block, offset = block + 1, offset + len(ids)
            docs, counts, held, n = [], [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

        names = [x.split()[0] for x in BLOCK.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in BLOCK.split(", ")])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and n + len(ids) // width > BLOCK_IDS:
                    yield flush()
                docs.append(NO_ID if doc is None else doc)
                counts.append(len(ids) // width)
                held.append(ids)
                n += counts[-1]
        if n:
            yield flush()

    return released(run)


#: Stands for a null document id in a block.
NO_ID = -(1 << 63)


def _decoded(lengths: np.ndarray, with_ids: bool):
    def run(batches):
        table = decoding_table(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["bits"], np.frombuffer(r["checkpoints"], "<u4"), r["n_ids"], table).astype("<u4")
                docs, counts = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["counts"], "<u4").astype(np.int64)
                end = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                cols = [
                    pa.array([None if d == NO_ID else int(d) for d in docs], pa.int64()),
                    pa.array(np.full(len(docs), r["part"], np.int32)),
                    pa.array(r["part_offset"] + end - counts),
                    pa.array(counts),
                    pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(end.tolist(), counts.tolist(), strict=True)], pa.int64()),
                ]
                names = ["doc_id", "part", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return released(run)


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """``docs`` as token ids, each text with ``end_id`` after it, under ``path``: blocks and the code's lengths."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = id_type(tokenizer)
    if end_id >= 1 << (8 * np.dtype(kind).itemsize):
        kind = "<u4"
    encode = _encode(tokenizer, end_id, kind, lowers(tokenizer)) if splits(tokenizer) else _encode_whole(tokenizer, end_id, kind)
    staged = cut(texts.mapInArrow(encode, "doc_id long, ids binary"), "ids")
    # at most a row for each id of the vocabulary comes to the driver
    counted = staged.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in counted), default=0), np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(lengths[i]), int(counts[i])) for i in np.flatnonzero(lengths)], "id long, bits int, n long").coalesce(1).write.parquet(f"{path}/code")
    # rows of one id, null included, may be many: among them the hash of the ids decides
    place = F.xxhash64("ids")
    ordered = staged.repartitionByRange("doc_id", place).sortWithinPartitions("doc_id", place, "ids")
    ordered.mapInArrow(_blocks(lengths, kind), BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    free(staged)


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document of a token file, from its blocks."""
    code = spark.read.schema("id long, bits int, n long").parquet(f"{path}/code").collect()
    lengths = np.zeros(1 + max((r["id"] for r in code), default=0), np.uint8)
    for r in code:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # a row for each file part: the ids of all parts before it
    sums = [(r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()]
    before = np.concatenate([[0], np.cumsum([n for _, n in sums])]).astype(int).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, before, strict=False)], "part int, before long")
    rows = bounded(blocks).mapInArrow(_decoded(lengths, with_ids), "doc_id long, part int, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op4_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "token_file")
    write_token_file(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_file(spark, path)
