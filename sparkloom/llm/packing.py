"""Packing documents into token sequences along a space-filling curve.

Each document's tokens are hashed into a vector, the vector is projected to few dimensions, and documents are sorted
by range on the Hilbert key of that point. All tokens in this order are one long stream, cut every `length` tokens: the
sum of the ranges before gives every range its place in the stream, so no range has to pad. The last, shorter
sequence is cut into powers of two, which need no padding either.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..steps import spread
from .common import Written, shuffle_partitions, table
from .curve import hilbert_key

LENGTH = 2048
DIMS, BITS, BUCKETS = 4, 10, 256
#: Characters whose words a task looks up at once.
CHARS_AT_ONCE = 3_000_000
#: Parts of words whose ids a worker remembers; beyond, it starts anew.
KNOWN_PARTS = 600_000
#: Words of letters whose lower case and normal form are one letter each, then ASCII marks that start no contraction.
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]*[!-&(-/:-@\[-`{-~]*$"
_PARTS = r"^(?P<letters>[a-zß-öø-ÿ]*)(?P<marks>[^a-zß-öø-ÿ]*)$"


class WordIds:
    """Token ids of whole texts from the ids of their words.

    Where no token crosses ASCII white space, the ids of a text are those of its words, and each distinct word is encoded
    once. Plain words are letters and marks, which never share a token; such parts are encoded many at a time, since each
    part ends with a token that ends a word. The tokenizer encodes other words one by one. Any other tokenizer (by_word is
    false: no word ends, or a probe comes out otherwise) encodes whole texts.
    """

    #: Letters, marks, digits, contractions, other scripts and white space next to one another.
    PROBE = "Don't stop (now),  4.0 a1!\tHe'll  say: \"ÀÉ\" éà THE the,THE\n日本語 Σς … x.y, end."

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for k, i in names.items() if k.endswith("</w>")]] = True
        self.by_word = self.ends.any() and self.one_by_one(self.PROBE.split())[0].tolist() == self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.stock, self.sizes, self.starts = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        return np.array([i for ids in each for i in ids], "<u4"), np.array([len(ids) for ids in each], np.int64)

    def together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of parts that the tokenizer's own splitting leaves whole."""
        runs = [" ".join(parts[i : i + 256]) for i in range(0, len(parts), 256)]
        got = [np.array(e.ids, "<u4") for i in range(0, len(runs), 64) for e in self.tokenizer.encode_batch_fast(runs[i : i + 64], add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.empty(0, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(np.r_[0, stops])) if len(stops) == len(parts) else self.one_by_one(parts)

    def numbers(self, parts: list[str], how) -> np.ndarray:
        """Where the table has each part; unknown ones are encoded and put there."""
        if new := [p for p in parts if p not in self.number]:
            ids, sizes = how(new)
            for n, p in enumerate(new, len(self.number)):
                self.number[p] = n
            self.stock, self.sizes = np.concatenate([self.stock, ids]), np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not self.by_word:
            return self.one_by_one(texts.to_pylist())
        if len(self.number) > KNOWN_PARTS:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        own = split.flatten().dictionary_encode()
        words = own.dictionary
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        is_plain = plain.to_numpy(zero_copy_only=False)
        parts = pc.extract_regex(pc.utf8_lower(words.filter(plain)), _PARTS)
        # two parts for each distinct word: letters and marks, or the word and nothing
        pair = np.zeros((len(words), 2), np.int64)
        for i in (0, 1):
            part = parts.field(i).dictionary_encode()
            pair[is_plain, i] = self.numbers(part.dictionary.to_pylist(), self.together)[part.indices.to_numpy(zero_copy_only=False)]
        pair[~is_plain, 0] = self.numbers(words.filter(pc.invert(plain)).to_pylist(), self.one_by_one)
        stock, sizes = _gathered(self.stock, self.starts, self.sizes, pair.ravel())
        sizes = sizes.reshape(-1, 2).sum(1)
        ids, each = _gathered(stock, np.cumsum(sizes) - sizes, sizes, own.indices.to_numpy(zero_copy_only=False))
        edges = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))]
        return ids, np.diff(np.r_[0, np.cumsum(each)][edges])


def _gathered(stock: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `stock` that are wanted, one after another, and their sizes."""
    each = sizes[wanted]
    upto = np.cumsum(each)
    return stock[np.repeat(starts[wanted] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)], each


@cache
def word_ids(path: str) -> WordIds:
    """One table for all tasks of a Python worker."""
    return WordIds(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + CHARS_AT_ONCE, "right")))
        yield start, stop
        start = stop


def points(ids: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Hashed document vectors (log counts of token buckets, unit length), projected and cut into cells."""
    n = len(lengths)
    bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(40)).astype(np.int64) % BUCKETS
    counts = np.bincount(np.repeat(np.arange(n), lengths) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    vectors = np.log1p(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    projected = vectors @ np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
    cells = 1 / (1 + np.exp(-1.702 * projected))  # close to the normal distribution function
    return np.clip((cells * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, seed: int, width: int) -> DataFrame:
    """(id, curve, n, ids): little-endian unsigned numbers of 16 bits (32 for a large vocabulary), with end_id at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for x, y in _slices(texts):
                ids, lengths = words(texts.slice(x, y - x))
                cells = points(ids, lengths, seed)
                stops = np.cumsum(lengths)
                ended = np.insert(ids, stops, end_id).astype(f"<u{width}")
                edges = np.r_[0, stops + np.arange(1, len(stops) + 1)] * width
                binary = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(edges.astype("<i8")), pa.py_buffer(ended)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(hilbert_key(cells, BITS)), pa.array(lengths + 1), binary.cast(pa.binary())], names=["id", "curve", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, curve long, n long, ids binary")


def pieces(start: int, size: int, total: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(sequence, offset, size) of the pieces of `size` tokens from place `start` in a stream of `total`."""
    tail = total // length * length
    end = start + size
    while start < end:
        if start < tail:
            number, base, room = start // length, start // length * length, length
        else:
            number, base, rest = tail // length, tail, total - tail
            room = 1 << (rest.bit_length() - 1)
            while start >= base + room:
                base, rest, number = base + room, rest - room, number + 1
                room = 1 << (rest.bit_length() - 1)
        stop = min(end, base + room)
        yield number, start - base, stop - start
        start = stop


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 1, seed: int = 11, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    `with_ids` the piece's token ids.

    tokenizer: path of the tokenizer's file, the same on every machine. Null and empty texts have only end_id. Equal
    documents share a key and are neighbours; ties are ordered by identifier, then by the ids. length is a power of two.
    An empty table gives an empty table. Sequences but the last few hold exactly `length` tokens; those have sizes that
    are powers of two.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length is a power of two")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    width = 2 if max(len(word_ids(tokenizer).ends) - 1, end_id) < 1 << 16 else 4  # bytes of an id on the way
    tokens = Written(tokenised(docs, tokenizer, id_col, text_col, end_id, seed, width))
    ranges = shuffle_partitions(spark)
    dealt = tokens.df.withColumn("crc", F.crc32("ids")).repartitionByRange(ranges, "curve", F.col("id"), "crc").sortWithinPartitions("curve", "id", "crc")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            upto = before + np.cumsum(n)
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(upto - n), batch.column(1), batch.column(2)], names=["part", "id", "place", "n", "ids"])
                before = int(upto[-1])

    ordered = Written(dealt.select("id", "n", "ids").mapInArrow(placed, f"part int, id {kind}, place long, n long, ids binary"))
    tokens.drop()
    # one number for each range
    sums = {r["part"]: r["n"] for r in ordered.df.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    order = sorted(sums)
    bases = dict(zip(order, accumulate((sums[p] for p in order), initial=0), strict=False))
    total = sum(sums.values())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, parts, places, sizes, ids = ([], [], [], [], [], [], []), *(batch.column(i).to_pylist() for i in (0, 2, 3)), batch.column(4)
            for row, (part, place, size) in enumerate(zip(parts, places, sizes, strict=True)):
                own, done = np.frombuffer(ids[row].as_buffer(), f"<u{width}").astype("<u4"), 0
                for number, offset, taken in pieces(bases[part] + place, size, total, length):
                    piece = own[done : done + taken].tobytes()
                    for column, value in zip(of, (row, done, taken, zlib.crc32(piece), number, offset, piece if with_ids else None), strict=True):
                        column.append(value)
                    done += taken
            rows = pa.array(of[0], pa.int64())
            out = [batch.column(1).take(rows), *(pa.array(of[i], pa.int64()) for i in (1, 2, 3)), batch.column(3).take(rows), *(pa.array(of[i], pa.int64()) for i in (4, 5))]
            if with_ids:
                out.append(pa.array(of[6], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(out)])

    return ordered.df.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op4_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
