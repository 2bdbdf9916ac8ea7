import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.curve import hilbert_key
from sparkloom.llm.packing import WordIds, pack, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids():
    texts = ["Don't stop… 4.0 a1 ÀÉ ß<|endoftext|>x \x1c y z Ω.x .\"' 's it's", "", "  lead", "é Σς 日本語 ﬁ ²³ µ", "éà THE the,THE"]
    words, plain = WordIds(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # also from the table
        ids, sizes = words(pa.array(texts))
        at = 0
        for text, n in zip(texts, sizes, strict=True):
            assert ids[at : at + n].tolist() == plain.encode(text, add_special_tokens=False).ids
            at += n


def test_tokenizer_without_word_ends_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, plain, texts = WordIds(path), Tokenizer.from_file(path), ["Two  words, and\n\nmore.", "", " é日本 "]
    ids, sizes = words(pa.array(texts))
    assert not words.by_word and WordIds(PATH).by_word
    assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids] and sizes.sum() == len(ids)


def test_hilbert_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(hilbert_key(cells, 3))
    assert len(set(hilbert_key(cells, 3))) == 512
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("total", [0, 1, 7, 8, 100])
def test_pieces_fill_sequences(total):
    got = list(pieces(0, total, total, 8))
    assert sum(n for _, _, n in got) == total
    sizes = defaultdict(int)
    for number, offset, n in got:
        assert offset == sizes[number]
        sizes[number] += n
    assert all(n & (n - 1) == 0 for n in sizes.values())


def test_round_trip(docs, rows):
    plain = Tokenizer.from_file(PATH)
    got = pack(docs, PATH, length=64, with_ids=True).collect()
    streams, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        streams[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = defaultdict(list)
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [1]
        wanted[r[0], len(ids)].append(ids)
    assert set(streams) == set(wanted)
    for key, texts in wanted.items():
        if len(texts) == 1:
            assert [i for _, ids in sorted(streams[key]) for i in ids] == texts[0]
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_no_rows(none):
    assert pack(none, PATH).count() == 0
