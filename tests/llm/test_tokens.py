"""Encoding by pieces against whole-text encoding; packing and id files against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldtally.llm import packing, token_files
from fieldtally.llm.packing import plan
from fieldtally.llm.queries import QUERIES
from fieldtally.llm.tokens import Encoder
from tests.llm.fixtures import SF, awkward, empty, rows_of, texts_of

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def whole(path: str):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_join_to_the_whole_text(path):
    rng = random.Random(7)
    odd = ["", " ", "  a", "a  b", "a \n b", "it's we'll I'M", "ΣΑΣ", "İstanbul", "한글 각", "<|endoftext|> a", "x\x1c y"]
    signs = "ab'. \n\t0é́ΣKK🙂!*_ İ\x1c"
    odd += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    encoder, reference = Encoder(path), whole(path)
    encoder.first.bound = 500  # the cache is emptied on the way
    for text in odd:
        assert encoder.encode(text) == reference(text).tobytes(), repr(text)


@pytest.mark.parametrize("n", [0, 1, 3, 60, 900, 20_000])
@pytest.mark.parametrize("spread", [0.3, 1.0, 1.6])
def test_plan_places_every_piece_once(n, spread):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(6.5, spread, n).astype(int), 1, 4096)
    histogram = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    assignments, sequences = plan(histogram)
    fill, placed = np.zeros(sequences + 1, int), dict.fromkeys(histogram, 0)
    for length, low, high, _, _ in assignments:
        placed[length] += high - low
    for length, low, high, first, offset in sorted(assignments, key=lambda a: a[4]):
        assert (fill[first : first + high - low] == offset).all()  # no gap
        fill[first : first + high - low] += length
    assert placed == histogram and fill.max(initial=0) <= 4096
    assert sequences <= int(lengths.sum() / 4096 * 1.03) + 2


def check_packed(rows, docs):
    reference, seen, places = whole(WORD), {}, {}
    for doc_id, piece, start, length, crc, sequence, offset in rows:
        seen.setdefault(doc_id, []).append((start, piece, length, crc))
        places.setdefault(sequence, []).append((offset, length))
    expected = {}
    for doc_id, text in docs:
        ids = np.append(reference(text), 1).astype("<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.setdefault(doc_id, []).append((at, piece, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in expected.items()}
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    return len(places)


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows_of(QUERIES["op2_best_fit_packing"](spark, SF), *COLUMNS)
    used = check_packed(rows, texts_of(docs))
    assert used <= sum(r[3] for r in rows) / 4096 * 1.03 + 2


def test_packing_awkward(spark):
    docs = awkward(spark)
    packed = packing.pack(docs, WORD, 1, with_ids=True)
    check_packed([tuple(r[c] for c in COLUMNS) for r in packed.collect()], texts_of(docs))
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in packed.collect())
    assert packing.pack(empty(spark), WORD, 1).count() == 0


def check_files(rows, docs):
    reference, start = whole(BYTE), 0
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    expected = []
    for doc_id, text in order:
        ids = np.append(reference(text), 2).astype("<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows, key=lambda r: r[1]) == expected


def test_token_files_round_trip(spark):
    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_files([tuple(r) for r in QUERIES["op7_token_files"](spark, SF).select(*columns).collect()], texts_of(docs))
    docs = awkward(spark)
    check_files([tuple(r) for r in token_files.tokens_round_trip(docs, BYTE, 2).collect()], texts_of(docs))
    assert token_files.tokens_round_trip(empty(spark), BYTE, 2).count() == 0


def test_ids_must_fit_the_file_type(spark, tmp_path):
    with pytest.raises(Exception, match="cannot hold"):
        token_files.write_tokens(awkward(spark), str(tmp_path), BYTE, 2, dtype="uint8")
