"""Token files and packing against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import fixtures
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ruleloom.llm import queries
from ruleloom.llm.packing import best_fit_pack, fullest, packed_sequences, patterns
from ruleloom.llm.token_file import SequenceFile, check_token_files, read_token_files, write_token_files
from ruleloom.llm.tokens import Encoder

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENCODERS = {path: (Encoder(path), Tokenizer.from_file(path)) for path in (BYTES, WORDS)}
ALPHABET = "aZéß ñ'’\n\t  .,!?-_#1²½٣中́İŒ<|> \x1c"


def ids_of(path, text):
    return ENCODERS[path][1].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=20))
def test_encoder_equals_the_tokenizer(path, text):
    got = np.frombuffer(ENCODERS[path][0].encode([text])[0], "<u4").tolist()
    assert got == ids_of(path, text)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_with_special_tokens_and_contractions(path):
    for text in ["a <|endoftext|> b", "x \n <|endoftext|>y", "don't we'LL I'm 'sno 's", "word''s,'t  two   three \n\n four", "end   ", "\n\n"]:
        assert np.frombuffer(ENCODERS[path][0].encode([text])[0], "<u4").tolist() == ids_of(path, text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_return_all_ids(spark, folder):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    want, start = [], 0
    for key, text in docs:
        ids = [*ids_of(WORDS, text), 2]
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    got = queries.QUERIES["op2_token_file"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_token_files_of_awkward_rows(spark):
    manifest = write_token_files(fixtures.documents(spark), WORDS, 2, sequence=64)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(manifest).collect())
    rows = sorted(((k is not None, k or 0), t or "") for k, t, _ in fixtures.ROWS)
    at = 0
    for (key, start, n, ids), (want_key, text) in zip(got, rows, strict=True):
        assert (key, start, ids) == (want_key, at, [*ids_of(WORDS, text), 2]) and n == len(ids)
        at += n
    assert check_token_files(write_token_files(fixtures.documents(spark, []), WORDS, 2)).count() == 0


def test_sequences_have_one_length_and_masks_cover_the_padding(spark):
    manifest = write_token_files(fixtures.documents(spark), WORDS, 2, sequence=64).collect()
    for row in manifest:
        file = SequenceFile(row.ids_file)
        count = -(-row.n_tokens // 64)
        for k in range(count):
            assert len(file.sequence(k)) == len(file.mask(k)) == 64
            assert not file.sequence(k).flags["OWNDATA"]
            assert file.mask(k).sum() == min(64, row.n_tokens - 64 * k)


def test_fullest_is_optimal():
    dice = random.Random(4)
    for _ in range(60):
        counts = {dice.randint(1, 40): dice.randint(1, 3) for _ in range(6)}
        room = dice.randint(0, 100)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        taken = fullest(counts, room)
        assert sum(taken) == max(sums) and all(taken.count(x) <= counts[x] for x in taken)


def test_patterns_use_every_piece_once():
    dice = random.Random(8)
    counts = {dice.randint(1, 2048): dice.randint(1, 12) for _ in range(80)}
    used, bins = defaultdict(int), 0
    for filling, times in patterns(counts):
        assert sum(filling) <= 2048
        bins += times
        for x in filling:
            used[x] += times
    assert used == counts
    rooms = []  # first fit of the longest first
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= length), None)
        if k is None:
            rooms.append(2048 - length)
        else:
            rooms[k] -= length
    assert bins <= 1.01 * len(rooms) + 1


def check_packing(rows, docs, capacity):
    ids = defaultdict(list)
    for key, text in docs:
        ids[key].append([*ids_of(BYTES, text), 0])
    places, got = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for key, several in ids.items():
        for own in several:
            first = (len(own) - 1) % capacity + 1
            cuts = [0, *range(first, len(own) + 1, capacity)]
            want[key] += [(n, a, b - a, crc(own[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return len(places), sum(len(x) for v in ids.values() for x in v)


def test_packing_of_the_documents(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    bins, total = check_packing(queries.QUERIES["op3_best_fit_packing"](spark, folder).collect(), docs, 2048)
    assert bins <= -(-total // 2048) * 1.02 + 1


def test_packing_of_awkward_rows(spark):
    pieces = best_fit_pack(fixtures.documents(spark), BYTES, with_ids=True, capacity=32).cache()
    check_packing(pieces.collect(), [(k, t or "") for k, t, _ in fixtures.ROWS], 32)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packed_sequences(pieces).collect()}
    for r in pieces.collect():
        assert crc(whole[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32
    assert best_fit_pack(fixtures.documents(spark, []), BYTES).count() == 0
