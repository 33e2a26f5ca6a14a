import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matrel.llm import bpe, packing
from matrel.llm.tokens import ByteLevelEncoder

from .helpers import SMALL, awkward, awkward_rows, nothing

ODD = [chr(x) for x in [*range(0x180), 0x2028, 0x3000, 0x200B, 0x301, 0x1F600, 0x660, 0x4E2D, 0xAC00, 0x2160, 0xFEFF, 0x3A3, 0x130, 0x1C5]] + [
    "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "\n\n", "aaa", "....", "!!!!"]


def odd_texts(count):
    rng = random.Random(1)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(count)] + [
        "".join(rng.choices("aahnotie.-", k=rng.randint(0, 40))) for _ in range(count)]


def test_byte_level_ids_match_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), ByteLevelEncoder(path)
    for text in odd_texts(3000):
        assert own.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_automaton_matches_the_library():
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.WordTokenizer(bpe.default_path())
    for text in odd_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.rendered(text) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), text


def test_every_table_entry_is_asked_for_once_in_a_word():
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.WordTokenizer(bpe.default_path())
    for word in ("ab" * 4000, "a" * 9000, "nationalisation" * 500, "zqxj" * 900, "thethathenthe" * 300):
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids
    automaton, asked = own.automaton, []

    class Table(dict):
        def __getitem__(self, key):
            asked.append(key)
            return automaton._open(key >> automaton.bits, key & (1 << automaton.bits) - 1)

    automaton.arcs = Table()
    word = "q" * 500                                     # no long labels: a few entries for each position
    automaton.path(word + "\n")
    assert len(asked) <= 500 * max(map(len, automaton.spelled))


def merged(word, merges):
    """Textbook merging: the lowest rank first, leftmost first."""
    parts, ranks = list(word), {m: i for i, m in enumerate(merges)}
    while len(parts) > 1:
        rank, at = min((ranks.get((a, b), 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 10**9:
            break
        parts[at:at + 2] = ["".join(parts[at:at + 2])]
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_automaton_of_random_merges(seed):
    rng = random.Random(seed)
    known, merges = list("ab"), []
    while len(merges) < 14:
        pair = (rng.choice(known), rng.choice(known))
        if pair not in merges and "".join(pair) not in known:
            merges.append(pair)
            known.append("".join(pair))
    vocab = {t: i for i, t in enumerate(known)}
    automaton = bpe.MergeAutomaton(vocab, merges)
    labels = {i: t for t, i in vocab.items()}
    for _ in range(400):
        word = "".join(rng.choices("ab", k=rng.randint(1, 24)))
        assert [labels[i] for i in automaton.path(word)] == merged(word, merges), (word, merges)


def test_round_trip_of_awkward_rows(spark):
    library = Tokenizer.from_file(bpe.default_path())
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.round_trip(awkward(spark)).collect()}
    for doc_id, text, *_ in awkward_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = got[(doc_id, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())]
        assert row["n_tokens"] == len(ids)
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(nothing(spark)).count() == 0
    encoded = bpe.encode_documents(awkward(spark))
    texts = {r["text"] for r in bpe.decode_documents(encoded).collect()}
    assert "" in texts and "one</w> two</w>" in texts


def check_packing(rows, docs, capacity, path):
    library, by_doc, sequences = Tokenizer.from_file(path), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for doc_id, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        at = 0
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // capacity)
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def test_packing_of_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    used, least = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048, path)
    assert used <= least + 2
    few = packing.pack_documents(docs, group_rows=25).collect()        # many groups
    check_packing(few, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048, path)


def test_packing_of_awkward_rows(spark):
    rows = [r for r in awkward_rows() if r[0] is not None and r[0] != 10]
    docs = awkward(spark).filter("doc_id <> 10")
    packed = packing.pack_documents(docs, capacity=64, keep_ids=True)
    check_packing(packed.collect(), [r[:2] for r in rows], 64, public_tokenizers.path("byte_bpe_50k.json"))
    joined = packing.sequences(packed).select("n_tokens", (F.length("ids") / 4).cast("long").alias("n")).collect()
    assert all(r["n"] == r["n_tokens"] <= 64 for r in joined)
    assert packing.pack_documents(awkward(spark)).count() == len({(i, j) for j, i in enumerate(awkward_rows())}) + sum(
        n - 1 for n in [-(-len(ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json")).ids(r[1] or "") + b"0000") // 8192) for r in awkward_rows()])
    assert packing.pack_documents(nothing(spark)).count() == 0


def test_sum_of_squares_places_by_the_smallest_sum():
    rng = random.Random(4)
    packer, gaps = packing.SumOfSquares(50), {}
    for _ in range(600):
        size = rng.randint(1, 50)
        bin_, offset = packer.place(size)
        fits = {g for b, g in gaps.items() if g >= size}
        if bin_ in gaps:
            before = gaps[bin_]
            assert offset == 50 - before and before >= size
            counts = lambda: np.bincount([g for g in gaps.values() if g], minlength=51)
            sums = {}
            for g in fits:
                c = counts()
                c[g] -= 1
                c[g - size] += g > size
                sums[g] = int((c[1:] ** 2).sum())
            assert sums[before] == min(sums.values())
            gaps[bin_] = before - size
        else:
            assert not fits and offset == 0
            gaps[bin_] = 50 - size
        gaps = {b: g for b, g in gaps.items() if g}


def test_packed_ids_are_exact_beside_nulls(spark):
    docs = spark.createDataFrame([(9007199254740993, "a b"), (None, "c"), (7, "d")], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack_documents(docs).collect()} == {9007199254740993, None, 7}
