import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from sonalyt.llm import packing


def decreasing(lengths, room):
    """Bins of first-fit decreasing, to compare with."""
    bins = []
    for x in sorted(lengths, reverse=True):
        i = next((i for i, b in enumerate(bins) if b >= x), None)
        if i is None:
            bins.append(room - x)
        else:
            bins[i] -= x
    return len(bins)


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing._ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(0)
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "'", ".", ",", "12", "é", "ñ", "日本", " ", "　", "<|endoftext|>", "<|", "\x1c", "\x85", "🙂", "!?", "-", "don't"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) + r.choice(("", " ", " ")) for _ in range(r.randrange(12)))
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.of(text) == struct.pack(f"<{len(want)}I", *want), text


def test_packing(docs, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, 64).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 64 + 1
        stops = range(first, len(ids) + 1, 64)
        for k, (a, b) in enumerate(zip([0, *stops], stops)):
            want[(doc, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= decreasing([r.length for r in got], 64) + 1


def test_plan_places_each_rank_once_and_packs_tightly():
    r = random.Random(1)
    counts = {r.randrange(1, 200): r.randrange(1, 50) for _ in range(40)}
    bins = defaultdict(int)
    ranks = defaultdict(set)
    for length, lo, hi, times, first, _ in packing.plan(counts, 200):
        for rank in range(lo, hi):
            assert rank not in ranks[length]
            ranks[length].add(rank)
            bins[first + (rank - lo) // times] += length
    assert {k: len(v) for k, v in ranks.items()} == counts and max(bins.values()) <= 200
    assert len(bins) <= decreasing([k for k, v in counts.items() for _ in range(v)], 200) + 1


def test_fullest_is_the_best_sum():
    r = random.Random(2)
    for _ in range(50):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(1, 60)
        reach = {0}
        for x, c in counts.items():
            for _ in range(c):
                reach |= {s + x for s in reach if s + x <= room}
        taken = packing.fullest(room, counts)
        assert sum(taken) == max(reach) and all(taken.count(x) <= counts[x] for x in taken)


def test_empty(nothing):
    assert packing.pack(nothing).count() == 0
