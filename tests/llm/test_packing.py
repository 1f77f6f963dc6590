import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from txloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expand(counts, capacity):
    """Every piece's place, checking that ranks are covered exactly once."""
    places = []
    seen = defaultdict(set)
    for length, lo, n, first, at, each in packing.plan_best_fit(counts, capacity):
        for k in range(n):
            assert lo + k not in seen[length]
            seen[length].add(lo + k)
            places.append((first + k // each, at + k % each * length, length))
    assert {k: len(v) for k, v in seen.items()} == {k: v for k, v in counts.items() if v}
    return places


def best_fit_bins(counts, capacity):
    room = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [r for r in room if r >= length]
        if fits:
            room[room.index(min(fits))] -= length
        else:
            room.append(capacity - length)
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_gapless_and_matches_best_fit_decreasing(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 50): r.randint(0, 30) for _ in range(20)}
    places = expand(counts, 50)
    bins = defaultdict(list)
    for s, at, length in places:
        bins[s].append((at, length))
    for parts in bins.values():
        parts.sort()
        end = 0
        for at, length in parts:
            assert at == end
            end += length
        assert end <= 50
    assert len(bins) == best_fit_bins(counts, 50)


def test_word_table_gives_the_tokenizers_ids(messy):
    whole, table = Tokenizer.from_file(PATH), packing.WordIds(PATH, limit=10)
    for text in [r.text or "" for r in messy.collect()] + ["It's  'S x's 'll\x0b\x0c1234 é ́x ſtraße İI", "a\x1cb \x85c", "''s'", "ΑΣ ΑΣΑ"]:
        want = b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
        assert table.encode(text) == want


def test_documents_are_packed_whole(messy, nothing):
    whole = Tokenizer.from_file(PATH)
    got = packing.pack_documents(messy, capacity=64).collect()
    want = Counter()
    for r in messy.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[r.doc_id, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert packing.pack_documents(nothing).count() == 0


def test_long_words_are_not_kept():
    import public_tokenizers

    table = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), limit=3)
    text = "ab " + "x" * 500 + " 漢字" * 3 + " " + "漢" * 400 + " cd ef gh ab"
    want = table.tokenizer.encode(text, add_special_tokens=False).ids
    assert table.encode(text) == b"".join(i.to_bytes(4, "little") for i in want)
    assert len(table) <= 4 and max(map(len, table)) < packing.CACHE_BYTES


def test_frequent_words_stay_and_case_and_punctuation_are_one_word():
    whole, table = Tokenizer.from_file(PATH), packing.WordIds(PATH, limit=20)
    found, merges = [], table.merge
    table.merge = lambda word: (found.append(word), merges(word))[1]
    text = " ".join(f"river River, RIVER. r\u00edo R\u00cdO! rare{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))
    got = table.encode(text)
    assert got == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
    assert found.count("river") == 1 and len(found) == 202 and len(table) <= 20 and len(table.older) <= 20
    for text in ['He said: "End". x.\u0308 a.b,c (d). \'s. 1. \u00aa. \u00b5! \u00df? \u00ff; A\u0301. H\u0331, T\u0308! W\u030a y\u00d7. \u4e2d. \u0130. X\x85Y. \xa0Z.', "NA\u00cfVE... (\u00c9T\u00c9)!! a''s. d'. l'\u00c9, \u00d7. \u00f7."]:
        assert table.encode(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
