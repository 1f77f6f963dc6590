import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from txloom.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
A.encode_special_tokens = True
LETTERS = alignment.byte_letters()


def tokens(text):
    """(id, first byte, end) of both sides, or nothing."""
    if not text:
        return [], []
    sides = []
    for ids, spell in (
        (A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(LETTERS[c] for c in A.id_to_token(i))),
        (B.encode(text), lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := B.id_to_piece(i)) else p.replace("▁", " ").encode()),
    ):
        at, side, whole = 0, [], b""
        for i in ids:
            s = spell(i)
            side.append((i, at, at + len(s)))
            at, whole = at + len(s), whole + s
        if whole != (" " + text).encode():
            return [], []
        sides.append(side)
    return sides


def plain(rows):
    """All columns by comparing every A token with every B token."""
    found, count = [], collections.Counter()
    for doc_id, text in rows:
        a, b = tokens(text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        count.update(links)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [(",".join(str(i) for i, s, e in a if lo <= s and e <= hi), ",".join(str(i) for i, s, e in b if lo <= s and e <= hi)) for lo, hi in zip([0, *ends], ends)]
        found.append((doc_id, len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return sorted(
        (
            (d, na, nb, len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(map("|".join, g)).encode()).hexdigest() if na else "")
            for d, na, nb, g, k in found
        ),
        key=str,
    )


def ours(df):
    return sorted(map(tuple, alignment.align(df).collect()), key=str)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "x\n\n y \t z", "▁", "a ▁b", "<|endoftext|> a<|endoftext|>", "<s> </s> <unk> <0x41>", "naïve café ﬁ ½", "日本語 テキスト 🎉🎉",
    "x　y  z", "a\x00b \x1c c", "don't we'll I'M", "é ́x", "zażółć gęślą jaźń", "0123456789 1,000.50", "a" * 500, "ab " * 300, "?!... --- ***", "﻿bom ​zero", "\x85a b c",
]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_units_give_the_tokens_of_whole_texts():
    r, units = random.Random(3), alignment.Units(*PATHS)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "ß", ".", ",", "'s", "1", "\t", " ", "Q", "ing", "日", "　", "-", "<", "\x1d", " ", "🎉"]
    for _ in range(300):
        texts = ["".join(r.choices(alphabet, k=r.randint(1, 25))) for _ in range(10)]
        whole = [tokens(t) for t in texts]
        for group in (texts, [t for t in texts for _ in "ab"]):  # learnt together, then looked up
            parts = [units.numbers(alignment._BETWEEN.split(t)) for t in group]
            places = np.frombuffer(units.places, np.int64).reshape(-1, 4)
            mine = [[[i for u in p.tolist() for i in side[places[u, k] : places[u, k + 1]]] for side, k in ((units.ids_a, 0), (units.ids_b, 2))] for p in parts]
            del places
            assert mine == [[[i for i, *_ in side] for side in whole[texts.index(t)]] for t in group]


def test_messy_documents(spark, messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect() if len(r["text"] or "") < 10_000]
    assert ours(messy.filter("length(text) < 10000 OR text IS NULL").repartition(3)) == plain(rows)


def test_blocks_and_tables_start_anew(monkeypatch):
    """Small blocks and a small table give what one block gives."""
    r = random.Random(5)
    texts = [" ".join(r.choices("alpha beta gammaray delta x".split(), k=30)) + " " + "w" * 70 for _ in range(20)]
    rows, whole = list(range(7, 27)), alignment.Units(*PATHS)

    def gathered(made):
        got = collections.Counter()
        for _, _, block in made:
            keys, pairs, sizes, doc, links = alignment.unpack(block)
            for p, d, n in zip(np.repeat(pairs.cumsum(), sizes).tolist(), keys.cumsum()[doc].tolist(), links.tolist()):
                got[p, d] += n
        return got

    docs, blocks = alignment.aligned(whole, rows, rows, texts)
    monkeypatch.setattr(alignment, "KEPT_UNITS", 3)
    small, parts, more = alignment.Units(*PATHS), [], []
    for k in range(0, 20, 3):
        d, b = alignment.aligned(small, rows[k : k + 3], rows[k : k + 3], texts[k : k + 3])
        parts += d
        more += b
    assert parts == docs and gathered(more) == gathered(blocks)


def test_chunks_keep_long_texts_whole(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 10)
    assert list(alignment._chunks(["a" * 4, None, "b" * 6, "c" * 50, "d"])) == [slice(0, 3), slice(3, 4), slice(4, 5)]


def test_sums_are_exact():
    doc, values = np.array([0, 1, 0]), np.array([(1 << 51) + 1, 3, 2])
    assert alignment._exact_sums(doc, values, 2).tolist() == [(1 << 51) + 3, 3]


@pytest.mark.parametrize("columns", [[], [0], [255], [256, 1], [1 << 31], [1 << 40]])
def test_pack(columns):
    assert [c.tolist() for c in alignment.unpack(alignment.pack(np.array(columns, np.int64), np.array([7])))] == [columns, [7]]


def test_nothing(nothing):
    assert alignment.align(nothing).collect() == []
