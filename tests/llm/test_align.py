"""Token alignment against whole texts encoded at once and every pair of tokens compared."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyforge.llm import align, registry

SCHEMA = "doc_id long, text string, row long, pairs string"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text):
    """(id, bytes) of both tokenizers, or nothing."""
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    x = [(i, bytes(align.byte_of()[c] for c in A.id_to_token(i))) for i in a]
    y = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := B.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in b]
    whole = (" " + text).encode()
    return (x, y) if text and b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def spans(ts):
    out, at = [], 0
    for i, t in ts:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(texts):
    links, out = [], []
    for text in texts:
        x, y = map(spans, tokens(text or ""))
        links.append([(i, j) for i, s, e in x for j, u, v in y if max(s, u) < min(e, v)])
        ends = sorted({e for _, _, e in x} & {v for _, _, v in y})
        groups = [("".join(f"{i}," for i, s, e in x if a <= s < b)[:-1], "".join(f"{i}," for i, s, e in y if a <= s < b)[:-1]) for a, b in zip([0, *ends], ends)]
        out.append([len(x), len(y), len(groups), len(links[-1]), hashlib.sha256(";".join(f"{a}|{b}" for a, b in groups).encode()).hexdigest() if x else ""])
    count = Counter(p for own in links for p in own)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(*o[:4], sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), o[4]) for o, own in zip(out, links)]


def texts():
    rng = random.Random(4)
    words = [a + b for a in "ka Lo mi né ru sa über".split() for b in "ta po li du en or 😀 it's 12.5 O'Neil (x)".split()]
    gaps = [" "] * 12 + ["\n", "  ", " \n", "\t ", " ", "　", "  ", "\x1c ", ""]
    out = ["".join(w + rng.choice(gaps) for w in rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)]
    return out + [None, "", " ", "  ", "\n", " a", "a ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ mark", "a▁b", "\u0000 x", "é", "é ﬁ ½", "日本語 のテキスト", "don't 's 'll", "x" * 500, "same same " * 60, "same same " * 60, "ａ fullwidth", "﻿bom", "a​b c‍ d"]


@pytest.mark.parametrize("hot", [0, 40, 1 << 19])
def test_alignment(spark, hot):
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = align.align(docs, hot=hot).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *x)) for r, x in zip(rows, brute([r[1] for r in rows])))


def test_units_spell_what_the_whole_text_spells():
    """Tokens by unit are those of the text encoded at once, and long texts are summed in parts."""
    known = align.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    whole, small = align.aligned(known, texts()), align.aligned(known, texts(), held=5)
    for t, one, parts in zip(texts(), whole, small, strict=True):
        x, y = tokens(t or "")
        assert one[:2] == (len(x), len(y)) and one[:5] == parts[:5]
        assert one[5].tolist() == parts[5].tolist() and one[6].tolist() == parts[6].tolist() and one[6].sum() == one[3]


def test_query_reads_the_table(spark, tmp_path):
    spark.createDataFrame([(1, "one two", 1, ""), (2, None, 1, "")], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.QUERIES["op12_align"](spark, str(tmp_path)).collect()}
    assert got[1].n_a == 2 and got[1].n_groups == 2 and tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "")


def test_ranks_are_the_vocabularys_merges():
    known = align.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for t in texts():
        assert known.ranked(f" {t or ''}") == A.encode(f" {t or ''}", add_special_tokens=False).ids
