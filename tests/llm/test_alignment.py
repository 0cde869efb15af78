"""Operator 13 against the libraries on whole texts and a plain walk over the tokens."""

import collections

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperweir.llm import alignment

DOCS = "doc_id long, text string"


def tokens(text, byte, piece, letters):
    a = byte.encode(" " + text, add_special_tokens=False).ids
    b = piece.encode(text)
    spelled_a = [bytes(letters[c] for c in byte.id_to_token(i)) for i in a]
    spelled_b = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, spelled_a, spelled_b


def groups_of(a, b, spelled_a, spelled_b):
    ends_a, ends_b, at = {}, {}, 0
    for k, s in enumerate(spelled_a):
        at += len(s)
        ends_a[at] = k + 1
    at = 0
    for k, s in enumerate(spelled_b):
        at += len(s)
        ends_b[at] = k + 1
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        out.append((a[i : ends_a[end]], b[j : ends_b[end]]))
        i, j = ends_a[end], ends_b[end]
    return out


def brute(rows):
    byte = Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    held, count = [], collections.Counter()
    for i, text in rows:
        found = None
        if text:
            a, b, sa, sb = tokens(text, byte, piece, letters)
            if b"".join(sa) == b"".join(sb) == (" " + text).encode():
                groups = groups_of(a, b, sa, sb)
                links = collections.Counter((x, y) for g, h in groups for x in g for y in h)
                count.update(links.keys())
                found = len(a), len(b), groups, links
        held.append((i, found))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, found in held:
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, n_a, n_b, len(groups), sum(links.values()), sum(n for k, n in links.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in links.items()), text))
    return collections.Counter(out)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "a"), (6, "a  b\n c"), (7, " lead and trail "), (8, "tab\tx  \n  y"), (9, "x▁y"), (10, "<|endoftext|> <s> </s> <unk> <0x41>"), (11, "emoji 😀😀 é é naïve \x00 \x1c z"),
    (12, "日本語 テキスト　全角 空白"), (13, "한국어 문장 입니다"), (14, "nbsp\xa0here \xa0 there  line"), (15, "   many   spaces    1  22 333"), (16, "it's we'll 'tis I'd"), (17, "x" * 3000), (18, "٣٤٥ 𝒳𝒴 ﬁ"), (19, "a\r\nb\r\n\r\n c"),
    (20, "the same text"), (20, "the same text"), (20, "another text"), (None, "the same text"), (None, "the same text"), (None, None), (21, "́ combining  ́ mark"), (22, "ᄀ" * 700), (23, "\x85 next \x85line"),
]


def got(frame):
    return collections.Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"] or "") for r in frame.collect())


def digests(frame):
    import hashlib

    for r in frame.collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "")


def test_alignment_is_the_libraries(spark):
    docs = spark.createDataFrame(ODD, DOCS).repartition(5).withColumns({"mark": F.lit(1), "side": F.lit(2), "pairs": F.lit(3), "N_A": F.lit(4)})
    frame = alignment.align(docs, with_groups=True)
    assert got(frame) == brute(ODD)
    digests(frame)


def test_many_stretches_and_blocks(spark, monkeypatch):
    import random

    random.seed(3)
    words = ["un", "believ", "able", "Zwölf", "häuser", "été", "12345", "...", "the", "of", "xqzk", "\n", " "]
    rows = [(i, " ".join("".join(random.choices(words, k=random.randint(1, 3))) for _ in range(random.randint(1, 400)))) for i in range(60)] + [(99, " ".join(random.choices(words, k=20_000)))] * 2
    for name, value in {"STRETCH": 500, "STEP": 3000, "TOGETHER": 2000, "BLOCK": 9000}.items():
        monkeypatch.setattr(alignment, name, value)
    assert got(alignment.align(spark.createDataFrame(rows, DOCS).repartition(3), with_groups=True)) == brute(rows)


def test_no_documents(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).collect() == []


def test_pieces_are_where_they_may_be_cut():
    import pyarrow as pa

    texts = ["a b", "", " a  b ", "x\n y  \n z"]
    different, number, many = alignment.pieces(pa.array(texts))
    names = different.to_pylist()
    found = [names[i] for i in number]
    assert found == [" a", " b", " ", "  a ", " b ", " x\n", " y  \n", " z"] or "".join(found) == "".join(" " + t for t in texts)
    assert many.sum() == len(found)


def test_wide_groups_count_alike(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    lengths = np.array([1, 2, 3, 5]), np.array([1, 4, 7])
    a, b = [], []
    for _ in range(20):
        left = rng.integers(0, 4, 60)
        total, right = int(lengths[0][left].sum()), []
        while total:
            right.append(rng.choice([i for i in range(3) if lengths[1][i] <= total]))
            total -= int(lengths[1][right[-1]])
        a.append(left), b.append(np.array(right))
    table = pa.array([f"{i}{s}" for s in ",|;" for i in range(4)], pa.large_string())
    whole = alignment.Cut(a, b, lengths, table)
    monkeypatch.setattr(alignment, "WIDE", 2)
    wide = alignment.Cut(a, b, lengths, table)
    for (k, c), (m, d), n in zip(whole.links, wide.links, whole.n_links, strict=True):
        assert k.tolist() == m.tolist() and c.tolist() == d.tolist() and c.sum() == n


def test_an_encoder_forgets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    own = alignment.Encoder("byte", public_tokenizers.path(alignment.A_FILE))
    for k in range(30):
        names = [f" w{k}x{i}" for i in range(7)] + [" the"]
        first, count = own.places(pa.array(names))
        for name, a, n in zip(names, first, count, strict=True):
            assert b"".join(own.library.bytes[i] for i in own.flat[a : a + n]) == name.encode()
    assert len(own.keys) <= 50
