"""The exact stages of the pipeline against plain versions, row by row, over all rows of the small tables.

The first stage learns from what it is given; its model is held to the definition in test_operators.py and its decisions to
planted cases in test_pipeline.py.
"""

import base64
import collections
import re

import public_tokenizers
import pytest

import corpus_pipeline
from paperweir.llm import byte_bpe
from paperweir.llm.common import table

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    frame = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    # rows that repeat an id and a text, texts without words, and nulls
    more = [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, rows[0][1]), (10_005, rows[1][1] + " "), (10_006, "two words")]
    added = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.unionByName(added.select(*(added[c].cast(frame.schema[c].dataType).alias(c) for c in frame.columns))), rows + more


def stays(stage, spark, docs, sf_dir):
    return collections.Counter((r["doc_id"], r["text"]) for r in STAGES[stage](spark, docs[0], sf_dir).select("doc_id", "text").collect())


def test_exact_dedup(spark, docs, sf_dir):
    best = {}
    for i, t in docs[1]:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        best[key] = min(best.get(key, (1, 0, None)), (-len(t or ""), i, t), key=lambda x: x[:2])
    assert stays("exact_dedup", spark, docs, sf_dir) == collections.Counter((i, t) for _, i, t in best.values())


def test_near_dedup(spark, docs, sf_dir):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in docs[1]:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[top(a)] = top(b)
    first = {}
    for k, (i, _) in enumerate(docs[1]):
        if sets[k]:
            first[top(k)] = min(first.get(top(k), i), i)
    want = collections.Counter((i, t) for k, (i, t) in enumerate(docs[1]) if not sets[k] or first[top(k)] == i)
    assert stays("near_dedup", spark, docs, sf_dir) == want


def test_decontamination(spark, docs, sf_dir):
    def words(t):
        return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())

    def shingles(w):
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    items = [words(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    held = collections.defaultdict(set)
    for n, w in enumerate(items):
        for s in shingles(w):
            held[s].add(n)
    want = collections.Counter()
    for i, t in docs[1]:
        w = words(t)
        parts = shingles(w)
        near = collections.Counter(n for s in parts for n in held.get(s, ()))
        hit = False
        for n, c in near.items():
            own = collections.Counter(shingles(items[n]))
            size = sum(own.values())
            if c < 0.4 * size:
                continue
            for k in range(max(1, len(parts) - size + 1)):
                window = collections.Counter(parts[k : k + size])
                both = sum((window & own).values())
                if both >= 0.8 * sum((window | own).values()) - 1e-9:
                    hit = True
                    break
            if hit:
                break
        if not hit:
            want[i, t] += 1
    assert sum(want.values()) < len(docs[1])
    assert stays("decontamination", spark, docs, sf_dir) == want


def test_tokens(spark, docs, sf_dir):
    import tiktoken

    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = collections.Counter((i, tuple(library.encode_ordinary(t or "")), True) for i, t in docs[1])
    got = STAGES["byte_bpe"](spark, docs[0], sf_dir).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in got) == texts
