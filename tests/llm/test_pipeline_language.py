"""The language stage against texts of other languages, of other scripts and without any language."""

import numpy as np
import pytest

import corpus_pipeline
from paperweir.llm.common import table

FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są obdarzeni rozumem i sumieniem.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है।",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах, они наделены разумом и совестью.",
}


def noise():
    rng = np.random.default_rng(5)
    for n in (20, 100, 400):
        for _ in range(20):
            yield "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 20_000, n))
            yield "".join("0123456789abcdef"[int(x)] for x in rng.integers(0, 16, 3 * n))


@pytest.fixture(scope="module")
def stayed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    other = [t * m for t in FOREIGN.values() for m in (1, 8)] + list(noise())
    rows = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(other)], "doc_id long, text string")
    out = corpus_pipeline.language_id(spark, docs.unionByName(rows, allowMissingColumns=True), sf_dir).select("doc_id", "text").collect()
    ids = {r["doc_id"] for r in out}
    return docs.where(r"text RLIKE '\\p{L}'").select("doc_id").collect(), ids, {i: t for i, t in enumerate(other) if 10**9 + i in ids}


def test_labelled_texts_stay(stayed):
    rows, ids, _ = stayed
    assert np.mean([r["doc_id"] in ids for r in rows]) > 0.99


def test_other_texts_go(stayed):
    assert stayed[2] == {}
