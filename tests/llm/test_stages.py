"""Stages of the pipeline on hand-made documents."""

from __future__ import annotations

import random

import corpus_pipeline

SYLLABLES = {"en": "the er in th on ing ed re", "fr": "eau ou ai é tion le qu ment", "de": "sch ung ein er ü zu keit ge"}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_short_texts_of_a_known_language_stay(spark):
    rows = [(100 * k + i, prose(lang, 80, 100 * k + i), lang) for k, lang in enumerate(SYLLABLES) for i in range(20)]
    rows += [(900, "er", "en"), (901, "e", "de"), (902, "###", "en"), (903, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {r[0] for r in rows} - {902, 903}


def test_repeated_ids_and_nulls_keep_their_documents(spark):
    one, two, three, four = (prose("en", 40, i) for i in range(4))
    rows = [(None, one), (None, two), (7, three), (7, three), (7, four), (3, three + " more"), (8, four), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for given in (rows, [r for r in rows if r[0] != 7 or r[1] == three][:3] + [(3, three + " more")]):
        got = corpus_pipeline.dedup(spark, spark.createDataFrame(given, docs.schema), "").collect()
        want = [(None, one), (None, two), (3, three + " more")]
        if given is rows:
            want += [(7, four), (9, None), (9, "")]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
