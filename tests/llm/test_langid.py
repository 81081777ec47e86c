import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from terseflow.llm import langid


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


TONGUES = {"aa": ["ka", "ton", "mi", "re"], "bb": ["sch", "en", "ung", "ver"], "cc": ["ción", "os", "ar", "ll"]}


def corpus():
    rng = random.Random(3)
    return [(i, speech(rng, TONGUES[lang], rng.randint(5, 120)), lang, "s", 0) for i, lang in enumerate(sorted(TONGUES) * 60)]


def test_held_out_accuracy_and_rejection(make):
    rows = corpus()
    model = langid.fit(make(rows[:120]))
    found = {r.doc_id: r for r in langid.identify(make(rows[120:]), model).collect()}
    assert sum(found[i].lang_pred == lang for i, _, lang, *_ in rows[120:]) >= 0.98 * len(rows[120:])
    assert sum(r.rejected for r in found.values()) <= 0.02 * len(found)
    foreign = make([(1, "ждл щцу " * 40), (2, "xqz wvk zzj " * 40), (3, "1234 5678"), (4, ""), (5, None)])
    assert all(r.rejected for r in langid.identify(foreign, model).collect())
    assert {r.doc_id: r.similarity for r in langid.identify(foreign, model).collect()}[5] == 0


def test_keeps_columns_and_whole_rows(make):
    docs = make(corpus())
    model = langid.fit(docs)
    kept = langid.keep_identified(docs.withColumn("rejected", F.lit("mine")), model)
    assert kept.columns == [*docs.columns, "rejected"] and kept.count() >= 0.99 * docs.count()
    twice = langid.identify(make([corpus()[0], corpus()[0]]), model).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_nothing_to_learn_from(make):
    empty = langid.fit(make([]))
    assert langid.identify(make([]), empty).count() == 0
    only = langid.identify(make([(1, "some text", None, "s", 0)]), langid.fit(make([(1, "some text", None, "s", 0)]))).collect()
    assert only[0].rejected and only[0].lang_pred is None
    one = make([(1, "word " * 50_000, "aa", "s", 0)])
    assert [r.lang_pred for r in langid.identify(one, langid.fit(one)).collect()] == ["aa"]


def plain_grams(text):
    """Counts of the byte 1- to 3-grams of letters, where a blank may stand before and after words but never twice."""
    raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
    counts = Counter(raw[i : i + 1] for i in range(len(raw)) if raw[i] != 32)
    for i in range(len(raw) - 1):
        if raw[i : i + 2] != b"  ":
            counts[raw[i : i + 2]] += 1
            if i + 2 < len(raw) and raw[i + 1 : i + 3] != b"  ":
                counts[raw[i : i + 3]] += 1
    return counts


def test_equals_plain_nearest_centroids(make):
    """Dictionaries of n-grams instead of hashed vectors, with the model's centroids built again from the sample by hand."""
    rows = corpus()[:90]
    model = langid.fit(make(rows), centroids=1)
    grams = [plain_grams(t) for _, t, *_ in rows]
    df = Counter(g for c in grams for g in c)

    def vector(counts):
        x = {g: (1 + math.log(n)) * (1 + math.log((1 + len(rows)) / (1 + df[g]))) for g, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / norm for g, v in x.items()}

    centroids = {}
    for lang in sorted(TONGUES):
        total = Counter()
        for counts, (_, _, own, *_) in zip(grams, rows):
            if own == lang:
                total.update(vector(counts))
        norm = math.sqrt(sum(v * v for v in total.values()))
        centroids[lang] = {g: v / norm for g, v in total.items()}
    tested = corpus()[90:] + [(500, "", "", "", 0), (500, "", "", "", 0), (501, "Ka ton, MI re. 12", "", "", 0)]
    found = {r.doc_id: r for r in langid.identify(make(tested), model).collect()}
    for doc_id, text, *_ in tested:
        x = vector(plain_grams(text)) if text else {}
        cosine = {lang: sum(v * c.get(g, 0) for g, v in x.items()) for lang, c in centroids.items()}
        best = max(cosine, key=cosine.get) if text else None
        letters = len(re.findall(r"[a-z]|[^\x00-\x7f]", text.lower()))
        assert found[doc_id].lang_pred == best, (doc_id, cosine)
        if text:
            assert abs(found[doc_id].similarity - cosine[best]) < 0.02  # hashed n-grams may collide
            assert found[doc_id].rejected == (found[doc_id].similarity < model.floor[int(math.log2(letters))]) or any(ord(c) > 127 for c in text)


def test_held_out_accuracy_on_the_documents(spark):
    """Fitted on the even ids of the given documents, tested on the odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    found = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred is not null").collect()
    assert len(found) > 400 and sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert sum(r.rejected for r in found) <= 0.03 * len(found)


def test_clashing_columns(spark):
    rows = [(i, t, lang, 1, "x", 2.0) for i, t, lang, *_ in corpus()[:60]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int, lang_pred string, __tf_cos double")
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(rows)
    assert langid.identify(docs, langid.fit(docs)).columns == ["doc_id", "lang_pred", "similarity", "rejected"]
