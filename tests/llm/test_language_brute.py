"""Language identification against naive Bayes in plain Python, n-gram by n-gram."""

from collections import Counter, defaultdict
from math import exp, log
from zlib import crc32

from lodestone.llm import language

FOLDER = "/root/testdata/sf0.001"
MASK = 0xFFFFFFFF


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    squeezed = "".join(c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " ")
    found = Counter()
    for order in (1, 2, 3):
        for at in range(len(squeezed) - order + 1):
            value = order
            for place in range(order):
                value = (value ^ ord(squeezed[at + place])) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[place] & MASK
                value ^= value >> 15
            found[value % language.BUCKETS] += 1
    return found


def plain_bayes(labelled):
    rows, counts = Counter(), defaultdict(Counter)
    for text, lang in labelled:
        rows[lang] += 1
        counts[lang].update(plain_grams(text))
    sums = {x: sum(c.values()) + language.SMOOTHING * language.BUCKETS for x, c in counts.items()}

    def predict(text):
        if not text or not any(map(str.isalpha, text)) or not counts:
            return "und", 0.0, 1.0
        grams = plain_grams(text)
        seen = {x: sum(n * log((counts[x][b] + language.SMOOTHING) / sums[x]) for b, n in grams.items()) for x in counts}
        prior = {x: log(rows[x] / sum(rows.values())) for x in counts}
        order = sorted(counts, key=lambda x: (-(seen[x] + prior[x]), x))
        best, margin = order[0], 1.0
        if len(order) > 1:
            margin = seen[best] + prior[best] - seen[order[1]] - prior[order[1]]
        size = sum(grams.values())
        share = min(size, language.EVIDENCE) / size
        odds = {x: exp(share * (seen[x] - seen[best]) + prior[x] - prior[best]) for x in counts}
        return best, 1 / sum(odds.values()), margin

    return predict


def agree(rows, texts, predict):
    for row in rows:
        lang, score, margin = predict(texts[row["doc_id"]])
        if margin > 0.01:  # a closer race may turn on single precision
            assert row["lang_pred"] == lang, row["doc_id"]
            assert abs(row["score"] - score) < 1e-3, row["doc_id"]


def test_the_query_is_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()
    remainder = {r["doc_id"]: crc32(str(r["doc_id"]).encode()) % 3 for r in docs}
    predict = plain_bayes((r["text"], r["lang"]) for r in docs if remainder[r["doc_id"]] != 1 and r["lang"] and r["text"] is not None)
    got = language.QUERIES["op7_language_id"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(remainder)
    assert all(r["held_out"] == (remainder[r["doc_id"]] == 1) for r in got)
    agree(got, {r["doc_id"]: r["text"] for r in docs}, predict)


def test_odd_texts_and_near_ties(spark):
    learned = [(1, "ab ba", "x"), (2, "AB  ba!", "y"), (3, "ça été", "z"), (4, "", "x"), (5, "1 2 3", "y"), (6, None, "z"), (7, "ab", None)]
    schema = "doc_id long, text string, lang string, score string"
    model = language.train(spark.createDataFrame([(*r, "clash") for r in learned], schema))
    asked = ["ab", "ba ba", "é", "çç", "", None, "42 !", " a ", "İstanbul", "a" * 5000 + " été", "日本", "ab\u0000ba"]
    rows = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(asked)], schema)
    got = language.predict(rows, model).collect()
    assert len(got) == len(asked)
    agree(got, dict(enumerate(asked)), plain_bayes((t, x) for _, t, x in learned if t is not None and x is not None))
