"""Operators against brute force, on the smallest tables and on hard small rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bpe, components, decontaminate, encoded, language, lines, minhash, pages, pii, registry, simhash, substrings
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(70))
HARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, PASSAGE + " tail"), (7, "head " + PASSAGE),
    (8, PASSAGE + " tail"), (9, LONG), (10, LONG + " more"), (11, "ünïcödé Straße ςΣ İ <|endoftext|> 'll  x\n\n  y"),
    (12, "a line of some length here\nshort\na line of some length here\n\na line of some lengths here"),
    (13, "a line of sum length here\nshort\n\x00\u0085 odd"), (14, "mail a.b@c.de_f@g.hi, 1.2.3.256 or 1.2.3.4.5; +1 (555) 010-9999 4111 1111 1111 1111"),
    (15, "é" * 300), (16, "x" * 5000), (17, "12 " * 400),
]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "documents": [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()],
        "benchmark": [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()],
    }


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(d, t, None, None, None, "clash") for d, t in HARD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def digest(df, *names):
    return {tuple(brute.sha(v) if n == "kept" else v for n, v in zip(names, r)) for r in rows(df, *names)}


# --- whole tables ----------------------------------------------------------------
def test_substring_dedup(spark, tables, hard, empty):
    got = set(rows(QUERIES["op2_substring_dedup"](spark, FOLDER), "doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == brute.substring(tables["documents"])
    names = ("doc_id", "n_words", "n_removed", "kept")
    assert digest(substrings.substring_dedup(hard), *names) == brute.substring(HARD)
    assert rows(substrings.substring_dedup(empty), *names) == []


def test_substring_dedup_keeps_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, PASSAGE), (2, "x " + PASSAGE), (2, PASSAGE), (2, PASSAGE), (None, PASSAGE)], "doc_id long, text string")
    got = sorted(rows(substrings.substring_dedup(docs), "doc_id", "n_words", "n_removed"), key=str)
    assert got == sorted([(1, 70, 0), (2, 71, 70), (2, 70, 70), (2, 70, 70), (None, 70, 70)], key=str)


def test_repeated_windows_of_equal_ids_are_spread():
    passage = " ".join(f"p{i}" for i in range(60))
    for own in (None, 7, 16):
        ids, texts = [own and own * (i + 1) if own == 16 else own for i in range(64)], [f"{passage} tail{i}" for i in range(64)]
        batch = pa.RecordBatch.from_arrays([pa.array([0, *ids], pa.int64()), pa.array([passage, *texts]), pa.array(range(65), pa.int64())], ["doc_id", "text", "twin"])
        sent = [r for b in substrings._windows(16, 50)([batch]) for r in b.to_pylist()]
        assert len({r["part"] for r in sent if r["settled"]}) > 8
        again = pa.Table.from_batches([batch, batch]).combine_chunks().to_batches()
        assert sum(len(r["steps"]) for b in substrings._windows(16, 50)(again) for r in b.to_pylist()) == sum(len(r["steps"]) for r in sent)


def test_simhash(spark, tables, hard, empty):
    got = set(rows(QUERIES["op8_simhash_near_dedup"](spark, FOLDER), "doc_id", "fingerprint", "component_id"))
    assert got == brute.simhash(tables["documents"])
    names = ("doc_id", "fingerprint", "component_id")
    assert set(rows(simhash.near_duplicates(hard), *names)) == brute.simhash(HARD)
    assert rows(simhash.near_duplicates(empty), *names) == []


def test_simhash_links_in_crowded_buckets(spark, monkeypatch):
    r = np.random.default_rng(7)
    centre = r.integers(0, 2**63)
    values = {int(centre)} | {int(centre) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 40, (300, 2))} | {int(x) for x in r.integers(0, 2**63, 50)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute.components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    for bucket in (4, 256):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        keys = simhash.signatures(df).repartition(3, "key").sortWithinPartitions("key", "fp").toPandas()
        assert len(keys) == 64 * len(values)
        got = dict(rows(components.connected_components(simhash.linked(df)), "node", "component"))
        assert all(got.get(v, v) == want[v] for v in values)


def test_line_dedup(spark, tables, hard, empty):
    want = brute.lines(tables["documents"])
    got = rows(QUERIES["op1_line_dedup"](spark, FOLDER), "doc_id", "n_lines", "n_removed", "n_links", "kept_sha256")
    assert {d: tuple(rest) for d, *rest in got} == want
    for docs, plain in ((hard, HARD), (empty, [])):
        found = rows(lines.line_dedup(docs), "doc_id", "n_lines", "removed", "n_links", "kept")
        assert {d: (n, len(r), k, brute.sha(t)) for d, n, r, k, t in found} == brute.lines(plain)


def test_edit_distance_in_a_band():
    r = np.random.default_rng(3)
    for _ in range(3000):
        a = "".join(r.choice(list("abc"), r.integers(0, 12)))
        b = list(a)
        for _ in range(r.integers(0, 4)):
            b.insert(r.integers(0, len(b) + 1), str(r.choice(list("abc"))))
            b.pop(r.integers(0, len(b)))
        for most in (0, 1, 2, 3):
            assert lines.edit_distance(a, "".join(b), most) == min(brute.distance(a, "".join(b)), most + 1)


def test_crowded_line_keys(spark, monkeypatch):
    base = "the quick brown fox jumps over the lazy dog and runs away"
    texts = [base[:i] + c + base[i + 1 :] for i in range(0, 57, 3) for c in "XYZ"]
    docs = [(i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(lines, "GROUP", 4)
    [(edits, keys, numbers, index)], sketches = lines.line_keys(texts)
    assert edits == 2 and index.sum() == 3 * len(texts)
    got = rows(lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_links")
    assert {d: n for d, n in got} == {d: v[2] for d, v in brute.lines(docs).items()}


def test_decontamination(spark, tables, hard, empty):
    got = set(rows(QUERIES["op4_benchmark_decontamination"](spark, FOLDER), "doc_id", "item_id"))
    assert got == brute.leaks(tables["documents"], tables["benchmark"])
    words = [f"word{i}" for i in range(40)]
    edited = [w if i % 6 else "other" for i, w in enumerate(words)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    docs = [(1, "clean text of other words " * 9), (2, "x " * 30 + " ".join(edited).upper() + " y" * 30), (3, None), (4, "here are two, words"), (5, " ".join(words[:10]))]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert set(rows(found, "doc_id", "item_id")) == {(2, 1), (4, 4)}
    assert rows(decontaminate.contaminated(empty, items), "doc_id") == []
    assert rows(decontaminate.contaminated(hard, items.limit(0)), "doc_id") == []
    assert decontaminate.uncontaminated(hard, items).count() == len(HARD)


def test_decontamination_in_several_passes(spark, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 2000)
    got = set(rows(QUERIES["op4_benchmark_decontamination"](spark, FOLDER), "doc_id", "item_id"))
    assert got == brute.leaks(tables["documents"], tables["benchmark"])


def test_fingerprints(spark, tables, hard, empty):
    for found, plain in ((QUERIES["op3_document_fingerprints"](spark, FOLDER), tables["documents"]), (minhash.fingerprint_pairs(hard), HARD)):
        want = brute.edited(plain)
        got = found.collect()
        assert len(got) == len(want)
        for r in got:
            text, edited, following = want[r["doc_id"]]
            assert r["n_chars"] == len(text)
            assert (r["edited_sha256"] if "edited_sha256" in r else brute.sha(r["edited"])) == brute.sha(edited)
            assert abs(r["near_edited"] - brute.jaccard(text, edited)) < 0.2
            assert abs(r["near_next"] - brute.jaccard(text, following)) < 0.2
    assert minhash.fingerprint_pairs(empty).collect() == []


def test_fingerprints_of_equal_texts_are_equal():
    low, some = minhash.bins([b"a b c d e f", b"", b"a b c d e f", b"a"])
    prints = minhash.fingerprint_texts(low, some)
    assert prints[0] == prints[2] and prints[1] == "" and prints[3]


def test_token_files(spark, tables, hard, empty, folder):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    got = set(rows(QUERIES["op5_token_binary_output"](spark, FOLDER), *names))
    assert got == brute.token_files(tables["documents"], Tokenizer.from_file(path))
    vocabulary = open(path, encoding="utf-8").read()
    for i, (docs, plain) in enumerate(((hard, HARD), (empty, []))):
        files = encoded.write_token_files(docs, vocabulary, f"{folder}/tokens{i}", file_ids=1000)
        assert set(rows(encoded.read_token_files(files), *names)) == brute.token_files(plain, Tokenizer.from_file(path))


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 4000])
@pytest.mark.parametrize("top", [2, 50_000, 2**40, 2**63])
def test_simple8b_round_trip(size, top):
    ids = np.random.default_rng(size).integers(0, top, size, dtype=np.uint64)
    ids[::5] = 0
    data = encoded.encode(ids)
    assert (encoded.decode(data) == ids).all()
    if size > 1024:
        assert (encoded.decode(data, 1, 2) == ids[512:1024]).all()


def test_personal_data(spark, tables, hard, empty):
    def want(plain):
        return {(d, *brute.pii(t)[:4], brute.sha(brute.pii(t)[4])) for d, t in plain}

    got = rows(QUERIES["op6_pii"](spark, FOLDER), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert set(got) == want(tables["documents"])
    found = pii.personal_data(hard).select("doc_id", pii.listed(pii.BASE).alias("spans"))
    assert set(rows(found, "doc_id", "spans")) == {(d, brute.pii(t)[4]) for d, t in HARD}
    assert pii.personal_data(empty).collect() == []


def test_personal_data_validators_and_context(spark):
    many = "a@b.c " * 3000 + "9" * 20_000
    texts = [(1, "konto DE89 3704 0044 0532 0130 00 und DE89 3704 0044 0532 0130 01"), (2, "my social security number 078-05-1120"), (3, "part 078-05-1120"), (4, many)]
    got = pii.personal_data(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [s["value"] for s in got[0]["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [len(r["ssn"]) for r in got[:3]] == [0, 1, 0]
    assert [(s["start"], s["end"]) for s in got[3]["email"]] == [(6 * i, 6 * i + 5) for i in range(3000)]


def test_personal_data_context_in_lists_and_behind(spark):
    apart = "1.2.3.4 " * 5 + "x" * 33 + " ssn"
    texts = [
        (1, "SSNs: 078-05-1120, 219-09-9999"), (2, "078-05-1120 (SSN)"), (3, "part 078-05-1120, 219-09-9999"),
        (4, "078-05-1120" + "." * 40 + "ssn"), (5, "phone: +1 555 010 9999, +1 555 010 8888"), (6, "ssn" + "." * 38 + "078-05-1120"), (7, apart),
    ]
    got = pii.personal_data(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s["value"] for s in r["ssn"]] for r in got[:4]] == [["078-05-1120", "219-09-9999"], ["078-05-1120"], [], []]
    assert [round(s["score"], 1) for s in got[4]["phone"]] == [0.9, 0.9] and got[5]["ssn"] == []
    assert [(s["start"], round(s["score"], 1)) for s in got[6]["ip"]] == [(8 * i, 0.5) for i in range(5)]


def test_language(spark, hard, empty):
    got = QUERIES["op7_language_id"](spark, FOLDER).collect()
    truth = dict(rows(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id", "lang"))
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and len(held) > 40
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    model = language.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    found = {r["doc_id"]: r for r in language.predict(hard, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 17)] == ["und"] * 4 and found[9]["lang_pred"] != "und"
    untaught = language.train(empty)
    assert {r["lang_pred"] for r in language.predict(hard, untaught).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []
    assert language.accepted(hard, model).columns == hard.columns


def test_pages(spark):
    source = dict(rows(spark.read.parquet(f"{FOLDER}/pages.parquet"), "page_id", "html"))
    for r in QUERIES["op9_html_extraction"](spark, FOLDER).collect():
        assert r["text"] == brute.article(source[r["page_id"]]) and r["n_chars"] == len(r["text"])
    odd = [(1, None), (2, ""), (3, "<p>"), (None, "just text"), (5, "<div" + "<b>" * 3000 + "deep")]
    found = pages.main_text(spark.createDataFrame(odd, "page_id long, html string").selectExpr("page_id", "html", "null url"))
    assert len(found.collect()) == 5
    assert found.limit(0).collect() == []


def test_page_without_article_element():
    html = """<body><header>Top</header><div class="menu"><a href=/>Home</a> <a href=/b>B</a></div><div id=content><h1>Title &amp; more</h1>
    <p>First, long   paragraph, with commas, and words.<p>Second one &eacute;.</div><div class="comments"><p>Great, really, great!</p></div>
    <aside>Side</aside><form>Send</form><div class="cookie-notice">We use cookies</div><script>var x="<p>no</p>";</script><footer>End</footer></body>"""
    assert pages.extract(html) == "Title & more First, long paragraph, with commas, and words. Second one é."


def test_page_with_names_of_other_parts_around_its_text():
    body = "<p>First paragraph, with commas, and words.</p><p>Second one, longer than it.</p>"
    text = "First paragraph, with commas, and words. Second one, longer than it."
    for name in ("content no-sidebar", "layout-with-nav", "post has-comments", "sidebar", "comments", "content search"):
        assert pages.extract(f"<body><div class='menu'><a href=/>Home</a></div><div class='{name}'>{body}</div></body>") == text
        assert pages.extract(f"<body><div class='{name}'><article>{body}</article><div class='share'>Tell</div></div></body>") == text
        assert pages.extract(f"<body><div class='{name}'><h1>T</h1>{body}</div></body>") == "T " + text
    for name in ("id='discussion'", "class='reviews'", "class='search'", "class='notice'", "class='share'"):
        assert pages.extract(f"<body><article>{body}<section {name}><h2>H</h2><p>More, of it.</p></section></article></body>") == text + " H More, of it."
    reader = "<div class='comments'>" + "<p>Great, really, great, yes, so, great!</p>" * 9 + "</div>"
    for page in (f"<article>{body}{reader}</article>", f"<div><h1>T</h1>{body}</div>{reader}", f"<article>{body}</article>{reader}"):
        assert "Great" not in pages.extract(f"<body>{page}<div class=share><a href=/>Share</a></div></body>")
    assert pages.extract("<body><div class='ad'><a href=/>Only this</a></div></body>") == "Only this"


def test_bpe(spark, tables, hard, empty):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert set(rows(QUERIES["op10_bpe_encode_decode"](spark, FOLDER), *names)) == brute.bpe(tables["documents"], tokenizer)
    for docs, plain in ((hard, HARD), (empty, [])):
        found = bpe.digests(bpe.encode_texts(docs, bpe.byte_vocabulary()))
        assert set(rows(found, *names)) == brute.bpe(plain, tokenizer)


def test_chunk_joins_agree_with_whole_texts(monkeypatch):
    coder = bpe.ChunkCoder(bpe.byte_vocabulary())
    r = np.random.default_rng(5)
    parts = ["a", "é", "'", " ", "   ", "\n", "1", "s", "re", "ll", "_", "!", "日", "²", " ", "'re", "\t"]
    for _ in range(500):
        text = "".join(r.choice(parts, r.integers(1, 60)))
        data = text.encode()
        ends = sorted({len("".join(text[:i]).encode()) for i in r.integers(1, len(text) + 1, 6)} | {len(data)})
        chunks = [data[a:b] for a, b in zip([0, *ends], ends) if b > a]
        coder.learn(chunks)
        assert np.frombuffer(coder.encode(chunks), dtype="<i4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


# --- the pipeline ----------------------------------------------------------------
def test_pipeline_stages(spark, hard, empty):
    for docs in (hard, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, FOLDER)
            assert found.columns == docs.columns and found.dtypes == docs.dtypes
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, hard, FOLDER).collect()}
    part = brute.near_copies(HARD)
    assert kept == {d for d in part if part[d] == d}
    twice = hard.union(hard)
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, twice, FOLDER).collect()) == sorted(kept)


def test_pipeline(spark, tables):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    ids = [r["doc_id"] for r in got]
    assert len(set(ids)) == len(ids) and set(ids) <= {d for d, _ in tables["documents"]}
    leaked = {d for d, _ in brute.leaks(tables["documents"], tables["benchmark"])}
    copies = {d for d, c in brute.near_copies(tables["documents"]).items() if c != d}
    assert {d for d, _ in tables["documents"]} - set(ids) <= leaked | copies


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([Row(doc_id=None, text="some words of a line here"), Row(doc_id=3, text="some words of a line here"), Row(doc_id=3, text="some words of a line here")], "doc_id long, text string")
    assert sorted(rows(simhash.near_duplicates(docs), "component_id")) == [(3,)] * 3
    assert sorted(rows(lines.line_dedup(docs), "doc_id", "kept"), key=str) == sorted([(None, ""), (3, docs.first()["text"]), (3, docs.first()["text"])], key=str)
    assert minhash.fingerprint_pairs(docs).count() == 3
    assert bpe.encode_texts(docs, bpe.byte_vocabulary()).count() == 3


def test_one_row_of_each_group_of_near_copies_stays(spark):
    a, b, c = (" ".join(f"{name}{i}" for i in range(40)) for name in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (9, b), (None, c), (None, c), (None, c)], "doc_id long, text string")
    kept = rows(simhash.first_of_each(docs), "doc_id", "text")
    assert sorted(kept, key=str) == sorted([(5, a), (5, b), (None, c)], key=str)
    near = docs.selectExpr("doc_id", "if(doc_id = 9, concat(text, ' '), text) text", "map('k', text) extra")
    assert sorted(r[:2] for r in simhash.first_of_each(near).collect() if r["doc_id"]) == [(5, a), (5, b)]
