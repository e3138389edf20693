"""PII, quality, SentencePiece, toxicity and licences against brute force, and on odd rows."""

import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.llm import licenses, pieces, pii, quality, queries, toxicity

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
        "card": 12 <= len(digits) <= 19 and _luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def _spans(text):
    found = [
        (m.start(), n, m.end(), kind)
        for n, (kind, pattern) in enumerate(PLAIN)
        for m in re.finditer(pattern, text or "")
        if _passes(kind, m.group())
    ]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def _fuzz(parts, n, longest=25, seed=3):
    random.seed(seed)
    return ["".join(random.choice(parts) for _ in range(random.randint(0, longest))) for _ in range(n)]


def test_pii_spans_match_plain_expressions(spark, docs_of, odd):
    parts = ["a@b.c", "@", ".", "1", "+1", "2 ", "-", "_", "x", "é", "🙂", "4539578763621486", " "]
    parts += ["10.0.0.1", "300.1.1.1", "(068) 555-2748", "+1 (068) 555-2748"]
    texts = _fuzz(parts, 400) + ["1" * 30_000, "1 " * 9_000, "a.b@c.d " * 500, "+1" * 9_000, None, ""]
    docs = docs_of(list(enumerate(texts)))
    rows = pii.find(docs).select("text", pii.named(pii.base_only(F.col("_spans"))).alias("s")).collect()
    assert all(r["s"] == _spans(r["text"]) for r in rows)
    assert pii.find(odd).count() == odd.count()


def test_pii_checksums_context_and_redaction(docs_of):
    text = "IBAN DE89370400440532013000 or DE88370400440532013000, ssn 123-45-6789; part 123-45-6789x"
    row = pii.find(docs_of([(1, text), (2, "part 123-45-6789")])).withColumn(
        "r", pii.redacted(F.col("text"), F.col("_spans"))
    ).orderBy("doc_id").collect()
    assert [s["kind"] for s in row[0]["_spans"]][0] == "iban"
    assert sum(s["kind"] == "iban" for s in row[0]["_spans"]) == 1
    assert any(s["kind"] == "national_id" for s in row[0]["_spans"])
    assert row[1]["_spans"] == [] and row[1]["r"] == "part 123-45-6789"
    assert row[0]["r"].startswith("IBAN <iban> or DE88")


def test_quality_counts_and_verdicts(spark, docs_of, odd, empty):
    clean = "The quick fox saw a lazy dog near the old mill.\nIt ran off over the hill at dawn again."
    junk = "aa### bb*** cc%%% dd&&& ee$$$ ff### gg*** hh%%% ii&&& jj$$$ kk### ll***"
    docs = docs_of([(i, clean + f" Note {i}.") for i in range(20)] + [(100 + i, junk) for i in range(20)])
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(10)] + [(100 + i, 0, 0) for i in range(10)],
        "doc_id long, quality int, toxic int",
    )
    model = quality.fit_line_model(docs, labels)
    kept = {r["doc_id"]: r["_quality"]["kept"] for r in quality.assess(docs, model).collect()}
    assert all(kept[i] for i in range(20)) and not any(kept[100 + i] for i in range(20))
    mixed = quality.assess(docs_of([(1, clean), (2, clean + "\n" + junk), (3, junk + "\n" + junk + " x\n" + clean)]), model)
    share = {r["doc_id"]: r["_quality"]["content_share"] for r in mixed.collect()}
    assert share[1] == 1 and 0 < share[3] < 0.5 < share[2] < 1  # lines of one text differ
    nothing = quality.fit_line_model(docs, labels.where("false"))
    rows = {r["doc_id"]: r["_quality"] for r in quality.assess(odd, nothing).collect()}
    assert rows[2]["n_words"] == 0 and not rows[2]["kept"] and rows[8]["base_failed"]
    assert quality.assess(empty, nothing).count() == 0


def test_repeated_words_equals_brute_force():
    random.seed(1)
    for _ in range(300):
        words = [random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 40))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert quality.repeated_words(words) == len(hit)


def test_crf_viterbi_is_the_best_path_and_slope_is_right():
    from itertools import product

    rng = np.random.default_rng(0)
    size = len(quality.FEATURES)
    model = quality.LineModel(rng.normal(size=size), rng.normal(size=(2, 2)))
    x = rng.normal(size=(6, size))

    def score(path):
        t = sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False))
        return sum((x @ model.weights)[i] for i, s in enumerate(path) if s) + t

    best = max(product((0, 1), repeat=6), key=score)
    assert list(best) == model.labels(x)
    states = (0, 1, 1, 0, 1, 1)
    data, inside, y = x[None], np.ones((1, 6), bool), np.array([states])
    at = np.concatenate((model.weights, model.transitions.ravel()))

    def loss(p):
        m = quality.LineModel(p[:size], p[size:].reshape(2, 2))
        total = {
            path: sum((x @ m.weights)[i] for i, s in enumerate(path) if s)
            + sum(m.transitions[a, b] for a, b in zip(path, path[1:], strict=False))
            for path in product((0, 1), repeat=6)
        }
        return np.logaddexp.reduce(list(total.values())) - total[states]

    slope = quality._slope(at, data, inside, y, np.ones(1))
    step = np.eye(len(at)) * 1e-6
    assert np.allclose(slope, [(loss(at + s) - loss(at - s)) / 2e-6 for s in step], atol=1e-5)


@pytest.fixture(scope="module")
def known():
    return queries.vocabulary()


def test_sentencepiece_equals_the_library(spark, docs_of, odd, known):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    parts = list("aab  \n\t▁eèñ中🙂​.,=-12") + ["<s>", "</s>", "the", "▁▁", "        "]
    texts = _fuzz(parts, 400, 60) + ["", " ", "\n", " " * 40, "ab" * 3000, "==" * 3000, None]
    docs = docs_of(list(enumerate(texts))).union(odd)
    rows = docs.select("text", pieces.round_trip(spark, docs["text"], known).alias("p")).collect()
    for r in rows:
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert bytes(r["p"]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["p"]["text"] == lib.decode(ids)
    one = docs.where("doc_id = 3").select(pieces.encoded(spark, F.col("text"), known).alias("i"))
    both = one.select(pieces.token_ids(F.col("i")).alias("n"), pieces.decoded(spark, F.col("i"), known).alias("t"))
    assert all(r["n"] == lib.encode(r["t"], add_bos=True, add_eos=True) for r in both.collect())


def test_toxicity_gradient_and_learning(spark, docs_of, odd):
    rng = np.random.default_rng(0)
    tokens = ["idiot", "the", "mill", "fox", "averyverylongtoken"[:16]]
    model = toxicity.ToxicModel.start({"the": 1, "fox": 2})
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    at = rng.integers(0, 5, (toxicity.WINDOW, 3))
    inside = np.ones_like(at, bool)
    inside[9:, 1] = False
    y = np.array([1.0, 0.0, 1.0])
    _, slopes = model.slopes(tokens, at, inside, y)
    for name, w in model.weights.items():
        i = np.unravel_index(np.abs(slopes[name]).argmax(), w.shape)
        w[i] += 1e-5
        up = model.slopes(tokens, at, inside, y)[0]
        w[i] -= 2e-5
        down = model.slopes(tokens, at, inside, y)[0]
        w[i] += 1e-5
        assert abs(slopes[name][i] - (up - down) / 2e-5) < 1e-4
    random.seed(5)
    words = ["".join(random.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]
    texts = [[random.choice(words) for _ in range(60)] for _ in range(500)]
    labels = [int(i % 5 == 0) for i in range(500)]
    for text, label in zip(texts, labels, strict=True):
        if label:
            for _ in range(2):
                text[random.randrange(60)] = random.choice(["idiot", "moron", "scum"])
    fitted = toxicity.fit([" ".join(t) for t in texts[:350]], labels[:350])
    scores = toxicity.Scorer(fitted)([" ".join(t) for t in texts[350:]])[:, 0]
    wrong = (scores >= 0.3) != (np.array(labels[350:]) == 1)
    assert wrong.mean() < 0.1
    out = odd.select("doc_id", toxicity.scored(spark, odd["text"], fitted).alias("t")).collect()
    assert all(0 <= r["t"]["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["t"]["windows"] for r in out}[2] == 0


@pytest.mark.parametrize("toxic", [range(0, 160, 40), [3]])
def test_toxicity_learns_from_few_toxic_texts(toxic):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(60)]
    texts = [[rng.choice(words) for _ in range(40)] for _ in range(200)]
    for i in toxic:
        texts[i][20] = "kzxqwvk"
    labels = [int(i in toxic) for i in range(200)]
    fitted = toxicity.fit([" ".join(t) for t in texts[:160]], labels[:160])
    fresh = texts[160:]
    clean = toxicity.Scorer(fitted)([" ".join(t) for t in fresh])[:, 0]
    rude = toxicity.Scorer(fitted)([" ".join([*t[:9], "kzxqwvk", *t[10:]]) for t in fresh])[:, 0]
    assert np.median(rude) > np.quantile(clean, 0.9)


def test_all_words_lie_in_a_window():
    lengths = np.array([0, 1, 31, 32, 33, 56, 57, 200])
    at, inside, text = toxicity.windows_of(lengths)
    for i, n in enumerate(lengths):
        assert len(np.unique(at[:, text == i][inside[:, text == i]])) == n
    assert "".join(toxicity.tokens_of("x" * 50)) == "x" * 50


def test_phrases_of_half_a_window_lie_whole_in_one():
    at, inside, _ = toxicity.windows_of(np.array([200]))
    held = [set(a[i].tolist()) for a, i in zip(at.T, inside.T, strict=True)]
    for start in range(184):
        assert any(set(range(start, start + 17)) <= h for h in held)


def test_licenses_survive_spelling_case_and_copyright(docs_of, odd, empty):
    mit = dict(licenses.LICENSES[:1])["MIT"]
    changed = "Copyright (c) 2020 A. Person\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,")
    rows = {r["doc_id"]: r for r in licenses.scan(
        docs_of([(1, changed), (2, mit + "\nmore"), (3, "Text.\nreleased under the MIT licence!")])
    ).collect()}
    assert rows[1]["license"] == "MIT" and rows[2]["license"] is None
    assert rows[3]["notices"] == "MIT"
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def test_licenses_from_a_table(spark, docs_of):
    header = (
        'Licensed under the Apache License, Version 2.0 (the "License");\n'
        "you may not use this file except in compliance with the License."
    )
    table = spark.createDataFrame(
        [("Apache-2.0", header), ("GPL-3.0-only", "One\ntext."), ("GPL-3.0-or-later", "One text")],
        "license string, text string",
    )
    docs = docs_of([(1, header.replace("\n", " ")), (2, "one text"), (3, "Prose.\nOne text\n"), (4, header + "\nx")])
    rows = {r["doc_id"]: r for r in licenses.scan(docs, licenses=table).collect()}
    assert len(rows) == 4 and [rows[i]["license"] for i in (1, 2, 3, 4)] == [
        "Apache-2.0", "GPL-3.0-only,GPL-3.0-or-later", None, None
    ]
    assert rows[3]["notices"] == "GPL-3.0-only,GPL-3.0-or-later" and rows[4]["notices"] == ""
