"""Language, spelling variants and periodic runs: brute force, held-out rows, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.llm import language, periodic, queries, toxicity, variants

SYLLABLES = {
    "aa": "tion the ing and er of".split(),
    "bb": "sch ein und der ung ch".split(),
    "cc": "ción que los ado ñe el".split(),
}


def _text(lang, words, rng):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A folder with `documents`: three languages, odd texts, repeated and missing ids, clashing columns."""
    rng = random.Random(5)
    rows = [
        (i, _text(lang, rng.choice((2, 8, 60)), rng), lang)
        for i, lang in enumerate(rng.choices(list(SYLLABLES), k=500))
    ]
    rows += [(1000, "", "aa"), (1001, None, "aa"), (1002, "12 ² Ⅷ _ !", "bb"), (1003, "the the", None), (None, "der die", "bb")]
    rows += [(7, rows[7][1], rows[7][2])] * 3 + [(1004, "und" * 20_000, "bb"), (1005, "ein und " * 9_000, "bb")]
    folder = str(tmp_path_factory.mktemp("llm") / "t")
    spark.createDataFrame(
        [(*r, "s", 0, 0.5) for r in rows],
        "doc_id long, text string, lang string, source string, n int, word double",
    ).repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_language_of_held_out_texts(spark, documents):
    folder, rows = documents
    out = queries.op11(spark, folder).toPandas()
    assert len(out) == len(rows)
    assert [bool(h) for h in out["held_out"]] == [
        i == i and zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in out["doc_id"]
    ]
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1000}
    tried = out[out["held_out"] & out["doc_id"].isin(truth)]
    right = tried["lang_pred"] == tried["doc_id"].map(truth)
    assert right.mean() > 0.95 and right[tried["accepted"]].mean() > 0.97 and tried["accepted"].mean() > 0.5
    by = out.set_index("doc_id")
    assert (by.loc[[1000, 1001, 1002], "lang_pred"] == "und").all() and (by.loc[[1000, 1001, 1002], "score"] == 0).all()
    assert by.loc[1005, "lang_pred"] == "bb" and out["score"].between(0, 1).all()
    assert by.loc[7, "score"].nunique() == 1  # repeated rows


def test_language_learns_nothing_from_held_out_rows(spark, documents):
    docs = queries.table(spark, documents[0], "documents")
    spoilt = docs.withColumns(
        {
            "text": F.when(toxicity.held_out(F.col("doc_id")), F.lit("zz zz zz")).otherwise(F.col("text")),
            "lang": F.when(toxicity.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")),
        }
    )
    a, b = language.fit_on(docs), language.fit_on(spoilt.repartition(3))
    assert a.languages == b.languages == ["aa", "bb", "cc"]
    assert np.array_equal(a.table, b.table) and a.scale == b.scale and a.least == b.least


def test_language_without_rows_or_with_one_language(spark, documents):
    docs = queries.table(spark, documents[0], "documents")
    none = language.fit_on(docs.where("false"))
    told = docs.select(language.identified(spark, docs["text"], none).alias("l")).select("l.*")
    assert {r["lang_pred"] for r in told.collect()} == {"und"}
    assert docs.where("false").select(language.identified(spark, docs["text"], none)).count() == 0
    one = language.fit_on(docs.where("lang = 'aa'"))
    told = docs.select(language.identified(spark, docs["text"], one).alias("l")).select("l.*")
    assert {r["lang_pred"] for r in told.collect()} == {"und", "aa"}
    with pytest.raises(ValueError):
        language.fit_on(docs, most_languages=2)


def _near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def _groups(counts):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {
        w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()
    }


def _as_dict(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("most", [3, 20_000])
def test_variant_groups_equal_brute_force(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(400)}
    words |= {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    counts = {w: rng.choice((2, 3, 30, 40, 500, 700, 9000)) for w in sorted(words)}
    frame = spark.createDataFrame(
        [(w, n, "clash") for w, n in counts.items()], "word string, n long, form string"
    )
    assert _as_dict(variants.group_variants(frame, most=most)) == _groups(counts)


def test_pairs_are_found_once_in_whatever_partition():
    rng = random.Random(2)
    for _ in range(150):
        words = sorted({"".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(40)})
        found = [tuple(sorted(p)) for p in variants.near_pairs(words)]
        want = {(x, y) for i, x in enumerate(words) for y in words[i + 1 :] if _near(x, y)}
        assert len(found) == len(set(found)) and set(found) == want
        small = variants.Acceptor(words)
        signs = {(f, *sorted(m.items())) for f, m in zip(small.final, small.moves, strict=True)}
        assert len(signs) == len(small.moves)  # no two states are alike


def test_variants_query_on_odd_texts(spark, documents):
    folder, rows = documents
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    assert _as_dict(queries.op12(spark, folder)) == _groups({w: n for w, n in counts.items() if n >= 2})
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.counted_words(empty)).count() == 0


def _brute_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _tangled(rng):
    words = []
    while len(words) < rng.randint(0, 200):
        unit = [rng.choice("aab" if rng.random() < 0.5 else "abcde") for _ in range(rng.randint(1, 25))]
        words += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        texts = [_tangled(rng) for _ in range(rng.randint(1, 6))]
        for words, (runs, stays) in zip(texts, periodic.runs_of(texts), strict=True):
            want = _brute_runs(words)
            assert runs == want
            assert stays.tolist() == [
                not any(s + p <= i < s + n for s, n, p in want) for i in range(len(words))
            ]


def test_runs_of_long_texts_and_across_groups(monkeypatch):
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", 50)
    unit = [str(i) for i in range(3000)]
    [(runs, stays), (none, _)] = periodic.runs_of([unit * 6 + unit[:5], unit])
    assert runs == [(0, 18_005, 3000)] and stays.sum() == 3000 and none == []
    # Equal neighbours of two texts make no run together.
    assert [r for r, _ in periodic.runs_of([["a"] * 3, ["a"] * 3, [], ["a"] * 6])] == [[], [], [], [(0, 6, 1)]]


def test_periodic_query_equals_brute_force(spark, documents):
    folder, rows = documents
    got = {}
    for r in queries.op13(spark, folder).collect():
        got.setdefault(r["doc_id"], set()).add(
            (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])
        )
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = _brute_runs(words) if n < 10_000 else [(0, n, 2)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        told = "".join(f"{s},{n_},{p}\n" for s, n_, p in runs)
        gone = {k for s, n_, p in runs for k in range(s + p, s + n_)}
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        want = (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
        )
        assert want in got[i], i
    assert sum(any(v[0] for v in s) for s in got.values()) > 5


def test_periodic_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert periodic.with_repeats(empty).select(periodic.collapsed_runs(F.col("text"))).count() == 0
