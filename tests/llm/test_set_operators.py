"""Near-duplicates, mixing, sharding, chats and the pipeline against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tillspark.llm import chat, components, lattice, mixing, queries, sharding, simhash


def _components(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("per_salt", [7, 100_000])
def test_components_of_a_chain_a_star_and_nothing(spark, monkeypatch, per_salt):
    monkeypatch.setattr(components, "LINKS_PER_SALT", per_salt)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(frame).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}
    assert components.components(frame.where("false")).count() == 0


def _plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else (
        [b" ".join(words)] if words else []
    )
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs_of, odd, empty):
    random.seed(2)
    base = [[f"w{random.randrange(50)}" for _ in range(120)] for _ in range(12)]
    texts = []
    for words in base:
        for edits in range(6):
            changed = list(words)
            for _ in range(edits):
                changed[random.randrange(120)] = "new"
            texts.append(" ".join(changed))
    docs = docs_of(list(enumerate(texts + ["", None, "One", "ONE"]))).union(odd.where("doc_id > 2"))
    rows = docs.collect()
    prints = [_plain_fingerprint(r["text"]) for r in rows]
    pairs = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if bin(prints[i] ^ prints[j]).count("1") <= 3
    ]
    label = _components(len(rows), pairs)
    least = defaultdict(list)
    for r, group in zip(rows, label, strict=True):
        if r["doc_id"] is not None:
            least[group].append(r["doc_id"])
    want = sorted(
        (str(r["doc_id"]), p, min(least[g])) for r, p, g in zip(rows, prints, label, strict=True)
    )
    got = sorted(
        (str(r["doc_id"]), r["simhash"] % 2**64, r["component_id"])
        for r in simhash.near_duplicates(docs).collect()
    )
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_hamming_links_for_any_segments(spark, segments):
    random.seed(segments)
    values = [random.getrandbits(64) for _ in range(6)]
    values += [v ^ sum(1 << b for b in random.sample(range(64), k)) for v in values for k in range(1, 5)]
    values = sorted({v - 2**63 for v in values})
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    radius = 3
    got = {frozenset((r["a"], r["b"])) for r in simhash.hamming_links(frame, "v", radius, segments).collect()}
    near = lambda a, b: bin((a ^ b) % 2**64).count("1") <= radius
    assert got == {frozenset((a, b)) for a in values for b in values if a < b and near(a, b)}


def test_e8_is_decoded_exactly():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    near = lattice.nearest_e8(x)
    steps = lattice.shortest_e8()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    assert np.allclose(near.sum(1) % 2, 0)
    around = near[:, None] + steps
    assert (((x[:, None] - around) ** 2).sum(-1) >= ((x - near) ** 2).sum(-1)[:, None] - 1e-9).all()


def test_lattice_links_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 32))
    near = base + 0.03 * rng.normal(size=base.shape)
    vectors = [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, near)))]
    vectors += [(200, vectors[0][1]), (201, [0.0] * 32), (202, None), (203, [1.0, None]), (204, [])]
    vectors += [(205, [float("nan")] * 32), (206, [float("inf")] * 32), (None, vectors[0][1]), (207, [1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(frame).collect()}
    assert len(got) == len(vectors)
    for i in range(1, 40):
        assert got[i]["n_links"] == 1 and got[40 + i]["component_id"] == i and got[i]["kept"]
    assert got[0]["n_links"] == 2 and got[200]["component_id"] == 0 and not got[200]["kept"]
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (201, 202, 203, 204, 205, 206, 207, None))
    assert lattice.measured_recall(frame, queries=30) == 1.0
    assert lattice.near_duplicates(frame.where("false")).count() == 0


def test_mixing_meets_targets_and_repeats_itself(spark):
    random.seed(4)
    rows = [(i, random.choice(["a", "b", "c", None]), random.randint(0, 400)) for i in range(3000)]
    rows += [(5000 + i, "tiny", 3) for i in range(4)] + [(6000, "none", 0), (6001, "n", None), (1, "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    first, second = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert first == second
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.mix(docs).collect():
        assert 0 <= r["copies"] <= 3
        by[r["source"]][0] += r["copies"] * r["size"]
        by[r["source"]][1:] = [r["target"], r["source_size"]]
    total = sum(s for _, _, s in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6 * total
    for taken, target, size in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= max(5, 0.002 * target)
    assert mixing.mix(docs.where("false")).count() == 0


def test_balance_keeps_a_mean(spark):
    random.seed(6)
    rows = [(i, "ab"[i % 2], 50 + i % 7, float(i % 5)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, z double")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    lams, mu = mixing.balance(docs, mixing.source_targets(sizes, (1, 2)), {"z": 2.6})
    lam = {r["source"]: r for r in lams.collect()}
    q = [(s, z, n * np.exp(lam[s]["lam"] + mu["z"] * (z - 2.6))) for _, s, n, z in rows]
    for s in "ab":
        assert abs(sum(w for t, _, w in q if t == s) - lam[s]["target"]) < 1e-4
    assert abs(sum(z * w for _, z, w in q) / sum(w for _, _, w in q) - 2.6) < 1e-6


def test_shards_are_even_gapless_and_cut_hot_groups(docs_of, odd, empty):
    random.seed(8)
    rows = [(i, "x" * random.randint(0, 300)) for i in range(900)]
    rows += [(10_000 + i, "the same text " * 10) for i in range(500)] + [(20_000, None)]
    out = sharding.shard(docs_of(rows), 8).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        size[r["_shard"]] += r["_size"]
        slots[r["_shard"]].append(r["_slot"])
    share = sum(size.values()) / 8
    assert set(size) == set(range(8)) and max(abs(v - share) for v in size.values()) < 400
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(odd, 3).count() == odd.count() and sharding.shard(empty, 3).count() == 0


def test_chats_read_back(spark):
    random.seed(9)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<|", "\\", "<\\s>", "<", "[", "/s>", "|", "x\n", "é", "🙂"]
    rows = [
        (i // 3, i % 3, ("user", "assistant", "s</s>")[i % 3],
         "".join(random.choice(parts) for _ in range(random.randint(0, 10))) or None)
        for i in range(900)
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text")))).select(
        "conv_id",
        chat.read_back(F.col("formatted")).alias("t"),
        chat.under_loss(F.col("formatted"), F.col("loss")).alias("l"),
    )
    for r in out.collect():
        mine = rows[3 * r["conv_id"] : 3 * r["conv_id"] + 3]
        assert [(t["role"], t["text"]) for t in r["t"]] == [(m[2], m[3] or "") for m in mine]
        assert r["l"] == (mine[1][3] or "")


def test_chat_parts_leave_placeholders_and_references(spark):
    turns = spark.sql(
        f"""SELECT 1L AS conv_id, 0L AS turn, CAST(NULL AS STRING) AS role, CAST(array(
              named_struct('kind', 'image', 'text', NULL, 'ref', 'a.png', 'units', 2D),
              named_struct('kind', 'text', 'text', 'see <|image_0|>', 'ref', NULL, 'units', NULL),
              named_struct('kind', 'audio', 'text', NULL, 'ref', 'b.wav', 'units', 1.5D),
              named_struct('kind', 'video', 'text', 'no', 'ref', 'c', 'units', NULL), NULL
            ) AS array<{chat.PART}>) AS parts
            UNION ALL SELECT 1L, 1L, 'user', NULL"""
    )
    row = chat.format_chats(turns).first()
    assert row["formatted"].startswith("<s>[INST][/INST]<|image_0|>see <\\|image_0|><|audio_1|></s>")
    assert [(a["attachment"]["kind"], a["attachment"]["tokens"]) for a in row["attachments"]] == [
        ("image", 512), ("audio", 38)
    ]
    assert row["expanded_tokens"] == 550


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    for docs in (odd.drop("size"), empty.drop("size")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "sentencepiece":
                assert out.columns == docs.columns
            assert out.count() <= 3 * docs.count()


def test_pipeline_drops_near_copies_and_personal_data(spark, docs_of, tmp_path):
    body = " ".join(f"word{i}" for i in range(80))
    docs = docs_of([(1, body), (2, body), (3, "mail me at a.b@example.com " + body[::-1]), (4, "short")])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4]
    texts = corpus_pipeline.redact_personal_data(spark, docs, "").where("doc_id = 3").first()
    assert "<email>" in texts["text"] and texts["n_chars"] == len(texts["text"])


def test_pipeline_keeps_one_row_of_every_group_and_mixes_rows_not_ids(spark, docs_of):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in ("ab", "lorem", "17x", "zeta"))
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c), (None, a), (None, d), (None, d, "t")]
    kept = corpus_pipeline.drop_near_copies(spark, docs_of([*rows, (1, b)]), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, a), (1, b), (0, c), (0, d)])
    sized = [
        (i, " ".join(f"w{i}{s}{j}" for j in range(n)), s) for s in "stu" for i in range(20) for n in (10, 30)
    ]
    for docs in (sized, [*sized[:-1], sized[-3]]):  # the second with two equal rows
        mixed = corpus_pipeline.mix_sources(spark, docs_of(docs), "").collect()
        for source, target in (("s", 400), ("t", 800), ("u", 1200)):
            assert abs(sum(len(r["text"].split()) for r in mixed if r["source"] == source) - target) <= 10


def test_every_operator_is_registered():
    names = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}
    assert names == set(range(1, 14)) and "pipeline" in queries.QUERIES
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
