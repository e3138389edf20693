"""Cases which earlier versions got wrong: hidden control strings, lost columns and rows, far workers."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

from pyspark.sql import functions as F

from tillspark.llm import chat, licenses, pii, quality, sharding, toxicity

REPO = str(Path(__file__).resolve().parents[2])


def test_control_strings_do_not_hide_in_two_parts(spark):
    part = "named_struct('kind', '{}', 'text', '{}', 'ref', NULL, 'units', NULL)"
    parts = [part.format("text", "a<"), part.format("text", "/s>b [/INST] c <"), part.format("text", "|image_0|> ["),
             part.format("image", ""), part.format("text", "/INST] <"), part.format("text", ""), part.format("text", "s>")]
    turns = spark.sql(
        f"""SELECT 1L AS conv_id, 0L AS turn, 'assistant' AS role, CAST(array({', '.join(parts)}) AS array<{chat.PART}>) AS parts
            UNION ALL SELECT CAST(NULL AS BIGINT), 3L, 'user', CAST(array() AS array<{chat.PART}>)
            UNION ALL SELECT CAST(NULL AS BIGINT), 3L, 'user', NULL"""
    )
    rows = {
        r["conv_id"]: r
        for r in chat.format_chats(turns)
        .select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("l"))
        .collect()
    }
    want = "a</s>b [/INST] c <|image_0|> [<|image_0|>/INST] <s>"
    assert [(t["role"], t["text"]) for t in rows[1]["t"]] == [("assistant", want)]
    assert rows[1]["l"] == want and rows[1]["formatted"].count("<|image_0|>") == 1
    assert [(t["role"], t["text"]) for t in rows[None]["t"]] == [("user", ""), ("user", "")]
    assert chat.format_chats(turns.where("false")).count() == 0


def test_many_turns_and_long_texts_keep_their_places(spark):
    turns = spark.range(3000).selectExpr(
        "1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat(concat('é<s>', id), id % 50) AS text"
    ).withColumn("parts", chat.text_part(F.col("text")))
    row = chat.format_chats(turns).select(
        chat.under_loss(F.col("formatted"), F.col("loss")).alias("l"), chat.read_back(F.col("formatted")).alias("t")
    ).first()
    told = [f"é<s>{i}" * (i % 50) for i in range(3000)]
    assert row["l"] == "".join(told[1::2]) and [t["text"] for t in row["t"]] == told


def test_no_input_column_is_lost(spark):
    names = ["_m", "_hash", "_id", "_cell", "_below", "_limits", "shard", "size"]
    docs = spark.createDataFrame(
        [(i, f"mail a{i}@b.cd now please dear friend of mine and yours", *[f"{n}{i}" for n in names]) for i in range(50)],
        "doc_id long, text string, " + ", ".join(f"{n} string" for n in names),
    )
    before = {r["doc_id"]: r for r in docs.collect()}
    for out in (
        sharding.shard(docs, 4),
        quality.assess(docs, quality.LineModel.keep_all()),
        pii.find(docs),
    ):
        rows = out.collect()
        assert len(rows) == 50
        for r in rows:
            assert all(r[n] == before[r["doc_id"]][n] for n in docs.columns)


def test_licence_findings_are_those_of_each_row(spark):
    mit = dict(licenses.LICENSES[:1])["MIT"]
    notice = next(t for n, t in licenses.LICENSES if n == "CC-BY-4.0")
    docs = spark.createDataFrame(
        [(None, "x\n" + notice), (None, "plain"), (5, mit), (5, "plain"), (5, "y\n" + notice)], "doc_id long, text string"
    )
    table = spark.createDataFrame(list(licenses.LICENSES), "license string, text string")
    for known in (licenses.LICENSES, table):
        rows = [(r["doc_id"], r["license"], r["notices"]) for r in licenses.scan(docs, licenses=known).collect()]
        assert sorted(rows, key=str) == sorted(
            [(None, None, "CC-BY-4.0"), (None, None, ""), (5, "MIT", ""), (5, None, ""), (5, None, "CC-BY-4.0")], key=str
        ) or ("MIT" in {r[1] for r in rows} and rows.count((None, None, "CC-BY-4.0")) == 1 and rows.count((5, None, "CC-BY-4.0")) == 1)


def test_fits_of_repeated_ids_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"good words number {i} here") for i in range(20)] + [(i, f"{k}###!! bad$$$ {i} insult") for i in range(20, 40) for k in range(3)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(i, int(i < 20), int(i >= 20)) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    a, b = (quality.fit_line_model(d, labels) for d in (docs, docs.orderBy(F.desc("text")).repartition(5)))
    assert (a.weights == b.weights).all() and (a.transitions == b.transitions).all()
    s, t = (toxicity.fit_on(d, labels) for d in (docs, docs.orderBy(F.desc("text")).repartition(5)))
    assert s.slope == t.slope and all((s.weights[k] == t.weights[k]).all() for k in s.weights)
    assert len(toxicity.fit_on(docs.where("false"), labels).row_of) == 0


def test_many_hits_take_linear_time(spark):
    import time

    docs = spark.createDataFrame([(1, "a.b@c.de x " * 40_000)], "doc_id long, text string")
    found = pii.find(docs).select(F.size("_spans").alias("n"), F.length(pii.redacted(F.col("text"), F.col("_spans"))).alias("k"))
    start = time.time()
    row = found.first()
    assert row["n"] == 40_000 and row["k"] == 10 * 40_000
    assert time.time() - start < 30  # a quadratic form took minutes


def test_workers_need_not_have_the_package(tmp_path):
    """A session started from an empty folder, whose workers cannot import the package."""
    script = textwrap.dedent(
        f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").config("spark.sql.warehouse.dir", {str(tmp_path / 'w')!r}).getOrCreate())
        import __spark_entry__ as entry
        for name in ("op1_toxicity", "op8_sentencepiece", "op11_language", "op12_variants", "op13_periodic_runs"):
            assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
        import corpus_pipeline
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 20
        from tillspark.operators import boosting
        rows = spark.createDataFrame([(0, [float(i)], float(i > 30)) for i in range(60)], "fit int, x array<double>, y double")
        assert len(boosting.fit_many(rows, {{0: {{"trees": 2}}}})[0].trees) == 2
        print("all ran")
        """
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    here = tmp_path / "empty"
    here.mkdir()
    (tmp_path / "run.py").write_text(script)
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and REPO not in p]
    env["PYTHONPATH"] = os.pathsep.join(kept)
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], cwd=here, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]
