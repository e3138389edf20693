"""The registered queries of the subpackage, and the DuckDB twins of those which SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import (
    chat,
    language,
    lattice,
    licenses,
    mixing,
    periodic,
    pieces,
    pii,
    quality,
    sharding,
    simhash,
    toxicity,
    variants,
)
from tillspark.llm.scratch import table, text_of, word_count

# Python workers need not have the package installed: its functions travel with the task.
for _module in (language, lattice, periodic, pieces, quality, simhash, toxicity, variants):
    cloudpickle.register_pickle_by_value(_module)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(job):
        QUERIES[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return keep


def _of_kind(name: str):
    return lambda span: span["kind"] == name


def vocabulary() -> pieces.Vocabulary:
    """The public 32k model; its path is a parameter of `Vocabulary.load`."""
    import public_tokenizers

    return pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


@register("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return (
        docs.select("doc_id", toxicity.scored(spark, docs["text"], model).alias("_t"))
        .select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "_t.*")
        .withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
    )


@register("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.base_only(F.col("_spans"))
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("_spans", _of_kind(k.name))).cast("long").alias(f"n_{k.name}")
            for k in pii.BASE
        ],
        F.sha2(pii.named(base), 256).alias("base_sha256"),
        pii.named(F.col("_spans")).alias("spans"),
    )


@register("op3_lattice")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_line_model(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model).select("doc_id", "_quality.*")


@register("op5_chat")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in stored.schema}
    rows = F.array(
        *[F.struct(F.lit(t).alias("turn"), F.lit(r).alias("role")) for t, r in ((0, "user"), (1, "assistant"))]
    )
    probe = spark.range(1).select(F.inline(rows)).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("turn").cast(kinds["turn"]),
        "role",
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = stored.union(probe).withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chats(turns).withColumns(
        {
            "turns": chat.read_back(F.col("formatted")),
            "learned": chat.under_loss(F.col("formatted"), F.col("loss")),
        }
    )
    line = F.lit("\n")
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), ""
    )
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


@register("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", word_count(text_of(docs)).alias("size"))
    return mixing.mix(sizes).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


@register("op7_licenses", licenses.scan_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = table(spark, sf_dir, "documents"), vocabulary()
    both = docs.select("doc_id", pieces.round_trip(spark, docs["text"], known).alias("_p")).select(
        "doc_id", "_p.*"
    )
    return both.select(
        "doc_id",
        pieces.token_count(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@register("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@register("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    checked = docs.withColumn("text_crc32", F.crc32(text_of(docs).cast("binary")))
    return sharding.shard(checked, 40).select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op11_language")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_on(docs)
    return docs.select("doc_id", language.identified(spark, docs["text"], model).alias("_l")).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "_l.*"
    )


@register("op12_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.group_variants(variants.counted_words(docs))


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", periodic.collapsed_runs(F.col("text")).alias("_r")).select(
        "doc_id", "_r.*", periodic.strongest(F.col("_r.runs")).alias("_best")
    )
    told = F.array_join(
        F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n", None
    )
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.*",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
