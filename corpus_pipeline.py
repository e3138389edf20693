"""A training-corpus pipeline over `documents`: five stages, each one operator of tillspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import mixing, pieces, pii, quality, simhash
from tillspark.llm.queries import vocabulary
from tillspark.llm.scratch import free_names, keep, row_key, table, text_of, word_count


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents which the base rules or the line field reject go."""
    model = quality.fit_line_model(docs, table(spark, sf_dir, "labels"))
    [verdict] = free_names(docs, "_quality")
    return quality.assess(docs, model, out=verdict).where(F.col(verdict)["kept"]).select(docs.columns)


def _chosen_rows(docs: DataFrame, chosen: DataFrame, also: dict[str, str] | None = None) -> DataFrame:
    """Rows of docs with a key in the written table `chosen` (_key, _rows, ...); equal rows once.

    `also` names further columns of `chosen` to keep, and what they are called in the result.
    """
    key, rows = free_names(docs, "_key", "_rows")
    names = {"_key": key, "_rows": rows, **(also or {})}
    wanted = chosen.select(*[F.col(old).alias(new) for old, new in names.items()])
    # One plan for every size: the keys grow with the documents, so they are never broadcast.
    joined = docs.withColumn(key, row_key(docs)).join(wanted.hint("merge"), key)
    once = joined.where(F.col(rows) == 1).union(joined.where(F.col(rows) > 1).dropDuplicates([key]))
    return once.select(*docs.columns, *(also or {}).values())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group one row stays, that with the smallest id; null ids come last.

    Rows of different groups which share an id, or have none, stay in one row for each group.
    """
    chosen = keep(simhash.representatives(docs), "chosen")
    return _chosen_rows(docs, chosen)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span found is replaced by its kind; n_chars follows the new text."""
    [spans] = free_names(docs, "_spans")
    found = pii.find(docs, out=spans)
    changed = found.withColumn("text", pii.redacted(text_of(docs), F.col(spans)))
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(
        docs.columns
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its rounded rate says; sources meet their targets.

    Rows are told apart by all their columns, so those which share an id have each their own copies.
    """
    sized = docs.select(row_key(docs).alias("doc_id"), "source", word_count(text_of(docs)).alias("size"))
    mixed = mixing.mix(sized).groupBy(F.col("doc_id").alias("_key")).agg(
        F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_rows")
    )
    [copies] = free_names(docs, "_copies")
    taken = _chosen_rows(docs, keep(mixed.where("_copies > 0"), "copies"), {"_copies": copies})
    each = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return taken.select(*docs.columns, each).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: number and digest of the ids of every document, and of the decoded text."""
    both = docs.select(
        "doc_id", "lang", "source", pieces.round_trip(spark, docs["text"], vocabulary()).alias("p")
    )
    return both.select(
        "doc_id",
        "lang",
        "source",
        pieces.token_count(F.col("p.ids")).alias("n_tokens"),
        F.sha2("p.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("p.text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good_text),
    ("near-dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: No stage but the mixing could be told in SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
