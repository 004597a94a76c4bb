"""The numbered queries: each applies one operator to its whole table. ORACLE has SQL where SQL can express one."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import mixing, sql
from ridgeline.session import ship

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ship(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_best_fit_packing(spark, d):
    from ridgeline.llm import packing

    return packing.pack(table(spark, d, "documents"), tokenizer(), capacity=2048)


@query
def op3_quality_trees(spark, d):
    from ridgeline.llm import quality

    out = quality.assess(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")


@query
def op5_language_ftrl(spark, d):
    from ridgeline.llm import langid
    from ridgeline.llm.common import crc_fold

    held_out = crc_fold(F.col("doc_id"), 4) == 2
    found = langid.identify(table(spark, d, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op6_toxicity_ordinal(spark, d):
    from ridgeline.llm import toxicity

    return toxicity.assess(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op10_minhash_components(spark, d):
    from ridgeline.llm import minhash

    return minhash.deduplicate(table(spark, d, "documents"), percent=85)


#: Target weights of the sources, in the order of their numbers; any other source has OTHER_WEIGHT.
WEIGHTS = {f"src{k}": float(1 + k % 5) for k in range(20)}
OTHER_WEIGHT = 1.0


@query
def op7_poisson_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), WEIGHTS, OTHER_WEIGHT).drop("rate")


ORACLE["op7_poisson_mix"] = mixing.mix_sql(WEIGHTS, OTHER_WEIGHT)


@query
def op9_line_dedup(spark, d):
    from ridgeline.llm import lines

    return lines.deduplicate(table(spark, d, "documents"), percent=80).select("doc_id", "text", "n_lines", "n_removed")


@query
def op4_pivot_links(spark, d):
    from ridgeline.llm import pivots

    return pivots.link(table(spark, d, "embeddings"), least=0.95)


@query
def op1_context_tree(spark, d):
    from ridgeline.llm import ctw
    from ridgeline.llm.common import crc_fold

    held_out = crc_fold(F.col("doc_id"), 7) == 2
    found = ctw.evaluate(table(spark, d, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_bwt_substrings(spark, d):
    from ridgeline.llm import substrings

    out = substrings.deduplicate(table(spark, d, "documents"), least=50)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_phrase_cycles(spark, d):
    from ridgeline.llm import phrases

    return phrases.mine(table(spark, d, "documents"), least=30, longest=4, covered=80, most=2000)


@query
def op12_binary_packing(spark, d):
    from ridgeline.llm import binary_packing

    return binary_packing.pack(table(spark, d, "documents"), tokenizer("byte_bpe_50k.json"), longest=1024)


@query
def op13_bond_negatives(spark, d):
    from ridgeline.llm import negatives

    label = F.col("label").cast("long")
    vectors = table(spark, d, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3)


ORACLE["op11_phrase_cycles"] = sql.PHRASES
ORACLE["op13_bond_negatives"] = sql.NEGATIVES
ORACLE["op4_pivot_links"] = sql.VECTOR_LINKS
ORACLE["op9_line_dedup"] = sql.LINES
ORACLE["op10_minhash_components"] = sql.NEAR_COPIES
