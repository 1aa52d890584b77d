"""A corpus pipeline of five stages, each written as Parquet and read by the next.

Toxic documents go, then exact copies, then near copies; what stays is laid out as a
mixture of its sources and encoded to token ids. Null texts count as empty everywhere:
they score as harmless, are copies of each other, and encode to no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsieve.llm import byte_bpe, exact, jaccard, mixing, toxicity
from postsieve.llm.common import cut, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Sources count in the mixture as their rows to this power: below 1, small ones come earlier.
MIX_POWER = 0.7
# Near copies share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
BROADCAST_IDS = 1_000_000
PARTS = 256  # of rows that share one id and source


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut go; the model is fitted on labelled rows."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), "text")
    return toxicity.with_scores(rows, model).filter(F.col("score") < toxicity.CUT).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link, the one with the smallest id stays.

    Each row is a document of its own: where ids repeat or are null, rows are compared under
    numbers in the order of their ids, null first, so that a row never goes for what another
    row of its id says. Rows without words stay. An empty table stays empty.
    """
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1)
    if odd.isEmpty():
        rows = docs.select(F.struct("*").alias("row"), "text", F.col("doc_id").cast("long").alias("at"))
    else:
        told = docs.select(F.struct("*").alias("row"), "text", "doc_id", F.xxhash64("text").alias("version"))
        sorted_rows = told.repartitionByRange("doc_id", "version").sortWithinPartitions("doc_id", "version")
        rows = cut(sorted_rows.select("row", "text", F.monotonically_increasing_id().alias("at")))
    linked = jaccard.join_documents(rows, id_col="at", k=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = cut(linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("at")))
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(few, "at", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows and files in the order of the mixture."""
    weights = mixing.proportional(docs, power=MIX_POWER)
    if not weights:
        return docs
    return mixing.in_mixed_order(spark, mixing.mix_sources(docs, weights)).select(*docs.columns)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_slot and mix_place. Ids and sources alone are numbered and then
    joined. Rows that share id and source have no order of their own: each gets one of the
    places that belong to them, dealt by a count within each part of the rows and the place
    where that part's count begins, so that no task holds them all."""
    weights = mixing.proportional(docs, power=MIX_POWER)
    if not weights:
        return docs.withColumns({"mix_slot": F.lit(None).cast("long"), "mix_place": F.lit(None).cast("int")})
    numbered = mixing.mix_sources(docs.select("doc_id", "source"), weights)
    source = F.coalesce("source", F.lit(""))
    places = cut(numbered.select(F.col("doc_id").alias("id"), source.alias("of"), "mix_slot", "mix_place"))
    own = [c for c in docs.columns if c not in ("mix_slot", "mix_place")]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("row_id"), source.alias("row_of"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_of") == F.col("of"))
    repeated = cut(places.groupBy("id", "of").count().filter("count > 1 or id is null").select("id", "of"))
    if repeated.isEmpty():
        few = F.broadcast(places) if places.count() <= BROADCAST_IDS else places
        return rows.join(few, same).select("row.*", "mix_slot", "mix_place")
    again = repeated.withColumnsRenamed({"id": "again_id", "of": "again_of"})
    is_again = lambda i, o: F.col(i).eqNullSafe(F.col("again_id")) & (F.col(o) == F.col("again_of"))
    single = rows.join(again, is_again("row_id", "row_of"), "left_anti").join(places, same).select("row.*", "mix_slot", "mix_place")
    left = _counted(rows.join(again, is_again("row_id", "row_of"), "left_semi"), "row_id", "row_of")
    right = _counted(places.join(again, is_again("id", "of"), "left_semi"), "id", "of")
    right = right.withColumnRenamed("nth", "mth")
    dealt = left.join(right, same & (F.col("nth") == F.col("mth"))).select("row.*", "mix_slot", "mix_place")
    return single.union(dealt)


def _counted(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``nth``, from 1 within each key, which may be null: rows are counted in
    parts by a number of their own, and each part begins where the parts before it end."""
    rows = cut(rows.withColumn("own", F.monotonically_increasing_id())).withColumn("part", F.pmod(F.xxhash64("own"), F.lit(PARTS)))
    sizes = rows.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select(*[F.col(k).alias(f"{k}_") for k in key], F.col("part").alias("part_"), before.alias("before"))
    within = F.row_number().over(W.partitionBy(*key, "part").orderBy("own"))
    same = (F.col("part") == F.col("part_")) & F.col(f"{key[0]}_").eqNullSafe(F.col(key[0])) & (F.col(f"{key[1]}_") == F.col(key[1]))
    return rows.withColumn("within", within).join(begins, same).withColumn("nth", F.col("within") + F.col("before")).drop(
        "own", "part", "part_", "within", "before", *[f"{k}_" for k in key]
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian uint32) in place of the text, digests of the
    ids and of what decodes from them, and the document's slot and place in the mixture.

    The mixture follows from ids and sources alone, so it is computed here again: files
    that are read back come in no certain order.
    """
    import public_tokenizers

    blob = byte_bpe.rank_file(public_tokenizers.path(VOCABULARY))
    out = byte_bpe.encode_texts(placed(docs), blob, public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "mix_slot", "mix_place")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix),
    ("encode", encode),
]

# The fitted model, the schedule and the codec are not SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
