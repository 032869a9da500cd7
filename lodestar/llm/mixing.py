"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents are spread over shards by a seeded hash. Inside a shard, each source's documents, in
the order of that hash, form a token stream that is cut into blocks of ``block_tokens``. A shard
hands out ``keep_fraction`` of its blocks, rounded up, to sources by the highest quotients
``weight / (2k + 1)``, never more than a source has; that gives integer quotas. The blocks that
fill a source's quota are those whose own seeded hash is lowest, and a document goes where the
block in which it ends goes.

Everything is grouped by shard, so no step holds more than a shard's blocks in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestar.llm.textutil import unused
from lodestar.runtime import cut

SEED = 17
BLOCK_TOKENS = 1024
SHARD_TOKENS = 1 << 20
KEEP_FRACTION = 0.75
#: What counts as a token here: a run of characters other than blank, tab and line ends.
TOKEN = "[^ \\t\\n\\r]+"


def _hash32(col):
    return F.conv(F.substring(col, 1, 8), 16, 10).cast("bigint")


def assign_blocks(docs: DataFrame, *, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(doc_id, source, n_tokens, shard, block)`` of every row.

    Nulls: a null text has no tokens, a null source is the source ``''``, null ids share one hash.
    Rows of one id and source tie and share a block. An empty table gives no rows.
    """
    spark = docs.sparkSession
    t = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(TOKEN)), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    )
    t = cut(t)  # texts are read once; what follows needs 60 bytes a row
    total = t.agg(F.greatest(F.lit(1), F.ceil(F.sum("n_tokens") / F.lit(shard_tokens))).cast("bigint").alias("n_shards"))
    n_shards = (total.first() or [1])[0] or 1
    t = t.withColumn("shard", F.pmod(_hash32(F.col("h")), F.lit(n_shards)))
    upto = F.sum("n_tokens").over(W.partitionBy("shard", "source").orderBy("h").rangeBetween(W.unboundedPreceding, W.currentRow))
    return t.withColumn("block", F.floor(F.greatest(upto - 1, F.lit(0)) / F.lit(block_tokens)).cast("bigint")).drop("h")


def weights_of(blocks: DataFrame) -> DataFrame:
    """Default weights: the square root of a source's share of tokens, as whole millionths, 1 at least."""
    by = blocks.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    total = by.agg(F.sum("tokens").alias("all"))
    return by.crossJoin(F.broadcast(total)).select(  # one row
        "source", F.greatest(F.lit(1), F.floor(F.lit(1e6) * F.sqrt(F.col("tokens") / F.greatest(F.col("all"), F.lit(1.0))))).cast("double").alias("weight")
    )


def quotas(blocks: DataFrame, weights: DataFrame | None = None, *, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, keep_fraction: float = KEEP_FRACTION) -> DataFrame:
    """``(shard, source, block)`` of the blocks that are chosen. Equal quotients go to the lesser source name."""
    have = blocks.groupBy("shard", "source").agg(F.ceil(F.sum("n_tokens") / F.lit(block_tokens)).cast("bigint").alias("blocks"))
    have = have.withColumn("blocks", F.greatest(F.col("blocks"), F.lit(1)))
    if weights is None:
        weights = weights_of(blocks)
    else:
        weights = weights.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.max(F.col("weight").cast("double")).alias("weight")).filter("weight > 0 and not isnan(weight)")
    have = have.join(weights, "source")
    each = have.select("shard", "source", "weight", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    each = each.withColumn("quotient", F.col("weight") / (2 * F.col("block") + 1)).withColumn(
        "h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("shard").cast("string"), F.col("source"), F.col("block").cast("string")))
    )
    shard = W.partitionBy("shard")
    each = each.withColumn("won", F.row_number().over(shard.orderBy(F.desc("quotient"), "source", "block")) <= F.ceil(F.count(F.lit(1)).over(shard) * F.lit(keep_fraction)))
    own = W.partitionBy("shard", "source")
    each = each.withColumn("quota", F.sum(F.col("won").cast("int")).over(own)).withColumn("rank", F.row_number().over(own.orderBy("h", "block")))
    return each.filter("rank <= quota").select("shard", "source", "block")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, keep_fraction: float = KEEP_FRACTION) -> DataFrame:
    """``(doc_id, source, n_tokens, shard, block)`` of the chosen rows; nulls and ties as in assign_blocks.

    ``weights``, if given, holds ``(source, weight double)``; a source without a weight above 0 isn't
    chosen, and of several weights of a source the greatest counts. Texts have no greatest length;
    an empty table gives no rows; columns besides doc_id, source and text aren't read.
    """
    blocks = assign_blocks(docs, seed=seed, block_tokens=block_tokens, shard_tokens=shard_tokens)
    return blocks.join(quotas(blocks, weights, seed=seed, block_tokens=block_tokens, keep_fraction=keep_fraction), ["shard", "source", "block"], "left_semi").select("doc_id", "source", "n_tokens", "shard", "block")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with all their columns, whatever their names.

    Rows of one id and source stay or go together.
    """
    id_, source = unused(docs.columns, "mixed_id"), unused(docs.columns, "mixed_source")
    ids = mix(docs).select(F.col("doc_id").alias(id_), F.col("source").alias(source)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.coalesce(F.col("source"), F.lit("")) == F.col(source))
    return docs.join(ids, same, "left_semi")


ORACLE = f"""
with t as (
  select doc_id, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::bigint as n_tokens,
         md5('{SEED}:' || coalesce(doc_id::varchar, '')) as h
  from documents),
s as (select *, ('0x' || substr(h, 1, 8))::bigint % (select greatest(1, ceil(sum(n_tokens) / {SHARD_TOKENS}))::bigint from t) as shard from t),
b as (select *, floor(greatest(sum(n_tokens) over (partition by shard, source order by h range between unbounded preceding and current row) - 1, 0) / {BLOCK_TOKENS})::bigint as block from s),
w as (select source, greatest(1, floor(1e6 * sqrt(sum(n_tokens)::double / greatest((select sum(n_tokens) from t)::double, 1))))::double as weight from t group by source),
a as (select shard, source, greatest(1, ceil(sum(n_tokens) / {BLOCK_TOKENS}))::bigint as blocks from b group by shard, source),
e as (select shard, source, weight, unnest(range(blocks)) as block from a join w using (source)),
q as (select *, row_number() over (partition by shard order by weight / (2 * block + 1) desc, source, block) <= ceil(count(*) over (partition by shard) * {KEEP_FRACTION}) as won from e),
r as (select *, sum(won::int) over (partition by shard, source) as quota,
             row_number() over (partition by shard, source order by md5('{SEED}:' || shard || ':' || source || ':' || block), block) as rank from q)
select b.doc_id, b.source, b.n_tokens, b.shard, b.block from b semi join (select * from r where rank <= quota) r on b.shard = r.shard and b.source = r.source and b.block = r.block
"""
