"""Mixing sources to target shares of tokens.

Every document of a source is taken its certain whole number of times; the rest of the source's share is a fixed-size
sample drawn by Pareto order sampling: documents rank by their random odds divided by their inclusion odds, and the
first are in, up to the wanted number of tokens. Where that is reached is found from the tokens of rank buckets, so that
no source is ever sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.arrow import flat_map
from inkwell.session import cut_lineage

#: Where the vocabulary lies unless told otherwise, and the pattern it splits text by (a fixed value of the vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rank buckets of a source. A source of n documents sorts about n / BUCKETS of them in one task.
BUCKETS = 4096


def source_name(source: Column | str) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of documents(doc_id, source, text). Null and empty texts have 0 tokens; null source stays.

    vocabulary is read on the driver and sent to every task; its size is that of the file.
    """
    with open(vocabulary, "rb") as lines:
        content = documents.sparkSession.sparkContext.broadcast(lines.read())

    def start():
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.value.splitlines() if line.strip())}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def work(doc_id: int | None, source: str | None, text: str | None) -> Iterable[tuple]:
            yield doc_id, source, len(encoding.encode_ordinary(text)) if text else 0

        return work

    counted = flat_map(documents, ["doc_id", "source", "text"], start, "doc_id bigint, source string, tokens bigint")
    return counted.select("doc_id", source_name("source").alias("source"), "tokens")


def allocate(counted: DataFrame, targets: DataFrame, exact: bool = False) -> DataFrame:
    """One row per source of targets(source, target_share, max_repeats): what it has, what it is asked for, its copies.

    wanted is its share of as many tokens as all documents together, of whatever source; short says that even max_repeats
    copies hold fewer tokens than that. copies = size / tokens, at most max_repeats, where size is wanted or, if exact,
    the source's share of the largest total in which the sources that aren't short keep their shares: the short ones,
    all they have, then make up the rest of it together. If these hold no tokens at all there is no such total, and size
    is wanted. A source named repeatedly has the sum of its shares and the largest of its max_repeats; one without
    documents has 0 tokens and copies. Null sources, shares or max_repeats count as absent, 0 and 0.
    """
    share = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    share = share.groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    # written once: both uses below would else count all tokens anew
    have = cut_lineage(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    most = F.col("tokens") * F.col("max_repeats")
    rows = share.join(have, "source", "left").na.fill(0, ["tokens", "documents"]).crossJoin(F.broadcast(total))
    rows = rows.withColumn("wanted", F.col("target_share") * F.col("all_tokens")).withColumn("short", most < F.col("wanted"))
    size = F.col("wanted")
    if exact:
        left = F.lit(1.0) - F.coalesce(F.sum(F.when(~F.col("short"), F.col("target_share"))), F.lit(0.0))
        whole = rows.agg(F.sum(F.when(F.col("short"), most)).alias("held"), left.alias("left"))
        rows = rows.crossJoin(F.broadcast(whole))
        scaled = F.col("target_share") * F.col("held") / F.col("left")
        size = F.when((F.col("held") > 0) & (F.col("left") > 0) & ~F.col("short"), F.least(F.col("wanted"), scaled)).otherwise(F.col("wanted"))
    copies = F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), size / F.col("tokens"))).otherwise(0.0)
    return rows.withColumn("copies", copies).drop("held", "left")


def inclusion_scale(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """source, scale: the odds of inclusion are least(1, scale * weight), and their sum of tokens is the source's rest.

    documents(source, tokens, weight), plan(source, rest). What the certain documents leave over is shared out among
    the others again until no more become certain: each round is an aggregate with a row per source. A source whose
    positive weights hold too few tokens takes them all.
    """
    scale = cut_lineage(plan.select("source", "rest", F.lit(0.0).alias("scale")))
    while True:
        near = documents.where("weight > 0").join(F.broadcast(scale), "source")
        sure = F.col("scale") * F.col("weight") >= 1
        sums = near.groupBy("source", "rest", "scale").agg(
            F.sum(F.when(sure, F.col("tokens")).otherwise(0)).alias("certain"),
            F.sum(F.when(~sure, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("mass"),
        )
        raised = F.when(F.col("mass") > 0, F.greatest("scale", (F.col("rest") - F.col("certain")) / F.col("mass"))).otherwise(F.col("scale"))
        found = cut_lineage(sums.select("source", "rest", raised.alias("scale"), (raised > F.col("scale") * (1 + 1e-12)).alias("moved")))
        scale = found.drop("moved")
        if not found.where("moved").limit(1).count():
            return scale.select("source", "scale")


def mix(counted: DataFrame, targets: DataFrame, seed: int = 1, weight: Column | None = None, exact: bool = False) -> DataFrame:
    """doc_id, source, tokens, copies of the documents of the mixture.

    counted: the result of count_tokens(). exact: see allocate(). weight: positive relative inclusion odds of documents
    in the sample, all equal by default; null weights count as 0 (never sampled). A source's sample are its documents in
    the order of their Pareto ranks as long as their tokens stay within what is asked for, and then one more, whichever
    fills the gap best, so its size in tokens is fixed. targets must be few, as rows per source are broadcast. The same seed gives the same mixture on every run, however the rows are spread;
    equal ranks go by doc_id and tokens; rows that repeat a doc_id and its source share its fate at the gap. Documents of sources without target are left out.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    documents = cut_lineage(counted.withColumn("weight", w))
    plan = allocate(documents, targets, exact).select("source", F.floor("copies").alias("whole"), ((F.col("copies") - F.floor("copies")) * F.col("tokens")).alias("rest"))
    plan = cut_lineage(plan)
    scale = inclusion_scale(documents, plan.where("rest > 0"))
    plan = plan.join(scale, "source", "left").na.fill(0.0, ["scale"])
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + 0.5) / 2**52
    p = F.least(F.lit(1.0), F.col("scale") * F.col("weight"))
    rank = F.when(p >= 1, 0.0).when(p <= 0, float("inf")).otherwise((u / (1 - u)) / (p / (1 - p)))
    ranked = documents.join(F.broadcast(plan), "source").withColumn("rank", rank)
    ranked = ranked.withColumn("bucket", F.when(F.col("rank") == float("inf"), BUCKETS).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS)))
    counts = ranked.where(F.col("rank") < float("inf")).groupBy("source", "bucket", "rest").agg(F.sum("tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # at most BUCKETS rows per source of targets
    edges = counts.withColumn("before", before).where("before < rest").drop("rest")
    placed = ranked.join(F.broadcast(edges), ["source", "bucket"], "left")
    inside = F.col("before").isNotNull() & (F.col("before") + F.col("held") <= F.col("rest"))
    edge = F.col("before").isNotNull() & ~inside
    order = W.partitionBy("source", "bucket").orderBy("rank", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, 0)
    split = placed.where(edge).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    split = split.withColumn("in", F.col("upto") <= F.col("rest")).drop("upto")
    full = cut_lineage(
        placed.where(~edge).withColumn("in", inside.eqNullSafe(True)).unionByName(split).select("doc_id", "source", "tokens", "whole", "rest", "rank", "in")
    )
    gap = full.where("rest > 0").groupBy("source", "rest").agg((F.col("rest") - F.sum(F.when(F.col("in"), F.col("tokens")).otherwise(0))).alias("gap"))
    off = F.abs(F.col("gap") - F.col("tokens"))
    left = full.where(~F.col("in") & (F.col("rank") < float("inf"))).join(F.broadcast(gap.select("source", "gap")), "source").where(off < F.col("gap"))
    last = left.groupBy("source").agg(F.min(F.struct(off, "rank", "doc_id")).alias("l")).select("source", F.col("l.doc_id").alias("last"))
    full = full.join(F.broadcast(last), "source", "left").withColumn("in", F.col("in") | F.col("last").eqNullSafe(F.col("doc_id")) & F.col("last").isNotNull())
    return full.select("doc_id", "source", "tokens", (F.col("whole") + F.col("in").cast("int")).cast("bigint").alias("copies")).where("copies > 0")


def report(mixture: DataFrame, counted: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, real_share, tokens, short of each source of targets; real_share is of the mixture.

    short: the mixture has all documents of the source max_repeats times, or it has none, and they are fewer tokens than
    its share of as many tokens as all documents together.
    """
    real = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    total = real.agg(F.sum("mixed").alias("all_mixed"))
    rows = allocate(counted, targets).drop("short").join(F.broadcast(real), "source", "left").crossJoin(F.broadcast(total))
    mixed = F.coalesce("mixed", F.lit(0))
    short = (mixed == F.col("tokens") * F.col("max_repeats")) & (mixed < F.col("wanted"))
    return rows.select("source", "target_share", F.coalesce(F.try_divide("mixed", "all_mixed"), F.lit(0.0)).alias("real_share"), mixed.alias("tokens"), short.alias("short"))
