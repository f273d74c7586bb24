"""Mixing sources to target weights by Poisson replication.

A source with `n` documents and target share `w` of `total` output documents has the repetition
rate `total * w / n`. A document's copy count inverts the Poisson distribution of its source's
rate at a uniform number hashed from the seed and its id, so it needs no coordination, and equal
runs give equal copies. Rates above `PIECE` are sums of independent Poisson counts, which keeps
exp(-rate) far from underflow. Copies are ordered by a hash of id and copy number over all
partitions, so the output is shuffled globally and a hot source lies nowhere in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.shared import saved

SEED, PIECE, EXPONENT = "mix-1", 32.0, 0.5
#: Rate tables of up to this many sources are broadcast; larger ones are joined over salted keys.
BROADCAST_SOURCES, SALTS = 20_000, 64
#: Input rows for a part of the global order, until there are as many parts as shuffle partitions.
PART_ROWS = 5_000


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, source_column: str = "source", weights: dict[str, float] | None = None, total: int | None = None, exponent: float = EXPONENT) -> DataFrame:
    """mix_source, mix_n (its documents), mix_pieces, and mix_cdf, the Poisson distribution function of a piece's rate.

    Without `weights` a source's weight is its document count to the power `exponent`; with them,
    a source that has none gets 0. `total` is the number of input documents by default.
    """
    counts = docs.groupBy(F.col(f"`{source_column}`").alias("mix_source")).agg(F.count("*").alias("mix_n"))
    if weights is None:
        weight = F.pow("mix_n", F.lit(exponent))
    else:
        weight = F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("mix_source")], F.lit(0.0)) if weights else F.lit(0.0)
    counts = saved(counts.withColumn("mix_w", weight), "source-counts")
    whole = counts.agg(F.coalesce(F.sum("mix_w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("mix_n"), F.lit(0)).alias("n")).first()
    size = whole.n if total is None else total
    rate = F.lit(size) * F.col("mix_w") / F.lit(whole.w) / F.col("mix_n") if whole.w > 0 else F.lit(0.0)
    pieces = F.greatest(F.ceil(F.col("mix_rate") / PIECE), F.lit(1)).cast("int")
    one = F.col("mix_rate") / F.col("mix_pieces")
    # terms p(0..k) far into the tail, then their running sums, with a single pass over the array
    start = F.struct(F.exp(-one).alias("p"), F.array(F.exp(-one)).alias("cdf"))
    step = lambda a, k: F.struct((a["p"] * one / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * one / k)).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(int(PIECE + 12 * PIECE**0.5 + 30))), start, step)["cdf"]
    return saved(counts.withColumn("mix_rate", rate).withColumn("mix_pieces", pieces).withColumn("mix_cdf", cdf).select("mix_source", "mix_n", "mix_pieces", "mix_cdf"), "rates")


def replicated(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", weights: dict[str, float] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """docs with `mix_copy` (from 0) and `mix_key` (the place in the global order), one row per copy, in that order.

    A null source is a source of its own; rows that repeat an id get equal counts each; a row
    with a null id is named by its text, so different texts draw apart; the text plays no other
    part, so null, empty and very long ones are all kept. Rows with equal keys (repeated ids)
    follow in the order of their texts. An empty table gives no rows. Columns of docs may have
    any names; those named mix_copy or mix_key are replaced.
    """
    docs = docs.drop("mix_copy", "mix_key")
    p = "mix_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = f"_{p}"
    known = rates(docs, source_column, weights, total).withColumnsRenamed({f"mix_{c}": f"{p}{c}" for c in ("source", "n", "pieces", "cdf")})
    name = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary"))))
    named = docs.withColumn(f"{p}name", name)
    same = F.col(f"`{source_column}`").eqNullSafe(F.col(f"{p}source"))
    if known.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = named.join(F.broadcast(known), same)
    else:
        salted = known.withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = named.withColumn(f"{p}own", F.pmod(F.xxhash64(f"{p}name"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(f"{p}own") == F.col(f"{p}salt"))).drop(f"{p}own", f"{p}salt")
    draws = F.transform(F.sequence(F.lit(1), F.col(f"{p}pieces")), lambda i: uniform(F.lit(seed), F.col(f"{p}name"), i.cast("string")))  # one a piece
    drawn = F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter(f"{p}cdf", lambda c: c <= u)))
    counted = joined.withColumn(f"{p}count", drawn).where(F.col(f"{p}count") > 0).drop(f"{p}source", f"{p}n", f"{p}pieces", f"{p}cdf")
    copies = counted.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(0), F.col(f"{p}count") - 1))).drop(f"{p}count")
    keyed = copies.withColumn(f"{p}key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), f"{p}name", F.col(f"{p}copy").cast("string")).cast("binary"))).drop(f"{p}name")
    keyed = keyed.withColumnsRenamed({f"{p}copy": "mix_copy", f"{p}key": "mix_key"})
    # keys are spread evenly over the hexadecimal numbers, so the parts of the global order need no sample of them
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(known.agg(F.sum(f"{p}n")).first()[0] or 0) // PART_ROWS)))
    part = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("bigint") * parts / float(2**32)).cast("int")
    return keyed.repartitionById(parts, part).sortWithinPartitions("mix_key", *([text_column] if docs.schema[text_column].dataType.simpleString() == "string" else []))


def op7_mixing(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return replicated(rows).withColumnsRenamed({"mix_copy": "copy", "mix_key": "shuffle_key"})


ORACLE = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(pow(n, {EXPONENT})) AS s, sum(n) AS a FROM counts),
rated AS (SELECT source, a * pow(n, {EXPONENT}) / s / n AS rate FROM counts, sums),
pieced AS (SELECT source, greatest(ceil(rate / {PIECE}), 1)::INT AS pieces, rate / greatest(ceil(rate / {PIECE}), 1)::INT AS one FROM rated),
terms AS (
  SELECT source, pieces, one, 0 AS k, exp(-one) AS p, exp(-one) AS c FROM pieced
  UNION ALL SELECT source, pieces, one, k + 1, p * one / (k + 1), c + p * one / (k + 1) FROM terms WHERE k < {int(PIECE + 12 * PIECE**0.5 + 30)}),
cdfs AS (SELECT source, pieces, list(c ORDER BY k) AS cdf FROM terms GROUP BY source, pieces),
named AS (SELECT *, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM documents),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, pieces + 1), lambda q: len(list_filter(cdf, lambda c: c <= ('0x' || md5('{SEED}:' || name || ':' || q::VARCHAR)[1:13])::BIGINT::DOUBLE / 4503599627370496.0))))::INT AS n
  FROM named d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source),
copies AS (SELECT *, unnest(range(0, n)) AS copy FROM drawn WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('{SEED}:order:' || name || ':' || copy::VARCHAR) AS shuffle_key FROM copies
"""
