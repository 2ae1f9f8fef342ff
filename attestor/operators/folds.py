"""Folds, samples and shards: balanced, reproducible, and without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def hashed_rank(df: DataFrame, by: list[str], key: Column, out: str = "rank") -> DataFrame:
    """The 1-based position of each row in its group by the SHA-256 of ``key``.

    A group is cut into buckets by the first three hex digits of the hash; small sums over bucket counts give each
    bucket's offset, and only rows of one bucket are sorted together. No group is ever in one task. Rows are shuffled
    once, by group and bucket and without their hash, which is worked out again where they arrive; the offsets meet
    them there.
    """
    at = F.struct(*by, F.substring(F.sha2(key, 256), 1, 3).alias("_b")).alias("_g")  # equal with nulls, never null
    rest = [c for c in df.columns if c not in by]
    counts = df.groupBy(at).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_g.{c}" for c in by]).orderBy("_g._b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_g", F.coalesce(before, F.lit(0)).alias("_offset"))
    groups = [F.col(f"_g.{c}").alias(c) for c in by]
    hashed = df.select(*rest, at).repartition("_g").select(*rest, *groups, "_g").withColumn("_h", F.sha2(key, 256))
    within = F.row_number().over(Window.partitionBy("_g").orderBy("_h"))
    ranked = hashed.withColumn("_w", within).drop("_h").join(offsets, "_g")
    return ranked.select(*df.columns, (F.col("_w") + F.col("_offset")).cast("long").alias(out))


def _salted(seed: int, text: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), text.cast("string"))


def _dealt(ranked: DataFrame, folds: int, seed: int, stratum: Column) -> DataFrame:
    """``fold`` by dealing ranks in turn, each stratum from a start of its own."""
    start = F.conv(F.substring(F.sha2(_salted(seed, stratum), 256), 1, 8), 16, 10).cast("long")
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1 + start, F.lit(folds)).cast("int")).drop("rank")


def stratified_folds(records: DataFrame, folds: int, seed: int, stratum: str = "stratum", key: str = "record_key") -> DataFrame:
    """``fold`` by dealing each stratum's records in hash order, each stratum from a start of its own."""
    return _dealt(hashed_rank(records, [stratum], _salted(seed, F.col(key))), folds, seed, F.col(stratum))


def inner_stratified_folds(records: DataFrame, folds: int, inner_folds: int, seed: int, stratum: str = "stratum", key: str = "record_key", keep: list[str] = ()) -> DataFrame:
    """``outer_fold`` and ``inner_fold`` of each record for each outer fold it trains in (all but its own ``fold``), and
    the columns ``keep``: the training records of an outer fold are dealt by stratum as in ``stratified_folds``, from a
    hash of their own."""
    outer = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("outer_fold")
    training = records.select(key, stratum, "fold", *keep, outer).where("outer_fold <> fold").drop("fold")
    prefixed = [F.concat_ws("|", F.col("outer_fold").cast("string"), F.col(c).cast("string")) for c in (stratum, key)]
    dealt = _dealt(hashed_rank(training, ["outer_fold", stratum], _salted(seed, prefixed[1])), inner_folds, seed, prefixed[0])
    return dealt.select(key, "outer_fold", F.col("fold").alias("inner_fold"), *keep)


def balanced_sample(records: DataFrame, label: str, per_class: dict[int, int], seed: int, key: str = "record_key") -> DataFrame:
    """At most ``per_class[value]`` records of each label value, in hash order."""
    ranked = hashed_rank(records, [label], F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    most = F.lit(0)
    for value, n in per_class.items():
        most = F.when(F.col(label) == value, n).otherwise(most)
    return ranked.where(F.col("rank") <= most).drop("rank")


def balanced_targets(positives: int, negatives: int, most: int | None, secure: int | None = None) -> dict[int, int]:
    """How many of either class to take: halves, the odd one to the positives, shortfalls made up by the other."""
    if most is None:
        return {1: positives, 0: negatives}
    want_negative = min(negatives, secure if secure is not None else most // 2)
    want_positive = min(positives, most - want_negative)
    if secure is None:
        want_negative = min(negatives, most - want_positive)
    return {1: want_positive, 0: want_negative}


def shards(records: DataFrame, index: str, n: int) -> DataFrame:
    return records.withColumn("shard", F.pmod(F.col(index), F.lit(n)).cast("int"))


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by an aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def grouped_folds(groups: DataFrame, folds: int, seed: int) -> DataFrame:
    """family -> fold, each family whole in one fold and each stratum level over the folds.

    ``groups`` has a row for each dataset, family and stratum with its count ``n`` — a summary, not the records. Families
    of several records are dealt one after the other, largest first, to the fold that holds least of their strata: that
    is sequential, in one pandas group a dataset. Families of one record, the bulk, only fill what is then uneven: how
    many of a stratum each fold is due follows from its counts, and they are dealt by their place in hash order.
    """
    import pandas as pd

    whole = groups.groupBy("dataset", "family").agg(F.sum("n").alias("size"), F.min("stratum").alias("stratum"), F.collect_list(F.struct("stratum", "n")).alias("strata"))
    singles = whole.where("size = 1").groupBy("dataset", "stratum").agg(F.count("*").alias("singles"))
    several = whole.where("size > 1").select("dataset", "family", "size", "strata", F.lit(None).cast("string").alias("stratum"), F.lit(None).cast("long").alias("singles"))
    due = singles.select("dataset", F.lit(None).cast("string").alias("family"), F.lit(None).cast("long").alias("size"), F.lit(None).cast(several.schema["strata"].dataType).alias("strata"), "stratum", "singles")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        held = [dict() for _ in range(folds)]
        total = [0] * folds
        out = []
        name = pdf.dataset.iloc[0]
        groups = pdf[pdf["size"].notna()]
        rows = sorted(zip(groups.family, groups["size"], groups.strata), key=lambda r: (-r[1], hashlib.sha256(f"{seed}|{r[0]}".encode()).hexdigest()))
        for family, size, strata in rows:
            k = min(range(folds), key=lambda j: (sum(held[j].get(x["stratum"], 0) * x["n"] for x in strata), total[j], j))
            for x in strata:
                held[k][x["stratum"]] = held[k].get(x["stratum"], 0) + x["n"]
            total[k] += int(size)
            out.append((name, family, None, k, None, None))
        for stratum, n in sorted(zip(pdf.stratum[pdf["size"].isna()], pdf.singles[pdf["size"].isna()])):
            counts = [held[k].get(stratum, 0) for k in range(folds)]
            level = sorted(range(folds), key=lambda k: (counts[k], total[k], k))
            left, quota = int(n), [0] * folds
            for filled in range(1, folds + 1):  # the lowest folds rise to the next one's count, then all alike
                room = filled * (counts[level[filled]] - counts[level[filled - 1]]) if filled < folds else left
                step = min(left, room)
                for place, k in enumerate(level[:filled]):
                    quota[k] += step // filled + (place < step % filled)
                left -= step
                if not left:
                    break
            start = 0
            for k in range(folds):
                out.append((name, None, stratum, k, start, start + quota[k]))
                start += quota[k]
                total[k] += quota[k]
        return pd.DataFrame(out, columns=["dataset", "family", "stratum", "fold", "lo", "hi"])

    kinds = dict(groups.dtypes)
    dealt = several.unionByName(due).groupBy("dataset").applyInPandas(deal, f"dataset string, family {kinds['family']}, stratum {kinds['stratum']}, fold int, lo long, hi long")
    ranked = hashed_rank(whole.where("size = 1").select("dataset", "family", "stratum"), ["dataset", "stratum"], F.concat_ws("|", F.lit(str(seed)), "family"))
    # Quotas are a row for each dataset, stratum and fold: a bounded table.
    quotas = F.broadcast(dealt.where("family is null and hi > lo").select(F.col("dataset").alias("_d"), F.col("stratum").alias("_s"), "fold", "lo", "hi"))
    alone = ranked.join(quotas, (F.col("dataset") == F.col("_d")) & F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")))
    return dealt.where("family is not null").select("dataset", "family", "fold").unionByName(alone.select("dataset", "family", "fold"))


def inner_grouped_folds(groups: DataFrame, dealt: DataFrame, folds: int, inner_folds: int, seed: int) -> DataFrame:
    """``inner_fold`` of each dataset's family for each ``outer_fold`` it trains in, each family whole in one fold.

    ``groups`` is the summary that ``grouped_folds`` dealt as ``dealt``; the training families of an outer fold are
    dealt anew, each outer fold's as a dataset of its own and by hashes of their own.
    """
    outer = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("outer_fold")
    training = groups.join(dealt, ["dataset", "family"]).select("dataset", "family", "stratum", "n", "fold", outer).where("outer_fold <> fold")
    prefixed = [F.concat_ws("|", F.col("outer_fold").cast("string"), F.col(c)).alias(c) for c in ("dataset", "family")]
    found = grouped_folds(training.select(*prefixed, "stratum", "n"), inner_folds, seed)
    own = [F.regexp_replace(c, r"^\d+\|", "").alias(c) for c in ("dataset", "family")]
    return found.select(*own, F.substring_index("dataset", "|", 1).cast("int").alias("outer_fold"), F.col("fold").alias("inner_fold"))
