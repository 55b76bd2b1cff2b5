"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source the documents are put in key order, cut into key ranges
(`BUCKETS` of them, so that a source with a third of all rows is spread over that many groups), and prefix sums of their
sizes are taken in two levels: over range totals, then inside a range. A source takes whole epochs while its target
holds them and cuts the last epoch at its exact budget in words.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, last in order; repeated
rows are separate rows of the mix; rows without an id have the key of their text; an empty table gives an empty mix. Only id, source, size and a
hash of the row are shuffled, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.prefix import running
from quarry.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Key ranges in each source: one per prefix of so many hexadecimal digits.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source (`m_source`, `m_size`): its weight by code-point rank and its target in words.

    Targets are min(max_epochs * size, level * weight), with the one level at which they add up to all sizes. Sorted by
    max_epochs * size / weight, saturated sources come first, so the level follows from running sums: it is that of the first source it does not saturate.
    """
    ranked = running(sizes, [F.col("m_source").asc_nulls_last()], label="sources").withColumnRenamed("place", "m_rank")
    table = F.array(*(F.lit(w) for w in weights))
    capped = ranked.withColumn("m_weight", F.get(table, (F.col("m_rank") % len(weights)).cast("int")).cast("long")).withColumn(
        "m_cap", F.lit(max_epochs).cast("long") * F.col("m_size")
    )
    ordered = running(capped, [(F.col("m_cap").cast("double") / F.col("m_weight")).asc(), F.col("m_rank")], ("m_cap", "m_weight"), "saturation")
    words, shares = ordered.agg(F.coalesce(F.sum("m_size"), F.lit(0)), F.coalesce(F.sum("m_weight"), F.lit(0))).first()
    level = (F.lit(words) - F.col("m_cap_before")).cast("double") / (F.lit(shares) - F.col("m_weight_before")).cast("double")
    fits = ordered.withColumn("level", level).where(F.col("level") * F.col("m_weight") <= F.col("m_cap"))
    first = fits.agg(F.min_by("level", "place")).first()[0]
    target = F.least(F.col("m_cap").cast("double"), F.lit(first).cast("double") * F.col("m_weight"))
    return ordered.select("m_source", "m_size", F.coalesce(target, F.lit(0.0)).alias("m_target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    row: Column | None = None,
) -> DataFrame:
    """Per document: m_id, m_source, size, source_size, target, epochs (whole copies), part (words of the last, cut copy), taken, and m_row: `row`, a hash of it."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("="), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    key = F.md5(F.concat_ws(":", F.lit(seed), name))
    sized = docs.select(
        F.col(id_col).alias("m_id"),
        F.col(source_col).alias("m_source"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("m_key"),
        (F.lit(0).cast("long") if row is None else row).alias("m_row"),
    )
    sized = sized.withColumn("m_part", F.substring("m_key", 1, RANGE_DIGITS)).withColumn(
        "m_group", F.coalesce(F.concat(F.lit("="), F.col("m_source")), F.lit("null"))
    )
    ranges = materialize(sized.groupBy("m_group", "m_source", "m_part").agg(F.sum("size").alias("m_words")), "key-ranges")
    targets = source_targets(ranges.groupBy("m_group", "m_source").agg(F.sum("m_words").alias("m_size")).drop("m_group"), weights, max_epochs)
    targets = targets.withColumn("m_group", F.coalesce(F.concat(F.lit("="), F.col("m_source")), F.lit("null"))).drop("m_source")
    up_to = Window.partitionBy("m_group").orderBy("m_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        ranges.withColumn("m_offset", F.sum("m_words").over(up_to) - F.col("m_words")).drop("m_words", "m_source").join(targets, "m_group")
    )
    inside = Window.partitionBy("m_group", "m_part").orderBy("m_key", "m_id", "size", "m_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.join(offsets, ["m_group", "m_part"]).withColumn(
        "m_before", F.col("m_offset") + F.sum("size").over(inside) - F.col("size")
    )
    budget = F.floor("m_target").cast("long")
    epochs = F.when(F.col("m_size") > 0, F.floor(budget / F.col("m_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("m_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("m_before")))
    return placed.select(
        "m_id",
        "m_source",
        "size",
        F.col("m_size").alias("source_size"),
        F.col("m_target").alias("target"),
        epochs.alias("epochs"),
        part.alias("part"),
        (epochs * F.col("size") + part).alias("taken"),
        "m_row",
    )


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("m_id").alias("doc_id"), "size", "source_size", "target", "taken")


def render_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: a row per copy, the copy that a budget cuts ending after its last word that is taken. Columns as given.

    Rows meet their place in the mix by a hash of all their columns; equal rows share the copies that they are given.
    """
    atomic = [f.name for f in docs.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    columns = [F.col(f"`{c}`") for c in atomic]
    row = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    plan = mix(docs, id_col, text_col, source_col, row=row, **options).where("size > 0").groupBy("m_row")
    whole_part, cut = F.col("part") == F.col("size"), F.sum(F.when(F.col("part") < F.col("size"), F.col("part")).otherwise(0))
    # Of equal rows, which follow one another in their source, at most one is cut.
    plan = plan.agg(F.count(F.lit(1)).alias("__rows"), (F.sum("epochs") + F.count_if(whole_part)).alias("__whole"), cut.alias("__cut"))
    joined = docs.withColumn("__row", row).join(plan, F.col("__row") == F.col("m_row"))
    # Equal rows have one of them stand for all; only these few are shuffled.
    once = joined.where("__rows = 1").unionByName(joined.where("__rows > 1").dropDuplicates(["__row"]))
    none = F.array().cast("array<bigint>")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__whole").cast("int")), F.when(F.col("__cut") > 0, F.array("__cut")).otherwise(none))
    rows = once.withColumn("__part", F.explode(copies))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, 1, F.greatest(F.col("__part"), F.lit(0)).cast("int")), "")
    out = rows.withColumn(text_col, F.when(F.col("__part") < 0, F.col(text_col)).otherwise(head))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def oracle_sql(weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('{seed}:' || coalesce(doc_id::VARCHAR, '=' || md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS m_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
c AS (SELECT *, (CASE rk % {len(weights)} {cases} END)::BIGINT AS wt, {max_epochs} * m_size AS cap FROM s),
l AS (SELECT *, (sum(m_size) OVER ())::BIGINT AS total,
        (sum(cap) OVER (ORDER BY cap::DOUBLE / wt, rk ROWS UNBOUNDED PRECEDING))::BIGINT - cap AS before,
        (sum(wt) OVER (ORDER BY cap::DOUBLE / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lft FROM c),
v AS (SELECT min_by((total - before)::DOUBLE / lft::DOUBLE, cap::DOUBLE / wt) AS lev FROM l
      WHERE (total - before)::DOUBLE / lft::DOUBLE * wt <= cap),
t AS (SELECT source, m_size, coalesce(least(cap::DOUBLE, lev * wt), 0.0) AS target FROM l, v),
p AS (SELECT d.doc_id, d.size, t.m_size AS source_size, t.target,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e"""
