"""Secret scans: fixed patterns plus a battery of randomness tests with false-discovery control.

Main path: DataFrame functions only. Documents without a hit are never shuffled with their text; hits (kind, place,
token) are exploded once, and only they and the row ids move.

Base kinds. `assign`, `access` and `hex` are found leftmost and without overlap by their patterns; matches that miss the
length rule are dropped. `random` spans come from the method: every run of 20 or more token characters (letters, digits, + / _ -), wherever it
stands, is tested with its padding, under the encoding inferred for it, for
  - uniformity of its alphabet (chi-squared against equal shares; against text, the mean surprise of its letters under text's letter frequencies),
  - the number of runs of character classes,
  - serial correlation of neighbouring code values.
Each gives a p-value of running text, bounded from above. Fisher's rule combines the three, and Benjamini and Hochberg's step-up rule controls the
false-discovery rate of the flagged tokens within strata of encoding and length, as short tokens tell less. Flagged tokens must
also agree with a random draw in all three tests, each under the size of the encoding's alphabet. A `random` span that touches a base span is left out.
The three are not quite independent, which Fisher's rule asks for; the agreement with a random draw stands against that.

Texts are scanned once: their hits, few, are written before anything is counted.

Defined results: a null text counts as empty and has no spans; repeated rows are reported row by row; positions are code points,
end exclusive; ties of start are ordered by kind as listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import let
from quarry.session import materialize

#: kind, pattern, group whose length counts, least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are maximal, so asking for the length in the pattern finds the same runs as filtering all of them.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    # A run is bounded by its own characters only: behind '=' a value begins. Any '=' after it are padding, unless a value follows them.
    ("random", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?", 0, 20),
)
ORDER = tuple(k for k, *_ in KINDS)

# Percent of each letter from a to z in running text, rounded means of English, German, French and Spanish.
LETTERS = (8.6, 1.4, 3.3, 4.4, 15.0, 1.3, 1.6, 2.9, 7.1, 0.4, 0.6, 4.6, 2.8, 7.9, 6.1, 2.3, 0.7, 6.7, 7.2, 7.2, 4.1, 1.2, 1.0, 0.4, 0.7, 0.5)
_total = sum(LETTERS)
SURPRISE = tuple(-math.log(p / _total) for p in LETTERS)
#: Of text: mean and (rounded up) deviation of a letter's surprise; how often it changes character class, at most; serial correlation where classes mix.
TEXT_SURPRISE, TEXT_DEVIATION = sum(p / _total * s for p, s in zip(LETTERS, SURPRISE, strict=True)), 0.9
TEXT_CLASS_CHANGE, TEXT_SERIAL = {"hex": 0.05, "base32": 0.05, "alnum": 0.12, "base64": 0.12}, 0.3
SIZES = {"hex": 16.0, "base32": 32.0, "alnum": 62.0, "base64": 64.0}
#: Rate of false discoveries, and how unlikely a random draw may be before a token is no longer taken for one.
FDR = 0.001
RANDOM_Z = 3.29
#: Size of the log10 p-value bins in which the step-up rule counts; a token takes its bin's upper end, so rounding errs to caution.
BIN = 0.25
FLOOR = 60.0


def _spans(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<k, part, hit, ok>>: the text before each match, the match, and whether it counts; k orders them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    marked = F.transform(
        F.arrays_zip(parts.alias("part"), hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")),
        lambda x, i: F.struct(
            F.lit(order).alias("kind"),
            i.alias("k"),
            F.length(x["part"]).alias("gap"),
            x["hit"].alias("hit"),
            (F.length(x["g"]) >= least).alias("ok"),
        ),
    )
    kept = F.filter(marked, lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(pattern), kept)


def _class_changes(token: Column) -> Column:
    """Runs of one character class (lower, upper, digit, other), less one."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    return (F.length(F.regexp_replace(classes, "[^aA0]+", "-")) - 1).cast("double")


def _upper_tail(z: Column) -> Column:
    """-ln of a bound on P(Z > z): exp(-z * z / 2) / max(2, z * sqrt(2 pi)) for z over 0."""
    return F.when(z > 0, z * z / 2 + F.log(F.greatest(F.lit(2.0), z * 2.5066283))).otherwise(F.lit(0.0))


def _more_changes(share: Column, n: Column, text: Column) -> Column:
    """-ln of Chernoff's bound on the chance of so large a share of n trials, each with text's chance."""
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    return F.when(share > text, n * (part(share, text) + part(1 - share, 1 - text))).otherwise(F.lit(0.0))


def tests(token: Column) -> Column:
    """struct(encoding, of: struct(n, score, random, mixed)): -log10 of the combined p-value of text, and whether it could be a random draw."""
    body = F.regexp_replace(token, "=+$", "")
    encoding = (
        F.when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(body.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .when(body.rlike("^[A-Za-z0-9]+$"), F.lit("alnum"))
        .otherwise(F.lit("base64"))
    )
    of_encoding = lambda table, e: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), e)

    def measured(b: Column) -> Column:
        chars = F.filter(F.split(b["body"], ""), lambda c: c != "")
        n = F.length(b["body"]).cast("double")
        size = of_encoding(SIZES, b["encoding"])
        squares = F.aggregate(
            F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(b["body"]) - F.length(F.replace(b["body"], c, F.lit("")))).cast("double"), F.lit(2.0))
        )
        letters = F.filter(F.transform(chars, lambda c: F.ascii(F.lower(c)) - 96), lambda i: (i >= 1) & (i <= 26))
        surprise = F.aggregate(letters, F.lit(0.0), lambda acc, i: acc + F.element_at(F.array(*(F.lit(x) for x in SURPRISE)), i))

        def serial(v: Column) -> Column:
            mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
            return let(
                F.struct(mean.alias("m"), v.alias("v")),
                lambda s: F.aggregate(
                    F.transform(s["v"], lambda x, i: F.coalesce((x - s["m"]) * (F.get(s["v"], i + 1) - s["m"]), F.lit(0.0))),
                    F.lit(0.0),
                    lambda a, x: a + x,
                )
                / F.nullif(F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + F.pow(x - s["m"], F.lit(2.0))), F.lit(0.0)),
            )

        shares = [F.length(F.regexp_replace(b["body"], f"[^{c}]+", "")).cast("double") / n for c in ("a-z", "A-Z", "0-9", "+/_-")]
        return F.struct(
            n.alias("n"),
            size.alias("size"),
            of_encoding(TEXT_CLASS_CHANGE, b["encoding"]).alias("text_change"),
            (size / n * squares - n).alias("chi"),
            F.size(letters).cast("double").alias("letters"),
            surprise.alias("surprise"),
            _class_changes(b["body"]).alias("changes"),
            (1 - sum((s * s for s in shares[1:]), shares[0] * shares[0])).alias("mixed"),
            let(F.transform(chars, lambda c: F.ascii(c).cast("double")), serial).alias("serial"),
        )

    def scored(m: Column) -> Column:
        n, size, changes = m["n"], m["size"], m["changes"]
        serial = F.coalesce(m["serial"], F.lit(1.0))
        of_letters = _upper_tail((m["surprise"] - m["letters"] * TEXT_SURPRISE) / (TEXT_DEVIATION * F.sqrt(F.greatest(m["letters"], F.lit(1.0)))))
        of_runs = _more_changes(changes / (n - 1), n - 1, m["text_change"])
        of_serial = F.when(m["mixed"] > 0, _upper_tail((TEXT_SERIAL - serial) * F.sqrt(n))).otherwise(F.lit(0.0))
        random_z = (m["chi"] - (size - 1)) / F.sqrt(2 * (size - 1))
        runs_z = (changes - (n - 1) * m["mixed"]) / F.sqrt((n - 1) * F.greatest(m["mixed"] * (1 - m["mixed"]), F.lit(0.05)))
        fisher = lambda s: F.greatest(F.lit(0.0), F.least(F.lit(FLOOR), (s - F.log(1 + s + s * s / 2)) / 2.302585093))
        return F.struct(
            n.cast("int").alias("n"),
            let(of_letters + of_runs + of_serial, fisher).alias("score"),
            ((random_z < RANDOM_Z) & (F.abs(runs_z) < RANDOM_Z) & (F.abs(serial * F.sqrt(n)) < RANDOM_Z)).alias("random"),
            (m["mixed"] > 0).alias("mixed"),
        )

    both = F.struct(body.alias("body"), encoding.alias("encoding"))
    return let(both, lambda b: F.struct(b["encoding"].alias("encoding"), let(measured(b), scored).alias("of")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """A row per span: s_row (the row's own number), s_id, kind (index into ORDER), start, end. Rows without spans have one row with null kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_spans(text, i, pattern, group, least) for i, (_, pattern, group, least) in enumerate(KINDS)]
    empty = F.array().cast("array<struct<kind:int,k:int,gap:int,hit:string,ok:boolean>>")
    rows = docs.select(
        F.monotonically_increasing_id().alias("s_row"),
        F.col(id_col).alias("s_id"),
        F.concat(*(F.coalesce(x, empty) for x in found)).alias("s_hits"),
    )
    # A row per hit, or one for a text without: written, so that neither the texts nor the numbers of rows are worked out twice.
    hits = materialize(rows.select("s_row", "s_id", F.explode_outer("s_hits").alias("h")).select("s_row", "s_id", "h.*"), "hits")
    ahead = Window.partitionBy("s_row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        hits.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(ahead))
        .withColumn("start", F.col("end") - F.length("hit"))
        .where("ok or kind is null")
        .withColumn("test", F.when(F.col("kind") == 3, tests(F.col("hit"))))
        .withColumn("test_of", F.concat_ws("/", "test.encoding", F.floor(F.log2(F.col("test.of.n").cast("double")) * 2).cast("string")))
        .withColumn("bin", F.floor(F.col("test.of.score") / BIN))
    )
    # Step-up rule on binned p-values: a table of strata by bins, both bounded, whatever the corpus.
    counts = placed.where("kind = 3").groupBy("test_of", "bin").agg(F.count(F.lit(1)).alias("c"))
    worst_first = Window.partitionBy("test_of").orderBy("bin")
    counts = counts.withColumn("all", F.sum("c").over(worst_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn(
        "as_small", F.sum("c").over(worst_first.rowsBetween(0, Window.unboundedFollowing))
    )
    cuts = counts.where(F.pow(F.lit(10.0), -F.col("bin") * BIN) <= F.lit(fdr) * F.col("as_small") / F.col("all")).groupBy("test_of").agg(F.min("bin").alias("cut"))
    judged = placed.join(F.broadcast(cuts), "test_of", "left")
    flagged = (F.col("bin") >= F.col("cut")) & F.col("test.of.random") & F.col("test.of.mixed")
    judged = judged.withColumn("flagged", F.coalesce(F.col("kind") < 3, F.lit(False)) | F.coalesce(flagged, F.lit(False)))
    # A method span stays only where no base span of its row reaches into it.
    in_row = Window.partitionBy("s_row").orderBy("start", "kind")
    before = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(in_row.rowsBetween(1, Window.unboundedFollowing))
    judged = judged.withColumn("clear", (F.coalesce(before, F.lit(0)) <= F.col("start")) & F.coalesce(after >= F.col("end"), F.lit(True)))
    keep = F.col("flagged") & ((F.col("kind") < 3) | F.col("clear"))
    return judged.select("s_row", "s_id", F.when(keep, F.col("kind")).alias("kind"), "start", "end")


def scan_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spans = scan(docs, id_col, text_col)
    names = F.array(*(F.lit(k) for k in ORDER))
    one = F.struct(
        "start", "kind", F.concat_ws(":", F.get(names, F.col("kind")), F.col("start").cast("string"), F.col("end").cast("string")).alias("said")
    )
    rows = spans.groupBy("s_row", "s_id").agg(
        *(F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(ORDER[:3])),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("found"),
    )
    base = F.filter("found", lambda x: x["kind"] < 3)
    return rows.select(
        F.col("s_id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.array_join(F.transform(base, lambda x: x["said"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", lambda x: x["said"]), ",").alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by `mark`; overlapping spans become one mark. Columns as given, rows all kept.

    Spans are joined back by id and text hash, so rows that repeat an id with another text are told apart.
    """
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    spans = scan(keyed.select(F.struct(F.col(id_col).alias("id"), F.col("__key").alias("key")).alias("both"), F.col(text_col).alias("text")), "both", "text")
    cut = (
        spans.where("kind is not null")
        .groupBy("s_row", "s_id")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__cuts"))
        .groupBy(F.col("s_id.id").alias("__id"), F.col("s_id.key").alias("__key2"))
        .agg(F.first("__cuts").alias("__cuts"))
    )
    joined = keyed.join(cut, keyed[id_col].eqNullSafe(cut["__id"]) & (keyed["__key"] == cut["__key2"]), "left")
    # Fold: text so far, and where the next uncut part begins.
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))
    folded = F.aggregate(
        F.col("__cuts"),
        zero,
        lambda acc, c: F.struct(
            F.when(
                c["start"] >= acc["at"],
                F.concat(acc["out"], F.array(F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (c["start"] - acc["at"]).cast("int")), F.lit(mark))),
            )
            .otherwise(acc["out"])
            .alias("out"),
            F.greatest(acc["at"], c["end"]).alias("at"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    out = joined.withColumn(text_col, F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(folded))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
