r"""Quality rules with adaptive thresholds, in DataFrame functions only.

Signals of a text are measured first; quantile sketches of each signal per
(lang, source) then give the thresholds in place of fixed cutoffs. The sketches
are KLL sketches: they are partial aggregates that Spark merges, so no group,
however hot, is gathered anywhere, and a finished sketch of a (lang, source)
group is merged again into one of its language and one of everything.

A signal is the empirical logit log((n + 1/2) / (N - n + 1/2)) of a share n / N.
Unlike the share, which is 0 for most texts, it has a spread everywhere: a short
text without a symbol says less than a long one. A group's threshold is

    q50 + SPREAD * max(q50 - q25, LEAST)

by its own quantiles. Median and lower quartile stay those of ordinary texts
while fewer than half of a group's rows are bad. Small groups borrow: each
quantile is the mean of the group's own, weighted by its rows, and its language's,
weighted as PRIOR rows (and likewise the language's and the whole table's), so
that the weight of a group's own goes up smoothly with its rows. LEAST, for groups of copies
that have next to no spread, is a fallback; the table of thresholds says in
floored how many signals took it.

Words are runs of [^\x20\x09-\x0D]. Defined cases: a null text has no words;
null lang or source form groups of their own; repeated rows count as often as
they occur; other columns pass; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytespan.llm.common import fresh, saved

#: Word separators, and the characters that count as symbols (fixed values of the contract).
SPACES, SYMBOLS = r"[ \t-\r]+", r"[^#*$%&|<>]+"
SIGNALS = ("symbol_share", "dup_line_share", "repeat_share", "upper_share")
#: How many lower half-spreads above the median a signal may be, and the least such spread that counts, in logits.
SPREAD = {"symbol_share": 6.0, "dup_line_share": 8.0, "repeat_share": 10.0, "upper_share": 12.0}
LEAST = {"symbol_share": 0.5, "dup_line_share": 0.4, "repeat_share": 0.4, "upper_share": 0.08}
PRIOR, SKETCH_K, QUANTILES = 32.0, 1024, (0.25, 0.5)
#: Up to so many (lang, source) groups their thresholds are broadcast (a few MB); beyond, they are joined.
BROADCAST_ROWS = 50_000


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(windows: Column) -> Column:
    """Words inside windows of three that occur twice or more; windows: (hash, index) of each, sorted."""
    near = lambda i, d: F.get(windows, i + d)["h"]
    hits = F.sort_array(F.transform(F.filter(windows, lambda w, i: (w["h"] == near(i, -1)) | (w["h"] == near(i, 1))), lambda w: w["i"]))
    # a hit covers three words, fewer if the next hit starts inside it
    gaps = F.zip_with(hits, F.slice(hits, F.lit(2), F.greatest(F.size(hits), F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct column of the contract's counts and the signals; and that column's name."""
    t, w, lines, hashes, windows, m = fresh(docs, "_t", "_w", "_lines", "_hashes", "_windows", "_measured")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    df = df.select(*keep, t, split_words(F.col(t)).alias(w), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias(lines))
    some = F.size(w) >= 3
    each = F.when(some, F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn(hashes, F.coalesce(each, F.array().cast("array<bigint>")))
    # most texts repeat nothing: only those that do are sorted
    df = df.withColumn(windows, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size(w).cast("long")
    chars = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    symbols = F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long")
    dups = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    df = df.select(
        *keep,
        F.struct(
            n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dups.alias("n_dup_lines"),
            F.coalesce(F.when(F.col(windows).isNotNull(), repeated_words(F.col(windows))), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        ).alias(m),
    )
    return df, m


def signals(m: str) -> dict[str, Column]:
    """The empirical logit of every share."""
    def logit(part: str, whole: str) -> Column:
        n, rest = F.col(f"{m}.{part}"), F.greatest(F.col(f"{m}.{whole}") - F.col(f"{m}.{part}"), F.lit(0))
        return F.log((n + F.lit(0.5)) / (rest + F.lit(0.5)))

    return {
        "symbol_share": logit("n_symbols", "word_chars"), "dup_line_share": logit("n_dup_lines", "n_lines"),
        "repeat_share": logit("n_repeat_words", "n_words"), "upper_share": logit("n_upper", "word_chars"),
    }


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def sketches(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per group: its number of rows and a KLL sketch of every value."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(k) for k, v in values.items()])


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of fewer, larger groups from those of many small ones."""
    return parts.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(k).alias(k) for k in SIGNALS])


def quantiles(rows: str) -> Column:
    """The quantiles of every signal, as a struct of arrays, from sketch columns; null without rows, as an empty sketch has none."""
    return F.when(F.col(rows) > 0, F.struct(*[F.array(*[F.kll_sketch_get_quantile_double(k, F.lit(q)) for q in QUANTILES]).alias(k) for k in SIGNALS]))


def thresholds(rows: DataFrame, lang: str, source: str, values: dict[str, Column]) -> DataFrame:
    """(lang, source, rows, fence, floored): one row per group. Its size is the number of distinct (lang, source) pairs."""
    parts = saved(sketches(rows, [lang, source], values).select(F.col(lang).alias("lang"), F.col(source).alias("source"), "rows", *SIGNALS))
    by_lang = merged(parts, ["lang"]).select(F.col("lang").alias("l"), F.col("rows").alias("lang_rows"), quantiles("rows").alias("by_lang"))
    whole = merged(parts, []).select(quantiles("rows").alias("by_whole"), F.lit(1).alias("one"))
    own = parts.select("lang", "source", "rows", quantiles("rows").alias("by_own"), F.lit(1).alias("one"))
    own = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(whole, "one", "left")

    def mixed(k: str, i: int) -> Column:
        q = lambda view: F.col(f"{view}.{k}")[i]
        of_lang = (F.col("lang_rows") * q("by_lang") + PRIOR * q("by_whole")) / (F.col("lang_rows") + PRIOR)
        return (F.col("rows") * q("by_own") + PRIOR * of_lang) / (F.col("rows") + PRIOR)

    spread = {k: mixed(k, 1) - mixed(k, 0) for k in SIGNALS}
    fence = F.struct(*[(mixed(k, 1) + SPREAD[k] * F.greatest(spread[k], F.lit(LEAST[k]))).alias(k) for k in SIGNALS])
    floored = sum(((spread[k] < LEAST[k]).cast("int") for k in SIGNALS), F.lit(0))
    return saved(own.select("lang", "source", "rows", fence.alias("fence"), floored.alias("floored")))


def judged(df: DataFrame, m: str) -> tuple[DataFrame, str]:
    """df (a saved table of measured(), of which m is the column of measures) with the verdict; and its column.

    The threshold table is broadcast if it was counted to be small, else joined.
    The verdict is one sum, so that no part of it is pushed below the join.
    """
    verdict, lang, source, fence = fresh(df, "_kept", "_lang", "_source", "_fence")
    passed = ~base_failed(m)
    view = df.select(F.col("`lang`").alias(lang), F.col("`source`").alias(source), *[F.when(passed, v).alias(k) for k, v in signals(m).items()], passed.alias("passed"))
    table = thresholds(view.filter("passed"), lang, source, {k: F.col(k) for k in SIGNALS})
    table = table.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("fence").alias(fence))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    df = df.join(table, F.col("`lang`").eqNullSafe(F.col(lang)) & F.col("`source`").eqNullSafe(F.col(source)), "left")
    against = base_failed(m).cast("int")
    for k, v in signals(m).items():
        against += F.coalesce((v > F.col(f"{fence}.{k}")).cast("int"), F.lit(0))
    return df.withColumn(verdict, against == 0).drop(lang, source, fence), verdict


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, unchanged."""
    df, m = measured(docs)
    df, verdict = judged(saved(df), m)
    return df.filter(F.col(verdict)).select(*[F.col(f"`{c}`") for c in docs.columns])
