"""Quality rules with thresholds that adapt to each language and source.

Four ratios of every text go into mergeable quantile sketches: log-linear histograms (bins of a
sixteenth to a thirty-second of an octave), which are summed bin by bin. Each (language, source)
has one; languages and the whole corpus get theirs by merging. The quartiles of a group's sketch
give its fences, ``q75 + reach * max(q75 - q25, least spread)``, and the documents are filtered by
a join with them. All of it is DataFrame expressions.

Defined cases: a null text has no words and fails; null languages and sources are groups of their
own; repeated rows are judged each by itself; an empty table gives an empty result; columns of the
input that have the name of a computed one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Ratio -> (least spread, whether low values fail too).
RATIOS = {"symbols_pm": (20, False), "dup_lines_pm": (120, False), "repeat_words_pm": (100, False), "word_len_pc": (50, True)}
OUT = (*BASE, *RATIOS, "base_failed", "kept")



def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(t: Column) -> Column:
    ends = lambda w: F.when((F.get(w, F.lit(0)) == "") | (F.get(w, F.size(w) - 1) == ""), F.filter(w, lambda x: x != "")).otherwise(w)
    return _let(F.split(t, r"[\x20\x09-\x0D]+", -1), ends)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    Each window is a long: its hash above, its position in the low bits. Sorted, equal windows are
    neighbours; every repeated window adds the words that the one before it did not cover.
    """
    n = F.size(w)
    long = lambda x: x.cast("long")

    def count(bits: Column) -> Column:
        up, down = lambda x: F.call_function("shiftleft", x, bits), lambda x: F.call_function("shiftright", x, bits)
        window = lambda i: up(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))).bitwiseOR(long(i))
        keys = F.transform(F.sequence(F.lit(0), n - 3), window)
        place = lambda x: x.bitwiseAND(up(long(F.lit(1))) - 1)
        same = lambda x, y: down(x.bitwiseXOR(y)) == 0
        again = lambda s: F.filter(s, lambda x, k: same(F.get(s, k + 1), x) | same(F.get(s, k - 1), x))
        start = F.struct(long(F.lit(-3)).alias("last"), long(F.lit(0)).alias("sum"))
        step = lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(long(F.lit(3)), x - a["last"])).alias("sum"))
        return F.aggregate(F.sort_array(F.transform(_let(F.sort_array(keys), again), place)), start, step, lambda a: a["sum"])

    return F.when(n >= 4, _let(F.coalesce(F.length(F.bin(n)), F.lit(1)), count)).otherwise(long(F.lit(0)))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the ratios (per mille, and hundredths of a character)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUT and c != text])
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = _let(
        _words(t),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    of_lines = _let(
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")
    # inline() keeps the optimiser from repeating the three expressions for every use of a field
    out = docs.select("*", F.inline(F.array(F.struct(of_words.alias("__tw_w"), of_lines.alias("__tw_l"), symbols.alias("n_symbols")))))
    out = out.withColumns({k: F.col(f"__tw_w.{k}") for k in ("n_words", "word_chars", "n_repeat_words")} | {k: F.col(f"__tw_l.{k}") for k in ("n_lines", "n_dup_lines")}).drop("__tw_w", "__tw_l")
    per = lambda a, b, k: F.when(F.col(b) > 0, F.expr(f"({a} * {k}) div {b}")).otherwise(F.lit(0).cast("long"))
    return out.withColumns({
        "symbols_pm": per("n_symbols", "word_chars", 1000), "dup_lines_pm": per("n_dup_lines", "n_lines", 1000),
        "repeat_words_pm": per("n_repeat_words", "n_words", 1000), "word_len_pc": per("word_chars", "n_words", 100),
        "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"),
    })


def bin_of(v: Column) -> Column:
    """The lower edge of the sketch bin of a non-negative long: exact below 64, then 32 bins an octave."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, e), e)


def sketches(feats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(level, lang, source, ratio, bin, n): level 0 for a language's source, 1 and 2 merged from it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bin_of(F.col(k)).alias("bin")) for k in RATIOS]))
    fine = feats.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs.alias("p")).groupBy("lang", "source", "p.ratio", "p.bin").agg(F.count(F.lit(1)).alias("n"))
    null = F.lit(None).cast("string")
    levels = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").cast("string").alias("lang"), null.alias("source")),
        F.struct(F.lit(2).alias("level"), null.alias("lang"), null.alias("source")),
    ))
    return fine.select(levels.alias("g"), "ratio", "bin", "n").groupBy("g.level", "g.lang", "g.source", "ratio", "bin").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, reach: int = 3, least_docs: int = 100) -> DataFrame:
    """(lang, source, <ratio>_hi, <ratio>_lo) for each group; small groups take the merged sketch above them."""
    part = "PARTITION BY level, lang, source, ratio"
    q = (
        sketch.selectExpr("*", f"sum(n) OVER ({part} ORDER BY bin) AS cum", f"sum(n) OVER ({part}) AS total")
        .groupBy("level", "lang", "source", "ratio")
        .agg(F.max("total").alias("total"), F.min(F.when(F.col("cum") * 4 >= F.col("total"), F.col("bin"))).alias("q25"), F.min(F.when(F.col("cum") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q75"))
    )
    fence = lambda k: F.col("reach") * F.greatest(F.col("q75") - F.col("q25"), F.lit(RATIOS[k][0]))
    q = q.withColumn("reach", F.lit(reach))
    wide = q.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("ratio") == k, F.col("q75") + fence(k))).alias(f"{k}_hi") for k in RATIOS],
        *[F.max(F.when(F.col("ratio") == k, F.col("q25") - fence(k))).alias(f"{k}_lo") for k in RATIOS],
    )
    names = [f"{k}_{end}" for k in RATIOS for end in ("hi", "lo")]
    at = lambda n: wide.where(F.col("level") == n)
    fine, by_lang, whole = at(0).alias("a"), at(1).alias("b"), at(2).alias("c")
    pick = lambda x: F.when(F.col("a.total") >= least_docs, F.col(f"a.{x}")).when(F.col("b.total") >= least_docs, F.col(f"b.{x}")).otherwise(F.col(f"c.{x}"))
    return fine.join(by_lang, F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").join(whole, F.col("c.level") == F.col("a.level") + 2, "left").select("a.lang", "a.source", *[pick(x).alias(x) for x in names])


#: Groups whose thresholds are broadcast at most (under 4 MB); more of them are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def judge(feats: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``feats`` with ``kept``, by a join with the thresholds of its group."""
    names = [c for c in limits.columns if c not in ("lang", "source")]
    keys = limits.select(F.col("lang").alias("__tw_lang"), F.col("source").alias("__tw_source"), *[F.col(c).alias(f"__tw_{c}") for c in names])
    if limits.count() <= BROADCAST_GROUPS:
        keys = F.broadcast(keys)
    on = F.col(lang).cast("string").eqNullSafe(F.col("__tw_lang")) & F.col(source).cast("string").eqNullSafe(F.col("__tw_source"))
    fine = F.lit(True)
    for k, (_, low) in RATIOS.items():
        fine &= F.col(k) <= F.col(f"__tw_{k}_hi")
        if low:
            fine &= F.col(k) >= F.col(f"__tw_{k}_lo")
    return feats.join(keys, on, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False))).drop(*keys.columns)


def staged_features(docs: DataFrame, *keep: str, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The counts, with ``keep`` and the group columns but without the text, as a table in the shared folder."""
    return staged(features(docs, text).select(*dict.fromkeys([*keep, lang, source]), *OUT[:-1]), "features")


def staged_thresholds(feats: DataFrame, lang: str = "lang", source: str = "source", reach: int = 3, least_docs: int = 100) -> DataFrame:
    """The thresholds as a small table in the shared folder."""
    return staged(thresholds(staged(sketches(feats, lang, source), "sketches"), reach, least_docs), "limits")


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", reach: int = 3, least_docs: int = 100) -> DataFrame:
    """``docs`` with base counts, ratios, ``base_failed`` and ``kept``.

    The counts are made once for the sketches and once for the join, so that no text is written or
    shuffled.
    """
    feats = features(docs, text)
    return judge(feats, staged_thresholds(feats, lang, source, reach, least_docs), lang, source)
