"""Statistics of token sequences by name: any chosen set of them from one pass over the texts.

`cells` reads the texts once and counts two kinds of cells: the shapes of rows (tokens, distinct tokens) and the words
at each position. All statistics are made of these counts. A statistic is a name with the parts it needs, which are
aggregates over one of three levels, and a step that finishes it: rows (a line for each shape, with its number `c`),
words (a line for each word, with its `freq`), places (a line for each position, with its `distinct` words).
`register_part` and `register` add one's own; `compute` makes each needed part once, however many statistics share it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.stats import ratio
from quillspark.sources.tables import kept

ROWS, WORDS, PLACES = "rows", "words", "places"


@dataclass(frozen=True)
class Statistic:
    needs: tuple[str, ...]
    finish: Callable[..., Column]  # of the needed parts, in their order


def cells(df: DataFrame, by: list[str], tokens: Column, wanted: set[str]) -> DataFrame:
    """(by..., pos, token, n, u, c) from one pass: rows with a null pos count shapes (n tokens, u distinct), others words at positions.

    Of the levels that are not wanted nothing is counted; where places are not, all words have position 0. A null array
    is a row without tokens. Cells are counted by each task before the shuffle.
    """
    if wanted == {WORDS}:
        plain = df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("c"))
        return plain.withColumn("pos", F.lit(0))
    long = lambda c: c.cast("long")
    kind = "struct<pos:int,token:string,n:long,u:long>"
    rows = df.select(*by, F.coalesce(tokens, F.array().cast("array<string>")).alias("__t"))
    shape = F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("token"), long(F.size("__t")).alias("n"), long(F.size(F.array_distinct("__t"))).alias("u"))
    words = F.transform("__t", lambda t, i: F.struct((i if PLACES in wanted else F.lit(0)).alias("pos"), t.alias("token"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("u")).cast(kind))
    listed = [F.array(shape.cast(kind))] * (ROWS in wanted) + [words] * bool(wanted - {ROWS})
    return rows.select(*by, F.explode(F.concat(*listed)).alias("x")).select(*by, "x.*").groupBy(*by, "pos", "token", "n", "u").agg(F.count("*").alias("c"))


def level_of(counted: DataFrame, by: list[str], level: str) -> DataFrame:
    """A level's lines, from `cells`."""
    if level == ROWS:
        return counted.filter("pos is null").select(*by, "n", "u", "c")
    at = counted.filter("pos is not null")
    return at.groupBy(*by, "token").agg(F.sum("c").alias("freq")) if level == WORDS else at.groupBy(*by, "pos").agg(F.count("*").alias("distinct"))


def _mean(x: Column) -> Column:
    return F.sum(x * F.col("c")) / F.sum("c")


def _variance(x: Column) -> Column:
    return F.greatest(F.sum(x * x * F.col("c")) / F.sum("c") - _mean(x) ** 2, F.lit(0.0))


def _parts() -> dict[str, tuple[str, Callable[[], Column]]]:
    n, u, c, f = (lambda: F.col("n")), (lambda: F.col("u")), (lambda: F.col("c")), (lambda: F.col("freq"))
    long = lambda x: x.cast("long")
    return {
        "entries": (ROWS, lambda: F.sum(c())),
        "filled": (ROWS, lambda: F.coalesce(F.sum(F.when(n() > 0, c())), F.lit(0))),
        "tokens": (ROWS, lambda: F.sum(n() * c())),
        "length_mean": (ROWS, lambda: _mean(n())),
        "length_median": (ROWS, lambda: F.percentile(n(), F.lit(0.5), c())),
        "length_min": (ROWS, lambda: F.min(n())),
        "length_max": (ROWS, lambda: F.max(n())),
        "length_variance": (ROWS, lambda: _variance(n())),
        "distinct_mean": (ROWS, lambda: _mean(u())),
        "repetition": (ROWS, lambda: F.sum(F.when(n() > 0, (1 - u() / n()) * c())) / F.sum(F.when(n() > 0, c()))),
        "words": (WORDS, lambda: F.count("*")),
        "used": (WORDS, lambda: F.count_if(f() > 0)),
        "word_tokens": (WORDS, lambda: F.sum(f())),
        "freq_mean": (WORDS, lambda: F.avg(f())),
        "freq_std": (WORDS, lambda: F.stddev_pop(f())),
        "freq_median": (WORDS, lambda: F.percentile(f(), F.lit(0.5))),
        "freq_max": (WORDS, lambda: long(F.max(f()))),
        "freq_min": (WORDS, lambda: long(F.min(f()))),
        "skewness": (WORDS, lambda: F.when(F.count("*") < 3, 0.0).otherwise(F.coalesce(F.skewness(f()), F.lit(0.0)))),
        "kurtosis": (WORDS, lambda: F.when(F.count("*") < 4, 0.0).otherwise(F.coalesce(F.kurtosis(f()), F.lit(0.0)))),
        "once": (WORDS, lambda: F.count_if(f() == 1)),
        "over_10": (WORDS, lambda: F.count_if(f() > 10)),
        "over_100": (WORDS, lambda: F.count_if(f() > 100)),
        "places_std": (PLACES, lambda: F.stddev_pop(F.col("distinct"))),
    }


#: Aggregates by name: the level they are made of, and the aggregate.
PARTS = _parts()
_cv = lambda var, mean: ratio(F.sqrt(var), mean)
_as_is = lambda x: x
#: Statistics by name.
STATISTICS: dict[str, Statistic] = {name: Statistic((name,), _as_is) for name in PARTS} | {
    "length_std": Statistic(("length_variance",), F.sqrt),
    "length_cv": Statistic(("length_variance", "length_mean"), _cv),
    "length_consistency": Statistic(("length_variance", "length_mean"), lambda v, m: 1 / (1 + _cv(v, m))),
    "stability": Statistic(("length_variance", "length_mean", "freq_std", "freq_mean"), lambda v, m, s, f: 1 / (1 + _cv(v, m) + ratio(s, f))),
    "complexity": Statistic(("distinct_mean", "length_mean"), ratio),
    "efficiency": Statistic(("words", "word_tokens"), ratio),
    "diversity": Statistic(("distinct_mean", "words"), ratio),
    "tokens_per_word": Statistic(("word_tokens", "words"), ratio),
    "tokens_per_entry": Statistic(("tokens", "entries"), ratio),
    "memory": Statistic(("words", "length_mean"), ratio),
    "rare_share": Statistic(("once", "words"), ratio),
    "common_share": Statistic(("over_100", "words"), ratio),
    "used_share": Statistic(("used", "words"), ratio),
}
#: Bundles: (name in the result, statistic, digits kept or None for whole numbers).
SHAPE = [
    ("vocab_size", "words", None), ("total_tokens", "word_tokens", None), ("freq_mean", "freq_mean", 6), ("freq_std", "freq_std", 6), ("freq_median", "freq_median", 6), ("freq_max", "freq_max", None), ("freq_min", "freq_min", None),
    ("vocab_efficiency", "efficiency", 6), ("skew", "skewness", 4), ("kurt", "kurtosis", 3), ("rare_ratio", "rare_share", 6), ("common_ratio", "common_share", 6), ("n_once", "once", None), ("n_over_10", "over_10", None),
]
VOCABULARY = [
    ("vocab_size", "words", None), ("total_tokens", "word_tokens", None), ("avg_tokens_per_vocab", "tokens_per_word", 6), ("token_freq_mean", "freq_mean", 6), ("token_freq_std", "freq_std", 5), ("token_freq_median", "freq_median", 6),
    ("most_common_freq", "freq_max", None), ("least_common_freq", "freq_min", None), ("vocab_efficiency", "efficiency", 6), ("frequency_skewness", "skewness", 4), ("frequency_kurtosis", "kurtosis", 3),
    ("rare_token_ratio", "rare_share", 6), ("common_token_ratio", "common_share", 6), ("vocabulary_coverage", "used_share", 6),
]
DIFFICULTY = [
    ("total_entries", "entries", None), ("valid_entries", "filled", None), ("total_tokens", "tokens", None), ("vocab_size", "words", None), ("avg_sequence_length", "length_mean", 6), ("median_sequence_length", "length_median", 6),
    ("min_sequence_length", "length_min", None), ("max_sequence_length", "length_max", None), ("sequence_length_std", "length_std", 6), ("sequence_length_variance", "length_variance", 4), ("sequence_length_cv", "length_cv", 6),
    ("avg_unique_tokens_per_seq", "distinct_mean", 6), ("avg_repetition_ratio", "repetition", 6), ("complexity_score", "complexity", 6), ("token_freq_mean", "freq_mean", 6), ("token_freq_std", "freq_std", 5), ("token_freq_median", "freq_median", 6),
    ("most_common_token_freq", "freq_max", None), ("least_common_token_freq", "freq_min", None), ("length_consistency", "length_consistency", 6), ("vocabulary_efficiency", "efficiency", 6), ("sequence_diversity", "diversity", 6),
    ("training_stability_score", "stability", 6), ("position_consistency", "places_std", 5), ("avg_tokens_per_sample", "tokens_per_entry", 6), ("memory_efficiency", "memory", 5),
]


def register_part(name: str, level: str, aggregate: Callable[[], Column]) -> None:
    """An aggregate over a level's columns, under a name that statistics can need; it is a statistic of that name, too."""
    if level not in (ROWS, WORDS, PLACES):
        raise ValueError(f"no level {level}: {ROWS}, {WORDS} or {PLACES}")
    PARTS[name] = (level, aggregate)
    STATISTICS[name] = Statistic((name,), _as_is)


def register(name: str, needs: list[str], finish: Callable[..., Column]) -> None:
    """A statistic that is made of parts."""
    if missing := [p for p in needs if p not in PARTS]:
        raise ValueError(f"no part {', '.join(missing)}: {sorted(PARTS)}")
    STATISTICS[name] = Statistic(tuple(needs), finish)


def compute(df: DataFrame, by: list[str], tokens: Column, chosen: list[tuple[str, str, int | None]] | list[str]) -> DataFrame:
    """(by..., chosen...): the chosen statistics of token arrays by group; the texts are read once, each part is made once.

    chosen: names, or (name in the result, name, digits). A group without a word has null word statistics. Cells that
    more than one level is made of are written down first.
    """
    chosen = [(x, x, None) if isinstance(x, str) else x for x in chosen]
    if missing := [s for _, s, _ in chosen if s not in STATISTICS]:
        raise ValueError(f"no statistic {', '.join(missing)}: {sorted(STATISTICS)}")
    needed = list(dict.fromkeys(p for _, s, _ in chosen for p in STATISTICS[s].needs))
    wanted = {PARTS[p][0] for p in needed}
    counted = cells(df, by, tokens, wanted)
    counted = kept(counted) if len(wanted) > 1 else counted
    tables = []
    for level in (ROWS, WORDS, PLACES):
        if names := [p for p in needed if PARTS[p][0] == level]:
            tables.append(level_of(counted, by, level).groupBy(*by).agg(*(PARTS[p][1]().alias(f"__{p}") for p in names)))
    joined = reduce(lambda a, b: a.join(b, by, "left"), tables)  # a row for each group
    out = lambda s: STATISTICS[s].finish(*(F.col(f"__{p}") for p in STATISTICS[s].needs))
    return joined.select(*by, *((F.round(out(s), digits) if digits is not None else out(s)).alias(name) for name, s, digits in chosen))
