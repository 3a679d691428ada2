"""Terms of one or several words in token streams: which of them occur, how often, and what a vocabulary makes of them."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between the tokens of a stream while it is searched; no token holds it.
EDGE = "\x1f"


def occurrences(df: DataFrame, by: list[str], tokens: Column, terms: list[str]) -> DataFrame:
    """(by..., term, n, n_rows): how often each term stands in the token arrays of a group, and in how many of them.

    All terms are looked for at once by one automaton over each stream, whose tokens are told apart by a sign, so a term
    matches whole tokens alone. Matches may overlap ('pleural fluid' and 'fluid collection' in 'pleural fluid collection',
    'effusion' inside 'pleural effusion'), and each counts. Terms are split at white space; a term without a word, and
    one that does not occur, have no row. Null arrays have no match. Each batch of rows is summed before the shuffle.
    """
    words = {t: EDGE + EDGE.join(t.split()) + EDGE for t in dict.fromkeys(terms) if t.split()}
    names = list(words)
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(names):
        automaton.add_word(words[t], (i, len(words[t])))
    if names:
        automaton.make_automaton()
    shared = df.sparkSession.sparkContext.broadcast(automaton)  # as large as the list of terms

    def run(batches):
        find = shared.value
        for b in batches:
            where, which = [], []
            for r, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for _, (i, _) in find.iter(text) if names and text else ():
                    where.append(r)
                    which.append(i)
            pairs, n = np.unique(np.array([where, which], np.int64).reshape(2, -1), axis=1, return_counts=True)
            rows = pa.array(pairs[0])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(len(by))), pa.array([names[i] for i in pairs[1].tolist()], pa.string()), pa.array(n)], names=[*by, "term", "n"])

    joined = F.concat(F.lit(EDGE), F.array_join(F.transform(tokens, lambda t: F.translate(t, EDGE, " ")), EDGE), F.lit(EDGE))
    streams = df.select(*by, joined.alias("__text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in streams.schema.fields[:-1])
    found = streams.mapInArrow(run, f"{kinds}term string, n long")
    return found.groupBy(*by, "term").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows"))


def coverage(categories: DataFrame, have: DataFrame, found: DataFrame) -> DataFrame:
    """(category, kind, n_terms, in_vocabulary, vocabulary_pct, in_texts, texts_pct, occurrences).

    categories: (category, term); a term may be in several of them. have: (token), a vocabulary, which can hold a term
    of several words as one token. found: (term, n) of `occurrences`. A row for each category and for all terms taken
    once ('all'), by kind of term: 'single' word, 'multi' word, and both ('any').
    """
    everything = categories.unionByName(categories.select(F.lit("all").alias("category"), "term")).distinct()
    listed = categories.select(F.col("term").alias("token")).distinct()
    known = have.join(F.broadcast(listed), "token", "left_semi").select(F.col("token").alias("term")).distinct().withColumn("known", F.lit(1))  # at most as many as there are terms
    rows = everything.join(known, "term", "left").join(found.groupBy("term").agg(F.sum("n").alias("n")), "term", "left")
    kind = F.when(F.contains("term", F.lit(" ")), "multi").otherwise("single")
    rows = rows.select("*", F.explode(F.array(kind, F.lit("any"))).alias("kind"))
    pct = lambda c: F.round(100 * F.count(c) / F.count("*"), 6)
    return rows.groupBy("category", "kind").agg(
        F.count("*").alias("n_terms"), F.count("known").alias("in_vocabulary"), pct("known").alias("vocabulary_pct"),
        F.count("n").alias("in_texts"), pct("n").alias("texts_pct"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"),
    )
