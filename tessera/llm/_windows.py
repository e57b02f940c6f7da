"""Word windows as columns: what the two window-join operators share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that one generated row holds, so a long text is cut into rows instead of growing one.
CHUNK = 4096


def windows(docs: DataFrame, words: Column, width: int, keys: list[str], of_word=None) -> DataFrame:
    """keys, pos (of the window's first word, from 0) and w0..w{width-1} for every window of `width` words.

    of_word maps an array of words to the array that is compared, given as h0..h{width-1} beside the words.
    """
    # The outer forms keep Spark from inferring filters that would split every text a second time.
    cut = docs.select(*keys, words.alias("words"))
    starts = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width, F.lit(CHUNK)))
    cut = cut.select(*keys, F.explode_outer(F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, CHUNK + width - 1).alias("ws")))).alias("c"))
    cut = cut.select(*keys, F.col("c.start").alias("start"), F.col("c.ws").alias("ws"))
    if of_word is not None:
        cut = cut.withColumn("hs", of_word(F.col("ws")))
    n = F.size("ws") - (width - 1)
    parts = [F.slice("ws", k + 1, n).alias(f"w{k}") for k in range(width)]
    if of_word is not None:
        parts += [F.slice("hs", k + 1, n).alias(f"h{k}") for k in range(width)]
    out = cut.select(*keys, "start", F.posexplode_outer(F.arrays_zip(*parts)).alias("i", "w"))
    names = [f"{c}{k}" for c in ("w", "h")[: 1 + (of_word is not None)] for k in range(width)]
    return out.select(*keys, (F.col("start") + F.col("i")).alias("pos"), *(F.col(f"w.{c}").alias(c) for c in names))
