"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question and its re-parameterised copy have the same
template; their values are kept beside them. Windows of template words are joined by hash with the windows of the
benchmark. Hits of one copy lie on one diagonal (document position minus item position) or, where words were put in
or left out, on a few neighbouring ones. In each copy the placeholders must be consistent: one benchmark value stands
for one document value and the other way round. An item is found in a document if enough windows of one copy hold.

What is a name is told by its capital, which copies in other letter case lose. So a window that holds names is looked
up twice: with its names as placeholders and with its names as plain words. All else ignores case: upper-cased and
lower-cased copies meet the second form. A number next to another number keeps its value, and a form in which most
words are placeholders isn't used, so runs of numbers or names are only found where they are the same; grouped numbers
(1,000,000 or 3.14) are one word.

Documents are tokenised once and hashed in chunks of CHUNK words; only hits travel. The benchmark's windows go to every task if their size, which is computed first, is at most
MOST_BYTES; beyond it only hashes are joined by a shuffle, and the hits fetch their words. Everything is DataFrame
functions.

Defined results: null or empty texts match nothing; an item of fewer than WIDTH words is one window as long as itself,
and one of fewer than LEAST_WORDS words is found only in documents that consist of it; rows equal in doc_id and text
give the same result rows once, a null doc_id is a value like any other; a repeated item_id counts as one item, found
if the text of any of its rows is; empty tables give an empty result; columns other than doc_id, item_id and text are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import texts, written

WIDTH = 8
#: Shorter items are evidence only as a whole document.
LEAST_WORDS = 4
#: An item is found if so many windows of one copy hold (13 words in a row), or all if it has fewer.
HOLD = 6
#: Diagonals this near belong to one copy.
DRIFT = 4
#: Words of a chunk, so a long text is cut into rows instead of growing one.
CHUNK = 4096
#: Bytes of benchmark windows that are sent to every task.
MOST_BYTES = 64 << 20

UNITS = ["kg", "g", "mg", "km", "m", "cm", "mm", "mi", "miles", "ft", "feet", "inches", "lb", "lbs", "oz", "l", "ml", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "year", "dollars", "euros", "cents", "percent", "degrees"]
#: Signs before a word that is a name, a number or a unit, and the sign inside a grouped number.
NAME, NUMBER, UNIT, POINT = "\u0001", "\u0002", "\u0003", "\u0004"
_APART = rf"[^\p{{L}}\p{{N}}{NAME}-{POINT}]"


def slots(text: Column) -> Column:
    """The words of a text in lower case; names, numbers and units have their sign in front."""
    text = F.regexp_replace(text, f"[{NAME}-{POINT}]", " ")
    text = F.regexp_replace(text, r"[.,](?<=[0-9][.,])(?=[0-9])", POINT)
    # Every pattern begins with the sign it looks for; what stands before that is only looked at there.
    lone = rf"[0-9](?<![\p{{L}}\p{{N}}{POINT}][0-9])(?<![0-9]{_APART}{{1,8}}[0-9])[0-9{POINT}]*+(?!{_APART}{{1,8}}[0-9])(?!\p{{N}})"
    text = F.regexp_replace(text, lone, f" {NUMBER}$0 ")
    text = F.regexp_replace(text, rf"(?i)({NUMBER}[0-9{POINT}]++ {{1,3}})({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    text = F.regexp_replace(text, rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{NAME}-{POINT}]\p{{Lu}})\p{{Ll}}[\p{{L}}\p{{N}}]*+", f"{NAME}$0")
    return F.array_remove(F.split(F.lower(F.upper(text)), rf"{_APART}+"), "")


def chunked(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, start and ws: the words from start on, CHUNK of them and width - 1 more, for texts of at least width words."""
    starts = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width, F.lit(CHUNK)))
    cut = df.select(*keys, F.explode_outer(F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, CHUNK + width - 1).alias("ws")))).alias("c"))
    return cut.select(*keys, "c.start", "c.ws")


def windows(cut: DataFrame, width: int) -> DataFrame:
    """keys, start, ws, named, i (of the window's first word within ws) and key, a row for every form of every window of width words.

    A window's hash is made of the hashes of its halves. The second form has names as words; it has no key where that is the first form's.
    """
    kind = lambda w: F.xxhash64(F.substring(w, 1, 1))
    plain = lambda w: F.when(w >= POINT, F.xxhash64(w))
    first = F.transform("ws", lambda w: plain(w).otherwise(kind(w)))
    second = F.transform("ws", lambda w: plain(w).when(w.startswith(NAME), F.xxhash64(F.substring(w, 2, 1 << 30))).otherwise(kind(w)))
    df = cut.withColumns({"_a": first, "_b": second, "_n": F.size("ws") - (width - 1)})
    joined, salt = 1, F.lit(width)
    while joined < width:  # the last step's halves overlap unless width is a power of two
        step = min(joined, width - joined)
        half = lambda c: F.zip_with(c, F.slice(c, F.lit(step + 1), F.size(c)), lambda x, y: F.xxhash64(salt, x, y))
        df = df.withColumns({"_a": half("_a"), "_b": half("_b")})
        joined += step
    other = F.zip_with(F.slice("_a", F.lit(1), F.col("_n")), F.slice("_b", F.lit(1), F.col("_n")), lambda x, y: F.when(x != y, y))
    # The outer form keeps Spark from inferring filters that would compute every array a second time.
    df = df.withColumn("_f", F.concat(F.slice("_a", F.lit(1), F.col("_n")), other)).select(*cut.columns, "_n", F.posexplode_outer("_f").alias("_i", "key"))
    return df.select(*cut.columns, (F.col("_i") < F.col("_n")).alias("named"), (F.col("_i") % F.col("_n")).cast("int").alias("i"), "key")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, n_held, n_windows, n_slots, verbatim, first_word."""
    docs = texts(docs, id_col, text_col).withColumn("sha", F.xxhash64("text"))
    items = texts(benchmark, item_col, text_col).select(F.col("doc_id").alias("item_id"), F.xxhash64("text").alias("item_sha"), slots(F.col("text")).alias("words"))
    items = written(items.where(F.size("words") > 0).withColumn("width", F.least(F.lit(WIDTH), F.size("words"))).distinct(), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # WIDTH values at most
    words = docs.select("doc_id", "sha", slots(F.col("text")).alias("words"))

    found = []
    for width in [w for w in widths if w >= LEAST_WORDS] or [WIDTH]:
        wanted = windows(chunked(items.where(F.col("width") == width), ["item_id", "item_sha"], width), width)
        wanted = wanted.where("key is not null").select("key", "item_id", "item_sha", (F.col("start") + F.col("i")).alias("at"), F.slice("ws", F.col("i") + 1, width).alias("theirs"), "named")
        # Equal forms have equally many placeholders, so one side's count does.
        below = lambda sign: F.size(F.filter("theirs", lambda w: w < sign))
        marks, names = below(POINT), below(NUMBER)
        wanted = written(wanted.where(~F.col("named") | (names == 0) | (marks <= width // 2)).drop("named").distinct(), "windows")
        size = wanted.agg(F.sum(64 + F.length(F.array_join("theirs", " ")) * 2)).first()[0] or 0
        cut = chunked(words, ["doc_id", "sha"], width)
        seen = windows(cut, width)
        if size <= most_bytes:
            hits = seen.join(F.broadcast(wanted), "key").withColumn("ours", F.slice("ws", F.col("i") + 1, width))
        else:
            hits = seen.drop("ws").join(wanted, "key").alias("h")
            of = cut.select(F.col("doc_id").alias("cd"), F.col("sha").alias("cs"), F.col("start").alias("ca"), "ws").dropDuplicates(["cd", "cs", "ca"])
            hits = hits.join(of, F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("sha") == F.col("cs")) & (F.col("start") == F.col("ca"))).withColumn("ours", F.slice("ws", F.col("i") + 1, width))
        found.append(hits.select("doc_id", "sha", "item_id", "item_sha", (F.col("start") + F.col("i")).alias("pos"), "at", "theirs", "ours"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)

    # Where only one side has its sign, case differs; values are compared without signs.
    value = lambda w: F.translate(w, NAME + NUMBER + UNIT, "")
    marked = F.filter(F.arrays_zip("theirs", "ours"), lambda p: p["theirs"].rlike(f"^[{NAME}-{UNIT}]"))
    pairs = F.transform(marked, lambda p: F.struct(value(p["theirs"]).alias("theirs"), value(p["ours"]).alias("ours")))
    of = ["doc_id", "sha", "item_id", "item_sha"]
    hits = hits.select(*of, "pos", "at", pairs.alias("slots"))
    diagonals = hits.groupBy(*of, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.min("pos").alias("first"))

    def consistent(c: str) -> Column:
        side = lambda name: F.size(F.array_distinct(F.transform(c, lambda p: p[name])))
        return (F.size(c) == side("theirs")) & (F.size(c) == side("ours"))

    along = Window.partitionBy(*of).orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(along) > DRIFT).cast("int")
    diagonals = diagonals.withColumn("alone", F.when(consistent("slots"), F.size("ats")).otherwise(0)).withColumn("new", new).withColumn("copy", F.sum("new").over(along))
    copies = diagonals.groupBy(*of, "copy").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"), F.max("alone").alias("alone"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"), F.min("first").alias("first"),
    )
    held = F.greatest(F.when(consistent("slots"), F.col("n")).otherwise(0), F.col("alone")).cast("long")
    same = F.forall("slots", lambda p: p["theirs"] == p["ours"])
    sized = items.select(F.col("item_id").alias("zi"), F.col("item_sha").alias("zs"), (F.size("words") - F.col("width") + 1).cast("long").alias("n_windows"))
    copies = copies.select(*of, held.alias("n_held"), F.size("slots").cast("long").alias("n_slots"), same.alias("verbatim"), F.col("first").cast("long").alias("first_word"))
    copies = copies.join(sized, F.col("item_id").eqNullSafe(F.col("zi")) & (F.col("item_sha") == F.col("zs"))).where(F.col("n_held") >= F.least(F.lit(HOLD), F.col("n_windows")))
    copies = copies.select("doc_id", "item_id", "n_held", "n_windows", "n_slots", "verbatim", "first_word")

    if widths and widths[0] < LEAST_WORDS:
        whole = lambda df, *c: df.where(F.size("words") < LEAST_WORDS).select(*c, F.transform("words", value).alias("of"))
        short = whole(words, "doc_id").join(whole(items, "item_id"), "of").select("doc_id", "item_id")
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        copies = copies.union(short.select("doc_id", "item_id", one, one, zero, F.lit(True), zero))
    return copies.groupBy("doc_id", "item_id").agg(F.max("n_held").alias("n_held"), F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.bool_or("verbatim").alias("verbatim"), F.min("first_word").alias("first_word"))
