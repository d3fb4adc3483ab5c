"""What a chain of filters does in each order that they can be applied in: a replay of every order over every document.

The flags of each document (which filters it fails) are crossed with the 120 orders, a broadcast table of fixed size, and
with the five steps of an order. The first step that a document fails tells what every step does with it: kept before it,
removed there, redundant after it if the step's filter would have removed it too. Counts by part, order and step are
conditional sums, which Spark adds up within a task before it shuffles them; so a part may hold any share of the documents.

Flags come from one pass over the texts. The one that depends on other documents, being identical to the text of a smaller
id, compares digests (SHA-256): a text's smallest id is found by digest, combined within tasks first. Digests of more than
a thousandth of all documents, at most a thousand of them, are broadcast; all others are joined by a shuffle, so no task
gets the copies of a frequent text. Narrow rows of flags are written once, and neither texts nor digests are read twice.

Defined results: a null text counts as empty; a null source is the empty string, one part with it. A row without an id is
identical to none and has no label, nor does it make another one a copy; repeated rows (same id and text) are no copies of
each other, and each counts. A document's labels are those of any row of ``labels`` with its id. Columns beside those named
are not read. Without documents there are no parts, so no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

FILTERS = "ABCDE"
#: Thresholds of the filters: fewer words; distinct words per 100; capitals per 100 characters; these characters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A text with more than one of so many documents is broadcast: there are no more such texts than this.
FREQUENT = 1000
#: The bit of the filter that looks at other documents.
COPY = 1 << FILTERS.index("E")


def orders(spark: SparkSession) -> DataFrame:
    """Every order of the filters: its number, its letters, the bit of each step's filter."""
    rows = [(n, "".join(p), [1 << FILTERS.index(x) for x in p]) for n, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "order_no int, filter_order string, bits array<int>")


def own_flags(text: Column) -> Column:
    """The bits of the filters that look at the text alone."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    fails = (n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, 100 * capitals.cast("long") > MAX_CAPITALS * F.char_length(text), text.rlike(SYMBOLS))
    out = F.lit(0)
    for k, failed in enumerate(fails):
        out = out + F.when(failed, 1 << k).otherwise(0)
    return out


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A narrow row for each document: doc_id, part, flags, digest, good, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), own_flags(text).alias("flags"), F.unhex(F.sha2(text, 256)).alias("digest"))
    told = labels.where("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    nothing = {"good": F.lit(False), "toxic": F.lit(False)}
    with_id = rows.where("doc_id IS NOT NULL").join(told, "doc_id", "left").fillna(False, ["good", "toxic"])
    return with_id.unionByName(rows.where("doc_id IS NULL").withColumns(nothing))


def with_copies(rows: DataFrame) -> DataFrame:
    """Sets the flag of rows whose digest a smaller id has, too. ``rows``: a written table."""
    total = rows.count()
    smallest = Scratch(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "audit-texts").df
    frequent = smallest.where(F.col("n") * FREQUENT > total)
    hot = rows.join(F.broadcast(frequent.drop("n")), "digest")
    rest = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti").join(smallest.where(F.col("n") * FREQUENT <= total).drop("n"), "digest", "left")
    marked = hot.unionByName(rest)
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return marked.withColumn("flags", F.col("flags") + F.when(copy, COPY).otherwise(0)).drop("first", "digest")


def replay(rows: DataFrame) -> DataFrame:
    """Counts of every part, order and step over rows of part, flags, good and toxic."""
    plans = orders(rows.sparkSession)
    crossed = rows.select("part", "flags", "good", "toxic").crossJoin(F.broadcast(plans.drop("filter_order")))
    first = F.lit(len(FILTERS) + 1)
    for step in range(len(FILTERS), 0, -1):
        first = F.when(F.col("flags").bitwiseAND(F.get("bits", F.lit(step - 1))) != 0, step).otherwise(first)
    crossed = crossed.select("part", "flags", "good", "toxic", "order_no", "bits", first.alias("first"))
    steps = crossed.select("part", "flags", "good", "toxic", "order_no", "first", F.posexplode("bits").alias("place", "bit"))
    step, bit = F.col("place") + 1, F.col("bit")
    here = F.col("first") == step
    counts = steps.groupBy("part", "order_no", step.alias("step"), "bit").agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("first") < step) & (F.col("flags").bitwiseAND(bit) != 0)).alias("redundant"),
        F.count_if(F.col("flags") == bit).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    shares = counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))  # 120 rows each
    names = plans.select("order_no", "filter_order")
    return shares.join(F.broadcast(names), "order_no").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic."""
    return replay(with_copies(Scratch(facts(docs, labels), "audit-flags").df))
