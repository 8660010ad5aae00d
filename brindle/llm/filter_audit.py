"""Filter interaction audit: what each of five filters removes in every order of application.

One native pass gives a mask of failures per document (bit 0 for filter A up to bit 4 for E). Copies
are found by a grouping of texts (their MD5) that keeps the smallest id. The masks are
counted in 32 cells per part; whatever order the filters are applied in, a document is
removed by the first filter of its mask, so all 120 orders are enumerated from the cells and no document is looked at again.

Filters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * capitals A-Z > 2 * characters;
D any of ``#$%&*|``; E equal to the text of a smaller id anywhere in the table.

Defined results: null texts are empty; the part of a null source is the empty string, which such a source shares; a null id is
neither smaller nor larger than another, so it fails E never and has no labels; rows repeated with one id are not copies of each
other; several labels of one id count as one that has any of their marks; an empty table gives no rows. Rows are
dealt by id, texts are never shuffled, and work columns are named ``_fa_*``.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: White space that ends a word, besides the blank itself.
SPACES = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def text_failures(text: Column, words: Column) -> Column:
    """Mask of the four filters that look at one text."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < 200, distinct.cast("long") * 100 < n.cast("long") * 50, capitals.cast("long") * 100 > F.length(text).cast("long") * 2, text.rlike("[#$%&*|]")]
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(_fa_id, part, mask, good, toxic) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(text))
    d = docs.select(F.col(id_col).alias("_fa_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("_fa_text"), words(text).alias("_fa_words"), key.alias("_fa_key"))
    d = d.select("_fa_id", "part", "_fa_key", text_failures(F.col("_fa_text"), F.col("_fa_words")).alias("_fa_mask"))
    first = docs.groupBy(key.alias("_fa_first")).agg(F.min(id_col).alias("_fa_i"))
    # What is known of an id, in one row: its labels and the texts of which it is the first. So rows are dealt once, by id.
    marks = labels.select(F.col("doc_id").alias("_fa_i"), (F.col("quality") == 1).alias("_fa_good"), (F.col("toxic") == 1).alias("_fa_toxic"))
    known = marks.unionByName(first, allowMissingColumns=True).filter("_fa_i is not null").groupBy("_fa_i")
    known = known.agg(F.max("_fa_good").alias("_fa_good"), F.max("_fa_toxic").alias("_fa_toxic"), F.collect_set("_fa_first").alias("_fa_firsts"))
    copy = F.coalesce(~F.array_contains("_fa_firsts", F.col("_fa_key")), F.lit(True))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    met = d.filter("_fa_id is not null").join(known, F.col("_fa_id") == F.col("_fa_i"), "left")
    met = met.select("_fa_id", "part", (F.col("_fa_mask") + F.when(copy, 16).otherwise(0)).alias("mask"), no("_fa_good").alias("good"), no("_fa_toxic").alias("toxic"))
    alone = d.filter("_fa_id is null").select("_fa_id", "part", F.col("_fa_mask").alias("mask"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return met.unionByName(alone)


def cells(found: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows per part."""
    return found.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _shapley(cell: Column) -> Column:
    """In how many of all orders a filter that fails the cell's documents removes them: an equal share."""
    return F.lit(len(ORDERS)) / F.bit_count(cell["mask"])


def audit(found: DataFrame) -> DataFrame:
    """Every part, order and step from the cells of ``masks``: 600 rows a part."""
    c = F.col("_fa_cells")
    parts = cells(found).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_fa_cells"))
    rows = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"_fa_own": bits(F.substr("filter_order", F.col("step"), F.lit(1))), "_fa_before": bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("_fa_own"), F.col("_fa_before")

    def total(field: str, test) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.when(test(x["mask"]), x[field]).otherwise(0))

    fails = lambda m: m.bitwiseAND(own) != 0
    there = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: there(m) & fails(m)
    share = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.when(fails(x["mask"]), (x["n"] * _shapley(x)).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: there(m) & ~fails(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & ~there(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    return audit(masks(docs, labels, id_col, text_col, part_col))
