"""Which dates are complete for a set of assets, by bitmaps: an asset's dates are bits of 64-bit words, a rebalance's common
dates the bits that all its assets have. Only those of the dates before a rebalance that its figures need are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.functions.columns import month_of, not_finite

WORD = 64


def numbered_dates(dates: DataFrame) -> DataFrame:
    """Rows date, i: the distinct dates, numbered from 0 by counts of the months before."""
    days = dates.select("date").distinct().withColumn("month", month_of(F.col("date")))
    months = days.groupBy("month").agg(F.count("*").alias("n"))
    months = months.agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("m"))  # a row per month
    sums = F.aggregate("m", F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["n"])))
    before = months.select(F.posexplode("m").alias("k", "x"), sums.alias("sums")).select("x.month", F.get("sums", F.col("k")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("month").orderBy("date"))
    return days.join(F.broadcast(before), "month").select("date", (F.col("before") + inside - 1).cast("int").alias("i"))


def bitmaps(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Rows asset, word, there, bad: a bit for each date with a price, and one for each whose price isn't finite and positive."""
    rows = panel.filter("price is not null and not isnan(price)").join(F.broadcast(days), "date")  # a row per date
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % WORD)
    odd = (F.col("price") <= 0) | not_finite(F.col("price"))
    return rows.groupBy("asset", F.floor(F.col("i") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("there"), F.bit_or(F.when(odd, bit).otherwise(F.lit(0).cast("long"))).alias("bad"))


def _bits(word: Column, bits: Column) -> Column:
    """The numbers of the dates whose bits are set."""
    places = F.sequence(F.lit(0), F.lit(WORD - 1))
    return F.transform(F.filter(places, lambda k: F.call_function("shiftrightunsigned", bits, k).bitwiseAND(F.lit(1)) == 1), lambda k: word * WORD + k)


def common_dates(maps: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: rid, asset. Rows rid, word, there, bad: the dates on which all assets of a rebalance have prices, and those of
    them on which one isn't finite and positive. A word that one asset lacks is zero for all."""
    sizes = chosen.groupBy("rid").agg(F.count("*").alias("assets"))
    words = chosen.join(maps, "asset").groupBy("rid", "word").agg(F.bit_and("there").alias("there"), F.bit_or("bad").alias("bad"), F.count("*").alias("n"))
    whole = words.join(F.broadcast(sizes), "rid").filter(F.col("n") == F.col("assets"))  # a row per rebalance
    return whole.select("rid", "word", "there", F.col("bad").bitwiseAND(F.col("there")).alias("bad")).filter("there <> 0")


def needed_dates(panel: DataFrame, dates: DataFrame, chosen: DataFrame, moments: DataFrame, lead: int) -> DataFrame:
    """Rows rid, date, common, bad: of each rebalance's common dates before it those of its estimation months and the last
    `lead` before these; how many common dates there are before it, and whether a price on one of them is bad. Rebalances
    and dates make at most a row for each pair; words of dates carry them until then."""
    days = numbered_dates(dates.select("date").union(panel.select("date").distinct()))
    opened = days.groupBy(month_of(F.col("date")).alias("m0")).agg(F.min("i").alias("open"))
    until = moments.select("rid", "m0", F.col("eff").alias("date")).join(F.broadcast(days), "date").select("rid", "m0", F.col("i").alias("until"))
    spans = until.join(F.broadcast(opened), "m0").select("rid", "open", "until")
    words = common_dates(bitmaps(panel, days), chosen).join(F.broadcast(spans), "rid")
    first = F.col("word") * WORD
    # bits of dates before the rebalance, and before its window
    below = lambda end: F.when(end - first >= WORD, F.lit(-1).cast("long")).when(end <= first, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), end - first) - 1)
    words = words.filter(first < F.col("until")).select("rid", "word", F.col("there").bitwiseAND(below(F.col("until"))).alias("there"), F.col("bad").bitwiseAND(below(F.col("until"))).alias("bad"), below(F.col("open")).alias("before"))
    words = words.withColumn("outside", F.bit_count(F.col("there").bitwiseAND(F.col("before"))))
    by_rid = Window.partitionBy("rid")
    later = F.sum("outside").over(by_rid.orderBy(F.desc("word"))) - F.col("outside")
    words = words.select("*", later.alias("later"), F.sum(F.bit_count("there")).over(by_rid).alias("common"), F.max(F.col("bad") != 0).over(by_rid).alias("any_bad"))
    # of the dates before the window, a word keeps its last `lead` less those of later words
    room = F.greatest(F.lit(0), F.lit(lead) - F.col("later")).cast("int")
    old = _bits(F.col("word"), F.col("there").bitwiseAND(F.col("before")))
    new = _bits(F.col("word"), F.col("there").bitwiseAND(F.bitwise_not("before")))
    kept = F.concat(F.slice(old, F.greatest(F.size(old) - room + 1, F.lit(1)), room), new)
    rows = words.filter((F.col("later") < lead) | (F.col("before") != -1)).select("rid", F.explode(kept).alias("i"), "common", F.col("any_bad").alias("bad"))
    return rows.join(F.broadcast(days), "i").select("rid", "date", "common", "bad")
