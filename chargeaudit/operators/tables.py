"""Operators on stored tables: unions with provenance, upserts, ownership, merges of pages and bills, adjusted rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new rows by key; new values win where they are not null."""
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    j = old.join(n, old[key] == n["_key"], "full")
    return j.select(F.coalesce(key, "_key").alias(key), *[F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key])


def united(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Lists under one another, each row with the name of its source."""
    out = None
    for name, df in sources:
        part = df.withColumn("data_source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def name_index(prices: DataFrame) -> DataFrame:
    """name key -> price rows: names in lower case, and synonyms of the same row."""
    keys = F.array_distinct(F.array(F.lower("name"), F.lower(F.concat_ws(" ", F.split_part("name", F.lit(" "), F.lit(2)), F.split_part("name", F.lit(" "), F.lit(1))))))
    return prices.select(F.explode(keys).alias("key"), "code", "rate")


def substring_fallback(names: DataFrame, index: DataFrame) -> DataFrame:
    """names (name) that no key equals, with the keys that hold them.

    A name meets the keys that hold its first letters, three of them if it has so many, and is then looked for in those.
    """
    keys = index.select("key").distinct()
    exact = names.join(keys.select(F.col("key").alias("name")).hint("merge"), "name", "left_anti")

    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - (n - 1), F.lit(1))), lambda i: F.substr("key", i, F.lit(n)))

    held = keys.select("key", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *map(pieces, (1, 2, 3))))).alias("_piece"))
    asked = exact.select("name", F.substring("name", 1, 3).alias("_piece"))
    return asked.join(held.hint("merge"), "_piece").filter(F.contains(F.col("key"), F.col("name"))).select("name", "key")


def merged_bills(bills: DataFrame, group: Column) -> DataFrame:
    """Bills of one upload: total, earliest date, joined numbers, count, and the first bill's fields."""
    per = bills.groupBy(group.alias("upload_id")).agg(
        F.count("*").alias("n_bills"), F.sum("bill_total").cast("double").alias("total"), F.min("bill_date").cast("string").alias("first_date"),
        F.array_join(F.transform(F.array_sort(F.collect_list("bill_id")), lambda x: x.cast("string")), ", ").alias("numbers"), F.min_by("department", "bill_id").alias("department"),
    )
    return per


def consolidated(lines: DataFrame, parts: DataFrame, bills: DataFrame, key: str = "upload_id", page: str = "page", number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines of each upload tagged with their bill, and one row per upload: what its readable bills add up to, with a warning for the others.

    ``parts`` (key, part, first, last) are ranges of pages; a line belongs to the part whose range holds its page, by one join on
    the upload and the range.  ``bills`` (key, part, number, bill_date, total, readable) has one row for each part; lines of bills that
    could not be read are left out, and so are lines of no part.  An upload of no readable bill has no total.
    Lines of a page may come as one row, their amounts summed and their number in the column ``number``.
    """
    read = bills.filter(F.coalesce("readable", F.lit(False))).select(key, "part")
    p = parts.join(read.hint("merge"), [key, "part"]).select(F.col(key).alias("_key"), F.col("part").alias("source_bill"), "first", "last")
    tagged = lines.join(p.hint("merge"), (lines[key] == p["_key"]) & (lines[page] >= p["first"]) & (lines[page] <= p["last"])).drop("_key", "first", "last")
    ok = F.coalesce("readable", F.lit(False))
    own = F.array_sort(F.collect_list(F.when(ok, F.struct("part", F.coalesce(F.col("number").cast("string"), F.lit("?")).alias("number")))))
    failed = F.array_sort(F.collect_list(F.when(~ok, F.col("part"))))
    per = bills.groupBy(key).agg(F.count("*").alias("n_bills"), F.count_if(ok).alias("n_read"), F.sum(F.when(ok, F.col("total"))).alias("total"), F.min(F.when(ok, F.col("bill_date"))).cast("string").alias("first_date"), own.alias("_own"), failed.alias("_failed"))
    n_lines = tagged.groupBy(F.col(key).alias("_key")).agg((F.sum(number) if number else F.count("*")).alias("n_lines"), F.sum("amount").alias("lines_total"))
    warning = F.when(F.col("n_read") == 0, F.format_string("All %d bills failed", "n_bills")).when(
        F.size("_failed") > 0, F.format_string("%d of %d bills could not be read (%s); %d are shown", F.size("_failed"), "n_bills", F.array_join(F.transform("_failed", lambda x: x.cast("string")), ", "), "n_read")
    )
    joined = per.join(n_lines.hint("merge"), per[key] == n_lines["_key"], "left")
    out = joined.select(
        key, "n_bills", "n_read", F.col("total").cast("double").alias("total"), "first_date", F.array_join(F.transform("_own", lambda x: x["number"]), ", ").alias("numbers"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.col("lines_total").cast("double"), F.lit(0.0)).alias("lines_total"), warning.alias("warning"),
    )
    return tagged, out


def merged_pages(pages: DataFrame, key: str, order: str) -> DataFrame:
    """Pages of one bill: fields of the first, all lines, and the first page's total or else the sum of all."""
    per = pages.groupBy(key).agg(F.min_by("page_total", order).alias("_first"), F.sum("page_amount").alias("_sum"), F.count("*").alias("n_pages"))
    return per.select(key, "n_pages", F.coalesce(F.nullif("_first", F.lit(0).cast("decimal(12,2)")), F.col("_sum")).cast("double").alias("total"))


def owned(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Only rows whose key an owner row has."""
    return rows.join(owners.select(key).distinct(), key, "left_semi")


def adjusted(items: DataFrame, factors: list[tuple[str, dict[str, str]]], rate: str = "rate") -> Column:
    """A rate times one factor for each dimension; values without a factor leave it as it is."""
    out = F.col(rate).cast("double")
    for column, table in factors:
        out = out * F.coalesce(*[F.when(F.col(column) == k, F.lit(float(v))) for k, v in table.items()], F.lit(1.0))
    return out


def components(prices: DataFrame) -> DataFrame:
    """Per device the sum of its components' highest prices, and their number."""
    top = prices.groupBy("device", "component").agg(F.max("price").alias("price"))
    return top.groupBy("device").agg(F.sum("price").cast("double").alias("total"), F.count("*").alias("n_components"))


def sentinel_mean(values: Column, sentinel: float = -1.0) -> Column:
    return F.avg(F.nullif(values, F.lit(sentinel)))


def dispute_text(gap: Column, reported: Column) -> Column:
    return F.when(reported.isNull(), "cannot reconcile").when(F.abs(gap) < 1, "exact match").when(gap > 1, F.concat(F.lit("sum exceeds reported by "), F.format_number(gap, 0))).otherwise(F.concat(F.lit("sum less than reported by "), F.format_number(-gap, 0)))
