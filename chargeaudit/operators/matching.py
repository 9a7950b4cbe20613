"""Matching of descriptions to benchmarks: by code, by common words, with synonyms; citations, evidence and numbers of issues.

The similarity of two texts is the cosine of their sets of words.  Texts are matched once for each different one, by a join
with a prefix filter: words stand in order of how many names have them, rare ones first, and a pair that is similar enough
shares one of the first words of both, of which there are the fewer the higher ``least`` is.  Words of more than HOT names make no
pairs.  Who shares only such words is found by classes: of names with the same frequent words and number of words only the
first few by name can be among the best, and texts with the same frequent words and number of words have the same best.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.bridge import stored


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


#: Words of more names than this are frequent.
HOT = 64
#: Parts in which the first names of a class are looked for at first.
SALTS = 16


def _first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group, from salted parts first, since a group may hold most rows."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)))
    some = salted.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_turn") <= n)
    return some.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_turn") <= n).drop("_salt", "_turn")


def text_matches(texts: DataFrame, benchmarks: DataFrame, n: int = 1, least: float = 0.0, extra: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """text, rank, name, similarity and the columns ``extra`` of the ``n`` most similar benchmarks (name, ...) of each different text.

    Ties go to the first name, then to the smallest ``extra``.  Texts and names of no common word never match, so neither do nulls and empty ones.
    """
    own = ["name", *extra]
    asked = texts.select("text").distinct().select("text", words_of(F.col("text")).alias("w"))
    listed = benchmarks.select(*own).distinct().select(*own, words_of(F.col("name")).alias("v"))
    names = listed.select(F.explode("v").alias("_w")).groupBy("_w").agg(F.count("*").alias("_df"))
    need = max(least - 1e-4, 0.0) ** 2  # similarities are rounded before they are compared

    def ordered(df: DataFrame, keys: list[str], words: str) -> DataFrame:
        """keys, words, their number ``_n``, and what joins are made of: rare words at the front, and frequent words."""
        each = df.select(*keys, words, F.explode(words).alias("_x"))
        told = each.join(names.hint("merge"), F.col("_x") == F.col("_w"))
        per = told.groupBy(*keys, words).agg(F.array_sort(F.collect_list(F.struct("_df", "_w"))).alias("_known")).withColumn("_n", F.size(words))
        # words that no name has are the rarest and fill the front
        front = F.greatest(F.col("_n") - F.ceil(F.col("_n") * need) + (1 if need else 0) - (F.col("_n") - F.size("_known")), F.lit(0)).cast("int")
        rare = F.filter(F.slice("_known", 1, front), lambda x: x["_df"] <= hot)
        return per.select(*keys, words, "_n", F.transform(rare, lambda x: x["_w"]).alias("_rare"), F.transform(F.filter("_known", lambda x: x["_df"] > hot), lambda x: x["_w"]).alias("_often"))

    a, b = ordered(asked, ["text"], "w"), ordered(listed, own, "v").withColumnRenamed("_n", "_m")
    cosine = lambda shared: F.round(shared / F.sqrt(F.col("_n").cast("double") * F.col("_m")), 4)
    left = a.select("text", "w", "_n", F.explode("_rare").alias("_x"))
    right = b.select(*own, "v", "_m", F.explode("_rare").alias("_y"))
    fits = (F.least("_n", "_m") >= F.greatest("_n", "_m") * need) & (F.col("_x") == F.col("_y"))
    rare = left.join(right.hint("merge"), fits).select("text", *own, cosine(F.size(F.array_intersect("w", "v"))).alias("similarity"))

    often = F.size("_often") > 0
    asking = a.filter(often).select("_often", "_n").distinct()
    answers = _first(b.filter(often).select(F.col("_often").alias("_held"), "_m", *own), ["_held", "_m"], own, n)
    classes = answers.select("_held", "_m").distinct()
    met = asking.withColumn("_x", F.explode("_often")).join(classes.withColumn("_y", F.explode("_held")).hint("merge"), F.col("_x") == F.col("_y"))
    close = met.select("_often", "_n", "_held", "_m", cosine(F.size(F.array_intersect("_often", "_held"))).alias("similarity")).distinct().filter(F.col("similarity") >= least)
    best = _first(close.join(answers.hint("merge"), ["_held", "_m"]), ["_often", "_n"], [F.desc("similarity"), *own], n)
    frequent = a.filter(often).select("text", "_often", "_n").join(best.hint("merge"), ["_often", "_n"]).select("text", *own, "similarity")

    # what shares only frequent words is exact; for others that is too low, and the pair stands among the rare ones too
    scored = rare.union(frequent).groupBy("text", *own).agg(F.max("similarity").alias("similarity")).filter(F.col("similarity") >= least)
    w = Window.partitionBy("text").orderBy(F.desc("similarity"), *own)
    return scored.select("text", *own, "similarity", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= n)


#: Rows of a written table up to which it is broadcast.
SMALL = 100_000


def _beside(left: DataFrame, right: DataFrame, on: Column | str, how: str = "inner") -> DataFrame:
    """``left`` joined with what was found for its different texts, which is written first and broadcast if it turns out small.

    Few texts stand in many lines, and a shuffle by text would bring all lines of a text to one task.
    """
    return left.join(right.hint("broadcast" if right.limit(SMALL + 1).count() <= SMALL else "merge"), on, how)


def code_or_text(items: DataFrame, benchmarks: DataFrame | None, text: str = "description", least: float = 0.0) -> DataFrame:
    """Lines with matched, match_rate and similarity: the benchmark of their code, or else the most similar one by text.

    Only benchmarks with a positive rate are candidates.  Lines without a match keep nulls, and so do all without benchmarks.
    """
    if benchmarks is None:
        return items.select("*", F.lit(None).cast("string").alias("matched"), F.lit(None).cast("decimal(12,2)").alias("match_rate"), F.lit(None).cast("double").alias("similarity"))
    priced = benchmarks.filter("rate > 0")
    # lines without a code find no partner, so they are dealt by what they hold and not all to one task
    of_code = lambda c: F.xxhash64(F.col(c).cast("string"))
    whole = F.xxhash64(*[c for c, t in items.dtypes if "map<" not in t])
    own = priced.groupBy(F.col("code").alias("_code")).agg(F.min("name").alias("_name"), F.min("rate").alias("_rate")).withColumn("_dealt", of_code("_code"))
    dealt = items.withColumn("_deal", F.when(F.col("code").isNull(), whole).otherwise(of_code("code")))
    coded = dealt.join(own.hint("merge"), (dealt["_deal"] == own["_dealt"]) & (dealt["code"] == own["_code"]), "left")
    # the texts alone, apart from the lines' other columns
    unknown = items.filter("code IS NOT NULL").select("code", text).join(own.select("_code").hint("merge"), items["code"] == F.col("_code"), "left_anti")
    rest = items.filter("code IS NULL").select(F.col(text).alias("text")).union(unknown.select(F.col(text)))
    found = stored(text_matches(rest, priced, 1, least, ("rate",)).select(F.col("text").alias("_text"), F.col("name").alias("_near"), F.col("rate").alias("_near_rate"), "similarity"), "texts")
    joined = _beside(coded, found, (coded[text] == found["_text"]) & coded["_code"].isNull(), "left")
    return joined.select(*[coded[c] for c in items.columns], F.coalesce("_name", "_near").alias("matched"), F.coalesce("_rate", "_near_rate").alias("match_rate"), F.when(F.col("_code").isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"))


def best_of_texts(items: DataFrame, benchmarks: DataFrame, texts: tuple[str, ...], least: float = 0.45) -> DataFrame:
    """bill_id, pos and the best benchmark over several texts of a line: by similarity, then the earlier text."""
    return beside_best(items, benchmarks, texts, least).select("bill_id", "pos", "source", F.col("_near_text").alias("text"), F.col("matched").alias("name"), F.col("match_rate").alias("rate"), "similarity")


def beside_best(items: DataFrame, benchmarks: DataFrame, texts: tuple[str, ...], least: float = 0.45, how: str = "inner", keep: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines with source, matched, match_rate and similarity of the best benchmark over several of their texts, which is found once for each different row of texts.

    ``keep``: a condition on the texts and the columns ``by``; lines that don't meet it are left out.  It is judged once for each different
    row too: in every line, a long list of words makes code that the JVM does not compile.
    """
    cols = [*dict.fromkeys((*texts, *by))]
    found, same = _best_for(items, benchmarks, texts, least, how, keep, cols), F.lit(True)
    for i, c in enumerate(cols):
        same = same & items[c].eqNullSafe(found[f"_t{i}"])
    told = [F.col("text").alias("_near_text"), F.col("name").alias("matched"), F.col("rate").alias("match_rate"), "source", "similarity"]
    keys = [f"_t{i}" for i in range(len(cols))]
    return _beside(items, found.select(*keys, *told), same).drop(*keys)


def _best_for(items: DataFrame, benchmarks: DataFrame, texts: tuple[str, ...], least: float, how: str, keep: Column | None, cols: list[str]) -> DataFrame:
    """For each different row of ``cols`` (_t0, _t1, ...; the texts come first) the best benchmark, the text and its place; written.  Rows without one keep nulls if ``how`` is left."""
    told = stored(items.select(*cols).distinct(), "texts")
    keys = [f"_t{i}" for i in range(len(cols))]
    rows = (told if keep is None else told.filter(keep)).select(*[F.col(c).alias(k) for c, k in zip(cols, keys, strict=True)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("source"), F.col(k).alias("text")) for i, k in enumerate(keys[: len(texts)])]))
    asked = rows.select(*keys, each.alias("x")).select(*keys, "x.*")
    near = text_matches(asked, benchmarks.filter("rate > 0"), 1, least, ("rate",)).drop("rank")
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("similarity"), "source")
    best = asked.join(near.hint("merge"), "text", how).select("*", F.row_number().over(w).alias("_turn")).filter("_turn = 1").drop("_turn")
    found = F.col("name").isNotNull()
    return stored(best.withColumns({c: F.when(found, F.col(c)) for c in ("source", "text")}), "texts")


def with_synonym(text: Column, also: Column, synonyms: dict[str, str] = rules.SYNONYMS) -> Column:
    """The text with the first listed abbreviation written out that it, or ``also``, holds; null if it holds none or nothing changes."""
    low, other = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(also, F.lit("")))
    first = F.coalesce(*[F.when(F.contains(low, F.lit(k)) | F.contains(other, F.lit(k)), F.replace(low, F.lit(k), F.lit(v))) for k, v in synonyms.items()])
    return F.when(first != low, first)


def synonym_overcharges(items: DataFrame, benchmarks: DataFrame, also: str, synonyms: dict[str, str] = rules.SYNONYMS, times: float = 1.5) -> DataFrame:
    """Lines whose written-out text has a benchmark that they exceed ``times`` over: bill_id, pos, expanded, matched, billed, benchmark."""
    asked = items.withColumn("text", with_synonym(F.col("description"), F.col(also), synonyms)).filter("text IS NOT NULL")
    found = text_matches(asked, benchmarks.filter("rate > 0"), 1, 0.0, ("rate",))
    j = asked.select("bill_id", "pos", "text", "amount").join(found.hint("merge"), "text")
    return j.filter(F.col("amount").cast("double") > F.col("rate").cast("double") * times).select("bill_id", "pos", F.col("text").alias("expanded"), F.col("name").alias("matched"), F.col("amount").cast("double").alias("billed"), F.col("rate").cast("double").alias("benchmark"))


def evidence(*lines: Column) -> Column:
    """The lines that say something, in order; without a lambda, so that what they are made of is compiled."""
    return F.array_remove(F.array(*[F.when(F.trim(x) != "", x).otherwise("") for x in lines]), "")


def numbered(issues: DataFrame, prefix: str, key: str = "bill_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Issues with ``issue_id``, such as EP_001: their number within the bill."""
    w = Window.partitionBy(key).orderBy(*order)
    return issues.withColumn("issue_id", F.format_string(f"{prefix}_%03d", F.row_number().over(w)))


def episode_issues(items: DataFrame, episode: Column, labels: dict[str, str], components: int = 5) -> DataFrame:
    """One low issue for each episode of a bill, with its share of the bill and its largest components as evidence."""
    whole = F.sum("amount").over(Window.partitionBy("bill_id"))
    marked = items.select("bill_id", "pos", "description", "amount", episode.alias("episode"), whole.alias("_bill")).filter(F.col("episode").isin(*labels))
    per = marked.groupBy("bill_id", "episode").agg(F.sum("amount").alias("billed"), F.count("*").alias("n"), F.max("_bill").alias("_bill"), F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("a"), "pos", "description"))).alias("x"))
    share = F.concat(F.lit("Share of bill: "), F.format_number(F.try_divide(F.col("billed") * 100, F.col("_bill")), 1), F.lit("%"))
    parts = F.transform(F.slice("x", 1, components), lambda x: F.concat(x["description"], F.lit(": ₹"), F.format_number(-x["a"], 2)))
    more = F.when(F.col("n") > components, F.concat(F.lit("and "), F.col("n") - components, F.lit(" more")))
    label = F.coalesce(*[F.when(F.col("episode") == k, F.lit(v)) for k, v in labels.items()])
    out = per.select("bill_id", "pos", F.col("episode").alias("issue_type"), label.alias("description"), F.col("billed").cast("double").alias("billed"), F.lit("low").alias("confidence"), F.concat(evidence(share), parts, evidence(more)).alias("evidence"))
    return numbered(out, "EP", order=("pos", "issue_type"))


def with_citations(issues: DataFrame, query: str, regulations: DataFrame, n: int = 2, least: float = 0.3) -> DataFrame:
    """Issues (evidence) with the regulations (name) nearest to a fixed question added to their evidence, best first.

    The question is one text, so what is joined has one row.
    """
    one = issues.sparkSession.createDataFrame([(query,)], "text string")
    found = text_matches(one, regulations, n, least).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("x"))
    cited = found.select(F.transform("x", lambda x: F.concat(F.lit("Regulation: "), x["name"])).alias("_cited"), F.lit(1).alias("_one"))
    return issues.withColumn("_one", F.lit(1)).join(F.broadcast(cited), "_one", "left").withColumn("evidence", F.concat("evidence", "_cited")).drop("_one", "_cited")


def keyword_issues(issues: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Issues of which type, description or evidence speaks of one of the words."""
    from ..functions.predicates import any_keyword

    return issues.filter(any_keyword(F.concat_ws("; ", "issue_type", "description", "evidence"), words))


def kept_and_dropped(rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The rows to keep, and one row with the numbers kept and dropped; unknown is dropped."""
    ok = F.coalesce(keep, F.lit(False))
    return rows.filter(ok), rows.agg(F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped"))


def kept_while_stored(rows: DataFrame, keep: Column, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """The rows to keep as ``store`` wrote them, and the numbers kept and dropped, counted while they were written: one pass over the rows."""
    ok, seen = F.coalesce(keep, F.lit(False)), Observation()
    kept = store(rows.observe(seen, F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped")).filter(ok))
    return kept, {k: seen.get[k] for k in ("n_kept", "n_dropped")}
