"""Checks that tell an edge from luck: audits, overfitting, redundancy, plateaus, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import exact_text, fixed
from ..session import written
from ..sources.price_table import PriceTable
from .scoring import fold_trade_counts, profit_ranks, sample_adequacy_gate

TRADE_KEY = ["symbol", "fold", "entry_date", "exit_date"]


# ---- audits -----------------------------------------------------------------------
def audit_sample(trades: DataFrame, folds: DataFrame) -> DataFrame:
    """Killed below 30 trades or when active in fewer than half of the folds."""
    return sample_adequacy_gate(fold_trade_counts(trades, folds)).select(
        "strategy", "total_trades", "empty_folds", "min_fold_trades",
        F.when(F.col("passed"), "survived").otherwise("killed").alias("verdict"))


def profit_gini(trades: DataFrame) -> DataFrame:
    """Gini of the winning trades: 0 = even, towards 1 = one trade carries all."""
    ranks = profit_ranks(trades)
    sizes = ranks.groupBy("strategy").agg(F.count_if(F.col("profit") > 0).alias("w"))
    place = F.col("pos") - (F.col("group_rows") - F.col("w")) + 1
    win = F.col("profit") > 0
    sums = ranks.join(sizes, "strategy").groupBy("strategy").agg(
        F.max("w").alias("w"), F.sum(F.when(win, F.col("profit"))).alias("t"),
        F.sum(F.when(win, place * F.col("profit"))).alias("wt"))
    w = F.col("w").cast("double")
    return sums.select("strategy", F.coalesce(
        F.try_divide(2 * F.col("wt"), w * F.col("t")) - F.try_divide(w + 1, w), F.lit(0.0)).alias("profit_gini"))


def audit_concentration(trades: DataFrame, period_profits: DataFrame | None = None) -> DataFrame:
    """What remains without the best trade, fold and symbol.

    Totals come from one aggregation per (strategy, fold, symbol), so a hot strategy is combined before
    it meets.  ``period_profits`` (strategy, fold, profit) replace fold sums where they cover exactly
    the strategy's folds.
    """
    cells = trades.groupBy("strategy", "fold", "symbol").agg(
        F.sum("profit").alias("p"), F.max("profit").alias("top"), F.count(F.lit(1)).alias("n"))
    by_fold = cells.groupBy("strategy", "fold").agg(
        F.sum("p").alias("p"), F.max("top").alias("top"), F.sum("n").alias("n"))
    whole = by_fold.groupBy("strategy").agg(
        F.sum("p").alias("total"), F.max("top").alias("best_trade"), F.sum("n").alias("trades"),
        F.max("p").alias("best_fold"), F.sum("p").alias("fold_total"),
        F.array_sort(F.collect_set("fold")).alias("_names"))
    if period_profits is not None:
        periods = period_profits.groupBy("strategy").agg(
            F.max("profit").alias("_best"), F.sum("profit").alias("_sum"),
            F.array_sort(F.collect_set("fold")).alias("_periods"))
        aligned = F.col("_periods").isNotNull() & (F.col("_periods") == F.col("_names"))
        whole = whole.join(periods, "strategy", "left").withColumn(
            "best_fold", F.when(aligned, F.col("_best")).otherwise(F.col("best_fold"))).withColumn(
            "fold_total", F.when(aligned, F.col("_sum")).otherwise(F.col("fold_total")))
    best_symbol = cells.groupBy("strategy", "symbol").agg(F.sum("p").alias("p")).groupBy("strategy").agg(
        F.max("p").alias("best_symbol"))
    rest = whole.join(best_symbol, "strategy").withColumn(
        "without_trade", F.col("total") - F.col("best_trade")).withColumn(
        "without_fold", F.col("fold_total") - F.col("best_fold")).withColumn(
        "without_symbol", F.col("total") - F.col("best_symbol"))
    heavy = (F.col("total") > 0) & (F.try_divide("best_trade", "total") > F.lit(K.MAX_SINGLE_TRADE_SHARE))
    verdict = (
        F.when((F.col("without_trade") <= 0) | (F.col("without_fold") <= 0), "killed")
        .when(heavy | (F.col("without_symbol") <= 0), "weakened").otherwise("survived"))
    return rest.select(
        "strategy", "trades", fixed(F.col("total")).alias("total_profit"), fixed(F.col("best_trade")).alias("best_trade_profit"),
        fixed(F.col("without_trade")).alias("profit_without_best_trade"),
        fixed(F.col("without_fold")).alias("profit_without_best_fold"),
        fixed(F.col("without_symbol")).alias("profit_without_best_symbol"), verdict.alias("verdict"))


def audit_verdict(sample: DataFrame, concentration: DataFrame) -> DataFrame:
    """Worst verdict of both audits per strategy."""
    severity = F.when(F.col("verdict") == "killed", 2).when(F.col("verdict") == "weakened", 1).otherwise(0)
    both = sample.select("strategy", "verdict").unionByName(concentration.select("strategy", "verdict"))
    worst = both.groupBy("strategy").agg(F.max(severity).alias("s"))
    return worst.select("strategy", F.element_at(
        F.array(F.lit("survived"), F.lit("weakened"), F.lit("killed")), F.col("s") + 1).alias("verdict"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("strategies"))


# ---- fold vectors -----------------------------------------------------------------
def fold_vectors(fold_scores: DataFrame) -> DataFrame:
    """One row per strategy: fold names (the signature) and scores in name order."""
    points = F.array_sort(F.collect_list(F.struct("fold", "score")))
    return fold_scores.groupBy("strategy").agg(points.alias("p")).select(
        "strategy", F.array_join(F.transform("p", lambda x: x["fold"]), ",").alias("signature"),
        F.size("p").alias("folds"), F.transform("p", lambda x: x["score"]).alias("scores"))


def fold_signature(fold_scores: DataFrame) -> DataFrame:
    """Signature per strategy, the size of its group, and whether the group is the dominant one."""
    vectors = fold_vectors(fold_scores).select("strategy", "signature", "folds")
    groups = vectors.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.max("folds").alias("f"))
    key = F.struct(-F.col("members"), -F.col("f"), F.col("signature"))
    top = groups.agg(F.min_by("signature", key).alias("dominant"))
    return vectors.join(groups.select("signature", "members"), "signature").join(F.broadcast(top)).select(
        "strategy", "signature", "folds", "members", (F.col("signature") == F.col("dominant")).alias("is_dominant"))


def best_per_lineage(entries: DataFrame) -> DataFrame:
    """Highest score per lineage, the first entry id on ties (lineage, entry, score)."""
    key = F.struct(-F.coalesce("score", F.lit(float("-inf"))), F.col("entry"))
    return entries.groupBy("lineage").agg(F.min_by(F.struct("entry", "score"), key).alias("e")).select("lineage", "e.*")


def pair_lineages(vectors: DataFrame, others: DataFrame | None = None, cell: int = 200) -> DataFrame:
    """Unordered pairs of strategies with the same fold signature, with both score vectors.

    With ``others`` only pairs of one strategy of each table.  The pair table is the report itself, so its
    size is that of the answer.  A signature is cut into a grid of cells of about ``cell`` strategies a side;
    each strategy goes to one row and one column of cells, and a cell joins only its own two slices, so one
    large signature is spread over many tasks, with no cross join.
    """
    both = vectors if others is None else vectors.unionByName(others)
    sides = both.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(cell))).alias("_grid"))
    cells = F.sequence(F.lit(0).cast("bigint"), F.col("_grid") - 1)
    slot = F.pmod(F.xxhash64("strategy"), F.col("_grid"))

    def side(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        return rows.join(sides, "signature").select(
            "signature", F.col("strategy").alias(name), F.col("scores").alias(f"{name}_scores"), slot.alias(own),
            F.explode(cells).alias(other))

    left, right = side(vectors, "a", "_row", "_col"), side(vectors if others is None else others, "b", "_col", "_row")
    met = left.join(right, ["signature", "_row", "_col"]).drop("_row", "_col")
    if others is None:
        return met.where(F.col("a") < F.col("b"))
    first = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.where(F.col("a") != F.col("b")).select(
        "signature", pick("a", "b", "a"), pick("a_scores", "b_scores", "a_scores"), pick("b", "a", "b"),
        pick("b_scores", "a_scores", "b_scores"))


def pearson(a: Column, b: Column) -> Column:
    """Two-pass correlation of two short arrays; null for a constant one or fewer than two points."""
    n = F.size(a)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    mean_a, mean_b = F.try_divide(total(a), n), F.try_divide(total(b), n)
    da, db = F.transform(a, lambda x: x - mean_a), F.transform(b, lambda x: x - mean_b)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    return F.when(n >= 2, F.try_divide(product(da, db), F.sqrt(product(da, da) * product(db, db))))


def fold_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("r", pearson(F.col("a_scores"), F.col("b_scores")))


def trade_overlap(trades: DataFrame, pairs: DataFrame, few: int = 16) -> DataFrame:
    """Shared trades and Jaccard index of each pair (a, b).

    Trades cross once, by their key, and each key lists the strategies that hold it, without repeats.  Keys of one holder
    are done with; up to ``few`` holders are counted as pairs where they lie.  Of more, a pair takes the trades of its
    first strategy to those of its second, so that no trade makes more pairs than are asked for.
    """
    held = written(trades.select("strategy", *TRADE_KEY).repartition(*TRADE_KEY).groupBy(*TRADE_KEY).agg(
        F.array_sort(F.collect_set("strategy")).alias("_by")), "held")
    sizes = held.select(F.explode("_by").alias("strategy")).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    whole = held.where(F.expr(" AND ".join(f"{name} IS NOT NULL" for name in TRADE_KEY)))  # a missing value equals none
    after = lambda x, i: F.transform(F.slice("_by", i + 2, F.size("_by")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    near = whole.where(F.size("_by").between(2, few)).select(F.inline(F.flatten(F.transform("_by", after)))).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("s"))
    keys = whole.where(F.size("_by") > few).select(F.explode("_by").alias("strategy"), *TRADE_KEY)
    asked = pairs.select("a", "b").distinct().join(keys.withColumnRenamed("strategy", "a"), "a")
    far = asked.join(keys.withColumnRenamed("strategy", "b"), ["b", *TRADE_KEY]).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("s"))
    either = lambda rows: rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    shared = either(near).unionByName(far).groupBy("a", "b").agg(F.sum("s").alias("s"))
    counted = pairs.select("a", "b").join(shared, ["a", "b"], "left").join(
        sizes.select(F.col("strategy").alias("a"), F.col("n").alias("_na")), "a").join(
        sizes.select(F.col("strategy").alias("b"), F.col("n").alias("_nb")), "b")
    both = F.coalesce("s", F.lit(0))
    return counted.select("a", "b", both.alias("shared_trades"), F.coalesce(F.try_divide(
        both.cast("double"), F.col("_na") + F.col("_nb") - both), F.lit(0.0)).alias("jaccard"))


def redundant_pairs(intervals: DataFrame, overlap: DataFrame, correlation: float = K.REDUNDANCY_CORRELATION,
                    max_jaccard: float = K.REDUNDANCY_MAX_JACCARD) -> DataFrame:
    """Pairs with their interval and overlap; flagged when surely correlated yet sharing few trades."""
    sure = F.coalesce(F.col("lower") >= F.lit(correlation), F.lit(False))
    return intervals.join(overlap, ["a", "b"]).select(
        "a", "b", "r", "lower", "upper", "shared_trades", "jaccard",
        (sure & (F.col("jaccard") <= F.lit(max_jaccard))).alias("flagged"))


def surely_redundant(pairs: DataFrame, trades: DataFrame, correlation: float = K.REDUNDANCY_CORRELATION,
                     max_jaccard: float = K.REDUNDANCY_MAX_JACCARD) -> DataFrame:
    """The flagged pairs (a, b) of ``redundant_pairs``, without intervals and overlaps of the others.

    Resampling a pair ends as soon as more resamples lie below ``correlation`` than an interval whose lower end reaches
    it can have; trades are compared for pairs that are sure only.
    """
    from .resample import surely_correlated

    sure = surely_correlated(fold_correlation(pairs), correlation).where("sure").select("a", "b")
    sure = written(sure, "sure")
    return sure.join(trade_overlap(trades, sure), ["a", "b"]).where(F.col("jaccard") <= F.lit(max_jaccard)).select(
        "a", "b", F.lit(True).alias("flagged"))


# ---- overfitting ------------------------------------------------------------------
def pbo(vectors: DataFrame) -> DataFrame:
    """Probability of backtest overfitting per fold signature.

    Splits are rows of their own, made once per fold count from the two halves of their bits, and meet the
    candidates by a join on the fold count; the winner of a split and its test rank are aggregations on
    (signature, split).  Null with fewer than two candidates or four folds.
    """
    usable = vectors.where(F.col("folds") >= 4)
    half, low = F.floor(F.col("folds") / 2), F.floor(F.col("folds") / 2).cast("int")
    bits = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2.0), count).cast("bigint") - 1))
    splits = (usable.select("folds").distinct().withColumn("_low", low).withColumn("_a", bits(F.col("_low")))
              .repartition("folds", "_a").withColumn("_b", bits(F.col("folds") - F.col("_low")))
              .where(F.bit_count("_a") + F.bit_count("_b") == half)
              .select("folds", (F.col("_a") + F.col("_b") * F.pow(F.lit(2.0), F.col("_low")).cast("bigint")).alias("split")))
    rows = usable.join(splits.hint("merge"), "folds")

    def side(bit: int, size: Column) -> Column:
        picked = F.transform("scores", lambda x, i: F.when(
            F.getbit(F.col("split"), i) == bit, x).otherwise(F.lit(0.0)))
        return F.aggregate(picked, F.lit(0.0), lambda acc, x: acc + x) / size

    scored = rows.select("signature", "folds", "strategy", "split", side(1, half).alias("train"),
                         side(0, F.col("folds") - half).alias("test"))
    winner = scored.groupBy("signature", "split").agg(
        F.min_by("test", F.struct(-F.col("train"), F.col("strategy"))).alias("win_test"))
    ranked = scored.join(winner, ["signature", "split"]).groupBy("signature", "split").agg(
        F.max("folds").alias("folds"), F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("test") <= F.col("win_test")).alias("below"))
    overfit = F.col("below") / F.col("candidates") <= F.lit(0.5)
    return ranked.groupBy("signature").agg(
        F.max("candidates").alias("candidates"), F.max("folds").alias("folds"), F.count(F.lit(1)).alias("splits"),
        F.count_if(overfit).alias("overfit")).select(
        "signature", "candidates", "folds", "splits",
        F.when(F.col("candidates") >= 2, F.col("overfit") / F.col("splits")).alias("probability"))


# ---- plateaus ---------------------------------------------------------------------
def plateau_neighbours(points: DataFrame) -> DataFrame:
    """Pairs of parameter points (campaign, point, neighbour, neighbour_score) that are equal or one
    step apart in exactly one parameter.

    ``points`` has (campaign, point, params map<string,string>, score).  For each parameter the other
    values form a key; points one rank apart under the same key meet by an equi join.
    """
    long = points.select("campaign", "point", "score", "params", F.explode("params").alias("name", "value"))
    number = F.expr("try_cast(value AS double)")
    domain = Window.partitionBy("campaign", "name").orderBy(number.asc_nulls_last(), "value")
    ranks = long.select("campaign", "name", "value").distinct().withColumn("rank", F.row_number().over(domain))
    others = F.to_json(F.array_sort(F.map_entries(F.map_filter("params", lambda k, v: k != F.col("name")))))
    placed = long.withColumn("rest", others).join(ranks, ["campaign", "name", "value"]).select(
        "campaign", "name", "rest", "rank", "point", "score")
    theirs = placed.select("campaign", "name", "rest", F.explode(F.array(
        F.col("rank") - 1, F.col("rank") + 1)).alias("rank"), F.col("point").alias("neighbour"),
        F.col("score").alias("neighbour_score"))
    near = placed.join(theirs, ["campaign", "name", "rest", "rank"]).select(
        "campaign", "point", "neighbour", "neighbour_score")
    whole = points.withColumn("_v", F.to_json(F.array_sort(F.map_entries("params"))))
    same = whole.select("campaign", "_v", "point").join(whole.select(
        "campaign", "_v", F.col("point").alias("neighbour"), F.col("score").alias("neighbour_score")),
        ["campaign", "_v"]).drop("_v")
    return near.unionByName(same)


def stable_parameter(points: DataFrame) -> DataFrame:
    """The point with most neighbours, then best neighbourhood median, then best score, per campaign."""
    around = plateau_neighbours(points).groupBy("campaign", "point").agg(
        F.count(F.lit(1)).alias("neighbourhood_size"), F.median("neighbour_score").alias("stability_score"))
    rated = points.join(around, ["campaign", "point"]).withColumn(
        "_v", F.to_json(F.array_sort(F.map_entries("params"))))
    key = F.struct(-F.col("neighbourhood_size"), -F.col("stability_score"), -F.col("score"), F.col("_v"))
    return rated.groupBy("campaign").agg(F.min_by(F.struct(
        "point", "score", "stability_score", "neighbourhood_size"), key).alias("b")).select("campaign", "b.*")


# ---- selection --------------------------------------------------------------------
def same_basis(candidates: DataFrame, reference_basis: DataFrame) -> DataFrame:
    """Candidates whose scoring basis equals the reference row's (both have ``basis``)."""
    return candidates.join(reference_basis.select("basis").distinct(), "basis", "left_semi")


def scoring_basis(fold_ranges: DataFrame) -> DataFrame:
    """Basis text per strategy: scoring model and ordered fold ranges (strategy, model, start, end)."""
    ranges = F.array_sort(F.collect_list(F.struct("start", "end")))
    return fold_ranges.groupBy("strategy").agg(
        F.to_json(F.struct(F.max("model").alias("model"), ranges.alias("ranges"))).alias("basis"))


def best_survivor(scored: DataFrame) -> DataFrame:
    """Highest finite score that was not killed, ties by name (strategy, score, verdict)."""
    fine = scored.where((F.col("verdict") != "killed") & F.col("score").isNotNull() & ~F.isnan("score")
                        & (F.abs("score") < F.lit(float("inf"))))
    return fine.agg(F.min_by(F.struct("strategy", "score", "verdict"), F.struct(-F.col("score"), F.col("strategy")))
                    .alias("b")).where(F.col("b").isNotNull()).select("b.*")


def diverse_partner(scored: DataFrame, correlations: DataFrame) -> DataFrame:
    """The best eligible strategy that has a partner, and its least correlated partner of another family.

    ``scored`` is (strategy, family, score, verdict).  Champions are tried in score order: the first
    whose family is not the only one wins, found from the best score per family; no pairs are made.
    """
    eligible = scored.where((F.col("verdict") != "killed") & (F.col("score") > 0)).select("strategy", "family", "score")
    key = F.struct(-F.col("score"), F.col("strategy"))
    families = eligible.agg(F.count_distinct("family").alias("families"))
    champion = eligible.agg(F.min_by(F.struct("strategy", "family"), key).alias("c")).select(
        F.col("c.strategy").alias("champion"), F.col("c.family").alias("champion_family"))
    lookup = correlations.select(F.col("a").alias("champion"), F.col("b").alias("strategy"), "r").unionByName(
        correlations.select(F.col("b").alias("champion"), F.col("a").alias("strategy"), "r"))
    others = eligible.join(F.broadcast(champion)).where(F.col("family") != F.col("champion_family")).join(
        lookup, ["champion", "strategy"], "left")
    pick = F.struct(F.col("r").isNull(), F.coalesce("r", F.lit(0.0)), -F.col("score"), F.col("strategy"))
    best = others.agg(F.min_by(F.struct("champion", F.col("strategy").alias("partner"), "r", "score"), pick).alias("p"))
    return best.join(F.broadcast(families)).where(F.col("p").isNotNull() & (F.col("families") > 1)).select("p.*")


def weakest_strategy(scored: DataFrame) -> DataFrame:
    """A strategy without a score, else the lowest one (ties by name)."""
    key = F.struct(F.col("score").isNotNull(), F.coalesce("score", F.lit(0.0)), F.col("strategy"))
    return scored.agg(F.min_by(F.struct("strategy", "score"), key).alias("w")).select("w.*")


# ---- admission --------------------------------------------------------------------
DIGEST = [f"s{i}" for i in range(4)]


def row_sums(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows and sums of the four parts of their hashes, per group: what a fingerprint is made of.

    Sums combine before the shuffle, so no group is gathered or sorted, and sums of groups add up to those of their union.
    """
    kinds = dict(rows.dtypes)
    text = lambda c: exact_text(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    row = F.sha2(F.concat_ws("|", *[F.coalesce(text(c), F.lit("~")) for c in columns]), 256)
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(DIGEST[i])
    hashed = rows.select(*keys, row.alias("h")).select(*keys, *[part(i) for i in range(len(DIGEST))])
    # 60 bits a part: summed as two halves, which are bigints, and put together as decimals once a group.
    halves = [F.sum(x).alias(f"{name}_{half}") for name in DIGEST for half, x in (
        ("high", F.shiftright(name, 30)), ("low", F.col(name).bitwiseAND(F.lit(2**30 - 1))))]
    whole = lambda name: (F.col(f"{name}_high").cast("decimal(20,0)") * F.lit(2**30).cast("decimal(10,0)")
                          + F.col(f"{name}_low").cast("decimal(20,0)")).cast("decimal(38,0)").alias(name)
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *halves).select(*keys, "rows", *[whole(name) for name in DIGEST])


def fingerprints(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprint per group from sums of its parts (rows that ``row_sums`` gave for finer keys, or the same)."""
    whole = sums.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.sum(name).alias(name) for name in DIGEST])
    return whole.select(*keys, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[
        F.col(name).cast("decimal(38,0)").cast("string") for name in DIGEST]), 256).alias("fingerprint"))


def trade_fingerprint(trades: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One fingerprint per group that ignores row order: equal multisets, equal fingerprints."""
    keys = keys or ["strategy"]
    return fingerprints(row_sums(trades, keys, columns or TRADE_KEY), keys)


def dataset_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``row_sums`` over all other columns; a value that is not finite is an error."""
    columns = [name for name in rows.columns if name not in keys]
    checked = rows
    for name, kind in rows.dtypes:
        if kind in ("double", "float") and name in columns:
            bad = F.isnan(name) | (F.abs(F.col(name)) == F.lit(float("inf")))
            checked = checked.withColumn(name, F.when(~F.coalesce(bad, F.lit(False)), F.col(name)).otherwise(
                F.raise_error(F.lit(f"not finite: {name}")).cast("double")))
    return row_sums(checked, keys, columns)


def dataset_fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Content fingerprint per group over all other columns, doubles by their bits."""
    return fingerprints(dataset_sums(rows, keys), keys)


def price_sums(bars: DataFrame) -> DataFrame:
    """Leaves of the digest tree of a price table: sums per symbol and year."""
    return dataset_sums(bars.withColumn("year", F.year("bar_date")), ["symbol", "year"])


def digest_tree(sums: DataFrame) -> DataFrame:
    """Fingerprints by level: ``leaf`` (symbol and year), ``symbol``, ``table``; one aggregation of the leaves."""
    whole = sums.groupingSets([["symbol", "year"], ["symbol"], []], "symbol", "year").agg(
        F.sum("rows").alias("rows"), *[F.sum(name).alias(name) for name in DIGEST],
        F.grouping("year").alias("_y"), F.grouping("symbol").alias("_s"))
    level = F.when(F.col("_s") == 1, "table").when(F.col("_y") == 1, "symbol").otherwise("leaf")
    return whole.select(level.alias("level"), "symbol", "year", "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[
        F.col(name).cast("decimal(38,0)").cast("string") for name in DIGEST]), 256).alias("fingerprint"))


def refreshed_sums(table: PriceTable, known: DataFrame, since: int, version: int | None = None) -> DataFrame:
    """Leaves of a version of the table from those of version ``since``: only years that changed are read again."""
    years = table.changed_years(since, version)
    if not years:
        return known
    return known.where(~F.col("year").isin(years)).unionByName(price_sums(table.read(version, years)))


def scoring_basis_changed(current: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose fingerprint is new, gone or different."""
    joined = current.select(*keys, F.col("fingerprint").alias("_now")).join(
        stored.select(*keys, F.col("fingerprint").alias("_then")), keys, "full")
    return joined.select(*keys, (~F.col("_now").eqNullSafe(F.col("_then"))).alias("changed"))


def admit_candidate(candidates: DataFrame, archive: DataFrame, redundant: DataFrame) -> DataFrame:
    """Decision per candidate against the archive.

    Both tables have (strategy, rule_hash, fingerprint); ``redundant`` has flagged pairs (a, b).
    Only the hashes are compared: three equi joins on small rows.
    """
    rule = archive.select("rule_hash").distinct().withColumn("_same_rule", F.lit(True))
    prints = archive.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct().withColumn(
        "_same_trades", F.lit(True))
    flagged = redundant.where("flagged")
    near = flagged.select(F.col("a").alias("strategy"), F.col("b").alias("_other")).unionByName(
        flagged.select(F.col("b").alias("strategy"), F.col("a").alias("_other"))).join(
        archive.select(F.col("strategy").alias("_other")), "_other", "left_semi").select("strategy").distinct().withColumn(
        "_redundant", F.lit(True))
    joined = candidates.join(rule, "rule_hash", "left").join(prints, "fingerprint", "left").join(near, "strategy", "left")
    decision = (F.when(F.col("_same_rule"), "same-rule").when(F.col("_same_trades"), "same-trades")
                .when(F.col("_redundant"), "redundant").otherwise("admitted"))
    return joined.select("strategy", decision.alias("decision"))
