"""Named queries: each applies one operator to the test tables of a folder."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numeric import dot as product
from ..functions.numeric import num_factors
from ..operators import agreement, block_index, block_matrix, linalg, models, prep, search, serving, similar, top_items
from ..session import new_folder, saved, written
from ..sources import readers, store, testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.item_genres(testdata.items(spark, sf_dir))


def _item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.item_tags(testdata.tags(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = saved(prep.split(testdata.ratings(spark, sf_dir)))
    return tuple(rows.where(F.col("split") == side).drop("split") for side in ("train", "test"))


@query
def ratings_scan(spark, sf_dir):
    return testdata.ratings(spark, sf_dir)


@query
def item_genres_explode(spark, sf_dir):
    return _genres(spark, sf_dir)


@query
def genre_counts(spark, sf_dir):
    return prep.genre_counts(_genres(spark, sf_dir))


@query
def genre_ids(spark, sf_dir):
    return prep.numbered(_genres(spark, sf_dir), "genre", "item_id")


@query
def tag_counts_min(spark, sf_dir):
    return prep.tag_uses(testdata.tags(spark, sf_dir))


@query
def item_tag_weights(spark, sf_dir):
    return rounded(_item_tags(spark, sf_dir), "weight")


@query
def tag_ids(spark, sf_dir):
    tags = testdata.tags(spark, sf_dir)
    return prep.numbered(tags.join(prep.tag_uses(tags), "tag", "left_semi"), "tag", "item_id")


@query
def item_medians(spark, sf_dir):
    return prep.item_stats(testdata.ratings(spark, sf_dir))


@query
def item_means(spark, sf_dir):
    return rounded(prep.item_stats(testdata.ratings(spark, sf_dir), "mean"), "center")


@query
def user_degree(spark, sf_dir):
    return prep.degrees(testdata.ratings(spark, sf_dir), "user_id")


@query
def item_degree(spark, sf_dir):
    return prep.degrees(testdata.ratings(spark, sf_dir), "item_id")


@query
def degree_histogram(spark, sf_dir):
    return prep.histogram(user_degree(spark, sf_dir), "n", 0, 100)


@query
def rating_levels(spark, sf_dir):
    return prep.rating_levels(testdata.ratings(spark, sf_dir))


@query
def item_rating_maps(spark, sf_dir):
    """Size and sum of the maps of each item's ratings by user."""
    maps = prep.item_ratings(testdata.ratings(spark, sf_dir), shares=8)
    parts = maps.select("item_id", F.size("ratings").cast("bigint").alias("n"), F.aggregate(F.map_values("ratings"), F.lit(0.0), lambda s, x: s + x).alias("total"))
    return parts.groupBy("item_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query
def rating_spread(spark, sf_dir):
    return rounded(agreement.spread(testdata.ratings(spark, sf_dir), "rating"), "mean")


@query
def title_mismatches(spark, sf_dir):
    """Items whose name isn't the expected one: small parts are expected to be called by their brand."""
    part = testdata.table(spark, sf_dir, "part")
    expected = part.select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.col("p_brand")).alias("title"))
    return prep.mismatches(testdata.items(spark, sf_dir), expected)


def _csv(rows: DataFrame) -> str:
    """rows written as CSV files with a header, as the readers expect them."""
    folder = new_folder(rows.sparkSession, "csv")
    rows.write.csv(folder, header=True, escape='"')
    return folder


@query
def items_csv(spark, sf_dir):
    return readers.read_items(spark, _csv(testdata.items(spark, sf_dir)))


def _rating_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.rating_events(spark, sf_dir).where("rating is not null").select("user_id", "item_id", "rating", F.unix_micros(F.col("event_time").cast("timestamp")).alias("ts"))


@query
def ratings_csv(spark, sf_dir):
    return readers.read_ratings(spark, _csv(_rating_log(spark, sf_dir)))


@query
def ratings_csv_latest(spark, sf_dir):
    return readers.read_ratings(spark, _csv(_rating_log(spark, sf_dir)), last_only=True)


@query
def tags_csv(spark, sf_dir):
    events = testdata.table(spark, sf_dir, "events")
    return readers.read_tags(spark, _csv(events.select("user_id", F.get_json_object("props", "$.k").alias("item_id"), F.upper("event_type").alias("tag"), "ts").where("item_id is not null")))


@query
def links_csv(spark, sf_dir):
    part = testdata.table(spark, sf_dir, "part")
    return readers.read_links(spark, _csv(part.select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")))))


@query
def kept_item_medians(spark, sf_dir):
    """A table that is computed and kept, and then found."""
    path = new_folder(spark, "kept")
    inputs = tuple(f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders"))
    readers.kept(spark, path, lambda: item_medians(spark, sf_dir), inputs=inputs)
    return readers.kept(spark, path, lambda: item_medians(spark, sf_dir).limit(0), inputs=inputs)


@query
def train_test_split(spark, sf_dir):
    return prep.split(testdata.ratings(spark, sf_dir))


@query
def split_eligible_users(spark, sf_dir):
    return user_degree(spark, sf_dir).where("n > 11")


@query
def distinct_rating_users(spark, sf_dir):
    return prep.varied_users(testdata.ratings(spark, sf_dir))


@query
def median_predict(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return models.Median.fit(train).transform(test).where("prediction is not null").select("user_id", "item_id", "rating", "prediction")


@query
def rank_agreement_median(spark, sf_dir):
    return rounded(agreement.rank_agreement(median_predict(spark, sf_dir)), "agreement")


@query
def rank_agreement_summary(spark, sf_dir):
    return rounded(agreement.summarize(agreement.rank_agreement(median_predict(spark, sf_dir))), "mean", "trimmed_mean")


@query
def agreement_histogram(spark, sf_dir):
    return prep.histogram(agreement.rank_agreement(median_predict(spark, sf_dir)), "agreement", 0.0, 1.0)


@query
def mean_error_median(spark, sf_dir):
    return rounded(agreement.mean_error(median_predict(spark, sf_dir)), "mae")


@query
def similar_pairs(spark, sf_dir):
    return rounded(similar.co_rated(testdata.ratings(spark, sf_dir)), "cos")


@query
def genre_overlap_pairs(spark, sf_dir):
    return similar.co_rated(testdata.ratings(spark, sf_dir), 3, _genres(spark, sf_dir)).select("a", "b", "n_common")


@query
def similar_topn(spark, sf_dir):
    return rounded(similar.similar(testdata.ratings(spark, sf_dir), _genres(spark, sf_dir)), "score")


@query
def similar_items_cards(spark, sf_dir):
    found = similar.similar(testdata.ratings(spark, sf_dir), _genres(spark, sf_dir)).select(F.col("item_id").alias("of"), "rank", F.col("similar_id").alias("item_id"))
    shown = serving.cards(found, testdata.items(spark, sf_dir), testdata.cards(spark, sf_dir))
    return shown.select(F.col("of").alias("item_id"), "rank", F.col("item_id").alias("similar_id"), "title", "tmdb_id", "poster_url")


@query
def tune_boost(spark, sf_dir):
    """The boost that brings the second best match of the most matched pair's first item to the top, and the number of their common raters."""
    ratings, genres = testdata.ratings(spark, sf_dir), _genres(spark, sf_dir)
    best = similar.similar(ratings, genres).where("rank = 2").orderBy(F.desc("n_common"), "item_id").first()
    schema = "id1 long, id2 long, point long, boost double"
    if best is None:
        return spark.createDataFrame([], schema)
    point, limit = similar.tune(ratings, genres, best["item_id"], best["similar_id"], 1)
    return spark.createDataFrame([(best["item_id"], best["similar_id"], point, round(float(limit), 6))], schema)


def _core(k: int) -> Query:
    def run(spark, sf_dir):
        return prep.kcore(_split(spark, sf_dir)[0], k)

    return run


for _k in (3, 5, 7, 9, 11):
    QUERIES[f"kcore_k{_k}"] = _core(_k)


@query
def kcores(spark, sf_dir):
    """Each training rating with the largest of the five cores that it is in."""
    return prep.cores(_split(spark, sf_dir)[0], ALS_FACTORS).where("k > 0")


@query
def user_tag_profile(spark, sf_dir):
    return rounded(models.tag_profile(testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir)), "score")


@query
def user_genre_profile(spark, sf_dir):
    return rounded(models.genre_profile(testdata.ratings(spark, sf_dir), _genres(spark, sf_dir)), "score")


@query
def profile_dots(spark, sf_dir):
    ratings, tags, genres = testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir)
    found = models.profile_dots(ratings, tags, genres, models.tag_profile(ratings, tags), models.genre_profile(ratings, genres))
    return rounded(found.select("user_id", "item_id", "tag_dot", "genre_dot"), "tag_dot", "genre_dot")


@query
def tag_count_factors(spark, sf_dir):
    return models.TagCount.fit(testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir)).factors


@query
def tag_count_predict(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return models.TagCount.fit(train, _item_tags(spark, sf_dir), _genres(spark, sf_dir)).transform(test)


@query
def tag_count_agreement(spark, sf_dir):
    return agreement.summarize(agreement.rank_agreement(tag_count_predict(spark, sf_dir)))


@query
def tag_count_params(spark, sf_dir):
    return models.TagCount.fit(testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir)).params()


@query
def factor_counts(spark, sf_dir):
    return models.factor_counts(testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir))


@query
def num_factors_by_user(spark, sf_dir):
    return user_degree(spark, sf_dir).select("user_id", num_factors(F.col("n")).alias("k"))


QUERIES["num_factors"] = QUERIES.pop("num_factors_by_user")


@query
def factor_profile(spark, sf_dir):
    return models.factor_profile(testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir))


@query
def tag_ls_factors(spark, sf_dir):
    return models.TagLS.fit(testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir)).factors


@query
def tag_ls_predict(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return models.TagLS.fit(train, _item_tags(spark, sf_dir), _genres(spark, sf_dir)).transform(test)


@query
def tag_ls_agreement(spark, sf_dir):
    return agreement.summarize(agreement.rank_agreement(tag_ls_predict(spark, sf_dir)))


@query
def tag_ls_params(spark, sf_dir):
    return models.TagLS.fit(testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir)).params()


def _largest(rows: DataFrame, key: str, width: int, left: Column) -> DataFrame:
    """(key, n, gradient): how far residuals (``left``) are from being orthogonal to the columns of x, as a cosine to four digits: 0 for a least-squares fit."""
    rows = rows.withColumn("__left", left)
    sums = [F.sum(F.get("x", F.lit(i)) * F.col("__left")).alias(f"g{i}") for i in range(width)] + [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)]
    cosines = [F.abs(F.col(f"g{i}")) / F.greatest(F.sqrt(F.col(f"s{i}")) * F.sqrt("yy"), F.lit(1e-9)) for i in range(width)]
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *sums)
    return found.select(key, "n", F.round(F.greatest(*cosines, F.lit(0.0)), 4).alias("gradient"))


@query
def tag_ls_optimality(spark, sf_dir):
    """Each user's fit is a least-squares fit: residuals are orthogonal to its columns."""
    ratings, tags, genres = written(testdata.ratings(spark, sf_dir), "ratings")[0], saved(_item_tags(spark, sf_dir)), saved(_genres(spark, sf_dir))
    model = models.TagLS.fit(ratings, tags, genres, saved(prep.item_stats(ratings).select("item_id", "center")))
    offsets = ratings.join(model.centers, "item_id").select("user_id", "item_id", (F.col("rating") - F.col("center")).alias("y"))
    rows = model._rows(offsets, model.profile, tags, genres).join(model.factors, "user_id")
    return _largest(rows, "user_id", models.TagLS.WIDTH, F.col("y") - product("x", "coef"))


@query
def tag_count_optimality(spark, sf_dir):
    """As tag_ls_optimality, for the fits with tags (model 0) and without (model 1)."""
    ratings, tags, genres = testdata.ratings(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir)
    model = models.TagCount.fit(ratings, tags, genres)
    dots = models.profile_dots(ratings, tags, genres, model.of_tags, model.of_genres).join(model.centers, "item_id").join(model.factors, "user_id").withColumn("y", F.col("rating") - F.col("center"))
    with_tags = dots.where("tag_dot > 0.1 and x0 is not null").withColumn("x", F.array("tag_dot", "genre_dot", F.lit(1.0)))
    without = dots.where("x1 is not null").withColumn("x", F.array("genre_dot", F.lit(1.0)))
    fits = [_largest(with_tags, "user_id", 3, F.col("y") - product("x", "x0")).withColumn("model", F.lit(0)), _largest(without, "user_id", 2, F.col("y") - product("x", "x1")).withColumn("model", F.lit(1))]
    return fits[0].unionByName(fits[1])


#: The numbers of factors that the reference fits.
ALS_FACTORS = (3, 5, 7, 9, 11)


def _by_k(train: DataFrame, rows: Callable[[models.ALS, DataFrame], DataFrame]) -> DataFrame:
    """What each number of factors gives, which is column k, from its model and the core that it is fitted on.

    The cores come from one peel; the fits run side by side, as their rounds are short.
    """
    of = saved(prep.cores(train, ALS_FACTORS))
    centers = saved(prep.item_stats(train).select("item_id", "center"))

    def one(k: int) -> DataFrame:
        core = of.where(F.col("k") >= k).drop("k")
        return rows(models.ALS.fit(core, k, centers, core=False), core).withColumn("k", F.lit(k))

    with ThreadPoolExecutor(len(ALS_FACTORS)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, ALS_FACTORS))


@query
def als_optimality(spark, sf_dir):
    """Of each number of factors, each item's factors are a least-squares fit to the users' ones."""

    def rows(model, core):
        k = model.k
        used = core.join(model.centers, "item_id").join(model.users, "user_id").join(model.items, "item_id")
        design = used.select("item_id", "v", F.slice("u", 1, k).alias("x"), (F.col("rating") - F.col("center") - F.get("u", F.lit(k))).alias("y"))
        return _largest(design, "item_id", k, F.col("y") - product("x", "v"))

    return _by_k(_split(spark, sf_dir)[0], rows)


@query
def als_fit(spark, sf_dir):
    return _by_k(_split(spark, sf_dir)[0], lambda model, _: model.items)


@query
def als_predict(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _by_k(train, lambda model, _: model.transform(test))


@query
def als_eval_by_k(spark, sf_dir):
    train, test = _split(spark, sf_dir)

    def row(model, _):
        return agreement.summarize(agreement.rank_agreement(model.transform(test))).select(F.lit(model.rounds).alias("rounds"), "users", "mean", "trimmed_mean")

    return _by_k(train, row).select("k", "rounds", "users", "mean", "trimmed_mean")


@query
def als_fold_in(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _by_k(train, lambda model, _: model.fold_in(test, center=True).params())


@query
def recommend_all_als3(spark, sf_dir):
    """Of each user that has factors, the 400 items not rated with the best predictions."""
    ratings = written(testdata.ratings(spark, sf_dir), "ratings")[0]  # medians, cores and what is left out read them
    model = models.ALS.fit(ratings, 3)
    users = model.users.select("user_id", F.slice("u", 1, 3).alias("u"), F.get("u", F.lit(3)).alias("b"))
    items = model.items.join(model.centers, "item_id").select("item_id", "v", F.col("center").alias("offset"))
    return top_items.best_items(users, items, ratings, serving.KEPT)


@query
def recommend_all_genres(spark, sf_dir):
    """Of each user, the 400 items not rated with the largest sum, over their genres, of how many of the user's items have each, plus the item's median."""
    ratings, genres = written(testdata.ratings(spark, sf_dir), "ratings")[0], _genres(spark, sf_dir)
    ids = saved(prep.numbered(genres, "genre", "item_id"))
    lists = saved(genres.join(ids, "genre").groupBy("item_id").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    width = max(ids.count(), 1)
    users = prep.counted_lists(ratings.join(lists, "item_id", "left").select(F.col("user_id").alias("key"), "ids"), width).select(F.col("key").alias("user_id"), F.col("counts").alias("u"), F.lit(0.0).alias("b"))
    own = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains("ids", i).cast("double"))
    items = lists.select("item_id", own.alias("v")).join(prep.item_stats(ratings).select("item_id", F.col("center").alias("offset")), "item_id")
    return top_items.best_items(users, items, ratings, serving.KEPT)


def _index(spark: SparkSession, sf_dir: str, stem: bool = False) -> search.Index:
    return search.build_index(testdata.titles(spark, sf_dir), stem)


@query
def title_tokens(spark, sf_dir):
    return text.tokens(text.term_lists(testdata.titles(spark, sf_dir), stem=False))


@query
def title_tokens_stemmed(spark, sf_dir):
    return text.tokens(text.term_lists(testdata.titles(spark, sf_dir), stem=True))


@query
def title_bigrams(spark, sf_dir):
    return text.bigrams(text.term_lists(testdata.titles(spark, sf_dir), stem=False))


@query
def term_counts(spark, sf_dir):
    return _index(spark, sf_dir).terms


@query
def postings(spark, sf_dir):
    return _index(spark, sf_dir).postings


@query
def frequent_terms(spark, sf_dir):
    return search.frequent_terms(_index(spark, sf_dir))


@query
def nonalnum_terms(spark, sf_dir):
    return search.odd_terms(_index(spark, sf_dir))


@query
def terms_with_suffix(spark, sf_dir):
    return search.terms_ending(_index(spark, sf_dir), "ing")


def _search(spark, sf_dir):
    return rounded(search.search(_index(spark, sf_dir), "Inghe: onth, (Inghe)"), "score")


QUERIES["search"] = _search


@query
def search_saved_index(spark, sf_dir):
    """As search, over an index that was saved and loaded."""
    path = new_folder(spark, "index")
    _index(spark, sf_dir).save(path)
    return rounded(search.search(search.Index.load(spark, path, stem=False), "Inghe: onth, (Inghe)"), "score")


def _block_index(spark: SparkSession, sf_dir: str) -> block_index.BlockIndex:
    return block_index.BlockIndex.build(testdata.titles(spark, sf_dir), new_folder(spark, "blocks"), stem=False)


@query
def search_blocks(spark, sf_dir):
    """As search, over an index of which only the text's blocks are read."""
    asked = spark.createDataFrame([(0, "Inghe: onth, (Inghe)")], "query_id long, title string")
    return rounded(_block_index(spark, sf_dir).search(asked).select("item_id", "score"), "score")


@query
def search_passages(spark, sf_dir):
    """The 20 documents that each benchmark passage finds, all passages searched at once."""
    asked = testdata.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("title"))
    return rounded(_block_index(spark, sf_dir).search(asked, 20), "score")


@query
def search_stemmed(spark, sf_dir):
    return search.search(_index(spark, sf_dir, stem=True), "Inghe: onth, (Inghe)")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.ratings(spark, sf_dir).select(F.col("user_id").alias("i"), F.col("item_id").alias("j"), F.col("rating").alias("v"))


def _vector(keys: DataFrame) -> DataFrame:
    return keys.distinct().select("i", (F.col("i") % 7 + 0.5).cast("double").alias("v"))


@query
def spmv(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return rounded(linalg.spmv(m, _vector(m.select(F.col("j").alias("i")))), "v")


@query
def spmv_t(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return rounded(linalg.spmv_t(m, _vector(m.select("i"))), "v")


@query
def transpose(spark, sf_dir):
    return linalg.transpose(_matrix(spark, sf_dir))


@query
def axpby(spark, sf_dir):
    stats = item_medians(spark, sf_dir)
    return rounded(linalg.axpby(2.0, stats.select(F.col("item_id").alias("i"), F.col("center").alias("v")), -0.5, stats.select(F.col("item_id").alias("i"), F.col("n").cast("double").alias("v"))), "v")


@query
def dot(spark, sf_dir):
    stats = item_medians(spark, sf_dir)
    value = linalg.dot(stats.select(F.col("item_id").alias("i"), F.col("center").alias("v")), stats.select(F.col("item_id").alias("i"), F.col("n").cast("double").alias("v")))
    return spark.createDataFrame([(round(float(value), 6),)], "dot double")


@query
def column_counts(spark, sf_dir):
    return linalg.column_counts(_matrix(spark, sf_dir))


@query
def cg_least_squares(spark, sf_dir):
    m = written(_matrix(spark, sf_dir), "ratings")[0]
    b = saved(linalg.spmv(m, _vector(m.select(F.col("j").alias("i")))))
    found = block_matrix.cg(block_matrix.BlockMatrix.from_entries(m), b)
    return found.x.withColumns({"iterations": F.lit(found.rounds), "final_rr": F.lit(float(found.gradient**2))})


def _blocks(spark: SparkSession, sf_dir: str) -> block_matrix.BlockMatrix:
    return block_matrix.BlockMatrix.from_entries(_matrix(spark, sf_dir))


@query
def block_spmv(spark, sf_dir):
    m = _blocks(spark, sf_dir)
    return rounded(m.times(_vector(m.columns.numbers().select(F.col("id").alias("i")))), "v")


@query
def block_spmv_t(spark, sf_dir):
    m = _blocks(spark, sf_dir)
    return rounded(m.transpose().times(_vector(m.rows.numbers().select(F.col("id").alias("i")))), "v")


@query
def block_entries(spark, sf_dir):
    """The matrix, cut into blocks and put together again."""
    return _blocks(spark, sf_dir).entries()


def _prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What an order costs as a sum over its parts: quantities (order, part) and totals of orders."""
    lines = testdata.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("double").alias("v"))
    return lines, testdata.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").cast("double").alias("v"))


def _priced(solve: Callable[..., block_matrix.Solution], **how) -> Query:
    """The parts' prices that explain the orders' totals best, and how the solver ended."""

    def run(spark, sf_dir):
        entries, totals = _prices(spark, sf_dir)
        found = solve(block_matrix.BlockMatrix.from_entries(entries), totals, **how)
        told = {"stop": F.lit(found.stop), "rounds": F.lit(found.rounds)} | {c: F.lit(float(getattr(found, c))) for c in ("residual", "gradient", "norm", "condition", "size")}
        return found.x.withColumns(told)

    return run


def _price_optimality(solve: Callable[..., block_matrix.Solution]) -> Query:
    """(part, n, gradient): how far what is left of the totals is from being orthogonal to a part's quantities, as a cosine to four digits."""

    def run(spark, sf_dir):
        entries, totals = _prices(spark, sf_dir)
        found = solve(block_matrix.BlockMatrix.from_entries(entries), totals, atol=1e-8, btol=1e-8)
        given = linalg.spmv(entries, found.x)
        left = saved(totals.join(given.withColumnRenamed("v", "given"), "i").select("i", (F.col("v") - F.col("given")).alias("left")))
        size = left.agg(F.sqrt(F.sum(F.col("left") * F.col("left")))).first()[0] or 1.0
        lines = entries.groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n")).join(left, "i")
        cosine = F.abs(F.sum(F.col("v") * F.col("left"))) / (F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.lit(float(size)))
        return lines.groupBy(F.col("j").alias("part")).agg(F.sum("n").alias("n"), F.round(cosine, 4).alias("gradient"))

    return run


for _name in ("lsqr", "lsmr"):
    QUERIES[f"{_name}_prices"] = _priced(getattr(block_matrix, _name))
    QUERIES[f"{_name}_optimality"] = _price_optimality(getattr(block_matrix, _name))


@query
def live_ratings(spark, sf_dir):
    return serving.live_ratings(testdata.rating_events(spark, sf_dir))


@query
def rating_changes(spark, sf_dir):
    return serving.ratings_changed(testdata.rating_events(spark, sf_dir))


@query
def rate_upsert(spark, sf_dir):
    """Live ratings, with the ratings of the other table put in their place."""
    return readers.upsert(live_ratings(spark, sf_dir).select("user_id", "item_id", "rating"), testdata.ratings(spark, sf_dir), ["user_id", "item_id"])


@query
def rated_items(spark, sf_dir):
    return serving.rated_by_all(testdata.ratings(spark, sf_dir), testdata.items(spark, sf_dir))


@query
def rotation(spark, sf_dir):
    return serving.rotation(similar_topn(spark, sf_dir), 1).select("item_id", "rank", "similar_id")


def _batches(events: DataFrame, n: int = 3) -> list[DataFrame]:
    """The events cut into n spans of time, in order."""
    at = F.unix_micros(F.col("event_time").cast("timestamp"))
    edges = events.select(F.percentile_approx(at, [k / n for k in range(1, n)]).alias("e")).first()["e"] or []
    return [events.where(at.between(a, b)) for a, b in zip([-(1 << 62), *(e + 1 for e in edges)], [*edges, 1 << 62])]


@query
def store_live_ratings(spark, sf_dir):
    """Live ratings, kept by batches of events that put and delete them, with one compaction between."""
    kept = store.Store.create(spark, new_folder(spark, "store"), "user_id bigint, item_id bigint, rating double, event_time timestamp", ("user_id", "item_id"), buckets=16)
    for number, events in enumerate(_batches(testdata.rating_events(spark, sf_dir))):
        last = saved(events.groupBy("user_id", "item_id").agg(F.max_by(F.struct("rating", "event_time"), F.struct("event_time", "event_id")).alias("e")).select("user_id", "item_id", "e.rating", F.col("e.event_time").cast("timestamp").alias("event_time")))
        kept.put(last.where("rating is not null"))
        kept.delete(last.where("rating is null"))
        if number == 1:
            kept.compact()
    return kept.read().select("user_id", "item_id", "rating")


@query
def recommendations_refreshed(spark, sf_dir):
    """When each user's recommendations were computed: all on the 15th of January, and those of users with later ratings again on the 1st of March."""
    ratings, changed = testdata.ratings(spark, sf_dir), rating_changes(spark, sf_dir).select("user_id", F.col("changed").cast("timestamp").alias("changed"))
    often = prep.degrees(ratings, "item_id").select("item_id", F.array(F.col("n").cast("double")).alias("v"), F.lit(0.0).alias("offset"))

    def popular(users: DataFrame, algorithm: str) -> DataFrame:
        asked = users.select("user_id", F.array(F.lit(1.0)).alias("u"), F.lit(0.0).alias("b"))
        return top_items.best_items(asked, often, ratings, 20)

    kept = serving.Recommendations.create(spark, new_folder(spark, "recommendations"), popular, buckets=16)
    for now in (datetime.datetime(2024, 1, 15), datetime.datetime(2024, 3, 1)):
        kept.refresh(changed, ("popular",), now)
    return kept.store.read().select("user_id", "algorithm", "computed", F.size("items").alias("n"))


@query
def rec_staleness(spark, sf_dir):
    changed = rating_changes(spark, sf_dir)
    computed = changed.select("user_id", F.lit("tag_ls").alias("algorithm"), F.lit("2024-01-15").cast("timestamp").alias("computed"))
    return serving.stale(computed, changed)


@query
def enrichment_missing(spark, sf_dir):
    """Items without a card; those without a rating are known to have none."""
    wanted = testdata.items(spark, sf_dir).select("item_id")
    unrated = wanted.join(testdata.ratings(spark, sf_dir).select("item_id"), "item_id", "left_anti")
    return readers.missing(wanted, testdata.cards(spark, sf_dir), unrated)


def _engine(spark: SparkSession, sf_dir: str) -> serving.Engine:
    ratings = written(testdata.ratings(spark, sf_dir), "ratings")[0]  # the medians, the model and the request read them
    centers = saved(prep.item_stats(ratings).select("item_id", "center"))
    return serving.Engine(ratings, testdata.items(spark, sf_dir), _item_tags(spark, sf_dir), _genres(spark, sf_dir), centers, testdata.cards(spark, sf_dir))


def _recommend(algorithm: str) -> Query:
    def run(spark, sf_dir):
        engine = _engine(spark, sf_dir)
        if algorithm.startswith("als"):
            k = int(algorithm[3:])
            engine.als[k] = models.ALS.fit(engine.ratings, k, engine.centers)
        try:
            return engine.recommend(1, algorithm)[0]
        except ValueError:  # a user with too few ratings gets nothing
            return spark.createDataFrame([], "item_id long, rank int, score double")

    return run


for _name in serving.ALGORITHMS:
    QUERIES[f"recommend_{_name}"] = _recommend(_name)
