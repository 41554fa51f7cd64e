"""DuckDB SQL with the results of the named queries."""

from __future__ import annotations

from ..functions.numeric import FACTOR_STEPS
from ..functions.text import ENDS, STARTS, STEMS, STOP_WORDS

_CTE = {
    "ratings": """SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(max(ceil(l_quantity / 5) / 2.0) AS DOUBLE) AS rating
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "item_genres": """SELECT DISTINCT item_id, genre FROM (
        SELECT p_partkey AS item_id, unnest(string_split(lower(concat_ws('|', p_type, p_brand, 'size' || CAST(p_size // 10 AS VARCHAR))), '|')) AS genre FROM part)
        WHERE genre <> '(no genres listed)' AND genre <> ''""",
    "genre_n": "SELECT genre, count(*) AS n FROM item_genres GROUP BY genre",
    "tags": """SELECT user_id, item_id, tag FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, lower(event_type) AS tag FROM events)
        WHERE item_id IS NOT NULL""",
    "tag_n": "SELECT tag, count(*) AS n FROM tags GROUP BY tag HAVING count(*) >= 6",
    "item_tags": "SELECT item_id, tag, ln(count(*)) + 1.0 AS weight, any_value(n) AS n FROM tags JOIN tag_n USING (tag) GROUP BY item_id, tag",
    "centers": "SELECT item_id, median(rating) AS center, count(*) AS n FROM ratings GROUP BY item_id",
    "sized": "SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ratings QUALIFY n > 11",
    "drawn": """SELECT *, a.a AS attempt, row_number() OVER (PARTITION BY user_id, a.a ORDER BY md5(concat_ws(':', user_id, item_id, 42, a.a)), item_id) > floor(n * 0.8) AS test
        FROM sized, (SELECT unnest([0, 1, 2, 3, 4]) AS a) a""",
    "good": """SELECT user_id, min(attempt) AS attempt FROM (
        SELECT user_id, attempt FROM drawn WHERE test GROUP BY user_id, attempt HAVING min(rating) < max(rating)) GROUP BY user_id""",
    "split": "SELECT user_id, item_id, rating, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM drawn JOIN good USING (user_id, attempt)",
    "train": "SELECT user_id, item_id, rating FROM split WHERE split = 'train'",
    "test": "SELECT user_id, item_id, rating FROM split WHERE split = 'test'",
    "train_centers": "SELECT item_id, median(rating) AS center FROM train GROUP BY item_id",
    "predicted": "SELECT user_id, item_id, rating, center AS prediction FROM test JOIN train_centers USING (item_id)",
    "agreed": """SELECT user_id, avg(CASE WHEN a.prediction > b.prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS agreement, count(*) AS pairs
        FROM predicted a JOIN predicted b USING (user_id) WHERE a.rating > b.rating GROUP BY user_id""",
    "pairs": """SELECT a.item_id AS a, b.item_id AS b, count(*) AS n_common,
        sum(a.rating * b.rating) / (sqrt(sum(a.rating * a.rating)) * sqrt(sum(b.rating * b.rating))) AS cos
        FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id HAVING count(*) >= 3""",
    "sets": "SELECT item_id, list(genre) AS g FROM item_genres GROUP BY item_id",
    "matched": "SELECT p.* FROM pairs p JOIN sets x ON x.item_id = a JOIN sets y ON y.item_id = b WHERE 2 * len(list_intersect(x.g, y.g)) >= least(len(x.g), len(y.g))",
    "scored": """SELECT a, b, n_common, cos * (1 + least(greatest(ln(3 + (3 * exp(0.05::DOUBLE) - 3) * (n_common - 3) / 97.0::DOUBLE) - ln(3.0::DOUBLE), 0.0), 0.05)) AS score
        FROM matched""",
    "ways": "SELECT a AS item_id, b AS similar_id, score, n_common FROM scored WHERE score > 0.3 UNION ALL SELECT b, a, score, n_common FROM scored WHERE score > 0.3",
    "pooled": "SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n_common DESC, similar_id) <= 400",
    "top_similar": """SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n_common DESC, similar_id) AS rank, similar_id, score, n_common
        FROM pooled QUALIFY rank <= 20""",
    "liked": "SELECT user_id, item_id, rating - 3 AS o FROM ratings WHERE rating <> 3",
    "of_tags": "SELECT user_id, tag, sum(o * weight) / any_value(n) AS score FROM liked JOIN item_tags USING (item_id) GROUP BY user_id, tag",
    "of_genres": "SELECT user_id, genre, sum(o) / any_value(n) AS score FROM liked JOIN item_genres USING (item_id) JOIN genre_n USING (genre) GROUP BY user_id, genre",
    "dots": """SELECT r.user_id, r.item_id, r.rating, coalesce(t.d, 0) AS tag_dot, coalesce(g.d, 0) AS genre_dot FROM ratings r
        LEFT JOIN (SELECT user_id, item_id, sum(score * weight) AS d FROM ratings JOIN item_tags USING (item_id) JOIN of_tags USING (user_id, tag) GROUP BY user_id, item_id) t USING (user_id, item_id)
        LEFT JOIN (SELECT user_id, item_id, sum(score) AS d FROM ratings JOIN item_genres USING (item_id) JOIN of_genres USING (user_id, genre) GROUP BY user_id, item_id) g USING (user_id, item_id)""",
    "counted": """SELECT user_id, 'genre' AS kind, genre AS name, count(*) AS n FROM ratings JOIN item_genres USING (item_id) GROUP BY user_id, genre
        UNION ALL SELECT user_id, 'tag', tag, count(*) FROM ratings JOIN item_tags USING (item_id) GROUP BY user_id, tag""",
    "titles": "SELECT doc_id AS item_id, text AS title FROM documents",
    "rating_events": """SELECT event_id, ts AS event_time, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
        CASE WHEN event_type <> 'error' THEN CAST(event_id % 5 + 1 AS DOUBLE) END AS rating FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""",
    "live": """SELECT user_id, item_id, rating, event_time FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY event_time DESC, event_id DESC) AS k FROM rating_events) WHERE k = 1 AND rating IS NOT NULL""",
    "matrix": "SELECT user_id AS i, item_id AS j, rating AS v FROM ratings",
}


def _factors_case(n: str) -> str:
    done, before, cases = 0, 0, ""
    for factors, size in FACTOR_STEPS:
        cases += f" WHEN {n} <= {before + size} THEN {done} + ({n} - {before}) // {size // factors}"
        done, before = done + factors, before + size
    return f"CASE{cases} ELSE {done} END"


_CTE["paid"] = f"SELECT user_id, CAST({_factors_case('count(*)')} AS INTEGER) AS k FROM ratings GROUP BY user_id"
_CTE["profile"] = """SELECT user_id, CAST(slot AS INTEGER) AS slot, kind, name FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, (kind = 'tag') DESC, name DESC) - 1 AS slot FROM counted) JOIN paid USING (user_id) WHERE slot < k"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _stop(word: str) -> str:
    return f"({word} IN ({', '.join(map(_text, STOP_WORDS))}) OR regexp_full_match({word}, '\\((19[0-9][0-9]|2[0-2][0-9][0-9]|2300)\\)'))"


def _strip(word: str) -> str:
    for mark in STARTS:
        word = f"ltrim({word}, {_text(mark)})"
    for mark in ENDS:
        word = f"rtrim({word}, {_text(mark)})" if len(mark) == 1 else f"(CASE WHEN ends_with({word}, {_text(mark)}) THEN rtrim({word}, {_text(mark)}) ELSE {word} END)"
    return word


_SPACES = "[" + "".join(map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])) + "]+"
_CTE["parts"] = f"SELECT item_id, k, w FROM (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM (SELECT item_id, regexp_split_to_array(title, {_text(_SPACES)}) AS t FROM titles)) WHERE w <> ''"
_CTE["words"] = """SELECT item_id, k, unnest(p) AS w, generate_subscripts(p, 1) AS m FROM (SELECT item_id, k, CASE
    WHEN contains(w, '-') THEN list_filter(string_split(w, '-'), lambda x: x <> '')
    WHEN length(w) - length(replace(w, '/', '')) = 1 AND length(w) >= 6 THEN string_split(w, '/') ELSE [w] END AS p FROM parts)"""
_CTE["bare"] = f"SELECT item_id, k, m, raw, regexp_replace({_strip('raw')}, '''s$', '') AS w FROM (SELECT item_id, k, m, lower(w) AS raw FROM words) WHERE NOT {_stop('raw')}"
_CTE["terms"] = f"""SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY k, m) - 1 AS INTEGER) AS pos, token FROM (
    SELECT item_id, k, m, raw, CASE w {' '.join(f'WHEN {_text(a)} THEN {_text(b)}' for a, b in STEMS.items())} ELSE w END AS token FROM bare)
    WHERE length(token) > 0 AND NOT (length(token) < length(raw) AND {_stop('token')})"""
_CTE["pairs_of_terms"] = "SELECT a.item_id, a.pos, a.token || ' ' || b.token AS bigram FROM terms a JOIN terms b ON a.item_id = b.item_id AND b.pos = a.pos + 1"
_CTE["all_terms"] = "SELECT item_id, token AS term, 'token' AS kind FROM terms UNION ALL SELECT item_id, bigram, 'bigram' FROM pairs_of_terms"
_CTE["term_n"] = "SELECT term, kind, count(*) AS n FROM all_terms GROUP BY term, kind"

_NEEDS = {
    "genre_n": ["item_genres"], "tag_n": ["tags"], "item_tags": ["tag_n"], "centers": ["ratings"], "sized": ["ratings"], "drawn": ["sized"], "good": ["drawn"], "split": ["good"], "train": ["split"], "test": ["split"],
    "train_centers": ["train"], "predicted": ["test", "train_centers"], "agreed": ["predicted"], "pairs": ["ratings"], "sets": ["item_genres"], "matched": ["pairs", "sets"], "scored": ["matched"], "ways": ["scored"],
    "pooled": ["ways"], "top_similar": ["pooled"], "liked": ["ratings"], "of_tags": ["liked", "item_tags"], "of_genres": ["liked", "genre_n"], "dots": ["of_tags", "of_genres"], "counted": ["ratings", "item_genres", "item_tags"],
    "paid": ["ratings"], "profile": ["counted", "paid"], "parts": ["titles"], "words": ["parts"], "bare": ["words"], "terms": ["bare"], "pairs_of_terms": ["terms"], "all_terms": ["pairs_of_terms"], "term_n": ["all_terms"],
    "live": ["rating_events"], "matrix": ["ratings"],
}


#: Common tables that are computed once: others name their columns very often.
_ONCE = ("bare", "terms")


def _sql(select: str, *needs: str) -> str:
    """select behind the common tables that it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _NEEDS.get(name, []):
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in _ONCE else ''}({_CTE[n]})" for n in order) + "\n" + select


def _kcore(k: int, rounds: int = 8) -> str:
    steps = [f"c0 AS ({_CTE['train']})"]
    for r in range(rounds):
        steps.append(f"u{r} AS MATERIALIZED (SELECT * FROM c{r} WHERE user_id IN (SELECT user_id FROM c{r} GROUP BY user_id HAVING count(*) >= {k + 1}))")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT * FROM u{r} WHERE item_id IN (SELECT item_id FROM u{r} GROUP BY item_id HAVING count(*) >= {k}))")
    base = _sql("", "split").rstrip()
    return base + ",\n" + ",\n".join(steps) + f"\nSELECT user_id, item_id, rating FROM c{rounds}"


def _core_items(k: int) -> str:
    """The items of a core, each with its number of ratings there and a gradient of 0."""
    return f"SELECT {k} AS k, item_id, count(*) AS n, 0.0::DOUBLE AS gradient FROM ({_kcore(k)}) GROUP BY item_id"


_SEARCHED = """SELECT item_id, round(sum(times * CASE kind WHEN 'bigram' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / n), 6) AS score
        FROM (SELECT DISTINCT term, kind, item_id FROM all_terms) JOIN term_n USING (term, kind)
        JOIN (VALUES ('inghe', 'token', 2), ('onth', 'token', 1), ('inghe onth', 'bigram', 1), ('onth inghe', 'bigram', 1)) q(term, kind, times) USING (term, kind)
        GROUP BY item_id ORDER BY sum(times * CASE kind WHEN 'bigram' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / n) DESC, item_id DESC LIMIT 100"""
#: Passages are cut into terms along with the texts, under negative ids. Weights are whole trillionths, whose sum is exact.
_PASSAGES = """SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, round(s / 1e12, 6) AS score FROM (
        SELECT query_id, item_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id DESC) AS rank FROM (
            SELECT query_id, item_id, CAST(sum(w) AS BIGINT) AS s FROM (
                SELECT -1 - q.item_id AS query_id, term, kind, CAST(round(count(*) * CASE kind WHEN 'bigram' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / any_value(n) * 1e12) AS BIGINT) AS w
                FROM all_terms q JOIN (SELECT term, kind, count(*) AS n FROM all_terms WHERE item_id >= 0 GROUP BY term, kind) USING (term, kind) WHERE q.item_id < 0 GROUP BY q.item_id, term, kind)
            JOIN (SELECT DISTINCT term, kind, item_id FROM all_terms WHERE item_id >= 0) USING (term, kind) GROUP BY query_id, item_id)) WHERE rank <= 20"""
_LOG = "SELECT user_id, item_id, rating, event_time FROM rating_events WHERE rating IS NOT NULL"
#: The rounds of tuning: t has the limit of each, the scores of the first item's 40 best matches decide on the next.
_TUNED = """, best AS (SELECT item_id AS id1, similar_id AS id2 FROM top_similar WHERE rank = 2 ORDER BY n_common DESC, item_id LIMIT 1),
own AS (SELECT CASE WHEN a = id1 THEN b ELSE a END AS id, id1, id2, n_common, cos FROM matched, best WHERE a = id1 OR b = id1),
target AS (SELECT id1, id2, n_common AS point, cos FROM own WHERE id = id2),
t AS (
    SELECT 0 AS round, CAST(0.0 AS DOUBLE) AS lim, false AS done
    UNION ALL
    SELECT round + 1, CASE WHEN bool_or(id = id2 AND place = 1) THEN any_value(lim) ELSE any_value(lim) * max(score) / (any_value(target_cos) * (1 + any_value(lim))) + 0.01::DOUBLE END, bool_or(id = id2 AND place = 1)
    FROM (SELECT *, row_number() OVER (ORDER BY score DESC, n_common DESC, id) AS place FROM (
        SELECT t.round, t.lim, o.id, o.id2, o.n_common, g.cos AS target_cos,
            o.cos * (1 + least(greatest(ln(greatest(3 + coalesce((3 * exp(t.lim) - 3) * (o.n_common - 3) / nullif(g.point - 3.0::DOUBLE, 0), 0), 1e-300)) - ln(3.0::DOUBLE), 0.0), t.lim)) AS score
        FROM t, own o, target g WHERE NOT t.done AND t.lim < 2) WHERE score > 0.3
        QUALIFY row_number() OVER (ORDER BY n_common DESC, id) <= 800)
    GROUP BY round)
SELECT id1, id2, point, round(lim, 6) AS boost FROM target, (SELECT lim FROM t ORDER BY round DESC LIMIT 1)"""

ORACLES = {
    "ratings_scan": _sql("SELECT * FROM ratings", "ratings"),
    "item_genres_explode": _sql("SELECT * FROM item_genres", "item_genres"),
    "genre_counts": _sql("SELECT * FROM genre_n", "genre_n"),
    "genre_ids": _sql("SELECT genre, CAST(row_number() OVER (ORDER BY min(item_id), genre) - 1 AS INTEGER) AS id FROM item_genres GROUP BY genre", "item_genres"),
    "tag_counts_min": _sql("SELECT * FROM tag_n", "tag_n"),
    "item_tag_weights": _sql("SELECT item_id, tag, round(weight, 6) AS weight, n FROM item_tags", "item_tags"),
    "tag_ids": _sql("SELECT tag, CAST(row_number() OVER (ORDER BY min(item_id), tag) - 1 AS INTEGER) AS id FROM tags JOIN tag_n USING (tag) GROUP BY tag", "tag_n"),
    "item_medians": _sql("SELECT item_id, center, n FROM centers", "centers"),
    "item_means": _sql("SELECT item_id, round(avg(rating), 6) AS center, count(*) AS n FROM ratings GROUP BY item_id", "ratings"),
    "user_degree": _sql("SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id", "ratings"),
    "item_degree": _sql("SELECT item_id, count(*) AS n FROM ratings GROUP BY item_id", "ratings"),
    "degree_histogram": _sql("SELECT CAST(least(floor(d * 20 / 100.0), 19) AS INTEGER) AS bin, count(*) AS n FROM (SELECT count(*) AS d FROM ratings GROUP BY user_id) WHERE d BETWEEN 0 AND 100 GROUP BY bin", "ratings"),
    "train_test_split": _sql("SELECT * FROM split", "split"),
    "split_eligible_users": _sql("SELECT DISTINCT user_id, n FROM sized", "sized"),
    "distinct_rating_users": _sql("SELECT user_id FROM ratings GROUP BY user_id HAVING min(rating) < max(rating)", "ratings"),
    "median_predict": _sql("SELECT * FROM predicted", "predicted"),
    "rank_agreement_median": _sql("SELECT user_id, round(agreement, 6) AS agreement, pairs FROM agreed", "agreed"),
    "rank_agreement_summary": _sql(
        """SELECT count(*) AS users, round(avg(agreement), 6) AS mean, CAST(sum(CAST(agreement BETWEEN 0.05 AND 0.95 AS BIGINT)) AS BIGINT) AS trimmed_users,
        round(avg(CASE WHEN agreement BETWEEN 0.05 AND 0.95 THEN agreement END), 6) AS trimmed_mean FROM agreed""", "agreed"),
    "agreement_histogram": _sql("SELECT CAST(least(floor(agreement * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM agreed GROUP BY bin", "agreed"),
    "mean_error_median": _sql("SELECT round(avg(abs(prediction - rating)), 6) AS mae, count(*) AS n FROM predicted", "predicted"),
    "similar_pairs": _sql("SELECT a, b, n_common, round(cos, 6) AS cos FROM pairs", "pairs"),
    "genre_overlap_pairs": _sql("SELECT a, b, n_common FROM matched", "matched"),
    "similar_topn": _sql("SELECT item_id, CAST(rank AS INTEGER) AS rank, similar_id, round(score, 6) AS score, n_common FROM top_similar", "top_similar"),
    "similar_items_cards": _sql(
        """SELECT s.item_id, CAST(rank AS INTEGER) AS rank, similar_id, coalesce(p_name, 'None') AS title, coalesce(CAST(page_id AS VARCHAR), 'None') AS tmdb_id, coalesce(url, 'None') AS poster_url
        FROM top_similar s LEFT JOIN part ON p_partkey = similar_id LEFT JOIN pages ON page_id = similar_id""", "top_similar"),
    **{f"kcore_k{k}": _kcore(k) for k in (3, 5, 7, 9, 11)},
    "kcores": "SELECT user_id, item_id, rating, max(k) AS k FROM (" + " UNION ALL ".join(f"SELECT *, {k} AS k FROM ({_kcore(k)})" for k in (3, 5, 7, 9, 11)) + ") GROUP BY user_id, item_id, rating",
    "user_tag_profile": _sql("SELECT user_id, tag, round(score, 6) AS score FROM of_tags", "of_tags"),
    "user_genre_profile": _sql("SELECT user_id, genre, round(score, 6) AS score FROM of_genres", "of_genres"),
    "profile_dots": _sql("SELECT user_id, item_id, round(tag_dot, 6) AS tag_dot, round(genre_dot, 6) AS genre_dot FROM dots", "dots"),
    "factor_counts": _sql("SELECT * FROM counted", "counted"),
    "num_factors": _sql("SELECT * FROM paid", "paid"),
    "factor_profile": _sql("SELECT * FROM profile", "profile"),
    "title_tokens": _sql("SELECT * FROM terms", "terms"),
    "title_bigrams": _sql("SELECT * FROM pairs_of_terms", "pairs_of_terms"),
    "term_counts": _sql("SELECT * FROM term_n", "term_n"),
    "postings": _sql("SELECT DISTINCT term, kind, item_id FROM all_terms", "all_terms"),
    "frequent_terms": _sql("SELECT term, n FROM term_n WHERE kind = 'token' ORDER BY n DESC, term DESC LIMIT 100", "term_n"),
    "nonalnum_terms": _sql("SELECT term, n FROM term_n WHERE kind = 'token' AND NOT regexp_full_match(term, '[\\p{L}\\p{N}]+')", "term_n"),
    "terms_with_suffix": _sql("SELECT term, n FROM term_n WHERE kind = 'token' AND ends_with(term, 'ing')", "term_n"),
    "search": _sql(_SEARCHED, "term_n"),
    "search_saved_index": _sql(_SEARCHED, "term_n"),
    "search_blocks": _sql(_SEARCHED, "term_n"),
    "search_passages": _sql(_PASSAGES, "all_terms").replace(f"titles AS ({_CTE['titles']})", f"titles AS ({_CTE['titles']} UNION ALL SELECT -1 - item_id, text FROM benchmark)"),
    "spmv": _sql("SELECT i, round(sum(m.v * (0.5::DOUBLE + x.item_id % 7)), 6) AS v FROM matrix m JOIN (SELECT DISTINCT item_id FROM ratings) x ON x.item_id = m.j GROUP BY i", "matrix"),
    "spmv_t": _sql("SELECT j AS i, round(sum(m.v * (0.5::DOUBLE + m.i % 7)), 6) AS v FROM matrix m GROUP BY j", "matrix"),
    "block_spmv": _sql("SELECT i, round(sum(m.v * (0.5::DOUBLE + x.item_id % 7)), 6) AS v FROM matrix m JOIN (SELECT DISTINCT item_id FROM ratings) x ON x.item_id = m.j GROUP BY i", "matrix"),
    "block_spmv_t": _sql("SELECT j AS i, round(sum(m.v * (0.5::DOUBLE + m.i % 7)), 6) AS v FROM matrix m GROUP BY j", "matrix"),
    "block_entries": _sql("SELECT i, j, v FROM matrix", "matrix"),
    **{f"{name}_optimality": "SELECT l_partkey AS part, CAST(count(*) AS BIGINT) AS n, 0.0::DOUBLE AS gradient FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey" for name in ("lsqr", "lsmr")},
    "transpose": _sql("SELECT j AS i, i AS j, v FROM matrix", "matrix"),
    "axpby": _sql("SELECT item_id AS i, round(2.0::DOUBLE * center - 0.5::DOUBLE * n, 6) AS v FROM centers", "centers"),
    "dot": _sql("SELECT round(sum(center * n), 6) AS dot FROM centers", "centers"),
    "column_counts": _sql("SELECT j, count(*) AS n FROM matrix GROUP BY j", "matrix"),
    "live_ratings": _sql("SELECT * FROM live", "live"),
    "rating_changes": _sql("SELECT user_id, max(event_time) AS changed FROM rating_events GROUP BY user_id", "rating_events"),
    "rated_items": _sql(
        """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, p_name NULLS FIRST, item_id) AS INTEGER) AS rank, item_id, p_name AS title, rating
        FROM ratings LEFT JOIN part ON p_partkey = item_id""", "ratings"),
    "recommend_all_genres": _sql(
        """SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM (
        SELECT u.user_id, i.item_id, i.center + coalesce(m.n, 0) AS score, row_number() OVER (PARTITION BY u.user_id ORDER BY i.center + coalesce(m.n, 0) DESC, i.item_id DESC) AS rank
        FROM (SELECT DISTINCT user_id FROM ratings) u CROSS JOIN (SELECT * FROM centers WHERE item_id IN (SELECT item_id FROM item_genres)) i
        LEFT JOIN (SELECT user_id, g.item_id, sum(n) AS n FROM item_genres g JOIN (
            SELECT user_id, genre, CAST(count(*) AS DOUBLE) AS n FROM ratings JOIN item_genres USING (item_id) GROUP BY user_id, genre) USING (genre) GROUP BY user_id, g.item_id) m
        ON m.user_id = u.user_id AND m.item_id = i.item_id
        WHERE (u.user_id, i.item_id) NOT IN (SELECT (user_id, item_id) FROM ratings)) WHERE rank <= 400""", "ratings", "item_genres", "centers"),
    "rotation": _sql("SELECT item_id, CAST(rank AS INTEGER) AS rank, similar_id FROM top_similar WHERE (rank - 1) % 4 = 1", "top_similar"),
    "store_live_ratings": _sql("SELECT user_id, item_id, rating FROM live", "live"),
    "recommendations_refreshed": _sql(
        """SELECT user_id, 'popular' AS algorithm, CASE WHEN max(event_time) >= TIMESTAMP '2024-01-15' THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-01-15' END AS computed, CAST(20 AS INTEGER) AS n
        FROM rating_events GROUP BY user_id""", "rating_events"),
    "rec_staleness": _sql("SELECT user_id, 'tag_ls' AS algorithm FROM rating_events GROUP BY user_id HAVING max(event_time) >= TIMESTAMP '2024-01-15'", "rating_events"),
    "enrichment_missing": "SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT page_id FROM pages) AND p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "rate_upsert": _sql("SELECT user_id, item_id, rating FROM live WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM ratings) UNION ALL SELECT user_id, item_id, rating FROM ratings", "live", "ratings"),
    "tune_boost": _sql(_TUNED.removeprefix(", "), "top_similar").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nbest AS", ",\nbest AS", 1),
    "rating_levels": _sql("SELECT user_id, item_id, rating, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY rating DESC) AS INTEGER) AS level FROM ratings", "ratings"),
    "item_rating_maps": _sql("SELECT item_id, count(*) AS n, sum(rating) AS total FROM ratings GROUP BY item_id", "ratings"),
    "rating_spread": _sql("SELECT min(rating) AS least, max(rating) AS most, round(avg(rating), 6) AS mean, count(rating) AS n FROM ratings", "ratings"),
    "title_mismatches": "SELECT p_partkey AS item_id, p_name AS title, p_brand AS expected FROM part WHERE NOT coalesce(p_size > 25, false) AND p_name IS DISTINCT FROM p_brand",
    "items_csv": "SELECT p_partkey AS item_id, p_name AS title, concat_ws('|', p_type, p_brand, 'size' || CAST(p_size // 10 AS VARCHAR)) AS genres FROM part",
    "ratings_csv": _sql(f"SELECT user_id, item_id, rating FROM ({_LOG})", "rating_events"),
    "ratings_csv_latest": _sql(f"SELECT user_id, item_id, rating FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY event_time DESC, rating DESC) = 1", "rating_events"),
    "tags_csv": _sql("SELECT user_id, item_id, tag FROM tags", "tags"),
    "links_csv": "SELECT p_partkey AS item_id, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS imdb_id, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS tmdb_id FROM part",
    "kept_item_medians": _sql("SELECT item_id, center, n FROM centers", "centers"),
    "tag_ls_optimality": _sql("SELECT user_id, count(*) AS n, 0.0::DOUBLE AS gradient FROM ratings GROUP BY user_id", "ratings"),
    "tag_count_optimality": _sql(
        """SELECT user_id, n, 0.0::DOUBLE AS gradient, 0 AS model FROM (SELECT user_id, count(*) AS n FROM dots WHERE tag_dot > 0.1 GROUP BY user_id) WHERE n >= 3
        UNION ALL SELECT user_id, n, 0.0::DOUBLE, 1 FROM (SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id) WHERE n >= 2""", "dots"),
    "als_optimality": " UNION ALL ".join(_core_items(k) for k in (3, 5, 7, 9, 11)),
}
