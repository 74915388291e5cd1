"""Named queries over the driver tables, and hand-written SQL that gives the same rows.

Every query takes all columns of its operator; doubles are rounded where engines add in different orders.
The SQL shares the input view with the queries, and nothing else.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import scalar, vocab
from rowtide.learn import trees
from rowtide.learn.binning import Matrix
from rowtide.operators import ensemble, features, sampling, scoring, state
from rowtide.plans import models
from rowtide.sources import adapter
from rowtide.sources.shared import cut, new_folder
from rowtide.streaming import running

SEED = 807
#: Bins of the first boosted model's matrix.
BINS = 64
STATS_OF = SEQ_OF = vocab.HISTORY
COUNT_OF, SHARE_OF, LAST_OF = vocab.BASIC_BUCKETS, vocab.EXTRA_BUCKETS, vocab.DIST_BUCKETS
MUST = ("pre_util_mean", "pre_util_last")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.selectExpr(*(f"round(`{c}`, {digits}) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes))


def basic_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.by_entity(adapter.kept_history(spark, d), features.column_stats(STATS_OF), features.STATS_AT_ONCE))


def loan_count(spark: SparkSession, d: str) -> DataFrame:
    return features.entity_counts(adapter.history(spark, d))


def paym_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.by_entity(adapter.history(spark, d), features.payment_counts())


def paym_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.by_entity(adapter.history(spark, d), features.payment_summary()))


def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.by_entity(adapter.history(spark, d), features.counts(COUNT_OF, "cnt"))


def bucket_counts_tall(spark: SparkSession, d: str) -> DataFrame:
    return features.tall_counts(adapter.history(spark, d), vocab.BASIC_BUCKETS)


def dist_counts_tall(spark: SparkSession, d: str) -> DataFrame:
    return features.tall_counts(adapter.history(spark, d), vocab.DIST_BUCKETS)


def bucket_props(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.by_entity(adapter.history(spark, d), features.counts(SHARE_OF, "xprop", features.ROWS)))


def recent_stats_k(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.recent_stats(adapter.history(spark, d)))


def payment_agg(spark: SparkSession, d: str) -> DataFrame:
    measured = features.payment_measures(adapter.history(spark, d))
    return rounded(features.by_entity(measured, features.column_stats(features.MEASURES, ("mean", "max", "std", "sum", "last"), "x")))


def cross_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.by_entity(adapter.history(spark, d), features.cross_counts(vocab.EXTRA_CROSSES, "xcnt"))


def cross_counts_tall(spark: SparkSession, d: str) -> DataFrame:
    return features.tall_crosses(adapter.history(spark, d), vocab.EXTRA_CROSSES).select("id", "cross", "code", "n")


def cross_props(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.tall_crosses(adapter.history(spark, d), vocab.DIST_CROSSES))


def last_onehot(spark: SparkSession, d: str) -> DataFrame:
    return features.latest(adapter.history(spark, d), 1).groupBy("id").agg(*features.last_one_hot(LAST_OF))


def recent_props_k(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.latest(adapter.history(spark, d), 7).groupBy("id").agg(*features.recent_shares()))


def seq_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = features.sequence(adapter.history(spark, d), SEQ_OF, kind="INT")
    return wide.drop(*(f"seq_delta0_1_{n}" for n in vocab.DELTAS))


def seq_delta(spark: SparkSession, d: str) -> DataFrame:
    return features.sequence(adapter.history(spark, d), SEQ_OF, kind="INT").select("id", *(f"seq_delta0_1_{n}" for n in vocab.DELTAS))


def id_norm(spark: SparkSession, d: str) -> DataFrame:
    return adapter.target(spark, d).select("id", features.id_norm().cast("double").alias("id_norm"))


def family_basic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.basic(adapter.kept_history(spark, d))).withColumn("id_norm", F.col("id_norm").cast("double"))


def family_extra(spark: SparkSession, d: str) -> DataFrame:
    return features.extra(adapter.history(spark, d), dealt=True, digits=6, adjacent=True)


def family_sequence(spark: SparkSession, d: str) -> DataFrame:
    return features.sequence(adapter.history(spark, d), kind="INT")


def family_distribution(spark: SparkSession, d: str) -> DataFrame:
    return features.distribution(adapter.history(spark, d), dealt=True, digits=6, adjacent=True)


def _state(spark: SparkSession, d: str) -> state.FeatureState:
    """The state after two batches that interleave."""
    kept, h = state.FeatureState(spark, new_folder(spark, "state")), adapter.dealt_history(spark, d)
    kept.add("thirds", h.where("rn % 3 = 0"), dealt=True, adjacent=True)
    kept.add("others", h.where("rn % 3 <> 0"), dealt=True, adjacent=True)
    return kept


def state_extra(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).family("extra", digits=6)


def state_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).family("dist", digits=6)


def state_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all positions and changes, without their wide table."""
    return rounded(_state(spark, d).scores("seq", adapter.target(spark, d)))


def target_join(spark: SparkSession, d: str) -> DataFrame:
    return scoring.attach_target(features.entity_counts(adapter.history(spark, d)), adapter.target(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    stats = features.by_entity(adapter.kept_history(spark, d), features.column_stats(STATS_OF), features.STATS_AT_ONCE)
    return scoring.attach_target(stats, adapter.target(spark, d))


def _recent(spark: SparkSession, d: str) -> DataFrame:
    return features.recent_stats(adapter.history(spark, d), rows=(3,))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of both families, rounded so that their order does not hang on the last bit."""
    extra = scoring.effect_sizes(scoring.attach_target(_recent(spark, d), adapter.target(spark, d)), True, "extra")
    return rounded(scoring.effect_sizes(_labelled(spark, d), True, "basic").unionByName(extra))


def effect_size_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.effect_sizes(_labelled(spark, d)))


def effect_size_pop(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.effect_sizes(_labelled(spark, d), population=True))


def top_n_must_keep(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_features(_scores(spark, d).where("family = 'basic'").select("feature", "score"), 5, MUST)


def joint_top_n(spark: SparkSession, d: str) -> DataFrame:
    named = _scores(spark, d).select("family", F.concat_ws("::", "family", "feature").alias("feature"), "score")
    return scoring.top_features(named, 8, tuple(f"basic::{m}" for m in MUST))


def family_top_n(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_by_family(_scores(spark, d), {"basic": 4, "extra": 3}, {"basic": MUST})


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(adapter.target(spark, d), 501, SEED)


def training_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.training_sample(adapter.target(spark, d), 301, 700, SEED)


def neg_undersample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_negatives(adapter.target(spark, d), 2, SEED)


def bounded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_rows(adapter.target(spark, d), 250, SEED)


def id_tail_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.id_tail(adapter.target(spark, d), 0.82, 200)


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    t = adapter.target(spark, d)
    prior = t.agg(F.avg("flag").alias("prior"), F.count_if(F.col("flag") == 1).alias("one"), F.count_if(F.col("flag") == 0).alias("zero"))
    one = F.col("one"), F.col("zero")
    weighted = t.crossJoin(F.broadcast(prior)).select(
        "id", scalar.class_weight(F.col("flag"), F.col("prior"), 0.95).alias("weight"),
        scalar.positive_weight(*one).alias("balanced"), scalar.positive_weight(*one, 13.0, 0.45).alias("rankish"),
    )
    return rounded(weighted, 9)


def _validated(spark: SparkSession, d: str) -> DataFrame:
    """Labels and three made-up predictions for each entity."""
    p = lambda a, b: ((F.col("id") * a + b) % 97 + 1) / 99.0
    return adapter.target(spark, d).select("id", "flag", p(31, 7).alias("p1"), p(57, 11).alias("p2"), p(13, 5).alias("p3"))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.roc_auc(_validated(spark, d).select("flag", F.col("p1").alias("score"))), 9)


def logit_blend(spark: SparkSession, d: str) -> DataFrame:
    score = ensemble.blend(["p1", "p2"], [F.lit(0.3), F.lit(0.7)])
    return rounded(_validated(spark, d).select("id", score.alias("score"), scalar.sigmoid(score).alias("probability")), 9)


def weight_grid2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.weight_aucs(_validated(spark, d), ["p1", "p2"], ensemble.pair_grid(21)), 9)


def weight_grid3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.weight_aucs(_validated(spark, d), ["p1", "p2", "p3"], ensemble.triple_grid(11)), 9)


def calibrate_prior(spark: SparkSession, d: str) -> DataFrame:
    prior = F.broadcast(adapter.target(spark, d).agg(F.avg("flag").alias("prior")))
    return rounded(_validated(spark, d).crossJoin(prior).select("id", scalar.calibrate(F.col("p1"), F.col("prior")).alias("flag")), 9)


def family_join(spark: SparkSession, d: str) -> DataFrame:
    h = adapter.history(spark, d)
    seq = features.sequence(h, ["pre_util"], 2)
    return sampling.join_families({"basic": features.entity_counts(h), "extra": rounded(_recent(spark, d)), "seq": seq.select("id", *(F.col(c).cast("int").alias(c) for c in seq.columns[1:]))})


def semi_join_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.semi_sample(features.entity_counts(adapter.history(spark, d)), stratified_split(spark, d).where("part = 'val'"))


def _submitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sample = adapter.target(spark, d).select(F.col("id").alias("ord"), "id")
    predicted = features.entity_counts(adapter.history(spark, d)).select("id", (F.col("loan_count") / 200).alias("flag"))
    return sample, ensemble.submission(sample, predicted)


def submission_left_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_submitted(spark, d)[1])


def submission_checks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.checked(*_submitted(spark, d)))


def submission_format(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("id", F.format_string("%.7f", "p1").alias("flag"))


def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    lacking = scoring.missing_columns(adapter.history(spark, d), adapter.event_history(spark, d))
    return spark.createDataFrame([(c,) for c in lacking], "column_name string")


def event_stats(spark: SparkSession, d: str) -> DataFrame:
    h = adapter.event_history(spark, d)
    return rounded(features.by_entity(h, [*features.column_stats(["value_bucket"]), *features.counts({"event_code": range(5)}, "cnt")]))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    return running.event_counts(spark, d)


def _matrix(spark: SparkSession, d: str) -> Matrix:
    """The statistics of every column as codes, with balanced class weights."""
    return Matrix.write(models.weighted(cut(rounded(_labelled(spark, d))), models.CONFIGS["hgb_baseline"]), _STAT_NAMES, BINS)


def _root(matrix: Matrix) -> np.ndarray:
    """The histogram of all rows before the first tree: (features, codes) sums of gradients and hessians, and rows."""
    one = trees.Tree()
    one.add()
    halves = lambda b: (trees.units(b.weights * (0.5 - b.flags)), trees.units(b.weights * 0.25), ~b.stop)
    width = len(matrix.features)
    return trees.histograms(matrix.rows, width, np.arange(width), matrix.codes, halves, [(one, {0: 0})], 1, tasks=matrix.files)[0][0]


def feature_bins(spark: SparkSession, d: str) -> DataFrame:
    """Rows in each bin of each feature of the binned matrix."""
    matrix = _matrix(spark, d)
    n = len(matrix.features)
    digits = matrix.rows.select(F.hex("bins").alias("x"))
    codes = digits.selectExpr(f"posexplode(transform(sequence(0, {n - 1}), k -> CAST(conv(substr(x, 2 * k + 1, 2), 16, 10) AS INT))) AS (f, code)")
    tall = codes.groupBy("f", "code").agg(F.count(F.lit(1)).alias("rows"))
    return tall.select(F.element_at(F.array(*map(F.lit, matrix.features)), F.col("f") + 1).alias("feature"), "code", "rows")


def first_splits(spark: SparkSession, d: str) -> DataFrame:
    """For each feature, the best gain that the first split of the first boosted model can have on it; 0 if it cannot split."""
    matrix = _matrix(spark, d)
    config, root = models.CONFIGS["hgb_baseline"], _root(matrix)
    rule = trees.Rule(config.least_rows, config.l1, config.l2)
    found = [(f, rule.best(root[:, k : k + 1])) for k, f in enumerate(matrix.features)]
    return rounded(spark.createDataFrame([(f, float(x[0]) if x else 0.0) for f, x in found], "feature string, gain double"))  # one row for each feature


def _signalled(spark: SparkSession, d: str) -> DataFrame:
    """All statistics and three noisy traces of the label, each with an AUC of about 0.82: only together do they reach 0.9."""
    traces = {f"trace_{k}": F.col("flag") + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) * 0.0025 for k in range(3)}
    return _labelled(spark, d).withColumns(traces)


def logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    return models.validate(spark, _signalled(spark, d), models.LOGISTIC, SEED, least=0.85)


def stochastic_baseline(spark: SparkSession, d: str) -> DataFrame:
    return models.validate(spark, _signalled(spark, d), models.STOCHASTIC, SEED, least=0.85)


def boosted_model(spark: SparkSession, d: str) -> DataFrame:
    """The first boosted model with its own parameters."""
    return models.validate(spark, _signalled(spark, d), models.CONFIGS["hgb_baseline"], SEED, least=0.85)


_H = f"h AS ({adapter.HISTORY_SQL.format(lineitem='lineitem', orders='orders')})"
_T = f"t AS ({adapter.TARGET_SQL.format(customer='customer')})"
_P = "v AS (SELECT id, flag, ((id * 31 + 7) % 97 + 1) / 99.0::DOUBLE AS p1, ((id * 57 + 11) % 97 + 1) / 99.0::DOUBLE AS p2, ((id * 13 + 5) % 97 + 1) / 99.0::DOUBLE AS p3 FROM t)"
_PAYM = "[" + ", ".join(f"enc_paym_{i}" for i in range(25)) + "]"


def _last(c: str) -> str:
    return f"coalesce(arg_max({c}, rn) FILTER (WHERE {c} IS NOT NULL), 0)::DOUBLE"


def _stat_columns() -> str:
    return ", ".join(f"avg({c}) AS {c}_mean, max({c})::DOUBLE AS {c}_max, coalesce(stddev_samp({c}), 0) AS {c}_std, {_last(c)} AS {c}_last" for c in STATS_OF)


def _round(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_STATS = f"stats AS (SELECT id, {_stat_columns()} FROM h GROUP BY id)"
_STAT_NAMES = [f"{c}_{s}" for c in STATS_OF for s in ("mean", "max", "std", "last")]
_RECENT_OF = vocab.RECENT_COLUMNS
_R = "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn DESC) - 1 AS pos FROM h)"


def _recent_columns(ks: tuple[int, ...], digits: int | None = 6) -> str:
    one = lambda k, c, s, f: f"{f}(CASE WHEN pos < {k} THEN {c} END)::DOUBLE"
    return ", ".join(
        (f"round({one(k, c, s, f)}, {digits})" if digits else one(k, c, s, f)) + f" AS xrecent{k}_{c}_{s}" for k in ks for c in _RECENT_OF for s, f in (("mean", "avg"), ("max", "max"), ("min", "min"))
    )


def _effect(table: str, names: list[str], population: bool, family: str | None = None) -> str:
    spread = "sqrt(greatest(var_pop({c}), 1e-12))" if population else "nullif(stddev_samp({c}), 0)"
    own = f"'{family}' AS family, " if family else ""
    score = f"round(coalesce(abs(avg(x) FILTER (WHERE flag = 1) - avg(x) FILTER (WHERE flag = 0)) / {spread.format(c='x')}, 0), 6)"
    return f"SELECT {own}feature, {score} AS score FROM (UNPIVOT (SELECT id, {', '.join(names)} FROM {table}) ON {', '.join(names)} INTO NAME feature VALUE x) JOIN t USING (id) GROUP BY feature"


_RECENT3 = [f"xrecent3_{c}_{s}" for c in _RECENT_OF for s in ("mean", "max", "min")]
_SCORES = f"WITH {_H}, {_T}, {_STATS}, {_R}, recent AS (SELECT id, {_recent_columns((3,), None)} FROM r GROUP BY id), scores AS ({_effect('stats', _STAT_NAMES, True, 'basic')} UNION ALL {_effect('recent', _RECENT3, True, 'extra')})"
_RANK = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY md5(id::VARCHAR || ':{SEED}'), id) AS rank FROM t)"
_SIZES = "n AS (SELECT count(*) FILTER (WHERE flag = 1) AS one, count(*) FILTER (WHERE flag = 0) AS zero, count(*) AS total FROM t)"


def _quota(size: int) -> str:
    """Quotas of both classes by largest remainder."""
    s = f"least({size}, total)"
    more = f"CASE WHEN {s} * one // total + {s} * zero // total < {s} THEN 1 ELSE 0 END"
    first = f"CASE WHEN {s} * one % total > {s} * zero % total THEN 1 ELSE 0 END"
    return f"q AS (SELECT {s} * one // total + ({more}) * ({first}) AS q1, {s} * zero // total + ({more}) * (1 - ({first})) AS q0 FROM n)"


def _split(size: int) -> str:
    return f"{_T}, {_SIZES}, {_quota(size)}, {_RANK}, parts AS (SELECT id, flag, CASE WHEN rank <= CASE WHEN flag = 1 THEN q1 ELSE q0 END THEN 'val' ELSE 'train' END AS part FROM ranked, q)"


def _tall(buckets) -> str:
    return " UNION ALL ".join(f"SELECT id, '{c}' AS \"column\", {c} AS bucket, count(*) AS n FROM h WHERE {c} IN ({', '.join(map(str, codes))}) GROUP BY ALL" for c, codes in buckets.items())


def _crosses(crosses) -> str:
    return " UNION ALL ".join(f"SELECT id, '{k}' AS \"cross\", {a} * 10 + {b} AS code, count(*) AS n FROM h WHERE {a} BETWEEN 0 AND {x - 1} AND {b} BETWEEN 0 AND {y - 1} GROUP BY ALL" for k, (a, x, b, y) in crosses.items())


def _auc(source: str, by: str = "") -> str:
    """Rank sum with average ranks."""
    over = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    return (
        f"places AS (SELECT {key}flag, rank() OVER ({over}ORDER BY score) + (count(*) OVER (PARTITION BY {key}score) - 1) / 2.0 AS place FROM {source}), "
        f"aucs AS (SELECT {key}(sum(place) FILTER (WHERE flag = 1) - count(*) FILTER (WHERE flag = 1) * (count(*) FILTER (WHERE flag = 1) + 1) / 2.0) "
        f"/ (count(*) FILTER (WHERE flag = 1) * count(*) FILTER (WHERE flag = 0))::DOUBLE AS auc FROM places {'GROUP BY ' + by if by else ''})"
    )


def _logit(p: str) -> str:
    return f"ln(least(greatest({p}, 1e-8), 1 - 1e-8) / (1 - least(greatest({p}, 1e-8), 1 - 1e-8)))"


def _measures() -> str:
    count = lambda test, cols: " + ".join(f"CASE WHEN {test.format(c=c)} THEN 1 ELSE 0 END" for c in cols)
    every, recent, old = ([f"enc_paym_{i}" for i in r] for r in (range(25), range(6), range(19, 25)))
    mean = lambda cols: f"({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in cols)}, 0)::DOUBLE"
    out = {f"paym_{n}": count("{c} = " + str(v), every) for v, n in enumerate(("zero", "one", "two", "three", "four"))}
    out |= {
        "paym_nonzero": count("{c} IS DISTINCT FROM 0", every), "paym_recent_nonzero": count("{c} IS DISTINCT FROM 0", recent), "paym_recent_bad12": count("{c} IN (1, 2)", recent), "paym_old_bad12": count("{c} IN (1, 2)", old),
        "paym_max": f"greatest({', '.join(every)})", "paym_mean": mean(every), "paym_recent_mean": mean(recent), "paym_old_mean": mean(old), "paym_trend_recent_minus_old": f"{mean(recent)} - {mean(old)}",
    }
    return ", ".join(f"{x} AS {n}" for n, x in out.items())


def _count_if(name: str, test: str) -> str:
    return f"count(*) FILTER (WHERE {test})::DOUBLE AS {name}"


def _wide_counts(buckets, prefix: str, share: bool) -> str:
    return ", ".join(f"round(count(*) FILTER (WHERE {c} = {v}) / count(*)::DOUBLE, 6) AS {prefix}_{c}_{v}" if share else _count_if(f"{prefix}_{c}_{v}", f"{c} = {v}") for c, codes in buckets.items() for v in codes)


def _wide_crosses(crosses, prefix: str, share: bool) -> str:
    codes = [(f"{prefix}_{k}_{i * 10 + j}", f"{a} * 10 + {b} = {i * 10 + j}") for k, (a, x, b, y) in crosses.items() for i in range(x) for j in range(y)]
    return ", ".join(f"round(count(*) FILTER (WHERE {test}) / count(*)::DOUBLE, 6) AS {name}" if share else _count_if(name, test) for name, test in codes)


_SUBMITTED = f"WITH {_H}, {_T}, counts AS (SELECT id, count(*)::DOUBLE / 200 AS flag FROM h GROUP BY id), s AS (SELECT t.id AS ord, t.id, counts.flag FROM t LEFT JOIN counts USING (id))"

ORACLE = {
    "basic_stats": f"WITH {_H}, {_STATS} SELECT id, {_round(_STAT_NAMES)} FROM stats",
    "loan_count": f"WITH {_H} SELECT id, count(*)::DOUBLE AS loan_count FROM h GROUP BY id",
    "paym_status_counts": f"WITH {_H} SELECT id, "
    + ", ".join(f"sum({' + '.join(f'CASE WHEN enc_paym_{i} = {v} THEN 1 ELSE 0 END' for i in range(n))})::DOUBLE AS paym_{w}status_{v}_count" for n, w in ((25, ""), (6, "recent_")) for v in range(5))
    + " FROM h GROUP BY id",
    "paym_summary": f"WITH {_H}, m AS (SELECT id, rn, {_measures()} FROM h) SELECT id, sum(paym_nonzero)::DOUBLE AS paym_nonzero_count, round(avg(paym_mean), 6) AS paym_mean_all, max(paym_max)::DOUBLE AS paym_max_all FROM m GROUP BY id",
    "bucket_counts": f"WITH {_H} SELECT id, " + ", ".join(_count_if(f"cnt_{c}_{v}", f"{c} = {v}") for c, codes in COUNT_OF.items() for v in codes) + " FROM h GROUP BY id",
    "bucket_counts_tall": f"WITH {_H} {_tall(vocab.BASIC_BUCKETS)}",
    "dist_counts_tall": f"WITH {_H} {_tall(vocab.DIST_BUCKETS)}",
    "bucket_props": f"WITH {_H} SELECT id, " + ", ".join(f"round(count(*) FILTER (WHERE {c} = {v}) / count(*)::DOUBLE, 6) AS xprop_{c}_{v}" for c, codes in SHARE_OF.items() for v in codes) + " FROM h GROUP BY id",
    "recent_stats_k": f"WITH {_H}, {_R} SELECT id, {_recent_columns((2, 3, 5, 10))} FROM r GROUP BY id",
    "payment_agg": f"WITH {_H}, m AS (SELECT id, rn, {_measures()} FROM h) SELECT id, "
    + ", ".join(
        f"round(avg({c})::DOUBLE, 6) + 0.0 AS x{c}_mean, round(max({c})::DOUBLE, 6) + 0.0 AS x{c}_max, round(coalesce(stddev_samp({c}), 0), 6) AS x{c}_std, round(sum({c})::DOUBLE, 6) + 0.0 AS x{c}_sum, round({_last(c)}, 6) + 0.0 AS x{c}_last" for c in features.MEASURES
    )
    + " FROM m GROUP BY id",
    "cross_counts": f"WITH {_H} SELECT id, {_wide_crosses(vocab.EXTRA_CROSSES, 'xcnt', False)} FROM h GROUP BY id",
    "cross_counts_tall": f"WITH {_H} {_crosses(vocab.EXTRA_CROSSES)}",
    "cross_props": f"WITH {_H}, c AS ({_crosses(vocab.DIST_CROSSES)}), n AS (SELECT id, count(*) AS total FROM h GROUP BY id) SELECT id, \"cross\", code, n, round(n / total::DOUBLE, 6) AS share FROM c JOIN n USING (id)",
    "last_onehot": f"WITH {_H}, {_R} SELECT id, " + ", ".join(f"CASE WHEN {c} = {v} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dlast_{c}_{v}" for c, codes in LAST_OF.items() for v in codes) + " FROM r WHERE pos = 0",
    "recent_props_k": f"WITH {_H}, {_R} SELECT id, "
    + ", ".join(f"round(count(*) FILTER (WHERE pos < {k} AND {c} = {v}) / count(*) FILTER (WHERE pos < {k})::DOUBLE, 6) AS dr{k}prop_{c}_{v}" for k in (3, 7) for c in vocab.DIST_RECENT for v in vocab.DIST_BUCKETS[c])
    + " FROM r GROUP BY id",
    "seq_pivot": f"WITH {_H}, {_R} SELECT id, " + ", ".join(f"coalesce(max(CASE WHEN pos = {p} THEN least(greatest({c}, 0), 255) END), 255)::INT AS seq{p}_{c}" for p in range(14) for c in SEQ_OF) + " FROM r GROUP BY id",
    "seq_delta": f"WITH {_H}, {_R}, s AS (SELECT id, "
    + ", ".join(f"coalesce(max(CASE WHEN pos = {p} THEN {c} END), 255) AS {n}{p}" for p in (0, 1) for n, c in vocab.DELTAS.items())
    + " FROM r GROUP BY id) SELECT id, "
    + ", ".join(f"least(greatest({n}0 - {n}1 + 128, 0), 255)::INT AS seq_delta0_1_{n}" for n in vocab.DELTAS)
    + " FROM s",
    "id_norm": f"WITH {_T} SELECT id, (id::FLOAT / 3000000.0::FLOAT)::DOUBLE AS id_norm FROM t",
    "target_join": f"WITH {_H}, {_T}, c AS (SELECT id, count(*)::DOUBLE AS loan_count FROM h GROUP BY id) SELECT id, loan_count, flag FROM c LEFT JOIN t USING (id)",
    "effect_size_sample": f"WITH {_H}, {_T}, {_STATS} {_effect('stats', _STAT_NAMES, False)}",
    "effect_size_pop": f"WITH {_H}, {_T}, {_STATS} {_effect('stats', _STAT_NAMES, True)}",
    "top_n_must_keep": f"{_SCORES}, p AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature)::INT AS place FROM scores WHERE family = 'basic') SELECT * FROM p WHERE place <= 5 OR feature IN ('pre_util_mean', 'pre_util_last')",
    "joint_top_n": f"{_SCORES}, p AS (SELECT family, family || '::' || feature AS feature, score, row_number() OVER (ORDER BY score DESC, family || '::' || feature)::INT AS place FROM scores) SELECT * FROM p WHERE place <= 8 OR feature IN ('basic::pre_util_mean', 'basic::pre_util_last')",
    "family_top_n": f"{_SCORES}, p AS (SELECT family, feature, score, row_number() OVER (PARTITION BY family ORDER BY score DESC, feature)::INT AS place FROM scores) SELECT * FROM p WHERE place <= CASE family WHEN 'basic' THEN 4 ELSE 3 END OR family = 'basic' AND feature IN ('pre_util_mean', 'pre_util_last')",
    "stratified_split": f"WITH {_split(501)} SELECT id, flag, part FROM parts",
    "training_sample": f"WITH {_split(301)}, pool AS (SELECT id, flag, row_number() OVER (PARTITION BY flag ORDER BY md5(id::VARCHAR || ':{SEED}'), id) AS place FROM parts WHERE part = 'train'), "
    "sizes AS (SELECT count(*) FILTER (WHERE flag = 1) AS one, count(*) FILTER (WHERE flag = 0) AS zero FROM pool), "
    "limits AS (SELECT CASE WHEN one + zero <= 700 OR one <= 700 THEN one ELSE 350 END AS q1, CASE WHEN one + zero <= 700 THEN zero WHEN one <= 700 THEN least(zero, 700 - one) ELSE least(zero, 350) END AS q0 FROM sizes) "
    "SELECT id, flag, part FROM parts WHERE part = 'val' UNION ALL SELECT id, flag, 'train' AS part FROM pool, limits WHERE place <= CASE WHEN flag = 1 THEN q1 ELSE q0 END",
    "neg_undersample": f"WITH {_T}, {_SIZES}, {_RANK} SELECT id, flag FROM ranked, n WHERE flag = 1 OR rank <= 2 * one",
    "bounded_sample": f"WITH {_T}, {_SIZES}, {_RANK} SELECT id, flag FROM ranked, n WHERE total <= 250 OR rank <= CASE WHEN flag = 1 THEN CASE WHEN one <= 250 THEN one ELSE 125 END ELSE 250 - CASE WHEN one <= 250 THEN one ELSE 125 END END",
    "id_tail_split": f"WITH {_T}, tail AS (SELECT *, row_number() OVER (ORDER BY md5(id::VARCHAR || ':555'), id) AS rank FROM t WHERE id > (SELECT quantile_cont(id, 0.82) FROM t)) SELECT id, flag FROM tail WHERE rank <= 200",
    "class_weights": f"WITH {_T}, {_SIZES} SELECT id, round(CASE WHEN flag = 1 THEN 0.5 / (one / total::DOUBLE) * 0.95 ELSE 0.5 / (1 - one / total::DOUBLE) END, 9) AS weight, "
    "round(least(zero::DOUBLE / greatest(one, 1), 24.0::DOUBLE), 9) AS balanced, round(greatest(1.0::DOUBLE, least(zero::DOUBLE / greatest(one, 1) * 0.45, 13.0::DOUBLE)), 9) AS rankish FROM t, n",
    "roc_auc": f"WITH {_T}, {_P}, scored AS (SELECT flag, p1 AS score FROM v), {_auc('scored')} SELECT round(auc, 9) AS auc FROM aucs",
    "logit_blend": f"WITH {_T}, {_P}, b AS (SELECT id, 0.3 * {_logit('p1')} + 0.7 * {_logit('p2')} AS score FROM v) SELECT id, round(score, 9) AS score, round(1 / (1 + exp(-score)), 9) AS probability FROM b",
    "weight_grid2": f"WITH {_T}, {_P}, g AS (SELECT i AS n, i / 20.0::DOUBLE AS w1, 1 - i / 20.0::DOUBLE AS w2 FROM range(21) r(i)), scored AS (SELECT n, flag, round(w1 * {_logit('p1')} + w2 * {_logit('p2')}, 12) AS score FROM v, g), {_auc('scored', 'n')} SELECT n::INT AS n, round(w1, 9) AS w1, round(w2, 9) AS w2, round(auc, 9) AS auc FROM aucs JOIN g USING (n)",
    "weight_grid3": f"WITH {_T}, {_P}, g AS (SELECT i * 11 + j AS n, i / 10.0::DOUBLE AS w1, (1 - i / 10.0::DOUBLE) * j / 10.0::DOUBLE AS w2 FROM range(11) a(i), range(11) b(j)), scored AS (SELECT n, flag, round(w1 * {_logit('p1')} + w2 * {_logit('p2')} + (1 - w1 - w2) * {_logit('p3')}, 12) AS score FROM v, g), {_auc('scored', 'n')} SELECT n::INT AS n, round(w1, 9) AS w1, round(w2, 9) AS w2, round(1 - w1 - w2, 9) AS w3, round(auc, 9) AS auc FROM aucs JOIN g USING (n)",
    "calibrate_prior": f"WITH {_T}, {_P}, prior AS (SELECT avg(flag) / (1 - avg(flag)) AS odds FROM t) SELECT id, round(p1 * odds / (1 - p1 + p1 * odds), 9) AS flag FROM v, prior",
    "family_join": f"WITH {_H}, {_R}, b AS (SELECT id, count(*)::DOUBLE AS loan_count FROM h GROUP BY id), e AS (SELECT id, {_recent_columns((3,))} FROM r GROUP BY id), "
    "s AS (SELECT id, coalesce(max(CASE WHEN pos = 0 THEN pre_util END), 255) AS s0, coalesce(max(CASE WHEN pos = 1 THEN pre_util END), 255) AS s1 FROM r GROUP BY id) "
    f"SELECT id, loan_count, {', '.join(f'{c} AS extra__{c}' for c in _RECENT3)}, s0::INT AS seq__seq0_pre_util, s1::INT AS seq__seq1_pre_util, least(greatest(s0 - s1 + 128, 0), 255)::INT AS seq__seq_delta0_1_util FROM b JOIN e USING (id) JOIN s USING (id)",
    "semi_join_sample": f"WITH {_H}, {_split(501)} SELECT id, count(*)::DOUBLE AS loan_count FROM h WHERE id IN (SELECT id FROM parts WHERE part = 'val') GROUP BY id",
    "submission_left_join": f"{_SUBMITTED} SELECT ord, id, round(flag, 6) AS flag FROM s",
    "submission_checks": f"{_SUBMITTED} SELECT count(*) AS rows, 0::BIGINT AS unmatched, 0::BIGINT AS out_of_order, count(*) FILTER (WHERE flag IS NULL) AS nulls, count(*) FILTER (WHERE NOT flag BETWEEN 0 AND 1) AS out_of_range, round(min(flag), 6) AS min, round(max(flag), 6) AS max, round(avg(flag), 6) AS mean FROM s",
    "submission_format": f"WITH {_T}, {_P} SELECT id, printf('%.7f', p1) AS flag FROM v",
    "missing_columns": f"SELECT unnest({sorted(set(vocab.HISTORY) - {'rn'})}) AS column_name",
    "event_stats": "WITH h AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type, floor(value / 50)::INT AS value_bucket FROM events) "
    f"SELECT id, round(avg(value_bucket), 6) AS value_bucket_mean, max(value_bucket)::DOUBLE AS value_bucket_max, round(coalesce(stddev_samp(value_bucket), 0), 6) AS value_bucket_std, {_last('value_bucket')} AS value_bucket_last, "
    + ", ".join(_count_if(f"cnt_event_code_{v}", f"event_type = '{e}'") for v, e in enumerate(("click", "error", "purchase", "signup", "view")))
    + " FROM h GROUP BY id",
    "stream_counts": "SELECT user_id AS id, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS n_{e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
}

_CODES = (
    f"WITH {_H}, {_T}, {_STATS}, x AS (SELECT id, feature, value FROM (UNPIVOT (SELECT id, {_round(_STAT_NAMES)} FROM stats) ON {', '.join(_STAT_NAMES)} INTO NAME feature VALUE value)), "
    f"q AS (SELECT feature, list_distinct(quantile_disc(value, [{', '.join(f'{i / BINS}' for i in range(1, BINS))}])) AS e, max(value) AS m FROM x GROUP BY feature), edges AS (SELECT feature, [v for v in e if v < m] AS e FROM q), "
    "codes AS (SELECT x.id, x.feature, 1 + len([v for v in e if v < x.value]) AS code FROM x JOIN edges USING (feature))"
)
ORACLE |= {
    "feature_bins": f"{_CODES} SELECT feature, code::INT AS code, count(*) AS rows FROM codes GROUP BY ALL",
    "first_splits": f"{_CODES}, {_SIZES}, w AS (SELECT id, CASE WHEN flag = 1 THEN 0.5 / (one / total::DOUBLE) ELSE 0.5 / (1 - one / total::DOUBLE) END AS w, flag FROM t, n), "
    "s AS (SELECT feature, code, sum(round(w * (0.5 - flag) * 1048576)) / 1048576 AS g, sum(round(w * 0.25 * 1048576)) / 1048576 AS h, count(*) AS m FROM codes JOIN w USING (id) GROUP BY ALL), "
    "c AS (SELECT feature, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(m) OVER o AS ml, sum(g) OVER p AS gt, sum(h) OVER p AS ht, sum(m) OVER p AS mt FROM s WINDOW o AS (PARTITION BY feature ORDER BY code), p AS (PARTITION BY feature)), "
    "b AS (SELECT feature, max(gl * gl / (hl + 0.05) + (gt - gl) * (gt - gl) / (ht - hl + 0.05) - gt * gt / (ht + 0.05)) FILTER (WHERE ml >= 80 AND mt - ml >= 80) AS gain FROM c GROUP BY feature) "
    "SELECT feature, round(CASE WHEN gain > 1e-12 THEN gain ELSE 0 END, 6) AS gain FROM b",
}


def _joined(*parts: str) -> str:
    """SQL for a whole family: its parts, which are checked one by one too, joined by id."""
    first, *rest = (f"({ORACLE.get(p, p)})" for p in parts)
    return f"SELECT * FROM {first} p0 " + " ".join(f"JOIN {x} p{k} USING (id)" for k, x in enumerate(rest, 1))


_OWN = f"WITH {_H} SELECT id, {{}} FROM h GROUP BY id"
ORACLE |= {
    "family_basic": _joined("basic_stats", "loan_count", "paym_status_counts", "paym_summary", "bucket_counts", "id_norm"),
    "family_extra": _joined(_OWN.format(_wide_counts(vocab.EXTRA_BUCKETS, "xcnt", False) + ", count(*)::DOUBLE AS xloan_count_check"), "bucket_props", "recent_stats_k", "payment_agg", "cross_counts"),
    "family_sequence": _joined("seq_pivot", "seq_delta"),
    "family_distribution": _joined(
        _OWN.format(", ".join(_wide_counts(vocab.DIST_BUCKETS, p, s) for p, s in (("d_cnt", False), ("dprop", True)))), "last_onehot", "recent_props_k",
        _OWN.format(", ".join(_wide_crosses(vocab.DIST_CROSSES, p, s) for p, s in (("dcross", False), ("dcrossprop", True)))),
    ),
}

ORACLE |= {
    "state_extra": ORACLE["family_extra"],
    "state_distribution": ORACLE["family_distribution"],
    "state_scores": f"WITH {_T} {_effect('(' + ORACLE['family_sequence'] + ')', list(state.FAMILIES['seq']()), True)}",
}

QUERIES = {
    f.__name__: f
    for f in (
        basic_stats, loan_count, paym_status_counts, paym_summary, bucket_counts, bucket_counts_tall, dist_counts_tall, bucket_props, recent_stats_k, payment_agg, cross_counts, cross_counts_tall, cross_props,
        last_onehot, recent_props_k, seq_pivot, seq_delta, id_norm, target_join, effect_size_sample, effect_size_pop, top_n_must_keep, joint_top_n, family_top_n, stratified_split, training_sample, neg_undersample,
        bounded_sample, id_tail_split, class_weights, roc_auc, logit_blend, weight_grid2, weight_grid3, calibrate_prior, family_join, semi_join_sample, submission_left_join, submission_checks, submission_format,
        missing_columns, event_stats, stream_counts, family_basic, family_extra, family_sequence, family_distribution, state_extra, state_distribution, state_scores, feature_bins, first_splits, logistic_baseline, stochastic_baseline, boosted_model,
    )
}
