"""Queries of the statistical jobs, of synergy and frontiers, and of the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import r4
from ..operators import panel as P
from ..operators import scalar as S
from ..operators import series as T
from ..operators import stats as M
from ..operators import synergy as Y
from ..sources import tables as IO
from .q_aggregates import POST, posterior, rounded
from .registry import query

NUM = ["npv", "carbon", "wind"]


@query("b15_panel_efficiency", "pixels")
def b15(t):
    df = t.pixels.select("pixel_id", (F.col("rsds") * 1e6 / 86400).alias("sun"), (F.col("tas") * 0.1).alias("air"), (F.col("wind") + 0.5).alias("wind"), (5 + F.col("prob") * 20).alias("vapour"))
    return rounded(P.panel_efficiency(df, "pixel_id", "sun", "air", "wind", "vapour"), "pixel_id", places=6)


@query(
    "g1_preprocess",
    "pixels",
    """SELECT pixel_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS v, round((npv - avg(npv) OVER ()) / stddev_pop(npv) OVER (), 6) AS npv, """
    + ", ".join(f"CAST(landcover = {k} AS INT) AS landcover_{k}" for k in range(1, 10))
    + """ FROM (SELECT *, coalesce(w, (SELECT median(CASE WHEN pixel_id % 11 <> 0 THEN wind END) FROM pixels)) AS v FROM (SELECT *, CASE WHEN pixel_id % 11 <> 0 THEN wind END AS w FROM pixels) a) b""",
)
def g1(t):
    df = t.pixels.withColumn("v", F.when(F.col("pixel_id") % 11 != 0, F.col("wind"))).select("pixel_id", "v", "npv", "landcover")
    return rounded(M.preprocess(df, ["v", "npv"], "landcover").drop("landcover"), "pixel_id", places=6)


def _mixture(t, ks=(2, 3)):
    scaled = M.preprocess(t.pixels, NUM, "landcover")
    model, table = M.fit_mixture(scaled, NUM, list(ks), "pixel_id")
    return scaled, *M.mixture_arrays(model), table


@query("g2_fit_mixture")
def g2(t):
    *_, table = _mixture(t, range(15, 36, 2))
    return t.spark.createDataFrame([(k, r, float(ll), float(b)) for k, r, ll, b, _ in table], "k int, restart int, log_likelihood double, bic double")


@query("g3_mixture_score")
def g3(t):
    scaled, w, m, c, _ = _mixture(t)
    return M.mixture_score(scaled, NUM, w, m, c, "pixel_id").select("pixel_id", r4("logdens").alias("logdens"), "component")


CAL = "(SELECT mu, median(abs(carbon - mu)) * 1.4826e0 + 1e-12 AS sd, min(carbon) AS lo, max(carbon) AS hi FROM pixels, (SELECT median(carbon) AS mu FROM pixels) z GROUP BY mu)"


@query(
    "g4_env_score",
    "pixels",
    f"""SELECT pixel_id, round(1 / (1 + exp(-least(greatest(0.01e0 * (carbon - mu), -50), 50))), 6) AS sigmoid, round(least(greatest((carbon - lo) / greatest(hi - lo, 1e-12), 0), 1), 6) AS minmax, round((carbon - mu) / sd, 6) AS zscore FROM pixels, {CAL} c""",
)
def g4(t):
    df, cal = t.pixels.select("pixel_id", "carbon"), M.calibrate(t.pixels, "carbon")
    for m in ("sigmoid", "minmax", "zscore"):
        df = M.env_score(df, "carbon", cal, m, 0.01, m)
    return rounded(df.drop("carbon"), "pixel_id", places=6)


@query("g5_calibrate", "pixels", f"SELECT round(mu, 4) AS mu, round(sd, 4) AS sd, round(lo, 4) AS low, round(hi, 4) AS high FROM {CAL} c")
def g5(t):
    return rounded(M.calibrate(t.pixels, "carbon"))


@query(
    "g6_similar_mask",
    "pixels",
    """SELECT pixel_id, carbon >= q AS similar, round((carbon - m) / s, 6) AS z FROM pixels, (SELECT quantile_cont(carbon, 0.05) AS q, avg(carbon) AS m, stddev_pop(carbon) AS s FROM pixels WHERE pixel_id % 10 = 0) r WHERE pixel_id % 10 <> 0""",
)
def g6(t):
    out = M.similar_mask(t.pixels.where("pixel_id % 10 = 0"), t.pixels.where("pixel_id % 10 <> 0"), "carbon")
    return out.select("pixel_id", "similar", r4("z", 6).alias("z"))


ENT = "-greatest(p0, 1e-10) * ln(greatest(p0, 1e-10)) - greatest(p1, 1e-10) * ln(greatest(p1, 1e-10))"


@query(
    "g7_cluster_posterior",
    "",
    f"""SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS dominant, round({ENT}, 6) AS entropy, round(({ENT}) / ln(2e0), 6) AS entropy_share
        FROM (SELECT vec_id, p[1] + p[3] AS p0, p[2] + p[4] AS p1 FROM ({POST}) a) b""",
)
def g7(t):
    return rounded(M.cluster_posterior(posterior(t), "vec_id", "p", {0: 0, 1: 1, 2: 0, 3: 1}), "vec_id", "dominant", places=6)


GROUPS = {"value": [0], "carbon": [1], "weather": [2]}


@query("g8_hex_pattern")
def g8(t):
    scaled, w, m, c, _ = _mixture(t)
    scores = t.spark.createDataFrame(M.pattern_score(w, m, c, GROUPS), "component int, pattern string, score double")
    post = M.mixture_score(scaled, NUM, w, m, c, "pixel_id").join(t.pixels.select("pixel_id", "state_key"), "pixel_id")
    return rounded(M.hex_pattern(post, scores, ["state_key"]), "state_key", places=6)


SH = "list_transform(list_reverse_sort([p[1], p[2], p[3], p[4]]), lambda x: x)"


@query(
    "g9_classify_pattern",
    "",
    f"""SELECT vec_id, CASE WHEN s[1] > 0.55 THEN 'Dominant' WHEN s[4] > 0.12 AND s[1] < 0.40 THEN 'Mixed-Quad' WHEN s[3] > 0.15 AND s[1] < 0.50 THEN 'Mixed-Triple' WHEN s[2] > 0.20 AND s[1] < 0.55 THEN 'Mixed-Dual' ELSE 'Dominant' END AS pattern,
        ['a', 'b', 'c', 'd'][list_position(p, list_max(p))] AS first FROM (SELECT *, {SH} AS s FROM ({POST}) a) b""",
)
def g9(t):
    df = posterior(t).select("vec_id", *[F.col("p")[i].alias(n) for i, n in enumerate("abcd")])
    return M.classify_pattern(df, "vec_id", list("abcd"))


def _split(t):
    return t.pixels.where("pixel_id % 10 = 0"), t.pixels.where("pixel_id % 10 <> 0")


@query("g10_negatives_by_selection")
def g10(t):
    pos, pool = _split(t)
    return M.negatives_by_selection(pos, pool.select("pixel_id", "prob"), "prob", "pixel_id").select("pixel_id", "level", r4("pit", 6).alias("pit"))


def _generated(t):
    scaled, w, m, c, _ = _mixture(t)
    positives = IO.stored(scaled.where("pixel_id % 10 = 0").select("pixel_id", *NUM), "positives")
    cut = M.log_density(positives, NUM, w, m, c).agg(F.avg("logdens") - F.stddev_pop("logdens")).first()[0]
    return scaled, M.negatives_by_generation(positives, "pixel_id", w, m, c, NUM, positives.count(), cut)


@query("g11_negatives_by_generation")
def g11(t):
    return rounded(_generated(t)[1], "id", "nearest")


@query("g12_negatives_hybrid")
def g12(t):
    scaled, made = _generated(t)
    pos, pool = _split(t)
    chosen = M.negatives_by_selection(pos, pool.select("pixel_id", "prob"), "prob", "pixel_id").select("pixel_id")
    rows = scaled.join(chosen, "pixel_id", "left_semi").select(F.col("pixel_id").alias("id"), *NUM)
    return rounded(M.negatives_hybrid(rows, made.select("id", *NUM), pos.count()), "id")


def _labelled(t):
    return t.pixels.select("pixel_id", "prob", "carbon", "wind", (F.col("npv") / 1e5).alias("npv"), (F.col("prob") + F.col("npv") / 1e6 > 0.5).cast("int").alias("label"))


LABELLED = "SELECT CAST(prob + npv / 1e6 > 0.5e0 AS INT) AS label FROM pixels"


@query(
    "g13_stratified_split",
    "pixels",
    f"""SELECT label, CAST(p AS INT) AS part, CAST(CASE p WHEN 0 THEN round(n * 0.6e0) WHEN 1 THEN round(n * 0.8e0) - round(n * 0.6e0) ELSE n - round(n * 0.8e0) END AS BIGINT) AS n
        FROM (SELECT label, count(*) AS n FROM ({LABELLED}) l GROUP BY 1) a, (SELECT unnest([0, 1, 2]) AS p) b""",
)
def g13(t):
    return M.stratified_split(_labelled(t), "label", "pixel_id").groupBy("label", "part").agg(F.count("*").alias("n"))


FEATURES = ["prob", "carbon", "wind", "npv"]


@query("g14_train_compare")
def g14(t):
    parts = M.stratified_split(_labelled(t), "label", "pixel_id")
    return rounded(M.train_compare(parts.where("part = 0"), parts.where("part = 2"), FEATURES, "label")[1], "model")


@query("g15_score_pool")
def g15(t):
    parts = M.stratified_split(_labelled(t), "label", "pixel_id")
    train = parts.where("part = 0")
    return rounded(M.score_pool(train, parts.where("part = 2"), parts.where("part > 0"), train.where("label = 0"), FEATURES, "label", "pixel_id")[0], "pixel_id")


SCORED = "SELECT pixel_id, prob, CAST(pixel_id % 3 = 0 OR prob > 0.8e0 AS INT) AS label FROM pixels"


def _scored(t):
    return t.pixels.select("pixel_id", "prob", ((F.col("pixel_id") % 3 == 0) | (F.col("prob") > 0.8)).cast("int").alias("label"))


@query(
    "g16_binary_metrics",
    "pixels",
    f"""SELECT tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
        round((r - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)), 6) AS auc, round(ll, 6) AS log_loss, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
        round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa, round((tp / (tp + fn) + tn / (fp + tn)) / 2, 6) AS balanced_accuracy
        FROM (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM (
          SELECT CAST(count(*) FILTER (label = 1 AND prob >= 0.5e0) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 0 AND prob >= 0.5e0) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 1 AND prob < 0.5e0) AS DOUBLE) AS fn,
                 CAST(count(*) FILTER (label = 0 AND prob < 0.5e0) AS DOUBLE) AS tn, CAST(count(*) AS DOUBLE) AS n, sum(rk) FILTER (label = 1) AS r,
                 avg(-CASE WHEN label = 1 THEN ln(greatest(least(prob, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15)) END) AS ll
          FROM (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2e0 AS rk FROM ({SCORED}) s) x) y) z""",
)
def g16(t):
    return rounded(M.binary_metrics(_scored(t), "label", "prob"), places=6)


@query(
    "g17_pu_threshold_sweep",
    "pixels",
    f"""SELECT round(c, 2) AS threshold, tp, fn, fp, tn, round(d, 6) AS detection, round(r, 6) AS recall, round(coalesce(p, 0), 6) AS precision, round(f, 6) AS fpr, round(r * w / (r * w + f * (1 - w)), 6) AS precision_corrected,
        round(coalesce(2 * p * r / (p + r), 0), 6) AS f1, round(r * r / greatest(d, 0.001e0), 6) AS f1_pu, CASE WHEN d < 0.001e0 THEN 'Low' WHEN d < 0.01e0 THEN 'Medium' ELSE 'High' END AS reliability
        FROM (SELECT c, tp, fn, fp, tn, tp / (tp + fn) AS r, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, fp / (fp + tn) AS f, 1 / 1.3e0 AS w, (SELECT avg(CAST(prob >= c AS INT)) FROM pixels WHERE pixel_id % 2 = 1) AS d
              FROM (SELECT c, CAST(count(*) FILTER (label = 1 AND prob >= c) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 1 AND prob < c) AS DOUBLE) AS fn, CAST(count(*) FILTER (label = 0 AND prob >= c) AS DOUBLE) AS fp,
                           CAST(count(*) FILTER (label = 0 AND prob < c) AS DOUBLE) AS tn FROM ({SCORED}) s, (SELECT CAST(i AS DOUBLE) * 5 / 100 AS c FROM range(1, 20) x(i)) g WHERE pixel_id % 2 = 0 GROUP BY 1) a) b""",
)
def g17(t):
    df = _scored(t)
    return rounded(M.pu_threshold_sweep(df.where("pixel_id % 2 = 0"), df.where("pixel_id % 2 = 1"), "label", "prob"), "threshold", places=6)


@query(
    "g17_best_threshold",
    "pixels",
    f"""WITH s AS (SELECT c, d, pow(tp / (tp + fn), 2) / greatest(d, 0.001e0) AS f FROM (SELECT c, CAST(count(*) FILTER (label = 1 AND prob >= c) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 1 AND prob < c) AS DOUBLE) AS fn,
               (SELECT avg(CAST(prob >= c AS INT)) FROM pixels WHERE pixel_id % 2 = 1) AS d FROM ({SCORED}) x, (SELECT CAST(i AS DOUBLE) * 5 / 100 AS c FROM range(1, 20) x(i)) g WHERE pixel_id % 2 = 0 GROUP BY 1) a)
        SELECT round(coalesce((SELECT c FROM s WHERE d >= 0.001e0 ORDER BY f DESC, c LIMIT 1), (SELECT c FROM s ORDER BY d DESC, c LIMIT 1)), 2) AS threshold""",
)
def g17b(t):
    df = _scored(t)
    return rounded(M.best_threshold(M.pu_threshold_sweep(df.where("pixel_id % 2 = 0"), df.where("pixel_id % 2 = 1"), "label", "prob")), places=2)


@query("g18_learning_curve")
def g18(t):
    return rounded(M.learning_curve(_labelled(t), FEATURES, "label", "pixel_id"), "size")


@query(
    "g19_ols_univariate",
    "pixels",
    " UNION ALL ".join(f"SELECT '{x}' AS x, round(regr_slope(npv, {x}), 4) AS slope, round(regr_intercept(npv, {x}), 4) AS intercept, round(regr_r2(npv, {x}), 8) AS r2, CAST(regr_count(npv, {x}) AS BIGINT) AS n FROM pixels" for x in ("prob", "carbon", "wind")),
)
def g19(t):
    df = M.ols_univariate(t.pixels, "npv", ["prob", "carbon", "wind"])
    return df.select("x", r4("slope").alias("slope"), r4("intercept").alias("intercept"), r4("r2", 8).alias("r2"), "n")


@query("g19_ols")
def g19b(t):
    return rounded(M.ols(t.pixels, "npv", ["prob", "carbon", "wind"]), "term")


def _poly(x, coefficients):
    return " + ".join(f"{c!r} * pow({x}, {len(coefficients) - 1 - i})" for i, c in enumerate(coefficients))


TAIL = f"(({_poly('sqrt(-2 * ln(least(q, 1 - q)))', D.PROBIT_C)}) / ({_poly('sqrt(-2 * ln(least(q, 1 - q)))', (*D.PROBIT_D, 1.0))}))"
PROBIT = f"""CASE WHEN q < 0.02425e0 THEN {TAIL} WHEN q > 1 - 0.02425e0 THEN -{TAIL} ELSE ({_poly('pow(q - 0.5e0, 2)', D.PROBIT_A)}) * (q - 0.5e0) / ({_poly('pow(q - 0.5e0, 2)', (*D.PROBIT_B, 1.0))}) END"""
LAMBDAS = (-2, -1.5, -1, -0.5, 0, 0.5, 1, 1.5, 2)


def _likelihoods(form, jacobian, where):
    """Oracle of a grid of transforms: -n / 2 log variance + (lambda - 1) * sum of the logs."""
    one = lambda g: f"SELECT CAST({g} AS DOUBLE) AS lam, round(-count(*) / 2e0 * ln(var_pop({form(g)})) + ({g} - 1) * sum({jacobian}), 4) AS ll FROM pixels WHERE {where}"
    return " UNION ALL ".join(one(g) for g in LAMBDAS)


def _yeo_johnson(g):
    up = "ln(1 + abs(carbon))" if g == 0 else f"(pow(abs(carbon) + 1, {g}) - 1) / ({g})"
    down = "ln(1 + abs(carbon))" if g == 2 else f"(pow(abs(carbon) + 1, {2 - g}) - 1) / ({2 - g})"
    return f"CASE WHEN carbon >= 0 THEN {up} ELSE -({down}) END"


@query(
    "g20_transform_vars",
    "pixels",
    f"""SELECT pixel_id, round((carbon - mu) / sd, 6) AS standard, round(ln(carbon - lo + 1), 6) AS log_shift, round(sqrt(carbon - lo + 0.001e0), 6) AS sqrt_shift, round(carbon * carbon, 4) AS square, round(ln(q / (1 - q)), 6) AS logit, round({PROBIT}, 6) AS probit
       FROM (SELECT *, ((carbon - lo) / (hi - lo) * (n - 1) + 0.5e0) / n AS q FROM pixels, (SELECT min(carbon) AS lo, max(carbon) AS hi, avg(carbon) AS mu, stddev_pop(carbon) AS sd, count(carbon) AS n FROM pixels) s) x""",
)
def g20(t):
    df = M.transform_vars(t.pixels.select("pixel_id", "carbon"), "carbon").drop("carbon")
    return df.select("pixel_id", *[r4(c, 4 if c == "square" else 6).alias(c) for c in ("standard", "log_shift", "sqrt_shift", "square", "logit", "probit")])


@query("g20_box_cox", "pixels", _likelihoods(lambda g: "ln(rsds)" if g == 0 else f"(pow(rsds, {g}) - 1) / ({g})", "ln(rsds)", "rsds > 0"))
def g20b(t):
    return rounded(M.box_cox_lambda(t.pixels, "rsds"))


def _best(name: str, likelihoods: str) -> str:
    """The lambda in steps of 0.01 with the greatest of the likelihoods by lambda."""
    return f"SELECT '{name}' AS kind, round(max_by(lam, ll), 2) AS lam FROM ({likelihoods}) b"


def _by_lambda(form: str, log_slope: str, x: str, where: str, lows: int, highs: int) -> str:
    return f"""SELECT g / 1e2 AS lam, -count(*) / 2e0 * ln(var_pop({form})) + (g / 1e2 - 1) * sum({log_slope}) AS ll
        FROM (SELECT {x} AS x FROM pixels WHERE {where}) v, range({lows}, {highs}) r(g) GROUP BY g"""


BOX = "CASE WHEN g = 0 THEN ln(x) ELSE (pow(x, g / 1e2) - 1) / (g / 1e2) END"
YEO = """CASE WHEN x >= 0 THEN CASE WHEN g = 0 THEN ln(1 + x) ELSE (pow(1 + x, g / 1e2) - 1) / (g / 1e2) END
         ELSE CASE WHEN g = 200 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - g / 1e2) - 1) / (2 - g / 1e2) END END"""


@query(
    "g20_best_lambda",
    "pixels",
    _best("box_cox", _by_lambda(BOX, "ln(x)", "rsds", "rsds > 0", -200, 301)) + " UNION ALL " + _best("yeo_johnson", _by_lambda(YEO, "sign(x) * ln(1 + abs(x))", "carbon", "carbon IS NOT NULL", -200, 301)),
)
def g20d(t):
    rows = [(kind, M.best_lambda(t.pixels, column, kind).lam) for kind, column in (("box_cox", "rsds"), ("yeo_johnson", "carbon"))]
    return rounded(t.spark.createDataFrame(rows, "kind string, lam double"), "kind", places=2)


@query("g20_yeo_johnson", "pixels", _likelihoods(_yeo_johnson, "sign(carbon) * ln(1 + abs(carbon))", "carbon IS NOT NULL"))
def g20c(t):
    return rounded(M.yeo_johnson_lambda(t.pixels, "carbon"))


TT = "SELECT state_key, count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS sd, round(avg({v}) / (stddev_samp({v}) / sqrt(count({v}))), 4) AS t, round(avg({v}) / stddev_samp({v}), 6) AS d, round(avg({v}) - 1.96e0 * stddev_samp({v}) / sqrt(count({v})), 3) AS low, round(avg({v}) + 1.96e0 * stddev_samp({v}) / sqrt(count({v})), 3) AS high FROM pixels GROUP BY 1"


def _tt(df):
    return df.select("state_key", "n", *[r4(c, p).alias(c) for c, p in (("mean", 4), ("sd", 4), ("t", 4), ("d", 6), ("low", 3), ("high", 3))])


@query("g21_ttest_table", "pixels", TT.format(v="carbon"))
def g21(t):
    return _tt(M.ttest_table(t.pixels, "state_key", "carbon"))


@query("g21_paired_table", "pixels", TT.format(v="(rsds - wind)"))
def g21b(t):
    return _tt(M.paired_table(t.pixels, "state_key", "rsds", "wind"))


@query("g21_p_values")
def g21c(t):
    return rounded(M.with_p_values(M.ttest_table(t.pixels, "state_key", "npv")), "state_key")


@query("g22_sample_by_group")
def g22(t):
    return M.sample_by_group(t.pixels, ["state_key", "landcover"], 5, "pixel_id").select("state_key", "landcover", "pixel_id")


LEVELS = {"depth": [1, 2, 3], "width": [8, 16, 32], "rate": [0.1, 0.01, 0.001], "drop": [0.0, 0.2, 0.4], "heads": [1, 2, 4], "batch": [32, 64, 128]}


def _runs(t):
    design = M.design_l18(t.spark, LEVELS)
    means = t.pixels.groupBy((F.col("pixel_id") % 18 + 1).cast("int").alias("exp_id")).agg(F.avg("prob").alias("f1"))
    return design.join(means, "exp_id"), list(LEVELS)


DESIGN = "(VALUES " + ", ".join("(" + ", ".join(map(str, (k + 1, *row))) + ")" for k, row in enumerate(M.L18)) + ") AS d(exp_id, depth, width, rate, \"drop\", heads, batch)"
RUNS = f"SELECT d.*, f1 FROM {DESIGN} JOIN (SELECT pixel_id % 18 + 1 AS e, avg(prob) AS f1 FROM pixels GROUP BY 1) m ON exp_id = e"


@query(
    "g23_sensitivity_tables",
    "pixels",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS factor, CAST([{', '.join(map(str, values))}]["{f}"] AS DOUBLE) AS level, round(avg(f1), 4) AS mean, count(f1) AS n FROM ({RUNS}) r GROUP BY "{f}\""""
        for f, values in LEVELS.items()
    ),
)
def g23(t):
    runs, factors = _runs(t)
    return rounded(M.sensitivity_tables(runs, factors, "f1"), "factor", "level")


@query("g23_best_run", "pixels", "SELECT CAST(pixel_id % 18 + 1 AS INT) AS exp_id FROM pixels GROUP BY 1 ORDER BY avg(prob) DESC, 1 LIMIT 1")
def g23b(t):
    return M.best_run(_runs(t)[0], "f1")


U = ["u1", "u2", "u3"]
UNIT = "SELECT pixel_id, area_m2, prob AS u1, CAST((pixel_id * 61) % 9001 AS DOUBLE) / 9e3 AS u2, CAST((pixel_id * 29) % 90 AS DOUBLE) / 89e0 AS u3 FROM pixels"


def _unit(t):
    return t.spark.sql(UNIT.replace("FROM pixels", "FROM {pixels}"), pixels=t.pixels)


CC = "CASE WHEN u1 + u2 + u3 = 0 THEN 0e0 ELSE pow(u1 * u2 * u3 / pow((u1 + u2 + u3) / 3, 3), 1e0 / 3) END"


@query("g24_ccd", "pixels", f"SELECT pixel_id, round(c, 6) AS c, round((u1 + u2 + u3) / 3, 6) AS t, round(sqrt(c * (u1 + u2 + u3) / 3), 6) AS d FROM (SELECT *, {CC} AS c FROM ({UNIT}) u) x")
def g24(t):
    c, b, d = Y.ccd(U)
    return _unit(t).select("pixel_id", r4(c, 6).alias("c"), r4(b, 6).alias("t"), r4(d, 6).alias("d"))


MEAN_CCD = f"avg(sqrt(greatest({CC} * (u1 * a + u2 * b + u3 * (1 - a - b)), 0e0)))"


def _finer(level: int, width: float) -> str:
    """The best weights among 11 x 11 around those of the level before (at first the whole simplex)."""
    if level == 0:
        points = "SELECT i, j, i / 10e0 AS a, j / 10e0 AS b FROM range(11) x(i), range(11) y(j)"
    else:
        points = f"SELECT i, j, f.a + {width} * (i - 5) / 5e0 AS a, f.b + {width} * (j - 5) / 5e0 AS b FROM f{level - 1} f, range(11) x(i), range(11) y(j)"
    return f"SELECT a, b, {MEAN_CCD} AS m FROM (SELECT * FROM ({points}) s WHERE a >= -1e-12 AND b >= -1e-12 AND a + b <= 1 + 1e-12) p, u GROUP BY i, j, a, b ORDER BY {MEAN_CCD} DESC, i, j LIMIT 1"


@query(
    "g25_ccd_optimize",
    "pixels",
    f"WITH u AS ({UNIT}), " + ", ".join(f"f{k} AS ({_finer(k, w)})" for k, w in enumerate((0, 0.1, 0.02, 0.004, 0.0008, 0.00016))) + " SELECT round(a, 2) AS l1, round(b, 2) AS l2, round(1 - a - b, 2) AS l3, round(m, 6) AS ccd FROM f5",
)
def g25(t):
    best = Y.ccd_optimize(_unit(t), U)
    return best.select(*[r4(c, 2).alias(c) for c in ("l1", "l2", "l3")], r4("ccd", 6).alias("ccd"))


@query("g25_ccd_pixel", "pixels", f"SELECT pixel_id, round(sqrt(c * greatest(u1, u2, u3)), 6) AS ccd FROM (SELECT *, {CC} AS c FROM ({UNIT}) u) x")
def g25b(t):
    return Y.ccd_optimize(_unit(t), U, mode="pixel").select("pixel_id", r4("ccd", 6).alias("ccd"))


LAM = "SELECT i * 11 + j AS lam_id, CAST(i AS DOUBLE) / 10 AS l1, CAST(j AS DOUBLE) / 10 AS l2, CAST(10 - i - j AS DOUBLE) / 10 AS l3 FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10"


@query("g26_lambda_grid", "pixels", f"SELECT lam_id, l1, l2, l3, round(l1 * a + l2 * b + l3 * c, 6) AS mean_score FROM ({LAM}) g, (SELECT avg(u1) AS a, avg(u2) AS b, avg(u3) AS c FROM ({UNIT}) u) m")
def g26(t):
    means = _unit(t).agg(F.avg("u1").alias("a"), F.avg("u2").alias("b"), F.avg("u3").alias("c"))
    df = Y.lambda_grid(t.spark, 10).crossJoin(means)
    return df.select("lam_id", "l1", "l2", "l3", r4(F.col("l1") * F.col("a") + F.col("l2") * F.col("b") + F.col("l3") * F.col("c"), 6).alias("mean_score"))


EVAL = f"""SELECT lam_id, l1, l2, l3, {', '.join(f'sum({u} * (1 - (k - 0.5e0) / n) / n) AS kernel_{u}' for u in U)}, {', '.join(f'sum({u} * (area_m2 / 1e4) * (n - k + 0.5e0) / n) / sum(area_m2 / 1e4) AS perf_{u}' for u in U)}
    FROM (SELECT *, row_number() OVER (PARTITION BY lam_id ORDER BY l1 * u1 + l2 * u2 + l3 * u3 DESC, pixel_id) AS k, count(*) OVER (PARTITION BY lam_id) AS n FROM ({UNIT}) u, ({LAM}) g) x GROUP BY 1, 2, 3, 4"""
EVALS = [f"{k}_{u}" for k in ("kernel", "perf") for u in U]


@query("g27_evaluate_lambdas", "pixels", f"SELECT lam_id, l1, l2, l3, {', '.join(f'round({c}, 6) AS {c}' for c in EVALS)} FROM ({EVAL}) e")
def g27(t):
    return rounded(Y.evaluate_lambdas(_unit(t), Y.lambda_grid(t.spark, 10), U, "pixel_id"), "lam_id", "l1", "l2", "l3", places=6)


@query("g28_pareto_front", "pixels", f"WITH u AS ({UNIT}) SELECT pixel_id FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.u1 >= a.u1 AND b.u2 >= a.u2 AND b.u3 >= a.u3 AND (b.u1 > a.u1 OR b.u2 > a.u2 OR b.u3 > a.u3))")
def g28(t):
    return Y.pareto_front(_unit(t), U).select("pixel_id")


@query(
    "g29_locate_in_front",
    "pixels",
    f"""WITH u AS ({UNIT}), p AS (SELECT avg(u1) AS a, avg(u2) AS b, avg(u3) AS c FROM u)
        SELECT round(sqrt(min(pow(u1 - a, 2) + pow(u2 - b, 2) + pow(u3 - c, 2))), 6) AS distance, round(avg(CAST(u1 < a AS INT)) * 100, 4) AS below_u1, round(avg(CAST(u2 < b AS INT)) * 100, 4) AS below_u2, round(avg(CAST(u3 < c AS INT)) * 100, 4) AS below_u3,
        round(avg(CAST((u1 + u2 + u3) / 3 < (a + b + c) / 3 AS INT)) * 100, 4) AS below_mean, CASE WHEN avg(CAST((u1 + u2 + u3) / 3 < (a + b + c) / 3 AS INT)) >= 0.75 THEN 'top' WHEN avg(CAST((u1 + u2 + u3) / 3 < (a + b + c) / 3 AS INT)) >= 0.25 THEN 'middle' ELSE 'bottom' END AS region FROM u, p""",
)
def g29(t):
    df = _unit(t)
    out = Y.locate_in_front(df.agg(*[F.avg(c).alias(c) for c in U]), df, U)
    return out.select(r4("distance", 6).alias("distance"), *[r4(c).alias(c) for c in ("below_u1", "below_u2", "below_u3", "below_mean")], "region")


PCTU = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0) / count(*) OVER () * 100"


@query(
    "g30_rank_candidates",
    "pixels",
    f"""SELECT pixel_id, round(a, 4) AS pct_u1, round(b, 4) AS pct_u2, round(c, 4) AS pct_u3, round(m, 6) AS composite, a >= 70 AND b >= 70 AND c >= 70 AS all_high FROM (SELECT pixel_id, {PCTU.format(c='u1')} AS a, {PCTU.format(c='u2')} AS b, {PCTU.format(c='u3')} AS c,
        ((u1 - min(u1) OVER ()) / (max(u1) OVER () - min(u1) OVER ()) + (u2 - min(u2) OVER ()) / (max(u2) OVER () - min(u2) OVER ()) + (u3 - min(u3) OVER ()) / (max(u3) OVER () - min(u3) OVER ())) / 3 AS m FROM ({UNIT}) u) x""",
)
def g30(t):
    df = Y.rank_candidates(_unit(t), U, "pixel_id")
    return df.select("pixel_id", *[r4(f"pct_{u}").alias(f"pct_{u}") for u in U], r4("composite", 6).alias("composite"), "all_high")


PLANE = "SELECT mz - a * mx - b * my AS c, a, b FROM (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM (SELECT avg(u1) AS mx, avg(u2) AS my, avg(u3) AS mz, var_pop(u1) AS xx, var_pop(u2) AS yy, covar_pop(u1, u2) AS xy, covar_pop(u1, u3) AS xz, covar_pop(u2, u3) AS yz FROM u) s) r"


@query("g31_plane_fit", "pixels", f"WITH u AS ({UNIT}) SELECT round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(avg(abs(u3 - (a * u1 + b * u2 + c))), 6) AS mean_error, round(max(abs(u3 - (a * u1 + b * u2 + c))), 6) AS max_error FROM u, ({PLANE}) p GROUP BY a, b, c")
def g31(t):
    return rounded(Y.plane_fit(_unit(t), "u1", "u2", "u3"), places=6)


def _factor(last):
    return f"""(SELECT scenario, sum(v / g[1] * 352e0) AS grams FROM (SELECT scenario, g, y, CASE WHEN y < 2030 THEN g[1] + (g[2] - g[1]) * (y - 2020) / 10 WHEN y < 2040 THEN g[2] + (g[3] - g[2]) * (y - 2030) / 10 ELSE g[3] + (g[4] - g[3]) * (y - 2040) / 10 END AS v
        FROM (SELECT scenario, list(g_per_kwh ORDER BY year) AS g FROM intensity GROUP BY 1) a, range(2020, {last}) r(y)) b GROUP BY 1)"""


DENS = "(rsds * area_m2) / (area_m2 / 1e4)"


@query(
    "g32_carbon_matrix",
    "pixels intensity",
    f"""SELECT scenario, a AS availability, CAST(e AS DOUBLE) / 100 AS efficiency, round(g * k, 8) AS gt, round(m * k, 6) AS mean_t_ha, round(d * k, 6) AS median_t_ha
        FROM (SELECT *, grams * (CAST(a AS DOUBLE) / 100 * (CAST(e AS DOUBLE) / 100) / 0.17e0) * 0.27e0 AS k FROM {_factor(2051)} f, (SELECT sum(rsds * area_m2) / 1e15 AS g, avg({DENS}) / 1e6 AS m, median({DENS}) / 1e6 AS d FROM pixels) p, (SELECT unnest([60, 80, 100]) AS a) x, (SELECT unnest([15, 17, 21]) AS e) y) z""",
)
def g32(t):
    pixels = t.pixels.withColumn("kwh", F.col("rsds") * F.col("area_m2"))
    out = Y.carbon_matrix(pixels, Y.intensity_factor(t.intensity, "scenario"), [60, 80, 100], [0.15, 0.17, 0.21], "kwh")
    return out.select("scenario", "availability", "efficiency", r4("gt", 8).alias("gt"), r4("mean_t_ha", 6).alias("mean_t_ha"), r4("median_t_ha", 6).alias("median_t_ha"))


@query("g33_carbon_to_year", "intensity", f"SELECT scenario, round(grams, 4) AS grams FROM {_factor(2040)} f")
def g33(t):
    return rounded(Y.intensity_factor(t.intensity, "scenario", 2040, include_end=False), "scenario")


@query(
    "g34_scenario_mean_density",
    "pixels intensity",
    f"""SELECT round(md * mf, 6) AS mean, round(ed * mf, 6) AS sem, round(sqrt(pow(ed * mf, 2) + pow(md * ef, 2)), 6) AS se_all FROM (SELECT avg(grams) AS mf, stddev_samp(grams) / sqrt(count(grams)) AS ef FROM {_factor(2051)} f) a,
        (SELECT avg({DENS} / 1e6 * 0.27e0) AS md, stddev_samp({DENS} / 1e6 * 0.27e0) / sqrt(count(*)) AS ed FROM pixels) b""",
)
def g34(t):
    pixels = t.pixels.withColumn("kwh", F.col("rsds") * F.col("area_m2"))
    return rounded(Y.scenario_mean_density(pixels, Y.intensity_factor(t.intensity, "scenario"), "kwh"), places=6)


@query("g35_decade_carbon", "pixels", f"SELECT pixel_id, round({DENS} / 1e6 * 0.27e0 * 3500e0, 6) AS decade_1, round({DENS} / 1e6 * 0.27e0 * 3000e0, 6) AS decade_2, round({DENS} / 1e6 * 0.27e0 * 2000e0, 6) AS decade_3, round({DENS} / 1e6 * 0.27e0 * 8500e0, 5) AS total FROM pixels")
def g35(t):
    out = Y.decade_carbon(t.pixels.withColumn("kwh", F.col("rsds") * F.col("area_m2")), [3500.0, 3000.0, 2000.0], "kwh", "area_m2", "pixel_id")
    return out.select("pixel_id", *[r4(f"decade_{i}", 6).alias(f"decade_{i}") for i in (1, 2, 3)], r4("total", 5).alias("total"))


ANNUITY = sum(0.2 / 1.05**y for y in range(1, 31))


@query(
    "g36_crop_revenue_cells",
    "crops crop_price",
    f"""WITH p AS (SELECT v.item AS crop, v.scenario, v.year, v.value / w.value * 1000 AS price FROM crop_price v JOIN crop_price w ON v.item = w.item AND v.scenario = w.scenario AND v.year = w.year WHERE v.element = 'value' AND w.element = 'tonnes' AND w.value > 0),
        y AS (SELECT pixel_id, 'maize' AS crop, maize_rcp26_kg_dw_ha AS kg FROM crops UNION ALL SELECT pixel_id, 'wheat', coalesce(wheat_rcp26_10kg_dw_ha, 0) * 10 FROM crops UNION ALL SELECT pixel_id, 'soybean', soybean_rcp26_kg_dw_ha FROM crops)
        SELECT pixel_id, scenario, year, round(sum(kg) / 1000, 6) AS tonnes, round(sum(r), 4) AS revenue, round(sum(r * r) / sum(r), 4) AS weighted, round(sum(r * r) / sum(r) * {ANNUITY!r}, 4) AS npv
        FROM (SELECT pixel_id, scenario, year, kg, kg * price / 1000 AS r FROM y JOIN p ON y.crop = p.crop WHERE kg > 0) z GROUP BY 1, 2, 3""",
)
def g36(t):
    names = [c for c in t.crops.columns if c.endswith("dw_ha")]
    yields = t.crops.unpivot("pixel_id", names, "name", "v").select("pixel_id", S.crop_of_column(F.col("name")).alias("crop"), S.yield_kg(F.col("v"), F.col("name")).alias("kg"))
    prices = T.crop_price_series(t.crop_price).select(F.col("item").alias("crop"), "scenario", "year", "price")
    out = Y.crop_revenue_cells(yields, prices, ["pixel_id", "scenario", "year"])
    return out.select("pixel_id", "scenario", "year", r4("tonnes", 6).alias("tonnes"), *[r4(c).alias(c) for c in ("revenue", "weighted", "npv")])


# sources and sinks

SITE = "SELECT unique_id, round(lat, 6) AS lat, round(lon, 6) AS lon, p_area, capacity_m, country, year FROM sites WHERE year = 2020"


@query("a1_read_points", "sites", f"SELECT CAST(unique_id AS VARCHAR) AS unique_id, lat, lon, p_area, capacity_m, country, year FROM ({SITE}) s")
def a1(t):
    path = IO.scratch(t.spark, "points")
    rows = t.sites.withColumnRenamed("lat", "Latitude").withColumnRenamed("lon", "LON").withColumn("time", F.col("year").cast("string"))
    rows.drop("year", "lat_idx", "lon_idx").write.option("header", True).csv(path)
    out = IO.read_points(t.spark, path, [2020])
    return out.select("unique_id", r4("lat", 6).alias("lat"), r4("lon", 6).alias("lon"), "p_area", "capacity_m", "country", "year")


@query("a2_union_year_files", "sites", "SELECT lat_idx, lon_idx, year, count(*) AS n FROM (SELECT DISTINCT lat_idx, lon_idx, year FROM sites) s GROUP BY 1, 2, 3")
def a2(t):
    frames = {y: t.sites.where(F.col("year") == y).drop("year") for y in (2018, 2020)}
    out = IO.union_year_files({y: f.union(f) for y, f in frames.items()}, ["lat_idx", "lon_idx"])
    return out.groupBy("lat_idx", "lon_idx", "year").agg(F.count("*").alias("n"))


SPELL = "SELECT pixel_id, CASE WHEN pixel_id % 13 = 0 THEN NULL ELSE lat_idx END AS lat_idx, 1995 + pixel_id % 20 AS start_year, 5 + pixel_id % 17 AS duration FROM pixels"


@query("a3_load_active_cells", "pixels", f"SELECT pixel_id, lat_idx, start_year, 1 AS current_abandonment FROM ({SPELL}) s WHERE lat_idx IS NOT NULL AND start_year + duration - 1 >= 2020")
def a3(t):
    rows = t.spark.sql(SPELL.replace("FROM pixels", "FROM {pixels}"), pixels=t.pixels)
    return IO.load_active_cells(rows, 2020, ["lat_idx"])


@query("a4_load_embedding", "sites", "SELECT unique_id, lat_idx, lon_idx, year FROM sites WHERE year = 2018")
def a4(t):
    return IO.load_embedding(t.sites, [2018], ["lat_idx", "lon_idx"], ["p_area", "country", "capacity_m", "lat", "lon"])


@query(
    "a5_grid_wide",
    "alts pixels",
    "SELECT a.pixel_id, a.analysis_year, npv_agri AS agri, npv_forest AS forest, round(p.npv, 4) AS price FROM (SELECT pixel_id, analysis_year, avg(npv_agri) AS npv_agri, avg(npv_forest) AS npv_forest FROM alts GROUP BY 1, 2) a JOIN pixels p ON a.pixel_id = p.pixel_id",
)
def a5(t):
    grid = lambda c: t.alts.groupBy("pixel_id", "analysis_year").agg(F.avg(c).alias("value"))
    out = IO.grid_wide({"agri": grid("npv_agri"), "forest": grid("npv_forest")}, {"price": t.pixels.select("pixel_id", F.col("npv").alias("value"))}, ["pixel_id"], "analysis_year")
    return out.withColumn("price", r4("price"))


@query("a6_tile", "pixels", "SELECT CAST(floor(lat_idx / 100) * 1000 + floor(lon_idx / 100) AS BIGINT) AS tile_id, count(*) AS n FROM pixels GROUP BY 1")
def a6(t):
    path = IO.scratch(t.spark, "tiles")
    df = IO.tile(t.pixels, 100)
    IO.write_tiles(df.where("tile_id < 2000"), path)
    IO.write_tiles(df, path)
    return t.spark.read.parquet(path).groupBy(F.col("tile_id").cast("long").alias("tile_id")).agg(F.count("*").alias("n"))


@query("a7_write_fact", "npv", "SELECT analysis_year, count(*) AS n, round(sum(npv_usd), 2) AS total FROM npv GROUP BY 1")
def a7(t):
    path = IO.scratch(t.spark, "fact")
    for part in (0, 1, 2, 1):  # a batch that is run again counts once
        IO.write_fact(t.npv.where(F.col("pixel_id") % 3 == part), path, batch=f"b{part}")
    return t.spark.read.parquet(path).groupBy("analysis_year").agg(F.count("*").alias("n"), r4(F.sum("npv_usd"), 2).alias("total"))


@query("a8_write_predictions", "pixels", "SELECT CAST('2020-01-01' AS DATE) AS time, round(lat, 6) AS lat, round(lon, 6) AS lon, prob AS p FROM pixels")
def a8(t):
    path = IO.scratch(t.spark, "predictions")
    IO.write_predictions(t.pixels.select(F.make_date(F.lit(2020), F.lit(1), F.lit(1)).alias("time"), r4("lat", 6).alias("lat"), r4("lon", 6).alias("lon"), F.col("prob").alias("p")), path)
    return t.spark.read.parquet(path)


@query("a9_normalize_columns", "npv", "SELECT category, CASE WHEN category IN ('C1', 'C2', 'C3') THEN 'RCP2.6' WHEN category = 'C4' THEN 'RCP4.5' WHEN category = 'C5' THEN 'RCP6.0' ELSE 'RCP8.5' END AS rcp_category, count(*) AS n FROM npv GROUP BY 1, 2")
def a9(t):
    return IO.normalize_columns(t.npv.withColumnRenamed("category", "Category")).groupBy("category", "rcp_category").agg(F.count("*").alias("n"))


@query("a10_read_gzip_csv", "demand", "SELECT state, scenario, sector, year, mmbtu FROM demand")
def a10(t):
    path = IO.scratch(t.spark, "energy")
    t.demand.select("state", "scenario", "sector", "year", "mmbtu").write.option("header", True).option("compression", "gzip").csv(path)
    return IO.read_gzip_csv(t.spark, path, "state string, scenario string, sector string, year int, mmbtu double")


@query("a11_collect_runs", "pixels", "SELECT CAST(e AS INT) AS exp_id, CASE WHEN e <= 15 THEN f END AS f1 FROM (SELECT pixel_id % 18 + 1 AS e, round(avg(prob), 6) AS f FROM pixels GROUP BY 1) x")
def a11(t):
    path = IO.scratch(t.spark, "runs")
    runs = t.pixels.groupBy((F.col("pixel_id") % 18 + 1).cast("int").alias("exp_id")).agg(r4(F.avg("prob"), 6).alias("f1"))
    runs.where("exp_id <= 15").write.json(path)
    return IO.collect_runs(t.spark, path, t.spark.range(1, 19).select(F.col("id").cast("int").alias("exp_id")), "exp_id int, f1 double")


@query("a12_bbox_extract", "pixels", "SELECT pixel_id FROM pixels WHERE lat BETWEEN 26e0 AND 30e0 AND lon BETWEEN -120e0 AND -111e0")
def a12(t):
    path = IO.scratch(t.spark, "tiled")
    IO.write_tiles(IO.tile(t.pixels, 100), path)
    return IO.bbox_extract(t.spark, path, [0, 1], (26.0, 30.0), (-120.0, -111.0)).select("pixel_id")


@query("a13_yearly_mean", "alts", "SELECT pixel_id, rcp_category, round(sum(npv_agri) / 4, 4) AS npv_agri FROM alts GROUP BY 1, 2")
def a13(t):
    frames = [t.alts.where(F.col("analysis_year") == y) for y in (2020, 2030, 2040, 2050)]
    return rounded(IO.yearly_mean(frames, ["pixel_id", "rcp_category"], "npv_agri"), "pixel_id")


@query(
    "a14_monthly_annual_mean",
    "",
    "SELECT cell, round(avg(m), 4) AS value, count(*) AS months FROM (SELECT o_custkey % 50 AS cell, month(o_orderdate) AS mo, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) x GROUP BY 1",
)
def a14(t):
    df = t.orders.select((F.col("o_custkey") % 50).alias("cell"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))
    return rounded(IO.monthly_then_annual_mean(df, ["cell"], "value"), "cell")


@query("a15_add_grids", "pixels crops", "SELECT p.pixel_id, round(npv + jatropha_class, 4) AS npv FROM pixels p JOIN crops c ON p.pixel_id = c.pixel_id")
def a15(t):
    return rounded(IO.add_grids(t.pixels, t.crops.withColumnRenamed("jatropha_class", "npv"), ["pixel_id"], "npv"), "pixel_id")


@query("a16_time_and_name", "pixels", "SELECT pixel_id, prob AS suitability, CAST('2020-01-01' AS DATE) AS time FROM pixels")
def a16(t):
    return IO.time_and_name(t.pixels.select("pixel_id", "prob"), "prob", "suitability", 2020)
