"""Encoding, models, metrics, anomalies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import GAPPY_SQL, check, even, gappy, readings, with_sql
from checks.features import ENERGY_CTES, SCORE_CTES
from gridloom.functions.calendar import with_calendar
from gridloom.functions.energy import with_energy
from gridloom.functions.risk import with_risk_score
from gridloom.functions.rounding import half_even
from gridloom.operators import anomaly, encode, metrics, models
from gridloom.operators.windows import with_lag_features
from gridloom.schema import ANOMALY_FEATURES
from gridloom.session import materialize, scratch_root

ORDER = ["datetime", "reading_id"]


_BUILT: dict[tuple[str, str], object] = {}


def features(spark, sf):
    """Feature table of the readings, written once per application and folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _BUILT:
        df = with_energy(with_calendar(readings(spark, sf)))
        df = encode.label_encode(with_lag_features(df, ORDER))
        _BUILT[at] = materialize(df.fillna(0), "check-features")
    return _BUILT[at]


def _models(spark, sf) -> str:
    """Folder of the models of this application and folder of tables: each preset is trained once, in full, and loaded after that."""
    at = (spark.sparkContext.applicationId, sf, "models")
    if at not in _BUILT:
        _BUILT[at] = f"{scratch_root(spark).rstrip('/')}/gridloom/models-{uuid.uuid4().hex}"
    return _BUILT[at]


def _codes(c: str) -> str:
    return f"cast(dense_rank() over (order by coalesce({c}, 'nan')) - 1 as int) as {c}_enc"


@check("m01_label_encode", with_sql(
    "select reading_id, " + ", ".join(_codes(c) for c in ("region", "city", "season", "event")) + " from gappy",
    gappy=GAPPY_SQL))
def _(spark, sf):
    cols = ["region", "city", "season", "event"]
    return encode.label_encode(gappy(spark, sf), cols).select("reading_id", *[f"{c}_enc" for c in cols])


def _code_of(c: str) -> str:
    return f"(select {c}, cast(row_number() over (order by {c}) - 1 as int) as code from (select distinct {c} from grid_readings where season = 'S1')) {c}_codes"


_ENCODED = ["region", "city", "season", "event"]


@check("m01_encode_stream", with_sql(
    "select reading_id, " + ", ".join(f"coalesce({c}_codes.code, -1) as {c}_enc" for c in _ENCODED) + " from grid_readings "
    + " ".join(f"left join {_code_of(c)} using ({c})" for c in _ENCODED)))
def _(spark, sf):
    """A dictionary of the first season's readings is stored; all readings arrive as a stream and are encoded by it."""
    from checks.base import table
    from gridloom.streaming import score

    path = f"{scratch_root(spark).rstrip('/')}/gridloom/encoder-{uuid.uuid4().hex}"
    encode.fit_encoder(readings(spark, sf).filter("season = 'S1'"), f"{path}/classes", _ENCODED)
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    coded = encode.encode_with(readings(spark, sf, events), encode.load_encoder(spark, f"{path}/classes"))
    score.write_stream(coded, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("reading_id", *[f"{c}_enc" for c in _ENCODED])


_SCALED = ["temperature", "total_load_mw", "voltage", "fuel_cost"]


@check("m02_scale_features", with_sql(
    "select reading_id, blackout, " + ", ".join(f"{even(f'({c} - avg({c}) over ())/stddev_pop({c}) over ()')} as {c}" for c in _SCALED) + " from grid_readings"))
def _(spark, sf):
    out, _ = encode.scale_features(readings(spark, sf), exclude=["reading_id"])
    return out.select("reading_id", "blackout", *[half_even(F.col(c), 6).alias(c) for c in _SCALED])


@check("m03_prepare_anomaly_data", with_sql("select reading_id, " + ", ".join(
    f"{even(f'(coalesce({c},0.0::double) - avg(coalesce({c},0.0::double)) over ())/stddev_pop(coalesce({c},0.0::double)) over ()')} as z_{c}"
    for c in ANOMALY_FEATURES) + " from features", **ENERGY_CTES))
def _(spark, sf):
    out, columns, _ = anomaly.prepare(with_energy(readings(spark, sf)))
    return out.select("reading_id", *[half_even(F.col(c), 6).alias(c.removeprefix("_")) for c in columns])


_KBEST = ["temperature", "total_load_mw", "voltage", "outage_risk", "humidity", "fuel_cost", "load_shedding_mw"]


def _anova(c: str) -> str:
    return f"""select '{c}' as feature, (sum(n*(m-g)*(m-g))/(count(*)-1))/(sum(n*v)/(sum(n)-count(*))) as f from (
  select count(*) as n, avg({c}) as m, var_pop({c}) as v, (select avg({c}) from grid_readings) as g from grid_readings group by blackout)"""


@check("m04_select_k_best", with_sql(
    f"select feature, {even('f', 4)} as score, cast(row_number() over (order by f desc, feature) as int) as rank from ("
    + " union all ".join(_anova(c) for c in _KBEST) + ") qualify rank <= 5"))
def _(spark, sf):
    best = encode.select_k_best(readings(spark, sf), _KBEST, "blackout", 5)
    return best.select("feature", half_even(F.col("score"), 4).alias("score"), "rank")


def _mi(c: str) -> str:
    return f"""select '{c}' as feature, {even('sum(n::double/t*ln(n::double*t/(nb*ny)))')} as score from (
  select n, sum(n) over () as t, sum(n) over (partition by b) as nb, sum(n) over (partition by y) as ny from (
    select least(floor(({c}-lo)/(hi-lo)*10), 9) as b, blackout as y, count(*) as n
    from grid_readings, (select min({c}) as lo, max({c}) as hi from grid_readings) group by 1, 2))"""


@check("m04_mutual_information", with_sql(" union all ".join(_mi(c) for c in _KBEST)))
def _(spark, sf):
    return encode.mutual_information(readings(spark, sf), _KBEST, "blackout").select("feature", half_even(F.col("score"), 6).alias("score"))


def _psi(x: str) -> str:
    """Digamma of a whole number, as SQL."""
    y = f"({x}+10)::double"
    return f"(ln({y}) - 1/(2*{y}) - 1/(12*{y}*{y}) + 1/(120*{y}*{y}*{y}*{y}) - (" + " + ".join(f"1/({x}+{i})::double" for i in range(10)) + "))"


_BESIDE = ", ".join(f"lag(v, {j}) over w as l{j}, lead(v, {j}) over w as h{j}" for j in (1, 2, 3))
_CLOSER = " + ".join(f"coalesce((v-l{j} < radius)::int, 0) + coalesce((h{j}-v < radius)::int, 0)" for j in (1, 2, 3))


@check("m04_neighbour_information", with_sql(f"""
select feature, {even(f"greatest(0, {_psi('sum(n)')} + sum(n*({_psi('k')} - {_psi('size')} - {_psi('m')}))/sum(n))")} as score from (
  select a.*, greatest(case when radius = 0 then same.n else coalesce(h.upto, 0) - coalesce(l.upto, 0) end, a.k)::bigint as m
  from ends a join totals same on a.feature = same.feature and a.v = same.v
  asof left join totals h on a.feature = h.feature and a.hi > h.v
  asof left join totals l on a.feature = l.feature and a.lo >= l.v) group by feature""",
    long=" union all ".join(f"select '{c}' as feature, blackout as y, {c}::double as v from grid_readings" for c in _KBEST),
    sized="select * from (select *, count(*) over (partition by feature, y) as size from long) where size > 1",
    beside=f"select *, {_BESIDE} from sized window w as (partition by feature, y order by v)",
    radii="select *, list_sort([v-l1, v-l2, v-l3, h1-v, h2-v, h3-v], 'ASC', 'NULLS LAST')[least(3, size - 1)] as radius from beside",
    ends=f"""select feature, y, v, size, radius, count(*) as n, case when radius = 0 then count(*) else max(1 + {_CLOSER}) end as k,
      max(case when h1-v = radius then h1 when h2-v = radius then h2 when h3-v = radius then h3 else v + radius end) as hi,
      min(case when v-l1 = radius then l1 when v-l2 = radius then l2 when v-l3 = radius then l3 else v - radius end) as lo from radii group by feature, y, v, size, radius""",
    totals="select feature, v, n, sum(n) over (partition by feature order by v) as upto from (select feature, v, count(*) as n from sized group by all)"))
def _(spark, sf):
    out = encode.neighbour_information(readings(spark, sf), _KBEST, "blackout")
    return out.select("feature", half_even(F.col("score"), 6).alias("score"))


@check("m05_pca")
def _(spark, sf):
    df, columns, _ = anomaly.prepare(with_energy(readings(spark, sf)))
    projection = encode.fit_pca(df, columns, 2)
    out = projection.apply(df).select("reading_id", "pc1", "pc2")
    return out.withColumn("explained", F.lit(sum(projection.explained)))


@check("m05_pca_moments", """
select cast(i as int) as i, cast(j as int) as j, 0.0::double as beside, i = j as own from range(1, 9) a(i), range(1, 9) b(j) where i <= j""")
def _(spark, sf):
    """Moments of all readings' coordinates: two axes share none, an axis its explained share of the whole variance."""
    df, columns, _ = anomaly.prepare(with_energy(readings(spark, sf)))
    projection = encode.fit_pca(df, columns, 8)
    places = projection.apply(df)
    total = sum((F.var_pop(c) for c in columns[1:]), F.var_pop(columns[0]))
    cells = []
    for i in range(8):
        for j in range(i, 8):
            moment = F.covar_pop(f"pc{i + 1}", f"pc{j + 1}") / total - F.lit(float(projection.explained[i]) if i == j else 0.0)
            cells.append(F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), (half_even(moment, 6) + F.lit(0.0)).alias("beside"), F.lit(i == j).alias("own")))
    return places.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@check("m06_min_max_by_region", with_sql(f"""
select reading_id, {even('(total_load_mw - lo)/(hi - lo)')} as scaled from grid_readings
join (select region, min(total_load_mw) as lo, max(total_load_mw) as hi from grid_readings group by 1) using (region)"""))
def _(spark, sf):
    out = encode.min_max(readings(spark, sf), "total_load_mw", "scaled", ("region",))
    return out.select("reading_id", half_even(F.col("scaled"), 6).alias("scaled"))


@check("m07_class_weights", with_sql(f"""
select reading_id, blackout, {even("n::double/(2*count(*) over (partition by blackout))")} as weight, case when blackout = 1 then 5.0::double else 1.0::double end as positive
from (select *, count(*) over () as n from grid_readings)"""))
def _(spark, sf):
    df = encode.class_weights(readings(spark, sf), "blackout")
    df = encode.class_weights(df, "blackout", "positive", positive=5)
    return df.select("reading_id", "blackout", half_even(F.col("weight"), 6).alias("weight"), "positive")


_AUC = """(select (sum(pos*rk) - sum(pos)*(sum(pos)+1)/2)/(sum(pos)*(sum(n)-sum(pos))) from (
  select n, pos, sum(n) over (order by risk) - n + (n+1)/2.0::double as rk from (select risk, count(*)::double as n, sum(blackout)::double as pos from p group by 1)))"""


@check("e01_classification_metrics", with_sql(f"""
select {even('(tp+tn)/(tp+fp+fn+tn)', 4)} as accuracy, {even('tp/(tp+fp)', 4)} as "precision", {even('tp/(tp+fn)', 4)} as recall,
  {even('2*tp/(2*tp+fp+fn)', 4)} as f1_score, {even('(tp*tn-fp*fn)/(sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn))', 4)} as mcc,
  tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp, {even(_AUC, 4)} as roc_auc
from (select count(*) filter (blackout=1 and risk>=0.5)::double as tp, count(*) filter (blackout=0 and risk>=0.5)::double as fp,
  count(*) filter (blackout=1 and risk<0.5)::double as fn, count(*) filter (blackout=0 and risk<0.5)::double as tn from p)""", **SCORE_CTES))
def _(spark, sf):
    scored = with_risk_score(readings(spark, sf))
    raw = _raw_score(readings(spark, sf))
    out = metrics.classification_metrics(scored, "blackout", "prediction").drop("roc_auc")
    auc = metrics.roc_auc(raw, "blackout", "risk")
    m = F.col("confusion_matrix")
    return out.withColumn("roc_auc", half_even(F.lit(auc), 4)).select(
        "accuracy", "precision", "recall", "f1_score", "mcc", m[0][0].alias("tn"), m[0][1].alias("fp"), m[1][0].alias("fn"), m[1][1].alias("tp"), "roc_auc")


def _raw_score(df):
    from gridloom.functions import risk as rk

    ratio = rk.floored_ratio(F.col("total_load_mw"), F.col("available_power_mw"))
    stress = rk.scoring_stress(ratio, F.col("transformer_temp"), F.col("voltage"), F.col("frequency"))
    return df.withColumn("risk", rk.risk_score(F.col("outage_risk"), ratio, stress, F.col("transformer_temp"), F.col("event")))


@check("e02_regression_metrics", with_sql(f"""
select region, {even('avg(abs(e))', 4)} as mae, {even('avg(e*e)', 4)} as mse, {even('sqrt(avg(e*e))', 4)} as rmse,
  {even('1 - avg(e*e)/var_pop(total_load_mw)', 4)} as r2, {even('avg(abs(e)/(abs(total_load_mw)+1e-9))*100', 4)} as mape
from (select region, total_load_mw, total_load_mw - available_power_mw as e from grid_readings) group by region"""))
def _(spark, sf):
    return metrics.regression_metrics(readings(spark, sf), "total_load_mw", "available_power_mw", ("region",))


# ------------------------------------------------------------------ models

def _flat(results):
    m = F.col("confusion_matrix")
    return results.select(
        "model", "accuracy", "precision", "recall", "f1_score", "mcc", "roc_auc",
        m[0][0].alias("tn"), m[0][1].alias("fp"), m[1][0].alias("fn"), m[1][1].alias("tp"))


for _name in ("logistic_regression", "random_forest", "gradient_boosting", "xgboost", "lightgbm", "catboost"):
    _key = {"logistic_regression": "m08", "random_forest": "m09"}.get(_name, "m10")

    @check(f"{_key}_{_name}")
    def _(spark, sf, name=_name):
        out = models.compare_classifiers(features(spark, sf), models.BLACKOUT_FEATURES, "blackout", "reading_id", names=[name], store=_models(spark, sf))
        return _flat(out.results)


for _name in ("ridge", "random_forest_reg", "xgboost_reg", "lightgbm_reg"):
    @check(f"m11_{_name}")
    def _(spark, sf, name=_name):
        return models.compare_regressors(
            features(spark, sf), models.DEMAND_FEATURES, "total_load_mw", "datetime", "reading_id", names=[name], store=_models(spark, sf)).results


@check("m13_ensemble")
def _(spark, sf):
    from gridloom.operators.sampling import stratified_split

    table = features(spark, sf)
    out = models.compare_classifiers(table, models.BLACKOUT_FEATURES, "blackout", "reading_id", ensemble_trees=100, names=[], store=_models(spark, sf))
    test = stratified_split(table, "reading_id", "blackout")[1]
    return out.best.predict(test).select("reading_id", "blackout", "score", "prediction")


@check("m14_feature_importance")
def _(spark, sf):
    out = models.compare_classifiers(features(spark, sf), models.BLACKOUT_FEATURES, "blackout", "reading_id", names=["random_forest"], store=_models(spark, sf))
    return models.feature_importance(out.best, spark)


@check("m15_blackout_job")
def _(spark, sf):
    return _flat(models.blackout_job(features(spark, sf), "reading_id", store=_models(spark, sf), path=f"{_models(spark, sf)}/blackout").results)


@check("m15_overload_job")
def _(spark, sf):
    return _flat(models.overload_job(features(spark, sf), "reading_id", store=_models(spark, sf), path=f"{_models(spark, sf)}/overload").results)


@check("m15_demand_job")
def _(spark, sf):
    return models.demand_job(features(spark, sf), "datetime", "reading_id", store=_models(spark, sf), path=f"{_models(spark, sf)}/demand").results


# --------------------------------------------------------------- anomalies

def _prepared(spark, sf):
    df, columns, _ = anomaly.prepare(with_energy(readings(spark, sf)))
    return materialize(df.select("reading_id", *columns), "check-scaled"), columns


@check("a01_isolation_forest")
def _(spark, sf):
    df, columns = _prepared(spark, sf)
    return anomaly.isolation_flags(df, "reading_id", columns).select("reading_id", "if_score", "if_anomaly")


@check("a01_stored_forest", with_sql("select reading_id, true as same from grid_readings"))
def _(spark, sf):
    """A forest is stored and loaded; both give each reading the same score."""
    from gridloom.operators.forest import IsolationForest, fit_isolation_forest

    df, columns = _prepared(spark, sf)
    path = f"{scratch_root(spark).rstrip('/')}/gridloom/forest-{uuid.uuid4().hex}"
    forest = fit_isolation_forest(df, "reading_id", columns)
    forest.save(spark, path)
    again = IsolationForest.load(spark, path)
    return df.select("reading_id", (forest.score(df) == again.score(df)).alias("same"))


@check("a01_live_isolation_forest")
def _(spark, sf):
    out = anomaly.live_anomalies(readings(spark, sf), "reading_id")
    return out.filter("is_anomaly = 1").orderBy("anomaly_score", "reading_id").limit(20).select(
        "reading_id", "datetime", "region", "city", "total_load_mw", "transformer_temp", "voltage", "anomaly_score")


@check("a02_reconstruction_error")
def _(spark, sf):
    df, columns = _prepared(spark, sf)
    return anomaly.reconstruction_flags(df, columns).select("reading_id", "ae_score", "ae_anomaly")


@check("a03_one_class_boundary")
def _(spark, sf):
    df, columns = _prepared(spark, sf)
    return anomaly.boundary_flags(df, "reading_id", columns).select("reading_id", "ocsvm_score", "ocsvm_anomaly")


@check("a03_one_class_machine")
def _(spark, sf):
    from gridloom.operators.boundary import one_class_flags

    df, columns = _prepared(spark, sf)
    return one_class_flags(df, "reading_id", columns).select("reading_id", "ocsvm_score", "ocsvm_anomaly")


@check("a03_stored_machine", with_sql("select reading_id, true as same from grid_readings"))
def _(spark, sf):
    """A one-class machine is stored and loaded; both give each reading the same score."""
    from gridloom.operators.boundary import OneClassMachine, fit_one_class

    df, columns = _prepared(spark, sf)
    path = f"{scratch_root(spark).rstrip('/')}/gridloom/machine-{uuid.uuid4().hex}"
    machine = fit_one_class(df, "reading_id", columns)
    machine.save(spark, path)
    again = OneClassMachine.load(spark, path)
    return df.select("reading_id", (machine.score(df) == again.score(df)).alias("same"))


_NEAR = ["x", "y", "z"]
_POINTS = "select event_id as id, value/50 as x, (event_id*37 % 500)/50.0::double as y, (event_id*13 % 60)/10.0::double as z from events"


@check("a04_density_noise", f"""
with pts as ({_POINTS}), pairs as (
  select a.id, b.id as other from pts a join pts b on b.x between a.x - 0.5 and a.x + 0.5 and b.y between a.y - 0.5 and a.y + 0.5
    and b.z between a.z - 0.5 and a.z + 0.5 where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.25),
core as (select id from pairs group by id having count(*) >= 10)
select id from pts where id not in (select id from core) and id not in (select p.id from pairs p join core c on p.other = c.id)""")
def _(spark, sf):
    from checks.base import table
    from gridloom.operators.density import noise_points

    e, i = table(spark, sf, "events"), F.col("event_id")
    pts = e.select(i.alias("id"), (F.col("value") / 50).alias("x"), (i * 37 % 500 / F.lit(50.0)).alias("y"), (i * 13 % 60 / F.lit(10.0)).alias("z"))
    return noise_points(pts, "id", _NEAR, 0.5, 10)


_CLUSTERS = f"""
with recursive pts as materialized ({_POINTS}), pairs as materialized (
  select a.id, b.id as other from pts a join pts b on b.x between a.x - 0.5 and a.x + 0.5 and b.y between a.y - 0.5 and a.y + 0.5
    and b.z between a.z - 0.5 and a.z + 0.5 where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.25),
core as materialized (select id from pairs group by id having count(*) >= 10),
links as materialized (select p.id, p.other from pairs p join core c on p.id = c.id join core d on p.other = d.id),
root(id, label) using key (id) as (select id, id from core
  union select l.id, min(r.label) from root r join links l on l.other = r.id join recurring.root own on own.id = l.id where r.label < own.label group by l.id),
numbered as (select id, dense_rank() over (order by label) - 1 as cluster from root),
labelled as (select p.id, coalesce(n.cluster, b.cluster, -1)::bigint as cluster from pts p left join numbered n using (id)
  left join (select q.id, min(m.cluster) as cluster from pairs q join numbered m on q.other = m.id group by q.id) b on b.id = p.id)
"""


def _cluster_points(spark, sf):
    from checks.base import table

    e, i = table(spark, sf, "events"), F.col("event_id")
    return e.select(i.alias("id"), (F.col("value") / 50).alias("x"), (i * 37 % 500 / F.lit(50.0)).alias("y"), (i * 13 % 60 / F.lit(10.0)).alias("z"))


@check("a04_clusters", _CLUSTERS + "select * from labelled")
def _(spark, sf):
    from gridloom.operators.density import clusters

    return clusters(_cluster_points(spark, sf), "id", _NEAR, 0.5, 10)


@check("a04_cluster_count", _CLUSTERS + "select count(distinct cluster) filter (cluster >= 0) as n_clusters, count(*) filter (cluster = -1) as n_noise from labelled")
def _(spark, sf):
    from gridloom.operators.density import clusters

    found = clusters(_cluster_points(spark, sf), "id", _NEAR, 0.5, 10)
    inside = F.when(F.col("cluster") >= 0, F.col("cluster"))
    return found.agg(F.count_distinct(inside).alias("n_clusters"), F.count_if(F.col("cluster") == -1).alias("n_noise"))


@check("a04_density_flags")
def _(spark, sf):
    df, columns = _prepared(spark, sf)
    return anomaly.density_flags(df, "reading_id", columns).select("reading_id", "dbscan_anomaly")


@check("a05_vote", with_sql(f"""
select reading_id, anomaly_vote, cast(anomaly_vote >= 2 as int) as is_anomaly,
  {even('100*(0.4*anomaly_vote/3 + 0.3*(1-(s1-min(s1) over ())/(max(s1) over ()-min(s1) over ()+1e-9)) + 0.3*(s2-min(s2) over ())/(max(s2) over ()-min(s2) over ()+1e-9))', 2)} as anomaly_risk_score
from (select reading_id, blackout + overload + case when outage_risk > 80 then 1 else 0 end as anomaly_vote, -temperature as s1, total_load_mw as s2 from grid_readings)"""))
def _(spark, sf):
    df = readings(spark, sf).select(
        "reading_id", F.col("blackout").alias("if_anomaly"), F.col("overload").alias("ae_anomaly"),
        (F.col("outage_risk") > 80).cast("int").alias("dbscan_anomaly"), (-F.col("temperature")).alias("if_score"), F.col("total_load_mw").alias("ae_score"))
    return anomaly.vote(df).select("reading_id", "anomaly_vote", "is_anomaly", "anomaly_risk_score")


@check("a05_detect_anomalies")
def _(spark, sf):
    out = anomaly.detect_anomalies(with_energy(readings(spark, sf)), "reading_id")
    return out.select("reading_id", "region", "if_anomaly", "ae_anomaly", "dbscan_anomaly", "anomaly_vote", "is_anomaly", "anomaly_risk_score")


@check("o03_top_anomalies", with_sql("""
select reading_id, datetime, region, city, total_load_mw, outage_risk, total_load_mw as anomaly_risk_score from grid_readings
where overload = 1 order by total_load_mw desc, reading_id limit 10"""))
def _(spark, sf):
    df = readings(spark, sf).withColumns({"is_anomaly": F.col("overload"), "anomaly_risk_score": F.col("total_load_mw")})
    return anomaly.top_anomalies(df, "reading_id")
