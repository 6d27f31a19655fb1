from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import sampling as A
from faultlens.operators import windows as V
from faultlens.operators.knn import nearest
from faultlens.queries.registry import L_SQL, R_SQL, labelled, query, r6, readings, table
from faultlens.schema import SENSORS

T_SQL = R_SQL + """,
t AS (SELECT event_id, value, CAST(event_type = 'error' AS INTEGER) AS y FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || event_id), event_id) - 1 AS rank,
      count(*) OVER (PARTITION BY y) AS n FROM t)"""


def truth(spark, sf):
    return readings(spark, sf).select(
        "event_id", "value", (F.col("event_type") == "error").cast("int").alias("y")
    )


@query("stratified_split", f"WITH {T_SQL} SELECT event_id, y, rank < floor(n * 0.2 + 0.5) AS is_test FROM h")
def stratified_split(spark, sf):
    return A.stratified_split(truth(spark, sf), "y", "event_id", target_rows=500).select("event_id", "y", "is_test")


@query(
    "random_split",
    """SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) <= floor(count(*) OVER () * 0.2 + 0.5)
    AS is_test FROM events""",
)
def random_split(spark, sf):
    return A.stratified_split(truth(spark, sf), "y", "event_id", stratify=False).select("event_id", "is_test")


@query(
    "seeded_sample",
    "SELECT event_id FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 2000",
)
def seeded_sample(spark, sf):
    return A.seeded_sample(truth(spark, sf), "event_id", 2000, seed=7).select("event_id")


@query(
    "stratified_sample",
    f"""WITH {T_SQL}, s AS (SELECT * FROM h WHERE rank < floor(n * 0.2 + 0.5)),
    v AS (SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('9:' || event_id), event_id) - 1 AS rank,
      count(*) OVER (PARTITION BY y) AS n FROM s)
    SELECT event_id, y, rank < floor(n * 0.1 + 0.5) AS is_validation FROM v""",
)
def stratified_sample(spark, sf):
    """A stratified 20 % sample with a nested 10 % validation part."""
    sample = A.stratified_split(truth(spark, sf), "y", "event_id").where("is_test").drop("is_test")
    return A.nested_validation(sample, "y", "event_id", 0.1, seed=9).select("event_id", "y", "is_validation")


@query("stratified_folds", f"WITH {T_SQL} SELECT event_id, y, CAST(rank % 5 AS INTEGER) AS fold FROM h")
def stratified_folds(spark, sf):
    return A.stratified_folds(truth(spark, sf), "y", "event_id", target_rows=500).select("event_id", "y", "fold")


@query(
    "class_weights",
    f"""WITH {T_SQL}, c AS (SELECT y, count(*) AS n FROM t GROUP BY y)
    SELECT y, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS balanced_weight,
      round(sum(n) FILTER (y = 0) OVER () / sum(n) FILTER (y = 1) OVER (), 4) AS pos_weight FROM c""",
)
def class_weights(spark, sf):
    return A.class_weights(truth(spark, sf), "y")


@query(
    "scaler_stats",
    f"""WITH {L_SQL} SELECT unnest([{", ".join(f"'{c}'" for c in SENSORS)}]) AS channel,
      round(unnest([{", ".join(f"avg({c})" for c in SENSORS)}]), 6) AS mean,
      round(unnest([{", ".join(f"stddev_pop({c})" for c in SENSORS)}]), 6) AS std, count(*) AS n
    FROM l WHERE anomaly = 0""",
)
def scaler_stats(spark, sf):
    out = V.scaler_stats(labelled(spark, sf).where("anomaly = 0"), SENSORS)
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "window_scaler",
    f"""WITH {L_SQL},
    i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM l),
    w AS (SELECT unnest(range(0, (SELECT count(*) FROM l) - 59, 10)) AS lo),
    m AS (SELECT i.* FROM w JOIN i ON rn BETWEEN lo AND lo + 59)
    {" UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS channel, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM m" for k, c in enumerate(SENSORS))}""",
)
def window_scaler(spark, sf):
    """Rows shared by overlapping windows count once per window."""
    mean, std = V.window_scaler(V.sliding_windows(labelled(spark, sf), SENSORS), len(SENSORS))
    rows = [(c, m, s) for c, (m, s) in enumerate(zip(mean, std))]
    out = spark.createDataFrame(rows, "channel int, mean double, std double")
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "standardize",
    f"""WITH {L_SQL}, z AS (SELECT avg(TP2) AS m, stddev_pop(TP2) AS d, avg(TP3) AS m3, stddev_pop(TP3) AS d3 FROM l)
    SELECT event_id, round((TP2 - m) / d, 6) + 0.0 AS TP2, round((TP3 - m3) / d3, 6) + 0.0 AS TP3,
      0.0::DOUBLE AS steady FROM l, z""",
)
def standardize(spark, sf):
    """A column without spread is only centred."""
    rows = labelled(spark, sf).select("event_id", "TP2", "TP3", F.lit(1.0).alias("steady"))
    columns = ["TP2", "TP3", "steady"]
    out = V.standardize_columns(rows, V.fit_columns(rows, columns))
    return out.select("event_id", *[r6(c).alias(c) for c in columns])


NEAR_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, b.label AS other, round(list_distance(a.v, b.v), 6) AS distance
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.label = 3 AND {which}),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS place FROM d)"""


@query(
    "knn_minority",
    f"""WITH {NEAR_SQL.format(which='b.label = 3')}
    SELECT id, CAST(place AS INTEGER) AS place, neighbour, distance FROM k WHERE place <= 5""",
)
def knn_minority(spark, sf):
    minority = table(spark, sf, "embeddings").where("label = 3")
    return nearest(minority, minority, "vec_id", "embedding", 5)


@query(
    "knn_partitioned",
    f"""WITH {NEAR_SQL.format(which='true')}
    SELECT id, CAST(place AS INTEGER) AS place, neighbour, distance FROM k WHERE place <= 5""",
)
def knn_partitioned(spark, sf):
    """Minority rows against all rows by pivot cells: the way for large reference sets."""
    rows = table(spark, sf, "embeddings")
    return nearest(rows.where("label = 3"), rows, "vec_id", "embedding", 5, broadcast_values=0, block_rows=128)


def binary(spark, sf):
    """One embedding label against the rest."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("v"), (F.col("label") == 3).cast("int").alias("y")
    )


SMOTE_SQL = f"""WITH {NEAR_SQL.format(which='b.label = 3')},
p AS (SELECT * FROM k WHERE place <= 5),
c AS (SELECT count(*) FILTER (label = 3) AS n1, count(*) FILTER (label <> 3) AS n0 FROM e),
s AS (SELECT vec_id AS parent, v, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rank,
        n0 - n1 AS total, n1 FROM e, c WHERE label = 3),
m AS (SELECT parent, v, CAST(unnest(range(0, total // n1 + CASE WHEN rank < total % n1 THEN 1 ELSE 0 END)) AS INTEGER) AS copy
      FROM s),
x AS (SELECT parent, copy, neighbour, m.v AS a,
        ('0x' || substr(md5('42:' || parent || ':' || copy), 1, 15))::BIGINT / 1152921504606846976.0 AS u
      FROM m JOIN p ON p.id = parent AND p.place = copy % 5 + 1)"""


@query(
    "smote",
    SMOTE_SQL
    + """ SELECT parent, copy, neighbour, list_transform(range(1, 65), lambda i: round(x.a[i] + u * (b.v[i] - x.a[i]), 6)) AS v
      FROM x JOIN e b ON b.vec_id = neighbour
    UNION ALL SELECT NULL, NULL, NULL, list_transform(v, lambda z: round(z, 6)) FROM e""",
)
def smote(spark, sf):
    out = A.smote(binary(spark, sf), "v", "y", "vec_id")
    return out.select("parent", "copy", "neighbour", F.transform("v", r6).alias("v"))


@query(
    "smote_report",
    """WITH c AS (SELECT CAST(label = 3 AS INTEGER) AS y, count(*) AS before FROM embeddings GROUP BY 1)
    SELECT y, before, max(before) OVER () AS after, max(before) OVER () - before AS synthetic FROM c""",
)
def smote_report(spark, sf):
    rows = binary(spark, sf)
    return A.resampling_report(rows, A.smote(rows, "v", "y", "vec_id"), "y")


@query(
    "borderline_seeds",
    f"""WITH {NEAR_SQL.format(which='true')},
    s AS (SELECT id AS vec_id, count(*) FILTER (other <> 3) AS n_foreign, count(*) AS n_near FROM k WHERE place <= 10 GROUP BY id)
    SELECT * FROM s WHERE n_foreign * 2 >= n_near AND n_foreign < n_near""",
)
def borderline_seeds(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")
    return A.borderline_seeds(rows, "v", "label", "vec_id", 3)


# Oversampling in general: e has id, y and v; y = 1 is the smaller class. `keep` picks the seeds.
OVERSAMPLE_SQL = """d AS (SELECT a.id, b.id AS neighbour, b.y AS other, round(list_distance(a.v, b.v), 6) AS distance
      FROM e a JOIN e b ON a.id <> b.id WHERE a.y = 1),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS place FROM d),
own AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS place FROM d WHERE other = 1),
seeds AS (SELECT id FROM near WHERE place <= 10 GROUP BY id HAVING {keep}),
c AS (SELECT count(*) FILTER (y = 0) - count(*) FILTER (y = 1) AS total, (SELECT count(*) FROM seeds) AS n FROM e),
z AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS rank FROM seeds),
m AS (SELECT id AS parent, CAST(unnest(range(0, total // n + CASE WHEN rank < total % n THEN 1 ELSE 0 END)) AS INTEGER) AS copy
      FROM z, c),
x AS (SELECT parent, copy, neighbour, a.v AS a, b.v AS b,
        ('0x' || substr(md5('42:' || parent || ':' || copy), 1, 15))::BIGINT / 1152921504606846976.0 AS u
      FROM m JOIN own ON own.id = parent AND own.place = copy % 5 + 1 JOIN e a ON a.id = parent JOIN e b ON b.id = neighbour)"""
MIXED_SQL = "list_transform(range(1, len(a) + 1), lambda i: round(a[i] + u * (b[i] - a[i]), 6))"


@query(
    "borderline_smote",
    f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
        CAST(embedding[1] + embedding[2] / 2 > 0.15 AS INTEGER) AS y FROM embeddings),
    {OVERSAMPLE_SQL.format(keep="count(*) FILTER (other = 0) * 2 >= count(*) AND count(*) FILTER (other = 0) < count(*)")}
    SELECT parent, copy, neighbour, CAST(1 AS INTEGER) AS y, {MIXED_SQL} AS v FROM x
    UNION ALL SELECT NULL, NULL, NULL, y, list_transform(v, lambda z: round(z, 6)) FROM e""",
)
def borderline_smote(spark, sf):
    """Seeds only near the class boundary; the labels are made to overlap there."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("v"),
        (F.element_at("embedding", 1) + F.element_at("embedding", 2) / 2 > 0.15).cast("int").alias("y"),
    )
    out = A.smote(rows, "v", "y", "vec_id", borderline=True)
    return out.select("parent", "copy", "neighbour", "y", F.transform("v", r6).alias("v"))


@query(
    "window_smote",
    f"""WITH {L_SQL},
    i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM l),
    w AS (SELECT unnest(range(0, (SELECT count(*) FROM l) - 59, 10)) AS lo),
    e AS (SELECT CAST(lo // 10 AS BIGINT) AS id, max(anomaly) AS y,
            flatten(list([{", ".join(SENSORS)}] ORDER BY rn)) AS v
          FROM w JOIN i ON rn BETWEEN lo AND lo + 59 GROUP BY lo),
    {OVERSAMPLE_SQL.format(keep="true")}
    SELECT CAST(NULL AS BIGINT) AS wid, CAST(1 AS INTEGER) AS y, parent, copy, {MIXED_SQL} AS v FROM x
    UNION ALL SELECT id, y, NULL, NULL, list_transform(v, lambda z: round(z, 6)) FROM e""",
)
def window_smote(spark, sf):
    """Oversampling of flattened windows of all channels, folded to tensors and flattened again."""
    w = V.sliding_windows(labelled(spark, sf), SENSORS, label="anomaly")
    flat = w.select("wid", V.flatten_window("x").alias("v"), "y")
    out = A.smote(flat, "v", "y", "wid")
    tensor = out.withColumn("x", V.unflatten_window("v", len(SENSORS)))
    return tensor.select("wid", "y", "parent", "copy", F.transform(V.flatten_window("x"), r6).alias("v"))


@query(
    "split_leak_check",
    f"""WITH {T_SQL}, s AS (SELECT *, rank < floor(n * 0.2 + 0.5) AS is_test FROM h)
    SELECT count(*) AS n_leaked FROM s a WHERE is_test AND EXISTS (
      SELECT 1 FROM s b WHERE NOT b.is_test AND a.value = b.value AND a.y = b.y)""",
)
def split_leak_check(spark, sf):
    """Test rows whose (value, class) also occurs in training; ids would never repeat."""
    split = A.stratified_split(truth(spark, sf), "y", "event_id")
    leaked = A.leaked_rows(split.where("NOT is_test"), split.where("is_test"), ["value", "y"])
    return leaked.agg(F.count("*").alias("n_leaked"))
