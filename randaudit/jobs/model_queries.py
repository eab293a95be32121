"""Queries of dataset assembly, evaluation and graph features on stand-in tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from randaudit.jobs.fixtures import view, with_views
from randaudit.operators import dataset as ds
from randaudit.operators import evaluate as ev
from randaudit.operators import graph_features as gf
from randaudit.sources.contracts import read_index
from randaudit.sources.scratch import shared_dir

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _r(*names: str, digits: int = 9) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index entries, graphs, paths): the artefacts are lists of (batch, contract_id)."""
    e = view(spark, sf_dir, "entries")
    return e.select("contract_id", "batch", "label", "num_paths"), e.where("has_graph").select("batch", "contract_id"), e.where("has_paths").select("batch", "contract_id")


_VALID = "has_graph AND has_paths"


@query(with_views(f"SELECT contract_id, batch, CAST(label AS BIGINT) AS label, num_paths FROM entries WHERE {_VALID}", "entries"))
def dataset_entries(spark, sf_dir):
    entries, graphs, paths = _entries(spark, sf_dir)
    names = [f"src{k}" for k in range(20)]
    batches = {n: entries.where(F.col("batch") == n).drop("batch") for n in names[:2]}
    both = ds.union_batches(batches).unionByName(entries.where(~F.col("batch").isin(names[:2])))
    return ds.valid_entries(both, graphs, paths).select("contract_id", "batch", *long("label", "num_paths"))


@query(with_views("SELECT contract_id, batch, CAST(label AS BIGINT) AS label, num_paths FROM entries", "entries"))
def index_documents(spark, sf_dir):
    """Index documents of each batch, written as JSON files of at most about 10,000 entries and read back, with a batch that has no file."""
    entries = view(spark, sf_dir, "entries")
    path, parts = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", -(-entries.count() // 10_000)
    each = entries.withColumn("part", F.pmod(F.xxhash64("contract_id"), F.lit(max(1, parts))))
    docs = each.groupBy("batch", "part").agg(F.collect_list(F.struct(F.col("contract_id").cast("string").alias("contract_id"), "label", "num_paths")).alias("entries"))
    docs.select("entries", "batch").write.option("maxRecordsPerFile", 1).partitionBy("batch").json(path)
    batches = [r.batch for r in docs.select("batch").distinct().collect()]  # a handful of index files
    found = read_index(spark, {b: f"{path}/batch={b}" for b in batches} | {"missing": f"{path}/batch=missing"})
    return found.select(F.col("contract_id").cast("long").alias("contract_id"), "batch", F.col("label").cast("long").alias("label"), "num_paths")


@query(with_views(f"SELECT batch, count(*) AS missing, string_agg(contract_id, ',' ORDER BY contract_id) FILTER (WHERE k <= 5) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY contract_id) AS k FROM entries WHERE NOT ({_VALID})) GROUP BY batch", "entries"))
def missing_artifacts(spark, sf_dir):
    return ds.missing_entries(*_entries(spark, sf_dir)).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(with_views(f"SELECT batch, count(*) FILTER (WHERE {_VALID} AND label = 0) AS safe, count(*) FILTER (WHERE {_VALID} AND label = 1) AS vulnerable, count(*) FILTER (WHERE NOT ({_VALID})) AS missing FROM entries GROUP BY ROLLUP (batch)", "entries"))
def batch_label_counts(spark, sf_dir):
    return ds.batch_label_counts(view(spark, sf_dir, "entries"), F.expr(_VALID))


_KEY = "md5(concat('42:', contract_id))"


@query(with_views(f"SELECT contract_id, batch, CAST(label AS BIGINT) AS label, num_paths FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, contract_id) AS k FROM flipped) WHERE label = 1 OR k <= (SELECT least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1)) FROM flipped)", "flipped"))
def balanced_entries(spark, sf_dir):
    return ds.balance(view(spark, sf_dir, "flipped")).select("contract_id", "batch", *long("label", "num_paths"))


@query(with_views(f"SELECT contract_id, row_number() OVER (ORDER BY {_KEY}, contract_id) - 1 AS place FROM flipped", "flipped"))
def shuffled_entries(spark, sf_dir):
    return ds.shuffle(view(spark, sf_dir, "flipped")).select("contract_id", *long("place"))


@query(with_views(f"""SELECT contract_id, CASE WHEN k <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT contract_id, row_number() OVER (ORDER BY {_KEY}, contract_id) AS k, count(*) OVER () AS n FROM flipped)""", "flipped"))
def split_entries(spark, sf_dir):
    return ds.split(view(spark, sf_dir, "flipped")).select("contract_id", "split")


#: Components of the embeddings.
DIMS = 64


def _vectors(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") - F.col("vec_id") % 10).alias("contract_id"), (F.col("vec_id") % 10).cast("int").alias("node"), F.col("embedding").alias("features"), "vec_id")


_VECTORS = "v AS (SELECT vec_id - vec_id % 10 AS contract_id, vec_id % 10 AS node, embedding AS features, vec_id FROM embeddings)"


@query(f"""WITH {_VECTORS} SELECT vec_id, i AS dim, CASE WHEN i <= len(features) THEN CAST(features[i] AS DOUBLE) WHEN i - len(features) - 1 = vec_id % 13 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM v, range(1, 75) r(i)""")
def one_hot_features(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", ds.one_hot(F.col("features"), F.col("vec_id") % 13).alias("f"))
    return v.select("vec_id", F.posexplode("f").alias("dim", "x")).select("vec_id", (F.col("dim") + 1).cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


@query(with_views("""WITH s AS (SELECT contract_id, list(rk ORDER BY rk) AS seq FROM taint_node GROUP BY contract_id)
SELECT contract_id, array_to_string(list_concat(seq, list_transform(range(20), lambda x: 0))[1:20], ',') AS sequence, CAST(least(len(seq), 20) AS BIGINT) AS length FROM s""", "taint_node"))
def padded_paths(spark, sf_dir):
    s = view(spark, sf_dir, "taint_node").groupBy("contract_id").agg(F.sort_array(F.collect_list(F.col("rk").cast("int"))).alias("seq"))
    seq, length = ds.pad_truncate(F.col("seq"), F.size("seq"))
    return s.select("contract_id", F.array_join(seq.cast("array<string>"), ",").alias("sequence"), length.cast("long").alias("length"))


@query(with_views("""WITH p AS (SELECT contract_id, num_paths, unnest(range(0, num_paths)) AS path_idx FROM entries WHERE num_paths > 0)
SELECT e.contract_id, e.num_paths, e.num_paths > 0 AS has_paths, coalesce(path_idx, 0) AS path_idx, CAST(CASE WHEN path_idx IS NULL THEN 0 ELSE 3 END AS BIGINT) AS length,
CAST(CASE WHEN path_idx IS NULL THEN 0 ELSE 3 + path_idx END AS DOUBLE) AS first_feature, CAST(20 AS BIGINT) AS width FROM entries e LEFT JOIN p USING (contract_id)""", "entries"))
def default_paths(spark, sf_dir):
    index = view(spark, sf_dir, "entries").select("contract_id", "num_paths")
    idx = F.explode(F.sequence(F.lit(0), F.col("num_paths").cast("int") - 1)).alias("path_idx")
    paths = index.where("num_paths > 0").select("contract_id", idx).select(
        "contract_id", "path_idx", F.array_repeat(F.lit(1), 20).alias("sequence"), F.lit(3).alias("length"), F.array_repeat((F.col("path_idx") + 3).cast("double"), 6).alias("features")
    )
    done = ds.with_default_paths(index, paths)
    return done.select("contract_id", "num_paths", "has_paths", *long("path_idx", "length"), F.col("features")[0].alias("first_feature"), F.size("sequence").cast("long").alias("width"))


@query(with_views("SELECT CAST(label AS BIGINT) AS label, n, round(n * 100.0::DOUBLE / t, 9) AS percent, round(t / (n * 2.0::DOUBLE), 9) AS weight FROM (SELECT label, count(*) AS n, (SELECT count(*) FROM entries) AS t FROM entries GROUP BY label)", "entries"))
def class_weights(spark, sf_dir):
    return ds.class_weights(view(spark, sf_dir, "entries")).select(*long("label"), "n", *_r("percent", "weight"))


@query("""SELECT contract_id, CAST(CASE WHEN f1 > 0.7 OR f2 > 0.8 OR f0 > 0.9 THEN 2 WHEN f1 > 0.4 OR f2 > 0.5 OR f0 > 0.6 THEN 1 ELSE 0 END AS BIGINT) AS risk_label
FROM (SELECT vec_id - vec_id % 3 AS contract_id, avg(abs(CAST(embedding[1] AS DOUBLE)) * 4) AS f0, avg(abs(CAST(embedding[2] AS DOUBLE)) * 4) AS f1, avg(abs(CAST(embedding[3] AS DOUBLE)) * 4) AS f2 FROM embeddings GROUP BY 1)""")
def path_risk_labels(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings")
    paths = e.select((F.col("vec_id") - F.col("vec_id") % 3).alias("contract_id"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 4).alias("features"))
    return ds.path_risk_label(paths).select("contract_id", *long("risk_label"))


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "scored")


_CLIPPED = "SELECT contract_id, 0.0::DOUBLE AS a, ln(least(greatest(prob, 0.01), 0.99) / (1 - least(greatest(prob, 0.01), 0.99))) AS b FROM scored"


@query(with_views(f"SELECT contract_id, round(exp(b) / (exp(a) + exp(b)), 9) AS prob, CAST(b > a AS BIGINT) AS pred, CAST(exp(b) / (exp(a) + exp(b)) > 0.6 AS BIGINT) AS above FROM ({_CLIPPED})", "scored"))
def softmax_predictions(spark, sf_dir):
    p = F.least(F.greatest("prob", F.lit(0.01)), F.lit(0.99))
    z = _scored(spark, sf_dir).select("contract_id", F.lit(0.0).alias("a"), F.log(p / (1 - p)).alias("b"))
    prob = ev.softmax_prob(F.col("a"), F.col("b"))
    return z.select("contract_id", F.round(prob, 9).alias("prob"), ev.argmax(F.col("a"), F.col("b")).cast("long").alias("pred"), ev.predict(prob, 0.6).cast("long").alias("above"))


def _cells_sql(t: str, source: str = "scored", group: str = "") -> str:
    return f"""SELECT {group + ',' if group else ''} count(*) FILTER (WHERE label = 0 AND prob <= {t}) AS tn, count(*) FILTER (WHERE label = 0 AND prob > {t}) AS fp,
 count(*) FILTER (WHERE label = 1 AND prob <= {t}) AS fn, count(*) FILTER (WHERE label = 1 AND prob > {t}) AS tp FROM {source}{' GROUP BY ' + group if group else ''}"""


_METRICS = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1"


@query(with_views(_cells_sql("0.5"), "scored"))
def confusion(spark, sf_dir):
    return ev.confusion(_scored(spark, sf_dir))


@query(with_views(f"SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT {_METRICS} FROM ({_cells_sql('0.5')}))", "scored"))
def precision_recall_f1(spark, sf_dir):
    return ev.metrics(_scored(spark, sf_dir)).select(*_r("precision", "recall", "f1"))


@query(with_views("""SELECT round(coalesce(sum(CASE WHEN a.prob > b.prob THEN 1.0::DOUBLE WHEN a.prob = b.prob THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 0), 9) AS auc_roc
FROM (SELECT prob FROM scored WHERE label = 1) a, (SELECT prob FROM scored WHERE label = 0) b""", "scored"))
def auc_roc(spark, sf_dir):
    return ev.auc_roc(_scored(spark, sf_dir)).select(*_r("auc_roc"))


_GRID = "grid AS (SELECT CAST(0.05 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) AS t FROM range(13) r(i))"


def _best_sql(score: str) -> str:
    return f"best AS (SELECT threshold, score FROM (SELECT threshold, {score} AS score FROM (SELECT threshold, {_METRICS} FROM ({_cells_sql('threshold', '(SELECT label, prob, t AS threshold FROM scored, grid)', 'threshold')}))) ORDER BY score DESC, threshold LIMIT 1)"


@query(with_views(f"""WITH {_GRID}, {_best_sql('f1')}, b2 AS (SELECT * FROM ({_best_sql('0.3::DOUBLE * f1 + 0.7::DOUBLE * recall')[9:-1]}))
SELECT 'f1' AS optimize_for, CASE WHEN score > 0 THEN threshold ELSE 0.5 END AS threshold, round(score, 9) AS score FROM best UNION ALL SELECT 'recall', CASE WHEN score > 0 THEN threshold ELSE 0.5 END, round(score, 9) FROM b2""", "scored"))
def best_threshold(spark, sf_dir):
    s = _scored(spark, sf_dir)
    each = [ev.best_threshold(s, o).select(F.lit(o).alias("optimize_for"), "threshold", *_r("score")) for o in ("f1", "recall")]
    return each[0].unionByName(each[1])


@query(with_views(f"""WITH a AS (SELECT recall AS r FROM (SELECT {_METRICS} FROM ({_cells_sql('CAST(0.5 AS DOUBLE)')}))), b AS (SELECT recall AS r FROM (SELECT {_METRICS} FROM ({_cells_sql('CAST(0.4 AS DOUBLE)')})))
SELECT CASE WHEN a.r < 0.65 AND b.r > a.r + 0.1 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS threshold, round(CASE WHEN a.r < 0.65 AND b.r > a.r + 0.1 THEN b.r ELSE a.r END, 9) AS recall FROM a, b""", "scored"))
def aggressive_threshold(spark, sf_dir):
    return ev.aggressive_threshold(_scored(spark, sf_dir), 0.5).select("threshold", *_r("recall"))


@query(with_views(f"SELECT tp + fn AS vulnerable, tp AS detected, fn AS missed, round(tp * 100 / CAST(tp + fn AS DOUBLE), 9) AS detected_percent, round(fn * 100 / CAST(tp + fn AS DOUBLE), 9) AS missed_percent FROM ({_cells_sql('0.5')})", "scored"))
def detection_breakdown(spark, sf_dir):
    return ev.detection_breakdown(_scored(spark, sf_dir)).select("vulnerable", "detected", "missed", *_r("detected_percent", "missed_percent"))


@query(with_views("SELECT round(coalesce(avg(CASE WHEN contract_id % 3 = label THEN 1.0::DOUBLE ELSE 0 END), 0), 9) AS accuracy FROM scored", "scored"))
def path_risk_accuracy(spark, sf_dir):
    return ev.path_risk_accuracy(_scored(spark, sf_dir).select((F.col("contract_id") % 3).alias("pred"), "label")).select(*_r("accuracy"))


_BALANCED = f"""(SELECT label, prob FROM (SELECT label, prob, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, contract_id) AS k, count(*) FILTER (WHERE label = 0) OVER () AS safe, count(*) FILTER (WHERE label = 1) OVER () AS vulnerable
  FROM scored) WHERE label = 1 OR k <= least(safe, vulnerable))"""


@query(with_views(f"""WITH x AS (SELECT 'balanced' AS s, {_METRICS} FROM ({_cells_sql('0.5', _BALANCED)}) UNION ALL SELECT 'imbalanced', {_METRICS} FROM ({_cells_sql('0.5')}))
SELECT metric, round(max(v) FILTER (WHERE s = 'balanced'), 9) AS balanced, round(max(v) FILTER (WHERE s = 'imbalanced'), 9) AS imbalanced
FROM (SELECT s, 'precision' AS metric, precision AS v FROM x UNION ALL SELECT s, 'recall', recall FROM x UNION ALL SELECT s, 'f1', f1 FROM x) GROUP BY metric""", "scored"))
def scenario_comparison(spark, sf_dir):
    s = _scored(spark, sf_dir)
    both = {"balanced": ev.metrics(ds.balance(s)), "imbalanced": ev.metrics(s)}
    return ev.compare_scenarios(both).select("metric", *_r("balanced", "imbalanced"))


@query(with_views("""WITH h AS (SELECT batch AS run, contract_id % 30 AS epoch, round(avg(prob), 6) AS val_f1 FROM scored JOIN (SELECT doc_id, source AS batch FROM documents) d ON d.doc_id = contract_id GROUP BY ALL)
SELECT run, epoch, val_f1 FROM h QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_f1 DESC, epoch) = 1""", "scored"))
def best_epoch(spark, sf_dir):
    s = _scored(spark, sf_dir).join(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("contract_id"), F.col("source").alias("run")), "contract_id")
    return ev.best_epoch(s.groupBy("run", (F.col("contract_id") % 30).alias("epoch")).agg(F.round(F.avg("prob"), 6).alias("val_f1")))


def _edges(nodes):
    n = nodes.select("contract_id", F.col("node").alias("src"))
    steps = n.select("contract_id", "src", F.explode(F.array(F.col("src") + 1, F.col("src") + 3)).alias("dst"))
    return steps.join(n.withColumnRenamed("src", "dst"), ["contract_id", "dst"], "left_semi")


_EDGES = "e AS (SELECT a.contract_id, a.node AS src, b.node AS dst FROM v a JOIN v b ON a.contract_id = b.contract_id AND (b.node = a.node + 1 OR b.node = a.node + 3 OR b.node = a.node))"


@query(f"""WITH {_VECTORS}, {_EDGES}, d AS (SELECT contract_id, dst AS node, count(*) AS deg FROM e GROUP BY ALL)
SELECT e.contract_id, e.dst AS node, CAST(i - 1 AS BIGINT) AS dim, round(sum(CAST(v.features[i] AS DOUBLE) / sqrt(s.deg * t.deg)), 6) + 0.0 AS value
FROM e JOIN v ON v.contract_id = e.contract_id AND v.node = e.src JOIN d s ON s.contract_id = e.contract_id AND s.node = e.src JOIN d t ON t.contract_id = e.contract_id AND t.node = e.dst, range(1, 65) r(i) GROUP BY ALL""")
def neighbour_aggregate(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("features", F.col("features").cast("array<double>"))
    done = gf.neighbour_aggregate(v, _edges(v))
    return done.select("contract_id", *long("node", "dim"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(f"WITH {_VECTORS} SELECT contract_id, CAST(i - 1 AS BIGINT) AS dim, round(avg(CAST(features[i] AS DOUBLE)), 6) + 0.0 AS mean, round(max(CAST(features[i] AS DOUBLE)), 6) + 0.0 AS max FROM v, range(1, 65) r(i) GROUP BY ALL")
def graph_pool(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("features", F.col("features").cast("array<double>"))
    return gf.graph_pool(v).select("contract_id", *long("dim"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "max")])


@query(f"""WITH {_VECTORS}, p AS (SELECT contract_id, node % 4 AS length, CAST(features[8] AS DOUBLE) * 10 AS score, features FROM v WHERE contract_id % 30 <> 0 AND node % 4 > 0),
w AS (SELECT contract_id, exp(score - max(score) OVER (PARTITION BY contract_id)) AS w, features FROM p),
g AS (SELECT contract_id, i - 1 AS dim, sum(w * CAST(features[i] AS DOUBLE)) / sum(w) AS attention, avg(CAST(features[i] AS DOUBLE)) AS mean, max(CAST(features[i] AS DOUBLE)) AS max FROM w, range(1, 65) r(i) GROUP BY ALL)
SELECT c.contract_id, CAST(c.dim AS BIGINT) AS dim, round(coalesce(attention, 0), 6) + 0.0 AS attention, round(coalesce(mean, 0), 6) + 0.0 AS mean, round(coalesce(max, 0), 6) + 0.0 AS max
FROM (SELECT DISTINCT contract_id, dim FROM v, range(0, 64) r(dim)) c LEFT JOIN g ON g.contract_id = c.contract_id AND g.dim = c.dim""")
def path_pool(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("features", F.col("features").cast("array<double>"))
    paths = v.where("contract_id % 30 <> 0").select("contract_id", (F.col("node") % 4).alias("length"), (F.col("features")[7] * 10).alias("score"), "features")
    done = gf.path_pool(paths, v.select("contract_id").distinct(), DIMS)
    return done.select("contract_id", *long("dim"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("attention", "mean", "max")])


#: Gate weights of the stand-in fusion: a fixed small matrix by rule.
WEIGHTS = [[((i * 7 + j * 3) % 5 - 2) / 4 for j in range(DIMS)] for i in range(DIMS)]
BIAS = [(i % 3 - 1) / 2 for i in range(DIMS)]
_GATE = " UNION ALL ".join(
    f"SELECT {i} AS dim, [{', '.join(f'CAST({w} AS DOUBLE)' for w in WEIGHTS[i])}] AS w, CAST({BIAS[i]} AS DOUBLE) AS b" for i in range(DIMS)
)


@query(f"""WITH {_VECTORS}, gate AS ({_GATE}), z AS (SELECT vec_id, dim, features, b + {' + '.join(f'w[{j}] * CAST(features[{j}] AS DOUBLE)' for j in range(1, DIMS + 1))} AS z FROM v, gate)
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(CAST(features[dim + 1] AS DOUBLE) / (1 + exp(-z)), 6) + 0.0 AS value FROM z""")
def gated_fusion(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("features", F.col("features").cast("array<double>"))
    # The graph and the path part are the two halves of the vector here.
    both = F.concat(F.slice("features", 1, DIMS // 2), F.slice("features", DIMS // 2 + 1, DIMS // 2))
    fused = v.select("vec_id", F.posexplode(gf.gated_fusion(both, WEIGHTS, BIAS)).alias("dim", "value"))
    return fused.select("vec_id", *long("dim"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query()
def weighted_classifier(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("contract_id"), (F.col("label") >= 7).cast("int").alias("label"), "embedding")
    train, test = rows.where("contract_id % 5 <> 0"), rows.where("contract_id % 5 = 0")
    scored = gf.score(gf.train_classifier(train, "embedding"), test, "embedding")
    return scored.select("contract_id", "label", F.round("prob", 6).alias("prob"))
