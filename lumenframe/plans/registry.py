"""All queries outside the corpus subpackage, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import prompts as W
from lumenframe.functions import rewrite as Q
from lumenframe.functions import text as T
from lumenframe.functions import tokens as K
from lumenframe.operators import checks as C
from lumenframe.operators import guards as G
from lumenframe.operators import labels as L
from lumenframe.operators import manifest as M
from lumenframe.operators import metrics as E
from lumenframe.operators import responses as P
from lumenframe.operators import resume as R
from lumenframe.operators import sampling as S
from lumenframe.operators import vectors as V
from lumenframe.plans.fixtures import responses
from lumenframe.sources import files as X
from lumenframe.sources import tables as B
from lumenframe.streaming import ingest as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {B.SQL} {sql}"
        return f

    return add


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.class_labels(B.records(spark, sf_dir), B.statements(spark, sf_dir))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_rows(_labels(spark, sf_dir))


@query("SELECT superclass, count(*) AS n, count(*) FILTER (label) AS n_yes, round(avg(CASE WHEN label THEN 1.0 ELSE 0.0 END), 6) AS rate FROM grid GROUP BY superclass")
def superclass_rates(spark, d):
    return L.rates(_grid(spark, d), "superclass")


@query("""SELECT CASE WHEN strat_fold <= 8 THEN 'train' WHEN strat_fold = 9 THEN 'val' ELSE 'test' END AS split, superclass, count(*) AS n, count(*) FILTER (label) AS n_yes,
    round(avg(CASE WHEN label THEN 1.0 ELSE 0.0 END), 6) AS rate FROM grid GROUP BY ALL""")
def split_counts(spark, d):
    return L.rates(_grid(spark, d).withColumn("split", L.split_of(F.col("strat_fold"))), "split", "superclass")


@query("""SELECT superclass, count(*) FILTER (label) AS n_yes, count(*) FILTER (NOT label) AS n_no, round(count(*) FILTER (NOT label)::DOUBLE / count(*) FILTER (label), 6) AS pos_weight
    FROM grid WHERE strat_fold <= 8 GROUP BY superclass""")
def positive_weights(spark, d):
    return L.positive_weights(_grid(spark, d))


_STATUS = """blocks AS (SELECT g.ecg_id, g.superclass, g.label, CASE WHEN d.doc_id IS NULL THEN 'no_answer' WHEN g.superclass = 'MI' AND n_chars <= 600 THEN 'missing'
    WHEN l.quality IS NULL OR trim(coalesce(text, '')) = '' THEN 'parse_failed' WHEN l.toxic = 1 THEN 'empty_reasoning' WHEN (l.quality = 1) <> g.label THEN 'label_mismatch' ELSE 'kept' END AS status
    FROM grid g LEFT JOIN documents d ON g.ecg_id = d.doc_id LEFT JOIN labels l ON g.ecg_id = l.doc_id)"""


def _taught(spark, d):
    """Answers as documents give them: short ones lack a block for MI, unlabelled ones a conclusion, toxic ones the reasoning."""
    docs, labels = B.table(spark, d, "documents").select("doc_id", "text", "n_chars"), B.table(spark, d, "labels")
    each = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("ecg_id"), F.explode(F.array(*map(F.lit, B.CLASSES))).alias("superclass"), "text", "n_chars", "quality", "toxic")
    there = each.where((F.col("superclass") != "MI") | (F.col("n_chars") > 600))
    return there.select("ecg_id", "superclass", F.col("text").alias("raw_block"), (F.col("quality") == 1).alias("conclusion"), F.when(F.col("toxic") == 1, "").otherwise(F.col("text")).alias("reasoning"))


def _blocks(spark, d):
    return L.block_status(_grid(spark, d).select("ecg_id", "superclass", "label"), _taught(spark, d))


@query(f", {_STATUS} SELECT status, count(*) AS blocks, count(DISTINCT ecg_id) AS records FROM blocks GROUP BY status")
def exclusion_accounting(spark, d):
    return L.exclusion_accounting(_blocks(spark, d))


@query(f", {_STATUS} SELECT ecg_id, superclass, label FROM blocks WHERE status = 'kept'")
def usable_examples(spark, d):
    return _blocks(spark, d).where("status = 'kept'").select("ecg_id", "superclass", "label")


_FLAGS = """f AS (SELECT r.ecg_id, r.strat_fold, r.validated, count(s.code) AS n, coalesce(bool_and(s.likelihood = 0), false) AS all_zero,
    coalesce(count(DISTINCT s.class) = 1 AND bool_and(s.class = 'NORM'), false) AS only_norm,
    coalesce(count(DISTINCT s.class) FILTER (s.diagnostic) = 1 AND bool_and(s.class = 'NORM') FILTER (s.diagnostic), false) AS diagnostic_norm,
    coalesce(count(DISTINCT s.class) FILTER (s.diagnostic AND s.likelihood > 0) = 1 AND bool_and(s.class = 'NORM') FILTER (s.diagnostic AND s.likelihood > 0), false) AS likely_norm,
    coalesce(bool_or(s.rhythm) AND bool_or(s.form), false) AS rhythm_and_form, coalesce(bool_or(s.diagnostic AND s.likelihood > 0 AND s.likelihood <= 50), false) AS low_likelihood
    FROM records r LEFT JOIN statements s USING (ecg_id) GROUP BY ALL)"""


@query(f""", {_FLAGS} SELECT count(*) AS n, median(n) AS median_statements, max(n) AS max_statements, count(*) FILTER (all_zero) AS all_zero, count(*) FILTER (only_norm) AS only_norm,
    count(*) FILTER (diagnostic_norm) AS diagnostic_norm, count(*) FILTER (likely_norm) AS likely_norm, count(*) FILTER (rhythm_and_form) AS rhythm_and_form, count(*) FILTER (low_likelihood) AS low_likelihood FROM f""")
def manifest_summary(spark, d):
    return M.summary(B.manifest(spark, d))


@query(f", {_FLAGS} SELECT ecg_id, CAST(n AS INTEGER) AS n_statements FROM f WHERE all_zero")
def all_zero_records(spark, d):
    return M.flags(B.manifest(spark, d)).where("all_zero").select("ecg_id", "n_statements")


@query("SELECT ecg_id, strat_fold FROM records ANTI JOIN statements USING (ecg_id)")
def records_without_statements(spark, d):
    lines = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ecg_id"))
    return R.skip_existing(B.records(spark, d), lines, "ecg_id").select("ecg_id", "strat_fold")


@query("""SELECT f AS strat_fold, count(*) FILTER (validated) AS validated, count(*) FILTER (NOT validated) AS unvalidated
    FROM (SELECT unnest(range(1, 11)) AS f) LEFT JOIN records ON f = strat_fold GROUP BY f""")
def validation_crosstab(spark, d):
    return M.validation_crosstab(B.records(spark, d))


@query("SELECT code, count(*) AS n FROM statements GROUP BY code ORDER BY n DESC, code LIMIT 10")
def top_codes(spark, d):
    return M.top_codes(B.statements(spark, d))


@query("""SELECT codes, count(*) AS n FROM (SELECT r.ecg_id, coalesce(string_agg(s.code::VARCHAR, '+' ORDER BY s.code) FILTER (s.rhythm OR s.form), '') AS codes
    FROM records r LEFT JOIN statements s USING (ecg_id) GROUP BY r.ecg_id) GROUP BY codes ORDER BY n DESC, codes LIMIT 10""")
def accompanying_code_sets(spark, d):
    return M.code_sets(B.manifest(spark, d))


@query("""SELECT codes, count(*) AS n FROM (SELECT r.ecg_id, coalesce(string_agg(s.code::VARCHAR, '+' ORDER BY s.code) FILTER (s.rhythm OR s.form), '') AS codes
    FROM records r JOIN statements s USING (ecg_id) GROUP BY r.ecg_id HAVING count(DISTINCT s.class) FILTER (s.diagnostic) = 1 AND bool_and(s.class = 'NORM') FILTER (s.diagnostic)) GROUP BY codes ORDER BY n DESC, codes LIMIT 10""")
def normal_code_sets(spark, d):
    return M.accompanying_sets(B.manifest(spark, d))


@query("SELECT ecg_id, CAST((row_number() OVER (ORDER BY ecg_id) - 1) // 2000 AS BIGINT) AS shard, CAST((row_number() OVER (ORDER BY ecg_id) - 1) % 2000 AS BIGINT) AS row FROM records")
def shard_layout(spark, d):
    return M.shard_layout(B.records(spark, d))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN 'regen' ELSE source END AS source FROM documents")
def regenerated_overlay(spark, d):
    full = B.table(spark, d, "documents").select("doc_id", "lang", "source")
    new = full.where("doc_id % 7 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit("regen").alias("source"))
    return R.overlay(full, new, "doc_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0")
def skip_existing(spark, d):
    e = B.table(spark, d, "events").select("event_id", "user_id")
    return R.skip_existing(e, e.where("event_id % 3 = 0"), "event_id")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    return R.last_write_wins(B.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT text, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY text")
def first_seen_turns(spark, d):
    c = B.table(spark, d, "conversations").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return R.first_seen(c, "text", "ord")


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'right' ELSE 'left' END AS only FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def id_set_difference(spark, d):
    return R.set_difference(B.table(spark, d, "documents").select("doc_id"), B.table(spark, d, "labels").select("doc_id"), "doc_id")


@query("""SELECT coalesce(sum(greatest(x, 0)), 0)::BIGINT AS only_left, coalesce(sum(greatest(-x, 0)), 0)::BIGINT AS only_right, coalesce(bool_and(x = 0), true) AS equal
    FROM (SELECT event_type, user_id, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS x FROM events GROUP BY event_type, user_id)""")
def multiset_equality(spark, d):
    e = B.table(spark, d, "events")
    half = lambda r: e.where(F.col("event_id") % 2 == r).select("event_type", "user_id")
    return R.multiset_equality(half(0), half(1))


@query("""SELECT count(*) AS shared, count(*) FILTER (texts = 1) AS identical FROM (SELECT conv_id, count(DISTINCT role) AS seen, count(DISTINCT text) AS texts FROM conversations GROUP BY conv_id)
    WHERE seen = (SELECT count(DISTINCT role) FROM conversations)""")
def identical_across_conditions(spark, d):
    return R.identical_across(B.table(spark, d, "conversations").select("conv_id", "role", "text"), "conv_id", "role", "text")


@query("""SELECT ecg_id, superclass, label FROM (SELECT *, row_number() OVER (PARTITION BY superclass, label ORDER BY md5(ecg_id::VARCHAR || '_42'), ecg_id) AS rank,
    count(*) FILTER (label) OVER (PARTITION BY superclass) AS yes, count(*) FILTER (NOT label) OVER (PARTITION BY superclass) AS no FROM grid)
    WHERE rank <= CASE WHEN label THEN 10 + greatest(10 - no, 0) ELSE 10 + greatest(10 - yes, 0) END""")
def stratified_draw(spark, d):
    return S.stratified_draw(_grid(spark, d), 20)


@query("""SELECT g.superclass, round(avg(CASE WHEN label THEN 1.0 ELSE 0.0 END), 6) AS population_rate, count(*) FILTER (rank <= 10) AS drawn FROM
    (SELECT *, row_number() OVER (PARTITION BY superclass, label ORDER BY md5(ecg_id::VARCHAR || '_42'), ecg_id) AS rank FROM grid) g GROUP BY g.superclass""")
def sample_vs_population(spark, d):
    g = _grid(spark, d)
    drawn = S.stratified_draw(g, 20).groupBy("superclass").agg(F.count("*").alias("drawn"))
    return L.rates(g, "superclass").join(drawn, "superclass").select("superclass", F.col("rate").alias("population_rate"), "drawn")


_CYCLE = """c AS (SELECT o_orderkey AS ecg_id, o_custkey % 50 AS g, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey % 50) AS n FROM orders
    WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY md5(o_orderkey::VARCHAR || '_7'), o_orderkey)),
    donors AS (SELECT a.ecg_id, a.g, CASE WHEN a.n > 1 THEN b.ecg_id END AS donor FROM c a JOIN c b ON a.g = b.g AND b.rn = a.rn % a.n + 1)"""


def _donors(spark, d):
    return S.derangement(B.records(spark, d), "ecg_id", F.col("patient") % 50)


@query(f", {_CYCLE} SELECT ecg_id, g, donor FROM donors")
def donor_derangement(spark, d):
    return _donors(spark, d)


@query(f""", {_CYCLE} SELECT x.superclass, count(*) AS n, count(*) FILTER (x.label <> y.label) AS opposite FROM donors JOIN grid x USING (ecg_id) JOIN grid y ON y.ecg_id = donor AND y.superclass = x.superclass GROUP BY x.superclass""")
def donor_answers(spark, d):
    g = _grid(spark, d).select("ecg_id", "superclass", "label")
    own = g.join(_donors(spark, d), "ecg_id")
    paired = own.join(g.toDF("donor", "superclass", "donor_label"), ["donor", "superclass"])
    return paired.groupBy("superclass").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("donor_label")).alias("opposite"))


@query("""SELECT doc_id, source, turn::INTEGER AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 30""")
def round_robin_report(spark, d):
    return S.round_robin(B.table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 30)


_GROUPS = "g AS (SELECT *, unnest(['overall', superclass, CASE WHEN superclass = 'en' THEN 'normal' ELSE 'abnormal' END]) AS grp FROM evals)"


def _prf(predicted: str) -> str:
    return f"""x AS (SELECT grp, count(*) AS n, count(*) FILTER (label) AS n_positive, count(*) FILTER ({predicted}) AS n_predicted, count(*) FILTER (label AND {predicted}) AS tp FROM g WHERE ({predicted}) IS NOT NULL GROUP BY grp),
    y AS (SELECT *, CASE WHEN n_predicted = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n_predicted END AS p, CASE WHEN n_positive > 0 THEN tp::DOUBLE / n_positive END AS r FROM x)
    SELECT grp, n, n_positive, n_predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN n_positive > 0 THEN CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END END, 6) AS f1 FROM y"""


@query(f", {_GROUPS}, {_prf('parsed')}")
def generation_metrics(spark, d):
    return E.confusion(E.with_groups(B.evaluations(spark, d), "en"), F.col("parsed"), "grp")


@query(f", {_GROUPS}, {_prf('p_yes >= 0.5')}")
def fast_metrics(spark, d):
    return E.confusion(E.with_groups(B.evaluations(spark, d), "en"), F.col("p_yes") >= 0.5, "grp")


@query(f""", {_GROUPS}, r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p_yes) + (count(*) OVER (PARTITION BY grp, p_yes) - 1) / 2.0 AS k FROM g),
    a AS (SELECT grp, count(*) AS n, count(*) FILTER (label) AS P, sum(k) FILTER (label) AS ranks FROM r GROUP BY grp),
    s AS (SELECT grp, p_yes, count(*) FILTER (label) AS pos, count(*) AS c FROM g GROUP BY grp, p_yes),
    u AS (SELECT grp, pos, sum(pos) OVER w AS tp, sum(c) OVER w AS taken FROM s WINDOW w AS (PARTITION BY grp ORDER BY p_yes DESC)),
    v AS (SELECT grp, sum(pos * tp / taken) AS area FROM u GROUP BY grp)
    SELECT grp, n, round(CASE WHEN P > 0 AND n > P THEN (ranks - P * (P + 1) / 2.0) / P / (n - P) END::DOUBLE, 6) AS auroc, round(CASE WHEN P > 0 THEN area / P END, 6) AS auprc FROM a JOIN v USING (grp)""")
def ranking_metrics(spark, d):
    return E.ranking(E.with_groups(B.evaluations(spark, d), "en"), "grp")


@query(f""", {_GROUPS}, t AS (SELECT grp, a.p_yes, (SELECT count(*) FILTER (label) FROM g b WHERE b.grp = a.grp AND b.p_yes >= a.p_yes) AS tp, (SELECT count(*) FROM g b WHERE b.grp = a.grp AND b.p_yes >= a.p_yes) AS taken,
    (SELECT count(*) FILTER (label) FROM g b WHERE b.grp = a.grp) AS P FROM (SELECT DISTINCT grp, p_yes FROM g) a), f AS (SELECT *, round(2 * tp / (taken + P), 9) AS f1, row_number() OVER (PARTITION BY grp ORDER BY round(2 * tp / (taken + P), 9) DESC, p_yes DESC) AS k FROM t WHERE P > 0)
    SELECT grp, p_yes AS threshold, round(f1, 6) AS f1 FROM f WHERE k = 1""")
def best_f1_threshold(spark, d):
    return E.best_f1(E.with_groups(B.evaluations(spark, d), "en"), "grp")


@query("""SELECT count(*) AS shared, count(*) FILTER (parsed IS NULL) AS unparsed, count(parsed) AS n, count(*) FILTER ((p_yes >= 0.5) = parsed) AS agree,
    count(*) FILTER (p_yes >= 0.5 AND parsed) AS both_yes, count(*) FILTER (p_yes < 0.5 AND NOT parsed) AS both_no FROM evals""")
def readout_agreement(spark, d):
    return E.agreement(B.evaluations(spark, d))


@query(f""", {_GROUPS} SELECT grp, count(*) AS n, round(avg(loss), 6) AS mean_loss, round(sum(loss * n_tokens) / sum(n_tokens), 6) AS token_mean, round(median(loss), 6) AS median_loss, count(*) FILTER (loss < 0.1) AS near_zero FROM g GROUP BY grp""")
def teacher_forced_summary(spark, d):
    return E.loss_summary(E.with_groups(B.evaluations(spark, d), "en"), "grp")


_CONTROLS = "c AS (SELECT ecg_id, superclass, label, NOT coalesce(parsed, label) AS donor_label, unnest(['real', 'shuffled', 'zeroed']) AS condition, unnest([loss, loss + p_yes, 3 * p_yes]) AS loss FROM evals)"


def _controls(spark, d):
    """Every example under three conditions, with a donor's label."""
    e = B.evaluations(spark, d)
    pair = lambda name, c: F.struct(F.lit(name).alias("condition"), c.alias("loss"))
    each = F.explode(F.array(pair("real", F.col("loss")), pair("shuffled", F.col("loss") + F.col("p_yes")), pair("zeroed", 3 * F.col("p_yes"))))
    return e.select("ecg_id", "superclass", "label", (~F.coalesce("parsed", "label")).alias("donor_label"), each.alias("x")).select("ecg_id", "superclass", "label", "donor_label", "x.*")


@query(f""", {_CONTROLS}, m AS (SELECT superclass, condition, avg(loss) AS m FROM c GROUP BY ALL)
    SELECT o.superclass, o.condition, round(r.m, 6) AS real, round(o.m, 6) AS mean, round(o.m - r.m, 6) AS gap, round(CASE WHEN r.m <> 0 THEN 100 * (o.m - r.m) / r.m END, 6) AS gap_percent
    FROM m o JOIN m r ON o.superclass = r.superclass AND r.condition = 'real' WHERE o.condition <> 'real'""")
def control_gaps(spark, d):
    return E.control_gaps(_controls(spark, d), "superclass")


@query(f""", {_CONTROLS}, s AS (SELECT condition, loss, unnest(['all', CASE WHEN label THEN 'yes' ELSE 'no' END, CASE WHEN label <> donor_label THEN CASE WHEN label THEN 'yes' ELSE 'no' END || ', donor opposite' END]) AS subset FROM c)
    SELECT condition, subset, count(*) AS n, round(avg(loss), 6) AS mean_loss FROM s WHERE subset IS NOT NULL GROUP BY ALL""")
def decision_controls(spark, d):
    return E.decision_controls(_controls(spark, d))


@query(f""", {_GROUPS}, b AS (SELECT * FROM g WHERE parsed IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p_yes) + (count(*) OVER (PARTITION BY grp, p_yes) - 1) / 2.0 AS k FROM b),
    a AS (SELECT grp, count(*) AS n, count(*) FILTER (label) AS P, sum(k) FILTER (label) AS ranks FROM r GROUP BY grp), s AS (SELECT grp, p_yes, count(*) FILTER (label) AS pos, count(*) AS c FROM b GROUP BY grp, p_yes),
    u AS (SELECT grp, pos, sum(pos) OVER w AS tp, sum(c) OVER w AS taken FROM s WINDOW w AS (PARTITION BY grp ORDER BY p_yes DESC)), v AS (SELECT grp, sum(pos * tp / taken) AS area FROM u GROUP BY grp),
    f AS (SELECT grp, count(*) AS n, count(parsed) AS n_parsed, count(*) FILTER (parsed AND label) AS tp, count(*) FILTER (parsed) AS pp, count(*) FILTER (parsed IS NOT NULL AND label) AS pos FROM g GROUP BY grp),
    q AS (SELECT *, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS pr, CASE WHEN pos > 0 THEN tp / pos END AS re FROM f)
    SELECT grp, q.n, n_parsed, n_parsed AS n_scored, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pos > 0 THEN CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END END, 6) AS f1,
    round(CASE WHEN P > 0 AND a.n > P THEN (ranks - P * (P + 1) / 2.0) / P / (a.n - P) END::DOUBLE, 6) AS auroc, round(CASE WHEN P > 0 THEN area / P END, 6) AS auprc,
    round(CASE WHEN P > 0 THEN round(area / P, 6) / (P / a.n) END, 6) AS lift FROM q LEFT JOIN a USING (grp) LEFT JOIN v USING (grp)""")
def metric_blocks(spark, d):
    return E.metric_block(E.with_groups(B.evaluations(spark, d), "en"), "grp")


@query("""SELECT superclass, count(*) AS n, round(avg(n_tokens), 6) AS mean_tokens, round(quantile_cont(n_tokens, 0.5)::DOUBLE, 6) AS p50_tokens, round(quantile_cont(n_tokens, 0.95)::DOUBLE, 6) AS p95_tokens, max(n_tokens) AS max_tokens,
    round(100 * avg((n_tokens < 2000)::INT), 6) AS closed_percent, round(100 * avg((parsed IS NULL)::INT), 6) AS unparsed_percent, count(*) FILTER (p_yes > 0.9) AS impure FROM evals GROUP BY superclass""")
def run_summaries(spark, d):
    runs = B.evaluations(spark, d).select("superclass", "n_tokens", (F.col("n_tokens") < 2000).alias("closed"), "parsed", F.when(F.col("p_yes") > 0.9, "impure").otherwise("clean").alias("status"))
    return E.run_summary(runs, "superclass")


@query("""SELECT c.condition, count(e.ecg_id) AS n, count(e.ecg_id) - count(parsed) AS unparsed, round(CASE WHEN count(parsed) > 0 THEN count(*) FILTER (parsed) / count(parsed) END, 6) AS yes_rate, round(coalesce(avg(n_tokens), 0.0), 6) AS mean_tokens
    FROM (SELECT DISTINCT superclass AS condition FROM evals WHERE superclass IS NOT NULL UNION SELECT 'zeroed') c LEFT JOIN evals e ON superclass = condition GROUP BY c.condition""")
def condition_summaries(spark, d):
    runs = B.evaluations(spark, d).withColumnRenamed("superclass", "condition")
    named = runs.where("condition IS NOT NULL").select("condition").unionAll(spark.createDataFrame([("zeroed",)], "condition string"))
    return E.condition_summary(runs, named)


@query("""SELECT b.bucket, round(avg(value), 6) AS mean_loss, count(value) AS n_positions, count(DISTINCT user_id) AS n_examples FROM (VALUES ('0-9', 0, 10), ('10-24', 10, 25), ('25-49', 25, 50), ('50-99', 50, 100), ('100+', 100, 1000000000)) b(bucket, low, high)
    LEFT JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) ON pos >= low AND pos < high GROUP BY b.bucket""")
def position_buckets(spark, d):
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return E.position_means(B.table(spark, d, "events").select(F.col("user_id").alias("key"), at.alias("position"), F.col("value").alias("loss")))


@query("""SELECT min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS mean, count(*) FILTER (n_chars > 4096) AS over, round(quantile_cont(n_chars, 0.5)::DOUBLE, 6) AS p50,
    round(quantile_cont(n_chars, 0.9)::DOUBLE, 6) AS p90, round(quantile_cont(n_chars, 0.95)::DOUBLE, 6) AS p95, round(quantile_cont(n_chars, 0.99)::DOUBLE, 6) AS p99 FROM documents""")
def token_length_percentiles(spark, d):
    return E.token_percentiles(B.table(spark, d, "documents").select("n_chars"), "n_chars", 4096)


@query("""SELECT * FROM (SELECT count(*) AS n, avg(loss) AS l, avg((n_tokens < 2000)::INT) AS c, abs(avg(n_tokens) - avg(1000.0 * loss + 10)) / avg(1000.0 * loss + 10) AS off, avg(coalesce(parsed = label, false)::INT) AS m,
    count(*) FILTER (label) AS ny, count(*) FILTER (NOT label) AS nn, avg(p_yes / 5) FILTER (label) AS dy, avg(p_yes / 5) FILTER (NOT label) AS dn, avg(p_yes / 10) FILTER (label) AS ry, avg(p_yes / 10) FILTER (NOT label) AS rn,
    count(*) FILTER (label AND NOT parsed) AS oy, count(*) FILTER (NOT label AND parsed) AS xn, avg(loss) FILTER (label AND NOT parsed) - avg(p_yes / 10) FILTER (label AND NOT parsed) AS gy, avg(loss) FILTER (NOT label AND parsed) - avg(p_yes / 10) FILTER (NOT label AND parsed) AS gn FROM evals) a,
    LATERAL (VALUES (1, 'mean loss', n, round(l, 6), l < 1.5), (2, 'closed', n, round(c, 6), c >= 0.9), (2, 'length', n, round(off, 6), off <= 0.25), (2, 'matches label', n, round(m, 6), m >= 0.9), (3, 'decision loss, yes', ny, round(dy, 6), dy < 0.1), (3, 'decision loss, no', nn, round(dn, 6), dn < 0.1),
    (4, 'real loss, yes', ny, round(ry, 6), ry < 0.1), (4, 'real loss, no', nn, round(rn, 6), rn < 0.1), (4, 'shuffled gap, yes', oy, round(gy, 6), CASE WHEN oy >= 8 THEN gy >= 0.5 END), (4, 'shuffled gap, no', xn, round(gn, 6), CASE WHEN xn >= 8 THEN gn >= 0.5 END)) v(condition, what, rows, measured, ok)""".replace("SELECT * FROM", "SELECT condition, what, v.rows AS n, measured, coalesce(ok, what LIKE 'shuffled%' AND NULL) AS ok FROM", 1))
def gate_verdicts(spark, d):
    e = B.evaluations(spark, d)
    x = e.select("label", "loss", (F.col("n_tokens") < 2000).alias("closed"), F.col("n_tokens").alias("n_generated"), (1000.0 * F.col("loss") + 10).alias("n_target"), "parsed", (F.col("p_yes") / 5).alias("decision_loss"), (F.col("p_yes") / 10).alias("real_loss"), F.col("loss").alias("shuffled_loss"), F.col("parsed").alias("donor_label"))
    return E.gate(x, 1.5)


_REPORTS = "reports AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN '  4.46   unbestÄtigter bericht' WHEN 1 THEN ' (NORM 100, IVCB)' WHEN 2 THEN ' Edit: NORM 80' ELSE '' END AS report FROM documents)"


def _reports(spark, d):
    end = F.when(F.col("doc_id") % 5 == 0, "  4.46   unbestÄtigter bericht").when(F.col("doc_id") % 5 == 1, " (NORM 100, IVCB)").when(F.col("doc_id") % 5 == 2, " Edit: NORM 80").otherwise("")
    return B.table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), end).alias("report"))


@query(rf""", {_REPORTS}, a AS (SELECT doc_id, report, regexp_replace(report, '\s*(?:\d+(?:[.,]\d+)?\s+)?unbest[\p{{L}}\p{{M}}\p{{N}}_]*tigter\s+bericht', '', 'gi') AS b FROM reports),
    b AS (SELECT *, regexp_replace(b, '\s*\([^)]*[A-Z]{{2,}}[^)]*\)', '', 'g') AS c FROM a),
    c AS (SELECT *, trim(regexp_replace(regexp_replace(c, '(?is)\s*\bEdit:.*$', ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS e FROM b)
    SELECT doc_id, CASE WHEN length(e) >= 15 THEN e ELSE '' END AS text, length(e) >= 15 AS usable, report <> b AS had_boilerplate, b <> c AS had_labels, regexp_matches(c, '(?i)\bEdit:') AS had_edit FROM c""")
def cleaned_reports(spark, d):
    return _reports(spark, d).select("doc_id", *[c.alias(n) for n, c in T.clean_report(F.col("report")).items()])


@query(rf""", {_REPORTS}, t AS (SELECT doc_id, report, regexp_split_to_array(translate(lower(report), ',.', '  '), '[ \t\n\x0B\f\r]+') AS w FROM reports)
    SELECT doc_id, CASE WHEN trim(report) = '' THEN false WHEN list_has_any(w, {T.SWEDISH!r}) THEN true WHEN regexp_matches(report, '{T.UMLAUTS}') THEN false ELSE list_has_any(w, {T.ENGLISH!r}) END AS non_german FROM t""")
def report_language(spark, d):
    return _reports(spark, d).select("doc_id", T.likely_non_german(F.col("report")).alias("non_german"))


@query("""SELECT c_custkey AS patient, superclass, CASE superclass WHEN 'NORM' THEN 'Is this a normal ECG?' ELSE 'Does this ECG show evidence of ' || name || '?' END || chr(10) || 'Patient: age ' ||
    CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) END || ', sex ' || CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown sex' END || '.' AS prompt
    FROM customer CROSS JOIN (VALUES ('NORM', ''), ('MI', 'myocardial infarction'), ('STTC', 'ST/T change'), ('CD', 'conduction disturbance'), ('HYP', 'hypertrophy')) v(superclass, name)""")
def student_prompts(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("patient"), "c_acctbal", F.explode(F.array(*map(F.lit, B.CLASSES))).alias("superclass"))
    age = F.when(F.col("c_acctbal") < 0, "unknown").otherwise(F.floor(F.col("c_acctbal") / 100).cast("string"))
    sex = F.when(F.col("patient") % 3 == 0, "male").when(F.col("patient") % 3 == 1, "female").otherwise("unknown sex")
    return c.select("patient", "superclass", F.concat(T.question(F.col("superclass")), F.lit("\nPatient: age "), age, F.lit(", sex "), sex, F.lit(".")).alias("prompt"))


@query("""SELECT ecg_id, superclass, CASE WHEN gone THEN 'missing' WHEN superclass = 'CD' AND ecg_id % 13 = 0 THEN 'unparseable' ELSE 'ok' END AS status,
    CASE WHEN gone OR (superclass = 'CD' AND ecg_id % 13 = 0) THEN NULL ELSE label END AS conclusion, CASE WHEN gone THEN NULL WHEN superclass = 'HYP' AND ecg_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS evidence_leaks,
    CASE WHEN gone THEN NULL ELSE 2 END::BIGINT AS evidence_items, CASE WHEN gone THEN NULL WHEN (ecg_id + k) % 5 = 0 THEN 'Step 1: look at the rate' || chr(10) || 'Step 2: decide'
    ELSE 'Step 1: look at the rate' || chr(10) || 'Step 2: look at the axis' || chr(10) || 'Step 3: decide' END AS reasoning, CASE WHEN gone THEN NULL WHEN (ecg_id + k) % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS removed_steps
    FROM (SELECT *, superclass = 'MI' AND ecg_id % 11 = 0 AS gone FROM grid)""")
def parsed_responses(spark, d):
    return P.parsed(responses(_labels(spark, d)))


@query("""SELECT count(*) FILTER (gone) AS missing, count(*) FILTER (NOT gone AND superclass = 'CD' AND ecg_id % 13 = 0) AS unparseable, count(*) FILTER (superclass = 'HYP' AND ecg_id % 7 = 0) AS leak_blocks,
    count(DISTINCT ecg_id) FILTER (ecg_id % 7 = 0) AS leak_records, count(*) FILTER (NOT gone AND (ecg_id + k) % 5 = 0) AS stripped_steps FROM (SELECT *, superclass = 'MI' AND ecg_id % 11 = 0 AS gone FROM grid)""")
def response_audit(spark, d):
    p = P.parsed(responses(_labels(spark, d)))
    leaks = F.col("evidence_leaks") > 0
    return p.agg(
        F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "unparseable").alias("unparseable"), F.count_if(leaks).alias("leak_blocks"),
        F.countDistinct(F.when(leaks, F.col("ecg_id"))).alias("leak_records"), F.sum("removed_steps").alias("stripped_steps"),
    )


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[.;\n]')) + 1 AS BIGINT) AS n_sentences FROM documents")
def sentence_counts(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), r"(?<=[.;\n])")).cast("long").alias("n_sentences"))


@query("SELECT dim::INTEGER AS dim, label, round(avg(x), 6) AS mean, round(sum(x) / count(*) FILTER (x <> 0), 6) AS nonzero_mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim, label")
def class_mean_vectors(spark, d):
    return V.mean_vectors(B.table(spark, d, "embeddings"), "label")


@query(""", x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), m AS (SELECT dim, avg(x) AS m FROM x WHERE vec_id % 10 < 8 GROUP BY dim)
    SELECT vec_id, round(sqrt(sum(x * x)), 5) AS norm, round(sqrt(sum((x - m) * (x - m))), 5) AS centred_norm FROM x JOIN m USING (dim) GROUP BY vec_id""")
def centred_norms(spark, d):
    return V.centred_norms(B.table(spark, d, "embeddings"), F.col("vec_id") % 10 < 8)


@query(""", x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), s AS (SELECT label, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY label, dim)
    SELECT label, max(n) AS n, round(CASE WHEN max(n) > 1 THEN sum(n * q - s * s) / (max(n) * (max(n) - 1) / 2.0) END::DOUBLE, 5) AS mean_square_distance FROM s GROUP BY label""")
def class_spread(spark, d):
    return V.spread(B.table(spark, d, "embeddings"), "label")


@query("""SELECT vec_id, round(1 / (1 + exp(ln(exp(embedding[3]::DOUBLE) + exp(embedding[4]::DOUBLE)) - ln(exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)))), 6) AS p_yes FROM embeddings""")
def pooled_probability(spark, d):
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")

    def lse(a, b):
        top = F.greatest(a, b)
        return top + F.log(F.exp(a - top) + F.exp(b - top))

    p = 1 / (1 + F.exp(lse(x(2), x(3)) - lse(x(0), x(1))))
    return B.table(spark, d, "embeddings").select("vec_id", F.round(p, 6).alias("p_yes"))


@query("SELECT event_type, count(*) FILTER (value >= 10) AS accepted, count(*) FILTER (value IS NULL OR value < 10) AS rejected FROM events GROUP BY event_type")
def streamed_ingest(spark, d):
    good, bad = I.ingest(spark, f"{d}/events.parquet", "value >= 10", I.shared_folder(spark))
    both = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return both.groupBy("event_type").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


@query()
def linear_probe(spark, d):
    """Coefficients of one-vs-rest logistic regression on the training rows, and the loss it ends with; no SQL form."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    v = B.table(spark, d, "embeddings").where("vec_id % 10 < 8").select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), "label")
    rows = []
    for k in (0, 1, 2):
        m = LogisticRegression(regParam=2e-4, elasticNetParam=0.0, standardization=False, maxIter=50).fit(v.withColumn("label", (F.col("label") == k).cast("double")))
        rows.append((k, float(m.intercept), float(m.summary.objectiveHistory[-1])))
    return spark.createDataFrame(rows, "label int, intercept double, loss double")


# --- files, prompts, selection and losses -----------------------------------------------------------------------

@query(f"""SELECT ecg_id, CAST(code AS VARCHAR) AS code, max(likelihood) AS likelihood, diagnostic, form, rhythm, class FROM statements GROUP BY ALL""")
def csv_statements(spark, d):
    folder = I.shared_folder(spark)
    text = lambda c: F.when(F.col(c), "1.0").alias(c)
    book = B.codebook(spark, d).select(F.col("code").cast("string").alias("code"), "description", text("diagnostic"), text("form"), text("rhythm"), "class")
    book.write.csv(f"{folder}/codebook", header=True)
    item = F.concat(F.lit("'"), F.col("code").cast("string"), F.lit("': "), F.col("likelihood").cast("string"))
    each = B.statements(spark, d).groupBy("ecg_id", "code").agg(F.max("likelihood").alias("likelihood")).withColumn("item", item)
    facts = each.groupBy("ecg_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("item")), ", "), F.lit("}")).alias("codes"))
    facts.write.csv(f"{folder}/facts", header=True)
    read = X.annotations_csv(spark, f"{folder}/facts", "ecg_id long, codes string", "codes")
    return X.coded(read, "ecg_id", "codes", X.codebook_csv(spark, f"{folder}/codebook")).select("ecg_id", "code", "likelihood", "diagnostic", "form", "rhythm", "class")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE lang END AS lang, text FROM documents WHERE doc_id IS NOT NULL")
def json_lines_last_wins(spark, d):
    folder = I.shared_folder(spark)
    docs = B.table(spark, d, "documents").select("doc_id", "lang", "text")
    X.write_json_lines(docs, f"{folder}/lines/1", "doc_id")
    X.write_json_lines(docs.where("doc_id % 7 = 0").withColumn("lang", F.upper("lang")), f"{folder}/lines/2", "doc_id")
    return X.json_lines(spark, f"{folder}/lines", "doc_id long, lang string, text string", "doc_id")


@query("SELECT CAST(row_number() OVER (ORDER BY n_name DESC) - 1 AS INTEGER) AS ord, n_nationkey, n_name FROM nation")
def requested_nations(spark, d):
    nations, path = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), f"{I.shared_folder(spark)}/ids"
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey")), False), lambda s: s["n_nationkey"])
    nations.agg(F.to_json(F.struct(listed.alias("ecg_ids"))).alias("value")).write.text(path)  # one row a nation
    return X.requested(nations, X.id_list(spark, path), "n_nationkey").select("ord", F.col("n_nationkey").cast(B.table(spark, d, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name")


@query("""SELECT o_orderkey AS ecg_id, concat_ws(chr(10), 'Clinical report: ' || CASE WHEN o_orderstatus = 'F' THEN 'priority ' || o_orderpriority ELSE '(no usable free-text report; rely on the annotated findings below)' END,
    'Annotated findings:', coalesce(s.lines, '  - none'), 'Recording properties:', '  Heart axis: ' || CASE o_orderkey % 3 WHEN 0 THEN 'LAD' WHEN 1 THEN 'MID' ELSE 'not annotated' END,
    '  Infarction stadium: ' || CASE o_orderkey % 4 WHEN 0 THEN 'Stadium I, Stadium II' WHEN 1 THEN 'Stadium II' ELSE 'not annotated' END,
    '  Signal quality: ' || CASE WHEN o_orderkey % 5 = 0 THEN 'static noise in leads V1; baseline drift in all leads' ELSE 'none annotated' END,
    'Patient context: age ' || CASE WHEN o_custkey % 11 = 0 THEN 'not recorded' ELSE CAST(o_custkey % 90 AS VARCHAR) END || ', sex ' || CASE o_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'not recorded' END) AS block
    FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('  - ' || p_name || ' [class: ' || coalesce(nullif(concat_ws(', ', CASE WHEN diagnostic THEN 'diagnostic' END, CASE WHEN form THEN 'form' END, CASE WHEN rhythm THEN 'rhythm' END), ''), 'unclassified')
        || '; likelihood: ' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || ']', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS lines
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN codebook ON l_partkey = code GROUP BY l_orderkey) s ON s.l_orderkey = o_orderkey""")
def input_blocks(spark, d):
    key, patient = F.col("ecg_id"), F.col("patient")
    more = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("ecg_id"), F.concat(F.lit("priority "), "o_orderpriority").alias("report"))
    m = B.manifest(spark, d).join(more, "ecg_id")
    stages = W.stadium(F.when(key % 4 == 0, " Stadium I").when(key % 4 == 1, "unknown"), F.when(key % 4 <= 1, "Stadium II").otherwise(" "))
    noisy = lambda field, raw: T.quality_phrase(field, F.when(key % 5 == 0, raw))
    block = W.input_block(
        F.col("report"), F.col("validated"), F.col("statements"), F.when(key % 3 == 0, "LAD").when(key % 3 == 1, "MID"), stages, F.array_compact(F.array(noisy("static_noise", " , V1 "), noisy("baseline_drift", "alles"))),
        F.when(patient % 11 != 0, (patient % 90).cast("double")), F.when(patient % 3 == 0, "male").when(patient % 3 == 1, "female"),
    )
    return m.select("ecg_id", block.alias("block"))


_BANK = ["Is it there?", "Can it be seen?", "Does the tracing show it?"]


@query(f"SELECT ecg_id, superclass, ({_BANK!r})[('0x' || substr(md5(ecg_id::VARCHAR || '_' || superclass), 1, 8))::BIGINT % 3 + 1] AS question FROM grid")
def paraphrased_questions(spark, d):
    return _grid(spark, d).select("ecg_id", "superclass", W.paraphrase(F.concat(F.col("ecg_id").cast("string"), F.lit("_"), "superclass"), _BANK).alias("question"))


@query(rf""", {_REPORTS}, t AS (SELECT doc_id, lower(report) AS low, list_distinct(regexp_split_to_array(translate(lower(report), ',.', '  '), '[ \t\n\x0B\f\r]+')) AS w FROM reports)
    SELECT doc_id, CASE WHEN trim(low) = '' THEN false WHEN list_has_any(w, {T.SWEDISH_SCORED!r}) THEN true WHEN regexp_matches(low, '[äöüß]') THEN false
    ELSE len(list_intersect(w, {T.ENGLISH_SCORED!r})) > len(list_intersect(w, {T.GERMAN_SCORED!r})) END AS non_german FROM t""")
def report_language_scored(spark, d):
    return _reports(spark, d).select("doc_id", T.non_german_by_score(F.col("report")).alias("non_german"))


@query()
def covering_records(spark, d):
    """Ten records that answer every class at least three times each way; greedy, no SQL form."""
    return S.covering_records(_grid(spark, d), 10, 3, B.CLASSES)


@query("""SELECT c AS condition, count(*) AS n, CASE WHEN c = 'b' THEN min(doc_id) FILTER (doc_id % 7 = 3 AND upper(lang) <> lang) END AS first_divergence
    FROM documents CROSS JOIN (VALUES ('a'), ('b')) v(c) GROUP BY c""")
def order_across_conditions(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", "lang")
    changed = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 3, F.upper("lang")).otherwise(F.col("lang")))
    return G.first_divergence(docs.withColumn("condition", F.lit("a")).unionByName(changed.withColumn("condition", F.lit("b"))), "condition", "doc_id", "lang")


@query("""SELECT superclass, round(quantile_cont(loss, 0.1)::DOUBLE, 6) AS p10, round(quantile_cont(loss, 0.3)::DOUBLE, 6) AS p30, round(quantile_cont(loss, 0.5)::DOUBLE, 6) AS p50, round(quantile_cont(loss, 0.7)::DOUBLE, 6) AS p70,
    round(quantile_cont(loss, 0.9)::DOUBLE, 6) AS p90, round(max(loss), 6) AS max, count(*) FILTER (loss < 0.1) AS near_zero FROM evals GROUP BY superclass""")
def loss_deciles(spark, d):
    return E.loss_deciles(B.evaluations(spark, d), "superclass", 0.1)


@query("""SELECT which, count(loss) AS n, round(avg(loss), 6) AS mean FROM (VALUES ('all'), ('yes'), ('no')) v(which) LEFT JOIN evals ON which = 'all' OR label = (which = 'yes') GROUP BY which""")
def mean_by_label(spark, d):
    return E.mean_by_label(B.evaluations(spark, d), "loss")


@query("""SELECT label, round(avg(CASE WHEN label = 1 THEN 2 * ln(1 + exp(-x)) ELSE ln(1 + exp(x)) END), 6) AS weighted_loss FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label""")
def weighted_losses(spark, d):
    loss = E.logistic_loss(F.get("embedding", F.lit(0)).cast("double"), (F.col("label") == 1).cast("double"), 2.0)
    return B.table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(loss), 6).alias("weighted_loss"))


@query(""", x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), u AS (SELECT label, dim, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS x FROM x),
    s AS (SELECT label, dim, count(*) AS n, sum(x) AS s FROM u GROUP BY label, dim)
    SELECT label, max(n) AS n, round(CASE WHEN max(n) > 1 THEN 1 - (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) END::DOUBLE, 4) AS mean_cosine_distance FROM s GROUP BY label""")
def class_cosine_spread(spark, d):
    return V.cosine_spread(B.table(spark, d, "embeddings"), "label")


@query("""SELECT vec_id, CAST(k - 1 AS INTEGER) AS rank, CAST(dim - 1 AS INTEGER) AS dim, round(1 / (1 + exp(-x::DOUBLE)), 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) AS k
    FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)) WHERE k <= 5""")
def top_dimensions(spark, d):
    return V.top_dimensions(B.table(spark, d, "embeddings"), "vec_id", 5)


#: Sentences of the test input, and what they must become; the rule that does it.
_CITING = [
    ("The report does not mention ST changes.", "The listed observations do not include ST changes.", "report_active"),
    ("The report describes the rhythm as regular.", "The rhythm is regular.", "report_positive_as"),
    ("Voltage criteria are not documented.", "Voltage criteria are not among the listed observations.", "passive_not_x"),
    ("A block is noted.", "A block is among the listed observations.", "passive_positive"),
    ("The axis is reported as left.", "The axis is left.", "characterisation_as"),
    ("Evidence 1 shows sinus rhythm.", "Evidence 1 shows sinus rhythm.", ""),
]


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _cited(spark, d):
    k = F.array_position(F.array(*map(F.lit, B.CLASSES)), F.col("superclass"))
    said = lambda i: F.element_at(F.array(*[F.lit(c[0]) for c in _CITING]), ((F.col("ecg_id") * 3 + k + i) % len(_CITING) + 1).cast("int"))
    return _grid(spark, d).select("ecg_id", "superclass", F.concat(F.lit("Step 1: "), said(0), F.lit("\nStep 2: "), said(1)).alias("reasoning"))


@query(f"""SELECT ecg_id, superclass, 'Step 1: ' || b[(ecg_id * 3 + k) % 6 + 1] || chr(10) || 'Step 2: ' || b[(ecg_id * 3 + k + 1) % 6 + 1] AS reasoning FROM (SELECT *, {_quoted(c[1] for c in _CITING)} AS b FROM grid)""")
def reworded_reasoning(spark, d):
    return Q.rewritten(_cited(spark, d), "reasoning").drop("rewrites")


@query(f"""SELECT rule, count(*) AS rewrites FROM (SELECT unnest([r[(ecg_id * 3 + k) % 6 + 1], r[(ecg_id * 3 + k + 1) % 6 + 1]]) AS rule FROM (SELECT *, {_quoted(c[2] for c in _CITING)} AS r FROM grid)) WHERE rule <> '' GROUP BY rule""")
def reword_counts(spark, d):
    return Q.rewrite_totals(_cited(spark, d), "reasoning").where("rewrites > 0")


@query("""SELECT doc_id, CASE WHEN position(chr(10) IN coalesce(text, '')) > 0 THEN position(chr(10) IN text) - 1 ELSE length(coalesce(text, '')) END::BIGINT AS kept, greatest(1, length(text) // 4)::BIGINT AS estimate FROM documents WHERE text IS NOT NULL""")
def trimmed_tokens(spark, d):
    """Characters as tokens, newline as the end."""
    docs = B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    ids = docs.select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("estimate"), F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "")).alias("ids"))
    return ids.select("doc_id", F.size(K.trim_generated(F.col("ids"), ["\n"])).cast("long").alias("kept"), "estimate")


@query("""SELECT conv_id, CAST(sum(n) AS BIGINT) AS padded, CAST(sum(m - n) AS BIGINT) AS filler FROM (SELECT conv_id, len(string_split(text, ' ')) AS n, max(len(string_split(text, ' '))) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id""")
def padded_turns(spark, d):
    """Turns of a conversation as a batch, padded to its longest."""
    c = B.table(spark, d, "conversations").select("conv_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint")).alias("ids"))
    width = c.groupBy("conv_id").agg(F.max(F.size("ids")).alias("width"))
    mask = K.attention(F.col("ids"), F.col("width"))
    ones = F.aggregate(mask, F.lit(0).cast("bigint"), lambda t, x: t + x)
    return c.join(width, "conv_id").select("conv_id", ones.alias("n"), (F.size(mask) - ones).alias("f")).groupBy("conv_id").agg(F.sum("n").alias("padded"), F.sum("f").alias("filler"))


@query("SELECT doc_id, coalesce(text, '') LIKE '%lead type%' OR lower(coalesce(text, '')) LIKE '%lead type%' AS lead_type, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[^.;\n]*[.;\n]|[^.;\n]+'), lambda x: x <> '')) AS BIGINT) AS sentences FROM documents")
def sentence_marks(spark, d):
    t = F.coalesce("text", F.lit(""))
    return B.table(spark, d, "documents").select("doc_id", T.has_lead_type(F.col("text")).alias("lead_type"), F.size(T.sentences(t)).cast("long").alias("sentences"))


@query("SELECT pattern, count(*) AS hits, count(*) AS blocks, count(DISTINCT ecg_id) AS records FROM (SELECT ecg_id, unnest(CASE WHEN superclass = 'HYP' AND ecg_id % 7 = 0 THEN ['the report'] WHEN (ecg_id + k) % 5 = 0 THEN ['known answer'] ELSE [] END || CASE WHEN superclass = 'HYP' AND ecg_id % 7 = 0 AND (ecg_id + k) % 5 = 0 THEN ['known answer'] ELSE [] END) AS pattern FROM grid WHERE NOT (superclass = 'MI' AND ecg_id % 11 = 0)) GROUP BY pattern")
def leak_patterns(spark, d):
    return P.leak_counts(P.leaks(responses(_labels(spark, d))))


@query("""SELECT ecg_id, 'header' AS split_method, CASE WHEN ecg_id % 11 = 0 THEN 'MI' ELSE '' END AS missing, CASE WHEN ecg_id % 13 = 0 THEN 'CD' ELSE '' END AS unparseable, ecg_id % 11 <> 0 AND ecg_id % 13 <> 0 AS ok FROM records""")
def response_statuses(spark, d):
    s = P.response_status(responses(_labels(spark, d)))
    return s.select("ecg_id", "split_method", F.array_join("missing", ",").alias("missing"), F.array_join("unparseable", ",").alias("unparseable"), "ok")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(greatest(0.0, 1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))), 4) AS to_reversed FROM embeddings")
def vector_distances(spark, d):
    v = B.table(spark, d, "embeddings")
    return v.select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.round(V.cosine_distance(F.col("embedding"), F.reverse("embedding")), 4).alias("to_reversed"))


@query("""SELECT problem, n FROM (SELECT 'repeated ids' AS problem, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL
    SELECT 'rows not contiguous', (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)))
    UNION ALL SELECT 'repeated slots', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey, l_linenumber HAVING count(*) > 1)) UNION ALL SELECT 'missing ids', (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem))
    UNION ALL SELECT 'shards too large', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) > 6))) WHERE n > 0""")
def cache_check(spark, d):
    index = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("shard"), (F.col("l_linenumber") - 1).alias("row"))
    return C.cache_problems(index, B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 6)


@query(f"""SELECT d.superclass, d.label, count(*) AS n FROM grid d WHERE ecg_id IN (SELECT DISTINCT ecg_id FROM grid ORDER BY ecg_id LIMIT 100) AND superclass IN ('MI', 'CD') GROUP BY ALL""")
def capped_records(spark, d):
    return L.record_cap(_grid(spark, d), ["MI", "CD"], 100).groupBy("superclass", "label").agg(F.count("*").alias("n"))
