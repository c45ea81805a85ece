"""Queries over whole tables in one order, pairs, signals, named sets, draws and files, each beside the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import signals as G
from lumenframe.functions import text as T
from lumenframe.functions import tokens as K
from lumenframe.operators import checks as C
from lumenframe.operators import labels as L
from lumenframe.operators import metrics as E
from lumenframe.operators import pairs as D
from lumenframe.operators import probes as P
from lumenframe.operators import sampling as S
from lumenframe.operators import series as R
from lumenframe.operators import vectors as V
from lumenframe.plans.registry import query
from lumenframe.sources import files as X
from lumenframe.sources import tables as B


def _r(name: str, places: int = 6):
    return F.round(name, places).alias(name)


@query("SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS 19 PRECEDING), 6) AS running FROM events")
def running_means(spark, d):
    return R.running_means(B.table(spark, d, "events").select("event_id", "value"), "value", 20, "event_id").select("event_id", _r("running"))


_BATCHES = "batches AS (SELECT event_id, value AS llm, value / 2 AS linear, CASE WHEN user_id % 4 > 0 THEN value / 3 END AS consistency, user_id % 4 AS n_consistency, user_id % 3 AS n_skipped FROM events)"


@query(f""", {_BATCHES}, w AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS w FROM batches)
    SELECT CAST(w AS BIGINT) AS "window", count(*) AS batches, round(avg(llm), 6) AS llm, round(avg(linear), 6) AS linear, round(CASE WHEN sum(n_consistency) > 0 THEN sum(consistency * n_consistency) / sum(n_consistency) END, 6) AS consistency,
    sum(n_consistency)::BIGINT AS n_consistency, sum(n_skipped)::BIGINT AS n_skipped FROM w GROUP BY w""")
def window_terms(spark, d):
    kind = F.col("user_id") % 4
    e = B.table(spark, d, "events").select(
        "event_id", F.col("value").alias("llm"), (F.col("value") / 2).alias("linear"), F.when(kind > 0, F.col("value") / 3).alias("consistency"), F.lit(None).cast("double").alias("gap"), kind.alias("n_consistency"), (F.col("user_id") % 3).alias("n_skipped")
    )
    return R.window_terms(e, 50, "event_id").select("window", "batches", _r("llm"), _r("linear"), _r("consistency"), "n_consistency", "n_skipped")


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(100 * q)}" for q in (0.01, 0.1, 0.5, 0.9, 0.99)) + " FROM events GROUP BY event_type")
def value_quantiles(spark, d):
    q = R.exact_quantiles(B.table(spark, d, "events"), "value", [0.01, 0.1, 0.5, 0.9, 0.99], "event_type", small=200)
    return q.select("event_type", *[_r(f"p{x}") for x in (1, 10, 50, 90, 99)])


_OTHER = f"""o AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(translate(lower(coalesce(text, '')), ',.', '  '), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
    other AS (SELECT doc_id, t, list_has_any(w, {T.SWEDISH!r}) AS swedish, CASE WHEN regexp_replace(t, '\\s', '', 'g') = '' THEN false WHEN list_has_any(w, {T.SWEDISH!r}) THEN true WHEN regexp_matches(t, '{T.UMLAUTS}') THEN false ELSE list_has_any(w, {T.ENGLISH!r}) END AS non_german FROM o)"""


@query(f""", {_OTHER} SELECT count(*) AS n, count(*) FILTER (regexp_replace(t, '\\s', '', 'g') = '') AS n_blank, round(100.0 * count(*) FILTER (regexp_replace(t, '\\s', '', 'g') = '') / count(*), 2)::DOUBLE AS blank_percent, median(length(t)) AS median_length,
    median(CASE WHEN length(t) > 0 THEN length(t) END) AS median_filled, min(length(t)) FILTER (length(t) > 0)::INTEGER AS least, max(length(t)) FILTER (length(t) > 0)::INTEGER AS greatest, count(*) FILTER (non_german) AS n_non_german, round(100.0 * count(*) FILTER (non_german) / count(*), 2)::DOUBLE AS non_german_percent FROM other""")
def report_coverage(spark, d):
    return E.report_coverage(B.table(spark, d, "documents"), "text", T.likely_non_german(F.col("text")))


@query("""SELECT vec_id, CAST(s AS INTEGER) AS segment, round(list_sum(z[s * 50 + 1:s * 50 + 50]), 5) AS total, round(z[s * 50 + 1], 5) AS first, round(z[s * 50 + 50], 5) AS last FROM (SELECT vec_id, unnest(range(0, 3)) AS s,
    list_transform(y, lambda v: (v - m) / dev) AS z FROM (SELECT *, list_avg(y) AS m, sqrt(list_avg(list_transform(y, lambda v: (v - list_avg(y)) * (v - list_avg(y))))) AS dev
    FROM (SELECT vec_id, list_transform(range(0, 160), lambda i: x[(i * 63.0 / 159)::DOUBLE.floor()::INT + 1] + (x[least(floor(i * 63.0 / 159)::INT + 2, 64)] - x[floor(i * 63.0 / 159)::INT + 1]) * (i * 63.0 / 159 - floor(i * 63.0 / 159))) AS y
    FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings))))""".replace("(i * 63.0 / 159)::DOUBLE.floor()::INT", "floor(i * 63.0 / 159)::INT").replace("63.0", "63.0::DOUBLE"))
def prepared_signals(spark, d):
    """Embeddings as signals of 100 samples a second, brought to 250 and cut into segments of 50."""
    e = B.table(spark, d, "embeddings").select("vec_id", G.standardised(G.constant_zeroed(G.resampled(F.col("embedding"), 100, 250))).alias("z"))
    each = e.select("vec_id", F.posexplode(G.segments(F.col("z"), 50)).alias("segment", "s"))
    total = F.aggregate("s", F.lit(0.0), lambda t, v: t + v)
    return each.select("vec_id", "segment", F.round(total, 5).alias("total"), F.round(F.get("s", F.lit(0)), 5).alias("first"), F.round(F.get("s", F.lit(49)), 5).alias("last"))


_VECTORS = "v AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


def _pairs_sql(rows: str, group: str, key: str) -> str:
    return f"""SELECT a.{group}, count(*) AS pairs, sum(greatest(0, 1 - list_cosine_similarity(a.x, b.x))) AS cosine, sum(list_distance(a.x, b.x)) AS l2 FROM {rows} a JOIN {rows} b ON a.{group} = b.{group} AND a.{key} < b.{key} GROUP BY a.{group}"""


@query(f""", {_VECTORS} SELECT label::VARCHAR AS label, pairs, round(cosine / pairs, 5) AS cosine, round(l2 / pairs / (SELECT avg(sqrt(list_dot_product(x, x))) FROM v), 5) AS l2 FROM ({_pairs_sql('v', 'label', 'vec_id')})""")
def pair_distances(spark, d):
    e = B.table(spark, d, "embeddings")
    sums = D.pair_sums(e, "label", "vec_id").join(D.mean_norm(e))  # one row
    return sums.select("label", "pairs", F.round(F.col("cosine") / F.col("pairs"), 5).alias("cosine"), F.round(F.col("l2") / F.col("pairs") / F.col("norm"), 5).alias("l2"))


_SPREADS = """i AS (SELECT 'all' AS g, vec_id AS k, x FROM v), o AS (SELECT vec_id // 10 AS record, vec_id % 10 AS question, x FROM v), h AS (SELECT record, question, list_transform(list_zip(a.x, b.x), lambda z: z[1] + 2 * z[2]) AS x FROM o a JOIN (SELECT record, x FROM o WHERE question = 0) b USING (record)),
    s AS (SELECT 'input' AS over, sum(pairs) AS pairs, sum(cosine) AS cosine, sum(l2) AS l2 FROM ({i}) UNION ALL SELECT 'held', sum(pairs), sum(cosine), sum(l2) FROM ({h}) UNION ALL SELECT 'own', sum(pairs), sum(cosine), sum(l2) FROM ({o}) UNION ALL SELECT 'within', sum(pairs), sum(cosine), sum(l2) FROM ({w})),
    n AS (SELECT avg(sqrt(list_dot_product(x, x))) AS norm FROM v), t AS (SELECT over, pairs::BIGINT AS pairs, cosine / pairs AS cosine, l2 / pairs / norm AS l2, norm FROM s, n)"""


@query(", " + _VECTORS + ", " + _SPREADS.format(i=_pairs_sql("i", "g", "k"), h=_pairs_sql("h", "question", "record"), o=_pairs_sql("o", "question", "record"), w=_pairs_sql("o", "record", "question")) + """
    SELECT t.over, t.pairs, round(t.cosine, 5) AS cosine, round(t.l2, 5) AS l2, round(t.norm, 5) AS norm, round(CASE WHEN t.over = 'held' THEN t.cosine / w.cosine END, 4) AS cosine_of_within, round(CASE WHEN t.over = 'held' THEN t.l2 / w.l2 END, 4) AS l2_of_within,
    round(CASE WHEN t.over = 'held' THEN t.cosine / i.cosine END, 4) AS cosine_of_input, round(CASE WHEN t.over = 'held' THEN t.l2 / i.l2 END, 4) AS l2_of_input FROM t, t w, t i WHERE w.over = 'within' AND i.over = 'input'""")
def four_way_spread(spark, d):
    """Vectors as inputs; as outputs of ten questions to each record; and, for the held prompt, moved by twice the record's first vector."""
    e = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    outputs = e.select(F.floor(F.col("vec_id") / 10).alias("record"), (F.col("vec_id") % 10).alias("question"), "embedding")
    first = outputs.where("question = 0").select("record", F.col("embedding").alias("_first"))
    held = outputs.join(first, "record").withColumn("embedding", F.zip_with("embedding", "_first", lambda x, y: x.cast("double") + 2 * y.cast("double"))).drop("_first")
    out = D.four_way_spread(e.withColumnRenamed("vec_id", "record"), outputs, held)
    return out.select("over", "pairs", *[F.round(c, 5).alias(c) for c in ("cosine", "l2", "norm")], *[F.round(c, 4).alias(c) for c in ("cosine_of_within", "l2_of_within", "cosine_of_input", "l2_of_input")])


def _whole_manifest(spark, d) -> DataFrame:
    """The manifest with codes as names, a report (the document of that id) and recording-quality fields (from the priority)."""
    m = B.manifest(spark, d)
    name = lambda s: F.when(s["rhythm"], "SR").when(s["class"] == "NORM", "NORM").otherwise(F.concat(F.lit("C"), s["code"].cast("string")))
    m = m.withColumn("statements", F.transform("statements", lambda s: s.withField("code", name(s))))
    p = F.col("o_orderpriority")
    fields = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("ecg_id"), F.when(p == "1-URGENT", " , V1 ").when(p == "2-HIGH", " ").alias("baseline_drift"), F.when(p == "3-MEDIUM", "alles").otherwise("").alias("static_noise"))
    return m.join(fields, "ecg_id").join(B.table(spark, d, "documents").select(F.col("doc_id").alias("ecg_id"), F.col("text").alias("report")), "ecg_id", "left")


_SETS = f"""{_OTHER}, c AS (SELECT ecg_id, list_sort(list(DISTINCT CASE WHEN rhythm THEN 'SR' WHEN class = 'NORM' THEN 'NORM' ELSE 'C' || code END)) AS codes, coalesce(list(DISTINCT class) FILTER (diagnostic), []) AS classes, count(*) FILTER (diagnostic) AS nd,
    coalesce(bool_or(diagnostic AND likelihood > 0 AND likelihood <= 50), false) AS low FROM statements GROUP BY ecg_id),
    m AS (SELECT r.ecg_id, validated, coalesce(codes, []) AS codes, coalesce(classes, []) AS classes, coalesce(nd, 0) AS nd, coalesce(low, false) AS low, o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS noisy, coalesce(swedish, false) AS swedish, coalesce(non_german, false) AS non_german
    FROM records r JOIN orders ON o_orderkey = ecg_id LEFT JOIN c USING (ecg_id) LEFT JOIN other ON doc_id = r.ecg_id)"""


def _sets_sql(sets: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in sets.items())
    return f", {_SETS} SELECT stratum, count(*) AS n FROM (SELECT unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS stratum FROM m) GROUP BY stratum"


@query(_sets_sql({
    "NORM+SR only": "codes = ['NORM', 'SR']", "multi-label abnormal": "NOT list_contains(classes, 'NORM') AND nd >= 2", "low-likelihood diagnostic": "low", "signal-quality annotated": "noisy", "unvalidated": "NOT validated",
    "swedish report": "swedish", "non-German (English/Swedish)": "non_german",
}))
def pilot_strata(spark, d):
    return L.pilot_strata(_whole_manifest(spark, d), ["baseline_drift", "static_noise"]).groupBy("stratum").agg(F.count("*").alias("n"))


@query(_sets_sql({
    "NORM+SR only": "codes = ['NORM', 'SR']", "multi-label abnormal": "NOT list_contains(codes, 'NORM') AND nd >= 2", "validated_by_human=True": "validated", "validated_by_human=False": "NOT validated", "signal-quality annotated": "noisy",
}))
def report_strata(spark, d):
    return L.report_strata(_whole_manifest(spark, d), ["baseline_drift", "static_noise"]).groupBy("stratum").agg(F.count("*").alias("n"))


def _filed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Records with a file name each, and files: some as named, some without the rate's folder, some with one part only, some nowhere."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("ecg_id"), F.format_string("%05d/%05d_hr", F.floor(F.col("o_orderkey") / 1000) * 1000, "o_orderkey").alias("below"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    records = o.select("ecg_id", F.concat(F.lit("records500/"), "below").alias("filename"), F.when(F.col("p") != 2, F.array(F.lit("MI"))).otherwise(F.array().cast("array<string>")).alias("superclass"))
    stem = F.when(F.col("p") <= 2, F.concat(F.lit("records500/"), "below")).when(F.col("p") <= 4, F.col("below"))
    parts = F.when(F.col("p") == 4, F.array(F.lit(".dat"))).otherwise(F.array(F.lit(".dat"), F.lit(".hea")))
    return records, o.where("p <= 4").select(stem.alias("stem"), F.explode(parts).alias("suffix"))


_FILED = """f AS (SELECT o_orderkey AS ecg_id, o_orderpriority[1:1]::INT AS p, printf('%05d/%05d_hr', o_orderkey // 1000 * 1000, o_orderkey) AS below FROM orders)"""


@query(f", {_FILED} SELECT ecg_id, CASE WHEN p = 1 THEN 'records500/' ELSE '' END || below AS stem FROM f WHERE p IN (1, 3, 4)")
def located_records(spark, d):
    records, files = _filed(spark, d)
    return X.with_files_and_labels(X.located(records, files), "superclass").select("ecg_id", "stem")


@query(f", {_FILED} SELECT ecg_id FROM f WHERE p >= 4")
def records_without_files(spark, d):
    records, files = _filed(spark, d)
    return X.missing_files(X.located(records, files), "ecg_id").select("ecg_id")


def _draw_sql(mode: str, n: int) -> str:
    half = "CASE WHEN p.label THEN (q + 1) // 2 ELSE q // 2 END"
    want = {"superclass": "q", "superclass-label": f"{half} - greatest({half} - own, 0) + greatest(q - ({half}) - other, 0)"}[mode]
    cell = {"superclass": "superclass", "superclass-label": "superclass, label"}[mode]
    return f""", q AS (SELECT superclass, label, count(*) AS own, any_value(k) AS k, {n} // 5 + (any_value(k) <= {n} % 5)::INT AS q FROM grid GROUP BY superclass, label),
    w AS (SELECT a.superclass, a.label, a.own, a.q, coalesce(b.own, 0) AS other FROM q a LEFT JOIN q b ON a.superclass = b.superclass AND a.label <> b.label),
    p AS (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY md5(ecg_id || '|' || superclass || '_42'), ecg_id) AS rank FROM grid)
    SELECT ecg_id, p.superclass, p.label FROM p JOIN w ON p.superclass = w.superclass AND p.label = w.label WHERE rank <= {want}"""


def _grid(spark, d) -> DataFrame:
    return L.label_rows(L.class_labels(B.records(spark, d), B.statements(spark, d)))


@query(_draw_sql("superclass-label", 1013))
def sample_by_label(spark, d):
    return S.sample(_grid(spark, d), 1013, "superclass-label", B.CLASSES)[0]


@query(_draw_sql("superclass", 1013))
def sample_by_class(spark, d):
    return S.sample(_grid(spark, d), 1013, "superclass", B.CLASSES)[0]


@query("SELECT ecg_id, superclass, label FROM grid ORDER BY md5(ecg_id || '|' || superclass || '_42') LIMIT 1013")
def sample_uniform(spark, d):
    return S.sample(_grid(spark, d), 1013, "none", B.CLASSES)[0]



@query("""SELECT n_chars, count(*) AS n FROM documents GROUP BY n_chars HAVING count(*) > 1""")
def repeated_lengths(spark, d):
    return C.duplicates(B.table(spark, d, "documents"), "n_chars")


@query("""SELECT vec_id, round(sum(x * x) ** 0.5, 5) AS norm, round(12.5 / sqrt(count(*)), 6) AS gain FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id""")
def calibrated_gains(spark, d):
    e = B.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.calibrated_gain(12.5, F.size("embedding")), 6).alias("gain"))


@query("""SELECT label, round(avg(x), 6) AS odds FROM (SELECT label, ln(list_sum(list_transform(embedding[1:32], lambda v: exp(v::DOUBLE)))) - ln(list_sum(list_transform(embedding[33:64], lambda v: exp(v::DOUBLE)))) AS x FROM embeddings) GROUP BY label""")
def log_odds(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return B.table(spark, d, "embeddings").select("label", K.log_odds(F.slice(x, 1, 32), F.slice(x, 33, 32)).alias("x")).groupBy("label").agg(F.round(F.avg("x"), 6).alias("odds"))


@query("""SELECT doc_id, len(t) AS n_ids, len(p) AS n_prompt, len(p) AS n_open, list_sum(t)::BIGINT AS total FROM (SELECT doc_id, list_concat(p, a) AS t, p FROM (SELECT doc_id, list_transform(range(1, 6 + 1), lambda i: ord(text[i]))::BIGINT[] AS p, list_transform(range(7, 12 + 1), lambda i: ord(text[i]))::BIGINT[] AS a FROM documents WHERE length(text) >= 12))""")
def spliced_inputs(spark, d):
    """Prompt and target ids of each text (its first characters), joined, with the prompt unsupervised and attended to."""
    code = lambda i: F.ascii(F.substring("text", i, 1)).cast("long")
    docs = B.table(spark, d, "documents").where(F.length("text") >= 12)
    ids = docs.select("doc_id", F.array(*[code(i) for i in range(1, 7)]).alias("p"), F.array(*[code(i) for i in range(7, 13)]).alias("a"))
    s = K.splice(F.col("p"), F.col("a"))
    both = ids.select("doc_id", F.size("p").alias("n_prompt"), s["input_ids"].alias("ids"), s["labels"].alias("labels"))
    opened = K.prompt_mask(F.transform("ids", lambda _: F.lit(1)), F.col("labels"))
    return both.select("doc_id", F.size("ids").alias("n_ids"), "n_prompt", F.size(F.filter(opened, lambda x: x)).alias("n_open"), F.aggregate("ids", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS estimate, text[1:500] AS error, text AS prompt FROM documents")
def text_limits(spark, d):
    """Estimated tokens, the part of a text that an error keeps, and the text again without the thinking mark put behind it."""
    t = B.table(spark, d, "documents")
    return t.select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("estimate"), T.error_text(F.col("text")).alias("error"), T.strip_think(F.concat("text", F.lit("<think> \n"))).alias("prompt"))


@query("""SELECT DISTINCT ON (source) source, doc_id, lang FROM documents ORDER BY source, doc_id""")
def one_of_each_source(spark, d):
    return S.one_of_each(B.table(spark, d, "documents").select("source", "doc_id", "lang"), "source", "doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '_5'), doc_id LIMIT 137)""")
def exact_draw(spark, d):
    return S.exact_sample(B.table(spark, d, "documents").select("doc_id"), 137, 5, "doc_id")


@query("""SELECT a.doc_id, b.quality, b.toxic FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '_9'), doc_id) AS n FROM labels) a JOIN (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '_10'), doc_id) AS n FROM labels) b USING (n)""")
def permuted_labels(spark, d):
    return S.permuted_labels(B.table(spark, d, "labels"), 9, "doc_id", ["quality", "toxic"])


@query("""SELECT ecg_id, superclass, label FROM grid WHERE ecg_id IN (SELECT doc_id FROM documents)""")
def chosen_examples(spark, d):
    g = _grid(spark, d).select("ecg_id", "superclass", "label")
    return S.chosen_examples(g, B.table(spark, d, "documents").select(F.col("doc_id").alias("ecg_id")))


@query("""SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) GROUP BY d.doc_id""")
def shared_ids(spark, d):
    return C.overlap(B.table(spark, d, "documents"), B.table(spark, d, "labels"), "doc_id").select("doc_id")


_CYCLE = """c AS (SELECT o_orderkey AS ecg_id, o_custkey % 50 AS g, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey % 50) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY md5(o_orderkey::VARCHAR || '_7'), o_orderkey)),
    donors AS (SELECT a.ecg_id, b.ecg_id AS donor FROM c a JOIN c b ON a.g = b.g AND b.rn = a.rn % a.n + 1 WHERE a.n > 1)"""


@query(f""", {_CYCLE} SELECT d.ecg_id, 'the donor''s embedding is its own' AS why FROM donors d JOIN orders a ON a.o_orderkey = d.ecg_id JOIN orders b ON b.o_orderkey = donor WHERE a.o_orderpriority || a.o_orderstatus = b.o_orderpriority || b.o_orderstatus""")
def donor_problems(spark, d):
    """Donors whose data equal their taker's; a record's data are here its priority and status."""
    donors = S.derangement(B.records(spark, d), "ecg_id", F.col("patient") % 50).where("donor IS NOT NULL").select("ecg_id", "donor")
    data = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat("o_orderpriority", "o_orderstatus").alias("data"))
    own = donors.join(data.toDF("ecg_id", "own"), "ecg_id").join(data.toDF("donor", "given"), "donor")
    return C.derangement_problems(own)


_FAST = """g AS (SELECT *, unnest(['overall', superclass, CASE WHEN superclass = 'en' THEN 'normal' ELSE 'abnormal' END]) AS grp FROM evals), c AS (SELECT grp, count(*) AS n, count(*) FILTER (label) AS pos, count(*) FILTER (p_yes >= 0.5) AS pp, count(*) FILTER (label AND p_yes >= 0.5) AS tp, round(avg(loss), 6) AS mean_loss FROM g GROUP BY grp),
    d AS (SELECT grp, p_yes, count(*) FILTER (label) AS y, count(*) AS k FROM g GROUP BY grp, p_yes), u AS (SELECT *, sum(y) OVER w AS tp, sum(k) OVER w AS taken, sum(y) OVER (PARTITION BY grp) AS P, sum(k) OVER (PARTITION BY grp) AS n FROM d WINDOW w AS (PARTITION BY grp ORDER BY p_yes DESC)),
    r AS (SELECT grp, round(sum(y * (n - P - (taken - tp) + (k - y) / 2.0)) / any_value(P) / any_value(n - P), 6)::DOUBLE AS auroc, round(sum(y * tp / taken) / any_value(P), 6)::DOUBLE AS auprc FROM u GROUP BY grp), b AS (SELECT grp, p_yes, round(2 * tp / (taken + P), 9) AS f1 FROM u QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(2 * tp / (taken + P), 9) DESC, p_yes DESC) = 1)"""


@query(f""", {_FAST} SELECT c.grp, c.n, pos AS n_positive, pp AS n_predicted, round(tp / pp, 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (pp + pos), 6) AS f1, auroc, auprc, b.p_yes AS threshold, round(b.f1, 6) AS best_f1, mean_loss FROM c JOIN r USING (grp) JOIN b USING (grp)""")
def fast_blocks(spark, d):
    return E.fast_block(E.with_groups(B.evaluations(spark, d), "en"), "grp")


_TOLD = "Step 2: As the required answer is Yes, this fits."


def _told(spark, d) -> DataFrame:
    """Responses of two blocks around each text, the first without a conclusion; every third one's second step tells the answer."""
    first = F.concat(F.lit("### NORM\nEvidence: 1) as said.\nReasoning:\nStep 1: "), F.translate("text", "\n", " "), F.when(F.col("doc_id") % 3 == 0, f"\n{_TOLD}").otherwise(""), F.lit("\n<END>\n"))
    second = F.concat(F.lit("### MI\nEvidence: "), F.translate("text", "\n", " "), F.lit("\nReasoning:\nStep 1: plain.\nConclusion: No.\n<END>"))
    return B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(first, second).alias("response"))


@query(f"""SELECT doc_id, regexp_replace(r, '(?m)^Step [0-9]+: [^\n]*required answer[^\n]*\n', '') AS content, regexp_matches(r, 'required answer')::INTEGER AS steps_removed FROM (SELECT doc_id, '### NORM' || chr(10) || 'Evidence: 1) as said.' || chr(10) || 'Reasoning:' || chr(10) || 'Step 1: ' || translate(text, chr(10), ' ')
    || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '{_TOLD}' ELSE '' END || chr(10) || '<END>' || chr(10) || '### MI' || chr(10) || 'Evidence: ' || translate(text, chr(10), ' ') || chr(10) || 'Reasoning:' || chr(10) || 'Step 1: plain.' || chr(10) || 'Conclusion: No.' || chr(10) || '<END>' AS r FROM documents WHERE text IS NOT NULL)""")
def stripped_responses(spark, d):
    return _told(spark, d).select("doc_id", T.stripped_response(F.col("response")).alias("s")).select("doc_id", "s.content", "s.steps_removed")


@query()
def probe_variants(spark, d):
    """One-vs-rest probes of all ten classes over three forms of the vectors, taught by folds 0 to 7, measured on the others; no SQL form."""
    v = B.table(spark, d, "embeddings").select("embedding", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("label") == k).alias("truth"), (F.col("vec_id") % 10 < 8).alias("teaches"))
    out = P.probe_report(v.where("teaches"), v.where("NOT teaches"), 10)
    return out.select("form", "class", "n_train", "n_test", _r("fit_loss"), _r("gradient_norm", 3), "converged", "auprc", "auroc", _r("positive_rate"), _r("lift"))
