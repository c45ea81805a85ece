"""Queries over runs' settings, whole prompts, views, audits of responses and readouts, each beside the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import prompts as W
from lumenframe.functions import text as T
from lumenframe.functions import tokens as K
from lumenframe.operators import checks as C
from lumenframe.operators import labels as L
from lumenframe.operators import manifest as M
from lumenframe.operators import metrics as E
from lumenframe.operators import responses as P
from lumenframe.operators import sampling as S
from lumenframe.plans.registry import query
from lumenframe.sources import files as X
from lumenframe.sources import runs as U
from lumenframe.sources import tables as B
from lumenframe.streaming import ingest as I

# --- settings of runs ---------------------------------------------------------------------------------------------

#: What a run did before its settings were recorded.
BEFORE = {"strip_think": "false", "task_stream": "prompt", "lambda_llm": "1.0", "lambda_linear": "0.0", "lambda_consistency": "0.0"}
LAMBDAS = {"lambda_llm", "lambda_linear", "lambda_consistency"}

_RUNS = """k AS (SELECT 'nation-' || n_nationkey AS run, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
    runs AS (SELECT run, CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS strip_think, CASE k % 4 WHEN 0 THEN 'prompt' WHEN 1 THEN 'question' WHEN 2 THEN 'none' END AS task_stream,
    '1.0' AS lambda_llm, CASE WHEN k % 5 > 0 THEN '0.' || k % 5 END AS lambda_linear, CASE WHEN k % 2 = 0 THEN '0.5' END AS lambda_consistency FROM k)"""


def _setting_sql(name: str, known: str, fatal: bool = False, wanted: str | None = None) -> str:
    had = f"coalesce({name}, '{BEFORE[name]}')"
    value = f"'{wanted}'" if wanted else had
    return f"SELECT run, '{name}' AS setting, {value} AS value, {had} AS recorded, {known} AS was_recorded, {value} <> {had} AS mismatch, {fatal} AND {value} <> {had} AS refused FROM runs"


_ALL = "lambda_llm IS NOT NULL AND lambda_linear IS NOT NULL AND lambda_consistency IS NOT NULL"


@query(
    f", {_RUNS} "
    + " UNION ALL ".join([_setting_sql("strip_think", "strip_think IS NOT NULL", True, "true"), _setting_sql("task_stream", "task_stream IS NOT NULL", False, "prompt"), *[_setting_sql(n, _ALL) for n in sorted(LAMBDAS)]])
)
def settled_runs(spark, d):
    """A run a nation, its settings from its customers' number, written beside its customers' rows and read back without those."""
    c = B.table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    k = B.table(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("k"))
    k, n = k.withColumn("run", F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"))), F.col("k")
    runs = k.select(
        "run", F.when(n % 3 == 0, "true").when(n % 3 == 1, "false").alias("strip_think"), F.when(n % 4 == 0, "prompt").when(n % 4 == 1, "question").when(n % 4 == 2, "none").alias("task_stream"),
        F.lit("1.0").alias("lambda_llm"), F.when(n % 5 > 0, F.concat(F.lit("0."), (n % 5).cast("string"))).alias("lambda_linear"), F.when(n % 2 == 0, "0.5").alias("lambda_consistency"),
    )
    root = I.shared_folder(spark)
    U.write_settings(runs, root)
    c.withColumn("run", F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"))).write.mode("append").partitionBy("run").parquet(root)  # the outputs that the scan must not open
    return U.settled(U.run_settings(spark, root, *BEFORE), {"strip_think": "true", "task_stream": "prompt"}, BEFORE, fatal={"strip_think"}, together=(LAMBDAS,))


# --- records, views and prompts -----------------------------------------------------------------------------------


@query("SELECT strat_fold, count(*) AS n FROM records GROUP BY strat_fold")
def records_per_fold(spark, d):
    return M.records_per_fold(B.records(spark, d))


@query("""SELECT f AS strat_fold, count(ecg_id) AS records, count(ecg_id) FILTER (validated) AS validated, round(CASE WHEN count(ecg_id) > 0 THEN 100.0 * count(ecg_id) FILTER (validated) / count(ecg_id) END, 2)::DOUBLE AS percent
    FROM (SELECT unnest(range(1, 11)) AS f) LEFT JOIN (SELECT * FROM records WHERE strat_fold <> 7) ON f = strat_fold GROUP BY f""")
def validated_by_fold(spark, d):
    """Fold 7 left out, so that one fold has no records."""
    return M.validated_by_fold(B.records(spark, d).where("strat_fold <> 7"))


@query("""SELECT v AS validated, g AS generated, count(o_orderkey) AS n FROM (SELECT unnest([true, false]) AS v), (SELECT unnest([true, false]) AS g)
    LEFT JOIN orders ON (o_orderstatus = 'F') = v AND (o_orderpriority = '1-URGENT') = g GROUP BY v, g""")
def validation_table(spark, d):
    o = B.table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("validated"), (F.col("o_orderpriority") == "1-URGENT").alias("generated"))
    return M.validation_table(o, "validated", "generated")


_NORMAL = """f AS (SELECT r.ecg_id, coalesce(count(DISTINCT s.class) = 1 AND bool_and(s.class = 'NORM'), false) AS only_norm, coalesce(count(DISTINCT s.class) FILTER (s.diagnostic) = 1 AND bool_and(s.class = 'NORM') FILTER (s.diagnostic), false) AS diagnostic_norm,
    coalesce(count(DISTINCT s.class) FILTER (s.diagnostic AND s.likelihood > 0) = 1 AND bool_and(s.class = 'NORM') FILTER (s.diagnostic AND s.likelihood > 0), false) AS likely_norm FROM records r LEFT JOIN statements s USING (ecg_id) GROUP BY r.ecg_id)"""


@query(f", {_NORMAL} " + " UNION ALL ".join(f"SELECT '{n}' AS definition, count(*) FILTER ({n}) AS n, round(100.0 * count(*) FILTER ({n}) / 21799, 2)::DOUBLE AS percent FROM f" for n in ("only_norm", "diagnostic_norm", "likely_norm")))
def normality_shares(spark, d):
    return M.normality_shares(B.manifest(spark, d), 21799)


@query("""SELECT r.ecg_id, coalesce(list_sort(list(DISTINCT class) FILTER (diagnostic AND code % 7 > 0)), [])::VARCHAR AS classes FROM records r LEFT JOIN statements USING (ecg_id) GROUP BY r.ecg_id""")
def record_classes(spark, d):
    """Classes from maps of codes, with a codebook that lacks each seventh code."""
    each = B.statements(spark, d).groupBy("ecg_id", "code").agg(F.max("likelihood").alias("likelihood"))
    maps = each.groupBy("ecg_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "likelihood"))).alias("codes"))
    facts = B.records(spark, d).select("ecg_id").join(maps, "ecg_id", "left")
    found = X.record_classes(facts, "ecg_id", "codes", B.codebook(spark, d).where("code % 7 > 0"))
    return found.select("ecg_id", F.concat(F.lit("["), F.array_join("superclass", ", "), F.lit("]")).alias("classes"))


#: The query's own wording; templates are arguments of the library.
_TEMPLATE = "Answer each question.\n{questions_block}\n---\n{input_block}\n"


@query("""SELECT g.ecg_id, 'Answer each question.' || chr(10) || string_agg('  ' || k || '. ' || superclass || ' - ' || CASE superclass WHEN 'NORM' THEN 'Is this a normal ECG?' WHEN 'MI' THEN 'Does this ECG show evidence of myocardial infarction?' WHEN 'STTC' THEN 'Does this ECG show evidence of ST/T change?'
    WHEN 'CD' THEN 'Does this ECG show evidence of conduction disturbance?' ELSE 'Does this ECG show evidence of hypertrophy?' END || ' Known answer: ' || CASE WHEN label THEN 'Yes' ELSE 'No' END, chr(10) ORDER BY k)
    || chr(10) || '---' || chr(10) || any_value('priority {yes_no} ' || o_orderpriority) || chr(10) AS prompt FROM grid g JOIN orders ON o_orderkey = g.ecg_id GROUP BY g.ecg_id""")
def whole_prompts(spark, d):
    """One prompt a record for all five questions; braces in what is filled in stay as they are."""
    block = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("ecg_id"), F.concat(F.lit("priority {yes_no} "), "o_orderpriority").alias("block"))
    m = B.manifest(spark, d).join(block, "ecg_id")
    return m.select("ecg_id", W.render_all(_TEMPLATE, W.known_answers(L.asserted(F.col("statements"))), F.col("block")).alias("prompt"))


@query("""SELECT o_orderkey AS ecg_id, CASE WHEN length('priority ' || o_orderpriority) >= 15 THEN 'priority ' || o_orderpriority ELSE '' END AS report_text, length('priority ' || o_orderpriority) >= 15 AS has_usable_report, coalesce(s.n, 0)::BIGINT AS n_statements,
    coalesce(s.d, '') AS diagnostic_classes, coalesce(s.w, 0)::BIGINT AS n_words, coalesce(s.l, 0)::DOUBLE AS likelihood, CASE o_orderkey % 3 WHEN 0 THEN 'LAD' END AS heart_axis, CASE o_orderkey % 4 WHEN 0 THEN 'Stadium I|Stadium II' WHEN 1 THEN 'Stadium II' ELSE '' END AS stadium,
    CASE WHEN o_orderkey % 5 = 0 THEN 'baseline drift in all leads|static noise in leads V1' ELSE '' END AS quality, CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 90 END::DOUBLE AS age, CASE o_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex, (o_custkey % 3)::INTEGER AS sex_code
    FROM orders LEFT JOIN (SELECT ecg_id, count(*) AS n, sum(likelihood) AS l, sum(diagnostic::INT + form::INT + rhythm::INT) AS w, string_agg(class, '|' ORDER BY class) FILTER (diagnostic) AS d FROM statements GROUP BY ecg_id) s ON s.ecg_id = o_orderkey""")
def record_views(spark, d):
    key, patient = F.col("ecg_id"), F.col("patient")
    more = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("ecg_id"), F.concat(F.lit("priority "), "o_orderpriority").alias("report"))
    m = B.manifest(spark, d).join(more, "ecg_id")
    view = W.record_view(
        key, F.col("report"), F.col("statements"), F.when(key % 3 == 0, " LAD ").otherwise(" "), [F.when(key % 4 == 0, " Stadium I").when(key % 4 == 1, "unknown"), F.when(key % 4 <= 1, "Stadium II")],
        {"baseline_drift": F.when(key % 5 == 0, "alles"), "static_noise": F.when(key % 5 == 0, " , V1 ")}, F.when(patient % 11 > 0, patient % 90), patient % 3,
    )
    v = m.select(view.alias("v")).select("v.*")
    classes = F.array_sort(F.array_compact(F.transform("statements", lambda s: s["diagnostic_superclass"])))
    words = F.aggregate("statements", F.lit(0).cast("long"), lambda t, s: t + F.size(s["classes"]))
    total = F.aggregate("statements", F.lit(0.0), lambda t, s: t + s["likelihood"])
    return v.select(
        "ecg_id", "report_text", "has_usable_report", F.size("statements").cast("long").alias("n_statements"), F.array_join(classes, "|").alias("diagnostic_classes"), words.alias("n_words"), total.alias("likelihood"),
        "heart_axis", F.array_join("infarction_stadium", "|").alias("stadium"), F.array_join("signal_quality", "|").alias("quality"), "age", "sex", "sex_code",
    )


# --- responses around documents' texts ------------------------------------------------------------------------------

_SAID = """t AS (SELECT doc_id, translate(coalesce(text, ''), chr(10) || chr(13), '  ') AS x, n_chars FROM documents),
    said AS (SELECT doc_id, n_chars, '### NORM' || chr(10) || 'Evidence: 1) ' || x || chr(10) || 'Reasoning:' || chr(10) || 'Step 1: plain.' || chr(10) || 'Conclusion: ' || CASE WHEN contains(x, ' the ') THEN 'Yes' ELSE 'No' END || ', so.' || chr(10) || '<END>' || chr(10)
    || '### MI' || chr(10) || 'Evidence: 1) rate.' || chr(10) || 'Reasoning:' || chr(10) || 'Step 1: ' || x || chr(10) || 'Conclusion: No, none.' || chr(10) || '<END>' || chr(10)
    || '### STTC' || chr(10) || 'Evidence: 1) rate.' || chr(10) || 'Reasoning:' || chr(10) || 'Step 1: plain.' || chr(10) || 'Conclusion: ' || CASE WHEN contains(x, 'q') THEN 'Maybe' ELSE 'Yes' END || chr(10) || '<END>' || chr(10)
    || CASE WHEN length(x) % 2 = 0 THEN '### CD' || chr(10) || 'Evidence: 1) lead type.' || chr(10) || 'Reasoning:' || chr(10) || 'Step 1: plain.' || chr(10) || 'Conclusion: No' || chr(10) || '<END>' || chr(10) ELSE '' END
    || '### HYP' || chr(10) || 'Evidence: 1) ' || CASE WHEN contains(x, 'z') THEN 'as annotated' ELSE 'rate' END || chr(10) || 'Reasoning:' || chr(10) || CASE WHEN contains(x, 'x') THEN '' ELSE 'Step 1: plain.' || chr(10) END || 'Conclusion: Yes' || chr(10) || '<END>' || chr(10) AS r FROM t),
    cut AS (SELECT doc_id, n_chars, split_part(b, chr(10), 1) AS superclass, substr(b, strpos(b, chr(10))) AS body FROM (SELECT doc_id, n_chars, unnest(string_split(chr(10) || r, chr(10) || '### ')[2:]) AS b FROM said)),
    parts AS (SELECT *, CASE lower(regexp_extract(body, '(?im)^[ \t>*#-]*conclusion\\b[ \t:*-]*(yes|no)\\b', 1)) WHEN 'yes' THEN true WHEN 'no' THEN false END AS conclusion, trim(regexp_extract(body, '(?is)\\breasoning\\b[ \t:*-]*(.*?)(?:\\bconclusion\\b|<\\s*END\\s*>|\\z)', 1), chr(10) || ' ' || chr(9)) AS reasoning,
    trim(regexp_extract(body, '(?is)\\bevidence\\b[ \t:*-]*(.*?)(?:\\breasoning\\b|\\bconclusion\\b|\\z)', 1), chr(10) || ' ' || chr(9)) AS evidence, trim(regexp_replace(regexp_extract(body, '(?is)\\bconclusion\\b[ \t:*-]*(.*)\\z', 1), '(?i)<\\s*END\\s*>', '', 'g'), chr(10) || ' ' || chr(9)) AS told FROM cut),
    known AS (SELECT doc_id, unnest(['NORM', 'MI', 'STTC', 'CD', 'HYP']) AS superclass, unnest([quality = 1, toxic = 1, quality = 1, toxic = 1, quality = 1]) AS label FROM labels)"""


def _said(spark, d) -> DataFrame:
    """A response around each document's text: its answers, a block left out, a blank reasoning and a cited annotation depend on what the text holds."""
    x = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    block = lambda name, evidence, reasoning, told: F.concat(F.lit(f"### {name}\nEvidence: 1) "), evidence, F.lit("\nReasoning:\n"), reasoning, F.lit("Conclusion: "), told, F.lit("\n<END>\n"))
    plain, rate = F.lit("Step 1: plain.\n"), F.lit("rate.")
    whole = F.concat(
        block("NORM", x, plain, F.concat(F.when(F.contains(x, F.lit(" the ")), "Yes").otherwise("No"), F.lit(", so."))),
        block("MI", rate, F.concat(F.lit("Step 1: "), x, F.lit("\n")), F.lit("No, none.")),
        block("STTC", rate, plain, F.when(F.contains(x, F.lit("q")), "Maybe").otherwise("Yes")),
        F.when(F.length(x) % 2 == 0, block("CD", F.lit("lead type."), plain, F.lit("No"))).otherwise(""),
        block("HYP", F.when(F.contains(x, F.lit("z")), "as annotated").otherwise("rate"), F.when(F.contains(x, F.lit("x")), "").otherwise(plain), F.lit("Yes")),
    )
    return B.table(spark, d, "documents").select(F.col("doc_id").alias("ecg_id"), F.col("n_chars").alias("n_tokens"), whole.alias("content"))


def _known(spark, d) -> DataFrame:
    answers = {"NORM": "quality", "MI": "toxic", "STTC": "quality", "CD": "toxic", "HYP": "quality"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("superclass"), (F.col(v) == 1).alias("label")) for k, v in answers.items()]))
    return B.table(spark, d, "labels").select(F.col("doc_id").alias("ecg_id"), each.alias("a")).select("ecg_id", "a.*")


@query(f", {_SAID} SELECT doc_id AS ecg_id, superclass FROM parts JOIN known USING (doc_id, superclass) WHERE conclusion <> label")
def label_mismatches(spark, d):
    return P.label_mismatches(_said(spark, d).select("ecg_id", "content"), _known(spark, d))


@query(f""", {_SAID}, each AS (SELECT doc_id, superclass, unnest(['evidence', 'reasoning', 'conclusion']) AS section, unnest([evidence, reasoning, told]) AS s FROM parts), lines AS (SELECT doc_id, superclass, section, unnest(string_split(s, chr(10))) AS line FROM each),
    hit AS (SELECT *, unnest(list_filter({T.LEAKS!r}, lambda p: contains(lower(line), p))) AS pattern FROM lines) SELECT section, pattern, count(*) AS hits, count(DISTINCT (doc_id, superclass)) AS blocks, count(DISTINCT doc_id) AS records FROM hit GROUP BY section, pattern""")
def leaked_sections(spark, d):
    found = P.leaks(_said(spark, d).select("ecg_id", "content"))
    return found.groupBy("section", "pattern").agg(F.count("*").alias("hits"), F.count_distinct("ecg_id", "superclass").alias("blocks"), F.count_distinct("ecg_id").alias("records"))


_HITS = " + ".join(f"regexp_matches(body, '(?i){p}')::INT" for p in T.AUDIT.values())


@query(f""", {_SAID}, b AS (SELECT p.*, {_HITS} AS hits, conclusion <> label AS wrong, contains(lower(body), 'lead type') AS lead FROM parts p LEFT JOIN known USING (doc_id, superclass)),
    r AS (SELECT doc_id, count(*) AS b, count(*) FILTER (reasoning = '') AS e, count(*) FILTER (hits > 0) AS h, count(*) FILTER (lead) AS t, coalesce(bool_or(wrong), false) AS w, count(conclusion) AS c, any_value(n_chars) AS n FROM b GROUP BY doc_id)
    SELECT count(*) AS records, sum(b)::BIGINT AS blocks, count(*) * 5 AS expected_blocks, count(*) FILTER (w) AS mismatched_records, count(*) FILTER (c < 5) AS failed_records, sum(e)::BIGINT AS empty_reasonings, round(avg(n), 6) AS mean_tokens, sum(h)::BIGINT AS hit_blocks, count(*) FILTER (h > 0) AS hit_records,
    sum(t)::BIGINT AS lead_type_blocks, round(100.0 * sum(h) / sum(b), 1)::DOUBLE AS hit_block_percent, round(100.0 * count(*) FILTER (h > 0) / count(*), 1)::DOUBLE AS hit_record_percent FROM r""")
def audit_totals(spark, d):
    return P.audit_totals(_said(spark, d), _known(spark, d))


@query(f", {_SAID} SELECT superclass, count(*) AS n FROM parts WHERE conclusion GROUP BY superclass")
def yes_counts(spark, d):
    return P.yes_counts(_said(spark, d).select("ecg_id", "content"))


@query("""SELECT n, n AS n_unique, 0::BIGINT AS n_repeated, absent AS n_regenerated_absent, failed AS failed_blocks, failed AS failed_records, e AS empty_blocks, e AS empty_records, k AS leaking_blocks, k AS leaking_records, w AS mismatched_blocks, w AS mismatched_records
    FROM (SELECT count(*) AS n FROM documents), (SELECT count(*) AS absent FROM (SELECT DISTINCT doc_id + 1 AS i FROM labels WHERE toxic = 1) WHERE i NOT IN (SELECT doc_id FROM documents)),
    (SELECT count(*) FILTER (parsed IS NULL) AS failed, count(*) FILTER (trim(coalesce(text[1:1], '')) = '') AS e, count(*) FILTER (contains(text, 'annotat')) AS k, count(*) FILTER (parsed <> label) AS w FROM evals JOIN documents ON doc_id = ecg_id)""")
def final_counts(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("ecg_id"), "text")
    regenerated = B.table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id") + 1).alias("ecg_id"))
    leaks = F.filter(F.array(F.lit("annotat")), lambda p: F.contains(F.coalesce("text", F.lit("")), p))
    blocks = B.evaluations(spark, d).join(docs, "ecg_id").select("ecg_id", F.col("parsed").alias("conclusion"), F.left("text", F.lit(1)).alias("reasoning"), leaks.alias("leaks"), (F.col("parsed") != F.col("label")).alias("mismatch"))
    return C.final_counts(docs, regenerated, blocks)


# --- readouts and draws ---------------------------------------------------------------------------------------------

_SCORES = """sc AS (SELECT ecg_id, superclass, label, unnest(['fast', 'parsed', 'linear']) AS readout, unnest([p_yes, CASE WHEN parsed THEN 1.0 WHEN NOT parsed THEN 0.0 END, (n_tokens % 101) / 100.0::DOUBLE]) AS p FROM evals),
    full_ AS (SELECT * FROM sc WHERE (ecg_id, superclass) IN (SELECT (ecg_id, superclass) FROM sc WHERE p IS NOT NULL GROUP BY ALL HAVING count(*) = 3))"""


def _scores(spark, d) -> DataFrame:
    pair = lambda n, c: F.struct(F.lit(n).alias("readout"), c.cast("double").alias("p_yes"))
    kinds = F.array(pair("fast", F.col("p_yes")), pair("parsed", F.col("parsed").cast("int")), pair("linear", (F.col("n_tokens") % 101) / 100))
    return B.evaluations(spark, d).select("ecg_id", "superclass", "label", F.explode(kinds).alias("x")).select("ecg_id", "superclass", "label", "x.*")


def _rank_sql(rows: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"""SELECT {k}, sum(k)::BIGINT AS n, round(sum(y * (n - pos - (taken - tp) + (k - y) / 2.0)) / any_value(pos) / any_value(n - pos), 6)::DOUBLE AS auroc, round(sum(y * tp / taken) / any_value(pos), 6)::DOUBLE AS auprc FROM (
    SELECT *, sum(y) OVER w AS tp, sum(k) OVER w AS taken, sum(y) OVER (PARTITION BY {k}) AS pos, sum(k) OVER (PARTITION BY {k}) AS n FROM (SELECT {k}, p, count(*) FILTER (label) AS y, count(*) AS k FROM {rows} WHERE p IS NOT NULL GROUP BY {k}, p) WINDOW w AS (PARTITION BY {k} ORDER BY p DESC)) GROUP BY {k}"""


@query(f""", {_SCORES}, q AS ({_rank_sql('full_', 'readout')}), g AS (SELECT a.readout, round(avg(abs(a.p - b.p)), 6) AS gap_to_last FROM full_ a JOIN full_ b USING (ecg_id, superclass) WHERE b.readout = 'linear' GROUP BY a.readout)
    SELECT readout, n, auprc, auroc, gap_to_last FROM q JOIN g USING (readout)""")
def readout_comparison(spark, d):
    return E.readout_table(_scores(spark, d), "linear", "ecg_id", "superclass")


@query(f""", {_SCORES}, l AS ({_rank_sql("(SELECT * FROM sc WHERE readout = 'fast')", 'superclass')}), r AS ({_rank_sql("(SELECT * FROM sc WHERE readout = 'linear')", 'superclass')})
    SELECT superclass, l.auprc AS left_auprc, l.auroc AS left_auroc, r.auprc AS right_auprc, r.auroc AS right_auroc, round(l.auprc - r.auprc, 6) AS auprc_gap FROM l JOIN r USING (superclass)""")
def metric_gaps(spark, d):
    s = _scores(spark, d)
    return E.metric_gaps(E.ranking(s.where("readout = 'fast'"), "superclass"), E.ranking(s.where("readout = 'linear'"), "superclass"), "superclass")


@query("""SELECT superclass, count(*) FILTER (label) AS yes, count(*) FILTER (NOT label) AS no, count(DISTINCT ecg_id) AS records FROM (SELECT * FROM grid ORDER BY ecg_id, superclass LIMIT 1003) GROUP BY superclass""")
def first_selection(spark, d):
    g = L.label_rows(L.class_labels(B.records(spark, d), B.statements(spark, d)))
    return S.selection_record(S.first_examples(g, 1003, "ecg_id", "superclass"))


@query("SELECT doc_id, mode, ids::BIGINT AS ids, open::BIGINT AS open FROM (SELECT doc_id, " + f"unnest({list(K.MODES)!r}) AS mode, unnest([n, n, q, 0]) AS ids, unnest([p, n, q, 0]) AS open " + "FROM (SELECT doc_id, least(length(text), 12) AS n, least(length(text), 5) AS p, least(length(text), 3) AS q FROM documents WHERE text IS NOT NULL))")
def task_streams(spark, d):
    """Which ids each mode reads, and how many of them are open; ids are a text's first twelve characters, the first five the prompt, the first three the question."""
    docs = B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split(F.substring("text", 1, 12), ""), lambda c: F.ascii(c).cast("long")).alias("ids"))
    ids, ones = F.col("ids"), F.transform("ids", lambda _: F.lit(1))
    labels = F.transform(ids, lambda x, i: F.when(i < 5, F.lit(K.IGNORED).cast("long")).otherwise(x))
    first = F.slice(ids, 1, 3)
    each = []
    for mode in K.MODES:
        read, open_ = K.task_stream(mode, ids, ones, labels, first, F.transform(first, lambda _: F.lit(1)))
        each.append(F.struct(F.lit(mode).alias("mode"), F.size(read).cast("long").alias("ids"), F.size(F.filter(open_, lambda x: x)).cast("long").alias("open")))
    return docs.select("doc_id", F.explode(F.array(*each)).alias("m")).select("doc_id", "m.*")
