"""Offline evaluation of the recommendations (relevant = same label), baselines, ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions.vector import l2_normalize
from matchspark.operators import evaluate as ev
from matchspark.operators.cascade import cascade, round1
from matchspark.operators.relevance import relevant_pairs
from matchspark.operators.sparse import sparse_top_k, term_weights
from matchspark.plans.catalog import register
from matchspark.plans.q_search import active_job_df, main_cv_df
from matchspark.plans.sqlparts import cascade_ctes, cos, dot, present, with_views
from matchspark.session import checkpointed
from matchspark.sources.tables import read_table

KS = [5, 10]


def _r(c):
    return F.round(c, 6)


def first_round(spark, sf):
    """The candidates that several cascades share, searched once."""
    return checkpointed(round1(main_cv_df(spark, sf), active_job_df(spark, sf), 50))


def labelled_recs(spark, sf, rounds: int = 3, candidates=None):
    cvs, jobs = main_cv_df(spark, sf), active_job_df(spark, sf)
    recs = cascade(cvs, jobs, k1=50, k2=20, k3=10, rounds=rounds, candidates=candidates)
    return (recs.join(cvs.select("cv_id", F.col("label").alias("cv_label")), "cv_id")
            .join(jobs.select("job_id", F.col("label").alias("job_label")), "job_id")
            .withColumn("rel", F.col("cv_label") == F.col("job_label")))


def relevant_counts(spark, sf):
    """Relevant jobs per CV = active jobs with the CV's label (count per label, joined by label)."""
    cvs, jobs = main_cv_df(spark, sf), active_job_df(spark, sf)
    per_label = jobs.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    return cvs.select("cv_id", "label").join(per_label, "label", "left").select(
        "cv_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def per_query(spark, sf, rounds: int = 3, candidates=None):
    return ev.per_query(labelled_recs(spark, sf, rounds, candidates), "cv_id", "rank", "rel", relevant_counts(spark, sf), KS)


def _recs_sql(rounds: int = 3) -> str:
    src = {1: "SELECT q_id, i_id, rnk AS rank FROM r1 WHERE rnk <= 10",
           2: "SELECT q_id, i_id, rnk2 AS rank FROM r2 WHERE rnk2 <= 10",
           3: "SELECT q_id, i_id, rnk3 AS rank FROM r3"}[rounds]
    return f"""recs{rounds} AS (
  SELECT x.q_id AS cv_id, x.i_id AS job_id, x.rank, (c.label = j.label) AS rel
  FROM ({src}) x JOIN main_cv c ON c.cv_id = x.q_id JOIN active_job j ON j.job_id = x.i_id)"""


NREL = """nrel AS (
  SELECT c.cv_id, count(j.job_id) AS n_relevant FROM main_cv c LEFT JOIN active_job j ON j.label = c.label
  GROUP BY c.cv_id)"""


def _pq_sql(rounds: int = 3) -> str:
    cols = []
    for k in KS:
        cols += [
            f"sum(CASE WHEN rel AND rank <= {k} THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg_{k}",
            f"sum(CASE WHEN rel AND rank <= {k} THEN 1 ELSE 0 END) AS hits_{k}",
            f"sum(CASE WHEN rel AND rank <= {k} THEN 1.0 / rank ELSE 0 END) AS wsum_{k}",
        ]
    idcg = {k: (f"coalesce(list_sum(list_transform(generate_series(1, least(n.n_relevant, {k})), "
                f"lambda i: 1.0 / log2(i + 1))), 0)") for k in KS}
    extra = []
    for k in KS:
        extra += [
            f"CASE WHEN {idcg[k]} > 0 THEN a.dcg_{k} / {idcg[k]} ELSE 0 END AS ndcg_{k}",
            f"a.hits_{k} / {float(k)} AS prec_{k}",
            f"CASE WHEN n.n_relevant > 0 THEN a.hits_{k} / n.n_relevant ELSE 0 END AS rec_{k}",
        ]
    return f"""pq{rounds} AS (
  SELECT a.*, coalesce(n.n_relevant, 0) AS n_relevant, {", ".join(extra)}
  FROM (SELECT cv_id, min(CASE WHEN rel THEN rank END) AS first_rel, {", ".join(cols)}
        FROM recs{rounds} GROUP BY cv_id) a LEFT JOIN nrel n ON n.cv_id = a.cv_id)"""


def _base(rounds=(3,)) -> str:
    parts = cascade_ctes(50, 20, 10) + [NREL]
    for r in rounds:
        parts += [_recs_sql(r), _pq_sql(r)]
    return with_views(*parts)


@register("mrr", _base() + """
SELECT count(*) AS queries, round(avg(coalesce(1.0 / first_rel, 0)), 6) AS mrr FROM pq3""")
def q_mrr(spark, sf):
    m = ev.mrr(per_query(spark, sf))
    return m.select("queries", _r("mrr").alias("mrr"))


def _k_union(expr_by_k: dict) -> str:
    return "\nUNION ALL\n".join(f"SELECT {k} AS k, {e} FROM pq3" for k, e in expr_by_k.items())


@register("ndcg_at_k", _base() + _k_union({k: f"round(avg(ndcg_{k}), 6) AS ndcg" for k in KS}))
def q_ndcg(spark, sf):
    return ev.at_k(per_query(spark, sf), KS, {"ndcg": lambda k: _r(F.avg(f"ndcg_{k}"))})


@register("hit_rate_at_k", _base() + _k_union(
    {k: f"round(avg(CASE WHEN hits_{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate" for k in KS}))
def q_hit_rate(spark, sf):
    return ev.at_k(per_query(spark, sf), KS,
                   {"hit_rate": lambda k: _r(F.avg(F.when(F.col(f"hits_{k}") > 0, 1.0).otherwise(0.0)))})


@register("precision_recall_f1", _base() + _k_union({k: (
    f"round(avg(prec_{k}), 6) AS precision_at_k, round(avg(rec_{k}), 6) AS recall_at_k, "
    f"round(avg(CASE WHEN prec_{k} + rec_{k} > 0 THEN 2 * prec_{k} * rec_{k} / (prec_{k} + rec_{k}) "
    f"ELSE 0 END), 6) AS f1_at_k") for k in KS}))
def q_precision_recall(spark, sf):
    return ev.at_k(per_query(spark, sf), KS, {
        "precision_at_k": lambda k: _r(F.avg(f"prec_{k}")),
        "recall_at_k": lambda k: _r(F.avg(f"rec_{k}")),
        "f1_at_k": lambda k: _r(F.avg(f"f1_{k}"))})


@register("pass_at_k_weighted", _base() + _k_union({k: (
    f"round(avg(CASE WHEN hits_{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_at_k, "
    f"round(avg(wsum_{k}), 6) AS weighted_at_k") for k in KS}))
def q_pass_weighted(spark, sf):
    return ev.at_k(per_query(spark, sf), KS, {
        "pass_at_k": lambda k: _r(F.avg(F.when(F.col(f"hits_{k}") > 0, 1.0).otherwise(0.0))),
        "weighted_at_k": lambda k: _r(F.avg(f"wsum_{k}"))})


@register("ablation_rounds", _base((1, 2, 3)) + "\nUNION ALL\n".join(
    f"SELECT {r} AS rounds, round(avg(coalesce(1.0 / first_rel, 0)), 6) AS mrr, "
    f"round(avg(ndcg_10), 6) AS ndcg_at_10, "
    f"round(avg(CASE WHEN hits_10 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_10 FROM pq{r}" for r in (1, 2, 3)))
def q_ablation(spark, sf):
    """Cascade stopped after round 1, 2 or 3 (top 10 each): MRR, NDCG@10, HR@10."""
    out, candidates = None, first_round(spark, sf)
    for r in (1, 2, 3):
        pq = per_query(spark, sf, rounds=r, candidates=candidates)
        row = pq.agg(_r(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rel"), F.lit(0.0)))).alias("mrr"),
                     _r(F.avg("ndcg_10")).alias("ndcg_at_10"),
                     _r(F.avg(F.when(F.col("hits_10") > 0, 1.0).otherwise(0.0))).alias("hit_rate_at_10")
                     ).select(F.lit(r).alias("rounds"), "mrr", "ndcg_at_10", "hit_rate_at_10")
        out = row if out is None else out.unionByName(row)
    return out


@register("coverage", _base() + """
SELECT (SELECT count(DISTINCT job_id) FROM recs3) AS recommended_items,
       (SELECT count(DISTINCT job_id) FROM active_job) AS corpus_items,
       (SELECT count(DISTINCT job_id) FROM recs3) / (SELECT count(DISTINCT job_id) FROM active_job) AS coverage""")
def q_coverage(spark, sf):
    c = ev.coverage_ratio(labelled_recs(spark, sf), "job_id", active_job_df(spark, sf), "job_id")
    return c.select("recommended_items", "corpus_items", _r("coverage").alias("coverage"))


@register("diversity", _base() + f"""
, u AS (
  SELECT r.cv_id, list_transform(j.title_vec, lambda x: x / sqrt({dot('j.title_vec', 'j.title_vec')})) AS u
  FROM recs3 r JOIN active_job j ON j.job_id = r.job_id),
ux AS (SELECT cv_id, unnest(u) AS x, unnest(generate_series(1, len(u))) AS pos FROM u),
s AS (SELECT cv_id, pos, sum(x) AS s, sum(x * x) AS sq FROM ux GROUP BY cv_id, pos),
per AS (SELECT cv_id, sum(s * s) AS s2, sum(sq) AS sq FROM s GROUP BY cv_id),
m AS (SELECT cv_id, count(*) AS m FROM recs3 GROUP BY cv_id)
SELECT count(*) AS lists, round(avg(1 - (per.s2 - per.sq) / (m.m * (m.m - 1))), 6) AS diversity
FROM per JOIN m ON m.cv_id = per.cv_id WHERE m.m >= 2""".replace("\n, u AS", ",\nu AS", 1))
def q_diversity(spark, sf):
    """Mean intra-list diversity (1 - cosine between job titles) of the final lists."""
    recs = labelled_recs(spark, sf).select("cv_id", "job_id")
    jobs = active_job_df(spark, sf).select("job_id", l2_normalize("title_vec").alias("u"))
    d = ev.diversity(recs.join(jobs, "job_id"), "cv_id", "u")
    return d.select("lists", _r("diversity").alias("diversity"))


@register("ctr_apply_rate", _base() + """
, ev AS (
  SELECT user_id AS cv_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id,
         max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicked,
         max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS applied
  FROM events GROUP BY ALL),
j AS (SELECT r.cv_id, r.job_id, coalesce(e.clicked, 0) AS clicked, coalesce(e.applied, 0) AS applied
      FROM (SELECT DISTINCT cv_id, job_id FROM recs3) r LEFT JOIN ev e ON e.cv_id = r.cv_id AND e.job_id = r.job_id)
SELECT count(*) AS impressions, sum(clicked) AS clicks, sum(applied) AS applies,
       round(sum(clicked) / count(*), 6) AS ctr, round(sum(applied) / count(*), 6) AS apply_rate FROM j"""
          .replace("\n, ev AS", ",\nev AS", 1))
def q_ctr_apply(spark, sf):
    """Interactions on recommended pairs: events (user = CV, props.k = job), click and apply rates."""
    e = read_table(spark, sf, "events", ["user_id", "event_type", "props"]).select(
        F.col("user_id").alias("cv_id"), F.get_json_object("props", "$.k").cast("bigint").alias("job_id"),
        "event_type")
    r = ev.interaction_rates(labelled_recs(spark, sf), e, ["cv_id", "job_id"], "event_type")
    return r.select("impressions", "clicks", "applies", _r("ctr").alias("ctr"), _r("apply_rate").alias("apply_rate"))


# Start of each published version of the lists, and the days that a version takes credit for.
VERSIONS = [(1, "2024-01-03"), (2, "2024-01-12"), (3, "2024-01-26")]
CREDIT_DAYS = 10


@register("ctr_by_version", with_views(*cascade_ctes(50, 20, 10), "lists AS (" + " UNION ALL ".join(
    f"SELECT {v} AS version, q_id AS cv_id, i_id AS job_id FROM {src}" for v, src in ((1, "r1 WHERE rnk <= 10"), (2, "r2 WHERE rnk2 <= 10"), (3, "r3"))) + ")",
    "spans AS (SELECT * FROM (VALUES " + ", ".join(
        f"({v}, TIMESTAMP '{d}', least(TIMESTAMP '{d}' + to_days({CREDIT_DAYS}), TIMESTAMP '{n}'))"
        for (v, d), n in zip(VERSIONS, [x[1] for x in VERSIONS[1:]] + ["9999-01-01"])) + ") AS s(version, a, b))",
    """ev AS (SELECT user_id AS cv_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, ts, event_type FROM events)""",
    """per AS (
  SELECT l.version, l.cv_id, l.job_id, coalesce(max((event_type = 'click')::INT), 0) AS clicked, coalesce(max((event_type = 'purchase')::INT), 0) AS applied
  FROM lists l JOIN spans s USING (version)
  LEFT JOIN ev e ON e.cv_id = l.cv_id AND e.job_id = l.job_id AND e.ts >= s.a AND e.ts < s.b GROUP BY ALL)""") + """
SELECT version, count(*) AS impressions, sum(clicked)::BIGINT AS clicks, sum(applied)::BIGINT AS applies,
       round(avg(clicked), 6) AS ctr, round(avg(applied), 6) AS apply_rate FROM per GROUP BY version""")
def q_ctr_by_version(spark, sf):
    """Three publishes of the lists (after one, two and three rounds): each event counts for the version that was current."""
    cvs, jobs = main_cv_df(spark, sf), active_job_df(spark, sf)
    lists, candidates = None, first_round(spark, sf)
    for v, _ in VERSIONS:
        part = cascade(cvs, jobs, k1=50, k2=20, k3=10, rounds=v, candidates=candidates).select(F.lit(v).alias("version"), "cv_id", "job_id")
        lists = part if lists is None else lists.unionByName(part)
    versions = spark.createDataFrame(VERSIONS, "version int, d string").select("version", F.to_timestamp("d").alias("valid_from"))
    e = read_table(spark, sf, "events", ["user_id", "event_type", "props", "ts"]).select(
        F.col("user_id").alias("cv_id"), F.get_json_object("props", "$.k").cast("bigint").alias("job_id"), "event_type", "ts")
    r = ev.rates_by_version(lists, versions, e, ["cv_id", "job_id"], "ts", "event_type", CREDIT_DAYS)
    return r.select("version", "impressions", "clicks", "applies", _r("ctr").alias("ctr"), _r("apply_rate").alias("apply_rate"))


@register("jaccard_labels", _base() + """
, t AS (
  SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN_]+'),
                                           lambda w: w <> '')) AS ws FROM documents)
SELECT r.cv_id, r.job_id,
       round(CASE WHEN len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)) > 0
                  THEN len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))
                  ELSE 0 END, 6) AS jaccard
FROM recs3 r JOIN t a ON a.doc_id = r.cv_id JOIN t b ON b.doc_id = r.job_id""".replace("\n, t AS", ",\nt AS", 1))
def q_jaccard(spark, sf):
    """Word-set Jaccard of the texts behind each recommended pair (document with the CV's id and
    the document with the job's id), the Jaccard part of the title rule label."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", ev.word_set(F.col("text")).alias("ws"))
    recs = labelled_recs(spark, sf).select("cv_id", "job_id")
    j = (recs.join(docs.select(F.col("doc_id").alias("cv_id"), F.col("ws").alias("a")), "cv_id")
         .join(docs.select(F.col("doc_id").alias("job_id"), F.col("ws").alias("b")), "job_id"))
    return j.select("cv_id", "job_id", _r(ev.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


_HASH = "('0x' || substr(md5('7:' || {q} || ':' || {d}), 1, 15))::BIGINT"


@register("random_baseline", with_views(f"""pos AS (
  SELECT job_id, row_number() OVER (ORDER BY substr(md5(job_id::VARCHAR), 1, 2), job_id) - 1 AS pos FROM active_job)""",
    "jobs_n AS (SELECT count(*) AS n FROM active_job)", f"""draws AS (
  SELECT cv_id, d, CASE WHEN d < 20 THEN {_HASH.format(q='cv_id', d='d')} ELSE {_HASH.format(q='cv_id', d="'0'")} + d END % n AS pos
  FROM main_cv, jobs_n, generate_series(0, 29) AS s(d) WHERE title_vec IS NOT NULL)""",
    "firsts AS (SELECT cv_id, pos, min(d) AS d FROM draws GROUP BY cv_id, pos)", """ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY d) AS INTEGER) AS rank FROM firsts)""") + """
SELECT cv_id, job_id, rank FROM ranked JOIN pos USING (pos) WHERE rank <= 10""")
def q_random_baseline(spark, sf):
    """Random top-10 jobs per main CV (seeded by md5, which both engines share)."""
    cvs, jobs = main_cv_df(spark, sf), active_job_df(spark, sf)
    return ev.random_top_k(cvs.where(F.col("title_vec").isNotNull()), "cv_id", jobs, "job_id", 10)


@register("tfidf_baseline", r"""
WITH t AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN_]+')) AS word FROM documents),
tf AS (SELECT id, word, count(*) AS tf FROM t WHERE word <> '' GROUP BY id, word),
voc AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) AS idf FROM tf GROUP BY word
        HAVING count(*) < (SELECT count(*) FROM documents)),
w AS (SELECT id, word, tf * idf AS w FROM tf JOIN voc USING (word)),
u AS (SELECT id, word, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
s AS (SELECT a.id AS q, b.id AS c, round(sum(a.w * b.w), 9) AS s FROM u a JOIN u b ON a.word = b.word AND a.id <> b.id GROUP BY a.id, b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS INTEGER) AS rank FROM s WHERE s > 0)
SELECT q AS doc_id, c AS similar_doc_id, s AS similarity, rank FROM r WHERE rank <= 10""")
def q_tfidf_baseline(spark, sf):
    """TF-IDF + cosine baseline: top 10 similar documents per document (self excluded), exact, over a fitted vocabulary."""
    weights = term_weights(read_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text")
    return sparse_top_k(weights, 10, "doc_id", "similar_doc_id")


# ---------------------------------------------------------------- rule labels
# Fixed rules (shared with the SQL): a job asks for the part names of its order; a CV lists, by the key of the part, the name, its
# first word or the name without its last letter; names of one colour or size whose things are in a chain of synonyms
# are synonyms; the category of a skill is its last word.
SYNONYM_THINGS = [("ring", "gizmo"), ("gizmo", "widget")]


def _lines(spark, sf):
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_partkey"])
    p = read_table(spark, sf, "part", ["p_partkey", "p_name"])
    return li.join(p, li.l_partkey == p.p_partkey)


def cv_skill(key, name):
    return F.when(key % 3 == 0, name).when(key % 3 == 1, F.split_part(name, F.lit(" "), F.lit(1))).otherwise(F.expr("left(p_name, length(p_name) - 1)"))


def synonym_table(spark, sf):
    names = read_table(spark, sf, "part", ["p_name"]).distinct().select(
        "p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("thing"))
    chain = spark.createDataFrame(SYNONYM_THINGS, "thing string, other string")
    return (names.join(chain, "thing").join(names.select(F.col("p_name").alias("b"), "kind", F.col("thing").alias("other")), ["kind", "other"])
            .select(F.col("p_name").alias("a"), "b"))


def category_table(spark, sf):
    return read_table(spark, sf, "part", ["p_name"]).distinct().select(F.col("p_name").alias("skill"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("category"))


_CHAIN = " OR ".join(f"(a.thing = '{x}' AND b.thing = '{y}')" for x, y in SYNONYM_THINGS)
SKILL_CTES = [
    "names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS kind, split_part(p_name, ' ', 2) AS thing FROM part)",
    f"syn AS (SELECT a.p_name AS a, b.p_name AS b FROM names a JOIN names b ON a.kind = b.kind AND ({_CHAIN}))",
    """reach(a, b) AS (
  SELECT a, b FROM (SELECT a, b FROM syn UNION SELECT b, a FROM syn)
  UNION SELECT r.a, s.b FROM reach r JOIN (SELECT a, b FROM syn UNION SELECT b, a FROM syn) s ON s.a = r.b)""",
    """skl AS (SELECT l_orderkey, lower(p_name) AS job_skill, lower(CASE l_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1)
                ELSE left(p_name, length(p_name) - 1) END) AS cv_skill FROM lineitem JOIN part ON p_partkey = l_partkey)"""]


def _level_sql(c: str, j: str) -> str:
    """Grade of a CV skill and a job skill."""
    return rf"""CASE WHEN {c} = {j} THEN 5 WHEN EXISTS (SELECT 1 FROM reach WHERE reach.a = {c} AND reach.b = {j}) THEN 4
         WHEN (contains({c}, {j}) OR contains({j}, {c})) AND (regexp_matches({c}, '(^|[^\pL\pN_])\Q' || {j} || '\E($|[^\pL\pN_])')
           OR regexp_matches({j}, '(^|[^\pL\pN_])\Q' || {c} || '\E($|[^\pL\pN_])')) THEN 3
         WHEN contains({c}, {j}) OR contains({j}, {c}) THEN 2
         WHEN EXISTS (SELECT 1 FROM names x JOIN names y ON x.thing = y.thing WHERE x.p_name = {c} AND y.p_name = {j}) THEN 1 ELSE 0 END"""


@register("skill_match_levels", "WITH RECURSIVE " + ",\n".join(SKILL_CTES) + f""",
cs AS (SELECT DISTINCT o_custkey AS cv_id, cv_skill FROM skl JOIN orders ON o_orderkey = l_orderkey),
js AS (SELECT DISTINCT l_orderkey AS job_id, job_skill FROM skl),
vocabulary AS (SELECT c.cv_skill, j.job_skill FROM (SELECT DISTINCT cv_skill FROM cs) c, (SELECT DISTINCT job_skill FROM js) j),
grade AS (SELECT cv_skill, job_skill, {_level_sql('cv_skill', 'job_skill')} AS level FROM vocabulary),
per AS (
  SELECT o.o_custkey AS cv_id, o.o_orderkey AS job_id, js.job_skill, coalesce(max(g.level), 0) AS level
  FROM orders o JOIN js ON js.job_id = o.o_orderkey LEFT JOIN cs ON cs.cv_id = o.o_custkey
  LEFT JOIN grade g ON g.cv_skill = cs.cv_skill AND g.job_skill = js.job_skill GROUP BY ALL)
SELECT o_custkey AS cv_id, o_orderkey AS job_id, count(job_skill)::INTEGER AS n_job_skills, coalesce(max(level), 0)::INTEGER AS best_level,
       (count(*) FILTER (WHERE level >= 3))::INTEGER AS n_matched, count(*) FILTER (WHERE level >= 3) > 0 AS skills_match
FROM orders LEFT JOIN per ON per.job_id = o_orderkey GROUP BY ALL""")
def q_skill_match_levels(spark, sf):
    """Skill part of the rule labels for (customer CV, each of its orders as a job), with all five grades: synonyms and categories are
    tables."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    lines = _lines(spark, sf)
    cv = lines.join(o, lines.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("cv_id"), cv_skill(F.col("p_partkey"), F.col("p_name")).alias("skill"))
    pairs = o.select(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("job_id"))
    return ev.skill_match(pairs, cv, lines.select(F.col("l_orderkey").alias("job_id"), F.col("p_name").alias("skill")),
                          synonyms=synonym_table(spark, sf), categories=category_table(spark, sf))


def rule_relevant(spark, sf):
    """Main CVs and active jobs with a title (name and type of the part with their id); the skills of a CV are those of the order
    with its id, a job asks for those of the next order."""
    part = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_type"]).select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    cvs, jobs = main_cv_df(spark, sf), active_job_df(spark, sf)
    cvs = cvs.join(part, cvs.cv_id == part.p_partkey).select("cv_id", "title", "title_vec")
    jobs = jobs.join(part, jobs.job_id == part.p_partkey).select("job_id", "title", "title_vec")
    lines = _lines(spark, sf)
    cv = lines.select(F.col("l_orderkey").alias("cv_id"), cv_skill(F.col("p_partkey"), F.col("p_name")).alias("skill"))
    job = lines.select((F.col("l_orderkey") - 1).alias("job_id"), F.col("p_name").alias("skill"))
    return relevant_pairs(cvs, jobs, cv, job, synonyms=synonym_table(spark, sf), categories=category_table(spark, sf))


RULE_CTES = SKILL_CTES + [
    """tc AS (SELECT cv_id, p_name || ' ' || p_type AS title, title_vec FROM main_cv JOIN part ON p_partkey = cv_id)""",
    """tj AS (SELECT job_id, p_name || ' ' || p_type AS title, title_vec FROM active_job JOIN part ON p_partkey = job_id)""",
    """titles AS (SELECT title FROM tc UNION ALL SELECT title FROM tj)""",
    """tw AS (SELECT title, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN_]+'), lambda w: w <> '')) AS ws FROM (SELECT DISTINCT title FROM titles))""",
    """idf AS (SELECT w, ln(((SELECT count(*) FROM titles) + 1.0) / (count(*) + 1)) + 1 AS idf
  FROM (SELECT unnest(ws) AS w FROM titles JOIN tw USING (title)) GROUP BY w)""",
    """tn AS (SELECT title, any_value(ws) AS ws, sqrt(sum(idf * idf)) AS norm FROM (SELECT title, ws, unnest(ws) AS w FROM tw) JOIN idf USING (w) GROUP BY title)""",
    """tt AS (
  SELECT a.title AS cv_title, b.title AS job_title,
         len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))
         + 1.0 - levenshtein(lower(a.title), lower(b.title)) / greatest(length(a.title), length(b.title))
         + coalesce((SELECT sum(idf * idf) FROM idf WHERE list_contains(a.ws, w) AND list_contains(b.ws, w)), 0) / (a.norm * b.norm) AS part
  FROM tn a, tn b)""",
    f"""tm AS (
  SELECT cv_id, job_id, (part + {cos('tc.title_vec', 'tj.title_vec')}) / 4 AS title_score
  FROM tt JOIN tc ON tc.title = cv_title JOIN tj ON tj.title = job_title
  WHERE (part + {cos('tc.title_vec', 'tj.title_vec')}) / 4 > 0.6)""",
    f"""sg AS (
  SELECT cv_skill, job_skill, {_level_sql('cv_skill', 'job_skill')} AS level
  FROM (SELECT DISTINCT cv_skill FROM skl) a, (SELECT DISTINCT job_skill FROM skl) b)""",
    """sl AS (
  SELECT cv_id, job_id, j.job_skill, coalesce(max(level), 0) AS level
  FROM tm JOIN (SELECT DISTINCT l_orderkey - 1 AS k, job_skill FROM skl) j ON j.k = job_id
  LEFT JOIN (SELECT DISTINCT l_orderkey AS k, cv_skill FROM skl) c ON c.k = cv_id
  LEFT JOIN sg ON sg.cv_skill = c.cv_skill AND sg.job_skill = j.job_skill GROUP BY ALL)""",
    """rule AS (
  SELECT tm.cv_id, tm.job_id, title_score, count(job_skill)::INTEGER AS n_job_skills, coalesce(max(level), 0)::INTEGER AS best_level,
         (count(*) FILTER (WHERE level >= 3))::INTEGER AS n_matched, count(*) FILTER (WHERE level >= 3) > 0 AS relevant
  FROM tm LEFT JOIN sl ON sl.cv_id = tm.cv_id AND sl.job_id = tm.job_id GROUP BY ALL)"""]


@register("relevant_pairs", with_views(*RULE_CTES).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT cv_id, job_id, round(title_score, 6) AS title_score, n_job_skills, best_level, n_matched, relevant FROM rule""")
def q_relevant_pairs(spark, sf):
    """Rule labels: all (CV, job) pairs whose titles match, graded by skills; relevant = titles and skills match."""
    return rule_relevant(spark, sf).select("cv_id", "job_id", _r("title_score").alias("title_score"), "n_job_skills", "best_level", "n_matched", "relevant")


@register("ndcg_rule_labels", with_views(*cascade_ctes(50, 20, 10), *RULE_CTES, """
recs3 AS (SELECT q_id AS cv_id, i_id AS job_id, rnk3 AS rank, coalesce(rule.relevant, FALSE) AS rel
          FROM r3 LEFT JOIN rule ON rule.cv_id = r3.q_id AND rule.job_id = r3.i_id)""", """
nrel AS (SELECT cv_id, count(*) AS n_relevant FROM rule WHERE relevant GROUP BY cv_id)""", _pq_sql(3)).replace("WITH ", "WITH RECURSIVE ", 1) + _k_union(
    {k: f"round(avg(ndcg_{k}), 6) AS ndcg, round(avg(CASE WHEN hits_{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate" for k in KS}))
def q_ndcg_rule(spark, sf):
    """NDCG and hit rate of the cascade's lists against the rule labels."""
    cvs, jobs = main_cv_df(spark, sf), active_job_df(spark, sf)
    relevant = checkpointed(rule_relevant(spark, sf).where("relevant").select("cv_id", "job_id", F.lit(True).alias("_rel")))   # read twice
    recs = cascade(cvs, jobs, k1=50, k2=20, k3=10).join(relevant, ["cv_id", "job_id"], "left").withColumn("rel", F.coalesce("_rel", F.lit(False)))
    pq = ev.per_query(recs, "cv_id", "rank", "rel", relevant.groupBy("cv_id").agg(F.count(F.lit(1)).alias("n_relevant")), KS)
    return ev.at_k(pq, KS, {"ndcg": lambda k: _r(F.avg(f"ndcg_{k}")),
                            "hit_rate": lambda k: _r(F.avg(F.when(F.col(f"hits_{k}") > 0, 1.0).otherwise(0.0)))})
