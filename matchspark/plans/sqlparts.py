"""SQL building blocks for the DuckDB oracle (same rules as ``sources/adapters.py``)."""

from __future__ import annotations

VIEWS = """
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
n AS (SELECT count(*) AS n FROM e),
base AS (
  SELECT e.id, e.v AS title_vec, e.label, pe.v AS exp_vec, ps.v AS skl_vec
  FROM e CROSS JOIN n
  LEFT JOIN e pe ON pe.id = (e.id * 7 + 3) % n.n
  LEFT JOIN e ps ON ps.id = (e.id * 3 + 1) % n.n),
v_cv AS (
  SELECT id AS cv_id, title_vec,
         CASE WHEN id % 4 = 0 THEN NULL ELSE exp_vec END AS experience_vec,
         CASE WHEN id % 15 = 0 THEN NULL ELSE skl_vec END AS skills_vec,
         (id % 10 <> 5 OR id < 50) AS is_main, label
  FROM base),
v_job AS (
  SELECT id AS job_id, title_vec,
         CASE WHEN id % 13 = 0 THEN NULL ELSE exp_vec END AS requirement_vec,
         CASE WHEN id % 17 = 0 THEN NULL ELSE skl_vec END AS skills_vec,
         CASE WHEN id % 11 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
         CASE WHEN id % 3 = 0 THEN NULL
              ELSE TIMESTAMP '2024-01-01' + to_days(CAST(id % 365 AS INTEGER)) END AS expires_at,
         label
  FROM base),
main_cv AS (SELECT * FROM v_cv WHERE is_main),
active_job AS (
  SELECT * FROM v_job
  WHERE status = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-06-01'))
"""


def present(v: str) -> str:
    return f"({v} IS NOT NULL AND len({v}) > 0)"


def dot(a: str, b: str) -> str:
    """NULL-safe inner product (DuckDB's list_dot_product rejects NULL lists)."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def cos(a: str, b: str) -> str:
    return (
        f"(CASE WHEN NOT {present(a)} OR NOT {present(b)} OR len({a}) <> len({b}) THEN CAST(0 AS DOUBLE) "
        f"WHEN {dot(a, a)} = 0 OR {dot(b, b)} = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) END)"
    )


def defaulted(q: str, i: str, qa: float = 0.3, ia: float = 0.5) -> str:
    return (
        f"(CASE WHEN NOT {present(q)} THEN CAST({qa} AS DOUBLE) "
        f"WHEN NOT {present(i)} THEN CAST({ia} AS DOUBLE) ELSE {cos(q, i)} END)"
    )


def with_views(*ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {VIEWS.strip()}{extra}\n"


def title_topk_cte(name: str, k: int, exclude_self: bool = False, queries: str = "main_cv",
                   qid: str = "cv_id", corpus: str = "active_job", iid: str = "job_id") -> str:
    """Exact top-k by title cosine over present vectors; rank ties by item id."""
    cond = f"AND q.{qid} <> c.{iid}" if exclude_self else ""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT q.{qid} AS q_id, c.{iid} AS i_id, {cos('q.title_vec', 'c.title_vec')} AS sim,
           CAST(row_number() OVER (PARTITION BY q.{qid}
                ORDER BY {cos('q.title_vec', 'c.title_vec')} DESC, c.{iid}) AS INTEGER) AS rnk
    FROM {queries} q JOIN {corpus} c ON {present('q.title_vec')} AND {present('c.title_vec')} {cond}
  ) WHERE rnk <= {k})"""


def cascade_ctes(k1: int, k2: int, k3: int) -> list[str]:
    """r1 (title), r2 (experience vs requirements), r3 (skills) with previous-rank tie breaks."""
    s2 = defaulted("c.experience_vec", "j.requirement_vec")
    s3 = defaulted("c.skills_vec", "j.skills_vec")
    return [
        title_topk_cte("r1", k1),
        f"""r2 AS (
  SELECT * FROM (
    SELECT q_id, i_id, rnk AS r1, s2,
           CAST(row_number() OVER (PARTITION BY q_id ORDER BY s2 DESC, rnk) AS INTEGER) AS rnk2
    FROM (SELECT r1.*, {s2} AS s2 FROM r1
          JOIN main_cv c ON c.cv_id = r1.q_id JOIN active_job j ON j.job_id = r1.i_id))
  WHERE rnk2 <= {k2})""",
        f"""r3 AS (
  SELECT * FROM (
    SELECT q_id, i_id, rnk2, s3,
           CAST(row_number() OVER (PARTITION BY q_id ORDER BY s3 DESC, rnk2) AS INTEGER) AS rnk3
    FROM (SELECT r2.*, {s3} AS s3 FROM r2
          JOIN main_cv c ON c.cv_id = r2.q_id JOIN active_job j ON j.job_id = r2.i_id))
  WHERE rnk3 <= {k3})""",
    ]


def cascade_sql(k1: int, k2: int, k3: int) -> str:
    return with_views(*cascade_ctes(k1, k2, k3)) + """
SELECT q_id AS cv_id, i_id AS job_id, round(s3, 6) AS similarity, rnk3 AS rank FROM r3"""
