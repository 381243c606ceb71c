"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Queries are put together from named parts; :func:`sql` adds the parts a body
mentions, in order of definition.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, body: str, columns: str = "") -> None:
    PARTS[name] = f"{name}{columns} AS MATERIALIZED ({body})"


def _mentioned(text: str, known: list[str]) -> set[str]:
    return {name for name in known if re.search(rf"\b{name}\b", text)}


def sql(body: str) -> str:
    names = list(PARTS)
    needed: set[str] = set()
    queue = _mentioned(body, names)
    while queue:
        name = queue.pop()
        needed.add(name)
        queue |= _mentioned(PARTS[name], names) - needed
    listed = [PARTS[name] for name in names if name in needed]
    return f"WITH RECURSIVE {', '.join(listed)} {body}" if listed else body


def by_case(column: str, codes: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items())
    return f"CAST(CASE {column} {whens} END AS INT)"


# ---------------------------------------------------------------- parts

part(
    "raw_steps",
    """SELECT CAST(user_id AS VARCHAR) AS ID,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS TIME,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k, value,
    CAST(floor(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) / 25.0) AS INT) AS total_sofa,
    """
    + by_case("event_type", {"error": 0, "view": 1, "click": 2, "purchase": 3, "signup": 4})
    + """ AS ACTION,
    CAST(least(floor(value / 20), 15) AS INT) AS RISK
    FROM events WHERE user_id IS NOT NULL""",
)
part(
    "spoiled",
    """SELECT CASE WHEN k % 10 <> 0 THEN ID END AS ID, CAST(TIME - 5 AS INT) AS TIME,
    CASE WHEN k % 7 <> 0 THEN k END AS k,
    CASE WHEN value < 5 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
    total_sofa, ACTION, RISK FROM raw_steps""",
)
part(
    "risky",
    """SELECT ID, TIME, k, value, total_sofa, ACTION, CAST(total_sofa + RISK AS INT) AS RISK
    FROM raw_steps WHERE ID IS NOT NULL AND TIME >= 0""",
)
part(
    "steps",
    """SELECT *, CAST(CASE WHEN RISK < 2 THEN 0 WHEN RISK < 4 THEN 1 ELSE 2 END AS INT) AS CLUSTER
    FROM risky""",
)
REWARDS = {"AUTOMOBILE": 0, "BUILDING": 5, "FURNITURE": 10, "HOUSEHOLD": 20, "MACHINERY": 100}
part(
    "ends",
    "SELECT CAST(c_custkey AS VARCHAR) AS ID, c_mktsegment AS end_state, "
    + by_case("c_mktsegment", REWARDS)
    + " AS Reward FROM customer WHERE c_custkey IN (SELECT user_id FROM events)",
)
part("top", "SELECT max(CLUSTER) AS max_cluster FROM steps")
part(
    "dim",
    """SELECT end_state, min(Reward) AS Reward, CAST(dense_rank() OVER (ORDER BY end_state)
    + (SELECT max_cluster FROM top) AS INT) AS END_INDEX FROM ends GROUP BY end_state""",
)
part(
    "indexed",
    "SELECT e.ID, e.end_state, e.Reward, d.END_INDEX FROM ends e JOIN dim d USING (end_state)",
)
part(
    "labelled",
    """SELECT s.*, coalesce(lead(s.CLUSTER) OVER w, i.END_INDEX) AS NEXT_CLUSTER
    FROM steps s LEFT JOIN indexed i ON s.ID = i.ID
    WINDOW w AS (PARTITION BY s.ID ORDER BY s.TIME)""",
)
part(
    "ahead",
    """SELECT s.*, coalesce(lead(s.RISK) OVER w, i.Reward) AS NEXT_RISK
    FROM steps s LEFT JOIN indexed i ON s.ID = i.ID
    WINDOW w AS (PARTITION BY s.ID ORDER BY s.TIME)""",
)
part(
    "counts",
    """SELECT CLUSTER, ACTION, NEXT_CLUSTER, count(*) AS cnt FROM labelled
    WHERE NEXT_CLUSTER IS NOT NULL GROUP BY ALL""",
)
part(
    "p",
    """SELECT c.CLUSTER, c.ACTION, c.NEXT_CLUSTER, c.cnt / t.total AS prob FROM counts c JOIN
    (SELECT CLUSTER, ACTION, sum(cnt) AS total FROM counts GROUP BY ALL) t
    ON c.CLUSTER = t.CLUSTER AND c.ACTION = t.ACTION""",
)
part(
    "r",
    """SELECT CLUSTER, avg(RISK) AS RISK FROM steps GROUP BY CLUSTER
    UNION ALL SELECT END_INDEX, CAST(Reward AS DOUBLE) FROM dim""",
)
part(
    "expected",
    """SELECT p.CLUSTER, p.ACTION, sum(p.prob * r.RISK) AS expected_next_risk
    FROM p LEFT JOIN r ON p.NEXT_CLUSTER = r.CLUSTER GROUP BY ALL""",
)
part(
    "best_next",
    """SELECT CLUSTER, ACTION, min(p.NEXT_CLUSTER) AS NEXT_CLUSTER FROM p JOIN
    (SELECT CLUSTER AS c, ACTION AS a, max(prob) AS m FROM p GROUP BY ALL) b
    ON p.CLUSTER = b.c AND p.ACTION = b.a AND p.prob = b.m GROUP BY ALL""",
)
part(
    "starts",
    "SELECT ID, arg_min(CLUSTER, TIME) AS CLUSTER FROM steps GROUP BY ID",
)
part("finish", "SELECT ID, count(*) AS n FROM steps GROUP BY ID")
part(
    "followed",
    """SELECT ID, 0 AS t, CLUSTER FROM starts
    UNION ALL
    SELECT f.ID, f.t + 1, coalesce(b.NEXT_CLUSTER, f.CLUSTER) FROM followed f
    JOIN steps s ON s.ID = f.ID AND s.TIME = f.t
    LEFT JOIN best_next b ON b.CLUSTER = f.CLUSTER AND b.ACTION = s.ACTION""",
)
PARTS["followed"] = PARTS["followed"].replace("AS MATERIALIZED", "AS")
part(
    "predicted",
    """SELECT f.ID, f.CLUSTER AS predicted_final_cluster FROM followed f
    JOIN finish n ON n.ID = f.ID AND n.n = f.t""",
)
part(
    "judged",
    """SELECT p.ID, p.predicted_final_cluster, i.END_INDEX,
    p.predicted_final_cluster = i.END_INDEX AS correct
    FROM predicted p LEFT JOIN indexed i ON p.ID = i.ID""",
)
part(
    "vectors",
    """SELECT *, (k + 1) / (k + value + total_sofa + 3) AS x0,
    (value + 1) / (k + value + total_sofa + 3) AS x1,
    (total_sofa + 1) / (k + value + total_sofa + 3) AS x2 FROM labelled""",
)
part(
    "centres",
    """SELECT CLUSTER, ACTION, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2
    FROM vectors GROUP BY ALL""",
)


def kl_sql(x: str, y: str) -> str:
    return f"CASE WHEN {x} > 0 AND {y} > 0 THEN {x} * ln({x} / ({y})) ELSE 0 END"


def js_sql(pairs: list[tuple[str, str]]) -> str:
    terms = []
    for x, y in pairs:
        middle = f"(({x} + {y}) / 2)"
        terms.append(f"0.5 * ({kl_sql(x, middle)}) + 0.5 * ({kl_sql(y, middle)})")
    return " + ".join(terms)


PAIRS = [("x0", "m0"), ("x1", "m1"), ("x2", "m2")]
part(
    "diverged",
    f"""SELECT v.ID, v.TIME, v.CLUSTER, v.ACTION, {js_sql(PAIRS)} AS js,
    {" + ".join(kl_sql(x, y) for x, y in PAIRS)} AS kl
    FROM vectors v JOIN centres c ON v.CLUSTER = c.CLUSTER AND v.ACTION = c.ACTION""",
)
part(
    "radius",
    """SELECT CLUSTER, ACTION, avg(js) AS incoherence, count(*) AS cnt FROM diverged
    GROUP BY ALL""",
)
part("halves", "SELECT *, CAST(k >= 50 AS INT) AS SUB FROM vectors WHERE CLUSTER = 1")
part(
    "half_radius",
    f"""SELECT v.SUB, v.ACTION, avg({js_sql(PAIRS)}) AS incoherence FROM halves v JOIN
    (SELECT SUB, ACTION, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2 FROM halves GROUP BY ALL) c
    ON v.SUB = c.SUB AND v.ACTION = c.ACTION GROUP BY ALL""",
)
part(
    "split",
    """SELECT ID, TIME, CAST(CASE WHEN CLUSTER = 1 AND k >= 50 THEN 3 ELSE CLUSTER END AS INT)
    AS CLUSTER FROM steps""",
)
# values: v0 before any sweep, then one part per sweep; solved by a recursive part
part(
    "v0",
    """SELECT r.CLUSTER, CASE WHEN r.CLUSTER IN (SELECT CLUSTER FROM p) THEN 0.0 ELSE r.RISK END
    AS v FROM r""",
)
for i in (1, 2, 3):
    part(
        f"q{i}",
        f"""SELECT p.CLUSTER, p.ACTION, max(r.RISK) + 0.9 * sum(p.prob * v.v) AS q FROM p
        JOIN r ON p.CLUSTER = r.CLUSTER JOIN v{i - 1} v ON p.NEXT_CLUSTER = v.CLUSTER GROUP BY ALL""",
    )
    part(
        f"v{i}",
        f"""SELECT CLUSTER, min(q) AS v FROM q{i} GROUP BY CLUSTER UNION ALL
        SELECT CLUSTER, v FROM v0 WHERE CLUSTER NOT IN (SELECT CLUSTER FROM p)""",
    )
part(
    "swept",
    """SELECT 0 AS i, CLUSTER, CAST(v AS DOUBLE) AS v FROM v0
    UNION ALL
    SELECT i, CLUSTER, v FROM (
      SELECT i, CLUSTER, min(q) AS v FROM (
        SELECT w.i + 1 AS i, p.CLUSTER, p.ACTION, max(r.RISK) + 0.9 * sum(p.prob * w.v) AS q
        FROM swept w JOIN p ON p.NEXT_CLUSTER = w.CLUSTER JOIN r ON p.CLUSTER = r.CLUSTER
        WHERE w.i < 400 GROUP BY w.i, p.CLUSTER, p.ACTION) GROUP BY i, CLUSTER
      UNION ALL
      SELECT w.i + 1, w.CLUSTER, w.v FROM swept w
      WHERE w.i < 400 AND w.CLUSTER NOT IN (SELECT CLUSTER FROM p))""",
)
PARTS["swept"] = PARTS["swept"].replace("AS MATERIALIZED", "AS")
part("solved", "SELECT CLUSTER, v FROM swept WHERE i = 400")
part(
    "solved_q",
    """SELECT p.CLUSTER, p.ACTION, max(r.RISK) + 0.9 * sum(p.prob * v.v) AS q FROM p
    JOIN r ON p.CLUSTER = r.CLUSTER JOIN solved v ON p.NEXT_CLUSTER = v.CLUSTER GROUP BY ALL""",
)
part("policy", "SELECT CLUSTER, arg_min(ACTION, (q, ACTION)) AS ACTION FROM solved_q GROUP BY 1")
part(
    "intervals",
    """SELECT CLUSTER, ACTION, NEXT_CLUSTER, coalesce(lag(hi) OVER w, 0.0) AS lo, hi FROM (
      SELECT CLUSTER, ACTION, NEXT_CLUSTER,
      CASE WHEN lead(NEXT_CLUSTER) OVER w IS NULL THEN 1.0 ELSE sum(prob) OVER (
        PARTITION BY CLUSTER, ACTION ORDER BY NEXT_CLUSTER ROWS UNBOUNDED PRECEDING) END AS hi
      FROM p WINDOW w AS (PARTITION BY CLUSTER, ACTION ORDER BY NEXT_CLUSTER))
    WINDOW w AS (PARTITION BY CLUSTER, ACTION ORDER BY NEXT_CLUSTER)""",
)
UNIFORM = (
    "CAST('0x' || substr(md5('42|' || {t}.ID || '|' || {t}.TIME), 1, 8) AS BIGINT) / 4294967296.0"
)
part(
    "walk",
    f"""SELECT ID, 0 AS TIME, CLUSTER FROM starts
    UNION ALL
    SELECT w.ID, w.TIME + 1, m.NEXT_CLUSTER FROM walk w
    JOIN policy y ON y.CLUSTER = w.CLUSTER
    JOIN intervals m ON m.CLUSTER = y.CLUSTER AND m.ACTION = y.ACTION
      AND {UNIFORM.format(t="w")} >= m.lo AND {UNIFORM.format(t="w")} < m.hi
    WHERE w.TIME < 5000""",
)
PARTS["walk"] = PARTS["walk"].replace("AS MATERIALIZED", "AS")
part(
    "m0",
    """SELECT p.CLUSTER, p.NEXT_CLUSTER, p.prob FROM p JOIN policy y
    ON p.CLUSTER = y.CLUSTER AND p.ACTION = y.ACTION
    UNION ALL SELECT END_INDEX, END_INDEX, 1.0 FROM dim""",
)
part(
    "c0",
    """SELECT CLUSTER, NEXT_CLUSTER, prob FROM m0 WHERE CLUSTER >= 2
    UNION ALL SELECT 0, 1, 1.0 UNION ALL SELECT 1, 0, 1.0""",
)
for chain in ("m", "c"):
    for i in range(1, 13):
        part(
            f"{chain}{i}",
            f"""SELECT a.CLUSTER, b.NEXT_CLUSTER, sum(a.prob * b.prob) AS prob
            FROM {chain}{i - 1} a JOIN {chain}{i - 1} b ON a.NEXT_CLUSTER = b.CLUSTER GROUP BY ALL""",
        )
part(
    "absorbed",
    """SELECT CLUSTER, NEXT_CLUSTER AS END_STATE, prob FROM m12
    WHERE NEXT_CLUSTER IN (SELECT END_INDEX FROM dim)""",
)
part(
    "absorbed_after",
    """SELECT p.CLUSTER, p.ACTION, b.END_STATE, sum(p.prob * b.prob) AS prob FROM p
    JOIN absorbed b ON p.NEXT_CLUSTER = b.CLUSTER GROUP BY ALL""",
)


# ---------------------------------------------------------------- queries

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLES[name] = sql(body)


oracle("scan_steps", "SELECT * FROM raw_steps")
oracle("scan_end_states", "SELECT * FROM ends")
ORDER_STEPS = (
    """SELECT CAST(o_custkey AS VARCHAR) AS ID, CAST(row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS TIME,
    o_totalprice AS value, """
    + by_case(
        "o_orderpriority",
        {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4},
    )
    + """ AS ACTION, CAST(least(floor(o_totalprice / 100000), 15) AS INT) AS RISK
    FROM orders WHERE o_custkey IS NOT NULL"""
)
ORACLES["scan_named"] = ORDER_STEPS
oracle(
    "scan_model",
    """SELECT p.NEXT_CLUSTER, p.CLUSTER, p.ACTION, round(p.prob, 6) AS prob,
    round(r.RISK, 6) AS RISK FROM p LEFT JOIN r ON p.NEXT_CLUSTER = r.CLUSTER""",
)
oracle(
    "sink_model",
    """SELECT 'steps' AS name, ID, TIME, CLUSTER, ACTION, NEXT_CLUSTER, CAST(RISK AS DOUBLE) AS value
    FROM labelled UNION ALL
    SELECT 'transitions', NULL, NULL, CLUSTER, ACTION, NEXT_CLUSTER, round(prob, 6) FROM p UNION ALL
    SELECT 'rewards', NULL, NULL, CLUSTER, NULL, NULL, round(RISK, 6) FROM r""",
)
oracle(
    "clean_steps",
    "SELECT ID, TIME, ACTION, RISK FROM spoiled WHERE ID IS NOT NULL AND TIME >= 0",
)
oracle("cast_keys", "SELECT ID, TIME, ACTION, CLUSTER FROM steps")
oracle("combine_risk", "SELECT ID, TIME, CAST(total_sofa + RISK AS INT) AS RISK FROM raw_steps")
oracle("infer_features", "SELECT ID, TIME, k, value, total_sofa FROM labelled")
oracle("select_existing", "SELECT ID, TIME, value, k, ACTION, RISK, CLUSTER FROM steps")
oracle("drop_working", "SELECT * FROM labelled")
oracle("rename_features", 'SELECT ID, TIME, total_sofa AS "Total SOFA" FROM raw_steps')
MISSING = [
    "MAP", "Systolic BP", "Diastolic BP", "Heart rate (pulse)", "Respiratory rate",
    "Temperature", "Weight", "FiO2", "SpO2", "SaO2", "Glucose", "Magnesium", "Calcium",
    "Sodium", "Chloride", "HCO3", "Phosphate", "Potassium", "BUN", "Creatinine", "CK",
    "Lactate", "Hematocrit", "Hemoglobin", "WBC", "Platelets", "LDH", "CRP", "ESR", "D-Dimer",
    "INR", "PT", "PTT", "hsCRP", "hsTroponin", "Total Bilirubin", "Troponin",
    "Conjugated Bilirubin", "ALT", "AST", "Albumin", "Alkaline Phosphatase", "BNP", "PaCO2",
    "PaO2", "pH", "Cardiovascular SOFA", "Coagulation SOFA", "Liver SOFA", "Renal SOFA",
    "Respiratory SOFA", "CNS SOFA", "GCS", "Emesis output", "Stool output",
    "Urine output - past 6hrs", "Fluid - ordered, not yet administered",
    "Fluid - given this hour", "Fluid - cumulative given past 6 hours",
]
oracle(
    "missing_features",
    "SELECT f.feature, (SELECT count(*) FROM raw_steps) AS missing_rows FROM (VALUES "
    + ", ".join(f"('{name}')" for name in MISSING)
    + ") f(feature)",
)
VALID = "k IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)"
oracle("skip_invalid", f"SELECT * FROM spoiled WHERE {VALID}")
oracle(
    "count_invalid",
    f"""SELECT count(*) FILTER (WHERE {VALID}) AS kept,
    count(*) FILTER (WHERE NOT ({VALID})) AS dropped FROM spoiled""",
)
oracle(
    "labelled_only",
    """SELECT ID, TIME, NEXT_CLUSTER FROM labelled WHERE NEXT_CLUSTER IS NOT NULL UNION ALL
    SELECT 'x' || ID, TIME, NEXT_CLUSTER FROM labelled WHERE NEXT_CLUSTER <= 2""",
)
oracle("state_action_slice", "SELECT * FROM steps WHERE CLUSTER = 1 AND ACTION = 2")
oracle("state_other_actions", "SELECT * FROM steps WHERE CLUSTER = 1 AND ACTION <> 2")
oracle("state_rest", "SELECT * FROM steps WHERE CLUSTER <> 1")
oracle(
    "start_states", "SELECT ID, arg_min(CLUSTER, TIME) AS CLUSTER FROM steps GROUP BY 1"
)
oracle(
    "conditional_relabel",
    "SELECT ID, TIME, CAST(CASE WHEN SUB = 0 THEN CLUSTER ELSE 3 END AS INT) AS CLUSTER FROM halves",
)
oracle("fill_terminal", "SELECT ID, TIME, NEXT_RISK FROM ahead")
oracle(
    "name_end_states",
    """SELECT ID, END_INDEX AS END_STATE, CASE WHEN end_state = 'FURNITURE'
    THEN 'state_' || END_INDEX ELSE end_state END AS label FROM indexed""",
)
oracle(
    "join_end_state",
    """SELECT s.ID, s.TIME, s.CLUSTER, i.END_INDEX FROM steps s LEFT JOIN indexed i
    ON s.ID = i.ID""",
)
oracle(
    "join_totals",
    """SELECT c.*, CAST(t.total AS BIGINT) AS total FROM counts c JOIN
    (SELECT CLUSTER, ACTION, sum(cnt) AS total FROM counts GROUP BY ALL) t
    ON c.CLUSTER = t.CLUSTER AND c.ACTION = t.ACTION""",
)
ORACLES["join_next_reward"] = ORACLES["scan_model"]
oracle(
    "join_expected",
    """SELECT s.ID, s.TIME, s.CLUSTER, s.ACTION, round(e.expected_next_risk, 6)
    AS expected_next_risk FROM steps s LEFT JOIN expected e
    ON s.CLUSTER = e.CLUSTER AND s.ACTION = e.ACTION""",
)
oracle(
    "join_subject_reward",
    "SELECT s.ID, s.TIME, s.RISK, e.Reward FROM steps s LEFT JOIN ends e ON s.ID = e.ID",
)
oracle(
    "join_argmax",
    """SELECT p.CLUSTER, p.ACTION, p.NEXT_CLUSTER, round(p.prob, 6) AS prob FROM p JOIN
    (SELECT CLUSTER, ACTION, max(prob) AS m FROM p GROUP BY ALL) b
    ON p.CLUSTER = b.CLUSTER AND p.ACTION = b.ACTION AND p.prob = b.m""",
)
oracle("join_truth", "SELECT * FROM judged")
oracle(
    "policy_transitions",
    """SELECT p.CLUSTER, p.ACTION, p.NEXT_CLUSTER, round(p.prob, 6) AS prob FROM p
    JOIN policy y ON p.CLUSTER = y.CLUSTER AND p.ACTION = y.ACTION""",
)
oracle("cluster_sizes", "SELECT CLUSTER, count(*) AS cnt FROM steps GROUP BY 1")
oracle(
    "distinct_states",
    "SELECT DISTINCT NEXT_CLUSTER FROM labelled WHERE NEXT_CLUSTER IS NOT NULL ORDER BY 1",
)
oracle("transition_counts", "SELECT * FROM counts")
oracle(
    "transition_probabilities",
    "SELECT CLUSTER, ACTION, NEXT_CLUSTER, round(prob, 6) AS prob FROM p",
)
ORACLES["transition_probabilities_orders"] = (
    f"""WITH s AS ({ORDER_STEPS}), st AS (SELECT ID, TIME, ACTION,
    CAST(CASE WHEN RISK < 2 THEN 0 WHEN RISK < 4 THEN 1 ELSE 2 END AS INT) AS CLUSTER FROM s),
    e AS (SELECT CAST(c_custkey AS VARCHAR) AS ID, CAST(dense_rank() OVER (ORDER BY c_mktsegment)
      + (SELECT max(CLUSTER) FROM st) AS INT) AS END_INDEX FROM customer
      WHERE c_custkey IN (SELECT o_custkey FROM orders)),
    l AS (SELECT st.CLUSTER, st.ACTION, coalesce(lead(st.CLUSTER) OVER
      (PARTITION BY st.ID ORDER BY st.TIME), e.END_INDEX) AS NEXT_CLUSTER
      FROM st LEFT JOIN e ON st.ID = e.ID),
    n AS (SELECT CLUSTER, ACTION, NEXT_CLUSTER, count(*) AS cnt FROM l
      WHERE NEXT_CLUSTER IS NOT NULL GROUP BY ALL)
    SELECT CLUSTER, ACTION, NEXT_CLUSTER,
    round(cnt / sum(cnt) OVER (PARTITION BY CLUSTER, ACTION), 6) AS prob FROM n"""
)
oracle("state_rewards", "SELECT CLUSTER, round(avg(RISK), 6) AS RISK FROM steps GROUP BY 1")
oracle(
    "end_state_rewards", "SELECT END_INDEX AS CLUSTER, CAST(Reward AS DOUBLE) AS RISK FROM dim"
)
oracle("reward_table", "SELECT CLUSTER, round(RISK, 6) AS RISK FROM r")
oracle(
    "expected_next_risk",
    "SELECT CLUSTER, ACTION, round(expected_next_risk, 6) AS expected_next_risk FROM expected",
)
oracle(
    "one_step_reward_error",
    """SELECT round(avg(abs(e.expected_next_risk - a.NEXT_RISK)), 6) AS mae,
    round(avg((e.expected_next_risk - a.NEXT_RISK) ** 2), 6) AS mse,
    round(1 - sum((e.expected_next_risk - a.NEXT_RISK) ** 2)
      / sum((a.NEXT_RISK - (SELECT avg(NEXT_RISK) FROM ahead)) ** 2), 6) AS r2
    FROM ahead a LEFT JOIN expected e ON a.CLUSTER = e.CLUSTER AND a.ACTION = e.ACTION""",
)
oracle(
    "stddev_incoherence",
    """SELECT CLUSTER, ACTION, round(stddev(NEXT_CLUSTER), 6) AS incoherence, count(*) AS cnt
    FROM labelled WHERE NEXT_CLUSTER IS NOT NULL GROUP BY ALL
    HAVING count(*) >= 200 AND stddev(NEXT_CLUSTER) IS NOT NULL""",
)
oracle(
    "mean_distribution",
    """SELECT CLUSTER, ACTION, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1,
    round(m2, 6) AS mean_2 FROM centres""",
)
oracle(
    "information_radius",
    "SELECT CLUSTER, ACTION, round(incoherence, 6) AS incoherence, cnt FROM radius",
)
oracle("max_state", "SELECT max_cluster FROM top")
oracle(
    "max_prob",
    "SELECT CLUSTER, ACTION, round(max(prob), 6) AS max_prob FROM p GROUP BY ALL",
)
oracle(
    "subject_sequences",
    """SELECT ID, CAST(TIME // 32 AS INT) AS BLOCK, string_agg(CLUSTER, ',' ORDER BY TIME)
    AS cluster_seq, string_agg(ACTION, ',' ORDER BY TIME) AS action_seq FROM steps GROUP BY ALL""",
)
oracle("path_accuracy", "SELECT round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM judged")
oracle(
    "confusion_matrix",
    "SELECT predicted_final_cluster, END_INDEX, count(*) AS cnt FROM judged GROUP BY ALL",
)
ORACLES["dedupe_rewards"] = ORACLES["reward_table"]
oracle(
    "time_profile",
    """SELECT CLUSTER, count(TIME) AS cnt, round(avg(TIME), 6) AS mean,
    round(stddev(TIME), 6) AS std, min(TIME) AS min,
    round(quantile_cont(CAST(TIME AS DOUBLE), 0.25), 6) AS p25,
    round(quantile_cont(CAST(TIME AS DOUBLE), 0.5), 6) AS p50,
    round(quantile_cont(CAST(TIME AS DOUBLE), 0.75), 6) AS p75, max(TIME) AS max
    FROM steps GROUP BY CLUSTER""",
)
oracle(
    "time_histogram",
    """SELECT CLUSTER, CAST(least(floor(TIME / 20), 99) AS INT) AS BIN, count(*) AS cnt
    FROM steps WHERE TIME BETWEEN 0 AND 2000 GROUP BY ALL""",
)
oracle(
    "action_frequency",
    """SELECT ACTION, round(count(*) / (SELECT count(*) FROM steps), 6) AS freq
    FROM steps GROUP BY ACTION""",
)
oracle(
    "action_frequency_by_state",
    """SELECT g.CLUSTER, g.ACTION, round(coalesce(c.n, 0) / g.total, 6) AS freq FROM
    (SELECT CLUSTER, count(*) AS total, CAST(unnest([0, 1, 2, 3, 4, 5]) AS INT) AS ACTION
     FROM steps GROUP BY CLUSTER) g
    LEFT JOIN (SELECT CLUSTER, ACTION, count(*) AS n FROM steps GROUP BY ALL) c
    ON g.CLUSTER = c.CLUSTER AND g.ACTION = c.ACTION""",
)
oracle(
    "feature_zscores",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, CLUSTER, round((avg({f}) - (SELECT avg({f}) FROM steps))
        / (SELECT stddev({f}) FROM steps), 6) AS zscore FROM steps GROUP BY CLUSTER"""
        for f in ("k", "value", "total_sofa")
    ),
)
oracle(
    "state_action_support",
    """SELECT CLUSTER, ACTION, count(*) AS cnt FROM labelled WHERE NEXT_CLUSTER IS NOT NULL
    GROUP BY ALL HAVING count(*) >= 400""",
)
oracle("next_state", "SELECT * FROM labelled")
oracle("next_risk", "SELECT ID, TIME, RISK, NEXT_RISK FROM ahead")
oracle("index_end_states", "SELECT * FROM indexed")
oracle(
    "rank_incoherence",
    """SELECT CLUSTER, ACTION, round(incoherence, 6) AS incoherence, cnt FROM radius
    WHERE cnt >= 200 AND NOT (CLUSTER = 0 AND ACTION = 1) AND NOT (CLUSTER = 2 AND ACTION = 3)
    ORDER BY radius.incoherence DESC, CLUSTER, ACTION LIMIT 1""",
)
oracle(
    "worst_action",
    """SELECT SUB, arg_max(ACTION, incoherence) AS ACTION,
    round(max(incoherence), 6) AS incoherence FROM half_radius GROUP BY SUB""",
)
oracle(
    "best_action",
    "SELECT CLUSTER, arg_min(ACTION, (q, ACTION)) AS ACTION FROM q3 GROUP BY CLUSTER",
)
oracle("order_trajectories", "SELECT ID, TIME, CLUSTER, ACTION FROM steps ORDER BY 1, 2")
ORACLES["order_series"] = ORACLES["transition_probabilities"]
oracle(
    "union_by_name",
    """SELECT ID, TIME, CLUSTER, CASE WHEN CLUSTER = 1 THEN CAST(k >= 50 AS INT) END AS SUB
    FROM labelled""",
)
oracle("distinct_rows", "SELECT DISTINCT CLUSTER, ACTION, NEXT_CLUSTER FROM labelled")
oracle("kl_divergence", "SELECT ID, TIME, round(kl, 6) AS kl FROM diverged")
oracle("js_divergence", "SELECT ID, TIME, round(js, 6) AS js FROM diverged")
oracle(
    "vector_element",
    """SELECT ID, TIME, value AS present, CAST(0 AS DOUBLE) AS absent, CAST(CASE total_sofa
    WHEN 0 THEN k WHEN 1 THEN value WHEN 2 THEN total_sofa ELSE 0 END AS DOUBLE) AS chosen
    FROM steps""",
)
oracle("pack_array", "SELECT ID, TIME, k || ',' || total_sofa AS packed FROM steps")
oracle(
    "math",
    """SELECT ID, TIME, round(abs(value - k), 6) AS distance, round((value - k) ** 2, 4) AS squared,
    round(RISK / (k + 1), 6) AS ratio, round(ln(value + 1), 6) AS log FROM steps""",
)
oracle(
    "portable_uniform",
    f"SELECT ID, TIME, round({UNIFORM.format(t='steps')}, 9) AS u FROM steps",
)
oracle(
    "renormalise",
    """SELECT CLUSTER, ACTION, NEXT_CLUSTER, round(prob * (NEXT_CLUSTER + 1) /
    sum(prob * (NEXT_CLUSTER + 1)) OVER (PARTITION BY CLUSTER, ACTION), 6) AS prob FROM p""",
)
oracle(
    "expand_grid",
    """WITH c AS (SELECT CLUSTER, ACTION, count(*) AS cnt FROM labelled
      WHERE NEXT_CLUSTER IS NOT NULL GROUP BY ALL HAVING count(*) >= 400)
    SELECT g.CLUSTER, g.ACTION, c.cnt FROM
    (SELECT CLUSTER, CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS ACTION FROM c GROUP BY CLUSTER) g
    LEFT JOIN c ON g.CLUSTER = c.CLUSTER AND g.ACTION = c.ACTION""".replace("WITH c AS", "SELECT * FROM (WITH c AS")
    + ")",
)
oracle(
    "wide_matrix",
    "SELECT CLUSTER, "
    + ", ".join(
        f"round(max(CASE WHEN NEXT_CLUSTER = {i} THEN prob END), 6) AS to_{i}" for i in range(8)
    )
    + " FROM p GROUP BY CLUSTER",
)
oracle(
    "assemble",
    f"""SELECT ID, TIME, CAST(k AS DOUBLE) AS first, value AS second FROM spoiled
    WHERE {VALID}""",
)
oracle(
    "accept_split",
    """SELECT count(*) FILTER (WHERE SUB = 0) AS size_0, count(*) FILTER (WHERE SUB = 1) AS size_1,
    count(*) FILTER (WHERE SUB = 0) >= 30 AND count(*) FILTER (WHERE SUB = 1) >= 30 AS accepted
    FROM halves""",
)
oracle(
    "apply_split",
    """SELECT s.ID, s.TIME, s.CLUSTER, coalesce(lead(s.CLUSTER) OVER
    (PARTITION BY s.ID ORDER BY s.TIME), CAST(i.END_INDEX + 1 AS INT)) AS NEXT_CLUSTER
    FROM split s LEFT JOIN indexed i ON s.ID = i.ID""",
)
oracle("bellman_backup", "SELECT CLUSTER, round(v, 6) AS v FROM v3")
oracle("solve_policy", "SELECT CLUSTER, round(v, 6) AS v FROM solved")
oracle(
    "action_values",
    "SELECT CLUSTER, "
    + ", ".join(
        f"round(0.75 * max(CASE WHEN ACTION = {a} THEN q END), 6) AS action_{a}" for a in range(5)
    )
    + " FROM q3 GROUP BY CLUSTER",
)
oracle("greedy_policy", "SELECT CLUSTER, ACTION FROM policy")
oracle(
    "cumulative_transitions",
    """SELECT CLUSTER, ACTION, NEXT_CLUSTER, round(lo, 6) AS lo, round(hi, 6) AS hi
    FROM intervals""",
)
oracle(
    "sample_transition",
    f"""SELECT s.ID, s.TIME, s.CLUSTER, s.ACTION, m.NEXT_CLUSTER AS SAMPLED FROM steps s
    LEFT JOIN intervals m ON s.CLUSTER = m.CLUSTER AND s.ACTION = m.ACTION
    AND {UNIFORM.format(t="s")} >= m.lo AND {UNIFORM.format(t="s")} < m.hi""",
)


def walk_sql(limit: int) -> str:
    stop = f"""CASE WHEN w.CLUSTER IN (SELECT END_INDEX FROM dim) THEN 'end_state'
    WHEN w.TIME >= {limit} THEN 'max_steps' END"""
    return f"""SELECT w.ID, w.TIME, w.CLUSTER, CASE WHEN {stop} IS NULL THEN y.ACTION END AS ACTION,
    {stop} AS stop_reason FROM walk w LEFT JOIN policy y ON w.CLUSTER = y.CLUSTER
    WHERE w.TIME <= {limit}"""


oracle("policy_rollout", walk_sql(5000))
oracle("policy_rollout_three_steps", walk_sql(3))
oracle("terminal_states", "SELECT END_INDEX AS CLUSTER FROM dim")
oracle(
    "most_likely_transition",
    "SELECT CLUSTER, ACTION, NEXT_CLUSTER AS most_likely_next_cluster FROM best_next",
)
oracle("most_likely_path", "SELECT ID, predicted_final_cluster FROM predicted")
oracle("policy_matrix", "SELECT CLUSTER, NEXT_CLUSTER, round(prob, 6) AS prob FROM m0")
oracle("find_absorbing", "SELECT END_INDEX AS CLUSTER FROM dim")
oracle(
    "absorption_probabilities",
    "SELECT CLUSTER, END_STATE, round(prob, 6) AS prob FROM absorbed",
)
oracle(
    "absorption_by_elimination",
    "SELECT CLUSTER, END_STATE, round(prob, 6) AS prob FROM absorbed",
)
oracle(
    "absorption_after_action",
    """SELECT CLUSTER, ACTION, END_STATE, round(prob, 6) AS prob FROM absorbed_after
    UNION ALL SELECT END_INDEX, NULL, END_INDEX, 1.0 FROM dim""",
)
oracle(
    "absorption_report",
    """SELECT a.CLUSTER, a.END_STATE, round(a.prob, 6) AS prob, a.ACTION, d.end_state AS label FROM
    (SELECT CLUSTER, END_STATE, prob, NULL AS ACTION FROM absorbed
     UNION ALL SELECT CLUSTER, END_STATE, prob, ACTION FROM absorbed_after) a
    LEFT JOIN dim d ON a.END_STATE = d.END_INDEX""",
)
oracle(
    "check_step_keys",
    """SELECT problem, CAST(n_rows AS BIGINT) AS n_rows FROM (
      WITH odd AS (
        SELECT CASE WHEN k % 13 <> 0 THEN ID END AS ID, CASE WHEN k % 11 <> 0 THEN TIME - 3 END AS TIME,
        k % 5 = 0 OR RISK IS NULL AS no_state, k FROM raw_steps
      ), doubled AS (SELECT * FROM odd UNION ALL SELECT * FROM odd WHERE k % 7 = 0
      ), counted AS (SELECT *, count(*) OVER (PARTITION BY ID, TIME) AS n FROM doubled)
      SELECT 'no subject' AS problem, count(*) FILTER (ID IS NULL) AS n_rows FROM counted
      UNION ALL SELECT 'no time', count(*) FILTER (TIME IS NULL) FROM counted
      UNION ALL SELECT 'negative time', count(*) FILTER (TIME < 0) FROM counted
      UNION ALL SELECT 'repeated key', count(*) FILTER (ID IS NOT NULL AND TIME IS NOT NULL AND n > 1)
        FROM counted
      UNION ALL SELECT 'no given state', count(*) FILTER (no_state) FROM counted)""",
)
oracle(
    "check_row_sums",
    """SELECT r.CLUSTER, CAST(0 AS DOUBLE) AS total FROM r WHERE r.CLUSTER = 0
    UNION ALL SELECT CLUSTER, sum(prob) FROM m0 WHERE CLUSTER <> 0 GROUP BY CLUSTER
    HAVING abs(sum(prob) - 1) > 1e-10""",
)
oracle(
    "check_nonnegative",
    """SELECT CLUSTER, ACTION, NEXT_CLUSTER, round(prob - 0.01, 6) AS prob FROM p
    WHERE prob - 0.01 < -1e-12""",
)
oracle(
    "check_square",
    """SELECT CLUSTER AS state, 'row' AS side FROM p WHERE CLUSTER NOT IN
    (SELECT NEXT_CLUSTER FROM p) GROUP BY ALL UNION ALL
    SELECT NEXT_CLUSTER, 'column' FROM p WHERE NEXT_CLUSTER NOT IN (SELECT CLUSTER FROM p)
    GROUP BY ALL""",
)
oracle(
    "check_absorbing",
    """SELECT count(DISTINCT CLUSTER) AS n_states,
    count(DISTINCT CLUSTER) FILTER (WHERE CLUSTER = NEXT_CLUSTER AND prob = 1) AS n_absorbing,
    count(DISTINCT CLUSTER) FILTER (WHERE CLUSTER = NEXT_CLUSTER AND prob = 1) > 0
      AS has_absorbing,
    count(DISTINCT CLUSTER) FILTER (WHERE CLUSTER = NEXT_CLUSTER AND prob = 1)
      = count(DISTINCT CLUSTER) AS is_identity FROM m0""",
)
oracle(
    "check_reachable",
    """SELECT CLUSTER, round(residual, 6) AS residual FROM (
      SELECT CLUSTER, 1 - coalesce(sum(prob) FILTER
        (WHERE NEXT_CLUSTER IN (SELECT END_INDEX FROM dim)), 0) AS residual
      FROM c12 GROUP BY CLUSTER) WHERE residual > 1e-6""",
)
oracle(
    "check_action_row",
    "SELECT DISTINCT CLUSTER, CAST(9 AS INT) AS ACTION, CAST(0 AS DOUBLE) AS total FROM p",
)

# ---------------------------------------------------------------- learning with forced answers

SOFA = "CASE WHEN k % 7 <> 0 THEN total_sofa END"
oracle(
    "initial_states",
    """SELECT count(*) AS n_rows, CAST(3 AS INT) AS n_states, true AS ordered FROM steps
    WHERE RISK IS NOT NULL""",
)
oracle("next_state_classifier", f"SELECT ID, TIME, {SOFA} AS prediction FROM raw_steps")
oracle(
    "next_state_distribution",
    """SELECT ID, TIME, CASE WHEN k % 7 <> 0 THEN (SELECT CAST(max(NEXT_CLUSTER) + 1 AS INT)
    FROM labelled WHERE k % 7 <> 0) END AS n_entries,
    CASE WHEN k % 7 <> 0 THEN true END AS is_whole FROM labelled""",
)
oracle("split_state", "SELECT ID, TIME, CAST(total_sofa >= 2 AS INT) AS SUB FROM steps")
oracle("extend_split", "SELECT ID, TIME, ACTION, CAST(total_sofa >= 2 AS INT) AS SUB FROM steps")
oracle(
    "refine_states",
    """SELECT count(*) AS n_rows, true AS states_are_dense, true AS states_in_range,
    true AS rows_sum_to_1 FROM steps""",
)
oracle("forest_fit", f"SELECT {SOFA} AS prediction, count(*) AS cnt FROM raw_steps GROUP BY 1")
oracle("forest_predict", f"SELECT ID, TIME, {SOFA} AS prediction FROM raw_steps")
oracle(
    "forest_predict_proba",
    f"""SELECT ID, TIME, CAST(c AS INT) AS class, CAST(c = s AS DOUBLE) AS p FROM
    (SELECT ID, TIME, {SOFA} AS s FROM raw_steps) JOIN range(4) t(c) ON s IS NOT NULL
    UNION ALL SELECT ID, TIME, NULL, NULL FROM raw_steps WHERE {SOFA} IS NULL""",
)
oracle(
    "surrogate_tree",
    f"SELECT {SOFA} AS CLUSTER, {SOFA} AS prediction, count(*) AS cnt FROM raw_steps GROUP BY 1",
)
oracle(
    "grid_search",
    """SELECT CAST(unnest([3, 4]) AS INT) AS max_depth, CAST(1 AS DOUBLE) AS mean_accuracy,
    CAST(0 AS DOUBLE) AS std_accuracy, unnest([true, false]) AS best""",
)
oracle(
    "stratified_folds",
    f"""SELECT CAST(place AS INT) AS place, CAST(fold AS INT) AS fold,
    n // 5 + CASE WHEN (fold - place + 5) % 5 < n % 5 THEN 1 ELSE 0 END AS cnt
    FROM (SELECT {SOFA} AS place, count(*) AS n FROM raw_steps
      WHERE {SOFA} IS NOT NULL AND value IS NOT NULL GROUP BY 1), range(5) t(fold)""",
)
oracle(
    "forest_sparse_classes",
    f"""SELECT ID, TIME, CAST(s * 1000000 - 7 AS INT) AS prediction,
    CAST(c * 1000000 - 7 AS INT) AS class, CAST(c = s AS DOUBLE) AS p FROM
    (SELECT ID, TIME, {SOFA} AS s FROM raw_steps) JOIN range(4) t(c) ON s IS NOT NULL
    UNION ALL SELECT ID, TIME, NULL, NULL, NULL FROM raw_steps WHERE {SOFA} IS NULL""",
)
oracle(
    "tree_rules",
    """SELECT 'total_sofa ' || unnest(['<= 0.5', '> 0.5', '<= 1.5', '> 1.5', '<= 2.5', '> 2.5'])
    AS condition""",
)
