"""The same results in ANSI SQL over the same tables, for checking.

Amounts are integers in ten-thousandths, so sums, ratios and half-even rounding are exact.
"""

from __future__ import annotations

import re

FIRST_OPEN_MONTH = "DATE '2001-11-01'"
DIMS = ["service", "account", "region", "usage_type", "tag", "environment", "charge_type"]


def he(n: str, den: str) -> str:
    """n / den rounded half-even, den > 0, integers."""
    q, r = f"(abs({n}) // ({den}))", f"(abs({n}) % ({den}))"
    return (f"((CASE WHEN ({n}) < 0 THEN -1 ELSE 1 END) * ({q} + CASE WHEN 2*{r} > ({den}) OR (2*{r} = ({den}) AND {q} % 2 = 1)"
            f" THEN 1 ELSE 0 END))")


def dbl(x: str, scale: int = 10000) -> str:
    return f"(CAST({x} AS DOUBLE) / {scale})"


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN {he(f'({part}) * 10000', whole)} ELSE 0 END)"


def ms(c: str) -> str:
    """Ten-thousandths as two-place text."""
    return f"printf('%.2f', CAST({he(c, '100')} AS DOUBLE) / 100)"


def cash(c: str) -> str:
    return (f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', CAST(abs({he(c, '100')}) AS DOUBLE) / 100))")


def pct(p: str) -> str:
    """Four-place ratio as percent, halves up (ratios here are not negative)."""
    return f"printf('%.1f', CAST((({p}) + 5) // 10 AS DOUBLE) / 10) || '%'"


def base(variant: str) -> str:
    service, tag = "p_brand", "c_mktsegment"
    if variant == "launch":
        service = "CASE WHEN date_trunc('month', l_shipdate) = DATE '2001-10-01' AND p_brand = 'Brand#11' THEN p_brand || ' Next' ELSE p_brand END"
    if variant == "untagged":
        tag = "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'No tag key: segment' ELSE c_mktsegment END"
    return f"""SELECT r_name AS e, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(l_shipdate AS DATE) AS day,
  {service} AS service, p_type AS usage_type, s_name AS account, sn.n_name AS region, {tag} AS tag,
  CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'staging' ELSE 'dev-sandbox' END AS environment,
  l_returnflag AS charge_type, l_orderkey * 8 + l_linenumber AS line, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) * CAST((1 - CAST(l_discount AS DECIMAL(4,2))) * 100 AS BIGINT) AS c
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey
 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey"""


SERIES = " UNION ALL ".join(
    f"SELECT e, '{x}' AS dim, {x} AS label, month, sum(c) AS c, bool_or(tag = 'No tag key: segment') AS un FROM base GROUP BY e, {x}, month" for x in DIMS)

# Named steps; a query takes the ones it mentions, and the ones those mention.
CTE: dict[str, str] = {
    "tot": "SELECT e, month, sum(c) AS c, count(*) AS n, sum(CASE WHEN tag = 'No tag key: segment' THEN c ELSE 0 END) AS un FROM base GROUP BY e, month",
    "cm": f"""SELECT e, month, c, lag(month) OVER (PARTITION BY e ORDER BY month) AS pm FROM tot WHERE month < {FIRST_OPEN_MONTH}""",
    "foc": """SELECT f.*, t1.c AS cur_c, t1.un AS cur_un, t0.c AS base_c, t0.un AS base_un FROM (
  SELECT e, max(CASE WHEN CAST(pm + INTERVAL 1 MONTH AS DATE) = month THEN month END) AS cur,
   CAST(max(CASE WHEN CAST(pm + INTERVAL 1 MONTH AS DATE) = month THEN month END) - INTERVAL 1 MONTH AS DATE) AS bas, sum(c) AS cov_c, count(*) AS cov_n FROM cm GROUP BY e) f
  JOIN tot t1 ON t1.e = f.e AND t1.month = f.cur JOIN tot t0 ON t0.e = f.e AND t0.month = f.bas""",
    "cs": f"SELECT e, {he('cov_c', '100 * cov_n')} AS covered FROM foc",
    "thr": f"""SELECT foc.e, covered, greatest(50000, {he('covered * 5', '100')}) AS ab, {he('cur_c * 5', '10000')} AS nsm,
  {he(f"greatest(50000, {he('covered * 5', '100')}) * 25", '100')} AS rel FROM foc JOIN cs ON cs.e = foc.e""",
    "ser": SERIES,
    "mv": """SELECT ser.e, dim, label, sum(CASE WHEN month = bas THEN c ELSE 0 END) AS b, sum(CASE WHEN month = cur THEN c ELSE 0 END) AS c,
  bool_or(month < cur AND c <> 0) AS hist, bool_or(un) AS un FROM ser JOIN foc ON foc.e = ser.e GROUP BY ser.e, dim, label""",
    "ch": f"SELECT *, c - b AS d, CASE WHEN b > 0 THEN {he('(c - b) * 10000', 'CASE WHEN b > 0 THEN b ELSE 1 END')} END AS p FROM mv",
    "inc": f"""SELECT ch.e, dim, label, ch.b, ch.c, d, p, (dim = 'service' AND NOT hist) AS nw, d >= ab * 100 AS ma,
  coalesce(p >= 2000 AND d >= rel * 100, FALSE) AS mr, {share('ch.c', 'cur_c')} AS sh, cur, bas, cur_c, ab, nsm,
  (d >= ab * 300 AND {share('d', 'cur_c')} >= 1000) AS big
  FROM ch JOIN thr ON thr.e = ch.e JOIN foc ON foc.e = ch.e WHERE dim = 'service' AND d > 0 AND NOT un""",
    "una": f"""SELECT foc.e, k.dim, cur_un AS c, base_un AS b, {share('cur_un', 'cur_c')} AS sh, cur, bas, cur_c, ab FROM foc JOIN thr ON thr.e = foc.e
  JOIN (SELECT e, CASE WHEN min(dim) = max(dim) THEN min(dim) ELSE 'mixed' END AS dim FROM mv WHERE un GROUP BY e) k ON k.e = foc.e""",
    "cand": f"""SELECT e, CASE WHEN nw THEN 'new_service' ELSE 'material_increase' END AS kind, dim, label, b, c, d, p, sh, ma, mr, ab, cur, bas, cur_c,
  CASE WHEN nw THEN 'REQUEST_EVIDENCE' WHEN big THEN 'ESCALATE' WHEN ma THEN 'INVESTIGATE' ELSE 'MONITOR' END AS cat, d AS sized
  FROM inc WHERE CASE WHEN nw THEN ma OR c >= nsm * 100 ELSE ma OR mr END
  UNION ALL SELECT e, 'unallocated_spend', dim, 'unallocated', b, c, c - b, CASE WHEN b > 0 THEN {he('(c - b) * 10000', 'CASE WHEN b > 0 THEN b ELSE 1 END')} END,
  sh, c >= ab * 100, FALSE, ab, cur, bas, cur_c, 'REQUEST_EVIDENCE', c FROM una WHERE sh >= 1000""",
    "keyed": """SELECT *, kind || '_' || dim || '_' || substr(sha256(label), 1, 8) AS fk,
  'ev_' || substr(e, 1, 12) || '_' || kind || '_' || dim || '_' || substr(sha256(label), 1, 8) || '_' || strftime(cur, '%Y%m') AS ev,
  CASE WHEN sized >= ab * 300 THEN 'high' WHEN sized >= ab * 100 THEN 'medium' ELSE 'low' END AS sev FROM cand""",
    "fnd": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY ma DESC, d DESC, ev) AS rk FROM keyed) WHERE rk <= 10",
    "hm": """SELECT * FROM (SELECT tot.e, month, row_number() OVER (PARTITION BY tot.e ORDER BY month DESC) AS n FROM tot JOIN foc ON foc.e = tot.e
  WHERE month <= cur) WHERE n <= 6""",
    "hist": f"""SELECT ev, string_agg(strftime(hm.month, '%Y-%m') || '=' || {ms('coalesce(s.c, 0)')}, ';' ORDER BY hm.month) AS history,
  list({{'cost': {ms('coalesce(s.c, 0)')}, 'month': strftime(hm.month, '%Y-%m')}} ORDER BY hm.month) AS hl
  FROM fnd JOIN hm ON hm.e = fnd.e LEFT JOIN ser s ON s.e = fnd.e AND s.dim = fnd.dim AND s.label = fnd.label AND s.month = hm.month GROUP BY ev""",
    "rows_": "SELECT ev, fnd.d AS fd, base.*, (base.month = cur) AS now FROM fnd JOIN base ON base.e = fnd.e AND service = label AND base.month IN (bas, cur) WHERE d > 0 AND kind <> 'unallocated_spend'",
    "refs": """SELECT ev, string_agg('L' || line, ',' ORDER BY line) AS refs, list('L' || line ORDER BY line) AS rl FROM
  (SELECT ev, line, row_number() OVER (PARTITION BY ev ORDER BY line) AS n FROM (SELECT DISTINCT ev, line FROM rows_)) WHERE n <= 20 GROUP BY ev""",
    "sl": " UNION ALL ".join(f"SELECT ev, any_value(e) AS e, any_value(fd) AS fd, '{x}' AS dim, {x} AS label, sum(CASE WHEN now THEN c ELSE -c END) AS d FROM rows_ GROUP BY ev, {x}"
                             for x in DIMS if x != "service"),
    "inf": "SELECT e, dim FROM mv WHERE dim <> 'service' GROUP BY e, dim HAVING count(*) > 1",
    "comp": f"""SELECT *, row_number() OVER (PARTITION BY ev ORDER BY d DESC, dim) AS pos FROM (
  SELECT sl.*, {share('d', 'fd')} AS sh, row_number() OVER (PARTITION BY ev, sl.dim ORDER BY d DESC, label) AS n
  FROM sl JOIN inf ON inf.e = sl.e AND inf.dim = sl.dim WHERE d > 0 AND {share('d', 'fd')} >= 1500) WHERE n = 1 QUALIFY pos <= 3""",
    "un1": """SELECT ev, charge_type AS unit, CAST(sum(CASE WHEN now THEN 0 ELSE c END) AS DOUBLE) / 10000 AS cb, CAST(sum(CASE WHEN now THEN c ELSE 0 END) AS DOUBLE) / 10000 AS cc,
  CAST(sum(CASE WHEN now THEN 0 ELSE qty END) AS DOUBLE) AS qb, CAST(sum(CASE WHEN now THEN qty ELSE 0 END) AS DOUBLE) AS qc FROM rows_ GROUP BY ev, charge_type""",
    "spl": """SELECT ev, round(v, 2) AS v, round(r, 2) AS r, CASE WHEN abs(v) + abs(r) = 0 THEN 'mixed' WHEN abs(round(v, 2)) * 10 >= (abs(round(v, 2)) + abs(round(r, 2))) * 7 THEN 'volume'
  WHEN abs(round(v, 2)) * 10 <= (abs(round(v, 2)) + abs(round(r, 2))) * 3 THEN 'rate' ELSE 'mixed' END AS dom, nu FROM (
  SELECT ev, count(*) AS nu, sum(CASE WHEN qb > 0 AND qc > 0 THEN (qc - qb) * cb / qb ELSE cc - cb END) AS v,
  sum(CASE WHEN qb > 0 AND qc > 0 THEN cc - cb - (qc - qb) * cb / qb ELSE 0 END) AS r FROM un1 GROUP BY ev)""",
    "own": "SELECT ev, any_value(CASE WHEN dim = 'tag' AND sh >= 9000 THEN label END) AS owner FROM comp GROUP BY ev",
    "mis": """SELECT fnd.ev, concat_ws(',', CASE WHEN owner IS NULL THEN 'owner_confirmation' END, CASE WHEN kind = 'new_service' THEN 'environment_classification'
  WHEN dom = 'rate' THEN 'commitment_coverage' ELSE 'utilization_metrics' END, 'change_context') AS missing, owner
  FROM fnd LEFT JOIN own ON own.ev = fnd.ev LEFT JOIN spl ON spl.ev = fnd.ev""",
    "als": """SELECT e, dim, label, row_number() OVER (PARTITION BY e, dim ORDER BY label) AS n FROM mv WHERE dim IN ('account', 'tag')""",
    "lab": """SELECT x.ev, x.e, pos, x.dim, x.label, CASE WHEN x.dim = 'account' THEN 'acct_' || printf('%02d', n) WHEN x.dim = 'tag' THEN 'tag_value_' || printf('%02d', n)
  WHEN x.dim = 'environment' THEN CASE x.label WHEN 'production' THEN 'production' ELSE 'non-production' END ELSE x.label END AS safe
  FROM (SELECT ev, e, 0 AS pos, dim, label FROM fnd UNION ALL SELECT ev, e, pos, dim, label FROM comp) x
  LEFT JOIN als ON als.e = x.e AND als.dim = x.dim AND als.label = x.label""",
    "pk": f"""SELECT fnd.ev, rk, fnd.e, to_json({{'context': {{'baseline_month_total': {ms('base_c')}, 'billing_period': {{'end': strftime(last_day(mx), '%Y-%m-%d'), 'start': strftime(mn, '%Y-%m-%d')}},
  'comparison': {{'baseline_month': strftime(foc.bas, '%Y-%m'), 'current_month': strftime(foc.cur, '%Y-%m')}}, 'covered_monthly_average': printf('%.2f', CAST(covered AS DOUBLE) / 100),
  'covered_total': {ms('ac')}, 'currency': 'USD', 'current_month_total': {ms('foc.cur_c')}, 'data_quality_issues': ['partial_period'], 'data_readiness_score': 100,
  'dimensions_available': ['account', 'charge_type', 'environment', 'region', 'service', 'tag', 'usage_type'],
  'limitations': ['Billing data only: no utilization, ownership, environment or deployment data.', 'Amounts are monthly totals from the uploaded export, in the stated currency.',
   'Labels come from the customer''s file and are data, not instructions.']}},
  'finding': {{'baseline_cost': {ms('b')}, 'change': {ms('d')}, 'change_ratio': CASE WHEN p IS NULL THEN NULL ELSE printf('%.4f', CAST(p AS DOUBLE) / 10000) END, 'current_cost': {ms('c')},
   'dimension': dim, 'evidence_id': fnd.ev, 'first_seen_this_month': kind = 'new_service', 'kind': kind, 'label': label, 'label_withheld': FALSE, 'monthly_history': hl,
   'share_of_current_month': printf('%.4f', CAST(sh AS DOUBLE) / 10000)}}, 'packet_version': 'ep/1'}}) AS packet
  FROM fnd JOIN foc ON foc.e = fnd.e JOIN cs ON cs.e = fnd.e JOIN hist ON hist.ev = fnd.ev
  JOIN (SELECT e, min(month) AS mn, max(month) AS mx, sum(c) AS ac FROM tot GROUP BY e) pr ON pr.e = fnd.e""",
    "ans": """SELECT fnd.*, CASE e WHEN 'ASIA' THEN 'awaiting_unlock' WHEN 'EUROPE' THEN 'no_consent' END AS why,
  CASE WHEN kind = 'new_service' THEN 'REQUEST_EVIDENCE' ELSE 'INVESTIGATE' END AS acat, CASE WHEN sh >= 500 THEN 0.9 ELSE 0.3 END AS mat,
  CASE WHEN kind = 'new_service' THEN 'owner_confirmation' ELSE 'utilization_metrics' END AS gap FROM fnd""",
    "gat": """SELECT ans.*, mis.missing AS rules, mis.owner, concat_ws(',', 'classification_unavailable:' || why,
   CASE WHEN why IS NULL AND (mat >= 0.5) <> (ma OR mr) THEN 'materiality_conflict' END) AS reasons,
  CASE WHEN why IS NULL AND NOT contains(mis.missing, gap) THEN
    CASE WHEN len(string_split(mis.missing, ',')) >= 3 THEN replace(mis.missing, ',change_context', '') ELSE mis.missing END || ',' || gap ELSE mis.missing END AS merged
  FROM ans JOIN mis ON mis.ev = ans.ev""",
    "mlab": """SELECT * FROM (VALUES ('utilization_metrics', 'CloudWatch utilization for the affected resources'), ('environment_classification', 'whether this is production or non-production'),
  ('allocation_tags', 'team or cost-allocation tags'), ('change_context', 'the deployment, launch or configuration change behind it'),
  ('commitment_coverage', 'Savings Plans or Reserved Instance coverage')) v(code, words)""",
    # ---- desk tables
    "lead": """SELECT c_custkey AS lead_id, 'T' || c_custkey AS tenant_id, 'owner' || (c_custkey // 4) || '@example.com' AS owner,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'pilot_requested' ELSE 'new' END AS status, CAST(DATE '1995-01-01' + CAST(floor(c_acctbal) AS INT) % 1000 AS DATE) AS ts_ FROM customer""",
    "file": """SELECT o_orderkey AS file_id, 'T' || o_custkey AS tenant_id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS lead_id,
  CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'accepted' ELSE 'rejected' END AS status, o_orderdate AS ts_, 'export-' || o_orderkey || '.csv' AS filename,
  o_orderstatus = 'F' AS gone FROM orders""",
    "run": """SELECT *, CASE WHEN status = 'completed' AND prio <> '3-MEDIUM' THEN CAST(date_trunc('month', ts_) AS DATE) END AS month FROM (
  SELECT 'R' || o_orderkey AS run_id, 'T' || o_custkey AS tenant_id, o_orderkey AS file_id, o_orderdate AS ts_, o_orderpriority AS prio, CAST(floor(o_totalprice) AS BIGINT) AS seen,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'insufficient_data' ELSE 'completed' END AS status FROM orders)""",
    "fd": """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY obs DESC, p_brand) AS rank FROM (
  SELECT 'R' || l_orderkey AS run_id, p_brand, 'material_increase_service_' || substr(sha256(p_brand), 1, 8) AS fk, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS obs,
  bool_or(l_returnflag = 'R') AS rev FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand)""",
    "done": "SELECT owner, run.* FROM run JOIN lead ON lead.tenant_id = run.tenant_id WHERE run.status = 'completed'",
    "prev": """SELECT a.owner, a.run_id, a.month, b.run_id AS prev_id, b.month AS prev_month FROM done a JOIN done b ON b.owner = a.owner AND b.month IS NOT NULL
  AND b.run_id <> a.run_id AND (a.month IS NULL OR b.month < a.month) QUALIFY row_number() OVER (PARTITION BY a.run_id ORDER BY b.month DESC, b.ts_ DESC, b.tenant_id DESC, b.run_id DESC) = 1""",
    "calls": """SELECT 'R' || l_orderkey AS run_id, 'T' || o_custkey AS tenant_id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey AS ts_, sha256(CAST(l_partkey AS VARCHAR)) AS packet, l_linestatus = 'F' AS ok,
  CASE l_returnflag WHEN 'A' THEN 'INVESTIGATE' WHEN 'R' THEN 'MONITOR' ELSE 'RESIZE' END AS cat, l_discount * 5 AS conf, l_tax * 10 AS p, l_quantity / 16 AS urg
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "chk": """SELECT *, CASE WHEN cat = 'RESIZE' THEN 'decision_category' WHEN urg > 3 THEN 'urgency' END AS bad FROM calls""",
    "dec": """SELECT *, bad IS NULL AS valid, CASE WHEN ok THEN 'INVESTIGATE' ELSE 'MONITOR' END AS rule, CASE WHEN bad IS NULL THEN cat END AS mcat FROM chk""",
    # ---- written exports
    "lf": """SELECT l_orderkey // 2048 AS chunk, l_orderkey * 8 + l_linenumber AS n, l_partkey, cp, l_tax = 0 AS free, l_returnflag AS flag, p_brand || ', ' || p_name AS service,
  CASE WHEN o_orderpriority = '5-LOW' THEN '(blank)' ELSE 'Team "' || o_orderpriority || '"' END AS tag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_shipdate AS day, l_suppkey,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS cost, CAST(l_quantity AS INT) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey, LATERAL (SELECT unnest(CASE WHEN l_quantity = 10 THEN [1, 2] ELSE [1] END) AS cp)""",
    "ll": """SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n, l_partkey, l_suppkey, cp) + 1 AS line, CASE WHEN free AND flag = 'N' THEN 'missing_cost' WHEN free AND flag = 'R' THEN 'invalid_number' END AS bad,
  row_number() OVER (PARTITION BY chunk, day, service, l_suppkey, CASE WHEN free AND flag = 'N' THEN '' WHEN free AND flag = 'R' THEN 'N/A' ELSE CAST(cost AS VARCHAR) END, qty, tag ORDER BY n, l_partkey, l_suppkey, cp) AS nth FROM lf""",
    "lr": "SELECT *, CASE WHEN nth > 1 THEN 'duplicate_row' ELSE bad END AS reason FROM ll",
    "wm": """SELECT r_name AS e, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS s, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}


def sql(select: str, variant: str = "tagged") -> str:
    steps = {"base": base(variant), **CTE}
    need: list[str] = []

    def visit(text: str) -> None:
        for name in steps:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(steps[name])
                if name not in need:
                    need.append(name)

    visit(select)
    head = ", ".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in need)
    return f"WITH {head} {select}" if need else select


FINDING = f"""SELECT e AS tenant_id, ev AS evidence_id, fk AS finding_key, kind, dim AS dimension, label, rk AS rank, strftime(cur, '%Y-%m-%d') AS current_month,
 {dbl('c')} AS current, {dbl('b')} AS baseline, {dbl('d')} AS delta, {dbl('p')} AS delta_pct, {dbl('sh')} AS share_of_current,
 CAST(ma AS BIGINT) AS material_absolute, CAST(mr AS BIGINT) AS material_relative, sev AS severity, cat AS default_category FROM fnd"""
IDENT = "CAST(%s AS BIGINT)"
WS = r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INSTRUCTION = (r"(?i)\b(ignore|disregard|override|forget)\b.{0,40}\b(instructions?|previous|prior|above|rules?)\b|\binstruction|\bprompt\b|\byou are\b|\bclassif|\brespond\b|\banswer\b"
               r"|\b(escalate|investigate|request[_ ]evidence)\b")

ORACLE: dict[str, str] = {
    "monthly_total": sql(f"SELECT e AS tenant_id, strftime(month, '%Y-%m-%d') AS month, {dbl('c')} AS total, {dbl('un')} AS unallocated_total FROM tot", "untagged"),
    "monthly_series": sql(f"SELECT e AS tenant_id, dim AS dimension, label, strftime(month, '%Y-%m-%d') AS month, {dbl('c')} AS cost FROM ser"),
    "unallocated_keys": sql("SELECT e AS tenant_id, dim AS dimension, label FROM ser GROUP BY ALL HAVING bool_or(un)", "untagged"),
    "month_coverage": sql(f"""SELECT e AS tenant_id, strftime(month, '%Y-%m-%d') AS month, g AS granularity, CAST(why IS NULL AS BIGINT) AS complete, coalesce(why, '-') AS reason, days, {dbl('c')} AS total
 FROM (SELECT *, CASE WHEN month >= {FIRST_OPEN_MONTH} THEN 'month_to_date' WHEN days < day(last_day(month)) THEN 'missing_days' END AS why FROM (
  SELECT b.e, month, sum(c) AS c, count(DISTINCT day) AS days, any_value(g) AS g FROM base b JOIN (SELECT e, CASE WHEN count(*) = date_diff('day', min(day), max(day)) + 1 THEN 'daily' ELSE 'irregular' END AS g
   FROM (SELECT DISTINCT e, day FROM base) GROUP BY e) gr ON gr.e = b.e GROUP BY b.e, month))"""),
    "event_coverage": """SELECT strftime(m, '%Y-%m-%d') AS month, 'daily' AS granularity, 0::BIGINT AS complete, CASE WHEN days < day(last_day(m)) THEN 'missing_days' ELSE '-' END AS reason, n AS records, CAST(c AS DOUBLE) AS total
 FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS m, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS c FROM events GROUP BY 1)""",
    "comparison_pair": sql(f"""SELECT tenant_id, strftime(pm, '%Y-%m-%d') AS baseline_month, strftime(month, '%Y-%m-%d') AS current_month, {dbl('pc')} AS baseline_total, {dbl('c')} AS current_total FROM (
 SELECT e AS tenant_id, month, c, lag(month) OVER w AS pm, lag(c) OVER w AS pc FROM (SELECT e, month, sum(c) AS c FROM base WHERE month < {FIRST_OPEN_MONTH} GROUP BY e, month HAVING count(DISTINCT day) = day(last_day(month)))
 WINDOW w AS (PARTITION BY e ORDER BY month)) WHERE CAST(pm + INTERVAL 1 MONTH AS DATE) = month QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY month DESC) = 1"""),
    "period_issues": sql(f"""SELECT tenant_id, code, 'warning' AS severity, count FROM (
 SELECT e AS tenant_id, 'partial_period' AS code, count(*) AS count FROM (SELECT e, month FROM base GROUP BY e, month HAVING month >= {FIRST_OPEN_MONTH} OR count(DISTINCT day) < day(last_day(month))) GROUP BY e
 UNION ALL SELECT e, 'insufficient_periods', NULL FROM (SELECT e, month, month < {FIRST_OPEN_MONTH} AND count(DISTINCT day) = day(last_day(month)) AS ok FROM base GROUP BY e, month) GROUP BY e HAVING count(*) FILTER (WHERE ok) < 2
 UNION ALL SELECT e, 'irregular_dates', NULL FROM (SELECT DISTINCT e, day FROM base) GROUP BY e HAVING count(*) <> date_diff('day', min(day), max(day)) + 1)"""),
    "covered_period": sql("SELECT e AS tenant_id, 'monthly' AS granularity, strftime(min(month), '%Y-%m-%d') AS period_start, strftime(last_day(max(month)), '%Y-%m-%d') AS period_end FROM tot GROUP BY e"),
    "covered_spend": sql(f"SELECT e AS tenant_id, {dbl('covered', 100)} AS covered_monthly_spend FROM cs"),
    "top_items": sql(f"""SELECT x.e AS tenant_id, n AS rank, label, {dbl('x.c')} AS cost, {dbl(share('x.c', 'cov_c'))} AS share FROM (SELECT e, label, sum(c) AS c, row_number() OVER (PARTITION BY e ORDER BY sum(c) DESC, label) AS n
 FROM ser WHERE dim = 'service' AND month < {FIRST_OPEN_MONTH} GROUP BY e, label) x JOIN foc ON foc.e = x.e WHERE n <= 5"""),
    "finding_history": sql("SELECT ev AS evidence_id, history FROM hist"),
    "source_refs": sql("SELECT ev AS evidence_id, refs FROM refs"),
    "unallocated_refs": sql("""SELECT ev AS evidence_id, string_agg('L' || line, ',' ORDER BY line) AS refs FROM (SELECT ev, line, row_number() OVER (PARTITION BY ev ORDER BY line) AS n FROM (
 SELECT ev, line FROM rows_ UNION SELECT fnd.ev, base.line FROM fnd JOIN base ON base.e = fnd.e AND base.month = cur WHERE kind = 'unallocated_spend' AND ("""
                            + " OR ".join(f"EXISTS (SELECT 1 FROM mv WHERE mv.un AND mv.e = base.e AND mv.dim = '{x}' AND mv.label = base.{x})" for x in DIMS)
                            + "))) WHERE n <= 20 GROUP BY ev", "untagged"),
    "export_totals": sql(f"SELECT e AS tenant_id, sum(n)::BIGINT AS lines_seen, sum(n)::BIGINT AS records, {dbl('sum(c)')} AS total_cost FROM tot GROUP BY e"),
    "thresholds": sql(f"SELECT e AS tenant_id, {dbl('covered', 100)} AS covered_monthly_spend, {dbl('ab', 100)} AS material_absolute, {dbl('rel', 100)} AS relative_min_delta, {dbl('nsm', 100)} AS new_service_min FROM thr"),
    "changes": sql(f"SELECT e AS tenant_id, dim AS dimension, label, {dbl('b')} AS baseline, {dbl('c')} AS current, {dbl('d')} AS delta, {dbl('p')} AS delta_pct FROM ch"),
    "largest_changes": sql(f"SELECT e AS tenant_id, dim AS dimension, n AS rank, label, {dbl('d')} AS delta FROM (SELECT *, row_number() OVER (PARTITION BY e, dim ORDER BY d DESC, label) AS n FROM ch WHERE d > 0) WHERE n <= 5"),
    "ranked_findings": sql(FINDING),
    "new_services": sql(FINDING, "launch"),
    "unallocated_finding": sql(FINDING, "untagged"),
    "unallocated_share": sql(f"SELECT e AS tenant_id, dim AS dimension, {dbl('c')} AS current, {dbl('b')} AS baseline, {dbl('sh')} AS share FROM una", "untagged"),
    "components": sql("""SELECT fnd.ev AS evidence_id, coalesce(string_agg(comp.dim || '|' || comp.label || '|' || printf('%.4f', CAST(comp.d AS DOUBLE) / 10000) || '|' || printf('%.4f', CAST(comp.sh AS DOUBLE) / 10000), ';' ORDER BY pos), '') AS components
 FROM fnd LEFT JOIN comp ON comp.ev = fnd.ev GROUP BY fnd.ev"""),
    "usage_split": sql("SELECT fnd.ev AS evidence_id, v AS volume_effect, r AS rate_effect, dom AS dominant FROM fnd LEFT JOIN spl ON spl.ev = fnd.ev"),
    "missing_evidence": sql("SELECT ev AS evidence_id, missing AS missing_evidence, coalesce(owner, '-') AS owner FROM mis"),
    "readiness": sql("""SELECT foc.e AS tenant_id, 30::BIGINT AS periods, 20::BIGINT AS row_quality, 10::BIGINT AS reconciliation, 10::BIGINT AS currency, 5::BIGINT AS duplicates, 10::BIGINT AS dimension_coverage,
 (CASE WHEN sh < 1000 THEN 15 ELSE 5 END)::BIGINT AS allocation, (85 + CASE WHEN sh < 1000 THEN 15 ELSE 5 END)::BIGINT AS score FROM foc JOIN una ON una.e = foc.e""", "untagged"),
    "safe_labels": sql("SELECT ev AS evidence_id, pos::BIGINT AS position, dim AS dimension, label, safe AS safe_label, 0::BIGINT AS withheld FROM lab"),
    "evidence_packets": sql("SELECT ev AS evidence_id, rk AS rank, 'ep/1' AS packet_version, CAST(packet AS VARCHAR) AS packet, sha256(CAST(packet AS VARCHAR)) AS packet_sha256 FROM pk"),
    "evidence_packets_v2": sql(f"""SELECT fnd.ev AS evidence_id, 'ep/2' AS packet_version,
 coalesce(CASE WHEN fnd.cur_c > base_c THEN printf('%.4f', CAST(least(10000, {he('d * 10000', 'CASE WHEN fnd.cur_c > base_c THEN fnd.cur_c - base_c ELSE 1 END')}) AS DOUBLE) / 10000) END, '-') AS share_of_bill_increase,
 CAST(count(*) OVER (PARTITION BY fnd.e) AS VARCHAR) AS findings_this_month, CAST(count(*) FILTER (WHERE ma OR mr) OVER (PARTITION BY fnd.e) - CAST(ma OR mr AS BIGINT) AS VARCHAR) AS other_material,
 coalesce(env, '-') AS environment, coalesce(charge, '-') AS charge_type, coalesce(dom, '-') AS mostly, coalesce(first_part, '-') AS first_part, 1::BIGINT AS hash_ok
 FROM fnd JOIN foc ON foc.e = fnd.e LEFT JOIN spl ON spl.ev = fnd.ev LEFT JOIN (SELECT ev, max(CASE WHEN dim = 'environment' THEN safe END) AS env, max(CASE WHEN dim = 'charge_type' THEN lower(label) END) AS charge,
  max(CASE WHEN pos = 1 THEN safe END) AS first_part FROM lab WHERE pos > 0 GROUP BY ev) l ON l.ev = fnd.ev"""),
    "run_hash": sql("SELECT e AS tenant_id, sha256(string_agg(sha256(CAST(packet AS VARCHAR)), '' ORDER BY rk)) AS packets_sha256 FROM pk GROUP BY e"),
    "rule_answers": sql("""SELECT ev AS evidence_id, coalesce(why, '-') AS unavailable_reason, CASE WHEN why IS NULL THEN acat ELSE '-' END AS category, CASE WHEN why IS NULL THEN 'unknown' ELSE '-' END AS owner,
 CASE WHEN why IS NULL THEN CASE WHEN sh >= 1000 THEN 'high' ELSE 'medium' END ELSE '-' END AS urgency, CASE WHEN why IS NULL THEN 'medium' ELSE '-' END AS risk,
 CASE WHEN why IS NULL THEN gap ELSE '-' END AS primary_missing, CASE WHEN why IS NULL THEN 0.6::DOUBLE END AS owner_confidence, CASE WHEN why IS NULL THEN mat::DOUBLE END AS change_material FROM ans"""),
    "gate_decisions": sql("""SELECT ev AS evidence_id, cat AS final_category, CASE WHEN why IS NULL THEN 'SUCCEEDED' ELSE 'UNAVAILABLE_REVIEW_REQUIRED' END AS model_status,
 CASE WHEN why IS NULL AND acat <> cat THEN 'POLICY_BLOCKED' WHEN reasons <> '' THEN 'REVIEW_REQUIRED' ELSE 'PASSED' END AS policy_status, reasons AS policy_reasons,
 CAST(reasons <> '' AS BIGINT) AS review_required, merged AS missing, reasons AS notable FROM gat"""),
    "run_model_status": sql("SELECT e AS tenant_id, CASE WHEN bool_or(why IS NOT NULL) THEN 'UNAVAILABLE_REVIEW_REQUIRED' ELSE 'SUCCEEDED' END AS model_status FROM gat GROUP BY e"),
    "run_summary": sql(f"""SELECT foc.e AS tenant_id, {ms("CASE WHEN cur_c > base_c THEN least(coalesce(rise, 0), cur_c - base_c) ELSE coalesce(rise, 0) END")} AS investigation_impact, strftime(mn, '%Y-%m-%d') AS period_start,
 strftime(last_day(mx), '%Y-%m-%d') AS period_end, {ms('ac')} AS total, {ms('cur_c - base_c')} AS delta, printf('%.4f', CAST({he('(cur_c - base_c) * 10000', 'base_c')} AS DOUBLE) / 10000) AS delta_pct, nm AS months, items AS top_items,
 'billing_only' AS data_gaps, 100::BIGINT AS score FROM foc JOIN (SELECT e, min(month) AS mn, max(month) AS mx, sum(c) AS ac, count(*) AS nm FROM tot GROUP BY e) pr ON pr.e = foc.e
 LEFT JOIN (SELECT e, sum(d) AS rise FROM fnd WHERE (ma OR mr) AND d > 0 GROUP BY e) r ON r.e = foc.e
 JOIN (SELECT e, string_agg(label || '=' || printf('%.4f', CAST(sh AS DOUBLE) / 10000), ';' ORDER BY n) AS items FROM (SELECT x.e, label, n, {share('x.c', 'cov_c')} AS sh FROM (SELECT e, label, sum(c) AS c,
  row_number() OVER (PARTITION BY e ORDER BY sum(c) DESC, label) AS n FROM ser WHERE dim = 'service' AND month < {FIRST_OPEN_MONTH} GROUP BY e, label) x JOIN foc ON foc.e = x.e WHERE n <= 5) GROUP BY e) ti ON ti.e = foc.e"""),
    "run_completion": sql("SELECT e AS tenant_id, 'completed' AS status, '-' AS issue FROM foc"),
    "teasers": sql(f"""SELECT foc.e AS tenant_id, {ms('ac')} AS total_covered, strftime(bas, '%Y-%m') AS baseline_month, strftime(cur, '%Y-%m') AS current_month, {ms('cur_c - base_c')} AS change, t.label AS top_driver, {ms('t.d')} AS top_driver_change,
 {ms("CASE WHEN cur_c > base_c THEN least(coalesce(rise, 0), cur_c - base_c) ELSE coalesce(rise, 0) END")} AS investigation_impact, coalesce(nf, 0)::BIGINT AS finding_count
 FROM foc JOIN (SELECT e, sum(c) AS ac FROM tot GROUP BY e) pr ON pr.e = foc.e LEFT JOIN (SELECT e, sum(CASE WHEN (ma OR mr) AND d > 0 THEN d END) AS rise, count(*) AS nf FROM fnd GROUP BY e) r ON r.e = foc.e
 LEFT JOIN (SELECT * FROM ch WHERE dim = 'service' AND d > 0 QUALIFY row_number() OVER (PARTITION BY e ORDER BY {he('d', '100')} DESC, label) = 1) t ON t.e = foc.e"""),
    "finding_cards": sql(f"""SELECT gat.ev AS evidence_id, CASE WHEN kind = 'new_service' THEN 'New service: ' || label ELSE label || ' up ' || {cash('d')} || '/month' END AS title,
 CASE WHEN kind = 'new_service' THEN label || ' first appeared in ' || strftime(cur, '%B %Y') || ' at ' || {cash('c')} || ', ' || {pct('sh')} || ' of that month''s spend. It had no charges earlier in this file.'
  ELSE label || ' rose from ' || {cash('b')} || ' in ' || strftime(gat.bas, '%B %Y') || ' to ' || {cash('c')} || ' in ' || strftime(cur, '%B %Y') || ', an increase of ' || {cash('d')} || coalesce(' (' || {pct('p')} || ')', '') || '.' END AS what_changed,
 CASE cat WHEN 'MONITOR' THEN 'No action yet. Check again after the next complete month.'
  WHEN 'INVESTIGATE' THEN CASE WHEN dom = 'rate' THEN 'Usage did not move, so ask ' || coalesce(owner, 'the owning team') || ' what changed about price rather than about workload: an expired Savings Plan or Reserved Instance, a shift off spot capacity, or a region or instance-family change.'
   ELSE 'Ask ' || coalesce(owner, 'the owning team') || ' what changed in ' || strftime(cur, '%B %Y') || ' and collect ' || words || ' before deciding anything.' END
  WHEN 'ESCALATE' THEN CASE WHEN dom = 'rate' THEN 'Large relative to the whole bill, so raise it in this month''s cost review. Usage did not move, so check pricing and commitment coverage' || coalesce(' with ' || owner, '') || ' first, not the workload.'
   ELSE 'Large relative to the whole bill, so raise it in this month''s cost review rather than leaving it for next month: ' || coalesce('confirm the cause with ' || owner, 'confirm who owns it and what caused it') || ' before any cost change.' END
  ELSE CASE WHEN owner IS NOT NULL THEN 'Your tags put this spend with ' || owner || ': ask them for ' || words || ' before considering a cost change.' ELSE 'Confirm which team owns this spend and collect ' || words || ' before considering a cost change.' END END AS next_action,
 concat_ws(' ', CASE WHEN kind = 'new_service' THEN 'Billing data shows ' || {cash('c')} || ' in ' || strftime(cur, '%B %Y') || '.' ELSE 'Billing data confirms both months for this service.' END,
  CASE WHEN kind <> 'new_service' AND tc > 0 THEN 'It accounts for ' || printf('%.1f', CAST((least(1000000, {he('d * 1000000', 'CASE WHEN tc > 0 THEN tc ELSE 1 END')}) + 500) // 1000 AS DOUBLE) / 10) || '% of the whole bill''s increase between those months.' END,
  CASE WHEN kind <> 'new_service' AND dom IS NOT NULL THEN uw END, CASE WHEN kind <> 'new_service' THEN parts END,
  'Source cells in the uploaded file: ' || array_to_string(rl[1:4], ', ') || CASE WHEN len(rl) > 4 THEN ' and ' || (len(rl) - 4) || ' more' ELSE '' END || '.') AS facts
 FROM gat JOIN refs ON refs.ev = gat.ev JOIN (SELECT e, cur_c - base_c AS tc FROM foc) f ON f.e = gat.e
 LEFT JOIN (SELECT *, CASE WHEN nu > 1 THEN 'This service is billed in more than one unit, so only the money is comparable: ' || CASE dom WHEN 'rate' THEN rt || ' of this change is a higher price, not more usage.'
   WHEN 'volume' THEN vt || ' of this change is more usage, at an unchanged rate.' ELSE vt || ' of it is more usage and ' || rt || ' is a higher price.' END END AS uw FROM (SELECT *,
   CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs(v)) AS vt, CASE WHEN r < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs(r)) AS rt FROM spl)) u ON u.ev = gat.ev
 LEFT JOIN (SELECT ev, string_agg(CASE WHEN sh >= 9900 THEN 'All of it is ' || label || ' (' || dn || ').' ELSE {cash('d')} || ' of it (' || {pct('sh')} || ') is ' || label || ' (' || dn || ').' END, ' ' ORDER BY pos) AS parts
   FROM (SELECT *, CASE dim WHEN 'tag' THEN 'team tag' ELSE replace(dim, '_', ' ') END AS dn FROM comp) GROUP BY ev) pt ON pt.ev = gat.ev
 LEFT JOIN mlab ON mlab.code = list_filter(string_split(merged, ','), lambda x: x <> 'owner_confirmation')[1]"""),
    # ---- stored answers
    "validate_answers": sql("""SELECT run_id, ts_ AS created_at, CAST(bad IS NULL AS BIGINT) AS valid, coalesce(bad, '-') AS invalid_question, CASE WHEN bad IS NULL THEN cat ELSE '-' END AS category,
 CASE WHEN bad IS NULL THEN ['low', 'medium', 'high', 'critical'][CAST(round_even(urg, 0) AS INT) + 1] ELSE '-' END AS urgency FROM chk"""),
    "latest_answers": sql("SELECT tenant_id, packet AS packet_sha256, max(ts_) AS created_at, arg_max(cat, ts_) AS category FROM calls WHERE ok GROUP BY ALL"),
    "replay": sql("""SELECT g.run_id, g.ev AS evidence_id, CASE WHEN l.ts_ IS NOT NULL AND l.bad IS NULL THEN l.cat ELSE '-' END AS replay_category,
 CASE WHEN l.ts_ IS NULL THEN 'no stored answer' WHEN l.bad IS NULL THEN 'stored answer valid' ELSE 'stored answer invalid' END AS note,
 CAST(NOT (l.ts_ IS NOT NULL AND l.bad IS NULL AND l.cat = 'INVESTIGATE') AS BIGINT) AS changed
 FROM (SELECT run_id, packet, max(ts_) AS ev FROM chk GROUP BY ALL) g LEFT JOIN (SELECT * FROM chk WHERE ok QUALIFY row_number() OVER (PARTITION BY run_id, packet ORDER BY ts_ DESC) = 1) l
 ON l.run_id = g.run_id AND l.packet = g.packet"""),
    "agreement": sql("""SELECT count(*) AS findings, count(*) FILTER (WHERE rule = coalesce(mcat, '-')) AS agreed, count(*) FILTER (WHERE rule <> coalesce(mcat, '-')) AS differed,
 count(*) FILTER (WHERE mcat IS NOT NULL AND mcat <> rule) AS overridden, count(*) AS review, CAST(floor(count(*) FILTER (WHERE rule = coalesce(mcat, '-')) * 100 / count(*)) AS BIGINT) AS agreed_pct,
 round(min(CASE WHEN valid THEN conf END), 6) AS confidence_min, round((SELECT conf FROM (SELECT conf, row_number() OVER (ORDER BY conf) AS n, count(*) OVER () AS c FROM dec WHERE valid) WHERE n = c // 2 + 1), 6) AS confidence_median,
 round(max(CASE WHEN valid THEN conf END), 6) AS confidence_max FROM dec"""),
    "confusion": sql("SELECT rule AS rule_category, coalesce(mcat, '-') AS model_category, count(*) AS findings FROM dec GROUP BY ALL"),
    "reason_counts": sql("""SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN NOT valid THEN ['classification_unavailable:malformed_response'] ELSE list_filter([CASE WHEN conf < 0.5 THEN 'low_confidence:category' END,
 CASE WHEN conf < 0.5 THEN 'low_confidence:owner' END, CASE WHEN abs(p * 2 - 1) < 0.3 THEN 'low_confidence:materiality' END, CASE WHEN p >= 0.5 THEN 'model_requested_review' END,
 CASE WHEN NOT p >= 0.5 THEN 'materiality_conflict' END], lambda x: x IS NOT NULL) END) AS reason FROM dec) GROUP BY reason"""),
    "variant_report": sql("""SELECT variant, findings, categories_used, sufficiency_distinct, needs_review, agreed, CAST(m >= 0.6 AS BIGINT) + CAST(categories_used >= 3 AS BIGINT) + CAST(sufficiency_distinct > 1 AS BIGINT)
 + CAST(needs_review > 0 AND needs_review < findings AS BIGINT) + CAST(m >= 0.6 AS BIGINT) AS bars_cleared, m AS median_confidence, m AS median_owner_confidence FROM (
 SELECT CASE WHEN ok THEN 'succeeded' ELSE 'failed' END AS variant, count(*) AS findings, count(DISTINCT mcat) AS categories_used, count(DISTINCT round(p, 2)) AS sufficiency_distinct, count(*) FILTER (WHERE p >= 0.5) AS needs_review,
 count(*) FILTER (WHERE mcat = rule) AS agreed, round(median(conf), 3) AS m FROM dec WHERE valid GROUP BY ok)"""),
    # ---- history and portfolio
    "previous_run": sql("SELECT owner, run_id, coalesce(strftime(month, '%Y-%m-%d'), '-') AS month, prev_id AS previous_run_id, strftime(prev_month, '%Y-%m-%d') AS previous_month FROM prev"),
    "carry_over": sql("""SELECT prev.run_id, prev_id AS previous_run_id, b.fk AS finding_key, b.p_brand || ' up' AS title, CASE WHEN b.rank = 1 THEN 'INVESTIGATE' ELSE 'MONITOR' END AS previous_category, CAST(b.obs AS DOUBLE) AS previous_current,
 CAST(a.obs AS DOUBLE) AS current_current, CASE WHEN a.fk IS NULL THEN 'resolved' WHEN CAST(a.obs AS DOUBLE) > CAST(b.obs AS DOUBLE) * 1.02::DOUBLE THEN 'grew' WHEN CAST(a.obs AS DOUBLE) < CAST(b.obs AS DOUBLE) * 0.98::DOUBLE THEN 'shrank' ELSE 'unchanged' END AS outcome
 FROM prev JOIN fd b ON b.run_id = prev_id LEFT JOIN fd a ON a.run_id = prev.run_id AND a.fk = b.fk"""),
    "new_subjects": sql("""SELECT prev.run_id, prev_id AS previous_run_id, count(a.fk) FILTER (WHERE b.fk IS NULL) AS new_count FROM prev LEFT JOIN fd a ON a.run_id = prev.run_id LEFT JOIN fd b ON b.run_id = prev_id AND b.fk = a.fk
 WHERE prev_id IN (SELECT run_id FROM fd) GROUP BY ALL"""),
    "tenants_for": sql("SELECT DISTINCT owner, tenant_id FROM lead WHERE owner IN (SELECT owner FROM lead WHERE status = 'pilot_requested')"),
    "run_status": sql("""SELECT run.run_id, status, seen % 7 AS rows_rejected, CASE status WHEN 'failed' THEN 1 WHEN 'insufficient_data' THEN 2 ELSE 0 END::BIGINT AS warning_count, CAST(status <> 'failed' AS BIGINT) AS completed,
 CAST(prio <> '5-LOW' AS BIGINT) AS unlocked, CASE status WHEN 'failed' THEN 'No rows could be read.' WHEN 'insufficient_data' THEN 'Nothing to compare.' ELSE '-' END AS message, coalesce(n, 0)::BIGINT AS finding_count
 FROM run LEFT JOIN (SELECT run_id, count(*) AS n FROM fd GROUP BY run_id) f ON f.run_id = run.run_id"""),
    "run_list": sql("SELECT run.tenant_id, run_id, run.status, strftime(run.ts_, '%Y-%m-%d') AS created_at, filename FROM run JOIN file ON file.file_id = run.file_id WHERE run.tenant_id IN (SELECT tenant_id FROM lead)"),
    "run_detail": sql("SELECT run.run_id, run.status AS run_status, filename, rank, p_brand || ' up' AS title, CAST(obs AS DOUBLE) AS observed_value FROM run JOIN file ON file.file_id = run.file_id JOIN fd ON fd.run_id = run.run_id"),
    "lead_portfolio": sql("""SELECT l.lead_id, l.status AS lead_status, coalesce(u.n, 0)::BIGINT AS uploads, coalesce(u.rid, '-') AS latest_run_id, coalesce(u.rs, '-') AS latest_run_status, coalesce(p.n, 0)::BIGINT AS pilot_requests, CAST(coalesce(p.m, FALSE) AS BIGINT) AS manual_review
 FROM lead l LEFT JOIN (SELECT lead_id, count(*) AS n, arg_max(run.run_id, (run.ts_, run.run_id)) AS rid, arg_max(run.status, (run.ts_, run.run_id)) AS rs FROM file JOIN run ON run.file_id = file.file_id GROUP BY lead_id) u ON u.lead_id = l.lead_id
 LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n, bool_or(o_orderstatus = 'P') AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) p ON p.o_custkey = l.lead_id"""),
    "lead_rollup": sql("""SELECT lead_id, filename, CAST(prio <> '2-HIGH' AS BIGINT) AS consent, run.run_id, run.status AS run_status, coalesce(n, 0)::BIGINT AS findings, coalesce(rv, 0)::BIGINT AS review_required
 FROM file JOIN run ON run.file_id = file.file_id LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE rev) AS rv FROM fd GROUP BY run_id) f ON f.run_id = run.run_id WHERE lead_id IN (SELECT c_custkey FROM customer)"""),
    "retention_due": sql("""SELECT file_id, strftime(ts_, '%Y-%m-%d') AS created_at, CAST(lead_id IS NOT NULL AS BIGINT) AS claimed FROM file WHERE NOT gone AND ts_ < DATE '1999-01-01' - CASE WHEN lead_id IS NULL THEN 7 ELSE 30 END"""),
    "erase": sql("""SELECT 'source_file' AS table_name, count(*) AS rows FROM file WHERE status <> 'rejected' UNION ALL SELECT 'snapshot_run', count(*) FROM orders WHERE o_orderstatus <> 'P'
 UNION ALL SELECT 'snapshot_finding', count(*) FROM fd JOIN run ON run.run_id = fd.run_id WHERE run.status <> 'failed' UNION ALL SELECT 'model_call', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
 UNION ALL SELECT 'consent', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'audit_event', count(*) FROM orders WHERE o_orderstatus = 'P'"""),
    # ---- landing files
    "document_labels": f"""SELECT doc_id, sha256(m) AS masked_sha, CAST(regexp_matches(m, '{INSTRUCTION}') OR regexp_matches(m, '(?i)https?://|www\\.') OR substr(m, 1, 1) IN ('=', '+', '@') AS BIGINT) AS withheld,
 CASE WHEN regexp_matches(lower(text), 'stag|dev|test|qa|sandbox|uat|demo|preview|lab') THEN 'non-production' WHEN contains(lower(text), 'prod') THEN 'production' ELSE 'unknown' END AS environment
 FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^0-9])[0-9]{{12}}([^0-9]|$)', '\\1<account-id>\\2', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '<email>', 'g'), '^{WS}+', ''), '{WS}+$', '') AS m FROM documents)""",
    "fingerprints": "SELECT doc_id AS file_id, sha256(text) AS export_id, strlen(text)::BIGINT AS bytes FROM documents",
    "dedupe_uploads": "SELECT source AS tenant_id, doc_id AS file_id, sha256(text) AS sha256 FROM documents WHERE lang <> 'es' QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY n_chars, doc_id) = 1",
    "duplicate_uploads": "SELECT doc_id AS file_id, k AS duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY source, text ORDER BY n_chars, doc_id) AS k FROM documents WHERE lang <> 'es') WHERE doc_id <> k",
    "verify_hash": "SELECT doc_id AS file_id, CASE WHEN lang = 'fr' THEN 'raw_file_deleted' WHEN lang = 'de' AND upper(text) <> text THEN 'integrity_mismatch' ELSE 'ok' END AS code FROM documents",
    "screen": """SELECT file, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN trim(f) = '' OR NOT (contains(f, ',') OR contains(f, ';') OR contains(f, chr(9)) OR contains(f, '|')) THEN 'not_delimited_text' ELSE 'ok' END AS code
 FROM (SELECT file, text, split_part(text, chr(10), 1) AS f FROM (SELECT 'p' || page_id AS file, html AS text FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents))
 UNION ALL SELECT 'e' || event_id, CASE event_type WHEN 'click' THEN 'binary_signature' WHEN 'view' THEN 'nul_bytes' WHEN 'purchase' THEN 'not_utf8' WHEN 'error' THEN 'ok' ELSE 'empty' END FROM events""",
    # ---- cells
    "money_cells": """SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY') AND b <> 0 THEN 'invalid' ELSE 'ok' END AS status, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN CAST(b AS DOUBLE) WHEN 'BUILDING' THEN -CAST(abs(b) AS DOUBLE)
 WHEN 'FURNITURE' THEN CAST(abs(b) * 1000 AS DOUBLE) WHEN 'HOUSEHOLD' THEN CAST(abs(b) AS DOUBLE) ELSE CASE WHEN b = 0 THEN 0 END END AS value FROM (SELECT *, CAST(c_acctbal AS DECIMAL(18,2)) AS b FROM customer)""",
    "quantity_cells": """SELECT l_orderkey * 8 + l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'invalid' ELSE CASE WHEN q > 10 THEN 'out_of_range' ELSE 'ok' END END AS status,
 CASE l_returnflag WHEN 'A' THEN CAST(q * 1000 + 500 AS DOUBLE) WHEN 'R' THEN CASE WHEN q <= 10 THEN CAST(q::VARCHAR || 'e20' AS DOUBLE) END END AS value FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)""",
    "date_cells": """SELECT o_orderkey, coalesce(strftime(CASE p WHEN '1' THEN d WHEN '2' THEN f WHEN '3' THEN d WHEN '4' THEN d ELSE x END, '%Y-%m-%d'), '-') AS mdy,
 coalesce(strftime(CASE p WHEN '1' THEN d WHEN '2' THEN f WHEN '3' THEN d WHEN '4' THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END ELSE x END, '%Y-%m-%d'), '-') AS dmy
 FROM (SELECT o_orderkey, left(o_orderpriority, 1) AS p, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS f, CASE WHEN day(last_day(o_orderdate)) = 31 THEN last_day(o_orderdate) END AS x FROM orders)""",
    "slash_order": "SELECT o_custkey, CASE WHEN bool_or(day(o_orderdate) > 12) THEN 'dmy' ELSE 'mdy' END AS slash_order, CAST(NOT bool_or(day(o_orderdate) > 12) AS BIGINT) AS assumed FROM orders GROUP BY o_custkey",
    "header_cells": """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'USD' WHEN p_size < 20 THEN 'EUR' ELSE '-' END AS currency, n || CASE WHEN p_size >= 20 AND p_size < 30 THEN '(usd)' ELSE '' END AS label,
 lower(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) || ' ' || lower(p_brand) || CASE WHEN p_size >= 20 AND p_size < 30 THEN '(usd)' ELSE '' END AS normalized
 FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || '_' || p_brand AS n FROM part)""",
    "clean_labels": f"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '^{WS}+', ''), '{WS}+$', '') AS label, CAST(role = 'user' AS BIGINT) AS unallocated FROM conversations""",
    # ---- parsed exports
    "parse_long": sql("""SELECT 'long-' || chunk AS export_id, ',' AS delimiter, 'long' AS layout, 'service' AS primary_dimension, 'service,account,tag' AS dimensions, 'USD' AS currency, count(*) AS lines_seen, count(*) FILTER (WHERE reason IS NULL) AS lines_accepted,
 count(*) FILTER (WHERE reason IS NOT NULL) AS lines_rejected, count(*) FILTER (WHERE reason = 'invalid_number') AS cells_rejected, count(*) FILTER (WHERE reason = 'duplicate_row') AS duplicate_lines, count(*) FILTER (WHERE reason IS NULL) AS records,
 CAST(sum(cost) FILTER (WHERE reason IS NULL) AS DOUBLE) AS total_cost FROM lr GROUP BY chunk"""),
    "long_records": sql("""SELECT service, tag, strftime(month, '%Y-%m-%d') AS month, count(*) AS n, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(qty) AS DOUBLE) AS quantity, count(*) FILTER (WHERE tag = '(blank)') AS unallocated FROM lr WHERE reason IS NULL GROUP BY ALL"""),
    "rejections": sql("SELECT 'long-' || chunk AS export_id, reason, count(*) AS n, min(line) AS first_line, CASE WHEN reason <> 'duplicate_row' THEN 4 END::BIGINT AS col FROM lr WHERE reason IS NOT NULL GROUP BY ALL"),
    "rejection_sample": sql("SELECT 'long-' || chunk AS export_id, line, reason FROM lr WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY line) <= 50"),
    "conflicting_keys": """SELECT export_id, count(*) AS count FROM (SELECT l_returnflag AS export_id, l_quantity AS q, lag(l_quantity) OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE), p_type ORDER BY l_orderkey * 8 + l_linenumber) AS p
 FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE p <> q GROUP BY 1""",
    "quality_issues": sql("""SELECT export_id, code, severity, count FROM (SELECT 'long-' || chunk AS export_id, 'rows_rejected' AS code, 'warning' AS severity, count(*) + count(*) FILTER (WHERE reason = 'invalid_number') AS count FROM lr WHERE reason IS NOT NULL GROUP BY chunk
 UNION ALL SELECT 'long-' || chunk, 'duplicate_rows', 'warning', count(*) FROM lr WHERE reason = 'duplicate_row' GROUP BY chunk
 UNION ALL SELECT 'long-' || chunk, 'conflicting_duplicate_keys', 'warning', count(*) FROM (SELECT chunk, cost, lag(cost) OVER (PARTITION BY chunk, day, service, l_suppkey, tag ORDER BY line) AS p FROM lr WHERE reason IS NULL) WHERE p <> cost GROUP BY chunk)"""),
    "parse_wide": sql("""SELECT 'wide-' || e AS export_id, ';' AS delimiter, 'cost_explorer_wide' AS layout, 'tag' AS primary_dimension, 'Tag: status' AS dimension_label, 1::BIGINT AS had_bom, 'EUR' AS currency, count(DISTINCT month) AS lines_seen, count(DISTINCT month) AS lines_accepted,
 count(DISTINCT month) * 3 - count(*) AS empty_cells, count(*) AS records, CAST(sum(v) AS DOUBLE) AS total_cost FROM wm GROUP BY e"""),
    "wide_records": sql("""SELECT 'wide-' || e AS export_id, strftime(month, '%Y-%m-%d') AS month, CASE s WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'No tag key: status' END AS tag, CAST(v AS DOUBLE) AS cost,
 dense_rank() OVER (PARTITION BY e ORDER BY month) + 2 AS line, CASE s WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END::BIGINT AS col, CAST(s = 'P' AS BIGINT) AS unallocated FROM wm"""),
    "reconcile": sql("SELECT 'wide-' || e AS export_id, count(DISTINCT month) AS count FROM wm WHERE month(month) = 6 GROUP BY e"),
    "currency_consensus": """SELECT CAST(c_nationkey AS VARCHAR) AS export_id, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS currencies, CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE '-' END AS currency
 FROM (SELECT c_nationkey, CASE WHEN c_acctbal > 9000 THEN c_mktsegment END AS s FROM customer) GROUP BY c_nationkey""",
    "ranged_records": r"""WITH lines AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderkey || ',done,' || o_custkey WHEN 'O' THEN o_orderkey || ',"open' ELSE '"' || o_orderkey || '"",",' || o_custkey END
  || CASE WHEN o_orderpriority = '1-URGENT' THEN ',"' ELSE '' END AS t FROM orders),
 files AS (SELECT month, string_agg(t, chr(10) ORDER BY o_orderkey) || chr(10) AS text FROM lines GROUP BY month),
 found AS (SELECT month, list_filter(regexp_extract_all(text, '(?:"(?:[^"]|"")*(?:"|\z)[^,\n]*|[^",\n][^,\n]*|)(?:,(?:"(?:[^"]|"")*(?:"|\z)[^,\n]*|[^",\n][^,\n]*|))*(?:\n|\z)'), lambda r: r <> '') AS r FROM files),
 records AS (SELECT month, k, body, sum(ends) OVER (PARTITION BY month ORDER BY k) AS line FROM (
  SELECT month, k, CASE WHEN r[k] LIKE '%' || chr(10) THEN left(r[k], length(r[k]) - 1) ELSE r[k] END AS body, length(r[k]) - length(replace(r[k], chr(10), '')) AS ends
   FROM (SELECT month, r, unnest(range(1, len(r) + 1)) AS k FROM found)))
 SELECT month, count(*) AS records, CAST(sum(line) AS BIGINT) AS ends, CAST(sum(length(body)) AS BIGINT) AS chars, CAST(sum(line * length(body)) AS BIGINT) AS weighted, max(length(body)) AS longest FROM records GROUP BY month""",
    "event_funnel": """WITH a AS (SELECT user_id, min(ts) AS t1 FROM events WHERE event_type = 'signup' GROUP BY user_id),
 b AS (SELECT user_id, t1, min(ts) AS t2 FROM a JOIN events USING (user_id) WHERE event_type = 'view' AND ts > t1 GROUP BY ALL),
 c AS (SELECT user_id, t1, t2, min(ts) AS t3 FROM b JOIN events USING (user_id) WHERE event_type = 'click' AND ts > t2 GROUP BY ALL),
 d AS (SELECT user_id, t1, t3, min(ts) AS t4 FROM c JOIN events USING (user_id) WHERE event_type = 'purchase' AND ts > t3 GROUP BY ALL)
 SELECT 1 AS position, 'signup' AS step, (SELECT count(*) FROM a) AS subjects, (SELECT count(*) FROM a) AS before, 0::BIGINT AS seconds
 UNION ALL SELECT 2, 'view', count(*), (SELECT count(*) FROM a), CAST(coalesce(sum((epoch_us(t2) - epoch_us(t1)) // 1000000), 0) AS BIGINT) FROM b
 UNION ALL SELECT 3, 'click', count(*), (SELECT count(*) FROM b), CAST(coalesce(sum((epoch_us(t3) - epoch_us(t1)) // 1000000), 0) AS BIGINT) FROM c
 UNION ALL SELECT 4, 'purchase', count(*), (SELECT count(*) FROM c), CAST(coalesce(sum((epoch_us(t4) - epoch_us(t1)) // 1000000), 0) AS BIGINT) FROM d""",
    "fatal_files": """SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 'unsupported_layout' WHEN 'HOUSEHOLD' THEN 'no_valid_rows' WHEN 'MACHINERY' THEN 'no_data_rows' ELSE 'missing_required_columns' END AS code, 'error' AS severity,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Required columns are missing: cost. The file needs a date, a service (or account/region) and a cost column.'
  WHEN 'BUILDING' THEN 'Required columns are missing: service (or account/region). The file needs a date, a service (or account/region) and a cost column.'
  WHEN 'FURNITURE' THEN 'This does not look like an AWS billing export. Expected a Cost Explorer CSV (dates in the first column, one column per service) or columns for date, service and cost.'
  WHEN 'HOUSEHOLD' THEN 'No rows could be read: every row had an invalid date or cost.' ELSE 'The file has a header but no data rows.' END AS message FROM customer""",
    "coverage_end": """WITH r AS (SELECT CAST(l_suppkey % 50 AS VARCHAR) AS export_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, last_day(l_shipdate) AS e,
  CAST(l_shipdate AS DATE) + CAST(CAST(l_quantity AS INT) // 5 - 20 AS INT) AS d, l_linenumber AS k, l_orderkey % 400 = 0 AS p FROM lineitem),
 g AS (SELECT export_id, m, max(e) AS e, max(t) FILTER (WHERE t >= m) AS reach, bool_or(p) AS p FROM (SELECT *, least(CASE WHEN k < 6 THEN d ELSE d + 20 END, e) AS t FROM r) GROUP BY ALL)
 SELECT export_id, strftime(m, '%Y-%m') AS month, coalesce(strftime(reach, '%Y-%m-%d'), '-') AS reach, CAST(p AS BIGINT) AS partial,
  CASE WHEN m >= DATE '2001-11-01' THEN 'month_to_date' WHEN p OR reach < e THEN 'ends_mid_month' ELSE '-' END AS reason FROM g""",
    "wide_repeats": """WITH o AS (SELECT o_orderkey // 2048 AS chunk, date_trunc('month', o_orderdate) AS m, o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_orderkey // 2048 ORDER BY o_orderkey) + 1 AS line FROM orders),
 l AS (SELECT *, lag(s) OVER (PARTITION BY chunk, m ORDER BY o_orderkey) AS before FROM o)
 SELECT CAST(chunk AS BIGINT) AS chunk, count(*) FILTER (WHERE s = before) AS repeats, coalesce(min(line) FILTER (WHERE s = before), 0) AS first_line, count(DISTINCT m) FILTER (WHERE s <> before) AS conflicts
 FROM l GROUP BY chunk HAVING count(before) > 0""",
}
