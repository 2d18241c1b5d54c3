"""Check SQL pieces for the operators (names usable in ``with_``)."""

from __future__ import annotations

from catalog.inputs import CTE, cte

PANELS = ["px_type_w", "px_brand_w", "px_brand_m", "px_brand_d", "px_two", "drv_w", "drv_seg_d", "drv_nation_m", "evt_day", "emb"]


def add_positions(p: str) -> None:
    cte(
        f"{p}_pos", p,
        "SELECT panel_id, dt, row_number() OVER (PARTITION BY panel_id ORDER BY dt) - 1 AS pos, "
        f"count(*) OVER (PARTITION BY panel_id) AS n_dates FROM (SELECT DISTINCT panel_id, dt FROM {p}) q",
    )


def add_returns(p: str) -> None:
    cte(
        f"{p}_pairs", f"{p} {p}_pos",
        "SELECT a.panel_id, a.dt, a.series, c.pos, c.n_dates, a.value AS price, "
        "CASE WHEN lag(c.pos) OVER w = c.pos - 1 THEN lag(a.dt) OVER w END AS prior_dt, "
        "CASE WHEN lag(c.pos) OVER w = c.pos - 1 THEN lag(a.value) OVER w END AS prior_price "
        f"FROM {p} a JOIN {p}_pos c ON a.panel_id = c.panel_id AND a.dt = c.dt "
        "WINDOW w AS (PARTITION BY a.panel_id, a.series ORDER BY c.pos)",
    )
    cte(
        f"{p}_sync", f"{p}_pairs",
        "SELECT q.*, price / prior_price AS ratio, ln(price / prior_price) AS raw_log "
        f"FROM {p}_pairs q JOIN (SELECT panel_id, count(DISTINCT series) AS n_series FROM {p} GROUP BY 1) u "
        "ON q.panel_id = u.panel_id WHERE price > 0 AND prior_price > 0 "
        "QUALIFY count(*) OVER (PARTITION BY q.panel_id, q.dt) = n_series",
    )
    cte(f"{p}_ret", f"{p}_sync", f"SELECT panel_id, dt, series, raw_log AS value FROM {p}_sync")
    add_positions(f"{p}_ret")


for _p in PANELS:
    add_positions(_p)
for _p in PANELS[:8]:
    add_returns(_p)

SPLIT_GRID = (
    "(VALUES (0, 1/20.0), (1, 1/10.0), (2, 1/8.0), (3, 1/7.0), (4, 1/5.0), (5, 1/4.0), (6, 1/3.0), (7, 1/2.5), (8, 1/2.0), "
    "(9, 2.0), (10, 2.5), (11, 3.0), (12, 4.0), (13, 5.0), (14, 7.0), (15, 8.0), (16, 10.0), (17, 20.0))"
)

cte(
    "events_all", "px_brand_w_sync ledger",
    "SELECT s.*, l.disposition, l.factor, l.verification_status AS vs, l.event_type, l.source_url, l.rationale, "
    "abs(raw_log) >= 0.5 AS is_candidate, g.f AS near_factor, g.err AS near_err, "
    "CASE WHEN disposition = 'APPLY_FACTOR' THEN 'ADJUSTED_VERIFIED_FACTOR' "
    "WHEN disposition = 'EXCLUDE_DATE' THEN 'EXCLUDED_VERIFIED_DISTRIBUTION_DATE' "
    "WHEN disposition = 'KEEP_OBSERVED' THEN 'RETAINED_VERIFIED_MARKET_MOVE' "
    "WHEN abs(raw_log) >= 0.5 AND g.err <= 0.05 THEN 'ADJUSTED_MECHANICAL_SPLIT_CANDIDATE' "
    "WHEN abs(raw_log) >= 0.5 THEN 'UNMATCHED_LARGE_MOVE' END AS rule_status "
    "FROM px_brand_w_sync s LEFT JOIN ledger l ON s.panel_id = l.panel_id AND s.dt = l.dt AND s.series = l.series "
    "LEFT JOIN (SELECT r2.dt, r2.series, arg_min(f, (e, k)) AS f, min(e) AS err FROM ("
    "SELECT s2.dt, s2.series, k, CAST(f AS DOUBLE) AS f, abs(s2.ratio - CAST(f AS DOUBLE)) / CAST(f AS DOUBLE) AS e "
    f"FROM px_brand_w_sync s2, {SPLIT_GRID} v(k, f)) r2 GROUP BY 1, 2) g ON g.dt = s.dt AND g.series = s.series",
)
cte(
    "events", "events_all",
    "SELECT *, CASE WHEN disposition = 'APPLY_FACTOR' THEN factor WHEN is_candidate THEN near_factor END AS matched_split_factor, "
    "CASE WHEN disposition = 'APPLY_FACTOR' THEN abs(ratio - factor) / factor WHEN is_candidate THEN near_err END AS relative_error, "
    "CASE WHEN rule_status IN ('ADJUSTED_VERIFIED_FACTOR', 'ADJUSTED_MECHANICAL_SPLIT_CANDIDATE') THEN "
    "ln(ratio / CASE WHEN disposition = 'APPLY_FACTOR' THEN factor ELSE near_factor END) ELSE raw_log END AS adjusted_log_return, "
    "CASE WHEN disposition IS NULL AND rule_status IS NOT NULL THEN 'MECHANICAL_RULE_ONLY' ELSE vs END AS verification_status "
    "FROM events_all",
)
cte("excluded", "events", "SELECT DISTINCT panel_id, dt FROM events WHERE rule_status = 'EXCLUDED_VERIFIED_DISTRIBUTION_DATE'")
cte("kept_events", "events excluded", "SELECT * FROM events WHERE dt NOT IN (SELECT dt FROM excluded)")
# repaired weekly brand returns: the asset panel of the later steps
cte("assets", "kept_events", "SELECT panel_id, dt, series, adjusted_log_return AS value FROM kept_events")
add_positions("assets")
