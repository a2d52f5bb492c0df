"""Metric definitions used on the driver's test tables (light and heavy mapping)."""

from __future__ import annotations

from ..sources.catalog import FormulaSpec as Fm
from ..sources.catalog import MetricSpec as M

# light: events(user_id, event_name in view/signup/error/click/purchase, event_value, event_timestamp, k)
REVENUE = Fm("revenue", "SUM(CASE WHEN event_name = 'purchase' THEN event_value ELSE 0 END)")
PURCHASES = Fm("purchases_cnt", "COUNT(CASE event_name WHEN 'purchase' THEN event_name ELSE NULL END)")
BIG_PURCHASES = Fm("big_purchases_cnt", "COUNT_IF(event_name = 'purchase' AND event_value >= 100)")
CLICKS = Fm("clicks_cnt", "COUNT(CASE event_name WHEN 'click' THEN event_name END)")
VIEWS = Fm("views_cnt", "COUNT(CASE event_name WHEN 'view' THEN event_name END)")
PURCHASER = Fm("purchaser_flg", "MAX(CASE WHEN event_name = 'purchase' THEN 1 ELSE 0 END)")
ERROR_SHARE = Fm("error_event_share", "AVG(CASE WHEN event_name = 'error' THEN 1 ELSE 0 END)")
VALUE_MEAN = Fm("event_value_mean", "AVG(event_value)")
DISTINCT_TYPES = Fm("distinct_event_types", "COUNT(DISTINCT event_name)")
MAX_VALUE = Fm("max_event_value", "MAX(event_value)")

LIGHT_METRICS = [
    M("revenue_per_user", "avg", REVENUE, display_name="Revenue per user", group_name="money", tags=("revenue", "core")),
    M("purchases_per_user", "avg", PURCHASES, display_name="Purchases per user", group_name="money", tags=("orders",)),
    M("avg_purchase_value", "ratio", REVENUE, PURCHASES, display_name="Average purchase value", group_name="money", tags=("revenue",)),
    M("click_through", "ratio", CLICKS, VIEWS, display_name="Clicks per view", group_name="engagement", tags=("core", "ux")),
    M("purchase_conversion", "proportion", PURCHASER, display_name="Purchase conversion", group_name="money", tags=("core",)),
    M("big_purchase_share", "proportion", BIG_PURCHASES, PURCHASES, display_name="Share of purchases >= 100", group_name="money", tags=None),
    M("error_share", "avg", ERROR_SHARE, display_name="Error share of events", group_name="quality", tags=("quality",)),
    M("event_value_mean", "avg", VALUE_MEAN, display_name="Mean event value", group_name="engagement", tags=("ux",)),
    M("distinct_event_types", "avg", DISTINCT_TYPES, display_name="Distinct event types", group_name="engagement", tags=("ux",)),
    M("max_event_value", "avg", MAX_VALUE, display_name="Max event value", group_name="engagement", tags=None),
]

# heavy: lineitem x orders per customer (event_name = l_returnflag, event_value = net price)
H_REVENUE = Fm("net_revenue", "SUM(event_value)")
H_LINES = Fm("lines_cnt", "COUNT(*)")
H_RETURNED = Fm("returned_lines", "COUNT(CASE WHEN event_name = 'R' THEN 1 END)")
H_RETURNER = Fm("returner_flg", "MAX(CASE WHEN event_name = 'R' THEN 1 ELSE 0 END)")
H_QTY = Fm("quantity", "SUM(l_quantity)")
H_OPEN = Fm("open_lines", "COUNT_IF(l_linestatus = 'O')")

HEAVY_METRICS = [
    M("revenue_per_customer", "avg", H_REVENUE, display_name="Net revenue per customer", group_name="sales", tags=("revenue",)),
    M("revenue_per_line", "ratio", H_REVENUE, H_LINES, display_name="Net revenue per line", group_name="sales", tags=("revenue",)),
    M("return_rate", "proportion", H_RETURNED, H_LINES, display_name="Returned line share", group_name="returns", tags=("quality",)),
    M("returner_share", "proportion", H_RETURNER, display_name="Customers with a return", group_name="returns", tags=("quality",)),
    M("quantity_per_customer", "avg", H_QTY, display_name="Quantity per customer", group_name="sales", tags=None),
    M("open_line_share", "ratio", H_OPEN, H_LINES, display_name="Open lines per line", group_name="sales", tags=("ops",)),
]
