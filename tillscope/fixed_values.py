"""Values fixed by the data model and the report layouts."""

from __future__ import annotations

from datetime import date

# --- Fixed values: enumerations of the star schema -------------------------
CUSTOMER_SEGMENTS = ("Regular", "Premium", "Budget")
CHANNELS = ("Online", "In-Store", "Click & Collect")
STATUSES = ("Processing", "Shipped", "Delivered", "Returned", "Cancelled")

CANCELLED = "Cancelled"
RETURNED = "Returned"
ONLINE = "Online"

# --- Fixed values: report labels and thresholds ----------------------------
NO_PROMOTION = "No Promotion"
NEW_CUSTOMER = "New"
RETURNING_CUSTOMER = "Returning"
BELOW_TREND = "Below Trend"
ON_TREND = "On/Above Trend"

RFM_AS_OF = date(2024, 12, 31)
RFM_BUCKETS = 5
RFM_OTHERS = "Others"
# label, then (lowest, highest) score for recency, frequency and monetary;
# None leaves that end open. The first matching row wins.
RFM_SEGMENTS = (
    ("Champions", (4, None), (4, None), (4, None)),
    ("Loyal Customers", (4, None), (3, None), (None, None)),
    ("New Customers", (4, None), (None, 2), (None, None)),
    ("Potential Loyalists", (3, 3), (3, None), (None, None)),
    ("At Risk", (None, 2), (4, None), (None, None)),
    ("Need Attention", (None, 2), (2, None), (3, None)),
    ("Lost", (1, 1), (1, 1), (None, None)),
)

CLV_TIERS = (50, 200, 500)
COHORT_PERIODS = 8
TOP_PRODUCTS = 10
ROLLING_ROWS = 3
SAMPLE_ROWS = 5

# upper edge in days and label; gaps beyond the last edge take GAP_BEYOND
GAP_BUCKETS = (
    (7, "0-7 days"),
    (14, "8-14 days"),
    (30, "15-30 days"),
    (60, "31-60 days"),
    (90, "61-90 days"),
)
GAP_BEYOND = "90+ days"
