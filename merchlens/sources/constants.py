"""Fixed values shared by the source adapter and the reports.

Everything here is data, not logic. Values that the reports must reproduce
exactly are stated plainly and in their natural order.
"""

from __future__ import annotations

import datetime as dt

# ---------------------------------------------------------------------------
# FIXED VALUES: country attributes for the 25 nation keys of the test tables.
# (nation key, ISO code, country name, commercial region, commercial subregion)
# ---------------------------------------------------------------------------
COUNTRIES = [
    (0, "IN", "India", "APAC", "South Asia"),
    (1, "US", "United States", "AMER", "North America"),
    (2, "JP", "Japan", "APAC", "Japan"),
    (3, "CN", "China", "APAC", "Greater China"),
    (4, "HK", "Hong Kong", "APAC", "Greater China"),
    (5, "TW", "Taiwan", "APAC", "Greater China"),
    (6, "SG", "Singapore", "APAC", "Southeast Asia"),
    (7, "TH", "Thailand", "APAC", "Southeast Asia"),
    (8, "PH", "Philippines", "APAC", "Southeast Asia"),
    (9, "VN", "Vietnam", "APAC", "Southeast Asia"),
    (10, "ID", "Indonesia", "APAC", "Southeast Asia"),
    (11, "MY", "Malaysia", "APAC", "Southeast Asia"),
    (12, "AU", "Australia", "APAC", "ANZ"),
    (13, "NZ", "New Zealand", "APAC", "ANZ"),
    (14, "GB", "United Kingdom", "EMEA", "UK and Ireland"),
    (15, "DE", "Germany", "EMEA", "DACH"),
    (16, "FR", "France", "EMEA", "Southern Europe"),
    (17, "CA", "Canada", "AMER", "North America"),
    (18, "BR", "Brazil", "AMER", "Latin America"),
    (19, "MX", "Mexico", "AMER", "Latin America"),
    (20, "KH", "Cambodia", "APAC", "Southeast Asia"),
    (21, "MM", "Myanmar", "APAC", "Southeast Asia"),
    (22, "AE", "United Arab Emirates", "EMEA", "Middle East"),
    (23, "ZA", "South Africa", "EMEA", "Africa"),
    (24, "KR", "South Korea", "APAC", "Korea"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: payment gateways (key, name, category).
# Keys are assigned to transactions by part key modulo the list length.
# ---------------------------------------------------------------------------
GATEWAYS = [
    (0, "platform_payments", "Platform Payments"),
    (1, "Cash on Delivery (COD)", "Manual"),
    (2, "paypal", "Third Party"),
    (3, "cash_on_delivery", "Manual"),
    (4, "razorpay", "Third Party"),
    (5, "bank_deposit", "Manual"),
]

# The test tables hold dates from 1995 to 2001; the reports' default periods
# begin in 2019 to 2022. Every adapted date is moved forward by this many
# years, so that every cut-off of a report falls inside the data.
YEAR_SHIFT = 24

# Reporting date used instead of CURRENT_DATE / CURRENT_TIMESTAMP so that
# results are repeatable.
DEFAULT_AS_OF = dt.date(2025, 6, 15)

# ---------------------------------------------------------------------------
# FIXED VALUES: report parameters as written in the reference queries.
# ---------------------------------------------------------------------------
APAC_APP_COUNTRIES = ["IN", "TH", "PH", "SG", "VN", "ID", "BN", "KH", "TL", "MY", "LA", "MM"]
GREATER_CHINA_COUNTRIES = ["CN", "HK", "TW"]
COD_GATEWAY_NAMES = ["Cash on Delivery (COD)", "cash_on_delivery"]
PLAN_YEARS = ["2022", "2023"]
PLAN_FACT_YEARS = [2022, 2023]

# Stage names of opportunities counted as in progress, in the reference's order.
OPEN_STAGES = [
    "Solution Validation",
    "Exploration",
    "Contracting",
    "Term-Sheet",
    "On Hold",
    "Negotiation",
    "Open",
    "Prospect",
    "Discovery",
    "New",
    "Pre-Qualified",
    "Committed",
    "Qualified",
    "Booked",
    "Fit Confirmed",
    "In Progress",
    "Proposal",
    "Contract Sent",
    "Interest",
    "SAL",
    "Evaluation",
    "Demo",
    "Scoping",
]
WON_STAGE = "Closed Won"
LOST_STAGE = "Closed Lost"

# Monthly plan rows: (month, brokered_projection, hijacked_projection,
# cod_projection, captured). February 2022 occurs twice, as in the reference.
PLAN_ROWS = [
    ("2022-01-01", 0, 0, 0, 0),
    ("2022-02-01", 0, 0, 0, 0),
    ("2022-02-01", 0, 0, 0, 0),
    ("2022-03-01", 0, 0, 0, 0),
    ("2022-04-01", 0, 0, 0, 0),
    ("2022-05-01", 0, 0, 0, 0),
    ("2022-06-01", 0, 0, 0, 0),
    ("2022-07-01", 0, 0, 0, 0),
    ("2022-08-01", 0, 0, 0, 0),
    ("2022-09-01", 0, 0, 0, 0),
    ("2022-10-01", 0, 0, 0, 0),
    ("2022-11-01", 0, 0, 0, 0),
    ("2022-12-01", 0, 0, 0, 0),
    ("2023-01-01", 0, 0, 0, 0),
    ("2023-02-01", 84446445, 24033694, 59065915, 0),
    ("2023-03-01", 93901073, 24985383, 60302391, 0),
    ("2023-04-01", 82075949, 26039039, 61671347, 0),
    ("2023-05-01", 83577054, 27058706, 62996143, 0),
    ("2023-06-01", 83436793, 28112362, 64365099, 0),
    ("2023-07-01", 92167312, 25507713, 57831422, 11482787),
    ("2023-08-01", 85515810, 24576550, 51386096, 23294124),
    ("2023-09-01", 73854602, 19913719, 44319417, 35434010),
    ("2023-10-01", 88463550, 16866887, 37263473, 47881249),
    ("2023-11-01", 94910030, 13696868, 30064418, 60672935),
    ("2023-12-01", 87208680, 10357814, 22659495, 73761375),
]
