"""Subscription plans."""

from __future__ import annotations

# Price in BDT and duration in days per plan, and the length of the free window.
PLAN_PRICES = {"WEEKLY": 100, "MONTHLY": 300, "QUARTERLY": 700, "HALF_YEARLY": 1000}
PLAN_DAYS = {"WEEKLY": 7, "MONTHLY": 30, "QUARTERLY": 90, "HALF_YEARLY": 180}
FREE_WINDOW_DAYS = 183
