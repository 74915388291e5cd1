"""Columns of a history and the codes that each feature family counts."""

from __future__ import annotations

# Names and codes must equal those of the feature tables that models were trained on.
PAYMENTS = [f"enc_paym_{i}" for i in range(25)]
HISTORY = [
    "rn", "pre_since_opened", "pre_since_confirmed", "pre_pterm", "pre_fterm", "pre_till_pclose", "pre_till_fclose",
    "pre_loans_credit_limit", "pre_loans_next_pay_summ", "pre_loans_outstanding", "pre_loans_total_overdue", "pre_loans_max_overdue_sum", "pre_loans_credit_cost_rate",
    "pre_loans5", "pre_loans530", "pre_loans3060", "pre_loans6090", "pre_loans90", "is_zero_loans5", "is_zero_loans530", "is_zero_loans3060", "is_zero_loans6090", "is_zero_loans90",
    "pre_util", "pre_over2limit", "pre_maxover2limit", "is_zero_util", "is_zero_over2limit", "is_zero_maxover2limit", *PAYMENTS,
    "enc_loans_account_holder_type", "enc_loans_credit_status", "enc_loans_credit_type", "enc_loans_account_cur", "pclose_flag", "fclose_flag",
]
BASIC_BUCKETS = {
    "pre_loans_credit_limit": range(20), "pre_loans_next_pay_summ": range(7), "pre_loans_outstanding": range(1, 6), "pre_loans_max_overdue_sum": range(1, 4), "pre_loans_credit_cost_rate": range(14),
    "pre_loans5": range(20), "pre_loans530": range(20), "pre_loans3060": range(10), "pre_loans6090": range(5), "pre_loans90": range(20),
    "pre_util": range(20), "pre_over2limit": range(20), "pre_maxover2limit": range(20),
    "enc_loans_account_holder_type": range(7), "enc_loans_credit_status": range(7), "enc_loans_credit_type": range(8), "enc_loans_account_cur": range(4), "pclose_flag": range(2), "fclose_flag": range(2),
}
EXTRA_BUCKETS = {
    "pre_since_opened": range(20), "pre_since_confirmed": range(18), "pre_pterm": range(18), "pre_fterm": range(17), "pre_till_pclose": range(17), "pre_till_fclose": range(16),
    **{c: range(5) for c in PAYMENTS},
}
DIST_BUCKETS = {
    **BASIC_BUCKETS, "pre_loans_total_overdue": range(2), "pre_loans_max_overdue_sum": range(4), "pre_loans5": (0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 13, 16), "pre_loans530": (*range(17), 18, 19), "pre_loans90": (2, 3, 8, 10, 13, 14, 19),
    "is_zero_loans5": range(2), "is_zero_loans530": range(2), "is_zero_loans3060": range(2), "is_zero_loans6090": range(2), "is_zero_loans90": range(2),
    "is_zero_util": range(2), "is_zero_over2limit": range(2), "is_zero_maxover2limit": range(2),
}
DIST_RECENT = (
    "pre_loans_credit_limit", "pre_loans_credit_cost_rate", "pre_loans530", "pre_loans3060", "pre_loans6090", "is_zero_loans3060", "is_zero_loans6090", "is_zero_loans90",
    "pre_util", "pre_over2limit", "enc_loans_credit_status", "enc_loans_credit_type",
)
#: Statistics over the latest rows cover these columns.
RECENT_COLUMNS = [c for c in HISTORY if c not in ("rn", "pre_loans_total_overdue", *PAYMENTS)]
RECENT_ROWS = (2, 3, 5, 10)
DIST_RECENT_ROWS = (3, 7)
SEQUENCE_ROWS = 14
#: name: left column, its codes, right column, its codes; a pair's code is left * 10 + right.
EXTRA_CROSSES = {
    "status_type": ("enc_loans_credit_status", 7, "enc_loans_credit_type", 8),
    "status_holder": ("enc_loans_credit_status", 7, "enc_loans_account_holder_type", 7),
    "type_cur": ("enc_loans_credit_type", 8, "enc_loans_account_cur", 4),
}
DIST_CROSSES = {
    "util_status": ("pre_util", 20, "enc_loans_credit_status", 7),
    "over_status": ("pre_over2limit", 20, "enc_loans_credit_status", 7),
    "limit_type": ("pre_loans_credit_limit", 20, "enc_loans_credit_type", 8),
    "cost_type": ("pre_loans_credit_cost_rate", 14, "enc_loans_credit_type", 8),
}
DELTAS = {"credit_limit": "pre_loans_credit_limit", "util": "pre_util", "status": "enc_loans_credit_status"}
MUST_KEEP = ("id_norm", "loan_count")
ID_SCALE = 3_000_000.0
