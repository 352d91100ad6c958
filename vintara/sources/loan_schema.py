"""Fixed values of the public loan-level file layout (release 47).

Column names in file order, their types, and the codes that mean "not available".
The files have no header, so the order below is the layout.
"""

from __future__ import annotations

ORIGINATION = (
    "classic_fico",
    "first_payment_date",
    "first_time_homebuyer_indicator",
    "maturity_date",
    "metropolitan_statistical_area_or_metropolitan_division",
    "mortgage_insurance_percentage",
    "number_of_units",
    "occupancy_status",
    "original_combined_loan_to_value",
    "original_debt_to_income_ratio",
    "original_upb",
    "original_loan_to_value",
    "original_interest_rate",
    "channel",
    "prepayment_penalty_indicator",
    "amortization_type",
    "property_state",
    "property_type",
    "postal_code",
    "loan_identifier",
    "loan_purpose",
    "original_loan_term",
    "number_of_borrowers",
    "seller_name",
    "super_conforming_flag",
    "pre_harp_loan_sequence_number",
    "special_eligibility_program",
    "harp_indicator",
    "property_valuation_method",
    "interest_only_indicator",
    "vantagescore_4_0",
)

PERFORMANCE = (
    "loan_identifier",
    "period",
    "current_actual_upb",
    "current_loan_delinquency_status",
    "loan_age",
    "remaining_months_to_legal_maturity",
    "underwriting_defect_and_major_servicing_defect_settlement_date",
    "modification_flag",
    "zero_balance_code",
    "zero_balance_effective_date",
    "current_interest_rate",
    "current_non_interest_bearing_upb",
    "due_date_of_last_paid_installment",
    "mi_recoveries",
    "net_sales_proceeds",
    "non_mi_recoveries",
    "total_expenses",
    "legal_costs",
    "maintenance_and_preservation_costs",
    "taxes_and_insurance",
    "miscellaneous_expenses",
    "actual_loss",
    "cumulative_modification_costs",
    "interest_rate_step_indicator",
    "payment_deferral_flag",
    "estimated_loan_to_value",
    "zero_balance_removal_upb",
    "delinquent_accrued_interest",
    "delinquency_due_to_disaster",
    "borrower_assistance_plan",
    "current_period_modification_costs",
    "current_interest_bearing_upb",
    "mortgage_insurance_cancellation_indicator",
    "servicer_name",
    "bankruptcy_cramdown_costs",
)

TABLES = {"origination": ORIGINATION, "performance": PERFORMANCE}

SMALLINT = {
    "classic_fico",
    "estimated_loan_to_value",
    "mortgage_insurance_percentage",
    "number_of_borrowers",
    "number_of_units",
    "original_combined_loan_to_value",
    "original_debt_to_income_ratio",
    "original_loan_term",
    "original_loan_to_value",
    "vantagescore_4_0",
}

INTEGER = {"loan_age", "remaining_months_to_legal_maturity"}

DOUBLE = {
    "actual_loss",
    "bankruptcy_cramdown_costs",
    "cumulative_modification_costs",
    "current_actual_upb",
    "current_interest_bearing_upb",
    "current_interest_rate",
    "current_non_interest_bearing_upb",
    "current_period_modification_costs",
    "delinquent_accrued_interest",
    "legal_costs",
    "maintenance_and_preservation_costs",
    "mi_recoveries",
    "miscellaneous_expenses",
    "net_sales_proceeds",
    "non_mi_recoveries",
    "original_interest_rate",
    "original_upb",
    "taxes_and_insurance",
    "total_expenses",
    "zero_balance_removal_upb",
}

#: YYYYMM text columns that get a first-of-month date beside them.
MONTHS = {
    "due_date_of_last_paid_installment",
    "first_payment_date",
    "maturity_date",
    "period",
    "underwriting_defect_and_major_servicing_defect_settlement_date",
    "zero_balance_effective_date",
}

#: The code of each column that stands for "not available".
NOT_AVAILABLE = {
    "channel": "9",
    "classic_fico": "9999",
    "current_loan_delinquency_status": "XX",
    "estimated_loan_to_value": "999",
    "first_time_homebuyer_indicator": "9",
    "loan_purpose": "9",
    "mortgage_insurance_cancellation_indicator": "7",
    "mortgage_insurance_percentage": "999",
    "number_of_borrowers": "99",
    "number_of_units": "99",
    "occupancy_status": "9",
    "original_combined_loan_to_value": "999",
    "original_debt_to_income_ratio": "999",
    "original_loan_to_value": "999",
    "postal_code": "000",
    "property_type": "99",
    "property_valuation_method": "7",
    "vantagescore_4_0": "9999",
}

LOAN_KEY = "loan_identifier"
COHORT = "origination_vintage"


def sql_type(column: str) -> str:
    if column in SMALLINT:
        return "smallint"
    if column in INTEGER:
        return "int"
    return "double" if column in DOUBLE else "string"
