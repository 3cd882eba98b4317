"""Frozen constants of the experiment (fixed values)."""

from __future__ import annotations

#: The export's columns in order.
RAW_COLUMNS = (
    "Date received",
    "Product",
    "Sub-product",
    "Issue",
    "Sub-issue",
    "Consumer complaint narrative",
    "Company public response",
    "Company",
    "State",
    "ZIP code",
    "Tags",
    "Consumer consent provided?",
    "Submitted via",
    "Date sent to company",
    "Company response to consumer",
    "Timely response?",
    "Consumer disputed?",
    "Complaint ID",
)

#: Names of the candidates table's columns by export column.
CANDIDATE_COLUMNS = {
    "Complaint ID": "complaint_id",
    "Date received": "date_received",
    "Product": "product",
    "Sub-product": "sub_product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Consumer complaint narrative": "narrative",
    "Company": "company",
    "State": "state",
    "Tags": "tags",
    "Submitted via": "submitted_via",
}
#: Columns that a raw export must have: those of the candidates and the one the label comes from.
REQUIRED_COLUMNS = tuple(c for c in RAW_COLUMNS if c in CANDIDATE_COLUMNS or c == "Company response to consumer")
#: First and last day of each split, both included.
SPLIT_DATES = {
    "train": ("2019-01-01", "2022-12-31"),
    "dev": ("2023-01-01", "2023-12-31"),
    "test": ("2024-01-01", "2026-06-15"),
}
#: Rows drawn of each split.
SPLIT_ROWS = {"train": 1_000, "dev": 2_000, "test": 5_000}
NEARDUP_SIMILARITY, SHINGLE_WORDS = 0.8, 5
COMPANY_TOP_K = 50
RATE_BAND = (0.05, 0.30)
LABEL_COUNTS = (300, 1_000)
SEEDS_SMALL, SEEDS_LARGE = 10, 5
BOOTSTRAPS, MARGIN, HALF_WIDTH_MAX = 1_000, 0.02, 0.015
FAILURE_STOP, BROKEN_STD = 0.01, 0.01
SEQUENCE, SPECIAL, OVERLAP = 512, 3, 64
LOGREG_C = (0.01, 0.1, 1.0, 10.0)
TFIDF_NGRAMS, TFIDF_FEATURES, TFIDF_MIN_DF = ((1, 1), (1, 2)), 20_000, 2
STACK_FOLDS = 5
#: Booster settings below 1,000 labels, and the grid from there on.
BOOST_SMALL = {"num_leaves": 7, "min_child_samples": 5, "n_estimators": 200, "learning_rate": 0.05}
BOOST_GRID = (
    {"num_leaves": 15, "min_child_samples": 20, "n_estimators": 200, "learning_rate": 0.05},
    {"num_leaves": 31, "min_child_samples": 20, "n_estimators": 200, "learning_rate": 0.05},
    {"num_leaves": 15, "min_child_samples": 50, "n_estimators": 400, "learning_rate": 0.05},
    {"num_leaves": 31, "min_child_samples": 50, "n_estimators": 400, "learning_rate": 0.1},
)
#: Categorical fields of the tabular encoder, company first.
TABULAR_FIELDS = ("company", "product", "sub_product", "issue", "sub_issue", "state", "tags", "submitted_via")
