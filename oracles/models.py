"""SQL of the model evaluation queries.

Metrics and selection read fitted predictions, which SQL cannot give; tests hold them against direct solves.
"""

from oracles.windows import DATASET

SQL = {
    "ml_grid": f"""WITH {DATASET} SELECT ticker, selection_date, model, n AS parameter_sets, lower(model) || '_000' AS first_set, lower(model) || '_' || printf('%03d', n - 1) AS last_set
        FROM sel CROSS JOIN (VALUES ('OLS', CAST(1 AS BIGINT)), ('Ridge', 6), ('Lasso', 6), ('RandomForest', 8), ('XGBoost', 16)) g(model, n)""",
}
